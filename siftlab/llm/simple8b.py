"""Simple-8b: integers packed into 64-bit words, with escapes and an index of blocks."""

from __future__ import annotations

import numpy as np

# Selector k (the top four bits of a word) packs COUNTS[k] integers of BITS[k] bits each.
# Selector 0 is the escape: the next word holds one integer of up to 64 bits as it is.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.uint64)
BLOCK = 8192
_SHIFT = np.uint64(60)


def _selectors(values: np.ndarray) -> np.ndarray:
    """For every position the densest selector whose integers all fit; past the end counts as 0."""
    n = len(values)
    chosen = np.zeros(n, np.int8)
    open_, here = np.ones(n, bool), np.arange(n)
    wide = np.zeros(n + 1, np.int32)
    for k in range(1, len(COUNTS)):
        count = int(COUNTS[k])
        too_wide = values >> BITS[k] > 0
        n_wide = int(np.count_nonzero(too_wide))
        if n - n_wide < count and n_wide:  # too few small integers to fill a word
            continue
        np.cumsum(too_wide, out=wide[1:])
        fits = open_ & (wide[np.minimum(here + count, n)] == wide[:-1])
        chosen[fits] = k
        open_ &= ~fits
        if not n_wide:
            break
    return chosen


def encode_block(values: np.ndarray) -> np.ndarray:
    """Pack unsigned integers into words; the last word may be padded with zeros."""
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    chosen = _selectors(values)
    step = COUNTS[chosen].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += step[at]
    starts = np.array(starts, np.int64)
    used = chosen[starts] if len(starts) else np.zeros(0, np.int8)
    place = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(used == 0)[:-1]]).astype(np.int64) if len(starts) else starts
    words = np.zeros(len(starts) + int((used == 0).sum()), np.uint64)
    padded = np.concatenate([values, np.zeros(int(COUNTS.max()), np.uint64)])
    for k in np.unique(used):
        rows = starts[used == k]
        if k == 0:
            words[place[used == 0] + 1] = padded[rows]
            continue
        word = np.full(len(rows), np.uint64(k) << _SHIFT, np.uint64)
        for j in range(int(COUNTS[k])):
            word |= padded[rows + j] << (BITS[k] * np.uint64(j))
        words[place[used == k]] = word
    return words


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[bytes, list[int]]:
    """(payload, offsets): little-endian words of all blocks, and the first word of each block."""
    parts, offsets, at = [], [], 0
    for start in range(0, len(values), block):
        words = encode_block(values[start : start + block])
        offsets.append(at)
        parts.append(words)
        at += len(words)
    payload = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return payload.astype("<u8").tobytes(), offsets


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` integers of a block; all words of one selector are unpacked at once."""
    selector = (words >> _SHIFT).astype(np.int64)
    raw = np.zeros(len(words), bool)  # words behind an escape hold data, not a selector
    if (selector == 0).any():
        at = 0
        for k in np.flatnonzero(selector == 0).tolist():
            if k >= at:
                raw[k + 1] = True
                at = k + 2
    count = np.where(raw, 0, COUNTS[np.where(raw, 0, selector)])
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for k in np.unique(selector[~raw]):
        rows = np.flatnonzero((selector == k) & ~raw)
        if k == 0:
            out[first[rows]] = words[rows + 1]
            continue
        size, bits = int(COUNTS[k]), BITS[k]
        mask = np.uint64((1 << int(bits)) - 1)
        shifts = np.arange(size, dtype=np.uint64) * bits
        out[(first[rows][:, None] + np.arange(size)).ravel()] = ((words[rows][:, None] >> shifts) & mask).ravel()
    return out[:n]


def decode(payload: bytes, offsets: list[int], n: int, block: int = BLOCK) -> np.ndarray:
    """All integers of a payload, block by block."""
    words = np.frombuffer(payload, "<u8").astype(np.uint64)
    ends = [*offsets, len(words)][1:]
    parts = [
        decode_block(words[a:b], min(block, n - i * block)) for i, (a, b) in enumerate(zip(offsets, ends, strict=True))
    ]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)
