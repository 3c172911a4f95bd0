"""Removal of repeated byte strings through enhanced suffix arrays and their common-prefix interval trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from siftlab.llm.words import ByteHashes, as_texts, bounded, concat_ranges, slices, text_bytes
from siftlab.session import materialize

MIN_BYTES = 400
ANCHOR_BYTES = 128
# Bytes of text of which one suffix array is built, and the stretches of one anchor beyond which
# their windows are counted by a Spark aggregate instead.
ARRAY_BYTES = 2 << 20
LONG_GROUP = 20_000
# Lists of at most this many rows go to the texts; beyond it the texts are shuffled to them.
BROADCAST_ROWS = 500_000
_NO_ID = -(1 << 63)
_PIECE = 1024


def sliding_minimum(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest value of every ``size`` neighbours, in two running minima over blocks."""
    n = len(values) - size + 1
    if n <= 0:
        return values[:0]
    fill = np.full(-len(values) % size, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([values, fill]).reshape(-1, size)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[size - 1 : size - 1 + n])


def stretches(data: np.ndarray, offsets: np.ndarray, min_bytes: int, anchor: int):
    """Runs of windows with the same anchor: (text, first window, last window, anchor, content hash, holds it twice).

    A window's anchor is the smallest hash of the ``anchor``-byte strings inside it, so equal
    windows have equal anchors, wherever they stand.
    """
    hashes = ByteHashes(data)
    grams = hashes.windows(anchor)
    width = min_bytes - anchor + 1
    least = sliding_minimum(grams, width)
    room = np.maximum(np.diff(offsets) - min_bytes + 1, 0)  # windows per text
    at = concat_ranges(offsets[:-1], room)
    text = np.repeat(np.arange(len(room)), room)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    value = least[at]
    fresh = np.ones(len(at), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(fresh)
    stop = np.concatenate([begin[1:], [len(at)]]) - 1
    first, last, key = at[begin], at[stop], value[begin]
    length = last - first + width
    hits = np.repeat(key, length) == grams[concat_ranges(first, length)]
    twice = np.add.reduceat(hits, np.cumsum(length) - length, dtype=np.int64) > 1
    return text[begin], first, last, key, hashes.ranges(first, last + min_bytes), twice


@dataclass
class SuffixArray:
    """Suffixes of several byte strings in order, with their common prefixes (a sparse enhanced suffix array)."""

    starts: np.ndarray  # of the suffixes, in suffix order
    prefix: np.ndarray  # common prefix of each with the next
    left: np.ndarray  # byte before each; a negative number that occurs once at the start of a string


def _sorted(raw: bytes, starts: list[int], ends: list[int], depth: int = 0) -> list[int]:
    """Suffixes in byte order, compared piece by piece so that long ones are never copied whole."""
    keys = [raw[a + depth : min(b, a + depth + _PIECE)] for a, b in zip(starts, ends, strict=True)]
    order = sorted(range(len(keys)), key=keys.__getitem__)
    out, k = [], 0
    while k < len(order):
        stop = k + 1
        while stop < len(order) and keys[order[stop]] == keys[order[k]]:
            stop += 1
        tied = order[k:stop]
        if stop - k > 1 and len(keys[order[k]]) == _PIECE:
            inner = _sorted(raw, [starts[i] for i in tied], [ends[i] for i in tied], depth + _PIECE)
            tied = [tied[i] for i in inner]
        out += tied
        k = stop
    return out


def suffix_array(data: np.ndarray, offsets: np.ndarray, depth: int) -> SuffixArray:
    """The suffixes at which maximal repeats of ``depth`` bytes or more can start.

    Those are the windows of ``depth`` bytes that stand twice and not always behind the same
    byte. The others are left out: a window that always follows the same byte repeats as part of
    a repeat that starts further left.
    """
    hashes = ByteHashes(data)
    room = np.maximum(np.diff(offsets) - depth + 1, 0)
    at = concat_ranges(offsets[:-1], room)
    end = np.repeat(offsets[1:], room)
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    before = np.where(first[at], -1 - at, data[np.maximum(at - 1, 0)].astype(np.int64))
    codes, unique = pd.factorize(hashes.ranges(at, at + depth))
    low, high = np.full(len(unique), 1 << 40), np.full(len(unique), -(1 << 40))
    np.minimum.at(low, codes, before)
    np.maximum.at(high, codes, before)
    kept = np.flatnonzero((low != high)[codes])
    kept = kept[np.array(_sorted(data.tobytes(), at[kept].tolist(), end[kept].tolist()), np.int64)]
    starts, ends = at[kept], end[kept]
    a, b = starts[:-1], starts[1:]
    lo, hi = np.zeros(len(a), np.int64), np.minimum(ends[:-1] - a, ends[1:] - b) if len(a) else np.zeros(0, np.int64)
    while (lo < hi).any():  # the longest equal prefix by halving
        middle = (lo + hi + 1) // 2
        equal = hashes.ranges(a, a + middle) == hashes.ranges(b, b + middle)
        lo, hi = np.where(equal, middle, lo), np.where(equal, hi, middle - 1)
    return SuffixArray(starts, lo, before[kept])


@dataclass
class PrefixIntervals:
    """Nodes of the interval tree: suffixes ``low..high`` share ``length`` bytes; ``diverse``: not all extend left alike."""

    low: np.ndarray
    high: np.ndarray
    length: np.ndarray
    parent: np.ndarray
    diverse: np.ndarray


def prefix_intervals(array: SuffixArray, min_bytes: int) -> PrefixIntervals:
    """Scan the common prefixes with a stack; every interval of ``min_bytes`` or more is a node."""
    prefix = np.where(array.prefix >= min_bytes, array.prefix, 0)
    differs = np.concatenate([[0], np.cumsum(array.left[1:] != array.left[:-1])])
    low, high, length, parent = [], [], [], []
    stack: list[list] = []  # [length, low, children]
    active = np.flatnonzero(prefix)
    visit = np.unique(np.concatenate([active, active + 1])) if len(active) else active
    values = np.concatenate([prefix, [0]])
    for k in visit.tolist():
        now, left = int(values[k]), k
        carried: list[int] = []
        while stack and stack[-1][0] > now:
            size, left, children = stack.pop()
            node = len(low)
            low.append(left)
            high.append(k)
            length.append(size)
            parent.append(-1)
            for c in children + carried:
                parent[c] = node
            carried = [node]
        if now and (not stack or stack[-1][0] < now):
            stack.append([now, left, carried])
        elif stack:
            stack[-1][2] += carried
    lo, hi = np.array(low, np.int64), np.array(high, np.int64)
    diverse = differs[hi] > differs[lo] if len(lo) else np.zeros(0, bool)
    return PrefixIntervals(lo, hi, np.array(length, np.int64), np.array(parent, np.int64), diverse)


def repeated_ranges(data: np.ndarray, offsets: np.ndarray, min_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of all occurrences of the maximal repeats of ``min_bytes`` or more.

    A suffix stands in a chain of nested intervals; its longest left-diverse one is the longest
    maximal repeat that starts there. Intervals that all members extend by the same byte are
    occurrences of a longer repeat, which starts further left.
    """
    array = suffix_array(data, offsets, min_bytes)
    tree = prefix_intervals(array, min_bytes)
    if not len(tree.low):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # The smallest interval of each suffix: nodes are closed children first.
    node = np.full(len(array.starts), -1, np.int64)
    order = np.argsort(-(tree.high - tree.low), kind="stable")  # parents before children
    for k in order.tolist():
        node[tree.low[k] : tree.high[k] + 1] = k
    while True:
        climb = (node >= 0) & ~tree.diverse[node]
        if not climb.any():
            break
        node[climb] = tree.parent[node[climb]]
    found = np.flatnonzero(node >= 0)
    return array.starts[found], tree.length[node[found]]


def maximal_repeats(texts: list[bytes], min_bytes: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, occurrences as (text, position)) of each maximal repeat of the given texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    array = suffix_array(data, offsets, min_bytes)
    tree = prefix_intervals(array, min_bytes)
    text = np.searchsorted(offsets, array.starts, side="right") - 1
    out = []
    for k in np.flatnonzero(tree.diverse).tolist():
        rows = range(int(tree.low[k]), int(tree.high[k]) + 1)
        out.append((int(tree.length[k]), sorted((int(text[r]), int(array.starts[r] - offsets[text[r]])) for r in rows)))
    return out


def _union(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged ranges in order; ranges that touch are one."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    cut = np.ones(len(starts), bool)
    cut[1:] = starts[1:] > ends[:-1]
    begin = np.flatnonzero(cut)
    return starts[begin], ends[np.concatenate([begin[1:], [len(starts)]]) - 1] if len(begin) else ends


def _sent(rows: DataFrame) -> DataFrame:
    kept = materialize(rows, "list")
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def _anchors(texts: DataFrame, min_bytes: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            data, offsets = text_bytes(as_texts(piece.column("text")))
            text, first, last, key, content, twice = stretches(data, offsets, min_bytes, anchor)
            rows = pa.array(text)
            base = offsets[:-1][text]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("id").take(rows), piece.column("h").take(rows), pa.array(key.view(np.int64)), pa.array(content.view(np.int64)),
                    pa.array(first - base), pa.array(last - base), pa.array(twice),
                ],
                names=["id", "h", "anchor", "content", "first", "last", "twice"],
            )

    return bounded(texts).mapInArrow(run, "id long, h long, anchor long, content long, first long, last long, twice boolean")


def _contexts(texts: DataFrame, wanted: DataFrame, min_bytes: int) -> DataFrame:
    """(anchor, id, h, first, body) of the wanted stretches, cut from their texts."""
    lists = wanted.groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(
        F.collect_list(F.struct("anchor", "first", "last")).alias("stretches")  # bounded by the text's length
    )
    joined = texts.join(_sent(lists), (F.col("id") == F.col("_id")) & (F.col("h") == F.col("_h"))).select("id", "h", "text", "stretches")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            lists = piece.column("stretches")
            flat = lists.flatten()
            row = np.repeat(np.arange(len(piece)), lists.value_lengths().to_numpy(zero_copy_only=False))
            raw = [t.encode() for t in piece.column("text").to_pylist()]
            first, last = flat.field("first").to_numpy(), flat.field("last").to_numpy()
            body = [raw[r][a : b + min_bytes] for r, a, b in zip(row.tolist(), first.tolist(), last.tolist(), strict=True)]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [flat.field("anchor"), piece.column("id").take(take), piece.column("h").take(take), flat.field("first"), pa.array(body, pa.binary())],
                names=["anchor", "id", "h", "first", "body"],
            )

    return joined.mapInArrow(cut, "anchor long, id long, h long, first long, body binary")


_RANGES = "id long, h long, start long, stop long"


def _ranges_of(ids, hs, firsts, offsets: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    """Ranges in a concatenation of stretches, merged and as positions in the documents."""
    if len(starts):
        row = np.searchsorted(offsets, starts, side="right") - 1
        gap = np.arange(len(offsets))[row]  # keeps ranges of neighbouring stretches apart
        a, b = _union(starts + gap, starts + lengths + gap)
        row = np.searchsorted(offsets[:-1] + np.arange(len(offsets) - 1), a, side="right") - 1
        shift = firsts[row] - offsets[row] - row
        columns = [ids[row], hs[row], a + shift, b + shift]
    else:
        columns = [np.zeros(0, np.int64)] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "h", "start", "stop"])


def _search(contexts: DataFrame, min_bytes: int) -> DataFrame:
    """Ranges of the maximal repeats among the stretches of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if not held or (batch is not None and size < ARRAY_BYTES):
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            anchors = table.column("anchor").to_numpy()
            whole = len(anchors)
            if batch is not None:  # the last anchor may go on
                whole = int(np.searchsorted(anchors, anchors[-1], side="left"))
            done = 0
            bodies = table.column("body").chunk(0) if whole else None
            ids, hs, firsts = (table.column(c).to_numpy() for c in ("id", "h", "first"))
            ends = np.cumsum(pc.binary_length(bodies).to_numpy().astype(np.int64)) if whole else None
            while done < whole:  # whole anchors of about ARRAY_BYTES together
                base = ends[done - 1] if done else 0
                stop = min(whole, max(done + 1, int(np.searchsorted(ends, base + ARRAY_BYTES, side="right"))))
                while stop < whole and anchors[stop] == anchors[stop - 1]:
                    stop += 1
                data, offsets = text_bytes(bodies.slice(done, stop - done).cast(pa.large_binary()))
                starts, lengths = repeated_ranges(data, offsets, min_bytes)
                yield _ranges_of(ids[done:stop], hs[done:stop], firsts[done:stop], offsets, starts, lengths)
                done = stop
            rest = table.slice(whole)
            held, size = rest.to_batches(), sum(b.nbytes for b in rest.to_batches()) if rest.num_rows else 0

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _RANGES)


def _count_windows(contexts: DataFrame, min_bytes: int) -> DataFrame:
    """The same for anchors with very many stretches: windows are counted by a combinable aggregate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "body"):
            data, offsets = text_bytes(piece.column("body").cast(pa.large_binary()))
            hashes = ByteHashes(data).windows(min_bytes)
            room = np.diff(offsets) - min_bytes + 1
            at = concat_ranges(offsets[:-1], room)
            row = np.repeat(np.arange(len(room)), room)
            start = at - offsets[:-1][row] + piece.column("first").to_numpy()[row]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [piece.column("id").take(take), piece.column("h").take(take), pa.array(start), pa.array(hashes[at].view(np.int64))],
                names=["id", "h", "start", "window"],
            )

    windows = materialize(contexts.mapInArrow(run, "id long, h long, start long, window long"), "windows")
    often = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    hit = windows.join(often, "window", "left_semi")
    return hit.select("id", "h", "start", (F.col("start") + min_bytes).alias("stop"))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, anchor_bytes: int = ANCHOR_BYTES,
    with_text: bool = False,
) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary]) per row.

    Every byte covered by a string of ``min_bytes`` bytes that also starts elsewhere is removed,
    judged on the given texts. Windows are grouped by their anchor, the smallest hash of the
    ``anchor_bytes``-byte strings in them, so equal windows meet whatever document holds them.
    Stretches of windows whose whole content occurs twice are removed at once; of the others,
    those that share an anchor are cut out and searched by an enhanced suffix array. An anchor with more than
    ``LONG_GROUP`` different stretches is searched by counting window hashes in a combinable
    aggregate. A null or empty text has no bytes; texts shorter than ``min_bytes`` lose none;
    repeated rows and null ids are documents like others, so a row given twice loses all its
    bytes if it is long enough; other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), text.alias("text"), F.xxhash64(text).alias("h"))
    long_texts = rows.where(F.octet_length("text") >= min_bytes)
    anchors = materialize(_anchors(long_texts, min_bytes, anchor_bytes), "anchors")
    # A stretch whose anchor stands once, in one place, holds no repeated window.
    shared = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("twice").alias("any_twice")).where("n > 1 or any_twice")
    met = materialize(anchors.join(shared.select("anchor"), "anchor", "left_semi"), "met")
    least = F.min(F.struct("id", "h", "first", "last")).alias("one")
    contents = materialize(met.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("c"), F.max("twice").alias("twice"), least), "contents")
    often = contents.where("c > 1").select("anchor", "content")
    whole = met.join(often, ["anchor", "content"], "left_semi").select("id", "h", F.col("first").alias("start"), (F.col("last") + min_bytes).alias("stop"))
    kinds = contents.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.max(F.col("twice") & (F.col("c") == 1)).alias("inner"))
    kinds = kinds.where("m > 1 or inner")
    wanted = materialize(
        contents.join(kinds, "anchor").select("anchor", "m", "one.id", "one.h", "one.first", "one.last"), "wanted"
    )
    few, many = wanted.where(F.col("m") <= LONG_GROUP), wanted.where(F.col("m") > LONG_GROUP)
    ranges = whole.unionByName(_search(_contexts(long_texts, few, min_bytes), min_bytes))
    if not many.isEmpty():
        ranges = ranges.unionByName(_count_windows(_contexts(long_texts, many, min_bytes), min_bytes))
    spans = ranges.groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(
        F.collect_set(F.struct("start", "stop")).alias("ranges")  # bounded by the text's length
    )
    joined = rows.join(_sent(spans), (F.col("id") == F.col("_id")) & (F.col("h") == F.col("_h")), "left").select("id", "text", "ranges")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            removed, count, digest, size, kept = [], [], [], [], []
            for text, ranges in zip(piece.column("text").to_pylist(), piece.column("ranges"), strict=True):
                raw = text.encode()
                size.append(len(raw))
                if not ranges.is_valid:
                    removed.append(0)
                    count.append(0)
                else:
                    values = ranges.values
                    a, b = _union(values.field("start").to_numpy(), values.field("stop").to_numpy())
                    removed.append(int((b - a).sum()))
                    count.append(len(a))
                    edges = [0, *np.stack([a, b], axis=1).ravel().tolist(), len(raw)]
                    raw = b"".join(raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                digest.append(hashlib.sha256(raw).hexdigest())
                if with_text:
                    kept.append(raw)
            columns = [pa.array(c, pa.int64()) for c in (size, removed, count)] + [pa.array(digest, pa.string())]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays([piece.column("id"), *columns], names=["id", *names])

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")
    out = joined.mapInArrow(strip, schema)
    return out.withColumn("id", F.when(F.col("id") != _NO_ID, F.col("id"))).withColumnRenamed("id", id_col)
