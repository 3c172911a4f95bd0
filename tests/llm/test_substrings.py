import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from siftlab.llm import substrings
from tests.llm.samples import docs_frame, document


def covered(texts, size):
    count = Counter(t[i : i + size] for t in texts for i in range(len(t) - size + 1))
    out = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - size + 1):
            if count[t[i : i + size]] > 1:
                mask[i : i + size] = True
        out.append(mask)
    return out


def related_texts(rng, n, alphabet="abcé"):
    texts = []
    for _ in range(n):
        kind = rng.random()
        noise = lambda k: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, k)))
        if texts and kind < 0.6:
            source = rng.choice(texts)
            a = rng.randint(0, len(source))
            texts.append(noise(20) + source[a : rng.randint(a, len(source))] + noise(20))
        elif kind < 0.7:
            texts.append(("a" + noise(4)) * rng.randint(1, 30))
        else:
            texts.append(noise(150))
    return texts


def expected(texts, size):
    out = {}
    for i, (raw, mask) in enumerate(zip(texts, covered(texts, size), strict=True)):
        kept = bytes(np.frombuffer(raw, np.uint8)[~mask])
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out[i] = (len(raw), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def test_suffix_array_marks_what_brute_force_marks():
    rng = random.Random(1)
    for _ in range(150):
        texts = [t.encode() for t in related_texts(rng, rng.randint(1, 6))]
        size = rng.choice([3, 5, 9, 12])
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        mask = np.zeros(len(data), bool)
        for a, n in zip(*substrings.repeated_ranges(data, offsets, size), strict=True):
            mask[a : a + n] = True
        assert (mask == np.concatenate(covered(texts, size))).all()


def test_maximal_repeats_list_all_occurrences():
    found = substrings.maximal_repeats([b"xabcdey", b"zabcdew", b"abcd"], 3)
    assert (5, [(0, 1), (1, 1)]) in found
    assert (4, [(0, 1), (1, 1), (2, 0)]) in found
    assert all(len(at) > 1 for _, at in found)
    assert not [f for f in found if f[0] == 3]  # "bcd" and the like extend to the left in all places


@pytest.mark.parametrize("long_group,array_bytes", [(20_000, 2 << 20), (2, 500)])
def test_removal_equals_brute_force(spark, monkeypatch, long_group, array_bytes):
    monkeypatch.setattr(substrings, "LONG_GROUP", long_group)
    monkeypatch.setattr(substrings, "ARRAY_BYTES", array_bytes)
    texts = related_texts(random.Random(7), 40)
    frame = docs_frame(spark, [document(i, t) for i, t in enumerate(texts)])
    got = {r[0]: tuple(r[1:]) for r in substrings.remove_repeats(frame, min_bytes=24, anchor_bytes=9).collect()}
    assert got == expected([t.encode() for t in texts], 24)


def test_awkward_rows(spark):
    rows = substrings.remove_repeats(docs_frame(spark)).collect()
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append(r)
    assert len(rows) == 28
    assert by_id[2][0]["n_bytes"] == 0 and by_id[1][0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert [r["n_removed"] == r["n_bytes"] > 400 for r in by_id[4] + by_id[5]] == [True] * 3
    assert by_id[12][0]["n_removed"] == 5000 and by_id[12][0]["n_spans"] == 1
    assert by_id[7][0]["n_removed"] == 0
    assert substrings.remove_repeats(docs_frame(spark, [])).count() == 0
