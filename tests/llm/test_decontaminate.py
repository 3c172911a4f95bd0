import random

import numpy as np

from siftlab.llm import decontaminate
from tests.llm.samples import docs_frame, document, words

ITEMS = "item_id long, text string, id string, seed string"


def tiles_by_hand(doc, item, size):
    """Greedy tiling by comparing all positions."""
    used_doc, used_item, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for q in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and p + n not in used_doc and q + n not in used_item:
                    n += 1
                if n > best[0]:
                    best = (n, q, p)
        if best[0] < size:
            return covered
        n, q, p = best
        used_item |= set(range(q, q + n))
        used_doc |= set(range(p, p + n))
        covered += n


def test_tiling_equals_brute_force(spark):
    rng = random.Random(4)
    items = {k: words(rng, rng.randint(12, 30), "abcdef").split() for k in range(6)}
    docs = {}
    for i in range(25):
        body = words(rng, 25).split()
        item = items[rng.randrange(6)]
        cut = rng.randint(3, len(item) - 3)
        parts = [item[:cut], item[cut:]]
        rng.shuffle(parts)
        at = rng.randint(0, len(body))
        docs[i] = body[:at] + parts[0] + rng.choice([[], ["zz"], body[:3]]) + (parts[1] if rng.random() < 0.6 else parts[1][:2]) + body[at:]
    frame = docs_frame(spark, [document(i, " ".join(d)) for i, d in docs.items()])
    bench = spark.createDataFrame([(k, " ".join(w).upper() + ".", "i", "s") for k, w in items.items()], ITEMS)
    got = {(r["doc_id"], r["item_id"]): r["covered"] for r in decontaminate.contaminated(frame, bench, coverage=0.3).collect()}
    want = {}
    for i, d in docs.items():
        for k, w in items.items():
            n = tiles_by_hand(d, w, decontaminate.MIN_TILE)
            if n / len(w) >= 0.3:
                want[i, k] = n
    assert got == want and want


def test_tiles_do_not_overlap():
    doc, item = np.array([0, 1, 2, 3, 10, 11]), np.array([0, 1, 2, 3, 1, 2])
    got = decontaminate.tile(doc, item, 8, 5)
    assert got == [(0, 0, 8)]
    assert decontaminate.tile(np.repeat(doc, 2), np.repeat(item, 2), 8, 5) == got  # a row given twice


def test_awkward_rows(spark):
    frame = docs_frame(spark)
    long_text = [r for r in frame.collect() if r["doc_id"] == 7][0]["text"]
    passage = " ".join(long_text.split()[20_000:20_020])
    bench = spark.createDataFrame(
        [(1, None, "i", "s"), (2, "", "i", "s"), (3, passage, "i", "s"), (4, passage.upper(), "i", "s"), (None, passage, "i", "s"), (5, "one", "i", "s")], ITEMS
    )
    got = sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in decontaminate.contaminated(frame, bench).collect())
    assert got == [(7, 3, 1.0), (8, 5, 1.0)]
    assert decontaminate.contaminated(docs_frame(spark, []), bench).count() == 0
    assert decontaminate.contaminated(frame, bench.limit(0)).count() == 0
