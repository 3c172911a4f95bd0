"""Pivot search against brute force: same hits, and fewer rows read where vectors have structure."""

import numpy as np
import pytest

from siftlab.operators import pivots as P
from siftlab.operators.pivots import build_index, pivot_top_k
from siftlab.operators.retrieval import vector_top_k

V = "id string, embedding array<double>, doc_id string, task_type string"
Q = "qid string, embedding array<double>, tasks array<string>, masked_doc string"


def _clustered(n, seed=3, centres=40, dim=16, spread=0.05):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    m = c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))
    return [(f"v{i:05d}", m[i].tolist(), f"D{i % 7}", ("HER", "OER")[i % 2]) for i in range(n)]


def _rows(df):
    return sorted((r.qid, r["rank"], r.id, round(r.score, 8)) for r in df.collect())


def _queries(rows, step, tasks=None, masked=None):
    return [(r[0], r[1], tasks, masked) for r in rows[::step]]


@pytest.mark.parametrize("tasks, masked, distance", [(None, None, None), (["OER"], "d3", None), (None, None, 0.02)])
def test_equal_to_full_search(make, tasks, masked, distance):
    rows = _clustered(3000)
    queries = make(_queries(rows, 60, tasks, masked), Q)
    vectors = make(rows, V)
    hits, _ = pivot_top_k(build_index(vectors), queries, 5, distance)
    assert _rows(hits) == _rows(vector_top_k(vectors, queries, 5, distance))


def test_share_of_rows_read_falls(make):
    shares = []
    for n in (1000, 8000):
        rows = _clustered(n)
        _, work = pivot_top_k(build_index(make(rows, V)), make(_queries(rows, n // 20), Q), 5)
        got = work.collect()
        assert all(0 < r.scored <= r.total == n for r in got)
        shares.append(sum(r.scored for r in got) / sum(r.total for r in got))
    assert shares[1] < shares[0] / 2 and shares[1] < 0.2


def test_odd_vectors(make, monkeypatch):
    """Ties, zero and other-length vectors, nulls, split blocks, empty tables."""
    monkeypatch.setattr("siftlab.operators.pivots.PART_ROWS", 50)
    rows = _clustered(400) + [(f"c{i:03d}", [1.0] + [0.0] * 15, "x", "HER") for i in range(300)]
    rows += [("zero", [0.0] * 16, "x", "HER"), ("null", None, "x", "HER"), ("short", [1.0, 2.0], None, None), ("none", [], "x", "HER")]
    queries = make(
        [("same", [2.0] + [0.0] * 15, None, None), ("short", [1.0, 2.0], None, None), ("zero", [0.0] * 16, None, None),
         ("null", None, None, None), ("far", [-1.0] + [0.0] * 15, None, None)], Q,
    )
    vectors = make(rows, V)
    hits, work = pivot_top_k(build_index(vectors), queries, 8)
    assert _rows(hits) == _rows(vector_top_k(vectors, queries.where("embedding is not null"), 8))
    assert {r.qid for r in work.collect()} == {"same", "short", "zero", "far"}
    empty, work = pivot_top_k(build_index(make([], V)), queries, 8)
    assert empty.count() == 0 and {r.scored for r in work.collect()} == {0}


def test_a_query_travels_once_to_a_bin(make):
    """Directions without structure rule out no block: rows chosen follow the bins, not the blocks."""
    rng = np.random.default_rng(5)
    rows = [(f"v{i:05d}", v.tolist(), "d", "HER") for i, v in enumerate(rng.normal(size=(3000, 16)))]
    index = build_index(make(rows, V))
    table = [tuple(r) for r in index.blocks.orderBy("pivot", "ring").collect()]
    bins = P._bins(table)
    queries = make(_queries(rows, 300), Q).selectExpr("*", "-2.0D as floor")
    got = P._choose_blocks(index, table, bins, queries, 0, None).collect()
    n_bins = max(first + parts for first, parts in bins)
    assert n_bins <= P.BINS < len(table)
    assert len(got) == 10 * n_bins and sum(r.n for r in got) == 10 * 3000
    assert sorted(b for r in got if r.qid == "v00000" for b in r.blocks) == list(range(len(table)))
