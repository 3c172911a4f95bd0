import math

import numpy as np

from siftlab.llm import embedding_dedup
from tests.llm.samples import groups_of

SCHEMA = "vec_id long, embedding array<float>, label int, node string, codes string, list int"


def brute(rows):
    unit = []
    for _, v, label in rows:
        ok = label is not None and v is not None and len(v) == 8 and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float64) if ok else None
        unit.append(None if x is None else x / np.sqrt(x @ x))
    near = lambda i, j: unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and unit[i] @ unit[j] >= 0.98
    root = groups_of(len(rows), near)
    return [(r[0], sum(near(i, j) for j in range(len(rows)) if j != i), rows[root[i]][0], root[i] == i) for i, r in enumerate(rows)]


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LIST_SIZE", 20)
    monkeypatch.setattr(embedding_dedup, "LIST_BLOCK", 16)
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for label in (1, 2):
        for _ in range(25):
            centre = rng.normal(size=8)
            for _ in range(int(rng.integers(1, 6))):
                v = np.float32(centre + rng.normal(size=8) * rng.choice([0, 0.02, 0.2]))
                rows.append((i, [float(x) for x in v], label))
                i += 1
    same = rows[0][1]
    odd = [None, [], [0.0] * 8, [math.nan] + [1.0] * 7, [math.inf] * 8, [None] + [1.0] * 7, [1.0] * 5]
    rows += [(i + k, v, 1) for k, v in enumerate(odd)] + [(900, same, None), (901, same, None), (902, same, 1), (903, [x * 3 for x in same], 1)]
    frame = spark.createDataFrame([(*r, "n", "c", 7) for r in rows], SCHEMA)
    got = sorted(tuple(r) for r in embedding_dedup.near_vectors(frame).collect())
    assert got == sorted(brute(rows))


def test_empty_useless_and_repeated(spark):
    run = lambda rows: sorted(tuple(r) for r in embedding_dedup.near_vectors(spark.createDataFrame([(*r, "n", "c", 7) for r in rows], SCHEMA)).collect())
    assert run([]) == []
    assert run([(1, None, 1), (2, [0.0], 1)]) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert run([(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [1.0, 2.0], 2)]) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def many(rng, labels=(1,)):
    """Dense groups of near vectors, loose ones, and vectors given twice."""
    rows = []
    for label in labels:
        centre = rng.normal(size=8)
        some = [centre + rng.normal(size=8) * 0.01 for _ in range(120)] + [rng.normal(size=8) for _ in range(120)]
        rows += [([float(x) for x in np.float32(v)], label) for v in some]
        rows += rows[-2:] + rows[-130:-127]
    return [(i, v, label) for i, (v, label) in enumerate(rows)]


def found(spark, rows, kind="float"):
    frame = spark.createDataFrame([(*r, "n", "c", 7) for r in rows], SCHEMA.replace("float", kind))
    return sorted(tuple(r) for r in embedding_dedup.near_vectors(frame).collect())


def test_written_tables_stay_linear(spark, monkeypatch):
    """No table has a row per vector and probed list, nor one per linked pair."""
    rows, seen, write = many(np.random.default_rng(4), labels=(1, 2)), {}, embedding_dedup.materialize

    def counted(df, label):
        table = write(df, label)
        seen[label] = table.count()
        return table

    monkeypatch.setattr(embedding_dedup, "materialize", counted)
    monkeypatch.setattr(embedding_dedup, "LIST_SIZE", 10)
    got = found(spark, rows)
    assert got == sorted(brute(rows))
    assert sum(r[1] for r in got) > 20 * len(rows)
    assert max(seen.values()) <= 2 * len(rows), seen


def test_labels_split_over_cells(spark, monkeypatch):
    """Cells of 24 vectors: lists and dense groups are cut through, pairs are found once."""
    monkeypatch.setattr(embedding_dedup, "LIST_SIZE", 10)
    monkeypatch.setattr(embedding_dedup, "LIST_BLOCK", 16)
    monkeypatch.setattr(embedding_dedup, "CELL_BYTES", 24 * 8 * 4)
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 8)
    monkeypatch.setattr(embedding_dedup, "AREA", 64)
    monkeypatch.setattr(embedding_dedup, "PAIRS", 32)
    rows = many(np.random.default_rng(5), labels=(3, -1))
    assert found(spark, rows) == sorted(brute(rows))
    wide = [(i, [x + 1e-9 for x in v], label) for i, v, label in rows]
    assert found(spark, wide, "double") == sorted(brute(wide))


def test_a_pair_of_cells_meets_once():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 8))
    quantiser = embedding_dedup.Quantiser(centres, [], 100.0)  # every ball meets every list
    order = embedding_dedup.near_order(centres)
    assert sorted(order.tolist()) == list(range(40))
    for wanted in (2, 3, 4, 7):
        sizes = np.array([400, *rng.integers(0, 30, 39)])
        n = int(sizes.sum())
        cells = embedding_dedup.Cells.plan(n + 50, [(2, 40), (5, n), (9, 41)], {5: wanted}, {5: sizes}, order, 100)
        lists, node = np.repeat(np.arange(40), sizes), rng.integers(-(2**62), 2**62, n)
        home, row, cell = cells.places(quantiser, np.full(n, 5), node, lists, centres[lists])
        used = cells.lists[5][2]
        assert home.min() >= cells.first[1] and home.max() < cells.first[2] == cells.first[1] + used
        assert np.bincount(home).max() <= cells.rows and cells.count == cells.first[2] + 1
        goes = np.zeros((n, cells.count), int)
        np.add.at(goes, (row, cell), 1)
        here = home[:, None] == home[None]
        assert ((goes[:, home] + goes[:, home].T)[~here] == 1).all() and not goes[np.arange(n), home].any()
        assert goes.sum(1).max() <= used // 2
