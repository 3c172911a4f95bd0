import pytest
from pyspark.sql import functions as F

from siftlab.llm import mixing
from tests.llm.samples import WORD, awkward_documents, docs_frame, document


def test_sizes_targets_and_copies(spark):
    rows = awkward_documents()
    plan = [r.asDict() for r in mixing.mix_plan(docs_frame(spark)).collect()]
    assert len(plan) == len(rows)
    assert sorted(r["size"] for r in plan) == sorted(len(WORD.findall(r[1] or "")) for r in rows)
    by_source = {}
    for r in plan:
        by_source.setdefault(r["source"], []).append(r)
    total = sum(r["size"] for r in plan)
    ordered = sorted(by_source, key=lambda s: (s is None, s))
    assert [by_source[s][0]["rank"] for s in ordered] == list(range(len(ordered)))
    targets = {s: g[0]["target"] for s, g in by_source.items()}
    assert sum(targets.values()) == pytest.approx(total)
    for s, group in by_source.items():
        assert targets[s] <= 3 * group[0]["source_size"] + 1e-6
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in group)
        assert abs(sum(r["taken"] for r in group) - targets[s]) <= max(r["size"] for r in group)
        assert all((r["position"] is None) == (r["copies"] == 0) for r in group)
    again = [r.asDict() for r in mixing.mix_plan(docs_frame(spark).repartition(7)).collect()]
    key = lambda r: str(sorted(r.items(), key=str))
    assert sorted(plan, key=key) == sorted(again, key=key)


def test_time_inverts_the_schedule(spark):
    shares = [i / 20 for i in range(21)]
    frame = spark.createDataFrame([(s, k) for s in shares for k in range(3)], "share double, k long")
    for r in frame.withColumn("t", mixing.time_of(F.col("share"), F.col("k"))).collect():
        knots = mixing.SCHEDULES[r["k"]]
        area = lambda upto: sum(
            (min(t1, upto) - t0) * (w0 + (w0 + (w1 - w0) * (min(t1, upto) - t0) / (t1 - t0))) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]) if upto > t0
        )
        assert area(r["t"]) / area(1.0) == pytest.approx(r["share"], abs=1e-9)


def test_mixed_documents_are_in_training_order(spark):
    frame = docs_frame(spark, [document(i, "w " * (5 + i), "en", f"s{i % 3}") for i in range(60)])
    mixed = mixing.mix_documents(frame)
    assert mixed.columns == frame.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(frame).collect()}
    got = [r["doc_id"] for r in mixed.collect()]
    assert sorted(got) == sorted(i for i, n in copies.items() for _ in range(n))
    order = mixing.training_order(mixing.mix_plan(frame)).collect()
    assert [r["doc_id"] for r in order] == got and [r["position"] for r in order] == sorted(r["position"] for r in order)
    assert mixing.mix_documents(docs_frame(spark, [])).count() == 0
    assert mixing.mix_plan(docs_frame(spark, [document(1, None), document(2, "")])).where("taken > 0").count() == 0
