"""Null keys are keys like others, and no group count or length is built in."""

import pytest
from pyspark.sql import functions as F

from siftlab.functions import claims, documents
from siftlab.operators import distributions, evaluation, feedback, ordinals, quality, retrieval, sampling
from siftlab.sources import responses, runs

OBS = (
    "task_type string, doi string, material_identity string, context_key string, label_key string, status string, ready boolean, "
    "source_file string, row_number long, extraction_index long, material_index long"
)


@pytest.fixture
def conflicting(make):
    base = ("HER", "d", "m", None)
    return make([(*base, "a", "direct", True, "f", 1, 1, 1), (*base, "b", "direct", True, "f", 2, 1, 1), ("HER", "e", "m", "c", "a", "direct", True, "f", 3, 1, 1)], OBS)


def test_conflicts_of_a_null_context(conflicting):
    assert quality.conflict_groups(conflicting).count() == 1
    assert quality.conflict_rows(conflicting).count() == 2
    got = {r["row_number"]: r["outcome"] for r in quality.select_candidates(conflicting).collect()}
    assert got == {1: "conflicting_context", 2: "conflicting_context", 3: "selected"}


def test_distributions_of_a_null_group(make):
    df = make([(None, float(i), "x") for i in range(10)] + [("g", float(i), "y") for i in range(4)], "g string, v double, c string")
    assert {r["g"]: r["median"] for r in distributions.basic_stats(df, ["g"], "v").collect()} == {None: 4.5, "g": 1.5}
    sums = {r["g"]: r["n"] for r in distributions.histogram(df, ["g"], "v").groupBy("g").agg(F.sum("count").alias("n")).collect()}
    assert sums == {None: 10, "g": 4}
    assert {r["g"] for r in distributions.density_curve(df, ["g"], "v", 8).collect()} == {None, "g"}
    many = make([(None, c) for c in "aabbc"], "g string, c string")
    assert {r["c"]: r["n"] for r in distributions.top_categories(many, ["g"], "c", 1).collect()} == {"a": 2, "OTHER": 3}


def test_samples_of_a_null_group(make):
    df = make([(None if i % 2 else "g", i, f"d{i}") for i in range(20)], "g string, id long, doc string")
    assert sampling.balanced_sample(df, "g", "id", 3, 1).groupBy("g").count().where("count = 3").count() == 2
    assert sampling.disjoint_sample(df, "g", "doc", "id", 3, 1).groupBy("g").count().where("count = 3").count() == 2
    hashed = df.withColumn("_h", ordinals.hash_key(1, "g", "id"))
    assert ordinals.take_quota(hashed, "g", "_h", "id", 2).count() == 4
    runs_of = make([(None, i, i, i % 2 == 0, "ok") for i in range(6)], "level long, dataset_index long, id long, correct boolean, judged_response string")
    assert evaluation.pass_at_k(runs_of, 1, by_level=True).collect()[0]["total_problems"] == 6


def test_rows_without_an_experiment_stay(make):
    table = make([("a", 1), (None, 2), ("b", 3)], "exp_id string, id long")
    assert sorted(r["id"] for r in runs.clear_experiment(table, "a").collect()) == [2, 3]


@pytest.mark.parametrize("n", [300, 12_000])
def test_round_robin_of_many_groups(spark, n):
    rows = spark.range(2 * n).select(F.pmod("id", F.lit(n)).cast("string").alias("g"), "id")
    got = sampling.round_robin(rows, "g", ["id"]).select("position", "id").orderBy("position").collect()
    assert [r["position"] for r in got] == list(range(2 * n))
    assert all(r["id"] < n for r in got[:n])
    with pytest.raises(ValueError):
        sampling.check_source(rows, "g", "id", [str(i) for i in range(n - 1)])


def test_limits_are_the_callers(make):
    records = make([(i,) for i in range(30)], "id long")
    assert feedback.cap_records(records, ["id"], 25).count() == 25
    with pytest.raises(ValueError):
        feedback.cap_records(records, ["id"], 0)


def test_whole_texts_and_all_decimals(make):
    far = "word " * 6000 + "https://doi.org/10.1234/far end"
    row = make([(far, "x\n" * 300 + "# A title far down the page", "1.2345678 ± 0.0000001")], "a string, b string, c string")
    got = row.select(
        documents.document_doi("a").alias("doi"), documents.document_doi("a", 8000, 20000).alias("near"),
        documents.title_candidates("b").alias("titles"), claims.single_point(F.col("c"), F.lit("none")).alias("point"),
        documents.clean_markup(F.lit("caf&eacute; &#233;<b>&mdash;</b>")).alias("clean"),
    ).collect()[0]
    assert (got["doi"], got["near"]) == ("10.1234/far", None)
    assert got["titles"] == ["A title far down the page"]
    assert got["point"] == "1.2345678"
    assert got["clean"] == "café é —"


def test_vector_search_edges(make):
    vectors = make([("a", [1.0, 0.0], "d", "t"), ("b", [1.0, 0.0], "d", "t"), ("c", [1.0, 0.0, 0.0], "d", "t"), ("d", [1.0, 0.0], "d", "t")], "id string, embedding array<double>, doc_id string, task_type string")
    queries = make([("q", [2.0, 0.0], None, None), ("zero", [0.0, 0.0], None, None), ("long", [1.0, 0.0, 0.0], None, None)], "qid string, embedding array<double>, tasks array<string>, masked_doc string")
    for grid in (None, 2):
        got = sorted((r["qid"], r["id"]) for r in retrieval.vector_top_k(vectors, queries, 2, grid=grid).collect())
        assert got == [("long", "c"), ("q", "a"), ("q", "b")]


def test_dead_letters_keep_the_line(make):
    lines = make([('{"custom_id": ' + "x" * 900,), ("{}",)], "line string")
    requests = make([("1", 1, "10.1/a")], "custom_id string, row_number long, doi string")
    dead = responses.dead_letters(responses.classify_responses(lines, requests, "conductivity")).collect()
    assert sorted(len(r["raw_line"]) for r in dead) == [2, 914]
