"""Dealing out scans for heavy row work."""

from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from siftlab.operators.records import clean_records
from siftlab.session import spread


def _rows_per_task(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_one_row_group_is_dealt_to_all_cores(spark, tmp_path):
    path = str(tmp_path / "one.parquet")
    spark.range(40_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x")).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "128k")
    try:
        scan = spark.read.parquet(path)
        cores = spark.sparkContext.defaultParallelism
        assert scan.rdd.getNumPartitions() >= cores and len(_rows_per_task(scan)) == 1
        assert max(_rows_per_task(spread(scan))) <= 2 * 40_000 / cores
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_folded_names_are_spread(spark):
    df = entry_points.queries()["nrm2_folded_entity_names"](spark, "/root/testdata/sf0.001")
    assert len(_rows_per_task(df)) >= spark.sparkContext.defaultParallelism


def test_cleaning_computes_only_what_is_asked_for(spark):
    raw = spark.createDataFrame(
        [(1, "s", "UOR", ["pt", None, " "], None, {"potential": "1.5 V", "overpotential": "", "note": None})],
        "id long, source string, reaction_type string, metals array<string>, material_name string, metrics map<string,string>",
    )
    cleaned = clean_records(raw)
    row = cleaned.first()
    assert (row["metals"], row["metrics_gt"], row["units"], row["drop_reason"]) == (["Pt"], {"potential_10mAcm-2": "1.5 V"}, {"potential_10mAcm-2": "V"}, None)
    plan = cleaned.select("id", "drop_reason")._jdf.queryExecution().optimizedPlan().toString()
    assert "map_from_entries" not in plan and "sort_array" not in plan


def test_metals_of_answers_need_no_set_per_row(spark):
    from siftlab.sources.responses import classify_responses

    answer = '{\\"metals\\": [\\"Fe\\", null, \\"O\\", \\"Fe\\", \\"Co\\"], \\"property_type\\": \\"conductivity\\", \\"conductivity\\": \\"5 S/m\\"}'
    line = '{"custom_id": "1", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": "%s"}}]}}}' % answer
    lines = spark.createDataFrame([(line,)], "line string")
    requests = spark.createDataFrame([("1", 1, "10.1/x")], "custom_id string, row_number int, doi string")
    df = classify_responses(lines, requests, "conductivity")
    assert [(r["outcome"], r["metals"]) for r in df.collect()] == [("kept", ["Fe", "Co"])]
    assert "array_intersect" not in df._jdf.queryExecution().analyzed().toString()
