"""Files in, files out, and incremental jobs."""

import json

import pytest
from pyspark.sql import functions as F

from siftlab.sources import jsonl, responses as RS, runs as RN, sinks, tables as TB, truth as TR
from siftlab.streaming import jobs as JB


def test_jsonl_scan(spark, tmp_path):
    folder = tmp_path / "src"
    folder.mkdir()
    (folder / "batch_1__her_2945.jsonl").write_text('{"doi": "10.1/a", "row_number": 1}\n\n[1]\n{"doi": "10.1/b"}\n', encoding="utf-8")
    (folder / "batch_3__热电_1696.jsonl").write_text('{"doi": "10.1/c"}\n', encoding="utf-8")
    lines = jsonl.read_lines(spark, str(folder))
    rows = jsonl.tagged_records(lines, "doi string, row_number int").collect()
    assert sorted((r.task_type, r.record.doi) for r in rows) == [("HER", "10.1/a"), ("HER", "10.1/b"), ("thermoelectric", "10.1/c")]
    (folder / "batch_1__oer_219.jsonl").write_text("{broken\n", encoding="utf-8")
    lines = jsonl.read_lines(spark, str(folder))
    with pytest.raises(Exception, match="Invalid JSON in batch_1__oer_219.jsonl"):
        jsonl.tagged_records(lines, "doi string").collect()
    assert [r.line for r in jsonl.tagged_records(lines, "doi string", strict=False).where("corrupt").collect()] == ["{broken"]


def test_truth_layouts(spark):
    samples = spark.createDataFrame(
        [({"reaction_type": "her", "doc_id": "https://doi.org/10.1/A", "product": None, "id": "7"}, {"overpotential": ">= 30 mV"})], "m map<string,string>, g map<string,string>"
    ).select(
        F.struct(
            F.col("m.reaction_type").alias("reaction_type"), F.col("m.doc_id").alias("doc_id"), F.col("g").alias("metrics_gt"),
            F.array(F.lit("Pt")).alias("metals"), F.col("m.product").alias("product"), F.create_map().cast("map<string,string>").alias("units"), F.col("m.id").alias("id"),
        ).alias("meta")
    )
    rows = spark.createDataFrame([("conductivity", "10.2/b", 4, ["Fe"], "5 S/m"), ("other", "10.2/c", 5, [], "1"), ("conductivity", "10.2/d", 6, [], None)], "_schema string, doi string, row_number int, metals array<string>, conductivity string")
    targets = TR.truth_targets(samples, rows)
    got = {r.task_type: (r.doi, r.row_number, r.metrics) for r in targets.collect()}
    assert got == {"HER": ("10.1/a", None, {"overpotential": ">= 30 mV"}), "conductivity": ("10.2/b", 4, {"conductivity": "5 S/m"})}
    values = {r.task_type: r for r in TR.truth_values(targets).collect()}
    assert (values["HER"].comparator, values["HER"].contract, values["conductivity"].contract) == (">=", "declared", "canonical")


def test_feedback_csv_headers(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("反应类型,金属元素,主要产物,数值,单位,测试条件\nHER,Pt,,30,mV,10 mA cm-2\n", encoding="utf-8")
    row = TB.read_feedback_csv(spark, str(path)).collect()[0].asDict()
    assert row == {"reaction_type": "HER", "metals": "Pt", "product": None, "value": "30", "unit": "mV", "condition": "10 mA cm-2"}
    with pytest.raises(ValueError, match="missing required"):
        TB.resolve_headers(["a", "b"], required=("value",))
    found = TB.resolve_headers(["reaction_type", "partial current density (mA)", "value"])
    assert "partial_current_density" not in found and "condition" not in found


def test_wide_sheet(spark):
    sheet = spark.createDataFrame([("e1", "Ni", "300mV, 0.25V", "无", "1.4"), ("", "Ni", "1", "1", "1")], "id string, metals string, `OER eta` string, HER string, UOR string")
    got = {r.id: (r.value, r.unit) for r in TB.wide_to_long(sheet, "id", "metals").collect()}
    assert got == {"e1_OER": (250.0, "mV"), "e1_UOR": (1.4, "V")}


def test_documents_and_ids(spark, tmp_path):
    (tmp_path / "paper_her.md").write_text("# T\nDOI: 10.1234/ABC.\n", encoding="utf-8")
    (tmp_path / "note.md").write_text("no id here", encoding="utf-8")
    (tmp_path / "skip.txt").write_text("x", encoding="utf-8")
    got = {r.reaction_type: r.doc_id for r in TB.read_documents(spark, str(tmp_path)).collect()}
    assert got["HER"] == "10.1234/abc" and got["unknown"].startswith("no-doi:note_")
    tsv = tmp_path / "ids.tsv"
    tsv.write_text("index\ttitle\tdoi\n108\tx\t10.5/z\n", encoding="utf-8")
    from siftlab.operators.joins import selective_lookup

    table = TB.read_id_table(spark, str(tsv))
    wanted = spark.createDataFrame([("108",), ("9",)], "index string")
    assert {r["index"]: r.doi for r in selective_lookup(table, wanted, "index", "doi").collect()} == {"108": "10.5/z", "9": None}


def test_traces(spark, tmp_path):
    trace = {
        "experiment_id": "e1", "timestamp": "t", "result": {
            "debate_history": [
                {"type": "propose", "proposal_id": "p1", "agent_name": "A", "claim": "Reaction Type: HER\nx"},
                {"type": "review", "round": 1, "from_proposal_id": "p2", "target_proposal_id": "p1", "flaw_type": "unit", "critique": "wrong", "valid": True},
            ],
            "surviving_proposals": [{"proposal_id": "p1"}], "defeated_proposals": [], "withdrawn_proposals": [],
        },
    }
    (tmp_path / "r.json").write_text(json.dumps(trace, indent=1), encoding="utf-8")
    traces = RS.read_traces(spark, str(tmp_path / "r.json"))
    p = RS.proposals(traces).collect()
    assert [(r.proposal_id, r.status, r.reaction_type, r.debate_id) for r in p] == [("p1", "surviving", "HER", "e1")]
    assert RS.critiques(traces).count() == 1
    row = RS.reward_rows(traces).collect()[0]
    assert (row.reward, row.reasoning) == (1.0, "- [unit] from p2: wrong")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, f"ü{i}") for i in range(10)], "b int, a string")
    assert sinks.write_json_lines(df, str(tmp_path / "out"), 10) == 10
    assert spark.read.text(str(tmp_path / "out")).where(F.col("value") == '{"a":"ü3","b":3}').count() == 1
    with pytest.raises(RuntimeError):
        sinks.write_json_lines(df, str(tmp_path / "out2"), 11)
    sinks.write_parts(df, df.select("b", F.lit("x").alias("doi")), "b", "b", 4, str(tmp_path / "parts"))
    sizes = [r["count"] for r in spark.read.json(str(tmp_path / "parts/requests")).groupBy("part").count().orderBy("part").collect()]
    assert sizes == [4, 4, 2]
    assert spark.read.json(str(tmp_path / "parts/map")).count() == 10
    target = str(tmp_path / "copy")
    assert sinks.copy_collection(df.where("b < 6"), target, "b") == 6
    assert sinks.copy_collection(df.where("b < 6"), target, "b") == 0
    with pytest.raises(RuntimeError, match="refusing"):
        sinks.copy_collection(df, target, "b")
    assert sinks.copy_collection(df, target, "b", resume=True) == 4


def test_run_table_pruning(spark, tmp_path):
    runs = spark.createDataFrame([(i, "e1" if i % 2 else "e2", "judged", float(i)) for i in range(6)], "id int, exp_id string, stage string, reward double")
    RN.write_runs(runs, str(tmp_path / "runs"))
    scan = RN.run_scan(RN.read_runs(spark, str(tmp_path / "runs")), "e1")
    assert "PartitionFilters: [isnotnull(exp_id" in scan._jdf.queryExecution().executedPlan().toString().replace("\n", " ")
    assert [r.id for r in RN.ordered_listing(RN.read_runs(spark, str(tmp_path / "runs")), "e1", order="reward_desc").collect()] == [5, 3, 1]


def test_stream_batches_equal_one_batch(spark, tmp_path):
    src, rows = tmp_path / "in", [(i % 7, f"s{i % 3}", i) for i in range(60)]
    schema = "key int, stage string, pos int"
    for n in range(3):
        spark.createDataFrame(rows[n * 20 : (n + 1) * 20], schema).coalesce(1).write.mode("append").parquet(str(src))
    stage = F.when(F.col("stage") == "s2", "judged").when(F.col("stage") == "s1", "rollout").otherwise("init")
    stream = JB.file_stream(spark, str(src), schema, max_files=1).withColumn("stage", stage)
    JB.run_available(stream, str(tmp_path / "sink"), str(tmp_path / "check"), lambda b, _: JB.current_stage(b, "key", "pos"))
    got = JB.current_stage(JB.read_sink(spark, str(tmp_path / "sink"), stream.schema), "key", "pos")
    want = JB.current_stage(spark.read.parquet(str(src)).withColumn("stage", stage), "key", "pos")
    assert sorted(map(tuple, got.select("key", "stage", "pos").collect())) == sorted(map(tuple, want.select("key", "stage", "pos").collect()))


def test_incremental_index_skips_known_keys(spark, tmp_path):
    src, sink = tmp_path / "in", str(tmp_path / "sink")
    schema = "key int, pos int"
    run = lambda: JB.append_missing(JB.file_stream(spark, str(src), schema), sink, str(tmp_path / "check"), "key", "pos")
    spark.createDataFrame([(1, 1), (1, 0), (2, 2)], schema).write.mode("append").parquet(str(src))
    run()
    spark.createDataFrame([(2, 9), (3, 3)], schema).write.mode("append").parquet(str(src))
    run()
    assert sorted(map(tuple, JB.read_sink(spark, sink, schema).collect())) == [(1, 0), (2, 2), (3, 3)]


def test_cache_and_snapshots(spark, tmp_path):
    cache = spark.createDataFrame([("k", "2024-01-01 00:00:00", 1), ("k", "2024-01-02 00:00:00", 2), ("o", "2023-01-01 00:00:00", 3)], "key string, ts string, id int").withColumn("ts", F.to_timestamp("ts"))
    live = JB.reusable_results(cache, ["key"], "ts", F.lit("2024-01-02 12:00:00").cast("timestamp"), 86400, "id")
    assert [(r.key, r.id) for r in live.collect()] == [("k", 2)]
    notes = spark.createDataFrame([("n",)], "content string")
    for step in (0, 1, 1):
        JB.write_snapshot(notes, str(tmp_path / "snap"), "e", step)
    last = JB.latest_snapshot(spark.read.parquet(str(tmp_path / "snap")))
    assert [(r.experiment, r.step) for r in last.collect()] == [("e", 1)]
