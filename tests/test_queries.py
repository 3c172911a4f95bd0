"""The driver contract: every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from siftlab.plans.registry import TABLES
from tools.compare import rows_of

FOLDER = "/root/testdata/sf0.001"
# A cross-section; tools/compare.py runs all of them.
SAMPLE = [
    "flagship_cross_record_report", "agg11_selection_accounting", "jon2_binding_by_elements", "jon3_binding_by_name", "jon11_set_similarity",
    "agg20_histogram", "win3_document_disjoint_allocation", "win5_round_robin", "nrm7_record_cleaning", "nrm26_claim_metric_extraction", "src10_batch_response_outcomes",
    "top3_idf_keyword_ranking", "vec1_two_level_chunking", "set6_operation_merge", "inc2_incremental_index", "agg31_round_means",
]


def test_registry_is_consistent():
    queries, sqls = entry_points.queries(), entry_points.oracle_sql()
    assert set(sqls) <= set(queries)
    assert {q for q in queries if not q.startswith("op") and q != "pipeline"} <= set(sqls)
    assert len(queries) >= 180


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = entry_points.queries()[name](spark, FOLDER)
    cur = con.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())


@pytest.mark.parametrize("name", ["inc1_stage_progress", "inc2_incremental_index", "inc4_first_results_stream"])
def test_streams_read_tables_of_many_files(spark, tmp_path, name):
    con = duckdb.connect()
    for t in ("documents", "events"):
        spark.read.parquet(f"{FOLDER}/{t}.parquet").repartition(3).write.parquet(str(tmp_path / f"{t}.parquet"))
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = entry_points.queries()[name](spark, str(tmp_path))
    cur = con.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())


def test_reference_removal_of_null_texts_and_phone_numbers(spark, tmp_path):
    texts = [None, "", "x", "a, b\n+1 (235) 555-2058 un, co, ezta", "a. b.\n+1 (207) 555-1984 ndth. is."]
    rows = [(i, texts[i // 5]) for i in range(25)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = entry_points.queries()["nrm21_reference_removal"](spark, str(tmp_path))
    cur = con.execute(entry_points.oracle_sql()["nrm21_reference_removal"])
    columns = [d[0] for d in cur.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())
