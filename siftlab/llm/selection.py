"""Keeping and removing documents by id without shuffling texts where the id list is small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from siftlab.session import materialize

# Id lists of at most this many rows are sent to all executors; longer ones are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def _id_list(ids: DataFrame, column: str) -> DataFrame:
    listed = materialize(ids.select(F.col(column).alias("_llm_listed")).distinct(), "ids")
    return F.broadcast(listed) if listed.count() <= BROADCAST_IDS else listed


def keep_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is listed; a null id matches a listed null."""
    return docs.join(_id_list(ids, column), F.col(column).eqNullSafe(F.col("_llm_listed")), "left_semi")


def drop_ids(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is not listed; a null id matches a listed null."""
    return docs.join(_id_list(ids, column), F.col(column).eqNullSafe(F.col("_llm_listed")), "left_anti")


def thinned(hashed: Column, wanted: int, total: int) -> Column:
    """Condition that leaves about four times ``wanted`` of ``total`` rows, by hash.

    A sample is then cut from what is left, so the last task sees few rows from however many tasks.
    """
    slots = 1 << 20
    return F.lit(True) if total <= 4 * wanted else F.pmod(hashed, F.lit(slots)) <= slots * 4 * wanted // total


def _key_list(keys: DataFrame, label: str) -> DataFrame:
    listed = materialize(keys.select(F.col("id").alias("_llm_id"), F.col("text_hash").alias("_llm_listed")).distinct(), label)
    return F.broadcast(listed) if listed.count() <= BROADCAST_IDS else listed


def kept_rows(docs: DataFrame, marked: DataFrame, text_hash: Column, column: str = "doc_id") -> DataFrame:
    """``docs`` without the rows that are not kept, and of rows equal in id and text one.

    ``marked`` has (column, text_hash, kept) of every row. Rows are told apart by id, null or not,
    and text hash, so an id says nothing on rows of another text. Only rows given twice are shuffled.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    marked = marked.select(F.col(column).alias("id"), "text_hash", "kept")
    keyed = docs.withColumn("_llm_hash", text_hash)
    same = F.col(column).cast("long").eqNullSafe(F.col("_llm_id")) & (F.col("_llm_hash") == F.col("_llm_listed"))
    left = keyed.join(_key_list(marked.where("not kept"), "dropped"), same, "left_anti")
    again = marked.where("kept").groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = _key_list(again, "repeated")
    if again.isEmpty():
        return left.select(columns)
    once = left.join(again, same, "left_anti")
    return once.unionByName(left.join(again, same, "left_semi").dropDuplicates([column, "_llm_hash"])).select(columns)
