"""The corpus pipeline: stages that each read what the stage before them kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from siftlab.llm import decontaminate, mixing, simhash, token_output, toxicity
from siftlab.llm.queries import tokenizer_file
from siftlab.llm.selection import drop_ids, kept_rows
from siftlab.session import materialize, scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose toxicity reaches the threshold; the models learn from the labels of ``docs``."""
    scored = toxicity.with_toxicity(docs, _table(spark, sf_dir, "labels"), score_col="_llm_toxicity")
    return scored.where(F.col("_llm_toxicity") < toxicity.THRESHOLD).select([F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of near-duplicates, of the smallest id; rows of null or repeated ids are judged each."""
    found = materialize(simhash.similar_documents(docs), "near")
    return kept_rows(docs, found, simhash.text_hash("text"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose tiles cover half of a benchmark item."""
    return drop_ids(docs, decontaminate.contaminated(docs, _table(spark, sf_dir, "benchmark")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that every source meets its target, in training order."""
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token ids in document order and reports per document what the files hold."""
    return token_output.token_output(docs, tokenizer_file())


STAGES = [
    ("toxicity", detoxify),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate_stage),
    ("mixing", mix),
    ("token_output", tokens),
]

# The stages hash, score and tokenise in ways SQL does not have; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
