"""CSV and TSV tables, wide sheets, key-value metadata, document folders, dataset loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftlab.functions import fixed as K
from siftlab.functions.documents import document_doi
from siftlab.functions.ids import canonical_doi, fallback_doc_id
from siftlab.functions.tasks import index_task
from siftlab.functions.text import strip, text_or_empty
from siftlab.operators.ordinals import with_group_ordinal


def _header_key(name: str) -> str:
    return " ".join((name or "").split()).lower()


def resolve_headers(
    headers: list[str], aliases: dict[str, list[str]] | None = None, required: tuple = (), exact: tuple = K.EXACT_HEADERS
) -> dict[str, str]:
    """Canonical name -> header. Equal spellings first, then a spelling contained in a header.

    Names in ``exact`` take no partial match. A missing required name fails with the header list.
    """
    aliases = aliases or K.HEADER_ALIASES
    by_key = {_header_key(h): h for h in headers if h}
    found = {}
    for name, spellings in aliases.items():
        keys = [_header_key(s) for s in spellings]
        hit = next((by_key[k] for k in keys if k in by_key), None)
        if hit is None and name not in exact:
            hit = next((header for k in keys if k for key, header in by_key.items() if k in key), None)
        if hit is not None:
            found[name] = hit
    if "partial" in _header_key(found.get("condition", "")):
        del found["condition"]
    missing = [name for name in required if name not in found]
    if missing:
        raise ValueError(f"missing required columns {missing}; headers: {headers}")
    return found


def canonical_columns(df: DataFrame, required: tuple = (), aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """The known columns under their canonical names, in the order of the alias table."""
    found = resolve_headers(df.columns, aliases, required)
    return df.select(*[F.col(f"`{header}`").alias(name) for name, header in found.items()])


def read_feedback_csv(spark: SparkSession, path: str, encoding: str = "UTF-8", sep: str = ",") -> DataFrame:
    """Feedback table with English or Chinese headers."""
    raw = spark.read.option("header", True).option("encoding", encoding).option("sep", sep).option("multiLine", True).csv(path)
    return canonical_columns(raw, required=("reaction_type",))


def read_id_table(spark: SparkSession, path: str, key: str = "index", value: str = "doi") -> DataFrame:
    """Two columns of a large TSV; the others are not parsed."""
    return spark.read.option("header", True).option("sep", "\t").csv(path).select(key, value)


def reaction_of_header(name: str) -> str | None:
    upper = (name or "").upper()
    return next((r for r in ("OER", "HER", "UOR") if r in upper), None)


def cell_minimum(cell, unit: str) -> Column:
    """Smallest of the values in a cell, in ``mV`` or ``V``; a missing unit is the first one stated."""
    mv = unit.lower() == "mv"
    number = r"([+-]?(?:\d+(?:\.\d*)?|\.\d+))([A-Za-z]+)?"
    parts = F.transform(F.split(F.translate(text_or_empty(cell), "，;；、", ",,,,"), ","), strip)
    kept = F.filter(parts, lambda p: ~p.isin("", "无", "-", "nan", "NaN", "N/A", "NA") & p.rlike(number))
    parsed = F.transform(
        kept,
        lambda p: F.struct(
            F.regexp_extract(p, number, 1).try_cast("double").alias("v"),
            F.lower(F.regexp_extract(p, number, 2)).alias("u"),
        ),
    )
    stated = F.filter(parsed, lambda x: x["u"].isin("mv", "v"))
    default = F.coalesce(F.try_element_at(stated, F.lit(1))["u"], F.lit(unit.lower()))
    factor = lambda u: F.when(u == "v", 1000.0 if mv else 1.0).otherwise(1.0 if mv else 0.001)
    values = F.transform(
        parsed, lambda x: x["v"] * factor(F.when(x["u"].isin("mv", "v"), x["u"]).otherwise(default))
    )
    return F.array_min(values)


def wide_to_long(sheet: DataFrame, id_col: str, metals_col: str, units: dict[str, str] | None = None) -> DataFrame:
    """One row per (experiment, reaction) from a sheet whose headers name the reaction."""
    units = units or {"OER": "mV", "HER": "mV", "UOR": "V"}
    columns = {c: reaction_of_header(c) for c in sheet.columns if c not in (id_col, metals_col)}
    entries = [
        F.struct(
            F.lit(r).alias("reaction_type"), cell_minimum(F.col(f"`{c}`"), units[r]).alias("value"), F.lit(units[r]).alias("unit")
        )
        for c, r in columns.items()
        if r
    ]
    rows = sheet.where((strip(text_or_empty(F.col(id_col))) != "") & (strip(text_or_empty(F.col(metals_col))) != ""))
    long = rows.select(F.col(id_col).cast("string").alias("exp_id"), F.col(metals_col).alias("metals"), F.explode(F.array(*entries)).alias("e"))
    return long.where(F.col("e.value").isNotNull()).select(
        F.concat_ws("_", "exp_id", "e.reaction_type").alias("id"), "e.reaction_type", "metals", "e.value", "e.unit"
    )


def metadata_pairs(eav: DataFrame) -> DataFrame:
    """(task, doi) pairs of the index from rows (id, key, string_value)."""
    of = lambda key: F.max(F.when(F.col("key") == key, F.col("string_value")))
    wanted = eav.where(F.col("key").isin("reaction_type", "doc_id"))
    wide = wanted.groupBy("id").agg(of("reaction_type").alias("task"), of("doc_id").alias("doc"))
    pairs = wide.select(index_task("task").alias("task_type"), canonical_doi("doc").alias("doi"))
    return pairs.where(F.col("task_type").isNotNull() & (F.col("doi") != "")).distinct()


def read_documents(spark: SparkSession, folder: str, reaction_type: str | None = None) -> DataFrame:
    """One row per ``*.md`` file of a folder (not its subfolders)."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", False).text(f"{folder.rstrip('/')}/*.md")
    return identify_documents(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")), reaction_type)


def identify_documents(files: DataFrame, reaction_type: str | None = None) -> DataFrame:
    """reaction_type by argument, file stem or path segment; doc_id from the text or the path."""
    stem = F.upper(F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", ""))
    named = F.coalesce(*[F.when(stem.contains(r), F.lit(r)) for r in sorted(K.REACTION_TASKS)])
    segment = F.upper(F.regexp_extract("path", rf"(?i)/({'|'.join(K.REACTION_TASKS)})/", 1))
    reaction = F.lit(reaction_type) if reaction_type else F.coalesce(named, F.nullif(segment, F.lit("")), F.lit("unknown"))
    return files.select(
        "path",
        reaction.alias("reaction_type"),
        F.coalesce(document_doi("text"), fallback_doc_id("path")).alias("doc_id"),
        "text",
    )


def dataset_rows(rows: DataFrame, dataset: str | Column, order_by, layout: str = "default") -> DataFrame:
    """Rows of the dataset table with a running index per dataset.

    ``layout="instruction"`` builds the question from instruction and input and the answer from
    output.
    """
    name = F.lit(dataset) if isinstance(dataset, str) else dataset
    shaped = rows.withColumn("dataset", name)
    if layout == "instruction":
        parts = [F.when(strip(F.col(c)) != "", F.col(c)) for c in ("instruction", "input")]
        shaped = shaped.withColumn("question", F.concat_ws("\n\n", *parts)).withColumn("answer", text_or_empty(F.col("output")))
        shaped = shaped.drop("instruction", "input", "output")
    return with_group_ordinal(shaped, "dataset", order_by, "index")


def write_dataset(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("dataset").parquet(path)
