"""Keyed joins: bands, upserts, patches, lookups, set similarity, masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftlab.functions import fixed as K
from siftlab.functions.ids import normalize_citation
from siftlab.functions.text import let
from siftlab.session import BROADCAST_LIMIT_BYTES, materialize, plan_size_bytes


def band_table(spark: SparkSession) -> DataFrame:
    """Grade bands as ranges of ``signed`` value: task, product, sign, lo, hi, grade, rank.

    Lower-is-better tasks are mirrored, so every band reads lo <= signed < hi. The table has a
    fixed size of five rows per task and product.
    """
    rows = []

    def add(task, product, sign, bounds):
        edges = [float("inf"), *[sign * b for b in bounds], float("-inf")]
        for i, grade in enumerate(K.GRADES):
            rows.append((task, product, sign, edges[i + 1], edges[i], grade, 4 - i))

    for task, bounds in K.LOWER_IS_BETTER.items():
        add(task, "", -1, bounds)
    for task, bounds in K.HIGHER_IS_BETTER.items():
        add(task, "", 1, bounds)
    for product, bounds in K.PRODUCT_EFFICIENCY.items():
        add("CO2RR", product, 1, bounds)
    add("CO2RR_current", "", 1, K.PARTIAL_CURRENT)
    columns = "task string, product string, sign int, lo double, hi double, grade string, rank int"
    return spark.createDataFrame(rows, columns)


def grade_values(df: DataFrame, task: str, value: str, product: str | None = None) -> DataFrame:
    """Adds grade and grade_rank. Product efficiencies use the product's table (CO by default)."""
    known = F.col(product).isin(*K.PRODUCT_EFFICIENCY) if product else F.lit(False)
    label = F.when(F.col(task) != "CO2RR", "").when(known, F.col(product) if product else F.lit("")).otherwise("CO")
    v = F.col(value)
    scaled = F.when((F.col(task) == "CO2RR") & v.between(0.0, 1.0), v * 100).when(
        F.col(task) == "CO2RR_current", F.abs(v)
    ).otherwise(v)
    left = df.withColumn("_p", label).withColumn("_v", scaled)
    bands = F.broadcast(band_table(df.sparkSession))
    signed = F.col("_v") * F.col("sign")
    top = (F.col("hi") == float("inf")) & (signed == float("inf"))
    bands = bands.withColumnRenamed("product", "_bp").withColumnRenamed("task", "_bt")
    hit = (F.col(task) == F.col("_bt")) & (F.col("_p") == F.col("_bp")) & (signed >= F.col("lo")) & (
        (signed < F.col("hi")) | top
    )
    out = left.join(bands, hit, "left")
    return out.select(
        *df.columns,
        F.coalesce("grade", F.when(F.col("_v").isNotNull(), F.lit(K.GRADES[-1]))).alias("grade"),
        F.coalesce("rank", F.when(F.col("_v").isNotNull(), F.lit(0))).alias("grade_rank"),
    )


def upsert(current: DataFrame, curated: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Curated values replace the named columns of existing keys; new keys are added.

    A column absent or null in the curated row keeps its old value. ``_change`` tells what
    happened; new keys sort after the old ones, numeric ids first.
    """
    fresh = curated.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_c"))
    old = current.withColumn("_o", F.lit(True))
    joined = old.join(fresh, key, "full_outer")
    kept = [
        F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in current.columns if c != key
    ]
    change = F.when(F.col("_o") & F.col("_c"), "updated").when(F.col("_c"), "created").otherwise("kept")
    return joined.select(key, *kept, change.alias("_change"))


def positional_patch(rows: DataFrame, patch: DataFrame, file: str, index: str, columns: dict[str, Column]) -> DataFrame:
    """Apply values to (file, row index); positions without a row and blank values are skipped.

    ``columns`` maps a column to the default used when the patch leaves it blank.
    """
    names = list(columns)
    first = names[0]
    valid = patch.where(F.trim(F.coalesce(first, F.lit(""))) != "")
    # Later lines of the patch win.
    last = valid.groupBy(file, index).agg(F.max_by(F.struct(*names), "line").alias("_p"))
    joined = rows.join(last, [file, index], "left")
    hit = F.col("_p").isNotNull()
    out = joined
    for name, default in columns.items():
        value = F.coalesce(F.nullif(F.trim(F.col(f"_p.{name}")), F.lit("")), default)
        out = out.withColumn(name, F.when(hit, value).otherwise(F.col(name)))
    return out.withColumn("_patched", hit).drop("_p")


def selective_lookup(table: DataFrame, wanted: DataFrame, key: str, value: str) -> DataFrame:
    """The wanted keys with their value, null where the table has none.

    The scan is filtered by the wanted keys: broadcast when they are few, else by a shuffle that
    Spark prepares with a runtime bloom filter.
    """
    ids = wanted.select(key).distinct()
    hits = table.select(key, value).join(ids, key, "left_semi").where(F.trim(F.col(value)) != "")
    first = hits.groupBy(key).agg(F.min(value).alias(value))
    return ids.join(first, key, "left")


def resolve_doc_id(df: DataFrame, mapping: DataFrame, keys: list[str], own: list[str], strict: bool = False) -> DataFrame:
    """doc_id from the mapping, else from the row's own columns; ``strict`` fails on rows with none."""
    found = df.join(mapping.select(*keys, F.col("doc_id").alias("_mapped")), keys, "left")
    parts = [F.nullif(F.trim("_mapped"), F.lit(""))] + [F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in own]
    doc = F.coalesce(*parts)
    if strict:
        shown = F.concat_ws("/", *[F.col(k).cast("string") for k in keys])
        doc = F.coalesce(doc, F.raise_error(F.concat(F.lit("missing document id for "), shown)).cast("string"))
    return found.withColumn("doc_id", doc).drop("_mapped")


def title_lookup(titles: DataFrame, index: DataFrame, id_col: str) -> DataFrame:
    """Document id of the first title variant found in the index.

    ``titles`` has id, scope, variant keys in order (array ``keys``); ``index`` scope, key, doi.
    """
    variants = titles.select(id_col, "scope", F.posexplode("keys").alias("rank", "key")).where("key <> ''")
    lookup = index.groupBy("scope", "key").agg(F.min("doi").alias("doi"))
    hits = variants.join(lookup, ["scope", "key"])
    best = hits.groupBy(id_col).agg(F.min_by("doi", "rank").alias("doi"))
    return titles.select(id_col).join(best, id_col, "left")


def mask_own_document(hits: DataFrame, masks: DataFrame, query: str, doc: str) -> DataFrame:
    """Hits without those whose document is masked for their query."""
    masked = masks.select(F.col(query), F.lower(F.trim(doc)).alias("_m")).distinct()
    keyed = hits.withColumn("_m", F.lower(F.trim(doc)))
    return keyed.join(masked, [query, "_m"], "left_anti").drop("_m")


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in the target yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def verify_citations(claims: DataFrame, retrieved: DataFrame, by: str) -> DataFrame:
    """Cited ids per claim: how many, how many valid and retrieved, and whether the claim stands.

    ``claims`` has the ``by`` key and an array ``cited``; ``retrieved`` the key and source_id.
    A claim that cites nothing stands; ``llm`` ids always count.
    """
    cited = claims.select(by, F.explode("cited").alias("raw")).withColumn("source_id", normalize_citation("raw"))
    got = retrieved.select(by, normalize_citation("source_id").alias("source_id")).distinct().withColumn("_got", F.lit(True))
    checked = cited.join(got, [by, "source_id"], "left").withColumn(
        "ok",
        F.lower(F.trim("raw")).startswith("llm")
        | (F.col("source_id").rlike(K.CITATION) & F.coalesce("_got", F.lit(False))),
    )
    counts = checked.groupBy(by).agg(F.count(F.lit(1)).alias("n_cited"), F.count_if("ok").alias("n_valid"))
    out = claims.select(by).join(counts, by, "left").fillna(0, ["n_cited", "n_valid"])
    return out.withColumn("valid", (F.col("n_cited") == 0) | (F.col("n_valid") > 0)).withColumn(
        "valid_share", F.coalesce(F.try_divide("n_valid", "n_cited"), F.lit(0.0))
    )


def chunk_lookup(chunks: DataFrame, wanted: DataFrame, collection: str) -> DataFrame:
    """Chunks behind citations: by document and index, same collection, matching task if asked.

    ``wanted`` has citation and, optionally, task_type.
    """
    from siftlab.functions.ids import canonical_doi, parse_citation

    refs = wanted.withColumn("_r", parse_citation("citation")).where(F.col("_r.collection") == collection)
    keyed = refs.select(
        *wanted.columns,
        canonical_doi(F.col("_r.doc_id"), "source").alias("doc_id"),
        F.col("_r.chunk").alias("chunk_index"),
    )
    found = keyed.join(chunks.withColumnRenamed("task_type", "chunk_task"), ["doc_id", "chunk_index"])
    if "task_type" in wanted.columns:
        found = found.where(F.col("task_type").isNull() | (F.col("task_type") == F.col("chunk_task")))
    return found


def component_set(c) -> Column:
    """Sorted distinct lower-case components without blanks."""
    col = F.col(c) if isinstance(c, str) else c
    cleaned = F.filter(F.transform(col, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.array_sort(F.array_distinct(cleaned))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; two empty sets are equal."""
    return let(
        lambda x, y: F.when(F.size(F.array_union(x, y)) == 0, F.lit(1.0)).otherwise(
            F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
        ),
        a,
        b,
    )


def similar_sets(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of distinct component sets with Jaccard similarity of at least ``threshold``.

    Both inputs hold a column ``components``. Sets are reduced to distinct values first. A pair
    above the threshold shares one of the rarest ``n - ceil(t * n) + 1`` elements of each set, so
    only these are joined, and sizes outside [t * n, n / t] never meet. Exact: no pair is lost.
    Returns left_set, right_set (comma-joined) and similarity; join back on them.
    """
    def distinct(df: DataFrame) -> DataFrame:
        return df.select(component_set("components").alias("s")).where(F.size("s") > 0).distinct()

    a, b = materialize(distinct(left), "sets"), materialize(distinct(right), "sets")
    frequency = (
        a.unionByName(b).select(F.explode("s").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("df"))
    )

    def prefixes(df: DataFrame, name: str) -> DataFrame:
        ordered = (
            df.select("s", F.explode("s").alias("e"))
            .join(frequency, "e")
            .groupBy("s")
            .agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("o"))
        )
        n = F.size("o")
        keep = n - F.ceil(F.lit(threshold) * n - F.lit(1e-9)) + 1
        return ordered.select(
            F.col("s").alias(name), n.alias(f"n_{name}"), F.explode(F.slice("o", F.lit(1), keep.cast("int"))).alias("p")
        ).select(name, f"n_{name}", F.col("p.e").alias("e"))

    meet = prefixes(a, "l").join(prefixes(b, "r"), "e").where(
        (F.col("n_l") >= F.lit(threshold) * F.col("n_r") - 1e-9) & (F.col("n_r") >= F.lit(threshold) * F.col("n_l") - 1e-9)
    )
    pairs = meet.select("l", "r").distinct()
    scored = pairs.withColumn("similarity", jaccard(F.col("l"), F.col("r"))).where(F.col("similarity") >= threshold - 1e-12)
    return scored.select(
        F.array_join("l", ",").alias("left_set"), F.array_join("r", ",").alias("right_set"), "similarity"
    )


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast hint only when the optimizer's size estimate is below the limit."""
    return F.broadcast(df) if plan_size_bytes(df) <= limit else df
