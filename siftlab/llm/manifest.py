"""Merkle manifest of a document table that keeps only every few levels.

Per language the documents, in order of their id, are the leaves of a tree in which every run of
``FAN_OUT`` nodes becomes the digest of their digests; the roots of these trees, in order of the
language, are the leaves of one more tree, whose root stands for the table. Levels 0, 3, 6, ... and
the roots are written. A proof needs the siblings on all levels: the missing ones are computed
again inside each aligned subtree of ``FAN_OUT ** KEPT_EVERY`` stored nodes, which is one row of
a Spark job, handed out to the nodes below and forgotten. No step holds more than one subtree.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from siftlab.functions.text import as_col
from siftlab.operators.joins import broadcast_if_small
from siftlab.operators.ordinals import with_ordinal
from siftlab.session import materialize, scratch_path

FAN_OUT = 8
KEPT_EVERY = 3
SPAN = FAN_OUT**KEPT_EVERY
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left: string, right: string>>"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def framed(c) -> Column:
    """A value with its byte length in front, so that neighbouring values cannot run together; null is ``-``."""
    text = as_col(c).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def tree_key(c) -> Column:
    """The group as a text that is never null and sorts null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), as_col(c).cast("string")), F.lit(""))


def _height(n: Column) -> Column:
    """Levels folded above a stored one with ``n`` nodes in its tree, KEPT_EVERY at most."""
    return sum((n > FAN_OUT**k).cast("int") for k in range(KEPT_EVERY))


def _subtrees(level: DataFrame, *carried: str) -> DataFrame:
    """One row per aligned subtree above a stored level, with its nodes in order."""
    nodes = F.array_sort(F.collect_list(F.struct("idx", "digest", *carried)))
    rows = level.where("n > 1").groupBy("tree", "n", F.floor(F.col("idx") / SPAN).alias("idx")).agg(nodes.alias("nodes"))
    return rows.withColumn("height", _height(F.col("n")))


def _inner_levels(digests: list[str], height: int) -> list[list[str]]:
    """A stored level and those above it inside one subtree."""
    levels = [digests]
    for _ in range(height):
        low = levels[-1]
        levels.append([sha256("".join(low[i : i + FAN_OUT]).encode()).hexdigest() for i in range(0, len(low), FAN_OUT)])
    return levels


def _subtree_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_inner_levels(d, h)[-1][0] for d, h in zip(batch.column("digests").to_pylist(), batch.column("height").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("tree"), batch.column("idx"), batch.column("n"), pa.array(found, pa.string())], ["tree", "idx", "n", "digest"])


def _subtree_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per subtree what stands left and right of each of its nodes, level by level."""
    for batch in batches:
        for row, (digests, height) in enumerate(zip(batch.column("digests").to_pylist(), batch.column("height").to_pylist(), strict=True)):
            levels = _inner_levels(digests, height)
            steps = []
            for at in range(len(digests)):
                beside = []
                for k in range(height):
                    place = at // FAN_OUT**k
                    begin = place - place % FAN_OUT
                    beside.append({"left": "".join(levels[k][begin:place]), "right": "".join(levels[k][place + 1 : begin + FAN_OUT])})
                steps.append(beside)
            own = batch.slice(row, 1)
            kept = [own.column(c) for c in ("tree", "idx", "nodes")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([steps], pa.list_(pa.list_(_STEP)))], ["tree", "idx", "nodes", "steps"])


@dataclass(frozen=True)
class Manifest:
    """The written levels of the language trees (``levels``) and of the tree above them (``top``), and the root."""

    path: str
    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _keep_levels(leaves: DataFrame, path: str) -> list[DataFrame]:
    """Write the leaves and every third level above them; a tree ends with the level that has one node."""
    kept = [_written(leaves, f"{path}/level=0")]
    while (kept[-1].agg(F.max("n").alias("n")).first()["n"] or 0) > 1:
        rows = _subtrees(kept[-1]).select("tree", "idx", F.ceil(F.col("n") / SPAN).alias("n"), F.col("nodes.digest").alias("digests"), "height")
        above = rows.mapInArrow(_subtree_roots, "tree string, idx long, n long, digest string")
        kept.append(_written(above, f"{path}/level={len(kept) * KEPT_EVERY}"))
    return kept


def _roots(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [level.where("n = 1").select("tree", "digest") for level in levels])


def build_manifest(docs: DataFrame, path: str | None = None) -> Manifest:
    """Write the manifest of ``docs`` (doc_id, source, lang, n_chars, text) below ``path``.

    Every row is a leaf. Rows of one id are ordered by their digest, so equal rows change places
    without effect; null ids come first. Null values are part of the digest, other columns are
    not. An empty table has no root. Positions come from range partitions and one count per
    partition, so a language may hold any share of the rows. Each leaf also keeps the digest that
    its document has when its text loses its capitals, for :func:`verify_tampered`.
    """
    spark = docs.sparkSession
    path = path or scratch_path(spark, "manifest")
    values = [docs[c].cast("string").alias(c) for c in FIELDS]
    rows = docs.select(docs["doc_id"].cast("long").alias("id"), *values)
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    head = [framed(c) for c in FIELDS[:-1]]
    # Written before the range partitions are drawn: the texts are read and hashed once.
    leaves = materialize(
        rows.select(
            tree_key("lang").alias("tree"), F.col("id").alias("doc_id"), digest(*head, framed("text")).alias("digest"),
            digest(*head, framed(lowered)).alias("lowered"),
        ),
        "leaves",
    )
    placed = with_ordinal(leaves, [F.col("tree"), F.col("doc_id").asc_nulls_first(), F.col("digest")], "at")
    sizes = materialize(placed.groupBy("tree").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")), "trees")
    placed = placed.join(broadcast_if_small(sizes), "tree")
    levels = _keep_levels(placed.select("tree", (F.col("at") - F.col("first")).alias("idx"), "n", "digest", "doc_id", "lowered"), f"{path}/trees")
    roots = with_ordinal(_roots(levels), F.col("tree"), "idx")
    count = sizes.count()
    top = _keep_levels(roots.select(F.lit("").alias("tree"), "idx", F.lit(count).cast("long").alias("n"), "digest", F.col("tree").alias("of")), f"{path}/top")
    found = _roots(top).first()
    return Manifest(path, levels, top, found["digest"] if found else None)


def _paths(levels: list[DataFrame], above: DataFrame, *carried: str) -> DataFrame:
    """The siblings of every leaf on all levels up to the end of ``above`` (tree, path), nearest first.

    Goes down from the highest stored level. The nodes of a subtree are told the siblings inside
    it and the path of its root, which one join finds: a row on either side for each subtree.
    """
    found = None
    for k in reversed(range(len(levels))):
        names = carried if k == 0 else ()
        ends = levels[k].where("n = 1").join(above, "tree").select("tree", "idx", "digest", *names, "path")
        if found is not None:
            ends = ends.unionByName(_open(levels[k], found, names))
        found = ends if k == 0 else materialize(ends, "paths")
    return found


def _open(level: DataFrame, parents: DataFrame, names: tuple[str, ...]) -> DataFrame:
    rows = _subtrees(level, *names).select("tree", "idx", "nodes", F.col("nodes.digest").alias("digests"), "height")
    nodes = rows.schema["nodes"].dataType.simpleString()
    told = rows.mapInArrow(_subtree_steps, f"tree string, idx long, nodes {nodes}, steps array<{PATH}>")
    joined = told.join(parents.select("tree", "idx", "path"), ["tree", "idx"])
    each = joined.select("tree", F.explode(F.arrays_zip("nodes", "steps")).alias("t"), "path")
    return each.select("tree", "t.nodes.*", F.concat("t.steps", "path").alias("path")).select("tree", "idx", "digest", *names, "path")


def proofs(manifest: Manifest) -> DataFrame:
    """(tree, doc_id, digest, lowered, path) per leaf; a step of the path has what stands left and right of the node."""
    spark = manifest.levels[0].sparkSession
    nothing = spark.createDataFrame([("",)], "tree string").withColumn("path", F.array().cast(PATH))
    top = _paths(manifest.top, nothing, "of").select(F.col("of").alias("tree"), "path")
    return _paths(manifest.levels, materialize(top, "paths"), "doc_id", "lowered")


def fold(leaf, path) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, as_col(leaf), lambda node, s: digest(s["left"], node, s["right"]))


def siblings(path) -> Column:
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def tampered(doc_id) -> Column:
    """A fixed third of the ids, by their checksum; never a null id."""
    return F.coalesce(F.crc32(as_col(doc_id).cast("string").cast("binary")) % 3 == 0, F.lit(False))


def verify_tampered(manifest: Manifest) -> DataFrame:
    """Proof and outcome per document when a third of the documents lost their capitals after the manifest was written."""
    roots = _roots(manifest.levels).withColumnRenamed("digest", "subroot")
    rows = proofs(manifest).join(broadcast_if_small(materialize(roots, "roots")), "tree")
    root = F.lit(manifest.root).cast("string")
    now = F.when(tampered("doc_id"), F.col("lowered")).otherwise(F.col("digest"))
    rows = rows.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"),
        fold(now, F.col("path")).alias("folded_root"),
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def read_manifest(spark: SparkSession, path: str) -> Manifest:
    """A manifest written earlier."""
    def kept(folder: str, top: bool) -> list[DataFrame]:
        own = "of string" if top else "doc_id long, lowered string"
        base = "tree string, idx long, n long, digest string"
        found = spark.read.parquet(folder).select("level").distinct().orderBy("level").collect()
        return [spark.read.schema(base if r["level"] else f"{base}, {own}").parquet(f"{folder}/level={r['level']}") for r in found]

    levels, top = kept(f"{path}/trees", False), kept(f"{path}/top", True)
    found = _roots(top).first()
    return Manifest(path, levels, top, found["digest"] if found else None)
