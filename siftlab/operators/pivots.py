"""Exact vector search that skips blocks which cannot reach the running k-th score.

Vectors belong to their nearest pivot and, inside its cell, to a ring of similar angles to it. The
angle between two vectors is a metric, so the angle between a query and anything in a ring is at
least the gap between the query's angle to the pivot and the angles of the ring. A block whose best
possible cosine is below a query's k-th score so far is never read for that query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F, types as T

from siftlab.operators.joins import broadcast_if_small
from siftlab.operators.ordinals import top_per_group
from siftlab.operators.retrieval import _unit_search, unit_rows
from siftlab.session import materialize

# Pivots grow with the square root of the table up to this number and these bytes.
MAX_PIVOTS = 1024
MAX_PIVOT_BYTES = 8 * 1024 * 1024
RINGS = 64

# Rows of a bin, which one task scores at a time: whole blocks, or a part of a larger one, split by a hash of the id.
PART_ROWS = 20_000
# Bins of a small table, and the rows one has at least even so.
BINS, BIN_ROWS = 64, 256
# Rows of one batch of chosen bins, each with its query.
CHOSEN_ROWS = 4096
# Queries of a block scored by one task.
SLICE_QUERIES = 4096
# Rows a query reads before its first and second k-th score are taken.
FIRST_ROWS, SECOND_ROWS = 256, 4096
# Rounding of arc cosines near one; bounds are widened by it.
ANGLE_SLACK = 1e-6

_HASHES = 1 << 16
_OTHER = -1


@dataclass(frozen=True)
class PivotIndex:
    """``rows`` is the written table of vectors by block, ``blocks`` its summary of at most
    ``MAX_PIVOTS * RINGS + 1`` rows, ``pivots`` the unit pivots."""

    rows: DataFrame
    blocks: DataFrame
    pivots: list[list[float]]


def _bins(blocks: list[tuple]) -> list[tuple[int, int]]:
    """First bin and number of bins of each block (pivot, ring, low, high, n), in order."""
    room = min(PART_ROWS, max(BIN_ROWS, -(-sum(b[4] for b in blocks) // BINS)))
    out, at, filled = [], 0, 0
    for n in (b[4] for b in blocks):
        if filled and filled + n > room:
            at, filled = at + 1, 0
        parts = -(-n // room)
        out.append((at, parts))
        at, filled = (at + parts, 0) if parts > 1 else (at, filled + n)
    return out


def _usable(vector) -> bool:
    import numpy as np

    size = np.linalg.norm(vector)
    return bool(np.isfinite(size) and size > 0)


def _choose_pivots(vectors: DataFrame, limit: int | None) -> list[list[float]]:
    """Unit vectors of the most frequent length, by the order of a hash of the id."""
    import numpy as np

    sizes = vectors.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    top = sizes.where("d > 0").orderBy(F.desc("n"), "d").first()
    if top is None:
        return []
    wanted = min(limit or math.isqrt(top.n) + 1, MAX_PIVOTS, max(1, MAX_PIVOT_BYTES // (8 * top.d)))
    drawn = vectors.where(F.size("embedding") == top.d).orderBy(F.xxhash64(F.lit("pivot"), "id"), "id")
    found = [np.array(r.embedding, dtype=float) for r in drawn.select("embedding").limit(wanted).collect()]
    return [(v / np.linalg.norm(v)).tolist() for v in found if _usable(v)]


def build_index(vectors: DataFrame, pivots: int | None = None) -> PivotIndex:
    """Index of ``vectors`` (id, embedding, doc_id, task_type) by pivot and ring.

    Null embeddings are left out. Zero and non-finite vectors and those of another length than the
    pivots' form one block that every query of their length reads. One pass of Arrow batches, no
    shuffle; a block may hold any share of the rows.
    """
    v = vectors.select(
        F.col("id").cast("string").alias("id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.lower("doc_id").alias("doc_id"),
        F.col("task_type").cast("string").alias("task_type"),
    ).where(F.col("embedding").isNotNull())
    chosen = _choose_pivots(v, pivots)
    dim = len(chosen[0]) if chosen else 0
    schema = T.StructType([*v.schema.fields]).add("pivot", "integer").add("ring", "integer").add("angle", "double")

    def assign(batches):
        import numpy as np

        centres = np.array(chosen)
        for pdf in batches:
            pivot, angle = np.full(len(pdf), _OTHER), np.zeros(len(pdf))
            fits = np.flatnonzero(pdf["embedding"].map(len).to_numpy() == dim) if dim else np.array([], dtype=int)
            if len(fits):
                matrix = np.stack(pdf["embedding"].to_numpy()[fits]).astype(float)
                norms = np.linalg.norm(matrix, axis=1)
                good = np.isfinite(norms) & (norms > 0)
                fits, unit = fits[good], matrix[good] / norms[good][:, None]
                cosines = unit @ centres.T
                best = cosines.argmax(axis=1)
                pivot[fits] = best
                angle[fits] = np.arccos(np.clip(cosines[np.arange(len(fits)), best], -1, 1))
            ring = np.minimum(angle * RINGS / np.pi, RINGS - 1).astype(int)
            yield pdf.assign(pivot=pivot, ring=ring, angle=angle)

    rows = materialize(v.mapInPandas(assign, schema), "pivots")
    blocks = rows.groupBy("pivot", "ring").agg(
        F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n")
    )
    return PivotIndex(rows, materialize(blocks, "blocks"), chosen)


def _choose_blocks(
    index: PivotIndex, table: list[tuple], bins: list[tuple[int, int]], queries: DataFrame, start: int, stop: int | None
) -> DataFrame:
    """The bins each query reads in one round: a row with the query, the blocks it asks for there and their rows.

    All blocks of a query are in one fixed order (best bound first); a round takes those that begin
    at ``start`` to ``stop`` rows of that order and whose bound reaches ``floor``. A query travels
    once to each bin, however many blocks it asks for there.
    """
    pivots = index.pivots
    fields = T.StructType([*queries.schema.fields]).add("bin", "integer").add("blocks", T.ArrayType(T.IntegerType())).add("n", "long")

    def choose(batches):
        import numpy as np
        import pandas as pd

        number, ring, low, high, n = (np.array(c) for c in zip(*table)) if table else (np.zeros(0, int),) * 5
        first, parts = np.array(bins, dtype=np.int64).reshape(-1, 2).T
        centres = np.array(pivots)
        inner = np.flatnonzero(number != _OTHER)
        other = np.flatnonzero(number == _OTHER)
        out = []
        for pdf in batches:
            for q in pdf.itertuples(index=False):
                v = np.asarray(q.embedding, dtype=float)
                if not _usable(v):
                    continue
                order, bound = other, np.ones(len(other))
                if len(inner) and len(v) == centres.shape[1]:
                    to_pivot = np.arccos(np.clip(centres @ (v / np.linalg.norm(v)), -1, 1))[number[inner]]
                    gap = np.maximum(0, np.maximum(to_pivot - high[inner], low[inner] - to_pivot) - ANGLE_SLACK)
                    best = np.cos(np.minimum(gap, np.pi))
                    by = np.lexsort((inner, to_pivot, -best))
                    order = np.concatenate([other, inner[by]])
                    bound = np.concatenate([bound, best[by]])
                before = np.cumsum(n[order]) - n[order] if len(order) else np.array([])
                take = (before >= start) & (bound >= q.floor)
                if stop is not None:
                    take &= before < stop
                chosen = np.sort(order[take])
                for block in chosen[parts[chosen] > 1]:
                    at = int(first[block])
                    out.extend((*q, at + k, [block], n[block] if k == 0 else 0) for k in range(parts[block]))
                chosen = chosen[parts[chosen] == 1]
                for whole in np.split(chosen, np.flatnonzero(np.diff(first[chosen])) + 1):
                    if len(whole):
                        out.append((*q, first[whole[0]], whole.astype(np.int32), n[whole].sum()))
                for k in range(0, len(out) - CHOSEN_ROWS + 1, CHOSEN_ROWS):
                    yield pd.DataFrame(out[k : k + CHOSEN_ROWS], columns=fields.names)
                out = out[len(out) // CHOSEN_ROWS * CHOSEN_ROWS :]
        if out:
            yield pd.DataFrame(out, columns=fields.names)

    return queries.mapInPandas(choose, fields)


def _score(index: PivotIndex, places: DataFrame, chosen: DataFrame, k: int, max_distance: float | None, slices: int) -> DataFrame:
    """Cosines of the chosen blocks: at most ``k`` hits per query and run of blocks in a bin."""
    search = _unit_search(k, max_distance)
    asked = chosen.withColumn("slice", F.pmod(F.xxhash64("qid"), F.lit(slices)))
    part = F.floor(F.pmod(F.xxhash64("id"), F.lit(_HASHES)) * F.col("parts") / _HASHES).cast("int")
    rows = index.rows.join(F.broadcast(places), ["pivot", "ring"]).withColumn("bin", F.col("first") + part)
    rows = rows.select("id", "embedding", "doc_id", "task_type", "bin", "block")
    # Blocks nobody asked for end here, before the shuffle.
    wanted = asked.select("bin", F.col("slice").alias("asked_slice"), F.explode("blocks").alias("block")).distinct()
    rows = rows.join(broadcast_if_small(wanted), ["bin", "block"])
    schema = T.StructType().add("qid", "string").add("id", "string").add("score", "double")

    def cell(vs, qs):
        import numpy as np
        import pandas as pd

        found = []
        if len(vs) and len(qs):
            for _, part in vs.groupby(vs["embedding"].map(len), sort=False):
                part = part.sort_values("block", kind="stable")
                blocks = part["block"].to_numpy()
                unit = unit_rows(np.stack(part["embedding"].to_numpy()).astype(float))
                ids, docs, tasks = (part[c].to_numpy() for c in ("id", "doc_id", "task_type"))
                for r in qs.itertuples():
                    mine = np.sort(r.blocks)
                    lo, hi = np.searchsorted(blocks, mine, "left"), np.searchsorted(blocks, mine, "right")
                    # Runs of rows that follow each other are one view.
                    new = np.flatnonzero(np.concatenate([[True], lo[1:] != hi[:-1]]))
                    for a, b in zip(lo[new], hi[np.concatenate([new[1:], [len(mine)]]) - 1]):
                        if a < b:
                            one = [(r.qid, r.embedding, r.tasks, r.masked_doc)]
                            found.extend(search(ids[a:b], unit[a:b], docs[a:b], tasks[a:b], one))
        return pd.DataFrame(found, columns=schema.names)

    hits = rows.groupBy("bin", "asked_slice").cogroup(asked.groupBy("bin", "slice")).applyInPandas(cell, schema)
    return hits.withColumn("score", F.round("score", 9))


def pivot_top_k(
    index: PivotIndex, queries: DataFrame, k: int, max_distance: float | None = None
) -> tuple[DataFrame, DataFrame]:
    """Exact cosine top ``k`` per query, and the rows each query was scored against.

    Same queries, filters, order and ties as ``retrieval.vector_top_k``. A query reads its most
    promising blocks first; its k-th score then rules out blocks by their bound, twice. Filters
    count: a query with fewer than ``k`` hits so far rules out nothing but what ``max_distance``
    does. The second frame has qid, scored and total. Vectors without structure (random directions
    in many dimensions) have no blocks to rule out and are all scored.
    """
    base = F.lit(-2.0 if max_distance is None else 1.0 - max_distance - 1e-9)
    q = materialize(
        queries.select(
            F.col("qid").cast("string").alias("qid"),
            F.col("embedding").cast("array<double>").alias("embedding"),
            F.col("tasks").cast("array<string>").alias("tasks"),
            F.lower("masked_doc").alias("masked_doc"),
        ).where(F.col("qid").isNotNull() & F.col("embedding").isNotNull()),
        "queries",
    )
    slices = max(1, -(-q.count() // SLICE_QUERIES))
    table = [tuple(r) for r in index.blocks.orderBy("pivot", "ring").collect()]
    bins = _bins(table)
    places = q.sparkSession.createDataFrame(
        [(b[0], b[1], i, *bins[i]) for i, b in enumerate(table)], "pivot int, ring int, block int, first int, parts int"
    )
    # A run of blocks gives at most k hits per query, so the best of all rounds are complete.
    best, read, floors = None, None, q.select("qid", base.alias("floor"))
    for start, stop in ((0, FIRST_ROWS), (FIRST_ROWS, SECOND_ROWS), (SECOND_ROWS, None)):
        chosen = materialize(_choose_blocks(index, table, bins, q.join(floors, "qid"), start, stop), "chosen")
        hits = _score(index, places, chosen, k, max_distance, slices)
        hits = hits if best is None else best.unionByName(hits)
        best = materialize(top_per_group(hits, "qid", [F.desc("score"), F.col("id")], k).drop("rank"), "best")
        work = chosen.select("qid", "n")
        read = work if read is None else read.unionByName(work)
        kth = best.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score") - 1e-8).alias("kth"))
        floors = q.join(kth, "qid", "left").select("qid", F.greatest(base, F.coalesce("kth", base)).alias("floor"))
    total = index.blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    scored = read.groupBy("qid").agg(F.sum("n").alias("scored"))
    report = q.select("qid").join(scored, "qid", "left").select("qid", F.coalesce("scored", F.lit(0)).alias("scored"))
    return top_per_group(best, "qid", [F.desc("score"), F.col("id")], k), report.withColumn("total", F.lit(total.first().total).cast("long"))
