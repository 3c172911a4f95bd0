"""Keyword, substring and vector search with filters, masks and reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from siftlab.functions import fixed as K
from siftlab.functions.text import keyword_tokens, let, squeeze, text_or_empty
from siftlab.operators.joins import broadcast_if_small
from siftlab.operators.ordinals import top_per_group
from siftlab.session import materialize, measured

# Estimated size of the vectors or queries of one cell of the block join.
CELL_BYTES = 16 * 1024 * 1024

# Query vectors up to this size are shipped to every task; more of them are searched as a grid.
MAX_QUERY_BYTES = 32 * 1024 * 1024
MAX_QUERIES = 4096


def token_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct keyword tokens per text, one row each; built and exploded inside the row."""
    tokens = F.array_distinct(keyword_tokens(F.col(text_col), K.STOPWORDS))
    return df.select(id_col, F.explode(tokens).alias("token"))


def idf_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Document frequency and ``1 + ln((N + 1) / (df + 1))`` per token; N counts all documents."""
    n = df.agg(F.count(F.lit(1))).scalar()
    counts = token_sets(df, id_col, text_col).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return counts.withColumn("idf", 1 + F.log((n + 1.0) / (F.col("df") + 1.0)))


def keyword_rank(
    docs: DataFrame, queries: DataFrame, doc_id: str, text_col: str, query_id: str, query_text: str, k: int
) -> DataFrame:
    """Top ``k`` documents per query by shared idf mass over the query's idf mass; ties by id.

    Tokens no query uses are dropped before anything is joined. Tokens no document has weigh 1.
    """
    # As a written table the query side has a true size, which decides about the broadcasts.
    asked = materialize(token_sets(queries, query_id, query_text), "queries")
    vocabulary = asked.select("token").distinct()
    have = token_sets(docs, doc_id, text_col).join(broadcast_if_small(vocabulary), "token", "left_semi")
    n = docs.agg(F.count(F.lit(1))).scalar()
    counts = have.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weighted = asked.join(counts, "token", "left").withColumn(
        "idf", F.when(F.col("df").isNull(), F.lit(1.0)).otherwise(1 + F.log((n + 1.0) / (F.col("df") + 1.0)))
    )
    weighted = materialize(weighted, "queries")
    mass = weighted.groupBy(query_id).agg(F.sum("idf").alias("_max"))
    shared = have.join(broadcast_if_small(weighted.select(query_id, "token", "idf")), "token")
    scores = shared.groupBy(query_id, doc_id).agg(F.sum("idf").alias("_score"))
    scored = scores.join(broadcast_if_small(mass), query_id).withColumn(
        "similarity", F.round(F.col("_score") / F.col("_max"), 9)
    )
    return top_per_group(scored, query_id, [F.desc("similarity"), F.col(doc_id)], k).drop("_score", "_max")


def snippet(text, tokens: list[str], chars: int = 400) -> Column:
    """Part of the text around the first token found, with dots where it was cut."""
    def cut(t: Column) -> Column:
        low = F.lower(t)
        at = F.coalesce(*[F.nullif(F.instr(low, F.lit(w)), F.lit(0)) for w in tokens])
        start = F.greatest(at - 1 - chars // 2, F.lit(0))
        end = F.least(start + chars, F.length(t))
        middle = F.concat(
            F.when(start > 0, "...").otherwise(""),
            F.substring(t, start + 1, end - start),
            F.when(end < F.length(t), "...").otherwise(""),
        )
        return (
            F.when(F.length(t) <= chars, t)
            .when(at.isNull(), F.concat(F.substring(t, 1, chars), F.lit("...")))
            .otherwise(middle)
        )

    return let(cut, squeeze(text_or_empty(text)))


def substring_search(
    docs: DataFrame, queries: list[str], doc_id: str, title: str, abstract: str, k: int, max_tokens: int | None = None
) -> DataFrame:
    """Per query the ``k`` documents with most token hits: 2 per title, 1 per abstract; ties by id.

    All matching documents are scored (no candidate cap). The queries are the few search strings
    of one request, so each becomes one score column of a single pass.
    """
    scored = []
    t, a = F.lower(text_or_empty(F.col(title))), F.lower(text_or_empty(F.col(abstract)))
    base = docs.withColumn("_t", t).withColumn("_a", a)
    for q in queries:
        tokens = q.lower().split()[:max_tokens]
        score = F.lit(0)
        for w in tokens:
            score = score + F.when(F.col("_t").contains(w), 2).otherwise(0) + F.when(F.col("_a").contains(w), 1).otherwise(0)
        scored.append(F.struct(F.lit(q).alias("query"), score.alias("score"), snippet(F.col(abstract), tokens).alias("snippet")))
    hits = base.select(doc_id, F.explode(F.array(*scored)).alias("h")).select(doc_id, "h.*").where("score > 0")
    return top_per_group(hits, "query", [F.desc("score"), F.col(doc_id)], k)


def unit_rows(matrix):
    """Rows scaled to length one; zero rows stay."""
    import numpy as np

    norms = np.linalg.norm(matrix, axis=1)
    return matrix / np.where(norms > 0, norms, 1.0)[:, None]


def _block_search(k: int, max_distance: float | None):
    """Closure over one block of queries: scores a block of vectors and keeps ``k`` per query."""
    search = _unit_search(k, max_distance)
    return lambda ids, matrix, docs, tasks, queries: search(ids, unit_rows(matrix), docs, tasks, queries)


def _unit_search(k: int, max_distance: float | None):
    """The same over rows of length one or zero."""

    def search(ids, unit, docs, tasks, queries):
        import numpy as np

        out = []
        for qid, vector, allowed, masked in queries:
            v = np.asarray(vector, dtype=float)
            size = np.linalg.norm(v)
            if not size or v.shape[0] != unit.shape[1]:
                continue  # a zero query, or one of another length, has no hits
            score = unit @ (v / size)
            keep = np.ones(len(ids), dtype=bool)
            if allowed is not None:
                keep &= np.isin(tasks, list(allowed))
            if masked:
                keep &= docs != masked
            if max_distance is not None:
                keep &= (1.0 - score) <= max_distance
            index = np.flatnonzero(keep)
            if len(index) > k:
                edge = np.partition(score[index], len(index) - k)[len(index) - k]
                index = index[score[index] >= edge - 1e-9]
                rounded = np.round(score[index], 9)  # as the final rank does, which breaks ties by id
                index = index[np.lexsort((ids[index].astype(str), -rounded))[:k]]
            out.extend((qid, ids[i], float(score[i])) for i in index)
        return out

    return search


def _by_length(search, pdf, asked) -> list:
    """Search a block whose vectors may differ in length; each length only meets queries of its own."""
    import numpy as np

    rows = []
    for _, part in pdf.groupby(pdf["embedding"].map(len), sort=False):
        matrix = np.stack(part["embedding"].to_numpy()).astype(float)
        rows.extend(search(part["id"].to_numpy(), matrix, part["doc_id"].to_numpy(), part["task_type"].to_numpy(), asked))
    return rows


def vector_top_k(
    vectors: DataFrame, queries: DataFrame, k: int, max_distance: float | None = None, grid: int | None = None
) -> DataFrame:
    """Exact cosine top ``k`` per query.

    ``vectors`` has id, embedding, doc_id, task_type; ``queries`` qid, embedding, tasks (array or
    null: only these tasks), masked_doc (or null: never return it). Filters apply before ranking.
    Few queries travel to the data and every task returns ``k`` rows per query. Many queries meet
    the vectors cell by cell in a block join instead, with as many blocks on either side as keep a
    cell small (``grid`` sets both); neither side passes through the driver or one task.
    """
    search = _block_search(k, max_distance)
    v = vectors.select(
        F.col("id").cast("string").alias("id"), "embedding", F.lower("doc_id").alias("doc_id"), "task_type"
    ).where(F.col("embedding").isNotNull())
    q = queries.select(
        F.col("qid").cast("string").alias("qid"),
        "embedding",
        F.col("tasks").cast("array<string>").alias("tasks"),
        F.lower("masked_doc").alias("masked_doc"),
    )
    schema = T.StructType().add("qid", "string").add("id", "string").add("score", "double")
    few = None
    q, q_bytes = measured(q, "queries", MAX_QUERY_BYTES)
    if grid is None and q_bytes <= MAX_QUERY_BYTES:
        few = q.limit(MAX_QUERIES + 1).collect()
    if few is not None and len(few) <= MAX_QUERIES:
        shipped = [(r.qid, list(r.embedding), r.tasks, r.masked_doc) for r in few]

        def scan(batches):
            import numpy as np
            import pandas as pd

            for pdf in batches:
                if len(pdf):
                    rows = _by_length(search, pdf, shipped)
                    yield pd.DataFrame(rows, columns=["qid", "id", "score"])

        hits = v.mapInPandas(scan, schema)
    else:
        v, v_bytes = measured(v, "vectors")
        n_v = grid or max(1, -(-v_bytes // CELL_BYTES))
        n_q = grid or max(1, -(-q_bytes // CELL_BYTES))
        block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("bigint")
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
        left = v.withColumn("_v", block("id", n_v)).withColumn("_q", every(n_q))
        right = q.withColumn("_q", block("qid", n_q)).withColumn("_v", every(n_v))

        def cell(vs, qs):
            import numpy as np
            import pandas as pd

            rows = []
            if len(vs) and len(qs):
                asked = [(r.qid, r.embedding, r.tasks, r.masked_doc) for r in qs.itertuples()]
                rows = _by_length(search, vs, asked)
            return pd.DataFrame(rows, columns=["qid", "id", "score"])

        hits = left.groupBy("_v", "_q").cogroup(right.groupBy("_v", "_q")).applyInPandas(cell, schema)
    ranked = hits.withColumn("score", F.round("score", 9))
    return top_per_group(ranked, "qid", [F.desc("score"), F.col("id")], k)


def rerank(hits: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    """Cut overfetched hits to ``k``: right task, required elements, fewer forbidden ones, score.

    ``hits`` has task_match, detected and required (element arrays) and score.
    """
    allowed = F.array(*[F.lit(e) for e in K.SUPPORT_ELEMENTS])
    matched = F.size(F.array_intersect("detected", "required"))
    forbidden = F.when(
        F.size("required") > 0, F.size(F.array_except("detected", F.array_union("required", allowed)))
    ).otherwise(0)
    scored = hits.withColumn("n_matched", matched).withColumn("n_forbidden", forbidden)
    order = [F.desc("task_match"), F.desc("n_matched"), F.col("n_forbidden"), F.desc("score"), F.col(tie)]
    return top_per_group(scored, by, order, k)


def keep_informative(hits: DataFrame, by: str, k: int, quality: str, score: str, tie: str) -> DataFrame:
    """Drop hard junk; soft junk only fills up to ``k``."""
    usable = hits.where(F.col(quality) != "hard")
    order = [(F.col(quality) == "soft").cast("int"), F.desc(score), F.col(tie)]
    return top_per_group(usable, by, order, k)
