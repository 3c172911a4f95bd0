"""Chunks, chunk ids and embeddings of documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from siftlab.functions import fixed as K
from siftlab.functions.text import as_col, keyword_tokens, let, text_or_empty

HEADING = r"(?m)^(#{1,6}\s)"


def _section_chunks(section: Column, size: int, overlap: int) -> Column:
    """Token windows of one section, moved to sentence ends where one lies in the overlap."""
    stride = size - overlap

    def build(words: Column, starts: Column) -> Column:
        n = F.size(words)
        last = F.greatest(F.ceil((n - overlap) / F.lit(stride)).cast("int") - 1, F.lit(0))

        def first_in(at: Column) -> Column:
            """First sentence start in the overlap beginning at token ``at``, else ``at``."""
            return let(
                lambda p: F.when(p > 0, at + p - 1).otherwise(at),
                F.array_position(F.slice(starts, at + 1, F.lit(overlap + 1)), True).cast("int"),
            )

        def last_in(at: Column) -> Column:
            """Last sentence start in the overlap beginning at token ``at``, else its end."""
            return let(
                lambda p: F.when(p > 0, at + overlap + 1 - p).otherwise(at + overlap),
                F.array_position(F.reverse(F.slice(starts, at + 1, F.lit(overlap + 1))), True).cast("int"),
            )

        def one(w: Column) -> Column:
            begin = F.when(w == 0, F.lit(0)).otherwise(first_in(w * stride))
            end = F.when(w == last, n).otherwise(last_in((w + 1) * stride))
            return let(lambda b, e: F.array_join(F.slice(words, b + 1, e - b), " "), begin, end)

        return F.transform(F.sequence(F.lit(0), last), one)

    words = F.filter(F.split(section, r"\s+"), lambda t: t != "")
    return let(
        lambda ws: F.when(F.size(ws) == 0, F.array().cast("array<string>")).otherwise(
            let(build, ws, _sentence_starts(ws))
        ),
        words,
    )


def _sentence_starts(words: Column) -> Column:
    """True where the token before ends a sentence; one more entry than tokens, the last is true."""
    ends = F.transform(words, lambda t: t.rlike(r"[.!?。！？][\"')\]]*$"))
    return F.concat(F.array(F.lit(True)), ends)


def chunk_documents(df: DataFrame, id_col: str, text_col: str, size: int = 256, overlap: int = 50) -> DataFrame:
    """One row per chunk: chunk_index, total_chunks, text.

    Documents are split at Markdown headings, then into windows of at most ``size`` whitespace
    tokens that share up to ``overlap`` tokens and start and end at sentences where possible.
    Everything happens inside the row: no shuffle, whatever the length of the document.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    marked = F.regexp_replace(text_or_empty(F.col(text_col)), HEADING, "\x01$1")
    sections = F.split(marked, "\x01")
    chunks = F.flatten(F.transform(sections, lambda s: _section_chunks(s, size, overlap)))
    kept = [c for c in df.columns if c != text_col]
    return df.withColumn("_c", chunks).select(
        *kept, F.size("_c").alias("total_chunks"), F.posexplode("_c").alias("chunk_index", "text")
    )


def with_chunk_ids(chunks: DataFrame, position: str) -> DataFrame:
    """Adds chunk_id: ``<doi>#chunk:<n>`` for real document ids, else ``hash_<sha256>`` of the text.

    All but the first row (by ``position``) with the same id get ``#dup:`` and 16 hex digits of
    the text and its keys. First positions are looked up by position, so a text repeated any
    number of times makes no hot key.
    """
    real = F.col("doc_id").rlike(r"(?i)^10\.\d{4,9}/") & F.col("chunk_index").isNotNull()
    base = F.when(real, F.concat("doc_id", F.lit("#chunk:"), F.col("chunk_index").cast("string"))).otherwise(
        F.concat(F.lit("hash_"), F.sha2(text_or_empty(F.col("text")), 256))
    )
    keyed = chunks.withColumn("_base", base)
    first = keyed.groupBy("_base").agg(F.min(position).alias(position)).select(position, F.lit(True).alias("_first"))
    payload = F.concat_ws(
        ", ",
        F.concat(F.lit('{"chunk_index": '), F.coalesce(F.col("chunk_index").cast("string"), F.lit("null"))),
        F.concat(F.lit('"doc_id": "'), F.coalesce("doc_id", F.lit("")), F.lit('"')),
        F.concat(F.lit('"reaction_type": "'), F.col("reaction_type"), F.lit('"}')),
    )
    suffix = F.substring(F.sha2(F.concat(text_or_empty(F.col("text")), F.lit("|"), payload), 256), 1, 16)
    marked = keyed.join(first, position, "left")
    chunk_id = F.when(F.col("_first"), F.col("_base")).otherwise(F.concat("_base", F.lit("#dup:"), suffix))
    return marked.withColumn("chunk_id", chunk_id).drop("_base", "_first")


def _hashed_vectors(dim: int):
    """Arrow UDF: token lists to normalised signed counts. A token is hashed once per worker."""

    def vectors(token_lists):
        import hashlib

        import numpy as np
        import pandas as pd

        codes = {}

        def code(token):
            digest = hashlib.sha256(token.encode("utf-8")).digest()
            entry = int.from_bytes(digest[:4], "big") % dim + 1
            codes[token] = -entry if digest[4] & 1 else entry
            return codes[token]

        def one(tokens):
            c = np.fromiter((codes.get(t) or code(t) for t in tokens), dtype=np.int64, count=len(tokens))
            v = np.bincount(np.abs(c) - 1, weights=np.sign(c), minlength=dim).astype(float)
            norm = np.linalg.norm(v)
            return v / norm if norm > 0 else v

        return pd.Series([one(t) if t is not None else None for t in token_lists])

    # Marked so that the optimizer does not evaluate it again in filters it derives from a generator.
    return F.pandas_udf(vectors, T.ArrayType(T.DoubleType())).asNondeterministic()


def hash_embedding(c, dim: int = 256) -> Column:
    """Signed feature hashing of the keyword tokens, L2-normalised; zero vector without tokens.

    Entry and sign come from the first five bytes of the token's SHA-256. Tokens are cut in the
    JVM, the rest is one Arrow UDF. No shuffle.
    """
    return _hashed_vectors(max(8, dim))(keyword_tokens(as_col(c), K.STOPWORDS))


def embed_with(df: DataFrame, id_col: str, text_col: str, embedder: Callable[[list[str]], list], batch: int = 32) -> DataFrame:
    """Vectors from any ``list[str] -> list[list[float]]`` callable, with an error column.

    A failing batch is retried text by text; a text that still fails gets a null vector and the
    error, and so stays out of every ranking.
    """
    schema = T.StructType([df.schema[id_col]]).add("embedding", T.ArrayType(T.DoubleType())).add("error", "string")

    def run(batches):
        import pandas as pd

        def safe(texts):
            try:
                return [(list(map(float, v)), None) for v in embedder(texts)]
            except Exception as exc:  # noqa: BLE001
                if len(texts) == 1:
                    return [(None, str(exc))]
                return [safe([t])[0] for t in texts]

        for pdf in batches:
            out = []
            texts = pdf[text_col].fillna("").tolist()
            for at in range(0, len(texts), batch):
                out.extend(safe(texts[at : at + batch]))
            yield pd.DataFrame({id_col: pdf[id_col], "embedding": [v for v, _ in out], "error": [e for _, e in out]})

    return df.select(id_col, text_col).mapInPandas(run, schema)


def changed_texts(texts: DataFrame, cache: DataFrame, id_col: str, text_col: str, model: str) -> DataFrame:
    """Rows whose text hash or model differs from the cached one; ``text_hash`` goes with them."""
    hashed = texts.withColumn("text_hash", F.sha2(text_or_empty(F.col(text_col)), 256))
    known = cache.where(F.col("model") == model).select(id_col, F.col("text_hash").alias("_old"))
    joined = hashed.join(known, id_col, "left")
    return joined.where(F.col("_old").isNull() | (F.col("_old") != F.col("text_hash"))).drop("_old")
