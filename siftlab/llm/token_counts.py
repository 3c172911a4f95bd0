"""Token counts per document without token ids: pieces are counted once per distinct pre-token."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftlab.llm.words import ByteHashes, LOWER, as_texts, bounded, range_sums, slices, text_bytes, word_ranges
from siftlab.session import materialize

TOKEN_LIMIT = 2048
# A pre-token is frequent if it makes up one part in FREQUENT of all pre-tokens: there are at most that many.
FREQUENT = 1 << 19
# Bytes of text worked on at once, and distinct pre-tokens a task holds before it passes their counts on.
CHUNK_BYTES = 1 << 21
HELD = 200_000

# Kinds of bytes for the fast way; anything else goes through the tokenizer's own pre-tokenizer.
_LETTER, _DIGIT, _MARK, _OTHER = 1, 2, 3, 0
_KIND = np.zeros(256, np.int8)
_KIND[0x21:0x7F] = _MARK
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[[0x27, 0x3C]] = _OTHER  # contractions and special tokens

_TOKENIZERS: dict[str, "PreTokens"] = {}


class PreTokens:
    """Pre-tokens of texts and their number of pieces, by one tokenizer file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("(" + "|".join(self.special) + ")") if self.special else None
        # Words stand alone if white space separates and is dropped; plain ASCII words then are cut where kinds change.
        probe = self._own("ab, C1 2?!x")
        self.by_word = probe == self._own("ab,") + self._own("C1") + self._own("2?!x")
        self.plain = self.by_word and probe == ["ab", ",", "c", "1", "2", "?!", "x"]

    def _own(self, text: str) -> list[str]:
        t = self.tokenizer
        text = t.normalizer.normalize_str(text) if t.normalizer else text
        return [p for p, _ in t.pre_tokenizer.pre_tokenize_str(text)] if t.pre_tokenizer else [text]

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of any text; special tokens stand as they are, after a zero byte."""
        parts = self.special.split(text) if self.special else [text]
        return [p for i, part in enumerate(parts) if part for p in (["\0" + part] if i % 2 else self._own(part))]

    def pieces(self, pre_token: str) -> int:
        return 1 if pre_token.startswith("\0") else len(self.tokenizer.model.tokenize(pre_token))

    def occurrences(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct pre-tokens, the one of each occurrence, the text of each occurrence)."""
        data, offsets = text_bytes(texts)
        if self.by_word:
            starts, ends, first = word_ranges(data, offsets)
        else:
            starts, ends, first = offsets[:-1], offsets[1:], np.arange(len(offsets))
        texts_of = np.repeat(np.arange(len(texts)), np.diff(first))
        fast = np.zeros(len(starts), bool)
        names: list[str] = []
        codes, owners = [], []
        raw = data.tobytes()
        if self.plain:
            kind = _KIND[data]
            other = np.concatenate([[0], np.cumsum(kind == _OTHER)])
            fast = other[ends] == other[starts]
            inside = np.zeros(len(data) + 1, np.int32)
            inside[starts[fast]] += 1
            inside[ends[fast]] -= 1
            inside = np.cumsum(inside[:-1]) > 0
            begins = np.zeros(len(data), bool)
            begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
            begins[starts] = True
            at = np.flatnonzero(begins & inside)
            stops = np.minimum(np.append(at[1:], len(data)), ends[np.searchsorted(ends, at, side="right")] if len(at) else 0)
            low = LOWER[data]
            found, unique = pd.factorize(ByteHashes(low).ranges(at, stops))
            where = np.zeros(len(unique), np.int64)
            where[found[::-1]] = np.arange(len(found) - 1, -1, -1)
            lowered = low.tobytes()
            names = [lowered[a:b].decode() for a, b in zip(at[where].tolist(), stops[where].tolist(), strict=True)]
            codes.append(found)
            owners.append(np.searchsorted(offsets, at, side="right") - 1)
        rest = np.flatnonzero(~fast)
        if len(rest):
            found, unique = pd.factorize(ByteHashes(data).ranges(starts[rest], ends[rest]))
            where = np.zeros(len(unique), np.int64)
            where[found[::-1]] = np.arange(len(found) - 1, -1, -1)
            known = {name: i for i, name in enumerate(names)}
            cuts = []
            for a, b in zip(starts[rest[where]].tolist(), ends[rest[where]].tolist(), strict=True):
                cuts.append([known.setdefault(p, len(known)) for p in self.cut(raw[a:b].decode())])
            names = list(known)
            sizes = np.array([len(c) for c in cuts], np.int64)
            begin = np.cumsum(sizes) - sizes
            flat = np.array([p for c in cuts for p in c], np.int64)
            each = sizes[found]
            total = np.cumsum(each)
            step = np.arange(int(total[-1]) if len(total) else 0) - np.repeat(total - each, each)
            codes.append(flat[np.repeat(begin[found], each) + step])
            owners.append(np.repeat(texts_of[rest], each))
        joined = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        return names, joined, np.concatenate(owners) if owners else np.zeros(0, np.int64)


def _pre_tokens(path: str) -> PreTokens:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = PreTokens(path)
    return _TOKENIZERS[path]


def pre_token_counts(texts: DataFrame, tokenizer_path: str) -> DataFrame:
    """(pre_token, n, pieces) of all texts: each distinct pre-token is given to the model once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _pre_tokens(tokenizer_path)
        held: dict[str, int] = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["pre_token", "n"])

        for piece in slices(batches, "text", CHUNK_BYTES):
            names, codes, _ = cutter.occurrences(as_texts(piece.column("text")))
            for name, n in zip(names, np.bincount(codes, minlength=len(names)).tolist(), strict=True):
                held[name] = held.get(name, 0) + n
            if len(held) > HELD:
                yield told()
                held.clear()
        yield told()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _pre_tokens(tokenizer_path)
        for batch in batches:
            found = [cutter.pieces(p) for p in batch.column("pre_token").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("pre_token"), batch.column("n"), pa.array(found, pa.int64())], ["pre_token", "n", "pieces"])

    partial = bounded(texts.select("text")).mapInArrow(count, "pre_token string, n long")
    return partial.groupBy("pre_token").agg(F.sum("n").alias("n")).mapInArrow(pieces, "pre_token string, n long, pieces long")


def count_tokens(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row, as the tokenizer would count without end tokens.

    The first pass gathers the distinct pre-tokens of all texts and how many pieces each has. The
    second finds the frequencies of the pre-tokens in every document. Those of frequent pre-tokens
    (at most ``FREQUENT`` by their definition, so their table has a proven bound and travels to the
    tasks) are multiplied and summed at once; all others meet their pieces in a join on the
    pre-token, of which none holds more than one part in ``FREQUENT`` of the occurrences, so no
    join key is hot. Token ids are never formed.

    Null texts are empty and have no tokens; null and repeated ids are rows like any other; other
    columns are ignored; an empty table gives no rows. Special tokens inside texts count as the
    tokenizer's default takes them: one token. Texts of any length are taken whole.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = materialize(pre_token_counts(rows, tokenizer_path), "pre-tokens")
    total = table.agg(F.sum("n").alias("n")).first()["n"] or 0
    often = table.where(F.col("n") * FREQUENT >= total).select("pre_token", "pieces").toPandas()
    sent = spark.sparkContext.broadcast(dict(zip(often["pre_token"], often["pieces"].astype("int32").tolist(), strict=True)))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, frequent = _pre_tokens(tokenizer_path), sent.value
        for piece in slices(batches, "text", CHUNK_BYTES):
            texts = as_texts(piece.column("text"))
            names, codes, owner = cutter.occurrences(texts)
            # Frequencies: one entry for each document and pre-token in it.
            pairs, n = np.unique(owner * max(len(names), 1) + codes, return_counts=True)
            document, code = pairs // max(len(names), 1), pairs % max(len(names), 1)
            size = np.array([frequent.get(p, -1) for p in names], np.int64)[code] if len(names) else np.zeros(0, np.int64)
            first = np.searchsorted(document, np.arange(len(texts) + 1))
            sums = range_sums(np.where(size >= 0, size, 0) * n, first)
            rare = np.flatnonzero(size < 0)
            borders = pa.array(np.searchsorted(rare, first), pa.int32())
            taken = pa.array(names, pa.string()).take(pa.array(code[rare], pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"), pa.array(np.diff(text_bytes(texts)[1]), pa.int64()), pa.array(sums, pa.int64()),
                    pa.ListArray.from_arrays(borders, taken), pa.ListArray.from_arrays(borders, pa.array(n[rare], pa.int64())),
                ],
                ["doc_id", "n_bytes", "frequent", "rare", "times"],
            )

    schema = "doc_id long, n_bytes long, frequent long, rare array<string>, times array<bigint>"
    # Written, so the number of a row stays the same for both readers.
    found = materialize(bounded(rows).mapInArrow(tally, schema).withColumn("row", F.monotonically_increasing_id()), "frequencies")
    each = found.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("pre_token"), "r.times")
    rest = table.where(F.col("n") * FREQUENT < total).select("pre_token", "pieces")
    summed = each.join(rest, "pre_token").groupBy("row").agg(F.sum(F.col("times") * F.col("pieces")).alias("others"))
    counted = found.select("row", "doc_id", "n_bytes", "frequent").join(summed, "row", "left")
    n_tokens = F.col("frequent") + F.coalesce("others", F.lit(0))
    return counted.select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
