"""Token ids as Simple-8b shards: tokenising, writing in document order and reading back."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from siftlab.llm import simple8b
from siftlab.llm.words import LOWER, ByteHashes, as_texts, bounded, concat_ranges, range_sums, slices, text_bytes, word_ranges
from siftlab.session import scratch_path

END_ID = 1
# Letters that every step of the tokenizer treats alike: units of these are learned in bulk.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_KNOWN_UNITS = 350_000
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True

_ENCODERS: dict[str, "WordEncoder"] = {}


def token_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges the tokenizer treats on their own, and the first of each text.

    These are the words between white space, with a closing full stop or comma apart where it
    follows a letter (ASCII, or U+00C0 to U+00FF without the two signs): the pre-tokenizer cuts
    there as well.
    """
    starts, ends, first = word_ranges(data, offsets)
    last, before, second = data[ends - 1], data[np.maximum(ends - 2, 0)], data[np.maximum(ends - 3, 0)]
    letter = _LETTER[before] | ((second == 0xC3) & (before != 0x97) & (before != 0xB7) & (ends - starts > 2) & (before >= 0x80))
    cut = ((last == 46) | (last == 44)) & letter & (ends - starts > 1)
    extra = np.concatenate([[0], np.cumsum(cut)])
    place = np.arange(len(starts)) + extra[:-1]
    unit_starts = np.empty(len(starts) + int(extra[-1]), np.int64)
    unit_ends = unit_starts.copy()
    unit_starts[place], unit_ends[place] = starts, ends - cut
    tail = place[cut] + 1
    unit_starts[tail], unit_ends[tail] = ends[cut] - 1, ends[cut]
    return unit_starts, unit_ends, first + extra[first]


class WordEncoder:
    """Token ids per unit of text; each unit is given to the tokenizer once.

    The tokenizer splits at the borders of units before anything else, so the ids of a text are
    those of its units in order. Units are found by a 64-bit hash of their bytes. The table is
    emptied when it holds ``_KNOWN_UNITS``, so it stays bounded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.ends_word = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.reset()

    def reset(self) -> None:
        self.code_of: dict[int, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _encode_plain(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths) of many plain units in one call; end-of-word tokens tell them apart."""
        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for start in range(0, len(units), 20_000):
            part = units[start : start + 20_000]
            got = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends_word[got]) + 1
            if len(stops) != len(part):  # a vocabulary without such tokens
                each = [self._encode(u) for u in part]
                got, stops = np.array([i for e in each for i in e], np.uint32), np.cumsum([len(e) for e in each])
            ids.append(got)
            lengths.append(np.diff(stops, prepend=0))
        return np.concatenate(ids), np.concatenate(lengths)

    def learn(self, hashes: list[int], units: list[str]) -> None:
        plain = [bool(_PLAIN.fullmatch(u)) for u in units]
        ids, lengths = self._encode_plain([u for u, p in zip(units, plain, strict=True) if p])
        others = [self._encode(u) for u, p in zip(units, plain, strict=True) if not p]
        ordered = [h for h, p in zip(hashes, plain, strict=True) if p] + [h for h, p in zip(hashes, plain, strict=True) if not p]
        lengths = np.concatenate([lengths, np.array([len(x) for x in others], np.int64)])
        self.code_of.update(zip(ordered, range(len(self.starts), len(self.starts) + len(ordered)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids, np.array([i for x in others for i in x], np.uint32)])

    def encode_texts(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids per text), end ids included."""
        if len(self.starts) > _KNOWN_UNITS:
            self.reset()
        data, offsets = text_bytes(texts)
        starts, ends, first = token_units(data, offsets)
        if not (data == 60).any():  # special tokens are matched before lower-casing and hold a "<"
            data = LOWER[data]
        codes, unique = pd.factorize(ByteHashes(data).ranges(starts, ends))
        keys = unique.tolist()
        missing = [i for i, h in enumerate(keys) if h not in self.code_of]
        if missing:
            place = np.full(len(keys), -1, np.int64)
            place[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)  # the first occurrence
            raw = data.tobytes()
            at = place[missing]
            units = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
            self.learn([keys[i] for i in missing], units)
        code = np.fromiter(map(self.code_of.__getitem__, keys), np.int64, len(keys))[codes]
        length = self.lengths[code]
        ids = self.ids[concat_ranges(self.starts[code], length)]
        counts = range_sums(length, first)
        out = np.full(len(ids) + len(texts), end_id, np.uint32)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(counts + 1) - 1] = False
        out[keep] = ids
        return out, counts + 1


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_token_shards(
    docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID
) -> None:
    """Write the token ids of all documents in ascending id order below ``path``.

    The frame is range-partitioned by id; every partition becomes one Parquet file of records
    (part, seq, before, doc_ids, lengths, n_ids, block_offsets, words). A record holds the ids of
    some consecutive documents as Simple-8b words; ``block_offsets`` gives the first word of every
    block of ``simple8b.BLOCK`` ids. Spark's committer makes retried tasks safe. Null texts are
    empty; null ids come first; rows of equal id are ordered by their text; an empty table
    writes no records; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        part, before, seq = TaskContext.get().partitionId(), 0, 0
        for piece in slices(batches, "text"):
            ids, counts = encoder.encode_texts(as_texts(piece.column("text")), end_id)
            payload, offsets = simple8b.encode(ids)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()),
                    "before": pa.array([before], pa.int64()), "doc_ids": pa.array([piece.column("id")], pa.list_(pa.int64())),
                    "lengths": pa.array([counts], pa.list_(pa.int64())), "n_ids": pa.array([len(ids)], pa.int64()),
                    "block_offsets": pa.array([offsets], pa.list_(pa.int64())), "words": pa.array([payload], pa.binary()),
                }
            )
            before += len(ids)
            seq += 1

    bounded(rows).mapInArrow(
        pack,
        "part int, seq int, before long, doc_ids array<bigint>, lengths array<bigint>, n_ids long, "
        "block_offsets array<bigint>, words binary",
    ).write.parquet(path)


def read_token_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document, decoded from the written records."""
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # One row per file, a few thousand at most.
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = simple8b.decode(row["words"], row["block_offsets"], row["n_ids"]).astype("<u4")
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                raw = ids.tobytes()
                crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()), "part": pa.array([row["part"]] * len(crcs), pa.int32()),
                        "at": pa.array(row["before"] + ends - lengths, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()),
                        "ids_crc32": pa.array(crcs, pa.int64()),
                    }
                )

    narrow = shards.select("part", "before", "doc_ids", "lengths", "n_ids", "block_offsets", "words")
    decoded = narrow.mapInArrow(unpack, "doc_id long, part int, at long, n_tokens long, ids_crc32 long")
    return decoded.join(totals, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_output(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, path: str | None = None
) -> DataFrame:
    """Write the shards (to ``path``, else to the shared folder) and report what they hold."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_token_shards(docs, path, tokenizer_path, id_col, text_col, end_id)
    schema = (
        "part int, seq int, before long, doc_ids array<bigint>, lengths array<bigint>, n_ids long, "
        "block_offsets array<bigint>, words binary"
    )
    return read_token_shards(spark.read.schema(schema).parquet(path))
