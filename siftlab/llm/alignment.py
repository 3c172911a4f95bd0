"""Alignment of two tokenizers over all texts, and how often their tokens overlap in the corpus."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from siftlab.llm.perfect_hash import KeyedVector, PerfectHash
from siftlab.llm.words import ByteHashes, as_texts, bounded, concat_ranges, range_sums, slices, text_bytes
from siftlab.session import materialize

# Bytes of text aligned at once, and of joined pieces given to the tokenizers in one call.
CHUNK_BYTES = 1 << 22
CALL_BYTES = 1 << 18
# Distinct pairs a task holds before it passes their counts on.
HELD = 1_000_000
# Keys of one perfect hash, count vectors added up in one task, and rows of one look-up group.
SHARD_KEYS = 1 << 15
FAN_IN = 16
GROUP_ROWS = 200_000
# A pair is frequent if it is one part in FREQUENT of all links: there are at most that many.
FREQUENT = 1 << 18

_SURE = np.zeros(256, bool)
_SURE[0x21:0x7F] = True
_MARK = "▁"
_MARK_BYTES = _MARK.encode()
_ALIGNERS: dict[tuple[str, str], "Aligner"] = {}


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones are their own."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class _Vocabulary:
    """Bytes of every id, one after another."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.array([len(e) for e in entries], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(entries), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.blob[concat_ranges(self.starts[ids], self.lengths[ids])]


class Pieces:
    """Alignment of distinct pieces of text: counts, links (keys ``a << 32 | b``) and groups per piece."""

    def __init__(self, n: int, with_groups: bool):
        self.n_a, self.n_b, self.n_groups, self.n_links, self.at = (np.zeros(n, np.int64) for _ in range(5))
        self.good = np.ones(n, bool)
        self.found: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.held = 0
        self.groups: list[str] | None = [""] * n if with_groups else None

    def links(self) -> np.ndarray:
        """The links of all pieces in their order."""
        return np.concatenate(self.found)[concat_ranges(self.at, self.n_links)]


class Aligner:
    """Aligns a byte-level BPE (tokenizers) and a SentencePiece BPE with byte fallback.

    Both cut before white space that follows another character, so a text is the sequence of the
    pieces between such places, and each distinct piece of a slice of texts is encoded once. For
    white space other than blanks that holds only if no entry of the vocabulary goes across it.
    """

    def __init__(self, byte_path: str, piece_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        byte_of = _byte_of_char()
        added = self.a.get_added_tokens_decoder()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.vocab_a = _Vocabulary([n.encode() if i in added else bytes(byte_of[c] for c in n) for i, n in enumerate(names)])
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.vocab_b = _Vocabulary(
            [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        )
        # Every id as text, followed by the sign inside its side of a group or at the end of the side.
        signs = [(self.vocab_a, ",|"), (self.vocab_b, ",;")]
        self.signed = np.array([f"{i}{sign}" for vocab, pair in signs for i in range(len(vocab.lengths)) for sign in pair], object)
        self.cuts = np.zeros(256, bool)
        self.cuts[[ord(c) for c in " \n\t" if not any((_MARK if c == " " else c) in p[1:].lstrip(_MARK) for p in pieces)]] = True

    def _sure(self, data: np.ndarray, at: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Whether the character that ends before each place is surely no white space (letters of three bytes: from U+4000)."""
        back = [data[np.maximum(at - k, floor)] for k in range(1, 5)]
        high = back[0] >= 0x80
        return _SURE[back[0]] | (high & ((back[1] >= 0xC3) | (back[1] >= 0x80) & (back[1] < 0xC0) & ((back[2] >= 0xE4) | (back[2] < 0xC0) & (back[3] >= 0xF0))))

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start of each piece, first piece of each text)"""
        at = np.flatnonzero(self.cuts[data])
        floor = offsets[np.searchsorted(offsets, at, side="right") - 1]
        inner = at[(at > floor)]
        inner = inner[self._sure(data, inner, floor[at > floor])]
        begins = np.zeros(len(data), bool)
        begins[inner] = begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        return starts, np.searchsorted(starts, offsets)

    def _encode(self, out: Pieces, numbers: np.ndarray, pieces: np.ndarray, sizes: np.ndarray) -> None:
        """Align pieces (their bytes one after another); if the result does not fall apart at their ends, each half again."""
        raw = np.concatenate([np.frombuffer(b" .", np.uint8), pieces])
        text = raw.tobytes().decode()
        a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        b = np.array(self.b.encode(text[1:], num_threads=1), np.int64)
        ends_a, ends_b = np.cumsum(self.vocab_a.lengths[a]), np.cumsum(self.vocab_b.lengths[b])
        ends = 2 + np.concatenate([[0], np.cumsum(sizes)])
        fits = ends_a[-1] == ends_b[-1] == len(raw) and np.array_equal(self.vocab_a.joined(a), raw) and np.array_equal(self.vocab_b.joined(b), raw)
        marks = np.zeros((2, len(raw) + 1), bool)
        if fits:
            marks[0, ends_a], marks[1, ends_b] = True, True
            fits = marks[:, ends].all()
        if not fits:
            if len(numbers) == 1:
                out.good[numbers] = False
                return
            half = len(numbers) // 2
            cut = int(sizes[:half].sum())
            self._encode(out, numbers[:half], pieces[:cut], sizes[:half])
            self._encode(out, numbers[half:], pieces[cut:], sizes[half:])
            return
        every, both = np.flatnonzero(marks[0] | marks[1]), np.flatnonzero(marks[0] & marks[1])
        out.found.append(a[np.searchsorted(ends_a, every)] << 32 | b[np.searchsorted(ends_b, every)])
        for counts, places in ((out.n_a, ends_a), (out.n_b, ends_b), (out.n_groups, both), (out.n_links, every)):
            counts[numbers] = np.diff(np.searchsorted(places, ends, side="right"))
        out.at[numbers] = out.held + np.searchsorted(every, ends[:-1], side="right")
        out.held += len(every)
        if out.groups is not None:
            # Tokens in the order of (group, tokenizer), each written with the sign that follows it.
            group = np.concatenate([np.searchsorted(both, ends_a) * 2, np.searchsorted(both, ends_b) * 2 + 1])
            order = np.argsort(group, kind="stable")
            last = np.diff(group[order], append=-1) != 0
            entry = np.concatenate([a, len(self.vocab_a.lengths) + b])[order] * 2 + last
            signed = self.signed[entry].tolist()
            token_at = np.searchsorted(group[order], np.searchsorted(both, ends, side="right") * 2).tolist()
            for i, n in enumerate(numbers.tolist()):
                out.groups[n] = "".join(signed[token_at[i] : token_at[i + 1]])

    def align(self, texts: pa.Array, with_groups: bool) -> tuple[Pieces, np.ndarray, np.ndarray, np.ndarray]:
        """(distinct pieces, the piece of each occurrence, first occurrence of each text, texts with tokens)."""
        some = pc.not_equal(texts, pa.scalar("", pa.large_string()))
        spaced = pc.if_else(some, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string())), texts)
        data, offsets = text_bytes(spaced)
        starts, first = self._pieces(data, offsets)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        codes, unique = pd.factorize(ByteHashes(data).ranges(starts, ends))
        where = np.zeros(len(unique), np.int64)
        where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        at, stop = starts[where], ends[where]
        sizes = stop - at
        out = Pieces(len(unique), with_groups)
        # The mark in a text stands for a blank in the other vocabulary.
        marks = np.flatnonzero((data[:-2] == _MARK_BYTES[0]) & (data[1:-1] == _MARK_BYTES[1]) & (data[2:] == _MARK_BYTES[2]))
        out.good = np.searchsorted(marks, at) == np.searchsorted(marks, stop)
        # A piece that ends with white space, at the end of its text, must not meet another piece.
        alone = ~self._sure(data, stop, at)
        for n in np.flatnonzero(alone & out.good).tolist():
            self._encode(out, np.array([n]), data[at[n] : stop[n]], sizes[n : n + 1])
        rest = np.flatnonzero(~alone & out.good)
        call = np.cumsum(sizes[rest]) // CALL_BYTES
        for numbers in np.split(rest, np.flatnonzero(np.diff(call)) + 1) if len(rest) else []:
            self._encode(out, numbers, data[concat_ranges(at[numbers], sizes[numbers])], sizes[numbers])
        whole = range_sums((~out.good)[codes].astype(np.int64), first) == 0
        return out, codes, first, whole & (np.diff(first) > 0)


def _aligner(byte_path: str, piece_path: str) -> Aligner:
    key = (byte_path, piece_path)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(*key)
    return _ALIGNERS[key]


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def _shard_of(keys, shards: int):
    """Shard of a key column, as a Spark expression."""
    return F.pmod(F.xxhash64(keys), F.lit(shards)).cast("int")


def link_counts(texts: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(part, key, n): links per pair, summed inside each task of the first pass."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part = _aligner(byte_path, piece_path), TaskContext.get().partitionId()
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), part, np.int32)), pa.array(keys), pa.array(n)], ["part", "key", "n"])

        for piece in slices(batches, "text", CHUNK_BYTES):
            found, codes, first, whole = aligner.align(as_texts(piece.column("text")), False)
            times = np.bincount(codes[np.repeat(whole, np.diff(first))], minlength=len(found.good))
            links = found.links()
            weights = np.repeat(times, found.n_links)
            keys, n = _summed(np.concatenate([keys, links[weights > 0]]), np.concatenate([n, weights[weights > 0]]))
            if len(keys) > HELD:
                yield told()
                keys, n = keys[:0], n[:0]
        yield told()

    return bounded(texts.select("text")).mapInArrow(count, "part int, key long, n long")


def pair_table(partial: DataFrame) -> tuple[DataFrame, int]:
    """(shard, hash, keys, counts) with the links of every pair in the corpus, and the number of shards.

    ``partial`` has (part, key, n). The distinct keys are dealt to shards of about SHARD_KEYS, and
    each shard gets a minimal perfect hash. The counts of every FAN_IN parts are laid out as one
    dense vector by hash; then FAN_IN vectors at a time are added up, until one is left.
    """
    distinct = materialize(partial.select("key").distinct(), "pairs")
    shards = max(1, -(-distinct.count() // SHARD_KEYS))

    def hashed(rows: pa.Table) -> pa.Table:
        keys = rows.column("key").to_numpy().astype(np.uint64)
        table = PerfectHash.build(keys)
        return pa.table({"shard": rows.column("shard")[:1], "hash": pa.array([table.dump()], pa.binary()), "keys": pa.array([table.by_slot(keys).tobytes()], pa.binary())})

    hashes = distinct.select(_shard_of("key", shards).alias("shard"), "key").groupBy("shard").applyInArrow(hashed, "shard int, hash binary, keys binary")
    hashes = materialize(hashes, "hashes")
    blocks = 1 + (partial.agg(F.max("part").alias("p")).first()["p"] or 0) // FAN_IN

    def vector(rows: pa.Table, table: pa.Table) -> pa.Table:
        names = {"shard": pa.int32(), "block": pa.int32(), "counts": pa.binary()}
        if not rows.num_rows:
            return pa.table({k: pa.array([], t) for k, t in names.items()})
        slots = PerfectHash.load(table.column("hash")[0].as_py()).slots(rows.column("key").to_numpy())
        counts = np.zeros(len(table.column("keys")[0].as_py()) // 8, np.int64)
        np.add.at(counts, slots, rows.column("n").to_numpy())
        return pa.table({"shard": rows.column("shard")[:1], "block": rows.column("block")[:1], "counts": pa.array([counts.tobytes()], pa.binary())})

    block = F.floor(F.col("part") / FAN_IN).cast("int")
    left = partial.select(_shard_of("key", shards).alias("shard"), block.alias("block"), "key", "n")
    right = hashes.select("shard", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "hash", "keys")
    schema = "shard int, block int, counts binary"
    vectors = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(vector, schema)

    def added(rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(c.as_py(), np.int64) for c in rows.column("counts"))
        return pa.table({"shard": rows.column("shard")[:1], "block": rows.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    while blocks > 1:
        vectors = vectors.withColumn("block", F.floor(F.col("block") / FAN_IN).cast("int")).groupBy("shard", "block").applyInArrow(added, schema)
        blocks = -(-blocks // FAN_IN)
    return materialize(hashes.join(vectors.drop("block"), "shard"), "counts"), shards


def _best_counts(table: DataFrame) -> DataFrame:
    """(b, best): the highest count of a pair per id of the second vocabulary."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                b, n = (np.frombuffer(keys, np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.int64), np.frombuffer(counts, np.int64)
                order = np.argsort(b, kind="stable")
                first = np.flatnonzero(np.diff(b[order], prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array(b[order][first]), pa.array(np.maximum.reduceat(n[order], first))], ["b", "best"])

    return table.select("keys", "counts").mapInArrow(best, "b long, best long").groupBy("b").agg(F.max("best").alias("best"))


def _frequent(table: DataFrame, total: int) -> DataFrame:
    """(key, n) of the pairs that are at least one part in FREQUENT of all links."""

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                n = np.frombuffer(counts, np.int64)
                taken = n * FREQUENT >= total
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(keys, np.uint64)[taken].astype(np.int64)), pa.array(n[taken])], ["key", "n"])

    return table.select("keys", "counts").mapInArrow(frequent, "key long, n long")


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row.

    First pass: every task aligns its texts and sums its links by pair; :func:`pair_table` makes
    one count vector of them. Second pass: texts are aligned again and counts looked up. The
    counts of frequent pairs (at most FREQUENT by definition, so their table has a proven bound)
    and the best count per second id (at most one vocabulary) travel to the tasks. Links of other
    pairs go to the shard of their pair, salted by row so that a group stays near GROUP_ROWS, and
    the sums come back by row. A slot counts only if its key is the pair's own.

    Null and empty texts, and texts that the second tokenizer does not give back byte by byte,
    have no tokens. Null and repeated ids are rows like any other; other columns are ignored; an
    empty table gives no rows. Texts are taken whole. Within a slice of texts 64-bit hashes stand
    for equal pieces.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    partial = materialize(link_counts(rows, byte_path, piece_path), "links")
    table, shards = pair_table(partial)
    total = partial.agg(F.sum("n").alias("n")).first()["n"] or 0
    often = _frequent(table, total).toPandas()
    keys = often["key"].to_numpy(np.uint64)
    hashed = PerfectHash.build(keys)
    values = np.zeros(len(keys), np.int64)
    values[hashed.slots(keys)] = often["n"].to_numpy(np.int64)
    top = _best_counts(table).toPandas()
    best = np.zeros(int(top["b"].max()) + 1 if len(top) else 1, np.int64)
    best[top["b"].to_numpy(np.int64)] = top["best"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast((hashed.dump(), hashed.by_slot(keys), values, best))

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(byte_path, piece_path)
        dump, held, counts, best = sent.value
        vector = KeyedVector(PerfectHash.load(dump), held, counts)
        for piece in slices(batches, "text", CHUNK_BYTES):
            found, codes, first, whole = aligner.align(as_texts(piece.column("text")), True)
            links = found.links()
            at = np.concatenate([[0], np.cumsum(found.n_links)])
            n = vector.get(links)
            tops = (n >= 0) & (n == best[np.minimum(links & 0xFFFFFFFF, len(best) - 1)])
            sums, bests = range_sums(np.maximum(n, 0), at), range_sums(tops.astype(np.int64), at)
            per_text = lambda v: np.where(whole, range_sums(v[codes], first), 0)
            shas = []
            for lo, hi, ok in zip(first[:-1].tolist(), first[1:].tolist(), whole.tolist(), strict=True):
                shas.append(hashlib.sha256("".join([found.groups[c] for c in codes[lo:hi].tolist()])[:-1].encode()).hexdigest() if ok else "")
            # Links of other pairs, one entry for each pair of a text.
            rare = np.flatnonzero(n < 0)
            rare_at = np.searchsorted(rare, at)
            each = np.where(np.repeat(whole, np.diff(first)), np.diff(rare_at)[codes], 0)
            owner = np.repeat(np.repeat(np.arange(len(whole)), np.diff(first)), each)
            pairs = pd.DataFrame({"o": owner, "k": links[rare[concat_ranges(rare_at[codes], each)]]}).value_counts(sort=False).sort_index()
            owners, rare_keys = pairs.index.get_level_values(0).to_numpy(), pairs.index.get_level_values(1).to_numpy()
            borders = pa.array(np.searchsorted(owners, np.arange(len(whole) + 1)), pa.int32())
            columns = [per_text(v) for v in (found.n_a, found.n_b, found.n_groups, found.n_links, bests, sums)]
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns], pa.array(shas, pa.string()),
                    pa.ListArray.from_arrays(borders, pa.array(rare_keys, pa.int64())), pa.ListArray.from_arrays(borders, pa.array(pairs.to_numpy(), pa.int64())),
                ],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "bests", "sums", "groups_sha256", "rare", "times"],
            )

    schema = (
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, bests long, sums long, groups_sha256 string, "
        "rare array<bigint>, times array<bigint>"
    )
    # Written, so the number of a row stays the same for both readers.
    aligned = materialize(bounded(rows).mapInArrow(second, schema).withColumn("row", F.monotonically_increasing_id()), "aligned")
    salts = 1 + (aligned.agg(F.sum(F.size("rare")).alias("n")).first()["n"] or 0) // (shards * GROUP_ROWS)

    def looked_up(rows: pa.Table, table: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in ("row", "more_best", "more_sum")})
        vector = KeyedVector(
            PerfectHash.load(table.column("hash")[0].as_py()), np.frombuffer(table.column("keys")[0].as_py(), np.uint64),
            np.frombuffer(table.column("counts")[0].as_py(), np.int64),
        )
        keys, times = rows.column("key").to_numpy(), rows.column("times").to_numpy()
        n = vector.get(keys)
        tops = n == sent.value[3][keys & 0xFFFFFFFF]
        return pa.table({"row": rows.column("row"), "more_best": pa.array(times * tops), "more_sum": pa.array(times * n)})

    each = aligned.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("key"), F.col("r.times").alias("times"))
    each = each.select(_shard_of("key", shards).alias("shard"), F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int").alias("salt"), "row", "key", "times")
    salted = table.select("shard", F.explode(F.sequence(F.lit(0), F.lit(int(salts) - 1))).alias("salt"), "hash", "keys", "counts")
    more = each.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt")).applyInArrow(looked_up, "row long, more_best long, more_sum long")
    more = more.groupBy("row").agg(F.sum("more_best").alias("more_best"), F.sum("more_sum").alias("more_sum"))
    told = aligned.drop("rare", "times").join(more, "row", "left")
    return told.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("bests") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("sums") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"), "groups_sha256",
    )
