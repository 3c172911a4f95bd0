"""Benchmark decontamination by greedy string tiling over shared token seeds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from siftlab.llm.words import LOWER, ByteHashes, as_texts, bounded, mix, slices, text_bytes, word_ranges
from siftlab.session import materialize

MIN_TILE = 5  # words of the shortest tile, which are also the words of a seed
COVERAGE = 0.5  # share of an item's words that tiles of one document must cover
FILTER_BITS = 24
_STEP = np.uint64(0x9E3779B97F4A7C15)

_OUTER = np.zeros(256, bool)
_OUTER[[ord(c) for c in ".,;:!?\"'()[]{}*#%$&-_/"]] = True


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, first token per text): words without case and outer punctuation; bare punctuation is none."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, first = word_ranges(data, offsets)
    for _ in range(4):
        starts = starts + ((ends > starts) & _OUTER[data[np.minimum(starts, len(data) - 1)]])
        ends = ends - ((ends > starts) & _OUTER[data[ends - 1]])
    real = ends > starts
    first = np.concatenate([[0], np.cumsum(real)])[first]
    return ByteHashes(data).ranges(starts[real], ends[real]), first


def seeds_of(tokens: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, texts, positions): Karp-Rabin hashes of every ``size`` tokens; a shorter text is one seed."""
    n = np.diff(first)
    count = np.where(n > 0, np.maximum(n - size + 1, 1), 0)
    text = np.repeat(np.arange(len(n)), count)
    position = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    at = first[:-1][text] + position
    stop = first[1:][text]
    seeds = np.zeros(len(at), np.uint64)
    for j in range(size):
        inside = at + j < stop
        seeds[inside] = mix(seeds[inside] * _STEP + tokens[(at + j)[inside]])
    return seeds, text, position


def _seed_rows(rows: DataFrame, size: int, filter_bits=None) -> DataFrame:
    """(id, n_tokens, position, seed) of (id, text), of seeds in the filter only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if filter_bits is None else filter_bits.value
        for piece in slices(batches, "text"):
            tokens, first = tokens_of(as_texts(piece.column("text")))
            seeds, text, position = seeds_of(tokens, first, size)
            if bits is not None:
                kept = np.flatnonzero(bits[(seeds >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                seeds, text, position = seeds[kept], text[kept], position[kept]
            yield pa.RecordBatch.from_arrays(
                [piece.column("id").take(pa.array(text)), pa.array(np.diff(first)[text]), pa.array(position), pa.array(seeds.view(np.int64))],
                names=["id", "n_tokens", "position", "seed"],
            )

    return bounded(rows).mapInArrow(run, "id long, n_tokens long, position long, seed long")


def _in_use(seeds: DataFrame):
    """A bit map of fixed size (``2 ** FILTER_BITS`` bits) of the seeds' leading bits, as a broadcast."""
    size = 1 << FILTER_BITS
    slot = F.shiftrightunsigned("seed", 64 - FILTER_BITS)
    words = seeds.select(F.shiftright(slot, 5).cast("int").alias("word"), F.pmod(slot, F.lit(32)).cast("int").alias("bit")).distinct()
    packed = words.groupBy("word").agg(F.sum(F.pow(F.lit(2.0), F.col("bit"))).cast("long").alias("bits")).toPandas()
    flat = np.zeros(size >> 5, np.uint32)
    flat[packed["word"].to_numpy(np.int64)] = packed["bits"].to_numpy(np.int64).astype(np.uint32)
    return np.unpackbits(flat.view(np.uint8), bitorder="little").astype(bool)


def tile(doc_at: np.ndarray, item_at: np.ndarray, n_item: int, size: int) -> list[tuple[int, int, int]]:
    """Tiles (document position, item position, length) of one document and item.

    Equal seeds at (p, q), (p + 1, q + 1), ... are one match of equal tokens. The longest match
    is marked first, ties by item and document position; of the others what marked tokens leave
    is matched anew while it has ``size`` tokens, so no token is in two tiles.
    """
    if n_item < size:  # the item is one seed
        return [(int(doc_at.min()), 0, n_item)] if len(doc_at) else []
    p, q = np.unique(np.stack([doc_at - item_at, item_at]), axis=1)  # by diagonal, then position
    p = p + q
    cut = np.flatnonzero((np.diff(p - q) != 0) | (np.diff(q) != 1)) + 1
    begin = np.concatenate([[0], cut])
    length = np.diff(np.concatenate([begin, [len(p)]])) + size - 1
    runs = [(-int(n), int(q[b]), int(p[b])) for b, n in zip(begin, length, strict=True)]
    used_doc, used_item = set(), np.zeros(n_item, bool)
    tiles = []
    heap = sorted(runs)  # a sorted list is a heap
    while heap and not used_item.all():
        n, b, a = heapq.heappop(heap)
        n = -n
        free = np.array([not used_item[b + k] and a + k not in used_doc for k in range(n)])
        if free.all():
            tiles.append((a, b, n))
            used_item[b : b + n] = True
            used_doc.update(range(a, a + n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]).astype(np.int8)))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s >= size:
                heapq.heappush(heap, (-(e - s), b + s, a + s))
    return tiles


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
    min_tile: int = MIN_TILE, coverage: float = COVERAGE,
) -> DataFrame:
    """(id, item, n_item, covered, n_tiles, coverage) of each document and item with enough tiles.

    Seeds of ``min_tile`` words of the benchmark are joined with those of the documents (a bit
    map of fixed size spares most document seeds the shuffle, at any size of the benchmark). Items
    of equal words are one class, and results name its smallest id. Per document and item the
    seeds are tiled greedily, and a pair is kept if the tiles cover at least ``coverage`` of the
    item's words, in whatever order the passages stand. An item shorter than a seed is found only in
    a document of just its words. Null and empty texts contain nothing and are in nothing;
    null ids are ignored; matches of rows of equal id count together; other columns
    are ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col(item_text).alias("text")).where("id is not null")
    item_seeds = materialize(_seed_rows(items, min_tile), "benchmark")
    whole = item_seeds.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("position", "seed", "n_tokens").cast("decimal(38,0)")).alias("h"))
    classes = whole.groupBy("n", "h").agg(F.min("id").alias("_id")).select("_id")
    item_seeds = item_seeds.join(classes, F.col("id") == F.col("_id"), "left_semi")
    item_seeds = item_seeds.select(F.col("id").alias("item"), F.col("n_tokens").alias("n_item"), F.col("position").alias("item_at"), "seed")
    bits = spark.sparkContext.broadcast(_in_use(item_seeds))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    found = _seed_rows(rows, min_tile, bits).select("id", F.col("position").alias("doc_at"), "seed")
    shared = found.join(item_seeds, "seed").select("id", "item", "n_item", "doc_at", "item_at")
    shared = materialize(shared, "seeds")
    # A seed covers at most ``min_tile`` words of the item: pairs that cannot reach the threshold end here.
    able = shared.groupBy("id", "item", "n_item").agg(F.countDistinct("item_at").alias("m"))
    able = able.where(F.col("m") * F.lit(min_tile) >= F.lit(coverage) * F.col("n_item")).select(F.col("id").alias("_i"), F.col("item").alias("_j"))
    pairs = shared.join(able, (F.col("id") == F.col("_i")) & (F.col("item") == F.col("_j")), "left_semi")

    def tiles_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("id", "item", "n_item", "doc_at", "item_at")
        held = np.zeros((0, 5), np.int64)
        for batch in chain(batches, [None]):
            if batch is not None:
                held = np.concatenate([held, np.stack([batch.column(c).to_numpy() for c in names], axis=1)])
            if not len(held):
                continue
            change = np.flatnonzero((np.diff(held[:, 0]) != 0) | (np.diff(held[:, 1]) != 0)) + 1
            bounds = np.concatenate([[0], change, [len(held)]])
            if batch is not None:
                bounds = bounds[:-1]  # the last pair may go on
            out = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                got = tile(held[a:b, 3], held[a:b, 4], int(held[a, 2]), min_tile)
                out.append((*held[a, :3].tolist(), sum(n for _, _, n in got), len(got)))
            held = held[bounds[-1] :]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "item", "n_item", "covered", "n_tiles"])

    pairs = pairs.select("id", "item", "n_item", "doc_at", "item_at").repartition("id", "item").sortWithinPartitions("id", "item", "doc_at", "item_at")
    tiled = pairs.mapInArrow(tiles_of, "id long, item long, n_item long, covered long, n_tiles long")
    share = (F.col("covered") / F.col("n_item")).alias("coverage")
    return tiled.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_item", "covered", "n_tiles", share).where(F.col("coverage") >= coverage)
