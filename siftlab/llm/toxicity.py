"""Toxicity from class-conditional Kneser-Ney models of spelling with shared backoff counts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from siftlab.llm.selection import thinned
from siftlab.llm.words import LOWER, ByteHashes, as_texts, bounded, concat_ranges, range_sums, slices, text_bytes, word_ranges
from siftlab.session import materialize

ORDER = 6  # bytes of the longest gram
BUCKET_BITS = 20  # grams are counted in this many hash buckets, so the model has a fixed size
DISCOUNT = 0.75
WINDOW = 64
STRONG = 3.0
THRESHOLD = 0.7
CALIBRATION_ROWS = 50_000
BROADCAST_LABELS = 2_000_000
_CLIP = 12.0
_UNFITTED = np.array([0.0, 0.5, 1.0, 1.0, 0.0, -4.0])  # where no calibration row can be had
_KNOWN_WORDS = 200_000
_START, _END = 1, 2
_BUCKETS = 1 << BUCKET_BITS

_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:!?\"'()[]{}*#%$&-_/"]] = True


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first word per text): lower-cased words without outer punctuation."""
    data, offsets = text_bytes(texts)
    data = LOWER[data]
    starts, ends, first = word_ranges(data, offsets)
    for _ in range(3):
        starts = starts + ((ends - starts > 1) & _PUNCT[data[starts]])
        ends = ends - ((ends - starts > 1) & _PUNCT[data[ends - 1]])
    return data, starts, ends, first


def padded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the words one after another, each between a start and an end mark."""
    length = ends - starts
    offsets = np.concatenate([[0], np.cumsum(length + 2)])
    out = np.empty(int(offsets[-1]), np.uint8)
    out[offsets[:-1]] = _START
    out[offsets[1:] - 1] = _END
    out[concat_ranges(offsets[:-1] + 1, length)] = data[concat_ranges(starts, length)]
    return out, offsets


class Grams:
    """Buckets of the grams and contexts that end at each byte behind the start marks."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        inside = np.ones(len(data), bool)
        inside[offsets[:-1]] = False
        self.at = np.flatnonzero(inside)
        self.word = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets) - 1)
        self.depth = self.at - offsets[:-1][self.word]
        self.hashes = ByteHashes(data)

    def bucket(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.hashes.ranges(starts, ends) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)

    def top(self) -> tuple[np.ndarray, np.ndarray]:
        """The longest gram at each byte, and its context."""
        start = self.at - np.minimum(self.depth, ORDER - 1)
        return self.bucket(start, self.at + 1), self.bucket(start, self.at)

    def lower(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, grams, contexts) of the n-grams that are shorter than the longest of their byte."""
        rows = np.flatnonzero(np.minimum(self.depth, ORDER - 1) + 1 > n)
        at = self.at[rows]
        return rows, self.bucket(at - n + 1, at + 1), self.bucket(at - n + 1, at)


def _bit(values: np.ndarray) -> np.ndarray:
    return np.uint64(1) << (values & 63).astype(np.uint64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fold, word, toxic, ordinary) per slice and fold of labelled texts."""
    for piece in slices(batches, "text"):
        folds = piece.column("fold").to_numpy()
        for fold in np.unique(folds).tolist():
            yield _counted(piece.filter(pa.array(folds == fold)), fold)


def _counted(piece: pa.RecordBatch, fold: int) -> pa.RecordBatch:
    data, starts, ends, first = plain_words(as_texts(piece.column("text")))
    codes, unique = pd.factorize(ByteHashes(data).ranges(starts, ends))
    label = np.repeat(piece.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(first))
    toxic = np.bincount(codes, weights=label, minlength=len(unique)).astype(np.int64)
    total = np.bincount(codes, minlength=len(unique))
    place = np.zeros(len(unique), np.int64)
    place[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    raw = data.tobytes()
    words = [raw[a:b] for a, b in zip(starts[place].tolist(), ends[place].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(words), fold, np.int32)), pa.array(words, pa.binary()), pa.array(toxic), pa.array(total - toxic)],
        names=["fold", "word", "toxic", "ordinary"],
    )


_TABLE = ("context", "left", "follow", "toxic", "ordinary", "toxic_all", "ordinary_all", "toxic_follow", "ordinary_follow")


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts per fold and bucket of all words of the task, which come by fold; one row for each at most."""
    now, table = None, {}
    for piece in slices(batches, "word"):
        folds = piece.column("fold").to_numpy()
        for fold in np.unique(folds).tolist():
            if fold != now:
                yield from _used_rows(now, table)
                table = {c: np.zeros(_BUCKETS, np.uint64 if c.endswith(("left", "follow")) else np.int64) for c in _TABLE}
                table["context"] -= 1
                now = fold
            _add_words(table, piece.filter(pa.array(folds == fold)))
    yield from _used_rows(now, table)


def _used_rows(fold: int | None, table: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    if fold is None:
        return
    kept = np.zeros(_BUCKETS, bool)
    for c in _TABLE[1:]:
        kept |= table[c] != 0
    used = np.flatnonzero(kept)
    for start in range(0, len(used), 1 << 16):
        at = used[start : start + (1 << 16)]
        columns = [pa.array(np.full(len(at), fold, np.int32)), pa.array(at), *(pa.array(table[c][at].view(np.int64)) for c in _TABLE)]
        yield pa.RecordBatch.from_arrays(columns, names=["fold", "bucket", *_TABLE])


def _add_words(table: dict[str, np.ndarray], words: pa.RecordBatch) -> None:
    data, offsets = text_bytes(words.column("word").cast(pa.large_binary()))
    grams = Grams(*padded(data, offsets[:-1], offsets[1:]))
    gram, context = grams.top()
    follow = _bit(grams.data[grams.at])
    for name in ("toxic", "ordinary"):
        weight = words.column(name).to_numpy().astype(np.float64)[grams.word]
        table[name] += np.bincount(gram, weights=weight, minlength=_BUCKETS).astype(np.int64)
        table[f"{name}_all"] += np.bincount(context, weights=weight, minlength=_BUCKETS).astype(np.int64)
        own = weight > 0
        np.bitwise_or.at(table[f"{name}_follow"], context[own], follow[own])
    for n in range(1, ORDER):
        rows, gram, context = grams.lower(n)
        np.bitwise_or.at(table["left"], gram, _bit(grams.data[grams.at[rows] - n]))
        np.bitwise_or.at(table["follow"], context, follow[rows])
        table["context"][gram] = np.maximum(table["context"][gram], context)


@dataclass(frozen=True)
class SpellingModel:
    """Discounted counts per bucket; every array has one entry for each bucket."""

    shared: np.ndarray  # discounted continuation counts of grams
    shared_scale: np.ndarray  # by context: 1 / sum of continuation counts
    shared_rest: np.ndarray  # by context: probability left for the shorter context
    own: tuple[np.ndarray, np.ndarray]  # discounted counts of the longest grams: toxic, ordinary
    own_scale: tuple[np.ndarray, np.ndarray]
    own_rest: tuple[np.ndarray, np.ndarray]

    @staticmethod
    def of(table: dict[str, np.ndarray], part: str) -> "SpellingModel":
        """The model of one part of the counted table (columns ending in ``part``)."""

        def parts(count, total, kinds):
            scale = np.divide(1, total, out=np.zeros(_BUCKETS, np.float32), where=total > 0)
            rest = np.where(total > 0, np.minimum(1, np.float32(DISCOUNT) * np.maximum(kinds, 1) * scale), np.float32(1))
            return np.maximum(count - np.float32(DISCOUNT), 0), scale, rest.astype(np.float32)

        left, context = table[f"left_{part}"], table["context"]
        used = np.flatnonzero(context >= 0)
        total = np.bincount(context[used], weights=left[used], minlength=_BUCKETS).astype(np.float32)
        shared = parts(left.astype(np.float32), total, table[f"follow_{part}"])
        own = [parts(*(table[f"{c}{end}_{part}"] for end in ("", "_all", "_follow"))) for c in ("toxic", "ordinary")]
        return SpellingModel(*shared, *[tuple(p[k] for p in own) for k in range(3)])

    def word_ratios(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        if not len(starts):
            return np.zeros(0)
        grams = Grams(*padded(data, starts, ends))
        p = np.full(len(grams.at), 1.0 / 256)
        for n in range(1, ORDER):
            rows, gram, context = grams.lower(n)
            p[rows] = self.shared[gram] * self.shared_scale[context] + self.shared_rest[context] * p[rows]
        gram, context = grams.top()
        toxic, ordinary = (self.own[k][gram] * self.own_scale[k][context] + self.own_rest[k][context] * p for k in (0, 1))
        ratio = np.bincount(grams.word, weights=np.log(toxic / ordinary), minlength=len(starts))
        return np.clip(ratio, -_CLIP, _CLIP)


class Scorer:
    """Features of texts under a model; ratios of known words are kept in a bounded table."""

    def __init__(self, model: SpellingModel):
        self.model = model
        self.known: dict[int, float] = {}

    def features(self, texts: pa.Array) -> np.ndarray:
        """Per text: the mean ratio per word; what words have over ``STRONG`` in the best window, and
        over the root and the number of words; the log of the words. A word counts once in a text."""
        data, starts, ends, first = plain_words(texts)
        codes, unique = pd.factorize(ByteHashes(data).ranges(starts, ends))
        keys = unique.tolist()
        if len(self.known) > _KNOWN_WORDS:
            self.known.clear()
        missing = [i for i, k in enumerate(keys) if k not in self.known]
        if missing:
            place = np.zeros(len(keys), np.int64)
            place[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            at = place[missing]
            ratios = self.model.word_ratios(data, starts[at], ends[at])
            self.known.update(zip([keys[i] for i in missing], ratios.tolist(), strict=True))
        ratio = np.fromiter(map(self.known.__getitem__, keys), np.float64, len(keys))[codes]
        n_words = np.diff(first)
        text = np.repeat(np.arange(len(texts)), n_words)
        again = pd.Series(text * np.int64(len(unique) or 1) + codes).duplicated().to_numpy()
        ratio[again] = 0.0
        distinct = np.bincount(text[~again], minlength=len(texts))
        strong = np.maximum(ratio - STRONG, 0)
        total = np.concatenate([[0.0], np.cumsum(strong)])
        begin = np.arange(len(ratio))
        windows = total[np.minimum(begin + WINDOW, np.repeat(first[1:], n_words))] - total[begin]
        best, full = np.zeros(len(texts)), np.flatnonzero(n_words)
        if len(full):
            best[full] = np.maximum.reduceat(windows, first[:-1][full])
        over = range_sums(strong, first)
        mean = range_sums(ratio, first) / np.maximum(distinct, 1)
        return np.stack([mean, best, over / np.sqrt(np.maximum(distinct, 1)), 10 * over / (distinct + 20), np.log1p(n_words)], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression by damped Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(penalty * w * w))

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) + penalty * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), grad)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        after = loss(w)
        if now - after < 1e-9 * max(1.0, abs(now)):
            break
        now = after
    return w


def held_out(doc_id) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(3)) == 1


def _fetch(rows: DataFrame, part: str, turns: int = 8) -> dict[str, np.ndarray]:
    """One part of the counted table as dense arrays of fixed size, read in turns so that little is held twice."""
    table = {"context": np.full(_BUCKETS, -1, np.int32)}
    for c in _TABLE[1:]:
        table[f"{c}_{part}"] = np.zeros(_BUCKETS, np.uint8 if c.endswith(("left", "follow")) else np.float32)
    for turn in range(turns):
        some = rows.where(F.shiftright("bucket", BUCKET_BITS - 3) == turn).select("bucket", *table).toArrow()
        at = some.column("bucket").to_numpy()
        for name, values in table.items():
            values[at] = pc.fill_null(some.column(name), 0).to_numpy()
    return table


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", calibration_rows: int = CALIBRATION_ROWS):
    """(model, logistic weights), or None if the labels do not have both classes.

    Rows with crc32(id) mod 3 = 1 give nothing; all others are counted, in two folds. At most
    ``calibration_rows`` of them (by id hash) turn features into a probability, each
    scored by a model of the other fold. Several labels of an id count as toxic if one is; null
    labels are none. Word counts are summed in Spark and grow with the corpus; what reaches the
    driver is one row for each of the fixed hash buckets.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    marks = marks.where(F.col("toxic").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    marks = marks.groupBy("id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")).withColumnRenamed("id", "_id")
    n_labels = labels.count()
    chosen = marks.where(thinned(F.xxhash64("_id"), calibration_rows, n_labels)).orderBy(F.xxhash64("_id", F.lit(1)), "_id")
    chosen = chosen.limit(calibration_rows).select(F.col("_id").alias("_sid"))
    if n_labels <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    marked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(marks, F.col("id") == F.col("_id"))
    marked = marked.withColumn("fold", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int"))
    words = bounded(marked.select("fold", "text", "toxic")).mapInArrow(_word_counts, "fold int, word binary, toxic long, ordinary long")
    words = words.groupBy("fold", "word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    counts = words.sortWithinPartitions("fold").mapInArrow(_gram_counts, "fold int, bucket long, " + ", ".join(f"{c} long" for c in _TABLE))
    columns = [F.max("context").alias("context")]
    for part, inside in (("0", F.col("fold") == 0), ("1", F.col("fold") == 1), ("both", F.lit(True))):
        for c in _TABLE[1:]:
            own = F.when(inside, F.col(c))
            if c.endswith(("left", "follow")):
                columns.append(F.bit_count(F.bit_or(own)).cast("tinyint").alias(f"{c}_{part}"))
            else:
                columns.append(F.sum(own).cast("float").alias(f"{c}_{part}"))
    grams = materialize(counts.groupBy("bucket").agg(*columns), "grams")
    seen = grams.agg(F.max("toxic_all_both"), F.max("ordinary_all_both")).first()
    if not seen[0] or not seen[1]:
        return None

    def ship(part: str):
        """The model of one part, held by the driver only until it is broadcast."""
        return spark.sparkContext.broadcast(SpellingModel.of(_fetch(grams, part), part))

    folds = [ship("1"), ship("0")]
    sample = marked.join(F.broadcast(chosen), F.col("id") == F.col("_sid"), "left_semi").select("text", "toxic", "fold")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = [Scorer(m.value) for m in folds]
        for piece in slices(batches, "text"):
            of = piece.column("fold").to_numpy()
            for fold in np.unique(of).tolist():
                own = piece.filter(pa.array(of == fold))
                x = scorers[fold].features(as_texts(own.column("text")))
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), own.column("toxic")], names=["x", "toxic"])

    seen = sample.mapInArrow(measure, "x array<double>, toxic int").toPandas()
    for model in folds:
        model.destroy()
    shipped = ship("both")
    y = seen["toxic"].to_numpy(np.float64)
    if len(y) < 2 or y.min() == y.max():
        return shipped, _UNFITTED
    return shipped, fit_logistic(np.stack(seen["x"].to_list()), y)


def with_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", score_col: str = "score"
) -> DataFrame:
    """All columns of ``docs`` and ``score_col``: the probability that a text is toxic.

    The score uses the text alone: spelling models of the two classes over byte grams of words
    give each word a log-likelihood ratio; their mean per word and the largest window of
    ``WINDOW`` words are calibrated to a probability. The longest grams are counted by class;
    shorter ones back off to continuation counts that both classes share. Null and empty texts
    score like texts without words; without labels of both classes all scores are 0; rows,
    ids and extra columns pass as they are; an empty table gives no rows.
    """
    trained = train(docs, labels, id_col, text_col, label_col)
    if trained is None:
        return docs.withColumn(score_col, F.lit(0.0))
    shipped, weights = trained
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for piece in slices(batches, text_col):
            z = scorer.features(as_texts(piece.column(text_col))) @ weights[:-1] + weights[-1]
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(p)], names=[*piece.schema.names, score_col])

    return docs.mapInArrow(score, schema)


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id, held_out, score, predicted) per row; see ``with_toxicity``."""
    narrow = docs.select(id_col, text_col)
    scored = with_toxicity(narrow, labels, id_col, text_col, label_col, "score")
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
