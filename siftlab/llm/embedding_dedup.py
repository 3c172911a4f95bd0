"""Near-duplicate vectors: coarse lists, residual product codes, table-lookup distances, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from siftlab.llm.components import components
from siftlab.llm.selection import thinned
from siftlab.session import materialize

MIN_COSINE = 0.98
SAMPLE = 20_000
LIST_SIZE = 256  # vectors wanted per coarse list
MAX_LISTS = 1024
SUBSPACES = 8
CODEWORDS = 64
# Queries that a task compares with the lists of its cell at once.
LIST_BLOCK = 4096
# Bytes of the vectors that are members of one cell, which its task holds.
CELL_BYTES = 128 * 1024 * 1024
# Vectors of a cell at least, and cells that a label is split into for the sake of cores only.
CELL_ROWS, SPARE_CELLS = 4096, 4
# Looked-up distances that are held at once, and queries among them; linked pairs that are gathered before they are counted.
AREA, WIDE, PAIRS = 1 << 17, 512, 1 << 18
# Buckets of nodes that tell apart vectors given once.
BUCKETS = 1 << 20
_SLACK, _ROUNDING = 1e-4, 1e-12
# The place of a query among the rows of a cell is above that of any member's list.
_QUERY = 1 << 20


def lloyd(points: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """At most ``k`` centres of the points; empty centres are dropped."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(points, axis=0)
    centres = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        near = nearest(points, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres = total[count > 0] / count[count > 0][:, None]
    return centres


def squared(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (points * points).sum(1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(1)[None]
    return np.maximum(d, 0)


def nearest(points: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    parts = [squared(points[i : i + block], centres).argmin(1) for i in range(0, len(points), block)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


@dataclass(frozen=True)
class Quantiser:
    """Coarse centres, and codewords for each subspace of the residuals."""

    centres: np.ndarray
    books: list[np.ndarray]
    radius: float  # largest distance of two linked unit vectors

    @staticmethod
    def fit(sample: np.ndarray, n_lists: int, min_cosine: float) -> "Quantiser":
        centres = lloyd(sample, n_lists)
        rest = sample - centres[nearest(sample, centres)]
        books = [lloyd(part, CODEWORDS) for part in np.array_split(rest, min(SUBSPACES, sample.shape[1]), axis=1)]
        return Quantiser(centres, books, float(np.sqrt(max(0.0, 2 - 2 * min_cosine))) + _SLACK)

    def encode(self, unit: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, error): the codes of the residuals, and how far each decoded vector is from its own."""
        rest = unit - self.centres[lists]
        codes, far = [], np.zeros(len(unit))
        for part, book in zip(np.array_split(rest, len(self.books), axis=1), self.books, strict=True):
            code = nearest(part, book)
            codes.append(code.astype(np.uint8))
            far += ((part - book[code]) ** 2).sum(1)
        return np.stack(codes, axis=1), np.sqrt(far)

    def probes(self, unit: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list): every list that can hold a vector within the radius of the row's.

        Such a vector lies in the list's cell, so the ball around the row crosses the half-space
        nearer to that centre than to the row's own: d(x, c)^2 - d(x, own)^2 <= 2 r d(c, own).
        """
        return np.nonzero(self.meets(unit, lists, np.arange(len(self.centres)))[0])

    def meets(self, unit: np.ndarray, lists: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row and list of ``other``: whether the row must look there, and its squared distance to the centre in 16 bits."""
        meet, far = np.zeros((len(unit), len(other)), bool), np.zeros((len(unit), len(other)), np.int16)
        for at in range(0, len(unit), 1024):
            to, mine = squared(unit[at : at + 1024], self.centres[other]), lists[at : at + 1024]
            own = ((unit[at : at + 1024] - self.centres[mine]) ** 2).sum(1)
            meet[at : at + 1024] = to - own[:, None] <= 2 * self.radius * self.apart[np.ix_(mine, other)] + _SLACK
            far[at : at + 1024] = self.whole(to)
        return meet, far

    @cached_property
    def apart(self) -> np.ndarray:
        """Distances of the centres."""
        return np.sqrt(squared(self.centres, self.centres))

    @cached_property
    def offsets(self) -> np.ndarray:
        """First row of each subspace in the tables."""
        return np.cumsum([0, *(len(book) for book in self.books)])

    @cached_property
    def scale(self) -> float:
        """Looked-up values are whole numbers of 16 bits in this scale, which no sum of them leaves."""
        return 32000 / (4 + 2 * float(np.sqrt(sum((book * book).sum(1).max() for book in self.books))))

    def whole(self, values: np.ndarray) -> np.ndarray:
        return np.rint(self.scale * values).astype(np.int16)

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """Twice the products of all codewords with the parts of each query, a column per query.

        With a member's centre c and decoded residual b, the squared distance is
        d(x, c)^2 + 2 c.b + b.b - 2 x.b: what depends on query and codeword is looked up here,
        whatever the list, and the rest is known per member or per query and list.
        """
        parts = zip(self.books, np.array_split(unit, len(self.books), axis=1), strict=True)
        return np.concatenate([self.whole(2 * book @ part.T) for book, part in parts])

    def limits(self, lists: np.ndarray, codes: np.ndarray, error: np.ndarray) -> np.ndarray:
        """What lookups less the squared distance to the centre must reach for a vector within the radius, with all rounding."""
        far = (self.radius + error + _SLACK) ** 2 + _SLACK
        for k, centre in enumerate(np.array_split(self.centres[lists], len(self.books), axis=1)):
            word = self.books[k][codes[:, k]]
            far -= ((2 * centre + word) * word).sum(1)
        return np.clip(np.floor(-self.scale * far) - len(self.books) - 1, -32768, 32767).astype(np.int16)


def scaled(values: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision of finite vectors that are not zero."""
    values = values.astype(np.float64)
    values = values / np.abs(values).max(axis=1)[:, None]
    return values / np.sqrt((values * values).sum(1))[:, None]


def usable(column: pa.ListArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors as given) of the vectors of ``width`` finite numbers that are not zero."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == width)
    if not len(rows) or not width:
        return rows[:0], np.zeros((0, max(width, 1)))
    flat = column.take(pa.array(rows)).flatten()
    flat = flat if pa.types.is_float32(flat.type) else flat.cast(pa.float64())
    values = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False).reshape(-1, width)
    with np.errstate(all="ignore"):
        fine = np.isfinite(values).all(axis=1) & (np.abs(values).max(axis=1) > 0)
    return rows[fine], values[fine]


@dataclass(frozen=True)
class Cells:
    """The cells in which vectors meet: a task each, with members and, where a label is split, queries of other cells.

    Labels of few vectors share the first ``loose`` cells by hash, others have cells of their own.
    A label with too many for one is split by lists, a list with too many by node. A query goes once to
    a cell, however many of its lists it probes, and each pair of cells meets in one of the two only:
    no vector travels to more than half of its label's cells.
    """

    loose: int
    rows: int  # most members of one label in a cell
    labels: np.ndarray  # with cells of their own, in order
    first: np.ndarray  # cell of each
    lists: dict[int, tuple[np.ndarray, np.ndarray, int]]  # per split label: first cell and parts of each list, cells

    @property
    def count(self) -> int:
        return self.loose + len(self.labels) + sum(n - 1 for _, _, n in self.lists.values())

    @staticmethod
    def plan(total: int, sizes: list[tuple[int, int]], split: dict[int, int], members: dict[int, np.ndarray], order: np.ndarray, target: int) -> "Cells":
        """``sizes``: (label, vectors) of the labels with own cells; ``split``: cells wanted; ``members``: vectors by list."""
        loose = max(1, -(-(total - sum(n for _, n in sizes)) // target))
        first, lists, most, at = [], {}, target, loose
        for label, n in sizes:
            first.append(at)
            if label not in split:
                most, at = max(most, n), at + 1
                continue
            room, left = -(-n // split[label]), n
            begin, parts, cell, filled = np.zeros(len(order), np.int64), np.ones(len(order), np.int64), 0, 0
            for i in order.tolist():
                size = int(members[label][i])
                if filled and (2 * size > room or 2 * filled + size > 2 * room and 8 * left > room):
                    cell, filled = cell + 1, 0
                begin[i], filled, left = cell, filled + size, left - size
                if 2 * size > room:
                    parts[i] = -(-size // room)
                    most, cell, filled = max(most, -(-size // int(parts[i]))), cell + int(parts[i]), 0
                most = max(most, filled)
            cells = cell + bool(filled) or 1
            lists[label] = np.minimum(begin, cells - 1), parts, cells
            at += cells
        return Cells(loose, most, np.array([x for x, _ in sizes], np.int64), np.array(first, np.int64), lists)

    def places(self, quantiser: Quantiser, label: np.ndarray, node: np.ndarray, lists: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(own cell of each row, and (row, cell) of the queries)."""
        mixed = label.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
        home = (mixed % np.uint64(self.loose)).astype(np.int64)
        if len(self.labels):
            i = np.minimum(np.searchsorted(self.labels, label), len(self.labels) - 1)
            home = np.where(self.labels[i] == label, self.first[i], home)
        row, cell = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in np.intersect1d(label, np.array(list(self.lists), np.int64)).tolist():
            begin, parts, cells = self.lists[x]
            at = np.flatnonzero(label == x)
            first = int(home[at[0]])
            own = begin[lists[at]] + node[at] % parts[lists[at]]
            holds = (begin[:, None] <= np.arange(cells)) & (np.arange(cells) < (begin + parts)[:, None])
            probe = np.zeros((len(at), len(begin)), np.float32)
            probe[quantiser.probes(unit[at], lists[at])] = 1
            ahead = (np.arange(cells)[None] - own[:, None]) % cells
            goes = (2 * ahead < cells) | (2 * ahead == cells) & (own[:, None] < np.arange(cells))
            a, b = np.nonzero((probe @ holds.astype(np.float32) > 0) & goes & (ahead > 0))
            home[at] = first + own
            row.append(at[a])
            cell.append(first + b)
        return home, np.concatenate(row), np.concatenate(cell)


def near_order(centres: np.ndarray) -> np.ndarray:
    """The centres' numbers, near ones together: halved again and again across the longest axis."""

    def halved(at: np.ndarray) -> list[np.ndarray]:
        if len(at) < 3:
            return [at]
        rest = centres[at] - centres[at].mean(0)
        at = at[np.argsort(rest @ np.linalg.svd(rest, full_matrices=False)[2][0], kind="stable")]
        return halved(at[: len(at) // 2]) + halved(at[len(at) // 2 :])

    return np.concatenate(halved(np.arange(len(centres))))


def _slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, pa.Array, np.ndarray]]:
    """(rows, numbers of the usable ones, their vectors), some 2,000 at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            kept, raw = usable(part.column("embedding"), width)
            if len(kept):
                yield part, pa.array(kept), raw


def _blobs(values: np.ndarray) -> pa.Array:
    """A binary value per row."""
    values = np.ascontiguousarray(values)
    ends = np.arange(len(values) + 1, dtype=np.int32) * (values.itemsize * values.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(values)])


def _listed(rows: DataFrame, quantiser, width: int) -> DataFrame:
    """Label, node and list of usable vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, kept, raw in _slices(batches, width):
            lists = nearest(scaled(raw), quantiser.value.centres)
            yield pa.RecordBatch.from_arrays([part.column("label").take(kept), part.column("node").take(kept), pa.array(lists)], names=["label", "node", "list"])

    return rows.mapInArrow(run, "label int, node long, list long")


def _indexed(rows: DataFrame, quantiser, cells, width: int) -> DataFrame:
    """Per vector its row as a member of its own cell, and as a query of every other cell it must be looked for in.

    ``place`` is the list, above ``_QUERY`` for queries. Vectors travel in the precision they are given in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, c = quantiser.value, cells.value
        for part, kept, raw in _slices(batches, width):
            unit = scaled(raw)
            lists = nearest(unit, q.centres)
            label, node = (part.column(x).take(kept).to_numpy().astype(np.int64) for x in ("label", "node"))
            home, row, cell = c.places(q, label, node, lists, unit)
            everything = np.concatenate([np.arange(len(label)), row])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([home, cell]), pa.int32()), pa.array(label[everything]), pa.array(np.concatenate([lists, _QUERY + lists[row]])),
                    pa.array(node[everything]), part.column("n").take(kept).take(pa.array(everything)), _blobs(raw[everything]),
                ],
                names=["cell", "label", "place", "node", "n", "vector"],
            )

    return rows.mapInArrow(run, "cell int, label long, place long, node long, n long, vector binary")


class Members:
    """The members of one label in a cell, in order of their lists, and what is linked with them so far."""

    def __init__(self, quantiser: Quantiser, min_cosine: float, lists: np.ndarray, node: np.ndarray, n: np.ndarray, raw: np.ndarray):
        self.q, self.min_cosine, self.lists, self.node, self.n, self.raw = quantiser, min_cosine, lists, node, n, raw
        self.codes, self.limit = np.zeros((len(node), len(quantiser.books)), np.uint8), np.zeros(len(node), np.int16)
        for at in range(0, len(node), 2000):
            own = lists[at : at + 2000]
            codes, error = quantiser.encode(scaled(raw[at : at + 2000]), own)
            self.codes[at : at + 2000] = codes
            self.limit[at : at + 2000] = quantiser.limits(own, codes, error)
        self.present, self.begins, self.number = np.unique(lists, return_index=True, return_inverse=True)
        self.ends = np.append(self.begins[1:], len(lists))
        self.held = np.zeros((2, max(AREA, WIDE)), np.int16)
        self.root, self.others = np.arange(len(node)), np.zeros(len(node), np.int64)

    def _matches(self, lists: np.ndarray, unit: np.ndarray, own: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(row of the block, member) of linked pairs: table lookups first, then exact cosines.

        ``own`` is the number of the first row if the block is a run of the members: pairs are found once then.
        """
        meet, far = self.q.meets(unit, lists, self.present)
        if own is not None:
            meet &= lists[:, None] <= self.present
        words = self.q.offsets[-1]
        tables = np.concatenate([self.q.tables(unit), -far.T])
        across = np.ascontiguousarray(tables[:words].T)
        # Cutting a few queries out of the tables pays for a long list only; else all are compared, with runs of lists at once.
        asked, sizes = meet.sum(0), self.ends - self.begins
        cut = asked * (words + sizes) < len(unit) * sizes
        for j in np.flatnonzero(cut & (asked > 0)).tolist():
            for rows in _parts(np.flatnonzero(meet[:, j]), WIDE):
                some = np.empty((words + 1, len(rows)), np.int16)
                some[:words], some[words] = across[rows].T, tables[words + j, rows]
                yield from self._compared(unit, rows, some, int(self.begins[j]), int(self.ends[j]), own, False)
        whole = np.flatnonzero(~cut & (asked > 0))
        first = np.flatnonzero(np.diff(whole, prepend=-2) != 1)
        runs = list(zip(self.begins[whole[first]].tolist(), self.ends[whole[np.append(first[1:], len(whole)) - 1]].tolist(), strict=True)) if len(whole) else []
        for rows in _parts(np.arange(len(unit)), WIDE) if runs else []:
            some = np.ascontiguousarray(tables[:, rows[0] : rows[-1] + 1])
            for begin, end in runs:
                yield from self._compared(unit, rows, some, begin, end, own, True)

    def _compared(self, unit: np.ndarray, rows: np.ndarray, tables: np.ndarray, begin: int, end: int, own: int | None, runs: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Some rows against the members from ``begin`` to ``end``, of several lists or of one."""
        begin, step = begin if own is None else max(begin, own + int(rows[0]) + 1), max(1, AREA // len(rows))
        for a in range(begin, end, step):
            b = min(a + step, end)
            near, more = (x[: (b - a) * len(rows)].reshape(b - a, len(rows)) for x in self.held)
            coarse = self.q.offsets[-1] + (self.number[a:b] if runs else np.zeros(b - a, np.intp))
            np.take(tables, coarse, axis=0, out=near, mode="clip")
            for k, offset in enumerate(self.q.offsets[:-1]):
                np.take(tables, self.codes[a:b, k] + offset, axis=0, out=more, mode="clip")
                near += more
            m, x = np.divmod(np.flatnonzero(near >= self.limit[a:b, None]), len(rows))
            if own is not None:
                later = a + m > own + rows[x]
                m, x = m[later], x[later]
            if 16 * len(m) > near.size:
                yield self._dense(unit, rows, a, b, m, x)
            else:
                yield from self._exact(unit, rows[x], a + m)

    def _exact(self, unit: np.ndarray, x: np.ndarray, m: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(x), 1 << 14):
            i, j = x[at : at + (1 << 14)], m[at : at + (1 << 14)]
            close = np.einsum("ij,ij->i", unit[i], scaled(self.raw[j])) >= self.min_cosine
            yield i[close], j[close]

    def _dense(self, unit: np.ndarray, rows: np.ndarray, a: int, b: int, m: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same where most pairs are candidates: products of whole blocks, single ones where rounding could decide."""
        cosine = np.concatenate([scaled(self.raw[i : min(i + 2000, b)]) @ unit[rows].T for i in range(a, b, 2000)])[m, x]
        sure, doubtful = cosine >= self.min_cosine + _ROUNDING, np.abs(cosine - self.min_cosine) < _ROUNDING
        more = list(self._exact(unit, rows[x[doubtful]], a + m[doubtful]))
        return np.concatenate([rows[x[sure]], *(i for i, _ in more)]), np.concatenate([a + m[sure], *(j for _, j in more)])

    def _gathered(self, lists: np.ndarray, unit: np.ndarray, own: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, n = [], 0
        for x, m in chain(self._matches(lists, unit, own), [(None, None)]):
            if x is not None:
                held, n = [*held, (x, m)] if len(x) else held, n + len(x)
            if held and (x is None or n >= PAIRS):
                yield tuple(np.concatenate(y) for y in zip(*held, strict=True))
                held, n = [], 0

    def among(self) -> None:
        """Links of the members with each other."""
        for at in range(0, len(self.node), LIST_BLOCK):
            for x, m in self._gathered(self.lists[at : at + LIST_BLOCK], scaled(self.raw[at : at + LIST_BLOCK]), at):
                self._add(at + x, self.n[m])
                self._add(m, self.n[at + x])
                self._join(at + x, m)

    def ask(self, lists: np.ndarray, node: np.ndarray, n: np.ndarray, raw: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Links of queries with the members; an edge of each linked query with one member."""
        for at in range(0, len(node), LIST_BLOCK):
            asked, times = node[at : at + LIST_BLOCK], n[at : at + LIST_BLOCK]
            one, others = np.full(len(asked), -1), np.zeros(len(asked), np.int64)
            for x, m in self._gathered(lists[at : at + LIST_BLOCK], scaled(raw[at : at + LIST_BLOCK]), None):
                np.add.at(others, x, self.n[m])
                self._add(m, times[x])
                free, i = np.unique(x, return_index=True)
                one[free] = np.where(one[free] < 0, m[i], one[free])
                self._join(one[x], m)
            found = one >= 0
            yield _edges(asked[found], self.node[one[found]])
            yield _counts(asked[found], others[found])

    def _add(self, m: np.ndarray, n: np.ndarray) -> None:
        np.add.at(self.others, m, n)

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            high, i = np.unique(high, return_index=True)
            self.root[high] = low[i]
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up

    def linked(self) -> Iterator[pa.RecordBatch]:
        """Edges of all members with the least node of their group here, and counts."""
        least = np.full(len(self.node), np.iinfo(np.int64).max)
        np.minimum.at(least, self.root, self.node)
        least = least[self.root]
        yield _edges(self.node[least != self.node], least[least != self.node])
        yield _counts(self.node[self.others > 0], self.others[self.others > 0])


def _parts(rows: np.ndarray, size: int) -> list[np.ndarray]:
    return [rows[at : at + size] for at in range(0, len(rows), size)]


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "others"])


def _counts(a: np.ndarray, others: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(others)], names=["a", "b", "others"])


def _links(index: DataFrame, quantiser, cells, n_cells: int, width: int, kind: type, min_cosine: float) -> DataFrame:
    """(a, b) of edges that join all linked nodes, and (a, others) with rows linked to node a.

    One task per cell holds its members; queries pass by. Pairs are counted and joined where they are
    found, so a group of many near vectors gives as many rows as it has vectors, not pairs.
    """
    rows = index.repartitionById(n_cells, F.col("cell")).sortWithinPartitions("cell", "label", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, room = quantiser.value, cells.value.rows
        held, raw, here, members = [], np.zeros((room, width), kind), None, None
        for batch in chain(batches, [None]):
            keys = np.zeros((0, 3), np.int64) if batch is None else np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("cell", "label", "place")], axis=1)
            kinds = np.column_stack([keys[:, :2], keys[:, 2] >= _QUERY])
            cuts = np.flatnonzero((np.diff(kinds, axis=0) != 0).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True) if len(keys) else [(0, 0)] * (batch is None):
                now = tuple(kinds[a].tolist()) if b else None
                if held and now != here:  # all members of the cell and label have come
                    lists, node, n = (np.concatenate(x) for x in zip(*held, strict=True))
                    held = []
                    if len(node) > 1 or now is not None and now[:2] == here[:2]:
                        members = Members(q, min_cosine, lists, node, n, raw[: len(node)])
                        members.among()
                if members is not None and (now is None or now[:2] != here[:2]):
                    yield from members.linked()
                    members = None
                if now is None:
                    break
                part, here = batch.slice(a, b - a), now
                vectors = np.frombuffer(b"".join(part.column("vector").to_pylist()), kind).reshape(-1, width)
                own = keys[a:b, 2] % _QUERY, part.column("node").to_numpy(), part.column("n").to_numpy()
                if not here[2]:
                    begin = sum(len(x[1]) for x in held)
                    if begin + len(vectors) > len(raw):
                        raw = np.concatenate([raw, np.zeros((max(len(vectors), len(raw)), width), kind)])
                    raw[begin : begin + len(vectors)] = vectors
                    held.append(own)
                elif members is not None:
                    yield from members.ask(*own, vectors)

    return rows.mapInArrow(run, "a long, b long, others long")


def _once(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(label, node, n, embedding) of each node once. Only vectors in a bucket with a node given twice are shuffled for that."""
    bucket = F.pmod("node", F.lit(BUCKETS))
    twice = materialize(nodes.where("n > 1").select(bucket.cast("int").alias("_bucket")).distinct(), "twice")
    if twice.isEmpty():
        return rows.select("label", "node", F.lit(1).cast("long").alias("n"), "embedding")
    twice, same = F.broadcast(twice), bucket.cast("int") == F.col("_bucket")
    again = rows.join(twice, same, "left_semi").groupBy("node").agg(
        F.first("label").alias("label"), F.count(F.lit(1)).alias("n"), F.first("embedding").alias("embedding")
    )
    once = rows.join(twice, same, "left_anti").select("label", "node", F.lit(1).cast("long").alias("n"), "embedding")
    return once.unionByName(materialize(again, "repeated"))


def _cells(given: DataFrame, nodes: DataFrame, n_good: int, quantiser, width: int, room: int) -> Cells:
    """Cells of ``room`` vectors at most. Labels are split further to keep cores busy, but only as far as few copies of a vector travel.

    The driver sees labels with at least an eighth of a cell, and the list sizes of split ones.
    """
    target = min(room, max(CELL_ROWS, -(-n_good // (2 * given.sparkSession.sparkContext.defaultParallelism))))
    sizes = nodes.groupBy("label").count().where(F.col("count") > target // 8).orderBy("label")
    sizes = [tuple(map(int, r)) for r in sizes.toPandas().to_numpy()]
    split = {label: n for label, size in sizes if (n := max(-(-size // room), min(SPARE_CELLS, size // target))) > 1}
    members = {label: np.zeros(len(quantiser.value.centres), np.int64) for label in split}
    if split:
        listed = _listed(given.where(F.col("label").isin(list(split))), quantiser, width).distinct().groupBy("label", "list").count()
        for label, number, count in listed.toPandas().to_numpy():
            members[int(label)][number] = count
    return Cells.plan(n_good, sizes, split, members, near_order(quantiser.value.centres), target)


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", min_cosine: float = MIN_COSINE,
    sample: int = SAMPLE,
) -> DataFrame:
    """(id, n_links, component_id, kept) per row.

    Rows of equal label (not null) are linked if their cosine is at least ``min_cosine``. Equal
    vectors of a label are one node. Nodes stand in the list of their nearest centre with
    product codes of their residuals; a query probes every list whose cell its ball can meet,
    and members whose table-lookup distance, less their own coding error, is within the radius
    are compared exactly, so no pair is lost. Centres and codewords are fitted to at most
    ``sample`` vectors chosen by hash; every row is indexed. Vectors that are null, empty,
    zero, of another length than most, or hold null or non-finite numbers link with nothing.
    Rows of equal id are separate rows. A null id counts as a link of others; its component is
    the smallest id reachable. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("int").alias("label"))
    widths = rows.where(F.size("embedding") > 0).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = widths["n"] if widths else 0
    node = F.xxhash64("label", "embedding", F.xxhash64("embedding", "label"))
    rows = rows.withColumn("node", F.when(F.col("label").isNotNull() & (F.size("embedding") == width), node))

    def valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, _ = usable(batch.column("embedding"), width)
            at = np.full(batch.num_rows, -1)
            at[kept] = kept
            node = batch.column("node").take(pa.array(at, mask=at < 0))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), node], names=["id", "label", "node"])

    # Vectors themselves are written nowhere: they are read again where they are needed.
    marked = materialize(rows.mapInArrow(valid, "id long, label int, node long"), "vectors")
    nodes = marked.where("node is not null").groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    nodes = materialize(nodes, "nodes")
    n_good = nodes.count()
    if not n_good:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    given = _once(rows.where("node is not null").select("label", "node", "embedding"), nodes)
    chosen = given.where(thinned(F.col("node"), sample, n_good)).mapInArrow(
        lambda batches: (part.select(["node", "embedding"]).take(kept) for part, kept, _ in _slices(batches, width)), given.select("node", "embedding").schema
    )
    chosen = chosen.orderBy("node").limit(sample).select("embedding").toPandas()
    points = scaled(np.stack([np.asarray(v, np.float64) for v in chosen["embedding"]]))
    n_lists = max(1, min(MAX_LISTS, n_good // LIST_SIZE, len(points) // 8))
    quantiser = spark.sparkContext.broadcast(Quantiser.fit(points, n_lists, min_cosine))
    kind = np.float32 if isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    plan = _cells(given, nodes, n_good, quantiser, width, max(1, CELL_BYTES // (width * np.dtype(kind).itemsize)))
    cells = spark.sparkContext.broadcast(plan)
    index = _indexed(given, quantiser, cells, width)
    links = materialize(_links(index, quantiser, cells, plan.count, width, kind, min_cosine), "links")
    linked = links.where("b is null").groupBy("a").agg(F.sum("others").alias("others")).withColumnRenamed("a", "_a")
    tree = materialize(components(links.where("b is not null").select("a", "b")), "roots").select(F.col("id").alias("_m"), "root")
    rooted = nodes.select("node", "n", "least").join(tree, F.col("node") == F.col("_m"), "left").join(linked, F.col("node") == F.col("_a"), "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    reach = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(reach, "root").select(F.col("node").alias("_node"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    out = marked.select("id", "node").join(named, F.col("node") == F.col("_node"), "left")
    component = F.when(F.col("_node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
