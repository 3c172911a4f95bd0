"""SimHash near-duplicates through an inverted index of fingerprint bytes with count filtering."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from siftlab.llm.components import components
from siftlab.llm.words import LOWER, SPACE, ByteHashes, as_texts, bounded, concat_ranges, mix, slices, text_bytes, word_ranges
from siftlab.session import materialize

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
# Search for copies by the Jaccard similarity of their shingles: a fingerprint holds one byte of the
# least shingle hash in each of eight orders, and texts that share ``COPY_TALLY`` bytes are compared.
COPY_SHINGLE = 5
COPY_SIMILARITY = 0.8
COPY_TALLY = 4
# Each text also carries one bit of the least hash in 128 further orders. Texts of similarity s agree in
# (1 + s) / 2 of them; at 0.8 that is 115 bits with a deviation of 3.4, so 107 are asked for.
SKETCH = ("s0", "s1")
SKETCH_BITS = 107
# Largest number of fingerprints of one posting list that a task compares at once.
LIST_BLOCK = 4096
# Shingles of one block of a loose group; larger groups are compared block by block.
BLOCK_SHINGLES = 1 << 20
_SHORT_LIST = 6
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ORDERS = np.arange(1, 17, 2, dtype=np.uint64) * _STEP
_FACTORS = np.random.default_rng(9).integers(1, 1 << 63, 64 * len(SKETCH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_ranges(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of each shingle, and the number of shingles per text."""
    n_words = np.diff(first)
    count = np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0)
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    begin = np.arange(total) + np.repeat(first[:-1] - (ends - count), count)
    last = np.minimum(begin + size - 1, np.repeat(first[1:] - 1, count))
    return begin, last, count


def fingerprints_of(texts: pa.Array, size: int = SHINGLE_WORDS, seed: int = SEED) -> np.ndarray:
    """SimHash of each text over XXH64 of its lower-cased, space-joined word shingles."""
    data, offsets = text_bytes(texts)
    starts, ends, first = word_ranges(data, offsets)
    out = np.zeros(len(texts), np.uint64)
    if not len(starts):
        return out
    space = SPACE[data]
    kept = ~space
    kept[1:] |= space[1:] & ~space[:-1]  # one white space character after each word
    place = np.cumsum(kept)
    joined = np.where(space, np.uint8(32), LOWER[data])[kept].tobytes()
    begin, last, count = shingle_ranges(first, size)
    a, b = (place[starts] - 1)[begin].tolist(), place[ends - 1][last].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], seed) for i, j in zip(a, b, strict=True)], np.uint64)
    return majority(hashes, count)


def majority(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Per text the bits that are set in over half of its hashes; no hashes give zero."""
    out = np.zeros(len(count), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        at = (np.cumsum(count) - count)[full]
        major = np.add.reduceat(bits, at, axis=0, dtype=np.int64) * 2 > count[full][:, None]
        out[full] = np.packbits(major, axis=1).view(">u8").ravel()
    return out


def shingle_hashes(texts: pa.Array, size: int = COPY_SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each lower-cased word shingle, the number of them per text, and a hash of each text's words."""
    data, offsets = text_bytes(texts)
    starts, ends, first = word_ranges(data, offsets)
    words = ByteHashes(LOWER[data]).ranges(starts, ends)
    begin, last, count = shingle_ranges(first, size)
    shingles = np.zeros(len(begin), np.uint64)
    for j in range(size):
        inside = begin + j <= last
        shingles[inside] = mix(shingles[inside] * _STEP + words[(begin + j)[inside]])
    n_words = np.diff(first)
    place = np.arange(len(words)) - np.repeat(first[:-1], n_words)
    content = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(n_words)
    if len(full):
        content[full] = mix(np.add.reduceat(mix(words + place.astype(np.uint64) * _STEP), first[:-1][full]) + n_words[full].astype(np.uint64))
    return shingles, count, content


def copy_fingerprints_of(texts: pa.Array, size: int = COPY_SHINGLE) -> tuple[np.ndarray, ...]:
    """Eight MinHash bytes over the shingles of each text, the hash of its words, and the sketch words.

    Two texts agree in each byte with the probability of their Jaccard similarity, whatever the
    edits between them are.
    """
    shingles, count, content = shingle_hashes(texts, size)
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        at = (np.cumsum(count) - count)[full]
        for k, step in enumerate(_ORDERS):
            least = np.minimum.reduceat(mix(shingles + step), at)
            out[full] |= (least & np.uint64(255)) << np.uint64(8 * k)
    sketch = np.zeros((len(SKETCH), len(texts)), np.uint64)
    if len(full):
        for k, factor in enumerate(_FACTORS):
            least = mix(np.minimum.reduceat(shingles * factor, at))
            sketch[k // 64, full] |= (least & np.uint64(1)) << np.uint64(k % 64)
    return out, content, *sketch


def text_hash(text_col: str) -> Column:
    """With the id the key of a row; a null text has the hash of no text."""
    return F.xxhash64(F.col(f"`{text_col}`"))


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str, fingerprints: Callable, more: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp, check, text_hash) per row: the indexed fingerprint and the one that is checked, signed; then ``more``."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), text_hash(text_col).alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            fp, check, *rest = [pa.array(x.view(np.int64)) for x in fingerprints(as_texts(piece.column("text")))]
            yield pa.RecordBatch.from_arrays(
                [piece.column("id"), fp, check, piece.column("text_hash"), *rest], names=["id", "fp", "check", "text_hash", *more]
            )

    return bounded(rows).mapInArrow(run, ", ".join(f"{c} long" for c in ("id", "fp", "check", "text_hash", *more)))


def posting_keys(fp: Column, max_bits: int = MAX_BITS) -> Column:
    """Keys of a fingerprint: every choice of ``8 - max_bits`` positional bytes.

    Two fingerprints that differ in at most ``max_bits`` bits share at least ``8 - max_bits``
    of their eight positional bytes. A list of single bytes holds 1/256 of all rows, so the
    tally is moved into the key: a pair shares a key exactly if its tally reaches the minimum.
    """
    keys = []
    for k, positions in enumerate(combinations(range(8), 8 - max_bits)):
        mask = sum(0xFF << (8 * p) for p in positions)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(signed).cast("long"))))
    return F.array(*keys)


Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def within_bits(max_bits: int) -> Near:
    """Whether fingerprint pairs (rows of fp, check, group) differ in at most ``max_bits`` bits."""
    return lambda x, y: np.bitwise_count(x[..., 0] ^ y[..., 0]) <= max_bits


def sketch_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing sketch bits of node pairs."""
    return sum(np.bitwise_count(x[..., 3 + k] ^ y[..., 3 + k]).astype(np.int16) for k in range(len(SKETCH)))


def alike(tally: int, bits: int = SKETCH_BITS) -> Near:
    """Whether node pairs of different groups share ``tally`` positional bytes and ``bits`` sketch bits or more."""

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        d = x[..., 0] ^ y[..., 0]
        same = np.zeros(d.shape, np.int8)
        for k in range(8):
            same += (d >> np.uint64(8 * k) & np.uint64(255)) == 0
        return (same >= tally) & (x[..., 2] != y[..., 2]) & (sketch_distance(x, y) <= 64 * len(SKETCH) - bits)

    return near


def star_edges(nodes: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """(member, first member) of every group of linked nodes.

    A breadth-first search in which every member is compared with those not yet reached, so a
    dense list costs little more than one comparison each.
    """
    root = np.arange(len(nodes))
    rest = np.arange(len(nodes))
    while len(rest):
        seed, rest = rest[0], rest[1:]
        frontier = np.array([seed])
        while len(frontier) and len(rest):
            hits = np.zeros(len(rest), bool)
            for k in range(0, len(frontier), 64):
                open_ = np.flatnonzero(~hits)
                hit = near(nodes[frontier[k : k + 64], None], nodes[None, rest[open_]])
                hits[open_] = hit.any(axis=0)
            frontier, rest = rest[hits], rest[~hits]
            root[frontier] = seed
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def parent_edges(nodes: np.ndarray, near: Near) -> tuple[np.ndarray, np.ndarray]:
    """(member, the member it was reached from) of every group of linked nodes, the same search as ``star_edges``."""
    parent = np.arange(len(nodes))
    rest = np.arange(len(nodes))
    while len(rest):
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            via = np.full(len(rest), -1)
            for k in range(0, len(frontier), 64):
                open_ = np.flatnonzero(via < 0)
                hit = near(nodes[frontier[k : k + 64], None], nodes[None, rest[open_]])
                reached = hit.any(axis=0)
                via[open_[reached]] = frontier[k + hit.argmax(axis=0)[reached]]
            parent[rest[via >= 0]] = via[via >= 0]
            frontier, rest = rest[via >= 0], rest[via < 0]
    moved = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[moved], nodes[parent[moved]]


def joining_edges(check: np.ndarray, group: np.ndarray, side: np.ndarray, sets: pa.ListArray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all groups with a pair of at least this Jaccard similarity, and none below it.

    Where ``side`` has two values, pairs within one are left to other calls. A node is compared with
    all others at once: the lists of the nodes that hold its shingles are counted. Every pair of two
    groups has a node outside of the largest one, so the nodes of that one start no comparison.
    """
    size = np.diff(sets.offsets.to_numpy())
    first = np.concatenate([[0], np.cumsum(size)])
    values = sets.flatten().to_numpy()
    code = np.unique(values, return_inverse=True)[1]
    holder = np.repeat(np.arange(len(size)), size)[np.argsort(code, kind="stable")]
    n_holders = np.bincount(code)
    begin = np.cumsum(n_holders) - n_holders
    group = np.unique(group, return_inverse=True)[1]
    pairs = np.ones(len(size), bool)
    left, right = [], []
    for i in np.flatnonzero(group != np.bincount(group).argmax()).tolist():
        if side.min() != side.max():
            pairs = side != side[i]
        if not (pairs & (group != group[i])).any():
            continue
        own = code[first[i] : first[i + 1]]
        shared = np.bincount(holder[concat_ranges(begin[own], n_holders[own])], minlength=len(size))
        close = shared * 1000 >= round(similarity * 1000) * (size + size[i] - shared)
        for j in np.flatnonzero(pairs & close & (group != group[i])).tolist():
            if group[i] != group[j]:
                left.append(check[i])
                right.append(check[j])
                group[group == group[j]] = group[i]
    return np.array(left, np.int64), np.array(right, np.int64)


_FOUND = "a long, a_check long, a_group long, b long, b_check long, key long, block int"


def _rows(a: np.ndarray, b: np.ndarray | None, key=None, block=None, more: tuple[str, ...] = ()) -> pa.RecordBatch:
    """Edges from nodes ``a`` to ``b``, or without ``b`` the nodes of one block of a long list."""
    n = len(a)
    column = lambda x, k: pa.array(np.ascontiguousarray(x[:, k]).view(np.int64))
    empty = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            column(a, 0), column(a, 1), empty if b is not None else column(a, 2),
            empty if b is None else column(b, 0), empty if b is None else column(b, 1),
            empty if key is None else pa.array(np.full(n, key, np.int64)),
            pa.nulls(n, pa.int32()) if block is None else pa.array(np.full(n, block, np.int32)),
            *[empty if b is not None else column(a, 3 + k) for k in range(len(more))],
        ],
        names=["a", "a_check", "a_group", "b", "b_check", "key", "block", *more],
    )


def _edges_of_lists(keys: np.ndarray, nodes: np.ndarray, bounds: np.ndarray, near: Near, search_list: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Edges of whole posting lists: short ones all together by shifted comparison, others by ``search_list``."""
    lengths = np.diff(bounds)
    left, right = [nodes[:0]], [nodes[:0]]
    short = np.repeat(lengths <= _SHORT_LIST, lengths)
    for shift in range(1, _SHORT_LIST):
        same = np.flatnonzero(short[:-shift] & (keys[:-shift] == keys[shift:]))
        if not len(same):
            break
        hit = same[near(nodes[same], nodes[same + shift])]
        left.append(nodes[hit])
        right.append(nodes[hit + shift])
    for k in np.flatnonzero(lengths > _SHORT_LIST).tolist():
        a, b = search_list(nodes[bounds[k] : bounds[k + 1]], near)
        left.append(a)
        right.append(b)
    return np.concatenate(left), np.concatenate(right)


def fingerprint_links(
    distinct: DataFrame, keys: Column, near: Near, search_list: Callable = star_edges, more: tuple[str, ...] = ()
) -> DataFrame:
    """Edges (a, a_check, b, b_check) between different nodes (fp, check, group and the columns ``more``).

    With ``star_edges`` or ``parent_edges`` they have the components of all links. A list of n nodes
    gives fewer than n edges, or all of a list of at most ``_SHORT_LIST``.

    Posting lists are dealt by key and sorted, and each is searched by one task in blocks of
    ``LIST_BLOCK``. A longer list is not held together: its blocks are marked, and all pairs of
    its blocks are searched by separate tasks, so no link is lost and no task grows with the list.
    """
    names = ("fp", "check", "group", *more)
    rows = distinct.select(*names, F.explode(keys).alias("key"))
    rows = rows.repartition("key").sortWithinPartitions("key", "fp", "check")

    def nodes_of(batch) -> np.ndarray:
        return np.stack([batch.column(c).to_numpy().view(np.uint64) for c in names], axis=1)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes = np.zeros(0, np.int64), np.zeros((0, len(names)), np.uint64)
        long_key, block = None, 0  # the list of which blocks have been sent on
        for batch in chain(batches, [None]):
            if batch is not None:
                keys = np.concatenate([keys, batch.column("key").to_numpy()])
                nodes = np.concatenate([nodes, nodes_of(batch)])
            if not len(keys):
                continue
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]])
            if batch is not None:
                bounds = bounds[:-1]  # the last list may go on
            if long_key is not None and keys[0] == long_key and len(bounds) > 1:
                yield _rows(nodes[: bounds[1]], None, long_key, block, more)
                bounds, long_key = bounds[1:], None
            if len(bounds) > 1:
                lo, hi = bounds[0], bounds[-1]
                yield _rows(*_edges_of_lists(keys[lo:hi], nodes[lo:hi], bounds - lo, near, search_list), more=more)
            keys, nodes = keys[bounds[-1] :], nodes[bounds[-1] :]
            while len(keys) > LIST_BLOCK:
                if keys[0] != long_key:
                    long_key, block = keys[0], 0
                yield _rows(nodes[:LIST_BLOCK], None, long_key, block, more)
                keys, nodes, block = keys[LIST_BLOCK:], nodes[LIST_BLOCK:], block + 1

    found = materialize(rows.mapInArrow(search, ", ".join([_FOUND, *[f"{c} long" for c in more]])), "postings")
    edges = found.where("b is not null").select("a", "a_check", "b", "b_check")
    blocks = found.where("key is not null").select(F.col("a").alias("fp"), F.col("a_check").alias("check"), F.col("a_group").alias("group"), *more, "key", "block")
    # Every pair of blocks of a long list: each block is sent to as many tasks as the list has blocks.
    sizes = blocks.groupBy("key").agg((F.max("block") + 1).alias("n"))
    cells = blocks.join(sizes, "key").select(
        *names, "key", "block", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    ).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *names)

    def search_cell(table: pa.Table) -> pa.Table:
        a, b = search_list(nodes_of(table.combine_chunks()), near)
        return pa.Table.from_batches([_rows(a, b)]).select(["a", "a_check", "b", "b_check"])

    searched = cells.groupBy("key", "i", "j").applyInArrow(search_cell, "a long, a_check long, b long, b_check long")
    return edges.unionByName(searched)


def _groups(marked: DataFrame, links: Callable[[DataFrame], DataFrame], more: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp, component_id, text_hash, first_hash) per row of (id, fp, check, text_hash and the columns ``more``).

    ``links`` gives the edges (a, b) between the nodes of a frame (fp, check, node, more). The component
    is the smallest id reachable, null only if all are; with the smallest ``first_hash`` under that
    id it names the row that stands for the component.
    """
    marked = materialize(marked.withColumn("node", F.xxhash64("fp", "check")), "fingerprints")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_hash"))
    distinct = materialize(marked.groupBy("fp", "check", "node", *more).agg(least.alias("least")), "distinct")
    tree = components(links(distinct.select("fp", "check", "node", *more)))
    rooted = distinct.join(tree, distinct["node"] == tree["id"], "left").select(
        "node", "least", F.coalesce("root", "node").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("first"))
    named = rooted.join(least, "root").select(
        F.col("node").alias("_node"), F.col("first.id").alias("component_id"), F.col("first.text_hash").alias("first_hash")
    )
    return marked.join(named, F.col("node") == F.col("_node")).select("id", "fp", "component_id", "text_hash", "first_hash")


def _node_edges(links: DataFrame) -> DataFrame:
    return links.select(F.xxhash64("a", "a_check").alias("a"), F.xxhash64("b", "b_check").alias("b"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS, seed: int = SEED
) -> DataFrame:
    """(id, fingerprint, component_id, kept) per row.

    Fingerprints that differ in at most ``max_bits`` bits are linked, and the component is the
    smallest id reachable. Equal fingerprints are one node, so exact copies cost one row however
    many there are. ``kept`` marks the row whose id is the component's. A null or blank text has
    fingerprint zero and is linked like any other. Rows of equal id are separate rows with their
    own fingerprints. A row of null id is linked; it is kept only where its whole component has
    null ids, whose component_id is null. An empty table gives no rows; other columns are ignored.
    """

    def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return fingerprints_of(texts, size, seed), np.zeros(len(texts), np.uint64)

    def links(nodes: DataFrame) -> DataFrame:
        rows = nodes.withColumn("group", F.lit(0).cast("long"))
        return _node_edges(fingerprint_links(rows, posting_keys(F.col("fp"), max_bits), within_bits(max_bits)))

    found = _groups(with_fingerprint(docs, id_col, text_col, fingerprints), links)
    return found.select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of ``check`` values whose shingle sets have at least this Jaccard similarity."""
    right = sets.select(F.col("check").alias("b"), F.col("shingles").alias("y"))
    left = sets.select(F.col("check").alias("a"), F.col("shingles").alias("x"))
    both = pairs.join(right, "b").join(left, "a")
    # Equal shares are not lost to rounding: both sides are whole numbers below 2 ** 53.
    shared = F.size(F.array_intersect("x", "y"))
    return both.withColumn("n", shared).where(
        F.col("n") * F.lit(1000) >= F.lit(round(similarity * 1000)) * (F.size("x") + F.size("y") - F.col("n"))
    ).select("a", "b")


def shingle_sets(docs: DataFrame, text_col: str, wanted: DataFrame, size: int) -> DataFrame:
    """(check, shingles) of the texts whose hash is in ``wanted`` (text_hash): the different shingle hashes of each."""
    rows = docs.select(F.col(text_col).alias("text"), text_hash(text_col).alias("text_hash"))
    rows = rows.join(wanted, "text_hash", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "text"):
            shingles, count, content = shingle_hashes(as_texts(piece.column("text")), size)
            bounds = np.concatenate([[0], np.cumsum(count)])
            sets = [np.unique(shingles[a:b]).view(np.int64) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(content.view(np.int64)), lists], names=["check", "shingles"])

    return bounded(rows).mapInArrow(run, "check long, shingles array<long>")


def _joined(open_: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The edges (a, b) of ``joining_edges`` over all pairs within each loose group of (check, loose, group).

    Each group is dealt to blocks by hash, as many as its rows and shingles ask for, and every pair of blocks is
    compared by one task, so no task grows with a group.
    """
    rows = open_.select("check", "loose", "group").join(sets, "check").withColumn("size", F.size("shingles"))
    n = F.greatest(F.ceil(F.count(F.lit(1)) / LIST_BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int")
    # A block on its own is half full, so that a pair of blocks is a full one.
    sizes = rows.groupBy("loose").agg(n.alias("n")).withColumn("n", F.when(F.col("n") > 1, F.col("n") * 2).otherwise(1))
    dealt = rows.join(sizes, "loose").withColumn("block", F.pmod(F.xxhash64("check", F.lit(1)), F.col("n")).cast("int"))
    cells = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")).select(
        "loose", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "check", "group", "shingles"
    )

    def join_cell(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks()
        column = lambda c: batch.column(c).to_numpy()
        sets = batch.column("shingles").combine_chunks()
        a, b = joining_edges(column("check"), column("group"), column("block"), sets, similarity)
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return cells.groupBy("loose", "i", "j").applyInArrow(join_cell, "a long, b long")


def similar_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = COPY_SHINGLE, similarity: float = COPY_SIMILARITY,
    tally: int = COPY_TALLY,
) -> DataFrame:
    """(id, component_id, kept, text_hash) per row for copies with a shingle similarity of ``similarity`` or more.

    The index runs over MinHash bytes of the ``size``-word shingles (a text of fewer words is one
    shingle), keyed by every choice of ``tally`` positions: a pair of similarity s is a candidate
    with the probability that at least ``tally`` of eight bytes agree, 0.99 at 0.8, whatever the
    edits. Candidates must also agree in enough bits of a wider sketch, and each is checked by the
    exact Jaccard similarity of the shingle sets. The search takes a tree of candidates from
    each posting list; all candidates, also those in no tree, lie within one loose group of such
    trees. Where failed checks leave nodes of a loose group apart, all its pairs of different
    groups are compared by their shingle sets, so no candidate stays unchecked. Texts of equal
    words are one node. ``kept`` marks the row of the smallest
    id (nulls last) and then the smallest ``text_hash`` of its component; only rows equal in both
    are kept together. So every component keeps a row, also one of null ids, and different texts
    under one id are judged each.
    """

    def fingerprints(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return copy_fingerprints_of(texts, size)

    marked = materialize(with_fingerprint(docs, id_col, text_col, fingerprints, SKETCH), "copies")

    def links(nodes: DataFrame) -> DataFrame:
        keys = posting_keys(F.col("fp"), 8 - tally)
        pairs = fingerprint_links(nodes.withColumn("group", F.col("check")), keys, alike(tally), parent_edges, SKETCH)
        tried = materialize(pairs.select(F.greatest("a_check", "b_check").alias("a"), F.least("a_check", "b_check").alias("b")).distinct(), "candidates")
        # Every text with a candidate is in one of these edges; the others need no shingles and no further comparison.
        ends = materialize(tried.select(F.explode(F.array("a", "b")).alias("check")).distinct(), "candidates")
        wanted = marked.join(ends, "check", "left_semi").groupBy("check").agg(F.min("text_hash").alias("text_hash")).select("text_hash")
        sets = materialize(shingle_sets(docs, text_col, wanted, size).dropDuplicates(["check"]), "shingles")
        rooted = lambda rows, edges, name: rows.join(
            components(edges).select(F.col("id").alias("check"), F.col("root").alias("_root")), "check", "left"
        ).select(*rows.columns, F.coalesce("_root", "check").alias(name))
        # All candidate pairs, also those no tree holds, lie within one loose group.
        loose = rooted(ends, tried, "loose")
        similar = materialize(_similar(tried, sets, similarity), "similar")
        grouped = materialize(rooted(loose, similar, "group"), "groups")
        split = grouped.groupBy("loose").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi")
        found = similar.unionByName(materialize(_joined(grouped.join(split, "loose", "left_semi"), sets, similarity), "joined"))
        names = nodes.select("check", "node")
        a, b = names.select(F.col("check").alias("a"), F.col("node").alias("x")), names.select(F.col("check").alias("b"), F.col("node").alias("y"))
        return found.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))

    found = _groups(marked, links, SKETCH)
    kept = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("first_hash"))
    return found.select(F.col("id").alias(id_col), "component_id", kept.alias("kept"), "text_hash")
