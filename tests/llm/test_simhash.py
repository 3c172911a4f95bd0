import random

import pytest
import xxhash

from siftlab.llm import simhash
from tests.llm.samples import WORD, ascii_lower, awkward_documents, docs_frame, document, groups_of, words


def fingerprint(text):
    found = WORD.findall(ascii_lower(text or ""))
    shingles = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))] if found else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if ones[k] * 2 > len(shingles))


def near_copies(rng, n):
    rows, base = [], words(rng, 150).split()
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 3)):
            copy[rng.randrange(len(copy))] = words(rng, 1)
        rows.append(document(100 + i, " ".join(copy)))
    return rows


@pytest.mark.parametrize("block", [4096, 5])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "LIST_BLOCK", block)
    rows = [r for r in awkward_documents() if r[0] is not None] + near_copies(random.Random(2), 60)
    prints = [fingerprint(r[1]) for r in rows]
    roots = groups_of(len(rows), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 4)
    least = {}
    for i, root in enumerate(roots):
        least[root] = min(least.get(root, rows[i][0]), rows[i][0])
    want = sorted((r[0], format(p, "016x"), least[root], r[0] == least[root]) for r, p, root in zip(rows, prints, roots, strict=True))
    assert sorted(tuple(r) for r in simhash.near_duplicates(docs_frame(spark, rows)).collect()) == want


def test_copies_of_high_similarity_are_found(spark):
    rng = random.Random(9)
    rows = []
    for k in range(40):
        base = words(rng, 150, "abcdefghijklm").split()
        copy = list(base)
        copy[rng.randrange(150)] = "changed"
        rows += [document(2 * k, " ".join(base)), document(2 * k + 1, " ".join(copy))]
    found = simhash.similar_documents(docs_frame(spark, rows)).collect()
    assert sum(r["component_id"] == r["doc_id"] - 1 for r in found if r["doc_id"] % 2) >= 36
    assert all(r["kept"] for r in found if r["doc_id"] % 2 == 0)


def test_empty_and_null_ids(spark):
    assert simhash.near_duplicates(docs_frame(spark, [])).count() == 0
    got = simhash.near_duplicates(docs_frame(spark, [document(None, "a b"), document(None, "a b"), document(3, "")])).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, True), (0, 0, True), (3, 3, True)]


def edited(rng, base, kind, n):
    text, at = list(base), rng.randrange(len(base) - 40)
    if kind == "substituted":
        for k in rng.sample(range(len(text)), n):
            text[k] = words(rng, 1)
    elif kind == "appended":
        text += words(rng, 5 * n).split()
    elif kind == "removed":
        del text[at : at + 4 * n]
    else:
        part, text = text[at : at + 40], text[:at] + text[at + 40 :]
        to = rng.randrange(len(text))
        text[to:to] = part
    return text


def shingle_set(text):
    found = text.split()
    return {tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4))}


@pytest.mark.parametrize("block", [4096, 5])
def test_copies_by_kind_of_edit_equal_exact_similarity(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "LIST_BLOCK", block)
    rng, rows = random.Random(17), []
    for kind in ("substituted", "appended", "removed", "moved"):
        for n in (1, 3, 5, 7, 9):
            for _ in range(6):
                base = words(rng, 200, "abcdefghijklm").split()
                rows += [document(len(rows), " ".join(base)), document(len(rows) + 1, " ".join(edited(rng, base, kind, n)))]
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(docs_frame(spark, rows)).collect()}
    hits, wanted = 0, 0
    for i in range(0, len(rows), 2):
        x, y = shingle_set(rows[i][1]), shingle_set(rows[i + 1][1])
        close = len(x & y) >= 0.8 * len(x | y)
        assert close or found[i + 1] == i + 1  # nothing less similar is linked
        wanted += close
        hits += close and found[i + 1] == i
    assert 60 <= wanted < 120 and hits >= 0.97 * wanted


def test_every_close_pair_of_a_dense_list_is_linked(spark):
    rng = random.Random(23)
    base = words(rng, 200, "abcdefghijklm").split()
    texts = [" ".join(base[: 200 - 10 * k] + words(rng, 10 * k).split()) for k in range(8) for _ in range(6)]
    rows = [document(i, t) for i, t in enumerate(texts)]
    sets = [shingle_set(t) for t in texts]
    prints = simhash.copy_fingerprints_of(simhash.pa.array(texts, simhash.pa.large_string()))[0].tolist()

    def close(i, j):
        same = sum(prints[i] >> 8 * k & 255 == prints[j] >> 8 * k & 255 for k in range(8))
        return same >= 4 and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])

    roots = groups_of(len(rows), close)
    assert 1 < len(set(roots)) < len(rows)
    assert [r["component_id"] for r in simhash.similar_documents(docs_frame(spark, rows)).orderBy("doc_id").collect()] == roots


@pytest.mark.parametrize("block", [4096, 20])
def test_pairs_with_nearer_failing_neighbours_are_linked(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "LIST_BLOCK", block)
    rng = random.Random(41)
    base = words(rng, 200, "abcdefghijklm").split()
    texts = []
    for _ in range(70):
        copy = list(base)
        for k in rng.sample(range(0, 200, 5), 3):
            copy[k] = words(rng, 1)
        texts.append(" ".join(copy))
    sets = [shingle_set(t) for t in texts]
    close = {(i, j) for i in range(70) for j in range(i) if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    roots = groups_of(len(texts), lambda i, j: (i, j) in close)
    assert 5 < len(set(roots)) < 50
    found = simhash.similar_documents(docs_frame(spark, [document(i, t) for i, t in enumerate(texts)])).orderBy("doc_id").collect()
    assert [r["component_id"] for r in found] == roots
