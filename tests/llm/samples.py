"""Awkward tables and brute-force twins shared by the tests."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Names that operators use inside, as extra columns of the input.
EXTRA = ("id", "h", "fp", "check", "node", "size", "score", "position", "word", "seed", "key", "rank", "target", "start", "component_id")
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def document(doc_id, text, lang="en", source="s0"):
    return (doc_id, text, lang, source, None if text is None else len(text), *("x" for _ in EXTRA))


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


def awkward_documents():
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, other scripts."""
    rng = random.Random(5)
    base = words(rng, 120)
    rows = [
        document(1, ""), document(2, None), document(3, " \t\n "), document(4, base), document(4, base), document(5, base),
        document(6, base.replace(" ", "  ")), document(7, words(rng, 30_000)), document(None, words(rng, 20)), document(8, "one"),
        document(9, "Ünïcode ÀÉ 𝔘 1.2.3.4 a@b.co +1 234 567 8901"), document(10, words(rng, 60), None, None), document(11, words(rng, 60), "en", "é"),
        document(12, "x" * 5000), document(13, "ab " * 700), document(None, None, None, None),
    ]
    return rows + [document(20 + i, words(rng, 40), "en", f"s{i % 4}") for i in range(12)]


def docs_frame(spark, rows=None):
    return spark.createDataFrame(awkward_documents() if rows is None else rows, DOC_SCHEMA)


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def groups_of(n, linked):
    """Smallest member of each index's group under a symmetric predicate."""
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if find(i) != find(j) and linked(i, j):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
