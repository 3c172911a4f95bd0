import hashlib
import random
import zlib

from siftlab.llm import manifest
from tests.llm.samples import ascii_lower, awkward_documents, docs_frame, document

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf_of(row, text):
    return h(*map(framed, (row[0], row[3], row[2], row[4], text)))


def tree_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def climb(levels, at, node):
    """(siblings, node at the top when the leaf is ``node``)"""
    out = []
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        out += [x for i, x in enumerate(run) if i != at % 8]
        run[at % 8] = node
        node, at = h(*run), at // 8
    return out, node


def brute_force(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, ordered = {}, {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r, r[1])))
        ordered[lang], trees[lang] = own, tree_of([leaf_of(r, r[1]) for r in own])
    top = tree_of([trees[x][-1][0] for x in langs])
    out = []
    for i, lang in enumerate(langs):
        for at, r in enumerate(ordered[lang]):
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = leaf_of(r, ascii_lower(r[1]) if touched and r[1] is not None else r[1])
            low, node = climb(trees[lang], at, now)
            high, root = climb(top, i, node)
            out.append((r[0], trees[lang][0][at], trees[lang][-1][0], top[-1][0], h(*low, *high), root, root == top[-1][0]))
    return sorted(out, key=str)


def told(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=str)


def test_awkward_rows(spark):
    rows = awkward_documents()
    assert told(manifest.verify_tampered(manifest.build_manifest(docs_frame(spark)))) == brute_force(rows)


def test_many_levels_and_many_languages(spark):
    rng = random.Random(3)
    sizes = {"en": 4200, "de": 513, "fr": 512, None: 65, "": 64, "ä": 9, "zz": 8, "Z": 1} | {f"l{i}": 1 + i % 3 for i in range(70)}
    rows = [document(i, rng.choice(["Ab", "ab", "", None, "É A"]), lang) for i, lang in enumerate(x for x, n in sizes.items() for _ in range(n))]
    rng.shuffle(rows)
    assert told(manifest.verify_tampered(manifest.build_manifest(docs_frame(spark, rows)))) == brute_force(rows)


def test_written_manifest_is_read_again(spark, tmp_path):
    rows = [document(i, f"Text {i}", "en" if i % 3 else "de") for i in range(700)]
    built = manifest.build_manifest(docs_frame(spark, rows), str(tmp_path / "m"))
    again = manifest.read_manifest(spark, built.path)
    assert again.root == built.root and len(again.levels) == len(built.levels) == 2
    assert told(manifest.verify_tampered(again)) == brute_force(rows)


def test_one_document_and_none(spark):
    one = [document(5, "Hello")]
    assert told(manifest.verify_tampered(manifest.build_manifest(docs_frame(spark, one)))) == brute_force(one)
    empty = manifest.build_manifest(docs_frame(spark, []))
    assert empty.root is None and manifest.verify_tampered(empty).count() == 0
