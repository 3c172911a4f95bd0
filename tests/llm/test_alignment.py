import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from siftlab.llm import alignment
from siftlab.llm.perfect_hash import KeyedVector, PerfectHash
from siftlab.llm.queries import tokenizer_file
from tests.llm.samples import awkward_documents, docs_frame, document, words

BYTE, PIECE = "byte_bpe_50k.json", "piece_bpe_32k.model"
HARD = [
    "a\nb\n\nc", " lead", "\n", "trail ", "trail \n", "a  b   c", "a\tb\r\nc", "<s> </s> <|endoftext|> <unk>", "don't it's", "x▁y", "▁", "1234 5,678.9",
    "日本語 テキスト。　x", "a  b", "a  b", "é ́x Å", "𝔘 𝔘", "a\x1c b\x00 c", "naïve … café… b", "ﬁ ½ １", "(); }\r\n", ";\r", "﻿ a", "ß ж\u0085 x", "  ",
]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**63 - 1), max_size=500))
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), np.uint64)
    table = PerfectHash.load(PerfectHash.build(keys).dump())
    slots = table.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))
    vector = KeyedVector(table, table.by_slot(keys), np.arange(len(keys))[np.argsort(slots)] if len(keys) else np.zeros(0, np.int64))
    assert vector.get(keys).tolist() == list(range(len(keys)))
    strange = np.array([k for k in range(300) if k not in set(keys.tolist())], np.uint64)
    assert (vector.get(strange) == -1).all()


@pytest.fixture(scope="module")
def tools():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_file(BYTE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECE))
    return a, b


def spans(tools, text):
    """[(id, begin, end)] of both tokenizers over the bytes of space + text, or None."""
    a, b = tools
    if not text:
        return None
    want = (" " + text).encode()
    byte_of = alignment._byte_of_char()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
    pieces = [b.id_to_piece(i) for i in ids_b]
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces, strict=True)]
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return None
    out = []
    for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
        at, own = 0, []
        for i, p in zip(ids, parts, strict=True):
            own.append((i, at, at + len(p)))
            at += len(p)
        out.append(own)
    return out


def brute_force(tools, rows):
    found, counts = [], Counter()
    for r in rows:
        got = spans(tools, r[1])
        links = []
        if got:
            links = [(x[0], y[0]) for x in got[0] for y in got[1] if max(x[1], y[1]) < min(x[2], y[2])] if len(got[0]) < 3000 else fast_links(got)
        counts.update(links)
        found.append((r[0], got, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for doc_id, got, links in found:
        if not got:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({x[2] for x in got[0]} & {y[2] for y in got[1]})
        groups, low = [], 0
        texts = [[(str(x[0]), x[2]) for x in side] for side in got]
        at = [0, 0]
        for end in ends:
            parts = []
            for k in range(2):
                stop = at[k]
                while stop < len(texts[k]) and texts[k][stop][1] <= end:
                    stop += 1
                parts.append(",".join(t for t, _ in texts[k][at[k] : stop]))
                at[k] = stop
            groups.append("|".join(parts))
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc_id, len(got[0]), len(got[1]), len(groups), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), sha))
    return sorted(out, key=str)


def fast_links(got):
    out, j = [], 0
    for i, begin, end in got[0]:
        while got[1][j][2] <= begin:
            j += 1
        k = j
        while k < len(got[1]) and got[1][k][1] < end:
            out.append((i, got[1][k][0]))
            k += 1
    return out


def told(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_awkward_rows(spark, tools):
    rows = awkward_documents() + [document(100 + i, t) for i, t in enumerate(HARD)]
    got = alignment.align_documents(docs_frame(spark, rows), tokenizer_file(BYTE), tokenizer_file(PIECE))
    assert told(got) == brute_force(tools, rows)
    assert alignment.align_documents(docs_frame(spark, []), tokenizer_file(BYTE), tokenizer_file(PIECE)).count() == 0


def test_rare_pairs_shards_and_tree(spark, tools, monkeypatch):
    for name, value in {"FREQUENT": 30, "SHARD_KEYS": 50, "FAN_IN": 2, "GROUP_ROWS": 20, "CHUNK_BYTES": 300, "HELD": 40, "CALL_BYTES": 100}.items():
        monkeypatch.setattr(alignment, name, value)
    rng = random.Random(6)
    alphabet = "abcdefghijklmnoprstuvw é\n,.1"
    rows = [document(i % 50, "the the " + words(rng, 20) + "".join(rng.choice(alphabet) for _ in range(60))) for i in range(90)]
    docs = docs_frame(spark, rows).repartition(9)
    assert told(alignment.align_documents(docs, tokenizer_file(BYTE), tokenizer_file(PIECE))) == brute_force(tools, rows)
