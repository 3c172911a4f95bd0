import random

import pyarrow as pa
import pytest

from siftlab.llm import token_counts
from siftlab.llm.queries import tokenizer_file
from tests.llm.samples import awkward_documents, docs_frame, document, words

HARD = [
    "", "  ", "don't DON'T it's 'tis rock'n'roll", "ΑΣ ΣΑΣ. x", "İstanbul I", "a b c", "é ́x", "<|endoftext|> <|STARTOFTEXT|>x <|startoftext|>a<|endoftext|>b",
    "ﬁ １２ ½", "a\x1cb \x85 c\x00d", "naïve,,, x.y a1b2. 12345", "​ zero", "ſ K Å", "…, Ende. ×, ÷.", "end.\nStart,\r\n\tx", "日本語。テキスト.",
    "< b > <|x|>", "x_y-z@a.b!?", "'''s '", "ÀÉ À", "\x7f a\x7f", "𝔘 𝔘", "1٣4", "\\0<|endoftext|> \x00",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_of_pre_tokens_sum_to_tokens(name):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_file(name))
    cutter = token_counts.PreTokens(tokenizer_file(name))
    rng = random.Random(4)
    noise = ["".join(rng.choice("ab '\n<|>1é.,Ś ") for _ in range(40)) for _ in range(200)]
    names, codes, owner = cutter.occurrences(pa.array(HARD + noise, pa.large_string()))
    sums = [0] * len(HARD + noise)
    for c, o in zip(codes.tolist(), owner.tolist(), strict=True):
        sums[o] += cutter.pieces(names[c])
    assert sums == [len(whole.encode(t, add_special_tokens=False).ids) for t in HARD + noise]


def expected(tokenizer, rows):
    out = []
    for r in rows:
        n = len(tokenizer.encode(r[1] or "", add_special_tokens=False).ids)
        out.append((r[0], len((r[1] or "").encode()), n, n > 2048))
    return sorted(out, key=str)


def test_awkward_rows(spark, tokenizer):
    rows = awkward_documents() + [document(100 + i, t) for i, t in enumerate(HARD)]
    got = token_counts.count_tokens(docs_frame(spark, rows), tokenizer_file())
    assert sorted(map(tuple, got.collect()), key=str) == expected(tokenizer, rows)
    assert token_counts.count_tokens(docs_frame(spark, []), tokenizer_file()).count() == 0


def test_rare_pre_tokens_meet_their_pieces_in_the_join(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(token_counts, "FREQUENT", 20)
    monkeypatch.setattr(token_counts, "CHUNK_BYTES", 400)
    monkeypatch.setattr(token_counts, "HELD", 30)
    rng = random.Random(6)
    rows = [document(i % 30, "the the and " + words(rng, 30, "abcdefghijklm")) for i in range(60)]
    got = token_counts.count_tokens(docs_frame(spark, rows), tokenizer_file())
    assert sorted(map(tuple, got.collect()), key=str) == expected(tokenizer, rows)
