import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from siftlab.llm import simple8b, token_output
from siftlab.llm.queries import tokenizer_file
from tests.llm.samples import awkward_documents, docs_frame


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 60_000) | st.integers(0, 3), max_size=400), st.sampled_from([7, 64, 8192]))
def test_simple8b_round_trip(values, block):
    array = np.array(values, np.uint64)
    payload, offsets = simple8b.encode(array, block)
    assert simple8b.decode(payload, offsets, len(array), block).tolist() == values
    assert len(payload) % 8 == 0 and len(offsets) == -(-len(values) // block)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def test_units_do_not_change_ids(tokenizer):
    texts = [
        "", "  ", "don't DON'T it's", "ΑΣ ΣΑΣ. x", "İstanbul I", "a b c", "é ́x", "<|endoftext|> <|STARTOFTEXT|>x <|startoftext|>", "ﬁ １２ ½",
        "a\x1cb \x85 c", "naïve,,, x.y a1b2.", "​ zero", "ſ K Å", "…, Ende. ×, ÷.", "end.\nStart,", "日本語。テキスト.", "ß. ÿ, À.",
    ]
    ids, counts = token_output.WordEncoder(tokenizer_file()).encode_texts(pa.array(texts, pa.large_string()), 1)
    at = 0
    for text, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [1]
        at += n


def test_files_hold_all_documents_in_order(spark, tokenizer):
    rows = sorted(awkward_documents(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = sorted(token_output.token_output(docs_frame(spark), tokenizer_file()).collect(), key=lambda r: r["start"])
    assert len(got) == len(rows)
    start = 0
    for want, r in zip(rows, got, strict=True):
        ids = tokenizer.encode(want[1] or "", add_special_tokens=False).ids + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (want[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_output.token_output(docs_frame(spark, []), tokenizer_file()).count() == 0
