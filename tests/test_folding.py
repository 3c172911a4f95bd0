"""Folding against the character database, on every character and on sequences with marks."""

import random
import sys
import unicodedata

from hypothesis import given, settings, strategies as st

from siftlab.functions import folding


def folded(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    columns = [folding.nfkc("t").alias("n"), folding.casefold("t").alias("f"), folding.casefold(folding.nfkc("t")).alias("both")]
    return df.select("t", *columns).toArrow().to_pylist()


def assert_equal(rows):
    normal = lambda t: unicodedata.normalize("NFKC", t)
    bad = [r for r in rows if (r["n"], r["f"], r["both"]) != (normal(r["t"]), r["t"].casefold(), normal(r["t"]).casefold())]
    assert not bad, bad[:3]


def test_every_assigned_character(spark):
    chars = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    assert_equal(folded(spark, [ch for ch in chars if unicodedata.category(ch) != "Cn"]))


def test_sequences_of_marks_and_syllables(spark):
    rng = random.Random(1)
    marks = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.combining(chr(c))]
    pairs = [a + b for a, b in folding._pairs()]
    other = [chr(c) for c in range(0x1100, 0x11FF)] + list("aeiouAEIOU ﬁ１ｶﾞ가각\n\x00ßİΣ")
    texts = ["".join(rng.choice(rng.choice((marks, pairs, other))) for _ in range(rng.randint(1, 12))) for _ in range(8_000)]
    assert_equal(folded(spark, texts))


def test_nulls_long_texts_and_marks_without_a_base(spark):
    long = "naïve ﬁne é " * 8000
    texts = ["", "́", "̣̂a", "a" + "́" * 300, long, "１２３" * 500]
    assert_equal(folded(spark, texts))
    row = spark.createDataFrame([(None,)], "t string").select(folding.nfkc("t").alias("n"), folding.casefold("t").alias("f")).first()
    assert tuple(row) == (None, None)


@settings(max_examples=6, deadline=None)
@given(texts=st.lists(st.text(max_size=40), min_size=1, max_size=50))
def test_any_texts(spark, texts):
    assert_equal(folded(spark, [t.replace("\x00", "") for t in texts]))
