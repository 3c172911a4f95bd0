"""Containment by the index of pieces against plain substring tests."""

import random

from siftlab.operators import binding


def found(spark, patterns, texts):
    p = spark.createDataFrame(sorted(patterns), "doi long, key string")
    t = spark.createDataFrame([(d, str(i), x) for i, (d, x) in enumerate(texts)], "doi long, text_id string, text string")
    rows = [(r["doi"], int(r["text_id"]), r["key"]) for r in binding.contained_keys(p, t).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def brute_force(patterns, texts):
    return {(d, i, k) for d, k in patterns for i, (e, x) in enumerate(texts) if d == e and k in x}


def test_contained_keys_equal_brute_force(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abα中1") for _ in range(n))
    patterns = {(rng.randrange(4), word(rng.randint(1, 9))) for _ in range(300)}
    texts = [(rng.randrange(5), word(rng.choice((0, 1, 2, 3, 5, 40, 200)))) for _ in range(80)]
    assert found(spark, patterns, texts) == brute_force(patterns, texts)
    assert found(spark, set(), texts[:3]) == set() and found(spark, patterns, []) == set()


def test_long_evidence_and_many_names(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh0123") for _ in range(100_000))
    patterns = {(1, text[i : i + 12]) for i in range(0, 50_000, 100)} | {(1, "".join(rng.choice("abcdefgh0123") for _ in range(9))) for _ in range(500)}
    patterns |= {(1, "a"), (1, "zz"), (1, "0" * 5)}
    texts = [(1, text), (1, "a" * 1000 + "zz"), (2, text)]
    assert found(spark, patterns, texts) == brute_force(patterns, texts)
