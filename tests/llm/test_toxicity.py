import random

from siftlab.llm import queries, toxicity
from tests.llm.samples import docs_frame, document, words

LABELS = "doc_id long, quality int, toxic int, score string"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = queries.op10_toxicity(spark, folder).collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    held = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(t == p for t, p in held) / len(held) > 0.93
    assert sum(p and not t for t, p in held) <= 1
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)


def corpus():
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(300):
        text = words(rng, 60, "abcdefghij").split()
        bad = i % 4 == 0
        if bad:
            for _ in range(4):
                text[rng.randrange(60)] = rng.choice(["zzworm", "zzslime", "zzrot"])
        rows.append(document(i, " ".join(text)))
        marks.append((i, 1, int(bad), "s"))
    return rows, marks


def test_labels_are_learned_and_awkward_rows_pass(spark):
    rows, marks = corpus()
    extra = [document(None, "a zzworm zzslime zzrot zzworm b"), document(901, None), document(902, ""), document(902, ""), document(903, "ab " * 50_000)]
    odd = [(None, 1, 1, "s"), (904, 1, None, "s"), (0, 1, 0, "s")]
    frame, labels = docs_frame(spark, rows + extra), spark.createDataFrame(marks + odd, LABELS)
    got = toxicity.score_documents(frame, labels).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == 305
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert sum((r["doc_id"] % 4 == 0) == bool(r["predicted"]) for r in held) / len(held) > 0.95
    assert not by_id[901]["predicted"] and by_id[901]["score"] == by_id[902]["score"]
    assert by_id[None]["held_out"] is False
    passed = toxicity.with_toxicity(frame, labels, score_col="_s")
    assert passed.columns == [*frame.columns, "_s"] and passed.count() == 305


def test_no_labels_or_documents(spark):
    rows, marks = corpus()
    one_class = spark.createDataFrame([m for m in marks if not m[2]], LABELS)
    assert {r["score"] for r in toxicity.score_documents(docs_frame(spark, rows[:5]), one_class).collect()} == {0.0}
    assert toxicity.score_documents(docs_frame(spark, []), spark.createDataFrame([], LABELS)).count() == 0


def test_word_ratio_uses_shared_backoff(spark):
    rows, marks = corpus()
    shipped, _ = toxicity.train(docs_frame(spark, rows), spark.createDataFrame(marks, LABELS))
    import pyarrow as pa

    data, starts, ends, _ = toxicity.plain_words(pa.array(["zzworm zzwo zzz abc"], pa.large_string()))
    ratio = shipped.value.word_ratios(data, starts, ends)
    assert ratio[0] > 3 and abs(ratio[3]) < 3


def test_driver_holds_one_part_of_the_counts(spark):
    names = [f"{c}_{part}" for part in ("0", "1", "both") for c in toxicity._TABLE[1:]]
    kinds = [f"{c} {'tinyint' if 'left' in c or 'follow' in c else 'float'}" for c in names]
    rows = [(b, None if b == 5 else b + 1, *[None if "_0" in c and b == 9 else b % 60 for c in names]) for b in (5, 9, 70_000, (1 << 20) - 1)]
    rows = [(b, c, *[v if v is None or "left" in n or "follow" in n else float(v) for n, v in zip(names, more, strict=True)]) for b, c, *more in rows]
    frame = spark.createDataFrame(rows, "bucket long, context long, " + ", ".join(kinds))
    table = toxicity._fetch(frame, "0")
    assert set(table) == {"context", *(n for n in names if n.endswith("_0"))}
    assert sum(v.nbytes for v in table.values()) <= 24 << 20
    for at in (9, 70_000, (1 << 20) - 1):
        assert table["context"][at] == at + 1
        assert {int(v[at]) for n, v in table.items() if n != "context"} == {0 if at == 9 else at % 60}
    assert table["toxic_0"].sum() == 5 + 70_000 % 60 + ((1 << 20) - 1) % 60
