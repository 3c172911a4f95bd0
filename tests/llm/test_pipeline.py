import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from siftlab.llm import simhash
from siftlab.llm.queries import tokenizer_file
from tests.llm.samples import docs_frame, document, words

FOLDER = "/root/testdata/sf0.001"


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "token_output"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("k", range(5))
def test_each_stage_takes_awkward_and_empty_tables(spark, k):
    _, stage = corpus_pipeline.STAGES[k]
    frame = docs_frame(spark)
    out = stage(spark, frame, FOLDER)
    if k < 4:
        assert out.columns == frame.columns
    rows = out.collect()
    if k == 1:
        ids = [r["doc_id"] for r in rows]
        assert len(ids) == len(set(ids)) and 4 in ids and 5 not in ids and 6 not in ids and {7, 8, 9, 10, 11} <= set(ids)
    elif k in (0, 2, 4):
        assert len(rows) == frame.count()  # nothing toxic or leaked in it
    assert stage(spark, docs_frame(spark, []), FOLDER).count() == 0


def test_run_equals_its_stages_by_hand(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    kept = {r["doc_id"]: r for r in docs}
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = spark.createDataFrame(stage(spark, frame, FOLDER).collect(), frame.schema)
        for r in frame.collect():
            assert r == kept[r["doc_id"]]  # rows pass unchanged
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    want, start = [], 0
    for r in sorted(frame.collect(), key=lambda r: r["doc_id"]):
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect()) == sorted(want)


def test_near_dedup_leaves_one_of_each_group(spark):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    left = corpus_pipeline.near_dedup(spark, frame, FOLDER)
    texts = [r["text"] for r in left.collect()]
    assert len(texts) == len(set(texts))
    assert simhash.similar_documents(left).where("not kept").count() == 0


def test_near_dedup_judges_rows_and_not_ids(spark):
    rng = random.Random(31)
    texts = [words(rng, 80) for _ in range(9)]
    copy = texts[0].replace(" ", "  ")
    rows = [document(1, texts[0]), document(1, texts[1]), document(1, texts[1]), document(2, copy), document(2, texts[2])]
    rows += [document(None, texts[k]) for k in (3, 4, 5, 5, 1)] + [document(None, copy), document(3, texts[6]), document(3, texts[6].replace(" ", "\t"))]
    left = sorted((r["doc_id"] or 0, r["text"].split()) for r in corpus_pipeline.near_dedup(spark, docs_frame(spark, rows), FOLDER).collect())
    want = [(0, 3), (0, 4), (0, 5), (1, 0), (1, 1), (2, 2), (3, 6)]
    assert left == sorted((i, texts[k].split()) for i, k in want)
