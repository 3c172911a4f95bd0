"""Operators on small hand-made frames, checked against plain Python."""

import itertools
import math
import random
import re
import statistics

import pytest
from pyspark.sql import functions as F

from siftlab.functions import fixed as K
from siftlab.operators import binding as B, chunking as C, distributions as D, evaluation as E, feedback as FB, joins as J
from siftlab.operators import notes as NT, quality as Q, ranking as R, records as RC, retrieval as RT, sampling as S, sets

OBS = "task_type string, doi string, material_identity string, context_key string, label_key string, status string, ready boolean, source_file string, row_number int, extraction_index int, material_index int"


def _obs(spark, rows):
    full = [("HER", "10.1/a", "m", ctx, label, status, ready, "f", i, 0, 0) for i, (ctx, label, status, ready) in enumerate(rows)]
    return spark.createDataFrame(full, OBS)


def test_duplicates_conflicts_and_selection(spark):
    obs = _obs(spark, [("c1", "x", "direct", True), ("c1", "x", "recoverable", False), ("c1", "y", "direct", True), ("c2", "z", "recoverable", True)])
    total = [r for r in Q.cross_record_report(obs).collect() if r.task_type == "ALL"][0]
    assert (total.duplicate_groups, total.rows_removed, total.conflict_groups, total.conflict_rows) == (1, 1, 1, 3)
    assert (total.multi_context_entities, total.trainable, total.ready) == (1, 1, 1)
    outcomes = sorted(r.outcome for r in Q.select_candidates(obs).collect())
    assert outcomes == ["conflicting_context", "conflicting_context", "exact_duplicate", "selected"]
    assert {r.status for r in Q.best_of_group(obs).where("label_key = 'x'").collect()} == {"direct"}
    assert Q.select_candidates(obs).count() == obs.count()


def test_fingerprint_is_order_free(spark):
    from siftlab.sources.sinks import fingerprint

    df = spark.range(500).select("id", (F.col("id") * 7 % 11).alias("v"))
    prints = {df.repartition(n).agg(fingerprint(["id", "v"])).collect()[0][0] for n in (1, 3, 8)}
    assert len(prints) == 1


def test_truth_join_precedence(spark):
    records = spark.createDataFrame([("HER", "a", 1, 1), ("HER", "a", 9, 2), ("HER", "b", 1, 3)], "task_type string, doi string, row_number int, id int")
    truth = spark.createDataFrame(
        [("HER", "a", 1, "c", "l1"), ("HER", "a", None, "c", "l2"), ("HER", "a", 1, "c", "l1")],
        "task_type string, doi string, row_number int, context string, label string",
    )
    got = {r.id: (r.join_mode, r.n_targets, r.n_unique, r.has_conflict) for r in B.truth_join(records, truth).collect()}
    assert got == {1: ("task_doi_row", 2, 1, False), 2: ("task_doi", 3, 2, True), 3: ("none", 0, 0, False)}
    assert [(r.id, r.label) for r in B.unambiguous_targets(records, truth).collect()] == [(1, "l1")]


def test_binding_by_name_against_brute_force(spark):
    rng = random.Random(3)
    words = ["Pt-Fe/MWNT", "Pt–Fe", "PtFe/MWNT film", "Cu2O", "Cu", "catalyst", "ZnO (film)", "O"]
    materials = [(f"d{rng.randrange(25)}", i, rng.choice(words)) for i in range(60)]
    asks = [(f"d{rng.randrange(27)}", i, rng.choice(words + ["", ""]), "the " + rng.choice(words) + " sample") for i in range(120)]
    m = spark.createDataFrame(materials, "doi string, material_index int, name string")
    x = spark.createDataFrame(asks, "doi string, extraction_id int, name string, evidence string")
    key = lambda s: re.sub("[^0-9a-z]+", "", s.lower())
    generic = lambda s: s == "catalyst"

    def expect(doc, name, evidence):
        own = [(i, n) for d, i, n in materials if d == doc]
        if name:
            exact = [(i, n) for i, n in own if key(n) == key(name)]
            if len(exact) == 1 and not generic(exact[0][1]):
                return "direct", exact[0][0]
            near = [(i, n) for i, n in own if key(n) in key(name) or key(name) in key(n)]
            if len(near) == 1 and not generic(near[0][1]):
                return "recoverable", near[0][0]
            if len(own) == 1 and not generic(own[0][1]):
                return "recoverable", own[0][0]
            return "manual_review", None
        if len(own) == 1 and not generic(own[0][1]):
            return "direct", own[0][0]
        seen = [(i, n) for i, n in own if key(n) in key(evidence)]
        if len(seen) == 1 and not generic(seen[0][1]):
            return "recoverable", seen[0][0]
        return "manual_review", None

    got = {r.extraction_id: (r.status, r.material_index) for r in B.bind_by_name(x, m).collect()}
    assert got == {i: expect(d, n, e) for d, i, n, e in asks}


def test_similar_sets_loses_no_pair(spark):
    rng = random.Random(1)
    pool = "abcdefgh"
    left = [rng.sample(pool, rng.randint(1, 5)) for _ in range(60)]
    right = [rng.sample(pool, rng.randint(1, 5)) for _ in range(60)]
    for t in (0.3, 0.5, 1.0):
        want = {
            (",".join(sorted(a)), ",".join(sorted(b)))
            for a, b in itertools.product(left, right)
            if len(set(a) & set(b)) / len(set(a) | set(b)) >= t - 1e-12
        }
        frames = [spark.createDataFrame([(s,) for s in side], "components array<string>") for side in (left, right)]
        assert {(r.left_set, r.right_set) for r in J.similar_sets(*frames, t).collect()} == want


def test_grades(spark):
    cases = [
        ("HER", None, 120.0, "Good"), ("OER", None, 380.0, "Poor"), ("HOR", None, 1.2, "Fair"), ("UOR", None, 1.38, "Good"), ("HZOR", None, -80.0, "Outstanding"),
        ("HZOR", None, 150.0, "Poor"), ("EOR", None, 25.0, "Outstanding"), ("conductivity", None, 1e-2, "Poor"), ("conductivity", None, 9e-3, "Terrible"),
        ("antibacterial", None, 8.0, "Outstanding"), ("CO2RR", "CO", 77.0, "Poor"), ("CO2RR", "C3+", 18.0, "Fair"), ("CO2RR", "CH4", 58.0, "Good"), ("CO2RR", None, 0.95, "Outstanding"),
        ("CO2RR_current", None, -100.0, "Good"), ("nonsense", None, 1.0, "Terrible"), ("furfural_hydrogenation", None, 59.9, "Terrible"),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, t string, p string, v double")
    got = {r.i: r.grade for r in J.grade_values(df, "t", "v", "p").collect()}
    assert got == {i: c[3] for i, c in enumerate(cases)}


def test_task_ranking(spark):
    items = spark.createDataFrame(
        [(1, 0, "Good", 1e8, ""), (1, 1, "Good", 1.0, ""), (1, 2, "Good", None, ""), (1, 3, None, None, "failed"), (1, 4, "Outstanding", 4.0, None)],
        "q int, pos int, grade string, metric_value double, error string",
    )
    order = [r.pos for r in R.rank_tasks(items, ["q"]).orderBy("rank").collect()]
    assert order == [4, 0, 1, 2, 3]
    assert [r.pos for r in R.top_tasks(items, ["q"], 4).orderBy("rank").collect()] == [4, 0, 1, 2]


def test_reward_reports(spark):
    rows = [(1, 1.0), (1, 1.0), (2, 0.0), (2, 0.0), (3, 0.0), (3, 0.7)]
    runs = spark.createDataFrame(
        [(i, q, "HER" if q < 3 else "OER", r, "", "judged", 0, 1.0) for i, (q, r) in enumerate(rows)],
        "id int, dataset_index int, task_type string, reward double, reasoning string, stage string, tool_calls int, time_cost double",
    )
    got = E.group_outcomes(runs).collect()[0]
    assert (got.all_correct, got.all_wrong, got.partial_reward, got.estimated_update_calls) == (1, 1, 1, 4)
    assert got.partial_group_rate == pytest.approx(1 / 3)
    assert E.reward_by_task(runs).count() == 19
    summary = E.reward_summary(runs).collect()[0]
    assert (summary.macro_task_reward, summary.min_task_reward) == (pytest.approx((0.5 + 0.35) / 2), pytest.approx(0.35))


def test_feedback_errors_and_combination(spark):
    base = "task_type string, recommendation_id string, actual double, unit string, metric string"
    fb = spark.createDataFrame([("CO2RR", " ", 1.5, "mA cm-2", "partial_current_density")], base)
    rec = spark.createDataFrame([("rec-1", "Ni")], "recommendation_id string, components string")
    ranked = spark.createDataFrame([("rec-1", "CO2RR", 0, 9.0), ("rec-1", "CO2RR", 1, 2.5)], "recommendation_id string, task_type string, pos int, predicted double")
    row = FB.with_errors(FB.pair_predictions(fb, rec, ranked, default_id="rec-1")).collect()[0]
    assert (row.rel_error, row.abs_error) == (pytest.approx(2 / 3), pytest.approx(1.0))
    records = spark.createDataFrame(
        [(1, 1, "CO2RR", "partial_current_density", 5, 2 / 3, 0.0), (1, 1, "CO2RR", "faradaic_efficiency", 6, 0.05 / 0.35, 0.0), (1, 2, "HER", "x", 7, 0.1, 0.9)],
        "job int, csv_row int, task_type string, metric_key string, pos int, rel_error double, score double",
    )
    got = {r.metric_key: r for r in FB.combine_metrics(records, ["job", "csv_row"], "pos").collect()}
    assert set(got) == {K.COMBINED_METRIC, "x"}
    assert got[K.COMBINED_METRIC].rel_error == pytest.approx((2 / 3 + 0.05 / 0.35) / 2)
    assert got[K.COMBINED_METRIC].pos == 5


def test_disjoint_split_invariants(spark):
    rng = random.Random(8)
    rows = [(f"t{rng.randrange(3)}", f"d{rng.randrange(60)}", i) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, doc string, id int")
    split = S.disjoint_split(df, "g", "doc", "id", 8, 4, 1).collect()
    docs = [r.doc for r in split]
    assert len(docs) == len(set(docs)) == 3 * 12
    assert sum(r.split == "train" for r in split) == 24
    again = {r.id for r in S.disjoint_split(df.repartition(5), "g", "doc", "id", 8, 4, 1).collect()}
    assert again == {r.id for r in split}
    with pytest.raises(ValueError):
        S.disjoint_sample(df, "g", "doc", "id", 50, 1)
    with pytest.raises(ValueError):
        S.balanced_sample(df, "g", "id", 1000, 1)
    with pytest.raises(ValueError):
        S.check_source(df, "g", "doc", ["t0", "t1", "t2"])


def test_round_robin_prefixes(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(2)] + [(None, 9)], "g string, id int")
    out = [r.g for r in S.round_robin(df, "g", "id", ["b"]).orderBy("position").collect()]
    assert out == [None, "b", "a", "b", "a", "a", "a", "a"]


def test_histogram_rules(spark):
    df = spark.createDataFrame([("m", float(x)) for x in [1, 2, 4, 8, 16]] + [("one", 3.0)] * 4, "g string, v double")
    stats = {r.g: r for r in D.basic_stats(df, ["g"], "v").collect()}
    assert stats["m"].p05 == pytest.approx(1.2) and stats["one"].stdev == 0.0
    bins = {}
    for r in D.histogram(df, ["g"], "v").collect():
        bins.setdefault(r.g, []).append(r["count"])
    assert sum(bins["m"]) == 5 and len(bins["m"]) == 5 and bins["one"] == [4]


def test_notes(spark):
    notes = spark.createDataFrame([("0", "plain"), ("1", "MaterialCard | TASK=HER"), ("2", "old")], "note_id string, content string")
    ops = spark.createDataFrame(
        [(0, "UPDATE", "0", "MaterialCard | TASK=OER"), (1, "UPDATE", "1", "short"), (2, "UPDATE", "1", "longer text"), (3, "DELETE", "2", None), (4, "UPDATE", "2", "x"), (5, "ADD", None, " plain "), (6, "UPDATE", "77", "new one"), (7, "ADD", None, "fresh")],
        "pos int, operation string, note_id string, content string",
    )
    got = {r.note_id: r.content for r in NT.merge_operations(notes, ops).collect()}
    assert got == {"0": "plain", "1": "longer text", "3": "fresh", "4": "MaterialCard | TASK=OER", "5": "new one"}


def test_chunks_cover_the_text(spark):
    rng = random.Random(2)
    words = [f"w{i}" + ("." if rng.random() < 0.1 else "") for i in range(1000)]
    text = "# one\n" + " ".join(words[:600]) + "\n## two\n" + " ".join(words[600:]) + "\n# empty\n"
    chunks = C.chunk_documents(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text", 100, 20).orderBy("chunk_index").collect()
    assert all(len(c.text.split()) <= 100 for c in chunks)
    seen = set(w for c in chunks for w in c.text.split())
    assert seen == set(words) | {"#", "##", "one", "two", "empty"}
    assert {c.total_chunks for c in chunks} == {len(chunks)}
    for a, b in zip(chunks, chunks[1:]):
        if "##" not in b.text and not b.text.startswith("#"):
            assert a.text.split()[-1] in b.text.split() or a.text.split()[-1].endswith(".")


def test_chunk_ids(spark):
    rows = [(0, "10.1000/abc.def", 0, "t1", "HER"), (1, "10.1000/abc.def", 0, "t2", "HER"), (2, "", None, "same", "OER"), (3, None, 4, "same", "OER")]
    df = spark.createDataFrame(rows, "pos int, doc_id string, chunk_index int, text string, reaction_type string")
    ids = [r.chunk_id for r in C.with_chunk_ids(df, "pos").orderBy("pos").collect()]
    assert ids[0] == "10.1000/abc.def#chunk:0" and re.fullmatch(r"10\.1000/abc\.def#chunk:0#dup:[0-9a-f]{16}", ids[1])
    assert re.fullmatch("hash_[0-9a-f]{64}", ids[2]) and ids[3].startswith(ids[2] + "#dup:")


def test_vector_search_paths_agree(spark):
    rng = random.Random(4)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(6)]
    vs = spark.createDataFrame([(i, vec(), f"d{i % 5}", "HER" if i % 2 else "OER") for i in range(200)], "id int, embedding array<double>, doc_id string, task_type string")
    qs = spark.createDataFrame([(i, vec(), ["HER"] if i else None, "D3") for i in range(3)], "qid int, embedding array<double>, tasks array<string>, masked_doc string")
    a = sorted(map(tuple, RT.vector_top_k(vs, qs, 7).collect()))
    b = sorted(map(tuple, RT.vector_top_k(vs, qs, 7, grid=2).collect()))
    assert a == b and len(a) == 21
    cos = lambda x, y: sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y))
    rows, first = vs.collect(), [q for q in qs.collect() if q.qid == 1][0]
    want = sorted(((cos(first.embedding, r.embedding), str(r.id)) for r in rows if r.task_type == "HER" and r.doc_id != "d3"), reverse=True)[:7]
    assert [x[1] for x in a if x[0] == "1"] == [w[1] for w in sorted(want, key=lambda w: w[1])]


def test_hash_vector_retrieval(spark):
    notes = spark.createDataFrame([("G0", "general unit discipline"), ("G1", "co2rr faradaic efficiency of copper")], "id string, text string")
    vs = notes.select("id", C.hash_embedding("text", 64).alias("embedding"), F.col("id").alias("doc_id"), F.lit("x").alias("task_type"))
    qs = spark.createDataFrame([("q", "copper CO2RR")], "qid string, text string").select(
        "qid", C.hash_embedding("text", 64).alias("embedding"), F.lit(None).cast("array<string>").alias("tasks"), F.lit(None).cast("string").alias("masked_doc")
    )
    assert RT.vector_top_k(vs, qs, 1).collect()[0].id == "G1"


def test_embedder_errors_become_nulls(spark):
    def embed(texts):
        if any("bad" in x for x in texts):
            raise RuntimeError("no")
        return [[float(len(x))] for x in texts]

    df = spark.createDataFrame([(i, "bad" if i == 3 else "x" * i) for i in range(8)], "id int, text string")
    got = {r.id: (r.embedding, r.error) for r in C.embed_with(df, "id", "text", embed, batch=4).collect()}
    assert got[3] == (None, "no") and got[5] == ([5.0], None)


def test_record_cleaning(spark):
    rows = [
        ("1", "hor.jsonl", "HOR", ["Pt", "Ru"], "", {"exchange_current_density": "3.68 mA cm-2", "overpotential_10mAcm-2": None, "pos": "33"}),
        ("2", "x", "HER", ["Mo"], "", {"overpotential": "0.18 V"}),
        ("3", "x", "HZOR", ["Cu"], "", {"overpotential_10mAcm-2": "0.36 V"}),
        ("4", "x", "O5H", ["Co"], "", {"Faradaic_efficiency": "98.5%", "FDCA_yield": "99.6%"}),
        ("5", "x", "UOR", ["Ni"], "", {"overpotential": "0.2 V", "potential": "1.4 V"}),
        ("6", "x", "XYZ", ["Ni"], "", {}),
        ("7", "x", "HER", [], "", {"overpotential": "1 V"}),
    ]
    df = spark.createDataFrame(rows, "id string, source string, reaction_type string, metals array<string>, material_name string, metrics map<string,string>")
    got = {r.id: r for r in RC.clean_records(df).collect()}
    assert got["1"].metrics_gt == {"exchange_current_density": "3.68 mA cm-2"} and got["1"].metals == ["Pt", "Ru"]
    assert got["2"].metrics_gt == {"overpotential_10mAcm-2": "180 mV"} and got["3"].metrics_gt == {"overpotential_10mAcm-2": "360 mV"}
    assert got["4"].metrics_gt == {"faradaic_efficiency": "0.985"} and got["4"].units == {"faradaic_efficiency": "fraction_0_to_1"}
    assert got["5"].metrics_gt == {"potential_10mAcm-2": "1.4 V"} and "duplicate_metric_prefer_potential" in got["5"].dropped
    assert (got["6"].drop_reason, got["7"].drop_reason) == ("unknown_reaction_type", "missing_material_identity")


def test_set_helpers(spark):
    a, b = spark.range(5), spark.range(3, 9)
    row = sets.set_report(a, b, ["id"]).collect()[0]
    assert (row.shared, row.missing, row.extra, row.equal) == (2, 3, 4, False)
    with pytest.raises(ValueError):
        sets.assert_disjoint(a, b, ["id"])


def test_round_robin_order(spark):
    df = spark.createDataFrame([("a", i) for i in range(5)] + [("b", i) for i in range(2)] + [(None, 9)], "g string, id int")
    got = [(r.g, r.id) for r in S.round_robin(df, "g", "id", ["b"]).orderBy("position").collect()]
    assert got == [(None, 9), ("b", 0), ("a", 0), ("b", 1), ("a", 1), ("a", 2), ("a", 3), ("a", 4)]


def test_block_join_sizes(spark, monkeypatch):
    monkeypatch.setattr(RT, "MAX_QUERIES", 1)
    vs = spark.createDataFrame([(i, [float(i), 1.0], "d", "t") for i in range(9)], "id int, embedding array<double>, doc_id string, task_type string")
    qs = spark.createDataFrame([(i, [1.0, float(i)], None, None) for i in range(3)], "qid int, embedding array<double>, tasks array<string>, masked_doc string")
    assert RT.vector_top_k(vs, qs, 2).count() == 6


@pytest.mark.parametrize("points,cells", [(240, 4), (24, 1)])
def test_binned_density_stays_within_its_error_of_the_exact_curve(spark, points, cells):
    rng = random.Random(5)
    rows = [("normal", rng.gauss(3, 2)) for _ in range(400)] + [("ties", float(rng.randint(0, 4))) for _ in range(90)]
    rows += [(None, rng.expovariate(1)) for _ in range(60)] + [("few", 1.0), ("few", 2.0), ("flat", 1.0), ("flat", 1.0), ("flat", 1.0), ("normal", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    exact = {(r["g"], r["point"]): r for r in D.density_curve(df, ["g"], "v", points).collect()}
    binned = {(r["g"], r["point"]): r for r in D.binned_density_curve(df, ["g"], "v", points, cells).collect()}
    shape = {r["g"]: r for r in D.histogram_shape(df, ["g"], "v").collect()}
    assert exact.keys() == binned.keys() and {g for g, _ in binned} == {"normal", "ties", None}
    for g in ("normal", "ties", None):
        values = [v for k, v in rows if k == g and v is not None]
        h = 1.06 * statistics.stdev(values) * len(values) ** -0.2
        step = (max(values) - min(values)) / (cells * (points - 1))
        bound = len(values) * shape[g]["width"] / (h * math.sqrt(2 * math.pi)) * step**2 / (8 * h**2)
        for p in range(points):
            assert abs(binned[g, p]["x"] - exact[g, p]["x"]) < 1e-9
            assert abs(binned[g, p]["y"] - exact[g, p]["y"]) <= bound + 1e-9


def test_scored_pairs_are_the_scored_rows_of_all_pairs(make):
    fb = make(
        [(1, "HER", "r1", 2.0, "mV"), (2, "OER", "r1", 2.0, "mV"), (3, "HER", " ", 1.0, "mV"), (4, "nope", "r1", 1.0, "mV"), (5, "HER", "r2", None, "mV"),
         (6, "HER", "r2", 3.0, "mV"), (7, "HER", "r9", 3.0, "mV"), (8, None, "r1", 1.0, "mV"), (9, "HER", "r3", 1.0, "mV"), (10, "UOR", "r1", 4.0, "mV")],
        "id int, task_type string, recommendation_id string, actual double, unit string",
    )
    rec = make([("r1", "a"), ("r2", "b"), ("r3", "c"), ("r1", "a")], "recommendation_id string, components string")
    ranked = make(
        [("r1", "HER", 0, 1.0), ("r1", "HER", 1, 5.0), ("r1", "UOR", 0, 7.0), ("r2", "HER", 0, 1.0), ("r2", "HER", 1, None), ("r9", "HER", 0, 1.0), (None, "HER", 0, 1.0)],
        "recommendation_id string, task_type string, pos int, predicted double",
    )
    for default in (None, "r1"):
        whole = FB.pair_predictions(fb, rec, ranked, default).where("stage = 'scored'")
        some = FB.scored_pairs(fb, rec, ranked, default)
        assert some.columns == whole.select(*some.columns).columns and set(some.columns) == set(whole.columns)
        assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.select(*some.columns).collect()))
        assert some.count() == (2 if default is None else 3)


def test_first_scored_pairs_hold_the_first_records_of_all(make, monkeypatch):
    rows = [(i, "HER", f"r{i}" if i % 7 == 3 else "gone", 2.0, "mV") for i in range(200)]
    fb = make(rows, "id int, task_type string, recommendation_id string, actual double, unit string")
    rec = make([(f"r{i}", "a") for i in range(200)], "recommendation_id string, components string")
    ranked = make([(f"r{i}", "HER", 0, 1.0) for i in range(200)], "recommendation_id string, task_type string, pos int, predicted double")
    whole = [r["id"] for r in FB.cap_records(FB.scored_pairs(fb, rec, ranked), ["id"], 5).collect()]
    assert whole == [3, 10, 17, 24, 31]
    some = FB.first_scored_pairs(fb, rec, ranked, ["id"], 5)
    assert [r["id"] for r in FB.cap_records(some, ["id"], 5).collect()] == whole
    assert some.count() < FB.scored_pairs(fb, rec, ranked).count()
    assert FB.first_scored_pairs(fb, rec, ranked, ["id"], 50).count() == 29
    monkeypatch.setattr(FB, "HEAD_ROWS", 1)
    assert [r["id"] for r in FB.cap_records(FB.first_scored_pairs(fb, rec, ranked, ["id"], 5), ["id"], 5).collect()] == whole


def test_ranked_items_are_dealt_once_for_scored_pairs(make):
    fb = make([(1, "HER", "r1", 2.0, "mV")], "id int, task_type string, recommendation_id string, actual double, unit string")
    rec = make([("r1", "a")], "recommendation_id string, components string")
    ranked = make([("r1", "HER", 0, 1.0)], "recommendation_id string, task_type string, pos int, predicted double")
    plan = FB.scored_pairs(fb, rec, ranked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(_rec") <= 3 and "hashpartitioning(_rec#" in plan
    assert not re.search(r"hashpartitioning\(_rec#\d+, task_type", plan)


def test_compliance_funnel_parses_an_answer_once(spark):
    from siftlab.plans.registry import REGISTRY, Tables
    from siftlab.plans import load_all

    load_all()
    df = REGISTRY["agg27_compliance_funnel"].build(Tables(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # The two halves of the union share one aggregate; each shows the expression once.
    assert 0 < plan.count("from_json") <= 2


def test_citations_are_normalised_as_by_their_pattern(make):
    from siftlab.functions import ids

    p = "rag:chroma/"
    cases = {
        p + "c/doi:10.1/x1#chunk:5": p + "c/doi:10.1/x1#chunk:5",
        p + "c/doi:10.1/X1#chunk:007": p + "c/doi:10.1/x1#chunk:7",
        p + "a#chunk:b/doi:**10.1/x**#chunk:12).": p + "a#chunk:b/doi:10.1/x#chunk:12",
        p + " c /doi:10.1/x.#chunk:1\n": p + "c/doi:10.1/x#chunk:1",
        p + "c/doi:10.1/x#chunk:1\nmore": p + "c/doi:10.1/x#chunk:1\nmore",
        p + "c/d/doi:10.1/x#chunk:1": p + "c/d/doi:10.1/x#chunk:1",
        p + "c/doi:10.1/x#chunk:" + "9" * 30: None,
    }
    got = make([(k,) for k in cases], "t string").select("t", ids.normalize_citation("t").alias("n")).collect()
    assert {r.t: r.n for r in got} == cases


def test_cited_evidence_is_dealt_out(spark):
    from siftlab.plans.registry import REGISTRY, Tables
    from siftlab.plans import load_all

    load_all()
    df = REGISTRY["jon17_cited_evidence"].build(Tables(spark, "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RoundRobinPartitioning") >= 2


def test_candidate_counts_equal_the_counts_of_selected_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["c1", "c2", None]), rng.choice("xyz"), rng.choice(Q.STATUSES), True) for _ in range(40)]
    for more in ([], [("c9", "x", "odd", True), ("c9", "x", None, True)]):
        obs = _obs(spark, rows[: 5 + 30 * bool(more)] + more)
        want = sorted(map(str, Q.selection_counts(Q.select_candidates(obs)).collect()))
        assert sorted(map(str, Q.candidate_counts(obs).collect())) == want
        complete = F.col("row_number") % 2 == 0
        some = sorted(map(str, Q.selection_counts(Q.select_candidates(obs, complete)).collect()))
        assert sorted(map(str, Q.candidate_counts(obs, complete).collect())) == some
    plan = Q.candidate_counts(_obs(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "SortAggregate" not in plan


def test_density_sums_kernels_batch_by_batch(spark):
    rng = random.Random(9)
    rows = [(g, rng.choice([rng.gauss(0, 1), 1.0])) for g in ("a", None) for _ in range(60)] + [("b", 1.0), ("b", 1.0), ("b", 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    out = D.density_curve(df, ["g"], "v", 8)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan
    got = {(r["g"], r["point"]): r for r in out.collect()}
    assert {g for g, _ in got} == {"a", None} and len(got) == 16
    frame = {r["g"]: r for r in D._density_frame(df, ["g"], "v").collect()}
    for (g, point), r in got.items():
        f, values = frame[g], [v for k, v in rows if k == g and v is not None]
        x = f["lo"] + point * (f["hi"] - f["lo"]) / 7
        y = sum(math.exp(-0.5 * ((x - v) / f["h"]) ** 2) for v in values) * f["width"] / (f["h"] * math.sqrt(2 * math.pi))
        assert abs(r["x"] - x) < 1e-9 and abs(r["y"] - y) < 1e-9
