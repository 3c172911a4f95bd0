"""Column functions on hand-made values."""

import pytest
from pyspark.sql import functions as F

from siftlab.functions import answers as A, cards as CA, chemistry as CH, claims as CL, documents as D, folding, ids, names, numbers as N
from siftlab.functions import scoring as S, tasks as TK, units as U
from siftlab.operators import records as RC


@pytest.fixture
def ev(spark):
    """Evaluate a column function on a list of values."""

    def run(fn, values, schema="c0 string"):
        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
        n = len(schema.split(","))
        df = spark.createDataFrame(rows, f"_i int, {schema}")
        return [r.out for r in df.select("_i", fn(*[F.col(f"c{k}") for k in range(n)]).alias("out")).orderBy("_i").collect()]

    return run


def test_nfkc_and_canonical_text(ev):
    assert ev(folding.canonical_text, ["ＡＢ　c", "x²  Y z", None, "Straße", "plain"]) == ["ab c", "x2 y z", "", "strasse", "plain"]


def test_doi_profiles(ev):
    assert ev(lambda c: ids.canonical_doi(c, "join"), ["https://doi.org/10.1/AB.", "doi: 10.2/x; ", "**10.3/y**", None]) == ["10.1/ab", "10.2/x", "10.3/y", ""]
    got = ev(
        lambda c: ids.canonical_doi(c, "document"),
        ["**10.1002/adma.1**", "10.3390/](https://doi.org/10.3390/catal1", "10.1002/(a)b)", "10.12/x", "10.1234/a?b=1", "10.1021/x(y)"],
    )
    assert got == ["10.1002/adma.1", None, "10.1002/(a)b", None, "10.1234/a", "10.1021/x(y)"]
    wrapped = ["10.1002/adma.202109108**", "**10.1002/adma.202109108**", "`10.1002/adma.202109108`", "_10.1002/adma.202109108_"]
    assert set(ev(lambda c: ids.canonical_doi(c, "source"), wrapped)) == {"10.1002/adma.202109108"}


def test_citations(ev):
    want = "rag:chroma/c/doi:10.1002/adma.202109108#chunk:23"
    assert ev(ids.normalize_citation, ["rag:chroma/c/doi:10.1002/adma.202109108**#chunk:23", f"({want}).".lstrip("("), "free text"]) == [want, want, "free text"]
    assert ev(ids.citations_in_text, [f"see {want}; and {want}, rag:chroma/bad"]) == [[want]]


def test_document_doi(ev):
    texts = [
        "# Title\n\nDOI: 10.1002/CCTC.202200897\n",
        "Supporting information: https://doi.org/10.1002/cctc.202200897\n",
        "Link: http://dx.doi.org/10.1002/cctc.202200897\n",
        "See [paper](https://doi.org/10.1002/cctc.202200897).",
        "DOI: <https://doi.org/10.1002/cctc.202200897>",
        "# Title\n\nDOI: 10.1002/cctc.202200897\n\n## References\n- Ref A https://doi.org/10.1021/acs.jacs.0c00000\n",
    ]
    assert set(ev(D.document_doi, texts)) == {"10.1002/cctc.202200897"}


def test_reference_block(ev):
    text = "intro\nbody\n[1] A, B\n\n[2] C, D\n3. E, F\n"
    assert ev(D.drop_references, [text, "a\n[1] x\n[2] y", "a\nReferences\nb"]) == ["intro\nbody", "a\n[1] x\n[2] y", "a\n"]


def test_phone_numbers_are_no_reference_years(ev):
    tail = "\n[1] A\n[2] B"
    phone = "Call +1 (235) 555-2058 un. Gaó dotaie."
    assert ev(D.drop_references, ["a\n" + phone + tail, "a\nA. B. 1998-2003." + tail]) == ["a\n" + phone + tail, "a"]


def test_chunk_quality(ev):
    long = "This is a sufficiently long chunk with useful context and a metric like 0.83 V vs. RHE, so it is kept."
    got = ev(D.chunk_quality, ["### Oxygen Reduction Reaction", "### *Electrocatalytic O2 Reduction*", "### 0.83 V vs. RHE", "#### KEYWORDS: ORR; HEA", "short", long, " "])
    assert got == ["hard", "hard", "keep", "hard", "soft", "keep", "hard"]


def test_names(ev):
    assert ev(names.name_key, ["Pt–Fe/MWNT", "Pt-Fe/MWNT", "α-Fe2O3 (film)", "催化剂-1"]) == ["ptfemwnt", "ptfemwnt", "αfe2o3film", "催化剂1"]
    assert ev(names.is_generic_name, ["the Catalyst", "prepared samples", "Pt/C", None]) == [True, True, False, True]
    flags = ev(lambda n, e: names.vague_name_reasons(n, e), [("sample 3", ""), ("La1-xSrxMnO3", "over a range"), ("La1-xSrxMnO3", "")], "c0 string, c1 string")
    assert flags == [["anonymous_sample_code"], ["variable_composition_range"], []]


def test_numbers(ev):
    rows = ev(N.numeric_struct, [">= 90 %", "~1.2", "abc", "1e400", "-.5", None])
    assert [(r.comparator, r.value) if r else None for r in rows] == [(">=", 90.0), ("~", 1.2), None, None, ("", -0.5), None]
    assert ev(N.unit_suffix, ["≈ 3.5  S   m-1", "x"]) == ["S m-1", ""]
    assert ev(lambda v, u: N.stitch_value_unit(v, u), [("300", "mV"), ("98.5", "%"), ("300 mV", "mV"), ("", "V")], "c0 string, c1 string") == ["300 mV", "98.5%", "300 mV", None]


def test_metric_normalisation(ev):
    cases = [
        ("300.00 mV", "overpotential_10mAcm-2", "300 mV"),
        ("0.14 V", "overpotential_10mAcm-2", "140 mV"),
        (" -0.064 V", "potential_10mAcm-2", "-0.064 V"),
        ("95.0 %", "x", "0.95"),
        ("98.5%", "x", "0.985"),
        ("3.68 mA cm-2", "exchange_current_density", "3.68 mA cm-2"),
        ("0.00368 A cm-2", "exchange_current_density", "3.68 mA cm-2"),
        ("9 times greater than Pt/HSC", "exchange_current_density", None),
        ("cm-2", "x", None),
        ("5 mA/cm2", "partial_current_density", "5 mA cm-2"),
    ]
    got = ev(lambda v, k: U.metric_text(U.normalize_metric(v, k)), [(a, b) for a, b, _ in cases], "c0 string, c1 string")
    assert got == [c for _, _, c in cases]


def test_conditions_and_labels(ev):
    assert ev(U.condition_status, ["10 mA cm-2", "0.01 A cm-2", "20 mA cm-2", ""]) == ["ok", "ok", "mismatch", "unknown"]
    pairs = [("HER", ""), ("ORR", "E1/2"), ("HOR", "j0"), ("O5H", "FE"), ("EOR", "mass_activity"), ("CO2RR", "")]
    got = ev(lambda r, m: RC.infer_metric(r, m), pairs, "c0 string, c1 string")
    assert got == ["overpotential_10mAcm-2", "half_wave_potential", "exchange_current_density", "faradaic_efficiency", "mass_activity", "partial_current_density"]
    assert ev(TK.canonical_reaction, ["her", " CO2-RR ", "HZOR", "尿素氧化", ""]) == ["HER", "CO2RR", "HZOR", "UOR", None]
    assert ev(TK.canonical_task, ["Hz-OR", "anti-ferromagnetism", "电导率", "Thermal_Conductivity", "nope"]) == ["HZOR", None, "conductivity", "thermal_conductivity", None]


def test_composition(ev):
    a, b = ev(CH.parse_composition, ["Co(57%),Ni(23%)", "pt, ru"])
    assert (a.metals, a.percent) == (["Co", "Ni"], {"Co": 57.0, "Ni": 23.0})
    assert (b.metals, b.percent) == (["Pt", "Ru"], {})
    shares = ev(lambda c: CH.exact_percentages(c), [([1.0, 1.0, 1.0],), ([0.0, 0.0],), ([3.0, 5.0, 7.0, 11.0],)], "c0 array<double>")
    assert shares[0] == [33.34, 33.33, 33.33] and shares[1] == [50.0, 50.0]
    assert all(abs(sum(s) - 100) < 1e-9 for s in shares)
    assert ev(CH.formula_elements, ["a NiFeOOH film, In the Pt-Cu, and No"]) == [["Cu", "Fe", "H", "Ni", "O", "Pt"]]


def test_prediction_coercion(ev):
    cases = [
        ("7781 S cm-1", "S/m", 778100.0), ("0.865", "%", 86.5), ("0.53 W/(mK)", "W m-1 K-1", 0.53), ("2.27 A m2/kg", "emu/g", 2.27),
        ("250 K", "K", 250.0), ("0.3 V", "mV", 300.0), ("300", None, 300.0), ("300 mV", None, None), ("5 furlong", "mV", None), ("80%", "fraction_0_to_1", 0.8),
    ]
    got = ev(lambda v, u: U.coerce_prediction(v, u), [(a, b) for a, b, _ in cases], "c0 string, c1 string")
    assert got == [pytest.approx(c) if c is not None else None for _, _, c in cases]


def test_answer_objects(spark):
    rows = [
        (1, '<think>x</think><answer>{"a": 1}</answer>', '{"a": 1}'),
        (2, '{"think":"short","answer":{"a": 2}}', '{"a":2}'),
        (3, 'text {bad {"a": "}"} more', '{"a": "}"}'),
        (4, "nothing", None),
        (5, "{}", None),
    ]
    df = spark.createDataFrame(rows, "id int, r string, want string")
    assert all(r.answer == r.want for r in A.with_answer_object(df, "r").collect())


def test_reward(spark):
    df = spark.createDataFrame(
        [({"m": 300.0}, {"m": 300.0}, {"m": "mV"}), ({"m": 300.0}, {"m": 300.0, "x": 1.0}, {"m": "mV"}), ({"f": 1.0}, {"f": 0.0}, {"f": "fraction_0_to_1"}), ({"a": 1.0, "b": 1.0}, {"a": 1.0}, {})],
        "t map<string,double>, p map<string,double>, u map<string,string>",
    )
    got = [r.r for r in df.select(S.metric_reward(F.col("t"), F.col("p"), F.col("u")).alias("r")).collect()]
    assert got == [pytest.approx(1.0), 0.0, pytest.approx(2.718281828459045 ** (-1 / 1.05)), pytest.approx(0.5)]


def test_claims(ev):
    claim = "Property Type: conductivity\nPerformance Metrics: 100 S/m (Confidence: low)\nPerformance Metrics: 7781 S cm-1 conductivity (Confidence: medium)\n"
    line = ev(CL.metric_line, [claim, "none"])
    assert line == ["7781 S cm-1 conductivity (Confidence: medium)", None]
    cases = [
        ("conductivity", "7781 S cm-1", 778100.0), ("conductivity", "46.65 mS/cm", 4.665), ("conductivity", "12 mS m-1", 0.012),
        ("photothermal_conversion_efficiency", "efficiency = 0.865", 86.5), ("thermal_conductivity", "0.53 W m-1 K-1", 0.53),
        ("ferromagnetism", "Ms = 2.27 A m2/kg", 2.27), ("antiferromagnetism", "TN = 250 K", 250.0), ("antibacterial", "minimum_concentration=8 ug/mL", 8.0),
        ("thermoelectric", "figure_of_merit=1.3", 1.3), ("CO2RR", "FE(HCOOH)=85%; j(HCOOH)=2 mA cm-2", 85.0), ("HER", "291 ± 2 mV at 10 mA cm-2; 900 mV at 100 mA", 291.0),
    ]
    got = ev(lambda t, m: CL.claim_metric(t, m)["value"], [(a, b) for a, b, _ in cases], "c0 string, c1 string")
    assert got == [pytest.approx(c) for _, _, c in cases]
    points = [("305-345 mV", "HER", "345 mV"), ("0.8 to 0.85 V", "ORR", "0.8 V"), ("291.5 +/- 0.5 mV", "HER", "292.0 mV"), ("10 mV", "HER", "10 mV")]
    assert ev(lambda m, t: CL.single_point(m, t), [(a, b) for a, b, _ in points], "c0 string, c1 string") == [c for _, _, c in points]


def test_cards(ev):
    card = ev(CA.parse_card, ["MaterialCard | TASK=HER; MATERIAL=Pt/C; ELEMENTS=Pt, C; ANCHOR=30 mV; X=1; MATERIAL=Pt2", "no card"])
    assert card[1] is None
    assert (card[0].kind, card[0].task_type, card[0].material_name, card[0].components, card[0].performance) == ("material_card", "HER", "Pt2", ["Pt", "C"], "30 mV")
    blocks = ev(CA.guideline_blocks, ["head\n[G0]. one\n  more\n[12]. two"])
    assert [(b.id, b.text) for b in blocks[0]] == [("G0", "one more"), ("G12", "two")]
