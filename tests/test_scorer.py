"""Label rules, strata, levels and paired callers, by hand-made rows."""

import pytest
from strandlake.operators import scorer

CORPUS = "case_id long, accession string, panel string, record_scope string, expected_class string, expected_superfamily string"
RESULTS = "case_id long, te_class string, class string, superfamily string, confidence string, coords_applied string, input_length long"


@pytest.fixture(scope="module")
def tables(spark):
    corpus = [
        (1, "a", "ltr", "element", "Class I, LTR retrotransposon", "Ty3/gypsy (family Huck)"),
        (2, "b", "ltr", "genome", "Class I (non-LTR)", " Jockey "),
        (3, "c", "line", "locus", "Class I: LINE", "HML-2"),
        (4, "d", "supply", "genome", "Class II / TIR", "hAT"),
        (5, "e", "negative", "element", "Not a TE (host gene)", ""),
        (6, "f", "negative", "element", "something", ""),
    ]
    results = [
        (1, "LTR/Gypsy", "Class I", "Gypsy (Ty3) · chromovirus", "High", None, 10),
        (2, "LINE", "Class I", "LINE (non-LTR)", "Moderate", "5-14", 10),
        (3, "retro/partial", "Class I", "coding fragment (GAG; RT/transposase not detected)", "Candidate", "1-9", 9),
        (4, "DNA/hAT", "Class II", "hAT", "High", "NOT APPLICABLE", 900),
        (5, "DNA/hAT", "Class II", "hAT", None, None, 3),
    ]
    return spark.createDataFrame(corpus, CORPUS), spark.createDataFrame(results, RESULTS)


def test_strata_add_up_to_the_corpus(spark, tables):
    strata = scorer.stratify(*tables)
    assert {r["case_id"]: r["stratum"] for r in strata.collect()} == {1: "scored", 2: "scored", 3: "scored", 4: "stratified", 5: "scored", 6: "not run"}
    assert strata.where("case_id = 4").first()["excluded_because"] == "containing record, no coordinate applied: 900 bp analysed whole (NOT APPLICABLE)"
    ledger = {r["panel"]: r for r in scorer.ledger(strata).collect()}
    assert ledger["supply"]["stratified"] == 1 and ledger["negative"]["not run"] == 1 and sum(r["cases"] for r in ledger.values()) == 6
    odd = spark.createDataFrame([(1, None, None, None, None, "2-5", 5), (9, None, None, None, None, None, 1)], RESULTS)
    assert {r["case_id"]: r["stratum"] for r in scorer.stratify(tables[0], odd).where("stratum <> 'not run'").collect()} == {1: "length differs", 9: "not in the corpus"}
    with pytest.raises(Exception, match="out of step"):
        scorer.stratify(tables[0], odd, strict=True).collect()


def test_labels_are_read_by_rules_or_fail(spark, tables):
    scored = {r["case_id"]: r for r in scorer.normalise_labels(scorer.stratify(*tables).where("stratum = 'scored'"), strict=True).collect()}
    got = {k: (r["want_class"], r["want_order"], r["want_superfamily"], r["said_class"], r["said_order"], r["said_superfamily"]) for k, r in scored.items()}
    assert got[1] == ("CLASS_I", "LTR", "GYPSY", "CLASS_I", "LTR", "GYPSY")
    assert got[2] == ("CLASS_I", "LINE", "JOCKEY", "CLASS_I", "LINE", "ABSTAIN")
    assert got[3] == ("CLASS_I", "LINE", None, "CLASS_I", "ABSTAIN", "ABSTAIN") and scored[3]["not_gradable"] == scorer.NO_BIN
    assert got[5] == ("NOT_TE", "NOT_TE", None, "CLASS_II", "TIR", "HAT")
    assert scored[3]["abstained_at_order"] and not scored[1]["abstained_at_order"] and all(r["rejected"] is None for r in scored.values())
    bad = spark.createDataFrame([(1, "x", "Class I", "no such label", None, None, 1)], RESULTS).join(tables[0], "case_id")
    assert scorer.rejected_labels(bad).first()[0] == "observed: no such label"
    with pytest.raises(Exception, match="outside the scoring vocabulary"):
        scorer.normalise_labels(bad, strict=True).select("want_class").collect()
    undue = spark.createDataFrame([(2, "LTR/Copia", "Class I", "Copia (Ty1)", None, None, 1)], RESULTS).join(tables[0], "case_id")
    assert scorer.undue_answers(scorer.normalise_labels(undue)).count() == 1


def test_empty_panels_show_no_cases(tables):
    rows = {(r["scope"], r["name"], r["level"]): r for r in scorer.scores_by_panel_and_tier(scorer.stratify(*tables)).collect()}
    assert (rows["panel", "supply", "order"]["n"], rows["panel", "supply", "order"]["n_stratified"], rows["panel", "supply", "order"]["accuracy"]) == (0, 1, None)
    order = rows["all", "all", "order"]
    assert (order["n"], order["n_gradable"], order["n_answered"], order["n_correct"], order["abstention_rate"]) == (4, 4, 3, 2, 0.25)
    assert rows["tier", "High", "superfamily"]["n_correct"] == 1 and rows["panel", "ltr", "superfamily"]["abstention_rate"] == 0.5
    report = {r["name"]: r for r in scorer.accuracy_report(scorer.stratify(*tables)).collect()}
    assert report["elements only"]["order_answered"] == "2/3" and report["all panels" if "all panels" in report else "all"]["order_answered"] == "3/4"


def test_two_callers_over_two_denominators(spark, tables):
    scored = scorer.normalise_labels(scorer.stratify(*tables).where("stratum = 'scored'"))
    calls = spark.createDataFrame([("a", "m", "LTR", "x", "f"), ("b", "m", "NO_CALL", "x", "f"), ("c", "m", "LINE", "z", "f"), ("e", "m", "TIR", None, None), ("d", "m", "TIR", "x", "f")], "accession string, mode string, call string, residue_sha string, fetch_sha string")
    inputs = spark.createDataFrame([("a", "x", "f"), ("a", "y", None), ("b", "x", "g"), ("c", "z", "f")], "accession string, residue_sha string, fetch_sha string")
    identity = scorer.input_identity(inputs, calls)
    got = {r["accession"]: (r["verdict"], r["recorded"], r["distinct_inputs"]) for r in identity.collect()}
    assert got == {"a": ("verified", "agrees", 2), "b": ("verified", "differs", 1), "c": ("verified", "agrees", 1), "d": ("unverifiable", "unavailable", 0), "e": ("unverifiable", "unavailable", 0)}
    pairs = scorer.pair_calls(scored, calls, identity)
    assert {r["accession"]: r["reason"] for r in pairs.collect()} == {"a": None, "b": "inputs differ", "c": None, "d": "not scored as a single element", "e": "negative control"}
    r = scorer.paired_comparison(pairs).first()
    assert (r["considered"], r["paired"], r["both"], r["b_only"], r["abstention_cost"], r["a_errors"], r["a_errors_with_controls"], r["b_errors_with_controls"]) == (5, 2, 1, 1, 1, 0, 1, 1)
