"""Queries of the scorer and their DuckDB SQL, which works the label rules out for itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.derive import derive, duck
from ..operators import scorer as ops


def _strata(spark, d):
    return ops.stratify(derive(spark, d, "corpus_rows"), derive(spark, d, "result_rows"))


def _scored(spark, d):
    return ops.normalise_labels(_strata(spark, d).where("stratum = 'scored'"))


def o78_normalise_labels(spark, d):
    tokens = ("want_class", "want_order", "want_superfamily", "not_gradable", "said_class", "said_order", "said_superfamily", "abstained_at_order", "abstained_at_superfamily", "rejected")
    return _scored(spark, d).select("case_id", *tokens)


def o78_rejected_labels(spark, d):
    return ops.rejected_labels(_strata(spark, d).where("stratum = 'scored'"))


def o79_stratify_cases(spark, d):
    return _strata(spark, d).select("case_id", "stratum", "span_applied", "excluded_because")


def o79_ledger(spark, d):
    return ops.ledger(_strata(spark, d))


def o80_accuracy_with_abstention(spark, d):
    return ops.accuracy_by_level(_scored(spark, d))


def o82_scores_by_panel_and_tier(spark, d):
    return ops.scores_by_panel_and_tier(_strata(spark, d))


def o85_superfamily_sensitivity(spark, d):
    return ops.superfamily_sensitivity(_scored(spark, d))


def o87_undue_answers(spark, d):
    return ops.undue_answers(_scored(spark, d)).select("case_id", "want_superfamily", "said_superfamily")


def o100_accuracy_report(spark, d):
    return ops.accuracy_report(_strata(spark, d))


def _identity(spark, d):
    return ops.input_identity(derive(spark, d, "first_inputs"), derive(spark, d, "second_calls"))


def o90_input_identity_check(spark, d):
    return _identity(spark, d)


def _pairs(spark, d):
    return ops.pair_calls(_scored(spark, d), derive(spark, d, "second_calls"), _identity(spark, d))


def o88_pair_calls(spark, d):
    return _pairs(spark, d)


def o88_paired_comparison(spark, d):
    return ops.paired_comparison(_pairs(spark, d))


_SPAN = r"regexp_matches(coalesce(coords_applied, ''), '^[0-9]+-[0-9]+$')"
_STRATA = f"""st AS (SELECT c.*, coalesce(c.case_id, r.case_id) AS id, r.te_class, r.class, r.superfamily, r.confidence, r.coords_applied, r.input_length, {_SPAN} AS span_applied,
        CASE WHEN c.case_id IS NULL THEN 'not in the corpus' WHEN r.case_id IS NULL THEN 'not run'
            WHEN {_SPAN} AND CAST(split_part(coords_applied, '-', 2) AS BIGINT) - CAST(split_part(coords_applied, '-', 1) AS BIGINT) + 1 IS DISTINCT FROM input_length THEN 'length differs'
            WHEN record_scope = 'element' OR {_SPAN} THEN 'scored' ELSE 'stratified' END AS stratum FROM corpus_rows c FULL JOIN result_rows r ON c.case_id = r.case_id)"""
_TOKENS = _STRATA + """, lab AS (SELECT *, lower(trim(coalesce(expected_class, ''))) AS x, lower(trim(coalesce(te_class, ''))) AS te, lower(trim(coalesce(class, ''))) AS k, trim(coalesce(expected_superfamily, '')) AS ws, regexp_replace(trim(coalesce(superfamily, '')), ' · chromovirus$', '') AS ss FROM st WHERE stratum = 'scored'),
    ord AS (SELECT *, CASE WHEN te IN ('', 'unclassified', 'none', '-') OR trim(split_part(te, '/', 1)) = 'repeat' THEN 'NO_CALL' WHEN trim(split_part(te, '/', 1)) IN ('ltr', 'line', 'sine') THEN upper(trim(split_part(te, '/', 1)))
            WHEN trim(split_part(te, '/', 1)) IN ('tir', 'dna', 'mite', 'helitron') THEN 'TIR' WHEN trim(split_part(te, '/', 1)) = 'retro' THEN 'ABSTAIN' ELSE 'OTHER' END AS said_order,
        CASE ws WHEN 'Copia (Ty1)' THEN 'COPIA' WHEN 'Ty3/gypsy (family Huck)' THEN 'GYPSY' WHEN 'Jockey' THEN 'JOCKEY' WHEN 'RTE/BovB' THEN 'RTE' WHEN 'Tc1/Mariner-related MITE' THEN 'TCMAR' WHEN 'hAT' THEN 'HAT' WHEN 'P-element family' THEN 'P_ELEMENT' WHEN 'HML-2' THEN 'ERV' WHEN '' THEN 'NONE' END AS w,
        CASE WHEN ss IN ('', 'LINE (non-LTR)', 'no clear TE signature', 'retrotransposon (partial)') OR regexp_matches(ss, '^LTR retroelement fragment [(].*; RT/pol not detected[)]$') OR ss LIKE '% domain(s) detected; no transposable-element assignment' THEN 'ABSTAIN'
            WHEN ss = 'Copia (Ty1)' THEN 'COPIA' WHEN ss = 'Gypsy (Ty3)' THEN 'GYPSY' WHEN ss = 'hAT' THEN 'HAT' WHEN ss = 'Tc1/Mariner' THEN 'TCMAR' END AS said_superfamily FROM lab),
    tok AS (SELECT * EXCLUDE (w), id AS the_case, CASE WHEN x LIKE 'not a te%' OR x LIKE '%falls outside the wicker%' THEN 'NOT_TE' WHEN x LIKE '%class ii%' THEN 'CLASS_II' WHEN x LIKE '%class i%' THEN 'CLASS_I' ELSE 'OTHER' END AS want_class,
        CASE WHEN x LIKE 'not a te%' OR x LIKE '%falls outside the wicker%' THEN 'NOT_TE' WHEN x LIKE '%sine%' THEN 'SINE' WHEN x LIKE '%line%' OR x LIKE '%non-ltr%' THEN 'LINE' WHEN x LIKE '%ltr%' THEN 'LTR' WHEN x LIKE '%tir%' OR x LIKE '%class ii%' THEN 'TIR' ELSE 'OTHER' END AS want_order,
        CASE WHEN w NOT IN ('ERV', 'NONE') THEN w END AS want_superfamily, CASE w WHEN 'NONE' THEN 'no superfamily label in the corpus' WHEN 'ERV' THEN 'Retrovirus/ERV superfamily outside the answer space' END AS not_gradable,
        CASE WHEN te IN ('', 'unclassified', 'none', '-') THEN 'NO_CALL' WHEN k LIKE '%class ii%' OR said_order = 'TIR' THEN 'CLASS_II' WHEN k LIKE '%class i%' OR said_order IN ('LTR', 'LINE', 'SINE') THEN 'CLASS_I' ELSE 'NO_CALL' END AS said_class,
        said_order IN ('NO_CALL', 'ABSTAIN') AS abstained_at_order, said_superfamily = 'ABSTAIN' AS abstained_at_superfamily, CASE WHEN w IS NULL THEN 'expected: ' || ws WHEN said_superfamily IS NULL THEN 'observed: ' || trim(coalesce(superfamily, '')) END AS rejected FROM ord)"""
_LEVELS = """lv AS (SELECT panel, coalesce(confidence, 'none') AS tier, want_class, 'class' AS level, want_class <> 'OTHER' AS g, said_class <> 'NO_CALL' AS a, want_class = said_class AS c FROM tok
    UNION ALL SELECT panel, coalesce(confidence, 'none'), want_class, 'order', want_order <> 'OTHER', NOT abstained_at_order, want_order = said_order FROM tok
    UNION ALL SELECT panel, coalesce(confidence, 'none'), want_class, 'superfamily', want_superfamily IS NOT NULL, NOT abstained_at_superfamily, want_superfamily = said_superfamily FROM tok)"""
_COUNTS = "count(*) AS n, count(*) FILTER (WHERE g) AS n_gradable, count(*) FILTER (WHERE g AND a) AS n_answered, count(*) FILTER (WHERE g AND a AND c) AS n_correct"
_Z = "1.959963985::DOUBLE"
_P, _D = "(n_correct::DOUBLE / n_answered)", f"(1 + {_Z} * {_Z} / n_answered)"
_MID, _HALF = f"({_P} + {_Z} * {_Z} / (2 * n_answered)) / {_D}", f"{_Z} * sqrt({_P} * (1 - {_P}) / n_answered + {_Z} * {_Z} / (4 * n_answered * n_answered)) / {_D}"
_RATES = f"""n, n_gradable, n_answered, n_correct, CASE WHEN n_answered > 0 THEN round({_P}, 4) END AS accuracy, CASE WHEN n_answered > 0 THEN round(greatest(0.0::DOUBLE, {_MID} - {_HALF}), 4) END AS ci95_low, CASE WHEN n_answered > 0 THEN round(least(1.0::DOUBLE, {_MID} + {_HALF}), 4) END AS ci95_high,
    CASE WHEN n_gradable > 0 THEN round(1 - n_answered / n_gradable, 4) END AS abstention_rate"""
_SCOPES = f"""sets AS (SELECT 'all' AS scope, 'all' AS name, level, {_COUNTS} FROM lv GROUP BY level UNION ALL SELECT 'panel', panel, level, {_COUNTS} FROM lv GROUP BY panel, level UNION ALL SELECT 'tier', tier, level, {_COUNTS} FROM lv GROUP BY tier, level),
    spine AS (SELECT scope, name, n_stratified, level FROM (SELECT 'panel' AS scope, panel AS name, count(*) FILTER (WHERE stratum = 'stratified') AS n_stratified FROM st WHERE panel IS NOT NULL GROUP BY panel UNION ALL SELECT 'all', 'all', count(*) FILTER (WHERE stratum = 'stratified') FROM st), (VALUES ('class'), ('order'), ('superfamily')) v(level)),
    filled AS (SELECT coalesce(s.scope, p.scope) AS scope, coalesce(s.name, p.name) AS name, coalesce(s.level, p.level) AS level, n_stratified, coalesce(n, 0) AS n, coalesce(n_gradable, 0) AS n_gradable, coalesce(n_answered, 0) AS n_answered, coalesce(n_correct, 0) AS n_correct
        FROM sets s FULL JOIN spine p ON s.scope = p.scope AND s.name = p.name AND s.level = p.level)"""
_IDENT = """a AS (SELECT accession, list(DISTINCT residue_sha) FILTER (WHERE residue_sha IS NOT NULL) AS residues, list(DISTINCT fetch_sha) FILTER (WHERE fetch_sha IS NOT NULL) AS fetched FROM first_inputs GROUP BY accession),
    ident AS (SELECT b.accession, b.mode, CASE WHEN residues IS NULL OR residue_sha IS NULL THEN 'unverifiable' WHEN list_contains(residues, residue_sha) THEN 'verified' ELSE 'mismatch' END AS verdict,
        CASE WHEN residues IS NULL THEN 'no input of the first caller' WHEN residue_sha IS NULL THEN 'input of the second caller not kept' END AS reason,
        CASE WHEN fetched IS NULL OR fetch_sha IS NULL THEN 'unavailable' WHEN list_contains(fetched, fetch_sha) THEN 'agrees' ELSE 'differs' END AS recorded, CAST(coalesce(len(residues), 0) AS INT) AS distinct_inputs FROM second_calls b LEFT JOIN a USING (accession))"""
_ERR = "CASE WHEN want_order IN ('LTR', 'LINE', 'SINE', 'TIR', 'NOT_TE') AND {0} IN ('LTR', 'LINE', 'SINE', 'TIR') THEN {0} <> want_order END"
_PAIRS = f"""{_IDENT}, mine AS (SELECT DISTINCT ON (accession) accession, case_id, want_order, said_order, abstained_at_order FROM tok ORDER BY accession, case_id),
    pairs AS (SELECT b.accession, b.mode, CASE WHEN m.case_id IS NULL THEN 'not scored as a single element' WHEN want_order = 'NOT_TE' THEN 'negative control' WHEN want_order = 'OTHER' THEN 'expected order outside the vocabulary' WHEN verdict = 'mismatch' OR recorded = 'differs' THEN 'inputs differ' END AS reason,
        want_order AS expected, said_order AS a_call, b.call AS b_call, abstained_at_order AS a_abstained, coalesce(NOT abstained_at_order AND said_order = want_order, false) AS a_right, coalesce(b.call NOT IN ('NO_CALL', 'OTHER') AND b.call = want_order, false) AS b_right,
        {_ERR.format("said_order")} AS a_wrong, {_ERR.format("b.call")} AS b_wrong FROM second_calls b LEFT JOIN mine m USING (accession) LEFT JOIN ident i ON i.accession = b.accession AND i.mode = b.mode)"""
_BASE = ("corpus_rows", "result_rows")

ORACLES = {
    "o78_normalise_labels": duck(f"WITH {_TOKENS} SELECT id AS case_id, want_class, want_order, want_superfamily, not_gradable, said_class, said_order, said_superfamily, abstained_at_order, abstained_at_superfamily, rejected FROM tok", *_BASE),
    "o78_rejected_labels": duck(f"WITH {_TOKENS} SELECT rejected, count(*) AS n FROM tok WHERE rejected IS NOT NULL GROUP BY rejected", *_BASE),
    "o79_stratify_cases": duck(f"""WITH {_STRATA} SELECT id AS case_id, stratum, span_applied, CASE WHEN stratum = 'stratified' THEN 'containing record, no coordinate applied: ' || input_length || ' bp analysed whole' || CASE WHEN coalesce(coords_applied, '') <> '' THEN ' (' || coords_applied || ')' ELSE '' END END AS excluded_because FROM st""", *_BASE),
    "o79_ledger": duck(f"""WITH {_STRATA} SELECT panel, count(*) FILTER (WHERE stratum = 'scored') AS scored, count(*) FILTER (WHERE stratum = 'stratified') AS stratified, count(*) FILTER (WHERE stratum = 'not run') AS "not run", count(*) FILTER (WHERE stratum = 'length differs') AS "length differs",
        count(*) FILTER (WHERE stratum = 'not in the corpus') AS "not in the corpus", count(*) FILTER (WHERE stratum <> 'not in the corpus') AS cases FROM st GROUP BY panel""", *_BASE),
    "o80_accuracy_with_abstention": duck(f"WITH {_TOKENS}, {_LEVELS} SELECT level, {_RATES} FROM (SELECT level, {_COUNTS} FROM lv GROUP BY level)", *_BASE),
    "o82_scores_by_panel_and_tier": duck(f"WITH {_TOKENS}, {_LEVELS}, {_SCOPES} SELECT scope, name, level, n_stratified, {_RATES} FROM filled", *_BASE),
    "o85_superfamily_sensitivity": duck(f"""WITH {_TOKENS}, v AS (SELECT 'as scored' AS view, want_superfamily AS w, * FROM tok UNION ALL SELECT 'retrovirus graded incorrect', CASE WHEN not_gradable LIKE 'Retrovirus%' THEN 'RETROVIRUS' ELSE want_superfamily END, * FROM tok
        UNION ALL SELECT 'representable only', CASE WHEN want_superfamily IN ('COPIA', 'GYPSY', 'HAT', 'TCMAR') THEN want_superfamily END, * FROM tok), lv AS (SELECT view, w IS NOT NULL AS g, NOT abstained_at_superfamily AS a, w = said_superfamily AS c FROM v) SELECT view, {_RATES} FROM (SELECT view, {_COUNTS} FROM lv GROUP BY view)""", *_BASE),
    "o87_undue_answers": duck(f"WITH {_TOKENS} SELECT id AS case_id, want_superfamily, said_superfamily FROM tok WHERE want_superfamily IN ('JOCKEY', 'RTE', 'P_ELEMENT') AND said_superfamily <> 'ABSTAIN'", *_BASE),
    "o100_accuracy_report": duck(f"""WITH {_TOKENS}, {_LEVELS}, {_SCOPES}, rows_ AS (SELECT scope, name, level, n, n_gradable, n_answered, n_correct FROM filled WHERE scope <> 'tier' UNION ALL SELECT 'elements', 'elements only', level, {_COUNTS} FROM lv WHERE want_class <> 'NOT_TE' GROUP BY level),
        rr AS (SELECT scope, name, level, {_RATES} FROM rows_), t AS (SELECT scope, name, max(n) AS n, {", ".join(f"max(n_answered || '/' || n_gradable) FILTER (WHERE level = '{x}') AS {x}_answered, max(accuracy) FILTER (WHERE level = '{x}') AS {x}_accuracy, max(abstention_rate) FILTER (WHERE level = '{x}') AS {x}_abstention" for x in ops.LEVELS)} FROM rr GROUP BY ALL)
        SELECT *, CAST(row_number() OVER (ORDER BY CASE scope WHEN 'panel' THEN 0 WHEN 'elements' THEN 1 ELSE 2 END, n DESC, name) AS INT) AS place FROM t""", *_BASE),
    "o90_input_identity_check": duck(f"WITH {_IDENT} SELECT * FROM ident", "first_inputs", "second_calls"),
    "o88_pair_calls": duck(f"WITH {_TOKENS}, {_PAIRS} SELECT * FROM pairs", *_BASE, "first_inputs", "second_calls"),
    "o88_paired_comparison": duck(f"""WITH {_TOKENS}, {_PAIRS}, c AS (SELECT mode, count(*) AS considered, {", ".join(f"count(*) FILTER (WHERE {w}) AS {n}" for n, w in (
        ("paired", "reason IS NULL"), ("unscored", "reason LIKE 'not scored%'"), ("controls", "reason = 'negative control'"), ("outside", "reason LIKE 'expected order%'"), ("inputs_differ", "reason = 'inputs differ'"),
        ("both", "reason IS NULL AND a_right AND b_right"), ("a_only", "reason IS NULL AND a_right AND NOT b_right"), ("b_only", "reason IS NULL AND NOT a_right AND b_right"), ("neither", "reason IS NULL AND NOT a_right AND NOT b_right"),
        ("abstention_cost", "reason IS NULL AND a_abstained AND b_right"), ("abstention_gain", "reason IS NULL AND a_abstained AND NOT b_right AND b_call <> 'NO_CALL'"), ("a_errors", "reason IS NULL AND a_wrong"), ("b_errors", "reason IS NULL AND b_wrong"),
        ("a_errors_with_controls", "coalesce(reason, 'negative control') = 'negative control' AND a_wrong"), ("b_errors_with_controls", "coalesce(reason, 'negative control') = 'negative control' AND b_wrong"),
        ("a_outside", "coalesce(reason, 'negative control') = 'negative control' AND a_call = 'OTHER'"), ("b_outside", "coalesce(reason, 'negative control') = 'negative control' AND b_call = 'OTHER'")))} FROM pairs GROUP BY mode)
        SELECT *, CASE WHEN paired > 0 THEN round((c."both" + a_only) / paired, 4) END AS a_accuracy, CASE WHEN paired > 0 THEN round((c."both" + b_only) / paired, 4) END AS b_accuracy FROM c""", *_BASE, "first_inputs", "second_calls"),
}

QUERIES = {k: v for k, v in list(globals().items()) if k[:1] == "o" and k[1:3].isdigit()}
