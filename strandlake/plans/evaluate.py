"""Queries of the evaluation operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.derive import derive, duck
from ..operators import evaluate as ops


def cases(spark, d):
    return derive(spark, d, "cases")


def o80_accuracy_by_panel(spark, d):
    return ops.accuracy_with_abstention(cases(spark, d), "call_a", ("panel",))


def o81_wilson_interval(spark, d):
    n = derive(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    p, lo, hi = ops.wilson(F.col("k"), F.col("n"))
    return n.select("l_suppkey", "n", "k", p.alias("p"), lo.alias("lo"), hi.alias("hi"))


def o82_scores_of_one_level(spark, d):
    return ops.scores_by_panel_and_tier(cases(spark, d))


def o83_confusion(spark, d):
    return ops.confusion(cases(spark, d))


def o84_negative_controls(spark, d):
    return ops.negative_controls(cases(spark, d))


def o84_false_positives(spark, d):
    return ops.false_positives(cases(spark, d))


def o85_sensitivity_views(spark, d):
    return ops.sensitivity_views(cases(spark, d))


def o86_incorrect_and_excluded(spark, d):
    return ops.incorrect_and_excluded(cases(spark, d))


def o87_representability_check(spark, d):
    return ops.representability_check(cases(spark, d))


def o88_calls_side_by_side(spark, d):
    return ops.paired_comparison(cases(spark, d))


def o89_mcnemar_exact(spark, d):
    return ops.mcnemar_exact(ops.paired_comparison(cases(spark, d))).withColumn("p", F.round("p", 9))


def _hashes(spark, d, shift):
    docs = derive(spark, d, "documents").where(F.col("doc_id") % 10 != shift)
    return docs.select(F.col("doc_id").alias("accession"), F.sha2(F.concat("text", F.when(F.col("doc_id") % 7 == shift, "N").otherwise("")), 256).alias("sha256"), F.when(F.col("n_chars") % 5 > shift, F.col("lang")).alias("call"))


def o90_hashes_side_by_side(spark, d):
    return ops.input_identity_check(_hashes(spark, d, 1), _hashes(spark, d, 2))


def o91_calibration(spark, d):
    return ops.calibration(cases(spark, d))


def _assays(spark, d):
    assays = derive(spark, d, "part").select(F.col("p_partkey").alias("name"), (F.col("p_size") * 20 + 70).cast("long").alias("expected"))
    products = derive(spark, d, "lineitem").select(F.col("l_partkey").alias("name"), (F.col("l_quantity") * 21 + 60).cast("long").alias("size"))
    return assays, products


def o92_assay_concordance(spark, d):
    return ops.assay_concordance(*_assays(spark, d))


def o92_concordance_summary(spark, d):
    return ops.concordance_summary(ops.assay_concordance(*_assays(spark, d)))


def o93_size_window(spark, d):
    return ops.size_window(_assays(spark, d)[0])


def o94_detection_curve(spark, d):
    runs = derive(spark, d, "lineitem").select(F.round(F.col("l_discount") * 100).cast("long").alias("target"), (F.col("l_quantity") > 20).alias("accepted"), (F.col("l_quantity") > 10).alias("advisory"))
    return ops.detection_curve(runs)


def o95_rank_correlation(spark, d):
    return ops.rank_correlation(derive(spark, d, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("rho", 9).alias("rho"), F.round("r", 9).alias("r"))


def o96_verdict_matrix(spark, d):
    cells = derive(spark, d, "part").select(F.col("p_brand").alias("tool"), F.col("p_type").alias("axis"), F.concat(F.initcap("p_name"), F.lit(".  As  measured")).alias("cell"))
    return ops.verdict_matrix(cells, ("small ring", "red widget", "small", "large", "red")).groupBy("tool", "verdict").agg(F.count("*").alias("n"))


def _two_readings(spark, d):
    """All lines on both sides; orders without lines are the inputs for which both are empty."""
    items = derive(spark, d, "lineitem")
    a = items.select("l_orderkey", "l_partkey", F.col("l_quantity").cast("int").alias("q"))
    b = items.select("l_orderkey", "l_partkey", F.when(F.col("l_discount") > 0.09, 0).otherwise(F.col("l_quantity").cast("int")).alias("q"))
    inputs = derive(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")).union(items.select("l_orderkey"))
    return a, b, ["l_orderkey"], inputs


def o97_differential_agreement(spark, d):
    return ops.differential_agreement(*_two_readings(spark, d))


def o97_agreement_histogram(spark, d):
    return ops.agreement_histogram(*_two_readings(spark, d))


def o98_call_changes(spark, d):
    return ops.call_changes(_hashes(spark, d, 1), _hashes(spark, d, 2))


def o99_orphan_results(spark, d):
    results = derive(spark, d, "lineitem").select(F.col("l_partkey").alias("accession"))
    known = derive(spark, d, "lineitem").where("l_discount > 0.01").select(F.col("l_partkey").alias("accession"))
    return ops.orphan_results(results, known)


def o100_report_of_one_level(spark, d):
    return ops.accuracy_report(cases(spark, d))


def _wilson(k, n):
    z = "1.959963985::DOUBLE"
    p, div = f"({k})::DOUBLE / ({n})", f"(1 + {z} * {z} / ({n}))"
    centre, half = f"({p} + {z} * {z} / (2 * ({n}))) / {div}", f"{z} * sqrt({p} * (1 - {p}) / ({n}) + {z} * {z} / (4 * ({n}) * ({n}))) / {div}"
    return f"CASE WHEN ({n}) > 0 THEN {p} END", f"CASE WHEN ({n}) > 0 THEN greatest(0.0::DOUBLE, {centre} - {half}) END", f"CASE WHEN ({n}) > 0 THEN least(1.0::DOUBLE, {centre} + {half}) END"


def _scores(select, source, group, call="call_a"):
    p, lo, hi = _wilson("c", "a")
    return f"""SELECT {select}, g AS n_gradable, a AS n_answered, c AS n_correct, {p} AS accuracy, {lo} AS lo, {hi} AS hi, CASE WHEN g > 0 THEN 1 - a / g END AS abstention_rate
        FROM (SELECT {select}, count(*) FILTER (WHERE expected IS NOT NULL) AS g, count(*) FILTER (WHERE expected IS NOT NULL AND {call} IS NOT NULL) AS a, count(*) FILTER (WHERE {call} = expected) AS c FROM {source} {group})"""


_HASH = "SELECT doc_id AS accession, sha256(text || CASE WHEN doc_id % 7 = {0} THEN 'N' ELSE '' END) AS h, CASE WHEN n_chars % 5 > {0} THEN lang END AS call FROM documents WHERE doc_id % 10 <> {0}"
_BOTH = f"x AS ({_HASH.format(1)}), y AS ({_HASH.format(2)}), j AS (SELECT coalesce(x.accession, y.accession) AS accession, x.h AS h0, y.h AS h1, x.call AS c0, y.call AS c1 FROM x FULL JOIN y ON x.accession = y.accession)"
_PAIRED = """SELECT panel AS mode, count(*) AS n, count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS a_only, count(*) FILTER (WHERE NOT a AND b) AS b_only, count(*) FILTER (WHERE NOT a AND NOT b) AS neither,
    count(*) FILTER (WHERE call_a IS NULL AND b) AS abstention_cost, count(*) FILTER (WHERE call_a IS NULL AND call_b IS NOT NULL AND NOT b) AS abstention_gain, count(*) FILTER (WHERE call_a IS NOT NULL AND NOT a) AS a_errors, count(*) FILTER (WHERE call_b IS NOT NULL AND NOT b) AS b_errors
    FROM (SELECT *, coalesce(call_a = expected, false) AS a, coalesce(call_b = expected, false) AS b FROM cases) GROUP BY panel"""
_ASSAY = """p AS (SELECT p_partkey AS name, CAST(p_size * 20 + 70 AS BIGINT) AS expected FROM part), q AS (SELECT l_partkey AS name, CAST(l_quantity * 21 + 60 AS BIGINT) AS size FROM lineitem),
    k AS (SELECT p.name, expected, arg_min(size, (abs(size - expected), size)) AS closest, count(size) AS products FROM p LEFT JOIN q ON p.name = q.name GROUP BY p.name, expected),
    c AS (SELECT *, closest - expected AS difference, coalesce(abs(closest - expected) <= greatest(20.0, 0.1 * expected), false) AS within_tolerance FROM k)"""
_W = _wilson("k", "n")
_WD = _wilson("k + v", "n")

ORACLES = {
    "o80_accuracy_by_panel": duck(_scores("panel", "cases", "GROUP BY panel"), "cases"),
    "o81_wilson_interval": f"SELECT l_suppkey, n, k, {_W[0]} AS p, {_W[1]} AS lo, {_W[2]} AS hi FROM (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS k FROM lineitem GROUP BY l_suppkey)",
    "o82_scores_of_one_level": duck(_scores("level, name", "(SELECT 'all' AS level, 'all' AS name, * FROM cases UNION ALL SELECT 'panel', panel, * FROM cases UNION ALL SELECT 'tier', tier, * FROM cases)", "GROUP BY level, name"), "cases"),
    "o83_confusion": duck("SELECT expected, coalesce(call_a, 'abstained') AS observed, count(*) AS n FROM cases GROUP BY ALL", "cases"),
    "o84_negative_controls": duck("SELECT panel, count(*) AS n, count(*) FILTER (WHERE call_a IS NULL OR call_a = 'none') AS correct, count(*) FILTER (WHERE call_a <> 'none') AS false_positives FROM cases WHERE expected = 'none' GROUP BY panel", "cases"),
    "o84_false_positives": duck("SELECT accession, panel, call_a AS observed FROM cases WHERE expected = 'none' AND call_a <> 'none'", "cases"),
    "o85_sensitivity_views": duck(_scores("view", """(SELECT 'as scored' AS view, expected, call_a FROM cases WHERE record_scope = 'element' UNION ALL SELECT 'excluded graded wrong', CASE WHEN record_scope <> 'element' THEN 'unanswerable' ELSE expected END, call_a FROM cases
        UNION ALL SELECT 'representable only', expected, call_a FROM cases WHERE record_scope = 'element' AND expected <> 'none')""", "GROUP BY view"), "cases"),
    "o86_incorrect_and_excluded": duck("SELECT accession, panel, expected, call_a AS observed, CASE WHEN record_scope <> 'element' THEN 'excluded: ' || record_scope WHEN call_a IS NULL THEN 'abstained' ELSE 'incorrect' END AS reason FROM cases WHERE record_scope <> 'element' OR call_a IS NULL OR call_a <> expected", "cases"),
    "o87_representability_check": duck("SELECT count(call_a) AS committed, count(*) FILTER (WHERE call_a NOT IN ('Class I', 'Class II', 'none')) AS outside FROM cases", "cases"),
    "o88_calls_side_by_side": duck(_PAIRED, "cases"),
    "o89_mcnemar_exact": duck(f"""WITH p AS ({_PAIRED}), t AS (SELECT mode, a_only AS b, b_only AS c, a_only + b_only AS n, unnest(range(0, least(a_only, b_only) + 1)) AS i FROM p)
        SELECT mode, b, c, round(least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2)))), 9) AS p FROM t GROUP BY mode, b, c""", "cases"),
    "o90_hashes_side_by_side": f"WITH {_BOTH} SELECT accession, CASE WHEN h0 IS NULL OR h1 IS NULL THEN 'unverifiable' WHEN h0 = h1 THEN 'verified' ELSE 'mismatch' END AS verdict FROM j",
    "o91_calibration": duck(f"SELECT tier, n, k AS correct, {_W[0]} AS accuracy, {_W[1]} AS lo, {_W[2]} AS hi FROM (SELECT tier, count(*) AS n, count(*) FILTER (WHERE expected <> 'none' AND call_a = expected) AS k FROM cases WHERE call_a <> 'none' GROUP BY tier)", "cases"),
    "o92_assay_concordance": f"WITH {_ASSAY} SELECT * FROM c",
    "o92_concordance_summary": f"""WITH {_ASSAY}, s AS (SELECT list_sort(list(abs(difference)) FILTER (WHERE difference IS NOT NULL)) AS v FROM c)
        SELECT count(*) AS n, count(*) FILTER (WHERE within_tolerance) AS concordant, count(*) FILTER (WHERE difference = 0) AS exact, max(abs(difference)) AS max_abs_difference, (SELECT v[len(v) // 2 + 1] FROM s) AS median_abs_difference FROM c""",
    "o93_size_window": "SELECT CAST(floor(min(p_size * 20 + 70) / 2) AS BIGINT) AS prod_min, CAST(3 * max(p_size * 20 + 70) AS BIGINT) AS prod_max FROM part",
    "o94_detection_curve": f"""SELECT target, n, k / n AS accepted_rate, v / n AS advisory_rate, {_WD[0]} AS rate, {_WD[1]} AS lo, {_WD[2]} AS hi FROM (SELECT CAST(round(l_discount * 100) AS BIGINT) AS target, count(*) AS n, count(*) FILTER (WHERE l_quantity > 20) AS k,
        count(*) FILTER (WHERE l_quantity <= 20 AND l_quantity > 10) AS v FROM lineitem GROUP BY 1)""",
    "o95_rank_correlation": """WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS rx, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2 AS ry FROM lineitem)
        SELECT round(corr(rx, ry), 9) AS rho, round(corr(x, y), 9) AS r FROM r""",
    "o96_verdict_matrix": """WITH c AS (SELECT p_brand AS tool, regexp_replace(lower(p_name || '.'), '[.]', '', 'g') AS t FROM part)
        SELECT tool, CASE WHEN t IN ('small ring', 'red widget') THEN t WHEN split_part(t, ' ', 1) IN ('small', 'large', 'red') THEN split_part(t, ' ', 1) ELSE 'unknown' END AS verdict, count(*) AS n FROM c GROUP BY ALL""",
    "o97_differential_agreement": """WITH a AS (SELECT l_orderkey AS k, l_partkey, CAST(l_quantity AS INT) AS q, count(*) AS m FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey AS k, l_partkey, CASE WHEN l_discount > 0.09 THEN 0 ELSE CAST(l_quantity AS INT) END AS q, count(*) AS m FROM lineitem GROUP BY ALL),
        j AS (SELECT coalesce(a.k, b.k) AS k, count(*) FILTER (WHERE a.m IS DISTINCT FROM b.m) AS different FROM a FULL JOIN b ON a.k = b.k AND a.l_partkey = b.l_partkey AND a.q = b.q GROUP BY 1)
        SELECT count(*) FILTER (WHERE different = 0) AS agreed, count(*) FILTER (WHERE different > 0) AS disagreed, count(*) FILTER (WHERE different IS NULL) AS both_empty FROM (SELECT o_orderkey AS k FROM orders UNION SELECT l_orderkey FROM lineitem) LEFT JOIN j USING (k)""",
    "o97_agreement_histogram": """WITH a AS (SELECT l_orderkey AS k, l_partkey, CAST(l_quantity AS INT) AS q, count(*) AS m FROM lineitem GROUP BY ALL), b AS (SELECT l_orderkey AS k, l_partkey, CASE WHEN l_discount > 0.09 THEN 0 ELSE CAST(l_quantity AS INT) END AS q, count(*) AS n FROM lineitem GROUP BY ALL),
        j AS (SELECT coalesce(a.k, b.k) AS k, coalesce(m, 0) AS m, coalesce(n, 0) AS n FROM a FULL JOIN b ON a.k = b.k AND a.l_partkey = b.l_partkey AND a.q = b.q), e AS (SELECT k, CAST(sum(least(m, n)) AS BIGINT) AS shared, CAST(sum(m - least(m, n)) AS BIGINT) AS only_a, CAST(sum(n - least(m, n)) AS BIGINT) AS only_b FROM j GROUP BY k)
        SELECT coalesce(shared, 0) AS shared, coalesce(only_a, 0) AS only_a, coalesce(only_b, 0) AS only_b, count(*) AS inputs FROM (SELECT o_orderkey AS k FROM orders UNION SELECT l_orderkey FROM lineitem) LEFT JOIN e USING (k) GROUP BY ALL""",
    "o98_call_changes": f"""WITH {_BOTH}, s AS (SELECT CASE WHEN h0 IS NULL THEN 'no earlier run' WHEN h1 IS NULL THEN 'no later run' WHEN h0 <> h1 THEN 'input changed' WHEN c0 IS NOT DISTINCT FROM c1 THEN 'unchanged' ELSE 'moved' END AS state, c0, c1 FROM j)
        SELECT state, CASE WHEN state IN ('unchanged', 'moved') THEN c0 END AS before, CASE WHEN state IN ('unchanged', 'moved') THEN c1 END AS after, count(*) AS n FROM s GROUP BY ALL""",
    "o99_orphan_results": """WITH r AS (SELECT l_partkey AS accession, count(*) AS n_results, count(*) FILTER (WHERE l_discount > 0.01) AS n_cases FROM lineitem GROUP BY 1)
        SELECT *, CASE WHEN n_cases = 0 THEN 'no case' ELSE 'surplus' END AS reason FROM r WHERE n_cases < n_results""",
    "o100_report_of_one_level": duck(f"""WITH p AS ({_scores("panel", "cases", "GROUP BY panel")}) SELECT *, CAST(row_number() OVER (ORDER BY n_gradable DESC, panel) AS INT) AS place FROM p
        UNION ALL SELECT *, 1048576 FROM ({_scores("panel", "(SELECT 'elements only' AS panel, expected, call_a FROM cases WHERE expected <> 'none')", "GROUP BY panel")})
        UNION ALL SELECT *, 1048577 FROM ({_scores("panel", "(SELECT 'all panels' AS panel, expected, call_a FROM cases)", "GROUP BY panel")})""", "cases"),
}

QUERIES = {k: v for k, v in list(globals().items()) if k[:1] == "o" and k[1:3].isdigit()}
