"""Abstention-aware evaluation: accuracy with intervals, paired tests, ledgers and audits.

Cases carry accession, panel, tier, expected, call_a, call_b (a null call is an abstention), record_scope.
All are map-side combined aggregates; self-joins run on accessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the two-sided 95 % quantile of the normal distribution.
Z = 1.959963985


def wilson(k: Column, n: Column) -> tuple[Column, Column, Column]:
    """Share, and the ends of the Wilson interval; null where n is 0."""
    p, d = k / n, 1 + Z * Z / n
    centre = (p + Z * Z / (2 * n)) / d
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / d
    return tuple(F.when(n > 0, c) for c in (p, F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)))


def _scores(n_gradable: Column, n_answered: Column, n_correct: Column) -> list[Column]:
    p, lo, hi = wilson(n_correct, n_answered)
    return [
        n_gradable.alias("n_gradable"),
        n_answered.alias("n_answered"),
        n_correct.alias("n_correct"),
        p.alias("accuracy"),
        lo.alias("lo"),
        hi.alias("hi"),
        F.when(n_gradable > 0, 1 - n_answered / n_gradable).alias("abstention_rate"),
    ]


def _counts(call: str) -> list[Column]:
    gradable = F.col("expected").isNotNull()
    return [
        F.count_if(gradable).alias("g"),
        F.count_if(gradable & F.col(call).isNotNull()).alias("a"),
        F.count_if(gradable & (F.col(call) == F.col("expected"))).alias("c"),
    ]


def accuracy_with_abstention(cases: DataFrame, call: str = "call_a", by: tuple[str, ...] = ()) -> DataFrame:
    return cases.groupBy(*by).agg(*_counts(call)).select(*by, *_scores(F.col("g"), F.col("a"), F.col("c")))


def scores_by_panel_and_tier(cases: DataFrame, call: str = "call_a") -> DataFrame:
    """Overall, by panel and by tier in one pass; level tells which."""
    sets = cases.groupingSets([[], ["panel"], ["tier"]], "panel", "tier").agg(*_counts(call), F.grouping_id().alias("gid"))
    level = F.when(F.col("gid") == 3, "all").when(F.col("gid") == 1, "panel").otherwise("tier")
    return sets.select(level.alias("level"), F.coalesce("panel", "tier", F.lit("all")).alias("name"), *_scores(F.col("g"), F.col("a"), F.col("c")))


def confusion(cases: DataFrame, call: str = "call_a") -> DataFrame:
    return cases.groupBy("expected", F.coalesce(call, F.lit("abstained")).alias("observed")).agg(F.count("*").alias("n"))


def negative_controls(cases: DataFrame, call: str = "call_a") -> DataFrame:
    """Per panel: controls, those correctly not called, and the accessions of false positives."""
    wrong = F.col(call).isNotNull() & (F.col(call) != "none")
    out = cases.where(F.col("expected") == "none").groupBy("panel").agg(F.count("*").alias("n"), F.count_if(~wrong).alias("correct"), F.count_if(wrong).alias("false_positives"))
    return out


def false_positives(cases: DataFrame, call: str = "call_a") -> DataFrame:
    return cases.where((F.col("expected") == "none") & F.col(call).isNotNull() & (F.col(call) != "none")).select("accession", "panel", F.col(call).alias("observed"))


def sensitivity_views(cases: DataFrame, call: str = "call_a") -> DataFrame:
    """The scores as they are, with excluded records graded wrong, and over representable labels only."""
    scoped = cases.withColumn("excluded", F.col("record_scope") != "element")
    base = scoped.where(~F.col("excluded")).withColumn("view", F.lit("as scored"))
    wrong = scoped.withColumn("expected", F.when(F.col("excluded"), F.lit("unanswerable")).otherwise(F.col("expected"))).withColumn("view", F.lit("excluded graded wrong"))
    only = scoped.where(~F.col("excluded") & (F.col("expected") != "none")).withColumn("view", F.lit("representable only"))
    return accuracy_with_abstention(base.unionByName(wrong).unionByName(only), call, ("view",))


def incorrect_and_excluded(cases: DataFrame, call: str = "call_a") -> DataFrame:
    """Every case that is not counted as correct, with the reason; with the correct ones they add up to all."""
    reason = (
        F.when(F.col("record_scope") != "element", F.concat(F.lit("excluded: "), F.col("record_scope")))
        .when(F.col(call).isNull(), "abstained")
        .when(F.col(call) != F.col("expected"), "incorrect")
    )
    return cases.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("accession", "panel", "expected", F.col(call).alias("observed"), "reason")


def representability_check(cases: DataFrame, answers: tuple[str, ...] = ("Class I", "Class II", "none"), call: str = "call_a") -> DataFrame:
    """Committed calls, and those outside the answer space (must be 0)."""
    return cases.agg(F.count(call).alias("committed"), F.count_if(F.col(call).isNotNull() & ~F.col(call).isin(*answers)).alias("outside"))


def paired_comparison(cases: DataFrame, by: str = "panel") -> DataFrame:
    """Two callers on the same cases: both / only one / neither right, and what abstaining cost or saved."""
    a, b = F.coalesce(F.col("call_a") == F.col("expected"), F.lit(False)), F.coalesce(F.col("call_b") == F.col("expected"), F.lit(False))
    return cases.where(F.col("expected").isNotNull()).groupBy(F.col(by).alias("mode")).agg(
        F.count("*").alias("n"),
        F.count_if(a & b).alias("both"),
        F.count_if(a & ~b).alias("a_only"),
        F.count_if(~a & b).alias("b_only"),
        F.count_if(~a & ~b).alias("neither"),
        F.count_if(F.col("call_a").isNull() & b).alias("abstention_cost"),
        F.count_if(F.col("call_a").isNull() & F.col("call_b").isNotNull() & ~b).alias("abstention_gain"),
        F.count_if(F.col("call_a").isNotNull() & ~a).alias("a_errors"),
        F.count_if(F.col("call_b").isNotNull() & ~b).alias("b_errors"),
    )


def mcnemar_exact(pairs: DataFrame) -> DataFrame:
    """mode, b, c and the two-sided exact binomial p. One walk over the smaller count: each logarithm of a binomial
    coefficient follows from the one before it."""
    n, k = F.col("a_only") + F.col("b_only"), F.least("a_only", "b_only")
    floor = n * F.log(F.lit(2.0))
    start = F.struct(F.lit(0.0).alias("c"), F.exp(-floor).alias("s"))

    def step(acc, i):
        c = acc["c"] + F.log((n - i + 1) / i)
        return F.struct(c.alias("c"), (acc["s"] + F.exp(c - floor)).alias("s"))

    tail = F.when(k > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(k, F.lit(1).cast("long"))), start, step, lambda acc: acc["s"])).otherwise(F.exp(-floor))
    return pairs.select("mode", F.col("a_only").alias("b"), F.col("b_only").alias("c"), F.least(F.lit(1.0), 2 * tail).alias("p"))


def input_identity_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """verified / mismatch / unverifiable for each accession, by the hashes of both inputs."""
    joined = a.select("accession", F.col("sha256").alias("a_hash")).join(b.select("accession", F.col("sha256").alias("b_hash")), "accession", "full")
    verdict = F.when(F.col("a_hash").isNull() | F.col("b_hash").isNull(), "unverifiable").when(F.col("a_hash") == F.col("b_hash"), "verified").otherwise("mismatch")
    return joined.select("accession", verdict.alias("verdict"))


def calibration(cases: DataFrame, call: str = "call_a") -> DataFrame:
    """Accuracy per tier over answered calls; a call on a negative control is an error at any tier."""
    answered = cases.where(F.col(call).isNotNull() & (F.col(call) != "none") & F.col("expected").isNotNull())
    n, k = F.count("*"), F.count_if((F.col("expected") != "none") & (F.col(call) == F.col("expected")))
    scored = answered.groupBy("tier").agg(n.alias("n"), k.alias("correct"))
    p, lo, hi = wilson(F.col("correct"), F.col("n"))
    return scored.select("tier", "n", "correct", p.alias("accuracy"), lo.alias("lo"), hi.alias("hi"))


def assay_concordance(assays: DataFrame, products: DataFrame) -> DataFrame:
    """Per assay (name, expected): the product closest to the published size and whether it is within tolerance."""
    size = F.col("size")
    best = assays.join(products, "name", "left").groupBy("name", "expected").agg(F.min_by("size", F.struct(F.abs(size - F.col("expected")), size)).alias("closest"), F.count("size").alias("products"))
    difference = F.col("closest") - F.col("expected")
    tolerance = F.greatest(F.lit(20.0), 0.1 * F.col("expected"))
    return best.select("name", "expected", "closest", "products", difference.alias("difference"), F.coalesce(F.abs(difference) <= tolerance, F.lit(False)).alias("within_tolerance"))


def concordance_summary(concordance: DataFrame) -> DataFrame:
    """n, concordant, exact matches, upper median and largest absolute difference."""
    ranked = concordance.where(F.col("difference").isNotNull()).groupBy(F.abs("difference").alias("d")).agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.orderBy("d"))  # as many rows as distinct differences
    middle = ranked.select("d", upto.alias("upto"), F.sum("m").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all"))
    middle = middle.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("d").alias("median_abs_difference"))
    return concordance.agg(
        F.count("*").alias("n"), F.count_if("within_tolerance").alias("concordant"), F.count_if(F.col("difference") == 0).alias("exact"), F.max(F.abs("difference")).alias("max_abs_difference")
    ).crossJoin(middle)


def size_window(assays: DataFrame) -> DataFrame:
    return assays.agg(F.floor(F.min("expected") / 2).alias("prod_min"), (3 * F.max("expected")).alias("prod_max"))


def detection_curve(runs: DataFrame) -> DataFrame:
    """Per target: accepted, advisory and either, as rates with intervals of either."""
    out = runs.groupBy("target").agg(F.count("*").alias("n"), F.count_if("accepted").alias("k"), F.count_if(~F.col("accepted") & F.col("advisory")).alias("v"))
    p, lo, hi = wilson(F.col("k") + F.col("v"), F.col("n"))
    return out.select("target", "n", (F.col("k") / F.col("n")).alias("accepted_rate"), (F.col("v") / F.col("n")).alias("advisory_rate"), p.alias("rate"), lo.alias("lo"), hi.alias("hi"))


def rank_correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman (average ranks) and Pearson correlation of two columns.

    Ranks come from the counts of distinct values, so the windows see distinct values and not rows.
    """
    rows = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull())

    def ranks(c: str) -> DataFrame:
        counts = rows.groupBy(c).agg(F.count("*").alias("m"))
        before = F.coalesce(F.sum("m").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return counts.select(c, (before + (F.col("m") + 1) / 2).alias(f"r{c}"))

    ranked = rows.join(ranks("x"), "x").join(ranks("y"), "y")
    return ranked.agg(F.corr("rx", "ry").alias("rho"), F.corr("x", "y").alias("r"))


def verdict_matrix(cells: DataFrame, verdicts: tuple[str, ...]) -> DataFrame:
    """tool, axis and the verdict a free-text cell starts with: two words before one, else unknown."""
    clean = F.lower(F.trim(F.regexp_replace("cell", r"\s+", " ")))
    two, one = F.regexp_extract(clean, r"^(\S+ \S+)", 1), F.regexp_extract(clean, r"^(\S+)", 1)
    strip = lambda c: F.regexp_replace(c, r"[.,;:]+$", "")
    return cells.select("tool", "axis", F.when(strip(two).isin(*verdicts), strip(two)).when(strip(one).isin(*verdicts), strip(one)).otherwise("unknown").alias("verdict"))


def differential_agreement(a: DataFrame, b: DataFrame, keys: list[str], inputs: DataFrame) -> DataFrame:
    """How two implementations agree per input: agreed, disagreed, both empty. All columns of a and b count."""
    count = lambda df, name: df.groupBy(*df.columns).agg(F.count("*").alias(name))
    joined = count(a, "m").join(count(b, "k"), a.columns, "full")
    per_key = joined.groupBy(*keys).agg(F.count_if(~F.col("m").eqNullSafe(F.col("k"))).alias("different"))
    out = inputs.select(*keys).distinct().join(per_key, keys, "left")
    return out.agg(F.count_if(F.col("different") == 0).alias("agreed"), F.count_if(F.col("different") > 0).alias("disagreed"), F.count_if(F.col("different").isNull()).alias("both_empty"))


def agreement_histogram(a: DataFrame, b: DataFrame, keys: list[str], inputs: DataFrame) -> DataFrame:
    """How many inputs have each number of rows that the two implementations share, and that only one of them has."""
    count = lambda df, name: df.groupBy(*df.columns).agg(F.count("*").alias(name))
    joined = count(a, "m").join(count(b, "k"), a.columns, "full").na.fill(0, ["m", "k"])
    each = joined.groupBy(*keys).agg(F.sum(F.least("m", "k")).alias("shared"), F.sum(F.col("m") - F.least("m", "k")).alias("only_a"), F.sum(F.col("k") - F.least("m", "k")).alias("only_b"))
    out = inputs.select(*keys).distinct().join(each, keys, "left").na.fill(0, ["shared", "only_a", "only_b"])
    return out.groupBy("shared", "only_a", "only_b").agg(F.count("*").alias("inputs"))


def call_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Transitions of calls on the same input hash; other accessions are counted with the reason."""
    joined = before.select("accession", F.col("sha256").alias("h0"), F.col("call").alias("c0")).join(after.select("accession", F.col("sha256").alias("h1"), F.col("call").alias("c1")), "accession", "full")
    state = F.when(F.col("h0").isNull(), "no earlier run").when(F.col("h1").isNull(), "no later run").when(F.col("h0") != F.col("h1"), "input changed").when(F.col("c0").eqNullSafe(F.col("c1")), "unchanged").otherwise("moved")
    same = state.isin("unchanged", "moved")
    return joined.groupBy(state.alias("state"), F.when(same, F.col("c0")).alias("before"), F.when(same, F.col("c1")).alias("after")).agg(F.count("*").alias("n"))


def orphan_results(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Accessions with results and no case, and those with more results than cases."""
    r, c = results.groupBy("accession").agg(F.count("*").alias("n_results")), cases.groupBy("accession").agg(F.count("*").alias("n_cases"))
    joined = r.join(c, "accession", "left").withColumn("n_cases", F.coalesce("n_cases", F.lit(0).cast("long")))
    reason = F.when(F.col("n_cases") == 0, "no case").when(F.col("n_results") > F.col("n_cases"), "surplus")
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull())


def accuracy_report(cases: DataFrame, call: str = "call_a") -> DataFrame:
    """A row per panel, a row of elements only and a row of all; ``place`` is the order to show them in."""
    panels = accuracy_with_abstention(cases, call, ("panel",))
    elements = accuracy_with_abstention(cases.where(F.col("expected") != "none"), call).select(F.lit("elements only").alias("panel"), "*")
    everything = accuracy_with_abstention(cases, call).select(F.lit("all panels").alias("panel"), "*")
    place = F.row_number().over(Window.orderBy(F.desc("n_gradable"), "panel"))  # one row per panel
    last = elements.withColumn("place", F.lit(1 << 20)).unionByName(everything.withColumn("place", F.lit((1 << 20) + 1)))
    return panels.withColumn("place", place).unionByName(last)
