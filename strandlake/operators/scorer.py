"""Scoring of calls against a curated corpus, at the ranks of class, order and superfamily.

Labels are read by ordered rule tables; a label that no rule knows is a reject, and fails the job where it is asked to.
Tables
  corpus: case_id, accession, panel, record_scope, expected_class, expected_superfamily
  results: case_id, te_class, class, superfamily, confidence, coords_applied, input_length
All steps are equi-joins on cases and map-side combined aggregates; only panels and tiers meet in small tables.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .evaluate import wilson

# Ranks, answers that decline, and reasons why a case has no superfamily to be graded by.
LEVELS = ("class", "order", "superfamily")
ABSTAIN, NO_LABEL, NO_BIN = "ABSTAIN", "no superfamily label in the corpus", "Retrovirus/ERV superfamily outside the answer space"

# Rules as (how, text, token), the first that holds. how: starts, has, is; a token of None keeps the
# upper-cased label. Expected labels are lower-cased before.
EXPECTED_CLASS = (("starts", "not a te", "NOT_TE"), ("has", "falls outside the wicker", "NOT_TE"), ("has", "class ii", "CLASS_II"), ("has", "class i", "CLASS_I"), ("has", "", "OTHER"))
EXPECTED_ORDER = (
    ("starts", "not a te", "NOT_TE"),
    ("has", "falls outside the wicker", "NOT_TE"),
    ("has", "sine", "SINE"),
    ("has", "line", "LINE"),
    ("has", "non-ltr", "LINE"),
    ("has", "ltr", "LTR"),
    ("has", "tir", "TIR"),
    ("has", "class ii", "TIR"),
    ("has", "", "OTHER"),
)
OBSERVED_ORDER = (
    ("is", "", "NO_CALL"),
    ("is", "unclassified", "NO_CALL"),
    ("is", "none", "NO_CALL"),
    ("is", "-", "NO_CALL"),
    ("head", "ltr", "LTR"),
    ("head", "line", "LINE"),
    ("head", "sine", "SINE"),
    ("head", "tir", "TIR"),
    ("head", "dna", "TIR"),
    ("head", "mite", "TIR"),
    ("head", "helitron", "TIR"),
    ("head", "retro", "ABSTAIN"),
    ("head", "repeat", "NO_CALL"),
    ("has", "", "OTHER"),
)

# What a caller may say at superfamily rank. Literal labels first, then labels that are composed around a
# list of domains, by their beginning and their end.
SAID = {
    "Copia (Ty1)": "COPIA",
    "Gypsy (Ty3)": "GYPSY",
    "hAT": "HAT",
    "Tc1/Mariner": "TCMAR",
    "CACTA (En/Spm)": "CACTA",
    "MULE (Mutator)": "MULE",
    "IS4-like DDE (piggyBac group)": "PIGGYBAC",
    "DDE transposon": "DDE_UNPLACED",
    "DNA transposon": "DNA_UNPLACED",
    "DIRS-group (tyrosine-recombinase retroelement)": "DIRS",
    "LTR retrotransposon (superfamily undetermined)": ABSTAIN,
    "LTR retrotransposon (no coding domains detected)": ABSTAIN,
    "retrotransposon (partial)": ABSTAIN,
    "reverse transcriptase, class unassigned": ABSTAIN,
    "LINE (non-LTR)": ABSTAIN,
    "non-autonomous TIR element (superfamily undetermined)": ABSTAIN,
    "terminal inverted repeat, class unassigned": ABSTAIN,
    "no clear TE signature": ABSTAIN,
    "": ABSTAIN,
}
SAID_COMPOSED = (
    ("LTR retroelement fragment (", "; RT/pol not detected)", ABSTAIN),
    ("coding fragment (", "; RT/transposase not detected)", ABSTAIN),
    ("", " domain(s) detected; no transposable-element assignment", ABSTAIN),
    ("Helitron-family helicase present", "superfamily not called", ABSTAIN),
)
#: Fixed value: a lineage that refines a label without changing its superfamily.
LINEAGE = " · chromovirus"

# Curated superfamily labels by the token they stand for.
WANTED_BY_TOKEN = {
    "COPIA": (
        "Copia (Ty1)",
        "Copia (Ty1-copia)",
        "Copia (Ty1) LTR retrotransposon",
        "Ty1/copia (Pseudoviridae, family copia)",
        "Ty1/copia (family Fourf)",
        "Ty1/copia (family Opie)",
        "Ty1/copia (RIRE1-related lineage)",
        "Ty1/copia (PREM family, element Prem1)",
        "Ty1/copia (PREM-2 family, element Prem2-a)",
        "Ty1/copia (PREM-2 family, element Prem2-b)",
    ),
    "GYPSY": (
        "Gypsy (Ty3)",
        "Gypsy (Ty3-gypsy)",
        "Tf2 (Ty3/Gypsy) LTR retrotransposon",
        "Ty3/gypsy (Errantivirus, family 17.6)",
        "Ty3/gypsy (Errantivirus, family 297)",
        "Ty3/gypsy (Metavirus, family 412)",
        "Ty3/gypsy (Cinful-Zeon family, element Zeon1)",
        "Ty3/gypsy (family Huck)",
        "Ty3/gypsy-clade (family blood)",
    ),
    "BELPAO": ("Pao/BEL (Semotivirus, family roo)",),
    "L1": ("L1",),
    "CR1": ("CR1",),
    "JOCKEY": ("Jockey", "Jockey (non-LTR LINE retrotransposon)"),
    "TAD1": ("Tad1",),
    "R1": ("R1",),
    "R2": ("R2",),
    "I": ("I",),
    "RTE": ("RTE", "RTE/BovB"),
    "SINE_7SL": ("7SL-RNA-derived (Alu family)", "7SL-RNA-derived (B1 family)"),
    "HAT": ("hAT",),
    "TCMAR": ("Tc1/Mariner", "Tc1/Mariner (Tc1-like)", "Tc1 (Tc1/mariner) DNA transposon", "Tc1/Mariner-related MITE"),
    "CACTA": ("CACTA", "CACTA (En/Spm)"),
    "MULE": ("MULE (Mutator)", "MULE (Mutator, atypical/FHY3-FAR1-related)", "MULE-related MITE"),
    "PIGGYBAC": ("IS4-like/piggyBac",),
    "PIFHARB": ("PIF/Harbinger",),
    "P_ELEMENT": ("generic DDE (P-element family)", "P-element family"),
    NO_LABEL: ("", "MusD element, ERVL-related (superfamily left unresolved, see note)"),
    NO_BIN: (
        "HML-2",
        "HML-2 (LTR5Hs)",
        "HERV-K (HML-2), Betaretrovirus-like / ERVK",
        "HERV-K (HML-2) LTR retrotransposon / endogenous retrovirus",
        "HERV-H, Gammaretrovirus-like / ERV1",
        "HERV-W, Gammaretrovirus-like / ERV1",
        "IAP element, Betaretrovirus-like / ERVK",
        "Gammaretrovirus-like / ERV1 (KoRV, GALV-related)",
        "Gammaretrovirus-like / ERV1 (PERV lineage)",
        "Gammaretrovirus-like / ERV1 (RD-114/BaEV lineage)",
        "Gammaretrovirus-like / ERV1 (murine leukemia virus lineage)",
        "Betaretrovirus-like / ERVK (JSRV/enJSRV lineage)",
        "Betaretrovirus-like / ERVK (MMTV lineage)",
        "Betaretrovirus-like / ERVK (type-D lineage, Mason-Pfizer/BaEV-related)",
        "Retroviridae, Alpharetrovirus (endogenous ALV subgroup E; chicken ev-3 locus)",
        "Retroviridae, Betaretrovirus (type D; enJSRV lineage, clone enJS56A1)",
        "Retroviridae, Epsilonretrovirus (RMERV)",
        "Retroviridae, Gammaretrovirus (type C; PERV-A)",
        "Retroviridae, gammaretrovirus (MLV)-related clade; genus deliberately left unassigned by the describing authors (ZFERV)",
        "Retroviridae, genus unassignable per the describing authors (PyERV) - NOT betaretrovirus, NOT gammaretrovirus",
    ),
}
WANTED = {label: token for token, labels in WANTED_BY_TOKEN.items() for label in labels}
#: Tokens that a caller can commit to at all.
REPRESENTABLE = tuple(sorted({t for t in SAID.values() if t != ABSTAIN}))


def _clean(label: str) -> Column:
    return F.trim(F.coalesce(F.col(label), F.lit("")))


def first_rule(label: Column, rules) -> Column:
    """Token of the first rule that holds for a label (lower-cased here)."""
    t = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    head = F.trim(F.substring_index(t, "/", 1))
    holds = {"starts": t.startswith, "has": t.contains, "is": lambda x: t == x, "head": lambda x: head == x}
    return F.coalesce(*(F.when(holds[how](text), token) for how, text, token in rules))


def _looked_up(table: dict[str, str], label: Column) -> Column:
    return F.element_at(F.create_map(*map(F.lit, chain.from_iterable(table.items()))), label)


def said_superfamily(label: Column) -> Column:
    """Token of a caller's superfamily label; null where no rule knows it."""
    s = F.regexp_replace(F.trim(F.coalesce(label, F.lit(""))), LINEAGE + "$", "")
    return F.coalesce(_looked_up(SAID, s), *(F.when(s.startswith(a) & s.endswith(b), token) for a, b, token in SAID_COMPOSED))


def normalise_labels(cases: DataFrame, strict: bool = False) -> DataFrame:
    """cases with the tokens of expected and observed labels at each rank, whether a call abstains there, and whether the
    superfamily can be graded. ``rejected`` holds a label that no rule knows; with strict the job fails on the first."""
    order = first_rule(F.col("te_class"), OBSERVED_ORDER)
    klass = F.lower(_clean("class"))
    committed = order != "NO_CALL"
    bare = F.lower(_clean("te_class")).isin("", "unclassified", "none", "-")
    seen = F.when(bare, "NO_CALL").when(F.contains(klass, F.lit("class ii")) | (order == "TIR"), "CLASS_II").when(F.contains(klass, F.lit("class i")) | order.isin("LTR", "LINE", "SINE"), "CLASS_I").otherwise("NO_CALL")
    wanted, said = _looked_up(WANTED, _clean("expected_superfamily")), said_superfamily(F.col("superfamily"))
    reject = F.when(wanted.isNull(), F.concat(F.lit("expected: "), _clean("expected_superfamily"))).when(said.isNull(), F.concat(F.lit("observed: "), _clean("superfamily")))
    out = cases.select(
        "*",
        first_rule(F.col("expected_class"), EXPECTED_CLASS).alias("want_class"),
        first_rule(F.col("expected_class"), EXPECTED_ORDER).alias("want_order"),
        F.when(~wanted.isin(NO_LABEL, NO_BIN), wanted).alias("want_superfamily"),
        F.when(wanted.isin(NO_LABEL, NO_BIN), wanted).alias("not_gradable"),
        seen.alias("said_class"),
        order.alias("said_order"),
        said.alias("said_superfamily"),
        (~committed | (order == "ABSTAIN")).alias("abstained_at_order"),
        (said == ABSTAIN).alias("abstained_at_superfamily"),
        reject.alias("rejected"),
    )
    if strict:
        # The check is part of the tokens' own plan, so that no optimizer can leave it out.
        fails = F.when(F.col("rejected").isNotNull(), F.raise_error(F.concat(F.lit("label outside the scoring vocabulary, "), "rejected")).cast("string"))
        out = out.withColumn("want_class", F.coalesce(fails, F.col("want_class"))).withColumn("said_class", F.coalesce(fails, F.col("said_class")))
    return out


def rejected_labels(cases: DataFrame) -> DataFrame:
    """Labels that no rule knows and how many cases carry them."""
    return normalise_labels(cases).where(F.col("rejected").isNotNull()).groupBy("rejected").agg(F.count("*").alias("n"))


def undue_answers(scored: DataFrame) -> DataFrame:
    """Committed superfamily calls on cases whose superfamily no caller can name: they must be none, else they would be
    graded wrong for want of a word."""
    return scored.where(F.col("want_superfamily").isNotNull() & ~F.col("want_superfamily").isin(*REPRESENTABLE) & ~F.col("abstained_at_superfamily"))


def stratify(corpus: DataFrame, results: DataFrame, strict: bool = False) -> DataFrame:
    """Every case of the corpus and every result, with its stratum: scored (one element was analysed), stratified (a
    containing record was analysed whole; ``excluded_because`` says so), not run, not in the corpus, or length differs
    (the span's length is not what was analysed). With strict the job fails on the last two."""
    known = corpus.withColumn("in_corpus", F.lit(True))
    ran = results.withColumn("ran", F.lit(True))
    span = lambda i: F.regexp_extract(F.coalesce("coords_applied", F.lit("")), r"^(\d+)-(\d+)$", i).try_cast("long")
    out = known.join(ran, "case_id", "full").withColumn("span_length", span(2) - span(1) + 1)
    applied = F.col("span_length").isNotNull()
    stratum = (
        F.when(F.col("in_corpus").isNull(), "not in the corpus")
        .when(F.col("ran").isNull(), "not run")
        .when(applied & ~F.col("span_length").eqNullSafe(F.col("input_length")), "length differs")
        .when((F.col("record_scope") == "element") | applied, "scored")
        .otherwise("stratified")
    )
    why = F.concat(F.lit("containing record, no coordinate applied: "), F.col("input_length").cast("string"), F.lit(" bp analysed whole"), F.when(F.coalesce("coords_applied", F.lit("")) != "", F.concat(F.lit(" ("), "coords_applied", F.lit(")"))).otherwise(""))
    out = out.withColumn("stratum", stratum).withColumn("span_applied", applied)
    if strict:
        bad = F.col("stratum").isin("not in the corpus", "length differs")
        out = out.withColumn("stratum", F.when(bad, F.raise_error(F.concat(F.lit("corpus and results are out of step: "), F.col("case_id").cast("string"), F.lit(" "), "stratum")).cast("string")).otherwise(F.col("stratum")))
    return out.withColumn("excluded_because", F.when(F.col("stratum") == "stratified", why)).drop("in_corpus", "ran", "span_length")


def ledger(strata: DataFrame) -> DataFrame:
    """Cases by panel and stratum; over the corpus they add up to all."""
    return strata.groupBy("panel").pivot("stratum", ["scored", "stratified", "not run", "length differs", "not in the corpus"]).count().na.fill(0).withColumn("cases", sum(F.col(f"`{c}`") for c in ("scored", "stratified", "not run", "length differs")))


def by_level(scored: DataFrame, *keep: str) -> DataFrame:
    """Three rows for each case: level, gradable, answered and correct."""
    graded = {
        "class": (F.col("want_class") != "OTHER", F.col("said_class") != "NO_CALL"),
        "order": (F.col("want_order") != "OTHER", ~F.col("abstained_at_order")),
        "superfamily": (F.col("want_superfamily").isNotNull(), ~F.col("abstained_at_superfamily")),
    }
    rows = F.array(*(F.struct(F.lit(x).alias("level"), g.alias("gradable"), (g & a).alias("answered"), (g & a & (F.col(f"want_{x}") == F.col(f"said_{x}"))).alias("correct")) for x, (g, a) in graded.items()))
    return scored.select(*keep, F.inline(rows))


def _rates(counts: DataFrame, *by: str) -> DataFrame:
    p, lo, hi = (F.round(c, 4) for c in wilson(F.col("n_correct"), F.col("n_answered")))
    declined = F.round(F.when(F.col("n_gradable") > 0, 1 - F.col("n_answered") / F.col("n_gradable")), 4)
    return counts.select(*by, "n", "n_gradable", "n_answered", "n_correct", p.alias("accuracy"), lo.alias("ci95_low"), hi.alias("ci95_high"), declined.alias("abstention_rate"))


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *(F.count_if(c).alias(f"n_{c}") for c in ("gradable", "answered", "correct"))]


def accuracy_by_level(scored: DataFrame, *by: str) -> DataFrame:
    """Accuracy with abstention of each level, for each group of by."""
    return _rates(by_level(scored, *by).groupBy(*by, "level").agg(*_sums()), *by, "level")


def scores_by_panel_and_tier(strata: DataFrame) -> DataFrame:
    """Each level over all cases, by panel and by tier of confidence, in one pass. Panels are those of the corpus: one
    whose cases are all stratified shows n = 0. n_stratified counts those."""
    scored = normalise_labels(strata.where("stratum = 'scored'"))
    sets = by_level(scored, "panel", F.coalesce("confidence", F.lit("none")).alias("tier")).groupingSets([["level"], ["level", "panel"], ["level", "tier"]], "level", "panel", "tier").agg(*_sums(), F.grouping("panel").alias("gp"), F.grouping("tier").alias("gt"))
    scope = F.when(F.col("gp") == 0, "panel").when(F.col("gt") == 0, "tier").otherwise("all")
    found = sets.select("level", scope.alias("scope"), F.when(scope == "panel", F.col("panel")).when(scope == "tier", F.col("tier")).otherwise("all").alias("name"), "n", "n_gradable", "n_answered", "n_correct")
    levels = F.explode(F.array(*map(F.lit, LEVELS))).alias("level")
    away = F.count_if(F.col("stratum") == "stratified").alias("n_stratified")
    panels = strata.where("panel IS NOT NULL").groupBy("panel").agg(away).select(F.lit("panel").alias("scope"), F.col("panel").alias("name"), "n_stratified", levels)
    every = strata.agg(away).select(F.lit("all").alias("scope"), F.lit("all").alias("name"), "n_stratified", levels)
    spine = panels.unionByName(every)
    rows = found.join(spine, ["level", "scope", "name"], "full").na.fill(0, ["n", "n_gradable", "n_answered", "n_correct"])
    return _rates(rows, "scope", "name", "level", "n_stratified")


def superfamily_sensitivity(scored: DataFrame) -> DataFrame:
    """The superfamily scores as they are, with retroviruses graded as errors, and over answerable labels only."""
    s = scored.select("want_superfamily", "not_gradable", "said_superfamily", "abstained_at_superfamily")
    views = {
        "as scored": F.col("want_superfamily"),
        "retrovirus graded incorrect": F.when(F.col("not_gradable") == NO_BIN, "RETROVIRUS").otherwise(F.col("want_superfamily")),
        "representable only": F.when(F.col("want_superfamily").isin(*REPRESENTABLE), F.col("want_superfamily")),
    }
    each = s.select("*", F.inline(F.array(*(F.struct(F.lit(v).alias("view"), w.alias("want")) for v, w in views.items()))))
    gradable, answered = F.col("want").isNotNull(), ~F.col("abstained_at_superfamily")
    rows = each.select("view", gradable.alias("gradable"), (gradable & answered).alias("answered"), (gradable & answered & (F.col("want") == F.col("said_superfamily"))).alias("correct"))
    return _rates(rows.groupBy("view").agg(*_sums()), "view")


def accuracy_report(strata: DataFrame) -> DataFrame:
    """A row per panel of the corpus, most cases first, then elements only and all panels; the levels stand side by side
    as ``answered/gradable``, accuracy and abstention. ``place`` is the order to show them in."""
    scores = scores_by_panel_and_tier(strata).where("scope <> 'tier'")
    elements = accuracy_by_level(normalise_labels(strata.where("stratum = 'scored'")).where("want_class <> 'NOT_TE'")).select(F.lit("elements").alias("scope"), F.lit("elements only").alias("name"), "*", F.lit(0).cast("long").alias("n_stratified"))
    rows = scores.unionByName(elements)
    cells = []
    for level in LEVELS:
        at = lambda c: F.max(F.when(F.col("level") == level, F.col(c)))  # noqa: B023, E731
        cells += [F.concat_ws("/", at("n_answered"), at("n_gradable")).alias(f"{level}_answered"), at("accuracy").alias(f"{level}_accuracy"), at("abstention_rate").alias(f"{level}_abstention")]
    table = rows.groupBy("scope", "name").agg(F.max("n").alias("n"), *cells)
    rank = F.when(F.col("scope") == "panel", 0).when(F.col("scope") == "elements", 1).otherwise(2)
    return table.withColumn("place", F.row_number().over(Window.orderBy(rank, F.desc("n"), "name")))  # one row per panel


# Orders that a call can be graded in.
ORDERS = ("LTR", "LINE", "SINE", "TIR")


def order_error(call: Column, expected: Column) -> Column:
    """True where a call of an order is wrong, false where it is right, null where there is nothing to grade."""
    gradable = expected.isin(*ORDERS, "NOT_TE") & call.isin(*ORDERS)
    return F.when(gradable, call != expected)


def input_identity(a_inputs: DataFrame, b_inputs: DataFrame) -> DataFrame:
    """How the inputs of two callers compare, for each accession of b.

    a_inputs: accession, residue_sha, fetch_sha (any number of records an accession); b_inputs: accession, mode,
    residue_sha, fetch_sha. verdict: verified, mismatch or unverifiable; recorded: agrees, differs or unavailable."""
    a = a_inputs.groupBy("accession").agg(F.array_sort(F.collect_set("residue_sha")).alias("residues"), F.array_sort(F.collect_set("fetch_sha")).alias("fetched"), F.count("*").alias("n_records"))
    j = b_inputs.join(a, "accession", "left")
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    verdict = F.when(none("residues") | F.col("residue_sha").isNull(), "unverifiable").when(F.array_contains("residues", F.col("residue_sha")), "verified").otherwise("mismatch")
    recorded = F.when(none("fetched") | F.col("fetch_sha").isNull(), "unavailable").when(F.array_contains("fetched", F.col("fetch_sha")), "agrees").otherwise("differs")
    reason = F.when(none("residues"), "no input of the first caller").when(F.col("residue_sha").isNull(), "input of the second caller not kept")
    return j.select("accession", "mode", verdict.alias("verdict"), reason.alias("reason"), recorded.alias("recorded"), F.greatest(F.coalesce(F.size("residues"), F.lit(0)), F.lit(0)).alias("distinct_inputs"))


def pair_calls(scored: DataFrame, other: DataFrame, identity: DataFrame) -> DataFrame:
    """Each case of the second caller (other: accession, mode, call) beside the first caller's, with the first reason that
    holds why the two can't be paired (null: paired) and the errors of both at order rank."""
    mine = scored.groupBy("accession").agg(F.min_by(F.struct("case_id", "want_order", "said_order", "abstained_at_order"), "case_id").alias("a"))
    j = other.join(mine, "accession", "left").join(identity.select("accession", "mode", "verdict", "recorded"), ["accession", "mode"], "left")
    want, said = F.col("a.want_order"), F.col("a.said_order")
    reason = (
        F.when(F.col("a").isNull(), "not scored as a single element")
        .when(want == "NOT_TE", "negative control")
        .when(want == "OTHER", "expected order outside the vocabulary")
        .when((F.col("verdict") == "mismatch") | (F.col("recorded") == "differs"), "inputs differ")
    )
    right_a = F.coalesce(~F.col("a.abstained_at_order") & (said == want), F.lit(False))
    right_b = F.coalesce(~F.col("call").isin("NO_CALL", "OTHER") & (F.col("call") == want), F.lit(False))
    return j.select("accession", "mode", reason.alias("reason"), want.alias("expected"), said.alias("a_call"), F.col("call").alias("b_call"), F.col("a.abstained_at_order").alias("a_abstained"), right_a.alias("a_right"), right_b.alias("b_right"), order_error(said, want).alias("a_wrong"), order_error(F.col("call"), want).alias("b_wrong"))


def paired_comparison(pairs: DataFrame) -> DataFrame:
    """Per mode: cases considered, paired and excluded by reason (they add up, else the job fails), who was right, what
    abstaining cost or spared, and errors over the paired cases alone and with the negative controls."""
    paired, control = F.col("reason").isNull(), F.col("reason") == "negative control"
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    a, b, silent = F.col("a_right"), F.col("b_right"), F.col("a_abstained")
    out = pairs.groupBy("mode").agg(
        F.count("*").alias("considered"),
        n(paired).alias("paired"),
        n(F.col("reason") == "not scored as a single element").alias("unscored"),
        n(control).alias("controls"),
        n(F.col("reason") == "expected order outside the vocabulary").alias("outside"),
        n(F.col("reason") == "inputs differ").alias("inputs_differ"),
        n(paired & a & b).alias("both"),
        n(paired & a & ~b).alias("a_only"),
        n(paired & ~a & b).alias("b_only"),
        n(paired & ~a & ~b).alias("neither"),
        n(paired & silent & b).alias("abstention_cost"),
        n(paired & silent & ~b & (F.col("b_call") != "NO_CALL")).alias("abstention_gain"),
        n(paired & F.col("a_wrong")).alias("a_errors"),
        n(paired & F.col("b_wrong")).alias("b_errors"),
        n((paired | control) & F.col("a_wrong")).alias("a_errors_with_controls"),
        n((paired | control) & F.col("b_wrong")).alias("b_errors_with_controls"),
        n((paired | control) & (F.col("a_call") == "OTHER")).alias("a_outside"),
        n((paired | control) & (F.col("b_call") == "OTHER")).alias("b_outside"),
    )
    adds_up = F.col("considered") == F.col("paired") + F.col("unscored") + F.col("controls") + F.col("outside") + F.col("inputs_differ")
    out = out.withColumn("considered", F.when(adds_up, F.col("considered")).otherwise(F.raise_error(F.lit("the exclusion ledger does not account for every case")).cast("long")))
    share = lambda c: F.round(F.when(F.col("paired") > 0, (F.col("both") + F.col(c)) / F.col("paired")), 4)
    return out.select("*", share("a_only").alias("a_accuracy"), share("b_only").alias("b_accuracy"))
