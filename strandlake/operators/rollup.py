"""From domain hits and structural evidence to one call per element, with its confidence and ledger.

One aggregate per element computes flags; ordered CASE expressions read them. Advisory evidence is never credited.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import apart, shares, stored

#: Domain codes in the order in which an architecture is written.
CODE_ORDER = ("ORF1", "GAG", "PR", "EN", "RT", "RNaseH", "INT", "YR", "CHR", "ENV", "TPase", "HEL")
#: Fixed value: length from which an inverted repeat stands for itself.
LONE_TIR = 20

# What the class of a transposase holds and the group it names, first that fits; models of a capsid or
# matrix, which a nucleocapsid finger is not; names of ledger entries that are no domains.
GROUPS = (("hAT", "hAT"), ("Tc1-Mariner", "Tc1-Mariner"), ("CACTA", "CACTA"), ("MULE", "MULE"), ("IS4", "IS4-like"), ("DDE", "DDE"))
GAG_CORE = ("Gag_p24", "Gag_p24_C", "Gag_p10", "PEG10_N-capsid")
TAIL, TIR5, TIR3 = "3′ tail (poly-A / poly-T)", "TIR (5′)", "TIR (3′)"

_RETRO = "orf1 OR (domains LIKE '%EN,%') OR rnaseh OR gag OR pr OR env"
#: The class of an element from its flags, first rule that holds.
TE_CLASS = f"""CASE
    WHEN rt AND yr AND NOT intg THEN 'DIRS'
    WHEN rt AND intg AND ltr AND NOT coalesce(readable, false) THEN 'LTR/unclassified'
    WHEN rt AND intg AND ltr AND int_first THEN 'LTR/Copia'
    WHEN rt AND intg AND ltr THEN 'LTR/Gypsy'
    WHEN rt AND NOT ltr AND NOT intg AND chromo THEN 'LTR/unclassified'
    WHEN rt AND NOT ltr AND NOT intg AND NOT ({_RETRO}) THEN 'retro/unassigned'
    WHEN rt AND NOT ltr AND NOT intg THEN 'LINE'
    WHEN rt THEN 'LTR/unclassified'
    WHEN tpase THEN 'DNA/' || tp_group
    WHEN hel THEN 'unclassified'
    WHEN n_domains > 0 AND ltr THEN 'LTR/partial'
    WHEN gag OR env OR intg OR orf1 THEN 'retro/partial'
    WHEN n_domains > 0 THEN 'unclassified'
    WHEN ltr THEN 'LTR/structural-only'
    WHEN tir AND tir_len >= {LONE_TIR} THEN 'DNA/non-autonomous'
    WHEN tir THEN 'repeat/structural-only'
    ELSE 'none' END"""
CLASS = """CASE WHEN te_class IN ('retro/unassigned', 'unclassified', 'LTR/partial', 'retro/partial', 'LTR/structural-only', 'repeat/structural-only', 'none') THEN 'unclassified'
    WHEN te_class LIKE 'DNA/%' THEN 'Class II' ELSE 'Class I' END"""
CONFIDENCE = """CASE
    WHEN NOT domains_ok THEN 'Candidate'
    WHEN tp_conflict AND tpase AND NOT rt THEN 'Candidate'
    WHEN te_class IN ('LTR/Copia', 'LTR/Gypsy') AND rt AND ltr AND n_domains >= 2 THEN CASE WHEN tpase THEN 'Moderate' ELSE 'High' END
    WHEN te_class = 'LINE' THEN CASE WHEN poly THEN 'Moderate' ELSE 'Candidate' END
    WHEN (rt AND (ltr OR tir)) OR (tpase AND (ltr OR tir_ok)) THEN 'Moderate'
    WHEN rt OR tpase THEN CASE WHEN n_domains >= 2 THEN 'Moderate' ELSE 'Candidate' END
    ELSE 'Candidate' END"""


#: Width of the cells that spans of an element are dealt to before they are joined.
CELL = 4096


def _cells(start: str, end: str) -> Column:
    return F.explode(F.sequence(F.floor(F.col(start) / CELL), F.floor((F.greatest(F.col(end), F.col(start) + 1) - 1) / CELL)))


#: Hits of an overlap island that are folded at once; larger islands go by rounds.
FOLDED = 1024
#: Width of the bins in which islands begin to be told apart, and of the cells that rounds compare hits in.
BIN, ROUND_CELL = 1 << 16, 512


def _islands(hits: DataFrame, keys: list[str]) -> DataFrame:
    """hits with __i, where their overlap island starts. Reach and last start are carried from bin to bin, so that only a
    bin's hits are sorted in one task."""
    bins = [*keys, "__bin"]
    rows = hits.withColumn("__bin", F.floor(F.col("start") / BIN))
    along = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*bins).agg(F.max("end").alias("__end")).withColumn("__carry", F.max("__end").over(along)).drop("__end")
    order = Window.partitionBy(*bins).orderBy("start", "end", "hit_id")
    reach = F.greatest(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("__carry"))
    fresh = rows.join(carried, bins).withColumn("__new", F.when(F.coalesce(F.col("start") < reach, F.lit(False)), None).otherwise(F.col("start")))
    begun = fresh.groupBy(*bins).agg(F.max("__new").alias("__last")).withColumn("__open", F.max("__last").over(along)).drop("__last")
    own = F.max("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return fresh.withColumn("__own", own).join(begun, bins).withColumn("__i", F.coalesce("__own", "__open")).drop("__bin", "__carry", "__new", "__own", "__open")


def _kept_by_rounds(hits: DataFrame, keys: list[str]) -> DataFrame:
    """hit_id of the hits that the greedy choice keeps, whatever the size of islands: a hit that is the best of each cell
    it touches is kept, those it overlaps go, and the rest is looked at again. A cell has one such hit a round."""
    cells = F.explode(F.sequence(F.floor(F.col("start") / ROUND_CELL), F.floor((F.greatest(F.col("end"), F.col("start") + 1) - 1) / ROUND_CELL)))
    rank = F.struct((-F.col("score")).alias("o"), F.col("hit_id").alias("hit_id"))
    open_, kept = hits.select(*keys, "hit_id", "score", "start", "end"), None
    while not open_.isEmpty():
        dealt = open_.withColumn("__cell", cells)
        first = dealt.groupBy(*keys, "__cell").agg(F.min(rank).alias("__b")).select(*keys, "__cell", F.col("__b.hit_id").alias("__best"))
        won = dealt.join(first, [*keys, "__cell"]).groupBy(*keys, "hit_id", "start", "end").agg(F.bool_and(F.col("hit_id") == F.col("__best")).alias("__won")).where("__won")
        won = stored(won.select(*keys, F.col("hit_id").alias("__k"), F.col("start").alias("__s"), F.col("end").alias("__e")), "kept-hits")
        kept = won.select(F.col("__k").alias("hit_id")) if kept is None else kept.union(won.select("__k"))
        held = won.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__s") / ROUND_CELL), F.floor((F.greatest(F.col("__e"), F.col("__s") + 1) - 1) / ROUND_CELL))))
        near = dealt.join(held, [*keys, "__cell"], "left")
        gone = F.coalesce((F.col("hit_id") == F.col("__k")) | ((F.col("start") < F.col("__e")) & (F.col("__s") < F.col("end"))), F.lit(False))
        left = near.groupBy(*keys, "hit_id", "score", "start", "end").agg(F.bool_or(gone).alias("__gone")).where("NOT __gone").drop("__gone")
        open_ = stored(left, "open-hits")
    return hits.select("hit_id").limit(0) if kept is None else kept


def dedup_domain_hits(hits: DataFrame) -> DataFrame:
    """Of overlapping hits of one domain and strand the best, greedily by score: a hit that only overlaps a dropped one
    stays. Small overlap islands are folded in place; larger ones go by rounds of hits that beat all around them."""
    keys = ["seq_id", "domain", "strand"]
    islands = stored(_islands(hits.select(*keys, "hit_id", "score", "start", "end"), keys), "islands")
    row = F.struct((-F.col("score")).alias("o"), "hit_id", "start", "end")
    sizes = islands.groupBy(*keys, "__i").agg(F.count("*").alias("__n"))
    large = stored(sizes.where(F.col("__n") > FOLDED), "large-islands")
    small = islands.join(large, [*keys, "__i"], "left_anti")
    folded = small.groupBy(*keys, "__i").agg(F.array_sort(F.collect_list(row)).alias("h"))
    kept = F.aggregate("h", F.slice("h", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"])), acc).otherwise(F.concat(acc, F.array(x))))
    ids = folded.select(F.explode(kept).alias("k")).select(F.col("k.hit_id").alias("hit_id"))
    if not large.isEmpty():
        ids = ids.union(_kept_by_rounds(islands.join(large, [*keys, "__i"], "left_semi"), keys))
    return hits.join(ids, "hit_id", "left_semi")


def representative_hit(hits: DataFrame) -> DataFrame:
    """The best-scoring hit of each domain (ties: the smaller hit_id)."""
    best = F.max_by(F.struct("hit_id", "class", "score", "strand", "start", "end"), F.struct("score", -F.col("hit_id")))
    return hits.groupBy("seq_id", "domain").agg(best.alias("b")).select("seq_id", "domain", "b.*")


def architecture_order(reps: DataFrame, a: str, b: str) -> DataFrame:
    """Whether a stands before b in translation; resolvable on one strand without overlap only."""
    pick = lambda code, name: reps.where(F.col("domain") == code).select("seq_id", *(F.col(c).alias(f"{name}_{c}") for c in ("strand", "start", "end")))
    j = pick(a, "a").join(pick(b, "b"), "seq_id")
    same = (F.col("a_strand") == F.col("b_strand")) & ((F.col("a_end") <= F.col("b_start")) | (F.col("b_end") <= F.col("a_start")))
    first = F.when(F.col("a_strand") == "-", F.col("a_end") > F.col("b_end")).otherwise(F.col("a_start") < F.col("b_start"))
    return j.select("seq_id", same.alias("resolvable"), F.when(same, first).alias("a_before_b"))


def element_flags(hits: DataFrame, evidence: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """One row per element that has a hit or credited evidence: all that the rules read. failed: seq_id of elements whose
    domain scan did not run (domains_ok is false there: what is not found was not looked for). All tables are dealt out by
    element alike, over tasks that follow the input, so that their aggregates meet without another shuffle."""
    n = shares(hits)
    hits, evidence = hits.repartition(n, "seq_id"), evidence.repartition(n, "seq_id")
    has = lambda code: F.coalesce(F.bool_or(F.col("domain") == code), F.lit(False))
    coded = hits.groupBy("seq_id").agg(
        *(has(c).alias(n) for c, n in (("RT", "rt"), ("INT", "intg"), ("TPase", "tpase"), ("YR", "yr"), ("CHR", "chromo"), ("ENV", "env"), ("GAG", "gag"), ("PR", "pr"), ("RNaseH", "rnaseh"), ("ORF1", "orf1"), ("HEL", "hel"))),
        F.bool_or(F.col("model").isin(*GAG_CORE)).alias("gag_core"),
        F.countDistinct("domain").alias("n_domains"),
        F.concat(F.array_join(F.array_sort(F.collect_set("domain")), ","), F.lit(",")).alias("domains"),
        F.max_by("class", F.when(F.col("domain") == "TPase", F.struct("score", -F.col("hit_id")))).alias("tp_class"),
        (F.countDistinct(F.when(F.col("domain") == "TPase", F.col("class"))) > 1).alias("tp_conflict"),
    )
    credited = evidence.where(~F.col("advisory"))
    kind = lambda *names: F.bool_or(F.col("kind").isin(*names))
    arms = F.min_by(F.struct("start", "end"), F.when(F.col("kind") == "TIR", F.struct("start", "end")))
    marks = credited.groupBy("seq_id").agg(
        kind("LTR").alias("ltr"), kind("TIR").alias("tir"), kind("TSD").alias("tsd"), kind("polyA", "polyT").alias("poly"), F.max(F.when(F.col("kind") == "TIR", F.col("length"))).alias("tir_len"), arms.alias("arms")
    )
    reps = apart(representative_hit(hits))
    order = architecture_order(reps, "INT", "RT").select("seq_id", F.col("resolvable").alias("readable"), F.col("a_before_b").alias("int_first"))
    # an endonuclease counts as the element's own where it is read before the reverse transcriptase on one strand
    lead = F.when(F.col("strand") == "-", -F.col("end")).otherwise(F.col("start"))
    at = lambda code, name: reps.where(F.col("domain") == code).select("seq_id", F.col("strand").alias(f"{name}_strand"), lead.alias(f"{name}_at"))
    en = at("EN", "en").join(at("RT", "rt"), "seq_id").select("seq_id", ((F.col("en_strand") == F.col("rt_strand")) & (F.col("en_at") < F.col("rt_at"))).alias("en_ok"))
    tp = reps.where("domain = 'TPase'").select("seq_id", F.col("start").alias("tp_start"), F.col("end").alias("tp_end"))
    joined = coded.join(marks, "seq_id", "full").join(apart(order), "seq_id", "left").join(tp, "seq_id", "left").join(apart(en), "seq_id", "left")
    none = F.lit(True).alias("domains_ok")
    if failed is not None:
        joined = joined.join(apart(failed.select("seq_id").repartition(n, "seq_id").distinct().withColumn("__ok", F.lit(False))), "seq_id", "left")
        none = F.coalesce("__ok", F.lit(True)).alias("domains_ok")
    flags = [c for c, t in joined.dtypes if t == "boolean" and c not in ("readable", "int_first", "__ok")]
    group = F.coalesce(*(F.when(F.col("tp_class").contains(x), g) for x, g in GROUPS), F.lit("unclassified")).alias("tp_group")
    out = joined.select("seq_id", "domains", "tp_class", group, none, "tir_len", "readable", "int_first", "arms", "tp_start", "tp_end", F.coalesce("n_domains", F.lit(0).cast("long")).alias("n_domains"), *(F.coalesce(c, F.lit(False)).alias(c) for c in flags))
    encloses = (F.col("arms.start") <= F.col("tp_start")) & (F.col("tp_end") <= F.col("arms.end"))
    return out.withColumn("tir_ok", F.col("tir") & F.coalesce(encloses, F.lit(True))).drop("arms", "tp_start", "tp_end")


#: What a call holds besides its element.
CALL = ("class", "te_class", "confidence", "is_erv", "composite", "architecture")


def _called(flags: DataFrame) -> DataFrame:
    """flags with the columns of CALL."""
    called = flags.withColumn("te_class", F.expr(TE_CLASS)).withColumn("class", F.expr(CLASS)).withColumn("confidence", F.expr(CONFIDENCE))
    erv = F.col("rt") & F.col("ltr") & F.col("env") & ~(F.col("yr") & ~F.col("intg"))
    return called.select("*", erv.alias("is_erv"), (F.col("rt") & F.col("tpase")).alias("composite"), order_string(F.split(F.coalesce("domains", F.lit("")), ",")).alias("architecture"))


def classify_elements(flags: DataFrame) -> DataFrame:
    """te_class, class, confidence, whether it is an endogenous retrovirus or a composite locus, and the architecture."""
    return _called(flags).select("seq_id", *CALL)


def order_string(codes: Column) -> Column:
    """Codes in canonical order, then unknown ones in the order of the alphabet, joined by dashes."""
    known = F.filter(F.array(*map(F.lit, CODE_ORDER)), lambda c: F.array_contains(codes, c))
    rest = F.array_sort(F.array_except(codes, F.array(F.lit(""), *map(F.lit, CODE_ORDER))))
    return F.array_join(F.concat(known, rest), "-")


def completeness_ledger(flags: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Expected, present and missing modules by the kind of element, and a tier that follows from them. keep: columns of
    flags that stay beside them.

    An endonuclease counts only before the reverse transcriptase (en_ok), both arms of an inverted repeat only around the
    transposase (tir_ok); the top tiers of retroelements take a capsid or matrix (gag_core). Elements without anything
    have tier and kind ``none``.
    """
    codes = F.split(F.coalesce("domains", F.lit("")), ",")
    listed = lambda *names: F.array(*map(F.lit, names))
    some = lambda flag, *names: F.when(flag, listed(*names)).otherwise(F.slice(listed(""), 1, 0))
    rt, intg, ltr, env, core = (F.col(c) for c in ("rt", "intg", "ltr", "env", "gag_core"))
    dirs, retro = rt & F.col("yr") & ~intg, rt & (ltr | intg)
    own = F.filter(listed(*CODE_ORDER), lambda c: F.array_contains(codes, c))
    expected = (
        F.when(dirs, listed("GAG", "RT", "RNaseH", "YR"))
        .when(retro, F.concat(listed("GAG", "PR", "RT", "RNaseH", "INT"), some(env, "ENV")))
        .when(rt, listed("ORF1", "EN", "RT", TAIL))
        .when(F.col("tpase"), listed("TPase", TIR5, TIR3))
        .otherwise(own)
    )
    line = rt & ~dirs & ~retro
    domains = F.filter(codes, lambda c: (c != "EN") | ~line)
    owned = F.concat(domains, some(line & F.col("en_ok"), "EN"), some(F.col("poly"), TAIL), some(F.col("tir_ok"), TIR5, TIR3))
    out = flags.select("*", expected.alias("expected"), owned.alias("owned"))
    out = out.withColumn("present", F.array_intersect("expected", "owned")).withColumn("missing", F.array_except("expected", "owned"))
    whole, held = F.size("missing") == 0, lambda c: F.array_contains("present", c)
    readable = ltr & intg & F.coalesce("readable", F.lit(False))
    full = "intact / autonomous-consistent"
    tier = (
        F.when(dirs, F.when(core & whole, full).otherwise("partial (DIRS core present: RT + tyrosine recombinase)"))
        .when(
            retro,
            F.when(core & intg & whole & ltr & readable, full)
            .when(core & intg & ltr, "near-complete")
            .when(core & intg & env, "coding core present (gag + pol; env); LTRs not confirmed")
            .when(core & intg, "coding core present (gag + pol); LTRs not confirmed")
            .when(core & ltr, "partial (gag + RT core present; integrase not confirmed)")
            .when(intg & ~whole, "partial (pol core present)")
            .when(intg, "partial (pol core present; gag capsid/matrix not confirmed)")
            .otherwise("fragment"),
        )
        .when(rt, F.when(whole, full).when(held("ORF1") & held("EN"), "near-complete (ORF1 + ORF2 endonuclease and RT recovered)").when(held("ORF1") | held("EN"), "partial (LINE coding core incomplete)").otherwise("partial (RT only)"))
        .when(F.col("tpase"), F.when(whole, full).otherwise("partial (transposase present)"))
        .when(F.col("n_domains") > 0, F.concat(F.lit("coding fragment ("), F.array_join("present", "–"), F.when(ltr | F.col("tir"), " detected; RT/pol not confirmed)").otherwise(" detected; no structural context)")))
        .when(ltr | F.col("tir"), "structural-only (terminal repeats, no coding domain detected)")
        .otherwise("none")
    )
    kind = (
        F.when(dirs, "DIRS-group retroelement (tyrosine recombinase)")
        .when(retro, F.when(ltr & env, "ERV (env-bearing LTR retroelement)").when(ltr, "LTR retroelement").otherwise("retroelement (LTR not confirmed)"))
        .when(rt, "non-LTR retroelement (LINE-like)")
        .when(F.col("tpase"), F.when(F.col("tir_ok"), "DNA transposon").otherwise("DNA transposon (terminal repeats not confirmed)"))
        .when(ltr, "LTR retroelement")
        .when(F.col("tir"), "DNA transposon")
        .when(F.col("n_domains") > 0, "coding fragment")
        .otherwise("none")
    )
    return out.select("seq_id", *keep, F.array_join("expected", ",").alias("expected"), F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"), tier.alias("tier"), kind.alias("kind"))


def coding_frames(hits: DataFrame, orfs: DataFrame) -> DataFrame:
    """Distinct frames that host an element's domains: the first that contains the hit on its strand."""
    o = orfs.select("seq_id", "strand", "orf_key", F.col("start").alias("o_start"), F.col("end").alias("o_end"), _cells("start", "end").alias("__cell"))
    # a frame that contains the hit covers the cell in which the hit starts
    near = hits.withColumn("__cell", F.floor(F.col("start") / CELL)).join(o, ["seq_id", "strand", "__cell"], "left").withColumn("host", F.when((F.col("o_start") <= F.col("start")) & (F.col("end") <= F.col("o_end")), F.col("orf_key")))
    placed = near.groupBy("seq_id", "hit_id").agg(F.min("host").alias("host"))
    out = placed.groupBy("seq_id").agg(F.countDistinct("host").alias("frames"), F.count_if(F.col("host").isNull()).alias("unplaced"))
    state = F.when(F.col("frames") == 0, "not assessed").when((F.col("frames") == 1) & (F.col("unplaced") == 0), "single reading frame").otherwise("split across reading frames")
    return out.select("seq_id", "frames", "unplaced", state.alias("state"))


def encloses(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """Per inner span (i_id): how many outer spans of its element (o_id) hold it, and whether any does. Cells and spans are
    dealt over tasks that follow the input."""
    n = shares(inner)
    o = outer.select("seq_id", "o_id", F.col("start").alias("o_start"), F.col("end").alias("o_end"), _cells("start", "end").alias("__cell"))
    i = inner.select("seq_id", "i_id", "start", "end", F.floor(F.col("start") / CELL).alias("__cell"))
    j = i.repartition(n, "seq_id", "__cell").join(o.repartition(n, "seq_id", "__cell"), ["seq_id", "__cell"], "left")
    holds = F.coalesce((F.col("o_start") <= F.col("start")) & (F.col("end") <= F.col("o_end")), F.lit(False))
    return j.select("seq_id", "i_id", holds.alias("holds")).repartition(n, "seq_id", "i_id").groupBy("seq_id", "i_id").agg(F.count_if("holds").alias("n_enclosing")).withColumn("encloses", F.col("n_enclosing") > 0)


def explain_call(calls: DataFrame, evidence: DataFrame) -> DataFrame:
    """One line per element: its class, confidence, structures and architecture."""
    kinds = evidence.where(~F.col("advisory")).groupBy("seq_id").agg(F.array_join(F.array_sort(F.collect_set("kind")), ", ").alias("kinds"))
    none = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) == "", "none").otherwise(F.col(c))
    line = F.concat(F.lit("Classified as "), "te_class", F.lit(" ("), F.lower("confidence"), F.lit("). Structural: "), none("kinds"), F.lit(". Domains: "), none("architecture"), F.lit("."))
    return calls.join(apart(kinds), "seq_id", "left").select("seq_id", line.alias("explanation"))


def unsearched_scope(orfs: DataFrame, scans: DataFrame, budget: int = 12) -> DataFrame:
    """Frames of an element outside the search budget, and whether its scan ran at all."""
    n = orfs.groupBy("seq_id").agg(F.greatest(F.lit(0).cast("long"), F.count("*") - budget).alias("unscanned"))
    return n.join(scans.select("seq_id", F.lit(True).alias("ran")).distinct(), "seq_id", "left").select("seq_id", "unscanned", F.coalesce("ran", F.lit(False)).alias("ran"))


#: Beginnings of a class and the ontology term that it may claim.
TERMS = (
    ("LTR/", "LTR_retrotransposon"),
    ("LINE", "LINE_element"),
    ("SINE", "SINE_element"),
    ("DIRS", "YR_retrotransposon"),
    ("DNA/", "terminal_inverted_repeat_element"),
    ("HEL", "helitron"),
)


def _term() -> Column:
    """so_term from te_class, tier, present and missing."""
    t = F.coalesce("te_class", F.lit("none"))
    listed = lambda c: F.split(F.coalesce(c, F.lit("")), ",")
    term = F.lit("repeat_region")
    for prefix, name in reversed(TERMS):
        claimed = F.lit(name)
        if name == "terminal_inverted_repeat_element":
            claimed = F.when(F.array_contains(listed("missing"), TIR5), "DNA_transposon").otherwise(name)
        elif name == "LTR_retrotransposon":
            claimed = F.when(F.array_contains(listed("present"), "RT"), name).otherwise("repeat_region")
        term = F.when(t.startswith(prefix), claimed).otherwise(term)
    bare = t.isin("", "none") | F.contains(t, F.lit("structural-only")) | F.contains(F.coalesce("tier", F.lit("")), F.lit("structural-only"))
    return F.when(bare, "repeat_region").otherwise(term).alias("so_term")


def ontology_term(calls: DataFrame, ledger: DataFrame) -> DataFrame:
    """The sequence ontology term that a call may claim by its ledger (tier, present, missing); without the evidence for
    it a more general one: nothing coding is a repeat_region, so is an LTR element without RT, and a transposase whose
    inverted repeats are missing is a DNA_transposon."""
    return calls.join(apart(ledger.select("seq_id", "tier", "present", "missing")), "seq_id", "left").select("seq_id", "te_class", _term())


def annotated_elements(flags: DataFrame) -> DataFrame:
    """Call, ledger and ontology term of each element. All follow from its row of flags, so that nothing is joined."""
    return completeness_ledger(_called(flags), CALL).select("*", _term())
