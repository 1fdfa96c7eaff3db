"""Structural evidence of elements: what stands at and between their terminal repeats, and all detectors together.

Terminal repeats are rows ltr (seq_id, s5, e5, s3, e3): the spans of the two copies. Thresholds come from params.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import stored
from .params import value
from .profile import count_of, cut
from .repeats import TSD_LENGTH, inverted_repeat_seeds, matches, tail_scan, target_site_duplications, terminal_direct_repeats, terminal_inverted_repeats

#: The usual motif of the ends (first two and last two bases), and others in the order they are tried.
CANONICAL = "TGCA"
MOTIFS = ("TCCA", "TGCT", "TACA", "TACT", "TGGA", "TATA", "TGTA")
#: Primer-binding sites by the tRNA that primes there.
PRIMING = {"tRNA-Lys3": "TGGCGCCCGAACAGGGAC"}
#: Hexamers of polyadenylation signals and how common each is.
HEXAMERS = {
    "AATAAA": "canonical",
    "ATTAAA": "principal variant",
    "AGTAAA": "minor variant",
    "TATAAA": "minor variant",
    "CATAAA": "minor variant",
    "GATAAA": "minor variant",
    "AATATA": "minor variant",
    "AATACA": "minor variant",
    "AATAGA": "minor variant",
    "ACTAAA": "minor variant",
    "AAGAAA": "minor variant",
    "AATGAA": "minor variant",
}
RANKS = ("canonical", "principal variant", "minor variant")
#: Codes of the modules before the envelope.
BODY = ("GAG", "PR", "RT", "RNaseH", "INT")
FOUND, NO_RECORD, NO_BASES, ABSENT = "found", "not assessable: record ends", "not assessable: unknown bases", "absent"


def _on_sequence(spans: DataFrame, seqs: DataFrame) -> DataFrame:
    """A row per element with its bases: elements are rows of seqs, so the join makes as many rows as there are spans."""
    return spans.join(seqs.select("seq_id", "seq", F.length("seq").alias("n_seq")), "seq_id")


def termini_motif(ltr: DataFrame, seqs: DataFrame) -> DataFrame:
    """The dinucleotides at both ends of both copies against the usual motif; only where they differ from it, the first
    other motif that all four fit."""
    two = lambda at: cut("seq", at, F.lit(2))
    ends = _on_sequence(ltr, seqs).select("seq_id", two(F.col("s5")).alias("five_start"), two(F.col("e5") - 2).alias("five_end"), two(F.col("s3")).alias("three_start"), two(F.col("e3") - 2).alias("three_end"))

    def differ(motif: str) -> Column:
        return sum((F.col(c) != motif[:2] if c.endswith("start") else F.col(c) != motif[2:]).cast("int") for c in ("five_start", "five_end", "three_start", "three_end"))

    other = F.coalesce(*(F.when(differ(m) == 0, m) for m in MOTIFS))
    out = ends.withColumn("mismatches", differ(CANONICAL)).withColumn("motif", F.when(F.col("mismatches") == 0, CANONICAL).otherwise(other))
    tier = F.when(F.col("mismatches") == 0, "canonical").when(F.col("motif").isNotNull(), "non-canonical").otherwise("none")
    return out.select("seq_id", "five_start", "five_end", "three_start", "three_end", "mismatches", (F.col("mismatches") <= 1).alias("within_tolerance"), tier.alias("tier"), "motif")


def primer_binding_site(ltr: DataFrame, seqs: DataFrame, panel: dict[str, str] = PRIMING, strong: float = 0.72) -> DataFrame:
    """The best match of a panel site after the first copy; ties to the panel's order, then to the first place."""
    search, least = value("pbs_search_window"), value("pbs_min_identity")
    lead = _on_sequence(ltr, seqs).select("seq_id", "e5", cut("seq", F.col("e5"), F.lit(search)).alias("lead"))

    def tried(rank: int, name: str, site: str) -> Column:
        n = len(site)
        part = lambda i: cut("lead", i, F.lit(n))
        here = lambda i: F.struct((matches(part(i), F.lit(site)) / n).alias("identity"), F.lit(-rank).alias("r"), (-i).alias("back"), F.lit(name).alias("name"), part(i).alias("motif"))
        return F.array_max(F.when(F.length("lead") >= n, F.transform(F.sequence(F.lit(0), F.length("lead") - n), here)))

    best = F.array_max(F.array(*(tried(rank, name, site) for rank, (name, site) in enumerate(panel.items()))))
    out = lead.select("seq_id", "e5", best.alias("b")).where(F.col("b.identity") >= least)
    start, confident = F.col("e5") - F.col("b.back"), F.col("b.identity") >= strong
    return out.select(
        "seq_id", start.cast("int").alias("start"), (start + F.length("b.motif")).cast("int").alias("end"), F.when(confident, F.col("b.name")).otherwise("undetermined").alias("priming_trna"),
        F.col("b.name").alias("best_match"), F.round(100 * F.col("b.identity"), 1).alias("identity"), confident.alias("confident"), F.col("b.motif").alias("motif"),
    )


def polypurine_tract(ltr: DataFrame, seqs: DataFrame) -> DataFrame:
    """The longest purine-rich tract that ends at the second copy: it starts on two purines, holds few others and no N."""
    window, least, share, most = value("ppt_window"), value("ppt_min_len"), value("ppt_min_purine"), value("ppt_max_defects")
    room = F.least(F.col("s3"), F.lit(window))
    # turned, so that a tract is a prefix
    region = _on_sequence(ltr, seqs).select("seq_id", "s3", F.reverse(cut("seq", F.col("s3") - room, room)).alias("r"))

    def fits(n):
        tract = cut("r", F.lit(0), n)
        pure = count_of(tract, "AG")
        return ~F.contains(tract, F.lit("N")) & (n - pure <= most) & tract.rlike("[AG][AG]$") & (pure >= share * n)

    best = F.when(F.length("r") >= least, F.array_max(F.filter(F.sequence(F.lit(least), F.length("r")), fits)))
    out = region.withColumn("length", best).where(F.col("length").isNotNull())
    tract = F.reverse(cut("r", F.lit(0), F.col("length")))
    return out.select("seq_id", (F.col("s3") - F.col("length")).cast("int").alias("start"), F.col("s3").cast("int").alias("end"), "length", F.round(count_of(tract, "AG") / F.col("length"), 2).alias("purine_frac"), tract.alias("motif"))


def polya_signal(ltr: DataFrame, seqs: DataFrame, low: int = 20, high: int = 60, min_gt: float = 0.65, min_t: int = 4) -> DataFrame:
    """The best hexamer in the second copy: one followed by a stretch rich in G and T first, then the commoner, then the
    first. None where the stretch is there but not rich; whether the first copy has the hexamer at the same offset."""
    base = _on_sequence(ltr, seqs).select("seq_id", "seq", "n_seq", "s5", "s3", "e3", cut("seq", F.col("s3"), F.col("e3") - F.col("s3")).alias("copy"))
    known = F.array(*map(F.lit, HEXAMERS))
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("copy") - 6)), lambda i: F.array_contains(known, cut("copy", i, F.lit(6))))
    hits = base.select("*", F.explode(at).alias("offset")).withColumn("motif", cut("copy", F.col("offset"), F.lit(6)))
    begin = F.col("s3") + F.col("offset") + 6 + low
    hits = hits.withColumn("w", F.when(begin + high - low <= F.col("n_seq"), cut("seq", begin, F.lit(high - low))))
    t, gt = count_of(F.col("w"), "T"), count_of(F.col("w"), "GT") / (high - low)
    state = F.when(F.col("w").isNull(), NO_RECORD).when(F.contains("w", F.lit("N")), NO_BASES).when((gt >= min_gt) & (t >= min_t), FOUND).otherwise(ABSENT)
    variant = F.element_at(F.create_map(*(F.lit(x) for item in HEXAMERS.items() for x in item)), F.col("motif"))
    mirror = cut("seq", F.col("s5") + F.col("offset"), F.lit(6))
    seen = hits.select("seq_id", "s3", "offset", "motif", variant.alias("variant"), state.alias("dse_state"), mirror.alias("mirror"), F.round(gt, 2).alias("gt_frac"), t.alias("t_count"))
    rank = F.struct((F.col("dse_state") != FOUND).alias("missing"), F.array_position(F.array(*map(F.lit, RANKS)), F.col("variant")).alias("rank"), "offset")
    best = seen.groupBy("seq_id").agg(F.min_by(F.struct("s3", "offset", "motif", "variant", "dse_state", "mirror", "gt_frac", "t_count"), rank).alias("b")).select("seq_id", "b.*")
    both, start = F.col("mirror") == F.col("motif"), (F.col("s3") + F.col("offset")).cast("int")
    known_window = F.col("dse_state").isin(FOUND, ABSENT)
    return best.where(F.col("dse_state") != ABSENT).select(
        "seq_id", start.alias("start"), (start + 6).alias("end"), "motif", "variant", "dse_state", F.when(known_window, F.col("gt_frac")).alias("gt_frac"), F.when(known_window, F.col("t_count")).alias("t_count"),
        F.col("mirror").alias("five_prime_copy_motif"), both.alias("in_both"), ((F.col("dse_state") == FOUND) & both).alias("confident"),
    )


def expected_length(superfamily: Column) -> Column:
    """Length of the target site that a superfamily duplicates, by the first word of its name up to a slash."""
    first = F.substring_index(F.substring_index(superfamily, " ", 1), "/", 1)
    table = {name.split("/")[0]: n for name, n in TSD_LENGTH.items()}
    return F.element_at(F.create_map(*(F.lit(x) for item in table.items() for x in item)), first)


def tsd_refine(tsd: DataFrame, calls: DataFrame, seqs: DataFrame) -> DataFrame:
    """tsd (seq_id, start, end, length, motif) once more with the length that the superfamily of calls (seq_id,
    superfamily) expects: taken where it truly flanks the element, else what was found stays."""
    wanted = tsd.join(calls.select("seq_id", expected_length(F.col("superfamily")).alias("expect")).distinct(), "seq_id", "left")
    again = target_site_duplications(wanted.where(F.col("expect").isNotNull() & (F.col("expect") != F.col("length"))).select("seq_id", "start", "end", "expect"), seqs)
    again = again.where("matched_expected").select("seq_id", "start", "end", F.col("length").alias("new_length"), F.col("motif").alias("new_motif")).distinct()
    out = wanted.join(again, ["seq_id", "start", "end"], "left")
    return out.select("seq_id", "start", "end", F.coalesce("new_length", "length").alias("length"), F.coalesce("new_motif", "motif").alias("motif"), F.col("new_length").isNotNull().alias("refined"))


def structural_evidence(seqs: DataFrame) -> DataFrame:
    """All detectors: seq_id, kind, start, end, length, identity, advisory, lower_bound, state, detail.

    A sequence with credited direct repeats (LTR) is not searched for inverted ones (TIR); what belongs to LTR elements
    is only sought there. Repeats that fail the identity floor alone are advisory. state says of a repeat whether its
    target-site duplication was found, is absent, or can't be assessed since the record ends with the element.
    """
    seqs = stored(seqs.select("seq_id", "seq"), "elements")  # read by every detector
    direct = terminal_direct_repeats(seqs, value("ltr_seed_k"), value("ltr_min_len"), value("ltr_min_anchors"), min_identity=value("ltr_min_identity_pct"))
    direct = stored(direct, "direct-repeats")
    ltr = direct.where(~F.col("advisory"))
    rest = seqs.join(ltr.select("seq_id"), "seq_id", "left_anti")
    terminal = terminal_inverted_repeats(rest, value("tir_min_len"), value("tir_max_len"), value("tir_min_identity_pct"))
    terminal = stored(terminal, "terminal-repeats")
    seeded = inverted_repeat_seeds(rest.join(terminal.select("seq_id"), "seq_id", "left_anti"), value("tir_seed_k"), max_len=value("tir_max_len"), min_anchors=value("tir_min_anchors"))
    n = seqs.select("seq_id", F.length("seq").alias("n_seq"))
    text = lambda *parts: F.concat_ws(" ", *parts)

    def rows(df: DataFrame, kind, start, end, length, identity=None, advisory=None, lower=None, detail=None) -> DataFrame:
        no = F.lit(None)
        pick = lambda c, t: (no if c is None else c).cast(t)
        return df.select(
            "seq_id", kind.alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), length.cast("int").alias("length"), pick(identity, "double").alias("identity"),
            F.coalesce(pick(advisory, "boolean"), F.lit(False)).alias("advisory"), F.coalesce(pick(lower, "boolean"), F.lit(False)).alias("lower_bound"), pick(detail, "string").alias("detail"),
        )

    c = F.col
    repeats = rows(direct, F.lit("LTR"), c("s5"), c("e3"), c("ltr_len"), c("identity"), c("advisory"), c("lower_bound"), text(c("e5"), c("s3")))
    repeats = repeats.unionByName(rows(terminal.join(n, "seq_id"), F.lit("TIR"), F.lit(0), c("n_seq"), c("tir_len"), c("identity"), None, c("lower_bound"), text(c("tir_len"), c("n_seq") - c("tir_len"))))
    repeats = repeats.unionByName(rows(seeded, F.lit("TIR"), c("s5"), c("e3"), c("e5") - c("s5"), c("identity"), None, None, text(c("e5"), c("s3"))))
    repeats = stored(repeats, "repeats")
    credited = repeats.where(~c("advisory"))
    tsd = target_site_duplications(credited.select("seq_id", "start", "end", F.lit(None).cast("int").alias("expect")), seqs, value("tsd_min_len"), value("tsd_max_len"))
    tsd = stored(tsd, "site-duplications")
    found = tsd.select("seq_id", "start", "end", F.lit(True).alias("has")).distinct()
    least = value("tsd_min_len")
    state = F.when(c("advisory"), None).when(c("has"), FOUND).when((c("start") < least) | (c("end") + least > c("n_seq")), NO_RECORD).otherwise(ABSENT)
    repeats = repeats.join(found, ["seq_id", "start", "end"], "left").join(n, "seq_id").withColumn("state", state).drop("has", "n_seq")
    parts = [
        rows(tsd, F.lit("TSD"), c("start") - c("length"), c("end") + c("length"), c("length"), detail=c("motif")),
        rows(primer_binding_site(ltr, seqs), F.lit("PBS"), c("start"), c("end"), c("end") - c("start"), c("identity"), None, None, text("priming_trna", "motif")),
        rows(polypurine_tract(ltr, seqs), F.lit("PPT"), c("start"), c("end"), c("length"), 100 * c("purine_frac"), None, None, c("motif")),
        rows(polya_signal(ltr, seqs), F.lit("polyA-signal"), c("start"), c("end"), F.lit(6), None, F.lit(True), None, text("motif", "variant", "dse_state")),
        rows(tail_scan(seqs, value("polya_min_run")), c("kind"), c("start"), c("end"), c("length")),
    ]
    out = repeats
    for part in parts:
        out = out.unionByName(part.withColumn("state", F.lit(None).cast("string")))
    return out.select("seq_id", "kind", "start", "end", "length", "identity", "advisory", "lower_bound", "state", "detail")


def subgenomic_architecture(calls: DataFrame, ltr: DataFrame, hits: DataFrame) -> DataFrame:
    """Leader exon, intron and envelope exon of endogenous retroviruses, from the inner edges of the repeats (ltr: seq_id,
    low, high) and the domain hits; no row where the spans are not in order inside the repeats.

    calls: seq_id, is_erv. The strand is that of most body and envelope hits (+ on a tie).
    """
    erv = calls.where("is_erv").select("seq_id").join(ltr.select("seq_id", "low", "high"), "seq_id")
    env, body = F.col("domain") == "ENV", F.col("domain").isin(*BODY)
    votes = F.count_if((env | body) & (F.col("strand") == "-")) > F.count_if((env | body) & (F.col("strand") != "-"))
    per = hits.groupBy("seq_id").agg(votes.alias("minus"), F.min(F.when(env, F.col("start"))).alias("env_low"), F.max(F.when(env, F.col("end"))).alias("env_high"))
    base = erv.join(per, "seq_id").where("env_low is not null")
    near = hits.where(body).select("seq_id", "start", "end").join(base, "seq_id")
    near = near.where(F.when(F.col("minus"), F.col("start") >= F.col("env_high")).otherwise(F.col("end") <= F.col("env_low")))
    edge = near.groupBy("seq_id", "low", "high", "minus", "env_low", "env_high").agg(F.min("start").alias("body_low"), F.max("end").alias("body_high"))
    pick = lambda minus, plus: F.when(F.col("minus"), minus).otherwise(plus)
    c = F.col
    out = edge.select(
        "seq_id", "low", "high", pick(F.lit("-"), F.lit("+")).alias("strand"),
        pick(c("body_high"), c("low")).alias("leader_start"), pick(c("high"), c("body_low")).alias("leader_end"),
        pick(c("env_high"), c("body_low")).alias("intron_start"), pick(c("body_high"), c("env_low")).alias("intron_end"),
        pick(F.greatest("env_low", "low"), c("env_low")).alias("env_start"), pick(c("env_high"), F.least("env_high", "high")).alias("env_end"),
    )
    whole = (c("leader_start") < c("leader_end")) & (c("intron_start") < c("intron_end")) & (c("env_start") < c("env_end"))
    plus = (c("leader_end") <= c("intron_start")) & (c("intron_end") <= c("env_start")) & (c("leader_start") >= c("low")) & (c("env_end") <= c("high"))
    minus = (c("env_end") <= c("intron_start")) & (c("intron_end") <= c("leader_start")) & (c("env_start") >= c("low")) & (c("leader_end") <= c("high"))
    return out.where(whole & F.when(c("strand") == "+", plus).otherwise(minus)).drop("low", "high")
