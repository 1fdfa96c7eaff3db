"""In-silico PCR: primer sites by a seed join, extension, amplicons by a bucketed range join, and summaries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.letters import CODE, blocks, text_bytes, texts, words_at
from ..functions.tables import stored
from .profile import count_of, cut, pieces, reverse_complement

#: Bases that a nucleotide code stands for.
COVERS = {
    "A": "A", "C": "C", "G": "G", "T": "T", "U": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}


#: Bases that a key may have, and bits of a look-up: keys of up to 10 bases have a bit of their own, longer ones share.
WORD, SLOT = 31, 20


def _covers(code: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for item in COVERS.items() for x in item)), code)


def mismatches(primer: Column, site: Column) -> Column:
    """Array of 1-based places where the template base is not covered by the primer's code."""
    pairs = F.zip_with(F.split(primer, ""), F.split(site, ""), lambda p, t: ~F.coalesce(F.contains(_covers(p), t) & (t != ""), F.lit(False)))
    return F.filter(F.transform(pairs, lambda bad, i: F.when(bad, i + 1)), lambda i: i.isNotNull())


def concrete(seed: Column, length: int) -> Column:
    """All concrete words that a degenerate word of the given length stands for."""
    words = F.array(F.lit(""))
    for i in range(length):
        bases = F.split(_covers(F.substring(seed, i + 1, 1)), "")
        words = _append(words, bases)
    return words


def _append(words: Column, bases: Column) -> Column:
    return F.flatten(F.transform(words, lambda w: F.transform(bases, lambda b: F.concat(w, b))))


def _places(seqs: DataFrame, keyed: DataFrame, probes: list, tp: int, max_primer: int, size: int) -> DataFrame:
    """seq_id, m (length of the sequence), no, k, q, from, near, core_bases: places q at which a 3' end of probe no starts and whose key
    may be one of keyed (no, k), with as many bases around as a primer covers, and those of the core (31 of them at
    most) as a number. probes: core, range of the block from the 3' end, orientation.

    The bit arrays (128 KB for each probe) are gathered by aggregation: they hold no more, however many the keys are.
    """
    slot = F.col("k").bitwiseXOR(F.shiftrightunsigned("k", SLOT)).bitwiseXOR(F.shiftrightunsigned("k", 2 * SLOT)).bitwiseXOR(F.shiftrightunsigned("k", 3 * SLOT)).bitwiseAND((1 << SLOT) - 1)
    bit = F.expr("shiftleft(1L, CAST(slot & 63 AS INT))")
    held = keyed.select("no", slot.alias("slot")).groupBy("no", F.shiftright("slot", 6).alias("i")).agg(F.bit_or(bit).alias("w")).toArrow()
    bits = np.zeros((len(probes), 1 << (SLOT - 6)), np.int64)
    bits[held.column("no").to_numpy(), held.column("i").to_numpy()] = held.column("w").to_numpy()
    shared = seqs.sparkSession.sparkContext.broadcast(bits)
    base = pieces(seqs, size, max_primer, max_primer)
    long_, int_ = T.LongType(), T.IntegerType()
    schema = T.StructType([base.schema["seq_id"], *(T.StructField(c, t) for c, t in (("m", int_), ("no", int_), ("k", long_), ("q", int_), ("from", int_), ("near", T.StringType()), ("core_bases", long_)))])

    def look_up(batches):
        tables = [np.unpackbits(row.view(np.uint8), bitorder="little").view(bool) for row in shared.value]
        for batch in batches:
            data, starts = text_bytes(batch.column("bases"))
            m, at, low = (batch.column(c).to_numpy() for c in ("n", "at", "low"))
            for first, last in blocks(starts):
                here, ends = data[starts[first] : starts[last]], starts[first : last + 1] - starts[first]
                code = CODE[here]
                words = {n: words_at(code, n) for n in {tp, *(b - a for _, a, b, _ in probes)}}
                for no, (core, a, b, o) in enumerate(probes):
                    n = max(0, len(here) - b + 1)
                    block, three = (0, b - tp) if o == "+" else (a, 0)
                    k = (words[b - a][block : block + n] << 2 * tp) | words[tp][three : three + n]
                    slots = k if 2 * (b - a + tp) <= SLOT else (k ^ (k >> SLOT) ^ (k >> 2 * SLOT) ^ (k >> 3 * SLOT)) & ((1 << SLOT) - 1)
                    x = np.flatnonzero(tables[no].take(slots))
                    row = np.searchsorted(ends, x, "right") - 1
                    q = low[first:last][row] + x + three - ends[row]
                    own = (x + b <= ends[row + 1]) & (q >= at[first:last][row]) & (q < at[first:last][row] + size)
                    x, row, q = x[own], row[own], q[own]
                    start = np.maximum(ends[row], x + b - max_primer) if o == "+" else x
                    end = x + b if o == "+" else np.minimum(ends[row + 1], x + max_primer)
                    if len(x):
                        span = min(core, WORD)
                        place = np.clip((x + b - span if o == "+" else x)[:, None] + np.arange(span), 0, len(code) - 1)  # a core beyond the end is no site
                        around = code[place].astype(np.int64) @ (1 << 2 * np.arange(span - 1, -1, -1, dtype=np.int64))
                        columns = [batch.column("seq_id").take(pa.array(row + first)), m[first:last][row], np.full(len(x), no, np.int32), k[x], q.astype(np.int32), (low[first:last][row] + start - ends[row]).astype(np.int32), texts(here, start, end), around]
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=schema.names)

    return base.mapInArrow(look_up, schema)


def primer_sites(primers: DataFrame, seqs: DataFrame, max_mm: int = 2, tp: int = 5, min_anneal: int = 18, max_primer: int = 60, size: int = 4000) -> DataFrame:
    """Binding sites: pair_id, primer (F/R), seq_id, orientation, at, end, mm, anneal_len, tail5.

    The last tp bases of a primer must match, and of the rest of its core at most max_mm may differ: of max_mm + 1 blocks
    of that rest one stands unchanged (pigeonhole). The 3' end with each block is a join key, spelled out where it is
    degenerate. Places are looked up in bit arrays of all keys first; only those whose bit is set go on, with the bases
    that a primer may cover there, to meet primers of the same key. On the reverse strand the reverse complement of the
    primer is sought, its 3' end first. Verified over the core, then extended 5' within the mismatch budget; of each primer, template and
    strand only the longest annealing length is kept. Primers are up to max_primer bases long.
    """
    each = primers.select("pair_id", F.explode(F.array(F.struct(F.lit("F").alias("primer"), F.col("fwd").alias("p")), F.struct(F.lit("R").alias("primer"), F.col("rev").alias("p")))).alias("x")).select("pair_id", "x.*")
    oriented = each.select("pair_id", "primer", F.explode(F.array(F.struct(F.lit("+").alias("orientation"), F.col("p").alias("w")), F.struct(F.lit("-").alias("orientation"), reverse_complement(F.col("p")).alias("w")))).alias("x")).select("pair_id", "primer", "x.*")
    plus = F.col("orientation") == "+"
    n = F.length("w")
    oriented = oriented.where(n >= tp).withColumn("n", n).withColumn("core", F.greatest(F.lit(tp), F.least(F.lit(min_anneal), n)))
    cores = [r[0] for r in oriented.select("core").distinct().orderBy("core").collect()]  # lengths from tp to min_anneal
    probes = []  # core, number of the block, its range from the 3' end, orientation
    for core in cores:
        cuts = [tp + (core - tp) * i // (max_mm + 1) for i in range(max_mm + 2)]
        probes += [(core, i, cuts[i], cuts[i + 1], o) for i in range(max_mm + 1) for o in "+-"]

    keyed = None
    for no, (core, i, a, b, o) in enumerate(probes):
        stop = min(b, a + WORD - tp)  # a key is one number
        three = F.col("n") - tp if o == "+" else F.lit(0)
        block = cut("w", three + tp - stop, F.lit(stop - a)) if o == "+" else cut("w", three + a, F.lit(stop - a))
        mine = oriented.where((F.col("core") == core) & (F.col("orientation") == o))
        words = F.explode(concrete(F.concat(block, cut("w", three, F.lit(tp))), stop - a + tp))
        span = F.least("core", F.lit(WORD))
        known = cut("w", F.col("n") - span if o == "+" else F.lit(0), span)
        mine = mine.withColumn("code", F.when(F.translate(known, "ACGT", "") == "", F.conv(F.translate(known, "ACGT", "0123"), 4, 10).cast("long")))
        spelled = mine.select("code", "pair_id", "primer", "orientation", "w", "n", "core", F.lit(i).alias("block"), F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(no).alias("no"), words.alias("k"))
        spelled = spelled.withColumn("k", F.conv(F.translate("k", "ACGT", "0123"), 4, 10).cast("long"))
        keyed = spelled if keyed is None else keyed.unionByName(spelled)
    if keyed is None:
        return primers.sparkSession.createDataFrame([], "pair_id long, primer string, seq_id long, orientation string, at long, end long, mm int, anneal_len int, tail5 int")

    keyed = stored(keyed, "primer-keys")  # read twice below
    found = _places(seqs, keyed, [(core, a, min(b, a + WORD - tp), o) for core, _, a, b, o in probes], tp, max_primer, size).withColumnsRenamed({"no": "p_no", "k": "p_k"})
    # two bits a base: where the primer has no degenerate code, bases that differ in its core are counted right here
    odd = F.col("core_bases").bitwiseXOR(F.col("code"))
    apart = F.bit_count(odd.bitwiseOR(F.shiftrightunsigned(odd, 1)).bitwiseAND(0x5555555555555555))
    found = found.join(keyed, (F.col("no") == F.col("p_no")) & (F.col("k") == F.col("p_k")) & F.coalesce(apart <= max_mm, F.lit(True))).drop("no", "k", "p_no", "p_k", "code", "core_bases")
    left = F.when(plus, F.col("q") + tp - F.col("n")).otherwise(F.col("q"))
    # as much of the primer as lies on the template; the core must
    low, high = F.greatest(F.lit(0), left), F.least(F.col("m"), left + F.col("n"))
    site = found.select("*", left.alias("left"), low.alias("low"), high.alias("high")).where(F.col("high") - F.col("low") >= F.col("core"))
    word = F.substring("w", F.col("low") - F.col("left") + 1, F.col("high") - F.col("low"))
    bases = cut("near", F.col("low") - F.col("from"), F.col("high") - F.col("low"))
    turned = lambda c: F.when(plus, F.reverse(c)).otherwise(c)  # 3' end first
    checked = site.select("pair_id", "primer", "seq_id", "orientation", "left", "n", "core", "block", "a", "b", (F.col("high") - F.col("low")).alias("fit"), mismatches(turned(word), turned(bases)).alias("bad"))
    in_core = F.size(F.filter("bad", lambda b: b <= F.col("core")))
    differs = lambda low, high: F.exists("bad", lambda x: (x > low) & (x <= high))
    # its own key, and none of an earlier block: a place is kept once
    first = ~differs(F.lit(0), F.lit(tp)) & ~differs(F.col("a"), F.col("b"))
    for i in range(max_mm):
        start, stop = (tp + F.floor((F.col("core") - tp) * j / (max_mm + 1)) for j in (i, i + 1))
        first = first & ((F.col("block") <= i) | differs(start, stop))
    good = checked.where((in_core <= max_mm) & first)
    reach = F.when(F.size("bad") > max_mm, F.get("bad", F.lit(max_mm)) - 1).otherwise(F.col("fit"))
    reached = good.withColumn("anneal_len", F.least("fit", reach)).withColumn("mm", F.size(F.filter("bad", lambda b: b <= F.col("anneal_len"))))
    best = F.max("anneal_len").over(Window.partitionBy("pair_id", "primer", "seq_id", "orientation"))
    kept = reached.withColumn("best", best).where(F.col("anneal_len") == F.col("best"))
    at = F.when(plus, F.col("left") + F.col("n") - F.col("anneal_len")).otherwise(F.col("left"))
    return kept.select("pair_id", "primer", "seq_id", "orientation", at.cast("long").alias("at"), (at + F.col("anneal_len")).cast("long").alias("end"), "mm", "anneal_len", (F.col("n") - F.col("anneal_len")).alias("tail5"))


def amplicons(sites: DataFrame, prod_min: int = 70, prod_max: int = 1000) -> DataFrame:
    """Forward sites paired with reverse sites to their right, within the window of product lengths.

    Starts are dealt to cells as wide as the longest product, so a pair is met in its own cell or the next.
    """
    left = sites.where("orientation = '+'").select("pair_id", "seq_id", F.col("at").alias("start"), F.col("primer").alias("fwd_primer"), F.col("mm").alias("fwd_mm"), F.col("tail5").alias("fwd_tail5"), F.floor(F.col("at") / prod_max).alias("cell"))
    right = sites.where("orientation = '-'").select("pair_id", "seq_id", "end", F.col("primer").alias("rev_primer"), F.col("mm").alias("rev_mm"), F.col("tail5").alias("rev_tail5"), F.floor(F.col("end") / prod_max).alias("cell"))
    near = left.withColumn("cell", F.explode(F.array("cell", F.col("cell") + 1))).join(right, ["pair_id", "seq_id", "cell"])
    length, tails = F.col("end") - F.col("start"), F.col("fwd_tail5") + F.col("rev_tail5")
    out = near.where((length > 0) & (length + tails).between(prod_min, prod_max))
    return out.select("pair_id", F.col("seq_id").alias("source"), "start", "end", length.alias("length"), (length + tails).alias("product_length"), "fwd_primer", "rev_primer", "fwd_mm", "rev_mm", (F.col("fwd_primer") == F.col("rev_primer")).alias("single_primer"))


def cap_flags(amps: DataFrame, cap: int) -> DataFrame:
    """Pairs and templates with more products than cap: reported, never cut silently."""
    return amps.groupBy("pair_id", "source").agg(F.count("*").alias("n"), (F.count("*") > cap).alias("truncated"))


def anneal_extension(sites: DataFrame) -> DataFrame:
    """How far each primer anneals on each template and strand: the longest length that any of its places reaches, the 5'
    tail that is left over, the places that reach it, and the fewest mismatches among them."""
    return sites.groupBy("pair_id", "primer", "seq_id", "orientation").agg(F.max("anneal_len").alias("anneal_len"), F.min("tail5").alias("tail5"), F.count("*").alias("n_sites"), F.min("mm").alias("min_mm"))


def site_caps(sites: DataFrame, cap: int = 4000) -> DataFrame:
    """Primers with more places on a strand of a template than cap: reported, never cut silently."""
    return sites.groupBy("pair_id", "primer", "seq_id", "orientation").agg(F.count("*").alias("n"), (F.count("*") > cap).alias("truncated"))


def on_target_by_span(amps: DataFrame, spans: DataFrame, slack: int = 5) -> DataFrame:
    """amps with on_target (two-primer products inside the target span of their pair and template, give or take slack) and
    ``place`` among the products of a pair and template: on target first, then fewest mismatches, two primers before one,
    start. A pair without a span has nothing on target."""
    span = spans.select("pair_id", "source", F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    inside = (F.col("start") >= F.col("t_start") - slack) & (F.col("end") <= F.col("t_end") + slack) & ~F.col("single_primer")
    out = amps.join(span, ["pair_id", "source"], "left").withColumn("on_target", F.coalesce(inside, F.lit(False))).drop("t_start", "t_end")
    order = Window.partitionBy("pair_id", "source").orderBy(~F.col("on_target"), F.col("fwd_mm") + F.col("rev_mm"), "single_primer", "start", "end", "fwd_primer", "rev_primer")
    return out.withColumn("place", F.row_number().over(order))


def sequence_counts(amps: DataFrame) -> DataFrame:
    """Products of each pair by sequence, the busiest first: place, and those of two primers, of one, and on target."""
    single = F.col("single_primer")
    counts = amps.groupBy("pair_id", "source").agg(F.count("*").alias("n"), F.count_if(~single).alias("n_pair"), F.count_if(single).alias("n_single"), F.count_if(F.col("on_target") & ~single).alias("n_on"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc("n"), "source")))


def genome_on_target(amps: DataFrame, loci: DataFrame) -> DataFrame:
    """amps with on_target: of a pair's two-primer products that overlap its locus, the one that overlaps most
    (then of smallest start)."""
    a = amps.withColumn("__key", F.struct("source", "start", "end", "fwd_primer", "rev_primer"))
    overlap = F.least("end", "l_end") - F.greatest("start", "l_start")
    l = loci.select("pair_id", F.col("source").alias("l_source"), F.col("start").alias("l_start"), F.col("end").alias("l_end"))  # noqa: E741
    near = a.where(~F.col("single_primer")).join(l, "pair_id").where((F.col("source") == F.col("l_source")) & (overlap > 0))
    best = near.groupBy("pair_id").agg(F.max_by("__key", F.struct(overlap, -F.col("start"), -F.col("end"))).alias("best"))
    return a.join(best, "pair_id", "left").withColumn("on_target", F.coalesce((F.col("__key") == F.col("best")) & ~F.col("single_primer"), F.lit(False))).drop("__key", "best")


def specificity_summary(amps: DataFrame, pairs: DataFrame, has_locus: bool) -> DataFrame:
    """Per pair: products on and off target, artefacts of one primer, sequences, usual size and a tier."""
    single = F.col("single_primer")
    sizes = amps.where(~single).groupBy("pair_id", "length").agg(F.count("*").alias("m"))
    usual = sizes.groupBy("pair_id").agg(F.max_by(F.struct("length", "m"), F.struct(F.col("m"), -F.col("length"))).alias("u"), F.min("length").alias("size_min"), F.max("length").alias("size_max"))
    counts = amps.groupBy("pair_id").agg(
        F.count("*").alias("n_total"), F.count_if(~single).alias("n_pair"), F.count_if(~single & F.col("on_target")).alias("n_on"), F.count_if(single).alias("n_single"), F.countDistinct(F.when(~single, F.col("source"))).alias("n_sources")
    )
    zero = F.lit(0).cast("long")
    out = pairs.select("pair_id").join(counts, "pair_id", "left").join(usual, "pair_id", "left").select(
        "pair_id", *(F.coalesce(c, zero).alias(c) for c in ("n_total", "n_pair", "n_on", "n_single", "n_sources")), F.col("u.length").alias("size_mode"), F.col("u.m").alias("size_mode_n"), "size_min", "size_max"
    )
    n, on, off = F.col("n_pair"), F.col("n_on"), F.col("n_pair") - F.col("n_on")
    if has_locus:
        tier = F.when(n == 0, "none").when(on == 0, "off-target-only").when(off == 0, "specific").when(off <= 5, "low-off-target").otherwise("family-generic")
    else:
        tier = F.when(n == 0, "none").when(n == 1, "locus-specific").when(n <= 5, "low-copy").otherwise("family-generic")
    return out.withColumn("n_off", off).withColumn("tier", tier)


def query_expansion(pairs: DataFrame) -> DataFrame:
    """Each pair as itself and as both single-primer queries."""
    rows = (("pair", "fwd", "rev"), ("fwdonly", "fwd", "fwd"), ("revonly", "rev", "rev"))
    return pairs.select("pair_id", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(a).alias("left"), F.col(b).alias("right")) for n, a, b in rows))).alias("q")).select("pair_id", "q.*")


def gel_bands(amps: DataFrame, has_locus: bool) -> DataFrame:
    """Per lane (pair) and product size: disjoint counts, the call, fewest mismatches and the band's intensity."""
    single, on = F.col("single_primer"), F.col("on_target") & ~F.col("single_primer")
    mm = F.min(F.col("fwd_mm") + F.col("rev_mm"))
    out = amps.groupBy(F.col("pair_id").alias("lane"), F.col("product_length").alias("size")).agg(F.count_if(on).alias("n_on"), F.count_if(~on & ~single).alias("n_off"), F.count_if(single).alias("n_single"), mm.alias("min_mm"))
    if has_locus:
        call = F.when(F.col("n_off") > 0, "off-target").when(F.col("n_single") > 0, "single-primer").otherwise("on-target")
    else:
        call = F.when(F.col("n_off") + F.col("n_on") > 0, "priming site").otherwise("single-primer")
    return out.select("*", call.alias("call"), F.greatest(F.lit(0.4), 1 - 0.22 * F.col("min_mm")).alias("intensity"))


def oligo_descriptors(oligos: DataFrame) -> DataFrame:
    """oligos (oligo_id, seq): length, GC percent, GC among the last five bases, longest run of one base."""
    s = F.upper("seq")
    runs = F.transform(F.regexp_extract_all(s, F.lit(r"A+|C+|G+|T+|[^ACGT]"), F.lit(0)), lambda r: F.length(r))
    return oligos.select("oligo_id", F.length(s).alias("length"), (100 * count_of(s, "GC") / F.length(s)).alias("gc_pct"), count_of(F.substring(s, F.greatest(F.lit(1), F.length(s) - 4), F.lit(5)), "GC").alias("gc_clamp"), F.coalesce(F.array_max(runs), F.lit(0)).alias("poly_x"))


#: Metric, free energies from which it is a warning and a caution (kcal/mol); band of agreement.
LIMITS = {"hairpin": (-9.0, -2.0), "dimer": (-9.0, -5.0), "end": (-9.0, -6.0)}
AGREE = 2.0


def oligo_qc_triage(first: DataFrame, second: DataFrame) -> DataFrame:
    """Free energies (pair_id, metric, dg) of two engines: the worse tier, how they agree, and the pair's worst.

    Tiers are 0 ok, 1 caution, 2 warning."""
    joined = first.select("pair_id", "metric", F.col("dg").alias("dg_a")).join(second.select("pair_id", "metric", F.col("dg").alias("dg_b")), ["pair_id", "metric"], "full")

    def tier(dg: Column) -> Column:
        out = F.lit(0)
        for metric, (warn, caution) in LIMITS.items():
            out = F.when(F.col("metric") == metric, F.when(dg <= warn, 2).when(dg <= caution, 1).otherwise(0)).otherwise(out)
        return out

    agree = F.when(F.col("dg_a").isNull() & F.col("dg_b").isNull(), "none").when(F.col("dg_a").isNull() | F.col("dg_b").isNull(), "single").when(F.abs(F.col("dg_a") - F.col("dg_b")) <= AGREE, "agree").otherwise("disagree")
    out = joined.select("pair_id", "metric", F.greatest(tier(F.col("dg_a")), tier(F.col("dg_b"))).alias("flag"), agree.alias("agree"))
    return out.join(out.groupBy("pair_id").agg(F.max("flag").alias("worst")), "pair_id")


def assay_primer_normalise(primers: DataFrame) -> DataFrame:
    """primers (primer_id, text): bracketed alternatives become one nucleotide code; what maps to none is an error."""
    codes = {"".join(sorted(bases)): code for code, bases in COVERS.items() if code != "U"}
    table = F.create_map(*(F.lit(x) for item in codes.items() for x in item))
    parts = F.regexp_extract_all(F.upper(F.regexp_replace("text", r"\s", "")), F.lit(r"\([^)]*\)|[^()]"), F.lit(0))
    bases = lambda p: F.array_join(F.array_sort(F.array_distinct(F.split(F.regexp_replace(p, "[(),/]", ""), ""))), "")
    mapped = F.transform(parts, lambda p: F.when(p.startswith("("), F.element_at(table, bases(p))).when(F.contains(F.lit("ACGTURYSWKMBDHVN"), p), p))
    out = primers.select("primer_id", "text", mapped.alias("m"))
    bad = (F.size("m") == 0) | F.exists("m", lambda c: c.isNull())
    return out.select("primer_id", "text", F.when(~bad, F.array_join("m", "")).alias("iupac"), F.when(bad, "no code for a part").alias("error"))
