"""Interval algebra on 0-based half-open intervals, repeat landscapes and gene models.

Hot contigs: islands are merged per coordinate bin first, then across bins, so that a contig that holds a third of
all rows is many tasks and only its merged pieces meet in one. Landscapes need bases only: intervals are cut at the borders
of bins, and bins are dealt over as many tasks as the input asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import shares, stored
from .profile import cut, pieces

# Heads of a class / family label by the kind they belong to; every other head is "other". Labels that a view
# of hits lists apart, compared whole.
TE_HEADS = ("LTR", "LINE", "SINE", "DNA", "RC", "Retroposon")
TANDEM_HEADS = ("Simple_repeat", "Low_complexity", "Satellite")
NON_TE = ("Low_complexity", "Simple_repeat", "Satellite")
UNCLASSED = ("Unknown", "Unspecified")


def _merged(df: DataFrame, keys: list[str], by: list[str], gap: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    broken = df.withColumn("__new", F.when(F.col("start") <= reach + gap, 0).otherwise(1)).withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return broken.groupBy(*by, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).select(*keys, "start", "end", "n")


def interval_islands(df: DataFrame, keys: list[str], gap: int = 0, bin_width: int = 1 << 20) -> DataFrame:
    """Merged intervals: keys, start, end, n (intervals merged). Intervals up to gap apart merge; null ends drop out."""
    rows = df.where(F.col("start").isNotNull() & F.col("end").isNotNull()).select(*keys, F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end"), F.lit(1).alias("n"))
    local = _merged(rows.withColumn("__bin", F.floor(F.col("start") / bin_width)), keys, [*keys, "__bin"], gap)
    return _merged(local, keys, keys, gap)


def range_join(left: DataFrame, right: DataFrame, keys: list[str], width: int, how: str = "inner") -> DataFrame:
    """Pairs of overlapping intervals of equal keys: left columns and right columns under r_ names.

    Both sides are dealt to coordinate bins of the given width; a pair counts in the bin where its overlap starts.
    """
    bins = lambda s, e: F.explode(F.sequence(F.floor(F.col(s) / width), F.floor((F.greatest(F.col(e), F.col(s) + 1) - 1) / width)))
    a = left.withColumn("__bin", bins("start", "end"))
    b = right.select(*(F.col(c).alias(c if c in keys else f"r_{c}") for c in right.columns)).withColumn("__bin", bins("r_start", "r_end"))
    hit = a.join(b, [*keys, "__bin"]).where((F.col("start") < F.col("r_end")) & (F.col("r_start") < F.col("end")) & (F.col("__bin") == F.floor(F.greatest("start", "r_start") / width)))
    return hit.drop("__bin")


def merge_fragments(hits: DataFrame) -> DataFrame:
    """Rows of one fragment_id, family, query and strand become one hit; rows without an id pass. The coverage of the
    family's model (percent, null where unknown) is summed, to 100 at most, where fragments are joined."""
    keys = ["query", "fragment_id", "family", "strand"]
    best = F.max_by(F.struct("score", "divergence", "class_family"), F.struct("score", "divergence", "class_family"))
    covered = F.when(F.count("*") > 1, F.round(F.least(F.lit(100.0), F.sum("coverage").cast("double")), 1)).otherwise(F.max("coverage").cast("double"))
    joined = (
        hits.where(F.col("fragment_id").isNotNull())
        .groupBy(*keys)
        .agg(F.min("q_start").alias("q_start"), F.max("q_end").alias("q_end"), best.alias("b"), covered.alias("coverage"), F.count("*").alias("n_fragments"))
        .select(*keys, "q_start", "q_end", "b.*", "coverage", "n_fragments")
    )
    alone = hits.where(F.col("fragment_id").isNull()).select(*keys, "q_start", "q_end", "score", "divergence", "class_family", F.col("coverage").cast("double").alias("coverage"), F.lit(1).cast("long").alias("n_fragments"))
    return joined.unionByName(alone)


def genome_length(hits: DataFrame) -> DataFrame:
    """One row: summed length of the contigs, each as long as its last hit reaches."""
    return hits.groupBy("query").agg(F.max("q_end").alias("length")).agg(F.sum("length").alias("genome_bp"))


def contig_sums(hits: DataFrame, contig: tuple[str, ...] = ("query",), union: bool = False, bin_width: int = 1 << 20) -> DataFrame:
    """Per contig and class_family: n (rows), weighted and width (sums of divergence by length and of lengths), length (the
    last hit's end), bp (merged bases; null where no hit has both ends) and, if asked for, union_bp: its share of the bases
    that all classes together cover.

    Intervals are cut at the borders of bins. In the order of their starts each adds what lies beyond all before it, so
    that no island is held, and the bins are dealt over tasks by the size of the input.
    """
    low, high, size = F.least("q_start", "q_end"), F.greatest("q_start", "q_end"), F.abs(F.col("q_end") - F.col("q_start"))
    whole = F.col("q_start").isNotNull() & F.col("q_end").isNotNull()
    first, last = F.floor(low / bin_width), F.floor((F.greatest(high, low + 1) - 1) / bin_width)
    rows = hits.select(*contig, "class_family", F.when(whole, low).alias("s"), F.when(whole, high).alias("e"), "q_end", size.alias("size"), (F.col("divergence") * size).alias("w"), F.explode_outer(F.when(whole, F.sequence(first, last))).alias("bin"))
    # what counts once for a hit goes with its first part
    head = F.col("bin").isNull() | (F.col("s") >= F.col("bin") * bin_width)
    once = lambda c, name: F.when(head, c).alias(name)
    parts = rows.select(*contig, "class_family", "bin", F.greatest("s", F.col("bin") * bin_width).alias("s"), F.least("e", (F.col("bin") + 1) * bin_width).alias("e"), "q_end", once(F.lit(1), "n"), once(F.col("w"), "w"), once(F.col("size"), "size"))
    dealt = parts.repartition(shares(hits), *contig, "bin")

    def added(*keys: str) -> Column:
        before = Window.partitionBy(*contig, "bin", *keys).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        return F.when(F.col("bin").isNotNull(), F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.max("e").over(before))))

    told = dealt.withColumn("bp", added("class_family"))
    sums = [F.sum("n").alias("n"), F.sum("w").alias("weighted"), F.sum("size").alias("width"), F.max("q_end").alias("length"), F.sum("bp").alias("bp")]
    if union:
        told, sums = told.withColumn("union_bp", added()), [*sums, F.sum("union_bp").alias("union_bp")]
    return told.groupBy(*contig, "class_family").agg(*sums)


def _genome(sums: DataFrame) -> DataFrame:
    return sums.groupBy("query").agg(F.max("length").alias("length")).agg(F.sum("length").alias("genome_bp"))


def _landscape(sums: DataFrame) -> DataFrame:
    rows = sums.where(F.col("class_family").isNotNull()).groupBy("class_family").agg(F.sum("n").alias("n"), (F.sum("weighted") / F.sum("width")).alias("divergence"), F.sum("bp").alias("bp")).where(F.col("bp").isNotNull())
    return rows.crossJoin(F.broadcast(_genome(sums))).select("class_family", "n", "bp", "divergence", (100 * F.col("bp") / F.col("genome_bp")).alias("percent"))


def _totals(sums: DataFrame) -> DataFrame:
    return sums.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("total_hits"), F.sum("bp").alias("sum_family_bp"), F.sum("union_bp").alias("union_bp"))


def repeat_landscape(hits: DataFrame) -> DataFrame:
    """Per class_family: rows, merged bases, length-weighted divergence and percent of the genome."""
    return _landscape(stored(contig_sums(hits), "contig-sums"))


def landscape_totals(hits: DataFrame) -> DataFrame:
    """total_hits, the sum of the families' merged bases, and the bases of their union."""
    return _totals(contig_sums(hits, union=True))


def kind_of(label: Column) -> Column:
    """te, tandem or other, by the exact head of a class / family label: what is not known as an element is none."""
    head = F.substring_index(F.trim(F.coalesce(label, F.lit(""))), "/", 1)
    return F.when(head.isin(*TANDEM_HEADS), "tandem").when(head.isin(*TE_HEADS), "te").otherwise("other")


def repeat_kind_totals(landscape: DataFrame) -> DataFrame:
    return landscape.groupBy(kind_of(F.col("class_family")).alias("kind")).agg(F.sum("bp").alias("bp"), F.count("*").alias("families"), F.sum("n").alias("n"))


def landscape_summary(hits: DataFrame) -> DataFrame:
    """One row: hits, genome, merged bases of each kind, percent masked and percent of elements, and a warning where no
    family of elements was found: a limit of what was searched, no finding about the genome."""
    told = stored(contig_sums(hits, union=True), "contig-sums")
    land = _landscape(told).withColumn("kind", kind_of(F.col("class_family")))
    bp = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("bp"))), F.lit(0)).alias(f"{kind}_bp")
    sums = land.agg(bp("te"), bp("tandem"), bp("other"), F.count_if(F.col("kind") == "te").alias("te_families"))
    percent = lambda c: F.when(F.col("genome_bp") > 0, F.round(100 * F.col(c) / F.col("genome_bp"), 3))
    warning = F.when(F.col("te_families") == 0, "No family of transposable elements was found: a limit of what was searched, not a finding about the genome")
    one = _totals(told).crossJoin(_genome(told)).crossJoin(sums)  # one row each
    return one.select("total_hits", "genome_bp", "union_bp", percent("union_bp").alias("masked_percent"), "te_bp", percent("te_bp").alias("te_percent"), "tandem_bp", "other_bp", "te_families", warning.alias("warning"))


def landscape_composition(landscape: DataFrame, genome: DataFrame) -> DataFrame:
    """Bases by class of transposable element, tandem, other, and what no repeat covers."""
    label = F.when(kind_of(F.col("class_family")) == "te", F.substring_index("class_family", "/", 1)).otherwise(kind_of(F.col("class_family")))
    parts = landscape.groupBy(label.alias("part")).agg(F.sum("bp").alias("bp"))
    rest = parts.agg(F.sum("bp").alias("s")).crossJoin(genome).select(F.lit("unannotated").alias("part"), F.greatest(F.lit(0).cast("long"), F.col("genome_bp") - F.coalesce("s", F.lit(0))).alias("bp"))
    return parts.unionByName(rest).crossJoin(F.broadcast(genome)).select("part", "bp", (F.col("bp") / F.col("genome_bp")).alias("share"))


def split_hits_by_kind(hits: DataFrame) -> DataFrame:
    """bucket of each hit: non_te and unclassed are a few whole labels, all else is shown among the elements."""
    label = F.coalesce("class_family", F.lit(""))
    return hits.withColumn("bucket", F.when(label.isin(*UNCLASSED), "unclassed").when(label.isin(*NON_TE), "non_te").otherwise("te"))


def introns(exons: DataFrame) -> DataFrame:
    """Gaps between neighbouring exons of a record: seq_id, start, end."""
    order = Window.partitionBy("seq_id").orderBy("start", "end")
    return exons.select("seq_id", F.col("end").alias("start"), F.lead("start").over(order).alias("end")).where(F.col("end") > F.col("start"))


def build_gene_model(features: DataFrame) -> DataFrame:
    """Exons from exon features, else mRNA, else CDS (then derived), and introns from the gaps between them."""
    present = features.groupBy("seq_id").agg(F.min(F.when(F.col("kind") == "exon", 1).when(F.col("kind") == "mRNA", 2).when(F.col("kind") == "CDS", 3)).alias("from"))
    rank = F.when(F.col("kind") == "exon", 1).when(F.col("kind") == "mRNA", 2).when(F.col("kind") == "CDS", 3)
    exons = features.withColumn("rank", rank).join(present, "seq_id").where(F.col("rank") == F.col("from")).select("seq_id", "start", "end", (F.col("from") > 1).alias("derived")).dropDuplicates(["seq_id", "start", "end"])
    gaps = introns(exons).select("seq_id", "start", "end", F.lit(True).alias("derived"), F.lit("intron").alias("kind"))
    return exons.withColumn("kind", F.lit("exon")).unionByName(gaps)


def complete_gene_model(model: DataFrame, cds: DataFrame) -> DataFrame:
    """A CDS outside every exon becomes an exon bounded by the nearest introns; derived introns are made anew.

    The nearest intron end at or before the CDS and intron start at or after it are as-of look-ups; without one
    the CDS's own end is taken.
    """
    exons = model.where("kind = 'exon'").select("seq_id", "start", "end", "derived")
    c = cds.select("seq_id", F.col("start").alias("c_start"), F.col("end").alias("c_end")).distinct()
    # an exon that holds the CDS overlaps it: met in the cell where the overlap starts
    held = range_join(c.select("seq_id", F.col("c_start").alias("start"), F.col("c_end").alias("end")), exons.select("seq_id", "start", "end"), ["seq_id"], 4096)
    inside = held.where((F.col("r_start") <= F.col("start")) & (F.col("r_end") >= F.col("end"))).select("seq_id", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    outside = c.join(inside.distinct(), ["seq_id", "c_start", "c_end"], "left_anti")
    gaps = model.where("kind = 'intron'").select("seq_id", F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    blank = F.lit(None).cast("long")
    # one pass over ends and CDS in order gives the last end before, one over starts the next start after
    ends = gaps.select("seq_id", F.col("i_end").alias("at"), F.lit(0).alias("o"), F.col("i_end").alias("v"), blank.alias("c_start"), blank.alias("c_end"))
    ends = ends.unionByName(outside.select("seq_id", F.col("c_start").alias("at"), F.lit(1).alias("o"), blank.alias("v"), "c_start", "c_end"))
    up = Window.partitionBy("seq_id").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    left = ends.withColumn("left", F.last("v", ignorenulls=True).over(up)).where("o = 1").select("seq_id", "c_start", "c_end", "left")
    starts = gaps.select("seq_id", F.col("i_start").alias("at"), F.lit(1).alias("o"), F.col("i_start").alias("v"), blank.alias("c_start"), blank.alias("c_end"))
    starts = starts.unionByName(outside.select("seq_id", F.col("c_end").alias("at"), F.lit(0).alias("o"), blank.alias("v"), "c_start", "c_end"))
    down = Window.partitionBy("seq_id").orderBy("at", "o").rowsBetween(0, Window.unboundedFollowing)
    right = starts.withColumn("right", F.first("v", ignorenulls=True).over(down)).where("o = 0").select("seq_id", "c_start", "c_end", "right")
    near = left.join(right, ["seq_id", "c_start", "c_end"])
    added = near.select("seq_id", F.coalesce("left", "c_start").alias("start"), F.coalesce("right", "c_end").alias("end"), F.lit(True).alias("derived"))
    all_exons = exons.unionByName(added).dropDuplicates(["seq_id", "start", "end"])
    given = model.where("kind = 'intron' AND NOT derived").select("seq_id", "start", "end", "derived", "kind")
    made = introns(all_exons).select("seq_id", "start", "end", F.lit(True).alias("derived"), F.lit("intron").alias("kind")).join(given, ["seq_id", "start", "end"], "left_anti")
    return all_exons.withColumn("kind", F.lit("exon")).unionByName(given).unionByName(made)


def cross_check_introns(a: DataFrame, b: DataFrame, tol: int = 2) -> DataFrame:
    """Introns of two models matched one to one, in order, where both ends lie within tol; per record the counts.

    Candidates come from a band join on the start: an intron has (2 tol + 1)**2 of them at most. Taking pairs in order of
    their places, each unless one of its introns is taken, is the same as rounds in which every pair that comes first for
    both of its introns is taken and the other pairs of these introns go; a round sees the pairs of one intron at a time,
    so that records may be of any size.
    """
    left = a.select("seq_id", F.col("start").alias("a_start"), F.col("end").alias("a_end")).distinct()
    right = b.select("seq_id", F.col("start").alias("b_start"), F.col("end").alias("b_end")).distinct()
    cell = lambda c: F.floor(F.col(c) / (tol + 1))
    near = left.withColumn("cell", F.explode(F.array(cell("a_start") - 1, cell("a_start"), cell("a_start") + 1))).join(right.withColumn("cell", cell("b_start")), ["seq_id", "cell"])
    near = near.where((F.abs(F.col("a_start") - F.col("b_start")) <= tol) & (F.abs(F.col("a_end") - F.col("b_end")) <= tol))
    of_a, of_b = Window.partitionBy("seq_id", "a_start", "a_end"), Window.partitionBy("seq_id", "b_start", "b_end")
    order = ("a_start", "a_end", "b_start", "b_end")
    open_, matched = near.select("seq_id", *order), None
    while True:
        ranked = open_.withColumn("i", F.row_number().over(of_a.orderBy(*order))).withColumn("j", F.row_number().over(of_b.orderBy(*order)))
        ranked = ranked.withColumn("taken", (F.col("i") == 1) & (F.col("j") == 1))
        ranked = ranked.withColumn("gone", F.max("taken").over(of_b)).withColumn("gone", F.max("gone").over(of_b) | F.max("taken").over(of_a))
        ranked = stored(ranked.select("seq_id", *order, "taken", "gone"), "intron-pairs")
        taken = ranked.where("taken").groupBy("seq_id").agg(F.count("*").alias("n"))
        matched = taken if matched is None else matched.unionByName(taken)
        open_ = ranked.where("NOT gone").select("seq_id", *order)
        if open_.isEmpty():
            break
    matched = matched.groupBy("seq_id").agg(F.sum("n").alias("matched"))
    totals = left.groupBy("seq_id").agg(F.count("*").alias("a_total")).join(right.groupBy("seq_id").agg(F.count("*").alias("b_total")), "seq_id", "full")
    zero = F.lit(0).cast("long")
    out = totals.join(matched, "seq_id", "left").select("seq_id", F.coalesce("matched", zero).alias("matched"), F.coalesce("a_total", zero).alias("a_total"), F.coalesce("b_total", zero).alias("b_total"))
    return out.select("*", (F.col("a_total") - F.col("matched")).alias("a_only"), (F.col("b_total") - F.col("matched")).alias("b_only"))


def flanks_and_gaps(features: DataFrame, lengths: DataFrame) -> DataFrame:
    """What no interval covers: the 5' flank, the 3' flank and holes between."""
    islands = interval_islands(features, ["seq_id"]).join(lengths, "seq_id")
    order = Window.partitionBy("seq_id").orderBy("start")
    before = F.lag("end").over(order)
    rows = islands.select("seq_id", "length", "start", "end", before.alias("left"), F.lead("start").over(order).alias("right"))
    spans = rows.select("seq_id", F.explode(F.array(
        F.struct(F.coalesce("left", F.lit(0).cast("long")).alias("start"), F.col("start").alias("end"), F.when(F.col("left").isNull(), "flank5").otherwise("hole").alias("kind")),
        F.struct(F.col("end").alias("start"), F.when(F.col("right").isNull(), F.col("length")).alias("end"), F.lit("flank3").alias("kind")),
    )).alias("s"))
    return spans.select("seq_id", "s.*").where(F.col("end") > F.col("start"))


def splice_motifs(gaps: DataFrame, seqs: DataFrame, size: int = 4096) -> DataFrame:
    """Donor and acceptor dinucleotides of introns inside their sequence, read on the transcribed strand. An intron meets
    the two pieces of its sequence that hold its ends."""
    cell = lambda c: (F.floor(c / size) * size).cast("int")
    around = pieces(seqs, size, 0, 1)
    first = around.select("seq_id", F.col("at").alias("a5"), F.col("bases").alias("b5"))
    last = around.select("seq_id", "n", F.col("at").alias("a3"), F.col("bases").alias("b3"))
    dealt = gaps.where((F.col("end") - F.col("start") >= 4) & (F.col("start") >= 0)).withColumns({"a5": cell(F.col("start")), "a3": cell(F.col("end") - 2)})
    joined = dealt.join(first, ["seq_id", "a5"]).join(last, ["seq_id", "a3"]).where(F.col("end") <= F.col("n"))
    left, right = cut("b5", F.col("start") - F.col("a5"), F.lit(2)), cut("b3", F.col("end") - 2 - F.col("a3"), F.lit(2))
    turned = lambda c: F.reverse(F.translate(c, "ACGT", "TGCA"))
    donor = F.when(F.col("strand") == "-", turned(right)).otherwise(left)
    acceptor = F.when(F.col("strand") == "-", turned(left)).otherwise(right)
    out = joined.select("seq_id", "start", "end", "strand", donor.alias("donor"), acceptor.alias("acceptor"))
    return out.withColumn("canonical", F.concat_ws("-", "donor", "acceptor").isin("GT-AG", "GC-AG", "AT-AC"))


def extract_regions(regions: DataFrame, seqs: DataFrame, flank: int = 0, size: int = 4096) -> DataFrame:
    """The bases of regions with flanks, clipped to the sequence, read on the region's strand. A region meets the pieces
    that it lies on, each gives its part, and the parts are joined in order. Regions are told apart by all their columns."""
    lengths = seqs.select("seq_id", F.length("seq").cast("long").alias("n"))
    inside = regions.join(lengths, "seq_id").where((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("n")))
    low, high = F.greatest(F.lit(0).cast("long"), F.col("start") - flank), F.least(F.col("n"), F.col("end") + flank)
    clipped = (F.col("start") < flank) | (F.col("end") + flank > F.col("n"))
    keys = ["region_id", "seq_id", "low", "high", "strand", "clipped"]
    asked = inside.select("region_id", "seq_id", low.alias("low"), high.alias("high"), "strand", clipped.alias("clipped")).groupBy(*keys).agg(F.count("*").alias("times"))
    cells = F.explode(F.sequence(F.floor(F.col("low") / size), F.floor((F.col("high") - 1) / size)))
    dealt = asked.withColumn("cell", cells).withColumn("at", (F.col("cell") * size).cast("int"))
    here = dealt.join(pieces(seqs, size, 0, 0).select("seq_id", "at", "bases"), ["seq_id", "at"])
    first, last = F.greatest(F.col("low") - F.col("at"), F.lit(0)), F.least(F.col("high") - F.col("at"), F.lit(size))
    parts = here.select(*keys, "times", F.struct("at", cut("bases", first, last - first).alias("x")).alias("p")).groupBy(*keys, "times").agg(F.array_sort(F.collect_list("p")).alias("p"))
    bases = F.array_join(F.col("p.x"), "")
    bases = F.when(F.col("strand") == "-", F.reverse(F.translate(bases, "ACGT", "TGCA"))).otherwise(bases)
    out = parts.select("region_id", "seq_id", F.col("low").alias("start"), F.col("high").alias("end"), "strand", bases.alias("bases"), "clipped", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("t"))
    return out.drop("t")


def resolve_contig_names(regions: DataFrame, molecules: DataFrame) -> DataFrame:
    """regions (region_id, assembly, chrom, start, end) with accession, or the reason why there is none.

    Names match without case and without a leading chr; M and MT are one.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(F.upper(F.trim(c)), "^CHR", ""), "^MT$", "M")
    names = F.array_distinct(F.array_compact(F.transform(F.array("chr_name", "ucsc_name", "accession"), lambda c: F.when(F.trim(c) != "", plain(c)))))
    alias = molecules.select("assembly", "accession", "length", F.posexplode(names).alias("__rank", "__name"))
    # where molecules share an alias, the one that has it as its first kind of name, then the smallest accession
    first = F.min_by(F.struct("accession", "length"), F.struct("__rank", F.coalesce("accession", F.lit("")), "length"))
    alias = alias.groupBy("assembly", "__name").agg(first.alias("m")).select("assembly", "__name", "m.accession", "m.length")
    found = regions.withColumn("__name", plain(F.col("chrom"))).join(alias, ["assembly", "__name"], "left")
    reason = F.when(F.col("accession").isNull(), "unknown contig").when(F.col("end") > F.col("length"), "past the end")
    return found.select("region_id", "assembly", "chrom", "start", "end", "accession", reason.alias("reason"))


def nearest_library_coverage(families: DataFrame) -> DataFrame:
    """Per lineage: curated and total models, their ratio, and a warning where nothing is curated."""
    out = families.groupBy("lineage").agg(F.sum(F.col("curated").cast("long")).alias("curated"), F.count("*").alias("total"))
    return out.select("lineage", "curated", "total", (F.col("curated") / F.col("total")).alias("ratio"), (F.col("curated") == 0).alias("uncovered"))
