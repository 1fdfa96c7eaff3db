"""Mixing sources to target weights by weighted fair queueing.

Every source's documents stand in a shuffled queue (order of a hash of doc_id and text). A document's
virtual finish time is its source's words up to and with it, divided by the source's weight; each further
round over the source goes on from there. A fair queue serves documents in the order of finish times, every source
with words left at the rate of its weight, and stops when the budget is spent.

The cut is found in that queue. Documents (one item per round) are spread over ranges of virtual time; a running total
of the words served in each range shows the range in which the budget ends, and this range is divided again until few
items are left in it. These are sorted by virtual time, and a running total over their starts and ends gives the moment
of the cut. The document that each source is serving then is truncated there, so that a source's words meet its share
within one word. What the cut leaves of a source's words, bounded by ``max_repeats`` rounds, is its target.

Nothing puts a source, or all sources, in one task: a queue is cut into hash-ordered buckets of about ``bucket_rows``
documents, sums per bucket give the offset of each bucket and a window inside gives the rest; sources are ranked by
range. Windows without partition see one row per range. Only ids, sizes and hashes are shuffled, never texts; two
numbers per range of time reach the driver's plan, one number comes back.

Defined results: a null text has size 0, takes 0 words; null sources are one source, ranked last; sources
rank by code point; repeated rows are queued each on their own; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, stored

RANGE, TIME_RANGES = 1 << 24, 1024


def weighted_sources(sizes: DataFrame, weights=(3, 1, 2)) -> DataFrame:
    """source, n_docs, source_size and weight: the weights in turn over the sources in their order."""
    per_source = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    ranged = stored(per_source.repartitionByRange(order).withColumn("range", F.spark_partition_id()), "mix-sources")
    # one row per range of sources
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1 + F.col("offset")
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    return ranged.join(offsets, "range").select("source", "n_docs", "source_size", F.get(cycle, (rank % len(weights)).cast("int")).alias("weight"))


def queue_cut(items: DataFrame, budget: float, bucket_rows: int) -> float:
    """Virtual time at which a fair queue has served budget words. items: weight, and begin and finish in virtual time."""
    low, high, served = 0.0, items.agg(F.max("finish")).first()[0], 0.0
    if high is None:
        return 0.0
    while True:
        width = (high - low) / TIME_RANGES
        here = items.where((F.col("finish") > low) & (F.col("begin") < high))
        number = lambda t: F.least(F.lit(TIME_RANGES - 1), F.greatest(F.lit(0), F.floor((t - low) / width).cast("int")))
        spread = here.select("*", F.explode(F.sequence(number(F.col("begin")), number(F.col("finish")))).alias("r"))
        start = F.col("r") * width + low
        words = F.col("weight") * F.greatest(F.lit(0.0), F.least("finish", start + width) - F.greatest("begin", start))
        per_range = spread.groupBy("r").agg(F.sum(words).alias("words"), F.count("*").alias("n"))
        total = F.sum("words").over(Window.orderBy("r")) + served  # TIME_RANGES rows
        cut = per_range.select("r", "words", "n", total.alias("total")).where(F.col("total") >= budget).orderBy("r").first()
        if cut is None:  # all is served before the budget is spent
            return high
        low, high, served = low + cut["r"] * width, low + (cut["r"] + 1) * width, cut["total"] - cut["words"]
        if cut["n"] <= bucket_rows or high - low <= 1e-9 * high:
            break
    here = items.where((F.col("finish") > low) & (F.col("begin") < high))
    at = lambda t: F.least(F.greatest(t, F.lit(low)), F.lit(high))
    ends = F.array(F.struct(at(F.col("begin")).alias("t"), F.col("weight").alias("rate")), F.struct(at(F.col("finish")).alias("t"), (-F.col("weight")).alias("rate")))
    # the few items of the range: their starts and ends in order of virtual time
    order = Window.orderBy("t")
    events = here.select(F.inline(ends)).groupBy("t").agg(F.sum("rate").alias("rate"))
    steps = events.select("t", F.lag("t").over(order).alias("since"), (F.sum("rate").over(order) - F.col("rate")).alias("rate"))
    total = F.sum((F.col("t") - F.col("since")) * F.col("rate")).over(order) + served
    last = steps.select("t", "rate", total.alias("total")).where((F.col("total") >= budget) & (F.col("rate") > 0)).orderBy("t").first()
    return high if last is None else last["t"] - (last["total"] - budget) / last["rate"]


def fair_mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, max_repeats: int = 2, seed: str = "mix", bucket_rows: int = 4096) -> DataFrame:
    """Each document with size, source_size, target, taken and the rounds it is served in.

    ``rounds`` holds (round, virtual_finish, words) of each round that takes words from the document.
    The result is sorted by range of virtual finish time: the order in which the mix serves documents.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(SPACE_WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(text))).alias("draw"),
    )
    slim = stored(slim, "mix-sizes")
    sources = stored(weighted_sources(slim, weights), "mix-weights")
    n_buckets = F.ceil(F.col("n_docs") / bucket_rows)
    same_source = F.col("t.source").eqNullSafe(F.col("d.source"))
    drawn = F.conv(F.substring("draw", 1, 6), 16, 10).cast("long")
    # Sources number few against documents, yet may be any number: the planner picks the join by their size.
    queued = slim.alias("d").join(sources.alias("t"), same_source).select("d.*", "source_size", "weight", F.floor(drawn * n_buckets / RANGE).alias("bucket"))
    per_bucket = queued.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select("source", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "bucket").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = queued.withColumn("within", F.sum("size").over(inside))
    both = (F.col("q.bucket") == F.col("o.bucket")) & F.col("q.source").eqNullSafe(F.col("o.source"))
    timed = summed.alias("q").join(offsets.alias("o"), both).select("q.doc_id", "q.source", "size", "source_size", "weight", (F.col("offset") + F.col("within")).alias("end"))
    timed = stored(timed, "mix-queue")

    every_round = F.sequence(F.lit(0), F.lit(max_repeats - 1))
    items = timed.where("size > 0").select("weight", "size", "source_size", "end", F.explode(every_round).alias("k")).withColumn("end", F.col("end") + F.col("k") * F.col("source_size"))
    items = items.select("weight", ((F.col("end") - F.col("size")) / F.col("weight")).alias("begin"), (F.col("end") / F.col("weight")).alias("finish"))
    budget = min(share, float(max_repeats)) * (slim.agg(F.sum("size")).first()[0] or 0)
    v_cut = queue_cut(items, budget, bucket_rows)
    cap = F.col("source_size") * max_repeats
    # Sums of floats found the moment; the sources that are through by then and the rates of the others give it exactly.
    through = (cap / F.col("weight")) <= v_cut * (1 - 1e-12)
    rest = sources.agg(F.sum(F.when(through, cap).otherwise(0)).alias("words"), F.sum(F.when(through, 0.0).otherwise(F.col("weight"))).alias("rate")).first()
    if rest["rate"]:
        v_cut = (budget - rest["words"]) / rest["rate"]
    target = F.least(cap.cast("double"), F.col("weight") * v_cut)
    rounds = F.transform(
        every_round,
        lambda k: F.struct(
            k.alias("round"),
            ((F.col("end") + k * F.col("source_size")) / F.col("weight")).alias("virtual_finish"),
            F.greatest(F.lit(0), F.least(F.col("size"), F.round("target").cast("long") - (F.col("end") - F.col("size")) - k * F.col("source_size"))).alias("words"),
        ),
    )
    served = timed.withColumn("target", target).withColumn("rounds", F.filter(rounds, lambda r: r["words"] > 0))
    out = served.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.aggregate("rounds", F.lit(0).cast("long"), lambda a, r: a + r["words"]).alias("taken"),
        (F.col("end") / F.col("weight")).alias("virtual_finish"),
        "rounds",
    )
    return out.repartitionByRange("virtual_finish").sortWithinPartitions("virtual_finish")
