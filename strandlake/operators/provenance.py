"""Seals, their audit, run status and a runtime model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Input labels that change from run to run and are never sealed.
VOLATILE = ("created_utc", "environment", "elapsed_s", "host", "retrieved_utc")


def seal(df: DataFrame, key: str, exclude: tuple[str, ...] = VOLATILE) -> DataFrame:
    """key and a hash of the row's other columns as JSON, in the order of their names, less the excluded ones. JSON escapes
    what it quotes and writes nulls, so that different rows never read alike."""
    names = sorted(c for c in df.columns if c != key and c not in exclude)
    return df.select(key, F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in names)), {"ignoreNullFields": "false"}), 256).alias("seal"))


def seal_coverage(derived: DataFrame, sealed: DataFrame) -> DataFrame:
    """Parameters that decide a run against those its seal records (both: run_id, parameters as a map of key paths to
    values): one row for each run and key that is derived but not sealed, sealed but not derived, or sealed with another
    value."""
    keys = lambda df, name: df.select("run_id", F.explode("parameters").alias("key", name))
    live, kept = keys(derived, "derived").withColumn("a", F.lit(True)), keys(sealed, "sealed").withColumn("b", F.lit(True))
    state = F.when(F.col("b").isNull(), "not sealed").when(F.col("a").isNull(), "not derived").when(~F.col("derived").eqNullSafe(F.col("sealed")), "differs")
    return live.join(kept, ["run_id", "key"], "full").withColumn("state", state).where("state IS NOT NULL").select("run_id", "key", "derived", "sealed", "state")


def table_seal(seals: DataFrame, key: str) -> DataFrame:
    """Per key prefix of a seal (256 shards): rows and a hash of the sorted row hashes.

    Equal seals are one entry with their count, so they can't cancel. Hashed level by level: first the entries of each
    longer prefix (65,536 of them), then those hashes per shard.
    """
    listed = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), "\n"), 256)
    entries = seals.groupBy("seal").agg(F.count("*").alias("n"))
    ranges = entries.groupBy(F.substring("seal", 1, 4).alias("range")).agg(F.sum("n").alias("n"), listed(F.concat_ws(":", "seal", "n")).alias("h"))
    return ranges.groupBy(F.substring("range", 1, 2).alias("shard")).agg(F.sum("n").alias("n"), listed(F.concat_ws(":", "range", "h")).alias("digest"))


def seal_audit(runs: DataFrame) -> DataFrame:
    """runs (input_id, seal): inputs whose seal moved between runs, and seals that several inputs share."""
    per_input = runs.groupBy("input_id").agg(F.countDistinct("seal").alias("m")).agg(F.count("*").alias("inputs"), F.count_if(F.col("m") > 1).alias("unstable"))
    per_seal = runs.groupBy("seal").agg(F.countDistinct("input_id").alias("m")).agg(F.count("*").alias("seals"), F.count_if(F.col("m") > 1).alias("shared"))
    return per_input.crossJoin(per_seal)


def run_status(units: DataFrame, done: DataFrame) -> DataFrame:
    """Per genome: units in all, finished and pending."""
    d = done.select("genome", "unit", F.lit(1).alias("ok")).distinct()
    out = units.select("genome", "unit").distinct().join(d, ["genome", "unit"], "left").groupBy("genome").agg(F.count("*").alias("total"), F.count("ok").alias("finished"))
    return out.withColumn("pending", F.col("total") - F.col("finished"))


def runtime_model(runs: DataFrame, requests: DataFrame, keep: int = 40) -> DataFrame:
    """Estimated seconds for requests (job, size): a least-squares line over a job's last samples (job, at, size, secs),
    or the mean rate where the line doesn't rise or the request lies far beyond the samples."""
    recent = runs.withColumn("__n", F.row_number().over(Window.partitionBy("job").orderBy(F.desc("at")))).where(F.col("__n") <= keep)
    n, sx, sy, sxx, sxy = F.count("*"), F.sum("size"), F.sum("secs"), F.sum(F.col("size") * F.col("size")), F.sum(F.col("size") * F.col("secs"))
    fit = recent.groupBy("job").agg(n.alias("n"), sx.alias("sx"), sy.alias("sy"), sxx.alias("sxx"), sxy.alias("sxy"), F.max("size").alias("largest"))
    c = F.col
    d = c("n") * c("sxx") - c("sx") * c("sx")
    slope = (c("n") * c("sxy") - c("sx") * c("sy")) / d
    line = (c("sy") - slope * c("sx")) / c("n") + slope * c("size")
    rate = c("sy") / c("sx") * c("size")
    use = (c("n") >= 2) & (d > 0) & (slope > 0) & (c("size") <= 1.5 * c("largest")) & (line >= 1)
    eta = F.when(use, line).when(c("sx") > 0, F.greatest(F.lit(1.0), F.when((c("n") >= 2) & (d == 0), c("sy") / c("n")).otherwise(rate)))
    out = requests.join(fit, "job", "left")
    return out.select("job", "size", eta.alias("eta_s"), F.when(c("n").isNull(), "heuristic").otherwise("calibrated").alias("basis"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
