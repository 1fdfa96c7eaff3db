"""Incremental landscape: new annotation files become sums per unit once, and a changed run refuses to go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.tables import stored
from ..operators.intervals import contig_sums
from ..sources.readers import parse_repeat_lines


def check_signature(spark: SparkSession, folder: str, signature: dict[str, str]) -> None:
    """Keep the signature of a run beside its output; raise where it differs from the one kept."""
    path = f"{folder}/_signature"
    rows = sorted(signature.items())
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        kept = sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect())  # one row per setting
        if kept != rows:
            raise ValueError(f"the run was started with other settings: {kept}")
        return
    spark.createDataFrame(rows, "k string, v string").coalesce(1).write.parquet(path)


def unit_sums(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of hit lines (unit, value): rows, merged bases and divergence by unit and class, and the length of each unit that has
    hits, each of its contigs as long as its last hit reaches. Units are whole contigs, so that their sums add up. Lines are
    parsed once."""
    told = stored(contig_sums(parse_repeat_lines(lines, ["unit"]), ("unit", "query")), "unit-sums")
    sums = told.groupBy("unit", "class_family").agg(*(F.sum(c).alias(c) for c in ("n", "weighted", "width", "bp")))
    return sums, told.groupBy("unit", "query").agg(F.max("length").alias("length")).groupBy("unit").agg(F.sum("length").alias("length"))


def incremental_landscape(spark: SparkSession, incoming: str, folder: str, signature: dict[str, str]) -> StreamingQuery:
    """Read every new file in incoming once. Its hit lines (unit, value) go to folder/hits, its sums to folder/sums and its
    unit (the file's name) to folder/units: exactly once, by the stream's checkpoint and the batch number in the paths."""
    check_signature(spark, folder, signature)
    schema = StructType([StructField("value", StringType())])
    lines = spark.readStream.schema(schema).text(incoming).select(F.col("value"), F.substring_index(F.col("_metadata.file_path"), "/", -1).alias("unit"))

    def keep(batch: DataFrame, number: int) -> None:
        put = lambda name, rows: rows.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        put("hits", batch.where(F.trim("value").rlike(r"^[0-9]+\s")))
        sums, lengths = unit_sums(spark.read.schema(batch.schema).parquet(f"{folder}/hits/batch={number}"))
        put("sums", sums)
        units = batch.select("unit").distinct().join(lengths, "unit", "left")
        put("units", units.withColumn("length", F.coalesce("length", F.lit(0)).cast("long")))

    return lines.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/_checkpoint").trigger(availableNow=True).start()


def progress(spark: SparkSession, folder: str, units: DataFrame) -> DataFrame:
    """One row: units (unit) in all, finished and pending."""
    done = spark.read.parquet(f"{folder}/units").select("unit", F.lit(1).alias("ok")).distinct()
    out = units.select("unit").distinct().join(done, "unit", "left").agg(F.count("*").alias("total"), F.count("ok").alias("finished"))
    return out.withColumn("pending", F.col("total") - F.col("finished"))


def landscape(spark: SparkSession, folder: str, units: DataFrame) -> DataFrame:
    """class_family, n, bp, divergence and percent over all units, from their sums; fails while units are pending."""
    left = progress(spark, folder, units).first()["pending"]
    if left:
        raise ValueError(f"{left} units are not finished")
    genome = spark.read.parquet(f"{folder}/units").agg(F.sum("length").alias("genome_bp"))
    sums = spark.read.parquet(f"{folder}/sums").groupBy("class_family").agg(*(F.sum(c).alias(c) for c in ("n", "bp", "weighted", "width")))
    return sums.crossJoin(F.broadcast(genome)).select("class_family", "n", "bp", (F.col("weighted") / F.col("width")).alias("divergence"), (100 * F.col("bp") / F.col("genome_bp")).alias("percent"))
