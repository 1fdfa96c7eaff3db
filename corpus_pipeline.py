"""The corpus pipeline: five operators in turn, each over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from strandlake.llm import decontaminate, line_dedup, minhash, mixing, toxicity
from strandlake.llm.common import packed, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject; it learns from the labelled rows of docs."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=tuple(COLUMNS)).where("predicted = 0").select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat across sources; n_chars follows the text. Documents that lose all they had
    go; those that were blank before are left as they are."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS)).where((F.col("n_removed") == 0) | (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one of smallest id. Rows are told apart by id and text."""
    groups = minhash.near_duplicates(docs.select(*COLUMNS))
    rejected = groups.where("not kept").select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_h")).distinct()
    rows = packed(docs.select(*COLUMNS))
    return rows.join(rejected, (F.col("d.doc_id") == F.col("r_id")) & (F.col("h") == F.col("r_h")), "left_anti").select("d.*")


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with the words that the mix takes from it, in the order of the mix."""
    return mixing.fair_mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken", "virtual_finish")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_boilerplate),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
]

#: The stages learn a model, draw hashes and align texts; DuckDB SQL can't express them. See tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
