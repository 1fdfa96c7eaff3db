"""Helpers shared by the corpus operators."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import shared_dir, stored

__all__ = ["SPACE_WORD", "alnum_words", "ascii_lower", "literal_rows", "packed", "shared_dir", "stored", "table"]

#: Characters that separate words in contracts that count space-delimited words.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: What stands between words of letters, digits and non-ASCII characters.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """lower() with the one non-ASCII letter that lowers to ASCII (the Kelvin sign) set aside first."""
    return F.lower(F.replace(text, F.lit("K"), F.lit("µ")))


def alnum_words(text: Column) -> Column:
    """Words of letters, digits and every non-ASCII character (split is twice as fast as regexp_extract_all)."""
    return F.array_remove(F.split(text, ALNUM_GAP), "")


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows as a DataFrame without Python workers; schema as in "a int, b array<string>", with ; between the
    fields of structs."""
    fields = [field.split(" ", 1) for field in schema.split(", ")]
    text = json.dumps([{name: value for (name, _), value in zip(fields, row)} for row in rows])
    kind = ",".join(f"{name}:{of}" for name, of in fields).replace(";", ",")
    return spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{kind}>>")))


def packed(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Whole rows as one struct ``d`` beside the hash ``h`` of their text, so that no input column clashes with columns
    that an operator adds; ``select("d.*")`` gives the rows back."""
    return docs.select(F.struct("*").alias("d"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
