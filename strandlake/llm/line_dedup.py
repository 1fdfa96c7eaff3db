"""Removal of lines that repeat across sites: distinct-site spread by HyperLogLog.

1. Each line's hash gets a HyperLogLog sketch of the sites it stands on. Sketches merge map-side, so a line
   that holds a third of all rows reaches the reducer as one sketch per task.
2. Lines clearly under the threshold are left, lines clearly above are boilerplate; those within the
   sketch's error get an exact distinct count from their (line, site) pairs.
3. Boilerplate stays in the document of smallest id that holds it and goes from every other document.

Look-ups of hot lines are not shuffled: lines with more than a thousandth of all line rows, boilerplate or not, number
at most a thousand and are broadcast; the others go by a join on the hash in which no key is hot.
Texts are only joined to the (small) lists of lines to remove, and only once.

Lines are compared by a 64-bit hash of their trimmed, lower-cased form with white space runs made one space.
Blank lines never count. Defined results: null text stays null; a null site counts as a site of its own; a
document that loses all lines keeps its row with an empty text; repeated rows are treated alike; documents
without id never own a line; an empty table gives an empty table; other columns pass through, whatever their names, but
for input columns called ``n_lines`` or ``n_removed``, which the counts replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, stored


def _line_hash(line):
    clean = F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))
    return F.when(clean != "", F.xxhash64(clean))


def boilerplate_lines(lines: DataFrame, min_sites: int = 6, lg_k: int = 9, margin: float = 0.15, hot_at: float = float("inf")) -> DataFrame:
    """line, owner and n_rows of the lines on at least min_sites distinct sites, and, with a null owner, of all others that
    more than hot_at rows hold. ``boilerplate`` tells them apart.

    lines: line (hash), site, doc_id. lg_k: log2 of the sketch's registers; margin: relative width of the band
    around the threshold that is counted exactly (about three standard errors of the sketch).
    """
    site = F.coalesce(F.concat(F.lit("="), F.col("site").cast("string")), F.lit("null"))
    spread = lines.groupBy("line").agg(F.hll_sketch_agg(site, lg_k).alias("sketch"), F.count("*").alias("n_rows"), F.min("doc_id").alias("owner"))
    spread = stored(
        spread.where(F.col("n_rows") >= min_sites).select("line", "n_rows", "owner", F.hll_sketch_estimate("sketch").alias("sites")).where((F.col("sites") >= min_sites * (1 - margin)) | (F.col("n_rows") > hot_at)),
        "line-spread",
    )
    near = spread.where(F.col("sites").between(min_sites * (1 - margin), min_sites * (1 + margin)))
    # (line, site) pairs are made distinct map-side before the join, so that hot lines are small there too.
    pairs = lines.select("line", site.alias("site")).distinct()
    exact = pairs.join(near.select("line"), "line", "left_semi").groupBy("line").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    sure = spread.where(F.col("sites") > min_sites * (1 + margin)).select("line", "owner", "n_rows")
    found = sure.unionByName(near.select("line", "owner", "n_rows").join(exact.select("line"), "line", "left_semi")).withColumn("boilerplate", F.lit(True))
    hot = spread.where(F.col("n_rows") > hot_at).select("line", F.lit(None).cast(spread.schema["owner"].dataType).alias("owner"), "n_rows", F.lit(False).alias("boilerplate"))
    return found.unionByName(hot.join(found.select("line"), "line", "left_anti"))


def dedup_lines(docs: DataFrame, min_sites: int = 6, site_col: str = "source", lg_k: int = 9, margin: float = 0.15) -> DataFrame:
    """docs with the boilerplate lines taken out of text; adds n_lines and n_removed."""
    marks = F.transform(F.split("text", "\n"), _line_hash)
    slim = docs.select("doc_id", F.col(site_col).alias("site"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.array_compact(marks).alias("lines"))
    lines = stored(slim.select("doc_id", "site", "h", F.explode("lines").alias("line")), "lines")
    hot_at = lines.count() / 1000
    found = stored(boilerplate_lines(lines, min_sites, lg_k, margin, hot_at), "boilerplate")
    hot, rest = found.where(F.col("n_rows") > hot_at), found.where((F.col("n_rows") <= hot_at) & F.col("boilerplate"))
    flagged = lines.join(F.broadcast(hot.select("line", "owner", "boilerplate")), "line", "left")  # a thousand rows at most
    known = flagged.where("boilerplate").select("doc_id", "h", "line", "owner")
    # hot lines of either kind are gone from this side before its shuffle
    others = flagged.where("boilerplate IS NULL").select("doc_id", "h", "line").join(rest.select("line", "owner"), "line")
    doomed = known.unionByName(others).where(~F.coalesce(F.col("doc_id") == F.col("owner"), F.lit(False)))
    gone = doomed.groupBy("doc_id", "h").agg(F.collect_set("line").alias("gone")).select(F.col("doc_id").alias("g_id"), F.col("h").alias("g_h"), "gone")
    here = packed(docs).join(gone, F.col("d.doc_id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h")), "left")
    parts = F.split("d.text", "\n")
    keep = F.filter(parts, lambda p: ~F.coalesce(F.array_contains("gone", _line_hash(p)), F.lit(False)))
    text = F.when(F.col("gone").isNull(), F.col("d.text")).otherwise(F.array_join(keep, "\n"))
    n_lines = F.coalesce(F.size(F.filter(parts, lambda p: _line_hash(p).isNotNull())), F.lit(0))
    n_gone = F.coalesce(F.when(F.col("gone").isNotNull(), F.size(parts) - F.size(keep)), F.lit(0))
    out = here.select(F.col("d").withField("text", text).alias("d"), n_lines.alias("n_lines"), n_gone.alias("n_removed"))
    return out.select(*(F.col(f"d.`{c}`") for c in docs.columns if c not in ("n_lines", "n_removed")), "n_lines", "n_removed")
