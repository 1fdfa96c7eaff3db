"""Corpus cases resolved to features of their records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Kinds of features that may delimit an element, words that name no family, and the least size.
KINDS = ("mobile_element", "repeat_region", "LTR", "misc_feature")
COMMON = ("family", "element", "the", "and", "ty1", "ty3", "clade", "related", "lineage")
LEAST = 200


def tokens(text: Column) -> Column:
    """Distinct words of three letters or more that may name a family."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: (F.length(t) > 2) & ~t.isin(*COMMON)))


def match_features_to_cases(cases: DataFrame, features: DataFrame) -> DataFrame:
    """cases (case_id, accession, coords, expected_superfamily) with start, end, strand and the method that gave them:
    a span of the corpus, a joined location of the corpus, the feature (accession, feature, kind, start, end, strand, name)
    that shares most words with the case (ties: the first), the only feature, or by size: the k-th case of a record that
    is left takes its k-th largest feature that no case took by name, which is weak.

    Only words that a record's cases and features share are joined; a record's left cases and features meet by rank.
    """
    coords = F.coalesce("coords", F.lit(""))
    plain = r"^\s*(\d[\d,]*)\s*(?:\.\.|-|–)\s*(\d[\d,]*)"
    number = lambda i: F.regexp_replace(F.regexp_extract(coords, plain, i), ",", "").try_cast("long")
    pairs = F.regexp_extract_all(coords, F.lit(r"\d+\s*\.\.\s*\d+"), F.lit(0))
    ends = F.transform(F.flatten(F.transform(pairs, lambda p: F.regexp_extract_all(p, F.lit(r"\d+"), F.lit(0)))), lambda x: x.cast("long"))
    given = cases.select("case_id", "accession", "coords", "expected_superfamily", number(1).alias("a"), number(2).alias("b"), F.array_min(ends).alias("low"), F.array_max(ends).alias("high"))
    span, joined = F.col("a").isNotNull(), F.col("low").isNotNull()
    known = given.where(span | joined).select(
        "case_id", (F.when(span, F.col("a")).otherwise(F.col("low")) - 1).alias("start"), F.when(span, F.col("b")).otherwise(F.col("high")).alias("end"),
        F.when(~span, F.when(F.startswith(F.trim("coords"), F.lit("complement")), "-").otherwise("+")).alias("strand"), F.when(span, "corpus span").otherwise("corpus joined location").alias("method"),
    )
    open_ = given.where(~span & ~joined).select("case_id", "accession", "coords", "expected_superfamily")
    fit = features.where(F.col("kind").isin(*KINDS) & (F.col("end") - F.col("start") > LEAST)).select("accession", "feature", "start", "end", "strand", "name")
    want = open_.select("case_id", "accession", F.explode(F.array_union(tokens(F.col("expected_superfamily")), tokens(F.col("coords")))).alias("word"))
    have = fit.select("accession", "feature", "start", "end", "strand", F.explode(tokens(F.col("name"))).alias("word"))
    shared = want.join(have, ["accession", "word"]).groupBy("case_id", "accession", "feature", "start", "end", "strand").agg(F.count("*").alias("n"))
    best = shared.groupBy("case_id", "accession").agg(F.max_by(F.struct("feature", "start", "end", "strand", "n"), F.struct("n", -F.col("feature"))).alias("b"))
    named = best.select("case_id", "accession", "b.*")
    left = open_.join(named.select("case_id"), "case_id", "left_anti").select("case_id", "accession")
    sizes = fit.groupBy("accession").agg(F.count("*").alias("n"), F.min_by(F.struct("start", "end", "strand"), "feature").alias("only"))
    counted = left.join(sizes, "accession", "left")
    sole = counted.where("n = 1").select("case_id", "only.start", "only.end", "only.strand", F.lit("only feature").alias("method"))
    none = counted.where("n is null").select("case_id", *(F.lit(None).cast(t).alias(c) for c, t in (("start", "long"), ("end", "long"), ("strand", "string"))), F.lit("no delimiting feature").alias("method"))
    by = Window.partitionBy("accession")  # the cases, and the features, of one record
    free = fit.join(named.select("accession", "start", "end").distinct(), ["accession", "start", "end"], "left_anti")
    queue = counted.where("n > 1").withColumn("k", F.row_number().over(by.orderBy("case_id")))
    offer = free.withColumn("k", F.row_number().over(by.orderBy(F.desc(F.col("end") - F.col("start")), "feature"))).select("accession", "k", "start", "end", "strand")
    ranked = queue.join(offer, ["accession", "k"], "left")
    ranked = ranked.select("case_id", "start", "end", "strand", F.when(F.col("start").isNull(), "all features taken").otherwise("by size, weak").alias("method"))
    told = named.select("case_id", "start", "end", "strand", F.concat(F.lit("name match of "), "n", F.lit(" words")).alias("method"))
    return known.unionByName(told).unionByName(sole).unionByName(none).unionByName(ranked)
