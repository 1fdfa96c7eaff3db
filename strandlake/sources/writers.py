"""Writers of annotation formats. Rows are sorted by range of sequence and place, never through one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import apart, shares, stored

#: Characters that attributes of a feature line must escape, the percent sign first.
ESCAPES = (("%", "%25"), (";", "%3B"), ("=", "%3D"), ("&", "%26"), (",", "%2C"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D"))


def escaped(c: Column) -> Column:
    for char, code in ESCAPES:
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def gff3_lines(features: DataFrame) -> DataFrame:
    """features (seq_id, kind, start, end, strand, score, id, parent, name) as lines, 1-based and inclusive. A column
    ``extra`` (array of key and value) adds attributes in its order; those without a value are left out. Lines are stored before they are sorted, as ranges
    are drawn from a pass of its own, and sorted in tasks that follow the input."""
    field = lambda key, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{key}="), escaped(F.col(c))))
    more = []
    if "extra" in features.columns:
        told = F.filter(F.coalesce("extra", F.array().cast(features.schema["extra"].dataType)), lambda x: F.coalesce(x["value"], F.lit("")) != "")
        more = [F.transform(told, lambda x: F.concat(x["key"], F.lit("="), escaped(x["value"])))]
    attributes = F.concat_ws(";", field("ID", "id"), field("Parent", "parent"), field("Name", "name"), *more)
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("."))
    line = F.concat_ws("\t", "seq_id", F.lit("strandlake"), "kind", (F.col("start") + 1).cast("string"), F.col("end").cast("string"), dot("score"), dot("strand"), F.lit("."), F.when(attributes == "", ".").otherwise(attributes))
    lines = stored(features.select("seq_id", "start", "end", line.alias("value")), "gff3-lines")
    return lines.repartitionByRange(shares(lines), "seq_id", "start").sortWithinPartitions("seq_id", "start", F.desc("end")).select("value")


#: Ontology terms of structural features, and accessions of terms.
STRUCTURES = {
    "LTR": "long_terminal_repeat",
    "TIR": "terminal_inverted_repeat",
    "TSD": "target_site_duplication",
    "PBS": "primer_binding_site",
    "PPT": "RR_tract",
    "polyA": "sequence_feature",
    "polyT": "sequence_feature",
    "polyA-signal": "polyA_signal_sequence",
}


#: Accessions of the terms of the sequence ontology.
ACCESSIONS = {
    "repeat_region": "SO:0000657",
    "LTR_retrotransposon": "SO:0000186",
    "LINE_element": "SO:0000194",
    "SINE_element": "SO:0000206",
    "YR_retrotransposon": "SO:0002286",
    "terminal_inverted_repeat_element": "SO:0000208",
    "DNA_transposon": "SO:0000182",
    "helitron": "SO:0000544",
    "long_terminal_repeat": "SO:0000286",
    "terminal_inverted_repeat": "SO:0000481",
    "target_site_duplication": "SO:0000434",
    "primer_binding_site": "SO:0005850",
    "RR_tract": "SO:0000435",
    "polypeptide_domain": "SO:0000417",
    "sequence_feature": "SO:0000110",
    "polyA_signal_sequence": "SO:0000551",
}


def _extra(term: Column, **values: Column) -> Column:
    known = F.element_at(F.create_map(*(F.lit(x) for item in ACCESSIONS.items() for x in item)), term)
    return F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in {"Ontology_term": known, **values}.items())).alias("extra")


def annotation_features(calls: DataFrame, lengths: DataFrame | None, evidence: DataFrame, hits: DataFrame) -> DataFrame:
    """Feature rows of elements for gff3_lines: the element under the term that its evidence admits, its structures and its
    domains as children.

    calls: seq_id, te_class, so_term and, where they are known, confidence, tier and scope (what was searched at all), which
    become attributes of the element as its class does; lengths: seq_id, length, or None where calls have their length; evidence as structural_evidence gives it (repeats that are
    advisory make no feature; both copies of a repeat and both ends of a site duplication make one each); hits: seq_id,
    hit_id, domain, strand, score, start, end. Hits and the elements they are looked up in are dealt out alike, over tasks
    that follow the input.
    """
    tasks = shares(hits)
    calls = calls.where(F.col("seq_id").isNotNull())
    sized, ids = calls if lengths is None else calls.join(apart(lengths), "seq_id"), apart(calls.select("seq_id").repartition(tasks, "seq_id"))
    none = F.lit(None).cast("string")
    own = F.concat(F.lit("TE_"), F.col("seq_id").cast("string"))
    columns = ["seq_id", "kind", "start", "end", "strand", "score", "id", "parent", "name", "extra"]
    known = lambda c: F.col(c) if c in calls.columns else none
    element = sized.select("seq_id", F.col("so_term").alias("kind"), F.lit(0).alias("start"), F.col("length").cast("int").alias("end"), none.alias("strand"), F.lit(None).cast("double").alias("score"), own.alias("id"), none.alias("parent"), F.col("te_class").alias("name"), _extra(F.col("so_term"), wicker_code=F.col("te_class"), te_class=F.col("te_class"), classification_confidence=known("confidence"), completeness_tier=known("tier"), domains_tested_scope=known("scope")))
    inner = F.split(F.coalesce("detail", F.lit("")), " ")
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    start, end, n = F.col("start"), F.col("end"), F.col("length")
    two = F.when(F.col("kind").isin("LTR", "TIR"), F.array(span(start, F.get(inner, F.lit(0)).try_cast("int")), span(F.get(inner, F.lit(1)).try_cast("int"), end))).when(F.col("kind") == "TSD", F.array(span(start, start + n), span(end - n, end)))
    term = F.element_at(F.create_map(*(F.lit(x) for item in STRUCTURES.items() for x in item)), F.col("kind"))
    shown = evidence.where(F.col("kind").isin(*STRUCTURES) & (~F.col("advisory") | (F.col("kind") == "polyA-signal"))).join(ids, "seq_id", "left_semi")
    bound = F.when(F.col("lower_bound"), "true") if "lower_bound" in evidence.columns else none
    parts = shown.select("seq_id", "kind", term.alias("term"), _extra(term, length_is_lower_bound=bound, identity_pct=F.col("identity") if "identity" in evidence.columns else none), F.explode(F.coalesce(two, F.array(span(start, end)))).alias("s"))
    structures = parts.select("seq_id", F.col("term").alias("kind"), "s.start", "s.end", none.alias("strand"), F.lit(None).cast("double").alias("score"), F.concat_ws(".", own, "kind", F.col("s.start").cast("string")).alias("id"), own.alias("parent"), F.col("kind").alias("name"), "extra")
    domains = hits.repartition(tasks, "seq_id").join(ids, "seq_id", "left_semi").select("seq_id", F.lit("polypeptide_domain").alias("kind"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "strand", F.col("score").cast("double").alias("score"), F.concat_ws(".", own, F.lit("d"), F.col("hit_id").cast("string")).alias("id"), own.alias("parent"), F.col("domain").alias("name"), _extra(F.lit("polypeptide_domain")))
    return element.unionByName(structures).unionByName(domains).select(*columns)


def write_gff3(features: DataFrame, path: str) -> None:
    gff3_lines(features).write.text(path)


def bed_rows(features: DataFrame) -> DataFrame:
    """BED6, 0-based; the score is rounded and kept within 0..1000."""
    score = F.greatest(F.lit(0), F.least(F.lit(1000), F.coalesce(F.round("score").cast("int"), F.lit(0))))
    return features.repartitionByRange("seq_id", "start").sortWithinPartitions("seq_id", "start").select("seq_id", "start", "end", F.coalesce("name", "kind").alias("name"), score.alias("score"), F.when(F.col("strand").isin("+", "-"), F.col("strand")).otherwise(".").alias("strand"))


def write_bed(features: DataFrame, path: str) -> None:
    bed_rows(features).write.option("sep", "\t").csv(path)


def anchor_to_genome(features: DataFrame, loci: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features of loci (seq_id, chrom, offset, locus_strand) in genome places, and those of minus-strand loci, refused."""
    joined = features.join(loci, "seq_id")
    good = joined.where(F.col("locus_strand") == "+").withColumns({"seq_id": F.col("chrom"), "start": F.col("start") + F.col("offset"), "end": F.col("end") + F.col("offset")})
    return good.select(*features.columns), joined.where(F.col("locus_strand") != "+").select(*features.columns)


def fasta_records(seqs: DataFrame, width: int = 60) -> DataFrame:
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return seqs.select(F.concat(F.lit(">"), "seq_id", F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" "), "description")).otherwise(""), F.lit("\n"), body).alias("value"))


def write_fasta(seqs: DataFrame, path: str, width: int = 60) -> None:
    fasta_records(seqs, width).write.text(path)


def write_table(df: DataFrame, path: str, sep: str = "\t") -> None:
    """All rows, in the declared order of columns."""
    df.write.option("sep", sep).option("header", True).csv(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.select(F.to_json(F.struct(*sorted(manifest.columns))).alias("value")).write.text(path)
