"""Readers of feature, domain-hit and gene-model formats, and of corpus tables. Coordinates come out 0-based and half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.params import value

#: Profile, domain code, class and accession of the domain panel.
PANEL = (
    ("RVT_1", "RT", "retro", "PF00078"),
    ("RVT_2", "RT", "retro", "PF07727"),
    ("RVT_3", "RT", "retro", "PF13456"),
    ("rve", "INT", "retro", "PF00665"),
    ("RNase_H", "RNaseH", "retro", "PF00075"),
    ("RVP", "PR", "retro", "PF00077"),
    ("PEG10_N-capsid", "GAG", "retro", "PF03732"),
    ("Gag_p24", "GAG", "retro", "PF00607"),
    ("Gag_p24_C", "GAG", "retro", "PF19317"),
    ("Gag_p10", "GAG", "retro", "PF02337"),
    ("zf-CCHC_5", "GAG", "retro", "PF14787"),
    ("HERV-K_env_2", "ENV", "retro", "PF13804"),
    ("GP41", "ENV", "retro", "PF00517"),
    ("TLV_coat", "ENV", "retro", "PF00429"),
    ("Chromo", "CHR", "retro", "PF00385"),
    ("HTH_Tnp_Tc3_2", "TPase", "dna:Tc1-Mariner", "PF01498"),
    ("DDE_1", "TPase", "dna:DDE", "PF03184"),
    ("DDE_3", "TPase", "dna:Tc1-Mariner", "PF13358"),
    ("Transposase_1", "TPase", "dna:Tc1-Mariner", "PF01359"),
    ("Dimer_Tnp_hAT", "TPase", "dna:hAT", "PF05699"),
    ("hAT-like_RNase-H", "TPase", "dna:hAT", "PF14372"),
    ("Transposase_22", "ORF1", "retro:LINE", "PF02994"),
    ("Tnp_22_trimer", "ORF1", "retro:LINE", "PF17489"),
    ("Tnp_22_dsRBD", "ORF1", "retro:LINE", "PF17490"),
    ("Exo_endo_phos", "EN", "retro:LINE?", "PF03372"),
    ("Phage_integrase", "YR", "retro:YR?", "PF00589"),
    ("Helitron_like_N", "HEL", "dna:Helitron", "PF14214"),
    ("Transposase_24", "TPase", "dna:CACTA", "PF03004"),
    ("MULE", "TPase", "dna:MULE", "PF10551"),
    ("DDE_Tnp_1_7", "TPase", "dna:IS4", "PF13843"),
)
#: What a deposit may be of its element, and what identifies a case.
SCOPES = ("element", "containing_record")
CASE_KEY = ("accession", "coords", "expected_superfamily")
#: Qualifiers that name a feature's family.
NAME_QUALIFIERS = ("mobile_element_type", "rpt_family", "note", "standard_name", "label", "gene", "product")
#: Ends of introns that splice as a rule.
SPLICE = ("GT-AG", "GC-AG", "AT-AC")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line (an order within the file, whatever splits it is read in) and value of each line of text files."""
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


def read_hmm_domtbl(spark: SparkSession, path: str, orfs: DataFrame, evalue: float | None = None) -> DataFrame:
    """Domain hits of a profile search against frames: a table by domain, whose targets are named ``orf`` and the frame's
    number on its sequence, or ``sequence|orfN`` where several sequences were searched.

    orfs: seq_id, orf_idx, strand, start, end. Places on the protein become places on the sequence by the frame's strand.
    Domains whose independent E-value is not under the limit drop out; unknown profiles keep their name, class other.
    """
    limit = value("domain_evalue_max") if evalue is None else evalue
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(p.alias("p")).where(F.size("p") >= 22)
    field = lambda i: F.get("p", F.lit(i))
    t = rows.select(field(0).alias("target"), field(3).alias("hmm"), field(12).try_cast("double").alias("evalue"), field(13).try_cast("double").alias("score"), field(19).try_cast("int").alias("aa_start"), field(20).try_cast("int").alias("aa_end"))
    t = t.where(F.col("evalue").isNotNull() & F.col("aa_start").isNotNull() & F.col("aa_end").isNotNull() & (F.col("evalue") < limit))
    named = F.contains("target", F.lit("|"))
    t = t.withColumn("name", F.when(named, F.substring_index("target", "|", 1))).withColumn("orf_idx", F.regexp_extract("target", r"orf([0-9]+)$", 1).try_cast("int"))
    panel = spark.createDataFrame(list(PANEL), "hmm string, domain string, class string, pfam string")
    o = orfs.select(F.col("seq_id"), "orf_idx", "strand", F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    joined = t.join(o, (t.orf_idx == o.orf_idx) & (t.name.isNull() | (t.name == o.seq_id.cast("string")))).drop(o.orf_idx)
    joined = joined.join(F.broadcast(panel), "hmm", "left")  # as many rows as PANEL
    plus = F.col("strand") == "+"
    first, last = F.col("aa_start") - 1, F.col("aa_end")
    return joined.select(
        "seq_id", "orf_idx", "strand", F.coalesce("domain", "hmm").alias("domain"), F.coalesce("class", F.lit("other")).alias("class"), "hmm", F.coalesce("pfam", F.lit("")).alias("pfam"), F.round("score", 1).alias("score"), "evalue",
        F.when(F.col("evalue") <= 1e-10, "high").otherwise("moderate").alias("confidence"), "aa_start", "aa_end",
        F.when(plus, F.col("o_start") + 3 * first).otherwise(F.col("o_end") - 3 * last).alias("start"), F.when(plus, F.col("o_start") + 3 * last).otherwise(F.col("o_end") - 3 * first).alias("end"),
    )


def _attributes(c: Column) -> Column:
    pairs = F.filter(F.split(c, ";"), lambda x: F.contains(x, F.lit("=")))
    return F.map_from_entries(F.array_distinct(F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_replace(x, "^[^=]*=", "").alias("v")))))


def read_spliced_gff3(spark: SparkSession, path: str, proteins: DataFrame, seqs: DataFrame, max_hits: int = 25) -> DataFrame:
    """Gene models of a spliced protein alignment, the best max_hits of each sequence: rank_no, protein, strand, score,
    identity, exons and introns (in places on the sequence, with their ends read on the strand), counts and coverage.

    Coding parts are grouped by their parent; introns are the gaps between neighbours. proteins (protein, length) gives
    the coverage; seqs (seq_id, seq) the ends of introns, which are cut from the bases at the gaps only.
    """
    f = F.split("value", "\t")
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(F.col("_metadata.file_path").alias("file"), f.alias("f")).where(F.size("f") >= 9)
    field = lambda i: F.get("f", F.lit(i))
    rows = lines.select("file", field(0).alias("seq_id"), field(2).alias("kind"), (field(3).try_cast("int") - 1).alias("start"), field(4).try_cast("int").alias("end"), field(5).try_cast("double").alias("score"), field(6).alias("strand"), _attributes(field(8)).alias("a"))
    target = F.split(F.element_at("a", F.lit("Target")), " ")
    whole = lambda key: F.element_at("a", F.lit(key)).try_cast("int")
    models = rows.where("kind = 'mRNA'").select(
        "file", F.element_at("a", F.lit("ID")).alias("id"), "seq_id", "strand", "score", "start", "end", F.get(target, F.lit(0)).alias("protein"), F.get(target, F.lit(1)).try_cast("int").alias("protein_start"), F.get(target, F.lit(2)).try_cast("int").alias("protein_end"),
        F.element_at("a", F.lit("Identity")).try_cast("double").alias("identity"), F.element_at("a", F.lit("Positive")).try_cast("double").alias("positive"), whole("Rank").alias("rank"),
        F.coalesce(whole("Frameshift"), F.lit(0)).alias("frameshifts"), F.coalesce(whole("StopCodon"), F.lit(0)).alias("inframe_stops"),
    )
    coding = rows.where("kind = 'CDS'").select("file", F.element_at("a", F.lit("Parent")).alias("id"), "start", "end").groupBy("file", "id").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cds"))
    both = models.join(coding, ["file", "id"], "left").join(proteins.select("protein", F.col("length").alias("protein_len")), "protein", "left")
    order = Window.partitionBy("seq_id").orderBy(F.desc(F.coalesce("score", F.lit(0.0))), F.desc(F.coalesce("identity", F.lit(0.0))), "start", "id")
    top = both.withColumn("rank_no", F.row_number().over(order)).where(F.col("rank_no") <= max_hits)
    cds = F.coalesce("cds", F.array().cast("array<struct<start:int,end:int>>"))
    gaps = F.filter(F.transform(cds, lambda c, i: F.struct(c["end"].alias("start"), F.get(cds, i + 1)["start"].alias("end"))), lambda g: g["end"] > g["start"])
    placed = top.join(seqs.select("seq_id", "seq"), "seq_id", "left")
    two = lambda at: F.substring(F.col("seq").cast("binary"), at + 1, F.lit(2)).cast("string")
    turned = lambda c: F.reverse(F.translate(F.upper(c), "ACGT", "TGCA"))
    minus = F.col("strand") == "-"
    ends = lambda g: (F.when(minus, turned(two(g["end"] - 2))).otherwise(F.upper(two(g["start"]))), F.when(minus, turned(two(g["start"]))).otherwise(F.upper(two(g["end"] - 2))))
    introns = F.transform(gaps, lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"), ends(g)[0].alias("donor"), ends(g)[1].alias("acceptor"), F.concat_ws("-", *ends(g)).isin(*SPLICE).alias("canonical")))
    coverage = F.round((F.col("protein_end") - F.col("protein_start") + 1) / F.col("protein_len"), 4)
    return placed.select(
        "seq_id", "rank_no", "id", "protein", "strand", "score", "identity", "positive", "rank", "frameshifts", "inframe_stops", "start", "end", "protein_start", "protein_end", "protein_len", F.when(F.col("protein_len") > 0, coverage).alias("protein_coverage"),
        F.when(minus, F.reverse(cds)).otherwise(cds).alias("exons"), introns.alias("introns"), F.size(cds).alias("n_exons"), F.size(introns).alias("n_introns"), F.size(F.filter(introns, lambda i: i["canonical"])).alias("n_canonical"),
    )


def read_feature_table(spark: SparkSession, path: str) -> DataFrame:
    """Five-column feature tables: file, feature (its number), kind, intervals (start, end, strand) and qualifiers.

    An interval whose start lies behind its end is on the minus strand; rows without a kind extend the feature before;
    of a repeated qualifier the first counts.
    """
    f = F.split("value", "\t")
    lines = numbered_lines(spark, path).where((F.trim("value") != "") & ~F.startswith("value", F.lit(">"))).select("file", "line", f.alias("f"))
    field = lambda i: F.coalesce(F.get("f", F.lit(i)), F.lit(""))
    place = lambda i: F.regexp_extract(F.trim(field(i)), r"^[<>]?([0-9]+)$", 1).try_cast("long")
    placed = place(0).isNotNull() & place(1).isNotNull()
    rows = lines.select("file", "line", "f", placed.alias("placed"), (placed & (field(2) != "")).alias("opens"), place(0).alias("a"), place(1).alias("b"), field(2).alias("kind"))
    # a file's lines are one feature table, small beside the corpus of files
    order = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("feature", F.sum(F.col("opens").cast("int")).over(order)).where(F.col("feature") > 0)
    interval = F.struct("line", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("end"), F.when(F.col("a") <= F.col("b"), "+").otherwise("-").alias("strand"))
    spans = numbered.where("placed").groupBy("file", "feature").agg(F.max(F.when(F.col("opens"), F.col("kind"))).alias("kind"), F.array_sort(F.collect_list(interval)).alias("i"))
    spans = spans.select("file", "feature", "kind", F.transform("i", lambda x: F.struct((x["low"] - 1).alias("start"), x["end"].alias("end"), x["strand"].alias("strand"))).alias("intervals"))
    told = F.filter("f", lambda x: x != "")
    quals = numbered.where(~F.col("placed") & (F.get("f", F.lit(0)) == "") & (F.size(told) > 0)).select("file", "feature", "line", F.get(told, F.lit(0)).alias("k"), F.coalesce(F.get(told, F.lit(1)), F.lit("")).alias("v"))
    firsts = quals.groupBy("file", "feature", "k").agg(F.min_by("v", "line").alias("v")).groupBy("file", "feature").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("qualifiers"))
    none = F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))
    return spans.join(firsts, ["file", "feature"], "left").withColumn("qualifiers", F.coalesce("qualifiers", none))


def read_genbank_features(spark: SparkSession, path: str, names: tuple[str, ...] = NAME_QUALIFIERS) -> DataFrame:
    """Features of flat files: file, feature, kind, location, the outermost span of the location, its strand, and the
    name qualifiers as one lower-case text. Locations and qualifiers go on over lines."""
    lines = numbered_lines(spark, path)
    order = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    opens, leaves = F.startswith("value", F.lit("FEATURES")), ~F.startswith("value", F.lit(" ")) & (F.col("value") != "")
    # the table ends at the first line after its head that is not indented
    heads = F.sum(opens.cast("int")).over(order)
    inside = lines.select("file", "line", "value", heads.alias("h"), F.sum(F.when(leaves & ~opens, 1).otherwise(0)).over(order).alias("x"), opens.alias("opens")).where("h > 0")
    inside = inside.withColumn("x0", F.min("x").over(Window.partitionBy("file"))).where((F.col("x") == F.col("x0")) & ~F.col("opens"))
    feature = F.col("value").rlike(r"^\s{5}\S+\s+\S")
    body = inside.select("file", "line", "value", feature.alias("starts"), F.sum(feature.cast("int")).over(order).alias("feature")).where("feature > 0")
    qualifier = F.regexp_extract("value", r"^\s{21}/(\w+)", 1)
    marked = body.withColumn("q", F.when(F.col("starts") | (qualifier != ""), 1).otherwise(0)).withColumn("part", F.sum("q").over(Window.partitionBy("file", "feature").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))
    text = F.when(F.col("starts"), F.regexp_extract("value", r"^\s{5}\S+\s+(\S.*)$", 1)).when(qualifier != "", F.regexp_extract("value", r'^\s{21}/\w+=?"?([^"]*)"?', 1)).otherwise(F.regexp_replace(F.trim("value"), '^"+|"+$', ""))
    listed = marked.groupBy("file", "feature", "part").agg(F.max(F.when(F.col("starts"), F.regexp_extract("value", r"^\s{5}(\S+)", 1))).alias("kind"), F.max(F.when(qualifier != "", qualifier)).alias("k"), F.array_sort(F.collect_list(F.struct("line", F.trim(text).alias("t")))).alias("t"))
    place = listed.where("kind is not null").select("file", "feature", "kind", F.array_join(F.col("t.t"), "").alias("location"))
    quals = listed.where("k is not null").select("file", "feature", "part", "k", F.array_join(F.col("t.t"), " ").alias("v"))
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("k"))
    last = quals.where(F.col("k").isin(*names)).groupBy("file", "feature", "k").agg(F.max_by("v", "part").alias("v"))
    named = last.groupBy("file", "feature").agg(F.array_join(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "v")))["v"], " ").alias("name"))
    numbers = F.transform(F.flatten(F.transform(F.regexp_extract_all("location", F.lit(r"\d+\s*\.\.\s*[<>]?\d+"), F.lit(0)), lambda p: F.regexp_extract_all(p, F.lit(r"\d+"), F.lit(0)))), lambda x: x.cast("long"))
    out = place.join(named, ["file", "feature"], "left")
    return out.select("file", "feature", "kind", "location", (F.array_min(numbers) - 1).alias("start"), F.array_max(numbers).alias("end"), F.when(F.startswith("location", F.lit("complement")), "-").otherwise("+").alias("strand"), F.lower(F.coalesce("name", F.lit(""))).alias("name"))


def read_cases(spark: SparkSession, table: str, results: str | None = None) -> DataFrame:
    """A corpus table (tab-separated, with a header) and, if given, the raw result of each case (JSON), joined by what
    identifies a case. Fails on an empty corpus, an unknown scope, a case without accession and on cases that aren't unique."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(table)
    if "record_scope" not in rows.columns:
        raise ValueError("the corpus has no column record_scope")
    for name in ("accession", "record_scope", "panel", *CASE_KEY):
        rows = rows.withColumn(name, F.trim(F.coalesce(F.col(name) if name in rows.columns else F.lit(None).cast("string"), F.lit(""))))
    bad = rows.agg(F.count("*").alias("n"), F.count_if(~F.col("record_scope").isin(*SCOPES)).alias("scope"), F.count_if(F.col("accession") == "").alias("accession")).first()
    repeated = rows.groupBy(*CASE_KEY).count().where("count > 1").limit(1).collect()
    for wrong, what in ((bad["n"] == 0, "has no rows"), (bad["scope"], "has rows whose record_scope is unknown"), (bad["accession"], "has rows without accession"), (repeated, f"has a case that is not unique: {repeated}")):
        if wrong:
            raise ValueError(f"the corpus {what}")
    if results is None:
        return rows
    raw = spark.read.option("multiLine", True).json(results)
    key = [F.trim(F.coalesce(F.col(c) if c in raw.columns else F.lit(None).cast("string"), F.lit(""))).alias(c) for c in CASE_KEY]
    return rows.join(raw.select(*key, F.struct("*").alias("result")), list(CASE_KEY), "left")
