"""Readers of sequence-annotation text formats. Coordinates come out 0-based and half-open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.profile import cut

#: Columns of a repeat annotation line, in order.
OUT_COLUMNS = ("score", "divergence", "pct_del", "pct_ins", "query", "begin", "end", "left", "strand", "family", "class_family", "c1", "c2", "c3", "fragment_id")


def fasta_lines(spark: SparkSession, path: str, molecule: str = "dna") -> DataFrame:
    """file, record (number in its file), header, at (place of the line in its record), bases: a row per line of residues.

    Lines end in LF, CRLF or CR. Only counts per line and per block of a file (what one task reads of it) are summed in
    order, so that a record may be as long as a chromosome and spread over many tasks. A file without any ``>`` is one
    record; what stands before the first header is dropped.
    """
    # the order within a file, whatever splits it is read in
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"), "value")
    is_head = F.startswith("value", F.lit(">"))
    bases = F.upper(F.regexp_replace("value", r"\s", ""))
    if molecule == "dna":
        bases = F.translate(bases, "U", "T")
    rows = rows.select("file", "block", "i", F.when(is_head, F.trim(F.substring("value", 2, 1 << 30))).alias("head"), F.when(~is_head, bases).alias("bases")).withColumn("n", F.coalesce(F.length("bases"), F.lit(0)).cast("long"))
    within = Window.partitionBy("file", "block").orderBy("i")
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("heads", F.count("head").over(within)).withColumn("done", F.coalesce(F.sum("n").over(before), F.lit(0)))
    rows = rows.withColumn("done", F.col("done") - F.coalesce(F.max(F.when(F.col("head").isNotNull(), F.col("done"))).over(within), F.lit(0)))
    last = F.max_by("head", F.when(F.col("head").isNotNull(), F.col("i")))
    tail = F.max_by(F.col("done") + F.col("n"), "i")
    blocks = rows.groupBy("file", "block").agg(F.count("head").alias("n_heads"), last.alias("last_head"), tail.alias("tail"))
    # What each block starts with: the record that is open, and how much of it the blocks before hold.
    order = Window.partitionBy("file").orderBy("block")
    every = Window.partitionBy("file")
    blocks = blocks.withColumns({"so_far": F.sum("n_heads").over(order), "of_file": F.sum("n_heads").over(every)})
    blocks = blocks.withColumn("sum_tail", F.sum("tail").over(Window.partitionBy("file", "so_far").orderBy("block")))
    first = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", "of_file", (F.col("so_far") - F.col("n_heads")).alias("heads0"), F.last("last_head", True).over(first).alias("head0"), F.coalesce(F.lag("sum_tail").over(order), F.lit(0)).alias("open"))
    j = rows.join(blocks, ["file", "block"])
    own = Window.partitionBy("file", "block").orderBy("i")
    header = F.when(F.col("heads") > 0, F.last("head", True).over(own)).otherwise(F.coalesce("head0", F.lit("input_sequence")))
    out = j.select("file", (F.col("heads0") + F.col("heads")).alias("record"), header.alias("header"), (F.col("done") + F.when(F.col("heads") > 0, 0).otherwise(F.col("open"))).cast("long").alias("at"), "bases", "of_file")
    # A header is kept as a line without bases, so that empty records stay.
    out = out.where((F.col("record") > 0) | (F.col("of_file") == 0))
    return out.select("file", "record", F.when(F.col("header") == "", "record").otherwise(F.col("header")).alias("header"), "at", F.coalesce("bases", F.lit("")).alias("bases"))


def _named(records: DataFrame, *columns: str) -> DataFrame:
    return records.select(F.substring_index("header", " ", 1).alias("seq_id"), F.trim(F.regexp_replace("header", r"^\S+", "")).alias("description"), *columns)


def read_fasta(spark: SparkSession, path: str, molecule: str = "dna") -> DataFrame:
    """seq_id, description, seq of each FASTA record, one row per record; long ones are better read as chunks."""
    lines = fasta_lines(spark, path, molecule)
    parts = F.array_sort(F.collect_list(F.struct("at", "bases")))
    whole = lines.groupBy("file", "record", "header").agg(F.array_join(F.transform(parts, lambda x: x["bases"]), "").alias("seq"))
    return _named(whole.where((F.col("seq") != "") | ~F.col("header").isin("record", "input_sequence")), "seq")


def read_fasta_chunks(spark: SparkSession, path: str, size: int, overlap: int, molecule: str = "dna") -> DataFrame:
    """seq_id, description, chunk_no, start0, bases: records cut while they are read, into pieces of size bases that share
    overlap bases with the next. Each line goes to the chunks that it touches, so that no row is longer than a chunk."""
    lines = fasta_lines(spark, path, molecule).where(F.length("bases") > 0)
    to = F.col("at") + F.length("bases")
    ks = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor((F.col("at") - overlap) / size)), F.floor((to - 1) / size))
    dealt = lines.withColumn("k", F.explode(ks)).withColumn("low", F.greatest("at", F.col("k") * size)).withColumn("high", F.least(to, (F.col("k") + 1) * size + overlap))
    dealt = dealt.where("low < high").select("file", "record", "header", "k", "low", cut("bases", F.col("low") - F.col("at"), F.col("high") - F.col("low")).alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("low", "part")))
    chunks = dealt.groupBy("file", "record", "header", "k").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "").alias("bases"))
    # What only repeats the end of the chunk before is no chunk of its own.
    chunks = chunks.where((F.col("k") == 0) | (F.length("bases") > overlap))
    return _named(chunks, F.col("k").cast("int").alias("chunk_no"), (F.col("k") * size).alias("start0"), "bases")


def read_repeat_table(spark: SparkSession, path: str) -> DataFrame:
    """Repeat annotation table: hits with consensus coordinates, whose columns are reversed on the minus strand.

    Lines whose first token is no number or that have fewer than 11 tokens are skipped; a malformed row drops alone.
    """
    return parse_repeat_lines(spark.read.text(path), [])


def parse_repeat_lines(lines: DataFrame, keep: list[str]) -> DataFrame:
    """Hits of the lines (value) of a repeat annotation table, with the columns named in keep."""
    # exploded, so that a line is split once and not for each use of its tokens
    parts = lines.select(*keep, F.explode(F.array(F.split(F.trim("value"), r"\s+"))).alias("p")).where(F.get("p", F.lit(0)).rlike("^[0-9]+$") & (F.size("p") >= 11))
    t = parts.select(*keep, *(F.get("p", F.lit(i)).alias(c) for i, c in enumerate(OUT_COLUMNS)))
    number = lambda c: F.regexp_replace(c, "[()]", "").try_cast("int")
    minus = F.col("strand") == "C"
    start, left = F.when(minus, number("c3")).otherwise(number("c1")), F.when(minus, number("c1")).otherwise(number("c3"))
    end = number("c2")
    length = end + left
    out = t.select(
        *keep, "query", (F.col("begin").try_cast("int") - 1).alias("q_start"), F.col("end").try_cast("int").alias("q_end"), F.when(minus, "-").otherwise("+").alias("strand"), "family", "class_family", F.col("score").try_cast("int").alias("score"),
        *(F.col(c).try_cast("double").alias(c) for c in ("divergence", "pct_del", "pct_ins")),
        start.alias("cons_start"), end.alias("cons_end"), left.alias("cons_left"), length.alias("cons_length"), F.when(length > 0, F.round(100 * (end - start + 1) / length, 1)).alias("cons_coverage_pct"), "fragment_id",
    )
    return out.where(F.col("q_start").isNotNull() & F.col("q_end").isNotNull() & F.col("divergence").isNotNull())


def read_sam_splice(spark: SparkSession, path: str) -> DataFrame:
    """Exon and intron blocks of the first kept alignment of each query: skipped operations N split exons."""
    # files in the order of their names, lines in their order within them
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    lines = spark.read.text(path).withColumn("i", place).where(~F.startswith("value", F.lit("@"))).select("i", F.split("value", "\t").alias("p"))
    rows = lines.where(F.size("p") >= 6).select("i", F.get("p", F.lit(0)).alias("query"), F.get("p", F.lit(1)).cast("int").alias("flag"), F.get("p", F.lit(2)).alias("ref"), F.get("p", F.lit(3)).cast("int").alias("pos"), F.get("p", F.lit(5)).alias("cigar"))
    rows = rows.where(F.col("flag").bitwiseAND(4 | 0x100 | 0x800) == 0)
    first = rows.groupBy("query").agg(F.min_by(F.struct("flag", "ref", "pos", "cigar"), "i").alias("r")).select("query", "r.*")
    ops = first.select("query", "ref", "flag", "pos", F.posexplode(F.regexp_extract_all("cigar", F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))).alias("k", "op"))
    ops = ops.select("query", "ref", "flag", "pos", "k", F.regexp_extract("op", "[0-9]+", 0).cast("int").alias("len"), F.substring("op", -1, 1).alias("op")).where(F.col("op").isin("M", "=", "X", "D", "N"))
    order = Window.partitionBy("query").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    skip = F.col("op") == "N"
    placed = ops.withColumn("to", F.sum("len").over(order)).withColumn("run", F.sum(skip.cast("int")).over(order))
    blocks = placed.groupBy("query", "ref", "flag", "pos", F.col("run"), skip.alias("intron")).agg(F.min(F.col("to") - F.col("len")).alias("lo"), F.max("to").alias("hi"))
    return blocks.select("query", "ref", F.when(F.col("flag").bitwiseAND(16) > 0, "-").otherwise("+").alias("strand"), F.when(F.col("intron"), "intron").otherwise("exon").alias("kind"), (F.col("pos") - 1 + F.col("lo")).alias("start"), (F.col("pos") - 1 + F.col("hi")).alias("end"))


def read_ispcr(spark: SparkSession, path: str) -> DataFrame:
    """Amplicons from headers ``>CHROM:START+END name SIZEbp F R``; other lines are ignored."""
    pattern = r"^>(\S+):([0-9]+)([+-])([0-9]+)\s+(\S+)\s+([0-9]+)bp\s+(\S+)\s+(\S+)"
    g = lambda i: F.regexp_extract("value", pattern, i)
    rows = spark.read.text(path).where(F.col("value").rlike(pattern)).select(g(1).alias("source"), g(2).cast("long").alias("a"), g(3).alias("strand"), g(4).cast("long").alias("b"), g(5).alias("name"), g(6).cast("int").alias("length"), g(7).alias("f"), g(8).alias("r"))
    single = F.col("name").isin("fwdonly", "revonly") | (F.lower("f") == F.lower("r"))
    return rows.select("source", (F.least("a", "b") - 1).alias("start"), F.greatest("a", "b").alias("end"), "strand", "name", "length", single.alias("single_primer")).orderBy("single_primer", "source", "start")


def read_assembly_maps(spark: SparkSession, path: str) -> DataFrame:
    """Molecules of assembly files (JSON)."""
    fields = "chrName string, ucscStyleName string, refseqAccession string, length long"
    rows = spark.read.schema(f"assemblyAccession string, molecules array<struct<{fields.replace(' string', ':string').replace(' long', ':long')}>>").option("multiLine", True).json(path)
    m = rows.select(F.col("assemblyAccession").alias("assembly"), F.explode("molecules").alias("m"))
    return m.select("assembly", F.col("m.chrName").alias("chr_name"), F.col("m.ucscStyleName").alias("ucsc_name"), F.col("m.refseqAccession").alias("accession"), F.col("m.length").alias("length"))


def parse_regions(requests: DataFrame) -> DataFrame:
    """requests (request_id, text): loci ``chr:start-end``, separated by lines or semicolons; a comma is a thousands mark.

    Rejected pieces keep their reason; start comes out 0-based.
    """
    pieces = requests.select("request_id", F.posexplode(F.split("text", r"[\n;]")).alias("n", "piece")).withColumn("piece", F.trim("piece")).where(F.col("piece") != "")
    plain = F.regexp_replace("piece", r"[,\s]", "")
    pattern = r"^(?:chr)?([^:]+):([0-9]+)(?:-|\.\.)([0-9]+)$"
    g = lambda i: F.regexp_extract(plain, "(?i)" + pattern, i)
    rows = pieces.select("request_id", "n", "piece", g(1).alias("chrom"), g(2).try_cast("long").alias("a"), g(3).try_cast("long").alias("b"))
    reason = F.when(F.col("a").isNull() | F.col("b").isNull(), "malformed").when(F.col("a") < 1, "start before 1").when(F.col("a") > F.col("b"), "start after end")
    return rows.select("request_id", "n", "piece", F.when(reason.isNull(), F.col("chrom")).alias("chrom"), F.when(reason.isNull(), F.col("a") - 1).alias("start"), F.when(reason.isNull(), F.col("b")).alias("end"), reason.alias("reason"))
