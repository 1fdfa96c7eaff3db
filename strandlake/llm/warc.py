"""WARC archives and their Merkle fixity audit.

``to_records`` writes pages as WARC/1.0 response records, ``lay_out`` deals them to archive files and gives each its
offset, ``parse_records`` reads record text back. An index row of a replica is (file, seq, start, length, copies,
digest): what a crawler's index keeps of each record, with the digest of the bytes found there now.

``write_warc`` writes archive files and ``read_warc`` reads WARC files, plain or gzipped, record by record.

``merkle_tree`` hashes records with their offset ranges into leaves and each ``fan`` neighbours in order into a node,
level by level inside each file, then over the files in order up to one root. ``audit`` compares the roots of two
replicas and descends only into branches that differ: a level's nodes are read where their parent differs.

A node's children are at most ``fan``; windows see one archive file, dealt by hash to about ``per_file`` records.
Bodies are hashed where they are read and never shuffled. Rows that repeat a whole record are one leaf with a count
of copies.

Defined results: null url or html is the empty string; a null page_id is a record of its own; equal replicas give no
row; a record of one side only is ``missing`` (not in the second) or ``extra`` (not in the first), one on both sides
``altered``; empty replicas are equal; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CRLF = "\r\n"
KEYS = ["file", "idx"]


def record_text(url: Column, body: Column, record_id: Column) -> Column:
    """A WARC/1.0 response record."""
    return F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: response{CRLF}WARC-Record-ID: <urn:md5:"),
        record_id,
        F.lit(f">{CRLF}WARC-Target-URI: "),
        url,
        F.lit(f"{CRLF}Content-Length: "),
        F.octet_length(body).cast("string"),
        F.lit(CRLF + CRLF),
        body,
        F.lit(CRLF + CRLF),
    )


def to_records(pages: DataFrame) -> DataFrame:
    """page_id, record_id and the record's text for each page."""
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    record_id = F.md5(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("|"), url))
    return pages.select("page_id", record_id.alias("record_id"), record_text(url, html, record_id).alias("record"))


def parse_records(records: DataFrame) -> DataFrame:
    """page_id, record_id, url and html read back from the text of records."""
    head = F.substring_index("record", CRLF + CRLF, 1)
    field = lambda name: F.regexp_extract(head, rf"\r\n{name}: ([^\r\n]*)", 1)
    body = F.substring("record", F.length(head) + 5, F.length("record") - F.length(head) - 8)
    return records.select("page_id", F.regexp_extract(head, r"<urn:md5:([0-9a-f]*)>", 1).alias("record_id"), field("WARC-Target-URI").alias("url"), body.alias("html"))


def write_warc(records: DataFrame, path: str) -> None:
    """Records (file, seq, record) as archive files: one text part per file number, records in order."""
    body = F.substring("record", F.lit(1), F.length("record") - 4)  # the two line ends after a record are the separator
    records.repartition("file").sortWithinPartitions("file", "seq").select("file", body.alias("value")).write.partitionBy("file").option("lineSep", CRLF + CRLF).text(path)


def read_warc(spark, path: str) -> DataFrame:
    """path, start (offset in the unpacked file), type, record_id, url, length and digest of each record's bytes, and its
    body, for the WARC files under path; bodies are found by their Content-Length, so they may hold anything."""
    names = ["path", "start", "type", "record_id", "url", "length", "digest", "body"]

    def parse(batches):
        import gzip
        import hashlib

        import pyarrow as pa

        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                at, rows = 0, []
                while (at := data.find(b"WARC/1.", at)) >= 0:
                    stop = data.find(b"\r\n\r\n", at)
                    if stop < 0:
                        break
                    head = dict(line.split(": ", 1) for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
                    size = int(head.get("Content-Length", 0))
                    end = min(len(data), stop + 4 + size + 4)
                    record = data[at:end]
                    rows.append((name, at, head.get("WARC-Type"), head.get("WARC-Record-ID"), head.get("WARC-Target-URI"), len(record), hashlib.sha256(record).hexdigest(), data[stop + 4 : stop + 4 + size]))
                    at = end
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=pa.schema([(n, {"start": pa.int64(), "length": pa.int64(), "body": pa.binary()}.get(n, pa.string())) for n in names]))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(parse, "path string, start long, type string, record_id string, url string, length long, digest string, body binary")


def lay_out(digests: DataFrame, per_file: int = 2048) -> DataFrame:
    """Deal records (page_id, record_id, length, digest and others) to files: adds copies, file, seq and start."""
    rest = [c for c in digests.columns if c not in ("page_id", "record_id", "length", "digest")]
    once = stored(digests.groupBy("page_id", "record_id", "length", "digest", *rest).agg(F.count("*").alias("copies")), "warc-records")
    n_files = max(1, -(-once.count() // per_file))
    drawn = F.conv(F.substring(F.md5(F.concat("record_id", F.lit("|"), "digest")), 1, 8), 16, 10).cast("long")
    order = Window.partitionBy("file").orderBy("record_id", "digest", "page_id", *rest)
    dealt = once.withColumn("file", drawn % n_files)
    return dealt.withColumn("seq", F.row_number().over(order).cast("long") - 1).withColumn(
        "start", F.coalesce(F.sum(F.col("length") * F.col("copies")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )


def shape(*replicas: DataFrame, fan: int = 16) -> tuple[int, int]:
    """Levels above the leaves inside files, and levels over the files, that hold all the replicas."""
    tops = [r.agg(F.max("seq"), F.max("file")).first() for r in replicas]

    def levels(largest: int) -> int:
        n = 0
        while largest > 0:
            largest, n = largest // fan, n + 1
        return n

    return levels(max(t[0] or 0 for t in tops)), levels(max(t[1] or 0 for t in tops))


def merkle_tree(index: DataFrame, inside: int, over: int, fan: int = 16) -> list[DataFrame]:
    """The levels of a replica's tree, leaves first: file, idx, start, end, hash and, of leaves, the record's columns."""
    end = F.col("start") + F.col("length") * F.col("copies")
    leaf = F.sha2(F.concat_ws("|", "start", "length", "copies", "digest"), 256)
    levels = [stored(index.select("file", F.col("seq").alias("idx"), "start", end.alias("end"), leaf.alias("hash"), "page_id", "record_id"), "merkle")]
    for n in range(inside + over):
        file, idx = (F.col("file"), F.floor(F.col("idx") / fan)) if n < inside else (F.floor(F.col("file") / fan), F.lit(0).cast("long"))
        child = F.struct("file", "idx", "hash", "start", "end")
        grouped = levels[-1].select(file.alias("file"), idx.alias("idx"), child.alias("child")).groupBy(*KEYS).agg(F.array_sort(F.collect_list("child")).alias("c"))
        joined = F.array_join(F.transform("c", lambda x: F.concat_ws(":", x["file"], x["idx"], x["hash"])), "|")
        levels.append(stored(grouped.select(*KEYS, F.array_min(F.col("c.start")).alias("start"), F.array_max(F.col("c.end")).alias("end"), F.sha2(joined, 256).alias("hash")), "merkle"))
    return levels


def audit(first: DataFrame, second: DataFrame, fan: int = 16, nodes_read: list[int] | None = None) -> DataFrame:
    """page_id, record_id, file, seq, start, end and status of each record that differs between two replicas.

    nodes_read: a list that takes the number of nodes of the first replica compared on each level, from the root down.
    """
    inside, over = shape(first, second, fan=fan)
    a, b = merkle_tree(first, inside, over, fan), merkle_tree(second, inside, over, fan)
    branches = None  # at the root: all
    for level in range(inside + over, -1, -1):
        x, y = (t[level] if branches is None else t[level].join(branches, KEYS, "left_semi") for t in (a, b))
        if nodes_read is not None:
            nodes_read.append(x.count())
        found = _compare(x, y)
        if level == 0:
            return found.select("page_id", "record_id", "file", F.col("idx").alias("seq"), "start", "end", "status")
        many = F.explode(F.sequence(F.lit(0), F.lit(fan - 1)))
        if level > inside:
            branches = found.select("*", many.alias("n")).select((F.col("file") * fan + F.col("n")).alias("file"), "idx")
        else:
            branches = found.select("*", many.alias("n")).select("file", (F.col("idx") * fan + F.col("n")).alias("idx"))
        branches = stored(branches, "branches")


def _compare(x: DataFrame, y: DataFrame) -> DataFrame:
    """Nodes of x and y whose hashes differ, with the columns of x where it has the node."""
    names = [c for c in x.columns if c not in KEYS]
    joined = x.join(y.select(*KEYS, *(F.col(c).alias(f"other_{c}") for c in names)), KEYS, "full")
    status = F.when(F.col("other_hash").isNull(), "missing").when(F.col("hash").isNull(), "extra").otherwise("altered")
    changed = joined.where(~F.col("hash").eqNullSafe(F.col("other_hash")))
    return changed.select(*KEYS, *(F.when(F.col("hash").isNull(), F.col(f"other_{c}")).otherwise(F.col(c)).alias(c) for c in names), status.alias("status"))
