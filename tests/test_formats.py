"""Readers and writers on small files of their formats."""

import random

import pytest
from strandlake.sources import readers, writers
from strandlake.streaming import landscape


def test_read_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b"junk\n>s1 first one\r\nacgu\r\nAC GT\r\n>\nTT\n>s3\n\n")
    (tmp_path / "b.fa").write_text("ACGT\nnnn\n")
    got = {r["seq_id"]: (r["description"], r["seq"]) for r in readers.read_fasta(spark, str(tmp_path)).collect()}
    assert got == {"s1": ("first one", "ACGTACGT"), "record": ("", "TT"), "s3": ("", ""), "input_sequence": ("", "ACGTNNN")}
    protein = readers.read_fasta(spark, str(tmp_path / "a.fa"), "protein").where("seq_id = 's1'").first()
    assert protein["seq"] == "ACGUACGT"


def test_read_repeat_table(spark, tmp_path):
    text = """   SW   perc perc perc  query     position in query    matching  repeat   position in repeat
score   div. del. ins.  sequence  begin end   (left)   repeat  class/family  begin end (left) ID

  463   1.3  0.6  1.7  chr1  10001 10468 (249) + L1MA LINE/L1 1 463 (100) 1
  239  29.4  1.9  1.0  chr1  20000 20400 (99) C MIR SINE/MIR (20) 200 41 7
  bad  1 2 3
  100  x    0.0  0.0  chr1  1 2 (3) + A B 1 2 (0) 9
"""
    (tmp_path / "x.out").write_text(text)
    rows = readers.read_repeat_table(spark, str(tmp_path / "x.out")).orderBy("q_start").collect()
    assert [(r["q_start"], r["strand"], r["cons_start"], r["cons_end"], r["cons_length"], r["cons_coverage_pct"]) for r in rows] == [(10000, "+", 1, 463, 563, 82.2), (19999, "-", 41, 200, 220, 72.7)]


def test_read_sam_splice(spark, tmp_path):
    rows = ["@HD", "q1\t4\tr\t1\t0\t10M", "q1\t16\tr\t101\t60\t5S10M2D8M100N20M1I5M", "q1\t0\tr\t900\t60\t9M", "q2\t256\tr\t1\t0\t5M"]
    (tmp_path / "a.sam").write_text("\n".join(rows))
    got = [tuple(r) for r in readers.read_sam_splice(spark, str(tmp_path / "a.sam")).orderBy("start").collect()]
    assert got == [("q1", "r", "-", "exon", 100, 120), ("q1", "r", "-", "intron", 120, 220), ("q1", "r", "-", "exon", 220, 245)]


def test_read_ispcr(spark, tmp_path):
    (tmp_path / "p.fa").write_text(">chr1:900-101 pair 800bp AC GT\nacgt\n>chr2:5+90 revonly 86bp TT TT\njunk\n>nope\n")
    got = [tuple(r) for r in readers.read_ispcr(spark, str(tmp_path / "p.fa")).collect()]
    assert got == [("chr1", 100, 900, "-", "pair", 800, False), ("chr2", 4, 90, "+", "revonly", 86, True)]


def test_assembly_maps_and_regions(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"assemblyAccession": "A.1",\n "molecules": [{"chrName": "1", "ucscStyleName": "", "refseqAccession": "N1", "length": 9}]}')
    assert [tuple(r) for r in readers.read_assembly_maps(spark, str(tmp_path / "m.json")).collect()] == [("A.1", "1", "", "N1", 9)]
    req = spark.createDataFrame([(1, "chr13:7,020,301-7,031,944; X:5..9\n2:0-4;\n3:9-4\nwhat"), (2, None)], "request_id int, text string")
    got = [(r["chrom"], r["start"], r["end"], r["reason"]) for r in readers.parse_regions(req).orderBy("n").collect()]
    assert got == [("13", 7020300, 7031944, None), ("X", 4, 9, None), (None, None, None, "start before 1"), (None, None, None, "start after end"), (None, None, None, "malformed")]


def test_writers(spark, tmp_path):
    f = spark.createDataFrame([("s", "gene", 10, 20, "+", 1500.4, "g;1", None, "a%b")], "seq_id string, kind string, start int, end int, strand string, score double, id string, parent string, name string")
    assert writers.gff3_lines(f).first()[0] == "s\tstrandlake\tgene\t11\t20\t1500.4\t+\t.\tID=g%3B1;Name=a%25b"
    assert tuple(writers.bed_rows(f).first()) == ("s", 10, 20, "a%b", 1000, "+")
    loci = spark.createDataFrame([("s", "chr1", 100, "+"), ("t", "chr1", 5, "-")], "seq_id string, chrom string, offset int, locus_strand string")
    good, refused = writers.anchor_to_genome(f.union(f.withColumn("seq_id", writers.F.lit("t"))), loci)
    assert [(r["seq_id"], r["start"], r["end"]) for r in good.collect()] == [("chr1", 110, 120)] and refused.count() == 1
    seqs = spark.createDataFrame([("s", "", "A" * 121)], "seq_id string, description string, seq string")
    assert writers.fasta_records(seqs).first()[0] == ">s\n" + "A" * 60 + "\n" + "A" * 60 + "\nA"
    writers.write_fasta(seqs, str(tmp_path / "out"))
    assert readers.read_fasta(spark, str(tmp_path / "out")).first()["seq"] == "A" * 121
    writers.write_manifest(f, str(tmp_path / "m"))
    writers.write_table(f, str(tmp_path / "t"))
    writers.write_bed(f, str(tmp_path / "b"))
    writers.write_gff3(f, str(tmp_path / "g"))


def test_incremental_landscape(spark, tmp_path):
    incoming, folder = tmp_path / "in", tmp_path / "run"
    incoming.mkdir()
    (incoming / "u1.out").write_text("head\n1 2 3\n")
    run = lambda s: landscape.incremental_landscape(spark, str(incoming), str(folder), s).awaitTermination()
    run({"library": "a"})
    (incoming / "u2.out").write_text("4 5 6\n7 8 9\n")
    run({"library": "a"})
    assert spark.read.parquet(str(folder / "hits")).count() == 3
    with pytest.raises(ValueError):
        run({"library": "b"})


def test_fasta_chunks_of_any_line_end_and_block(spark, tmp_path):
    rng = random.Random(5)
    old = {c: spark.conf.get(c) for c in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for end in ("\n", "\r\n", "\r"):
            folder = tmp_path / end.encode().hex()
            folder.mkdir()
            seqs = {f"r{i}": "".join(rng.choice("ACGTu n") for _ in range(n)) for i, n in enumerate((0, 5, 60, 61, 5000, 300))}
            text = "dropped" + end + "".join(f">{k} of {n}{end}" + end.join(s[i : i + 60] for i in range(0, len(s), 60)) + end for n, (k, s) in enumerate(seqs.items()))
            (folder / "a.fa").write_bytes(text.encode())
            (folder / "bare.fa").write_bytes(f"ac{end}gt{end}".encode())
            want = {k: s.upper().replace(" ", "").replace("U", "T") for k, s in seqs.items()} | {"input_sequence": "ACGT"}
            for size in ("128m", "500"):  # one block a file, and many
                spark.conf.set("spark.sql.files.maxPartitionBytes", size)
                spark.conf.set("spark.sql.files.openCostInBytes", "1")
                assert {r["seq_id"]: r["seq"] for r in readers.read_fasta(spark, str(folder)).collect()} == want
                chunks = readers.read_fasta_chunks(spark, str(folder), 300, 40).collect()
                assert sorted((r["seq_id"], r["chunk_no"], r["start0"], r["bases"]) for r in chunks) == sorted((k, i, i * 300, s[i * 300 : i * 300 + 340]) for k, s in want.items() if s for i in range(max(0, len(s) - 41) // 300 + 1))
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
