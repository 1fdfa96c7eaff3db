"""Readers of features, hits, models and cases; cases resolved to features; element annotations and their landscape."""

import pytest
from pyspark.sql import functions as F
from strandlake.operators import cases, structure
from strandlake.sources import features, readers, writers
from strandlake.streaming import landscape

GENBANK = """LOCUS       X
FEATURES             Location/Qualifiers
     source          1..5000
                     /organism="Some
                     thing"
     mobile_element  complement(join(<10..400,
                     500..900))
                     /mobile_element_type="retrotransposon:Alpha
                     one"
                     /note="first"
     repeat_region   1000..2500
                     /rpt_family="Beta"
     LTR             3000..3100
ORIGIN
        1 acgt
     fake            1..2
"""


def test_feature_table(spark, tmp_path):
    rows = [">Feature x", "<1\t90\tgene", "\t\t\tgene\tabc", "\t\t\tgene\tlater", "200\t>150\tCDS", "120\t100", "\t\t\tproduct\tp q", "\t\t\tpseudo", "junk", ""]
    (tmp_path / "a.tbl").write_text("\n".join(rows))
    got = features.read_feature_table(spark, str(tmp_path / "a.tbl")).orderBy("feature").collect()
    assert [(r["kind"], [tuple(i) for i in r["intervals"]], r["qualifiers"]) for r in got] == [
        ("gene", [(0, 90, "+")], {"gene": "abc"}), ("CDS", [(149, 200, "-"), (99, 120, "-")], {"product": "p q", "pseudo": ""})
    ]


def test_flat_file_features_and_cases(spark, tmp_path):
    (tmp_path / "r1.gb").write_text(GENBANK)
    found = features.read_genbank_features(spark, str(tmp_path / "r1.gb"))
    got = [tuple(r) for r in found.select("kind", "start", "end", "strand", "name").orderBy("feature").collect()]
    assert got == [("source", 0, 5000, "+", ""), ("mobile_element", 9, 900, "-", "retrotransposon:alpha one first"), ("repeat_region", 999, 2500, "+", "beta"), ("LTR", 2999, 3100, "+", "")]
    at = found.withColumn("accession", F.lit("r1"))
    asked = [(1, "r1", "1,000..2,000", "x"), (2, "r1", "complement(join(5..9,20..30))", "x"), (3, "r1", "", "Alpha family"), (4, "r1", None, "gamma"), (5, "r1", None, "delta"), (6, "r2", None, "beta")]
    out = {r["case_id"]: tuple(r)[1:] for r in cases.match_features_to_cases(spark.createDataFrame(asked, "case_id int, accession string, coords string, expected_superfamily string"), at).collect()}
    assert out == {
        1: (999, 2000, None, "corpus span"), 2: (4, 30, "-", "corpus joined location"), 3: (9, 900, "-", "name match of 1 words"), 4: (999, 2500, "+", "by size, weak"),
        5: (None, None, None, "all features taken"), 6: (None, None, None, "no delimiting feature"),
    }


def test_domain_table(spark, tmp_path):
    line = lambda target, hmm, ev, a, b: f"{target} - 300 {hmm} PF1.1 100 1e-9 50.0 0.1 1 1 1e-9 {ev} 42.26 0.1 1 90 {a} {b} {a} {b} 0.9 text of it"
    (tmp_path / "d.txt").write_text("\n".join(["# head", line("orf0", "RVT_1", "1e-20", 11, 100), line("s|orf1", "rve", "1e-5", 2, 50), line("orf0", "What", "1e-4", 1, 9), line("orf0", "RVP", "0.5", 1, 9), line("orf7", "RVP", "1e-9", 1, 9)]))
    orfs = spark.createDataFrame([("s", 0, "+", 100, 700), ("s", 1, "-", 300, 900)], "seq_id string, orf_idx int, strand string, start int, end int")
    got = [tuple(r) for r in features.read_hmm_domtbl(spark, str(tmp_path / "d.txt"), orfs).select("domain", "class", "pfam", "score", "confidence", "start", "end").orderBy("start", "end").collect()]
    assert got == [("What", "other", "", 42.3, "moderate", 100, 127), ("RT", "retro", "PF00078", 42.3, "high", 130, 400), ("INT", "retro", "PF00665", 42.3, "moderate", 750, 897)]


def test_gene_models(spark, tmp_path):
    row = lambda kind, a, b, score, strand, attrs: f"s\tmp\t{kind}\t{a}\t{b}\t{score}\t{strand}\t.\t{attrs}"
    text = ["##gff-version 3", row("mRNA", 1, 30, 50, "+", "ID=M1;Rank=1;Identity=0.9;Positive=0.95;Target=p1 1 8"), row("CDS", 21, 30, 0, "+", "Parent=M1"), row("CDS", 1, 10, 0, "+", "Parent=M1"), row("mRNA", 1, 30, 60, "-", "ID=M2;Identity=0.5;StopCodon=2;Frameshift=1;Target=p2 2 4"), row("CDS", 1, 12, 0, "-", "Parent=M2"), row("CDS", 17, 30, 0, "-", "Parent=M2"), row("mRNA", 1, 5, 1, "+", "ID=M3;Target=p9 1 2"), "short"]
    (tmp_path / "g.gff").write_text("\n".join(text))
    seqs = spark.createDataFrame([("s", "ACGTACGTACGTACGTACAGACGTACGTACGT")], "seq_id string, seq string")
    proteins = spark.createDataFrame([("p1", 10), ("p2", 6)], "protein string, length int")
    got = features.read_spliced_gff3(spark, str(tmp_path / "g.gff"), proteins, seqs, max_hits=2).orderBy("rank_no").collect()
    assert [(r["id"], r["protein_coverage"], r["inframe_stops"], r["frameshifts"], [tuple(e) for e in r["exons"]]) for r in got] == [("M2", 0.5, 2, 1, [(16, 30), (0, 12)]), ("M1", 0.8, 0, 0, [(0, 10), (20, 30)])]
    assert [tuple(i) for r in got for i in r["introns"]] == [(12, 16, "AC", "GT", False), (10, 20, "GT", "AG", True)]


def test_cases(spark, tmp_path):
    head = "accession\tcoords\texpected_superfamily\trecord_scope\tpanel\n"
    (tmp_path / "c.tsv").write_text(head + "A1\t1..9\tx\telement\tp\nA2\t\ty\tcontaining_record\tp\n")
    (tmp_path / "res").mkdir()
    (tmp_path / "res" / "1.json").write_text('{"accession": "A1", "coords": "1..9",\n "expected_superfamily": "x", "call": "z"}')
    got = {r["accession"]: r["result"] and r["result"]["call"] for r in features.read_cases(spark, str(tmp_path / "c.tsv"), str(tmp_path / "res")).collect()}
    assert got == {"A1": "z", "A2": None}
    for n, (text, what) in enumerate(((head, "no rows"), (head + "A\t1\tx\tsome\tp\n", "scope"), (head + "A\t1\tx\telement\tp\nA\t1\tx\telement\tq\n", "unique"), (head + "\t1\tx\telement\tp\n", "accession"), ("accession\nA\n", "record_scope"))):
        (tmp_path / f"b{n}.tsv").write_text(text)
        with pytest.raises(ValueError, match=what):
            features.read_cases(spark, str(tmp_path / f"b{n}.tsv"))


def test_evidence_and_annotation_of_an_element(spark):
    import random

    rng = random.Random(3)
    some = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    polya = "AATAAA" + some(20).replace("A", "C") + "TGTTTGTGTTTTGTGTTGTTTGTGTTTTGTGTTGTTTTGT"
    ltr = "TG" + some(150) + polya + some(60) + "CA"
    body = "T" + "TGGCGCCCGAACAGGGAC" + some(900) + "AGGAAGAGGAGAAAG"
    seq = some(30) + "CATTC" + ltr + body + ltr + "CATTC" + some(40)
    s5 = 35
    bare = ltr + body + ltr
    seqs = spark.createDataFrame([("whole", seq), ("bare", bare), ("none", some(700))], "seq_id string, seq string")
    rows = {(r["seq_id"], r["kind"]): r for r in structure.structural_evidence(seqs).where("kind in ('LTR', 'TSD', 'PBS', 'PPT', 'polyA-signal')").collect()}
    assert (rows["whole", "LTR"]["start"], rows["whole", "LTR"]["end"], rows["whole", "LTR"]["identity"], rows["whole", "LTR"]["state"]) == (s5, s5 + 2 * len(ltr) + len(body), 100.0, "found")
    assert rows["bare", "LTR"]["state"] == structure.NO_RECORD and ("bare", "TSD") not in rows and not {k for k in rows if k[0] == "none"}
    assert (rows["whole", "TSD"]["length"], rows["whole", "TSD"]["detail"]) == (5, "CATTC")
    assert (rows["whole", "PBS"]["start"], rows["whole", "PBS"]["identity"]) == (s5 + len(ltr) + 1, 100.0) and rows["whole", "PBS"]["detail"].startswith("tRNA-Lys3 ")
    assert rows["whole", "PPT"]["end"] == s5 + len(ltr) + len(body) and rows["whole", "PPT"]["length"] >= 15
    assert rows["whole", "polyA-signal"]["detail"] == "AATAAA canonical found"
    spans = spark.createDataFrame([("whole", s5, s5 + len(ltr), s5 + len(ltr) + len(body), s5 + 2 * len(ltr) + len(body))], "seq_id string, s5 int, e5 int, s3 int, e3 int")
    motif = structure.termini_motif(spans, seqs).first()
    assert (motif["tier"], motif["mismatches"], motif["motif"]) == ("canonical", 0, "TGCA")
    signal = structure.polya_signal(spans, seqs).first()
    assert signal["confident"] and signal["in_both"] and signal["start"] == s5 + len(ltr) + len(body) + 152
    calls = spark.createDataFrame([("whole", "LTR/Gypsy", "LTR_retrotransposon")], "seq_id string, te_class string, so_term string")
    hits = spark.createDataFrame([("whole", 1, "RT", "+", 50.0, 500, 800), ("other", 2, "RT", "+", 1.0, 1, 2)], "seq_id string, hit_id int, domain string, strand string, score double, start int, end int")
    made = writers.annotation_features(calls, seqs.select("seq_id", F.length("seq").alias("length")), structure.structural_evidence(seqs), hits)
    lines = [r[0].split("\t") for r in writers.gff3_lines(made).collect()]
    assert lines[0][2:5] == ["LTR_retrotransposon", "1", str(len(seq))] and lines[0][8] == "ID=TE_whole;Name=LTR/Gypsy;Ontology_term=SO:0000186;wicker_code=LTR/Gypsy;te_class=LTR/Gypsy"
    kinds = sorted(x[2] for x in lines[1:])
    assert kinds.count("long_terminal_repeat") == 2 and kinds.count("target_site_duplication") == 2 and "polypeptide_domain" in kinds and all("Parent=TE_whole" in x[8] for x in lines[1:])


def test_subgenomic_architecture(spark):
    calls = spark.createDataFrame([("a", True), ("b", True), ("c", False), ("d", True)], "seq_id string, is_erv boolean")
    ltr = spark.createDataFrame([(s, 100, 900) for s in "abcd"], "seq_id string, low int, high int")
    rows = [("a", "GAG", "+", 150, 200), ("a", "RT", "+", 300, 500), ("a", "ENV", "+", 600, 950), ("b", "ENV", "-", 150, 250), ("b", "RT", "-", 300, 500), ("b", "GAG", "-", 550, 700), ("c", "ENV", "+", 600, 700), ("c", "RT", "+", 200, 300), ("d", "ENV", "+", 120, 200), ("d", "RT", "+", 300, 400)]
    hits = spark.createDataFrame(rows, "seq_id string, domain string, strand string, start int, end int")
    got = {r["seq_id"]: tuple(r)[1:] for r in structure.subgenomic_architecture(calls, ltr, hits).collect()}
    assert got == {"a": ("+", 100, 150, 150, 600, 600, 900), "b": ("-", 700, 900, 250, 700, 150, 250)}


def test_landscape_of_units(spark, tmp_path):
    incoming, folder = tmp_path / "in", str(tmp_path / "run")
    incoming.mkdir()
    hit = lambda div, q, a, b, fam: f"  463 {div} 0.6 1.7 {q} {a} {b} (9) + X {fam} 1 463 (0) 1\n"
    run = lambda: landscape.incremental_landscape(spark, str(incoming), folder, {"library": "a"}).awaitTermination()
    (incoming / "u1.out").write_text("head\n" + hit(10.0, "c1", 1, 100, "LINE/L1") + hit(20.0, "c1", 51, 150, "LINE/L1") + "  1 2 3\n")
    run()
    units = spark.createDataFrame([("u1.out",), ("u2.out",)], "unit string")
    assert tuple(landscape.progress(spark, folder, units).first()) == (2, 1, 1)
    with pytest.raises(ValueError, match="not finished"):
        landscape.landscape(spark, folder, units)
    (incoming / "u2.out").write_text(hit(30.0, "c2", 1, 50, "LINE/L1") + hit(5.0, "c2", 41, 50, "DNA/hAT"))
    run()
    got = {r["class_family"]: (r["n"], r["bp"], round(r["divergence"], 6), r["percent"]) for r in landscape.landscape(spark, folder, units).collect()}
    assert got == {"LINE/L1": (3, 200, 18.0, 100.0), "DNA/hAT": (1, 10, 5.0, 5.0)}


def test_first_alignment_is_that_of_the_first_file(spark, tmp_path):
    (tmp_path / "b.sam").write_text("q\t0\tr\t900\t60\t9M\n")
    (tmp_path / "a.sam").write_text("@HD\nq\t0\tr\t101\t60\t5M\n")
    assert [r["start"] for r in readers.read_sam_splice(spark, str(tmp_path)).collect()] == [100]
