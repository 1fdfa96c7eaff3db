"""Queries of the sequence and PCR operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.derive import derive, duck
from ..functions.tables import spread, stored
from ..operators import pcr, profile


def seqs(spark, d):
    return derive(spark, d, "seqs", "doc_id")


def raw(spark, d):
    """Records as they are: the text without white space."""
    return profile.bare(derive(spark, d, "documents", "doc_id"))


def s2_chunk_contigs(spark, d):
    return profile.chunk_contigs(seqs(spark, d), 500, 12).select("seq_id", "chunk_no", "start0", F.md5("bases").alias("bases"))


def o1_composition(spark, d):
    return profile.composition(raw(spark, d))


def o2_gc_windows(spark, d):
    return profile.gc_windows(profile.chunk_contigs(seqs(spark, d), 100, 0), 100)


def o3_invalid_positions(spark, d):
    return profile.invalid_positions(raw(spark, d))


def o4_nucleotide_gate(spark, d):
    """Records through both gates, and the derived sequences through that for DNA."""
    return profile.nucleotide_gates(raw(spark, d), {"protein": "protein", "dna": "dna"}).unionByName(profile.nucleotide_gates(seqs(spark, d), {"derived": "dna"}))


def o5_orf_table(spark, d):
    return profile.orf_table(seqs(spark, d))


def o6_longest_orfs(spark, d):
    return profile.longest_orfs(profile.orf_table(seqs(spark, d), 20)).select("seq_id", "orf_idx", "strand", "frame", "start", "length_aa", "unscanned")


def o7_codon_usage(spark, d):
    s = seqs(spark, d)
    return profile.codon_usage(profile.orf_table(s), s)


def o8_low_complexity_flag(spark, d):
    chunks = profile.chunk_contigs(seqs(spark, d), 60, 0)
    return profile.low_complexity_flag(chunks.select(F.concat_ws("-", "seq_id", "chunk_no").alias("span_id"), "bases"))


def o9_kmer_index(spark, d):
    return profile.kmer_counts(seqs(spark, d), 7)


def o10_duplicate_inputs(spark, d):
    return profile.duplicate_inputs(seqs(spark, d))


def sites(spark, d):
    return pcr.primer_sites(derive(spark, d, "primers"), seqs(spark, d))


def o67_primer_sites(spark, d):
    return sites(spark, d)


def products(spark, d):
    return pcr.amplicons(sites(spark, d))


def o69_amplicons(spark, d):
    return products(spark, d)


def o68_anneal_extension(spark, d):
    return pcr.anneal_extension(sites(spark, d))


def _spanned(spark, d):
    """Products against a span of each pair and template: from the first start, as long as the passage."""
    amps = stored(products(spark, d), "products")  # read twice below
    first = amps.groupBy("pair_id", "source").agg(F.min("start").alias("start"))
    spans = first.join(derive(spark, d, "primers").select("pair_id", "target"), "pair_id").select("pair_id", "source", "start", (F.col("start") + F.col("target")).alias("end"))
    return pcr.on_target_by_span(amps, spans)


def o69_on_target_by_span(spark, d):
    return _spanned(spark, d).select("pair_id", "source", "start", "end", "fwd_primer", "rev_primer", "on_target", "place")


def o70_site_caps(spark, d):
    return pcr.site_caps(sites(spark, d), 1)


def o72_sequence_counts(spark, d):
    return pcr.sequence_counts(_spanned(spark, d))


def o70_cap_flags(spark, d):
    return pcr.cap_flags(products(spark, d), 1)


def _on_target(spark, d):
    amps = stored(products(spark, d), "products")  # read twice below
    loci = amps.where(~F.col("single_primer")).groupBy("pair_id").agg(F.min("source").alias("source")).select("pair_id", "source", F.lit(0).cast("long").alias("start"), F.lit(5000).cast("long").alias("end"))
    return pcr.genome_on_target(amps, loci)


def o71_genome_on_target(spark, d):
    return _on_target(spark, d).select("pair_id", "source", "start", "end", "single_primer", "on_target")


def o72_specificity_summary(spark, d):
    return pcr.specificity_summary(_on_target(spark, d), derive(spark, d, "primers"), True)


def o73_query_expansion(spark, d):
    return pcr.query_expansion(derive(spark, d, "primers"))


def o74_gel_bands(spark, d):
    return pcr.gel_bands(_on_target(spark, d), True)


def o75_oligo_descriptors(spark, d):
    p = derive(spark, d, "primers")
    return pcr.oligo_descriptors(p.select(F.concat(F.col("pair_id").cast("string"), F.lit("F")).alias("oligo_id"), F.col("fwd").alias("seq")).union(p.select(F.concat(F.col("pair_id").cast("string"), F.lit("R")), "rev")))


def o76_oligo_qc_triage(spark, d):
    e = derive(spark, d, "events").select(F.col("event_id").alias("k"), (F.col("event_id") / 3).cast("long").alias("pair_id"), F.element_at(F.array(F.lit("hairpin"), F.lit("dimer"), F.lit("end")), (F.col("event_id") % 3 + 1).cast("int")).alias("metric"), (-F.col("value") / 10).alias("dg"))
    return pcr.oligo_qc_triage(e.where("k % 5 > 0"), e.where("k % 7 > 0").withColumn("dg", F.col("dg") - F.col("k") % 4))


def o77_assay_primer_normalise(spark, d):
    p = derive(spark, d, "primers").select(F.col("pair_id").alias("primer_id"), F.concat(F.substring("fwd", 1, 5), F.when(F.col("pair_id") % 3 == 0, "(T/C)").when(F.col("pair_id") % 3 == 1, "(AX)").otherwise("N"), F.substring("fwd", 6, 15)).alias("text"))
    return pcr.assay_primer_normalise(p)


_RAW = "raw AS (SELECT doc_id AS seq_id, translate(regexp_replace(text, '\\s', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS seq FROM documents)"
_CNT = "(length({s}) - length(translate({s}, '{c}', '')))"
_CODONS = """pc AS (SELECT seq_id, n, a, substr(seq, a + 1, 1002) AS b FROM (SELECT seq_id, seq, length(seq) AS n, unnest(range(0, length(seq), 1000)) AS a FROM seqs)),
    tri AS (SELECT seq_id, n, a + i AS p, substr(b, i + 1, 3) AS w FROM (SELECT *, unnest(range(0, length(b) - 2)) AS i FROM pc)),
    cod AS (SELECT seq_id, '+' AS strand, n, p, p % 3 + 1 AS frame, w AS codon FROM tri UNION ALL SELECT seq_id, '-', n, n - 3 - p, (n - 3 - p) % 3 + 1, reverse(translate(w, 'ACGT', 'TGCA')) FROM tri),
    seg AS (SELECT *, codon IN ('TAA', 'TAG', 'TGA') AS stop, sum(CAST(codon IN ('TAA', 'TAG', 'TGA') AS INT)) OVER (PARTITION BY seq_id, strand, frame ORDER BY p ROWS UNBOUNDED PRECEDING) - CAST(codon IN ('TAA', 'TAG', 'TGA') AS INT) AS g FROM cod),
    f AS (SELECT seq_id, strand, frame, n, g, min(p) FILTER (WHERE codon = 'ATG') AS s, max(p) + 3 AS e, max(CAST(stop AS INT)) AS closed FROM seg GROUP BY seq_id, strand, frame, n, g),
    orf AS (SELECT seq_id, strand, CAST(frame AS INT) AS frame, CAST(CASE WHEN strand = '+' THEN s ELSE n - e END AS INT) AS start, CAST(CASE WHEN strand = '+' THEN e ELSE n - s END AS INT) AS "end", CAST(e - s AS INT) AS length_nt, CAST((e - s) // 3 - closed AS INT) AS length_aa, closed = 0 AS open_end FROM f WHERE s IS NOT NULL)"""
_SITES = """each AS (SELECT pair_id, 'F' AS primer, fwd AS p FROM primers UNION ALL SELECT pair_id, 'R', rev FROM primers),
    o AS (SELECT pair_id, primer, '+' AS orientation, p AS w FROM each UNION ALL SELECT pair_id, primer, '-', reverse(translate(p, 'ACGT', 'TGCA')) FROM each),
    pc AS (SELECT seq_id, a, substr(seq, a + 1, 1004) AS b FROM (SELECT *, unnest(range(0, length(seq), 1000)) AS a FROM seqs)),
    pos AS (SELECT seq_id, a + i AS q, substr(b, i + 1, 5) AS seed FROM (SELECT *, unnest(range(0, length(b) - 4)) AS i FROM pc)),
    j AS (SELECT o.*, pos.seq_id, seq, length(seq) AS m, CASE WHEN orientation = '+' THEN q + 5 - 20 ELSE q END AS l FROM pos JOIN seqs ON seqs.seq_id = pos.seq_id JOIN o ON seed = CASE WHEN orientation = '+' THEN substr(w, 16, 5) ELSE substr(w, 1, 5) END),
    lo AS (SELECT *, greatest(0, l) AS a, least(m, l + 20) AS b FROM j WHERE least(m, l + 20) - greatest(0, l) >= 18),
    t AS (SELECT pair_id, primer, seq_id, orientation, l, b - a AS fit, CASE WHEN orientation = '+' THEN reverse(substr(w, a - l + 1, b - a)) ELSE substr(w, a - l + 1, b - a) END AS x, CASE WHEN orientation = '+' THEN reverse(substr(seq, a + 1, b - a)) ELSE substr(seq, a + 1, b - a) END AS y FROM lo),
    h AS (SELECT *, hamming(substr(x, 1, 18), substr(y, 1, 18)) AS m18, hamming(substr(x, 1, least(fit, 19)), substr(y, 1, least(fit, 19))) AS m19, hamming(x, y) AS m20 FROM t),
    k AS (SELECT *, CASE WHEN m20 <= 2 THEN fit WHEN m19 <= 2 THEN least(fit, 19) ELSE 18 END AS anneal_len FROM h WHERE m18 <= 2),
    z AS (SELECT *, CASE anneal_len WHEN 18 THEN m18 WHEN 19 THEN m19 ELSE m20 END AS mm, max(anneal_len) OVER (PARTITION BY pair_id, primer, seq_id, orientation) AS best FROM k),
    site AS (SELECT pair_id, primer, seq_id, orientation, CASE WHEN orientation = '+' THEN l + 20 - anneal_len ELSE l END AS at, CASE WHEN orientation = '+' THEN l + 20 ELSE l + anneal_len END AS "end", CAST(mm AS INT) AS mm, CAST(anneal_len AS INT) AS anneal_len, CAST(20 - anneal_len AS INT) AS tail5 FROM z WHERE anneal_len = best)"""
_AMPS = _SITES + """, amp AS (SELECT f.pair_id, f.seq_id AS source, f.at AS start, r."end", r."end" - f.at AS length, r."end" - f.at + f.tail5 + r.tail5 AS product_length, f.primer AS fwd_primer, r.primer AS rev_primer, f.mm AS fwd_mm, r.mm AS rev_mm, f.primer = r.primer AS single_primer
    FROM site f JOIN site r ON f.pair_id = r.pair_id AND f.seq_id = r.seq_id AND f.orientation = '+' AND r.orientation = '-' WHERE r."end" > f.at AND r."end" - f.at + f.tail5 + r.tail5 BETWEEN 70 AND 1000)"""
_SPAN = """sp AS (SELECT pair_id, source, min(start) AS s FROM amp GROUP BY ALL), spanned AS (SELECT amp.*, coalesce(NOT single_primer AND amp.start >= sp.s - 5 AND amp."end" <= sp.s + primers.target + 5, false) AS on_target FROM amp JOIN sp ON sp.pair_id = amp.pair_id AND sp.source = amp.source JOIN primers ON primers.pair_id = amp.pair_id)"""
_ON = _AMPS + """, loc AS (SELECT pair_id, min(source) AS s FROM amp WHERE NOT single_primer GROUP BY pair_id),
    near AS (SELECT amp.*, row_number() OVER (PARTITION BY amp.pair_id ORDER BY least("end", 5000) - greatest(start, 0) DESC, start, "end") AS rn FROM amp JOIN loc ON amp.pair_id = loc.pair_id AND source = s WHERE NOT single_primer AND start < 5000),
    tgt AS (SELECT amp.*, EXISTS (SELECT 1 FROM near n WHERE rn = 1 AND n.pair_id = amp.pair_id AND n.source = amp.source AND n.start = amp.start AND n."end" = amp."end" AND n.fwd_primer = amp.fwd_primer AND n.rev_primer = amp.rev_primer) AS on_target FROM amp)"""
_TIER = "CASE metric WHEN 'hairpin' THEN CASE WHEN {0} <= -9 THEN 2 WHEN {0} <= -2 THEN 1 ELSE 0 END WHEN 'dimer' THEN CASE WHEN {0} <= -9 THEN 2 WHEN {0} <= -5 THEN 1 ELSE 0 END ELSE CASE WHEN {0} <= -9 THEN 2 WHEN {0} <= -6 THEN 1 ELSE 0 END END"


def _count(chars, s="seq"):
    return _CNT.format(s=s, c=chars)


ORACLES = {
    "s2_chunk_contigs": duck("SELECT seq_id, CAST(a // 500 AS INT) AS chunk_no, a AS start0, md5(substr(seq, a + 1, 512)) AS bases FROM (SELECT *, unnest(range(0, greatest(0, length(seq) - 13) + 1, 500)) AS a FROM seqs WHERE length(seq) > 0)", "seqs"),
    "o1_composition": f"""WITH {_RAW}, c AS (SELECT seq_id, length(seq) AS length, {", ".join(f"{_count(b)} AS {b.lower()}" for b in "ACGTN")}, {_count("RYSWKMBDHV")} AS ambiguous FROM raw)
        SELECT *, CASE WHEN a + c + g + t > 0 THEN 100 * (g + c) / (a + c + g + t) ELSE 0 END AS gc_pct, CASE WHEN length > 0 THEN 100 * n / length ELSE 0 END AS n_pct, CASE WHEN length > 0 THEN 100 * ambiguous / length ELSE 0 END AS ambiguous_pct FROM c""",
    "o2_gc_windows": duck(f"""WITH w AS (SELECT seq_id, CAST(a // 100 AS INT) AS bin, substr(seq, a + 1, 100) AS x FROM (SELECT *, unnest(range(0, length(seq), 100)) AS a FROM seqs WHERE length(seq) > 0)) SELECT seq_id, bin, {_count("GC", "x")} AS gc, {_count("ACGT", "x")} AS acgt FROM w""", "seqs"),
    "o3_invalid_positions": f"""WITH {_RAW}, c AS (SELECT seq_id, unnest(string_split(seq, '')) AS char, generate_subscripts(string_split(seq, ''), 1) - 1 AS pos FROM raw), r AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY pos) AS rn FROM c WHERE NOT contains('ACGTURYSWKMBDHVN', char))
        SELECT seq_id, CAST(pos AS INT) AS pos, char FROM r WHERE rn <= 50""",
    "o4_nucleotide_gate": duck(f"""WITH {_RAW}, r AS (SELECT seq_id, length(seq) AS n, CASE WHEN length(seq) > 0 THEN {_count("ACGTUN")} / length(seq) ELSE 0 END AS dna, CASE WHEN length(seq) > 0 THEN {_count("ACDEFGHIKLMNPQRSTVWYBJOUXZ*")} / length(seq) ELSE 0 END AS ratio FROM raw),
        q AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN dna > 0.9 THEN 'looks like nucleotides' WHEN ratio < 0.9 THEN 'not amino acids' END AS reason FROM r), v AS (SELECT 'dna' AS gate, seq_id, n, dna FROM r UNION ALL SELECT 'derived', seq_id, length(seq), CASE WHEN length(seq) > 0 THEN {_count("ACGTUN")} / length(seq) ELSE 0 END FROM seqs),
        u AS (SELECT *, CASE WHEN n = 0 THEN 'empty' WHEN dna < 0.5 THEN 'not nucleotides' END AS reason FROM v) SELECT 'protein' AS gate, seq_id, ratio, reason IS NULL AS ok, reason FROM q UNION ALL SELECT gate, seq_id, dna, reason IS NULL, reason FROM u""", "seqs"),
    "o5_orf_table": duck(f"WITH {_CODONS} SELECT * FROM orf WHERE length_aa >= 40", "seqs"),
    "o6_longest_orfs": duck(f"""WITH {_CODONS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY seq_id ORDER BY length_aa DESC, strand, frame, start) - 1 AS INT) AS orf_idx, CAST(greatest(0, count(*) OVER (PARTITION BY seq_id) - 12) AS INT) AS unscanned FROM orf WHERE length_aa >= 20)
        SELECT seq_id, orf_idx, strand, frame, start, length_aa, unscanned FROM r WHERE orf_idx < 12""", "seqs"),
    "o7_codon_usage": duck(f"""WITH {_CODONS}, x AS (SELECT CASE WHEN strand = '-' THEN reverse(translate(substr(seq, start + 1, length_nt), 'ACGT', 'TGCA')) ELSE substr(seq, start + 1, length_nt) END AS s, length_nt FROM orf JOIN seqs USING (seq_id) WHERE length_aa >= 40),
        y AS (SELECT substr(s, i * 3 + 1, 3) AS codon FROM (SELECT s, unnest(range(0, length_nt // 3)) AS i FROM x)) SELECT codon, substr('{profile.CODE}', 16 * (strpos('TCAG', codon[1]) - 1) + 4 * (strpos('TCAG', codon[2]) - 1) + strpos('TCAG', codon[3]), 1) AS aa, count(*) AS cnt FROM y GROUP BY ALL""", "seqs"),
    "o8_low_complexity_flag": duck(f"""WITH w AS (SELECT seq_id || '-' || (a // 60) AS span_id, substr(seq, a + 1, 60) AS x FROM (SELECT *, unnest(range(0, length(seq), 60)) AS a FROM seqs WHERE length(seq) > 0)),
        c AS (SELECT span_id, CAST(length(x) AS INT) AS n, greatest({", ".join(_count(b, "x") for b in "ACGT")}) / length(x) AS max_base_frac, CAST(len(list_distinct(list_transform(range(1, length(x) - 2), lambda i: substr(x, i, 4)))) AS INT) AS distinct_4mers FROM w)
        SELECT *, n < 8 OR max_base_frac > 0.7 OR distinct_4mers < greatest(4, 0.05 * (n - 3)) AS simple FROM c""", "seqs"),
    "o9_kmer_index": duck("WITH pc AS (SELECT seq_id, a, substr(seq, a + 1, 1006) AS b FROM (SELECT *, unnest(range(0, length(seq), 1000)) AS a FROM seqs)) SELECT substr(b, i + 1, 7) AS kmer, count(*) AS n, CAST(min(a + i) AS INT) AS first_pos, count(DISTINCT seq_id) AS records FROM (SELECT *, unnest(range(0, length(b) - 6)) AS i FROM pc) GROUP BY 1", "seqs"),
    "o10_duplicate_inputs": duck("SELECT sha256(seq) AS sha256, count(*) AS n, min(seq_id) AS first_id FROM seqs GROUP BY 1 HAVING count(*) > 1", "seqs"),
    "o67_primer_sites": duck(f"WITH {_SITES} SELECT * FROM site", "primers", "seqs"),
    "o68_anneal_extension": duck(f"WITH {_SITES} SELECT pair_id, primer, seq_id, orientation, max(anneal_len) AS anneal_len, min(tail5) AS tail5, count(*) AS n_sites, min(mm) AS min_mm FROM site GROUP BY ALL", "primers", "seqs"),
    "o70_site_caps": duck(f"WITH {_SITES} SELECT pair_id, primer, seq_id, orientation, count(*) AS n, count(*) > 1 AS truncated FROM site GROUP BY ALL", "primers", "seqs"),
    "o69_on_target_by_span": duck(f'WITH {_AMPS}, {_SPAN} SELECT pair_id, source, start, "end", fwd_primer, rev_primer, on_target, CAST(row_number() OVER (PARTITION BY pair_id, source ORDER BY NOT on_target, fwd_mm + rev_mm, single_primer, start, "end", fwd_primer, rev_primer) AS INT) AS place FROM spanned', "primers", "seqs"),
    "o72_sequence_counts": duck(f"""WITH {_AMPS}, {_SPAN}, c AS (SELECT pair_id, source, count(*) AS n, count(*) FILTER (WHERE NOT single_primer) AS n_pair, count(*) FILTER (WHERE single_primer) AS n_single, count(*) FILTER (WHERE on_target) AS n_on FROM spanned GROUP BY ALL)
        SELECT *, CAST(row_number() OVER (PARTITION BY pair_id ORDER BY n DESC, source) AS INT) AS place FROM c""", "primers", "seqs"),
    "o69_amplicons": duck(f"WITH {_AMPS} SELECT * FROM amp", "primers", "seqs"),
    "o70_cap_flags": duck(f"WITH {_AMPS} SELECT pair_id, source, count(*) AS n, count(*) > 1 AS truncated FROM amp GROUP BY ALL", "primers", "seqs"),
    "o71_genome_on_target": duck(f'WITH {_ON} SELECT pair_id, source, start, "end", single_primer, on_target FROM tgt', "primers", "seqs"),
    "o72_specificity_summary": duck(f"""WITH {_ON}, u AS (SELECT pair_id, length, count(*) AS m FROM tgt WHERE NOT single_primer GROUP BY ALL), v AS (SELECT pair_id, arg_max(length, (m, -length)) AS size_mode, max(m) AS size_mode_n, min(length) AS size_min, max(length) AS size_max FROM u GROUP BY pair_id),
        n AS (SELECT pair_id, count(*) AS n_total, count(*) FILTER (WHERE NOT single_primer) AS n_pair, count(*) FILTER (WHERE on_target) AS n_on, count(*) FILTER (WHERE single_primer) AS n_single, count(DISTINCT source) FILTER (WHERE NOT single_primer) AS n_sources FROM tgt GROUP BY pair_id),
        q AS (SELECT primers.pair_id, coalesce(n_total, 0) AS n_total, coalesce(n_pair, 0) AS n_pair, coalesce(n_on, 0) AS n_on, coalesce(n_single, 0) AS n_single, coalesce(n_sources, 0) AS n_sources, size_mode, size_mode_n, size_min, size_max, coalesce(n_pair - n_on, 0) AS n_off FROM primers LEFT JOIN n USING (pair_id) LEFT JOIN v USING (pair_id))
        SELECT *, CASE WHEN n_pair = 0 THEN 'none' WHEN n_on = 0 THEN 'off-target-only' WHEN n_off = 0 THEN 'specific' WHEN n_off <= 5 THEN 'low-off-target' ELSE 'family-generic' END AS tier FROM q""", "primers", "seqs"),
    "o73_query_expansion": duck('SELECT pair_id, \'pair\' AS name, fwd AS "left", rev AS "right" FROM primers UNION ALL SELECT pair_id, \'fwdonly\', fwd, fwd FROM primers UNION ALL SELECT pair_id, \'revonly\', rev, rev FROM primers', "primers"),
    "o74_gel_bands": duck(f"""WITH {_ON}, b AS (SELECT pair_id AS lane, product_length AS size, count(*) FILTER (WHERE on_target) AS n_on, count(*) FILTER (WHERE NOT on_target AND NOT single_primer) AS n_off, count(*) FILTER (WHERE single_primer) AS n_single, min(fwd_mm + rev_mm) AS min_mm FROM tgt GROUP BY ALL)
        SELECT *, CASE WHEN n_off > 0 THEN 'off-target' WHEN n_single > 0 THEN 'single-primer' ELSE 'on-target' END AS call, greatest(0.4::DOUBLE, 1 - 0.22::DOUBLE * min_mm) AS intensity FROM b""", "primers", "seqs"),
    "o75_oligo_descriptors": duck(f"""WITH o AS (SELECT pair_id || 'F' AS oligo_id, fwd AS seq FROM primers UNION ALL SELECT pair_id || 'R', rev FROM primers)
        SELECT oligo_id, CAST(length(seq) AS INT) AS length, 100 * {_count("GC")} / length(seq) AS gc_pct, {_count("GC", "right(seq, 5)")} AS gc_clamp, CAST(list_max(list_transform(regexp_extract_all(seq, 'A+|C+|G+|T+'), lambda r: length(r))) AS INT) AS poly_x FROM o""", "primers"),
    "o76_oligo_qc_triage": f"""WITH e AS (SELECT event_id AS k, event_id // 3 AS pair_id, ['hairpin', 'dimer', 'end'][event_id % 3 + 1] AS metric, -value / 10 AS dg FROM events), a AS (SELECT * FROM e WHERE k % 5 > 0), b AS (SELECT pair_id, metric, dg - k % 4 AS dg FROM e WHERE k % 7 > 0),
        j AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.metric, b.metric) AS metric, a.dg AS x, b.dg AS y FROM a FULL JOIN b ON a.pair_id = b.pair_id AND a.metric = b.metric),
        f AS (SELECT pair_id, metric, CAST(greatest({_TIER.format("x")}, {_TIER.format("y")}) AS INT) AS flag, CASE WHEN x IS NULL OR y IS NULL THEN 'single' WHEN abs(x - y) <= 2 THEN 'agree' ELSE 'disagree' END AS agree FROM j) SELECT *, max(flag) OVER (PARTITION BY pair_id) AS worst FROM f""",
    "o77_assay_primer_normalise": duck("""SELECT pair_id AS primer_id, substr(fwd, 1, 5) || ['(T/C)', '(AX)', 'N'][pair_id % 3 + 1] || substr(fwd, 6, 15) AS text, CASE pair_id % 3 WHEN 0 THEN substr(fwd, 1, 5) || 'Y' || substr(fwd, 6, 15) WHEN 2 THEN substr(fwd, 1, 5) || 'N' || substr(fwd, 6, 15) END AS iupac,
        CASE WHEN pair_id % 3 = 1 THEN 'no code for a part' END AS error FROM primers""", "primers"),
}

QUERIES = {k: v for k, v in list(globals().items()) if k[:1] in "os" and k[1:2].isdigit()}
