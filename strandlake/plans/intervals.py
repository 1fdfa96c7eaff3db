"""Queries of the interval operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.derive import derive, duck
from ..operators import intervals as ops


def hits(spark, d):
    return derive(spark, d, "repeat_hits")


def o47_merge_fragments(spark, d):
    return ops.merge_fragments(hits(spark, d))


def o48_repeat_landscape(spark, d):
    return ops.repeat_landscape(hits(spark, d))


def o48_landscape_totals(spark, d):
    return ops.landscape_totals(hits(spark, d))


def o49_repeat_kind_totals(spark, d):
    return ops.repeat_kind_totals(ops.repeat_landscape(hits(spark, d)))


def o49_landscape_summary(spark, d):
    return ops.landscape_summary(hits(spark, d))


def o49_summary_without_elements(spark, d):
    return ops.landscape_summary(hits(spark, d).where(ops.kind_of(F.col("class_family")) != "te"))


def o50_landscape_composition(spark, d):
    h = hits(spark, d)
    return ops.landscape_composition(ops.repeat_landscape(h), ops.genome_length(h))


def o51_split_hits_by_kind(spark, d):
    return ops.split_hits_by_kind(hits(spark, d)).select("row_key", "row_no", "class_family", "bucket")


def exons(spark, d):
    return derive(spark, d, "exons").where("`end` > start")


def features(spark, d):
    kind = F.when(F.col("role") == "system", "mRNA").when(F.col("seq_id") % 2 == 0, F.lit("exon")).otherwise("CDS")
    return exons(spark, d).select("seq_id", "start", "end", kind.alias("kind"))


def o52_build_gene_model(spark, d):
    return ops.build_gene_model(features(spark, d))


def o53_complete_gene_model(spark, d):
    e = exons(spark, d)
    model = ops.build_gene_model(e.where("turn % 3 <> 1").select("seq_id", "start", "end", F.lit("exon").alias("kind")))
    return ops.complete_gene_model(model, e.where("turn % 3 = 1"))


def o54_cross_check_introns(spark, d):
    e = exons(spark, d)
    moved = F.when(F.col("turn") % 3 == 0, 0).when(F.col("turn") % 3 == 1, 2).otherwise(5)
    return ops.cross_check_introns(ops.introns(e), ops.introns(e.select("seq_id", (F.col("start") + moved).alias("start"), "end")))


def o55_flanks_and_gaps(spark, d):
    e = exons(spark, d)
    lengths = e.groupBy("seq_id").agg((F.max("end") + 10).alias("length"))
    return ops.flanks_and_gaps(e.where("turn > 0"), lengths)


def o56_extract_regions(spark, d):
    h = derive(spark, d, "orfs").select(F.col("orf_key").alias("region_id"), (F.col("seq_id")).alias("seq_id"), "start", "end", "strand")
    h = h.join(derive(spark, d, "seqs").select("seq_id", F.greatest(F.length("seq") - 400, F.lit(1)).alias("span")), "seq_id").withColumn("at", F.col("start") % F.col("span")).select("region_id", "seq_id", F.col("at").alias("start"), (F.col("at") + F.col("end") - F.col("start")).alias("end"), "strand")
    return ops.extract_regions(h, derive(spark, d, "seqs"), flank=25)


def o57_resolve_contig_names(spark, d):
    molecules = derive(spark, d, "supplier").select((F.col("s_nationkey") % 5).alias("assembly"), F.concat(F.lit("chr"), F.col("s_suppkey")).alias("chr_name"), F.lit("").alias("ucsc_name"), F.col("s_name").alias("accession"), F.lit(15000).cast("long").alias("length"))
    regions = hits(spark, d).select(F.concat_ws("-", "row_key", "row_no").alias("region_id"), (F.col("query") % 7).alias("assembly"), F.concat(F.when(F.col("row_no") % 2 == 0, "CHR").otherwise(""), F.col("query")).alias("chrom"), F.col("q_start").alias("start"), F.col("q_end").alias("end"))
    return ops.resolve_contig_names(regions, molecules).select("region_id", "assembly", "accession", "reason")


def o58_splice_motifs(spark, d):
    e = ops.introns(exons(spark, d)).withColumn("strand", F.when(F.col("seq_id") % 2 == 0, "+").otherwise("-"))
    return ops.splice_motifs(e, derive(spark, d, "seqs"))


def o60_nearest_library_coverage(spark, d):
    p = derive(spark, d, "part").select(F.col("p_brand").alias("lineage"), (F.col("p_size") > 25).alias("curated"))
    return ops.nearest_library_coverage(p)


_ISLANDS = """{name} AS (SELECT {keys}, min(s) AS s, max(e) AS e FROM (SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY s, e RANGE UNBOUNDED PRECEDING) AS island FROM
    (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM {source})) GROUP BY {keys}, island)"""
_PLACED = "placed AS (SELECT *, least(q_start, q_end) AS s, greatest(q_start, q_end) AS e FROM repeat_hits)"
_FAMILY = _ISLANDS.format(name="fam", keys="class_family, query", source="placed")
_KIND = "CASE WHEN regexp_matches(class_family, '^(LTR|LINE|SINE|DNA|RC|Retroposon)(/|$)') THEN 'te' WHEN regexp_matches(class_family, '^(Simple_repeat|Low_complexity|Satellite)(/|$)') THEN 'tandem' ELSE 'other' END"
_LANDSCAPE = f"""{_PLACED}, {_FAMILY}, g AS (SELECT CAST(sum(m) AS BIGINT) AS genome_bp FROM (SELECT max(q_end) AS m FROM repeat_hits GROUP BY query)),
b AS (SELECT class_family, CAST(sum(e - s) AS BIGINT) AS bp FROM fam GROUP BY class_family),
land AS (SELECT class_family, count(*) AS n, any_value(bp) AS bp, CAST(sum(divergence * (e - s)) AS BIGINT) / CAST(sum(e - s) AS BIGINT) AS divergence, 100 * any_value(bp) / any_value(genome_bp) AS percent
    FROM placed JOIN b USING (class_family), g GROUP BY class_family),
kinds AS (SELECT *, {_KIND} AS kind FROM land)"""
_GAPS = """{name} AS (SELECT * FROM (SELECT seq_id, "end" AS start, lead(start) OVER (PARTITION BY seq_id ORDER BY start, "end") AS "end" FROM {source}) WHERE "end" > start)"""
_EX = 'ex AS (SELECT * FROM exons WHERE "end" > start)'

ORACLES = {
    "o47_merge_fragments": duck("""SELECT query, fragment_id, family, strand, min(q_start) AS q_start, max(q_end) AS q_end, arg_max(score, (score, divergence, class_family)) AS score,
        arg_max(divergence, (score, divergence, class_family)) AS divergence, arg_max(class_family, (score, divergence, class_family)) AS class_family, CASE WHEN count(*) > 1 THEN round(least(100.0::DOUBLE, sum(coverage)), 1) ELSE max(coverage) END AS coverage, count(*) AS n_fragments
        FROM repeat_hits WHERE fragment_id IS NOT NULL GROUP BY ALL UNION ALL SELECT query, fragment_id, family, strand, q_start, q_end, score, divergence, class_family, coverage, 1 FROM repeat_hits WHERE fragment_id IS NULL""", "repeat_hits"),
    "o48_repeat_landscape": duck(f"WITH {_LANDSCAPE} SELECT * FROM land", "repeat_hits"),
    "o48_landscape_totals": duck(f"""WITH {_PLACED}, {_FAMILY}, {_ISLANDS.format(name="uni", keys="query", source="placed")}
        SELECT (SELECT count(*) FROM placed) AS total_hits, (SELECT CAST(sum(e - s) AS BIGINT) FROM fam) AS sum_family_bp, (SELECT CAST(sum(e - s) AS BIGINT) FROM uni) AS union_bp""", "repeat_hits"),
    "o49_repeat_kind_totals": duck(f"WITH {_LANDSCAPE} SELECT kind, CAST(sum(bp) AS BIGINT) AS bp, count(*) AS families, CAST(sum(n) AS BIGINT) AS n FROM kinds GROUP BY kind", "repeat_hits"),
    **{name: duck(f"""WITH hits AS (SELECT * FROM repeat_hits WHERE {which}), {_LANDSCAPE.replace("repeat_hits", "hits")}, {_ISLANDS.format(name="uni", keys="query", source="placed")}, u AS (SELECT CAST(sum(e - s) AS BIGINT) AS union_bp FROM uni),
        k AS (SELECT CAST(coalesce(sum(bp) FILTER (WHERE kind = 'te'), 0) AS BIGINT) AS te_bp, CAST(coalesce(sum(bp) FILTER (WHERE kind = 'tandem'), 0) AS BIGINT) AS tandem_bp, CAST(coalesce(sum(bp) FILTER (WHERE kind = 'other'), 0) AS BIGINT) AS other_bp, count(*) FILTER (WHERE kind = 'te') AS te_families FROM kinds)
        SELECT (SELECT count(*) FROM hits) AS total_hits, genome_bp, union_bp, round(100 * union_bp / genome_bp, 3) AS masked_percent, te_bp, round(100 * te_bp / genome_bp, 3) AS te_percent, tandem_bp, other_bp, te_families,
        CASE WHEN te_families = 0 THEN 'No family of transposable elements was found: a limit of what was searched, not a finding about the genome' END AS warning FROM g, u, k""", "repeat_hits") for name, which in (("o49_landscape_summary", "true"), ("o49_summary_without_elements", f"{_KIND} <> 'te'"))},
    "o50_landscape_composition": duck(f"""WITH {_LANDSCAPE}, parts AS (SELECT CASE WHEN kind = 'te' THEN split_part(class_family, '/', 1) ELSE kind END AS part, CAST(sum(bp) AS BIGINT) AS bp FROM kinds GROUP BY 1),
        every AS (SELECT * FROM parts UNION ALL SELECT 'unannotated', greatest(0, genome_bp - (SELECT CAST(sum(bp) AS BIGINT) FROM parts)) FROM g) SELECT part, bp, bp / genome_bp AS share FROM every, g""", "repeat_hits"),
    "o51_split_hits_by_kind": duck("""SELECT CASE WHEN class_family IN ('Unknown', 'Unspecified') THEN 'unclassed' WHEN class_family IN ('Low_complexity', 'Simple_repeat', 'Satellite') THEN 'non_te' ELSE 'te' END AS bucket, class_family, row_key, row_no FROM repeat_hits""", "repeat_hits"),
    "o52_build_gene_model": duck(f"""WITH {_EX}, f AS (SELECT seq_id, start, "end", CASE WHEN role = 'system' THEN 2 WHEN seq_id % 2 = 0 THEN 1 ELSE 3 END AS r FROM ex),
        e AS (SELECT DISTINCT f.seq_id, start, "end", m > 1 AS derived FROM f JOIN (SELECT seq_id, min(r) AS m FROM f GROUP BY seq_id) p ON f.seq_id = p.seq_id AND r = m), {_GAPS.format(name="i", source="e")}
        SELECT seq_id, start, "end", derived, 'exon' AS kind FROM e UNION ALL SELECT seq_id, start, "end", true, 'intron' FROM i""", "exons"),
    "o53_complete_gene_model": duck(f"""WITH {_EX}, e AS (SELECT DISTINCT seq_id, start, "end" FROM ex WHERE turn % 3 <> 1), {_GAPS.format(name="i", source="e")}, c AS (SELECT DISTINCT seq_id, start AS cs, "end" AS ce FROM ex WHERE turn % 3 = 1),
        o AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.seq_id = c.seq_id AND e.start <= cs AND e."end" >= ce)),
        n AS (SELECT o.seq_id, coalesce(max(CASE WHEN i."end" <= cs THEN i."end" END), cs) AS start, coalesce(min(CASE WHEN i.start >= ce THEN i.start END), ce) AS "end" FROM o LEFT JOIN i ON i.seq_id = o.seq_id GROUP BY o.seq_id, cs, ce),
        a AS (SELECT seq_id, start, "end", bool_and(derived) AS derived FROM (SELECT *, false AS derived FROM e UNION ALL SELECT *, true FROM n) GROUP BY ALL), {_GAPS.format(name="i2", source="a")}
        SELECT seq_id, start, "end", derived, 'exon' AS kind FROM a UNION ALL SELECT seq_id, start, "end", true, 'intron' FROM i2""", "exons"),
    "o54_cross_check_introns": duck(f"""WITH {_EX}, {_GAPS.format(name="x", source="ex")}, mv AS (SELECT seq_id, start + [0, 2, 5][1 + turn % 3] AS start, "end" FROM ex), {_GAPS.format(name="y", source="mv")}, a AS (SELECT DISTINCT * FROM x), b AS (SELECT DISTINCT * FROM y),
        p AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY a0, a1, b0, b1) AS i FROM (SELECT a.seq_id, a.start AS a0, a."end" AS a1, b.start AS b0, b."end" AS b1 FROM a JOIN b ON a.seq_id = b.seq_id AND abs(a.start - b.start) <= 2 AND abs(a."end" - b."end") <= 2)),
        m AS (SELECT seq_id, i, [[a0, a1]] AS ta, [[b0, b1]] AS tb FROM p WHERE i = 1 UNION ALL SELECT m.seq_id, p.i, CASE WHEN list_contains(ta, [a0, a1]) OR list_contains(tb, [b0, b1]) THEN ta ELSE list_append(ta, [a0, a1]) END, CASE WHEN list_contains(ta, [a0, a1]) OR list_contains(tb, [b0, b1]) THEN tb ELSE list_append(tb, [b0, b1]) END FROM m JOIN p ON p.seq_id = m.seq_id AND p.i = m.i + 1),
        f AS (SELECT seq_id, arg_max(len(ta), i) AS matched FROM m GROUP BY seq_id), na AS (SELECT seq_id, count(*) AS a_total FROM a GROUP BY seq_id), nb AS (SELECT seq_id, count(*) AS b_total FROM b GROUP BY seq_id)
        SELECT coalesce(na.seq_id, nb.seq_id) AS seq_id, coalesce(matched, 0) AS matched, coalesce(a_total, 0) AS a_total, coalesce(b_total, 0) AS b_total, coalesce(a_total, 0) - coalesce(matched, 0) AS a_only, coalesce(b_total, 0) - coalesce(matched, 0) AS b_only FROM na FULL JOIN nb ON na.seq_id = nb.seq_id LEFT JOIN f ON f.seq_id = coalesce(na.seq_id, nb.seq_id)""", "exons"),
    "o55_flanks_and_gaps": duck(f"""WITH {_EX}, len AS (SELECT seq_id, max("end") + 10 AS length FROM ex GROUP BY seq_id), p AS (SELECT seq_id, start AS s, "end" AS e FROM ex WHERE turn > 0), {_ISLANDS.format(name="u", keys="seq_id", source="p")},
        r AS (SELECT u.*, length, lag(e) OVER w AS l, lead(s) OVER w AS n FROM u JOIN len USING (seq_id) WINDOW w AS (PARTITION BY seq_id ORDER BY s))
        SELECT seq_id, coalesce(l, 0) AS start, s AS "end", CASE WHEN l IS NULL THEN 'flank5' ELSE 'hole' END AS kind FROM r WHERE s > coalesce(l, 0) UNION ALL SELECT seq_id, e, length, 'flank3' FROM r WHERE n IS NULL AND length > e""", "exons"),
    "o56_extract_regions": duck("""WITH r AS (SELECT orf_key AS region_id, seq_id, start % greatest(length(seq) - 400, 1) AS start, start % greatest(length(seq) - 400, 1) + "end" - start AS "end", strand FROM orfs JOIN seqs USING (seq_id)), j AS (SELECT r.*, seq, length(seq) AS n FROM r JOIN seqs USING (seq_id) WHERE start < "end" AND "end" <= length(seq)),
        k AS (SELECT *, greatest(0, start - 25) AS lo, least(n, "end" + 25) AS hi FROM j)
        SELECT region_id, seq_id, lo AS start, hi AS "end", strand, CASE WHEN strand = '-' THEN reverse(translate(substr(seq, lo + 1, hi - lo), 'ACGT', 'TGCA')) ELSE substr(seq, lo + 1, hi - lo) END AS bases, start < 25 OR "end" + 25 > n AS clipped FROM k""", "orfs", "seqs"),
    "o57_resolve_contig_names": duck("""WITH m AS (SELECT s_nationkey % 5 AS assembly, CAST(s_suppkey AS VARCHAR) AS name, s_name AS accession FROM supplier), r AS (SELECT row_key || '-' || row_no AS region_id, query % 7 AS assembly, CAST(query AS VARCHAR) AS name, q_end FROM repeat_hits),
        j AS (SELECT region_id, r.assembly, accession, CASE WHEN accession IS NULL THEN 'unknown contig' WHEN q_end > 15000 THEN 'past the end' END AS reason FROM r LEFT JOIN m ON r.assembly = m.assembly AND r.name = m.name) SELECT region_id, assembly, accession, reason FROM j""", "repeat_hits"),
    "o58_splice_motifs": duck(f"""WITH {_EX}, {_GAPS.format(name="i", source="ex")}, j AS (SELECT i.*, CASE WHEN i.seq_id % 2 = 0 THEN '+' ELSE '-' END AS strand, substr(seq, start + 1, 2) AS l, substr(seq, "end" - 1, 2) AS r FROM i JOIN seqs USING (seq_id) WHERE "end" - start >= 4 AND "end" <= length(seq)),
        k AS (SELECT seq_id, start, "end", strand, CASE WHEN strand = '-' THEN reverse(translate(r, 'ACGT', 'TGCA')) ELSE l END AS donor, CASE WHEN strand = '-' THEN reverse(translate(l, 'ACGT', 'TGCA')) ELSE r END AS acceptor FROM j)
        SELECT *, donor || '-' || acceptor IN ('GT-AG', 'GC-AG', 'AT-AC') AS canonical FROM k""", "exons", "seqs"),
    "o60_nearest_library_coverage": "SELECT p_brand AS lineage, count(*) FILTER (WHERE p_size > 25) AS curated, count(*) AS total, count(*) FILTER (WHERE p_size > 25) / count(*) AS ratio, count(*) FILTER (WHERE p_size > 25) = 0 AS uncovered FROM part GROUP BY p_brand",
}

QUERIES = {k: v for k, v in list(globals().items()) if k[:1] == "o" and k[1:3].isdigit()}
