"""Queries of the structural-evidence operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.derive import derive, duck
from ..functions.tables import spread
from ..operators import cases, params, repeats, rollup
from ..operators import structure as ops
from .repeats import _TIR
from .rollup import hits
from .sequences import seqs


def arms(spark, d):
    """Two spans of 100 bases near the ends of each longer sequence."""
    return derive(spark, d, "arms")


def o15_termini_motif(spark, d):
    return ops.termini_motif(arms(spark, d), seqs(spark, d))


def _superfamily(column: str):
    names = F.array(*map(F.lit, ("Copia 1", "Gypsy", "hAT-like x", "Tc1/Mariner", "MULE")))
    return F.element_at(names, (F.col(column) % 5 + 1).cast("int"))


def o21_tsd_refine(spark, d):
    o = derive(spark, d, "orfs")
    elements = o.select("seq_id", (F.col("start") % 700).alias("start"), (F.col("start") % 700 + F.col("frame") * 97).alias("end"), F.lit(None).cast("int").alias("expect")).distinct()
    s = seqs(spark, d)
    tsd = repeats.target_site_duplications(elements, s).select("seq_id", "start", "end", "length", "motif")
    return ops.tsd_refine(tsd, s.select("seq_id", _superfamily("seq_id").alias("superfamily")), s)


def o22_primer_binding_site(spark, d):
    return ops.primer_binding_site(arms(spark, d), seqs(spark, d))


def o23_polypurine_tract(spark, d):
    return ops.polypurine_tract(arms(spark, d), seqs(spark, d))


def o24_polya_signal(spark, d):
    return ops.polya_signal(arms(spark, d), seqs(spark, d))


def elements(spark, d):
    """The sequences, and elements made of them: 600 bases, 400 between, and a copy of the 600 in which GAC is GTC."""
    return spread(derive(spark, d, "copies"), "seq_id")


def o25_structural_evidence(spark, d):
    return ops.structural_evidence(elements(spark, d)).withColumn("identity", F.round("identity", 6))


def o35_classify_detected(spark, d):
    """The calls that follow from the domain hits and the evidence that the detectors find in the sequences themselves."""
    evidence = ops.structural_evidence(elements(spark, d))
    return rollup.classify_elements(rollup.element_flags(hits(spark, d), evidence)).select("seq_id", "class", "te_class", "confidence")


def o39_subgenomic_architecture(spark, d):
    h = hits(spark, d).withColumn("seq_id", F.col("seq_id") % 500)
    spans = derive(spark, d, "evidence").where("kind = 'LTR'").groupBy((F.col("seq_id") % 500).alias("seq_id")).agg(F.min("start").alias("low"), F.max("end").alias("high"))
    calls = spans.select("seq_id", (F.col("seq_id") % 3 > 0).alias("is_erv"))
    return ops.subgenomic_architecture(calls, spans, h)


def o59_match_features_to_cases(spark, d):
    return cases.match_features_to_cases(derive(spark, d, "case_rows"), derive(spark, d, "case_features"))


def o63_detector_parameters(spark, d):
    """The thresholds attached to a count of the frames that the first of them admits."""
    n = derive(spark, d, "orfs").agg(F.count_if((F.col("end") - F.col("start")) / 3 - 1 >= params.value("orf_min_aa")).alias("orfs"))
    return n.crossJoin(params.detector_parameters(spark))  # one row and one row


_ARMS = "ar AS (SELECT arms.*, seq, length(seq) AS n FROM arms JOIN seqs USING (seq_id))"
_FLANK = """e AS (SELECT DISTINCT seq_id, start % 700 AS s, start % 700 + frame * 97 AS e FROM orfs), j AS (SELECT e.*, seq, length(seq) AS n FROM e JOIN seqs USING (seq_id)), k AS (SELECT *, unnest(range(2, 13)) AS l FROM j),
    m AS (SELECT seq_id, s, e, seq, l FROM k WHERE s >= l AND e + l <= n AND substr(seq, s - l + 1, l) = substr(seq, e + 1, l))"""
_HEX = ", ".join(f"('{h}', '{v}', {ops.RANKS.index(v) + 1})" for h, v in ops.HEXAMERS.items())
_SIMPLE = "{n} < 8 OR greatest({t}) / {n} > 0.7 OR len(list_distinct(list_transform(range(1, {n} - 2), lambda i: substr({s}, i, 4)))) < greatest(4, 0.05 * ({n} - 3))"


def _simple(text: str) -> str:
    top = ", ".join(f"length({text}) - length(translate({text}, '{b}', ''))" for b in "ACGT")
    return _SIMPLE.format(n=f"length({text})", t=top, s=text)


#: The direct repeats: words of both ends, their strongest diagonal, the walk out to both sides, identity and complexity.
_LTR = f"""en AS (SELECT seq_id, length(seq) AS n, least(6000, length(seq) // 2) AS w, seq FROM {{source}} WHERE length(seq) // 2 >= 80),
    fv AS (SELECT seq_id, i AS p5, substr(t, i + 1, 13) AS word FROM (SELECT seq_id, substr(seq, 1, w) AS t, unnest(range(0, w - 12)) AS i FROM en)),
    th AS (SELECT seq_id, n - w + i AS p3, substr(t, i + 1, 13) AS word FROM (SELECT seq_id, n, w, substr(seq, n - w + 1, w) AS t, unnest(range(0, w - 12)) AS i FROM en)),
    an AS (SELECT fv.seq_id, p5, p3, p3 - p5 AS d FROM fv JOIN th ON fv.seq_id = th.seq_id AND fv.word = th.word WHERE p3 > p5 + 80),
    dg AS (SELECT seq_id, d, count(*) AS c, min(p3) AS p3, min(p5) AS p5 FROM an GROUP BY seq_id, d),
    bs AS (SELECT seq_id, arg_max(d, (c, -p3, -p5)) AS best FROM dg GROUP BY seq_id),
    sd AS (SELECT an.seq_id, best AS d, count(DISTINCT p5) AS dp, min(p5) AS lo, max(p5) + 13 AS hi FROM an JOIN bs ON an.seq_id = bs.seq_id WHERE abs(an.d - best) <= 3 GROUP BY an.seq_id, best HAVING count(*) >= 4),
    rm AS (SELECT sd.*, n, w, seq, least(lo, 6000) AS lr, greatest(0, least(d - hi, n - d - hi, 6000)) AS rr FROM sd JOIN en ON en.seq_id = sd.seq_id),
    wk AS (SELECT seq_id, 'l' AS side, unnest(string_split(reverse(substr(seq, lo - lr + 1, lr)), '')) AS x, unnest(string_split(reverse(substr(seq, lo + d - lr + 1, lr)), '')) AS y, unnest(range(1, lr + 1)) AS i FROM rm WHERE lr > 0
        UNION ALL SELECT seq_id, 'r', unnest(string_split(substr(seq, hi + 1, rr), '')), unnest(string_split(substr(seq, hi + d + 1, rr), '')), unnest(range(1, rr + 1)) FROM rm WHERE rr > 0),
    sc AS (SELECT seq_id, side, i, sum(CASE WHEN x = y THEN 1 ELSE -2 END) OVER (PARTITION BY seq_id, side ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM wk),
    mx AS (SELECT *, greatest(0, max(s) OVER (PARTITION BY seq_id, side ORDER BY i ROWS UNBOUNDED PRECEDING)) AS top FROM sc),
    lv AS (SELECT *, max(CAST(s < top - 30 AS INT)) OVER (PARTITION BY seq_id, side ORDER BY i ROWS UNBOUNDED PRECEDING) AS dead FROM mx),
    ex AS (SELECT seq_id, side, CASE WHEN max(s) > 0 THEN arg_max(i, (s, -i)) ELSE 0 END AS ext FROM lv WHERE dead = 0 GROUP BY seq_id, side),
    sp AS (SELECT rm.seq_id, seq, w, d, dp, lo - coalesce(l.ext, 0) AS s5, hi + coalesce(r.ext, 0) AS e5 FROM rm LEFT JOIN ex l ON l.seq_id = rm.seq_id AND l.side = 'l' LEFT JOIN ex r ON r.seq_id = rm.seq_id AND r.side = 'r'),
    ln AS (SELECT *, e5 - s5 AS len, substr(seq, s5 + 1, e5 - s5) AS a, substr(seq, s5 + d + 1, e5 - s5) AS b FROM sp WHERE e5 - s5 >= 80 AND dp >= greatest(4, ceil((e5 - s5 - 12) * 0.01))),
    ltr AS (SELECT seq_id, CAST(s5 AS INT) AS s5, CAST(e5 AS INT) AS e5, CAST(s5 + d AS INT) AS s3, CAST(e5 + d AS INT) AS e3, CAST(len AS INT) AS ltr_len, 100 * (len - hamming(a, b)) / len AS identity, e5 >= w AS lower_bound FROM ln WHERE NOT ({_simple("a")}))"""
_SEEDS = f"""se AS (SELECT seq_id, length(seq) AS n, least(1200, length(seq) // 2) AS w, seq FROM {{source}} WHERE length(seq) // 2 >= 1),
    sf AS (SELECT seq_id, i AS p5, substr(t, i + 1, 11) AS word FROM (SELECT seq_id, substr(seq, 1, w) AS t, unnest(range(0, w - 10)) AS i FROM se)),
    st AS (SELECT seq_id, n - w + i AS p3, reverse(translate(substr(t, i + 1, 11), 'ACGT', 'TGCA')) AS word FROM (SELECT seq_id, n, w, substr(seq, n - w + 1, w) AS t, unnest(range(0, w - 10)) AS i FROM se)),
    sa AS (SELECT sf.seq_id, p5, p3, p5 + p3 + 11 AS s FROM sf JOIN st ON sf.seq_id = st.seq_id AND sf.word = st.word WHERE p3 > p5),
    ss AS (SELECT seq_id, s, count(*) AS c, min(p5) AS low, max(p5) AS high, max(p3) AS last FROM sa GROUP BY seq_id, s),
    sb AS (SELECT seq_id, arg_max(s, (c, last, -s)) AS best FROM ss GROUP BY seq_id HAVING max(c) >= 3),
    sn AS (SELECT ss.seq_id, best, min(low) AS s5, max(high) + 11 AS e5 FROM ss JOIN sb ON ss.seq_id = sb.seq_id WHERE abs(s - best) <= 4 GROUP BY ss.seq_id, best),
    sq AS (SELECT sn.*, substr(seq, s5 + 1, e5 - s5) AS a, reverse(translate(substr(seq, best - e5 + 1, e5 - s5), 'ACGT', 'TGCA')) AS b FROM sn JOIN se ON se.seq_id = sn.seq_id WHERE e5 - s5 BETWEEN 10 AND 1000),
    sr AS (SELECT *, 100 * len(list_filter(list_zip(string_split(a, ''), string_split(b, '')), lambda x: x[1] = x[2])) / (e5 - s5) AS identity FROM sq),
    seeded AS (SELECT seq_id, CAST(s5 AS INT) AS s5, CAST(e5 AS INT) AS e5, CAST(best - e5 AS INT) AS s3, CAST(best - s5 AS INT) AS e3, identity FROM sr WHERE identity >= 80 AND NOT ({_simple("a")}))"""

_PBS = f"""pl AS (SELECT seq_id, e5, substr(seq, e5 + 1, 44) AS t FROM ar), pi AS (SELECT *, unnest(range(0, length(t) - 17)) AS i FROM pl), ph AS (SELECT seq_id, e5, i, substr(t, i + 1, 18) AS motif, 18 - hamming(substr(t, i + 1, 18), '{ops.PRIMING["tRNA-Lys3"]}') AS same FROM pi),
    pb AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY same DESC, i) AS rn FROM ph), pbs AS (SELECT seq_id, CAST(e5 + i AS INT) AS start, CAST(e5 + i + 18 AS INT) AS "end", CASE WHEN same / 18 >= 0.72 THEN 'tRNA-Lys3' ELSE 'undetermined' END AS priming_trna, 'tRNA-Lys3' AS best_match, round(100 * same / 18, 1) AS identity, same / 18 >= 0.72 AS confident, motif
    FROM pb WHERE rn = 1 AND same / 18 >= 0.55)"""
_PPT = """tt AS (SELECT *, unnest(range(9, least(s3, 30) + 1)) AS length FROM ar), tu AS (SELECT seq_id, s3, length, substr(seq, s3 - length + 1, length) AS motif FROM tt), tv AS (SELECT *, length - length(regexp_replace(motif, '[AG]', '', 'g')) AS pure FROM tu),
    tw AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY length DESC) AS rn FROM tv WHERE length - pure <= 2 AND regexp_matches(motif, '^[AG][AG]') AND pure >= 0.82 * length),
    ppt AS (SELECT seq_id, CAST(s3 - length AS INT) AS start, CAST(s3 AS INT) AS "end", CAST(length AS INT) AS length, round(pure / length, 2) AS purine_frac, motif FROM tw WHERE rn = 1)"""
_SIGNAL = f"""hx(motif, variant, rank) AS (VALUES {_HEX}), xp AS (SELECT *, unnest(range(0, greatest(0, e3 - s3 - 6) + 1)) AS o FROM ar), xh AS (SELECT xp.*, hx.*, substr(seq, s5 + o + 1, 6) AS mirror, CASE WHEN s3 + o + 66 <= n THEN substr(seq, s3 + o + 27, 40) END AS win FROM xp JOIN hx ON hx.motif = substr(seq, s3 + o + 1, 6)),
    xq AS (SELECT *, length(win) - length(replace(win, 'T', '')) AS t_count, length(win) - length(translate(win, 'GT', '')) AS gt FROM xh), xr AS (SELECT *, CASE WHEN win IS NULL THEN '{ops.NO_RECORD}' WHEN gt / 40 >= 0.65 AND t_count >= 4 THEN 'found' ELSE 'absent' END AS dse_state FROM xq),
    xb AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY dse_state <> 'found', rank, o) AS rn FROM xr), pas AS (SELECT seq_id, CAST(s3 + o AS INT) AS start, CAST(s3 + o + 6 AS INT) AS "end", motif, variant, dse_state, round(gt / 40, 2) AS gt_frac, t_count, mirror AS five_prime_copy_motif, mirror = motif AS in_both, dse_state = 'found' AND mirror = motif AS confident
    FROM xb WHERE rn = 1 AND dse_state <> 'absent')"""

ORACLES = {
    "o11_terminal_direct_repeats": duck(f"WITH {_LTR.format(source='seqs')} SELECT *, identity < 80 AS advisory FROM ltr", "seqs"),
    "o13_near_miss_repeats": duck(f"WITH {_LTR.format(source='copies')} SELECT *, true AS advisory, 99.0::DOUBLE AS threshold FROM ltr WHERE identity < 99", "copies"),
    "o17_inverted_repeat_seeds": duck(f"WITH {_SEEDS.format(source='seqs')} SELECT * FROM seeded", "seqs"),
    "o15_termini_motif": duck(f"""WITH {_ARMS}, t AS (SELECT seq_id, substr(seq, s5 + 1, 2) AS five_start, substr(seq, e5 - 1, 2) AS five_end, substr(seq, s3 + 1, 2) AS three_start, substr(seq, e3 - 1, 2) AS three_end FROM ar),
        m AS (SELECT *, CAST(five_start <> 'TG' AS INT) + CAST(three_start <> 'TG' AS INT) + CAST(five_end <> 'CA' AS INT) + CAST(three_end <> 'CA' AS INT) AS mismatches, CASE WHEN five_start = three_start AND five_end = three_end THEN five_start || five_end END AS pair FROM t)
        SELECT * EXCLUDE (pair), mismatches <= 1 AS within_tolerance, CASE WHEN mismatches = 0 THEN 'canonical' WHEN pair IN {ops.MOTIFS} THEN 'non-canonical' ELSE 'none' END AS tier, CASE WHEN mismatches = 0 OR pair IN {ops.MOTIFS} THEN pair END AS motif FROM m""", "arms", "seqs"),
    "o21_tsd_refine": duck(f"""WITH {_FLANK}, g AS (SELECT seq_id, s, e, any_value(seq) AS seq, max(l) AS l, list(l) AS all_l, [5, 5, NULL, 2, NULL][seq_id % 5 + 1] AS want FROM m GROUP BY seq_id, s, e),
        r AS (SELECT *, coalesce(want <> l AND list_contains(all_l, want), false) AS refined FROM g) SELECT seq_id, s AS start, e AS "end", CASE WHEN refined THEN want ELSE l END AS length, substr(seq, e + 1, CASE WHEN refined THEN want ELSE l END) AS motif, refined FROM r""", "orfs", "seqs"),
    "o22_primer_binding_site": duck(f"WITH {_ARMS}, {_PBS} SELECT * FROM pbs", "arms", "seqs"),
    "o23_polypurine_tract": duck(f"WITH {_ARMS}, {_PPT} SELECT * FROM ppt", "arms", "seqs"),
    "o24_polya_signal": duck(f"WITH {_ARMS}, {_SIGNAL} SELECT * FROM pas", "arms", "seqs"),
    "o25_structural_evidence": duck(f"""WITH {_LTR.format(source="copies")}, acc AS (SELECT * FROM ltr WHERE identity >= 80), rest AS (SELECT * FROM copies WHERE seq_id NOT IN (SELECT seq_id FROM acc)), {_TIR.replace("FROM seqs", "FROM rest").replace("length(seq) >= 8", "length(seq) >= 20").replace("n >= 4", "n >= 10")},
        rest2 AS (SELECT * FROM rest WHERE seq_id NOT IN (SELECT seq_id FROM tir)), {_SEEDS.format(source="rest2")},
        rep AS (SELECT seq_id, 'LTR' AS kind, s5 AS start, e3 AS "end", ltr_len AS length, identity, identity < 80 AS advisory, lower_bound, e5 || ' ' || s3 AS detail FROM ltr
            UNION ALL SELECT tir.seq_id, 'TIR', 0, length(seq), tir_len, identity, false, lower_bound, tir_len || ' ' || (length(seq) - tir_len) FROM tir JOIN copies ON copies.seq_id = tir.seq_id
            UNION ALL SELECT seq_id, 'TIR', s5, e3, e5 - s5, identity, false, false, e5 || ' ' || s3 FROM seeded),
        tl AS (SELECT rep.seq_id, start AS s, "end" AS e, seq, length(seq) AS n, unnest(range(2, 13)) AS l FROM rep JOIN copies ON copies.seq_id = rep.seq_id WHERE NOT advisory),
        td AS (SELECT seq_id, s, e, max(l) AS l, any_value(seq) AS seq FROM tl WHERE s >= l AND e + l <= n AND substr(seq, s - l + 1, l) = substr(seq, e + 1, l) GROUP BY seq_id, s, e),
        ar AS (SELECT acc.*, seq, length(seq) AS n FROM acc JOIN copies ON copies.seq_id = acc.seq_id), {_PBS}, {_PPT}, {_SIGNAL},
        tails AS (SELECT seq_id, length(seq) AS n, length(seq) - length(rtrim(seq, 'A')) AS a, length(seq) - length(ltrim(seq, 'T')) AS t FROM copies),
        every AS (SELECT rep.*, CASE WHEN advisory THEN NULL WHEN td.l IS NOT NULL THEN 'found' WHEN start < 2 OR "end" + 2 > length(copies.seq) THEN '{ops.NO_RECORD}' ELSE 'absent' END AS state FROM rep JOIN copies ON copies.seq_id = rep.seq_id LEFT JOIN td ON td.seq_id = rep.seq_id AND td.s = start AND td.e = "end"
            UNION ALL SELECT seq_id, 'TSD', s - l, e + l, l, NULL, false, false, substr(seq, e + 1, l), NULL FROM td
            UNION ALL SELECT seq_id, 'PBS', start, "end", 18, identity, false, false, priming_trna || ' ' || motif, NULL FROM pbs
            UNION ALL SELECT seq_id, 'PPT', start, "end", length, 100 * purine_frac, false, false, motif, NULL FROM ppt
            UNION ALL SELECT seq_id, 'polyA-signal', start, "end", 6, NULL, true, false, motif || ' ' || variant || ' ' || dse_state, NULL FROM pas
            UNION ALL SELECT seq_id, 'polyA', n - a, n, a, NULL, false, false, NULL, NULL FROM tails WHERE a >= 8 UNION ALL SELECT seq_id, 'polyT', 0, t, t, NULL, false, false, NULL, NULL FROM tails WHERE t >= 8)
        SELECT seq_id, kind, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end", CAST(length AS INT) AS length, round(CAST(identity AS DOUBLE), 6) AS identity, advisory, lower_bound, detail, state FROM every""", "copies"),
    "o59_match_features_to_cases": duck("""WITH c AS (SELECT *, regexp_extract(coalesce(coords, ''), '^([0-9]+)[.][.]([0-9]+)', 1) AS plain FROM case_rows), f AS (SELECT * FROM case_features WHERE kind <> 'gene' AND "end" - start > 200),
        o AS (SELECT * FROM c WHERE coords IS NULL), w AS (SELECT DISTINCT case_id, accession, unnest(string_split_regex(lower(expected_superfamily), '[^a-z0-9]+')) AS word FROM o), h AS (SELECT DISTINCT accession, feature, start, "end", strand, unnest(string_split_regex(lower(name), '[^a-z0-9]+')) AS word FROM f),
        m AS (SELECT case_id, w.accession, feature, start, "end", strand, count(*) AS n FROM w JOIN h ON w.accession = h.accession AND w.word = h.word WHERE length(w.word) > 2 AND w.word NOT IN ('family', 'the') GROUP BY ALL),
        b AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY n DESC, feature) AS rn FROM m), named AS (SELECT * FROM b WHERE rn = 1), z AS (SELECT accession, count(*) AS n, arg_min(start, feature) AS s, arg_min("end", feature) AS e, arg_min(strand, feature) AS st FROM f GROUP BY accession),
        lf AS (SELECT case_id, o.accession, z.n, s, e, st FROM o LEFT JOIN z ON z.accession = o.accession WHERE case_id NOT IN (SELECT case_id FROM named)), q AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY case_id) AS k FROM lf WHERE n > 1),
        fr AS (SELECT *, row_number() OVER (PARTITION BY accession ORDER BY "end" - start DESC, feature) AS k FROM f WHERE NOT EXISTS (SELECT 1 FROM named x WHERE x.accession = f.accession AND x.start = f.start AND x."end" = f."end"))
        SELECT case_id, CASE WHEN plain <> '' THEN case_id - 1 ELSE case_id - 1 END AS start, CASE WHEN plain <> '' THEN case_id + 500 ELSE case_id + 30 END AS "end", CASE WHEN plain = '' THEN '-' END AS strand, CASE WHEN plain <> '' THEN 'corpus span' ELSE 'corpus joined location' END AS method FROM c WHERE coords IS NOT NULL
        UNION ALL SELECT case_id, start, "end", strand, 'name match of ' || n || ' words' FROM named UNION ALL SELECT case_id, s, e, st, 'only feature' FROM lf WHERE n = 1 UNION ALL SELECT case_id, NULL, NULL, NULL, 'no delimiting feature' FROM lf WHERE n IS NULL
        UNION ALL SELECT q.case_id, fr.start, fr."end", fr.strand, CASE WHEN fr.start IS NULL THEN 'all features taken' ELSE 'by size, weak' END FROM q LEFT JOIN fr ON fr.accession = q.accession AND fr.k = q.k""", "case_rows", "case_features"),
    "o39_subgenomic_architecture": duck(f"""WITH h AS (SELECT seq_id % 500 AS seq_id, domain, strand, start, "end" FROM domain_hits), l AS (SELECT seq_id % 500 AS seq_id, min(start) AS low, max("end") AS high FROM evidence WHERE kind = 'LTR' GROUP BY 1),
        p AS (SELECT seq_id, count(*) FILTER (WHERE domain IN {(*ops.BODY, "ENV")} AND strand = '-') > count(*) FILTER (WHERE domain IN {(*ops.BODY, "ENV")} AND strand <> '-') AS minus, min(start) FILTER (WHERE domain = 'ENV') AS el, max("end") FILTER (WHERE domain = 'ENV') AS eh FROM h GROUP BY seq_id),
        b AS (SELECT p.*, low, high, min(start) AS bl, max("end") AS bh FROM p JOIN l USING (seq_id) JOIN h USING (seq_id) WHERE seq_id % 3 > 0 AND el IS NOT NULL AND domain IN {ops.BODY} AND CASE WHEN minus THEN start >= eh ELSE "end" <= el END GROUP BY ALL),
        s AS (SELECT seq_id, low, high, '+' AS strand, low AS leader_start, bl AS leader_end, bl AS intron_start, el AS intron_end, el AS env_start, least(eh, high) AS env_end FROM b WHERE NOT minus UNION ALL SELECT seq_id, low, high, '-', bh, high, eh, bh, greatest(el, low), eh FROM b WHERE minus)
        SELECT * EXCLUDE (low, high) FROM s WHERE leader_start < leader_end AND intron_start < intron_end AND env_start < env_end AND env_start >= low AND env_end <= high AND leader_start >= low AND leader_end <= high
        AND CASE WHEN strand = '+' THEN leader_end <= intron_start AND intron_end <= env_start ELSE env_end <= intron_start AND intron_end <= leader_start END""", "domain_hits", "evidence"),
    "o63_detector_parameters": duck(f"""SELECT count(*) FILTER (WHERE ("end" - start) / 3 - 1 >= 40) AS orfs, {", ".join(f"{v}::DOUBLE AS {k}" for k, v in params.PARAMETERS.items())} FROM orfs""", "orfs"),
}

QUERIES = {k: v for k, v in list(globals().items()) if k[:1] == "o" and k[1:3].isdigit()}
