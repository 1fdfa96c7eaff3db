"""Queries of the repeat and self-similarity operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.derive import derive, duck
from ..functions.tables import spread, stored
from ..operators import profile
from ..operators import repeats as ops
from ..operators import rollup
from .rollup import _FLAGS, _LEDGER, flags
from .sequences import _RAW, _count, raw, seqs


def o11_terminal_direct_repeats(spark, d):
    return ops.terminal_direct_repeats(seqs(spark, d))


def _pairs(spark, d):
    """A sequence and the next one, whole."""
    s = seqs(spark, d).select("seq_id", "seq")
    nxt = s.select((F.col("seq_id") - 1).alias("seq_id"), F.col("seq").alias("b"))
    return s.withColumnRenamed("seq", "a").join(nxt, "seq_id").select(F.col("seq_id").alias("pair_id"), "a", "b")


def o12_xdrop_extend(spark, d):
    s = seqs(spark, d).select("seq_id", "seq")
    ids = s.select("seq_id").distinct()
    pairs = ids.join(ids.select((F.col("seq_id") - 1).alias("seq_id")), "seq_id").select(F.col("seq_id").alias("pair_id"), F.col("seq_id").alias("a_id"), (F.col("seq_id") + 1).alias("b_id"))
    return ops.xdrop_by_frontier(pairs, s, 6)


def o13_near_miss_repeats(spark, d):
    return ops.near_miss_repeats(spread(derive(spark, d, "copies"), "seq_id"), 99.0)


def o14_span_identity(spark, d):
    return ops.span_identity(_pairs(spark, d))


def o17_inverted_repeat_seeds(spark, d):
    return ops.inverted_repeat_seeds(seqs(spark, d))


def o43_record_summary(spark, d):
    f = stored(flags(spark, d), "flags")  # read twice
    return ops.record_summary(profile.composition(raw(spark, d)), rollup.classify_elements(f), derive(spark, d, "evidence"), rollup.completeness_ledger(f))


def o16_terminal_inverted_repeats(spark, d):
    return ops.terminal_inverted_repeats(seqs(spark, d), min_tir=4)


def o18_tail_scan(spark, d):
    return ops.tail_scan(seqs(spark, d), min_run=2)


def _elements(spark, d):
    o = derive(spark, d, "orfs")
    return o.select("seq_id", (F.col("start") % 700).alias("start"), (F.col("start") % 700 + F.col("frame") * 97).alias("end"), F.lit(2).alias("expect"))


def o19_target_site_duplications(spark, d):
    return ops.target_site_duplications(_elements(spark, d), seqs(spark, d))


def o20_tsd_congruence(spark, d):
    e = derive(spark, d, "orders").select(F.col("o_orderkey").alias("seq_id"), F.element_at(F.array(*map(F.lit, ("Copia", "Gypsy", "hAT", "Tc1/Mariner", "MULE"))), (F.col("o_orderkey") % 5 + 1).cast("int")).alias("superfamily"), F.when(F.col("o_custkey") % 10 > 1, (F.col("o_custkey") % 10).cast("int")).alias("length"))
    return ops.tsd_congruence(e)


def o26_chance_length_profile(spark, d):
    return ops.chance_length_profile(ops.terminal_inverted_repeats(seqs(spark, d), min_tir=4).join(derive(spark, d, "documents").select(F.col("doc_id").alias("seq_id"), F.col("lang").alias("stratum")), "seq_id").select("stratum", F.col("tir_len").alias("length")), 20)


def o27_self_similarity_matrix(spark, d):
    return ops.self_similarity_matrix(seqs(spark, d), k=13, bins=20)


def o27_masked_words(spark, d):
    return ops.masked_words(seqs(spark, d), k=6, max_occ=20)


def o28_chance_floor(spark, d):
    return ops.chance_floor(seqs(spark, d), k=4, bins=20).select("seq_id", *(F.round(c, 6).alias(c) for c in ("p_base", "p_word", "total", "per_bin")))


def o29_significant_cells(spark, d):
    return ops.significant_cells(ops.chance_floor(seqs(spark, d), k=8, bins=20), bins=20)


def o30_word_size_per_element(spark, d):
    return ops.word_size_per_element(derive(spark, d, "evidence"))


def o31_normalised_density(spark, d):
    return ops.normalised_density(ops.self_similarity_matrix(seqs(spark, d), k=13, bins=20))


_TIR = """lim AS (SELECT seq_id, least(1000, length(seq) // 2) AS l, seq FROM seqs WHERE length(seq) >= 8),
    ab AS (SELECT seq_id, l, string_split(substr(seq, 1, l), '') AS a, string_split(reverse(translate(substr(seq, length(seq) - l + 1, l), 'ACGT', 'TGCA')), '') AS b FROM lim),
    u AS (SELECT seq_id, l, unnest(range(1, l + 1)) AS n, unnest(a) AS x, unnest(b) AS y FROM ab), c AS (SELECT seq_id, l, n, x, sum(CAST(x = y AS INT)) OVER (PARTITION BY seq_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS m FROM u),
    best AS (SELECT seq_id, any_value(l) AS l, arg_max(n, (3 * m - 2 * n, -n)) AS len, arg_max(m, (3 * m - 2 * n, -n)) AS hits FROM c WHERE n >= 4 AND 100 * m >= 80 * n GROUP BY seq_id),
    top AS (SELECT seq_id, max(k) AS k FROM (SELECT c.seq_id, x, count(*) AS k FROM c JOIN best ON best.seq_id = c.seq_id AND n <= len GROUP BY ALL) GROUP BY seq_id),
    tir AS (SELECT best.seq_id, CAST(len AS INT) AS tir_len, CAST(100 * hits AS BIGINT) / len AS identity, len = best.l AS lower_bound FROM best JOIN top USING (seq_id) JOIN lim USING (seq_id)
        WHERE k / len <= 0.7 AND NOT (len >= 8 AND len(list_distinct(list_transform(range(1, len - 2), lambda i: substr(seq, i, 4)))) < greatest(4, 0.05 * (len - 3))))"""
_WORDS = """pc AS (SELECT seq_id, length(seq) AS n, a, substr(seq, a + 1, 999 + {k}) AS b FROM (SELECT *, unnest(range(0, length(seq), 1000)) AS a FROM seqs)),
    wd AS (SELECT seq_id, n, a + i AS p, substr(b, i + 1, {k}) AS w FROM (SELECT *, unnest(range(0, length(b) - {k} + 1)) AS i FROM pc))"""
_MATRIX = _WORDS.format(k=13) + """, ct AS (SELECT seq_id, w FROM wd GROUP BY ALL HAVING count(*) <= 120), kp AS (SELECT wd.seq_id, p, wd.w, CAST(floor(p * 20 / n) AS INT) AS bin FROM wd JOIN ct ON wd.seq_id = ct.seq_id AND wd.w = ct.w),
    mx AS (SELECT a.seq_id, 'forward' AS orientation, a.bin AS bin_i, b.bin AS bin_j, count(*) AS cnt FROM kp a JOIN kp b ON a.seq_id = b.seq_id AND a.w = b.w AND a.p <= b.p GROUP BY ALL
    UNION ALL SELECT a.seq_id, 'reverse', a.bin, b.bin, count(*) FROM (SELECT * REPLACE (reverse(translate(w, 'ACGT', 'TGCA')) AS w) FROM kp) a JOIN kp b ON a.seq_id = b.seq_id AND a.w = b.w GROUP BY ALL)"""

_PAIR = "pr AS (SELECT a.seq_id AS pair_id, a.seq AS a, b.seq AS b FROM seqs a JOIN seqs b ON b.seq_id = a.seq_id + 1)"

ORACLES = {
    "o12_xdrop_extend": duck(f"""WITH {_PAIR}, o AS (SELECT pair_id, unnest(range(1, l + 1)) AS i, unnest(string_split(substr(a, 1, l), '')) AS x, unnest(string_split(substr(b, 1, l), '')) AS y FROM (SELECT *, least(length(a), length(b)) AS l FROM pr) WHERE l > 0), c AS (SELECT pair_id, i, sum(CASE WHEN x = y THEN 1 ELSE -2 END) OVER (PARTITION BY pair_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS s FROM o),
        m AS (SELECT *, greatest(0, max(s) OVER (PARTITION BY pair_id ORDER BY i ROWS UNBOUNDED PRECEDING)) AS best FROM c), k AS (SELECT *, max(CAST(s < best - 6 AS INT)) OVER (PARTITION BY pair_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS dead FROM m),
        e AS (SELECT pair_id, arg_max(i, (s, -i)) AS ext, max(s) AS top FROM k WHERE dead = 0 GROUP BY pair_id) SELECT pr.pair_id, CAST(CASE WHEN top > 0 THEN ext ELSE 0 END AS INT) AS ext FROM pr LEFT JOIN e USING (pair_id)""", "seqs"),
    "o14_span_identity": duck(f"""WITH {_PAIR}, n AS (SELECT *, CAST(least(length(a), length(b)) AS INT) AS len FROM pr), h AS (SELECT pair_id, len, CASE WHEN len > 0 THEN CAST(len - hamming(substr(a, 1, len), substr(b, 1, len)) AS INT) ELSE 0 END AS matches FROM n) SELECT *, CASE WHEN len > 0 THEN 100 * matches / len END AS identity FROM h""", "seqs"),
    "o43_record_summary": duck(f"""WITH {_FLAGS}, {_LEDGER}, {_RAW}, k AS (SELECT seq_id, array_to_string(list_sort(list(DISTINCT kind)), ',') AS structures FROM evidence WHERE NOT advisory GROUP BY seq_id),
        r AS (SELECT seq_id, length(seq) AS length, {_count("ACGT")} AS known, {_count("GC")} AS gc, {_count("ACGTNRYSWKMBDHV")} AS coded FROM raw)
        SELECT r.seq_id, length, coalesce(length > 0 AND coded = length, false) AS valid, CASE WHEN known > 0 THEN 100 * gc / known ELSE 0 END AS gc_pct, coalesce(te_class, 'none') AS te_class, coalesce(confidence, 'Candidate') AS confidence, coalesce(tier, 'none') AS tier,
        coalesce(architecture, '') AS architecture, coalesce(n_domains, 0) AS n_domains, coalesce(structures, '') AS structures FROM r LEFT JOIN led ON led.seq_id = r.seq_id LEFT JOIN k ON k.seq_id = r.seq_id""", "domain_hits", "evidence"),
    "o16_terminal_inverted_repeats": duck(f"WITH {_TIR} SELECT * FROM tir", "seqs"),
    "o18_tail_scan": duck("""WITH t AS (SELECT seq_id, length(seq) AS n, length(seq) - length(rtrim(seq, 'A')) AS a, length(seq) - length(ltrim(seq, 'T')) AS t FROM seqs)
        SELECT seq_id, 'polyA' AS kind, a AS length, n - a AS start, n AS "end" FROM t WHERE a >= 2 UNION ALL SELECT seq_id, 'polyT', t, 0, t FROM t WHERE t >= 2""", "seqs"),
    "o19_target_site_duplications": duck("""WITH e AS (SELECT seq_id, start % 700 AS s, start % 700 + frame * 97 AS e FROM orfs), j AS (SELECT e.*, seq, length(seq) AS n FROM e JOIN seqs USING (seq_id)), k AS (SELECT *, unnest(range(2, 13)) AS l FROM j),
        m AS (SELECT * FROM k WHERE s >= l AND e + l <= n AND substr(seq, s - l + 1, l) = substr(seq, e + 1, l)), g AS (SELECT seq_id, s, e, any_value(seq) AS seq, CASE WHEN bool_or(l = 2) THEN 2 ELSE max(l) END AS length, count(*) AS reps FROM m GROUP BY seq_id, s, e),
        c AS (SELECT seq_id, s, e, count(*) AS copies FROM e GROUP BY ALL) SELECT g.seq_id, g.s AS start, g.e AS "end", length, substr(seq, g.e + 1, length) AS motif, length = 2 AS matched_expected FROM g JOIN c USING (seq_id, s, e), range(0, copies)""", "orfs", "seqs"),
    "o20_tsd_congruence": """WITH t AS (SELECT o_orderkey AS seq_id, ['Copia', 'Gypsy', 'hAT', 'Tc1/Mariner', 'MULE'][o_orderkey % 5 + 1] AS superfamily, CASE WHEN o_custkey % 10 > 1 THEN o_custkey % 10 END AS length, [5, 5, 8, 2, NULL][o_orderkey % 5 + 1] AS expected FROM orders)
        SELECT *, CASE WHEN length IS NULL THEN 'not assessed' WHEN expected IS NULL THEN 'not diagnostic' WHEN expected = length THEN 'congruent' ELSE 'incongruent' END AS verdict FROM t""",
    "o26_chance_length_profile": duck(f"""WITH {_TIR}, h AS (SELECT lang AS stratum, tir_len AS length, count(*) AS cnt FROM tir JOIN documents ON doc_id = seq_id GROUP BY ALL)
        SELECT *, CAST(sum(cnt) OVER (PARTITION BY stratum ORDER BY length DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS at_least, max(length) OVER (PARTITION BY stratum) AS longest, 20 - max(length) OVER (PARTITION BY stratum) AS margin FROM h""", "seqs"),
    "o27_self_similarity_matrix": duck(f"WITH {_MATRIX} SELECT * FROM mx", "seqs"),
    "o27_masked_words": duck(f"WITH {_WORDS.format(k=6)}, ct AS (SELECT seq_id, w, count(*) AS c FROM wd GROUP BY ALL HAVING count(*) > 20) SELECT seq_id, count(*) AS masked_kmers, CAST(sum(c) AS BIGINT) AS masked_positions FROM ct GROUP BY seq_id", "seqs"),
    "o28_chance_floor": duck(f"""WITH c AS (SELECT seq_id, length(seq) AS n, {" + ".join(f"pow((length(seq) - length(translate(seq, '{b}', ''))) / length(seq), 2)" for b in "ACGT")} AS s FROM seqs WHERE length(seq) >= 4)
        SELECT seq_id, round(s, 6) AS p_base, round(pow(s, 4), 6) AS p_word, round(pow(s, 4) * n * n / 2, 6) AS total, round(pow(s, 4) * n * n / 400, 6) AS per_bin FROM c""", "seqs"),
    "o29_significant_cells": duck(f"""WITH c AS (SELECT seq_id, CAST(length(seq) AS DOUBLE) AS n, {" + ".join(f"pow((length(seq) - length(translate(seq, '{b}', ''))) / length(seq), 2)" for b in "ACGT")} AS s FROM seqs WHERE length(seq) >= 8), m AS (SELECT seq_id, pow(s, 8) * n * n / 400 AS mean FROM c),
        t AS (SELECT seq_id, c, sum(exp(c * ln(mean) - mean - lgamma(c + 1))) OVER (PARTITION BY seq_id ORDER BY c DESC ROWS UNBOUNDED PRECEDING) AS tail FROM (SELECT *, unnest(range(0, 256)) AS c FROM m WHERE mean < 64)), x AS (SELECT seq_id, min(c) AS m FROM t WHERE tail * 400 < 1 GROUP BY seq_id)
        SELECT m.seq_id, CAST(CASE WHEN mean >= 64 THEN 64 ELSE least(64, x.m) END AS INT) AS threshold FROM m LEFT JOIN x ON x.seq_id = m.seq_id""", "seqs"),
    "o30_word_size_per_element": duck("SELECT seq_id, CAST(greatest(6, least(13, min(length) - 3)) AS INT) AS k FROM evidence GROUP BY seq_id", "evidence"),
    "o31_normalised_density": duck(f"WITH {_MATRIX}, pk AS (SELECT *, max(cnt) OVER (PARTITION BY seq_id, orientation) AS peak FROM mx) SELECT *, cnt / peak AS density FROM pk", "seqs"),
}

QUERIES = {k: v for k, v in list(globals().items()) if k[:1] == "o" and k[1:3].isdigit() and k.startswith(("o1", "o2", "o3", "o43"))}
