"""Queries of the roll-up and provenance operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.derive import derive, duck
from ..operators import provenance, rollup


def hits(spark, d):
    return derive(spark, d, "domain_hits")


def o32_dedup_domain_hits(spark, d):
    wide = hits(spark, d).withColumn("seq_id", F.col("seq_id") % 100).withColumn("start", F.col("start") % 4000).withColumn("end", F.col("start") + 200 + F.col("hit_id") % 300)
    return rollup.dedup_domain_hits(wide).select("hit_id", "seq_id", "domain", "strand", "start", "end")


def o33_representative_hit(spark, d):
    return rollup.representative_hit(hits(spark, d))


def o34_architecture_order(spark, d):
    return rollup.architecture_order(rollup.representative_hit(hits(spark, d)), "INT", "RT")


def flags(spark, d):
    """Flags of all elements; every thirteenth domain scan did not run and has no hits."""
    failed = derive(spark, d, "evidence").where("seq_id % 13 = 0").select("seq_id")
    return rollup.element_flags(hits(spark, d).where("seq_id % 13 <> 0"), derive(spark, d, "evidence"), failed)


def o35_classify_elements(spark, d):
    return rollup.classify_elements(flags(spark, d)).select("seq_id", "class", "te_class", "is_erv")


def o36_confidence_tier(spark, d):
    return rollup.classify_elements(flags(spark, d)).select("seq_id", "te_class", "confidence")


def o37_completeness_ledger(spark, d):
    return rollup.completeness_ledger(flags(spark, d))


def o38_coding_frames(spark, d):
    return rollup.coding_frames(hits(spark, d).withColumn("seq_id", F.col("seq_id") % 1000), derive(spark, d, "orfs"))


def o40_encloses(spark, d):
    outer = derive(spark, d, "evidence").where("kind IN ('LTR', 'TIR')").select("seq_id", F.col("start").alias("o_id"), "start", "end")
    return rollup.encloses(outer, hits(spark, d).select("seq_id", F.col("hit_id").alias("i_id"), "start", "end"))


def o41_order_string(spark, d):
    return rollup.classify_elements(flags(spark, d)).select("seq_id", "architecture")


def o42_explain_call(spark, d):
    return rollup.explain_call(rollup.classify_elements(flags(spark, d)), derive(spark, d, "evidence"))


def o44_unsearched_scope(spark, d):
    return rollup.unsearched_scope(derive(spark, d, "orfs"), hits(spark, d))


def o45_composite_flag(spark, d):
    return flags(spark, d).select("seq_id", (F.col("rt") & F.col("tpase")).alias("composite"), "tp_conflict")


def o46_ontology_term(spark, d):
    f = flags(spark, d)
    return rollup.ontology_term(rollup.classify_elements(f), rollup.completeness_ledger(f))


def _manifest(spark, d):
    o = derive(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("run_type"), F.col("o_custkey").alias("input"), F.col("o_orderdate").cast("string").alias("created_utc"), F.col("o_orderstatus").alias("params"))


def o61_seal(spark, d):
    return provenance.seal(_manifest(spark, d), "run_id")


def o61_table_seal(spark, d):
    return provenance.table_seal(provenance.seal(_manifest(spark, d), "run_id"), "run_id")


def o62_seal_audit(spark, d):
    m = _manifest(spark, d).withColumn("input_id", F.col("input")).drop("run_id", "run_type")
    return provenance.seal_audit(provenance.seal(m, "input_id"))


def _parameters(spark, d, sealed: bool):
    """Parameters of each order: those that are derived, and those that its seal kept of them."""
    o = derive(spark, d, "orders")
    k = F.col("o_orderkey")
    pairs = [("detectors.ltr.min_len", "o_custkey", k % 7 == 1), ("detectors.tir.seed", "o_orderpriority", k % 5 == 2), ("scan.budget", "o_orderstatus", k % 11 == 3)]
    every = [F.struct(F.lit(key).alias("key"), (F.when((k % 13 == 0), F.lit("other")).otherwise(F.col(c).cast("string")) if sealed and key == "scan.budget" else F.col(c).cast("string")).alias("value"), (gone if sealed else F.lit(False)).alias("gone")) for key, c, gone in pairs]
    every.append(F.struct(F.lit("library.release" if sealed else "library.path").alias("key"), F.lit("r").alias("value"), (k % 3 > 0).alias("gone")))
    held = F.filter(F.array(*every), lambda x: ~x["gone"])
    return o.select(k.alias("run_id"), F.map_from_entries(F.transform(held, lambda x: F.struct(x["key"], x["value"]))).alias("parameters"))


def o62_seal_coverage(spark, d):
    return provenance.seal_coverage(_parameters(spark, d, False), _parameters(spark, d, True))


def o65_run_status(spark, d):
    o = derive(spark, d, "lineitem")
    units = o.select(F.col("l_suppkey").alias("genome"), F.col("l_partkey").alias("unit"))
    return provenance.run_status(units, o.where("l_linestatus = 'F'").select(F.col("l_suppkey").alias("genome"), F.col("l_partkey").alias("unit")))


def o66_runtime_model(spark, d):
    o = derive(spark, d, "lineitem")
    runs = o.select(F.col("l_suppkey").alias("job"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"), F.col("l_quantity").cast("long").alias("size"), (F.col("l_partkey") % 90 + F.col("l_quantity").cast("long")).alias("secs"))
    runs = runs.groupBy("job", "at").agg(F.max("size").alias("size"), F.max("secs").alias("secs"))
    return provenance.runtime_model(runs, derive(spark, d, "supplier").select(F.col("s_suppkey").alias("job"), (F.col("s_nationkey") * 5 + 1).cast("long").alias("size"))).withColumn("eta_s", F.round("eta_s", 6))


_REP = """rep AS (SELECT seq_id, domain, hit_id, class, score, strand, start, "end" FROM (SELECT *, row_number() OVER (PARTITION BY seq_id, domain ORDER BY score DESC, hit_id) AS rn FROM domain_hits) WHERE rn = 1)"""
_ORD = """ord AS (SELECT a.seq_id, a.strand = b.strand AND (a."end" <= b.start OR b."end" <= a.start) AS resolvable, CASE WHEN a.strand = b.strand AND (a."end" <= b.start OR b."end" <= a.start) THEN CASE WHEN a.strand = '-' THEN a."end" > b."end" ELSE a.start < b.start END END AS a_before_b
    FROM rep a JOIN rep b ON a.seq_id = b.seq_id AND a.domain = 'INT' AND b.domain = 'RT')"""
_FLAGS = f"""dh AS (SELECT * FROM domain_hits WHERE seq_id % 13 <> 0), {_REP.replace("FROM domain_hits", "FROM dh")}, {_ORD}, cod AS (SELECT seq_id, bool_or(domain = 'RT') AS rt, bool_or(domain = 'INT') AS intg, bool_or(domain = 'TPase') AS tpase, bool_or(domain = 'YR') AS yr, bool_or(domain = 'CHR') AS chromo, bool_or(domain = 'ENV') AS env, bool_or(domain = 'GAG') AS gag, bool_or(domain = 'PR') AS pr,
        bool_or(domain = 'RNaseH') AS rnaseh, bool_or(domain = 'ORF1') AS orf1, bool_or(domain = 'EN') AS en, bool_or(domain = 'HEL') AS hel, bool_or(model IN ('Gag_p24', 'PEG10_N-capsid')) AS core, list(DISTINCT domain) AS found, count(DISTINCT domain) AS n_domains, count(DISTINCT class) FILTER (WHERE domain = 'TPase') > 1 AS tp_conflict FROM dh GROUP BY seq_id),
    mark AS (SELECT seq_id, bool_or(kind = 'LTR') AS ltr, bool_or(kind = 'TIR') AS tir, bool_or(kind IN ('polyA', 'polyT')) AS poly, max(length) FILTER (WHERE kind = 'TIR') AS tir_len, arg_min(start, (start, "end")) FILTER (WHERE kind = 'TIR') AS a_start, arg_min("end", (start, "end")) FILTER (WHERE kind = 'TIR') AS a_end FROM evidence WHERE NOT advisory GROUP BY seq_id),
    fl AS (SELECT coalesce(cod.seq_id, mark.seq_id) AS seq_id, {", ".join(f"coalesce({c}, false) AS {c}" for c in ("rt", "intg", "tpase", "yr", "chromo", "env", "gag", "pr", "rnaseh", "orf1", "en", "hel", "core", "tp_conflict", "ltr", "tir", "poly"))}, coalesce(n_domains, 0) AS n_domains, coalesce(found, []) AS found, tir_len, a_start, a_end FROM cod FULL JOIN mark ON cod.seq_id = mark.seq_id),
    ahead AS (SELECT a.seq_id, a.strand = b.strand AND CASE a.strand WHEN '+' THEN a.start < b.start ELSE a."end" > b."end" END AS en_ok FROM rep a JOIN rep b ON a.seq_id = b.seq_id AND a.domain = 'EN' AND b.domain = 'RT'),
    flags AS (SELECT fl.*, coalesce(en_ok, false) AS en_ok, coalesce(resolvable, false) AS readable, a_before_b AS int_first, t.class AS tp_class, tir AND coalesce(a_start <= t.start AND t."end" <= a_end, true) AS tir_ok, fl.seq_id IN (SELECT seq_id FROM evidence WHERE seq_id % 13 = 0) AS unscanned
        FROM fl LEFT JOIN ord ON ord.seq_id = fl.seq_id LEFT JOIN ahead ON ahead.seq_id = fl.seq_id LEFT JOIN rep t ON t.seq_id = fl.seq_id AND t.domain = 'TPase'),
    con AS (SELECT *, rt AND ltr AND env AND (intg OR NOT yr) AS is_erv, array_to_string(list_filter(['ORF1', 'GAG', 'PR', 'EN', 'RT', 'RNaseH', 'INT', 'YR', 'CHR', 'ENV', 'TPase', 'HEL'], lambda c: list_contains(found, c)), '-') AS architecture,
        CASE WHEN te_class LIKE 'DNA/%' THEN 'Class II' WHEN te_class IN ('DIRS', 'LINE', 'LTR/Copia', 'LTR/Gypsy', 'LTR/unclassified') THEN 'Class I' ELSE 'unclassified' END AS class,
        CASE WHEN unscanned THEN 'Candidate' WHEN rt AND NOT (yr AND NOT intg) AND intg AND ltr AND readable THEN CASE WHEN n_domains >= 2 AND NOT tpase THEN 'High' ELSE 'Moderate' END
            WHEN te_class = 'LINE' THEN CASE WHEN poly THEN 'Moderate' ELSE 'Candidate' END WHEN NOT rt AND tpase AND tp_conflict THEN 'Candidate' WHEN rt AND (ltr OR tir) OR tpase AND (ltr OR tir_ok) THEN 'Moderate' WHEN (rt OR tpase) AND n_domains >= 2 THEN 'Moderate' ELSE 'Candidate' END AS confidence
        FROM (SELECT *, CASE WHEN rt THEN CASE WHEN yr AND NOT intg THEN 'DIRS' WHEN intg AND ltr THEN CASE WHEN NOT readable THEN 'LTR/unclassified' WHEN int_first THEN 'LTR/Copia' ELSE 'LTR/Gypsy' END WHEN intg OR ltr OR chromo THEN 'LTR/unclassified' WHEN orf1 OR en OR rnaseh OR gag OR pr OR env THEN 'LINE' ELSE 'retro/unassigned' END
            WHEN tpase THEN 'DNA/' || CASE tp_class WHEN 'dna:hAT-C dimer' THEN 'hAT' WHEN 'dna:IS4' THEN 'IS4-like' WHEN 'dna:other' THEN 'unclassified' ELSE split_part(tp_class, ':', 2) END
            WHEN hel THEN 'unclassified' WHEN n_domains > 0 THEN CASE WHEN ltr THEN 'LTR/partial' WHEN gag OR env OR intg OR orf1 THEN 'retro/partial' ELSE 'unclassified' END
            WHEN ltr THEN 'LTR/structural-only' WHEN tir THEN CASE WHEN tir_len >= 20 THEN 'DNA/non-autonomous' ELSE 'repeat/structural-only' END ELSE 'none' END AS te_class FROM flags))"""
_LEDGER = """exp AS (SELECT *, CASE WHEN rt THEN CASE WHEN yr AND NOT intg THEN 'dirs' WHEN ltr OR intg THEN 'retro' ELSE 'line' END WHEN tpase THEN 'dna' ELSE 'rest' END AS way FROM con),
    ex AS (SELECT *, list_filter(CASE way WHEN 'dirs' THEN ['GAG', 'RT', 'RNaseH', 'YR'] WHEN 'retro' THEN CASE WHEN env THEN ['GAG', 'PR', 'RT', 'RNaseH', 'INT', 'ENV'] ELSE ['GAG', 'PR', 'RT', 'RNaseH', 'INT'] END WHEN 'line' THEN ['ORF1', 'EN', 'RT', '3′ tail (poly-A / poly-T)'] WHEN 'dna' THEN ['TPase', 'TIR (5′)', 'TIR (3′)'] ELSE string_split(architecture, '-') END, lambda c: c <> '') AS e FROM exp),
    pr1 AS (SELECT *, list_filter(e, lambda c: CASE WHEN c LIKE 'TIR%' THEN tir_ok WHEN c LIKE '3%' THEN poly WHEN c = 'EN' AND way = 'line' THEN en_ok ELSE list_contains(found, c) END) AS p FROM ex),
    pm AS (SELECT *, list_filter(e, lambda c: NOT list_contains(p, c)) AS m FROM pr1),
    led AS (SELECT *, CASE way WHEN 'dirs' THEN CASE WHEN core AND m = [] THEN 'intact / autonomous-consistent' ELSE 'partial (DIRS core present: RT + tyrosine recombinase)' END
        WHEN 'retro' THEN CASE WHEN core AND intg AND ltr THEN CASE WHEN m = [] AND readable THEN 'intact / autonomous-consistent' ELSE 'near-complete' END WHEN core AND intg THEN 'coding core present (gag + pol' || CASE WHEN env THEN '; env' ELSE '' END || '); LTRs not confirmed'
            WHEN core THEN 'partial (gag + RT core present; integrase not confirmed)' WHEN intg THEN CASE WHEN m = [] THEN 'partial (pol core present; gag capsid/matrix not confirmed)' ELSE 'partial (pol core present)' END ELSE 'fragment' END
        WHEN 'line' THEN CASE WHEN m = [] THEN 'intact / autonomous-consistent' WHEN orf1 AND en_ok THEN 'near-complete (ORF1 + ORF2 endonuclease and RT recovered)' WHEN orf1 OR en_ok THEN 'partial (LINE coding core incomplete)' ELSE 'partial (RT only)' END
        WHEN 'dna' THEN CASE WHEN tir_ok THEN 'intact / autonomous-consistent' ELSE 'partial (transposase present)' END
        ELSE CASE WHEN n_domains > 0 THEN 'coding fragment (' || array_to_string(p, '–') || CASE WHEN ltr OR tir THEN ' detected; RT/pol not confirmed)' ELSE ' detected; no structural context)' END WHEN ltr OR tir THEN 'structural-only (terminal repeats, no coding domain detected)' ELSE 'none' END END AS tier,
        CASE way WHEN 'dirs' THEN 'DIRS-group retroelement (tyrosine recombinase)' WHEN 'retro' THEN CASE WHEN NOT ltr THEN 'retroelement (LTR not confirmed)' WHEN env THEN 'ERV (env-bearing LTR retroelement)' ELSE 'LTR retroelement' END WHEN 'line' THEN 'non-LTR retroelement (LINE-like)'
        WHEN 'dna' THEN CASE WHEN tir_ok THEN 'DNA transposon' ELSE 'DNA transposon (terminal repeats not confirmed)' END ELSE CASE WHEN ltr THEN 'LTR retroelement' WHEN tir THEN 'DNA transposon' WHEN n_domains > 0 THEN 'coding fragment' ELSE 'none' END END AS kind FROM pm)"""
_S = """sha256('{"input":' || o_custkey || ',"params":"' || o_orderstatus || '","run_type":"' || o_orderpriority || '"}')"""

ORACLES = {
    "o32_dedup_domain_hits": duck("""WITH h AS (SELECT hit_id, seq_id % 100 AS seq_id, domain, strand, score, start % 4000 AS start, start % 4000 + 200 + hit_id % 300 AS "end" FROM domain_hits),
        o AS (SELECT *, row_number() OVER (PARTITION BY seq_id, domain, strand ORDER BY score DESC, hit_id) AS i FROM h),
        g AS (SELECT seq_id, domain, strand, i, [struct_pack(id := hit_id, s := start, e := "end")] AS kept FROM o WHERE i = 1
            UNION ALL SELECT g.seq_id, g.domain, g.strand, o.i, CASE WHEN len(list_filter(kept, lambda k: k.s < o."end" AND o.start < k.e)) = 0 THEN list_append(kept, struct_pack(id := hit_id, s := o.start, e := o."end")) ELSE kept END
            FROM g JOIN o ON o.seq_id = g.seq_id AND o.domain = g.domain AND o.strand = g.strand AND o.i = g.i + 1),
        k AS (SELECT unnest(arg_max(kept, i)).id AS hit_id FROM g GROUP BY seq_id, domain, strand) SELECT hit_id, seq_id, domain, strand, start, "end" FROM h SEMI JOIN k USING (hit_id)""", "domain_hits"),
    "o33_representative_hit": duck(f"WITH {_REP} SELECT * FROM rep", "domain_hits"),
    "o34_architecture_order": duck(f"WITH {_REP}, {_ORD} SELECT * FROM ord", "domain_hits"),
    "o35_classify_elements": duck(f"WITH {_FLAGS} SELECT seq_id, class, te_class, is_erv FROM con", "domain_hits", "evidence"),
    "o36_confidence_tier": duck(f"WITH {_FLAGS} SELECT seq_id, te_class, confidence FROM con", "domain_hits", "evidence"),
    "o37_completeness_ledger": duck(f"WITH {_FLAGS}, {_LEDGER} SELECT seq_id, array_to_string(e, ',') AS expected, array_to_string(p, ',') AS present, array_to_string(m, ',') AS missing, tier, kind FROM led", "domain_hits", "evidence"),
    "o38_coding_frames": duck("""WITH h AS (SELECT hit_id, seq_id % 1000 AS seq_id, strand, start, "end" FROM domain_hits), p AS (SELECT h.seq_id, hit_id, min(orf_key) FILTER (WHERE o.start <= h.start AND h."end" <= o."end") AS host FROM h LEFT JOIN orfs o ON o.seq_id = h.seq_id AND o.strand = h.strand GROUP BY ALL),
        f AS (SELECT seq_id, count(DISTINCT host) AS frames, count(*) FILTER (WHERE host IS NULL) AS unplaced FROM p GROUP BY seq_id) SELECT *, CASE WHEN frames = 0 THEN 'not assessed' WHEN frames = 1 AND unplaced = 0 THEN 'single reading frame' ELSE 'split across reading frames' END AS state FROM f""", "domain_hits", "orfs"),
    "o40_encloses": duck("""SELECT h.seq_id, hit_id AS i_id, count(e.seq_id) AS n_enclosing, count(e.seq_id) > 0 AS encloses FROM domain_hits h LEFT JOIN evidence e ON e.seq_id = h.seq_id AND kind IN ('LTR', 'TIR') AND e.start <= h.start AND h."end" <= e."end" GROUP BY h.seq_id, hit_id""", "domain_hits", "evidence"),
    "o41_order_string": duck(f"WITH {_FLAGS} SELECT seq_id, architecture FROM con", "domain_hits", "evidence"),
    "o42_explain_call": duck(f"""WITH {_FLAGS}, k AS (SELECT seq_id, array_to_string(list_sort(list(DISTINCT kind)), ', ') AS kinds FROM evidence WHERE NOT advisory GROUP BY seq_id)
        SELECT con.seq_id, 'Classified as ' || te_class || ' (' || lower(confidence) || '). Structural: ' || coalesce(kinds, 'none') || '. Domains: ' || CASE WHEN architecture = '' THEN 'none' ELSE architecture END || '.' AS explanation FROM con LEFT JOIN k ON k.seq_id = con.seq_id""", "domain_hits", "evidence"),
    "o44_unsearched_scope": duck("SELECT seq_id, greatest(0, count(*) - 12) AS unscanned, seq_id IN (SELECT seq_id FROM domain_hits) AS ran FROM orfs GROUP BY seq_id", "domain_hits", "orfs"),
    "o45_composite_flag": duck(f"WITH {_FLAGS} SELECT seq_id, rt AND tpase AS composite, tp_conflict FROM flags", "domain_hits", "evidence"),
    "o46_ontology_term": duck(f"""WITH {_FLAGS}, {_LEDGER} SELECT seq_id, te_class, CASE WHEN te_class IN ('none', 'LTR/structural-only', 'repeat/structural-only') OR tier LIKE 'structural-only%' THEN 'repeat_region' WHEN starts_with(te_class, 'LTR/') THEN CASE WHEN list_contains(p, 'RT') THEN 'LTR_retrotransposon' ELSE 'repeat_region' END
        WHEN te_class = 'LINE' THEN 'LINE_element' WHEN te_class = 'DIRS' THEN 'YR_retrotransposon' WHEN starts_with(te_class, 'DNA/') THEN CASE WHEN list_contains(m, 'TIR (5′)') THEN 'DNA_transposon' ELSE 'terminal_inverted_repeat_element' END ELSE 'repeat_region' END AS so_term FROM led""", "domain_hits", "evidence"),
    "o61_seal": f"SELECT o_orderkey AS run_id, {_S} AS seal FROM orders",
    "o61_table_seal": f"""WITH s AS (SELECT {_S} AS seal FROM orders), e AS (SELECT seal, count(*) AS n, seal || ':' || count(*) AS entry FROM s GROUP BY seal), r AS (SELECT substr(seal, 1, 4) AS range, sum(n) AS n, sha256(string_agg(entry, chr(10) ORDER BY entry)) AS h FROM e GROUP BY 1)
        SELECT substr(range, 1, 2) AS shard, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(range || ':' || h, chr(10) ORDER BY range || ':' || h)) AS digest FROM r GROUP BY 1""",
    "o62_seal_audit": """WITH s AS (SELECT o_custkey AS i, sha256('{"input":' || o_custkey || ',"params":"' || o_orderstatus || '"}') AS s FROM orders), a AS (SELECT i, count(DISTINCT s) AS m FROM s GROUP BY i), b AS (SELECT s, count(DISTINCT i) AS m FROM s GROUP BY s)
        SELECT (SELECT count(*) FROM a) AS inputs, (SELECT count(*) FROM a WHERE m > 1) AS unstable, (SELECT count(*) FROM b) AS seals, (SELECT count(*) FROM b WHERE m > 1) AS shared""",
    "o62_seal_coverage": """WITH p AS (SELECT o_orderkey AS k, unnest([struct_pack(key := 'detectors.ltr.min_len', a := CAST(o_custkey AS VARCHAR), b := CASE WHEN o_orderkey % 7 <> 1 THEN CAST(o_custkey AS VARCHAR) END), struct_pack(key := 'detectors.tir.seed', a := o_orderpriority, b := CASE WHEN o_orderkey % 5 <> 2 THEN o_orderpriority END),
        struct_pack(key := 'scan.budget', a := o_orderstatus, b := CASE WHEN o_orderkey % 11 = 3 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'other' ELSE o_orderstatus END), struct_pack(key := 'library.path', a := CASE WHEN o_orderkey % 3 = 0 THEN 'r' END, b := NULL), struct_pack(key := 'library.release', a := NULL, b := CASE WHEN o_orderkey % 3 = 0 THEN 'r' END)]) AS x FROM orders)
        SELECT k AS run_id, x.key AS key, x.a AS derived, x.b AS sealed, CASE WHEN x.b IS NULL THEN 'not sealed' WHEN x.a IS NULL THEN 'not derived' ELSE 'differs' END AS state FROM p WHERE x.a IS DISTINCT FROM x.b""",
    "o65_run_status": """WITH u AS (SELECT l_suppkey AS genome, l_partkey AS unit, bool_or(l_linestatus = 'F') AS ok FROM lineitem GROUP BY ALL) SELECT genome, count(*) AS total, count(*) FILTER (WHERE ok) AS finished, count(*) FILTER (WHERE NOT ok) AS pending FROM u GROUP BY genome""",
    "o66_runtime_model": """WITH g AS (SELECT l_suppkey AS job, l_orderkey * 10 + l_linenumber AS t, max(CAST(l_quantity AS BIGINT)) AS size, max(l_partkey % 90 + CAST(l_quantity AS BIGINT)) AS secs FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY t DESC) AS rn FROM g),
        f AS (SELECT job, count(*) AS n, CAST(sum(size) AS BIGINT) AS sx, CAST(sum(secs) AS BIGINT) AS sy, CAST(sum(size * size) AS BIGINT) AS sxx, CAST(sum(size * secs) AS BIGINT) AS sxy, max(size) AS largest FROM r WHERE rn <= 40 GROUP BY job),
        q AS (SELECT s_suppkey AS job, s_nationkey * 5 + 1 AS size FROM supplier), j AS (SELECT q.*, f.* EXCLUDE (job), n * sxx - sx * sx AS d FROM q LEFT JOIN f ON f.job = q.job), k AS (SELECT *, CASE WHEN d <> 0 THEN (n * sxy - sx * sy) / d END AS slope FROM j), l AS (SELECT *, (sy - slope * sx) / n + slope * size AS line FROM k)
        SELECT job, CAST(size AS BIGINT) AS size, round(CASE WHEN n >= 2 AND d > 0 AND slope > 0 AND size <= 1.5 * largest AND line >= 1 THEN line WHEN sx > 0 THEN greatest(1.0, CASE WHEN n >= 2 AND d = 0 THEN sy / n ELSE sy / sx * size END) END, 6) AS eta_s, CASE WHEN n IS NULL THEN 'heuristic' ELSE 'calibrated' END AS basis, coalesce(n, 0) AS n FROM l""",
}

QUERIES = {k: v for k, v in list(globals().items()) if k[:1] == "o" and k[1:3].isdigit()}
