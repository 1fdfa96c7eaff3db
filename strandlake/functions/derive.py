"""Domain tables derived from the given tables, for Spark and, as text, for DuckDB.

Values with fractions are kept as integers (hundredths), so that sums are exact and do not depend on order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import spread

#: Letters of a text stand for bases.
LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"

_SEQ = f"translate(regexp_replace(lower(coalesce(text, '')), '[^a-z]', ''%s), '{LETTERS}', '{BASES}')"

#: SQL of each table; both engines run it (%g: DuckDB's flag to replace every match).
TABLES = {
    "seqs": "SELECT doc_id AS seq_id, lang, source, " + _SEQ.replace("%s", "%g") + " AS seq FROM documents",
    "passages": "SELECT item_id, " + _SEQ.replace("%s", "%g") + " AS seq FROM benchmark",
    "repeat_hits": """SELECT l_suppkey AS query, l_partkey * 10 AS q_start, l_partkey * 10 + CAST(l_quantity AS BIGINT) AS q_end,
        CASE WHEN l_returnflag = 'R' THEN '-' ELSE '+' END AS strand, p_brand AS family,
        CASE p_type WHEN 'ECONOMY' THEN 'LINE/L1' WHEN 'STANDARD' THEN 'LTR/Gypsy' WHEN 'PROMO' THEN 'DNA/hAT' WHEN 'SMALL' THEN 'Simple_repeat'
            WHEN 'MEDIUM' THEN CASE l_partkey % 4 WHEN 0 THEN 'scRNA' WHEN 1 THEN 'Unspecified' WHEN 2 THEN 'Satellite/centr' ELSE 'Unknown' END ELSE CASE l_partkey % 3 WHEN 0 THEN 'RC/Helitron' WHEN 1 THEN 'LINEage' ELSE 'rRNA' END END AS class_family,
        CAST(round(l_extendedprice * 100) AS BIGINT) AS score, CAST(round(l_discount * 100) AS BIGINT) AS divergence, CASE WHEN l_partkey % 5 > 0 THEN CAST(l_quantity AS BIGINT) END AS coverage,
        CASE WHEN l_linestatus = 'O' THEN l_orderkey % 500 END AS fragment_id, l_orderkey AS row_key, l_linenumber AS row_no
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "domain_hits": """SELECT event_id AS hit_id, user_id * 50 + event_id % 41 AS seq_id,
        CASE event_id % 12 WHEN 0 THEN 'GAG' WHEN 1 THEN 'PR' WHEN 2 THEN 'INT' WHEN 3 THEN 'RT' WHEN 4 THEN 'RNaseH' WHEN 5 THEN 'ENV'
            WHEN 6 THEN 'TPase' WHEN 7 THEN 'CHR' WHEN 8 THEN 'EN' WHEN 9 THEN 'ORF1' WHEN 10 THEN 'YR' ELSE 'HEL' END AS domain,
        CASE WHEN event_id % 12 <> 6 THEN 'core' ELSE CASE CAST(floor(event_id / 12) AS BIGINT) % 7 WHEN 0 THEN 'dna:hAT-C dimer' WHEN 1 THEN 'dna:Tc1-Mariner' WHEN 2 THEN 'dna:CACTA' WHEN 3 THEN 'dna:MULE' WHEN 4 THEN 'dna:IS4' WHEN 5 THEN 'dna:DDE' ELSE 'dna:other' END END AS class,
        CASE WHEN event_id % 12 = 0 THEN CASE event_id % 36 WHEN 0 THEN 'Gag_p24' WHEN 12 THEN 'zf-CCHC_5' ELSE 'PEG10_N-capsid' END ELSE 'other' END AS model,
        CAST(round(value * 100) AS BIGINT) AS score, CASE WHEN event_id % 2 = 0 THEN '+' ELSE '-' END AS strand,
        event_id * 7919 % 86400 AS start, event_id * 7919 % 86400 + 200 + event_id % 300 AS "end" FROM events""",
    "evidence": """SELECT c_custkey * 5 + CAST(c_nationkey AS BIGINT) AS seq_id, CASE c_custkey % 7 WHEN 0 THEN 'LTR' WHEN 1 THEN 'TIR' WHEN 2 THEN 'polyA' WHEN 3 THEN 'TSD' WHEN 4 THEN 'TIR' WHEN 5 THEN 'LTR' ELSE 'polyT' END AS kind,
        c_custkey % 5 = 0 AS advisory, c_custkey % 40 AS length, c_custkey * 13 % 20000 AS start, c_custkey * 13 % 20000 + 60000 AS "end" FROM customer""",
    "orfs": """SELECT o_orderkey AS orf_key, o_custkey AS seq_id, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand,
        o_orderkey % 3 + 1 AS frame, o_orderkey * 37 % 80000 AS start, o_orderkey * 37 % 80000 + 300 + o_orderkey % 600 * 3 AS "end" FROM orders""",
    "exons": """SELECT conv_id AS seq_id, turn, role, CAST(coalesce(sum(length(text) + 50) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
        CAST(sum(length(text) + 50) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) - 50 AS BIGINT) AS "end" FROM conversations""",
    "cases": """SELECT d.doc_id AS accession, d.lang AS panel, d.source AS tier, CASE WHEN l.quality = 1 THEN 'Class I' WHEN l.toxic = 1 THEN 'Class II' ELSE 'none' END AS expected,
        CASE WHEN d.n_chars % 5 = 0 THEN NULL WHEN d.n_chars % 5 < 3 THEN CASE WHEN l.quality = 1 THEN 'Class I' WHEN l.toxic = 1 THEN 'Class II' ELSE 'none' END
            WHEN d.n_chars % 5 = 3 THEN 'Class I' ELSE 'Class II' END AS call_a,
        CASE WHEN d.n_chars % 7 = 0 THEN NULL WHEN d.n_chars % 7 < 5 THEN CASE WHEN l.quality = 1 THEN 'Class I' WHEN l.toxic = 1 THEN 'Class II' ELSE 'none' END
            ELSE 'Class II' END AS call_b,
        CASE d.n_chars % 9 WHEN 0 THEN 'locus' WHEN 1 THEN 'genome' ELSE 'element' END AS record_scope, d.n_chars
        FROM labels l JOIN documents d ON d.doc_id = l.doc_id""",
    "corpus_rows": """SELECT doc_id AS case_id, CAST(floor(doc_id / 2) AS BIGINT) AS accession, CASE WHEN n_chars % 13 = 0 THEN 'containing' ELSE lang END AS panel, CASE WHEN n_chars % 13 = 0 THEN 'genome' WHEN n_chars % 5 = 1 THEN 'locus' ELSE 'element' END AS record_scope,
        CASE n_chars % 8 WHEN 0 THEN 'Class I, LTR retrotransposon' WHEN 1 THEN 'Class I (non-LTR)' WHEN 2 THEN 'Class I: SINE' WHEN 3 THEN ' Class II / TIR ' WHEN 4 THEN 'Not a TE (host gene)' WHEN 5 THEN 'Class II' WHEN 6 THEN 'falls outside the Wicker scheme' END AS expected_class,
        CASE n_chars % 23 WHEN 0 THEN 'Copia (Ty1)' WHEN 1 THEN 'Ty3/gypsy (family Huck)' WHEN 2 THEN ' Jockey' WHEN 3 THEN 'RTE/BovB' WHEN 4 THEN 'Tc1/Mariner-related MITE' WHEN 5 THEN 'hAT' WHEN 6 THEN 'P-element family' WHEN 7 THEN 'HML-2' WHEN 8 THEN 'copia-like' WHEN 9 THEN '' WHEN 10 THEN 'hAT' WHEN 11 THEN 'Copia (Ty1)' END AS expected_superfamily
        FROM documents""",
    "result_rows": """SELECT CASE WHEN doc_id % 29 = 0 THEN -doc_id - 1 ELSE doc_id END AS case_id,
        CASE n_chars % 11 WHEN 0 THEN 'LTR/Copia' WHEN 1 THEN 'LTR/Gypsy' WHEN 2 THEN 'LINE' WHEN 3 THEN 'DNA/hAT' WHEN 4 THEN 'retro/partial' WHEN 5 THEN 'repeat/structural-only' WHEN 6 THEN 'unclassified' WHEN 7 THEN 'SINE / Alu' WHEN 8 THEN 'Helitron' WHEN 9 THEN 'odd' END AS te_class,
        CASE n_chars % 7 WHEN 0 THEN 'Class I' WHEN 1 THEN 'Class II' WHEN 2 THEN 'unclassified' END AS class,
        CASE (n_chars + doc_id) % 17 WHEN 0 THEN 'Copia (Ty1)' WHEN 1 THEN 'Gypsy (Ty3) · chromovirus' WHEN 2 THEN 'hAT' WHEN 3 THEN 'Tc1/Mariner' WHEN 4 THEN 'LINE (non-LTR)' WHEN 5 THEN 'LTR retroelement fragment (GAG, PR; RT/pol not detected)' WHEN 6 THEN '2 domain(s) detected; no transposable-element assignment'
            WHEN 7 THEN 'no clear TE signature' WHEN 8 THEN 'hAT-like' WHEN 9 THEN 'retrotransposon (partial)' WHEN 10 THEN 'Copia (Ty1)' END AS superfamily,
        CASE n_chars % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Moderate' WHEN 2 THEN 'Candidate' END AS confidence,
        CASE n_chars % 6 WHEN 0 THEN concat(doc_id + 1, '-', doc_id + n_chars) WHEN 1 THEN 'NOT APPLICABLE (no span)' WHEN 2 THEN concat(doc_id + 2, '-', doc_id + n_chars) END AS coords_applied, CASE WHEN n_chars % 6 = 2 AND doc_id % 2 = 0 THEN n_chars - 1 ELSE n_chars END AS input_length
        FROM documents WHERE doc_id % 19 <> 0""",
    "first_inputs": "SELECT CAST(floor(doc_id / 2) AS BIGINT) AS accession, CASE WHEN doc_id % 7 <> 1 THEN md5(concat(lang, doc_id % 4)) END AS residue_sha, CASE WHEN doc_id % 5 <> 2 THEN md5(source) END AS fetch_sha FROM documents WHERE doc_id % 31 > 1",
    "second_calls": """SELECT CAST(floor(doc_id / 2) AS BIGINT) AS accession, CASE WHEN doc_id % 2 = 0 THEN 'plain' ELSE 'sensitive' END AS mode, CASE n_chars % 7 WHEN 0 THEN 'LTR' WHEN 1 THEN 'LINE' WHEN 2 THEN 'SINE' WHEN 3 THEN 'TIR' WHEN 4 THEN 'OTHER' ELSE 'NO_CALL' END AS call,
        CASE WHEN doc_id % 9 <> 4 THEN md5(concat(lang, doc_id % 4)) END AS residue_sha, CASE WHEN doc_id % 6 <> 3 THEN md5(source) END AS fetch_sha FROM documents WHERE doc_id % 3 <> 2""",
    "copies": """SELECT seq_id * 2 AS seq_id, seq FROM seqs UNION ALL SELECT seq_id * 2 + 1, substr(seq, 1, 12) || substr(seq, 13, 588) || substr(seq, 601, 400) || replace(substr(seq, 13, 588), 'GAC', 'GTC') || substr(seq, 1, seq_id % 9) FROM seqs WHERE length(seq) >= 1000""",
    "case_rows": """SELECT c_custkey AS case_id, CAST(floor(c_custkey / 10) AS BIGINT) AS accession, CASE c_custkey % 7 WHEN 0 THEN concat(c_custkey, '..', c_custkey + 500) WHEN 1 THEN concat('complement(join(', c_custkey, '..', c_custkey + 9, ',', c_custkey + 20, '..', c_custkey + 30, '))') END AS coords,
        CASE c_custkey % 5 WHEN 0 THEN 'urgent family' WHEN 1 THEN 'High, the medium' WHEN 2 THEN 'low' ELSE lower(c_mktsegment) END AS expected_superfamily FROM customer""",
    "case_features": """SELECT CAST(floor(o_custkey / 10) AS BIGINT) AS accession, o_orderkey AS feature, CASE o_orderkey % 6 WHEN 0 THEN 'mobile_element' WHEN 1 THEN 'LTR' WHEN 2 THEN 'misc_feature' ELSE 'gene' END AS kind, o_orderkey * 31 % 50000 AS start, o_orderkey * 31 % 50000 + o_orderkey % 900 AS "end",
        CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, concat(o_orderpriority, ' element') AS name FROM orders""",
    "arms": """SELECT seq_id, CAST(seq_id % 20 AS INT) AS s5, CAST(seq_id % 20 + 100 AS INT) AS e5, CAST(length(seq) - 140 - seq_id % 30 AS INT) AS s3, CAST(length(seq) - 40 - seq_id % 30 AS INT) AS e3 FROM seqs WHERE length(seq) >= 400""",
    "primers": """SELECT item_id AS pair_id, substr(seq, 1, 20) AS fwd, reverse(translate(substr(seq, length(seq) - 19, 20), 'ACGT', 'TGCA')) AS rev, length(seq) AS target
        FROM passages WHERE length(seq) >= 70""",
}

#: What each derived table is made of.
NEEDS = {
    "seqs": ["documents"],
    "passages": ["benchmark"],
    "repeat_hits": ["lineitem", "part"],
    "domain_hits": ["events"],
    "evidence": ["customer"],
    "orfs": ["orders"],
    "exons": ["conversations"],
    "cases": ["labels", "documents"],
    "corpus_rows": ["documents"],
    "result_rows": ["documents"],
    "first_inputs": ["documents"],
    "second_calls": ["documents"],
    "case_rows": ["customer"],
    "case_features": ["orders"],
    "arms": ["seqs"],
    "copies": ["seqs"],
    "primers": ["passages"],
}


def derive(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    """A given table (by its name) or one of TABLES. With a key, the given tables behind it are dealt out by it first."""
    if name not in TABLES:
        given = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(given, key) if key else given
    sql = TABLES[name].replace("%g", "").replace('"end"', "`end`")
    return spark.sql(_inlined(sql, NEEDS[name]), **{t: derive(spark, sf_dir, t, key) for t in NEEDS[name]})


def _inlined(sql: str, names: list[str]) -> str:
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}").replace(f"JOIN {n}", f"JOIN {{{n}}}")
    return sql


def duck(body: str, *names: str) -> str:
    """DuckDB SQL with the derived tables it names in front."""
    order: list[str] = []

    def add(n: str) -> None:
        if n in TABLES and n not in order:
            for m in NEEDS[n]:
                add(m)
            order.append(n)

    for n in names:
        add(n)
    head = ", ".join(f"{n} AS MATERIALIZED ({TABLES[n].replace('%g', chr(44) + ' ' + chr(39) + 'g' + chr(39))})" for n in order)
    if not head:
        return body
    return f"WITH RECURSIVE {head}" + (", " + body[len("WITH ") :] if body.startswith("WITH ") else " " + body)
