"""Queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, decontaminate, license_scan, line_dedup, minhash, mixing, pii, runs, suffixes, topk, toxicity, warc
from .common import literal_rows, stored, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.told_apart(license_scan.license_scan(table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("text_chars"), F.sha2("text", 256).alias("text_sha256"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = literal_rows(spark, [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    back = chat_format.read_back(chat_format.format_chats(turns.unionByName(extra)))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _span(kind: str):
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(table(spark, sf_dir, "documents"))
    listed = lambda kinds: F.array_join(
        F.concat(*(F.transform(F.array_sort(k), _span(k)) for k in kinds)), ","
    )
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select(
        "doc_id", *counts[:4], F.sha2(listed(pii.PATTERNS), 256).alias("base_sha256"), listed(pii.KINDS).alias("spans"), *counts[4:], sum(F.size(k) for k in pii.KINDS).cast("long").alias("n_spans")
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.fair_mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit of a second replica in which a few records were damaged by a rule on their id: of 512, one has its first
    letter changed, one is cut to half, one is lost, and one stands in the second replica only. Ids and sizes are those
    read from the records themselves."""
    records = warc.to_records(table(spark, sf_dir, "pages"))
    parsed = F.regexp_extract(F.substring_index("record", warc.CRLF * 2, 1), r"<urn:md5:([0-9a-f]*)>", 1)
    records = records.select("page_id", parsed.alias("record_id"), "record")
    fate = F.conv(F.substring("record_id", 30, 3), 16, 10).cast("int") % 512
    copy = (
        F.when(fate == 0, F.concat(F.lit("V"), F.substring("record", 2, 1 << 30)))
        .when(fate == 1, F.substring("record", F.lit(1), F.floor(F.length("record") / 2).cast("int")))
        .otherwise(F.col("record"))
    )
    measured = records.select(
        "page_id", "record_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"), fate.alias("fate"), F.octet_length(copy).cast("long").alias("copy_length"), F.sha2(copy, 256).alias("copy_digest")
    )
    index = stored(warc.lay_out(measured), "warc-index")
    first = index.where("fate != 3")
    second = index.where("fate != 2").withColumns({"length": F.col("copy_length"), "digest": F.col("copy_digest")})
    return warc.audit(first, second)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffixes.cut_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def with_made_runs(docs: DataFrame) -> DataFrame:
    """docs in which every tenth text, by the hash of its id, runs periodically from a place of its own on."""
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    h = F.crc32(F.col("doc_id").cast("string"))
    some = docs.withColumn("w", F.when(h % 10 == 0, words)).withColumns({"n": F.size("w").cast("long"), "g": F.floor(h / 10)})
    some = some.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    some = some.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    made = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("w", at(i).cast("int"))), " ")
    return some.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = runs.periodic_runs(with_made_runs(table(spark, sf_dir, "documents")))
    wins = lambda a, r: r["length"] * a["period"] > a["length"] * r["period"]
    best = F.when(F.size("runs") > 0, F.reduce("runs", F.get("runs", F.lit(0)), lambda a, r: F.when(wins(a, r), r).otherwise(a)))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = out.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (op1_license_scan, op2_toxicity, op3_line_dedup, op4_chat_format, op5_decontaminate, op6_topk, op7_pii, op8_mixing, op9_warc, op10_minhash, op11_suffix_dedup, op12_collocations, op13_periodic_runs)
}


def _op1_sql() -> str:
    values = ", ".join(f"({n}, '{label}', '{word}', {len(set(text.split()))})" for n, (label, text) in enumerate(license_scan.TEMPLATES) for word in sorted(set(text.split())))
    rules = ", ".join(
        f"({n}, {i}, {least}, {most}, '{word}')"
        for n, (label, text) in enumerate(license_scan.TEMPLATES)
        for i, (least, most, words) in enumerate(license_scan.telling_rules(label, set(text.split()), license_scan.TEMPLATES, 0.8))
        for word in words
    )
    return f"""
WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
t(n, label, word, size) AS (VALUES {values}),
r(n, rule, least, most, word) AS (VALUES {rules}),
w AS (SELECT doc_id, len(words) AS n_words, greatest(0, CAST(ceil(len(words) / 64.0) AS INT) - 2) AS last, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS p FROM docs),
nexts AS (SELECT *, lead(word) OVER o AS w1, lead(word, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
base AS (SELECT doc_id, p, CASE WHEN word = 'cc' AND w1 = 'by' THEN 'cc-by' WHEN word = 'general' AND w1 = 'public' AND w2 = 'license' THEN 'gpl'
        WHEN word = 'all' AND w1 = 'rights' AND w2 = 'reserved' THEN 'reserved' END AS label FROM nexts),
b AS (SELECT doc_id, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list_sort(list(DISTINCT label)) AS labels FROM base WHERE label IS NOT NULL GROUP BY doc_id),
blocks AS (SELECT DISTINCT doc_id, word, unnest([least(last, p // 64), greatest(0, p // 64 - 1)]) AS block FROM w WHERE word IN (SELECT word FROM t)),
m AS (SELECT doc_id, block, n, any_value(label) AS label, count(*) / any_value(size) AS c, count(*) AS common, any_value(size) AS size
      FROM blocks JOIN t USING (word) GROUP BY doc_id, block, n),
near AS (SELECT * FROM m WHERE common >= ceil(0.8 * size - 1e-9)),
wrong AS (SELECT DISTINCT doc_id, block, n FROM (SELECT near.doc_id, near.block, near.n, r.rule, r.least, r.most, count(b.word) AS held FROM near JOIN r ON r.n = near.n
          LEFT JOIN blocks b ON b.doc_id = near.doc_id AND b.block = near.block AND b.word = r.word GROUP BY ALL) WHERE held < least OR held > most),
found AS (SELECT doc_id, max(c) AS best, list(DISTINCT label) AS labels FROM near ANTI JOIN wrong USING (doc_id, block, n) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(b.n_base, 0) AS n_base, CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(b.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ',') AS labels,
       CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(f.best, 0.0::DOUBLE) END AS score
FROM docs d LEFT JOIN b USING (doc_id) LEFT JOIN found f USING (doc_id)"""


ORACLES = {
    "op1_license_scan": _op1_sql(),
    "op3_line_dedup": r"""
WITH parts AS (SELECT doc_id, coalesce('=' || source, 'null') AS site, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
lines AS (SELECT *, trim(regexp_replace(lower(part), '\s+', ' ', 'g')) AS line FROM parts),
boiler AS (SELECT line, min(doc_id) AS owner FROM lines WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 6),
kept AS (SELECT l.*, b.line IS NOT NULL AND l.doc_id <> b.owner AS gone FROM lines l LEFT JOIN boiler b ON l.line = b.line)
SELECT doc_id, CAST(count(*) FILTER (WHERE line <> '') AS INT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS INT) AS n_removed,
       length(coalesce(string_agg(part, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS text_chars,
       sha256(coalesce(string_agg(part, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM kept GROUP BY doc_id""",
    "op4_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM t),
e AS (SELECT *, replace(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c') AS body,
      replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c') AS head FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(CAST(sum(length(text)) FILTER (WHERE role = 'assistant') AS BIGINT), 0) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(body) + CASE WHEN before IS NULL OR before <> role THEN 4 + length(head) + 2 + 8 ELSE 3 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op6_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
      md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS draw FROM documents),
s AS (SELECT source, sum(size) AS source_size, CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM d GROUP BY source),
c AS (SELECT *, source_size * 2 AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS budget, sum(weight) OVER () AS all_weight,
      coalesce(sum(source_size * 2) OVER o, 0) AS full_before, coalesce(sum(weight) OVER o, 0) AS weight_before
      FROM s WINDOW o AS (ORDER BY source_size * 2 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT *, (budget - full_before) / (all_weight - weight_before) AS v FROM c),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(CAST(cap AS DOUBLE), weight * (SELECT coalesce(arg_min(v, cap / weight) FILTER (WHERE v <= cap / weight), max(cap / weight)) FROM v)) AS target FROM v),
q AS (SELECT d.*, t.source_size, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) AS done FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, round(target) - (done - size))) + greatest(0, least(size, round(target) - (done - size) - source_size)) AS BIGINT) AS taken FROM q""",
    "op12_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
q AS (SELECT lang, d, generate_subscripts(pieces, 1) AS i, unnest(pieces) AS piece FROM p),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM q),
g AS (SELECT lang, len(w) AS m, unnest(range(1, len(w) + 1)) AS i, w FROM w WHERE len(w) > 0),
f AS MATERIALIZED (SELECT lang, p, count(*) AS f, any_value(k) AS k FROM (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS p, k FROM g, range(1, 6) t(k) WHERE i + k - 1 <= m) GROUP BY lang, p HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS MATERIALIZED (SELECT lang, p, k AS size, f AS a, string_split(p, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT *, unnest(range(1, size)) AS k FROM c),
cuts AS (SELECT cut.lang, cut.p, cut.a, cut.k, l.f AS l, r.f AS r, n.n AS n, (1000::HUGEINT * cut.a * n.n) // (l.f::HUGEINT * r.f) AS score FROM cut
         JOIN f l ON l.lang = cut.lang AND l.p = array_to_string(cut.w[1:cut.k], ' ') JOIN f r ON r.lang = cut.lang AND r.p = array_to_string(cut.w[cut.k + 1:], ' ') JOIN n ON n.lang = cut.lang),
best AS (SELECT lang, p, a, n, score, l, r FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_ AS (SELECT lang, a, w, size, k, unnest(range(1, size - k + 2)) AS i FROM c, range(2, 5) t(k) WHERE size > k),
inside AS (SELECT DISTINCT c.lang, c.p FROM inner_ o JOIN c ON c.lang = o.lang AND c.p = array_to_string(o.w[o.i:o.i + o.k - 1], ' ') WHERE 100 * o.a >= 100 * c.a),
r AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM best ANTI JOIN inside USING (lang, p))
SELECT * FROM r WHERE rank <= 2000""",
    "op9_warc": r"""
WITH r AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, md5(coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')) AS record_id FROM pages),
w AS (SELECT page_id, record_id, replace('WARC/1.0~WARC-Type: response~WARC-Record-ID: <urn:md5:' || record_id || '>~WARC-Target-URI: ', '~', chr(13) || chr(10)) || url || chr(13) || chr(10) || 'Content-Length: ' || strlen(html)
      || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record FROM r),
m AS (SELECT page_id, record_id, strlen(record) AS length, sha256(record) AS digest, CAST('0x' || record_id[30:32] AS BIGINT) % 512 AS fate, strlen(substr(record, 1, length(record) // 2)) AS half FROM w),
f AS (SELECT *, CAST('0x' || md5(record_id || '|' || digest)[1:8] AS BIGINT) % greatest(1, (SELECT ceil(count(*) / 2048.0)::BIGINT FROM m)) AS file FROM m),
l AS (SELECT *, row_number() OVER o - 1 AS seq, CAST(coalesce(sum(length) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM f WINDOW o AS (PARTITION BY file ORDER BY record_id, digest, page_id))
SELECT page_id, record_id, file, seq, start, start + length AS "end", CASE fate WHEN 2 THEN 'missing' WHEN 3 THEN 'extra' ELSE 'altered' END AS status FROM l WHERE fate <= 3""",
}
