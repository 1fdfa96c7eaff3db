"""Personal data: pattern spans, and information-theoretic sanitisation of the terms around them.

Base spans (e-mail, IPv4, card and phone numbers) come from patterns that are checked afterwards. Places are found
without Python: ``split`` gives the stretches between matches, ``regexp_extract_all`` the matches, and running
lengths the offsets (in code points).

Secrets (the value that a name such as ``token`` or ``api_key`` is set to) are spans of the method's own kind ``secret``.

A term reveals a protected entity when the corpus says so. Most values stand in one text only, which is no evidence, so
values are counted in pools too: each value e alone, with those of its owner (domain of an e-mail address, /24 network
of an IP, first 6 digits of a card, first 4 of a phone number), and with all of its kind. For a term t in the ``window``
words before or after an entity of pool e: n(t, e) documents hold both so, n(t) hold t anywhere, n(e) hold e. The term
is disclosed where the first are ``min_support`` distinct texts at least, P(e | t) = n(t, e) / n(t) >= ``min_share`` and
log2(P(e | t) / P(e)) >= ``min_bits``.
Disclosed terms are spans of kind ``term`` wherever they stand in the window of an entity of that pool; entities are replaced by
their kind, terms by ``[TERM]`` or, where they are numbers, generalised to their magnitude (digits after the first
become 0).

A word is a run of characters that are neither white space nor ASCII punctuation, beside entities and in whole texts
alike; a word that runs on into an entity (``x12`` before ``.3.4.5``) is a piece of it and no term. All counts are of
rows: a row that is there three times counts three times in n(t, e), n(t), n(e) and the number of documents, so repeats
change no share. Texts with the same hash are one text for min_support, so copies lend no support.

Terms travel as 64-bit hashes. n(t) is a map-side combined count over the distinct words of each text, joined to the
candidates afterwards, so no word of the corpus is shuffled more than once per task.

Patterns are written so that Java neither recurses nor rescans: possessive repeats, and a local part of an address
only starts where a run of its characters starts or the last match ended.

Defined results: null and empty texts hold nothing; repeated rows get the same result each; a null doc_id is kept;
an empty table gives an empty table; ``find_pii`` ignores other columns, ``sanitise`` passes them through, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, packed, stored

_LOCAL = r"A-Za-z0-9._%+-"
#: Kind and pattern, in the order in which spans are listed. The languages of the patterns.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The method's own kind: what a name for a secret is set to.
SECRET = r"""(?<=(?:token|secret|passwd|password|api_key|apikey|api-key|access_key|auth_key|private_key)["']?\x20{0,2}[:=]\x20{0,2}["']?)(?<![A-Za-z0-9+/_.~=-])[A-Za-z0-9+/_.~-]{12,}+"""
ENTITIES = PATTERNS | {"secret": SECRET}
KINDS = (*ENTITIES, "term")
_WORD, _GAP = r"[^\s\p{Punct}]", r"[\s\p{Punct}]"
SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(digits)),
        F.lit(0),
        lambda a, i: a
        + F.element_at(
            F.when((F.length(digits) - i) % 2 == 1, F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)))).otherwise(F.array(*map(F.lit, range(10)))),
            F.substring(digits, i, F.lit(1)).cast("int") + 1,
        ),
    )
    return total % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(F.length(_digits(value)).between(16, 19), _luhn(_digits(value))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    if kind == "secret":
        return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.lit(True)


def spans_of(kind: str, text: Column, might: Column) -> Column:
    """Spans of a kind; might: a cheap test that a text without it has none."""
    pattern = ENTITIES[kind]
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    zero = F.array().cast(SPAN)

    def add(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        return F.struct(
            end.cast("bigint").alias("at"),
            F.when(_valid(kind, pair["value"]), F.concat(acc["spans"], F.array(F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), pair["value"].alias("value"))))).otherwise(acc["spans"]).alias("spans"),
        )

    pairs = F.zip_with(found, gaps, lambda v, g: F.struct(g.alias("gap"), v.alias("value")))
    pairs = F.filter(pairs, lambda p: p["value"].isNotNull())
    walked = F.aggregate(pairs, F.struct(F.lit(0).cast("bigint").alias("at"), zero.alias("spans")), add, lambda acc: acc["spans"])
    return F.when(might, walked).otherwise(zero)


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, h, text and an array of spans for each kind of entity."""
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    digit = F.col("text").rlike("[0-9]")
    might = {
        "email": F.contains("text", F.lit("@")),
        "ip": digit & F.col("text").rlike(r"[0-9]\.[0-9]"),
        "card": digit & F.col("text").rlike(r"[0-9][\x20-]?[0-9]"),
        "phone": F.contains("text", F.lit("+")),
        "secret": F.col("text").rlike("(?:token|secret|passw|key)[a-z]*[\"']?\\x20{0,2}[:=]"),
    }
    return slim.select("doc_id", "h", "text", *(spans_of(k, F.col("text"), might[k]).alias(k) for k in ENTITIES))


def _tagged(kind: str) -> Column:
    return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(kind).alias("kind")))


def _lowered(c: Column) -> Column:
    """ASCII letters in lower case: other letters lower by their surroundings, and words stand in several."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def term_hash(term: Column) -> Column:
    return F.xxhash64(_lowered(term))


def _owner(e: Column) -> Column:
    """What values of one owner share: the domain of an e-mail address, or the first digits of a number."""
    return (
        F.when(e["kind"] == "email", ascii_lower(F.substring_index(e["value"], "@", -1)))
        .when(e["kind"] == "ip", F.substring_index(e["value"], ".", 3))
        .when(e["kind"] == "secret", e["value"])
        .otherwise(F.substring(_digits(e["value"]), F.lit(1), F.when(e["kind"] == "card", 6).otherwise(4)))
    )


def pools(e: Column) -> Column:
    """Hashes of what an entity counts for: its value, its owner, its kind."""
    return F.array(F.xxhash64(e["kind"], e["value"]), F.xxhash64(e["kind"], F.lit("owner"), _owner(e)), F.xxhash64(e["kind"]))


def contexts(found: DataFrame, window: int, reach: int = 400) -> DataFrame:
    """One row for each word within window words of an entity, and each pool of it: doc_id, h, entity (the pool), term,
    start, end.

    reach: characters looked at first; where they do not hold window words and what ends the last, four times
    as many, and so on up to the end of the text, so no word is cut or left out. Words before are taken from the turned text.
    """
    entities = F.concat(*(_tagged(k) for k in ENTITIES))
    each = found.select("doc_id", "h", "text", F.explode(entities).alias("e"))
    # a word that touches the entity is a piece of it and none of the window
    heads = rf"^{_WORD}*+(?:{_GAP}++{_WORD}++){{0,{window}}}+"
    full = rf"^{_WORD}*+(?:{_GAP}++{_WORD}++){{{window}}}{_GAP}"
    first, last = F.col("e.start"), F.col("e.end")

    def before(n):
        n = F.least(n, first)
        return F.reverse(F.substring("text", (first - n).cast("int") + 1, n.cast("int")))

    def after(n):
        return F.substring("text", last.cast("int") + 1, F.least(n, F.lit((1 << 31) - 1)).cast("int"))

    def head(side, all_of):
        def wider(acc, _):
            enough = side(acc["n"]).rlike(full) | all_of(acc["n"])
            return F.when(acc["done"], acc).otherwise(F.when(enough, F.struct(acc["n"].alias("n"), F.lit(True).alias("done"))).otherwise(F.struct((acc["n"] * 4).alias("n"), F.lit(False).alias("done"))))

        # 12 steps: beyond any length of a string
        start = F.struct(F.lit(reach).cast("bigint").alias("n"), F.lit(False).alias("done"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, wider, lambda acc: F.regexp_extract(side(acc["n"]), heads, 0))

    sided = each.select(
        "doc_id",
        "h",
        pools(F.col("e")).alias("entity"),
        F.explode(
            F.array(
                F.struct(first.alias("at"), head(before, lambda n: n >= first).alias("side"), F.lit(True).alias("before")),
                F.struct(last.alias("at"), head(after, lambda n: F.length(after(n)) < n).alias("side"), F.lit(False).alias("before")),
            )
        ).alias("s"),
    ).select("doc_id", "h", "entity", "s.*")
    # Words and what separates them, in turn: running lengths give the distances from the entity.
    words = F.regexp_extract_all("side", F.lit(f"{_WORD}++"), F.lit(0))
    gaps = F.split("side", f"{_WORD}++", -1)
    pairs = F.filter(F.zip_with(words, gaps, lambda w, g: F.struct(w.alias("w"), F.length(g).alias("g"))), lambda p: p["w"].isNotNull())
    added = lambda acc, p: F.array(F.struct((acc["at"] + p["g"]).alias("start"), (acc["at"] + p["g"] + F.length(p["w"])).alias("end"), p["w"].alias("value")))
    placed = F.aggregate(
        pairs,
        F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(SPAN).alias("out")),
        lambda acc, p: F.struct(
            (acc["at"] + p["g"] + F.length(p["w"])).alias("at"),
            F.when(acc["at"] + p["g"] == 0, acc["out"]).otherwise(F.concat(acc["out"], added(acc, p))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    turned = lambda w: F.struct((F.col("at") - w["end"]).alias("start"), (F.col("at") - w["start"]).alias("end"), F.reverse(w["value"]).alias("value"))
    forth = lambda w: F.struct((F.col("at") + w["start"]).alias("start"), (F.col("at") + w["end"]).alias("end"), w["value"].alias("value"))
    near = F.when(F.col("before"), F.transform("placed", turned)).otherwise(F.transform("placed", forth))
    out = sided.select("doc_id", "h", "entity", "at", "before", placed.alias("placed")).select("doc_id", "h", "entity", F.explode(near).alias("w"))
    placed_terms = out.select("doc_id", "h", "entity", term_hash(F.col("w.value")).alias("term"), F.col("w.start").alias("start"), F.col("w.end").alias("end")).where(F.length("w.value") > 1)
    return placed_terms.withColumn("entity", F.explode("entity"))


def disclosed_terms(docs: DataFrame, found: DataFrame, near: DataFrame, min_support: int, min_share: float, min_bits: float) -> DataFrame:
    """(term, entity) pairs in which the term gives the entity away. found: a row per row of docs with its spans."""
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))
    # rows that hold entities, with how often each is there
    times = found.where(F.greatest(*(F.size(k) for k in ENTITIES)) > 0).groupBy("doc_id", "h").agg(F.count("*").alias("times"))
    pairs = near.groupBy("term", "entity", "doc_id", "h").agg(F.lit(1).alias("one")).alias("p").join(times.alias("t"), same("p", "t")).select("term", "entity", "p.h", "times")
    together = pairs.groupBy("term", "entity", "h").agg(F.sum("times").alias("n")).groupBy("term", "entity").agg(F.sum("n").alias("n_te"), F.count("*").alias("texts"))
    together = stored(together.where(F.col("texts") >= min_support).drop("texts"), "pii-together")
    held = near.select("entity", "doc_id", "h").distinct()
    of_entity = held.alias("p").join(times.alias("t"), same("p", "t")).groupBy("entity").agg(F.sum("times").alias("n_e"))
    words = docs.select(F.array_distinct(F.split(_lowered(F.coalesce("text", F.lit(""))), f"{_GAP}++")).alias("words"))
    of_term = words.select(F.explode("words").alias("w")).groupBy(F.xxhash64("w").alias("term")).agg(F.count("*").alias("n_t"))
    told = together.join(of_term, "term").join(of_entity, "entity")
    share = F.col("n_te") / F.col("n_t")
    bits = F.log2(share * float(max(1, docs.count())) / F.col("n_e"))
    return told.where((share >= min_share) & (bits >= min_bits)).select("term", "entity")


def find_pii(docs: DataFrame, window: int = 8, min_support: int = 3, min_share: float = 0.5, min_bits: float = 4.0) -> DataFrame:
    """doc_id, h (hash of the text), the spans of each kind of entity and of kind term."""
    found = stored(base_spans(docs).drop("text"), "pii-spans")
    held = base_spans(docs).where(F.greatest(*(F.size(k) for k in ENTITIES)) > 0)
    near = stored(contexts(held, window), "pii-contexts")
    told = stored(disclosed_terms(docs, found, near, min_support, min_share, min_bits), "pii-disclosed")
    spans = near.join(told, ["term", "entity"]).groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("term"))
    same = F.col("f.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("f.h") == F.col("s.h"))
    out = found.alias("f").join(spans.alias("s"), same, "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select("f.doc_id", "f.h", *ENTITIES, F.coalesce("term", none).alias("term"))


def sanitise(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with every span replaced: entities by [KIND], terms by [TERM] or, if numbers, their magnitude."""
    every = F.concat(*(_placed(k) for k in KINDS))
    spans = found.dropDuplicates(["doc_id", "h"]).select(F.col("doc_id").alias("p_id"), F.col("h").alias("p_h"), F.array_sort(every).alias("spans")).where(F.size("spans") > 0)
    joined = packed(docs).join(spans, F.col("d.doc_id").eqNullSafe(F.col("p_id")) & (F.col("h") == F.col("p_h")), "left")
    whole = F.col("d.text")

    def replace(acc, s):
        value = F.substring(whole, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))
        number = value.rlike(r"^[0-9]+$") & (s["kind"] == "term")
        new = F.when(number, F.concat(F.substring(value, 1, 1), F.regexp_replace(F.substring(value, 2, 1 << 20), "[0-9]", "0"))).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        before = F.substring(whole, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        # a span inside the one before is covered already
        return F.when(s["start"] < acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(before, new)).alias("out")))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    text = F.aggregate("spans", start, replace, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(whole, acc["at"].cast("int") + 1, 1 << 30)))
    return joined.select(F.col("d").withField("text", F.when(F.col("spans").isNotNull(), text).otherwise(whole)).alias("d")).select("d.*")


def _placed(kind: str) -> Column:
    return F.transform(F.col(kind), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), F.lit(kind).alias("kind")))
