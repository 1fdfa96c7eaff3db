"""Suffix dedup, collocations and periodic runs against brute force, and their awkward rows."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from strandlake.llm import collocations, line_dedup, queries, runs, suffixes

LONG = "doc_id long, text string"


def removed(texts, length):
    """(bytes, removed, spans, kept) of each text, from all strings of length bytes."""
    places = {}
    for k, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            places.setdefault(t[i : i + length], []).append((k, i))
    marks = [bytearray(len(t)) for t in texts]
    for at in places.values():
        for k, i in at if len(at) > 1 else ():
            marks[k][i : i + length] = b"\1" * length
    return [(len(t), sum(m), sum(m[i] and not (i and m[i - 1]) for i in range(len(m))), bytes(c for c, x in zip(t, m) if not x)) for t, m in zip(texts, marks)]


@pytest.mark.parametrize("seed, bucket", [(1, 90), (2, 1 << 16)])
def test_suffix_dedup_removes_every_repeated_string(spark, monkeypatch, seed, bucket):
    monkeypatch.setattr(suffixes, "BUCKET", bucket)  # small buckets: equal suffixes meet across their ends
    rnd = random.Random(seed)
    word = lambda n: "".join(rnd.choice("abcdefghij é\n") for _ in range(n))
    passages = [word(rnd.randint(150, 500)) for _ in range(5)] + ["a" * 400, "ab" * 300]
    docs = []
    for _ in range(90):
        parts = []
        for _ in range(rnd.randint(0, 4)):
            p, a = rnd.choice(passages), rnd.randrange(150)
            p = rnd.choice([p, p[a : a + rnd.randint(50, 500)], word(rnd.randint(1, 400)), p[:a] + "X" + p[a + 1 :]])
            parts.append(p)
        docs.append("".join(parts))
    docs += [docs[3]] * 30 + [docs[5], docs[5], None, "", "x" * 199, "y\0" * 150]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(docs)]
    out = suffixes.cut_repeats(spark.createDataFrame(rows, LONG).repartition(5)).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == sorted(removed([(t or "").encode() for t in docs], 200))


def test_suffix_dedup_of_empty_and_clashing_tables(spark):
    assert suffixes.cut_repeats(spark.createDataFrame([], LONG)).count() == 0
    clash = spark.createDataFrame([(1, "a" * 201, b"x", 7), (1, "b" * 10, b"y", 8)], LONG + ", t binary, p int")
    assert sorted((r.n_bytes, r.n_removed) for r in suffixes.cut_repeats(clash).collect()) == [(10, 0), (201, 201)]


def test_a_task_forgets_what_it_met_and_still_finds_all_repeats(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "MET", 3)
    rnd = random.Random(11)
    word = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passages = [word(rnd.randint(220, 600)) for _ in range(4)]
    docs = []
    for _ in range(40):
        p, q, a = rnd.choice(passages), rnd.choice(passages), rnd.randrange(100)
        docs.append(word(rnd.randint(0, 90)) + p[a:] + rnd.choice([q, q[:a] + "X" + q[a:], word(30)]))
    out = suffixes.cut_repeats(spark.createDataFrame(list(enumerate(docs)), LONG).coalesce(1)).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == sorted(removed([t.encode() for t in docs], 200))


def test_a_bucket_takes_little_more_memory_than_its_bytes():
    column = [bytes([65 + i % 20]) * (200 - i % 7) + suffixes.END * (i % 7 > 0) for i in range(1 << 14)]
    tracemalloc.start()
    rows, size = suffixes._words(column, 200)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [bytes(r).rstrip(b"\0") for r in rows] == column and size.tolist() == [200 - i % 7 for i in range(1 << 14)]
    assert peak < 5 * rows.nbytes


def test_passages_that_one_neighbour_shares_leave_no_window_open(spark, monkeypatch):
    """Passages end inside an anchor's reach on both sides; the same neighbour is the best both ways."""
    rnd, open_ = random.Random(7), []
    word = lambda n: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(n))
    docs = []
    for _ in range(20):
        passage = word(240)
        docs += [word(300) + passage + word(300), word(250) + passage + word(350)]
    real = suffixes._open_windows
    monkeypatch.setattr(suffixes, "_open_windows", lambda found, rows, length: open_.append(rows.count()) or real(found, rows, length))
    out = suffixes.cut_repeats(spark.createDataFrame(list(enumerate(docs)), LONG)).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out) == sorted(removed([t.encode() for t in docs], 200))
    assert open_ == [0]


def test_texts_without_repeats_do_not_pass_through_python(spark, capsys):
    rows = [(1, "a" * 300), (2, "b" * 20), (3, "c" * 20)]
    suffixes.cut_repeats(spark.createDataFrame(rows, LONG)).explain("simple")
    assert capsys.readouterr().out.count("MapInArrow") == 1


def test_multikey_quicksort_orders_rows_of_words():
    rnd = np.random.default_rng(3)
    rows = rnd.integers(0, 3, (500, 6)).astype(np.uint64)
    assert [tuple(r) for r in rows[suffixes.multikey_quicksort(rows)]] == sorted(map(tuple, rows))


def counted(docs, threshold, top):
    """The collocations of (lang, text) rows by plain counting."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang, text = "und" if lang is None else lang, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for c in ".,;:!?\x0a\x0b\x0c\x0d":
            text = text.replace(c, ".")
        for piece in text.split("."):
            w = [x for x in piece.replace("\t", " ").split(" ") if x]
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    cand = {p: a for p, a in f.items() if len(p) > 2 and a >= threshold}
    inside = {(p[0], *p[i : i + k]): 1 for p, a in cand.items() for k in range(2, len(p) - 1) for i in range(1, len(p) - k + 1) if a >= f[(p[0], *p[i : i + k])]}
    out = []
    for p, a in cand.items():
        if p not in inside:
            score, _, l, r = min((1000 * a * n[p[0]] // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1))
            out.append((p[0], " ".join(p[1:]), a, l, r, n[p[0]], score))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    ranks = Counter()
    return [(x[0], ranks[x[0]], *x[1:]) for x in out if not ranks.update([x[0]]) and ranks[x[0]] <= top]


@pytest.mark.parametrize("chunk, partition", [(1 << 20, 1 << 22), (300, 1 << 11)])
def test_collocations_are_those_of_plain_counting(spark, monkeypatch, chunk, partition):
    # Small chunks and partitions: summaries are cut and handed on many times.
    for name, value in (("CHUNK", chunk), ("HELD", 4 * chunk), ("SLICE", chunk), ("PER_PARTITION", partition)):
        monkeypatch.setattr(collocations, name, value)
    rnd = random.Random(5)
    words = [f"{c}{i}" for i in range(6) for c in "aBÉ"] + ["K", "ab-c", "d e"]
    docs = []
    for _ in range(250):
        text = "".join(rnd.choice(words) + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".\n"]) for _ in range(rnd.randint(0, 90)))
        docs.append((rnd.choice(["x", "x", "x", "und", None]), text.replace(words[0], "new york city")))
    docs += [(None, None), ("empty", ""), ("x", "...\n"), ("x", "same words again " * 400)]
    rows = [(i, t, lang, 1) for i, (lang, t) in enumerate(docs)]
    got = collocations.collocations(spark.createDataFrame(rows, LONG + ", lang string, phrase int").repartition(7), threshold=12, top=70)
    want = counted(docs, 12, 70)
    assert len(want) > 60 and sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], LONG + ", lang string")).count() == 0


def test_cut_summaries_undercount_by_what_they_say():
    keys = np.arange(1000, dtype=np.uint64)
    counts = np.arange(1000, dtype=np.int64)[::-1] + 1
    left, n, cut = collocations.cut_to(keys, counts, 50)
    assert len(left) <= 50 and (counts[left.astype(int)] == n + cut).all() and set(keys[counts > cut]) == set(left)


def plain_runs(w, least=24, times=3):
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, times * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_are_those_of_every_period():
    rnd = random.Random(1)
    for _ in range(400):
        w = []
        for _ in range(rnd.randint(1, 6)):
            of = rnd.choice([1, 2, 3, 10, 1000])
            w += [rnd.randrange(of) for _ in range(rnd.choice([1, 2, 3, 5, 8, 13, 20, 40]))] * rnd.randint(1, 8)
            w = w * rnd.choice([1, 1, 2, 4]) + [rnd.randrange(2) for _ in range(rnd.choice([0, 60]))]
        assert runs.find_runs(np.array(w[:900], np.int64)) == plain_runs(w[:900])
    assert runs.find_runs(np.zeros(50_000, np.int64)) == [(0, 50_000, 1)]


def test_a_grammar_derives_its_text():
    ids = np.array([1, 2, 3] * 40 + [5] * 33 + [2, 3, 1] * 9, np.int64)
    rounds, top = runs.repair(ids)
    assert len(top) < 20
    for rule, start, middle, end in rounds:
        for r in range(int(rule.max()) + 1):
            same = {(tuple(ids[s:e]), m - s) for k, s, m, e in zip(rule, start, middle, end) if k == r}
            assert len(same) == 1


def test_periodic_runs_of_awkward_rows(spark):
    rows = [(1, "a b " * 12, 5, 0), (1, "a b " * 12, 5, 1), (None, None, 6, 0), (2, " \n\t ", 7, 0), (3, "x " * 23, 8, 0), (4, "pre " + "é " * 30 + "post", 9, 0)]
    out = runs.periodic_runs(spark.createDataFrame(rows, LONG + ", runs int, d int")).orderBy("doc_id", "d").collect()
    assert [([tuple(x) for x in r.runs], r.collapsed) for r in out] == [([], ""), ([(0, 24, 2)], "a b"), ([(0, 24, 2)], "a b"), ([], ""), ([], " ".join("x" * 23)), ([(1, 30, 1)], "pre é post")]
    assert out[0].d == 0 and runs.periodic_runs(spark.createDataFrame([], LONG)).count() == 0


def test_made_runs_follow_the_rule(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(90)), lambda i: F.concat(F.lit("w"), i)), " ").alias("text"))
    import zlib

    for r in queries.with_made_runs(docs).collect():
        w = [f"w{i}" for i in range(1, 91)]
        g, keep = divmod(zlib.crc32(str(r.doc_id).encode()), 10)
        a = g % 90
        p = 1 + (90 - a) // (3 + g % 8)
        assert r.text.split(" ") == (w if keep else [w[i] if i < a else w[a + (i - a) % p] for i in range(90)])


def test_hot_lines_on_few_sites_stay(spark):
    rows = [(i, f"hot on three sites\nown {i}\n" + ("everywhere" if i % 2 else "rare"), f"s{i % 3 if i % 2 == 0 else i % 9}") for i in range(3000)]
    rows = [(i, t if s in ("s0", "s1", "s2") else t.replace("hot on three sites\n", ""), s) for i, t, s in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line"), F.col("source").alias("site"), "doc_id")
    found = {r.line: r.boilerplate for r in line_dedup.boilerplate_lines(lines, hot_at=3).collect()}
    assert found == {"hot on three sites": False, "rare": False, "everywhere": True}
    out = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert out == {i: t.replace("\neverywhere", "") if i > 1 else t for i, t, _ in rows}
