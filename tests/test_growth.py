"""Steps whose rows, memory or time must not grow faster than the input; results against plain loops."""

import random

from pyspark.sql import functions as F
from strandlake import plans
from strandlake.functions import tables
from strandlake.functions.derive import derive
from strandlake.operators import intervals, pcr, profile, repeats, rollup
from strandlake.sources import readers, writers
from strandlake.streaming import landscape

TURN = str.maketrans("ACGTRYN", "TGCAYRN")


def brute_sites(primers, seqs, max_mm, tp, min_anneal):
    out = []
    for pair, fwd, rev in primers:
        for name, p in (("F", fwd), ("R", rev)):
            for o, w in (("+", p), ("-", p[::-1].translate(TURN))):
                n = len(w)
                core = max(tp, min(min_anneal, n))
                for seq_id, s in seqs:
                    mine = []
                    for left in range(-n, len(s) + 1):
                        low, high = max(0, left), min(len(s), left + n)
                        if high - low < core or (o == "+" and left + n > len(s)) or (o == "-" and left < 0):
                            continue
                        x, y = w[low - left : high - left], s[low:high]
                        if o == "+":
                            x, y = x[::-1], y[::-1]
                        bad = [i + 1 for i, (a, b) in enumerate(zip(x, y)) if b not in pcr.COVERS[a]]
                        if any(b <= tp for b in bad) or sum(b <= core for b in bad) > max_mm:
                            continue
                        anneal = bad[max_mm] - 1 if len(bad) > max_mm else high - low
                        at = left + n - anneal if o == "+" else left
                        mine.append((pair, name, seq_id, o, at, at + anneal, sum(b <= anneal for b in bad), anneal, n - anneal))
                    out += [m for m in mine if m[7] == max(m[7] for m in mine)]
    return sorted(out)


def test_primer_places_are_looked_up_before_the_join(spark):
    rng = random.Random(31)
    bases = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    pairs = [(1, bases(20), bases(20)), (2, "ACGTRYNACGTTGCAAACGTAC", bases(12)), (3, bases(40), bases(20))]
    body = bases(9000)
    for at, p in ((0, pairs[0][1]), (3990, pairs[0][1]), (4400, pairs[0][2][::-1].translate(TURN)), (7996, pairs[2][1]), (8990, pairs[2][2][:10])):
        body = body[:at] + p + body[at + len(p) :]
    near = body[:3995] + "N" + body[3996:8000] + "T" + body[8001:]
    seqs = [(1, body), (2, near), (3, ""), (4, pairs[0][1][2:]), (5, "ACGTACACGTACGTTGCAAACGTAC" + bases(30)), (6, None)]
    p, s = spark.createDataFrame(pairs, "pair_id long, fwd string, rev string"), spark.createDataFrame(seqs, "seq_id long, seq string")
    whole = [(i, x or "") for i, x in seqs]
    for max_mm, min_anneal in ((2, 18), (0, 18), (0, 40), (1, 9)):
        got = sorted(tuple(r) for r in pcr.primer_sites(p, s, max_mm=max_mm, min_anneal=min_anneal).collect())
        assert got == brute_sites(pairs, whole, max_mm, 5, min_anneal) and got
    # a key that no primer has goes no further than the task that reads it
    keyed = spark.createDataFrame([(0, 5), (1, 1 << 17)], "no int, k long")
    places = pcr._places(s, keyed, [(18, 5, 9, "+"), (18, 5, 9, "-")], 5, 60, 4000)
    assert places.count() < 10 and {(r["no"], r["k"]) for r in places.collect()} <= {(0, 5), (1, 1 << 17)}


def test_end_windows_are_read_in_arrays(spark):
    rng = random.Random(32)
    mirror = str.maketrans("ACGTURYSWKMBDHVN", "TGCAAYRSWMKVHDBN")
    bases = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    arm = bases(90)
    texts = [arm + bases(100) + arm, arm + bases(70) + arm[::-1].translate(mirror), "ACGNU" * 30, bases(300, "AC"), bases(200, "ACGTNRUa"), "ACGT", "", None, arm[:40] + "N" + arm[41:] + bases(51) + arm[:60]]
    texts += [bases(70_000) + arm, "A" * 50]
    s = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    for k, window, turned in ((5, 120, False), (5, 120, True), (11, 6000, False), (11, 80, True)):
        five, three = repeats.end_words(s, k, window, turned=turned)
        want5, want3 = set(), set()
        for i, t in enumerate(x or "" for x in texts):
            w = min(window, len(t) // 2)
            if w < k:
                continue
            head, tail = [(p, t[p : p + k]) for p in range(w - k + 1)], [(p, t[p : p + k]) for p in range(len(t) - w, len(t) - k + 1)]
            tail = [(p, x[::-1].translate(mirror)) for p, x in tail] if turned else tail
            both = {x for x in {x for _, x in head} & {x for _, x in tail} if "N" not in x}
            want5 |= {(i, x, p) for p, x in head if x in both}
            want3 |= {(i, len(t), w, x, p) for p, x in tail if x in both}
        assert {tuple(r) for r in five.collect()} == want5 and {tuple(r) for r in three.collect()} == want3 and want3
    found = repeats.terminal_inverted_repeats(s, min_tir=4)
    assert {r["seq_id"]: r["tir_len"] for r in found.collect()}[1] >= 90
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "aggregate(" not in plan


def brute_direct(t, k, min_ltr, min_anchors, window):
    n, w = len(t), min(window, len(t) // 2)
    if w < max(min_ltr, k):
        return None
    pairs = [(p3, p5) for p5 in range(w - k + 1) for p3 in range(n - w, n - k + 1) if p3 > p5 + min_ltr and t[p5 : p5 + k] == t[p3 : p3 + k] and "N" not in t[p5 : p5 + k]]
    if not pairs:
        return None
    by = {}
    for p3, p5 in pairs:
        by.setdefault(p3 - p5, []).append((p3, p5))
    d = min(by, key=lambda x: (-len(by[x]), min(by[x])))
    near = [p5 for x in by if abs(x - d) <= 3 for _, p5 in by[x]]
    if len(near) < min_anchors:
        return None
    lo, hi = min(near), max(near) + k

    def walk(at, step, room):
        score = best = ext = 0
        for i in range(room):
            a, b = t[at + step * i], t[at + step * i + d]
            score += 1 if a == b != "N" else -2
            if score > best:
                best, ext = score, i + 1
            if score < best - 30:
                break
        return ext

    s5, e5 = lo - walk(lo - 1, -1, min(lo, window)), hi + walk(hi, 1, max(0, min(d - hi, n - d - hi, window)))
    a, size = t[s5:e5], e5 - s5
    if size < min_ltr or len(set(near)) < max(min_anchors, -(-(size - k + 1) // 100)) or max(map(a.count, "ACGT")) / size > 0.7 or len({a[i : i + 4] for i in range(size - 3)}) < max(4, 0.05 * (size - 3)):
        return None
    return s5, e5, s5 + d, e5 + d, round(100 * sum(x == y != "N" for x, y in zip(a, t[s5 + d : e5 + d])) / size, 6), e5 >= w


def test_terminal_repeats_make_no_row_for_a_pair_of_words(spark):
    rng = random.Random(33)
    bases = lambda n, letters="ACGT": "".join(rng.choice(letters) for _ in range(n))
    texts = []
    for _ in range(60):
        arm = bases(rng.randint(20, 120), rng.choice(("ACGT", "ACGT", "ACGTN", "ACGTRY", "AC")))
        again = "".join(rng.choice("ACGTN") if rng.random() < 0.04 else c for c in arm)
        at = rng.randint(0, len(again))
        again = again[:at] + rng.choice(("", "", "A", "CA")) + again[at:]
        texts.append(bases(rng.randint(0, 9)) + arm + bases(rng.randint(0, 150)) + again[: rng.choice((len(again), len(again) - 2))] + bases(rng.choice((0, 0, 7))))
    texts += ["ACGTACCA" * 60, "A" * 300, bases(900), "", None]
    s = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    for k, min_ltr, window in ((5, 20, 6000), (7, 12, 60)):
        found = repeats.terminal_direct_repeats(s, k, min_ltr, 4, window)
        got = {r["seq_id"]: (r["s5"], r["e5"], r["s3"], r["e3"], round(r["identity"], 6), r["lower_bound"]) for r in found.collect()}
        want = {i: b for i, t in enumerate(texts) if t and (b := brute_direct(t, k, min_ltr, 4, window))}
        assert got == want and len(want) > 20
    for made in (found, repeats.inverted_repeat_seeds(s)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Join" not in plan and "Exchange" not in plan
    # windows of one word: 9 million pairs for each sequence, counted a million at a time
    long = spark.createDataFrame([(1, "ACGTTGCA" * 1500 + "C"), (2, "T" * 12000)], "seq_id long, seq string")
    assert repeats.terminal_direct_repeats(long).count() == 0


def test_frames_are_split_in_arrays(spark):
    from strandlake.operators import profile

    rng = random.Random(34)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (0, 2, 3, 59, 60, 61, 62, 63, 400, 1300) for letters in ("ACGT", "ATG", "ACGTN")] + ["ATG" * 200, "TTA" * 90 + "CAT", None]
    found = profile.orf_table(spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string"), 3, 60)
    got = {tuple(r) for r in found.collect()}
    want = set()
    for i, t in enumerate(x or "" for x in texts):
        n = len(t)
        for strand, x in (("+", t), ("-", t[::-1].translate(TURN))):
            for f in range(3):
                s = None
                for p in range(f, n - 2, 3):
                    s = p if s is None and x[p : p + 3] == "ATG" else s
                    closed = x[p : p + 3] in profile.STOPS
                    if s is not None and (closed or p + 6 > n):
                        aa, e = (p + 3 - s) // 3 - closed, p + 3
                        if aa >= 3:
                            want.add((i, strand, f + 1, *((s, e) if strand == "+" else (n - e, n - s)), e - s, aa, not closed))
                    s = None if closed else s
    assert got == want and len(want) > 50
    assert "regexp_extract" not in found._jdf.queryExecution().toString()


def test_words_are_counted_where_their_sequence_is(spark):
    from collections import Counter

    from strandlake.operators import profile

    rng = random.Random(35)
    texts = ["".join(rng.choice(letters) for _ in range(n)) for n in (0, 3, 4, 5, 50, 51, 120, 400) for letters in ("ACGT", "AC", "ACGTNR")] + [None]
    s = spark.createDataFrame(list(enumerate(texts)), "seq_id long, seq string")
    k, bins, most = 4, 5, 6
    at = {(i, w): [p for p in range(len(t) - k + 1) if t[p : p + k] == w] for i, t in enumerate(x or "" for x in texts) for w in {t[p : p + k] for p in range(len(t) - k + 1)}}
    kmers, masked, cells = {}, {}, Counter()
    for (i, w), places in at.items():
        n = len(texts[i])
        if "N" not in w:
            old = kmers.get(w, (0, n, 0))
            kmers[w] = (old[0] + len(places), min(old[1], places[0]), old[2] + 1)
        if len(places) > most:
            old = masked.get(i, (0, 0))
            masked[i] = (old[0] + 1, old[1] + len(places))
            continue
        cells.update((i, "forward", p * bins // n, q * bins // n) for p in places for q in places if p <= q)
        turned = at.get((i, w[::-1].translate(TURN)), [])
        cells.update((i, "reverse", p * bins // n, q * bins // n) for p in places for q in turned if len(turned) <= most)
    for size in (50, 1 << 18):
        assert {r["kmer"]: (r["n"], r["first_pos"], r["records"]) for r in profile.kmer_counts(s, k, size).collect()} == kmers
        assert {r["seq_id"]: tuple(r)[1:] for r in repeats.masked_words(s, k, most, size).collect()} == masked
        assert {tuple(r)[:4]: r["cnt"] for r in repeats.self_similarity_matrix(s, k, bins, most, size).collect()} == cells
    plan = repeats.self_similarity_matrix(s, k, bins, most)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "MapInArrow" in profile.kmer_counts(s, k)._jdf.queryExecution().toString()


def brute_cover(spans):
    return len({x for a, b in spans for x in range(min(a, b), max(a, b))})


def test_landscape_sums_are_dealt_by_the_size_of_the_input(spark, tmp_path, monkeypatch):
    rng = random.Random(48)
    rows = []
    for i in range(600):
        a = rng.randrange(-20, 400)
        rows.append((rng.choice(["c1", "c2", None]), rng.choice(["LINE/L1", "rRNA", None]), a, rng.choice([a, a + rng.randrange(90), a - 7, a + 400, None]), rng.randrange(30)))
    rows.append(("c3", "all null", 5, None, 3))
    schema = "query string, class_family string, q_start long, q_end long, divergence long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "hits"))
    hits = spark.read.schema(schema).parquet(str(tmp_path / "hits"))
    for width in (16, 1 << 20):
        got = {(r["query"], r["class_family"]): r for r in intervals.contig_sums(hits, union=True, bin_width=width).collect()}
        assert set(got) == {r[:2] for r in rows}
        for key, r in got.items():
            mine = [x for x in rows if x[:2] == key]
            whole = [x[2:4] for x in mine if x[3] is not None]
            assert (r["n"], r["bp"]) == (len(mine), brute_cover(whole) if whole else None)
            assert r["weighted"] == (sum(d * abs(a - b) for _, _, a, b, d in mine if b is not None) if whole else None)
        for query in ("c1", "c2", None):
            assert sum(r["union_bp"] or 0 for k, r in got.items() if k[0] == query) == brute_cover([x[2:4] for x in rows if x[0] == query and x[3] is not None])
    land = {r["class_family"]: (r["n"], r["bp"]) for r in intervals.repeat_landscape(hits).collect()}
    assert set(land) == {"LINE/L1", "rRNA"} and all(land[c][0] == sum(x[1] == c for x in rows) for c in land)
    # twice the files, twice the tasks
    assert tables.shares(hits) == spark.sparkContext.defaultParallelism
    one = tables.shares(hits, 100)
    hits.write.mode("append").parquet(str(tmp_path / "more")), hits.write.mode("append").parquet(str(tmp_path / "more"))
    assert one > 4 and tables.shares(spark.read.parquet(str(tmp_path / "more")), 100) >= 1.5 * one
    monkeypatch.setattr(intervals, "shares", lambda df: tables.shares(df, 100))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = intervals.contig_sums(hits)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert f", {one}), REPARTITION_BY_NUM" in plan


def test_incremental_landscape_parses_lines_once(spark, tmp_path):
    hit = lambda q, a, b, c: f" 300 12.0 0.5 1.5 {q} {a} {b} (9) + F1 {c} 11 80 (20) 1"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "u1").write_text("\n".join([hit("c1", 1, 100, "LINE/L1"), hit("c1", 51, 150, "LINE/L1"), hit("c2", 1, 10, "rRNA"), "header", ""]))
    (tmp_path / "in" / "u2").write_text("no hits at all\n")
    folder = str(tmp_path / "run")
    landscape.incremental_landscape(spark, str(tmp_path / "in"), folder, {"library": "a"}).awaitTermination()
    units = {r["unit"]: r["length"] for r in spark.read.parquet(f"{folder}/units").collect()}
    assert units == {"u1": 160, "u2": 0}
    sums, lengths = landscape.unit_sums(spark.read.parquet(f"{folder}/hits"))
    for df in (sums, lengths):  # both from one stored table, not from the lines
        assert all("unit-sums" in f for f in df.inputFiles()) and df.inputFiles()
    assert {(r["class_family"], r["n"], r["bp"], r["width"]) for r in sums.collect()} == {("LINE/L1", 2, 150, 200), ("rRNA", 1, 10, 10)}
    plan = readers.parse_repeat_lines(spark.createDataFrame([("x",)], "value string"), [])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1


def test_letters_are_counted_in_arrays(spark, tmp_path):
    texts = ["ACGT acgt\tNn\n", "", None, "MKV*x\x0b\x0c\r w", "é ü ACG ß", "\u00a0\u2003K", "rywsRYkmbdhv", " \t", "A" * 3_000_000 + "é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    raw = profile.bare(docs)
    up = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    want = [None if x is None else "".join(c for c in x if c not in " \t\n\x0b\x0c\r").translate(up) for x in texts]
    assert [r["seq"] for r in raw.orderBy("seq_id").collect()] == want
    got = {r["seq_id"]: r for r in profile.composition(docs.select(F.col("doc_id").alias("seq_id"), F.col("text").alias("seq"))).collect()}
    for i, x in enumerate(texts):
        x = (x or "").translate(up)
        assert [got[i][c] for c in ("length", "a", "n", "ambiguous")] == [len(x), x.count("A"), x.count("N"), sum(x.count(c) for c in "RYSWKMBDHV")]
    gates = {(r["seq_id"], r["gate"]): r for r in profile.nucleotide_gates(raw, {"p": "protein", "d": "dna"}).collect()}
    assert len(gates) == 2 * len(texts) and gates[2, "d"]["reason"] == "not nucleotides" and gates[1, "d"]["reason"] == "empty"
    assert gates[4, "d"]["ratio"] == 0.5 and gates[4, "d"]["ok"] and gates[3, "p"]["ratio"] == 1.0 and gates[0, "p"]["reason"] == "looks like nucleotides"
    # one row group is one task of reading: its rows are dealt out before their texts are worked on
    docs.withColumns({"lang": F.lit("en"), "source": F.lit("s")}).write.parquet(str(tmp_path / "documents.parquet"))
    plan = derive(spark, str(tmp_path), "seqs", "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("regexp_replace") < plan.index("Repartition")


def test_spans_flags_and_lines_are_dealt_by_the_size_of_the_input(spark, tmp_path, monkeypatch):
    rng = random.Random(40)
    outer = [(rng.randrange(3), i, a, a + rng.choice([0, 50, 9000, 60000])) for i, a in enumerate(rng.randrange(20000) for _ in range(40))]
    inner = [(rng.randrange(4), i // 2, a, a + rng.randrange(400)) for i, a in enumerate(rng.randrange(30000) for _ in range(200))]
    for name, rows in (("o", outer), ("i", inner)):
        spark.createDataFrame(rows, f"seq_id long, {name}_id long, start long, `end` long").write.parquet(str(tmp_path / name))
    asked = []
    for module in (rollup, writers):
        monkeypatch.setattr(module, "shares", lambda df: asked.append(tables.shares(df, 300)) or asked[-1])
    got = rollup.encloses(spark.read.parquet(str(tmp_path / "o")), spark.read.parquet(str(tmp_path / "i")))
    want = {}
    for seq, i, s, e in inner:
        want[seq, i] = want.get((seq, i), 0) + sum(q == seq and a <= s and e <= b for q, _, a, b in outer)
    assert {(r["seq_id"], r["i_id"]): r["n_enclosing"] for r in got.collect()} == want and asked[-1] > 4
    assert got._jdf.queryExecution().optimizedPlan().toString().count(f", {asked[-1]}") == 3
    features = spark.createDataFrame([(1, "x", s, e, "+", 1.0, f"i{s}", None, "n") for _, _, s, e in inner], "seq_id int, kind string, start int, `end` int, strand string, score double, id string, parent string, name string")
    lines = writers.gff3_lines(features)
    places = [int(r["value"].split("\t")[3]) for r in lines.collect()]
    assert places == sorted(s + 1 for _, _, s, _ in inner) and "gff3-lines" in lines.inputFiles()[0]


def test_elements_never_go_whole_through_the_driver(spark, tmp_path, monkeypatch):
    rng = random.Random(41)
    events = [(i, rng.randrange(60), rng.randrange(9000) / 100) for i in range(4000)]
    spark.createDataFrame(events, "event_id long, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    customers = [(i, i % 25) for i in range(700)] + [(None, 3)]
    spark.createDataFrame(customers, "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    made, write = [], writers.write_gff3
    monkeypatch.setattr(writers, "write_gff3", lambda features, path: write(made.append(features) or features, path))
    lines = sorted(r["value"] for r in plans.QUERIES["k01_write_gff3"](spark, str(tmp_path)).collect())
    flags = plans.rollup.flags(spark, str(tmp_path))
    f = tables.stored(flags, "flags")
    calls, ledger = rollup.classify_elements(f), rollup.completeness_ledger(f)
    term = rollup.ontology_term(calls, ledger)
    # files of elements are small beside their rows: none of their joins may be planned by the bytes of files
    told = term.join(calls.select("seq_id", "confidence"), "seq_id").join(ledger.select("seq_id", "tier"), "seq_id").withColumn("scope", F.lit("12 domains; 50% of models"))
    none = spark.range(0).selectExpr("id AS seq_id", "'' AS kind", "1 AS start", "1 AS `end`", "1 AS length", "true AS advisory", "'' AS detail")
    given = writers.annotation_features(told.localCheckpoint(), f.select("seq_id", F.lit(90_000).alias("length")), none, derive(spark, str(tmp_path), "domain_hits").where("seq_id % 13 <> 0"))
    summary = repeats.record_summary(f.selectExpr("seq_id", "1 AS length", "1 AS a", "0 AS c", "0 AS g", "0 AS t", "0 AS n", "0 AS ambiguous", "0.0 AS gc_pct"), calls, derive(spark, str(tmp_path), "evidence"), ledger)
    explained = rollup.explain_call(calls, derive(spark, str(tmp_path), "evidence"))
    for df in (flags, made[0], term, given, explained, summary):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    # one pass over flags says what calls, ledger and terms joined say
    joined = term.join(calls.drop("te_class"), "seq_id").join(ledger, "seq_id")
    one = rollup.annotated_elements(f).where("seq_id IS NOT NULL")
    assert sorted(map(str, one.collect())) == sorted(map(str, joined.select(*one.columns).collect())) and one.count() > 1000
    assert lines == sorted(r["value"] for r in writers.gff3_lines(given).collect()) and len(lines) > 4000 and all(x[0].isdigit() for x in lines)
