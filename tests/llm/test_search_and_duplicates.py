"""Brute-force checks of the operators that SQL can't express."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F
from strandlake.llm import decontaminate, minhash, topk

DOCS = "doc_id long, text string"


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_groups(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, len(s), low.get(find(i)) if d is not None else None, d is None or low[find(i)] == d) for i, (d, s) in enumerate(sets)), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)] + ["É", "naïve", "LOUD"]
    rows = [(None, "null id one two three four five six"), (1, None), (2, ""), (3, "one two"), (4, "One  two"), (5, " \t\n"), (6, "one two"), (6, "one two")]
    d = 10
    for size in (6, 12, 40, 300):
        for _ in range(6):
            base = [rng.choice(words) for _ in range(size)]
            for _ in range(rng.choice((1, 2, 8))):
                copy = list(base)
                for _ in range(rng.choice((0, 0, 1, 2, max(1, size // 40)))):
                    copy[rng.randrange(size)] = rng.choice(words)
                rows.append((d, " ".join(copy)))
                d += 1
    rows.append((d, " ".join(rng.choice(words) for _ in range(30000))))
    rng.shuffle(rows)
    return rows


def test_near_duplicates_match_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS + ", n_shingles int, key string")
    got = sorted((tuple(r)[:4] for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == brute_groups(rows)


def test_rows_that_share_an_id_keep_their_links(spark):
    rng = random.Random(4)
    texts = [[f"t{n}w{rng.randrange(900)}" for _ in range(80)] for n in range(3)]
    near = lambda t, *at: " ".join("x" if i in at else w for i, w in enumerate(t))
    a, b, c = texts
    # two texts under one id, each with a near copy; a row without id that alone bridges two others
    rows = [(6, near(a)), (6, near(b)), (7, near(a, 40)), (8, near(b, 40)), (1, near(c, 3, 9)), (None, near(c, 9)), (2, near(c, 9, 60)), (None, near(b)), (9, "lone text of six words here")]
    got = sorted((tuple(r)[:4] for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == brute_groups(rows)
    assert (7, 76, 6, False) in got and (8, 76, 6, False) in got and (2, 76, 1, False) in got


def test_prefix_filter_alone_matches_brute_force(spark):
    rows = corpus(7)
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((tuple(r)[:4] for r in minhash.near_duplicates(df, rounds=0).collect()), key=str)
    assert got == brute_groups(rows)


def test_near_duplicates_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1001, 1000), (5000, 4000)]
    random.Random(3).shuffle(edges)
    df = spark.createDataFrame([(max(e), min(e)) for e in edges], "member long, hub long").repartition(7)
    got = {r["node"]: r["component"] for r in minhash.components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 1001: 1000, 5000: 4000}


def test_super_minhash_estimates_and_early_stop():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    a, b = x[:300], x[100:]
    m = 1024
    same = (minhash.super_minhash(a, m) == minhash.super_minhash(b, m)).mean()
    assert abs(same - 0.5) < 0.08
    # every slot holds a layer and a fraction; a single element fills each slot from its own layer
    one = np.sort(np.floor(minhash.super_minhash(x[:1], 64)))
    assert one.tolist() == list(range(64))


def plain(text):
    b = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    return re.sub(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", b" ", b).strip()


def brute_edits(item, text):
    if len(text) > 10_000:  # far apart words of one long text can't help each other
        return min(brute_edits(item, text[:5000]), brute_edits(item, text[-5000:]))
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != t)))
        row = new
    return min(row)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéo") for _ in range(rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 40)))) for i in range(12)] + [(20, None), (21, ""), (22, "short"), (23, "two plus two"), (24, "-- ?!"), (25, "É"), (26, " a  b. "), (27, "twelve short words"), (3, "again another item with this id in the table")]
    docs = [(None, "before " + items[0][1]), (1, None), (2, ""), (3, items[1][1].upper() + "!!"), (3, items[1][1].upper() + "!!")]
    docs += [(4, "say two plus two here"), (5, "say two plvs two"), (6, "shorts and Short"), (7, "É éa"), (8, "a b"), (9, "aa b"), (100, "twelve shrt words"), (101, items[2][1] + " tail " * 40_000 + items[3][1])]
    for d in range(10, 60):
        body = [word() for _ in range(rng.randint(0, 120))]
        if d % 3 == 0:
            text = list(rng.choice(items[:12])[1])
            for _ in range(rng.choice((0, 1, 3, 8, 20))):
                at = rng.randrange(len(text))
                text[at : at + rng.choice((0, 1))] = rng.choice(("", "x", "yz"))
            body.insert(rng.randint(0, len(body)), "".join(text))
        docs.append((d, rng.choice((" ", ",\n")).join(body)))
    got = {
        (r["doc_id"], r["item_id"], r["edits"], r["max_edits"], round(r["similarity"], 9))
        for r in decontaminate.find_matches(spark.createDataFrame([(*d, "x") for d in docs], DOCS + ", leak string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=400).collect()
    }
    want = {}
    for d, t in docs:
        for i, item in items:
            p = plain(item)
            if not t or not p:
                continue
            k = len(p) // 10
            e = brute_edits(p, plain(t)) if k else int(f" {p.decode('latin-1')} " not in f" {plain(t).decode('latin-1')} ")
            if e <= k:
                want[d, i] = min((e, k, round(1 - e / len(p), 9)), want.get((d, i), (e, k, 1.0)))
    assert got == {(*key, *v) for key, v in want.items()}
    assert {(4, 23), (5, 23), (6, 22), (7, 25), (8, 26), (100, 27), (101, 2), (101, 3)} <= set(want) and (9, 26) not in want
    assert len(want) > 8


def test_decontamination_empty_tables(spark):
    empty, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "x y z")], DOCS)
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_matches(empty, items).count() == 0
    assert decontaminate.decontaminate(some, items).count() == 1
    rows = [(1, "the quick brown fox jumps over it", "a", "b"), (None, "the quick brown fox jumps over it", "a", "b"), (2, None, None, None)]
    clash = spark.createDataFrame(rows, DOCS + ", leak string, h string")
    fox = spark.createDataFrame([(7, "quick brown fox jumps")], "item_id long, text string")
    left = decontaminate.decontaminate(clash, fox)
    assert left.columns == clash.columns and [tuple(r) for r in left.collect()] == [rows[2]]


def brute_top(rows, k, is_query):
    v = [(i, [math.floor(256 * c) for c in x]) for i, x in rows if i is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for n, (q, x) in enumerate(v):
        if is_query(q):
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for m, (i, y) in enumerate(v) if m != n and len(y) == len(x))[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_top_k_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) + 3 * ((i % 7) == j) for j in range(8)]) for i in range(900)]
    rows += [(i, [0.5] * 8) for i in range(900, 1200)]  # ties and one hot vector
    rows += [(None, [1.0] * 8), (1300, None), (1350, [None] * 8), (1400, [float("nan")] * 8), (1450, [float("inf")] * 8), (1500, [1.0, 2.0]), (1550, [])]
    rows += [(950, [0.5] * 8), (50, [0.1] * 8), (0, []), (2, []), (1650, [3.0, 1.0]), (7, [5.0, 1.0])]
    df = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, min_pivots=16, block_rows=100).collect())
    f32 = [(i, x and [None if c is None else float(np.float32(c)) for c in x]) for i, x in rows]
    assert got == brute_top(f32, 5, lambda i: i % 50 == 0)


def test_top_k_few_rows_and_huge_values(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (50, [3.0, 1.0]), (51, [-1.0, 0.5])], "vec_id long, embedding array<double>")
    query = F.col("vec_id") % 50 == 0
    got = sorted(tuple(r) for r in topk.top_k(few, query).collect())
    assert got == brute_top([(0, [1.0, 2.0]), (50, [3.0, 1.0]), (51, [-1.0, 0.5])], 5, lambda i: i % 50 == 0)
    assert topk.top_k(few.limit(0), query).count() == 0
    huge = spark.createDataFrame([(0, [1e9, -2e9]), (7, [3e9, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(huge, query).collect()] == [(0, 1, 7, 2**63 - 1)]
