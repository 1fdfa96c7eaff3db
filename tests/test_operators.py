"""Operators that SQL can't express against plain loops, and small literal cases."""

import random

from pyspark.sql import functions as F
from strandlake.operators import intervals, repeats, rollup
from strandlake.operators.profile import orf_table


def test_greedy_dedup_keeps_a_hit_that_only_overlaps_a_dropped_one(spark):
    rng = random.Random(1)
    rows = [(i, 1, "RT", "+", rng.randrange(400), rng.randrange(10)) for i in range(60)]
    df = spark.createDataFrame([(*r[:4], r[4], r[4] + 40, r[5]) for r in rows], "hit_id long, seq_id long, domain string, strand string, start long, end long, score long")
    kept = []
    for i, *_, start, score in sorted(rows, key=lambda r: (-r[5], r[0])):
        if all(start + 40 <= s or s + 40 <= start for _, s in kept):
            kept.append((i, start))
    assert {r["hit_id"] for r in rollup.dedup_domain_hits(df).collect()} == {i for i, _ in kept}


def test_introns_match_one_to_one(spark):
    a = spark.createDataFrame([(1, 100, 200), (1, 300, 400), (2, 5, 9)], "seq_id int, start long, end long")
    b = spark.createDataFrame([(1, 101, 199), (1, 102, 200), (1, 303, 400)], "seq_id int, start long, end long")
    got = {r["seq_id"]: tuple(r)[1:] for r in intervals.cross_check_introns(a, b).collect()}
    assert got == {1: (1, 2, 3, 1, 2), 2: (0, 1, 0, 1, 0)}


def test_dedup_by_rounds_and_across_bins_is_the_greedy_choice(spark, monkeypatch):
    monkeypatch.setattr(rollup, "BIN", 300)  # islands reach over several bins
    rng = random.Random(7)
    rows = [(i, rng.choice("ab"), "RT", "+", rng.randrange(40), s := rng.randrange(4000), s + rng.randrange(1, 700)) for i in range(500)]
    df = spark.createDataFrame(rows, "hit_id long, seq_id string, domain string, strand string, score long, start long, end long")
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[0])):
        if all(r[1] != k[1] or r[5] >= k[6] or k[5] >= r[6] for k in kept):
            kept.append(r)
    for folded in (0, 5, 10_000):
        monkeypatch.setattr(rollup, "FOLDED", folded)
        assert {r["hit_id"] for r in rollup.dedup_domain_hits(df).collect()} == {r[0] for r in kept}


def test_introns_of_one_large_record_match_in_order(spark):
    rng = random.Random(4)
    a = {(s := rng.randrange(600), s + 50 + rng.randrange(3)) for _ in range(300)}
    b = {(s := rng.randrange(600), s + 50 + rng.randrange(3)) for _ in range(300)}
    taken_a, taken_b = set(), set()
    for x, y in sorted((x, y) for x in a for y in b if abs(x[0] - y[0]) <= 2 and abs(x[1] - y[1]) <= 2):
        if x not in taken_a and y not in taken_b:
            taken_a.add(x)
            taken_b.add(y)
    frame = lambda rows: spark.createDataFrame([(9, *r) for r in sorted(rows)], "seq_id int, start long, end long")
    got = intervals.cross_check_introns(frame(a), frame(b)).first()
    assert tuple(got)[1:] == (len(taken_a), len(a), len(b), len(a) - len(taken_a), len(b) - len(taken_b))


def test_islands_across_bins_and_range_join(spark):
    rng = random.Random(2)
    rows = [(rng.choice("xy"), s := rng.randrange(3000), s + rng.randrange(1, 90)) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, start long, end long")
    covered = {k: set() for k in "xy"}
    for k, s, e in rows:
        covered[k].update(range(s, e))
    got = intervals.interval_islands(df, ["k"], bin_width=64).collect()
    assert sum(r["end"] - r["start"] for r in got) == sum(map(len, covered.values()))
    assert sum(r["n"] for r in got) == len(rows)
    pairs = intervals.range_join(df, df, ["k"], 50).count()
    assert pairs == sum(a[0] == b[0] and a[1] < b[2] and b[1] < a[2] for a in rows for b in rows)


def test_extension_by_frontier_is_that_of_whole_sequences(spark):
    rng = random.Random(6)
    base = "".join(rng.choice("ACGT") for _ in range(3000))
    far = base[:1700] + "".join(rng.choice("ACGT") for _ in range(900))
    seqs = spark.createDataFrame([(1, base), (2, base), (3, far), (4, base[:64]), (5, ""), (6, "T" + base)], "seq_id long, seq string")
    pairs = spark.createDataFrame([(10 * a + b, a, b) for a in range(1, 7) for b in range(1, 8)], "pair_id long, a_id long, b_id long")
    got = {r["pair_id"]: r["ext"] for r in repeats.xdrop_by_frontier(pairs, seqs, 6, first=64, growth=4).collect()}
    a, b = seqs.toDF("a_id", "a"), seqs.toDF("b_id", "b")
    want = {r["pair_id"]: r["ext"] for r in repeats.xdrop_extend(pairs.join(a, "a_id").join(b, "b_id"), 6).collect()}
    assert {k: v for k, v in got.items() if k % 10 < 7} == want and want[12] == 3000 and 1700 <= want[13] < 1720 and all(got[10 * a + 7] == 0 for a in range(1, 7))


def test_xdrop_matches_a_loop(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        a = "".join(rng.choice("ACGTN") for _ in range(rng.randrange(0, 60)))
        b = "".join(c if rng.random() < 0.8 else rng.choice("ACGT") for c in a) + "A" * rng.randrange(3)
        rows.append((i, a, b))
    df = spark.createDataFrame(rows, "i int, a string, b string")
    got = {r["i"]: r["e"] for r in df.select("i", repeats.xdrop(F.col("a"), F.col("b"), 6).alias("e")).collect()}
    for i, a, b in rows:
        score = best = ext = 0
        for n, (x, y) in enumerate(zip(a, b), 1):
            score += 1 if x == y != "N" else -2
            if score > best:
                best, ext = score, n
            if score < best - 6:
                break
        assert got[i] == ext


def element(rng, repeat, body):
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    ltr = base(repeat)
    return base(30) + ltr + base(body) + ltr + base(30)


def test_terminal_repeats(spark):
    rng = random.Random(4)
    rows = [(1, element(rng, 160, 1500)), (2, "".join(rng.choice("ACGT") for _ in range(3000))), (3, "AT" * 900), (4, "ACG")]
    found = {r["seq_id"]: r for r in repeats.terminal_direct_repeats(spark.createDataFrame(rows, "seq_id int, seq string")).where("not advisory").collect()}
    assert abs(found[1]["ltr_len"] - 160) <= 12 and found[1]["identity"] >= 95
    assert abs(found[1]["s5"] - 30) <= 10 and 2 not in found and 4 not in found


def test_open_reading_frames(spark):
    codons = "ATG" + "GCA" * 50
    rows = [(1, "TAA" + codons + "TAG"), (2, codons), (3, "CTA" + "TGC" * 50 + "CAT"), (4, "")]
    got = {r["seq_id"]: r for r in orf_table(spark.createDataFrame(rows, "seq_id int, seq string")).where("length_aa = 51").collect()}
    assert (got[1]["start"], got[1]["end"], got[1]["strand"], got[1]["open_end"]) == (3, 159, "+", False)
    assert got[2]["open_end"] and got[3]["strand"] == "-" and (got[3]["start"], got[3]["end"]) == (0, 156)
