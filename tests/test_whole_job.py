"""Registered queries and operators do the whole job: plain loops over small given tables, nothing cut off."""

import datetime
import hashlib
import random
from collections import Counter

from strandlake import plans
from strandlake.operators import provenance


def bases(rng, n):
    return "".join(rng.choice("abcdefgh") for _ in range(n))


def as_seq(text):
    return text.translate(str.maketrans("abcdefgh", "ACGTACGT"))


def test_pairs_are_whole_sequences(spark, tmp_path):
    rng = random.Random(21)
    first = bases(rng, 70_000)
    near = "".join(c if rng.random() < 0.97 else rng.choice("abcdefgh") for c in first[:30_000]) + bases(rng, 5_000)
    texts = [first, near, near[:300], near[:300] + "a" * 40, "", "acgt", bases(rng, 90), None, bases(rng, 256), bases(rng, 1024)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    ext = {r["pair_id"]: r["ext"] for r in plans.QUERIES["o12_xdrop_extend"](spark, str(tmp_path)).collect()}
    same = {r["pair_id"]: tuple(r)[1:] for r in plans.QUERIES["o14_span_identity"](spark, str(tmp_path)).collect()}
    assert set(ext) == set(same) == set(range(len(texts) - 1))
    for i in ext:
        pairs = list(zip(as_seq(texts[i] or ""), as_seq(texts[i + 1] or "")))
        score = best = far = 0
        for n, (x, y) in enumerate(pairs, 1):
            score += 1 if x == y else -2
            if score > best:
                best, far = score, n
            if score < best - 6:
                break
        hits = sum(x == y for x, y in pairs)
        assert ext[i] == far and same[i] == (hits, len(pairs), 100 * hits / len(pairs) if pairs else None)
    assert max(ext.values()) > 20_000


def test_density_of_every_cell(spark, tmp_path):
    rng = random.Random(22)
    unit = bases(rng, 60)
    texts = [unit * 3 + bases(rng, 100) + unit, bases(rng, 200), "acgt", "ab" * 40]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {tuple(r)[:4]: (r["cnt"], r["peak"], r["density"]) for r in plans.QUERIES["o31_normalised_density"](spark, str(tmp_path)).select("seq_id", "orientation", "bin_i", "bin_j", "cnt", "peak", "density").collect()}
    want = Counter()
    for s, seq in enumerate(map(as_seq, texts)):
        words = [(p, seq[p : p + 13]) for p in range(len(seq) - 12)]
        often = Counter(w for _, w in words)
        for p, v in words:
            for q, w in words:
                cell = p * 20 // len(seq), q * 20 // len(seq)
                if often[v] <= 120 and often[w] <= 120:
                    want[s, "forward", *cell] += v == w and p <= q
                    want[s, "reverse", *cell] += v[::-1].translate(str.maketrans("ACGT", "TGCA")) == w
    want = {k: n for k, n in want.items() if n}
    peak = {k[:2]: max(n for j, n in want.items() if j[:2] == k[:2]) for k in want}
    assert got == {k: (n, peak[k[:2]], n / peak[k[:2]]) for k, n in want.items()}
    assert any(d < 1 for _, _, d in got.values())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table_seal(seals):
    out = {}
    for shard in {s[:2] for s in seals}:
        n = Counter(s for s in seals if s[:2] == shard)
        hashes = {r: sha("\n".join(sorted(f"{s}:{c}" for s, c in n.items() if s[:4] == r))) for r in {s[:4] for s in n}}
        out[shard] = sum(n.values()), sha("\n".join(sorted(f"{r}:{h}" for r, h in hashes.items())))
    return out


def test_table_seal_counts_equal_seals(spark, tmp_path):
    orders = [(i, i % 7, "OFP"[i % 3], datetime.date(2020, 1, 1 + i % 28), f"{i % 5}-P") for i in range(900)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate date, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    seals = [r["seal"] for r in plans.QUERIES["o61_seal"](spark, str(tmp_path)).collect()]
    got = {r["shard"]: (r["n"], r["digest"]) for r in plans.QUERIES["o61_table_seal"](spark, str(tmp_path)).collect()}
    assert got == table_seal(seals) and len(set(seals)) < len(seals)
    # a pair of equal seals in place of another of the same shard
    a, b, c = "ab" + "1" * 62, "ab" + "2" * 62, "ab1" + "3" * 61
    digest = lambda rows: provenance.table_seal(spark.createDataFrame(list(enumerate(rows)), "k int, seal string"), "k").collect()
    assert digest([a, a, c]) != digest([b, b, c]) and digest([a, c, a]) == digest([c, a, a])


def test_agreement_compares_all_lines(spark, tmp_path):
    rng = random.Random(25)
    lines = [(k, rng.randrange(9), float(rng.randrange(1, 51)), rng.randrange(11) / 100) for k in range(60) for _ in range(rng.randrange(4))]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k,) for k in range(60)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    moved = {k for k, _, _, discount in lines if discount > 0.09}
    keys = {k for k, *_ in lines}
    got = plans.QUERIES["o97_differential_agreement"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in got] == [(len(keys - moved), len(moved), 60 - len(keys))] and moved and len(keys) < 60
