"""The pipeline's stages in turn: on the smallest tables against loops that know nothing of the operators, and on a table
of awkward rows."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandlake.llm.common import stored, table

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = dict(corpus_pipeline.STAGES)


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def dedup_lines(rows, min_sites=6):
    key = lambda line: re.sub(r"[ \t\n\x0b\f\r]+", " ", line.lower()).strip(" ")
    sites, owner = {}, {}
    for r in rows:
        for line in filter(None, map(key, (r["text"] or "").split("\n"))):
            sites.setdefault(line, set()).add(r["source"])
            if r["doc_id"] is not None:
                owner[line] = min(r["doc_id"], owner.get(line, r["doc_id"]))
    out = []
    for r in rows:
        if r["text"] is None:
            out.append((r["doc_id"], None))
            continue
        lines = r["text"].split("\n")
        kept = [x for x in lines if len(sites.get(key(x), ())) < min_sites or (r["doc_id"] is not None and owner.get(key(x)) == r["doc_id"])]
        if len(kept) == len(lines) or "".join(kept).strip(" \t\n\x0b\f\r"):
            out.append((r["doc_id"], "\n".join(kept)))
    return out


def first_of_groups(rows):
    sets, parent = [shingles(r["text"]) for r in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            low[find(i)] = min(r["doc_id"], low.get(find(i), r["doc_id"]))
    return [(r["doc_id"], r["text"]) for i, r in enumerate(rows) if r["doc_id"] is None or low[find(i)] == r["doc_id"]]


def holds_item(item, text, rate=0.1):
    plain = lambda t: re.sub(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", b" ", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode())
    p, t = plain(item).strip(), plain(text)
    k = int(rate * len(p))
    # with k edits one of k + 1 pieces of the item stands unchanged
    cuts = [len(p) * i // (k + 1) for i in range(k + 2)]
    starts = {m.start() - a for a, b in zip(cuts, cuts[1:]) for m in re.finditer(b"(?=" + re.escape(p[a:b]) + b")", t)}
    return any(edits(p, t[max(0, s - 2 * k) : s + len(p) + 2 * k]) <= k for s in starts)


def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)


def shares(size, weights=(3, 1, 2), share=1.5):
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, share * sum(size.values()), list(order)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if rate * weight[s] > 2 * size[s]]
        if not full:
            return target | {s: rate * weight[s] for s in open_}
        for s in full:
            target[s] = 2 * size[s]
            left -= 2 * size[s]
            open_.remove(s)
    return target


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_stages_match_brute_force(spark):
    docs = table(spark, SMALL, "documents")
    kept = stored(STAGE["toxicity"](spark, docs, SMALL), "stage")
    toxic = {r["doc_id"] for r in table(spark, SMALL, "labels").where("toxic = 1").collect()}
    gone = {r[0] for r in docs.select("doc_id").collect()} - {r[0] for r in kept.select("doc_id").collect()}
    assert not any(zlib.crc32(str(d).encode()) % 3 != 1 and d not in toxic for d in gone if d in {r[0] for r in table(spark, SMALL, "labels").select("doc_id").collect()})
    for name, brute in (("line dedup", dedup_lines), ("MinHash near-dedup", first_of_groups)):
        before = kept.collect()
        kept = stored(STAGE[name](spark, kept, SMALL), "stage")
        assert kept.columns == docs.columns and rows_of(kept) == sorted(brute(before), key=str), name
    before, items = kept.collect(), [r["text"] for r in table(spark, SMALL, "benchmark").collect()]
    kept = stored(STAGE["benchmark decontamination"](spark, kept, SMALL), "stage")
    assert kept.columns == docs.columns
    assert rows_of(kept) == sorted(((r["doc_id"], r["text"]) for r in before if not any(holds_item(i, r["text"]) for i in items)), key=str)
    mixed = [r.asDict() for r in STAGE["mixing"](spark, kept, SMALL).collect()]
    size = {}
    for r in kept.collect():
        size[r["source"]] = size.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    target = shares(size)
    assert len(mixed) == kept.count() and all(r["taken"] <= 2 * r["size"] for r in mixed)
    for s in size:
        assert abs(sum(r["taken"] for r in mixed if r["source"] == s) - target[s]) <= 1


@pytest.fixture(scope="module")
def awkward_folder(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("awkward"))
    rng = random.Random(6)
    spark.createDataFrame([(1, "quality of the item that is a benchmark question about rivers"), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(d, 0, int(d % 4 == 0)) for d in range(100, 300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rows = [(d, " ".join([f"w{rng.randrange(999)}" for _ in range(30)] + ["moron"] * 2 * (d % 4 == 0)), "en", f"s{d % 3}", 9) for d in range(100, 300)]
    base = " ".join(f"z{i}" for i in range(60))
    menu = [(d, "shared menu\nof the sites", "en", f"t{d}", 3) for d in range(400, 408)]
    rows += menu + [(410, None, None, None, None), (411, "", "en", "s1", 0), (None, "a row without id and with a moron", None, None, 1), (None, base, "en", "s1", 1), (412, base + " tail", "en", None, 2)]
    rows += [(412, base + " tail", "en", None, 2), (412, "another text under the same id", "en", "s2", 3), (413, "y " * 50_000, "en", "s2", 4), (414, "Quality of the ITEM, that is a benchmark qestion about rivers", "en", "s2", 5)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_awkward_rows(spark, awkward_folder):
    docs = table(spark, awkward_folder, "documents")
    kept = stored(STAGE["toxicity"](spark, docs, awkward_folder), "stage")
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert not {d for d in ids if d is not None and 100 <= d < 300 and d % 4 == 0} and len(ids) == docs.count() - 50 - 1
    kept = stored(STAGE["line dedup"](spark, kept, awkward_folder), "stage")
    assert {r[0] for r in kept.select("doc_id").collect()} & set(range(400, 408)) == {400} and kept.where("doc_id in (410, 411)").count() == 2
    kept = stored(STAGE["MinHash near-dedup"](spark, kept, awkward_folder), "stage")
    assert kept.where("doc_id = 412").count() == 3 and kept.where("doc_id is null").count() == 1
    kept = stored(STAGE["benchmark decontamination"](spark, kept, awkward_folder), "stage")
    assert kept.where("doc_id = 414").count() == 0 and kept.where("doc_id = 413").count() == 1
    mixed = STAGE["mixing"](spark, kept, awkward_folder)
    assert mixed.count() == kept.count() and mixed.where("taken > 2 * size or taken is null").count() == 0


def test_stages_ignore_other_columns_and_take_empty_tables(spark, awkward_folder):
    docs = table(spark, awkward_folder, "documents").limit(40)
    wide = docs.select("*", *(F.lit("x").alias(c) for c in ("score", "predicted", "gone", "n_lines", "n_removed", "h", "d", "kept", "leak", "size", "target")))
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, wide, awkward_folder), stage(spark, docs.limit(0), awkward_folder)
        assert none.count() == 0 and none.columns == out.columns
        assert out.columns == docs.columns or name == "mixing"
        assert out.count() == stage(spark, docs, awkward_folder).count()
