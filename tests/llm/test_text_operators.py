"""Native operators against plain Python on small tables with nulls, ties, repeats, long and empty texts."""

import gzip
import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F
from strandlake.llm import chat_format, license_scan, line_dedup, mixing, pii, toxicity, warc
from strandlake.llm.queries import _span

DOCS = "doc_id long, text string"
AWKWARD = [(None, "no id, all rights reserved."), (1, None), (2, ""), (3, " \n\t"), (4, "x" * 50_000), (5, "word " * 20_000), (6, "CC-BY cc by CC BY"), (6, "CC-BY cc by CC BY"), (6, "other text")]


def clash(spark, rows, schema, extra):
    return spark.createDataFrame([(*r, "x") for r in rows], f"{schema}, {extra} string")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def test_license_scan(spark):
    rows = AWKWARD + [(7, "pad " * 200 + "Released under the\nMIT License. É"), (8, "This work is licensed under the GNU General Public License, version 3."), (9, "all rights reserved all rights reserved")]
    got = sorted((tuple(r)[:8] for r in license_scan.license_scan(clash(spark, rows, DOCS, "words")).collect()), key=str)
    want = []
    for d, t in rows:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low(t))
        hits = [(i, label) for phrase, label in license_scan.BASE_PHRASES.items() for i in range(len(w)) if tuple(w[i : i + len(phrase)]) == phrase]
        labels, best = {x for _, x in hits}, 1.0 if hits else 0.0
        last = max(0, -(-len(w) // 64) - 2)
        for b in range(last + 1):
            block = set(w[b * 64 : b * 64 + 128])
            for label, text in license_scan.TEMPLATES:
                t_words = set(text.split())
                if len(block & t_words) >= 0.8 * len(t_words) - 1e-9:
                    labels.add(label)
                    best = max(best, len(block & t_words) / len(t_words))
        at = [i for i, _ in hits]
        want.append((d, len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})), ",".join(sorted(labels)), best))
    assert got == sorted(want, key=str)
    assert license_scan.license_scan(spark.createDataFrame([], DOCS)).count() == 0


def test_licenses_are_told_apart(spark):
    notices = {
        "Licensed under CC BY 4.0": "cc-by",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa",
        "licensed under a Creative Commons Attribution 4.0 International License": "cc-by",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "cc-by-nc",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License": "cc-by-sa",
        "Licensed under the GNU General Public License": "gpl",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "licensed under the GNU Lesser General Public License": "gpl,lgpl",
        "Released under the MIT License.": "mit",
        "The film was released last week under an export license of the ministry": "",
        "They may not use this road except in compliance with the rules and the license of the town": "",
        "subject to the terms of the public license of the city": "",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "licensed under the trade license, version 2.0 of 1970": "",
        "this is free software released into the public park": "",
    }
    rows = list(enumerate(notices))
    got = {r["doc_id"]: r["labels"] for r in license_scan.told_apart(license_scan.license_scan(spark.createDataFrame(rows, DOCS))).collect()}
    assert {t: got[i] for i, t in rows} == notices
    # each template is found by its own words, under no label but its own and those that base phrases give
    rows = list(enumerate(text for _, text in license_scan.TEMPLATES))
    for r in license_scan.told_apart(license_scan.license_scan(spark.createDataFrame(rows, DOCS))).collect():
        own = license_scan.TEMPLATES[r["doc_id"]][0]
        assert set(r["labels"].split(",")) == {own} | (set(r["base_labels"].split(",")) - {""}), (own, r["labels"])


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(t):
    t = t or ""
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in found)


def test_pii_base_spans(spark):
    rng = random.Random(8)
    parts = ["a.b@c.d", "x@y", "a@b.c_x@d.e", "@", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "4539578763621486", "+1 (017) 555-7713", "+12", "++4412345678", "1" * 40, "é", "\U0001f600", " ", "\n", "word", "-"]
    rows = AWKWARD + [(100 + i, "".join(rng.choice(parts) + rng.choice((" ", "", ",")) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    rows += [(300, "9 " * 30_000), (301, "a" * 60_000 + "@"), (302, "a.b@c.d " * 3000)]
    out = pii.find_pii(clash(spark, rows, DOCS, "h"))
    listed = F.array_join(F.concat(*(F.transform(F.array_sort(k), _span(k)) for k in pii.PATTERNS)), ",")
    got = sorted(((r[0], r[1]) for r in out.select("doc_id", listed).collect()), key=str)
    assert got == sorted(((d, base_spans(t)) for d, t in rows), key=str)
    assert pii.find_pii(spark.createDataFrame([], DOCS)).count() == 0


def test_pii_terms_and_sanitising(spark):
    filler = [f"common{i}" for i in range(30)]
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(filler, k=30))) for i in range(90)]
    rows += [(1000 + i, " ".join(rng.choices(filler, k=30))) for i in range(90)]
    rows += [(100 + i, f"{' '.join(rng.choices(filler, k=12))} (Zebulon) 48213 mail zeb@mail.org {' '.join(rng.choices(filler, k=12))}") for i in range(5)]
    docs = spark.createDataFrame(rows, DOCS)
    found = pii.find_pii(docs)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs, found).collect()}
    for d, t in rows:
        if d < 100 or d >= 1000:
            assert clean[d] == t
        else:
            assert "Zebulon" not in clean[d] and "([TERM]) 40000" in clean[d] and "[EMAIL]" in clean[d] and "common" in clean[d]


SECRET = r"(?:token|secret|passwd|password|api_key|apikey|api-key|access_key|auth_key|private_key)[\"']? {0,2}[:=] {0,2}[\"']?(?<![A-Za-z0-9+/_.~=-])([A-Za-z0-9+/_.~-]{12,})"
WORD = r"[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"


def entities(t):
    out = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in base_spans(t).split(",") if x)]
    return out + [("secret", *m.span(1)) for m in re.finditer(SECRET, t) if re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1])]


def brute_terms(rows, window=8, min_support=3, min_share=0.5, min_bits=4.0):
    """Spans of disclosed terms by row, by loops over all words."""
    near, n_te, n_t, n_e, texts = [], {}, {}, {}, {}
    for d, t in rows:
        t, here = t or "", set()
        for w in set(re.findall(WORD, low(t))):
            n_t[w] = n_t.get(w, 0) + 1
        for kind, a, b in entities(t):
            v = t[a:b]
            digits = re.sub("[^0-9]", "", v)
            owner = {"email": low(v.split("@")[-1]), "ip": ".".join(v.split(".")[:3]), "card": digits[:6], "phone": digits[:4], "secret": v}[kind]
            before = [m.span() for m in re.finditer(WORD, t[:a]) if m.end() < a][-window:]
            after = [(m.start() + b, m.end() + b) for m in re.finditer(WORD, t[b:]) if m.start()][:window]
            for s, e in before + after:
                if e - s > 1:
                    here |= {(low(t[s:e]), pool, s, e) for pool in ((kind, v), (kind, "owner", owner), (kind,))}
        near.append(here)
        for w, pool in {x[:2] for x in here}:
            n_te[w, pool] = n_te.get((w, pool), 0) + 1
            texts.setdefault((w, pool), set()).add(t)
        for pool in {x[1] for x in here}:
            n_e[pool] = n_e.get(pool, 0) + 1
    told = {
        (w, pool) for (w, pool), n in n_te.items() if len(texts[w, pool]) >= min_support and n / n_t[w] >= min_share and np.log2(n / n_t[w] * len(rows) / n_e[pool]) >= min_bits
    }
    return [sorted({(s, e) for w, pool, s, e in here if (w, pool) in told}) for here in near]


def test_pii_terms_match_brute_force(spark):
    rng = random.Random(21)
    filler = [f"word{i}" for i in range(60)] + ["éa", "x", "ΑΣ"]
    some = lambda n: " ".join(rng.choices(filler, k=n))
    rows = [(i, some(20)) for i in range(150)] + [(None, None), (500, ""), (501, "zeb@mail.org"), (502, "a" * 30_000 + " lead me@here.org " + "b" * 30_000)]
    for i in range(6):
        rows.append((600 + i, f"{some(5)} user=Zebulon,zeb@mail.org {some(9)} x12.3.4.{i} Ōsaka"))
        rows.append((700 + i, f"{some(3)} badge\t{70 + i}-Kestrel/ {'w' * 61} {'v' * 700} {some(4)} +44 20 555 {1000 + i}, {some(5)} Kestrel"))
        rows.append((800 + i, f"{some(12)} vault {'api_key' if i % 2 else 'token'} = \"{rng.getrandbits(120):030x}\" falcon {some(3)} token: internationalization"))
    once = pii.find_pii(spark.createDataFrame(rows, DOCS))
    got = sorted(((r["doc_id"], [tuple(s) for s in r["term"]], [(s["start"], s["end"]) for s in r["secret"]]) for r in once.collect()), key=str)
    secrets = [sorted((a, b) for k, a, b in entities(t or "") if k == "secret") for _, t in rows]
    want = sorted(((d, terms, s) for (d, _), terms, s in zip(rows, brute_terms(rows), secrets)), key=str)
    assert got == want
    assert sum(bool(x[1]) for x in want) >= 17 and sum(bool(x[2]) for x in want) == 6
    # rows that are there three times change nothing
    again = pii.find_pii(spark.createDataFrame(rows * 3, DOCS))
    assert sorted(((r["doc_id"], [tuple(s) for s in r["term"]], [(s["start"], s["end"]) for s in r["secret"]]) for r in again.collect()), key=str) == sorted(want * 3, key=str)


def test_sanitise_keeps_columns_of_any_name(spark):
    rows = [(1, "mail zeb@mail.org now", "a", "b", "c", "d"), (2, None, None, None, None, None), (None, "at 10.0.0.1", "a", "b", "c", "d"), (1, "mail zeb@mail.org now", "e", "f", "g", "h")]
    docs = spark.createDataFrame(rows, DOCS + ", spans string, __h string, h string, d string")
    clean = pii.sanitise(docs, pii.find_pii(docs))
    assert clean.columns == docs.columns
    want = [(r[0], r[1] and r[1].replace("zeb@mail.org", "[EMAIL]").replace("10.0.0.1", "[IP]"), *r[2:]) for r in rows]
    assert sorted((tuple(r) for r in clean.collect()), key=str) == sorted(want, key=str)


def test_chat_formatting(spark):
    nasty = ["\\", "<|>", "</turn>\n", "### user:\n", "\\b\\l\\h", "", "é\U0001f600", "a:b#c<d", None, "\\### Assistant: </turn> ok"]
    rng = random.Random(10)
    rows = [(c, t, rng.choice(("user", "assistant", "system", "a:#<\\")), rng.choice(nasty)) for c in range(25) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "x"), (30, None, "assistant", "y"), (30, 1, None, "z"), (31, 1, "user", "b"), (31, 1, "user", "a"), (31, 1, "user", "a")]
    df = clash(spark, rows, "conv_id long, turn long, role string, text string", "turns")
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(back) == set(by)
    for c, turns in by.items():
        want = [(r, x) for _, r, x in sorted(turns)]
        assert [tuple(t) for t in back[c]["turns"]] == want
        assert back[c]["loss_text"] == "".join(x for r, x in want if r == "assistant")
        roles = [r for r, _ in want]
        assert back[c]["formatted"].count("</turn>\n") == sum(i == 0 or r != roles[i - 1] for i, r in enumerate(roles))
    for r in chat_format.format_chats(df).collect():
        assert "".join(s["piece"] for s in r["segments"]) == r["formatted"]
    assert chat_format.format_chats(df.limit(0)).count() == 0
    long = [(1, i, ("user", "user", "assistant")[i % 3], f"{i}<|>" + "y" * (200_000 if i == 7 else 20)) for i in range(3000)]
    one = chat_format.read_back(chat_format.format_chats(spark.createDataFrame(long, "conv_id long, turn long, role string, text string"))).collect()[0]
    assert [tuple(t) for t in one["turns"]] == [r[2:] for r in long] and one["loss_text"] == "".join(r[3] for r in long if r[2] == "assistant")


def test_line_dedup(spark):
    nav = "Home |  About | CONTACT"
    rows = [(i, f"own line {i}\n{nav}\nedge\nlast {i}" if i % 2 else f"own line {i}\n\n{nav.lower()}", f"s{i % 8}") for i in range(40)]
    rows = [(d, t.replace("edge\n", "edge\n" if d % 8 < 7 and d in (1, 3, 5, 7, 9) else ""), s) for d, t, s in rows]
    rows += [(50, None, "s1"), (51, "", None), (52, nav, None), (None, nav, "s1"), (53, "x\n" * 5000, "s2"), (1, rows[1][1], "s1")]
    clashing = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], DOCS + ", source string, gone string, h string, d string, __h string, n_lines string")
    out = line_dedup.dedup_lines(clashing, min_sites=6)
    assert out.columns == ["doc_id", "text", "source", "gone", "h", "d", "__h", "n_lines", "n_removed"]
    assert {tuple(r) for r in out.select("gone", "h", "d", "__h").collect()} == {("a", "b", "c", "d")}
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    sites, owner = {}, {}
    key = lambda line: re.sub(r"\s+", " ", line.lower()).strip()
    for d, t, s in rows:
        for line in (t or "").split("\n"):
            if key(line):
                sites.setdefault(key(line), set()).add(s)
                if d is not None:
                    owner[key(line)] = min(d, owner.get(key(line), d))
    gone = {k for k, v in sites.items() if len(v) >= 6}
    want = [(d, t if t is None else "\n".join(x for x in t.split("\n") if key(x) not in gone or (d is not None and owner.get(key(x)) == d))) for d, t, _ in rows]
    assert got == sorted(want, key=str) and gone == {key(nav)}
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS + ", source string")).count() == 0


def test_mixing(spark):
    rng = random.Random(11)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(("b", "a", "a", "a", "é", "Z", None))) for i in range(300)]
    rows += [(None, "n " * 5, "a"), (7, rows[7][1], rows[7][2]), (900, None, "a"), (901, "v " * 3000, "tiny"), (902, "", "empty")]
    df = clash(spark, rows, DOCS + ", source string", "size")
    out = [r.asDict() for r in mixing.fair_mix(df, bucket_rows=16).collect()]
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, full = {}, 1.5 * sum(size.values()), set()
    while True:
        open_ = [s for s in order if s not in full]
        over = [s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * size[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        for s in over:
            target[s] = 2 * size[s]
        left, full = left - sum(2 * size[s] for s in over), full | set(over)
    assert len(out) == len(rows)
    for s in order:
        mine = [r for r in out if r["source"] == s]
        assert all(abs(r["target"] - target[s]) < 1e-6 and r["source_size"] == size[s] and 0 <= r["taken"] <= 2 * r["size"] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - target[s]) <= 1
    again = mixing.fair_mix(df.repartition(7), bucket_rows=16).select("doc_id", "size", "taken")
    assert sorted(map(str, again.collect())) == sorted(str(r) for r in mixing.fair_mix(df, bucket_rows=16).select("doc_id", "size", "taken").collect())
    assert mixing.fair_mix(df.limit(0)).count() == 0


def test_warc_round_trip_and_audit(spark):
    rows = [(i, f"http://h{i % 5}.example/{i}", f"<p>é {i}</p>\r\n\r\n" * (i % 4)) for i in range(200)] + [(None, None, None), (3, "http://h3.example/3", rows_3 := "<p>é 3</p>\r\n\r\n" * 3), (500, "u", None)]
    pages = clash(spark, rows, "page_id long, url string, html string", "record")
    back = sorted(((r["page_id"], r["url"], r["html"]) for r in warc.parse_records(warc.to_records(pages)).collect()), key=str)
    assert back == sorted(((p, u or "", h or "") for p, u, h in rows), key=str) and rows_3
    digests = warc.to_records(pages).select("page_id", "record_id", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("digest"))
    index = warc.lay_out(digests, per_file=16).cache()
    assert index.where("copies = 2").count() == 1
    assert warc.audit(index, index, fan=4).count() == 0
    damaged = index.where("page_id is null or page_id <> 17").withColumn("digest", F.when(F.col("page_id").isin(5, 99), F.lit("bad")).otherwise(F.col("digest")))
    got = {(r["page_id"], r["status"]) for r in warc.audit(index, damaged, fan=4).collect()}
    assert got == {(17, "missing"), (5, "altered"), (99, "altered")}
    assert {(r["page_id"], r["status"]) for r in warc.audit(damaged, index, fan=4).collect()} == {(17, "extra"), (5, "altered"), (99, "altered")}
    # only the children of nodes that differ are read: three leaves that differ lie in three parents at most
    read: list[int] = []
    warc.audit(index, damaged, fan=4, nodes_read=read).count()
    assert read[0] == 1 and all(n <= 4 * 3 for n in read) and read[-1] <= 12 < index.count() / 10
    intact: list[int] = []
    warc.audit(index, index, fan=4, nodes_read=intact).count()
    assert intact == [1] + [0] * (len(intact) - 1)
    assert warc.audit(index.limit(0), index.limit(0)).count() == 0
    assert warc.audit(index, index.limit(0), fan=4).count() == index.count()


def test_warc_files(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>é {i}</p>\r\n\r\nWARC/1.0\r\n" * (i % 3)) for i in range(40)] + [(99, "http://long", "x" * 300_000)]
    records = warc.to_records(spark.createDataFrame(rows, "page_id long, url string, html string"))
    files = records.select(F.pmod("page_id", F.lit(3)).alias("file"), F.col("page_id").alias("seq"), "record")
    warc.write_warc(files, str(tmp_path / "plain"))
    whole = b"".join(r["record"].encode() for r in files.orderBy("seq").collect())
    (tmp_path / "packed").mkdir()
    (tmp_path / "packed" / "a.warc.gz").write_bytes(gzip.compress(whole[:10_000]) + gzip.compress(whole[10_000:]))
    want = sorted((f"http://h/{i}" if i < 99 else "http://long", h) for i, _, h in rows)
    for folder in ("plain", "packed"):
        back = warc.read_warc(spark, str(tmp_path / folder)).collect()
        assert sorted((r["url"], bytes(r["body"]).decode()) for r in back) == want
        assert {r["type"] for r in back} == {"response"} and sum(r["length"] for r in back) == len(whole)
    starts = sorted((r["start"], r["length"], r["digest"]) for r in back)
    assert all(hashlib.sha256(whole[a : a + n]).hexdigest() == x for a, n, x in starts)


def test_toxicity(spark):
    rng = random.Random(12)
    words = [f"plain{i}" for i in range(200)]
    bad = ["idiot", "clown", "scum"]
    rows, labels = [], []
    for i in range(600):
        text = rng.choices(words, k=rng.randint(5, 60))
        toxic = i % 4 == 0
        for _ in range(3 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic), 1))
    rows += [(1000, "You 1D10T and clоwn, sсum!"), (1001, "plain1 clown fish plain2"), (1002, None), (1003, ""), (None, "idiotic plain"), (1004, "plain3 " * 30_000)]
    docs, known = clash(spark, rows, DOCS, "score"), spark.createDataFrame([*labels, (5, None, 1), (None, 1, 1)], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, known)
    assert set(model["lexicon"]) == {toxicity.fold(b) for b in bad}
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i]["predicted"] == toxic for i, toxic, _ in labels)
    assert got[1000]["predicted"] == 1 and got[1000]["n_hits"] == 3
    assert all(got[i]["predicted"] == 0 for i in (1001, 1002, 1003, None, 1004))
    assert sum(r["held_out"] for r in got.values()) > 100
    none = toxicity.fit(docs, known.limit(0))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def brute_hits(text, model):
    """Places of lexicon words: every window of the text against every word, then every phrase against every hit."""
    folded, written = toxicity.fold(text), toxicity.plain(text)

    def places(term):
        at = [i for i in range(len(folded) - len(term) + 1) if folded[i : i + len(term)] == term]
        return [(i, i + len(term)) for i in at if not (i and written[i - 1].isalnum()) and not (i + len(term) < len(written) and written[i + len(term)].isalnum())]

    shields = [p for phrase in (*toxicity.EXCEPTIONS, *model["exceptions"]) for p in places(toxicity.fold(phrase))]
    return sorted((s, e, w) for term, w in model["lexicon"].items() for s, e in places(term) if not any(a <= s and e <= b for a, b in shields))


def test_toxicity_scores_match_brute_force(spark):
    rng = random.Random(30)
    words, bad = [f"plain{i}" for i in range(150)] + ["É", "straße"], ["moron", "vermin", "scum"]
    rows, labels = [], []
    for i in range(700):
        text, toxic = rng.choices(words, k=rng.randint(5, 50)), i % 4 == 0
        for _ in range(2 * toxic):
            text.insert(rng.randrange(len(text)), rng.choice(bad))
        if i % 45 == 1 and not toxic:
            text.insert(rng.randrange(len(text)), "vermin control")  # an everyday phrase with a lexicon word
        text += ["rare"] * (i in (0, 8, 12, 16))  # in four toxic documents by chance
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    rows += [(2000 + n, t) for n, t in enumerate(["", None, "m0r0n", "MORON! moronic vermin control vermin", "vermin controls", "ѕсum soap scum scum", "scum " * 5000, "scum-control (vermin) control"])]
    rows += rows[:3] + [(None, "moron")]
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    train = [(t, y) for (_, t), (i, y) in zip(rows, labels) if zlib.crc32(str(i).encode()) % 3 != 1]
    holds = lambda w, t: w in [toxicity.fold(x) for x in t.split()]
    n1, n0 = sum(y for _, y in train), sum(1 - y for _, y in train)
    assert set(model["lexicon"]) == {toxicity.fold(b) for b in bad}
    for w, weight in model["lexicon"].items():
        pos, neg = sum(y for t, y in train if holds(w, t)), sum(1 - y for t, y in train if holds(w, t))
        assert abs(weight - np.log((pos + 0.5) / (n1 + 1) / ((neg + 0.5) / (n0 + 1)))) < 1e-9
    assert toxicity.fold("vermin control") in model["exceptions"]
    automaton = toxicity._automaton(model)
    got = {}
    for r in toxicity.score(docs, model).collect():
        got.setdefault(r["doc_id"], []).append((round(r["score"], 9), r["n_hits"], r["predicted"], r["held_out"]))
    for d, t in rows:
        hits = brute_hits(t or "", model)
        assert sorted(toxicity.matches(automaton, t or "")) == hits
        total, n = sum(w for *_, w in hits), len(re.findall("[ \n]", t)) + 1 if t else 0
        z = model["beta"] @ np.array([1, np.log1p(total), np.log1p(100 * total / max(20, n))])
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        assert (round(float(p), 9), len(hits), int(p >= 0.7), d is not None and zlib.crc32(str(d).encode()) % 3 == 1) in got[d]
    assert {d: got[d][0][1] for d in range(2002, 2008)} == {2002: 1, 2003: 2, 2004: 1, 2005: 2, 2006: 5000, 2007: 2}
    caught = [got[i][0][2] == y for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(caught) / len(caught) > 0.95 and {len(v) for v in (got[0], got[1], got[2])} == {2}


def test_hashes_of_an_empty_list():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
