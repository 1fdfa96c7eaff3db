"""Terms and licenses over whole texts, against plain loops."""

import random
import re

from strandlake.llm import license_scan, pii
from strandlake.llm import queries as llm

WORD = r"[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+"


def term_spans(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {r["doc_id"]: {t[s["start"] : s["end"]] for s in r["term"]} for r in pii.find_pii(docs).collect() for d, t in rows if d == r["doc_id"]}


def test_terms_of_values_that_stand_in_one_text_each(spark):
    rng = random.Random(23)
    filler = [f"common{i}" for i in range(30)]
    some = lambda n: " ".join(rng.choices(filler, k=n))
    rows = [(i, some(30)) for i in range(200)]
    rows += [(1000 + i, f"{some(12)} Mailbox: p{i}@host{i}.org {some(12)}") for i in range(4)]
    rows += [(2000 + i, f"{some(12)} Zebulon works q{i}@acme.org {some(12)}") for i in range(4)]
    rows += [(3000 + i, f"{some(12)} works {some(12)}") for i in range(9)]
    rows += [(4000, f"{some(12)} once r@else.net {some(12)}")]
    got = term_spans(spark, rows)
    assert all(got[1000 + i] == {"Mailbox"} and got[2000 + i] == {"Zebulon"} for i in range(4))
    assert all(not v for d, v in got.items() if not 1000 <= d < 3000)


def test_windows_are_words_however_long(spark):
    rng = random.Random(24)
    rows = [(1, "a@b.org"), (2, "x" * 3000 + " mid " + "é" * 900 + ",c@d.org)" + "z" * 700 + " \U0001f600end")]
    parts = ["w", "é\U0001f600", "(two)", "l" * 150, "k" * 2000]
    for i in range(40):
        side = lambda n: " ".join(rng.choice(parts) + str(rng.randrange(90)) for _ in range(n))
        rows.append((10 + i, side(rng.randrange(14)) + rng.choice(("", " ", "\n\t ")) + f"(m{i}@h.org)" + rng.choice(("", "  ", ",")) + side(rng.randrange(14))))
    found = pii.base_spans(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["doc_id"], r["start"], r["end"]) for r in pii.contexts(found, 8).collect()}
    want = set()
    for d, t in rows:
        for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", t):
            # words are runs without white space and ASCII punctuation; a piece that touches the address is none
            before = [w.span() for w in re.finditer(WORD, t[: m.start()]) if w.end() < m.start()][-8:]
            after = [(m.end() + w.start(), m.end() + w.end()) for w in re.finditer(WORD, t[m.end() :]) if w.start()][:8]
            want |= {(d, a, b) for a, b in before + after if b - a > 1}
    assert got == want and max(e - s for _, s, e in got) >= 3000


def test_licenses_are_told_from_their_siblings(spark, tmp_path):
    want = {
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under the GNU Lesser General Public License.": "gpl,lgpl",
        "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc",
        "Licensed under CC BY-SA 4.0.": "cc-by,cc-by-sa",
        "Licensed under CC BY 4.0.": "cc-by",
        "Licensed under CC BY-NC 4.0. Licensed under CC BY-SA 4.0.": "cc-by,cc-by-nc,cc-by-sa",
        "Released under the MIT License.": "mit",
        "Nothing.": "",
        "": "",
    }
    docs = spark.createDataFrame(list(enumerate(want)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in llm.QUERIES["op1_license_scan"](spark, str(tmp_path)).collect()}
    assert got == {i: (labels, 1.0 if labels else 0.0) for i, labels in enumerate(want.values())}
    # every template's own words give its label, and those of no sibling
    own = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(license_scan.TEMPLATES)], "doc_id long, text string")
    for r in license_scan.told_apart(license_scan.license_scan(own)).collect():
        assert {m["label"] for m in r["matches"]} == {license_scan.TEMPLATES[r["doc_id"]][0]}
