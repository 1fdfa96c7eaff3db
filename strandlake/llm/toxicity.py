"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton over folded text.

Folding undoes disguises: compatibility forms, homoglyphs and digit substitutions all go to one character
per look-alike class (``l``, ``1``, ``i``, ``!`` and ``|`` are one class), lexicon and text alike. A term
counts where it stands as a whole word and no exception phrase covers it.

The lexicon is learnt: log odds of a word's document frequency in toxic against other labelled documents, for words
whose share of toxic documents is no chance: by the Chernoff bound fewer than ``alpha`` words of the whole vocabulary
would reach it if labels were drawn at random. Exception phrases are a lexicon word with the word before or after it:
some are fixed, the others learnt, where the phrase stands in ``min_exception`` documents that are not toxic and its
share of toxic ones is no higher than that of all documents.
The weights of a text's matches, as a sum and normalised by its length, feed a logistic model. Both are fitted
on at most ``max_train`` labelled documents, drawn by hash: a bounded, documented sample; exact copies count
once. What reaches the driver is the lexicon and as many learnt phrases (``max_terms`` each) and three numbers per sampled
document.
Scoring reads each whole text once, without a shuffle.

Defined results: a null or empty text matches nothing and gets the score of such texts; a null doc_id is
not held out; without labels, or with labels of one class only, every score is the share of toxic labels
(0 without labels); repeated rows are scored each; an empty table gives an empty table. A document
labelled more than once is toxic if any label says so.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from functools import partial
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Look-alike characters, by the Latin letter they stand for.
LOOK_ALIKES = {
    "a": "4@аαå",
    "b": "8ьβ",
    "c": "сϲ¢",
    "e": "3еεё€",
    "g": "9",
    "h": "һ",
    "i": "1!|lіιїí",
    "k": "кκ",
    "m": "м",
    "n": "пη",
    "o": "0оοσ",
    "p": "рρ",
    "s": "5$ѕ",
    "t": "7тτ+",
    "u": "υս",
    "v": "ν",
    "w": "ωԝ",
    "x": "хχ",
    "y": "уγ",
    "j": "ј",
}
FOLD = {ord(c): letter for letter, chars in LOOK_ALIKES.items() for c in chars}

#: Phrases in which a lexicon word says nothing bad.
EXCEPTIONS = ("clown fish", "circus clown", "trash can", "trash bag", "trash bin", "take out the trash", "pond scum", "soap scum", "idiot proof", "sore loser")

_EDGE = "\"'.,;:()[]{}<>?*_-"
FEATURES = "weight double, density double, n_hits int, n_words int"


def plain(text: str) -> str:
    """Lower case in compatibility form; as long as its folded form."""
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


def fold(text: str) -> str:
    return plain(text).translate(FOLD)


def _words(text: str) -> list[str]:
    return [w.translate(FOLD) for w in re.findall(r"[^\W_]+", plain(text))]


def _count_words(batches, letters: tuple[int, int]):
    """Document frequency of each folded word of so many letters, by label, within a partition."""
    seen = Counter()
    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            seen.update((w, int(toxic)) for w in set(_words(text)) if letters[0] <= len(w) <= letters[1])
    yield pd.DataFrame([(w, y, n) for (w, y), n in seen.items()], columns=["word", "toxic", "n"])


def _count_phrases(batches, lexicon: set[str], longest: int):
    """Document frequency, by label, of the pairs of neighbouring words that hold a lexicon word; spaces stand between."""
    seen = Counter()
    for pdf in batches:
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            words = [w.strip(_EDGE) for w in fold(text).split(" ")]
            seen.update((p, int(toxic)) for p in {f"{a} {b}" for a, b in zip(words, words[1:]) if a and b and (a in lexicon or b in lexicon)} if len(p) <= longest)
    yield pd.DataFrame([(w, y, n) for (w, y), n in seen.items()], columns=["word", "toxic", "n"])


def _automaton(model: dict):
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in (*EXCEPTIONS, *model["exceptions"]):
        a.add_word(fold(phrase), (len(fold(phrase)), 0.0))
    lexicon: dict[str, float] = model["lexicon"]
    for term, weight in lexicon.items():
        a.add_word(term, (len(term), weight))
    a.make_automaton()
    return a


def matches(automaton, text: str) -> list[tuple[int, int, float]]:
    """(start, end, weight) in the folded text of terms that no exception phrase covers."""
    written = plain(text)
    folded = written.translate(FOLD)
    hits, shields = [], []
    for end, (n, weight) in automaton.iter(folded):
        start, end = end - n + 1, end + 1
        if (start and written[start - 1].isalnum()) or (end < len(written) and written[end].isalnum()):
            continue
        (hits if weight else shields).append((start, end, weight))
    if not shields:
        return hits
    # phrases in order of their starts, with the furthest end so far: one look-up per hit
    shields.sort()
    starts, furthest = [s for s, _, _ in shields], list(accumulate((e for _, e, _ in shields), max))
    covered = lambda s, e: (i := bisect_right(starts, s)) > 0 and furthest[i - 1] >= e
    return [h for h in hits if not covered(h[0], h[1])]


def features(automaton, text: str) -> tuple[float, float, int, int]:
    hits = matches(automaton, text)
    n_words = text.count(" ") + text.count("\n") + 1 if text else 0
    total = sum(w for _, _, w in hits)
    return total, 100 * total / max(20, n_words), len(hits), n_words


def _design(weight: np.ndarray, density: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(density)], axis=1)


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(beta)), x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _by_label(counted: DataFrame) -> DataFrame:
    n = lambda y: F.sum(F.when(F.col("toxic") == y, F.col("n")).otherwise(0))
    return counted.groupBy("word").agg(n(1).alias("pos"), n(0).alias("neg"))


def fit(
    docs: DataFrame, labels: DataFrame, max_train: int = 20_000, max_terms: int = 2_000, min_share: float = 0.02, min_ratio: float = 8.0, alpha: float = 0.05, min_exception: int = 5,
    letters: tuple[int, int] = (3, 39), longest_exception: int = 79,
) -> dict:
    """Lexicon, exception phrases and logistic weights, from labelled rows that are not held out.

    A word enters the lexicon if it stands in min_share of the toxic documents (3 at least), min_ratio times as often
    there as in the others, and its toxic share is significant (see alpha above). letters: the fewest and most letters of a
    word that may enter; longest_exception: the most letters of an exception phrase. Longer words and phrases are junk that
    no two texts share by meaning; they count in a text's length, but teach nothing.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    known = known.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    train = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(drawn), "doc_id")  # max_train rows of two numbers
    train = train.groupBy(F.md5("text").alias("h")).agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic").persist()
    try:
        return _fit(train, max_terms, min_share, min_ratio, alpha, min_exception, letters, longest_exception)
    finally:
        train.unpersist()


def _fit(train: DataFrame, max_terms: int, min_share: float, min_ratio: float, alpha: float, min_exception: int, letters: tuple[int, int], longest_exception: int) -> dict:
    size = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    n1, n0 = size.get(1, 0), size.get(0, 0)
    model = {"lexicon": {}, "exceptions": [], "beta": None, "prior": n1 / max(1, n0 + n1)}
    if not n0 or not n1:
        return model
    counts = _by_label(train.mapInPandas(partial(_count_words, letters=letters), "word string, toxic int, n long")).persist()
    try:
        ratio = ((F.col("pos") + 0.5) / (n1 + 1)) / ((F.col("neg") + 0.5) / (n0 + 1))
        n, p = F.col("pos") + F.col("neg"), model["prior"]
        share = F.col("pos") / n
        # divergence of the word's toxic share from that of all documents: n times it bounds the log of the chance
        surprise = n * (share * F.log(share / p) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - p))).otherwise(0.0))
        sure = surprise >= float(np.log(max(1, counts.count()) / alpha))
        top = counts.where((F.col("pos") >= max(3, min_share * n1)) & (ratio >= min_ratio) & sure).select("word", F.log(ratio).alias("w")).orderBy(F.desc("w"), "word").limit(max_terms)
        model["lexicon"] = {r["word"]: r["w"] for r in top.collect()}
    finally:
        counts.unpersist()
    if not model["lexicon"]:
        return model
    phrases = _by_label(train.mapInPandas(partial(_count_phrases, lexicon=set(model["lexicon"]), longest=longest_exception), "word string, toxic int, n long"))
    tame = phrases.where((F.col("neg") >= min_exception) & (F.col("pos") <= model["prior"] * (F.col("pos") + F.col("neg"))))
    model["exceptions"] = [r["word"] for r in tame.orderBy(F.desc("neg"), "word").limit(max_terms).collect()]
    shared = train.sparkSession.sparkContext.broadcast(model)  # max_terms words and phrases

    def measure(batches):
        a = _automaton(shared.value)
        for pdf in batches:
            rows = [features(a, t) for t in pdf["text"]]
            yield pd.DataFrame({"weight": [r[0] for r in rows], "density": [r[1] for r in rows], "toxic": pdf["toxic"].astype(int).to_numpy()})

    sample = train.mapInPandas(measure, "weight double, density double, toxic int").groupBy("weight", "density", "toxic").count().collect()
    sample.sort(key=lambda r: (r["weight"], r["density"], r["toxic"]))
    x = np.repeat(_design(np.array([r["weight"] for r in sample]), np.array([r["density"] for r in sample])), [r["count"] for r in sample], axis=0)
    y = np.repeat([float(r["toxic"]) for r in sample], [r["count"] for r in sample])
    model["beta"] = _fit_logistic(x, y).tolist()
    return model


def score(docs: DataFrame, model: dict, threshold: float = 0.7, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, n_hits and the columns named in keep."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # max_terms words and a few numbers
    kept = docs.select("doc_id", "text", *(c for c in keep if c not in ("doc_id", "text")))
    names = [c for c in kept.columns if c != "text" or "text" in keep]
    fields = {f.name: f for f in kept.schema.fields}
    schema = ", ".join(f"`{c}` {fields[c].dataType.simpleString()}" for c in names) + ", score double, n_hits int"

    def run(batches):
        import pyarrow as pa

        m = shared.value
        a = _automaton(m) if m["beta"] else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if a is None:
                s, n = np.full(len(texts), m["prior"]), np.zeros(len(texts), int)
            else:
                f = [features(a, t or "") for t in texts]
                x = _design(np.array([r[0] for r in f], float), np.array([r[1] for r in f], float))
                s, n = 1 / (1 + np.exp(-np.clip(x @ np.array(m["beta"]), -30, 30))), np.array([r[2] for r in f], int)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(s, pa.float64()), pa.array(n, pa.int32())], names=[*names, "score", "n_hits"])

    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    return kept.mapInArrow(run, schema).select(*names, held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_hits")
