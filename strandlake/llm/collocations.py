"""Phrases whose words stand together more often than chance has it.

1. Words and phrases are hashed with their language. Tasks count them in chunks and merge the chunks into Misra-Gries
   summaries, which are cut along hash partitions. A partition's summaries merge in one task: equal keys add up, and where
   more counters are left than the capacity, the largest counter beyond it is taken off all. A summary of c counters over a
   mass m undercounts by less than m / c at every merge order. The capacity of a task is twice the whole mass by the
   threshold, that of a partition twice its own mass by the threshold, so that the two together lose less than the
   threshold and every phrase that reaches it survives.
2. The first summaries hold words and pairs. Phrases of three words and more enter the second only where all their pairs
   survived the first. Survivors are looked up in a Bloom filter of fixed size: it lets strangers through, but no survivor
   out, however many there are.
3. A second pass counts survivors exactly, now by their words; those under the threshold go.
4. Candidates meet the counts of their parts, longer candidates and the rest by joins.

Defined results: a null text is empty, a null language is ``und``; rows without id and repeated rows count like any
other; texts without words add nothing; an empty table gives an empty table; other columns are ignored. Words are told
apart by 64-bit hashes within a task, and by their letters across tasks.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .filters import bloom, holds
from .minhash import mix

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: What ends a piece, and what stands between the words of one.
_BREAK, _SPACE = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SPACE[[0x20, 0x09]] = True
_GAP = _BREAK | _SPACE

#: Bytes of text that are tokenised at once; grams that are counted at once; counters a task holds before it passes them on.
SLICE, CHUNK, HELD = 1 << 20, 1 << 20, 3 << 19
#: Bytes of text for each hash partition of the summaries, and the most partitions.
PER_PARTITION, PARTITIONS = 1 << 22, 1 << 16

def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, _U)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return both[0], both[1]


def slices(batches):
    """(bytes, start of each text, lang of each text) of about SLICE bytes. Longer texts are cut where a piece ends."""
    texts, langs, size = [], [], 0

    def packed():
        starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        return b"\n".join(texts), starts, langs

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1)):
            text, lang, at = (text.as_py() or b"").translate(_LOWER), lang.as_py(), 0
            while at < len(text):
                end = min(len(text), at + SLICE)
                while end < len(text) and not _BREAK[text[end]]:
                    end += 1
                texts.append(text[at:end])
                langs.append(lang)
                size += end - at
                at = end
                if size >= SLICE:
                    yield packed()
                    texts, langs, size = [], [], 0
    if texts:
        yield packed()


class Words:
    """The words of a slice, and hashes of the phrases that begin at each of them."""

    def __init__(self, data: bytes, starts: np.ndarray, langs: list[str], powers: dict):
        b = np.frombuffer(data, np.uint8)
        gap = np.concatenate(([True], _GAP[b], [True]))
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        self.data, self.langs, self.start, self.end = data, langs, edges[::2], edges[1::2]
        if len(b) >= powers.get("n", 0):
            powers["n"] = len(b) + SLICE
            powers["up"], powers["down"] = _powers(powers["n"] + 1)
        sums = np.zeros(len(b) + 1, _U)
        np.cumsum((b.astype(_U) + _U(1)) * powers["up"][: len(b)], out=sums[1:])
        self.piece = np.cumsum(_BREAK[b])[self.start] if len(b) else np.zeros(0, np.int64)
        self.text = np.searchsorted(starts, self.start, "right") - 1
        seeds = np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in langs], _U)
        self.hash = mix((sums[self.end] - sums[self.start]) * powers["down"][self.start] + seeds[self.text])

    def phrases(self, most: int):
        """For k = 1 to most: k, the first words of phrases of k words, and their hashes."""
        h, n = self.hash, len(self.hash)
        for k in range(1, most + 1):
            if k > 1:
                h = mix(h[: n - k + 1] * _U(_BASE) + self.hash[k - 1 :])
            if n < k:
                return
            inside = np.flatnonzero(self.piece[: n - k + 1] == self.piece[k - 1 :])
            yield k, inside, h[inside]


def admitted(words: Words, most: int, bits: np.ndarray | None, least: int = 1):
    """As phrases(), without those that hold a pair (or word) that the filter does not know, from least words on."""
    known = None
    for k, first, h in words.phrases(most):
        if bits is not None and k == 2:
            known = np.zeros(len(words.hash) + 1, bool)
            known[first] = holds(bits, h)
        if bits is not None and k > 2:
            all_known = np.logical_and.reduce([known[first + i] for i in range(k - 1)])
            first, h = first[all_known], h[all_known]
        if k >= least:
            yield k, first, h


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[: len(keys)]
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def cut_to(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """A Misra-Gries summary of at most capacity counters, and what it takes off all others."""
    if len(keys) <= capacity:
        return keys, counts, 0
    cut = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    left = counts > cut
    return keys[left], counts[left] - cut, cut


def summaries(docs: DataFrame, least: int, most: int, capacity: int, partitions: int, known=None) -> DataFrame:
    """Misra-Gries summaries of the phrases of least to most words: part, mass (occurrences), cut, keys, counts."""
    names = ["part", "mass", "cut", "keys", "counts"]

    def run(batches):
        powers: dict = {}
        bits = known.value if known else None
        fresh, size = [], 0
        keys, counts, cut, mass = np.zeros(0, _U), np.zeros(0, np.int64), 0, np.zeros(partitions, np.int64)

        def part_of(h):
            return ((h >> _U(32)) * _U(partitions)) >> _U(32)

        def merge():
            nonlocal fresh, size, keys, counts, cut
            new, n = np.unique(np.concatenate(fresh), return_counts=True)
            mass.__iadd__(np.bincount(part_of(new).astype(np.int64), weights=n, minlength=partitions).astype(np.int64))
            keys, counts, more = cut_to(*summed(np.concatenate((keys, new)), np.concatenate((counts, n))), capacity)
            fresh, size, cut = [], 0, cut + more

        def passed_on():
            edges = np.searchsorted(part_of(keys), np.arange(partitions + 1).astype(_U))
            parts = np.flatnonzero((mass > 0) | (cut > 0))
            of = [slice(edges[p], edges[p + 1]) for p in parts]
            return pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int64()), pa.array(mass[parts], pa.int64()), pa.array([cut] * len(parts), pa.int64()), pa.array([keys[s].tobytes() for s in of], pa.binary()), pa.array([counts[s].tobytes() for s in of], pa.binary())],
                names=names,
            )

        for piece in slices(batches):
            for _, _, h in admitted(Words(*piece, powers), most, bits, least):
                fresh.append(h)
                size += len(h)
            if size >= CHUNK:
                merge()
                if len(keys) >= HELD:
                    yield passed_on()
                    keys, counts, cut = keys[:0], counts[:0], 0
                    mass[:] = 0
        if size:
            merge()
        if mass.any():
            yield passed_on()

    return docs.mapInArrow(run, "part long, mass long, cut long, keys binary, counts binary")


def survivors(parts: DataFrame, threshold: int) -> DataFrame:
    """Hashes h of all phrases that can reach the threshold, by merging the summaries of each hash partition."""

    def run(batches):
        part, keys, counts, cut, capacity = None, [], [], 0, 0

        def merge(last: bool):
            nonlocal keys, counts, cut
            k, n, more = cut_to(*summed(np.concatenate(keys), np.concatenate(counts)), capacity)
            cut += more
            keys, counts = [k], [n]
            if last:
                return pa.RecordBatch.from_arrays([pa.array(k[n + cut >= threshold].view(np.int64))], names=["h"])

        for batch in batches:
            for p, total, c, k, n in zip(*(batch.column(x) for x in ("part", "total", "cut", "keys", "counts"))):
                if part is not None and p.as_py() != part:
                    yield merge(True)
                    keys, counts, cut = [], [], 0
                part, capacity = p.as_py(), 2 * total.as_py() // threshold + 1
                keys.append(np.frombuffer(k.as_py(), _U))
                counts.append(np.frombuffer(n.as_py(), np.int64))
                cut += c.as_py()
                if sum(map(len, keys)) >= CHUNK + 2 * capacity:
                    merge(False)
        if part is not None:
            yield merge(True)

    whole = parts.withColumn("total", F.sum("mass").over(Window.partitionBy("part")))
    return whole.select("part", "total", "cut", "keys", "counts").mapInArrow(run, "h long")


def exact_counts(docs: DataFrame, most: int, threshold: int, partitions: int, known) -> DataFrame:
    """lang, phrase, k and f of the words and phrases that the filter knows and that reach the threshold, and the words of
    each language as k = 0. Tasks pass their counts on as lists, one for each hash partition."""
    fields = [("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int32()), ("f", pa.int64())]

    def run(batches):
        powers: dict = {}
        bits = known.value
        keys, counts = np.zeros(0, _U), np.zeros(0, np.int64)
        said: dict[int, tuple] = {}
        n_words: dict[str, int] = {}

        def passed_on():
            rows = [(*said[h], f) for h, f in zip(keys.tolist(), counts.tolist())] + [(x, "", 0, n) for x, n in n_words.items()]
            # By letters, so that a phrase meets its like of every task.
            part = np.array([int.from_bytes(hashlib.blake2b(f"{x[0]} {x[1]}".encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % partitions for x in rows], np.int64)
            order = np.argsort(part, kind="stable")
            parts, at = np.unique(part[order], return_index=True)
            ends = pa.array(np.append(at, len(rows)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array([rows[i][c] for i in order.tolist()], kind)) for c, (_, kind) in enumerate(fields)]
            return pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), *lists], names=["part", *(n for n, _ in fields)])

        for piece in slices(batches):
            words = Words(*piece, powers)
            for text, n in zip(*np.unique(words.text, return_counts=True)):
                n_words[words.langs[text]] = n_words.get(words.langs[text], 0) + int(n)
            for k, first, h in admitted(words, most, bits):
                here = holds(bits, h)
                new, at, n = np.unique(h[here], return_index=True, return_counts=True)
                for key, i in zip(new.tolist(), first[here][at].tolist()):
                    if key not in said:
                        span = [words.data[words.start[j] : words.end[j]] for j in range(i, i + k)]
                        said[key] = (words.langs[words.text[i]], b" ".join(span).decode("utf-8", "surrogatepass"), k)
                keys, counts = summed(np.concatenate((keys, new)), np.concatenate((counts, n)))
            if len(said) >= HELD // 8:
                yield passed_on()
                keys, counts, said, n_words = keys[:0], counts[:0], {}, {}
        if n_words:
            yield passed_on()

    def merged(batches):
        part, sums = None, {}

        def whole():
            rows = [(*key, f) for key, f in sums.items() if f >= threshold or not key[2]]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])

        for batch in batches:
            for i, p in enumerate(batch.column("part").to_pylist()):
                if p != part and sums:
                    yield whole()
                    sums = {}
                part = p
                for lang, phrase, k, f in zip(*(batch.column(n)[i].as_py() for n, _ in fields)):
                    sums[lang, phrase, k] = sums.get((lang, phrase, k), 0) + f
        if sums:
            yield whole()

    lists = docs.mapInArrow(run, "part long, lang array<string>, phrase array<string>, k array<int>, f array<long>")
    return lists.repartition("part").sortWithinPartitions("part").mapInArrow(merged, "lang string, phrase string, k int, f long")


def frequent_phrases(docs: DataFrame, most: int = 5, threshold: int = 100, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, phrase (words joined by spaces), k (words in it) and f (occurrences, at least threshold) of all words and
    phrases of at most ``most`` words; k = 0 holds the number of all words of a language."""
    text = F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8")
    slim = docs.select(text.alias("t"), F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"))
    size = slim.agg(F.sum(F.length("t"))).first()[0] or 0
    # A phrase needs two bytes for each word and its end, so that no summary's mass passes twice the bytes.
    capacity, partitions = 4 * size // threshold + 1, min(PARTITIONS, math.ceil(size / PER_PARTITION) or 1)
    found = stored(survivors(summaries(slim, 1, min(2, most), capacity, partitions), threshold), "pairs")
    if most > 2:
        known = bloom(found)
        found = found.union(stored(survivors(summaries(slim, 3, most, capacity, partitions, known), threshold), "phrases"))
    return stored(exact_counts(slim, most, threshold, partitions, bloom(found)), "counts")


def collocations(docs: DataFrame, threshold: int = 100, most: int = 5, share: int = 100, top: int = 2000) -> DataFrame:
    """The top phrases of 2 to ``most`` words of each language by their weakest cut: lang, rank, phrase, a, l, r, n, score.

    A phrase goes where a longer one holds it and reaches share percent of its occurrences.
    """
    counts = frequent_phrases(docs, most, threshold)
    n = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    known = counts.where("k > 0").select("lang", "phrase", "k", "f")
    cand = known.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, size: F.array_join(F.slice("w", start, size), " ")
    cuts = cand.select("lang", "phrase", "k", "a", "w", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("c"))
    cuts = cuts.select("lang", "phrase", "a", "c", part(F.lit(1), F.col("c")).alias("left"), part(F.col("c") + 1, F.col("k") - F.col("c")).alias("right"))
    of = lambda side, name: known.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"]).join(n, "lang")
    wide = lambda x: f"CAST({x} AS DECIMAL(19,0))"
    score = F.expr(f"CAST(({wide('a * 1000')} * {wide('n')}) div ({wide('l')} * {wide('r')}) AS BIGINT)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "c", "l", "r")).alias("x"))
    inner = cand.where("k > 2").select("lang", "w", "k", "a", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    inner = inner.select("lang", "w", "size", "a", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("from"))
    inner = inner.select("lang", part(F.col("from"), F.col("size")).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = scored.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.col("x.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score"))
