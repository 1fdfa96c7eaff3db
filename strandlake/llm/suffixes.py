"""Byte strings that stand twice in a corpus, by sorting suffixes in range-partitioned buckets.

Sorting every suffix would carry each byte 200 times. Of each window of ``length`` bytes only the suffix at its anchor is
sorted: the place of the least hash of GRAM bytes in the window, which equal windows have in common.

1. Anchors whose GRAM bytes stand at one place only are left out, by counts per hash and a Bloom filter of fixed size.
2. An anchor's suffix runs to the end of the last window that it serves; what stands before it, read backwards, is
   its prefix. Sampled splitters range-partition the anchors by suffix, then prefix, then a salt, so that texts that
   thousands of documents share spread over buckets. Each bucket is put in order by a multikey quicksort over
   words of 8 bytes, neighbours are compared, and so are the ends of neighbouring buckets. The same is done by prefix, then
   suffix.
3. The neighbour with most of the suffix in common, and what it has of the prefix, tell which windows repeat, and the other
   way round. Windows that neither order decides (between those of the two neighbours) are sorted whole, beside all windows
   equal to them.
4. Repeated windows are joined into spans per text, and cut from each document that has the text.

Texts are told apart by their MD5, so that copies are worked on once per task; of a text with copies all goes. Defined
results: a null text is empty; texts shorter than ``length`` keep all; repeated rows are copies, whatever their ids; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .filters import bloom, holds, passes
from .minhash import mix

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
GRAM = 64
#: Anchors in a bucket, about; bytes hashed at once; anchors or windows that a task knows again (what it has forgotten is sorted).
BUCKET, SLICE, MET = 1 << 14, 1 << 16, 1 << 17
END = b"\xff"  # stands in no UTF-8 text
_BYTE = mix(np.arange(256, dtype=_U) + _U(77))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, _U)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return both[0], both[1]


_UP, _DOWN = _powers(2 * SLICE)


def gram_hashes(text: bytes, k: int) -> np.ndarray:
    """A polynomial hash of the k bytes from each place on; bytes stand for random words, so that its high half is well mixed."""
    out = []
    for at in range(0, len(text) - k + 1, SLICE):
        b = np.frombuffer(text, np.uint8, min(SLICE + k - 1, len(text) - at), at)
        sums = np.zeros(len(b) + 1, _U)
        np.cumsum(_BYTE[b] * _UP[: len(b)], out=sums[1:])
        out.append((sums[k:] - sums[:-k]) * _DOWN[: len(b) - k + 1])
    return np.concatenate(out) if out else np.zeros(0, _U)


def _sliding(best, x: np.ndarray, width: int) -> np.ndarray:
    """Minimum or maximum of width values from each place on."""
    span = 1
    while span * 2 <= width:
        x, span = best(x[:-span], x[span:]), span * 2
    return best(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def anchors(text: bytes, length: int, gram: int = GRAM):
    """(hash, place, first window, last window) of the anchors of a text."""
    if len(text) < length:
        return (np.zeros(0, _U), *(np.zeros(0, np.int64) for _ in range(3)))
    g = gram_hashes(text, gram)
    # Half of the hash is compared, above the place: what ties goes to the first place, alike in equal windows.
    key = (g & _U(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=_U)
    at = _sliding(np.minimum, key, length - gram + 1).astype(np.uint32)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    place = at[first].astype(np.int64)
    return mix(g[place]), place, first, np.append(first[1:], len(at)) - 1


def _words(column: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings as rows of bytes, padded with zeros, and their lengths without END."""
    size = np.fromiter(map(len, column), np.int64, len(column))
    out = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in column]), np.uint8).reshape(-1, width)
    closed = (size > 0) & (out[np.arange(len(out)), np.maximum(size, 1) - 1] == END[0])
    return out, size - closed


def multikey_quicksort(rows: np.ndarray) -> np.ndarray:
    """The order of rows of 8-byte words. All stretches that still tie are split by their next word at once."""
    order, segment = np.arange(len(rows)), np.zeros(len(rows), np.int64)
    tied = np.arange(len(rows))  # places in the order that are not settled
    for d in range(rows.shape[1]):
        word = rows[order[tied], d]
        by = np.lexsort((word, segment[tied]))
        order[tied] = order[tied][by]
        word, part = word[by], segment[tied]
        new = np.concatenate(([True], (word[1:] != word[:-1]) | (part[1:] != part[:-1])))
        ids = np.cumsum(new)
        segment[tied] = tied[np.flatnonzero(new)][ids - 1]
        size = np.bincount(ids)[ids]
        tied = tied[size > 1]
        if not len(tied):
            break
    return order


def _common(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Common leading bytes of each row and the next."""
    if len(rows) < 2:
        return np.zeros(0, np.int64)
    differ = rows[1:] != rows[:-1]
    lead = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(lead, np.minimum(size[1:], size[:-1]))


def _compared(a, a_size, b, b_size):
    """most: common bytes of a with the better neighbour; full: of b with that one (-1: no neighbour)."""
    n = len(a)
    lead, tail = _common(a, a_size), _common(b, b_size)
    most, full = np.full(n, -1), np.full(n, -1)
    if n > 1:
        most[1:] = lead
        most[:-1] = np.maximum(most[:-1], lead)
        full[1:] = np.where(lead == most[1:], tail, -1)
        full[:-1] = np.maximum(full[:-1], np.where(lead == most[:-1], tail, -1))
    return most, full


def neighbours(rows: DataFrame, a: str, b: str, a_width: int, b_width: int) -> DataFrame:
    """For each place (t, p) of rows: most (bytes of a in common with any other place) and full (of b, with a place that has
    so many of a; the most of b that any has where all of a is equal; -1 where there is no other place)."""
    names = ["t", "p", "most", "full", "bucket", "seq", "a", "b"]

    def arranged(batches):
        """The bucket in order, one row for each place."""
        t, p, first, second = [], [], [], []
        for batch in batches:
            t += batch.column("t").to_pylist()
            p += batch.column("p").to_pylist()
            first += batch.column("a").to_pylist()
            second += batch.column("b").to_pylist()
        if not t:
            return None
        (x, nx), (y, ny) = _words(first, a_width), _words(second, b_width)
        ids = np.frombuffer(b"".join(t), ">u8").reshape(-1, 2).astype(_U)
        keys = np.concatenate((x.view(">u8").astype(_U), y.view(">u8").astype(_U), ids, np.array(p, _U)[:, None]), axis=1)
        order = multikey_quicksort(keys)
        keys = keys[order]
        order = order[np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))]
        return order, x[order], nx[order], y[order], ny[order], t, p, first, second

    def run(batches):
        if (got := arranged(batches)) is None:
            return
        order, x, nx, y, ny, t, p, first, second = got
        most, full = _compared(x, nx, y, ny)
        n, bucket = len(order), TaskContext.get().partitionId()
        seq = np.arange(n)
        edge = (seq < 2) | (seq >= n - 2)
        pick = lambda c, ok=None: [c[i] if ok is None or ok[k] else None for k, i in enumerate(order.tolist())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(pick(t), pa.binary()), pa.array(pick(p), pa.int64()), pa.array(most), pa.array(full), pa.array(np.full(n, bucket)), pa.array(np.where(edge, seq, -1)), pa.array(pick(first, edge), pa.binary()), pa.array(pick(second, edge), pa.binary())],
            names=names,
        )

    def across(batches):
        for batch in batches:
            t, p, most, full = [], [], [], []
            for t0, p0, a0, b0, t1, p1, a1, b1 in zip(*(batch.column(c).to_pylist() for c in ("t0", "p0", "a0", "b0", "t", "p", "a", "b"))):
                (x, nx), (y, ny) = _words([a0, a1], a_width), _words([b0, b1], b_width)
                m, f = _compared(x, nx, y, ny)
                t, p, most, full = t + [t0, t1], p + [p0, p1], most + [m[0]] * 2, full + [f[0]] * 2
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.binary()), pa.array(p, pa.int64()), pa.array(most, pa.int64()), pa.array(full, pa.int64())], names=names[:4])

    buckets = max(1, -(-rows.count() // BUCKET))
    dealt = rows.select("t", "p", F.col(a).alias("a"), F.col(b).alias("b")).repartitionByRange(buckets, "a", "b", F.xxhash64("t", "p"))
    out = stored(dealt.mapInArrow(run, "t binary, p long, most long, full long, bucket long, seq long, a binary, b binary"), "sorted")
    # Ends of buckets, four rows of each: what one place fills passes on to the next bucket.
    by = Window.orderBy("bucket", "seq")
    ends = out.where("seq >= 0").withColumns({"t0": F.lag("t").over(by), "p0": F.lag("p").over(by)})
    ends = ends.where("t0 IS NULL OR t0 <> t OR p0 <> p").select("t", "p", "a", "b", "bucket", "seq")
    ends = ends.withColumns({f"{c}0": F.lag(c).over(by) for c in ("t", "p", "a", "b")}).where("t0 IS NOT NULL")
    met = ends.mapInArrow(across, "t binary, p long, most long, full long")
    # Copies of one place may stand in two buckets.
    best = out.select("t", "p", "most", "full").unionByName(met).groupBy("t", "p").agg(F.max(F.struct("most", "full")).alias("best"))
    return best.select("t", "p", "best.most", "best.full")


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.unhex(F.md5(text)).alias("t"), F.encode(text, "UTF-8").alias("text"))


def _each_text(batches):
    """(md5, text) of the distinct texts of a task, in order."""
    seen = set()
    for batch in batches:
        for t, text in zip(batch.column("t"), batch.column("text")):
            if (t := t.as_py()) not in seen:
                seen.add(t)
                yield t, text.as_py()


def _in_batches(rows, schema, size: int = 1 << 14):
    """Tuples of row lists as record batches of about size rows."""
    held, n = [[] for _ in schema], 0
    for cols in rows:
        for h, c in zip(held, cols):
            h.extend(c)
        n += len(cols[0])
        if n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(h, f.type) for h, f in zip(held, schema)], schema=schema)
            held, n = [[] for _ in schema], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(h, f.type) for h, f in zip(held, schema)], schema=schema)


def _place(t: bytes, at: np.ndarray) -> np.ndarray:
    return mix(at.astype(_U) * _U(_BASE) + _U(int.from_bytes(t[:8], "little")))


def shared_anchors(texts: DataFrame, length: int) -> DataFrame:
    """t, p, i, j, h, prefix (backwards) and suffix of each anchor whose bytes (hash h) may stand elsewhere too; it serves windows i to j.

    Where a task meets the same prefix and suffix again, its windows repeat: they come as rows without prefix and suffix,
    and only the first place goes on to be sorted. A passage of many documents is so one row for each task."""
    back = length - GRAM

    def hashed(batches):
        held, n = [], 0
        whole = lambda: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*held)], names=["h", "place"])
        for t, text in _each_text(batches):
            h, p, _, _ = anchors(text, length)
            held.append((h, _place(t, p)))
            n += len(h)
            if n >= 1 << 16:
                yield whole()
                held, n = [], 0
        if held:
            yield whole()

    places = texts.mapInArrow(hashed, "h long, place long").groupBy("h").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    known = bloom(stored(places.where("low < high").select("h"), "shared-grams"))

    def cut(batches):
        bits = known.value
        kind = pa.schema([("t", pa.binary()), ("p", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("h", pa.int64()), ("prefix", pa.binary()), ("suffix", pa.binary())])

        def rows():
            first: dict[bytes, tuple | None] = {}
            for t, text in _each_text(batches):
                h, p, i, j = anchors(text, length)
                of = np.flatnonzero(holds(bits, h))
                out = []
                for at, low, high, gram in zip(p[of].tolist(), i[of].tolist(), j[of].tolist(), h.view(np.int64)[of].tolist()):
                    prefix = text[at - back : at][::-1] if at >= back else text[:at][::-1] + END
                    suffix = text[at : at + length] if at + length <= len(text) else text[at:] + END
                    key = hashlib.blake2b(prefix + suffix, digest_size=16, salt=len(prefix).to_bytes(4, "little")).digest()
                    if key not in first:
                        if len(first) >= MET:
                            first.clear()
                        first[key] = (t, at, low, high, gram)
                        out.append((t, at, low, high, gram, prefix, suffix))
                        continue
                    if first[key]:
                        out.append((*first[key], None, None))
                        first[key] = None
                    out.append((t, at, low, high, gram, None, None))
                if out:
                    yield tuple(zip(*out))

        yield from _in_batches(rows(), kind)

    return texts.mapInArrow(cut, "t binary, p long, i long, j long, h long, prefix binary, suffix binary")


def repeated_windows(texts: DataFrame, length: int) -> DataFrame:
    """t, i, j: in the text of md5 t, every string of length bytes that starts at i to j stands elsewhere too."""
    back = length - GRAM
    told = stored(shared_anchors(texts, length), "anchors")
    found = told.where("suffix IS NOT NULL")
    wide = (length + 7) // 8 * 8, (back + 7) // 8 * 8
    forth = neighbours(found, "suffix", "prefix", wide[0], wide[1]).select("t", "p", F.col("most").alias("r"), F.col("full").alias("l_full"))
    aback = neighbours(found, "prefix", "suffix", wide[1], wide[0]).select("t", "p", F.col("most").alias("l"), F.col("full").alias("r_full"))
    both = found.select("t", "p", "i", "j", "h").distinct().join(forth, ["t", "p"]).join(aback, ["t", "p"])
    # Of windows i to j, only those from `bottom` to `top` can repeat; those from `since` on and those up to `until` do, as a
    # neighbour has both ends in common; between them, `low` to `high` may.
    both = both.withColumns({"bottom": F.greatest("i", F.col("p") - F.col("l")), "top": F.least("j", F.col("p") + F.col("r") - length)})
    both = both.withColumns({"since": F.when(F.col("l_full") >= 0, F.greatest("i", F.col("p") - F.col("l_full"))).otherwise(F.col("j") + 1), "until": F.when(F.col("r_full") >= 0, F.least("j", F.col("p") + F.col("r_full") - length)).otherwise(F.col("i") - 1)})
    both = both.withColumns({"low": F.greatest("bottom", F.col("until") + 1), "high": F.least("top", F.col("since") - 1)})
    both = stored(both.select("t", "p", "h", "bottom", "top", "since", "until", "low", "high"), "decided")
    sure = both.select("t", F.col("since").alias("i"), F.col("top").alias("j")).union(both.select("t", F.col("bottom").alias("i"), F.col("until").alias("j"))).where("i <= j")
    sure = sure.union(told.where("suffix IS NULL").select("t", "i", "j"))
    return sure.union(_open_windows(found, both.where("low <= high").select("t", "p", "h", "low", "high"), length))


def _offsets(h: np.ndarray, p: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows i to j of each anchor: its row, the window, and a hash of the anchor's bytes and the offset."""
    n = j - i + 1
    row = np.repeat(np.arange(len(n)), n)
    window = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + i[row]
    return row, window, mix(h[row] + (p[row] - window).astype(_U) * _U(_BASE))


def _open_windows(found: DataFrame, open_: DataFrame, length: int) -> DataFrame:
    """t, i, j of the windows low to high of anchors that stand elsewhere too.

    Windows that may equal an open one have an anchor of the same bytes at the same offset; only anchors of such bytes are
    looked at, and of their windows the ones with the bytes of an open window are sorted beside them."""
    known = bloom(open_.select("h").distinct())
    some = stored(found.where(passes(known, F.col("h"))), "open-anchors")
    own = some.join(open_.drop("h"), ["t", "p"]).select("p", F.col("low").alias("i"), F.col("high").alias("j"), "h", "prefix", "suffix")
    longs = lambda batch, c: batch.column(c).to_numpy(zero_copy_only=False)

    def windows_of(batch, may=None):
        """Of the windows of a batch of anchors, or those whose bytes and offset the filter knows: row, window, where it starts
        in the bytes that come fourth, a hash of its own bytes, and one of its anchor's bytes and offset."""
        p = longs(batch, "p")
        row, window, o = _offsets(longs(batch, "h").view(_U), p, longs(batch, "i"), longs(batch, "j"))
        if may is not None:
            known = holds(may, o)
            row, window, o = row[known], window[known], o[known]
        before = [x.removesuffix(END) for x in batch.column("prefix").to_pylist()]
        texts = [x[::-1] + y for x, y in zip(before, batch.column("suffix").to_pylist())]
        ends = np.cumsum([len(x) for x in texts])
        zero = np.append(0, ends[:-1]) + [len(x) for x in before] - p
        at, text = zero[row] + window, b"".join(texts)
        return row, window, at, text, mix(gram_hashes(text, length)[at]), o

    def sliced(batches):
        return (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024))

    def hashed(batches):
        for batch in sliced(batches):
            *_, d, o = windows_of(batch)
            yield pa.RecordBatch.from_arrays([pa.array(d.view(np.int64)), pa.array(o.view(np.int64))], names=["d", "o"])

    keys = stored(own.mapInArrow(hashed, "d long, o long").distinct(), "open-keys")
    same, near = bloom(keys.select(F.col("d").alias("h"))), bloom(keys.select(F.col("o").alias("h")))
    kind = pa.schema([("t", pa.binary()), ("p", pa.int64()), ("j", pa.int64()), ("w", pa.binary()), ("none", pa.binary())])

    def alike(batches):
        first: dict[bytes, tuple | None] = {}

        def rows():
            for batch in sliced(batches):
                row, window, at, text, d, _ = windows_of(batch, near.value)
                good = holds(same.value, d)
                out, run = [], None  # run: windows in a row that the task has met before
                for r, k, w in zip(row[good].tolist(), window[good].tolist(), (text[a : a + length] for a in at[good].tolist())):
                    key = hashlib.blake2b(w, digest_size=16).digest()
                    t = batch.column("t")[r].as_py()
                    if key not in first:
                        if len(first) >= MET:
                            first.clear()
                        first[key] = (t, k)
                        out.append((t, k, k, w, b""))
                        continue
                    if first[key]:
                        out.append((*first[key], first[key][1], None, None))
                        first[key] = None
                    if run and run[0] == t and run[2] + 1 == k:
                        run[2] = k
                        continue
                    if run:
                        out.append((*run, None, None))
                    run = [t, k, k]
                if run:
                    out.append((*run, None, None))
                if out:
                    yield tuple(zip(*out))

        yield from _in_batches(rows(), kind)

    # As among anchors, what a task meets twice is told at once and its first place goes on.
    windows = stored(some.mapInArrow(alike, "t binary, p long, j long, w binary, none binary"), "open-windows")
    met = neighbours(windows.where("w IS NOT NULL"), "w", "none", (length + 7) // 8 * 8, 8)
    single = met.where(F.col("most") == length).select("t", F.col("p").alias("i"), F.col("p").alias("j"))
    return single.union(windows.where("w IS NULL").select("t", F.col("p").alias("i"), "j"))


def cut_repeats(docs: DataFrame, length: int = 200, text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes left) of each document: every byte goes that lies in a string
    of length bytes which also starts anywhere else."""
    texts = _texts(docs, text_col)
    windows = repeated_windows(texts, length)
    spans = stored(windows.groupBy("t").agg(F.collect_list(F.struct("i", (F.col("j") + length).alias("j"))).alias("spans")), "spans")
    slim = docs.select(F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))).alias("t"))
    copies = stored(slim.groupBy("t").agg(F.count("*").alias("n")).where("n > 1"), "copies")
    known = bloom(spans.select("t").union(copies.select("t")).select(F.xxhash64("t").alias("h")))
    # Texts that hold no span and have no copy need no join, and stay in the JVM as they are.
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select("doc_id", F.unhex(F.md5(text)).alias("t"), F.encode(text, "UTF-8").alias("text")).withColumn("may", passes(known, F.xxhash64("t")))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Texts with over a thousandth of all rows are a thousand at most; they need no join on texts either, as they go whole.
    hot = F.broadcast(copies.where(F.col("n") > F.lit(docs.count() / 1000)).select("t", F.lit(True).alias("hot")))
    size, goes = F.length("text").cast("long"), F.col("hot").isNotNull() & (F.length("text") >= length)
    plain = rows.join(hot, "t", "left").where("hot OR NOT may").select(
        "doc_id",
        size.alias("n_bytes"),
        F.when(goes, size).otherwise(0).alias("n_removed"),
        F.when(goes, 1).otherwise(0).cast("long").alias("n_spans"),
        F.when(goes, F.lit(b"")).otherwise(F.col("text")).alias("kept"),
    )
    whole = F.array(F.struct(F.lit(0).cast("long").alias("i"), size.alias("j")))
    is_copy = F.col("copy").isNotNull() & (F.length("text") >= length)
    joined = rows.where("may").join(hot, "t", "left_anti").join(spans, "t", "left").join(copies.select("t", F.lit(True).alias("copy")), "t", "left")
    joined = joined.select("doc_id", "text", F.when(is_copy, whole).otherwise(F.col("spans")).alias("spans"))

    def cut(batches):
        for batch in (b.slice(at, 1024) for b in batches for at in range(0, b.num_rows, 1024)):
            n, gone, count, kept = [], [], [], []
            spans_, texts = batch.column("spans"), batch.column("text")
            for r in range(len(texts)):
                text, row = texts[r].as_py(), spans_[r].values
                out, at, runs = [], 0, 0
                if row is not None and len(row):
                    i, j = (row.field(c).to_numpy(zero_copy_only=False) for c in "ij")
                    order = np.argsort(i, kind="stable")
                    i, reach = i[order], np.maximum.accumulate(j[order])
                    first = np.flatnonzero(np.concatenate(([True], i[1:] > reach[:-1])))
                    runs = len(first)
                    for s, e in zip(i[first].tolist(), reach[np.append(first[1:], len(i)) - 1].tolist()):
                        out.append(text[at:s])
                        at = e
                left = b"".join(out) + text[at:]
                n.append(len(text))
                gone.append(len(text) - len(left))
                count.append(runs)
                kept.append(left)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (n, gone, count)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return plain.unionByName(joined.mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary"))
