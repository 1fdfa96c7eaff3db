"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are compared in a plain form: ASCII letters in lower case, every run of other ASCII
characters one space (none at the ends of an item), other bytes as they are. An item of m bytes may be found with up
to ``k = floor(error_rate * m)`` edits, whatever its length. A copy with k edits shares at least ``m + 1 - q * (k + 1)``
q-grams with the item, on diagonals (text place minus item place) at most k apart:

1. Each task looks the q-grams of its texts up in the item index and counts the shared ones in overlapping
   diagonal bands (two neighbouring cells, each at least k wide).
2. Bands that reach the lemma's bound become regions: (document, item, bytes of the text under the band).
3. Regions are verified by an alignment that walks the diagonals of the band only, for all regions of an item at once.

q is the largest of 8, 4, 2 and 1 for which the bound is positive, so no item is left out and none gets fewer edits
than its length allows; items of one q share an index. An item so short that it may have no edits (under 10 bytes at
the default rate) must stand as whole words. An item without letters or digits says nothing and is not searched.

Texts are read once per block of items and are not shuffled; regions are about as long as their items. The item
index goes to the executors in blocks of at most about ``block_bytes`` of item text, so that the broadcast is
bounded whatever the benchmark's size.

Defined results: null and empty texts match nothing; items that repeat are each reported; repeated documents are
each reported once per item; a null doc_id is reported as null; empty tables give an empty table; other
columns are ignored, and ``decontaminate`` passes them through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import packed

Q_GRAMS, ERROR_RATE = (8, 4, 2, 1), 0.1

_PLAIN = np.full(256, 0x20, np.uint8)
for _b in [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]:
    _PLAIN[_b] = _b
for _b in range(0x41, 0x5B):
    _PLAIN[_b] = _b + 32
_SPREAD, _BITS = np.uint64(0x9E3779B97F4A7C15), 22
_CELLS = 1 << 22  # of a batch of alignments


def plain(text: str) -> np.ndarray:
    b = _PLAIN[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    blank = b == 0x20
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    return np.ascontiguousarray(b[keep])


def grams(b: np.ndarray, q: int) -> np.ndarray:
    """The q-grams of b as numbers (q is 8, 4, 2 or 1 bytes)."""
    if len(b) < q:
        return np.zeros(0, np.uint64)
    return np.lib.stride_tricks.sliding_window_view(b, q).copy().view(f"<u{q}").ravel().astype(np.uint64)


class Item:
    """A benchmark item: its plain text, the edits allowed and the q-grams that a copy shares at least."""

    def __init__(self, text: str, error_rate: float):
        body = plain(text).tobytes().strip(b" ")
        self.size, self.k = len(body), int(error_rate * len(body))
        # without edits the item must be whole words: the spaces around it are part of it
        self.text = np.frombuffer(body if self.k else b" " + body + b" ", np.uint8)
        m = len(self.text)
        self.q = next((q for q in Q_GRAMS if m + 1 - q * (self.k + 1) > 0), 1)
        self.least = max(1, m + 1 - self.q * (self.k + 1))


class ItemIndex:
    """q-grams of items that share q: sorted, with the items and places where they stand."""

    def __init__(self, items: list[tuple[int, Item]], q: int):
        self.q, self.numbers, self.text = q, [n for n, _ in items], [x.text for _, x in items]
        self.k, self.least = np.array([x.k for _, x in items], np.int64), np.array([x.least for _, x in items], np.int64)
        all_grams = [grams(t, q) for t in self.text]
        g = np.concatenate(all_grams)
        item = np.repeat(np.arange(len(items)), [len(x) for x in all_grams])
        place = np.concatenate([np.arange(len(x)) for x in all_grams])
        order = np.argsort(g, kind="stable")
        self.grams, self.first, self.count = np.unique(g[order], return_index=True, return_counts=True)
        self.item, self.place = item[order], place[order]
        self.seen = np.zeros(1 << _BITS, bool)
        self.seen[(self.grams * _SPREAD) >> np.uint64(64 - _BITS)] = True
        self.cell = 1 << int(max(1, self.k.max())).bit_length()
        self.longest = max(map(len, self.text))

    def regions(self, b: np.ndarray):
        """(item number, region of the plain text b, shared q-grams) of each band over its bound.

        Place 0 of a region lies on the band's lowest diagonal, less k; what a region takes beyond the text is zero bytes.
        """
        g = grams(b, self.q)
        at = np.flatnonzero(self.seen[(g * _SPREAD) >> np.uint64(64 - _BITS)])
        if len(at) < self.least.min():
            return
        found = np.searchsorted(self.grams, g[at])
        found[found == len(self.grams)] = 0
        true = self.grams[found] == g[at]
        at, found = at[true], found[true]
        if len(at) < self.least.min():
            return
        width = int((len(b) + self.longest) // self.cell) + 2
        hits: dict[str, list] = {"used": [], "n": []}
        # places go in slices, so that a long text of frequent q-grams never meets all its places at once
        cuts = np.flatnonzero(np.diff(np.cumsum(self.count[found]) // _CELLS)) + 1
        for part in np.split(np.arange(len(at)), cuts):
            n = self.count[found[part]]
            entry = np.repeat(self.first[found[part]] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            cell = (np.repeat(at[part], n) - self.place[entry] + self.longest) // self.cell
            used, n = np.unique(self.item[entry] * width + cell, return_counts=True)
            hits["used"].append(used)
            hits["n"].append(n)
        used, back = np.unique(np.concatenate(hits["used"]), return_inverse=True)
        hit = np.bincount(back, np.concatenate(hits["n"])).astype(np.int64)
        after = np.minimum(np.searchsorted(used, used + 1), len(used) - 1)
        band = hit + np.where(used[after] == used + 1, hit[after], 0)
        over = band >= self.least[used // width]
        used, band = used[over], band[over]
        # neighbouring bands over the bound make one region
        for run in np.split(np.arange(len(used)), np.flatnonzero(np.diff(used) > 1) + 1) if len(used) else ():
            i = int(used[run[0]] // width)
            k = int(self.k[i])
            start = int(used[run[0]] % width) * self.cell - self.longest - k
            end = (int(used[run[-1]] % width) + 2) * self.cell - self.longest + k + len(self.text[i])
            inside = b[max(0, start) : max(0, end)].tobytes()
            yield self.numbers[i], (b"\0" * max(0, -start) + inside).ljust(end - start, b"\0"), int(band[run].max())


def indexes(items: list[Item]) -> list[ItemIndex]:
    by_q: dict[int, list] = {}
    for n, item in enumerate(items):
        by_q.setdefault(item.q, []).append((n, item))
    return [ItemIndex(group, q) for q, group in sorted(by_q.items())]


def banded_edits(item: np.ndarray, regions: list[bytes], limit: int) -> np.ndarray:
    """Least edits that turn the item into some part of each region, along the diagonals from a region's start to the
    one that ends with it; limit + 1 where more are needed. Row i of the alignment holds one number per diagonal."""
    out = np.empty(len(regions), np.int64)
    widths = np.array([len(r) - len(item) for r in regions])
    order = np.argsort(widths, kind="stable")
    at = 0
    while at < len(order):
        part = order[at : at + max(1, _CELLS // (2 * int(widths[order[at]]) + 64 + len(item)))]
        part = part[widths[part] <= 2 * widths[part[0]] + 64]  # regions of like width
        at += len(part)
        w = int(widths[part].max())
        text = np.zeros((len(part), len(item) + w), np.uint8)
        for row, i in enumerate(part):
            text[row, : len(regions[i])] = np.frombuffer(regions[i], np.uint8)
        d = np.arange(w + 1, dtype=np.int32)
        cost = np.zeros((len(part), w + 1), np.int32)
        for i, byte in enumerate(item):
            new = cost + (text[:, i : i + w + 1] != byte)
            np.minimum(new[:, :-1], cost[:, 1:] + 1, out=new[:, :-1])  # the item's byte is left out
            cost = np.minimum.accumulate(new - d, axis=1) + d  # bytes of the text are left out
            if not i % 32 and cost.min() > limit:
                break
        out[part] = np.minimum(cost.min(axis=1), limit + 1)
    return out


def find_matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, item_id, edits, max_edits (allowed for the item), similarity and shared_qgrams of each benchmark item found in each document."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", "text").where(F.octet_length("text") > 0)
    n_blocks = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    id_type, item_type = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    texts = docs.select("doc_id", "text").where(F.octet_length("text") > 0)
    out = spark.createDataFrame([], f"doc_id {id_type}, item_id {item_type}, edits int, max_edits int, similarity double, shared_qgrams int")
    columns_out, n_tasks = out.columns, int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    for block in range(n_blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).orderBy("item_id", "text").collect()  # about block_bytes
        ids, block_items = [], []
        for row in rows:
            if (item := Item(row[1], error_rate)).size:
                ids.append(row[0])
                block_items.append(item)
        if not ids:
            continue
        shared = spark.sparkContext.broadcast((pa.array(ids, to_arrow_type(benchmark.schema["item_id"].dataType)), block_items))

        def seek(batches, shared=shared):
            index = indexes(shared.value[1])
            for batch in batches:
                at, found = [], []
                for row, t in enumerate(batch.column("text")):
                    b = plain(f"x {t.as_py()} ")[1:]  # a space before and after the text
                    for part in index:
                        for region in part.regions(b):
                            at.append(row)
                            found.append(region)
                columns = [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.binary()), pa.array([f[2] for f in found], pa.int32())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *columns], names=["doc_id", "item_no", "region", "shared"])

        def align(batches, shared=shared):
            names, items_ = shared.value
            for batch in batches:
                number = batch.column("item_no").to_numpy()
                regions = batch.column("region").to_pylist()
                n = np.empty(len(number), np.int64)
                for i in np.unique(number):
                    here = np.flatnonzero(number == i)
                    n[here] = banded_edits(items_[i].text, [regions[j] for j in here], items_[i].k)
                k, size = (np.array([getattr(x, name) for x in items_], np.int64)[number] for name in ("k", "size"))
                columns = [batch.column("doc_id"), names.take(pa.array(number)), pa.array(n, pa.int32()), pa.array(k, pa.int32()), pa.array(1 - n / size, pa.float64()), batch.column("shared")]
                yield pa.RecordBatch.from_arrays(columns, names=columns_out).filter(pa.array(n <= k))

        # regions are dealt out anew, in a fixed number of parts: they gather in few tasks, and alignment costs more than the search
        regions = texts.mapInArrow(seek, f"doc_id {id_type}, item_no int, region binary, shared int").repartition(n_tasks, "doc_id", "item_no", "region")
        out = out.union(regions.mapInArrow(align, out.schema))
    return out.groupBy("doc_id", "item_id").agg(
        F.min("edits").alias("edits"), F.max("max_edits").alias("max_edits"), F.max("similarity").alias("similarity"), F.max("shared_qgrams").alias("shared_qgrams")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """docs without the rows whose id has a text that holds a benchmark item."""
    leaks = find_matches(docs, benchmark, error_rate).select(F.col("doc_id").alias("leak")).distinct()
    return packed(docs).join(leaks, F.col("d.doc_id").eqNullSafe(F.col("leak")), "left_anti").select("d.*")
