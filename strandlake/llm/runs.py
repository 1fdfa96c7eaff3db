"""Periodic runs of words, found on a Re-Pair grammar of each text.

1. The words of a text become ids. A run of at least 24 words and three periods repeats some 16 words further on, so a
   text (or a part of the grammar) in which no 16 words return holds none and is left at once.
2. Re-Pair: in rounds, pairs of symbols that stand more than once become nonterminals. A pair gives way only where it
   overlaps a more frequent one, so that the most frequent pair of a round is replaced wherever it stands and others that
   do not compete with it are replaced in the same round. What is left of the text is halved into a balanced tree.
3. For each nonterminal the runs that cross the boundary of its two halves are worked out once, at its first place and
   inside its own expansion. Extensions are compared exactly, by names of blocks of 2, 4, 8, ... words.
4. They are carried to every place where the nonterminal is derived; intervals of one period that overlap by a period
   are merged. The lowest node over a run has it whole, so merged intervals are maximal.

A text is one row of one task: no shuffle, and memory in proportion to the longest text. Defined results: a null or blank
text has no words and no runs; repeated rows are treated alike, whatever their ids; an empty table gives an empty table;
other columns pass through, but for input columns called ``runs`` or ``collapsed``, which the results replace.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .minhash import mix

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k ids from each place on; equal ids give equal hashes."""
    out = np.zeros(len(ids) - k + 1, _U)
    for i in range(k):
        out = out * _U(_BASE) + ids[i : len(ids) - k + 1 + i]
    return out


def returning(ids: np.ndarray, k: int) -> np.ndarray:
    """True at each place whose k ids stand again further on."""
    flags = np.zeros(len(ids), bool)
    if len(ids) > k:
        g = _grams(mix(ids.astype(_U)), k)
        order = np.argsort(g, kind="stable")
        same = g[order][1:] == g[order][:-1]
        flags[order[:-1][same]] = True
    return flags


def block_names(ids: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ... numbers that are equal where blocks of 2**k ids are."""
    names = [np.unique(ids, return_inverse=True)[1].astype(np.int64)]
    while (half := 1 << (len(names) - 1)) * 2 <= len(ids):
        low = names[-1]
        names.append(np.unique(low[: len(low) - half] * (int(low.max()) + 1) + low[half:], return_inverse=True)[1])
    return names


def common_after(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many ids agree from i and j (i < j) on, most at the utmost."""
    done = np.zeros_like(i)
    for k in range(len(names) - 1, -1, -1):
        for _ in range(2 if k == len(names) - 1 else 1):
            fits = done + (1 << k) <= most
            at, to = np.where(fits, i + done, 0), np.where(fits, j + done, 0)
            done += np.where(fits & (names[k][at] == names[k][to]), 1 << k, 0)
    return done


def common_before(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many ids agree before i and j (both left out), most at the utmost."""
    done = np.zeros_like(i)
    for k in range(len(names) - 1, -1, -1):
        for _ in range(2 if k == len(names) - 1 else 1):
            fits = done + (1 << k) <= most
            at, to = np.where(fits, i - done - (1 << k), 0), np.where(fits, j - done - (1 << k), 0)
            done += np.where(fits & (names[k][at] == names[k][to]), 1 << k, 0)
    return done


def repair(ids: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """Re-Pair. Returns, for each round, (rule, start, middle, end) of all places of its nonterminals, and the starts of
    the symbols that are left."""
    symbols, starts, rounds, fresh = ids.astype(np.int64), np.arange(len(ids), dtype=np.int64), [], int(ids.max()) + 1
    while len(symbols) > 1:
        _, pair, count = np.unique(symbols[:-1] * fresh + symbols[1:], return_inverse=True, return_counts=True)
        # A total order of pairs by frequency; those that stand once come last.
        rank = np.empty(len(count), np.int64)
        rank[np.argsort(count, kind="stable")] = np.arange(len(count))
        weight = np.where(count[pair] > 1, rank[pair], -1)
        # Pairs that overlap themselves (a a a) form stretches of one weight, of which every other place is taken.
        first = np.flatnonzero(np.concatenate(([True], weight[1:] != weight[:-1])))
        size = np.diff(np.append(first, len(weight)))
        heads = weight[first]
        peak = (heads >= 0) & (heads > np.append(-2, heads[:-1])) & (heads > np.append(heads[1:], -2))
        inside = np.arange(len(weight)) - np.repeat(first, size)
        taken = np.flatnonzero(np.repeat(peak, size) & (inside % 2 == 0))
        if not len(taken):
            break
        kinds, rule = np.unique(pair[taken], return_inverse=True)
        ends = np.append(starts, len(ids))
        rounds.append((rule, starts[taken], ends[taken + 1], ends[taken + 2]))
        symbols = symbols.copy()
        symbols[taken] = fresh + rule
        left = np.ones(len(symbols), bool)
        left[taken + 1] = False
        symbols, starts, fresh = symbols[left], starts[left], fresh + len(kinds)
        if fresh > 1 << 31:
            symbols = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
            fresh = int(symbols.max()) + 1
    return rounds, starts


def crossing(names: list[np.ndarray], x: np.ndarray, b: np.ndarray, y: np.ndarray, least: int, times: int) -> np.ndarray:
    """Rows (node, start, end, period) of the runs inside [x, y) that cross b, for each node."""
    gram, found = names[3], []
    for node, (x0, b0, y0) in enumerate(zip(x.tolist(), b.tolist(), y.tolist())):
        top = (y0 - x0) // times
        q = [np.arange(1, min(15, top) + 1)]
        # A longer period shows in the 8 words right of the boundary and their repeat, or in the 8 left of it.
        if (far := min(top, y0 - b0 - 8)) > 15:
            q.append(np.flatnonzero(gram[b0 + 16 : b0 + far + 1] == gram[b0]) + 16)
        if (far := min(top, b0 - 8 - x0)) > 15:
            q.append(far - np.flatnonzero(gram[b0 - 8 - far : b0 - 23] == gram[b0 - 8]))
        q = np.unique(np.concatenate(q))
        found.append(np.stack([np.full(len(q), node), q]))
    node, q = np.concatenate(found, axis=1)
    x, b, y = x[node], b[node], y[node]
    out = []
    for i, ok in ((b, b + q <= y), (b - q, b - q >= x)):  # the pair (i, i + q) lies on the right, then on the left
        n, i, p = node[ok], i[ok], q[ok]
        after = common_after(names, i, i + p, y[ok] - i - p)
        before = common_before(names, i, i + p, i - x[ok])
        start, end = i - before, i + p + after
        good = (end - start >= np.maximum(least, times * p)) & (start < b[ok]) & (end > b[ok])
        out.append(np.stack([n, start, end, p])[:, good])
    runs = np.concatenate(out, axis=1)
    # Of the periods of one stretch the smallest counts.
    runs = runs[:, np.lexsort((runs[3], runs[2], runs[1], runs[0]))]
    keep = np.ones(runs.shape[1], bool)
    keep[1:] = (runs[:3, 1:] != runs[:3, :-1]).any(axis=0)
    return runs[:, keep].T


def find_runs(ids: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of ids, by start and period. least: shortest run, 24 or more; times:
    periods it holds, 3 or more."""
    if least < 24 or times < 3:
        raise ValueError("runs are sought from 24 words and 3 periods on")
    n = len(ids)
    if n < least:
        return []
    flags = returning(ids, 16)
    if not flags.any():
        return []
    flagged = np.concatenate(([0], np.cumsum(flags)))
    rounds, top = repair(ids)
    nodes = []  # rows: first place (start, middle, end), and the starts of all places
    for rule, start, middle, end in rounds:
        order = np.argsort(rule, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], np.diff(rule[order]) > 0)))
        for at in np.split(order, heads[1:]):
            nodes.append((start[at[0]], middle[at[0]], end[at[0]], start[at]))
    edges = np.append(top, n)
    step = 1
    while step < len(top):
        low = np.arange(0, len(top) - step, 2 * step)
        for i in low:
            nodes.append((edges[i], edges[i + step], edges[min(i + 2 * step, len(top))], edges[i : i + 1]))
        step *= 2
    nodes = [v for v in nodes if v[2] - v[0] >= least and flagged[v[2]] > flagged[v[0]]]
    if not nodes:
        return []
    x, b, y = (np.array([v[i] for v in nodes], np.int64) for i in range(3))
    runs = crossing(block_names(ids), x, b, y, least, times)
    if not len(runs):
        return []
    places = [nodes[k][3] - x[k] for k in runs[:, 0]]
    times_each = [len(p) for p in places]
    s, e, q = (np.repeat(runs[:, i], times_each) for i in (1, 2, 3))
    moved = np.concatenate(places)
    s, e = s + moved, e + moved
    order = np.lexsort((s, q))
    s, e, q = s[order], e[order], q[order]
    lane = q * (2 * n + 2)  # keeps the periods apart
    reach = np.maximum.accumulate(e + lane)
    first = np.flatnonzero(np.concatenate(([True], s[1:] + lane[1:] > reach[:-1] - q[1:])))
    ends = reach[np.append(first[1:], len(s)) - 1] - lane[first]
    return sorted(zip(s[first].tolist(), (ends - s[first]).tolist(), q[first].tolist()), key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without those that stand in a run after its first period."""
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]


RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = 24, times: int = 3) -> DataFrame:
    """docs with ``runs`` (start, length, period in words, by start and period) and ``collapsed``: the words of the text
    joined by spaces, without those that a run repeats."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("runs", "collapsed")]
    rows = docs.select(F.struct(*kept).alias("d"), F.encode(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "UTF-8").alias("t"))
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches):
        for batch in batches:
            found, texts = [], []
            for text in batch.column("t"):
                words = WORD.findall(text.as_py())
                known: dict = {}
                ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
                runs = find_runs(ids, least, times)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(b" ".join(collapse(words, runs) if runs else words))
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())], names=["d", "runs", "collapsed"])

    schema = T.StructType([T.StructField("d", rows.schema["d"].dataType), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    return rows.mapInArrow(run, schema).select("d.*", "runs", "collapsed")
