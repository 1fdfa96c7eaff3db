"""Near-duplicate documents by SuperMinHash, banding, verification on full sets and union-find grouping.

1. Each text becomes the set of its distinct word shingles (64-bit hashes, computed with numpy per Arrow batch)
   and a SuperMinHash signature: layer j of every element puts ``j + r`` into the slot that the element's
   random permutation names at j; layers stop once no slot can fall any more. For sets of many elements that is
   one or two layers instead of one per slot.
2. Texts with the same set are one class, whatever their ids; classes are numbered and only they go on.
3. Classes that share a band of the signature are candidates. Instead of all pairs of a bucket, its members
   are compared with a hub, and later rounds only compare members that no link has joined yet: pairs inside
   a connected group can't change the grouping. Round after round takes other hubs. For members that then still
   share a bucket across groups an exact prefix filter finds the pairs that can reach the threshold at all: words
   are ordered by frequency among these members, and a pair must meet in the rarest words that its two sizes leave
   free to differ. A text full of edits of its own meets nobody there, however large its bucket is. No bucket is
   capped.
4. A pair counts only if its full shingle sets reach the threshold. Members' sets travel along the edges and
   hubs join last, so that a hub with very many members is a skewed join that Spark can split.
5. Groups are found by large-star / small-star rounds on the links, after a union-find inside each partition.

Lineage is cut by tables in the shared folder. Nothing but counts reaches the driver.

Defined results: texts without words (or null) have an empty set and stay alone; rows of equal sets are linked
whatever their doc_id; rows that share a doc_id but not a text are nodes of their own, each with its own group; a
null doc_id links like any other row, but has a null component_id and is kept; repeated rows get equal results; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

SHINGLE, BANDS, ROWS, PERCENT = 5, 28, 4, 75

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BASE = _U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_PLACE = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], _U)
_SLICE = 1 << 20
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(max(n, _SLICE + 4096), base, _U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a UTF-8 text, in order; long texts go in slices cut at white space."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + _SLICE)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        b = np.frombuffer(data, np.uint8, end - at, at)
        space = np.concatenate(([True], _SPACE[b], [True]))
        edges = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edges[::2], edges[1::2]
        up, down = _power_tables(len(b) + 1)
        sums = np.zeros(len(b) + 1, _U)
        np.cumsum((b.astype(_U) + _U(1)) * up[: len(b)], out=sums[1:])
        out.append(mix((sums[ends] - sums[starts]) * down[starts]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, _U)


def shingle_set(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's k-word shingles; of all its words as one where it has fewer."""
    w = word_hashes(text.encode("utf-8", "surrogatepass").translate(_LOWER)) if text else np.zeros(0, _U)
    if not len(w):
        return w
    size = min(k, len(w))
    s = np.full(len(w) - size + 1, size, _U)
    for i in range(size):
        s += w[i : len(w) - size + 1 + i] * _PLACE[i % len(_PLACE)] * _U(2 * (i // len(_PLACE)) + 1)
    return np.unique(mix(s))


def super_minhash(elements: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signature of a set of 64-bit hashes, in m slots."""
    h = np.full(m, np.inf)

    def draw(j):
        bits = mix(elements + _U(int(_BASE) * (j + 1) % 2**64))
        return (bits >> _U(32)).astype(np.float64) / 2**32, j + (((bits & _U(0xFFFFFFFF)) * _U(m - j)) >> _U(32)).astype(np.intp)

    r, slot = draw(0)
    np.minimum.at(h, slot, r)
    if h.max() <= 1:
        return h
    rows = np.arange(len(elements))
    p = np.tile(np.arange(m, dtype=np.int16), (len(elements), 1))
    p[rows, slot] = 0
    p[:, 0] = slot
    for j in range(1, m):
        if h.max() <= j:  # no later layer can lower any slot
            break
        r, k = draw(j)
        slot = p[rows, k].copy()
        p[rows, k] = p[:, j]
        p[:, j] = slot
        np.minimum.at(h, slot, r + j)
    return h


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    v = signature[: bands * rows].view(_U).reshape(bands, rows)
    s = np.arange(1, bands + 1).astype(_U) * _BASE
    for i in range(rows):
        s = mix(s + v[:, i])
    return s.view(np.int64)


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, key (digest of the set, null where empty) and bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            n, keys, hashes = [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), k)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                hashes.append(band_hashes(super_minhash(s, bands * rows), bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "key", "bands"],
            )

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, key binary, bands array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """key (digest) and the set as bytes of sorted 64-bit hashes, for each text with words."""

    def run(batches):
        for batch in batches:
            sets = [x.tobytes() for x in (shingle_set(t.as_py(), k) for t in batch.column("text")) if len(x)]
            keys = [hashlib.blake2b(x, digest_size=16).digest() for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], names=["key", "s"])

    return docs.select("text").mapInArrow(run, "key binary, s binary")


def verified(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges (hub, member) whose full sets reach the threshold."""
    kind = edges.schema["hub"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            keep, last, a = [], None, None
            for x, y in zip(batch.column("hub_set"), batch.column("s")):
                if last is None or x != last:
                    last, a = x, np.frombuffer(x.as_py(), _U)
                b = np.frombuffer(y.as_py(), _U)
                if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
                    keep.append(False)
                    continue
                at = np.searchsorted(a, b)
                at[at == len(a)] = 0
                common = int((a[at] == b).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            out = batch.select(["hub", "member"]).filter(pa.array(keep, pa.bool_()))
            yield out

    hubs = sets.select(F.col("rep").alias("hub"), F.col("s").alias("hub_set"))
    both = edges.join(sets.select(F.col("rep").alias("member"), "s"), "member").join(hubs, "hub")
    return both.select("hub", "member", "hub_set", "s").mapInArrow(run, f"hub {kind}, member {kind}")


def _local_stars(batches):
    """Union-find over the edges of a partition: an edge to the root for each of its nodes."""
    parent: dict = {}

    def find(x):
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    if kind is not None:
        nodes = [x for x in parent if find(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["v", "u"])


def components(edges: DataFrame) -> DataFrame:
    """node and component (smallest node reachable) for each node of edges but the smallest ones themselves."""
    kind = edges.schema.fields[0].dataType.simpleString()
    e = stored(edges.toDF("v", "u").mapInArrow(_local_stars, f"v {kind}, u {kind}").distinct(), "stars")
    while True:
        # Done when every node points at one root and no root points anywhere.
        many = e.groupBy("v").count().where(F.col("count") > 1).limit(1)
        if e.join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).union(many.select("v", "v")).count() == 0:
            return e.select(F.col("v").alias("node"), F.col("u").alias("component"))
        both = e.union(e.select("u", "v")).toDF("v", "u")
        low = stored(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m")), "least")
        large = both.join(low, "v").where(F.col("u") > F.col("v")).select(F.col("u").alias("v"), F.col("m").alias("u")).where(F.col("v") != F.col("u")).distinct()
        large = stored(large, "large-star")
        low = stored(large.groupBy("v").agg(F.min("u").alias("m")), "least")
        joined = large.join(low, "v")
        small = joined.select(F.col("u").alias("v"), F.col("m").alias("u")).union(joined.select("v", "m")).where(F.col("v") != F.col("u")).distinct()
        e = stored(small.mapInArrow(_local_stars, f"v {kind}, u {kind}").distinct(), "stars")


def _elements(sets: DataFrame) -> DataFrame:
    """rep, g and each element of its set."""
    kind = sets.schema["rep"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            each = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("s")]
            at = pa.array(np.repeat(np.arange(len(each)), [len(e) for e in each]))
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(at), pa.array(np.concatenate(each) if each else np.zeros(0, np.int64))], names=["rep", "e"])

    return sets.select("rep", "s").mapInArrow(run, f"rep {kind}, e long")


def prefix_pairs(members: DataFrame, sets: DataFrame, percent: int, step: float = 1.03) -> DataFrame:
    """(hub, member) of different groups that a prefix filter can't rule out; members: rep, g.

    Sizes fall into classes, each step times as large as the one before. For partners of one class a set of n elements
    gives the n - need + 1 rarest, where need is the least overlap with the smallest partner of that class. Where two
    sets meet, what follows in the shorter rest must still reach the overlap that their own sizes need.
    """
    elements = stored(_elements(sets.join(members, "rep")), "elements")
    frequency = stored(elements.groupBy("e").agg(F.count("*").alias("f")), "frequency")
    ordered = elements.join(frequency, "e").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("o"))
    n = F.size("o")
    cls = lambda x: F.floor(F.log(x) / float(np.log(step)) + 1e-9).cast("int")
    classes = F.sequence(cls(F.ceil(n * (percent / 100) - 1e-6)), cls(F.floor(n * (100 / percent) + 1e-6)))
    smallest = F.greatest(F.floor(F.pow(F.lit(step), F.col("p")) - 1e-6), F.ceil(F.col("n") * (percent / 100) - 1e-6))
    need = F.ceil(percent * (F.col("n") + smallest) / (100 + percent) - 1e-6)
    each = ordered.select("rep", "o", n.alias("n"), cls(n).alias("c"), F.explode(classes).alias("p")).withColumn("free", (F.col("n") - need + 1).cast("int")).where("free > 0")
    keyed = each.select("rep", "c", F.least("c", "p").alias("low"), F.greatest("c", "p").alias("high"), "n", F.posexplode(F.slice("o", 1, F.col("free"))).alias("i", "x"))
    keyed = keyed.select("rep", "c", "n", "i", F.xxhash64("low", "high", "x.e").alias("k"), (F.col("low") == F.col("high")).alias("one"), F.col("x.f").alias("f")).where("f > 1")
    keyed = stored(keyed.join(members, "rep").select("rep", "g", "c", "n", "i", "one", "k"), "prefixes")
    mixed = stored(keyed.groupBy("k").agg(F.min("g").alias("low"), F.max("g").alias("high")).where(F.col("low") < F.col("high")).select("k"), "prefix-keys")
    open_ = stored(keyed.join(mixed, "k"), "prefix-members")
    a, b = open_.alias("a"), open_.alias("b")
    differ = (F.col("a.rep") < F.col("b.rep")) & (F.col("a.g") != F.col("b.g")) & (F.col("a.one") | (F.col("a.c") != F.col("b.c")))
    reach = F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i")) * (100 + percent) >= percent * (F.col("a.n") + F.col("b.n"))
    return a.join(b, (F.col("a.k") == F.col("b.k")) & differ & reach).select(F.col("a.rep").alias("hub"), F.col("b.rep").alias("member")).distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, rounds: int = 3) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each document, and the text_hash that tells rows of one id apart."""
    slim = docs.select("doc_id", "text")
    sig = stored(signatures(slim.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")))), k, bands, rows), "signatures")
    # A class is a distinct set, whatever ids its rows have: it gets a number of its own, fixed by writing the table.
    # Numbers follow the smallest ids, so that the hub of a bucket is its earliest document: later ones derive from it.
    by_set = stored(sig.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("doc_id").alias("first_id"), F.any_value("bands").alias("bands")), "sets-found")
    order = (F.col("first_id").asc_nulls_last(), F.col("key"))
    classes = stored(by_set.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rep", F.monotonically_increasing_id()), "classes")
    banded = stored(classes.select("rep", F.explode(F.array_distinct("bands")).alias("bucket")), "bands")
    shared = banded.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where(F.col("low") < F.col("high"))
    # Members of buckets that hold more than one class, each with its group so far: itself.
    members = stored(banded.join(stored(shared.select("bucket"), "shared"), "bucket"), "members")
    wanted = stored(classes.join(members.select("rep").distinct(), "rep").select("rep", "key", "first_id"), "wanted")
    # One text of each class is read again: a row of its smallest id; of classes without any id, each distinct text.
    with_id = slim.join(wanted.where(F.col("first_id").isNotNull()).select(F.col("first_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    without = sig.where(F.col("doc_id").isNull()).join(wanted.where(F.col("first_id").isNull()).select("key"), "key").select("text_hash").distinct()
    hashed = slim.where(F.col("doc_id").isNull()).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit("")))).join(without, "text_hash", "left_semi")
    texts = with_id.select("text").union(hashed.groupBy(F.sha2("text", 256)).agg(F.first("text").alias("text")).select("text"))
    sets = stored(shingle_sets(texts, k).join(wanted.select("rep", "key"), "key").dropDuplicates(["rep"]).select("rep", "s"), "sets")
    links = groups = None

    def grouped():
        """Members in buckets that more than one group shares, with their group."""
        g = members if groups is None else members.join(groups.withColumnRenamed("node", "rep"), "rep", "left")
        g = g.select("bucket", "rep", (F.col("rep") if groups is None else F.coalesce("component", "rep")).alias("g"))
        if groups is None:
            return g
        g = stored(g, "grouped")
        mixed = g.groupBy("bucket").agg(F.min("g").alias("low"), F.max("g").alias("high")).where(F.col("low") < F.col("high"))
        return stored(g.join(stored(mixed.select("bucket"), "mixed"), "bucket"), "open")

    def take(edges):
        nonlocal links, groups
        found = stored(verified(edges, sets, percent), "links")
        links = found if links is None else links.union(found)
        groups = components(links.select("member", "hub"))

    tested = None
    for i in range(rounds):
        open_ = grouped()
        order = F.col("rep") if i == 0 else F.xxhash64(F.lit(i), "rep")
        hubs = stored(open_.groupBy("bucket").agg(F.min_by(F.struct("rep", "g"), order).alias("h")).select("bucket", F.col("h.rep").alias("hub"), F.col("h.g").alias("hub_g")), "hubs")
        edges = open_.join(hubs, "bucket").where(F.col("g") != F.col("hub_g"))
        if i == 0:  # one hub for each member to begin with: the smallest of its buckets
            edges = edges.groupBy(F.col("rep").alias("member")).agg(F.min("hub").alias("hub")).select("hub", "member")
        else:
            edges = edges.select("hub", F.col("rep").alias("member")).distinct()
        edges = stored(edges, "edges")
        if edges.isEmpty():
            break
        take(edges)
        tested = edges if tested is None else tested.union(edges)
    else:
        open_ = grouped()
        pairs = prefix_pairs(stored(open_.select("rep", "g").distinct(), "open-members"), sets, percent)
        if tested is not None:
            pairs = pairs.join(tested.select(F.least("hub", "member").alias("hub"), F.greatest("hub", "member").alias("member")), ["hub", "member"], "left_anti")
        pairs = stored(pairs, "pairs")
        if not pairs.isEmpty():
            take(pairs)
    if groups is None:
        final = classes.select("key", F.col("first_id").alias("component_id"))
    else:
        grouped_classes = stored(classes.join(groups, classes.rep == groups.node, "left").select("key", "first_id", F.coalesce("component", "rep").alias("g")), "groups")
        smallest = grouped_classes.groupBy("g").agg(F.min("first_id").alias("component_id"))
        final = stored(grouped_classes.join(smallest, "g").select("key", "component_id"), "group-ids")
    out = sig.select("doc_id", "n_shingles", "key", "text_hash").join(final, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")
