"""SimHash near-dedup with BK-trees.

A document's fingerprint has a bit set where over half of its shingles' hashes
have it. Equal fingerprints become one row before anything is linked, so exact
copies cost no pairs. The distinct fingerprints are dealt to shards; every shard
is a BK-tree, whose children are keyed by their integer Hamming distance to the
parent, and a search for radius r from a node at distance d follows the edges
d - r .. d + r alone.

How trees meet queries: a broadcast from the driver would take all fingerprints
through it. Instead fingerprints are routed: cut into r + 1 bands, two that differ
in at most r bits agree in at least one of them, so each fingerprint goes to one
shard for each band, chosen by the band's bits, and meets every neighbour in one of
its shards. There are as many shards as make one about 2,000 fingerprints, of many
values of the band, so it is the tree that finds the neighbours. A shard of more
than `cap` rows is split into parts, and each part's tree is sent to each part's
queries (a cell for every pair of parts), so no task gets an unbounded group. Cells
emit a spanning forest, not all pairs.

Near-duplicates by similarity use the same trees with a wider radius, routed by
MinHash bands, with a loose estimate of the Jaccard similarity as a filter. What it
connects is only where exact similarities are computed, and those alone link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, join_unique, table, written

LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42


def shingle_hashes(text: str, size: int) -> np.ndarray:
    """XXH64 of each shingle of words, repeats included; fewer words: of the whole sequence; no words: none."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER_BYTES).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    digest, shingles = xxhash.xxh64_intdigest, map(b" ".join, zip(*(words[k:] for k in range(size)), strict=False))
    return np.fromiter((digest(s, SEED) for s in shingles), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit integer."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingle_hashes(t.as_py(), size)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def band_keys(fp: Column, radius: int, shards: int) -> Column:
    """The shard of each of the radius + 1 bands of a fingerprint; a band has `shards` of them."""
    bands = radius + 1
    cuts = [round(64 * k / bands) for k in range(bands + 1)]
    part = [F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    return F.array(*[F.lit(j * shards).cast("long") + F.pmod(F.xxhash64(part[j]), F.lit(shards)) for j in range(bands)])


class BKForest:
    """One BK-tree for each group of fingerprints, all built and searched level by level.

    fps: the fingerprints; groups: ascending group numbers. child[n, d] is node n's
    child at distance d, or -1.
    """

    def __init__(self, fps: np.ndarray, groups: np.ndarray):
        self.fps = fps
        n = len(fps)
        self.child = np.full((n, 65), -1, np.int32)
        heads = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]]) if n else np.empty(0, np.int64)
        self.root = heads[np.cumsum(np.r_[True, groups[1:] != groups[:-1]]) - 1] if n else heads
        item = np.setdiff1d(np.arange(n), heads)
        node = self.root[item]
        while len(item):
            d = np.bitwise_count(fps[item] ^ fps[node]).astype(np.int64)
            # the first item to arrive at an edge becomes its node; the others go on below it
            _, first = np.unique(node * 65 + d, return_index=True)
            self.child[node[first], d[first]] = item[first]
            rest = np.ones(len(item), bool)
            rest[first] = False
            item, node = item[rest], self.child[node[rest], d[rest]].astype(np.int64)

    def search(self, query: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) index pairs within the radius, each query in its own group's tree."""
        q, node = query, self.root[query]
        while len(q):
            d = np.bitwise_count(self.fps[q] ^ self.fps[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            nexts = []
            for edge in range(-radius, radius + 1):
                at = d + edge
                ok = (at >= 0) & (at <= 64)
                below = self.child[node[ok], at[ok]]
                some = below >= 0
                nexts.append((q[ok][some], below[some].astype(np.int64)))
            q, node = (np.concatenate(x) for x in zip(*nexts, strict=True))


class Forest:
    """Labels of linked items: the smallest index of what is linked so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def union(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.label[u], self.label[v]
            apart = a != b
            if not apart.any():
                return
            u, v = u[apart], v[apart]
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(self.label, high, low)
            while (nxt := self.label[self.label]).tobytes() != self.label.tobytes():
                self.label = nxt


def cell_links(group: np.ndarray, part: np.ndarray, fps: np.ndarray, radius: int,
               similar: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(item, linked item) index pairs that connect what the cells' trees find, at most one an item.

    part: 0 for what belongs to the tree, 1 for what only asks. Cells that compare a
    part with itself have zeros alone.
    """
    forest, links = BKForest(fps[part == 0], group[part == 0]), Forest(len(fps))
    tree = np.flatnonzero(part == 0)
    place = np.cumsum(part == 0) - 1
    if len(tree) < len(fps):
        # those who ask are appended as items without children, with the root of their group
        outer = np.flatnonzero(part == 1)
        roots = dict(zip(group[tree][forest.root].tolist(), forest.root.tolist(), strict=True))
        known = np.array([roots.get(g, -1) for g in group[outer].tolist()], np.int64)
        outer, known = outer[known >= 0], known[known >= 0]
        place = place.copy()
        place[outer] = len(tree) + np.arange(len(outer))
        forest.fps = np.r_[forest.fps, fps[outer]]
        forest.root = np.r_[forest.root, known]
        back = np.r_[tree, outer]
        mixed = np.isin(group, group[outer])
        ask = np.r_[np.flatnonzero((part == 0) & ~mixed), outer]
    else:
        back, ask = tree, tree
    for at in range(0, len(ask), block):
        for q, node in forest.search(place[ask[at : at + block]], radius):
            u, v = back[q], back[node]
            apart = links.label[u] != links.label[v]
            u, v = u[apart], v[apart]
            while len(u) and similar is not None:
                # a share at a time: what that connects needs no check
                ok = similar(u[:20000], v[:20000])
                links.union(u[:20000][ok], v[:20000][ok])
                u, v = u[20000:], v[20000:]
                apart = links.label[u] != links.label[v]
                u, v = u[apart], v[apart]
            if similar is None:
                links.union(u, v)
    linked = np.flatnonzero(links.label != np.arange(len(fps)))
    return linked, links.label[linked]


def shard_links(routed: DataFrame, radius: int, cap: int = 4096, similarity: float | None = None) -> DataFrame:
    """(a, b) links between nodes, from rows (node, fp, key[, sketch]) with a row for each shard key of a node."""
    large = routed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap)
    large = large.select("key", F.ceil(F.col("n") / cap).cast("int").alias("parts"))
    extra = ["sketch"] if similarity is not None else []
    own = F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.lit(0))
    parts = F.coalesce("parts", F.lit(1))
    cells = routed.join(large, "key", "left").select("node", "fp", "key", *extra, own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
    cells = cells.select(
        "node", "fp", "key", *extra, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        (F.col("own") > F.col("other")).cast("int").alias("part"))
    dealt = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def work(t: pa.Table) -> pa.RecordBatch:
        key, low, high, part = (t.column(c).to_numpy() for c in ("key", "low", "high", "part"))
        node, fps = t.column("node").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
        new = np.r_[True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
        group = np.cumsum(new)
        several = np.bincount(group)[group] > 1
        group, part, fps, node = group[several], part[several], fps[several], node[several]
        similar = None
        if similarity is not None:
            size = len(t.column("sketch")[0].as_py())
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, size)[several]
            # two equal pairs of bits by chance: 1 in 4; less five standard errors, as the exact check follows
            equal = similarity + (1 - similarity) / 4
            most = (1 - equal + 5 * (equal * (1 - equal) / (4 * size)) ** 0.5) * 4 * size

            def similar(u: np.ndarray, v: np.ndarray) -> np.ndarray:
                unlike = sketch[u] ^ sketch[v]
                return np.bitwise_count((unlike | unlike >> 1) & 0x55).sum(axis=1) <= most

        a, b = cell_links(group, part, fps, radius, similar)
        return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            last = tuple(held[-1].column(c)[-1].as_py() for c in ("key", "low", "high")) if held else None
            if rows >= 60_000:
                # work off the whole cells, keep the last one
                t = pa.Table.from_batches(held)
                same = np.ones(t.num_rows, bool)
                for c, x in zip(("key", "low", "high"), last, strict=True):
                    same &= t.column(c).to_numpy() == x
                cut = int(same.argmax())
                if cut:
                    yield work(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
                    rows = t.num_rows - cut
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield work(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a long, b long")


def with_lowest(rows: DataFrame, lowest: DataFrame, total: int, least: int = 100) -> DataFrame:
    """rows (a, b) with m of lowest (a, m, n), where n rows have that a.

    An a of over a five-hundredth of all rows is one of fewer than 500: those are
    broadcast, so that a class's centre does not bring all its edges to one task.
    """
    limit = max(least, total // 500)
    hubs = {r.a: r.m for r in lowest.filter(F.col("n") > limit).select("a", "m").collect()} if total > limit else {}
    if not hubs:
        return rows.join(lowest, "a").select("a", "b", "m")
    often, known = F.col("a").isin(list(hubs)), F.broadcast(rows.sparkSession.createDataFrame(list(hubs.items()), "a long, m long"))
    return rows.filter(often).join(known, "a").select("a", "b", "m").unionByName(rows.filter(~often).join(lowest, "a").select("a", "b", "m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node that can be reached.

    Alternating large-star and small-star steps; each is a minimum per node, taken
    partly before its shuffle, and a join. They end when the edges form stars, after
    a number of rounds that grows with the logarithm of the nodes.
    """

    def stored(rows: DataFrame) -> tuple[DataFrame, tuple]:
        found = written(rows.filter("a <> b").distinct(), "edges")
        return found, found.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges, now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    before = None
    while now != before:
        before = now
        # large star: link each larger neighbour of u to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        edges, size = stored(with_lowest(both, lowest, 2 * now[0]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small star: link u and its smaller neighbours to the smallest of them
        lowest = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        edges, now = stored(with_lowest(edges, lowest, size[0]).select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, node, component_id) from stored members (doc_id, node) and links between nodes.

    component_id is the smallest doc_id of all that is linked.
    """
    smallest = members.groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = smallest.join(components(links), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    rooted = written(rooted, "roots")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_node = written(join_unique(rooted, ids, "root").select("node", "component_id"), "classes")
    return join_unique(members, by_node, "node")


def fingerprint_classes(members: DataFrame, radius: int = 2, shard: int = 2048) -> DataFrame:
    """(doc_id, node, component_id) of stored members (doc_id, node), node being a fingerprint."""
    distinct = written(members.select("node").distinct(), "distinct-fingerprints")
    shards = max(1, round(distinct.count() / shard))
    routed = distinct.select("node", F.col("node").alias("fp"), F.explode(band_keys(F.col("node"), radius, shards)).alias("key"))
    return classes(members, shard_links(routed, radius))


def simhash_classes(docs: DataFrame, size: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of each row: documents whose fingerprints differ in radius bits or fewer are linked.

    component_id is the smallest doc_id that can be reached. Null and empty texts
    have fingerprint zero and are linked like any other. A null id is carried along
    and never the smallest, unless a component has no other (then it is null).
    Repeated ids are rows of their own. Very long texts are hashed whole, one at a
    time. A bit set in exactly half of the hashes is 0. Other columns are ignored. An
    empty table gives an empty table.
    """
    members = written(fingerprints(docs, size, id_col, text_col), "fingerprints").withColumnRenamed("fp", "node")
    return fingerprint_classes(members, radius).select("doc_id", F.col("node").alias("fp"), "component_id")


def sketches(docs: DataFrame, size: int, bands: int, rows: int, width: int, id_col: str, text_col: str, plain: int = 3) -> DataFrame:
    """(doc_id, plain, fp, same, n, keys, sketch) of each text; of one without words all but the first two are null.

    plain: the fingerprint of simhash_classes(), for shingles of that size; fp: of the
    set, so a shingle counts once, as in the similarity; same: a digest of the set of
    shingle hashes; n: their number; keys: a hash of `rows` whole minima of the shingles'
    hashes for each band; sketch: two bits of each of the first `width` minima, `width` being a multiple of four.
    """
    if width % 4:
        raise ValueError("a sketch is of a multiple of four minima")
    salts = np.random.default_rng(20).integers(1, 1 << 62, (max(width, bands * rows), 2), np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                own = text.as_py()
                whole = fingerprint(shingle_hashes(own, plain))
                distinct = np.unique(shingle_hashes(own, size))
                if not len(distinct):
                    out.append((doc_id, whole, None, None, None, None, None))
                    continue
                low = np.full(len(salts), np.iinfo(np.uint64).max)
                for at in range(0, len(distinct), 4096):
                    np.minimum(low, (distinct[at : at + 4096, None] * salts[:, 0] + salts[:, 1]).min(axis=0), out=low)
                mixed = low ^ (low >> np.uint64(31))
                mixed = mixed * np.uint64(0x9E3779B97F4A7C15)
                keys = [xxhash.xxh64_intdigest(bytes([b]) + mixed[b * rows : (b + 1) * rows].tobytes()) - (1 << 63) for b in range(bands)]
                same = xxhash.xxh3_128_digest(distinct.tobytes())
                two = (mixed[:width] >> np.uint64(62)).astype(np.uint8).reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)
                out.append((doc_id, whole, fingerprint(distinct), same, len(distinct), keys, two.sum(axis=1, dtype=np.uint8).tobytes()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["doc_id", "plain", "fp", "same", "n", "keys", "sketch"])

    own = id_and_text(docs, id_col, text_col).filter("doc_id is not null")
    return own.mapInArrow(run, "doc_id long, plain long, fp long, same binary, n long, keys array<long>, sketch binary")


def similar_sets(sets: list[np.ndarray], part: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(item, linked item) index pairs that connect the sets of a Jaccard similarity from that bound on, at most one an item.

    part: where it has zeros and ones, only sets of different parts are compared.
    """
    links, sizes = Forest(len(sets)), np.array([len(x) for x in sets])
    every, ids = np.unique(np.concatenate(sets), return_inverse=True)
    # the sets that have an element stand between two places of `first` in `owner`
    owner = np.repeat(np.arange(len(sets)), sizes)[np.argsort(ids, kind="stable")]
    first = np.r_[0, np.cumsum(np.bincount(ids, minlength=len(every)))]
    ends = np.cumsum(sizes)
    crossed = bool(part.any() and not part.all())
    for i in np.flatnonzero(part == 1) if crossed else range(1, len(sets)):
        others = np.flatnonzero(part == 0) if crossed else np.arange(i)
        low, high = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
        others = others[(links.label[others] != links.label[i]) & (low / high >= similarity)]
        if not len(others):
            continue
        own = ids[ends[i] - sizes[i] : ends[i]]
        n = first[own + 1] - first[own]
        places = np.repeat(first[own] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        common = np.bincount(owner[places], minlength=len(sets))[others]
        others = others[common / (sizes[i] + sizes[others] - common) >= similarity]
        links.union(np.full(len(others), i), others)
    linked = np.flatnonzero(links.label != np.arange(len(sets)))
    return linked, links.label[linked]


def in_parts(groups: DataFrame, cap: int, cap_hashes: int) -> DataFrame:
    """groups (node, same, n, root) with parts: how many the group is split into, so that each has about `cap` sets and `cap_hashes` hashes at most."""
    large = groups.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / cap), F.ceil(F.sum("n") / cap_hashes)).cast("int").alias("parts")).filter("parts > 1")
    return groups.join(large, "root", "left").select("node", "same", "n", "root", F.coalesce("parts", F.lit(1)).alias("parts"))


def cells_of(groups: DataFrame, keys: DataFrame | None, cap: int, cap_hashes: int, most: int) -> DataFrame:
    """(doc_id, same, cells) of each set of groups (node, same, n, root): cells lists the (root, parts) of the groups it is compared in.

    A group of more than `most` parts, which nodes may form as a chain, is not compared as a whole: with the band keys of
    its nodes (keys: node, same, keys) those that share one are a group each, so that a set goes to as many as it has bands.
    """
    one = F.struct("root", "parts")
    split = in_parts(groups, cap, cap_hashes)
    vast = split.filter(F.col("parts") > most)
    if keys is None or vast.isEmpty():
        return split.select(F.col("node").alias("doc_id"), "same", F.array(one).alias("cells"))
    banded = vast.select("node", "same", "n", "root").join(keys, ["node", "same"]).select("node", "same", "n", "root", F.explode("keys").alias("key"))
    banded = banded.select("node", "same", "n", F.xxhash64("root", "key").alias("root"))
    shared = banded.groupBy("root").agg(F.count(F.lit(1)).alias("sets")).filter("sets > 1").select("root")
    banded = in_parts(banded.join(shared, "root", "left_semi"), cap, cap_hashes)
    every = split.filter(F.col("parts") <= most).unionByName(banded)
    return every.groupBy(F.col("node").alias("doc_id"), "same").agg(F.collect_set(one).alias("cells"))


def exact_links(docs: DataFrame, groups: DataFrame, size: int, similarity: float, id_col: str = "doc_id", text_col: str = "text",
                keys: DataFrame | None = None, cap: int = 1024, cap_hashes: int = 1 << 20, most: int = 16) -> DataFrame:
    """(a, b) links between the nodes of each group (node, same, n, root) whose sets of shingle hashes are that similar.

    All sets of a group are compared, but for what is linked already or cannot be that similar by its
    size. A group of more than `cap` sets or `cap_hashes` hashes is split into parts, with a cell for every
    pair of parts; one of more than `most` parts is compared by band keys (cells_of()), if they are given.
    The hashes are made anew from the texts, of the groups' nodes alone.
    """
    asked = cells_of(groups, keys, cap, cap_hashes, most)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sets = [], []
            for k, (text, same) in enumerate(zip(batch.column("text"), batch.column("same").to_pylist(), strict=True)):
                found = np.unique(shingle_hashes(text.as_py(), size)).tobytes()
                # an id may have several texts
                if xxhash.xxh3_128_digest(found) == same:
                    keep.append(k)
                    sets.append(found)
            rest = batch.select(["doc_id", "cells"]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(sets, pa.binary())], names=["node", "cells", "hashes"])

    sets = id_and_text(docs, id_col, text_col).join(asked, "doc_id").select("doc_id", "text", "same", "cells")
    sets = sets.mapInArrow(hashed, "node long, cells array<struct<root: long, parts: int>>, hashes binary").select("node", "hashes", F.inline("cells"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cells = sets.select("node", "root", "hashes", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = cells.select("node", "root", "hashes", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("part"))
    dealt = cells.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")

    def work(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, part = (t.column(c).to_numpy() for c in ("node", "part"))
        if t.column("low")[0].as_py() != t.column("high")[0].as_py() and (part.all() or not part.any()):
            return node[:0], node[:0]
        a, b = similar_sets([np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()], part, similarity)
        return node[a], node[b]

    def out(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # work off the whole cells, keep the last one
            t = pa.Table.from_batches([*held, batch])
            key = np.stack([t.column(c).to_numpy() for c in ("root", "low", "high")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
            if len(cuts) > 1:
                yield out([work(t.slice(at, end - at)) for at, end in zip(cuts, cuts[1:], strict=False)])
            held = t.slice(cuts[-1]).to_batches()
        if held:
            yield out([work(pa.Table.from_batches(held))])

    return dealt.mapInArrow(run, "a long, b long")


def near_classes(docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 28, bands: int = 20, rows: int = 5, width: int = 100,
                 id_col: str = "doc_id", text_col: str = "text", members: DataFrame | None = None) -> DataFrame:
    """(doc_id, component_id) of documents by the Jaccard similarity of their shingles; component_id is the smallest linked doc_id.

    Documents with one set of shingles are one node. The others meet in shards of equal MinHash
    bands, where BK-trees of SimHash fingerprints find what differs in radius bits or
    fewer and sketches of two bits of `width` minima estimate the similarity, with a standard error of
    0.048; up to five of those below the bound (0.56) pass. Within what these pairs connect, exact_links()
    computes the similarities, and only pairs at the bound or above link. With the defaults a
    pair of similarity 0.8 shares a band with a probability of 0.9996 (one of 0.3 with 0.05, one
    of 0.1 with 0.0002), and fails the sketch with one of 0.00001.
    Its fingerprints differ in a bit with a probability of 0.15, and of 0.1875 at most (sets of 4 and 5): the radius
    is passed with one of 0.0000011 at most.

    Texts without words (null, empty) and rows without an id are linked to nothing and
    not in the result. Repeated ids are in it more than once. Very long texts are hashed
    whole, one at a time. members: stored sketches() of docs, where there are some.
    """
    if members is None:
        members = written(sketches(docs, size, bands, rows, width, id_col, text_col), "sketches")
    members = members.filter("same is not null")
    nodes = members.groupBy("same").agg(F.min(F.struct("doc_id", "fp", "n", "keys", "sketch")).alias("node")).select("same", "node.*")
    nodes = written(nodes.withColumnRenamed("doc_id", "node"), "sketch-nodes")
    routed = nodes.select("node", "fp", "sketch", F.explode("keys").alias("key"))
    groups = nodes.select("node", "same", "n").join(components(shard_links(routed, radius, similarity=similarity)), "node")
    links = exact_links(docs, written(groups, "near-groups"), size, similarity, id_col, text_col, nodes.select("node", "same", "keys"))
    # of a node in several sets (a repeated id) all are one
    rooted = nodes.select("node", "same").join(components(links), "node", "left")
    by_set = written(rooted.select("same", F.coalesce("root", "node").alias("component_id")), "set-classes")
    return join_unique(members.select("doc_id", "same"), by_set, "same").select("doc_id", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, bands: int = 20, rows: int = 5, width: int = 100, **options) -> DataFrame:
    """The rows of docs, all columns, without near-duplicates: of each class the smallest id stays.

    Linked are documents with fingerprints of simhash_classes() near each other, and
    those that near_classes() finds similar; the texts are hashed once for both. Texts
    without words have one fingerprint, so one of them stays. Rows without an id stay,
    and so do rows that repeat a kept id.
    """
    named = docs.filter(F.col(id_col).isNotNull())
    members = written(sketches(named, size, bands, rows, width, id_col, text_col), "sketches")
    by_bits = fingerprint_classes(members.select("doc_id", F.col("plain").alias("node")))
    by_shingles = near_classes(named, size, bands=bands, rows=rows, width=width, id_col=id_col, text_col=text_col, members=members, **options)
    pairs = [x.filter("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")) for x in (by_bits, by_shingles)]
    gone = components(pairs[0].unionByName(pairs[1])).filter("node <> root").select(F.col("node").alias("gone")).distinct()
    # a struct, as docs may have columns of any name
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[id_col].cast("long").alias("gone"))
    return rows.join(gone, "gone", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
