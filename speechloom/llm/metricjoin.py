"""Exact Jaccard join in metric space: regions around pivots, windows by the triangle inequality, recursion.

1 - similarity of sets is a metric, and documents that are unlike are all at a distance near 1 from each other, so
whole documents part nothing as pivots of a corpus: every window would hold everything. The join therefore goes down
through three kinds of pivots, and each level loses no link.

1. Sets of one shingle. A document is at 1 - 1 / n from each of its shingles and at 1 from all others; of two documents
   that link, both have one of the first n - ceil(t n) + 1 shingles of the other, in any order that is common to all. A
   region is a shingle, and this many are a document's window. The order puts shingles that many documents hold last,
   so regions hold few, or documents that are alike.
2. Hashed sets. A document's shingles, as the parities of some hundreds of bits, change in no more bits than two sets
   differ in shingles. Documents of a region whose parities are too far apart to link are parted; what is not parted by
   it makes clusters.
3. Documents, by their full sets. A region's members are compared with its pivots; those that link with one share its
   component, and only the rest need others. Each of the rest lives in the Voronoi region of its nearest pivot p, and
   a member y is copied there if a link allows it: d(y, p) lies within eps of the distances of the rest, and at most
   2 eps above y's distance from its own pivot. Regions are joined again in the same way with pivots of their own, by
   Spark while they are large, in a task when they are small, down to pairs. A region that does not shrink is cut
   into tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.llm import neardup
from speechloom.llm.common import mix, staged, texts, with_class
from speechloom.llm.neardup import Compare, components, digest, full_sets, joined, shingle_hashes

#: Counters of shingles, and how many of them one row holds. A shingle is common if its counter reaches COMMON of the
#: rows, and LEAST_COMMON. Only shingles in the lower quarter of the order are counted, as others seldom begin one.
SLOTS, RANGES = 1 << 23, 128
COMMON, LEAST_COMMON = 1 / 10_000, 16
COUNTED_BELOW = np.uint64(1 << 62)
#: Bits of parities: at least, at most.
LEAST_BITS, MOST_BITS = 256, 1 << 16
#: Members, and shingles, of a region that one task joins.
REGION, REGION_SHINGLES = 1024, 1 << 22
#: Pivots of a region, and members that are compared with each other at once.
PIVOTS, LEAF = 6, 24
#: A region that keeps a larger share of the members of the one that it came from is cut into tiles.
SHRINKS = 0.8
#: What rounding may take from a window.
SLACK = 1e-9


def slots(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ np.uint64(0x3C6EF372FE94F82B)) & np.uint64(SLOTS - 1)).astype(np.int64)


def common_slots(rows: DataFrame, width: int) -> np.ndarray:
    """Which counters of shingles are common, as a boolean array; rows: doc_id, text.

    A task's counts are packed by range of counters and added up by range; the driver gets the numbers of the common
    counters, SLOTS at most. The counters decide the order of shingles, and nothing else.
    """
    span = SLOTS // RANGES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(SLOTS, dtype=np.uint32)
        n = 0
        for batch in batches:
            n += batch.num_rows
            sets = [s[s < COUNTED_BELOW] for s in shingle_hashes(texts(batch.column(1)), width)]
            if sets:
                at, n_ = np.unique(slots(np.concatenate(sets)), return_counts=True)
                seen[at] += n_.astype(np.uint32)
        if n:
            for k in range(RANGES):
                own = seen[k * span : (k + 1) * span]
                at = np.flatnonzero(own)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([at.astype(np.uint16).tobytes()]), pa.array([own[at].tobytes()]), pa.array([0 if k else n])], names=["range", "at", "n", "documents"])

    counted = staged(rows.mapInArrow(count, "range long, at binary, n binary, documents long"), "metric-counts")
    least = max(LEAST_COMMON, (counted.agg(F.sum("documents")).first()[0] or 0) * COMMON)  # one row

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, at, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                sums.setdefault(k, np.zeros(span, dtype=np.int64))[np.frombuffer(at, dtype=np.uint16)] += np.frombuffer(n, dtype=np.uint32)
        for k, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(own >= least) + k * span)], names=["slot"])

    out = np.zeros(SLOTS, dtype=bool)
    for batch in counted.repartition(RANGES, "range").mapInArrow(add, "slot long").toArrow().to_batches():
        out[batch.column(0).to_numpy()] = True
    return out


def window(n: int, percent: int) -> int:
    """How many of a set's first shingles are its window; 0 if no other set can be similar enough."""
    if percent * (n + 1) > 100 * n:  # sets of n + 1 shingles are the likeliest
        return 0
    return n - -(-percent * n // 100) + 1


def bits_of(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << max(0, n - 1).bit_length()))


def parities(hashes: np.ndarray) -> bytes:
    """A bit for each of bits_of() classes of shingles: whether the set has an odd number of them."""
    size = bits_of(len(hashes))
    at = (mix(hashes ^ np.uint64(0x1F83D9ABFB41BD6B)) & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=size) & 1).tobytes()


def folded(rows: np.ndarray) -> np.ndarray:
    """Packed parities of half as many bits."""
    half = rows.shape[-1] // 2
    return rows[..., :half] ^ rows[..., half:]


def near_enough(away: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets that differ in `away` shingles at least can be similar enough."""
    return (100 + percent) * away <= (100 - percent) * (n + m)


def _parity_pairs(x: list[bytes], y: list[bytes], n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    out = np.zeros(len(x), dtype=bool)
    size = np.array([min(len(a), len(b)) for a, b in zip(x, y, strict=True)])
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        a, b = (np.stack([_fold_to(v[k], s) for k in at]) for v in (x, y))
        out[at] = near_enough(np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64), n[at], m[at], percent)
    return out


def _fold_to(sketch: bytes, size: int) -> np.ndarray:
    row = np.frombuffer(sketch, dtype=np.uint8)
    while len(row) > size:
        row = folded(row)
    return row


def _parity_within(sketches: list[bytes], n: np.ndarray, percent: int):
    size = np.array([len(s) for s in sketches])
    # by number of bytes: the parities of members that have these or more, and their places
    levels, places = {}, {}
    for s in np.unique(size).tolist():
        own = np.flatnonzero(size >= s)
        levels[s] = np.stack([_fold_to(sketches[k], s) for k in own])
        places[s] = np.full(len(sketches), -1)
        places[s][own] = np.arange(len(own))

    def similar(k: int, near: np.ndarray) -> np.ndarray:
        out = np.zeros(len(near), dtype=bool)
        least = np.minimum(size[near], size[k])
        for s in np.unique(least).tolist():
            at = np.flatnonzero(least == s)
            away = np.bitwise_count(levels[s][places[s][near[at]]] ^ levels[s][places[s][k]]).sum(axis=1, dtype=np.int64)
            out[at] = near_enough(away, n[near[at]], n[k], percent)
        return out

    return similar


#: By the number of parities that differ; a lower bound of the sets' difference, so nothing similar is missed.
PARITIES = Compare(_parity_pairs, _parity_within)


def sketch(rows: DataFrame, width: int, percent: int, common: np.ndarray) -> DataFrame:
    """(doc_id, n_shingles, high, low, bands, agree) of each row: bands are the shingles of its window, agree its parities."""
    packed = rows.sparkSession.sparkContext.broadcast(np.packbits(common))  # SLOTS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = np.unpackbits(packed.value).astype(bool)
        for batch in batches:
            sets = shingle_hashes(texts(batch.column(1)), width)
            names, bands, agree = np.zeros((len(sets), 2), dtype=np.uint64), [None] * len(sets), [None] * len(sets)
            for k, s in enumerate(sets):
                if len(s):
                    names[k] = digest(s)
                    first = window(len(s), percent)
                    if first:
                        behind = (s < COUNTED_BELOW) & late[slots(s)]
                        bands[k] = np.concatenate((s[~behind], s[behind]))[:first].view(np.int64)
                        agree[k] = parities(s)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array([len(s) for s in sets], type=pa.int64()), *[pa.array(names[:, i].view(np.int64)) for i in (0, 1)], pa.array(bands, type=pa.list_(pa.int64())), pa.array(agree, type=pa.binary())], names=["doc_id", "n_shingles", "high", "low", "bands", "agree"])

    return rows.mapInArrow(run, "doc_id long, n_shingles long, high long, low long, bands array<long>, agree binary")


class Region:
    """Members of a region in one task: full sets, sizes, components that grow, and which members are of the rest."""

    def __init__(self, sets: list[np.ndarray], component: np.ndarray, rest: np.ndarray, percent: int) -> None:
        self.size, self.percent, self.component, self.rest = np.array([len(s) for s in sets]), percent, component.copy(), rest
        self.eps = 1 - percent / 100
        kinds, self.codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.begins = np.concatenate(([0], np.cumsum(self.size)))
        self.marked = np.zeros(len(kinds), dtype=np.int64)
        self.links: list[tuple[int, int]] = []

    def own(self, k: int) -> np.ndarray:
        return self.codes[self.begins[k] : self.begins[k + 1]]

    def common(self, k: int, others: np.ndarray) -> np.ndarray:
        """How many shingles member k shares with each of the others."""
        self.marked[self.own(k)] = 1
        out = np.array([self.marked[self.own(m)].sum() for m in others], dtype=np.int64)
        self.marked[self.own(k)] = 0
        return out

    def link(self, k: int, others: np.ndarray, common: np.ndarray) -> None:
        near = others[100 * common >= self.percent * (self.size[k] + self.size[others] - common)]
        if len(near):
            self.links += [(k, m) for m in joined(self.component, np.append(near, k)) if m != k]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> None:
        """Compare each of left with those of right that may be its partners and are in other components."""
        for k in left:
            n, m = self.size[k], self.size[right]
            near = right[(self.component[right] != self.component[k]) & (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m))]
            if len(near):
                self.link(k, near, self.common(k, near))

    def join(self, members: np.ndarray) -> None:
        """Link all members that links join, but for pairs without one of the rest."""
        if len(members) <= LEAF:
            return self.pairs(members[self.rest[members]], members)
        away, pivot = [], members[0]
        nearest = np.full(len(members), np.inf)
        for _ in range(PIVOTS):
            common = self.common(pivot, members)
            self.link(pivot, members[members != pivot], common[members != pivot])
            away.append(1 - common / (self.size[pivot] + self.size[members] - common))
            nearest = np.minimum(nearest, away[-1])
            pivot = members[nearest.argmax()]
            if nearest.max() <= 0:
                break
        # of pairs across components, one member is outside that of the first pivot; one at least is of the rest
        main = self.component[members] == self.component[members[0]]
        rest = ~main & (self.rest[members] | self.rest[members[main]].any())
        home = np.argmin(away, axis=0)
        for p, d in enumerate(away):
            mine = rest & (home == p)
            if mine.any():
                inside = (d >= d[mine].min() - self.eps - SLACK) & (d <= d[mine].max() + self.eps + SLACK) & (d <= nearest + 2 * self.eps + SLACK)
                near = members[inside]
                if len(near) < SHRINKS * len(members):
                    # only those that live here are of the rest here
                    outer, self.rest = self.rest, np.zeros_like(self.rest)
                    self.rest[members[mine]] = True
                    self.join(near)
                    self.rest = outer
                else:
                    self.pairs(members[mine], near)


def join_region(percent: int):
    def run(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("hashes").to_pylist()]
        region = Region(sets, group.column("component").to_numpy(), group.column("rest").to_numpy(zero_copy_only=False), percent)
        region.join(np.arange(len(node)))
        a, b = (node[[x[i] for x in region.links]] if region.links else node[:0] for i in (0, 1))
        return pa.table({"a": pa.array(a, type=pa.int64()), "b": pa.array(b, type=pa.int64())})

    return run


def region_links(held: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join all members of a cluster which links connect; held: node, cluster, n, agree, hashes."""
    sets = held.select("node", "n", "agree", "hashes")
    members = held.select("cluster", "node", F.col("node").alias("component"), F.lit(True).alias("rest"), "n")
    links, tiled, level = None, None, 0

    def add(found: DataFrame, label: str) -> None:
        nonlocal links
        found = staged(found, label)
        links = found if links is None else links.unionByName(found)

    while True:
        sizes = staged(members.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")), "metric-sizes")
        small = (F.col("members") <= REGION) & (F.col("shingles") <= REGION_SHINGLES)
        few = members.join(sizes.where(small & (F.col("members") > 1)).select("cluster"), "cluster", "left_semi")
        add(few.join(sets.select("node", "hashes"), "node").groupBy("cluster").applyInArrow(join_region(percent), "a long, b long"), "metric-small")
        large = sizes.where(~small & (F.col("members") > 1)).withColumn("size", F.col("members"))
        if large.isEmpty():
            break
        members = staged(with_class(members, large, ["cluster"], "size").withColumnRenamed("size", "parent"), "metric-large")
        near = staged(pivot_distances(members, large, sets, level), "metric-distances")
        add(near.where(100 * F.col("common") >= percent * (F.col("n") + F.col("m") - F.col("common"))).select(F.col("node").alias("a"), "b"), "metric-pivots")
        grown = components(links, "metric-linked")
        shrunk, same = voronoi(members, near, grown, percent)
        if not same.isEmpty():
            tiled = same if tiled is None else tiled.unionByName(same)
        members, level = shrunk, level + 1
    if tiled is not None:
        sized = tiled.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.greatest(F.count(F.lit(1)), F.ceil(F.sum("n") * (neardup.TILE / neardup.TILE_SHINGLES))).alias("size"), F.count_if("rest").alias("rest_size"))
        placed = with_class(with_class(tiled, sized, ["cluster"], "rest_size"), sized.select("cluster", F.col("size").alias("parts"), "size"), ["cluster"], "parts").withColumnRenamed("parts", "size")
        dealt = neardup.tiles(staged(placed.join(sets.select("node", "agree", "hashes"), "node"), "metric-tiled"), "cluster")
        add(dealt.groupBy("key", "i", "j").applyInArrow(neardup.link_tile(percent, PARITIES), "a long, b long"), "metric-tiles")
    return links


def pivot_distances(members: DataFrame, large: DataFrame, sets: DataFrame, level: int) -> DataFrame:
    """(cluster, node, b, n, m, common) of large regions' members and pivots, a pivot being its own too.

    A region's pivots are the members with the least hash in each of PIVOTS classes, those of the rest before others.
    """
    order = F.struct(~F.col("rest"), F.xxhash64("node", F.lit(level)), "node")
    chosen = members.groupBy("cluster", F.pmod(F.xxhash64(F.lit(level), "node"), F.lit(PIVOTS)).alias("k")).agg(F.min_by("node", order).alias("node")).select("cluster", "node")
    chosen = staged(chosen, "metric-chosen")
    found = neardup.pivot_overlaps(members.select("cluster", "node").join(sets, "node"), large, chosen, sets)
    itself = chosen.join(sets.select("node", "n"), "node").select("cluster", "node", F.col("node").alias("b"), "n", F.col("n").alias("m"), F.col("n").alias("common"))
    return found.unionByName(itself)


def voronoi(members: DataFrame, near: DataFrame, grown: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The Voronoi regions of the rest with what is copied to them: those that shrank, and those that did not."""
    eps = 1 - percent / 100
    known = members.select("cluster", "node", "n", "rest", "parent").join(grown, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mains = known.groupBy("cluster").agg(F.min_by("component", neardup.rank()).alias("main"), F.count(F.lit(1)).alias("size"))
    known = staged(with_class(known, mains, ["cluster"], "main").withColumn("rest", F.col("component") != F.col("main")).drop("main"), "metric-known")
    away = near.select("cluster", "node", "b", (1 - F.col("common") / (F.col("n") + F.col("m") - F.col("common"))).alias("d"))
    homes = away.groupBy("cluster", "node").agg(F.min(F.struct("d", "b")).alias("home")).select("cluster", "node", F.col("home.b").alias("home"), F.col("home.d").alias("nearest"))
    placed = staged(away.join(homes, ["cluster", "node"]).join(known, ["cluster", "node"]), "metric-placed")
    living = F.col("rest") & (F.col("home") == F.col("b"))
    windows = placed.groupBy("cluster", "b").agg(F.min(F.when(living, F.col("d"))).alias("low"), F.max(F.when(living, F.col("d"))).alias("high"), F.count(F.lit(1)).alias("size")).where("low is not null")
    inside = with_class(placed.withColumn("living", living), windows.withColumn("range", F.struct("low", "high")), ["cluster", "b"], "range")
    inside = inside.where((F.col("d") >= F.col("range.low") - eps - SLACK) & (F.col("d") <= F.col("range.high") + eps + SLACK) & (F.col("d") <= F.col("nearest") + 2 * eps + SLACK))
    regions = staged(inside.select(F.xxhash64("cluster", "b").alias("cluster"), F.col("cluster").alias("outer"), "b", "node", "n", "component", F.col("living").alias("rest"), "parent"), "metric-regions")
    sizes = regions.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), F.first("parent").alias("before"))
    marked = with_class(regions.drop("parent"), sizes.withColumn("stays", F.col("size") > SHRINKS * F.col("before")), ["cluster"], "stays")
    marked = staged(marked, "metric-marked")
    columns = ["cluster", "node", "component", "rest", "n"]
    return marked.where(~F.col("stays")).select(*columns), marked.where("stays").select(*columns)


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles and component_id, the smallest id that links reach; exact.

    Two documents link if 100 * |intersection| >= percent * |union| of their shingle sets. Texts without words, and null
    texts, have an empty set and link with nothing. A row with a null id has a null component. Rows that repeat an id are
    rows of one document: what any of them links with is linked with all. Ids are below 2 ** 62. Empty tables give empty
    results; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = staged(sketch(rows, width, percent, common_slots(rows, width)), "metric-sketch")

    def find_links(nodes: DataFrame) -> DataFrame:
        known = neardup.tied_clusters(nodes, percent, PARITIES)
        sets = full_sets(rows, known.select("node", "least_id", "high", "low"), width)
        return region_links(staged(known.select("node", "cluster", "n", "agree").join(sets, "node"), "metric-held"), percent)

    return neardup.components_by_class(sketched, find_links)
