"""Near-duplicates by min-max hashing.

Each document is the set of its word shingles. A permutation gives two signature values, the set's minimum and
its maximum, so half the hash evaluations serve as many bands. Equal sets are one class first, by a 128-bit
digest. Classes that share a band are candidates, handled so that large groups stay cheap and no link is lost:

1. ties: within a band's bucket each class is compared with one pivot by all signature values; classes that agree
   in enough of them are tied. Classes that are not tied to their bucket's pivot are compared with the bucket's
   other classes. Ties make clusters; every link lies within a cluster.
2. links: within a cluster each class is compared with a few pivots on the full shingle sets; classes that are not
   linked with the first pivot's component are compared with all others, again on the full sets.

Comparing the rest with all goes by tiles of bounded size, which give ties or links but never their pairs.
Everything is keyed by classes; sets, links and components stay in Spark tables. A class's node number is the
smallest id of its documents. Where rows of one id have different texts, only one of their classes has that
number and the others a number made of their digest, above all ids; the id's rows tie them all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechloom.llm import common
from speechloom.llm.common import LOWER, blocks, mix, staged, texts, with_class, word_hashes

#: Bands of ROWS signature values each. A pair at similarity 0.8 shares no band in 7 of a million cases.
BANDS, ROWS = 30, 5
PERMUTATIONS = BANDS * ROWS // 2
#: Pairs of which fewer of the signature values agree are not compared: at a similarity of 0.8 that is over
#: five standard deviations below the mean.
LEAST_AGREEMENT = 0.62
#: Members of one side of a tile, and their shingles if sets are compared (but one set at least).
TILE, TILE_SHINGLES = 1024, 1 << 22
#: Node numbers of classes whose smallest id another class has begin here; ids are smaller.
SECOND = 1 << 62
#: Edges that one task joins; more are contracted in rounds first.
SMALL_EDGES = 200_000
#: Ids that are broadcast to find their texts, 16 bytes each; more ids are joined with the texts.
FEW_IDS = 1 << 20
#: Pivots of a cluster.
PIVOTS = 8

_draw = np.random.default_rng(20240301)
_MULTIPLIERS = _draw.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(values: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text; of fewer words than width, the whole sequence as one."""
    out = [[] for _ in values]
    tails: dict[int, np.ndarray] = {}
    for _, parts in blocks(values):
        words, starts, _ = word_hashes(LOWER[np.frombuffer(b"".join(p + b" " for _, p in parts), dtype=np.uint8)])
        cuts = np.searchsorted(starts, np.cumsum([0] + [len(p) + 1 for _, p in parts]))
        for (row, _), a, b in zip(parts, cuts[:-1], cuts[1:], strict=True):
            own = words[a:b]
            if row in tails:  # the text goes on from the block before
                own = np.concatenate([tails[row], own])
            if len(own) >= width:
                n = len(own) - width + 1
                code = np.zeros(n, dtype=np.uint64)
                for i in range(width):
                    code = code * np.uint64(0xD6E8FEB86659FD93) + own[i : i + n]
                out[row].append(mix(code))
            tails[row] = own[-(width - 1) :] if width > 1 else own[:0]
    found = []
    for row, lists in enumerate(out):
        if not lists and len(tails.get(row, ())):
            code = np.uint64(len(tails[row]))
            with np.errstate(over="ignore"):
                for w in tails[row]:
                    code = code * np.uint64(0xD6E8FEB86659FD93) + w
            lists = [mix(np.array([code ^ np.uint64(0xA5A5A5A5A5A5A5A5)]))]
        found.append(np.unique(np.concatenate(lists)) if lists else np.zeros(0, dtype=np.uint64))
    return found


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum and maximum of each set under each permutation, as 32-bit values; sets must not be empty."""
    flat = np.concatenate(sets)
    begins = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    out = np.empty((len(sets), 2 * PERMUTATIONS), dtype=np.uint32)
    for k, m in enumerate(_MULTIPLIERS):
        x = flat * m
        x ^= x >> np.uint64(32)
        x = x.astype(np.uint32)
        out[:, 2 * k] = np.minimum.reduceat(x, begins)
        out[:, 2 * k + 1] = np.maximum.reduceat(x, begins)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """64-bit key of each band of each signature."""
    bands = values.reshape(len(values), BANDS, ROWS).astype(np.uint64)
    code = np.tile(np.arange(BANDS, dtype=np.uint64), (len(values), 1))
    for i in range(ROWS):
        code = mix(code * np.uint64(0x9FB21C651E98DF25) + bands[:, :, i])
    return code


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, high, low, bands, agree) of each row; high and low digest the set, agree is a byte per value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_hashes(texts(batch.column(1)), width)
            sizes = np.array([len(s) for s in sets])
            some = np.flatnonzero(sizes)
            high, low = np.zeros(len(sets), dtype=np.uint64), np.zeros(len(sets), dtype=np.uint64)
            bands, agree = [None] * len(sets), [None] * len(sets)
            at = 0
            while at < len(some):  # a bounded number of shingles at a time
                end = at + 1
                while end < len(some) and sizes[some[at : end + 1]].sum() <= 1 << 17:
                    end += 1
                chosen = some[at:end]
                values = signatures([sets[k] for k in chosen])
                keys = band_keys(values).astype(np.int64)
                for k, s, b, v in zip(chosen, (sets[k] for k in chosen), keys, values.astype(np.uint8), strict=True):
                    high[k], low[k] = digest(s)
                    bands[k], agree[k] = b, v.tobytes()
                at = end
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, type=pa.int64()), pa.array(high.astype(np.int64)), pa.array(low.astype(np.int64)), pa.array(bands, type=pa.list_(pa.int64())), pa.array(agree, type=pa.binary())], names=["doc_id", "n_shingles", "high", "low", "bands", "agree"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, high long, low long, bands array<long>, agree binary")


class Compare(NamedTuple):
    """How sketches tell that sets may be similar enough; both give boolean arrays and never miss what they must find."""

    #: Of rows of pairs: (sketches, other sketches, sizes, other sizes, percent).
    pairs: Callable[[list[bytes], list[bytes], np.ndarray, np.ndarray, int], np.ndarray]
    #: Of a group: (sketches, sizes, percent) gives a function of a member and an array of members.
    within: Callable[[list[bytes], np.ndarray, int], Callable[[int, np.ndarray], np.ndarray]]


def _agreeing_pairs(x: list[bytes], y: list[bytes], n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    a, b = (np.frombuffer(b"".join(v), dtype=np.uint8).reshape(-1, 2 * PERMUTATIONS) for v in (x, y))
    return (a == b).mean(axis=1) >= LEAST_AGREEMENT


def _agreeing_within(sketches: list[bytes], n: np.ndarray, percent: int) -> Callable[[int, np.ndarray], np.ndarray]:
    values = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(-1, 2 * PERMUTATIONS)
    return lambda k, near: (values[near] == values[k]).mean(axis=1) >= LEAST_AGREEMENT


#: By the share of signature values that agree.
AGREEMENT = Compare(_agreeing_pairs, _agreeing_within)


def sizes_allow(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar enough at all."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def digest(hashes: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """128 bits that name a set of hashes."""
    return mix(hashes).sum(dtype=np.uint64), mix(hashes ^ np.uint64(0x5555555555555555)).sum(dtype=np.uint64)


def full_sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, hashes): the sets of the classes in nodes (node, least_id, high, low, n_shingles), from a document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_hashes(texts(batch.column(1)), width)
            names = np.array([digest(s) for s in sets], dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(names[:, 0]), pa.array(names[:, 1]), pa.array([s.tobytes() for s in sets], type=pa.binary())], names=["least_id", "high", "low", "hashes"])

    # written first, so that they are counted: few ids need no shuffle of the texts
    ids = staged(nodes.select(F.col("least_id").alias("doc_id")).distinct(), "neardup-ids")
    ids = F.broadcast(ids) if ids.count() <= FEW_IDS else ids
    found = docs.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(run, "least_id long, high long, low long, hashes binary")
    # rows that repeat an id and a set are one
    return found.join(nodes, ["least_id", "high", "low"]).groupBy("node").agg(F.first("hashes").alias("hashes"))


def relabelled(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels (node, component) with the components that were found; other nodes are their own."""
    return labels.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (a, b) reaches.

    Up to SMALL_EDGES edges are joined in one task. Of more, each node points to its smallest neighbour or
    itself, pointers are followed to their ends, and the edges between different ends are the next round's.
    """
    found = None
    edges = staged(edges.select("a", "b").where("a <> b").distinct(), f"{label}-edges")
    while (n := edges.count()) > SMALL_EDGES:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component"))
        while True:
            ends = staged(ends, f"{label}-ends")
            onwards = looked_up(ends, "component", ends.select(F.col("node").alias("component"), F.col("component").alias("next")), "next")
            if onwards.where("next <> component").isEmpty():
                break
            ends = onwards.select("node", F.col("next").alias("component"))
        left = looked_up(edges, "a", ends.select(F.col("node").alias("a"), F.col("component").alias("x")), "x")
        moved = looked_up(left, "b", ends.select(F.col("node").alias("b"), F.col("component").alias("y")), "y").where("x <> y")
        edges = staged(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{label}-edges")
        found = ends if found is None else staged(relinked(found, ends), f"{label}-found")
    if found is not None and not n:
        return found
    last = staged(edges.coalesce(1).mapInArrow(union_find, "node long, component long"), f"{label}-last")
    return last if found is None else staged(relinked(found, last), f"{label}-found")


def union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of a bounded number of edges."""
    parent: dict[int, int] = {}

    def end(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = end(a), end(b)
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.int64()), pa.array([end(x) for x in nodes], type=pa.int64())], names=["node", "component"])


def relinked(found: DataFrame, ends: DataFrame) -> DataFrame:
    """(node, component) of found, with components replaced by where they end."""
    later = ends.select(F.col("node").alias("component"), F.col("component").alias("end"))
    sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    every = sizes.join(later, "component", "left").withColumn("end", F.coalesce("end", "component"))
    return with_class(found, every, ["component"], "end").select("node", F.col("end").alias("component"))


def looked_up(rows: DataFrame, key: str, known: DataFrame, wanted: str) -> DataFrame:
    """rows with the column `wanted` of known, which has one row per key; a key may have any number of rows."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    return with_class(rows, sizes.join(known, key), [key], wanted)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept (doc_id = component_id).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets. Texts without
    words, and null texts, have an empty set and link with nothing. A row with a null id is no document that
    others could name: its component is null and it is kept. Rows that repeat an id are rows of one document:
    what any of them is linked with is linked with all, but each row keeps its own n_shingles, and one without words
    its own id as its component. Ids are below 2 ** 62. Empty tables give empty results; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = staged(sketch(rows, width), "neardup-sketch")
    out = components_by_class(sketched, lambda nodes: class_links(rows, nodes, width, percent))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def components_by_class(sketched: DataFrame, find_links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, n_shingles, component_id) of sketched rows (doc_id, n_shingles, high, low, bands, agree).

    find_links takes the classes of equal sets (node, least_id, high, low, n_shingles, bands, agree, size) and gives edges
    (a, b) between them.
    """
    filled = sketched.where("doc_id is not null and n_shingles > 0")
    key = ["high", "low", "n_shingles"]
    sized = filled.groupBy(*key).agg(F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("size"), F.first("bands").alias("bands"), F.first("agree").alias("agree"))
    # of classes with one smallest id, the one with the smallest digest has it for its number
    sized = staged(sized, "neardup-sized")
    owner = staged(sized.groupBy("least_id").agg(F.min(F.struct(*key)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "neardup-owners")
    other = F.col("first").isNotNull() & (F.col("first") != F.struct(*key))
    numbered = sized.join(owner.drop("n"), "least_id", "left").withColumn("node", F.when(other, F.lit(SECOND) + F.shiftrightunsigned(F.xxhash64("high", "low"), 2)).otherwise(F.col("least_id")))
    nodes = numbered.drop("first")  # few classes share a least id, so this is read from the written table again
    links = find_links(nodes)
    # rows of one id that are in several classes tie these
    several = filled.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("x"), F.max(F.struct(*key)).alias("y")).where("x <> y").select("doc_id")
    member = staged(filled.select("doc_id", *key).join(several, "doc_id", "left_semi").join(nodes.select(*key, "node"), key).select("doc_id", "node"), "neardup-several")
    tied = member.join(member.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b")).where("a <> b").distinct()
    labels = components(links.unionByName(tied), "neardup-all")
    placed = staged(relabelled(nodes.select("node"), labels).join(nodes.select("node", *key, "size"), "node"), "neardup-placed-classes")
    # rows that are not in a class are alone
    found = with_class(filled.select("doc_id", *key), placed, key, "component").select("doc_id", "n_shingles", "component")
    alone = sketched.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    out = found.unionByName(alone)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def class_links(rows: DataFrame, nodes: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links that join all classes which links connect; nodes (node, least_id, high, low, n_shingles, bands, agree)."""
    known = tied_clusters(nodes, percent, AGREEMENT)
    sets = full_sets(rows, known.select("node", "least_id", "high", "low"), width)
    held = staged(known.select("node", "cluster", "n", "agree").join(sets, "node"), "neardup-held")
    slim = held.select("cluster", "node", "n")
    sizes = staged(slim.groupBy("cluster").agg(F.count(F.lit(1)).alias("members"), F.greatest(F.count(F.lit(1)), F.ceil(F.sum("n") * (TILE / TILE_SHINGLES))).alias("size")), "neardup-cluster-sizes")
    links = staged(pivot_links(held, sizes, percent), "neardup-links")
    labels = relabelled(held.select("node"), components(links, "neardup-linked"))
    placed = cluster_rest(staged(slim.join(labels, "node"), "neardup-slim"), sizes).join(held.select("node", "agree", "hashes"), "node")
    more = tiles(staged(placed, "neardup-placed"), "cluster").groupBy("key", "i", "j").applyInArrow(link_tile(percent, AGREEMENT), "a long, b long")
    return links.unionByName(staged(more.distinct(), "neardup-more"))


def tied_clusters(nodes: DataFrame, percent: int, compare: Compare) -> DataFrame:
    """(node, cluster, least_id, high, low, n, agree) of classes that share a band with others: links lie within clusters.

    Bands have members in any number, as a template may have millions of variants, so what belongs to a band or a pivot
    is joined by with_class().
    """
    buckets = nodes.select(F.explode("bands").alias("band"), "node", F.col("n_shingles").alias("n"))
    buckets = staged(with_neighbours(buckets, "band", percent), "neardup-neighbours")
    shared = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = staged(with_class(buckets, shared, ["band"], "size"), "neardup-buckets")
    agree = nodes.select("node", "agree")
    labels = buckets.select("node").distinct().select("node", F.col("node").alias("component"))
    ties = staged(pivot_ties(buckets, agree, percent, compare), "neardup-ties")
    labels = staged(relabelled(labels, components(ties, "neardup-tied")), "neardup-labels")
    placed = with_rest(buckets.join(labels, "node"), "band")
    others = tiles(placed.join(agree, "node"), "band").groupBy("key", "i", "j").applyInArrow(tie_tile(percent, compare), "a long, b long")
    # edges between the components so far, which hold the nodes
    whole = components(labels.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(staged(others.distinct(), "neardup-others")), "neardup-clusters")
    clusters = whole.select("node", F.col("component").alias("cluster"))
    return nodes.join(clusters, "node").select("node", "cluster", "least_id", "high", "low", F.col("n_shingles").alias("n"), "agree")


def with_neighbours(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """rows (key, node, n) without most of those whose key, a number, no other row of a size that percent allows has.

    In the order of sizes, a row has such a partner only if one of its neighbours is one. Rows are ranged by key, size and
    node, so a heavy key lies in many ranges; what borders a range is kept. One exchange drops what is alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            n = whole.column(2).to_numpy()
            same = (np.diff(whole.column(0).to_numpy()) == 0) & (100 * n[:-1] >= percent * n[1:])
            keep = np.append(same, False) | np.append(matched if held is not None else first, same)
            yield whole.slice(0, whole.num_rows - 1).filter(pa.array(keep[:-1]))
            held, matched, first = whole.slice(whole.num_rows - 1), bool(keep[-1]), False
        if held is not None:
            yield held

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.select(key, "node", "n").repartitionByRange(key, "n", "node").sortWithinPartitions(key, "n").mapInArrow(run, kinds)


def rank() -> Column:
    """The order in which classes are chosen as pivots."""
    return F.struct(F.xxhash64("node").alias("rank"), "node")


def pivot_ties(buckets: DataFrame, agree: DataFrame, percent: int, compare: Compare) -> DataFrame:
    """(a, b): each class whose sketch is similar enough to that of its bucket's pivot, and that pivot.

    The pivot is the class with the smallest hash, so the buckets of one family tend to share it.
    """
    pivots = buckets.groupBy("band").agg(F.min_by(F.struct("node", "n"), rank()).alias("p"), F.count(F.lit(1)).alias("size"))
    beside = with_class(buckets.select("band", "node", "n"), pivots, ["band"], "p").where((F.col("p.node") != F.col("node")) & sizes_allow(F.col("n"), F.col("p.n"), percent))
    pairs = staged(beside.select("node", "n", F.col("p.node").alias("b"), F.col("p.n").alias("m")).distinct(), "neardup-pivot-pairs")
    both = looked_up(pairs, "b", agree.select(F.col("node").alias("b"), F.col("agree").alias("y")), "y").join(agree.select("node", F.col("agree").alias("x")), "node").select("node", "b", "x", "y", "n", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(i).to_pylist() for i in (2, 3))
            chosen = pa.array(np.flatnonzero(compare.pairs(x, y, batch.column(4).to_numpy(), batch.column(5).to_numpy(), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(chosen), batch.column(1).take(chosen)], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def pivot_links(held: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """(a, b): classes of a cluster that are linked with one of its PIVOTS pivots, on the full sets."""
    w = Window.partitionBy("cluster").orderBy(F.xxhash64("node"), "node")
    chosen = held.select("cluster", "node", F.row_number().over(w).alias("k")).where(F.col("k") <= PIVOTS).select("cluster", "node")
    near = pivot_overlaps(held, sizes, chosen, held, percent)
    return near.where(100 * F.col("common") >= percent * (F.col("n") + F.col("m") - F.col("common"))).select(F.col("node").alias("a"), "b")


def pivot_overlaps(held: DataFrame, sizes: DataFrame, chosen: DataFrame, sets: DataFrame, percent: int = 0) -> DataFrame:
    """(cluster, node, b, n, m, common) of the members of clusters and each of their chosen pivots (cluster, node) of a size that percent allows.

    held: cluster, node, n, hashes; sets: node, n, hashes; sizes: cluster, members. The pivots of a heavy cluster are repeated, so that each
    copy of them meets at most 1 / common.HEAVY of all classes.
    """
    total = sizes.agg(F.sum("members").alias("total"))
    heavy = sizes.crossJoin(F.broadcast(total)).where(F.col("members") * common.HEAVY >= F.col("total"))  # one row of totals
    heavy = F.broadcast(heavy.select("cluster", F.ceil(F.col("members") * common.HEAVY / F.col("total")).cast("int").alias("parts")))  # at most common.HEAVY rows
    parts = F.coalesce("parts", F.lit(1))
    pivots = chosen.join(sets.select("node", F.col("n").alias("m"), F.col("hashes").alias("y")), "node").join(heavy, "cluster", "left")
    pivots = pivots.select("cluster", F.col("node").alias("b"), "m", "y", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = held.join(heavy, "cluster", "left").select("cluster", "node", "n", "hashes", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))
    both = dealt.join(pivots, ["cluster", "part"]).where((F.col("node") != F.col("b")) & sizes_allow(F.col("n"), F.col("m"), percent)).select("cluster", "node", "b", "n", "m", "hashes", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = []
            for x, y in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                shared.append(int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(shared, type=pa.int64())], names=["cluster", "node", "b", "n", "m", "common"])

    return both.mapInArrow(run, "cluster long, node long, b long, n long, m long, common long")


def with_rest(members: DataFrame, key: str) -> DataFrame:
    """members (key, node, n, size, component) of groups that have a rest, with rest (not in the first pivot's component) and rest_size."""
    groups = members.groupBy(key).agg(F.min_by("component", rank()).alias("main"), F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size")).where("low <> high and size > 2")  # of two, one is the pivot
    marked = with_class(members, groups, [key], "main")
    marked = staged(marked.withColumn("rest", F.col("component") != F.col("main")).drop("main"), "neardup-marked-bands")
    return with_class(marked, marked.groupBy(key).agg(F.count_if("rest").alias("rest_size"), F.count(F.lit(1)).alias("size")), [key], "rest_size")


def cluster_rest(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """members (cluster, node, n, component) of clusters that have a rest, as with_rest() gives them, with the cluster's size.

    Sizes count members, or TILE_SHINGLES / TILE shingles as one if that gives more. Clusters have members in any
    number, so what belongs to a cluster is joined by with_class().
    """
    main = members.groupBy("cluster").agg(F.min_by("component", rank()).alias("main")).join(sizes.withColumnRenamed("size", "parts"), "cluster")
    marked = with_class(members, main.withColumnRenamed("members", "size"), ["cluster"], "main", "parts")
    marked = staged(marked.withColumn("rest", F.col("component") != F.col("main")).drop("main"), "neardup-marked")
    weight = F.ceil(F.sum(F.when(F.col("rest"), F.col("n")).otherwise(F.lit(0))) * (TILE / TILE_SHINGLES))
    rest = marked.groupBy("cluster").agg(F.greatest(F.count_if("rest"), weight).alias("rest_size"), F.count(F.lit(1)).alias("size"))
    return with_class(marked, rest.where("rest_size > 0"), ["cluster"], "rest_size").withColumnRenamed("parts", "size")


def tiles(placed: DataFrame, key: str) -> DataFrame:
    """placed with key, i, j and left: members dealt so that each of the rest meets each member of its group in a tile.

    A group has size / TILE parts of all members and rest_size / TILE parts of the rest, by a hash; a tile holds
    one part of either kind. The work grows with the rest of a group times the group, not with its square.
    """
    parts = {c: F.ceil(F.col(c) / TILE).cast("int") for c in ("size", "rest_size")}
    own = {c: F.pmod(F.xxhash64("node"), n).cast("int") for c, n in parts.items()}
    every = F.sequence(F.lit(0), parts["rest_size"] - 1)
    right = placed.withColumn("j", own["size"]).withColumn("i", F.explode(every)).withColumn("left", F.lit(False))
    left = placed.where("rest").withColumn("i", own["rest_size"]).withColumn("j", F.explode(F.sequence(F.lit(0), parts["size"] - 1))).withColumn("left", F.lit(True))
    return right.unionByName(left).withColumnRenamed(key, "key").drop("rest", "rest_size", "size")


def tile_candidates(group: pa.Table, percent: int, component: np.ndarray, compare: Compare) -> Iterator[tuple[int, np.ndarray]]:
    """(left member, right members that may be similar enough) of a tile, across components as they are by then."""
    n = group.column("n").to_numpy()
    similar = compare.within(group.column("agree").to_pylist(), n, percent)
    side = group.column("left").to_numpy(zero_copy_only=False)
    right = np.flatnonzero(~side)
    for k in np.flatnonzero(side):
        near = right[(component[right] != component[k]) & (100 * np.minimum(n[right], n[k]) >= percent * np.maximum(n[right], n[k]))]
        if len(near):
            near = near[similar(k, near)]
        if len(near):
            yield k, near


def joined(component: np.ndarray, members: np.ndarray) -> list[int]:
    """Join the components of the members, in place; one member for each component that was joined to the first's."""
    names, at = np.unique(component[members], return_index=True)
    component[np.isin(component, names)] = component[members[0]]
    return members[at].tolist()


def tie_tile(percent: int, compare: Compare):
    def run(group: pa.Table) -> pa.Table:
        node, component, a, b = group.column("node").to_numpy(), group.column("component").to_numpy().copy(), [], []
        for k, near in tile_candidates(group, percent, component, compare):
            for m in joined(component, np.append(near, k)):
                a.append(node[k])
                b.append(node[m])
        return pa.table({"a": pa.array(a, type=pa.int64()), "b": pa.array(b, type=pa.int64())})

    return run


def link_tile(percent: int, compare: Compare):
    def run(group: pa.Table) -> pa.Table:
        node, component, a, b = group.column("node").to_numpy(), group.column("component").to_numpy().copy(), [], []
        sets = [np.frombuffer(x, dtype=np.uint64) for x in group.column("hashes").to_pylist()]
        size = np.array([len(x) for x in sets])
        kinds, codes = np.unique(np.concatenate(sets), return_inverse=True)
        begins = np.concatenate(([0], np.cumsum(size)))
        marked = np.zeros(len(kinds), dtype=np.int64)
        for k, near in tile_candidates(group, percent, component, compare):
            marked[codes[begins[k] : begins[k + 1]]] = 1
            common = np.array([marked[codes[begins[m] : begins[m + 1]]].sum() for m in near])
            marked[codes[begins[k] : begins[k + 1]]] = 0
            near = near[100 * common >= percent * (size[k] + size[near] - common)]
            if len(near):
                for m in joined(component, np.append(near, k)):
                    a.append(node[k])
                    b.append(node[m])
        return pa.table({"a": pa.array(a, type=pa.int64()), "b": pa.array(b, type=pa.int64())})

    return run
