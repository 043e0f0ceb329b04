"""Collocations from a weighted de Bruijn graph of words.

The graph's edges are the longest phrases (ORDER words), its nodes the phrases of one word less that overlap in
them. Tasks count the edges of their texts, and the last words of each piece, which begin no whole edge: an end of
three, two and one words. Edges and ends are range-sorted once by their words. There every shorter phrase is a run of
neighbours, and its count is the flow out of its node, the sum over the edges that begin with it, plus the ends that
begin with it. So one exchange gives the counts of all lengths; only runs that reach the least count leave a task,
and those that touch a partition's border, which are added up afterwards.

The edges that are frequent are compacted: unary paths, whose inner nodes have one frequent edge in and one out, become
rows of words and weights, by pointers that double their reach. A path names the longer phrases around each of its nodes
once for all of its edges. What follows are joins of the tables of frequent phrases.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechloom.llm.common import LOWER, staged, texts, with_class
from speechloom.llm.perplexity import by_language

#: Words of an edge.
ORDER = 4
#: Bytes of text that are worked on as one numpy block, and distinct phrases that a task holds.
BLOCK_BYTES, HELD = 1 << 19, 1 << 20
#: Documents of which every STRIDE-th edge or end shows where ranges begin, and how many of these count.
SAMPLED, STRIDE, SAMPLED_GRAMS = 2000, 16, 50_000
#: Rows of a sorted partition that are worked on at once.
GATHERED = 1 << 14
#: Bytes of two neighbours that are compared as a block; longer ones are compared one by one.
COMPARED = 64
#: Edges of a path that one row holds.
PATH_EDGES = 256
#: Parts in which a language's phrases are ranked first.
RANK_PARTS = 64
#: Bytes that end a piece, and bytes that separate words.
PIECE_ENDS, SPACES = b".,;:!?\x0a\x0b\x0c\x0d", b" \t"

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(SPACES)] = 1
_KIND[list(PIECE_ENDS)] = 2
_SEPARATOR = re.compile(b"[" + re.escape(PIECE_ENDS + SPACES) + b"]")
#: Words are joined by the byte 0, so that phrases sort word by word; a 0 inside a word is written as a tab, which no word has.
_INNER = np.arange(256, dtype=np.uint8)
_INNER[0] = 9


def parts(values: list[bytes]) -> Iterator[list[tuple[int, bytes, bool]]]:
    """Blocks of (row, part of its text, whether it is the last one); cuts are behind separators."""
    held: list[tuple[int, bytes, bool]] = []
    size = 0
    for row, value in enumerate(values):
        at = 0
        while True:
            end = at + BLOCK_BYTES
            if end < len(value):
                last = max(value.rfind(bytes([b]), at, end) for b in SPACES + PIECE_ENDS)
                found = None if last >= at else _SEPARATOR.search(value, end)
                end = last + 1 if last >= at else found.end() if found else len(value)
            if held and size + min(end, len(value)) - at > BLOCK_BYTES:
                yield held
                held, size = [], 0
            held.append((row, value[at:end], end >= len(value)))
            size += len(held[-1][1])
            at = end
            if at >= len(value):
                break
    if held:
        yield held


def block_phrases(block: list[tuple[int, bytes, bool]], tails: dict[int, bytes]) -> pa.Array:
    """Edges and ends of a block; tails holds, by row, the words of a piece that goes on in the row's next part."""
    chunks = [tails.pop(row, b"") + part for row, part, _ in block]
    data = LOWER[np.frombuffer(b"\n".join(chunks) + b"\n", dtype=np.uint8)]
    kind = _KIND[data]
    inside = kind == 0
    steps = np.diff(np.concatenate(([False], inside)).astype(np.int8))
    starts, piece = np.flatnonzero(steps == 1), np.cumsum(kind == 2)
    ends = np.flatnonzero(np.diff(np.concatenate((inside, [False])).astype(np.int8)) == -1) + 1
    own = piece[starts]
    closed = np.ones(len(starts), dtype=bool)  # of a piece's last word: whether the piece ends there
    limits = np.cumsum([len(c) + 1 for c in chunks])
    for (row, _, last), chunk_end in zip(block, limits, strict=True):
        if not last:
            k = int(np.searchsorted(starts, chunk_end)) - 1  # the part's last word
            if k >= 0 and own[k] == piece[chunk_end - 2]:
                closed[k] = False
                first = max(k - ORDER + 2, int(np.searchsorted(own, own[k])))
                tails[row] = b"".join(data[starts[j] : ends[j]].tobytes() + b" " for j in range(first, k + 1))
    # the words, each followed by a 0
    nth = np.cumsum(steps == 1)[inside] - 1
    joined = np.zeros(len(nth) + len(starts) + 1, dtype=np.uint8)
    joined[np.arange(len(nth)) + nth] = _INNER[data[inside]]
    lengths = ends - starts
    at = np.cumsum(lengths + 1) - lengths - 1
    word = np.arange(len(starts))
    whole = word[: max(0, len(word) - ORDER + 1)]
    whole = whole[own[whole] == own[whole + ORDER - 1]]
    last = word[closed & np.concatenate((own[1:] != own[:-1], [True]))[: len(word)]]
    spans = [(whole, whole + ORDER - 1)]
    for k in range(1, ORDER):
        enough = last[last >= k - 1]
        enough = enough[own[enough - k + 1] == own[enough]]
        spans.append((enough - k + 1, enough))
    first, final = (np.concatenate([s[i] for s in spans]) for i in (0, 1))
    size = at[final] + lengths[final] - at[first]
    offsets = np.concatenate(([0], np.cumsum(size)))
    source = np.repeat(at[first] - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(joined[source])])


def summed(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by("gram", use_threads=False).aggregate([("n", "sum")]).rename_columns(["gram", "n"])


def counted_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    """(lang, table of gram and n in order of gram): edges and ends of batches of (lang, text), counted a bounded number at a time."""
    held: dict[str, list[pa.Table]] = {}
    size = 0
    for batch in batches:
        langs, values = batch.column(0).to_pylist(), texts(batch.column(1))
        for lang in dict.fromkeys(langs):
            tails: dict[int, bytes] = {}
            for block in parts([v for m, v in zip(langs, values, strict=True) if m == lang]):
                counted = pc.value_counts(block_phrases(block, tails))
                held.setdefault(lang, []).append(pa.table({"gram": counted.field(0), "n": counted.field(1)}))
                size += len(counted)
                if size > 2 * HELD:
                    held = {k: [summed(v)] for k, v in held.items()}
                    size = sum(len(t) for v in held.values() for t in v)
                    if size > HELD:
                        yield from ((k, v[0].sort_by("gram")) for k, v in held.items())
                        held, size = {}, 0
    yield from ((k, summed(v).sort_by("gram")) for k, v in held.items())


def range_bounds(docs: DataFrame, ranges: int) -> list[tuple[bytes, bytes]]:
    """Where ranges of about as many edges and ends begin, as (lang, gram), by a sample of about SAMPLED documents.

    The bounds decide where a phrase is counted, and nothing else. The driver gets SAMPLED_GRAMS rows, about.
    """
    n = docs.count()
    if not n or ranges < 2:
        return []

    def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, found in counted_phrases(batches):
            few = found.column(0).take(pa.array(np.arange(0, len(found), STRIDE)))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(few), type=pa.string()), few.combine_chunks()], names=["lang", "gram"])

    sample = docs.sample(min(1.0, SAMPLED / n), seed=13).mapInArrow(thinned, "lang string, gram string")
    kept = sample.withColumn("n", F.xxhash64("lang", "gram")).orderBy("n").limit(SAMPLED_GRAMS).select("lang", "gram")
    found = sorted((r["lang"].encode(), r["gram"].encode()) for r in kept.collect())
    return sorted({found[len(found) * k // ranges] for k in range(1, ranges)}) if found else []


def dealt_phrases(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): counted edges and ends of whole texts, in ranges that are sorted; docs has columns lang (not null) and text."""
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = range_bounds(docs, ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, found in counted_phrases(batches):
            gram, n = (c.combine_chunks() for c in found.columns)
            own = lang.encode()
            cuts = [bisect_left(range(len(gram)), b, key=lambda k: gram[k].as_py().encode()) for m, b in bounds if m == own]
            at = sum(m < own for m, _ in bounds) + np.searchsorted(cuts, np.arange(len(gram)), side="right")
            whole = pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([lang]).take(pa.array(np.zeros(len(gram), dtype=np.int32))), gram, n], names=["range", "lang", "gram", "n"])
            yield from (whole.slice(k, 1 << 15) for k in range(0, len(gram), 1 << 15))

    counted = docs.mapInArrow(run, "range int, lang string, gram string, n long")
    return counted.repartitionById(ranges, F.col("range")).drop("range").sortWithinPartitions("lang", "gram")


def shared_bytes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many leading bytes each string but the first shares with the one before it."""
    sizes = np.diff(offsets)
    width = int(min(COMPARED, sizes.max()))
    columns = np.arange(width)
    inside = columns < sizes[:, None]
    block = np.where(inside, data[np.minimum(offsets[:-1, None] + columns, len(data) - 1)], 255)  # no UTF-8 has the byte 255
    differ = block[1:] != block[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    least = np.minimum(sizes[1:], sizes[:-1])
    for k in np.flatnonzero((shared == width) & (least > width)):  # long strings that agree so far
        a, b = (data[offsets[k + i] : offsets[k + i] + least[k]] for i in (0, 1))
        other = np.flatnonzero(a != b)
        shared[k] = other[0] if len(other) else least[k]
    return np.minimum(shared, least)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Columns of GATHERED rows or more, from batches that are small for the sake of long texts; the gram as bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= GATHERED:
            yield _columns(held)
            held = []
    if sum(b.num_rows for b in held):
        yield _columns(held)


def _columns(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array, np.ndarray]:
    lang, gram, n = (pa.concat_arrays([b.column(i) for b in held]) for i in range(3))
    return lang, gram.cast(pa.binary()), n.to_numpy()


def flows(sorted_grams: DataFrame, least: int) -> DataFrame:
    """(lang, k, phrase, n) from edges and ends that are sorted within partitions: counts of phrases of k words.

    Of a phrase that touches the border of a partition the counts of both sides are given; of others, those of at
    least `least`. k is 0 for the number of a language's words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: tuple[str, bytes] | None = None
        open_ = [0] * (ORDER + 1)  # what the last row's phrases have so far
        border = [True] * (ORDER + 1)  # whether they began with the partition's first row
        words: dict[str, int] = {}

        def shown(langs: list[str], phrases: list[bytes], k: int, n: list[int]) -> pa.RecordBatch:
            plain = [p.replace(b"\0", b" ").replace(b"\t", b"\0").decode() for p in phrases]
            return pa.RecordBatch.from_arrays([pa.array(langs, type=pa.string()), pa.array([k] * len(n), type=pa.int32()), pa.array(plain, type=pa.string()), pa.array(n, type=pa.int64())], names=["lang", "k", "phrase", "n"])

        for lang, gram, number in gathered(batches):
            head = carried is not None
            if head:
                lang, gram = (pa.concat_arrays([pa.array([c], type=x.type), x]) for c, x in zip(carried, (lang, gram), strict=True))
            n = np.concatenate(([0], number)) if head else number
            offsets = np.frombuffer(gram.buffers()[1], dtype=np.int32)[gram.offset : gram.offset + len(gram) + 1].astype(np.int64)
            data = np.frombuffer(gram.buffers()[2] or b"", dtype=np.uint8)[: offsets[-1]][offsets[0] :]
            offsets -= offsets[0]
            sizes = np.diff(offsets)
            named = lang.dictionary_encode()
            names, codes = named.dictionary.to_pylist(), named.indices.to_numpy()
            for name, s in zip(names, np.bincount(codes, weights=n).astype(np.int64).tolist(), strict=True):
                words[name] = words.get(name, 0) + s
            other = np.concatenate(([True], codes[1:] != codes[:-1]))
            # where the first k words of each row end, -1 if it has fewer
            gaps = np.flatnonzero(data == 0)
            rows = np.searchsorted(offsets, gaps, side="right") - 1
            count = np.bincount(rows, minlength=len(gram))
            until = np.full((len(gram), ORDER + 1), -1, dtype=np.int64)
            until[rows, 1 + np.arange(len(rows)) - np.searchsorted(rows, rows)] = gaps - offsets[rows]
            until[np.arange(len(gram)), count + 1] = sizes
            common = np.concatenate(([0], shared_bytes(data, offsets)))
            before = np.concatenate(([-1], sizes[:-1]))
            for k in range(1, ORDER + 1):
                has = np.flatnonzero(until[:, k] >= 0)
                if not len(has):
                    continue
                u = until[has, k]
                same = ~other[has] & ((common[has] > u) | ((common[has] == u) & (before[has] == u)))
                starts = np.flatnonzero(~same)
                if not len(starts) or starts[0]:
                    starts = np.concatenate(([0], starts))
                value = n[has].copy()
                goes_on = head and has[0] == 0  # row 0 is the one carried over
                value[0] += open_[k] if goes_on else 0
                sums = np.add.reduceat(value, starts)
                last_open = has[-1] == len(gram) - 1
                first_border = border[k] and (goes_on or (not head and has[0] == 0))
                given = sums >= least
                given[0] |= first_border
                if last_open:
                    given[-1] = False
                    open_[k] = int(sums[-1])
                    border[k] = first_border and len(sums) == 1
                chosen = np.flatnonzero(given)
                if len(chosen):
                    at = has[starts[chosen]]
                    yield shown([names[codes[i]] for i in at], [data[offsets[i] : offsets[i] + until[i, k]].tobytes() for i in at], k, sums[chosen].tolist())
            if not head:
                border = [b and until[0, k] >= 0 and b for k, b in enumerate(border)]
            carried = (names[codes[-1]], data[offsets[-2] :].tobytes())
        if carried is not None:
            own = carried[1].split(b"\0")
            for k in range(1, len(own) + 1):
                yield shown([carried[0]], [b"\0".join(own[:k])], k, [open_[k]])
            yield shown(list(words), [b""] * len(words), 0, list(words.values()))

    return sorted_grams.mapInArrow(run, "lang string, k int, phrase string, n long")


def phrase_counts(docs: DataFrame, least: int) -> DataFrame:
    """(lang, k, phrase, n): phrases of 1 to ORDER words that occur `least` times, and with k = 0 the words of each language."""
    sums = flows(dealt_phrases(docs), least).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    return staged(sums.where((F.col("k") == 0) | (F.col("n") >= least)), "phrases-counts")


def unary_paths(edges: DataFrame) -> DataFrame:
    """(lang, words, weights): unary paths of edges (lang, phrase, n), cut after PATH_EDGES edges; each edge is in one of them.

    An edge points to the one before it where their node has no other edge. Pointers double their reach until they end
    at an edge without one; on a cycle, the edge with the least number counts as the first.
    """
    edges = staged(edges.select("lang", "phrase", "n").withColumn("id", F.monotonically_increasing_id()), "phrases-edges")
    node = {"in": F.substring_index("phrase", " ", -(ORDER - 1)), "out": F.substring_index("phrase", " ", ORDER - 1)}
    one = {side: edges.groupBy("lang", name.alias("node")).agg(F.count(F.lit(1)).alias("edges"), F.min("id").alias(side)).where("edges = 1").drop("edges") for side, name in node.items()}
    before = one["in"].join(one["out"], ["lang", "node"]).select(F.col("out").alias("id"), F.col("in").alias("up"))
    state = edges.select("id").join(before, "id", "left")
    state = staged(state.select("id", F.coalesce("up", "id").alias("up"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("up").isNull().alias("ended"), F.struct("id", F.lit(0).cast("long").alias("steps")).alias("least")), "phrases-pointers")
    seen = None
    while True:
        after = state.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("ended").alias("at_end"), F.col("least").alias("theirs"))
        theirs = F.struct(F.col("theirs.id").alias("id"), (F.col("theirs.steps") + F.col("steps")).alias("steps"))
        walking = state.where(~F.col("ended")).join(after, "up").select("id", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("at_end").alias("ended"), F.least("least", theirs).alias("least"))
        # an edge that points to one at a path's end has arrived with the step that it has made
        arrived = state.where("ended")
        state = staged(arrived.unionByName(walking), "phrases-pointers")
        left = state.where(~F.col("ended")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("least.id").cast("decimal(38,0)")).alias("least")).first()  # one row
        if not left["n"] or tuple(left) == seen:  # only cycles are left, and each edge knows its cycle's first
            break
        seen = tuple(left)
    first, steps = F.when(F.col("ended"), F.col("up")).otherwise(F.col("least.id")), F.when(F.col("ended"), F.col("steps")).otherwise(F.col("least.steps"))
    placed = edges.join(state.select("id", first.alias("first"), steps.alias("steps")), "id")
    rows = placed.groupBy("lang", "first", F.floor(F.col("steps") / PATH_EDGES).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("steps", "phrase", "n"))).alias("e"))
    words = F.concat(F.split(F.get("e", F.lit(0))["phrase"], " "), F.transform(F.slice("e", 2, PATH_EDGES), lambda x: F.substring_index(x["phrase"], " ", -1)))
    return staged(rows.select("lang", words.alias("words"), F.col("e.n").alias("weights")), "phrases-paths")


def inside_longer(counts: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the largest count of a longer frequent phrase around each phrase of 2 to ORDER - 1 words."""
    paths = unary_paths(counts.where(F.col("k") == ORDER))

    def around(k: int) -> DataFrame:
        """Phrases of k words on the paths: edge j has the words j to j + ORDER - 1."""
        at = F.sequence(F.lit(1), F.size("words") - k + 1)
        widest = F.transform(at, lambda i: F.struct(F.array_join(F.slice("words", i, F.lit(k)), " ").alias("phrase"), F.array_max(F.slice("weights", F.greatest(F.lit(1), i - (ORDER - k)), F.least(i, F.lit(ORDER - k + 1)))).alias("longer")))
        return paths.select("lang", F.inline(widest))

    found = around(2)
    for k in range(3, ORDER):
        found = found.unionByName(around(k))
        own = counts.where(F.col("k") == k)
        for j in range(2, k):
            cuts = [F.array_join(F.slice(F.split("phrase", " "), i, j), " ") for i in range(1, k - j + 2)]
            found = found.unionByName(own.select("lang", F.explode(F.array(*cuts)).alias("phrase"), F.col("n").alias("longer")))
    return found.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))


def cut_scores(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of phrases of two words or more at their lowest-scoring cut, the first of equal ones."""

    def cuts(k: int) -> Column:
        return F.array(*[F.struct(F.lit(j).alias("cut"), F.lit(side).alias("side"), F.substring_index("phrase", " ", j if side == "l" else j - k).alias("part")) for j in range(1, k) for side in ("l", "r")])

    wanted = counts.where("k = 2").select("lang", "phrase", F.col("n").alias("a"), F.inline(cuts(2)))
    for k in range(3, ORDER + 1):
        wanted = wanted.unionByName(counts.where(F.col("k") == k).select("lang", "phrase", F.col("n").alias("a"), F.inline(cuts(k))))
    uses = wanted.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("size"))
    known = staged(uses.join(counts.where("k > 0").select("lang", F.col("phrase").alias("part"), "n"), ["lang", "part"]), "phrases-parts")
    # a common word is part of many phrases; a part of a frequent phrase is as frequent
    found = with_class(wanted, known, ["lang", "part"], "n")
    both = found.groupBy("lang", "phrase", "a", "cut").agg(*[F.max(F.when(F.col("side") == s, F.col("n"))).alias(s) for s in ("l", "r")])
    scored = both.withColumn("score", F.expr("cast(2000000 as decimal(7,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + r)"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("m"))
    return lowest.select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def collocations(docs: DataFrame, least: int = 30, percent: int = 80, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Each language's `top` phrases: lang, rank, phrase, a, l, r, n, score.

    Candidates are phrases of 2 to ORDER words that occur `least` times; those that lie inside a longer candidate with
    100 * count >= percent * a are dropped. Order: score and a downwards, then the phrase in byte order. Null texts are
    empty, a null language is `und`; rows without words give nothing, repeated rows count again. An empty table gives an
    empty result; other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    counts = phrase_counts(rows, least)
    longer = inside_longer(counts)
    kept = cut_scores(counts).join(longer, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer").cast("decimal(19,0)") < percent * F.col("a").cast("decimal(19,0)"), F.lit(True))).drop("longer")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language may hold most phrases: its parts are ranked first
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)).cast("int")
    best = kept.withColumn("part", part).withColumn("place", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("place") <= top)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    n = by_language(counts.where("k = 0").select("lang", "n"))
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: Fixed values of the statement: 30 occurrences, 80 percent, 2,000 phrases.
ORACLE = r"""WITH piece AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(p, '[ \x09]+'), lambda w: w <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS c FROM (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM piece, (SELECT unnest([1, 2, 3, 4]) AS k))) GROUP BY ALL HAVING count(*) >= 30),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY lang),
cand AS (SELECT lang, k, phrase, c, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT c.lang, c.phrase, c.c AS a, j, x.c AS l, y.c AS r, (2000000 * c.c::HUGEINT // (x.c + y.c))::BIGINT AS score FROM (SELECT *, unnest(range(1, k)) AS j FROM cand) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : c.j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.j + 1 : c.k], ' ')),
low AS (SELECT lang, phrase, a, arg_min(l, (score, j)) AS l, arg_min(r, (score, j)) AS r, min(score) AS score FROM cut GROUP BY ALL),
inner_ AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(c) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand)) GROUP BY ALL),
ranked AS (SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, a DESC, w.phrase) AS rank FROM low w LEFT JOIN inner_ i ON i.lang = w.lang AND i.phrase = w.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT r.lang, rank, phrase, a, l, r, n, score FROM ranked r JOIN total t ON t.lang = r.lang WHERE rank <= 2000"""
