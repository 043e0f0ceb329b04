"""Benchmark decontamination: a BM25 index of test items, queried by every training passage.

Items are cut into segments; a segment's BM25 impacts are divided by its score for itself, so a score is the
share of the segment's weight that a passage covers and one threshold serves all. The index is inverted: each
term's postings lie in blocks with their largest impact. A passage first adds up its terms' largest impacts
per range of segments (numpy, no false dismissals); only passages that reach the threshold run block-max
WAND, which retrieves every segment at or above it. Each retrieved item is then verified: enough of both its
question's and its answer's word 3-grams must stand in the passage or beside it. The index is made by Spark
and broadcast in shards of a fixed number of segments, many of them at once, so that the documents, which are never
shuffled, are read once for thousands of segments.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.llm.common import blocks, staged, word_hashes

#: Words of a segment and of a passage; passages overlap by half, so a segment of this length lies inside one.
SEGMENT, PASSAGE = 48, 96
#: Segments of one shard, of all shards that are broadcast for one pass over the documents, and of a range that shares
#: upper bounds. Hashing deals twice as many shards and passes, since it is uneven. The bounds of a shard of 512
#: segments are some 1 MB, and 9 MB if no two segments share a word.
SHARD_SEGMENTS, PASS_SEGMENTS, RANGE = 1024, 16_384, 2
#: Steps in which the bounds are stored, rounded up.
STEPS = 255
#: Postings of a block.
BLOCK = 16
#: Fixed BM25 parameters, the share of a segment's weight that retrieves it, and the shares that verify it.
K1, B = 1.2, 0.75
THRESHOLD, QUESTION_SHARE, ANSWER_SHARE = 0.5, 0.4, 0.3
#: Words of the n-grams that verify an item.
GRAM = 3
WORD_CHARS = "[a-z0-9\\x{80}-\\x{10FFFF}]+"

_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_SPACED = bytes(b if _IN_WORD[b] else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and digits and of any character beyond ASCII."""
    return text.lower().encode("utf-8", "replace").translate(_SPACED).split()


def question_and_answer(words: list[bytes], text: str) -> tuple[int, int]:
    """Words of the question and of the answer: the last sentence answers; a single one is split at 3/4."""
    sentences = [n for s in text.replace("?", ".").replace("!", ".").replace("\n", ".").split(".") if (n := len(words_of(s)))]
    answer = sentences[-1] if len(sentences) > 1 else -(-len(words) // 4)
    return len(words) - answer, answer


def index_postings(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(segment, item, term, impact): normalised BM25 impacts of all segments, by Spark.

    Segments are numbered by item and place. Null and empty items have no segment and are never retrieved.
    """
    spaced = F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(f"({WORD_CHARS})"), F.lit(1))
    words = items.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), spaced.alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size("words") - SEGMENT / 2) / SEGMENT), F.lit(0)).cast("int"))
    cut = words.select("item", "words", F.posexplode(starts).alias("place", "k"), F.size(starts).alias("n"))
    cut = cut.select("item", "place", F.slice("words", F.col("k") * SEGMENT + 1, F.when(F.col("k") == F.col("n") - 1, F.size("words")).otherwise(F.lit(SEGMENT))).alias("words"))
    length = cut.select("item", "place", "words", F.size("words").alias("len"))
    stats = length.agg(F.count(F.lit(1)).alias("n_segments"), F.avg("len").alias("avg_len"))
    terms = length.select("item", "place", "len", F.explode("words").alias("term")).groupBy("item", "place", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = terms.join(df, "term").crossJoin(F.broadcast(stats))  # one row of totals
    idf = F.log(1 + (F.col("n_segments") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    raw = weighed.select("item", "place", "term", impact.alias("raw"))
    own = raw.groupBy("item", "place").agg(F.sum("raw").alias("self"))
    return raw.join(own, ["item", "place"]).select("item", "place", "term", (F.col("raw") / F.col("self")).alias("impact"))


class Shard:
    """Inverted index of about SHARD_SEGMENTS / 2 segments, with what verifies their items."""

    def __init__(self, rows: list[tuple], items: dict[int, str]) -> None:
        segments = sorted({(r[0], r[1]) for r in rows})
        number = {s: k for k, s in enumerate(segments)}
        self.item = [s[0] for s in segments]
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for item, place, term, impact in rows:
            postings.setdefault(term.encode(), []).append((number[item, place], impact))
        self.terms = sorted(postings)
        self.number = {t: k for k, t in enumerate(self.terms)}
        self.segments = [np.array([s for s, _ in sorted(postings[t])]) for t in self.terms]
        self.impacts = [np.array([i for _, i in sorted(postings[t])]) for t in self.terms]
        self.block_max = [[float(x[at : at + BLOCK].max()) for at in range(0, len(x), BLOCK)] for x in self.impacts]
        self.step = max(float(x.max()) for x in self.impacts) / STEPS
        self.grams, self.longest = {}, 0  # bytes of the longest word
        for item, text in items.items():
            words = words_of(text)
            n, _ = question_and_answer(words, text)
            size = min(GRAM, len(words))  # short sides take words of the other side beside them
            self.grams[item] = (word_grams(words[: max(n, size)], size), word_grams(words[max(0, min(n - size + 1, len(words) - size)) :], size), size)
            self.longest = max(self.longest, *map(len, words), 0)
        self.reach = max([PASSAGE, *(reach(q, a) for q, a, _ in self.grams.values())])

    @cached_property
    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the terms in order, and their numbers; made by each worker, like the bounds."""
        found, _, _ = word_hashes(np.frombuffer(b" ".join(self.terms), dtype=np.uint8))
        order = np.argsort(found)
        return found[order], order

    @cached_property
    def bounds(self) -> np.ndarray:
        """Largest impact of each term in each range of segments, in steps, rounded up."""
        bounds = np.zeros((len(self.terms), -(-len(self.item) // RANGE)), dtype=np.uint8)
        term = np.repeat(np.arange(len(self.terms)), [len(x) for x in self.segments])
        steps = np.ceil(np.concatenate(self.impacts) / self.step - 1e-9).clip(1, STEPS)
        np.maximum.at(bounds, (term, np.concatenate(self.segments) // RANGE), steps.astype(np.uint8))
        return bounds

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Segments whose impacts over these terms reach the threshold, by block-max WAND."""
        lists = [[0, t, float(self.impacts[t].max())] for t in terms]  # position, term, largest impact
        found, slack = [], threshold - 1e-9
        at = lambda x: int(self.segments[x[1]][x[0]])
        while True:
            lists = [x for x in lists if x[0] < len(self.segments[x[1]])]
            lists.sort(key=at)
            bound, pivot = 0.0, -1
            for k, x in enumerate(lists):
                bound += x[2]
                if bound >= slack:
                    pivot = k
                    break
            if pivot < 0:
                return found
            target = at(lists[pivot])
            while pivot + 1 < len(lists) and at(lists[pivot + 1]) == target:
                pivot += 1
            shallow, jump = 0.0, at(lists[pivot + 1]) if pivot + 1 < len(lists) else len(self.item)
            for x in lists[: pivot + 1]:
                own = self.segments[x[1]]
                block = int(np.searchsorted(own, target)) // BLOCK
                if block < len(self.block_max[x[1]]):
                    shallow += self.block_max[x[1]][block]
                    jump = min(jump, int(own[min((block + 1) * BLOCK, len(own)) - 1]) + 1)
            if shallow < slack:  # no segment up to the end of these blocks can reach the threshold
                for x in lists[: pivot + 1]:
                    x[0] = int(np.searchsorted(self.segments[x[1]], max(jump, target + 1)))
            elif at(lists[0]) == target:
                score = 0.0
                for x in lists[: pivot + 1]:
                    score += float(self.impacts[x[1]][x[0]])
                    x[0] += 1
                if score >= slack:
                    found.append((target, score))
            else:
                for x in lists[:pivot]:
                    if at(x) < target:
                        x[0] = int(np.searchsorted(self.segments[x[1]], target))


def reach(question: set, answer: set) -> int:
    """Words on either side of a passage in which the grams of an item's sides may stand."""
    return max(PASSAGE, len(question) + len(answer) + GRAM)


def word_grams(words: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def passages_above(shard: Shard, words: np.ndarray, limits: np.ndarray) -> list[int]:
    """Numbers of the half passages that begin a passage whose upper bound in some range reaches the threshold.

    words: term hash per word; limits: the word at which each half begins, and the end. A passage is a half
    and the next one, and each of its terms counts once, with its largest impact in the range.
    """
    hashes, order = shard.hashes
    at = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
    known = np.flatnonzero(hashes[at] == words)
    half, term = np.searchsorted(limits, known, side="right") - 1, order[at[known]]
    key = np.unique(np.concatenate([half, half[half > 0] - 1]) * np.int64(len(hashes)) + np.concatenate([term, term[half > 0]]))
    if not len(key):
        return []
    passage, term = key // len(hashes), key % len(hashes)
    begins = np.flatnonzero(np.diff(passage, prepend=-1))
    sums = np.add.reduceat(shard.bounds[term], begins, axis=0, dtype=np.uint16)  # a passage has at most PASSAGE terms
    return passage[begins][sums.max(axis=1) * shard.step >= THRESHOLD - 1e-3].tolist()


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row and leaked item: doc_id, item_id, score, question_share, answer_share.

    score is the best passage's share of the best segment's weight. Null and empty texts and items leak
    nothing; repeated items (by id, the largest text counts) are one; repeated document rows are searched one
    by one; an empty table gives an empty result. Whole texts are searched, in overlapping passages.
    """
    spark = docs.sparkSession
    unique = items.where(F.col(item_col).isNotNull()).groupBy(F.col(item_col).cast("long").alias("item_id")).agg(F.max(item_text_col).alias("text"))
    unique = staged(unique, "decontaminate-items")
    postings = staged(index_postings(unique), "decontaminate-postings")
    totals = staged(postings.groupBy("item").agg(F.countDistinct("place").alias("n")), "decontaminate-totals")
    n_segments = totals.agg(F.sum("n")).first()[0] or 0
    passes = max(1, -(-n_segments // (PASS_SEGMENTS // 2)))
    kind = docs.schema[id_col].dataType.simpleString()
    fields = f"doc_id {kind}, item_id long, score double, question_share double, answer_share double"
    index = staged(built_shards(postings, unique, totals, passes), "decontaminate-shards")
    out = None
    for k in sorted(r["pass"] for r in index.select("pass").distinct().collect()):  # a number per pass
        shards = [pickle.loads(r["shard"]) for r in index.where(F.col("pass") == k).orderBy("number").collect()]  # PASS_SEGMENTS segments, about
        shared = spark.sparkContext.broadcast(shards)
        found = docs.select(id_col, text_col).mapInArrow(_search(shared), fields)
        if passes > 1:  # written, so that only one pass's index is held at a time
            found = staged(found, "decontaminate-found")
            shared.unpersist()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], fields)


def built_shards(postings: DataFrame, items: DataFrame, totals: DataFrame, passes: int) -> DataFrame:
    """(pass, number, shard): the index in shards of about SHARD_SEGMENTS / 2 segments, each made by a task and pickled.

    postings: item, place, term, impact; items: item_id, text; totals: item, n. All segments of an item are in one pass.
    """
    own = F.pmod(F.xxhash64("item"), F.lit(passes)).alias("pass")
    numbers = totals.groupBy(own).agg(F.ceil(F.sum("n") / (SHARD_SEGMENTS // 2)).alias("shards"))  # a row per pass
    placed = postings.select(own, "item", "place", "term", "impact").join(F.broadcast(numbers), "pass")
    placed = placed.select("pass", F.pmod(F.xxhash64("item", "place"), F.col("shards")).alias("number"), "item", "place", "term", "impact")
    # an item's text stands beside its postings, at place -1
    beside = placed.select("pass", "number", "item").distinct().join(items.select(F.col("item_id").alias("item"), "text"), "item")
    beside = beside.select("pass", "number", "item", F.lit(-1).alias("place"), F.coalesce("text", F.lit("")).alias("term"), F.lit(0.0).alias("impact"))

    def build(group: pa.Table) -> pa.Table:
        rows = list(zip(*[group.column(c).to_pylist() for c in ("item", "place", "term", "impact")], strict=True))
        shard = Shard([r for r in rows if r[1] >= 0], {r[0]: r[2] for r in rows if r[1] < 0})
        return pa.table({"pass": group.column("pass")[:1], "number": group.column("number")[:1], "shard": pa.array([pickle.dumps(shard)], type=pa.binary())})

    return placed.unionByName(beside).groupBy("pass", "number").applyInArrow(build, "pass long, number long, shard binary")


def tail(reach: int, longest: int, joined: bytes, starts: np.ndarray, ends: np.ndarray, first: int, end: int) -> bytes:
    """The last words of a part of a text, which go in front of its next part.

    They hold every passage whose reach crosses the cut, with the reach before it, from a half passage of the
    whole text on, so the parts together find what the whole text does. Words longer than any of the items'
    are shortened to one byte more than those, so they still match none.
    """
    half = PASSAGE // 2
    begin = first + max(0, end - first - 2 * reach - PASSAGE) // half * half
    return b"".join(joined[starts[i] : min(ends[i], starts[i] + longest + 1)] + b" " for i in range(begin, end))


def _search(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = index.value
        reach, longest = max(x.reach for x in shards), max(x.longest for x in shards)
        for batch in batches:
            ids, values = batch.column(0), [(t or "").lower().encode("utf-8", "replace").translate(_SPACED) for t in batch.column(1).to_pylist()]
            rows, carried, done = [], {}, [0] * len(values)
            for _, parts in blocks(values):
                for row, p in parts:
                    done[row] += len(p)
                parts = [(row, carried.pop(row, b"") + p) for row, p in parts]
                joined = b"".join(p + b" " for _, p in parts)
                words, starts, ends = word_hashes(np.frombuffer(joined, dtype=np.uint8))
                if not len(words):
                    continue
                # halves of passages: they begin anew with each text
                firsts = np.searchsorted(starts, np.cumsum([0] + [len(p) + 1 for _, p in parts]))
                if done[parts[-1][0]] < len(values[parts[-1][0]]):
                    carried[parts[-1][0]] = tail(reach, longest, joined, starts, ends, int(firsts[-2]), int(firsts[-1]))
                limits = np.concatenate([np.arange(a, max(b, a + 1), PASSAGE // 2) for a, b in zip(firsts[:-1], firsts[1:], strict=True)] + [firsts[-1:]])
                limits = np.unique(limits)
                for shard in shards:
                    rows += _verified(shard, joined, starts, ends, limits, firsts, parts, passages_above(shard, words, limits))
            best: dict[tuple[int, int], tuple] = {}
            for row, item, score, q, a in rows:
                best[row, item] = tuple(map(max, best.get((row, item), (0.0, 0.0, 0.0)), (score, q, a)))
            found = [(row, item, *v) for (row, item), v in sorted(best.items()) if v[1] >= QUESTION_SHARE and v[2] >= ANSWER_SHARE]
            columns = list(zip(*found, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], type=pa.int64())), pa.array(columns[1], type=pa.int64()), *[pa.array(columns[i], type=pa.float64()) for i in (2, 3, 4)]], names=["doc_id", "item_id", "score", "question_share", "answer_share"])

    return run


def _verified(shard: Shard, joined: bytes, starts: np.ndarray, ends: np.ndarray, limits: np.ndarray, firsts: np.ndarray, parts: list, halves: list[int]) -> list[tuple]:
    """(row, item, score, question share, answer share) of what the passages from these halves retrieve."""
    rows, looked = [], {}
    for half in halves:
        begin, owner = int(limits[half]), int(np.searchsorted(firsts, limits[half], side="right")) - 1
        text_first, text_end = int(firsts[owner]), int(firsts[owner + 1])
        end = min(begin + PASSAGE, text_end)
        inside = {joined[starts[i] : ends[i]] for i in range(begin, end)}
        for segment, score in shard.wand([shard.number[w] for w in inside if w in shard.number], THRESHOLD):
            item = shard.item[segment]
            question, answer, size = shard.grams[item]
            far = reach(question, answer)
            if (half, far, size) not in looked:
                looked[half, far, size] = word_grams([joined[starts[i] : ends[i]] for i in range(max(begin - far, text_first), min(end + far, text_end))], size)
            near = looked[half, far, size]
            rows.append((parts[owner][0], item, score, len(question & near) / max(len(question), 1), len(answer & near) / max(len(answer), 1)))
    return rows
