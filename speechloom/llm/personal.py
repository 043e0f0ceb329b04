"""Personal data: fixed patterns, and identifiers found by bootstrapped contextual extraction.

Fixed patterns find e-mail addresses, IP addresses, card and phone numbers. These seeds, and seeds given by
further expressions, induce lexical patterns: the two words in front of an identifier. Spark builds the graph
of patterns and the instances they introduce, and scores it in rounds: a pattern is as good as the share of
all its occurrences that introduce known identifiers, an instance is as good as its patterns let it be.
Confident patterns then mark identifiers of any shape that no expression knows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechloom.llm.common import LOWER, blocks, mix, staged, word_hashes
from speechloom.llm.neardup import looked_up

KINDS = ("email", "ip", "card", "phone")
#: Kind of the spans that patterns discover.
FOUND = "id"
#: Further seeds, which count as evidence for patterns but are no spans by themselves: long hexadecimal keys.
SEEDS = (r"[0-9a-f]{32,}",)
ROUNDS = 3
#: A pattern needs so many distinct known instances, and this confidence in the end.
MIN_INSTANCES, MIN_CONFIDENCE = 3, 0.8
#: Bits of the filter of wanted patterns, which is broadcast; ranges in which it is made; pairs that a task holds.
FILTER_BITS, FILTER_RANGES, HELD_PAIRS = 1 << 26, 64, 1 << 20

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_CANDIDATE = re.compile(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*")
_EDGE = "\"'`(),.;:!?<>[]{}#%&*$|"
#: A candidate identifier without its edges: long enough and with at least four digits or letters among digits.
_SHAPE = re.compile(r"(?=.*[0-9])[A-Za-z0-9][A-Za-z0-9_+./=@:-]{4,}[A-Za-z0-9=]\Z")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches around each @; the part before it is its run of allowed characters, so time is linear."""
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done:  # run backwards in pieces, as a run may be long
            piece = text[max(done, begin - 256) : begin]
            kept = len(_LOCAL_END.search(piece).group()) if not _NOT_LOCAL.search(piece) else len(piece) - (max(m.end() for m in _NOT_LOCAL.finditer(piece)))
            begin -= kept
            if kept < len(piece):
                break
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            yield begin, m.end()
            done = m.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, leftmost and non-overlapping within a kind, in order of kinds."""
    out = [("email", a, b) for a, b in emails(text)]
    if text.count(".") > 2:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append(("phone", *m.span()))
    return out


def candidates(text: str) -> Iterator[tuple[str, int, int, str]]:
    """(pattern, start, end, instance) of each word that may be an identifier; pattern: the two words before."""
    for m in _CANDIDATE.finditer(text):
        word = m.group()
        core = word.strip(_EDGE)
        if not _SHAPE.match(core):
            continue
        start = m.start() + (len(word) - len(word.lstrip(_EDGE)))
        before = words_before(text, m.start())
        if len(before) == 2:
            yield b" ".join(before).decode("utf-8", "replace"), start, start + len(core), core


def words_before(text: str, end: int) -> list[bytes]:
    """The last two whole words before a place, A-Z lower-cased; one or none where the text begins."""
    size = 64
    while True:
        begin = max(0, end - size)
        words = text[begin:end].encode("utf-8", "replace").lower().split()
        if not begin or len(words) > 2:  # the first of more than two may be the rest of a longer word
            return words[-2:]
        size *= 4


class Spans:
    """Spans in order of their starts, to be asked for an overlap in logarithmic time."""

    def __init__(self, spans: list[tuple[str, int, int]]) -> None:
        placed = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in placed]
        self.reach = list(accumulate((b for _, b in placed), max))  # how far the spans up to this one reach

    def overlap(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, end)
        return k > 0 and self.reach[k - 1] > start


def edges(docs: DataFrame, seeds: tuple[str, ...]) -> DataFrame:
    """The graph: (pattern, instance, known, n) over all texts; known instances overlap a base span or match a seed."""
    extra = [re.compile(s) for s in seeds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple[str, str], list] = {}
            for text in batch.column(0).to_pylist():
                spans = None
                for pattern, start, end, core in candidates(text or ""):
                    if spans is None:
                        spans = Spans(base_spans(text))
                    known = spans.overlap(start, end) or any(s.fullmatch(core) for s in extra)
                    key = (pattern, hashlib.blake2b(core.encode("utf-8", "replace"), digest_size=16).hexdigest())
                    row = rows.setdefault(key, [False, 0])
                    row[0] |= known
                    row[1] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], type=pa.string()), pa.array([k[1] for k in rows], type=pa.string()), pa.array([v[0] for v in rows.values()], type=pa.bool_()), pa.array([v[1] for v in rows.values()], type=pa.int64())], names=["pattern", "instance", "known", "n"])

    return docs.mapInArrow(run, "pattern string, instance string, known boolean, n long").groupBy("pattern", "instance").agg(F.max("known").alias("known"), F.sum("n").alias("n"))


def pattern_hashes(patterns: list[str]) -> np.ndarray:
    joined = " ".join(patterns).encode("utf-8", "replace")
    words, _, _ = word_hashes(LOWER[np.frombuffer(joined, dtype=np.uint8)])
    return mix(words[::2] * np.uint64(3) + words[1::2])


def hashed_patterns(patterns: DataFrame) -> DataFrame:
    """(pattern, hash) of a table with the column pattern."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pattern_hashes(batch.column(0).to_pylist()).view(np.int64))], names=["pattern", "hash"])

    return patterns.select("pattern").mapInArrow(run, "pattern string, hash long")


def pattern_filter(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter of FILTER_BITS bits over the hashes of a table, as packed bits: its size does not depend on the table's.

    Tasks give the bits that they set by range; ranges are combined by Spark.
    """
    span = FILTER_BITS // FILTER_RANGES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for batch in batches:
            for at in filter_bits(batch.column(0).to_numpy().view(np.uint64)):
                np.bitwise_or.at(seen, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for k in range(FILTER_RANGES):
            own = seen[k * span // 8 : (k + 1) * span // 8]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([own.tobytes()], type=pa.binary())], names=["range", "bits"])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[k] = held.get(k, np.zeros(span // 8, dtype=np.uint8)) | np.frombuffer(bits, dtype=np.uint8)
        for k, bits in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([bits.tobytes()], type=pa.binary())], names=["range", "bits"])

    kind = "range long, bits binary"
    out = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in wanted.select("hash").mapInArrow(mark, kind).repartition(FILTER_RANGES, "range").mapInArrow(combine, kind).collect():  # FILTER_BITS bits in all
        out[r["range"] * span // 8 : (r["range"] + 1) * span // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def filter_bits(hashes: np.ndarray) -> Iterator[np.ndarray]:
    """The two places of each hash in the filter."""
    for other in (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47):
        yield (mix(hashes ^ np.uint64(other)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def occurrences(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(hash, total): how often the two words of each pattern stand side by side before a third word.

    One pass over the texts, whatever the number of patterns: a task adds up the pairs that pass a filter of the wanted
    ones, and the sums are joined with these.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pattern_filter(wanted))  # FILTER_BITS bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held, size = shared.value, [], 0

        def summed() -> pa.RecordBatch:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64))], names=["hash", "total"])

        for batch in batches:
            values = [(t or "").encode("utf-8", "replace") for t in batch.column(0).to_pylist()]
            for _, parts in blocks(values):
                data = LOWER[np.frombuffer(b"".join(p + b" " for _, p in parts), dtype=np.uint8)]
                words, starts, _ = word_hashes(data)
                if len(words) < 3:
                    continue
                owner = np.searchsorted(np.cumsum([len(p) + 1 for _, p in parts]), starts, side="right")
                pair = mix(words[:-2] * np.uint64(3) + words[1:-1])[owner[:-2] == owner[2:]]
                pair = pair[np.all([bits[at >> 3] >> (at & 7) & 1 for at in filter_bits(pair)], axis=0)]
                held.append(np.unique(pair, return_counts=True))
                size += len(held[-1][0])
                if size > HELD_PAIRS:
                    yield summed()
                    held, size = [], 0
        if held:
            yield summed()

    found = docs.mapInArrow(run, "hash long, total long").groupBy("hash").agg(F.sum("total").alias("total"))
    return found.join(wanted.select("hash").distinct(), "hash", "left_semi")


def learn_patterns(docs: DataFrame, seeds: tuple[str, ...] = SEEDS, rounds: int = ROUNDS) -> dict[str, float]:
    """Confident patterns of a table with the column text, by scoring the pattern-instance graph in rounds."""
    graph = staged(edges(docs.select("text"), seeds), "pii-graph")
    support = graph.groupBy("pattern").agg(F.count(F.lit(1)).alias("instances"))
    wanted = staged(hashed_patterns(support.where(F.col("instances") >= MIN_INSTANCES)), "pii-patterns")
    if wanted.isEmpty():
        return {}
    totals = staged(wanted.join(occurrences(docs.select("text"), wanted), "hash").select("pattern", "total"), "pii-totals")
    # a pattern may stand before any number of instances, so what belongs to it is joined by size
    graph = staged(looked_up(graph, "pattern", totals, "total"), "pii-wanted")
    known = graph.groupBy("instance").agg(F.max(F.col("known").cast("double")).alias("known"))
    score = known.select("instance", F.col("known").alias("score"))
    for k in range(rounds):
        # a pattern of few occurrences is shrunk towards no confidence by two more without an identifier
        by_pattern = looked_up(graph, "instance", score, "score").groupBy("pattern").agg(F.sum(F.col("score") * F.col("n")).alias("hits"), F.max("total").alias("total"), F.sum(F.when(F.col("score") > 0.5, 1).otherwise(0)).alias("instances"))
        confident = by_pattern.where(F.col("instances") >= MIN_INSTANCES).select("pattern", F.least(F.lit(1.0), F.col("hits") / (F.col("total") + 2)).alias("confidence"))
        confident = staged(confident, f"pii-round-{k}")
        if k + 1 < rounds:
            best = looked_up(graph, "pattern", confident, "confidence").groupBy("instance").agg(F.max("confidence").alias("confidence"))
            score = known.join(best, "instance", "left").select("instance", F.greatest("known", F.coalesce("confidence", F.lit(0.0))).alias("score"))
    return {r[0]: r[1] for r in confident.where(F.col("confidence") >= MIN_CONFIDENCE).collect()}  # each occurs at least eight times


def all_spans(text: str, patterns: dict[str, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and the spans that confident patterns add beside them."""
    base = base_spans(text)
    if not patterns:
        return base, []
    taken = Spans(base)
    return base, [(FOUND, a, b) for p, a, b, _ in candidates(text) if p in patterns and not taken.overlap(a, b)]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """Per row: doc_id, counts of the base kinds and of discovered ids, base_sha256 and spans.

    Offsets are code points, ends are exclusive. Null texts are empty; null and repeated ids and repeated
    rows are worked on one by one; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    patterns = docs.sparkSession.sparkContext.broadcast(learn_patterns(rows, seeds))
    kind = docs.schema[id_col].dataType.simpleString()

    def join(spans: list[tuple[str, int, int]]) -> str:
        return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t or "", patterns.value) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(k == kind_ for k, _, _ in base) for base, _ in found], type=pa.int64()) for kind_ in KINDS]
            digests = pa.array([hashlib.sha256(join(base).encode()).hexdigest() for base, _ in found], type=pa.string())
            spans = pa.array([join(base + added) for base, added in found], type=pa.string())
            ids = pa.array([len(added) for _, added in found], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, spans, ids], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_found"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_found long")


def mask_personal_data(docs: DataFrame, seeds: tuple[str, ...] = SEEDS) -> DataFrame:
    """docs with every span of its column text replaced by its kind in brackets; n_chars follows, where it is."""
    patterns = docs.sparkSession.sparkContext.broadcast(learn_patterns(docs.select("text"), seeds))

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masked = [None if t is None else mask(t, patterns.value) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(masked, type=pa.string()), *batch.columns[at + 1 :]], names=batch.schema.names)

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mask(text: str, patterns: dict[str, float]) -> str:
    """Spans replaced from the left; of overlapping ones, the union is replaced under the first one's kind."""
    base, added = all_spans(text, patterns)
    out, done = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(base + added, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[done:a], f"[{kind.upper()}]"]
        done = b
    return "".join(out) + text[done:]
