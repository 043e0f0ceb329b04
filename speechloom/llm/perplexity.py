"""Rule metrics and n-gram perplexity bands per language.

The model is a modified Kneser-Ney model over code points, of order 5, one per language. Tasks count the
5-grams of their texts, Spark sums the counts of the whole corpus, and all that follows are groupings and
joins of n-gram tables: lower orders count the distinct left extensions, counts of counts give the discounts,
contexts give the back-off weights, and each order's probability is interpolated with the one below. The
result is stored as sorted arrays of 64-bit n-gram hashes with a number beside each, cut into shards by the
leading bits of the hash. A model that fits BROADCAST_BYTES is broadcast; of a larger one, blocks of texts ask
the shards for the hashes that they hold, each once, and are scored with the answers.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechloom.llm.common import mix, staged

ORDER = 5
#: Stands before and behind each text.
EDGE = "\0"
#: 5-grams seen fewer times have no entry: what only one text holds must not make it likely.
LEAST_COUNT = 2
#: Width of the bands around the language's median, in robust standard deviations for the text's length.
BELOW, ABOVE = 5.0, 5.0
#: Robust standard deviation that counts where all texts score alike.
EQUAL_SPREAD = 0.1
#: Entries of one shard at most, about, and bytes of a model that is broadcast; an entry has ENTRY bytes.
SHARD_ENTRIES, BROADCAST_BYTES, ENTRY = 1 << 20, 64 << 20, 12
#: Code points that are worked on as one numpy block, and distinct 5-grams that a task holds.
BLOCK_CHARS, HELD = 1 << 18, 1 << 19
#: Languages whose discounts and bands are broadcast.
MOST_LANGUAGES = 10_000
#: Texts, and bytes of texts, of one block of the way without broadcast, about; a longer text is a block by itself.
BLOCK_TEXTS, BLOCK_TEXT_BYTES = 1 << 16, 48 << 20
#: Bytes that count as symbols.
SYMBOL_BYTES = frozenset(b"#*$%&|<>")

_BASE = np.uint64(0x9E3779B97F4A7C15)
Lookup = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def language_seed(lang: str) -> np.uint64:
    return np.frombuffer(hashlib.blake2b(lang.encode(), digest_size=8).digest(), dtype=np.uint64)[0]


def hashed(grams: np.ndarray, seed: np.uint64, tag: int) -> np.ndarray:
    """64-bit hash of rows of code points; tag: the order, plus 8 for the context of an n-gram of that order."""
    code = np.full(len(grams), seed + np.uint64(tag), dtype=np.uint64)
    for i in range(grams.shape[1]):
        code = mix(code * _BASE + grams[:, i]) if i == grams.shape[1] - 1 else code * _BASE + grams[:, i]
    return code if grams.shape[1] else mix(code)


def pieces(values: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Blocks of (row, piece of its text with the ORDER - 1 code points before it); a text's end is an EDGE."""
    held, size = [], 0
    for row, value in enumerate(values):
        whole = EDGE * (ORDER - 1) + value + EDGE
        for at in range(0, len(value) + 1, BLOCK_CHARS):
            part = whole[at : at + BLOCK_CHARS + ORDER - 1]
            if held and size + len(part) > BLOCK_CHARS:
                yield held
                held, size = [], 0
            held.append((row, part))
            size += len(part)
    if held:
        yield held


def windows(parts: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    """5-grams of a block as rows of code points, and the number of them in each part."""
    data = np.frombuffer("".join(p for _, p in parts).encode("utf-32-le", "replace"), dtype="<u4")
    sizes = np.array([len(p) for _, p in parts])
    every = np.lib.stride_tricks.sliding_window_view(data, ORDER)
    begins = np.cumsum(sizes) - sizes
    inside = np.ones(len(data), dtype=bool)
    for k in range(1, ORDER):  # the last ORDER - 1 places of a part begin no n-gram
        inside[begins + sizes - k] = False
    return every[inside[: len(every)]], sizes - ORDER + 1


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order of appearance, the first place of each, and the number of each place's key."""
    at, found = pd.factorize(keys)
    first = np.empty(len(found), dtype=np.int64)
    first[at[::-1]] = np.arange(len(keys))[::-1]
    return found, first, at


def count_ngrams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of all 5-grams of all texts; docs has columns lang and text, not null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def merge() -> int:
            for lang, lists in held.items():
                keys, grams, n = (np.concatenate([x[i] for x in lists]) for i in range(3))
                found, first, at = distinct(keys)
                held[lang] = [(found, grams[first], np.bincount(at, weights=n).astype(np.int64))]
            return sum(len(x[0][0]) for x in held.values())

        def out() -> Iterator[pa.RecordBatch]:
            for lang, ((_, grams, n),) in held.items():
                text = grams.astype("<u4").tobytes().decode("utf-32-le", "replace")
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), type=pa.string()), pa.array([text[k : k + ORDER] for k in range(0, len(text), ORDER)], type=pa.string()), pa.array(n)], names=["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            langs, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in dict.fromkeys(langs):
                for parts in pieces([v for m, v in zip(langs, values, strict=True) if m == lang]):
                    grams, _ = windows(parts)
                    found, first, at = distinct(hashed(grams, np.uint64(0), 0))
                    held.setdefault(lang, []).append((found, grams[first], np.bincount(at)))
                    size += len(found)
                    if size > 2 * HELD:
                        size = merge()
                        if size > HELD:
                            yield from out()
                            size = 0
        merge()
        yield from out()

    return docs.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("c"))


def discounted(level: DataFrame) -> DataFrame:
    """level (lang, gram, c) with cut: the modified Kneser-Ney discount for counts of 1, 2 and 3 or more."""
    n = [F.count_if(F.col("c") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    usable = F.least("n1", "n2", "n3", "n4") > 0

    def step(k: int, usual: float) -> Column:
        return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(k - 0.01), k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")))).otherwise(F.lit(usual))

    steps = level.groupBy("lang").agg(*n).select("lang", *[step(k, d).alias(f"d{k}") for k, d in ((1, 0.5), (2, 0.75), (3, 0.9))])
    return level.join(by_language(steps), "lang").select("lang", "gram", "c", F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3")).alias("cut"))


def by_language(rows: DataFrame) -> DataFrame:
    """A table of one row per language, to be broadcast if it is checked to be small: most rows share a language."""
    small = staged(rows, "perplexity-languages")  # so that they are not made again to be counted
    return F.broadcast(small) if small.count() <= MOST_LANGUAGES else small


def train(docs: DataFrame) -> DataFrame:
    """(hash, value): natural log probabilities of n-grams and log back-off weights of contexts, all languages.

    docs has columns lang and text, not null. Every order is a table; nothing is gathered.
    """
    levels = {ORDER: staged(count_ngrams(docs), "perplexity-counts")}
    for k in range(ORDER - 1, 0, -1):  # lower orders count the distinct code points to the left
        shorter = levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("c"))
        levels[k] = staged(shorter, f"perplexity-{k}")
    flat = levels[1].groupBy("lang").agg((1 / (F.count(F.lit(1)) + 1)).alias("below"))  # order 0: uniform, with one unseen
    entries = [flat.select("lang", F.lit("").alias("gram"), F.lit(0).alias("tag"), F.log("below").alias("value"))]
    lower = flat
    for k in range(1, ORDER + 1):
        cut = discounted(levels[k]).withColumns({"context": F.substring("gram", 1, k - 1), "suffix": F.substring("gram", 2, k - 1)})
        has_entry = F.col("c") >= (LEAST_COUNT if k == ORDER else 1)
        used = F.sum(F.when(has_entry, F.col("c") - F.col("cut")).otherwise(F.lit(0.0)))
        totals = cut.groupBy("lang", "context").agg(F.sum("c").alias("total"), used.alias("used"))
        back = F.greatest(1 - F.col("used") / F.col("total"), F.lit(1e-9))
        known = cut.where(has_entry).join(totals.select("lang", "context", "total", back.alias("back")), ["lang", "context"])
        p = (F.col("c") - F.col("cut")) / F.col("total") + F.col("back") * F.col("below")
        known = known.join(lower, ["lang"] if k == 1 else ["lang", "suffix"]).select("lang", "gram", "context", "back", p.alias("p"))
        known = staged(known, f"perplexity-p-{k}")
        lower = known.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
        # a context without entries has the weight 1, as one that was never seen
        contexts = known.groupBy("lang", "context").agg(F.first("back").alias("back"))
        entries += [known.select("lang", "gram", F.lit(k).alias("tag"), F.log("p").alias("value")), contexts.select("lang", F.col("context").alias("gram"), F.lit(k + 8).alias("tag"), F.log("back").alias("value"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, grams, tags = (batch.column(i).to_pylist() for i in range(3))
            code = np.zeros(len(langs), dtype=np.uint64)
            groups: dict[tuple[str, int], list[int]] = {}
            for row, key in enumerate(zip(langs, tags, strict=True)):
                groups.setdefault(key, []).append(row)
            for (lang, tag), rows in groups.items():
                width = tag - 9 if tag > 8 else tag
                flat_ = np.frombuffer("".join(grams[r] for r in rows).encode("utf-32-le", "replace"), dtype="<u4")
                code[rows] = hashed(flat_.reshape(len(rows), width), language_seed(lang), tag)
            yield pa.RecordBatch.from_arrays([pa.array(code.view(np.int64)), batch.column(3).cast(pa.float32())], names=["hash", "value"])

    every = entries[0]
    for e in entries[1:]:
        every = every.unionByName(e)
    return staged(every.mapInArrow(run, "hash long, value float"), "perplexity-entries")


def shards(entries: DataFrame) -> tuple[DataFrame, int, int]:
    """(shard, keys, numbers) with sorted arrays, how many leading bits name a shard, and the number of entries."""
    n = entries.count()
    bits = max(0, (n // SHARD_ENTRIES).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, numbers = None, [], []

        def out() -> pa.RecordBatch:
            k, v = np.concatenate(keys).view(np.uint64), np.concatenate(numbers)
            at = np.argsort(k)
            return pa.RecordBatch.from_arrays([pa.array([shard], type=pa.int64()), pa.array([k[at].tobytes()], type=pa.binary()), pa.array([v[at].astype(np.float32).tobytes()], type=pa.binary())], names=["shard", "keys", "numbers"])

        for batch in batches:
            own = batch.column(0).to_numpy()
            for at in np.split(np.arange(len(own)), np.flatnonzero(np.diff(own)) + 1):
                if not len(at):
                    continue
                if keys and own[at[0]] != shard:
                    yield out()
                    keys.clear()
                    numbers.clear()
                shard = int(own[at[0]])
                keys.append(batch.column(1).to_numpy()[at])
                numbers.append(batch.column(2).to_numpy()[at])
        if keys:
            yield out()

    dealt = entries.select(shard_of(F.col("hash"), bits).alias("shard"), "hash", "value").repartition(1 << bits, "shard").sortWithinPartitions("shard")
    return staged(dealt.mapInArrow(run, "shard long, keys binary, numbers binary"), "perplexity-shards"), bits, n


def shard_of(code: Column, bits: int) -> Column:
    return F.shiftrightunsigned(code, 64 - bits) if bits else F.lit(0).cast("long")


def lookup(keys: np.ndarray, numbers: np.ndarray) -> Lookup:
    def find(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(keys):
            return np.zeros(len(wanted), dtype=np.float32), np.zeros(len(wanted), dtype=bool)
        order = np.argsort(wanted)  # sorted requests walk the array once
        at = np.empty(len(wanted), dtype=np.int64)
        at[order] = np.minimum(np.searchsorted(keys, wanted[order]), len(keys) - 1)
        return numbers[at], keys[at] == wanted

    return find


def log_probability(grams: np.ndarray, seed: np.uint64, find: Lookup) -> np.ndarray:
    """Of the last code point of each 5-gram after the four before it: the longest n-gram with an entry counts."""
    out = np.zeros(len(grams))
    open_ = np.arange(len(grams))
    for k in range(ORDER, 0, -1):
        value, hit = find(hashed(grams[open_, ORDER - k :], seed, k))
        out[open_[hit]] += value[hit]
        open_ = open_[~hit]
        if not len(open_):
            return out
        value, hit = find(hashed(grams[open_, ORDER - k : -1], seed, k + 8))  # an unseen context falls back without a price
        out[open_[hit]] += value[hit]
    value, hit = find(hashed(grams[:1, :0], seed, 0))
    out[open_] += value[0] if hit[0] else np.log(1e-6)
    return out


def text_scores(langs: list[str], values: list[str], find: Lookup) -> np.ndarray:
    """Negative log probability of each whole text and its end."""
    sums = np.zeros(len(values))
    for lang in dict.fromkeys(langs):
        mine = [k for k, m in enumerate(langs) if m == lang]
        for parts in pieces([values[k] for k in mine]):
            grams, sizes = windows(parts)
            _, first, at = distinct(hashed(grams, np.uint64(0), 0))
            total = np.concatenate(([0.0], np.cumsum(log_probability(grams[first], language_seed(lang), find)[at])))
            for (row, _), s in zip(parts, np.diff(total[np.concatenate(([0], np.cumsum(sizes)))]), strict=True):
                sums[mine[row]] -= s
    return sums


def requests(langs: list[str], values: list[str]) -> np.ndarray:
    """Distinct hashes that text_scores() may ask for, sorted."""
    found: list[np.ndarray] = []
    for lang in dict.fromkeys(langs):
        seed = language_seed(lang)
        for parts in pieces([v for m, v in zip(langs, values, strict=True) if m == lang]):
            grams, _ = windows(parts)
            grams = grams[distinct(hashed(grams, np.uint64(0), 0))[1]]
            found += [np.unique(hashed(grams[:, ORDER - k : end], seed, tag)) for k in range(1, ORDER + 1) for end, tag in ((ORDER, k), (ORDER - 1, k + 8))]
            found.append(hashed(grams[:1, :0], seed, 0))
            if sum(map(len, found)) > HELD:
                found = [np.unique(np.concatenate(found))]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def rule_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = text.split()
    # every code point has one byte that is no continuation byte
    chars = sum(map(len, words)) - len(text.translate(None, _NOT_CONTINUATION))
    symbols = len(text) - len(text.translate(None, bytes(SYMBOL_BYTES)))
    seen, dup = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip(b" \t\r\x0b\x0c"):
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        times, last = Counter(windows), -1
        for i, w in enumerate(windows):
            if times[w] > 1:  # words i to i + 2, less those that an earlier window has counted
                repeated += i + 2 - max(last, i - 1)
                last = i + 2
    return len(words), chars, symbols, dup, repeated


_NOT_CONTINUATION = bytes(b for b in range(256) if not 0x80 <= b < 0xC0)


def judge_texts(batch: list[pa.Array], find: Lookup) -> pa.RecordBatch:
    """Rule counts and log perplexity per word of a batch of (doc_id, lang, text)."""
    langs, values = batch[1].to_pylist(), batch[2].to_pylist()
    rules = np.array([rule_counts(v.encode("utf-8", "replace")) for v in values], dtype=np.int64).reshape(-1, 5)
    return pa.RecordBatch.from_arrays([batch[0], batch[1], *[pa.array(rules[:, i]) for i in range(5)], pa.array(text_scores(langs, values, find) / np.maximum(rules[:, 0], 1))], names=["doc_id", "lang", *RULES, "log_perplexity"])


RULES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, lang, RULES, log_perplexity) of rows (doc_id, lang, text) under a trained model's entries."""
    packed, bits, n = shards(entries)
    fields = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, {', '.join(f'{c} long' for c in RULES)}, log_perplexity double"
    if n * ENTRY <= BROADCAST_BYTES:  # the size is checked
        arrays = sorted(packed.collect(), key=lambda r: r["shard"])
        keys = np.concatenate([np.frombuffer(r["keys"], dtype=np.uint64) for r in arrays] or [np.zeros(0, dtype=np.uint64)])
        numbers = np.concatenate([np.frombuffer(r["numbers"], dtype=np.float32) for r in arrays] or [np.zeros(0, dtype=np.float32)])
        model = rows.sparkSession.sparkContext.broadcast((keys, numbers))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            find = lookup(*model.value)
            for batch in batches:
                yield judge_texts(batch.columns, find)

        return rows.mapInArrow(run, fields)
    # blocks of bounded rows and bytes; their two uses share one exchange, and texts are written nowhere else
    size = rows.agg(F.count(F.lit(1)).alias("texts"), F.sum(F.octet_length("text")).alias("bytes")).first()  # one row
    blocks = max(1, -(-size["texts"] // BLOCK_TEXTS), -(-(size["bytes"] or 0) // BLOCK_TEXT_BYTES))
    placed = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(blocks)).cast("long"))

    def ask(group: pa.Table) -> pa.Table:
        wanted = requests(group.column("lang").to_pylist(), group.column("text").to_pylist())
        own = wanted >> np.uint64(64 - bits) if bits else np.zeros(len(wanted), dtype=np.uint64)
        cuts = np.split(wanted, np.flatnonzero(np.diff(own)) + 1)
        return pa.table({"shard": pa.array([int(x[0] >> np.uint64(64 - bits)) if bits else 0 for x in cuts if len(x)], type=pa.int64()), "block": pa.array([group.column("block")[0].as_py()] * sum(1 for x in cuts if len(x)), type=pa.int64()), "wanted": pa.array([x.tobytes() for x in cuts if len(x)], type=pa.binary())})

    asked = placed.groupBy("block").applyInArrow(ask, "shard long, block long, wanted binary")
    # the shard's arrays come first, then one request after another passes by
    both = packed.select("shard", F.lit(-1).cast("long").alias("block"), "keys", "numbers").unionByName(asked.select("shard", "block", F.col("wanted").alias("keys"), F.lit(None).cast("binary").alias("numbers")))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = None
        for batch in batches:
            for block, keys, numbers in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)], strict=True):
                wanted = np.frombuffer(keys, dtype=np.uint64)
                if block < 0:
                    find = lookup(wanted, np.frombuffer(numbers, dtype=np.float32))
                    continue
                value, hit = find(wanted) if find else (np.zeros(0), np.zeros(len(wanted), dtype=bool))
                yield pa.RecordBatch.from_arrays([pa.array([block], type=pa.int64()), pa.array([wanted[hit].tobytes()], type=pa.binary()), pa.array([value[hit].astype(np.float32).tobytes()], type=pa.binary())], names=["block", "keys", "numbers"])

    # a shard that no entry has answers nothing; each partition holds one shard's requests
    answers = both.repartition(1 << bits, "shard").sortWithinPartitions("shard", "block").mapInArrow(answer, "block long, keys binary, numbers binary")

    def judge(_, texts_: pa.Table, answered: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in answered.column("keys").to_pylist()] or [np.zeros(0, dtype=np.uint64)])
        numbers = np.concatenate([np.frombuffer(x, dtype=np.float32) for x in answered.column("numbers").to_pylist()] or [np.zeros(0, dtype=np.float32)])
        at = np.argsort(keys)
        columns = [texts_.column(c).combine_chunks() for c in ("doc_id", "lang", "text")]
        return pa.Table.from_batches([judge_texts(columns, lookup(keys[at], numbers[at]))])

    return placed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(judge, fields)


def perplexity_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = BELOW, above: float = ABOVE) -> DataFrame:
    """Per row: rule counts, base_failed, log_perplexity (per word), kept and the bounds of the band.

    kept needs base_failed to be false and the log perplexity under the language's model to lie within the
    language's band [m - below * s / sqrt(n), m + above * s / sqrt(n)], where n is the number of words, m the
    median of the texts of that language that pass the base rules, and s the robust standard deviation of
    their (log_perplexity - m) * sqrt(n): the mean over a longer text varies less. Every language has its own model and bands, whatever its share of the rows;
    texts with a null language share those of the empty name. Null texts are empty: no words, so base_failed.
    Medians and quantiles are exact up to 10,000 texts of a language; beyond, their rank is off by a ten-thousandth at most
    and may depend on the order of arrival, so texts right at the border of a band may be judged otherwise in another run.
    Repeated rows and ids are judged one by one; an empty table gives an empty result; other columns are not
    read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scored = staged(score(rows, train(rows.select("lang", "text"))), "perplexity")
    scored = scored.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    root = F.sqrt(F.greatest("n_words", F.lit(1)))
    passing = scored.where(~F.col("base_failed"))
    middle = by_language(passing.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10000).alias("middle")))
    away = passing.join(middle, "lang").groupBy("lang", "middle").agg(F.percentile_approx((F.col("log_perplexity") - F.col("middle")) * root, [0.16, 0.84], 10000).alias("q"))
    spread = (F.element_at("q", 2) - F.element_at("q", 1)) / 2
    bands = away.select("lang", "middle", F.when(spread > 0, spread).otherwise(F.lit(EQUAL_SPREAD)).alias("spread"))
    judged = scored.join(by_language(bands), "lang", "left")
    judged = judged.withColumns({"low": F.col("middle") - below * F.col("spread") / root, "high": F.col("middle") + above * F.col("spread") / root})
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True))
    return judged.select("doc_id", *RULES, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "log_perplexity", "low", "high")
