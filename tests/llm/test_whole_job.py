"""The llm operators where a bound of their working memory lies inside the data."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechloom.llm import common, decontaminate, editcount, packing, personal, queries
from speechloom.llm.common import BLOCK_BYTES


@pytest.mark.parametrize("share", [0.25, 0.5, 0.8])
def test_leaks_across_a_block_are_found(spark, share):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    question, answer = [word() for _ in range(60)], [word() for _ in range(30)]
    item = f"{' '.join(question)}? {' '.join(answer)}."
    filler = " ".join("x" + word() for _ in range(BLOCK_BYTES // 8 + 1))  # eight bytes a word
    front = filler[: BLOCK_BYTES - int(share * len(item))]
    docs = spark.createDataFrame([(1, f"{front} {item} {filler[:50_000]}"), (2, filler), (3, f"{filler[:999]} {item}")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, " ".join(word() for _ in range(80)))], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.find_leaks(docs, items).collect()}
    assert set(found) == {1, 3}
    assert found[1]["question_share"] == found[1]["answer_share"] == 1.0


def test_rare_patterns_are_learned_beside_many_candidates(spark, monkeypatch):
    known = [f"account key user{k}@mail{k}.org today " for k in range(14)]
    logs = spark.range(170).select(F.repeat(F.lit("log at 1234567 "), 10_000).alias("text"))  # 1.7 million candidates
    rare = spark.createDataFrame([(t,) for t in [*known, "account key ZX81-77Q today", "our code ab12cd and our code ab12ce and our code ab12cf"]], "text string")
    docs = logs.unionByName(rare)
    assert personal.learn_patterns(docs).keys() == {"account key"}
    learned = personal.learn_patterns(rare)
    monkeypatch.setattr(personal, "HELD_PAIRS", 1)
    monkeypatch.setattr(personal, "FILTER_RANGES", 2)
    monkeypatch.setattr(common, "HEAVY", 4)
    assert learned.keys() == {"account key"} and personal.learn_patterns(rare) == learned


def test_pattern_totals_equal_plain_counting(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["aa", "Bb", "cc", "dd", "ee"]) for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", "aa bb"]
    wanted = ["aa bb", "cc cc", "ee dd", "zz zz"]
    hashes = spark.createDataFrame([(w, int(personal.pattern_hashes([w]).view("int64")[0])) for w in wanted], "pattern string, hash long")
    found = personal.occurrences(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), hashes).join(hashes, "hash")
    want = {}
    for t in texts:
        words = (t or "").lower().split()
        for pair in zip(words, words[1:], words[2:], strict=False):
            want[" ".join(pair[:2])] = want.get(" ".join(pair[:2]), 0) + 1
    assert {r["pattern"]: r["total"] for r in found.collect()} == {w: want[w] for w in wanted if w in want}


def test_confidences_equal_a_plain_version(spark, monkeypatch):
    rng = random.Random(4)
    lines = []
    for k in range(400):
        pattern = rng.choice(["account key", "ticket number", "see page", "our code"])
        core = f"u{rng.randint(0, 40)}@mail.org" if rng.random() < {"account key": 0.9, "ticket number": 0.6, "see page": 0.05, "our code": 0.3}[pattern] else f"{rng.choice('XYZ')}{rng.randint(0, 30)}-77Q"
        lines.append(f"{pattern} {core} then")
    docs = spark.createDataFrame([(x,) for x in lines], "text string")
    monkeypatch.setattr(personal, "MIN_CONFIDENCE", 0.0)
    got = personal.learn_patterns(docs)
    edges, totals = {}, {}
    for text in lines:
        spans = personal.Spans(personal.base_spans(text))
        for pattern, start, end, core in personal.candidates(text):
            e = edges.setdefault((pattern, core), [False, 0])
            e[0] |= spans.overlap(start, end)
            e[1] += 1
        w = text.lower().split()
        for i in range(len(w) - 2):
            totals[f"{w[i]} {w[i + 1]}"] = totals.get(f"{w[i]} {w[i + 1]}", 0) + 1
    support = {p: sum(q == p for q, _ in edges) for p, _ in edges}
    edges = {k: v for k, v in edges.items() if support[k[0]] >= personal.MIN_INSTANCES}
    known = {c: max(float(v[0]) for (_, d), v in edges.items() if d == c) for _, c in edges}
    score = dict(known)
    for _ in range(personal.ROUNDS):
        sure = {}
        for p in {p for p, _ in edges}:
            mine = [(c, v[1]) for (q, c), v in edges.items() if q == p]
            if sum(score[c] > 0.5 for c, _ in mine) >= personal.MIN_INSTANCES:
                sure[p] = min(1.0, sum(score[c] * n for c, n in mine) / (totals[p] + 2))
        score = {c: max(known[c], *[sure.get(p, 0.0) for p, d in edges if d == c]) for c in known}
    assert got.keys() == sure.keys() and all(abs(got[p] - sure[p]) < 1e-9 for p in sure) and len(sure) > 1


def test_documents_are_packed_under_three_limits(spark):
    docs = spark.createDataFrame([(k, " ".join(["word"] * (1 + k % 90))) for k in range(180)], "doc_id long, text string")
    sequences = {}
    for r in packing.pack_documents(docs, queries.tokenizer_file(), capacity=64, max_segments=3, max_loss=40).collect():
        sequences.setdefault(r["sequence_id"], []).append(r["length"])
    assert all(sum(s) <= 64 and len(s) <= 3 and sum(s) - len(s) <= 40 for s in sequences.values())
    assert max(map(len, sequences.values())) == 3 and max(sum(s) - len(s) for s in sequences.values()) == 40


def test_sums_are_kept_and_only_edited_rows_change(spark, monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(editcount, "LEAF", 4)
    ranks, pattern = queries.tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = [(1, "one two three four five six seven eight nine ten. " * 9), (2, "left alone " * 30), (3, ""), (4, None), (None, "no id"), (2, "left alone")]
    state = editcount.build_state(spark.createDataFrame(rows, "doc_id long, text string"), ranks, pattern)
    put = [(1, 1, 200, 9, "x " * 40), (1, 2, 0, 3, ""), (3, 1, 0, 0, "new text"), (4, 1, 3, 1, "é")]
    edits = spark.createDataFrame(put, "id long, seq int, pos long, deleted long, inserted string")
    out = editcount.apply_edits(editcount.attach_edits(state, edits), ranks, pattern)
    before, after = ({(r["id"], r["text"]): r for r in df.collect()} for df in (state, out))
    for r in after.values():
        sizes, sums = np.frombuffer(r["leaf_pieces"], "<i4"), np.frombuffer(r["node_sums"], "<i8").reshape(2, -1)
        assert sizes.sum() * 4 == len(r["piece_chars"]) == len(r["piece_tokens"])
        for heap, name in zip(sums, ("piece_chars", "piece_tokens"), strict=True):
            pieces, width = np.frombuffer(r[name], "<i4"), len(heap) // 2
            leaves = [int(x.sum()) for x in np.split(pieces, np.cumsum(sizes)[:-1])]
            assert heap[width : width + len(leaves)].tolist() == leaves and not heap[width + len(leaves) :].any()
            assert all(heap[k] == heap[2 * k] + heap[2 * k + 1] for k in range(1, width))
        assert sums[0, 1] == len(r["text"]) and sums[1, 1] == r["n_tokens"]
        if r["n_edits"] == 0:
            assert all(before[r["id"], r["text"]][c] == r[c] for c in state.columns) and r["encoded_pieces"] == 0
    again = editcount.apply_edits(editcount.attach_edits(out.select(*state.columns), edits), ranks, pattern).collect()
    own = editcount.counter(ranks, pattern)
    assert len(again) == 6 and all(r["n_tokens"] == sum(own.counts(own.split(r["text"]))) for r in again)


def test_an_edit_reads_few_leaves():
    import public_tokenizers

    own = editcount.counter(queries.tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = "word " * 200_000
    pieces = own.split(text)
    tree = editcount.PieceTree(text, [len(p) for p in pieces], own.counts(pieces))
    tree.edit(own, 500_000, 3, "new")
    assert sum(not isinstance(x, int) for x in tree.leaves) <= 4


def edited(rng, text, share):
    """The text with a share of its words replaced."""
    words = text.split()
    for k in rng.sample(range(len(words)), round(share * len(words))):
        words[k] = "other" + words[k][:3].lower()
    return " ".join(words)


@pytest.mark.parametrize(("segments", "share"), [(None, 0.05), ((2, 8), 0.05), (None, 0.1)])
def test_edited_items_are_found_whatever_the_shards(spark, monkeypatch, segments, share):
    if segments:
        monkeypatch.setattr(decontaminate, "SHARD_SEGMENTS", segments[0])
        monkeypatch.setattr(decontaminate, "PASS_SEGMENTS", segments[1])
    rng = random.Random(23)
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text")
    long = (10_000, " ".join(f"long{k} item{k % 7}" for k in range(150)) + "? " + " ".join(f"reply{k}" for k in range(60)) + ".")  # several segments
    listed = [*map(tuple, items.collect()), long]
    filler = lambda n: " ".join("fill" + "".join(rng.choices("abcdef", k=4)) for _ in range(n))
    rows = [(i, f"{filler(rng.randint(0, 150))} {edited(rng, t, share)} {filler(60)}") for i, t in listed] + [(-1, filler(400))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = decontaminate.find_leaks(docs, spark.createDataFrame(listed, "item_id long, text string")).collect()
    assert len({(r["doc_id"], r["item_id"]) for r in found}) == len(found)
    hits = {r["doc_id"] for r in found if r["doc_id"] == r["item_id"]}
    assert -1 not in {r["doc_id"] for r in found} and 10_000 in hits
    assert len(hits) >= 0.9 * len(listed)


def test_examples_are_packed_across_batches(spark):
    rng = random.Random(6)
    rows = [(k if k % 50 else None, rng.choice([None, 5, 100, 500]), rng.choice([None, 0, 90, 250])) for k in range(6000)]
    df = spark.createDataFrame(rows, "example_id long, n_tokens long, n_loss long").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = packing.pack_examples(df, capacity=1024, max_segments=6, max_loss=512).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 512)
    assert sorted((str(r["id"]), r["n_tokens"], r["n_loss"]) for r in got) == sorted((str(i), t or 0, n or 0) for i, t, n in rows)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["n_tokens"], 1, r["n_loss"]))
    sums = [tuple(map(sum, zip(*b, strict=True))) for b in bins.values()]
    assert all(t <= 1024 and s <= 6 and n <= 512 for t, s, n in sums)
    # each limit acts, and no more bins are open than one for each block of examples
    assert any(s == 6 for _, s, _ in sums) and any(n > 480 for _, _, n in sums) and any(t > 1000 for t, _, _ in sums)
    least = max(sum(t or 0 for _, t, _ in rows) / 1024, len(rows) / 6, sum(n or 0 for _, _, n in rows) / 512)
    assert len(bins) <= 1.25 * least + 3
