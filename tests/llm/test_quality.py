"""The quality classifier against a plain version of its features, training and scores; URL rules beyond a broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechloom.llm import quality, queries, urlrules
from speechloom.llm.common import mix, word_hashes


def plain_bag(text):
    """Share of each bucket: words, words that repeat the one before, n-grams that no white space divides."""
    framed = b" " + bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()) + b" "
    space = b" \t\n\v\f\r"
    out, last = [], None
    for w in framed.split():
        code = int(word_hashes(np.frombuffer(w, dtype=np.uint8))[0][0])
        out += [code % quality.BUCKETS] + [quality.AGAIN] * (w == last)
        last = w
    for n in quality.NGRAMS:
        for i in range(len(framed) - n + 1):
            gram = framed[i : i + n]
            if not any(c in space for c in gram[1:-1]):
                code = n
                for c in gram:
                    code = (code << 8 | c) % (1 << 64)
                out.append(int(mix(np.array([code], dtype=np.uint64))[0]) % quality.BUCKETS)
    bag = {}
    for b in out:
        bag[b] = bag.get(b, 0) + 1 / len(out)
    return bag


def plain_model(bags, labels, seed=7):
    """Stochastic gradient descent on the mean of a bag's vectors and a softmax, one value at a time."""
    draw = np.random.default_rng(seed)
    vectors = (draw.random((quality.BUCKETS, quality.DIM), dtype=np.float32) - 0.5) / quality.DIM
    layer, bias = np.zeros((quality.DIM, 2)), np.zeros(2)
    done, total = 0, quality.EPOCHS * len(labels)
    for _ in range(quality.EPOCHS):
        for k in draw.permutation(len(labels)):
            hidden = sum((s * vectors[b].astype(float) for b, s in bags[k].items()), np.zeros(quality.DIM))
            odds = [sum(hidden[i] * layer[i][c] for i in range(quality.DIM)) + bias[c] for c in (0, 1)]
            p = np.exp(np.array(odds) - max(odds))
            p /= p.sum()
            p[labels[k]] -= 1
            rate = quality.RATE * (1 - done / total)
            back = layer @ p
            for i in range(quality.DIM):
                for c in (0, 1):
                    layer[i][c] -= rate * hidden[i] * p[c]
            bias -= rate * p
            for b, s in bags[k].items():
                vectors[b] -= rate * min(len(bags[k]), 50) * s * back
            done += 1
    return lambda bag: 1 / (1 + np.exp(-(sum(s * float(vectors[b] @ (layer[:, 1] - layer[:, 0])) for b, s in bag.items()) + bias[1] - bias[0])))


def test_scores_equal_a_plain_version(spark):
    good = ["The quick brown fox runs over the hill", "A calm river flows by the old mill", "They read books in the quiet garden", "Rain fell on the green fields today"]
    bad = ["buy now now now !!! $$$ win", "click click here here $$$ free", "xx xx xx zz zz free win", "win win $$$ !!! buy buy"]
    rows = [(k, t, k % 2) for k, t in enumerate(x for pair in zip(good, bad, strict=True) for x in pair)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - n) for k, _, n in rows], "doc_id long, quality int")
    model = quality.fit(quality.sample_labelled(docs, labels, F.lit(True), 100, "quality"))
    new = ["", None, "A quiet river by the garden", "FREE free win $$$", "word " * 300, "\t\n", *good]
    got = {r["doc_id"]: r["score"] for r in quality.score_quality(spark.createDataFrame(list(enumerate(new)), "doc_id long, text string"), *model).collect()}
    known = sorted((k, t, 1 - n) for k, t, n in rows)
    plain = plain_model([plain_bag(t) for _, t, _ in known], [n for *_, n in known])
    for k, t in enumerate(new):
        assert abs(got[k] - plain(plain_bag(t))) < 1e-4, t
    assert got[2] > got[3]


def test_training_needs_both_labels():
    weights, bias = quality.train([(np.array([1]), np.array([1.0], dtype=np.float32))] * 3, np.array([1, 1, 1]))
    assert not weights.any() and bias > 0


@pytest.mark.parametrize("limit", [0, 3])
def test_url_rules_without_a_broadcast(spark, sf, monkeypatch, limit):
    want = sorted(map(str, queries.op6_url_rules(spark, sf).collect()))
    monkeypatch.setattr(urlrules, "MAX_BROADCAST_RULES", limit)
    monkeypatch.setattr(urlrules, "SALTS", 1 + limit)
    assert sorted(map(str, queries.op6_url_rules(spark, sf).collect())) == want
