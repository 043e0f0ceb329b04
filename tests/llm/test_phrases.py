"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechloom.llm import phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, n long"


def plain_counts(rows):
    counts, words = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    return counts, words


def plain(rows, least, percent, top):
    counts, words = plain_counts(rows)
    found = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least:
            cuts = [(2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            found[lang, p] = (score, a, counts[lang, p[:k]], counts[lang, p[k:]])

    def hidden(lang, p, a):
        return any(m == lang and len(q) > len(p) and 100 * found[m, q][1] >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q))) for m, q in found)

    out = []
    for lang in {lang for lang, _ in found}:
        mine = sorted((-s, -a, " ".join(p).encode(), l, r) for (m, p), (s, a, l, r) in found.items() if m == lang and not hidden(lang, p, a))
        out += [(lang, k, p.decode(), -a, l, r, words[lang], -s) for k, (s, a, p, l, r) in enumerate(mine[:top], 1)]
    return sorted(out)


def corpus(seed=3):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "tea", "b\0c", "b", "b\1", "é", "\x7f", "long" * 40, "long" * 40 + "er", "x"]
    rows = []
    for k in range(250):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", "\t", "  ", ", ", ".", "\n", "\v"]) for _ in range(rng.randint(0, 40)))
        if k % 3 == 0:
            text += "One and the same line of words, again and again"
        rows.append((k, text, rng.choice(["en", "en", "en", "de", None, "und", ""]), "clash", k))
    rows += [(900, None, "en", None, None), (901, "", None, None, None), (902, " \t\n.,", "fr", None, None), (903, "na " * 300, "xx", None, None), (904, "ba bo bi " * 200, "xx", None, None), (905, "ba bo bi " * 200, "xx", None, None), (None, "y" * 5000 + " z z z", None, None, None)]
    return rows


@pytest.mark.parametrize(("block", "held", "parts"), [(1 << 19, 1 << 20, 4), (64, 1 << 20, 13), (40, 50, 2)])
def test_phrases_equal_plain_counting(spark, monkeypatch, block, held, parts):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", block)
    monkeypatch.setattr(phrases, "HELD", held)
    rows = corpus(block)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        # values of a module do not reach the workers: the tasks are run here
        counts, words = plain_counts(rows)
        got = {(r["lang"], r["phrase"], r["k"]): r["n"] for r in phrases.phrase_counts(df.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text"), 5).collect()}
        want = {(lang, " ".join(p), len(p)): n for (lang, p), n in counts.items() if n >= 5} | {(lang, "", 0): n for lang, n in words.items() if n}
        assert got == want
        found = phrases.collocations(df, least=5, percent=80, top=40).collect()
        assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found) == plain(rows, 5, 80, 40)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_blocks_lose_nothing(monkeypatch):
    rows = corpus()
    texts = [(r[1] or "").encode() for r in rows]
    want = Counter()
    for b in phrases.parts(texts):
        want.update(phrases.block_phrases(b, {}).to_pylist())
    for size in (30, 100, 333):
        monkeypatch.setattr(phrases, "BLOCK_BYTES", size)
        got, tails = Counter(), {}
        for b in phrases.parts(texts):
            got.update(phrases.block_phrases(b, tails).to_pylist())
        assert got == want and not tails


def test_shared_bytes():
    rng = random.Random(4)
    for _ in range(50):
        given = sorted("".join(rng.choice("ab") for _ in range(rng.choice([0, 3, 70, 200]))).encode() for _ in range(30))
        offsets = np.concatenate(([0], np.cumsum([len(g) for g in given])))
        data = np.frombuffer(b"".join(given) + b"\0", dtype=np.uint8)
        import os

        assert phrases.shared_bytes(data, offsets).tolist() == [len(os.path.commonprefix([a, b])) for a, b in zip(given, given[1:], strict=False)]


def test_unary_paths(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PATH_EDGES", 7)
    chain = [f"w{k} w{k + 1} w{k + 2} w{k + 3}" for k in range(20)]
    branch = ["w5 w6 w7 v", "w6 w7 v u", "p w10 w11 w12"]
    cycle = ["a b c d", "b c d e", "c d e a", "d e a b", "e a b c"]
    loop = ["na na na na"]
    edges = spark.createDataFrame([("en", e, 10 + k) for k, e in enumerate(chain + branch + cycle + loop)], "lang string, phrase string, n long")
    paths = phrases.unary_paths(edges).collect()
    found = Counter()
    for r in paths:
        assert len(r["words"]) == len(r["weights"]) + 3 and len(r["weights"]) <= 7
        for i, n in enumerate(r["weights"]):
            found[" ".join(r["words"][i : i + 4]), n] += 1
    assert found == Counter((e, 10 + k) for k, e in enumerate(chain + branch + cycle + loop))
    rows = {" ".join(r["words"]) for r in paths}
    assert "w0 w1 w2 w3 w4 w5 w6 w7" in rows  # up to the branch behind w5 w6 w7
    assert "w5 w6 w7 v u" in rows and "na na na na" in rows and len(rows) == 8
    assert sum(set(r["words"]) == set("abcde") and len(r["words"]) == 8 for r in paths) == 1


def test_empty(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None, "", 1), (2, "one two", "en", "", 1)], SCHEMA)).collect() == []
