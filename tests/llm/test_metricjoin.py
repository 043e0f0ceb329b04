"""The exact Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from speechloom.llm import common, metricjoin, neardup

SCHEMA = "doc_id long, text string"


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def plain(rows, width, percent):
    """(doc_id, n_shingles, component_id) by all pairs."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def end(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    parent[end(i)] = end(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[end(i)] = min(least.get(end(i), d), d)
    return sorted((d, len(s), least[end(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True)))


def corpus(seed, families=12, alike=14, single=60):
    """Families of drifting variants at the edge of the limit, chains, a line that all share, texts of any length."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randint(0, 4000))
    rows = []
    for f in range(families):
        base = [word() for _ in range(rng.choice([5, 7, 9, 30, 80, 200]))]
        for _ in range(rng.randint(2, alike)):
            new = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                new[rng.randrange(len(new))] = word()
            rows.append(" ".join(new))
            if f % 3 == 0:
                base = new  # a chain: each variant of the one before
    line = " ".join(f"shared{k}" for k in range(40))
    rows += [" ".join(word() for _ in range(rng.randint(0, 90))) + (" " + line if k % 2 else "") for k in range(single)]
    rows += [rows[0], rows[0].upper(), "", None, " \n ", "one", "One", "two words"]
    rng.shuffle(rows)
    return [(10 * k + 3, t) for k, t in enumerate(rows)]


def found(spark, rows, width=4, percent=85):
    out = metricjoin.jaccard_components(spark.createDataFrame(rows, SCHEMA), width, percent).collect()
    return sorted(tuple(r) for r in out)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    rows = corpus(seed)
    assert found(spark, rows) == plain(rows, 4, 85)


def test_large_regions_and_heavy_groups(spark, monkeypatch):
    rows = corpus(5, families=4, alike=60, single=30)
    want = plain(rows, 4, 85)
    assert len({c for _, _, c in want}) < len(rows) - 40
    monkeypatch.setattr(metricjoin, "REGION", 6)
    monkeypatch.setattr(common, "HEAVY", 20)
    monkeypatch.setattr(neardup, "TILE", 8)
    monkeypatch.setattr(neardup, "SMALL_EDGES", 10)
    assert found(spark, rows) == want


def test_regions_in_a_task():
    for seed in range(30):
        rng = np.random.default_rng(seed)
        base = rng.choice(10_000, 60, replace=False).astype(np.uint64)
        sets = []
        for _ in range(90):
            s = base.copy()
            s[rng.integers(0, 60, rng.integers(0, 7))] = rng.integers(10_000, 99_999, 1)
            sets.append(np.unique(s))
            if rng.random() < 0.3:
                base = s
        rest = rng.random(90) < (1 if seed % 2 else 0.3)
        region = metricjoin.Region(sets, np.arange(90), rest, 85)
        region.join(np.arange(90))
        want = list(range(90))

        def end(x, parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i in range(90):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if (rest[i] or rest[j]) and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    want[end(i, want)] = end(j, want)
        got = list(range(90))
        for i, j in region.links:
            both = len(np.intersect1d(sets[i], sets[j]))
            assert 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both)
            got[end(i, got)] = end(j, got)
        # links between two of the others may be found as well, and join no more than they should
        for i in range(90):
            for j in range(i):
                assert end(i, want) != end(j, want) or end(i, got) == end(j, got)


def test_parities_bound_the_difference():
    rng = np.random.default_rng(2)
    for n, m in ((40, 45), (255, 257), (500, 520), (3000, 3500)):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate((x[: n * 9 // 10], rng.integers(0, 1 << 63, m - n * 9 // 10, dtype=np.uint64))))
        a, b = metricjoin.parities(x), metricjoin.parities(y)
        size = min(len(a), len(b))
        away = int(np.bitwise_count(metricjoin._fold_to(a, size) ^ metricjoin._fold_to(b, size)).sum())
        assert away <= len(np.setxor1d(x, y))
        sizes = np.array([len(x), len(y)])
        similar = metricjoin._parity_within([a, b], sizes, 85)(0, np.array([1]))[0]
        assert similar == metricjoin._parity_pairs([a], [b], sizes[:1], sizes[1:], 85)[0]


def test_window():
    for percent in (80, 85, 100):
        for n in range(1, 200):
            need = -(-percent * n // 100)
            partner = any(100 * min(n, m) >= percent * max(n, m) for m in (n + 1, n - 1) if m)
            assert metricjoin.window(n, percent) in ((n - need + 1,) if partner and percent * (n + 1) <= 100 * n else (0, n - need + 1))
            if partner and m_links(n, percent):
                assert metricjoin.window(n, percent) == n - need + 1


def m_links(n, percent):
    """Whether a set of n can be similar enough to another set at all."""
    return any(m != n and 100 * min(n, m) >= percent * max(n, m) for m in range(1, 2 * n + 2)) or 100 * (n - 1) >= percent * (n + 1)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "a b c d e f g h"), (3, "q r s t"), (4, "q R s T"), (None, "a b c d e f g h"), (5, "x " * 5000), (6, "y" * 70_000)]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in metricjoin.jaccard_components(spark.createDataFrame(rows, SCHEMA), 4, 85).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 5, 3), (3, 1, 3), (4, 1, 3), (5, 1, 5), (6, 1, 6)} <= got and len(got) == 8
    assert metricjoin.jaccard_components(spark.createDataFrame([], SCHEMA)).collect() == []
