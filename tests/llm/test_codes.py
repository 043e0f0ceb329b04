"""Vector codes against a plain loop."""

import hashlib
import math

import numpy as np
import pytest

from speechloom.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string"


def plain(rows, parts, entries, rounds):
    """(vec_id, code, error) of kept rows, and the codebooks' digest."""
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]

    def assign(v):
        return [min((sum((a - b) ** 2 for a, b in zip(cut(v, p), e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(parts)]

    for _ in range(rounds):
        own = [assign(v) for _, v, _ in kept]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v, p) for (_, v, _), a in zip(kept, own, strict=True) if a[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
        books = [[list(e) for e in b] for b in books]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        a = assign(v)
        out.append((i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), label))
    totals = {}
    for _, _, e, label in out:
        totals[label] = totals.get(label, 0) + e
    return sorted(((i, c, e, totals[label]) for i, c, e, label in out), key=str), digest


def vectors():
    rng = np.random.default_rng(5)
    rows = [(int(k), [float(x) for x in rng.normal(0, 0.3, 8).astype(np.float32)], int(k % 3), "clash") for k in range(60)]
    rows += [(k, rows[0][1], None, "clash") for k in range(60, 90)]  # copies of one vector
    rows += [(7, [0.25] * 8, 1, "again"), (7, [0.25] * 8, 1, "again"), (None, [-3.0] * 8, None, None)]
    nan, inf = float("nan"), float("inf")
    rows += [(100, None, 1, ""), (101, [0.5] * 7 + [None], 1, ""), (-5, [nan] * 8, 1, ""), (-6, [inf] + [0.0] * 7, 2, ""), (103, [], 2, ""), (104, [0.1] * 6, 2, "")]
    return rows


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 16, 2), (2, 64, 2), (8, 3, 1), (1, 200, 2)])
def test_codes_equal_a_plain_loop(spark, parts, entries, rounds):
    rows = vectors()
    got = codes.vector_codes(spark.createDataFrame(rows, SCHEMA), parts, entries, rounds).collect()
    want, digest = plain(rows, parts, entries, rounds)
    assert sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got), key=str) == want
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_no_vector_no_code(spark):
    assert codes.vector_codes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert codes.vector_codes(spark.createDataFrame([(1, None, 1, "")], SCHEMA)).collect() == []


def test_what_cannot_be_coded(spark):
    with pytest.raises(ValueError, match="equal parts"):
        codes.vector_codes(spark.createDataFrame([(1, [0.0] * 6, 1, "")], SCHEMA), parts=4)
    with pytest.raises(Exception, match="components must lie"):
        codes.vector_codes(spark.createDataFrame([(1, [1e6] * 4, 1, "")], SCHEMA), parts=4).collect()


def test_bounds_prune_and_hold():
    rng = np.random.default_rng(1)
    centres = rng.integers(-4000, 4000, (3, 40, 4))
    own = centres[np.arange(3), rng.integers(0, 40, (500, 3))] + rng.integers(-30, 30, (500, 3, 4))
    pivots = codes.choose_pivots(centres, codes.PIVOTS)
    away = codes.roots(codes.squares(own[:, :, None], pivots[None]))
    code, error, evaluated = codes.Assigner(centres, pivots).nearest(own, away)
    every = codes.squares(own[:, :, None], centres[None])
    assert (code == every.argmin(axis=2)).all() and (error == every.min(axis=2)).all()
    assert evaluated < own.shape[0] * 3 * 40 / 8  # of 40 entries, few are evaluated
