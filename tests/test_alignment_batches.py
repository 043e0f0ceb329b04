"""Alignment of whole batches: who works on them, and what a worker holds."""

import random
import tracemalloc

import pyarrow as pa

from speechloom.fixtures import Views
from speechloom.operators import align


def test_turns_of_one_file_are_dealt_to_tasks(spark, tmp_path):
    rows = [(k, t, "user", f"one two {k}") for k in range(40) for t in range(2)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    aligned = Views(spark, str(tmp_path)).aligned
    assert aligned.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert aligned.count() == 80


def test_a_batch_holds_one_pair_as_objects():
    rng = random.Random(5)
    ref = [[f"word{rng.randrange(5000)}" for _ in range(80)] for _ in range(2000)]
    hyp = [["zz" if k % 5 == 4 else w for k, w in enumerate(r) if k % 7 != 6] for r in ref]
    arrays = [pa.array(x, type=pa.list_(pa.string())) for x in (ref, hyp)]
    tracemalloc.start()
    ops = align.edit_operations.func(*arrays)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20  # 320,000 words, each of some 50 bytes as an object
    assert ops.to_pylist()[:50] == [align.alignment_path(a, b) for a, b in zip(ref[:50], hyp[:50], strict=True)]


def test_nulls_and_slices_of_batches():
    ref = pa.array([["q"], None, ["a", None], [], ["x", "y"]], type=pa.list_(pa.string())).slice(1)
    hyp = pa.array([["q"], ["b"], ["a", None, "c"], None, ["z"]], type=pa.list_(pa.string())).slice(1)
    ops = align.edit_operations.func(ref, hyp)
    assert ops.to_pylist() == ["I", "CCI", "", "DS"]
    used = align.words_used.func(pa.array(["CC", None, *ops.to_pylist()], type=pa.string()).slice(1)).to_pylist()
    assert used == [{"i": [], "j": []}, {"i": [0], "j": [1]}, {"i": [1, 2, 2], "j": [1, 2, 3]}, {"i": [], "j": []}, {"i": [1, 2], "j": [0, 1]}]
