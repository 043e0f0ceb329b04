"""Operators over ordered rows: numbering, segmentation, merging, running state."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from speechloom.operators.scan import prefix_scan, ranged


def number_rows(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """1-based position within each key."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def first_n(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    return number_rows(df, keys, order, "__n").where(F.col("__n") <= n).drop("__n")


def segment_by_budget(utterances: DataFrame, budget_ms: int) -> DataFrame:
    """Add seg (1-based per rec): an utterance joins the segment unless its end passes the start by over budget_ms.

    A single utterance above the budget is a segment of its own. Rows are ranged by recording and utterance, so a long
    recording lies in many partitions. What a partition does to the segment that is open at its beginning depends on that
    segment's start alone, and only on which utterance cuts it first: for each range of starts, a partition says which
    start it ends with, and after how many cuts. These few rows are chained by recording, and then every partition knows
    the segment that it begins in. A task keeps some numbers, never a recording. start_ms and end_ms are not null.
    """
    spread = ranged(utterances, ["rec"], [F.col("utt")])
    pieces = spread.groupBy("rec", "__p").agg(F.max("start_ms").alias("__most"))
    w = Window.partitionBy("rec").orderBy("__p")
    # of recordings that go on into other partitions, the pieces: fewer than twice the partitions
    long = pieces.withColumns({"__before": F.max("__most").over(w.rowsBetween(Window.unboundedPreceding, -1)), "__pieces": F.count(F.lit(1)).over(Window.partitionBy("rec"))}).where("__pieces > 1").select("rec", "__p", "__before")
    rows = _ordered(_with_piece(spread.select("rec", "__p", "utt", "start_ms", "end_ms"), long, "inner"))
    ends = rows.mapInArrow(lambda batches: _piece_ends(batches, budget_ms), f"rec {spread.schema['rec'].dataType.simpleString()}, p int, low long, high long, out long, cuts long")
    begins = ends.groupBy("rec").applyInArrow(_chained, f"rec {spread.schema['rec'].dataType.simpleString()}, __p int, __begin long, __seg long")
    placed = _ordered(_with_piece(spread, begins, "left"))
    schema = utterances.schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, begin, segment = None, 0, 0
        for batch in batches:
            out = []
            for p, rec, start, end, before, number in zip(*[batch.column(c).to_pylist() for c in ("__p", "rec", "start_ms", "end_ms", "__begin", "__seg")], strict=True):
                fresh = (p, rec) != current
                if fresh:
                    current = (p, rec)
                    begin, segment = (start, 1) if before is None else (before, number)
                if end - begin > budget_ms and not (fresh and before is None):  # a recording's first utterance begins a segment whatever its length
                    begin, segment = start, segment + 1
                out.append(segment)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in schema.names], pa.array(out, type=pa.int64())], names=[*schema.names, "seg"])

    return placed.mapInArrow(run, f"{kinds}, seg long")


def _with_piece(rows: DataFrame, pieces: DataFrame, how: str) -> DataFrame:
    """rows joined with what their piece (rec, __p) of a long recording has; pieces has fewer rows than twice the partitions."""
    more = [c for c in pieces.columns if c not in ("rec", "__p")]
    match = F.col("a.rec").eqNullSafe(F.col("b.rec")) & (F.col("a.__p") == F.col("b.__p"))
    return rows.alias("a").join(F.broadcast(pieces.alias("b")), match, how).select("a.*", *[F.col(f"b.{c}").alias(c) for c in more])


def _ordered(rows: DataFrame) -> DataFrame:
    return rows.repartition("__p").sortWithinPartitions("__p", "rec", "utt")


def _piece_ends(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """(rec, p, low, high, out, cuts) of pieces: an open segment that starts in [low, high) becomes one that starts at out, after so many cuts.

    high is null for no limit, out for the segment that stays open. A recording's first piece has one row, without limits.
    """
    piece, found = None, []
    # ranges: [low, high, cuts]; those whose segment starts at the same place are kept together
    held: dict[int, list[list]] = {}
    top = None

    def close() -> None:
        if piece is not None:
            p, rec, before = piece
            found.extend((rec, p, low, high, begin, cuts) for begin, ranges in held.items() for low, high, cuts in ranges)
            if before is not None:
                found.append((rec, p, top - budget, None, None, 0))

    for batch in batches:
        for p, rec, before, start, end in zip(*[batch.column(c).to_pylist() for c in ("__p", "rec", "__before", "start_ms", "end_ms")], strict=True):
            fresh = piece is None or (p, rec) != piece[:2]
            if fresh:
                close()
                piece, held, top = (p, rec, before), {} if before is not None else {start: [[None, None, 0]]}, None
            cut = [] if fresh and before is None else [begin for begin in held if end - begin > budget]
            moved = [[low, high, cuts + 1] for begin in cut for low, high, cuts in held.pop(begin)]
            if before is not None and (top is None or (end > top and top - budget <= before)):
                moved.append([None if top is None else top - budget, end - budget, 1])
            if moved:
                held.setdefault(start, []).extend(moved)
            top = end if top is None else max(top, end)
    close()
    columns = list(zip(*found, strict=True)) or [()] * 6
    yield pa.RecordBatch.from_arrays([pa.array(columns[0]) if found else pa.array([], type=pa.string()), pa.array(columns[1], type=pa.int32()), *[pa.array(c, type=pa.int64()) for c in columns[2:]]], names=["rec", "p", "low", "high", "out", "cuts"])


def _chained(group: pa.Table) -> pa.Table:
    """(rec, __p, __begin, __seg) of a recording's pieces but the first: the segment that each begins in."""
    pieces: dict[int, list[tuple]] = {}
    for p, *row in zip(*[group.column(c).to_pylist() for c in ("p", "low", "high", "out", "cuts")], strict=True):
        pieces.setdefault(p, []).append(tuple(row))
    out, begin, number = [], None, 1
    for p in sorted(pieces):
        if begin is not None:
            out.append((p, begin, number))
        for low, high, after, cuts in pieces[p]:
            if begin is None or ((low is None or begin >= low) and (high is None or begin < high)):
                begin, number = begin if after is None else after, number + cuts
                break
    rec = group.column("rec")[:1]
    return pa.table({"rec": pa.chunked_array([rec.combine_chunks().take(pa.array([0] * len(out), type=pa.int64()))]), "__p": pa.array([x[0] for x in out], type=pa.int32()), "__begin": pa.array([x[1] for x in out], type=pa.int64()), "__seg": pa.array([x[2] for x in out], type=pa.int64())})


def merge_gaps(regions: DataFrame, max_gap: int, order: list[str]) -> DataFrame:
    """(rec, island, start, end, n): regions merged where the gap to the region before is at most max_gap.

    A merged region ends where its last region ends, which need not be the largest end.
    """
    w = Window.partitionBy("rec").orderBy(*order)
    gap = regions.withColumn("cut", F.coalesce((F.col("start") - F.lag("end").over(w) > max_gap).cast("int"), F.lit(1)))
    island = gap.withColumn("island", F.sum("cut").over(w).cast("long"))
    last = F.struct(*order)
    return island.groupBy("rec", "island").agg(F.min_by("start", last).alias("start"), F.max_by("end", last).alias("end"), F.count(F.lit(1)).alias("n"))


def running_best(steps: DataFrame) -> DataFrame:
    """Add improved, best_loss and best_step per run: a step improves only if strictly below all before it.

    The least (loss, step) so far is the first step with the least loss, so a step improves if it is that itself.
    """
    # NaN counts as no loss
    own = F.when(~F.isnan("loss"), F.struct("loss", "step"))
    best = prefix_scan(steps.select("run", "step", "loss"), ["run"], [F.col("step")], {"__best": ("min", own)})
    improved = F.coalesce(~F.isnan("loss") & (F.col("__best.step") == F.col("step")), F.lit(False))
    return best.select("run", "step", "loss", improved.alias("improved"), F.col("__best.loss").alias("best_loss"), F.col("__best.step").alias("best_step"))


def evaluation_steps(steps: DataFrame, every: int) -> DataFrame:
    """Steps at which to evaluate: each every-th, and a run's last one.

    Last steps that are no every-th are found by run, and their rows by run and step, so a run of any length is dealt out.
    """
    last = steps.groupBy("run").agg(F.max("step").alias("step")).where(F.col("step") % every != 0)
    return steps.where(F.col("step") % every == 0).unionByName(steps.join(last, ["run", "step"], "left_semi").select(*steps.columns))


def batches(rows: DataFrame, order: list[str], size: int, keys: list[str]) -> DataFrame:
    """Add batch (0-based per key): consecutive rows, the last batch short."""
    return number_rows(rows, keys, order, "__n").withColumn("batch", F.floor((F.col("__n") - 1) / size).cast("long")).drop("__n")


def group_offsets(groups: DataFrame, keys: list[str], order: list[str], size: Column) -> DataFrame:
    """Add offset: the sizes of the groups before it."""
    upto = prefix_scan(groups, keys, [F.col(c) for c in order], {"offset": ("sum", size.cast("long"))})
    return upto.withColumn("offset", F.coalesce(F.col("offset") - F.coalesce(size, F.lit(0)), F.lit(0)).cast("long"))


def fill_translations(lines: DataFrame) -> DataFrame:
    """(rec, utt, translation): translation lines go to the latest utterance before them, the last line wins.

    lines: rec, line_no, utt (null on other lines), translation (null on other lines).
    """
    filled = prefix_scan(lines, ["rec"], [F.col("line_no")], {"__utt": ("last", F.col("utt"))}).withColumn("utt", F.col("__utt")).where("utt is not null")
    newest = F.max_by("translation", F.when(F.col("translation").isNotNull(), F.col("line_no")))
    return filled.groupBy("rec", "utt").agg(F.coalesce(newest, F.lit("")).alias("translation"))
