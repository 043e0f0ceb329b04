"""Streaming forms of batch operators: sessions, merged regions and running best with state of their own, and the upsert of best run rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from speechloom.operators.tables import last_per_key, upsert

#: Buckets of a table of versions.
BUCKETS = 64


def session_regions(events: DataFrame, gap: str, lateness: str, key: str = "user_id", at: str = "ts") -> DataFrame:
    """(key, start, end, n): events of a key that are at most `gap` apart; state is dropped behind the watermark."""
    return events.withWatermark(at, lateness).groupBy(F.col(key), F.session_window(at, gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def in_order(rows: DataFrame, key: str, at: str, lateness: str, order: list[str], fields: list[str], out: str, held: str, step: Callable[[tuple | None, tuple], tuple[tuple, tuple | None]], flush: Callable[[tuple], tuple] | None = None, idle_ms: int = 0) -> DataFrame:
    """A stream's rows of each key in the order of `order`, passed to step() behind the watermark; late rows wait their turn.

    step(state, row) gives the next state and a row of `out` or None; rows are tuples of `fields`, states of the columns
    `held`. A row waits in the state until the watermark has passed its time, so the state holds as many rows as the
    lateness allows. flush(state) gives a last row when no row has come for idle_ms, and ends the state.
    """
    names = [c.split()[0] for c in out.split(", ")]
    state_names = [c.split()[0] for c in held.split(", ")]
    kinds = ", ".join(f"w_{c} array<{rows.schema[c].dataType.simpleString()}>" for c in fields)

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, waiting, current, last = state.getCurrentWatermarkMs(), [], None, 0
        if state.exists:
            stored = state.get
            last, known = stored[0], stored[1]
            current = tuple(stored[2 : 2 + len(state_names)]) if known else None
            waiting = list(zip(stored[2 + len(state_names)], *stored[3 + len(state_names) :], strict=True))
        if not state.hasTimedOut:
            for frame in frames:
                waiting += [(int(t), *row) for t, row in zip(frame["__at"], frame[fields].itertuples(index=False, name=None), strict=True)]
        places = [1 + fields.index(c) for c in order]
        waiting.sort(key=lambda r: tuple(r[k] for k in places))
        rows_out, later = [], []
        for row in waiting:
            if row[0] <= now:
                current, made = step(current, row[1:])
                last = max(last, row[0])
                if made is not None:
                    rows_out.append((*name, *made))
            else:
                later.append(row)
        if flush is not None and current is not None and not later and now > last + idle_ms:
            rows_out.append((*name, *flush(current)))
            current = None
        if current is None and not later:
            state.remove()
        else:
            columns = [list(c) for c in zip(*later, strict=True)] or [[] for _ in range(1 + len(fields))]
            state.update((last, current is not None, *(current or (None,) * len(state_names)), *columns))
            wake = min((r[0] for r in later), default=last + idle_ms)
            if later or flush is not None:
                state.setTimeoutTimestamp(max(wake, now) + 1)
        yield pd.DataFrame(rows_out, columns=[key, *names])

    timed = rows.withWatermark(at, lateness).withColumn("__at", F.unix_millis(F.col(at).cast("timestamp")))
    own = f"{key} {rows.schema[key].dataType.simpleString()}"
    return timed.groupBy(key).applyInPandasWithState(run, f"{own}, {out}", f"last long, known boolean, {held}, w_at array<long>, {kinds}", "append", GroupStateTimeout.EventTimeTimeout)


def running_best_stream(steps: DataFrame, lateness: str, at: str = "at") -> DataFrame:
    """run, step, loss, improved, best_loss and best_step of a stream of (run, step, loss, at), as running_best() gives them.

    A run's times rise with its steps. NaN is no loss, and comes out as null, as pandas has it.
    """

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple]:
        number, loss = row
        best, at_step = state or (None, None)
        loss = None if loss is None else float(loss)
        improved = loss is not None and loss == loss and (best is None or loss < best)
        if improved:
            best, at_step = loss, number
        return (best, at_step), (number, loss, improved, best, at_step)

    return in_order(steps, "run", at, lateness, ["step"], ["step", "loss"], "step long, loss double, improved boolean, best_loss double, best_step long", "best double, at_step long", step)


def merged_regions_stream(regions: DataFrame, max_gap_ms: int, lateness: str, at: str = "at") -> DataFrame:
    """rec, start, end and n of a stream of regions (rec, start, end, event_id, at), merged as merge_gaps() does.

    start and end are in milliseconds, at is the time of start. A merged region ends where its last region ends, and
    leaves the state with the region that begins the next one, or when the watermark is max_gap_ms behind its last end.
    """

    def step(state: tuple | None, row: tuple) -> tuple[tuple, tuple | None]:
        start, end, _ = row
        if state is not None and start - state[1] <= max_gap_ms:
            return (state[0], end, state[2] + 1), None
        return (start, end, 1), state

    return in_order(regions, "rec", at, lateness, ["start", "event_id"], ["start", "end", "event_id"], "start long, end long, n long", "begun long, ended long, n long", step, lambda state: state, max_gap_ms)


def upsert_results(results: DataFrame, path: str, checkpoint: str, key: str = "run_name", order: str = "evaluation_step", buckets: int = BUCKETS) -> StreamingQuery:
    """Keep the newest row of each key in a Parquet table of versions, by buckets of keys; each batch makes the next version.

    A batch writes the buckets that its keys fall into, and a manifest that says in which version each bucket was written
    last, so the bytes written grow with the batch. Names follow from the batch's number, so a batch that is repeated after
    a failure writes the same again. read_results() reads a version that has its manifest, and so is whole.
    """
    place = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        newest = last_per_key(batch, [key], [order]).withColumn("bucket", place)
        before = manifest(spark, path, epoch - 1) if epoch else {}
        touched = {r["bucket"] for r in newest.select("bucket").distinct().collect()}  # a number per bucket
        old = [f"{path}/version={v}/bucket={b}" for b, v in before.items() if b in touched]
        out = upsert(spark.read.schema(batch.schema).parquet(*old).withColumn("bucket", place), newest, key) if old else newest
        out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={epoch}")
        now = before | {b: epoch for b in touched}
        spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest/version={epoch}")

    return results.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).start()


def manifest(spark: SparkSession, path: str, version: int) -> dict[int, int]:
    """The version in which each bucket was written last, as of a version: a row per bucket."""
    return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{path}/_manifest/version={version}").collect()}


def read_results(spark: SparkSession, path: str, version: int) -> DataFrame:
    """The rows of a version of the table."""
    return spark.read.option("basePath", path).parquet(*[f"{path}/version={v}/bucket={b}" for b, v in manifest(spark, path, version).items()]).drop("version", "bucket")
