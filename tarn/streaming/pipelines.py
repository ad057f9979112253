"""Structured Streaming: ingest pipelines, windows, de-duplication, grouping, and rolling jobs.

Late data: an event older than the watermark is dropped; up to it, it counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tarn.operators import traces


def source(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream, a bounded number per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


@dataclass
class Node:
    """A step of a pipeline: rows that meet ``condition`` pass through ``transform`` into ``target`` (None: only on to the next)."""

    condition: Column | str | None = None
    transform: Callable[[DataFrame], DataFrame] | None = None
    target: str | None = None


def run_nodes(df: DataFrame, nodes: Sequence[Node]) -> dict[str, DataFrame]:
    """target -> rows, for the branches of a pipeline over one input."""
    out: dict[str, DataFrame] = {}
    for n in nodes:
        rows = df.filter(n.condition) if n.condition is not None else df
        rows = n.transform(rows) if n.transform else rows
        if n.target is None:
            df = rows
        else:
            out[n.target] = out[n.target].unionByName(rows, allowMissingColumns=True) if n.target in out else rows
    return out


def realtime(stream: DataFrame, nodes: Sequence[Node], root: str, checkpoint: str):
    """Run a pipeline on ingest: every batch fans out to its targets, each batch under its own folder so a replay overwrites it."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        for target, rows in run_nodes(kept, nodes).items():
            rows.write.mode("overwrite").parquet(f"{root}/{target}/batch={number}")
        kept.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def tumbling(stream: DataFrame, time: str, width: str, keys: Sequence[str], aggs: Sequence[Column], late: str) -> DataFrame:
    """Aggregates per window of one width; a week begins on a Monday, as in batch."""
    start = "4 days" if width.split()[-1].rstrip("s") == "week" or width == "7 days" else None
    w = F.window(F.col(time), width, width, start) if start else F.window(F.col(time), width)
    return stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("bucket"), *keys, *[F.col(_name(a)) for a in aggs])


def sliding(stream: DataFrame, time: str, width: str, slide: str, keys: Sequence[str], aggs: Sequence[Column], late: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(F.col(time), width, slide).alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *[F.col(_name(a)) for a in aggs])


def sessions(stream: DataFrame, time: str, gap: str, keys: Sequence[str], aggs: Sequence[Column], late: str) -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(F.col(time), gap).alias("w"), *keys).agg(*aggs).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *[F.col(_name(a)) for a in aggs])


def _name(c: Column) -> str:
    return c._jc.toString().rsplit(" AS ", 1)[-1].strip("`")


def distinct_within(stream: DataFrame, time: str, keys: Sequence[str], within: str) -> DataFrame:
    """The first event of each key; repeats within the time are dropped."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(list(keys))


def distinct_counts(stream: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value, count) so far, for update or complete mode."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")
    return stream.select(pairs).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("count"))


def downsample(stream: DataFrame, time: str, width: str, series: Sequence[str], value: str, late: str) -> DataFrame:
    return tumbling(stream, time, width, series, [F.avg(value).alias("avg"), F.count(F.lit(1)).alias("n")], late)


def grouped_alerts(stream: DataFrame, time: str, key: str, wait: str, size: int, late: str = "0 seconds") -> DataFrame:
    """Batches of alerts per key: one is sent when it holds ``size`` alerts or ``wait`` has passed since its first.

    Needs append mode. Result: key, n, first_us, last_us, reason (size or wait).
    """
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    schema = f"{key} string, n long, first_us long, last_us long, reason string"

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, last = state.get if state.exists else (0, 0, 0)
        sent = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(group[0], n, first, last, "wait")], columns=[key, "n", "first_us", "last_us", "reason"])
            return
        for us in sorted(int(x) for f in frames for x in f["us"]):
            if n and us - first >= wait_ms * 1000:
                sent.append((group[0], n, first, last, "wait"))
                n = 0
            first = us if not n else first
            n, last = n + 1, us
            if n >= size:
                sent.append((group[0], n, first, last, "size"))
                n = 0
        if n:
            state.update((n, first, last))
            state.setTimeoutTimestamp(max(first // 1000 + wait_ms, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if sent:
            yield pd.DataFrame(sent, columns=[key, "n", "first_us", "last_us", "reason"])

    timed = stream.withWatermark(time, late).select(F.col(key).cast("string").alias(key), F.col(time), F.unix_micros(F.col(time).cast("timestamp")).alias("us"))
    return timed.groupBy(key).applyInPandasWithState(step, schema, "n long, first_us long, last_us long", "append", GroupStateTimeout.EventTimeTimeout)


def join_streams(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, within: str) -> DataFrame:
    """Inner join of two streams whose times lie within a distance of each other; state is dropped by watermark."""
    a = left.withWatermark(left_time, within).alias("a")
    renamed = {c: f"__{c}" for c in right.columns}
    b = right.withWatermark(right_time, within).withColumnsRenamed(renamed).alias("b")
    t, u = f"a.`{left_time}`", f"b.`__{right_time}`"
    on = F.expr(f"{u} BETWEEN {t} - INTERVAL {within} AND {t} + INTERVAL {within}")
    for k in keys:
        on = on & (F.col(f"a.`{k}`") == F.col(f"b.`__{k}`"))
    joined = a.join(b, on).drop(*[f"__{k}" for k in keys])
    # Right columns get their names back unless the left side has them.
    return joined.withColumnsRenamed({f"__{c}": c if c not in left.columns else f"right_{c}" for c in right.columns if c not in keys})


def service_calls(spans: DataFrame, time: str, within: str) -> DataFrame:
    """Calls of a stream of spans with their client: a parent may come in another batch, up to ``within`` before or after.

    A span whose parent has not come by then, or that has none, is an entry
    point (client null). Append mode; service_edges sums what this writes.
    """
    a = spans.withWatermark(time, within).alias("a")
    names = {"trace_id": "__trace", "span_id": "__span", "service_name": "client", time: "__time"}
    b = spans.select(*names).withColumnsRenamed(names).withWatermark("__time", within).alias("b")
    near = F.expr(f"b.__time BETWEEN a.`{time}` - INTERVAL {within} AND a.`{time}` + INTERVAL {within}")
    on = (F.col("a.trace_id") == F.col("b.__trace")) & (F.col("a.reference_parent_span_id") == F.col("b.__span")) & near
    calls = a.join(b, on, "left").drop("__trace", "__span", "__time")
    return calls.filter(F.col("client").isNull() | (F.col("client") != F.col("service_name")))


def service_graph_batches(stream: DataFrame, path: str, checkpoint: str, time: str = "ts", within: str = "10 minutes"):
    """Service calls as they settle, under the batch's own folder; traces.edge_totals sums them."""

    def write(batch: DataFrame, number: int) -> None:
        traces.call_totals(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return service_calls(stream, time, within).writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint)


def trace_index(spans: DataFrame, time: str, stream: str, within: str) -> DataFrame:
    """The first row of each service and trace, as it comes; repeats within the time are dropped."""
    first = spans.withWatermark(time, within).dropDuplicatesWithinWatermark(["service_name", "trace_id"])
    return first.select(F.unix_micros(F.col(time).cast("timestamp")).alias("_timestamp"), F.lit(stream).alias("stream_name"), "service_name", "trace_id")


def derived(spark: SparkSession, plan: Callable[[int, int], DataFrame], path: str, start_us: int, end_us: int, every_us: int) -> int:
    """Run a scheduled query over each period of a range, each overwriting its own folder, so a backfill may repeat; returns the periods."""
    if every_us < 60_000_000:
        raise ValueError("a schedule runs at most once a minute")
    n = 0
    for low in range(start_us, end_us, every_us):
        plan(low, min(low + every_us, end_us)).write.mode("overwrite").parquet(f"{path}/period={low}")
        n += 1
    return n
