"""What a client of searches needs beside one plan: chunks with progress, a truncation notice, cached slices, jobs, EXPLAIN."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.operators import jobs
from tarn.plans.search import DEFAULT_LIMIT, MAX_LIMIT, Engine, Request


@dataclass
class Chunk:
    """Rows of a part of the time range, in the order of the whole answer; progress is the share of the range done."""

    start_us: int
    end_us: int
    rows: DataFrame
    n: int
    progress: float


def chunks(engine: Engine, request: Request, every_us: int, ascending: bool = False) -> Iterator[Chunk]:
    """A plain search by parts of its time range, newest first, until the range or the size is used up.

    Only a query without grouping and order can be answered in parts; what a
    chunk holds is limited to what the size still allows.
    """
    if request.start_us is None or request.end_us is None or every_us <= 0:
        raise ValueError("chunks need a time range and a positive length")
    left = request.size or DEFAULT_LIMIT
    low, high = request.start_us, request.end_us
    while low < high and left > 0:
        a, b = (low, min(low + every_us, high)) if ascending else (max(low, high - every_us), high)
        rows = engine.search(replace(request, start_us=a, end_us=b, size=left, offset=0))
        if ascending:
            time = engine._streams(request.sql, request.kind)[0].time_column
            rows = engine.plan(replace(request, start_us=a, end_us=b)).orderBy(F.col(time).asc_nulls_last()).limit(left)
        rows = rows.persist()
        n = rows.count()
        low, high = (b, high) if ascending else (low, a)
        left -= n
        yield Chunk(a, b, rows, n, 1 - (high - low) / max(1, request.end_us - request.start_us))
        rows.unpersist()


def truncated(engine: Engine, request: Request) -> tuple[DataFrame, bool]:
    """A search's rows at its size, and whether there were more."""
    size = min(request.size or DEFAULT_LIMIT, MAX_LIMIT - 1)
    more = engine.search(replace(request, size=size + 1)).count() > size
    return engine.search(replace(request, size=size)), more


def explain(engine: Engine, request: Request, analyze: bool = False) -> DataFrame:
    """(phase, node, plan): the logical plan, then the physical one; after a run of it if analyze."""
    df = engine.plan(request)
    execution = df._jdf.queryExecution()
    texts = [execution.optimizedPlan().toString()]
    if analyze:
        df.write.format("noop").mode("overwrite").save()
    texts.append(execution.executedPlan().toString())
    rows = [(phase, node, line) for phase, text in enumerate(texts) for node, line in enumerate(text.rstrip().split("\n"))]
    return engine.spark.createDataFrame(rows, "phase int, node int, plan string")


class SliceCache:
    """Partial aggregates by aligned slices of time, in a folder; a slice is computed once.

    key names the query: another query takes another key. The last slice may
    still grow, so slices that end after ``settled_us`` are not kept.
    """

    def __init__(self, engine: Engine, path: str, every_us: int):
        self.engine, self.path, self.every = engine, path, every_us
        self.computed = 0

    def _exists(self, path: str) -> bool:
        spark = self.engine.spark
        target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)

    def aggregate(self, key: str, request: Request, keys: Sequence[str], value: str, settled_us: int) -> DataFrame:
        """count, sum, min, max and avg of value by keys over the request's range; a range end within a slice is aggregated afresh."""
        parts = []
        at = request.start_us
        while at < request.end_us:
            to = min((at // self.every + 1) * self.every, request.end_us)
            part = jobs.partial_aggregate(self.engine.plan(replace(request, start_us=at, end_us=to)), keys, value)
            if at % self.every == 0 and to % self.every == 0 and to <= settled_us:
                folder = f"{self.path}/{key}/slice={at}"
                if not self._exists(folder):
                    part.write.mode("overwrite").parquet(folder)
                    self.computed += 1
                part = self.engine.spark.read.schema(part.schema).parquet(folder)
            parts.append(part)
            at = to
        states = parts[0]
        for p in parts[1:]:
            states = states.unionByName(p)
        return jobs.merge_aggregates(states, keys)


class Jobs:
    """Searches that run in the background and leave their result in a folder."""

    def __init__(self, engine: Engine, path: str, workers: int = 2):
        self.engine, self.path = engine, path
        self._pool = ThreadPoolExecutor(workers)
        self._runs: dict[str, Future] = {}

    def submit(self, request: Request) -> str:
        job = uuid.uuid4().hex
        plan = self.engine.search(request)
        self._runs[job] = self._pool.submit(lambda: plan.write.mode("overwrite").parquet(f"{self.path}/{job}"))
        return job

    def status(self, job: str) -> str:
        run = self._runs[job]
        if not run.done():
            return "running" if run.running() else "pending"
        return "cancelled" if run.cancelled() else "failed" if run.exception() else "finished"

    def cancel(self, job: str) -> bool:
        return self._runs[job].cancel()

    def result(self, job: str, offset: int = 0, size: int | None = None) -> DataFrame:
        """The stored rows; waits for the job, and raises what made it fail."""
        self._runs[job].result()
        rows = self.engine.spark.read.parquet(f"{self.path}/{job}")
        rows = rows.offset(offset) if offset else rows
        return rows if size is None else rows.limit(size)


def backfill(plan: Callable[[int, int], DataFrame], delete: Callable[[int, int], None] | None, path: str, start_us: int, end_us: int, every_us: int, done: int | None = None) -> Iterator[tuple[int, int, float]]:
    """Run a scheduled query over a past range, period by period: (start, end, progress) after each.

    delete, if given, first clears the target's rows of the whole range, unless
    the run goes on from ``done``, the end of the last period of an earlier one.
    """
    if every_us < 60_000_000:
        raise ValueError("a schedule runs at most once a minute")
    if delete is not None and done is None:
        delete(start_us, end_us)
    for low in range(start_us if done is None else done, end_us, every_us):
        high = min(low + every_us, end_us)
        plan(low, high).write.mode("overwrite").parquet(f"{path}/period={low}")
        yield low, high, (high - start_us) / max(1, end_us - start_us)
