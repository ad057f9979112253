"""Span tables: traces by user, parent graphs, and service graphs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SERVER_KINDS = ("2", "SPAN_KIND_SERVER", "Server", "server")


def trace_dag(spans: DataFrame, trace_id: str) -> DataFrame:
    """The spans of a trace with their parent's operation; a root, or a span whose parent is missing, has none."""
    own = spans.filter(F.col("trace_id") == trace_id)
    parents = own.select(F.col("span_id").alias("__parent"), F.col("service_name").alias("parent_service"), F.col("operation_name").alias("parent_operation")).dropDuplicates(["__parent"])
    joined = own.join(parents, F.col("reference_parent_span_id") == F.col("__parent"), "left").drop("__parent")
    return joined.select("span_id", "reference_parent_span_id", "service_name", "operation_name", "span_kind", "span_status", "start_time", "end_time", "parent_service", "parent_operation")


def trace_list(spans: DataFrame) -> DataFrame:
    """Per trace its first start, last end, spans and services."""
    return spans.groupBy("trace_id").agg(
        F.min("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
        F.count(F.lit(1)).alias("spans"),
        F.sum(F.when(F.col("span_status") == "ERROR", 1).otherwise(0)).alias("errors"),
        F.array_sort(F.collect_set("service_name")).alias("services"),
    )


def trace_index(spans: DataFrame, stream: str) -> DataFrame:
    """One row per service and trace, with the time it was first seen."""
    return spans.groupBy("service_name", "trace_id").agg(F.min("start_time").alias("_timestamp")).select("_timestamp", F.lit(stream).alias("stream_name"), "service_name", "trace_id")


def service_edges(spans: DataFrame, exact: bool = False, bucket: Column | None = None) -> DataFrame:
    """Calls between services: client (null for entry points) and server with counts, errors and latency percentiles.

    A call is a span whose parent is of another service, or a span without a
    parent. A parent is looked up within its trace.
    """
    parents = spans.select(F.col("trace_id").alias("__trace"), F.col("span_id").alias("__span"), F.col("service_name").alias("client")).dropDuplicates(["__trace", "__span"])
    calls = spans.join(parents, (F.col("trace_id") == F.col("__trace")) & (F.col("reference_parent_span_id") == F.col("__span")), "left")
    calls = calls.filter(F.col("client").isNull() | (F.col("client") != F.col("service_name")))
    duration = (F.col("end_time") - F.col("start_time")).cast("double")

    def at(p: float):
        return F.percentile(duration, F.lit(p)) if exact else F.percentile_approx(duration, F.lit(p), F.lit(10_000))

    errors = F.sum(F.when(F.col("span_status") == "ERROR", 1).otherwise(0))
    keys = ["client", F.col("service_name").alias("server"), *([bucket.cast("long").alias("bucket_start")] if bucket is not None else [])]
    out = calls.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_requests"), errors.alias("failed_requests"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99")
    )
    return out.withColumn("error_rate", F.col("failed_requests") * 100.0 / F.col("total_requests"))


def call_totals(calls: DataFrame) -> DataFrame:
    """Mergeable totals of calls (spans with their client): requests, errors, and the sum and largest of their durations."""
    duration = (F.col("end_time") - F.col("start_time")).cast("double")
    errors = F.sum(F.when(F.col("span_status") == "ERROR", 1).otherwise(0))
    return calls.groupBy("client", F.col("service_name").alias("server")).agg(F.count(F.lit(1)).alias("total_requests"), errors.alias("failed_requests"), F.sum(duration).alias("duration"), F.max(duration).alias("longest"))


def edge_totals(totals: DataFrame) -> DataFrame:
    """The totals of several batches as one row per edge."""
    return totals.groupBy("client", "server").agg(*[F.sum(c).alias(c) for c in ("total_requests", "failed_requests", "duration")], F.max("longest").alias("longest"))


def edge_history(spans: DataFrame, every_us: int, time_column: str = "start_time", exact: bool = False) -> DataFrame:
    """service_edges per bucket of time (bucket_start), so that an edge's requests, errors and latencies can be followed."""
    return service_edges(spans, exact, F.floor(F.col(time_column) / every_us) * every_us)


def duration_percentiles(spans: DataFrame, by: Sequence[str], points: Sequence[float] = (0.5, 0.75, 0.9, 0.95, 0.99), exact: bool = False) -> DataFrame:
    """Percentiles of the spans' durations by the given columns, with their number."""
    duration = (F.col("end_time") - F.col("start_time")).cast("double")
    at = [(F.percentile(duration, F.lit(p)) if exact else F.percentile_approx(duration, F.lit(p), F.lit(10_000))).alias(f"p{round(p * 100)}") for p in points]
    return spans.groupBy(*by).agg(F.count(F.lit(1)).alias("spans"), *at)


def trace_list_by_user(spans: DataFrame, user_column: str, user: str | None = None) -> DataFrame:
    """Traces with the user that a span of theirs names (the least if several), those of one user if given."""
    own = spans.groupBy("trace_id").agg(F.min(user_column).alias("user"))
    own = own.filter(F.col("user").isNotNull() if user is None else F.col("user") == user)
    return trace_list(spans).join(own, "trace_id")


def service_nodes(edges: DataFrame) -> DataFrame:
    """Services of the edges with the requests they receive and make."""
    received = edges.select(F.col("server").alias("service"), F.col("total_requests").alias("received"), F.lit(0).cast("long").alias("made"), "failed_requests")
    made = edges.filter("client IS NOT NULL").select(F.col("client").alias("service"), F.lit(0).cast("long").alias("received"), F.col("total_requests").alias("made"), F.lit(0).cast("long").alias("failed_requests"))
    return received.unionByName(made).groupBy("service").agg(F.sum("received").alias("received"), F.sum("made").alias("made"), F.sum("failed_requests").alias("failed"))


def depths(spark, spans_view: str):
    """The depth of each span below its root (span_id, depth), by a recursive query over a view of spans."""
    return spark.sql(f"""
        WITH RECURSIVE tree(trace_id, span_id, depth) AS (
            SELECT trace_id, span_id, 0 FROM {spans_view} WHERE reference_parent_span_id IS NULL OR reference_parent_span_id = ''
            UNION ALL
            SELECT s.trace_id, s.span_id, t.depth + 1 FROM {spans_view} s JOIN tree t ON s.trace_id = t.trace_id AND s.reference_parent_span_id = t.span_id
        ) SELECT trace_id, span_id, depth FROM tree""")


def token_costs(spans: DataFrame, prices: DataFrame) -> DataFrame:
    """Spans of model calls with their cost: tokens times the price of the tier that the input size falls into.

    prices: model, from_tokens, input_price, output_price (per million tokens).
    """
    tiers = prices.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("from_tokens", "input_price", "output_price"))).alias("tiers"))
    joined = spans.join(F.broadcast(tiers) if _small(prices) else tiers, "model", "left")
    tier = F.element_at(F.filter("tiers", lambda t: t["from_tokens"] <= F.col("input_tokens")), -1)
    cost = (F.col("input_tokens") * tier["input_price"] + F.col("output_tokens") * tier["output_price"]) / 1e6
    return joined.withColumn("cost", F.when(F.size(F.filter("tiers", lambda t: t["from_tokens"] <= F.col("input_tokens"))) > 0, cost)).drop("tiers")


def _small(df: DataFrame) -> bool:
    from tarn.operators.relational import BROADCAST_BYTES, estimated_bytes

    return estimated_bytes(df) <= BROADCAST_BYTES
