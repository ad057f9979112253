"""Records of several protocols as flat tables."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEVERITIES = ["UNSPECIFIED", *[f"{n}{i or ''}" for n in ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL") for i in ("", 2, 3, 4)]]


def key_name(name: str) -> str:
    """Lower case, with every other character than letters and digits as an underscore."""
    return re.sub(r"[^a-z0-9_]", "_", name.lower())


def flatten(df: DataFrame, max_level: int = 0) -> DataFrame:
    """Nested structs as columns joined by ``_``; arrays, and structs past max_level (0: no limit), as JSON strings."""
    out: list[Column] = []
    seen: dict[str, str] = {}

    def walk(c: Column, kind: T.DataType, name: str, level: int) -> None:
        if isinstance(kind, T.StructType) and (not max_level or level < max_level):
            for f in kind:
                walk(c.getField(f.name), f.dataType, f"{name}_{f.name}" if name else f.name, level + 1)
            return
        final = key_name(name)
        if final in seen:
            raise ValueError(f"{name!r} and {seen[final]!r} flatten to one column")
        seen[final] = name
        nested = isinstance(kind, (T.StructType, T.ArrayType, T.MapType))
        out.append((F.to_json(c) if nested else c).alias(final))

    for f in df.schema:
        walk(F.col(f"`{f.name}`"), f.dataType, f.name, 1)
    return df.select(*out)


def with_timestamp(df: DataFrame, source: str = "_timestamp") -> DataFrame:
    """A ``_timestamp`` in microseconds from a number of any unit or a time string; now where it is missing."""
    now = F.unix_micros(F.current_timestamp())
    if source not in df.columns:
        return df.withColumn("_timestamp", now)
    text = F.expr(f"text_us(CAST(`{source}` AS STRING))")
    return df.withColumn("_timestamp", F.coalesce(text, now))


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, max_level: int = 0) -> DataFrame:
    """Newline-delimited JSON records, flattened and with a time."""
    reader = spark.read.schema(schema) if schema else spark.read
    return with_timestamp(flatten(reader.json(path), max_level))


def from_json_text(spark: SparkSession, rows: Sequence[dict], max_level: int = 0) -> DataFrame:
    """Records of a request body as a flat table; keys with only nulls are left out."""
    # The reader infers one schema over all lines; a request body is small.
    lines = spark.sparkContext.parallelize([json.dumps({k: v for k, v in r.items() if v is not None}) for r in rows])
    return with_timestamp(flatten(spark.read.json(lines), max_level))


def multi_line(spark: SparkSession, path: str, schema: T.StructType | None = None, max_level: int = 0) -> DataFrame:
    """Files that each hold one record or an array of records over several lines."""
    reader = (spark.read.schema(schema) if schema else spark.read).option("multiLine", "true")
    return with_timestamp(flatten(reader.json(path), max_level))


def pubsub(pushes: DataFrame, column: str = "value") -> DataFrame:
    """Push messages of a cloud topic: the decoded data as log, with the message's id, time and attributes."""
    schema = "message STRUCT<data: STRING, messageId: STRING, publishTime: STRING, attributes: MAP<STRING,STRING>>, subscription STRING"
    m = pushes.select(F.from_json(column, schema).alias("m")).filter("m.message.data IS NOT NULL").select("m.message.*", "m.subscription")
    us = F.coalesce(F.expr("text_us(publishTime)"), F.unix_micros(F.current_timestamp()))
    return m.select(us.alias("_timestamp"), F.unbase64("data").cast("string").alias("log"), F.col("messageId").alias("message_id"), "subscription", "attributes")


def firehose(requests: DataFrame, column: str = "value") -> DataFrame:
    """Delivery requests: a row per record, and per log event where a record holds a batch of them."""
    schema = "requestId STRING, timestamp BIGINT, records ARRAY<STRUCT<data: STRING>>"
    r = requests.select(F.from_json(column, schema).alias("r")).select("r.requestId", "r.timestamp", F.explode("r.records.data").alias("data"))
    text = F.unbase64("data").cast("string")
    batch = F.from_json(text, "logGroup STRING, logStream STRING, logEvents ARRAY<STRUCT<id: STRING, timestamp: BIGINT, message: STRING>>")
    rows = r.select("requestId", "timestamp", text.alias("text"), batch.alias("b")).withColumn("e", F.explode_outer("b.logEvents"))
    at = F.expr("time_us(coalesce(e.timestamp, timestamp))")
    return rows.select(at.alias("_timestamp"), F.coalesce("e.message", "text").alias("log"), F.col("requestId").alias("request_id"), F.col("b.logGroup").alias("log_group"), F.col("b.logStream").alias("log_stream"))


def rum(events: DataFrame, tags: dict[str, str] | None = None, column: str = "value", schema: str = "type STRING, date BIGINT, application STRUCT<id: STRING>, session STRUCT<id: STRING>, view STRUCT<id: STRING, url: STRING>, service STRING") -> DataFrame:
    """Browser events, one JSON object per row, flattened; the request's tags become columns."""
    e = flatten(events.select(F.from_json(column, schema).alias("e")).filter("e.type IS NOT NULL").select("e.*"))
    out = e.withColumn("_timestamp", F.expr("time_us(date)")).drop("date")
    return out.withColumns({key_name(k): F.lit(v) for k, v in (tags or {}).items()})


def with_record_id(df: DataFrame, name: str = "_record_id", time_column: str = "_timestamp") -> DataFrame:
    """An id of each record that sorts by time: its microseconds, then a hash of its columns; equal records share one."""
    rest = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) for c in df.columns])
    return df.withColumn(name, F.concat(F.lpad(F.hex(F.col(time_column)), 16, "0"), F.lpad(F.hex(rest), 16, "0")))


def hec(lines: DataFrame, column: str = "value") -> DataFrame:
    """HTTP event collector lines: event as text or JSON, time in seconds, and its metadata fields."""
    schema = "time DOUBLE, host STRING, source STRING, sourcetype STRING, index STRING, event STRING, fields MAP<STRING,STRING>"
    e = lines.select(F.from_json(column, schema).alias("e")).filter("e IS NOT NULL AND e.event IS NOT NULL").select("e.*")
    us = F.coalesce((F.col("time") * 1_000_000).cast("long"), F.unix_micros(F.current_timestamp()))
    return e.select(us.alias("_timestamp"), "host", "source", "sourcetype", F.coalesce("index", F.lit("default")).alias("stream"), F.col("event").alias("log"), F.to_json("fields").alias("fields"))


def loki(pushes: DataFrame, column: str = "value") -> DataFrame:
    """Push requests: one row per line, with its stream's labels and structured metadata."""
    schema = "streams ARRAY<STRUCT<stream: MAP<STRING,STRING>, values: ARRAY<ARRAY<STRING>>>>"
    streams = pushes.select(F.explode(F.from_json(column, schema)["streams"]).alias("s"))
    rows = streams.select("s.stream", F.explode("s.values").alias("v"))
    return rows.select((F.get("v", F.lit(0)).cast("long") / 1000).cast("long").alias("_timestamp"), F.get("v", F.lit(1)).alias("log"), F.col("stream").alias("labels"), F.from_json(F.get("v", F.lit(2)), "MAP<STRING,STRING>").alias("metadata"))


def parse_labels(text: Column) -> Column:
    """``{a="x", b="y"}`` as a map; escaped quotes and backslashes are resolved."""
    pairs = F.regexp_extract_all(text, F.lit(r'([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"((?:[^"\\]|\\.)*)"'), F.lit(0))

    def entry(p: Column) -> Column:
        raw = F.regexp_extract(p, r'^([A-Za-z_][A-Za-z0-9_]*)\s*=\s*"(.*)"$', 2)
        return F.struct(F.regexp_extract(p, r"^([A-Za-z_][A-Za-z0-9_]*)", 1).alias("key"), F.regexp_replace(raw, r"\\(.)", "$1").alias("value"))

    return F.map_from_entries(F.transform(pairs, entry))


def otlp_value(v: Column) -> Column:
    """An attribute value of the JSON encoding as text: the one field that is set."""
    kinds = ("stringValue", "intValue", "doubleValue", "boolValue", "arrayValue", "kvlistValue")
    return F.coalesce(*[F.get_json_object(v, f"$.{k}") for k in kinds])


def otlp_spans(requests: DataFrame, column: str = "value") -> DataFrame:
    """Trace export requests as flat spans; attributes as a map of texts."""
    attributes = "ARRAY<STRUCT<key: STRING, value: STRING>>"
    span = f"STRUCT<traceId: STRING, spanId: STRING, parentSpanId: STRING, name: STRING, kind: INT, startTimeUnixNano: STRING, endTimeUnixNano: STRING, attributes: {attributes}, status: STRUCT<code: INT, message: STRING>>"
    schema = f"resourceSpans ARRAY<STRUCT<resource: STRUCT<attributes: {attributes}>, scopeSpans: ARRAY<STRUCT<spans: ARRAY<{span}>>>>>"
    resources = requests.select(F.explode(F.from_json(column, schema)["resourceSpans"]).alias("r"))
    scopes = resources.select(F.col("r.resource.attributes").alias("resource"), F.explode("r.scopeSpans").alias("s"))
    spans = scopes.select("resource", F.explode("s.spans").alias("x"))

    def as_map(c: str) -> Column:
        return F.map_from_entries(F.transform(F.coalesce(F.col(c), F.array().cast(attributes)), lambda a: F.struct(a["key"], otlp_value(a["value"]).alias("value"))))

    start, end = F.col("x.startTimeUnixNano").cast("long"), F.col("x.endTimeUnixNano").cast("long")
    status = F.when(F.col("x.status.code") == 2, "ERROR").when(F.col("x.status.code") == 1, "OK").otherwise("UNSET")
    return spans.select(
        (start / 1000).cast("long").alias("_timestamp"), F.col("x.traceId").alias("trace_id"), F.col("x.spanId").alias("span_id"),
        F.coalesce("x.parentSpanId", F.lit("")).alias("reference_parent_span_id"), F.try_element_at(as_map("resource"), F.lit("service.name")).alias("service_name"),
        F.col("x.name").alias("operation_name"), F.col("x.kind").cast("string").alias("span_kind"), status.alias("span_status"),
        start.alias("start_time"), end.alias("end_time"), ((end - start) / 1000).cast("long").alias("duration"), as_map("x.attributes").alias("attributes"),
    )


def severity_text(number: Column) -> Column:
    """The name of a severity number from 0 to 24."""
    return F.coalesce(F.get(F.array(*[F.lit(s) for s in SEVERITIES]), number.cast("int")), F.lit("UNSPECIFIED"))


def metrics(spark: SparkSession, rows: Sequence[dict]) -> DataFrame:
    """metric_samples of a request body, in which a sample without a name or value is an error."""
    for r in rows:
        if not r.get("__name__") or "value" not in r:
            raise ValueError("a metric sample needs __name__ and value")
    return metric_samples(from_json_text(spark, rows))


def metric_samples(df: DataFrame) -> DataFrame:
    """Metric samples of a table with __name__, labels, value and a time, those without name or value left out; the series hash is that of the labels."""
    df = with_timestamp(df).filter("coalesce(__name__, '') <> '' AND value IS NOT NULL")
    own = {"__name__", "__type__", "value", "_timestamp"}
    labels = sorted(c for c in df.columns if c not in own)
    series = F.sha2(F.to_json(F.struct("__name__", *labels)), 256).substr(1, 16)
    return df.withColumn("value", F.col("value").cast("double")).withColumn("__hash__", series)


def write_stream(df: DataFrame, root: str, org: str, kind: str, stream: str, time_column: str = "_timestamp", bloom: Sequence[str] = ()) -> None:
    """Append to files/org/kind/stream by day and hour, newest rows first in each file, with bloom filters where asked."""
    t = F.timestamp_micros(F.col(time_column))
    parts = df.withColumn("dt", F.date_format(t, "yyyy-MM-dd")).withColumn("hr", F.date_format(t, "HH"))
    # One task per hour unless an hour is large: AQE splits it.
    writer = parts.hint("rebalance", "dt", "hr").sortWithinPartitions("dt", "hr", F.col(time_column).desc()).write.mode("append").option("compression", "zstd")
    for c in bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.partitionBy("dt", "hr").parquet(f"{root}/files/{org}/{kind}/{stream}")


def read_stream(spark: SparkSession, root: str, org: str, kind: str, stream: str) -> DataFrame:
    """All files of a stream under their merged schema; dt and hr prune partitions."""
    return spark.read.option("mergeSchema", "true").parquet(f"{root}/files/{org}/{kind}/{stream}")


def import_json(spark: SparkSession, path: str, schema: T.StructType, root: str, org: str, kind: str, stream: str) -> int:
    """Exported rows back into a stream; returns how many."""
    rows = with_timestamp(spark.read.schema(schema).json(path))
    write_stream(rows, root, org, kind, stream)
    return rows.count()


def export_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls left out."""
    df.write.mode("overwrite").json(path)
