"""Search requests: rewrite the SQL, plan it over time-bounded streams, apply sort and limit rules."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.catalog import Catalog, Stream
from tarn.functions import timefn
from tarn.plans import sqltext

DEFAULT_LIMIT = 1000
MAX_LIMIT = 100_000
MAX_OFFSET = 100_000
#: Fields that tell a log record's level, by preference.
LEVEL_FIELDS = ("level", "severity", "severity_text", "log_level", "loglevel", "status", "event_type")


@dataclass
class Request:
    sql: str
    start_us: int | None = None
    end_us: int | None = None
    offset: int = 0
    #: Above 0: that many rows; 0: the default; below 0: no limit.
    size: int = 0
    kind: str = "logs"
    track_total_hits: bool = False
    interval: str | None = None
    add_time_column: bool = False
    #: A column that names a record; put beside the time in plain queries of a stream that has it.
    record_id: str | None = None


class Engine:
    """SQL over the streams of a catalog."""

    def __init__(self, catalog: Catalog):
        self.catalog = catalog
        self.spark = catalog.spark

    # Planning

    def rewrite(self, request: Request) -> tuple[str, list[Stream]]:
        sql = sqltext.qualify(sqltext.drop_placeholders(sqltext.expand_custom(request.sql)))
        streams = self._streams(sql, request.kind)
        if request.track_total_hits:
            sql = sqltext.total_hits(sql)
        if request.add_time_column and len(streams) == 1 and streams[0].time_column:
            sql = sqltext.add_columns(sql, [streams[0].time_column])
        if request.record_id and len(streams) == 1 and request.record_id in streams[0].frame.columns:
            sql = sqltext.add_columns(sql, [request.record_id])
        return self._functions(sql, request, streams), streams

    def _streams(self, sql: str, kind: str) -> list[Stream]:
        """The streams that a query names in FROM, joins and subqueries."""
        out: list[Stream] = []
        for name in sqltext.relations(sql):
            try:
                stream = self.catalog.get(name, kind)
            except KeyError:
                continue  # a CTE, or a table of the session
            if stream not in out:
                out.append(stream)
        return out

    def _functions(self, sql: str, request: Request, streams: list[Stream]) -> str:
        def texts() -> list[str]:
            return [c for s in streams for c in s.text_columns]

        def histogram(args: list[str]) -> str:
            column = args[0].split(".")[-1].strip('"`')
            if len(args) > 1:
                width = timefn.interval_us(sqltext.literal(args[1]))
            elif request.interval:
                width = timefn.interval_us(request.interval)
            else:
                width = timefn.auto_interval_us(request.start_us, request.end_us)
            stream = next((s for s in streams if s.time_column == column), None)
            us = f"unix_micros(CAST({args[0]} AS TIMESTAMP))" if stream is not None and stream.time_is_timestamp else args[0]
            return f"CAST(timestamp_micros(bucket_us({us}, {width})) AS TIMESTAMP_NTZ)"

        def match_all(args: list[str]) -> str:
            self._check_match(sql, streams)
            return "(" + " OR ".join(f"contains(lower({c}), lower({args[0]}))" for c in texts()) + ")"

        def fuzzy_all(args: list[str]) -> str:
            self._check_match(sql, streams)
            return "(" + " OR ".join(f"fuzzy_match({c}, {args[0]}, {args[1] if len(args) > 1 else 1})" for c in texts()) + ")"

        def date_format(args: list[str]) -> str | None:
            if len(args) != 3:
                return None
            pattern = timefn.java_pattern(sqltext.literal(args[1]))
            zone = timefn.zone_of(sqltext.literal(args[2]))
            return f"date_format(from_utc_timestamp(timestamp_micros(time_us({args[0]})), '{zone}'), {sqltext.quoted(pattern)})"

        def rename(name: str):
            return lambda args: f"{name}({', '.join(args)})"

        handlers = {
            "histogram": histogram,
            "match_all": match_all,
            "match_all_raw": match_all,
            "match_all_raw_ignore_case": match_all,
            "fuzzy_match_all": fuzzy_all,
            "date_format": date_format,
            "approx_distinct": rename("approx_count_distinct"),
            "approx_percentile_cont": rename("percentile_approx"),
            "approx_median": lambda args: f"percentile_approx({args[0]}, 0.5)",
            "date_bin": lambda args: f"CAST(timestamp_micros(bucket_us(unix_micros(CAST({args[1]} AS TIMESTAMP)), {timefn.interval_us(re.sub(r'(?i)interval', '', args[0]).strip().strip(chr(39)))})) AS TIMESTAMP_NTZ)",
        }
        return sqltext.rewrite_calls(sql, handlers)

    @staticmethod
    def _check_match(sql: str, streams: list[Stream]) -> None:
        s = sqltext.parse(sql)
        if len(streams) != 1 or s.compound or re.search(r"\bJOIN\b|\(\s*SELECT\b", s.clauses.get("FROM", ""), re.I):
            raise ValueError("full-text match needs one stream, without join, derived table or CTE")
        if not streams[0].text_columns:
            raise ValueError(f"stream {streams[0].name} has no text columns")

    def plan(self, request: Request) -> DataFrame:
        """The query over rows in the request's time range, without the request's sort and limit."""
        sql, streams = self.rewrite(request)
        own = sqltext.own_names(sql)
        views: dict[str, str] = {}
        for s in streams:
            df = s.between(request.start_us, request.end_us)
            df = df.drop(*s.hidden_columns) if s.hidden_columns else df
            names = [s.name] if s.kind == request.kind else []
            if s.kind != request.kind or f"{s.kind}." in sql:
                names.append(f"{s.kind}__{s.name}")
                sql = re.sub(rf"\b{s.kind}\s*\.\s*{re.escape(s.name)}\b", names[-1], sql)
            for name in names:
                # A view of the request's own, so that requests of one session do not meet;
                # a CTE named like the stream it reads needs the name itself.
                view = name if name.lower() in own else f"request_{uuid.uuid4().hex}"
                df.createOrReplaceTempView(view)
                views[name] = view
        try:
            return self.spark.sql(sqltext.with_relations(sql, {name: view for name, view in views.items() if name != view}))
        finally:
            for view in views.values():
                self.spark.catalog.dropTempView(view)

    # Requests

    def search(self, request: Request) -> DataFrame:
        """Rows as a client sees them: newest first unless the query orders, and limited."""
        s = sqltext.parse(request.sql)
        if not 0 <= request.offset <= MAX_OFFSET or request.size > MAX_LIMIT:
            raise ValueError("offset or size out of bounds")
        df = self.plan(request)
        streams = self._streams(request.sql, request.kind)
        if request.track_total_hits:
            return df
        if s.simple and "ORDER" not in s.clauses and len(streams) == 1 and streams[0].time_column in df.columns:
            df = df.orderBy(F.col(streams[0].time_column).desc_nulls_last())
        if "LIMIT" in s.clauses or request.size < 0:
            return df
        df = df.offset(request.offset) if request.offset else df
        # A few rows above the default tell the caller that there were more.
        return df.limit(request.size or DEFAULT_LIMIT + 5)

    def total_hits(self, request: Request) -> DataFrame:
        return self.plan(Request(**{**request.__dict__, "track_total_hits": True}))

    def histogram(self, request: Request, breakdown: str | None = None) -> DataFrame:
        """Rows per time bucket of a plain query (key, num), newest first, by ``breakdown`` if given."""
        where = sqltext.where_of(request.sql)
        streams = self._streams(request.sql, request.kind)
        if len(streams) != 1:
            raise ValueError("a histogram needs one stream")
        by = f", {breakdown} AS breakdown" if breakdown else ""
        sql = f"SELECT histogram({streams[0].time_column}) AS key{by}, count(*) AS num FROM {streams[0].name}"
        sql += f" WHERE {where}" if where else ""
        sql += f" GROUP BY key{', breakdown' if breakdown else ''} ORDER BY key DESC"
        return self.plan(Request(sql, request.start_us, request.end_us, kind=request.kind, interval=request.interval))

    def multi_histogram(self, requests: list[Request]) -> DataFrame:
        """Histograms of several queries, summed by bucket."""
        parts = [self.histogram(r) for r in requests]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.groupBy("key").agg(F.sum("num").alias("num")).orderBy(F.col("key").desc())

    def breakdown_field(self, stream: Stream) -> str | None:
        names = {c.lower(): c for c in stream.frame.columns}
        return next((names[f] for f in LEVEL_FIELDS if f in names), None)

    def around(self, stream: Stream, at_us: int, size: int) -> DataFrame:
        """The size/2 rows at and before a time and the size/2 after it, newest first: two top-k plans."""
        half = max(1, size // 2)
        older = stream.between(None, at_us + 1).orderBy(F.col(stream.time_column).desc()).limit(half)
        newer = stream.between(at_us + 1, None).orderBy(F.col(stream.time_column).asc()).limit(half)
        return older.unionByName(newer).orderBy(F.col(stream.time_column).desc())

    def field_values(self, stream: Stream, fields: list[str], size: int = 10, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
        """The most frequent values of each field (field, value, num)."""
        rows = stream.between(start_us, end_us)
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")
        counted = rows.select(pairs).groupBy("p.field", "p.value").agg(F.count(F.lit(1)).alias("num"))
        # The rank's limit holds before the shuffle too, so a field of very many values sends a few of them.
        order = Window.partitionBy("field").orderBy(F.desc("num"), F.asc_nulls_last("value"))
        return counted.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= size).drop("__rank")

    def cardinality(self, stream: Stream, fields: list[str], exact: bool = False) -> DataFrame:
        """Distinct values per field, in one aggregation."""
        count = F.count_distinct if exact else F.approx_count_distinct
        return stream.frame.agg(*[count(F.col(f)).alias(f) for f in fields])
