"""Streams: Parquet-backed tables by kind, with a time column and text columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("logs", "metrics", "traces", "metadata", "enrichment")
#: Types that a column may take on as batches with other types arrive, narrowest first.
_WIDER = ["tinyint", "smallint", "int", "bigint", "float", "double", "string"]


class Stream:
    """A table with its roles; a path is opened when its columns are first needed."""

    def __init__(self, name: str, kind: str, source: DataFrame | Callable[[], DataFrame], time_column: str | None = None, text_columns: Sequence[str] | None = None, hidden_columns: Sequence[str] = ()):
        self.name = name
        self.kind = kind
        self.hidden_columns = tuple(hidden_columns)
        self._source = source
        self._time = time_column
        self._text = text_columns

    @cached_property
    def frame(self) -> DataFrame:
        return self._source if isinstance(self._source, DataFrame) else self._source()

    @cached_property
    def time_column(self) -> str | None:
        return self._time or ("_timestamp" if "_timestamp" in self.frame.columns else None)

    @cached_property
    def text_columns(self) -> list[str]:
        return list(self._text) if self._text is not None else [f.name for f in self.frame.schema if isinstance(f.dataType, T.StringType)]

    @property
    def time_is_timestamp(self) -> bool:
        return self.time_column is not None and not isinstance(self.frame.schema[self.time_column].dataType, (T.LongType, T.IntegerType))

    def time_us(self):
        """The time column in microseconds."""
        c = F.col(self.time_column)
        return F.unix_micros(c.cast("timestamp")) if self.time_is_timestamp else c

    def between(self, start_us: int | None, end_us: int | None) -> DataFrame:
        """Rows from start (included) to end (excluded); bounds are literals of the column's type, so they reach the scan."""
        df = self.frame
        if self.time_column is None:
            return df
        kind = self.frame.schema[self.time_column].dataType.simpleString()
        for bound, keep in ((start_us, "__ge__"), (end_us, "__lt__")):
            if bound is not None:
                literal = F.timestamp_micros(F.lit(bound)).cast(kind) if self.time_is_timestamp else F.lit(bound)
                df = df.filter(getattr(F.col(self.time_column), keep)(literal))
        return df


class Catalog:
    """The streams of a session; two kinds may hold streams of one name."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.streams: dict[tuple[str, str], Stream] = {}

    def register(self, name: str, source: str | DataFrame, kind: str = "logs", time_column: str | None = None, text_columns: Sequence[str] | None = None, hidden_columns: Sequence[str] = ()) -> Stream:
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind!r}")
        opened = (lambda: self.spark.read.parquet(source)) if isinstance(source, str) else source
        stream = Stream(name, kind, opened, time_column, text_columns, hidden_columns)
        self.streams[(kind, name)] = stream
        return stream

    def get(self, name: str, kind: str = "logs") -> Stream:
        """The stream ``name`` or ``kind.name``; an unknown one is an error."""
        if "." in name:
            kind, name = name.split(".", 1)
        if (kind, name) not in self.streams:
            raise KeyError(f"no stream {kind}.{name}")
        return self.streams[(kind, name)]


def merge_schemas(old: T.StructType, new: T.StructType) -> T.StructType:
    """The fields of both by name; a field with two types takes the wider, in the end string."""
    fields = {f.name: f.dataType for f in old}
    for f in new:
        have = fields.get(f.name)
        if have is None or isinstance(have, T.NullType):
            fields[f.name] = f.dataType
        elif have != f.dataType and not isinstance(f.dataType, T.NullType):
            a, b = have.simpleString(), f.dataType.simpleString()
            known = a in _WIDER and b in _WIDER
            fields[f.name] = have if known and _WIDER.index(a) >= _WIDER.index(b) else f.dataType if known else T.StringType()
    return T.StructType([T.StructField(n, fields[n]) for n in sorted(fields)])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with the columns of schema, absent ones null."""
    have = set(df.columns)
    return df.select(*[(F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema])


def union_streams(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames under their merged schema, columns by name."""
    schema = frames[0].schema
    for f in frames[1:]:
        schema = merge_schemas(schema, f.schema)
    out = conform(frames[0], schema)
    for f in frames[1:]:
        out = out.unionByName(conform(f, schema))
    return out
