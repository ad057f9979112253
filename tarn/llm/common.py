"""Shared helpers: input tables, the cluster's scratch folder, Arrow row mapping."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rows handed to a batch function at once; bounds a worker's memory, not the result.
ROWS_PER_BATCH = 512
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only in local mode."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    master = conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")


class Scratch:
    """Tables written once into the shared folder, so that a lost executor costs a reread only."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/tarn-{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, partition_by: Sequence[str] = (), dictionary_mb: int = 1) -> DataFrame:
        """Write df as Parquet and return the table read back with the schema it had.

        The shuffles that made it go when it is written: they would else stay
        on the executors' disks until the driver collects its garbage.
        """
        path = self.path(name)
        writer = df.write.mode("overwrite").option("compression", "zstd").option("parquet.dictionary.page.size", dictionary_mb << 20)
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def map_rows(
    df: DataFrame,
    text_col: str,
    fields: T.StructType,
    batch_fn: Callable[[list], dict[str, list]],
    carry: Sequence[str] | None = None,
    as_bytes: bool = True,
    rows_per_batch: int = ROWS_PER_BATCH,
) -> DataFrame:
    """Add ``fields`` computed from ``text_col`` by ``batch_fn``, keeping the columns ``carry`` (all by default).

    batch_fn gets a list of texts (UTF-8 bytes if as_bytes, else str; None for
    null) and returns a list per field. A carried column whose name equals a
    new field is replaced by the new field.
    """
    carry = list(df.columns if carry is None else carry)
    names = {f.name.lower() for f in fields.fields}
    inside = text_col in carry
    packed = df.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], F.lit(0).alias("pad")).alias("row"),
        *([] if inside else [F.col(f"`{text_col}`").alias("text")]),
    )
    out_schema = T.StructType([packed.schema["row"], T.StructField("out", fields)])
    at = carry.index(text_col) if inside else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow_out = to_arrow_schema(fields)
        for whole in batches:
            for start in range(0, whole.num_rows, rows_per_batch):
                batch = whole.slice(start, rows_per_batch)
                row = batch.column(0)
                text = row.field(at) if inside else batch.column(1)
                values = (text.cast(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary()) if as_bytes else text).to_pylist()
                got = batch_fn(values)
                out = pa.StructArray.from_arrays([pa.array(got[f.name], f.type) for f in arrow_out], fields=list(arrow_out))
                yield pa.RecordBatch.from_arrays([row, out], names=["row", "out"])

    mapped = packed.mapInArrow(run, out_schema)
    kept = [F.col("row").getField(f"c{i}").alias(c) for i, c in enumerate(carry) if c.lower() not in names]
    return mapped.select(*kept, *[F.col("out").getField(f.name).alias(f.name) for f in fields.fields])


def null_safe(left: DataFrame, right: DataFrame, pairs: Iterable[tuple[str, str]]) -> Column:
    """Join condition over pairs of columns that holds for two nulls as well."""
    cond = None
    for a, b in pairs:
        one = left[a].eqNullSafe(right[b])
        cond = one if cond is None else cond & one
    return cond
