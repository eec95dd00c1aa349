"""What the corpus operators share: reading, lineage cuts in the shared folder, Arrow helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed on by one Arrow batch of results.
OUT_ROWS = 2000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where a session on one machine names none (tests) is a folder made and set; on a cluster executors would not see it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="quern-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder, removed when the driver's Python ends."""
    path = f"{shared_root(spark)}/quern-{what}-{uuid.uuid4().hex}"
    atexit.register(_remove_quietly, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        if spark._jsc.sc().isStopped():
            return
        remove(spark, path)
    except Exception:  # the session has gone; nothing is left to clean with
        pass


def cut(df: DataFrame, what: str, partition_by: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage ends here, on storage that outlives executors."""
    spark = df.sparkSession
    path = path or shared_path(spark, what)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or one made from it that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_bytes(column: str) -> Column:
    """A text column as its UTF-8 bytes, null as no bytes; Python then works on bytes without decoding."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def map_rows(df: DataFrame, make: Callable[[], Callable[..., tuple]], schema: str, fields: list[tuple[str, pa.DataType]]) -> DataFrame:
    """One result row per input row. ``make`` runs once per task and returns the function of a row's values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for row_group in slices(batches):
            yield from to_batches([one(*row) for row in row_group], fields)

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[list[tuple]]:
    """The rows of Arrow batches as Python tuples, a few at a time so that long texts are not all held twice."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield list(zip(*(c.to_pylist() for c in batch.slice(at, rows).columns), strict=True))


def to_batches(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), OUT_ROWS):
        columns = list(zip(*rows[at : at + OUT_ROWS], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])
