"""Written intermediates in the folder that the cluster shares.

A table written here cuts the lineage: a lost executor costs a re-read, never a
re-run of what came before.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapwise.session import scratch_path


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_by_key(df: DataFrame, name: str, key: str) -> str:
    """Write ``df`` below the shared folder in buckets of ``key``; the name of the table.

    Joins on the key then shuffle the other side alone, however often they
    read the table.  Give the name to :func:`forget_table` in the end.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    (df.write.format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", scratch_path(spark, name)).saveAsTable(table))
    return table


def forget_table(spark: SparkSession, table: str) -> None:
    """Delete a table made by :func:`keep_by_key`, files included."""
    rows = spark.table(table)
    forget(spark, rows)
    spark.sql(f"drop table if exists {table}")


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables made by :func:`keep` that nothing reads any more."""
    for table in tables:
        for file in table.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, so that other columns can never clash."""
    return df.select([F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def texts_of(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null is empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: int,
           most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of each part stays near ``most_bytes``."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = max(1, batch.column(column).nbytes)
        rows = max(1, int(batch.num_rows * most_bytes / size))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    give_back()


def give_back() -> None:
    """Return freed memory to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library keeps its own rules
        pass


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound Arrow batches by bytes too, so that wide rows never pile up in a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
