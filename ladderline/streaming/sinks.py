"""Appending from a stream exactly once.

Every micro-batch has a folder of its own, named by its id. A batch that is written again after a failure replaces its folder; a folder counts
only once its write has been committed. So neither a batch that is replayed nor one that broke off halfway adds anything, and readers see whole batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ladderline.model import RANK_HISTORY
from ladderline.sources.store import PARTITIONS, new_rows, row_key, snapshot_rows

BATCH = "stream_batch"


def committed_batches(spark: SparkSession, path: str) -> list[int]:
    """Ids of the batches whose write was committed, in order: one listing of the table's folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    done = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(where, f"{BATCH}=*/_SUCCESS"))
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in done or [])


def read_batches(spark: SparkSession, path: str, schema: StructType | str, before: int | None = None) -> DataFrame:
    """Rows of the committed batches, with their id in stream_batch; `before` leaves out that batch and later ones."""
    ids = [k for k in committed_batches(spark, path) if before is None or k < before]
    reader = spark.read.schema(schema).option("basePath", path)
    if ids:
        return reader.parquet(*[f"{path}/{BATCH}={k}" for k in ids])
    empty = spark.createDataFrame([], schema)
    return empty if BATCH in empty.columns else empty.withColumn(BATCH, F.lit(None).cast("int"))


def write_batch(rows: DataFrame, path: str, batch: int, by: list[str] | None = None) -> None:
    rows.write.mode("overwrite").partitionBy(*(by or [])).parquet(f"{path}/{BATCH}={batch}")


def appended_history(spark: SparkSession, path: str) -> DataFrame:
    return read_batches(spark, path, RANK_HISTORY)


def append_history(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: appends a batch's rows whose key is neither stored by an earlier batch nor met earlier in the batch.

    A replayed batch is compared with the batches before it alone, not with what it wrote itself, and so gives the same rows again. Only stored
    rows of the batch's markets, categories and dates are read. Rows are numbered by batch, and in a batch by their own order.
    """

    def append(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        rows = rows.persist()
        try:
            found = rows.agg(F.min("date_kst").alias("first"), F.max("date_kst").alias("last"), F.count_if(F.col("date_kst").isNull()).alias("undated")).first()
            stored = read_batches(spark, path, RANK_HISTORY, before=batch)
            base = (stored.agg(F.max("row_seq")).first()[0] or 0) + 1  # from the files' statistics
            if not found["undated"] and found["first"] is not None:
                stored = stored.where(F.col("date_kst").between(found["first"], found["last"]))
            folders = rows.select(*(F.coalesce(c, F.lit("")).alias(c) for c in PARTITIONS)).distinct()
            stored = stored.withColumn("_key", F.coalesce("row_key", row_key())).join(folders, [F.coalesce(stored[c], F.lit("")) == folders[c] for c in PARTITIONS], "left_semi")
            added = snapshot_rows(new_rows(rows, stored.drop("row_key").withColumnRenamed("_key", "row_key")))
            write_batch(added.withColumn("row_seq", F.col("row_seq") + base), path, batch, PARTITIONS)
        finally:
            rows.unpersist()

    return append
