"""Plumbing that the operators share: inputs, tables in the shared folder, Arrow mapping, bitmaps of keys."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

#: Bits of a key bitmap: 2^25 bits are 4 MB, whatever the number of keys.
BITMAP_BITS = 25


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text counts as empty, other columns are left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A temporary one is set where a local session names none; a cluster has to name one."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='checkpoints-')}"
        spark.sparkContext.setCheckpointDir(where)
    return where


#: Paths that cut() and Tables have written, in order.
_WRITTEN: list[str] = []


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows to the shared folder and reads them back: the lineage ends there, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def tables_written() -> int:
    """How many tables have been written so far, as a mark for remove_tables()."""
    return len(_WRITTEN)


def remove_tables(spark: SparkSession, since: int, but_last: int = 0) -> None:
    """Removes the tables that have been written since a mark, but for the last ones. Nothing that is read later may depend on them."""
    for path in _WRITTEN[since : len(_WRITTEN) - but_last]:
        remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Tables:
    """Tables that one operator writes on its way, so that they can be removed when its result is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.parquet(path)
        _WRITTEN.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def only(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the result and removes all other tables."""
        before, self.paths = self.paths, []
        out = self.cut(df, name)
        for path in before:
            remove(self.spark, path)
        return out


def where_computed(rows: DataFrame, condition: Column) -> DataFrame:
    """Keeps rows by a costly condition that is computed once.

    Catalyst copies the expressions of a filter's columns below it, also into lambdas that run them again and again; it
    does not move a filter past a row number.
    """
    return rows.withColumns({"_keep": condition, "_number": F.monotonically_increasing_id()}).where(F.col("_keep") & (F.col("_number") >= 0)).drop("_keep", "_number")


def arrow_map(df: DataFrame, schema: pa.Schema, of_batch: Callable[[pa.RecordBatch], dict[str, object] | None], rows: int = 512) -> DataFrame:
    """mapInArrow with a function from a batch, of so many rows at most, to columns by name. Small batches keep a worker's memory low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, rows) for whole in batches for at in range(0, whole.num_rows, rows)):
            if (columns := of_batch(batch)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

    return df.mapInArrow(run, from_arrow_schema(schema))


def text_map(docs: DataFrame, fields: list[tuple[str, pa.DataType]], of_text: Callable[[str], tuple]) -> DataFrame:
    """doc_id and, for each whole text, the fields that the function returns."""
    schema = pa.schema([("doc_id", pa.int64()), *fields])
    names = [name for name, _ in fields]

    def of_batch(batch: pa.RecordBatch) -> dict[str, object]:
        rows = [of_text(text) for text in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), **dict(zip(names, zip(*rows, strict=True), strict=True))}

    return arrow_map(id_and_text(docs), schema, of_batch)


def key_bitmap(keys: DataFrame, hashed: Column) -> bytearray | None:
    """A bitmap of fixed size with the bit of each hashed key set; None if there is no key.

    Built by a distributed aggregate; at most 2^BITMAP_BITS / 8 bytes reach the driver. Other keys may share a bit:
    who uses it to skip rows has to join on the key itself afterwards.
    """
    position = F.pmod(hashed, F.lit(1 << BITMAP_BITS)) + 1
    parts = keys.select(position.alias("at")).groupBy(F.expr("bitmap_bucket_number(at)").alias("part")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(at))").alias("bits"))
    bits = None
    for part, chunk in parts.collect():
        bits = bits or bytearray((1 << BITMAP_BITS) // 8)
        bits[(part - 1) * len(chunk) : part * len(chunk)] = chunk
    return bits


def in_bitmap(bits: bytes, key: bytes) -> bool:
    """Whether the bit of this key, hashed by CRC-32, is set."""
    at = zlib.crc32(key) & ((1 << BITMAP_BITS) - 1)
    return bits[at >> 3] >> (at & 7) & 1 == 1


def apart(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose doc_id may be among the ids, and rows whose doc_id is not (or is null), without a shuffle of the rows.

    The first are to be joined with the ids. So texts that no id concerns are not shuffled. What is broadcast is a bitmap of fixed size, in chunks of 4 kB,
    one of which each row meets.
    """
    position = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << BITMAP_BITS)) + 1
    chunk, bit = F.call_function("bitmap_bucket_number", F.col("_at")), F.call_function("bitmap_bit_position", F.col("_at"))
    known = ids.where("doc_id is not null").select(position.alias("_at"))
    bits = known.groupBy(chunk.alias("_chunk")).agg(F.call_function("bitmap_construct_agg", bit).alias("_bits"))
    placed = rows.withColumn("_at", F.when(F.col("doc_id").isNotNull(), position)).withColumn("_chunk", chunk)
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))
    marked = placed.join(F.broadcast(bits), "_chunk", "left").withColumn("_may", may)
    return tuple(marked.where(c).drop("_at", "_chunk", "_bits", "_may") for c in (F.col("_may"), ~F.col("_may")))
