"""Document fingerprints: a digest of the quartiles of hashed byte-triplet counts.

A window of fourteen bytes slides over the UTF-8 text; three spaced byte triplets in it, which reach over a word's end and so
depend on the text more than on its language, are hashed into buckets and counted. The digest has two bits a bucket (which quartile of the counts the bucket lies in), the text's length
on a logarithmic scale, and a check byte. Two digests are compared by the sum of the quartile distances and of the
length distance, scaled so that equal digests score 1 and the score stays in 0 to 1.

Defined cases: a null text counts as empty; texts shorter than the window are padded with zero bytes; a long text is one text like any other, and no more than
two texts are held at a time beside an Arrow batch; equal texts always have equal digests. Rows are ordered by doc_id, descending; rows that repeat one, by text
hash and text; rows without one come last, in an order that their text hashes fix. A single row is followed by itself; an empty table gives an
empty table. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ladderline.llm.common import id_and_text

BUCKETS = 256
#: Places of a triplet's second and third byte after its first.
_TRIPLETS = ((4, 9), (5, 11), (6, 13))
_HASH = np.random.default_rng(20260101).integers(0, BUCKETS, (len(_TRIPLETS), 3, 256), dtype=np.uint16)
#: Length steps a factor of two, and what a step of length distance costs against a quartile step.
_LENGTH_STEPS, _LENGTH_COST = 4, 2.0
RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def bucket_counts(data: bytes) -> np.ndarray:
    """Counts of the hashed triplets."""
    b = np.frombuffer(data if len(data) >= 14 else data + bytes(13), np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for (i, j), (first, second, third) in zip(_TRIPLETS, _HASH, strict=True):
        if len(b) > j:
            counts += np.bincount(first[b[:-j]] ^ second[b[i : i - j]] ^ third[b[j:]], minlength=BUCKETS)
    return counts


def fingerprint(text: str) -> str:
    """Hexadecimal: length byte, check byte, then two bits a bucket."""
    data = text.encode("utf-8", "surrogatepass")
    counts = bucket_counts(data)
    q1, q2, q3 = np.partition(counts, [BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4])[[BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4]]
    codes = ((counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)).astype(np.uint8)
    packed = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    length = min(255, round(_LENGTH_STEPS * math.log2(1 + len(data))))
    return bytes([length, zlib.crc32(data) & 255]).hex() + packed.astype(np.uint8).tobytes().hex()


def _codes(digest: str) -> tuple[int, int, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex(digest), np.uint8)
    return int(raw[0]), int(raw[1]), np.stack([raw[2:] >> s & 3 for s in (0, 2, 4, 6)], 1).ravel().astype(np.int8)


def likeness(a: str, b: str) -> float:
    """1 for equal digests; falls with the difference score, never below 0."""
    if a == b:
        return 1.0
    (la, ca, qa), (lb, cb, qb) = _codes(a), _codes(b)
    steps = np.abs(qa - qb)
    # a jump over two or three quartiles is rarer by chance than its share of steps, and counts more
    score = float(np.sum(steps) + np.sum(steps == 3) * 2) + _LENGTH_COST * abs(la - lb) + (ca != cb)
    most = 5.0 * BUCKETS + _LENGTH_COST * 255 + 1
    return 1.0 - min(score, most) / most


def edited_text(text: str, following: str) -> str:
    """The last third replaced by as much of the start of the following text, or all of it."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def compare_with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Every text's digest, that of its edited text, and the likeness to that and to the next document (descending doc_id).

    Documents go to contiguous ranges of doc_id, whose bounds are quantiles of doc_id, one range a partition. Spark sorts each range, and it is read as a stream
    that holds one text over. The first document of a range also visits the end of the range before it, so that every document meets the next one with its text
    shuffled once. Rows without doc_id come last, in ranges by hash.
    """
    spark = docs.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = id_and_text(docs).withColumn("hash", F.xxhash64("text"))
    quantiles = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    bounds = np.unique(np.array(quantiles or [], np.int64))
    last = len(bounds)

    def range_of(ids: pa.Array, hashes: pa.Array) -> np.ndarray:
        out = last + 1 + (hashes.to_numpy() % parts)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        out[known] = last - np.searchsorted(bounds, ids.drop_null().to_numpy(), "left")
        return out

    # ids travel as Arrow columns: a column with nulls would be rounded to doubles on its way to pandas
    @F.arrow_udf("long")
    def own_range(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        return pa.array(range_of(ids, hashes), pa.int64())

    key = F.struct(F.bitwise_not("doc_id").alias("down"), "hash")
    heads = sorted((head.range, tuple(head.key)) for head in rows.select(own_range("doc_id", "hash").alias("range"), key.alias("key")).groupBy("range").agg(F.min("key").alias("key")).collect())
    #: the first document of each range (one a range) and the range that it visits
    visits = {key: heads[k - 1][0] for k, (_, key) in enumerate(heads)}

    @F.arrow_udf("array<long>")
    def ranges(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        keys = zip((None if i is None else ~i for i in ids.to_pylist()), hashes.to_pylist(), strict=True)
        return pa.array([[r, -1 - visits[k]] if k in visits else [r] for r, k in zip(range_of(ids, hashes).tolist(), keys, strict=True)], pa.list_(pa.int64()))

    dealt = rows.withColumn("at", F.explode(ranges("doc_id", "hash"))).withColumn("visits", F.col("at") < 0)
    dealt = dealt.withColumn("range", F.when(F.col("visits"), -1 - F.col("at")).otherwise(F.col("at")).cast("int"))
    # visitors stand last; only the first of them, in the order of rows, is met
    placed = dealt.repartitionById(last + 1 + parts, F.col("range")).sortWithinPartitions("range", "visits", F.col("doc_id").desc_nulls_last(), "hash", "text")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            out = []
            for doc_id, text, visits in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "visits")), strict=True):
                # a visitor ends its range, so that the row before it is of the same one
                digest = fingerprint(text) if held is not None or not visits else ""
                if held is not None:
                    edited = edited_text(held[1], text)
                    of_edited = fingerprint(edited)
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((held[0], len(held[1]), sha, held[2], of_edited, likeness(held[2], of_edited), likeness(held[2], digest)))
                held = None if visits else (doc_id, text, digest)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), RESULT, strict=True)], schema=RESULT)

    return placed.select("doc_id", "text", "visits").mapInArrow(stream, from_arrow_schema(RESULT))
