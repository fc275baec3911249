"""Token counts through a cache of digests.

A text is brought to a normal form that has the same tokens (runs of white space as one blank, none at the ends; ASCII texts without a mark
of special strings in lower case). Its SHA-256 and the digest of the tokenizer (its file, the library's version, the normal form's version) are the key of a stored count. Keys
are joined with the cache; of keys that it lacks one text each is encoded, and the new counts are appended to the cache.

Which texts are encoded is decided on keys alone, and texts move only if they have to: a bitmap of fixed size tells apart, where they are read, the rows that are surely to be encoded (or surely
not, whichever is the smaller doubt), and only the rest are joined. Texts are encoded word by word, since this tokenizer's words never reach over a blank, with a bounded dictionary of
counts by word; words that it lacks go to the library.

Defined cases: a null or empty text, or one of white space, has no tokens; special strings in a text count as the library counts them (one token); a long text is counted whole; repeated rows
and texts with equal normal forms are encoded once and get a row each; a null doc_id keeps its row; an empty table gives an empty table and leaves the cache as it is; counts that two runs append at once
are equal, and one of them is used; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladderline.llm.common import Tables, apart, arrow_map

#: Tokens of a document above which it is over the limit.
LIMIT = 2048
#: To be raised whenever normal_form changes, so that stored counts of the former one are not found any more.
NORMAL_FORM = 1
#: Among how many keys the rows of one text are spread, so that copies do not meet in one task.
SALTS = 32
# white space that is not a single blank
_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*+|\x20[\x20\x09-\x0D]++"
CACHE = T.StructType([T.StructField("tokenizer", T.StringType()), T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])
_FOUND = pa.schema([("digest", pa.binary()), ("n_tokens", pa.int64())])


def tokenizer_digest(vocabulary: str) -> str:
    """Names what decides a count: the bytes of the tokenizer's file, the library and the normal form."""
    import tokenizers

    return hashlib.sha256(Path(vocabulary).read_bytes() + f"|{tokenizers.__version__}|{NORMAL_FORM}".encode()).hexdigest()


def check_blanks(vocabulary: str) -> None:
    """Raises unless the tokenizer folds and drops white space and lower-cases, on which the normal form and the counting by words rest."""
    model = json.loads(Path(vocabulary).read_text(encoding="utf-8"))
    steps = [(s["type"], s.get("pattern"), s.get("content")) for s in (model["normalizer"] or {}).get("normalizers", [])]
    split = (model["pre_tokenizer"] or {}).get("pretokenizers", [{}])[0]
    plain = not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or set(t["content"]) & set(" \t\n\x0b\f\r") for t in model["added_tokens"])
    if ("Replace", {"Regex": r"\s+"}, " ") not in steps or ("Lowercase", None, None) not in steps or split.get("behavior") != "Removed" or not plain or model["post_processor"]:
        raise ValueError(f"counts by words need a tokenizer that drops white space and lower-cases: {vocabulary}")


def normal_form(text: Column) -> Column:
    """A text with the same tokens. Letters of texts beyond ASCII are left as they are, as marks may compose with them, and so are those of texts where a special string may stand."""
    folded = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), F.lit(_SPACE), F.lit(" ")))
    plain = (F.octet_length(folded) == F.length(folded)) & ~F.contains(folded, F.lit("<|"))
    return F.when(plain, F.lower(folded)).otherwise(folded)


class WordCounts(dict):
    """Tokens of a word, from the library. Of bounded size: when it is full it becomes the older half, from which words in use come back."""

    MOST, LONGEST = 250_000, 64

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.library, self.older = Tokenizer.from_file(vocabulary), {}
        self.library.no_truncation()
        self.library.no_padding()

    def __missing__(self, word: str) -> int:
        n = self.older.get(word)
        if n is None:
            n = len(self.library.encode(word, add_special_tokens=False)) if word else 0
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.older = dict(self)
                self.clear()
            self[word] = n
        return n

    def of_text(self, text: str) -> int:
        return sum(map(self.__getitem__, text.split(" ")))


@lru_cache(maxsize=2)
def word_counts(vocabulary: str) -> WordCounts:
    return WordCounts(vocabulary)


def encoded(rows: DataFrame, vocabulary: str) -> DataFrame:
    """digest and n_tokens of rows of digest and normal form."""

    def of_batch(batch: pa.RecordBatch) -> dict[str, object]:
        counts = word_counts(vocabulary)
        return {"digest": batch.column("digest"), "n_tokens": [counts.of_text(t) for t in batch.column("normal").to_pylist()]}

    return arrow_map(rows.select("digest", "normal"), _FOUND, of_batch)


def read_cache(spark: SparkSession, cache: str, tokenizer: str) -> DataFrame:
    """digest and n_tokens of this tokenizer; no rows if nothing is stored yet. One folder a tokenizer is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE).select("digest", "n_tokens")
    stored = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == tokenizer)
    return stored.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, vocabulary: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """One row a document: n_bytes, n_tokens and over_limit. cache: a folder that the driver and all executors share."""
    check_blanks(vocabulary)
    spark, tables, tokenizer = docs.sparkSession, Tables(docs.sparkSession), tokenizer_digest(vocabulary)
    doc_id, normal = F.col("doc_id").cast("long"), normal_form(F.col("text"))
    digest = F.unhex(F.sha2(F.col("normal"), 256))
    keyed = docs.select(doc_id.alias("doc_id"), F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"), normal.alias("normal")).withColumn("digest", digest).drop("normal")
    # a row's mark tells rows apart where doc_id does not; its low bits spread the copies of a text
    mark = F.xxhash64("doc_id", "digest")
    keyed = tables.cut(keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")), "counts-keyed")
    spread = tables.cut(keyed.groupBy("digest", "salt").agg(F.min(mark).alias("mark"), F.count("*").alias("n")), "counts-spread")
    stored = read_cache(spark, cache, tokenizer)
    distinct = spread.groupBy("digest").agg(F.min("mark").alias("mark"), F.sum("n").alias("n"))
    distinct = tables.cut(distinct.join(stored, "digest", "left"), "counts-distinct")
    todo = distinct.where("n_tokens is null").select("digest", "mark")

    n_todo, n_rows = distinct.agg(F.count_if(F.col("n_tokens").isNull()), F.sum("n")).first()
    if n_todo:
        rows = docs.select(normal.alias("normal"), doc_id.alias("own_id")).withColumn("digest", digest).withColumn("doc_id", F.xxhash64(F.col("own_id"), F.col("digest"))).drop("own_id")
        if 2 * n_todo > n_rows:  # fewer rows are to be left out than to be encoded
            others = keyed.select("digest", mark.alias("mark")).join(todo, ["digest", "mark"], "left_anti").select(F.col("mark").alias("doc_id"))
            perhaps, surely = apart(rows, others)
        else:
            perhaps, surely = apart(rows, todo.select(F.col("mark").alias("doc_id")))[0], None
        perhaps = perhaps.join(todo.withColumnRenamed("mark", "doc_id"), ["digest", "doc_id"], "left_semi")
        new = encoded(perhaps if surely is None else perhaps.select("digest", "normal").unionByName(surely.select("digest", "normal")), vocabulary)
        # a row that is repeated with its doc_id is encoded as often as it stands
        new = tables.cut(new.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens")), "counts-new")
        new.select(F.lit(tokenizer).alias("tokenizer"), "digest", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache)
        known = distinct.where("n_tokens is not null").select("digest", "n_tokens").unionByName(new)
    else:
        known = distinct.select("digest", "n_tokens")
    by_salt = spread.select("digest", "salt").join(known, "digest")
    out = keyed.join(by_salt, ["digest", "salt"]).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    return tables.only(out, "counts-result")
