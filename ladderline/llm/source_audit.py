"""Source divergence audit: how far the term frequencies of a language's sources lie from one another, and which terms make a source special.

Sketch-prefiltered counting. A first pass over the texts fills a count-min sketch of document frequencies by (lang, term) in every task, with counters that stop
at the threshold; sketches are merged by adding. A counter never underestimates, so a term with one counter below the threshold is not in enough documents.
A second pass counts terms by (lang, source) in every task and hands on only those that the sketch does not rule out, before anything is shuffled; survivors are
counted exactly. Shares of kept terms are integers (billionths), and divergences are exact integer sums.

Pairs of sources are joined sparsely, over the sources that a term occurs in. Terms that a source lacks all have one share there, so a sum over all kept terms is: what the other source's terms give
against that share (from a histogram of its counts), the same the other way round, a correction for terms that both have (the only ones that are joined, and counted by their pair of counts
before shares are looked up), and the two shares of absent terms against each other for all remaining terms.

Defined cases: null text, lang and source count as empty; a text without terms still makes its group occur; a language without kept terms gives pairs of value 0; equal values are ranked by
item; repeated rows are documents each; a long text is counted whole, in pieces of bounded size; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ladderline.llm.common import Tables
from ladderline.llm.kernels import RangeHashes, mixed

#: Documents of a language that a kept term is in, at least; terms reported of a group, at most.
MIN_DOCS, TOP_TERMS = 3, 200
#: Rows of the sketch and counters in a row, of one byte each; a task holds all of them, and one bit of each is broadcast.
SKETCH_ROWS, SKETCH_WIDTH = 4, 1 << 22
_BLOCK = 1 << 16
#: Entries that a task counts before it hands them on, at most (about 150 bytes each), and bytes of texts that are hashed at once.
HELD, HASHED = 1_000_000, 1 << 20
#: How often a group's totals are repeated among the keys of a join, so that a group's terms do not meet in one task.
SALTS = 16
#: Bytes of terms, A-Z as a-z; all others as blanks.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_LOWER_ARRAY = np.frombuffer(_LOWER, np.uint8)
_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("n_docs", pa.int64())])
_CELLS = pa.schema([("block", pa.int32()), ("cells", pa.binary())])


def _texts(docs: DataFrame) -> DataFrame:
    empty = F.lit("")
    return docs.select(F.coalesce(F.col("lang").cast("string"), empty).alias("lang"), F.coalesce(F.col("source").cast("string"), empty).alias("source"), F.coalesce(F.col("text"), empty).cast("binary").alias("text"))


def _hashes(strings: list[bytes]) -> np.ndarray:
    """64-bit hashes of terms, in pieces of bounded size."""
    sizes = np.array([len(x) for x in strings], np.int64)
    ends, out, at = np.cumsum(sizes), np.zeros(len(strings), np.uint64), 0
    while at < len(strings):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HASHED, "right")))
        last = np.cumsum(sizes[at:to])
        out[at:to] = RangeHashes(np.frombuffer(b"".join(strings[at:to]), np.uint8)).of(last - sizes[at:to], last)
        at = to
    return out


def term_hashes(text: bytes) -> np.ndarray:
    """Hashes of the distinct terms of a text, which is cut between terms into pieces of bounded size."""
    found, at = [], 0
    while at < len(text):
        to = len(text)
        if to - at > HASHED:
            piece = text[at : at + HASHED].translate(_LOWER)
            to = at + (piece.rfind(b" ") + 1 or len(piece))
            while to < len(text) and _LOWER[text[to - 1]] != 32:  # a term as long as a piece
                to += 1
        b = _LOWER_ARRAY[np.frombuffer(text, np.uint8, to - at, at)]
        inside = np.zeros(len(b) + 2, bool)
        inside[1:-1] = b != 32
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        found.append(RangeHashes(b).of(edges[0::2], edges[1::2]))
        at = to
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def sketch_places(lang: str, hashes: np.ndarray, rows: int, width: int) -> np.ndarray:
    """Where terms of a language, given by their hashes, stand in each row of the sketch."""
    key = mixed(_hashes([lang.encode()]) + np.uint64(0x9E3779B97F4A7C15)) ^ hashes
    return np.stack([(mixed(key + np.uint64(k * 0xD1B54A32D192ED03 % 2**64)) >> np.uint64(65 - width.bit_length())).astype(np.int64) for k in range(rows)])


def frequency_sketch(docs: DataFrame, min_docs: int, rows: int = SKETCH_ROWS, width: int = SKETCH_WIDTH) -> np.ndarray:
    """Which counters of the merged sketch reach min_docs: packed bits, row after row."""
    blocks = max(1, width // _BLOCK)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((rows, width), np.uint8)

        def add(by_lang: dict[str, list[np.ndarray]]) -> None:
            for lang, found in by_lang.items():
                for own, places in zip(cells, sketch_places(lang, np.concatenate(found), rows, width), strict=True):
                    at, n = np.unique(places, return_counts=True)
                    own[at] = np.minimum(own[at] + n, min_docs)
            by_lang.clear()

        by_lang: dict[str, list[np.ndarray]] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                found = term_hashes(text.as_py())
                by_lang.setdefault(lang, []).append(found)
                held += len(found)
                if held > HELD:
                    add(by_lang)
                    held = 0
        add(by_lang)
        split = cells.reshape(rows * blocks, -1)
        for at in np.flatnonzero(split.any(1)):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(split[at].tobytes(), 1)], pa.binary())], schema=_CELLS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, packed in zip(batch.column("block").to_pylist(), batch.column("cells"), strict=True):
                more = np.frombuffer(zlib.decompress(packed.as_py()), np.uint8)
                sums[at] = np.minimum(sums[at] + more.astype(np.uint16), min_docs).astype(np.uint8) if at in sums else more
        for at, cells in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(cells >= min_docs).tobytes()], pa.binary())], schema=_CELLS)

    bits = np.zeros((rows * blocks, width // blocks // 8), np.uint8)
    parts = _texts(docs).select("lang", "text").mapInArrow(fill, from_arrow_schema(_CELLS))
    for at, packed in parts.repartition("block").mapInArrow(merge, from_arrow_schema(_CELLS)).collect():  # a bit for each counter, whatever the input
        bits[at] = np.frombuffer(packed, np.uint8)
    return bits.reshape(rows, -1)


def possible_terms(docs: DataFrame, bits: np.ndarray, width: int = SKETCH_WIDTH) -> DataFrame:
    """Per task: occurrences and documents of every (lang, source, term) that the sketch does not rule out."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, n_docs) in groups.items():
                terms = list(n)
                places = sketch_places(lang, _hashes(terms), len(shared.value), width)
                alive = np.logical_and.reduce([(own[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 for own, at in zip(shared.value, places, strict=True)]).astype(bool)
                size = int(alive.sum())
                same = lambda value: pa.DictionaryArray.from_arrays(pa.array(np.zeros(size, np.int32)), pa.array([value], pa.string())).dictionary_decode()  # noqa: E731, B023
                numbers = (np.fromiter(x, np.int64, len(terms))[alive] for x in (n.values(), map(n_docs.__getitem__, terms)))
                yield pa.RecordBatch.from_arrays([same(lang), same(source), pa.array(terms, pa.binary()).filter(pa.array(alive)).cast(pa.string()), *map(pa.array, numbers)], schema=_COUNTED)
            groups.clear()

        held = 0
        for batch in batches:
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
                if (lang, source) not in groups:
                    groups[lang, source] = Counter(), Counter()
                n, n_docs = groups[lang, source]
                terms = text.as_py().translate(_LOWER).split()
                held -= len(n)
                n.update(terms)
                n_docs.update(set(terms))
                held += len(n)
                if held > HELD:
                    yield from handed_on()
                    held = 0
        yield from handed_on()

    return _texts(docs).mapInArrow(run, from_arrow_schema(_COUNTED))


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)), in three steps of a thousand, so that 64 bits do for totals up to 10^15."""
    div = lambda a, b: F.call_function("div", a, b)
    whole = F.greatest(total + terms, F.lit(1))
    first = (n + 1) * 1000
    second = (first % whole) * 1000
    third = (second % whole) * 1000
    return 1 + div(first, whole) * 1_000_000 + div(second, whole) * 1000 + div(third, whole)


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def audit_sources(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, sketch_width: int = SKETCH_WIDTH) -> DataFrame:
    """Parts pair and term of every (lang, source) group: lang, source, part, item, value, rank."""
    tables = Tables(docs.sparkSession)
    # tasks have counted already, so that rows of a term are at most as many as tasks and sources, and go where all that follows meets
    found = possible_terms(docs, frequency_sketch(docs, min_docs, width=sketch_width), sketch_width).repartition("lang", "term")
    exact = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))
    terms = exact.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("n_docs").alias("in_docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("own"))  # an entry for each source of the language
    terms = tables.cut(terms.where(F.col("in_docs") >= min_docs).drop("in_docs"), "audit-terms")
    entries = terms.select("lang", "term", "of_lang", F.explode("own").alias("own")).select("lang", "term", "of_lang", "own.*")

    own = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("size"))
    groups = _texts(docs).select("lang", "source").distinct().join(own, ["lang", "source"], "left").na.fill(0)
    langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("of_lang").alias("of_lang_total"))
    groups = groups.join(langs, "lang", "left").na.fill(0)
    # as many rows as there are groups: joins below broadcast it only where Spark finds it small enough
    groups = tables.cut(groups.withColumn("absent", share(F.lit(0).cast("long"), F.col("total"), F.col("terms"))), "audit-groups")

    result = pair_rows(terms, entries, groups).unionByName(term_rows(entries, groups, top))
    return tables.only(result, "audit-result")


def pair_rows(terms: DataFrame, entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Part pair: every two groups of a language, both ways."""
    exact = lambda c: c.cast("decimal(20,0)")
    of = lambda side: groups.select("lang", *(F.col(c).alias(f"{side}_{c}") for c in ("source", "total", "size", "absent")), *(["terms"] if side == "a" else []))
    both_ways = lambda rows, value: rows.select("lang", F.explode(F.array(*(F.struct(F.col(f"{x}_source").alias("source"), F.col(f"{y}_source").alias("item"), value(x, y).alias("value")) for x, y in (("a", "b"), ("b", "a"))))).alias("v")).select("lang", "v.*")

    met = groups.select("lang", F.col("source").alias("a_source"), F.col("absent").alias("a_absent"), F.col("size").alias("a_size"), "terms").join(groups.select("lang", F.col("source").alias("b_source"), F.col("absent").alias("b_absent"), F.col("size").alias("b_size")), "lang")
    neither = met.where("a_source < b_source")
    neither = both_ways(neither, lambda x, y: exact(F.col("terms") - F.col("a_size") - F.col("b_size")) * exact(divergence(F.col(f"{x}_absent"), F.col(f"{y}_absent"))))

    histogram = entries.groupBy("lang", "source", "n").agg(F.count("*").alias("m")).join(groups, ["lang", "source"])
    histogram = histogram.select("lang", F.col("source").alias("a_source"), "m", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"))
    one = histogram.join(groups.select("lang", F.col("source").alias("b_source"), F.col("absent").alias("b_absent")), "lang").where("a_source <> b_source")
    one = both_ways(one, lambda x, y: exact(F.col("m")) * exact(divergence(F.col("p"), F.col("b_absent")) if x == "a" else divergence(F.col("b_absent"), F.col("p"))))

    # every two sources of a term; most terms are in few of them
    first = terms.select("lang", "own", F.posexplode("own").alias("at", "a"))
    shared = first.select("lang", "a", F.explode(F.slice("own", F.col("at") + 2, F.size("own"))).alias("b"))
    shared = shared.groupBy("lang", F.col("a.source").alias("a_source"), F.col("b.source").alias("b_source"), F.col("a.n").alias("a_n"), F.col("b.n").alias("b_n")).agg(F.count("*").alias("m"))
    shared = shared.join(of("a"), ["lang", "a_source"]).join(of("b"), ["lang", "b_source"])
    shared = shared.withColumns({f"{x}_p": share(F.col(f"{x}_n"), F.col(f"{x}_total"), F.col("terms")) for x in "ab"})
    correction = lambda x, y: sum(sign * exact(divergence(F.col(f"{x}_{p}"), F.col(f"{y}_{q}"))) for sign, p, q in ((1, "p", "p"), (-1, "p", "absent"), (-1, "absent", "p"), (1, "absent", "absent")))
    shared = both_ways(shared, lambda x, y: exact(F.col("m")) * exact(correction(x, y)))

    wide = lambda rows: rows.select("lang", "source", "item", F.col("value").cast("decimal(38,0)").alias("value"))
    sums = wide(neither).unionByName(wide(one)).unionByName(wide(shared)).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def term_rows(entries: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    """Part term: the terms that a group has a larger share of than its language, the most diverging ones."""
    salted = groups.select("lang", "source", "total", "terms", "of_lang_total", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = entries.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "source", "salt"])
    rows = rows.select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), share(F.col("of_lang"), F.col("of_lang_total"), F.col("terms")).alias("q")).where("p > q")
    rows = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    # Spark limits ranks within its tasks before rows of a group meet
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "source", "part", "item", "value", "rank")
