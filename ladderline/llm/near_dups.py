"""MinHash near-dedup with odd sketches.

Every document becomes the set of its distinct word shingles. MinHash samples of the set give bands (documents that share a
band are candidates) and an odd sketch: the samples folded into a parity bitmap, so that the population count of the XOR of two
sketches estimates a high similarity precisely. Candidates that pass the sketch are confirmed on the full sets.

Documents of equal sets are one class from the start; only the class's smallest doc_id goes on. A band is named by its smallest
document, its lead; documents that share a lead are a group, so that copies that share many bands meet once. Groups are dealt in blocks
of bounded size, with the lead in each. In a block the sketches say which documents have a near one at all; only their sets are fetched, and
the block then confirms every pair that is not linked already, and hands on a spanning forest: at most one link a document, never a
list of pairs. Groups of several blocks are then looked at again: documents that are not in their lead's component meet all others of the group. No
link is lost but by the bands (below 1e-7 at a similarity of 0.8) and the sketch (five deviations).

Defined cases: a null or empty text, or one without words, has no shingles and is linked with nothing; a long text is one set like any other (blocks are bounded by the
size of their sets); rows that repeat a doc_id are one document, linked with whatever any of its texts is linked with; a row
without doc_id is linked with nothing (its component is null) and kept; an empty table gives an empty table; extra
columns are ignored, or kept by keep_one().
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladderline.llm.common import Tables, apart, arrow_map, id_and_text, in_bitmap, key_bitmap
from ladderline.llm.kernels import RangeHashes, grouped_arrow, mixed

BANDS, ROWS = 32, 4
#: MinHash samples in a sketch (those of the bands are the first of them), and the sketch's size.
SAMPLES, SKETCH_BITS = 256, 2048
#: Similarity that links, in percent, and the estimate from which the sketches pass a pair on.
LINK_PERCENT, SKETCH_FLOOR = 80, 0.65
#: Most documents of a group, and most shingles of their sets, in a block: two blocks are compared in one task at once.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: How often a class is repeated among the keys of the last join, so that the copies of one text do not meet in one task.
SALTS = 8
_RANDOM = np.random.default_rng(11)
_MULTIPLY = _RANDOM.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RANDOM.integers(0, 2**63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TAG = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64))
#: The XOR of two sketches has at most so many bits where the estimated similarity reaches the floor.
MAX_XOR = int(SKETCH_BITS / 2 * (1 - math.exp(-2 * 2 * SAMPLES * (1 - SKETCH_FLOOR) / SKETCH_BITS)))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True


def shingle_set(text: str, words: int = 2) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)  # bytes.lower() changes A-Z alone
    inside = np.zeros(len(b) + 2, bool)
    inside[1:-1] = ~_IS_SPACE[b]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    if not len(edges):
        return np.zeros(0, np.uint64)
    hashes = RangeHashes(b).of(edges[0::2], edges[1::2])
    width = min(words, len(hashes))
    out = np.full(len(hashes) - width + 1, width, np.uint64)
    for k in range(width):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + len(out)])
    return np.unique(out)


def min_samples(hashes: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * _MULTIPLY).min(0), out=least)
    return least


def odd_sketch(samples: np.ndarray) -> bytes:
    places = (mixed(samples ^ _TAG) >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=SKETCH_BITS).astype(np.uint8) & 1).tobytes()


def band_keys(samples: np.ndarray) -> list[int]:
    keys = (mixed(samples[: BANDS * ROWS].reshape(BANDS, ROWS)) * _BAND).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)
    return mixed(keys).view(np.int64).tolist()


_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.string()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def signatures(docs: DataFrame, words: int = 2) -> DataFrame:
    def of_batch(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {"n_shingles": [], "set_key": [], "bands": [], "sketch": []}
        for text in batch.column("text").to_pylist():
            found = shingle_set(text, words)
            samples = min_samples(found) if len(found) else None
            out["n_shingles"].append(len(found))
            out["set_key"].append(hashlib.md5(found.tobytes()).hexdigest() if len(found) else None)
            out["bands"].append(band_keys(samples) if len(found) else None)
            out["sketch"].append(odd_sketch(samples) if len(found) else None)
        return out | {"doc_id": batch.column("doc_id")}

    return arrow_map(id_and_text(docs), _SIGNATURE, of_batch)


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_PLACE = pa.schema([("lead", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("doc_id", pa.int64()), ("component", pa.int64())])
_BLOCK_KEYS = ["lead", "i", "j"]


def with_near_ones(sketch: np.ndarray, n: np.ndarray, component: np.ndarray, edges: np.ndarray, percent: int) -> np.ndarray:
    """Which rows have a row of another component in their group whose sketch is near and whose size allows the similarity.

    All rows are compared with the first of their group at once; only rows that are not near it are compared with the others.
    """

    def near(k: np.ndarray | int, rows: np.ndarray | slice) -> np.ndarray:
        fits = 100 * np.minimum(n[k], n[rows]) >= percent * np.maximum(n[k], n[rows])
        return fits & (component[k] != component[rows]) & (np.bitwise_count(sketch[k] ^ sketch[rows]).sum(-1) <= MAX_XOR)

    sizes = np.diff(edges)
    first = np.repeat(edges[:-1], sizes)
    out = near(first, np.arange(len(n)))
    out[first[out]] = True
    todo = ~out & (np.repeat(sizes, sizes) > 2)
    todo[edges[:-1]] = False
    ends = np.repeat(edges[1:], sizes)
    for k in np.flatnonzero(todo):
        group = slice(first[k], ends[k])
        found = near(k, group)
        if found.any():
            out[k] = True
            out[group] |= found
    return out


def forest(ids: np.ndarray, component: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join what pairs of the similarity join, at most one fewer than there are rows.

    The first row meets all others; then those outside the largest component meet all others. Pairs that are joined already are not looked at.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    has, out = np.zeros(len(values), np.uint8), []
    own = np.unique(component, return_inverse=True)[1]

    def meet(k: int) -> None:
        rows = np.flatnonzero(own != own[k])
        if not len(rows):
            return
        mine = flat[starts[k] : starts[k] + sizes[k]]
        has[mine] = 1
        both = np.add.reduceat(has[flat], starts, dtype=np.int64)[rows]
        has[mine] = 0
        hit = rows[100 * both >= percent * (sizes[k] + sizes[rows] - both)]
        joined, at = np.unique(own[hit], return_index=True)
        out.extend((int(ids[k]), int(x)) for x in ids[hit[at]])
        own[np.isin(own, joined)] = own[k]

    meet(0)
    for k in np.flatnonzero(own != np.bincount(own).argmax()):
        meet(k)
    return out


def links_in_blocks(docs: DataFrame, dealt: DataFrame, words: int, percent: int, tables: Tables) -> DataFrame:
    """Links of the similarity between rows of a block that are in different components.

    dealt: block keys, doc_id, component, n_shingles and sketch. The sets are built of documents with a near sketch in a block alone.
    """

    def flag(table: pa.Table, edges: np.ndarray) -> dict[str, object]:
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint64).reshape(table.num_rows, -1)
        near = with_near_ones(sketch, table.column("n_shingles").to_numpy(), table.column("component").to_numpy(), edges, percent)
        return {c: table.column(c).to_numpy()[near] for c in _PLACE.names}

    flagged = tables.cut(grouped_arrow(dealt, _BLOCK_KEYS, [F.col("doc_id") != F.col("lead"), F.col("doc_id")], _PLACE, flag), "near-flagged")
    ids = flagged.select("doc_id").distinct()
    bits = key_bitmap(ids, F.crc32(F.col("doc_id").cast("string")))
    if bits is None:
        return flagged.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    shared = docs.sparkSession.sparkContext.broadcast(bytes(bits))

    def sets_of(batch: pa.RecordBatch) -> dict[str, object] | None:
        at = [k for k, d in enumerate(batch.column("doc_id").to_pylist()) if d is not None and in_bitmap(shared.value, str(d).encode())]
        chosen = batch.take(pa.array(at, pa.int64()))
        return {"doc_id": chosen.column("doc_id"), "found": [shingle_set(t, words).tobytes() for t in chosen.column("text").to_pylist()]} if at else None

    sets = arrow_map(id_and_text(docs), pa.schema([("doc_id", pa.int64()), ("found", pa.binary())]), sets_of).where(F.length("found") > 0)

    def link(table: pa.Table, edges: np.ndarray) -> dict[str, object]:
        ids, component = (table.column(c).to_numpy() for c in ("doc_id", "component"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("found").to_pylist()]
        out = [x for lo, hi in zip(edges, edges[1:], strict=False) for x in forest(ids[lo:hi], component[lo:hi], sets[lo:hi], percent)]
        return {"a": [a for a, _ in out], "b": [b for _, b in out]}

    return grouped_arrow(flagged.join(sets, "doc_id"), _BLOCK_KEYS, [F.col("doc_id") != F.col("lead"), F.col("doc_id")], _LINK, link)


def components(links: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(node, component): the smallest node that links lead to. Labels move over links and then jump to their label's label."""
    tables = tables or Tables(links.sparkSession)
    both = tables.cut(links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e")).select("e.*").distinct(), "links")
    labels = tables.cut(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("to"), F.col("component").alias("seen")), "to").groupBy("node").agg(F.min("seen").alias("seen"))
        moved = labels.join(near, "node").select("node", F.least("component", "seen").alias("next"), "component")
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("further"))
        new = tables.cut(moved.join(jump, "next").select("node", F.least("next", "further").alias("component"), (F.least("next", "further") != F.col("component")).alias("changed")), "labels")
        labels = new.select("node", "component")
        if new.where("changed").limit(1).count() == 0:
            return labels


def _blocks(rows: Column, shingles: Column) -> Column:
    return F.greatest(F.ceil(rows / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _dealt_once(members: DataFrame, large: DataFrame) -> DataFrame:
    """Every group in as many blocks as it needs; the lead is in each."""
    rows = members.join(large, "lead", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    where = F.when((F.col("doc_id") == F.col("lead")) & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    return rows.select("lead", F.explode(where).alias("i"), F.lit(0).alias("j"), "doc_id", F.col("doc_id").alias("component"), "n_shingles", "sketch")


def _dealt_again(members: DataFrame, large: DataFrame, labels: DataFrame) -> DataFrame:
    """Groups of several blocks: documents outside their lead's component, in blocks that meet one another and those of all others."""
    label = labels.select(F.col("node").alias("doc_id"), "component")
    rows = members.join(large.select("lead"), "lead").join(label, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    leads = large.select("lead").join(label.withColumnRenamed("doc_id", "lead"), "lead", "left").select("lead", F.coalesce("component", "lead").alias("main"))
    rows = rows.join(leads, "lead").withColumn("apart", F.col("component") != F.col("main"))
    shingles = lambda c: F.sum(F.when(c, F.col("n_shingles")).otherwise(0))
    sizes = rows.groupBy("lead").agg(_blocks(F.count_if("apart"), shingles(F.col("apart"))).alias("few"), _blocks(F.count_if(~F.col("apart")), shingles(~F.col("apart"))).alias("many")).where("few > 0")
    rows = rows.join(sizes, "lead")
    own = F.when(F.col("apart"), F.pmod(F.xxhash64("doc_id"), F.col("few"))).otherwise(F.col("few") + F.pmod(F.xxhash64("doc_id"), F.col("many"))).cast("int")
    last = F.when(F.col("apart"), F.col("few") + F.col("many") - 1).otherwise(F.col("few") - 1)
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return rows.select("lead", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "doc_id", "component", "n_shingles", "sketch")


def near_duplicates(docs: DataFrame, words: int = 2, percent: int = LINK_PERCENT) -> DataFrame:
    """One row a document: n_shingles, component_id and kept (the smallest doc_id of its component)."""
    tables = Tables(docs.sparkSession)
    signed = tables.cut(signatures(docs, words), "near-signatures")
    usable = signed.where(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull())
    classes = tables.cut(usable.groupBy("set_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "near-classes")
    firsts = usable.join(classes.select("set_key", F.col("first").alias("doc_id")), ["set_key", "doc_id"], "left_semi").dropDuplicates(["doc_id", "set_key"])
    firsts = tables.cut(firsts.select("doc_id", "n_shingles", "bands", "sketch"), "near-firsts")
    banded = firsts.select("doc_id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("doc_id").alias("lead")).where("n > 1").drop("n")
    grouped = banded.join(shared, "band").select("lead", "doc_id").distinct()
    members = tables.cut(grouped.join(firsts.select("doc_id", "n_shingles", "sketch"), "doc_id"), "near-members")
    large = tables.cut(members.groupBy("lead").agg(_blocks(F.count("*"), F.sum("n_shingles")).alias("blocks")).where("blocks > 1"), "near-large")
    # a document whose rows differ is linked with the first document of each of its texts
    several = usable.groupBy("doc_id").agg(F.min("set_key").alias("least"), F.max("set_key").alias("most")).where("least < most").select("doc_id")
    own = usable.join(several, "doc_id", "left_semi").join(classes, "set_key").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    links = tables.cut(own.unionByName(links_in_blocks(docs, _dealt_once(members, large), words, percent, tables)).distinct(), "near-links")
    labels = components(links, tables)
    if large.limit(1).count():
        more = tables.cut(links_in_blocks(docs, _dealt_again(members, large, labels), words, percent, tables), "near-links")
        if more.limit(1).count():
            labels = components(links.unionByName(more), tables)
    # classes that stay alone with themselves need no look-up; the others are salted
    moved = classes.join(labels.withColumnRenamed("node", "first"), "first", "left").select("set_key", "n", F.coalesce("component", "first").alias("component"), (F.coalesce("component", "first") != F.col("first")).alias("moved"))
    moved = moved.where("moved or n > 1").select("set_key", "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = signed.select("doc_id", "n_shingles", "set_key", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    component = F.coalesce("component", "doc_id")
    out = rows.join(moved, ["set_key", "salt"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
    return tables.only(out, "near-result")


def keep_one(docs: DataFrame, words: int = 5, percent: int = LINK_PERCENT) -> DataFrame:
    """The documents, all columns kept, without those that are near copies of one with a smaller doc_id."""
    gone = near_duplicates(docs, words, percent).where(~F.col("kept")).select("doc_id").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*docs.columns).alias("row"))
    perhaps, others = apart(rows, gone)
    return others.select("row.*").union(perhaps.join(gone, "doc_id", "left_anti").select("row.*"))
