"""Suffix-array dedup: long byte strings that already stand in a document with a smaller doc_id.

Every string of LENGTH bytes has one anchor, its least hashed K-gram, and equal strings have equal anchors. The neighbouring
strings of one anchor are a unit: the suffixes that begin in the unit, cut to the unit's end. So the index holds a sparse suffix
array, one suffix an anchor, ordered by fingerprint instead of by letter (equality is all that is asked of it).

Tasks sort the units of their batch and settle what is a copy within the batch; the rest goes to shards by anchor, so many that a shard has a bounded
share of the input. A shard keeps a logarithmic family of sorted levels: batches come in order of their smallest document, a new batch is scanned against the levels
before it becomes one, and levels of like size merge, so that there are log n of them; each unit keeps the smallest doc_id that has it. A unit that stands
whole in a smaller document is settled by the scan.
Where units of one anchor differ, copies can end inside them: those units' strings are fetched from the texts and the
smallest doc_id of each string decides. Everything is judged on the input texts.

An anchor that a batch has many different units of (the edges of a passage that a large part of all documents share) sends them to shards by unit, and its own
shard a mark; its strings are then decided one by one, by the minimum of a partial aggregate, so that no key's units or strings meet in one task.

Defined cases: a null or empty text has no bytes and no removals; a long text is a batch of its own; rows that repeat a doc_id are one document (neither is removed for the
other), each row judged on its own text; a row without doc_id neither loses bytes nor takes any from others; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ladderline.llm.common import Tables, apart, arrow_map, id_and_text, in_bitmap, key_bitmap
from ladderline.llm.kernels import RangeHashes, grouped_arrow, mixed, sliding_min

LENGTH, K = 50, 20
#: Bytes of text that are hashed at once in a task; a longer text is hashed alone.
CHUNK = 1 << 19
#: Bytes of text whose units make up one batch of the index; a longer text is a batch of its own.
BATCH = 8 << 20
#: Bytes of text that a shard has the units of, and shards that a task takes one after the other.
SHARD, SHARDS_A_TASK = 64 << 20, 4
#: Different units of an anchor in a batch, or open ones in a shard, from which its strings are decided one by one: what bounds the strings that meet at a
#: key, about sixteen a unit, so that they fit in a task.
MANY, MANY_OPEN = 1024, 1 << 16
_LOW = np.uint64(0xFFFFFFFF)
#: A unit: anchor key, fingerprint of its bytes (48 bits, beside the anchor's), document, hash of the text (0 where the doc_id is known to have one row), first
#: string's place, number of strings, and how far the anchor stands behind the first string's place.
UNIT = np.dtype([("a", "<u4"), ("u", "<u8"), ("d", "<i8"), ("tag", "<i8"), ("lo", "<u4"), ("n", "u1"), ("off", "u1")])
_SENT = {"u": 6}
#: The fingerprint of a mark, which says that an anchor has many units elsewhere. Others are below it.
_MARK = np.uint64((1 << 48) - 1)
#: Strings that begin so many bytes or more before their anchor meet by what stands before it, others by what stands behind it.
_BEFORE = (LENGTH - K) // 2


def _units_of_chunk(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Number of text, place, number of strings, anchor's distance, anchor hash and fingerprint of each unit of the texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    b = np.frombuffer(b"".join(texts), np.uint8)
    if len(b) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    hashes = RangeHashes(b)
    grams = mixed(hashes.of_length(K))
    least = sliding_min((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), LENGTH - K + 1)
    owner = np.repeat(np.arange(len(texts)), sizes)
    start = np.flatnonzero(owner[: len(least)] == owner[LENGTH - 1 :])
    anchor = (least[start] & _LOW).astype(np.int64)
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    lo = start[first]
    n = np.diff(np.append(first, len(start)))
    text = owner[lo]
    return text, lo - (np.cumsum(sizes) - sizes)[text], n, anchor[first] - lo, mixed(grams[anchor[first]]), hashes.of(lo, lo + n - 1 + LENGTH)


def units(ids: list[int], texts: list[bytes], tags: list[int], chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """The units of these documents, and the whole anchor hashes."""
    out, whole, at = [], [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= chunk):
            size += len(texts[end])
            end += 1
        text, lo, n, off, anchor, unit = _units_of_chunk(texts[at:end])
        found = np.zeros(len(lo), UNIT)
        found["a"], found["u"], found["lo"], found["n"], found["off"] = anchor >> np.uint64(32), np.minimum(unit >> np.uint64(16), _MARK - np.uint64(1)), lo, n, off
        found["d"] = np.array(ids[at:end], np.int64)[text]
        found["tag"] = np.array(tags[at:end], np.int64)[text]
        out.append(found)
        whole.append(anchor)
        at = end
    return np.concatenate(out), np.concatenate(whole)


def settled_in_batch(found: np.ndarray) -> np.ndarray:
    """Whether a unit stands in a smaller document of the same batch."""
    order = np.lexsort((found["d"], found["a"], found["u"]))
    u, a, d = (found[c][order] for c in ("u", "a", "d"))
    new = np.concatenate([[True], (u[1:] != u[:-1]) | (a[1:] != a[:-1])]) if len(u) else np.zeros(0, bool)
    smallest = d[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros(len(found), bool)
    out[order] = d > smallest
    return out


class LevelFamily:
    """Sorted levels of (unit, anchor, smallest document); like-sized levels merge, so that n units are in log n levels."""

    def __init__(self, levels: list[np.ndarray] | None = None) -> None:
        self.levels: list[np.ndarray] = levels or []

    @staticmethod
    def _sorted(rows: np.ndarray) -> np.ndarray:
        rows = rows[np.lexsort((rows["d"], rows["a"], rows["u"]))]
        new = np.concatenate([[True], (rows["u"][1:] != rows["u"][:-1]) | (rows["a"][1:] != rows["a"][:-1])])
        return rows[new]

    def add(self, batch: np.ndarray) -> None:
        level = self._sorted(batch[["u", "a", "d"]])
        while self.levels and len(self.levels[-1]) <= 2 * len(level):
            level = self._sorted(np.concatenate([self.levels.pop(), level]))
        self.levels.append(level)

    def smallest(self, batch: np.ndarray) -> np.ndarray:
        """The smallest document that is known, by the levels or the batch's own rows, to have each unit of the batch."""
        out = batch["d"].copy()
        for level in self.levels:
            at = np.minimum(np.searchsorted(level["u"], batch["u"]), len(level) - 1)
            # units of equal fingerprints and different anchors stand next to one another
            while (step := (level["u"][at] == batch["u"]) & (level["a"][at] < batch["a"]) & (at + 1 < len(level))).any():
                at = at + step
            hit = (level["u"][at] == batch["u"]) & (level["a"][at] == batch["a"])
            out[hit] = np.minimum(out[hit], level["d"][at[hit]])
        return out

    def contested(self) -> np.ndarray:
        """Sorted anchor keys whose units differ between documents."""
        rows = np.concatenate(self.levels)
        rows = rows[np.argsort(rows["a"], kind="stable")]
        edges = np.flatnonzero(np.concatenate([[True], rows["a"][1:] != rows["a"][:-1]]))
        differ = np.minimum.reduceat(rows["d"], edges) < np.maximum.reduceat(rows["d"], edges)
        several = np.minimum.reduceat(rows["u"], edges) < np.maximum.reduceat(rows["u"], edges)
        marked = np.maximum.reduceat(rows["u"], edges) == _MARK
        return rows["a"][edges][(differ & several) | marked]


def _packed(found: np.ndarray) -> bytes:
    """Column by column and byte by byte, documents as differences: what is alike stands together, and compresses."""
    planes = []
    for c in UNIT.names:
        column = np.diff(found[c], prepend=0).astype("<i8") if c == "d" else np.ascontiguousarray(found[c])
        planes += [p.tobytes() for p in column.view(np.uint8).reshape(len(found), -1).T[: _SENT.get(c)]]
    return zstandard.compress(b"".join(planes), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    widths = {c: _SENT.get(c, UNIT[c].itemsize) for c in UNIT.names}
    planes = raw.reshape(sum(widths.values()), -1)
    out, at = np.zeros(planes.shape[1], UNIT), 0
    for c, width in widths.items():
        column = np.zeros((planes.shape[1], UNIT[c].itemsize), np.uint8)
        column[:, :width] = planes[at : at + width].T
        values = column.view(UNIT[c]).ravel()
        out[c] = np.cumsum(values) if c == "d" else values
        at += width
    return out


def merged_runs(found: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, text check sum, start and end of the bytes that units cover; overlapping ones of a text made one."""
    found = found[np.lexsort((found["lo"], found["tag"], found["d"]))]
    d, tag, lo = found["d"], found["tag"], found["lo"].astype(np.int64)
    hi = lo + found["n"] - 1 + LENGTH
    if not len(d):
        return d, tag.astype(np.int64), lo, hi
    text = np.concatenate([[True], (d[1:] != d[:-1]) | (tag[1:] != tag[:-1])])
    # places grow within a text and units are at most LENGTH strings, so the end so far is the last one's
    new = text | np.concatenate([[True], lo[1:] > hi[:-1]])
    first = np.flatnonzero(new)
    return d[first], tag[first].astype(np.int64), lo[first], np.maximum.reduceat(hi, first)


#: kind: covered units, units of a shard of anchors, or units that are spread by their fingerprints. first orders the batches of a shard.
_COVERED, _BY_ANCHOR, _SPREAD = 0, 1, 2
_DEALT = pa.schema([("shard", pa.int64()), ("first", pa.int64()), ("kind", pa.int32()), ("units", pa.binary())])
#: A run of covered bytes; or, with an anchor's place, the places of strings (lo to hi) that are still to be decided, one by one if each is set.
_FOUND = pa.schema([("doc_id", pa.int64()), ("tag", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("anchor", pa.int64()), ("each", pa.bool_())])


def _found_batch(columns: list[object], n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.nulls(n, f.type) if c is None else pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)


def _open_batch(found: np.ndarray, each: np.ndarray) -> pa.RecordBatch:
    lo = found["lo"].astype(np.int64)
    return _found_batch([found["d"], found["tag"], lo, lo + found["n"], lo + found["off"], each], len(found))


def _count_of(values: np.ndarray) -> np.ndarray:
    """How often each value occurs in the array."""
    _, which, counts = np.unique(values, return_inverse=True, return_counts=True)
    return counts[which]


def deal(found: np.ndarray, whole: np.ndarray, shards: int, most: int = MANY) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Shard, kind and units of a batch, with the smallest document: what the batch settles, and what the shards have to."""
    done = settled_in_batch(found)
    shard = ((whole & _LOW) % np.uint64(shards)).astype(np.int64)
    if done.any():
        yield int(shard[done][0]), int(found["d"].min()), _COVERED, found[done]
    rest = np.flatnonzero(~done)
    many = _count_of(whole[rest]) >= most
    marks = found[rest[many]][np.unique(whole[rest[many]], return_index=True)[1]] if many.any() else found[:0]
    marks["u"], marks["n"] = _MARK, 0
    spread = mixed(whole[rest[many]] ^ found["u"][rest[many]])
    home = shard[rest[many]][np.unique(whole[rest[many]], return_index=True)[1]] if many.any() else shard[:0]
    parts = ((_BY_ANCHOR, np.concatenate([found[rest[~many]], marks]), np.concatenate([shard[rest[~many]], home])), (_SPREAD, found[rest[many]], (spread % np.uint64(shards)).astype(np.int64)))
    for kind, rows, to in parts:
        order = np.argsort(to, kind="stable")
        edges = np.searchsorted(to[order], np.arange(shards + 1)) if shards <= len(to) else None
        for s in np.unique(to):
            lo, hi = (edges[s], edges[s + 1]) if edges is not None else np.searchsorted(to[order], [s, s + 1])
            own = rows[order[lo:hi]]
            yield int(s), int(own["d"].min()), kind, own


def scanned(batches: list[np.ndarray], spread: bool, most: int = MANY_OPEN) -> Iterator[pa.RecordBatch]:
    """What a shard's batches, smallest documents first, settle and leave open.

    Each is looked up before it is added. A later batch may still hold a smaller document, as batches overlap; so those before it are looked up again at the end.
    """
    family, copies, reach, again = LevelFamily(), [], None, []
    for k, found in enumerate(batches):
        copies.append(family.smallest(found) < found["d"])
        if reach is not None and found["d"].min() < reach:
            again.append(k)
        family.add(found)
        reach = max(reach or found["d"].max(), found["d"].max())
    if again:
        copies = [family.smallest(found) < found["d"] for found in batches]
    contested = None if spread else family.contested()
    left = []
    for found, copy in zip(batches, copies, strict=True):
        real = found["u"] != _MARK
        runs = merged_runs(found[copy & real])
        if len(runs[0]):
            yield _found_batch([*runs, None, None], len(runs[0]))
        open_ = found[~copy | ~real]
        left.append(open_ if spread else open_[np.isin(open_["a"], contested)])
    open_ = np.concatenate(left)
    if spread:
        yield _open_batch(open_, np.ones(len(open_), bool))
    elif len(open_):
        marked = np.unique(open_["a"][open_["u"] == _MARK])
        each = np.isin(open_["a"], marked) | (_count_of(open_["a"]) >= most)
        real = open_["u"] != _MARK
        yield _open_batch(open_[real], each[real])


def settle(docs: DataFrame, tables: Tables) -> DataFrame:
    """Covered runs, and units that need their strings compared."""
    rows = _with_tag(docs)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(SHARDS_A_TASK * parts, -(-size // SHARD))
    tasks = max(parts, -(-shards // SHARDS_A_TASK))
    repeated = key_bitmap(rows.groupBy("doc_id").count().where("count > 1"), F.crc32(F.col("doc_id").cast("string")))
    shared = docs.sparkSession.sparkContext.broadcast(bytes(repeated or b""))
    many, many_open, chunk = MANY, MANY_OPEN, CHUNK

    def of_batch(batch: pa.RecordBatch) -> dict[str, object] | None:
        out: dict[str, list] = {c: [] for c in _DEALT.names}
        ids, texts, tags, size = [], [], [], 0
        for k, (doc_id, tag) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), strict=True)):
            ids.append(doc_id)
            texts.append(batch.column("text")[k].as_py().encode("utf-8", "surrogatepass"))
            tags.append(tag if shared.value and in_bitmap(shared.value, str(doc_id).encode()) else 0)
            size += len(texts[-1])
            if size >= BATCH or k == batch.num_rows - 1:
                for row in deal(*units(ids, texts, tags, chunk), shards, many):
                    for name, value in zip(_DEALT.names, (*row[:3], _packed(row[3])), strict=True):
                        out[name].append(value)
                ids, texts, tags, size = [], [], [], 0
        return out if out["shard"] else None

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        own = None
        for batch in batches:
            for shard, _, kind, blob in zip(*(batch.column(c).to_pylist() for c in _DEALT.names), strict=True):
                if held and own != (shard, kind):
                    yield from scanned(held, own[1] == _SPREAD, many_open)
                    held = []
                own = (shard, kind)
                if kind == _COVERED:
                    runs = merged_runs(_unpacked(blob))
                    yield _found_batch([*runs, None, None], len(runs[0]))
                else:
                    held.append(_unpacked(blob))
        if held:
            yield from scanned(held, own[1] == _SPREAD, many_open)

    dealt = arrow_map(rows, _DEALT, of_batch, 1 << 20).repartition(tasks, "shard", F.col("kind") == _SPREAD).sortWithinPartitions("shard", "kind", "first")
    return tables.cut(dealt.mapInArrow(scan, from_arrow_schema(_FOUND)), "suffix-found")


_OPEN = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("at", pa.int64()), ("data", pa.binary())])
_EACH = pa.schema([("key", pa.int64()), ("more", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("at", pa.int64())])
_RUN = pa.schema(list(_FOUND)[:4])


def _asked(docs: DataFrame, open_units: DataFrame) -> DataFrame:
    """Texts with the open units that they have: doc_id, tag, text, asked. Texts without any are not shuffled."""
    asked = open_units.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "lo", "hi", "anchor")).alias("asked"))  # bounded by the texts of an id
    perhaps, _ = apart(_with_tag(docs), open_units.select("doc_id").distinct())
    return perhaps.join(asked, "doc_id").withColumn("asked", F.filter("asked", lambda x: (x["tag"] == 0) | (x["tag"] == F.col("tag"))))


def _places(asked: list) -> tuple[np.ndarray, ...]:
    return tuple(np.array([(r["lo"], r["hi"], r["anchor"], r["tag"]) for r in asked], np.int64).reshape(-1, 4).T)


def _open_strings(docs: DataFrame, open_units: DataFrame) -> DataFrame:
    """The bytes of the strings that are still to be decided. key is equal for equal strings: a hash of the anchor and what
    stands before or behind it, so that a frequent anchor's strings spread over many keys."""

    def of_batch(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {c: [] for c in _OPEN.names}
        for doc_id, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "asked")), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            lo, hi, anchor, tag = _places(asked)
            hashes = RangeHashes(np.frombuffer(data, np.uint8))
            middle = np.clip(anchor - _BEFORE + 1, lo, hi)
            for first, last, start, size in ((lo, middle, anchor - _BEFORE, _BEFORE + K), (middle, hi, anchor, LENGTH - _BEFORE + 1)):
                some = np.flatnonzero(last > first)
                out["key"] += hashes.of(start[some], start[some] + size).view(np.int64).tolist()
                out["at"] += first[some].tolist()
                out["data"] += [data[x : y - 1 + LENGTH] for x, y in zip(first[some].tolist(), last[some].tolist(), strict=True)]
                out["doc_id"] += [doc_id] * len(some)
                out["tag"] += tag[some].tolist()
        return out

    return arrow_map(_asked(docs, open_units), _OPEN, of_batch)


def _decided(strings: DataFrame) -> DataFrame:
    """The runs of strings that a smaller document has; keys are taken as they come, a few Arrow batches at a time."""

    def decide(rows: pa.Table, edges: np.ndarray) -> dict[str, object]:
        key, doc_id, tag, at = (rows.column(c).to_numpy() for c in _OPEN.names[:4])
        data = rows.column("data").to_pylist()
        sizes = np.array([len(x) for x in data], np.int64)
        n = sizes - LENGTH + 1
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        row = np.repeat(np.arange(len(n)), n)
        place = (np.cumsum(sizes) - sizes)[row] + inner
        string = RangeHashes(np.frombuffer(b"".join(data), np.uint8)).of(place, place + LENGTH)
        order = np.lexsort((doc_id[row], key[row], string))
        s, k, d = string[order], key[row][order], doc_id[row][order]
        new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (k[1:] != k[:-1])]))
        smallest = np.repeat(d[new], np.diff(np.append(new, len(d))))
        copy = np.zeros(len(order), bool)
        copy[order] = d > smallest
        found = np.zeros(int(copy.sum()), UNIT)
        found["d"], found["tag"], found["lo"], found["n"] = doc_id[row][copy], tag[row][copy], (at[row] + inner)[copy], 1
        return dict(zip(_RUN.names, merged_runs(found), strict=True))

    return grouped_arrow(strings, ["key"], [], _RUN, decide)


def _decided_each(docs: DataFrame, open_units: DataFrame, tables: Tables) -> DataFrame:
    """As _decided, for strings of anchors with many units: each by two hashes, against the smallest document of all that have it."""

    def of_batch(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {c: [] for c in _EACH.names}
        for doc_id, text, asked in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "asked")), strict=True):
            lo, hi, _, tag = _places(asked)
            at = np.repeat(lo, hi - lo) + np.arange((hi - lo).sum()) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            hashes = RangeHashes(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8))
            half = LENGTH // 2
            for name, values in zip(out, (hashes.of(at, at + LENGTH).view(np.int64), (hashes.of(at, at + half) ^ mixed(hashes.of(at + half, at + LENGTH))).view(np.int64), [doc_id] * len(at), np.repeat(tag, hi - lo), at), strict=True):
                out[name].extend(values)
        return out

    strings = tables.cut(arrow_map(_asked(docs, open_units), _EACH, of_batch), "suffix-each")
    least = strings.groupBy("key", "more").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last")).where("least < last").drop("last")
    return strings.join(least, ["key", "more"]).where(F.col("doc_id") > F.col("least")).select("doc_id", "tag", F.col("at").alias("lo"), (F.col("at") + LENGTH).alias("hi"))


def _with_tag(docs: DataFrame) -> DataFrame:
    """Rows with a doc_id, and a hash of the text that tells rows of one doc_id apart."""
    return id_and_text(docs).where(F.col("doc_id").isNotNull()).withColumn("tag", F.xxhash64("text"))


def removed_runs(docs: DataFrame, tables: Tables) -> DataFrame:
    """doc_id, tag (hash of the text, or 0 for all texts of the id), lo, hi: runs of bytes to remove; runs of a text may overlap."""
    found = settle(docs, tables)
    out = found.where(F.col("anchor").isNull()).select(*_RUN.names)
    out = out.unionByName(_decided(_open_strings(docs, found.where("anchor IS NOT NULL AND NOT each"))))
    many = found.where("each")
    return out.unionByName(_decided_each(docs, many, tables)) if many.limit(1).count() else out


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def without_copies(docs: DataFrame) -> DataFrame:
    """One row a document: its size, what was removed, the digest of what is left, and that itself (kept)."""
    tables = Tables(docs.sparkSession)
    runs = removed_runs(docs, tables).groupBy("doc_id").agg(F.collect_list(F.struct("tag", "lo", "hi")).alias("runs"))  # bounded by the texts of an id
    runs = tables.only(runs, "suffix-runs")
    perhaps, others = apart(_with_tag(docs), runs)
    joined = perhaps.join(runs, "doc_id", "left").select("doc_id", "text", F.filter("runs", lambda x: (x["tag"] == 0) | (x["tag"] == F.col("tag"))).alias("runs"))
    none = F.lit(None).cast(runs.schema["runs"].dataType)
    joined = joined.unionByName(others.select("doc_id", "text", none.alias("runs")))
    no_id = id_and_text(docs).where(F.col("doc_id").isNull()).select("doc_id", "text", none.alias("runs"))

    def of_batch(batch: pa.RecordBatch) -> dict[str, object]:
        out: dict[str, list] = {c: [] for c in _RESULT.names[1:]}
        for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
            data, kept, at, removed, spans, end = text.encode("utf-8", "surrogatepass"), [], 0, 0, 0, -1
            for lo, hi in sorted((r["lo"], r["hi"]) for r in runs or ()):
                if lo > end:
                    spans += 1
                    kept.append(data[at:lo])
                if hi > max(end, at):
                    removed += hi - max(end, lo)
                    end = at = hi
            kept = b"".join([*kept, data[at:]])
            for name, value in zip(out, (len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                out[name].append(value)
        return out | {"doc_id": batch.column("doc_id")}

    return arrow_map(joined.unionByName(no_id), _RESULT, of_batch)
