"""Best-fit packing: Martello-Toth dominance reduction, then best fit decreasing, over the counts of lengths.

Documents are tokenised, closed with id 0 and, where longer than a sequence, cut into pieces. What has to be packed is then described by
how many pieces there are of each length, at most as many numbers as a sequence has tokens, however large the corpus. The
plan is made on those counts: dominance first fixes sets of one or two pieces that no other choice can beat, best fit
places the rest, many equal sequences at a time. Spark then gives each piece its rank among the pieces of its length, and
the plan says which sequence and offset a rank has.

Defined cases: a null or empty text is the closing id alone; a text longer than a sequence is cut, its first piece being the shorter one; repeated rows are packed
each; equal lengths are told apart by doc_id and piece; long runs of white space or of one character take time in proportion to their length (a text with a run of white space
over LONGEST_RUN goes to the library, as the regular expression of the faster path runs out of stack on such runs); an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladderline.llm.common import arrow_map, cut, id_and_text

CAPACITY = 2048
#: White space that the faster tokeniser is given at once, at most.
LONGEST_RUN = 10_000
_SPACES = re.compile(r"\s\s+")
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


class WordIds(dict):
    """Token ids, as little-endian unsigned 32-bit bytes, of a piece of text that is tokenised by itself. Of bounded size: when it is full it becomes the older half, from which words in use come back."""

    MOST, LONGEST = 150_000, 64

    def __init__(self, vocabulary: str) -> None:
        import public_tokenizers
        import tiktoken

        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(visible))}
        with open(vocabulary, encoding="utf-8") as file:
            model = json.load(file)
        self.added = {t["content"]: np.asarray([t["id"]], "<u4").tobytes() for t in model["added_tokens"]}
        self.split = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.added, key=len, reverse=True)) or r"(?!)")
        ranks = {bytes(byte_of[c] for c in token): k for token, k in model["model"]["vocab"].items() if token not in self.added}
        self.vocabulary, self.library, self.older = vocabulary, None, {}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        ids = self.encoding.encode_ordinary(text)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word) or self.encode(word)
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def of_text(self, text: str) -> bytes:
        """Added tokens (<|endoftext|>) are cut out first, as the library does, and have their own ids; what stands between is tokenised by itself."""
        if self.split.search(text) is None:
            return self._of_plain(text)
        return b"".join(self.added.get(part) or self._of_plain(part) for part in self.split.split(text) if part)

    def _by_library(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.vocabulary)
            self.library.no_truncation()
            self.library.no_padding()
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _of_plain(self, text: str) -> bytes:
        """The pattern never joins what stands before a lone space to what follows, so words can be tokenised each by itself."""
        if len(text) > LONGEST_RUN and any(m.end() - m.start() > LONGEST_RUN for m in _SPACES.finditer(text)):
            return self._by_library(text)
        if _SPACES.search(text):
            return self.encode(text)
        first, *rest = text.split(" ")
        return b"".join([self[first], *[self[" " + word] for word in rest]])


@lru_cache(maxsize=2)
def word_ids(vocabulary: str) -> WordIds:
    return WordIds(vocabulary)


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document. Ids are those of the tokenizers library for the vocabulary file, with add_special_tokens=False."""

    def of_batch(batch: pa.RecordBatch) -> dict[str, object]:
        ids, out = word_ids(vocabulary), []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data = ids.of_text(text) + bytes(4)
            size, at = len(data) // 4, 0
            n = -(-size // capacity)
            for piece in range(n):
                end = size - capacity * (n - 1 - piece)
                out.append((doc_id, piece, at, end - at, zlib.crc32(data[4 * at : 4 * end])))
                at = end
        return dict(zip(_PIECES.names, zip(*out, strict=True), strict=True))

    return arrow_map(id_and_text(docs), _PIECES, of_batch)


def dominance_reduction(counts: np.ndarray) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """Sets that are in some best packing, with how often, and the counts that are left. counts[l] pieces have length l.

    For the longest piece j, a set with j dominates if it fills the sequence exactly with one more piece; if only one more
    piece fits at all, and it is the longest that does; or if that one is as long as any two that fit together and no three fit.
    """
    capacity, counts, fixed = len(counts) - 1, counts.copy(), []
    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while counts[j]:
                counts[j] -= 1  # j itself is no partner of its own
                room = capacity - j
                fits = np.flatnonzero(counts[: room + 1])
                smallest = np.repeat(fits[:3], np.minimum(counts[fits[:3]], 3))[:3]
                counts[j] += 1
                if not len(fits):
                    fixed.append(((j,), int(counts[j])))
                    counts[j] = 0
                    changed = True
                    break
                k = int(fits[-1])
                alone = len(smallest) < 2 or smallest[0] + smallest[1] > room
                if not (k == room or alone or ((len(smallest) < 3 or smallest.sum() > room) and k >= _best_two(fits, counts, room))):
                    break
                times = int(counts[j] // 2 if k == j else min(counts[j], counts[k]))
                fixed.append(((j, k), times))
                counts[j] -= times
                counts[k] -= times
                changed = True
    return fixed, counts


def _best_two(fits: np.ndarray, counts: np.ndarray, room: int) -> int:
    """The largest sum of two pieces that fit together."""
    partner = np.searchsorted(fits, room - fits, "right") - 1
    ok = (partner >= 0) & ((fits[partner] != fits) | (counts[fits] > 1))
    return int((fits + fits[partner])[ok].max(initial=0))


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit decreasing: each piece goes to the fullest sequence that has room; equal steps are made together."""
    capacity, n = len(counts) - 1, counts.copy()
    opened: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for length in range(capacity, 0, -1):
        while n[length]:
            room = next((r for r in range(length, capacity) if opened[r]), capacity)
            pattern, times = opened[room].pop() if room < capacity else ((), int(n[length]))
            each = min(room // length, int(n[length]))
            used = min(times, int(n[length]) // each)
            if used < times and pattern:
                opened[room].append((pattern, times - used))
            opened[room - each * length].append((pattern + (length,) * each, used))
            n[length] -= used * each
    return [x for found in opened.values() for x in found]


def packing_plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    fixed, left = dominance_reduction(counts)
    return fixed + best_fit(left)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every piece with its place: sequence_id and offset."""
    pieces = cut(token_pieces(docs, vocabulary, capacity).withColumn("part", F.spark_partition_id()), "pack-pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    froms, firsts, offsets = [], [], []
    used, sequence = np.zeros(capacity + 1, np.int64), 0
    for pattern, times in packing_plan(counts):
        at = 0
        for length in pattern:
            froms.append((length << 44) + int(used[length]))
            firsts.append(sequence)
            offsets.append(at)
            used[length] += times
            at += length
        sequence += times
    order = np.argsort(np.array(froms, np.int64))
    starts, first, offset = (np.array(x, np.int64)[order] for x in (froms, firsts, offsets))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64)
        run = np.searchsorted(starts, key, "right") - 1
        return pd.DataFrame({"sequence_id": first[run] + key - starts[run], "offset": offset[run]})

    before = by_part.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(Window.partitionBy("part", "length").orderBy("doc_id", "piece")) - 1
    ranked = pieces.join(before.drop("n"), ["part", "length"]).withColumn("rank", F.col("before") + rank)
    return ranked.withColumn("place", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "place.sequence_id", "place.offset")
