"""Packing: pieces and ids by an exact round trip, few sequences against the bound and an exact search."""

import random
import zlib
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest

from ladderline.llm import packing
from tests.llm.conftest import SCHEMA, frame

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def test_ids_are_those_of_the_tokenizers_library(corpus):
    rng = random.Random(8)
    bits = [" ", "  ", "\n", " \n", "\t", " ", "　", "\x1c", "\x85", "don't", "I'll", "é", "ß", "日本", "12", "3.5", "!!", "a", "Word", "<|endoftext|>", "_", "🙂"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y <|endoftext"] + [t for _, t in corpus if t] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    words, whole = packing.word_ids(VOCABULARY), tokenizer()
    for text, encoded in zip(texts, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(words.of_text(text), "<u4").tolist() == encoded.ids, repr(text)


@pytest.mark.parametrize("space", [" ", "\n", "\t", " \n", "\r\n", "\u3000 "])
def test_long_white_space(space):
    run = space * (1_000_000 // len(space))
    words, whole = packing.word_ids(VOCABULARY), tokenizer()
    for text in (run, "a" + run + "b", run + "<|endoftext|>" + run + "x", "one two" + run[: packing.LONGEST_RUN] + "b  c", "a" + run[: packing.LONGEST_RUN + 1] + "b"):
        assert words.of_text(text) == np.asarray(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_long_white_space_in_a_table(spark):
    rows = [(1, "a" + " " * 1_000_000 + "b"), (2, "\n" * 1_000_000), (3, "plain words"), (4, "x" * 200_000)]
    found = packing.pack(frame(spark, rows), VOCABULARY).groupBy("doc_id").agg({"length": "sum"}).collect()
    assert {d: n for d, n in map(tuple, found)} == {d: len(tokenizer().encode(t, add_special_tokens=False).ids) + 1 for d, t in rows}


def test_pieces_and_places(spark, corpus):
    rows = [r for r in corpus if r[0] is not None]
    found = packing.pack(frame(spark, rows), VOCABULARY, 256).collect()
    whole = tokenizer()
    expected = []
    for d, t in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        cuts = [0, *range(len(ids) % 256 or 256, len(ids) + 1, 256)]
        expected += [(d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(pairwise(cuts))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(expected)
    by = {}
    for r in sorted(found, key=lambda r: r.offset):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 256 and len(by) <= 1.05 * -(-sum(by.values()) // 256) + 1


def fewest(lengths, capacity):
    """The least number of sequences, by exhaustive search."""
    lengths = sorted(lengths, reverse=True)
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in set(rooms):
            if room >= lengths[k]:
                rest = list(rooms)
                rest.remove(room)
                place(k + 1, [*rest, room - lengths[k]])
        place(k + 1, [*rooms, capacity - lengths[k]])

    place(0, [])
    return best


def count(plan):
    return sum(times for _, times in plan)


def test_dominance_leaves_a_best_packing_possible():
    rng = random.Random(6)
    for _ in range(150):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        counts = np.bincount(lengths, minlength=21)
        fixed, left = packing.dominance_reduction(counts)
        rest = np.repeat(np.arange(21), left).tolist()
        assert sum(sum(p) * t for p, t in fixed) + sum(rest) == sum(lengths)
        assert count(fixed) + fewest(rest, 20) == fewest(lengths, 20), lengths


def test_best_fit_is_the_step_by_step_one():
    rng = random.Random(7)
    for _ in range(200):
        lengths = sorted((rng.randint(1, 30) for _ in range(rng.randint(1, 60))), reverse=True)
        rooms = []
        for x in lengths:
            fits = [r for r in rooms if r >= x]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - x)
            else:
                rooms.append(30 - x)
        plan = packing.best_fit(np.bincount(lengths, minlength=31))
        assert count(plan) == len(rooms)
        assert sorted(x for p, t in plan for x in p * t) == sorted(lengths) and all(sum(p) <= 30 for p, _ in plan)


def test_large_counts_are_planned_quickly():
    counts = np.random.default_rng(1).integers(0, 10**9, 2049)
    counts[0] = 0
    plan = packing.packing_plan(counts)
    assert count(plan) <= 1.03 * (counts * np.arange(2049)).sum() / 2048


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, ""), (1, ""), (None, "x")]])
def test_odd_tables(spark, rows):
    docs = frame(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
    assert len(packing.pack(docs.withColumnRenamed("source", "piece"), VOCABULARY).collect()) == len(rows)
