"""The source audit against brute force over every kept term and every pair of groups."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ladderline.llm import source_audit
from tests.llm.conftest import SCHEMA


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(k, t, lang, source, 0) for k, (t, lang, source) in enumerate(rows)], schema).repartition(3)


def terms(text):
    return [m.translate({c: c + 32 for c in range(65, 91)}) for m in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def expected(rows, min_docs=3, top=200):
    df, n = defaultdict(Counter), defaultdict(Counter)
    groups = defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = terms(text)
        df[lang].update(set(found))
        n[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, c in df[lang].items() if c >= min_docs)
        v = len(kept)

        def shares(count, kept=kept, v=v):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + v) for t in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted(((sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources - {s}), key=lambda x: (-x[0], x[1].encode()))
            own = sorted(((f(p[s][t], q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, value, k + 1) for k, (value, o) in enumerate(pairs)]
            out += [(lang, s, "term", t, value, k + 1) for k, (value, t) in enumerate(own[:top])]
    return sorted(out)


def some_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "Éa", "日本", "x1y", "a_b", "ZZ", *("w" + chr(97 + k) * (1 + k // 7) for k in range(40))]
    rows = [(" ".join(rng.choice(words[k % 5 :]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s2", "s2", "s3", None, "S"])) for k in range(n)]
    return [*rows, (None, "en", "none"), ("", "fr", "alone"), ("12 !", "es", "s1"), ("rare", "es", "s2"), (" ".join(["the"] * 5000), "en", "s1")]


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, seed):
    rows = some_rows(seed)
    assert sorted(map(tuple, source_audit.audit_sources(frame(spark, rows)).collect())) == expected(rows)
    # a sketch so small that it rules out next to nothing, and other bounds
    small = source_audit.audit_sources(frame(spark, rows), min_docs=2, top=4, sketch_width=1 << 16)
    assert sorted(map(tuple, small.collect())) == expected(rows, 2, 4)


def test_counts_handed_on_early_are_added_up(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "HELD", 7)
    rows = some_rows(5)
    assert sorted(map(tuple, source_audit.audit_sources(frame(spark, rows)).collect())) == expected(rows)


@pytest.mark.parametrize("width", [1 << 10, 1 << 16])
def test_the_sketch_never_underestimates_and_rules_out_most(spark, width):
    rng = random.Random(9)
    rows = [(" ".join(["common", f"pair{'abcdefghij'[k % 10]}", "only" + "".join(rng.choice("abcdefgh") for _ in range(9))]), "en", f"s{k % 4}") for k in range(300)]
    docs = frame(spark, rows)
    alive = {r.term for r in source_audit.possible_terms(docs, source_audit.frequency_sketch(docs, 3, width=width), width).collect()}
    frequent = {"common", *(f"pair{c}" for c in "abcdefghij")}
    assert frequent <= alive and len(alive) < len(frequent) + (5 if width == 1 << 16 else 60)


@pytest.mark.parametrize("piece", [3, 10, 1 << 20])
def test_hashes_of_a_text_are_those_of_its_terms(monkeypatch, piece):
    monkeypatch.setattr(source_audit, "HASHED", piece)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["the", "The", " ", "é", "É", "1", "\x00", "日本", "averyverylongterm"]) for _ in range(rng.randint(0, 12)))
        own = sorted({t.encode() for t in terms(text)})
        assert np.array_equal(source_audit.term_hashes(text.encode()), np.sort(source_audit._hashes(own)))


def test_shares_are_exact(spark):
    rng = random.Random(1)
    values = [(0, 1, 1), (0, 0, 1), (10**15 - 1, 10**15 - 2, 2)] + [(rng.randrange(t + 1), t, rng.randint(1, 10**9)) for t in (rng.randrange(10 ** rng.randint(1, 14)) for _ in range(500))]
    found = spark.createDataFrame(values, "n long, total long, v long").select("*", source_audit.share(F.col("n"), F.col("total"), F.col("v")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.n + 1) // (r.total + r.v) for r in found)


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [("a a a", "en", "x")] * 3, [("", "en", "x"), ("", "en", "y")]])
def test_odd_tables(spark, rows):
    docs = frame(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
    docs = docs.withColumnRenamed("n_chars", "term")
    assert sorted(map(tuple, source_audit.audit_sources(docs).collect())) == expected(rows)
