"""Fill-in-middle against the same rule in Python, with texts that hold delimiters, escapes and sentinels."""

import hashlib
import random
import re

import pytest

from ladderline.llm import infill
from tests.llm.conftest import SCHEMA, frame

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = sha(f"42:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 80 else "psm"
    output = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), form, len(prefix), len(middle), sha(output), sha(text)


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def check(spark, rows):
    assert in_order(infill.digests(frame(spark, rows)).collect()) == in_order(expected(d, t) for d, t, *_ in rows)


def test_against_the_rule_in_python(spark, corpus):
    rng = random.Random(2)
    bits = [" ", "  ", "\n", "\t ", "word", "<", "<P", "<S", "<M", "P>", ">", "S>", "M>", "é", "日本", "🙂", "\x00", "\x01", "\x02", "\x01e", "\x02d", "\x02e", "\x01\x02", "d", "e", "$0", "\\", "\x1c", "\xa0", "\r\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(3000)]
    check(spark, [*corpus, *((1000 + k, t) for k, t in enumerate(texts)), (9001, "a <P> b"), (9002, "<M>"), (-5, "one two three")])


def test_long_texts(spark):
    rows = [(k, t) for k, t in enumerate(["ab " * 300_000, "a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "x" * 1_000_000, "\x01\x02" * 300_000] * 4)]
    check(spark, rows)


def test_forms_and_places_are_spread(spark):
    rows = infill.transform(frame(spark, [(k, " ".join(map(str, range(50)))) for k in range(3000)])).collect()
    share = lambda form: sum(r.form == form for r in rows) / len(rows)
    assert 0.46 < share("plain") < 0.54 and 0.36 < share("spm") < 0.44 and 0.07 < share("psm") < 0.13
    assert all(r.prefix + r.middle + r.suffix == r.text for r in rows if r.form != "plain")
    assert all(r.output == r.text and r.prefix is None for r in rows if r.form == "plain")


def test_no_python_in_the_plan(spark):
    plan = infill.digests(frame(spark, [(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Exchange hash", plan)
    assert plan.count("regexp_replace") == 1


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "x y"), (None, "x y")], [(1, "a b"), (1, "a b"), (1, "c")]])
def test_odd_tables(spark, rows):
    docs = frame(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
    docs = docs.withColumnRenamed("source", "_text").withColumnRenamed("lang", "form")
    assert in_order(infill.digests(docs).collect()) == in_order(expected(d, t) for d, t, *_ in rows)
    kept = infill.transform(docs)
    assert kept.columns == ["doc_id", "text", "_text", "n_chars", "n", "form", "prefix", "middle", "suffix", "output"]
    assert [r._text for r in kept.collect()] == ["src0"] * len(rows)
