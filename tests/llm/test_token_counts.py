"""Token counts against the library itself, over texts made to part the normal form from the text, and over a cache that fills."""

import random

import public_tokenizers
import pytest

from ladderline.llm import token_counts
from tests.llm.conftest import SCHEMA, frame

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BITS = [" ", "  ", "\n", " \n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "don't", "I'LL", "É", "É", "H̱", "ẖ", "İ", "İ", "ΑΣ", "Σ", "ß", "ẞ", "ﬁ", "日本", "12", "3.5", "!!", "'s", "'", "S", "Word", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|", "_", "🙂", "́", "\x00", "K"]


def counts(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(VOCABULARY).encode_batch(texts, add_special_tokens=False)]


def stored(spark, cache):
    return sorted(map(tuple, token_counts.read_cache(spark, cache, token_counts.tokenizer_digest(VOCABULARY)).collect()))


def rows_of(found):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in found.collect())


def expected(rows, limit=token_counts.LIMIT):
    texts = [t or "" for _, t, *_ in rows]
    return sorted((r[0] is None, r[0] or 0, len(t.encode()), n, n > limit) for r, t, n in zip(rows, texts, counts(texts), strict=True))


def test_counts_are_those_of_the_library(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 30)))) for k in range(2500)]
    assert rows_of(token_counts.count_tokens(frame(spark, rows), VOCABULARY, str(tmp_path / "c"))) == expected(rows)


def test_long_texts(spark, tmp_path):
    rows = [(1, "ab " * 200_000), (2, "a" + " " * 1_000_000 + "b"), (3, "\n" * 1_000_000), (4, "x" * 100_000), (5, "Ab1!" * 20_000), (6, "é" * 50_000)]
    assert rows_of(token_counts.count_tokens(frame(spark, rows), VOCABULARY, str(tmp_path / "c"))) == expected(rows)


def test_only_distinct_misses_are_encoded_and_stored(spark, tmp_path, corpus, monkeypatch):
    cache, asked = str(tmp_path / "c"), []
    encoded = token_counts.encoded

    def seen(rows, vocabulary):
        asked.append(rows.count())
        return encoded(rows, vocabulary)

    monkeypatch.setattr(token_counts, "encoded", seen)
    corpus = list(dict.fromkeys(corpus))  # a row that is repeated with its doc_id would be encoded twice
    first = [r for r in corpus if r[0] is not None and r[0] % 2]
    for batch in (first, corpus, corpus):
        assert rows_of(token_counts.count_tokens(frame(spark, batch), VOCABULARY, cache)) == expected(batch)
    forms = lambda rows: {" ".join((t or "").split()).lower() if (t or "").isascii() else " ".join((t or "").split()) for _, t, *_ in rows}
    assert asked == [len(forms(first)), len(forms(corpus) - forms(first))]  # the third batch asks for nothing
    assert len(stored(spark, cache)) == len(forms(corpus)) == spark.read.parquet(cache).count()


def test_stored_counts_are_used_and_other_tokenizers_do_not_see_them(spark, tmp_path):
    cache = str(tmp_path / "c")
    rows = [(1, "Some words"), (2, "some  WORDS\n"), (3, "others")]
    token_counts.count_tokens(frame(spark, rows), VOCABULARY, cache).collect()
    # a count that no library gives shows where it came from
    wrong = spark.read.parquet(cache).withColumn("n_tokens", token_counts.F.lit(77).cast("long")).toPandas()
    for name, given in ((token_counts.tokenizer_digest(VOCABULARY), 77), ("another", None)):
        at = str(tmp_path / name[:7])
        spark.createDataFrame(wrong.assign(tokenizer=name)).write.partitionBy("tokenizer").parquet(at)
        found = token_counts.count_tokens(frame(spark, rows), VOCABULARY, at)
        assert [r[3] for r in rows_of(found)] == ([given] * 3 if given else [r[3] for r in expected(rows)])


def test_counts_that_two_runs_append_are_used_once(spark, tmp_path):
    cache, rows = str(tmp_path / "c"), [(1, "some words"), (2, None)]
    token_counts.count_tokens(frame(spark, rows), VOCABULARY, cache).collect()
    spark.read.parquet(cache).toPandas().pipe(spark.createDataFrame).write.mode("append").partitionBy("tokenizer").parquet(cache)
    assert rows_of(token_counts.count_tokens(frame(spark, rows), VOCABULARY, cache)) == expected(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "x"), (None, "x"), (None, "y")], [(1, "a b"), (1, "a b"), (1, "c")], [(k, "One TEXT") for k in range(500)]])
def test_odd_tables(spark, tmp_path, rows):
    docs = frame(spark, rows) if rows else spark.createDataFrame([], SCHEMA)
    docs = docs.withColumnRenamed("source", "digest").withColumnRenamed("lang", "n_tokens")
    assert rows_of(token_counts.count_tokens(docs, VOCABULARY, str(tmp_path / "c"), limit=1)) == expected(rows, 1)


def test_a_word_that_left_the_dictionary_comes_back(monkeypatch):
    monkeypatch.setattr(token_counts.WordCounts, "MOST", 3)
    own, rng = token_counts.WordCounts(VOCABULARY), random.Random(1)
    texts = [" ".join(rng.choice(["one", "two", "Three", "four5", "six!", "", "seven"]) for _ in range(9)) for _ in range(50)]
    assert [own.of_text(t) for t in texts] == counts(texts) and len(own) <= 3 and len(own.older) <= 3


def test_tokenizers_that_keep_white_space_are_refused(spark, tmp_path):
    with pytest.raises(ValueError, match="white space"):
        token_counts.count_tokens(frame(spark, [(1, "x")]), public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "c"))
