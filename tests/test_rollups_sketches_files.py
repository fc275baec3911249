"""Groupings, frames, sketches and text files against plain restatements."""

import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ladderline import scan_queries
from ladderline.functions.urls import crawl_delay, crawl_delay_of
from ladderline.operators import rollups, sketches
from ladderline.sources import text_files

HISTORY = "date_kst string, market string, category_key string, rank int, product_name_raw string, product_url string, row_seq long"


def histories(seed, n=200):
    rng = random.Random(seed)
    day = lambda: (date(2024, 1, 28) + timedelta(days=rng.randint(0, 12))).isoformat()
    return [(rng.choice([day(), day(), day(), "n/a"]), rng.choice("mk"), "c", rng.choice([None, *range(1, 30)]), "x", rng.choice("abc"), k) for k in range(n)]


def test_grouping_sets(spark):
    rows = histories(1)
    found = rollups.grouping_sets(spark.createDataFrame(rows, HISTORY), [["market", "month"], ["market"], []]).collect()
    expected = defaultdict(list)
    for r in rows:
        for key, bits in (((r[1], r[0][:7]), 0), ((r[1], None), 1), ((None, None), 3)):
            expected[*key, bits].append(r)
    assert len(found) == len(expected)
    for r in found:
        own = expected[r.market, r.month, r.grouping_id]
        ranks = [x[3] for x in own if x[3] is not None]
        assert (r.n_rows, r.n_products, r.best_rank, r.rank_sum) == (len(own), len({x[5] for x in own}), min(ranks), sum(ranks))


def test_frames_are_of_days_not_of_rows(spark):
    rows = histories(2)
    found = {r.row_seq: r for r in rollups.rank_trends(spark.createDataFrame(rows, HISTORY), 3).collect()}
    known = [(r, date.fromisoformat(r[0])) for r in rows if r[0] != "n/a" and r[3] is not None]
    assert set(found) == {r[-1] for r, _ in known}
    for r, day in known:
        own = [(d, x[-1], x[3]) for x, d in known if x[5] == r[5] and x[1] == r[1] and timedelta(0) <= day - d <= timedelta(days=2)]
        f = found[r[-1]]
        assert (f.days_seen, f.best_rank, f.oldest_rank) == (len(own), min(x[2] for x in own), min(own)[2]) and f.mean_rank == pytest.approx(sum(x[2] for x in own) / len(own), abs=1e-6)


def test_merged_sketches_are_within_their_errors(spark, tmp_path):
    path = str(tmp_path / "sketches")
    rows = spark.range(60_000).select((F.col("id") % 12).alias("day"), (F.xxhash64("id") % 20_011).alias("key"), F.when(F.col("id") % 10 > 0, F.col("id") / 3).alias("value"), F.when(F.col("id") % 4 == 0, "hot").otherwise(F.concat(F.lit("i"), (F.col("id") % 5_000).cast("string"))).alias("item"))
    build = lambda rows: sketches.sketched(rows, ["day"], F.col("key"), F.col("value"), F.col("item"))
    sketches.store_sketches(build(rows.where("day < 6")), path, "day")
    sketches.store_sketches(build(rows.where("day >= 5")), path, "day")  # day 5 is stored again
    stored = sketches.read_sketches(spark, path)
    assert stored.count() == 12
    direct = sketches.sketched(rows, [], F.col("key"), F.col("value"), F.col("item"))
    exact = rows.agg(F.count_distinct("key"), F.count("value")).first()
    for found in (sketches.merged(stored, []), direct):
        r = sketches.estimates(found, [0.1, 0.5, 0.9], 2).first()
        assert r.n_rows == 60_000 and abs(r.distinct_keys / exact[0] - 1) < 4 * sketches.DISTINCT_ERROR
        for fraction, value in zip((0.1, 0.5, 0.9), r.quantiles, strict=True):
            assert abs(rows.where(F.col("value") <= value).count() / exact[1] - fraction) < 2 * sketches.RANK_ERROR
        assert r.frequent[0].item == "hot" and abs(r.frequent[0]["count"] - 15_000) <= 60_000 / sketches.TRACKED
    some = sketches.estimates(sketches.merged(stored.where("day IN (1, 2)"), []), [0.5], 1).first()
    assert some.n_rows == 10_000


def test_counts_beside_sketches_are_exact(spark, tmp_path):
    """More users than a sketch counts exactly, a null type, and a type without values."""
    day = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") % 200_000).alias("ts")
    kind = F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 7 == 1, "empty").otherwise(F.concat(F.lit("k"), (F.col("id") % 3).cast("string")))
    user = F.when(F.col("id") % 11 == 0, None).when(F.col("id") % 13 < 2, F.lit(5)).otherwise(F.col("id") % 9_973)
    rows = spark.range(60_000).select(F.col("id").alias("event_id"), day, user.alias("user_id"), kind.alias("event_type"), F.when(F.col("id") % 7 != 1, F.rand(3)).alias("value"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    rows = spark.read.parquet(str(tmp_path / "events.parquet"))
    users = rows.groupBy("event_type", "user_id").count().groupBy("event_type").agg(F.sum("count"), F.count_if(F.col("user_id").isNotNull()), F.max("count"))
    found = scan_queries.event_sketches(spark, str(tmp_path)).collect()
    assert sorted(map(str, ((*r[:4],) for r in found))) == sorted(map(str, map(tuple, users.collect()))) and all(r.median_within for r in found) and len(found) == 5


SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_text_files(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"a": 1, "b": "é\\n"}\n{"a": "x", "b": "y"}\n{"a": 2\n{"c": 3}\n')
    rows = text_files.read_json(spark, str(tmp_path / "x.json"), SCHEMA).collect()
    assert [(r.a, r.b, r[text_files.CORRUPT] is None) for r in rows] == [(1, "é\n", True), (None, "y", False), (None, None, False), (None, None, True)]
    tricky = spark.createDataFrame([(1, 'a "quoted", text\nover lines'), (2, ""), (3, None), (None, "é")], SCHEMA).coalesce(1)
    text_files.write_csv(tricky, str(tmp_path / "csv"))
    good, bad = text_files.split_corrupt(text_files.read_csv(spark, str(tmp_path / "csv"), SCHEMA))
    assert sorted(map(str, good.collect())) == sorted(map(str, tricky.collect())) and bad.collect() == []
    text_files.write_json(tricky, str(tmp_path / "json"))
    assert sorted(map(str, text_files.split_corrupt(text_files.read_json(spark, str(tmp_path / "json"), SCHEMA))[0].collect())) == sorted(map(str, tricky.collect()))
    for name, sql in (("1", "1L AS a"), ("2", "2L AS a, 'z' AS b")):
        spark.sql(f"SELECT {sql}").write.parquet(str(tmp_path / "merged" / name))
    assert sorted(map(tuple, text_files.read_merged(spark, str(tmp_path / "merged" / "*")).select("a", "b").collect())) == [(1, None), (2, "z")]


def test_crawl_delays_as_a_fold(spark):
    rng = random.Random(1)
    lines = ["User-agent: *", "user-agent: ladder", "USER-AGENT: Ladderline/1.0", "User-agent: other", "User-agent:", "Crawl-delay: 3", " crawl-delay : 4", "Crawl-delay:5.5", "crawl-delay: -1", "crawl-delay: 1e1", "crawl-delay: 7d", "crawl-delay: soon", "crawl-delay:", "# x", "", "Disallow: /"]
    ends = ["\n", "\r\n", "\r", "\n\n", " ", "\x0b"]
    texts = [None, "", *("".join(rng.choice(lines) + rng.choice(ends) for _ in range(rng.randint(1, 9))) for _ in range(300))]
    found = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", crawl_delay(F.col("t"), F.lit("Ladderline/1.0")).alias("delay"))
    assert {r.k: r.delay for r in found.collect()} == {k: crawl_delay_of(t, "Ladderline/1.0") for k, t in enumerate(texts)}
