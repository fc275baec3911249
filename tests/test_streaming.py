"""Streams against batch: standings over restarts, expiry by timers, and appends that happen once whatever fails."""

import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

import __spark_entry__
from ladderline.model import RANK_HISTORY
from ladderline.operators import entry_exit, shocks, streaks
from ladderline.streaming import folded, sinks, standings

HISTORY = "date_kst string, market string, category_key string, rank int, product_name_raw string, product_url string, row_seq long"


@pytest.fixture
def states(spark):
    before = {k: spark.conf.get(k, None) for k in standings.STATE_STORE}
    for k, v in standings.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def histories(seed, n):
    rng = random.Random(seed)
    dates = [f"2024-0{m}-{d:02d}" for m in (1, 2) for d in range(1, 10)] + ["2024-01-05 ?", "2024-01-3", "2024-02-31", ""]
    rows = [(rng.choice(dates), rng.choice([None, *range(1, 14)]), f"name{k}", rng.choice(["a", "a", "b", "c", None]), k) for k in range(n)]
    return [(d, "m", "c", r, name, p and f"https://x/{p}", k) for d, r, name, p, k in rows]


def feed(spark, tmp_path, parts, start):
    """One run of a stream for each part, all from one checkpoint."""
    files = str(tmp_path / "files")
    for rows in parts:
        spark.createDataFrame(rows, HISTORY).coalesce(1).write.mode("append").parquet(files)
        start(spark.readStream.schema(HISTORY).parquet(files)).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()


def rows_of(df, columns):
    return sorted(map(str, df.select(*columns).collect()))


def test_standings_are_those_of_the_history(spark, tmp_path, states):
    rows = sorted(histories(3, 160), key=lambda r: (r[0], r[-1]))
    out = str(tmp_path / "out")
    feed(spark, tmp_path, [rows[:50], rows[50:51], rows[51:]], lambda s: standings.standings(s, [3, 8]).writeStream.outputMode("update").foreachBatch(standings.keep_standings(out)))
    found, history = standings.latest_standings(spark, out), spark.createDataFrame(rows, HISTORY)
    assert sinks.committed_batches(spark, out) == [0, 1, 2]
    assert rows_of(standings.streaks_of(found), streaks.COLUMNS) == rows_of(streaks.best_streaks(history, [3, 8]), streaks.COLUMNS)
    for columns, batch, stream in ((entry_exit.ENTRY_COLUMNS, entry_exit.new_entries, entry_exit.entries_of), (entry_exit.EXIT_COLUMNS, entry_exit.exits, entry_exit.exits_of)):
        assert rows_of(stream(standings.facts_of(found, 20)), columns) == rows_of(batch(history, [3, 8], 20), columns)


def test_series_expire_and_begin_anew(spark, tmp_path, states):
    row = lambda day, product, rank=1: (f"2024-01-{day:02d}", "m", "c", rank, product, product, day)
    out = str(tmp_path / "out")
    parts = [[row(1, "gone"), row(2, "gone"), row(2, "stays")], [row(5, "stays"), row(1, "stays", 9)], [row(9, "stays")], [row(10, "gone"), row(10, "stays")]]
    feed(spark, tmp_path, parts, lambda s: standings.standings(s, [3], keep_days=4).writeStream.outputMode("update").foreachBatch(standings.keep_standings(out)))
    found = sinks.read_batches(spark, out, standings.STANDING).orderBy(sinks.BATCH).collect()
    of = lambda product: [(r.streak_days, r.latest_date, r.expired) for r in found if r.product_url == product]
    assert (2, "2024-01-02", True) in of("gone")  # the timer gives the last standing
    assert of("gone")[-1] == (1, "2024-01-10", False)  # a series that comes back begins anew
    assert not any(expired for *_, expired in of("stays")) and of("stays")[-1] == (2, "2024-01-10", False)


def stored(spark, path):
    return sorted((r.date_kst, r["rank"], r.product_name_raw, r.product_url) for r in sinks.appended_history(spark, path).collect())


def snapshots(*found):
    return [(d, "m", "c", r, name, p, k) for k, (d, r, name, p) in enumerate(found)]


FIRST = snapshots(("2024-01-01", 1, "first", "a"), ("2024-01-01", 1, "again", "a"), ("2024-01-01", 2, "b", "b"))
SECOND = snapshots(("2024-01-01", 2, "later", "b"), ("2024-01-02", 1, "a", "a"), (None, 3, "n", "n"))
EXPECTED = [("2024-01-01", 1, "first", "a"), ("2024-01-01", 2, "b", "b"), ("2024-01-02", 1, "a", "a")]


def test_a_replayed_batch_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "history")
    append = sinks.append_history(path)
    frames = [spark.createDataFrame(rows, HISTORY) for rows in (FIRST, SECOND[:2])]
    assert stored(spark, path) == [] and sinks.appended_history(spark, path).columns[:3] == RANK_HISTORY.names[:3]
    for k in (0, 0, 1, 1, 1):
        append(frames[k], k)
        rows = sinks.appended_history(spark, path)
        assert rows.select("row_seq").distinct().count() == rows.count() == rows.select("row_key").distinct().count()
    assert stored(spark, path) == EXPECTED
    low = lambda k: sinks.appended_history(spark, path).where(F.col(sinks.BATCH) == k).agg(F.min("row_seq"), F.max("row_seq")).first()
    assert low(0)[1] < low(1)[0]


def test_a_write_that_was_not_committed_does_not_count(spark, tmp_path):
    path = str(tmp_path / "history")
    append = sinks.append_history(path)
    append(spark.createDataFrame(FIRST, HISTORY), 0)
    append(spark.createDataFrame(SECOND[:2], HISTORY), 1)
    (tmp_path / "history" / f"{sinks.BATCH}=1" / "_SUCCESS").unlink()  # as if the job had been killed between its files and its commit
    assert stored(spark, path) == EXPECTED[:2]
    append(spark.createDataFrame(SECOND[:2], HISTORY), 1)
    assert stored(spark, path) == EXPECTED


@pytest.mark.parametrize("after_write", [True, False])
def test_a_stream_that_dies_in_a_batch_goes_on_without_loss_or_copies(spark, tmp_path, after_write):
    path, died = str(tmp_path / "history"), []
    append = sinks.append_history(path)

    def dying(rows, batch):
        if batch == 1 and not died:
            died.append(batch)
            if after_write:
                append(rows, batch)
            raise RuntimeError("killed")
        append(rows, batch)

    feed(spark, tmp_path, [FIRST], lambda s: s.writeStream.foreachBatch(dying))
    with pytest.raises(StreamingQueryException):
        feed(spark, tmp_path, [SECOND], lambda s: s.writeStream.foreachBatch(dying))
    files = str(tmp_path / "files")
    spark.readStream.schema(HISTORY).parquet(files).writeStream.foreachBatch(dying).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    assert died == [1] and [r for r in map(tuple, sinks.appended_history(spark, path).where('date_kst is not null').select('date_kst', 'rank', 'product_name_raw', 'product_url').orderBy('date_kst', 'rank').collect())] == EXPECTED


def test_folded_batches_give_what_the_history_gives(spark, tmp_path):
    """Unreadable dates and ranks, rows that come too late, a batch that is replayed, and series that are first outside."""
    rows = sorted(histories(4, 260), key=lambda r: (r[0], r[-1]))
    parts = [rows[:70], rows[70:71], rows[71:200], [*rows[200:], ("2023-12-31", "m", "c", 1, "late", "https://x/a", 999)]]
    out, jumps = str(tmp_path / "out"), str(tmp_path / "jumps")
    fold, step = folded.keep_folded(out, [3, 8]), folded.keep_shocks(jumps)
    for k, part in enumerate(parts):
        for _ in range(2):
            fold(spark.createDataFrame(part, HISTORY).repartition(3), k)
            step(spark.createDataFrame(part, HISTORY).repartition(3), k)
    found, history = folded.latest_folded(spark, out, [3, 8]), spark.createDataFrame(rows, HISTORY)
    assert found.schema.names == standings.STANDING.names and found.count() == 2 * history.select(F.coalesce("product_url", F.lit(""))).distinct().count()
    assert rows_of(standings.streaks_of(found), streaks.COLUMNS) == rows_of(streaks.best_streaks(history, [3, 8]), streaks.COLUMNS)
    for columns, batch, stream in ((entry_exit.ENTRY_COLUMNS, entry_exit.new_entries, entry_exit.entries_of), (entry_exit.EXIT_COLUMNS, entry_exit.exits, entry_exit.exits_of)):
        assert rows_of(stream(standings.facts_of(found, 20)), columns) == rows_of(batch(history, [3, 8], 20), columns)
    assert rows_of(folded.folded_shocks(spark, jumps), shocks.COLUMNS) == rows_of(shocks.shocks(history), shocks.COLUMNS)
    assert len(sinks.committed_batches(spark, f"{out}/series")) == 2  # the state is not kept for every batch


def test_streamed_queries_run_no_row_in_python(spark, tmp_path, monkeypatch):
    """Calls to Python by series took most of their time."""
    for name in ("transformWithState", "applyInPandasWithState"):
        monkeypatch.setattr(f"pyspark.sql.group.GroupedData.{name}", lambda *a, **k: pytest.fail("a state in Python"), raising=False)
        monkeypatch.setattr(f"pyspark.sql.pandas.group_ops.PandasGroupedOpsMixin.{name}", lambda *a, **k: pytest.fail("a state in Python"), raising=False)
    for name in ("streamed_streaks", "streamed_shocks"):
        assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0
