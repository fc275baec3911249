"""Streaks, entries and exits on a stream of ranks, with typed state by series: what is known of a series is one row, and one entry a threshold.

Rows of a series come in order of date, over batches; those of one batch are put in order. A row that is older than the last one of its series is
left out. Every batch gives the present standing of the series that it touched (an update of their former rows), so that the latest
standings give the same streaks, entries and exits as the whole history does. A series that has not been seen for a number of days can expire: a timer
on event time gives its last standing, marked expired, and drops its state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ladderline.model import DEFAULT_THRESHOLDS, SERIES
from ladderline.operators import entry_exit
from ladderline.operators.series import parsed_date, whole_rank
from ladderline.streaming.sinks import BATCH, read_batches, write_batch

#: The state store that transformWithState needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "date": T.DateType(), "boolean": T.BooleanType()}


def _schema(text: str) -> T.StructType:
    """Columns as "name kind, name kind"; no session is needed."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (column.split() for column in text.split(", "))])


_SERIES_STATE = _schema("first_seq long, date_kst string, row_seq long, product_name string, rank int")
#: Of a threshold: the last valid row; the open run; the best closed run; first and last row inside, and how many.
_TOP_STATE = _schema("last_day date, inside boolean, days int, start string, end string, best_days int, best_start string, best_end string, first_date string, first_rank int, last_date string, last_rank int, rows_inside int")
STANDING = _schema(
    ", ".join(f"{c} string" for c in SERIES)
    + ", n int, threshold_pos int, first_seq long, product_name string, latest_date string, latest_rank int, is_active boolean, streak_days int, streak_start string, streak_end string, first_date string, first_rank int, last_date string, last_rank int, rows_inside int, expired boolean"
)


def _next_top(top: dict, day: date | None, date_kst: str, rank: int, n: int) -> None:
    """One more row of a series, with a date and a rank, seen by the threshold n."""
    inside, was_inside = rank <= n, bool(top["inside"])
    known = day is not None and top["last_day"] is not None
    if was_inside and not (inside and known and (day - top["last_day"]).days <= 1):
        # the open run ends; it is lost where the step to the next row inside can't be measured
        if not (inside and not known) and top["days"] > top["best_days"]:
            top.update(best_days=top["days"], best_start=top["start"], best_end=top["end"])
        top["days"] = 0
    if inside:
        top.update(days=top["days"] + 1, start=top["start"] if top["days"] else date_kst, end=date_kst)
    top.update(inside=inside, last_day=day)


def _count_inside(top: dict, date_kst: str, rank: int | None, n: int) -> None:
    if rank is not None and rank <= n:
        if not top["rows_inside"]:
            top.update(first_date=date_kst, first_rank=rank)
        top.update(last_date=date_kst, last_rank=rank, rows_inside=top["rows_inside"] + 1)


_NOTHING = dict.fromkeys(_TOP_STATE.names) | {"inside": False, "days": 0, "best_days": 0, "rows_inside": 0}


class Standings(StatefulProcessor):
    """Value state: the latest row of a series. Map state: by threshold, its runs and entries."""

    def __init__(self, thresholds: Sequence[int], keep_days: int | None) -> None:
        self.thresholds, self.keep_days = list(thresholds), keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.series = handle.getValueState("series", _SERIES_STATE)
        self.tops = handle.getMapState("tops", _schema("threshold_pos int"), _TOP_STATE)

    def _standing(self, key: tuple, series: dict, tops: list[dict], expired: bool = False) -> Iterator[Row]:
        for k, (n, top) in enumerate(zip(self.thresholds, tops, strict=True)):
            # the open run competes as it stands; the earlier of equals wins
            own = ("days", "start", "end") if top["days"] > top["best_days"] else ("best_days", "best_start", "best_end")
            days, start, end = (top[c] for c in own)
            values = (*key, n, k, series["first_seq"], series["product_name"], series["date_kst"], series["rank"], bool(top["inside"]), days, start, end, *(top[c] for c in ("first_date", "first_rank", "last_date", "last_rank", "rows_inside")), expired)
            yield Row(**dict(zip(STANDING.names, values, strict=True)))

    def _tops(self) -> list[dict]:
        found = {k[0]: v for k, v in self.tops.iterator()}
        return [dict(zip(_TOP_STATE.names, found[k], strict=True)) if k in found else dict(_NOTHING) for k in range(len(self.thresholds))]

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        series = dict(zip(_SERIES_STATE.names, self.series.get(), strict=True)) if self.series.exists() else None
        tops, touched = self._tops(), False
        for r in sorted(rows, key=lambda r: (r.date_kst, r.row_seq)):
            if series and (r.date_kst, r.row_seq) <= (series["date_kst"], series["row_seq"]):
                continue
            touched = True
            series = {"first_seq": min(series["first_seq"], r.row_seq) if series else r.row_seq, "date_kst": r.date_kst, "row_seq": r.row_seq, "product_name": r.product_name, "rank": r.rank}
            for n, top in zip(self.thresholds, tops, strict=True):
                _count_inside(top, r.date_kst, r.rank, n)
                if r.rank is not None and r.date_kst:
                    _next_top(top, r.day, r.date_kst, r.rank, n)
        if not touched:
            return
        self.series.update(tuple(series.values()))
        for k, top in enumerate(tops):
            self.tops.updateValue((k,), tuple(top[c] for c in _TOP_STATE.names))
        day = max((t["last_day"] for t in tops if t["last_day"]), default=None)
        if self.keep_days is not None and day:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(int((datetime(day.year, day.month, day.day, tzinfo=timezone.utc) + timedelta(days=self.keep_days)).timestamp() * 1000))
        yield from self._standing(key, series, tops)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        if self.series.exists():
            yield from self._standing(key, dict(zip(_SERIES_STATE.names, self.series.get(), strict=True)), self._tops(), expired=True)
        self.series.clear()
        self.tops.clear()

    def close(self) -> None:
        pass


def standings(stream: DataFrame, thresholds: Sequence[int] | None = None, keep_days: int | None = None, late: str = "0 days") -> DataFrame:
    """A stream of the standings that each batch changes, one row a series and threshold. The session has to have the settings STATE_STORE.

    keep_days: series whose last date is so many days behind the watermark expire; None keeps them all.
    """
    kind = stream.schema["rank"].dataType
    text = F.coalesce(F.col("date_kst").cast("string"), F.lit(""))
    keys = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in SERIES]
    rows = stream.select(*keys, text.alias("date_kst"), parsed_date(text).alias("day"), whole_rank(F.col("rank"), kind).alias("rank"), F.coalesce("product_name_raw", F.lit("")).alias("product_name"), "row_seq")
    if keep_days is not None:
        rows = rows.withColumn("event_time", F.col("day").cast("timestamp")).withWatermark("event_time", late)
    return rows.groupBy(*SERIES).transformWithState(Standings(thresholds or DEFAULT_THRESHOLDS, keep_days), STANDING, "Update", "None" if keep_days is None else "EventTime")


def keep_standings(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch's standings in a folder of its own, replaced if the batch is replayed."""
    return lambda rows, batch: write_batch(rows, path, batch)


def latest_standings(spark: SparkSession, path: str) -> DataFrame:
    """The last standing of every series and threshold, of the batches that were committed."""
    rows = read_batches(spark, path, STANDING)
    return rows.groupBy(*SERIES, "n", "threshold_pos").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in (*SERIES, "n", "threshold_pos"))), BATCH).alias("_s")).select(*SERIES, "n", "threshold_pos", "_s.*").drop(BATCH)


def streaks_of(found: DataFrame) -> DataFrame:
    """The best streaks of the standings, as from the history."""
    rows = found.where("streak_days > 0").withColumnRenamed("n", "top_n_threshold")
    return rows.withColumn("current_rank", F.when(F.col("is_active"), F.col("latest_rank")))


def facts_of(found: DataFrame, lookback_days: int = 7) -> DataFrame:
    """The standings as entry_exit.facts() gives them, for entries_of() and exits_of()."""
    rows = found.where("rows_inside > 0").select(
        *SERIES,
        "n",
        "threshold_pos",
        "first_seq",
        F.struct(F.col("latest_date").alias("date_kst"), F.col("latest_rank").alias("rank"), "product_name").alias("latest"),
        F.struct(F.col("first_date").alias("date_kst"), F.col("first_rank").alias("rank")).alias("first"),
        F.struct(F.col("last_date").alias("date_kst"), F.col("last_rank").alias("rank")).alias("last"),
        F.col("rows_inside").alias("days"),
    )
    # one row, whatever the history
    dates = found.where("latest_date <> ''").agg(F.max("latest_date").alias("latest_date"))
    dates = dates.withColumn("cutoff", F.coalesce(F.date_format(F.date_sub(parsed_date(F.col("latest_date")), lookback_days), "yyyy-MM-dd"), F.lit(entry_exit.NO_CUTOFF)))
    return rows.crossJoin(F.broadcast(dates)).withColumn("top_n_threshold", F.col("n")).withColumn("product_name", F.col("latest.product_name"))
