"""Streaming forms: appending without duplicates, and rank shocks as they happen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ladderline.model import SERIES
from ladderline.operators.series import parsed_date
from ladderline.sources.store import row_key

SHOCKS = "product_name string, product_url string, market string, category_key string, date string, previous_date string, previous_rank int, new_rank int, change int, change_type string"


def new_rows(stream: DataFrame, late: str = "2 days") -> DataFrame:
    """Rows of a history stream whose key was not seen within the watermark. State is bounded by the watermark."""
    rows = stream.withColumn("row_key", row_key()).withColumn("event_time", parsed_date(F.col("date_kst")).cast("timestamp"))
    return rows.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["row_key"])


def streaming_shocks(stream: DataFrame, threshold: int = 3) -> DataFrame:
    """Shocks between a product's row and its last one, which is all that is kept of a series.

    Rows of one micro-batch are put in order of date; a row older than the last one seen is left out.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_date, last_rank = state.get if state.exists else (None, None)
        out = []
        for row in pd.concat(list(frames)).sort_values("date_kst", kind="stable").itertuples():
            if last_date is not None and row.date_kst < last_date:
                continue
            day = pd.to_datetime(row.date_kst, format="%Y-%m-%d", errors="coerce")
            before = pd.to_datetime(last_date, format="%Y-%m-%d", errors="coerce")
            rank = None if pd.isna(row.rank) else int(row.rank)
            if rank is not None and last_rank is not None and (day - before).days <= 2 and abs(last_rank - rank) >= threshold:
                out.append((row.product_name_raw, *key, row.date_kst, last_date, last_rank, rank, last_rank - rank, "improved" if last_rank > rank else "dropped"))
            last_date, last_rank = row.date_kst, rank
        if last_date is not None:
            state.update((last_date, last_rank))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SHOCKS.split(", ")])

    return stream.groupBy(*SERIES).applyInPandasWithState(step, SHOCKS, "date string, rank int", "append", GroupStateTimeout.NoTimeout)
