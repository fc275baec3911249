"""Numpy helpers inside tasks: hashes of byte ranges from prefix sums, and sorted groups over Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import from_arrow_schema

_RANDOM = np.random.default_rng(7)
_BYTE = _RANDOM.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C55
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2^64."""
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHashes:
    """Hashes of ranges of a byte string, equal for equal bytes wherever they stand."""

    def __init__(self, b: np.ndarray) -> None:
        up, self.down = _powers(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_BYTE[b] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def of_length(self, k: int) -> np.ndarray:
        """Of every range of k bytes; not mixed."""
        return (self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    reach = 1
    while 2 * reach <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    return np.minimum(values[: len(values) - (width - reach)], values[width - reach :]) if width > reach else values


def grouped_arrow(df: DataFrame, keys: list[str], order: list[Column], schema: pa.Schema, of_groups: Callable[[pa.Table, np.ndarray], dict[str, object]]) -> DataFrame:
    """Calls a function with rows of whole groups, in order, and the groups' edges; a group comes from one partition, sorted by Spark.

    Unlike a grouped map, many small groups share one call. A group's rows have to fit in memory: callers bound them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
            columns = [table.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
            found = of_groups(table, np.array([0, *change, table.num_rows]))
            if len(found[schema.names[0]]):
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in schema], schema=schema)

        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            # the last key of a batch may go on in the next one
            same = np.logical_and.reduce([table.column(k).to_numpy(zero_copy_only=False) == table.column(k)[-1].as_py() for k in keys])
            at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if at:
                yield from done(pa.concat_tables([*held, table.slice(0, at)]))
                held = [table.slice(at)]
            else:
                if held and any(held[-1].column(k)[-1].as_py() != table.column(k)[0].as_py() for k in keys):
                    yield from done(pa.concat_tables(held))
                    held = []
                held.append(table)
        if held:
            yield from done(pa.concat_tables(held))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, from_arrow_schema(schema))
