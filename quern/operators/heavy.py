"""Per-key results where a few keys hold most rows: dense accumulator arrays.

Rows are first reduced to different (key, id) pairs, hashed by both, so a key's pairs lie spread over all tasks in equal
splits. Each split encodes its keys with a dictionary of its own and adds into dense arrays by ``numpy.bincount``; it gives
out one number a key, however many rows the key has. These partial arrays are summed in blocks of keys: a block's task encodes
the keys it gets and scatter-adds the partial counts, at most one a split for each key. No task ever holds the rows of one
key, and the work of a task follows the number of its rows or of its different keys only.

Null keys and ids are left out. Values are summed over different pairs, of repeated pairs the largest value; null values add
nothing, and a key without any value has a null total.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written

_ARRAYS = "key string, n long, total long, values long"


class _Dense:
    """Accumulator arrays over a dictionary of keys."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.sums = np.zeros((3, 1024), np.int64)

    def add(self, keys: pa.Array, *columns: np.ndarray) -> None:
        encoded = pc.dictionary_encode(keys)
        own = encoded.dictionary.to_pylist()
        codes = self.codes
        place = np.fromiter((codes.setdefault(k, len(codes)) for k in own), np.int64, len(own))
        if len(codes) > self.sums.shape[1]:
            self.sums = np.pad(self.sums, ((0, 0), (0, max(len(codes), 2 * self.sums.shape[1]) - self.sums.shape[1])))
        at = encoded.indices.to_numpy()
        for row, column in zip(self.sums, columns):
            # counts by bincount in integers: a float weight would lose digits beyond 2^53
            part = np.bincount(at, minlength=len(own)) if column is None else np.zeros(len(own), np.int64)
            if column is not None:
                np.add.at(part, at, column)
            row[place] += part

    def batch(self) -> pa.RecordBatch:
        n = len(self.codes)
        return pa.RecordBatch.from_arrays([pa.array(list(self.codes), pa.string()), *(pa.array(row[:n], pa.int64()) for row in self.sums)], names=["key", "n", "total", "values"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    dense = _Dense()
    for batch in batches:
        value = batch.column(1)
        dense.add(batch.column(0), None, pc.fill_null(value, 0).to_numpy(zero_copy_only=False), pc.is_valid(value).to_numpy(zero_copy_only=False).astype(np.int64))
    if dense.codes:
        yield dense.batch()


def _block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    dense = _Dense()
    for batch in batches:
        dense.add(batch.column(0), *(batch.column(k).to_numpy() for k in (1, 2, 3)))
    if dense.codes:
        yield dense.batch()


def key_totals(rows: DataFrame, key: str, id: str, value: str) -> DataFrame:
    """(key, n, total): for each key its different ids and the sum of their values."""
    pairs = rows.where(F.col(key).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(key).alias("key"), F.col(id).alias("id")).agg(F.max(value).cast("long").alias("value"))
    partial = pairs.select("key", "value").mapInArrow(_split, _ARRAYS)
    return partial.repartition("key").mapInArrow(_block, _ARRAYS).select("key", "n", F.when(F.col("values") > 0, F.col("total")).alias("total"))


def dominant_keys(totals: DataFrame, share: float) -> DataFrame:
    """(key, n, total, share): keys that own at least this share of all different pairs."""
    totals = written(totals, "totals")
    n = totals.agg(F.sum("n")).first()[0] or 0  # one number
    return totals.where(F.col("n") >= F.lit(share) * F.lit(float(n))).withColumn("share", F.col("n") / F.lit(float(max(1, n))))
