"""Running totals in a total order, without gathering a key in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from signalops.functions.lineage import cut


def running(df: DataFrame, key: str, order: list[str], weight: str | None = None, name: str = "pos") -> DataFrame:
    """Add ``name``: the sum of ``weight`` (1 if None) over the rows of the same key that come earlier in ``order``.

    Rows are dealt by ranges of (key, order), so a key with a third of all rows is spread over many tasks. Each task
    adds up its own rows; only the keys that cross a border of two tasks need the sums of earlier tasks, and there is at
    most one such key a task, so that table is bounded by the number of partitions. ``key`` is not null; the weight is a long;
    rows that tie in ``order`` should be interchangeable or carry a unique last column.
    """
    if weight is None:
        return running(df.withColumn("__one", F.lit(1).cast("bigint")), key, order, "__one", name).drop("__one")
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, carry, heading = TaskContext.get().partitionId(), None, 0, True
        for b in batches:
            if not b.num_rows:
                continue
            k, w = b.column(names.index(key)), b.column(names.index(weight)).to_numpy(zero_copy_only=False)
            new = np.concatenate(([last is not None and k[0] != last], pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False))).astype(bool)
            before = np.cumsum(w) - w
            first = np.maximum.accumulate(np.where(new, np.arange(len(w)), -1))
            local = before - np.where(first < 0, -carry, before[first])
            head = np.logical_and(heading, np.cumsum(new) == 0)
            last, carry, heading = k[-1], int(local[-1] + w[-1]), bool(head[-1])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(local, pa.int64()), pa.array(head), pa.array(np.full(len(w), pid, np.int32))],
                                             [*names, name, "__head", "__pid"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{name}` bigint, __head boolean, __pid int"
    at = [F.col(c) for c in (key, *order)]
    t = cut(df.repartitionByRange(*at).sortWithinPartitions(*at).mapInArrow(run, types))
    crossing = t.where("__head").select(key).distinct()
    sums = t.join(F.broadcast(crossing), key).groupBy(key, "__pid").agg(F.sum(weight).alias("__sum"))
    past = F.sum("__sum").over(Window.partitionBy(key).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1))
    offsets = cut(sums.select(key, "__pid", past.alias("__past")).where("__past is not null"))
    return t.join(F.broadcast(offsets), [key, "__pid"], "left").select(
        *names, (F.col(name) + F.coalesce("__past", F.lit(0))).alias(name))
