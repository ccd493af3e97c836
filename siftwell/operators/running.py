"""Running sums over all rows in an order, without bringing them to one task.

Rows are dealt to ranges of the order (ties apart by an extra number, so that equal rows don't meet in one range), each range sums on its
own, and the ranges' totals - as many numbers as there are partitions - become the offsets of the ranges after them.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.sources.staged import stage


def running_sums(rows: DataFrame, order: Sequence[Column], value: Column | None = None, name: str = "running", total: str | None = None) -> DataFrame:
    """``rows`` with ``name``, the sum of ``value`` (not negative; one if not given, so that rows are numbered from 1) over each row and those before it, and
    the sum of all as ``total``. Rows that are equal in ``order`` come in any order, but each has its own place. An empty table stays empty."""
    taken = {c.lower() for c in rows.columns}
    new = iter(f"_{i}_{name}" for i in range(1000) if f"_{i}_{name}".lower() not in taken)
    keys, tie, own, part = [next(new) for _ in order], next(new), next(new), next(new)
    keyed = rows.select("*", *(c.alias(k) for c, k in zip(order, keys, strict=True)), (F.lit(1) if value is None else value).cast("long").alias(own), F.monotonically_increasing_id().alias(tie))
    keyed = stage(keyed, "numbers")  # dealing by ranges looks at the rows twice, and what makes them may be long
    # a column may be wanted in descending order: the sort keeps the expressions' own directions
    directions = [_directed(c, k) for c, k in zip(order, keys, strict=True)]
    dealt = keyed.repartitionByRange(*directions, F.col(tie)).withColumn(part, F.spark_partition_id())
    dealt = stage(dealt, "ranges")
    sums = sorted((r[0], r[1]) for r in dealt.groupBy(part).agg(F.sum(own)).collect())  # a number for each partition
    offsets = list(zip([p for p, _ in sums], accumulate([0, *(s for _, s in sums)]), strict=False))
    within = Window.partitionBy(part).orderBy(*directions, tie).rowsBetween(Window.unboundedPreceding, 0)
    before = F.broadcast(dealt.sparkSession.createDataFrame(offsets, f"{part} int, _before long"))
    found = dealt.withColumn(name, F.sum(own).over(within)).join(before, part).withColumn(name, F.col(name) + F.col("_before"))
    if total:
        found = found.withColumn(total, F.lit(sum(s for _, s in sums)))
    return found.select(*rows.columns, name, *([total] if total else []))


class Descending:
    """A column of an order, largest first."""

    def __init__(self, column: Column):
        self.column = column

    def alias(self, name: str) -> Column:
        return self.column.alias(name)


def _directed(column: Column | Descending, name: str) -> Column:
    return F.col(name).desc_nulls_last() if isinstance(column, Descending) else F.col(name).asc_nulls_first()
