"""Positions in a total order, without a sort of all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.storage import keep

SPAN = 100_000


def number_rows(df: DataFrame, by: list[str | Column], name: str) -> DataFrame:
    """df with `name`, each row's place from 0 in the order of `by`, which must have no ties.

    Rows are range-partitioned and sorted by task; the tasks' counts, one row a task, give each task's first place.
    The sorted rows are written to the shared folder, so that both reads see the same.
    """
    at, task, n, first, before = (_free(df, name, x) for x in ("at", "task", "n", "first", "before"))
    ranged = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id())
    rows = keep(ranged.select("*", F.shiftright(at, 33).alias(task)), "ordered")
    counts = rows.groupBy(task).agg(F.count(F.lit(1)).alias(n), F.min(at).alias(first))
    # One row a task.
    sums = F.coalesce(F.sum(n).over(Window.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select(task, first, sums.alias(before))
    return rows.join(F.broadcast(bases), task).withColumn(name, F.col(before) + F.col(at) - F.col(first)).drop(task, at, first, before)


def with_previous(df: DataFrame, place: str, value: str, name: str) -> DataFrame:
    """df with `name`, the value of the row whose place is one less; null for the first.

    Rows fall into spans of SPAN places; a span's last row is also sent to the next span, so a window never holds
    more than SPAN + 1 rows.
    """
    held = _free(df, name, "span")
    span = F.floor(F.col(place) / SPAN)
    last = (F.col(place) + 1) % SPAN == 0
    both = df.withColumn(held, F.explode(F.when(last, F.array(span, span + 1)).otherwise(F.array(span))))
    before = F.lag(value).over(Window.partitionBy(held).orderBy(place))
    return both.withColumn(name, before).where(F.col(held) == span).drop(held)


def _free(df: DataFrame, given: str, name: str) -> str:
    """A column name that neither df nor its caller has."""
    taken = {c.lower() for c in [*df.columns, given]}
    while name.lower() in taken:
        name += "_"
    return name
