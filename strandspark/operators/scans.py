"""Running sums and row numbers over long orders, without one task that sees all rows.

A running value is taken inside chunks of an order and, over the chunks' totals, before
them; only the totals (one row a chunk) meet in one place. Numbers of a global order
come from range partitions: each row's place in its partition, plus the rows of the
partitions before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandspark.runtime import written

CHUNK = 1 << 16
#: Bits of the row number inside a partition (see ``monotonically_increasing_id``).
_PLACE = 33


def running(df: DataFrame, by: list[str], at: str, value: str, how: str = "sum", name: str | None = None, backwards: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Add ``name`` (default: ``value`` itself): the sum, max or min of ``value`` over the rows of
    one ``by`` up to this one in the order of the whole number ``at`` (from it on, if
    ``backwards``). ``df`` is read twice: a written table. Rows of one ``by`` have different ``at``.
    """
    f = {"sum": F.sum, "max": F.max, "min": F.min}[how]
    name = name or value
    order = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c).asc())
    own = df.withColumn("_chunk", F.floor(F.col(at) / chunk))
    inside = f(value).over(Window.partitionBy(*by, "_chunk").orderBy(order(at)).rowsBetween(Window.unboundedPreceding, 0))
    totals = own.groupBy(*by, "_chunk").agg(f(value).alias("_total"))
    before = f("_total").over(Window.partitionBy(*by).orderBy(order("_chunk")).rowsBetween(Window.unboundedPreceding, -1))
    both = own.withColumn("_inside", inside).join(totals.select(*by, "_chunk", before.alias("_before")), [*by, "_chunk"])
    if how == "sum":
        out = F.coalesce("_inside", F.lit(0)) + F.coalesce("_before", F.lit(0))
    else:
        out = (F.greatest if how == "max" else F.least)("_inside", "_before")  # both skip nulls
    return both.withColumn(name, out).drop("_chunk", "_inside", "_before")


def numbered(df: DataFrame, name: str, *by: str, start: int = 0) -> DataFrame:
    """Number the rows in the order of ``by``; rows that are equal there come in any order.

    Rows are dealt by ranges of ``by`` and sorted in each; one row per range is what meets in
    one place. Ranges are found by reading the rows, so these are written before.
    """
    dealt = written(df, "unnumbered").repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_n", F.monotonically_increasing_id())
    dealt = written(dealt, "numbered").withColumn("_part", F.shiftright("_n", _PLACE))
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("_part", before.alias("_before")))  # one row per range partition
    place = F.col("_n").bitwiseAND((1 << _PLACE) - 1)
    return dealt.join(offsets, "_part").withColumn(name, F.col("_before") + place + start).drop("_n", "_part", "_before")
