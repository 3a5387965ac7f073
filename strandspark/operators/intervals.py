"""Interval joins on bins: equi-joins on (contig, bin) with a residual condition.

A pure range condition plans as a nested loop. :func:`overlaps` spreads each interval over
the bins it touches, for intervals not much longer than a bin. :func:`nested_overlaps` has
levels of bins, each ``FAN`` times as wide as the one below: an interval stands in the
one or two bins that it touches at the first level whose bins are as long as it is,
and asks those of the levels above for longer ones, so its rows don't grow with its
length. In both a pair is emitted only in the bin of the later start, so none comes
twice. :func:`point_sums` needs no pairs for what lies in whole bins. Intervals are half-open.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BIN = 10_000
#: Bins of a level that one of the next level covers; levels of nested bins.
FAN, LEVELS = 8, 9


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    last = F.greatest(F.floor((F.col(end) - 1) / width), F.floor(F.col(start) / width))
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), last)))


def overlaps(left: DataFrame, right: DataFrame, on: list[str], start: str, end: str, other_start: str, other_end: str, width: int = BIN, condition: Column | None = None, tasks: int | None = None) -> DataFrame:
    """Inner join of the pairs that share ``on`` and overlap; empty intervals overlap nothing. With
    ``tasks`` rows are dealt over so many by ``on`` and the bin, which stays as ``_bin``: what is
    grouped by these and more is not dealt again."""
    a = _binned(left.where(F.col(end) > F.col(start)), start, end, width)
    b = _binned(right.where(F.col(other_end) > F.col(other_start)), other_start, other_end, width)
    if tasks:
        a, b = a.repartition(tasks, *on, "_bin"), b.repartition(tasks, *on, "_bin").hint("shuffle_hash")
    pairs = a.join(b, [*on, "_bin"]).where((F.col(start) < F.col(other_end)) & (F.col(other_start) < F.col(end)))
    pairs = pairs.where(F.col("_bin") == F.floor(F.greatest(F.col(start), F.col(other_start)) / width))
    pairs = pairs if tasks else pairs.drop("_bin")
    return pairs if condition is None else pairs.where(condition)


def _level(start: str, end: str, width: int) -> Column:
    """The first level whose bins are as long as the interval."""
    out, length = F.lit(LEVELS - 1), F.col(end) - F.col(start)
    for k in reversed(range(LEVELS - 1)):
        out = F.when(length <= width * FAN**k, k).otherwise(out)
    return out


def _bin_width(level: Column, width: int) -> Column:
    return F.element_at(F.array(*[F.lit(width * FAN**k).cast("long") for k in range(LEVELS)]), level + 1)


def _in_bins(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Add ``_bin``: the bins that a row touches at its ``_at`` level."""
    w = _bin_width(F.col("_at"), width)
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / w), F.floor((F.col(end) - 1) / w))))


def nested_overlaps(left: DataFrame, right: DataFrame, on: list[str], start: str, end: str, other_start: str, other_end: str, width: int = BIN) -> DataFrame:
    """As :func:`overlaps`, for intervals of any length: longer or equal ones of the left with
    those of the right, and the other way round."""
    a = left.where(F.col(end) > F.col(start)).withColumn("_level", _level(start, end, width))
    b = right.where(F.col(other_end) > F.col(other_start)).withColumn("_other", _level(other_start, other_end, width))
    up = lambda df, level, first: df.withColumn("_at", F.explode(F.sequence(F.col(level) + first, F.lit(LEVELS - 1))))
    longer = _in_bins(a.withColumn("_at", F.col("_level")), start, end, width).join(_in_bins(up(b, "_other", 0), other_start, other_end, width), [*on, "_at", "_bin"])
    shorter = _in_bins(up(a.where(F.col("_level") < LEVELS - 1), "_level", 1), start, end, width).join(_in_bins(b.withColumn("_at", F.col("_other")), other_start, other_end, width), [*on, "_at", "_bin"])
    pairs = longer.unionByName(shorter.select(*longer.columns)).where((F.col(start) < F.col(other_end)) & (F.col(other_start) < F.col(end)))
    return pairs.where(F.col("_bin") == F.floor(F.greatest(F.col(start), F.col(other_start)) / _bin_width(F.col("_at"), width))).drop("_at", "_bin", "_level", "_other")


def point_sums(spans: DataFrame, points: DataFrame, key: list[str], on: list[str], start: str, end: str, spot: str, sums: dict[str, Column], width: int) -> DataFrame:
    """(key, sums) of the spans that hold points: sums over the points in [start, end).

    Points are summed per bin at every level. A span takes whole bins of ever wider
    levels from its middle, at most ``2 (FAN - 1)`` of each, and meets single points in its first
    and last bin only. ``key`` names a span and contains ``on``.
    """
    names = list(sums)
    p = points.select(*on, F.col(spot).cast("long").alias("_spot"), *[c.alias(n) for n, c in sums.items()])
    whole = p.groupBy(*on, F.floor(F.col("_spot") / width).alias("_bin")).agg(*[F.sum(n).alias(n) for n in names]).withColumn("_at", F.lit(0))
    levels = whole.select(*on, "_bin", *names, F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1))).alias("_at"))
    levels = levels.withColumn("_bin", F.floor(F.col("_bin") / _bin_width(F.col("_at"), 1))).groupBy(*on, "_at", "_bin").agg(*[F.sum(n).alias(n) for n in names])
    s = spans.select(*key, F.col(start).cast("long").alias("_from"), F.col(end).cast("long").alias("_to")).where("_to > _from")
    first, last = F.ceil(F.col("_from") / width), F.floor(F.col("_to") / width)
    s = s.withColumns({"_first": first, "_last": last})
    taken = []
    for k in range(LEVELS):  # the bins of level k outside whole bins of level k + 1
        low = [F.ceil(F.col("_first") / FAN**j) for j in (k, k + 1)]
        high = [F.floor(F.col("_last") / FAN**j) for j in (k, k + 1)]
        wider = low[1] < high[1] if k + 1 < LEVELS else F.lit(False)
        bins = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
        own = F.when(wider, F.concat(bins(low[0], low[1] * FAN), bins(high[1] * FAN, high[0]))).otherwise(bins(low[0], high[0]))
        taken.append(F.arrays_zip(F.array_repeat(F.lit(k), F.size(own)).alias("_at"), own.alias("_bin")))
    inside = s.select(*key, F.explode(F.concat(*taken)).alias("_b")).select(*key, "_b._at", "_b._bin").join(levels, [*on, "_at", "_bin"]).select(*key, *names)
    # up to the first whole bin and from the last one on; a span without whole bins has all its points here
    edges = F.when(F.col("_first") <= F.col("_last"), F.array(F.struct(F.col("_from").alias("a"), (F.col("_first") * width).alias("b")), F.struct((F.col("_last") * width).alias("a"), F.col("_to").alias("b")))).otherwise(F.array(F.struct(F.col("_from").alias("a"), F.col("_to").alias("b"))))
    parts = s.select(*key, F.explode(edges).alias("_e")).select(*key, "_e.a", "_e.b").where("a < b").withColumn("_bin", F.explode(F.sequence(F.floor(F.col("a") / width), F.floor((F.col("b") - 1) / width))))
    near = parts.join(p.withColumn("_bin", F.floor(F.col("_spot") / width)), [*on, "_bin"]).where("_spot >= a and _spot < b").select(*key, *names)
    return inside.unionByName(near).groupBy(*key).agg(*[F.sum(n).alias(n) for n in names])


def _hits(left: DataFrame, right: DataFrame, key: list[str], on: list[str], start: str, end: str, other_start: str, other_end: str, width: int) -> DataFrame:
    cut = right.select(*on, F.col(other_start).alias("_s"), F.col(other_end).alias("_e"))
    return nested_overlaps(left.select(*dict.fromkeys([*on, *key, start, end])), cut, on, start, end, "_s", "_e", width).select(*key).distinct()


def overlapping(left: DataFrame, right: DataFrame, key: list[str], on: list[str], start: str, end: str, other_start: str, other_end: str, width: int = BIN) -> DataFrame:
    """Rows of ``left`` (unique by ``key``) that overlap some row of ``right``."""
    return left.join(_hits(left, right, key, on, start, end, other_start, other_end, width), key, "left_semi")


def not_overlapping(left: DataFrame, right: DataFrame, key: list[str], on: list[str], start: str, end: str, other_start: str, other_end: str, width: int = BIN) -> DataFrame:
    return left.join(_hits(left, right, key, on, start, end, other_start, other_end, width), key, "left_anti")
