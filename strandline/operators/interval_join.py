"""Joins of intervals: Spark has no range join, so both sides are dealt over buckets of the axis and meet by equality.

Buckets come in levels, each STEP times as wide as the one below. An interval's own level is the first whose buckets are as wide as
the interval, so it touches two of them at most; it is also dealt over the wider levels that the other side's intervals have as
their own, which one row about each side tells. A pair meets at the wider of its two levels, in the first bucket that both
touch there: it is found once, and an interval of any length writes a few rows. No side is collected; Spark chooses how the
equality is joined.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals

LEFT, RIGHT = "_l_", "_r_"
#: A small step: an interval meets few others that its buckets, at most STEP times as wide as itself, hold but it doesn't touch.
STEP_BITS, LEVELS = 1, 22
STEP = 1 << STEP_BITS


def _level(length: Column, bucket: int) -> Column:
    """The first level with buckets of at least this length, from the bits of its number of buckets; the last one takes all beyond."""
    buckets = F.floor((length - 1) / bucket)
    return F.when(buckets == 0, 0).otherwise(F.least(F.lit(LEVELS - 1), F.floor((F.length(F.bin(buckets)) + STEP_BITS - 1) / STEP_BITS).cast("int")))


def _width(level: Column, bucket: int) -> Column:
    return F.element_at(F.array(*[F.lit(bucket * STEP**k).cast("long") for k in range(LEVELS)]), (level + 1).cast("int"))


def _bounded(df: DataFrame, start: str, end: str, margin: int) -> DataFrame:
    """Adds _a, _b: the widened interval. Empty ones meet nothing."""
    return df.withColumn("_a", F.col(start) - margin).withColumn("_b", F.col(end) + margin).filter("_a < _b")


def _share(split: int) -> Column:
    """Of an interval's length, the part that one of its buckets holds at least."""
    return F.ceil((F.col("_b") - F.col("_a")) / split)


def _own_levels(df: DataFrame, start: str, end: str, margin: int, bucket: int, split: int = 1) -> Column:
    """One row: the levels that the intervals have as their own."""
    spans = _bounded(df.select(start, end), start, end, margin)
    return spans.agg(F.collect_set(_level(_share(split), bucket))).scalar()


def _bucketed(df: DataFrame, mark: str, start: str, end: str, margin: int, bucket: int, others: Column, split: int = 1) -> DataFrame:
    """The intervals at their own level and at the wider ones in ``others``: adds _level, _bucket and the mark's own level."""
    named = _bounded(df, start, end, margin).withColumn(f"{mark}own", _level(_share(split), bucket)).withColumn("_others", others)
    wider = F.filter("_others", lambda k: k > F.col(f"{mark}own"))
    each = named.withColumn("_level", F.explode(F.concat(F.array(F.col(f"{mark}own")), wider))).drop("_others")
    width = _width(F.col("_level"), bucket)
    each = each.withColumn(f"{mark}first", F.floor(F.col("_a") / width).cast("long"))
    return each.withColumn("_bucket", F.explode(F.sequence(F.col(f"{mark}first"), F.floor((F.col("_b") - 1) / width).cast("long")))).drop("_a", "_b")


def interval_join(left: DataFrame, right: DataFrame, by: Sequence[str] = ("chrom",), bucket: int = 1000, margin: int = 0) -> DataFrame:
    """All pairs of rows that agree in ``by`` and overlap, the left one widened by ``margin`` on both sides.

    Columns: ``by``, then the left ones and the right ones; apart from ``by``, no name may be on both sides but start and end,
    which come as start, end and right_start, right_end.
    """
    right = right.withColumnsRenamed({"start": "right_start", "end": "right_end"})
    a = _bucketed(left, LEFT, "start", "end", margin, bucket, _own_levels(right, "right_start", "right_end", 0, bucket))
    b = _bucketed(right, RIGHT, "right_start", "right_end", 0, bucket, _own_levels(left, "start", "end", margin, bucket))
    met = a.join(b, [*by, "_level", "_bucket"])
    meet = intervals.overlaps(F.col("start") - margin, F.col("end") + margin, F.col("right_start"), F.col("right_end"))
    widest = F.col("_level") == F.greatest(f"{LEFT}own", f"{RIGHT}own")
    met = met.filter(meet & widest & (F.col("_bucket") == F.greatest(f"{LEFT}first", f"{RIGHT}first")))
    return met.drop("_level", "_bucket", *[f"{m}{c}" for m in (LEFT, RIGHT) for c in ("own", "first")])


def flat_join(left: DataFrame, right: DataFrame, by: Sequence[str] = ("chrom",), bucket: int = 1000, margin: int = 0) -> DataFrame:
    """As ``interval_join``, for short left intervals and right ones that cover few buckets for each left row: there is one level.

    A left row is written once for each bucket that it touches, mostly once, and isn't widened; the right ones are, and are written to all their buckets.
    """
    right = right.withColumnsRenamed({"start": "right_start", "end": "right_end"})
    last = lambda end: F.floor((end - 1) / bucket).cast("long")
    a = left.filter(F.col("start") - margin < F.col("end") + margin).withColumn(f"{LEFT}first", F.floor(F.col("start") / bucket).cast("long"))
    a = a.withColumn("_bucket", F.explode(F.sequence(F.col(f"{LEFT}first"), last(F.greatest(F.col("end"), F.col("start") + 1)))))
    b = right.filter("right_start < right_end").withColumn(f"{RIGHT}first", F.floor((F.col("right_start") - margin) / bucket).cast("long"))
    b = b.withColumn("_bucket", F.explode(F.sequence(F.col(f"{RIGHT}first"), last(F.col("right_end") + margin))))
    meet = intervals.overlaps(F.col("start") - margin, F.col("end") + margin, F.col("right_start"), F.col("right_end"))
    met = a.drop(f"{LEFT}first").join(b, [*by, "_bucket"]).filter(meet & (F.col("_bucket") == F.greatest(F.floor(F.col("start") / bucket), f"{RIGHT}first")))
    return met.drop("_bucket", f"{RIGHT}first")


def _touching(left: DataFrame, right: DataFrame, by: Sequence[str], bucket: int, margin: int, key: Sequence[str]) -> DataFrame:
    spans = right.select(*by, "start", "end").distinct()
    return interval_join(left.select(*by, "start", "end", *[k for k in key if k not in (*by, "start", "end")]), spans, by, bucket, margin).select(*key).distinct()


def interval_semi(left: DataFrame, right: DataFrame, key: Sequence[str], by: Sequence[str] = ("chrom",), bucket: int = 1000, margin: int = 0) -> DataFrame:
    """The left rows, identified by ``key``, that overlap any right one."""
    return left.join(_touching(left, right, by, bucket, margin, key), list(key), "left_semi")


def interval_anti(left: DataFrame, right: DataFrame, key: Sequence[str], by: Sequence[str] = ("chrom",), bucket: int = 1000, margin: int = 0) -> DataFrame:
    """The left rows, identified by ``key``, that overlap no right one."""
    return left.join(_touching(left, right, by, bucket, margin, key), list(key), "left_anti")


def point_join(points: DataFrame, right: DataFrame, pos: str = "pos", by: Sequence[str] = ("chrom",), bucket: int = 1000, split: int = 1, tasks: int | None = None) -> DataFrame:
    """All pairs of a point and an interval that holds it. A point is in one bucket of each level, so no pair is met twice.

    For intervals with far more pairs than rows: with a larger ``split`` an interval is written to about so many narrower buckets and meets few
    points that it doesn't hold, and ``tasks`` deals the buckets over so many tasks at least, however few bytes the rows have.
    """
    levels = _own_levels(right, "start", "end", 0, bucket, split)
    a = points.withColumn("_level", F.explode(levels)).withColumn("_bucket", F.floor(F.col(pos) / _width(F.col("_level"), bucket)).cast("long"))
    b = _bucketed(right, RIGHT, "start", "end", 0, bucket, F.array().cast("array<int>"), split).drop(f"{RIGHT}first", f"{RIGHT}own")
    if tasks is not None:  # a number that is asked for isn't coalesced; a broadcast would leave the pairs to the few tasks that read the points
        a, b = [side.repartition(tasks, *by, "_level", "_bucket") for side in (a, b)]
        b = b.hint("merge")
    return a.join(b, [*by, "_level", "_bucket"]).filter(intervals.contains(F.col("start"), F.col("end"), F.col(pos))).drop("_level", "_bucket")


def tile_join(points: DataFrame, tiles: DataFrame, pos: str = "pos", by: Sequence[str] = ("chrom",), bucket: int = 1000) -> DataFrame:
    """As ``point_join``, for intervals that don't overlap each other: a point is written once, an interval once for each bucket that it touches.

    Disjoint intervals write as many rows as there are of them and buckets in all that they cover.
    """
    a = points.withColumn("_bucket", F.floor(F.col(pos) / bucket).cast("long"))
    touched = F.sequence(F.floor(F.col("start") / bucket).cast("long"), F.floor((F.col("end") - 1) / bucket).cast("long"))
    b = tiles.filter("start < end").withColumn("_bucket", F.explode(touched))
    return a.join(b, [*by, "_bucket"]).filter(intervals.contains(F.col("start"), F.col("end"), F.col(pos))).drop("_bucket")


def reciprocal_join(left: DataFrame, right: DataFrame, least: float, by: Sequence[str] = ("chrom",), most_shift: int | None = None) -> DataFrame:
    """All pairs that agree in ``by`` and whose reciprocal overlap is ``least`` (above 0) or more; columns as in ``interval_join``.

    Such lengths differ by less than a factor and such starts by a share of the length, so both sides are dealt over classes of lengths and
    buckets of starts: long intervals that merely overlap never meet. ``most_shift``: starts further apart than this need no pair either.
    The left row is in one place, so a pair meets once. The right one is in nine, which Spark's guess at its size doesn't know: it isn't broadcast.
    """
    right = right.withColumnsRenamed({"start": "right_start", "end": "right_end"})
    factor = 1.001 / least  # a little more than what lengths can differ by, for rounding

    def wide(level: Column) -> Column:
        reach = F.floor(F.pow(F.lit(factor), level + 2) * (1 - least)).cast("long") + 1
        return reach if most_shift is None else F.least(reach, F.lit(most_shift + 1).cast("long"))

    level = lambda start, end: F.floor(F.log(F.greatest(F.col(end) - F.col(start), F.lit(intervals.LEAST_SPAN)).cast("double")) / math.log(factor)).cast("int")
    a = left.filter("start < end").withColumn("_level", level("start", "end")).withColumn("_bucket", F.floor(F.col("start") / wide(F.col("_level"))).cast("long"))
    own = level("right_start", "right_end")
    b = right.filter("right_start < right_end").withColumn("_level", F.explode(F.array(own - 1, own, own + 1)))
    at = F.floor(F.col("right_start") / wide(F.col("_level"))).cast("long")
    b = b.withColumn("_bucket", F.explode(F.array(at - 1, at, at + 1)))
    good = intervals.reciprocal_overlap(F.col("start"), F.col("end"), F.col("right_start"), F.col("right_end")) >= least
    return a.join(b.hint("merge"), [*by, "_level", "_bucket"]).filter(good).drop("_level", "_bucket")


DEFAULT_COPIES, HIGH = 2, 5


def majority_value(targets: DataFrame, regions: DataFrame, key: str, value: str = "value", bucket: int = 1000) -> DataFrame:
    """For each target, the value with the greatest total length of the regions it touches (not clipped to the target).

    Values above HIGH count as HIGH; the smaller value wins a tie; a target that touches nothing has DEFAULT_COPIES.
    """
    met = interval_join(targets.select("chrom", "start", "end", key), regions.select("chrom", "start", "end", F.least(F.col(value), F.lit(HIGH)).alias(value)), bucket=bucket)
    spans = met.groupBy(key, value).agg(F.sum(F.col("right_end") - F.col("right_start")).alias("_span"))
    best = spans.groupBy(key).agg(F.max(F.struct("_span", (-F.col(value)).alias("_minus"))).alias("_best"))
    return targets.select(key).join(best, key, "left").select(key, F.coalesce(-F.col("_best._minus"), F.lit(DEFAULT_COPIES)).cast("long").alias(value))


def unanimous_value(targets: DataFrame, regions: DataFrame, group: str, key: str, value: str = "value", bucket: int = 1000) -> DataFrame:
    """For each group of targets, the value of all regions they touch if there is one only and each target touches some."""
    met = interval_join(targets.select("chrom", "start", "end", group, key), regions.select("chrom", "start", "end", value), bucket=bucket)
    each = met.groupBy(group, key).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    all_of = targets.select(group, key).join(each, [group, key], "left").groupBy(group)
    agreed = all_of.agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.bool_and(F.col("_low").isNotNull()).alias("_all"))
    same = F.col("_all") & (F.col("_low") == F.col("_high"))
    return agreed.select(group, F.when(same, F.col("_low")).otherwise(F.lit(DEFAULT_COPIES)).cast("long").alias(value))
