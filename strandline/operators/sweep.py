"""Sweeps along an axis: running totals, depth, runs, sliding sums, unions and complements of regions.

Long axes are cut into blocks: totals of blocks give each block's start, so that no task sorts a whole axis.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import settle, stored

BLOCK = 1_000_000


def running_total(df: DataFrame, keys: Sequence[str], pos: str, value: str, before: str, block: int = BLOCK) -> DataFrame:
    """``before``: the total of ``value`` at smaller positions of the same keys; positions are unique within keys."""
    df = df.withColumn("_block", F.floor(F.col(pos) / block).cast("long"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*keys, "_block").agg(F.sum(value).alias("_sum"))
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*keys, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(blocks, [*keys, "_block"])
    return joined.withColumn(before, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_block", "_base")


def running_max(df: DataFrame, keys: Sequence[str], pos: str, value: str, before: str, block: int = BLOCK // 1000) -> DataFrame:
    """``before``: the greatest ``value`` of the rows before a row in order of (pos, value) within the same keys; null for the first one."""
    df = df.withColumn("_block", F.floor(F.col(pos) / block).cast("long"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*keys, "_block").agg(F.max(value).alias("_top"))
    blocks = blocks.withColumn("_base", F.max("_top").over(earlier)).drop("_top")
    inside = Window.partitionBy(*keys, "_block").orderBy(pos, value).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(blocks, [*keys, "_block"])
    return joined.withColumn(before, F.greatest("_base", F.max(value).over(inside))).drop("_block", "_base")


def edges(segments: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """+1 at each start and -1 at each end, summed by position: (keys, pos, delta)."""
    both = F.explode(F.array(F.struct(F.col("start").alias("pos"), F.lit(1).alias("delta")), F.struct(F.col("end").alias("pos"), F.lit(-1).alias("delta"))))
    return segments.select(*keys, both.alias("_e")).groupBy(*keys, F.col("_e.pos").alias("pos")).agg(F.sum("_e.delta").cast("long").alias("delta"))


def depth_bins(segments: DataFrame, size: int, keys: Sequence[str] = ("chrom",), lengths: DataFrame | None = None) -> DataFrame:
    """Covered bases per bin: (keys, bin, bases); the mean depth is bases / size. Bins that nothing covers are not there.

    With ``lengths`` (chrom, length), the partial last bin of each is dropped.
    """
    first, last = F.floor(F.col("start") / size).cast("long"), F.floor((F.col("end") - 1) / size).cast("long")
    each = segments.filter("start < end").select(*keys, "start", "end", F.explode(F.sequence(first, last)).alias("bin"))
    covered = F.least("end", (F.col("bin") + 1) * size) - F.greatest("start", F.col("bin") * size)
    bins = each.groupBy(*keys, "bin").agg(F.sum(covered).cast("long").alias("bases"))
    if lengths is not None:
        bins = bins.join(lengths.select("chrom", F.floor(F.col("length") / size).cast("long").alias("_n")), "chrom").filter("bin < _n").drop("_n")
    return bins


def runs_between(flips: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """From rows (keys, pos, opens) that open and close in turn: (keys, start, end).

    The number of openings before a row pairs it with its partner; it comes from blocks, so a key's rows needn't meet in one task.
    """
    counted = running_total(flips.withColumn("_opens", F.col("opens").cast("int")), keys, "pos", "_opens", "_before", block)
    numbered = counted.withColumn("_n", F.col("_before") - F.when(F.col("opens"), 0).otherwise(1))
    runs = numbered.groupBy(*keys, "_n").agg(F.min(F.when(F.col("opens"), F.col("pos"))).alias("start"), F.min(F.when(~F.col("opens"), F.col("pos"))).alias("end"))
    return runs.drop("_n")


def regions_where(changes: DataFrame, holds, keys: Sequence[str] = ("chrom",), block: int = BLOCK) -> DataFrame:
    """Maximal regions in which ``holds(depth)`` is true; changes: (keys, pos, delta), one row a position; it must not hold at 0.

    The depth before and after a position tells whether a region opens or closes there, so no row looks at its neighbour. The
    changes, and then the flips, are read twice (for blocks and within them): both narrow tables are kept.
    """
    level = running_total(stored(changes), keys, "pos", "delta", "_before", block)
    was, now = holds(F.col("_before")), holds(F.col("_before") + F.col("delta"))
    return runs_between(settle(level.filter(was != now).select(*keys, "pos", now.alias("opens"))), keys, block)


def regions_over(segments: DataFrame, most: int, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Regions whose depth is above ``most``."""
    return regions_where(edges(segments, keys), lambda depth: depth > most, keys)


def union(regions: DataFrame, gap: int = 0, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Regions that overlap, touch or lie within ``gap`` of each other, merged."""
    wide = regions.filter("start < end").select(*keys, "start", (F.col("end") + gap).alias("end"))
    return regions_where(edges(wide, keys), lambda depth: depth > 0, keys).withColumn("end", F.col("end") - gap)


def subtract(regions: DataFrame, holes: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """What the union of ``regions`` covers and ``holes`` don't."""
    weigh = lambda df, w: edges(union(df, 0, keys), keys).withColumn("delta", F.col("delta") * w)
    both = weigh(regions, 1).unionByName(weigh(holes, 2)).groupBy(*keys, "pos").agg(F.sum("delta").alias("delta"))
    return regions_where(both.filter("delta <> 0"), lambda depth: depth == 1, keys)


def filled_union(regions: DataFrame, gap: int, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """The merged regions and, labelled, the gaps between them that merging within ``gap`` fills."""
    plain = settle(union(regions, 0, keys))
    return plain.withColumn("label", F.lit("region")).unionByName(subtract(union(regions, gap, keys), plain, keys).withColumn("label", F.lit("excluded_gap_fill")))


def common_regions(regions: DataFrame, least: int, gap: int = 0, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Where at least ``least`` regions lie, merged within ``gap``."""
    return union(regions_where(edges(regions, keys), lambda depth: depth >= least, keys), gap, keys)


def islands(df: DataFrame, index: str, holds: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Maximal runs of consecutive ``index`` where ``holds``: (keys, start, end). For dense indices of any length."""
    some = df.filter(holds).select(*keys, F.col(index).alias("start"), (F.col(index) + 1).alias("end"))
    return union(some, 0, keys or ())


def run_lengths(df: DataFrame, keys: Sequence[str], index: str, state: str) -> DataFrame:
    """Neighbouring equal states as one row: (keys, begin, end, state), end exclusive. Indices are dense within keys.

    One path (a key) is one window: the paths of a segmentation, bounded by the axis.
    """
    order = Window.partitionBy(*keys).orderBy(index)
    group = F.sum(F.when(F.lag(state).over(order).eqNullSafe(F.col(state)), 0).otherwise(1)).over(order)
    return df.withColumn("_run", group).groupBy(*keys, "_run").agg(F.min(index).alias("begin"), (F.max(index) + 1).alias("end"), F.first(state).alias(state)).drop("_run")


def sliding_sum(df: DataFrame, width: int, pos: str = "pos", value: str = "count", keys: Sequence[str] = ("chrom",), block: int = BLOCK) -> DataFrame:
    """The sum of ``value`` over positions in (pos - width, pos]. Each row is also lent to the next block where it may be needed."""
    here = F.floor(F.col(pos) / block).cast("long")
    last = F.floor((F.col(pos) + width - 1) / block).cast("long")
    each = df.withColumn("_own", here).withColumn("_block", F.explode(F.sequence(here, last)))
    window = Window.partitionBy(*keys, "_block").orderBy(pos).rangeBetween(-(width - 1), 0)
    return each.withColumn("window_sum", F.sum(value).over(window)).filter("_own = _block").drop("_own", "_block")


def sessions(df: DataFrame, keys: Sequence[str], pos: str, gap: int) -> DataFrame:
    """Numbers clusters of positions, a new one where the step from the last position is above ``gap``: adds ``cluster`` (its first position)."""
    points = df.select(*keys, F.col(pos).alias("start"), (F.col(pos) + 1).alias("end")).distinct()
    spans = union(points, gap - 1, keys).select(*keys, F.col("start").alias("cluster"), F.col("end").alias("_last"))
    from .interval_join import tile_join

    found = tile_join(df, spans.select(*keys, F.col("cluster").alias("start"), F.col("_last").alias("end")), pos, tuple(keys), bucket=max(1000, 10 * gap))
    return found.withColumnRenamed("start", "cluster").drop("end")


def last_values(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int) -> DataFrame:
    """Adds ``history``: the last ``n`` values up to each row."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("history", F.collect_list(value).over(window))


def scoring_depth_limit(haploid: DataFrame, factor: float = 12.0, most: int = 1000) -> DataFrame:
    """haploid (sample, haploid): the depth above which variants aren't scored: (sample, max_depth)."""
    return haploid.select("sample", F.least(F.floor(F.col("haploid") * factor), F.lit(most)).cast("long").alias("max_depth"))


def over_limit(svs: DataFrame, over: DataFrame, margin: int = 50, key: str = "sv") -> DataFrame:
    """svs (sample, chrom, start, end, key) that come within ``margin`` of their sample's regions of too much depth."""
    from .interval_join import interval_semi

    return interval_semi(svs, over, ["sample", key], by=("sample", "chrom"), margin=margin)


def select_chroms(df: DataFrame, pattern: str = r"^(chr)?\d{1,2}$", column: str = "chrom") -> DataFrame:
    """Rows of the chromosomes that match."""
    return df.filter(F.col(column).cast("string").rlike(pattern))
