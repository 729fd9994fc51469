"""Tables of intervals clustered by the bins of a hierarchy, so that the rows of some regions are read without the others.

A folder holds one slot: chromosomes of one of HASHES kinds, and either one of the widest bins or (0) what no such bin holds. So there are few
folders, however many chromosomes there are, and other ones aren't opened. Within a slot, files are sorted by chromosome and bin, and the
bins of a region, a few ranges, reach the Parquet scan as filters on row groups and pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cigar
from ..operators.interval_join import interval_semi

HASHES, PARTS, MOST_REGIONS = 64, 1 << 16, 200
#: A bin's width as a shift, and the first bin of that width (fixed values of the binning scheme).
WIDTHS = ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681))
WIDEST = WIDTHS[0][0]


def _slot(chrom: Column, part: Column) -> Column:
    return (F.crc32(chrom.cast("string").cast("binary")) % HASHES * PARTS + part).cast("int")


def write_indexed(df: DataFrame, path: str, overwrite: bool = False, row_group: int = 16 << 20) -> None:
    """df (chrom, start, end and others) as a clustered table; its columns must not be named bin or slot.

    All rows are written: those with a null place, too, though no region has them. ``row_group`` is the size in bytes of what is read or passed
    over as a whole. A slot of many rows is written by many tasks.
    """
    if {"bin", "slot"} & set(df.columns):
        raise ValueError("columns named bin and slot are the index's own")
    first, last = F.shiftright("start", WIDEST), F.shiftright(F.col("end") - 1, WIDEST)
    part = F.when(F.col("start").isNotNull() & F.col("end").isNotNull(), F.when(first == last, first + 1).otherwise(0))
    keyed = df.withColumns({"bin": cigar.sam_bin(F.col("start"), F.col("end")).cast("int"), "slot": _slot(F.col("chrom"), part)})
    order = ["slot", "chrom", "bin", "start", "end"]
    rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("overwrite" if overwrite else "errorifexists").option("parquet.block.size", row_group).partitionBy("slot").parquet(path)


def _bins(start: int, end: int) -> Column:
    """Whether a row's bin is one that a region touches."""
    ranges = [F.col("bin").between(first + (start >> shift), first + ((end - 1) >> shift)) for shift, first in WIDTHS]
    return reduce(or_, ranges, F.col("bin") == 0)


def read_regions(spark: SparkSession, path: str, regions: Sequence[tuple[object, int, int]]) -> DataFrame:
    """The rows of a clustered table that overlap any of a few regions (chrom, start, end), each row once. Empty intervals overlap nothing."""
    if len(regions) > MOST_REGIONS:
        raise ValueError(f"more than {MOST_REGIONS} regions: give a DataFrame to reads_of_regions")
    slots = {zlib.crc32(str(c).encode()) % HASHES * PARTS + part for c, s, e in regions for part in (0, *range((s >> WIDEST) + 1, ((e - 1) >> WIDEST) + 2))}
    touched = [(F.col("chrom") == c) & _bins(s, e) & (F.col("end") > s) & (F.col("start") < e) for c, s, e in regions if s < e]
    wanted = F.col("slot").isin(sorted(slots)) & (F.col("end") > F.col("start")) & reduce(or_, touched, F.lit(False))
    return spark.read.parquet(path).filter(wanted).drop("bin", "slot")


def reads_of_regions(spark: SparkSession, path: str, regions: DataFrame, key: Sequence[str]) -> DataFrame:
    """The rows of a clustered table, identified by ``key``, that overlap any of many regions (chrom, start, end).

    Only the slots of the regions are opened: their numbers, bounded by the scheme and not by the regions, are gathered first.
    """
    parts = F.concat(F.array(F.lit(0)), F.sequence((F.shiftright("start", WIDEST) + 1).cast("int"), (F.shiftright(F.col("end") - 1, WIDEST) + 1).cast("int")))
    slots = regions.filter("start < end").select("chrom", F.explode(parts).alias("part")).select(_slot(F.col("chrom"), F.col("part")).alias("slot")).distinct()
    rows = spark.read.parquet(path).filter(F.col("slot").isin([r["slot"] for r in slots.collect()])).drop("bin", "slot")
    return interval_semi(rows, regions, key)
