"""Column expressions over half-open integer intervals [start, end)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spans shorter than this count as this long in reciprocal overlaps.
LEAST_SPAN = 100


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start < b_end) & (b_start < a_end)


def contains(start: Column, end: Column, pos: Column) -> Column:
    return (start <= pos) & (pos < end)


def distance(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The gap between two intervals; 0 if they touch or overlap."""
    return F.greatest(b_start - a_end, a_start - b_end, F.lit(0))


def is_before(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The direction that goes with ``distance``: true unless the second interval ends before the first begins."""
    return ~(b_end < a_start)


def reciprocal_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """The overlap as a share of the longer interval, each counted as LEAST_SPAN long at least."""
    shared = F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))
    return shared / F.greatest(a_end - a_start, b_end - b_start, F.lit(LEAST_SPAN))


def shared_range(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> tuple[Column, Column]:
    """What two intervals share; nulls if nothing."""
    meet = overlaps(a_start, a_end, b_start, b_end)
    return F.when(meet, F.greatest(a_start, b_start)), F.when(meet, F.least(a_end, b_end))


def merged(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> tuple[Column, Column]:
    return F.least(a_start, b_start), F.greatest(a_end, b_end)


def centre(start: Column, end: Column) -> Column:
    return F.floor((start + end) / 2).cast("long")


def reverse(start: Column, end: Column, length: Column) -> tuple[Column, Column]:
    """The interval seen from the other end of a sequence of ``length``."""
    return length - end, length - start


def expand(start: Column, end: Column, left: Column, right: Column, length: Column) -> tuple[Column, Column, Column, Column]:
    """The interval widened on both sides within [0, length), and by how much it was."""
    new_start, new_end = F.greatest(start - left, F.lit(0)), F.least(end + right, length)
    return new_start, new_end, start - new_start, new_end - end


def strictly_before(a_chrom: Column, a_end: Column, b_chrom: Column, b_start: Column) -> Column:
    return (a_chrom < b_chrom) | ((a_chrom == b_chrom) & (a_end <= b_start))


def region_label(chrom: Column, start: Column, end: Column) -> Column:
    """1-based, inclusive: chr2:11-20."""
    return F.concat(chrom, F.lit(":"), (start + 1).cast("string"), F.lit("-"), end.cast("string"))


#: What follows the name: :first or :first-last, digits with or without commas.
_POSITIONS = r":([\d,]+)(?:-([\d,]+))?$"


def parse_region(text: Column) -> tuple[Column, Column, Column]:
    """Name, start, end (null: to the name's end) of a label. The last colon that positions follow splits it."""
    tail, first, last = (F.regexp_extract(text, _POSITIONS, i) for i in range(3))
    name = F.substring(text, F.lit(1), F.length(text) - F.length(tail))
    first, last = F.regexp_replace(first, ",", ""), F.regexp_replace(last, ",", "")
    number = lambda c: F.when(c != "", c).cast("long")
    return name, F.coalesce(number(first) - 1, F.lit(0)), number(last)


def tiles(size: Column, most: int) -> Column:
    """[0, size) cut into the fewest nearly equal pieces of at most ``most``: an array of structs; the first ones are longer."""
    n = F.floor((size - 1) / most).cast("long") + 1
    each, longer = F.floor(size / n).cast("long"), size % n

    def tile(i: Column) -> Column:
        i = i.cast("long")
        return F.struct((i * each + F.least(i, longer)).alias("start"), ((i + 1) * each + F.least(i + 1, longer)).alias("end"))

    return F.when(size > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), tile))
