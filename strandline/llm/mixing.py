"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share, by weight, of ``total`` times all words, at most ``most`` times its own words; what is above that
is shared again among the others (water filling). Every document of a source then has the same expected number of copies,
target / words. The whole part is taken as it is. The fractional parts are rounded in pairs: words move at random from one
document of the pair to the other, their sum unchanged and each expectation kept, until one of the two is a whole number. One
document of each leaf (a bounded number of rows of a source) is left fractional; those meet in a reduction tree, ``fan_in``
at a time, until the last of a source is rounded by itself. So the words taken of a source differ from its target by less than
the words of one document, however the source's rows are spread.

Rows that agree in id, source and size are one unit, rounded as one: of its m rows, the whole part of m times the fraction take one
copy more, and only what is left of that, less than one row, is rounded with others. Which rows these are is a matter of their
numbers within the unit, which are counted in pieces of a unit (see ``mix``), so that no task counts a whole unit.

Defined cases: a null text has no words; a null source is a source of its own, last in order; null ids are equal to each other;
documents without words are taken once per whole copy (they add no words); an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType
from pyspark.sql.window import Window

from .common import WORD, bounded, settled

#: Rows of a source that one leaf holds on average.
LEAF_ROWS = 512
EPSILON = 1e-9


def word_count(text_col: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(units: DataFrame, weights: Sequence[float], total: float, most: float) -> DataFrame:
    """One row per source: _source, source_size, rows, target. Water filling in closed form over the sources by capacity / weight.

    The window without keys sorts one row per source.
    """
    sources = units.groupBy(F.col("source").alias("_source")).agg(F.sum(F.col("size") * F.col("_m")).alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    everywhere = Window.orderBy(F.col("_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("_rank", F.row_number().over(everywhere) - 1).withColumn("_weight", weight)
    sources = sources.withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    whole = Window.partitionBy()
    filled = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(float(total)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(filled), F.lit(0.0))) / F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    # the level of the first source that it doesn't fill holds for all that follow; those before it are full
    sources = sources.withColumn("_level", level).withColumn("_open", F.col("_level") * F.col("_weight") <= F.col("_cap"))
    lasting = F.min(F.when(F.col("_open"), F.struct(F.col("_cap") / F.col("_weight"), F.col("_rank"), F.col("_level").alias("level")))).over(whole)["level"]
    return sources.select("_source", "source_size", "_rows", F.coalesce(F.least("_cap", lasting * F.col("_weight")), F.col("_cap")).alias("target"))


def pivot(size: np.ndarray, part: np.ndarray, draw: np.ndarray) -> tuple[np.ndarray, int]:
    """Rounds ``part`` (fractions of a copy) in one pass; returns the parts and the place still fractional, or -1.

    Between two documents of s and t words, moving w words changes their parts by w / s and -w / t.
    """
    part, held = part.copy(), -1
    for i in range(len(part)):
        p = part[i]
        if p <= EPSILON or p >= 1 - EPSILON:
            part[i] = round(p)
            continue
        if held < 0:
            held = i
            continue
        s, t, q = size[held], size[i], part[held]
        up = min((1 - q) * s, p * t)  # to the held one
        down = min(q * s, (1 - p) * t)
        w = up if draw[i] * (up + down) < down else -down
        q, p = q + w / s, p - w / t
        part[held], part[i] = q, p
        done = EPSILON < p < 1 - EPSILON
        if not EPSILON < q < 1 - EPSILON:
            part[held] = round(q)
            held = i if done else -1
        if not done:
            part[i] = round(p)
    return part, held


def _round_group(table: pa.Table) -> pa.Table:
    table = table.sort_by([("_key", "ascending"), ("_words", "ascending"), ("_part", "ascending")])
    part, held = pivot(*[table[c].to_numpy() for c in ("_words", "_part", "_u")])
    table = table.set_column(table.schema.get_field_index("_part"), "_part", pa.array(part))
    return table.append_column("_held", pa.array(np.arange(len(part)) == held))


def round_parts(units: DataFrame, fan_in: int, levels: int, seed: int) -> DataFrame:
    """units (_source, _leaf, _key, _words, _part): the same rows with _part 0 or 1."""
    def draws(level: int):
        return (F.shiftrightunsigned(F.xxhash64("_key", F.lit(seed), F.lit(level)), 11).cast("double")) / F.lit(float(1 << 53))

    columns = [c for c in units.columns if c not in ("_u", "_held")]
    kinds = StructType(units.select(*columns).schema.fields + [StructField("_u", DoubleType()), StructField("_held", BooleanType())])
    done, rest = [], units
    for level in range(levels + 1):
        grouped = rest.select(*columns).withColumn("_u", draws(level)).groupBy("_source", "_leaf").applyInArrow(_round_group, kinds)
        grouped = settled(grouped)
        done.append(grouped.filter("not _held").select(*columns))
        rest = grouped.filter("_held").withColumn("_leaf", F.expr(f"_leaf div {fan_in}"))
    last = rest.withColumn("_part", F.when(draws(levels + 1) < F.col("_part"), 1.0).otherwise(0.0)).select(*columns)
    for part in done:
        last = last.unionByName(part)
    return last


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), total: float = 1.5, most: float = 2.0, seed: int = 7, fan_in: int = 64, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", by_text: bool = False) -> DataFrame:
    """One row per unit (rows that agree in id, source and size) and piece of it: _unit, _piece, rows, source_size, target, copies
    (of each row), extra (so many rows of the piece take one copy more).

    A piece is the unit's rows of one input partition or, with ``by_text``, of one of PIECES hashes of the text, which can be found
    again from the document.
    """
    piece = text_piece(text_col) if by_text else F.spark_partition_id()
    rows = docs.select(unit(id_col, text_col, source_col), piece.alias("_piece"))
    pieces = settled(rows.groupBy("_unit", "_piece").agg(F.count(F.lit(1)).alias("rows")))
    units = pieces.groupBy("_unit").agg(F.sum("rows").alias("_m"))
    units = settled(units.select("_unit", F.col("_unit.source").alias("source"), F.col("_unit.size").alias("size"), "_m"))
    targets = settled(source_targets(units, weights, total, most))
    leaves = F.greatest(F.lit(1), F.ceil(F.col("_rows") / LEAF_ROWS)).cast("long")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(float(total)))
    parts = F.when(F.col("size") > 0, F.greatest(F.lit(0.0), expected - F.floor(expected + EPSILON))).otherwise(0.0) * F.col("_m")
    joined = units.join(bounded(targets), F.col("source").eqNullSafe(F.col("_source"))).select(
        "_unit", "source_size", "target", "_source",
        F.xxhash64("_unit").alias("_key"), F.pmod(F.xxhash64("_unit", F.lit(seed), F.lit("leaf")), leaves).alias("_leaf"),
        F.floor(expected + EPSILON).cast("int").alias("_whole"), F.floor(parts + EPSILON).alias("_extra"),
        F.col("size").cast("double").alias("_words"), F.greatest(F.lit(0.0), parts - F.floor(parts + EPSILON)).alias("_part"),
    )
    most_rows = targets.agg(F.max("_rows")).first()[0] or 0
    levels, left = 0, -(-most_rows // LEAF_ROWS)
    while left > 1:
        levels, left = levels + 1, -(-left // fan_in)
    rounded = round_parts(joined, fan_in, levels, seed).select("_unit", "source_size", "target", "_whole", (F.col("_extra") + F.col("_part").cast("long")).alias("_more"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("_unit").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.least(F.greatest(F.col("_more") - before, F.lit(0)), F.col("rows"))
    return pieces.join(rounded, "_unit").select("_unit", "_piece", "rows", "source_size", "target", F.col("_whole").alias("copies"), extra.alias("extra"))


#: The pieces of a unit that ``mixed`` numbers by themselves.
PIECES = 256


def text_piece(text_col: str):
    return F.pmod(F.xxhash64(F.col(text_col), F.lit("piece")), F.lit(PIECES)).cast("int")


def unit(id_col: str, text_col: str, source_col: str):
    """What rows of a unit agree in. Structs with nulls in the same places are equal."""
    return F.struct(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size")).alias("_unit")


def mix_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **settings) -> DataFrame:
    """One row per document of ``docs``: doc_id, size, source_size, target, taken, source, copies."""
    pieces = mix(docs, id_col=id_col, source_col=source_col, **settings)
    # no more rows of one piece than its input partition has
    each = pieces.withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    each = each.withColumn("copies", F.col("copies") + (F.col("_row") <= F.col("extra")).cast("int"))
    return each.select(F.col("_unit.id").alias(id_col), F.col("_unit.size").alias("size"), "source_size", "target", (F.col("_unit.size") * F.col("copies")).alias("taken"), F.col("_unit.source").alias(source_col), "copies")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The mix itself: every document of ``docs``, with all its columns, as often as it is taken."""
    columns = docs.columns
    pieces = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, by_text=True, **settings)
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"), unit(id_col, text_col, source_col), text_piece(text_col).alias("_piece"))
    taken = pieces.filter((F.col("copies") > 0) | (F.col("extra") > 0)).select("_unit", "_piece", "copies", "extra")
    number = F.row_number().over(Window.partitionBy("_unit", "_piece").orderBy(F.xxhash64("_doc")))
    # the narrow side is hashed, so that the texts are sorted once, for their numbers
    met = named.join(taken.hint("shuffle_hash"), ["_unit", "_piece"]).withColumn("_copies", F.col("copies") + (number <= F.col("extra")).cast("int"))
    return met.filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"), F.lit(1)))).select("_doc.*")
