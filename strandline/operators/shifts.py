"""How far an indel can be moved on the reference without changing the sequence it makes: both shifts and the range of its breaks.

Moved right by k bases, an indel that replaces R by A before the sequence X says the same if the first k bases of R + X and of A + X agree;
to the left it is the same in reverse. So each shift is the longest common start of two texts, both from reference chunks but for A. It is
looked for in windows that grow eightfold from round to round; within a window, halving finds the place with a few comparisons of substrings.
Almost all indels are settled in the first round, and later ones read chunks for the rest only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from ..sources.text import joined_parts, parts_of

FIRST_WINDOW, GROWTH, WIDEST_WINDOW = 64, 8, 1 << 15


def common_start(x: Column, y: Column, most: int) -> Column:
    """How many first letters agree, up to ``most``, a power of two. N agrees with nothing."""
    steps = F.array(*[F.lit(most >> i) for i in range(most.bit_length())])
    fits = lambda p, at, n: (at + n <= p["size"]) & (F.substring(p["x"], at + 1, n) == F.substring(p["y"], at + 1, n))
    count = lambda p: F.aggregate(steps, F.lit(0), lambda at, n: at + F.when(fits(p, at, n), n).otherwise(0))
    # the texts are made once, as a value that the steps share, not anew in each step
    pair = F.struct(F.translate(x, "N", "-").alias("x"), F.translate(y, "N", "+").alias("y"), F.least(F.length(x), F.length(y)).alias("size"))
    return F.least(F.element_at(F.transform(F.array(pair), count), 1), F.lit(most))


def indel_shifts(indels: DataFrame, chunks: DataFrame, chunk: int = 1_000_000) -> DataFrame:
    """indels (id, chrom, start, end, inserted): [start, end) of the reference gives way to the bases inserted (null: none); an id is one row.
    chunks (chrom, start, seq) as ``sources.text.read_fasta`` gives them, ``chunk`` bases each.

    Columns id, left, right: by how many bases the indel can move each way; the break's homology is their sum. Indels that change
    nothing can't be moved (0, 0), those with a null place have nulls. A chromosome's ends and Ns stop a move. Long repeats take a round for each eightfold
    length, and beyond WIDEST_WINDOW bases one for each such stretch.
    """
    named = indels.select("id", "chrom", "start", "end", F.coalesce(F.col("inserted"), F.lit("")).alias("inserted"))
    moves = named.filter("chrom is not null and start <= end and (start < end or inserted <> '')")
    live = stored(moves.withColumn("way", F.explode(F.array(F.lit(-1), F.lit(1)))).withColumn("at", F.lit(0).cast("long")))
    c, window, done = F.col, FIRST_WINDOW, []
    size, right = F.length("inserted"), c("way") == 1
    while not live.isEmpty():
        own = F.substring(F.when(right, c("inserted")).otherwise(F.reverse("inserted")), (c("at") + 1).cast("int"), F.lit(window))
        rest, past = F.lit(window) - F.length(own), F.greatest(F.lit(0), c("at") - size)
        span = lambda which, low, length: F.struct(F.lit(which).alias("which"), F.greatest(F.lit(0), low).cast("long").alias("start"), (low + length).cast("long").alias("end"))
        old = span(0, F.when(right, c("start") + c("at")).otherwise(c("end") - c("at") - window), F.lit(window))
        new = span(1, F.when(right, c("end") + past).otherwise(c("start") - past - rest), rest)
        spans = live.select("id", "way", "chrom", F.explode(F.array(old, new)).alias("s")).filter("s.start < s.end")
        # the bases are dealt once, by the indel and the way, for both texts
        parts = parts_of(chunks, spans.select(F.struct("id", "way", "s.which").alias("id"), "chrom", "s.start", "s.end"), chunk)
        pick = lambda i: joined_parts(F.when(c("id.which") == i, c("part")))
        both = parts.groupBy(c("id.id").alias("id"), c("id.way").alias("way")).agg(pick(0).alias("_x"), pick(1).alias("_y"))
        both = both.select("id", "way", *[F.when(right, c(n)).otherwise(F.reverse(n)).alias(n) for n in ("_x", "_y")])
        met = live.join(both, ["id", "way"], "left").fillna("", ["_x", "_y"])
        met = met.withColumn("_same", common_start(c("_x"), F.concat(own, c("_y")), window)).drop("_x", "_y")
        # an equal text in place of another of its length is no change
        idle = (size == c("end") - c("start")) & (c("at") + c("_same") >= size)
        told = stored(met.withColumns({"_idle": idle, "at": c("at") + c("_same")}))
        over = c("_idle") | (c("_same") < window)
        done.append(told.filter(over).select("id", "way", F.when(c("_idle"), 0).otherwise(c("at")).cast("long").alias("n")))
        live = told.filter(~over).drop("_idle", "_same")
        window = min(window * GROWTH, WIDEST_WINDOW)
    if not done:
        return named.select("id", *[F.when(c("start") <= c("end"), 0).cast("long").alias(n) for n in ("left", "right")])
    of = lambda way: F.max(F.when(c("way") == way, c("n")))
    shifts = reduce(DataFrame.unionByName, done).groupBy("id").agg(of(-1).alias("left"), of(1).alias("right"))
    known = F.when(c("chrom").isNotNull() & (c("start") <= c("end")), 0)
    return named.select("id", known.alias("_none")).join(shifts, "id", "left").select("id", *[F.coalesce(n, "_none").cast("long").alias(n) for n in ("left", "right")])


def shifted_breaks(indels: DataFrame, shifts: DataFrame) -> DataFrame:
    """indels with their ``indel_shifts`` at their leftmost place, and homology, the bases by which their breaks can move in all.

    An insertion's bases are turned round as it moves. An indel that deletes and inserts keeps its place, as its bases would become others.
    """
    met = indels.join(shifts, "id").withColumn("inserted", F.coalesce("inserted", F.lit("")))
    size = F.length("inserted")
    by = F.when((F.col("start") < F.col("end")) & (size > 0), 0).otherwise(F.col("left"))
    turn = (by % F.greatest(size, F.lit(1))).cast("int")
    turned = F.concat(F.right("inserted", turn), F.substring(F.col("inserted"), F.lit(1), size - turn))
    return met.select(*[c for c in indels.columns if c not in ("start", "end", "inserted")], (F.col("start") - by).alias("start"), (F.col("end") - by).alias("end"), turned.alias("inserted"), (F.col("left") + F.col("right")).alias("homology"))
