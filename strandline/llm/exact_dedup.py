"""Exact deduplication: a tree merge of sorted digest runs, in DataFrame operations only.

Every row is reduced to (sha256, length, xxhash64) of its text: the digest, and two more values that verify it, so that rows meet
only if all three hashes of the text agree. These narrow rows are settled once; the texts are read for them and, where whole
documents are asked for, once more for the survivors.

Rows are dealt over ``runs`` runs by a hash of id and place, and over ``parts`` ranges of the digest. A run is sorted by digest
within each range; its neighbours with equal digests are reduced to one entry: the surviving id and the number of rows. Runs then
merge in rounds, ``fan_in`` neighbouring runs at a time (2: a binomial tree): their entries of a range meet in one sorted sequence,
in which at most ``fan_in`` entries in a row share a digest, and each of these stretches becomes one entry of the merged run. After
the last round one run is left, sorted within each range. A group of copies that holds a third of all rows is thus never larger in
one task than its share of a run, or ``fan_in`` entries in a later round. The way back is a join by (digest, run), so the group's
own rows are spread over the runs as well. Unless given, ``runs`` and ``parts`` grow with the rows (see ``enough``), which changes
no result.

Defined cases: a null text counts as empty; null ids count as smaller than all others (larger, with ``keep="smallest"``); of rows
that share text and surviving id, one stays and the others go; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settled

DIGEST = ["_sha", "_length", "_check"]
#: Rows of a run, over all ranges of the digest; and rows of a range, over all runs. Both are about halved or doubled by rounding.
RUN_ROWS, PART_ROWS = 1 << 22, 1 << 20
LEAST_RUNS, LEAST_PARTS = 16, 64


def _order(keep: str) -> Column:
    """The surviving id last."""
    return {"largest": F.col("_id").asc_nulls_first(), "smallest": F.col("_id").desc_nulls_first()}[keep]


def enough(rows: int, each: int, least: int) -> int:
    """A power of two, about one for ``each`` rows."""
    return max(least, 1 << max(0, -(-rows // each) - 1).bit_length())


def digest_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One narrow row per document: its id, the digest with the values that verify it, and a number to deal by."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("_id"),
        F.unhex(F.sha2(text, 256)).alias("_sha"),
        F.octet_length(text).cast("long").alias("_length"),
        F.xxhash64(text).alias("_check"),
        F.monotonically_increasing_id().alias("_place"),  # fixed once the rows are settled; it only spreads rows of one id
    )


def sorted_runs(rows: DataFrame, runs: int, parts: int, keep: str) -> DataFrame:
    """The rows, each in its run, sorted by digest and then id: _n on the last row of a digest is the number of its rows there,
    null on all others; _copy numbers the rows of one digest and id from 1."""
    first = F.conv(F.hex(F.substring("_sha", 1, 4)), 16, 10).cast("long")
    dealt = rows.withColumn("_part", F.floor(first * F.lit(parts) / F.lit(1 << 32)).cast("int"))
    dealt = dealt.withColumn("_run", F.pmod(F.xxhash64("_id", "_place"), F.lit(runs)).cast("int")).drop("_place")
    run = Window.partitionBy("_part", "_run")
    by_id, by_digest = run.orderBy(*DIGEST, _order(keep)), run.orderBy(*DIGEST)
    same = F.lit(True)
    for c in DIGEST:
        same = same & (F.lead(c).over(by_id) == F.col(c))
    placed = dealt.withColumn("_last", ~F.coalesce(same, F.lit(False))).withColumn("_row", F.row_number().over(by_id)).withColumn("_copy", F.col("_row") - F.rank().over(by_id) + 1)
    n = (F.col("_row") - F.rank().over(by_digest) + 1).cast("long")
    return placed.withColumn("_n", F.when(F.col("_last"), n)).drop("_row", "_last")


def merge_round(level: DataFrame, fan_in: int, keep: str) -> DataFrame:
    """Each ``fan_in`` neighbouring runs merged into one: entries that are neighbours in the sorted sequence and share a digest become one."""
    met = level.withColumn("_run", F.expr(f"_run div {fan_in}").cast("int"))
    merged = Window.partitionBy("_part", "_run").orderBy(*DIGEST, _order(keep))
    same = [F.lit(True)]
    for step in range(1, fan_in):
        equal = F.lit(True)
        for c in DIGEST:
            equal = equal & (F.lag(c, step).over(merged) == F.col(c))
        same.append(F.coalesce(equal, F.lit(False)))
    total = F.col("_n")
    for step in range(1, fan_in):
        total = total + F.when(same[step], F.lag("_n", step).over(merged)).otherwise(0)
    follows = F.lit(True)
    for c in DIGEST:
        follows = follows & (F.lead(c).over(merged) == F.col(c))
    return met.select("_part", "_run", *DIGEST, "_id", total.alias("_n"), F.coalesce(follows, F.lit(False)).alias("_more")).filter("not _more").drop("_more")


def merge_runs(level: DataFrame, runs: int, fan_in: int, keep: str) -> DataFrame:
    """The root: one entry per digest, with the surviving id and the number of rows. Each level is settled."""
    while runs > 1:
        runs = -(-runs // fan_in)
        level = settled(merge_round(level, fan_in, keep))
    return level.drop("_run")


def _grouped(docs: DataFrame, id_col: str, text_col: str, keep: str, runs: int | None, fan_in: int, parts: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows in their runs, the first level (an entry per digest and run) and the root."""
    rows = settled(digest_rows(docs, id_col, text_col))
    n = rows.count()
    runs = runs or enough(n, RUN_ROWS, LEAST_RUNS)
    placed = settled(sorted_runs(rows, runs, parts or enough(n, PART_ROWS, LEAST_PARTS), keep))
    first = placed.filter("_n IS NOT NULL").select("_part", "_run", *DIGEST, "_id", "_n")
    return placed, first, merge_runs(first, runs, fan_in, keep)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", runs: int | None = None, fan_in: int = 2, parts: int | None = None) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256."""
    placed, first, root = _grouped(docs, id_col, text_col, keep, runs, fan_in, parts)
    # down the tree: to one entry for each run of a digest, then to the documents of each run
    best = root.select(*DIGEST, F.col("_id").alias("_best"), F.col("_n").alias("_size"))
    entries = first.select(*DIGEST, "_run", F.col("_id").alias("_entry")).join(best, DIGEST)
    # runs may share the surviving id: the survivor is in the first of them
    mine = F.col("_entry").eqNullSafe(F.col("_best"))
    holder = F.min(F.when(mine, F.col("_run"))).over(Window.partitionBy(*DIGEST))
    down = entries.withColumn("_holds", mine & (F.col("_run") == holder)).drop("_entry")
    return placed.select(*DIGEST, "_run", "_id", "_copy").join(down, [*DIGEST, "_run"]).select(
        F.col("_id").alias(id_col),
        F.col("_best").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_holds") & F.col("_id").eqNullSafe(F.col("_best")) & (F.col("_copy") == 1)).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest", runs: int | None = None, fan_in: int = 2, parts: int | None = None) -> DataFrame:
    """The surviving documents, with all their columns: one row for each different text.

    Documents meet the root's entries by digest and id, so that no id has to be unique; the texts move once.
    """
    columns = docs.columns
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"),
        F.unhex(F.sha2(text, 256)).alias("_sha"),
        F.struct(F.col(id_col)).alias("_key"),
    )
    _, _, root = _grouped(docs, id_col, text_col, keep, runs, fan_in, parts)
    winners = root.select("_sha", F.struct(F.col("_id")).alias("_key"))
    first = Window.partitionBy("_sha", "_key").orderBy(F.xxhash64("_doc"))
    met = named.join(winners, ["_sha", "_key"]).withColumn("_rank", F.row_number().over(first))
    return met.filter("_rank = 1").select("_doc.*")
