"""Helpers shared by the corpus operators: reading, settled intermediate tables, two-level running totals."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The ASCII white space that separates words in the contracts of these operators.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

WORD_RE = re.compile(WORD)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, with only the named columns (all, if none is named)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(*columns) if columns else docs


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session on one machine may do without the setting."""
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_dir(spark: SparkSession, name: str) -> str:
    """A new folder's path (not yet made) below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared checkpoint folder, which survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def starts(df: DataFrame, keys: Sequence[str], index: str, value: str, out: str, block: int = 1024) -> DataFrame:
    """For each row, the sum of ``value`` over the rows of the same keys with a smaller ``index`` (null keys are keys).

    ``index`` is an integer from 0, unique within its keys. Totals of blocks of ``block`` indices are summed first, so that no
    task sorts more than ``block`` rows of a key, or one row for each block of it.
    """
    block_of = F.expr(f"{index} div {block}L")
    df = df.withColumn("_block", block_of)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*keys, "_block").agg(F.sum(value).alias("_total"))
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    blocks = blocks.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), "_base")
    inside = Window.partitionBy(*keys, "_block").orderBy(index).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = df.join(blocks, same).withColumn(out, F.col("_base") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return joined.drop("_block", "_b", "_base", *[f"_k{i}" for i in range(len(keys))])


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, total: str | None = None) -> DataFrame:
    """Settled ``rows`` with each row's number from 0 within its keys (null keys are keys), and the number of the keys' rows as ``total``.

    Rows are dealt by ranges of keys and order, so that a key's rows spread over tasks; the counts of its ranges give each range its
    first number. Rows that ``order`` doesn't tell apart stay in one range: end it with a column that does.
    """
    placed = settled(rows.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *order).withColumn("_range", F.spark_partition_id()))
    counts = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(*keys)
    before = own.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"), F.sum("_n").over(own).alias("_all"),
    )
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    found = placed.join(first, same).withColumn(out, F.col("_first") + F.row_number().over(inside) - 1)
    found = found.withColumn(total, F.col("_all")) if total else found
    return found.drop("_range", "_r", "_first", "_all", *[f"_k{i}" for i in range(len(keys))])


def bounded(df: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """``df``, marked for broadcasting only if it has at most ``most_rows`` (narrow) rows; otherwise Spark shuffles it.

    ``df`` is small to compute or already settled: its rows are counted here.
    """
    return F.broadcast(df) if df.limit(most_rows + 1).count() <= most_rows else df


def bytes_of(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
