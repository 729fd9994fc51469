"""Harmonic packing of token ids into sequences of a fixed capacity.

Pieces of length in (capacity / (k + 1), capacity / k] form class k; a sequence of class k takes exactly k pieces, so workers fill
classes without knowing each other's pieces: a piece's number within its class gives its sequence and place. A document is first
cut into full sequences; what remains is cut at capacity / k, the largest such size that fits, until a piece would leave no
more than ``waste`` of its class's sequence empty. So sequences of every class are full but for that share.

Numbers within a class come from counts of (class, bucket) and their running totals, buckets being hashes of the piece, about
``BUCKET_ROWS`` rows each. Only the last, unfilled sequence of each class is left: fewer than k pieces for each class, whatever
the input: the sum of k - 1 over the classes that whole lengths have, 21,297 at a capacity of 4,096; one task packs those by first
fit in descending order.

Defined cases: a null text counts as empty (a piece of the end id alone); repeated rows are packed once each; null ids sort as
any other value; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settled, starts
from .tokenize import encoder, tokenizer_path

BUCKET_ROWS = 1000
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, row long"


def cuts(n: int, capacity: int, waste: float) -> list[int]:
    """The lengths into which a document of n ids is cut."""
    out, n = [capacity] * (n // capacity), n % capacity
    while n:
        k = capacity // n
        if capacity - k * n <= waste * capacity:
            out.append(n)
            break
        fit = capacity // (k + 1)
        out.append(fit)
        n -= fit
    return out


def pieces(docs: DataFrame, tokenizer: str, end_id: int | None, capacity: int, waste: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, row (tells equal ids apart)."""
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, False).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                rows: list[tuple] = []
                for name, row, ids in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), encode([t or "" for t in some.column(1).to_pylist()])):
                    ids, begin = ids + end, 0
                    for n in cuts(len(ids) // 4, capacity, waste):
                        rows.append((name, begin, n, ids[4 * begin : 4 * (begin + n)], len(ids) // 4, row))
                        begin += n
                columns = list(zip(*rows)) or [()] * 6
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "length", "ids", "doc_tokens", "row"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(cut, PIECES)


def first_fit(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Adds bin and place by first fit, longest pieces first. For the few pieces that the classes leave."""
    frame = frame.sort_values(["length", "_order"], ascending=[False, True], kind="stable", ignore_index=True)
    used: list[int] = []
    bins, places = [], []
    least = 0  # bins before it are full
    for n in frame["length"]:
        i = least
        while i < len(used) and used[i] + n > capacity:
            i += 1
        if i == len(used):
            used.append(0)
        bins.append(i)
        places.append(used[i])
        used[i] += n
        while least < len(used) and used[least] == capacity:
            least += 1
    return frame.assign(sequence_id=bins, offset=places)


def pack(found: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, row and any other columns).

    Sequence numbers: those of the classes first, without gaps, then those of the pieces that are left.
    """
    name = F.xxhash64("doc_id", "start", "row")
    found = settled(found.withColumn("_class", F.expr(f"{capacity} div length")).withColumn("_order", name))
    buckets = max(1, -(-found.count() // BUCKET_ROWS))
    found = found.withColumn("_bucket", F.pmod(F.col("_order"), F.lit(buckets)))
    counts = starts(found.groupBy("_class", "_bucket").agg(F.count(F.lit(1)).alias("_n")), ["_class"], "_bucket", "_n", "_first")
    # at most one class for each quotient of the capacity
    classes = counts.groupBy("_class").agg(F.sum("_n").alias("_pieces")).withColumn("_sequences", F.expr("_pieces div _class"))
    before = Window.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("_base", F.coalesce(F.sum("_sequences").over(before), F.lit(0))).withColumn("_left_base", F.sum("_sequences").over(Window.partitionBy()))
    counts = settled(counts.join(F.broadcast(settled(classes)), "_class"))
    in_bucket = Window.partitionBy("_class", "_bucket").orderBy("_order", "doc_id", "start", "row")
    ranked = found.withColumn("_rank", F.row_number().over(in_bucket) - 1).join(counts.drop("_n"), ["_class", "_bucket"])
    ranked = ranked.withColumn("_number", F.col("_first") + F.col("_rank"))
    ranked = ranked.withColumn("sequence_id", F.when(F.col("_number") < F.col("_sequences") * F.col("_class"), F.col("_base") + F.expr("_number div _class")))
    ranked = settled(ranked.drop("_bucket", "_rank", "_first", "_pieces", "_sequences", "_base"))
    in_sequence = Window.partitionBy("sequence_id").orderBy("_number").rowsBetween(Window.unboundedPreceding, -1)
    full = ranked.filter("sequence_id is not null").withColumn("offset", F.coalesce(F.sum("length").over(in_sequence), F.lit(0)))
    left = ranked.filter("sequence_id is null").drop("sequence_id")
    kinds = ", ".join(f"`{c}` {t}" for c, t in left.dtypes) + ", sequence_id long, offset long"
    left = left.groupBy(F.lit(0).alias("_all")).applyInPandas(lambda frame: first_fit(frame, capacity), kinds)
    left = left.withColumn("sequence_id", F.col("_left_base") + F.col("sequence_id"))
    return full.unionByName(left.select(full.columns)).drop("_class", "_order", "_number", "_left_base")


def packed(docs: DataFrame, tokenizer: str | None = None, end_id: int | None = 2, capacity: int = 4096, waste: float = 1 / 64, with_ids: bool = False, **columns) -> DataFrame:
    """The pieces of ``docs`` with their ids' crc32 (and the ids), sequence and offset."""
    found = pieces(docs, tokenizer or tokenizer_path("word_bpe_49k.json"), end_id, capacity, waste, **columns)
    found = found.withColumn("ids_crc32", F.crc32("ids"))
    return pack(found if with_ids else found.drop("ids"), capacity).drop("row")
