"""SimHash near-deduplication: fingerprints, pigeonhole blocks, Hamming verification, components.

Documents with one fingerprint become one node. A fingerprint is split into ``BLOCKS`` blocks; two fingerprints that differ in at
most ``BITS`` bits agree in at least BLOCKS - BITS of them, so each choice of that many blocks is a join key. Nodes that meet on
a key are compared and linked if they differ in at most BITS bits. Keys met by many nodes (``MEET`` or more) are not paired up:
there, every node is written once for each choice of BITS bits outside the key, with these bits cleared; nodes equal then differ
in at most these bits, so all of them are linked to one, and the links lost are only those that this implies. Both ways are exact.

Defined cases: a null or empty text has the fingerprint zero, linked like any other; texts of one or two words have one shingle,
the whole; null ids are larger than all others as component ids; repeated rows belong to one component; an empty table gives an
empty table; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType
from pyspark.sql.window import Window

from .common import bytes_of, settled
from .components import components

BLOCKS, BITS, MEET = 5, 2, 256
SEED = 42
SHINGLE = 3


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest as h

    words = bytes_of(text).lower().split()  # bytes: A-Z, and the six ASCII spaces, only
    n = len(words) - shingle + 1
    if not words:
        return 0
    if n <= 1:
        return h(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = [0, *ends[: n - 1].tolist()]
    hashes = np.array([h(joined[a:b], SEED) for a, b in zip(begins, (ends[shingle - 1 :] - 1).tolist())], dtype=np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        some = hashes[at : at + 4096]
        ones += np.unpackbits(some.view(np.uint8).reshape(len(some), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view(np.uint64)[0])


@F.arrow_udf(LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    """As signed 64-bit numbers."""
    return pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64), pa.int64())


def _edges() -> list[int]:
    return [64 * i // BLOCKS for i in range(BLOCKS + 1)]


def _masks() -> list[int]:
    """For each choice of BLOCKS - BITS blocks, the bits of these."""
    at = _edges()
    return [sum(((1 << at[b + 1]) - 1) ^ ((1 << at[b]) - 1) for b in chosen) for chosen in combinations(range(BLOCKS), BLOCKS - BITS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _cleared(key_mask: int) -> list[int]:
    """For each choice of BITS bits outside the key, all bits but these."""
    outside = [i for i in range(64) if not key_mask >> i & 1]
    return [_signed(((1 << 64) - 1) ^ sum(1 << i for i in chosen)) for chosen in combinations(outside, BITS)]


def links(nodes: DataFrame) -> DataFrame:
    """nodes (fp, distinct): edges (u, v) whose components are those of all pairs that differ in at most BITS bits."""
    masks = _masks()
    keys = F.array(*[F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)])
    keyed = nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.choice", "k.key")
    met = keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("met")).filter("met > 1")
    keyed = settled(keyed.join(met, ["choice", "key"]))
    few = keyed.filter(F.col("met") < MEET)
    pairs = few.select("choice", "key", F.col("fp").alias("u")).join(few.select("choice", "key", F.col("fp").alias("v")), ["choice", "key"])
    near = pairs.filter((F.col("u") < F.col("v")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= BITS)).select("u", "v")
    # keys that many meet: equal but for the cleared bits, at most 2 ** BITS distinct nodes in a group
    clear = F.lit(None)
    for i, m in enumerate(masks):
        clear = F.when(F.col("choice") == i, F.array(*[F.lit(x) for x in _cleared(m)])).otherwise(clear)
    many = keyed.filter(F.col("met") >= MEET).select("fp", F.explode(clear).alias("clear"))
    alike = many.groupBy("clear", F.col("fp").bitwiseAND(F.col("clear")).alias("rest")).agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    stars = alike.select(F.array_min("all").alias("u"), F.explode("all").alias("v")).filter("u <> v")
    return near.union(stars).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: _id, _hash (of its text), fp, _root (a fingerprint that names the component), component_id."""
    rows = settled(docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), fingerprints(text_col).alias("fp")))
    nodes = settled(rows.groupBy("fp").agg(F.min("_id").alias("_least")))
    roots = components(links(nodes.select("fp")))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root"))
    ids = placed.groupBy(F.col("_root").alias("_r")).agg(F.min("_least").alias("component_id"))
    named = placed.join(ids, F.col("_root") == F.col("_r")).select("fp", "_root", "component_id")
    return rows.join(named, "fp")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, fingerprint (hex), component_id (smallest id reachable)."""
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return _grouped(docs, id_col, text_col).select(F.col("_id").alias(id_col), digits, "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns: of each component, the first row of the smallest id (and text hash)."""
    columns = docs.columns
    found = _grouped(docs, id_col, text_col)
    best = found.groupBy("_root").agg(F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_hash").alias("h"))).alias("b"))
    kept = best.select(F.coalesce(F.col("b.i").cast("string"), F.lit("null")).alias("_key"), F.col("b.h").alias("_hash"))
    named = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("_key"),
        F.xxhash64(text_col).alias("_hash"),
    )
    first = Window.partitionBy("_key", "_hash").orderBy(F.xxhash64("_doc"))
    met = named.join(kept, ["_key", "_hash"]).withColumn("_rank", F.row_number().over(first))
    return met.filter("_rank = 1").select("_doc.*")
