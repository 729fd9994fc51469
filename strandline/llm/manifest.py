"""A Merkle manifest of a table: one binary hash tree for each group of rows, and one over the groups' roots.

A row's leaf is the SHA-256 of its fields, each ``-`` if null, else the number of its UTF-8 bytes, ``:`` and its value. A group's
leaves ascend by id. Level by level, a window over (group, parent's index) collects the two nodes of a run in order: their texts are
the parent's preimage, and the other one of the two is the node's sibling. Of the run's equal parents one goes on to the next level.
Each level is settled, half as long as the one below. A group that has one node left is done; the groups' roots, in order of the
group, are the leaves of the last tree.

Siblings go back down by joins on (group, parent's index): a node's proof is its sibling followed by its parent's proof, 32 bytes a
level. ``folded`` recomputes the root from a leaf and its proof alone, so a changed row doesn't give the manifest's root again.

No task holds a group: leaves are numbered by ranges of (group, id) and every window holds two rows. A group may have any size.

Defined cases: a null id comes first in its group and a null group comes first; rows of one id are ordered by their leaf; equal rows are
leaves of their own, side by side; a lone leaf is its group's root, a lone group's root is the root, and an empty proof's hash is that of
the empty text; an empty table gives an empty table; columns that are not among the fields take no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded, numbered, settled

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = 32


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """A row's leaf over FIELDS; ``changed`` gives other values for some of them."""
    return leaf_of([changed.get(c, F.col(c)) for c in FIELDS])


def leaf_of(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def levels(leaves: DataFrame) -> list[DataFrame]:
    """leaves: _g (no null), _i from 0 without gaps, _n of the group, _h, and any columns that only the first level keeps.

    Each level (settled) has a node's _g, _i, _n (nodes of the group on this level), _h, _sibling (binary; null: none) and _parent.
    The first level holds all leaves, the others the nodes of groups that have more than one left.
    """
    out, nodes = [], leaves
    while True:
        run = Window.partitionBy("_g", F.expr("_i div 2")).orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        met = nodes.withColumn("_run", F.collect_list("_h").over(run))
        other = F.when(F.size("_run") > 1, F.element_at("_run", F.when(F.expr("_i % 2 = 0"), 2).otherwise(1)))
        level = settled(met.withColumn("_sibling", F.unhex(other)).withColumn("_parent", F.sha2(F.array_join("_run", ""), 256)).drop("_run"))
        out.append(level)
        if not level.filter("_n > 2").limit(1).count():
            return out
        # one of each run's equal parents goes on: the first node's
        nodes = level.filter("_n > 2 AND _i % 2 = 0").select("_g", F.expr("_i div 2").alias("_i"), F.expr("(_n + 1) div 2").alias("_n"), F.col("_parent").alias("_h"))


def roots(tree: Sequence[DataFrame]) -> DataFrame:
    """(_g, _root): the last node of each group."""
    alone = tree[0].filter("_n = 1").select("_g", F.col("_h").alias("_root"))
    for level in tree:
        alone = alone.union(level.filter("_n = 2 AND _i = 0").select("_g", "_parent"))
    return alone


def proofs(tree: Sequence[DataFrame], together: int = 6) -> DataFrame:
    """The first level with each leaf's _proof: its siblings from the leaf up, one after the other. ``together`` levels make one job."""
    none = F.unhex(F.lit(""))
    above = None
    for at in range(len(tree) - 1, -1, -1):
        level = tree[at]
        own = F.coalesce("_sibling", none)
        if above is None:
            found = level.withColumn("_proof", own)
        else:
            up = above.select(F.col("_g").alias("_ag"), F.col("_i").alias("_ai"), F.col("_proof").alias("_above"))
            found = level.join(up, (F.col("_g") == F.col("_ag")) & (F.expr("_i div 2") == F.col("_ai")), "left")
            found = found.withColumn("_proof", F.concat(own, F.coalesce("_above", none))).drop("_ag", "_ai", "_above")
        above = found if at == 0 else found.select("_g", "_i", "_proof")
        if at and (len(tree) - at) % together == 0:
            above = settled(above)
    return above


def folded(node: Column, proof: Column, index: Column, size: Column) -> Column:
    """The root of a tree of ``size`` leaves, from leaf number ``index`` and its proof."""
    depth = F.when(size > 1, F.length(F.bin(size - 1))).otherwise(0)

    def step(s: Column, _: Column) -> Column:
        right = s["i"] % 2 == 1
        has = right | (s["i"] + 1 < s["n"])
        other = F.lower(F.hex(F.substring(proof, s["at"] + 1, NODE)))
        met = F.when(~has, s["h"]).when(right, F.concat(other, s["h"])).otherwise(F.concat(s["h"], other))
        half = lambda x: F.shiftright(x, 1)
        return F.struct(F.sha2(met, 256).alias("h"), (s["at"] + F.when(has, NODE).otherwise(0)).alias("at"), half(s["i"]).alias("i"), half(s["n"] + 1).alias("n"))

    start = F.struct(node.alias("h"), F.lit(0).alias("at"), index.cast("long").alias("i"), size.cast("long").alias("n"))
    steps = F.when(depth > 0, F.sequence(F.lit(1), F.greatest(depth, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda s: s["h"])


def manifest(rows: DataFrame, group: str, order: Sequence[str], leaf_col: str = "leaf") -> DataFrame:
    """rows with their group's ``subroot``, the ``root``, _proof and what ``folded_root`` needs. ``rows`` has a column ``leaf_col``; all
    of its columns are kept, so let them be narrow."""
    named = rows.withColumn("_g", F.when(F.col(group).isNull(), "").otherwise(F.concat(F.lit("="), F.col(group).cast("string"))))
    narrow = settled(named.withColumn("_h", F.col(leaf_col)).withColumn("_place", F.monotonically_increasing_id()))
    by = [*[F.col(c).asc_nulls_first() for c in order], F.col("_h").asc(), F.col("_place").asc()]
    tree = levels(numbered(narrow, ["_g"], by, "_i", "_n").drop("_place"))
    groups = settled(roots(tree).select(F.lit("").alias("_g"), F.col("_g").alias("_name"), F.col("_root").alias("_h")))
    top = levels(numbered(groups, ["_g"], [F.col("_name").asc()], "_i", "_n"))
    whole = roots(top).select(F.col("_g").alias("_rg"), F.col("_root").alias("root"))
    ends = proofs(top).join(whole, F.col("_g") == F.col("_rg"))
    ends = settled(ends.select(F.col("_name").alias("_tg"), F.col("_h").alias("subroot"), "root", F.col("_proof").alias("_top_proof"), F.col("_i").alias("_top_i"), F.col("_n").alias("_top_n")))
    return proofs(tree).join(bounded(ends), F.col("_g") == F.col("_tg"))


def folded_root(leaf_col: Column) -> Column:
    """On rows of ``manifest``: the root that this leaf, in its row's place, gives with its row's proof."""
    return folded(folded(leaf_col, F.col("_proof"), F.col("_i"), F.col("_n")), F.col("_top_proof"), F.col("_top_i"), F.col("_top_n"))


def proof_hash() -> Column:
    return F.sha2(F.lower(F.hex(F.concat("_proof", "_top_proof"))), 256)


def tampered_leaf(id_col: str = "doc_id", number_col: str = "n_chars", every: int = 7) -> Column:
    """The leaf after one is added to ``number_col`` where ``every`` divides the id's crc32; elsewhere, and where either is null, the leaf as it is."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0
    return F.when(hit & F.col(number_col).isNotNull(), leaf(**{number_col: F.col(number_col) + 1})).otherwise(leaf())


def verified(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root (from the tampered leaf), verified."""
    rows = docs.select("doc_id", "lang", leaf().alias("leaf"), tampered_leaf().alias("_tampered"))
    found = manifest(rows, "lang", ["doc_id"]).withColumn("folded_root", folded_root(F.col("_tampered")))
    return found.select("doc_id", "leaf", "subroot", "root", proof_hash().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
