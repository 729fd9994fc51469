"""The prefix trie of conversations: which conversations start with the same turns, how often, and what sharing them saves.

Every distinct sequence of a conversation's first d turns is a node. Its digest is made of running sums of the hashes of (depth, turn),
so that a conversation of any length is summed in blocks, not by one task; the owner of a node is the smallest conversation
that starts with it (the prefix-digest minima). If a conversation owns a node, it owns its deeper ones too, so each
conversation's first owned depth is found by binary search: all open conversations probe one depth each per round, by a join with the
digests and one with the minima. What a conversation owns is a chain of nodes; a chain hangs from the node at which its last failed
probe ended, so the owned chains form a tree. Their totals are aggregated bottom-up by doubling: each round every chain adds what the
chains at the present distance below it have, and looks twice as far. Running sums along the chains then give the nodes' subtrees.

The ids of the conversations that end at a node are joined in pieces of 4096 consecutive ids, which one hash reads in order.

Defined cases: rows without a conversation id belong to no conversation; a null role or text is empty; a null turn comes first; turns of one
number are ordered by their hash; repeated rows are turns of their own; a conversation without turns is a member of the root only; an
empty table gives an empty table (no root); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import numbered, settled
from .mixing import word_count

#: 32-bit parts of a turn's hash that are summed each by itself; a sum of two billion parts fits in a long.
PARTS = 5
BLOCK = 1024
#: Bits of an id within a piece of joined ids.
PIECE_BITS = 12
ROOT = ""
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """One narrow settled row per turn: conv_id, depth (from 1), _turn (hash of role and text), words. The texts are read once."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("_turn"),
        word_count("text").alias("words"), F.monotonically_increasing_id().alias("_place"),
    )
    order = [F.col("turn").asc_nulls_first(), F.col("_turn").asc(), F.col("_place").asc()]
    return settled(numbered(settled(rows), ["conv_id"], order, "_at").select("conv_id", (F.col("_at") + 1).alias("depth"), "_turn", "words"))


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """The turns after each conversation c took over the first h turns of c - c % every in place of its own, h = crc32(c) % most; and all ids."""
    convs = settled(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")))
    named = convs.select(F.col("conv_id").alias("_c"), (F.col("conv_id") - F.col("conv_id") % every).alias("_base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).alias("_h"))
    heads = turns.filter(F.col("depth") < most)
    first = heads.join(named, (F.col("conv_id") == F.col("_base")) & (F.col("depth") <= F.col("_h"))).select(F.col("_c").alias("conv_id"), "depth", "_turn", "words")
    bases = convs.select(F.col("conv_id").alias("_b"), F.col("_n").alias("_bn"))
    shift = named.join(bases, F.col("_base") == F.col("_b"), "left").select("_c", "_h", F.least("_h", F.coalesce("_bn", F.lit(0))).alias("_taken"))
    own = turns.join(shift, F.col("conv_id") == F.col("_c")).filter("depth > _h").select("conv_id", (F.col("depth") - F.col("_h") + F.col("_taken")).alias("depth"), "_turn", "words")
    return first.unionByName(own), convs.select("conv_id")


def running(rows: DataFrame, values: Sequence[str], block: int = BLOCK) -> DataFrame:
    """rows with each value's running sum along conv_id by depth, in place of the value; the depths of a conversation have no gaps.

    Sums within blocks of depths come first; a block's last row hands them on, so that no task sums up a whole conversation.
    """
    of_block = F.floor(F.col("depth") / block)
    inside = Window.partitionBy("conv_id", "_block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.withColumn("_block", of_block)
    sums = settled(sums.withColumns({v: F.sum(v).over(inside) for v in values}))
    before = Window.partitionBy("_c").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    handed = sums.filter((F.col("depth") + 1) % block == 0).select(F.col("conv_id").alias("_c"), (F.col("_block") + 1).alias("_b"), *[F.col(v).alias(f"_on_{v}") for v in values])
    handed = handed.withColumns({f"_on_{v}": F.sum(f"_on_{v}").over(before) for v in values})
    joined = sums.join(handed, (F.col("conv_id") == F.col("_c")) & (F.col("_block") == F.col("_b")), "left")
    return joined.withColumns({v: F.col(v) + F.coalesce(f"_on_{v}", F.lit(0)) for v in values}).drop("_block", "_c", "_b", *[f"_on_{v}" for v in values])


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, digest of the first depth turns, words of the last of them."""
    hashed = turns.withColumn("_hash", F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("_turn")), 256))
    parts = [f"_s{i}" for i in range(PARTS)]
    hashed = hashed.select("conv_id", "depth", "words", *[F.conv(F.substring("_hash", 1 + 8 * i, 8), 16, 10).cast("long").alias(p) for i, p in enumerate(parts)])
    return running(hashed, parts).select("conv_id", "depth", F.unhex(F.sha2(F.concat_ws(":", "depth", *parts), 256)).alias("digest"), "words")


def first_owned(rows: DataFrame, minima: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, size (turns), first (owned depth; size + 1 if none) and _parent, the owner of the node before it (null: the root's)."""
    sizes = rows.groupBy(F.col("conv_id").alias("_c")).agg(F.max("depth").alias("_size"))
    search = convs.join(sizes, F.col("conv_id") == F.col("_c"), "left").select("conv_id", F.coalesce("_size", F.lit(0)).cast("long").alias("size"))
    search = settled(search.select("conv_id", "size", F.lit(1).cast("long").alias("_low"), (F.col("size") + 1).alias("_high"), F.lit(None).cast("long").alias("_parent")))
    longest = search.agg(F.max("size")).first()[0] or 0
    probed = rows.select(F.col("conv_id").alias("_c"), F.col("depth").alias("_d"), "digest")
    found = search.filter("_low = _high")
    for _ in range(longest.bit_length()):
        probes = search.filter("_low < _high").withColumn("_mid", F.expr("(_low + _high) div 2"))
        met = probes.join(probed, (F.col("conv_id") == F.col("_c")) & (F.col("_mid") == F.col("_d"))).join(minima, "digest")
        mine = F.col("owner") == F.col("conv_id")
        search = settled(met.select(
            "conv_id", "size", F.when(mine, F.col("_low")).otherwise(F.col("_mid") + 1).alias("_low"), F.when(mine, F.col("_mid")).otherwise(F.col("_high")).alias("_high"),
            F.when(mine, F.col("_parent")).otherwise(F.col("owner")).alias("_parent"),
        ))
        found = found.union(search.filter("_low = _high"))
    return settled(found.select("conv_id", "size", F.col("_low").alias("first"), "_parent"))


def totals(chains: DataFrame) -> DataFrame:
    """chains: conv_id, _parent (null: none), saved, leaves of the chain itself. The same with those of all chains below it added."""
    level = settled(chains.select("conv_id", F.col("_parent").alias("_up"), "saved", "leaves"))
    while level.filter("_up IS NOT NULL").limit(1).count():
        below = level.filter("_up IS NOT NULL").groupBy(F.col("_up").alias("_c")).agg(F.sum("saved").alias("_saved"), F.sum("leaves").alias("_leaves"))
        further = level.filter("_up IS NOT NULL").select(F.col("conv_id").alias("_p"), F.col("_up").alias("_next"))
        met = level.join(below, F.col("conv_id") == F.col("_c"), "left").join(further, F.col("_up") == F.col("_p"), "left")
        level = settled(met.select("conv_id", F.col("_next").alias("_up"), *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in ("saved", "leaves")]))
    return level.drop("_up")


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by digest and piece: each digest with the hash of its joined pieces. The hash is carried over from batch to batch."""
    now, state = None, None
    for batch in batches:
        digests, hashes = [], []
        for digest, ids in zip(batch["digest"].to_pylist(), batch["ids"].to_pylist()):
            if digest != now:
                if state is not None:
                    digests.append(now)
                    hashes.append(state.hexdigest())
                now, state = digest, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_pydict({"_digest": pa.array(digests, pa.binary()), "ends_sha256": pa.array(hashes, pa.string())})
    if state is not None:
        yield pa.RecordBatch.from_pydict({"_digest": pa.array([now], pa.binary()), "ends_sha256": pa.array([state.hexdigest()], pa.string())})


def ends(rows: DataFrame) -> DataFrame:
    """rows (digest, conv_id): _digest and ends_sha256, the SHA-256 of its ids in ascending order, joined by commas."""
    pieces = rows.groupBy("digest", F.shiftright("conv_id", PIECE_BITS).alias("_piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("_ids"))
    pieces = pieces.select("digest", "_piece", F.array_join(F.transform("_ids", lambda x: x.cast("string")), ",").alias("ids"))
    ordered = pieces.repartition("digest").sortWithinPartitions("digest", "_piece").select("digest", "ids")
    return ordered.mapInArrow(_hash_pieces, "_digest binary, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """turns: conv_id, depth (from 1, no gaps), _turn, words; convs: every conv_id once. One row per node, the root among them."""
    top = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    root, members = (top[0], top[1]) if top[1] else (None, 0)
    rows = settled(prefixes(turns))
    minima = settled(rows.groupBy("digest").agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs")))
    search = first_owned(rows, minima, convs)
    is_root = F.col("conv_id").eqNullSafe(F.lit(root).cast("long"))
    above = F.when(~is_root, F.coalesce("_parent", F.lit(root).cast("long")))  # nothing shared with a smaller one: it hangs from the root
    chains = settled(search.filter((F.col("first") <= F.col("size")) | is_root).select("conv_id", "size", F.when(is_root, 0).otherwise(F.col("first")).alias("first"), above.alias("_parent")))

    own = chains.select(F.col("conv_id").alias("_c"), "first", "size", "_parent")
    nodes = rows.join(own, F.col("conv_id") == F.col("_c")).filter("depth >= first").join(minima.drop("owner"), "digest")
    nodes = nodes.select("digest", "conv_id", "depth", "n_convs", "first", "size", "_parent", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    rooted = chains.filter(is_root).select(F.lit(ROOT).cast("binary").alias("digest"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(members).cast("long").alias("n_convs"), "first", "size", "_parent", F.lit(0).cast("long").alias("saved"))
    hung = chains.filter("_parent IS NOT NULL").groupBy(F.col("_parent").alias("_hc"), (F.col("first") - 1).alias("_hd")).agg(F.count(F.lit(1)).alias("_hung"))
    nodes = nodes.unionByName(rooted).join(hung, (F.col("conv_id") == F.col("_hc")) & (F.col("depth") == F.col("_hd")), "left").drop("_hc", "_hd")
    more = F.col("depth") < F.col("size")
    n_children = F.coalesce("_hung", F.lit(0)) + more.cast("long")
    nodes = settled(nodes.withColumn("n_children", n_children).withColumn("leaves", (F.col("n_children") == 0).cast("long")).drop("_hung"))

    each = nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), F.first("_parent").alias("_parent"))
    whole = settled(totals(each))
    # what hangs from a node counts there; a node's subtree is the whole of its chain less what comes before it
    hangs = whole.join(own, F.col("conv_id") == F.col("_c")).filter("_parent IS NOT NULL").groupBy(F.col("_parent").alias("_hc"), (F.col("first") - 1).alias("_hd")).agg(F.sum("saved").alias("_hs"), F.sum("leaves").alias("_hl"))
    met = nodes.join(hangs, (F.col("conv_id") == F.col("_hc")) & (F.col("depth") == F.col("_hd")), "left").drop("_hc", "_hd")
    met = met.withColumn("_at_s", F.col("saved") + F.coalesce("_hs", F.lit(0))).withColumn("_at_l", F.col("leaves") + F.coalesce("_hl", F.lit(0)))
    met = met.withColumn("_up_s", F.col("_at_s")).withColumn("_up_l", F.col("_at_l")).drop("_hs", "_hl", "saved", "leaves")
    summed = running(met, ["_up_s", "_up_l"])
    all_of = whole.select(F.col("conv_id").alias("_wc"), "saved", "leaves")
    summed = summed.join(all_of, F.col("conv_id") == F.col("_wc"))

    last = search.select(F.col("conv_id").alias("_c"), "size")
    ended = rows.join(last, (F.col("conv_id") == F.col("_c")) & (F.col("depth") == F.col("size"))).select("digest", "conv_id")
    ended = ended.union(search.filter("size = 0").select(F.lit(ROOT).cast("binary"), "conv_id"))
    summed = summed.join(ends(ended), F.col("digest") == F.col("_digest"), "left")
    return summed.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("first"), F.col("conv_id")).otherwise(F.col("_parent")).alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaves") - F.col("_up_l") + F.col("_at_l")).alias("n_leaves"), (F.col("saved") - F.col("_up_s") + F.col("_at_s")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as they are (conv_id, turn, role, text)."""
    turns = turn_rows(conversations)
    return trie(turns, settled(turns.select("conv_id").distinct()))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations after ``rebuilt``."""
    turns, convs = rebuilt(turn_rows(conversations))
    return trie(turns, convs)
