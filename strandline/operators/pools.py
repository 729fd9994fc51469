"""Pooling of near-duplicate candidates across samples, merging within pools, remapping of their ids."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import sweep
from .groups import per_group
from .interval_join import point_join

POOL_MARGIN, CLOSE, SIZE_RATIO, SHARED = 100, 10, 0.01, 0.5
#: What a deletion counts for in a variant's size, at most, and what stands in for it in other variants.
MOST_DELETED, NO_DELETION = 500, 100


def leader_pools(candidates: DataFrame, margin: int = 0, keys: tuple[str, ...] = ("chrom",)) -> DataFrame:
    """candidates (keys, start, end, sample, id) of all samples in one order: a pool grows while they overlap its first member
    (widened by ``margin``). Adds pool, the first member's id. Runs within islands: chains of overlapping candidates."""
    spans = candidates.select(*keys, (F.col("start") - margin).alias("start"), F.col("end"))
    islands = sweep.union(spans, margin, keys).withColumn("end", F.col("end") + margin)
    points = candidates.select(*keys, F.col("start").alias("_s"), F.col("end").alias("_e"), "sample", "id").withColumn("_pos", F.col("_s"))
    placed = point_join(points, islands, "_pos", keys, bucket=10_000).select(*keys, "_s", "_e", "sample", "id", F.col("start").alias("island"))
    kinds = ", ".join(f"{k} long" for k in keys) + ", start long, end long, sample long, id long, pool long"

    def pool(island: Iterable[dict]) -> Iterator[tuple]:
        leader = None
        for r in island:
            s, e = r["_s"], r["_e"]
            if leader is None or not (leader[0] - margin < e and s < leader[1] + margin):
                leader = (s, e, r["id"])
            yield *[r[k] for k in keys], s, e, r["sample"], r["id"], leader[2]

    return per_group(placed, [*keys, "island"], ["_s", "_e", "sample", "id"], pool, kinds)


def merge_equal(pooled: DataFrame, same: list[str]) -> DataFrame:
    """Members of a pool that agree in ``same`` merge: adds merged_id, the representative's (most reads, longest contig, first id).

    Needs columns pool, id, reads, contig_length.
    """
    order = Window.partitionBy("pool", *same).orderBy(F.desc("reads"), F.desc("contig_length"), "id")
    return pooled.withColumn("merged_id", F.first("id").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def merge_size(inserted: Column, deleted: Column) -> Column:
    """The size by which merging compares variants: inserted bases and a bounded number of deleted ones (null: no indel)."""
    return F.coalesce(inserted, F.lit(0)) + F.least(F.coalesce(deleted, F.lit(NO_DELETION)), F.lit(MOST_DELETED))


def merge_close(pooled: DataFrame, close: int = CLOSE, ratio: float = SIZE_RATIO, shared: float = SHARED) -> DataFrame:
    """Members of a pool with close ends and nearly equal sizes merge greedily; members of one sample never do.

    pooled (pool, id, sample, start, end, size, reads, contig_length): (id, merged_id). In order, each member joins the first of those
    before it that head a group, are close to it and whose group lacks its sample; else it heads one. A pool is read as a stream: only heads
    that a later member can still join are held, by their ends, with the names of their members.

    With a column ``words`` (``allele_words.novel_words`` of a member's contig; null without a contig) a member must also share that part of the
    smaller one of its and the head's words, so that equal places with other inserted bases stay apart.
    """
    named = "words" in pooled.columns

    def alike(head: dict, words: frozenset | None) -> bool:
        own = head["words"]
        return own is None or words is None or len(own & words) >= shared * min(len(own), len(words))

    def merge(pool: Iterable[dict]) -> Iterator[tuple]:
        heads: dict[int, list[dict]] = {}  # by stretch of the end, each in order
        waiting: deque[dict] = deque()
        number = 0

        def leave(head: dict) -> Iterator[tuple]:
            own = heads[head["at"]]
            own.remove(head)
            if not own:
                del heads[head["at"]]
            yield from ((i, head["best"][2]) for i in head["members"])

        for r in pool:
            while waiting and r["start"] - waiting[0]["start"] > close:
                yield from leave(waiting.popleft())
            at = r["end"] // (close + 1)
            near = (h for k in (at - 1, at, at + 1) for h in heads.get(k, ()))
            fits = [h for h in near if r["sample"] not in h["samples"] and abs(h["end"] - r["end"]) <= close and 2 * abs(h["size"] - r["size"]) <= ratio * (h["size"] + r["size"])]
            words = frozenset(r["words"]) if named and r["words"] is not None else None
            head = next((h for h in sorted(fits, key=lambda h: h["number"]) if alike(h, words)), None)
            if head is not None:
                head["samples"].add(r["sample"])
                head["members"].append(r["id"])
                if (r["reads"], r["contig_length"]) > head["best"][:2]:
                    head["best"] = (r["reads"], r["contig_length"], r["id"])
            else:
                head = {"start": r["start"], "end": r["end"], "size": r["size"], "samples": {r["sample"]}, "members": [r["id"]], "best": (r["reads"], r["contig_length"], r["id"]), "number": number, "at": at, "words": words}
                number += 1
                heads.setdefault(at, []).append(head)
                waiting.append(head)
        for head in waiting:
            yield from ((i, head["best"][2]) for i in head["members"])

    return per_group(pooled, ["pool"], ["start", "end", "sample", "id"], merge, "id long, merged_id long")


def merge_stats(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count(F.lit(1)).alias("before"), F.countDistinct("merged_id").alias("after"))


def remap(links: DataFrame, mapping: DataFrame, column: str) -> DataFrame:
    """Ids in ``column`` replaced by what they were merged into; those without a mapping stay."""
    return links.join(mapping.select(F.col("id").alias(column), F.col("merged_id").alias("_to")), column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def groups_by_cluster(svs: DataFrame) -> DataFrame:
    """svs (cluster, assembly, id): haplotypes and members of each cluster: (cluster, haplotypes, members)."""
    haplotypes = F.sort_array(F.collect_set("assembly"))
    return svs.groupBy("cluster").agg(F.size(haplotypes).cast("long").alias("haplotypes"), F.concat_ws(",", F.transform(F.sort_array(F.collect_list("id")), lambda x: x.cast("string"))).alias("members"))


def resolve_replicates(calls: DataFrame, key: list[str]) -> DataFrame:
    """calls (group, sv, place, sample, carried, haplotypes, ref, alt, overlap, and the columns ``key`` that equal variants share): one row
    per variant and sample of a group; place is the variant's in the group.

    Of a group's equal variants the first by place stands for all; the others are ``replicated``. In a sample of two haplotypes or more
    that carries several of them, each is ``on_several`` and all but the first are ``within_replicate``. The one that stays has, in each
    sample, the counts of the last other one that the sample carries without being a replicate there, if there is such a one.
    """
    alike = ["group", *key]
    carried = F.col("carried") & (F.col("haplotypes") >= 2)
    in_sample = Window.partitionBy(*alike, "sample")
    so_far = in_sample.orderBy("place", "sv").rowsBetween(Window.unboundedPreceding, -1)
    marked = calls.withColumn("_first", F.first("sv").over(in_sample.orderBy("place", "sv").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    marked = marked.withColumn("on_several", carried & (F.count_if(carried).over(in_sample) > 1)).withColumn("within_replicate", carried & (F.coalesce(F.count_if(carried).over(so_far), F.lit(0)) > 0))
    marked = marked.withColumn("replicated", F.col("sv") != F.col("_first"))
    gives = F.col("replicated") & F.col("carried") & ~F.col("within_replicate")
    counts = ("ref", "alt", "overlap")
    moved = F.max_by(F.struct(*counts), F.when(gives, F.struct("place", "sv"))).over(in_sample)
    marked = marked.withColumn("_moved", moved)
    return marked.withColumns({c: F.when(F.col("replicated"), F.col(c)).otherwise(F.coalesce(F.col(f"_moved.{c}"), F.col(c))) for c in counts}).drop("_first", "_moved")
