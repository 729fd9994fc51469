"""Rules that tie a sample's haplotypes together, by brute force; and a planted second haplotype that only joint calling finds."""

import random
from collections import defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strandline.operators import genotype, matching, pools
from strandline.plans import pipelines
from strandline.settings import DiscoverSettings, JointCallSettings

CALLS = "group long, sample long, sv long, rank long, start long, end long, ref long, alt long, overlap long, haploid boolean, replicated boolean"


def random_calls(n=400):
    r = random.Random(2)
    out = []
    for sv in range(n):
        start = r.randrange(200)
        for sample in range(2):
            hom = r.random() < 0.4
            out.append((sv // 12, sample, sv, r.choice([0, 0, 1, 1, None]), start, start + r.randrange(1, 60), 0 if hom else r.randrange(9), r.randrange(2, 9), r.randrange(3) if not hom else 0, False, r.random() < 0.1))
    return out


def test_absorbed_overlaps(spark):
    rows = spark.createDataFrame(random_calls(), CALLS)
    before = {(c["sv"], c["sample"]): c for c in genotype.genotypes(rows).collect()}
    want = {}
    for key, c in before.items():
        top = c["rank"] == 0 and c["gt"] == 2 and not c["replicated"]
        beaten = c["rank"] == 1 and any(o["rank"] == 0 and o["gt"] == 2 and not o["replicated"] and o["group"] == c["group"] and o["sample"] == c["sample"] and o["start"] < c["end"] and c["start"] < o["end"] for o in before.values())
        want[key] = (c["ref"] + c["alt"] + c["overlap"], 0, 0, True) if beaten else (c["ref"], c["alt"] + c["overlap"], 0, False) if top else (c["ref"], c["alt"], c["overlap"], False)
    got = genotype.absorb_overlaps(genotype.genotypes(rows)).collect()
    assert {(c["sv"], c["sample"]): (c["ref"], c["alt"], c["overlap"], c["gt_excluded"]) for c in got} == want
    assert sum(w[3] for w in want.values()) > 20
    # the genotypes are those of the new counts
    again = genotype.genotypes(spark.createDataFrame(got).select("sv", "sample", "ref", "alt", "overlap", "haploid")).collect()
    assert {(c["sv"], c["sample"], c["gt"], c["gq"], c["pl0"]) for c in got} == {(c["sv"], c["sample"], c["gt"], c["gq"], c["pl0"]) for c in again}
    assert {c["gt"] for c in got if c["gt_excluded"]} == {0}


def test_wide_group_meets_by_buckets(spark):
    """20,000 variants of each haplotype in one group and sample: ranges meet through buckets, not in pairs."""
    rows = spark.range(40_000).selectExpr("0L AS group", "0L AS sample", "id AS sv", "id % 2 AS rank", "(id div 2) * 1000 + (id % 2) * 400 * (id div 2 % 2) AS start", "0L AS ref", "5L AS alt", "0L AS overlap", "false AS haploid").withColumn("end", F.col("start") + 300)
    got = genotype.absorb_overlaps(genotype.genotypes(rows)).groupBy("gt_excluded").count().collect()
    assert {r["gt_excluded"]: r["count"] for r in got} == {True: 10_000, False: 30_000}


def test_resolved_replicates(spark):
    r = random.Random(4)
    rows = [(g, g * 8 + i, i, s, r.random() < 0.7, 1 + s % 2, r.randrange(50), r.randrange(50), r.randrange(50), r.randrange(3)) for g in range(12) for i in range(8) for s in range(4)]
    spots = {x[1]: x[9] for x in rows}
    rows = [(*x[:9], spots[x[1]]) for x in rows]
    want = {(x[1], x[3]): [x[6], x[7], x[8], False, False, False] for x in rows}
    by = defaultdict(list)
    for x in sorted(rows, key=lambda x: x[2]):
        by[x[0], x[9], x[3]].append(x)
    for same in by.values():
        carried = [x for x in same if x[4] and x[5] >= 2]
        for k, x in enumerate(carried):
            want[x[1], x[3]][3:5] = [len(carried) > 1, k > 0]
        for x in same[1:]:  # in order, the last one given wins
            want[x[1], x[3]][5] = True
            if x[4] and not want[x[1], x[3]][4]:
                want[same[0][1], x[3]][:3] = x[6:9]
    got = pools.resolve_replicates(spark.createDataFrame(rows, "group long, sv long, place long, sample long, carried boolean, haplotypes long, ref long, alt long, overlap long, spot long"), ["spot"])
    assert {(x["sv"], x["sample"]): [x[c] for c in ("ref", "alt", "overlap", "on_several", "within_replicate", "replicated")] for x in got.collect()} == want


def test_excluded_only_if_every_carrier_is(spark):
    rows = [(1, 0, True, True), (1, 1, True, False), (2, 0, True, True), (2, 1, False, False), (3, 0, False, True), (4, 0, True, False)]
    got = genotype.gt_excluded(spark.createDataFrame(rows, "sv long, sample long, carried boolean, gt_excluded boolean"))
    assert {(r["sv"], r["all_excluded"]) for r in got.collect()} == {(1, False), (2, True), (3, False), (4, False)}


POINT = "id long, chrom long, start long, end long, dir long, next1 long, side1 long, next2 long, side2 long"


@pytest.mark.parametrize(
    ("first", "second", "pairs"),
    [
        ((None,) * 4, (None,) * 4, True),
        ((2, 1, None, None), (None,) * 4, False),  # the first ends follow each other on one haplotype
        ((2, 2, None, None), (None,) * 4, True),
        ((None, None, 2, 2), (None,) * 4, False),
        ((None, None, 2, 1), (None,) * 4, True),
        ((9, 1, None, None), (None,) * 4, True),  # a neighbour from elsewhere matters to long ones only
    ],
)
def test_neighbours_veto_inversions(spark, first, second, pairs):
    short = [(1, 0, 1000, 9000, 0, *first), (2, 0, 1100, 9100, 1, *second)]
    assert matching.inversions(spark.createDataFrame(short, POINT)).count() == int(pairs)
    long = [(1, 0, 1000, 150_000, 0, *first), (2, 0, 1100, 150_100, 1, *second)]
    assert matching.inversions(spark.createDataFrame(long, POINT)).count() == int(pairs and first[0] != 9)


def test_conflicting_genotypes_reach_the_record(spark):
    """One of three samples agrees: the inversion's record says so, its breakpoints don't."""
    pairs = spark.createDataFrame([(0, 1, 2, 1000, 9100)], "chrom long, id1 long, id2 long, start long, end long")
    calls = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (1, 2, None), (2, 0, 1), (2, 1, 2), (2, 3, 1)], "id long, sample long, gt long")
    told = matching.genotype_conflicts(pairs, calls)
    assert [r["conflicting"] for r in told.collect()] == [True]
    assert [r["conflicting"] for r in matching.genotype_conflicts(pairs, calls.filter("sample = 0")).collect()] == [False]
    assert [r["conflicting"] for r in matching.genotype_conflicts(pairs, calls.limit(0)).collect()] == [False]
    svs = spark.createDataFrame([(i, "BND", 0, 1000, 0, 0, 9000, 0, 50.0, False, False) for i in (1, 2)], "sv long, kind string, chrom1 long, start1 long, dir1 long, chrom2 long, start2 long, dir2 long, qual double, over_depth boolean, replicated boolean")
    filters = {(r["kind"], r["filter"]) for r in pipelines.joint_records(svs, told, None, JointCallSettings(dedup=False)).collect()}
    assert filters == {("BND", "InvBreakpoint"), ("INV", "ConflictingBreakpointGT")}


def test_second_haplotype_from_one_read(spark):
    """Two deletions with one start: sample 0 has clusters of both, sample 1 of the shorter one and a single read of the longer one."""
    rows = []

    def read(sample, name, cigar, end, begin=7000):
        rows.append((sample, name, 0, 1, begin, end, 0, 60, 0, cigar))

    for i in range(4):
        read(0, f"a{i}", f"{3000 - i}=300D{2700 + i}=", 13_000 + 0, 7000 + i)
        read(0, f"b{i}", f"{3000 - i}=600D{2400 + i}=", 13_000 + 0, 7000 + i)
        read(1, f"c{i}", f"{3000 - i}=300D{2700 + i}=", 13_000 + 0, 7000 + i)
        read(2, f"e{i}", f"{6000 - i}=", 13_000 + 0, 7000 + i)
    read(1, "d", "2990=600D2410=", 13_000, 7010)
    reads = spark.createDataFrame(rows, "sample long, qname string, seg long, chrom long, start long, end long, strand long, mapq long, flag long, cigar string")
    stage = pipelines.discover(reads, settings=replace(DiscoverSettings(), cluster_distance=100, disable_cnv=True, disable_large_insertions=True))
    assert {(c["sample"], c["start2"] - c["start1"]) for c in stage["clusters"].collect()} == {(0, 300), (0, 600), (1, 300)}
    found = pipelines.joint_call(reads, stage, JointCallSettings(disable_cnv=True))
    ends = {int(r["id"]): r["end"] - r["pos"] for r in found["records"].collect()}
    calls = {(c["sample"], ends[c["sv"]]): c for c in found["calls"].collect()}
    assert calls[1, 600]["carried"] and calls[1, 600]["alt"] == 1 and calls[1, 600]["gt"] == 1 and calls[1, 300]["gt"] == 1
    assert not calls[2, 600]["carried"] and calls[2, 600]["gt"] == calls[2, 300]["gt"] == 0
    assert calls[0, 300]["gt"] == calls[0, 600]["gt"] == 1
    alone = pipelines.joint_call(reads, {k: v for k, v in stage.items() if k != "evidence"}, JointCallSettings(disable_cnv=True))
    assert {c["alt"] for c in alone["calls"].filter(F.col("sample") == 1).collect() if ends[c["sv"]] == 600} == {0}


def test_close_members_merge_by_brute_force(spark):
    """Each remaining member in turn takes in later ones: the same groups as the stream's."""
    r = random.Random(8)
    rows = [(i % 5, i, r.randrange(6), r.randrange(120), 500 + r.randrange(60), 100 + r.randrange(4), r.randrange(9), r.randrange(5)) for i in range(600)]
    want = {}
    for pool in range(5):
        own = sorted((x for x in rows if x[0] == pool), key=lambda x: (x[3], x[4], x[2], x[1]))
        taken = set()
        for k, a in enumerate(own):
            if a[1] in taken:
                continue
            group, samples = [a], {a[2]}
            for b in own[k + 1 :]:
                if b[1] not in taken and b[2] not in samples and b[3] - a[3] <= 10 and abs(b[4] - a[4]) <= 10 and 2 * abs(a[5] - b[5]) <= 0.01 * (a[5] + b[5]):
                    group.append(b)
                    samples.add(b[2])
                    taken.add(b[1])
            best = group[0]
            for b in group[1:]:
                best = b if (b[6], b[7]) > (best[6], best[7]) else best
            want |= {b[1]: best[1] for b in group}
    df = spark.createDataFrame(rows, "pool long, id long, sample long, start long, end long, size long, reads long, contig_length long")
    assert {x["id"]: x["merged_id"] for x in pools.merge_close(df).collect()} == want
    assert len(set(want.values())) < len(want)


def test_a_pool_of_many_members_streams(spark):
    """30,000 members of one pool, all at one place, of as many samples: one group."""
    df = spark.range(30_000).selectExpr("0L AS pool", "id", "id AS sample", "id % 3 AS start", "500L AS end", "100L AS size", "id % 7 AS reads", "0L AS contig_length")
    assert pools.merge_close(df).select("merged_id").distinct().count() == 1
