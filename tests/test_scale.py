"""Groups and plans that must hold at size, and order-dependent rules against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import cluster, genotype, groups, hmm, interval_join, matching
from strandline.plans import interval_queries
from tests.test_engine import brute_clusters

OBSERVATIONS = "obs long, chrom1 long, start1 long, end1 long, dir1 long, chrom2 long, start2 long, end2 long, dir2 long, evidence long, qname long"


def test_a_long_chain_falls_into_many_groups(spark):
    """First ends 100 bases apart form one chain; second ends tell its parts apart, and the result is that of one pass."""
    r = random.Random(5)
    rows = [(i, 1, 100 * i, 100 * i + 1, 0, 1, p, p + 1, 1, 0, i) for i in range(4000) for p in [r.randrange(0, 8) * 40_000 + r.randrange(300) + 37 * (i // 40)]]
    df = spark.createDataFrame(rows, OBSERVATIONS)
    keys = ["dir1", "dir2", "chrom1", "chrom2"]
    islands = cluster.with_islands(df, keys)
    assert islands.select("island").distinct().count() == 1
    parts = cluster.split_islands(islands, [*keys, "island"], 500).groupBy("part2", "part1").count().collect()
    assert len(parts) > 50 and max(p["count"] for p in parts) < 800
    found = cluster.breakpoint_clusters(df).collect()
    names = [c.split()[0] for c in OBSERVATIONS.split(", ")]
    assert sorted((c["chrom1"], c["start1"], c["end1"], c["chrom2"], c["start2"], c["end2"], c["evidence"], c["first_obs"]) for c in found) == brute_clusters([dict(zip(names, x)) for x in rows])


def test_groups_are_streams_of_exact_numbers(spark):
    """Keys with nulls are one group each, numbers keep their digits, and a large group isn't held."""
    rows = [(None, i, None) for i in range(5)] + [(1, i, 9007199254740993) for i in range(20_000)]
    df = spark.createDataFrame(rows, "k long, i long, v long")

    def visit(own):
        assert not isinstance(own, list)
        n, last = 0, None
        for row in own:
            n, last = n + 1, row["v"]
        yield n, last

    assert sorted(map(str, map(tuple, groups.per_group(df, ["k"], ["i"], visit, "n long, v long").collect()))) == ["(20000, 9007199254740993)", "(5, None)"]


def test_a_chromosome_long_interval_writes_few_rows(spark):
    wide = spark.createDataFrame([(1, 0, 250_000_000, 7)], "chrom long, start long, end long, id long")
    short = spark.range(0, 250_000_000, 250_000).selectExpr("1L AS chrom", "id AS start", "id + 90 AS end", "id AS read")
    levels = interval_join._own_levels(short, "start", "end", 0, 1000)
    assert interval_join._bucketed(wide, "_r_", "start", "end", 0, 1000, levels).count() <= 2
    levels = interval_join._own_levels(wide, "start", "end", 0, 1000)
    assert interval_join._bucketed(short, "_l_", "start", "end", 0, 1000, levels).count() <= 4 * 1000
    assert interval_join.interval_join(short, wide).count() == 1000
    assert interval_join.point_join(short.withColumnsRenamed({"start": "pos", "end": "_"}), wide).count() == 1000


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_shared_sweeps_are_settled(spark, sf_dir):
    assert scans(interval_queries.regions_over_depth(spark, sf_dir)) <= 1
    assert scans(interval_queries.gc_correction(spark, sf_dir)) <= 4


def brute_sync(segs, cells, haploid, most_shift, factor=0.5):
    """The rule over plain dicts. segs: {sample: [[begin, end, state], ...]}; cells: {(sample, bin): (depth, kind)}."""
    emission = {k: hmm.emissions(np.array([d]), np.ones(1), haploid)[0] for k, (d, _) in cells.items()}
    steps = {k: hmm.transitions(k) for k in range(3)}
    out = {s: [list(x) for x in own] for s, own in segs.items()}
    moves = {}
    for kind in (hmm.LOSS, hmm.GAIN):
        edges = defaultdict(list)
        for s, own in segs.items():
            for a, b in zip(own, own[1:]):
                if hmm.UNKNOWN not in (a[2], b[2]) and (hmm.LOSS if a[2] > b[2] else hmm.GAIN) == kind:
                    edges[b[0]].append((s, a[2], b[2]))
        places, moves[kind] = sorted(edges), []
        clusters = []
        for p in places:
            if clusters and p - clusters[-1][-1] <= most_shift:
                clusters[-1].append(p)
            else:
                clusters.append([p])
        for own in clusters:
            scores = []
            for a in own:
                for b in own:
                    if a != b:
                        total = 0.0
                        for s, left, right in edges[a]:
                            for x in range(min(a, b), max(a, b)):
                                if (s, x) in emission:
                                    e = emission[s, x]
                                    total += 0.02 * ((e[left] - e[right]) if a < b else (e[right] - e[left])) if np.isfinite(e[left]) and np.isfinite(e[right]) else -np.inf
                            tag = lambda x: cells[s, x][1] if (s, x) in cells else 0  # noqa: E731, B023
                            total += factor * steps[tag(b)][left, right] - steps[tag(a)][left, right]
                        scores.append((round(total / len(edges[a]), 9), a, b))
            left_, entered = set(), set()
            for score, a, b in sorted(scores, reverse=True):
                if score > 0 and a not in left_ and b not in left_ and a not in entered:
                    left_.add(a)
                    entered.add(b)
                    moves[kind].append((a, b))
    for kind in (hmm.LOSS, hmm.GAIN):
        for a, b in sorted(moves[kind]):
            for s, own in segs.items():
                for i in range(1, len(own)):
                    if own[i][0] == a and hmm.UNKNOWN not in (own[i - 1][2], own[i][2]) and (hmm.LOSS if own[i - 1][2] > own[i][2] else hmm.GAIN) == kind and out[s][i - 1][0] < b < out[s][i][1]:
                        out[s][i - 1][1] = out[s][i][0] = b
    return out


@pytest.mark.parametrize("seed", range(3))
def test_boundaries_sync_by_brute_force(spark, seed):
    r = random.Random(seed)
    segs, cells = {}, {}
    for s in range(4):
        cuts = sorted({0, 60, *[min(59, max(1, 10 * k + r.randint(-3, 3))) for k in range(1, 6)]})
        own, last = [], -1
        for a, b in zip(cuts, cuts[1:]):
            last = r.choice([x for x in (1, 2, 3, 6) if x != last])
            own.append((a, b, last))
        segs[s] = own
        for a, b, state in own:
            for x in range(a, b):
                cells[s, x] = (None if r.random() < 0.05 else max(0.0, 5.0 * min(state, 3) + r.uniform(-4, 4)), r.choice((0, 0, 0, 1, 2)))
    depth = {k: (float("nan") if d is None else d, t) for k, (d, t) in cells.items()}
    want = sorted((s, *x) for s, own in brute_sync(segs, depth, 5.0, 5).items() for x in own)
    a = spark.createDataFrame([(s, 0, *x) for s, own in segs.items() for x in own], "sample long, chrom long, begin long, end long, state long")
    b = spark.createDataFrame([(s, 0, x, d, 1.0, t) for (s, x), (d, t) in cells.items()], "sample long, chrom long, bin long, depth double, reduction double, kind long")
    h = spark.createDataFrame([(s, 5.0) for s in range(4)], "sample long, haploid double")
    found = hmm.sync_boundaries(a, b, h, 5)
    assert sorted((x["sample"], x["begin"], x["end"], x["state"]) for x in found.collect()) == want
    assert want != sorted((s, *x) for s, own in segs.items() for x in own)


def test_reserved_counts_by_brute_force(spark):
    r = random.Random(8)
    rows = []
    for g in range(6):
        for s in range(2):
            for place, sv in enumerate(r.sample(range(10 * g, 10 * g + 3), 3)):
                blocked, shared = r.random() < 0.2, r.random() < 0.2
                rows += [(g, s, place, sv, place % 2, r.choice((None, 0, 1)), shared, f"r{q}", r.choice((0, 1, 2)), r.random() < 0.2, genotype.BLOCKED if blocked else genotype.NATIVE) for q in r.sample(range(8), 5)]
    for passes in (1, 2):
        want = {}
        for g, s in sorted({x[:2] for x in rows}):
            held = {}
            for _ in range(passes):
                counts, best = defaultdict(lambda: [0, 0, 0]), 0
                for x in sorted((x for x in rows if x[:2] == (g, s)), key=lambda x: (x[2], x[3], x[7])):
                    _, _, _, sv, own, other, shared, q, allele, tie, relation = x
                    if relation == genotype.BLOCKED:
                        continue
                    hap = {0: None, 1: own, 2: other}[allele]
                    if allele and not tie and not shared:
                        if hap is None or held.setdefault(q, hap) != hap:
                            continue
                    counts[sv][1 if allele == 2 and shared else allele] += 1
                best = max((sum(c) for c in counts.values()), default=0)
            for x in rows:
                if x[:2] == (g, s):
                    want[x[3], s] = (best, 0, 0) if x[10] == genotype.BLOCKED else tuple(counts[x[3]])
        df = spark.createDataFrame(rows, "group long, sample long, place long, sv long, haplotype long, other long, shared boolean, qname string, allele long, tie boolean, relation long")
        assert {(c["sv"], c["sample"]): (c["ref"], c["alt"], c["overlap"]) for c in genotype.reserved_counts(df, passes).collect()} == want


def test_a_lost_variant_does_not_win_later(spark):
    """SV 1 loses the first CNV to SV 2, so it doesn't take the second one, though no other variant is there."""
    svs = spark.createDataFrame([(1, "DEL", 0, 1000, 101_000), (2, "DEL", 0, 1100, 101_100)], "sv long, kind string, chrom long, start long, end long")
    cnvs = spark.createDataFrame([(10, 0, 1200, 101_200), (11, 0, 900, 92_900)], "cnv long, chrom long, start long, end long")
    calls = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (2, 0, 1), (2, 2, 1), (1, 2, None), (2, 1, None)], "sv long, sample long, gt long")
    states = spark.createDataFrame([(10, 0, 1, 2), (10, 2, 1, 2), (11, 1, 1, 2)], "cnv long, sample long, copies long, expected long")
    found = sorted((m["sv"], m["cnv"], m["fits"]) for m in matching.sv_cnv_match(svs, cnvs, calls, states, 9000).collect())
    assert found == [(2, 10, 2)]


def test_allele_rules(spark):
    """Ties, reserved haplotypes, negative scores and the first untied condition."""
    rows = [
        ("plain", 0, 0, 0.2, None, True), ("plain", 0, 1, 0.9, None, True),
        ("ref only", 0, 0, 0.9, None, True), ("ref only", 0, 1, 0.2, None, True),
        ("low alt first", 0, 0, 0.9, None, True), ("low alt first", 0, 1, 0.8, None, True), ("low alt first", 1, 0, 0.1, None, True), ("low alt first", 1, 1, 0.3, None, True),
        ("negative", 0, 0, -0.5, None, True), ("negative", 0, 1, -0.2, None, True), ("negative", 1, 0, 0.9, None, True), ("negative", 1, 1, 0.1, None, True),
        ("tie resolved", 0, 0, 0.5, None, True), ("tie resolved", 0, 1, 0.5, None, True), ("tie resolved", 1, 0, 0.1, None, True), ("tie resolved", 1, 1, 0.4, None, True),
        ("overlap by place", 0, 0, 0.1, None, False), ("overlap by place", 0, 1, 0.5, None, False), ("overlap by place", 0, 2, 0.5, None, False),
        ("alt by reserve", 0, 0, 0.1, 1, False), ("alt by reserve", 0, 1, 0.5, 1, False), ("alt by reserve", 0, 2, 0.5, 1, False),
    ]
    df = spark.createDataFrame(rows, "read string, condition long, allele long, score double, reserved long, alt_on_top boolean")
    found = {r["read"]: (r["allele"], r["condition"], r["tie"]) for r in genotype.best_alleles(df).collect()}
    assert found == {"plain": (1, 0, False), "ref only": (0, 0, False), "low alt first": (1, 1, False), "tie resolved": (1, 1, False), "overlap by place": (2, 0, True), "alt by reserve": (1, 0, True)}
