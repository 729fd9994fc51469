"""Literal cases, oracles and brute force for the engine's own operators."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import cigar, intervals, prob, variants
from strandline.operators import align, cluster, evidence, genotype, hmm, interval_join, matching, pools, records, sweep
from strandline.plans import pipelines, registry
from strandline.settings import DiscoverSettings, JointCallSettings


def one(spark, **columns):
    row = spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()
    return row[0] if len(columns) == 1 else row


def lits(*values):
    return [F.lit(v) for v in values]


@pytest.mark.parametrize(("a", "b", "want"), [((1, 4), (6, 8), 2), ((6, 8), (8, 9), 0), ((6, 8), (7, 9), 0), ((6, 8), (1, 4), 2)])
def test_distance(spark, a, b, want):
    assert one(spark, d=intervals.distance(*lits(*a, *b))) == want


@pytest.mark.parametrize(("b", "want"), [((0, 1000), 0), ((500, 1500), 0.5), ((1000, 2000), 1), ((1500, 2500), 0.5), ((1500, 2000), 0.5), ((1990, 2000), 0.01)])
def test_reciprocal_overlap(spark, b, want):
    assert one(spark, d=intervals.reciprocal_overlap(*lits(1000, 2000, *b))) == pytest.approx(want)


def test_reciprocal_overlap_pads_short_spans(spark):
    assert one(spark, d=intervals.reciprocal_overlap(*lits(0, 10, 0, 10))) == pytest.approx(0.1)


@pytest.mark.parametrize(("text", "want"), [("chr2:1,000-2,000", ("chr2", 999, 2000)), ("chr2:1,000", ("chr2", 999, None)), ("chr2", ("chr2", 0, None)), ("HLA-DRB1*10:01:01:1000-2000", ("HLA-DRB1*10:01:01", 999, 2000))])
def test_region_strings(spark, text, want):
    name, start, end = intervals.parse_region(F.lit(text))
    assert tuple(one(spark, a=name, b=start, c=end)) == want
    assert one(spark, x=intervals.region_label(*lits("chr2", 10, 11))) == "chr2:11-11"


@pytest.mark.parametrize(("size", "most", "want"), [(100, 200, [(0, 100)]), (100, 49, [(0, 34), (34, 67), (67, 100)]), (0, 10, None)])
def test_tiles(spark, size, most, want):
    found = one(spark, t=intervals.tiles(F.lit(size), most))
    assert (found and [tuple(x) for x in found]) == want


def test_islands(spark):
    rows = spark.createDataFrame(list(enumerate([0, 1, 2, -1, 4, 5, 6, 7, 8, 9])), "i long, v long")
    assert sorted(map(tuple, sweep.islands(rows.withColumn("k", F.lit(0)), "i", F.col("v") >= 0, ("k",)).select("start", "end").collect())) == [(0, 3), (4, 10)]


def test_sliding_sum(spark):
    rows = spark.createDataFrame([(0, 100, 2), (0, 101, 2), (0, 102, 2), (0, 103, 4), (0, 200, 2)], "chrom long, pos long, count long")
    for block in (2, 7, 1000):
        assert {r["pos"]: r["window_sum"] for r in sweep.sliding_sum(rows, 3, block=block).collect()} == {100: 2, 101: 4, 102: 6, 103: 8, 200: 2}


@pytest.mark.parametrize("block", [3, 10, 10_000])
def test_depth_by_brute_force(spark, block):
    r = random.Random(block)
    spans = [(c, s, s + r.randint(1, 30)) for c in range(2) for s in (r.randint(0, 90) for _ in range(40))]
    df = spark.createDataFrame(spans, "chrom long, start long, end long")
    depth = {(c, p): sum(x == c and s <= p < e for x, s, e in spans) for c in range(2) for p in range(130)}
    want = [(c, p) for (c, p), n in sorted(depth.items()) if n > 7]
    found = sweep.regions_where(sweep.edges(df), lambda d: d > 7, block=block).collect()
    assert sorted((x["chrom"], p) for x in found for p in range(x["start"], x["end"])) == want
    assert len(found) == sum((c, p - 1) not in set(want) for c, p in want)
    bins = {(x["chrom"], x["bin"]): x["bases"] for x in sweep.depth_bins(df, 7).collect()}
    assert bins == {k: n for k in {(c, p // 7) for c, p in depth} if (n := sum(v for (c, p), v in depth.items() if (c, p // 7) == k))}


@pytest.mark.parametrize("bucket", [5, 50, 5000])
def test_interval_join_by_brute_force(spark, bucket):
    r = random.Random(1)
    make = lambda n, most: [(i, r.randint(0, 1), s, s + r.randint(0, most)) for i in range(n) for s in [r.randint(-20, 300)]]
    a, b = make(60, 40), make(60, 90)
    left, right = spark.createDataFrame(a, "i long, chrom long, start long, end long"), spark.createDataFrame(b, "j long, chrom long, start long, end long")
    for margin in (0, 9):
        found = sorted((x["i"], x["j"]) for x in interval_join.interval_join(left, right, bucket=bucket, margin=margin).collect())
        assert found == sorted((i, j) for i, c, s, e in a for j, d, t, f in b if c == d and s - margin < f and t < e + margin and t < f and s - margin < e + margin)


def test_cigar(spark):
    runs = cigar.parse(F.lit("5H3S10=2D4X3I6=7S"))
    got = one(spark, a=cigar.ref_length(runs), b=cigar.read_length(runs), c=cigar.leading_clip(runs), d=cigar.trailing_clip(runs), e=cigar.edit_distance(runs), f=cigar.render(cigar.compress(cigar.parse(F.lit("3=0D4=2I1I")))), g=cigar.clipped_read_length(runs), h=cigar.is_hard_clipped(runs))
    assert tuple(got) == (22, 33, 8, 7, 9, "7=3I", 38, True)
    assert [tuple(x) for x in one(spark, s=cigar.ref_segments(cigar.parse(F.lit("10M2D10M10D10M")), F.lit(100), 10))] == [(100, 122), (132, 142)]
    assert one(spark, s=cigar.render(cigar.edge_insertions_to_clips(cigar.parse(F.lit("3I5=2I4=6I"))))) == "3S5=2I4=6S"
    assert one(spark, s=cigar.closest_read_position(cigar.parse(F.lit("5=3D5=")), F.lit(100), F.lit(106))) == 4
    assert one(spark, s=cigar.closest_read_position(cigar.parse(F.lit("5=3D5=")), F.lit(100), F.lit(106), False)) == 5


def test_hard_clipped_ranges(spark):
    runs = cigar.parse(F.lit("5H3S10=4D10=2H"))
    of = lambda a, b: tuple(one(spark, a=x, b=y) for x, y in [cigar.hard_clipped_read_range(runs, F.lit(100), F.lit(a), F.lit(b))])[0]
    assert tuple(of(102, 108)) == (5, 11) and tuple(of(108, 116)) == (11, 15) and tuple(of(111, 113)) == (None, None)


def test_indels_fuse_neighbours(spark):
    found = one(spark, s=cigar.indels(cigar.parse(F.lit("9I10=20D30I10=50I")), F.lit(100), 25))
    assert [tuple(x) for x in found] == [(109, 130, 30)]


def test_probabilities(spark):
    assert one(spark, p=prob.phred(F.lit(0.001))) == pytest.approx(30)
    assert one(spark, p=prob.phred(F.lit(0.0))) == 3070
    assert one(spark, p=prob.ln_phred(F.lit(math.log(0.001)))) == pytest.approx(30)
    assert one(spark, p=F.exp(prob.log_sum(*lits(math.log(0.2), math.log(0.3))))) == pytest.approx(0.5)
    values = lits(*[math.log(x) for x in (0.001, 0.001, 0.002, 0.001)])
    got = prob.normalised(values)
    assert one(spark, a=got[0], b=got[2], c=prob.first_argmax(values)) == pytest.approx((0.2, 0.4, 2))
    assert one(spark, p=prob.complement(lits(0.9999999, 1e-7), 0)) == pytest.approx(1e-7)


def test_genotypes(spark):
    rows = spark.createDataFrame([(10, 0, 0, False), (5, 5, 0, False), (0, 10, 0, False), (3, 0, 2, True), (0, 0, 0, False)], "ref long, alt long, overlap long, haploid boolean")
    found = [tuple(r) for r in genotype.genotypes(rows).select("gt", "pl0", "pl1", "pl2", "gq").collect()]
    assert [f[0] for f in found] == [0, 1, 2, 0, None]
    assert found[0][1:] == (0, 30, 500, 30) and found[1][1:] == (220, 0, 220, 220) and found[3][2] == 999


def test_breakpoint_distance(spark):
    end = lambda c, s, d: lits(c, s, s + 1, d)
    one_way = variants.breakpoint_distance(end(0, 100, 0), end(0, 200, 1), end(0, 110, 0), end(0, 210, 1))
    other = variants.breakpoint_distance(end(0, 100, 0), end(0, 200, 1), end(0, 90, 0), end(0, 210, 1))
    assert one(spark, a=one_way, b=other) == (9, 18)
    assert one(spark, a=variants.breakpoint_distance(end(0, 1, 0), end(1, 1, 0), end(0, 1, 0), end(2, 1, 0))) is None


def test_breakend_strings(spark):
    parsed = variants.parse_bnd_alt(F.lit("TCT]chr1:500]"), F.lit(10))
    assert tuple(one(spark, **parsed)) == (0, 0, "chr1", 489, "CT")
    parsed = variants.parse_bnd_alt(F.lit("TCT]HLA-DRB1*10:01:01:500]"), F.lit(10))
    assert one(spark, **parsed)["mate_chrom"] == "HLA-DRB1*10:01:01"
    assert one(spark, s=variants.rev_comp(F.lit("ACGTN"))) == "NACGT"


def test_emissions():
    e = hmm.emissions(np.array([5.0, np.nan]), np.ones(2), 5.0)
    assert e[0, 2] == pytest.approx(-3.2745662778118154)
    assert e[1, hmm.UNKNOWN] == 0 and e[1, 0] == pytest.approx(math.log(0.5)) and e[0, hmm.UNKNOWN] == -math.inf
    for kind in (hmm.SAME, hmm.GAIN, hmm.LOSS):
        assert np.exp(hmm.transitions(kind)).sum(axis=1) == pytest.approx(np.ones(hmm.STATES))


def test_best_path_is_best():
    import itertools

    r = np.random.default_rng(0)
    for _ in range(5):
        e, kinds, begin = r.normal(size=(4, hmm.STATES)) * 20, r.integers(0, 3, 4), hmm.first_states(False, 2)
        steps = [hmm.transitions(k) for k in range(3)]
        score = lambda p: begin[p[0]] + e[0, p[0]] + sum(steps[kinds[t]][p[t - 1], p[t]] + 0.02 * e[t, p[t]] for t in range(1, 4))  # noqa: E731, B023
        assert score(hmm.best_path(e, kinds, begin)) == pytest.approx(max(map(score, itertools.product(range(hmm.STATES), repeat=4))))


def test_boundaries_meet(spark):
    """Two samples whose losses lie a bin apart, with depth that speaks for either: one moves onto the other."""
    cells = [(s, 0, b, 10.0 if b < 10 + s else 5.0, 1.0, 0) for s in range(2) for b in range(20)]
    bins = spark.createDataFrame(cells, "sample long, chrom long, bin long, depth double, reduction double, kind long")
    segs = spark.createDataFrame([(s, 0, a, b, c) for s in range(2) for a, b, c in ((0, 10 + s, 2), (10 + s, 20, 1))], "sample long, chrom long, begin long, end long, state long")
    haploid = spark.createDataFrame([(0, 5.0), (1, 5.0)], "sample long, haploid double")
    found = {(r["sample"], r["state"]): (r["begin"], r["end"]) for r in hmm.sync_boundaries(segs, bins, haploid, 5).collect()}
    assert found[0, 1][0] == found[1, 1][0] and found[0, 2][1] == found[0, 1][0]


def brute_clusters(rows, distance=500, least=2):
    """One pass over all rows in order, with no islands."""
    live = []
    for o in sorted(rows, key=lambda o: (o["start1"], o["end1"], o["start2"], o["end2"], o["evidence"], o["qname"], o["obs"])):
        near = [(d, i) for i, c in enumerate(live) if all(c[k] == o[k] for k in ("dir1", "dir2", "chrom1", "chrom2")) and (d := cluster._distance(c, o)) <= distance]
        if near:
            c = live[min(near)[1]]
        else:
            c = {k: o[k] for k in cluster.OBSERVATION} | {"evidence": 0, "qnames": [], "first_obs": o["obs"]}
            live.append(c)
        for i in "12":
            c[f"start{i}"], c[f"end{i}"] = min(c[f"start{i}"], o[f"start{i}"]), max(c[f"end{i}"], o[f"end{i}"])
        if o["qname"] not in c["qnames"]:
            c["qnames"].append(o["qname"])
            c["evidence"] += 1
    return sorted((c["chrom1"], c["start1"], c["end1"], c["chrom2"], c["start2"], c["end2"], c["evidence"], c["first_obs"]) for c in live if c["evidence"] >= least)


def test_clusters_by_brute_force(spark):
    r = random.Random(7)
    rows = []
    for i in range(400):
        s1, s2 = r.randint(0, 6000), r.randint(0, 6000)
        rows.append({"obs": i, "chrom1": r.randint(0, 1), "start1": s1, "end1": s1 + r.randint(1, 20), "dir1": r.randint(0, 1), "chrom2": r.randint(0, 1), "start2": s2, "end2": s2 + 1, "dir2": r.randint(0, 1), "evidence": r.randint(0, 2), "qname": r.randint(0, 150)})
    found = cluster.breakpoint_clusters(spark.createDataFrame(rows)).collect()
    assert sorted((c["chrom1"], c["start1"], c["end1"], c["chrom2"], c["start2"], c["end2"], c["evidence"], c["first_obs"]) for c in found) == brute_clusters(rows)


def test_pools_by_brute_force(spark):
    r = random.Random(2)
    rows = [(r.randint(0, 1), s, s + r.randint(1, 300), r.randint(0, 2), i) for i in range(200) for s in [r.randint(0, 9000)]]
    want, leader = {}, {}
    for c, s, e, _, i in sorted(rows):
        if c not in leader or not (leader[c][0] - 100 < e and s < leader[c][1] + 100):
            leader[c] = (s, e, i)
        want[i] = leader[c][2]
    found = pools.leader_pools(spark.createDataFrame(rows, "chrom long, start long, end long, sample long, id long"), 100)
    assert {x["id"]: x["pool"] for x in found.collect()} == want


def test_close_merge_keeps_samples_apart(spark):
    rows = [(1, 10, 0, 100, 200, 100, 3, 5), (1, 11, 0, 101, 201, 100, 9, 5), (1, 12, 1, 102, 202, 100, 4, 5), (1, 13, 1, 900, 1900, 1000, 1, 5)]
    found = pools.merge_close(spark.createDataFrame(rows, "pool long, id long, sample long, start long, end long, size long, reads long, contig_length long"))
    assert {x["id"]: x["merged_id"] for x in found.collect()} == {10: 12, 12: 12, 11: 11, 13: 13}


def test_downsample(spark):
    for n, k in ((13, 5), (13, 13), (13, 14), (4, 3)):
        rows = spark.range(n).withColumn("g", F.lit(0))
        total, want = 0, []
        for i in range(n):  # the running form: keep when the remainder passes n
            total = total % n + k
            want += [i] if total >= n or k >= n else []
        assert sorted(x["id"] for x in genotype.downsample(rows, ["g"], ["id"], k).collect()) == want


def test_inversions_use_each_once(spark):
    rows = [(1, 0, 1000, 9000, 0), (2, 0, 1000, 9000, 0), (3, 0, 1100, 9100, 1), (4, 0, 1200, 9200, 0), (5, 0, 50_000, 90_000, 1)]
    found = matching.inversions(spark.createDataFrame(rows, "id long, chrom long, start long, end long, dir long")).collect()
    assert [(x["id1"], x["id2"], x["start"], x["end"]) for x in found] == [(1, 3, 1000, 9100)]


def test_large_insertions(spark):
    rows = [(1, 0, 1000, 1), (2, 0, 1300, 0), (3, 0, 5000, 0), (4, 0, 5150, 1), (5, 0, 5300, 0), (6, 0, 9000, 0), (7, 0, 9300, 1)]
    found = cluster.large_insertions(spark.createDataFrame(rows, "id long, chrom long, pos long, dir long"))
    assert sorted((x["root"], x["other"]) for x in found.collect()) == [(1, 2), (3, 4)]


def test_alignment():
    assert align.align("ACGTACGT", "TTACGTACGTTT") == (8, 2, "8=")
    score, at, text = align.align("AAAACCCCGGGGTTTT" * 3, "AAAACCCCGGGGTTTT" * 2 + "AAAACCGGGGTTTT", False)
    assert text.count("I") == 1 and score == 46 - 4
    assert align.left_shifted([(4, "="), (2, "D"), (4, "=")], "ACACACGT", "ACACACACGT") == [(1, "="), (2, "D"), (7, "=")]
    r = random.Random(1)
    for _ in range(30):
        q, t = ("".join(r.choice("ACGT") for _ in range(r.randint(1, 12))) for _ in range(2))
        h = np.zeros((len(q) + 1, len(t) + 1), int)
        h[:, 0] = [-2 * i for i in range(len(q) + 1)]
        for i in range(1, len(q) + 1):
            for j in range(1, len(t) + 1):
                h[i, j] = max(h[i - 1, j - 1] + (1 if q[i - 1] == t[j - 1] else -3), h[i - 1, j] - 2, h[i, j - 1] - 2)
        assert (align.table(q, t, True) == h).all()


def test_assembly(spark):
    r = random.Random(3)
    truth = ["".join(r.choice("ACGT") for _ in range(400)) for _ in range(2)]
    reads = []
    for k, t in enumerate(truth):
        for i in range(4):
            s = list(t[i * 5 :])
            s[50 + 31 * i] = "A" if s[50 + 31 * i] != "A" else "C"
            reads.append((1, f"r{k}{i}", "".join(s)))
    found = align.assemble(spark.createDataFrame(reads, "cluster long, qname string, seq string")).collect()
    assert sorted(len(x["qnames"]) for x in found) == [4, 4]
    best = {x["contig"] for x in found}
    assert all(min(sum(a != b for a, b in zip(c, t)) for t in truth) <= 1 for c in best)


def test_contig_indels():
    r = random.Random(5)
    ref = "".join(r.choice("ACGT") for _ in range(400))
    ((start, end, inserted, _),) = align.anchored_indels(ref[:150] + ref[200:], ref, 1000, 35, 50)
    assert end - start - 1 == 50 and abs(start - 1149) <= 3 and inserted == ""


def test_records(spark):
    rows = spark.createDataFrame([("b", 1, 5, None, False), ("a", 1, 5, None, False), ("c", 1, 5, None, True), ("d", 1, 5, 3, False)], "id string, chrom long, pos long, size long, is_inversion boolean")
    assert sorted(x["id"] for x in records.dedup(rows, ["chrom", "pos", "size"]).collect()) == ["c", "d"]
    assert evidence.least_evidence_size() == 25
    with pytest.raises(ValueError):
        DiscoverSettings(bin_size=0)


def plain(value):
    if value is None or value != value:
        return "null"
    return str(int(value)) if isinstance(value, float) and value == int(value) else f"{value:.6g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda found: sorted(tuple(map(plain, r)) for r in found)
    assert rows(got.select(want.columns).collect()) == rows(want.fetchall())


@pytest.fixture(scope="module")
def once():
    """Whole pipelines by their arguments: queries that ask one pipeline for different tables share a run of it here."""
    done = {}

    def shared(name, function):
        def run(*args, **named):
            key = (name, repr([x for x in (*args, *sorted(named.items())) if isinstance(x, JointCallSettings | DiscoverSettings | str)]), "excluded" in named)
            if key not in done:
                done[key] = function(*args, **named)
            return done[key]

        return run

    with pytest.MonkeyPatch.context() as patch:
        for name in ("discover", "joint_call"):
            patch.setattr(pipelines, name, shared(name, getattr(pipelines, name)))
        yield


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_runs(spark, sf_dir, once, name):
    found = registry.queries()[name](spark, sf_dir)
    assert found.count() >= 0 and found.columns
