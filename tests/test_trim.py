import random

from pyspark.sql import functions as F

from strandline.functions import cigar, variants
from strandline.operators import sweep, trim


def test_clip_read_edges(spark):
    runs = cigar.parse(F.lit("5S10=3D10=2I8=4S"))
    cut = lambda a, b: spark.range(1).select(cigar.render(cigar.clip_read_edges(runs, F.lit(a), F.lit(b)))).first()[0]
    assert cut(7, 0) == "7S8=3D10=2I8=4S"
    assert cut(15, 12) == "15S10=2I12S"
    assert cut(0, 0) == "5S10=3D10=2I8=4S"


def test_homology(spark):
    found = lambda s, at, n: spark.range(1).select(cigar.homology(F.lit(s), F.lit(at), F.lit(n))).first()[0]
    assert found("TTACGACGACGTT", 2, 3) == 6
    assert found("AACCGGTT", 2, 2) == 0


def test_limits_and_history(spark):
    limits = sweep.scoring_depth_limit(spark.createDataFrame([(0, 10.7), (1, 500.0)], "sample long, haploid double"))
    assert {r["sample"]: r["max_depth"] for r in limits.collect()} == {0: 128, 1: 1000}
    rows = spark.createDataFrame([(0, i, i * i) for i in range(5)], "k long, i long, v long")
    assert [r["history"] for r in sweep.last_values(rows, ["k"], ["i"], "v", 3).orderBy("i").collect()] == [[0], [0, 1], [0, 1, 4], [1, 4, 9], [4, 9, 16]]
    svs = spark.createDataFrame([(0, 0, 100, 110, 1), (1, 0, 100, 110, 1), (0, 0, 400, 410, 2)], "sample long, chrom long, start long, end long, sv long")
    over = spark.createDataFrame([(0, 0, 165, 175)], "sample long, chrom long, start long, end long")
    assert sweep.over_limit(svs, over).count() == 0 and [(r["sample"], r["sv"]) for r in sweep.over_limit(svs, over, 60).collect()] == [(0, 1)]
    assert sweep.select_chroms(spark.createDataFrame([("chr1",), ("chrX",), ("22",)], "chrom string")).count() == 2


def test_trimmed_reads_and_flanks(spark):
    r = random.Random(1)
    ref = "".join(r.choice("ACGT") for _ in range(3000))
    reads = [(f"r{i}", 0, 200 + 10 * i, 2700 + 10 * i, "1300=60D1140=", ref[200 + 10 * i : 1500 + 10 * i] + ref[1560 + 10 * i : 2700 + 10 * i], True) for i in range(3)]
    reads.append(("plain", 0, 300, 2300, "2000=", ref[300:2300], True))
    table = spark.createDataFrame(reads, "qname string, chrom long, start long, end long, cigar string, seq string, is_primary boolean")
    regions = spark.createDataFrame([(1, 0, 1490, 1580)], "cluster long, chrom long, start long, end long")
    pieces = trim.trimmed_reads(table, regions)
    found = {x["qname"]: x for x in pieces.collect()}
    assert sorted(found) == ["r0", "r1", "r2"]
    for q, *_, seq, _ in reads[:3]:
        assert found[q]["prefix"] + found[q]["seq"] + found[q]["suffix"] == seq and len(found[q]["seq"]) == 631
    contigs = spark.createDataFrame([(1, 0, found["r0"]["seq"], ["r0", "r1"])], "cluster long, assembly long, contig string, qnames array<string>")
    (longer,) = trim.extend_contigs(contigs, pieces, 100).collect()
    assert longer["core_start"] == 100 and len(longer["contig"]) == 831


def test_split_matches(spark):
    segments = spark.createDataFrame([("a", 0, 0, 100, 500), ("a", 1, 1, 900, 1400), ("b", 0, 0, 100, 500), ("b", 1, 0, 700, 900), ("b", 2, 1, 900, 950)], "qname string, seg long, chrom long, start long, end long")
    ends = spark.createDataFrame([(7, 0, 510, 1, 880)], "sv long, chrom1 long, pos1 long, chrom2 long, pos2 long")
    assert sorted(map(tuple, trim.split_matches(segments, ends).collect())) == [(7, "a", 0, 1), (7, "b", 1, 2)]


def test_junction(spark):
    r = random.Random(2)
    left, right = ("".join(r.choice("ACGT") for _ in range(300)) for _ in range(2))
    assert len(trim.junction_of(left[100:200] + "GATTACA" + right[120:220], left, right)[2]) <= 7
    leave, enter, between = trim.junction_of(left[100:200] + right[120:220], left, right)
    assert abs(leave - 200) <= 4 and abs(enter - 120) <= 4
    assert trim.junction_of(left[100:220], left, right) is None
    s = spark.range(1).select(trim.derived_sequence(F.lit("AAC"), F.lit("GGT"), F.lit(0), F.lit(0))).first()[0]
    assert s == "AAC" + "N" * 100 + "ACC"
    assert spark.range(1).select(variants.rev_comp(F.lit("GGT"))).first()[0] == "ACC"


def test_insertion_read_order(spark):
    rows = [(1, 0, 1, "AC"), (1, 1, 0, "ACGT"), (1, 2, -1, "A"), (1, 3, 1, "ACG"), (1, 4, -1, "ACC"), (1, 5, 0, "A"), (1, 6, 1, "AG")]
    found = trim.insertion_read_order(spark.createDataFrame(rows, "cluster long, place long, clip long, seq string"))
    assert [r["place"] for r in found.orderBy("rank").collect()] == [4, 2, 1, 5, 3, 0, 6]


def _segments(spark, rows):
    return spark.createDataFrame(rows, "qname string, seg long, chrom long, start long, end long, strand long, read_start long, read_end long, read_length long, cigar string, is_primary boolean")


BREAKS = "cluster long, chrom1 long, start1 long, end1 long, dir1 long, chrom2 long, start2 long, end2 long, dir2 long"


def test_reads_of_a_translocation_come_out_in_order(spark):
    """One chromosome runs up to 1000, then on from 5000 of another; reads of both strands cross the break at different places."""
    r = random.Random(3)
    left, right = ("".join(r.choice("ACGT") for _ in range(8000)) for _ in range(2))
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows, bases, joined = [], [], {}
    for name, before, after, reverse in [("even", 600, 700, False), ("turned", 500, 500, True), ("short", 400, 100, False), ("shorter", 400, 60, True), ("late", 90, 500, False), ("later", 200, 400, True)]:
        seq = left[1000 - before : 1000] + right[5000 : 5000 + after]
        joined[name] = seq
        n = before + after
        strand = int(reverse)
        one = (0, 1000 - before, 1000, strand, *((after, n) if reverse else (0, before)), n, f"{before}={after}S", True)
        two = (1, 5000, 5000 + after, strand, *((0, after) if reverse else (before, n)), n, f"{before}H{after}=", False)
        rows += [(name, i, *x) for i, x in enumerate((two, one) if reverse else (one, two))]
        bases.append((name, turned(seq) if reverse else seq))
    far = [("far", 0, 0, 400, 700, 0, 0, 300, 600, None, True), ("far", 1, 1, 5000, 5300, 0, 300, 600, 600, None, False)]
    lone = [("lone", 0, 0, 800, 1000, 0, 0, 200, 200, "200=", True), ("no bases", 0, 0, 700, 1000, 0, 0, 300, 600, None, True), ("no bases", 1, 1, 5000, 5300, 0, 300, 600, 600, None, False)]
    segments = _segments(spark, rows + far + lone)
    breaks = spark.createDataFrame([(1, 0, 998, 1003, 0, 1, 4999, 5004, 1), (2, 0, 998, 1003, 0, None, None, None, None), (3, 0, 998, 1003, 1, 1, 4999, 5004, 1), (4, 0, 998, 1003, 0, 2, 4999, 5004, 1)], BREAKS)
    found = trim.breakpoint_reads(segments, spark.createDataFrame(bases, "qname string, seq string"), breaks).orderBy("rank").collect()
    assert {x["cluster"] for x in found} == {1} and sorted(x["qname"] for x in found) == sorted(joined)
    for x in found:
        assert x["prefix"] + x["seq"] + x["suffix"] == joined[x["qname"]]  # all turned as the first end's reference is
        assert left[990:1000] + right[5000:5010] in x["seq"]
    order = [(x["qname"], x["clip"]) for x in found]
    assert order == [("short", -1), ("shorter", -1), ("even", 0), ("turned", 0), ("later", 1), ("late", 1)]
    ranks = {x["qname"]: x["rank"] for x in trim.ordered_breakpoint_reads(trim.breakpoint_ranges(segments, breaks)).collect()}
    assert ranks["no bases"] == 4  # the piece is base ``at`` with 300 on both sides: with 299 before it, the longest of those cut on the left


def test_deletions_within_alignments_come_first(spark):
    rows = [
        ("inside", 0, 0, 1000, 2000, 0, 0, 800, 800, "400=200D400=", True), ("elsewhere", 0, 0, 1000, 2000, 0, 0, 800, 800, "100=200D700=", True), ("smaller", 0, 0, 1000, 2000, 0, 0, 950, 950, "400=50D550=", True),
        ("second", 0, 0, 1000, 2000, 1, 0, 790, 790, "390=10D10=200D390=", True), ("unknown", 0, 0, 1000, 2000, 0, 0, 800, 800, None, True),
    ]
    breaks = spark.createDataFrame([(7, 0, 1399, 1400, 0, 0, 1600, 1601, 1), (8, 0, 1399, 1400, 1, 0, 1600, 1601, 0)], BREAKS)
    segments = _segments(spark, rows)
    assert sorted((x["cluster"], x["qname"], x["at"]) for x in trim.breakpoint_ranges(segments, breaks).collect()) == [(7, "inside", 399), (7, "second", 399)]
    assert trim.breakpoint_ranges(segments.limit(0), breaks).count() == 0 and trim.breakpoint_ranges(segments, breaks.limit(0)).count() == 0


def test_one_piece_of_each_read(spark):
    ranges = spark.createDataFrame(
        [(1, "a", 0, 5, 0, False, 1000, 500), (1, "a", 1, 5, 0, True, 1000, 600), (1, "a", 2, 5, 0, True, 1000, 900), (2, "a", 2, 5, 0, True, 1000, 900), (2, "a", 2, 5, 0, True, 1000, 900)],
        "cluster long, qname string, seg long, pos long, strand long, is_primary boolean, read_length long, at long",
    )
    found = trim.ordered_breakpoint_reads(ranges).orderBy("cluster").collect()
    assert [(x["cluster"], x["seg"], x["first"], x["last"], x["clip"], x["rank"]) for x in found] == [(1, 1, 300, 901, 0, 0), (2, 2, 600, 1000, -1, 0)]
