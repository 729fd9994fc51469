"""Both pipelines over reads of known chromosomes: what is planted is found, and each setting changes what it names."""

import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strandline.plans import pipelines
from strandline.settings import DiscoverSettings, JointCallSettings
from strandline.sources import sinks

READS = "sample long, qname string, seg long, chrom long, start long, end long, strand long, mapq long, flag long, cigar string"
LENGTH, READ, STEP = 400_000, 6000, 300
DELETED, TURNED = (100_000, 240_000), (200_000, 230_000)
BIN = DiscoverSettings(bin_size=1000)
QUICK = replace(BIN, disable_cnv=True, disable_large_insertions=True)


def pieces(chrom, sample, haplotype):
    """The haplotype as (start, end, strand) pieces of the reference: a deletion on one haplotype of samples 0 and 1, an inversion on both
    of sample 2."""
    if chrom == 1 and sample < 2 and haplotype == 0:
        return [(0, DELETED[0], 0), (DELETED[1], LENGTH, 0)]
    if chrom == 2 and sample == 2:
        return [(0, TURNED[0], 0), (*TURNED, 1), (TURNED[1], LENGTH, 0)]
    return [(0, LENGTH, 0)]


def reads_of(chrom, sample, haplotype, r):
    own, at, out = pieces(chrom, sample, haplotype), 0, []
    total = sum(e - s for s, e, _ in own)
    for n, begin in enumerate(range(r.randrange(STEP) - READ, total, STEP)):
        segments, at = [], 0
        for s, e, strand in own:
            a, b = max(begin, at, 0), min(begin + READ, at + e - s)
            if b - a > 50:
                segments.append((s + a - at, s + b - at, 0) if not strand else (e - (b - at), e - (a - at), 1))
            at += e - s
        name = f"{chrom}.{haplotype}.{n}"
        out += [(sample, name, k, chrom, s, e, strand, 60, 0, f"{e - s}=") for k, (s, e, strand) in enumerate(segments)]
    return out


def all_reads():
    r = random.Random(1)
    out = [x for chrom in (1, 2) for sample in range(3) for haplotype in range(2) for x in reads_of(chrom, sample, haplotype, r)]
    for i in range(3):  # an insertion that only clips show, in sample 0; and reads of low quality or identity
        out += [(0, f"r{i}", 0, 2, 50_000 - 3000, 50_000 + i, 0, 60, 0, f"{3000 + i}=900S"), (0, f"l{i}", 0, 2, 50_060 + i, 53_000, 0, 60, 0, f"900S{2940 - i}=")]
        out += [(1, f"m{i}", k, 2, *((100_000, 103_000), (140_000, 143_000))[k], 0, 3, 0, None) for k in range(2)]
        out += [(1, f"x{i}", 0, 2, 20_000, 22_080, 0, 60, 0, "900=100X100D980=")]
    return out


@pytest.fixture(scope="module")
def reads(spark):
    return spark.createDataFrame(all_reads(), READS).repartition(3).cache()


@pytest.fixture(scope="module")
def stage(reads):
    return pipelines.discover(reads, settings=BIN)


@pytest.fixture(scope="module")
def joint(reads, stage):
    return pipelines.joint_call(reads, stage, JointCallSettings(report_supporting_reads=True))


def ends(clusters):
    return {(c["sample"], c["chrom1"], c["start1"], c["start2"], c["dir1"], c["dir2"]) for c in clusters.collect()}


def test_clusters(stage):
    turned = {(2, 2, TURNED[0] - 1, TURNED[1] - 1, 0, 0), (2, 2, TURNED[0] - 1, TURNED[1] - 1, 1, 1)}
    assert ends(stage["clusters"]) == {(s, 1, DELETED[0] - 1, DELETED[1] - 1, 0, 1) for s in (0, 1)} | turned


def test_insertion_of_clips(stage):
    (found,) = stage["insertions"].collect()
    assert found["sample"] == 0 and found["chrom"] == 2 and 49_990 <= found["start"] <= 50_070


def test_inverted_ends_are_neighbours(stage):
    """Reads that run through the whole piece: the left-hand junction is followed by the right-hand one, 30,000 bases on, which is too
    far; with a longer reach and longer reads it would be found. No pair is reported here."""
    assert stage["neighbours"].count() == 0


def test_segments(stage):
    lost = {(s["sample"], s["begin"], s["end"]) for s in stage["segments"].filter("chrom = 1 and state = 1").collect()}
    assert {s for s, _, _ in lost} == {0, 1} and all(abs(b - 100) <= 5 and abs(e - 240) <= 5 for _, b, e in lost)
    assert {s["state"] for s in stage["segments"].filter("sample = 2").collect()} == {2}


def test_joint_calls(joint):
    records = {r["id"]: r for r in joint["records"].collect()}
    (gone,) = [r for r in records.values() if r["kind"] == "DEL"]
    assert (gone["chrom"], gone["pos"], gone["end"], gone["filter"], gone["claim"]) == (1, DELETED[0] - 1, DELETED[1] - 1, "PASS", "DJ")
    gt = {r["sample"]: (r["gt"], r["ref"], r["alt"]) for r in joint["calls"].filter(F.col("sv") == int(gone["id"])).collect()}
    assert [gt[s][0] for s in range(3)] == [1, 1, 0] and gt[2][2] == 0 and all(gt[s][2] >= 5 for s in (0, 1))
    (turn,) = [r for r in records.values() if r["kind"] == "INV"]
    assert (turn["chrom"], turn["pos"], turn["end"]) == (2, TURNED[0] - 1, TURNED[1] - 1)
    parts = [r for r in records.values() if r["kind"] == "BND"]
    assert len(parts) == 2 and {(r["filter"], r["event"]) for r in parts} == {("InvBreakpoint", turn["id"])}
    for r in parts:
        assert [x["gt"] for x in joint["calls"].filter(F.col("sv") == int(r["id"])).orderBy("sample").collect()] == [0, 0, 2]


def test_joint_copy_numbers(joint):
    """The variant's ends pull the samples' boundaries onto its bins; the variant takes the copy-number record over."""
    lost = joint["copy_segments"].filter("copies = 1").collect()
    assert {(s["sample"], s["chrom"], s["start"], s["end"]) for s in lost} == {(s, 1, *DELETED) for s in (0, 1)}
    assert all(s["cnq"] > 0 and s["expected"] == 2 for s in lost)
    assert joint["cnvs"].count() == 0 and joint["matches"].count() == 1


def test_supporting_reads(joint, reads):
    names = joint["supporting_reads"].groupBy("sample").count().collect()
    assert {r["sample"] for r in names} == {0, 1, 2}


def test_written_and_read_again(spark, reads, stage, tmp_path):
    folder, output = str(tmp_path / "stage"), str(tmp_path / "joint")
    pipelines.run_discover(reads.filter("sample = 2 and chrom = 2"), str(tmp_path / "small"), QUICK)
    assert '"bin_size": 1000' in spark.read.text(str(tmp_path / "small" / "run_stats")).first()["value"]
    sinks.write_stage(stage, folder)
    contigs = spark.createDataFrame([(1, "chr1", LENGTH), (2, "chr2", LENGTH)], "chrom long, name string, length long")
    pipelines.run_joint_call(reads, folder, output, contigs, JointCallSettings(report_supporting_reads=True))
    lines = [r["value"] for r in spark.read.text(f"{output}/vcf").collect()]
    assert f"##contig=<ID=chr1,length={LENGTH}>" in lines and any(x.startswith("##INFO=<ID=SVTYPE,") for x in lines) and any(x.startswith("##FORMAT=<ID=GT,") for x in lines) and any(x.startswith("##FILTER=<ID=MinQUAL,") for x in lines)
    body = [x.split("\t") for x in lines if not x.startswith("#")]
    assert Counter(x[7].split(";")[0] for x in body) == {"SVTYPE=DEL": 1, "SVTYPE=INV": 1, "SVTYPE=BND": 4}
    (gone,) = [x for x in body if "SVTYPE=DEL" in x[7]]
    assert gone[:2] == ["chr1", str(DELETED[0])] and f"END={DELETED[1]}" in gone[7] and [x.split(":")[0] for x in gone[9:]] == ["0/1", "0/1", "0/0"]
    assert spark.read.text(f"{output}/supporting_reads_json").count() >= 3
    assert '"report_supporting_reads": true' in spark.read.text(f"{output}/run_stats").first()["value"]
    with pytest.raises(ValueError, match="finished stage"):
        pipelines.run_discover(reads, folder, BIN)
    assert sinks.check_folder(spark, folder, True) is None


def proposed(reads, settings):
    seen = pipelines.observations(pipelines.usable_reads(reads, settings), settings)
    return {(o["sample"], o["chrom1"], o["start1"], o["start2"]) for o in seen.filter("chrom1 = 2 and sample = 1").collect()}


def test_read_settings_act(reads):
    jump, gap = (1, 2, 102_999, 139_999), (1, 2, 20_999, 21_099)
    assert proposed(reads, BIN) == set()
    assert proposed(reads, replace(BIN, min_mapq=3)) == {jump}
    assert proposed(reads, replace(BIN, min_identity=0.9)) == {gap}
    assert proposed(reads, replace(BIN, min_identity=0.9, min_indel=120)) == set()
    assert proposed(reads, replace(BIN, min_identity=0.9, min_indel=120, noise_margin=30)) == {gap}


def test_cluster_settings_act(reads):
    found = pipelines.discover(reads, settings=replace(QUICK, min_evidence=1000))
    assert found["clusters"].count() == 0 and "insertions" not in found


@pytest.fixture
def known_haploid(spark, monkeypatch):
    """Discovery without its rounds: the haploid depth is given."""
    haploid = spark.createDataFrame([(s, 20.0) for s in range(3)], "sample long, haploid double")
    monkeypatch.setattr(pipelines.hmm, "converge", lambda cells: (cells.select("sample", "chrom", "bin", F.lit(2).cast("long").alias("state")), haploid))


def test_depth_settings_act(reads, stage, known_haploid):
    assert stage["max_depth"].count() == 0
    assert pipelines.discover(reads, settings=replace(QUICK, max_depth=25))["max_depth"].count() > 0
    factor = pipelines.discover(reads, settings=replace(BIN, max_depth_factor=1.0, disable_large_insertions=True, chrom_regex="^2$"))
    assert factor["max_depth"].count() > 0 and {r["chrom"] for r in factor["cells"].select("chrom").distinct().collect()} == {2}
    called = pipelines.joint_call(reads, stage | {"max_depth": factor["max_depth"]}, JointCallSettings(min_qual=2000, max_qscore=20, disable_cnv=True, dedup=False, pool_margin=0))
    assert {r["filter"] for r in called["records"].filter("kind = 'DEL'").collect()} == {"MaxScoringDepth;MinQUAL"}
    assert max(r["pl0"] for r in called["calls"].collect()) <= 20


def test_bin_size_and_shift_reach_the_joint_stage(reads, stage, monkeypatch):
    seen = []
    monkeypatch.setattr(pipelines.hmm, "joint_segments", lambda cells, haploid, shift: seen.append(shift) or pipelines.hmm.segments(pipelines.hmm.segment_states(cells, haploid)))
    wide = {"settings": stage["settings"].withColumn("value", F.when(F.col("name") == "bin_size", "2000").otherwise(F.col("value")))}
    found = pipelines.joint_call(reads, stage | wide, JointCallSettings(merge_sv_cnv=False, boundary_shift=9000))
    assert seen == [4] and "matches" not in found
    assert max(r["end"] for r in found["copy_segments"].collect()) == 2 * LENGTH


def test_content_settings_act(spark, reads):
    r = random.Random(3)
    seq = "".join(r.choice("GC" if (i // 10_000) % 2 else "AT") if r.random() < 0.8 else r.choice("ACGT") for i in range(LENGTH))
    sequences = spark.createDataFrame([(1, seq), (2, seq)], "chrom long, seq string")
    found = []
    for more in ({}, {"gc_window": 1000}, {"gc_levels": 2}):
        settings = replace(BIN, disable_large_insertions=True, **more)
        depth = spark.range(LENGTH // 1000).selectExpr("0L AS sample", "1L AS chrom", "id AS bin", "20.0D + id % 7 + 9 * (id div 10 % 2) AS depth")
        cells = pipelines.copy_numbers(depth, pipelines.gc.window_content(sequences, 1000, settings.gc_window), None, replace(settings, bin_size=100_000, gc_window=100_000))["cells"]
        found.append(sorted((c["bin"], round(c["reduction"], 6)) for c in cells.collect()))
    assert all(len(f) == LENGTH // 1000 for f in found) and found[0] != found[1] and found[0] != found[2] and found[1] != found[2]


def test_expected_copies(spark, reads):
    """One copy of chromosome 1 everywhere: by it, the deleted stretch isn't a loss; told so, calls there are haploid."""
    expected = spark.createDataFrame([(1, 0, LENGTH, 1)], "chrom long, start long, end long, value long")
    stage = pipelines.discover(reads, settings=replace(BIN, disable_large_insertions=True), expected=expected)
    assert {r["expected"] for r in stage["cells"].filter("chrom = 1").collect()} == {1}
    found = pipelines.joint_call(reads, stage, JointCallSettings(treat_single_copy_as_haploid=True), expected)
    assert {(r["chrom"], r["haploid"]) for r in found["calls"].join(found["records"].filter("not is_inversion").select(F.col("id").cast("long").alias("sv"), "chrom"), "sv").collect()} == {(1, True), (2, False)}
    assert not [c for c in found["cnvs"].collect() if c["start"] == DELETED[0] and c["end"] == DELETED[1]]


def test_refined_contigs(spark):
    """Reads with one deletion are assembled to a contig that shows it to the base; an insertion of a stretch explains its duplication."""
    r = random.Random(11)
    ref = "".join(r.choice("ACGT") for _ in range(9000))
    new = "".join(r.choice("ACGT") for _ in range(150))
    rows = []
    for i in range(4):
        a = 3600 + 20 * i
        rows.append((0, f"d{i}", 0, 1, a, a + 1120, 0, 60, 0, f"{4000 - a}=120D{a + 1000 - 4000}=", ref[a:4000] + ref[4120 : a + 1120]))
        b = 6600 + 20 * i
        rows.append((0, f"i{i}", 0, 1, b, b + 900, 0, 60, 0, f"{7000 - b}=150I{b + 900 - 7000}=", ref[b:7000] + new + ref[7000 : b + 900]))
        rows += [(0, f"t{i}", k, 1, s, e, 0, 60, 0, None, None) for k, (s, e) in enumerate([(6500, 7100), (6960, 7900)])]
    reads = spark.createDataFrame(rows, READS + ", seq string")
    reference = spark.createDataFrame([(1, 0, ref)], "chrom long, start long, seq string")
    found = pipelines.discover(reads, settings=replace(QUICK, cluster_distance=100), reference=reference)
    kinds = {(c["dir1"], c["dir2"], c["start2"] - c["start1"]) for c in found["clusters"].collect()}
    assert (0, 1, 120) in kinds
    candidates = found["candidates"].collect()
    (gone,) = [c for c in candidates if c["inserted"] == ""]
    assert gone["end"] - gone["start"] - 1 == 120 and gone["start"] <= 3999 <= gone["start"] + gone["homology"]
    (more,) = [c for c in candidates if c["inserted"]]
    assert len(more["inserted"]) == 150 and abs(more["start"] - 6999) <= more["homology"]
    assert not [k for k in kinds if k[:2] == (1, 0)]  # the duplication went
    assert found["split_reads"].count() == 0  # no cluster of two regions
    plain = pipelines.discover(reads.drop("seq"), settings=replace(QUICK, cluster_distance=100))
    assert "candidates" not in plain and [c for c in plain["clusters"].collect() if (c["dir1"], c["dir2"]) == (1, 0)]


def test_split_reads_of_two_regions(spark):
    """Reads of two samples join one chromosome's start to another's end; each sample's reads go to its own cluster."""
    r = random.Random(12)
    left, right = ("".join(r.choice("ACGT") for _ in range(6000)) for _ in range(2))
    rows, joined = [], {}
    for sample in (0, 1):
        for i, (a, b) in enumerate([(500, 600), (400, 200), (100 + sample, 700)]):
            seq, strand = left[2000 - a : 2000] + right[3000 : 3000 + b], (i + sample) % 2
            joined[sample, f"q{i}"] = seq
            one = (1, 2000 - a, 2000, strand, 60, 0, f"{a}={b}S", seq)
            two = (2, 3000, 3000 + b, strand, 60, 0x800, f"{a}H{b}=", seq[a:])  # hard-clipped: its bases are not whole
            rows += [(sample, f"q{i}", k, *x) for k, x in enumerate((two, one) if strand else (one, two))]
    reads = spark.createDataFrame(rows, READS + ", seq string")
    clusters = spark.createDataFrame([(s, 10 + s, 2, 1, 1998, 2001, 0, 2, 2998, 3001, 1) for s in (0, 1)] + [(0, 12, 1, 1, 1998, 2001, 0, 2, 2998, 3001, 1)], "sample long, cluster long, region_count int, chrom1 long, start1 long, end1 long, dir1 int, chrom2 long, start2 long, end2 long, dir2 int")
    found = pipelines.split_reads(reads, clusters).collect()
    assert {(x["sample"], x["cluster"], x["qname"]) for x in found} == {(s, 10 + s, q) for s, q in joined} and len(found) == 6
    assert all(x["prefix"] + x["seq"] + x["suffix"] == joined[x["sample"], x["qname"]] for x in found)
    assert [x["qname"] for x in sorted(found, key=lambda x: (x["cluster"], x["rank"]))] == ["q1", "q0", "q2"] * 2
