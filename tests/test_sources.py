import json
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import sweep
from strandline.sources import sinks, text
from strandline.streaming import depth as streams


def put(path, content):
    path.write_text(content)
    return str(path)


def test_bed(spark, tmp_path):
    path = put(tmp_path / "a.bed", "chr1\t5\t10\tx\t3\nchr2\t0\t7\n")
    assert sorted(map(tuple, text.read_bed(spark, path).collect())) == [("chr1", 5, 10, "x", 3), ("chr2", 0, 7, None, None)]
    with pytest.raises(Exception, match="not a region"):
        text.read_bed(spark, put(tmp_path / "b.bed", "chr1\tfive\t10\n")).collect()
    with pytest.raises(Exception, match="unknown chromosome"):
        text.read_bed(spark, path, spark.createDataFrame([("chr1",)], "chrom string")).collect()


@pytest.mark.parametrize("chunk", [3, 8, 1000])
def test_fasta(spark, tmp_path, chunk):
    r = random.Random(chunk)
    truth = {f"c{i}": "".join(r.choice("acgtRN") for _ in range(r.randint(1, 60))) for i in range(4)}
    lines = []
    for name, seq in truth.items():
        lines += [f"> {name} some words"] + [seq[i : i + 7] for i in range(0, len(seq), 7)] + [""]
    chunks = text.read_fasta(spark, put(tmp_path / "r.fa", "\n".join(lines)), chunk)
    clean = {n: "".join(c if c in "ACGT" else "N" for c in s.upper()) for n, s in truth.items()}
    found = {}
    for x in sorted(chunks.collect(), key=lambda x: (x["chrom"], x["start"])):
        assert x["start"] == len(found.get(x["chrom"], "")) and len(x["seq"]) <= chunk
        found[x["chrom"]] = found.get(x["chrom"], "") + x["seq"]
    assert found == clean
    regions = spark.createDataFrame([(i, n, 1, len(s)) for i, (n, s) in enumerate(clean.items()) if len(s) > 1], "id long, chrom string, start long, end long")
    got = {x["id"]: x["seq"] for x in text.sequence_of(chunks, regions, chunk).collect()}
    assert got == {i: s[1:] for i, s in enumerate(clean.values()) if len(s) > 1}


def test_manifest(spark, tmp_path):
    path = put(tmp_path / "m.csv", "# samples\n one , a.bam\ntwo\n")
    assert sorted((r["sample"], r["discover_dir"], r["alignments"]) for r in text.read_manifest(spark, path).collect()) == [(0, "one", "a.bam"), (1, "two", None)]


def test_allele_counts(spark, tmp_path):
    rows = ["##FILTER=<ID=PASS>", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2"]
    rows += ["1\t10\t.\tA\tC\t9\tPASS\t.\tGT:AD\t0/1:3,4\t0/0:9,.", "1\t10\t.\tA\tG\t9\tPASS\t.\tGT:AD\t0/1:5,6\t0/0:1,2", "1\t20\t.\tA\tC,G\t9\tPASS\t.\tGT:AD\t0/1:3,4\t0/0:9,1", "1\t30\t.\tA\tC\t9\tbad\t.\tAD\t3,4\t9,1"]
    found = text.read_allele_counts(spark, put(tmp_path / "v.vcf", "\n".join(rows)))
    assert sorted(map(tuple, found.collect())) == [("s1", "1", 9, 5, 6), ("s2", "1", 9, 1, 2)]


def test_sam(spark, tmp_path):
    path = put(tmp_path / "x.sam", "@SQ\tSN:chr1\tLN:100\n@SQ\tSN:HLA:1\tLN:50\n@RG\tID:1\tSM:me\nr1\t16\tchr1\t11\t60\t5M\t*\t0\t0\tACGTA\t*\tNM:i:2\tSA:Z:chr1,5,+,5M,3,0;\n")
    (row,) = text.read_sam(spark, path).withColumn("nm", text.int_tag(F.col("tags"), "NM")).collect()
    assert (row["qname"], row["flag"], row["pos"], row["mapq"], row["nm"], row["tags"]["SA"]) == ("r1", 16, 10, 60, 2, "chr1,5,+,5M,3,0;")
    assert [tuple(r) for r in text.header_chroms(spark, path).orderBy("chrom_index").collect()] == [(0, "chr1", 100), (1, "HLA:1", 50)]
    assert text.sample_name(spark, path, "none") == "me"


def test_methylation(spark):
    reads = spark.createDataFrame([("r", "ACGCCGTC", "C+m,0,1;", "128,255")], "qname string, seq string, mm string, ml string")
    assert sorted(map(tuple, text.methylation(reads).collect())) == [("r", 1, 0.5 + 1 / 512), ("r", 4, 255 / 256 + 1 / 512)]


def test_methylation_of_reverse_reads_and_later_entries(spark):
    """The same molecule read from either strand has the same CpG places; probabilities follow those of earlier entries."""
    seq = "ACGCCGTCGA"
    back = "".join({"A": "T", "C": "G", "G": "C", "T": "A"}[c] for c in reversed(seq))
    rows = [("f", seq, "A+a,0,0;C+m,0,1,0;", "9,9,128,255,7", False), ("r", seq, "C+m?,0,0;", "1,2", True), ("none", seq, "A+a,0;", "9", False), ("r2", back, "C+m,0;", "64", True)]
    found = sorted(map(tuple, text.methylation(spark.createDataFrame(rows, "qname string, seq string, mm string, ml string, is_reverse boolean")).collect()))
    want = []
    for name, s, mm, ml, reverse in rows:
        read = "".join({"A": "T", "C": "G", "G": "C", "T": "A"}[c] for c in reversed(s)) if reverse else s
        entries, probabilities, at = [e.split(",") for e in mm.split(";") if e], [int(x) for x in ml.split(",")], 0
        for e in entries:
            if e[0].startswith("C+m"):
                cs, k = [i for i, c in enumerate(read) if c == "C"], -1
                for skip, p in zip(map(int, e[1:]), probabilities[at:]):
                    k += skip + 1
                    i = cs[k]
                    if read[i + 1 : i + 2] == "G":
                        want.append((name, len(read) - i - 2 if reverse else i, p / 256 + 1 / 512))
            at += len(e) - 1
    assert found == sorted(want) and {x[0] for x in found} == {"f", "r", "r2"}


def test_tags(spark):
    (row,) = spark.sql("select map('NM', '2', 'rq', '0.5', 'SA', 'x') as t").select(text.int_tag(F.col("t"), "NM"), text.float_tag(F.col("t"), "rq"), text.string_tag(F.col("t"), "SA"), text.int_tag(F.col("t"), "XX"), text.has_tag(F.col("t"), "NM"), text.has_tag(F.col("t"), "XX"), F.size(text.without_tag(F.col("t"), "SA"))).collect()
    assert tuple(row) == (2, 0.5, "x", None, True, False, 2)
    with pytest.raises(Exception):
        spark.sql("select map('NM', 'two') as t").select(text.int_tag(F.col("t"), "NM")).collect()


def test_info_and_format_keys(spark):
    rows = [("SVTYPE=DEL;SVLEN=-90", "GT:AD", "0/1:3,4", "A", "<DEL>"), ("XSVTYPE=DEL", "GT", "0/1", "A", "ACC"), ("SVTYPE=BND", ".", ".", "AT", "A")]
    f = spark.createDataFrame(rows, "info string, format string, sample string, ref string, alt string")
    found = f.select(text.info_value(F.col("info"), "SVTYPE"), text.sample_value(F.col("format"), F.col("sample"), "AD"), text.sv_size(F.col("info"), F.col("ref"), F.col("alt")), text.sv_kind(F.col("info"), F.col("ref"), F.col("alt"))).collect()
    assert [tuple(r) for r in found] == [("DEL", "3,4", 90, "DEL"), (None, None, 2, "INS"), ("BND", None, 1, None)]


def test_counts_of_several_files(spark, tmp_path):
    put(tmp_path / "a.vcf", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\n1\t10\t.\tA\tC\t9\tlow\t.\tAD\t3,4\n")
    put(tmp_path / "b.vcf", "##FILTER=<ID=PASS>\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts2\n1\t10\t.\tA\tC\t9\tPASS\t.\tAD\t5,6\n1\t20\t.\tA\tC\t9\tlow\t.\tAD\t5,6\n")
    assert sorted(map(tuple, text.read_allele_counts(spark, str(tmp_path)).collect())) == [("s1", "1", 9, 3, 4), ("s2", "1", 9, 5, 6)]


def test_typed_variants_and_regions(spark, tmp_path):
    lines = ["##fileformat=VCFv4.4", "chr1\t101\ta\tA\t<DEL>\t30\tPASS\tSVTYPE=DEL;END=200;SVLEN=99;HOMLEN=3\tGT\t0/1", "chr1\t5\tb\tT\tTCT]chr2:500]\t.\tMinQUAL\tSVTYPE=BND\tGT\t0/1"]
    found = {r["id"]: r for r in text.read_svs(spark, put(tmp_path / "v.vcf", "\n".join(lines))).collect()}
    assert (found["a"]["pos"], found["a"]["end"], found["a"]["size"], found["a"]["homology"], found["a"]["kind"], found["a"]["dir1"]) == (100, 200, 99, 3, "DEL", None)
    assert (found["b"]["kind"], found["b"]["mate_chrom"], found["b"]["dir1"], found["b"]["dir2"], found["b"]["qual"]) == ("BND", "chr2", 0, 0, None)
    regions = text.read_assembly_regions(spark, put(tmp_path / "r.bed", "chr1\t5\t9\t3\nchr2\t1\t4\t3\nchr1\t7\t8\t4\n")).orderBy("cluster").collect()
    assert [(r["cluster"], r["region_count"], [tuple(x) for x in r["regions"]]) for r in regions] == [(3, 2, [("chr1", 5, 9), ("chr2", 1, 4)]), (4, 1, [("chr1", 7, 8)])]


def test_exclusions(spark):
    gaps = spark.createDataFrame([("chr1", 5, 9)], "chrom string, start long, end long")
    repeats = spark.createDataFrame([("chr2", 1, 4, "Satellite/centr"), ("chr2", 5, 6, "LINE")], "chrom string, start long, end long, class string")
    chroms = spark.createDataFrame([("chr1", 50), ("chrUn", 20)], "chrom string, length long")
    assert sorted(map(tuple, text.exclusion_regions(gaps, repeats, chroms).collect())) == [("1", 5, 9, "gap"), ("2", 1, 4, "repeat"), ("Un", 0, 20, "other")]


def test_sinks(spark, tmp_path):
    bins = spark.createDataFrame([(0, 1, b, None if b == 3 else float(b)) for b in range(6)], "sample long, chrom long, bin long, depth double")
    assert sorted((r["first"], r["values"]) for r in sinks.track_runs(bins).collect()) == [(0, [0.0, 1.0, 2.0]), (4, [4.0, 5.0])]
    sinks.write_tracks(bins, 10, str(tmp_path / "tracks"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "tracks" / "sample=0")).collect()] == ["fixedStep chrom=1 start=1 step=10 span=10", "0.0", "1.0", "2.0", "fixedStep chrom=1 start=41 step=10 span=10", "4.0", "5.0"]
    segments = spark.createDataFrame([(1, 0, 5, 2), (1, 5, 7, 6), (1, 7, 9, 3)], "chrom long, begin long, end long, state long")
    sinks.write_copy_numbers(segments, 10, str(tmp_path / "cn"))
    assert sorted(map(tuple, spark.read.csv(str(tmp_path / "cn"), sep="\t").collect())) == [("1", "0", "50", "2"), ("1", "70", "90", "3")]
    bases = spark.createDataFrame([("s", 1, 2, 70, True), ("s", 1, 3, 20, False)], "sample string, chrom long, state long, bases long, is_mode boolean")
    assert json.loads(sinks.copy_number_summary(bases).first()["value"]) == {"sample": "s", "chroms": [{"chrom": 1, "most_common": 2, "bases": {"2": 70, "3": 20}}]}
    support = spark.createDataFrame([("v", "s", "b"), ("v", "s", "a"), ("v", "t", "c")], "variant string, sample string, qname string")
    assert json.loads(sinks.supporting_reads(support).first()["value"]) == {"variant": "v", "samples": {"s": ["a", "b"], "t": ["c"]}}
    records = spark.createDataFrame([("1", 20, "b", "A", "T", 3.0, "PASS", ".", ["0/1"]), ("1", 5, "a", "A", "T", None, "PASS", ".", ["1/1"])], "chrom string, pos long, id string, ref string, alt string, qual double, filter string, info string, gt array<string>")
    lines = [r["value"] for r in sinks.vcf_lines(records, ["s"], {"GT": "gt"}).collect()]
    assert lines[2:] == ["1\t5\ta\tA\tT\t.\tPASS\t.\tGT\t1/1", "1\t20\tb\tA\tT\t3.0\tPASS\t.\tGT\t0/1"] and lines[1].endswith("FORMAT\ts")


def test_stage_needs_its_marker(spark, tmp_path):
    folder = str(tmp_path / "stage")
    spark.range(3).write.parquet(f"{folder}/loose")
    with pytest.raises(Exception):
        sinks.read_stage(spark, folder, "loose")
    sinks.write_stage({"rows": spark.range(4)}, folder)
    assert sinks.read_stage(spark, folder, "rows").count() == 4
    with pytest.raises(ValueError):
        sinks.read_stage(spark, folder, "loose")
    with pytest.raises(Exception):
        sinks.write_stage({"rows": spark.range(4)}, folder)


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, i * 37 % 500, i * 37 % 500 + 90) for i in range(60)], "chrom long, start long, end long")
    rows.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streams.depth_bins(stream, 100).writeStream.format("memory").queryName("stream_depth").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(tuple, spark.table("stream_depth").collect())) == sorted(map(tuple, sweep.depth_bins(rows, 100).collect()))


def test_stream_windows(spark, tmp_path):
    rows = spark.createDataFrame([(1, f"2024-01-01 00:{m:02d}:00") for m in (0, 3, 4, 12, 13)], "k long, t string").withColumn("t", F.col("t").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = streams.event_windows(stream, "t", ("k",), "5 minutes", "1 hour").writeStream.format("memory").queryName("stream_windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r["events"] for r in spark.table("stream_windows").collect()) == [2, 3]
