"""VCF lines with the reference at hand: real bases in REF and breakend strings, homology of deletions, N where the reference ends."""

import random

from strandline.sources import sinks

RECORD = "id string, chrom long, pos long, mate_chrom long, end long, dir1 long, dir2 long, kind string, qual double, is_inversion boolean, filter string, event string, claim string"
CALL = "sv long, sample long, ref long, alt long, overlap long, gt long, gq long, pl0 long, pl1 long, pl2 long, phase_set long, is_first boolean, haploid boolean"


def test_bases(spark):
    r = random.Random(8)
    one = "".join(r.choice("ACGT") for _ in range(400))
    seq = {1: one[:200] + "GATTACA" * 12 + "C" + one[200:], 2: one[::-1]}
    rows = [("1", 1, 199, 1, 220, 0, 1, "DEL"), ("2", 1, 50, 1, 90, 1, 0, "DUP"), ("3", 1, 60, 2, 70, 0, 1, "BND"), ("4", 2, 5000, 2, 5100, 0, 1, "DEL"), ("5", 1, 10, 1, 20, 0, 1, "DEL")]
    records = spark.createDataFrame([(*x, 50.0, False, "PASS", None, "J") for x in rows], RECORD)
    calls = spark.createDataFrame([(i, 0, 3, 4, 0, 1, 20, 30, 0, 40, None, False, False) for i in range(1, 6)], CALL)
    contigs = spark.createDataFrame([(1, "chr1", 500), (2, "chr2", 500)], "chrom long, name string, length long")
    chunks = spark.createDataFrame([(c, 0, s) for c, s in seq.items()], "chrom long, start long, seq string")
    tables = {"records": records, "calls": calls}
    lines = [x["value"].split("\t") for x in sinks.joint_vcf(tables, contigs, reference=chunks).collect() if not x["value"].startswith("#")]
    found = {x[2]: x for x in lines}
    for x in lines:
        s, p = seq[int(x[0][3:])], int(x[1])
        assert x[3] == (s[p - 1] if p <= len(s) else "N")
    assert found["3:0"][4] == f"{seq[1][60]}[chr2:72[" and found["3:1"][4] == f"]chr1:61]{seq[2][71]}"
    # three units go of twelve: the rest of the repeat follows
    assert "HOMLEN=63;HOMSEQ=" + "GATTACA" * 9 in found["1"][7]
    assert "HOM" not in found["2"][7] and "HOM" not in found["4"][7]
    assert {x["value"].split("\t")[3] for x in sinks.joint_vcf(tables, contigs).collect() if not x["value"].startswith("#")} == {"N"}
