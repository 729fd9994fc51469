"""What reads' words say about alleles: near-duplicate alleles are told apart, and genotypes follow the bases."""

import random
from collections import defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strandline.operators import allele_words, genotype, pools
from strandline.plans import pipelines
from strandline.settings import DiscoverSettings, JointCallSettings

TURN = str.maketrans("ACGT", "TGCA")
QUICK = DiscoverSettings(bin_size=1000, disable_cnv=True, disable_large_insertions=True)
READS = "sample long, qname string, seg long, chrom long, start long, end long, strand long, mapq long, flag long, cigar string, seq string"


def bases(n, seed):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def brute(pieces, alleles, k):
    def of(seq):
        cut = [seq[i : i + k] for i in range(len(seq or "") - k + 1)]
        return {min(w, w[::-1].translate(TURN)) for w in cut if not set(w) - set("ACGT")}

    has, read_words = defaultdict(lambda: defaultdict(set)), defaultdict(set)
    for g, a, s in alleles:
        has[g][a] |= of(s)
    for g, r, s in pieces:
        read_words[g, r] |= of(s)
    out = []
    for (g, r), found in read_words.items():
        telling = {w for w in found if 0 < sum(w in h for h in has[g].values()) < len(has[g])}
        out += [(g, r, a, len(telling & h), len(telling)) for a, h in has[g].items() if telling & h]
    return sorted(out)


def test_brute_force_and_defined_cases(spark):
    """Null, empty and short sequences, letters beyond the four, repeated rows, several rows an allele, a group of one allele, turned reads."""
    seq = bases(1500, 1)
    alleles = [(1, 0, seq), (1, 1, seq[:700] + seq[760:]), (1, 2, seq[:703] + seq[763:]), (1, 2, "N" * 50 + seq[:40]), (1, 3, None), (2, 0, seq), (3, 0, seq), (3, 1, seq), (4, 0, ""), (4, 1, "ACGT")]
    pieces = [(g, i, s) for g in (1, 2, 3, 4, 5) for i, s in enumerate([seq[500:900], seq[:700] + seq[760:900], (seq[600:703] + seq[763:900])[::-1].translate(TURN), None, "", "ACG", seq[650:720] + "N" + seq[721:], seq * 4])]
    pieces += [(1, 0, seq[500:900]), (1, 0, seq[690:1200]), (1, 9, "N" * 2000)]
    a, p = spark.createDataFrame(alleles, "group long, allele long, seq string"), spark.createDataFrame(pieces, "group long, read long, seq string")
    for k in (11, 25, 31):
        assert sorted(map(tuple, allele_words.allele_support(p, a, k).select("group", "read", "allele", "hits", "told").collect())) == brute(pieces, alleles, k)
    assert allele_words.allele_support(p.limit(0), a).count() == 0 == allele_words.allele_support(p, a.limit(0)).count()
    with pytest.raises(ValueError):
        allele_words.words(a, ["group"], 32)


CHROM = bases(20_000, 7)
BREAKS = ((5000, 5060), (5003, 5063))


def chunks(spark):
    return spark.createDataFrame([(1, 0, CHROM)], "chrom long, start long, seq string")


def variants_of(spark, rows):
    names = "sv long, pool long, kind string, chrom1 long, start1 long, end1 long, dir1 long, chrom2 long, start2 long, end2 long, dir2 long, insert_high long"
    return spark.createDataFrame(rows, names)


def test_near_duplicates_are_told_apart(spark):
    """Reads of two deletions three bases apart, all aligned to the first one, and of the reference: the bases decide."""
    best = variants_of(spark, [(i + 1, 1, "DEL", 1, s - 1, s, 0, 1, e - 1, e, 1, 0) for i, (s, e) in enumerate(BREAKS)] + [(3, 2, "DEL", 1, 8999, 9010, 0, 1, 9099, 9110, 1, 0)])
    numbered = best.select("sv", "pool", F.when(F.col("sv") == 2, 1).otherwise(0).cast("long").alias("haplotype"))
    reads, true = [], {}
    for n in range(24):
        s, kind = 4600 + 12 * n, n % 3
        if kind == 2:
            seq, text, end = CHROM[s : s + 700], "700=", s + 700
        else:
            d, e = BREAKS[kind]
            seq, end = CHROM[s:d] + CHROM[e : e + 700 - (d - s)], s + 760
            text = f"{5000 - s}=60D{s + 700 - 5000}="
        reads.append((0, f"r{n}", 1, s, end, text, seq[:600] + "A" + seq[601:]))
        true[f"r{n}"] = kind
    reads += [(0, "bare", 1, 4900, 5200, None, None), (0, "ninth", 1, 8500, 9500, "1000=", CHROM[8500:9500])]
    used = spark.createDataFrame(reads, "sample long, qname string, chrom long, start long, end long, cigar string, seq string")
    scores = pipelines.word_scores(best, numbered, used, chunks(spark))
    told = genotype.best_alleles(scores.select(F.struct("sv", "qname").alias("read"), "condition", "allele", "score"))
    names = used.select("qname", F.xxhash64("qname").alias("_q"))
    found = {(r["sv"], r["qname"]): r["allele"] for r in told.select("read.*", "allele").withColumnRenamed("qname", "_q").join(names, "_q").collect()}
    want = {(sv, q): genotype.REF if k == 2 else genotype.ALT if k == sv - 1 else genotype.OVERLAP for q, k in true.items() for sv in (1, 2)}
    assert found == want
    assert {(r["sv"], r["other"]) for r in scores.filter("other is not null").collect()} <= {(1, 1), (2, 0)}


@pytest.mark.parametrize("dirs", [(0, 0), (1, 1), (1, 0), (0, 1)])
def test_alleles_join_the_sides_of_the_ends(spark, dirs):
    best = variants_of(spark, [(1, 1, "BND", 1, 3999, 4000, dirs[0], 1, 6999, 7000, dirs[1], 0)])
    found = {r["allele"]: r["seq"] for r in pipelines.allele_sequences(best, best.select("sv", "pool", F.lit(0).cast("long").alias("haplotype")), chunks(spark), 50).filter("allele = 1").collect()}
    turn = lambda s: s[::-1].translate(TURN)
    before, behind = (CHROM[3950:4000], CHROM[6950:7000]), (CHROM[4000:4050], CHROM[7000:7050])
    want = {(0, 1): before[0] + behind[1], (0, 0): before[0] + turn(before[1]), (1, 1): turn(behind[1]) + behind[0], (1, 0): before[1] + behind[0]}
    assert found[1] == want[dirs]


def test_genotypes_follow_the_bases(spark):
    """Sample 1's reads of a deletion end in short clips, which are no evidence of it: only their bases show it."""
    (d, e), rows = BREAKS[0], []
    for n in range(8):
        s = 4400 + 40 * n
        rows.append((0, f"a{n}", 0, 1, s, s + 1060, 0, 60, 0, f"{d - s}=60D{1000 - (d - s)}=", CHROM[s:d] + CHROM[e : e + 1000 - (d - s)]))
        rows.append((0, f"b{n}", 0, 1, s, s + 1000, 0, 60, 0, "1000=", CHROM[s : s + 1000]))
        rows.append((1, f"c{n}", 0, 1, s, d, 0, 60, 0, f"{d - s}=20S", CHROM[s:d] + CHROM[e : e + 20]))
    reads = spark.createDataFrame(rows, READS).repartition(2)
    stage = pipelines.discover(reads, settings=QUICK)
    counts = {}
    for name, given in (("bases", chunks(spark)), ("none", None)):
        calls = pipelines.joint_call(reads, stage, replace(JointCallSettings(), disable_cnv=True), reference=given)["calls"]
        counts[name] = {r["sample"]: (r["gt"], r["ref"], r["alt"]) for r in calls.collect()}
    assert counts["bases"][0] == counts["none"][0] == (1, 8, 8)
    assert counts["bases"][1] == (2, 0, 8) and counts["none"][1][2] == 0


def test_equal_places_with_other_inserts_stay_apart(spark):
    """By brute force over members of many pools: order, samples, words of the smaller one, members without a contig."""
    r = random.Random(9)
    left, right, inserts = bases(80, 2), bases(80, 3), [bases(60, 10 + i) for i in range(3)]
    inserts.append(inserts[0][:40] + bases(20, 20))
    rows, contigs = [], []
    for i in range(400):
        kind = r.choice((0, 1, 2, 3, None))
        rows.append((i // 10, i, r.randrange(6), 100 + r.randrange(3), 200 + r.randrange(30), 60, r.randrange(5), 220))
        if kind is not None:
            contigs.append((i, left + inserts[kind] + right))
    df = spark.createDataFrame(rows, "pool long, id long, sample long, start long, end long, size long, reads long, contig_length long")
    told = allele_words.novel_words(spark.createDataFrame(contigs, "id long, seq string"), spark.createDataFrame([(i, left + right) for i, _ in contigs], "id long, seq string"))
    words = {x["id"]: set(x["words"]) for x in told.collect()}
    assert all(len(w) in (84, 83, 82, 81) for w in words.values())
    want = {}
    for pool in range(40):
        heads = []
        for m in sorted((x for x in rows if x[0] == pool), key=lambda x: (x[3], x[4], x[2], x[1])):
            for h in heads:
                f, a, b = h[0], words.get(h[0][1]), words.get(m[1])
                if m[2] not in {x[2] for x in h} and abs(f[4] - m[4]) <= 10 and abs(f[3] - m[3]) <= 10 and (a is None or b is None or 2 * len(a & b) >= min(len(a), len(b))):
                    h.append(m)
                    break
            else:
                heads.append([m])
        for h in heads:
            best = max(h, key=lambda x: (x[6], x[7], -h.index(x)))
            want |= {x[1]: best[1] for x in h}
    found = pools.merge_close(df.join(told, "id", "left")).collect()
    assert {x["id"]: x["merged_id"] for x in found} == want
    assert want != {x["id"]: x["merged_id"] for x in pools.merge_close(df).collect()}
