"""Queries over segmentation, genotypes, matching and records, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variants
from ..operators import allele_words, genotype, hmm, matching, pools, records, sv_groups, sweep
from ..session import settle
from .views import BASES_SQL, bases, view, with_recursive, with_views

BIN = 1000


def segmentation_bins(spark: SparkSession, d: str) -> DataFrame:
    """(sample, chrom, bin, depth, reduction, kind): depth in reads a base, a part of the bins excluded."""
    bins = sweep.depth_bins(view(spark, d, "v_read"), BIN, ("sample", "chrom"))
    depth = F.when(F.col("bin") % 17 != 0, F.col("bases") / BIN * (F.floor((F.col("bin") + F.col("sample")) / 30) % 4) / 2)
    return bins.select("sample", "chrom", "bin", depth.alias("depth"), F.lit(1.0).alias("reduction"), F.lit(0).alias("kind"))


def _haploid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, 1.25) for i in range(3)], "sample long, haploid double")


def best_states(spark: SparkSession, d: str) -> DataFrame:
    """The best state path of each sample and chromosome, as segments."""
    return hmm.segments(hmm.segment_states(segmentation_bins(spark, d), _haploid(spark)))


def converged_states(spark: SparkSession, d: str) -> DataFrame:
    states, haploid = hmm.converge(segmentation_bins(spark, d))
    return hmm.segments(states).join(haploid.withColumn("haploid", F.round("haploid", 6)), "sample")


def synced_boundaries(spark: SparkSession, d: str) -> DataFrame:
    # bins and paths are read several times
    return hmm.joint_segments(settle(segmentation_bins(spark, d)), _haploid(spark), 5)


def emission_table(spark: SparkSession, d: str) -> DataFrame:
    """ln P(depth | state) of the depths that the regions' sizes give, between whole numbers too, at haploid depth 1.5."""
    cells = view(spark, d, "v_region").select(F.col("region_id").alias("bin"), ((F.col("end") - F.col("start")) % 970 / F.lit(37.0)).alias("depth"), F.lit(1.0).alias("reduction"), F.lit(1.5).alias("haploid"))
    found = hmm.cell_emissions(cells, ["bin"])
    return found.select("bin", *[F.round(f"e{s}", 6).alias(f"s{s}") for s in range(hmm.UNKNOWN)])


def _segments(spark: SparkSession, d: str) -> DataFrame:
    """Tiling segments of 3 samples from the read bins: runs of whole depth, as states 0..6."""
    bins = sweep.depth_bins(view(spark, d, "v_read"), BIN, ("sample", "chrom"))
    return sweep.run_lengths(bins.select("sample", "chrom", "bin", F.least(F.floor(F.col("bases") / 1500), F.lit(6)).cast("long").alias("state")), ["sample", "chrom"], "bin", "state")


def copy_boundaries(spark: SparkSession, d: str) -> DataFrame:
    return hmm.boundaries(_segments(spark, d))


def boundary_clusters(spark: SparkSession, d: str) -> DataFrame:
    return hmm.boundary_clusters(copy_boundaries(spark, d), 5)


def breakend_kinds(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "v_bpo").select(F.col("evidence").alias("sample"), F.col("chrom1").alias("chrom"), F.col("start1").alias("pos"), (F.col("dir2") + 1).alias("kind"))
    return hmm.breakend_kinds(b, BIN)


def high_copies(spark: SparkSession, d: str) -> DataFrame:
    segs = _segments(spark, d).withColumn("state", F.when(F.col("state") >= 2, hmm.HIGH).otherwise(F.col("state")))
    return hmm.high_copies(segs, segmentation_bins(spark, d), _haploid(spark), least_bins=1).withColumn("high_copies", F.round("high_copies", 6))


def copy_quality(spark: SparkSession, d: str) -> DataFrame:
    segs = best_states(spark, d)
    return hmm.copy_quality(hmm.state_likelihoods(segs, segmentation_bins(spark, d), _haploid(spark)))


def _counts(spark: SparkSession, d: str) -> DataFrame:
    o = view(spark, d, "v_order").select("sv", (F.col("cust") % 5).alias("sample"), "status")
    count = lambda s: F.count_if(F.col("status") == s)
    rows = o.groupBy("sv", "sample").agg((count("F") - F.min(F.lit(2))).alias("_f"), count("O").alias("alt"), count("P").alias("overlap"))
    return rows.select("sv", "sample", F.greatest(F.lit(0), F.col("_f")).alias("ref"), F.when(F.col("sv") % 3 == 0, 0).otherwise(F.col("alt")).cast("long").alias("alt"), "overlap", (F.col("sample") == 4).alias("haploid"))


def genotype_likelihoods(spark: SparkSession, d: str) -> DataFrame:
    scored = genotype.genotypes(_counts(spark, d))
    return scored.select("sv", "sample", "pl0", "pl1", "pl2", "gt", "gq")


def joint_quality(spark: SparkSession, d: str) -> DataFrame:
    return genotype.joint_quality(genotype.genotypes(_counts(spark, d)), "sv").select("sv", F.round("qual", 3).alias("qual"))


def genotype_texts(spark: SparkSession, d: str) -> DataFrame:
    scored = genotype.genotypes(_counts(spark, d))
    copies = F.when(F.col("sv") % 4 != 0, F.col("sv") % 3)
    return scored.select("sv", "sample", variants.genotype_text(F.col("gt"), F.col("haploid")).alias("text"), variants.cnv_genotype(copies, F.col("haploid")).alias("cnv_text"), genotype.ploidy(copies).alias("ploidy"))


def best_alleles(spark: SparkSession, d: str) -> DataFrame:
    read = view(spark, d, "v_read")
    reserved = F.when(F.col("qname") % 5 == 0, 1).when(F.col("qname") % 5 == 1, 2).cast("long")
    scores = read.select(F.col("qname").alias("read"), (F.col("seg") % 4).alias("condition"), (F.col("start") % 3).alias("allele"), F.when(F.col("mapq") > 9, F.col("mapq") % 4 - 1).alias("score"), reserved.alias("reserved"), (F.col("qname") % 3 != 0).alias("alt_on_top"))
    return genotype.best_alleles(scores)


def allele_counts(spark: SparkSession, d: str) -> DataFrame:
    best = best_alleles(spark, d)
    return genotype.allele_counts(best.select((F.col("read") % 300).alias("sv"), (F.col("read") % 3).alias("sample"), "allele"))


def sample_sv_order(spark: SparkSession, d: str) -> DataFrame:
    """Groups of four orders as variants on two haplotypes; samples that have some, all or none of these."""
    orders = view(spark, d, "v_order")
    svs = orders.select(F.floor(F.col("key") / 16).alias("group"), F.col("key").alias("sv"), (F.col("key") % 2).alias("haplotype"))
    sample = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("sample")
    each = svs.select("group").distinct().select("group", sample)
    native = each.withColumn("haplotype", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(1).cast("long")))).filter((F.col("group") + F.col("sample") + F.col("haplotype")) % 3 != 0)
    ranked = native.withColumn("rank", F.when(F.col("group") % 2 == 0, F.col("haplotype")).otherwise(1 - F.col("haplotype")))
    return genotype.sample_sv_order(svs, ranked, each.withColumn("ploidy", F.when((F.col("group") + F.col("sample")) % 4 == 0, 1).otherwise(2)))


def reserved_counts(spark: SparkSession, d: str) -> DataFrame:
    """Reads named by their part and order, at groups of variants that share them."""
    read = view(spark, d, "v_read")
    assigned = read.select((F.col("qname") % 400).alias("group"), "sample", (F.col("seg") % 3).alias("place"), (F.col("qname") % 400 * 3 + F.col("seg") % 3).alias("sv"), (F.col("seg") % 2).alias("haplotype"), F.when(F.col("mapq") % 4 != 0, 1 - F.col("seg") % 2).alias("other"), (F.col("seg") % 3 == 2).alias("shared"), F.concat(F.lit("r"), (F.col("start") % 7).cast("string")).alias("qname"), (F.col("mapq") % 3).alias("allele"), (F.col("mapq") % 5 == 0).alias("tie"), F.when(F.col("qname") % 400 % 9 == F.col("seg") % 3, genotype.BLOCKED).otherwise(genotype.NATIVE).alias("relation"))
    return genotype.reserved_counts(assigned, passes=2)


def guest_haplotypes(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "v_read")
    return genotype.guest_haplotypes(r.select((F.col("qname") % 200).alias("group"), "sample", (F.col("start") % 3).alias("haplotype"), (F.col("mapq") / 64.0).alias("score")))


def phase_sets(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "v_region")
    calls = r.select("region_id", F.floor(F.col("region_id") / 4).cast("long").alias("group"), (F.col("region_id") % 2).alias("sample"), (F.col("region_id") % 3 % 2).alias("haplotype"), "start", (F.col("value") % 3).alias("gt"))
    return genotype.phase_sets(calls).select("region_id", "phase_set", "is_first")


def absorbed_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Groups of eight variants in three samples; of three haplotypes the first two are the sample's own."""
    sample = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("sample")
    count = lambda a, m: ((F.col("sv") * a + F.col("sample")) % m).cast("long")
    v = view(spark, d, "v_sv").select("sv", sample).withColumns({"ref": F.when((F.col("sv") + F.col("sample")) % 3 == 0, 0).otherwise(count(3, 11)), "alt": count(5, 13), "overlap": F.when(F.col("sv") % 4 > 1, count(1, 4)).otherwise(0), "haploid": F.lit(False)})
    scored = genotype.genotypes(v)
    c = scored.select("*", F.floor(F.col("sv") / 8).cast("long").alias("group"), F.when(F.col("sv") % 3 < 2, F.col("sv") % 3).alias("rank"), (F.col("sv") * 37 % 100).alias("start"), (F.col("sv") * 37 % 100 + 30).alias("end"), (F.col("sv") % 10 == 0).alias("replicated"))
    return genotype.absorb_overlaps(c).select("sv", "sample", "ref", "alt", "overlap", "gt_excluded", "pl0", "pl1", "pl2", "gt", "gq")


def excluded_everywhere(spark: SparkSession, d: str) -> DataFrame:
    """Variants that all of their samples rule out, and the filter that follows."""
    c = view(spark, d, "v_read").select((F.col("qname") % 2000).alias("sv"), "sample", (F.col("mapq") > 30).alias("carried"), (F.col("start") % 5 > 0).alias("gt_excluded"))
    found = genotype.gt_excluded(c)
    return found.select("sv", "all_excluded", variants.sv_filter(F.col("sv") % 6 == 0, F.col("all_excluded")).alias("filter"))


def resolved_replicates(spark: SparkSession, d: str) -> DataFrame:
    """Sixteen variants a group at five spots, in three samples."""
    sample = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("sample")
    v = view(spark, d, "v_sv").select("sv", sample)
    count = lambda a, m: ((F.col("sv") * a + F.col("sample")) % m).cast("long")
    calls = v.select("sv", "sample", F.floor(F.col("sv") / 16).cast("long").alias("group"), F.col("sv").alias("place"), (F.col("sv") * 7 % 5).alias("spot"), ((F.col("sv") + F.col("sample")) % 3 != 0).alias("carried"), F.when(F.col("sample") == 0, 1).otherwise(2).alias("haplotypes"), count(3, 11).alias("ref"), count(5, 13).alias("alt"), count(1, 4).alias("overlap"))
    return pools.resolve_replicates(calls, ["spot"]).select("sv", "sample", "ref", "alt", "overlap", "on_several", "within_replicate", "replicated")


def top_supported(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "v_bpo").groupBy(F.col("start1").alias("cluster"), F.col("inserted").alias("assembly")).agg(F.count(F.lit(1)).alias("reads"))
    return genotype.top_supported(b, 2).select("cluster", "assembly", "reads", F.col("rank").cast("long").alias("rank"))


def downsampled(spark: SparkSession, d: str) -> DataFrame:
    return genotype.downsample(view(spark, d, "v_bpo").select("obs", F.col("start1").alias("cluster")), ["cluster"], ["obs"], 2)


def one_per_read(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "v_read").select("qname", "seg", F.col("start").alias("pos"), (F.col("end") - F.col("start")).alias("length"), (F.col("strand") == 0).alias("is_primary"))
    return genotype.one_per_read(r)


def _calls(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    svs, cnvs = view(spark, d, "v_sv"), view(spark, d, "v_cnv")
    sample = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("sample")
    calls = svs.select("sv", sample).withColumn("gt", F.when(F.col("sv") % 13 != 0, (F.col("sv") + F.col("sample")) % 3))
    states = cnvs.select("cnv", sample).select("cnv", "sample", ((F.col("cnv") * 5 + F.col("sample")) % 4).alias("copies"), F.lit(2).cast("long").alias("expected"))
    return svs, cnvs, calls, states


def sv_cnv_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.sv_cnv_match(*_calls(spark, d))


def forced_breakends(spark: SparkSession, d: str) -> DataFrame:
    svs = _calls(spark, d)[0]
    return matching.to_breakend_pairs(svs, sv_cnv_match(spark, d)).select("sv", "forced_bnd")


def _tiling(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "v_cnv")
    return r.select(F.col("cnv").alias("segment"), "chrom", "start", "end", F.when(F.col("cnv") % 5 < 2, 1).otherwise(2).cast("long").alias("copies"), F.lit(2).cast("long").alias("expected"))


def power_boost(spark: SparkSession, d: str) -> DataFrame:
    segments = view(spark, d, "v_region").select(F.col("region_id").alias("segment"), "chrom", (F.col("start") - F.col("start") % 1000).alias("start"), (F.col("start") + 200_000).alias("end"))
    return matching.power_boost(view(spark, d, "v_sv"), segments)


def close_fit(spark: SparkSession, d: str) -> DataFrame:
    return matching.close_fit(view(spark, d, "v_sv"), _tiling(spark, d))


def inversions(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "v_bpo").filter("dir1 = dir2").select(F.col("obs").alias("id"), F.col("chrom1").alias("chrom"), F.col("start1").alias("start"), (F.col("start2") + 1).alias("end"), (F.col("obs") % 2).alias("dir"))
    return matching.inversions(b)


def inversion_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Some breakpoints have a neighbour on their haplotype; genotypes of three samples vote."""
    b = view(spark, d, "v_bpo").filter("dir1 = dir2").select(F.col("obs").alias("id"), F.col("chrom1").alias("chrom"), F.col("start1").alias("start"), (F.col("start2") + 1).alias("end"), (F.col("obs") % 2).alias("dir"))
    beside = F.when(F.col("id") % 3 == 0, F.col("id") + F.col("id") % 7 * 25)
    named = b.withColumns({"next1": beside, "side1": F.col("id") % 2 + 1, "next2": beside, "side2": F.col("id") % 5 % 2 + 1})
    sample = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("sample")
    calls = b.select("id", sample).filter((F.col("id") + F.col("sample")) % 4 != 0).select("id", "sample", F.when(F.col("id") % 9 != 0, (F.col("id") + F.col("sample") * F.col("id")) % 3).alias("gt"))
    return matching.genotype_conflicts(matching.inversions(named), calls)


def eligible_svs(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "v_sv")
    return s.filter(matching.eligible(F.col("kind"), F.col("end") - F.col("start"), F.col("sv") % 9 == 0, F.col("quality"), F.col("sv") % 10 == 0)).select("sv")


def deduped_records(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "v_bpo").select(F.col("obs").cast("string").alias("id"), F.col("chrom1").alias("chrom"), F.col("start1").alias("pos"), F.when(F.col("inserted") % 4 != 0, F.col("inserted")).alias("size"), (F.col("obs") % 11 == 0).alias("is_inversion"))
    return records.dedup(b, ["chrom", "pos", "size"])


def ordered_records(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "v_bpo").select(F.col("obs").cast("string").alias("id"), F.col("chrom1").alias("chrom"), F.col("start1").alias("pos"), (F.col("obs") % 11 == 0).alias("is_inversion"))
    return records.in_order(b)


def merged_segments(spark: SparkSession, d: str) -> DataFrame:
    s = _segments(spark, d).select("sample", "chrom", F.col("begin").alias("start"), "end", F.col("state").alias("copies"), F.lit(2).alias("expected"))
    return records.merge_equal_segments(s)


def accuracy_by_size(spark: SparkSession, d: str) -> DataFrame:
    out = records.accuracy(view(spark, d, "v_truth"))
    return out.withColumns({c: F.round(c, 6) for c in ("recall", "precision", "f1")})


def record_filters(spark: SparkSession, d: str) -> DataFrame:
    s = view(spark, d, "v_sv")
    tags = variants.filters(F.col("sv") % 9 == 0, F.col("quality"), F.col("sv") % 5 == 0, F.col("sv") % 25 == 0)
    return s.select("sv", tags.alias("filter"), variants.sv_filter(F.col("sv") % 6 == 0, F.col("sv") % 4 == 0).alias("sv_filter"), variants.sv_id("call", F.col("sv"), F.col("chrom")).alias("label"))


def breakend_strings(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "v_bpo")
    alt = variants.bnd_alt(F.col("dir1"), F.col("dir2"), F.lit("T"), F.lit("CT"), F.concat(F.lit("HLA:"), F.col("chrom2").cast("string")), F.col("start2") + 1)
    out = b.select("obs", alt.alias("alt"))
    parsed = variants.parse_bnd_alt(F.col("alt"), F.lit(0))
    return out.select("obs", "alt", *[c.alias(n) for n, c in parsed.items()])


def minor_fractions(spark: SparkSession, d: str) -> DataFrame:
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    counts = lines.groupBy(F.col("l_partkey").cast("long").alias("pos")).agg(F.count_if(F.col("l_returnflag") == "A").alias("ad0"), F.count_if(F.col("l_returnflag") == "R").alias("ad1"))
    return counts.select("pos", "ad0", "ad1", F.round(variants.minor_fraction(F.col("ad0"), F.col("ad1")), 6).alias("minor_fraction"))


_BINS_SQL = """, bins AS (SELECT sample, chrom, bin, CAST(sum(least("end", (bin + 1) * 1000) - greatest(start, bin * 1000)) AS BIGINT) AS bases
  FROM (SELECT sample, chrom, start, "end", unnest(generate_series(start // 1000, ("end" - 1) // 1000)) AS bin FROM v_read) GROUP BY ALL) """
_SEGS_SQL = _BINS_SQL + """, s AS (SELECT sample, chrom, bin, least(bases // 1500, 6) AS state FROM bins), f AS (SELECT *, CASE WHEN lag(state) OVER w = state THEN 0 ELSE 1 END AS n FROM s WINDOW w AS (PARTITION BY sample, chrom ORDER BY bin)),
  g AS (SELECT *, sum(n) OVER (PARTITION BY sample, chrom ORDER BY bin) AS k FROM f), segs AS (SELECT sample, chrom, min(bin) AS b, max(bin) + 1 AS e, min(state) AS state FROM g GROUP BY sample, chrom, k) """
_EDGES_SQL = _SEGS_SQL + ", p AS (SELECT *, lag(state) OVER (PARTITION BY sample, chrom ORDER BY b) AS was FROM segs), edges AS (SELECT sample, chrom, b AS bin, CAST(CASE WHEN was > state THEN 2 ELSE 1 END AS BIGINT) AS kind FROM p WHERE was <> 6 AND state <> 6) "
_COUNTS_SQL = ", c AS (SELECT sv, cust % 5 AS sample, greatest(0, count(*) FILTER (status = 'F') - 2) AS ref, CASE WHEN sv % 3 = 0 THEN 0 ELSE count(*) FILTER (status = 'O') END AS alt, count(*) FILTER (status = 'P') AS overlap FROM v_order GROUP BY sv, cust % 5) "
_R, _W, _H = repr(math.log(1 - 1e-5)), repr(math.log(1e-5)), repr(math.log(0.5))
def _scored_sql(counts: str, n: str = "") -> str:
    """Common table expressions up to gt: the genotypes of the table ``counts``, with names ending in ``n``."""
    return f""", l{n} AS (SELECT *, sample = 4 AS hap, ref + overlap AS r, (ref + overlap) * ({_R}) + alt * ({_W}) AS l0, CASE WHEN sample = 4 THEN '-inf'::DOUBLE ELSE (ref + overlap + alt) * ({_H}) END AS l1, (ref + overlap) * ({_W}) + alt * ({_R}) AS l2 FROM {counts}),
  t{n} AS (SELECT *, l0 + CASE WHEN hap THEN ln(1 - 5e-4) ELSE ln(1 - 7.5e-4) END AS p0, l1 + CASE WHEN hap THEN 0 ELSE ln(5e-4) END AS p1, l2 + CASE WHEN hap THEN ln(5e-4) ELSE ln(2.5e-4) END AS p2, greatest(l0, l1, l2) AS m FROM l{n}),
  pl{n} AS (SELECT *, CAST(least(999, round(greatest((l0 - m) / ln(10), -307) * -10)) AS BIGINT) AS pl0, CAST(least(999, round(greatest((l1 - m) / ln(10), -307) * -10)) AS BIGINT) AS pl1, CAST(least(999, round(greatest((l2 - m) / ln(10), -307) * -10)) AS BIGINT) AS pl2 FROM t{n}),
  gt{n} AS (SELECT *, CASE WHEN r + alt > 0 THEN CAST(CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS BIGINT) END AS gt, CASE WHEN r + alt > 0 THEN list_sort([pl0, pl1, pl2])[2] END AS gq FROM pl{n}) """


_GT_SQL = _COUNTS_SQL + _scored_sql("c")
_ALLELE_SQL = """, s AS (SELECT qname AS read, seg % 4 AS condition, start % 3 AS allele, CASE WHEN mapq > 9 THEN mapq % 4 - 1 END AS score FROM v_read),
  c AS (SELECT read, condition, max(score) FILTER (allele = 0) AS r, max(score) FILTER (allele = 1) AS a, max(score) FILTER (allele = 2) AS o, bool_or(allele = 2) AS has_o FROM s GROUP BY ALL),
  u AS (SELECT read, condition, 0 AS allele, r AS score FROM c UNION ALL SELECT read, condition, 1, a FROM c UNION ALL SELECT read, condition, 2, o FROM c WHERE has_o),
  k AS (SELECT *, row_number() OVER (PARTITION BY read, condition ORDER BY score DESC NULLS LAST, allele) AS k FROM u),
  p AS (SELECT x.read, x.condition, x.allele AS a1, x.score AS s1, y.allele AS a2, y.score AS s2, x.score IS NOT DISTINCT FROM y.score AS tied, CASE WHEN x.read % 5 = 0 THEN 1 WHEN x.read % 5 = 1 THEN 2 END AS reserved, x.read % 3 <> 0 AS on_top
    FROM k x JOIN k y ON x.read = y.read AND x.condition = y.condition AND x.k = 1 AND y.k = 2),
  q AS (SELECT *, tied AND a1 <> 0 AND a2 <> 0 AND CASE WHEN reserved IS NOT NULL THEN a2 = reserved ELSE NOT on_top AND a1 = 1 END AS swap FROM p),
  w AS (SELECT read, condition, CASE WHEN swap THEN a2 ELSE a1 END AS allele, CASE WHEN s1 >= 0 THEN s1 END AS score, CASE WHEN tied THEN CASE WHEN swap THEN a1 ELSE a2 END END AS other FROM q),
  j AS (SELECT *, row_number() OVER (PARTITION BY read ORDER BY allele = 0, score DESC NULLS LAST, condition) AS j FROM w),
  n AS (SELECT read, min(j) FILTER (j > 1 AND other IS NULL) AS j FROM j GROUP BY read),
  z AS (SELECT f.*, t.condition AS tc, t.allele AS ta, t.score AS ts FROM j f LEFT JOIN n ON n.read = f.read LEFT JOIN j t ON t.read = n.read AND t.j = n.j WHERE f.j = 1),
  v AS (SELECT *, coalesce(other IS NOT NULL AND ts IS NOT NULL AND ta = other, false) AS later FROM z),
  best AS (SELECT read, CASE WHEN later THEN tc ELSE condition END AS condition, CAST(CASE WHEN later THEN ta ELSE allele END AS BIGINT) AS allele, CASE WHEN later THEN ts ELSE score END AS score, NOT later AND other IS NOT NULL AS tie FROM v WHERE later OR score IS NOT NULL) """
_MATCH_SQL = """, n AS (SELECT sv, kind, cnv, c.chrom, c.start AS cs, c."end" AS ce, abs(v.start - c.start) + abs(v."end" - c."end") AS shift FROM v_sv v JOIN v_cnv c ON v.chrom = c.chrom AND abs(v.start - c.start) <= 8000 AND abs(v."end" - c."end") <= 8000 AND v.start < c."end" AND c.start < v."end"
    WHERE (least(v."end", c."end") - greatest(v.start, c.start)) / greatest(v."end" - v.start, c."end" - c.start, 100) >= 0.9),
  g AS (SELECT *, CASE WHEN sv % 13 <> 0 THEN (sv + sample) % 3 END AS gt, (cnv * 5 + sample) % 4 AS copies FROM n, range(0, 3) t(sample)),
  f AS (SELECT *, CASE WHEN gt IS NULL THEN NULL WHEN gt = 0 THEN CASE WHEN copies = 2 THEN NULL ELSE false END WHEN kind = 'DEL' THEN CASE WHEN gt = 1 THEN copies = 1 ELSE copies = 0 END ELSE copies > 2 END AS fit FROM g),
  t AS (SELECT sv, count(*) FILTER (fit) AS t, count(*) AS n, sum(CASE WHEN fit THEN shift ELSE 0 END) AS d FROM f WHERE fit IS NOT NULL GROUP BY sv),
  pairs AS (SELECT f.sv, cnv, chrom, cs, ce, shift, any_value(t) AS t, any_value(d) AS d, count(*) FILTER (fit) AS fits, count(*) FILTER (NOT fit) AS misfits FROM f JOIN t ON f.sv = t.sv WHERE fit IS NOT NULL AND t >= 0.5 * n GROUP BY f.sv, cnv, chrom, cs, ce, shift),
  c AS (SELECT chrom, row_number() OVER (PARTITION BY chrom ORDER BY cs, ce, cnv) AS i, list(sv ORDER BY t DESC, d, sv) AS svs FROM pairs GROUP BY chrom, cs, ce, cnv),
  step(chrom, i, lost) AS (SELECT DISTINCT chrom, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM c
    UNION ALL SELECT c.chrom, c.i, list_concat(step.lost, list_filter(c.svs, lambda x: NOT list_contains(step.lost, x))[2:]) FROM step JOIN c ON c.chrom = step.chrom AND c.i = step.i + 1),
  gone AS (SELECT unnest(arg_max(lost, i)) AS sv FROM step GROUP BY chrom),
  matched AS (SELECT sv, cnv, fits, misfits, shift FROM pairs WHERE fits > 0 AND sv NOT IN (SELECT sv FROM gone)) """
_ORDER_SQL = """, svs AS (SELECT DISTINCT key // 16 AS g, key AS sv, key % 2 AS h FROM v_order), each AS (SELECT g, sample FROM (SELECT DISTINCT g FROM svs), range(0, 3) t(sample)),
  native AS (SELECT g, sample, h, CASE WHEN g % 2 = 0 THEN h ELSE 1 - h END AS rank FROM each, range(0, 2) t(h) WHERE (g + sample + h) % 3 <> 0),
  a AS (SELECT e.g, e.sample, s.sv, n.rank, (SELECT count(*) FROM native m WHERE m.g = e.g AND m.sample = e.sample) AS have, CASE WHEN (e.g + e.sample) % 4 = 0 THEN 1 ELSE 2 END AS ploidy FROM each e JOIN svs s ON s.g = e.g LEFT JOIN native n ON n.g = e.g AND n.sample = e.sample AND n.h = s.h)
  SELECT g AS "group", sample, sv, CAST(CASE WHEN rank IS NOT NULL THEN 0 WHEN have >= ploidy THEN 2 ELSE 1 END AS BIGINT) AS relation, row_number() OVER (PARTITION BY g, sample ORDER BY rank NULLS LAST, sv) - 1 AS place FROM a"""
# the rule of emissions: capped at 20 haploid depths; between whole depths, interpolated; the highest state's mean follows the depth
_EMISSION_SQL = """, c AS (SELECT region_id AS bin, least(("end" - start) % 970 / 37.0::DOUBLE, 30.0) AS depth FROM v_region), k AS (SELECT *, floor(depth) AS lo, depth - floor(depth) AS f FROM c),
  m AS (SELECT *, s, CASE WHEN s = 0 THEN 0.015 WHEN s = 5 THEN greatest(7.5, round(depth)) ELSE 1.5 * s END AS mean FROM k, range(0, 6) t(s)),
  q AS (SELECT *, lo * ln(mean) - mean - lgamma(lo + 1) AS a, (lo + 1) * ln(mean) - mean - lgamma(lo + 2) AS b FROM m),
  e AS (SELECT bin, s, CASE WHEN f < 0.001 THEN a ELSE ln(f * exp(b) + (1 - f) * exp(a)) END AS v FROM q)
  SELECT bin, """ + ", ".join(f"round(max(v) FILTER (s = {i}), 6) AS s{i}" for i in range(6)) + " FROM e GROUP BY bin"

#: A sequence, two deletions three bases apart and the first of them with bases inserted, in both dialects.
_ALLELES = ("seq", "concat(substr(seq, 1, 200), substr(seq, 261))", "concat(substr(seq, 1, 203), substr(seq, 264))", "concat(substr(seq, 1, 200), 'GATTACA', substr(seq, 261))")


def allele_support(spark: SparkSession, d: str) -> DataFrame:
    """Four alleles of each document's bases, told apart by the words of reads cut from each around the variants, every other one turned."""
    alleles = bases(spark, d).select(F.col("doc").alias("group"), F.posexplode(F.array(*[F.expr(a) for a in _ALLELES])).alias("allele", "seq"))
    cut = alleles.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("seq", F.expr("substr(seq, 101 + 40 * i, 300)"))
    reads = cut.select("group", (F.col("allele") * 10 + F.col("i")).alias("read"), F.when(F.col("i") % 2 == 1, variants.rev_comp(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))
    return allele_words.allele_support(reads, alleles)


#: Inserted bases of three members at one place: the second one's are the first one's or others, the third one's overlap these more or less.
_INSERTED = "substr(seq, CAST(CASE WHEN i = 0 THEN 1 WHEN i = 1 THEN 1 + doc % 2 * 120 ELSE 1 + doc % 8 * 20 END AS INT), 60)"


def merged_by_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Members with equal places and sizes merge by the words that they add to the reference."""
    each = bases(spark, d).filter("length(seq) >= 700").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("id", F.col("doc") * 3 + F.col("i"))
    contigs = each.select("id", F.expr(f"concat(substr(seq, 401, 150), {_INSERTED}, substr(seq, 551, 150))").alias("seq"))
    told = allele_words.novel_words(contigs, each.select("id", F.expr("substr(seq, 401, 300)").alias("seq")))
    place = {"start": 550, "end": 551, "size": 160, "contig_length": 360}
    pooled = each.select(F.col("doc").alias("pool"), "id", F.col("i").alias("sample"), F.col("i").alias("reads"), *[F.lit(v).cast("long").alias(n) for n, v in place.items()])
    return pools.merge_close(pooled.join(told, "id"))


def _groups(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Groups of up to ten variants and three samples; a part of them breaks each rule."""
    r = view(spark, d, "v_region").withColumn("group", F.floor(F.col("region_id") / 10).cast("long"))
    sample = (F.col("region_id") % 3).alias("sample")
    group = {
        "regions": r.filter("region_id % 10 < 1 or (region_id % 10 = 1 and group % 4 = 0)").filter("group % 37 <> 5").select("group"),
        "haplotypes": r.filter("region_id % 10 < 4").select("group", (F.col("region_id") % 10).alias("haplotype"), F.when(F.col("group") % 4 == 0, 2).otherwise(1 + F.when(F.col("region_id") % 41 == 0, 1).otherwise(0)).alias("alignments")),
        "variants": r.filter("region_id % 10 = 0 or (group % 4 <> 0 and value > 2) or region_id % 29 = 0").select("group", F.col("region_id").alias("sv"), (F.col("region_id") % 10 % 5).alias("haplotype")),
        "lists": r.filter("region_id % 10 < 5 and value <> 4").select("group", sample, F.col("region_id").alias("place"), (F.floor(F.col("start") / 7) % 4 + F.when(F.col("region_id") % 31 == 0, 2).otherwise(0)).cast("long").alias("haplotype")),
        "copies": r.filter("region_id % 10 < 3 and region_id % 43 <> 0").select("group", sample, (1 + F.col("value") % 2).alias("copies")),
    }
    return group, spark.range(3).withColumnRenamed("id", "sample")


def group_violations(spark: SparkSession, d: str) -> DataFrame:
    return sv_groups.violations(*_groups(spark, d), treat_single_copy_as_haploid=True)


def sample_variants(spark: SparkSession, d: str) -> DataFrame:
    """The haplotypes that each sample's ploidy allows, and the variants on them, as text."""
    group, samples = _groups(spark, d)
    found = sv_groups.sample_variants(sv_groups.over_samples(group["lists"], group["copies"], True), group["variants"], samples)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return found.select("group", "sample", text("haplotypes"), text("variants"))


_GROUPS_SQL = """, r AS (SELECT *, region_id // 10 AS g, region_id % 10 AS k, region_id % 3 AS sample FROM v_region),
        regions AS (SELECT g FROM r WHERE (k < 1 OR (k = 1 AND g % 4 = 0)) AND g % 37 <> 5),
        haplotypes AS (SELECT g, k AS haplotype, CASE WHEN g % 4 = 0 THEN 2 WHEN region_id % 41 = 0 THEN 2 ELSE 1 END AS alignments FROM r WHERE k < 4),
        variants AS (SELECT g, region_id AS sv, k % 5 AS haplotype FROM r WHERE k = 0 OR (g % 4 <> 0 AND value > 2) OR region_id % 29 = 0),
        lists AS (SELECT g, sample, region_id AS place, (start // 7) % 4 + CASE WHEN region_id % 31 = 0 THEN 2 ELSE 0 END AS haplotype FROM r WHERE k < 5 AND value <> 4),
        copies AS (SELECT g, sample, 1 + value % 2 AS copies FROM r WHERE k < 3 AND region_id % 43 <> 0),
        ploidy AS (SELECT g, sample, CASE WHEN max(copies) = 1 THEN 1 ELSE 2 END AS p FROM copies GROUP BY ALL) """


ORACLES = {
    "merged_by_sequence": "WITH " + BASES_SQL + f""", e AS (SELECT doc, i, substr(seq, 401, 300) AS ref, concat(substr(seq, 401, 150), {_INSERTED}, substr(seq, 551, 150)) AS contig FROM (SELECT doc, seq, unnest([0, 1, 2]) AS i FROM v_base WHERE length(seq) >= 700)),
        k AS (SELECT doc, i, true AS mine, substr(contig, unnest(generate_series(1, length(contig) - 24)), 25) AS x FROM e UNION ALL SELECT doc, i, false, substr(ref, unnest(generate_series(1, length(ref) - 24)), 25) FROM e),
        w AS (SELECT doc, i, least(x, reverse(translate(x, 'ACGT', 'TGCA'))) AS word, bool_and(mine) AS novel FROM k GROUP BY ALL),
        n AS (SELECT e.doc, e.i, list(word) FILTER (novel) AS words FROM e JOIN w ON w.doc = e.doc AND w.i = e.i GROUP BY ALL),
        p AS (SELECT a.doc, a.i, b.i AS j, 2 * len(list_intersect(coalesce(a.words, []), coalesce(b.words, []))) >= least(len(coalesce(a.words, [])), len(coalesce(b.words, []))) AS alike FROM n a JOIN n b ON a.doc = b.doc AND a.i < b.i),
        h AS (SELECT doc, bool_or(alike) FILTER (i = 0 AND j = 1) AS a01, bool_or(alike) FILTER (i = 0 AND j = 2) AS a02, bool_or(alike) FILTER (i = 1 AND j = 2) AS a12 FROM p GROUP BY doc),
        g AS (SELECT doc, unnest([0, 1, 2]) AS i, unnest([0, CASE WHEN a01 THEN 0 ELSE 1 END, CASE WHEN a02 THEN 0 WHEN a12 AND NOT a01 THEN 1 ELSE 2 END]) AS head FROM h)
        SELECT doc * 3 + i AS id, doc * 3 + max(i) OVER (PARTITION BY doc, head) AS merged_id FROM g""",
    "group_violations": with_views("v_region", body=_GROUPS_SQL + """, e AS (SELECT DISTINCT g, (SELECT count(*) FROM regions x WHERE x.g = r.g) AS regions, (SELECT count(*) FROM variants x WHERE x.g = r.g) AS svs FROM r
            WHERE g IN (SELECT g FROM regions UNION SELECT g FROM haplotypes UNION SELECT g FROM variants UNION SELECT g FROM lists UNION SELECT g FROM copies)),
        w AS (SELECT g, 'no region' AS rule FROM e WHERE regions = 0
          UNION ALL SELECT g, 'alignments of a haplotype' FROM haplotypes JOIN e USING (g) WHERE alignments <> CASE WHEN regions = 1 THEN 1 ELSE 2 END
          UNION ALL SELECT g, 'copies of a sample' FROM e WHERE (SELECT count(*) FROM copies x WHERE x.g = e.g) <> 3 OR (SELECT count(DISTINCT sample) FROM copies x WHERE x.g = e.g) <> 3
          UNION ALL SELECT g, 'unknown haplotype of a sample' FROM lists l WHERE NOT EXISTS (SELECT 1 FROM haplotypes h WHERE h.g = l.g AND h.haplotype = l.haplotype)
          UNION ALL SELECT g, 'repeated haplotype of a sample' FROM (SELECT g FROM lists GROUP BY g, sample, haplotype HAVING count(*) > 1)
          UNION ALL SELECT g, 'more haplotypes than ploidy' FROM (SELECT g, sample, count(*) AS n FROM lists GROUP BY ALL) LEFT JOIN ploidy USING (g, sample) WHERE n > coalesce(p, 2)
          UNION ALL SELECT g, 'unknown haplotype of a variant' FROM variants l WHERE NOT EXISTS (SELECT 1 FROM haplotypes h WHERE h.g = l.g AND h.haplotype = l.haplotype)
          UNION ALL SELECT g, 'variants of a group of two regions' FROM e WHERE regions > 1 AND svs <> 1)
        SELECT g AS "group", rule, count(*) AS n FROM w GROUP BY ALL"""),
    "sample_variants": with_views("v_region", body=_GROUPS_SQL + """, n AS (SELECT *, row_number() OVER (PARTITION BY g, sample ORDER BY place, haplotype) AS i FROM lists),
        t AS (SELECT g, sample, place, haplotype FROM n LEFT JOIN ploidy USING (g, sample) WHERE i <= coalesce(p, 2)),
        h AS (SELECT g, sample, string_agg(haplotype, ',' ORDER BY place) AS haplotypes FROM t GROUP BY ALL),
        v AS (SELECT g, sample, string_agg(sv, ',' ORDER BY place, sv) AS variants FROM t JOIN variants USING (g, haplotype) GROUP BY ALL),
        x AS (SELECT DISTINCT g, unnest([0, 1, 2]) AS sample FROM variants)
        SELECT g AS "group", CAST(sample AS BIGINT) AS sample, coalesce(haplotypes, '') AS haplotypes, coalesce(variants, '') AS variants FROM x LEFT JOIN h USING (g, sample) LEFT JOIN v USING (g, sample)"""),
    "allele_support": "WITH " + BASES_SQL + ", a AS (" + " UNION ALL ".join(f"SELECT doc AS grp, {i} AS allele, {a} AS seq FROM v_base" for i, a in enumerate(_ALLELES)) + """),
        p AS (SELECT grp, allele * 10 + i AS read, i, substr(seq, 101 + 40 * i, 300) AS seq FROM (SELECT *, unnest(generate_series(0, 3)) AS i FROM a)),
        s AS (SELECT grp, allele AS name, true AS is_allele, seq FROM a UNION ALL SELECT grp, read, false, CASE WHEN i % 2 = 1 THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END FROM p),
        k AS (SELECT grp, name, is_allele, substr(seq, unnest(generate_series(1, length(seq) - 24)), 25) AS x FROM s),
        w AS (SELECT DISTINCT grp, name, is_allele, least(x, reverse(translate(x, 'ACGT', 'TGCA'))) AS word FROM k),
        t AS (SELECT grp, word FROM w WHERE is_allele GROUP BY ALL HAVING count(*) < 4),
        m AS (SELECT grp, name AS read, word FROM w JOIN t USING (grp, word) WHERE NOT is_allele),
        n AS (SELECT grp, read, count(*) AS told FROM m GROUP BY ALL)
        SELECT m.grp AS "group", m.read, w.name AS allele, count(*) AS hits, n.told FROM m JOIN w ON w.is_allele AND w.grp = m.grp AND w.word = m.word JOIN n ON n.grp = m.grp AND n.read = m.read GROUP BY ALL""",
    "emission_table": with_views("v_region", body=_EMISSION_SQL),
    "copy_boundaries": with_views("v_read", body=_EDGES_SQL + "SELECT * FROM edges"),
    "boundary_clusters": with_views("v_read", body=_EDGES_SQL + ", d AS (SELECT DISTINCT chrom, kind, bin FROM edges), z AS (SELECT *, CASE WHEN bin - lag(bin) OVER w <= 5 THEN 0 ELSE 1 END AS n FROM d WINDOW w AS (PARTITION BY chrom, kind ORDER BY bin)), y AS (SELECT *, sum(n) OVER (PARTITION BY chrom, kind ORDER BY bin) AS k FROM z), x AS (SELECT chrom, kind, bin, min(bin) OVER w AS cluster, count(*) OVER w AS m FROM y WINDOW w AS (PARTITION BY chrom, kind, k)) SELECT chrom, kind, cluster, bin FROM x WHERE m > 1"),
    "breakend_kinds": with_views("v_bpo", body="SELECT evidence AS sample, chrom1 AS chrom, (start1 + 500) // 1000 AS bin, CAST(CASE WHEN min(dir2) = max(dir2) THEN min(dir2) + 1 ELSE 0 END AS BIGINT) AS kind FROM v_bpo GROUP BY ALL"),
    "high_copies": with_views("v_read", body=_SEGS_SQL + ", h AS (SELECT * FROM segs WHERE state >= 2 AND state <> 6 UNION ALL SELECT * FROM segs WHERE state = 6), x AS (SELECT h.sample, h.chrom, h.b, h.e, count(*) FILTER (bin % 17 <> 0) AS used, avg(CASE WHEN bin % 17 <> 0 THEN bases / 1000 * ((bin + sample) // 30 % 4) / 2 END) AS mean FROM h JOIN bins USING (sample, chrom) WHERE bins.bin >= b AND bins.bin < e GROUP BY ALL) SELECT sample, chrom, b AS \"begin\", e AS \"end\", used, round(CASE WHEN used >= 1 AND used >= 0.8 * (e - b) THEN greatest(5.0, mean / 1.25) END, 6) AS high_copies FROM x"),
    "genotype_likelihoods": with_views("v_order", body=_GT_SQL + "SELECT sv, sample, pl0, pl1, pl2, gt, gq FROM gt"),
    "joint_quality": with_views("v_order", body=_GT_SQL + ", w AS (SELECT sv, greatest(p0, p1, p2) AS top, p0, p1, p2 FROM gt), z AS (SELECT sv, exp(p0 - top) / (exp(p0 - top) + exp(p1 - top) + exp(p2 - top)) AS p FROM w) SELECT sv, round(greatest(0.0, least(999.0, -10 * greatest(CASE WHEN exp(sum(ln(greatest(p, 1e-300)))) > 0 THEN log10(exp(sum(ln(greatest(p, 1e-300))))) ELSE -307 END, -307))), 3) AS qual FROM z GROUP BY sv"),
    "genotype_texts": with_views("v_order", body=_GT_SQL + ", x AS (SELECT *, CASE WHEN sv % 4 <> 0 THEN sv % 3 END AS copies FROM gt) SELECT sv, sample, CASE WHEN gt IS NULL THEN CASE WHEN hap THEN '.' ELSE './.' END WHEN hap THEN CASE WHEN gt = 2 THEN '1' ELSE '0' END WHEN gt = 0 THEN '0/0' WHEN gt = 1 THEN '0/1' ELSE '1/1' END AS text, CASE WHEN copies IS NULL THEN CASE WHEN hap THEN '.' ELSE './.' END WHEN hap THEN CASE WHEN copies = 1 THEN '0' ELSE '1' END WHEN copies = 0 THEN '1/1' WHEN copies = 1 THEN '0/1' ELSE './1' END AS cnv_text, CASE WHEN copies = 1 THEN 1 ELSE 2 END AS ploidy FROM x"),
    "best_alleles": with_views("v_read", body=_ALLELE_SQL + "SELECT * FROM best"),
    "allele_counts": with_views("v_read", body=_ALLELE_SQL + "SELECT read % 300 AS sv, read % 3 AS sample, count(*) FILTER (allele = 0) AS ref, count(*) FILTER (allele = 1) AS alt, count(*) FILTER (allele = 2) AS overlap FROM best GROUP BY ALL"),
    "sample_sv_order": with_views("v_order", body=_ORDER_SQL),
    "guest_haplotypes": with_views("v_read", body=', m AS (SELECT qname % 200 AS "group", sample, start % 3 AS haplotype, CAST(floor(sum(mapq / 64) / count(*) * 1000000000) AS BIGINT) AS mean, count(*) AS n FROM v_read GROUP BY ALL HAVING count(*) >= 2) SELECT "group", sample, haplotype, mean, n FROM (SELECT *, row_number() OVER (PARTITION BY "group", sample ORDER BY mean DESC, n DESC, haplotype) AS k FROM m) WHERE k = 1'),
    "phase_sets": with_views("v_region", body=", c AS (SELECT region_id, region_id // 4 AS g, region_id % 2 AS s, region_id % 3 % 2 AS h, start, value % 3 = 1 AS het FROM v_region), w AS (SELECT *, count(*) FILTER (het) OVER (PARTITION BY g, s) AS n, min(CASE WHEN het THEN start END) OVER (PARTITION BY g, s) + 1 AS p FROM c) SELECT region_id, CASE WHEN het AND n > 1 THEN p END AS phase_set, CASE WHEN het AND n > 1 THEN h = 0 END AS is_first FROM w"),
    "absorbed_overlaps": with_views("v_sv", body=""", c AS (SELECT sv, sample, CASE WHEN (sv + sample) % 3 = 0 THEN 0 ELSE (sv * 3 + sample) % 11 END AS ref, (sv * 5 + sample) % 13 AS alt, CASE WHEN sv % 4 > 1 THEN (sv + sample) % 4 ELSE 0 END AS overlap FROM v_sv, range(3) AS t(sample))""" + _scored_sql("c") + """,
        p AS (SELECT sv, sample, ref, alt, overlap, gt, sv // 8 AS g, sv % 3 AS rank, sv * 37 % 100 AS s, sv * 37 % 100 + 30 AS e, coalesce(sv % 3 = 0 AND gt = 2 AND sv % 10 <> 0, false) AS top FROM gt),
        x AS (SELECT DISTINCT b.sv, b.sample FROM p b JOIN p t ON t.top AND b.rank = 1 AND t.g = b.g AND t.sample = b.sample AND b.s < t.e AND t.s < b.e),
        c2 AS (SELECT p.sv, p.sample, x.sv IS NOT NULL AS gt_excluded, CASE WHEN x.sv IS NULL THEN ref ELSE ref + alt + overlap END AS ref, CASE WHEN x.sv IS NOT NULL THEN 0 WHEN top THEN alt + overlap ELSE alt END AS alt,
            CASE WHEN x.sv IS NOT NULL OR top THEN 0 ELSE overlap END AS overlap FROM p LEFT JOIN x ON x.sv = p.sv AND x.sample = p.sample)""" + _scored_sql("c2", "2") + "SELECT sv, sample, ref, alt, overlap, gt_excluded, pl0, pl1, pl2, gt, gq FROM gt2"),
    "excluded_everywhere": with_views("v_read", body=", c AS (SELECT qname % 2000 AS sv, coalesce(bool_and(start % 5 > 0) FILTER (mapq > 30), false) AS all_excluded FROM v_read GROUP BY ALL) SELECT *, CASE WHEN sv % 6 = 0 THEN 'Replicated' WHEN all_excluded THEN 'GTExcluded' ELSE 'NoFilter' END AS filter FROM c"),
    "resolved_replicates": with_views("v_sv", body=""", r AS (SELECT sv, sample, sv // 16 AS g, sv * 7 % 5 AS spot, (sv + sample) % 3 <> 0 AS carried, sample > 0 AS several, (sv * 3 + sample) % 11 AS ref, (sv * 5 + sample) % 13 AS alt, (sv + sample) % 4 AS overlap FROM v_sv, range(3) AS t(sample)),
        w AS (SELECT *, carried AND several AND count(*) FILTER (carried AND several) OVER (PARTITION BY g, spot, sample) > 1 AS on_several, sv <> min(sv) OVER (PARTITION BY g, spot) AS replicated,
            carried AND several AND coalesce(count(*) FILTER (carried AND several) OVER (PARTITION BY g, spot, sample ORDER BY sv ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS within_replicate FROM r),
        m AS (SELECT g, spot, sample, max(sv) AS sv FROM w WHERE replicated AND carried AND NOT within_replicate GROUP BY ALL),
        n AS (SELECT m.g, m.spot, m.sample, w.ref, w.alt, w.overlap FROM m JOIN w USING (sv, sample))
        SELECT w.sv, w.sample, CASE WHEN w.replicated THEN w.ref ELSE coalesce(n.ref, w.ref) END AS ref, CASE WHEN w.replicated THEN w.alt ELSE coalesce(n.alt, w.alt) END AS alt, CASE WHEN w.replicated THEN w.overlap ELSE coalesce(n.overlap, w.overlap) END AS overlap,
            w.on_several, w.within_replicate, w.replicated FROM w LEFT JOIN n ON n.g = w.g AND n.spot = w.spot AND n.sample = w.sample"""),
    "top_supported": with_views("v_bpo", body=", c AS (SELECT start1 AS cluster, inserted AS assembly, count(*) AS reads FROM v_bpo GROUP BY ALL HAVING count(*) >= 2) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY reads DESC, assembly) AS rank FROM c) WHERE rank <= 2"),
    "downsampled": with_views("v_bpo", body=", w AS (SELECT obs, start1 AS cluster, row_number() OVER (PARTITION BY start1 ORDER BY obs) AS i, count(*) OVER (PARTITION BY start1) AS n FROM v_bpo) SELECT obs, cluster FROM w WHERE n <= 2 OR i * 2 // n > (i - 1) * 2 // n"),
    "one_per_read": with_views("v_read", body=', r AS (SELECT qname, seg, start AS pos, "end" - start AS length, strand = 0 AS is_primary FROM v_read) SELECT qname, seg, pos, length, is_primary FROM (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY length DESC, is_primary DESC, pos, seg) AS k FROM r) WHERE k = 1'),
    "sv_cnv_match": with_recursive("v_sv", "v_cnv", body=_MATCH_SQL + "SELECT * FROM matched"),
    "forced_breakends": with_recursive("v_sv", "v_cnv", body=_MATCH_SQL + 'SELECT sv, "end" - start >= 50000 AND sv NOT IN (SELECT sv FROM matched) AS forced_bnd FROM v_sv'),
    "power_boost": with_views("v_sv", "v_region", body='SELECT sv, region_id AS segment FROM v_sv v JOIN v_region r ON v.chrom = r.chrom AND r.start - r.start % 1000 + 5000 <= v.start AND v."end" + 5000 <= r.start + 200000 WHERE v."end" - v.start >= 50000'),
    "close_fit": with_views("v_sv", "v_cnv", body=', s AS (SELECT cnv AS segment, chrom, start, "end", cnv % 5 >= 2 AS usual FROM v_cnv), w AS (SELECT *, lag(usual) OVER w AS before, lead(usual) OVER w AS after FROM s WINDOW w AS (PARTITION BY chrom ORDER BY start, segment)), m AS (SELECT segment, sv FROM w JOIN v_sv v ON v.chrom = w.chrom AND v.start < w."end" AND w.start < v."end" WHERE before AND after AND NOT usual AND (least(v."end", w."end") - greatest(v.start, w.start)) / greatest(v."end" - v.start, w."end" - w.start, 100) >= 0.8) SELECT min(sv) AS sv, segment FROM m GROUP BY segment HAVING count(*) = 1'),
    "inversions": with_recursive("v_bpo", body=""", o AS (SELECT obs AS id, chrom1 AS chrom, start1 AS s, start2 + 1 AS e, obs % 2 AS dir, row_number() OVER (PARTITION BY chrom1 ORDER BY start1, obs % 2, CAST(obs AS VARCHAR)) AS i FROM v_bpo WHERE dir1 = dir2),
        j AS (SELECT w.chrom, w.i, NULL::BIGINT AS id1, NULL::BIGINT AS id2, NULL::BIGINT AS start, NULL::BIGINT AS "end", w.id AS hid, w.s AS hs, w.e AS he, w.dir AS hd FROM o w WHERE i = 1
          UNION ALL SELECT chrom, i, CASE WHEN pairs THEN hid END, CASE WHEN pairs THEN id END, CASE WHEN pairs THEN hs END, CASE WHEN pairs THEN greatest(e, he) END,
            CASE WHEN pairs THEN NULL WHEN same THEN hid ELSE id END, CASE WHEN pairs THEN NULL WHEN same THEN hs ELSE s END, CASE WHEN pairs THEN NULL WHEN same THEN he ELSE e END, CASE WHEN pairs THEN NULL WHEN same THEN hd ELSE dir END
          FROM (SELECT o.chrom, o.i, o.id, o.s, o.e, o.dir, j.hid, j.hs, j.he, j.hd, coalesce(o.dir <> j.hd AND abs(o.s - j.hs) <= 10000 AND abs(o.e - j.he) <= 10000 AND least(o.e, j.he) - greatest(o.s, j.hs) >= 0.6 * greatest(o.e - o.s, j.he - j.hs, 100), false) AS pairs,
            coalesce(o.s = j.hs AND o.e = j.he AND o.dir = j.hd, false) AS same FROM j JOIN o ON o.chrom = j.chrom AND o.i = j.i + 1))
        SELECT chrom, id1, id2, start, "end" FROM j WHERE id1 IS NOT NULL"""),
    "inversion_conflicts": with_recursive("v_bpo", body=""", o AS (SELECT obs AS id, chrom1 AS chrom, start1 AS s, start2 + 1 AS e, obs % 2 AS dir, CASE WHEN obs % 3 = 0 THEN obs + obs % 7 * 25 END AS near, obs % 2 + 1 AS side1, obs % 5 % 2 + 1 AS side2,
            row_number() OVER (PARTITION BY chrom1 ORDER BY start1, obs % 2, CAST(obs AS VARCHAR)) AS i FROM v_bpo WHERE dir1 = dir2),
        j AS (SELECT chrom, i, NULL::BIGINT AS id1, NULL::BIGINT AS id2, NULL::BIGINT AS start, NULL::BIGINT AS "end", i AS h FROM o WHERE i = 1
          UNION ALL SELECT chrom, i, CASE WHEN pairs THEN hid END, CASE WHEN pairs THEN id END, CASE WHEN pairs THEN hs END, CASE WHEN pairs THEN greatest(e, he) END, CASE WHEN pairs THEN NULL WHEN same THEN h ELSE i END
          FROM (SELECT o.chrom, o.i, o.id, o.e, p.id AS hid, p.s AS hs, p.e AS he, p.i AS h, coalesce(o.dir <> p.dir AND abs(o.s - p.s) <= 10000 AND abs(o.e - p.e) <= 10000 AND least(o.e, p.e) - greatest(o.s, p.s) >= 0.6 * greatest(o.e - o.s, p.e - p.s, 100)
                AND NOT coalesce(p.near = o.id AND (p.side1 = 1 OR p.side2 = 2), false), false) AS pairs, coalesce(o.s = p.s AND o.e = p.e AND o.dir = p.dir, false) AS same
            FROM j JOIN o ON o.chrom = j.chrom AND o.i = j.i + 1 LEFT JOIN o p ON p.chrom = j.chrom AND p.i = j.h)),
        gts AS (SELECT obs AS id, sample, (obs + sample * obs) % 3 AS gt FROM v_bpo, range(3) AS t(sample) WHERE dir1 = dir2 AND obs % 9 <> 0 AND (obs + sample) % 4 <> 0),
        v AS (SELECT id1, id2, sample, max(gt) FILTER (g.id = id1) AS g1, max(gt) FILTER (g.id = id2) AS g2 FROM j JOIN gts g ON g.id IN (j.id1, j.id2) WHERE id1 IS NOT NULL GROUP BY id1, id2, sample),
        w AS (SELECT id1, id2, 2 * count(*) FILTER (g1 IS NOT DISTINCT FROM g2) < count(*) AS conflicting FROM v GROUP BY id1, id2)
        SELECT j.chrom, j.id1, j.id2, j.start, j."end", coalesce(w.conflicting, false) AS conflicting FROM j LEFT JOIN w ON w.id1 = j.id1 AND w.id2 = j.id2 WHERE j.id1 IS NOT NULL"""),
    "eligible_svs": with_views("v_sv", body="SELECT sv FROM v_sv WHERE sv % 10 <> 0 AND sv % 9 <> 0 AND quality >= 10 AND \"end\" - start >= 10000"),
    "deduped_records": with_views("v_bpo", body=", r AS (SELECT CAST(obs AS VARCHAR) AS id, chrom1 AS chrom, start1 AS pos, CASE WHEN inserted % 4 <> 0 THEN inserted END AS size, obs % 11 = 0 AS is_inversion FROM v_bpo) SELECT id, chrom, pos, size, is_inversion FROM (SELECT *, row_number() OVER (PARTITION BY chrom, pos, size ORDER BY is_inversion DESC, id) AS k FROM r) WHERE k = 1"),
    "ordered_records": with_views("v_bpo", body="SELECT CAST(obs AS VARCHAR) AS id, chrom1 AS chrom, start1 AS pos, obs % 11 = 0 AS is_inversion FROM v_bpo"),
    "merged_segments": with_views("v_read", body=_SEGS_SQL + ", m AS (SELECT chrom, b AS start, e AS \"end\", count(*) FILTER (state < 2) AS below, count(*) FILTER (state > 2) AS above, max(sample) AS base_sample FROM segs GROUP BY ALL) SELECT *, CASE WHEN below > 0 AND above > 0 THEN 'CNV' WHEN below > 0 THEN 'DEL' ELSE 'DUP' END AS type FROM m WHERE below + above > 0"),
    "accuracy_by_size": with_views("v_truth", body=", s AS (SELECT type, CASE WHEN size < 500 THEN '0-500' WHEN size < 5000 THEN '500-5000' ELSE '5000+' END AS size_bin, count(*) FILTER (label = 'TP') AS tp, count(*) FILTER (label = 'FP') AS fp, count(*) FILTER (label = 'FN') AS fn FROM v_truth GROUP BY ALL) SELECT *, round(tp / nullif(tp + fn, 0), 6) AS recall, round(tp / nullif(tp + fp, 0), 6) AS precision, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM s"),
    "record_filters": with_views("v_sv", body=", t AS (SELECT *, concat_ws(';', CASE WHEN sv % 9 = 0 THEN 'MaxScoringDepth' END, CASE WHEN quality < 10 THEN 'MinQUAL' END, CASE WHEN sv % 5 = 0 THEN 'InvBreakpoint' END, CASE WHEN sv % 25 = 0 THEN 'ConflictingBreakpointGT' END) AS tags FROM v_sv) SELECT sv, CASE WHEN tags = '' THEN 'PASS' ELSE tags END AS filter, CASE WHEN sv % 6 = 0 THEN 'Replicated' WHEN sv % 4 = 0 THEN 'GTExcluded' ELSE 'NoFilter' END AS sv_filter, 'call:' || sv || ':' || chrom AS label FROM t"),
    "breakend_strings": with_views("v_bpo", body=", t AS (SELECT *, CASE WHEN dir2 = 0 THEN ']' ELSE '[' END AS b, 'HLA:' || chrom2 AS m FROM v_bpo) SELECT obs, CASE WHEN dir1 = 0 THEN 'TCT' || b || m || ':' || (start2 + 1) || b ELSE b || m || ':' || (start2 + 1) || b || 'CTT' END AS alt, CAST(dir1 AS INTEGER) AS dir1, CAST(dir2 AS INTEGER) AS dir2, m AS mate_chrom, start2 - CASE WHEN dir2 = 0 THEN 0 ELSE 1 END AS mate_pos, 'CT' AS inserted FROM t"),
    "minor_fractions": "SELECT CAST(l_partkey AS BIGINT) AS pos, count(*) FILTER (l_returnflag = 'A') AS ad0, count(*) FILTER (l_returnflag = 'R') AS ad1, round(CASE WHEN count(*) FILTER (l_returnflag IN ('A', 'R')) >= 8 THEN least(count(*) FILTER (l_returnflag = 'A'), count(*) FILTER (l_returnflag = 'R')) / count(*) FILTER (l_returnflag IN ('A', 'R')) END, 6) AS minor_fraction FROM lineitem GROUP BY l_partkey",
}
QUERIES = {f.__name__: f for f in (
    best_states, converged_states, synced_boundaries, emission_table, copy_boundaries, boundary_clusters, breakend_kinds, high_copies, copy_quality, genotype_likelihoods, joint_quality,
    genotype_texts, allele_support, merged_by_sequence, best_alleles, allele_counts, sample_sv_order, group_violations, sample_variants, reserved_counts, guest_haplotypes, phase_sets, absorbed_overlaps, excluded_everywhere, resolved_replicates, top_supported, downsampled, one_per_read, sv_cnv_match, forced_breakends, power_boost,
    close_fit, inversions, inversion_conflicts, eligible_svs, deduped_records, ordered_records, merged_segments, accuracy_by_size, record_filters, breakend_strings, minor_fractions,
)}
