"""Queries over intervals and depth, each with its DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intervals, prob
from ..operators import gc, interval_join, sweep
from ..session import shared_folder
from ..sources import regions
from .views import SEQUENCES_SQL, sequences, view, with_views

BIN = 1000


def interval_overlaps(spark: SparkSession, d: str) -> DataFrame:
    reads = view(spark, d, "v_read").select("qname", "seg", "chrom", "start", "end")
    met = interval_join.interval_join(reads, view(spark, d, "v_region").select("region_id", "chrom", "start", "end"))
    return met.select("qname", "seg", "region_id", F.greatest("start", "right_start").alias("shared_start"), F.least("end", "right_end").alias("shared_end"))


def interval_semi(spark: SparkSession, d: str) -> DataFrame:
    return interval_join.interval_semi(view(spark, d, "v_read").select("qname", "seg", "chrom", "start", "end"), view(spark, d, "v_region"), ["qname", "seg", "chrom", "start", "end"]).select("qname", "seg")


def interval_anti(spark: SparkSession, d: str) -> DataFrame:
    return interval_join.interval_anti(view(spark, d, "v_read").select("qname", "seg", "chrom", "start", "end"), view(spark, d, "v_region"), ["qname", "seg", "chrom", "start", "end"]).select("qname", "seg")


def point_in_interval(spark: SparkSession, d: str) -> DataFrame:
    points = view(spark, d, "v_read").select("qname", "seg", "chrom", F.col("start").alias("pos"))
    return interval_join.point_join(points, view(spark, d, "v_region")).select("qname", "seg", "region_id")


#: One region of each chromosome (chrom, start, end).
TARGETS = [(c, 20_000 * c, 20_000 * c + 15_000) for c in range(24)]


def _indexed(spark: SparkSession, d: str) -> str:
    """The reads as a table clustered by bin."""
    path = f"{shared_folder(spark)}/reads-{uuid.uuid4().hex}"
    regions.write_indexed(view(spark, d, "v_read"), path)
    return path


def region_reads(spark: SparkSession, d: str) -> DataFrame:
    return regions.read_regions(spark, _indexed(spark, d), TARGETS).select("qname", "seg", "chrom", "start", "end", "mapq")


def reads_of_regions(spark: SparkSession, d: str) -> DataFrame:
    wanted = view(spark, d, "v_region").filter("value = 3")
    return regions.reads_of_regions(spark, _indexed(spark, d), wanted, ["qname", "seg", "chrom", "start", "end"]).select("qname", "seg", "mapq")


def _pair() -> list[Column]:
    return [F.col(c) for c in ("start1", "end1", "start2", "end2")]


def _bpo_ranges(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_bpo").select("obs", "start1", (F.col("start1") + 200 + F.col("inserted") * 40).alias("end1"), (F.col("start2") - 250).alias("start2"), (F.col("start2") + F.col("inserted") * 30).alias("end2"))


_RANGES_SQL = ', r AS (SELECT obs, start1, start1 + 200 + inserted * 40 AS end1, start2 - 250 AS start2, start2 + inserted * 30 AS end2 FROM v_bpo) '


def range_distance(spark: SparkSession, d: str) -> DataFrame:
    return _bpo_ranges(spark, d).select("obs", intervals.distance(*_pair()).alias("distance"), intervals.is_before(*_pair()).alias("is_before"))


def reciprocal_overlap(spark: SparkSession, d: str) -> DataFrame:
    shared = intervals.shared_range(*_pair())
    return _bpo_ranges(spark, d).select("obs", F.round(intervals.reciprocal_overlap(*_pair()), 6).alias("overlap"), shared[0].alias("shared_start"), shared[1].alias("shared_end"))


def merged_range(spark: SparkSession, d: str) -> DataFrame:
    low, high = intervals.merged(*_pair())
    back = intervals.reverse(F.col("start1"), F.col("end1"), F.lit(200_000))
    return _bpo_ranges(spark, d).select("obs", low.alias("low"), high.alias("high"), intervals.centre(low, high).alias("centre"), back[0].alias("rev_start"), back[1].alias("rev_end"))


def expanded_range(spark: SparkSession, d: str) -> DataFrame:
    new = intervals.expand(F.col("start"), F.col("end"), F.lit(700), F.lit(900), F.lit(150_000))
    return view(spark, d, "v_region").select("region_id", *[c.alias(n) for c, n in zip(new, ("new_start", "new_end", "left_shift", "right_shift"))])


def strict_order(spark: SparkSession, d: str) -> DataFrame:
    return _bpo_ranges(spark, d).select("obs", intervals.strictly_before(F.lit(1), F.col("end1"), F.lit(1), F.col("start2")).alias("before"))


def region_labels(spark: SparkSession, d: str) -> DataFrame:
    label = intervals.region_label(F.concat(F.lit("HLA:"), F.col("chrom").cast("string")), F.col("start"), F.col("end"))
    named = view(spark, d, "v_region").select("region_id", label.alias("label"))
    name, start, end = intervals.parse_region(F.col("label"))
    return named.select("region_id", "label", name.alias("name"), start.alias("start"), end.alias("end"))


def region_tiles(spark: SparkSession, d: str) -> DataFrame:
    each = view(spark, d, "v_region").select("region_id", F.explode(intervals.tiles(F.col("end") - F.col("start"), 300)).alias("t"))
    return each.select("region_id", "t.start", "t.end")


def coverage_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of bins with any read, per sample and chromosome."""
    bins = sweep.depth_bins(view(spark, d, "v_read"), BIN, ("sample", "chrom"))
    return sweep.islands(bins, "bin", F.col("bases") >= 1500, ("sample", "chrom"))


def expected_copies_majority(spark: SparkSession, d: str) -> DataFrame:
    targets = view(spark, d, "v_read").filter("seg = 1").select("chrom", "start", "end", "qname")
    return interval_join.majority_value(targets, view(spark, d, "v_region"), "qname")


def expected_copies_unanimous(spark: SparkSession, d: str) -> DataFrame:
    targets = view(spark, d, "v_read").select("chrom", "start", "end", "qname", "seg")
    return interval_join.unanimous_value(targets, view(spark, d, "v_region").filter("value < 3"), "qname", "seg")


def depth_per_bin(spark: SparkSession, d: str) -> DataFrame:
    return sweep.depth_bins(view(spark, d, "v_read"), BIN, ("sample", "chrom"))


def excluded_bins(spark: SparkSession, d: str) -> DataFrame:
    """Bins with depth that any region of value 0 touches."""
    bins = sweep.depth_bins(view(spark, d, "v_read"), BIN).select("chrom", "bin", (F.col("bin") * BIN).alias("start"), ((F.col("bin") + 1) * BIN).alias("end"))
    return interval_join.interval_semi(bins, view(spark, d, "v_region").filter("value = 0"), ["chrom", "bin"]).select("chrom", "bin")


def sliding_sums(spark: SparkSession, d: str) -> DataFrame:
    starts = view(spark, d, "v_read").groupBy("chrom", F.col("start").alias("pos")).agg(F.count(F.lit(1)).alias("count"))
    return sweep.sliding_sum(starts, 500, block=20_000)


def regions_over_depth(spark: SparkSession, d: str) -> DataFrame:
    return sweep.regions_over(view(spark, d, "v_read"), 8)


def merged_regions(spark: SparkSession, d: str) -> DataFrame:
    return sweep.union(view(spark, d, "v_region"), 50)


def subtracted_regions(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "v_region")
    return sweep.subtract(r.filter("value <> 0"), r.filter("value = 0"))


def gap_filled_regions(spark: SparkSession, d: str) -> DataFrame:
    return sweep.filled_union(view(spark, d, "v_region").filter("value = 1"), 500)


def common_regions(spark: SparkSession, d: str) -> DataFrame:
    return sweep.common_regions(view(spark, d, "v_region"), 2, 100)


def gc_windows(spark: SparkSession, d: str) -> DataFrame:
    return gc.window_content(sequences(spark, d), 100, 901)


def gc_levels(spark: SparkSession, d: str) -> DataFrame:
    return gc.content_levels(gc.window_content(sequences(spark, d), 100, 901), least_bases=300)


def _depth_and_levels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    depth = sweep.depth_bins(view(spark, d, "v_read"), BIN, ("sample", "chrom")).withColumnRenamed("bases", "depth")
    levels = depth.select("chrom", "bin").distinct().withColumn("gc_level", (F.col("bin") * 7 + F.col("chrom")) % 40)
    return depth, levels


def gc_correction(spark: SparkSession, d: str) -> DataFrame:
    """Levels with under 10 bins don't qualify."""
    depth, levels = _depth_and_levels(spark, d)
    usable = depth.join(levels.filter("gc_level not in (3, 31)"), ["chrom", "bin"], "left_semi")
    table = gc.correction(gc.level_depth(usable, levels), BIN, qualifying_bases=10 * BIN)
    return table.select("sample", "gc_level", F.round("reduction", 6).alias("reduction"))


def scaled_depths(spark: SparkSession, d: str) -> DataFrame:
    """Depth over a reduction that follows from the level."""
    depth, levels = _depth_and_levels(spark, d)
    reductions = levels.select("gc_level").distinct().withColumn("sample", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)]))).withColumn("reduction", (F.col("gc_level") % 8 + 1) / F.lit(8.0))
    return gc.scaled_depth(depth, levels, reductions).withColumn("scaled_depth", F.round("scaled_depth", 6))


def haploid_depth(spark: SparkSession, d: str) -> DataFrame:
    depth, _ = _depth_and_levels(spark, d)
    copies = F.when(F.col("bin") % 11 != 0, F.col("bin") % 4 + 1)
    return gc.haploid_mean(depth.withColumn("copies", copies)).select("sample", F.round("haploid", 6).alias("haploid"))


def state_bases(spark: SparkSession, d: str) -> DataFrame:
    return gc.bases_per_state(view(spark, d, "v_region").withColumnRenamed("value", "state"))


def state_runs(spark: SparkSession, d: str) -> DataFrame:
    depth, _ = _depth_and_levels(spark, d)
    grid = depth.select("sample", "chrom", "bin", F.floor(F.col("depth") / 1000).cast("long").alias("state"))
    return sweep.run_lengths(grid, ["sample", "chrom"], "bin", "state")


def phred_scores(spark: SparkSession, d: str) -> DataFrame:
    p = (F.col("region_id") % 1000) / F.lit(1000.0)
    values = [prob.ln((F.col("value") + i) / F.lit(20.0)) for i in range(1, 4)]
    out = prob.normalised(values)
    return view(spark, d, "v_region").select("region_id", F.round(prob.phred(p), 4).alias("phred"), F.round(F.exp(prob.log_sum(values[0], values[1])), 6).alias("total"), F.round(out[2], 6).alias("third"), prob.first_argmax(values).alias("best"), F.round(prob.complement(out, 2), 6).alias("rest"))


def _islands_sql(source: str, keys: str, start: str, end: str, gap: int = 0, where: str = "TRUE") -> str:
    """Merging of intervals by the running maximum of their ends."""
    part = f"PARTITION BY {keys}"
    return f"""
      SELECT {keys}, min(s) AS "start", max(e) AS "end" FROM (
        SELECT *, sum(CASE WHEN s <= reach + {gap} THEN 0 ELSE 1 END) OVER ({part} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM (
          SELECT {keys}, {start} AS s, {end} AS e, max({end}) OVER ({part} ORDER BY {start}, {end} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
          FROM {source} WHERE ({where}) AND {start} < {end})) GROUP BY {keys}, island"""


_BINS_SQL = """, bins AS (
  SELECT sample, chrom, bin, CAST(sum(least("end", (bin + 1) * 1000) - greatest(start, bin * 1000)) AS BIGINT) AS bases
  FROM (SELECT sample, chrom, start, "end", unnest(generate_series(start // 1000, ("end" - 1) // 1000)) AS bin FROM v_read) GROUP BY ALL) """
_CHROM_BINS_SQL = _BINS_SQL.replace("sample, ", "")
_SWEEP_SQL = """, deltas AS (SELECT chrom, pos, sum(delta) AS delta FROM (SELECT chrom, start AS pos, 1 AS delta FROM {0} UNION ALL SELECT chrom, "end", -1 FROM {0}) GROUP BY ALL),
  levels AS (SELECT chrom, pos, sum(delta) OVER (PARTITION BY chrom ORDER BY pos) AS depth, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS next FROM deltas) """
_GC_SQL = """WITH """ + SEQUENCES_SQL + """, b AS (SELECT chrom, seq, unnest(generate_series(0, length(seq) // 100 - 1)) AS bin FROM v_seq),
  w AS (SELECT chrom, bin, substr(seq, CAST(greatest(0, ((2 * bin + 1) * 100) // 2 - 450) + 1 AS BIGINT),
      CAST(least(length(seq), ((2 * bin + 1) * 100) // 2 + 451) - greatest(0, ((2 * bin + 1) * 100) // 2 - 450) AS BIGINT)) AS t FROM b),
  content AS (SELECT chrom, bin, length(t) - length(translate(t, 'GC', '')) AS gc, length(t) - length(translate(t, 'AT', '')) AS "at" FROM w) """

_MEET = 'r.chrom = g.chrom AND r.start < g."end" AND g.start < r."end"'
ORACLES = {
    "interval_overlaps": with_views("v_read", "v_region", body=f'SELECT qname, seg, region_id, greatest(r.start, g.start) AS shared_start, least(r."end", g."end") AS shared_end FROM v_read r JOIN v_region g ON {_MEET}'),
    "region_reads": with_views("v_read", body='SELECT qname, seg, chrom, start, "end", mapq FROM v_read WHERE start < chrom * 20000 + 15000 AND "end" > chrom * 20000'),
    "reads_of_regions": with_views("v_read", "v_region", body=f"SELECT qname, seg, mapq FROM v_read r WHERE EXISTS (SELECT 1 FROM v_region g WHERE g.value = 3 AND {_MEET})"),
    "interval_semi": with_views("v_read", "v_region", body=f"SELECT qname, seg FROM v_read r WHERE EXISTS (SELECT 1 FROM v_region g WHERE {_MEET})"),
    "interval_anti": with_views("v_read", "v_region", body=f"SELECT qname, seg FROM v_read r WHERE NOT EXISTS (SELECT 1 FROM v_region g WHERE {_MEET})"),
    "point_in_interval": with_views("v_read", "v_region", body='SELECT qname, seg, region_id FROM v_read r JOIN v_region g ON r.chrom = g.chrom AND r.start >= g.start AND r.start < g."end"'),
    "range_distance": with_views("v_bpo", body=_RANGES_SQL + "SELECT obs, greatest(start2 - end1, start1 - end2, 0) AS distance, NOT (end2 < start1) AS is_before FROM r"),
    "reciprocal_overlap": with_views("v_bpo", body=_RANGES_SQL + "SELECT obs, round(greatest(least(end1, end2) - greatest(start1, start2), 0) / greatest(end1 - start1, end2 - start2, 100), 6) AS overlap, CASE WHEN start1 < end2 AND start2 < end1 THEN greatest(start1, start2) END AS shared_start, CASE WHEN start1 < end2 AND start2 < end1 THEN least(end1, end2) END AS shared_end FROM r"),
    "merged_range": with_views("v_bpo", body=_RANGES_SQL + "SELECT obs, least(start1, start2) AS low, greatest(end1, end2) AS high, (least(start1, start2) + greatest(end1, end2)) // 2 AS centre, 200000 - end1 AS rev_start, 200000 - start1 AS rev_end FROM r"),
    "expanded_range": with_views("v_region", body='SELECT region_id, greatest(start - 700, 0) AS new_start, least("end" + 900, 150000) AS new_end, start - greatest(start - 700, 0) AS left_shift, least("end" + 900, 150000) - "end" AS right_shift FROM v_region'),
    "strict_order": with_views("v_bpo", body=_RANGES_SQL + "SELECT obs, end1 <= start2 AS before FROM r"),
    "region_labels": with_views("v_region", body="SELECT region_id, 'HLA:' || chrom || ':' || (start + 1) || '-' || \"end\" AS label, 'HLA:' || chrom AS name, start, \"end\" FROM v_region"),
    "region_tiles": with_views("v_region", body=', s AS (SELECT region_id, "end" - start AS size, ("end" - start - 1) // 300 + 1 AS n FROM v_region), t AS (SELECT *, unnest(generate_series(0, n - 1)) AS i FROM s) SELECT region_id, i * (size // n) + least(i, size % n) AS start, (i + 1) * (size // n) + least(i + 1, size % n) AS "end" FROM t'),
    "coverage_islands": with_views("v_read", body=_BINS_SQL + 'SELECT sample, chrom, min(bin) AS start, max(bin) + 1 AS "end" FROM (SELECT *, bin - row_number() OVER (PARTITION BY sample, chrom ORDER BY bin) AS g FROM bins WHERE bases >= 1500) GROUP BY sample, chrom, g'),
    "expected_copies_majority": with_views("v_read", "v_region", body=f', t AS (SELECT * FROM v_read WHERE seg = 1), s AS (SELECT qname, least(g.value, 5) AS value, sum(g."end" - g.start) AS span FROM t r JOIN v_region g ON {_MEET} GROUP BY ALL), b AS (SELECT qname, value FROM (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY span DESC, value) AS k FROM s) WHERE k = 1) SELECT t.qname, coalesce(b.value, 2) AS value FROM t LEFT JOIN b USING (qname)'),
    "expected_copies_unanimous": with_views("v_read", "v_region", body=f", m AS (SELECT r.qname, r.seg, min(g.value) AS low, max(g.value) AS high FROM v_read r LEFT JOIN v_region g ON g.value < 3 AND {_MEET} GROUP BY ALL) SELECT qname, CASE WHEN bool_and(low IS NOT NULL) AND min(low) = max(high) THEN min(low) ELSE 2 END AS value FROM m GROUP BY qname"),
    "depth_per_bin": with_views("v_read", body=_BINS_SQL + "SELECT sample, chrom, bin, bases FROM bins"),
    "excluded_bins": with_views("v_read", "v_region", body=_CHROM_BINS_SQL + 'SELECT chrom, bin FROM bins b WHERE EXISTS (SELECT 1 FROM v_region g WHERE g.value = 0 AND g.chrom = b.chrom AND g.start < (b.bin + 1) * 1000 AND b.bin * 1000 < g."end")'),
    "sliding_sums": with_views("v_read", body=', c AS (SELECT chrom, start AS pos, count(*) AS "count" FROM v_read GROUP BY ALL) SELECT *, CAST(sum("count") OVER (PARTITION BY chrom ORDER BY pos RANGE BETWEEN 499 PRECEDING AND CURRENT ROW) AS BIGINT) AS window_sum FROM c'),
    "regions_over_depth": with_views("v_read", body=_SWEEP_SQL.format("v_read") + ', f AS (SELECT *, depth > 8 AS over FROM levels WHERE next IS NOT NULL), g AS (SELECT *, sum(CASE WHEN over THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY pos) AS k FROM f) SELECT chrom, min(pos) AS start, max(next) AS "end" FROM g WHERE over GROUP BY chrom, k'),
    "merged_regions": with_views("v_region", body=_islands_sql("v_region", "chrom", "start", '"end"', 50)),
    "subtracted_regions": with_views("v_region", body=', d AS (SELECT chrom, start AS pos, CASE WHEN value = 0 THEN 0 ELSE 1 END AS a, CASE WHEN value = 0 THEN 1 ELSE 0 END AS h FROM v_region UNION ALL SELECT chrom, "end", CASE WHEN value = 0 THEN 0 ELSE -1 END, CASE WHEN value = 0 THEN -1 ELSE 0 END FROM v_region), e AS (SELECT chrom, pos, sum(a) AS a, sum(h) AS h FROM d GROUP BY ALL), l AS (SELECT chrom, pos, sum(a) OVER w AS a, sum(h) OVER w AS h, lead(pos) OVER w AS next FROM e WINDOW w AS (PARTITION BY chrom ORDER BY pos)), f AS (SELECT *, a > 0 AND h = 0 AS ok FROM l WHERE next IS NOT NULL), g AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY chrom ORDER BY pos) AS k FROM f) SELECT chrom, min(pos) AS start, max(next) AS "end" FROM g WHERE ok GROUP BY chrom, k'),
    "gap_filled_regions": with_views("v_region", body=", u AS (" + _islands_sql("v_region", "chrom", "start", '"end"', 0, "value = 1") + "), n AS (SELECT *, lead(start) OVER (PARTITION BY chrom ORDER BY start) AS next FROM u) SELECT chrom, start, \"end\", 'region' AS label FROM u UNION ALL SELECT chrom, \"end\", next, 'excluded_gap_fill' FROM n WHERE next - \"end\" <= 500"),
    "common_regions": with_views("v_region", body=_SWEEP_SQL.format("v_region") + ", c AS (SELECT chrom, pos AS start, next AS \"end\" FROM levels WHERE depth >= 2 AND next IS NOT NULL) " + _islands_sql("c", "chrom", "start", '"end"', 100)),
    "gc_windows": _GC_SQL + "SELECT * FROM content",
    "gc_levels": _GC_SQL + ', total AS (SELECT sum(gc) / sum(gc + "at") AS whole FROM content) SELECT chrom, bin, CAST(greatest(0, least(39, floor((CASE WHEN gc + "at" >= 300 THEN gc / (gc + "at") ELSE whole END) * 40))) AS BIGINT) AS gc_level FROM content, total',
    "gc_correction": with_views("v_read", body=_BINS_SQL + """, s AS (SELECT sample, (bin * 7 + chrom) % 40 AS level, count(*) AS n, sum(bases) AS d FROM bins WHERE (bin * 7 + chrom) % 40 NOT IN (3, 31) GROUP BY ALL),
        g AS (SELECT sample, level FROM (SELECT DISTINCT sample FROM s), range(0, 40) t(level)),
        m AS (SELECT g.sample, g.level, CASE WHEN n >= 10 THEN d / n ELSE 0 END AS mean FROM g LEFT JOIN s USING (sample, level)),
        t AS (SELECT *, max(mean) OVER (PARTITION BY sample) AS most FROM m), p AS (SELECT *, min(CASE WHEN mean = most THEN level END) OVER (PARTITION BY sample) AS top FROM t),
        e AS (SELECT *, min(CASE WHEN mean = 0 AND level > top THEN level END) OVER (PARTITION BY sample) AS up, max(CASE WHEN mean = 0 AND level < top THEN level END) OVER (PARTITION BY sample) AS down FROM p),
        f AS (SELECT *, CASE WHEN level >= up THEN up - 1 WHEN level <= down THEN down + 1 ELSE level END AS src FROM e)
        SELECT f.sample, CAST(f.level AS BIGINT) AS gc_level, round(CASE WHEN f.most > 0 THEN q.mean / f.most ELSE 1 END, 6) AS reduction FROM f JOIN m q ON q.sample = f.sample AND q.level = f.src"""),
    "scaled_depths": with_views("v_read", body=_BINS_SQL + "SELECT sample, chrom, bin, round(bases / (((bin * 7 + chrom) % 40 % 8 + 1) / 8.0::DOUBLE), 6) AS scaled_depth FROM bins"),
    "haploid_depth": with_views("v_read", body=_BINS_SQL + "SELECT sample, round(sum(bases) / sum(bin % 4 + 1), 6) AS haploid FROM bins WHERE bases > 0 AND bin % 11 <> 0 GROUP BY sample"),
    "state_bases": with_views("v_region", body=', s AS (SELECT chrom, value AS state, CAST(sum("end" - start) AS BIGINT) AS bases FROM v_region GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY bases DESC, state DESC) = 1 AS is_mode FROM s'),
    "state_runs": with_views("v_read", body=_BINS_SQL + ', s AS (SELECT sample, chrom, bin, bases // 1000 AS state FROM bins), f AS (SELECT *, CASE WHEN lag(state) OVER w = state THEN 0 ELSE 1 END AS n FROM s WINDOW w AS (PARTITION BY sample, chrom ORDER BY bin)), g AS (SELECT *, sum(n) OVER (PARTITION BY sample, chrom ORDER BY bin) AS k FROM f) SELECT sample, chrom, min(bin) AS "begin", max(bin) + 1 AS "end", min(state) AS state FROM g GROUP BY sample, chrom, k'),
    "phred_scores": with_views("v_region", body="SELECT region_id, round(-10 * CASE WHEN region_id % 1000 = 0 THEN -307 ELSE log10((region_id % 1000) / 1000) END, 4) AS phred, round((2 * value + 3) / 20, 6) AS total, round((value + 3) / (3 * value + 6), 6) AS third, 2 AS best, round((2 * value + 3) / (3 * value + 6), 6) AS rest FROM v_region"),
}
QUERIES = {f.__name__: f for f in (
    interval_overlaps, interval_semi, interval_anti, region_reads, reads_of_regions, point_in_interval, range_distance, reciprocal_overlap, merged_range, expanded_range, strict_order, region_labels, region_tiles,
    coverage_islands, expected_copies_majority, expected_copies_unanimous, depth_per_bin, excluded_bins, sliding_sums, regions_over_depth, merged_regions, subtracted_regions,
    gap_filled_regions, common_regions, gc_windows, gc_levels, gc_correction, scaled_depths, haploid_depth, state_bases, state_runs, phred_scores,
)}
