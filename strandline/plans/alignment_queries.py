"""Queries over alignments, evidence, breakpoints and clusters, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cigar, variants
from ..operators import cluster, evidence, pools, shifts, trim
from ..session import stored
from .views import bases, view, with_recursive, with_views


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_cigar").withColumn("runs", cigar.parse(F.col("cigar")))


def cigar_offsets(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("runs")
    return _aligned(spark, d).select("qname", cigar.ref_length(r).alias("ref_length"), cigar.read_length(r).alias("read_length"), cigar.leading_clip(r).alias("left_clip"), cigar.trailing_clip(r).alias("right_clip"), cigar.edit_distance(r).alias("edits"), cigar.has_matches(r).alias("has_matches"))


def gap_identity(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_cigar").select("qname", F.round(cigar.text_identity(F.col("cigar")), 6).alias("identity"))


def rendered_runs(spark: SparkSession, d: str) -> DataFrame:
    return _aligned(spark, d).select("qname", F.round(cigar.gap_identity(F.col("runs")), 6).alias("identity"), cigar.render(F.col("runs")).alias("rendered"))


def covered_segments(spark: SparkSession, d: str) -> DataFrame:
    each = _aligned(spark, d).select("qname", F.explode(cigar.ref_segments(F.col("runs"), F.col("pos"), 30)).alias("s"))
    return each.select("qname", "s.start", "s.end")


def indel_evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence.indel_evidence(view(spark, d, "v_cigar"))


def clipped_edges(spark: SparkSession, d: str) -> DataFrame:
    both = _aligned(spark, d).withColumn("_both", cigar.clipped_ref_edges(F.col("runs"), F.col("qname") % 70, F.col("qname") % 55))
    return both.select("qname", cigar.render(F.col("_both.kept")).alias("kept"), F.col("_both.moved").alias("moved"))


#: Bases with a stretch repeated in them, and indels of and around it, in both dialects.
_REPEAT = "concat(substr(seq, 1, 300), repeat(substr(seq, 301, {n}), 40), substr(seq, 301))".format(n="CAST(7 + doc % 50 AS INT)")
_INDEL = {"start": "CAST(250 + 60 * i AS BIGINT)", "end": "CAST(250 + 60 * i + (7 + doc % 50) * (i % 3) AS BIGINT)", "inserted": "CASE WHEN i % 3 = 0 OR i > 5 THEN substr(seq, CAST(251 + 60 * i AS INT), CAST(7 + doc % 50 AS INT)) ELSE '' END"}
_CHUNK = 512


def indel_shifts(spark: SparkSession, d: str) -> DataFrame:
    """Repeats of up to 2,280 bases, longer than a chunk; sequences too short for an indel have none there."""
    seqs = bases(spark, d).filter("length(seq) >= 400").selectExpr("doc", f"{_REPEAT} AS seq")
    indels = seqs.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7)))).selectExpr("doc * 8 + i AS id", "doc AS chrom", *[f"{e} AS `{n}`" for n, e in _INDEL.items()])
    # cut in one pass, not by a substring of the whole sequence for each chunk; each round of the shifts reads the chunks
    pieces = seqs.select(F.col("doc").alias("chrom"), F.posexplode(F.regexp_extract_all("seq", F.lit(f".{{1,{_CHUNK}}}"), F.lit(0))).alias("k", "seq"))
    chunks = stored(pieces.select("chrom", (F.col("k").cast("long") * _CHUNK).alias("start"), "seq"))
    return shifts.indel_shifts(stored(indels), chunks, _CHUNK)


def clip_evidence(spark: SparkSession, d: str) -> DataFrame:
    return evidence.clip_evidence(view(spark, d, "v_cigar"))


def closest_position(spark: SparkSession, d: str) -> DataFrame:
    target = F.col("pos") + F.col("qname") % 90
    r, p = F.col("runs"), F.col("pos")
    return _aligned(spark, d).select("qname", cigar.closest_read_position(r, p, target).alias("at_most"), cigar.closest_read_position(r, p, target, False).alias("at_least"))


def sam_bins(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_read").select("qname", "seg", cigar.sam_bin(F.col("start"), F.col("end")).alias("sam_bin"), cigar.sequencing_position(F.col("start") % 200, F.lit(200), F.col("strand") == 1).alias("sequencing_pos"))


def usable_reads(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_read").filter(evidence.usable(F.col("flag"), F.col("mapq"))).select("qname", "seg")


def split_junctions(spark: SparkSession, d: str) -> DataFrame:
    return evidence.junctions(view(spark, d, "v_read"))


def split_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of a text tag, in the order of sequencing."""
    some = view(spark, d, "v_cigar").withColumn("_sa", F.concat_ws(",", F.concat(F.lit("chr"), F.col("chrom").cast("string")), F.col("pos").cast("string"), F.when(F.col("qname") % 2 == 0, "+").otherwise("-"), F.regexp_replace("cigar", "X.*S$", "X200S"), F.lit("30"), F.lit("0")))
    tags = some.groupBy(F.expr("qname div 8").alias("qname")).agg(F.concat(F.array_join(F.sort_array(F.collect_list("_sa")), ";"), F.lit(";")).alias("sa"))
    return evidence.split_segments(tags)


def breakpoint_reads(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of reads around the breakpoints that the reads themselves show: each junction and each deletion, off by a few bases."""
    segments = view(spark, d, "v_segment")
    off = F.col("qname") % 23 - 11
    kept = [F.col(c) for c in ("chrom1", "start1", "end1", "dir1", "chrom2", "start2", "end2", "dir2")]
    split = evidence.junctions(segments.withColumn("mapq", F.lit(60)))
    for i in (1, 2):
        split = split.withColumns({f"start{i}": F.col(f"pos{i}") + off * i, f"end{i}": F.col(f"pos{i}") + off * i + 3})
    split = split.select((F.col("qname") * 16 + F.col("seg")).alias("cluster"), *kept)
    before = F.col("start") + F.col("until") - 1 + off
    gaps = segments.select(
        (F.col("qname") * 16 + F.col("seg") + 8).alias("cluster"), F.col("chrom").alias("chrom1"), before.alias("start1"), (before + 1).alias("end1"), F.lit(0).alias("dir1"),
        F.col("chrom").alias("chrom2"), (before + F.col("gone")).alias("start2"), (before + F.col("gone") + 1).alias("end2"), F.lit(1).alias("dir2"),
    )
    found = trim.ordered_breakpoint_reads(trim.breakpoint_ranges(segments, split.unionByName(gaps)))
    return found.select("cluster", "qname", "seg", "first", "last", F.col("clip").cast("long").alias("clip"), "rank")


def read_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return evidence.read_neighbours(view(spark, d, "v_bpo").select("qname", "obs", F.col("start1").alias("read_pos")))


def _ends() -> list[list[Column]]:
    return [[F.col(f"{c}{i}") for c in ("chrom", "start", "end", "dir")] for i in (1, 2)]


def breakpoint_distance(spark: SparkSession, d: str) -> DataFrame:
    """Each observation against the same one shifted."""
    moved = [[e[0], e[1] + F.col("inserted") * 9 - 100, e[2] + F.col("inserted") * 9 - 100, e[3]] for e in _ends()]
    moved[1] = [moved[1][0], moved[1][1] + F.col("evidence") * 30, moved[1][2] + F.col("evidence") * 30, moved[1][3]]
    return view(spark, d, "v_bpo").select("obs", variants.breakpoint_distance(*_ends(), *moved).alias("distance"))


def breakpoint_clusters(spark: SparkSession, d: str) -> DataFrame:
    found = cluster.breakpoint_clusters(view(spark, d, "v_bpo"))
    return found.withColumn("qnames", F.size("qnames").cast("long"))


def evidence_counts(spark: SparkSession, d: str) -> DataFrame:
    return cluster.evidence_counts(view(spark, d, "v_bpo").select(F.col("start2").alias("cluster"), "evidence", F.when(F.col("obs") % 5 != 0, F.col("qname")).alias("qname")), "cluster")


def assembly_regions(spark: SparkSession, d: str) -> DataFrame:
    rows = cluster.assembly_regions(view(spark, d, "v_bpo"))
    return rows.select("obs", "region_count", F.col("regions")[0]["start"].alias("first_start"), F.element_at("regions", -1)["end"].alias("last_end"))


def consolidated_regions(spark: SparkSession, d: str) -> DataFrame:
    return cluster.consolidate(view(spark, d, "v_region").select("chrom", "start", "end", F.col("region_id").alias("id")))


def standard_breakpoints(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "v_bpo").withColumn("start2", F.col("start2") - 800).withColumn("end2", F.col("end2") - 800)
    return b.select("obs", variants.needs_swap(*[c for e in _ends() for c in e]).alias("swapped"))


def breakpoint_types(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "v_bpo").withColumn("deleted", F.col("start2") - F.col("start1"))
    chrom2 = F.when(F.col("obs") % 50 != 0, F.col("chrom2") + (F.col("obs") % 9 == 0).cast("long"))
    kind = variants.sv_type(F.col("chrom1"), chrom2, F.col("dir1"), F.col("dir2"), F.col("deleted") % 30, F.col("inserted"))
    return b.select("obs", kind.alias("type"), variants.record_type(kind, F.col("deleted"), F.col("obs") % 2 == 0, F.lit(False)).alias("record_type"))


def breakpoint_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and checks of breakpoints, some across chromosomes and some without a second end."""
    b = view(spark, d, "v_bpo")
    chrom2 = F.when(F.col("obs") % 50 != 0, F.col("chrom2") + (F.col("obs") % 9 == 0).cast("long"))
    start2, dir2 = F.when(chrom2.isNotNull(), F.col("start2") - F.col("inserted") * 200), F.when(chrom2.isNotNull(), F.col("dir2"))
    one, two = (F.col("chrom1"), F.col("start1"), F.col("dir1")), (chrom2, start2, dir2)
    return b.select(
        "obs", variants.breakpoint_span(one[0], one[1], two[0], two[1]).alias("span"), variants.deletion_size(*one, *two).alias("deletion"), variants.deldup_size(*one, *two).alias("deldup"), variants.same_orientation(one[2], two[2]).alias("same"),
        variants.homology_length(F.col("start1"), F.col("end1") + F.col("evidence")).alias("homology"), variants.is_valid_end(F.col("start1") - F.col("inserted") * 4000, F.col("end1"), F.col("dir1"), F.lit(90_000)).alias("valid"),
        variants.insert_size(F.when(F.col("obs") % 3 == 0, F.col("inserted")), F.col("inserted") + 7, F.when(F.col("obs") % 5 == 0, F.lit("ACGT"))).alias("inserted"),
    )


def neighbour_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Ends of observations that share a position; their neighbours are the second ends of these."""
    # a position's observations are dealt together once; the ends and what they have seen are read from there
    at = ["chrom1", "start1", "end1", "dir2"]
    b = stored(view(spark, d, "v_bpo").select(*at, "chrom2", "start2", "end2", F.min("obs").over(Window.partitionBy(*at)).alias("id")))
    ends = b.select("id", F.col("chrom1").alias("chrom"), F.col("start1").alias("start"), F.col("end1").alias("end"), F.col("dir2").alias("dir")).distinct()
    seen = b.select("id", F.col("chrom2").alias("chrom"), F.col("start2").alias("start"), F.col("end2").alias("end"))
    return cluster.neighbour_pairs(ends.withColumn("is_indel", F.col("id") % 4 == 1), seen, 5000)


def large_insertions(spark: SparkSession, d: str) -> DataFrame:
    ends = view(spark, d, "v_bpo").select(F.col("obs").alias("id"), F.col("chrom1").alias("chrom"), F.col("start1").alias("pos"), (F.col("obs") % 2).alias("dir"))
    return cluster.large_insertions(ends)


def insertions_off_indels(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "v_region").withColumnRenamed("region_id", "id")
    return cluster.insertions_off_indels(r.filter("value = 1"), r.filter("value = 2").select("chrom", "start", "end")).select("id")


def redundant_duplications(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "v_region").withColumnRenamed("region_id", "id")
    insertions = r.filter("value in (2, 3)").select("chrom", "start", (F.col("start") + 1).alias("end"), (F.col("end") - F.col("start")).alias("size"))
    return cluster.redundant_duplications(r.filter("value < 2"), insertions)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "v_region")
    return r.select("chrom", "start", "end", (F.col("region_id") % 3).alias("sample"), F.col("region_id").alias("id"))


def candidate_pools(spark: SparkSession, d: str) -> DataFrame:
    return pools.leader_pools(_candidates(spark, d), 100).select("id", "pool")


def _pooled(spark: SparkSession, d: str) -> DataFrame:
    r = view(spark, d, "v_region")
    return r.select(F.col("chrom").alias("pool"), "start", "end", F.col("value").alias("size"), F.col("region_id").alias("id"), (F.col("region_id") % 7).alias("reads"), (F.col("end") - F.col("start")).alias("contig_length"), (F.col("region_id") % 3).alias("sample"))


def merged_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return pools.merge_equal(_pooled(spark, d), ["size"]).select("id", "merged_id")


def close_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Merging within pools of overlapping candidates."""
    pooled = pools.leader_pools(_candidates(spark, d), 100)
    return pools.merge_close(pooled.withColumns({"size": F.col("end") - F.col("start"), "reads": F.col("id") % 7, "contig_length": F.col("end")}), 800, 0.5)


def merge_stats(spark: SparkSession, d: str) -> DataFrame:
    return pools.merge_stats(pools.merge_equal(_pooled(spark, d), ["size"]))


def remapped_links(spark: SparkSession, d: str) -> DataFrame:
    mapping = pools.merge_equal(_pooled(spark, d), ["size"]).filter("id % 4 <> 0")
    return pools.remap(view(spark, d, "v_bpo").select("obs", (F.col("obs") % 3000).alias("link")), mapping, "link")


def cluster_groups(spark: SparkSession, d: str) -> DataFrame:
    b = view(spark, d, "v_bpo")
    return pools.groups_by_cluster(b.select(F.col("start1").alias("cluster"), F.col("evidence").alias("assembly"), F.col("obs").alias("id")))


_RUN_SQL = """, n AS (SELECT qname, chrom, pos, CAST(regexp_extract(cigar, '^(\\d+)=', 1) AS BIGINT) AS q, CAST(regexp_extract(cigar, '=(\\d+)X', 1) AS BIGINT) AS x, CAST(regexp_extract(cigar, 'X(\\d+)D', 1) AS BIGINT) AS d,
  CAST(regexp_extract(cigar, '=(\\d+)I', 1) AS BIGINT) AS i, CAST(regexp_extract(cigar, '=(\\d+)S$', 1) AS BIGINT) AS s, cigar FROM v_cigar) """
_CAND = ", r AS (SELECT region_id AS id, chrom, start, \"end\", value FROM v_region) "
ORACLES = {
    "cigar_offsets": with_views("v_cigar", body=_RUN_SQL + "SELECT qname, 3 * q + x + d AS ref_length, 3 * q + x + i + s AS read_length, CAST(0 AS BIGINT) AS left_clip, s AS right_clip, x + d + i AS edits, true AS has_matches FROM n"),
    "gap_identity": with_views("v_cigar", body=_RUN_SQL + "SELECT qname, round(3 * q / (3 * q + x + 2), 6) AS identity FROM n"),
    "rendered_runs": with_views("v_cigar", body=_RUN_SQL + "SELECT qname, round(3 * q / (3 * q + x + 2), 6) AS identity, cigar AS rendered FROM n"),
    "covered_segments": with_views("v_cigar", body=_RUN_SQL + ', f AS (SELECT qname, pos AS start, CASE WHEN d >= 30 THEN pos + q + x ELSE pos + 3 * q + x + d END AS "end" FROM n UNION ALL SELECT qname, pos + q + x + d, pos + 3 * q + x + d FROM n WHERE d >= 30) SELECT * FROM f'),
    "indel_evidence": with_views("v_cigar", body=_RUN_SQL + 'SELECT qname, chrom, pos + q + x - 1 AS start, pos + q + x + d AS "end", 0 AS inserted FROM n WHERE d >= 25 UNION ALL SELECT qname, chrom, pos + 2 * q + x + d - 1, pos + 2 * q + x + d, i FROM n WHERE i >= 25'),
    "clipped_edges": with_views("v_cigar", body=""", n AS (SELECT row_number() OVER () AS id, qname, regexp_extract_all(cigar, '(\\d+)([IDSX=])', 1) AS a, regexp_extract_all(cigar, '(\\d+)([IDSX=])', 2) AS o FROM v_cigar),
        r AS (SELECT id, qname, i, CAST(a[i] AS BIGINT) AS n, o[i] AS op FROM (SELECT *, unnest(generate_series(1, len(o))) AS i FROM n)),
        p AS (SELECT *, coalesce(sum(CASE WHEN op IN ('D', 'X', '=') THEN n END) OVER (PARTITION BY id ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ref, qname % 55 AS least FROM r),
        q AS (SELECT id, qname, i, 0 AS j, op, n - greatest(0, least(n, least - ref)) AS n FROM p WHERE op IN ('X', '=') UNION ALL SELECT id, qname, i, 1, 'S', greatest(0, least(n, least - ref)) FROM p WHERE op IN ('X', '=')
          UNION ALL SELECT id, qname, i, 0, CASE WHEN op = 'I' AND ref < least THEN 'S' ELSE op END, n FROM p WHERE op IN ('I', 'S') OR (op = 'D' AND ref > least)),
        s AS (SELECT *, coalesce(sum(CASE WHEN op IN ('D', 'X', '=') THEN n END) OVER (PARTITION BY id ORDER BY i, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ref, qname % 70 AS least FROM q),
        t AS (SELECT id, qname, i, j, 1 AS k, op, n - greatest(0, least(n, least - ref)) AS n FROM s WHERE op IN ('X', '=') UNION ALL SELECT id, qname, i, j, 0, 'S', greatest(0, least(n, least - ref)) FROM s WHERE op IN ('X', '=')
          UNION ALL SELECT id, qname, i, j, 0, CASE WHEN op = 'I' AND ref < least THEN 'S' ELSE op END, n FROM s WHERE op IN ('I', 'S') OR (op = 'D' AND ref > least)),
        m AS (SELECT id, CAST(sum(CASE WHEN op = 'D' AND ref <= least THEN n WHEN op IN ('X', '=') THEN greatest(0, least(n, least - ref)) ELSE 0 END) AS BIGINT) AS moved FROM s GROUP BY id),
        u AS (SELECT *, CASE WHEN lag(op) OVER (PARTITION BY id ORDER BY i, j, k) = op THEN 0 ELSE 1 END AS new FROM t WHERE n > 0),
        v AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY i, j, k) AS run FROM u),
        w AS (SELECT id, qname, run, CAST(sum(n) AS BIGINT) || min(op) AS x FROM v GROUP BY ALL)
        SELECT qname, string_agg(x, '' ORDER BY run) AS kept, min(moved) AS moved FROM w JOIN m USING (id) GROUP BY id, qname"""),
    "clip_evidence": with_views("v_cigar", body=_RUN_SQL + "SELECT qname, chrom, pos + 3 * q + x + d - 1 AS pos, 0 AS dir, s AS clipped FROM n WHERE s >= 500"),
    "closest_position": with_views("v_cigar", body=_RUN_SQL + """SELECT qname, CASE WHEN t < q + x THEN t WHEN t < q + x + d THEN q + x - 1 WHEN t < 2 * q + x + d THEN t - d WHEN t < 3 * q + x + d THEN t - d + i ELSE 3 * q + x + i - 1 END AS at_most,
        CASE WHEN t < q + x THEN t WHEN t < q + x + d THEN q + x WHEN t < 2 * q + x + d THEN t - d WHEN t < 3 * q + x + d THEN t - d + i END AS at_least FROM (SELECT *, qname % 90 AS t FROM n)"""),
    "sam_bins": with_views("v_read", body='SELECT qname, seg, CASE WHEN start >> 14 = ("end" - 1) >> 14 THEN 4681 + (start >> 14) WHEN start >> 17 = ("end" - 1) >> 17 THEN 585 + (start >> 17) WHEN start >> 20 = ("end" - 1) >> 20 THEN 73 + (start >> 20) WHEN start >> 23 = ("end" - 1) >> 23 THEN 9 + (start >> 23) WHEN start >> 26 = ("end" - 1) >> 26 THEN 1 + (start >> 26) ELSE 0 END AS sam_bin, CASE WHEN strand = 1 THEN 199 - start % 200 ELSE start % 200 END AS sequencing_pos FROM v_read'),
    "usable_reads": with_views("v_read", body="SELECT qname, seg FROM v_read WHERE (flag & 1796) = 0 AND mapq >= 5"),
    "split_junctions": with_views("v_read", body=', p AS (SELECT *, lead(chrom) OVER w AS c2, lead(start) OVER w AS s2, lead("end") OVER w AS e2, lead(strand) OVER w AS t2, lead(mapq) OVER w AS m2 FROM v_read WINDOW w AS (PARTITION BY qname ORDER BY seg, chrom, start, "end", strand, mapq)) SELECT qname, seg, chrom AS chrom1, CASE WHEN strand = 0 THEN "end" - 1 ELSE start - 1 END AS pos1, CASE WHEN strand = 0 THEN 0 ELSE 1 END AS dir1, c2 AS chrom2, CASE WHEN t2 = 0 THEN s2 - 1 ELSE e2 - 1 END AS pos2, CASE WHEN t2 = 0 THEN 1 ELSE 0 END AS dir2 FROM p WHERE c2 IS NOT NULL AND mapq >= 5 AND m2 >= 5'),
    "breakpoint_reads": with_views("v_segment", body=""",
        w AS (SELECT *, lag(chrom) OVER w AS c0, lag(start) OVER w AS s0, lag("end") OVER w AS e0, lag(read_end) OVER w AS r0, lead(chrom) OVER w AS c2, lead(start) OVER w AS s2, lead("end") OVER w AS e2, lead(strand) OVER w AS t2, lead(read_start) OVER w AS r2
          FROM v_segment WINDOW w AS (PARTITION BY qname ORDER BY seg, chrom, start, "end", strand, read_start, read_end)),
        j AS (SELECT qname * 16 + seg AS cluster, chrom AS chrom1, CASE WHEN strand = 0 THEN "end" - 1 ELSE start - 1 END + qname % 23 - 11 AS start1, 3 AS n, strand AS dir1, c2 AS chrom2, CASE WHEN t2 = 0 THEN s2 - 1 ELSE e2 - 1 END + 2 * (qname % 23 - 11) AS start2, 1 - t2 AS dir2 FROM w WHERE c2 IS NOT NULL
          UNION ALL SELECT qname * 16 + seg + 8, chrom, start + until - 1 + qname % 23 - 11, 1, 0, chrom, start + until - 1 + qname % 23 - 11 + gone, 1 FROM v_segment),
        m AS (SELECT j.*, w.*, start1 + n AS end1, start2 - start1 AS size, least(100, CAST(floor((start2 - start1) / 2) AS BIGINT)) AS slack, start + until AS p, (dir1 = 0) <> (strand = 1) AS later FROM j JOIN w ON chrom1 = chrom AND start1 - 10 < "end" AND start < start1 + n + 10),
        a AS (SELECT *, CASE WHEN dir1 = 0 AND dir2 = 1 AND chrom1 = chrom2 AND greatest(p - end1, start1 - p - 1, 0) <= slack AND abs(gone - size) <= slack THEN until - 1 END AS gap,
          CASE WHEN abs(CASE WHEN dir1 = 0 THEN "end" - 1 ELSE start END - start1) <= 200 AND CASE WHEN later THEN c2 ELSE c0 END = chrom2
            AND abs(CASE WHEN dir2 = 0 THEN CASE WHEN later THEN e2 ELSE e0 END - 1 ELSE CASE WHEN later THEN s2 ELSE s0 END END - start2) <= 200 THEN CASE WHEN later THEN r2 - 1 ELSE r0 END END AS crossed FROM m),
        k AS (SELECT *, coalesce(gap, CASE WHEN strand = 1 THEN read_length - crossed - 2 ELSE crossed END) AS x FROM a),
        f AS (SELECT *, greatest(0, x - 300) AS first, least(read_length, x + 301) AS last FROM k WHERE x IS NOT NULL),
        o AS (SELECT *, row_number() OVER (PARTITION BY cluster, qname ORDER BY last - first DESC, is_primary DESC, start, seg, strand, x) AS i, CASE WHEN x + 301 > read_length THEN 1 ELSE 0 END AS r, CASE WHEN x < 300 THEN 1 ELSE 0 END AS l FROM f WHERE last > first),
        u AS (SELECT *, l - r AS clip FROM o WHERE i = 1)
        SELECT cluster, qname, seg, first, last, CAST(clip AS BIGINT) AS clip, row_number() OVER (PARTITION BY cluster ORDER BY clip, CASE WHEN clip <> 0 THEN first - last ELSE 0 END, qname) - 1 AS rank FROM u"""),
    "read_neighbours": with_views("v_bpo", body="SELECT qname, obs, lag(obs) OVER w AS before, lead(obs) OVER w AS after FROM v_bpo WINDOW w AS (PARTITION BY qname ORDER BY start1, obs)"),
    "breakpoint_distance": with_views("v_bpo", body=', m AS (SELECT *, inserted * 9 - 100 AS m1, inserted * 9 - 100 + evidence * 30 AS m2 FROM v_bpo), g AS (SELECT obs, dir1 = dir2 AS same, greatest(abs(m1) - 1, 0) AS d1, greatest(abs(m2) - 1, 0) AS d2, (m1 + 1 >= 0) = (m2 + 1 >= 0) AS way FROM m) SELECT obs, CASE WHEN same <> way THEN greatest(d1, d2) ELSE d1 + d2 END AS distance FROM g'),
    "evidence_counts": with_views("v_bpo", body=", m AS (SELECT start2 AS cluster, evidence, CASE WHEN obs % 5 <> 0 THEN qname END AS qname FROM v_bpo), u AS (SELECT cluster, min(evidence) AS evidence FROM m WHERE qname IS NOT NULL GROUP BY cluster, qname UNION ALL SELECT cluster, evidence FROM m WHERE qname IS NULL) SELECT cluster, evidence, count(*) AS n FROM u GROUP BY ALL"),
    "assembly_regions": with_views("v_bpo", body="SELECT obs, CAST(CASE WHEN near THEN 1 ELSE 2 END AS BIGINT) AS region_count, CASE WHEN near THEN least(start1, start2) ELSE start1 END AS first_start, CASE WHEN near THEN greatest(end1, end2) ELSE end2 END AS last_end FROM (SELECT *, dir1 = 0 AND dir2 = 1 AND start2 - end1 <= 600 AS near FROM v_bpo)"),
    "standard_breakpoints": with_views("v_bpo", body="SELECT obs, start1 > start2 - 800 OR (start1 = start2 - 800 AND end1 > end2 - 800) OR (start1 = start2 - 800 AND end1 = end2 - 800 AND dir1 = 1 AND dir2 = 0) AS swapped FROM v_bpo"),
    "breakpoint_types": with_views("v_bpo", body=", t AS (SELECT *, start2 - start1 AS deleted, CASE WHEN obs % 50 = 0 THEN 'SBND' WHEN obs % 9 = 0 OR dir1 = dir2 THEN 'BND' WHEN dir1 = 1 THEN 'DUP' WHEN inserted > (start2 - start1) % 30 THEN 'INS' ELSE 'DEL' END AS type FROM v_bpo) SELECT obs, type, CASE WHEN obs % 2 = 0 AND ((type = 'DEL' AND deleted > 1000) OR type = 'DUP') THEN 'BND' ELSE type END AS record_type FROM t"),
    "breakpoint_sizes": with_views("v_bpo", body=""", b AS (SELECT *, CASE WHEN obs % 50 <> 0 THEN chrom2 + CASE WHEN obs % 9 = 0 THEN 1 ELSE 0 END END AS c2, CASE WHEN obs % 50 <> 0 THEN start2 - inserted * 200 END AS s2, CASE WHEN obs % 50 <> 0 THEN dir2 END AS d2 FROM v_bpo),
        p AS (SELECT *, CASE WHEN chrom1 = c2 THEN greatest(s2 - start1, 0) END AS span FROM b)
        SELECT obs, span, CASE WHEN dir1 = 0 AND d2 = 1 THEN span END AS deletion, CASE WHEN dir1 <> d2 THEN span END AS deldup, coalesce(dir1 = d2, false) AS same, end1 + evidence - start1 - 1 AS homology,
          start1 - inserted * 4000 < end1 AND start1 - inserted * 4000 >= CASE WHEN dir1 = 1 THEN -1 ELSE 0 END AND end1 <= 90000 - CASE WHEN dir1 = 1 THEN 1 ELSE 0 END AS valid,
          CASE WHEN obs % 5 = 0 THEN 4 WHEN obs % 3 = 0 THEN (2 * inserted + 7) // 2 ELSE 0 END AS inserted FROM p"""),
    "neighbour_pairs": with_views("v_bpo", body=""", o AS (SELECT *, min(obs) OVER (PARTITION BY chrom1, start1, end1, dir2) AS id, count(*) OVER (PARTITION BY chrom1, start1, end1, dir2) AS n FROM v_bpo),
        e AS (SELECT DISTINCT id, chrom1 AS chrom, start1 AS s, end1 AS e, dir2 AS dir FROM o WHERE n >= 2),
        p AS (SELECT l.id, l.s AS ls, l.e AS le, n.id AS next_id, n.s AS ns, n.e AS ne FROM e l JOIN e n ON l.dir = 1 AND n.dir = 0 AND l.chrom = n.chrom AND (n.s > l.s OR (n.s = l.s AND n.e > l.e)) AND n.s - l.e <= 5000 AND NOT (l.id % 4 = 1 AND n.id % 4 = 1)),
        f AS (SELECT p.id, ls, le, next_id, ns, ne, avg(greatest(ns - o.end2, o.start2 - ne, 0)) AS fit FROM p JOIN o ON o.id = p.id GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fit, ns, ne, next_id) AS k FROM f), g AS (SELECT *, row_number() OVER (PARTITION BY next_id ORDER BY fit, ls, le, id) AS m FROM k WHERE k = 1)
        SELECT id, next_id, fit FROM g WHERE m = 1"""),
    "large_insertions": with_recursive("v_bpo", body=""", o AS (SELECT obs AS id, chrom1 AS chrom, start1 AS pos, obs % 2 AS dir, row_number() OVER (PARTITION BY chrom1 ORDER BY start1, obs % 2, obs) AS i FROM v_bpo),
        j AS (SELECT chrom, i, false AS emits, NULL::BIGINT AS root, id AS other, NULL::BIGINT AS start, pos AS "end", CASE WHEN dir = 0 THEN id END AS i0, CASE WHEN dir = 0 THEN pos END AS p0, CASE WHEN dir = 1 THEN id END AS i1, CASE WHEN dir = 1 THEN pos END AS p1 FROM o WHERE i = 1
          UNION ALL SELECT chrom, i, near, oi, id, op, pos, CASE WHEN dir = 0 AND NOT near THEN id END, CASE WHEN dir = 0 AND NOT near THEN pos END, CASE WHEN dir = 1 AND NOT near THEN id END, CASE WHEN dir = 1 AND NOT near THEN pos END
          FROM (SELECT *, coalesce(pos < op + CASE WHEN dir = 1 THEN 200 ELSE 500 END, false) AS near FROM (SELECT o.*, CASE WHEN o.dir = 1 THEN j.i0 ELSE j.i1 END AS oi, CASE WHEN o.dir = 1 THEN j.p0 ELSE j.p1 END AS op FROM j JOIN o ON o.chrom = j.chrom AND o.i = j.i + 1)))
        SELECT chrom, root, other, start, "end" FROM j WHERE emits"""),
    "consolidated_regions": with_recursive("v_region", body=""", o AS (SELECT chrom, start AS s, "end" AS e, region_id AS id, row_number() OVER (PARTITION BY chrom ORDER BY start, "end", region_id) AS i FROM v_region),
        j AS (SELECT chrom, i, s, e, id, s AS first, e + 300 AS reach, id AS root FROM o WHERE i = 1
          UNION ALL SELECT chrom, i, s, e, id, CASE WHEN opens THEN s ELSE first END, CASE WHEN opens THEN e + 300 ELSE greatest(reach, e + 300) END, CASE WHEN opens THEN id ELSE root END
          FROM (SELECT o.*, j.first, j.reach, j.root, o.s - 300 >= j.reach OR o.e - j.first > 8000 AS opens FROM j JOIN o ON o.chrom = j.chrom AND o.i = j.i + 1))
        SELECT chrom, s AS start, e AS "end", id, root FROM j"""),
    "candidate_pools": with_recursive("v_region", body=""", o AS (SELECT chrom, start AS s, "end" AS e, region_id AS id, row_number() OVER (PARTITION BY chrom ORDER BY start, "end", region_id % 3, region_id) AS i FROM v_region),
        j AS (SELECT chrom, i, id, s AS ls, e AS le, id AS pool FROM o WHERE i = 1
          UNION ALL SELECT chrom, i, id, CASE WHEN joins THEN ls ELSE s END, CASE WHEN joins THEN le ELSE e END, CASE WHEN joins THEN pool ELSE id END
          FROM (SELECT o.*, j.ls, j.le, j.pool, j.ls - 100 < o.e AND o.s < j.le + 100 AS joins FROM j JOIN o ON o.chrom = j.chrom AND o.i = j.i + 1))
        SELECT id, pool FROM j"""),
    "insertions_off_indels": with_views("v_region", body=_CAND + 'SELECT id FROM r a WHERE value = 1 AND NOT EXISTS (SELECT 1 FROM r b WHERE b.value = 2 AND a.chrom = b.chrom AND a.start - 300 < b."end" AND b.start < a."end" + 300)'),
    "redundant_duplications": with_views("v_region", body=_CAND + ', m AS (SELECT a.id, a."end" - a.start AS span, b."end" - b.start AS size, row_number() OVER (PARTITION BY a.id ORDER BY b.start, b."end" - b.start) AS k FROM r a JOIN r b ON a.value < 2 AND b.value IN (2, 3) AND a.chrom = b.chrom AND a.start - 100 < b.start + 1 AND b.start < a."end" + 100 WHERE a."end" - a.start <= 50000) SELECT id FROM m WHERE k = 1 AND size * 1.1 >= span'),
    "merged_duplicates": with_views("v_region", body="SELECT region_id AS id, first_value(region_id) OVER (PARTITION BY chrom, value ORDER BY region_id % 7 DESC, \"end\" - start DESC, region_id) AS merged_id FROM v_region"),
    "merge_stats": with_views("v_region", body="SELECT count(*) AS before, count(DISTINCT m) AS after FROM (SELECT first_value(region_id) OVER (PARTITION BY chrom, value ORDER BY region_id % 7 DESC, \"end\" - start DESC, region_id) AS m FROM v_region)"),
    "remapped_links": with_views("v_region", "v_bpo", body=", m AS (SELECT region_id AS id, first_value(region_id) OVER (PARTITION BY chrom, value ORDER BY region_id % 7 DESC, \"end\" - start DESC, region_id) AS m FROM v_region) SELECT obs, coalesce(m.m, obs % 3000) AS link FROM v_bpo LEFT JOIN (SELECT * FROM m WHERE id % 4 <> 0) m ON m.id = obs % 3000"),
    "cluster_groups": with_views("v_bpo", body="SELECT start1 AS cluster, count(DISTINCT evidence) AS haplotypes, string_agg(CAST(obs AS VARCHAR), ',' ORDER BY obs) AS members FROM v_bpo GROUP BY start1"),
}
QUERIES = {f.__name__: f for f in (
    cigar_offsets, gap_identity, rendered_runs, covered_segments, clipped_edges, indel_shifts, indel_evidence, clip_evidence, closest_position, sam_bins, usable_reads, split_junctions, split_segments, breakpoint_reads, read_neighbours, breakpoint_distance,
    breakpoint_clusters, evidence_counts, assembly_regions, consolidated_regions, standard_breakpoints, breakpoint_types, breakpoint_sizes, neighbour_pairs, large_insertions, insertions_off_indels,
    redundant_duplications, candidate_pools, merged_duplicates, close_duplicates, merge_stats, remapped_links, cluster_groups,
)}
