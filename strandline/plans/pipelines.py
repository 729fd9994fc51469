"""The two pipelines as compositions of operators: ``discover`` per set of samples, ``joint_call`` over all of them.

Each returns named DataFrames; ``sources.sinks.write_stage`` keeps them as Parquet between the two (``run_discover``,
``run_joint_call``). Tables that several steps read are settled, so calling a pipeline runs Spark jobs.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cigar, intervals, variants
from ..operators import align, allele_words, cluster, evidence, gc, genotype, hmm, interval_join, matching, pools, records, sweep, trim
from ..session import settle, stored
from ..settings import DiscoverSettings, JointCallSettings, SharedSettings
from ..sources import sinks, text

OBSERVATION = ["sample", "chrom1", "start1", "end1", "dir1", "chrom2", "start2", "end2", "dir2", "evidence", "qname"]
#: Chromosome numbers of different samples are kept apart by this step, and places on a read's segments by that one.
SAMPLE_STEP, SEGMENT_STEP = 1 << 32, 1 << 40
#: Bases that a read has on both sides of an end that it spans.
BOTH_SIDES = 50
#: Bases of reference on each side of a break whose words tell alleles apart, and the words that a read must show at least.
ALLELE_FLANK, LEAST_TOLD = 100, 3
#: Bases of reference on both sides of a region that contigs are aligned to.
REFERENCE_FLANK = 3500


def usable_reads(reads: DataFrame, settings: SharedSettings) -> DataFrame:
    """Reads that pass the flags, the mapping quality and, where they have a CIGAR, the identity."""
    identity = F.when(F.col("cigar").isNotNull(), cigar.text_identity(F.col("cigar")))
    return reads.filter(evidence.usable(F.col("flag"), F.col("mapq"), identity, settings.min_mapq, settings.min_identity))


def observations(reads: DataFrame, settings: DiscoverSettings) -> DataFrame:
    """Breakpoints that single reads propose: indels (evidence 0), split reads (1); with an id from their columns, the inserted
    bases, the place on the read, and whether the ends are in the read's order (swapped: not)."""
    least = evidence.least_evidence_size(settings.min_indel, settings.noise_margin)
    indels = reads.filter("cigar is not null").select(F.struct("sample", "qname", "seg", "strand").alias("qname"), "chrom", F.col("start").alias("pos"), "cigar")
    rows = evidence.indel_evidence(indels, least)
    along = lambda seg, strand, pos: seg * SEGMENT_STEP + F.when(strand == 0, pos).otherwise(SEGMENT_STEP - 2 - pos)
    one = rows.select(
        F.col("qname.sample").alias("sample"), F.col("chrom").alias("chrom1"), F.col("start").alias("start1"), (F.col("start") + 1).alias("end1"), F.lit(0).alias("dir1"),
        F.col("chrom").alias("chrom2"), (F.col("end") - 1).alias("start2"), F.col("end").alias("end2"), F.lit(1).alias("dir2"), F.lit(0).alias("evidence"), F.col("qname.qname").alias("qname"),
        F.col("inserted").cast("long").alias("inserted"), along(F.col("qname.seg"), F.col("qname.strand"), F.col("start")).alias("read_pos"), (F.col("qname.strand") != 0).alias("swapped"),
    )
    split = evidence.junctions(reads.select(F.struct("sample", "qname").alias("qname"), "seg", "chrom", "start", "end", "strand", "mapq"), settings.min_mapq)
    swap = variants.needs_swap(*[F.col(c) for c in ("chrom1", "pos1", "pos1", "dir1", "chrom2", "pos2", "pos2", "dir2")])
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    two = split.select(
        F.col("qname.sample").alias("sample"), pick("chrom1", "chrom2").alias("chrom1"), pick("pos1", "pos2").alias("start1"), (pick("pos1", "pos2") + 1).alias("end1"), pick("dir1", "dir2").alias("dir1"),
        pick("chrom2", "chrom1").alias("chrom2"), pick("pos2", "pos1").alias("start2"), (pick("pos2", "pos1") + 1).alias("end2"), pick("dir2", "dir1").alias("dir2"), F.lit(1).alias("evidence"), F.col("qname.qname").alias("qname"),
        F.lit(None).cast("long").alias("inserted"), ((F.col("seg") + 1) * SEGMENT_STEP - 1).alias("read_pos"), swap.alias("swapped"),
    )
    return one.unionByName(two).withColumn("obs", F.xxhash64(*OBSERVATION))


def clip_observations(reads: DataFrame) -> DataFrame:
    """One-sided breakpoints (evidence 2) of long soft clips, with a second end that is the same for all."""
    clips = evidence.clip_evidence(reads.filter("cigar is not null").select(F.struct("sample", "qname").alias("qname"), "chrom", F.col("start").alias("pos"), "cigar"))
    rows = clips.select(
        F.col("qname.sample").alias("sample"), F.col("chrom").alias("chrom1"), F.col("pos").alias("start1"), (F.col("pos") + 1).alias("end1"), F.col("dir").alias("dir1"), F.col("chrom").alias("chrom2"),
        F.lit(0).cast("long").alias("start2"), F.lit(1).cast("long").alias("end2"), F.col("dir").alias("dir2"), F.lit(2).alias("evidence"), F.col("qname.qname").alias("qname"), F.lit(None).cast("long").alias("inserted"),
    )
    return rows.withColumn("obs", F.xxhash64(*OBSERVATION))


def _coded(sample: str, chrom: str) -> Column:
    return F.col(sample) * SAMPLE_STEP + F.col(chrom)


def _per_sample(seen: DataFrame) -> DataFrame:
    return seen.withColumns({c: _coded("sample", c) for c in ("chrom1", "chrom2")} | {"qname": F.xxhash64("qname")})


def _unpacked(clusters: DataFrame) -> DataFrame:
    plain = clusters.withColumn("sample", F.floor(F.col("chrom1") / SAMPLE_STEP).cast("long"))
    plain = plain.withColumns({c: F.col(c) % SAMPLE_STEP for c in ("chrom1", "chrom2")})
    return plain.withColumn("cluster", F.xxhash64("sample", "chrom1", "start1", "end1", "dir1", "chrom2", "start2", "end2", "dir2", "first_obs"))


def cluster_neighbours(seen: DataFrame, clusters: DataFrame, distance: int) -> DataFrame:
    """Breakends of two-region clusters that reads see follow each other: (sample, cluster, end, next_cluster, next_end, fit).

    Where two observations follow each other on a read, the end at which the read leaves the first and the end at which it enters the second
    are observed neighbours. An observation belongs to the cluster of its kind that has its read and encloses it.
    """
    place = lambda i: F.struct(F.col(f"chrom{i}").alias("chrom"), F.col(f"start{i}").alias("start"), F.col(f"end{i}").alias("end"))
    ends = seen.select(
        "sample", "qname", "read_pos", "obs", "swapped", F.when(F.col("swapped"), 1).otherwise(2).alias("leave_end"), F.when(F.col("swapped"), place(1)).otherwise(place(2)).alias("leave"),
        F.when(F.col("swapped"), 2).otherwise(1).alias("enter_end"), F.when(F.col("swapped"), place(2)).otherwise(place(1)).alias("enter"),
    )
    order = Window.partitionBy("sample", "qname").orderBy("read_pos", "obs", "swapped")
    follow = ends.withColumn("_next", F.lead(F.struct("obs", "enter_end", "enter")).over(order)).filter("_next is not null")
    both = F.explode(F.array(F.struct(F.col("obs").alias("obs"), F.col("leave_end").alias("end"), F.col("_next.enter").alias("at")), F.struct(F.col("_next.obs").alias("obs"), F.col("_next.enter_end").alias("end"), F.col("leave").alias("at"))))
    seen_at = follow.select(both.alias("x")).select("x.obs", F.col("x.end").alias("side"), "x.at")
    named = clusters.filter("region_count = 2").select("sample", "cluster", "chrom1", "chrom2", "dir1", "dir2", *[F.col(f"{c}{i}").alias(f"_{c}{i}") for c in ("start", "end") for i in (1, 2)], F.explode("qnames").alias("_qname"))
    own = seen.withColumn("_qname", F.xxhash64("qname")).join(named, ["sample", "chrom1", "chrom2", "dir1", "dir2", "_qname"])
    own = own.filter("start1 >= _start1 and end1 <= _end1 and start2 >= _start2 and end2 <= _end2").groupBy("obs").agg(F.min("cluster").alias("cluster"), F.min("sample").alias("_sample"))
    observed = seen_at.join(own, "obs")
    observed = settle(observed.select(F.struct("cluster", "side").alias("id"), (F.col("_sample") * SAMPLE_STEP + F.col("at.chrom")).alias("chrom"), "at.start", "at.end"))
    is_indel = (F.col("chrom1") == F.col("chrom2")) & (F.col("dir1") == 0) & (F.col("dir2") == 1)
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), _coded("sample", f"chrom{i}").alias("chrom"), F.col(f"start{i}").alias("start"), F.col(f"end{i}").alias("end"), F.col(f"dir{i}").alias("dir")) for i in (1, 2)]))
    breakends = clusters.filter("region_count = 2").select("cluster", is_indel.alias("is_indel"), sides.alias("s")).select(F.struct("cluster", F.col("s.side").alias("side")).alias("id"), "s.chrom", "s.start", "s.end", F.col("s.dir").alias("dir"), "is_indel")
    pairs = cluster.neighbour_pairs(breakends, observed, distance)
    found = pairs.select(F.col("id.cluster").alias("cluster"), F.col("id.side").alias("end"), F.col("next_id.cluster").alias("next_cluster"), F.col("next_id.side").alias("next_end"), "fit")
    return found.join(clusters.select("cluster", "sample"), "cluster").select("sample", "cluster", "end", "next_cluster", "next_end", "fit")


def large_insertion_candidates(clips: DataFrame, clusters: DataFrame, settings: DiscoverSettings) -> DataFrame:
    """Insertions whose sides only soft clips show, off all indel regions: (sample, id, chrom, start, end)."""
    groups = _unpacked(cluster.breakpoint_clusters(_per_sample(clips), settings.cluster_distance, settings.min_evidence))
    ends = settle(groups.select(F.col("cluster").alias("id"), _coded("sample", "chrom1").alias("chrom"), F.col("start1").alias("pos"), F.col("dir1").alias("dir")))
    found = cluster.large_insertions(ends).select(F.col("root").alias("id"), "chrom", F.least("start", "end").alias("start"), (F.greatest("start", "end") + 1).alias("end"))
    indels = clusters.filter("region_count = 1").select(_coded("sample", "chrom1").alias("chrom"), F.col("regions")[0]["start"].alias("start"), F.col("regions")[0]["end"].alias("end"))
    kept = cluster.insertions_off_indels(settle(found), indels)
    return kept.select(F.floor(F.col("chrom") / SAMPLE_STEP).cast("long").alias("sample"), "id", (F.col("chrom") % SAMPLE_STEP).alias("chrom"), "start", "end")


def consolidated(clusters: DataFrame) -> DataFrame:
    """One-region clusters by the region that is assembled for them: (sample, cluster, root, chrom, start, end)."""
    regions = clusters.filter("region_count = 1").select(_coded("sample", "chrom1").alias("chrom"), F.col("regions")[0]["start"].alias("start"), F.col("regions")[0]["end"].alias("end"), F.col("cluster").alias("id"))
    joined = cluster.consolidate(regions)
    whole = Window.partitionBy("chrom", "root")
    return joined.select(F.floor(F.col("chrom") / SAMPLE_STEP).cast("long").alias("sample"), F.col("id").alias("cluster"), "root", (F.col("chrom") % SAMPLE_STEP).alias("chrom"), F.min("start").over(whole).alias("start"), F.max("end").over(whole).alias("end"))


def refine(reads: DataFrame, clusters: DataFrame, regions: DataFrame, reference: DataFrame, settings: DiscoverSettings) -> dict[str, DataFrame]:
    """Contigs and precise indels of the consolidated regions, and the duplications that an insertion among these explains.

    reads need seq; reference has chunks (chrom, start, seq).
    """
    roots = regions.select("sample", F.col("root").alias("cluster"), "chrom", "start", "end").distinct()
    pieces = reads.filter("cigar is not null and seq is not null").select(F.col("qname").cast("string").alias("qname"), _coded("sample", "chrom").alias("chrom"), "start", "end", "cigar", "seq", F.lit(True).alias("is_primary"))
    least = evidence.least_evidence_size(settings.min_indel, settings.noise_margin)
    trimmed = settle(trim.trimmed_reads(pieces, roots.withColumn("chrom", _coded("sample", "chrom")), least_evidence=least))
    contigs = settle(trim.extend_contigs(align.assemble(trimmed.select("cluster", "qname", "seq")), trimmed))
    spans = roots.select(F.col("cluster").alias("id"), "chrom", F.greatest(F.lit(0), F.col("start") - REFERENCE_FLANK).alias("start"), (F.col("end") + REFERENCE_FLANK).alias("end"))
    refs = text.sequence_of(reference, spans).join(spans.select("id", F.col("start").alias("ref_start")), "id").select(F.col("id").alias("cluster"), F.col("seq").alias("ref"), "ref_start")
    found = align.contig_indels(contigs.join(refs, "cluster"), settings.min_indel).join(roots.select("cluster", "sample", "chrom"), "cluster")
    candidates = settle(found.select("sample", "cluster", "assembly", "chrom", "start", "end", "inserted", "homology"))
    inserted = candidates.filter("inserted <> ''").select(_coded("sample", "chrom").alias("chrom"), "start", (F.col("start") + 1).alias("end"), F.length("inserted").cast("long").alias("size"))
    dups = clusters.filter("chrom1 = chrom2 and dir1 = 1 and dir2 = 0 and start2 > start1").select(F.col("cluster").alias("id"), _coded("sample", "chrom1").alias("chrom"), F.col("start1").alias("start"), F.col("start2").alias("end"))
    return {"contigs": contigs, "candidates": candidates, "redundant": cluster.redundant_duplications(dups, inserted).withColumnRenamed("id", "cluster")}


def split_reads(reads: DataFrame, clusters: DataFrame) -> DataFrame:
    """Reads that show a two-region cluster of their sample, turned to its first end and in order: (sample, cluster, rank, qname, clip, seq, prefix, suffix).

    A read's bases are its longest sequence, so that hard-clipped segments lack nothing.
    """
    read, runs, reverse = F.struct("sample", F.col("qname").cast("string").alias("qname")).alias("qname"), cigar.parse(F.col("cigar")), F.col("strand") == 1
    known = reads.filter("cigar is not null")
    left, right, length = cigar.leading_clip(runs), cigar.trailing_clip(runs), cigar.clipped_read_length(runs)
    segments = known.select(
        read, "seg", _coded("sample", "chrom").alias("chrom"), "start", "end", "strand", F.when(reverse, right).otherwise(left).alias("read_start"),
        (length - F.when(reverse, left).otherwise(right)).alias("read_end"), length.alias("read_length"), "cigar", (F.col("flag").bitwiseAND(0x800) == 0).alias("is_primary"),
    )
    breaks = clusters.filter("region_count = 2").select("cluster", *[(_coded("sample", f"chrom{i}").alias(f"chrom{i}") if c == "chrom" else F.col(f"{c}{i}")) for i in (1, 2) for c in ("chrom", "start", "end", "dir")])
    hits = settle(trim.ordered_breakpoint_reads(trim.breakpoint_ranges(segments, breaks)))
    turned = F.when(reverse, variants.rev_comp("seq")).otherwise(F.col("seq"))
    own = known.filter("seq is not null").select(read, turned.alias("seq")).join(hits.select("qname").distinct(), "qname", "left_semi")
    bases = own.groupBy("qname").agg(F.max_by("seq", F.struct(F.length("seq"), "seq")).alias("seq"))
    found = trim.cut_pieces(hits, bases)
    return found.select(F.col("qname.sample").alias("sample"), "cluster", "rank", F.col("qname.qname").alias("qname"), "clip", "seq", "prefix", "suffix")


def discover(reads: DataFrame, content: DataFrame | None = None, excluded: DataFrame | None = None, settings: DiscoverSettings = DiscoverSettings(), expected: DataFrame | None = None, sequences: DataFrame | None = None, reference: DataFrame | None = None) -> dict[str, DataFrame]:
    """reads (sample, qname, seg, chrom, start, end, strand, mapq, flag, cigar or null, and seq, if they are to be assembled); content
    (chrom, bin, gc, at), or sequences (chrom, seq) that it is counted from; excluded and expected (chrom, start, end; value)
    regions; reference chunks (chrom, start, seq).

    Tables: settings, depth, max_depth, clusters, regions, neighbours, evidence, insertions; with copy numbers cells, segments, haploid; with
    reference and seq contigs, candidates, split_reads.
    """
    usable = usable_reads(reads, settings)
    # read by each of the steps that follow, so CIGARs are looked at once; bases are left where they are
    used = stored(usable.select("sample", "qname", "seg", "chrom", "start", "end", "strand", "mapq", "cigar"))
    size = settings.bin_size
    bins = sweep.depth_bins(used, size, ("sample", "chrom"))
    depth = bins.select("sample", "chrom", "bin", (F.col("bases") / size).alias("depth"))
    if excluded is not None:
        spans = depth.select("chrom", "bin").distinct().withColumns({"start": F.col("bin") * size, "end": (F.col("bin") + 1) * size})
        masked = interval_join.interval_semi(spans, excluded, ["chrom", "bin"]).select("chrom", "bin", F.lit(True).alias("_masked"))
        depth = depth.join(masked, ["chrom", "bin"], "left").withColumn("depth", F.when(F.col("_masked").isNull(), F.col("depth"))).select("sample", "chrom", "bin", "depth")
    depth = settle(depth)
    out = {"settings": reads.sparkSession.createDataFrame([(k, str(v)) for k, v in asdict(settings).items()], "name string, value string"), "depth": depth}
    if settings.disable_cnv:
        out["max_depth"] = sweep.regions_over(used, settings.max_depth, ("sample", "chrom"))
    else:
        out |= copy_numbers(sweep.select_chroms(depth, settings.chrom_regex), content if sequences is None else gc.window_content(sequences, size, settings.gc_window), expected, settings)
        limits = sweep.scoring_depth_limit(out["haploid"], settings.max_depth_factor, settings.max_depth)
        changes = sweep.edges(used, ("sample", "chrom")).join(limits, "sample")  # a row for each sample
        out["max_depth"] = sweep.regions_where(changes, lambda depth: depth > F.col("max_depth"), ("sample", "chrom"))
    seen = stored(observations(used, settings))
    found = _unpacked(cluster.breakpoint_clusters(_per_sample(seen), settings.cluster_distance, settings.min_evidence))
    clusters = settle(cluster.assembly_regions(found))
    out["regions"] = consolidated(clusters)
    out["neighbours"] = cluster_neighbours(seen, clusters, settings.close_breakends)
    if not settings.disable_large_insertions:
        out["insertions"] = large_insertion_candidates(stored(clip_observations(used)), clusters, settings)
    if reference is not None and "seq" in reads.columns:
        refined = refine(usable, clusters, out["regions"], reference, settings)
        clusters = settle(clusters.join(refined.pop("redundant"), "cluster", "left_anti"))
        out |= refined | {"split_reads": split_reads(usable, clusters)}
    # a read may show what its sample has too little evidence of for a cluster
    out["evidence"] = seen.withColumn("qname", F.xxhash64("qname")).select(*[c for c in OBSERVATION if c != "evidence"])
    return out | {"clusters": clusters}


def copy_numbers(depth: DataFrame, content: DataFrame | None, expected: DataFrame | None, settings: DiscoverSettings) -> dict[str, DataFrame]:
    """cells (sample, chrom, bin, depth, reduction, kind, expected), segments and haploid depths. The rounds run here, not when read."""
    if content is not None:
        levels = gc.content_levels(content, settings.gc_levels)
        table = gc.correction(gc.level_depth(depth, levels), settings.bin_size, settings.gc_levels)
        corrected = depth.join(levels, ["chrom", "bin"]).join(table, ["sample", "gc_level"])
    else:
        corrected = depth.withColumn("reduction", F.lit(1.0))
    if expected is not None:
        places = depth.select("chrom", "bin").distinct().withColumns({"start": F.col("bin") * settings.bin_size, "end": (F.col("bin") + 1) * settings.bin_size, "place": F.struct("chrom", "bin")})
        usual = interval_join.majority_value(places, expected, "place").select("place.chrom", "place.bin", F.col("value").alias("expected"))
        corrected = corrected.join(usual, ["chrom", "bin"])
    else:
        corrected = corrected.withColumn("expected", F.lit(interval_join.DEFAULT_COPIES).cast("long"))
    cells = settle(corrected.select("sample", "chrom", "bin", "depth", "reduction", F.lit(hmm.SAME).alias("kind"), "expected"))
    states, haploid = hmm.converge(cells)
    return {"cells": cells, "segments": hmm.segments(states), "haploid": haploid}


def merged_variants(clusters: DataFrame, settings: JointCallSettings) -> DataFrame:
    """Clusters of all samples whose first ends pool and whose types agree: one row per member, with its variant (sv), pool and evidence."""
    kind = variants.sv_type(F.col("chrom1"), F.col("chrom2"), F.col("dir1"), F.col("dir2"), F.col("start2") - F.col("start1"), F.coalesce("insert_high", F.lit(0)))
    rows = clusters.withColumn("kind", kind).withColumn("class", F.xxhash64("kind", "dir1", "dir2", "chrom1", "chrom2"))
    pooled = pools.leader_pools(rows.select(F.col("class").alias("chrom"), F.col("start1").alias("start"), F.col("end1").alias("end"), "sample", F.col("cluster").alias("id")), settings.pool_margin)
    members = pooled.select(F.col("id").alias("cluster"), "pool").join(rows, "cluster")
    deleted = variants.deletion_size(*[F.col(c) for c in ("chrom1", "start1", "dir1", "chrom2", "start2", "dir2")])
    size = pools.merge_size(F.floor((F.col("insert_low") + F.col("insert_high")) / 2), deleted)
    # clusters aren't exact to the base as contigs are: their ends may differ by as much as pooling allows
    close = pools.merge_close(
        members.select("pool", F.col("cluster").alias("id"), "sample", F.col("start1").alias("start"), F.col("end2").alias("end"), size.alias("size"), F.col("evidence").alias("reads"), (F.col("end1") - F.col("start1")).alias("contig_length")),
        max(settings.pool_margin, pools.CLOSE),
    )
    return members.join(close.withColumnRenamed("id", "cluster"), "cluster").withColumnRenamed("merged_id", "sv")


def supporting(best: DataFrame, members: DataFrame, seen: DataFrame | None, margin: int) -> DataFrame:
    """The reads that show each variant: (pool, sv, sample, qname).

    Those of its clusters; and, of the reads that support no variant of its pool so, the ones whose breakpoint lies within ``margin`` of
    it at both ends and nearer than to the pool's others (the lower number on a tie). These speak for samples that have no cluster of their own.
    """
    own = members.select("pool", "sv", "sample", F.explode("qnames").alias("qname")).distinct()
    if seen is None:
        return own
    place = ["chrom1", "dir1", "chrom2", "dir2"]
    spans = best.select("pool", "sv", *place, F.col("start1").alias("start"), F.col("end1").alias("end"), F.col("start2").alias("_vs"), F.col("end2").alias("_ve"))
    shown = seen.select(*place, F.col("start1").alias("start"), F.col("end1").alias("end"), "start2", "end2", "sample", "qname")
    # a cluster's first ends are a chain of observations, so that the variants' buckets are bounded by these, which are written once
    met = interval_join.flat_join(shown, spans, place, margin=margin)
    second = intervals.distance(F.col("start2"), F.col("end2"), F.col("_vs"), F.col("_ve"))
    first = intervals.distance(F.col("start"), F.col("end"), F.col("right_start"), F.col("right_end"))
    near = met.filter(second <= margin).groupBy("pool", "sample", "qname").agg(F.min(F.struct((first + second).alias("gap"), "sv")).alias("_b"))
    more = near.join(own.select("pool", "sample", "qname").distinct(), ["pool", "sample", "qname"], "left_anti")
    return own.unionByName(more.select("pool", F.col("_b.sv").alias("sv"), "sample", "qname"))


def allele_scores(best: DataFrame, support: DataFrame, used: DataFrame, numbered: DataFrame) -> DataFrame:
    """What each read says about each variant that it supports or spans: (sv, sample, qname, condition, allele, score, other).

    The two ends are the conditions. A read that supports the variant scores 1 for it and 0.5 for the reference, one that spans an end
    without support the other way round; one that supports another variant of the pool scores 1.5 for that one's allele, which
    overlaps, on the haplotype ``other``, or 0.75 if it supports this one as well.
    """
    ends = best.select("pool", "sv", F.explode(F.array(*[F.struct(F.lit(i - 1).alias("condition"), F.col(f"chrom{i}").alias("chrom"), F.col(f"start{i}").alias("pos")) for i in (1, 2)])).alias("e")).select("pool", "sv", "e.*")
    spans = used.select("chrom", (F.col("start") + BOTH_SIDES).alias("start"), (F.col("end") - BOTH_SIDES).alias("end"), "sample", F.xxhash64("qname").alias("qname"))
    spanning = interval_join.point_join(ends, spans).select("pool", "sv", "sample", "qname", "condition", F.lit(False).alias("mine"))
    told = spanning.unionByName(support.withColumn("condition", F.lit(0)).withColumn("mine", F.lit(True)))
    # one row a read and variant: the ends it tells of, and whether it supports it; dealt by what they meet the other variants by
    each = told.repartition("pool", "sample", "qname").groupBy("pool", "sv", "sample", "qname").agg(F.collect_set("condition").alias("conditions"), F.bool_or("mine").alias("mine"))
    shown = support.join(numbered.select("sv", "haplotype"), "sv").groupBy("pool", "sample", "qname").agg(F.collect_set(F.struct("sv", "haplotype")).alias("_all"))
    rows = each.join(shown, ["pool", "sample", "qname"], "left").withColumn("_others", F.filter(F.coalesce("_all", F.array()), lambda x: x["sv"] != F.col("sv")))
    entry = lambda allele, score, other: F.struct(F.lit(allele).alias("allele"), score.cast("double").alias("score"), other.cast("long").alias("other"))
    none, kind = F.lit(None), "array<struct<allele:int,score:double,other:bigint>>"
    both = F.array(entry(genotype.REF, F.when(F.col("mine"), 0.5).otherwise(1.0), none), entry(genotype.ALT, F.when(F.col("mine"), 1.0).otherwise(0.5), none))
    third = F.transform("_others", lambda x: entry(genotype.OVERLAP, F.when(F.col("mine"), 0.75).otherwise(1.5), x["haplotype"]))
    found = rows.select("sv", "sample", "qname", F.explode("conditions").alias("condition"), F.concat(both.cast(kind), third.cast(kind)).alias("_e"))
    return found.select("sv", "sample", "qname", "condition", F.explode("_e").alias("e")).select("sv", "sample", "qname", "condition", "e.allele", "e.score", "e.other")


def allele_sequences(best: DataFrame, numbered: DataFrame, reference: DataFrame, flank: int = ALLELE_FLANK) -> DataFrame:
    """The alleles of each pool all of whose variants are exact: (group, allele, seq), several rows an allele. reference: chunks (chrom, start, seq).

    Allele 0 is the reference at both ends of each variant; a variant's is its haplotype and 1: the reference on the sides that its ends
    extend to, joined. A variant is exact if all its observations agree in both places and none shows inserted bases.
    """
    exact = (F.col("end1") - F.col("start1") == 1) & (F.col("end2") - F.col("start2") == 1) & (F.coalesce(F.col("insert_high"), F.lit(0)) == 0)
    known = best.groupBy("pool").agg(F.bool_and(F.coalesce(exact, F.lit(False))).alias("_exact")).filter("_exact")
    rows = best.join(known, "pool", "left_semi").join(numbered.select("sv", "haplotype"), "sv")
    end = lambda i: F.struct(F.lit(i).alias("i"), F.col(f"chrom{i}").alias("chrom"), (F.col(f"start{i}") + 1).alias("at"), F.col(f"dir{i}").alias("dir"))
    ends = rows.select("pool", "sv", "haplotype", F.explode(F.array(end(1), end(2))).alias("e")).select("pool", "sv", "haplotype", "e.*")
    spans = ends.select(F.struct("pool", "sv", "haplotype", "i", "at", "dir").alias("id"), "chrom", F.greatest(F.lit(0), F.col("at") - flank).alias("start"), (F.col("at") + flank).alias("end"))
    found = text.sequence_of(reference, spans).select("id.*", "seq").withColumn("_left", F.least(F.col("at"), F.lit(flank)).cast("int"))
    whole = found.select(F.col("pool").alias("group"), F.lit(0).cast("long").alias("allele"), "seq")
    side = F.when(F.col("dir") == variants.LEFT, F.substring(F.col("seq"), F.lit(1), F.col("_left"))).otherwise(F.substring(F.col("seq"), F.col("_left") + 1, F.length("seq")))
    pick = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c))).alias(f"_{c}{i}")
    both = found.withColumn("side", side).groupBy("pool", "sv", "haplotype").agg(*[pick(c, i) for c in ("side", "dir") for i in (1, 2)])
    joined = trim.derived_sequence(F.col("_side1"), F.col("_side2"), F.col("_dir1"), F.col("_dir2"), spacer="")
    return whole.unionByName(both.select(F.col("pool").alias("group"), (F.col("haplotype") + 1).alias("allele"), joined.alias("seq")))


def word_scores(best: DataFrame, numbered: DataFrame, used: DataFrame, reference: DataFrame, flank: int = ALLELE_FLANK) -> DataFrame:
    """As ``allele_scores``, by what reads' own bases show: the share that each allele has in the words of a read that tell a pool's alleles apart.

    used (sample, qname, chrom, start, end, cigar, seq; both null where unknown). A read speaks of the variants whose ends it comes near, if
    it has LEAST_TOLD such words or more; only pools whose alleles are known exactly have rows.
    """
    alleles = settle(allele_sequences(best, numbered, reference, flank))
    known = best.join(alleles.select(F.col("group").alias("pool")).distinct(), "pool", "left_semi")
    ends = known.select("pool", "sv", F.explode(F.array(*[F.struct(F.col(f"chrom{i}").alias("chrom"), (F.col(f"start{i}") + 1 - flank).alias("start"), (F.col(f"start{i}") + 1 + flank).alias("end")) for i in (1, 2)])).alias("e")).select("pool", "sv", "e.*")
    based = used.filter("cigar is not null and seq is not null").select("sample", F.xxhash64("qname").alias("qname"), "chrom", "start", "end", "cigar", "seq")
    met = interval_join.interval_join(ends, based.withColumnRenamed("cigar", "_cigar")).withColumn("_runs", cigar.parse(F.col("_cigar")))
    # the read's bases around the break: behind its last base before the break, or else before its first one behind it
    at = F.col("start") + flank
    before, behind = cigar.closest_read_position(F.col("_runs"), F.col("right_start"), at - 1), cigar.closest_read_position(F.col("_runs"), F.col("right_start"), at, False)
    cut = F.coalesce(before + 1, behind)
    first = F.greatest(F.lit(0), cut - flank)
    piece = F.substring(F.col("seq"), (first + 1).cast("int"), (cut + flank - first).cast("int"))
    near = settle(met.select("pool", "sv", "sample", "qname", piece.alias("seq")))
    pieces = near.select(F.col("pool").alias("group"), F.struct("sample", "qname").alias("read"), "seq").distinct()
    told = allele_words.allele_support(pieces, alleles).filter(F.col("told") >= LEAST_TOLD).select(F.col("group").alias("pool"), "read.*", F.col("allele").alias("_a"), (F.col("hits") / F.col("told")).alias("score"))
    rows = near.select("pool", "sv", "sample", "qname").distinct().join(told, ["pool", "sample", "qname"]).join(numbered.select("sv", "haplotype"), "sv")
    mine, none = F.col("_a") == F.col("haplotype") + 1, F.col("_a") == 0
    allele = F.when(none, genotype.REF).when(mine, genotype.ALT).otherwise(genotype.OVERLAP)
    return rows.select("sv", "sample", "qname", F.lit(0).alias("condition"), allele.alias("allele"), "score", F.when(~none & ~mine, F.col("_a") - 1).alias("other"))


def with_guests(native: DataFrame, order: DataFrame, scores: DataFrame, allowed: DataFrame) -> DataFrame:
    """native (group, sample, haplotype, rank) with a second haplotype for the samples that have one and may have two: the one that their reads at
    the first of their own variants score highest, on average."""
    lone = native.groupBy("group", "sample").agg(F.count(F.lit(1)).alias("_n"), F.min("haplotype").alias("_own")).filter("_n = 1")
    lone = lone.join(allowed.filter("ploidy > 1"), ["group", "sample"]).select("group", "sample", "_own")
    first = order.filter(F.col("relation") == genotype.NATIVE).groupBy("group", "sample").agg(F.min_by("sv", "place").alias("sv"))
    told = scores.filter(F.col("allele") == genotype.OVERLAP).join(first, ["sv", "sample"]).join(lone, ["group", "sample"]).filter("other <> _own")
    guests = genotype.guest_haplotypes(told.select("group", "sample", F.col("other").alias("haplotype"), "score"))
    return native.unionByName(guests.select("group", "sample", "haplotype", F.lit(1).cast("long").alias("rank")))


def expected_ploidies(best: DataFrame, expected: DataFrame | None, settings: JointCallSettings) -> DataFrame:
    """(sv, copies, haploid): the expected copies at both ends if they agree, and whether one copy means one haplotype."""
    if expected is None:
        copies = best.select("sv", F.lit(interval_join.DEFAULT_COPIES).cast("long").alias("copies"))
    else:
        ends = best.select("sv", F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"chrom{i}").alias("chrom"), F.col(f"start{i}").alias("start"), F.col(f"end{i}").alias("end")) for i in (1, 2)])).alias("e")).select("sv", "e.*")
        copies = interval_join.unanimous_value(ends, expected, "sv", "side").withColumnRenamed("value", "copies")
    return copies.withColumn("haploid", genotype.ploidy(F.col("copies"), settings.treat_single_copy_as_haploid) == 1)


def joint_call(reads: DataFrame, stage: dict[str, DataFrame], settings: JointCallSettings = JointCallSettings(), expected: DataFrame | None = None, reference: DataFrame | None = None) -> dict[str, DataFrame]:
    """Variants over all samples, genotyped by what each read supports: calls, records, inversions; supporting_reads if asked for; with
    copy numbers cnvs, copy_segments, matches.

    With reference chunks (chrom, start, seq) and reads that have seq, a read's own bases say which allele it has, where they tell.
    """
    members = settle(merged_variants(stage["clusters"], settings))
    best = settle(members.filter("cluster = sv").select("sv", "pool", "kind", "chrom1", "start1", "end1", "dir1", "chrom2", "start2", "end2", "dir2", "insert_high"))
    usable = usable_reads(reads, settings)
    used = stored(usable.select("sample", "qname", "chrom", "start", "end"))
    # a sample's regions of too much depth leave its variants there unscored
    ends = best.select("sv", F.explode(F.array(*[F.struct(F.col(f"chrom{i}").alias("chrom"), F.col(f"start{i}").alias("start"), F.col(f"end{i}").alias("end")) for i in (1, 2)])).alias("e")).select("sv", "e.*")
    samples = F.explode(used.agg(F.sort_array(F.collect_set("sample"))).scalar()).alias("sample")  # one row names all samples
    deep = settle(sweep.over_limit(ends.select("*", samples), stage["max_depth"]).select("sv", "sample").distinct())
    # haplotypes of a pool are its variants in order
    in_pool = Window.partitionBy("pool").orderBy("start1", "start2", "sv")
    numbered = settle(best.select("pool", "sv", (F.row_number().over(in_pool) - 1).cast("long").alias("haplotype")))
    ploidies = settle(expected_ploidies(best, expected, settings))
    of_sample = Window.partitionBy("group", "sample").orderBy("haplotype")
    native = members.select("pool", "sample", "sv").distinct().join(numbered, ["pool", "sv"]).select(F.col("pool").alias("group"), "sample", "haplotype").withColumn("rank", (F.row_number().over(of_sample) - 1).cast("long"))
    allowed = numbered.join(ploidies, "sv").groupBy(F.col("pool").alias("group")).agg(F.max(F.when(F.col("haploid"), 1).otherwise(2)).alias("ploidy"))
    allowed = settle(allowed.select("group", samples, "ploidy"))
    placed_svs = numbered.select(F.col("pool").alias("group"), "sv", "haplotype")
    support = stored(supporting(best, members, stage.get("evidence"), settings.pool_margin))
    scores = allele_scores(best, support, used, numbered)
    if reference is not None and "seq" in reads.columns:
        shown = settle(word_scores(best, numbered, usable, reference))
        scores = shown.unionByName(scores.join(shown.select("sv", "sample", "qname").distinct(), ["sv", "sample", "qname"], "left_anti"))
    scores = stored(scores.join(deep, ["sv", "sample"], "left_anti"))
    # variants in order, then a second haplotype where one is missing, then the order anew
    native = settle(with_guests(native, genotype.sample_sv_order(placed_svs, native, allowed), scores, allowed))
    order = settle(genotype.sample_sv_order(placed_svs, native, allowed))
    alleles = genotype.best_alleles(scores.select(F.struct("sv", "sample", "qname").alias("read"), "condition", "allele", "score"))
    told = stored(alleles.select("read.*", "allele", "tie"))
    # a read of an overlapping allele is on the sample's other haplotype
    pair = native.groupBy("group", "sample").agg(*[F.max(F.when(F.col("rank") == i, F.col("haplotype"))).alias(f"_h{i}") for i in (0, 1)], F.count(F.lit(1)).alias("haplotypes"))
    other = F.when(F.col("haplotype") == F.col("_h0"), F.col("_h1")).when(F.col("haplotype") == F.col("_h1"), F.col("_h0"))
    placed = order.join(numbered.select("sv", "haplotype"), "sv").join(told, ["sv", "sample"], "left").join(pair, ["group", "sample"], "left")
    assigned = placed.select("group", "sample", "place", "sv", "haplotype", F.coalesce(other, F.lit(1) - F.least(F.col("haplotype"), F.lit(1))).alias("other"), F.lit(False).alias("shared"), F.coalesce(F.col("qname").cast("string"), F.lit("")).alias("qname"), "allele", F.coalesce("tie", F.lit(False)).alias("tie"), "relation")
    counts = genotype.reserved_counts(assigned, passes=2).join(ploidies.select("sv", "haploid"), "sv")
    equal = ["chrom1", "start1", "dir1", "chrom2", "start2", "dir2", "insert_high"]
    rows = counts.join(numbered.withColumnRenamed("pool", "group"), "sv").join(native.select("group", "sample", "haplotype", "rank"), ["group", "sample", "haplotype"], "left").join(pair.select("group", "sample", "haplotypes"), ["group", "sample"], "left")
    rows = rows.join(best.select("sv", *equal), "sv").withColumns({"carried": F.col("rank").isNotNull(), "haplotypes": F.coalesce("haplotypes", F.lit(0)), "place": F.col("haplotype")})
    rows = pools.resolve_replicates(rows, equal).withColumns({"start": F.col("start1"), "end": F.when(F.col("chrom1") == F.col("chrom2"), F.greatest("start1", "start2") + 1).otherwise(F.col("start1") + 1)}).drop(*equal)
    calls = genotype.phase_sets(genotype.absorb_overlaps(genotype.genotypes(rows, settings.max_qscore), settings.max_qscore))
    calls = settle(calls.join(deep.withColumn("over_depth", F.lit(True)), ["sv", "sample"], "left").withColumn("over_depth", F.coalesce("over_depth", F.lit(False))))
    quality = genotype.joint_quality(calls, "sv", settings.max_qscore).join(calls.groupBy("sv").agg(F.bool_or("over_depth").alias("over_depth"), F.coalesce(F.max("gt"), F.lit(0)).alias("most"), F.bool_or("replicated").alias("_replicate")), "sv")
    kind_of = variants.sv_filter(F.col("_replicate"), F.col("all_excluded"))
    svs = settle(best.join(quality, "sv").join(genotype.gt_excluded(calls), "sv").withColumn("sv_filter", kind_of).withColumn("replicated", F.col("sv_filter") != "NoFilter").drop("_replicate", "all_excluded"))
    inverted = svs.filter("not replicated and chrom1 = chrom2 and dir1 = dir2 and most > 0 and not over_depth and start2 >= start1").select(F.col("sv").alias("id"), F.col("chrom1").alias("chrom"), F.col("start1").alias("start"), (F.col("start2") + 1).alias("end"), F.col("dir1").alias("dir"))
    if "neighbours" in stage:
        pick = lambda c, i: F.max(F.when(F.col("end") == i, F.col(c)))
        links = pools.remap(stage["neighbours"], members.select(F.col("cluster").alias("id"), F.col("sv").alias("merged_id")), "next_cluster")
        beside = links.groupBy(F.col("cluster").alias("id")).agg(*[pick(c, i).cast("long").alias(f"{n}{i}") for i in (1, 2) for c, n in (("next_cluster", "next"), ("next_end", "side"))])
        inverted = inverted.join(beside, "id", "left")
    carried = calls.filter("carried").select(F.col("sv").alias("id"), "sample", "gt")
    inversions = settle(matching.genotype_conflicts(settle(matching.inversions(inverted)), carried))
    out = {"calls": calls.select("sv", "sample", "ref", "alt", "overlap", "gt", "gq", "pl0", "pl1", "pl2", "phase_set", "is_first", "haploid", "carried", "gt_excluded"), "inversions": inversions}
    if settings.report_supporting_reads:
        out["supporting_reads"] = told.filter(F.col("allele") == genotype.ALT).select(F.col("sv").alias("variant"), "sample", "qname")
    matches = None
    if not settings.disable_cnv and "cells" in stage:
        out |= joint_copy_numbers(svs, calls, stage, settings, expected)
        matches = out.get("matches")
    return out | {"records": joint_records(svs, out["inversions"], matches, settings)}


def joint_copy_numbers(svs: DataFrame, calls: DataFrame, stage: dict[str, DataFrame], settings: JointCallSettings, expected: DataFrame | None) -> dict[str, DataFrame]:
    """Segments of all samples, with changes likelier where variants end, moved onto common bins: copy_segments (with their quality and, for
    the highest state, the copies by depth), cnvs, matches."""
    size = int(stage["settings"].filter("name = 'bin_size'").first()["value"])
    spans = svs.filter("chrom1 = chrom2 and kind in ('DEL', 'DUP') and start2 > start1").select("sv", "kind", "over_depth", "qual", "replicated", F.col("chrom1").alias("chrom"), F.col("start1").alias("start"), F.col("start2").alias("end"))
    carried = spans.join(calls.filter("gt > 0").select("sv", "sample"), "sv")
    own = carried.select(F.struct("sv", "sample", "kind", "chrom", "start", "end").alias("sv"), _coded("sample", "chrom").alias("chrom"), "start", "end")
    usual = stage["cells"].groupBy("sample", "chrom", "bin").agg(F.max("expected").alias("expected"))
    named = stage["segments"].join(usual.withColumnRenamed("bin", "begin"), ["sample", "chrom", "begin"])
    parts = named.select(F.xxhash64("sample", "chrom", "begin").alias("segment"), _coded("sample", "chrom").alias("chrom"), (F.col("begin") * size).alias("start"), (F.col("end") * size).alias("end"), F.col("state").alias("copies"), "expected")
    known = settle(parts.filter(F.col("copies") != hmm.UNKNOWN))
    boosted = matching.power_boost(own, known.select("segment", "chrom", "start", "end")).select("sv").unionByName(matching.close_fit(own, known).select("sv")).distinct().select("sv.*")
    edge = lambda pos, first: F.struct(F.col(pos).alias("pos"), F.when((F.col("kind") == "DEL") == F.lit(first), hmm.LOSS).otherwise(hmm.GAIN).alias("kind"))
    breakends = boosted.select("sample", "chrom", F.explode(F.array(edge("start", True), edge("end", False))).alias("e")).select("sample", "chrom", "e.pos", "e.kind")
    kinds = hmm.breakend_kinds(breakends, size)
    cells = settle(stage["cells"].drop("kind").join(kinds, ["sample", "chrom", "bin"], "left").withColumn("kind", F.coalesce("kind", F.lit(hmm.SAME))))
    segs = settle(hmm.joint_segments(cells, stage["haploid"], settings.boundary_shift // size))
    quality = hmm.copy_quality(hmm.state_likelihoods(segs, cells, stage["haploid"]), settings.max_qscore)
    high = hmm.high_copies(segs, cells, stage["haploid"]).select("sample", "chrom", "begin", "high_copies")
    table = segs.join(quality.select("sample", "chrom", "begin", "cnq"), ["sample", "chrom", "begin"]).join(high, ["sample", "chrom", "begin"], "left").join(usual.withColumnRenamed("bin", "begin"), ["sample", "chrom", "begin"], "left")
    table = settle(table.select("sample", "chrom", (F.col("begin") * size).alias("start"), (F.col("end") * size).alias("end"), F.col("state").alias("copies"), F.coalesce("expected", F.lit(2)).alias("expected"), "cnq", "high_copies"))
    cnv = table.filter((F.col("copies") != F.col("expected")) & (F.col("copies") != hmm.UNKNOWN))
    cnvs = settle(records.merge_equal_segments(cnv).withColumn("cnv", F.xxhash64("chrom", "start", "end")))
    out = {"copy_segments": table, "cnvs": cnvs}
    if settings.merge_sv_cnv:
        good = spans.filter(matching.eligible(F.col("kind"), F.col("end") - F.col("start"), F.col("over_depth"), F.col("qual"), F.col("replicated"), settings.min_qual))
        states = cnv.select(F.xxhash64("chrom", "start", "end").alias("cnv"), "sample", "copies", "expected")
        out["matches"] = settle(matching.sv_cnv_match(good, cnvs, calls.select("sv", "sample", "gt"), states))
        out["cnvs"] = cnvs.join(out["matches"].select("cnv").distinct(), "cnv", "left_anti")
    return out


def joint_records(svs: DataFrame, inversions: DataFrame, matches: DataFrame | None, settings: JointCallSettings) -> DataFrame:
    """One row per variant and one per inversion, with type, quality, filters and the inversion (event) that a breakpoint is part of."""
    in_inversion = inversions.select(F.explode(F.array("id1", "id2")).alias("sv"), F.concat_ws(":", F.lit("INV"), "id1", "id2").alias("event"))
    rows = svs.join(in_inversion, "sv", "left")
    if matches is not None:
        spans = svs.filter("chrom1 = chrom2").select("sv", "kind", F.col("start1").alias("start"), F.col("start2").alias("end"))
        forced = matching.to_breakend_pairs(spans, matches).select("sv", "forced_bnd")
        claimed = matches.select("sv").distinct().withColumn("has_cnv", F.lit(True))
        rows = rows.join(forced, "sv", "left").join(claimed, "sv", "left")
    else:
        rows = rows.withColumn("forced_bnd", F.lit(False)).withColumn("has_cnv", F.lit(None).cast("boolean"))
    kind = variants.record_type(F.col("kind"), F.col("start2") - F.col("start1"), F.lit(False), F.coalesce("forced_bnd", F.lit(False)))
    tags = variants.filters(F.col("over_depth"), F.col("qual"), F.col("event").isNotNull(), F.lit(False), settings.min_qual)
    claim = F.when(F.coalesce("has_cnv", F.lit(False)), "DJ").otherwise("J")
    one = rows.filter("not replicated").select(F.col("sv").cast("string").alias("id"), F.col("chrom1").alias("chrom"), F.col("start1").alias("pos"), F.col("chrom2").alias("mate_chrom"), F.col("start2").alias("end"), "dir1", "dir2", kind.alias("kind"), "qual", F.lit(False).alias("is_inversion"), tags.alias("filter"), "event", claim.alias("claim"))
    two = inversions.join(svs.select(F.col("sv").alias("id1"), "qual"), "id1").select(
        F.concat_ws(":", F.lit("INV"), "id1", "id2").alias("id"), "chrom", F.col("start").alias("pos"), F.col("chrom").alias("mate_chrom"), (F.col("end") - 1).alias("end"), F.lit(None).cast("long").alias("dir1"), F.lit(None).cast("long").alias("dir2"),
        F.lit("INV").alias("kind"), "qual", F.lit(True).alias("is_inversion"), variants.filters(F.lit(False), F.col("qual"), F.lit(False), F.col("conflicting"), settings.min_qual).alias("filter"), F.concat_ws(":", F.lit("INV"), "id1", "id2").alias("event"), F.lit("J").alias("claim"),
    )
    found = one.unionByName(two)
    return records.dedup(found, ["chrom", "pos", "mate_chrom", "end", "kind", "dir1", "dir2"]) if settings.dedup else found


def run_discover(reads: DataFrame, folder: str, settings: DiscoverSettings = DiscoverSettings(), **inputs: DataFrame | None) -> None:
    """``discover`` into a stage folder; run statistics and the marker come last."""
    sinks.check_folder(reads.sparkSession, folder, settings.overwrite)
    found = discover(reads, settings=settings, **inputs)
    sinks.write_stage(found, folder, settings.overwrite)
    sinks.write_run_stats(reads.sparkSession, folder, asdict(settings), found)


def run_joint_call(reads: DataFrame, folders: str, output: str, contigs: DataFrame, settings: JointCallSettings = JointCallSettings(), expected: DataFrame | None = None, reference: DataFrame | None = None) -> None:
    """``joint_call`` of a finished stage into Parquet tables, VCF text and, if asked for, supporting reads as JSON lines.

    contigs (chrom, name, length) name the chromosomes, one row each.
    """
    spark = reads.sparkSession
    sinks.check_folder(spark, output, settings.overwrite)
    stage = {name: sinks.read_stage(spark, folders, name) for name in sinks.stage_tables(spark, folders)}
    found = joint_call(reads, stage, settings, expected, reference)
    sinks.write_stage(found, output, settings.overwrite)
    tables = {name: sinks.read_stage(spark, output, name) for name in found}
    mode = "overwrite" if settings.overwrite else "errorifexists"
    sinks.joint_vcf(tables, contigs, settings.min_qual, reference).write.mode(mode).option("compression", "gzip").text(f"{output}/vcf")
    if settings.report_supporting_reads:
        sinks.supporting_reads(tables["supporting_reads"]).write.mode(mode).option("compression", "gzip").text(f"{output}/supporting_reads_json")
    sinks.write_run_stats(spark, output, asdict(settings), tables)
