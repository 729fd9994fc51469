"""Groups of variants that are scored together, over all samples: who carries which haplotype, which variants lie on it, and whether that adds up.

A group is rows of five tables: regions (group), one or two rows; haplotypes (group, haplotype, alignments); variants (group, sv, haplotype);
lists (group, sample, place, haplotype), the haplotypes of a sample in order; copies (group, sample, copies). Maps are rows, one a haplotype and
sample, so that no group is ever held whole; only what one sample carries, two haplotypes at most, is an array.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import genotype

#: What can be wrong with a group, by name.
RULES = ("no region", "alignments of a haplotype", "copies of a sample", "unknown haplotype of a sample", "repeated haplotype of a sample", "more haplotypes than ploidy", "unknown haplotype of a variant", "variants of a group of two regions")


def over_samples(lists: DataFrame, copies: DataFrame, treat_single_copy_as_haploid: bool = False) -> DataFrame:
    """The lists as long as each sample's ploidy allows: first by place, the lower haplotype on a tie. copies may name a place several
    times, once for each region; the highest number counts, and a sample without one has two copies."""
    most = copies.groupBy("group", "sample").agg(F.max("copies").alias("_copies"))
    ploidy = genotype.ploidy(F.coalesce("_copies", F.lit(2)), treat_single_copy_as_haploid)
    order = Window.partitionBy("group", "sample").orderBy("place", "haplotype")
    numbered = lists.withColumn("_n", F.row_number().over(order)).join(most, ["group", "sample"], "left")
    return numbered.filter(F.col("_n") <= ploidy).drop("_n", "_copies")


def haplotype_samples(lists: DataFrame) -> DataFrame:
    """Who carries each haplotype: (group, haplotype, sample)."""
    return lists.select("group", "haplotype", "sample").distinct()


def sample_variants(lists: DataFrame, variants: DataFrame, samples: DataFrame) -> DataFrame:
    """For every group that has a variant and every sample (sample; few): haplotypes, in order, and variants, those on them by haplotype, then by
    number; empty arrays where it carries none."""
    each = lists.join(variants, ["group", "haplotype"], "left").groupBy("group", "sample", "place", "haplotype").agg(F.sort_array(F.collect_list("sv")).alias("_svs"))
    held = each.groupBy("group", "sample").agg(F.sort_array(F.collect_list(F.struct("place", "haplotype", "_svs"))).alias("_h"))
    names = samples.agg(F.sort_array(F.collect_set("sample"))).scalar()  # one row names all samples
    wanted = variants.select("group").distinct().withColumn("sample", F.explode(names))
    none = F.array().cast("array<bigint>")
    found = wanted.join(held, ["group", "sample"], "left")
    return found.select("group", "sample", F.coalesce(F.transform("_h", lambda h: h["haplotype"]), none).alias("haplotypes"), F.coalesce(F.flatten(F.transform("_h", lambda h: h["_svs"])), none).alias("variants"))


def violations(group: Mapping[str, DataFrame], samples: DataFrame, treat_single_copy_as_haploid: bool = False) -> DataFrame:
    """What is wrong: (group, rule, n), n rows at fault. ``group`` has the five tables by name; a valid group has no rows.

    Every group that any table names is looked at. A haplotype has one alignment in a group of one region and two in others; each sample has one number
    of copies; a group of more than one region has one variant.
    """
    regions, haplotypes, variants, lists, copies = (group[n] for n in ("regions", "haplotypes", "variants", "lists", "copies"))
    every = reduce(DataFrame.union, [t.select("group") for t in (regions, haplotypes, variants, lists, copies)]).distinct()
    count = lambda t, name: t.groupBy("group").agg(F.count(F.lit(1)).alias(name))
    sized = every.join(count(regions, "_regions"), "group", "left").join(count(variants, "_svs"), "group", "left").fillna(0, ["_regions", "_svs"])
    known, size = haplotypes.select("group", "haplotype").distinct(), samples.select("sample").distinct().agg(F.count(F.lit(1))).scalar()
    aligned = haplotypes.join(sized, "group").filter(F.col("alignments") != F.when(F.col("_regions") == 1, 1).otherwise(2))
    told = copies.join(samples.select("sample").distinct(), "sample").groupBy("group").agg(F.count(F.lit(1)).alias("_rows"), F.count_distinct("sample").alias("_told"))
    unequal = every.join(told, "group", "left").fillna(0, ["_rows", "_told"]).withColumn("_all", size).filter("_rows <> _all or _told <> _all")
    repeated = lists.groupBy("group", "sample", "haplotype").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    most = copies.groupBy("group", "sample").agg(F.max("copies").alias("_copies"))
    long = lists.groupBy("group", "sample").agg(F.count(F.lit(1)).alias("_n")).join(most, ["group", "sample"], "left").filter(F.col("_n") > genotype.ploidy(F.coalesce("_copies", F.lit(2)), treat_single_copy_as_haploid))
    unknown = lambda t: t.join(known, ["group", "haplotype"], "left_anti")
    wrong = (sized.filter("_regions = 0"), aligned, unequal, unknown(lists), repeated, long, unknown(variants), sized.filter("_regions > 1 and _svs <> 1"))
    rows = reduce(DataFrame.union, [t.select("group", F.lit(rule).alias("rule")) for rule, t in zip(RULES, wrong, strict=True)])
    return rows.groupBy("group", "rule").agg(F.count(F.lit(1)).alias("n"))


def check(group: Mapping[str, DataFrame], samples: DataFrame, treat_single_copy_as_haploid: bool = False) -> None:
    """Raises, with the first group by number and what is wrong with it, if a group isn't valid."""
    first = violations(group, samples, treat_single_copy_as_haploid).orderBy("group", "rule").first()
    if first is not None:
        raise ValueError(f"group {first['group']}: {first['rule']} ({first['n']})")
