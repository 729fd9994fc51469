"""Read-to-allele assignment, genotypes, phasing, ranking and sampling."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import prob
from ..session import settle
from .groups import per_group
from .interval_join import interval_semi


def genotypes(counts: DataFrame, most: int = 999) -> DataFrame:
    """counts (..., ref, alt, overlap, haploid): adds pl0..pl2, gt (null without reads), gq and p_ref, the chance of no variant.

    Reads of an overlapping allele count as reference ones. The smaller genotype wins a tie.
    """
    ref = F.col("ref") + F.col("overlap")
    logs = prob.genotype_logs(ref, F.col("alt"), F.col("haploid"))
    pls = prob.phred_likelihoods(logs, most)
    posterior = prob.normalised([a + b for a, b in zip(logs, prob.genotype_priors(F.col("haploid")))])
    out = counts.withColumns({f"pl{i}": p.cast("long") for i, p in enumerate(pls)} | {"p_ref": posterior[0], "_post": F.array(*posterior)})
    seen = ref + F.col("alt") > 0
    sorted_pl = F.sort_array(F.array("pl0", "pl1", "pl2"))
    return out.withColumn("gt", F.when(seen, prob.first_argmax([F.element_at("_post", i + 1) for i in range(3)])).cast("long")).withColumn("gq", F.when(seen, sorted_pl[1])).drop("_post")


def joint_quality(scored: DataFrame, key: str, most: int = 999) -> DataFrame:
    """The phred-scaled chance that no sample has the variant."""
    product = F.exp(F.sum(F.log(F.greatest(F.col("p_ref"), F.lit(1e-300)))))
    return scored.groupBy(key).agg(F.greatest(F.lit(0.0), F.least(F.lit(float(most)), prob.phred(product))).alias("qual"))


REF, ALT, OVERLAP = 0, 1, 2
NATIVE, GUEST, BLOCKED = 0, 1, 2


def best_alleles(scores: DataFrame) -> DataFrame:
    """scores (read, condition, allele, score; alleles REF, ALT, OVERLAP): what each read supports: (read, condition, allele, score, tie).

    Optional columns, one value a read: ``reserved``, the allele of the haplotype that an earlier variant has given the read (null:
    none), and ``alt_on_top``, whether ALT lies on the sample's first haplotype (so by default).

    Within a condition the best score wins, nulls last, then the lower allele. Equal first and second scores (two nulls are equal) are
    a tie; one of ALT and OVERLAP goes to the reserved allele or, without one, to OVERLAP if ALT isn't on top. Scores below 0 are
    null from here on. Conditions are in order: other alleles before the reference, whatever their scores, then the score, nulls
    last, then the number. If the first is a tie, the first later one without a tie takes its place if it has a score and the allele that the
    first's winner tied with. A read whose winner has no score is left out.
    """
    extra = {"reserved": F.lit(None).cast("long"), "alt_on_top": F.lit(True)}
    for name, value in extra.items():
        if name not in scores.columns:
            scores = scores.withColumn(name, value)
    of = lambda a: F.max(F.when(F.col("allele") == a, F.col("score")))
    # dealt once, by the read, for both groupings
    each = scores.repartition("read").groupBy("read", "condition").agg(of(REF).alias("r"), of(ALT).alias("a"), of(OVERLAP).alias("o"), F.bool_or(F.col("allele") == OVERLAP).alias("_o"), F.max("reserved").alias("reserved"), F.bool_and("alt_on_top").alias("alt_on_top"))
    entry = lambda allele, c: F.struct((-F.coalesce(F.col(c).cast("double"), F.lit(float("-inf")))).alias("down"), F.lit(allele).alias("allele"), F.col(c).alias("score"))
    ranked = F.sort_array(F.when(F.col("_o"), F.array(entry(REF, "r"), entry(ALT, "a"), entry(OVERLAP, "o"))).otherwise(F.array(entry(REF, "r"), entry(ALT, "a"))))
    each = each.withColumn("_s", ranked).withColumn("_1", F.col("_s")[0]).withColumn("_2", F.col("_s")[1])
    tied = F.col("_1.down") == F.col("_2.down")
    others = tied & (F.col("_1.allele") != REF) & (F.col("_2.allele") != REF)
    second = others & F.when(F.col("reserved").isNotNull(), F.col("_2.allele") == F.col("reserved")).otherwise(~F.col("alt_on_top") & (F.col("_1.allele") == ALT))
    pick = lambda field: F.when(second, F.col(f"_2.{field}")).otherwise(F.col(f"_1.{field}"))
    won = F.when(pick("score") >= 0, pick("score"))
    each = each.select("read", "condition", pick("allele").alias("allele"), won.alias("score"), F.when(tied, F.when(second, F.col("_1.allele")).otherwise(F.col("_2.allele"))).alias("with"))
    order = F.struct((F.col("allele") == REF).alias("is_ref"), (-F.coalesce(F.col("score").cast("double"), F.lit(float("-inf")))).alias("down"), "condition", "allele", "score", "with")
    listed = each.groupBy("read").agg(F.sort_array(F.collect_list(order)).alias("all"))  # four conditions at most
    first = F.col("all")[0]
    untied = F.try_element_at(F.filter(F.slice("all", 2, 1 << 30), lambda c: c["with"].isNull()), F.lit(1))
    instead = first["with"].isNotNull() & untied["score"].isNotNull() & (untied["allele"] == first["with"])
    chosen = listed.select("read", F.when(F.coalesce(instead, F.lit(False)), untied).otherwise(first).alias("c"))
    return chosen.filter("c.score is not null").select("read", "c.condition", F.col("c.allele").cast("long").alias("allele"), "c.score", F.col("c.with").isNotNull().alias("tie"))


def allele_counts(assigned: DataFrame) -> DataFrame:
    """assigned (sv, sample, allele; 0 reference, 1 variant, 2 overlapping): ref, alt, overlap."""
    count = lambda a: F.count_if(F.col("allele") == a)
    return assigned.groupBy("sv", "sample").agg(count(0).alias("ref"), count(1).alias("alt"), count(2).alias("overlap"))


def sample_sv_order(svs: DataFrame, native: DataFrame, ploidies: DataFrame) -> DataFrame:
    """In which order a sample's variants are evaluated: (group, sample, sv, relation, place).

    svs (group, sv, haplotype; sv in the group's order), native (group, sample, haplotype, rank: the sample's own haplotypes in
    order), ploidies (group, sample, ploidy). Variants of the sample's own haplotypes come first, by haplotype, then sv, as NATIVE; all
    others follow by sv, as BLOCKED if the sample has as many haplotypes as its ploidy, else as GUEST.
    """
    own = native.join(svs, ["group", "haplotype"]).groupBy("group", "sample", "sv").agg(F.min("rank").alias("rank"))
    full = native.groupBy("group", "sample").agg(F.countDistinct("rank").alias("_n"))
    every = ploidies.join(svs.select("group", "sv").distinct(), "group").join(full, ["group", "sample"], "left").join(own, ["group", "sample", "sv"], "left")
    relation = F.when(F.col("rank").isNotNull(), NATIVE).when(F.coalesce("_n", F.lit(0)) >= F.col("ploidy"), BLOCKED).otherwise(GUEST)
    order = Window.partitionBy("group", "sample").orderBy(F.col("rank").asc_nulls_last(), "sv")
    return every.select("group", "sample", "sv", relation.cast("long").alias("relation"), (F.row_number().over(order) - 1).cast("long").alias("place"))


def reserved_counts(assigned: DataFrame, passes: int = 1) -> DataFrame:
    """Allele counts in which a read supports one haplotype only: (sv, sample, ref, alt, overlap).

    assigned (group, sample, place, sv, haplotype, other, shared, qname, allele, tie, relation): reads' alleles in the order of
    ``sample_sv_order``; ``other`` is the overlapping allele's haplotype, ``shared`` says that the variant is on both of the
    sample's haplotypes. Reference reads, ties and those of shared variants always count and reserve nothing. An ALT (OVERLAP) read
    must agree with the haplotype that its qname has, or gets the variant's (the other's). OVERLAP counts as ALT where shared.
    With two passes, as for samples of several haplotypes, the second counts with all that the first reserved. A BLOCKED variant has
    as many reference reads as the sample's best native one has reads.
    """
    kinds = "group long, sample long, sv long, relation long, ref long, alt long, overlap long"

    def count(rows: Iterable[dict]) -> Iterator[tuple]:
        rows = list(rows)  # the reads at one group of variants in one sample
        held: dict[str, int] = {}
        for _ in range(passes):
            counts: dict[tuple, list[int]] = {}
            for r in rows:
                own = counts.setdefault((r["group"], r["sample"], r["sv"], r["relation"]), [0, 0, 0])
                if r["relation"] == BLOCKED or r["allele"] is None:
                    continue
                if not (r["tie"] or r["shared"] or r["allele"] == REF):
                    mine = r["haplotype"] if r["allele"] == ALT else r["other"]
                    if mine is None or held.setdefault(r["qname"], mine) != mine:
                        continue
                own[ALT if r["allele"] == OVERLAP and r["shared"] else r["allele"]] += 1
        most = max((sum(c) for k, c in counts.items() if k[3] == NATIVE), default=0)
        for key, own in counts.items():
            yield (*key, *([most, 0, 0] if key[3] == BLOCKED else own))

    typed = assigned.select(*[F.col(c).cast("long").alias(c) for c in ("group", "sample", "place", "sv", "haplotype", "other", "allele", "relation")], "shared", "tie", "qname")
    return per_group(typed, ["group", "sample"], ["place", "sv", "qname"], count, kinds).select("sv", "sample", "ref", "alt", "overlap")


def guest_haplotypes(scores: DataFrame, least: int = 2) -> DataFrame:
    """scores (group, sample, haplotype, score): the haplotype with the highest mean (to nine decimals), count, lowest index."""
    means = scores.groupBy("group", "sample", "haplotype").agg(F.floor(F.avg("score") * 1_000_000_000).cast("long").alias("mean"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    order = Window.partitionBy("group", "sample").orderBy(F.desc("mean"), F.desc("n"), "haplotype")
    return means.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def phase_sets(calls: DataFrame) -> DataFrame:
    """calls (group, sample, haplotype, start, gt): hets of a sample's group with more than one het get phase_set (their least
    start + 1) and is_first (haplotype 0)."""
    every = Window.partitionBy("group", "sample")
    het = F.col("gt") == 1
    several = F.count_if(het).over(every) > 1
    least = F.min(F.when(het, F.col("start"))).over(every) + 1
    return calls.withColumn("phase_set", F.when(het & several, least)).withColumn("is_first", F.when(het & several, F.col("haplotype") == 0))


def ploidy(copies, treat_single_as_haploid: bool = True, two_regions=None):
    """Haplotypes to expect: 1 of one copy (if told so), else 2; of two-region variants 1 at most."""
    base = F.when((copies == 1) & F.lit(treat_single_as_haploid), 1).otherwise(2)
    return base if two_regions is None else F.when(two_regions, 1).otherwise(base)


def top_supported(assemblies: DataFrame, most: int, least_reads: int = 2) -> DataFrame:
    """assemblies (cluster, assembly, reads): the ``most`` with the most reads, in order."""
    order = Window.partitionBy("cluster").orderBy(F.desc("reads"), "assembly")
    return assemblies.filter(F.col("reads") >= least_reads).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def downsample(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Keeps ``most`` rows of each key, evenly spread over its order; all of a smaller one. A sampling operator."""
    ordered, every = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys)
    numbered = rows.withColumn("_i", F.row_number().over(ordered)).withColumn("_n", F.count(F.lit(1)).over(every))
    step = lambda i: F.floor(i * most / F.col("_n"))
    return numbered.filter((F.col("_n") <= most) | (step(F.col("_i")) > step(F.col("_i") - 1))).drop("_i", "_n")


def one_per_read(reads: DataFrame, keys: tuple[str, ...] = ("qname",)) -> DataFrame:
    """Of each read's pieces, the longest; then the primary one, the first position. ``keys`` name a read."""
    order = Window.partitionBy(*keys).orderBy(F.desc("length"), F.desc("is_primary"), "pos", "seg")
    return reads.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def absorb_overlaps(calls: DataFrame, most: int = 999) -> DataFrame:
    """calls (group, sample, sv, rank, start, end, ref, alt, overlap, haploid, with their genotypes): one variant on both haplotypes rules
    out others at its place.

    ``rank`` is the place of the variant's haplotype among the sample's own (null: not its own); a column ``replicated``, if there, keeps
    replicates from ruling out others. A homozygous variant of the sample's first haplotype takes its overlap reads as its own. A variant of
    the second haplotype whose range intersects that of such a one in the same sample gives all its reads to the reference and is
    ``gt_excluded``. Genotypes are then computed anew. The ranges meet through their buckets, so a group of any size has no pairs to try.
    """
    if "replicated" not in calls.columns:
        calls = calls.withColumn("replicated", F.lit(False))
    calls = settle(calls)  # read for the ranges of both haplotypes and for the counts
    top = F.coalesce((F.col("rank") == 0) & (F.col("gt") == 2) & ~F.col("replicated"), F.lit(False))
    spans = calls.select("group", "sample", "sv", "rank", F.col("start"), F.col("end"), top.alias("_top"))
    key = ["group", "sample", "sv"]
    out = interval_semi(spans.filter("rank = 1"), spans.filter("_top"), key, ("group", "sample")).select(*key, F.lit(True).alias("gt_excluded"))
    met = calls.withColumn("_top", top).join(out, key, "left").withColumn("gt_excluded", F.coalesce("gt_excluded", F.lit(False)))
    lost = F.col("gt_excluded")
    met = met.withColumns({
        "ref": F.when(lost, F.col("ref") + F.col("alt") + F.col("overlap")).otherwise(F.col("ref")),
        "alt": F.when(lost, 0).when(F.col("_top"), F.col("alt") + F.col("overlap")).otherwise(F.col("alt")),
        "overlap": F.when(lost | F.col("_top"), 0).otherwise(F.col("overlap")),
    })
    return genotypes(met.drop("_top"), most)


def gt_excluded(calls: DataFrame) -> DataFrame:
    """calls (sv, sample, carried, gt_excluded): sv and all_excluded, whether every sample that carries it, and at least one, is excluded."""
    return calls.groupBy("sv").agg(F.coalesce(F.bool_and(F.when(F.col("carried"), F.col("gt_excluded"))), F.lit(False)).alias("all_excluded"))
