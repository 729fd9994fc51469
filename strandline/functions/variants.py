"""Column expressions for breakpoints and variant records: types, sizes, labels, breakend strings, genotype text, filters.

A breakpoint has two ends (chrom, start, end, dir; dir 0 extends left of the break, 1 right), an inserted length and flags.
Positions are the base before the break.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEFT, RIGHT = 0, 1
SYMBOLIC_DELETION, CANDIDATE_DELETION, CONVERT_SIZE, LEAST_QUALITY = 100_001, 1000, 50_000, 10


def rev_comp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def simple_bases(seq: Column) -> Column:
    """Upper case; all but ACGT becomes N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def breakpoint_distance(a1: list[Column], a2: list[Column], b1: list[Column], b2: list[Column]) -> Column:
    """Distance of two breakpoints whose ends are [chrom, start, end, dir]: the larger of both ends' gaps if these shift in
    concert, else their sum; null across chromosomes."""
    from . import intervals

    d1, d2 = intervals.distance(a1[1], a1[2], b1[1], b1[2]), intervals.distance(a2[1], a2[2], b2[1], b2[2])
    same_way = intervals.is_before(a1[1], a1[2], b1[1], b1[2]) == intervals.is_before(a2[1], a2[2], b2[1], b2[2])
    same_orientation = a1[3] == a2[3]
    return F.when((a1[0] == b1[0]) & (a2[0] == b2[0]), F.when(same_orientation != same_way, F.greatest(d1, d2)).otherwise(d1 + d2))


def needs_swap(chrom1: Column, start1: Column, end1: Column, dir1: Column, chrom2: Column, start2: Column, end2: Column, dir2: Column) -> Column:
    """Whether a breakpoint's ends must change places to be in standard order."""
    plain = lambda *c: F.struct(*[x.alias(f"c{i}") for i, x in enumerate(c)])
    one, two = plain(chrom1, start1, end1), plain(chrom2, start2, end2)
    return (one > two) | ((one == two) & (dir1 == RIGHT) & (dir2 == LEFT))


def sv_type(chrom1: Column, chrom2: Column, dir1: Column, dir2: Column, deleted: Column, inserted: Column) -> Column:
    """Single breakend, breakend pair, duplication, insertion or deletion. chrom2 is null for a single breakend."""
    return (
        F.when(chrom2.isNull(), "SBND").when((chrom1 != chrom2) | (dir1 == dir2), "BND").when(dir1 == RIGHT, "DUP").when(inserted > deleted, "INS").otherwise("DEL")
    )


def is_indel(chrom1: Column, chrom2: Column, dir1: Column, dir2: Column) -> Column:
    """Both ends on one chromosome, turned as around a deletion or insertion; false without a second end."""
    return F.coalesce((chrom1 == chrom2) & (dir1 == LEFT) & (dir2 == RIGHT), F.lit(False))


def is_indel_or_dup(chrom1: Column, chrom2: Column, dir1: Column, dir2: Column) -> Column:
    return F.coalesce((chrom1 == chrom2) & (dir1 != dir2), F.lit(False))


def same_orientation(dir1: Column, dir2: Column) -> Column:
    return F.coalesce(dir1 == dir2, F.lit(False))


def breakpoint_span(chrom1: Column, start1: Column, chrom2: Column, start2: Column) -> Column:
    """From the first to the second end; null across chromosomes and without a second end."""
    return F.when(chrom1 == chrom2, F.greatest(start2 - start1, F.lit(0)))


def deletion_size(chrom1: Column, start1: Column, dir1: Column, chrom2: Column, start2: Column, dir2: Column) -> Column:
    return F.when(is_indel(chrom1, chrom2, dir1, dir2), breakpoint_span(chrom1, start1, chrom2, start2))


def deldup_size(chrom1: Column, start1: Column, dir1: Column, chrom2: Column, start2: Column, dir2: Column) -> Column:
    return F.when(is_indel_or_dup(chrom1, chrom2, dir1, dir2), breakpoint_span(chrom1, start1, chrom2, start2))


def homology_length(start: Column, end: Column) -> Column:
    """An end's range is one base longer than its homology."""
    return end - start - 1


def is_valid_end(start: Column, end: Column, dir_: Column, length: Column) -> Column:
    """Whether an end lies on its chromosome; a right-anchored one may lie a base before it, and not on the last base."""
    before = F.when(dir_ == RIGHT, 1).otherwise(0)
    return (start < end) & (start >= -before) & (end <= length - before)


def insert_size(low: Column, high: Column, seq: Column) -> Column:
    """The middle of a size range, the length of a known sequence, or none."""
    return F.when(seq.isNotNull(), F.length(seq)).when(low.isNotNull(), F.floor((low + high) / 2)).otherwise(0).cast("long")


def record_type(kind: Column, deleted: Column, is_candidate: Column, forced_bnd: Column) -> Column:
    """The type as written: large candidate deletions and all candidate duplications go as breakend pairs."""
    large = is_candidate & (((kind == "DEL") & (deleted > CANDIDATE_DELETION)) | (kind == "DUP"))
    return F.when(forced_bnd | large, "BND").otherwise(kind)


def cnv_type(below: Column, above: Column) -> Column:
    """From the number of samples below and above the expected copies: null if none."""
    return F.when((below > 0) & (above > 0), "CNV").when(below > 0, "DEL").when(above > 0, "DUP")


def filters(over_depth: Column, quality: Column, in_inversion: Column, conflicting: Column, least_quality: int = LEAST_QUALITY) -> Column:
    """The filter tags of a record, or PASS."""
    tags = F.array_compact(F.array(F.when(over_depth, "MaxScoringDepth"), F.when(quality < least_quality, "MinQUAL"), F.when(in_inversion, "InvBreakpoint"), F.when(conflicting, "ConflictingBreakpointGT")))
    return F.when(F.size(tags) == 0, "PASS").otherwise(F.array_join(tags, ";"))


def sv_filter(is_replicate: Column, all_excluded: Column) -> Column:
    return F.when(is_replicate, "Replicated").when(all_excluded, "GTExcluded").otherwise("NoFilter")


def sv_id(tool: str, *parts: Column) -> Column:
    return F.concat_ws(":", F.lit(tool), *[p.cast("string") for p in parts])


def parts_of_id(label: Column, names: list[str]) -> list[Column]:
    parts = F.split(label, ":")
    return [F.element_at(parts, i + 2).cast("long").alias(n) for i, n in enumerate(names)]


def bnd_alt(dir1: Column, dir2: Column, base: Column, inserted: Column, mate_chrom: Column, mate_pos: Column) -> Column:
    """The breakend string of a pair's first end: its bases on the kept side, brackets towards the mate's kept side."""
    place = F.concat(mate_chrom, F.lit(":"), mate_pos.cast("string"))
    bracket = F.when(dir2 == LEFT, "]").otherwise("[")
    mate = F.concat(bracket, place, bracket)
    return F.when(dir1 == LEFT, F.concat(base, inserted, mate)).otherwise(F.concat(mate, inserted, base))


def parse_bnd_alt(alt: Column, homology: Column) -> dict[str, Column]:
    """dir1, dir2, mate_chrom, mate_pos (0-based, the base before the break), inserted. The last colon splits name and position."""
    place = F.regexp_extract(alt, r"[\[\]](.*)[\[\]]", 1)
    chrom, pos = F.regexp_extract(place, r"^(.*):(\d+)$", 1), F.regexp_extract(place, r"^(.*):(\d+)$", 2).cast("long")
    is_left = ~alt.rlike(r"^[\[\]]")
    mate_left = F.contains(alt, F.lit("]"))
    bases = F.regexp_replace(F.regexp_replace(alt, r"[\[\]].*[\[\]]", ""), r"[\[\]]", "")
    same = is_left == mate_left
    at = pos - 1 - F.when(same, homology).otherwise(0) - F.when(mate_left, 0).otherwise(1)
    inserted = F.when(is_left, F.substring(bases, F.lit(2), F.length(bases))).otherwise(F.substring(bases, F.lit(1), F.length(bases) - 1))
    return {"dir1": F.when(is_left, LEFT).otherwise(RIGHT), "dir2": F.when(mate_left, LEFT).otherwise(RIGHT), "mate_chrom": chrom, "mate_pos": at, "inserted": inserted}


def genotype_text(genotype: Column, haploid: Column, phase_set: Column | None = None, first: Column | None = None) -> Column:
    """0/0, 0/1, 1/1 (0 and 1 if haploid, . if unknown); a phased het as 1|0 or 0|1."""
    plain = F.when(genotype.isNull(), F.when(haploid, ".").otherwise("./.")).when(haploid, F.when(genotype == 2, "1").otherwise("0"))
    plain = plain.when(genotype == 0, "0/0").when(genotype == 1, "0/1").otherwise("1/1")
    return plain if phase_set is None else F.when((genotype == 1) & phase_set.isNotNull() & ~haploid, F.when(first, "1|0").otherwise("0|1")).otherwise(plain)


def cnv_genotype(copies: Column, haploid: Column) -> Column:
    """By copies: none 1/1, one 0/1, more ./1; haploid: 0 or more than one 1."""
    return F.when(copies.isNull(), F.when(haploid, ".").otherwise("./.")).when(haploid, F.when(copies == 1, "0").otherwise("1")).when(copies == 0, "1/1").when(copies == 1, "0/1").otherwise("./1")


def minor_fraction(ad0: Column, ad1: Column, least: int = 8) -> Column:
    """The rarer allele's share; null under ``least`` reads."""
    return F.when(ad0 + ad1 >= least, F.least(ad0, ad1) / (ad0 + ad1))
