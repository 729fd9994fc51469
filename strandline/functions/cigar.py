"""Column expressions over alignments as run-length strings (12=1X3D...), parsed once to arrays of (op, len)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_RUN = r"(\d+)([MIDNSHPX=])"
REF_OPS, READ_OPS, MATCH_OPS, CLIP_OPS = ("M", "D", "N", "=", "X"), ("M", "I", "S", "=", "X"), ("M", "=", "X"), ("S", "H")


def parse(text: Column) -> Column:
    """array<struct<op, len>>."""
    each = F.regexp_extract_all(text, F.lit(_RUN), F.lit(0))
    return F.transform(each, lambda x: F.struct(F.substring(x, -1, 1).alias("op"), F.substring(x, F.lit(1), F.length(x) - 1).cast("long").alias("len")))


def render(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: F.concat(r["len"].cast("string"), r["op"])), "")


def _total(runs: Column, ops: tuple[str, ...]) -> Column:
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + F.when(r["op"].isin(*ops), r["len"]).otherwise(0))


def ref_length(runs: Column) -> Column:
    return _total(runs, REF_OPS)


def read_length(runs: Column) -> Column:
    return _total(runs, READ_OPS)


def clipped_read_length(runs: Column) -> Column:
    """Hard clips included."""
    return _total(runs, (*READ_OPS, "H"))


def leading_clip(runs: Column) -> Column:
    """The length of all clips before the first other run."""
    first = F.coalesce(F.array_position(F.transform(runs, lambda r: ~r["op"].isin(*CLIP_OPS)), True), F.lit(0)) - 1
    return F.when(first < 0, _total(runs, CLIP_OPS)).otherwise(F.aggregate(F.slice(runs, F.lit(1), first.cast("int")), F.lit(0).cast("long"), lambda n, r: n + r["len"]))


def trailing_clip(runs: Column) -> Column:
    return leading_clip(F.reverse(runs))


def is_hard_clipped(runs: Column) -> Column:
    return F.exists(runs, lambda r: r["op"] == "H")


def has_matches(runs: Column) -> Column:
    return F.exists(runs, lambda r: r["op"].isin(*MATCH_OPS))


def edit_distance(runs: Column) -> Column:
    """Mismatches and inserted and deleted bases."""
    return _total(runs, ("X", "I", "D"))


def gap_identity(runs: Column) -> Column:
    """Matches over matches and mismatch events, a gap of any length being one event. Null without either."""
    matches = _total(runs, ("=",))
    events = F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + F.when(r["op"] == "X", r["len"]).when(r["op"].isin("I", "D"), 1).otherwise(0))
    return F.when(matches + events > 0, matches / (matches + events))


def text_identity(text: Column) -> Column:
    """The same from the string itself, without building runs: for filters over many reads."""
    total = lambda op: F.aggregate(F.regexp_extract_all(text, F.lit(rf"(\d+){op}"), F.lit(1)), F.lit(0).cast("long"), lambda n, x: n + x.cast("long"))
    matches = total("=")
    events = total("X") + F.regexp_count(text, F.lit("[ID]"))
    # counted once, as a value that the three uses share
    share = lambda p: F.when(p["matches"] + p["events"] > 0, p["matches"] / (p["matches"] + p["events"]))
    return F.element_at(F.transform(F.array(F.struct(matches.alias("matches"), events.alias("events"))), share), 1)


def compress(runs: Column) -> Column:
    """Neighbouring runs of one op become one; empty runs go."""
    kind = "struct<all:array<struct<op:string,len:bigint>>,op:string,len:bigint>"
    start = F.struct(F.array().alias("all"), F.lit(None).alias("op"), F.lit(0).cast("long").alias("len")).cast(kind)
    closed = lambda s: F.when(s["op"].isNull(), s["all"]).otherwise(F.concat(s["all"], F.array(F.struct(s["op"].alias("op"), s["len"].alias("len")))))

    def add(s: Column, r: Column) -> Column:
        same = s["op"].eqNullSafe(r["op"])
        return F.struct(F.when(same, s["all"]).otherwise(closed(s)).alias("all"), r["op"].alias("op"), (F.when(same, s["len"]).otherwise(0) + r["len"]).alias("len"))

    return F.aggregate(F.filter(runs, lambda r: r["len"] > 0), start, add, closed)


def edge_insertions_to_clips(runs: Column) -> Column:
    """Insertions before the first or after the last matched run become soft clips."""
    inside = F.transform(runs, lambda r: r["op"].isin(*MATCH_OPS, "D", "N"))
    first, last = F.array_position(inside, True), F.size(runs) + 1 - F.array_position(F.reverse(inside), True)
    return F.transform(runs, lambda r, i: F.struct(F.when((r["op"] == "I") & ((i + 1 < first) | (i + 1 > last)), "S").otherwise(r["op"]).alias("op"), r["len"].alias("len")))


def placed(runs: Column, pos: Column) -> Column:
    """Each run with where it begins on both axes: array<struct<op, len, ref, read>>."""
    kind = "struct<all:array<struct<op:string,len:bigint,ref:bigint,read:bigint>>,ref:bigint,read:bigint>"
    start = F.struct(F.array().alias("all"), pos.cast("long").alias("ref"), F.lit(0).cast("long").alias("read")).cast(kind)

    def add(s: Column, r: Column) -> Column:
        row = F.struct(r["op"].alias("op"), r["len"].alias("len"), s["ref"].alias("ref"), s["read"].alias("read"))
        step = lambda ops: F.when(r["op"].isin(*ops), r["len"]).otherwise(0)
        return F.struct(F.concat(s["all"], F.array(row)).alias("all"), (s["ref"] + step(REF_OPS)).alias("ref"), (s["read"] + step(READ_OPS)).alias("read"))

    return F.aggregate(runs, start, add)["all"]


def ref_segments(runs: Column, pos: Column, least_gap: int) -> Column:
    """The reference pieces an alignment covers, split at deletions (or skips) of ``least_gap`` and more: array<struct<start, end>>."""
    kind = "struct<all:array<struct<start:bigint,end:bigint>>,start:bigint,end:bigint>"
    start = F.struct(F.array().alias("all"), pos.cast("long").alias("start"), pos.cast("long").alias("end")).cast(kind)
    piece = lambda s: F.when(s["end"] > s["start"], F.concat(s["all"], F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))).otherwise(s["all"])

    def add(s: Column, r: Column) -> Column:
        after = s["end"] + F.when(r["op"].isin(*REF_OPS), r["len"]).otherwise(0)
        long_gap = r["op"].isin("D", "N") & (r["len"] >= least_gap)
        return F.struct(F.when(long_gap, piece(s)).otherwise(s["all"]).alias("all"), F.when(long_gap, after).otherwise(s["start"]).alias("start"), after.alias("end"))

    return F.aggregate(runs, start, add, piece)


def indels(runs: Column, pos: Column, least: int) -> Column:
    """Deletions and insertions, neighbouring ones fused: array<struct<start, end, inserted>> where either reaches ``least``.

    ``start`` is the last matched reference base before it, ``end`` the first after it.
    """
    kind = "struct<all:array<struct<start:bigint,end:bigint,inserted:bigint>>,ref:bigint,del:bigint,ins:bigint,seen:boolean>"
    zero = F.lit(0).cast("long")
    start = F.struct(F.array().alias("all"), pos.cast("long").alias("ref"), zero.alias("del"), zero.alias("ins"), F.lit(False).alias("seen")).cast(kind)

    def add(s: Column, r: Column) -> Column:
        is_gap, is_match = r["op"].isin("I", "D"), r["op"].isin(*MATCH_OPS)
        row = F.struct((s["ref"] - s["del"] - 1).alias("start"), s["ref"].alias("end"), s["ins"].alias("inserted"))
        big = s["seen"] & is_match & (F.greatest(s["del"], s["ins"]) >= least)
        return F.struct(
            F.when(big, F.concat(s["all"], F.array(row))).otherwise(s["all"]).alias("all"),
            (s["ref"] + F.when(r["op"].isin(*REF_OPS), r["len"]).otherwise(0)).alias("ref"),
            F.when(is_gap, s["del"] + F.when(r["op"] == "D", r["len"]).otherwise(0)).otherwise(0).alias("del"),
            F.when(is_gap, s["ins"] + F.when(r["op"] == "I", r["len"]).otherwise(0)).otherwise(0).alias("ins"),
            (s["seen"] | is_match).alias("seen"),
        )

    return F.aggregate(runs, start, add)["all"]


def closest_read_position(runs: Column, pos: Column, target: Column, at_most: bool = True) -> Column:
    """The read position of the last aligned base at or before ``target`` (or the first at or after it); null if there is none."""
    start = F.struct(pos.cast("long").alias("ref"), F.lit(0).cast("long").alias("read"), F.lit(None).cast("long").alias("hit"))

    def add(s: Column, r: Column) -> Column:
        match = r["op"].isin(*MATCH_OPS)
        if at_most:  # later runs win
            fits, hit = s["ref"] <= target, s["read"] + F.least(target - s["ref"], r["len"] - 1)
        else:
            fits, hit = s["hit"].isNull() & (s["ref"] + r["len"] > target), s["read"] + F.greatest(target - s["ref"], F.lit(0))
        step = lambda ops: F.when(match | r["op"].isin(*[o for o in ops if o not in MATCH_OPS]), r["len"]).otherwise(0)
        return F.struct((s["ref"] + step(REF_OPS)).alias("ref"), (s["read"] + step(READ_OPS)).alias("read"), F.when(match & fits, hit.cast("long")).otherwise(s["hit"]).alias("hit"))

    return F.aggregate(runs, start, add)["hit"]


def sam_bin(start: Column, end: Column) -> Column:
    """The smallest bin of the six-level binning scheme that holds [start, end)."""
    last = end - 1
    out = F.lit(0)
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = F.when(F.shiftright(start, shift) == F.shiftright(last, shift), F.lit(first) + F.shiftright(start, shift)).otherwise(out)
    return out


def sequencing_position(pos: Column, length: Column, reverse: Column) -> Column:
    """A read position in the order of sequencing."""
    return F.when(reverse, length - 1 - pos).otherwise(pos)


def clip_read_edges(runs: Column, left: Column, right: Column) -> Column:
    """The alignment without the read's first ``left`` and last ``right`` bases, as soft clips; runs of no read base at an edge go."""
    total = read_length(runs)
    low, high = left, total - right

    def part(r: Column) -> Column:
        taken = F.greatest(F.least(r["read"] + r["len"], high) - F.greatest(r["read"], low), F.lit(0).cast("long"))
        inside = (r["read"] > low) & (r["read"] < high)
        return F.struct(r["op"].alias("op"), F.when(r["op"].isin(*READ_OPS), taken).when(inside, r["len"]).otherwise(0).cast("long").alias("len"))

    kept = F.filter(F.transform(placed(runs, F.lit(0)), part), lambda r: (r["len"] > 0) & ~r["op"].isin("S", "H"))
    s = lambda n: F.array(F.struct(F.lit("S").alias("op"), n.cast("long").alias("len")))
    first, last = leading_soft(runs), trailing_soft(runs)
    return compress(F.concat(s(F.greatest(left, first)), kept, s(F.greatest(right, last))))


def _clip_ref_start(runs: Column, least: Column, finish) -> Column:
    """One pass over the runs; ``finish`` gets the runs that are left (all), and the bases of reference that are lost."""
    kind = "array<struct<op:string,len:bigint>>"
    zero = F.lit(0).cast("long")
    run = lambda op, n: F.struct(op.alias("op"), n.cast("long").alias("len"))
    start = F.struct(F.array().cast(kind).alias("all"), zero.alias("ref"), zero.alias("lost"))

    def add(s: Column, r: Column) -> Column:
        gap, match = r["op"].isin("D", "N"), r["op"].isin(*MATCH_OPS)
        cut = F.least(r["len"], F.greatest(least - s["ref"], F.lit(0)))
        split = F.array(run(F.lit("S"), cut), run(r["op"], r["len"] - cut))
        turned = F.array(run(F.lit("S"), r["len"]))
        gone = gap & (s["ref"] <= least)
        # what lies behind the cut stays as it is
        some = F.when(gone, F.array().cast(kind)).when((r["op"] == "I") & (s["ref"] < least), turned).when(match & (s["ref"] < least), split).otherwise(F.array(run(r["op"], r["len"])))
        lost = F.when(gone, r["len"]).when(match, cut).otherwise(0)
        return F.struct(F.concat(s["all"], some).cast(kind).alias("all"), (s["ref"] + F.when(match | gap, r["len"]).otherwise(0)).alias("ref"), (s["lost"] + lost).cast("long").alias("lost"))

    return F.aggregate(runs, start, add, finish)


def clipped_ref_edges(runs: Column, left: Column, right: Column) -> Column:
    """struct<kept, moved>: the alignment without its first ``left`` and last ``right`` bases of reference at least, and by how many bases its start moves.

    Matched bases and insertions that lie in what is cut become soft clips; deletions there, and one that would be an edge, go.
    """
    turned = _clip_ref_start(F.reverse(runs), right, lambda s: s["all"])
    return _clip_ref_start(F.reverse(turned), left, lambda s: F.struct(compress(s["all"]).alias("kept"), s["lost"].alias("moved")))


def clip_ref_edges(runs: Column, left: Column, right: Column) -> tuple[Column, Column]:
    """The two fields of ``clipped_ref_edges``; as a column of its own that one is found once for both."""
    both = clipped_ref_edges(runs, left, right)
    return both["kept"], both["moved"]


def leading_soft(runs: Column) -> Column:
    return F.coalesce(F.when(F.try_element_at(runs, F.lit(1))["op"] == "S", F.try_element_at(runs, F.lit(1))["len"]), F.lit(0).cast("long"))


def trailing_soft(runs: Column) -> Column:
    return leading_soft(F.reverse(runs))


def homology(seq: Column, at: Column, length: Column) -> Column:
    """How many bases after a gap of ``length`` at ``at`` (from 0) of ``seq`` repeat the gap's own first bases."""
    after, own = F.substring(seq, at + length + 1, F.length(seq)), F.substring(seq, at + 1, F.length(seq))
    same = F.zip_with(F.split(after, ""), F.split(own, ""), lambda a, b: (a == b) & (a != ""))
    return F.coalesce(F.nullif(F.array_position(F.transform(same, lambda x: F.coalesce(x, F.lit(False))), False), F.lit(0)) - 1, F.size(same)).cast("long")


def hard_clipped_read_range(runs: Column, pos: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """Where a range of the reference lies on a read as stored, without its hard clips: from the first read base at or after the start
    to behind the last one before the end; nulls if none is there."""
    first, last = closest_read_position(runs, pos, start, False), closest_read_position(runs, pos, end - 1)
    there = first.isNotNull() & last.isNotNull() & (first <= last)
    return F.when(there, first), F.when(there, last + 1)
