"""Sinks: BED, bedGraph, tracks, VCF text, copy-number and supporting-read JSON; stage tables with a completion marker."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def write_bed(regions: DataFrame, path: str) -> None:
    """Sorted rows in tab-separated parts; parts follow each other in order."""
    regions.orderBy("chrom", "start", "end").write.csv(path, sep="\t", header=False)


def write_copy_numbers(segments: DataFrame, bin_size: int, path: str) -> None:
    """Known segments as chrom, start, end, copies: unknown ones are gaps."""
    known = segments.filter("state <> 6")
    write_bed(known.select("chrom", (F.col("begin") * bin_size).alias("start"), (F.col("end") * bin_size).alias("end"), "state"), path)


def track_runs(bins: DataFrame, value: str = "depth") -> DataFrame:
    """(sample, chrom, bin, value; nulls excluded) as runs of neighbouring bins with their values: (sample, chrom, first, values)."""
    some = bins.filter(F.col(value).isNotNull())
    order = Window.partitionBy("sample", "chrom").orderBy("bin")
    runs = some.withColumn("_run", F.col("bin") - F.row_number().over(order))
    pairs = F.sort_array(F.collect_list(F.struct("bin", value)))
    return runs.groupBy("sample", "chrom", "_run").agg(F.min("bin").alias("first"), F.transform(pairs, lambda p: p[value]).alias("values")).drop("_run")


def track_lines(bins: DataFrame, bin_size: int, value: str = "depth") -> DataFrame:
    """Each sample's runs as fixed-step track text, a row per run: (sample, chrom, first, value), the head line and then the values."""
    runs = track_runs(bins, value)
    head = F.concat(F.lit("fixedStep chrom="), F.col("chrom").cast("string"), F.lit(" start="), (F.col("first") * bin_size + 1).cast("string"), F.lit(f" step={bin_size} span={bin_size}\n"))
    return runs.select("sample", "chrom", "first", F.concat(head, F.array_join(F.transform("values", lambda v: v.cast("string")), "\n")).alias("value"))


def write_tracks(bins: DataFrame, bin_size: int, path: str, value: str = "depth") -> None:
    """A folder for each sample, its runs in order of place."""
    lines = track_lines(bins, bin_size, value)
    lines.repartitionByRange("sample", "chrom", "first").sortWithinPartitions("sample", "chrom", "first").select("sample", "value").write.partitionBy("sample").text(path)


VCF_FIELDS = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info")
#: Header lines (fixed values).
VCF_ALT = ("DEL,Deletion", "INS,Insertion", "DUP:TANDEM,Tandem duplication", "INV,Inversion", "CNV,Copy number variable region")
VCF_INFO = (
    "END,1,Integer,End position of the variant", "EVENT,A,String,ID of associated event", "EVENTTYPE,A,String,Type of associated event",
    "HOMLEN,A,Integer,Length of homology at the breakpoints", "HOMSEQ,A,String,Bases of homology at the breakpoints", "MATEID,A,String,ID of mate breakend",
    "SVCLAIM,A,String,Claim made by the call: D (abundance) or J (adjacency) or DJ", "SVLEN,A,Integer,Length of structural variant", "SVTYPE,1,String,Type of structural variant",
)
VCF_FORMAT = (
    "GT,1,String,Genotype", "GQ,1,Integer,Genotype quality", "PL,G,Integer,Phred-scaled genotype likelihoods", "AD,R,Integer,Read depth for each allele", "PS,1,Integer,Phase set", "CN,1,Float,Copy number",
    "CNQ,1,Float,Copy number quality",
)


def vcf_header(contigs: list[tuple[str, int]], least_quality: int = 10) -> list[str]:
    """The lines before the column names: contigs, alleles, filters, INFO and FORMAT keys."""
    filters = ("PASS,All filters passed", f"MinQUAL,QUAL is less than {least_quality}", "MaxScoringDepth,Depth exceeds the scoring limit in a sample", "InvBreakpoint,Part of an inversion record with the same EVENT", "ConflictingBreakpointGT,Genotypes of an event's breakpoints conflict")
    out = ["##fileformat=VCFv4.4", *[f"##contig=<ID={name},length={length}>" for name, length in contigs]]
    for kind, rows in (("ALT", VCF_ALT), ("FILTER", filters)):
        out += [f'##{kind}=<ID={key},Description="{text}">' for key, text in (r.split(",", 1) for r in rows)]
    for kind, rows in (("INFO", VCF_INFO), ("FORMAT", VCF_FORMAT)):
        out += [f'##{kind}=<ID={key},Number={n},Type={of},Description="{text}">' for key, n, of, text in (r.split(",", 3) for r in rows)]
    return out


def vcf_lines(records: DataFrame, samples: list[str], formats: dict[str, str], header: list[str] | None = None, order: str = "chrom") -> DataFrame:
    """records (VCF_FIELDS and an array column per format, one value a sample): text lines, in order of the column ``order``, then
    pos and id, behind the header and the line of column names."""
    head = [*(header or ["##fileformat=VCFv4.4"]), "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])]
    zipped = F.arrays_zip(*[F.col(c).alias(f"f{i}") for i, c in enumerate(formats.values())])
    fields = F.transform(zipped, lambda s: F.concat_ws(":", *[F.coalesce(s[f"f{i}"].cast("string"), F.lit(".")) for i in range(len(formats))]))
    fixed = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in VCF_FIELDS]
    body = records.select(F.col(order).alias("_order"), "pos", "id", F.concat_ws("\t", *fixed, F.lit(":".join(formats)), F.array_join(fields, "\t")).alias("value"))
    spark = records.sparkSession
    kind = dict(body.dtypes)["_order"]
    lines = spark.createDataFrame([(i, h) for i, h in enumerate(head)], "n int, value string")
    top = lines.select(F.lit(0).alias("_part"), F.lit(None).cast(kind).alias("_order"), F.col("n").cast("long").alias("pos"), F.lit("").alias("id"), "value")
    return top.unionByName(body.select(F.lit(1).alias("_part"), "_order", F.col("pos").cast("long").alias("pos"), "id", "value")).orderBy("_part", "_order", "pos", "id").select("value")


def _with_base(rows: DataFrame, reference: DataFrame | None, number: Column, pos: Column) -> DataFrame:
    """Adds base: the reference's at ``pos`` (from 1), N where it isn't known."""
    if reference is None:
        return rows.withColumn("base", F.lit("N"))
    from .text import sequence_of

    placed = rows.withColumn("_place", F.struct(number.alias("chrom"), pos.alias("pos")))
    spans = placed.select(F.col("_place").alias("id"), "_place.chrom", (F.col("_place.pos") - 1).alias("start"), F.col("_place.pos").alias("end")).filter("start >= 0").distinct()
    found = sequence_of(reference, spans).select(F.col("id").alias("_place"), F.col("seq").alias("base"))
    return placed.join(found, "_place", "left").withColumn("base", F.when(F.length("base") == 1, F.col("base")).otherwise("N")).drop("_place")


def _with_homology(rows: DataFrame, reference: DataFrame | None) -> DataFrame:
    """Adds homology: of deletions with a reference, the bases by which the place can move to the right; null for others."""
    if reference is None:
        return rows.withColumn("homology", F.lit(None).cast("string"))
    from ..operators.shifts import indel_shifts
    from .text import sequence_of

    gone = rows.filter("kind = 'DEL' and chrom = mate_chrom and pos < end").select("id", "chrom", (F.col("pos") + 1).alias("start"), (F.col("end") + 1).alias("end"), F.lit("").alias("inserted"))
    moved = gone.join(indel_shifts(gone, reference).filter("right > 0"), "id")
    seqs = sequence_of(reference, moved.select("id", "chrom", "start", (F.col("start") + F.col("right")).alias("end"))).withColumnRenamed("seq", "homology")
    return rows.join(seqs, "id", "left")


def joint_vcf(tables: dict[str, DataFrame], contigs: DataFrame, least_quality: int = 10, reference: DataFrame | None = None) -> DataFrame:
    """The lines of a joint call's records, calls and copy-number variants. contigs (chrom, name, length), one row each.

    A breakend pair is two lines that name each other. With reference chunks (chrom, start, seq), REF is the base there, deletions have
    their homology to the right; else REF is N. The columns are the samples in order.
    """
    from ..functions import variants

    names = [(r["name"], r["length"]) for r in contigs.orderBy("chrom").collect()]
    calls = tables["calls"]
    samples = [r["sample"] for r in calls.select("sample").distinct().orderBy("sample").collect()]  # the header's columns
    gt = variants.genotype_text(F.col("gt"), F.col("haploid"), F.col("phase_set"), F.col("is_first"))
    entry = F.struct("sample", gt.alias("gt"), "gq", F.concat_ws(",", "pl0", "pl1", "pl2").alias("pl"), F.concat_ws(",", F.col("ref") + F.col("overlap"), "alt").alias("ad"), F.col("phase_set").alias("ps"))
    listed = F.sort_array(F.collect_list(entry))
    formats = ("gt", "gq", "pl", "ad", "ps")
    by_sv = calls.groupBy(F.col("sv").cast("string").alias("call")).agg(*[_field(listed, c).alias(c) for c in formats])
    rows = tables["records"].withColumn("call", F.when(F.col("is_inversion"), F.element_at(F.split("id", ":"), 2)).otherwise(F.col("id"))).join(by_sv, "call")
    place = contigs.select(F.col("chrom"), F.col("name"))
    rows = _with_homology(rows, reference).join(place, "chrom").join(place.select(F.col("chrom").alias("mate_chrom"), F.col("name").alias("mate_name")), "mate_chrom")
    pair = F.col("kind") == "BND"
    sides = F.when(pair, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    each = rows.withColumn("side", F.explode(sides))
    first = F.col("side") == 0
    here, there = F.when(first, F.col("dir1")).otherwise(F.col("dir2")), F.when(first, F.col("dir2")).otherwise(F.col("dir1"))
    number = F.when(first, F.col("chrom")).otherwise(F.col("mate_chrom"))
    pos = F.when(first, F.col("pos")).otherwise(F.col("end")) + 1 + F.when(pair & (here == variants.RIGHT), 1).otherwise(0)
    each = _with_base(each, reference, number, pos)
    mate_pos = F.when(first, F.col("end")).otherwise(F.col("pos")) + 1 + F.when(there == variants.RIGHT, 1).otherwise(0)
    symbol = F.concat(F.lit("<"), F.when(F.col("kind") == "DUP", "DUP:TANDEM").otherwise(F.col("kind")), F.lit(">"))
    alt = F.when(pair, variants.bnd_alt(here, there, F.col("base"), F.lit(""), F.when(first, F.col("mate_name")).otherwise(F.col("name")), mate_pos)).otherwise(symbol)
    ident = F.when(pair, F.concat_ws(":", "id", F.col("side"))).otherwise(F.col("id"))
    info = F.concat_ws(
        ";", F.concat(F.lit("SVTYPE="), "kind"), F.when(~pair, F.concat(F.lit("END="), (F.col("end") + 1).cast("string"))), F.when(~pair, F.concat(F.lit("SVLEN="), (F.col("end") - F.col("pos")).cast("string"))),
        F.when(pair, F.concat(F.lit("MATEID="), F.concat_ws(":", "id", F.lit(1) - F.col("side")))), F.when(F.col("event").isNotNull(), F.concat(F.lit("EVENT="), F.col("event"), F.lit(";EVENTTYPE=INV"))), F.concat(F.lit("SVCLAIM="), "claim"),
        F.concat(F.lit("HOMLEN="), F.length("homology").cast("string"), F.lit(";HOMSEQ="), F.col("homology")),
    )
    lines = each.select(number.alias("_number"), F.when(first, F.col("name")).otherwise(F.col("mate_name")).alias("chrom"), pos.alias("pos"), ident.alias("id"), F.col("base").alias("ref"), alt.alias("alt"), F.round("qual").cast("long").alias("qual"), "filter", info.alias("info"), *formats, F.array_repeat(F.lit(None).cast("string"), len(samples)).alias("cn"), F.array_repeat(F.lit(None).cast("string"), len(samples)).alias("cnq"))
    if "cnvs" in tables:
        lines = lines.unionByName(_cnv_lines(tables, place, samples, reference))
    return vcf_lines(lines, [str(s) for s in samples], {f.upper(): f for f in (*formats, "cn", "cnq")}, vcf_header(names, least_quality), order="_number")


def _field(entries: Column, name: str) -> Column:
    return F.transform(entries, lambda s: s[name].cast("string"))


def _cnv_lines(tables: dict[str, DataFrame], place: DataFrame, samples: list, reference: DataFrame | None = None) -> DataFrame:
    """Copy-number variants: a sample without the segment has no values."""
    from ..functions import variants

    own = tables["copy_segments"].join(tables["cnvs"].select("chrom", "start", "end", "cnv"), ["chrom", "start", "end"])
    entries = own.groupBy("cnv").agg(F.map_from_entries(F.collect_list(F.struct("sample", F.struct("copies", "expected", "cnq", "high_copies").alias("v")))).alias("m"))
    names = F.array(*[F.lit(s) for s in samples])
    at = lambda f: F.transform(names, lambda s: f(F.try_element_at("m", s)))
    rows = _with_base(tables["cnvs"].join(entries, "cnv").join(place, "chrom"), reference, F.col("chrom"), F.col("start") + 1)
    none = F.transform(names, lambda s: F.lit(None).cast("string"))
    kind = F.concat(F.lit("<"), F.when(F.col("type") == "DUP", "DUP:TANDEM").otherwise(F.col("type")), F.lit(">"))
    quality = F.array_max(at(lambda v: v["cnq"]))
    return rows.select(
        F.col("chrom").alias("_number"), F.col("name").alias("chrom"), (F.col("start") + 1).alias("pos"), F.concat_ws(":", F.lit("CNV"), "cnv").alias("id"), F.col("base").alias("ref"), kind.alias("alt"), quality.cast("long").alias("qual"), F.lit("PASS").alias("filter"),
        F.concat(F.lit("SVTYPE=CNV;END="), F.col("end").cast("string"), F.lit(";SVLEN="), (F.col("end") - F.col("start")).cast("string"), F.lit(";SVCLAIM=D")).alias("info"),
        at(lambda v: variants.cnv_genotype(v["copies"], v["expected"] == 1)).alias("gt"), none.alias("gq"), none.alias("pl"), none.alias("ad"), none.alias("ps"), at(lambda v: F.coalesce(F.round(v["high_copies"], 1).cast("string"), v["copies"].cast("string"))).alias("cn"), at(lambda v: v["cnq"].cast("string")).alias("cnq"),
    )


def copy_number_summary(bases: DataFrame) -> DataFrame:
    """(sample, chrom, state, bases, is_mode): one JSON line a sample, chromosomes in order."""
    entries = F.sort_array(F.collect_list(F.struct(F.col("state").cast("string").alias("k"), F.col("bases").alias("v"))))
    by_chrom = bases.groupBy("sample", "chrom").agg(F.max(F.when(F.col("is_mode"), F.col("state"))).alias("most_common"), entries.alias("bases"))
    chroms = F.sort_array(F.collect_list(F.struct("chrom", "most_common", "bases")))
    named = F.transform(chroms, lambda c: F.struct(c["chrom"].alias("chrom"), c["most_common"].alias("most_common"), F.map_from_entries(c["bases"]).alias("bases")))
    return by_chrom.groupBy("sample").agg(named.alias("chroms")).select(F.to_json(F.struct("sample", "chroms")).alias("value"))


def supporting_reads(support: DataFrame) -> DataFrame:
    """(variant, sample, qname): one JSON line a variant: its samples' read names, sorted."""
    by_sample = support.groupBy("variant", "sample").agg(F.sort_array(F.collect_set("qname")).alias("reads"))
    rows = by_sample.groupBy("variant").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("sample", "reads")))).alias("samples"))
    return rows.select(F.to_json(F.struct("variant", "samples")).alias("value"))


def write_stage(tables: dict[str, DataFrame], folder: str, overwrite: bool = False) -> None:
    """Writes each table as Parquet, then the marker that says all are there."""
    for name, df in tables.items():
        df.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{folder}/{name}")
    # the marker comes last
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(n,) for n in tables], "stage_table string").coalesce(1).write.mode("overwrite").json(f"{folder}/complete")


def check_folder(spark: SparkSession, folder: str, overwrite: bool) -> None:
    """Raises, before any work, if the folder has a finished stage that may not be overwritten."""
    try:
        done = stage_tables(spark, folder)
    except AnalysisException:  # no marker
        return
    if done and not overwrite:
        raise ValueError(f"{folder} has a finished stage: {', '.join(done)}")


def stage_tables(spark: SparkSession, folder: str) -> list[str]:
    """The tables of a finished stage; without the marker, reading fails."""
    return sorted(r["stage_table"] for r in spark.read.json(f"{folder}/complete").collect())


def read_stage(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a finished stage; without the marker, reading fails."""
    if name not in stage_tables(spark, folder):
        raise ValueError(f"{name} is not a finished table of {folder}")
    return spark.read.parquet(f"{folder}/{name}")


def write_run_stats(spark: SparkSession, folder: str, settings: dict, tables: dict[str, DataFrame]) -> None:
    """The settings and the number of rows of each table, as one JSON line below ``run_stats``."""
    counts = {name: read_stage(spark, folder, name).count() for name in tables}
    line = json.dumps({"settings": settings, "rows": counts}, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/run_stats")
