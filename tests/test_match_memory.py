"""Candidates of SVs and copy numbers: however small the tables look, their dealt rows and what samples say aren't sent whole to the driver."""

from pyspark.sql import functions as F

from strandline.operators import interval_join, matching


def tables(spark, n=60):
    sample = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("sample")
    svs = spark.range(n).selectExpr("id AS sv", "CASE WHEN id % 3 = 0 THEN 'DUP' ELSE 'DEL' END AS kind", "id % 2 AS chrom", "id * 500 AS start", "id * 500 + 20000 + id % 5 * 300 AS end")
    cnvs = spark.range(n).selectExpr("id AS cnv", "id % 2 AS chrom", "id * 500 + id % 7 * 90 AS start", "id * 500 + 20000 + id % 7 * 200 AS end")
    calls = svs.select("sv", sample).withColumn("gt", F.when((F.col("sv") + F.col("sample")) % 5 > 0, F.floor(F.col("sv") / 8) % 3))
    states = cnvs.select("cnv", sample).withColumns({"copies": F.when((F.col("cnv") + F.col("sample")) % 9 > 0, F.when((F.col("cnv") + F.col("sample")) % 4 > 0, 2 - F.floor(F.col("cnv") / 8) % 3).otherwise(3)), "expected": F.lit(2).cast("long")})
    return svs, cnvs, calls, states


def test_dealt_rows_are_not_broadcast(spark):
    svs, cnvs, _, _ = tables(spark)
    met = interval_join.reciprocal_join(svs, cnvs, 0.9, most_shift=8000)
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_samples_count_as_if_each_was_a_row(spark):
    """Fits and misfits of every pair, against joins of pairs, calls and copies."""
    svs, cnvs, calls, states = tables(spark)
    near = svs.join(cnvs.withColumnsRenamed({"start": "s", "end": "e"}), "chrom").filter("(least(end, e) - greatest(start, s)) / greatest(end - start, e - s, 100) >= 0.9")
    told = near.join(calls, "sv").join(states, ["cnv", "sample"]).withColumn("fit", matching.genotype_fits_copies(F.col("kind"), F.col("gt"), F.col("copies"), F.col("expected"))).filter("fit is not null")
    counted = {(r["sv"], r["cnv"]): (r["fits"], r["misfits"], r["shift"]) for r in told.groupBy("sv", "cnv").agg(F.count_if("fit").alias("fits"), F.count_if(~F.col("fit")).alias("misfits"), F.first(F.abs(F.col("start") - F.col("s")) + F.abs(F.col("end") - F.col("e"))).alias("shift")).collect()}
    found = matching.sv_cnv_match(svs, cnvs, calls, states).collect()
    assert found and all(counted[r["sv"], r["cnv"]] == (r["fits"], r["misfits"], r["shift"]) for r in found)
    # the rule of the losers, over all pairs
    sums = {}
    for (sv, _), (fits, misfits, shift) in counted.items():
        a = sums.setdefault(sv, [0, 0, 0])
        sums[sv] = [a[0] + fits, a[1] + fits + misfits, a[2] + fits * shift]
    left = {k: v for k, v in counted.items() if sums[k[0]][0] >= 0.5 * sums[k[0]][1]}
    lost = set()
    for _, _, cnv in sorted((c["start"], c["end"], c["cnv"]) for c in cnvs.collect()):
        own = sorted((-sums[sv][0], sums[sv][2], sv) for sv, c in left if c == cnv and sv not in lost)
        lost |= {sv for _, _, sv in own[1:]}
    assert sorted((r["sv"], r["cnv"]) for r in found) == sorted(k for k, v in left.items() if k[0] not in lost and v[0] > 0)
