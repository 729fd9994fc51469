"""Shifts of indels by brute force: repeats longer than chunks and windows, chromosome ends, Ns; clipping by reference."""

import random

from pyspark.sql import functions as F

from strandline.functions import cigar
from strandline.operators import shifts

INDEL = "id long, chrom string, start long, end long, inserted string"


def brute(ref, s, e, new):
    if s is None or e is None or s > e:
        return None, None
    if ref[s:e] == new:
        return 0, 0
    same = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y)) if a != b or "N" in (a, b)), min(len(x), len(y)))
    return same(ref[:e][::-1], (ref[:s] + new)[::-1]), same(ref[s:], new + ref[e:])


def test_brute_force(spark):
    r = random.Random(4)
    letters = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    unit = letters(13)
    refs = {"r": letters(300) + unit * 150 + letters(300), "a": "A" * 700, "n": letters(40) + "N" * 80 + "AC" * 60, "long": letters(100) + "ACGTTGA" * 6000 + letters(100)}
    rows = [(0, "r", None, 5, ""), (1, "r", 5, 5, ""), (2, "r", 5, 5, None), (3, "r", 9, 5, "A"), (4, None, 5, 9, ""), (5, "absent", 5, 9, ""), (6, "r", 400, 426, unit), (7, "r", 400, 426, refs["r"][400:426]), (8, "long", 20_003, 20_010, ""), (9, "long", 20_003, 20_003, refs["long"][20_003:20_031])]
    for c in "ran":
        for k in range(120):
            s = r.choice((0, r.randrange(len(refs[c]) - 60), len(refs[c]) - 40))
            size = r.choice((0, 1, 2, 13, 26, 40))
            new = r.choice(("", "A", refs[c][s : s + 13], refs[c][s : s + r.randrange(200)], letters(3), unit))
            rows.append((len(rows), c, s, s + size, new))
    chunk = 50
    pieces = [(c, i, x[i : i + chunk]) for c, x in refs.items() for i in range(0, len(x), chunk)]
    chunks, indels = spark.createDataFrame(pieces, "chrom string, start long, seq string"), spark.createDataFrame(rows, INDEL)
    told = shifts.indel_shifts(indels, chunks, chunk)
    found = {x["id"]: (x["left"], x["right"]) for x in told.collect()}
    want = {i: (None, None) if c is None else brute(refs.get(c, ""), s, e, new or "") for i, c, s, e, new in rows}
    want[5] = (0, 0)
    assert found == want and max(v[0] or 0 for v in want.values()) > 15_000
    moved = {x["id"]: x for x in shifts.shifted_breaks(indels, told).collect()}
    for i, c, s, e, new in rows[6:]:
        x, ref = moved[i], refs[c]
        assert ref[: x["start"]] + x["inserted"] + ref[x["end"] :] == ref[:s] + (new or "") + ref[e:] and x["homology"] == sum(want[i])
        if s == e or not new:
            assert x["start"] == s - want[i][0]


def test_empty(spark):
    none = spark.createDataFrame([], INDEL)
    assert shifts.indel_shifts(none, spark.createDataFrame([], "chrom string, start long, seq string")).collect() == []


def test_reference_clips(spark):
    """From the rule: cut matches and insertions become soft clips, deletions within or at the edge of what is cut go."""
    cases = [("5S10=3D10=2I10=4S", 0, 0, "5S10=3D10=2I10=4S", 0), ("10=3D10=", 4, 0, "4S6=3D10=", 4), ("10=3D10=", 10, 0, "10S10=", 13), ("10=3D10=", 11, 0, "10S10=", 13), ("10=2I10=", 10, 0, "10S2I10=", 10), ("10=2I10=", 11, 5, "13S4=5S", 11), ("10=3D10=", 0, 10, "10=10S", 0), ("3H10=5N10=", 100, 0, "3H20S", 25), ("20=", 30, 30, "20S", 0)]
    df = spark.createDataFrame(cases, "text string, l long, r long, want string, by long")
    kept, moved = cigar.clip_ref_edges(cigar.parse(F.col("text")), F.col("l"), F.col("r"))
    for x in df.withColumns({"kept": cigar.render(kept), "moved": moved}).collect():
        assert (x["kept"], x["moved"]) == (x["want"], x["by"]), x


def test_texts_are_made_once(spark):
    """The compared texts stood in each step of the comparison, four times."""
    df = spark.createDataFrame([("ACGTN", "ACGTN", 4), ("ACG", "ACGT", 3), ("", "A", 0), ("CA", "GA", 0), ("A" * 9, "A" * 9, 8)], "x string, y string, n int")
    found = df.select(shifts.common_start(F.col("x"), F.col("y"), 8).alias("same"), "n")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("translate(") == 2
    assert all(r["same"] == r["n"] for r in found.collect())


def test_a_round_deals_bases_once(spark, monkeypatch):
    """A round's texts were put together by each piece first and then, dealt again, by the indel."""
    plans = []
    real = shifts.stored
    monkeypatch.setattr(shifts, "stored", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df))[1])
    chunks = spark.createDataFrame([("c", 0, "ACGT" * 200), ("c", 800, "TTAC" * 200)], "chrom string, start long, seq string")
    indels = spark.createDataFrame([(1, "c", 40, 44, ""), (2, "c", 790, 790, "AC"), (3, "c", 803, 804, "")], "id long, chrom string, start long, end long, inserted string")
    found = {r["id"]: (r["left"], r["right"]) for r in shifts.indel_shifts(indels, chunks, 800).collect()}
    assert found[1] == (40, 756) and len(plans) > 2
    assert all(p.count("Aggregate") == 2 for p in plans[1:])
