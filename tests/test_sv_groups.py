"""Groups of variants over samples: each broken rule is named, and the maps follow from the lists."""

import pytest

from strandline.operators import sv_groups

GOOD = {
    "regions": ([(1,), (2,), (2,)], "group long"),
    "haplotypes": ([(1, 0, 1), (1, 1, 1), (2, 0, 2)], "group long, haplotype long, alignments long"),
    "variants": ([(1, 10, 0), (1, 11, 0), (1, 12, 1), (2, 20, 0)], "group long, sv long, haplotype long"),
    "lists": ([(1, 0, 0, 1), (1, 0, 1, 0), (1, 1, 0, 0), (2, 1, 0, 0)], "group long, sample long, place long, haplotype long"),
    "copies": ([(1, 0, 2), (1, 1, 1), (2, 0, 2), (2, 1, 2)], "group long, sample long, copies long"),
}


def tables(spark, **more):
    return {n: spark.createDataFrame(more.get(n, rows), schema) for n, (rows, schema) in GOOD.items()}


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(0,), (1,)], "sample long")


def rows(name):
    return GOOD[name][0]


BROKEN = [
    ({"regions": rows("regions")[1:]}, {(1, "no region"), (1, "alignments of a haplotype")}),
    ({"haplotypes": [(1, 0, 1), (1, 1, 2), (2, 0, 2)]}, {(1, "alignments of a haplotype")}),
    ({"copies": rows("copies")[1:]}, {(1, "copies of a sample")}),
    ({"copies": [*rows("copies"), (1, 0, 2)]}, {(1, "copies of a sample")}),
    ({"lists": [*rows("lists"), (2, 0, 0, 7)]}, {(2, "unknown haplotype of a sample")}),
    ({"lists": [*rows("lists"), (2, 1, 1, 0)]}, {(2, "repeated haplotype of a sample")}),
    ({"lists": [*rows("lists"), (1, 1, 1, 1)]}, {(1, "more haplotypes than ploidy")}),
    ({"variants": [*rows("variants"), (1, 13, 2)]}, {(1, "unknown haplotype of a variant")}),
    ({"variants": [*rows("variants"), (2, 21, 0)]}, {(2, "variants of a group of two regions")}),
]


def test_valid(spark, samples):
    assert sv_groups.violations(tables(spark), samples, True).count() == 0
    sv_groups.check(tables(spark), samples, True)
    empty = {n: df.limit(0) for n, df in tables(spark).items()}
    assert sv_groups.violations(empty, samples).count() == 0


def test_each_rule_is_named(spark, samples):
    assert {rule for _, want in BROKEN for _, rule in want} == set(sv_groups.RULES)
    for changed, want in BROKEN:
        assert {(r["group"], r["rule"]) for r in sv_groups.violations(tables(spark, **changed), samples, True).collect()} == want
    with pytest.raises(ValueError, match="group 2: repeated haplotype of a sample"):
        sv_groups.check(tables(spark, **BROKEN[5][0]), samples, True)


def test_maps(spark, samples):
    t = tables(spark, copies=[(1, 0, 1), (1, 0, 2), (1, 1, 1)], lists=[*rows("lists"), (1, 1, 1, 1)])
    kept = sv_groups.over_samples(t["lists"], t["copies"], True)
    found = {(r["group"], r["sample"]): (r["haplotypes"], r["variants"]) for r in sv_groups.sample_variants(kept, t["variants"], samples).collect()}
    assert found == {(1, 0): ([1, 0], [12, 10, 11]), (1, 1): ([0], [10, 11]), (2, 0): ([], []), (2, 1): ([0], [20])}
    assert {tuple(r) for r in sv_groups.haplotype_samples(kept).collect()} == {(1, 1, 0), (1, 0, 0), (1, 0, 1), (2, 0, 1)}
