"""The segmentation queries over an axis of more than 150 bins, by brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from strandline.operators import hmm
from strandline.plans import registry


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """(folder, {(sample, chrom): {bin: bases}}, {doc: text}): 200 bins of one chromosome."""
    d, r = str(tmp_path_factory.mktemp("wide")), random.Random(4)
    lines = [(k, r.choice((0, 10)), 0, r.randint(1, 3), r.randint(1, 50)) for k in range(0, 20_000, 12)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber long, l_quantity double"
    spark.createDataFrame([(*x[:4], float(x[4])) for x in lines], names).coalesce(1).write.parquet(f"{d}/lineitem.parquet")
    bases = defaultdict(lambda: defaultdict(int))
    for order, part, supplier, number, quantity in lines:
        start = order * 10 + part % 10
        for p in range(start, start + 200 + quantity * 40):
            bases[number % 3, supplier % 24][p // 1000] += 1
    texts = {i: "".join(r.choice("ACGT") for _ in range(n)) for i, n in enumerate((1, 90, 250, 399, 1000, 2050))}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d, bases, texts


def runs(states):
    """(begin, end, state) of bins with reads that follow each other."""
    out = []
    for b in sorted(states):
        if out and out[-1][2] == states[b]:
            out[-1][1] = b + 1
        else:
            out.append([b, b + 1, states[b]])
    return [tuple(x) for x in out]


def rows(spark, wide, name, *columns):
    return sorted(map(tuple, registry.queries()[name](spark, wide[0]).select(*columns).collect()))


def test_best_states(spark, wide):
    want = []
    for (sample, chrom), own in wide[1].items():
        at = sorted(own)
        depth = np.array([own[b] / 1000 * ((b + sample) // 30 % 4) / 2 if b % 17 else np.nan for b in at])
        path = hmm.best_path(hmm.emissions(depth, np.ones(len(at)), 1.25), np.zeros(len(at), int), hmm.first_states(bool(np.isnan(depth[0])), 2))
        want += [(sample, chrom, *x) for x in runs(dict(zip(at, path.tolist())))]
    assert max(x[3] for x in want) > 190
    assert rows(spark, wide, "best_states", "sample", "chrom", "begin", "end", "state") == sorted(want)


def test_later_queries_reach_the_end(spark, wide):
    last = {k: max(own) + 1 for k, own in wide[1].items()}
    for name in ("converged_states", "synced_boundaries", "copy_quality"):
        found = defaultdict(int)
        for sample, chrom, end in rows(spark, wide, name, "sample", "chrom", "end"):
            found[sample, chrom] = max(found[sample, chrom], end)
        assert found == last


def test_whole_boundaries(spark, wide):
    edges = []
    for (sample, chrom), own in wide[1].items():
        own = runs({b: min(n // 1500, 6) for b, n in own.items()})
        edges += [(sample, chrom, b[0], 2 if a[2] > b[2] else 1) for a, b in zip(own, own[1:]) if 6 not in (a[2], b[2])]
    assert rows(spark, wide, "copy_boundaries", "sample", "chrom", "bin", "kind") == sorted(edges)
    want = []
    for kind in (1, 2):
        groups = []
        for b in sorted({e[2] for e in edges if e[3] == kind}):
            if groups and b - groups[-1][-1] <= 5:
                groups[-1].append(b)
            else:
                groups.append([b])
        want += [(0, kind, b) for g in groups if len(g) > 1 for b in g]
    assert any(b % 4 and b >= 150 for _, _, b in want)
    assert rows(spark, wide, "boundary_clusters", "chrom", "kind", "bin") == sorted(want)
