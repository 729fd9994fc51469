import re
from collections import defaultdict

import numpy as np
import pytest

from strandline.llm import mixing
from tests.llm.conftest import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, weights=(3, 1, 2), total=1.5, most=2.0):
    """Sharing again what is above the limit until nothing is."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, open_ = total * sum(sizes.values()), {}, set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            out |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mix(docs, empty):
    found = mixing.mix_rows(docs).collect()
    assert len(found) == len(rows())
    sizes = defaultdict(int)
    for r in rows():
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want, taken = targets(sizes), defaultdict(int)
    largest = defaultdict(int)
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["taken"] == r["size"] * r["copies"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6
    again = mixing.mix_rows(docs.repartition(5)).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    assert mixing.mix_rows(empty).count() == 0


def test_mixed_repeats_documents(docs):
    copies = mixing.mix_rows(docs).collect()
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in copies)


def test_leaves_and_levels(spark, monkeypatch):
    """Many leaves and several levels of the tree: words taken still differ from the target by one document at most."""
    monkeypatch.setattr(mixing, "LEAF_ROWS", 4)
    table = spark.range(600).selectExpr("id AS doc_id", "trim(repeat('w ', cast(1 + id % 13 AS int))) AS text", "if(id % 3 = 0, 'a', 'b') AS source")
    found = mixing.mix_rows(table, fan_in=3).collect()
    for s in "ab":
        own = [r for r in found if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 13


def test_pivot_keeps_expectations():
    size, part = np.array([5.0, 3.0, 8.0, 1.0]), np.array([0.3, 0.6, 0.5, 0.9])
    r, sums = np.random.default_rng(1), np.zeros(4)
    for _ in range(20_000):
        out, held = mixing.pivot(size, part, r.random(4))
        assert sum((out > 1e-9) & (out < 1 - 1e-9)) == (held >= 0)
        assert size @ out == pytest.approx(size @ part)
        sums += out
    assert np.abs(sums / 20_000 - part).max() < 0.02


def test_random_targets(spark):
    r = np.random.default_rng(5)
    for _ in range(3):
        sizes = {f"s{i}": int(r.integers(1, 400)) for i in range(int(r.integers(1, 9)))}
        table = spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes.items())], "_id long, source string, size long").selectExpr("*", "1L AS _m")
        got = {x["_source"]: x["target"] for x in mixing.source_targets(table, (3, 1, 2), 1.5, 2.0).collect()}
        assert got == pytest.approx(targets(sizes))


def test_many_equal_rows(spark):
    """A source of 6,000 equal rows: within one row of its target, its rows' copies differ by one at most, and the mix has them."""
    text = "six words are in this text"
    some = [(7, text, "a")] * 6000 + [(i, f"{text} {i}" * (1 + i % 3), "b") for i in range(3000)] + [(None, text, "b")] * 500
    table = spark.createDataFrame(some, "doc_id long, text string, source string").repartition(5)
    found = mixing.mix_rows(table).collect()
    assert len(found) == len(some)
    for s in "ab":
        own = [r for r in found if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    copies = {r["copies"] for r in found if r["doc_id"] == 7}
    assert max(copies) - min(copies) <= 1
    out = mixing.mixed(table)
    assert out.columns == table.columns
    taken = {s: 0 for s in "ab"}
    for r in out.collect():
        taken[r["source"]] += len(r["text"].split())
    assert taken == {s: sum(r["taken"] for r in found if r["source"] == s) for s in "ab"}


def test_large_ids_keep_their_digits(spark):
    table = spark.createDataFrame([(9007199254740993, "a b", "s"), (None, "a b", "s"), (9007199254740995, "c", "s")], "doc_id long, text string, source string")
    assert {r["doc_id"] for r in mixing.mix_rows(table).collect()} == {9007199254740993, None, 9007199254740995}
