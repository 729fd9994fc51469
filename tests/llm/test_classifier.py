import math
import random
import re

import pytest

from strandline.llm import classifier as c
from tests.llm.conftest import rows

SP = r"\x20\x09-\x0D"


def stats(text):
    t = text or ""
    words = re.findall(rf"[^{SP}]+", t)
    solid = "".join(words)
    n, chars, total = len(words), len(solid), len(t)
    letters = sum(x.isalpha() for x in solid)
    count = lambda kinds: sum(x in kinds for x in solid)
    digits, odd = sum(x.isdecimal() for x in solid), chars - letters
    capitals = sum(x.isupper() and x.isalpha() for x in t)
    shouted = sum(len(x) for x in re.findall(r"[A-ZÀ-ÖØ-Þ]{2,}", t))
    stops = sum(w[-1] in ".!?" for w in words)
    stuttered = len(re.sub(rf"(?<![^{SP}])([^{SP}]+)(?:[{SP}]+\1(?![^{SP}]))+", r"\1", t))
    lines = t.split("\n")
    echoed, i = 0, 0
    while i < len(lines):
        j = i
        while lines[i] and j + 1 < len(lines) and lines[j + 1] == lines[i]:
            j += 1
        echoed += (j - i) * (len(lines[i]) + 1)
        i = j + 1
    some = lambda x: max(x, 1)
    other = (odd - count("#*$%&|<>") - digits - count("!?") - count(",;:") - count(".")) / some(chars)
    return [math.log1p(n), chars / some(n), count("#*$%&|<>") / some(n), capitals / some(letters), digits / some(chars), count("!?") / some(n), stops / some(n), count(",;:") / some(n),
            shouted / some(letters), (total - stuttered) / some(total), math.log1p(n / len(lines)), echoed / some(total), other]


def test_statistics_by_brute_force(docs):
    got = c.statistics(docs, keep=("text",)).collect()
    assert len(got) == len(rows())
    for r in got:
        want = stats(r["text"])
        assert all(math.isclose(r[n], w, abs_tol=1e-9) for n, w in zip(c.STATISTICS, want)), (r["text"] and r["text"][:60], dict(zip(c.STATISTICS, zip(r[1:], want))))


def test_long_texts(spark):
    """Five million letters in one word, a million equal words and a million equal lines."""
    df = spark.createDataFrame([(0, "x" * 5_000_000), (1, "la " * 1_000_000), (2, "a line\n" * 1_000_000)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in c.statistics(df).collect()}
    assert got[0]["word_length"] == 5_000_000 and got[1]["stutters"] > 0.99 and got[2]["echoes"] > 0.99


def test_rules_of_a_tree():
    tree = "Tree\n  If (feature 0 <= 1.5)\n   If (feature 1 <= 0.25)\n    Predict: 0.0\n   Else (feature 1 > 0.25)\n    If (feature 0 <= 0.5)\n     Predict: 1.0\n    Else (feature 0 > 0.5)\n     Predict: 0.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    found = {r.bounds for r in c.rules_of(tree, ("a", "b"))}
    assert found == {
        (("a", None, 1.5),), (("a", None, 1.5), ("b", None, 0.25)), (("a", None, 1.5), ("b", 0.25, None)), (("a", None, 0.5), ("b", 0.25, None)), (("a", 0.5, 1.5), ("b", 0.25, None)), (("a", 1.5, None),),
    }


def test_compiled_score(spark):
    some = c.Ensemble(-0.5, ((c.Rule((("digits", None, 0.2), ("symbols", 0.1, None))), 2.0), (c.Rule((("digits", 0.1, 0.3),)), -1.25)))
    df = spark.createDataFrame([(d / 10, s / 10) for d in range(5) for s in range(4)], "digits double, symbols double")
    for r in df.withColumn("score", some.score()).collect():
        z = -0.5 + 2.0 * (r["digits"] <= 0.2 and r["symbols"] > 0.1) - 1.25 * (0.1 < r["digits"] <= 0.3)
        assert math.isclose(r["score"], 1 / (1 + math.exp(-z)))


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    got = c.classify(docs, labels)
    assert got.count() == docs.count()
    met = got.filter("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    right = sum(r["predicted"] == r["quality"] for r in met) / len(met)
    good = [r for r in met if r["quality"] == 1]
    assert right >= 0.95 and sum(r["predicted"] for r in good) / len(good) >= 0.97


def test_labels_of_held_out_rows_are_not_read(spark):
    r = random.Random(1)
    table = [(i, " ".join(r.choice(["word", "other", "thing."]) for _ in range(60)) if i % 2 else "### $$$ | " * 30) for i in range(200)]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    flags = {r["doc_id"]: r["h"] for r in docs.select("doc_id", c.held_out().alias("h")).collect()}
    true = [(i, i % 2) for i in range(200)]
    lied = [(i, 1 - q if flags[i] else q) for i, q in true]
    a, b = (sorted(map(tuple, c.classify(docs, spark.createDataFrame(x, "doc_id long, quality int"), trees=4).collect())) for x in (true, lied))
    assert a == b
    assert all(predicted == i % 2 for i, _, _, predicted in a)


@pytest.mark.parametrize(("labels", "score"), [([], 0.5), ([(5, None), (None, 1)], 0.5), ([(i, 1) for i in range(9)], 1.0), ([(i, 0) for i in range(9)], 0.0)])
def test_without_two_labels(spark, docs, labels, score):
    got = c.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
    assert len(got) == len(rows()) and all(abs(r["score"] - score) < 1e-9 for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got)


def test_empty(spark, empty):
    assert c.classify(empty, spark.createDataFrame([], "doc_id long, quality int")).count() == 0
