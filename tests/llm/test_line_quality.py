"""The field labels lines: planted headers and footers, held-out labels, the bounds of the sample."""

import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import quality

HEADERS = ["home | news | sport | contact | log in", "MENU >> SHOP >> BASKET (0) >> LOG IN"]
FOOTERS = ["SUBSCRIBE NOW!! CLICK HERE!!", "<< back | top | next >> *** share ***", "HOME | ABOUT | IMPRINT | PRIVACY"]


@pytest.fixture(scope="module")
def corpus(spark):
    """The larger test table: documents, and labels dealt into those for the fit and those held out."""
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(4)) == 0
    return docs, labels.filter(~held), labels.filter(held)


@pytest.fixture(scope="module")
def field(corpus):
    docs, known, _ = corpus
    return quality.fit(docs, known)


def test_held_out_labels(corpus, field):
    docs, _, held = corpus
    found = quality.judge(docs, field).join(held, "doc_id").collect()
    good = [r for r in found if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in found if r["quality"] == 0]
    assert len(good) > 50 and len(bad) >= 8
    assert sum(r["kept"] for r in good) >= 0.97 * len(good)
    assert sum(r["kept"] for r in bad) <= 0.1 * len(bad)


def test_many_texts_are_mixed(corpus, field):
    found = [r for r in quality.judge(corpus[0], field).collect() if r["n_lines"] > 1]
    assert sum(0 < r["n_content_words"] < r["n_words"] for r in found) >= 0.05 * len(found)


def test_planted_headers_and_footers(corpus, field):
    docs, known, held = corpus
    texts = [r["text"] for r in docs.join(held.filter("quality = 1"), "doc_id").orderBy("doc_id").collect()]
    right = {0: 0, 1: 0}
    total = {0: 0, 1: 0}
    mixed = 0
    for i, text in enumerate(texts):
        own = [x for x in text.split("\n") if len(x.split()) >= 8]
        if len(own) < 3:
            continue
        lines = [HEADERS[i % 2], HEADERS[1 - i % 2], *own, FOOTERS[i % 3], FOOTERS[(i + 1) % 3]]
        want = [0, 0, *[1] * len(own), 0, 0]
        got = field.decode(quality.line_features("\n".join(lines))[0]).tolist()
        mixed += 0 < sum(got) < len(got)
        for a, b in zip(want, got):
            total[a] += 1
            right[a] += a == b
    assert total[1] > 100 and mixed > 0.9 * total[0] / 4
    assert right[0] >= 0.9 * total[0] and right[1] >= 0.9 * total[1]


def test_recurring_lines_are_boilerplate():
    lines = [[7, k, 8] for k in range(20, 24)]
    near = [[100 + k, 7, 200 + k] for k in range(4)]
    got = quality.constraints([1, 1, 1, 0], lines, near)
    a, b, c = quality.PRIOR[2], quality.PRIOR[1], quality.PRIOR[0]
    assert [g.tolist() for g in got] == [[a, b, a]] * 3 + [[a, c, a]]
    again = quality.constraints([1, 1, 1], [[7, 8]] * 3, [[5, 6]] * 3)  # copies of one text: the same neighbours
    assert [g.tolist() for g in again] == [[b, b]] * 3


def test_the_sample_is_bounded_and_repeats(spark):
    """Repeated ids and labels, a text of more lines than the bound, null texts: the same field from any order of the rows."""
    good = "\n".join(f"These plain words {x} are of a {x}kind that {x}line ends well." for x in ("ab", "cd", "ef", "gh", "ij", "kl"))
    bad = "\n".join("SHOUT!! *** ### BUY $$$ NOW!!" + " !!" * k for k in range(6))
    rows = [(i % 5, good.replace("plain", f"plain {i}")) for i in range(40)] + [(100 + i % 4, bad + f" {i}") for i in range(40)]
    rows += [(5, "line ###\n" * 50_000), (6, None), (None, good)]
    labels = [(i, 1) for i in range(7)] * 3 + [(100 + i, 0) for i in range(4)] * 2 + [(None, 0), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, quality int")
    fields = [quality.fit(docs.repartition(n), known.repartition(n), sample_docs=60, sample_lines=400) for n in (1, 3)]
    assert np.allclose(fields[0].emit, fields[1].emit)
    found = {r["doc_id"]: r["kept"] for r in quality.judge(docs.filter("length(text) > 0"), fields[0]).collect()}
    assert quality.fit(docs, known, sample_docs=0).emit.tolist() == quality.Field.trusting().emit.tolist()
    assert found[0] and not found[100]


def test_blocks_change_nothing(monkeypatch):
    """Blocks of a few letters and pieces of a few keys give what one block gives."""
    r = random.Random(6)
    texts = ["", " ", "\n", "a\n\n b \n", "x\n" * 50, "é ü\r\nB! ?\n" * 5, "one", None, "a b " * 100, *["\n".join(" ".join(r.choice("abc") for _ in range(r.randint(0, 5))) for _ in range(60)) for _ in range(20)]]
    rng = np.random.default_rng(1)
    field = quality.Field(rng.normal(size=len(quality.FEATURES)), rng.normal(size=(2, 2)), rng.normal(size=2))
    whole = [(quality.judged(t, field), quality.line_features(t)[0].round(6).tolist()) for t in texts]
    for block, keys in ((1, 7), (13, 5), (40, 1000)):
        monkeypatch.setattr(quality, "BLOCK", block)
        monkeypatch.setattr(quality, "KEYS", keys)
        assert [(quality.judged(t, field), quality.line_features(t)[0].round(6).tolist()) for t in texts] == whole


def test_millions_of_lines_take_little_memory():
    """Five million one-letter lines, in a process of their own: under 100 bytes a line."""
    code = """
import random, resource
from strandline.llm import quality
text = "\\n".join(random.Random(1).choice("abcdefgh") for _ in range(5_000_000))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
found = quality.judged(text, quality.Field.trusting())
print(found[0], found[5], (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    words, lines, mb = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert words == lines == 5_000_000 and mb < 500
