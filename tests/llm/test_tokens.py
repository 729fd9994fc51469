import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import packing, token_files
from strandline.llm.tokenize import TextEncoder, tokenizer_path
from tests.llm.conftest import rows

FILES = (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False))
ENCODERS = {name: TextEncoder(tokenizer_path(name), keeps) for name, keeps in FILES}
ODD = ["ab  cd", "ab \n cd", "\n\nab", " ", "", "a\tb c", "it's  we'll\n'll  x", "a b ", "don't  'S", "<|endoftext|> a", "İstanbul ÀÈ² ½x '", "‘quoted’ – x", "x  'd y", "\n's a  'll"]


def library(name, text):
    return ENCODERS[name].tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ENCODERS)
def test_encoder_equals_library(name, monkeypatch):
    texts = ODD + [r[1] or "" for r in rows() if len(r[1] or "") < 10_000]
    for cache in (500_000, 20):
        monkeypatch.setattr("strandline.llm.tokenize.CACHE", cache)
        ENCODERS[name].cache.clear()
        got = ENCODERS[name].encode(texts)
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library(name, t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(" \n'stdAaéß9½.,!-\t\xa0ſİ中"), max_size=30))
def test_encoder_on_random_texts(text):
    for name, e in ENCODERS.items():
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == library(name, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2000), min_size=0, max_size=700), st.sampled_from([1, 7, 100_000]))
def test_elias_fano(steps, scale):
    values = np.cumsum(np.array(steps, np.int64) * scale)
    made = token_files.EliasFano.of(values)
    read, end = token_files.EliasFano.from_bytes(memoryview(made.to_bytes()), 0)
    assert end == len(made.to_bytes())
    n = len(values)
    assert read.selects(0, n).tolist() == values.tolist() == [read.select(i) for i in range(n)]
    for a, b in [(0, 1), (n // 3, n // 2), (255, 258), (256, 512), (n - 1, n), (-1, 5), (n // 2, n + 9), (5, 5)]:
        assert read.selects(a, b).tolist() == values[max(a, 0) : max(b, 0)].tolist()
    if len(values) > 100:
        assert len(made.low) + len(made.high) <= len(values) * (2 + max(0, np.log2(max(values[-1], 1) / len(values)) + 1)) / 8 + 3


def test_token_files(docs, empty, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "IDS_PER_FILE", 2000)
    found = token_files.round_trip(docs, folder=str(tmp_path / "files")).collect()
    want = [(r[0], zlib.crc32(np.array([*library("byte_bpe_50k.json", r[1] or ""), 0], "<u4").tobytes())) for r in rows()]
    assert Counter((r["doc_id"], zlib.crc32(r["ids"])) for r in found) == Counter(want)
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += len(r["ids"]) // 4
    ids = [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    files = sorted((tmp_path / "files").glob("*.eft"))
    assert len(files) > 1
    one = token_files.TokenFile(files[0].read_bytes())
    assert sum(len(one.document(i)) for i in range(one.n_docs)) == one.n_ids
    for a, b in [(0, one.n_docs), (1, 3), (one.n_docs - 2, one.n_docs)]:
        assert one.doc_ids(a, b) == [one.doc_ids(i, i + 1)[0] for i in range(a, b)]
    assert token_files.round_trip(empty).count() == 0


def test_reading_uses_many_tasks_and_a_hot_id_many_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(token_files, "IDS_PER_FILE", 500)
    table = spark.range(400).selectExpr("if(id % 2 = 0, 7L, id) AS doc_id", "repeat(concat('word', id, ' '), 20) AS text").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # it would join so small a table's partitions
    try:
        manifest = token_files.write(table, str(tmp_path), tokenizer_path("byte_bpe_50k.json"), 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.select((manifest["part"] / (1 << 20)).cast("int")).distinct().count() > 2  # tasks that wrote
    read = token_files.read(manifest, str(tmp_path))
    assert read.rdd.getNumPartitions() >= min(manifest.count(), 4)
    found = sorted(read.collect(), key=lambda r: r["start"])
    assert len(found) == 400 and [r["doc_id"] for r in found] == sorted(r["doc_id"] for r in found)


def test_cuts():
    for n in [*range(1, 300), 4095, 4096, 4097, 9000]:
        own = packing.cuts(n, 4096, 1 / 64)
        assert sum(own) == n and max(own) <= 4096
        assert all(4096 - (4096 // c) * c <= 4096 / 64 + 64 for c in own)


def test_packing(docs, empty):
    found = packing.packed(docs, with_ids=True).collect()
    want = defaultdict(list)
    for r in rows():
        want[r[0]].append(bytes(np.array([*library("word_bpe_49k.json", r[1] or ""), 2], "<u4").tobytes()))
    pieces = defaultdict(list)
    for r in found:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] > 0
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
    rebuilt = Counter()
    for (name, _), own in pieces.items():
        copies = min(Counter(s for s, _ in own).values())
        rebuilt[name, b"".join(x for _, x in sorted(own)[::copies])] += copies
    assert sum(rebuilt.values()) >= len({(k, v) for k, vs in want.items() for v in vs})
    assert {k for k in rebuilt} == {(k, v) for k, vs in want.items() for v in vs}
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert sorted(sequences) == list(range(len(sequences)))
    assert packing.packed(empty).count() == 0


def test_packing_wastes_little(spark):
    table = spark.range(3000).selectExpr("id AS doc_id", "repeat('word ', cast(1 + id * id % 3000 AS int)) AS text")
    found = packing.packed(table).collect()
    sequences = Counter()
    for r in found:
        sequences[r["sequence_id"]] += r["length"]
    assert sum(4096 - n for n in sequences.values()) < 0.02 * 4096 * len(sequences)
