from collections import Counter, defaultdict

import corpus_pipeline

from tests.llm.conftest import SCHEMA, rows
from tests.llm.test_mixing import WORD, targets
from tests.llm.test_models import brute_fingerprint, brute_groups
from tests.llm.test_tokens import library


def test_pipeline_by_brute_force(spark, tmp_path):
    table = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows())], SCHEMA)
    table.write.parquet(f"{tmp_path}/in/documents.parquet")
    stages, docs = [], spark.read.parquet(f"{tmp_path}/in/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, f"{tmp_path}/in")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        stages.append(docs.collect())
    known, unique, apart, mixed, pieces = stages
    documents = [r for i, r in enumerate(rows())]
    assert {r["doc_id"] for r in known} <= {i for i, r in enumerate(documents) if r[1] and any(c.isalpha() for c in r[1])}
    assert len(known) >= 0.95 * sum(bool(r[1]) and any(c.isalpha() for c in r[1]) for r in documents)
    last = {}
    for r in sorted(known, key=lambda r: r["doc_id"]):
        last[r["text"]] = r["doc_id"]
    assert sorted(r["doc_id"] for r in unique) == sorted(last.values())
    groups = brute_groups([(r["doc_id"], brute_fingerprint(r["text"])) for r in unique])
    assert sorted(r["doc_id"] for r in apart) == sorted({c for _, _, c in groups})
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in apart:
        n = len(WORD.findall(r["text"]))
        sizes[r["source"]] += n
        largest[r["source"]] = max(largest[r["source"]], n)
    for r in mixed:
        taken[r["source"]] += len(WORD.findall(r["text"]))
    want = targets(sizes)
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
    assert max(Counter(r["doc_id"] for r in mixed).values()) <= 2
    total = sum(len(library("word_bpe_49k.json", r["text"])) + 1 for r in mixed)
    assert sum(r["length"] for r in pieces) == total
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in mixed}


def test_run(spark, sf_dir):
    found = corpus_pipeline.run(spark, sf_dir)
    assert found.count() > 0 and found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "simhash_dedup", "source_mix", "packing"]


