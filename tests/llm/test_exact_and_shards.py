import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from strandline.llm import exact_dedup, queries, sharding
from tests.llm.conftest import rows


@pytest.mark.parametrize(("runs", "fan_in", "keep"), [(None, 2, "largest"), (64, 8, "largest"), (1, 2, "largest"), (5, 2, "smallest"), (7, 3, "largest")])
def test_exact_groups(docs, runs, fan_in, keep):
    groups = defaultdict(list)
    for r in rows():
        groups[r[1] or ""].append(r[0])
    found = exact_dedup.exact_groups(docs, runs=runs, fan_in=fan_in, keep=keep).collect()
    assert len(found) == len(rows())
    by_hash = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = Counter()
    for r in found:
        ids = by_hash[r["text_sha256"]]
        named = [i for i in ids if i is not None]
        assert r["keep_id"] == ((max if keep == "largest" else min)(named) if named else None)
        assert r["group_size"] == len(ids)
        if r["kept"]:
            assert r["doc_id"] == r["keep_id"]
            kept[r["text_sha256"]] += 1
    assert kept == Counter(dict.fromkeys(by_hash, 1))


def test_exact_sql_on_repeated_rows(spark):
    """Rows that repeat whole, rows of one id with different texts, null ids and texts: the SQL agrees on every row."""
    some = [(i % 7 if i % 5 else None, None if i % 11 == 0 else f"text {i % 3}") for i in range(200)] + [(3, "alone")] * 4 + [(9, "")] * 3
    table = spark.createDataFrame(some, "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", table.toArrow())
    want = con.sql(queries.oracle_sql()["op10_exact_dedup"])
    got = exact_dedup.exact_groups(table).select(want.columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())


def test_runs_are_sorted_and_merged(spark, monkeypatch):
    """Each level is in digest order within its range and run, one entry per digest; the plans sort, and group nothing by hash."""
    table = spark.range(3000).selectExpr("id AS doc_id", "concat('t', if(id % 3 = 0, 0, id % 700)) AS text")
    rows = exact_dedup.settled(exact_dedup.digest_rows(table, "doc_id", "text"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    runs = exact_dedup.sorted_runs(rows, 8, 4, "largest")
    assert "Sort [" in plan(runs) and "HashAggregate" not in plan(runs)
    level, n = exact_dedup.settled(runs).filter("_n IS NOT NULL").select("_part", "_run", *exact_dedup.DIGEST, "_id", "_n"), 8
    sizes = []
    while True:
        found = level.collect()
        sizes.append(len(found))
        assert sum(r["_n"] for r in found) == 3000
        runs_seen = defaultdict(list)
        for r in found:
            runs_seen[r["_part"], r["_run"]].append(bytes(r["_sha"]))
        assert all(x == sorted(set(x)) for x in runs_seen.values()) and len({r for _, r in runs_seen}) <= n
        if n == 1:
            break
        merged = exact_dedup.merge_round(level, 2, "largest")
        assert "Sort [" in plan(merged) and "HashAggregate" not in plan(merged)
        level, n = exact_dedup.settled(merged), n // 2
    assert sizes == sorted(sizes, reverse=True) and len(sizes) == 4 and sizes[-1] == len({0 if i % 3 == 0 else i % 700 for i in range(3000)})


def test_exact_dedup_keeps_columns(docs, empty):
    kept = exact_dedup.exact_dedup(docs)
    assert kept.columns == docs.columns
    texts = Counter(r["text"] or "" for r in kept.collect())
    assert texts == Counter({r[1] or "" for r in rows()})
    assert exact_dedup.exact_dedup(empty).count() == 0 == exact_dedup.exact_groups(empty).count()


def test_exact_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = con.sql(queries.oracle_sql()["op10_exact_dedup"])
    got = queries.op10_exact_dedup(spark, sf_dir).select(want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_shards(docs, empty):
    found = sharding.shard(docs, [1.0] * 24).collect()
    assert len(found) == len(rows())
    sizes = {(r[0], r[1]): (len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows()}
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == Counter((r[0], *sizes[r[0], r[1]]) for r in rows())
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 24) and 0 <= r["shard"] < 24 and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = defaultdict(set)
    for r in found:
        by_id[r["doc_id"]].add((r["shard"], r["grown_shard"]))
    assert all(len(s) == 1 for s in by_id.values())
    assert sharding.shard(empty, [1.0] * 3).count() == 0


def test_shard_weights(spark):
    keys = spark.range(20_000).selectExpr("id AS doc_id", "'' AS text")
    counts = Counter(r["shard"] for r in sharding.shard(keys, [1.0, 2.0, 1.0], buckets=7).collect())
    assert abs(counts[1] / 20_000 - 0.5) < 0.02 and abs(counts[0] / 20_000 - 0.25) < 0.02
    a = {r["doc_id"]: r["shard"] for r in sharding.shard(keys, [1.0, 1.0]).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.shard(keys, [1.0, 1.0, 1.0]).collect()}
    assert {b[k] for k in a if a[k] != b[k]} == {2}
