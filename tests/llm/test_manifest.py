import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb

from strandline.llm import manifest, queries
from tests.llm.conftest import rows


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """The root, and for each leaf the siblings met on its way."""
    above, met, where = nodes, [[] for _ in nodes], list(range(len(nodes)))
    while len(above) > 1:
        for k, at in enumerate(where):
            if at ^ 1 < len(above):
                met[k].append((at & 1, above[at ^ 1]))
            else:
                met[k].append(None)
        above = [h(*above[i : i + 2]) for i in range(0, len(above), 2)]
        where = [at // 2 for at in where]
    return above[0], met


def fold(node, met):
    for x in met:
        node = h(node) if x is None else h(x[1], node) if x[0] else h(node, x[1])
    return node


def brute(table):
    groups = defaultdict(list)
    for doc_id, text, lang, source, n_chars, *_ in table:
        other = n_chars + 1 if doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 else n_chars
        groups[lang].append((doc_id is not None, doc_id or 0, leaf(doc_id, text, lang, source, n_chars), leaf(doc_id, text, lang, source, other)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    root, above = tree([trees[g][0] for g in names])
    out = []
    for g, tops in zip(names, above):
        for (known, doc_id, own, other), met in zip(sorted(groups[g]), trees[g][1]):
            siblings = [x[1] for x in met + tops if x]
            got = fold(other, met + tops)
            out.append((doc_id if known else None, own, trees[g][0], root, h(*siblings), got, got == root))
    return Counter(out)


def test_manifest_by_brute_force(docs):
    got = manifest.verified(docs).collect()
    assert Counter(map(tuple, got)) == brute(rows())
    assert {r["verified"] for r in got} == {True, False}


def test_small_groups_and_lone_ones(spark):
    for sizes in ([1], [2], [1, 1], [3, 1, 2], [5, 8, 9, 1, 1]):
        table = [(100 * g + i, "t", f"l{g}" if g else None, "s", i) for g, n in enumerate(sizes) for i in range(n)]
        df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
        assert Counter(map(tuple, manifest.verified(df).collect())) == brute(table), sizes


def test_manifest_sql(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.execute(queries.oracle_sql()["op13_merkle_manifest"])
    names = [d[0] for d in want.description]
    assert Counter(map(tuple, manifest.verified(docs).select(names).collect())) == Counter(want.fetchall())


def test_every_field_counts(spark):
    table = [(i, f"text {i}", "en" if i % 2 else "fr", "s", i) for i in range(9)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    roots = set()
    for change in (None, (3, "text 3 ", "en", "s", 3), (3, "text 3", "en", None, 3), (3, "text 3", "en", "s", None), (3, None, "en", "s", 3), (3, "text 3", "fr", "s", 3)):
        df = spark.createDataFrame([change if change and r[0] == 3 else r for r in table], schema)
        roots |= {r["root"] for r in manifest.verified(df).select("root").collect()}
    assert len(roots) == 6


def test_equal_rows_spread(spark):
    """One row 20,000 times in one group: numbered in ranges, a leaf each."""
    df = spark.range(20_000).selectExpr("7L AS doc_id", "'same' AS text", "'en' AS lang", "'s' AS source", "4L AS n_chars")
    got = manifest.verified(df).select("leaf", "root", "proof_sha256").distinct().collect()
    assert len({r["leaf"] for r in got}) == len({r["root"] for r in got}) == 1


def test_empty(empty):
    assert manifest.verified(empty).count() == 0
