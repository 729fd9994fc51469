import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from strandline.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, digest string, depth int"


def conversations():
    r = random.Random(5)
    out = []
    for c in [*range(0, 64), -3, -41, 10_000, 10_007, 10_020]:
        for t in range(r.choice([1, 1, 2, 3, 4, 6, 9])):
            out.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {r.randint(0, 1)} of {t}", "x", 3))
    out += [(200 + i, t, "user", f"the same {t}", None, None) for i in range(40) for t in range(5)]  # copies
    out += [(300, None, "user", "first", None, None), (300, 1, None, None, None, None), (301, None, "user", "first", None, None), (302, 0, "", "", None, None)]
    out += [(303, 7, "user", "tie a", None, None), (303, 7, "user", "tie b", None, None), (303, 7, "user", "tie a", None, None), (None, 0, "user", "nobody's", None, None)]
    out += [(321, 0, "user", "lost its turns", None, None)]
    return out


def brute(rows, rebuild=True):
    """Nodes as tuples of turns."""
    turn_hash = lambda role, text: hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, turn_hash(role or "", text or ""), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    made = dict(own)
    if rebuild:
        for c in own:
            h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
            made[c] = own.get(base, [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = Counter(n[:-1] for n in members if n)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[: len(node)] == node]
        words = lambda n: len(n[-1][1].split()) if n else 0
        ids = ",".join(map(str, sorted(ends[node])))
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children[node], sum(not children[n] for n in below),
            sum((len(members[n]) - 1) * words(n) for n in below), hashlib.sha256(ids.encode()).hexdigest(),
        ))
    return Counter(out)


@pytest.mark.parametrize("block", [1024, 2])
def test_trie_by_brute_force(spark, monkeypatch, block):
    """Also with blocks of two depths and pieces of four ids, so that sums and hashes are handed on."""
    monkeypatch.setattr(trie.running, "__defaults__", (block,))
    monkeypatch.setattr(trie, "PIECE_BITS", 12 if block == 1024 else 2)
    table = spark.createDataFrame(conversations(), SCHEMA).repartition(5)
    assert Counter(map(tuple, trie.rebuilt_trie(table).collect())) == brute(conversations())
    assert Counter(map(tuple, trie.conversation_trie(table).collect())) == brute(conversations(), rebuild=False)


def test_trie_sql(spark):
    table = spark.createDataFrame(conversations(), SCHEMA)
    con = duckdb.connect()
    con.register("conversations", table.toArrow())
    want = con.execute(queries.oracle_sql()["op11_conversation_trie"])
    names = [d[0] for d in want.description]
    assert Counter(map(tuple, trie.rebuilt_trie(table).select(names).collect())) == Counter(want.fetchall()) == brute(conversations())


def test_long_conversation_and_chain_of_chains(spark):
    """One conversation of 5,000 turns, and conversations that each leave the one before it a turn later."""
    rows = [(1000, t, "user", f"long {t}", None, None) for t in range(5000)]
    rows += [(c, t, "user", f"t {t}" if t < c else f"own {c} {t}", None, None) for c in range(12) for t in range(13)]
    got = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {(r["conv_id"], r["depth"]): r for r in got}
    assert len(got) == 1 + 5000 + len({n for c in range(12) for n in [tuple(f"t {t}" if t < c else f"own {c} {t}" for t in range(d)) for d in range(1, 14)]})
    assert by[0, 0]["n_leaves"] == 13 and by[0, 0]["n_convs"] == 13 and by[1000, 5000]["parent_conv_id"] == 1000 and by[1000, 1]["parent_conv_id"] == 0
    assert by[0, 0]["saved_tokens"] == 2 * sum(12 - 1 - t - 1 for t in range(11))


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert trie.rebuilt_trie(none).count() == trie.conversation_trie(none).count() == 0
