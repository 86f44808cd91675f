"""The trie against a brute-force one: random trees, seams between ranges, spilled runs, odd rows."""

import collections
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from verdigris.llm import prefix_trie as P

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, graft=True):
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if graft else 0
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members, below = collections.defaultdict(list), collections.defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in below[p]) or 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in below[p])
    ends = lambda p: ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
    return sorted(
        ((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items()), key=str
    )


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=str)


def random_rows(n, seed):
    rng = random.Random(seed)
    ids = [0, 1, 2, 3, 100, 101, 102, 103, 250, -105, -100, *range(4, 13)]
    return [(rng.choice(ids), rng.choice([None, 0, 1, 2, 3, 4, 5, 5]), rng.choice(["u", "a", None]), rng.choice(["x", "yy", "ÿ😀", None, ""])) for _ in range(n)]


@pytest.mark.parametrize("n,seed", [(150, 1), (400, 3)])
@pytest.mark.parametrize("limits", [{"ranges": 3, "run": 5, "held": 10, "waiting": 2, "ends": 2}, {"ranges": 9, "run": 3, "held": 50, "waiting": 100, "ends": 1}])
def test_random_tables(spark, n, seed, limits):
    rows = random_rows(n, seed)
    assert rows_of(P.nodes(P.grafted(spark.createDataFrame(rows, SCHEMA)), **limits)) == brute(rows)


def test_one_hot_conversation_and_one_hot_first_turn(spark):
    rows = [(i, t, "user", f"turn {t}") for i in range(300) for t in range(3)]
    rows += [(i, t, "user", "turn 0" if t == 0 else f"{i} {t}") for i in range(300, 400) for t in range(4)]
    rows += [(500, t, "user", f"{t}") for t in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    for limits in ({"ranges": 8, "ends": 20, "waiting": 10}, {"ranges": 1, "run": 50, "held": 100}):
        assert rows_of(P.nodes(P.turns(df), **limits)) == brute(rows, graft=False)


def test_odd_tables(spark):
    assert rows_of(P.nodes(P.grafted(spark.createDataFrame([], SCHEMA)))) == []
    rows = [(None, 1, "u", "no conversation"), (5, None, None, None), (5, None, None, None), (7, 2, "u", "long " * 20_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"depth": F.lit("clash"), "turns": F.lit(1), "k1": F.lit("x")})
    assert rows_of(P.nodes(P.grafted(df))) == brute(rows)
    alone = spark.createDataFrame([(7, 2, "u", "x")], SCHEMA)  # 7 loses its turn to a conversation that isn't there
    assert rows_of(P.nodes(P.grafted(alone))) == brute([(7, 2, "u", "x")])


def test_role_and_text_are_apart(spark):
    rows = [(1, 0, "ab", "c"), (2, 0, "a", "bc"), (3, 0, "abc", ""), (4, 0, "", "abc")]
    assert rows_of(P.nodes(P.turns(spark.createDataFrame(rows, SCHEMA)))) == brute(rows, graft=False)


def test_merge_keeps_order_and_counts_shared_turns():
    rng = random.Random(4)
    items = [(b"".join(rng.choice([b"a", b"b"]) * P.KEY for _ in range(rng.randint(0, 9))), i, b"") for i in range(500)]
    rng.shuffle(items)
    for run, held in ((1, 10**9), (7, 40), (10**9, 10**9)):
        got = list(P.sort(iter(items), run, held))
        assert [x[:2] for x in got] == sorted(x[:2] for x in items)
        before = b""
        for keys, _, _, common in got:
            assert common == P.shared(before, keys)
            before = keys


def test_merge_compares_only_beyond_shared_turns(monkeypatch):
    seen = []
    real = P.shared
    monkeypatch.setattr(P, "shared", lambda a, b, known=0: seen.append(real(a, b, known) - known) or real(a, b, known))
    prefix = b"p" * P.KEY * 1000
    runs = [P.Run([(prefix + bytes([i + 2 * j]) * P.KEY, 0, b"") for j in range(50)]) for i in range(2)]
    seen.clear()
    assert len(list(P.merged(runs))) == 100
    assert sum(seen) <= 1001  # the shared thousand turns are walked once, not for each item
