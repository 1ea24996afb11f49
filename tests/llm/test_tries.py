"""The trie against a plain walk: counts, subtree sums, order of nodes, and long or hot conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tapeloom.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string, d string, a int"


def rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(own) - 1) * len(node[-1][1].encode()) if node else 0
    rows = set()
    for node, own in members.items():
        ends = ",".join(str(c) for c in sorted(own) if len(paths[c]) == len(node))
        rows.add((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return rows


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def made():
    rng = random.Random(1)
    rows = []
    for c in [*range(40), 10**12 + 3, 97, 98]:
        for t in range(rng.choice([1, 2, 3, 5, 9, 12])):
            rows.append((c, t, rng.choice(["user", "bot"]), rng.choice(["hi", "hi", "no", "Ünï", ""])))
    rows += [(60, None, None, None), (60, 1, "user", None), (60, 1, "a", "tie"), (60, 1, "a", "tie"), (None, 0, "user", "lost")]
    rows += [(c, t, "user", "same") for c in range(200, 260) for t in range(3)]
    return rows


@pytest.fixture(scope="module")
def nodes(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in made()], SCHEMA).repartition(5)
    return tries.rebuilt_trie(df).collect()


def test_equals_a_plain_walk(nodes):
    assert {tuple(r[c] for c in COLUMNS) for r in nodes} == brute(rebuilt(made())) and len(nodes) == len({(r["conv_id"], r["depth"]) for r in nodes})


def test_intervals_are_preorder(nodes):
    """Places are 0, 1, ...; a child's interval lies in its parent's, and siblings' don't meet."""
    assert sorted(r["pre"] for r in nodes) == list(range(len(nodes)))
    at = {r["pre"]: r for r in nodes}
    stack = []
    for place in range(len(nodes)):
        r = at[place]
        while stack and stack[-1]["end"] < place:
            stack.pop()
        assert r["depth"] == len(stack) and r["end"] >= place
        if stack:
            assert r["parent_conv_id"] is not None and r["end"] <= stack[-1]["end"]
        stack.append(r)


def test_parts_of_a_long_conversation(spark, monkeypatch):
    """Turns dealt over many windows, and ids over many pieces, give the same trie."""
    monkeypatch.setattr(tries, "TURNS", 4)
    monkeypatch.setattr(tries, "IDS", 7)
    rows = [*made(), *((5, t, "user", f"w{t % 3}") for t in range(60)), *((6, t, "user", f"w{t % 3}") for t in range(61))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert {tuple(r[c] for c in COLUMNS) for r in tries.rebuilt_trie(df).collect()} == brute(rebuilt(rows))


def test_turnless_conversations_end_at_the_root(spark):
    missing = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(missing, 0, "user", "gone")]
    got = tries.rebuilt_trie(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert {tuple(r[c] for c in COLUMNS) for r in got} == brute(rebuilt(rows)) and len(got) == 1


def test_empty_table_and_labels(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tries.rebuilt_trie(empty).collect() == []
    turns = spark.createDataFrame([(1, 1, "u", "a"), (1, 2, "b", "c"), (2, 1, "u", "a")], "conv_id long, d long, role string, text string")
    got = {(r["conv_id"], r["depth"]): (r["role"], r["text"], r["n_convs"]) for r in tries.labelled(tries.prefix_trie(turns), turns).collect()}
    assert got == {(1, 0): (None, None, 2), (1, 1): ("u", "a", 2), (1, 2): ("b", "c", 1)}


def test_prefix_sums_by_parts(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("g"), F.col("id").alias("x")).repartition(7)
    got = tries.running(df, ["g"], F.expr("x div 10"), [F.col("x")], {"s": F.col("x")}).collect()
    assert all(r["s"] == sum(y for y in range(r["x"] + 1) if y % 3 == r["g"]) for r in got) and len(got) == 300
