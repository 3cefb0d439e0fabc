"""Conversation trie against a plain trie of dicts."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sigfolio.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
CLASH = ("conv", "i", "d", "key", "digest", "n", "part", "label", "any", "depth", "n_bytes", "base", "h", "m")


def digest(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()


def rebuilt(rows):
    """Conversation -> its rebuilt turns, by the contract's words."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", digest(role or "", text or ""), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    return out


def plain(convs):
    members, kids = defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[:d - 1])].add(tuple(turns[:d]))
    out = []
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below = [totals[k] for k in kids[node]] if out else []
        if not out:
            totals = {}
        totals[node] = (sum(x[0] for x in below) or 1, own + sum(x[1] for x in below))
        ends = ",".join(str(c) for c in sorted(members[node]) if len(convs[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(kids[node]),
                    totals[node][0], totals[node][1], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def built(df):
    turns, convs = prefix_trie.mixed(prefix_trie.number_turns(df))
    return sorted(map(tuple, prefix_trie.trie(turns, convs).drop("turn_bytes").collect()), key=repr)


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in CLASH:
        df = df.withColumn(name, F.lit("x"))
    return df


def test_random_conversations(spark):
    rng = random.Random(5)
    rows = []
    for c in rng.sample(range(400), 120):
        for t in range(rng.randint(1, 14)):
            rows.append((c, rng.choice([None, t, t, t // 2]), rng.choice(["user", "user", None]), rng.choice(["a", "a", "a", "b", "", None, "żółw"])))
    rows += rng.sample(rows, 40)  # repeated rows
    rows += [(None, 0, "user", "a"), (3000, 0, "user", "x" * 300_000), (3000, None, None, None)]
    rng.shuffle(rows)
    assert built(frame(spark, rows)) == plain(rebuilt(rows))


def test_long_and_nested_conversations(spark, monkeypatch):
    """Chains over many blocks, and every conversation a beginning of the next."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "SPAN", 8)
    rows = [(c, t, "user", str(t % 3)) for c in (0, 1, 2, 6, 12) for t in range(90 + c)]
    rows += [(100 + 5 * k, t, "user", f"n{t}") for k in range(30) for t in range(k + 1)]
    assert built(frame(spark, rows)) == plain(rebuilt(rows))


def test_hot_first_turn(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "HOT", 4)
    monkeypatch.setattr(prefix_trie, "PIECE", 20)
    rows = [(c, t, "user", "hello" if t == 0 else f"{c} {t}") for c in range(0, 300, 5) for t in range(1 + c % 3)]
    rows += [(c, 0, "user", "same") for c in range(1000, 1300, 5)]
    assert built(frame(spark, rows)) == plain(rebuilt(rows))


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "a")]])
def test_nothing(spark, rows):
    assert built(frame(spark, rows)) == []


def test_turnless_conversation(spark):
    """Conversation 1 keeps nothing: its base is absent and h covers its turns."""
    assert zlib.crc32(b"1") % 9 > 1
    rows = [(1, 0, "user", "gone"), (7, 0, "user", "gone too")]
    assert built(frame(spark, rows)) == plain(rebuilt(rows))


def test_prefix_keys_do_not_depend_on_the_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    turns = [(c, d, bytes([d % 2]), 1) for c, n in ((1, 27), (2, 26), (3, 9), (4, 3), (5, 40)) for d in range(1, n + 1)]
    convs = spark.createDataFrame([(1, 27), (2, 26), (3, 9), (4, 3), (5, 40)], "conv long, length long")
    keys = prefix_trie.prefix_keys(spark.createDataFrame(turns, "conv long, d long, digest binary, n_bytes long"), convs)
    by = defaultdict(set)
    for r in keys.collect():
        by[r["d"]].add((bytes(r["parent"]), bytes(r["key"])))
    assert all(len(x) == 1 for x in by.values()) and len(by) == 40
    assert len({next(iter(x))[1] for x in by.values()}) == 40
    assert all(next(iter(by[d]))[0] == next(iter(by[d - 1]))[1] for d in range(2, 41))
