"""Merkle audit against a plain comparison of records."""

import hashlib
import random
from collections import Counter

import pytest

from sigfolio.llm import merkle

SCHEMA = "file string, offset long, payload string, node long, hash string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(f, o, p, 1, "x", 2) for f, o, p in rows], SCHEMA)


def sha(p):
    return None if p is None else hashlib.sha256(p.encode()).hexdigest()


def plain(a, b):
    """(file, offset) of the places whose records differ."""
    x, y = Counter(a), Counter(b)
    return {(f, o) for f, o, p in (x - y) + (y - x)}


def archive(rng, n=400):
    rows, at = [], Counter()
    for k in range(n):
        f = "hot" if rng.random() < 0.4 else f"f{rng.randrange(4)}"
        p = "".join(rng.choice("abc é") for _ in range(rng.choice([0, 3, 50, 40000])))
        rows.append((f, at[f], p))
        at[f] += len(p.encode()) + rng.choice([1, 1 << 26])
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_finds_exactly_the_differing_records(spark, seed):
    rng = random.Random(seed)
    a = archive(rng)
    b = [(f, o, p + "!") if k % 50 == 7 else (f, o, p) for k, (f, o, p) in enumerate(a) if k % 60 != 11]
    b += [("new", 0, "extra"), a[3], ("hot", 5 << 40, "far away")]
    a += [a[8], ("old", 3, None), (None, 1, "adrift"), ("hot", None, "adrift too")]
    b += [("old", 3, ""), a[8]]
    got = merkle.audit(frame(spark, a), frame(spark, b)).collect()
    placed = [r for r in got if r["status"] != "unplaced"]
    assert {(r["file"], r["offset"]) for r in placed} == plain([x for x in a if None not in x[:2]], b)
    assert len([r for r in got if r["status"] == "unplaced"]) == 2
    inside = {(f, o, sha(p)) for f, o, p in a}
    for r in placed:
        if r["status"] in ("altered", "missing"):
            assert (r["file"], r["offset"], r["expected"]) in inside
        if r["status"] == "extra":
            assert r["expected"] is None and r["actual"] is not None
        assert r["primary_root"] != r["replica_root"]


def test_equal_replicas_and_empty_tables(spark):
    a = archive(random.Random(3), 60)
    assert merkle.audit(frame(spark, a), frame(spark, a[::-1])).count() == 0
    assert merkle.audit(frame(spark, []), frame(spark, [])).count() == 0
    assert merkle.audit(frame(spark, a[:5]), frame(spark, [])).filter("status = 'missing'").count() == 5


def test_roots_depend_on_place_and_content(spark):
    one = merkle.tree(merkle.leaves(frame(spark, [("f", 0, "a"), ("f", 1, "b")])))[-1].first()["hash"]
    two = merkle.tree(merkle.leaves(frame(spark, [("f", 0, "b"), ("f", 1, "a")])))[-1].first()["hash"]
    leaf = "0:1:" + sha("a") + ":1,1:1:" + sha("b") + ":1"
    root = sha(leaf)
    for _ in merkle.LEVELS[1:]:
        root = sha("0:" + root)
    assert one == root != two
