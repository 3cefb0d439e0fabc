"""Spaced seeds against brute force over all aligned windows."""

import random
import re

import pytest

from llm_fixtures import docs_frame
from sigfolio.llm import decontaminate as dc


def words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def brute(rows, items):
    out = {}
    for d, t in rows:
        w, found = words(t), {}
        for i, x in {(i, x) for i, x in items if i is not None}:
            v = words(x)
            for s in range(len(w) - 12):
                for p in range(len(v) - 12):
                    if sum(a == b for a, b in zip(w[s:s + 13], v[p:p + 13])) >= 11:
                        found.setdefault(i, set()).add(s)
            if 5 <= len(v) < 13:
                for s in range(len(w) - len(v) + 1):
                    if w[s:s + len(v)] == v:
                        found.setdefault(i, set()).add(s)
        old = out.setdefault(d, {})
        for i, s in found.items():
            old.setdefault(i, set()).update(s)
    return {d: (bool(f), len(f), sum(map(len, f.values())), min(f, default=None), min((min(s) for s in f.values()), default=None)) for d, f in out.items()}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "naïve", "X"]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, prose(rng.randint(8, 40))) for i in range(12)]
    rows = []
    for d in range(80):
        w = prose(rng.randint(0, 60))
        if rng.random() < 0.5:
            src = list(rng.choice(items)[1])
            a = rng.randint(0, max(0, len(src) - 13))
            src = src[a:a + rng.randint(11, 30)]
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                src[rng.randrange(len(src))] = "zz"
            at = rng.randint(0, len(w))
            w = w[:at] + src + w[at:]
        rows.append((d, rng.choice([" ", ", ", "\n"]).join(w)))
    items = [(i, " ".join(x)) for i, x in items]
    return rows + [(500, None), (501, ""), rows[3], (None, rows[4][1])], items + [(50, None), (51, ""), items[2], (None, items[3][1])]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows, items = corpus(seed)
    b = spark.createDataFrame([(i, t, "x", "y") for i, t in items], "item_id long, text string, words string, known string")
    got = dc.contamination(docs_frame(spark, rows), b).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in rows)
    want = brute(rows, items)
    for r in got:
        assert tuple(r)[1:] == want[r["doc_id"]]
    clean = sorted(str(r["doc_id"]) for r in dc.keep_clean(docs_frame(spark, rows), b).collect())
    assert clean == sorted(str(d) for d, t in rows if not brute([(d, t)], items)[d][0])


def test_masks_are_lossless():
    assert dc.is_lossless() and not dc.is_lossless(errors=4)
    assert max(max(m) for m in dc.MASKS) + 1 == dc.SPAN


def test_nothing(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r) for r in dc.contamination(docs_frame(spark, [(1, "a b")]), empty).collect()] == [(1, False, 0, 0, None, None)]
    assert dc.contamination(docs_frame(spark, []), empty).count() == 0


def test_no_python_in_the_plan(spark):
    b = spark.createDataFrame([(1, "a " * 20)], "item_id long, text string")
    plan = dc.contamination(docs_frame(spark, [(1, "b")]), b)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_short_items_word_for_word(spark):
    """A short question copied whole is found, a changed one is not, and items
    of a word or a few meet nothing."""
    rows = [(1, "Well: What is the capital of a small, far country? Who knows."), (2, "What is the capital of a large, far country?"),
            (3, "Yes."), (4, "what is the capital of a small far"), (5, "a b c d e f a b c d e"), (6, "中文 什么 是 首都 吗"), (7, None)]
    items = [(10, "What is the capital of a small far country"), (11, "Yes"), (12, "a b c d"), (13, "a b c d e"), (14, "中文 什么 是 首都 吗")]
    got = dc.contamination(docs_frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    by = {r["doc_id"]: tuple(r)[1:] for r in got}
    assert by == {1: (True, 1, 1, 10, 1), 2: (False, 0, 0, None, None), 3: (False, 0, 0, None, None), 4: (False, 0, 0, None, None),
                  5: (True, 1, 2, 13, 0), 6: (True, 1, 1, 14, 0), 7: (False, 0, 0, None, None)}
    assert sorted(r["doc_id"] for r in dc.keep_clean(docs_frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()) == [2, 3, 4, 7]
