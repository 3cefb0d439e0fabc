"""Importance resampling against a plain version, and the selection alone."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm_fixtures import docs_frame
from sigfolio.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def buckets(text):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def plain(rows, target, percent=25, min_words=20):
    s, t = (Counter(b for x in texts for b in buckets(x)[1]) for texts in ([x for _, x in rows], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in rows:
        n, found = buckets(text)
        g = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in found]
        weight = sum(g) // len(g) if g else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n, None])
    able = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(able[:percent * len(able) // 100], 1):
        r[5] = k
    return sorted(map(tuple, out), key=repr)


def drawn(docs, target, **more):
    return sorted(map(tuple, resample.draw(docs, target, **more).select("doc_id", "n_features", "weight", "score", "n_words", "rank").collect()), key=repr)


def some_rows(n=300):
    rng = random.Random(3)
    words = ["Alpha", "beta", "GAMMA9", "дом", "x_y", "東京", "o'clock", "İ", "a\x00b", "q" * 70, "ü" * 50]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(n)]
    return [*rows, (n, None), (n + 1, ""), (None, "beta " * 30), (None, "beta " * 30), *rows[:20], (5, "beta gamma " * 40), (n + 2, "w" * 200_000)]


def test_like_the_plain_version(spark):
    rows, target = some_rows(), ["alpha beta alpha beta", None, "", "дом 東京 " * 5]
    docs = docs_frame(spark, rows).repartition(5).withColumn("row", F.lit("x")).withColumn("weight", F.lit("x"))
    assert drawn(docs, spark.createDataFrame([(t,) for t in target], "text string")) == plain(rows, target)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(resample, "CHUNK", 64)
    rows = [(1, "Alpha beta, " * 400), (2, "one  two\n" * 30 + "z" * 500 + " three " * 20), (3, "." * 900), (4, "y" * 900), (5, None)]
    assert drawn(docs_frame(spark, rows), spark.createDataFrame([("alpha beta two",)], "text string"), percent=100) == plain(rows, ["alpha beta two"], 100)


@pytest.mark.parametrize("grams", [1, 2, 3])
def test_features_in_pieces_are_those_of_the_whole(monkeypatch, grams):
    text = " ".join(f"w{k % 13}" for k in range(400)).encode()
    whole = Counter(b for _, _, x in resample.features([text, b"", text], grams, 10_000) for b in x.tolist())
    monkeypatch.setattr(resample, "CHUNK", 50)
    cut = list(resample.features([text, b"", text], grams, 10_000))
    assert len(cut) > 5 and Counter(b for _, _, x in cut for b in x.tolist()) == whole
    assert sum(len(w) for w, _, _ in cut) == 800


def test_empty_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert drawn(docs_frame(spark, []), none) == []
    rows = [(1, "a " * 30), (2, "b " * 30)]
    assert drawn(docs_frame(spark, rows), none, percent=50) == plain(rows, [], 50)


@pytest.mark.parametrize("scores", [[5] * 2000, list(range(2000)), [k % 3 for k in range(2000)]])
def test_kth_key(spark, scores):
    rng = random.Random(1)
    rows = [(s, k // 2 if k % 5 else None, k % 4, k) for k, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "score long, doc_id long, n_features long, row long").select("score", "row", resample.sort_key().alias("key"))
    order = sorted((-s, d is None, d or 0, n, r) for s, d, n, r in rows)
    for k in (1, 2000, rng.randint(2, 1999)):
        assert tuple(resample.select_kth(df, k, pivots=4)) == order[k - 1]
