"""Suffix-array dedup against a brute-force version."""

import random

import numpy as np
import pytest

from llm_fixtures import docs_frame
from sigfolio.llm import suffix_dedup as sd


def brute(rows, width=50):
    """(id, n_bytes, n_removed, n_spans, kept) of every row, by definition."""
    first = {}
    texts = [((t or "").encode(), float("inf") if d is None else d) for d, t in rows]
    for t, d in texts:
        for s in range(len(t) - width + 1):
            w = t[s:s + width]
            first[w] = min(d, first.get(w, d))
    out = []
    for (d, _), (t, o) in zip(rows, texts):
        gone = [False] * len(t)
        for s in range(len(t) - width + 1):
            if first[t[s:s + width]] < o:
                gone[s:s + width] = [True] * width
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, kept))
    return sorted(out, key=repr)


def corpus(seed, n=90):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(rng.randint(6, 40)) for _ in range(8)] + ["ab" * 60, "a" * 120, "x" * 49, "y" * 50]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.4 else prose(rng.randint(0, 25)) for _ in range(rng.randint(0, 6))]
        rows.append((i, rng.choice(["", " ", "\n"]).join(parts)))
    rows += [(200 + i, rng.choice(rows)[1]) for i in range(20)]
    rows += [(None, rows[3][1]), (None, rows[4][1] + passages[0]), (7, rows[9][1]), rows[11], (300, None), (301, ""), (302, passages[1])]
    rng.shuffle(rows)
    return rows


def collect(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in df.collect()), key=repr)


@pytest.mark.parametrize("hot", [sd.HOT_TEXTS, 3])
def test_matches_brute_force(spark, monkeypatch, hot):
    rows = corpus(hot)
    monkeypatch.setattr(sd, "HOT_TEXTS", hot)
    monkeypatch.setattr(sd, "PACK_BYTES", 700)
    monkeypatch.setattr(sd, "BLOCK_BYTES", 500)
    monkeypatch.setattr(sd, "SLICE_BYTES", 400)
    assert collect(sd.dedup(docs_frame(spark, rows), group_bytes=4000, bucket_bytes=3000)) == brute(rows)


def test_whole_chars_stay_utf8(spark):
    rows = corpus(5)
    exact = {r["doc_id"]: r for r in sd.dedup(docs_frame(spark, rows)).filter("doc_id < 200").collect()}
    for r in sd.dedup(docs_frame(spark, rows), whole_chars=True).filter("doc_id < 200").collect():
        bytes(r["kept"]).decode()
        assert 0 <= exact[r["doc_id"]]["n_removed"] - r["n_removed"] <= 6 * exact[r["doc_id"]]["n_spans"]


def test_longest_previous_factor_is_exact():
    rng = random.Random(1)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(50, 76))).encode() for _ in range(40)]
    strings += [s[:30] + strings[0][:35] for s in strings[:10]]
    data = np.frombuffer(b"".join(strings), np.uint8)
    ends = np.cumsum([len(s) for s in strings])
    starts, order = [], []
    for k, s in enumerate(strings):
        for p in range(len(s) - 49):
            starts.append(ends[k] - len(s) + p)
            order.append(rng.randrange(12) if p == 0 else order[-1])
    starts, order = np.array(starts), np.array(order)
    got = sd.longest_previous(data, starts, order, 50)
    raw = data.tobytes()
    for i in range(len(starts)):
        best = 0
        for j in range(len(starts)):
            if order[j] < order[i]:
                a, b = raw[starts[i]:starts[i] + 50], raw[starts[j]:starts[j] + 50]
                best = max(best, next((k for k in range(50) if a[k] != b[k]), 50))
        assert got[i] == best


def test_every_window_has_its_string():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abc ") for _ in range(rng.randint(0, 400))) for _ in range(20)]
    for size in (sd.SLICE_BYTES, 100):
        parts = list(sd.window_strings(texts, slice_bytes=size))
        seen = sorted(base + p + k for base, _, at, count, _, _ in parts for p, c in zip(at, count) for k in range(c))
        check_windows(texts, seen)
        assert all((count <= 50 - sd.GRAM + 1).all() for _, _, _, count, _, _ in parts)


def check_windows(texts, seen):
    ends, want = 0, []
    for t in texts:
        want += range(ends, ends + max(0, len(t) - 49))
        ends += len(t)
    assert seen == want


def test_cover_and_whole_characters():
    rng = np.random.default_rng(0)
    starts = rng.random(1000) < 0.01
    want = np.array([starts[max(0, i - 49):i + 1].any() for i in range(1000)])
    assert all((sd.cover(starts, 50, n) == want).all() for n in (1 << 18, 64, 1))
    raw = np.frombuffer("aé中😀b".encode() * 20, np.uint8)
    drop = rng.random(len(raw)) < 0.8
    kept = raw[~sd.whole(raw, drop)].tobytes().decode()
    at, want = 0, ""
    for c in "aé中😀b" * 20:
        n = len(c.encode())
        want += "" if drop[at:at + n].all() else c
        at += n
    assert kept == want


def test_empty_table(spark):
    assert sd.dedup(docs_frame(spark, [])).count() == 0


def test_groups_and_buckets_have_parts_of_their_own(spark):
    from pyspark.sql import functions as F
    for n in (12, 113):
        names = sd.bucket_names(spark, n)
        assert len(set(names.tolist())) == n
        rows = spark.createDataFrame([(int(x),) for x in names], "bucket int").repartition(n, "bucket")
        assert rows.groupBy(F.spark_partition_id()).count().count() == n

