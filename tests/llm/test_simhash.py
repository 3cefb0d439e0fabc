"""SimHash near-duplicates against a brute-force version."""

import random
import re

import numpy as np
import pytest
import xxhash

from llm_fixtures import docs_frame
from sigfolio.llm import simhash
from sigfolio.llm.components import components


def brute_fp(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h)) if h else 0


def brute_components(rows, bits):
    fp = [brute_fp(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= bits:
                up[max(root(i), root(j))] = min(root(i), root(j))
    ids = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            ids[root(i)] = min(d, ids.get(root(i), d))
    return sorted((str(d), f"{fp[i]:016x}", ids.get(root(i))) for i, (d, _) in enumerate(rows))


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(200)] + ["É", "Über", "A", "B"]
    base = [[rng.choice(vocab) for _ in range(rng.randint(1, 90))] for _ in range(n // 4)]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((i * 3, rng.choice([" ", "  ", "\t", "\n"]).join(words)))
    return rows + [(1, None), (2, ""), (4, " \n"), (None, rows[5][1]), (None, "only here and nowhere else at all"), rows[7]]


@pytest.mark.parametrize("chunk", [simhash.CHUNK, 4])
def test_components_match_brute_force(spark, chunk):
    rows = corpus(chunk)
    got = simhash.near_duplicates(docs_frame(spark, rows), chunk=chunk).select("doc_id", simhash.as_hex("fp").alias("h"), "component_id").collect()
    assert sorted((str(r[0]), r[1], r[2]) for r in got) == brute_components(rows, 4)


def test_large_cell_is_cut_into_chunks_without_losing_a_link(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 400:  # many fingerprints around one: they share cells
        fps.add(rng.choice(sorted(fps)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    far = {rng.getrandbits(64) for _ in range(50)}
    all_fps = sorted(fps | far)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in all_fps], "fp long")
    links = simhash.links(df, 4, chunk=16)
    roots = {r["node"] % (1 << 64): r["root"] for r in components(links).collect()}
    up = {f: f for f in all_fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f

    for a in all_fps:
        for b in all_fps:
            if a < b and (a ^ b).bit_count() <= 4:
                up[root(b)] = root(a)
    for a in all_fps:
        for b in all_fps:
            together = a in roots and roots.get(a) == roots.get(b)
            assert a == b or together == (root(a) == root(b))
    assert links.count() < 40 * len(all_fps)  # spanning links, not all pairs


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 1 << 63, 2000, dtype=np.uint64) for _ in range(2))
    low = np.bitwise_count(simhash.embed_array(a) ^ simhash.embed_array(b))
    counts = lambda x: np.stack([np.bitwise_count(x >> np.uint64(2 * k) & np.uint64(3)) for k in range(32)]).astype(int)
    assert (low == np.abs(counts(a) - counts(b)).sum(axis=0)).all()
    assert (low <= np.bitwise_count(a ^ b)).all()


def test_long_text_in_pieces_gives_the_same_fingerprint():
    text = " ".join(random.Random(5).choice(["aa", "Bb", "cc", "d"]) for _ in range(5000))
    assert simhash.fingerprint(text, size=100) == simhash.fingerprint(text) == brute_fp(text)


def test_empty_table(spark):
    assert simhash.near_duplicates(docs_frame(spark, [])).count() == 0
