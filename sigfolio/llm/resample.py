"""Importance resampling towards a target distribution of hashed features.

Features are runs of one to ``grams`` consecutive words, hashed into buckets.
A bucket's gain compares its share in the target's texts with its share in the
documents; a document's weight is the mean gain of its features, and a random
draw without replacement takes the documents with the highest weight plus
Gumbel noise.

The texts are read twice, once to count and once to score, each time in numpy
over the bytes of many texts; the gains are one array of fixed size.  The k
highest scores are found by distributed quickselect over the narrow table of
scores: random pivots, exact counts of the keys below, at and above each, and
on with the one interval that holds the k-th.  Only the winners are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigfolio.llm.common import cut_lineage, map_rows, text_of

#: Pivots of a round.
PIVOTS = 15
#: Bytes of text worked on at once.
CHUNK = 1 << 22
#: Words of more bytes are hashed one by one.
LONG_WORD = 64

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype("u1")
#: Digits, letters and all bytes of characters beyond ASCII.
IN_WORD = ((LOWER >= 0x30) & (LOWER <= 0x39)) | ((LOWER >= 0x61) & (LOWER <= 0x7A)) | (LOWER >= 0x80)


def crc_table() -> np.ndarray:
    c = np.arange(256, dtype="u4")
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype("u4")
    return c


CRC = crc_table()


def extend(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 states after the bytes data[start:start + size] of each."""
    order = np.argsort(-np.minimum(size, LONG_WORD + 1), kind="stable")
    out, at, left = state[order], start[order], size[order]
    long = int(np.searchsorted(-left, -LONG_WORD, "left"))
    for k in range(long):
        out[k] = zlib.crc32(data[at[k]:at[k] + left[k]].tobytes(), int(out[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    n, ends = len(out), np.searchsorted(-left[long:], -np.arange(LONG_WORD + 1), "left") + long
    for j in range(LONG_WORD):
        n = int(ends[j])  # those with more than j bytes
        if n <= long:
            break
        s = out[long:n]
        out[long:n] = CRC[(s ^ data[at[long:n] + j]) & 0xFF] ^ (s >> 8)
    done = np.empty_like(out)
    done[order] = out
    return done


def pieces(text: bytes, grams: int, size: int | None = None) -> Iterator[tuple[bytes, int]]:
    """A long text some ``size`` bytes at a time, cut between words; from the
    second piece on with the ``grams`` - 1 words before it, and their number."""
    at, before, size = 0, b"", size or CHUNK
    data = np.frombuffer(text, "u1")
    while len(text) - at > size:
        gap = at + size
        while gap < len(text) and not len(found := np.flatnonzero(~IN_WORD[data[gap:gap + size]])):
            gap += size
        if gap >= len(text):
            break
        gap += int(found[0])
        piece = before + text[at:gap]
        yield piece, len(before.split())
        before, at = b"".join(w + b" " for w in _last_words(piece, grams - 1)), gap
    yield before + text[at:], len(before.split())


def _last_words(text: bytes, n: int) -> list[bytes]:
    out: list[bytes] = []
    end = len(text)
    data = np.frombuffer(text, "u1")
    while len(out) < n and end:
        while end and not IN_WORD[data[end - 1]]:
            end -= 1
        start = end
        while start and IN_WORD[data[start - 1]]:
            start -= 1
        if start < end:
            out.insert(0, text[start:end])
        end = start
    return out


def features(texts: list[bytes], grams: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per group of texts or pieces: (place of the text, number of words),
    as two arrays in one, and of each feature the text's place and bucket."""
    group, total = [], 0
    for k, text in enumerate(texts):
        for piece, known in pieces(text, grams):
            group.append((k, piece, known))
            total += len(piece)
            if total >= CHUNK:
                yield _features(group, grams, buckets)
                group, total = [], 0
    if group:
        yield _features(group, grams, buckets)


def _features(group: list[tuple[int, bytes, int]], grams: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = LOWER[np.frombuffer(b"\0".join(p for _, p, _ in group) + b"\0", "u1")]
    inside = np.r_[False, IN_WORD[data]]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, size = edges[::2], edges[1::2] - edges[::2]
    bounds = np.cumsum([0] + [len(p) + 1 for _, p, _ in group])
    piece = np.searchsorted(bounds, start, "right") - 1
    places, known = np.array([k for k, _, _ in group]), np.array([n for _, _, n in group])
    nth = np.arange(len(start)) - np.searchsorted(piece, piece, "left")
    fresh = nth >= known[piece]  # not a word repeated from the piece before
    state = extend(np.full(len(start), 0xFFFFFFFF, "u4"), data, start, size)
    owner, bucket = [places[piece[fresh]]], [(state[fresh] ^ np.uint32(0xFFFFFFFF)) % buckets]
    for g in range(2, grams + 1):
        m = max(len(start) - g + 1, 0)
        with_space = CRC[(state[:m] ^ np.uint32(0x20)) & 0xFF] ^ (state[:m] >> 8)
        state = extend(with_space, data, start[g - 1:], size[g - 1:])
        ok = (piece[:m] == piece[g - 1:]) & fresh[g - 1:]
        owner.append(places[piece[:m][ok]])
        bucket.append((state[ok] ^ np.uint32(0xFFFFFFFF)) % buckets)
    return places[piece[fresh]], np.concatenate(owner), np.concatenate(bucket).astype("i8")


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def bucket_counts(df: DataFrame, grams: int = 2, buckets: int = 10_000, text_col: str = "text") -> np.ndarray:
    """Features of all texts in each bucket: one array, whatever the input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, "i8")
        for b in batches:
            for _, _, bucket in features(_bytes(b), grams, buckets):
                counts += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    found = map_rows(df.select(text_of(text_col).alias("text")), run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, "i8")
    for r in found:  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed shares' ratio) of each bucket."""
    s_all, t_all, n = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n))))
                     for s, t in zip(source.tolist(), target.tolist())], "i8")


def weigh(docs: DataFrame, gain: np.ndarray, grams: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain; 0 without
    features), row (a number that no other row has)."""
    known = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for b in batches:
            n = b.num_rows
            words, count, total = np.zeros(n, "i8"), np.zeros(n, "i8"), np.zeros(n, "i8")
            for word_owner, owner, bucket in features(_bytes(b), grams, len(known.value)):
                words += np.bincount(word_owner, minlength=n)
                count += np.bincount(owner, minlength=n)
                np.add.at(total, owner, known.value[bucket])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *map(pa.array, (words, count, np.where(count, total // np.maximum(count, 1), 0), np.arange(first, first + n)))],
                names=["doc_id", "n_words", "n_features", "weight", "row"])
            first += n

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return map_rows(rows, run, "doc_id long, n_words long, n_features long, weight long, row long")


def noise(seed: int) -> Column:
    """floor(1000 x Gumbel noise) from sha256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


#: The order of a draw: highest score, smaller id (NULL last), fewer features;
#: rows alike in all of these are told apart by their number.
def sort_key() -> Column:
    return F.struct((-F.col("score")).alias("a"), F.col("doc_id").isNull().cast("long").alias("b"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("c"),
                    F.col("n_features").alias("d"), F.col("row").alias("e"))


def _literal(key) -> Column:
    return F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip("abcde", key)))


def select_kth(keys: DataFrame, k: int, pivots: int = PIVOTS):
    """The k-th smallest (from 1) ``key`` of a table of distinct keys.

    Each round draws ``pivots`` random keys of the interval that holds the
    answer and counts the keys below and at each of them.
    """
    low = high = None
    before, seed = 0, 0
    while True:
        inside = keys
        if low is not None:
            inside = inside.filter((F.col("score") <= -low["a"]) & (F.col("key") > _literal(low)))
        if high is not None:
            inside = inside.filter((F.col("score") >= -high["a"]) & (F.col("key") < _literal(high)))
        drawn = sorted({r["key"] for r in inside.orderBy(F.xxhash64("row", F.lit(seed))).select("key").limit(pivots).collect()})
        counts = inside.agg(*(F.count_if(F.col("key") < _literal(p)).alias(f"below{j}") for j, p in enumerate(drawn)),
                            *(F.count_if(F.col("key") == _literal(p)).alias(f"at{j}") for j, p in enumerate(drawn))).first()
        start = before
        for j, p in enumerate(drawn):
            below, at = start + counts[f"below{j}"], counts[f"at{j}"]
            if below < k <= below + at:
                return p
            if below >= k:
                high = p
                break
            low, before = p, below + at
        seed += 1


def draw(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, grams: int = 2, buckets: int = 10_000,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_features, weight, score, n_words, rank; rank (1, 2,
    ... by falling score) only of the ``percent`` of the rows with at least
    ``min_words`` words that are drawn.

    NULL and empty texts have no features, weight 0, and are never drawn;
    repeated rows take part one by one; NULL ids share the noise of an empty
    id and come last among equal scores; very long texts are worked on in
    parts; extra columns take no part; empty tables give no rows or, as
    target, gains from smoothing alone.
    """
    gain = gains(bucket_counts(docs, grams, buckets, text_col), bucket_counts(target, grams, buckets, text_col))
    scored = cut_lineage(weigh(docs, gain, grams, id_col, text_col).withColumn("score", F.col("weight") + noise(seed)), "resample-scores")
    able = F.col("n_words") >= min_words
    k = percent * scored.filter(able).count() // 100
    columns = ["doc_id", "n_features", "weight", "score", "n_words"]
    if not k:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    last = select_kth(scored.filter(able).select("score", "row", sort_key().alias("key")), k)
    won = able & (sort_key() <= _literal(last))
    lost = scored.filter(~won).withColumn("rank", F.lit(None).cast("long"))
    return lost.unionByName(ranked(scored.filter(won))).select(*columns, "rank")


def ranked(winners: DataFrame) -> DataFrame:
    """Rows with their rank in the draw's order: sorted into ranges, numbered
    inside each, plus the rows of the ranges before (one count per range)."""
    by = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("row")]
    placed = winners.repartitionByRange(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first = TaskContext.get().partitionId(), 1
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, "i4")), pa.array(np.arange(first, first + n))],
                                             names=[*b.schema.names, "part", "nth"])
            first += n

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in winners.schema)
    numbered = cut_lineage(placed.mapInArrow(run, f"{kinds}, part int, nth long"), "resample-winners")
    sizes = {r["part"]: r["n"] for r in numbered.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per range
    before, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, before))
        before += sizes[part]
    base = winners.sparkSession.createDataFrame(rows, "part int, before long")
    return numbered.join(F.broadcast(base), "part").withColumn("rank", F.col("before") + F.col("nth")).drop("part", "nth", "before")
