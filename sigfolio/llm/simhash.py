"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit
segments.  The Manhattan distance of two embeddings never exceeds the number
of differing bits.  Counts are written in unary (0, 01, 11), so the embedding
is again 64 bits and its Manhattan distance a population count.

Range join on a grid: the segments are cut into ``max_bits + EQUAL`` blocks.
Vectors within ``max_bits`` differ in at most ``max_bits`` blocks, so they
share all counts of some ``EQUAL`` blocks: each such choice of blocks with its
counts is a grid cell.  Fingerprints that share a cell are held against the
Manhattan bound and then against the fingerprints themselves.

Only distinct fingerprints take part, so copies never meet.  Within a cell
only a spanning forest of the links is kept, never all pairs.  Cells of over
``CHUNK`` fingerprints are cut into chunks and their pairs of chunks spread
over tasks; no row is dropped or capped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigfolio.llm.common import cut_lineage, fresh_name, map_rows, row_key, text_of
from sigfolio.llm.components import components

SEED = 42
SEGMENTS = 32
EQUAL = 3
CHUNK = 2048
PIECE = 1 << 20
SPACE = re.compile(rb"[ \t-\r]")


def pieces(data: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """Words of a text, some ``size`` bytes of it at a time."""
    at = 0
    while at < len(data):
        m = SPACE.search(data, at + size)
        end = m.start() if m else len(data)
        yield data[at:end].split()
        at = end


def fingerprint(text: str, shingle: int = 4, size: int = PIECE) -> int:
    """64 majority bits of the XXH64 hashes of the text's word shingles."""
    import xxhash

    digest, ones, n, carry = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for words in pieces(text.encode().lower(), size):
        words = carry + words
        carry = words[max(0, len(words) - shingle + 1):] if len(words) >= shingle else words
        if len(words) < shingle:
            continue
        joined = b" ".join(words)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens + 1) - 1
        starts = (ends - lens)[:len(words) - shingle + 1].tolist()
        h = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())]
        n += len(h)
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    if not n:
        if not carry:
            return 0
        return digest(b" ".join(carry), SEED)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and key (``carry``) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), (F.lit("") if carry is None else carry).cast("string").alias("key"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps), batch.column("key")], names=["doc_id", "fp", "key"])

    return map_rows(rows, run, f"doc_id {rows.schema['id'].dataType.simpleString()}, fp long, key string")


def embed(fp: Column) -> Column:
    """Bit counts of the two-bit segments, in unary."""
    odd = F.lit(0x5555555555555555)
    above = F.shiftrightunsigned(fp, 1)
    return F.shiftleft(fp.bitwiseAND(above).bitwiseAND(odd), 1).bitwiseOR(fp.bitwiseOR(above).bitwiseAND(odd))


def embed_array(fp: np.ndarray) -> np.ndarray:
    odd, one = np.uint64(0x5555555555555555), np.uint64(1)
    return ((fp & (fp >> one) & odd) << one) | ((fp | (fp >> one)) & odd)


def cell_masks(max_bits: int, equal: int = EQUAL) -> list[int]:
    """For each choice of ``equal`` of the blocks, the bits of their segments
    as a signed 64-bit number."""
    n = max_bits + equal
    bounds = [2 * (SEGMENTS * k // n) for k in range(n + 1)]
    blocks = [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(bounds, bounds[1:])]
    masks = [sum(c) for c in combinations(blocks, equal)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    """Manhattan bound of the embeddings first, then the differing bits."""
    keep = np.flatnonzero(np.bitwise_count(embed_array(a) ^ embed_array(b)) <= max_bits)
    return keep[np.bitwise_count(a[keep] ^ b[keep]) <= max_bits]


class Forest:
    """Union-find that keeps the links that joined two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = int(up[i])
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:  # pairs that already hang together are skipped in bulk
            flat = self.up[self.up]
            if (flat == self.up).all():
                break
            self.up = flat
        new = np.flatnonzero(self.up[a] != self.up[b])
        for i, j in zip(a[new].tolist(), b[new].tolist()):
            r, s = self.root(i), self.root(j)
            if r != s:
                self.up[max(r, s)] = min(r, s)
                self.links.append((i, j))


def links_in_runs(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among neighbours with equal keys (sorted); runs are at
    most CHUNK long, so there are fewer than CHUNK lags."""
    forest, at, lag = Forest(len(keys)), np.arange(len(keys)), 1
    while True:
        at = at[:np.searchsorted(at, len(keys) - lag)]
        at = at[keys[at] == keys[at + lag]]
        if not len(at):
            break
        ok = at[near(fps[at], fps[at + lag], max_bits)]
        forest.join(ok, ok + lag)
        lag += 1
    pairs = np.array(forest.links, np.int64).reshape(-1, 2)
    return fps[pairs[:, 0]], fps[pairs[:, 1]]


def links(fps: DataFrame, max_bits: int, equal: int = EQUAL, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links at ``max_bits`` or fewer differing bits among the distinct
    fingerprints ``fp``, enough of them to hold every group together."""
    cells = (fps.select("fp", embed(F.col("fp")).alias("e"))
             .select("fp", F.explode(F.array(*(F.xxhash64(F.lit(k), F.col("e").bitwiseAND(F.lit(m))) for k, m in enumerate(cell_masks(max_bits, equal))))).alias("cell")))
    # equal cells come one after the other; a hash of the cell deals them out
    dealt = cells.select("cell", "fp").repartition("cell").sortWithinPartitions("cell", "fp")

    def batch(a=(), b=(), cell=(), number=(), members=()) -> pa.RecordBatch:
        n, m = len(a), len(cell)
        none = [None] * m
        return pa.RecordBatch.from_arrays(
            [pa.array([*np.asarray(a, np.uint64).view(np.int64).tolist(), *none], pa.int64()),
             pa.array([*np.asarray(b, np.uint64).view(np.int64).tolist(), *none], pa.int64()),
             pa.array([None] * n + list(cell), pa.int64()), pa.array([None] * n + list(number), pa.int32()),
             pa.array([None] * n + list(members), pa.binary())], names=["a", "b", "cell", "number", "members"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, hot, number = 0, None, 0  # hot: the cell whose chunks are being handed on
        stream = iter(batches)
        while True:
            got = next(stream, None)
            if got is not None:
                held.append((got.column("cell").to_numpy(), got.column("fp").to_numpy().view(np.uint64)))
                size += got.num_rows
                if size < 16 * chunk:
                    continue
            if not held:
                return
            keys, own = (np.concatenate(x) for x in zip(*held))
            held, size = [], 0
            edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.array([], int)
            ends = np.r_[edges[1:], len(keys)].astype(int)
            at, out_cell, out_number, out_members = 0, [], [], []
            parts = np.zeros(len(keys), np.int64)  # chunk of a large run that a row is in
            stop = len(keys)
            for s, e in zip(edges.tolist(), ends.tolist()):
                open_end = got is not None and e == len(keys)
                large = e - s > chunk or hot == keys[s]
                if not large:
                    if open_end:
                        stop = s
                    continue
                if hot != keys[s]:
                    hot, number = int(keys[s]), 0
                at = s
                while e - at > (chunk if open_end else 0):
                    to = min(e, at + chunk)
                    parts[at:to] = number
                    out_cell.append(int(keys[s]))
                    out_number.append(number)
                    out_members.append(own[at:to].astype("<u8").tobytes())
                    number, at = number + 1, to
                if open_end:
                    stop = at
            held, size = [(keys[stop:], own[stop:])], len(keys) - stop
            keys, own, parts = keys[:stop], own[:stop], parts[:stop]
            same = np.cumsum(np.r_[0, (keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])]) if len(keys) else keys
            a, b = links_in_runs(same, own, max_bits)
            yield batch(a, b, out_cell, out_number, out_members)
            if got is None:
                return

    found = dealt.mapInArrow(within, "a long, b long, cell long, number int, members binary")
    found = cut_lineage(found, "cells")
    chunks = found.filter(F.col("cell").isNotNull()).select("cell", "number", "members")
    crossing = (chunks.alias("x").join(chunks.alias("y"), F.expr("x.cell = y.cell AND x.number < y.number"))
                .select(F.col("x.members").alias("left"), F.col("y.members").alias("right"))
                .repartition(F.xxhash64("left", "right")))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for left, right in zip(rows.column("left").to_pylist(), rows.column("right").to_pylist()):
                x, y = np.frombuffer(left, "<u8"), np.frombuffer(right, "<u8")
                forest, own, there = Forest(len(x) + len(y)), np.concatenate([x, y]), np.arange(len(y))
                for i in range(len(x)):
                    ok = there[near(np.broadcast_to(x[i], y.shape), y, max_bits)]
                    forest.join(np.full(len(ok), i), ok + len(x))
                pairs = np.array(forest.links, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(own[pairs[:, k]].view(np.int64)) for k in (0, 1)], names=["a", "b"])

    return (found.filter(F.col("cell").isNull()).select("a", "b")
            .unionByName(map_rows(crossing, across, "a long, b long")))


def components_of(marked: DataFrame, max_bits: int, equal: int = EQUAL, chunk: int = CHUNK) -> DataFrame:
    """(fp, root, component_id) of every distinct fingerprint of ``marked``:
    root names its component, component_id is the smallest doc_id in it."""
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), max_bits, equal, chunk))
    classes = (distinct.join(roots, distinct["fp"] == roots["node"], "left")
               .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    classes = cut_lineage(classes, "classes")
    smallest = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    return classes.join(smallest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, equal: int = EQUAL, chunk: int = CHUNK,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fp (signed long) and component_id, the smallest doc_id
    that links of at most ``max_bits`` differing bits reach.

    NULL and empty texts have fingerprint 0 and link like any other; repeated
    rows share everything; a NULL id gets its group's smallest id (NULL where
    the group has none); other columns take no part; an empty table gives no
    rows.
    """
    marked = cut_lineage(fingerprints(docs, shingle, id_col, text_col).drop("key"), "fingerprints")
    return marked.join(components_of(marked, max_bits, equal, chunk), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each component one row of ``docs``, with all its columns: the one
    with the smallest id (a NULL id only where the group has no other).  Of
    rows with that id and one text, the one whose other columns come first as
    JSON stays; columns may have any names."""
    key = row_key(id_col, text_col)
    marked = cut_lineage(fingerprints(docs, shingle, id_col, text_col, key), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("key")))
    by_print = marked.groupBy("fp").agg(first.alias("first"))  # copies meet as partial minima
    chosen = (by_print.join(components_of(marked, max_bits), "fp").groupBy("root").agg(F.min("first").alias("first"))
              .select(F.col("first.key").alias("__chosen")))
    mine, row, kept = (fresh_name(docs, x) for x in ("mine", "row", "chosen"))
    rows = docs.withColumn(mine, key).join(chosen.withColumnRenamed("__chosen", kept), F.col(mine) == F.col(kept), "left_semi")
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    first_row = F.to_json(F.struct(*others)) if others else F.lit("")
    return rows.groupBy(mine).agg(F.min_by(F.struct(*docs.columns), first_row).alias(row)).select(f"{row}.*")


def as_hex(fp: Column) -> Column:
    """16 lowercase hex digits."""
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
