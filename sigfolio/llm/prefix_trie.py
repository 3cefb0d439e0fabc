"""Prefix trie of conversations with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns.  It is known by (smallest
member, depth), which no two nodes share, and found by a 128-bit digest of its
turns.  The digests of a conversation come from blocks of ``BLOCK`` turns, and
blocks of blocks, so a conversation of any length is spread over tasks.

Subtree totals come from rounds over the live tree:

* compress: nodes with at most one live child that follow each other within
  one label and one block of depths become the lowest of them; the label is
  the longest member, which is the same all along a chain;
* rake: leaves give their totals to their parents and leave.

A compressed node's total is its representative's minus what lies above it in
the run, so the rounds are undone from the last to the first by one join each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigfolio.llm.common import cut_lineage

BLOCK = 256
#: Turns of one conversation that one row of a join partner serves.
SPAN = 4096
#: A parent with more than one in HOT of all nodes as children is looked up by
#: broadcast: there are fewer than HOT of those.
HOT = 1024
#: Characters of a piece of a list of ids.
PIECE = 65536
#: Rounds that are undone in one plan.
UNDO = 6
KEY_BYTES = 16
ROOT = hashlib.sha256(b"").digest()[:KEY_BYTES]


def _key(*parts: bytes) -> bytes:
    return hashlib.sha256(b"".join(parts)).digest()[:KEY_BYTES]


# ------------------------------------------------------------- turns

def number_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """conv, i (0, 1, ... in each conversation by turn, NULL first), digest of
    (role, text) and n_bytes of the text.

    NULL roles and texts are empty; turns of equal number go by role, then by
    digest; repeated rows are turns of their own; rows without a conversation
    id belong to none and are left out; extra columns take no part.  Rows are
    sorted over all conversations together, so a long one spans many tasks.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = df.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    ).filter(F.col("conv").isNotNull())
    by = ["conv", "turn", "role", "digest"]
    # rows equal in all of them are alike: any place among them will do
    placed = (rows.withColumn("any", F.monotonically_increasing_id()).repartitionByRange(*by, "any").sortWithinPartitions(*by)
              .select("conv", "digest", "n_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            conv = b.column("conv").to_numpy()
            start = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            idx = np.arange(n) - np.repeat(start, np.diff(np.r_[start, n]))
            if last == conv[0]:
                idx[:start[1] if len(start) > 1 else n] += seen
            last, seen = conv[-1], int(idx[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [b.column("conv"), b.column("digest"), b.column("n_bytes"), pa.array(np.full(n, part, "i4")), pa.array(idx)],
                names=["conv", "digest", "n_bytes", "part", "idx"])

    turns = cut_lineage(placed.mapInArrow(run, "conv long, digest binary, n_bytes long, part int, idx long"), "trie-turns")
    counts = turns.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")
    # only a partition's first conversation can have begun before it: at most one row for each partition
    later = counts.select("conv", "part", before.alias("before")).filter(F.col("before") > 0)
    return (turns.join(F.broadcast(later), ["conv", "part"], "left")
            .select("conv", (F.col("idx") + F.coalesce("before", F.lit(0))).alias("i"), "digest", "n_bytes"))


def mixed(turns: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Each conversation c rebuilt as the first h turns of conversation
    c - c % ``group`` (all if fewer, none if it is absent) and c's own turns
    after its first h; h = crc32(decimal c) % ``most``.

    Returns (turns: conv, d from 1, digest, n_bytes; convs: conv, length).
    """
    taken = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(most))
    sizes = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    bases = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = cut_lineage(
        sizes.withColumn("h", taken).withColumn("base", F.col("conv") - F.col("conv") % F.lit(group))
        .join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0))))
        .select("conv", "base", "h", "m", "n", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")),
        "trie-convs")
    # a base serves at most `group` conversations, and of each only its first turns
    heads = (turns.filter(F.col("i") < most).withColumnRenamed("conv", "base").join(convs.select("conv", "base", "m"), "base")
             .filter(F.col("i") < F.col("m")).select("conv", (F.col("i") + 1).alias("d"), "digest", "n_bytes"))
    # turns move where the base has too few; a row here serves SPAN turns
    moves = (convs.filter((F.col("m") < F.col("h")) & (F.col("n") > F.col("h")))
             .select("conv", (F.col("h") - F.col("m")).alias("back"),
                     F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("n") / SPAN).cast("long"))).alias("span")))
    tails = (turns.filter(F.col("i") >= taken).withColumn("span", F.floor(F.col("i") / SPAN).cast("long"))
             .join(moves, ["conv", "span"], "left")
             .select("conv", (F.col("i") + 1 - F.coalesce("back", F.lit(0))).alias("d"), "digest", "n_bytes"))
    return heads.unionByName(tails), convs.select("conv", "length")


# ------------------------------------------------------------ digests

def _chain(rows: DataFrame, names: list[str]) -> DataFrame:
    """Of each block (conv, seed, next, items) a row per item: its index, the
    key before it, the key up to it, n_bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = [], [], [], [], []
            for r in batch.to_pylist():
                at, digests = r["seed"] or ROOT, [x["digest"] for x in r["items"]]
                for j, x in enumerate(r["items"]):
                    key = _key(at, x["digest"])
                    if j == BLOCK - 1:
                        key = r["next"] or _key(r["seed"] or ROOT, _key(*digests))
                    for c, v in zip(out, (r["conv"], x["k"], at, key, x["n_bytes"])):
                        c.append(v)
                    at = key
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()))], names=names)

    kinds = ("long", "long", "binary", "binary", "long")
    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def _whole(rows: DataFrame) -> DataFrame:
    """The digest of each block (conv, b, items)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [_key(*(x["digest"] for x in items)) for items in batch.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("b"), pa.array(digests, pa.binary())],
                                             names=["conv", "k", "digest"])

    return rows.select("conv", "b", "items").mapInArrow(run, "conv long, k long, digest binary").withColumn("n_bytes", F.lit(0).cast("long"))


def prefix_keys(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv, d, parent (key of the first d - 1 turns), key, n_bytes.

    ``turns``: conv, d, digest, n_bytes.  Key 256 of a block is the block's
    own, which the level above works out, so no task follows a conversation
    from end to end.
    """
    longest = convs.agg(F.max("length")).first()[0] or 0
    levels, items = [], turns.select("conv", (F.col("d") - 1).alias("k"), "digest", "n_bytes")
    while True:
        blocks = items.groupBy("conv", F.floor(F.col("k") / BLOCK).alias("b")).agg(
            F.sort_array(F.collect_list(F.struct("k", "digest", "n_bytes"))).alias("items"))
        longest = -(-longest // BLOCK)
        if longest <= 1:
            levels.append(blocks)
            break
        levels.append(blocks := cut_lineage(blocks, "trie-blocks"))
        long = blocks.filter(F.col("b") > 0).select("conv").distinct()
        items = _whole(blocks.join(long, "conv", "left_semi"))
    seeds = None
    for blocks in reversed(levels):
        if seeds is None:
            rows = blocks.withColumn("seed", F.lit(None).cast("binary")).withColumn("next", F.lit(None).cast("binary"))
        else:
            rows = blocks.join(seeds.select("conv", "b", "seed", "next"), ["conv", "b"], "left")
        last = blocks is levels[0]
        seeds = _chain(rows.select("conv", "seed", "next", "items"),
                       ["conv", "k", "parent", "key", "n_bytes"] if last else ["conv", "b", "seed", "next", "n_bytes"])
    return seeds.select("conv", (F.col("k") + 1).alias("d"), "parent", "key", "n_bytes")


# ---------------------------------------------------------- contraction

ID = ["conv", "depth"]
UP = ["up_conv", "up_depth"]
VALUES = ["leaves", "saved"]


def _compress(live: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Runs of nodes with at most one child each become their lowest node.

    Returns (records: id, rep_conv, rep_depth, what to take from the
    representative's total; the live tree after it).  A group has one label
    and ``width`` depths.
    """
    group = Window.partitionBy("label", "block").orderBy("depth")
    follows = (F.lag("conv").over(group) == F.col("up_conv")) & (F.lag("depth").over(group) == F.col("up_depth"))
    run = Window.partitionBy("label", "block", "run").orderBy("depth")
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = (live.filter(F.col("n") <= 1).withColumn("block", F.floor(F.col("depth") / width))
            .withColumn("head", F.when(follows, 0).otherwise(1))
            .withColumn("run", F.sum("head").over(group)))
    runs = runs.select(
        *ID, "label", "n", F.first("up_conv").over(whole).alias("up_conv"), F.first("up_depth").over(whole).alias("up_depth"),
        F.last("conv").over(whole).alias("rep_conv"), F.last("depth").over(whole).alias("rep_depth"),
        F.count(F.lit(1)).over(whole).alias("size"),
        *(F.sum(v).over(whole).alias(v) for v in VALUES),
        *((F.sum(v).over(run) - F.col(v)).alias(f"{v}_above") for v in VALUES))
    runs = cut_lineage(runs, "trie-runs")
    records = runs.filter(F.col("size") > 1).select(*ID, "rep_conv", "rep_depth", *(f"{v}_above" for v in VALUES))
    kept = runs.filter((F.col("conv") == F.col("rep_conv")) & (F.col("depth") == F.col("rep_depth")))
    columns = [*ID, *UP, "label", "n", *VALUES]
    return records, live.filter(F.col("n") > 1).select(columns).unionByName(kept.select(columns))


def _rake(live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves leave; returns (their totals, the live tree after it)."""
    leaf = (F.col("n") == 0) & F.col("up_conv").isNotNull()
    raked = live.filter(leaf)
    given = raked.groupBy(*UP).agg(F.count(F.lit(1)).alias("gone"), *(F.sum(v).alias(f"{v}_in") for v in VALUES))
    given = given.withColumnsRenamed(dict(zip(UP, ID)))
    rest = live.filter(~leaf).join(given, ID, "left").select(
        *ID, *UP, "label", (F.col("n") - F.coalesce("gone", F.lit(0))).alias("n"),
        *((F.col(v) + F.coalesce(f"{v}_in", F.lit(0))).alias(v) for v in VALUES))
    return raked.select(*ID, *VALUES), rest


def subtree_totals(live: DataFrame, cut: Callable[[DataFrame, str], DataFrame] = cut_lineage) -> DataFrame:
    """conv, depth and the sums of ``leaves`` and ``saved`` over the subtree.

    ``live``: a tree's nodes (conv, depth, up_conv, up_depth, label, n live
    children, leaves, saved).  Every round removes each chain at whose lower
    end nothing branches any more.
    """
    deepest = live.agg(F.max("depth")).first()[0] or 0
    widths = [BLOCK]
    while widths[-1] <= deepest:
        widths.append(widths[-1] * BLOCK)
    undo = []
    while live.count() > 1:
        steps = []
        for width in widths:
            records, live = _compress(live, width)
            steps.append(records)
        live = cut(live, "trie-compressed")
        raked, rest = _rake(live)
        undo.append((steps, raked))
        live = cut(rest, "trie-live")
    known = live.select(*ID, *VALUES)
    for k, (steps, raked) in enumerate(reversed(undo), 1):
        known = known.unionByName(raked)
        for records in reversed(steps):
            r = records.withColumnsRenamed({"conv": "own_conv", "depth": "own_depth", "rep_conv": "conv", "rep_depth": "depth"})
            known = known.join(r, ID, "left").select(
                F.coalesce("own_conv", "conv").alias("conv"), F.coalesce("own_depth", "depth").alias("depth"),
                *((F.col(v) - F.coalesce(f"{v}_above", F.lit(0))).alias(v) for v in VALUES))
        if k % UNDO == 0:
            known = cut(known, "trie-known")
    return known


# --------------------------------------------------------------- lists

def joined_ids(ends: DataFrame) -> DataFrame:
    """key, ends_sha256: digest of the key's conversation ids, ascending and
    comma-joined.  ``ends``: key, conv.

    Ids are joined to pieces where a sort over all of them has put them, so
    what one task hashes is a few strings, taken one at a time.
    """
    placed = ends.select("key", "conv").repartitionByRange("conv").sortWithinPartitions("key", "conv")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, size, key, k = TaskContext.get().partitionId(), [], 0, None, 0
        names = ["key", "part", "piece", "ids"]

        def row(rows: list[tuple]) -> pa.RecordBatch:
            cols = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int64(), pa.string()))], names=names)

        for b in batches:
            done = []
            for x, c in zip(b.column("key").to_pylist(), map(str, b.column("conv").to_pylist())):
                if held and (x != key or size > PIECE):
                    done.append((key, part, k, ",".join(held)))
                    held, size, k = [], 0, k + 1
                key = x
                held.append(c)
                size += len(c) + 1
            if done:
                yield row(done)
        if held:
            yield row([(key, part, k, ",".join(held))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            done = []
            for x, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
                if x != key:
                    if sha:
                        done.append((key, sha.hexdigest()))
                    key, sha = x, hashlib.sha256(ids.encode())
                else:
                    sha.update(b",")
                    sha.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["key", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], names=["key", "ends_sha256"])

    cut = placed.mapInArrow(pieces, "key binary, part int, piece long, ids string")
    return (cut.repartition("key").sortWithinPartitions("key", "part", "piece").select("key", "ids")
            .mapInArrow(hashed, "key binary, ends_sha256 string"))


# ---------------------------------------------------------------- trie

def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id
    (NULL at the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, turn_bytes.

    ``turns``: conv, d (1, 2, ... without gaps), digest, n_bytes; ``convs``:
    conv, length (0: only in the root).  No conversations give no rows.
    """
    keys = cut_lineage(prefix_keys(turns, convs), "trie-keys")
    long = convs.withColumn("label", F.shiftleft(F.least("length", F.lit((1 << 20) - 1)), 42)
                            .bitwiseOR(F.xxhash64("conv").bitwiseAND(F.lit((1 << 42) - 1))))
    ends = keys.join(convs.withColumnRenamed("length", "d"), ["conv", "d"], "left_semi").select("key", "conv").unionByName(
        convs.filter(F.col("length") == 0).select(F.lit(ROOT).alias("key"), "conv"))
    ends = cut_lineage(ends, "trie-ends")
    labels = _labels(keys, long)
    root = long.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv"), F.max("label").alias("label")).filter("n_convs > 0").select(
        F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("n_bytes"), "n_convs", "conv", "label")
    nodes = labels.groupBy("key", "parent", F.col("d").alias("depth"), "n_bytes").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv"), F.max("label").alias("label"))
    nodes = cut_lineage(nodes.unionByName(root), "trie-nodes")
    kids = nodes.filter(F.col("depth") > 0).groupBy("parent").agg(F.count(F.lit(1)).alias("n"))
    kids = cut_lineage(kids.withColumnRenamed("parent", "key"), "trie-kids")
    linked = cut_lineage(_with_parent(nodes, kids), "trie-linked")
    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    totals = subtree_totals(linked.select(
        *ID, *UP, "label", "n", F.when(F.col("n") == 0, 1).otherwise(0).cast("long").alias("leaves"), saved.alias("saved")))
    return (linked.join(totals.withColumnsRenamed({v: f"all_{v}" for v in VALUES}), ID).join(joined_ids(ends), "key", "left")
            .select(F.col("conv").alias("conv_id"), "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", F.col("n").alias("n_children"),
                    F.col("all_leaves").alias("n_leaves"), F.col("all_saved").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.col("n_bytes").alias("turn_bytes")))


def _labels(keys: DataFrame, long: DataFrame) -> DataFrame:
    """The prefixes with their conversation's label; a row of the right side
    serves SPAN turns."""
    spans = long.select("conv", "label", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / SPAN).cast("long"))).alias("span"))
    return keys.withColumn("span", F.floor(F.col("d") / SPAN).cast("long")).join(spans, ["conv", "span"])


def _with_parent(nodes: DataFrame, kids: DataFrame) -> DataFrame:
    """Nodes with n (children) and the id of their parent."""
    few = F.broadcast(kids.filter(F.col("n") > F.lit(max(nodes.count(), 1) / HOT)).select("key"))
    own = nodes.join(kids, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    place = nodes.select(F.col("key").alias("parent"), F.col("conv").alias("up_conv"), F.col("depth").alias("up_depth"))
    hot = F.broadcast(place.join(few.withColumnRenamed("key", "parent"), "parent", "left_semi"))  # fewer than HOT rows
    near = own.join(hot, "parent", "left")
    rest = own.join(few.withColumnRenamed("key", "parent"), "parent", "left_anti").join(place, "parent", "left")
    return near.filter(F.col("up_conv").isNotNull()).unionByName(rest)
