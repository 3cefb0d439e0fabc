"""Fixity audit of archive replicas by Merkle trees.

A record is hashed with its place; records of one range of offsets make a
node, ranges make wider ranges, up to one root per file.  Replicas whose
roots agree are done.  Below a root that differs, only the children of
differing nodes are compared, level by level, down to the records.

Nodes are keyed by (file, range), so a file that holds a third of all records
is many groups; a node has at most 256 children, and a lowest range RANGE
bytes of one file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigfolio.llm.common import cut_lineage

#: Bits of an offset that a node of each level leaves out; the last is the root.
LEVELS = (16, 24, 32, 40, 48, 63)
RANGE = 1 << LEVELS[0]


def leaves(records: DataFrame, file: str = "file", offset: str = "offset", payload: str = "payload") -> DataFrame:
    """(file, offset, length, hash, copies) of distinct records with a place."""
    return (records.select(F.col(file).cast("string").alias("file"), F.col(offset).cast("long").alias("offset"),
                           F.octet_length(payload).cast("long").alias("length"), F.sha2(F.col(payload), 256).alias("hash"))
            .groupBy("file", "offset", "length", "hash").agg(F.count(F.lit(1)).alias("copies")))


def joined(parts: Column) -> Column:
    """Hash of sorted (key, text) pairs."""
    return F.sha2(F.concat_ws(",", F.transform(F.sort_array(parts), lambda p: F.concat_ws(":", p["key"].cast("string"), p["text"]))), 256)


def tree(records: DataFrame) -> list[DataFrame]:
    """(file, node, hash) of every level, from the lowest ranges to the roots."""
    text = F.concat_ws(":", F.coalesce(F.col("length").cast("string"), F.lit("-")), F.coalesce("hash", F.lit("-")), F.col("copies").cast("string"))
    level = (records.filter("file IS NOT NULL AND offset IS NOT NULL")
             .groupBy("file", F.shiftright("offset", LEVELS[0]).alias("node"))
             .agg(joined(F.collect_list(F.struct(F.col("offset").alias("key"), text.alias("text")))).alias("hash")))
    out = [cut_lineage(level, "merkle")]
    for low, high in zip(LEVELS, LEVELS[1:]):
        below = out[-1]
        level = (below.groupBy("file", F.shiftright("node", high - low).alias("up"))
                 .agg(joined(F.collect_list(F.struct(F.col("node").alias("key"), F.col("hash").alias("text")))).alias("hash"))
                 .withColumnRenamed("up", "node"))
        out.append(cut_lineage(level, "merkle"))
    return out


def differing(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose hashes differ or that one side lacks."""
    return (a.select(*keys, F.col("hash").alias("left")).join(b.select(*keys, F.col("hash").alias("right")), keys, "full_outer")
            .filter(~F.col("left").eqNullSafe(F.col("right"))))


def audit(primary: DataFrame, replica: DataFrame, file: str = "file", offset: str = "offset", payload: str = "payload") -> DataFrame:
    """One row per record that differs: file, offset, length and expected
    hash (primary), actual hash (replica), status (altered, missing, extra,
    unplaced) and both roots of the file.

    Records with a NULL file or offset have no place in a tree: they are
    reported as unplaced with their hash, on whichever side they are.  A NULL
    payload differs from an empty one and equals another NULL.  Repeated
    records count: another number of copies is a difference.  Several records
    at one place are told apart by their hashes.  Other columns take no part;
    two empty tables give no rows.
    """
    sides = [cut_lineage(leaves(r, file, offset, payload), "leaves") for r in (primary, replica)]
    trees = [tree(s) for s in sides]
    roots = reduce(lambda x, y: x.join(y, "file", "full_outer"),
                   [t[-1].select("file", F.col("hash").alias(n)) for t, n in zip(trees, ("primary_root", "replica_root"))])
    bad = differing(trees[0][-1], trees[1][-1], ["file", "node"]).select("file", "node")
    for level in range(len(LEVELS) - 2, -1, -1):
        step = LEVELS[level + 1] - LEVELS[level]
        up = bad.withColumnRenamed("node", "up")
        below = [t[level].withColumn("up", F.shiftright("node", step)).join(up, ["file", "up"], "left_semi") for t in trees]
        bad = cut_lineage(differing(*below, ["file", "node"]).select("file", "node"), "descent")
    found = [s.withColumn("node", F.shiftright("offset", LEVELS[0])).join(bad, ["file", "node"], "left_semi") for s in sides]
    none = F.lit("-")
    left = found[0].select("file", "offset", "length", F.col("hash").alias("expected"), F.col("copies").alias("n"), F.coalesce("hash", none).alias("h"))
    right = found[1].select("file", "offset", F.col("length").alias("its_length"), F.col("hash").alias("actual"), F.col("copies").alias("m"), F.coalesce("hash", none).alias("h"))
    # the same record on both sides in other numbers, then what only one side has
    pairs = left.join(right, ["file", "offset", "h"], "full_outer").filter(~F.col("n").eqNullSafe(F.col("m")))
    gone = pairs.filter("m IS NULL").select("file", "offset", "length", "expected")
    new = pairs.filter("n IS NULL").select("file", "offset", F.col("its_length"), "actual")
    counted = pairs.filter("n IS NOT NULL AND m IS NOT NULL").select("file", "offset", "length", "expected", "actual", F.lit("altered").alias("status"))
    changed = gone.join(new, ["file", "offset"], "full_outer").select(
        "file", "offset", F.coalesce("length", "its_length").alias("length"), "expected", "actual",
        F.when(F.col("its_length").isNull() & F.col("actual").isNull(), "missing")
        .when(F.col("length").isNull() & F.col("expected").isNull(), "extra").otherwise("altered").alias("status"))
    empty = F.lit(None).cast("string")
    adrift = [s.filter("file IS NULL OR offset IS NULL").select(
        "file", "offset", "length", (F.col("hash") if k == 0 else empty).alias("expected"), (F.col("hash") if k else empty).alias("actual"),
        F.lit("unplaced").alias("status")) for k, s in enumerate(sides)]
    return counted.unionByName(changed).unionByName(adrift[0]).unionByName(adrift[1]).join(roots, "file", "left")
