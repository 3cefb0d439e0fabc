"""Shards by vector bin packing.

A group of equal texts is a vector of bytes, tokens and rows.  Groups are
placed, largest first, into the shard where the dot product of their vector
with the shard's residual capacity is highest.

Packing looks at a bounded number of items at every size of the input:

* a group with more than 1 / (shards x FINE) of the bytes, tokens or rows is
  an item of its own (there are at most 3 x shards x FINE of those);
* a group larger than a whole shard cannot stay together: its rows go, by a
  hash of the id, to pieces of about a quarter of a shard;
* all smaller groups are bundled by a hash of their text into BUNDLES items.

Only these items meet in one place; rows are dealt by joins with the item
table, and slots come from ranks within (item, part) plus summed counts, so
no task holds a shard.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigfolio.llm.common import cut_lineage

FINE = 64
BUNDLES = 4096
#: A group over one shard's share is split into pieces of 1 / PIECES shard.
PIECES = 4
#: Parts of an item in which slots are ranked.
PARTS = 16
OVERHEAD = 8
MEASURES = ("size", "tokens", "rows")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document; the text is read here only."""
    text = F.col(text_col).cast("string")
    known = F.coalesce(text, F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(known) + OVERHEAD).cast("long").alias("size"),
        F.regexp_count(known, F.lit(r"\S+")).cast("long").alias("tokens"), F.lit(1).cast("long").alias("rows"),
        F.crc32(known).alias("text_crc32"), F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("group"))


def spread(column: Column, n: int, salt: int) -> Column:
    return F.pmod(F.xxhash64(column, F.lit(salt)), F.lit(n))


def pack(items: list[tuple], shards: int) -> dict[str, int]:
    """Item -> shard.  ``items``: (name, size, tokens, rows), a bounded list.

    Ties go to the item whose name sorts first and to the lower shard.
    """
    if not items:
        return {}
    items = sorted(items, key=lambda x: x[0])
    load = np.array([x[1:] for x in items], float)
    load /= np.maximum(load.sum(axis=0), 1)
    residual = np.full((shards, load.shape[1]), 1 / shards)
    out = {}
    for k in sorted(range(len(items)), key=lambda k: (-load[k].max(), k)):
        s = int(np.argmax(residual @ load[k]))
        residual[s] -= load[k]
        out[items[k][0]] = s
    return out


def assign(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, size, tokens, text_crc32, shard and slot (gapless from
    0 in each shard, in an order that only the data decide).

    NULL and empty texts have size 8 and are two groups; repeated rows are
    rows of one group and take a slot each (which of them takes which is not
    told apart); NULL ids are packed as others; extra columns take no part;
    an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = cut_lineage(measure(docs, id_col, text_col), "shard-rows")
    groups = rows.groupBy("group").agg(*(F.sum(m).alias(m) for m in MEASURES))
    total = rows.agg(*(F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in MEASURES)).first()
    share = F.greatest(*(F.col(m) / F.lit(float(max(total[m], 1))) for m in MEASURES))
    # at most 3 x shards x FINE groups can be this large, so they may be broadcast
    large = (groups.withColumn("share", share).filter(F.col("share") > 1 / (shards * FINE))
             .select("group", F.when(F.col("share") > 1 / shards, F.ceil(F.col("share") * shards * PIECES)).otherwise(F.lit(1)).alias("pieces")))
    named = (rows.join(F.broadcast(large), "group", "left")
             .withColumn("item", F.when(F.col("pieces").isNull(), F.concat(F.lit("b"), spread(F.col("group"), BUNDLES, 1)))
                         .otherwise(F.concat(F.lit("g"), F.hex("group"), F.lit("."), F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("pieces")))))
             .withColumn("part", spread(F.col("doc_id"), PARTS, 3))
             .drop("pieces"))
    named = cut_lineage(named, "shard-items")
    items = named.groupBy("item").agg(*(F.sum(m).alias(m) for m in MEASURES))
    placed = pack([(r["item"], r["size"], r["tokens"], r["rows"]) for r in items.collect()], shards)
    where = spark.createDataFrame(sorted(placed.items()), "item string, shard int")
    parts = named.groupBy("item", "part").agg(F.sum("rows").alias("n")).join(F.broadcast(where), "item")
    before = Window.partitionBy("shard").orderBy("item", "part")
    start = parts.withColumn("start", F.sum("n").over(before) - F.col("n")).select("item", "part", "shard", "start")
    rank = F.row_number().over(Window.partitionBy("item", "part").orderBy("doc_id", "group"))
    # items x PARTS rows: the same proven bound
    return (named.withColumn("rank", rank).join(F.broadcast(start), ["item", "part"])
            .select("doc_id", "size", "tokens", "text_crc32", "shard", (F.col("start") + F.col("rank") - 1).alias("slot")))
