"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations.

A document is contaminated by a benchmark item if WINDOW tokens in a row of
the document equal, position by position, WINDOW tokens in a row of the item
with at most ERRORS substitutions.  Each mask is a set of token positions
that are hashed while the others are ignored; the masks are lossless: however
the substitutions fall in a window, some mask at some place misses them all
(``is_lossless`` proves it by trying every case).

An item shorter than the window is a seed as a whole and must be met exactly.

The hashes of all places of the documents first meet two tables of hash
buckets of the benchmark.  A table has at most BUCKETS rows whatever the
benchmark's size, which is the proven bound of its broadcast; it lets through
every true hit.  What is left is joined on the whole hash, salted, with a
shuffle, and each hit is verified around its place.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigfolio.llm.common import fresh_name, row_key, text_of

WINDOW = 13
ERRORS = 2
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
SPAN = 8
#: Shorter items (a word or a few) say nothing about where a text comes from.
LEAST = 5
BUCKETS = 1 << 20
SALTS = 8
#: Tokens before and after a mask's span that a window through it may reach.
REACH = WINDOW - SPAN
TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def is_lossless(masks=MASKS, window: int = WINDOW, errors: int = ERRORS) -> bool:
    return all(any(not bad.intersection(o + m for m in mask) for mask in masks for o in range(window - max(mask)))
               for bad in (set(c) for c in combinations(range(window), errors)))


def tokens(text_col: str = "text") -> Column:
    """Runs of letters and digits of the lower-cased whole text."""
    return F.array_remove(F.split(F.lower(text_of(text_col)), TOKEN_BREAK), "")


def padded(words: Column) -> Column:
    none = F.array_repeat(F.lit(None).cast("string"), REACH)
    return F.concat(none, words, none)


def seeds(rows: DataFrame, key: str) -> DataFrame:
    """(key, words, place, h): the hash of each mask at each place.  ``words``
    is padded by REACH NULLs on either side; ``place`` counts without them."""
    at = F.posexplode(F.slice("words", REACH + 1, F.greatest(F.size("words") - F.lit(2 * REACH + SPAN - 1), F.lit(0)))).alias("place", "first")
    placed = rows.select(key, "words", at)
    word = lambda k: F.col("first") if k == 0 else F.get(F.col("words"), F.col("place") + F.lit(REACH + k))
    hashes = F.array(*(F.xxhash64(F.lit(n), *(word(k) for k in mask)) for n, mask in enumerate(MASKS)))
    return placed.select(key, "words", "place", F.explode(hashes).alias("h"))


def around() -> Column:
    """The tokens that windows through this place can reach."""
    return F.slice("words", F.col("place") + 1, SPAN + 2 * REACH)


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, token): every verified window of a document, by its
    first token's number (from 0), with the item that it overlaps."""
    there = items.select(F.col(item_col).alias("item_id"), padded(tokens(text_col)).alias("words"))
    known = seeds(there, "item_id").select("item_id", "h", around().alias("known"))
    low, high = F.pmod(F.col("h"), F.lit(BUCKETS)), F.pmod(F.shiftright("h", 24), F.lit(BUCKETS))
    here = docs.select(F.col(id_col).alias("doc_id"), padded(tokens(text_col)).alias("words"))
    places = seeds(here, "doc_id").withColumn("low", low).withColumn("high", high)
    # at most BUCKETS rows each
    for name, bucket in (("low", low), ("high", high)):
        places = places.join(F.broadcast(known.select(bucket.alias(name)).distinct()), name, "left_semi")
    places = places.select("doc_id", "place", "h", around().alias("seen"), F.pmod(F.xxhash64("doc_id", "place"), F.lit(SALTS)).alias("salt"))
    known = known.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS))))).withColumn("salt", F.col("salt").cast("long"))
    met = places.join(known, ["h", "salt"])
    same = F.zip_with("seen", "known", lambda x, y: F.when(x.isNull() | y.isNull(), F.lit(-WINDOW)).when(x == y, F.lit(1)).otherwise(F.lit(0)))
    good = F.filter(F.sequence(F.lit(0), F.lit(REACH)), lambda s: F.aggregate(
        F.slice(F.col("same"), s + 1, WINDOW), F.lit(0), lambda a, b: a + b) >= WINDOW - ERRORS)
    long = (met.select("doc_id", "item_id", "place", same.alias("same"))
            .select("doc_id", "item_id", "place", F.explode(good).alias("start"))
            .select("doc_id", "item_id", (F.col("place") - REACH + F.col("start")).alias("token")))
    return long.unionByName(short_hits(docs, items, id_col, item_col, text_col))


def short_hits(docs: DataFrame, items: DataFrame, id_col: str, item_col: str, text_col: str) -> DataFrame:
    """(doc_id, item_id, token): where a document has a whole item of LEAST
    to WINDOW - 1 tokens, word for word.  The seed is the whole item; only
    lengths that some item has are hashed, so without short items the
    documents are not even cut into tokens."""
    short = (items.select(F.col(item_col).alias("item_id"), tokens(text_col).alias("item"))
             .filter(F.size("item").between(LEAST, WINDOW - 1)).withColumn("h", F.xxhash64("item")))
    lengths = short.agg(F.collect_set(F.size("item"))).scalar()  # fewer than WINDOW numbers
    here = docs.filter(F.size(lengths) > 0).select(F.col(id_col).alias("doc_id"), tokens(text_col).alias("words"), lengths.alias("lengths"))
    places = here.select("doc_id", "words", "lengths", F.posexplode("words").alias("token", "first"))
    fits = F.filter("lengths", lambda n: F.col("token") + n <= F.size("words"))
    runs = F.transform(fits, lambda n: F.slice(F.col("words"), F.col("token") + 1, n))
    found = places.select("doc_id", "token", F.explode(runs).alias("seen")).withColumn("h", F.xxhash64("seen"))
    low, high = F.pmod(F.col("h"), F.lit(BUCKETS)), F.pmod(F.shiftright("h", 24), F.lit(BUCKETS))
    # at most BUCKETS rows each
    for name, bucket in (("low", low), ("high", high)):
        found = found.withColumn(name, bucket).join(F.broadcast(short.select(bucket.alias(name)).distinct()), name, "left_semi").drop(name)
    found = found.withColumn("salt", F.pmod(F.xxhash64("doc_id", "token"), F.lit(SALTS)))
    short = short.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return (found.join(short, ["h", "salt"]).filter(F.col("seen") == F.col("item"))
            .select("doc_id", "item_id", F.col("token").cast("int").alias("token")))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, contaminated, n_items (distinct items met), n_windows
    (distinct windows and items), first_item (smallest) and first_token.

    An item of LEAST to WINDOW - 1 tokens is met where a document has all of
    it, word for word (one window).  Shorter, NULL and empty items meet
    nothing; a NULL or empty text is clean; a very long one is judged whole.  A NULL
    doc_id is told by its NULL; rows of one doc_id are judged together;
    repeated items change nothing; an item with a NULL id is not counted;
    other columns take no part; empty tables give no rows or clean ones.
    """
    found = hits(docs, items.filter(F.col(item_col).isNotNull()), id_col, item_col, text_col)
    per_item = (found.groupBy("doc_id", "item_id", "token").agg(F.lit(1).alias("one"))
                .groupBy("doc_id", "item_id").agg(F.count("one").alias("windows"), F.min("token").alias("token")))
    per_doc = per_item.groupBy(F.col("doc_id").alias("hit_id")).agg(
        F.count("item_id").alias("n_items"), F.sum("windows").alias("n_windows"),
        F.min("item_id").alias("first_item"), F.min("token").alias("first_token"))
    own = docs.select(F.col(id_col).alias("doc_id"))
    return (own.join(per_doc, own["doc_id"].eqNullSafe(F.col("hit_id")), "left")
            .select("doc_id", F.col("n_items").isNotNull().alias("contaminated"),
                    F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_windows", F.lit(0)).alias("n_windows"),
                    "first_item", F.col("first_token").cast("int").alias("first_token")))


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not contaminated.

    Each row is judged by itself, whatever its id: an anti-join by a digest
    of id and text with the (few) contaminated rows.  NULL and empty texts
    stay; columns may have any names.
    """
    mine, bad = fresh_name(docs, "mine"), fresh_name(docs, "bad")
    rows = docs.withColumn(mine, row_key(id_col, text_col))
    found = hits(rows, items.filter(F.col(item_col).isNotNull()), mine, item_col, text_col)
    return rows.join(found.select(F.col("doc_id").alias(bad)).distinct(), F.col(mine) == F.col(bad), "left_anti").drop(mine)
