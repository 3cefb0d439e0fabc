"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if a string of ``width`` bytes that covers it also starts in a
document with a smaller id; what is left is the first copy.

Suffixes that can match are brought together by their minimiser, the k-gram
of least hash among those in a window of ``width`` bytes: equal windows have
equal minimisers.  The windows of a minimiser at one place form a string, the
unit that is sent.

1. Documents are packed into groups of some megabytes, a table bucketed by
   group, so later steps meet their texts without another shuffle of text.
   Whole copies of a text stand behind the copy with the smallest id.
2. Each group tells which minimisers it has; those that only one text has
   are dropped.
3. Each group sends every distinct string of the others once, with the
   smallest id that has it.  Minimisers of very many texts are sent window by
   window, by the hash of the window, so their strings spread over tasks.
4. In each bucket, the suffixes of the distinct strings are sorted to
   ``width`` bytes; the previous and the next suffix with a smaller id give
   the longest previous factor, and windows where it reaches ``width`` go.
5. Each group applies the answers to its texts.

Every step's memory is bounded by a group or bucket, whose number grows with
the bytes of the input; equal strings of a group are sent once, so a passage
that a third of all documents share makes one row per group.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigfolio.llm.common import cut_lineage, fresh_name, map_rows, row_key, small_batches, text_of
from sigfolio.session import own_table, scratch_path

WIDTH = 50
GRAM = 24
GROUP_BYTES = 8 << 20
BUCKET_BYTES = 8 << 20
#: Buckets of the table of packs, at most, and numbers tried for each to find its own.
MAX_BUCKETS = 20_000
SEARCH = 24
PACK_BYTES = 256 << 10
BLOCK_BYTES = 2 << 20
#: Texts are hashed this many bytes at a time, however long one is.
SLICE_BYTES = 256 << 10
#: A minimiser that more texts have is sent window by window.
HOT_TEXTS = 4096
SALTS = 16
#: Stands for a NULL id: after all others.
LAST = np.iinfo(np.int64).max

Batches = Iterator[pa.RecordBatch]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place, by doubling."""
    step, length, power = np.uint64(0x9E3779B97F4A7C15), 1, 0x9E3779B97F4A7C15
    doubled = data.astype(np.uint64) + np.uint64(1)
    out, done = None, 0
    while True:
        if k & length:  # append this length to what is hashed so far
            if out is None:
                out = doubled
            else:
                n = len(data) - done - length + 1
                out = out[:n] * np.uint64(power) + doubled[done:done + n]
            done += length
        if done == k:
            return mix(out * step)
        doubled = doubled[:-length] * np.uint64(power) + doubled[length:]
        power, length = power * power % (1 << 64), 2 * length


def slide(f, x: np.ndarray, w: int) -> np.ndarray:
    """f over every w neighbours."""
    length = 1
    while 2 * length <= w:
        x = f(x[:-length], x[length:])
        length *= 2
    return f(x[:len(x) - (w - length)], x[w - length:]) if w > length else x


def window_strings(texts: list[bytes], width: int = WIDTH, k: int = GRAM, slice_bytes: int = SLICE_BYTES) -> Iterator[tuple]:
    """Minimiser strings of some texts, laid end to end, a slice of them at a
    time: the slice's place and bytes and, per string, its first window's
    place in the slice, number of windows, minimiser hash and text number.

    A string is a run of windows with one least hash, cut after as many
    windows as a k-gram has places in one (a repeated k-gram could make
    longer runs) and where a slice ends.  Windows never cross texts.
    """
    every = np.frombuffer(b"".join(texts), np.uint8)
    ends, span = np.cumsum([len(t) for t in texts]), width - k + 1
    for base in range(0, len(every) - width + 1, slice_bytes):
        data = every[base:base + slice_bytes + width - 1]
        least = slide(np.minimum, gram_hashes(data, k) | np.uint64(1), span)
        for e in (ends[np.searchsorted(ends, base):np.searchsorted(ends, base + len(data))] - base).tolist():
            least[max(0, e - width + 1):e] = 0  # windows that reach over the end of a text
        first = np.r_[0, np.flatnonzero(least[1:] != least[:-1]) + 1]
        count = np.diff(np.r_[first, len(least)])
        h = least[first]
        some = h > 0
        first, count, h = first[some], count[some], h[some]
        n = -(-count // span)
        if len(n) and n.max() > 1:
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            first, h = np.repeat(first, n) + span * nth, np.repeat(h, n)
            count = np.minimum(span, np.repeat(count, n) - span * nth)
        if len(first):
            yield base, data, first, count, h, np.searchsorted(ends, first + base, side="right")


def longest_previous(data: np.ndarray, starts: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Longest previous factor, up to ``width`` bytes, of the suffixes at
    ``starts``: the longest common prefix with a suffix of smaller ``order``.

    The suffixes are sorted by their first ``width`` bytes, as words of eight;
    the previous and the next suffix of smaller order are found by pointer
    jumping; the longer of the two common prefixes is the answer.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(width + 8, np.uint8)])
    eight = np.zeros(n + width, np.uint64)
    for b in range(8):
        eight = (eight << np.uint64(8)) | padded[b:b + n + width]
    words = [eight[starts + at] for at in range(0, width, 8)]
    if width % 8:
        words[-1] = words[-1] >> np.uint64(64 - 8 * (width % 8)) << np.uint64(64 - 8 * (width % 8))
    suffix = np.lexsort((order, *words[::-1]))
    own, best = order[suffix], np.zeros(len(starts), np.int64)
    ends = np.r_[own, np.iinfo(np.int64).min]  # place -1: smaller than all
    for side in (-1, 1):
        near = np.arange(len(suffix)) + side
        near[near >= len(suffix)] = -1
        far = np.arange(len(suffix))
        while True:
            far = far[ends[near[far]] >= own[far]]
            if not len(far):
                break
            near[far] = near[near[far]]
        found = np.flatnonzero(near >= 0)
        a, b = suffix[found], suffix[near[found]]
        common, alike = np.full(len(found), width), np.arange(len(found))
        for k, w in enumerate(words):
            odd = w[a[alike]] ^ w[b[alike]]
            differ = np.flatnonzero(odd)
            same = np.zeros(len(differ), np.int64)
            for byte in range(1, 8):
                same += odd[differ] >> np.uint64(64 - 8 * byte) == 0
            common[alike[differ]] = 8 * k + same
            alike = alike[odd == 0]
        best[suffix[found]] = np.maximum(best[suffix[found]], np.minimum(common, width))
    return best


def squeeze(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(data)


def expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def group_numbers(spark: SparkSession, buckets: int) -> list[list[int]]:
    """For each of ``buckets`` some numbers that Spark deals to it, no two
    buckets having the same number: a group named by one has a bucket of its
    own.  At most SEARCH x MAX_BUCKETS rows."""
    found = spark.range(SEARCH * buckets).select(F.col("id").cast("int").alias("k"))
    out: list[list[int]] = [[] for _ in range(buckets)]
    for r in found.select("k", F.pmod(F.hash("k"), F.lit(buckets)).alias("b")).collect():
        out[r["b"]].append(r["k"])
    return [sorted(x) for x in out]


def bucket_names(spark: SparkSession, buckets: int) -> np.ndarray:
    """A number for each bucket under which a shuffle into as many parts deals
    it to a part of its own (beyond MAX_BUCKETS its own number, as it falls)."""
    if buckets > MAX_BUCKETS:
        return np.arange(buckets, dtype="i4")
    return np.array([x[0] if x else SEARCH * buckets + b for b, x in enumerate(group_numbers(spark, buckets))], "i4")


def pack_documents(rows: DataFrame, groups: int) -> DataFrame:
    """Table of packs (grp, first, ids, sizes, digests, blob), bucketed by
    ``grp`` and kept in the shared folder.  Groups have a bucket each (several
    share one beyond MAX_BUCKETS); repeated rows are dealt like others."""
    spark = rows.sparkSession
    buckets = min(groups, MAX_BUCKETS)
    numbers = group_numbers(spark, buckets)

    def run(batches: Batches) -> Batches:
        turn, own = divmod(TaskContext.get().partitionId(), buckets)
        grp = numbers[own][turn] if turn < len(numbers[own]) else SEARCH * buckets + turn * buckets + own
        first, ids, keys, texts, size = 0, [], [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "grp": pa.array([grp], pa.int32()), "first": pa.array([first], pa.int32()),
                "ids": pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                "sizes": pa.array([np.array([len(t) for t in texts], "<i8").tobytes()], pa.binary()),
                "digests": pa.array([b"".join(hashlib.md5(t).digest() for t in texts)], pa.binary()),
                "keys": pa.array([keys], pa.list_(pa.string())),
                "blob": pa.array([squeeze(b"".join(texts))], pa.binary())})

        for batch in batches:
            for i, key, t in zip(*(batch.column(c).to_pylist() for c in ("id", "key", "text"))):
                if texts and size + len(t) > PACK_BYTES:
                    yield out()
                    first += len(ids)
                    ids, keys, texts, size = [], [], [], 0
                ids.append(LAST if i is None else i)
                keys.append(key)
                texts.append(t)
                size += len(t)
        if texts:
            yield out()

    dealt = rows.withColumn("deal", F.xxhash64("id", F.monotonically_increasing_id())).repartition(groups, "deal").drop("deal")
    packs = map_rows(dealt, run,
                     "grp int, first int, ids binary, sizes binary, digests binary, keys array<string>, blob binary")
    name = f"packs_{uuid.uuid4().hex[:12]}"
    (packs.write.option("path", scratch_path(spark, "packs")).option("compression", "uncompressed")
     .bucketBy(buckets, "grp").saveAsTable(name))
    own_table(name)
    return spark.table(name)


def repeated(packs: DataFrame) -> DataFrame:
    """(grp, kind, data): by group, the numbers of the texts that a smaller id has whole."""
    def run(batches: Batches) -> Batches:
        for b in batches:
            for grp, first, ids, digests in zip(*(b.column(c).to_pylist() for c in ("grp", "first", "ids", "digests"))):
                ids = np.frombuffer(ids, "<i8")
                yield pa.RecordBatch.from_pydict({
                    "grp": pa.array([grp] * len(ids), pa.int32()), "number": pa.array(np.arange(first, first + len(ids)), pa.int32()),
                    "id": pa.array(ids), "digest": pa.array([digests[16 * k:16 * k + 16] for k in range(len(ids))], pa.binary())})

    texts = packs.select("grp", "first", "ids", "digests").mapInArrow(run, "grp int, number int, id long, digest binary")
    least = texts.groupBy("digest").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    # one text may have a third of all rows as its copies: they are dealt to SALTS parts
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    texts = texts.withColumn("salt", F.pmod(F.xxhash64("grp", "number"), F.lit(SALTS)).cast("int"))
    later = texts.join(least, ["digest", "salt"]).filter("id > least")
    return later.groupBy("grp").agg(F.concat_ws(",", F.collect_list(F.col("number").cast("string"))).cast("binary").alias("data")).select(
        "grp", F.lit("copies").alias("kind"), "data")


class Group:
    """The texts of one group and what the steps so far told it."""

    def __init__(self, packs: pa.Table, told: pa.Table):
        names = ("first", "ids", "sizes", "blob", *(["keys"] if "keys" in packs.column_names else []))
        rows = sorted(zip(*(packs.column(c).to_pylist() for c in names)), key=lambda r: r[0])
        self.packs, self.keys = [], {r[0]: r[4] for r in rows if len(r) > 4}
        for first, ids, sizes, blob, *_ in rows:
            ends = np.cumsum(np.frombuffer(sizes, "<i8")).tolist()
            data = expand(blob)
            self.packs.append((first, np.frombuffer(ids, "<i8"), [data[a:b] for a, b in zip([0, *ends], ends)]))
        heard: dict[str, list[bytes]] = {}
        for kind, data in zip(told.column("kind").to_pylist(), told.column("data").to_pylist()):
            heard.setdefault(kind, []).append(data)
        self.copies = {int(x) for d in heard.get("copies", ()) for x in d.split(b",")}
        shared = np.concatenate([np.array([], "<u8"), *(np.frombuffer(d, "<u8") for d in heard.get("shared", ()))])
        self.shared, self.hot = np.sort(shared & ~np.uint64(1)), np.sort(shared[(shared & np.uint64(1)) > 0] & ~np.uint64(1))
        self.answers = np.concatenate([np.zeros((0, 2), "<u4"), *(np.frombuffer(d, "<u4").reshape(-1, 2) for d in heard.get("answers", ()))])
        self.grp = (packs.column("grp").to_pylist() or [0])[0]

    def strings(self):
        """Per slice of a pack: its place in the group's texts, its bytes and
        the places, windows, hashes (even), ids and text numbers of its
        strings.  Whole copies are left out."""
        base = number = 0
        for first, ids, texts in self.packs:
            own = [b"" if first + k in self.copies else t for k, t in enumerate(texts)]
            for begin, data, at, count, h, owner in window_strings(own):
                yield base + begin, data, at, count, h & ~np.uint64(1), ids[owner], number + owner
            base += sum(map(len, own))
            number += len(own)

    def bytes(self) -> np.ndarray:
        """All texts but whole copies, end to end."""
        return np.frombuffer(b"".join(t for first, _, texts in self.packs for k, t in enumerate(texts) if first + k not in self.copies), np.uint8)

    def kept(self, h: np.ndarray, which: np.ndarray) -> np.ndarray:
        if not len(which):
            return np.zeros(len(h), bool)
        return which[np.minimum(np.searchsorted(which, h), len(which) - 1)] == h

    def units(self) -> Units:
        """The strings with shared minimisers, those of hot ones as single
        windows, numbered by the order of their hashes."""
        parts = []
        for base, data, at, count, h, ids, _ in self.strings():
            keep = self.kept(h, self.shared)
            at, count, h, ids = at[keep], count[keep], h[keep], ids[keep]
            hot = self.kept(h, self.hot)
            n = count[hot]
            each = np.repeat(at[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            cold = ~hot
            at, count = np.r_[at[cold], each], np.r_[count[cold], np.ones(len(each), np.int64)]
            own = string_hashes(data, at, at + count + WIDTH - 1)
            single = mix(own[len(own) - len(each):] + np.uint64(1)) & ~np.uint64(1)
            parts.append((at + base, count, np.r_[h[cold], single], own, np.r_[ids[cold], np.repeat(ids[hot], n)]))
        at, count, h, own, ids = (np.concatenate(x) for x in zip(*parts)) if parts else [np.zeros(0, np.int64)] * 5
        return Units(self.bytes(), at, count, h, own, ids)


class Units:
    """Strings of a group: places, windows and ids; ``number`` of the distinct
    string that each is, ``least`` its smallest id, ``where`` one of its places.
    Strings are told apart by two independent 64-bit hashes."""

    def __init__(self, data, at, count, h, own, ids):
        self.data, self.at, self.count, self.ids = data, at, count, ids
        order = np.lexsort((ids, own, h))
        new = np.r_[True, (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])][:len(order)]
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.where = order[new]
        self.least, self.minimiser, self.own = ids[self.where], h[self.where].astype(np.uint64), own[self.where].astype(np.uint64)


def string_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial hashes, modulo 2^64, of data[start:end]."""
    base, back = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)
    power = lambda x: np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(data), x, np.uint64)])
    total = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power(base)[:len(data)], dtype=np.uint64)]
    return mix((total[end] - total[start]) * power(back)[start])


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenation of data[start:start + size]."""
    ends = np.cumsum(size)
    return data[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def tell_minimisers(names: np.ndarray):
    def run(packs: pa.Table, told: pa.Table) -> pa.Table:
        group = Group(packs, told)
        hashes, texts = [], []
        for _, _, _, _, h, _, number in group.strings():
            hashes.append(h)
            texts.append(number)
        h, t = (np.concatenate(x) if x else np.array([], np.uint64) for x in (hashes, texts))
        order = np.lexsort((t, h))
        h, t = h[order], t[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])][:len(h)]
        h, n = np.unique(h[new], return_counts=True)
        bucket = (h >> np.uint64(1)) % np.uint64(len(names))
        order = np.argsort(bucket, kind="stable")
        return by_bucket(group.grp, bucket[order], names, {"hashes": h[order].astype("<u8"), "counts": np.minimum(n[order], 65535).astype("<u2")})
    return run


def by_bucket(grp: int, bucket: np.ndarray, names: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Table:
    """One row per bucket, under its name, with its part of the sorted columns, packed."""
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][:len(bucket)])
    ends = np.r_[cut[1:], len(bucket)].astype(int) if len(cut) else cut
    return pa.Table.from_pydict(
        {"bucket": pa.array(names[bucket[cut].astype(np.int64)]), "grp": pa.array([grp] * len(cut), pa.int32())}
        | {k: pa.array([v[a:b].tobytes() for a, b in zip(cut, ends)], pa.binary()) for k, v in columns.items()})


def find_shared(rows: pa.Table) -> pa.Table:
    """Back to each group: its minimisers that several texts have; the lowest
    bit marks those that very many have."""
    hashes = [np.frombuffer(x, "<u8") for x in rows.column("hashes").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, "<u2") for x in rows.column("counts").to_pylist()])
    every, of = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(of, weights=counts)
    answer = (every | (total > HOT_TEXTS).astype(np.uint64))[of]
    keep, out, at = total[of] > 1, [], 0
    for h in hashes:
        out.append(answer[at:at + len(h)][keep[at:at + len(h)]].astype("<u8").tobytes())
        at += len(h)
    return answers(rows.column("grp").to_pylist(), "shared", out)


def answers(grps: list[int], kind: str, data: list[bytes]) -> pa.Table:
    full = [(g, d) for g, d in zip(grps, data) if d]
    return pa.Table.from_pydict({"grp": pa.array([g for g, _ in full], pa.int32()), "kind": pa.array([kind] * len(full), pa.string()),
                                 "data": pa.array([d for _, d in full], pa.binary())})


def send_strings(names: np.ndarray):
    def run(packs: pa.Table, told: pa.Table) -> pa.Table:
        group = Group(packs, told)
        u = group.units()
        bucket = ((u.minimiser >> np.uint64(1)) % np.uint64(len(names))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = (u.count[u.where] + WIDTH - 1)[order]
        out = by_bucket(group.grp, bucket[order], names, {
            "numbers": order.astype("<u4"), "ids": u.least[order].astype("<i8"), "hashes": u.minimiser[order].astype("<u8"),
            "strings": u.own[order].astype("<u8"), "sizes": size.astype("<u2")})
        every, blobs, at, byte = gather(u.data, u.at[u.where][order], size), [], 0, 0
        for n in (len(x) // 4 for x in out.column("numbers").to_pylist()):
            more = int(size[at:at + n].sum())
            blobs.append(squeeze(every[byte:byte + more].tobytes()))
            at, byte = at + n, byte + more
        return out.append_column("blob", pa.array(blobs, pa.binary()))
    return run


def find_previous(rows: pa.Table) -> pa.Table:
    """Back to each group: per string the windows, as bits, that an earlier
    document has."""
    read = lambda name, kind: [np.frombuffer(x, kind) for x in rows.column(name).to_pylist()]
    each = read("numbers", "<u4")
    where = np.repeat(np.arange(len(each)), [len(x) for x in each])
    numbers, ids, h, own, size = (np.concatenate(x) for x in (each, read("ids", "<i8"), read("hashes", "<u8"), read("strings", "<u8"), read("sizes", "<u2")))
    size = size.astype(np.int64)
    every = np.frombuffer(b"".join(map(expand, rows.column("blob").to_pylist())), np.uint8)
    u = Units(every, np.cumsum(size) - size, size - WIDTH + 1, h, own, ids)
    of, first_id, minimiser, windows, place = u.number, u.least, u.minimiser, u.count[u.where], u.at[u.where]
    bits = np.zeros(len(u.where), np.uint64)
    _, by, several = np.unique(minimiser, return_inverse=True, return_counts=True)
    todo = np.flatnonzero(several[by] > 1)  # a lone string has nothing to match but its copies
    todo = todo[np.argsort(by[todo], kind="stable")]
    # only strings of one minimiser can match: whole minimisers, some BLOCK_BYTES at a time
    block = np.cumsum(windows[todo] + WIDTH - 1) // BLOCK_BYTES
    last = np.flatnonzero(np.r_[by[todo][1:] != by[todo][:-1], True][:len(todo)])
    block = block[last[np.searchsorted(last, np.arange(len(todo)))]]
    for part in np.split(todo, np.flatnonzero(block[1:] != block[:-1]) + 1) if len(todo) else ():
        n = windows[part]
        data = gather(every, place[part], n + WIDTH - 1)
        begin = np.cumsum(n + WIDTH - 1) - (n + WIDTH - 1)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = np.repeat(begin, n) + offset
        seen = longest_previous(data, starts, np.repeat(first_id[part], n), WIDTH) >= WIDTH
        np.bitwise_or.at(bits, np.repeat(part, n)[seen], np.uint64(1) << offset[seen].astype(np.uint64))
    whole = (np.uint64(1) << windows.astype(np.uint64)) - np.uint64(1)
    answer = np.where(ids > first_id[of], whole[of], bits[of])
    keep = answer > 0
    pairs = np.stack([numbers, answer.astype(np.uint32)], axis=1).astype("<u4")[keep]
    ends = np.searchsorted(where[keep], np.arange(rows.num_rows + 1))  # a group row's strings lie together
    return answers(rows.column("grp").to_pylist(), "answers", [pairs[a:b].tobytes() for a, b in zip(ends, ends[1:])])


def cover(starts: np.ndarray, width: int, slice_bytes: int = SLICE_BYTES) -> np.ndarray:
    """Bytes that a window starting at one of ``starts`` (flags) covers."""
    out = np.zeros(len(starts), bool)
    for a in range(0, len(starts), slice_bytes):
        back = max(0, a - width + 1)
        total = np.r_[0, np.cumsum(starts[back:a + slice_bytes], dtype=np.int32)]
        at = np.arange(a - back, len(total) - 1)
        out[a:a + slice_bytes] = total[at + 1] > total[np.maximum(at + 1 - width, 0)]
    return out


def whole(raw: np.ndarray, drop: np.ndarray) -> np.ndarray:
    """``drop`` without the bytes of characters that keep another byte."""
    keep, inner = ~drop, (raw & 0xC0) == 0x80
    for _ in range(3):  # a kept inner byte keeps the ones before it
        keep[:-1] |= keep[1:] & inner[1:]
    for _ in range(3):  # and a kept byte the inner ones after it
        keep[1:] |= keep[:-1] & inner[1:]
    return ~keep


KINDS = {"key": pa.string(), "kept": pa.binary()}


def apply_answers(whole_chars: bool):
    def run(packs: pa.Table, told: pa.Table) -> pa.Table:
        group = Group(packs, told)
        u = group.units()
        bits = np.zeros(len(u.where), np.uint64)
        bits[group.answers[:, 0]] = group.answers[:, 1]
        every = (np.uint64(1) << u.count.astype(np.uint64)) - np.uint64(1)
        mask = np.where(u.ids > u.least[u.number], every, bits[u.number]) if len(u.at) else bits
        gone = np.zeros(len(u.data), bool)
        for k in range(int(u.count.max()) if len(u.at) else 0):
            gone[u.at[(mask >> np.uint64(k)) & np.uint64(1) > 0] + k] = True
        covered, begin = cover(gone, WIDTH), 0
        out = {c: [] for c in ("doc_id", "key", "n_bytes", "n_removed", "n_spans", "kept")}
        for first, ids, texts in group.packs:
            for k, (i, text) in enumerate(zip(ids.tolist(), texts)):
                if first + k in group.copies:
                    drop = np.full(len(text), len(text) >= WIDTH)
                else:
                    drop = covered[begin:begin + len(text)]
                    begin += len(text)
                raw = np.frombuffer(text, np.uint8)
                if whole_chars and drop.any():
                    drop = whole(raw, drop)
                out["doc_id"].append(None if i == LAST else i)
                out["key"].append(group.keys[first][k])
                out["n_bytes"].append(len(text))
                out["n_removed"].append(int(drop.sum()))
                out["n_spans"].append(int(drop[:1].sum() + (drop[1:] > drop[:-1]).sum()))
                out["kept"].append(raw[~drop].tobytes() if drop.any() else text)
        return pa.Table.from_pydict({k: pa.array(v, KINDS.get(k, pa.int64())) for k, v in out.items()})
    return run


def dedup(docs: DataFrame, whole_chars: bool = False, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES,
          id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None) -> DataFrame:
    """Per row: doc_id, key (``carry`` of the row), n_bytes, n_removed, n_spans (maximal removed runs) and
    kept (binary, what is left).  ``whole_chars`` keeps a character if any
    of its bytes stays, so that ``kept`` is UTF-8.

    NULL and empty texts have no bytes; a NULL id comes after all others, and
    rows of one id are never earlier than each other, so repeated rows keep
    what they keep; extra columns take no part; an empty table gives no rows.
    A very long text is worked on in slices, by one task, and matched whole.
    """
    key = F.lit(None) if carry is None else carry
    rows = docs.select(F.col(id_col).cast("long").alias("id"), key.cast("string").alias("key"), text_of(text_col).cast("binary").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    groups, buckets = 12 + total // group_bytes, 12 + total // bucket_bytes
    names = bucket_names(docs.sparkSession, buckets)
    small_batches(docs.sparkSession)
    packs = pack_documents(rows, groups)
    schema = "grp int, kind string, data binary"
    copies = cut_lineage(repeated(packs), "copies")
    def by_group(told: DataFrame, fn, out: str, *more: str) -> DataFrame:
        return packs.select("grp", "first", "ids", "sizes", "blob", *more).groupBy("grp").cogroup(told.groupBy("grp")).applyInArrow(fn, out)

    minimisers = by_group(copies, tell_minimisers(names), "bucket int, grp int, hashes binary, counts binary")
    shared = cut_lineage(minimisers.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(find_shared, schema), "shared")
    strings = by_group(copies.unionByName(shared), send_strings(names),
                       "bucket int, grp int, numbers binary, ids binary, hashes binary, strings binary, sizes binary, blob binary")
    previous = cut_lineage(strings.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(find_previous, schema), "previous")
    return by_group(copies.unionByName(shared).unionByName(previous), apply_answers(whole_chars),
                    "doc_id long, key string, n_bytes long, n_removed long, n_spans long, kept binary", "keys")


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with the repeats taken out of its texts, whole characters
    only, and ``length_col`` (where there is one) set to what is left; all
    rows and columns stay.  A NULL text becomes empty; rows of one id and text
    are cut alike; columns may have any names."""
    key, of, left, mine = row_key(id_col, text_col), *(fresh_name(docs, x) for x in ("of", "left", "mine"))
    kept = (dedup(docs, whole_chars=True, id_col=id_col, text_col=text_col, carry=key)
            .select(F.col("key").alias(of), F.decode("kept", "UTF-8").alias(left)).dropDuplicates([of]))
    rows = docs.withColumn(mine, key).drop(text_col)
    new = {c: F.col(left) if c == text_col else F.length(left).cast("long") if c == length_col else F.col(c) for c in docs.columns}
    return rows.join(kept, F.col(mine) == F.col(of)).select(*(x.alias(c) for c, x in new.items()))
