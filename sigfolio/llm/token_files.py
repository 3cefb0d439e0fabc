"""Token-id files of independent zstandard frames with a trailing seek table.

A file holds whole documents in ascending id order.  Each document is a frame
of its own (or several of at most ``FRAME_IDS`` ids), so a reader decompresses
the documents it wants and nothing else:

    frame, frame, ...      little-endian unsigned 32-bit ids
    skippable frame        the documents: ids, NULL marks, frames of each
    skippable frame        the public seekable format's seek table: of every
                           frame its size, its size decompressed and the low
                           32 bits of the XXH64 of its content; then how many,
                           a flag byte and the magic number

Any zstandard tool decompresses such a file to all its ids.

Tasks write below a shared folder under names of their attempt and report what
they wrote; the reported rows are the index, so files of lost or repeated
attempts are never read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigfolio.llm.bpe import WORDS, byte_letters
from sigfolio.llm.common import cut_lineage, map_rows, text_of

FRAME_IDS = 1 << 20
LEVEL = 3
#: Entries of an encoder's table.
MAX_WORDS = 1_000_000
PART_CHARS = 1_000_000
#: Bytes that a reader of neighbouring documents fetches at once.
AHEAD = 1 << 22
#: Ids in one batch of read documents.
OUT_IDS = 1 << 21

#: Fixed values of the frame formats.
SKIPPABLE = 0x184D2A50
SEEK_TABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
WITH_CHECKSUMS = 0x80


class Encoder:
    """Whole texts to packed ids, by the tokenizer library.

    Where the file says that the words of the byte-level pattern are encoded
    each for itself, texts are cut before each space that something visible
    follows, where no word can go on, and a piece met before is looked up.
    New words go to the library's model one by one.
    """

    def __init__(self, raw: bytes, max_words: int = MAX_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import regex
        from tokenizers import Tokenizer

        spec = json.loads(raw)
        first = spec.get("pre_tokenizer") or {}
        self.by_word = (first.get("type") == "ByteLevel" and first.get("use_regex", True) and not first.get("add_prefix_space")
                        and not spec.get("normalizer") and not spec["model"].get("dropout"))
        self.tokenizer = Tokenizer.from_str(raw.decode())
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.letters = {b: letter for letter, b in byte_letters().items()}
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        self.words = regex.compile(WORDS).findall
        self.border = regex.compile(r"(?<=\S) (?=\S)")
        self.pieces = re.compile(r" (?=\S)").split
        self.after_space = Known(lambda p: self.piece(p, " "), max_words)  # by what follows the space
        self.other = Known(self.word, max_words)

    def parts(self, text: str) -> Iterator[str]:
        """A long text cut before lone spaces, which no word spans."""
        at = 0
        while self.by_word and len(text) - at > PART_CHARS and (m := self.border.search(text, at + PART_CHARS)):
            yield text[at:m.start()]
            at = m.start()
        yield text[at:] if at else text

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])

    def piece(self, piece: str, space: str = "") -> bytes:
        """Ids of a piece, which may be several words."""
        if space and piece.isalpha():
            return self.word(space + piece)
        if space and piece[-1] in ".,;:!?" and piece[:-1].isalpha():
            return self.after_space[piece[:-1]] + self.other[piece[-1]]
        words = self.words(space + piece)
        if len(words) == 1:
            return self.word(words[0])
        return b"".join([self.after_space[w[1:]] if w[0] == " " and len(w) > 1 else self.other[w] for w in words])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        known = self.after_space.__getitem__
        for text in texts:
            out = []
            for part in self.parts(text):
                if not self.by_word or any(a in part for a in self.added):
                    out.append(self.whole(part))
                    continue
                first, *cut = self.pieces(part)
                out.append(self.piece(first))
                out += map(known, cut)
            self.after_space.turn()
            self.other.turn()
            yield b"".join(out)


class Known(dict):
    """Results of a function, at most about ``size`` of them: what was not
    asked for since the last turn but one is forgotten."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def __missing__(self, key):
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found

    def turn(self) -> None:
        if len(self) > self.size // 2:
            self.old = dict(self)
            self.clear()


def worker_encoder(raw: bytes) -> Encoder:
    """The encoder of this Python worker: Spark runs many tasks in one, and
    the words that a task has met are words of the next."""
    state = sys.modules.setdefault("_sigfolio_worker", types.ModuleType("_sigfolio_worker"))
    key = hashlib.sha256(raw).hexdigest()
    if getattr(state, "tokenizer", None) != key:
        state.tokenizer, state.encoder = key, Encoder(raw)
    return state.encoder


class FileWriter:
    """Appends documents to an open binary stream."""

    def __init__(self, out, level: int = LEVEL):
        import zstandard

        self.out, self.pack = out, zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.table: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        import xxhash

        frames = 0
        for at in range(0, len(ids), 4 * FRAME_IDS):
            content = ids[at:at + 4 * FRAME_IDS]
            frame = self.pack(content)
            self.out.write(frame)
            self.table.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
            frames += 1
        self.docs.append((doc_id, frames))

    def finish(self) -> None:
        import xxhash

        names = np.array([d or 0 for d, _ in self.docs], "<i8").tobytes()
        nulls = np.array([d is None for d, _ in self.docs], "u1").tobytes()
        frames = np.array([n for _, n in self.docs], "<u4").tobytes()
        content = struct.pack("<Q", len(self.docs)) + names + nulls + frames
        self.out.write(struct.pack("<II", SKIPPABLE, len(content)) + content)
        self.table.append((len(content) + 8, 0, xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        rows = np.array(self.table, "<u4").tobytes()
        self.out.write(struct.pack("<II", SEEK_TABLE, len(rows) + 9) + rows + struct.pack("<IBI", len(self.table), WITH_CHECKSUMS, SEEKABLE))


class DamagedFile(ValueError):
    pass


class FileReader:
    """Documents of one file by their place in it; ``source`` has size() and
    read_at(size, offset)."""

    def __init__(self, source, name: str = ""):
        import xxhash
        import zstandard

        self.source, self.name, self.sum = source, name, lambda b: xxhash.xxh64_intdigest(b) & 0xFFFFFFFF
        self.unpack = zstandard.ZstdDecompressor().decompress
        end = source.size()
        tail = self.exact(max(end - 9, 0), min(9, end))
        if len(tail) < 9 or struct.unpack("<I", tail[5:])[0] != SEEKABLE or not tail[4] & WITH_CHECKSUMS:
            raise DamagedFile(f"{name}: no seek table")
        n = struct.unpack("<I", tail[:4])[0]
        start = end - 9 - 12 * n
        head = struct.unpack("<II", self.exact(start - 8, 8)) if start >= 8 else None
        if head != (SEEK_TABLE, 12 * n + 9):
            raise DamagedFile(f"{name}: no seek table")
        self.table = np.frombuffer(self.exact(start, 12 * n), "<u4").reshape(n, 3).astype("i8")
        self.at = np.r_[0, np.cumsum(self.table[:, 0])]
        if self.at[-1] != start - 8:
            raise DamagedFile(f"{name}: the seek table does not fit the file")
        content = self.exact(int(self.at[-2]) + 8, int(self.table[-1, 0]) - 8)
        if self.sum(content) != self.table[-1, 2]:
            raise DamagedFile(f"{name}: list of documents")
        d = struct.unpack("<Q", content[:8])[0]
        names, nulls = np.frombuffer(content, "<i8", d, 8), np.frombuffer(content, "u1", d, 8 + 8 * d)
        self.ids = [None if null else i for i, null in zip(names.tolist(), nulls.tolist())]
        self.first = np.r_[0, np.cumsum(np.frombuffer(content, "<u4", d, 8 + 9 * d))]
        self.before = np.r_[0, np.cumsum(self.table[:, 1])] // 4
        self.held, self.held_at, self.next = b"", 0, -1

    def exact(self, at: int, size: int) -> bytes:
        return bytes(self.source.read_at(size, at))

    def fetch(self, at: int, size: int) -> bytes:
        """Bytes of the frames; reads ahead only behind what was asked for last."""
        if not self.held_at <= at <= at + size <= self.held_at + len(self.held):
            ahead = max(size, AHEAD) if at == self.next else size
            self.held, self.held_at = self.exact(at, min(ahead, int(self.at[-1]) - at)), at
        self.next = at + size
        return self.held[at - self.held_at:at - self.held_at + size]

    def document(self, k: int) -> bytes:
        """The packed ids of document ``k``; damage is an error."""
        out = []
        for f in range(self.first[k], self.first[k + 1]):
            size, whole, check = self.table[f].tolist()
            content = self.unpack(self.fetch(int(self.at[f]), size), max_output_size=whole)
            if len(content) != whole or self.sum(content) != check:
                raise DamagedFile(f"{self.name}: frame {f}")
            out.append(content)
        return out[0] if len(out) == 1 else b"".join(out)


def file_system(uri: str):
    """(pyarrow file system, path in it) of a folder as Spark names it."""
    from pyarrow import fs

    scheme, _, rest = uri.partition(":")
    if scheme in ("s3a", "s3n"):
        uri = f"s3:{rest}"
    elif scheme == "file" and not rest.startswith("//"):
        uri = f"file://{rest}"
    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, folder: str, tokenizer_file: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of every whole text, ``end_id`` behind each, to files
    below ``folder`` in ascending id order.

    Returns the index, a written table with one row per document: part (the
    file's place in the order), file, doc (place in the file), doc_id, n_ids.

    A NULL text is empty; NULL ids come first; documents of one id go by
    xxhash64 of their texts, and repeated rows are documents each; extra
    columns take no part; an empty table gives no files.  Very long texts are
    encoded in parts and stored in several frames.
    """
    with open(tokenizer_file, "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, of fixed size
    end = struct.pack("<I", end_id)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # rows equal in id and hash are alike: any place among them will do
    rows = (rows.withColumn("hash", F.xxhash64("text")).withColumn("any", F.monotonically_increasing_id())
            .repartitionByRange("doc_id", "hash", "any").sortWithinPartitions("doc_id", "hash").select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, encoder, writer, out, doc = TaskContext.get(), None, None, None, 0
        file = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.ids.zst"
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                system, path = file_system(folder)
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(f"{path}/{file}", compression=None)
                encoder, writer = worker_encoder(raw.value), FileWriter(out)
            n_ids = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), encoder.encode(b.column("text").to_pylist())):
                writer.add(doc_id, ids + end)
                n_ids.append(len(ids) // 4 + 1)
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, task.partitionId(), "i4")), pa.array([file] * n), pa.array(np.arange(doc, doc + n)), b.column("doc_id"),
                 pa.array(n_ids, pa.int64())], names=["part", "file", "doc", "doc_id", "n_ids"])
            doc += n
        if writer is not None:
            writer.finish()
            out.close()

    return cut_lineage(map_rows(rows, run, "part int, file string, doc long, doc_id long, n_ids long"), "token-index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """The documents that ``index`` (rows of what ``write`` returned: all or
    some) names, from their files: doc_id, part, doc, at (ids before it in its
    file), ids (binary).

    Of each file the seek table, the list of documents and the frames of the
    wanted documents are read; content that does not have its checksum is an
    error.
    """
    files = index.select("part").distinct().count()
    wanted = index.select("part", "file", "doc").repartitionByRange(max(files, 1), "part", "doc").sortWithinPartitions("part", "file", "doc")
    names = ["doc_id", "part", "doc", "at", "ids"]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        name, reader, rows, size = None, None, [], 0
        for b in batches:
            for part, file, doc in zip(*(b.column(c).to_pylist() for c in ("part", "file", "doc"))):
                if file != name:
                    if reader is not None:
                        reader.source.close()
                    name, reader = file, FileReader(system.open_input_file(f"{path}/{file}"), file)
                ids = reader.document(doc)
                rows.append((reader.ids[doc], part, doc, int(reader.before[reader.first[doc]]), ids))
                size += len(ids)
                if size >= 4 * OUT_IDS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
        if reader is not None:
            reader.source.close()

    return wanted.mapInArrow(run, "doc_id long, part int, doc long, at long, ids binary")


def starts(index: DataFrame) -> DataFrame:
    """part, base: the ids of all files before it.  One row per file."""
    sizes = index.groupBy("part").agg(F.sum("n_ids").alias("n"))
    return sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
