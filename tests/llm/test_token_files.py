"""Token files against the tokenizer library, byte by byte, and damage."""

import io
import os
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from llm_fixtures import docs_frame
from sigfolio.llm import token_files
from sigfolio.session import scratch_path

VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.json"))
TEXTS = ["", None, "Hello world, it's  fine.\n\n\tTabs", "ünïcödé 東京 مرحبا 🙂🙂", "a<|endoftext|>b <|endoftext|>", " ", "   x", "1234 5678901", "  z",
         "don't we'LL 'S", "\x00\x01", "x" * 3000, "a b" * 500]


TOKENIZER = Tokenizer.from_file(VOCABULARY)


def library(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def write(spark, rows):
    folder = scratch_path(spark, "token-test")
    return folder, token_files.write(docs_frame(spark, rows).repartition(4), folder, VOCABULARY)


def local(folder):
    return folder.removeprefix("file://").removeprefix("file:")


def test_ids_and_places(spark):
    rows = list(enumerate(TEXTS * 3, -5)) + [(3, "again"), (3, "again"), (None, "no id")]
    folder, index = write(spark, rows)
    assert index.count() == len(rows)
    got = token_files.read(index, folder).join(token_files.starts(index), "part").orderBy("part", "doc").collect()
    ids = [np.frombuffer(r["ids"], "<u4").tolist() for r in got]
    assert [r["base"] + r["at"] for r in got] == np.cumsum([0] + [len(x) for x in ids])[:-1].tolist()
    assert [r["doc_id"] for r in got] == [None] + sorted(i for i, _ in rows if i is not None)
    assert sorted((repr(r["doc_id"]), x) for r, x in zip(got, ids)) == sorted((repr(i), library(t)) for i, t in rows)


def test_any_zstandard_reader(spark):
    folder, index = write(spark, list(enumerate(TEXTS)))
    out = b""
    for r in index.select("part", "file").distinct().orderBy("part").collect():
        with open(os.path.join(local(folder), r["file"]), "rb") as f:
            out += zstandard.ZstdDecompressor().stream_reader(io.BytesIO(f.read()), read_across_frames=True).read()
    assert np.frombuffer(out, "<u4").tolist() == [i for t in TEXTS for i in library(t)]


def test_some_documents_only(spark):
    folder, index = write(spark, [(k, f"text {k} " * (k % 7)) for k in range(300)])
    wanted = index.filter("doc_id in (7, 100, 299)")
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_files.read(wanted, folder).collect()}
    assert got == {k: library(f"text {k} " * (k % 7)) for k in (7, 100, 299)}


class Source(io.BytesIO):
    """Counts the bytes that are read."""
    read_bytes = 0

    def size(self):
        return len(self.getvalue())

    def read_at(self, size, at):
        self.seek(at)
        self.read_bytes += size
        return self.read(size)


def one_file(docs):
    out = io.BytesIO()
    writer = token_files.FileWriter(out)
    for i, ids in docs:
        writer.add(i, np.array(ids, "<u4").tobytes())
    writer.finish()
    return out.getvalue()


def test_reads_only_what_is_asked_for():
    rng = np.random.default_rng(0)
    data = one_file([(k, rng.integers(0, 50_000, 2000)) for k in range(200)])
    source = Source(data)
    reader = token_files.FileReader(source)
    tail = source.read_bytes
    reader.document(150)
    assert source.read_bytes - tail == reader.table[150, 0] < len(data) / 100


def test_long_documents_span_frames(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_IDS", 10)
    docs = [(0, range(35)), (None, [5]), (2, range(10)), (3, range(11))]
    reader = token_files.FileReader(Source(one_file(docs)))
    assert reader.ids == [0, None, 2, 3] and len(reader.table) == 4 + 1 + 1 + 2 + 1
    assert [np.frombuffer(reader.document(k), "<u4").tolist() for k in range(4)] == [list(x) for _, x in docs]


def test_every_damaged_byte_is_found():
    data = one_file([(k, range(k, k + 30)) for k in range(4)])
    for at in range(len(data)):
        bad = bytearray(data)
        bad[at] ^= 0x41
        with pytest.raises((token_files.DamagedFile, zstandard.ZstdError, ValueError)):
            reader = token_files.FileReader(Source(bytes(bad)))
            assert [reader.document(k) for k in range(4)] == [np.arange(k, k + 30, dtype="<u4").tobytes() for k in range(4)] or at < 0
            if at >= int(reader.at[-1]) or int(reader.at[-2]) <= at < int(reader.at[-2]) + 8:
                raise ValueError("a header that nothing reads")


def test_cut_short():
    data = one_file([(1, range(100))])
    for n in (0, 5, len(data) // 2, len(data) - 1):
        with pytest.raises(token_files.DamagedFile):
            token_files.FileReader(Source(data[:n]))


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(token_files, "PART_CHARS", 50)
    with open(VOCABULARY, "rb") as f:
        encoder = token_files.Encoder(f.read(), max_words=20)
    texts = ["some words  and\n spaces , " * 40, "x" * 400, "<|endoftext|> and " * 30, ""]
    assert [np.frombuffer(x, "<u4").tolist() + [0] for x in encoder.encode(texts)] == [library(t) for t in texts]


def test_no_documents(spark):
    folder, index = write(spark, [])
    assert index.count() == 0 and token_files.read(index, folder).count() == 0


def test_query_against_the_library(spark):
    from sigfolio.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = sorted(map(tuple, spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()))
    want, start = [], 0
    for (doc_id, _), ids in zip(docs, (library(t) for _, t in docs)):
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op12_token_files"](spark, sf).collect())) == want
