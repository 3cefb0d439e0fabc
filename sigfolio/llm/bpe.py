"""Byte-level BPE by prefix-sharing trie traversal.

The last token of a prefix's encoding decides the whole encoding: a prefix
ends in the one token ``t`` for which the encoding of what stands before it
ends in a token that may be followed by ``t``.  The distinct new words of a
group of texts form a trie.  Their sorted list is that trie in depth-first
order: two neighbours share the path to their common prefix, so each node is
met once, a prefix that several words share is solved once, and a node keeps
only its last token.  A word's ids are read back from its node to the root.

``encode_decode`` needs no shuffle: each row is encoded where it is read.  A
task keeps at most ``MAX_WORDS`` encoded words and ``MAX_PAIRS`` known pairs;
beyond that these tables start afresh, with equal results.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigfolio.llm.common import map_rows, text_of

MAX_WORDS = 400_000
MAX_PAIRS = 1_000_000
#: Characters of text whose distinct words form one trie.
GROUP_CHARS = 2_000_000

#: Fixed value: the word pattern of byte-level pre-tokenising.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level
    vocabulary: itself if it is visible, else the next letter from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in visible}
    rest = [b for b in range(256) if b not in set(visible)]
    letters.update({chr(0x100 + k): b for k, b in enumerate(rest)})
    return letters


class Vocabulary:
    """Tokens as bytes, merges as pairs of ids, and the added tokens."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model, letters = spec["model"], byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        self.ids = {to_bytes(s): i for s, i in model["vocab"].items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*self.ids.values(), *self.added.values()])
        self.bytes: list[bytes] = [b""] * size
        for b, i in self.ids.items():
            self.bytes[i] = b
        for s, i in self.added.items():
            self.bytes[i] = s.encode()
        self.sizes = list(map(len, self.bytes))
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        #: Beginnings of tokens: the id of a whole token, else -1.
        self.begins = {b[:k]: -1 for b in self.ids for k in range(1, len(b))} | self.ids
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right = to_bytes(a), to_bytes(b)
            self.merges[self.ids[left], self.ids[right]] = (rank, self.ids[left + right])
        #: token -> (rank, left, right) of the merge that makes it
        self.made_by = {made: (rank, *pair) for pair, (rank, made) in self.merges.items()}

    def merge(self, word: bytes) -> list[int]:
        """Encoding by definition: the lowest-ranked pair is merged first."""
        out = [self.ids[bytes((b,))] for b in word]
        while len(out) > 1:
            found = [(self.merges[p], k) for k, p in enumerate(zip(out, out[1:])) if p in self.merges]
            if not found:
                break
            (_, made), k = min(found)
            out[k:k + 2] = [made]
        return out


class TrieEncoder:
    """Encodes a set of words over the trie that they form."""

    def __init__(self, vocab: Vocabulary, max_pairs: int = MAX_PAIRS):
        self.vocab, self.max_pairs = vocab, max_pairs
        self.pairs: dict[int, bool] = {}
        self.edges: tuple[dict, dict] = {}, {}  # at most the vocabulary

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at the left (0) or right (1) end of ``token``
        while it is merged together, each with the rank of the merge that
        takes it in."""
        known = self.edges[side].get(token)
        if known is None:
            known, until, t = [], float("inf"), token
            while True:
                known.append((t, until))
                made = self.vocab.made_by.get(t)
                if made is None:
                    break
                until, t = made[0], made[1 + side]
            self.edges[side][token] = known
        return known

    def follows(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left`` in an encoding?  ``left`` -1: at the start.

        It may unless some merge would join the two across their border: one
        whose two tokens stand at the border together, before either is taken
        in.  Of equal merges the one on the left goes first.
        """
        key = (left + 1) << 20 | right
        known = self.pairs.get(key)
        if known is None:
            if left < 0:
                known = self.vocab.merge(self.vocab.bytes[right]) == [right]
            else:
                merges, known = self.vocab.merges, self.follows(-1, right)
                for a, until_a in self.edge(left, 1) if known else ():
                    for b, until_b in self.edge(right, 0):
                        m = merges.get((a, b))
                        if m is not None and m[0] < until_a and m[0] <= until_b:
                            known = False
            if len(self.pairs) >= self.max_pairs:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def solve(self, word: bytes, depth: int, last: list[int]) -> None:
        """Append to ``last``, which has the last tokens of the prefixes
        shorter than ``depth``, those of the prefixes from ``depth`` on.

        ``alive`` are the places from which some token goes on: a place that
        no token begins with stays out for all longer prefixes.
        """
        begins, pairs, follows = self.vocab.begins, self.pairs, self.follows
        alive = [s for s in range(depth - 1) if word[s:depth - 1] in begins]
        for d in range(depth, len(word) + 1):
            alive.append(d - 1)
            still, token = [], -1
            for s in alive:
                t = begins.get(word[s:d])
                if t is None:
                    continue
                still.append(s)
                if token < 0 <= t:
                    before = last[s]
                    known = pairs.get((before + 1) << 20 | t)
                    if known or known is None and follows(before, t):
                        token = t
            if token < 0:
                raise ValueError(f"no encoding of {word[:d]!r}")
            alive = still
            last.append(token)

    def read_back(self, size: int, last: list[int]) -> bytes:
        """The packed ids, from the last token to the first."""
        out, sizes, packed = [], self.vocab.sizes, self.vocab.packed
        while size:
            t = last[size]
            out.append(packed[t])
            size -= sizes[t]
        out.reverse()
        return b"".join(out)

    def encode(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Each distinct word with its packed ids, in the trie's depth-first
        order.  ``last`` is the path from the root to the current node."""
        last, prev = [-1], b""
        for word in sorted(words):
            depth, top = 0, min(len(word), len(prev))
            while depth < top and word[depth] == prev[depth]:
                depth += 1
            del last[depth + 1:]
            self.solve(word, depth + 1, last)
            prev = word
            yield word, self.read_back(len(word), last)


class TextCodec:
    """Whole texts to ids (little-endian unsigned 32-bit) and back."""

    def __init__(self, raw: bytes, max_words: int = MAX_WORDS):
        import regex

        self.vocab = Vocabulary(raw)
        self.trie = TrieEncoder(self.vocab)
        self.words = regex.compile(WORDS).findall
        self.border = regex.compile(r"(?<=\S) (?=\S)")
        self.part_chars = 1_000_000
        self.added = regex.compile("(" + "|".join(map(regex.escape, self.vocab.added)) + ")") if self.vocab.added else None
        self.known: dict[str, bytes] = {}
        self.max_words = max_words

    def pieces(self, text: str) -> list[str | int]:
        """Words, and the ids of added tokens, in order."""
        if self.added is None or not self.added.search(text):
            return self.words(text)
        out: list[str | int] = []
        for part in self.added.split(text):
            if part in self.vocab.added:
                out.append(self.vocab.added[part])
            else:
                out += self.words(part)
        return out

    def parts(self, text: str, size: int | None = None) -> Iterator[str]:
        """A long text some ``size`` characters at a time, cut before a lone
        space between two visible characters: no word spans such a place."""
        at, size = 0, size or self.part_chars
        while len(text) - at > size:
            m = self.border.search(text, at + size)
            if m is None:
                break
            yield text[at:m.start()]
            at = m.start()
        yield text[at:] if at else text

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; GROUP_CHARS of text at a time."""
        out: list[list[bytes]] = [[] for _ in texts]
        group, size = [], 0
        for k, text in enumerate(texts):
            for part in self.parts(text):
                group.append((k, part))
                size += len(part)
                if size >= GROUP_CHARS:
                    self.encode_group(group, out)
                    group, size = [], 0
        self.encode_group(group, out)
        return [b"".join(x) for x in out]

    def encode_group(self, group: list[tuple[int, str]], out: list[list[bytes]]) -> None:
        if len(self.known) > self.max_words:
            self.known = {}
        cut = [self.pieces(t) for _, t in group]
        new = set().union(*cut).difference(self.known) if cut else set()
        by_bytes = {w.encode(): w for w in new if isinstance(w, str)}
        fresh = {w: i.to_bytes(4, "little") for w in new if isinstance(i := w, int)}
        for word, packed in self.trie.encode(by_bytes):
            fresh[by_bytes[word]] = packed
        self.known.update(fresh)
        for (k, _), c in zip(group, cut):
            out[k].append(b"".join(map(self.known.__getitem__, c)))

    def decode(self, packed: bytes) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        ids, token = np.frombuffer(packed, "<u4"), self.vocab.bytes.__getitem__
        parts = (b"".join(map(token, ids[a:a + 1_000_000].tolist())) for a in range(0, len(ids), 1_000_000))
        return b"".join(parts).decode("utf-8", "replace")


def encode_decode(df: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, ``ids`` (binary, little-endian unsigned 32-bit
    ids of the whole text) and ``decoded`` (the text decoded from them).

    A NULL text counts as empty and gives no ids; repeated rows and NULL ids
    give a row each; an empty table gives none.  Other columns of ``df``,
    whatever their names, take no part.  Strings of added tokens in a text
    become those tokens.
    """
    with open(tokenizer_file, "rb") as f:
        raw = df.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file, of fixed size
    rows = df.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, held, size = TextCodec(raw.value), [], 0

        def done() -> Iterator[pa.RecordBatch]:
            texts = [b.column("text").to_pylist() for b in held]
            packed = codec.encode_batch([t for x in texts for t in x])
            for b in held:
                own, packed = packed[:b.num_rows], packed[b.num_rows:]
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(own, pa.binary()), pa.array(map(codec.decode, own), pa.string())],
                    names=[id_col, "ids", "decoded"])
            held.clear()

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= GROUP_CHARS:
                yield from done()
                size = 0
        yield from done()

    kind = rows.schema["id"].dataType.simpleString()
    return map_rows(rows, run, f"`{id_col}` {kind}, ids binary, decoded string")
