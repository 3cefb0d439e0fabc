"""Toxicity by weak supervision.

1. Lexicons are mined from one part of the labelled rows: words and word
   beginnings that are much likelier in toxic texts.
2. Voters: each kind of term, split by strength and by a hash of the term,
   votes on a text by its hits; a few patterns (shouting, censored words, runs
   of exclamation marks, one word over and over) vote too.
3. A generative label model is fitted by EM to the vote patterns of the other
   part of the training rows, their annotation being one more voter: class balance, each voter's accuracy in both
   classes, and the correlation of voters within a class, by which the votes
   of voters that repeat each other are discounted.
4. A linear classifier (logistic regression over terms and voters) learns the
   posterior labels; it scores every whole text.

What is fitted rests on at most ``max_labelled`` labelled rows, chosen by a
hash of the id, so every fitting step has a proven bound.  Scoring runs where
the rows are read, without a shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigfolio.llm.common import map_rows, text_of

#: Labelled rows that a model is fitted on, at most (documented bound).
MAX_LABELLED = 40_000
#: Terms that the lexicons keep, at most.
MAX_TERMS = 6_000
#: A document is rejected at this score.
THRESHOLD = 0.7
#: Log-likelihood ratio against independence that a term needs.
LEAST_EVIDENCE = 16.0
PREFIXES = (4, 5, 6, 7)
#: Beginnings that also count as a term of their own if two distinct words have them.
TWICE = {5: "b", 7: "c"}
GROUPS = 3
PATTERNS = ("shouting", "censored", "exclaiming", "repeating")

WORD = re.compile(r"[^\W\d_]+")
SPACE = re.compile(r"\s")
CENSORED = re.compile(r"\b[^\W\d_]+[*#@$%]{2,}[^\W\d_]*")


def pieces(text: str, size: int = 1_000_000) -> Iterator[str]:
    """A long text some ``size`` characters at a time, cut at white space."""
    at = 0
    while len(text) - at > size:
        m = SPACE.search(text, at + size)
        if m is None:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


def terms(text: str) -> set[str]:
    """Distinct words ("w:..."), beginnings of longer words ("4:...") and
    beginnings that two distinct words share ("b:...", "c:...")."""
    words: set[str] = set()
    for part in pieces(text):
        words.update(WORD.findall(part.lower()))
    out = {"w:" + w for w in words}
    for n in PREFIXES:
        begun = [w[:n] for w in words if len(w) > n]
        once = set(begun)
        out.update([f"{n}:{b}" for b in once])
        if n in TWICE and len(once) < len(begun):
            out.update([f"{TWICE[n]}:{b}" for b, k in Counter(begun).items() if k > 1])
    return out


def pattern_votes(text: str) -> list[int]:
    upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    count: Counter = Counter()
    for part in pieces(text):
        count.update(part.split())
    words, top = count.total(), max(count.values(), default=0)
    return [int(upper >= 20 and upper > 0.5 * len(text)), int(CENSORED.search(text) is not None),
            int("!!" in text), int(words >= 20 and top > 0.3 * words)]


@dataclass
class Lexicon:
    """term -> (index, voter); voters are kind x strength x hash group."""

    index: dict[str, int] = field(default_factory=dict)
    voter: dict[str, int] = field(default_factory=dict)
    voters: list[str] = field(default_factory=list)

    @staticmethod
    def of(rows: list[tuple[str, float, bool]]) -> Lexicon:
        out = Lexicon()
        names: dict[str, int] = {}
        for term, _, strong in sorted(rows):
            name = f"{term[0]}/{'strong' if strong else 'weak'}/{zlib.crc32(term.encode()) % GROUPS}"
            out.index[term] = len(out.index)
            out.voter[term] = names.setdefault(name, len(names))
        out.voters = [*names, *PATTERNS]
        return out

    def hits(self, text: str) -> tuple[list[int], list[int]]:
        """Indices of the terms that occur, and every voter's vote."""
        found = sorted(t for t in terms(text) if t in self.index)
        votes = [0] * (len(self.voters) - len(PATTERNS))
        for t in found:
            votes[self.voter[t]] = 1
        return [self.index[t] for t in found], votes + pattern_votes(text)


class LabelModel:
    """Two classes; each voter fires with a rate of its own in either.

    ``fit`` takes distinct vote patterns with their counts; the last voter is
    the annotation of the training row.  Voters that are correlated within
    the classes share their say: a voter's log odds are divided by one plus
    the sum of its positive within-class correlations.
    """

    def __init__(self, prior: float = 0.1):
        self.prior = prior

    def fit(self, votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> LabelModel:
        post = np.where(votes[:, -1] > 0, 0.95, 0.05)
        total = counts.sum()
        for _ in range(rounds):
            w1, w0 = counts * post, counts * (1 - post)
            self.prior = float(np.clip(w1.sum() / total, 0.005, 0.5))
            self.rate1 = (votes.T @ w1 + 0.5) / (w1.sum() + 1)
            self.rate0 = (votes.T @ w0 + 0.5) / (w0.sum() + 1)
            # an annotation is taken to be right 95 to 99.5 times in a hundred where it says
            # toxic, and to say so wrongly 2 to 50 times in a thousand
            self.rate1[-1], self.rate0[-1] = np.clip(self.rate1[-1], 0.95, 0.995), np.clip(self.rate0[-1], 0.002, 0.05)
            self.correlate(votes, w1, w0)
            new = self.posterior(votes)
            done = np.abs(new - post).max() < 1e-6
            post = new
            if done:
                break
        return self

    def correlate(self, votes: np.ndarray, w1: np.ndarray, w0: np.ndarray) -> None:
        cov = np.zeros((votes.shape[1],) * 2)
        for w, rate in ((w1, self.rate1), (w0, self.rate0)):
            d = votes - rate
            cov += (d * w[:, None]).T @ d
        std = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        self.correlation = cov / np.outer(std, std)
        share = np.clip(self.correlation, 0, 1)
        np.fill_diagonal(share, 0)
        share[-1] = 0  # the annotation keeps its whole say
        self.discount = 1 / (1 + share.sum(axis=1))

    @property
    def accuracy(self) -> np.ndarray:
        return self.prior * self.rate1 + (1 - self.prior) * (1 - self.rate0)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        on = np.log(self.rate1 / self.rate0) * self.discount
        off = np.log((1 - self.rate1) / (1 - self.rate0)) * self.discount
        z = math.log(self.prior / (1 - self.prior)) + votes @ on + (1 - votes) @ off
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    lexicon: Lexicon
    labels: LabelModel | None
    weight: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        index, votes = self.lexicon.hits(text)
        n = len(self.lexicon.index)
        z = self.bias + self.weight[index].sum() + self.weight[n:] @ np.array(votes, float)
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))


def logistic(rows: list[list[int]], target: np.ndarray, size: int, rounds: int = 2000, l2: float = 1e-6) -> tuple[np.ndarray, float]:
    """Logistic regression on sets of present features, by accelerated
    gradient descent with a step for each feature by its frequency."""
    n = max(1, len(rows))
    w, b = np.zeros(size), math.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    held = np.array([len(r) for r in rows])
    of, feat = np.repeat(np.arange(n), held), np.array([i for r in rows for i in r], np.int64)
    active = 1 + float(np.quantile(held, 0.99))
    step = 4 / (active * (np.bincount(feat, minlength=size) / n + 1e-3))
    before = w, b
    for k in range(rounds):
        m = k / (k + 3)
        v, c = w + m * (w - before[0]), b + m * (b - before[1])
        z = c + np.bincount(of, v[feat], minlength=n)
        err = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - target
        before = w, b
        w = v - step * (np.bincount(feat, err[of], minlength=size) / n + l2 * v)
        b = c - 4 / active * err.mean()
    return w, float(b)


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3: 1 is held out, 0 gives the lexicons,
    2 the label model and the classifier."""
    return F.crc32(F.col(id_col).cast("string")) % 3


def labelled_sample(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """(part, toxic, text) of at most ``max_labelled`` training rows, the
    first ones by a hash of the id.  The sample's size bounds the broadcast."""
    picked = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != 1))
              .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
              .select("doc_id", fold().cast("int").alias("part"), F.col("toxic").cast("int").alias("toxic")))
    return docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id").select("part", "toxic", "text")


def mine(sample: DataFrame, max_terms: int, least: int = 3) -> Lexicon:
    """Terms that are far likelier in toxic texts of part 0."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()

        def out() -> pa.RecordBatch:
            keys = list(toxic.keys() | clean.keys())
            batch = pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())],
                names=["term", "toxic", "clean"])
            toxic.clear()
            clean.clear()
            return batch

        for batch in batches:
            for y, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
                (toxic if y else clean).update(terms(text) if text else ())
            if len(toxic) + len(clean) > 200_000:
                yield out()
        yield out()

    part = sample.filter("part = 0")
    sizes = {r["toxic"]: r["n"] for r in part.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not n1 or not n0:
        return Lexicon.of([])
    t, c = F.col("toxic"), F.col("clean")
    odds = F.log(((t + 0.5) / (n1 + 1)) / ((c + 0.5) / (n0 + 1)))
    ratio = lambda k, n: 2 * k * F.log(k * (n1 + n0) / ((t + c) * n))
    evidence = ratio(t, n1) + F.when(c > 0, ratio(c, n0)).otherwise(0.0)
    found = (map_rows(part.select("toxic", "text"), count, "term string, toxic long, clean long")
             .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
             .filter(t >= least)
             .select("term", odds.alias("odds"), evidence.alias("evidence"))
             .filter((F.col("odds") >= math.log(8.0)) & (F.col("evidence") >= LEAST_EVIDENCE))
             .orderBy(F.col("evidence").desc(), "term").limit(max_terms))
    return Lexicon.of([(r["term"], r["odds"], r["odds"] >= math.log(50.0)) for r in found.collect()])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_terms: int = MAX_TERMS) -> Model:
    """Lexicons, label model and classifier from the training rows."""
    sample = labelled_sample(docs, labels, max_labelled)
    lexicon = mine(sample, max_terms)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [lexicon.hits(t) for t in batch.column("text").to_pylist()]
            votes = [g[1] + [y] for g, y in zip(got, batch.column("toxic").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array(votes, pa.list_(pa.int8()))],
                                             names=["index", "votes"])

    rows = map_rows(sample.filter("part = 2").select("toxic", "text"), vote, "index array<int>, votes array<tinyint>").collect()
    if not rows:
        return Model(lexicon, None, np.zeros(len(lexicon.index) + len(lexicon.voters)), -4.0)
    rows.sort(key=lambda r: (r["votes"], r["index"]))  # the order of tasks must not matter
    votes = np.array([r["votes"] for r in rows], float)
    distinct, of, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    labels_model = LabelModel().fit(distinct, counts)
    target = labels_model.posterior(distinct)[of.ravel()]
    n = len(lexicon.index)
    weight, bias = logistic([[*r["index"], *(n + np.flatnonzero(r["votes"][:-1])).tolist()] for r in rows], target, n + len(lexicon.voters))
    return Model(lexicon, labels_model, weight, bias)


def score_rows(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text") -> DataFrame:
    """Every row with all its columns and ``name``, the score (0 to 1) of its
    whole text.  NULL and empty texts get the classifier's bias."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # the model, at most MAX_TERMS terms, goes with the function
            scores = [model.score(t or "") for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])

    return map_rows(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and ``score`` (0 to 1) of every row's whole text.

    NULL and empty texts get the classifier's bias; repeated rows and NULL
    ids give a row each; other columns take no part.
    """
    return score_rows(docs.select(id_col, text_of().alias("text")), model).select(id_col, "score")
