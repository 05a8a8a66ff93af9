"""Document quality from a linear-chain conditional random field over its lines.

Every line of a text is labelled good or bad.  A line is described by a few
counted traits (shares of symbols, capitals, digits, word lengths, repetition and
so on), each put into one of ``BUCKETS`` buckets; the field's emissions add up a
weight for each bucket of the line itself and of the lines before and after it,
and its transitions couple neighbouring labels.  Forward and backward sums give
the probability that a line is good, and a document's score is the mean over its
lines, weighted by their lengths.

Only documents are labelled, so in training every line has its document's label.
The field is fitted by gradient ascent on the driver on a bounded sample: per
label at most ``SAMPLE_DOCS`` documents, those with the smallest hash of their id, of
at most ``SAMPLE_LINES`` lines each, weighted so that the labels keep the shares
that they have among all labelled documents.  Scoring reads every text whole.

Cases: null and empty texts are one empty line and get that line's probability;
ids whose labels disagree are not learned from, repeated labels count once, and
of several texts under one id one is learned from; null labels are ignored; with
labels of one kind only, or none, all documents get the (smoothed) share of
label 1; equal texts have equal scores; very long texts are labelled line by line
in one task, with a few hundred bytes held per line; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 2500          # of each label
SAMPLE_LINES = 2000         # a longer document is not learned from
ACCEPT = 0.7                # score from which a document is predicted good
BATCH_LINES = 200_000       # lines scored at once
ROUNDS = 150
STEP = 0.1
PENALTY = 1.0               # of the squared weights, per sampled line of weight
LEAST, MOST = 1e-12, 30.0   # of probabilities; of an emission's log odds

# classes of bytes: small letters, capitals, digits, space, common and other punctuation, bytes of other characters
_CLASS = bytes(
    97 if 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if b == 32 or 9 <= b <= 13
    else 120 if b >= 128 else 46 if chr(b) in ".,;:'\"()-?" else 35 for b in range(256))
_END, _START = b".!?:;\"'", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# upper ends of the buckets of each trait
CUTS = {
    "length": (0, 20, 60, 120, 250, 500, 1000),
    "words": (0, 1, 3, 8, 20, 50, 150),
    "symbols": (0.0, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4),
    "capitals": (0.0, 0.01, 0.03, 0.08, 0.2, 0.5, 0.8),
    "digits": (0.0, 0.005, 0.02, 0.05, 0.1, 0.3, 0.6),
    "points": (0.0, 0.01, 0.02, 0.04, 0.08, 0.15, 0.3),
    "others": (0.0, 0.01, 0.03, 0.06, 0.12, 0.3, 0.6),
    "mean_word": (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0),
    "long_word": (5, 8, 12, 16, 24, 40, 80),
    "distinct": (0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.999),
    "twice": (0.0, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7),
    "edges": (0.0, 1.0, 2.0),
    "seen": (0.0, 1.0),
}
TRAITS = list(CUTS)
BUCKETS = 8
AROUND = (0, -1, 1)                                   # the line, the one before, the one after
OUTSIDE = len(TRAITS) * BUCKETS                       # the bucket of a line beyond either end
WIDTH = OUTSIDE + 1


def traits(text: bytes) -> tuple[list[tuple], list[int]]:
    """One row of traits per line, and the lines' lengths in characters."""
    rows, lengths = [], []
    seen: set[bytes] = set()
    for line in text.split(b"\n"):
        kinds = line.translate(_CLASS)
        n = len(line) or 1
        words = line.split()
        count = len(words) or 1
        pairs = list(zip(words, words[1:], strict=False))
        bare = line.strip()
        edges = (bare[:1] in _START if bare else 0) + (bare[-1:] in _END if bare else 0)
        blank = kinds.count(b" ")
        rows.append((
            len(line), len(words), kinds.count(b"#") / n, kinds.count(b"A") / n, kinds.count(b"0") / n, kinds.count(b".") / n,
            kinds.count(b"x") / n, (len(line) - blank) / count, max(map(len, words), default=0), len(set(words)) / count,
            1 - len(set(pairs)) / len(pairs) if pairs else 0.0, edges, float(bool(bare) and bare in seen)))
        seen.add(bare)
        # characters: bytes that do not continue one
        lengths.append(len(line) - sum(map(line.count, _CONTINUED)) if kinds.count(b"x") else len(line))
    return rows, lengths


_CONTINUED = [bytes([b]) for b in range(0x80, 0xC0)]


def buckets(rows: list[tuple]) -> np.ndarray:
    """Places of the traits' buckets, one column per trait."""
    values = np.asarray(rows, np.float64).reshape(len(rows), len(TRAITS))
    out = np.empty(values.shape, np.uint8)
    for k, name in enumerate(TRAITS):
        out[:, k] = k * BUCKETS + np.searchsorted(CUTS[name], values[:, k], side="left")
    return out


@dataclass
class Chains:
    """Lines of several documents, each document's lines in a row, longest documents first."""

    codes: np.ndarray            # lines x traits
    starts: np.ndarray           # first line of each document
    sizes: np.ndarray            # its lines

    @classmethod
    def of(cls, codes: np.ndarray, sizes: np.ndarray) -> tuple[Chains, np.ndarray]:
        """The chains, and the order in which the documents now are."""
        order = np.argsort(-sizes, kind="stable")
        return cls(codes, (np.cumsum(sizes) - sizes)[order], sizes[order]), order

    def shifted(self) -> list[np.ndarray]:
        """The codes of the lines themselves, before and after, with OUTSIDE beyond the ends."""
        before, after = np.full_like(self.codes, OUTSIDE), np.full_like(self.codes, OUTSIDE)
        before[1:], after[:-1] = self.codes[:-1], self.codes[1:]
        before[self.starts], after[self.starts + self.sizes - 1] = OUTSIDE, OUTSIDE
        return [self.codes, before, after]

    def steps(self) -> Iterator[tuple[int, int]]:
        """(place in the chain, documents that reach it)."""
        ends = -self.sizes
        for t in range(int(self.sizes[0]) if len(self.sizes) else 0):
            yield t, int(np.searchsorted(ends, -t, side="left"))


@dataclass
class Field:
    emission: np.ndarray         # 3 x WIDTH: log odds of good
    bias: float
    transition: np.ndarray       # 2 x 2, logs
    prior: float | None = None   # the answer for all where there is nothing to learn

    def odds(self, around: list[np.ndarray]) -> np.ndarray:
        total = np.full(len(around[0]), self.bias)
        for w, codes in zip(self.emission, around, strict=True):
            total += w[codes].sum(axis=1)
        return np.clip(total, -MOST, MOST)


def forward_backward(chains: Chains, odds: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability that each line is good, and the expected transitions of each line from the one before (lines x 2 x 2)."""
    good = 1 / (1 + np.exp(-odds))
    m = np.exp(transition - transition.max())
    a, b = np.empty((len(odds), 2)), np.ones((len(odds), 2))
    pairs = np.zeros((len(odds), 2, 2))
    steps = list(chains.steps())
    for t, n in steps:
        at = chains.starts[:n] + t
        state = np.ones((n, 2)) if t == 0 else a[at - 1] @ m
        state = state * np.stack([1 - good[at], good[at]], axis=1)
        a[at] = np.maximum(state / state.sum(axis=1, keepdims=True), LEAST)
    for t, n in reversed(steps[1:]):
        at = chains.starts[:n] + t
        right = b[at] * np.stack([1 - good[at], good[at]], axis=1)
        both = a[at - 1][:, :, None] * m[None] * right[:, None, :]
        pairs[at] = both / both.sum(axis=(1, 2), keepdims=True)
        left = right @ m.T
        b[at - 1] = np.maximum(left / left.sum(axis=1, keepdims=True), LEAST)
    joint = a * b
    return joint[:, 1] / joint.sum(axis=1), pairs


def fit(codes: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Field:
    """Weights that maximise the penalised likelihood of the lines' labels; ``labels`` and ``weights`` are per document."""
    share = float(np.average(labels, weights=weights)) if len(labels) else 0.5
    field = Field(np.zeros((len(AROUND), WIDTH)), 0.0, np.zeros((2, 2)))
    if len(set(labels.tolist())) < 2:
        n = float(weights.sum()) if len(labels) else 0.0
        field.prior = (share * n + 1) / (n + 2)
        return field
    chains, order = Chains.of(codes, sizes)
    labels, weights = labels[order], weights[order]
    line = np.empty(len(codes), np.int64)
    for d, (s, n) in enumerate(zip(chains.starts, chains.sizes, strict=True)):
        line[s:s + n] = d
    y, w = labels[line].astype(np.float64), weights[line] / weights.sum() * len(weights)
    around = chains.shifted()
    inner = np.ones(len(codes), bool)
    inner[chains.starts] = False                              # lines with one before
    same = np.zeros((2, 2))
    for k in (0, 1):
        same[k, k] = w[inner & (y == k)].sum()                # all lines of a document share its label
    theta = np.zeros(len(AROUND) * WIDTH + 5)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, ROUNDS + 1):
        field.emission = theta[:-5].reshape(len(AROUND), WIDTH)
        field.bias, field.transition = float(theta[-5]), theta[-4:].reshape(2, 2)
        p, pairs = forward_backward(chains, field.odds(around), field.transition)
        gap = w * (y - p)
        grad = np.empty_like(theta)
        for k, c in enumerate(around):
            grad[k * WIDTH:(k + 1) * WIDTH] = np.bincount(c.ravel(), np.repeat(gap, c.shape[1]), WIDTH)
        grad[-5] = gap.sum()
        grad[-4:] = (same - (w[inner, None, None] * pairs[inner]).sum(axis=0)).ravel()
        grad = (grad - PENALTY * theta) / len(codes)
        first = 0.9 * first + 0.1 * grad                      # Adam
        second = 0.999 * second + 0.001 * grad ** 2
        theta = theta + STEP * (first / (1 - 0.9 ** r)) / (np.sqrt(second / (1 - 0.999 ** r)) + 1e-8)
    field.emission = theta[:-5].reshape(len(AROUND), WIDTH)
    field.bias, field.transition = float(theta[-5]), theta[-4:].reshape(2, 2)
    return field


def scores(field: Field, texts: list[bytes]) -> np.ndarray:
    """The length-weighted mean of the lines' probabilities, for each text."""
    if field.prior is not None:
        return np.full(len(texts), field.prior)
    rows, lengths, sizes = [], [], []
    for text in texts:
        r, n = traits(text)
        rows += r
        lengths += n
        sizes.append(len(r))
    sizes = np.array(sizes, np.int64)
    chains, _ = Chains.of(buckets(rows), sizes)
    p, _ = forward_backward(chains, field.odds(chains.shifted()), field.transition)
    starts = np.cumsum(sizes) - sizes
    weight = np.array(lengths, np.float64)
    total = np.add.reduceat(weight, starts)
    weight[np.repeat(total == 0, sizes)] = 1.0                # no character in any line: all lines alike
    return np.clip(np.add.reduceat(p * weight, starts) / np.add.reduceat(weight, starts), 0.0, 1.0)


# --- Spark --------------------------------------------------------------------

def held_out(doc_id: Column) -> Column:
    """A quarter of the documents, by the checksum of their id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        coded, ids = [], []
        for i, text in enumerate(batch.column(1)):
            text = text.as_py() or b""
            if text.count(b"\n") < SAMPLE_LINES:
                coded.append(buckets(traits(text)[0]).tobytes())
                ids.append(i)
        yield pa.record_batch({"id": batch.column(0).take(pa.array(ids, pa.int64())), "codes": pa.array(coded, pa.binary())})


def _bytes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text_bytes"))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit the field to ``labels`` (doc_id, ``label_col`` 0 or 1) and their documents."""
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).dropna()
             .groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other"))
             .filter("label = other and label in (0, 1)").select("id", "label").persist())
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}           # two rows
    chosen = None
    for label in sorted(totals):
        part = known.filter(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        return fit(np.zeros((0, len(TRAITS)), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    # at most 2 * SAMPLE_DOCS narrow rows
    texts = _bytes(docs, id_col, text_col).join(F.broadcast(chosen), "id", "left_semi")
    coded = texts.mapInArrow(_codes, "id long, codes binary").groupBy("id").agg(F.min("codes").alias("codes"))
    rows = coded.join(F.broadcast(chosen), "id").orderBy("id").collect()
    known.unpersist()
    own = [np.frombuffer(r["codes"], np.uint8).reshape(-1, len(TRAITS)) for r in rows]
    label = np.array([r["label"] for r in rows], np.int64)
    got = np.bincount(label, minlength=2)
    weight = np.array([totals[k] / got[k] for k in label.tolist()], np.float64)
    return fit(np.concatenate(own) if own else np.zeros((0, len(TRAITS)), np.uint8),
               np.array([len(c) for c in own], np.int64), label, weight)


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(astuple(field))       # plain arrays: workers hold no classes of this package

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*model.value)
        for batch in batches:
            lo, lines, texts = 0, 0, []
            for i, text in enumerate(batch.column(1)):
                texts.append(text.as_py() or b"")
                lines += texts[-1].count(b"\n") + 1
                if lines >= BATCH_LINES or i + 1 == batch.num_rows:
                    yield pa.record_batch({"doc_id": batch.column(0).slice(lo, i + 1 - lo),
                                           "score": pa.array(scores(own, texts), pa.float64())})
                    lo, lines, texts = i + 1, 0, []

    return _bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")
