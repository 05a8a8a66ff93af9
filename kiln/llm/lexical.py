"""Ranked lexical search over a length-stratified index.

A document's score is a sum, over the terms of the question, of the term's
weight times a saturating function of its frequency ``tf`` and of the normaliser
``m`` of the document's length.  Documents with an equal ``m`` form a stratum, and
within it every posting of a term with an equal ``tf`` has the same impact.  So the
index holds, per stratum, the postings of each term grouped by ``tf``, highest
first: an impact is computed once per group, the first group of each term gives
the stratum's bound for a question, and a question visits strata by falling
bounds until none can hold a document among its best.

Weights and normalisers use the statistics of all documents; the index is made
from the counted documents in blocks, wherever they lie, and is searched where
it lies: the best ``k`` of each part are merged.  Nothing is shuffled but the
counts per term and these few rows.  ``build`` may be told which terms will be
asked for, so that it leaves the others out.

Questions are searched in blocks of bounded size (``QUESTION_PAIRS``), which tasks
hold in memory; each block reads the index once.

Cases: null and blank texts hold no term and are in no result; repeated rows of
documents are ranked each; repeated questions are answered once, and different
texts under one id each for itself; equal scores are ranked by id, null first;
scores of 0 are left out; long texts are read whole; an empty table of either
kind gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.common import materialize

# --- fixed values -----------------------------------------------------------
TOP = 20
LENGTH_PERCENT = 25            # share of the length in the normaliser
SATURATION = 12                # of a term's frequency, in tenths
SCALE = 1_000_000_000
WEIGHT_SCALE = 1000
# -----------------------------------------------------------------------------

BLOCK_POSTINGS = 2_000_000     # of a block of the index: some 50 MB of arrays
QUESTION_PAIRS = 500_000       # (question, term) pairs that are searched for at once
KNOWN_TERMS = 1_000_000        # terms that tasks may hold to leave out all others

# bytes of a term: 0-9, A-Z in lower case, a-z, and those of any other character than ASCII
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TERM_BYTES).split()


@dataclass
class Index:
    strata: DataFrame          # m, docs, terms, groups, tfs, sizes, members: one row per stratum and block
    weights: DataFrame         # term, df, weight
    n_docs: int                # documents with a term
    n_terms: int               # their terms with repeats


def _count(known: Callable[[], frozenset[bytes] | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known()
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column(1):
                found = terms_of(text.as_py() or b"")
                counts = Counter(found)
                own = sorted(counts if wanted is None else counts.keys() & wanted)
                n.append(len(found))
                terms.append(own)
                tfs.append([counts[t] for t in own])
            yield pa.record_batch({
                "id": batch.column(0), "n": pa.array(n, pa.int64()),
                "terms": pa.array(terms, pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                "tfs": pa.array(tfs, pa.list_(pa.int64()))})
    return run


def counted(rows: DataFrame, id_col: str, text_col: str, known=lambda: None) -> DataFrame:
    """id, n (terms with repeats), terms (distinct), tfs."""
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text_bytes")).mapInArrow(
        _count(known), "id long, n long, terms array<string>, tfs array<long>")


def _split(values: np.ndarray, at: np.ndarray, ends: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(at, ends), pa.int32()), values if isinstance(values, pa.Array) else pa.array(values))


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where the columns' values change, in sorted rows."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.nonzero(new)[0]


def _strata(held: list[pa.RecordBatch], n_docs: int, n_terms: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(held).combine_chunks()
    ids, n, lists, tf = (table.column(c).chunk(0) for c in ("id", "n", "terms", "tfs"))
    none = np.asarray(ids.is_null())
    ids = np.where(none, np.int64(0), np.asarray(ids.fill_null(0)))
    m = 100 - LENGTH_PERCENT + (LENGTH_PERCENT * np.asarray(n) * n_docs) // n_terms
    lens = np.diff(np.asarray(lists.offsets))
    coded = lists.flatten().dictionary_encode()
    code, tf = np.asarray(coded.indices), np.asarray(tf.flatten())
    order = np.lexsort((ids, ~none, m))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    m, ids, none = m[order], ids[order], none[order]
    doc = np.repeat(place, lens)
    by = np.lexsort((doc, -tf, code, m[doc]))
    doc, code, tf = doc[by], code[by], tf[by]
    first = _starts(m)                                       # of each stratum
    stratum = np.searchsorted(first, doc, side="right") - 1
    group, term = _starts(stratum, code, tf), _starts(stratum, code)
    whole = np.arange(len(first))

    def at(starts: np.ndarray, end: int) -> np.ndarray:      # offsets of the strata in a list of groups or terms
        return np.searchsorted(stratum[starts] if len(starts) else starts, whole), end

    per_group = np.diff(np.append(group, len(doc)))
    per_term = np.diff(np.append(np.searchsorted(group, term), len(group)))
    docs = pa.array(ids, pa.int64(), mask=none)
    names = coded.dictionary.take(pa.array(code[term])) if len(term) else pa.array([], pa.string())
    return pa.record_batch({
        "m": pa.array(m[first]), "docs": _split(docs, first, len(ids)),
        "terms": _split(names, *at(term, len(term))), "groups": _split(per_term, *at(term, len(term))),
        "tfs": _split(tf[group], *at(group, len(group))), "sizes": _split(per_group, *at(group, len(group))),
        "members": _split(doc - first[stratum], *at(np.arange(len(doc)), len(doc)))})


def _stratify(n_docs: int, n_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += len(batch.column(2).flatten()) + batch.num_rows
            if size >= BLOCK_POSTINGS:
                yield _strata(held, n_docs, n_terms)
                held, size = [], 0
        if held:
            yield _strata(held, n_docs, n_terms)
    return run


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> Index:
    """Index every document; with ``known`` (term) only the postings of these terms, if they are not too many to hold."""
    spark = docs.sparkSession
    hold = lambda: None
    if known is not None:
        known = materialize(known.select("term").distinct())
        if known.count() <= KNOWN_TERMS:
            held = spark.sparkContext.broadcast(frozenset(r[0].encode() for r in known.collect()))
            hold = lambda: held.value
    rows = materialize(counted(docs, id_col, text_col, hold).filter("n > 0"))
    n_docs, n_terms = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ratio = F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double")
    weights = df.withColumn("weight", F.floor(WEIGHT_SCALE * F.log(ratio)).cast("long"))
    strata = rows.mapInArrow(_stratify(n_docs, n_terms), (
        "m long, docs array<long>, terms array<string>, groups array<long>, tfs array<long>, sizes array<long>, members array<long>"))
    return Index(materialize(strata), materialize(weights), n_docs, n_terms)


# --- search -----------------------------------------------------------------

class Questions:
    """A block of questions: terms as places in a vocabulary, with their weights."""

    def __init__(self, rows: list[tuple[int, list[tuple[str, int, int]]]]):
        names = sorted({t for _, terms in rows for t, _, _ in terms})
        place = {t: k for k, t in enumerate(names)}
        self.names = pa.array(names, pa.string())
        self.weight = np.zeros(len(names), np.int64)
        self.keys = [key for key, _ in rows]
        self.terms, self.times = [], []
        for _, terms in rows:
            self.terms.append(np.array([place[t] for t, _, _ in terms], np.int64))
            self.times.append(np.array([c for _, c, _ in terms], np.int64))
            for t, _, w in terms:
                self.weight[place[t]] = w
        self.flat = np.concatenate(self.terms) if rows else np.zeros(0, np.int64)
        self.flat_times = np.concatenate(self.times) if rows else np.zeros(0, np.int64)
        self.starts = np.cumsum([0, *[len(t) for t in self.terms]])[:-1]

    def bounds(self, best: np.ndarray) -> np.ndarray:
        """The highest possible score of each question, from the best impact of each term."""
        return np.add.reduceat(self.flat_times * best[self.flat], self.starts) if len(self.flat) else np.zeros(0, np.int64)


class Stratum:
    """Postings of the questions' terms in one row of the index, with their weighted impacts."""

    def __init__(self, row: dict, questions: Questions):
        m, docs = row["m"], row["docs"]
        self.none = np.asarray(docs.is_null())
        self.docs = np.asarray(docs.fill_null(0))
        place = np.asarray(pc.fill_null(pc.index_in(row["terms"], value_set=questions.names), -1)).astype(np.int64)
        tfs, sizes, groups = (np.asarray(row[c]) for c in ("tfs", "sizes", "groups"))
        impact = (SCALE * tfs) // (1000 * tfs + SATURATION * m)          # once per tf
        group_end = np.cumsum(groups)
        member_end = np.cumsum(sizes)
        self.members = np.asarray(row["members"])
        weight = np.where(place >= 0, questions.weight[place] if len(questions.weight) else 0, 0)
        self.value = np.repeat(np.repeat(weight, groups) * impact, sizes)   # of each posting
        asked = place >= 0
        size = len(questions.weight)
        self.best, self.lo, self.hi = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
        if asked.any():
            head = (group_end - groups)[asked]
            self.best[place[asked]] = weight[asked] * impact[head]           # groups go down in tf
            self.lo[place[asked]] = (member_end - sizes)[head]
            self.hi[place[asked]] = member_end[group_end[asked] - 1]

    def scores(self, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.docs), np.int64)
        lo, hi = self.lo[terms], self.hi[terms]
        for k in np.nonzero(hi > lo)[0]:
            part = slice(lo[k], hi[k])
            out[self.members[part]] += times[k] * self.value[part]           # a document is once in a term's postings
        return out


class Best:
    """The best ``k`` documents of a question so far: highest score, then smallest id, null first."""

    def __init__(self, k: int):
        self.k = k
        self.score, self.docs, self.none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """What a document must reach: the score of the last place, 1 while places are free."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, docs: np.ndarray, none: np.ndarray) -> None:
        found = np.nonzero(score >= self.least)[0]
        if not len(found):
            return
        if len(found) > 4 * self.k:      # all that reach the k-th score, ties included
            found = found[score[found] >= np.partition(score[found], -self.k)[-self.k]]
        score, docs, none = (np.concatenate(x) for x in (
            (self.score, score[found]), (self.docs, docs[found]), (self.none, none[found])))
        order = np.lexsort((docs, ~none, -score))[:self.k]
        self.score, self.docs, self.none = score[order], docs[order], none[order]


def _search(questions: Callable[[], Questions], k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = questions()
        best = [Best(k) for _ in asked.keys]

        def visit(strata: list[Stratum]) -> None:
            if not asked.keys:
                return
            bounds = np.stack([asked.bounds(s.best) for s in strata])
            order = np.argsort(-bounds, axis=0, kind="stable")
            for q, own in enumerate(best):
                for s in order[:, q]:                 # by falling bounds: beyond the first that is too low, all are
                    if bounds[s, q] < own.least:
                        break
                    own.add(strata[s].scores(asked.terms[q], asked.times[q]), strata[s].docs, strata[s].none)

        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values for c in ("docs", "terms", "groups", "tfs", "sizes", "members")}
                held.append(Stratum(row | {"m": batch.column("m")[i].as_py()}, asked))
                size += len(row["members"]) + len(asked.weight)
                if size >= 2 * BLOCK_POSTINGS:
                    visit(held)
                    held, size = [], 0
        if held:
            visit(held)
        keys = np.repeat(np.array(asked.keys, np.int64), [len(b.score) for b in best])
        if len(keys):
            docs, none, score = (np.concatenate([getattr(b, c) for b in best]) for c in ("docs", "none", "score"))
            yield pa.record_batch({"question": pa.array(keys), "doc_id": pa.array(docs, pa.int64(), mask=none),
                                   "score": pa.array(score, pa.int64())})
    return run


def search(index: Index, items: DataFrame, k: int = TOP, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each question with a score above 0."""
    spark = items.sparkSession
    asked = counted(items.select(F.col(id_col), F.col(text_col)).distinct(), id_col, text_col).withColumn(
        "question", F.monotonically_increasing_id())
    asked = materialize(asked)
    pairs = asked.select("question", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(
        "question", F.col("t.terms").alias("term"), F.col("t.tfs").alias("times"))
    pairs = materialize(pairs.join(index.weights.filter("weight > 0"), "term").groupBy("question").agg(
        F.collect_list(F.struct("term", "times", "weight")).alias("terms")))
    n_blocks = -(-(pairs.agg(F.sum(F.size("terms"))).first()[0] or 0) // QUESTION_PAIRS)
    found = spark.createDataFrame([], "question long, doc_id long, score long")
    for b in range(n_blocks):
        rows = pairs.filter(F.pmod(F.xxhash64("question"), F.lit(n_blocks)) == b).collect()      # a bounded block
        block = spark.sparkContext.broadcast([(r["question"], [tuple(t) for t in r["terms"]]) for r in rows])
        part = index.strata.mapInArrow(_search(lambda block=block: Questions(block.value), k),
                                       "question long, doc_id long, score long")
        found = found.unionByName(part) if b else part
    order = Window.partitionBy("question").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    top = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return top.join(asked.select("question", F.col("id").alias("item_id")), "question").select("item_id", "rank", "doc_id", "score")


def rank(items: DataFrame, docs: DataFrame, k: int = TOP) -> DataFrame:
    """Index ``docs`` for the terms of ``items``, and search."""
    terms = counted(items, "item_id", "text").select(F.explode("terms").alias("term"))
    return search(build(docs, known=terms), items, k)
