"""The line field against sums over all labellings, and its queries' contract."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.llm import linecrf
from kiln.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, id long, label int, codes string, score double"


def plain_marginals(odds, transition):
    """P(good) of each line by summing over all labellings."""
    total, good = 0.0, np.zeros(len(odds))
    for labels in itertools.product((0, 1), repeat=len(odds)):
        weight = np.exp(sum(o for o, y in zip(odds, labels, strict=True) if y)
                        + sum(transition[a, b] for a, b in itertools.pairwise(labels)))
        total += weight
        good += weight * np.array(labels)
    return good / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    sizes = np.array([1, 4, 7, 2, 7, 1])
    odds, transition = rng.normal(size=sizes.sum()) * 3, rng.normal(size=(2, 2))
    codes = np.zeros((sizes.sum(), len(linecrf.TRAITS)), np.uint8)
    chains, _ = linecrf.Chains.of(codes, sizes)
    p, pairs = linecrf.forward_backward(chains, odds, transition)
    ends = np.cumsum(sizes)
    for lo, hi in zip(ends - sizes, ends, strict=True):
        assert np.allclose(p[lo:hi], plain_marginals(odds[lo:hi], transition))
        assert np.allclose(pairs[lo + 1:hi].sum(axis=1), np.stack([1 - p[lo + 1:hi], p[lo + 1:hi]], axis=1))


def test_neighbours_and_ends():
    codes = np.arange(5 * len(linecrf.TRAITS), dtype=np.uint8).reshape(5, -1)
    chains, order = linecrf.Chains.of(codes, np.array([2, 3]))
    assert order.tolist() == [1, 0]
    own, before, after = chains.shifted()
    assert (own == codes).all()
    assert (before[[0, 2]] == linecrf.OUTSIDE).all() and (before[[1, 3, 4]] == codes[[0, 2, 3]]).all()
    assert (after[[1, 4]] == linecrf.OUTSIDE).all() and (after[[0, 2, 3]] == codes[[1, 3, 4]]).all()


def test_traits_of_odd_lines():
    rows, lengths = linecrf.traits("né\n\nné\nA! A! A!".encode())
    assert lengths == [2, 0, 2, 8] and [r[-1] for r in rows] == [0.0, 0.0, 1.0, 0.0]
    assert linecrf.buckets(rows).shape == (4, len(linecrf.TRAITS)) and linecrf.buckets(rows).max() < linecrf.OUTSIDE
    assert linecrf.traits(b"")[1] == [0]


def test_score_is_the_length_weighted_mean():
    rng = np.random.default_rng(3)
    field = linecrf.Field(rng.normal(size=(3, linecrf.WIDTH)), 0.1, rng.normal(size=(2, 2)))
    text = "A line here.\n### $$$\n\nanother one of these lines"
    rows, lengths = linecrf.traits(text.encode())
    chains, _ = linecrf.Chains.of(linecrf.buckets(rows), np.array([len(rows)]))
    p = plain_marginals(field.odds(chains.shifted()), field.transition)
    assert linecrf.scores(field, [text.encode()])[0] == pytest.approx(np.average(p, weights=lengths))
    # in a batch with others, and where there is no character at all
    many = linecrf.scores(field, [b"x", text.encode(), b"", b"\n\n"])
    assert many[1] == pytest.approx(np.average(p, weights=lengths)) and ((many >= 0) & (many <= 1)).all()


def odd_rows():
    rng = random.Random(1)
    good = lambda: "\n".join(" ".join(rng.choice(["some", "Words", "here,", "and", "there."]) for _ in range(12)) for _ in range(4))
    bad = lambda: "\n".join(" ".join(rng.choice(["$$", "BUY", "##", "now!!"]) for _ in range(12)) for _ in range(4))
    docs = [(k, good() if k % 3 else bad()) for k in range(120)]
    labels = [(k, int(k % 3 > 0)) for k in range(90)] + [(0, 0), (1, 0), (None, 1), (5, None), (777, 1), (8, 7)]
    docs += [(200, None), (201, ""), (202, "\n\n"), (203, good() * 3000), (None, "text"), docs[4], docs[4], (4, "another text")]
    return docs, labels


def test_odd_rows(spark):
    docs, labels = odd_rows()
    d = spark.createDataFrame([(i, t, "en", 1, 1, "c", 0.5) for i, t in docs], SCHEMA).repartition(3)
    lab = spark.createDataFrame([(i, q, 1, 2, 3) for i, q in labels], "doc_id long, quality int, id long, label int, other int")
    field = linecrf.train(d, lab)
    rows = linecrf.score(d, field).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r.score)
    assert len(by[4]) == 4 and len(set(by[4])) == 2                        # equal texts score alike
    assert all((by[k][0] >= linecrf.ACCEPT) == (k % 3 > 0) for k in range(90, 120)) and by[203][0] >= linecrf.ACCEPT
    # the same rows in other partitions give the same field
    again = linecrf.train(d.repartition(7), lab.repartition(5))
    assert (again.emission == field.emission).all() and (again.transition == field.transition).all()


@pytest.mark.parametrize(("labels", "want"), [([], 0.5), ([(1, 1), (2, 1)], 0.75), ([(1, 0)], 1 / 3)])
def test_nothing_to_learn(spark, labels, want):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    field = linecrf.train(d, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert [r.score for r in linecrf.score(d, field).collect()] == pytest.approx([want] * 3)
    assert linecrf.score(d.limit(0), field).collect() == []


def test_query_held_out_accuracy(spark):
    """Held-out documents, and no look at their labels."""
    got = QUERIES["op12_line_crf"](spark, SF)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in rows)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    majority = max(sum(y for _, y in held), sum(1 - y for _, y in held)) / len(held)
    accuracy = sum(p == y for p, y in held) / len(held)
    assert len(held) > 50 and accuracy > majority and accuracy >= 0.97


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    own = ~linecrf.held_out(F.col("doc_id"))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(own, F.col("quality")).otherwise(1 - F.col("quality")))
    a, b = (linecrf.train(docs.filter(own), x.filter(own)) for x in (labels, turned))
    assert (a.emission == b.emission).all()
