"""Ranked search against a plain scorer over all pairs."""

import math
import random
import re
from collections import Counter

import pytest

from kiln.llm import lexical

DOCS = "doc_id long, text string, id long, n long, terms string, question long, score long"
ITEMS = "item_id long, text string, id long, term string, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(items, docs, k):
    counted = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        asked, found = Counter(terms(text)), []
        for doc_id, c, n in counted:
            m = 75 + (25 * n * n_docs) // n_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 12 * m))
                    for t, times in asked.items() if c[t])
            if s > 0:
                found.append((-s, doc_id is not None, doc_id or 0, doc_id))
        out += [(item, r, f[3], -f[0]) for r, f in enumerate(sorted(found, key=lambda f: f[:3])[:k], 1)]
    return sorted(out, key=repr)


def run(spark, items, docs, k=lexical.TOP):
    d = spark.createDataFrame([(i, t, 1, 2, "t", 3, 4) for i, t in docs], DOCS).repartition(4)
    q = spark.createDataFrame([(i, t, 1, "t", 2) for i, t in items], ITEMS)
    got = lexical.rank(q, d, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    words = ["the", "Of", "and"] * 20 + ["w%d" % rng.randrange(300) for _ in range(300)] + ["Größe", "ÄÖ", "naïve", "x1"]
    docs = [(k, rng.choice([" ", "-", "\n"]).join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 20, 60, 400])))) for k in range(400)]
    docs += [(1000 + k, docs[7][1]) for k in range(120)]               # many equal scores
    docs += [docs[3], docs[3], (5, "w1 w1 w2"), (None, docs[9][1]), (None, docs[9][1] + " more"), (50, None), (51, ""), (52, " .,\x7f "),
             (53, "w7 " * 30_000), (54, " ".join(words * 40))]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 4, 30])))) for k in range(25)]
    items += [(25, docs[7][1]), (26, "W1 w1 W1 w2"), (27, None), (28, ""), (29, "unknown words"), items[0], (0, "other text w3"), (None, "w4 the")]
    return items, docs


def test_equals_all_pairs(spark, corpus):
    assert run(spark, *corpus) == plain(*corpus, lexical.TOP)


def test_small_blocks(spark, corpus, monkeypatch):
    """Many blocks of the index and of the questions give the same."""
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 500)
    monkeypatch.setattr(lexical, "QUESTION_PAIRS", 60)
    assert run(spark, *corpus, 5) == plain(*corpus, 5)


def test_whole_index_searched_later(spark, corpus, monkeypatch):
    """Without the questions' terms at hand (or with too many of them) every term is indexed."""
    items, docs = corpus
    monkeypatch.setattr(lexical, "KNOWN_TERMS", 1)
    assert run(spark, items, docs) == plain(items, docs, lexical.TOP)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == run(spark, [(1, "a")], []) == run(spark, [(1, "b")], [(1, "a"), (2, None)]) == []


def test_strata_out_of_reach_are_not_scored(spark, monkeypatch):
    """Bounds order the visits and end them."""
    rng = random.Random(8)
    docs = [(k, " ".join("w%d" % int(200 * rng.random() ** 3) for _ in range(rng.randint(5, 400)))) for k in range(3000)]
    index = lexical.build(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    counts = Counter(t for _, x in docs for t in set(x.split()))
    rare = [t for t, _ in counts.most_common()[60:62]]
    weights = {r.term: r.weight for r in index.weights.collect()}
    asked = lexical.Questions([(0, [(t, 1, weights[t]) for t in rare])])
    seen, visited = [], []
    scores = lexical.Stratum.scores
    made = lexical.Stratum.__init__
    monkeypatch.setattr(lexical.Stratum, "scores", lambda s, *a: visited.append(1) or scores(s, *a))
    monkeypatch.setattr(lexical.Stratum, "__init__", lambda s, *a: seen.append(1) or made(s, *a))
    batches = [b for b in index.strata.toArrow().to_batches()]
    list(lexical._search(lambda: asked, 3)(iter(batches)))
    assert len(seen) > 40 and len(visited) < 0.6 * len(seen), (len(seen), len(visited))
