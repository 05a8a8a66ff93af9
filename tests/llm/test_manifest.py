"""Merkle manifest against a plain tree in memory."""

import random
import zlib
from hashlib import sha256

import pytest

from kiln.llm import manifest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, k string, g long, pos long, size long, "
          "width long, digest string")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(s):
    return sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def plain(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in by[lang]])
    top = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for g, lang in enumerate(langs):
        for p, r in enumerate(by[lang]):
            forged = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
                forged = (*r[:4], r[4].translate(LOWER))
            node, siblings = leaf(forged), ""
            for levels, i in ((trees[lang], p), (top, g)):
                for nodes in levels[:-1]:
                    run = nodes[i // 8 * 8:i // 8 * 8 + 8]
                    left, right = "".join(run[:i % 8]), "".join(run[i % 8 + 1:])
                    siblings += left + right
                    node = h(left + node + right)
                    i //= 8
            out.append((r[0], leaf(r), trees[lang][-1][0], top[-1][0], h(siblings), node, node == top[-1][0]))
    return sorted(out, key=repr)


def run(spark, rows):
    extra = [(i, t, lang, s, n, "x", 1, 2, 3, 4, "d") for i, s, lang, n, t in rows]
    got = manifest.report(spark.createDataFrame(extra, SCHEMA).repartition(3))
    assert got.columns[:7] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def rows_of(sizes, seed=3):
    rng = random.Random(seed)
    out = []
    for lang, n in sizes.items():
        for _ in range(n):
            out.append((rng.randrange(10 ** 6), rng.choice(["web", None, "ÄÖ"]), lang, rng.randrange(99),
                        rng.choice(["Some TEXT É", "lower only", "", None, "A" * 20_000])))
    return out


@pytest.mark.parametrize("sizes", [
    {"en": 700, None: 9, "": 1, "de": 64, "é": 8, "zz": 513},      # several tiers, whole and broken runs, single leaves
    {f"l{k}": 1 + k % 3 for k in range(70)},                        # a tree of several levels over the subroots
])
def test_equals_plain_tree(spark, sizes):
    rows = rows_of(sizes)
    rows += [rows[0], rows[0], (None, None, None, None, None), (None, "s", "en", 1, "T"), (rows[1][0], "s", "en", 2, "other text")]
    assert run(spark, rows) == plain(rows)


def test_many_tiers(spark, monkeypatch):
    """Small partitions: five tiers for the same trees."""
    monkeypatch.setattr(manifest, "TIER", 1)
    monkeypatch.setattr(manifest, "CHUNK", 8)
    rows = rows_of({"en": 600, "de": 65, "fr": 64, "es": 1})
    assert run(spark, rows) == plain(rows)


def test_single_and_empty(spark):
    one = [(5, "a", "en", 1, "Text")]
    assert run(spark, one) == plain(one)
    assert run(spark, []) == []


def test_only_tampered_texts_fail(spark):
    rows = [(i, "s", "en", 3, "Abc") for i in range(60)]
    for doc_id, *_, verified in run(spark, rows):
        assert verified == (zlib.crc32(str(doc_id).encode()) % 3 != 0)


def test_missing_is_the_least_set():
    """Any range of leaves: with the fetched nodes every proof can be written, and none can be left out."""
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(1, 400)
        lo = rng.randrange(n)
        hi = rng.randrange(lo + 1, n + 1)
        wide = manifest.widths(n)
        levels = tree([str(i) for i in range(n)])
        wanted = manifest.missing(lo, hi, 0, wide)
        derived = {(k, i) for k in range(len(wide)) for i in range(wide[k])
                   if i * 8 ** k >= lo and min(n, (i + 1) * 8 ** k) <= hi}
        needed = set()
        for p in range(lo, hi):
            for k in range(len(wide) - 1):
                q = p // 8 ** k
                needed |= {(k, i) for i in range(q // 8 * 8, min(wide[k], q // 8 * 8 + 8)) if i != q}
        on_the_way = {(k, p // 8 ** k) for p in range(lo, hi) for k in range(len(wide))}
        assert set(wanted) == needed - derived - on_the_way and len(wanted) == len(set(wanted))
        known = {k: (s, nodes) for k, s, nodes in manifest.interiors(
            lo, levels[0][lo:hi], 0, wide, {c: levels[c[0]][c[1]] for c in wanted})}
        for p in range(lo, hi):
            for k, left, right in manifest.climb(p, 0, wide, known):
                for i, d in left + right:
                    assert levels[k][i] == d
