"""Near-duplicate documents by min-max hashing.

Every hash function is evaluated once per shingle and gives two signature
values, its minimum and its maximum.  Bands of four values (two functions) find
candidates; every link is confirmed on the full shingle sets.

How the work stays bounded:

* documents with equal shingle sets form one class and go on as one row;
* in a bucket, members are first compared with one leader, not with each other;
  links found that way are closed to components, and only members of different
  components are compared afterwards: those of small buckets by a join, those of
  large ones in blocks of bounded size, where each pair has one bucket;
* a pair reaches the exact check only if its signatures agree well enough.  The
  limit lies 4.5 standard deviations below the threshold.

With 32 bands of 4 values a pair at similarity 0.75 is missed by all bands with
probability 0.684**32 = 5e-6, at 0.8 with 5e-8.

Cases: null or blank texts have no shingles and link with nothing; fewer than
five words make one shingle; a null id forms no class and is its own result
(component null, kept); repeated rows give repeated result rows, and different
texts under one id count as one node of the link graph; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import shingles
from kiln.llm.common import join_unique, materialize, row_struct
from kiln.llm.graph import components
from kiln.operators.indexing import row_index

WIDTH = 5
THRESHOLD_PERCENT = 75
BANDS = 32
FUNCTIONS = 2 * BANDS            # each gives a minimum and a maximum; two functions make a band of four values
SIGNATURE = 2 * FUNCTIONS        # one byte kept of each value
MIN_AGREEMENT = 0.58             # of the signature bytes: 0.75 - 4.5 * sqrt(0.75 * 0.25 / 128)
BLOCK = 512                      # members of a bucket block that meet in one task
SMALL_BUCKET = 24                # up to this, a bucket's members are paired by a join
BROADCAST_IDS = 2_000_000        # ids broadcast to pick candidate texts (16 MB); beyond, a shuffle join
_rng = np.random.default_rng(20)
_MUL = _rng.integers(1, 1 << 63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, FUNCTIONS, dtype=np.uint64)


def _distinct_by_row(hashes: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row, and the counts before each row."""
    parts = [np.unique(hashes[a:b]) for a, b in zip(before[:-1], before[1:], strict=True)]
    sizes = np.fromiter((len(p) for p in parts), dtype=np.int64, count=len(parts))
    return (np.concatenate(parts) if parts else hashes[:0]), np.concatenate([[0], np.cumsum(sizes)])


def _row_sets(texts: pa.Array, powers: shingles.Powers) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for row, end, data, offsets in shingles.slices(texts):
        starts, ends, before = shingles.word_bounds(data, offsets)
        hashed = shingles.word_hashes(data, starts, ends, powers)
        grams, at = shingles.shingle_hashes(hashed, before, WIDTH)
        yield row, end, *_distinct_by_row(grams, at)


def _signed(lists: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(lists).reshape(-1).view(np.int64))
    return pa.ListArray.from_arrays(pa.array(np.arange(0, lists.size + 1, lists.shape[1], dtype=np.int32)), flat)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, set digest (d1, d2), band keys, signature bytes."""
    powers = shingles.Powers()
    salt = shingles.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        for row, end, sets, at in _row_sets(batch.column(1), powers):
            n = np.diff(at)
            full = np.flatnonzero(n)
            low = np.zeros((end - row, FUNCTIONS), dtype=np.uint64)
            high = np.zeros((end - row, FUNCTIONS), dtype=np.uint64)
            d1 = np.zeros(end - row, dtype=np.uint64)
            d2 = np.zeros(end - row, dtype=np.uint64)
            if len(full):
                cuts = at[:-1][full]
                for j in range(FUNCTIONS):
                    v = sets * _MUL[j] + _ADD[j]
                    low[full, j] = np.minimum.reduceat(v, cuts)
                    high[full, j] = np.maximum.reduceat(v, cuts)
                d1[full] = np.add.reduceat(sets, cuts)
                d2[full] = np.add.reduceat(shingles.mix(sets + np.uint64(7)), cuts)
            low, high = shingles.mix(low), shingles.mix(high + np.uint64(1))
            keys = (low[:, 0::2] + high[:, 0::2] * np.uint64(3) + low[:, 1::2] * np.uint64(5)
                    + high[:, 1::2] * np.uint64(9))
            keys = shingles.mix(shingles.mix(keys) + salt)
            sig = np.concatenate([low, high], axis=1).astype(np.uint8)
            yield pa.record_batch({
                "doc_id": batch.column(0).slice(row, end - row).cast(pa.int64()),
                "n_shingles": pa.array(n.astype(np.int64)),
                "d1": pa.array(d1.view(np.int64)), "d2": pa.array(d2.view(np.int64)),
                "keys": _signed(keys),
                "sig": pa.array([x.tobytes() for x in sig], type=pa.binary())})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, d1, shingles: the distinct shingle hashes of each text and their sum."""
    powers = shingles.Powers()
    for batch in batches:
        for row, end, sets, at in _row_sets(batch.column(1), powers):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sets, dtype=np.uint64)])
            yield pa.record_batch({
                "rep": batch.column(0).slice(row, end - row).cast(pa.int64()),
                "d1": pa.array((total[at[1:]] - total[at[:-1]]).view(np.int64)),
                "shingles": pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))})


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def _signatures(column: pa.Array | pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(x) for x in column), dtype=np.uint8).reshape(-1, SIGNATURE)


def _agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) whose signatures agree, from (a, b, sig_a, sig_b)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        share = _agreement(_signatures(batch.column(2).to_pylist()), _signatures(batch.column(3).to_pylist()))
        good = np.flatnonzero(share >= MIN_AGREEMENT)
        yield pa.record_batch({"a": batch.column(0).take(pa.array(good)), "b": batch.column(1).take(pa.array(good)),
                               "share": pa.array(share[good])})


def _block_links(group: pd.DataFrame) -> pd.DataFrame:
    """Confirmed links between two blocks (or within one) of a bucket.

    A group holds at most about two blocks of members with their sets.  A pair
    is looked at in the first band that it shares, and only while its ends are
    not connected by links found here.
    """
    i, j, band = (int(group[c].iloc[0]) for c in ("i", "j", "band"))
    left, right = (group[group["block"] == x].sort_values("rep") for x in (i, j))
    sig, node = _signatures(right["sig"]), right["rep"].to_numpy()
    size, sets = right["n_shingles"].to_numpy(), [np.asarray(x) for x in right["shingles"]]
    earlier = np.array([np.asarray(x)[:band] for x in right["keys"]]).reshape(len(right), band)
    home = dict(zip(group["rep"], group["component"], strict=True))
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    out = []
    for one in left.itertuples(index=False):
        near = ((100 * np.minimum(size, one.n_shingles) >= THRESHOLD_PERCENT * np.maximum(size, one.n_shingles))
                & ~(earlier == np.asarray(one.keys)[:band]).any(axis=1))
        if i == j:
            near &= node > one.rep
        at = np.flatnonzero(near)
        share = _agreement(sig[at], np.frombuffer(bytes(one.sig), dtype=np.uint8))
        own = np.asarray(one.shingles)
        for k in at[share >= MIN_AGREEMENT][np.argsort(-share[share >= MIN_AGREEMENT], kind="stable")]:
            x, y = top(home[one.rep]), top(home[int(node[k])])
            if x == y:
                continue
            shared = len(np.intersect1d(own, sets[k], assume_unique=True))
            if 100 * shared >= THRESHOLD_PERCENT * (len(own) + len(sets[k]) - shared):
                above[max(x, y)] = min(x, y)
                out.append((one.rep, int(node[k])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


class _Linker:
    """Confirms candidate pairs and keeps the components of the links so far."""

    def __init__(self, reps: DataFrame, sets: DataFrame):
        self.reps, self.sets = reps, sets
        self.labels: DataFrame | None = None     # (node, component) of nodes with a link

    def labelled(self, df: DataFrame, node: str, out: str) -> DataFrame:
        if self.labels is None:
            return df.withColumn(out, F.col(node))
        names = self.labels.select(F.col("node").alias(node), F.col("component").alias(out))
        return df.join(names, node, "left").withColumn(out, F.coalesce(out, node))

    def agreeing(self, pairs: DataFrame) -> DataFrame:
        """Distinct candidate pairs (a < b) that can reach the threshold by sizes and signatures."""
        side = {x: self.reps.select(F.col("rep").alias(x), F.col("sig").alias(f"sig_{x}"),
                                    F.col("n_shingles").alias(f"n_{x}")) for x in "ab"}
        pairs = materialize(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        n = pairs.count()
        both = join_unique(join_unique(pairs, side["a"], "a", rows=n), side["b"], "b", _counts(pairs, "b"), n, False)
        both = both.filter(100 * F.least("n_a", "n_b") >= THRESHOLD_PERCENT * F.greatest("n_a", "n_b"))
        return materialize(both.select("a", "b", "sig_a", "sig_b").mapInArrow(
            _agreeing, "a long, b long, share double"))

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (materialised) that pass the exact test on the full sets."""
        side = {x: self.sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "ab"}
        n = pairs.count()
        both = join_unique(join_unique(pairs, side["a"], "a", rows=n), side["b"], "b", _counts(pairs, "b"), n, False)
        shared = F.size(F.array_intersect("s_a", "s_b"))
        union = F.size("s_a") + F.size("s_b") - shared
        return both.filter(100 * shared >= THRESHOLD_PERCENT * union).select("a", "b")

    def add(self, links: DataFrame) -> None:
        """Close the components over more links."""
        if self.labels is not None:
            links = links.unionByName(
                self.labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
        self.labels = components(links)


def _counts(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def _best(pairs: DataFrame) -> DataFrame:
    """Of each node's pairs with a smaller node, the one that agrees best."""
    return pairs.groupBy("b").agg(F.max(F.struct("share", "a")).alias("t")).select(F.col("t.a").alias("a"), "b")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, d1, d2, keys, sig of every row."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _fingerprints, "doc_id long, n_shingles long, d1 long, d2 long, keys array<long>, sig binary")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    prints = materialize(fingerprints(docs, id_col, text_col))
    # one row per distinct shingle set, under its smallest id
    classes = (prints.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
               .groupBy("n_shingles", "d1", "d2")
               .agg(F.min(F.struct("doc_id", "keys", "sig")).alias("m"), F.count(F.lit(1)).alias("n")))
    classes = materialize(classes.select("n_shingles", "d1", "d2", "n", "m.*").withColumnRenamed("doc_id", "rep"))
    linker = _link(classes, docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text")))
    named = linker.labelled(classes.select("rep", "n_shingles", "d1", "d2", "n"), "rep", "component_id")
    return _named(prints, named)


def _with_nodes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_row, _id, _text and _node: a number for each (id, text) that rises with the id."""
    rows = materialize(docs.select(row_struct(docs), F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
                       .filter("_id is not null").withColumn("_key", F.struct("_id", F.sha2("_text", 256).alias("h"))))
    nodes = row_index(rows.select("_key").distinct(), "_key", name="_node").select(
        F.col("_key._id").alias("_nid"), F.coalesce("_key.h", F.lit("")).alias("_nh"), "_node")
    same = (F.col("_key._id") == F.col("_nid")) & (F.coalesce("_key.h", F.lit("")) == F.col("_nh"))
    return rows.join(nodes, same).select("_row", "_id", "_text", "_node")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id, with its own columns.

    Rows with a null id are kept.  Different texts under one id are judged each
    for itself, in order of their SHA-256; of rows with equal id and text one stays.
    """
    rows = docs.select(row_struct(docs), F.col(id_col).cast("long").alias("_id"))
    clash = (docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
             .filter("_id is not null").groupBy("_id").agg((F.min("h") != F.max("h")).alias("c")).filter("c"))
    if not clash.isEmpty():
        own = materialize(_with_nodes(docs, id_col, text_col))
        found = near_duplicates(own.select(F.col("_node").alias("doc_id"), F.col("_text").alias("text")))
        picked = materialize(found.filter("kept").select(F.col("doc_id").alias("_node")).distinct())
        kept = own.select("_row", "_node").join(picked, "_node", "left_semi").dropDuplicates(["_node"])
        return kept.select("_row").unionByName(rows.filter("_id is null").select("_row")).select("_row.*")
    found = materialize(near_duplicates(docs, id_col, text_col).filter("kept and doc_id is not null").select("doc_id"))
    ids = found.distinct()
    n = ids.count()
    picked = ids.withColumnRenamed("doc_id", "_id")
    kept = rows.join(F.broadcast(picked) if n <= BROADCAST_IDS else picked, "_id", "left_semi")
    if found.count() > n:
        kept = kept.dropDuplicates(["_id"])
    return kept.unionByName(rows.filter("_id is null")).select("_row.*")


def _named(prints: DataFrame, named: DataFrame) -> DataFrame:
    """Hand the class's component to every document.  A hot class never meets in one task."""
    digest = F.concat_ws(":", "n_shingles", "d1", "d2").alias("class")
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    named = materialize(named.select(digest, "component_id", "n"))
    rows = join_unique(prints.filter(linked).select("doc_id", "n_shingles", digest),
                       named.select("class", "component_id"), "class", named.select("class", "n"))
    alone = prints.filter(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return (rows.select("doc_id", "n_shingles", "component_id").unionByName(alone)
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def _link(classes: DataFrame, texts: DataFrame) -> _Linker:
    bands = classes.select("rep", F.posexplode("keys").alias("band", "key"))
    # the leader of a bucket is the member with the smallest hash, so a document leads in many of its bands
    order = F.struct(F.xxhash64("rep").alias("h"), F.col("rep"))
    buckets = materialize(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("lead"))
                          .filter("n > 1").select("key", "n", F.col("lead.rep").alias("leader")))
    members = materialize(join_unique(bands, buckets.select("key", "leader"), "key", buckets.select("key", "n"),
                                      rows=BANDS * classes.count()))
    ids = materialize(members.select("rep").distinct())
    few = ids.count() <= BROADCAST_IDS
    own = texts.join(F.broadcast(ids) if few else ids, "rep", "left_semi")
    sets = materialize(own.mapInArrow(_sets, "rep long, d1 long, shingles array<long>")
                       .groupBy("rep", "d1").agg(F.max("shingles").alias("shingles")).select("rep", "shingles"))
    reps = materialize(classes.join(ids, "rep", "left_semi").select("rep", "sig", "n_shingles", "keys"))
    linker = _Linker(reps, sets)
    # a group of m copies costs about m exact checks here, and is one component afterwards
    led = linker.agreeing(members.filter("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")))
    linker.add(linker.confirmed(materialize(_best(led))))
    linker.add(_rest(linker, members))
    return linker


def _rest(linker: _Linker, members: DataFrame) -> DataFrame:
    """Links between members of a bucket that are still in different components."""
    m = materialize(linker.labelled(members.select("key", "band", "rep"), "rep", "component"))
    open_ = (m.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                  F.count(F.lit(1)).alias("n"))
             .filter("lo <> hi").select("key", "n"))
    m = materialize(join_unique(m, materialize(open_), "key", open_))
    small, large = m.filter(F.col("n") <= SMALL_BUCKET), m.filter(F.col("n") > SMALL_BUCKET)
    other = small.select("key", F.col("rep").alias("b"), F.col("component").alias("cb"))
    near = linker.agreeing(small.select("key", F.col("rep").alias("a"), F.col("component").alias("ca"))
                           .join(other, "key").filter("a < b and ca <> cb").select("a", "b"))
    links = linker.confirmed(near.select("a", "b"))
    if large.isEmpty():
        return links
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    placed = large.select("key", "band", "rep", "component", blocks.alias("blocks")).withColumn(
        "block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # one row for each pair of blocks in which a member's block takes part
    placed = placed.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("i", F.least("block", "k")).withColumn("j", F.greatest("block", "k"))
    payload = linker.reps.join(linker.sets, "rep")
    placed = placed.join(payload, "rep").select(
        "key", "band", "i", "j", "block", "rep", "component", "n_shingles", "sig", "keys", "shingles")
    return links.unionByName(placed.groupBy("key", "i", "j").applyInPandas(_block_links, "a long, b long"))
