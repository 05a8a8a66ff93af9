"""Merkle manifest of a document table, with a proof for every document.

Leaves are SHA-256 digests of the encoded rows.  The leaves of a language, in
order of ``doc_id``, are the floor of a tree whose nodes have eight children;
the tops of these trees (subroots), in order of the language, are the floor of
one more tree, whose top is the root.  A document's proof is the siblings on its
way to the root.

The proofs come as an octopus multiproof.  The leaves are dealt into partitions
of ``CHUNK`` neighbours.  A partition works out which nodes it lacks to reach the
root from all of its leaves at once (``missing``: the least set of coordinates),
gets them as one row, derives the interiors that its leaves share, and writes
the proof of each leaf from there.  The partitions' tops are the leaves of the
next tier, dealt the same way: from the bottom up, tiers fold into the root;
from the top down, a tier's proofs are the rows that the partitions below fetch.
So every partition is read with exactly one row of nodes: no node is wanted by
many, whatever the size of the language.

Cases: null fields are encoded as "-"; null languages and ids come first; rows
under one id are ordered by their leaf, so repeated rows are neighbours with a
proof each; an empty text is an empty field, not a null; long texts only meet
the hash function; other columns are ignored; an empty table has no leaves, no
root and an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import FEW_ROWS, join_unique, materialize
from kiln.operators.indexing import row_index

FANOUT = 8
TIER = 3                          # levels of a partition
CHUNK = FANOUT ** TIER            # leaves of a partition
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def encoded(value: bytes | None) -> bytes:
    """"-" for null, else the length in bytes, ":" and the value."""
    return b"-" if value is None else b"%d:%b" % (len(value), value)


def leaf_digest(fields: list[bytes | None]) -> str:
    return sha256(b"".join(map(encoded, fields))).hexdigest()


def tampered(doc_id: Column) -> Column:
    """A third of the documents, by the checksum of their id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 0, F.lit(False))


# --- trees ------------------------------------------------------------------

def digest(parts: list[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def widths(n: int) -> list[int]:
    """Nodes of each level of a tree over ``n`` leaves, up to its single top."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FANOUT))
    return out


def missing(lo: int, hi: int, level: int, wide: list[int]) -> list[tuple[int, int]]:
    """Least set of (level, index) that leads from the nodes ``lo`` to ``hi`` of ``level`` to the top."""
    out = []
    for k in range(level, len(wide) - 1):
        first, last = lo // FANOUT, -(-hi // FANOUT)
        out += [(k, i) for i in range(first * FANOUT, lo)] + [(k, i) for i in range(hi, min(wide[k], last * FANOUT))]
        lo, hi = first, last
    return out


def parents(nodes: list[str]) -> list[str]:
    """The next level over nodes that start at a multiple of eight; a last run may be shorter."""
    return [digest(nodes[i:i + FANOUT]) for i in range(0, len(nodes), FANOUT)]


def interiors(lo: int, nodes: list[str], level: int, wide: list[int], fetched: dict) -> Iterator[tuple[int, int, list[str]]]:
    """(level, index of the first node, nodes) of all levels, from the own nodes and the fetched ones."""
    for k in range(level, len(wide)):
        if k == len(wide) - 1:
            yield k, lo, nodes
            return
        hi = lo + len(nodes)
        first, last = lo // FANOUT, -(-hi // FANOUT)
        runs = ([fetched[k, i] for i in range(first * FANOUT, lo)] + nodes
                + [fetched[k, i] for i in range(hi, min(wide[k], last * FANOUT))])
        yield k, first * FANOUT, runs
        lo, nodes = first, parents(runs)


def climb(index: int, level: int, wide: list[int], known: dict) -> Iterator[tuple[int, list[tuple[int, str]], list[tuple[int, str]]]]:
    """(level, siblings to the left, siblings to the right) on the way from a node to the top."""
    for k in range(level, len(wide) - 1):
        start, nodes = known[k]
        run = index // FANOUT * FANOUT
        end = min(wide[k], run + FANOUT)
        yield (k, [(i, nodes[i - start]) for i in range(run, index)], [(i, nodes[i - start]) for i in range(index + 1, end)])
        index //= FANOUT


# --- tasks ------------------------------------------------------------------

def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_TOP = pa.schema([("g", pa.int64()), ("size", pa.int64()), ("pos", pa.int64()), ("width", pa.int64()), ("digest", pa.string())])
_NODES = pa.list_(pa.struct([("root", pa.bool_()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string())]))
_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_PATH = pa.schema([("g", pa.int64()), ("pos", pa.int64()), ("nodes", _NODES)])
_PROOF = pa.schema([("g", pa.int64()), ("pos", pa.int64()), ("doc_id", pa.int64()), ("leaf", pa.string()),
                    ("altered", pa.string()), ("steps", _STEPS)])


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, doc_id, changed, the fields as bytes) -> leaves, and those of the texts with A-Z in lower case."""
    for batch in batches:
        changed, *fields = [c.to_pylist() for c in batch.columns[2:]]
        rows = list(zip(*fields, strict=True))
        own = [leaf_digest(r) for r in rows]
        other = [None if not c else d if r[-1] is None else leaf_digest([*r[:-1], r[-1].lower()])     # bytes: only A-Z
                 for c, r, d in zip(changed, rows, own, strict=True)]
        yield pa.record_batch({"k": batch.column(0), "doc_id": batch.column(1), "digest": pa.array(own, pa.string()),
                               "altered": pa.array(other, pa.string())})


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partitions (g, chunk, size, width, pos, digest) -> their tops."""
    def tops() -> Iterator[tuple]:
        for (g, chunk), rows in groupby(_rows(batches), itemgetter(0, 1)):
            rows = list(rows)
            size, width = rows[0][2], rows[0][3]
            nodes = [r[5] for r in rows]
            for _ in range(min(TIER, len(widths(width)) - 1)):
                nodes = parents(nodes)
            yield g, size, chunk, -(-width // CHUNK), nodes[0]
    yield from _batches(tops(), _TOP)


def _expand(level: int, upper: bool, final: bool) -> Callable:
    """Partitions (g, chunk, pos, size, digest, doc_id, altered, nodes) -> the paths of their nodes.

    The first row of a partition (``pos`` null) holds the nodes it fetches.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def paths() -> Iterator[tuple]:
            for (g, _), rows in groupby(_rows(batches), itemgetter(0, 1)):
                rows = list(rows)
                got, rows = rows[0][7], rows[1:]
                if not rows:                    # an empty table still has the row for the root
                    continue
                wide = widths(rows[0][3])
                lo = rows[0][2]
                mine = {(n["level"], n["idx"]): n["digest"] for n in got if n["root"] == upper}
                above = [n for n in got if n["root"] != upper]      # beyond the top of this tree
                wanted = missing(lo, lo + len(rows), level, wide)
                known = {k: (start, nodes) for k, start, nodes in interiors(
                    lo, [r[4] for r in rows], level, wide, {c: mine[c] for c in wanted})}
                beyond = _steps(above)
                for r in rows:
                    way = list(climb(r[2], level, wide, known))
                    if final:
                        steps = [{"left": "".join(d for _, d in a), "right": "".join(d for _, d in b)} for _, a, b in way]
                        yield g, r[2], r[5], r[4], r[6], steps + beyond
                    else:
                        nodes = [{"root": upper, "level": k, "idx": i, "digest": d} for k, a, b in way for i, d in a + b]
                        yield g, r[2], nodes + above
        yield from _batches(paths(), _PROOF if final else _PATH)
    return run


def _steps(nodes: list[dict]) -> list[dict]:
    """Left and right siblings per level, for the nodes beyond a subroot.

    Each level of the tree over subroots is marked by its place: the entry with an
    empty digest stands where the node on the way itself would be.
    """
    out = []
    for _, level in groupby(nodes, itemgetter("level")):
        run = list(level)
        own = next(k for k, n in enumerate(run) if not n["digest"])
        out.append({"left": "".join(n["digest"] for n in run[:own]), "right": "".join(n["digest"] for n in run[own + 1:])})
    return out


# --- the manifest -----------------------------------------------------------

@dataclass
class Manifest:
    leaves: DataFrame             # k, g, size, width, pos, doc_id, digest, altered: the floor of the trees
    tiers: list[DataFrame]        # g, size, pos, width, digest: tops of the partitions, tier by tier
    langs: DataFrame              # k (encoded language), g (its place), size (its leaves)
    subroots: DataFrame           # g, digest
    root_tiers: list[DataFrame]   # the tiers over the subroots, these first
    root: str | None              # None for an empty table


def _dealt(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("chunk", F.floor(F.col("pos") / CHUNK))


def _fold_tier(nodes: DataFrame) -> DataFrame:
    dealt = _dealt(nodes).select("g", "chunk", "size", "width", "pos", "digest")
    return materialize(dealt.repartition("g", "chunk").sortWithinPartitions("g", "chunk", "pos").mapInArrow(
        _fold, "g long, size long, pos long, width long, digest string"))


def _fold_all(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """All tiers above ``nodes``; a tree is done where it has one node left (``width`` 1)."""
    tiers = [_fold_tier(nodes)]
    largest = -(-largest // CHUNK)
    while largest > 1:
        tiers.append(_fold_tier(tiers[-1].filter("width > 1")))
        largest = -(-largest // CHUNK)
    return tiers


def _done(tiers: list[DataFrame]) -> DataFrame:
    out = tiers[0].filter("width = 1")
    for t in tiers[1:]:
        out = out.unionByName(t.filter("width = 1"))
    return out.select("g", "digest")


def build(docs: DataFrame) -> Manifest:
    """The manifest of ``docs`` (doc_id, source, lang, n_chars, text)."""
    lang = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))      # null first, then by bytes
    leaves = materialize(docs.select(
        lang.alias("k"), F.col("doc_id").cast("long").alias("doc_id"), tampered(F.col("doc_id")).alias("changed"),
        *[F.col(c).cast("string").cast("binary").alias(c + "_bytes") for c in FIELDS],
    ).mapInArrow(_leaves, "k string, doc_id long, digest string, altered string"))
    langs = materialize(row_index(leaves.groupBy("k").agg(F.count(F.lit(1)).alias("size")), "k", name="g"))
    n_langs, largest = langs.agg(F.count(F.lit(1)), F.max("size")).first()
    leaves = leaves.withColumn("_order", F.struct("doc_id", "digest"))
    leaves = row_index(leaves, "_order", ("k",), name="pos").drop("_order")
    if n_langs <= FEW_ROWS:
        leaves = leaves.join(F.broadcast(langs), "k")
    else:
        leaves = join_unique(materialize(leaves), langs, "k", counts=langs.select("k", F.col("size").alias("n")))
    leaves = materialize(leaves.withColumn("width", F.col("size")))
    tiers = _fold_all(leaves, largest or 0)
    subroots = _done(tiers)
    floor = subroots.select(F.lit(0).cast("long").alias("g"), F.lit(n_langs).cast("long").alias("size"),
                            F.col("g").alias("pos"), F.lit(n_langs).cast("long").alias("width"), "digest")
    root_tiers = [floor, *_fold_all(floor, n_langs)]
    top = _done(root_tiers[1:]).first()
    return Manifest(leaves, tiers, langs, subroots, root_tiers, top and top["digest"])


def _expand_tier(nodes: DataFrame, fetched: DataFrame, level: int, upper: bool, final: bool) -> DataFrame:
    """Paths of the nodes of a tier; ``fetched`` (g, pos, nodes) has one row for each of its partitions."""
    own = _dealt(nodes).select(
        "g", "chunk", "pos", "size", "digest", *([F.col("doc_id"), F.col("altered")] if final else [
            F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("altered")]),
        F.lit(None).cast(_NODE_DDL).alias("nodes"))
    rows = own.unionByName(fetched.select(
        "g", F.col("pos").alias("chunk"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("size"),
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("doc_id"),
        F.lit(None).cast("string").alias("altered"), "nodes"))
    ddl = (f"g long, pos long, doc_id long, leaf string, altered string, steps {_STEP_DDL}" if final
           else f"g long, pos long, nodes {_NODE_DDL}")
    return rows.repartition("g", "chunk").sortWithinPartitions("g", "chunk", "pos").mapInArrow(
        _expand(level, upper, final), ddl)


_NODE_DDL = "array<struct<root:boolean,level:int,idx:bigint,digest:string>>"
_STEP_DDL = "array<struct<left:string,right:string>>"


def _place(paths: DataFrame, size: int) -> DataFrame:
    """Paths of the subroots with an empty digest where the subroot's own way passes, so that left and right can be told."""
    levels = len(widths(size)) - 1
    own = F.array(*[F.struct(F.lit(True).alias("root"), F.lit(k).cast("int").alias("level"),
                             F.floor(F.col("pos") / FANOUT ** k).alias("idx"), F.lit("").alias("digest")) for k in range(levels)])
    return paths.withColumn("nodes", F.array_sort(F.concat("nodes", own.cast(_NODE_DDL)))) if levels else paths


def prove(manifest: Manifest) -> DataFrame:
    """k, doc_id, leaf, altered, subroot, root, steps of every document.

    ``steps`` holds, level by level up to the root, the digests to the left and
    to the right of the node on the way, as joined text.
    """
    spark = manifest.leaves.sparkSession
    n_langs = manifest.root_tiers[0].select("size").first()
    # from the top down: the tree over the subroots first
    paths = spark.createDataFrame([(0, 0, [])], f"g long, pos long, nodes {_NODE_DDL}")
    for t in range(len(manifest.root_tiers) - 2, -1, -1):
        paths = _expand_tier(manifest.root_tiers[t].filter("width > 1") if t else manifest.root_tiers[t], paths, TIER * t, True, False)
    if n_langs:
        paths = _place(paths, n_langs["size"])
    paths = materialize(paths)
    top = paths.select(F.col("pos").alias("g"), F.lit(0).cast("long").alias("pos"), "nodes")     # one row a language
    below: DataFrame | None = None
    for t in range(len(manifest.tiers) - 1, -1, -1):
        # trees that end at this tier take the path of their subroot, the others that of the tier above
        ends = manifest.tiers[t].filter("width = 1").select("g")
        fetched = top.join(ends, "g", "left_semi")
        if below is not None:
            fetched = fetched.unionByName(below)
        if t:
            below = materialize(_expand_tier(manifest.tiers[t - 1].filter("width > 1"), fetched, TIER * t, False, False))
        else:
            below = _expand_tier(manifest.leaves, fetched, 0, False, True)
    subroots = manifest.langs.join(manifest.subroots, "g").select("g", "k", F.col("digest").alias("subroot"))
    few = manifest.langs.count() <= FEW_ROWS
    proofs = below.join(F.broadcast(subroots), "g") if few else join_unique(materialize(below), subroots, "g", narrow=False)
    return proofs.select("k", "doc_id", "leaf", "altered", "subroot", F.lit(manifest.root).alias("root"), "steps")


def fold(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, leaf, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def report(docs: DataFrame) -> DataFrame:
    """Digests of the proofs, checked against leaves of which a third was tampered with."""
    folded = fold(F.coalesce("altered", "leaf"), F.col("steps"))
    return prove(build(docs)).select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"),
                                     folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))
