"""Benchmark decontamination by template canonicalisation.

Texts become token templates: numbers, names and units are replaced by typed
placeholders, all other tokens are lower-cased and stripped of punctuation.
Windows of eight template tokens are hash-joined between documents and
benchmark items.  The placeholders' values are then compared: a document that
repeats an item with other numbers or names maps each value of the item to one
value of its own (slot consistency); accidental template matches do not.

A document leaks an item when at least half of the item's windows occur in it,
or ``MIN_RUN`` of them, with consistent slots.  Slots are judged per occurrence
of the item: the windows on one alignment (place in the document minus place in
the item), those of one run (until the item starts again), those with the
item's own values, and all windows of the document; one consistent occurrence
is enough, and the one with most windows is reported.

Beside the templates, literal windows (lower-cased tokens with their values, no
placeholders) are joined: a verbatim run of ``VERBATIM`` tokens, or the whole of
a shorter item, is a leak by itself, whatever share of the item it is and
however few of its tokens are words.  For leaks found by them alone, the counts
and the coverage are those of the literal windows.

Cases: null or blank texts match nothing; items with fewer tokens than a window
are one shorter window; template windows with fewer than ``MIN_LITERALS`` literal
tokens are not matched (placeholders alone say nothing); an item of fewer than
``MIN_VERBATIM`` tokens is matched only if it has no placeholder (a lone number
or name is in any text); repeated rows
count once, and different texts under one id are judged apart; empty tables give an empty result; a null id is reported as null;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm import shingles
from kiln.llm.common import materialize, row_struct

WIDTH = 8
MIN_LITERALS = 4
MIN_COVERAGE = 0.5
MIN_RUN = 24
VERBATIM = 13                 # tokens in a row that leak an item
MIN_VERBATIM = 3
MIN_CONSISTENT = 0.75
# window hashes sent to every task (32 MB); a larger index is joined by a shuffle
BROADCAST_WINDOWS = 4_000_000
# fixed values: unit words, recognised directly after a number
UNITS = """mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg lb lbs oz ounce ounces pound
pounds ton tons ml cl l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour
hours day days week weeks month months year years mph kmh kph usd eur gbp dollar dollars euro euros cent cents percent
degree degrees c f k w kw kwh v a hz khz mhz ghz b kb mb gb tb""".split()

_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x1F3D5B79A1C3E5F7, 0x2F4D6B8193B5D7F9, 0x3F5D7B91A3C5E7F1))
_DIGIT, _LETTER, _UPPER, _SMALL, _POINT, _STOP = (np.zeros(256, dtype=bool) for _ in range(6))
_DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER[65:91] = True
_SMALL[97:123] = _SMALL[128:] = True
_POINT[[44, 46]] = True
_STOP[[10, 13, 33, 34, 46, 58, 59, 63]] = True
_LITERAL = 1 << 32                     # starts the hash of a literal window
_INDEX_SCHEMA = "id long, pos int, wh long, slots array<long>, windows int, literal boolean"
_HIT_SCHEMA = "id long, text_hash long, doc_pos int, wh long, slots array<long>"


def _hash_of(word: str) -> int:
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(shingles.word_hashes(data, np.array([0]), np.array([len(data)]), shingles.Powers())[0])


_UNIT_HASHES = np.sort(np.array([_hash_of(u) for u in UNITS], dtype=np.uint64))


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)
    return ordered[at] == values


def template(data: np.ndarray, offsets: np.ndarray, powers: shingles.Powers
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template token, value hash, is placeholder, tokens before each row) of a slice."""
    n = len(data)
    if n == 0:
        zero = np.zeros(0, dtype=np.uint64)
        return zero, zero, np.zeros(0, bool), np.zeros(len(offsets), np.int64)
    digit, letter = _DIGIT[data], _LETTER[data]
    begins, cut = np.zeros(n + 1, dtype=bool), offsets[(offsets > 0) & (offsets < n)]
    begins[offsets] = True
    solid = digit | letter
    # a point or comma between digits belongs to the number
    joint = np.zeros(n, dtype=bool)
    joint[1:-1] = _POINT[data[1:-1]] & digit[:-2] & digit[2:]
    joint[cut] = False
    joint[cut - 1] = False
    solid |= joint
    first = solid.copy()
    first[1:] &= ~solid[:-1] | begins[1:n] | (digit[:-1] & letter[1:])
    starts = np.flatnonzero(first)
    stop = ~solid
    stop[1:] |= first[1:]
    # a token ends before the next byte that is not solid, starts a token or starts a row
    edges = np.flatnonzero(np.concatenate([stop | begins[:n], [True]]))
    ends = edges[np.searchsorted(edges, starts, side="right")]
    before = np.searchsorted(starts, offsets)
    value = shingles.word_hashes(data, starts, ends, powers)
    number = digit[starts]
    head = np.zeros(len(starts), dtype=bool)          # first token of a row
    head[before[:-1][before[:-1] < len(starts)]] = True
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    previous = np.concatenate([[0], ends[:-1]])
    opens = head | (stops[starts] > stops[previous])
    second = np.minimum(starts + 1, n - 1)
    name = _UPPER[data[starts]] & (ends - starts > 1) & _SMALL[data[second]] & ~opens
    unit = np.zeros(len(starts), dtype=bool)
    unit[1:] = number[:-1] & ~head[1:] & _among(value[1:], _UNIT_HASHES)
    token = value.copy()
    token[number], token[name], token[unit] = _NUMBER, _NAME, _UNIT
    return token, value, number | name | unit, before


def _windows(token: np.ndarray, slot: np.ndarray, before: np.ndarray, width: int, kind: int = 0,
             floor: int = MIN_LITERALS) -> tuple[np.ndarray, np.ndarray]:
    """(window hashes, their first token) of the windows with enough literal tokens."""
    n = len(token)
    if n < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = n - width + 1
    whole = np.full(m, width + kind, dtype=np.uint64)
    for k in range(width):
        whole += token[k:k + m] * np.uint64(pow(shingles._P, k + 1, 1 << 64))
    slots = np.concatenate([[0], np.cumsum(slot)])
    row_end = np.repeat(before[1:], np.diff(before))[:m]
    at = np.flatnonzero((np.arange(m) + width <= row_end)
                        & (width - (slots[width:] - slots[:m]) >= min(floor, width)))
    return shingles.mix(whole[at]), at


def _literal_windows(value: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of the tokens themselves; their hashes never equal those of templates by construction."""
    return _windows(value, np.zeros(len(value), dtype=bool), before, width, _LITERAL, 0)


def _slot_lists(value: np.ndarray, slot: np.ndarray, at: np.ndarray, width: int) -> pa.Array:
    """The placeholder values of each window, in order."""
    places = at[:, None] + np.arange(width)[None, :]
    inside = slot[places] if len(at) else np.zeros((0, width), dtype=bool)
    sizes = inside.sum(axis=1)
    flat = value[places][inside] if len(at) else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)),
                                    pa.array(flat.view(np.int64)))


def _no_slots(n: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, dtype=np.int32)), pa.array([], pa.int64()))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Benchmark windows: id, pos, wh, slots, windows (of the item)."""
    powers = shingles.Powers()
    for batch in batches:
        for row, end, data, offsets in shingles.slices(batch.column(1)):
            for r in range(end - row):
                own = data[offsets[r]:offsets[r + 1]]
                token, value, slot, before = template(own, np.array([0, len(own)]), powers)
                if not len(token):
                    continue
                width = min(WIDTH, len(token))
                wh, at = _windows(token, slot, before, width)
                found = [(wh, at, _slot_lists(value, slot, at, width), False)]
                if len(token) >= MIN_VERBATIM:
                    wh, at = _literal_windows(value, before, min(VERBATIM, len(token)))
                    found.append((wh, at, _no_slots(len(wh)), True))
                for wh, at, slots, literal in found:
                    yield pa.record_batch({
                        "id": pa.array([batch.column(0)[row + r].as_py()] * len(wh), pa.int64()),
                        "pos": pa.array(at.astype(np.int32)), "wh": pa.array(wh.view(np.int64)), "slots": slots,
                        "windows": pa.array(np.full(len(wh), len(wh), dtype=np.int32)),
                        "literal": pa.array(np.full(len(wh), literal))})


def _scanner(widths: list[int], known) -> Callable:
    """Windows of documents; with ``known`` (a broadcast sorted array) only those in it."""
    kinds = [(w, False) for w in sorted({min(w, WIDTH) for w in widths})]
    kinds += [(w, True) for w in widths if w >= MIN_VERBATIM]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, ordered = shingles.Powers(), None if known is None else known.value
        for batch in batches:
            for row, _, data, offsets in shingles.slices(batch.column(1)):
                token, value, slot, before = template(data, offsets, powers)
                for width, literal in kinds:
                    wh, at = (_literal_windows(value, before, width) if literal
                              else _windows(token, slot, before, width))
                    if ordered is not None:
                        hit = np.flatnonzero(_among(wh, ordered))
                        wh, at = wh[hit], at[hit]
                    if len(wh):
                        rows = row + np.searchsorted(before, at, side="right") - 1
                        yield pa.record_batch({
                            "id": batch.column(0).take(pa.array(rows)).cast(pa.int64()),
                            "text_hash": batch.column(2).take(pa.array(rows)),
                            "doc_pos": pa.array((at - before[rows - row]).astype(np.int32)),
                            "wh": pa.array(wh.view(np.int64)), "slots": _no_slots(len(wh)) if literal else _slot_lists(value, slot, at, width)})
    return scan


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text",
               broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, coverage, slot_share, reparameterised: one row per leak."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("id"),
                             F.col(item_text_col).cast("string").alias("text")).filter("text is not null")
    index = materialize(items.mapInArrow(_index, _INDEX_SCHEMA).dropDuplicates(["id", "pos", "wh"]))
    hashes = index.select("wh").distinct()
    few = hashes.count() <= broadcast_windows
    known = None
    if few:
        found = hashes.toPandas()["wh"].to_numpy(dtype=np.int64).view(np.uint64)
        known = spark.sparkContext.broadcast(np.sort(found))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64("text"))
    hits = texts.mapInArrow(_scanner(_item_widths(items), known), _HIT_SCHEMA)
    side = index.select(F.col("id").alias("item_id"), "pos", "wh", F.col("slots").alias("own"), "windows", "literal")
    hits = hits.join(F.broadcast(side) if few else side, "wh")
    hits = hits.select(F.col("id").alias("doc_id"), "text_hash", "item_id", "doc_pos", "pos", "windows", "literal",
                       "own", "slots")
    return _judge(materialize(hits.dropDuplicates(["doc_id", "text_hash", "item_id", "doc_pos", "pos", "literal"])))


def _item_widths(items: DataFrame) -> list[int]:
    """The lengths of the items up to VERBATIM, which all window widths in use follow from."""
    def width(batches):
        powers = shingles.Powers()
        for batch in batches:
            for _, _, data, offsets in shingles.slices(batch.column(0)):
                n = np.diff(template(data, offsets, powers)[3])
                yield pa.record_batch({"w": pa.array(np.unique(np.minimum(n, VERBATIM)).astype(np.int32))})

    found = items.select("text").mapInArrow(width, "w int").distinct().filter("w > 0").collect()
    return sorted(r["w"] for r in found)


def _occurrences(hits: DataFrame) -> DataFrame:
    """Each hit once for every occurrence that it may belong to: ``kind`` and ``key`` name the occurrence."""
    order = Window.partitionBy("doc_id", "text_hash", "item_id").orderBy("doc_pos", "pos")
    again = (F.col("pos") < F.lag("pos").over(order)).cast("int")
    hits = hits.withColumn("again", F.coalesce(again, F.lit(0))).withColumn("run", F.sum("again").over(order))

    def named(kind, key):
        return F.struct(F.lit(kind).alias("kind"), key.cast("long").alias("key"))

    ways = F.array(named("alignment", F.col("doc_pos") - F.col("pos")), named("run", F.col("run")), named("all", F.lit(0)))
    same = F.when(F.col("own") == F.col("slots"), F.array(named("same", F.lit(0)))).otherwise(F.array())
    return hits.withColumn("way", F.explode(F.concat(ways, same))).select(
        "doc_id", "text_hash", "item_id", "way.kind", "way.key", "pos", "windows", "own", "slots")


def _judge(hits: DataFrame) -> DataFrame:
    by = ["doc_id", "text_hash", "item_id", "kind", "key"]
    literal = hits.filter("literal").groupBy("doc_id", "text_hash", "item_id", "pos").agg(
        F.max("windows").alias("w")).groupBy("doc_id", "text_hash", "item_id").agg(
        F.count(F.lit(1)).alias("n_windows"), F.max("w").cast("long").alias("item_windows")).select(
        "doc_id", "item_id", F.lit(0).alias("template"), "n_windows", "item_windows",
        (F.col("n_windows") / F.col("item_windows")).alias("coverage"), F.lit(1.0).alias("slot_share"),
        F.lit(False).alias("other"))
    hits = materialize(_occurrences(hits.filter("not literal")))
    windows = hits.groupBy(*by, "pos").agg(F.max("windows").alias("w")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_windows"), F.max("w").alias("item_windows"))
    # per value of the item: how often its most frequent counterpart in the occurrence comes
    pairs = hits.select(*by, F.explode(F.arrays_zip("own", "slots")).alias("z")).groupBy(
        *by, F.col("z.own").alias("own"), F.col("z.slots").alias("theirs")).agg(F.count(F.lit(1)).alias("n"))
    slots = pairs.groupBy(*by, "own").agg(F.max("n").alias("top"), F.sum("n").alias("n"),
                                          F.max((F.col("own") != F.col("theirs")).cast("int")).alias("other"))
    slots = slots.groupBy(*by).agg((F.sum("top") / F.sum("n")).alias("slot_share"), F.max("other").alias("other"))
    # null ids match each other
    a, b = windows.alias("a"), slots.alias("b")
    both = a.join(b, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by], "left").select(
        "a.doc_id", "a.item_id", "n_windows", F.col("item_windows").cast("long").alias("item_windows"),
        (F.col("n_windows") / F.col("item_windows")).alias("coverage"),
        F.coalesce("slot_share", F.lit(1.0)).alias("slot_share"), (F.coalesce("other", F.lit(0)) > 0).alias("other"))
    leaks = both.filter((F.col("coverage") >= MIN_COVERAGE) | (F.col("n_windows") >= MIN_RUN)).filter(
        F.col("slot_share") >= MIN_CONSISTENT)
    leaks = leaks.withColumn("template", F.lit(1)).unionByName(literal)
    best = F.max(F.struct("template", "n_windows", "slot_share", (~F.col("other")).alias("same"), "item_windows", "coverage"))
    return leaks.groupBy("doc_id", "item_id").agg(best.alias("m")).select(
        "doc_id", "item_id", "m.n_windows", "m.item_windows", "m.coverage", "m.slot_share",
        (~F.col("m.same")).alias("reparameterised"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text leaks no benchmark item, with their own columns.

    Rows are matched by the hash of their text, so copies go together and ids do not matter.
    """
    keyed = docs.select(row_struct(docs), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("_text_hash"))
    leaks = materialize(find_leaks(keyed, benchmark, "_text_hash", "text").select(
        F.col("doc_id").alias("_text_hash")).distinct())
    small = leaks.count() <= BROADCAST_WINDOWS
    return keyed.join(F.broadcast(leaks) if small else leaks, "_text_hash", "left_anti").select("_row.*")
