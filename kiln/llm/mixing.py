"""Mixing sources to target weights with a low-discrepancy schedule (DataFrame functions only).

Sources get a target number of words.  Each source's documents are put in a
seeded random order, which is repeated for further passes, and cut into blocks
of equal length.  Slot i of the mix takes the point frac(i * golden ratio); the
source in whose share of the cumulated targets the point falls supplies its
next block there.  So every stretch of the mix is close to the weights.  Points
that fall to a source without blocks left are empty slots; sources that are
short of points share further ones by what they lack, until all blocks of all
targets have their slot.

The mix is made of the scheduled blocks: ``mix`` counts the words of each
document that lie in them (the last block of a source ends at its target, which
may be inside a document) and returns the slots of all its pieces.  Where whole
rows are wanted (``mixed_rows``), a document counts as taken in a pass when its
middle lies in a scheduled block, below the target, so a source misses its
target by half a document at most.

Cases: a null or blank text has size 0 and takes 0 words; a null source is a
source of its own (last in the order of weights); a source without words has
target 0; equal ids order by text hash, and fully equal rows get equal results
as a multiset; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm.common import materialize, row_struct, running_total, words

WEIGHTS = (3, 1, 2)          # of the sources in order, repeating
SHARE = 1.5                  # words of the mix per word of the input
PASSES = 2                   # no source, and no document, is taken more often
BLOCK_WORDS = 1024
GRID = 1024                  # cells of [0, 1) in which points meet source shares
GOLDEN = 0.6180339887498949
SEED = 11
BUCKETS = 256                # of a source's random order; each is summed by itself


def _caps(sources: DataFrame, weight: str, cap: str, total: float) -> DataFrame:
    """Add ``target``: ``total`` shared by weight, stopped at the cap, the excess reshared by weight.

    With the level L of the sources below their caps, a target is
    min(cap, L * weight).  L only rises from round to round, so the rounds end
    when no further source reaches its cap.
    """
    level, capped = None, -1
    while True:
        stopped = F.lit(False) if level is None else F.col(cap) <= F.col(weight) * F.lit(level)
        n, spent, open_weight = sources.agg(
            F.coalesce(F.sum(stopped.cast("long")), F.lit(0)),
            F.coalesce(F.sum(F.when(stopped, F.col(cap))), F.lit(0)).cast("double"),
            F.coalesce(F.sum(F.when(~stopped, F.col(weight))), F.lit(0)).cast("double")).first()
        if n == capped or open_weight == 0:
            break
        capped, level = n, (total - spent) / open_weight
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    return sources.withColumn("target", F.when(stopped, F.col(cap).cast("double")).otherwise(
        F.col(weight) * F.lit(level)))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            passes: int = PASSES) -> DataFrame:
    """source, named, source_size, weight, target, low, high: one row per source.

    [low, high) is the source's part of [0, 1) on the cumulated targets.
    ``sizes`` has source, named and size; named is 0 for the null source, which comes as "".
    """
    sources = materialize(sizes.groupBy("named", "source").agg(F.sum("size").alias("source_size")))
    # one row per source from here on
    order = Window.orderBy(F.desc("named"), "source")
    cycle = F.array(*[F.lit(w) for w in weights])
    sources = materialize(sources.withColumn("weight", F.get(
        cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))).withColumn(
        "cap", passes * F.col("source_size")))
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    sources = materialize(_caps(sources, "weight", "cap", share * total))
    whole = sources.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0] or 1.0
    high = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.lit(whole)
    return materialize(sources.withColumn("high", high).withColumn(
        "low", F.coalesce(F.lag("high").over(order), F.lit(0.0))).drop("cap"))


def _dealt(spark, sources: DataFrame, first: int, n_slots: int) -> DataFrame:
    """source, named, block, slot: points ``first`` to ``first + n_slots - 1`` dealt to sources that still need blocks.

    Points and shares meet in the cells of a grid over [0, 1), so neither side
    is broadcast and a source with a large share is spread over many cells.
    """
    points = spark.range(first, first + n_slots).select(F.col("id").alias("slot"), (F.col("id") * F.lit(GOLDEN)).alias("x"))
    points = points.select("slot", (F.col("x") - F.floor("x")).alias("x")).withColumn(
        "cell", F.floor(F.col("x") * GRID))
    shares = sources.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * GRID), F.floor(F.col("high") * GRID))))
    slots = points.join(shares.select("cell", "source", "named", "low", "high", "have", "need"), "cell").filter(
        "x >= low and x < high")
    # rank within the source, over ranges of slots
    slots = slots.withColumn("range", F.floor(F.col("slot") / 4096)).withColumn("one", F.lit(1).cast("long"))
    ranked = running_total(slots, ["named", "source"], ["slot"], "range", "one", "rank")
    return ranked.withColumn("block", F.col("have") + F.col("rank")).filter("block < need").select(
        "source", "named", "block", "slot")


def schedule(spark, sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """source, named, block, slot: the slot in which each block stands; every block up to the targets has one."""
    need = F.ceil(F.col("target") / block_words).cast("long")
    short = sources.filter("target > 0").select("source", "named", "low", "high", F.lit(0).cast("long").alias("have"),
                                                need.alias("need"))
    done, first = None, 0
    while True:
        n_slots = short.agg(F.coalesce(F.sum(F.col("need") - F.col("have")), F.lit(0))).first()[0]
        if done is not None and n_slots == 0:
            return done
        dealt = materialize(_dealt(spark, short, first, n_slots), n_slots)
        done, first = dealt if done is None else done.unionByName(dealt), first + n_slots
        # the first point of a further round falls to a source that lacks a block, so the rounds end
        got = dealt.groupBy("named", "source").agg(F.count(F.lit(1)).alias("got"))
        order = Window.orderBy(F.desc("named"), "source")          # one row per source
        short = short.drop("low", "high").join(got, ["named", "source"], "left").withColumn(
            "have", F.col("have") + F.coalesce("got", F.lit(0))).filter("have < need").drop("got")
        lack = F.col("need") - F.col("have")
        short = short.withColumn("upto", F.sum(lack).over(order)).withColumn("whole", F.sum(lack).over(Window.partitionBy()))
        short = materialize(short.withColumn("high", F.col("upto") / F.col("whole")).withColumn(
            "low", (F.col("upto") - lack) / F.col("whole")).drop("upto", "whole"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, *keep: Column) -> DataFrame:
    """One narrow row per document with its place in the source's random order."""
    text, source = F.col(text_col), F.col(source_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), *keep, F.size(words(text)).cast("long").alias("size"),
                       F.coalesce(source, F.lit("")).alias("source"),
                       source.isNotNull().cast("int").alias("named"),
                       F.xxhash64(text).alias("text_hash"),
                       F.xxhash64(F.lit(SEED), F.col(id_col), text).alias("r"))


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...],
            share: float, passes: int) -> tuple[DataFrame, DataFrame]:
    """(sources with their targets, documents with ``start``: the words before them in their source's order)."""
    # the high bits of r order like r itself
    sized = materialize(_sized(docs, id_col, text_col, source_col).withColumn(
        "bucket", F.shiftright("r", 64 - BUCKETS.bit_length() + 1)))
    sources = targets(sized.select("source", "named", "size"), weights, share, passes)
    placed = running_total(sized, ["named", "source"], ["r", "doc_id", "text_hash"], "bucket", "size", "start")
    return sources, placed.join(sources.select("named", "source", "source_size", "target"), ["named", "source"])


def _passed(placed: DataFrame, passes: int) -> DataFrame:
    """One row per document with words and pass; ``begin``: the words before this copy in its source."""
    return placed.filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn(
        "begin", F.col("start") + F.col("pass") * F.col("source_size"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES,
        block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, slot (of the first piece) and slots (of all pieces, in order).

    A document has one piece for each pass and each scheduled block that holds words of it.
    """
    sources, placed = _placed(docs, id_col, text_col, source_col, weights, share, passes)
    slots = schedule(docs.sparkSession, sources, block_words)
    placed = materialize(placed.select("doc_id", "size", "source_size", "target", "named", "source", "start"))
    # the last block ends at the target
    pieces = _passed(placed, passes).withColumn(
        "end", F.least(F.col("begin") + F.col("size"), F.round("target").cast("long"))).withColumn(
        "block", F.explode_outer(F.when(F.col("end") > F.col("begin"), F.sequence(
            F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words)))))
    pieces = pieces.join(slots, ["named", "source", "block"], "left")
    words_in = F.least("end", (F.col("block") + 1) * block_words) - F.greatest("begin", F.col("block") * block_words)
    # documents with words have a start of their own in their source
    taken = pieces.groupBy("named", "source", "start", "doc_id", "size", "source_size", "target").agg(
        F.coalesce(F.sum(F.when(F.col("slot").isNotNull(), words_in)), F.lit(0)).cast("long").alias("taken"),
        F.sort_array(F.collect_list(F.when(F.col("slot").isNotNull(), F.struct("pass", "block", "slot")))).alias("s"))
    taken = taken.select("doc_id", "size", "source_size", "target", "taken", F.col("s.slot").alias("slots"))
    none = placed.filter("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"),
                                            F.array().cast("array<bigint>").alias("slots"))
    return taken.unionByName(none).select("doc_id", "size", "source_size", "target", "taken",
                                          F.get("slots", F.lit(0)).alias("slot"), "slots")


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = PASSES,
               max_sources: int = 100_000, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their own columns.

    A copy is in when its middle lies in a scheduled block and below the target.
    A source's blocks are scheduled from the start of its random order, so one
    bound per source and pass decides for each row (rows with equal id and text
    go together).  Whole texts are never shuffled unless there are more than
    ``max_sources`` sources.
    """
    sources, placed = _placed(docs, id_col, text_col, source_col, weights, share, passes)
    slots = schedule(docs.sparkSession, sources, block_words)
    middle = 2 * F.col("begin") + F.col("size")          # twice the place of the middle
    copies = _passed(placed, passes).withColumn("block", F.floor(middle / (2 * block_words))).filter(
        middle < 2 * F.col("target")).select("named", "source", "block", "pass", "r")
    scheduled = copies.join(slots, ["named", "source", "block"])
    bounds = materialize(scheduled.groupBy("named", "source").agg(
        F.array(*[F.max(F.when(F.col("pass") == p, F.col("r"))) for p in range(passes)]).alias("bounds")))
    if bounds.count() <= max_sources:
        bounds = F.broadcast(bounds)
    rows = _sized(docs, id_col, text_col, source_col, row_struct(docs))
    times = F.size(F.filter("bounds", lambda b: F.col("r") <= b))
    rows = rows.filter("size > 0").join(bounds, ["named", "source"]).withColumn("times", times).filter("times > 0")
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("_row.*")
