"""Sharding by minimax contiguous partition over atomic groups of equal texts.

Groups are ordered by their text's hash.  The smallest feasible shard capacity
is found by binary search with a greedy check, and shards are cut there.  A
group larger than a fair share gets a shard of its own, and the others share
the remaining shards, so that one huge group does not loosen the capacity of
all.

The search never sees all groups.  It works on ranges of the hash order with
their sums and largest members; ranges that could hold a cut are split further
until they are single groups.  Only a bounded number of ranges, whatever the
input's size, reaches the driver.

Cases: a null text counts as empty (size 16); equal texts are one group, also
with repeated ids; an empty table gives an empty result; fewer groups than
shards leave shards empty; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.llm.common import materialize, row_struct, running_total

SHARDS = 40
OVERHEAD = 16            # bytes a document takes besides its text
FIRST_BITS = 12          # of the first split of the hash order
MORE_BITS = 8            # of every further split
SLOT_ROWS = 50_000      # rows that are numbered together, about


class _Ranges:
    """Consecutive ranges of the group order, as (order of the first, bits, sum, largest group, groups)."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        self.rows = sorted(rows)
        self.prefix = [0, *accumulate(r[2] for r in self.rows)]
        self.total = self.prefix[-1]

    def ends(self, capacity: int, shards: int) -> list[tuple[int, int]]:
        """Where the greedy check ends each shard: the least and the most words of sum that it can reach.

        A cut inside a range of several groups is known up to the range's
        largest group only; elsewhere both figures are exact.
        """
        low = high = 0
        out = []
        for _ in range(shards):
            low, high = self._down(low + capacity, True), self._down(high + capacity, False)
            out.append((low, high))
        return out

    def _down(self, at: int, least: bool) -> int:
        if at >= self.total:
            return self.total
        k = bisect_right(self.prefix, at) - 1
        if self.rows[k][4] == 1:
            return self.prefix[k]
        return max(self.prefix[k], at - self.rows[k][3] + 1) if least else at

    def bounds(self, shards: int) -> tuple[int, int]:
        """The smallest capacities that may pass and that surely pass."""
        found = []
        for side in (1, 0):
            low, high = max(-(-self.total // shards), max((r[3] for r in self.rows), default=0)), self.total
            low = min(low, high)
            while low < high:
                middle = (low + high) // 2
                if self.ends(middle, shards)[-1][side] < self.total:
                    low = middle + 1
                else:
                    high = middle
            found.append(low)
        return found[0], found[1]

    def unsettled(self, shards: int) -> list[tuple[int, int]]:
        """(order, bits) of the ranges of several groups in which a shard may end at a capacity still possible."""
        low, high = self.bounds(shards)
        first, last = 0, 0
        marked = set()
        for (a, _), (_, b) in zip(self.ends(low, shards), self.ends(high, shards), strict=True):
            # the ends of this shard lie in (first + low) .. (last + high)
            x = bisect_right(self.prefix, min(first + low, self.total)) - 1
            y = bisect_right(self.prefix, min(last + high, self.total)) - 1
            marked.update(k for k in range(x, min(y, len(self.rows) - 1) + 1) if self.rows[k][4] > 1)
            first, last = a, b
        return [self.rows[k][:2] for k in sorted(marked)]

    def cuts(self, shards: int) -> list[int]:
        """Order of the first group of each shard after the first, at the smallest capacity."""
        capacity = self.bounds(shards)[1]
        out = []
        for end, _ in self.ends(capacity, shards):
            k = bisect_right(self.prefix, end) - 1
            if end >= self.total:
                break
            out.append(self.rows[k][0])
        return out


def _ranges(groups: DataFrame, prefix: Column, bits: int) -> list[tuple[int, int, int, int, int]]:
    """Sums by the first ``bits`` bits of the order (as a signed number, so ranges sort like their groups)."""
    got = groups.groupBy(prefix.alias("p")).agg(F.sum("bytes"), F.max("bytes"), F.count(F.lit(1))).collect()
    return [(r[0] << (64 - bits), bits, int(r[1]), int(r[2]), r[3]) for r in got]


def _top_bits(bits: int) -> Column:
    return F.shiftright("h", 64 - bits)


def plan(groups: DataFrame, shards: int) -> tuple[list[int], list[int]]:
    """(orders of groups with a shard of their own, cut orders of the rest).

    ``groups`` has one row per group: h (its order) and bytes.  Groups above
    the fair share of what is left are fewer than the shards, so the largest
    ``shards`` groups are looked at only.
    """
    total = int(groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])
    alone = []
    for r in groups.orderBy(F.desc("bytes"), "h").limit(shards).collect():
        left = shards - len(alone)
        if left == 1 or r["bytes"] * left <= total:
            break
        alone.append(r["h"])
        total -= r["bytes"]
    left = shards - len(alone)
    rest = groups.filter(~F.col("h").isin(alone)) if alone else groups
    known = {r[:2]: r for r in _ranges(rest, _top_bits(FIRST_BITS), FIRST_BITS)}
    while todo := _Ranges(list(known.values())).unsettled(left):
        for bits in sorted({b for _, b in todo}):
            # a few ranges for each shard at most
            orders = [o >> (64 - bits) for o, b in todo if b == bits]
            finer = min(64, bits + MORE_BITS)
            inside = rest.filter(_top_bits(bits).isin(orders))
            for o, b in todo:
                if b == bits:
                    known.pop((o, b))
            for r in _ranges(inside, _top_bits(finer) if finer < 64 else F.col("h"), finer):
                known[r[:2]] = r
    return alone, _Ranges(list(known.values())).cuts(left)


def shard_of(h: Column, alone: list[int], cuts: list[int]) -> Column:
    """The shard of a group: own shards first, then the number of cuts up to it."""
    rest = F.lit(len(alone))
    for c in cuts:
        rest = rest + (h >= F.lit(c)).cast("int")
    own = F.lit(None).cast("int")
    for k, o in enumerate(alone):
        own = F.when(h == F.lit(o), F.lit(k)).otherwise(own)
    return F.coalesce(own, rest).cast("int")


def _sized(docs: DataFrame, text_col: str, *keep: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(*keep, (F.octet_length(text) + OVERHEAD).cast("long").alias("_size"),
                       F.xxhash64(text).alias("_h"), F.crc32(text).cast("long").alias("_crc"))


def _groups(sized: DataFrame) -> DataFrame:
    return materialize(sized.groupBy(F.col("_h").alias("h")).agg(F.sum("_size").alias("bytes")))


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.

    Slots are numbered within (shard, bucket) and shifted by the rows of the
    shard's earlier buckets, so no task numbers a whole shard.
    """
    sized = materialize(_sized(docs, text_col, F.col(id_col).alias("doc_id")))
    alone, cuts = plan(_groups(sized), shards)
    buckets = max(1, -(-sized.count() // SLOT_ROWS))
    placed = sized.withColumn("shard", shard_of(F.col("_h"), alone, cuts)).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "_h"), F.lit(buckets)).cast("int")).withColumn(
        "one", F.lit(1).cast("long"))
    numbered = running_total(placed, ["shard"], ["doc_id", "_h"], "bucket", "one", "slot")
    return numbered.select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"),
                           F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def with_shards(docs: DataFrame, text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """The rows of ``docs`` with their columns and ``shard`` (which replaces a column of that name).

    Whole rows are read twice and never shuffled.
    """
    alone, cuts = plan(_groups(_sized(docs, text_col)), shards)
    rows = _sized(docs.drop("shard"), text_col, row_struct(docs.drop("shard")))
    return rows.select("_row.*", shard_of(F.col("_h"), alone, cuts).alias("shard"))
