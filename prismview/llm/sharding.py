"""Sharding by minimax contiguous partition, with DataFrame functions only.

Groups of equal texts stay together, so a shard boundary can only fall between
groups. Groups are ordered: first those that outweigh an equal share of what is left
after the heavier ones, heaviest first (fewer than there are shards), then the rest by
the SHA-256 of their text. The smallest shard capacity that lets a greedy sweep fit them
into the given number of shards is found by binary search. Within that capacity each cut
falls as near as possible to an equal share of what is left, so a heavy group gets a
shard of its own and the other shards are near equal and none is empty while groups last.

The driver never sees the groups: it sees *cells*, the summed sizes of all groups that
share a digest prefix, and splits only those cells into finer ones in which a cut may
still fall.

Rows with null text weigh one byte and form one group with empty texts. An empty
table gives an empty result. Repeated rows are rows of their own, also with null ids.
Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismview.llm.scratch import written

#: Hex digits of the digest in the first cells and in each finer level: they
#: bound what the driver holds to some ten thousands of cells at any input size.
FIRST_DIGITS, MORE_DIGITS = 3, 2
#: Parts of a shard that are numbered side by side.
NUMBERING_PARTS = 256


class Cells:
    """Ordered cells: digest prefix, weight, and whether it is one group."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        rows = sorted(rows)
        self.prefix = [r[0] for r in rows]
        self.weight = np.array([r[1] for r in rows], dtype=np.int64)
        self.single = np.array([r[2] == 1 for r in rows], dtype=bool)
        self.ends = np.concatenate([[0], np.cumsum(self.weight)])

    def sweep(self, capacity: int, shards: int, fluid: bool) -> list[tuple[int, int]]:
        """(weight position, cell index) that each shard reaches; ``fluid`` may split cells of several groups."""
        at, reached, total, n = 0, [], int(self.ends[-1]), len(self.prefix)
        for _ in range(shards):
            to = at + capacity
            if to >= total:
                reached.append((total, n))
                at = total
                continue
            cell = int(np.searchsorted(self.ends, to, side="right")) - 1
            at = to if fluid and not self.single[cell] else max(at, int(self.ends[cell]))
            reached.append((at, cell))
        return reached

    def capacity(self, shards: int, fluid: bool, least: int, most: int) -> int:
        """Binary search for the smallest capacity that holds everything."""
        total = int(self.ends[-1])
        while least < most:
            middle = (least + most) // 2
            if self.sweep(middle, shards, fluid)[-1][0] >= total:
                most = middle
            else:
                least = middle + 1
        return least

    def cuts(self, capacity: int, shards: int) -> tuple[list[int], set[int]]:
        """First cells of shards 1, 2, ... at capacity ``capacity``, and cells of several groups in which a cut would fall."""
        total, n = int(self.ends[-1]), len(self.prefix)
        least = [total]  # where the shard before must end for the rest to fit
        for _ in range(shards - 1):
            least.append(int(self.ends[np.searchsorted(self.ends, least[-1] - capacity)]))
        at, found, inside = 0, [], set()
        for j in range(shards - 1):
            first = int(np.searchsorted(self.ends, at, side="right")) - 1
            if first >= n:
                break
            low, high = max(least[shards - 1 - j], int(self.ends[first + 1]) if self.single[first] else at + 1), at + capacity
            want = min(max(at + -(-(total - at) // (shards - j)), low), high)
            cell = int(np.searchsorted(self.ends, want, side="right")) - 1
            if int(self.ends[cell]) != want and cell < n:
                if not self.single[cell]:
                    inside.add(cell)
                start, end = int(self.ends[cell]), int(self.ends[cell + 1])
                want = start if start > at and (end > high or (start >= low and want - start <= end - want)) else end
            at = min(want, total)
            found.append(int(np.searchsorted(self.ends, at)))
        return [c for c in found if c < n], inside


def cut_points(groups: DataFrame, shards: int) -> tuple[dict[str, str], list[str], int]:
    """Order keys of heavy groups, order keys at which shards 1, 2, ... begin, and the smallest capacity.

    ``groups`` has ``key`` (hex digest) and ``weight``.
    """
    total = groups.agg(F.sum("weight")).first()[0] or 0
    left, heavy = total, {}
    for r in groups.orderBy(F.desc("weight"), "key").limit(shards).collect():  # one row a shard
        if len(heavy) == shards - 1 or r.weight * (shards - len(heavy)) <= left:
            break
        heavy[r.key] = f"!{len(heavy):02d}"  # sorts before hex digits
        left -= r.weight
    groups = groups.select(order_key(F.col("key"), heavy).alias("key"), "weight")

    def cells_of(df: DataFrame, digits: int) -> list[tuple[str, int, int]]:
        prefix = F.substring("key", 1, digits)
        return [tuple(r) for r in df.groupBy(prefix.alias("p")).agg(F.sum("weight"), F.count("*")).collect()]

    def split(found: list, opened: set[int], cells: Cells, digits: int) -> list:
        """``found`` with the opened cells made finer."""
        names = [cells.prefix[i] for i in sorted(opened)]
        # Cells that opened at a coarser level than the last one have shorter prefixes.
        inside = F.lit(False)
        for k in sorted({len(p) for p in names}):
            inside = inside | F.substring("key", 1, k).isin([p for p in names if len(p) == k])
        gone = set(names)
        return [r for r in sorted(found) if r[0] not in gone] + cells_of(groups.filter(inside), digits)

    found = cells_of(groups, FIRST_DIGITS)
    if not found:
        return heavy, [], 0
    largest = groups.agg(F.max("weight")).first()[0]
    digits = FIRST_DIGITS
    while True:
        cells = Cells(found)
        most = cells.capacity(shards, False, max(largest, -(-total // shards)), total)
        least = cells.capacity(shards, True, max(largest, -(-total // shards)), most)
        early, late = cells.sweep(least, shards, False), cells.sweep(most, shards, True)
        opened = {i for (_, a), (_, b) in zip(early, late, strict=True) for i in range(a, min(b + 1, len(found))) if not cells.single[i]}
        if not opened:
            break
        digits += MORE_DIGITS
        found = split(found, opened, cells, digits)
    best = cells.capacity(shards, False, least, most)
    while (told := cells.cuts(best, shards))[1]:
        digits += MORE_DIGITS
        cells = Cells(found := split(found, told[1], cells, digits))
    return heavy, [cells.prefix[i] for i in told[0]], best


def order_key(key: Column, heavy: dict[str, str]) -> Column:
    """The digest, or the order key of a heavy group."""
    out = key
    for digest, own in heavy.items():
        out = F.when(key == F.lit(digest), own).otherwise(out)
    return out


def shard_of(key: Column, cuts: list[str]) -> Column:
    """Cuts at or below the key; a plain expression, so rows need no join."""
    out = F.lit(0)
    for cut in cuts:
        out = out + F.when(key >= F.lit(cut), 1).otherwise(0)
    return out.cast("int")


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row."""
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            F.sha2(text, 256).alias("key"),
        ),
        "rows",
    )
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("weight")), "groups")
    heavy, cuts, _ = cut_points(groups, shards)
    part = F.pmod(F.xxhash64("doc_id", "key"), F.lit(NUMBERING_PARTS)).cast("int")
    placed = rows.select("doc_id", "size", "text_crc32", shard_of(order_key(F.col("key"), heavy), cuts).alias("shard"), part.alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "part", F.coalesce(before, F.lit(0)).alias("start"))  # shards x NUMBERING_PARTS rows at most
    number = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id"))
    return (
        placed.withColumn("number", number)
        .join(F.broadcast(starts), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("number") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
