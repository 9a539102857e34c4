"""Best-fit packing of token sequences, improved by swap-based local search.

Documents longer than a sequence are cut into full pieces and a rest. Pieces
are dealt by a hash into groups, whose number follows from the bytes of all
texts; each group is packed on its own in a task of its own, so the work is
spread evenly whatever the sizes of documents; rows that repeat often are dealt
one by one. The emptiest bin of each group is packed once more with those of
other groups, again in groups of bounded size.

In a group, best-fit decreasing gives the first bins. The local search then
works on underfull bins: it moves documents, exchanges one for one or two for
one between a bin and any fuller one with room, whichever raises the sum of
squared fills most, until bins empty. It ends at the lower bound of bins, or when
no bin has such a change left; it only ever improves on the first bins. Of
changes of equal gain, and of pieces of equal length, the first in order counts.

Nulls: a null text is an empty one (an end id only); a null id is kept. Rows
that repeat are packed as often as they come. Texts of any length are cut, none
is dropped. An empty table gives an empty result. Only doc_id and text are read;
other columns do not matter, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmill.llm.store import written
from brookmill.llm.tokens import word_ids

#: Bytes of text to a packing group.
GROUP_BYTES = 32_000_000
#: Rows that repeat are dealt singly where they fill more than this part of a group.
PARTS = 8
#: Values by which rows that repeat often are told; a power of 2.
SLOTS = 1 << 22
#: Most partitions that groups are shuffled to; beyond that a task packs several groups in turn.
MOST_PARTITIONS = 10_000


class Bins:
    """Bins of one group with the places of items, lists of item numbers by length."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit_decreasing(self) -> None:
        room_of: dict[int, list[int]] = {}
        rooms: list[int] = []
        for item in np.argsort(-self.lengths, kind="stable").tolist():
            n = int(self.lengths[item])
            at = bisect_left(rooms, n)
            if at < len(rooms):
                room = rooms[at]
                b = room_of[room].pop()
                if not room_of[room]:
                    del room_of[room]
                    rooms.pop(at)
            else:
                b, room = len(self.items), self.capacity
                self.items.append([])
                self.fill.append(0)
            self.items[b].append(item)
            self.fill[b] += n
            if room > n:
                if room - n not in room_of:
                    insort(rooms, room - n)
                    room_of[room - n] = []
                room_of[room - n].append(b)

    def bound(self) -> int:
        return -(-sum(self.fill) // self.capacity)

    def count(self) -> int:
        return sum(1 for f in self.fill if f)

    def _change(self, low: int, high: int, out: list[int], back: list[int]) -> None:
        """Items `out` go from low to high, items `back` the other way."""
        moved = int(sum(self.lengths[i] for i in out) - sum(self.lengths[i] for i in back))
        self.items[low] = [i for i in self.items[low] if i not in out] + back
        self.items[high] = [i for i in self.items[high] if i not in back] + out
        self.fill[low] -= moved
        self.fill[high] += moved
        self.bin_of[out], self.bin_of[back] = high, low

    def _best_change(self, low: int) -> tuple[int, int, list[int], list[int]]:
        """The change between a bin and any fuller one that raises the sum of squares most: gain, high, out, back."""
        best: tuple[int, int, list[int], list[int]] = (0, -1, [], [])
        fill = np.array(self.fill)
        highs = np.flatnonzero((fill >= fill[low]) & (fill < self.capacity))
        highs = highs[highs != low]
        owner = self.bin_of
        fits = (fill[owner] >= fill[low]) & (fill[owner] < self.capacity) & (owner != low)
        theirs = np.flatnonzero(fits)
        # either nothing comes back or one item
        bins, back = np.concatenate([highs, owner[theirs]]), np.concatenate([np.full(len(highs), -1), theirs])
        lengths = np.concatenate([np.zeros(len(highs), np.int64), self.lengths[theirs]])
        room, gap = self.capacity - fill[bins], fill[bins] - fill[low]
        ours = sorted({int(self.lengths[i]): i for i in self.items[low]}.items())
        pairs = self._pairs(self.items[low]) if len(self.items[low]) > 1 else []
        for options in ([(n, [i]) for n, i in ours], pairs):
            if not options or not len(bins):
                continue
            # the largest option that still fits when the other item has left
            sums = np.array([0, *(n for n, _ in options)])
            at = np.searchsorted(sums, lengths + room, side="right") - 1
            moved = np.maximum(sums[at] - lengths, 0)
            gains = 2 * moved * (gap + moved)
            k = int(np.argmax(gains))
            if gains[k] > best[0]:
                best = (int(gains[k]), int(bins[k]), options[at[k] - 1][1], [] if back[k] < 0 else [int(back[k])])
        return best

    def _pairs(self, items: list[int]) -> list[tuple[int, list[int]]]:
        """Sums of two items; of items of one length two are enough."""
        twice: dict[int, list[int]] = {}
        for i in items:
            if len(same := twice.setdefault(int(self.lengths[i]), [])) < 2:
                same.append(i)
        by_length = [i for n in sorted(twice) for i in twice[n]]
        found = {int(self.lengths[a]) + int(self.lengths[b]): [a, b] for k, a in enumerate(by_length) for b in by_length[k + 1 :]}
        return sorted(found.items())

    def search(self) -> None:
        """Empty the emptiest bins into the other underfull ones, until the bound is met or no change is left."""
        self.bin_of = np.zeros(len(self.lengths), np.int64)
        for b, items in enumerate(self.items):
            self.bin_of[items] = b
        left, changed = self.count() - self.bound(), True
        while changed and left > 0:
            changed = False
            for low in sorted((b for b, f in enumerate(self.fill) if 0 < f < self.capacity), key=lambda b: self.fill[b]):
                while 0 < self.fill[low] < self.capacity:
                    gain, high, out, back = self._best_change(low)
                    if not gain:
                        break
                    self._change(low, high, out, back)
                    changed = True
                    left -= not self.fill[low]
                if left <= 0:
                    return


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item."""
    bins = Bins(np.asarray(lengths, dtype=np.int64), capacity)
    bins.best_fit_decreasing()
    bins.search()
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for b, items in enumerate(bins.items):
        at = 0
        for i in items:
            where[i], offset[i] = b, at
            at += int(lengths[i])
    return where, offset


def content():
    """A hash of a row's id and text."""
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def surveyed(docs: DataFrame, group_bytes: int) -> tuple[int, np.ndarray]:
    """How many groups the texts' bytes ask for (each row counts 16 bytes besides), and which rows repeat often.

    The latter is a bit for each of SLOTS values of content(), set where equal
    rows together fill more than a PARTS-th of a group. So its size is the same
    for any table. A row that shares its bit with such rows only has its own
    number too. All comes from one pass over the texts.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    rows = docs.select(content().alias("row"), size.alias("size")).groupBy("row").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    often = (F.col("n") > 1) & (F.col("size") * PARTS > group_bytes)
    bit = F.when(often, F.expr("shiftleft(1L, cast(slot & 63 as int))")).otherwise(F.lit(0).cast("long"))
    words = rows.withColumn("slot", F.col("row").bitwiseAND(F.lit(SLOTS - 1))).groupBy(F.shiftright("slot", 6).alias("word"))
    found = words.agg(F.bit_or(bit).alias("bits"), F.sum("size").alias("size")).toArrow()
    bits = np.zeros(SLOTS // 64, np.int64)
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    groups = max(1, -(-int(found.column("size").to_numpy().sum()) // group_bytes))
    return groups, bits if groups > 1 else np.zeros(0, np.int64)


class Turns:
    """Tells the rows of a task that repeat often from each other; 0 for all other rows.

    A row's number depends on its task and on how many of its like came before,
    so a rerun gives the same numbers whatever the order of the task's rows.
    """

    def __init__(self, often: np.ndarray):
        self.bits = often.tolist() if often.any() else None
        self.count: dict[int, int] = {}
        self.first = TaskContext.get().partitionId() << 32

    def of(self, row: int) -> int:
        slot = row & (SLOTS - 1)
        if self.bits is None or not self.bits[slot >> 6] >> (slot & 63) & 1:
            return 0
        self.count[row] = self.count.get(row, 0) + 1
        return self.first + self.count[row]


def pieces(docs: DataFrame, capacity: int, end_id: int, tokenizer_path: str | None, often: np.ndarray) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, turn of every piece; docs has doc_id and text, often is of surveyed()."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("turn", pa.int64())])

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, end, turns = word_ids(tokenizer_path), np.array([end_id], dtype="<u4"), Turns(often)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, row in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("row").to_pylist()):
                turn = turns.of(row)
                ids = np.concatenate([ids_of(text.as_py() or ""), end])
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes()), turn))
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    return docs.select("doc_id", "text", content().alias("row")).mapInArrow(tokenized, "doc_id long, piece int, start long, length long, ids_crc32 long, turn long")


def by_group(dealt: DataFrame, groups: int):
    """Rows grouped by pack_group (from 0), each group in a partition of its own as long as there are not too many."""
    return dealt.repartitionById(min(groups, MOST_PARTITIONS), F.col("pack_group")).groupBy("pack_group")


def packed(docs: DataFrame, capacity: int = 4096, end_id: int = 1, tokenizer_path: str | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Every piece of docs with its sequence and its offset there."""
    groups, often = surveyed(docs, group_bytes)
    dealt = pieces(docs, capacity, end_id, tokenizer_path, often)
    dealt = dealt.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "turn"), F.lit(groups)).cast("int")).drop("turn")

    fields = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = table.column("length").to_numpy()
        where, offset = pack(lengths, capacity)
        first = table.column("pack_group")[0].as_py() << 32
        fill = np.bincount(where, lengths)
        emptiest = int(np.argmin(np.where(fill > 0, fill, capacity)))
        rest = (where == emptiest) & (fill[emptiest] < capacity)
        return table.drop_columns(["pack_group"]).append_column("sequence_id", pa.array(where + first, pa.int64())).append_column("offset", pa.array(offset, pa.int64())).append_column("rest", pa.array(rest))

    def place_again(table: pa.Table) -> pa.Table:
        before = table.drop_columns(["pack_group"])
        after = place(table.drop_columns(["sequence_id", "offset"])).drop_columns(["rest"])
        return after if len(after["sequence_id"].unique()) < len(before["sequence_id"].unique()) else before

    if groups == 1:
        return by_group(dealt, 1).applyInArrow(place, f"{fields}, rest boolean").drop("rest")
    placed = written(by_group(dealt, groups).applyInArrow(place, f"{fields}, rest boolean"), "packed")
    # a group's rest is less than a sequence; so many groups' rests are about a group again
    again = -(-groups // max(2, group_bytes // (4 * capacity)))
    rests = placed.where("rest").drop("rest").withColumn("pack_group", F.lit(groups) + F.pmod(F.shiftright("sequence_id", 32), F.lit(again)))
    return placed.where(~F.col("rest")).drop("rest").unionByName(rests.groupBy("pack_group").applyInArrow(place_again, fields))
