"""Token-id matrices: best-fit-decreasing packing with a segment tree, lossless splits.

Texts become ids of a byte-level tokenizer, with an end id after each; ids of a
document that is longer than a sequence are cut into full pieces and a rest, so
nothing is lost. Pieces are dealt by a hash into groups of a bounded size, rows
that repeat often one by one, and each group is packed on its own: pieces in descending length go to the sequence
with the least room that still holds them, which a segment tree over the
possible rooms finds in log(capacity) steps.

A row of the result is a sequence: the row of the id matrix (padded to the
capacity), its cumulative segment lengths (from 0), the places where positions
start again from 0, the positions themselves, and where each segment came from.
`write` stores them as Parquet, and `restored` gives the documents' ids back.

Nulls: a null text is an empty one, whose ids are the end id only; a null id is
kept. Repeated rows are packed as often as they come. An empty table gives an
empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookmill.llm.packing import Turns, by_group, content, surveyed
from brookmill.llm.tokens import byte_encoding, byte_ids

CAPACITY = 4096
#: The id after each document and in the padding of a row; the first that the vocabulary leaves free.
END_ID = 50_256
#: Bytes of text to a packing group.
GROUP_BYTES = 16_000_000
SEQUENCE = (
    "sequence_id long, n_tokens int, ids binary, positions binary, cu_seqlens array<int>, resets array<int>,"
    " doc_ids array<long>, pieces array<int>, starts array<long>"
)


class Rooms:
    """A segment tree over rooms 0..capacity: which of them some sequence has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << int(capacity).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.with_room: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def put(self, sequence: int, room: int) -> None:
        self.with_room[room].append(sequence)
        self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """A sequence of the least room that is at least size, and that room."""
        at = size + self.leaves
        if not self.count[at]:
            # up to the first right-hand neighbour that has some room, then down its left side
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return self.with_room[room].pop(), room


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Item numbers of each sequence, in the order in which they were placed."""
    rooms, sequences = Rooms(capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = rooms.take(lengths[item])
        if found is None:
            found = len(sequences), capacity
            sequences.append([])
        sequence, room = found
        sequences[sequence].append(item)
        rooms.put(sequence, room - lengths[item])
    return sequences


def pieces(docs: DataFrame, capacity: int, end_id: int, tokenizer_path: str | None, often: np.ndarray) -> DataFrame:
    """doc_id, piece, start, ids (little-endian unsigned 16-bit), turn of every piece; often is of packing's surveyed()."""
    if end_id >= 1 << 16 or capacity >= 1 << 16:
        raise ValueError("ids and positions must fit 16 bits")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("ids", pa.binary()), ("turn", pa.int64())])

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, turns = byte_ids(tokenizer_path), Turns(often)
        for batch in batches:
            rows = []
            for doc_id, text, row in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("row").to_pylist()):
                turn = turns.of(row)
                ids = array("H", ids_of(text.as_py() or ""))
                ids.append(end_id)
                if sys.byteorder == "big":
                    ids.byteswap()
                rows += [(doc_id, k, at, ids[at : at + capacity].tobytes(), turn) for k, at in enumerate(range(0, len(ids), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, schema.types)], schema=schema)

    return docs.select("doc_id", "text", content().alias("row")).mapInArrow(tokenized, "doc_id long, piece int, start long, ids binary, turn long")


def sequences(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer_path: str | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per packed sequence; see SEQUENCE for the columns."""
    groups, often = surveyed(docs, group_bytes)
    dealt = pieces(docs, capacity, end_id, tokenizer_path, often)
    dealt = dealt.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "ids", "turn"), F.lit(groups)).cast("int")).drop("turn")
    names = [c.split()[0] for c in SEQUENCE.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    schema = pa.schema(list(zip(names, kinds)))

    def pack(table: pa.Table) -> pa.Table:
        first = table.column("pack_group")[0].as_py() << 32
        rows = sorted(zip(*[table.column(c).to_pylist() for c in ("doc_id", "piece", "start", "ids")]), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[3]))
        lengths, out = [len(r[3]) // 2 for r in rows], []
        for n, items in enumerate(best_fit_decreasing(lengths, capacity)):
            ids = np.full(capacity, end_id, "<u2")
            own = np.frombuffer(b"".join(rows[i][3] for i in items), "<u2")
            ids[: len(own)] = own
            ends = np.cumsum([0, *[lengths[i] for i in items]])
            resets = np.append(ends, [] if ends[-1] == capacity else [capacity]).astype(np.int64)  # padding is a segment of its own
            positions = np.arange(capacity) - np.repeat(resets[:-1], np.diff(resets))
            out.append((
                first + n, len(own), ids.tobytes(), positions.astype("<u2").tobytes(), ends.tolist(), resets[:-1].tolist(),
                [rows[i][0] for i in items], [rows[i][1] for i in items], [rows[i][2] for i in items],
            ))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), kinds)], schema=schema)

    return by_group(dealt, groups).applyInArrow(pack, SEQUENCE)


def write(packed: DataFrame, folder: str) -> None:
    """Store sequences as Parquet, by Spark's writer: any store will do, and a lost task is simply written again."""
    packed.write.mode("errorifexists").parquet(folder)


def matrices(rows: list, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Id matrix and position matrix of some rows, such as one training batch."""
    return tuple(np.frombuffer(b"".join(bytes(r[c]) for r in rows), "<u2").reshape(-1, capacity) for c in ("ids", "positions"))


def restored(packed: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, text of documents with an id of their own, from their packed pieces."""
    segment = F.inline(F.arrays_zip("doc_ids", "starts", F.slice("cu_seqlens", F.lit(1), F.size("doc_ids")).alias("at"), F.slice("cu_seqlens", F.lit(2), F.size("doc_ids")).alias("end")))
    parts = packed.select("ids", segment).select(F.col("doc_ids").alias("doc_id"), F.col("starts").alias("start"), F.expr("substring(ids, 2 * at + 1, 2 * (end - at))").alias("part"))
    joined = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "part"))).alias("parts"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = byte_encoding(tokenizer_path)
        for batch in batches:
            texts = [encoding.decode(np.frombuffer(b"".join(p["part"] for p in parts), "<u2")[:-1].tolist()) for parts in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return joined.mapInArrow(decode, "doc_id long, text string")
