"""Document fingerprints of closed syncmers.

Of each run of K code points the least hash among its inner runs of S code
points is looked up; if that stands at the first or the last place, the run is a
closed syncmer. Whether a run is one depends on nothing outside it, so an edit
leaves the anchors of all other places as they are. Every stretch of
2 * K - S = 10 code points holds one, so half of a text of 20 does, and about 2
of 5 places are one: a fingerprint takes some 3 times its text. A fingerprint lists all anchors of the
whole text in order, each as 6 hex digits of its hash and 2 of the distance from
the anchor before (from the start for the first; 255 for more). A text without
an anchor, such as one shorter than K, has one anchor for the whole of it: such
texts are alike only if equal. So a text of fewer than 20 code points may have
likeness 0 to one that shares half of it.

The likeness of two fingerprints is the share of anchors, of both together, that
stand in runs which both have, in the same order. A run is RUN neighbouring
anchors with equal hashes, so many that they aren't there by chance; neighbouring
runs form stretches. Stretches are matched by their places: those count whose
places increase in both texts, chosen so that they hold the most anchors. So
text that was moved counts once, on one side of what it was moved past: of
swapped halves one half is left, of shuffled passages few. What is inserted or
taken away between stretches may shift them by any distance. Of a run that
stands several times, the n-th is matched with the n-th, from the start or from
the end. How long a run must be does not grow with the text, so edits of one
density give one likeness at every length.

Nulls: a null text is an empty one, whose fingerprint is one fixed anchor. A row
with a null id comes last; rows with one id are ordered by a hash of the text.
The only row of a table is its own next one. An empty table gives an empty
result. Texts of any length are read whole. Only doc_id and text are read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.functions.columns import place_among
from brookmill.llm.textcode import MULTIPLIER, code_points, mixed_bits

K, S = 6, 2
#: Code points hashed at a time.
PART = 1 << 18
#: Bytes of text to a part of the documents in id order, the most such parts (beyond that, parts are larger,
#: with the same result), and about how many rows are looked at to find their bounds.
PART_BYTES, MOST_PARTS, BOUND_ROWS = 16_000_000, 10_000, 50_000
#: Anchors in one order from which on a run isn't there by chance; fewer, a quarter of them, in a text of less than 4 * RUN anchors.
RUN = 8
#: Characters of fingerprints to a batch of the result; a row counts 400 besides.
BATCH_CHARS = 4_000_000


def _run_hashes(points: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n code points."""
    out = np.zeros(max(len(points) - n + 1, 0), np.uint64)
    for i in range(n if len(out) else 0):
        out = out * np.uint64(MULTIPLIER) + points[i : i + len(out)]
    return mixed_bits(out)


def _joined(hashes: np.ndarray, inner: int) -> np.ndarray:
    """A hash of each run of `inner` neighbouring hashes, by doubling."""
    width, at, out = 1, 0, None
    power = hashes
    while inner >> at:
        if inner >> at & 1:
            done = 0 if out is None else inner & ((1 << at) - 1)
            out = power if out is None else mixed_bits(out[: len(out) - width] * np.uint64(MULTIPLIER) + power[done : done + len(out) - width])
        if inner >> (at + 1):
            power = mixed_bits(power[: len(power) - width] * np.uint64(MULTIPLIER) + power[width:])
            width *= 2
        at += 1
    return out


def _least(hashes: np.ndarray, inner: int) -> np.ndarray:
    """The least of each run of `inner` neighbours."""
    width, out = 1, hashes
    while 2 * width <= inner:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(out) - (inner - width)], out[inner - width :])


def anchors(points: np.ndarray, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places and 24-bit hashes of the closed syncmers of a text's code points."""
    inner, places, found = k - s + 1, [], []
    for at in range(0, len(points) - k + 1, PART):
        part = points[at : at + PART + k - 1].astype(np.uint64)
        small = _run_hashes(part, s)
        least = _least(small, inner)
        edge = np.flatnonzero((small[: len(least)] == least) | (small[inner - 1 :] == least))
        places.append(edge + at)
        found.append(_joined(small, inner)[edge] >> np.uint64(40))
    if not places or not sum(map(len, places)):
        whole = hashlib.md5(points.tobytes()).digest()
        return np.zeros(1, np.int64), np.array([int.from_bytes(whole[:3], "big")], np.int64)
    return np.concatenate(places), np.concatenate(found).astype(np.int64)


def fingerprint(text: str, k: int = K, s: int = S) -> str:
    place, code = anchors(code_points(text), k, s)
    gap = np.minimum(np.diff(place, prepend=0), 255)
    return ((code << 8) | gap).astype(">u4").tobytes().hex()


def _pairs(codes: list[np.ndarray], run: int, from_end: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Where equal runs of anchors begin in two texts, in order of the first; the n-th of equal ones is paired with the n-th
    of the other text, counted from the start or from the end. Whether some run stands more than once."""
    sides, again = [], False
    for v in codes:
        runs = _joined(mixed_bits(v), run)
        order = np.argsort(runs, kind="stable")
        runs = runs[order]
        start = np.flatnonzero(np.append(True, runs[1:] != runs[:-1]))
        size = np.diff(np.append(start, len(runs)))
        turn = np.arange(len(runs)) - np.repeat(start, size)
        if from_end:
            turn = np.repeat(size, size) - 1 - turn
        again |= bool((size > 1).any())
        sides.append((runs + turn.astype(np.uint64) * np.uint64(MULTIPLIER), order))
    _, *found = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
    first, second = sides[0][1][found[0]], sides[1][1][found[1]]
    order = np.argsort(first)
    return first[order], second[order], again


def _heaviest_chain(place: list[int], weight: list[int]) -> int:
    """The greatest weight of a selection whose places increase, in n log n steps."""
    ends: list[int] = []
    best: list[int] = []  # of a selection that ends at `ends`, both increasing
    for at, w in zip(place, weight):
        k = bisect.bisect_left(ends, at)
        total = w + (best[k - 1] if k else 0)
        upto = k
        while upto < len(ends) and best[upto] <= total:
            upto += 1
        if k == upto and k < len(ends) and ends[k] == at:
            continue
        ends[k:upto], best[k:upto] = [at], [total]
    return best[-1] if best else 0


def _in_order(codes: list[np.ndarray], run: int, from_end: bool) -> tuple[int, bool]:
    """How many anchors stand in common runs that have one order in both texts, and whether
    others were left out of which some stand more than once, so that they may be paired otherwise."""
    first, second, again = _pairs(codes, run, from_end)
    if not len(first):
        return 0, False
    # neighbouring pairs are one stretch; stretches don't interleave, as no run is paired twice
    edge = np.flatnonzero(np.append(True, (np.diff(first) != 1) | (np.diff(second) != 1)))
    size = np.diff(np.append(edge, len(first)))
    weight = size + run - 1
    kept = _heaviest_chain(second[edge].tolist(), weight.tolist())
    return kept, again and kept < weight.sum()


def likeness(a: str, b: str) -> float:
    """From 0 to 1; 1 for equal fingerprints. Symmetric."""
    if a == b:
        return 1.0
    codes = [np.frombuffer(bytes.fromhex(v), ">u4").astype(np.uint64) >> np.uint64(8) for v in (a, b)]
    n = list(map(len, codes))
    run = min(max(min(n) // 4, 1), RUN)
    kept, lacking = _in_order(codes, run, False)
    if lacking:
        # where a repeated passage lacks its first copy, the last ones fit
        kept = max(kept, _in_order(codes, run, True)[0])
    return 2 * min(kept, *n) / sum(n)


def edited(text: str, following: str) -> str:
    """text with its last half replaced by as many code points of the next text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


KEY = "struct<k: bigint, h: bigint, r: bigint>"


def constant(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), kind)


def in_order(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, text, part, role: docs cut into parts in order of ids, each part sorted and
    followed by the row that comes next after it.

    role is 0 for a row of the part, 1 for the row after. A row's key is its id,
    a hash of its text and its place in the table, so that parts can end
    anywhere, also within equal rows. The bounds of parts come from about
    BOUND_ROWS rows, drawn by a hash of the key, with the bytes of their texts;
    they and each part's least key come to the driver, MOST_PARTS at most.
    Texts are shuffled once, each part to a partition of its own. docs is read
    three times and has to come in the same order each time, as a table does.
    """
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("k"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.monotonically_increasing_id().alias("r"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    step = -(-docs.count() // BOUND_ROWS) or 1
    seen = docs.where(F.pmod(F.xxhash64("key"), F.lit(step)) == 0).select("key.*", (F.octet_length("text") + F.lit(16)).alias("size")).toArrow()
    k, h, r, size = (seen.column(c).to_numpy() for c in ("k", "h", "r", "size"))
    ranked = np.lexsort((r, h, k))
    upto = np.cumsum(size[ranked]) * step
    parts = int(min(max(upto[-1] // part_bytes, 1), MOST_PARTS)) if len(upto) else 1
    # a bound is the greatest key of its part
    ends = ranked[np.unique(np.searchsorted(upto, [upto[-1] * i // parts for i in range(1, parts)]))] if parts > 1 else []
    bounds = constant([{"k": int(k[i]), "h": int(h[i]), "r": int(r[i])} for i in ends], f"array<{KEY}>")
    docs = docs.withColumn("part", place_among(bounds, F.col("key"), len(ends)))
    least = {x["part"]: x["least"].asDict() for x in docs.groupBy("part").agg(F.min("key").alias("least")).collect()}
    order, every = sorted(least), range(len(ends) + 1)
    before = {p: order[n - 1] for n, p in enumerate(order)}  # the first part comes after the last
    first = F.get(constant([least.get(p) for p in every], f"array<{KEY}>"), F.col("part")) == F.col("key")
    role = lambda part, number: F.struct(part.alias("part"), F.lit(number).alias("role"))
    own, after = role(F.col("part"), 0), role(F.get(constant([before.get(p) for p in every], "array<int>"), F.col("part")), 1)
    placed = docs.select("doc_id", "text", "key", F.inline(F.when(first, F.array(own, after)).otherwise(F.array(own))))
    return placed.repartitionById(len(every), F.col("part")).sortWithinPartitions("part", "role", "key").select("doc_id", "text", "part", "role")


def fingerprints(docs: DataFrame, k: int = K, s: int = S, part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def row(now, following):
        (doc_id, text, own), (_, after, other) = now, following
        changed = edited(text, after)
        print_changed = fingerprint(changed, k, s)
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), sha, own, print_changed, likeness(own, print_changed), likeness(own, other)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = part = None
        rows, size = [], 0
        for batch in batches:
            for doc_id, text, p, role in zip(*[batch.column(c) for c in ("doc_id", "text", "part", "role")]):
                p, role = p.as_py(), role.as_py()
                if held is None and role:
                    continue  # only the first of the rows after a part counts
                text = text.as_py()
                now = doc_id.as_py(), text, fingerprint(text, k, s)
                if held is not None and p == part:
                    rows.append(row(held, now))
                    size += len(rows[-1][3]) + len(rows[-1][4]) + 400
                    if size >= BATCH_CHARS:
                        yield batch_of(rows)
                        rows, size = [], 0
                held, part = (None if role else now), p
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(docs, part_bytes).mapInArrow(pairs, fields)
