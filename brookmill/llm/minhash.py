"""Near duplicates by ProbMinHash signatures, banding and exact verification.

A text is a weighted set of its five-word shingles; a shingle that stands there
c times weighs 1 + ln(c). Texts with fewer words are one shingle. Every shingle
is a Poisson process of arrivals with its weight as rate; each arrival falls
into one of the registers, and a register keeps the shingle that arrives first.
Shingles whose next arrival is later than the latest register drop out, so the
work ends early. Two signatures agree in a register with a probability equal to
the probability Jaccard of the sets.

Texts with equal sets are one node. Nodes that share a band of registers are
candidates. In each bucket all nodes are first compared with one of them, which
settles a group of copies in linear work. Where a bucket then still holds nodes
of several components, those outside its largest component are compared with
all others, block by block within tasks: the signatures first, then the sets.
Buckets too large for sets to be dealt so often are divided by each further
band; for the pairs in them that share no further band the signatures alone are
compared block by block, and few pass. So every pair that shares a band is
compared, whatever the size of its buckets. A link needs a probability Jaccard
of at least the threshold, taken on the sets themselves; between two components
one link is enough. Classes are the connected components of links.

Texts of any length are coded whole; blocks are bounded by the bytes of their
sets as well as by their number. Nulls: a null text is an empty one, and texts without a word are one class; a
null id is a row like others. Repeated rows are members of one class. A class
has the least id of its members, null if they have none. An empty table gives
an empty result. Clashing columns of the input do not matter: only doc_id and
text are read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookmill.llm.components import connected
from brookmill.llm.store import join_checked, passing, set_apart, written
from brookmill.llm.textcode import MULTIPLIER, mixed_bits, shingle_codes, word_codes

REGISTERS, ROWS = 128, 4
#: Sets compared at a time, by number and by shingles; signatures alone, 8 times as many.
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
#: Block pairs up to which a bucket is compared as it is, and levels of division.
MOST_BLOCKS, LEVELS = 16, 3
#: Standard deviations by which the share of equal registers may fall short of the threshold.
DEVIATIONS = 5.5


def shingle_set(text: str, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of a text's shingles, and how often each stands there."""
    return np.unique(shingle_codes(word_codes(text), size), return_counts=True)


def weights_of(counts: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(counts)


def signature(codes: np.ndarray, weights: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The shingle that comes first in each register, as 16 bits of its code; 2,048 registers at most."""
    if not 0 < registers <= 1 << 11:
        raise ValueError("registers must be from 1 to 2048")
    best, winner = np.full(registers, np.inf), np.zeros(registers, np.uint64)
    # enough arrivals at a time to fill the registers of a small set at once
    step = max(1, int(1.2 * registers * (np.log(registers) + 0.6) / max(len(codes), 1)))
    clock, at = np.zeros(len(codes)), 0
    while len(codes):
        turn = np.arange(at + 1, at + step + 1, dtype=np.uint64) * np.uint64(MULTIPLIER)
        bits = mixed_bits(codes[:, None] + turn)
        waits = -np.log(((bits >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53)
        times = clock[:, None] + np.cumsum(waits, axis=1) / weights[:, None]
        slot = ((bits & np.uint64(0x7FF)) % np.uint64(registers)).astype(np.int64)
        near = times < best[slot]
        np.minimum.at(best, slot[near], times[near])
        first = near & (times == best[slot])
        winner[slot[first]] = np.broadcast_to(codes[:, None], times.shape)[first]
        going = times[:, -1] < best.max()
        clock, codes, weights, at = times[going, -1], codes[going], weights[going], at + step
    return (mixed_bits(winner) >> np.uint64(48)).astype("<u2")


def probability_jaccard(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """Of two weighted sets, each given by sorted codes and weights."""
    shared, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(shared):
        return 0.0
    only_a, only_b, x, y = x.sum() - x[i].sum(), y.sum() - y[j].sum(), x[i], y[j]
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    above = np.cumsum(x[::-1])[::-1]
    below = np.cumsum(y) - y
    return float(np.sum(1.0 / ((only_a + above) / x + (only_b + below) / y)))


def plain_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(len(a) + len(b) - both, 1)


def signed(docs: DataFrame, size: int, registers: int) -> DataFrame:
    """doc_id, near_text (a hash of the text), near_key (equal for equal sets), near_size, near_sig of each row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, sigs = [], [], []
            for text in batch.column("text"):
                codes, counts = shingle_set(text.as_py() or "", size)
                keys.append(hashlib.md5(codes.tobytes() + counts.astype("<u4").tobytes()).digest())
                sizes.append(len(codes))
                sigs.append(signature(codes, weights_of(counts), registers).tobytes())
            columns = [batch.column("doc_id"), batch.column("near_text"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "near_text", "near_key", "near_size", "near_sig"])

    rows = docs.select("doc_id", "text", text_hash().alias("near_text"))
    fields = [rows.schema["doc_id"], T.StructField("near_text", T.LongType()), T.StructField("near_key", T.BinaryType()), T.StructField("near_size", T.IntegerType()), T.StructField("near_sig", T.BinaryType())]
    return rows.mapInArrow(sign, T.StructType(fields))


def band(sig, i: int, rows: int = ROWS):
    return F.substring(sig, 2 * rows * i + 1, 2 * rows)


def bucket_rows(texts: DataFrame, registers: int, rows: int) -> DataFrame:
    """near_bucket, near_band, near_key, near_size: one row per band of each node."""
    bands = F.array(*[F.xxhash64(F.lit(i), band(F.col("near_sig"), i, rows)) for i in range(registers // rows)])
    return texts.select("near_key", "near_size", F.posexplode(bands).alias("near_band", "near_bucket"))


def shared_buckets(texts: DataFrame, registers: int, rows: int) -> DataFrame:
    """The bucket rows of buckets with two nodes or more, each with its bucket's first node."""
    all_rows = bucket_rows(texts, registers, rows)
    firsts = all_rows.groupBy("near_bucket").agg(F.min("near_key").alias("near_first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return all_rows.join(written(firsts, "near-firsts"), "near_bucket")


def handle(doc_id):
    return F.coalesce(doc_id.cast("string"), F.lit(""))


def text_hash():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def sets_of(nodes: DataFrame, texts: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """near_key, near_codes, near_weights (empty where all are 1) of the nodes (near_key), as a written table.

    A node's text is found by an id and a hash of the text, so where ids repeat or are null each node still meets its own text only.
    """
    asked = written(texts.join(nodes, "near_key").select("near_at.near_handle", "near_at.near_text", "near_key"), "near-asked")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found, weights = [], [], []
            for key, text in zip(batch.column("near_key").to_pylist(), batch.column("text")):
                codes, counts = shingle_set(text.as_py() or "", size)
                short, at = np.unique(codes.astype(np.uint32), return_index=True)
                keys.append(key)
                found.append(short.astype("<u4").tobytes())
                weights.append(b"" if counts.max() == 1 else weights_of(counts[at]).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in (keys, found, weights)], names=["near_key", "near_codes", "near_weights"])

    keyed = docs.select("text", handle(F.col("doc_id")).alias("near_handle"), text_hash().alias("near_text"))
    rows = join_checked(keyed, asked, ["near_handle", "near_text"], "inner").select("near_key", "text")
    return written(rows.mapInArrow(sets, "near_key binary, near_codes binary, near_weights binary").dropDuplicates(["near_key"]), "near-sets")


def alike(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether the probability Jaccard is at least the threshold; sets without weights have weights of 1."""
    if not len(x) and not len(y):
        return plain_jaccard(a, b) >= threshold
    x, y = (w.astype(np.float64) if len(w) else np.ones(n) for w, n in ((x, len(a)), (y, len(b))))
    return probability_jaccard(a, x, b, y) >= threshold


def verified(pairs: DataFrame, table: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are alike enough; both tables are written ones."""
    side = lambda k: table.select(F.col("near_key").alias(k), F.col("near_codes").alias(f"codes_{k}"), F.col("near_weights").alias(f"weights_{k}"))

    def good_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for row in zip(*[batch.column(c) for c in ("codes_a", "weights_a", "codes_b", "weights_b")]):
                a, x, b, y = [np.frombuffer(v.as_buffer(), "<u4" if k % 2 == 0 else "<f4") for k, v in enumerate(row)]
                good.append(alike(a, x, b, y, threshold))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    # the side that may be a hub comes last, when the other side's set is already there
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(good_ones, "a binary, b binary")


def unsettled(rows: DataFrame, block: int) -> DataFrame:
    """Those rows (near_bucket, near_band, near_key, near_size, near_root) in whose bucket several components meet,
    with how many nodes it has (near_all), how many outside its largest component (near_rest), into how many
    blocks of sets both are dealt (near_parts, near_rest_parts), and whether the row is one of the rest (near_out)."""
    by_root = rows.groupBy("near_bucket", "near_root").agg(F.count("*").alias("n"), F.sum("near_size").alias("size"))
    buckets = by_root.groupBy("near_bucket").agg(
        F.sum("n").alias("near_all"), F.sum("size").alias("all_size"), F.max(F.struct("n", "near_root", "size")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    parts = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size / BLOCK_SHINGLES)).cast("int")
    rest = F.col("near_all") - F.col("most.n")
    buckets = buckets.select(
        "near_bucket", "near_all", rest.alias("near_rest"), parts(F.col("near_all"), F.col("all_size")).alias("near_parts"),
        parts(rest, F.col("all_size") - F.col("most.size")).alias("near_rest_parts"), F.col("most.near_root").alias("near_most"))
    return rows.join(written(buckets, "near-mixed"), "near_bucket").withColumn("near_out", F.col("near_root") != F.col("near_most")).drop("near_most")


class Signatures:
    """The signatures of some rows, and their bands as numbers."""

    def __init__(self, table: pa.Table, registers: int, rows: int, threshold: float):
        self.sig = np.frombuffer(b"".join(table.column("near_sig").to_pylist()), "<u2").reshape(table.num_rows, registers)
        parts = self.sig[:, : registers // rows * rows].reshape(table.num_rows, registers // rows, rows)
        self.bands = np.zeros(parts.shape[:2], np.uint64)
        for k in range(rows):
            self.bands = mixed_bits(self.bands * np.uint64(MULTIPLIER) + parts[:, :, k])
        self.lowest = threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / registers)

    def likely(self, k: int, others: np.ndarray, first: int | None, bands: int) -> np.ndarray:
        """Those of the others that share so many bands with k, counted up to `first` (or all), and enough registers."""
        shared = (self.bands[others, : None if first is None else first + 1] == self.bands[k, : None if first is None else first + 1]).sum(axis=1)
        some = others[shared == bands]
        return some[(self.sig[some] == self.sig[k]).mean(axis=1) >= self.lowest]


def links_within(table: pa.Table, registers: int, rows: int, threshold: float, level: int) -> pa.Table:
    """Links between the components that meet in a group of rows, one for each two components that they join.

    Two nodes meet once for each set of level + 1 bands that they share; they are compared where these are the first.
    """
    keys, names, last = table.column("near_key").to_pylist(), table.column("near_root").to_pylist(), table.column("near_band")[0].as_py()
    number: dict[bytes, int] = {}
    root = np.array([number.setdefault(r, len(number)) for r in names])
    asks, signed_rows = table.column("asks").to_numpy(), Signatures(table, registers, rows, threshold)
    codes = [np.frombuffer(v, "<u4") for v in table.column("near_codes").to_pylist()]
    weights = [np.frombuffer(v, "<f4") for v in table.column("near_weights").to_pylist()]
    others, found = np.flatnonzero(~asks), []
    for k in np.flatnonzero(asks).tolist() if len(others) else []:
        tried = signed_rows.likely(k, others[root[others] != root[k]], last, level + 1)
        if not len(tried):
            continue
        # shared shingles of all that are tried at once; without weights they tell the likeness
        sizes = np.array([len(codes[o]) for o in tried])
        flat, owner = np.concatenate([codes[o] for o in tried]), np.repeat(np.arange(len(tried)), sizes)
        at = np.minimum(np.searchsorted(codes[k], flat), len(codes[k]) - 1)
        both = np.bincount(owner[codes[k][at] == flat], minlength=len(tried))
        plain = both / (sizes + len(codes[k]) - both) >= threshold
        for o, fits in zip(tried.tolist(), plain.tolist()):
            if root[o] == root[k]:
                continue
            if len(weights[k]) or len(weights[o]):
                fits = alike(codes[k], weights[k], codes[o], weights[o], threshold)
            if fits:
                found.append((keys[k], keys[o]))
                root[root == root[o]] = root[k]
    return pa.table([pa.array([p[n] for p in found], pa.binary()) for n in (0, 1)], names=["a", "b"])


def lone_pairs_within(table: pa.Table, registers: int, rows: int, threshold: float, level: int) -> pa.Table:
    """Pairs of a group's rows in different components that share level + 1 bands in all and whose signatures are alike enough."""
    keys = table.column("near_key").to_pylist()
    root = np.unique(np.array(table.column("near_root").to_pylist(), object), return_inverse=True)[1]
    asks, signed_rows = table.column("asks").to_numpy(), Signatures(table, registers, rows, threshold)
    others, found = np.flatnonzero(~asks), []
    for k in np.flatnonzero(asks).tolist():
        found += [tuple(sorted((keys[k], keys[o]))) for o in signed_rows.likely(k, others[root[others] != root[k]], None, level + 1)]
    return pa.table([pa.array([p[n] for p in found], pa.binary()) for n in (0, 1)], names=["a", "b"])


def in_blocks(rows: DataFrame, parts, rest_parts, columns: list[str], within) -> DataFrame:
    """within() of each pair of blocks: a bucket's nodes are dealt into `parts` blocks, those
    outside its largest component into `rest_parts`; each pair of two is one group, of bounded size."""
    own = lambda n: F.pmod(F.xxhash64("near_key"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = rows.select(*columns, own(parts).alias("i"), every(rest_parts).alias("j"), F.lit(False).alias("asks"))
    right = rows.where("near_out").select(*columns, every(parts).alias("i"), own(rest_parts).alias("j"), F.lit(True).alias("asks"))
    return left.unionByName(right).groupBy("near_bucket", "i", "j").applyInArrow(lambda table: within(table), "a binary, b binary")


def remaining_links(
    shared: DataFrame, roots: DataFrame, texts: DataFrame, docs: DataFrame, size: int, registers: int, rows: int, threshold: float,
    block: int, most_blocks: int, levels: int,
) -> DataFrame | None:
    """Links between components that meet in a bucket; None if there are no such buckets. shared and roots are written tables."""
    current = shared.join(roots.select(F.col("node").alias("near_key"), F.col("root")), "near_key", "left")
    current = current.select("near_bucket", "near_band", "near_key", "near_size", F.coalesce("root", "near_key").alias("near_root"))
    signatures, given = texts.select("near_key", "near_sig"), {"registers": registers, "rows": rows, "threshold": threshold}
    columns = ["near_bucket", "near_band", "near_key", "near_root", "near_sig"]
    out, sets = [], None
    for level in range(levels + 1):
        open_rows = written(unsettled(current, block), "near-open")
        last = (F.col("near_band") == registers // rows - 1) | F.lit(level == levels)
        small = (F.col("near_parts") * F.col("near_rest_parts") <= most_blocks) | last
        sizes = open_rows.agg(F.count_if(small), F.count_if(~small)).first()
        if sum(sizes) and sets is None:  # later levels have no other nodes
            sets = sets_of(open_rows.select("near_key").distinct(), texts, docs, size)
        if sizes[0]:
            full = open_rows.where(small).join(signatures, "near_key").join(sets, "near_key")
            links = functools.partial(links_within, level=level, **given)
            out.append(written(in_blocks(full, F.col("near_parts"), F.col("near_rest_parts"), [*columns, "near_codes", "near_weights"], links), "near-links"))
        if not sizes[1]:
            break
        large = open_rows.where(~small).join(signatures, "near_key")
        blocks = lambda n: F.ceil(F.col(n) / (8 * block)).cast("int")
        lone = in_blocks(large, blocks("near_all"), blocks("near_rest"), columns, functools.partial(lone_pairs_within, level=level, **given))
        out.append(written(verified(written(lone.distinct(), "near-lone"), sets, threshold), "near-links"))
        later = F.filter(F.array(*[F.struct(F.lit(i).alias("near_band"), F.xxhash64("near_bucket", F.lit(i), band(F.col("near_sig"), i, rows)).alias("near_bucket")) for i in range(registers // rows)]), lambda x: x["near_band"] > F.col("near_band"))
        current = large.select("near_key", "near_size", "near_root", F.inline(later))
    return functools.reduce(DataFrame.unionByName, out) if out else None


def near_classes(
    docs: DataFrame, threshold: float = 0.8, size: int = 5, registers: int = REGISTERS, rows: int = ROWS,
    block: int = BLOCK, most_blocks: int = MOST_BLOCKS, levels: int = LEVELS,
) -> DataFrame:
    """One row per row of docs: doc_id, near_text (a hash of the text), class_id, class_size,
    class_links (verified links between its different sets, one at least for each but the first),
    class_key (the class's own, as two classes may have one id where ids repeat or are null)."""
    docs = docs.select("doc_id", "text")
    with passing() as tables:
        members = written(signed(docs, size, registers), "near-signed")
        at = F.struct(handle(F.col("doc_id")).alias("near_handle"), "near_text")
        texts = written(
            members.groupBy("near_key").agg(
                F.min("doc_id").alias("near_doc"), F.min(at).alias("near_at"), F.count("*").alias("near_rows"), F.first("near_size").alias("near_size"), F.first("near_sig").alias("near_sig")),
            "near-texts",
        )
        full = texts.where("near_size > 0")
        shared = written(shared_buckets(full, registers, rows), "near-shared")
        stars = shared.where(F.col("near_key") != F.col("near_first")).select(F.col("near_key").alias("a"), F.col("near_first").alias("b")).distinct()
        stars = written(stars, "near-stars")
        nodes = stars.select(F.col("a").alias("near_key")).unionByName(stars.select(F.col("b").alias("near_key"))).distinct()
        links = written(verified(stars, sets_of(nodes, full, docs, size), threshold), "near-links")
        roots = written(connected(links), "near-roots")
        more = remaining_links(shared, roots, full, docs, size, registers, rows, threshold, block, most_blocks, levels)
        if more is not None and more.limit(1).count():
            # a component stays tied to its root
            tied = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            roots = written(connected(tied.unionByName(more)), "near-roots")
            links = links.unionByName(more)
        nodes = texts.select("near_key", "near_doc", "near_rows").join(roots.select(F.col("node").alias("near_key"), "root"), "near_key", "left")
        nodes = written(nodes.select("near_key", "near_doc", "near_rows", F.coalesce("root", "near_key").alias("near_root")), "near-nodes")
        counted = links.join(roots, F.col("a") == F.col("node")).groupBy(F.col("root").alias("near_root")).agg(F.count("*").alias("class_links"))
        classes = nodes.groupBy("near_root").agg(F.min("near_doc").alias("class_id"), F.sum("near_rows").alias("class_size")).join(counted, "near_root", "left")
        classes = written(classes.withColumn("class_links", F.coalesce("class_links", F.lit(0))), "near-classes")
        named = written(nodes.select("near_key", "near_root").join(classes, "near_root").select("near_key", "class_id", "class_size", "class_links", F.col("near_root").alias("class_key")), "near-named")
        tables.keep(members, named)
    return members.select("doc_id", "near_text", "near_key").join(named, "near_key").select("doc_id", "near_text", "class_id", "class_size", "class_links", "class_key")


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """docs with one row of each class: one with the class's least id. Columns stay."""
    docs, back = set_apart(docs, ("doc_id", "text"))
    on = ["near_handle", "near_text"]
    with passing() as tables:
        found = near_classes(docs, **parameters).where("class_size > 1")
        found = written(found.select(handle(F.col("doc_id")).alias("near_handle"), "near_text", "class_key", (handle(F.col("doc_id")) == handle(F.col("class_id"))).alias("near_least")), "near-found")
        # a class's least id may stand on several rows: of these, the text with the least hash stays
        first = found.where("near_least").groupBy("class_key", "near_handle", "near_text").agg(F.count("*").alias("n"))
        first = first.groupBy("class_key").agg(F.min_by(F.struct("near_handle", "near_text", "n"), "near_text").alias("stays"))
        first = written(first.select("stays.near_handle", "stays.near_text", "stays.n"), "near-first")
        dropped = written(found.select(*on).distinct().join(first.select(*on), on, "left_anti"), "near-dropped")
        again = written(first.where("n > 1").select(*on), "near-again")
        tables.keep(dropped, again)
    keyed = docs.withColumns({"near_handle": handle(F.col("doc_id")), "near_text": text_hash()})
    rest = join_checked(keyed, dropped, on, "left_anti")
    if not again.limit(1).count():
        return back(rest)
    single = join_checked(rest, again, on, "left_anti")
    repeated = join_checked(rest, again, on, "left_semi").dropDuplicates(on)
    return back(single.unionByName(repeated))
