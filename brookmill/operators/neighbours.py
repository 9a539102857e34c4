"""Nearest neighbours among vectors: an inverted file of cells, searched by blocks and ranked by exact distance.

Cells are the nearest centroids of vectors; the centroids are fitted on a
bounded sample, all vectors are put into the index. A query looks into as many
of the nearest cells as a calibration on the sample asks for. Equal vectors are
one node with the few least ids that can matter, so copies cost nothing. A
cell's nodes are dealt into blocks of bounded size, and so are the queries that
look into it; each pair of blocks is one group, and keeps the nearest nodes of
each query only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brookmill.operators.groups import top_per_group
from brookmill.operators.joins import uneven_join
from brookmill.sources.written import passing, written

#: About how many rows the index is fitted on, and how many of them are asked for when the number of cells to look into is chosen.
SAMPLE_ROWS, ASKED_ROWS = 20_000, 400
#: Rows of the sample to a cell at least, and rounds of fitting.
CELL_ROWS, ROUNDS = 40, 12
#: Nodes and queries to a block, about.
BLOCK_NODES, BLOCK_QUERIES = 20_000, 2_000


@dataclass(frozen=True)
class Index:
    """Centroids of the cells, and into how many cells a query looks."""

    centroids: np.ndarray
    probes: int


def _squared(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, less the rows' own lengths, which don't change an order."""
    return (centres**2).sum(1) - 2 * rows @ centres.T


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = whole.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(whole), -1)


def usable(vectors: DataFrame, id: str, vector: str, size: int) -> DataFrame:
    """id and vec of the rows with an id and a vector of `size` finite numbers."""
    good = F.size(vector) == size
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(id).isNotNull() & good & finite).select(F.col(id).alias("id"), F.col(vector).alias("vec"))


def centroids_of(sample: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Cells' centres by rounds of assignment and mean; an empty cell keeps its centre."""
    chosen = np.random.default_rng(seed).choice(len(sample), cells, replace=False)
    centres = sample[chosen].astype(np.float64)
    for _ in range(ROUNDS):
        own = np.argmin(_squared(sample, centres), axis=1)
        sums, n = np.zeros_like(centres), np.bincount(own, minlength=cells)
        np.add.at(sums, own, sample)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(rows: DataFrame, k: int, least_recall: float = 0.95, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Index:
    """An index fitted on about sample_rows of rows (id, vec), which come to the driver.

    There are as many cells as the square root of the number of rows, with
    CELL_ROWS rows of the sample each at least. A query looks into the least
    number of cells that finds least_recall of the k nearest neighbours of
    sampled rows within the sample. In all rows neighbours are nearer than in
    the sample, so they share a cell more often.
    """
    total = rows.count()
    share = min(1.0, sample_rows / max(total, 1))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit("cells"), "id"), F.lit(1_000_000)) < F.lit(share * 1_000_000)).select("vec").toArrow()
    if not drawn.num_rows:
        return Index(np.zeros((1, 1)), 1)
    sample = _matrix(drawn.column("vec"))
    sample = sample[np.lexsort(sample.T)]  # whatever order rows came in
    cells = int(min(max(total**0.5, 1), max(len(sample) // CELL_ROWS, 1)))
    centres = centroids_of(sample, cells, seed)
    own = np.argmin(_squared(sample, centres), axis=1)
    asked = np.random.default_rng(seed).permutation(len(sample))[:ASKED_ROWS]
    # the place of each true neighbour's cell in the order in which the query looks into cells
    place, apart = np.argsort(np.argsort(_squared(sample[asked], centres), axis=1), axis=1), _squared(sample[asked], sample)
    apart[np.arange(len(asked)), asked] = np.inf
    nearest = np.argsort(apart, axis=1)[:, :k]
    looked = np.take_along_axis(place, own[nearest], axis=1).ravel()
    probes = int(np.quantile(looked, least_recall, method="higher")) + 1 if looked.size else cells
    return Index(centres, min(probes, cells))


def _celled(rows: DataFrame, index: Index, probes: int) -> DataFrame:
    """rows (with vec) with `cell`, once for each of the nearest `probes` cells."""
    centres = index.centroids

    def cells(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            if not len(vectors):
                yield pa.array([], pa.list_(pa.int32()))
                continue
            if probes < len(centres):
                nearest = np.argpartition(_squared(_matrix(vectors), centres), probes - 1, axis=1)[:, :probes]
            else:
                nearest = np.tile(np.arange(len(centres)), (len(vectors), 1))
            yield pa.array(list(nearest.astype(np.int32)), pa.list_(pa.int32()))

    of = F.arrow_udf(cells, "array<int>").asNondeterministic()
    return rows.withColumn("cells", of("vec")).select("*", F.explode("cells").alias("cell")).drop("cells")


def _blocks(rows: DataFrame, most: int, name: str) -> DataFrame:
    return rows.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias(name))


def _dealt(key: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(blocks), key), F.col(blocks)).cast("int")


def nearest(
    rows: DataFrame, queries: DataFrame, k: int = 10, index: Index | None = None, exact: bool = False, block_nodes: int = BLOCK_NODES, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """A written table of id, rank, neighbour, distance: the k nearest of rows (id, vec) to each of queries (id, vec), by distance, then id.

    A row is no neighbour of itself (of its own id). Without an index one is
    fitted; exact looks into all cells, so the result is that of comparing
    all, in blocks. Vectors are as usable() gives them.
    """
    with passing() as tables:
        index = index or fit(rows, k)
        kept = top_per_group(rows, ["vec"], [F.col("id")], k + 1).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        nodes = written(_celled(kept, index, 1), "near-nodes")
        asked = written(queries.select("vec").distinct().withColumn("number", F.monotonically_increasing_id()), "near-queries")
        probing = written(_celled(asked, index, len(index.centroids) if exact else index.probes), "near-probes")
        sizes = written(_blocks(nodes, block_nodes, "node_blocks").join(_blocks(probing, block_queries, "query_blocks"), "cell"), "near-sizes")
        every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
        left = nodes.join(F.broadcast(sizes), "cell").withColumns({"node_block": _dealt("vec", "node_blocks"), "query_block": every("query_blocks")})
        right = probing.join(F.broadcast(sizes), "cell").withColumn("query_block", _dealt("number", "query_blocks")).withColumn("node_block", every("node_blocks"))
        groups = ["cell", "node_block", "query_block"]

        def search(a: pa.Table, b: pa.Table) -> pa.Table:
            number, distance, ids = [], [], []
            if a.num_rows and b.num_rows:
                here, ask = _matrix(a.column("vec")), _matrix(b.column("vec"))
                own, query = a.column("ids").to_pylist(), b.column("number").to_pylist()
                lengths = (here**2).sum(1)
                for at in range(0, len(ask), 64):
                    some = ask[at : at + 64]
                    apart = lengths - 2 * some @ here.T
                    n = min(k + 1, len(here))
                    # a little more than the n-th, as products are rounded; then distances themselves
                    limit = np.partition(apart, n - 1, axis=1)[:, n - 1] + 1e-9 * (1 + lengths.max())
                    for i, row in enumerate(apart):
                        close = np.flatnonzero(row <= limit[i])
                        exactly = ((here[close] - some[i]) ** 2).sum(1)
                        order = np.argsort(exactly, kind="stable")
                        last = exactly[order[n - 1]]
                        for j in order[: np.searchsorted(exactly[order], last, "right")]:
                            for x in own[close[j]]:
                                number.append(query[at + i])
                                distance.append(exactly[j])
                                ids.append(x)
            return pa.table({"number": pa.array(number, pa.int64()), "squared": pa.array(distance, pa.float64()), "neighbour": pa.array(ids, pa.int64())})

        found = left.select("vec", "ids", *groups).groupBy(*groups).cogroup(right.select("vec", "number", *groups).groupBy(*groups)).applyInArrow(search, "number long, squared double, neighbour long")
        best = written(top_per_group(found, ["number"], [F.col("squared"), F.col("neighbour")], k + 1), "near-found")
        named = uneven_join(queries, asked, ["vec"]).select("id", "number")
        out = named.join(best.drop("rank"), "number").where(F.col("id") != F.col("neighbour"))
        out = top_per_group(out, ["id"], [F.col("squared"), F.col("neighbour")], k)
        out = written(out.select("id", "rank", "neighbour", F.sqrt("squared").alias("distance")), "near-result")
        tables.keep(out)
    return out


def recall(found: DataFrame, true: DataFrame) -> float:
    """The share of the true neighbours that are found."""
    n = true.count()
    return true.join(found, ["id", "neighbour"], "left_semi").count() / n if n else 1.0
