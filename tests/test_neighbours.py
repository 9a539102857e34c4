"""Nearest neighbours: exact search against numpy, recall of the index, copies, odd vectors, small blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brookmill.operators.neighbours import fit, nearest, recall, usable
from brookmill.plans import catalog
from brookmill.sources.tables import table


def plain(ids, x, asked, k):
    out = []
    for i in asked:
        d = np.sqrt(((x - x[ids.index(i)]) ** 2).sum(1))
        near = sorted((d[j], ids[j]) for j in range(len(ids)) if ids[j] != i)[:k]
        out += [(i, n, other, round(float(apart), 6)) for n, (apart, other) in enumerate(near, 1)]
    return out


def rows(spark, ids, x):
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in zip(ids, x)], "id long, e array<float>").repartition(5)
    return usable(df, "id", "e", x.shape[1])


def taken(found):
    return sorted((r.id, r["rank"], r.neighbour, round(r.distance, 6)) for r in found.collect())


@pytest.mark.parametrize("block_nodes,block_queries", [(20_000, 2_000), (40, 7)])
def test_exact_search_with_copies(spark, block_nodes, block_queries):
    """A third of all rows are one vector; blocks are small; ties go to lesser ids."""
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(600, 8)), 1).astype(np.float32)
    x[200:400] = x[0]
    ids = [int(i) for i in rng.permutation(5000)[:600]]
    df = rows(spark, ids, x)
    asked = [i for i in ids if i % 5 == 0]
    got = nearest(df, df.where("id % 5 = 0"), 4, exact=True, block_nodes=block_nodes, block_queries=block_queries)
    assert taken(got) == sorted(plain(ids, x.astype(np.float64), asked, 4))


def test_recall_of_the_index(spark):
    """On the test data, which have no clusters, and on clusters, where few cells are looked into."""
    df = usable(table(spark, "/root/testdata/sf0.1", "embeddings"), "vec_id", "embedding", 64)
    asked = df.where("id % 50 = 0")
    assert recall(nearest(df, asked, 10), nearest(df, asked, 10, exact=True)) >= 0.9
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] * 5 + rng.normal(size=(3000, 16))).astype(np.float32)
    df = rows(spark, list(range(3000)), x)
    index = fit(df, 5)
    assert index.probes < len(index.centroids) / 4
    asked = df.where("id % 50 = 0")
    assert recall(nearest(df, asked, 5, index=index), nearest(df, asked, 5, exact=True)) >= 0.9


def test_odd_vectors_and_few_rows(spark):
    good = [1.0, 2.0]
    df = spark.createDataFrame([(1, good), (2, [1.0, 3.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (None, good), (8, good)], "id long, e array<float>")
    df = usable(df, "id", "e", 2)
    assert sorted(r.id for r in df.collect()) == [1, 2, 8]
    assert [(r.id, r["rank"], r.neighbour) for r in nearest(df, df, 3).orderBy("id", "rank").collect()] == [(1, 1, 8), (1, 2, 2), (2, 1, 1), (2, 2, 8), (8, 1, 1), (8, 2, 2)]
    assert nearest(df.where("false"), df, 3).collect() == [] and nearest(df, df.where("false"), 3).collect() == []
    assert nearest(df.where("id = 1"), df.where("id = 1"), 3).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    found, true = (catalog.QUERIES[n](spark, folder).select(F.col("vec_id").alias("id"), "neighbour") for n in ("nearest_vectors", "nearest_vectors_exact"))
    assert true.count() == 100 and recall(found, true) >= 0.9
