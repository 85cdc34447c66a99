"""Blocks of the neighbour search: one list for each query, bounded copies, bounded memory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetscope.operators import knn as N
from tests.conftest import rows


def ranked(queries, entries, k):
    distance = np.round(1.0 - N._unit(queries) @ N._unit(entries).T, N.DISTANCE_DIGITS)
    order = np.lexsort((np.broadcast_to(np.arange(len(entries)), distance.shape), distance), axis=1)[:, :k]
    return order, np.take_along_axis(distance, order, axis=1)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("tile", (3, 1_024))
def test_lists_equal_a_full_sort_in_any_order_of_batches(monkeypatch, seed, tile):
    monkeypatch.setattr(N, "TILE", tile)
    rng = np.random.default_rng(seed)
    # few distinct directions, so that many distances are equal, and scaled copies
    entries = rng.choice([-1.0, 0.0, 1.0], (300, 4 + seed)) * rng.choice([0.5, 1.0, 3.0], (300, 1)) if seed % 2 else rng.normal(size=(300, 16))
    entries = entries[np.abs(entries).sum(axis=1) > 0]
    queries = np.concatenate([entries[:20], rng.normal(size=(20, entries.shape[1]))])
    nearest = N._Nearest([np.arange(40)], [queries], 7)
    at = rng.permutation(len(entries))
    for part in np.array_split(at, [2, 5, 60, 200]):
        nearest.meet(part, entries[part])
    order, distance = ranked(queries, entries, 7)
    assert np.allclose(nearest.distance, distance, atol=1e-11) and (nearest.filled == 7).all()
    if seed % 2 == 0:
        assert (nearest.entry == order).all()
    else:  # equal distances come by id, but for the last digit of the product
        assert np.mean(nearest.entry == order) > 0.9


def test_fewer_entries_than_k():
    nearest = N._Nearest([np.arange(2)], [np.eye(2)], 5)
    nearest.meet(np.array([7, 3]), np.array([[1.0, 0.0], [1.0, 0.0]]))
    assert nearest.filled.tolist() == [2, 2] and nearest.entry[:, :2].tolist() == [[3, 7], [3, 7]]


def lsh_inputs(spark, n):
    vector = F.array(*[F.hash("id", F.lit(i)) / F.lit(2.0**31) for i in range(6)]).cast("array<float>")
    items = spark.range(n).select("id", vector.alias("embedding"))
    return items.withColumnRenamed("id", "query_id"), items.withColumnRenamed("id", "entry_id")


def test_one_list_comes_out_for_each_query(spark):
    """The search puts out k rows for each query, not k for each of its blocks."""
    q, e = lsh_inputs(spark, 600)
    asked, entries = q.select("query_id", "embedding"), e.select("entry_id", "embedding")
    found = N._search_blocks(entries, asked, 4, [], 5)
    assert found.groupBy("query_id").count().where("count <> 4").count() == 0 and found.count() == 2_400
    assert rows(found.groupBy(F.spark_partition_id()).count().agg(F.count(F.lit(1)))) == [(5,)]


def test_entries_are_not_copied_for_queries_of_other_buckets(spark):
    """9,000 queries in 16 buckets of each table: one block a bucket does, whatever the number of all queries."""
    q, e = lsh_inputs(spark, 9_000)
    found = N.knn_lsh(q, e, 2, dims=6, tables=3, bits=4)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_salts" in plan and "sequence(0, 2" not in plan and "CoGroup" not in plan
