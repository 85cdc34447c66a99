"""Pairs of a class against all pairs of small classes."""

from itertools import combinations

import pytest

from fleetscope.sources import pairs
from tests.conftest import rows

SIZES = {"a": 1, "b": 2, "c": 3, "d": 8, "e": 9}


def items(spark):
    data = [(label, 100 * k + 7 * i) for k, (label, n) in enumerate(SIZES.items()) for i in range(n)]
    # repeated rows, rows without a class or id
    return data, spark.createDataFrame([*data, *data[:4], (None, 1), ("a", None)], "label string, id bigint")


def test_all_pairs_at_full_degree(spark):
    data, df = items(spark)
    want = {(l, x, y) for l in SIZES for x, y in combinations(sorted(i for k, i in data if k == l), 2)}
    got = rows(pairs.class_pairs(df, "label", "id", 20), "label", "a", "b")
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("degree", [1, 2, 3, 4])
def test_each_item_meets_the_next_ones(spark, monkeypatch, degree):
    monkeypatch.setattr(pairs, "PLACE_ROWS", 2)
    data, df = items(spark)
    want = set()
    for label in SIZES:
        ring = sorted(i for k, i in data if k == label)
        for at, x in enumerate(ring):
            for d in range(1, min(degree, len(ring) - 1) + 1):
                y = ring[(at + d) % len(ring)]
                want.add((label, min(x, y), max(x, y)))
    got = rows(pairs.class_pairs(df, "label", "id", degree), "label", "a", "b")
    assert len(got) == len(want) and set(got) == want


def test_rows_grow_with_items_in_one_large_class(spark):
    df = spark.range(5000).selectExpr("'one' as label", "id * 3 as id")
    got = pairs.class_pairs(df, "label", "id", 3)
    assert got.count() == got.distinct().count() == 15_000
    assert pairs.class_pairs(df.limit(0), "label", "id", 3).count() == 0
