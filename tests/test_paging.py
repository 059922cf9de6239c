"""Pages past the first by distributed rank selection, against slicing a sorted list."""

import random

import pytest

from tallymart.operators.shaping import SortBy, page, ranked


@pytest.mark.parametrize("offset,limit", [(0, 7), (1, 1), (25, 50), (190, 30), (300, 5), (37, None)])
def test_ranked_equals_slicing(spark, offset, limit):
    pick = random.Random(offset)
    rows = [(k, pick.choice([None, 1, 2, 3]), pick.random()) for k in range(200)]
    table = spark.createDataFrame(rows, "product_id long, a int, b double").repartition(7)
    want = sorted(rows, key=lambda r: (-(r[1] if r[1] is not None else -1), r[2], r[0]))
    # Spark puts nulls last in descending order, as the key above does.
    sort = [SortBy("a", descending=True), SortBy("b")]
    end = None if limit is None else offset + limit
    got = [tuple(r) for r in ranked(table, sort, ["product_id"], limit, offset, position="position").collect()]
    assert [r[:3] for r in got] == want[offset:end]
    assert [r[3] for r in got] == list(range(offset, offset + len(got)))
    assert [tuple(r) for r in page(table, sort, ["product_id"], limit, offset).collect()] == want[offset:end]


def test_deep_page_and_empty_table(spark):
    table = spark.range(0, 10_000).withColumnRenamed("id", "product_id").repartition(8)
    got = ranked(table, [], ["product_id"], 10, 5000)
    assert [r["product_id"] for r in got.collect()] == list(range(5000, 5010))
    assert ranked(table.filter("false"), [], ["product_id"], 10, 5).count() == 0


def test_no_single_partition_exchange(spark):
    table = spark.range(0, 1000).withColumnRenamed("id", "product_id").repartition(4)
    got = ranked(table, [], ["product_id"], 10, 100, position="position")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    assert [r["position"] for r in got.collect()] == list(range(100, 110))
