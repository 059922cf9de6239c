"""Operators against brute force on generated data."""

import datetime as dt
import random
import statistics

import pytest
from conftest import at
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallymart.functions.arrays import hist_median
from tallymart.operators.abc import abc_classify
from tallymart.operators.running import running_sums
from tallymart.operators.spread import grouped_median
from tallymart.plans import rollup
from tallymart.plans.snapshots import category_period_stats
from tallymart.sources import stores, upserts
from tallymart.streaming import subscriptions

small = st.integers(0, 12)


def four_cases(low, high, before):
    """Orders told apart by where the earlier maximum lies."""
    span = high - low
    if low < before:
        return span - (before - low)
    if before >= high:
        return span + before - high
    if 0 < before < low:
        return span + low - before
    return span


@given(small, small, small)
def test_closed_form_of_orders(a, b, before):
    low, high = min(a, b), max(a, b)
    closed = high - before if before > 0 else high - low
    assert closed == four_cases(low, high, before)


def one_hot(rng, groups, n):
    """Keys of which the first takes more than a third of all rows."""
    return [0 if rng.random() < 0.4 else rng.randrange(groups) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_grouped_median(spark, seed):
    rng = random.Random(seed)
    keys = one_hot(rng, 7, 3000)
    rows = [(k, rng.choice([rng.randrange(10), rng.randrange(10**6), -5]) / 2) for k in keys]
    table = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: r.m for r in grouped_median(table, ["k"], "v", "m").collect()}
    want = {k: statistics.median(v for g, v in rows if g == k) for k in set(keys)}
    assert got == want


def test_grouped_median_ignores_nulls_and_weighs(spark):
    rows = [(1, 5.0, 3), (1, 9.0, 1), (1, None, 9), (2, None, 1), (3, 1.0, 1), (3, 2.0, 1)]
    table = spark.createDataFrame(rows, "k int, v double, w int")
    got = {r.k: r.m for r in grouped_median(table, ["k"], "v", "m", F.col("w")).collect()}
    assert got == {1: 5.0, 3: 1.5}


def test_hist_median(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        rows.append((i, [(rng.randrange(6), rng.randrange(1, 4)) for _ in range(rng.randrange(1, 6))]))
    table = spark.createDataFrame(rows, "i int, h array<struct<price: bigint, cnt: bigint>>")
    got = {r.i: r.m for r in table.select("i", hist_median(F.col("h")).alias("m")).collect()}
    for i, hist in rows:
        assert got[i] == statistics.median([p for p, n in hist for _ in range(n)])


def test_abc_against_every_other_row(spark):
    rng = random.Random(4)
    keys = one_hot(rng, 5, 800)
    rows = [(k, i, rng.choice([0, 1, rng.randrange(1000)])) for i, k in enumerate(keys)]
    table = spark.createDataFrame(rows, "k int, i int, v bigint")
    got = {r.i: r.c for r in abc_classify(table, ["k"], {"v": "c"}).collect()}
    for k, i, v in rows:
        group = [w for g, _, w in rows if g == k]
        share = (sum(w for w in group if w > v) + v) * 100
        total = sum(group)
        want = "A" if share < 81 * total else "B" if share < 96 * total else "C"
        assert got[i] == (want if total else None)


def test_running_sums(spark):
    rng = random.Random(5)
    rows = [(k, i, rng.randrange(9)) for i, k in enumerate(one_hot(rng, 4, 600))]
    table = spark.createDataFrame(rows, "k int, i int, v int")
    bucket = F.floor(F.col("i") / 50)
    got = {r.i: r.v_upto for r in running_sums(table, ["k"], bucket, ["i"], ["v"]).collect()}
    for k, i, _ in rows:
        assert got[i] == sum(v for g, j, v in rows if g == k and j <= i)


def random_snapshots(seed, n=300):
    rng = random.Random(seed)
    return [
        {
            "timestamp": at(rng.randrange(1, 6), rng.randrange(24), rng.randrange(60)),
            "product_id": (p := one_hot(rng, 4, 1)[0]),
            "sku_id": p * 10 + rng.randrange(2),
            "title": rng.choice("AB"),
            "photo_key": rng.choice(["x", "y", None]),
            "total_orders_amount": rng.randrange(50),
            "available_amount": rng.randrange(50),
            "full_price": rng.choice([None, 100, 200]),
            "purchase_price": rng.randrange(90, 95),
            "latest_category_id": rng.choice([3, 4]),
        }
        for _ in range(n)
    ]


def by_row(table):
    return sorted(map(str, table.select(*sorted(table.columns)).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_partials_of_any_split_merge_to_the_whole(snapshots, seed):
    rows = random_snapshots(seed)
    rng = random.Random(seed)
    whole = rollup.daily_sales(rollup.sku_days(rollup.observations(snapshots(rows))))
    rng.shuffle(rows)
    cut = rng.randrange(len(rows))
    parts = [rollup.observations(snapshots(part)) for part in (rows[:cut], rows[cut:])]
    merged = rollup.merge(parts[0].unionByName(parts[1]))
    assert by_row(rollup.daily_sales(rollup.sku_days(merged))) == by_row(whole)


def test_period_stats_boundaries(market):
    """A row at midnight belongs to both halves; today only counts at midnight."""
    rows = [
        {"timestamp": at(10), "total_orders_amount": 10},
        {"timestamp": dt.datetime(2024, 1, 17), "total_orders_amount": 14},
        {"timestamp": at(20), "total_orders_amount": 20},
        {"timestamp": dt.datetime(2024, 1, 24), "total_orders_amount": 25},
        {"timestamp": at(24, 13), "total_orders_amount": 99},
    ]
    stats = category_period_stats(market(rows), dt.date(2024, 1, 24), [7]).collect()
    assert [(r.category_id, r.order_amount, r.prev_order_amount) for r in stats] == [(4, 11, 4)]
    assert (stats[0].seller_count, stats[0].prev_product_count) == (1, 1)


def test_snapshot_written_twice_stays_one(spark, market, tmp_path):
    rows = [{"timestamp": at(d), "total_orders_amount": d} for d in range(1, 25)]
    stats = category_period_stats(market(rows), dt.date(2024, 1, 24), [7])
    other = stats.withColumn("snapshot_date", F.lit(dt.date(2024, 1, 20)))
    path = str(tmp_path / "stats")
    for table in (other, stats, stats):
        stores.write_snapshot(table, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 2
    newest = stores.latest(stored).collect()
    assert [r.snapshot_date for r in newest] == [dt.date(2024, 1, 24)]


def test_upserts(spark):
    old = spark.createDataFrame([(1, 0, "a"), (2, 1, "b")], "category_id int, parent_category_id int, title string")
    new = spark.createDataFrame(
        [(2, 1, "b2", 2), (2, 1, "b1", 1), (3, 1, "c", 1)],
        "category_id int, parent_category_id int, title string, v int",
    )
    got = upserts.upsert(old, new, ["category_id"], "v").orderBy("category_id").collect()
    assert [r.title for r in got] == ["a", "b2", "c"]
    again = upserts.upsert(
        spark.createDataFrame(got), new, ["category_id"], "v"
    ).orderBy("category_id").collect()
    assert again == got


def test_retention_keeps_what_is_younger(spark):
    rows = spark.createDataFrame([(at(15),), (at(15, 0, 0),), (at(16),)], "timestamp timestamp_ntz")
    assert stores.retain(rows, stores.KEEP_POSITIONS, dt.date(2024, 2, 15)).count() == 2


def payment_log(seed, users=4, payments=60):
    rng = random.Random(seed)
    start = dt.datetime(2020, 1, 1)
    events = []
    for p in range(payments):
        moment = start + dt.timedelta(days=rng.randrange(400), seconds=p)
        status = rng.choice(["success", "pending", "failed"])
        user = one_hot(rng, users, 1)[0]
        events.append((p, user, "created", moment, status, rng.randrange(1, 4), rng.randrange(4)))
        for step in range(rng.randrange(4)):
            later = moment + dt.timedelta(days=step + 1)
            status = rng.choice(["success", "pending", "failed", "canceled", "unknown"])
            events.append((p, None, "status", later, status, None, None))
    events.append((999, None, "status", start, "success", None, None))
    return events


def simulate(events):
    known, users = {}, {}
    for p, user, kind, moment, status, plan, multiply in sorted(
        events, key=lambda e: (e[3], e[0])
    ):
        if kind == "created":
            known[p] = [status, user, plan, multiply]
            won = status == "success"
        elif status == "unknown" or p not in known:
            continue
        else:
            won = status == "success" and known[p][0] != "success"
            known[p][0] = status
        if won:
            _, user, plan, multiply = known[p]
            days = 30 * multiply if multiply > 1 else 30
            end = users.get(user, (None, dt.datetime.min))[1]
            users[user] = (plan, max(end, moment) + dt.timedelta(days=days))
    names = subscriptions.PLAN_NAMES
    return {u: (names[plan], end) for u, (plan, end) in users.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_subscriptions_follow_each_other(spark, seed):
    events = payment_log(seed)
    table = spark.createDataFrame(events, subscriptions.EVENT)
    got = {
        r.user_id: (r.subscription_type, r.subscription_end_at)
        for r in subscriptions.subscription_state(table).collect()
    }
    assert got == simulate(events)
    assert [r.payment_id for r in subscriptions.orphans(table).collect()] == [999]


def test_states_of_batches_merge(spark):
    granted = subscriptions.grants(spark.createDataFrame(payment_log(7), subscriptions.EVENT))
    whole = subscriptions.subscriptions(subscriptions.user_states(granted))
    cuts = [dt.datetime(2020, 1, 1), dt.datetime(2020, 4, 1), dt.datetime(2020, 7, 1), dt.datetime(2022, 1, 1)]
    states = None
    for number, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = granted.where((F.col("at") >= F.lit(low)) & (F.col("at") < F.lit(high)))
        state = subscriptions.user_states(part).withColumn("batch_id", F.lit(number))
        states = state if states is None else states.unionByName(state)
    merged = subscriptions.subscriptions(subscriptions.merge_states(states))
    assert by_row(merged) == by_row(whole)
