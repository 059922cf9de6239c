"""Streams give what batch gives, also after restarts and repeated batches."""

import datetime as dt
import json
import random

import pytest
from conftest import at
from pyspark.sql import functions as F

from tallymart import schemas
from tallymart.operators.hierarchy import closure
from tallymart.plans import rollup
from tallymart.sources import upserts
from tallymart.sources.stores import latest
from tallymart.streaming import envelopes as env
from tallymart.streaming import key_sharing, subscriptions, tables
from test_properties import by_row, payment_log, random_snapshots, simulate

PRODUCT = {
    "product_id": 5,
    "title": "Hat",
    "orders": 7,
    "total_available_amount": 9,
    "reviews_amount": 2,
    "rating": 4.5,
    "is_eco": True,
    "is_adult": False,
    "attributes": ["a"],
    "tags": [],
    "category": {
        "id": 4,
        "title": "leaf",
        "parent": {"id": 2, "title": "mid", "parent": {"id": 1, "title": "top"}},
    },
    "seller": {
        "id": 3,
        "account_id": 30,
        "seller_link": "s",
        "seller_title": "S",
        "reviews": 1,
        "orders": 2,
        "rating": 5,
        "registration_seconds": 86400,
        "contacts": [{"type": "mail", "value": "x"}, {"type": "mail", "value": "y"}],
    },
    "skus": [
        {
            "sku_id": 50,
            "purchase_price": "12.50",
            "full_price": "",
            "available_amount": 3,
            "photo_key": "",
            "characteristics": [
                {"type": "color", "title": "red"},
                {"type": "color", "title": "blue"},
            ],
        },
        {
            "sku_id": 51,
            "purchase_price": "9.99",
            "full_price": "20",
            "available_amount": 6,
            "photo_key": "k",
            "characteristics": [],
            "restricted_amount": 2,
        },
    ],
}
DEEP = {"category_id": 1, "title": "l1", "children": []}
for n in range(2, 13):
    DEEP = {"category_id": n, "title": f"l{n}", "children": [DEEP]}


def envelopes(spark, *events):
    rows = [
        (str(i), at(1, i % 24), kind, body if isinstance(body, str) else json.dumps(body))
        for i, (kind, body) in enumerate(events)
    ]
    return spark.createDataFrame(rows, schemas.ENVELOPE)


def test_product_event_to_rows(spark):
    first, second = env.product_rows(envelopes(spark, ("product", PRODUCT))).orderBy("sku_id").collect()
    assert (first.purchase_price, first.full_price, first.photo_key) == (1250, None, None)
    assert (second.purchase_price, second.full_price, second.photo_key) == (999, 2000, "k")
    assert (first.characteristics, second.characteristics) == ({"color": "blue"}, {})
    assert (first.restriction, second.restriction) == (0, 2)
    assert first.seller_registration_date == dt.datetime(1970, 1, 2)
    assert first.seller_contacts == {"mail": "y"}
    assert first.latest_category_id == 4
    assert set(first.asDict()) == {f.name for f in spark.createDataFrame([], schemas.PRODUCT_SNAPSHOT).schema}


def test_routing(spark):
    events = envelopes(
        spark,
        ("product", PRODUCT),
        ("product", '{"product_id":'),
        ("product", {"title": "no id"}),
        ("position", {"product_id": 1, "sku_id": 2, "category_id": 3, "position": 4}),
        ("category", DEEP),
        ("weather", {}),
    )
    got = [r.target for r in env.routed(events).orderBy("event_id").collect()]
    assert got == ["product", "quarantine", "quarantine", "position", "category"]
    assert env.position_rows(events).count() == 1


def test_trees_of_any_depth(spark):
    edges = env.category_rows(envelopes(spark, ("category", DEEP))).collect()
    assert {(r.category_id, r.parent_category_id) for r in edges} == {
        (n, n + 1 if n < 12 else 0) for n in range(1, 13)
    }


def deliver(folder, number, rows):
    path = folder / "in"
    path.mkdir(exist_ok=True)
    (path / f"part{number}.json").write_text("\n".join(json.dumps(r) for r in rows))
    return str(path)


def product_event(row, number):
    return {
        "event_id": str(number),
        "scrap_time": row["timestamp"].isoformat(),
        "kind": "product",
        "payload": json.dumps(
            {
                "product_id": row["product_id"],
                "title": row["title"],
                "orders": row["total_orders_amount"],
                "reviews_amount": 0,
                "category": {"id": row["latest_category_id"]},
                "seller": {"id": 7, "account_id": 70, "seller_link": "shop", "seller_title": "Shop"},
                "skus": [
                    {
                        "sku_id": row["sku_id"],
                        "purchase_price": str(row["purchase_price"] / 100),
                        "full_price": "" if row["full_price"] is None else str(row["full_price"] / 100),
                        "available_amount": row["available_amount"],
                        "photo_key": row["photo_key"] or "",
                    }
                ],
            }
        ),
    }


def test_rollup_stream_equals_batch_and_survives_replay(spark, snapshots, tmp_path):
    rows = random_snapshots(11)
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "check")
    events = [product_event(row, i) for i, row in enumerate(rows)]
    for number, part in enumerate((events[:100], events[100:])):
        stream = env.read_stream(spark, deliver(tmp_path, number, part))
        tables.stream_rollup(stream, target, checkpoint).awaitTermination()
    partials = tables.partials(spark, target)
    want = by_row(rollup.daily_sales(rollup.sku_days(rollup.observations(snapshots(rows)))))
    columns = [c for c in partials.columns if c != "batch_id"]
    assert by_row(rollup.daily_sales(rollup.sku_days(rollup.merge(partials)))) == want
    again = spark.read.parquet(target).where("batch_id = 1").select(*columns)
    kept = spark.createDataFrame(again.collect(), again.schema)
    tables.replace_batch(kept, 1, target)
    assert by_row(rollup.daily_sales(rollup.sku_days(rollup.merge(tables.partials(spark, target))))) == want
    compacted = str(tmp_path / "compacted")
    tables.compact(spark, target, compacted)
    assert by_row(rollup.daily_sales(rollup.sku_days(spark.read.parquet(compacted)))) == want


def test_categories_and_sellers_keep_the_newest_version(spark, tmp_path):
    checkpoint, target = str(tmp_path / "check"), str(tmp_path / "out")
    for number, title in enumerate(("old", "new")):
        tree = {"category_id": 1, "title": title, "children": [{"category_id": 2, "title": title}]}
        event = {
            "event_id": "1",
            "scrap_time": f"2024-01-0{number + 1}T00:00:00",
            "kind": "category",
            "payload": json.dumps(tree),
        }
        stream = env.read_stream(spark, deliver(tmp_path, number, [event]))
        tables.stream_categories(stream, target, checkpoint).awaitTermination()
    got = tables.current_versions(spark, target, upserts.CATEGORY_KEY, "version")
    assert {(r.category_id, r.parent_category_id, r.title) for r in got.collect()} == {
        (1, 0, "new"),
        (2, 1, "new"),
    }


def drained(spark, parts, schema, start, tmp_path):
    source, target, checkpoint = (str(tmp_path / n) for n in ("src", "out", "check"))
    for part in parts:
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        start(stream, target, checkpoint).awaitTermination()
    return spark.read.parquet(target)


def test_payment_stream(spark, tmp_path):
    events = payment_log(5)
    table = spark.createDataFrame(events, subscriptions.EVENT)
    middle = F.lit(dt.datetime(2020, 6, 1))
    parts = [table.where(F.col("at") < middle), table.where(F.col("at") >= middle)]
    grants = str(tmp_path / "grants")

    def start(stream, path, checkpoint):
        return subscriptions.stream_payments(stream, path, grants, checkpoint)

    states = drained(spark, parts, subscriptions.EVENT, start, tmp_path)
    assert states.select("batch_id").distinct().count() == 2
    granted = spark.read.parquet(grants).drop("batch_id")
    assert by_row(granted) == by_row(subscriptions.grants(table))
    got = subscriptions.subscriptions(subscriptions.user_states(granted)).collect()
    assert {r.user_id: (r.subscription_type, r.subscription_end_at) for r in got} == simulate(events)


def brute_alarms(visits):
    alarms, state = set(), {}
    for ts, key, ip, browser in sorted(visits):
        held = state.get(key)
        if held and ts > held["renewed"] + dt.timedelta(hours=2):
            held = None
        if held is None:
            held = state[key] = {"started": ts, "places": [], "flagged": False}
        if (ip, browser) in held["places"]:
            continue
        held["places"].append((ip, browser))
        held["renewed"] = ts
        ips = {p[0] for p in held["places"]}
        browsers = {p[1] for p in held["places"]}
        crowded = any(sum(p[0] == i for p in held["places"]) > 3 for i in ips)
        many = len(held["places"]) > 2
        if many and ((len(ips) > 4 and len(browsers) > 2) or crowded) and not held["flagged"]:
            held["flagged"] = True
            alarms.add((key, held["started"], ts, len(held["places"]), len(ips), len(browsers)))
    return alarms


def test_key_sharing_stream(spark, tmp_path):
    rng = random.Random(6)
    visits = sorted(
        {
            (
                at(1 + rng.randrange(3), rng.randrange(24), rng.randrange(60)),
                0 if rng.random() < 0.4 else rng.randrange(4),
                f"ip{rng.randrange(6)}",
                rng.choice(["f", "c", "s", "o"]),
            )
            for _ in range(700)
        }
    )
    schema = "ts timestamp_ntz, api_key bigint, ip string, browser string"
    parts = [spark.createDataFrame(part, schema) for part in (visits[:300], visits[300:])]

    def start(stream, path, checkpoint):
        return tables.append_rows(key_sharing.stream_alarms(stream), path, checkpoint)

    got = {tuple(r) for r in drained(spark, parts, schema, start, tmp_path).collect()}
    want = brute_alarms(visits)
    assert want and got == want
    doubled = parts[0].union(parts[0])
    assert key_sharing.once_per_second(doubled).count() == 300


def test_faulty_products_go_to_quarantine(spark):
    good = '{"product_id": 1, "skus": [{"sku_id": 2, "purchase_price": "1.50", "full_price": ""}]}'
    payloads = {
        "good": good,
        "price": good.replace("1.50", "abc"),
        "shape": '{"product_id": 1, "skus": "none"}',
        "missing": '{"product_id": 1}',
        "id": '{"product_id": ',
    }
    rows = [(name, dt.datetime(2024, 1, 1), "product", text) for name, text in payloads.items()]
    frame = spark.createDataFrame(rows, schemas.ENVELOPE)
    reasons = {row["event_id"]: row["reason"] for row in env.routed(frame).collect()}
    assert reasons == {
        "good": None, "price": "bad_price", "shape": "bad_shape", "missing": "bad_shape", "id": "no_id",
    }
    assert [row["purchase_price"] for row in env.product_rows(frame).collect()] == [150]


def test_late_creation_brings_its_grant(spark, tmp_path):
    events = [
        (1, None, "status", dt.datetime(2024, 1, 2), "success", None, None),
        (1, 9, "created", dt.datetime(2024, 1, 1), "pending", 1, 1),
    ]
    grants = str(tmp_path / "grants")

    def start(stream, path, checkpoint):
        return subscriptions.stream_payments(stream, path, grants, checkpoint)

    parts = [spark.createDataFrame([event], subscriptions.EVENT) for event in events]
    drained(spark, parts, subscriptions.EVENT, start, tmp_path)
    rows = spark.read.parquet(grants).collect()
    assert [(row["user_id"], row["days"]) for row in rows] == [(9, 30)]


def test_cycle_in_the_tree_is_refused(spark):
    edges = spark.createDataFrame([(1, 2, "a"), (2, 1, "b"), (3, 0, "c")], schemas.CATEGORY_EDGE)
    with pytest.raises(ValueError, match="cycle"):
        closure(edges)


def test_latest_of_each_period(spark):
    rows = [(7, dt.date(2024, 1, 31), 1), (14, dt.date(2024, 1, 30), 2), (14, dt.date(2024, 1, 29), 3)]
    table = spark.createDataFrame(rows, "period int, snapshot_date date, value int")
    assert {row["value"] for row in latest(table).collect()} == {1, 2}
