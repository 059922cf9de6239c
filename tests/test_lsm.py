"""The log-structured roll-up table: sealed batches, tiered runs, replay, late rows."""

import json

from test_properties import by_row, random_snapshots
from test_streams import deliver, product_event

from tallymart.plans import rollup
from tallymart.streaming import envelopes as env
from tallymart.streaming import lsm


def feed(spark, tmp_path, parts, root, checkpoint):
    for number, part in enumerate(parts):
        stream = env.read_stream(spark, deliver(tmp_path, number, part))
        lsm.stream_rollup(stream, root, checkpoint).awaitTermination()


def test_tiers_replay_late_rows_and_vacuum(spark, snapshots, tmp_path, monkeypatch):
    monkeypatch.setattr(lsm, "FANOUT", 2)
    rows = random_snapshots(21, 240)
    for row in rows[200:]:
        row["timestamp"] = row["timestamp"].replace(year=2023, month=12)  # late rows of an earlier month
    events = [product_event(row, i) for i, row in enumerate(rows)]
    parts = [events[at : at + 30] for at in range(0, 240, 30)]
    root, checkpoint = str(tmp_path / "table"), str(tmp_path / "check")
    feed(spark, tmp_path, parts, root, checkpoint)

    want = by_row(rollup.daily_sales(rollup.sku_days(rollup.observations(snapshots(rows)))))
    assert by_row(rollup.daily_sales(rollup.sku_days(lsm.read(spark, root)))) == want
    store = lsm.Store(spark, root)
    state = lsm.manifest(store)
    assert state["sealed"] == len(parts) - 1
    january = state["months"]["202401"]
    assert max(run["level"] for run in january["runs"]) >= 1 and january["through"] >= 3
    assert len(store.names("manifest")) == state["version"]

    # A replay of a batch that a run holds changes nothing.
    again = env.read_stream(spark, deliver(tmp_path, 1, parts[1]))
    replay = spark.read.schema(again.schema).json(str(tmp_path / "in" / "part1.json"))
    lsm.write_batch(replay, 1, root)
    assert by_row(rollup.daily_sales(rollup.sku_days(lsm.read(spark, root)))) == want

    # One day reads one month's folders.
    day = lsm.read_days(spark, root, "2024-01-02", "2024-01-02")
    assert day.inputFiles() and all("month=202401" in path for path in day.inputFiles())
    assert by_row(day) == by_row(lsm.read(spark, root).where("date = DATE'2024-01-02'"))

    assert lsm.vacuum(spark, root) > 0
    assert by_row(rollup.daily_sales(rollup.sku_days(lsm.read(spark, root)))) == want


def test_unsealed_deltas_stay_unseen(spark, tmp_path):
    root = str(tmp_path / "table")
    store = lsm.Store(spark, root)
    assert lsm.read(spark, root).count() == 0
    lsm._publish(store, {"version": 0, "sealed": -1, "months": {}})
    assert not store.publish("{}", "manifest", lsm._manifest_name(1))  # a version is never replaced
    assert json.loads(store.read_text("manifest", lsm._manifest_name(1)))["sealed"] == -1
