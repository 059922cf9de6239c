"""Retention by dropping and rewriting month partitions."""

import datetime as dt

from tallymart.sources import stores
from tallymart.sources.files import Store


def test_purge_drops_whole_months_and_rewrites_the_border(spark, tmp_path):
    rows = [(k, dt.datetime(2024, month, day, 12)) for k, (month, day) in enumerate([(1, 5), (1, 28), (2, 3), (2, 20), (3, 1), (3, 30)] * 5)]
    frame = spark.createDataFrame(rows, "id long, timestamp timestamp_ntz")
    path = str(tmp_path / "table")
    stores.append_series(frame.repartition(3), path, ["id"])
    store = Store(spark, path)
    before = {name: len(store.files(name)) for name in store.names() if name.startswith("month=")}
    as_of = dt.date(2024, 3, 10)
    done = stores.purge(spark, path, "1 month", as_of)
    after = {name: len(store.files(name)) for name in store.names() if name.startswith("month=")}
    assert done["dropped"] == 1 and "month=202401" not in after  # January is past whole
    assert done["rewritten"] == 1 and after["month=202403"] == before["month=202403"]  # March untouched
    want = sorted(r for r in rows if r[1] + dt.timedelta(days=29) > dt.datetime(2024, 3, 10))
    got = sorted(tuple(r) for r in spark.read.parquet(path).select("id", "timestamp").collect())
    assert got == sorted(stores.retain(frame, "1 month", as_of).collect()) == want
    assert not [name for name in store.names() if name.startswith(".")]  # nothing left aside
    assert stores.purge(spark, path, "1 month", as_of)["files"] == after["month=202402"]  # again: same rows
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("id", "timestamp").collect()) == want


def test_spans():
    assert stores._later(dt.date(2024, 1, 31), "1 month") == dt.date(2024, 2, 29)
    assert stores._later(dt.date(2024, 11, 15), "4 months") == dt.date(2025, 3, 15)
    assert stores._later(dt.date(2024, 2, 27), "3 days") == dt.date(2024, 3, 1)


def test_snapshot_runs_are_seen_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    rows = [(7, dt.date(2024, 1, 31), 1, 10), (14, dt.date(2024, 1, 31), 2, 20)]
    table = spark.createDataFrame(rows, "period int, snapshot_date date, root_id long, value long")
    first = stores.publish_snapshot(table, path, "stats-2024-01-31")
    stores.publish_snapshot(table, path, "stats-2024-01-31")  # a rerun replaces the first as a whole
    table.write.partitionBy("period", "snapshot_date", "root_id").parquet(Store(spark, path).path("runs", "run-killed"))
    got = sorted(tuple(r) for r in stores.read_snapshots(spark, path).select(*table.columns).collect())
    assert got == sorted(rows)
    assert stores.vacuum_snapshots(spark, path) == 2  # the first run and the killed one
    assert first not in Store(spark, path).names("runs")
    assert sorted(tuple(r) for r in stores.read_snapshots(spark, path).select(*table.columns).collect()) == sorted(rows)


def test_appends_are_clustered_by_the_first_key(spark, tmp_path):
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # Product 0 holds a third of the rows.
        rows = spark.range(60_000).select(
            F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 500).alias("product_id"),
            (F.col("id") % 7).alias("sku_id"),
            (F.lit(dt.datetime(2024, 1, 1)) + F.make_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("id") % 55).cast("int"))).cast("timestamp_ntz").alias("timestamp"),
        ).repartition(8)
        path = tmp_path / "series"
        stores.append_series(rows, str(path), ["product_id", "sku_id", "timestamp"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(path.glob("month=*/*.parquet"))
    ranges = []
    for file in files:
        meta = pq.ParquetFile(file).metadata
        column = meta.schema.names.index("product_id")
        for group in range(meta.num_row_groups):
            stats = meta.row_group(group).column(column).statistics
            ranges.append((stats.min, stats.max))
    touching = lambda product: sum(low <= product <= high for low, high in ranges)
    assert len(files) >= 16
    assert touching(250) <= 2 * len(list(path.glob("month=*")))  # one product: one range per month, or two
    assert touching(0) > 2  # the hot product is spread over several files
    assert spark.read.parquet(str(path)).count() == 60_000
