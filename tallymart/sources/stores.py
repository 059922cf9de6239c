"""Month-partitioned time series, staged tables, retention and latest snapshots."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymart.session import fresh_folder
from tallymart.sources.files import Store

# How long rows of each table are kept.
KEEP_RAW = "4 months"
KEEP_POSITIONS = "1 month"
KEEP_SNAPSHOTS = "3 days"


def append_series(rows: DataFrame, path: str, sort: list[str], time: str = "timestamp"):
    """Append to a table partitioned by month and range-clustered by ``sort``.

    Rows are range-partitioned by (month, *sort) before they are written, so
    each file holds a narrow range of the first key and its row groups' minima
    and maxima exclude the rest; a single product or category reads few row
    groups. The range includes the later keys, so a key that holds much of a
    month is split over several files and tasks. The first key also gets a
    Parquet bloom filter, which answers equality lookups inside a file's range.
    """
    month = F.date_format(time, "yyyyMM").cast("int")
    (
        rows.withColumn("month", month)
        .repartitionByRange("month", *sort)
        .sortWithinPartitions("month", *sort)
        .write.mode("append")
        .option(f"parquet.bloom.filter.enabled#{sort[0]}", "true")
        .partitionBy("month")
        .parquet(path)
    )


def between(
    table: DataFrame,
    start: dt.date | None,
    end: dt.date | None,
    time: str = "timestamp",
) -> DataFrame:
    """Rows of whole days ``start`` to ``end``, pruning months where stored.

    ``time`` may be a timestamp or a date; both compare with the bounds as they
    are, so the scan can skip row groups.
    """
    kind = table.schema[time].dataType
    months = "month" in table.columns
    if start is not None:
        table = table.where(F.col(time) >= F.lit(start).cast(kind))
        if months:
            table = table.where(F.col("month") >= start.year * 100 + start.month)
    if end is not None:
        after = end + dt.timedelta(days=1)
        table = table.where(F.col(time) < F.lit(after).cast(kind))
        if months:
            table = table.where(F.col("month") <= end.year * 100 + end.month)
    return table


def stage(table: DataFrame, name: str) -> DataFrame:
    """Write a table several branches read into the shared folder; read it back."""
    spark = table.sparkSession
    path = fresh_folder(spark, name)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def retain(table: DataFrame, keep: str, as_of: dt.date, time: str = "timestamp"):
    """Drop rows whose time plus ``keep`` is not after ``as_of``.

    Months differ by up to three days, so a plain bound a little earlier comes
    first: the scan can skip by it, and the exact rule decides the rest.
    """
    now, span = F.lit(as_of).cast("timestamp_ntz"), F.expr(f"INTERVAL {keep}")
    surely_over = now - span - F.expr("INTERVAL 4 DAYS")
    return table.where(F.col(time) > surely_over).where(F.col(time) + span > now)


def _later(day: dt.date, keep: str) -> dt.date:
    """``day`` plus a span of whole days or months (``"3 days"``, ``"4 months"``)."""
    count, unit = keep.split()
    count = int(count)
    if unit.startswith("day"):
        return day + dt.timedelta(days=count)
    if unit.startswith("month"):
        month = day.month - 1 + count
        year, month = day.year + month // 12, month % 12 + 1
        last = (dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(days=1)).day
        return dt.date(year, month, min(day.day, last))
    raise ValueError(f"a span of days or months is needed, not {keep!r}")


def purge(spark: SparkSession, path: str, keep: str, as_of: dt.date, time: str = "timestamp") -> dict[str, int]:
    """Apply retention to a month-partitioned table in place, by partition.

    Months whose every row is past ``keep`` are dropped whole: the folder is
    first renamed to a hidden name, which readers skip, then deleted. Months
    with every row still kept are not touched. Only a month on the border is
    rewritten, file by file: the rows a file keeps are written aside, renamed
    into the month, and only then is the old file removed, so a reader between
    the two renames may see a file's kept rows twice but never miss one. Files
    that appends add meanwhile are not listed and so stay as they are. Returns
    the number of months dropped and rewritten and of files rewritten.
    """
    store = Store(spark, path)
    done = {"dropped": 0, "rewritten": 0, "files": 0}
    for name in store.names():
        if not name.startswith("month="):
            continue
        month = int(name.split("=", 1)[1])
        first = dt.date(month // 100, month % 100, 1)
        after = _later(first, "1 month")
        if _later(after, keep) <= as_of:
            hidden = store.path(f".{name}.purged-{uuid.uuid4().hex}")
            if store.rename(store.path(name), hidden):
                store.fs.delete(store.Path(hidden), True)
                done["dropped"] += 1
            continue
        if _later(first, keep) > as_of:
            continue
        done["rewritten"] += 1
        for file in store.files(name):
            rows = spark.read.option("basePath", path).parquet(store.path(name, file))
            aside = store.path(f".rewrite-{uuid.uuid4().hex}")
            retain(rows, keep, as_of, time).drop("month").write.parquet(aside)
            for part in Store(spark, aside).files():
                store.rename(f"{aside}/{part}", store.path(name, f"{uuid.uuid4().hex}-{part}"))
            store.remove(name, file)
            store.fs.delete(store.Path(aside), True)
            done["files"] += 1
    return done


def latest(
    table: DataFrame, date: str = "snapshot_date", period: str = "period"
) -> DataFrame:
    """Rows of the newest snapshot of every period; other partitions are not read.

    Periods are snapshot on their own, so each has a newest day of its own. They
    are a handful, which bounds what is broadcast. Without a period column the
    whole table has one newest day.
    """
    if period not in table.columns:
        return table.where(F.col(date) == table.agg(F.max(date)).scalar())
    newest = table.groupBy(period).agg(F.max(date).alias(date))
    return table.join(F.broadcast(newest), [period, date], "left_semi")


def write_snapshot(table: DataFrame, path: str) -> None:
    """Replace exactly the (period, snapshot_date, root_id) partitions in ``table``.

    Running a snapshot again therefore leaves one copy of it. Rows of a partition
    are brought together first, and large partitions split again by adaptive
    execution, so their files are few and of a fair size.
    """
    keys = ("period", "snapshot_date", "root_id")
    (
        table.hint("rebalance", *keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*keys)
        .parquet(path)
    )


def publish_snapshot(table: DataFrame, path: str, run: str) -> str:
    """Write a snapshot run whole, then make it visible by one ledger entry.

    The rows go to a folder of their own under ``runs/``; only after all of its
    files are there is ``ledger/<run>/v-N.json`` published by rename, naming
    that folder. Readers (``read_snapshots``) see, per run key, the newest
    entry's folder alone, so a run killed before its entry is never visible, and
    a rerun of the same key replaces the earlier one as a whole. Returns the
    folder written.
    """
    import json

    spark = table.sparkSession
    store = Store(spark, path)
    folder = f"run-{uuid.uuid4().hex}"
    (
        table.hint("rebalance", "period", "snapshot_date", "root_id")
        .write.partitionBy("period", "snapshot_date", "root_id")
        .parquet(store.path("runs", folder))
    )
    versions = [int(name[2:-5]) for name in store.names("ledger", run) if name.startswith("v-") and name.endswith(".json")]
    version = max(versions, default=0) + 1
    if not store.publish(json.dumps({"run": run, "folder": folder}), "ledger", run, f"v-{version:010d}.json"):
        raise RuntimeError(f"another writer published run {run} at the same time")
    return folder


def read_snapshots(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The newest published folder of every run key, read together."""
    import json

    store = Store(spark, path)
    folders = []
    for run in store.names("ledger"):
        entries = sorted(name for name in store.names("ledger", run) if name.startswith("v-") and name.endswith(".json"))
        if entries:
            folders.append(store.path("runs", json.loads(store.read_text("ledger", run, entries[-1]))["folder"]))
    reader = spark.read if schema is None else spark.read.schema(schema)
    if not folders:
        return spark.createDataFrame([], schema) if schema is not None else None
    table = reader.option("basePath", folders[0]).parquet(folders[0])
    for folder in folders[1:]:
        table = table.unionByName(reader.option("basePath", folder).parquet(folder))
    return table


def vacuum_snapshots(spark: SparkSession, path: str) -> int:
    """Remove run folders that no newest ledger entry names; how many went."""
    import json

    store = Store(spark, path)
    named = set()
    for run in store.names("ledger"):
        entries = sorted(name for name in store.names("ledger", run) if name.startswith("v-") and name.endswith(".json"))
        if entries:
            named.add(json.loads(store.read_text("ledger", run, entries[-1]))["folder"])
    gone = 0
    for folder in store.names("runs"):
        if folder.startswith("run-") and folder not in named:
            store.remove("runs", folder)
            gone += 1
    return gone
