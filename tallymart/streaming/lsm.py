"""A log-structured roll-up table: deltas by (month, batch), tiered runs, a manifest.

Every micro-batch writes its roll-up observations as deltas under
``deltas/month=M/batch=N``; a replayed batch rewrites its own folders with the
same rows. A batch becomes visible only when a new manifest that seals it is
published. Manifests are numbered files written aside and renamed into place,
so a reader sees one whole version or the one before, never half of a batch.

Per month, the manifest lists *runs*: merged observations of a contiguous range
of batches, and ``through``, the last batch a run holds. A reader of a month
reads that month's runs and its deltas newer than ``through`` (and sealed), and
merges them by aggregating again; a replay of a batch a run already holds is
thus never counted twice, and late rows are deltas of their own month like any
other. Compaction is tiered: once ``FANOUT`` deltas of a month wait, they become
one run of level 0; once ``FANOUT`` runs of a level gather, they become one run
of the next level. Reading a day reads one month's folders only.

Nothing is deleted while a manifest may name it: ``vacuum`` removes runs that
the newest manifest does not list and deltas it holds in runs, for use when no
reader still holds an older version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallymart import schemas
from tallymart.sources.files import Store
from tallymart.plans import rollup
from tallymart.streaming import envelopes as env

FANOUT = 4  # deltas or runs of one level merged at once


def _manifest_name(version: int) -> str:
    return f"v-{version:010d}.json"


def manifest(store: Store) -> dict:
    """The newest published manifest, or an empty one."""
    names = [name for name in store.names("manifest") if name.startswith("v-") and name.endswith(".json")]
    if not names:
        return {"version": 0, "sealed": -1, "months": {}}
    return json.loads(store.read_text("manifest", names[-1]))


def _publish(store: Store, state: dict) -> dict:
    state = {**state, "version": state["version"] + 1}
    if not store.publish(json.dumps(state, sort_keys=True), "manifest", _manifest_name(state["version"])):
        raise RuntimeError("another writer published this version of the manifest")
    return state


def _delta_batches(store: Store, month: str) -> list[int]:
    return sorted(int(name.split("=", 1)[1]) for name in store.names("deltas", f"month={month}") if name.startswith("batch="))


def _months(store: Store) -> list[str]:
    return [name.split("=", 1)[1] for name in store.names("deltas") if name.startswith("month=")]


def write_batch(batch: DataFrame, number: int, root: str) -> None:
    """Deltas of one micro-batch of envelopes, sealed by a new manifest, then compaction."""
    spark = batch.sparkSession
    store = Store(spark, root)
    state = manifest(store)
    observed = rollup.observations(env.product_rows(batch))
    if number > state["sealed"]:
        (
            observed.withColumn("month", F.date_format("date", "yyyyMM"))
            .withColumn("batch", F.lit(number))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("month", "batch")
            .parquet(store.path("deltas"))
        )
        state = _publish(store, {**state, "sealed": number})
    # A replayed batch that is sealed already changes nothing.
    compact(spark, root)


def _month_state(state: dict, month: str) -> dict:
    return state["months"].get(month, {"runs": [], "through": -1})


def _merged(spark: SparkSession, paths: Iterable[str], base: str) -> DataFrame:
    return rollup.merge(spark.read.option("basePath", base).parquet(*paths).drop("month", "batch"))


def compact(spark: SparkSession, root: str, fanout: int | None = None) -> dict:
    """Tiered compaction of every month; publishes one manifest if anything changed."""
    fanout = fanout or FANOUT
    store = Store(spark, root)
    state = manifest(store)
    months = dict(state["months"])
    changed = False
    for month in _months(store):
        current = _month_state(state, month)
        runs, through = list(current["runs"]), current["through"]
        waiting = [b for b in _delta_batches(store, month) if through < b <= state["sealed"]]
        if len(waiting) >= fanout:
            name = f"run-0-{uuid.uuid4().hex}"
            paths = [store.path("deltas", f"month={month}", f"batch={b}") for b in waiting]
            _merged(spark, paths, store.path("deltas")).write.parquet(store.path("runs", f"month={month}", name))
            runs.append({"name": name, "level": 0, "lo": waiting[0], "hi": waiting[-1]})
            through, changed = waiting[-1], True
        level = 0
        while True:
            same = [run for run in runs if run["level"] == level]
            if len(same) >= fanout:
                name = f"run-{level + 1}-{uuid.uuid4().hex}"
                paths = [store.path("runs", f"month={month}", run["name"]) for run in same]
                _merged(spark, paths, store.path("runs", f"month={month}")).write.parquet(
                    store.path("runs", f"month={month}", name)
                )
                runs = [run for run in runs if run["level"] != level]
                runs.append({"name": name, "level": level + 1, "lo": min(r["lo"] for r in same), "hi": max(r["hi"] for r in same)})
                changed = True
            elif not any(run["level"] > level for run in runs):
                break
            level += 1
        months[month] = {"runs": sorted(runs, key=lambda run: run["lo"]), "through": through}
    if changed:
        state = _publish(store, {**state, "months": months})
    return state


def read(spark: SparkSession, root: str, months: Iterable[str] | None = None) -> DataFrame:
    """Merged observations of the newest manifest: runs, then newer sealed deltas.

    ``months`` (``yyyyMM``) limits the folders read to those months; by default
    all months with deltas are read. The result has the columns of
    ``rollup.observations``; an empty table gives an empty one.
    """
    store = Store(spark, root)
    state = manifest(store)
    wanted = sorted(set(months)) if months is not None else _months(store)
    runs, deltas = [], []
    for month in wanted:
        current = _month_state(state, month)
        runs += [store.path("runs", f"month={month}", run["name"]) for run in current["runs"]]
        deltas += [
            store.path("deltas", f"month={month}", f"batch={b}")
            for b in _delta_batches(store, month)
            if current["through"] < b <= state["sealed"]
        ]
    parts = []
    if runs:
        parts.append(spark.read.parquet(*runs))
    if deltas:
        parts.append(spark.read.option("basePath", store.path("deltas")).parquet(*deltas).drop("month", "batch"))
    if not parts:
        empty = spark.createDataFrame([], schemas.ENVELOPE)
        return rollup.observations(env.product_rows(empty))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return rollup.merge(merged)


def read_days(spark: SparkSession, root: str, first: str, last: str) -> DataFrame:
    """Merged observations of the days from ``first`` to ``last`` (ISO dates), reading their months only."""
    import datetime as dt

    start, end = dt.date.fromisoformat(first), dt.date.fromisoformat(last)
    months, day = [], start.replace(day=1)
    while day <= end:
        months.append(day.strftime("%Y%m"))
        day = (day.replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    merged = read(spark, root, months)
    return merged.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def vacuum(spark: SparkSession, root: str) -> int:
    """Remove runs the newest manifest does not list and deltas its runs hold; how many folders went."""
    store = Store(spark, root)
    state = manifest(store)
    gone = 0
    for month in _months(store):
        current = _month_state(state, month)
        listed = {run["name"] for run in current["runs"]}
        for name in store.names("runs", f"month={month}"):
            if name.startswith("run-") and name not in listed:
                store.remove("runs", f"month={month}", name)
                gone += 1
        for b in _delta_batches(store, month):
            if b <= current["through"]:
                store.remove("deltas", f"month={month}", f"batch={b}")
                gone += 1
    return gone


def stream_rollup(envelopes: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Feed the table from a stream of envelopes, compacting as batches come."""
    return (
        envelopes.writeStream.foreachBatch(lambda batch, number: write_batch(batch, number, root))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
