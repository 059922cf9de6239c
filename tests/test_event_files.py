"""Event files are compressed and bounded in rows, and give back the rows written."""

import gzip
import pathlib

from conftest import at
from pyspark.sql import functions as F

from tallymart import schemas
from tallymart.catalog import streams
from tallymart.sources import sample
from tallymart.streaming import tables


def test_delivered_events_are_compressed(spark, monkeypatch):
    made = []
    fresh = streams.fresh_folder
    monkeypatch.setattr(streams, "fresh_folder", lambda s, name: made.append(fresh(s, name)) or made[-1])
    monkeypatch.setitem(sample.PACKED, "maxRecordsPerFile", 40)
    rows = [(f"e{n}", at(1 + n % 20, n % 24), "position", '{"product_id": %d}' % n) for n in range(100)]
    events = spark.createDataFrame(rows, "event_id string, scrap_time timestamp_ntz, kind string, payload string").coalesce(1)
    known = events.select(*spark.createDataFrame([], schemas.ENVELOPE).columns)
    path = streams.run(
        spark, streams.deliveries(known, "scrap_time", "2024-01-10"), "json", schemas.ENVELOPE,
        lambda stream, target, checkpoint: tables.append_rows(stream, target, checkpoint),
    )
    got = spark.read.parquet(path).select("event_id", "scrap_time", "kind", "payload")
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    files = [f for f in pathlib.Path(made[0]).iterdir() if f.name.startswith("part-")]
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert max(len(gzip.decompress(f.read_bytes()).splitlines()) for f in files) <= 40
    assert got.agg(F.count(F.lit(1))).first()[0] == 100
