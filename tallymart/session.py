"""Session settings and the folder shared by all executors."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Histograms are gathered for far more groups than fit a hash table of
    # objects; sorting at once, which spills, spares the attempt.
    "spark.sql.execution.useObjectHashAggregateExec": "false",
}


#: Rows of a batch of whole texts that goes to a Python task at once.
BATCH_ROWS = 1000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def build_session(
    app: str = "tallymart", master: str | None = None, **conf: str
) -> SparkSession:
    """A session with UTC days, last-wins maps and adaptive execution."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of this session.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a folder of this machine, since no executor lives elsewhere.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors see")
        folder = tempfile.mkdtemp(prefix="tallymart-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder, for one table or one checkpoint."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Jobs planned meanwhile send at most so many rows to a Python task at once.

    A batch lies in buffers outside the heap, on both sides. A lower limit of the
    session holds; its own setting is back afterwards.
    """
    before = spark.conf.get(BATCH_SETTING, None)
    if before is not None and 0 < int(before) <= rows:
        yield
        return
    spark.conf.set(BATCH_SETTING, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_SETTING)
        else:
            spark.conf.set(BATCH_SETTING, before)
