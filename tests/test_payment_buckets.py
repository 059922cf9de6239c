"""Payment states by bucket: results of many batches unchanged, each bucket's runs bounded."""

from pyspark.sql import functions as F
from test_properties import by_row, payment_log, simulate
from test_streams import drained

from tallymart.sources.files import Store
from tallymart.streaming import subscriptions


def test_many_batches_keep_few_runs_per_bucket(spark, tmp_path):
    events = payment_log(5)
    table = spark.createDataFrame(events, subscriptions.EVENT)
    times = sorted(e[3] for e in events)
    cuts = [times[len(times) * k // 8] for k in range(1, 8)]
    parts, low = [], None
    for cut in [*cuts, None]:
        part = table
        if low is not None:
            part = part.where(F.col("at") >= F.lit(low))
        if cut is not None:
            part = part.where(F.col("at") < F.lit(cut))
        parts.append(part)
        low = cut
    grants = str(tmp_path / "grants")

    def start(stream, path, checkpoint):
        return subscriptions.stream_payments(stream, path, grants, checkpoint)

    drained(spark, parts, subscriptions.EVENT, start, tmp_path)
    granted = spark.read.parquet(grants).drop("batch_id")
    assert by_row(granted) == by_row(subscriptions.grants(table))
    got = subscriptions.subscriptions(subscriptions.user_states(granted)).collect()
    assert {r.user_id: (r.subscription_type, r.subscription_end_at) for r in got} == simulate(events)
    store = Store(spark, str(tmp_path / "out"))
    runs = [len(store.names(name)) for name in store.names() if name.startswith("bucket=")]
    assert runs and max(runs) <= subscriptions.RUNS
