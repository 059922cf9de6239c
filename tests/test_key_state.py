"""Key sharing on the state store with timers: the same alarms, and idle keys leave no state."""

import datetime as dt
import random

import pandas as pd
from conftest import at
from test_streams import brute_alarms, drained

from tallymart.streaming import key_sharing, tables

SCHEMA = "ts timestamp_ntz, api_key bigint, ip string, browser string"


def test_alarms_in_the_state_store(spark, tmp_path):
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
    # Key 0 alone comes back two days later: the watermark passes every other key's timer.
    later = [(at(5, 12, minute), 0, f"ip{minute % 6}", "f") for minute in range(3)]
    visits += later
    parts = [spark.createDataFrame(part, SCHEMA) for part in (visits[:300], visits[300:-3], later)]

    def start(stream, path, checkpoint):
        return tables.append_rows(key_sharing.stream_alarms_in_store(stream), path, checkpoint)

    try:
        got = {tuple(r) for r in drained(spark, parts, SCHEMA, start, tmp_path).collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = brute_alarms(visits)
    assert want and got == want
    checkpoint = str(tmp_path / "check")
    for name in ("session", "places"):
        state = spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
        assert {row["key"][0] for row in state.select("key").collect()} == {0}


class _Map:
    def __init__(self, calls):
        self.calls, self.held = calls, {}

    def containsKey(self, key):
        self.calls.append("read")
        return key in self.held

    def getValue(self, key):
        self.calls.append("read")
        return self.held[key]

    def updateValue(self, key, value):
        self.calls.append("write")
        self.held[key] = value

    def clear(self):
        self.held.clear()


class _Value(_Map):
    def exists(self):
        return "value" in self.held

    def get(self):
        return self.held["value"]

    def update(self, value):
        self.held["value"] = value


class _Handle:
    def __init__(self):
        self.calls, self.timers = [], []

    def getValueState(self, *_):
        return _Value(self.calls)

    def getMapState(self, *_):
        return _Map(self.calls)

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, timer):
        self.timers.remove(timer)

    def registerTimer(self, timer):
        self.timers.append(timer)


def _watched(batches):
    watch, handle, alarms = key_sharing.PlaceWatch(), _Handle(), set()
    watch.init(handle)
    for batch in batches:
        frame = pd.DataFrame(batch, columns=["ts", "api_key", "ip", "browser"])
        pieces = [frame[start : start + 50] for start in range(0, len(frame), 50)]
        for out in watch.handleInputRows((0,), iter(pieces), None):
            alarms |= {tuple(x.to_pydatetime() if hasattr(x, "to_pydatetime") else x for x in row) for row in out.itertuples(index=False)}
    return alarms, handle


def test_visits_to_known_places_cost_no_state_calls():
    start = at(1, 0)
    visits = [(start + dt.timedelta(seconds=n), 0, f"ip{n % 6}", "fcso"[n % 4]) for n in range(5000)]
    alarms, handle = _watched([visits])
    assert alarms == brute_alarms(visits)
    assert len(handle.calls) < 200


def test_keyed_state_over_batches_and_idle_times():
    for seed in range(20):
        rng = random.Random(seed)
        now, visits = at(1, 0), []
        for _ in range(400):
            now += dt.timedelta(minutes=rng.choice([0, 0, 1, 2, 30, 119, 120, 121, 200]) * (rng.random() < 0.4))
            visits.append((now, 0, f"ip{rng.randrange(7)}", rng.choice("fcso")))
        visits = sorted(set(visits))
        cuts = sorted({0, len(visits), *(rng.randrange(len(visits)) for _ in range(3))})
        batches = [visits[a:b] for a, b in zip(cuts, cuts[1:])]
        assert _watched(batches)[0] == brute_alarms(visits)
