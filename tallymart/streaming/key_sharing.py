"""API keys used from too many places within a short time.

A key's places, pairs of address and browser, are remembered until no new one
appeared for two hours; a known place does not extend that. Since whether a
place is new depends on all earlier ones, the key is a state of the stream.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# Hours a key's places are kept, and how many places are too many.
KEEP_HOURS = 2
MAX_PLACES = 2
MAX_ADDRESSES = 4
MAX_BROWSERS = 2
MAX_BROWSERS_PER_ADDRESS = 3

ALARM = (
    "api_key bigint, started_at timestamp_ntz, flagged_at timestamp_ntz, "
    "places int, addresses int, browsers int"
)
_STATE = (
    "started_at timestamp_ntz, renewed_at timestamp_ntz, flagged boolean, "
    "ips array<string>, browsers array<string>"
)


def shared(places: list[tuple[str, str]]) -> bool:
    """Whether the places of one key are too many."""
    if len(places) <= MAX_PLACES:
        return False
    per_address = Counter(ip for ip, _ in places)
    wide = len(per_address) > MAX_ADDRESSES
    if wide and len({browser for _, browser in places}) > MAX_BROWSERS:
        return True
    return max(per_address.values()) > MAX_BROWSERS_PER_ADDRESS


def _follow_key(
    key: tuple, batches: Iterator[pd.DataFrame], state: GroupState
) -> Iterator[pd.DataFrame]:
    """Keep a key's places; yield a row when they become too many."""
    started, renewed, flagged, places = None, None, False, []
    if state.exists:
        started, renewed, flagged, ips, browsers = state.get
        places = list(zip(ips, browsers, strict=True))
    keep = pd.Timedelta(hours=KEEP_HOURS)
    alarms = []
    visits = pd.concat(list(batches)).sort_values(["ts", "ip", "browser"])
    for visit in visits.itertuples():
        if renewed is not None and visit.ts > renewed + keep:
            started, renewed, flagged, places = None, None, False, []
        place = (visit.ip, visit.browser)
        if place in places:
            continue
        places.append(place)
        started, renewed = started or visit.ts, max(renewed or visit.ts, visit.ts)
        if not flagged and shared(places):
            flagged = True
            addresses, browsers = ({p[i] for p in places} for i in (0, 1))
            alarms.append(
                (key[0], started, visit.ts, len(places), len(addresses), len(browsers))
            )
    ips, browsers = [p[0] for p in places], [p[1] for p in places]
    state.update((started, renewed, flagged, ips, browsers))
    columns = ["api_key", "started_at", "flagged_at", "places", "addresses", "browsers"]
    if alarms:
        yield pd.DataFrame(alarms, columns=columns)


def once_per_second(visits: DataFrame) -> DataFrame:
    """First visits from each place within a second, with their exact times.

    Later ones of the same second find a place that is known already and
    change nothing. This combines before the shuffle and bounds what one busy
    key can bring to the task that holds its state.
    """
    second = F.date_trunc("second", "ts").alias("second")
    return visits.groupBy("api_key", "ip", "browser", second).agg(F.min("ts").alias("ts")).drop("second")


def stream_alarms(visits: DataFrame) -> DataFrame:
    """Alarms of a stream of visits (ts, api_key, ip, browser)."""
    return visits.groupBy("api_key").applyInPandasWithState(
        _follow_key, ALARM, _STATE, "append", GroupStateTimeout.NoTimeout
    )


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KEEP_MICROS = KEEP_HOURS * 3600 * 1_000_000


def _numbered(rows: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Times in microseconds and place numbers of visits in order, and the places in order.

    A visit is held as twelve bytes, whatever its texts. Order is by time, then
    address, then browser, nulls last.
    """
    numbers: dict[tuple, int] = {}
    times, codes = [], []
    for frame in rows:
        times.append(frame["ts"].to_numpy("datetime64[us]").astype(np.int64))
        ip, ips = pd.factorize(frame["ip"], use_na_sentinel=False)
        browser, browsers = pd.factorize(frame["browser"], use_na_sentinel=False)
        pairs, local = np.unique(ip * max(len(browsers), 1) + browser, return_inverse=True)
        texts = [
            tuple(None if pd.isna(text) else text for text in (ips[pair // len(browsers)], browsers[pair % len(browsers)]))
            for pair in pairs
        ]
        own = np.array([numbers.setdefault(place, len(numbers)) for place in texts], np.int32)
        codes.append(own[local])
    places = list(numbers)
    ranked = sorted(range(len(places)), key=lambda n: [(text is None, text or "") for text in places[n]])
    rank = np.empty(len(places), np.int32)
    rank[ranked] = np.arange(len(places), dtype=np.int32)
    at, code = np.concatenate(times), rank[np.concatenate(codes)]
    order = np.lexsort((code, at))
    return at[order], code[order], [places[n] for n in ranked]


def _first_unknown(known: np.ndarray, code: np.ndarray, start: int, end: int) -> int:
    """The first visit from ``start`` on to a place that is not known, or ``end``."""
    size = 64
    while start < end:
        stop = min(start + size, end)
        new = ~known[code[start:stop]]
        if new.any():
            return start + int(new.argmax())
        start, size = stop, min(2 * size, 1 << 16)
    return end


class PlaceWatch:
    """Keyed state of one API key in the state store, one map entry per place.

    ``session`` holds (started, renewed, flagged, places, addresses, browsers,
    widest) with times in microseconds; ``places`` maps (ip, browser) to the
    time it was first seen, ``addresses`` and ``browsers`` count places per
    address and per browser. An event-time timer at ``renewed`` plus the kept
    hours clears all of it, so idle keys leave no state. A batch looks each of its
    places up once and passes over visits to known ones in blocks, so a busy
    key costs lookups and writes by its places, not by its visits.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.session = handle.getValueState(
            "session",
            "started long, renewed long, flagged boolean, places long, addresses long, browsers long, widest long",
        )
        self.places = handle.getMapState("places", "ip string, browser string", "seen long")
        self.addresses = handle.getMapState("addresses", "ip string", "n long")
        self.browsers = handle.getMapState("browsers", "browser string", "n long")

    def _clear(self) -> None:
        for state in (self.session, self.places, self.addresses, self.browsers):
            state.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues):
        # The visits of one key in one batch, in time order; a batch is bounded by the trigger.
        at, code, distinct = _numbered(rows)
        session = self.session.get() if self.session.exists() else (None, None, False, 0, 0, 0, 0)
        started, renewed, flagged, places, addresses, browsers, widest = session
        # Each place of the batch is looked up once; what the batch adds is written at its end.
        known = np.array([self.places.containsKey(place) for place in distinct], bool)
        added: list[int] = []
        counts: dict[str, dict] = {"addresses": {}, "browsers": {}}
        cleared, alarms, row = False, [], 0

        def one_more(name: str, value) -> int:
            held = counts[name]
            if value not in held:
                state = getattr(self, name)
                held[value] = state.getValue((value,))[0] if not cleared and state.containsKey((value,)) else 0
            held[value] += 1
            return held[value]

        while row < len(at):
            if renewed is not None and at[row] > renewed + _KEEP_MICROS:
                started, renewed, flagged, places, addresses, browsers, widest = None, None, False, 0, 0, 0, 0
                known[:] = False
                counts = {"addresses": {}, "browsers": {}}
                cleared, added = True, []
            # Visits to known places change nothing until the kept hours are over.
            end = len(at) if renewed is None else int(np.searchsorted(at, renewed + _KEEP_MICROS, "right"))
            row = _first_unknown(known, code, row, end)
            if row == end:
                continue
            place, now = int(code[row]), int(at[row])
            ip, browser = distinct[place]
            known[place] = True
            added.append((place, now))
            per_address, per_browser = one_more("addresses", ip), one_more("browsers", browser)
            addresses += per_address == 1
            browsers += per_browser == 1
            places, widest = places + 1, max(widest, per_address)
            started = now if started is None else started
            renewed = now if renewed is None else max(renewed, now)
            too_many = places > MAX_PLACES and (
                (addresses > MAX_ADDRESSES and browsers > MAX_BROWSERS) or widest > MAX_BROWSERS_PER_ADDRESS
            )
            if not flagged and too_many:
                flagged = True
                alarms.append((key[0], started, now, places, addresses, browsers))
            row += 1
        if cleared:
            self._clear()
        for place, now in added:
            self.places.updateValue(distinct[place], (now,))
        for name, held in counts.items():
            for value, n in held.items():
                getattr(self, name).updateValue((value,), (n,))
        if renewed is not None and added:
            self.session.update((started, renewed, flagged, places, addresses, browsers, widest))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer((renewed + _KEEP_MICROS) // 1000 + 1)
        if alarms:
            frame = pd.DataFrame(alarms, columns=["api_key", "started_at", "flagged_at", "places", "addresses", "browsers"])
            for column in ("started_at", "flagged_at"):
                frame[column] = pd.to_datetime(frame[column], unit="us")
            yield frame.astype({"places": "int32", "addresses": "int32", "browsers": "int32"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self._clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_alarms_in_store(visits: DataFrame, delay: str = f"{KEEP_HOURS} hours") -> DataFrame:
    """As ``stream_alarms``, with the key's places in the RocksDB state store and timers that expire them.

    Visits are watermarked ``delay`` behind the newest; visits later than the
    watermark are dropped by Spark, as for any event-time state.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    processor = type("PlaceWatchProcessor", (PlaceWatch, StatefulProcessor), {})
    visits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Watermarks need a time-zoned column; the session's zone (UTC) reads the local times.
    return (
        visits.withColumn("_event_at", F.col("ts").cast("timestamp"))
        .withWatermark("_event_at", delay)
        .groupBy("api_key")
        .transformWithStateInPandas(processor(), ALARM, "Append", "EventTime")
    )
