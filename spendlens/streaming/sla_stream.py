"""G4 as a stream: SLA clocks kept in state per finding, events folded in order of event time.

Events of a finding may arrive late and out of order. Each waits in the finding's state
until the watermark has passed its time; then a timer folds it into the clock. So the
clock sees events exactly in the order of the batch replay, whatever order they came in,
and state holds only what the watermark has not passed plus one clock. Events later than
the watermark allows are dropped by it. The keyed state and the progress lie in the
checkpoint location; a restarted query goes on where it stopped.
"""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KEY = ["tenant_id", "workspace", "fingerprint"]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

EVENT = "source string, state string, snooze_until timestamp, event_ts timestamp, days int, sla_days int, detected_at timestamp"
CLOCK = (
    "first_ts timestamp, detected_at timestamp, sla_days int, opened timestamp, pause_from timestamp, paused long, extension long, breached timestamp, events long, extensions int, "
    "own_state string, own_until timestamp, group_state string, group_until timestamp"
)
OUTPUT = (
    "tenant_id string, workspace string, fingerprint string, first_detected_at timestamp, first_opened_at timestamp, sla_days int, sla_paused_at timestamp, sla_total_paused_seconds long, "
    "sla_extension_seconds long, sla_deadline timestamp, sla_breached_at timestamp, sla_extended_count int, events long, folded long"
)
_CLOCK_FIELDS = [f.split()[0] for f in CLOCK.split(", ")]
_EVENT_FIELDS = [f.split()[0] for f in EVENT.split(", ")]
_NEW = dict.fromkeys(_CLOCK_FIELDS) | {"paused": 0, "extension": 0, "events": 0, "extensions": 0}


def _none(v):
    """A value from pandas as Python has it: missing ones None, whole numbers (float beside missing ones) int."""
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else int(v)
    return v


def _effective(c: dict, at) -> str:
    """The effective state at a time: resolved, ignored or actively snoozed, the group's first; else open."""
    for state, until in ((c["group_state"], c["group_until"]), (c["own_state"], c["own_until"])):
        if state in ("resolved", "ignored") or (state == "snoozed" and until is not None and until > at):
            return state
    return "open"


def deadline_of(c: dict):
    if c["opened"] is None or c["sla_days"] is None:
        return None
    return c["opened"] + pd.Timedelta(days=c["sla_days"], seconds=c["paused"] + c["extension"])


def fold(c: dict, e: dict) -> dict:
    """The clock after one more event."""
    c, at = dict(c), e["event_ts"]
    c["detected_at"], c["sla_days"] = e["detected_at"], e["sla_days"]
    if e["source"] == "extension":
        c["extension"] += 86400 * int(e["days"] or 0)
        c["extensions"] += 1
    else:
        whose = "own" if e["source"] == "finding" else "group"
        c[f"{whose}_state"], c[f"{whose}_until"] = e["state"], e["snooze_until"]
        c["first_ts"] = at if c["first_ts"] is None else c["first_ts"]
        c["events"] += 1
        now = _effective(c, at)
        if now == "open" and c["opened"] is None:
            c["opened"] = at
        if now == "snoozed":
            c["pause_from"] = at if c["pause_from"] is None else c["pause_from"]
        elif c["pause_from"] is not None:
            c["paused"] += max(0, math.floor((at - c["pause_from"]).total_seconds()))
            c["pause_from"] = None
    due = deadline_of(c)
    if due is not None and due < at:
        c["breached"] = at if c["breached"] is None else c["breached"]
    elif e["source"] == "extension":
        c["breached"] = None
    return c


class SlaClock(StatefulProcessor):
    """Waiting events and the clock of one finding."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", CLOCK + ", folded long")
        self.waiting = handle.getListState("waiting", EVENT)

    def handleInputRows(self, key, rows, timerValues):
        for batch in rows:
            for r in batch[_EVENT_FIELDS].itertuples(index=False):
                self.waiting.appendValue(tuple(_none(v) for v in r))
                self.handle.registerTimer(math.ceil(pd.Timestamp(r.event_ts).timestamp() * 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = expiredTimerInfo.getExpiryTimeInMs()
        events = [dict(zip(_EVENT_FIELDS, (_none(v) for v in row), strict=True)) for row in self.waiting.get()]
        due = [e for e in events if pd.Timestamp(e["event_ts"]).timestamp() * 1000 <= until]
        if not due:
            return
        rest = [e for e in events if pd.Timestamp(e["event_ts"]).timestamp() * 1000 > until]
        c, folded = dict(_NEW), 0
        if self.clock.exists():
            *values, folded = self.clock.get()
            c = dict(zip(_CLOCK_FIELDS, map(_none, values), strict=True))
        for e in sorted(due, key=lambda e: (e["event_ts"], e["source"], e["state"] or "", e["days"] or 0)):
            c = fold(c, e)
        folded += len(due)
        self.clock.update((*(c[f] for f in _CLOCK_FIELDS), folded))
        if rest:
            self.waiting.put([tuple(e[f] for f in _EVENT_FIELDS) for e in rest])
        else:
            self.waiting.clear()
        first = c["first_ts"] if c["detected_at"] is None else c["detected_at"]
        row = (*key, first, c["opened"], c["sla_days"], c["pause_from"], c["paused"], c["extension"], deadline_of(c), c["breached"], c["extensions"], c["events"], folded)
        yield pd.DataFrame([row], columns=[f.split()[0] for f in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def sla_stream(events: DataFrame, days: DataFrame, *, delay: str = "1 day") -> DataFrame:
    """Governance rows of a stream of events, a new one each time a finding's clock moves on.

    ``events`` (streaming): key, source (finding, group, extension), state, snooze_until, event_ts,
    days; ``days`` (static): key, sla_days, detected_at of the findings of the read model. The
    row of the largest ``folded`` of a finding is its newest. Needs the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    known = events.withWatermark("event_ts", delay).join(days, KEY)
    return known.groupBy(*KEY).transformWithStateInPandas(statefulProcessor=SlaClock(), outputStructType=OUTPUT, outputMode="Update", timeMode="EventTime")
