"""Sigma ``near`` conditions on a stream, by a state machine for each rule, case and host.

The state holds the events that may still matter: those not older than two time frames before the
watermark. An event of the search is decided once the watermark has passed its time frame; timers
stand at multiples of the time frame, so a busy host's events are decided a slot at a time. The
decisions are those of plans.timed.near() over the same events, but for events that come later
than the watermark allows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tracelake.plans import timed
from tracelake.plans.sigma import SigmaRule

_DETECTED = "rule_id string, case_id string, host string, artifact_id string, matched_on string, t long"


class _Near(StatefulProcessor):
    """``told`` has (rule id, micros, text, [(bit, wanted)]) by rule number."""

    def __init__(self, told: list[tuple[str, int, str, list[tuple[int, bool]]]]):
        self.told = told

    def init(self, handle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "t long, artifact_id string, base boolean, mask long, decided boolean")

    def _slot_end(self, t: int, span: int) -> int:
        """In ms: the first multiple of the time frame at which an event at ``t`` can be decided."""
        return -(-(t + span + 1) // span) * span // 1000 + 1

    def handleInputRows(self, key, rows, timerValues):
        span = self.told[key[0]][1]
        ends = set()
        for r in rows:
            self.events.appendValue((r["t"], r["artifact_id"], r["base"], r["mask"], False))
            ends.add(self._slot_end(r["t"], span))
        for end in ends:
            self.handle.registerTimer(end)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        rule_id, span, text, parts = self.told[key[0]]
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(tuple(e) for e in self.events.get())
        times = {bit: [e[0] for e in events if e[3] & bit] for bit, _ in parts}

        def seen(bit: int, t: int) -> bool:
            return bisect_right(times[bit], t + span) > bisect_left(times[bit], t - span)

        kept, out = [], []
        for t, artifact, base, mask, decided in events:
            if base and not decided and t + span < passed:
                decided = True
                if all(seen(bit, t) == wanted for bit, wanted in parts):
                    out.append(Row(rule_id=rule_id, case_id=key[1], host=key[2], artifact_id=artifact, matched_on=text, t=t))
            if t + 2 * span >= passed or (base and not decided):
                kept.append((t, artifact, base, mask, decided))
        if kept:
            self.events.put(kept)
        else:
            self.events.clear()
        return iter(out)

    def close(self) -> None:
        pass


def detect_near(artifacts: DataFrame, found: list[SigmaRule], lateness: str = "1 hour") -> DataFrame:
    """Detections of the ``near`` rules of sigma.assemble() on a stream of artifacts: rule_id, case_id, host, artifact_id, matched_on, t (microseconds).

    The session's state store must be RocksDB's. Events without a time take no part; null cases
    and hosts are keys of their own.
    """
    found = [r for r in found if r.timed is not None and r.timed.near]
    told = [(r.rule.id, r.timed.micros, r.timed.text, [(1 << k, wanted) for k, (_, wanted) in enumerate(r.timed.near)]) for r in found]
    events = timed.near_events(artifacts, [(r.rule.id, r.rule.types, r.predicate, r.timed) for r in found], found[0].fields)
    marked = events.withColumn("at", F.timestamp_micros("t")).withWatermark("at", lateness)
    return marked.groupBy("rule", "case_id", "host").transformWithState(_Near(told), _DETECTED, "append", "eventTime")
