"""The calls that presence on a stream makes on its state, each a round trip to the JVM."""

from __future__ import annotations

import pandas as pd

from pulseframe.streaming.presence import _Presence, silences


class Handle:
    """State and timers of one client, counting calls."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def listTimers(self):
        self.calls += 1
        return iter(set(self.timers))

    def deleteTimer(self, timer):
        self.calls += 1
        self.timers.remove(timer)

    def registerTimer(self, timer):
        self.calls += 1
        self.timers.add(timer)


def frames(*buckets):
    return iter([pd.DataFrame([b], columns=["first_ts", "last_ts", "offline"]) for b in buckets])


def test_calls_on_the_state():
    handle, processor = Handle(), _Presence(10)
    processor.init(handle)
    assert list(processor.handleInputRows(("a",), frames((1, 2, False)), None)) == []
    assert handle.calls == 1 and not handle.timers
    (out,) = processor.handleInputRows(("a",), frames((30, 31, False), (12, 14, True)), None)
    assert out["offline_ts"].tolist() == [14] and handle.value is None and not handle.timers
    list(processor.handleInputRows(("a",), frames((41, 45, True)), None))
    assert handle.value == (45,) and handle.timers == {60}
    list(processor.handleInputRows(("a",), frames((50, 52, True)), None))
    assert handle.value == (52,) and handle.timers == {70}
    handle.timers.clear()
    (out,) = processor.handleExpiredTimer(("a",), None, None)
    assert out["expired_ts"].tolist() == [62] and handle.value is None


def test_silences():
    assert silences([(20, 25, True), (1, 5, True)], None, 10) == ([5], 25)
    assert silences([(15, 16, False)], 5, 10) == ([], None)
    assert silences([(16, 16, False)], 5, 10) == ([5], None)
