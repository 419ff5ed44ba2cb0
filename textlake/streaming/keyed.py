"""Keyed state over streams, in order of event time: bounded buffers, token buckets, clause buffers.

Rows of a key wait in state until the watermark has passed their time; a timer then takes all that are due, in the order of time and
place, through a fold. So results do not depend on how the input is cut into batches. A key that has been idle for `idle_s` seconds
of event time is closed: what its fold still holds is emitted and its state goes. State lives in RocksDB below the query's checkpoint,
from which a restarted query goes on.

Defined cases
    null keys: one key.      rows later than the watermark: dropped, as everywhere in Structured Streaming.
    null time: never due; such rows are left out before.      times up to 1970: late from the start, as the first watermark is 0.    equal times: in the order of `place`, then of the payload.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Fold(ABC):
    """What is done with a key's rows, one after another. State and rows are JSON values; outputs are tuples of `schema`."""

    schema: str

    @abstractmethod
    def start(self) -> dict:
        """The state of a new key."""

    @abstractmethod
    def step(self, state: dict, at: int, row: dict) -> Iterator[tuple]:
        """Take a row at a time (milliseconds) into the state."""

    def close(self, state: dict) -> Iterator[tuple]:
        """What a key emits when it goes."""
        return iter(())


class Evictions(Fold):
    """First in, first out: the oldest messages leave while more than `cap` tokens are held and one message would stay. `cursor`, the
    number of messages already read, moves with the buffer and never below 0."""

    schema = "turn bigint, tokens bigint, held bigint, cursor bigint"

    def __init__(self, cap: int, cursor: int = 0):
        self.cap, self.cursor = cap, cursor

    def start(self) -> dict:
        return {"buffer": [], "held": 0, "cursor": self.cursor}

    def step(self, state: dict, at: int, row: dict) -> Iterator[tuple]:
        buffer = deque(state["buffer"])
        buffer.append((row["turn"], row["tokens"]))
        state["held"] += row["tokens"]
        while state["held"] > self.cap and len(buffer) > 1:
            turn, tokens = buffer.popleft()
            state["held"] -= tokens
            state["cursor"] = max(0, state["cursor"] - 1)
            yield turn, tokens, state["held"], state["cursor"]
        state["buffer"] = list(buffer)


class TokenBucket(Fold):
    """A bucket refills by `rate` tokens a second up to `burst`; an event passes if it finds a token."""

    schema = "event_id bigint, allowed boolean, level double"

    def __init__(self, rate: float, burst: float):
        self.rate, self.burst = rate, burst

    def start(self) -> dict:
        return {"level": self.burst, "t": None}

    def step(self, state: dict, at: int, row: dict) -> Iterator[tuple]:
        t = row["micros"]
        passed = 0.0 if state["t"] is None else (t - state["t"]) / 1e6 * self.rate
        level = min(self.burst, state["level"] + passed)
        allowed = level >= 1.0
        state["level"], state["t"] = level - 1.0 if allowed else level, t
        yield row["event_id"], allowed, state["level"]


class Clauses(Fold):
    """Pieces of an answer are held until a clause ends, or `most` characters have come together, and then given out through `clean`;
    what is left follows when the key is closed."""

    schema = "seq bigint, text string"
    #: Fixed value: what ends a clause.
    ENDS = "，。；！？、\n】…"

    def __init__(self, most: int = 120, clean: Callable[[str], str] = str):
        self.most, self.clean = most, clean

    def start(self) -> dict:
        return {"held": "", "seq": 0}

    def _out(self, state: dict, text: str) -> tuple:
        state["seq"] += 1
        return state["seq"] - 1, self.clean(text)

    def step(self, state: dict, at: int, row: dict) -> Iterator[tuple]:
        held = state["held"] + (row["piece"] or "")
        cut = max(held.rfind(c) for c in self.ENDS) + 1
        if cut:
            yield self._out(state, held[:cut])
            held = held[cut:]
        if len(held) >= self.most:
            yield self._out(state, held)
            held = ""
        state["held"] = held

    def close(self, state: dict) -> Iterator[tuple]:
        if state["held"]:
            yield self._out(state, state["held"])


class _Ordered(StatefulProcessor):
    def __init__(self, fold: Fold, idle_ms: int, names: list[str]):
        self.fold, self.idle_ms, self.names = fold, idle_ms, names

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, place bigint, payload string")
        self.folded = handle.getValueState("folded", "state string, last bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for b in rows:
            new = [(int(a), int(p), x) for a, p, x in zip(b["at_ms"], b["place"], b["payload"], strict=True)]
            if new:
                self.waiting.appendList(new)
                first = min([a for a, *_ in new] + ([] if first is None else [first]))
        if first is not None:  # one timer takes all rows that are due by then, and sets the next
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in rows if r[0] <= now]
        state, last = (json.loads(x) if i == 0 else x for i, x in enumerate(self.folded.get())) if self.folded.exists() else (None, -1)
        out = []
        for at, _, payload in due:
            if state is not None and at >= last + self.idle_ms:  # it had gone before
                out += self.fold.close(state)
                state = None
            state = state if state is not None else self.fold.start()
            out += self.fold.step(state, at, json.loads(payload))
            last = at
        if due:
            later = rows[len(due) :]
            self.waiting.clear()
            if later:
                self.waiting.appendList(later)
                self.handle.registerTimer(later[0][0])
        if state is not None and last + self.idle_ms <= now:
            out += self.fold.close(state)
            self.folded.clear()
        elif due:
            self.folded.update((json.dumps(state), last))
            self.handle.registerTimer(last + self.idle_ms)
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=self.names)

    def close(self) -> None:
        pass


def keyed(rows: DataFrame, key: str, at: Column, place: Column, payload: list[str], fold: Fold, late: str, idle_s: int) -> DataFrame:
    """(key, the fold's columns) of a stream: `fold` over each key's rows in the order of `at` (a timestamp) and `place`, seeing the columns
    `payload`. Rows may come up to `late` out of order."""
    spark = rows.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKS:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # keyed timers and lists need it
    rows = rows.select(key, at.cast("timestamp").alias("at"), place.cast("bigint").alias("place"), F.to_json(F.struct(*payload)).alias("payload")).where("at is not null")
    rows = rows.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", late)
    kind = dict(rows.dtypes)[key]
    schema = f"{key} {kind}, {fold.schema}"
    names = [key, *[c.split()[0] for c in fold.schema.split(", ")]]
    return rows.groupBy(key).transformWithStateInPandas(_Ordered(fold, idle_s * 1000, names), schema, "Append", "EventTime")
