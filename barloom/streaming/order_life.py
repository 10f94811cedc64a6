"""The order state machine with a countdown that runs out, on event-time timers.

Orders are dealt into groups: a call of the processor, a read of its state and a timer cost milliseconds whatever they
hold, so a group of orders shares one of each, not every order its own."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.services import STATES

COUNTDOWN = STATES.index("COUNTDOWN")
EXPIRED = "EXPIRED"
#: Groups that orders are dealt into, for the life of a stream's checkpoint.
GROUPS = 512
#: The time, in microseconds, of a move without one: such moves are judged last in their batch.
UNDATED = 2**63 - 1
OUT = "order_id long, us long, state string, previous string, legal boolean"


class OrderLife(StatefulProcessor):
    """State of a group: its open orders, each one's place among STATES and when it came there (microseconds); nothing
    once all their lives are over. One timer is set at a time: the first end of a countdown, or the first moment after
    which an idle order is forgotten."""

    def __init__(self, countdown: timedelta, idle: timedelta) -> None:
        self.countdown, self.idle = (x // timedelta(microseconds=1) for x in (countdown, idle))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("open", "order_id array<long>, at array<int>, since_us array<long>")

    def _read(self) -> dict[int, tuple[int, int]]:
        return {o: (at, since) for o, at, since in zip(*self.state.get())} if self.state.exists() else {}

    def _until(self, at: int, since: int) -> int:
        """In milliseconds: the next whole one, so that the watermark is never short of the end itself."""
        return -(-(since + (self.countdown if at == COUNTDOWN else self.idle)) // 1000)

    def _write(self, open_orders: dict[int, tuple[int, int]]) -> None:
        until = min((self._until(*x) for x in open_orders.values()), default=None)
        timers = list(self.handle.listTimers())
        for timer in timers:
            if timer != until:
                self.handle.deleteTimer(timer)
        if until is None:
            self.state.clear()
            return
        self.state.update((list(open_orders), *map(list, zip(*open_orders.values()))))
        if until not in timers:
            self.handle.registerTimer(until)

    def _rows(self, key: tuple, out: list[tuple[int, int, str | None, str | None, bool]]) -> pd.DataFrame:
        order, us, state, previous, legal = zip(*out) if out else [()] * 5
        order = pd.Series([None] * len(order) if key[0] < 0 else order, dtype="Int64")
        return pd.DataFrame({"order_id": order, "us": np.array(us, np.int64), "state": pd.Series(state, dtype=object), "previous": pd.Series(previous, dtype=object), "legal": np.array(legal, bool)})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        open_orders, out = self._read(), []
        moves = pd.concat(rows)
        by = np.lexsort((moves["us"], moves["order_id"]))  # stable
        for order, us, name in zip(*(moves[c].to_numpy()[by].tolist() for c in ("order_id", "us", "state"))):
            at, since = open_orders.get(order, (-1, 0))
            if at == COUNTDOWN and us != UNDATED and us > since + self.countdown:
                out.append((order, since + self.countdown, EXPIRED, STATES[at], True))
                del open_orders[order]
                at = -1
            legal = at + 1 < len(STATES) and name == STATES[at + 1]
            out.append((order, us, name, STATES[at] if at >= 0 else None, legal))
            if legal and at + 2 < len(STATES):
                # An undated move leaves its order's time, or takes the watermark's.
                at_us = us if us != UNDATED else since if at >= 0 else timerValues.getCurrentWatermarkInMs() * 1000
                open_orders[order] = (at + 1, at_us)
            elif legal:
                del open_orders[order]
        self._write(open_orders)
        yield self._rows(key, out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        open_orders, out = self._read(), []
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)
        for order, (at, since) in list(open_orders.items()):
            if self._until(at, since) <= passed:
                del open_orders[order]
                if at == COUNTDOWN:
                    out.append((order, since + self.countdown, EXPIRED, STATES[at], True))
        self._write(open_orders)
        yield self._rows(key, out)

    def close(self) -> None:
        pass


def order_life(moves: DataFrame, countdown_seconds: int = 10, late: str = "1 hour", idle: timedelta = timedelta(days=1), groups: int = GROUPS) -> DataFrame:
    """moves: order_id, ts (timestamp), state. Every move with the state its order was in and whether it was legal (an
    illegal one leaves the order where it was), and a row EXPIRED at the countdown's end for every order that was left in
    COUNTDOWN longer: at its next move or, without one, once the watermark passes. An expired or acknowledged order's
    life is over and nothing of it is kept; an order in any other state is forgotten once it was idle for `idle`. Moves
    behind the watermark are dropped. Wherever batches end, rows are the same as long as no move is late. Orders share
    state by `groups`, which stays as it is while a checkpoint lives; a batch reads and writes the open orders of each
    group that it has moves of."""
    # Moves without an order are a group of their own.
    group = F.when(F.col("order_id").isNull(), -1).otherwise(F.pmod(F.xxhash64(F.col("order_id").cast("long")), F.lit(groups)))
    us = F.coalesce(F.unix_micros("ts"), F.lit(UNDATED))
    watched = moves.withWatermark("ts", late).select(group.alias("group"), F.coalesce(F.col("order_id").cast("long"), F.lit(0)).alias("order_id"), "ts", us.alias("us"), "state")
    judged = watched.groupBy("group").transformWithStateInPandas(OrderLife(timedelta(seconds=countdown_seconds), idle), OUT, "Append", "EventTime")
    return judged.select("order_id", F.when(F.col("us") != UNDATED, F.timestamp_micros("us")).alias("ts"), "state", "previous", "legal")
