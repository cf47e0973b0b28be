"""Live match state from a stream of deliveries.

Balls can arrive late, twice or out of order. Each innings keeps its totals and the number of the next ball as a typed
value, and the balls that wait behind a gap as entries of a typed map, so an arriving ball touches only what it concerns.
States are given in order alone: every one equals the batch computation's. What can no longer be told in order is not
lost: it comes out beside the states, marked as late.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from overstats import config as C

OUTPUT = ("match_id string, innings int, seq int, balls_left bigint, wickets bigint, "
          "runs bigint, kind string")
STATE, LATE = "state", "late"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


def ball_limit(fmt: Column, limits: Mapping[str, int | None] | None = None) -> Column:
    """Balls of an innings by format; null for formats without a limit and unknown ones."""
    limits = {k: v["balls"] for k, v in C.FORMATS.items()} if limits is None else limits
    out = F.lit(None).cast("int")
    for name, balls in limits.items():
        out = F.when(fmt == name, F.lit(balls).cast("int")).otherwise(out)
    return out


def feed(deliveries: DataFrame, limits: Mapping[str, int | None] | None = None) -> DataFrame:
    """What the stream needs of each ball, whatever else it carries; the limit is that of the ball's format."""
    return deliveries.select(
        F.col("match_id").cast("string").alias("match_id"), F.col("innings").cast("int"),
        F.col("seq").cast("int"), F.col("is_legal").cast("int"),
        F.col("team_wickets").cast("bigint").alias("team_wickets"),
        F.col("runs_total").cast("bigint").alias("runs_total"),
        F.col("penalty_pre").cast("bigint").alias("penalty_pre"),
        ball_limit(F.col("fmt"), limits).alias("max_balls"),
    )


def milliseconds(text: str) -> int:
    """'90 seconds', '1 day'."""
    number, unit = text.split()
    return int(number) * UNITS[unit.rstrip("s")] * 1000


class Innings(StatefulProcessor):
    """One innings: totals so far, waiting balls, and when it was last heard of."""

    def __init__(self, idle: int, patience: int, remember: int):
        self.idle, self.patience, self.remember = idle, patience, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "next int, legal bigint, wickets bigint, runs bigint, heard bigint, max_balls int, held int")
        self.waiting = handle.getMapState("waiting", "seq int", "is_legal int, wickets bigint, runs bigint")
        #: Number of the next ball of an innings that is over; forgotten by itself.
        self.over = handle.getValueState("over", "next int", self.remember)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [f for f in rows if len(f)]
        if not frames:
            return
        balls = pd.concat(frames)
        if self.over.exists():
            closed = self.over.get()[0]
            yield self._late(key, [(r.seq, r.is_legal, r.team_wickets, r.runs_total) for r in balls[balls["seq"] >= closed].itertuples()])
            return
        limits = balls["max_balls"].dropna()
        if self.totals.exists():
            expected, legal, wickets, runs, _, limit, held = self.totals.get()
        else:
            expected, legal, wickets, runs, limit = 1, 0, 0, int(balls["penalty_pre"].max()), None
            held = 0
        limit = int(limits.iloc[0]) if limit is None and len(limits) else limit
        arrived = {int(r.seq): (int(r.is_legal), int(r.team_wickets), int(r.runs_total)) for r in balls[balls["seq"] >= expected].itertuples()}
        out = []
        while True:
            stored = self.waiting.getValue((expected,)) if held and self.waiting.containsKey((expected,)) else None
            if stored is not None:
                self.waiting.removeKey((expected,))
                held -= 1
            ball = arrived.pop(expected, stored)
            if ball is None:
                break
            legal, wickets, runs = legal + ball[0], wickets + ball[1], runs + ball[2]
            out.append((*key, expected, None if limit is None else limit - legal, wickets, runs, STATE))
            expected += 1
        for seq, ball in arrived.items():
            held += not (held and self.waiting.containsKey((seq,)))
            self.waiting.updateValue((seq,), ball)
        now = timerValues.getCurrentProcessingTimeInMs()
        self.totals.update((expected, legal, wickets, runs, now, limit, held))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.idle)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.totals.exists():
            return
        expected, *_, heard, _, held = self.totals.get()
        now = timerValues.getCurrentProcessingTimeInMs()
        if held and now < heard + self.patience:  # the gap may still close
            self.handle.registerTimer(heard + self.patience)
            return
        left = [(k[0], *v) for k, v in self.waiting.iterator()] if held else []
        self.totals.clear()
        if left:
            self.waiting.clear()
        self.over.update((expected,))
        yield self._late(key, left)

    def _late(self, key, balls: list[tuple]) -> pd.DataFrame:
        """Balls as they came, after one that is missing or an end: their own runs and wickets in place of totals."""
        return self._frame([(*key, int(seq), None, int(wickets), int(runs), LATE) for seq, _, wickets, runs in sorted(balls)])

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["match_id", "innings", "seq", "balls_left", "wickets", "runs", "kind"])
        return out.astype({"balls_left": "Int64"})

    def close(self) -> None:
        pass


def live_feed(stream: DataFrame, idle: str = "1 day", patience: str = "7 days", remember: str = "30 days") -> DataFrame:
    """State after every ball, as soon as all balls before it have arrived (``kind`` is state), and late balls (late).

    ``stream`` has the columns of :func:`feed`. Ball numbers start at 1 and repeats are ignored. An innings that is silent for
    ``idle`` and waits for no ball is over and its state goes; one with balls behind a gap stays for ``patience``, then these
    come out as late, with their own runs and wickets, and its state goes too. For ``remember``, one number tells that the
    innings is over: balls up to there are repeats, later ones late. After that an innings of that name would begin anew.
    Times are those of processing. The session must keep state in RocksDB, as :func:`overstats.session.session` does.
    """
    if ROCKS not in (stream.sparkSession.conf.get(PROVIDER, "") or ""):
        raise ValueError(f"set {PROVIDER} to {ROCKS}")
    times = [milliseconds(x) for x in (idle, patience, remember)]
    return stream.groupBy("match_id", "innings").transformWithStateInPandas(
        Innings(*times), OUTPUT, "append", "ProcessingTime")


def live_states(stream: DataFrame, idle: str = "1 day", patience: str = "7 days", remember: str = "30 days") -> DataFrame:
    """The states of :func:`live_feed` alone."""
    return live_feed(stream, idle, patience, remember).where(F.col("kind") == STATE).drop("kind")
