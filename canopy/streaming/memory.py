"""Session memory as keyed state: what a user's next turn may look back on."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, IntegralType, LongType, StructField, StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TURNS = 3            # fixed value: turns kept for context
IDLE_SECONDS = 1800  # fixed value: a longer pause ends the session
BUCKETS = 256        # groups of users that share a state; fixed for the life of a checkpoint


class SessionMemory(StatefulProcessor):
    """State per bucket of users: turns that wait for the watermark, and for every user with an open session its number of turns, the
    latest one, the last turns and the event ids last discussed. A timer takes up waiting turns, in order, when the watermark has
    passed the first of them; another one forgets sessions that have been idle for too long. Users share buckets because each call
    for a key costs several trips to the state store: a user has a few turns in a micro-batch, a bucket has thousands."""

    def __init__(self, user: str, turn: StructType, turns: int, idle_seconds: int):
        self.user, self.turn, self.turns, self.idle = user, turn, turns, idle_seconds * 1_000_000
        self.whole = isinstance(turn["seq"].dataType, IntegralType)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.turn)
        last = ArrayType(StructType([self.turn["question"], self.turn["answer"]]))
        self.sessions = handle.getListState("sessions", StructType([
            self.turn["user"], StructField("turn", LongType()), StructField("latest", LongType()), StructField("recent", last), self.turn["event_ids"]]))

    def _rows(self, frame: pd.DataFrame) -> Iterator[tuple]:
        columns = {c: frame[c].tolist() for c in self.turn.names}
        if self.whole and frame["seq"].dtype.kind == "f":   # what pandas makes of whole numbers with a null
            columns["seq"] = [None if s != s else int(s) for s in columns["seq"]]
        return zip(columns["user"], map(int, columns["micros"]), columns["seq"], columns["question"], columns["answer"],
                   [None if ids is None else list(ids) for ids in columns["event_ids"]])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from self._take([r for frame in rows for r in self._rows(frame)], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._take([], timerValues.getCurrentWatermarkInMs())

    def _take(self, new: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        passed = watermark_ms * 1000
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for rows in (held, new) for r in rows if r[1] < passed), key=lambda r: (r[1], r[2] is not None, r[2]))
        later = [r for rows in (held, new) for r in rows if r[1] >= passed]
        if len(later) == len(held) + len(new):
            if new:
                self.waiting.appendList(new)
        elif later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        sessions = {r[0]: (r[1], r[2], [tuple(t) for t in r[3]], list(r[4])) for r in self.sessions.get()} if self.sessions.exists() else {}
        out = []
        for user, micros, seq, question, answer, ids in due:
            turn, latest, recent, carried = sessions.get(user, (0, None, [], []))
            if latest is not None and micros - latest > self.idle:
                turn, recent, carried = 0, [], []
            out.append((user, micros, seq, turn + 1, [{"question": q, "answer": a} for q, a in recent], carried))
            sessions[user] = (turn + 1, micros, [*recent, (question, answer)][-self.turns :], ids or carried)
        # Whatever comes later than the watermark is too late for a session whose pause has passed it.
        open_ = {user: s for user, s in sessions.items() if s[1] + self.idle >= passed}
        if open_ and (due or len(open_) < len(sessions)):
            self.sessions.put([(user, *s) for user, s in open_.items()])
        elif sessions and not open_:
            self.sessions.clear()
        if later:
            self.handle.registerTimer(min(r[1] for r in later) // 1000 + 1)
        if open_:
            self.handle.registerTimer((max(s[1] for s in open_.values()) + self.idle) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=[self.user, "micros", "seq", "turn", "recent", "carried"])

    def close(self) -> None:
        pass


def session_memory(stream: DataFrame, user: str, seq: str, question: str, answer: str, event_ids: str, ts: str = "ts", delay: str = "10 minutes",
                   turns: int = TURNS, idle_seconds: int = IDLE_SECONDS) -> DataFrame:
    """(user, ts, seq, turn, recent, carried) of every turn the watermark has passed: its number in the session, the last turns
    (question, answer) before it, and the event ids that the latest earlier turn with any was about.

    A session ends with a pause longer than idle_seconds. Turns are taken in the order of (ts, seq) whatever batch they came in,
    so results do not depend on how the input is cut; a turn later than delay is dropped by the watermark. Null or empty event
    ids leave the carried ones. Users are dealt over BUCKETS keys of state, which hold the turns of the last delay and, of every open
    session, the last few turns and one list of ids; a session goes when it has been idle. One user's turns follow each other and
    so share a task; other buckets' do not.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    named = stream.select(F.pmod(F.xxhash64(user), F.lit(BUCKETS)).cast("int").alias("bucket"), F.col(user).cast("string").alias("user"), F.col(ts).alias("ts"),
                          F.unix_micros(ts).alias("micros"), F.col(seq).alias("seq"), F.col(question).alias("question"), F.col(answer).alias("answer"),
                          F.col(event_ids).alias("event_ids"))
    turn = StructType([named.schema[c] for c in ("user", "micros", "seq", "question", "answer", "event_ids")])
    kind = lambda c: named.schema[c].dataType.simpleString()
    out = f"{user} string, micros long, seq {kind('seq')}, turn long, recent array<struct<question:string,answer:string>>, carried {kind('event_ids')}"
    found = named.withWatermark("ts", delay).groupBy("bucket").transformWithStateInPandas(
        SessionMemory(user, turn, turns, idle_seconds), out, "append", "EventTime")
    return found.select(F.col(user).cast(stream.schema[user].dataType).alias(user), F.timestamp_micros("micros").alias("ts"), "seq", "turn", "recent", "carried")
