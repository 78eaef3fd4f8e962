"""An outbox relayed with states: queued, sent, waiting for another attempt, dead.

The relay is a stream of what happens to messages (queued, sent, failed) and keeps the state of each message.  Messages are dealt
by hash over ``buckets``, and the states of a bucket are one value of the state store with one timer, the earliest of its
messages': a call of Python per message would cost milliseconds, a message within a call costs microseconds.  A failed
attempt waits twice as long as the one before; when event time has passed the wait, a timer asks for the next attempt.  The last
attempt's failure makes a message dead.  ``sent`` and ``dead`` are final, whatever comes after or again, so replayed batches,
repeated rows and late receipts change nothing.  Transitions are appended, and their table is the log of the relay.

    queued -> sent            a receipt
    queued -> waiting         a failure, attempts left; a timer is set
    waiting -> queued         the timer: ``retry`` asks to send again, one attempt higher
    queued, waiting -> dead   the failure of the last attempt
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRANSITION = "message string, state string, attempt int, at timestamp"
STATE = "messages string"
FINAL = ("sent", "dead")


def _step(state: str | None, attempt: int, kind: str, of: int, most: int) -> tuple[str, int] | None:
    """The state and attempt after an event ``kind`` of attempt ``of``; None if it changes nothing."""
    if state in FINAL:
        return None
    if kind == "queued":
        return ("queued", 1) if state is None else None
    if kind == "sent":
        return "sent", of
    # A failure counts once, and only if it is not of an attempt before the present one.
    if kind == "failed" and of >= attempt and not (state == "waiting" and of == attempt):
        return ("dead", of) if of >= most else ("waiting", of)
    return None


def relay(events: DataFrame, most: int = 3, wait_seconds: int = 60, late: str = "10 minutes", buckets: int = 1024) -> DataFrame:
    """Transitions (message, state, attempt, at) of a stream ``events`` (message, kind, attempt, at).

    Events of a batch are taken in the order of time; of one time, ``queued`` comes first and ``sent`` before ``failed``.  Null
    messages and unknown kinds are left out.  A call holds what a batch has for one of the ``buckets``; their number belongs to
    the checkpoint.
    """
    kinds = ["queued", "sent", "failed"]

    def update(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        # message: [state, attempt, due, timer]; the timer is later than the watermark that set it.
        known = json.loads(state.get[0]) if state.exists else {}
        watermark = state.getCurrentWatermarkMs()
        rows = []
        if not state.hasTimedOut:
            for part in parts:
                rows.extend(zip(part["us"].tolist(), part["place"].tolist(), part["of"].tolist(), part["message"].tolist()))
            rows.sort()
        out = []
        for us, place, of, message in rows:
            now, attempt, due, timer = known.get(message, (None, 0, 0, 0))
            after = _step(now, attempt, kinds[place], of, most)
            if after is not None:
                now, attempt = after
                out.append((message, now, attempt, us))
                due = us // 1000 + 1000 * wait_seconds * 2 ** (attempt - 1) if now == "waiting" else 0
            known[message] = (now, attempt, due, max(due, watermark + 1))
        here = {row[3] for row in rows}
        for message, (now, attempt, due, timer) in known.items():
            if now == "waiting" and timer < watermark and message not in here:
                out.append((message, "retry", attempt + 1, due * 1000))
                known[message] = ("queued", attempt + 1, 0, 0)
        state.update((json.dumps(known),))
        timers = [timer for now, _, _, timer in known.values() if now == "waiting"]
        if timers:
            state.setTimeoutTimestamp(max(min(timers), watermark + 1))
        if out:
            made = pd.DataFrame(out, columns=["message", "state", "attempt", "at"])
            yield made.assign(at=pd.to_datetime(made["at"], unit="us", utc=True))

    wanted = events.where(F.col("message").isNotNull() & F.col("kind").isin(*kinds) & F.col("at").isNotNull())
    timed = wanted.select(F.col("message").cast("string").alias("message"), (F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")) - 1).alias("place"), F.coalesce("attempt", F.lit(1)).cast("int").alias("of"), F.col("at").cast("timestamp").alias("at"))
    dealt = timed.withColumns({"us": F.unix_micros("at"), "bucket": F.pmod(F.xxhash64("message"), F.lit(buckets))}).withWatermark("at", late)
    return dealt.groupBy("bucket").applyInPandasWithState(update, TRANSITION, STATE, "append", "EventTimeTimeout")


def last_states(transitions: DataFrame) -> DataFrame:
    """(message, state, attempts, at) of a log of transitions: final states go before any other, then the last one counts."""
    final = F.col("state").isin(*FINAL)
    last = Window.partitionBy("message").orderBy(final.desc(), F.col("attempt").desc(), F.col("at").desc(), (F.col("state") == "retry").desc())
    ranked = transitions.withColumn("__rank", F.row_number().over(last)).where("__rank = 1")
    return ranked.select("message", "state", F.col("attempt").alias("attempts"), "at")
