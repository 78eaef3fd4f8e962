"""The relay's states: replays, late receipts, timers, and one final state for every message."""

import datetime

import pytest

from agora.streaming import incremental, relay

EVENT = "message string, kind string, attempt int, at timestamp"
T0 = datetime.datetime(2024, 1, 1)


def at(minutes):
    return T0 + datetime.timedelta(minutes=minutes)


LOTS = [
    [("a", "queued", 1, at(0)), ("b", "queued", 1, at(0)), ("b", "failed", 1, at(1)), ("c", "queued", None, at(0)), ("d", "failed", 1, at(2)), ("d", "queued", 1, at(0)), (None, "queued", 1, at(0)), ("x", "moved", 1, at(0))],
    [("a", "sent", 1, at(3)), ("a", "failed", 1, at(4)), ("b", "failed", 1, at(1)), ("b", "failed", 2, at(5)), ("c", "sent", 1, at(3)), ("c", "sent", 1, at(3)), ("d", "failed", 2, at(6)), ("d", "failed", 3, at(7))],
    [("b", "sent", 3, at(30)), ("d", "sent", 3, at(30)), ("a", "queued", 1, at(0)), ("e", "queued", 1, at(30)), ("e", "failed", 1, at(31))],
    [("z", "queued", 1, at(300))],
    [("z", "sent", 1, at(600))],
]


@pytest.mark.parametrize("lots", [LOTS, LOTS[:3] + [LOTS[1] + LOTS[0]] + LOTS[3:], [sum(LOTS[:3], []), *LOTS[3:]]])
def test_every_message_ends_once(spark, tmp_path, lots):
    for lot in lots:
        spark.createDataFrame(lot, EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        stream = incremental.landed(spark, f"{tmp_path}/events", spark.createDataFrame([], EVENT).schema)
        incremental.run_now(relay.relay(stream, most=3, wait_seconds=60), f"{tmp_path}/checkpoint", path=f"{tmp_path}/log")
    log = spark.read.schema(relay.TRANSITION).parquet(f"{tmp_path}/log")
    rows = {}
    for r in log.collect():
        rows.setdefault(r.message, []).append((r.state, r.attempt))
    assert set(rows) == {"a", "b", "c", "d", "e", "z"}
    assert all(sum(s in relay.FINAL for s, _ in found) <= 1 for found in rows.values())
    ends = {r.message: (r.state, r.attempts) for r in relay.last_states(log).collect()}
    assert ends["a"] == ("sent", 1) and ends["b"] == ("sent", 3) and ends["c"] == ("sent", 1) and ends["d"] == ("dead", 3) and ends["z"] == ("sent", 1)
    # Nobody answered e after its failure: its timer asked for a second attempt once, when event time had passed the wait.
    assert ends["e"] == ("retry", 2) and sorted(rows["e"]) == [("queued", 1), ("retry", 2), ("waiting", 1)]


def test_steps():
    step = relay._step
    assert step(None, 0, "queued", 1, 3) == ("queued", 1) and step("queued", 1, "queued", 1, 3) is None
    assert step("queued", 1, "failed", 1, 3) == ("waiting", 1) and step("waiting", 1, "failed", 1, 3) is None and step("queued", 2, "failed", 1, 3) is None
    assert step("queued", 3, "failed", 3, 3) == ("dead", 3) and step("waiting", 2, "sent", 2, 3) == ("sent", 2)
    assert all(step(final, 2, kind, 3, 3) is None for final in relay.FINAL for kind in ("queued", "sent", "failed"))


@pytest.mark.parametrize("zone", ["UTC", "Asia/Seoul"])
def test_messages_of_one_bucket_keep_their_own_states_and_timers(spark, tmp_path, zone):
    """Python is called per bucket, not per message; timers are of event time in any zone."""
    lots = [[(f"m{i}", "failed", 1, f"2024-01-01T00:{i:02d}:00Z") for i in range(40)], [("m0", "sent", 2, "2024-01-01T00:41:00Z"), ("late", "queued", 1, "2024-01-01T00:41:00Z")], [("z", "queued", 1, "2024-01-01T00:42:00Z")]]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for lot in lots:
            spark.createDataFrame(lot, "message string, kind string, attempt int, at string").selectExpr("message", "kind", "attempt", "to_timestamp(at) AS at").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
            stream = incremental.landed(spark, f"{tmp_path}/events", spark.createDataFrame([], EVENT).schema)
            incremental.run_now(relay.relay(stream, most=3, wait_seconds=60, buckets=1), f"{tmp_path}/checkpoint", path=f"{tmp_path}/log")
        log = spark.read.schema(relay.TRANSITION).parquet(f"{tmp_path}/log").selectExpr("message", "state", "attempt", "unix_seconds(at) AS at").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    start = 1704067200
    assert sorted(r.message for r in log if r.state == "waiting") == sorted(f"m{i}" for i in range(40))
    # The watermark ends at 00:32; whose wait of a minute had passed before then is asked again, at the time it was due.
    asked = {r.message: r.at for r in log if r.state == "retry"}
    assert asked == {f"m{i}": start + 60 * (i + 1) for i in range(31) if f"m{i}" in asked} and {f"m{i}" for i in range(1, 29)} <= set(asked)
    assert all(r.attempt == 2 for r in log if r.state == "retry") and [r.state for r in log if r.message == "late"] == ["queued"]
