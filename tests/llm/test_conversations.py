import random

import pytest

from leafmill.llm import conversations as C

SCHEMA = "session_id string, id string, parent_id string, ts string, type string, role string, text string, turn_id string, received_at timestamp, library_id string"


def session(name, kinds):
    """Rows of a session from (type, role, text, turn) in order."""
    out, last = [], None
    for n, (kind, role, text, turn) in enumerate([("session_header", None, None, None), *kinds]):
        out.append([name, f"{name}-{n}", last, "t", kind, role, text, turn])
        last = f"{name}-{n}"
    return out


TURN = [("turn_started", None, None, "1"), ("message", "user", "hi?", None), ("message", "assistant", "yes", None), ("turn_completed", None, None, "1")]


def cases():
    import copy

    yield "good", session("good", TURN), None
    yield "silent", session("silent", [TURN[0], ("message", "user", "​ ́", None), *TURN[2:]]), "empty"
    yield "emoji", session("emoji", [TURN[0], ("message", "user", "👍", None), *TURN[2:]]), None
    yield "open", session("open", TURN[:3]), "no_reply"
    yield "mute", session("mute", [TURN[0], TURN[1], ("message", "assistant", "\n", None), TURN[3]]), "no_reply"
    yield "retried", session("retried", [TURN[0], TURN[1], ("turn_aborted", None, None, "1"), *TURN]), None
    yield "second", session("second", [*TURN, ("turn_started", None, None, "2"), ("turn_aborted", None, None, "2")]), "no_reply"
    yield "restarted", session("restarted", [TURN[0], TURN[2], ("turn_started", None, None, "1"), TURN[1], TURN[3]]), "no_reply"
    yield "no turns", session("no turns", [("message", "user", "x", None)]), None
    rows = session("twin", TURN)
    rows[3][2] = rows[1][1]
    yield "twin", rows, "broken"
    rows = session("lost", TURN)
    rows[2][2] = "nowhere"
    yield "lost", rows, "broken"
    rows = session("loop", TURN)
    rows[1][2] = rows[4][1]
    yield "loop", rows, "broken"
    rows = session("heads", TURN)
    rows.append(["heads", "h2", rows[-1][1], "t", "session_header", None, None, None])
    yield "heads", rows, "broken"
    yield "headless", copy.deepcopy(session("headless", TURN))[1:], "broken"
    yield "only header", session("only header", []), "empty"


@pytest.fixture(scope="module")
def log(spark):
    from datetime import datetime, timedelta

    rng, rows = random.Random(2), []
    for _, session_rows, _ in cases():
        for r in session_rows:
            at = datetime(2031, 1, 1) + timedelta(seconds=rng.randint(0, 999))
            rows.append((*r, at, None))
            if rng.random() < 0.3:
                rows.append((*r, at + timedelta(days=1), "again"))
    rows.append((None, "x", None, "t", "session_header", None, None, None, datetime(2031, 1, 1), None))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


WANT = {name: reason for name, _, reason in cases()}


def test_verdicts(log):
    assert {r.session_id: r.reason for r in C.verdicts(log).collect()} == WANT


def test_large_sessions_take_the_distributed_way_to_the_same_verdicts(log):
    assert {r.session_id: r.reason for r in C.verdicts(log, large=2).collect()} == WANT


def test_conversations_are_in_order_and_the_same_both_ways(log):
    key = lambda r: (r.session_id, r.position)
    small = sorted(C.conversations(log).collect(), key=key)
    assert {r.session_id for r in small} == {n for n, w in WANT.items() if w is None} - {"no turns"}
    assert [(r.role, r.text) for r in small if r.session_id == "good"] == [("user", "hi?"), ("assistant", "yes")]
    # of two tries of a turn the completed one stays
    assert [r.segment_no for r in small if r.session_id == "retried"] == [2, 2]
    large = sorted(C.conversations(log, large=2).collect(), key=key)
    assert [r.asDict() for r in large] == [r.asDict() for r in small]


def test_snapshots_are_joined(spark, log):
    seen = spark.createDataFrame([("good", 1, None, "a"), ("good", 1, True, "b"), (None, 1, True, "c")], "session_id string, segment_no bigint, completed boolean, snapshot_at string")
    rows = [r for r in C.conversations(log, seen).collect() if r.session_id in ("good", "emoji")]
    assert {(r.session_id, r.snapshot_completed) for r in rows} == {("good", True), ("emoji", None)}


def test_empty_log(spark):
    log = spark.createDataFrame([], SCHEMA)
    assert C.verdicts(log).count() == 0 and C.conversations(log).count() == 0


def test_null_ids(spark):
    from datetime import datetime

    rows = [("s", None, None, "t", "session_header", None, None, None, datetime(2031, 1, 1), None), ("s", "a", None, "t", "message", "user", "x", None, datetime(2031, 1, 1), None)]
    assert [r.reason for r in C.verdicts(spark.createDataFrame(rows, SCHEMA)).collect()] == ["broken"]


def test_rows_of_a_large_session_are_spread(spark):
    from pyspark.sql import functions as F

    log = spark.range(20_000).select(
        F.lit("s").alias("session_id"), F.format_string("e%06d", F.col("id")).alias("id"), F.when(F.col("id") > 0, F.format_string("e%06d", F.col("id") - 1)).alias("parent_id"),
        F.when(F.col("id") == 0, "session_header").when(F.col("id") % 4 == 1, "turn_started").when(F.col("id") % 4 == 0, "turn_completed").otherwise("message").alias("type"),
        F.when(F.col("id") % 4 == 2, "user").when(F.col("id") % 4 == 3, "assistant").alias("role"), F.lit("words").alias("text"), F.when(F.col("id") > 0, F.concat(F.lit("t"), F.floor((F.col("id") - 1) / 4))).alias("turn_id"),
        F.lit("2024-01-01T00:00:00Z").alias("ts"), F.current_timestamp().alias("received_at"),
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    sizes = C.events(log, together=False).groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 3 and max(r["count"] for r in sizes) < 10_000
    assert [tuple(r) for r in C.verdicts(log, large=1000).collect()] == [("s", "no_reply")]  # the last turn is open
    whole = log.filter("id <= 'e019996'")
    assert [tuple(r) for r in C.verdicts(whole, large=1000).collect()] == [("s", None)]
    out = C.conversations(whole, large=1000).orderBy("position").collect()
    assert len(out) == 2 * 4999 and [r.position for r in out] == list(range(len(out))) and [r.turn_no for r in out] == [k // 2 for k in range(len(out))]
