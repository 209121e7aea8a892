"""Problem 3: conversations from message rows.

The rows are an event log.  Rows of one session and id are versions of one entry; the latest delivery holds.
Entries of a session are chained by `parent_id`; the chain gives the order (clocks tie and step back).  Along the
chain, retries of a turn are folded by `turn_id`: of several tries the last completed one with a reply stays, aborted
tries are deleted.  Sessions are then judged: `broken`, `empty`, `no_reply`, else they survive.

Whole sessions are folded in the order of a sorted shuffle by session, one session in memory at a time.  A session of
more than `LARGE` rows is never brought to one task: its versions are folded by session and id, its chain is ranked by
pointer doubling over the cluster, and its turns and positions are numbered from sums of blocks of the chain.

Results by case: a null `session_id` is no session, its rows are left out; a null `id` is an entry like any other that
nothing can follow; several rows of equal session and id are one entry (latest `received_at`, nulls first, further ties
by the other columns); a session without header is broken; a session without turns can't lack a reply; an empty log
gives no rows; further columns stay out unless asked for.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written

#: Entries up to which a session is folded in one task.
LARGE = 100_000
#: Entries of a large session that are numbered in one window.
BLOCK = 10_000

#: A letter, digit, punctuation or symbol; marks count only on a letter, which then counts itself.
VISIBLE = r"[\p{L}\p{N}\p{P}\p{S}]"


def events(log: DataFrame, text: bool = False, together: bool = True) -> DataFrame:
    """Folded entries: session_id, id, parent_id, kind, turn_id [, role, ts, text].

    together: whether the entries of a session come to lie in one partition; else they are spread by session and id.

    kind: 1 session header, 2 turn started, 3 turn completed, 4 turn aborted, 5 visible user message,
    6 visible assistant message, 0 any other entry.
    """
    visible = F.coalesce(F.col("text").rlike(VISIBLE), F.lit(False))
    kind = F.coalesce(
        F.when(F.col("type") == "session_header", 1)
        .when(F.col("type") == "turn_started", 2)
        .when(F.col("type") == "turn_completed", 3)
        .when(F.col("type") == "turn_aborted", 4)
        .when((F.col("type") == "message") & (F.col("role") == "user") & visible, 5)
        .when((F.col("type") == "message") & (F.col("role") == "assistant") & visible, 6),
        F.lit(0),
    ).cast("tinyint")
    kept = ["parent_id", kind.alias("kind"), "turn_id"]
    if text:
        kept += [F.when(F.col("type") == "message", F.col("role")).alias("role"), "ts", F.when(F.col("type") == "message", F.col("text")).alias("text")]
    rows = log.filter("session_id is not null").select("session_id", "id", F.col("received_at").alias("at"), *kept)
    rest = [c for c in rows.columns if c not in ("session_id", "id", "at")]
    # the latest version by (received_at, all columns): a total order, so that ties have one result
    latest = F.max(F.struct("at", *rest)).alias("v")
    if together:  # one shuffle by session serves the folding of versions and the walk along the chain
        rows = rows.repartition("session_id")
    return rows.groupBy("session_id", "id").agg(latest).select("session_id", "id", *[F.col(f"v.{c}").alias(c) for c in rest])


def walk(ids: list, parents: list, kinds: list) -> list[int] | None:
    """Positions of a session's entries along its one chain, or None if it is broken."""
    child: dict = {}
    start = -1
    for i, parent in enumerate(parents):
        if parent is None:
            if start >= 0 or kinds[i] != 1:
                return None
            start = i
        elif parent in child:
            return None
        else:
            child[parent] = i
    if start < 0 or kinds.count(1) != 1:
        return None
    order = [start]
    at = child.get(ids[start]) if ids[start] is not None else None
    while at is not None and len(order) <= len(ids):
        order.append(at)
        at = child.get(ids[at]) if ids[at] is not None else None
    return order if len(order) == len(ids) else None


def judge(kinds: list, turns: list) -> tuple[str | None, list[int], list[int]]:
    """For entries in chain order: the reason to drop, the number of the segment of each entry (0: outside), and
    the segments that stay."""
    segment, number, replied, opened = 0, [], False, None
    seen: dict = {}
    good: dict = {}
    count = 0
    for kind, turn in zip(kinds, turns):
        if kind in (2, 3, 4) and turn is not None:
            seen.setdefault(turn, None)
        if kind == 2:
            count += 1
            segment, opened, replied = count, turn, False
        elif kind == 6:
            replied = True
        number.append(segment)
        if kind == 3 and segment and turn == opened and turn is not None:
            if replied:
                good[turn] = segment
            segment, opened = 0, None
    if 5 not in kinds:
        return "empty", number, []
    if any(t not in good for t in seen):
        return "no_reply", number, []
    return None, number, sorted(good.values())


def _fold(columns: int):
    """One row per session with its verdict or, if columns > 0, the rows of the turns of surviving sessions."""

    def sessions(batches):
        held = []
        last = None
        for batch in batches:
            ids = batch.column(0)
            n, start = len(ids), 0
            if not n:
                continue
            # borders between sessions inside the batch
            changed = pc.not_equal(ids.slice(1), ids.slice(0, n - 1)).to_numpy(zero_copy_only=False).nonzero()[0] + 1 if n > 1 else []
            for border in [*changed, n]:
                session = ids[start].as_py()
                if held and session != last:
                    yield last, held
                    held = []
                held.append(batch.slice(start, border - start))
                last, start = session, border
        if held:
            yield last, held

    def run(batches):
        out, outs = [], 0
        for session, parts in sessions(batches):
            data = pa.Table.from_batches(parts).combine_chunks()
            ids, parents, kinds, turns = (data.column(i).to_pylist() for i in range(1, 5))
            order = walk(ids, parents, kinds)
            if order is None:
                reason, number, good = "broken", [], []
            else:
                reason, number, good = judge([kinds[i] for i in order], [turns[i] for i in order])
            if not columns:
                out.append((session, reason))
                if len(out) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], names=["session_id", "reason"])
                    out = []
                continue
            if reason is None:
                keep = set(good)
                chosen = [(k, i) for k, i in enumerate(order) if kinds[i] in (5, 6) and (number[k] in keep)]
                rows = data.take(pa.array([i for _, i in chosen], pa.int64()))
                first: dict = {}
                turn_of = {number[k]: turns[i] for k, i in enumerate(order) if kinds[i] == 2}
                numbers = [first.setdefault(number[k], len(first)) for k, _ in chosen]
                out.append(
                    pa.table(
                        [
                            rows.column(0),
                            pa.array(range(len(chosen)), pa.int64()),
                            pa.array(numbers, pa.int64()),
                            pa.array([number[k] for k, _ in chosen], pa.int64()),
                            pa.array([turn_of.get(number[k]) for k, _ in chosen], pa.string()),
                            *[rows.column(i) for i in (1, 5, 6, 7)],
                        ],
                        names=["session_id", "position", "turn_no", "segment_no", "turn_id", "id", "role", "ts", "text"],
                    )
                )
                outs += len(chosen)
                if outs >= 5_000:
                    yield from pa.concat_tables(out).combine_chunks().to_batches()
                    out, outs = [], 0
        if out and not columns:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*out)], names=["session_id", "reason"])
        elif out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return run


TURNS = "session_id string, position bigint, turn_no bigint, segment_no bigint, turn_id string, id string, role string, ts string, text string"


def _large(log: DataFrame, large: int) -> DataFrame | None:
    """The ids of sessions beyond the size for one task; None if there are none (the usual case).

    Their number is at most the rows of the log over `large`.
    """
    sizes = log.filter("session_id is not null").groupBy("session_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large).select("session_id")
    return None if sizes.isEmpty() else written(sizes, "large-sessions")


def _ranked(entries: DataFrame) -> DataFrame:
    """Entries of large sessions with `rank` (0 at the header; null if not reached), by pointer doubling.

    After round r every entry knows the entry 2^r steps towards the header, so a chain of n entries takes
    ceil(log2 n) rounds; each round's table is written to the shared folder.
    """
    keyed = written(entries, "large-entries")
    longest = keyed.groupBy("session_id").count().agg(F.max("count")).first()[0] or 0
    jumps = keyed.select("session_id", "id", F.col("parent_id").alias("to"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("bigint").alias("steps"))
    for _ in range(max(1, int(longest).bit_length())):
        ahead = jumps.select("session_id", F.col("id").alias("to"), F.col("to").alias("to2"), F.col("steps").alias("steps2"))
        jumps = written(
            jumps.join(ahead, ["session_id", "to"], "left").select(
                "session_id", "id", F.when(F.col("to").isNull(), None).when(F.col("steps2").isNull(), F.lit("\x00lost")).otherwise(F.col("to2")).alias("to"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps")
            ),
            "jumps",
        )
    rank = jumps.select("session_id", "id", F.when(F.col("to").isNull(), F.col("steps")).alias("rank"))
    return keyed.join(rank, (keyed.session_id == rank.session_id) & keyed.id.eqNullSafe(rank.id), "left").select(keyed["*"], "rank")


def _running(rows: DataFrame, order: str, counts: Column, name: str) -> DataFrame:
    """rows with `name`, how many of the rows of the session up to and with each satisfy `counts`, in order of `order`.

    The numbers come from sums of blocks of the order, so no window holds a whole session.
    """
    block = F.floor(F.col(order) / BLOCK).cast("bigint")
    sums = rows.groupBy("session_id", block.alias("block")).agg(F.count_if(counts).alias("inside"))
    earlier = Window.partitionBy("session_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("session_id", "block", F.coalesce(F.sum("inside").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("session_id", "block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("block", block).join(sums, ["session_id", "block"]).withColumn(name, F.col("before") + F.count_if(counts).over(inside)).drop("block", "before")


def _large_judged(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session_id, reason) of large sessions, and their entries with rank, segment_no and `stays`."""
    ranked = written(_ranked(entries), "ranked")
    header = (F.col("kind") == 1) & F.col("parent_id").isNull()
    chain = ranked.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("rank").alias("reached"),
        F.max("rank").alias("last"),
        F.count_if(header).alias("starts"),
        F.count_if(F.col("parent_id").isNull()).alias("roots"),
        F.count_if(F.col("kind") == 1).alias("headers"),
        F.count_if(F.col("kind") == 5).alias("asked"),
    )
    whole = (F.col("reached") == F.col("n")) & (F.col("last") == F.col("n") - 1) & (F.col("starts") == 1) & (F.col("roots") == 1) & (F.col("headers") == 1)
    # segment number: starts so far
    numbered = _running(ranked, "rank", F.col("kind") == 2, "segment_no")
    opened = numbered.filter("kind = 2").select("session_id", "segment_no", F.col("turn_id").alias("opened"))
    ended = numbered.filter("kind = 3").join(opened, ["session_id", "segment_no"]).filter("turn_id = opened").groupBy("session_id", "segment_no").agg(F.min("rank").alias("ended"))
    numbered = numbered.join(ended, ["session_id", "segment_no"], "left")
    segments = numbered.groupBy("session_id", "segment_no").agg(
        F.max(F.when(F.col("kind") == 2, F.col("turn_id"))).alias("turn"),
        F.coalesce(F.bool_or((F.col("kind") == 6) & (F.col("rank") < F.col("ended"))), F.lit(False)).alias("good"),
    )
    named = ranked.filter("kind in (2, 3, 4) and turn_id is not null").select("session_id", F.col("turn_id").alias("turn")).distinct()
    turns = named.join(segments.filter("good").groupBy("session_id", "turn").agg(F.max("segment_no").alias("best")), ["session_id", "turn"], "left")
    turns = written(turns, "large-turns")
    missing = turns.groupBy("session_id").agg(F.count_if(F.col("best").isNull()).alias("missing"))
    verdict = chain.join(missing, "session_id", "left").select(
        "session_id", F.when(~whole, "broken").when(F.col("asked") == 0, "empty").when(F.col("missing") > 0, "no_reply").alias("reason")
    )
    stays = turns.filter("best is not null").select("session_id", F.col("best").alias("segment_no"), F.col("turn").alias("turn_of"))
    return verdict, numbered.join(stays, ["session_id", "segment_no"]).filter("rank < ended and kind in (5, 6)")


def _sorted(entries: DataFrame) -> DataFrame:
    return entries.sortWithinPartitions("session_id")


def _parted(log: DataFrame, big: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """The rows of the sessions that one task can hold, and those of the large ones."""
    if big is None:
        return log, None
    return log.join(big, "session_id", "left_anti"), log.join(big, "session_id", "left_semi")


def verdicts(log: DataFrame, large: int = LARGE) -> DataFrame:
    """session_id and reason (broken, empty, no_reply; null for a session that stays) of every session."""
    small, hot = _parted(log, _large(log, large))
    found = _sorted(events(small)).mapInArrow(_fold(0), "session_id string, reason string")
    return found if hot is None else found.unionByName(_large_judged(events(hot, together=False))[0])


def conversations(log: DataFrame, segments: DataFrame | None = None, large: int = LARGE) -> DataFrame:
    """The messages of surviving sessions in order: session_id, position, turn_no, segment_no, turn_id, id, role, ts, text
    and, with `segments`, what the client saw of the segment (`snapshot_completed`, null if it saw nothing)."""
    small, hot = _parted(log, _large(log, large))
    turns = _sorted(events(small, text=True)).mapInArrow(_fold(1), TURNS)
    if hot is not None:
        verdict, kept = _large_judged(events(hot, text=True, together=False))
        kept = written(kept.join(verdict.filter("reason is null"), "session_id", "left_semi"), "large-kept")
        placed = _running(kept, "rank", F.lit(True), "position")
        starts = kept.groupBy("session_id", "segment_no").agg(F.lit(True).alias("first"))
        numbers = _running(starts, "segment_no", F.col("first"), "turn_no").select("session_id", "segment_no", "turn_no")
        turns = turns.unionByName(
            placed.join(numbers, ["session_id", "segment_no"]).select(
                "session_id", (F.col("position") - 1).alias("position"), (F.col("turn_no") - 1).alias("turn_no"), "segment_no", F.col("turn_of").alias("turn_id"), "id", "role", "ts", "text"
            )
        )
    if segments is None:
        return turns
    seen = segments.filter("session_id is not null and segment_no is not null").groupBy("session_id", "segment_no").agg(F.max_by("completed", "snapshot_at").alias("snapshot_completed"))
    return turns.join(seen, ["session_id", "segment_no"], "left")


def visible(column: Column) -> Column:
    return F.coalesce(column.rlike(VISIBLE), F.lit(False))
