"""Streaming forms of the log operators (STM1-STM12): the functions are those of batch tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.structures import patch_between


def tail(spark: SparkSession, path: str, schema, files: int = 100) -> DataFrame:
    """New rows of a log table as they are committed (STM1); the checkpoint of the query is the cursor."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def once(stream: DataFrame, key: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Each event once, although files may bring it again (STM2, STM9)."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(key)


def advancing(stream: DataFrame, key: str, seq: str) -> DataFrame:
    """Rows whose sequence number is above all seen ones of their key (STM2), with a cursor per key as state."""
    schema = stream.select(key, seq).schema

    def run(k, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # the parts of one trigger come in any order: all are held against the cursor from before it
        before = state.get[0] if state.exists else None
        top, given = before, set()
        for part in parts:
            new = part[[key, seq]].drop_duplicates(seq)
            if before is not None:
                new = new[new[seq] > before]
            new = new[~new[seq].isin(given)]
            if len(new):
                given.update(new[seq].tolist())
                top = int(new[seq].max()) if top is None else max(top, int(new[seq].max()))
                yield new.sort_values(seq)
        if top is not None:
            state.update((top,))

    return stream.select(key, seq).groupBy(key).applyInPandasWithState(run, schema, "cursor bigint", "append", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, at: str, by: list[str], size: str, late: str = "1 hour") -> DataFrame:
    """Counts by event-time window, closed by a watermark: a capability of its own."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), *by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *by, "n")


def activity_fold(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Last phase, last title, all text in order of each activity (STM5); on a stream use it in foreachBatch per closed key."""
    text = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(order, "delta"))), lambda x: x["delta"]))
    return df.groupBy(*key).agg(F.min(order).alias("first_seen"), F.max_by("phase", order).alias("phase"), F.max_by("title", F.when(F.col("title").isNotNull(), F.col(order))).alias("title"), text.alias("text"))


def last_state(events: DataFrame, key: list[str], order: str, status: str) -> DataFrame:
    """Event-sourced state: the status of the last event (STM8, STM11)."""
    return events.groupBy(*key).agg(F.max_by(status, order).alias(status), F.max(order).alias("at"))


def interrupted(jobs: DataFrame, status: str, active: list[str]) -> DataFrame:
    """Rows left active by a process that ended (STM10)."""
    return jobs.withColumn(status, F.when(F.col(status).isin(active), "interrupted").otherwise(F.col(status)))


def drained(stream: DataFrame, name: str, folder: str) -> DataFrame:
    """All that is there now, processed to the end into a table of the folder, which every executor must see."""
    target = f"{folder}/{name}"
    query = stream.writeStream.format("parquet").option("path", f"{target}/rows").option("checkpointLocation", f"{target}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{target}/rows")


def applied_once(stream: DataFrame, key: list[str], merge, folder: str) -> None:
    """Every micro-batch given to `merge(rows, batch_id)`, rows of one key once in a batch (UDF7); a restart goes on behind
    the last batch that was done."""
    run = stream.writeStream.foreachBatch(lambda rows, n: merge(rows.dropDuplicates(key), n)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()


def flush_groups(events: DataFrame, key: list[str], order: str, chars, delta, millis, most_chars: int = 96, most_millis: int = 80) -> DataFrame:
    """`flush`: which rows of a text stream leave together (STM6).

    A flush ends at a row that is no delta, when so many characters have come together, or with the first row so many
    milliseconds after the last flush. An ordered fold over sorted partitions; one flush is held at a time.
    """
    n = len(key)

    def run(batches):
        last, number, size, begun = None, 0, 0, None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            out = []
            for row in zip(*columns):
                k, (text, is_delta, at) = row[:n], row[n + 1 :]
                if k != last:
                    last, number, size, begun = k, 0, 0, None
                out.append(number)
                begun = at if begun is None else begun
                size += text or 0
                if not is_delta or size >= most_chars or at - begun >= most_millis:
                    number, size, begun = number + 1, 0, at
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n + 1)), pa.array(out, pa.int64())], names=[*key, order, "flush"])

    rows = events.select(*key, order, chars.cast("bigint").alias("_chars"), delta.alias("_delta"), millis.cast("bigint").alias("_at"))
    types = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in [*key, order])
    return rows.repartition(*key).sortWithinPartitions(*key, order).mapInArrow(run, f"{types}, flush bigint")


def changes(snapshots: DataFrame, key: list[str], order: str, state: str) -> DataFrame:
    """What is written of a sequence of snapshots (STM4): the first in full, then a merge patch where something changed."""
    before = F.lag(state).over(Window.partitionBy(*key).orderBy(order))
    rows = snapshots.withColumn("_old", before)
    return rows.select(*key, order, F.when(F.col("_old").isNull(), "full").otherwise("patch").alias("mode"), patch_between("_old", state).alias("state")).filter("state is not null")


def set_states(events: DataFrame, key: list[str], order: str) -> DataFrame:
    """State of each result set after its events, and the first ordering error (STM7).

    events: key, order, name (created, derived, evidence_recorded, completed), parent (of a derived set, in the same log).
    """
    log, ident = key[:-1], key[-1]
    made = F.col("name").isin("created", "derived")
    s = events.groupBy(*key).agg(
        F.count_if(made).alias("_made"), F.min(F.when(made, F.col(order))).alias("made_at"), F.min(F.when(~made, F.col(order))).alias("_first_use"), F.min_by("parent", F.when(made, F.col(order))).alias("parent"),
        F.min_by("name", F.when(made, F.col(order))).alias("_how"), F.count_if(F.col("name") == "evidence_recorded").alias("evidence"), F.min(F.when(F.col("name") == "evidence_recorded", F.col(order))).alias("_evidence_at"),
        F.min(F.when(F.col("name") == "completed", F.col(order))).alias("_done_at"),
    )
    parents = s.select(*log, F.col(ident).alias("parent"), F.col("made_at").alias("_parent_at"))
    s = s.join(parents, [*log, "parent"], "left")
    error = (
        F.when(F.col("_made") == 0, "unknown set")
        .when(F.col("_made") > 1, "made twice")
        .when(F.col("_first_use") < F.col("made_at"), "used before it is made")
        .when((F.col("_how") == "created") & F.col("parent").isNotNull(), "created with a parent")
        .when((F.col("_how") == "derived") & (F.col("_parent_at").isNull() | (F.col("_parent_at") >= F.col("made_at"))), "unknown parent")
        .when(F.col("_done_at") < F.coalesce("_evidence_at", F.col("_done_at") + 1), "completed before evidence")
    )
    return s.select(*key, "parent", "evidence", F.col("_done_at").isNotNull().alias("completed"), error.alias("error"))


def kept_ends(c, most: int):
    """Head and tail of the bytes of an output with the number of bytes between them (STM12)."""
    head = most // 2
    raw, size = F.encode(c, "utf-8"), F.octet_length(c)
    whole = size <= most
    return F.struct(
        F.when(whole, raw).otherwise(F.substring(raw, 1, head)).alias("head"), F.when(whole, F.encode(F.lit(""), "utf-8")).otherwise(F.substring(raw, -(most - head), most - head)).alias("tail"),
        F.when(whole, 0).otherwise(size - most).cast("bigint").alias("omitted"),
    )
