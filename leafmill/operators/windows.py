"""Window-shaped operators over ordered logs (WIN1-WIN20). All windows have a key; `order` is a total order inside it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def ordered_log(log: DataFrame, *columns: str) -> DataFrame:
    """One row per entry of a session log (the first delivery), with `pos` in order of arrival."""
    first = log.groupBy("session_id", "id").agg(F.min_by(F.struct(*dict.fromkeys([*columns, "received_at"])), "received_at").alias("e"))
    by = Window.partitionBy("session_id").orderBy("received_at", "id")
    return first.select("session_id", "id", "e.*").withColumn("pos", F.row_number().over(by).cast("bigint"))


def run_length(df: DataFrame, key: list[str], order: list[str], signature: str, out: str = "run") -> DataFrame:
    """Length so far of the run of equal signatures that a row is in (WIN1)."""
    by = Window.partitionBy(*key).orderBy(*order)
    new = F.coalesce((~F.col(signature).eqNullSafe(F.lag(signature).over(by))) | (F.row_number().over(by) == 1), F.lit(True))
    island = df.withColumn("_island", F.sum(new.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return island.withColumn(out, F.row_number().over(Window.partitionBy(*key, "_island").orderBy(*order)).cast("bigint")).drop("_island")


def similar_in_frame(df: DataFrame, key: list[str], order: list[str], signature: str, previous: int = 8, out: str = "similar") -> DataFrame:
    """How many of the `previous` rows before and the row itself have the row's signature (WIN2)."""
    frame = Window.partitionBy(*key).orderBy(*order).rowsBetween(-previous, 0)
    return df.withColumn(out, F.size(F.filter(F.collect_list(signature).over(frame), lambda s: s == F.col(signature))).cast("bigint"))


def turn_segments(df: DataFrame, key: list[str], order: str, start: Column, end: Column) -> DataFrame:
    """Adds `segment` (0 outside of turns), `closed` (the segment has an end) (WIN3).

    Rows before the first start, and between an end and the next start, are outside; the next start closes an open turn.
    """
    by = Window.partitionBy(*key).orderBy(order)
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    numbered = df.withColumn("_start", start.cast("int")).withColumn("_end", end.cast("int")).withColumn("_turn", F.sum("_start").over(so_far))
    inside = Window.partitionBy(*key, "_turn")
    ended = F.coalesce(F.max("_end").over(inside.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        numbered.withColumn("segment", F.when((F.col("_turn") == 0) | (ended == 1), 0).otherwise(F.col("_turn")).cast("bigint"))
        .withColumn("closed", (F.col("segment") > 0) & (F.max("_end").over(inside) == 1))
        .drop("_start", "_end", "_turn")
    )


def resumable(segmented: DataFrame, key: list[str], turn: str, current: Column) -> DataFrame:
    """Rows outside of turns, then segments whose turn is the current one or has any closed segment (WIN4)."""
    done = F.max(F.col("closed").cast("int")).over(Window.partitionBy(*key, turn)) == 1
    return segmented.withColumn("_keep", (F.col("segment") == 0) | F.coalesce(F.col(turn) == current, F.lit(False)) | done).filter("_keep").drop("_keep")


def after_last(df: DataFrame, key: list[str], order: str, reset: Column) -> DataFrame:
    """Rows after the last reset row of their key; all rows where there is none (WIN5)."""
    last = F.max(F.when(reset, F.col(order))).over(Window.partitionBy(*key))
    return df.withColumn("_last", last).filter(F.col("_last").isNull() | (F.col(order) > F.col("_last"))).drop("_last")


def regrouped(df: DataFrame, key: list[str], order: str, side: str) -> DataFrame:
    """Consecutive rows of the same side become one (WIN6): side, first position, number of rows."""
    by = Window.partitionBy(*key).orderBy(order)
    new = (F.lag(side).over(by).isNull() | (F.lag(side).over(by) != F.col(side))).cast("int")
    islands = df.withColumn("_g", F.sum(new).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*key, "_g", side).agg(F.min(order).alias("first_pos"), F.count(F.lit(1)).alias("rows")).withColumnRenamed("_g", "block")


def damage_blocks(lines: DataFrame, key: list[str], order: str, damaged: Column, barrier: Column, bridge: int = 2) -> DataFrame:
    """Runs of damaged lines that bridge at most `bridge` clean ones and no barrier line (WIN7): first, last, lines."""
    by = Window.partitionBy(*key).orderBy(order)
    marked = lines.withColumn("_d", damaged).withColumn("_walls", F.sum(barrier.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    only = marked.filter("_d")
    gap = F.col(order) - F.lag(order).over(by)
    new = gap.isNull() | (gap > bridge + 1) | (F.col("_walls") != F.lag("_walls").over(by))
    blocks = only.withColumn("_b", F.sum(new.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return blocks.groupBy(*key, "_b").agg(F.min(order).alias("first_line"), F.max(order).alias("last_line"), F.count(F.lit(1)).alias("damaged")).withColumnRenamed("_b", "block")


def visual_runs(boxes: DataFrame, key: list[str], order: list[str], gap: float = 1.75, slack: float = 2.0) -> DataFrame:
    """Runs of boxes (x1, y1, x2, y2) that follow each other closely down a page (WIN8), numbered in `run`."""
    by = Window.partitionBy(*key).orderBy(*order)
    last = {c: F.lag(c).over(by) for c in ("x1", "y1", "x2", "y2")}
    height = F.greatest(F.col("y2") - F.col("y1"), last["y2"] - last["y1"])
    follows = (F.col("y1") >= last["y1"]) & (F.col("y1") - last["y2"] <= gap * height) & (F.least("x2", last["x2"]) - F.greatest("x1", last["x1"]) >= -slack)
    return boxes.withColumn("run", F.sum((~F.coalesce(follows, F.lit(False))).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))


def resolved_sections(sections: DataFrame, total_pages: Column) -> DataFrame:
    """Sections with an inferred last page; parents directly followed by a deeper section are left out (WIN9)."""
    by = Window.partitionBy("paper_id").orderBy("ord")
    ended = sections.withColumn("last_page", F.coalesce("page_end", F.lead("page_start").over(by), total_pages)).withColumn("_next", F.lead("depth").over(by))
    return ended.filter(F.col("_next").isNull() | (F.col("_next") <= F.col("depth"))).drop("_next")


def token_windows(df: DataFrame, key: str, tokens: Column, size: int = 512, overlap: int = 64) -> DataFrame:
    """Sliding token windows (WIN10): key, ord, start, n_tokens, window text joined by blanks."""
    stride = size - overlap
    counted = df.withColumn("_t", tokens).filter(F.size("_t") > 0)
    last = F.when(F.size("_t") <= size, F.lit(0)).otherwise(F.ceil((F.size("_t") - size) / stride).cast("int") * stride)
    cut = counted.select(key, "_t", F.posexplode(F.sequence(F.lit(0), last, F.lit(stride))).alias("ord", "start"))
    part = F.slice("_t", F.col("start") + 1, size)
    return cut.select(key, F.col("ord").cast("bigint").alias("ord"), F.col("start").cast("bigint").alias("start"), F.size(part).cast("bigint").alias("n_tokens"), F.concat_ws(" ", part).alias("text"))


def offsets(df: DataFrame, key: list[str], order: str, text: str, separator: int = 1) -> DataFrame:
    """Byte range [start_offset, end_offset) of each page of a key, pages joined by `separator` bytes (WIN11)."""
    sized = df.withColumn("_size", F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint"))
    placed = running_before(sized, key, [order], F.col("_size") + separator, "start_offset")
    return placed.withColumn("end_offset", F.col("start_offset") + F.col("_size")).drop("_size")


def running_before(df: DataFrame, key: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of `value` over the rows of the key before each row, also for a key of very many rows.

    Rows are sorted into ranges of key and order together, so a large key lies in several tasks; a row's sum is that of the
    ranges of its key before and that inside its range.
    """
    ranged = written(df.withColumn("_value", value).repartitionByRange(*key, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*key, "_range").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(key)], F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("_value").over(Window.partitionBy(*key, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(key):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    joined = ranged.withColumn("_inside", inside).join(sums, same)
    return joined.withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint")).select(*df.columns, name)


def short_refs(df: DataFrame, ident: str, order: str, length: int = 8, key: list[str] | None = None) -> DataFrame:
    """Short references: the first characters, with -n from the second of equal ones on (WIN12)."""
    stem = F.substring(ident, 1, length)
    n = F.row_number().over(Window.partitionBy(*(key or []), stem).orderBy(order))
    return df.withColumn("ref", F.when(n == 1, stem).otherwise(F.concat_ws("-", stem, n.cast("string"))))


def recent_suffix(df: DataFrame, key: list[str], order: str, tokens: str, budget: int) -> DataFrame:
    """The newest rows whose tokens fit the budget together, the newest one always (WIN13)."""
    back = Window.partitionBy(*key).orderBy(F.desc(order))
    kept = df.withColumn("_sum", F.sum(tokens).over(back.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(back))
    return kept.filter((F.col("_n") == 1) | (F.col("_sum") <= budget)).drop("_sum", "_n")


def budget_stop(df: DataFrame, key: list[str], order: list[str], cost: str, most: float) -> DataFrame:
    """The first row of each key before which the summed cost has reached the limit (WIN14)."""
    by = Window.partitionBy(*key).orderBy(*order)
    spent = df.withColumn("spent_before", F.coalesce(F.sum(cost).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    reached = spent.filter(F.col("spent_before") >= most)
    return reached.withColumn("_n", F.row_number().over(by)).filter("_n = 1").drop("_n")


def next_input_estimate(df: DataFrame, key: list[str], order: str, actual: str, request: str, now: str) -> DataFrame:
    """Last actual input plus what the request has grown since (WIN15)."""
    by = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(actual, ignorenulls=True).over(by)
    at = F.last(F.when(F.col(actual).isNotNull(), F.col(request)), ignorenulls=True).over(by)
    return df.withColumn("estimate", F.coalesce(last + F.greatest(F.col(now) - at, F.lit(0)), F.col(now)))


def high_water(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    return df.withColumn("high_water", F.max(value).over(Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def sequence_gaps(df: DataFrame, key: list[str], seq: str, first: int = 1, ties: str | None = None) -> DataFrame:
    """Rows whose sequence number is not the next one (WIN17), with what was expected."""
    by = Window.partitionBy(*key).orderBy(seq, *([ties] if ties else []))
    return df.withColumn("expected", (F.row_number().over(by) + (first - 1)).cast("bigint")).filter(F.col("expected") != F.col(seq))


def attempts(df: DataFrame, key: list[str], order: list[str], most: int = 3) -> DataFrame:
    """Number of each try of a key, and whether it is refused (WIN18)."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("bigint")
    return df.withColumn("attempt_no", n).withColumn("refused", n > most)


def rates(df: DataFrame, key: list[str], order: list[str], clock: Column, value: str, expected: float = 0.0) -> DataFrame:
    """Change of a value per unit of time since the sample before, in percent, and the delay beyond `expected` (WIN19)."""
    by = Window.partitionBy(*key).orderBy(*order)
    timed = df.withColumn("_at", clock)
    wall = F.greatest(F.col("_at") - F.lag("_at").over(by), F.lit(1e-6))
    return timed.withColumn("rate", (F.col(value) - F.lag(value).over(by)) / wall * 100).withColumn("gap", F.greatest(wall - expected, F.lit(0.0))).drop("_at")


def thinned(df: DataFrame, key: str, clock: str, least: float) -> DataFrame:
    """Samples at least `least` after the last kept one (WIN20): an ordered fold in one pass over sorted partitions.

    Only the time of the last kept sample is held, so a key of any size is read as a stream.
    """

    def run(batches):
        last_key, last_kept = None, None
        for batch in batches:
            keep = []
            for i, (k, at) in enumerate(zip(batch.column(key).to_pylist(), batch.column(clock).to_pylist())):
                if k != last_key or last_kept is None or (at is not None and at - last_kept >= least):
                    keep.append(i)
                    last_key, last_kept = k, at
            yield batch.take(pa.array(keep, pa.int64()))

    return df.repartition(key).sortWithinPartitions(key, clock).mapInArrow(run, df.schema)
