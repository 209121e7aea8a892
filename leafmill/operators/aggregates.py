"""Aggregations, sorts, limits and set operations (AGG, SRT, SET)."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .windows import running_before


def total_or_zero(column: str) -> Column:
    return F.coalesce(F.sum(F.coalesce(F.col(column), F.lit(0))), F.lit(0))


def repeated(df: DataFrame, group: list[str], payload: str, ident: str, least: int) -> DataFrame:
    """Equal calls made at least `least` times (AGG3): group, payload hash, number, first call."""
    hashed = df.withColumn("payload_sha", F.sha2(payload, 256))
    return hashed.groupBy(*group, "payload_sha").agg(F.count(F.lit(1)).alias("calls"), F.min(ident).alias("first_call")).filter(F.col("calls") >= least)


def coverage(members: DataFrame, done: DataFrame, key: list[str], member: str) -> DataFrame:
    """Expected and completed members of each set, and the missing ones (AGG5)."""
    marked = members.join(done.select(*key, member).distinct().withColumn("_done", F.lit(True)), [*key, member], "left")
    out = marked.groupBy(*key).agg(
        F.count(F.lit(1)).alias("expected"), F.count("_done").alias("completed"), F.concat_ws(",", F.array_sort(F.collect_list(F.when(F.col("_done").isNull(), F.col(member).cast("string"))))).alias("missing")
    )
    return out.withColumn("status", F.when(F.col("expected") == F.col("completed"), "ok").otherwise("incomplete"))


def first_seen(df: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """Distinct values of a key in the order of their first occurrence (AGG7)."""
    return df.groupBy(*key, value).agg(F.min(order).alias("first_pos"))


def text_of(parts: str, order: str, separator: str = "") -> Column:
    """Ordered concatenation (AGG15)."""
    return F.concat_ws(separator, F.transform(F.array_sort(F.collect_list(F.struct(order, parts))), lambda x: x[parts]))


def bounding_box(x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> list[Column]:
    return [F.min(x1).alias("x1"), F.min(y1).alias("y1"), F.max(x2).alias("x2"), F.max(y2).alias("y2")]


def scores(df: DataFrame, key: list[str], verdict: str) -> DataFrame:
    """Strict, weighted and completed shares of C (correct), P (partly) and I (incorrect) among all items (AGG13)."""
    n = F.count(F.lit(1))
    c, p, i = (F.count_if(F.col(verdict) == v) for v in "CPI")
    return df.groupBy(*key).agg(n.alias("items"), F.round(c / n, 6).alias("strict"), F.round((c + 0.5 * p) / n, 6).alias("weighted"), F.round((c + p + i) / n, 6).alias("completion"))


def recall_at(ranked: DataFrame, relevant: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """Recall of each query among its first k items; queries without relevant items are left out (AGG14)."""
    hits = ranked.filter(F.col("rank") <= k).join(relevant, [query, item], "left_semi").groupBy(query).agg(F.count(F.lit(1)).alias("hits"))
    return relevant.groupBy(query).agg(F.count(F.lit(1)).alias("relevant")).join(hits, query, "left").select(query, F.coalesce("hits", F.lit(0)).alias("hits"), "relevant", F.round(F.coalesce("hits", F.lit(0)) / F.col("relevant"), 6).alias("recall"))


def tree_hash(files: DataFrame, root: str, path: str, digest: str) -> DataFrame:
    """One hash over the records `F NUL path NUL hash LF` of each tree in path order (AGG18).

    The records of a tree are read as a sorted stream into one hash, so that a tree of any size needs no memory.
    """

    def run(batches):
        last, sha, n, seen = None, None, 0, False
        for batch in batches:
            out = []
            for k, p, d in zip(*[c.to_pylist() for c in batch.columns]):
                if seen and k != last:
                    out.append((last, sha.hexdigest(), n))
                if not seen or k != last:
                    last, sha, n, seen = k, hashlib.sha256(), 0, True
                sha.update(f"F\0{p}\0{d}\n".encode())
                n += 1
            yield trees(out)
        if seen:
            yield trees([(last, sha.hexdigest(), n)])

    def trees(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["root", "tree_sha256", "files"])

    rows = files.select(F.col(root).cast("string").alias("root"), path, digest).repartition("root").sortWithinPartitions("root", path, digest)
    return rows.mapInArrow(run, "root string, tree_sha256 string, files bigint").withColumnRenamed("root", root)


def column_widths(cells: DataFrame, key: list[str], column: str, text: str, unit: int = 8, least: int = 112, most: int = 240) -> DataFrame:
    return cells.groupBy(*key, column).agg(F.least(F.greatest(unit * F.max(F.length(text)), F.lit(least)), F.lit(most)).cast("bigint").alias("width"))


def page_of(df: DataFrame, order: list[Column], limit: int) -> tuple[DataFrame, Column]:
    """The first `limit` rows and whether there are more (SRT7): one row more is fetched."""
    head = df.orderBy(*order).limit(limit + 1)
    by = Window.orderBy(*order)  # limit + 1 rows
    return head.withColumn("_n", F.row_number().over(by)).withColumn("has_more", F.max("_n").over(Window.partitionBy()) > limit).filter(F.col("_n") <= limit).drop("_n"), F.col("has_more")


def top(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("bigint")).filter(F.col("rank") <= n)


def char_budget(df: DataFrame, key: list[str], order: list[str], text: str, budget: int) -> DataFrame:
    """Lines of a page up to a number of characters, the last one cut (SRT9)."""
    placed = running_before(df, key, order, F.coalesce(F.length(text), F.lit(0)), "_before")
    return placed.filter(F.col("_before") < budget).withColumn(text, F.expr(f"substring({text}, 1, {budget} - _before)")).drop("_before")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def is_partition(parent: Column, a: Column, b: Column) -> Column:
    """Whether two arrays are disjoint and together hold the parent's members (SET2, SET3)."""
    return ~F.arrays_overlap(a, b) & (F.array_sort(F.array_union(a, b)) == F.array_sort(F.array_distinct(parent)))


def global_numbers(df: DataFrame, order: str, descending: bool = False, buckets: int = 256) -> DataFrame:
    """Adds `n`, the place of each row from 1 in the order of a unique column, without a window over everything.

    Rows are sorted into ranges; a row's number is the rows of the ranges before and its place in its own range. The
    ranges are one row each, so the counts that go to every task are few.
    """
    from pyspark.sql import Window

    key = F.desc(order) if descending else F.asc(order)
    ranged = df.repartitionByRange(buckets, key).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranges")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    return ranged.withColumn("_inside", inside).join(F.broadcast(before), "_range").withColumn("n", F.col("_before") + F.col("_inside")).drop("_range", "_inside", "_size", "_before")


def bounded_set(df: DataFrame, key: list[str], item: str, most: int) -> DataFrame:
    """The least distinct items of each key up to a bound, how many there are, and whether they are more (AGG8).

    Counted before anything is gathered, so a key of very many items brings no more than `most` of them to a row.
    """
    from pyspark.sql import Window

    items = df.filter(F.col(item).isNotNull()).select(*key, item).distinct()
    ranked = items.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(item)))
    kept = F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.col(item))))
    return ranked.groupBy(*key).agg(kept.alias("items"), F.count(F.lit(1)).alias("size"), (F.count(F.lit(1)) > most).alias("over"))


def retention_report(payloads: DataFrame, key: str, size, running, old, gone) -> DataFrame:
    """Counts and bytes of payloads by what may be done with them (AGG4)."""
    p = payloads.select(key, size.alias("_b"), running.alias("_running"), old.alias("_old"), gone.alias("_gone"))
    expired = F.col("_old") & ~F.col("_gone")
    candidate = expired & ~F.col("_running")
    total = lambda rule: F.coalesce(F.sum(F.when(rule, F.col("_b"))), F.lit(0))
    return p.groupBy(key).agg(
        F.count(F.lit(1)).alias("payloads"), total(F.lit(True)).alias("bytes"), F.count_if("_gone").alias("tombstones"), F.count_if("_running").alias("running"), total(F.col("_running")).alias("running_bytes"),
        F.count_if(expired).alias("expired"), F.count_if(candidate).alias("candidates"), total(candidate).alias("candidate_bytes"),
    )


def rollup_jobs(jobs: DataFrame, job: str, conversation: str, created: str, updated: str, question: str, chars: int = 34) -> DataFrame:
    """Jobs of each conversation in order (AGG9); a job without one is a conversation of its own."""
    first = F.struct(created, job)
    line = F.substring(F.trim(F.substring_index(F.min_by(question, F.when(F.col(question).isNotNull(), first)), "\n", 1)), 1, chars)
    return jobs.groupBy(F.coalesce(conversation, job).alias("conversation")).agg(F.transform(F.array_sort(F.collect_list(first)), lambda x: x[job]).alias("jobs"), line.alias("title"), F.max(updated).alias("updated"))


def reading_order(*columns: str) -> list:
    """Sort columns for places on a page; a missing coordinate is 0 (SRT5)."""
    return [F.coalesce(F.col(c), F.lit(0.0)) for c in columns]


def bounded_search(hits: DataFrame, order: list[str], most: int, full: bool) -> DataFrame:
    """The first hits and `truncated` (SRT6): whether the list is full, or (full=False) whether more were found."""
    found = hits.orderBy(*order).limit(most + 1)
    size = found.agg((F.count(F.lit(1)) >= most if full else F.count(F.lit(1)) > most).alias("truncated"))
    return found.orderBy(*order).limit(most).crossJoin(F.broadcast(size))  # one row


def last_rows(df: DataFrame, key: list[str], order: str, n: int) -> DataFrame:
    """The last rows of each key (SRT8)."""
    from pyspark.sql import Window

    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).filter(F.col("_n") <= n).drop("_n")
