"""Join-shaped operators (JN1-JN22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written, written_and_counted

#: Rows of a rule table up to which it is broadcast; beyond, the join is left to the optimizer.
SMALL = 10_000


def small(df: DataFrame, bound: int = SMALL) -> DataFrame:
    """df, marked for broadcast if it has at most `bound` rows; only that many are counted."""
    return F.broadcast(df) if df.limit(bound + 1).count() <= bound else df


def spans(events: DataFrame, key: list[str], start: Column, end: Column, at: str) -> DataFrame:
    """Start and end event of each entity in one aggregation instead of a self join (JN1)."""
    return events.groupBy(*key).agg(F.min(F.when(start, F.col(at))).alias("started"), F.max(F.when(end, F.col(at))).alias("ended"), F.count_if(start).alias("starts"), F.count_if(end).alias("ends"))


def paired_results(uses: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Every use with its result; a missing one is an aborted error (JN2)."""
    first = results.groupBy(*key).agg(F.min_by(F.struct("output", "is_error"), "pos").alias("r"))
    joined = uses.join(first, key, "left")
    return joined.withColumn("output", F.when(F.col("r").isNull(), "aborted").otherwise(F.col("r.output"))).withColumn("is_error", F.when(F.col("r").isNull(), True).otherwise(F.col("r.is_error"))).withColumn("paired", F.col("r").isNotNull()).drop("r")


def by_alias(requested: DataFrame, files: DataFrame, ident: str, aliases: list[str]) -> DataFrame:
    """Requests that match a short or a full id (JN4): ident, n_files, path of the one match."""
    names = files.select("path", F.explode(F.array_distinct(F.array(*aliases))).alias(ident)).filter(F.col(ident).isNotNull())
    return requested.join(names, ident, "left").groupBy(ident).agg(F.count("path").alias("n_files"), F.min("path").alias("path"))


def missing(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Expected rows without a found one, compared without case and outer white space (JN5, JN7); repeated rows all count."""
    plain = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    left = expected.withColumns({f"_k{i}": plain(k) for i, k in enumerate(key)})
    right = found.select(*[plain(k).alias(f"_k{i}") for i, k in enumerate(key)]).distinct()
    names = [f"_k{i}" for i in range(len(key))]
    return left.join(right, names, "left_anti").drop(*names)


def orphans(cached: DataFrame, live: DataFrame, key: str, failures: int) -> DataFrame:
    """Cached keys with no live file; none after a partial scan (JN6)."""
    return cached.join(live, key, "left_anti") if failures == 0 else cached.limit(0)


def partition_of(parent: DataFrame, key: str, include: DataFrame | None, exclude: DataFrame | None) -> DataFrame:
    """parent with `included`; the side that is not given is the complement of the other (JN8)."""
    if include is not None:
        marks = include.select(key).distinct().withColumn("included", F.lit(True))
        return parent.join(marks, key, "left").withColumn("included", F.coalesce("included", F.lit(False)))
    if exclude is not None:
        marks = exclude.select(key).distinct().withColumn("included", F.lit(False))
        return parent.join(marks, key, "left").withColumn("included", F.coalesce("included", F.lit(True)))
    return parent.withColumn("included", F.lit(True))


def by_prefix(df: DataFrame, value: str, rules: DataFrame, prefix: str = "prefix", rank: str = "rank") -> DataFrame:
    """Each row with the first rule (by rank) whose prefix its value begins with; null without one (JN9).

    The rules are matched once per distinct value, not per row.
    """
    values = df.select(value).distinct()
    met = values.join(small(rules), F.col(value).startswith(F.col(prefix)), "left")
    best = met.groupBy(value).agg(F.min_by(F.struct(*rules.columns), rank).alias("rule"))
    return df.join(best, value, "left")


def in_range(points: DataFrame, ranges: DataFrame, key: str, point: str, low: str, high: str) -> DataFrame:
    """Points inside [low, high] of the same key (JN10): the key is the equi join, the range a residual condition."""
    return points.join(ranges, key).filter(F.col(point).between(F.col(low), F.col(high)))


def as_of_previous(df: DataFrame, key: list[str], order: list[str], wanted: Column, value: Column) -> DataFrame:
    """The value of the latest wanted row before each row (JN11)."""
    by = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("previous", F.last(F.when(wanted, value), ignorenulls=True).over(by))


def latest(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The columns of the last row of each key (JN12, AGG6)."""
    return df.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_l")).select(*key, "_l.*")


def overlapping(boxes: DataFrame, regions: DataFrame, key: list[str]) -> DataFrame:
    """Boxes that cut regions of the same page (JN13). regions: region, rx1, ry1, rx2, ry2."""
    cut = (F.col("x1") < F.col("rx2")) & (F.col("rx1") < F.col("x2")) & (F.col("y1") < F.col("ry2")) & (F.col("ry1") < F.col("y2"))
    return boxes.join(regions, key).filter(cut)


def best_overlap(boxes: DataFrame, regions: DataFrame, key: list[str], line: str) -> DataFrame:
    """For each region the line with the largest common area, the first of equals (JN14)."""
    area = (F.least("x2", "rx2") - F.greatest("x1", "rx1")) * (F.least("y2", "ry2") - F.greatest("y1", "ry1"))
    met = overlapping(boxes, regions, key).withColumn("area", area)
    return met.groupBy(*key, "region").agg(F.max("area").alias("area"), F.max_by(line, F.struct(F.col("area"), (-F.col(line)).alias("n"))).alias(line))


def unknown_parents(df: DataFrame, key: list[str], ident: str, parent: str, order: str) -> DataFrame:
    """Rows whose parent did not come earlier (JN15)."""
    earlier = df.groupBy(*key, F.col(ident).alias(parent)).agg(F.min(order).alias("_first"))
    return df.filter(F.col(parent).isNotNull()).join(earlier, [*key, parent], "left").filter(F.col("_first").isNull() | (F.col("_first") >= F.col(order))).drop("_first")


def closure(spark, links: DataFrame, source: str, target: str, starts: DataFrame) -> DataFrame:
    """Everything reachable from the starts, with the least number of steps (JN21); cycles end by themselves.

    A frontier at a time, until it is empty; what was reached is anti-joined, so every node is expanded once. A frontier
    is a table in the shared folder, so a plan does not grow with the number of steps and survives a lost executor.
    """
    edges = written(links.select(F.col(source).alias("_s"), F.col(target).alias("_t")).filter("_s is not null and _t is not null").distinct(), "edges")
    seen = starts.select(F.col(starts.columns[0]).alias("node"), F.lit(0).cast("bigint").alias("steps"))
    frontier = seen
    step = 0
    while True:
        step += 1
        reached = frontier.join(edges, frontier.node == edges["_s"]).select(F.col("_t").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier, found = written_and_counted(reached.withColumn("steps", F.lit(step).cast("bigint")), "frontier")
        if not found:
            return seen
        seen = seen.unionByName(frontier)


def inherited(spark, sessions: DataFrame, session: str, base: str) -> DataFrame:
    """Which sessions a session takes its rows from, farthest first, and what is wrong with its chain (JN16).

    sessions: a row for each recovery base of a session (base null: none). Gives session, source, depth (0: itself, the
    largest first in reading order) and error: `several bases`, `unavailable` or `cycle`. Every session has one base at
    most, so the chains are followed by pointer doubling: a chain of n sessions takes log2(n) joins.
    """
    one = sessions.groupBy(session).agg(F.count(base).alias("_n"), F.min(base).alias("_base"))
    known = one.select(F.col(session).alias("_base"), F.lit(True).alias("_known"))
    one = written(one.join(known, "_base", "left").select(F.col(session).alias("s"), "_n", "_base", F.coalesce("_known", F.lit(False)).alias("_known")), "bases")
    bad = F.when(F.col("_n") > 1, "several bases").when(F.col("_base").isNotNull() & ~F.col("_known"), "unavailable")
    fault = one.select(F.col("s").alias("source"), bad.alias("error"))
    # jumps of 2^k sessions and everything within 2^k steps
    jump = one.filter("_n = 1 and _known").select("s", F.col("_base").alias("t"))
    reach = written(one.select("s", F.col("s").alias("source"), F.lit(0).cast("bigint").alias("depth")), "reach")
    step, count = 1, one.count()
    while step <= count:
        jump, left = written_and_counted(jump, "jumps")
        if not left:
            break
        farther = jump.join(reach.toDF("t", "source", "depth"), "t").select("s", "source", (F.col("depth") + step).alias("depth"))
        reach = written(reach.unionByName(farther), "reach")
        jump = jump.join(jump.toDF("t", "u"), "t").select("s", F.col("u").alias("t"))
        step *= 2
    looped = reach.filter("depth > 0 and s = source").select("s").distinct().withColumn("_cycle", F.lit(True))
    # a session that reaches a cycle has one in its chain, too
    cyclic = reach.join(looped.withColumnRenamed("s", "source"), "source").groupBy("s").agg(F.lit("cycle").alias("_cycle"))
    first = reach.join(fault, "source").filter("error is not null").groupBy("s").agg(F.min_by("error", "depth").alias("_error"))
    rows = reach.groupBy("s", "source").agg(F.min("depth").alias("depth"))
    return rows.join(cyclic, "s", "left").join(first, "s", "left").select(F.col("s").alias(session), "source", "depth", F.coalesce("_cycle", "_error").alias("error"))


def retained(ids: DataFrame, snapshots: DataFrame, key: str, order: str) -> DataFrame:
    """Snapshots of the retained ids in the order of those (JN3)."""
    return ids.join(snapshots, key).select(*ids.columns, *[c for c in snapshots.columns if c not in ids.columns])


def by_locator(paths: DataFrame, manifest: DataFrame, path: str, locator: str, order: str, value: str, prefix: str = "library/") -> DataFrame:
    """The first manifest row of each path, a leading `library/` of the locator set aside (JN18)."""
    plain = lambda c: F.when(F.col(c).startswith(prefix), F.substring(F.col(c), len(prefix) + 1, 1 << 30)).otherwise(F.col(c))
    rows = manifest.groupBy(plain(locator).alias("_at")).agg(F.min_by(value, order).alias(value))
    return paths.withColumn("_at", plain(path)).join(rows, "_at", "left").drop("_at")


def overlapping_paths(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of paths of which one is the other or lies above it (JN17), as equi joins on all ancestors."""
    above = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda n: F.concat_ws("/", F.slice(F.split(c, "/"), 1, n)))
    up_left = left.select(a, F.explode(above(F.col(a))).alias("_up"))
    up_right = right.select(b, F.explode(above(F.col(b))).alias("_up"))
    one = up_left.join(right.withColumn("_up", F.col(b)), "_up").select(a, b)
    two = up_right.join(left.withColumn("_up", F.col(a)), "_up").select(a, b)
    return one.unionByName(two).distinct()


def stale(snapshot: DataFrame, current: DataFrame, key: str, ref: str) -> DataFrame:
    """Members of a snapshot that are gone, ambiguous or changed (JN19)."""
    now = current.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(ref).alias("_ref"))
    return snapshot.join(now, key, "left").filter(~(F.coalesce(F.col("_n") == 1, F.lit(False)) & F.col(ref).eqNullSafe(F.col("_ref")))).drop("_n", "_ref")


def line_hits(pages: DataFrame, key: list[str], text: str, needle: str, width: int = 500) -> DataFrame:
    """Lines that hold a needle, with or without its white space (JN20): key, line_no, line (cut to `width`)."""
    lines = pages.filter(F.lower(F.regexp_replace(text, r"\s+", "")).contains(needle.lower().replace(" ", "")))
    rows = lines.select(*key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    spaced = F.regexp_replace(F.lower("line"), r"\s+", " ")
    hit = spaced.contains(" ".join(needle.lower().split())) | F.regexp_replace(F.lower("line"), r"\s+", "").contains("".join(needle.lower().split()))
    return rows.filter(hit).select(*key, F.col("line_no").cast("bigint").alias("line_no"), F.substring("line", 1, width).alias("line"))


def cited_pages(links: DataFrame, url: str, locators: DataFrame, ref: str) -> DataFrame:
    """Citation links with a known reference and a page above zero (JN22)."""
    q = links.withColumn(ref, F.parse_url(F.col(url), F.lit("QUERY"), F.lit("ref"))).withColumn("page", F.expr(f"try_cast(parse_url({url}, 'QUERY', 'page') AS BIGINT)"))
    return q.filter("page > 0").join(locators, ref)


def without(df: DataFrame, *columns: str) -> DataFrame:
    """df without identity columns (PRJ3)."""
    return df.drop(*columns)


def orphans_of(keys: DataFrame, live: DataFrame, key: str, failures: DataFrame) -> DataFrame:
    """Cache keys without a live source (JN6); none at all if the scan of the sources had failures. failures: one row."""
    return keys.join(live.select(key).distinct(), key, "left_anti").crossJoin(F.broadcast(failures)).filter("failures = 0").drop("failures")
