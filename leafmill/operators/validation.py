"""Constraint checks as rows and columns (VAL1-VAL8, FLT10-FLT13, RET1-RET7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.structures import TOMBSTONE, tombstone_sha
from ..functions.text import canonical_sha


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds `violations`: the sorted names of the rules that a row breaks; a rule that is null is broken (VAL1, VAL7)."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in sorted(rules.items())]))
    return df.withColumn("violations", broken)


def summary(errors: Column, most: int = 5) -> Column:
    """The first errors, and how many more there are (VAL6)."""
    head = F.concat_ws("; ", F.slice(errors, 1, most))
    return F.when(F.size(errors) > most, F.concat(head, F.lit("; ... "), (F.size(errors) - most).cast("string"), F.lit(" more"))).otherwise(head)


def checked(df: DataFrame, rule: Column, message: str) -> DataFrame:
    """df; reading a row that breaks the rule fails."""
    return df.filter(F.when(F.coalesce(rule, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def trace_faults(events: DataFrame, trace: list[str], seq: str, ident: str, entity: str, parent: str, start: Column, terminal: Column) -> DataFrame:
    """Faults of traces (VAL2): gaps in the sequence, repeated ids, ends before starts, several ends, unknown parents, roots."""
    by = Window.partitionBy(*trace).orderBy(seq, ident)
    rows = events.withColumn("_gap", F.row_number().over(by) != F.col(seq)).withColumn("_twice", F.count(F.lit(1)).over(Window.partitionBy(*trace, ident)) > 1)
    per_row = rows.groupBy(*trace).agg(F.count_if("_gap").alias("gaps"), F.count_if("_twice").alias("repeated_ids"))
    spans = events.groupBy(*trace, entity).agg(F.min(F.when(start, F.col(seq))).alias("s"), F.min(F.when(terminal, F.col(seq))).alias("e"), F.count_if(start).alias("ns"), F.count_if(terminal).alias("ne"), F.first(F.when(start, F.col(parent)), ignorenulls=True).alias("p"))
    known = spans.select(*trace, F.col(entity).alias("p"), F.col("s").alias("ps"))
    with_parent = spans.join(known, [*trace, "p"], "left")
    faults = with_parent.groupBy(*trace).agg(
        F.count_if(F.col("ns") != 1).alias("bad_starts"), F.count_if(F.col("ne") > 1).alias("several_ends"), F.count_if(F.col("e") < F.col("s")).alias("ends_before_start"),
        F.count_if(F.col("p").isNotNull() & (F.col("ps").isNull() | (F.col("ps") >= F.col("s")))).alias("unknown_parents"), F.count_if(F.col("p").isNull()).alias("roots"),
    )
    return per_row.join(faults, trace)


def balanced_rounds(df: DataFrame, key: list[str], order: str, role: str, calls: str, results: str) -> DataFrame:
    """Rounds of calls and the next row's results: whether roles alternate and ids agree (VAL5)."""
    by = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("alternates", F.coalesce(F.lag(role).over(by) != F.col(role), F.lit(True))).withColumn("ids_agree", F.coalesce((F.size(calls) > 0) & (F.array_sort(calls) == F.array_sort(F.lead(results).over(by))), F.lit(False)))


def safe_path(c: Column) -> Column:
    """Relative, without parent steps and NUL (FLT11)."""
    return ~c.startswith("/") & ~F.array_contains(F.split(c, "/"), "..") & ~c.contains("\x00") & (c != "")


def first_usable(df: DataFrame, key: list[str], usable: Column, rank: str, value: str) -> DataFrame:
    """The best-ranked usable candidate of each key (FLT13)."""
    return df.groupBy(*key).agg(F.min_by(F.when(usable, F.col(value)), F.when(usable, F.col(rank))).alias(value))


def artifact_faults(files: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Listed artifacts that are missing or differ in size or hash (VAL8). files: key, size, sha256."""
    got = files.select(key, F.col("size").alias("_size"), F.col("sha256").alias("_sha"))
    why = F.when(F.col("_sha").isNull(), "missing").when(F.col("_size") != F.col("size"), "size").when(F.col("_sha") != F.col("sha256"), "hash")
    return manifest.join(got, key, "left").withColumn("fault", why).filter("fault is not null").drop("_size", "_sha")


def cache_state(wanted: DataFrame, manifests: DataFrame, files: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """miss, incompatible, corrupt or hit for each wanted key, tested in this order (RET4)."""
    m = manifests.select(key, F.col(fingerprint).alias("_fp"), F.col("sha256").alias("_want"))
    f = files.select(key, F.col("sha256").alias("_have"))
    state = F.when(F.col("_want").isNull(), "miss").when(F.col("_fp") != F.col(fingerprint), "incompatible").when(~F.col("_want").eqNullSafe(F.col("_have")), "corrupt").otherwise("hit")
    return wanted.join(m, key, "left").join(f, key, "left").withColumn("state", state).drop("_fp", "_want", "_have")


def retention(payloads: DataFrame, at: str, running: Column, tombstoned: Column, now: Column, days: int) -> DataFrame:
    """Adds `candidate`: expired, not running, not yet removed (RET1)."""
    old = F.col(at) <= now - F.make_dt_interval(days=F.lit(days))
    return payloads.withColumn("candidate", old & ~F.coalesce(running, F.lit(False)) & ~F.coalesce(tombstoned, F.lit(False)))


def removed(payloads: DataFrame, scan: DataFrame, key: list[str], payload: str, at: Column, policy: str = "full") -> DataFrame:
    """Payloads of a scan replaced by tombstones, `released` the bytes saved, at least 0, and `fault` (RET2).

    scan: key, original_file_sha256, original_value_sha256 of each candidate as they were found. What the payload is now is
    checked against both before it is replaced; a payload that changed since, or is a tombstone already, stays and has a
    fault (`changed`, `removed`).
    """
    found = payloads.join(scan.select(*key, F.col("original_file_sha256").alias("_file"), F.col("original_value_sha256").alias("_value")), key, "left")
    value = canonical_sha(F.col(payload))
    fault = F.when(F.col("_file").isNull(), None).when(tombstone_sha(F.col(payload)).isNotNull(), "removed").when(~((F.sha2(payload, 256) == F.col("_file")) & value.eqNullSafe(F.col("_value"))), "changed")
    stone = F.to_json(
        F.struct(
            F.lit(TOMBSTONE).alias("_trace_value"), F.lit("retention").alias("reason"), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ssXXX").alias("removed_at"), F.lit(policy).alias("payload_policy"),
            F.octet_length(payload).alias("original_bytes"), F.col("_file").alias("original_file_sha256"), F.col("_value").alias("original_value_sha256"),
        )
    )
    found = found.withColumn("fault", fault).withColumn("_stone", F.when(F.col("_file").isNotNull() & F.col("fault").isNull(), stone))
    released = F.coalesce(F.greatest(F.octet_length(payload) - F.octet_length("_stone"), F.lit(0)), F.lit(0))
    return found.withColumn("released", F.when(F.col("_stone").isNotNull(), released).otherwise(0)).withColumn(payload, F.coalesce("_stone", F.col(payload))).drop("_file", "_value", "_stone")


def set_faults(sets: DataFrame, key: list[str]) -> DataFrame:
    """The first fault of each set of members and exclusions (VAL3), null for none. sets: key, members, excluded, parent
    (its parent's members, null for a set of its own), reason; all arrays of ids."""
    size = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>")))
    none = F.array().cast("array<string>")
    m, x = F.coalesce("members", none), F.coalesce("excluded", none)
    fault = (
        F.when(F.size(F.array_distinct(m)) < F.size(m), "members repeat")
        .when(F.size(F.array_distinct(x)) < F.size(x), "exclusions repeat")
        .when(F.exists(x, lambda i: ~F.coalesce(i.rlike("^[0-9a-f]{64}$"), F.lit(False))), "invalid exclusion")
        .when(F.col("parent").isNull() & ((size("excluded") > 0) | F.col("reason").isNotNull()), "exclusions without a parent")
        .when(F.col("parent").isNotNull() & F.arrays_overlap(m, x), "members are excluded")
        .when(F.col("parent").isNotNull() & (F.array_sort(F.array_union(m, x)) != F.array_sort(F.array_distinct("parent"))), "no partition of the parent")
        .when(F.col("parent").isNotNull() & (F.size(x) > 0) & F.col("reason").isNull(), "exclusions without a reason")
    )
    return sets.select(*key, fault.alias("fault"))


def runtime_context(c: Column) -> Column:
    """Whether a text block is context that the program put in, not words of a user (FLT10)."""
    end = F.regexp_replace(c, r"\s+$", "")
    return F.coalesce((c.startswith("<runtime_context>\n") & end.endswith("</runtime_context>")) | (c.startswith('<world_state mode="') & end.endswith("</world_state>")), F.lit(False))


def exposed(tools: DataFrame, planning: bool, reading: bool) -> DataFrame:
    """Tools that may be offered (FLT12). tools: four flags `enabled`, `internal`, `writes`, `needs_library`."""
    rule = F.col("enabled") & ~F.col("internal") & (~F.col("writes") | F.lit(not planning)) & (~F.col("needs_library") | F.lit(reading))
    return tools.filter(F.coalesce(rule, F.lit(False)))


def deleted_by_source(entries: DataFrame, gone: DataFrame, locator: str, fingerprint: str) -> DataFrame:
    """Cache entries that stay when all of a source's entries of one extractor are deleted (RET5)."""
    return entries.join(gone.select(locator, fingerprint).distinct(), [locator, fingerprint], "left_anti")


def reusable(directories: DataFrame, wanted: DataFrame, key: str, tree_sha: str, path: str) -> DataFrame:
    """The first directory in order of path with the wanted content, for each wanted key (RET7)."""
    return wanted.join(directories.groupBy(tree_sha).agg(F.min(path).alias(path)), tree_sha, "left").select(key, path)


def without_active(jobs: DataFrame, sessions: DataFrame, key: str, active: Column) -> DataFrame:
    """Sessions of conversations none of whose jobs is active: those may be deleted (RET6)."""
    return sessions.join(jobs.filter(active).select(key).distinct(), key, "left_anti")


def kept_revisions(revisions: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Adds `keep`: the latest revision of each key (SNK5)."""
    by = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    return revisions.withColumn("keep", F.row_number().over(by) == 1)
