"""Log files as tables, and tables as files (SRC1-SRC21, SNK1-SNK12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

COMMON = "id string, ts string, type string, parent_id string"
#: Columns of the row kinds of a session log beside the common ones.
KINDS = {
    "session_header": "paper_id string, cwd string, model string, agent string",
    "system_message": "text string",
    "message": "role string, text string",
    "reasoning": "text string",
    "tool_use": "tool_use_id string, name string, input variant",
    "tool_result": "tool_use_id string, output string, is_error boolean",
    "llm_call": "agent string, model string, input_tokens bigint, output_tokens bigint, latency_ms bigint, stop_reason string",
    "application_event": "namespace string, name string, payload variant",
    "turn_started": "turn_id string, job_id string, attempt bigint",
    "turn_completed": "turn_id string, job_id string, attempt bigint",
    "turn_aborted": "reason string, turn_id string, job_id string, attempt bigint",
    "world_state": "mode string, state variant, rendered string, model_visible boolean",
}


def complete_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line) of the lines of log files that end with a line feed (SRC1, RET3).

    The text after the last line feed of a file is a write that did not finish and is left out, and only that: what is
    wrong elsewhere has to be seen.  The lines are read in splits; a file whose last line has no line feed is one byte
    longer in lines than in bytes.
    """
    lines = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).text(path)
    rows = lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("_size"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line")
    )
    by = Window.partitionBy("path").orderBy("_block", "_id")
    read = F.sum(F.octet_length("line").cast("bigint") + 1).over(by.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("line_no", F.row_number().over(by) - 1).withColumn("_torn", read > F.col("_size"))
    return rows.filter(~F.col("_torn") & (F.trim("line") != "")).select("path", "line_no", "line")


def parsed(lines: DataFrame, kind: str | None = None) -> DataFrame:
    """Typed rows of one kind of a session log; a line that is no JSON object of its kind fails the query."""
    schema = f"{COMMON}, {KINDS[kind]}" if kind else COMMON
    row = F.from_json("line", schema, {"mode": "FAILFAST"})
    head = lines.withColumn("_type", F.get_json_object("line", "$.type"))
    known = F.when(F.col("_type").isNull(), F.raise_error(F.concat(F.lit("not a log row: "), F.col("path"), F.lit(":"), F.col("line_no").cast("string"))).cast("boolean")).otherwise(F.lit(True))
    rows = head.filter(known)
    if kind:
        rows = rows.filter(F.col("_type") == kind)
    return rows.select("path", "line_no", row.alias("r")).select("path", "line_no", "r.*")


def json_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document per file (SRC4, SRC5, SRC18)."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def inventory(spark: SparkSession, path: str, suffix: str = ".pdf") -> DataFrame:
    """Regular files with a suffix in any case: path, size, modified, sha256, short id; in order of path components (SRC7, HSH1)."""
    glob = "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.split("path", "/").alias("parts"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), F.substring(F.sha1("content"), 1, 12).alias("short_id"))


def listed(files: DataFrame, limit: int) -> DataFrame:
    """The first files in order of path components, without hidden ones and trash, and whether the limit was reached (SRC8)."""
    visible = files.filter(~F.exists("parts", lambda p: p.startswith(".") & (p != ".")))
    first = visible.orderBy("parts").limit(limit)
    return first.crossJoin(F.broadcast(first.agg((F.count(F.lit(1)) >= limit).alias("limit_reached"))))  # one row


def manifest(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Header and paper rows of a manifest (SRC9); a broken row makes both empty."""
    v = lines.withColumn("v", F.try_parse_json("line")).withColumn("kind", F.try_variant_get("v", "$.record_type", "string"))
    broken = v.groupBy("path").agg(F.count_if(F.col("kind").isNull()).alias("bad")).filter("bad > 0").select("path")
    good = v.join(broken, "path", "left_anti")
    return good.filter("kind = 'header'"), good.filter("kind = 'paper'")


def typed(lines: DataFrame, schema: T.StructType | str) -> DataFrame:
    """Rows of one kind from JSON lines (SRC2, SRC11); a line that does not fit fails the query."""
    return lines.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def present(spark: SparkSession, paths: list[str], schema: T.StructType | str) -> DataFrame:
    """Rows of the log files or folders that exist; a missing one is empty (SRC3)."""
    there = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            there.append(path)
    tables = [typed(complete_lines(spark, path), schema) for path in there]
    out = spark.createDataFrame([], schema)
    for one in tables:
        out = out.unionByName(one)
    return out


def payload_lookup(refs: DataFrame, payloads: DataFrame, ident: str, value: str) -> DataFrame:
    """The payload of each reference, and why there is none (SRC6). payloads: ident, own_id (as its file says), value."""
    given = payloads.withColumn("_there", F.lit(True))
    fault = F.when(~F.coalesce(F.col(ident).rlike("^[A-Za-z0-9_-]{1,64}$"), F.lit(False)), "bad id").when(F.col("_there").isNull(), "missing").when(~F.col("own_id").eqNullSafe(F.col(ident)), "id differs").when(F.col(value).isNull(), "no value")
    return refs.join(given, ident, "left").withColumn("fault", fault).drop("_there")


def byte_range(c: Column, start: Column, end: Column) -> Column:
    """Bytes from `start` up to `end`, counted from 0, of a text in UTF-8 (SRC10)."""
    return F.substring(F.encode(c, "utf-8"), start + 1, end - start)


def front_matter(pages: DataFrame, key: list[str], outlined: str, few: int = 3, many: int = 8) -> DataFrame:
    """The first pages of each document, fewer if it has an outline, each behind a marker line (SRC12)."""
    inside = pages.filter(F.col("page") <= F.when(F.col(outlined), few).otherwise(many))
    marked = F.concat(F.lit("--- page "), F.col("page").cast("string"), F.lit(" ---\n"), F.col("text"))
    return page_range(inside.withColumn("text", marked), key, F.lit(1), F.lit(many))


def glyph_lines(glyphs: DataFrame, key: list[str]) -> DataFrame:
    """Lines of a page from its glyphs (SRC14): text in order, and the box around them. glyphs: key, pos, char, x1, y1, x2, y2."""
    text = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("pos", "char"))), lambda g: g["char"]))
    return glyphs.groupBy(*key).agg(text.alias("text"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def suite(spark: SparkSession, text: str, schema: str) -> DataFrame:
    """Cases of a small suite file (SRC17): YAML where its reader is installed, else JSON, which is YAML too."""
    import json

    try:
        from yaml import safe_load as load
    except ImportError:
        load = json.loads
    return spark.createDataFrame([tuple(c.get(f.split()[0]) for f in schema.split(", ")) for c in load(text)["cases"]], schema)


def reports(files: DataFrame, sessions: DataFrame, key: str, modified: str, limit: int = 20) -> DataFrame:
    """The latest reports with what the session beside each says (SRC19, SRT2)."""
    latest = files.orderBy(F.desc(modified), key).limit(limit)
    return latest.join(sessions, key, "left")


def page_range(pages: DataFrame, key: list[str], first: Column, last: Column, separator: str = "\n\n") -> DataFrame:
    """Text of an inclusive range of pages in order (SRC12, SRC13)."""
    inside = pages.filter(F.col("page").between(first, last))
    return inside.groupBy(*key).agg(F.concat_ws(separator, F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"])).alias("text"))


def pages_of(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """Pages of layout text, which form feeds part (SRC15)."""
    return texts.select(*key, F.posexplode(F.split(F.regexp_replace(text, "\f$", ""), "\f")).alias("_n", "text")).withColumn("page", (F.col("_n") + 1).cast("bigint")).drop("_n")


def sse(lines: DataFrame, line: str = "line") -> DataFrame:
    """JSON documents of a stream of server-sent events (SRC16, SRC21); the end mark and comments are left out."""
    data = lines.filter(F.col(line).startswith("data:")).withColumn("data", F.trim(F.substring(line, 6, 1 << 30)))
    return data.filter("data <> '[DONE]' and data <> ''").withColumn("document", F.parse_json("data"))


def synthetic_events(spark: SparkSession, reasoning: int, deltas: int) -> DataFrame:
    """A deterministic event log of a job: lifecycle rows around reasoning rows and answer deltas (SRC20)."""
    total = reasoning + deltas + 18
    n = F.col("id")
    kind = F.when(n < 9, "lifecycle").when(n < 9 + reasoning, "reasoning").when(n < 9 + reasoning + deltas, "delta").otherwise("lifecycle")
    return spark.range(total).select((n + 1).alias("seq"), kind.alias("kind"), F.when(kind == "delta", F.concat(F.lit("d"), (n % 97).cast("string"))).alias("text"))


def append(df: DataFrame, path: str) -> None:
    """Rows added to a log table (SNK1-SNK3, SNK8); a commit is atomic, so no row can be torn."""
    df.write.mode("append").json(path)


def numbered(existing: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """New rows with `seq` going on densely behind the existing ones of their key (SNK2, SNK3)."""
    last = existing.groupBy(*key).agg(F.max("seq").alias("_last"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return new.join(last, key, "left").withColumn("seq", (F.coalesce("_last", F.lit(0)) + place).cast("bigint")).drop("_last")


def bound_patches(notes: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """What becomes of notes by patches that are bound to the hash of the text they were made from (SNK9).

    notes: key, text. patches: key, made_from, new_text. A patch of another text is a conflict and changes nothing.
    """
    rows = patches.join(notes, key)
    fits = F.sha2("text", 256) == F.col("made_from")
    return rows.withColumn("status", F.when(fits, "applied").otherwise("conflict")).withColumn("text", F.when(fits, F.col("new_text")).otherwise(F.col("text")))


def linked_at(links: DataFrame, at: Column) -> DataFrame:
    """Edges to append, with one time for all of a call (SNK8); nothing for nothing."""
    return links.withColumn("linked_at", at)


def manifest_of(lines: DataFrame, key: list[str], line: str) -> DataFrame:
    """The text of a manifest under the name of its content (SNK6): lines in order, name from the hash."""
    text = F.concat(F.concat_ws("\n", F.array_sort(F.collect_list(line))), F.lit("\n"))
    m = lines.groupBy(*key).agg(text.alias("text"), F.count(F.lit(1)).alias("rows"))
    return m.withColumn("name", F.concat(F.lit("manifest-"), F.substring(F.sha2("text", 256), 1, 16), F.lit(".jsonl")))


def snapshot(df: DataFrame, path: str, version: str) -> str:
    """A table written as a version of its own and then named as the current one (SNK4, SNK6)."""
    spark = df.sparkSession
    target = f"{path}/version={version}"
    df.write.mode("errorifexists").parquet(target)
    spark.createDataFrame([(version,)], "current string").coalesce(1).write.mode("overwrite").json(f"{path}/_current")
    return target


def current(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.json(f"{path}/_current").first()["current"]
    return spark.read.parquet(f"{path}/version={version}")


def by_date(df: DataFrame, path: str, at: str, level: str, least: int, levels: list[str]) -> None:
    """Log lines from a level up, one directory a UTC date (SNK10)."""
    rank = F.array_position(F.array(*[F.lit(x) for x in levels]), F.col(level))
    df.filter(rank >= least).withColumn("date", F.to_date(at)).write.mode("append").partitionBy("date").json(path)


def report(papers: DataFrame, language: str = "en") -> DataFrame:
    """A Markdown page of each nested record (SNK11): title, authors, contributions as list."""
    names = {"en": ("Authors", "Contributions"), "zh": ("作者", "贡献")}[language]
    items = F.concat_ws("\n", F.transform("claims", lambda c: F.concat(F.lit("- "), c)))
    body = F.concat_ws("\n", F.concat(F.lit("# "), F.col("title")), F.lit(""), F.concat(F.lit(f"**{names[0]}:** "), F.concat_ws(", ", "authors")), F.lit(""), F.lit(f"## {names[1]}"), items)
    return papers.select("paper_id", body.alias("markdown"))
