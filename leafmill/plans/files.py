"""Queries over files: tables are written as logs, trees and manifests to the shared folder and read back (SRC, SNK, RET3)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import gone_with_session, shared_folder, table
from ..sources import logs as L
from .catalogue import query
from .logs import EVENTS, LOG, events, log


def folder(spark: SparkSession, what: str) -> str:
    path = f"{shared_folder(spark)}/leafmill-{what}-{uuid4().hex}"
    gone_with_session(spark, path)
    return path


def text_file(spark: SparkSession, path: str, text: str) -> None:
    """A file of exactly this text, be its last line finished or not."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(text.encode()))
    out.close()


def as_log(df: DataFrame, what: str, torn: str = '{"type": "message", "id": "torn') -> str:
    """df as JSON lines in files, and one more file whose last line was never finished."""
    spark, path = df.sparkSession, folder(df.sparkSession, what)
    df.select(F.to_json(F.struct(*df.columns)).alias("line")).write.text(path)
    text_file(spark, f"{path}/torn.jsonl", torn)
    return path


@query("SELECT session_id, id, role, CAST(length(text) AS BIGINT) AS chars FROM session_log WHERE type = 'message' AND NOT contains(coalesce(text, ''), chr(0))")
def src1_messages(spark, sf):
    """SRC1, RET3: messages of logs with an unfinished last line."""
    rows = table(spark, sf, "session_log").select("id", "ts", "type", "parent_id", "role", F.concat("session_id", F.lit("|"), F.coalesce("text", F.lit("\x01"))).alias("text"))
    m = L.parsed(L.complete_lines(spark, as_log(rows, "session-log")), "message").filter(~F.col("text").contains("\x00"))
    text = F.substring(F.col("text"), F.locate("|", "text") + 1, F.length("text"))
    return m.select(F.substring_index("text", "|", 1).alias("session_id"), "id", "role", F.when(text != "\x01", F.length(text)).cast("bigint").alias("chars"))


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def src2_trace_events(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    rows = L.typed(L.complete_lines(spark, as_log(e, "trace", '{"event_id": 1')), "event_id bigint, user_id bigint, event_type string, value double")
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, user_id FROM events")
def src3_job_events(spark, sf):
    path = as_log(table(spark, sf, "events").select("event_id", "user_id"), "job-events", "")
    return L.present(spark, [path, f"{path}-of-a-job-without-log"], "event_id bigint, user_id bigint")


def _documents(spark: SparkSession, df: DataFrame, key: str, what: str) -> str:
    """One JSON document a file."""
    path = folder(spark, what)
    df.withColumn("at", F.col(key)).repartition("at").write.partitionBy("at").json(path)
    return path


@query("SELECT library_id AS id, name FROM libraries")
def src4_job_records(spark, sf):
    d = table(spark, sf, "libraries").select(F.col("library_id").alias("id"), "name")
    return L.json_records(spark, f"{_documents(spark, d, 'id', 'jobs')}/*/*.json", "id string, name string")


@query("SELECT source, target_share, max_repeats FROM mix_targets")
def src5_manifests(spark, sf):
    d = table(spark, sf, "mix_targets").select("source", "target_share", "max_repeats")
    return L.json_records(spark, f"{_documents(spark, d, 'source', 'manifests')}/*/*.json", "source string, target_share double, max_repeats int")


@query("SELECT n_nationkey, n_name FROM nation")
def src18_goldens(spark, sf):
    d = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return L.json_records(spark, f"{_documents(spark, d, 'n_nationkey', 'goldens')}/*/*.json", "n_nationkey bigint, n_name string")


@query("""WITH u AS (SELECT DISTINCT tool_use_id FROM session_log WHERE type = 'tool_use'), r AS (SELECT tool_use_id, max(output) AS value FROM session_log WHERE type = 'tool_result' AND tool_use_id IS NOT NULL GROUP BY 1)
SELECT u.tool_use_id, CASE WHEN u.tool_use_id IS NULL OR NOT regexp_full_match(u.tool_use_id, '[A-Za-z0-9_-]{1,64}') THEN 'bad id' WHEN r.tool_use_id IS NULL THEN 'missing' WHEN value IS NULL THEN 'no value' END AS fault FROM u LEFT JOIN r USING (tool_use_id)""")
def src6_payloads(spark, sf):
    s = table(spark, sf, "session_log").select("type", "tool_use_id", "output")
    refs = s.filter("type = 'tool_use'").select("tool_use_id").distinct()
    found = s.filter("type = 'tool_result' and tool_use_id is not null").groupBy("tool_use_id").agg(F.max("output").alias("value")).withColumn("own_id", F.col("tool_use_id"))
    return L.payload_lookup(refs, found, "tool_use_id", "value").select("tool_use_id", "fault")


@query("SELECT library_id, CAST(strlen(name) + 1 AS BIGINT) AS size, sha256(name || chr(10)) AS sha256 FROM libraries")
def src7_inventory(spark, sf):
    """A tree of one file a library; its name is the line in it."""
    path = folder(spark, "tree")
    table(spark, sf, "libraries").select("library_id", "name").repartition("library_id").write.partitionBy("library_id").text(path)
    return L.inventory(spark, path, ".TXT").select(F.regexp_extract("path", "library_id=([^/]+)", 1).alias("library_id"), "size", "sha256")


@query("WITH v AS (SELECT pdf_dir FROM libraries WHERE pdf_dir IS NOT NULL AND NOT regexp_matches(pdf_dir, '/\\.') ORDER BY string_split(pdf_dir, '/') LIMIT 25) SELECT pdf_dir, (SELECT count(*) FROM v) >= 25 AS limit_reached FROM v")
def src8_listing(spark, sf):
    d = table(spark, sf, "libraries").filter("pdf_dir is not null").select("pdf_dir", F.split("pdf_dir", "/").alias("parts"))
    return L.listed(d, 25).select("pdf_dir", "limit_reached")


@query("""SELECT library_id, CAST(count(*) AS BIGINT) AS papers FROM papers WHERE library_id IS NOT NULL GROUP BY 1 HAVING count(*) = count(venue)""")
def src9_manifests(spark, sf):
    """A paper without venue plays a broken row: the whole manifest of its library is left out."""
    p = table(spark, sf, "papers").filter("library_id is not null")
    row = F.when(F.col("venue").isNull(), F.lit('{"record_type": "paper", ')).otherwise(F.to_json(F.struct(F.lit("paper").alias("record_type"), "paper_id")))
    lines = p.select(F.col("library_id").alias("path"), row.alias("line"))
    heads = p.select(F.col("library_id").alias("path"), F.lit('{"record_type": "header"}').alias("line")).distinct()
    header, papers = L.manifest(lines.unionByName(heads))
    return papers.join(header.select("path"), "path").groupBy(F.col("path").alias("library_id")).agg(F.count(F.lit(1)).alias("papers"))


@query("SELECT chunk_id, paper_id, hex(encode(text)[11:60]) AS bytes FROM chunks WHERE text IS NOT NULL")
def src10_byte_ranges(spark, sf):
    c = table(spark, sf, "chunks").filter("text is not null")
    return c.select("chunk_id", "paper_id", F.hex(L.byte_range(F.col("text"), F.lit(10), F.lit(60))).alias("bytes"))


@query("SELECT paper_id, ord AS page, type AS ref FROM contributions")
def src11_formula_records(spark, sf):
    c = table(spark, sf, "contributions").select("paper_id", F.col("ord").alias("page"), F.col("type").alias("ref"), F.col("claim").alias("latex"))
    return L.typed(L.complete_lines(spark, as_log(c, "formulas", "")), "paper_id string, page bigint, ref string, latex string").select("paper_id", "page", "ref")


@query("""WITH p AS (SELECT paper_id, ord + 1 AS page, coalesce(title, '') AS text, max(depth) OVER (PARTITION BY paper_id) > 1 AS outlined FROM sections)
SELECT paper_id, string_agg('--- page ' || page || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY page, '--- page ' || page || ' ---' || chr(10) || text) AS text FROM p WHERE page <= CASE WHEN outlined THEN 3 ELSE 8 END GROUP BY 1""")
def src12_front_matter(spark, sf):
    s = table(spark, sf, "sections").select("paper_id", (F.col("ord") + 1).alias("page"), F.coalesce("title", F.lit("")).alias("text"), "depth")
    outline = s.groupBy("paper_id").agg((F.max("depth") > 1).alias("outlined"))
    return L.front_matter(s.join(outline, "paper_id"), ["paper_id"], "outlined").select("paper_id", "text")


@query("SELECT section_id, title AS text, CAST(0 AS BIGINT) AS x1, CAST(6 * length(title) AS BIGINT) AS x2, 10 * ord AS y1, 10 * ord + 8 AS y2 FROM sections WHERE length(title) > 0")
def src14_page_lines(spark, sf):
    """The letters of section titles as glyphs of a line."""
    g = table(spark, sf, "sections").filter("length(title) > 0").select("section_id", "ord", F.posexplode(F.split("title", "")).alias("pos", "char"))
    x = F.col("pos").cast("bigint")
    glyphs = g.select("section_id", x.alias("pos"), "char", (6 * x).alias("x1"), (6 * x + 6).alias("x2"), (10 * F.col("ord")).alias("y1"), (10 * F.col("ord") + 8).alias("y2"))
    return L.glyph_lines(glyphs, ["section_id"])


@query(f"WITH {LOG} SELECT session_id, id, json_extract_string(input, '$.query') AS query FROM log WHERE type = 'tool_use' AND input IS NOT NULL")
def src16_token_stream(spark, sf):
    """Tool inputs as a stream of server-sent events with comments and an end mark."""
    u = log(spark, sf, "type", "input").filter("type = 'tool_use' and input is not null")
    lines = u.select("session_id", "id", F.explode(F.array(F.lit(": keep-alive"), F.concat(F.lit("data: "), "input"), F.lit(""), F.lit("data: [DONE]"))).alias("line"))
    return L.sse(lines).select("session_id", "id", F.try_variant_get("document", "$.query", "string").alias("query"))


@query(f"WITH {EVENTS} SELECT user_id, CAST(count(*) AS BIGINT) AS documents, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM e GROUP BY 1")
def src21_client_stream(spark, sf):
    lines = events(spark, sf).select("user_id", F.explode(F.array(F.lit("event: activity"), F.concat(F.lit("data:"), "props"))).alias("line"))
    return L.sse(lines).groupBy("user_id").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.try_variant_get("document", "$.k", "bigint")).alias("k"))


SUITE = '{"cases": [{"id": "a", "action": "read", "expected": "allow"}, {"id": "b", "action": "delete", "expected": "deny"}, {"id": "c", "action": "write", "expected": "deny"}]}'


@query("SELECT id, expected, CASE WHEN action = 'read' THEN 'allow' ELSE 'deny' END = expected AS passed FROM (VALUES ('a', 'read', 'allow'), ('b', 'delete', 'deny'), ('c', 'write', 'deny')) v(id, action, expected)")
def src17_suite(spark, sf):
    """SRC17, ARR4: cases of a suite file and whether the actual result is the expected one."""
    cases = L.suite(spark, SUITE, "id string, action string, expected string")
    return cases.select("id", "expected", (F.when(F.col("action") == "read", "allow").otherwise("deny") == F.col("expected")).alias("passed"))


@query("""WITH r AS (SELECT paper_id, max(ingested_at) AS latest FROM papers GROUP BY 1 ORDER BY latest DESC, paper_id LIMIT 20), s AS (SELECT paper_id, min(session_id) AS session_id FROM session_log GROUP BY 1) SELECT paper_id, epoch_us(latest) AS "at", session_id FROM r LEFT JOIN s USING (paper_id)""")
def src19_reports(spark, sf):
    """SRC19, SRT2: the twenty latest papers play the reports."""
    p = table(spark, sf, "papers").groupBy("paper_id").agg(F.max("ingested_at").alias("at"))
    s = table(spark, sf, "session_log").groupBy("paper_id").agg(F.min("session_id").alias("session_id"))
    return L.reports(p, s, "paper_id", "at").select("paper_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at"), "session_id")


@query("SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(seq) AS BIGINT) AS seqs FROM (SELECT n + 1 AS seq, CASE WHEN n < 9 THEN 'lifecycle' WHEN n < 3009 THEN 'reasoning' WHEN n < 8009 THEN 'delta' ELSE 'lifecycle' END AS kind FROM range(8018) t(n)) GROUP BY 1")
def src20_synthetic(spark, sf):
    return L.synthetic_events(spark, 3000, 5000).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("seq").alias("seqs"))


def _appended(spark: SparkSession, sf: str, key: list[str], what: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    path, half = folder(spark, what), F.lit("2024-01-15").cast("timestamp_ntz")
    none = e.limit(0).withColumn("seq", F.lit(0).cast("bigint"))
    L.append(L.numbered(none, e.filter(F.col("ts") < half), key, ["ts", "event_id"]).select(*key, "event_id", "seq"), path)
    schema = ", ".join(f"{c} {'string' if c == 'event_type' else 'bigint'}" for c in dict.fromkeys([*key, "event_id", "seq"]))
    L.append(L.numbered(spark.read.schema(schema).json(path), e.filter(F.col("ts") >= half), key, ["ts", "event_id"]).select(*key, "event_id", "seq"), path)
    return spark.read.schema(schema).json(path)


@query("SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS seq FROM events")
def snk2_recorded(spark, sf):
    return _appended(spark, sf, ["user_id", "event_type"], "recorded")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def snk3_appended(spark, sf):
    """SNK1, SNK3: rows appended in two calls; the second goes on from what it reads."""
    return _appended(spark, sf, ["user_id"], "appended")


@query("SELECT c_custkey, c_mktsegment FROM customer")
def snk4_snapshots(spark, sf):
    c, path = table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), folder(spark, "snapshots")
    L.snapshot(c.withColumn("c_mktsegment", F.lit("old")), path, "1")
    L.snapshot(c, path, "2")
    return L.current(spark, path)


@query("""WITH m AS (SELECT library_id, string_agg(l, chr(10) ORDER BY l) || chr(10) AS t, count(*) AS n FROM (SELECT library_id, '{"paper_id":"' || paper_id || '"}' AS l FROM papers WHERE library_id IS NOT NULL) GROUP BY 1) SELECT library_id, 'manifest-' || left(sha256(t), 16) || '.jsonl' AS name, CAST(n AS BIGINT) AS rows FROM m""")
def snk6_manifests(spark, sf):
    p = table(spark, sf, "papers").filter("library_id is not null").select("library_id", F.to_json(F.struct("paper_id")).alias("line"))
    return L.manifest_of(p, ["library_id"], "line").select("library_id", "name", "rows")


@query("SELECT paper_id, field, value FROM (SELECT paper_id, unnest([struct_pack(field := 'title', value := title), struct_pack(field := 'year', value := CAST(year AS VARCHAR))], recursive := true) FROM (SELECT paper_id, max_by(title, ingested_at) AS title, max_by(year, ingested_at) AS year FROM papers GROUP BY 1)) WHERE value IS NOT NULL")
def snk7_goldens(spark, sf):
    """Golden values marked from the latest output of each paper, one folder a field."""
    p = table(spark, sf, "papers").groupBy("paper_id").agg(F.max_by("title", "ingested_at").alias("title"), F.max_by("year", "ingested_at").alias("year"))
    rows = p.select("paper_id", F.explode(F.array(F.struct(F.lit("title").alias("field"), F.col("title").alias("value")), F.struct(F.lit("year").alias("field"), F.col("year").cast("string").alias("value")))).alias("m")).select("paper_id", "m.*").filter("value is not null")
    path = folder(spark, "marked")
    rows.write.partitionBy("field").json(path)
    return spark.read.schema("paper_id string, value string, field string").json(path)


@query("SELECT paper_id, session_id, TIMESTAMP '2031-01-01' AS linked_at FROM (SELECT DISTINCT paper_id, session_id FROM session_log WHERE type = 'session_header')")
def snk8_links(spark, sf):
    path = folder(spark, "links")
    links = table(spark, sf, "session_log").filter("type = 'session_header'").select("paper_id", "session_id").distinct()
    for part in (links, links.limit(0)):
        L.append(L.linked_at(part, F.lit("2031-01-01T00:00:00")), path)
    return spark.read.schema("paper_id string, session_id string, linked_at timestamp_ntz").json(path)


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY 1")
def snk10_by_date(spark, sf):
    path = folder(spark, "app-log")
    L.by_date(table(spark, sf, "events").select("event_id", "event_type", "ts"), path, "ts", "event_type", 3, ["view", "click", "signup", "purchase", "error"])
    rows = spark.read.schema("event_id bigint, date date").json(path)
    return rows.groupBy(F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS samples, max(value) AS worst FROM events GROUP BY 1")
def snk12_stress_summary(spark, sf):
    path = folder(spark, "summary")
    table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("samples"), F.max("value").alias("worst")).coalesce(1).write.json(path)
    return spark.read.schema("event_type string, samples bigint, worst double").json(path)


@query("SELECT session_id, id, text IS NULL AS silent FROM session_log WHERE type IN ('reasoning', 'message')")
def snk1_session_appends(spark, sf):
    """Rows appended to a log whose last write was torn: what was torn stays out, what comes after is read."""
    rows = table(spark, sf, "session_log").filter("type in ('reasoning', 'message')").select("session_id", "id", F.col("text").isNull().alias("silent"), "type")
    path = as_log(rows.filter("type = 'message'"), "appends", '{"session_id": "s", "id": "to')
    L.append(rows.filter("type = 'reasoning'"), path)
    return L.typed(L.complete_lines(spark, path), "session_id string, id string, silent boolean")


@query("SELECT user_id, CAST(count(*) AS BIGINT) AS lines FROM events GROUP BY 1")
def ret3_torn_tails(spark, sf):
    """Two unfinished ends, one of them a whole document but for its line feed, are no lines."""
    path = as_log(table(spark, sf, "events").select("user_id", "event_id"), "torn", '{"user_id": -1}')
    text_file(spark, f"{path}/other.jsonl", '{"user_id": -2')
    return L.typed(L.complete_lines(spark, path), "user_id bigint").groupBy("user_id").agg(F.count(F.lit(1)).alias("lines"))


@query("""WITH n AS (SELECT paper_id, max_by(coalesce(venue, ''), ingested_at) AS note FROM papers GROUP BY 1) SELECT p.paper_id, epoch_us(p.ingested_at) AS "at", CASE WHEN coalesce(p.venue, '') = note THEN 'applied' ELSE 'conflict' END AS status, CASE WHEN coalesce(p.venue, '') = note THEN note || ' +' ELSE note END AS text FROM papers p JOIN n USING (paper_id)""")
def snk9_bound_patches(spark, sf):
    """Patches of notes, each bound to the hash of the text that it was made from: the latest venue of a paper is its note."""
    p = table(spark, sf, "papers").withColumn("venue", F.coalesce("venue", F.lit("")))
    notes = p.groupBy("paper_id").agg(F.max_by("venue", "ingested_at").alias("text"))
    patches = p.select("paper_id", F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("at"), F.sha2("venue", 256).alias("made_from"), F.concat("venue", F.lit(" +")).alias("new_text"))
    return L.bound_patches(notes, patches, "paper_id").select("paper_id", "at", "status", "text")
