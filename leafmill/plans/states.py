"""Queries over streams, state and retention (STM, RET, UDF7)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import joins as J
from ..operators import validation as V
from ..session import gone_with_session, shared_folder, table
from ..streaming import tails
from .catalogue import query
from .logs import EVENTS, LOG, events, log
from .values import KEYED, _documents


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("at", F.col("ts").cast("timestamp"))


def _folder(spark):
    folder = f"{shared_folder(spark)}/leafmill-stream-{uuid4().hex}"
    gone_with_session(spark, folder)
    return folder


@query("SELECT event_id, user_id FROM events WHERE user_id IS NOT NULL")
def stm1_live_tail(spark, sf):
    """The event file as a live tail into a table; the checkpoint is the cursor, a second run brings nothing again."""
    rows, folder = _stream(spark, sf).select("event_id", "user_id").filter("user_id is not null"), _folder(spark)
    tails.drained(rows, "tail", folder)
    return tails.drained(rows, "tail", folder)


@query("SELECT DISTINCT user_id, event_id FROM events")
def stm2_stream_once(spark, sf):
    """Each event of a user once, by a cursor per user."""
    return tails.drained(tails.advancing(_stream(spark, sf), "user_id", "event_id"), "once", _folder(spark))


@query("""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT epoch_us(s) AS window_start, event_type, CAST(n AS BIGINT) AS n FROM w WHERE s + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)""")
def stm_windowed_counts(spark, sf):
    """Hourly counts of the event stream; windows that the watermark has not passed stay open."""
    rows = tails.drained(tails.windowed(_stream(spark, sf), "at", ["event_type"], "1 hour"), "hourly", _folder(spark))
    return rows.select(F.unix_micros("window_start").alias("window_start"), "event_type", "n")


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def udf7_batches(spark, sf):
    """A caller's function over every micro-batch; here it appends counts to a table."""
    folder = _folder(spark)
    tails.applied_once(_stream(spark, sf), ["event_id"], lambda rows, n: rows.groupBy("event_type").count().withColumn("batch", F.lit(n)).write.mode("append").parquet(f"{folder}/out"), folder)
    return spark.read.parquet(f"{folder}/out").groupBy("event_type").agg(F.sum("count").alias("n"))


@query(f"""WITH {EVENTS}, d AS {KEYED}, l AS (SELECT *, lag(doc) OVER (PARTITION BY user_id ORDER BY seq) AS old FROM d) SELECT user_id, seq, CASE WHEN old IS NULL THEN 'full' ELSE 'patch' END AS mode, old IS NULL AND state = doc OR old IS NOT NULL AS whole FROM (SELECT *, doc AS state FROM l) WHERE old IS DISTINCT FROM doc""")
def stm4_changes(spark, sf):
    """Which documents of a user are written, and how; the first one is written as it is."""
    d = _documents(spark, sf)
    c = tails.changes(d, ["user_id"], "seq", "doc").withColumnRenamed("doc", "state")
    return c.join(d.select("user_id", "seq", "doc"), ["user_id", "seq"]).select("user_id", "seq", "mode", ((F.col("mode") == "patch") | (F.col("state") == F.col("doc"))).alias("whole"))


@query(f"WITH {EVENTS}, d AS {KEYED} SELECT CAST(user_id AS VARCHAR) AS user_id, max_by(doc, seq) AS state FROM d GROUP BY 1")
def stm3_state_fold(spark, sf):
    """Full documents and patches folded in order give the last document; fields go on the way."""
    from ..functions import structures as S

    c = tails.changes(_documents(spark, sf), ["user_id"], "seq", "doc")
    return S.folded_state(c, "user_id", "seq", "mode", "state")


@query()
def stm6_flushes(spark, sf):
    """Rows of an event stream in groups that leave together: a fold with feedback, which SQL has not."""
    e = events(spark, sf).withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))
    return tails.flush_groups(e, ["user_id"], "seq", F.length("props"), F.col("event_type") != "purchase", F.col("at"), 40, 600_000)


@query(f"""WITH {LOG}, v AS (SELECT session_id, turn_id, pos, CASE type WHEN 'turn_started' THEN 'created' WHEN 'turn_aborted' THEN 'evidence_recorded' ELSE 'completed' END AS name FROM log WHERE type IN ('turn_started', 'turn_completed', 'turn_aborted') AND turn_id IS NOT NULL),
s AS (SELECT session_id, turn_id, count(*) FILTER (name = 'created') AS made, min(pos) FILTER (name = 'created') AS made_at, min(pos) FILTER (name <> 'created') AS used, count(*) FILTER (name = 'evidence_recorded') AS evidence, min(pos) FILTER (name = 'evidence_recorded') AS ev, min(pos) FILTER (name = 'completed') AS done FROM v GROUP BY 1, 2)
SELECT session_id, turn_id, CAST(evidence AS BIGINT) AS evidence, done IS NOT NULL AS completed, CASE WHEN made = 0 THEN 'unknown set' WHEN made > 1 THEN 'made twice' WHEN used < made_at THEN 'used before it is made' WHEN done < coalesce(ev, done + 1) THEN 'completed before evidence' END AS error FROM s""")
def stm7_set_states(spark, sf):
    """Turns as result sets: started is created, aborted is evidence, completed is completed."""
    rows = log(spark, sf, "type", "turn_id").filter(F.col("type").isin("turn_started", "turn_completed", "turn_aborted") & F.col("turn_id").isNotNull())
    name = F.when(F.col("type") == "turn_started", "created").when(F.col("type") == "turn_aborted", "evidence_recorded").otherwise("completed")
    v = rows.select("session_id", "turn_id", "pos", name.alias("name"), F.lit(None).cast("string").alias("parent"))
    return tails.set_states(v, ["session_id", "turn_id"], "pos").select("session_id", "turn_id", "evidence", "completed", "error")


@query(f"""WITH {LOG}, t AS (SELECT session_id, turn_id, min(pos) FILTER (type = 'turn_started') AS s, max(pos) FILTER (type <> 'turn_started') AS e FROM log WHERE type IN ('turn_started', 'turn_completed', 'turn_aborted') AND turn_id IS NOT NULL AND received_at < TIMESTAMPTZ '2031-07-01 00:00:00+00' GROUP BY 1, 2) SELECT session_id, turn_id, CASE WHEN e IS NULL OR e < s THEN 'running' ELSE 'done' END AS status FROM t WHERE s IS NOT NULL""")
def stm8_running_spans(spark, sf):
    """The state of a trace while it is live: the log up to an instant; spans without an end are running."""
    rows = log(spark, sf, "type", "turn_id", "received_at").filter(F.col("type").isin("turn_started", "turn_completed", "turn_aborted") & F.col("turn_id").isNotNull() & (F.col("received_at") < F.lit("2031-07-01T00:00:00Z").cast("timestamp")))
    started = F.col("type") == "turn_started"
    t = rows.groupBy("session_id", "turn_id").agg(F.min(F.when(started, F.col("pos"))).alias("s"), F.max(F.when(~started, F.col("pos"))).alias("e")).filter("s is not null")
    return t.select("session_id", "turn_id", F.when(F.col("e").isNull() | (F.col("e") < F.col("s")), "running").otherwise("done").alias("status"))


@query("SELECT doc_id, hex(CASE WHEN strlen(text) <= 100 THEN encode(text) ELSE encode(text)[1:50] END) AS head, hex(CASE WHEN strlen(text) <= 100 THEN encode('') ELSE encode(text)[strlen(text) - 49:] END) AS tail, CAST(CASE WHEN strlen(text) <= 100 THEN 0 ELSE strlen(text) - 100 END AS BIGINT) AS omitted FROM documents WHERE text IS NOT NULL")
def stm12_kept_ends(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null")
    return d.select("doc_id", tails.kept_ends(F.col("text"), 100).alias("k")).select("doc_id", F.hex("k.head").alias("head"), F.hex("k.tail").alias("tail"), "k.omitted")


@query(f"""WITH {EVENTS}, c AS (SELECT *, event_type <> 'view' AND ts <= TIMESTAMP '2024-01-15' AS candidate, event_type = 'click' AND ts <= TIMESTAMP '2024-01-15' AS changed FROM e)
SELECT event_id, CASE WHEN candidate AND NOT changed THEN 'retention' END AS reason, CASE WHEN candidate AND NOT changed THEN strlen(props) END AS original_bytes, CASE WHEN candidate AND NOT changed THEN sha256(replace(props, ' ', '')) END AS sha256, CASE WHEN changed THEN 'changed' END AS fault, CASE WHEN candidate AND NOT changed THEN '2024-02-14T00:00:00Z' ELSE props END AS kept FROM c""")
def ret2_tombstones(spark, sf):
    """Payloads of a scan are removed; those that changed since the scan, here the clicks, stay and are reported."""
    from ..functions import structures as S

    e = V.retention(events(spark, sf), "ts", F.col("event_type") == "view", F.lit(False), F.lit("2024-02-14").cast("timestamp_ntz"), 30)
    scan = e.filter("candidate").select("event_id", F.when(F.col("event_type") == "click", F.sha2(F.lit("before"), 256)).otherwise(F.sha2("props", 256)).alias("original_file_sha256"), X.canonical_sha(F.col("props")).alias("original_value_sha256"))
    out = V.removed(e.select("event_id", "props"), scan, ["event_id"], "props", F.lit("2024-02-14T00:00:00Z").cast("timestamp"))
    v = F.try_parse_json("props")
    sha = S.tombstone_sha(F.col("props"))
    get = lambda path, kind: F.when(sha.isNotNull(), F.try_variant_get(v, path, kind))
    return out.select("event_id", get("$.reason", "string").alias("reason"), get("$.original_bytes", "bigint").alias("original_bytes"), sha.alias("sha256"), "fault", F.coalesce(get("$.removed_at", "string"), F.col("props")).alias("kept"))


@query("SELECT chunk_id FROM chunks c WHERE NOT EXISTS (SELECT 1 FROM sections s WHERE s.text IS NULL AND s.paper_id = c.paper_id AND s.title = c.section_title)")
def ret5_deleted_by_source(spark, sf):
    """Chunks stay unless their source, a section of a paper, has lost its text."""
    gone = table(spark, sf, "sections").filter("text is null").select("paper_id", F.col("title").alias("section_title"))
    return V.deleted_by_source(table(spark, sf, "chunks"), gone, "paper_id", "section_title").select("chunk_id")


@query("WITH d AS (SELECT sha256(title) AS sha, paper_id AS path FROM papers WHERE title IS NOT NULL), w AS (SELECT n_nationkey AS k, (SELECT sha256(min(title)) FROM papers) AS sha FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 99, 'none') SELECT k AS wanted, (SELECT min(path) FROM d WHERE d.sha = w.sha) AS path FROM w")
def ret7_reusable(spark, sf):
    p = table(spark, sf, "papers")
    first = p.agg(F.sha2(F.min("title"), 256).alias("sha"))
    wanted = table(spark, sf, "nation").filter("n_nationkey < 3").select(F.col("n_nationkey").cast("bigint").alias("wanted")).crossJoin(F.broadcast(first)).unionByName(spark.createDataFrame([(99, "none")], "wanted bigint, sha string"))
    return V.reusable(p.filter("title is not null").select(F.sha2("title", 256).alias("sha"), F.col("paper_id").alias("path")), wanted, "wanted", "sha", "path")


@query("SELECT paper_id, CASE WHEN n IS NULL THEN 'miss' WHEN library_id IS NULL THEN 'incompatible' WHEN t IS DISTINCT FROM title THEN 'corrupt' ELSE 'hit' END AS state FROM (SELECT paper_id, max_by(library_id, ingested_at) AS library_id, max_by(title, ingested_at) AS title FROM papers GROUP BY 1) p LEFT JOIN (SELECT paper_id, count(*) AS n FROM sections GROUP BY 1) c USING (paper_id) LEFT JOIN (SELECT paper_id, min(title) AS t FROM papers GROUP BY 1) f USING (paper_id)")
def ret4_cache_states(spark, sf):
    """Papers with sections as cached ones: a library plays the extractor, the hash of the title the content."""
    p = table(spark, sf, "papers")
    last = p.groupBy("paper_id").agg(F.max_by("library_id", "ingested_at").alias("library_id"), F.max_by("title", "ingested_at").alias("title"))
    wanted = last.select("paper_id", F.lit("known").alias("fp"))
    cached = table(spark, sf, "sections").select("paper_id").distinct()
    manifests = last.join(cached, "paper_id").select("paper_id", F.when(F.col("library_id").isNotNull(), "known").otherwise("other").alias("fp"), F.sha2("title", 256).alias("sha256"))
    files = p.groupBy("paper_id").agg(F.sha2(F.min("title"), 256).alias("sha256"))
    return V.cache_state(wanted, manifests, files, "paper_id", "fp").select("paper_id", "state")


_ = J
