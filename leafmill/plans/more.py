"""Further queries of the catalogue: smaller operators of every family."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import structures as S
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import validation as V
from ..session import table
from ..streaming import tails
from .catalogue import query
from .logs import EVENTS, LOG, events, log


@query(f"""WITH {LOG} SELECT session_id, turn_id FROM log WHERE turn_id IS NOT NULL GROUP BY 1, 2 HAVING count(*) FILTER (type = 'turn_started') > count(*) FILTER (type IN ('turn_completed', 'turn_aborted'))""")
def flt4_unfinished(spark, sf):
    rows = log(spark, sf, "type", "turn_id").filter("turn_id is not null")
    spans = J.spans(rows, ["session_id", "turn_id"], F.col("type") == "turn_started", F.col("type").isin("turn_completed", "turn_aborted"), "pos")
    return spans.filter("starts > ends").select("session_id", "turn_id")


@query(f"WITH {LOG} SELECT name, CAST(count(*) AS BIGINT) AS n FROM log WHERE type = 'application_event' GROUP BY 1")
def flt5_application_events(spark, sf):
    return log(spark, sf, "type", "name").filter("type = 'application_event'").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE contains(text, chr(0)) OR regexp_matches(text, '[\\x{FFFD}\\x{E000}-\\x{F8FF}\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]')")
def flt9_garbled_documents(spark, sf):
    return table(spark, sf, "documents").filter(X.garbled(F.col("text"))).select("doc_id")


@query("SELECT paper_id FROM papers WHERE paper_id NOT IN (SELECT paper_id FROM contributions WHERE type = 'method' AND paper_id IS NOT NULL) GROUP BY 1")
def jn7_papers_without_methods(spark, sf):
    return table(spark, sf, "papers").select("paper_id").distinct().join(table(spark, sf, "contributions").filter("type = 'method'").select("paper_id").distinct(), "paper_id", "left_anti")



@query(f"""WITH {EVENTS}, o AS (SELECT *, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY seq), true) AS ordered FROM e)
SELECT user_id, round(coalesce(avg(value), 0), 4) AS mean, max(value) AS most, round(coalesce(avg(value) FILTER (event_type = 'click'), 0), 4) AS click_mean, bool_and(ordered) AS in_order FROM o GROUP BY 1""")
def agg12_summary(spark, sf):
    from pyspark.sql import Window

    by = Window.partitionBy("user_id").orderBy("seq")
    e = events(spark, sf).withColumn("ordered", F.coalesce(F.col("ts") >= F.lag("ts").over(by), F.lit(True)))
    return e.groupBy("user_id").agg(F.round(F.coalesce(F.avg("value"), F.lit(0.0)), 4).alias("mean"), F.max("value").alias("most"), F.round(F.coalesce(F.avg(F.when(F.col("event_type") == "click", F.col("value"))), F.lit(0.0)), 4).alias("click_mean"), F.bool_and("ordered").alias("in_order"))


@query(f"WITH {LOG} SELECT session_id, id, greatest(coalesce(input_tokens, 0) - coalesce(output_tokens, 0), 0) AS fresh FROM log WHERE type = 'llm_call'")
def agg17_disjoint_usage(spark, sf):
    calls = log(spark, sf, "type", "input_tokens", "output_tokens").filter("type = 'llm_call'")
    return calls.select("session_id", "id", F.greatest(F.coalesce("input_tokens", F.lit(0)) - F.coalesce("output_tokens", F.lit(0)), F.lit(0)).alias("fresh"))


@query(f"WITH {LOG} SELECT session_id, id, round(least(greatest((input_tokens - 12000) / (272000.0 - 12000), 0.0), 1.0), 6) AS used FROM log WHERE type = 'llm_call' AND input_tokens IS NOT NULL")
def num2_used_fraction(spark, sf):
    calls = log(spark, sf, "type", "input_tokens").filter("type = 'llm_call' and input_tokens is not null")
    return calls.select("session_id", "id", F.round(X.used_fraction(F.col("input_tokens"), F.lit(272_000)), 6).alias("used"))


@query("""WITH a AS (SELECT paper_id, count(*) AS g FROM sections GROUP BY 1), b AS (SELECT paper_id, count(*) AS n FROM contributions GROUP BY 1) SELECT paper_id, coalesce(n, 0) < g * 0.5 AS halved FROM a LEFT JOIN b USING (paper_id)""")
def num7_halved(spark, sf):
    a = table(spark, sf, "sections").groupBy("paper_id").agg(F.count("section_id").alias("golden"))
    b = table(spark, sf, "contributions").groupBy("paper_id").agg(F.count("contribution_id").alias("found"))
    return a.join(b, "paper_id", "left").select("paper_id", X.halved(F.coalesce("found", F.lit(0)), F.col("golden")).alias("halved"))


@query("SELECT source_set, CAST(count(*) AS BIGINT) AS rows FROM (SELECT 'old' AS source_set FROM contributions UNION ALL SELECT 'new' FROM sections) GROUP BY 1")
def set1_union_all(spark, sf):
    old = table(spark, sf, "contributions").select(F.lit("old").alias("source_set"))
    new = table(spark, sf, "sections").select(F.lit("new").alias("source_set"))
    return old.unionByName(new).groupBy("source_set").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT DISTINCT paper_id FROM chunks c WHERE paper_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.paper_id = c.paper_id)")
def set7_new_refs(spark, sf):
    d = table(spark, sf, "documents").filter("paper_id is not null").select("paper_id").distinct()
    return table(spark, sf, "chunks").filter("paper_id is not null").select("paper_id").distinct().join(d, "paper_id", "left_anti")


@query("SELECT paper_id, sha256(to_json(list_sort(list(DISTINCT type)))) AS sha FROM contributions WHERE type IS NOT NULL GROUP BY 1")
def hsh4_bundles(spark, sf):
    c = table(spark, sf, "contributions").filter("type is not null")
    return c.groupBy("paper_id").agg(X.bundle_sha("type").alias("sha"))


@query(f"WITH {EVENTS} SELECT user_id, event_id % 3 AS index, string_agg(event_type, '' ORDER BY seq) AS name, string_agg(props, '' ORDER BY seq) AS arguments FROM e GROUP BY 1, 2")
def jsn10_assembled_calls(spark, sf):
    e = events(spark, sf).select("user_id", (F.col("event_id") % 3).alias("index"), F.col("seq").alias("pos"), F.col("event_type").alias("name"), F.col("props").alias("arguments"))
    return S.assembled_calls(e, ["user_id"])


@query("SELECT p_partkey, to_json(map {'started.size': p_size, 'completed.size': p_size + 1}) AS attributes FROM part")
def jsn7_prefixed_keys(spark, sf):
    p = table(spark, sf, "part")
    old, new = F.create_map(F.lit("size"), F.col("p_size")), F.create_map(F.lit("size"), F.col("p_size") + 1)
    return p.select("p_partkey", F.to_json(S.joined_maps(S.prefixed_keys(old, "started"), S.prefixed_keys(new, "completed"))).alias("attributes"))


@query(f"""WITH {EVENTS} SELECT user_id, event_type, min(seq) AS first_seen, CAST(max_by(value, seq) AS VARCHAR) IS NOT NULL AS phase_known, max_by(event_id, seq) AS phase, sha256(string_agg(props, '' ORDER BY seq)) AS text_sha FROM e GROUP BY 1, 2""")
def stm5_activity_fold(spark, sf):
    e = events(spark, sf).withColumn("phase", F.col("event_id")).withColumn("title", F.col("value")).withColumn("delta", F.col("props"))
    return tails.activity_fold(e, ["user_id", "event_type"], "seq").select("user_id", "event_type", "first_seen", F.col("title").isNotNull().alias("phase_known"), "phase", F.sha2("text", 256).alias("text_sha"))



@query(f"WITH {EVENTS} SELECT e.user_id, CAST(count(*) AS BIGINT) AS kept FROM e WHERE user_id NOT IN (SELECT user_id FROM e WHERE event_type = 'error' AND value >= 150) GROUP BY 1")
def ret6_without_active(spark, sf):
    e = events(spark, sf)
    return V.without_active(e, e, "user_id", (F.col("event_type") == "error") & (F.col("value") >= 150)).groupBy("user_id").agg(F.count(F.lit(1)).alias("kept"))
