"""Queries over event and session logs: diagnostics, windows, turns, retention (FLT, VAL, WIN, AGG, RET, STM)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import structures as S
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import validation as V
from ..operators import windows as W
from ..session import table
from ..streaming import tails
from .catalogue import query

# ---- events: a stream is a user, `seq` its order; error = failed, signup = turn start, purchase = turn end

EVENTS = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)"
LOG = """log AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY received_at, id) AS pos FROM
 (SELECT * FROM session_log QUALIFY row_number() OVER (PARTITION BY session_id, id ORDER BY received_at) = 1))"""


def events(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").withColumn("seq", F.row_number().over(by).cast("bigint"))


def log(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return W.ordered_log(table(spark, sf, "session_log"), *columns)


@query(f"""WITH {EVENTS}, r AS (SELECT user_id, sha256(props) AS h, event_type, count(*) AS n FROM e GROUP BY ALL HAVING count(*) >= 2)
SELECT e.user_id, CAST(count(*) AS BIGINT) AS operations, round(sum(value), 4) AS total_value,
 CAST(count(*) FILTER (value >= 100) AS BIGINT) AS slow, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS failed,
 min(seq) FILTER (event_type = 'error') AS first_error_seq,
 coalesce((SELECT CAST(count(*) AS BIGINT) FROM r WHERE r.user_id = e.user_id), 0) AS repeated
FROM e GROUP BY e.user_id""")
def rollout_diagnostics(spark, sf):
    """FLT2-FLT4, AGG2, AGG3: totals, slow and failed operations, the first failure and repeated calls of each stream."""
    e = events(spark, sf)
    repeats = A.repeated(e, ["user_id", "event_type"], "props", "seq", 2).groupBy("user_id").agg(F.count(F.lit(1)).alias("repeated"))
    out = e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("operations"), F.round(F.sum("value"), 4).alias("total_value"), F.count_if(F.col("value") >= 100).alias("slow"),
        F.count_if(F.col("event_type") == "error").alias("failed"), F.min(F.when(F.col("event_type") == "error", F.col("seq"))).alias("first_error_seq"),
    )
    return out.join(repeats, "user_id", "left").withColumn("repeated", F.coalesce("repeated", F.lit(0)))


@query(f"WITH {EVENTS} SELECT user_id, event_id, seq FROM e WHERE seq > 5 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq) <= 10")
def flt1_event_tail(spark, sf):
    return A.top(events(spark, sf).filter("seq > 5"), ["user_id"], [F.col("seq")], 10).select("user_id", "event_id", "seq")


@query("SELECT event_type, round(sum(value), 4) AS total, CAST(count(*) AS BIGINT) AS n FROM events WHERE value IS NOT NULL GROUP BY 1")
def agg2_phase_totals(spark, sf):
    e = table(spark, sf, "events").filter("value is not null")
    return e.groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {EVENTS} SELECT user_id, event_id, seq, value FROM e WHERE value >= 100")
def flt2_slow_operations(spark, sf):
    return events(spark, sf).filter("value >= 100").select("user_id", "event_id", "seq", "value")


@query(f"WITH {EVENTS} SELECT user_id, event_id, seq FROM e WHERE event_type = 'error' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq) = 1")
def flt3_first_error(spark, sf):
    e = events(spark, sf).filter("event_type = 'error'")
    return e.groupBy("user_id").agg(F.min_by("event_id", "seq").alias("event_id"), F.min("seq").alias("seq"))


@query("SELECT event_type, props, sha256(props) AS payload_sha, CAST(count(*) AS BIGINT) AS calls, min(event_id) AS first_call FROM events GROUP BY 1, 2 HAVING count(*) >= 3")
def agg3_repeated_calls(spark, sf):
    e = table(spark, sf, "events")
    return A.repeated(e, ["event_type", "props"], "props", "event_id", 3)


@query(f"""WITH {EVENTS}, g AS (SELECT *, coalesce(event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1, true) AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
 i AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY user_id ORDER BY seq) AS g FROM g)
SELECT event_id, row_number() OVER (PARTITION BY user_id, g ORDER BY seq) AS run FROM i""")
def win1_identical_runs(spark, sf):
    return W.run_length(events(spark, sf), ["user_id"], ["seq"], "event_type").select("event_id", "run")


@query(f"""WITH {EVENTS}, f AS (SELECT event_id, event_type, list(event_type) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS l FROM e)
SELECT event_id, CAST(len(list_filter(l, lambda x: x = event_type)) AS BIGINT) AS similar FROM f WHERE len(list_filter(l, lambda x: x = event_type)) >= 4""")
def win2_similar_calls(spark, sf):
    return W.similar_in_frame(events(spark, sf), ["user_id"], ["seq"], "event_type").filter("similar >= 4").select("event_id", "similar")


SEGMENTS = """s AS (SELECT *, sum(CAST(type = 'turn_started' AS INT)) OVER (PARTITION BY session_id ORDER BY pos) AS t FROM log),
 m AS (SELECT *, coalesce(max(CAST(type IN ('turn_completed', 'turn_aborted') AS INT)) OVER (PARTITION BY session_id, t ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over FROM s),
 cut AS (SELECT *, CASE WHEN t = 0 OR over = 1 THEN 0 ELSE t END AS segment FROM m),
 seg AS (SELECT *, max(CAST(type = 'turn_completed' AS INT)) OVER (PARTITION BY session_id, segment) AS done FROM cut)"""


def _segments(spark, sf):
    df = log(spark, sf, "type", "turn_id")
    out = W.turn_segments(df, ["session_id"], "pos", F.col("type") == "turn_started", F.col("type").isin("turn_completed", "turn_aborted"))
    done = F.max((F.col("type") == "turn_completed").cast("int")).over(Window.partitionBy("session_id", "segment")) == 1
    return out.withColumn("closed", (F.col("segment") > 0) & done)


@query(f"""WITH {LOG}, {SEGMENTS} SELECT session_id, CAST(segment AS BIGINT) AS segment, CAST(count(*) AS BIGINT) AS entries, CASE WHEN segment > 0 THEN max(CASE WHEN type = 'turn_started' THEN turn_id END) END AS turn_id, segment > 0 AND max(done) = 1 AS closed FROM seg GROUP BY session_id, segment""")
def win3_turn_segments(spark, sf):
    s = _segments(spark, sf).groupBy("session_id", "segment")
    return s.agg(F.count(F.lit(1)).alias("entries"), F.max(F.when((F.col("segment") > 0) & (F.col("type") == "turn_started"), F.col("turn_id"))).alias("turn_id"), F.bool_or("closed").alias("closed"))


@query(f"""WITH {LOG}, {SEGMENTS}, named AS (SELECT *, CASE WHEN segment > 0 THEN max(CASE WHEN type = 'turn_started' THEN turn_id END) OVER (PARTITION BY session_id, segment) END AS turn FROM seg),
 k AS (SELECT *, max(CAST(segment > 0 AND done = 1 AS INT)) OVER (PARTITION BY session_id, turn) AS any_done FROM named)
SELECT session_id, CAST(count(*) AS BIGINT) AS kept FROM k WHERE segment = 0 OR coalesce(turn = 'turn-1', false) OR any_done = 1 GROUP BY 1""")
def win4_resume_filter(spark, sf):
    s = _segments(spark, sf)
    named = s.withColumn("turn", F.when(F.col("segment") > 0, F.max(F.when(F.col("type") == "turn_started", F.col("turn_id"))).over(Window.partitionBy("session_id", "segment"))))
    return W.resumable(named, ["session_id"], "turn", F.lit("turn-1")).groupBy("session_id").agg(F.count(F.lit(1)).alias("kept"))


@query(f"""WITH {LOG}, r AS (SELECT session_id, max(pos) FILTER (type = 'turn_aborted') AS last FROM log GROUP BY 1)
SELECT log.session_id, CAST(count(*) AS BIGINT) AS entries FROM log JOIN r USING (session_id) WHERE last IS NULL OR pos > last GROUP BY 1""")
def win5_after_reset(spark, sf):
    return W.after_last(log(spark, sf, "type"), ["session_id"], "pos", F.col("type") == "turn_aborted").groupBy("session_id").agg(F.count(F.lit(1)).alias("entries"))


@query(f"""WITH {LOG}, m AS (SELECT session_id, pos, role FROM log WHERE type = 'message'), n AS (SELECT *, CAST(coalesce(lag(role) OVER w <> role, true) AS INT) AS new FROM m WINDOW w AS (PARTITION BY session_id ORDER BY pos)),
 g AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY pos) AS g FROM n) SELECT session_id, role, min(pos) AS first_pos, CAST(count(*) AS BIGINT) AS rows FROM g GROUP BY session_id, g, role""")
def win6_regrouped_messages(spark, sf):
    m = log(spark, sf, "type", "role").filter("type = 'message'")
    return W.regrouped(m, ["session_id"], "pos", "role").select("session_id", "role", "first_pos", "rows")


@query(f"""WITH {LOG}, m AS (SELECT session_id, pos, greatest(CAST(ceil(strlen(text) / 3) AS BIGINT), 1) AS tokens FROM log WHERE type = 'message' AND text IS NOT NULL),
 c AS (SELECT *, sum(tokens) OVER w AS s, row_number() OVER w AS n FROM m WINDOW w AS (PARTITION BY session_id ORDER BY pos DESC))
SELECT session_id, pos, tokens FROM c WHERE n = 1 OR s <= 120""")
def win13_recent_suffix(spark, sf):
    m = log(spark, sf, "type", "text").filter("type = 'message' and text is not null").withColumn("tokens", X.token_estimate(F.col("text")))
    return W.recent_suffix(m, ["session_id"], "pos", "tokens", 120).select("session_id", "pos", "tokens")


@query(f"""WITH {LOG}, c AS (SELECT session_id, pos, input_tokens, coalesce(sum(input_tokens) OVER (PARTITION BY session_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM log WHERE type = 'llm_call')
SELECT session_id, pos, CAST(spent AS BIGINT) AS spent_before FROM c WHERE spent >= 50000 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos) = 1""")
def win14_budget_stop(spark, sf):
    calls = log(spark, sf, "type", "input_tokens").filter("type = 'llm_call'")
    return W.budget_stop(calls, ["session_id"], ["pos"], "input_tokens", 50_000).select("session_id", "pos", F.col("spent_before").cast("bigint").alias("spent_before"))


@query(f"WITH {LOG} SELECT session_id, pos, max(input_tokens) OVER (PARTITION BY session_id ORDER BY pos) AS high_water FROM log WHERE type = 'llm_call'")
def win16_high_water(spark, sf):
    return W.high_water(log(spark, sf, "type", "input_tokens").filter("type = 'llm_call'"), ["session_id"], "pos", "input_tokens").select("session_id", "pos", "high_water")


@query(f"""WITH {LOG}, c AS (SELECT session_id, pos, input_tokens, pos * 100 AS request, lag(input_tokens) OVER w AS la, lag(pos * 100) OVER w AS lr FROM log WHERE type = 'llm_call' WINDOW w AS (PARTITION BY session_id ORDER BY pos))
SELECT session_id, pos, coalesce(la + greatest(request - lr, 0), request) AS estimate FROM c""")
def win15_next_input(spark, sf):
    calls = log(spark, sf, "type", "input_tokens").filter("type = 'llm_call'").withColumn("request", F.col("pos") * 100)
    return W.next_input_estimate(calls, ["session_id"], "pos", "input_tokens", "request", "request").select("session_id", "pos", "estimate")


@query("""WITH c AS (SELECT chunk_id, paper_id, ord, row_number() OVER (PARTITION BY paper_id ORDER BY ord, chunk_id) - 1 AS expected FROM (SELECT DISTINCT chunk_id, paper_id, ord FROM chunks))
SELECT chunk_id, paper_id, ord, expected FROM c WHERE expected <> ord""")
def win17_sequence_gaps(spark, sf):
    c = table(spark, sf, "chunks").select("chunk_id", "paper_id", "ord").distinct()
    return W.sequence_gaps(c, ["paper_id"], "ord", first=0, ties="chunk_id").select("chunk_id", "paper_id", "ord", "expected")


@query(f"""WITH {LOG} SELECT session_id, name, pos, row_number() OVER (PARTITION BY session_id, name ORDER BY pos) AS attempt_no, row_number() OVER (PARTITION BY session_id, name ORDER BY pos) > 3 AS refused FROM log WHERE type = 'tool_use'""")
def win18_attempts(spark, sf):
    return W.attempts(log(spark, sf, "type", "name").filter("type = 'tool_use'"), ["session_id", "name"], ["pos"]).select("session_id", "name", "pos", "attempt_no", "refused")


@query(f"""WITH {EVENTS}, r AS (SELECT event_id, value - lag(value) OVER w AS dv, greatest(CAST(epoch_us(ts) - epoch_us(lag(ts) OVER w) AS DOUBLE) / 1e6, 1e-6) AS wall FROM e WINDOW w AS (PARTITION BY user_id ORDER BY seq))
SELECT event_id, round(dv / wall * 100, 2) + 0.0 AS rate, CAST(floor(greatest(wall - 60, 0.0)) AS BIGINT) AS gap FROM r WHERE dv IS NOT NULL""")
def win19_rates(spark, sf):
    e = W.rates(events(spark, sf), ["user_id"], ["seq"], F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, "value", 60.0)
    return e.filter("rate is not null").select("event_id", (F.round("rate", 2) + 0.0).alias("rate"), F.floor("gap").alias("gap"))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t FROM events), k AS (SELECT user_id, min(t) AS t FROM e GROUP BY 1 UNION ALL SELECT user_id, n FROM (SELECT k.user_id, (SELECT min(e.t) FROM e WHERE e.user_id = k.user_id AND e.t >= k.t + 3600000000) AS n FROM k) WHERE n IS NOT NULL) SELECT user_id, t AS "at" FROM k""")
def win20_thinned(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return W.thinned(e, "user_id", "at", 3_600_000_000)


@query(f"""WITH {LOG}, u AS (SELECT session_id, tool_use_id, min(pos) AS pos FROM log WHERE type = 'tool_use' GROUP BY 1, 2), r AS (SELECT session_id, tool_use_id, min_by(is_error, pos) AS is_error, 1 AS there FROM log WHERE type = 'tool_result' GROUP BY 1, 2)
SELECT u.session_id, u.tool_use_id, u.pos, there IS NOT NULL AS paired, CASE WHEN there IS NULL THEN true ELSE is_error END AS is_error FROM u LEFT JOIN r USING (session_id, tool_use_id)""")
def jn2_paired_results(spark, sf):
    rows = log(spark, sf, "type", "tool_use_id", "output", "is_error")
    uses = rows.filter("type = 'tool_use'").groupBy("session_id", "tool_use_id").agg(F.min("pos").alias("pos"))
    return J.paired_results(uses, rows.filter("type = 'tool_result'"), ["session_id", "tool_use_id"]).select("session_id", "tool_use_id", "pos", "paired", "is_error")


@query(f"""WITH {LOG} SELECT session_id, turn_id, min(pos) FILTER (type = 'turn_started') AS started, max(pos) FILTER (type = 'turn_completed') AS ended, CAST(count(*) FILTER (type = 'turn_started') AS BIGINT) AS starts, CAST(count(*) FILTER (type = 'turn_completed') AS BIGINT) AS ends FROM log WHERE turn_id IS NOT NULL GROUP BY 1, 2""")
def jn1_turn_spans(spark, sf):
    rows = log(spark, sf, "type", "turn_id").filter("turn_id is not null")
    return J.spans(rows, ["session_id", "turn_id"], F.col("type") == "turn_started", F.col("type") == "turn_completed", "pos")


@query(f"""WITH {EVENTS}, p AS (SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM e) SELECT event_id, previous FROM p""")
def jn11_previous_purchase(spark, sf):
    return J.as_of_previous(events(spark, sf), ["user_id"], ["seq"], F.col("event_type") == "purchase", F.col("event_id")).select("event_id", "previous")


@query(f"""WITH {LOG} SELECT session_id, max_by(input_tokens, pos) AS input_tokens, max_by(model, pos) AS model FROM log WHERE type = 'llm_call' GROUP BY 1""")
def jn12_last_usage(spark, sf):
    calls = log(spark, sf, "type", "model", "input_tokens").filter("type = 'llm_call'")
    return J.latest(calls, ["session_id"], ["pos"], ["input_tokens", "model"])


@query(f"""WITH {LOG}, f AS (SELECT session_id, id, min(pos) AS first FROM log GROUP BY 1, 2)
SELECT log.session_id, log.id, log.parent_id FROM log LEFT JOIN f ON f.session_id = log.session_id AND f.id = log.parent_id WHERE log.parent_id IS NOT NULL AND (first IS NULL OR first >= pos)""")
def jn15_late_parents(spark, sf):
    return J.unknown_parents(log(spark, sf, "parent_id"), ["session_id"], "id", "parent_id", "pos").select("session_id", "id", "parent_id")


@query("""SELECT model, agent, CAST(count(*) AS BIGINT) AS calls, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS input_tokens, CAST(sum(coalesce(output_tokens, 0)) AS BIGINT) AS output_tokens FROM (SELECT DISTINCT session_id, id, model, agent, input_tokens, output_tokens FROM session_log WHERE type = 'llm_call') GROUP BY 1, 2""")
def agg1_token_ledger(spark, sf):
    calls = table(spark, sf, "session_log").filter("type = 'llm_call'").select("session_id", "id", "model", "agent", "input_tokens", "output_tokens").distinct()
    return calls.groupBy("model", "agent").agg(F.count(F.lit(1)).alias("calls"), A.total_or_zero("input_tokens").alias("input_tokens"), A.total_or_zero("output_tokens").alias("output_tokens"))


@query(f"""WITH {LOG} SELECT session_id, name, min(pos) AS first_pos FROM log WHERE type = 'tool_use' GROUP BY 1, 2""")
def agg7_tools_in_order(spark, sf):
    return A.first_seen(log(spark, sf, "type", "name").filter("type = 'tool_use'"), ["session_id"], "name", "pos")


@query(f"""WITH {LOG} SELECT session_id, sha256(string_agg(text, chr(10) ORDER BY pos)) AS text_sha, CAST(count(*) AS BIGINT) AS parts FROM log WHERE type = 'reasoning' AND text IS NOT NULL GROUP BY 1""")
def agg15_joined_text(spark, sf):
    r = log(spark, sf, "type", "text").filter("type = 'reasoning' and text is not null")
    return r.groupBy("session_id").agg(F.sha2(A.text_of("text", "pos", "\n"), 256).alias("text_sha"), F.count(F.lit(1)).alias("parts"))


@query("""SELECT session_id, CAST(count(*) AS BIGINT) AS expected, CAST(count(*) FILTER (completed) AS BIGINT) AS completed, string_agg(CASE WHEN completed IS NOT TRUE THEN CAST(segment_no AS VARCHAR) END, ',' ORDER BY CAST(segment_no AS VARCHAR)) AS missing, CASE WHEN count(*) = count(*) FILTER (completed) THEN 'ok' ELSE 'incomplete' END AS status FROM turn_segments GROUP BY 1""".replace("string_agg(", "coalesce(string_agg(").replace("VARCHAR)) AS missing", "VARCHAR)), '') AS missing"))
def agg5_segment_coverage(spark, sf):
    t = table(spark, sf, "turn_segments")
    return A.coverage(t.select("session_id", "segment_no"), t.filter("completed").select("session_id", "segment_no"), ["session_id"], "segment_no")



@query(f"""WITH {EVENTS} SELECT CAST(count(*) FILTER (event_type <> 'view' AND ts <= TIMESTAMP '2024-01-15') AS BIGINT) AS candidates, CAST(count(*) FILTER (event_type = 'view' AND ts <= TIMESTAMP '2024-01-15') AS BIGINT) AS running, CAST(sum(CASE WHEN event_type <> 'view' AND ts <= TIMESTAMP '2024-01-15' THEN strlen(props) ELSE 0 END) AS BIGINT) AS bytes, user_id FROM e GROUP BY user_id""")
def ret1_retention_report(spark, sf):
    e = V.retention(events(spark, sf), "ts", F.col("event_type") == "view", F.lit(False), F.lit("2024-02-14").cast("timestamp_ntz"), 30)
    old = F.col("ts") <= F.lit("2024-01-15").cast("timestamp_ntz")
    return e.groupBy("user_id").agg(F.count_if("candidate").alias("candidates"), F.count_if(old & (F.col("event_type") == "view")).alias("running"), F.sum(F.when(F.col("candidate"), F.octet_length("props")).otherwise(0)).alias("bytes"))



@query(f"""WITH {LOG}, d AS (SELECT session_id, id, json_extract_string(input, '$.query') AS query, CASE WHEN json_type(input, '$.page') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(input, '$.page') AS BIGINT) ELSE 0 END AS page FROM log WHERE type = 'tool_use' AND input IS NOT NULL)
SELECT session_id, id, query, page FROM d""")
def prj4_strict_fields(spark, sf):
    u = log(spark, sf, "type", "input").filter("type = 'tool_use' and input is not null")
    return u.select("session_id", "id", S.strict_field(F.col("input"), "$.query", "string", None).alias("query"), S.strict_field(F.col("input"), "$.page", "bigint", 0).alias("page"))


@query(f"WITH {LOG} SELECT session_id, id, coalesce(nullif(name, ''), nullif(model, ''), type) AS label FROM log")
def prj6_labels(spark, sf):
    return log(spark, sf, "type", "name", "model").select("session_id", "id", S.label(F.col("name"), F.col("model"), F.col("type")).alias("label"))


@query("""SELECT session_id, id, rule FROM (SELECT session_id, id, unnest([CASE WHEN type = 'message' AND (role NOT IN ('user', 'assistant') OR role IS NULL) THEN 'role' END, CASE WHEN coalesce(input_tokens, 0) < 0 THEN 'tokens' END, CASE WHEN type IN ('message', 'reasoning') AND coalesce(text, '') = '' THEN 'text' END]) AS rule FROM session_log) WHERE rule IS NOT NULL""")
def val1_violations(spark, sf):
    rules = {
        "role": (F.col("type") != "message") | F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)),
        "tokens": F.coalesce("input_tokens", F.lit(0)) >= 0,
        "text": ~F.col("type").isin("message", "reasoning") | (F.coalesce("text", F.lit("")) != ""),
    }
    return V.violations(table(spark, sf, "session_log"), rules).select("session_id", "id", F.explode("violations").alias("rule"))


@query(f"""WITH {LOG}, r AS (SELECT session_id, id, regexp_extract(text, '\\[([0-9a-f]{{64}}):page\\[([1-9][0-9]*)\\]\\]', 1) AS paper, regexp_extract(text, '\\[([0-9a-f]{{64}}):page\\[([1-9][0-9]*)\\]\\]', 2) AS page FROM log WHERE type = 'message' AND text IS NOT NULL)
SELECT session_id, id, paper, CAST(page AS BIGINT) AS page FROM r WHERE paper <> ''""")
def val4_evidence_refs(spark, sf):
    m = log(spark, sf, "type", "text").filter("type = 'message' and text is not null")
    shape = X.EVIDENCE_REF.strip("^$")
    return m.select("session_id", "id", F.regexp_extract("text", shape, 1).alias("paper"), F.regexp_extract("text", shape, 2).alias("page")).filter("paper <> ''").withColumn("page", F.col("page").cast("bigint"))


@query(f"""WITH {LOG}, g AS (SELECT session_id, CAST(count(*) FILTER (bad) AS BIGINT) AS late FROM (SELECT session_id, received_at < lag(received_at) OVER (PARTITION BY session_id ORDER BY pos) AS bad FROM log) GROUP BY 1),
 p AS (SELECT log.session_id, CAST(count(*) FILTER (log.parent_id IS NULL) AS BIGINT) AS roots, CAST(count(*) FILTER (log.parent_id IS NOT NULL AND q.id IS NULL) AS BIGINT) AS unknown_parents FROM log LEFT JOIN log q ON q.session_id = log.session_id AND q.id = log.parent_id GROUP BY 1)
SELECT session_id, roots, unknown_parents FROM p""")
def val2_chain_faults(spark, sf):
    rows = log(spark, sf, "parent_id")
    known = rows.select("session_id", F.col("id").alias("parent_id"), F.lit(True).alias("known"))
    return rows.join(known, ["session_id", "parent_id"], "left").groupBy("session_id").agg(F.count_if(F.col("parent_id").isNull()).alias("roots"), F.count_if(F.col("parent_id").isNotNull() & F.col("known").isNull()).alias("unknown_parents"))


@query(f"WITH {LOG} SELECT session_id, max_by(type, pos) AS type, max(pos) AS at FROM log WHERE type IN ('turn_started', 'turn_completed', 'turn_aborted') GROUP BY 1")
def stm11_last_state(spark, sf):
    rows = log(spark, sf, "type").filter(F.col("type").isin("turn_started", "turn_completed", "turn_aborted"))
    return tails.last_state(rows, ["session_id"], "pos", "type")


@query(f"""WITH {LOG}, s AS (SELECT session_id, max_by(type, pos) AS type FROM log WHERE type IN ('turn_started', 'turn_completed', 'turn_aborted') GROUP BY 1) SELECT session_id, CASE WHEN type = 'turn_started' THEN 'interrupted' ELSE type END AS type FROM s""")
def stm10_interrupted(spark, sf):
    return tails.interrupted(stm11_last_state(spark, sf), "type", ["turn_started"]).select("session_id", "type")




@query("SELECT event_id, sha256(replace(props, ' ', '')) AS sha FROM events")
def hsh2_canonical_sha(spark, sf):
    return table(spark, sf, "events").select("event_id", X.canonical_sha(F.col("props")).alias("sha"))



@query(f"""WITH {LOG} SELECT session_id, id, epoch_us(CAST(ts AS TIMESTAMPTZ)) AS micros FROM log WHERE regexp_matches(ts, '(Z|[+-]\\d{{2}}:?\\d{{2}})$')""")
def dt1_instants(spark, sf):
    rows = log(spark, sf, "ts").withColumn("at", X.iso_instant(F.col("ts"))).filter("at is not null")
    return rows.select("session_id", "id", F.unix_micros("at").alias("micros"))


@query("""WITH r AS (SELECT session_id, id, CASE WHEN row_number() OVER (PARTITION BY session_id, id ORDER BY received_at) = 1 THEN 1 ELSE 0 END AS first FROM session_log) SELECT session_id, CAST(sum(first) AS BIGINT) AS entries, CAST(count(*) - sum(first) AS BIGINT) AS delivered_again FROM r GROUP BY 1""")
def stm9_deliveries(spark, sf):
    rows = table(spark, sf, "session_log").groupBy("session_id", "id").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("entries"), (F.sum("n") - F.count(F.lit(1))).alias("delivered_again"))
