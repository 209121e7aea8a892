"""Further projections, filters, checks, joins, aggregates and sorts (PRJ, FLT, VAL, JN, AGG, SRT)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import structures as S
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import validation as V
from ..session import table
from .catalogue import query
from .logs import EVENTS, LOG, events, log


@query(f"""WITH {LOG} SELECT session_id, id, CASE type WHEN 'tool_use' THEN 'tool_use' WHEN 'tool_result' THEN 'tool_result' ELSE 'text' END AS block, CASE WHEN type IN ('tool_use', 'tool_result') THEN tool_use_id END AS ref, CASE type WHEN 'tool_use' THEN input WHEN 'tool_result' THEN output ELSE text END AS content, CASE WHEN type = 'tool_result' THEN coalesce(is_error, false) END AS is_error
FROM log WHERE type IN ('message', 'tool_use', 'tool_result')""")
def prj1_content_blocks(spark, sf):
    """Rows as the content blocks of a message on the wire."""
    rows = log(spark, sf, "type", "text", "tool_use_id", "input", "output", "is_error").filter("type in ('message', 'tool_use', 'tool_result')")
    block = S.content_block(F.col("type"), F.col("text"), F.col("tool_use_id"), F.col("input"), F.col("output"), F.col("is_error"))
    return rows.select("session_id", "id", block.alias("b")).select("session_id", "id", "b.*")


@query("""SELECT library_id, '{"name":"' || name || '"' || CASE WHEN pdf_dir IS NULL THEN '' ELSE ',"pdf_dir":"' || pdf_dir || '"' END || CASE WHEN utc_offset_minutes IS NULL THEN '' ELSE ',"utc_offset_minutes":' || utc_offset_minutes END || '}' AS payload FROM libraries""")
def prj2_event_payloads(spark, sf):
    return table(spark, sf, "libraries").select("library_id", S.dropped_nulls(F.struct("name", "pdf_dir", "utc_offset_minutes")).alias("payload"))


@query("SELECT ord + 1 AS page, sha256(text) AS sha FROM sections WHERE text IS NOT NULL")
def prj3_visible_pages(spark, sf):
    """Pages without what tells whose they are."""
    pages = table(spark, sf, "sections").filter("text is not null").select("section_id", "paper_id", (F.col("ord") + 1).alias("page"), "text")
    return J.without(pages, "section_id", "paper_id").select("page", F.sha2("text", 256).alias("sha"))


@query(f"""WITH {LOG} SELECT session_id, id, '[{{"b":' || input || ',"type":"text"}}]' AS blocks FROM (SELECT session_id, id, replace(replace(input, ': ', ':'), ', ', ',') AS input FROM log WHERE type = 'tool_use' AND json_keys(input) = ['page', 'query'] AND strpos(json_extract_string(input, '$.query'), ': ') + strpos(json_extract_string(input, '$.query'), ', ') = 0)""")
def prj5_uncached_blocks(spark, sf):
    """Blocks without their cache marks, at any depth."""
    u = log(spark, sf, "type", "input").filter("type = 'tool_use' and array_sort(json_object_keys(input)) = array('page', 'query') and json_object_keys(input) = array('page', 'query') and get_json_object(input, '$.query') not like '%: %' and get_json_object(input, '$.query') not like '%, %'")
    blocks = F.concat(F.lit('[{"type": "text", "cache_control": {"type": "ephemeral"}, "b": '), F.concat(F.substring(F.col("input"), F.lit(1), F.length("input") - 1), F.lit(', "cache_control": 1}')), F.lit("}]"))
    return u.select("session_id", "id", S.uncached_json(blocks).alias("blocks"))


@query(f"""WITH {LOG}, s AS (SELECT library_id, session_id, max_by(type, pos) AS type FROM log WHERE type IN ('turn_started', 'turn_completed', 'turn_aborted') GROUP BY 1, 2) SELECT library_id, CAST(count(*) FILTER (type = 'turn_started' AND session_id <> f) AS BIGINT) AS active FROM s JOIN (SELECT library_id AS l, min(session_id) AS f FROM s GROUP BY 1) x ON l IS NOT DISTINCT FROM library_id GROUP BY 1""")
def flt6_active_jobs(spark, sf):
    """Active sessions of each library beside its first one."""
    rows = log(spark, sf, "type", "library_id").filter(F.col("type").isin("turn_started", "turn_completed", "turn_aborted"))
    s = rows.groupBy("library_id", "session_id").agg(F.max_by("type", "pos").alias("type"))
    first = s.groupBy("library_id").agg(F.min("session_id").alias("f"), F.count_if(F.col("type") == "turn_started").alias("all"), F.min_by("type", "session_id").alias("t"))
    return first.select("library_id", (F.col("all") - F.when(F.col("t") == "turn_started", 1).otherwise(0)).alias("active"))


WRAPPED = "(SELECT section_id, CASE depth WHEN 1 THEN '<runtime_context>' || chr(10) || title || '</runtime_context> ' || chr(10) WHEN 2 THEN '<world_state mode=\"full\">' || title || '</world_state>' ELSE '<runtime_context>' || title END AS t FROM sections WHERE title IS NOT NULL)"


@query(f"SELECT section_id, (starts_with(t, '<runtime_context>' || chr(10)) AND ends_with(regexp_replace(t, '\\s+$', ''), '</runtime_context>')) OR (starts_with(t, '<world_state mode=\"') AND ends_with(regexp_replace(t, '\\s+$', ''), '</world_state>')) AS context FROM {WRAPPED}")
def flt10_runtime_context(spark, sf):
    t = F.when(F.col("depth") == 1, F.concat(F.lit("<runtime_context>\n"), "title", F.lit("</runtime_context> \n"))).when(F.col("depth") == 2, F.concat(F.lit('<world_state mode="full">'), "title", F.lit("</world_state>"))).otherwise(F.concat(F.lit("<runtime_context>"), "title"))
    return table(spark, sf, "sections").filter("title is not null").select("section_id", V.runtime_context(t).alias("context"))


@query("SELECT p_partkey FROM part WHERE p_size > 5 AND NOT (p_retailprice > 1500) AND p_brand IS NOT NULL AND NOT contains(p_type, 'TIN')")
def flt12_exposed_tools(spark, sf):
    """Parts as tools with four flags, offered while planning and reading."""
    t = table(spark, sf, "part").select("p_partkey", (F.col("p_size") > 5).alias("enabled"), (F.col("p_retailprice") > 1500).alias("internal"), F.col("p_type").contains("TIN").alias("writes"), F.col("p_brand").isNotNull().alias("needs_library"))
    return V.exposed(t, planning=True, reading=True).select("p_partkey")


@query("""WITH s AS (SELECT library_id, coalesce(list(paper_id) FILTER (arxiv_id IS NOT NULL), []) AS m, coalesce(list(DISTINCT paper_id) FILTER (arxiv_id IS NULL), []) AS x, list(DISTINCT paper_id) AS p, min(venue) AS reason FROM papers WHERE library_id IS NOT NULL GROUP BY 1)
SELECT library_id, CASE WHEN len(list_distinct(m)) < len(m) THEN 'members repeat' WHEN list_has_any(m, x) THEN 'members are excluded' WHEN list_sort(list_distinct(list_concat(m, x))) <> list_sort(p) THEN 'no partition of the parent' WHEN len(x) > 0 AND reason IS NULL THEN 'exclusions without a reason' END AS fault FROM s""")
def val3_set_faults(spark, sf):
    """Papers with an arXiv number as a set derived from the papers of their library."""
    p = table(spark, sf, "papers").filter("library_id is not null")
    s = p.groupBy("library_id").agg(F.collect_list(F.when(F.col("arxiv_id").isNotNull(), F.col("paper_id"))).alias("members"), F.collect_set(F.when(F.col("arxiv_id").isNull(), F.col("paper_id"))).alias("excluded"), F.collect_set("paper_id").alias("parent"), F.min("venue").alias("reason"))
    return V.set_faults(s, ["library_id"])


@query(f"""WITH {LOG}, r AS (SELECT session_id, id, pos, CASE type WHEN 'tool_use' THEN 'assistant' ELSE 'user' END AS role, CASE WHEN type = 'tool_use' THEN tool_use_id END AS c, CASE WHEN type = 'tool_result' THEN tool_use_id END AS t FROM log WHERE type IN ('tool_use', 'tool_result'))
SELECT session_id, id, coalesce(lag(role) OVER w <> role, true) AS alternates, coalesce(c = lead(t) OVER w, false) AS ids_agree FROM r WINDOW w AS (PARTITION BY session_id ORDER BY pos)""")
def val5_rounds(spark, sf):
    r = log(spark, sf, "type", "tool_use_id").filter("type in ('tool_use', 'tool_result')")
    one = lambda kind: F.array_compact(F.array(F.when(F.col("type") == kind, F.col("tool_use_id"))))
    rows = r.select("session_id", "id", "pos", F.when(F.col("type") == "tool_use", "assistant").otherwise("user").alias("role"), one("tool_use").alias("calls"), one("tool_result").alias("results"))
    return V.balanced_rounds(rows, ["session_id"], "pos", "role", "calls", "results").select("session_id", "id", "alternates", "ids_agree")


@query("SELECT paper_id, authors_summary FROM (SELECT DISTINCT paper_id, array_to_string(authors[1:2], '; ') || CASE WHEN len(authors) > 2 THEN '; ... ' || (len(authors) - 2) || ' more' ELSE '' END AS authors_summary FROM papers WHERE authors IS NOT NULL)")
def val6_summaries(spark, sf):
    """Lists cut to their first items; the authors of a paper play the errors."""
    return table(spark, sf, "papers").filter("authors is not null").select("paper_id", V.summary(F.col("authors"), 2).alias("authors_summary")).distinct()


@query("""SELECT session_id, id, rule FROM (SELECT session_id, id, unnest([CASE WHEN json_extract_string(input, '$.query') IS NULL OR json_extract_string(input, '$.query') = '' THEN 'query' END, CASE WHEN name = 'inspect_page' AND NOT coalesce(TRY_CAST(json_extract_string(input, '$.page') AS BIGINT) >= 1, false) THEN 'page' END, CASE WHEN name IS NULL THEN 'name' END]) AS rule FROM session_log WHERE type = 'tool_use') WHERE rule IS NOT NULL""")
def val7_argument_rules(spark, sf):
    """Rules for the arguments of a call that depend on what is called."""
    u = table(spark, sf, "session_log").filter("type = 'tool_use'")
    rules = {
        "query": F.coalesce(F.get_json_object("input", "$.query"), F.lit("")) != "",
        "page": (F.coalesce("name", F.lit("")) != "inspect_page") | (F.get_json_object("input", "$.page").try_cast("bigint") >= 1),
        "name": F.col("name").isNotNull(),
    }
    return V.violations(u, rules).select("session_id", "id", F.explode("violations").alias("rule"))


@query("""SELECT doc_id, CASE WHEN text IS NULL THEN 'missing' WHEN strlen(text) <> n_chars THEN 'size' ELSE 'hash' END AS fault FROM documents WHERE text IS NULL OR strlen(text) <> n_chars OR sha256(text) <> sha256(trim(text))""")
def val8_artifact_faults(spark, sf):
    """Texts against a manifest that counts characters and hashes trimmed texts: others than ASCII differ in size."""
    d = table(spark, sf, "documents")
    files = d.filter("text is not null").select("doc_id", F.octet_length("text").cast("bigint").alias("size"), F.sha2("text", 256).alias("sha256"))
    manifest = d.select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("size"), F.sha2(F.trim("text"), 256).alias("sha256"))
    return V.artifact_faults(files, manifest, "doc_id").select("doc_id", "fault")


@query("SELECT r.paper_id, r.pos, p.title FROM (SELECT paper_id, row_number() OVER (ORDER BY paper_id DESC) AS pos FROM (SELECT DISTINCT paper_id FROM contributions WHERE type = 'method')) r JOIN (SELECT paper_id, min(title) AS title FROM papers GROUP BY 1) p USING (paper_id)")
def jn3_retained(spark, sf):
    """Snapshots of the retained papers, in their order; the order is a number that the table brings."""
    ids = table(spark, sf, "contributions").filter("type = 'method'").select("paper_id").distinct()
    pos = A.global_numbers(ids, "paper_id", descending=True).withColumnRenamed("n", "pos")
    return J.retained(pos, table(spark, sf, "papers").groupBy("paper_id").agg(F.min("title").alias("title")), "paper_id", "pos")


@query("""WITH f AS (SELECT count(*) FILTER (n_chars IS NULL) > 0 AS partial FROM documents) SELECT paper_id FROM (SELECT DISTINCT paper_id FROM contributions WHERE paper_id IS NOT NULL) c, f WHERE NOT partial AND paper_id NOT IN (SELECT paper_id FROM sections WHERE text IS NOT NULL)
UNION ALL SELECT paper_id FROM (SELECT DISTINCT paper_id FROM papers WHERE paper_id IS NOT NULL) c WHERE (SELECT count(*) FILTER (title IS NULL AND ord < 0) = 0 FROM sections) AND paper_id NOT IN (SELECT paper_id FROM contributions WHERE type = 'method' AND paper_id IS NOT NULL)""")
def jn6_orphans(spark, sf):
    """Cache keys without a source, counted failures decide: documents without text make their scan partial and prune
    nothing; the sections have none."""
    d, s, c = table(spark, sf, "documents"), table(spark, sf, "sections"), table(spark, sf, "contributions")
    failed = d.agg(F.count_if(F.col("n_chars").isNull()).alias("failures"))
    none = s.agg(F.count_if(F.col("title").isNull() & (F.col("ord") < 0)).alias("failures"))
    keys = c.filter("paper_id is not null").select("paper_id").distinct()
    papers = table(spark, sf, "papers").filter("paper_id is not null").select("paper_id").distinct()
    one = J.orphans_of(keys, s.filter("text is not null").select("paper_id"), "paper_id", failed)
    return one.unionByName(J.orphans_of(papers, c.filter("type = 'method'").select("paper_id"), "paper_id", none))


@query("""WITH RECURSIVE b AS (SELECT c_custkey AS s, CASE WHEN c_custkey < 40 THEN (c_custkey + 1) % 40 WHEN c_custkey >= 80 THEN c_custkey // 2 END AS base FROM customer),
r AS (SELECT s, s AS source, CAST(0 AS BIGINT) AS depth FROM b UNION ALL SELECT r.s, b.base, depth + 1 FROM r JOIN b ON b.s = r.source WHERE b.base IS NOT NULL AND depth < 40),
m AS (SELECT s, source, min(depth) AS depth FROM r GROUP BY 1, 2)
SELECT s AS session, source, depth, CASE WHEN s < 40 THEN 'cycle' END AS error FROM m""")
def jn16_inherited(spark, sf):
    """Customers as sessions: the first forty take their rows from each other in a circle, later ones from that of half their number."""
    k = F.col("c_custkey")
    base = F.when(k < 40, (k + 1) % 40).when(k >= 80, F.floor(k / 2))
    c = table(spark, sf, "customer").select(k.alias("session"), base.alias("base"))
    return J.inherited(spark, c, "session", "base")


@query("""WITH m AS (SELECT 'library/' || library_id AS locator, min(paper_id) AS paper_id FROM papers WHERE library_id IS NOT NULL GROUP BY 1) SELECT l.library_id AS path, m.paper_id FROM libraries l LEFT JOIN m ON m.locator = 'library/' || l.library_id""")
def jn18_by_locator(spark, sf):
    p = table(spark, sf, "papers").filter("library_id is not null").select(F.concat(F.lit("library/"), "library_id").alias("locator"), "paper_id")
    return J.by_locator(table(spark, sf, "libraries").select(F.col("library_id").alias("path")), p, "path", "locator", "paper_id", "paper_id")


@query(f"""WITH {LOG}, j AS (SELECT session_id, max_by(type, pos) FILTER (type IN ('turn_started', 'turn_completed', 'turn_aborted')) = 'turn_started' AS running FROM log GROUP BY 1),
p AS (SELECT library_id, strlen(output) AS b, coalesce(running, false) AS running, received_at <= TIMESTAMPTZ '2031-06-01 00:00:00+00' AS old, output IS NULL AS gone FROM log JOIN j USING (session_id) WHERE type = 'tool_result')
SELECT library_id, CAST(count(*) AS BIGINT) AS payloads, CAST(coalesce(sum(b), 0) AS BIGINT) AS bytes, CAST(count(*) FILTER (gone) AS BIGINT) AS tombstones, CAST(count(*) FILTER (running) AS BIGINT) AS running, CAST(coalesce(sum(b) FILTER (running), 0) AS BIGINT) AS running_bytes,
 CAST(count(*) FILTER (old AND NOT gone) AS BIGINT) AS expired, CAST(count(*) FILTER (old AND NOT gone AND NOT running) AS BIGINT) AS candidates, CAST(coalesce(sum(b) FILTER (old AND NOT gone AND NOT running), 0) AS BIGINT) AS candidate_bytes FROM p GROUP BY 1""")
def agg4_library_report(spark, sf):
    """Counts and bytes of the payloads of each library: all, removed, of running sessions, expired, to be removed."""
    rows = log(spark, sf, "type", "output", "library_id", "received_at")
    last = rows.groupBy("session_id").agg(F.max_by("type", F.when(F.col("type").isin("turn_started", "turn_completed", "turn_aborted"), F.col("pos"))).alias("last"))
    p = rows.filter("type = 'tool_result'").join(last, "session_id")
    return A.retention_report(p, "library_id", F.octet_length("output").cast("bigint"), F.coalesce(F.col("last") == "turn_started", F.lit(False)), F.col("received_at") <= F.lit("2031-06-01T00:00:00Z").cast("timestamp"), F.col("output").isNull())


@query("SELECT library_id, list_sort(list(DISTINCT paper_id))[1:5] AS kept, CAST(count(DISTINCT paper_id) AS BIGINT) AS members, count(DISTINCT paper_id) > 5 AS over FROM papers WHERE paper_id IS NOT NULL GROUP BY 1")
def agg8_bounded_sets(spark, sf):
    """The members of each set up to a bound, and whether there were more."""
    b = A.bounded_set(table(spark, sf, "papers"), ["library_id"], "paper_id", 5)
    return b.select("library_id", F.col("items").alias("kept"), F.col("size").alias("members"), "over")


@query(f"""WITH {LOG}, j AS (SELECT session_id, coalesce(min(job_id), session_id) AS conversation, min(received_at) AS created, max(received_at) AS updated, min_by(text, pos) FILTER (type = 'message' AND role = 'user' AND text IS NOT NULL) AS question FROM log GROUP BY 1)
SELECT conversation, string_agg(session_id, ',' ORDER BY created, session_id) AS jobs, left(trim(string_split(min_by(question, struct_pack(a := created, b := session_id)) FILTER (question IS NOT NULL), chr(10))[1], ' '), 34) AS title, epoch_us(max(updated)) AS updated FROM j GROUP BY 1""")
def agg9_conversation_rollup(spark, sf):
    """Jobs by conversation, or alone: in order of creation, with the first line of the first question as title."""
    rows = log(spark, sf, "type", "role", "text", "job_id", "received_at")
    asked = (F.col("type") == "message") & (F.col("role") == "user") & F.col("text").isNotNull()
    j = rows.groupBy("session_id").agg(F.min("job_id").alias("conversation"), F.min("received_at").alias("created"), F.max("received_at").alias("updated"), F.min_by("text", F.when(asked, F.col("pos"))).alias("question"))
    return A.rollup_jobs(j, "session_id", "conversation", "created", "updated", "question").select("conversation", F.concat_ws(",", "jobs").alias("jobs"), "title", F.unix_micros(F.col("updated").cast("timestamp")).alias("updated"))


@query("SELECT library_id, CAST(count(DISTINCT paper_id) AS BIGINT) AS touched, CAST(sum(coalesce(input_tokens, 0)) AS BIGINT) AS spent, greatest(100000 - CAST(sum(coalesce(input_tokens, 0)) AS BIGINT), 0) AS remaining FROM session_log GROUP BY 1")
def agg11_budgets(spark, sf):
    s = table(spark, sf, "session_log").groupBy("library_id").agg(F.count_distinct("paper_id").alias("touched"), F.sum(F.coalesce("input_tokens", F.lit(0))).alias("spent"))
    return s.withColumn("remaining", F.greatest(F.lit(100_000) - F.col("spent"), F.lit(0)))


@query("SELECT doc_id FROM documents ORDER BY collected_at DESC, doc_id LIMIT 20")
def srt2_latest_reports(spark, sf):
    return table(spark, sf, "documents").orderBy(F.desc("collected_at"), "doc_id").limit(20).select("doc_id")


@query(f"WITH {EVENTS} SELECT user_id, string_agg(event_type, ',' ORDER BY seq) AS operations FROM e GROUP BY 1")
def srt3_operations_in_order(spark, sf):
    e = events(spark, sf)
    return e.groupBy("user_id").agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("seq", "event_type"))), lambda x: x["event_type"])).alias("operations"))


@query("SELECT paper_id, contribution_id, row_number() OVER (PARTITION BY paper_id ORDER BY coalesce(y1, 0.0), coalesce(x1, 0.0), extracted_at, contribution_id) AS place FROM (SELECT paper_id, contribution_id, extracted_at, CASE WHEN evidence_type IS NOT NULL THEN ord * 10.5 END AS y1, CASE WHEN type = 'method' THEN 3.5 END AS x1 FROM contributions)")
def srt5_formula_order(spark, sf):
    """Formulas from top to bottom and left to right; what has no place counts as at the top."""
    c = table(spark, sf, "contributions").select("paper_id", "contribution_id", "extracted_at", F.when(F.col("evidence_type").isNotNull(), F.col("ord") * 10.5).alias("y1"), F.when(F.col("type") == "method", 3.5).alias("x1"))
    by = Window.partitionBy("paper_id").orderBy(*A.reading_order("y1", "x1"), "extracted_at", "contribution_id")
    return c.select("paper_id", "contribution_id", F.row_number().over(by).alias("place"))


@query("""WITH h AS (SELECT section_id FROM sections WHERE contains(lower(text), 'method') ORDER BY section_id LIMIT 100), g AS (SELECT count(*) AS n FROM sections WHERE contains(lower(text), 'method')), x AS (SELECT section_id FROM sections WHERE contains(lower(text), 'tensor') ORDER BY section_id LIMIT 20)
SELECT 'text' AS search, section_id, n >= 100 AS truncated FROM h, g UNION ALL SELECT 'geometry', section_id, (SELECT count(*) > 20 FROM sections WHERE contains(lower(text), 'tensor')) FROM x""")
def srt6_bounded_searches(spark, sf):
    """The first hits in order; one search says that it is cut when it is full, the other when more were found."""
    s = table(spark, sf, "sections").select("section_id", F.lower("text").alias("t"))
    text = A.bounded_search(s.filter(F.col("t").contains("method")), ["section_id"], 100, full=True)
    geometry = A.bounded_search(s.filter(F.col("t").contains("tensor")), ["section_id"], 20, full=False)
    pick = lambda df, name: df.select(F.lit(name).alias("search"), "section_id", "truncated")
    return pick(text, "text").unionByName(pick(geometry, "geometry"))


@query("""SELECT o_orderkey, true AS has_more, 'first' AS page FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20) WHERE (SELECT count(*) FROM orders) > 20
UNION ALL SELECT n_nationkey, (SELECT count(*) FROM nation) > 30, 'whole' FROM nation UNION ALL SELECT n_nationkey, (SELECT count(*) FROM nation) > 25, 'exact' FROM (SELECT n_nationkey FROM nation ORDER BY 1 LIMIT 25)""")
def srt7_page(spark, sf):
    """Pages with a look ahead: one that has more behind it, one that is not full, and one that is just full."""
    pick = lambda rows, key, page: rows.select(F.col(key).alias("o_orderkey"), "has_more", F.lit(page).alias("page"))
    first, _ = A.page_of(table(spark, sf, "orders").select("o_orderkey"), [F.col("o_orderkey")], 20)
    nation = table(spark, sf, "nation").select("n_nationkey")
    whole, _ = A.page_of(nation, [F.col("n_nationkey")], 30)
    exact, _ = A.page_of(nation, [F.col("n_nationkey")], 25)
    return pick(first, "o_orderkey", "first").unionByName(pick(whole, "n_nationkey", "whole")).unionByName(pick(exact, "n_nationkey", "exact"))


@query(f"WITH {LOG} SELECT session_id, id, pos FROM log QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) <= 3")
def srt8_session_tails(spark, sf):
    """The last rows of each session."""
    return A.last_rows(log(spark, sf), ["session_id"], "pos", 3).select("session_id", "id", "pos")


@query("SELECT paper_id, n <= 10 AS prepared, sha256(paper_id) AS sha FROM (SELECT paper_id, row_number() OVER (ORDER BY paper_id) AS n FROM (SELECT DISTINCT paper_id FROM papers WHERE paper_id IS NOT NULL))")
def srt10_first_prepared(spark, sf):
    """All papers are hashed, the first ten in order are prepared."""
    p = table(spark, sf, "papers").filter("paper_id is not null").select("paper_id").distinct()
    first = p.orderBy("paper_id").limit(10).withColumn("prepared", F.lit(True))
    return p.join(F.broadcast(first), "paper_id", "left").select("paper_id", F.coalesce("prepared", F.lit(False)).alias("prepared"), F.sha2("paper_id", 256).alias("sha"))


@query("SELECT paper_id, array_to_string(authors[1:2], '; ') AS kept, greatest(len(authors) - 2, 0) AS omitted FROM papers WHERE authors IS NOT NULL")
def srt11_capped_lists(spark, sf):
    p = table(spark, sf, "papers").filter("authors is not null")
    return p.select("paper_id", F.concat_ws("; ", F.slice("authors", 1, 2)).alias("kept"), F.greatest(F.size("authors") - 2, F.lit(0)).cast("bigint").alias("omitted"))


_ = X
