"""Queries over document, chunk and section texts (STR, NUM1, WIN7, WIN10, JN20, AGG16, HSH1, FLT8, FLT9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parsers as P
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import windows as W
from ..session import table
from .catalogue import query


@query("SELECT sha256(text) AS sha, CAST(count(*) AS BIGINT) AS copies, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def hsh1_duplicate_content(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"))
    return d.groupBy("sha").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_doc")).filter("copies > 1")


GARBLE = "[\\x{FFFD}\\x{E000}-\\x{F8FF}\\x01-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"


@query(f"SELECT lang, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(length(text) - length(regexp_replace(replace(text, chr(0), ''), '{GARBLE}', '', 'g'))) AS BIGINT) AS garbled FROM documents WHERE text IS NOT NULL GROUP BY 1")
def agg16_garble_rate(spark, sf):
    d = table(spark, sf, "documents").filter(F.col("text").isNotNull() & ~F.col("text").contains("\x00"))
    return d.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.sum(X.garble_count(F.col("text"))).cast("bigint").alias("garbled"))


LINES = "l AS (SELECT section_id, CAST(i - 1 AS BIGINT) AS n, string_split(text, chr(10))[i] AS line FROM sections, unnest(generate_series(1, len(string_split(text, chr(10))))) t(i) WHERE text IS NOT NULL)"


def _lines(spark, sf):
    s = table(spark, sf, "sections").filter("text is not null")
    return s.select("section_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("n", F.col("n").cast("bigint"))


@query(f"WITH {LINES} SELECT section_id, CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (regexp_matches(line, '[\\x{{3400}}-\\x{{9FFF}}]|[A-Za-z]{{2,}}')) AS BIGINT) AS prose FROM l GROUP BY 1")
def flt8_prose_lines(spark, sf):
    return _lines(spark, sf).groupBy("section_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(X.has_prose(F.col("line"))).alias("prose"))


@query(f"""WITH {LINES}, m AS (SELECT section_id, n, regexp_matches(line, '[0-9]+\\.[0-9]') AS d, sum(CAST(line = '' AS INT)) OVER (PARTITION BY section_id ORDER BY n) AS walls FROM l),
 o AS (SELECT *, CASE WHEN n - lag(n) OVER w <= 3 AND walls = lag(walls) OVER w THEN 0 ELSE 1 END AS new FROM m WHERE d WINDOW w AS (PARTITION BY section_id ORDER BY n)), b AS (SELECT *, sum(new) OVER (PARTITION BY section_id ORDER BY n) AS b FROM o)
SELECT section_id, min(n) AS first_line, max(n) AS last_line, CAST(count(*) AS BIGINT) AS damaged FROM b GROUP BY section_id, b""")
def win7_blocks(spark, sf):
    """Blocks of lines with decimals, which stand in for damaged ones; blank lines are barriers."""
    rows = W.damage_blocks(_lines(spark, sf), ["section_id"], "n", F.col("line").rlike(r"[0-9]+\.[0-9]"), F.col("line") == "")
    return rows.select("section_id", "first_line", "last_line", "damaged")


@query("""WITH t AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, t, CASE WHEN len(t) <= 64 THEN 0 ELSE CAST(ceil((len(t) - 64) / 56.0) AS INT) END AS last FROM t WHERE len(t) > 0)
SELECT doc_id, CAST(k AS BIGINT) AS ord, CAST(k * 56 AS BIGINT) AS start, CAST(len(t[k * 56 + 1 : k * 56 + 64]) AS BIGINT) AS n_tokens FROM w, unnest(generate_series(0, last)) u(k)""")
def win10_token_windows(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null")
    return W.token_windows(d, "doc_id", F.filter(F.split("text", " "), lambda x: x != ""), 64, 8).select("doc_id", "ord", "start", "n_tokens")


@query(f"WITH {LINES} SELECT section_id, n AS line_no, CAST(length(line) AS BIGINT) AS chars FROM l WHERE contains(regexp_replace(lower(line), '[ \\t\\n\\x0B\\x0C\\r]+', ' ', 'g'), 'robust') ")
def jn20_line_search(spark, sf):
    s = table(spark, sf, "sections").filter("text is not null")
    return J.line_hits(s, ["section_id"], "text", "robust", 1 << 30).select("section_id", "line_no", F.length("line").cast("bigint").alias("chars"))


@query("SELECT doc_id, greatest(CAST(ceil(strlen(text) / 3) AS BIGINT), 1) AS tokens FROM documents WHERE text IS NOT NULL")
def num1_token_estimates(spark, sf):
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", X.token_estimate(F.col("text")).alias("tokens"))


@query("SELECT doc_id, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 80) || '…' END AS preview FROM documents WHERE text IS NOT NULL")
def str6_bounded(spark, sf):
    d = table(spark, sf, "documents").filter("text is not null")
    return d.select("doc_id", X.bounded(F.col("text"), 80).alias("preview"))


@query("SELECT section_id, lower(regexp_replace(title, '^\\s+|\\s+$', '', 'g')) AS title FROM sections WHERE title IS NOT NULL")
def str3_plain_keys(spark, sf):
    s = table(spark, sf, "sections").filter("title is not null")
    return s.select("section_id", X.plain_key(F.col("title")).alias("title"))


SECRETS = "(SELECT doc_id, 'Authorization: Bearer abc.' || doc_id || ' api_key=' || left(md5(CAST(doc_id AS VARCHAR)), 10) || '; sk-' || md5(CAST(doc_id AS VARCHAR)) || ' ' || coalesce(text, '') AS t FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[^\\x00-\\x7F]'))"


@query(f"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\\b(Bearer|Basic)\\s+[A-Za-z0-9._~+/=-]+', '\\1 [REDACTED]', 'gi'), '\\b(api[_-]?key|access[_-]?token|refresh[_-]?token|password|passwd|secret|authorization|cookie)(\\s*[:=]\\s*)([^\\s,;]+)', '\\1\\2[REDACTED]', 'gi'), '\\bsk-[A-Za-z0-9_-]{{8,}}\\b', '[REDACTED]', 'g') AS clean FROM {SECRETS}")
def str5_redacted(spark, sf):
    d = table(spark, sf, "documents")
    key = F.md5(F.col("doc_id").cast("string"))
    t = F.concat(F.lit("Authorization: Bearer abc."), F.col("doc_id").cast("string"), F.lit(" api_key="), F.substring(key, 1, 10), F.lit("; sk-"), key, F.lit(" "), F.coalesce("text", F.lit("")))
    # every text is redacted; the comparison is on ASCII ones, since word borders differ between the engines beyond
    return d.select("doc_id", "text", X.redacted(t).alias("clean")).filter(~F.coalesce(F.col("text").rlike(r"[^\x00-\x7F]"), F.lit(False))).select("doc_id", "clean")


@query("SELECT DISTINCT k AS name, regexp_matches(trim(regexp_replace(lower(k), '[^a-z0-9]+', '_', 'g'), '_'), '^(authorization|cookie|passwd|password|proxy_authorization|secret|set_cookie|token)$|(_api_key|_password|_secret|_token)$') AS sensitive FROM (SELECT unnest(['X-Api-Key', type, 'user ' || type || '-Token', 'cookie', 'Set-Cookie', 'Proxy-Authorization', ' Token ']) AS k FROM session_log)")
def flt7_sensitive_keys(spark, sf):
    names = table(spark, sf, "session_log").select("type").distinct().select(F.explode(F.array(F.lit("X-Api-Key"), F.col("type"), F.concat(F.lit("user "), "type", F.lit("-Token")), F.lit("cookie"), F.lit("Set-Cookie"), F.lit("Proxy-Authorization"), F.lit(" Token "))).alias("name")).distinct()
    return names.select("name", X.sensitive_key(F.col("name")).alias("sensitive"))


@query("SELECT session_id, id, nullif(trim(regexp_extract(text, '\\*\\*(.+?)\\*\\*', 1)), '') AS header FROM session_log WHERE type = 'reasoning' AND text IS NOT NULL")
def str18_headers(spark, sf):
    r = table(spark, sf, "session_log").filter("type = 'reasoning' and text is not null")
    return r.select("session_id", "id", X.bold_header(F.col("text")).alias("header"))


@query("SELECT session_id, id, CASE WHEN strpos(t, '{') > 0 AND strpos(t, '}') > 0 THEN substring(t, strpos(t, '{'), length(t) - strpos(reverse(t), '}') + 2 - strpos(t, '{')) END AS object FROM (SELECT session_id, id, 'say ' || input || ' end' AS t FROM session_log WHERE input IS NOT NULL)")
def str19_json_objects(spark, sf):
    r = table(spark, sf, "session_log").filter("input is not null").withColumn("t", F.concat(F.lit("say "), "input", F.lit(" end")))
    return r.select("session_id", "id", X.json_object(F.col("t")).alias("object"))


@query("SELECT session_id, id, list_sort(list_distinct(regexp_extract_all(text, '\\[[A-Za-z0-9_-]{3,64}:[A-Za-z_][A-Za-z0-9_.\\[\\]-]*\\]'))) [1] AS ref, CAST(len(list_distinct(regexp_extract_all(text, '\\[[A-Za-z0-9_-]{3,64}:[A-Za-z_][A-Za-z0-9_.\\[\\]-]*\\]'))) AS BIGINT) AS refs FROM session_log WHERE type = 'message' AND text IS NOT NULL")
def str15_evidence(spark, sf):
    m = table(spark, sf, "session_log").filter("type = 'message' and text is not null").withColumn("r", F.array_sort(X.evidence_refs(F.col("text"))))
    return m.select("session_id", "id", F.try_element_at("r", F.lit(1)).alias("ref"), F.size("r").cast("bigint").alias("refs"))


@query("SELECT p_partkey, regexp_replace(lower(regexp_replace('ABCDEF+' || p_name || '-Bold,' || p_type, '^[A-Z]{6}\\+', '')), '[^a-z0-9]', '', 'g') AS font FROM part")
def str22_font_names(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", X.font_name(F.concat(F.lit("ABCDEF+"), "p_name", F.lit("-Bold,"), "p_type")).alias("font"))


@query("SELECT paper_id, CAST(max(ord) AS BIGINT) AS pages FROM sections GROUP BY 1 HAVING max(ord) >= 1")
def str23_labelled_numbers(spark, sf):
    t = table(spark, sf, "sections").groupBy("paper_id").agg(F.concat(F.lit("Title: x\nPages: "), F.max("ord").cast("string"), F.lit("\nRotation: 0")).alias("info"))
    return t.select("paper_id", X.labelled_number(F.col("info"), "Pages").alias("pages")).filter("pages is not null")



@query("SELECT section_id, sha256(string_agg(text, chr(10) || chr(10))) AS sha FROM sections WHERE text IS NOT NULL GROUP BY 1")
def src13_page_text(spark, sf):
    from ..sources.logs import page_range

    s = table(spark, sf, "sections").filter("text is not null").select("section_id", F.col("ord").alias("page"), "text")
    return page_range(s, ["section_id"], F.lit(0), F.lit(1 << 40)).select("section_id", F.sha2("text", 256).alias("sha"))


@query("SELECT paper_id, CAST(i AS BIGINT) AS page, CAST(length(string_split(t, chr(12))[i]) AS BIGINT) AS chars FROM (SELECT paper_id, string_agg(replace(coalesce(text, ''), chr(12), ' '), chr(12) ORDER BY ord, section_id) AS t FROM sections GROUP BY 1), unnest(generate_series(1, len(string_split(t, chr(12))))) u(i)")
def src15_pages(spark, sf):
    from ..sources.logs import pages_of

    s = table(spark, sf, "sections").withColumn("k", F.struct("ord", "section_id")).withColumn("t", F.translate(F.coalesce("text", F.lit("")), "\f", " "))
    # a closing form feed ends the last page and opens none
    whole = s.groupBy("paper_id").agg(F.concat(A.text_of("t", "k", "\f"), F.lit("\f")).alias("t"))
    return pages_of(whole, ["paper_id"], "t").select("paper_id", "page", F.length("text").cast("bigint").alias("chars"))


@query()
def str1_search_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.search_key(F.col("text")).alias("key"), X.query_fingerprint(F.col("text")).alias("fingerprint"))


@query("""SELECT doc_id, CASE WHEN strlen(text) <= 200 THEN text ELSE left(text, (SELECT CAST(max(k) AS INT) FROM range(0, 101) t(k) WHERE strlen(left(text, CAST(k AS INT))) <= 100)) || chr(10) || '[... shortened ...]' || chr(10) || right(text, (SELECT CAST(max(k) AS INT) FROM range(0, 101) t(k) WHERE k = 0 OR strlen(right(text, CAST(k AS INT))) <= 100)) END AS text FROM documents""")
def str7_head_and_tail(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.head_and_tail(F.col("text"), 50).alias("text"))


_CODES = [i for i in range(1, 32) if i not in (9, 10, 11, 12, 13, 28, 29, 30)]


@query("SELECT doc_id, translate(replace(text, chr(0), chr(9216)), " + " || ".join(f"chr({i})" for i in [*_CODES, 127]) + ", '" + "".join(chr(0x2400 + i) for i in _CODES) + "␡') AS text FROM documents")
def str9_visible_controls(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.visible_controls(F.col("text")).alias("text"))


@query()
def str14_masked(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.masked_signature(F.col("text")).alias("signature"))


@query()
def str16_markdown(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.posexplode(P.markdown("text")).alias("ord", "b")).select("doc_id", "ord", "b.kind", "b.level", "b.text")


@query("""SELECT session_id, id, unnest(['paper search "a; b"', 'cat ' || tool_use_id, 'wc -l', '(x; y)']) AS part, CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS ord FROM session_log WHERE type = 'tool_use' AND tool_use_id IS NOT NULL""")
def str12_shell(spark, sf):
    u = table(spark, sf, "session_log").filter("type = 'tool_use'")
    command = F.concat(F.lit("paper search \"a; b\" && cat "), "tool_use_id", F.lit(" | wc -l; (x; y)"))
    return u.select("session_id", "id", F.posexplode(P.shell_segments(command)).alias("ord", "part")).withColumn("ord", F.col("ord").cast("bigint"))


@query()
def str20_diffs(spark, sf):
    from pyspark.sql import Window

    c = table(spark, sf, "contributions").withColumn("before", F.lag("claim").over(Window.partitionBy("paper_id").orderBy("ord", "contribution_id")))
    return c.select("contribution_id", P.unified_diff("before", "claim").alias("diff"))
