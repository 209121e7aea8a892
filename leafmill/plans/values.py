"""Further queries over texts, numbers, JSON values, character maps and extension points (STR, NUM, DT, JSN, MAP, ARR, UDF)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import extend as U
from ..functions import parsers as P
from ..functions import structures as S
from ..functions import text as X
from ..session import table
from .catalogue import query
from .logs import EVENTS, LOG, events, log

ASCII = "regexp_full_match(title, '[\\x20-\\x7E]*')"


@query(f"SELECT paper_id, sha256(lower(regexp_replace(trim(title, ' '), ' +', ' ', 'g'))) AS fingerprint FROM (SELECT DISTINCT paper_id, title FROM papers WHERE {ASCII}) UNION ALL SELECT DISTINCT paper_id, 'other' FROM papers WHERE NOT {ASCII}")
def str2_query_fingerprints(spark, sf):
    """Hashes of titles; those with other letters are hashed as well, but SQL has no case folding to compare them by."""
    p = table(spark, sf, "papers").filter("title is not null").select("paper_id", "title").distinct().withColumn("h", X.query_fingerprint(F.col("title")))
    plain = p.filter(F.col("title").rlike("^[ -~]*$")).select("paper_id", F.col("h").alias("fingerprint"))
    other = p.filter(~F.col("title").rlike("^[ -~]*$")).select("paper_id", F.when(F.length("h") == 64, "other").alias("fingerprint")).distinct()
    return plain.unionByName(other)


@query("SELECT doc_id, CASE WHEN length(text) <= 2000 THEN 'whole' ELSE 'truncated' END AS status, CASE WHEN length(text) > 2000 THEN sha256(left(text, 1500)) END AS preview, CASE WHEN length(text) > 2000 THEN CAST(length(text) AS BIGINT) END AS original_length, sha256(text) AS sha FROM documents WHERE text IS NOT NULL")
def str8_capped(spark, sf):
    """The envelope of a long text, read back, and the hash of what it stands for."""
    d = table(spark, sf, "documents").filter("text is not null").select("doc_id", "text", X.capped(F.col("text"), 2000).alias("c"))
    long = F.length("text") > 2000
    v = F.when(long, F.try_parse_json("c"))
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    reason = get("$.reason", "string") == "tool output exceeded its application-defined context limit"
    return d.select(
        "doc_id", F.when(~long, F.lit("whole")).when(reason, get("$.status", "string")).alias("status"), F.when(long, F.sha2(get("$.preview", "string"), 256)).alias("preview"),
        F.when(long, get("$.original_length", "bigint")).alias("original_length"), F.when(long, get("$.sha256", "string")).otherwise(F.sha2("c", 256)).alias("sha"),
    )


@query("SELECT section_id, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS source_lines, CAST(len(list_filter(string_split(text, chr(10)), lambda x: contains(x, '[') )) AS BIGINT) AS damaged FROM sections WHERE length(trim(text, ' ' || chr(10))) > 0 AND NOT regexp_matches(text, '[\\x0B\\x0C\\x0D\\x1C-\\x1F\\x{85}\\x{2028}\\x{2029}]') AND NOT ends_with(text, chr(10))")
def str10_rendered_pages(spark, sf):
    """Pages with marked runs of damaged lines (here those with a bracket): lines of the source, and those marked as raw."""
    s = table(spark, sf, "sections").filter(~F.col("text").rlike("[\\x0B\\x0C\\x0D\\x1C-\\x1F\\x{85}\\x{2028}\\x{2029}]") & ~F.col("text").endswith("\n") & (F.length(F.trim(F.translate("text", "\n", " "))) > 0))
    damaged = F.transform(F.split("text", "\n"), lambda x: x.contains("["))
    page = F.split(X.page_lines(F.col("text"), F.lit(1), damaged), "\n")
    inner = F.filter(page, lambda x: ~x.rlike(r"^\[\[(page:1|damaged page=1|damaged end)\]\]$") & (x != "[formula text may be garbled]"))
    # the marker's blank line and the end of the last line stand beside the lines of the source
    return s.select("section_id", (F.size(inner) - 2).cast("bigint").alias("source_lines"), F.size(F.filter(page, lambda x: x.startswith("raw: "))).cast("bigint").alias("damaged"))


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(0))")
def str11_valid_text(spark, sf):
    """Texts from their bytes; a lone surrogate can only be in bytes, which the tests show."""
    d = table(spark, sf, "documents").filter("text is not null")
    return d.select("doc_id", X.without_surrogates(F.encode("text", "utf-8")).alias("text")).filter(~F.col("text").contains("\x00"))


@query("SELECT section_id, 'search' AS operation, CAST(2 AS BIGINT) AS arguments, title AS needle FROM sections WHERE title IS NOT NULL AND NOT regexp_matches(title, '[''\"\\\\$`]') UNION ALL SELECT section_id, NULL, NULL, NULL FROM sections WHERE title IS NULL OR regexp_matches(title, '[''\"\\\\$`]')")
def str13_commands(spark, sf):
    """Search commands for titles; one with a quote in it stays unbalanced or says something else and is left out here."""
    s = table(spark, sf, "sections")
    odd = F.col("title").isNull() | F.col("title").rlike("['\"\\\\$`]")
    c = P.command(F.when(~odd, F.concat(F.lit("paper search a.pdf \""), "title", F.lit("\""))))
    return s.select("section_id", c.alias("c")).select("section_id", "c.operation", F.when(F.col("c.operation").isNotNull(), F.size("c.arguments")).cast("bigint").alias("arguments"), F.get("c.arguments", F.lit(1)).alias("needle"))


@query("SELECT section_id, 'so x_' || ord || ' holds' AS rest, 'x_' || ord AS math FROM sections")
def str17_inline_math(spark, sf):
    """A line with a formula in it, taken apart: the text without signs, and the formula."""
    line = F.concat(F.lit("so $x_"), F.col("ord").cast("string"), F.lit("$ holds"))
    s = table(spark, sf, "sections").select("section_id", P.math_pieces(line).alias("p"))
    return s.select("section_id", F.concat_ws("", F.transform("p", lambda x: x["text"])).alias("rest"), F.concat_ws("", F.transform(F.filter("p", lambda x: x["kind"] == "math"), lambda x: x["text"])).alias("math"))


@query("SELECT p_partkey, CASE WHEN p_size > 10 THEN '1.' || p_size END AS version, CASE WHEN p_size > 10 THEN p_name END AS description FROM part")
def str21_skill_headers(spark, sf):
    """Headers with a version and a description; small parts declare two versions and have none."""
    p = table(spark, sf, "part")
    version = F.concat(F.lit("version: 1."), F.col("p_size").cast("string"), F.lit("\n"))
    text = F.concat(F.lit("---\nname: skill\n"), version, F.when(F.col("p_size") > 10, F.lit("")).otherwise(version), F.lit("description: "), "p_name", F.lit("\n---\nBody.\n"))
    return p.select("p_partkey", X.skill_header(text, F.lit("skill")).alias("h")).select("p_partkey", "h.version", "h.description")


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS width, CAST(p_partkey % 65536 AS BIGINT) AS height FROM part")
def str24_image_sizes(spark, sf):
    p = table(spark, sf, "part")
    number = lambda c: F.lpad(F.hex(c.cast("bigint")), 8, "0")
    head = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(F.col("p_size")), number(F.col("p_partkey") % 65536)))
    return p.select("p_partkey", X.png_size(head).alias("s")).select("p_partkey", "s.width", "s.height")


@query("""SELECT paper_id, form, CASE form WHEN 4 THEN '$' || t || '$' WHEN 6 THEN '\\(' || t ELSE t END AS latex FROM (SELECT DISTINCT paper_id, trim(title, ' ') AS t FROM papers WHERE title IS NOT NULL AND trim(title, ' ') <> ''), (VALUES (0), (1), (2), (3), (4), (5), (6)) f(form)""")
def str25_bare_latex(spark, sf):
    """Titles between every pair of signs, between two pairs, without any, and with one side only."""
    t = table(spark, sf, "papers").filter("trim(title) <> ''").select("paper_id", F.trim("title").alias("t")).distinct()
    forms = [("$", "$"), ("\\(", "\\)"), ("\\[", "\\]"), ("$$", "$$"), ("$$$", "$$$"), ("", ""), ("\\(", "")]
    rows = t.select("paper_id", F.explode(F.array(*[F.struct(F.lit(i).alias("form"), F.concat(F.lit(a), "t", F.lit(b)).alias("x")) for i, (a, b) in enumerate(forms)])).alias("f"))
    return rows.select("paper_id", "f.form", X.bare_latex(F.col("f.x")).alias("latex"))


@query("SELECT doc_id, CASE WHEN source = 'chat_reports' AND length(text) > 400 THEN '… ' || right(text, 400) ELSE text END AS tail FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(0))")
def str26_tails(spark, sf):
    """Growing texts, here the chat reports, show their end behind a notice; others are whole."""
    d = table(spark, sf, "documents").filter("text is not null")
    return d.select("doc_id", X.tail(F.col("text"), F.coalesce(F.col("source") == "chat_reports", F.lit(False)), 400).alias("tail")).filter(~F.col("tail").contains("\x00"))


@query("SELECT p_partkey, '/lib/' || p_brand || ';/opt/' || p_size AS paths FROM part")
def str27_linked_paths(spark, sf):
    listing = F.concat(F.lit("cmd LC_ID\n path /no\ncmd LC_RPATH\n size 9\n path /lib/"), "p_brand", F.lit(" (offset 12)\n path /never\ncmd LC_RPATH\n path /opt/"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", F.concat_ws(";", X.values_after(listing, "cmd LC_RPATH", "path ", " (offset")).alias("paths"))


@query("SELECT p_partkey, CAST(p_size * 1000 * 95 // 100 AS BIGINT) AS working, CAST(p_size * 1000 * 90 // 100 AS BIGINT) AS trigger FROM part UNION ALL SELECT -1, 258400, 244800")
def num4_context_limits(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 1000).cast("bigint").alias("w"))
    whole = spark.range(1).select(F.lit(-1).cast("bigint").alias("p_partkey"), F.lit(272_000).cast("bigint").alias("w"))
    return p.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "w").unionByName(whole).select("p_partkey", X.context_limits(F.col("w")).alias("l")).select("p_partkey", "l.working", "l.trigger")


@query("SELECT l_orderkey, l_linenumber, CAST(least(floor(1800 * greatest(1.0, 700.0 / greatest(l_quantity * 20, 1.0), 180.0 / greatest(l_discount * 1000, 1.0)) + 0.5), 3600) AS BIGINT) AS scale FROM lineitem")
def num5_render_scales(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.render_scale(F.col("l_quantity") * 20, F.col("l_discount") * 1000, ).alias("scale"))


@query("SELECT l_orderkey, l_linenumber, greatest(1, CAST(trunc(l_discount * 2000) AS INT) - CAST(trunc(l_tax * 2000) AS INT)) AS px FROM lineitem")
def num8_pixels(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.pixels(F.col("l_tax"), F.col("l_discount"), F.lit(2000)).alias("px"))


@query("SELECT event_id, ts <= TIMESTAMP '2024-02-01' - INTERVAL 10 DAY AS expired FROM events")
def dt2_cutoffs(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", X.expired(F.col("ts").cast("timestamp"), F.lit("2024-02-01T00:00:00Z").cast("timestamp"), 10).alias("expired"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS iso FROM events")
def dt3_iso_times(spark, sf):
    return table(spark, sf, "events").select("event_id", X.iso_time(F.unix_micros(F.col("ts").cast("timestamp"))).alias("iso"))


@query("SELECT event_id, strftime(ts, '%Y%m%dT%H%M%S') AS stamp FROM events")
def dt4_stamps(spark, sf):
    return table(spark, sf, "events").select("event_id", X.stamp(F.col("ts").cast("timestamp")).alias("stamp"))


@query("SELECT session_id, id, sha256(input) AS sha FROM (SELECT session_id, id, '{' || array_to_string(list_transform(list_sort(json_keys(input)), lambda k: '\"' || k || '\":' || CAST(json_extract(input, k) AS VARCHAR)), ',') || '}' AS input FROM session_log WHERE input IS NOT NULL AND regexp_full_match(input, '[\\x20-\\x7E]*'))")
def hsh3_ascii_sha(spark, sf):
    s = table(spark, sf, "session_log").filter("input is not null").filter(F.col("input").rlike("^[ -~]*$"))
    return s.select("session_id", "id", S.canonical_sha_ascii("input").alias("sha"))


KEYED = "(SELECT *, CASE event_type WHEN 'view' THEN '{\"a\":1,\"b\":{\"k\":' || k || '}}' WHEN 'click' THEN '{\"b\":{\"k\":' || k || ',\"m\":[null]}}' ELSE '{\"a\":1}' END AS doc FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM e))"


def _documents(spark, sf):
    """Each event's document: with two fields, with a nested list, or with one field only, so that fields come and go."""
    e = events(spark, sf).withColumn("k", F.get_json_object("props", "$.k"))
    doc = F.when(F.col("event_type") == "view", F.concat(F.lit('{"a":1,"b":{"k":'), "k", F.lit("}}"))).when(F.col("event_type") == "click", F.concat(F.lit('{"b":{"k":'), "k", F.lit(',"m":[null]}}'))).otherwise(F.lit('{"a":1}'))
    return e.withColumn("doc", doc)


@query(f"""WITH {EVENTS}, d AS {KEYED}, l AS (SELECT *, lag(doc) OVER w AS old, lag(event_type) OVER w AS o, lag(k) OVER w AS ok FROM d WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
t AS (SELECT *, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'x' END AS n, CASE WHEN o IN ('view', 'click') THEN o ELSE 'x' END AS p FROM l)
SELECT event_id, CASE WHEN old IS NULL THEN doc WHEN old = doc THEN NULL WHEN n = 'x' THEN CASE p WHEN 'view' THEN '{{"b":null}}' ELSE '{{"a":1,"b":null}}' END WHEN p = 'x' THEN CASE n WHEN 'view' THEN '{{"b":{{"k":' || k || '}}}}' ELSE '{{"a":null,"b":{{"k":' || k || ',"m":[null]}}}}' END
 WHEN p = n THEN '{{"b":{{"k":' || k || '}}}}' WHEN n = 'view' THEN '{{"a":1,"b":{{' || CASE WHEN k = ok THEN '' ELSE '"k":' || k || ',' END || '"m":null}}}}' ELSE '{{"a":null,"b":{{' || CASE WHEN k = ok THEN '' ELSE '"k":' || k || ',' END || '"m":[null]}}}}' END AS patch FROM t""")
def jsn1_patches(spark, sf):
    """What changes between the documents of a user: fields that come, go, or change inside."""
    e = _documents(spark, sf).withColumn("old", F.lag("doc").over(Window.partitionBy("user_id").orderBy("seq")))
    return e.select("event_id", S.patch_between("old", "doc").alias("patch"))


@query(f"WITH {EVENTS}, d AS {KEYED} SELECT event_id, doc FROM d")
def jsn2_patched(spark, sf):
    """A document after the patch that leads to it from the one before is the document."""
    e = _documents(spark, sf).withColumn("old", F.lag("doc").over(Window.partitionBy("user_id").orderBy("seq")))
    return e.withColumn("patch", S.patch_between("old", "doc")).select("event_id", S.patched("old", "patch").alias("doc"))


@query("SELECT library_id, '{\"d\":{\"l\":[null],\"o\":' || utc_offset_minutes || '}' || CASE WHEN pdf_dir IS NULL THEN '' ELSE ',\"p\":\"' || pdf_dir || '\"' END || '}' AS value FROM libraries WHERE utc_offset_minutes IS NOT NULL")
def jsn3_without_nulls(spark, sf):
    p = F.when(F.col("pdf_dir").isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), "pdf_dir", F.lit('"')))
    text = F.concat(F.lit('{"p":'), p, F.lit(',"d":{"x":null,"l":[null],"o":'), F.col("utc_offset_minutes").cast("string"), F.lit("}}"))
    return table(spark, sf, "libraries").filter("utc_offset_minutes is not null").select("library_id", S.no_null_fields(text).alias("value"))


@query("SELECT p_partkey, '{\"properties\":{\"p\":{\"maximum\":' || p_size || ',\"title\":\"t\",\"type\":\"integer\"}}}' AS schema FROM part")
def jsn4_inlined_schemas(spark, sf):
    text = F.concat(F.lit('{"$defs":{"s":{"type":"integer","title":"old","maximum":'), F.col("p_size").cast("string"), F.lit('}},"properties":{"p":{"$ref":"#/$defs/s","title":"t"}}}'))
    return table(spark, sf, "part").select("p_partkey", S.inlined_schema(text).alias("schema"))


@query("""SELECT p_partkey, '{"Set-Cookie":"[REDACTED]","deep":{"a":{"a":{"a":{"a":{"a":{"a":{"a":{"_trace_value":"max_depth"}}}}}}}},"list":[' || array_to_string(list_transform(range(50), lambda i: CAST(i AS VARCHAR)), ',') || ',{"_trace_value":"truncated_items","omitted":1}],"n":' || p_size || ',"note":"Bearer [REDACTED] then token=x; password=[REDACTED], ok","user":{"api_key":"k","my_token":"[REDACTED]"}}' AS payload FROM part""")
def jsn5_sanitized(spark, sf):
    """Secrets by field name and inside texts, a chain too deep, and a list of one item too many."""
    deep = '{"a":' * 9 + "1" + "}" * 9
    text = F.concat(
        F.lit('{"Set-Cookie":"sid=1","note":"Bearer abcdefgh then token=x; password=hunter2, ok","user":{"my_token":"t","api_key":"k"},"list":['), F.lit(",".join(map(str, range(51)))),
        F.lit(f'],"deep":{deep},"n":'), F.col("p_size").cast("string"), F.lit("}"),
    )
    return table(spark, sf, "part").select("p_partkey", S.sanitized_payload(text).alias("payload"))


@query("SELECT session_id, id, CAST(length(json_extract_string(input, '$.query')) AS BIGINT) AS query_length, json_type(input, '$.page') IN ('UBIGINT', 'BIGINT') AS has_page FROM session_log WHERE input IS NOT NULL")
def jsn12_shapes(spark, sf):
    """Types and lengths of the arguments of calls, without what they say."""
    s = table(spark, sf, "session_log").filter("input is not null").select("session_id", "id", S.content_shape("input").alias("s"))
    return s.select("session_id", "id", F.get_json_object("s", "$.query.str").cast("bigint").alias("query_length"), F.when(F.get_json_object("s", "$.page").isNotNull(), F.get_json_object("s", "$.page") == "int").alias("has_page"))


@query("SELECT p_partkey, '{\"new\":\"' || p_brand || '\",\"old\":1,\"size\":' || (p_size + 1) || '}' AS m FROM part")
def jsn6_joined_maps(spark, sf):
    """Attributes of a start and an end, the later value wins."""
    p = table(spark, sf, "part")
    both = S.joined_maps(F.create_map(F.lit("size"), F.col("p_size"), F.lit("old"), F.lit(1)), F.create_map(F.lit("size"), F.col("p_size") + 1))
    get = lambda k: F.try_element_at(both, F.lit(k)).cast("string")
    return p.select("p_partkey", F.concat(F.lit('{"new":"'), "p_brand", F.lit('","old":'), get("old"), F.lit(',"size":'), get("size"), F.lit("}")).alias("m"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN sha256(p_name) END AS sha FROM part")
def jsn8_tombstone_hashes(spark, sf):
    p = table(spark, sf, "part")
    stone = F.to_json(F.struct(F.when(F.col("p_size") > 25, S.TOMBSTONE).otherwise("truncated_string").alias("_trace_value"), F.sha2("p_name", 256).alias("original_value_sha256")))
    return p.select("p_partkey", S.tombstone_sha(stone).alias("sha"))


@query("SELECT p_partkey, '[{\"text\":\"' || p_brand || '\",\"type\":\"text\"},{\"image_url\":{\"url\":\"<image data URL omitted: ' || (22 + length(p_name)) || ' chars>\"},\"type\":\"image_url\"},{\"image_url\":\"https://x.test/1.png\"}]' AS blocks FROM part")
def jsn9_without_images(spark, sf):
    text = F.concat(F.lit('[{"type":"text","text":"'), "p_brand", F.lit('"},{"type":"image_url","image_url":{"url":"data:image/png;base64,'), "p_name", F.lit('"}},{"image_url":"https://x.test/1.png"}]'))
    return table(spark, sf, "part").select("p_partkey", S.without_images(text).alias("blocks"))


@query(f"WITH {LOG} SELECT session_id, id, CASE type WHEN 'tool_use' THEN 'assistant' ELSE role END AS role, sha256(CASE WHEN type = 'message' THEN nullif(text, '') END) AS content, CASE WHEN type = 'tool_use' THEN name END AS called, CASE WHEN type = 'tool_use' THEN sha256(input) END AS arguments FROM log WHERE type IN ('message', 'tool_use')")
def jsn11_provider_messages(spark, sf):
    """Messages and calls in a provider's form, read back."""
    rows = log(spark, sf, "type", "role", "text", "tool_use_id", "name", "input").filter("type in ('message', 'tool_use')")
    call = F.col("type") == "tool_use"
    calls = F.array_compact(F.array(F.when(call, F.struct(F.col("tool_use_id").alias("id"), "name", F.col("input").alias("arguments")))))
    m = S.provider_message(F.when(call, "assistant").otherwise(F.col("role")), F.when(~call, F.col("text")), calls)
    v = F.try_parse_json(m)
    get = lambda path: F.try_variant_get(v, path, "string")
    return rows.select("session_id", "id", get("$.role").alias("role"), F.sha2(get("$.content"), 256).alias("content"), get("$.tool_calls[0].function.name").alias("called"), F.sha2(get("$.tool_calls[0].function.arguments"), 256).alias("arguments"))


# ---- character maps: a brand is a font, a part a glyph, its size its code point


def _glyphs(spark, sf):
    p = table(spark, sf, "part").withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1)
    return p.select(F.col("p_brand").alias("font"), F.col("r").cast("int").alias("gid"), F.col("p_type").alias("name"), (F.col("p_size") + 64).alias("codepoint"))


GLYPHS = "g AS (SELECT p_brand AS font, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS gid, p_type AS name, p_size + 64 AS codepoint FROM part)"


@query(f"""WITH {GLYPHS}, s AS (SELECT font, CASE WHEN font LIKE '%1' THEN 'identity' WHEN font LIKE '%2' THEN 'missing' ELSE 'stream' END AS source FROM (SELECT DISTINCT font FROM g))
SELECT font, gid AS cid, codepoint FROM g JOIN s USING (font) WHERE source = 'identity' UNION ALL SELECT g.font, g.gid * 2, coalesce(h.codepoint, 65533) FROM g JOIN s ON s.font = g.font AND source = 'stream' LEFT JOIN g h ON h.font = g.font AND h.gid = g.gid + 5 WHERE g.gid * 2 <= 65535""")
def map2_by_cid(spark, sf):
    g = _glyphs(spark, sf)
    source = F.when(F.col("font").endswith("1"), "identity").when(F.col("font").endswith("2"), "missing").otherwise("stream")
    cids = g.select("font", source.alias("source"), (F.col("gid") * 2).alias("cid"), (F.col("gid") + 5).alias("gid"))
    return S.by_cid(g.select("font", "gid", "codepoint"), cids, "font")


@query(f"""WITH {GLYPHS}, s AS (SELECT font, gid AS cid, codepoint + 57344 AS codepoint FROM g), r AS (SELECT font, cid, CASE WHEN codepoint > 57430 AND cid < 3 THEN codepoint ELSE 32 END AS codepoint FROM s),
c AS (SELECT s.font, s.codepoint FROM s JOIN r USING (font, cid) GROUP BY 1, 2 HAVING bool_and(r.codepoint <> s.codepoint)), o AS (SELECT codepoint, min(font) AS font FROM s GROUP BY 1 HAVING count(DISTINCT font) = 1) SELECT c.font, c.codepoint FROM c JOIN o USING (font, codepoint)""")
def map4_removable_controls(spark, sf):
    s = _glyphs(spark, sf).select("font", F.col("gid").alias("cid"), (F.col("codepoint") + 57344).alias("codepoint"))
    r = s.withColumn("codepoint", F.when((F.col("codepoint") > 57430) & (F.col("cid") < 3), F.col("codepoint")).otherwise(32))
    return S.removable_controls(s, r, s.select("font", "codepoint"), "font")


@query(f"""WITH {GLYPHS} SELECT font, gid, CASE WHEN codepoint % 2 = 0 THEN codepoint + 800 ELSE 65533 END AS codepoint FROM g WHERE codepoint % 2 = 0 OR gid <> 0""")
def map5_symbols(spark, sf):
    """Even code points have a name of the symbol form, and the encoding knows them all; others have another name."""
    g = _glyphs(spark, sf)
    name = F.when(F.col("codepoint") % 2 == 0, F.concat(F.lit("uniF0"), F.lpad(F.hex("codepoint"), 2, "0"))).otherwise("other")
    encoding = spark.range(256).select(F.col("id").cast("int").alias("code"), (F.col("id") + 800).cast("int").alias("codepoint"))
    return S.symbol_mapping(g.select("font", "gid", name.alias("name")), encoding, "font")


@query(f"""WITH {GLYPHS}, d AS (SELECT font, name, min(codepoint) AS codepoint FROM g WHERE codepoint < 90 GROUP BY 1, 2), b AS (SELECT font, max(name) AS base FROM g GROUP BY 1),
v AS (SELECT g.font, g.name, CASE WHEN count(DISTINCT x.codepoint) = 1 THEN min(x.codepoint) END AS codepoint FROM (SELECT DISTINCT font, name FROM g) g JOIN b USING (font) JOIN (SELECT DISTINCT font, name, codepoint FROM g WHERE codepoint < 90) x ON x.font = b.font AND x.name = b.base GROUP BY 1, 2)
SELECT g.font, g.gid, coalesce(d.codepoint, v.codepoint, 65533) AS codepoint FROM g LEFT JOIN d USING (font, name) LEFT JOIN v USING (font, name) WHERE g.gid <= 65535 AND (coalesce(d.codepoint, v.codepoint) IS NOT NULL OR g.gid <> 0)""")
def map6_glyph_mapping(spark, sf):
    """Small code points are known by the glyph's name; every glyph is a variant of the last name of its font."""
    g = _glyphs(spark, sf)
    direct = g.filter("codepoint < 90").select("font", "name", "codepoint").distinct()
    base = g.groupBy("font").agg(F.max("name").alias("base"))
    variants = g.select("font", "name").distinct().join(base, "font")
    return S.glyph_mapping(g.select("font", "gid", "name"), direct, variants, "font")


@query(f"""WITH {GLYPHS}, r AS (SELECT font, gid, gid // 100 AS block, '<' || lpad(upper(hex(gid)), 4, '0') || '> <' || lpad(upper(hex(codepoint)), 4, '0') || '>' AS l FROM (SELECT font, gid, codepoint FROM g)) SELECT font, CAST(block AS BIGINT) AS block, count(*) || ' beginbfchar' || chr(10) || string_agg(l, chr(10) ORDER BY gid) || chr(10) || 'endbfchar' AS text FROM r GROUP BY 1, 2""".replace("hex(gid)", "to_hex(gid)").replace("hex(codepoint)", "to_hex(codepoint)").replace("to_to_hex", "to_hex"))
def map7_cmap_blocks(spark, sf):
    return S.cmap_blocks(_glyphs(spark, sf).select("font", F.col("gid").alias("cid"), "codepoint"), "font")


@query(f"""WITH {GLYPHS}, f AS (SELECT DISTINCT font FROM g) SELECT font FROM f WHERE font NOT LIKE '%3' AND (font LIKE '%4' OR font IN (SELECT font FROM g WHERE codepoint + 57240 BETWEEN 55296 AND 63743))""")
def map8_damaged_fonts(spark, sf):
    g = _glyphs(spark, sf)
    fonts = g.select("font").distinct().select("font", F.lit("ABCDEF+Cambria Math").alias("base_font"), F.when(F.col("font").endswith("3"), "TrueType").otherwise("Type0").alias("type"), F.lit("Identity-H").alias("encoding"), (~F.col("font").endswith("4")).alias("has_map"))
    return S.damaged_fonts(fonts, g.select("font", (F.col("codepoint") + 57240).alias("codepoint")), "font", ["cambriamath"]).select("font")


@query("""WITH f AS (SELECT paper_id, ord + 1 AS page, '[[formula ' || type || ']]' || chr(10) || '$$' || chr(10) || left(claim, 5) || chr(10) || '$$' AS t, contribution_id AS c FROM contributions WHERE type IS NOT NULL AND claim IS NOT NULL), a AS (SELECT paper_id, page, string_agg(t, chr(10) ORDER BY c) AS t FROM f GROUP BY 1, 2)
SELECT section_id, sha256(CASE WHEN a.t IS NULL THEN title ELSE regexp_replace(title, '\\s+$', '') || chr(10) || chr(10) || '[[formulas accepted]]' || chr(10) || a.t || chr(10) END) AS sha FROM sections s LEFT JOIN a ON a.paper_id = s.paper_id AND a.page = s.ord WHERE title IS NOT NULL""")
def arr3_overlaid_pages(spark, sf):
    pages = table(spark, sf, "sections").filter("title is not null").select("section_id", "paper_id", F.col("ord").alias("page"), "title")
    c = table(spark, sf, "contributions").filter("type is not null and claim is not null")
    f = c.select("paper_id", (F.col("ord") + 1).alias("page"), F.col("type").alias("ref"), F.substring("claim", 1, 5).alias("latex"), F.lit(None).cast("double").alias("x1"), F.col("contribution_id").cast("double").alias("y1"), F.col("contribution_id").alias("at"))
    return S.overlaid(pages, f, ["paper_id", "page"], "title").select("section_id", F.sha2("title", 256).alias("sha"))


@query("SELECT o_orderkey, (o_totalprice > 100000) = (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS passed FROM orders")
def arr4_case_results(spark, sf):
    """Orders as cases: an urgent one is expected to be dear, and passes if it is."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") > 100_000).alias("actual"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("expected"))
    return o.select("o_orderkey", S.passed(F.col("actual"), F.col("expected")).alias("passed"))


@query("SELECT doc_id, array_to_string(list_filter([CASE WHEN NOT contains(coalesce(text, ''), 'method') THEN 'text omitted method' END, CASE WHEN NOT contains(coalesce(text, ''), 'tensor') THEN 'text omitted tensor' END, CASE WHEN coalesce(lang, '') NOT LIKE '%en%' THEN 'lang omitted en' END], lambda x: x IS NOT NULL), '; ') AS errors FROM documents")
def arr5_fidelity(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    return S.omitted_values(d, {"text": ["method", "tensor"], "lang": ["en"]}).select("doc_id", F.concat_ws("; ", "errors").alias("errors"))


@query("SELECT section_id, CAST(len(regexp_extract_all(title, '[^\\s]+')) AS BIGINT) AS tokens, CAST(length(title) AS BIGINT) AS chars FROM sections WHERE title IS NOT NULL AND regexp_full_match(title, '[\\x20-\\x7E]*')")
def udf1_token_spans(spark, sf):
    s = table(spark, sf, "sections").filter(F.col("title").rlike("^[ -~]*$"))
    return s.select("section_id", "title", U.token_spans(F.col("title")).alias("t")).select("section_id", F.size("t").cast("bigint").alias("tokens"), F.length("title").cast("bigint").alias("chars"))


@query("SELECT doc_id, greatest(CAST(floor(length(text) / 2) AS BIGINT), 1) AS tokens FROM documents WHERE text IS NOT NULL")
def udf2_estimated(spark, sf):
    return table(spark, sf, "documents").filter("text is not null").select("doc_id", U.estimated(F.col("text"), lambda c: F.floor(F.length(c) / 2)).alias("tokens"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'too much' END AS problem FROM orders")
def udf3_validated(spark, sf):
    return U.validated(table(spark, sf, "orders"), lambda df: F.when(F.col("o_totalprice") > 200_000, "too much")).select("o_orderkey", "problem")


@query("SELECT n_nationkey, epoch_us(TIMESTAMP '2031-05-01 10:00:00') AS at FROM nation")
def udf4_clock(spark, sf):
    return U.at_time(table(spark, sf, "nation"), lambda: "2031-05-01T10:00:00Z").select("n_nationkey", F.unix_micros("at").alias("at"))


@query(f"WITH {LOG} SELECT session_id, id, pos FROM log QUALIFY pos > max(pos) OVER (PARTITION BY session_id) - 5")
def udf5_compacted(spark, sf):
    from ..operators import aggregates as A

    return U.compacted(log(spark, sf).select("session_id", "id", "pos"), lambda h: A.last_rows(h, ["session_id"], "pos", 5))


@query(f"WITH {LOG} SELECT session_id, id, CASE name WHEN 'inspect_page' THEN json_extract_string(input, '$.page') ELSE json_extract_string(input, '$.query') END AS result FROM log WHERE type = 'tool_use' AND name IN ('inspect_page', 'search')")
def udf6_dispatched(spark, sf):
    u = log(spark, sf, "type", "name", "input").filter("type = 'tool_use'")
    field = lambda path: lambda calls: calls.select("session_id", "id", F.get_json_object("input", path).alias("result"))
    return U.dispatched(u, "name", {"inspect_page": field("$.page"), "search": field("$.query")}, spark.createDataFrame([], "session_id string, id string, result string"))


@query("SELECT section_id, i AS page, p AS text FROM (SELECT section_id, unnest(string_split(title, ' ')) AS p, generate_subscripts(string_split(title, ' '), 1) AS i FROM sections WHERE title IS NOT NULL)")
def udf8_extracted(spark, sf):
    """Titles as files, whose pages an extractor cuts at blanks."""
    files = table(spark, sf, "sections").filter("title is not null").select("section_id", F.encode("title", "utf-8").alias("content"))
    return U.extracted(files, "section_id", "content", lambda raw: raw.decode().split(" "))
