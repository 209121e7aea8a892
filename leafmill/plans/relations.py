"""Queries over papers, sections, orders and derived tables: joins, sets, sorts, aggregates (JN, SET, SRT, AGG, MAP, ARR)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import structures as S
from ..functions import text as X
from ..operators import aggregates as A
from ..operators import joins as J
from ..operators import validation as V
from ..operators import windows as W
from ..session import table
from .catalogue import query


@query("SELECT s.section_id, CAST(p AS BIGINT) AS page FROM sections s, unnest(generate_series(s.page_start, coalesce(s.page_end, s.page_start))) t(p) WHERE s.page_start IS NOT NULL")
def jn10_section_pages(spark, sf):
    """Sections x the pages of their paper that lie in their range."""
    s = table(spark, sf, "sections").filter("page_start is not null").withColumn("last", F.coalesce("page_end", "page_start"))
    pages = s.groupBy("paper_id").agg(F.min("page_start").alias("a"), F.max("last").alias("b")).filter("b >= a").select("paper_id", F.explode(F.sequence("a", "b")).alias("page"))
    return J.in_range(pages, s.select("paper_id", "section_id", "page_start", "last"), "paper_id", "page", "page_start", "last").select("section_id", "page")


@query("""WITH t AS (SELECT paper_id, max(greatest(coalesce(page_end, page_start), page_start)) AS total FROM sections GROUP BY 1), n AS (SELECT s.*, total, lead(page_start) OVER w AS np, lead(depth) OVER w AS nd FROM sections s JOIN t USING (paper_id) WINDOW w AS (PARTITION BY paper_id ORDER BY ord))
SELECT section_id, page_start, coalesce(page_end, np, total) AS last_page FROM n WHERE nd IS NULL OR nd <= depth""")
def win9_resolved_sections(spark, sf):
    s = table(spark, sf, "sections")
    total = s.groupBy("paper_id").agg(F.max(F.greatest(F.coalesce("page_end", "page_start"), F.col("page_start"))).alias("total"))
    return W.resolved_sections(s.join(total, "paper_id"), F.col("total")).select("section_id", "page_start", "last_page")


@query("""WITH o AS (SELECT section_id, paper_id, coalesce(sum(strlen(coalesce(text, '')) + 1) OVER (PARTITION BY paper_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a, strlen(coalesce(text, '')) AS n FROM sections)
SELECT section_id, CAST(a AS BIGINT) AS start_offset, CAST(a + n AS BIGINT) AS end_offset FROM o""")
def win11_offsets(spark, sf):
    return W.offsets(table(spark, sf, "sections"), ["paper_id"], "ord", "text").select("section_id", "start_offset", "end_offset")


@query("""WITH p AS (SELECT DISTINCT paper_id FROM papers), r AS (SELECT paper_id, left(paper_id, 2) AS s, row_number() OVER (PARTITION BY left(paper_id, 2) ORDER BY paper_id) AS n FROM p) SELECT paper_id, CASE WHEN n = 1 THEN s ELSE s || '-' || n END AS ref FROM r""")
def win12_short_refs(spark, sf):
    return W.short_refs(table(spark, sf, "papers").select("paper_id").distinct(), "paper_id", "paper_id", 2).select("paper_id", "ref")


@query("""WITH a AS (SELECT paper_id AS alias, paper_id AS path FROM papers UNION SELECT legacy_paper_id, paper_id FROM papers), r AS (SELECT DISTINCT CASE WHEN ord % 2 = 0 THEN paper_id ELSE left(paper_id, 12) END AS alias FROM sections)
SELECT r.alias, CAST(count(path) AS BIGINT) AS n_files, min(path) AS path FROM r LEFT JOIN a ON a.alias = r.alias GROUP BY 1""")
def jn4_by_alias(spark, sf):
    """Requests by a full or a short id."""
    files = table(spark, sf, "papers").select("paper_id", "legacy_paper_id").distinct().withColumn("path", F.col("paper_id"))
    asked = table(spark, sf, "sections").select(F.when(F.col("ord") % 2 == 0, F.col("paper_id")).otherwise(F.substring("paper_id", 1, 12)).alias("alias")).distinct()
    named = files.withColumnRenamed("paper_id", "full").withColumnRenamed("legacy_paper_id", "short")
    return J.by_alias(asked, named, "alias", ["full", "short"])


@query("""SELECT section_id FROM sections s WHERE title IS NOT NULL AND NOT EXISTS (SELECT 1 FROM chunks c WHERE c.paper_id = s.paper_id AND lower(trim(c.section_title, ' ' || chr(9) || chr(10))) = lower(trim(s.title, ' ' || chr(9) || chr(10))))""")
def jn5_sections_without_chunks(spark, sf):
    expected = table(spark, sf, "sections").filter("title is not null").select("section_id", "paper_id", F.col("title").alias("section_title"))
    return J.missing(expected, table(spark, sf, "chunks").filter("section_title is not null"), ["paper_id", "section_title"]).select("section_id")



@query("SELECT paper_id, bool_or(paper_id IN (SELECT paper_id FROM contributions WHERE type = (SELECT min(type) FROM contributions))) AS included FROM papers GROUP BY 1")
def jn8_partition(spark, sf):
    c = table(spark, sf, "contributions")
    first = c.agg(F.min("type").alias("type"))
    return J.partition_of(table(spark, sf, "papers").select("paper_id").distinct(), "paper_id", c.join(F.broadcast(first), "type", "left_semi"), None)


@query("""WITH r(prefix, rank, class) AS (VALUES ('quill-l', 1, 'large'), ('quill', 2, 'other quill'), ('orrery', 3, 'orrery')), m AS (SELECT model, class FROM (SELECT DISTINCT model FROM session_log WHERE model IS NOT NULL) v LEFT JOIN r ON starts_with(model, prefix) QUALIFY row_number() OVER (PARTITION BY model ORDER BY rank) = 1)
SELECT l.model, class, CAST(count(*) AS BIGINT) AS n FROM session_log l JOIN m USING (model) GROUP BY 1, 2""")
def jn9_prefix_rules(spark, sf):
    rules = spark.createDataFrame([("quill-l", 1, "large"), ("quill", 2, "other quill"), ("orrery", 3, "orrery")], "prefix string, rank int, class string")
    rows = table(spark, sf, "session_log").filter("model is not null").select("model")
    return J.by_prefix(rows, "model", rules).select("model", F.col("rule.class").alias("class")).groupBy("model", "class").agg(F.count(F.lit(1)).alias("n"))


BOXES = "b AS (SELECT l_orderkey AS page, l_linenumber AS line, l_quantity AS x1, l_discount * 1000 AS y1, l_quantity + l_tax * 300 AS x2, l_discount * 1000 + 12 AS y2 FROM lineitem)"


def boxes(spark, sf) -> DataFrame:
    """Boxes on pages: an order is a page, a line a box."""
    l = table(spark, sf, "lineitem")
    return l.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("x1"), (F.col("l_discount") * 1000).alias("y1"), (F.col("l_quantity") + F.col("l_tax") * 300).alias("x2"), (F.col("l_discount") * 1000 + 12).alias("y2"))


REGIONS = "r(region, rx1, ry1, rx2, ry2) AS (VALUES (1, 5.0, 10.0, 30.0, 60.0), (2, 20.0, 40.0, 50.0, 90.0))"


def _on_pages(spark, sf) -> DataFrame:
    pages = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page"))
    return pages.select("page", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("region", "rx1", "ry1", "rx2", "ry2"), r)]) for r in ((1, 5.0, 10.0, 30.0, 60.0), (2, 20.0, 40.0, 50.0, 90.0))])).alias("r")).select("page", "r.*")


@query(f"WITH {BOXES}, {REGIONS} SELECT page, region, CAST(count(*) AS BIGINT) AS hits FROM b, r WHERE page IN (SELECT o_orderkey FROM orders) AND x1 < rx2 AND rx1 < x2 AND y1 < ry2 AND ry1 < y2 GROUP BY 1, 2")
def jn13_overlaps(spark, sf):
    return J.overlapping(boxes(spark, sf), _on_pages(spark, sf), ["page"]).groupBy("page", "region").agg(F.count(F.lit(1)).alias("hits"))


@query(f"""WITH {BOXES}, {REGIONS}, m AS (SELECT page, region, line, (least(x2, rx2) - greatest(x1, rx1)) * (least(y2, ry2) - greatest(y1, ry1)) AS area FROM b, r WHERE page IN (SELECT o_orderkey FROM orders) AND x1 < rx2 AND rx1 < x2 AND y1 < ry2 AND ry1 < y2)
SELECT page, region, round(max(area), 3) AS area FROM m GROUP BY 1, 2""")
def jn14_best_overlap(spark, sf):
    return J.best_overlap(boxes(spark, sf), _on_pages(spark, sf), ["page"], "line").select("page", "region", F.round("area", 3).alias("area"))


@query(f"WITH {BOXES} SELECT page, min(x1) AS x1, round(min(y1), 6) AS y1, round(max(x2), 6) AS x2, round(max(y2), 6) AS y2 FROM b GROUP BY 1")
def agg10_bounding_boxes(spark, sf):
    b = boxes(spark, sf).groupBy("page").agg(*A.bounding_box())
    return b.select("page", "x1", *[F.round(c, 6).alias(c) for c in ("y1", "x2", "y2")])


@query(f"""WITH {BOXES}, d AS (SELECT page, line, round(y1, 6) AS y1, x1, x2, round(y2, 6) AS y2 FROM b), l AS (SELECT *, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1, lag(x2) OVER w AS px2, lag(y2) OVER w AS py2 FROM d WINDOW w AS (PARTITION BY page ORDER BY line, x1, y1, x2)),
 f AS (SELECT *, CASE WHEN y1 >= py1 AND y1 - py2 <= 1.75 * greatest(y2 - y1, py2 - py1) AND least(x2, px2) - greatest(x1, px1) >= -2.0 THEN 0 ELSE 1 END AS new FROM l)
SELECT page, CAST(max(run) AS BIGINT) AS runs FROM (SELECT page, sum(new) OVER (PARTITION BY page ORDER BY line, x1, y1, x2) AS run FROM f) GROUP BY 1""")
def win8_visual_runs(spark, sf):
    b = boxes(spark, sf)
    rounded = b.withColumn("y1", F.round("y1", 6)).withColumn("y2", F.round("y2", 6))
    return W.visual_runs(rounded, ["page"], ["line", "x1", "y1", "x2"]).groupBy("page").agg(F.max("run").alias("runs"))


@query("""WITH RECURSIVE c(node, steps) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION ALL SELECT node * 2 + k, steps + 1 FROM c, (VALUES (1), (2)) v(k) WHERE node * 2 + k < (SELECT count(*) FROM customer) AND steps < 32) SELECT node, min(steps) AS steps FROM c GROUP BY 1""")
def jn21_closure(spark, sf):
    """Everything below customer 0 in the tree whose node n has children 2n+1 and 2n+2."""
    keys = table(spark, sf, "customer").select(F.col("c_custkey").alias("n"))
    links = keys.filter("n > 0").select(F.floor((F.col("n") - 1) / 2).cast("bigint").alias("above"), F.col("n").alias("below"))
    return J.closure(spark, links, "above", "below", spark.range(1).select("id"))


@query("""SELECT DISTINCT a.pdf_dir AS a, b.pdf_dir AS b FROM libraries a, libraries b WHERE a.pdf_dir IS NOT NULL AND b.pdf_dir IS NOT NULL AND (a.pdf_dir = b.pdf_dir OR starts_with(a.pdf_dir, b.pdf_dir || '/') OR starts_with(b.pdf_dir, a.pdf_dir || '/'))""")
def jn17_overlapping_paths(spark, sf):
    p = table(spark, sf, "libraries").filter("pdf_dir is not null")
    return J.overlapping_paths(p.select(F.col("pdf_dir").alias("a")).distinct(), p.select(F.col("pdf_dir").alias("b")).distinct(), "a", "b")


@query("""WITH s AS (SELECT paper_id, min(venue) AS venue FROM papers GROUP BY 1), n AS (SELECT paper_id, count(*) AS n, min(venue) AS v FROM papers GROUP BY 1) SELECT paper_id FROM s JOIN n USING (paper_id) WHERE NOT (n = 1 AND venue IS NOT DISTINCT FROM v)""")
def jn19_stale(spark, sf):
    p = table(spark, sf, "papers")
    return J.stale(p.groupBy("paper_id").agg(F.min("venue").alias("venue")), p, "paper_id", "venue").select("paper_id")


@query("SELECT p.paper_id, CAST(page AS BIGINT) AS page, title FROM (SELECT DISTINCT 'paper://x?ref=' || paper_id || '&page=' || (ord - 1) AS url, paper_id AS ref, ord - 1 AS page FROM sections) u JOIN (SELECT paper_id, min(title) AS title FROM papers GROUP BY 1) p ON p.paper_id = u.ref WHERE page > 0")
def jn22_cited_pages(spark, sf):
    links = table(spark, sf, "sections").select(F.concat(F.lit("paper://x?ref="), "paper_id", F.lit("&page="), (F.col("ord") - 1).cast("string")).alias("url")).distinct()
    known = table(spark, sf, "papers").groupBy(F.col("paper_id").alias("ref")).agg(F.min("title").alias("title"))
    return J.cited_pages(links, "url", known, "ref").select(F.col("ref").alias("paper_id"), "page", "title")


@query("SELECT paper_id, max_by(venue, ingested_at) FILTER (venue IS NOT NULL) AS venue, epoch_us(max(ingested_at)) AS at FROM papers GROUP BY 1")
def agg6_latest_paper(spark, sf):
    p = table(spark, sf, "papers")
    at = F.unix_micros(F.max("ingested_at").cast("timestamp")).alias("at")
    return p.groupBy("paper_id").agg(F.max_by("venue", F.when(F.col("venue").isNotNull(), F.col("ingested_at"))).alias("venue"), at)



@query("""SELECT l_returnflag, CAST(count(*) AS BIGINT) AS items, round(count(*) FILTER (v = 'C') / count(*), 6) AS strict, round((count(*) FILTER (v = 'C') + 0.5 * count(*) FILTER (v = 'P')) / count(*), 6) AS weighted, round(count(*) FILTER (v IS NOT NULL) / count(*), 6) AS completion
FROM (SELECT l_returnflag, CASE WHEN l_quantity > 30 THEN 'C' WHEN l_quantity > 20 THEN 'P' WHEN l_quantity > 5 THEN 'I' END AS v FROM lineitem) GROUP BY 1""")
def agg13_scores(spark, sf):
    q = F.col("l_quantity")
    l = table(spark, sf, "lineitem").withColumn("verdict", F.when(q > 30, "C").when(q > 20, "P").when(q > 5, "I"))
    return A.scores(l, ["l_returnflag"], "verdict")


@query("""WITH s AS (SELECT a.vec_id AS q, b.vec_id AS item, a.label = b.label AS rel, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding, b.embedding), 5) DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT q, CAST(count(*) FILTER (rel AND rank <= 10) AS BIGINT) AS hits, CAST(count(*) FILTER (rel) AS BIGINT) AS relevant FROM s GROUP BY 1 HAVING count(*) FILTER (rel) > 0""")
def agg14_recall(spark, sf):
    """Recall at 10 of brute-force cosine search; queries are the vectors whose id is divisible by 100, against all rows."""
    v = table(spark, sf, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double")))
    v = v.withColumn("norm", F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)))
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("label").alias("ql"), F.col("e").alias("qe"), F.col("norm").alias("qn"))
    # a stated query set against all rows
    met = v.join(J.small(asked), F.col("vec_id") != F.col("q"))
    cosine = F.round(F.aggregate(F.zip_with("e", "qe", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) / (F.col("norm") * F.col("qn")), 5)
    ranked = A.top(met.withColumn("cosine", cosine), ["q"], [F.desc("cosine"), F.col("vec_id")], 10)
    hits = ranked.filter("label = ql").groupBy("q").agg(F.count(F.lit(1)).alias("hits"))
    relevant = met.filter("label = ql").groupBy("q").agg(F.count(F.lit(1)).alias("relevant"))
    return relevant.join(hits, "q", "left").select("q", F.coalesce("hits", F.lit(0)).alias("hits"), "relevant")


@query("""SELECT paper_id, sha256(string_agg('F' || chr(0) || title || chr(0) || sha256(coalesce(text, '')) || chr(10), '' ORDER BY title, section_id)) AS tree_sha256, CAST(count(*) AS BIGINT) AS files FROM (SELECT paper_id, lpad(CAST(ord AS VARCHAR), 6, '0') AS title, text, section_id FROM sections) GROUP BY 1""")
def agg18_tree_hash(spark, sf):
    s = table(spark, sf, "sections").select("paper_id", F.lpad(F.col("ord").cast("string"), 6, "0").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return A.tree_hash(s, "paper_id", "path", "digest")


@query("SELECT p_brand, p_type, CAST(least(greatest(8 * max(length(p_name)), 112), 240) AS BIGINT) AS width FROM part GROUP BY 1, 2")
def agg19_column_widths(spark, sf):
    return A.column_widths(table(spark, sf, "part"), ["p_brand"], "p_type", "p_name")


@query("SELECT CAST(greatest(count(*) FILTER (pdf_dir IS NOT NULL AND NOT starts_with(pdf_dir, '.')), 1) AS BIGINT) AS budget, utc_offset_minutes FROM libraries GROUP BY utc_offset_minutes")
def agg20_budget(spark, sf):
    l = table(spark, sf, "libraries")
    return l.groupBy("utc_offset_minutes").agg(F.greatest(F.count_if(F.col("pdf_dir").isNotNull() & ~F.col("pdf_dir").startswith(".")), F.lit(1)).cast("bigint").alias("budget"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def srt1_latest_jobs(spark, sf):
    return table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_totalprice")



@query("""WITH b AS (SELECT section_id, paper_id, text, coalesce(sum(length(text)) OVER (PARTITION BY paper_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sections) SELECT section_id, CAST(length(substring(text, 1, CAST(3000 - before AS INT))) AS BIGINT) AS chars FROM b WHERE before < 3000""")
def srt9_char_budget(spark, sf):
    s = table(spark, sf, "sections").select("section_id", "paper_id", "ord", "text")
    return A.char_budget(s, ["paper_id"], ["ord"], "text", 3000).select("section_id", F.length("text").cast("bigint").alias("chars"))


@query("SELECT l_orderkey, round(l_extendedprice, 2) AS price, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem QUALIFY rank <= 10")
def srt4_top_per_group(spark, sf):
    l = table(spark, sf, "lineitem")
    return A.top(l, ["l_returnflag"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 10).select("l_orderkey", F.round("l_extendedprice", 2).alias("price"), "rank")


@query("SELECT paper_id, CAST(count(*) AS BIGINT) AS copies FROM papers GROUP BY 1 HAVING count(*) > 1")
def set5_duplicates(spark, sf):
    return A.duplicates(table(spark, sf, "papers"), ["paper_id"])


@query("SELECT paper_id FROM papers INTERSECT SELECT paper_id FROM contributions WHERE evidence_type IS NULL")
def set2_intersection(spark, sf):
    return table(spark, sf, "papers").select("paper_id").intersect(table(spark, sf, "contributions").filter("evidence_type is null").select("paper_id"))


@query("SELECT paper_id FROM papers EXCEPT SELECT paper_id FROM contributions WHERE evidence_type IS NULL")
def set4_difference(spark, sf):
    return table(spark, sf, "papers").select("paper_id").subtract(table(spark, sf, "contributions").filter("evidence_type is null").select("paper_id"))


@query("SELECT paper_id, list_sort(list_distinct(list(type))) = list_sort(list_distinct(list_concat(coalesce(list(type) FILTER (ord % 2 = 0), []), coalesce(list(type) FILTER (ord % 2 = 1), [])))) AND NOT list_has_any(coalesce(list(type) FILTER (ord % 2 = 0), []), coalesce(list(type) FILTER (ord % 2 = 1), [])) AS parts FROM contributions GROUP BY 1")
def set3_partition_test(spark, sf):
    c = table(spark, sf, "contributions").groupBy("paper_id").agg(F.collect_list("type").alias("all"), F.collect_list(F.when(F.col("ord") % 2 == 0, F.col("type"))).alias("a"), F.collect_list(F.when(F.col("ord") % 2 == 1, F.col("type"))).alias("b"))
    return c.select("paper_id", F.coalesce(A.is_partition(F.col("all"), F.col("a"), F.col("b")), F.lit(True)).alias("parts"))


@query("SELECT paper_id, to_json(list_sort(list(DISTINCT type))) AS kinds FROM contributions GROUP BY 1")
def set6_distinct_sorted(spark, sf):
    return table(spark, sf, "contributions").groupBy("paper_id").agg(F.to_json(F.array_sort(F.collect_set("type"))).alias("kinds"))


@query("SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1")
def map3_unique_mapping(spark, sf):
    return S.unique_mapping(table(spark, sf, "lineitem").select("l_partkey", "l_suppkey"), "l_partkey", "l_suppkey")


@query("WITH f AS (SELECT p_partkey AS id, p_size * 16 AS lo, p_size * 16 + p_partkey % 4 AS hi FROM part) SELECT id, CAST(c AS BIGINT) AS code, CAST(65 + c - lo AS BIGINT) AS unicode FROM f, unnest(generate_series(lo, hi)) t(c)")
def map1_expanded_cmaps(spark, sf):
    """A character map per part, with one range, expanded."""
    hexa = lambda c: F.concat(F.lit("<"), F.lpad(F.hex(c), 4, "0"), F.lit(">"))
    lo = (F.col("p_size") * 16).cast("bigint")
    maps = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("1 beginbfrange\n"), hexa(lo), F.lit(" "), hexa(lo + F.col("p_partkey") % 4), F.lit(" <0041>\nendbfrange")).alias("cmap"))
    return S.expanded_cmap(maps, "id", "cmap")


@query("SELECT paper_id, max_by(chunk_id, struct_pack(a := indexed_at, b := chunk_id)) AS chunk_id FROM chunks GROUP BY 1")
def arr2_latest_chunk(spark, sf):
    c = table(spark, sf, "chunks").select("paper_id", "chunk_id", "indexed_at")
    return S.upserted(c, [F.col("paper_id")], ["indexed_at", "chunk_id"]).select("paper_id", "chunk_id")


@query("""WITH g AS (SELECT a.paper_id, a.title, b.year, a.year AS gy, len(a.authors) AS ga, len(b.authors) AS na FROM papers a JOIN papers b ON a.paper_id = b.paper_id AND a.ingested_at < b.ingested_at) SELECT paper_id, gy IS DISTINCT FROM year AS year_differs, ga <> na AS author_count_differs FROM g""")
def arr1_golden_diff(spark, sf):
    """A paper ingested again is compared with its earlier row."""
    p = table(spark, sf, "papers").select("paper_id", "year", "authors", "ingested_at")
    later = p.toDF("paper_id", "year2", "authors2", "at2")
    return p.join(later, "paper_id").filter("ingested_at < at2").select("paper_id", (~F.col("year").eqNullSafe(F.col("year2"))).alias("year_differs"), (F.size("authors") != F.size("authors2")).alias("author_count_differs"))


@query("SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total, sum(l_extendedprice) > o_totalprice * 1.5 AS over FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_totalprice")
def num6_budget_exceeded(spark, sf):
    totals = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("total"))
    both = totals.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", F.round("total", 2).alias("total"), X.exceeds(F.col("total"), F.col("o_totalprice")).alias("over"))


@query("SELECT l_orderkey, l_linenumber, least(greatest(round_even((l_quantity - 1) / 49, 4), 0.0), 1.0) AS share, greatest(1, CAST(floor(l_discount * 1000) AS INT) - CAST(floor(l_tax * 1000) AS INT)) AS px FROM lineitem")
def num3_normalized(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select("l_orderkey", "l_linenumber", X.normalized(F.col("l_quantity"), F.lit(1.0), F.lit(49.0)).alias("share"), X.pixels(F.col("l_tax"), F.col("l_discount"), F.lit(1000)).alias("px"))


@query("SELECT p.paper_id, min_by(library_id, ingested_at) AS library_id FROM papers p WHERE library_id IS NOT NULL GROUP BY 1")
def flt13_first_usable(spark, sf):
    p = table(spark, sf, "papers").filter("library_id is not null")
    return V.first_usable(p, ["paper_id"], F.col("library_id").isNotNull(), "ingested_at", "library_id")


@query("SELECT library_id, pdf_dir, NOT starts_with(pdf_dir, '/') AND NOT list_contains(string_split(pdf_dir, '/'), '..') AND pdf_dir <> '' AS safe FROM libraries WHERE pdf_dir IS NOT NULL")
def flt11_safe_paths(spark, sf):
    return table(spark, sf, "libraries").filter("pdf_dir is not null").select("library_id", "pdf_dir", V.safe_path(F.col("pdf_dir")).alias("safe"))


@query("SELECT paper_id, CASE WHEN arxiv_id IS NULL THEN NULL ELSE nullif(regexp_extract(arxiv_id, '^\\s*(?:arXiv:)?([a-z\\-]+(?:\\.[A-Z]{2})?/\\d{7}|\\d{4}\\.\\d{4,5})(?:v\\d+)?\\s*$', 1, 'i'), '') END AS arxiv FROM papers")
def str4_arxiv_ids(spark, sf):
    return table(spark, sf, "papers").select("paper_id", X.arxiv_id(F.col("arxiv_id")).alias("arxiv"))


@query("SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY ingested_at DESC) = 1 AS keep, epoch_us(ingested_at) AS at FROM papers")
def snk5_kept_revisions(spark, sf):
    p = table(spark, sf, "papers").select("paper_id", "ingested_at")
    return V.kept_revisions(p, ["paper_id"], ["ingested_at"]).select("paper_id", "keep", F.unix_micros(F.col("ingested_at").cast("timestamp")).alias("at"))


@query("""WITH p AS (SELECT paper_id, max_by(struct_pack(title := title, authors := authors), ingested_at) AS p FROM papers GROUP BY 1), c AS (SELECT paper_id, string_agg('- ' || claim, chr(10) ORDER BY ord, contribution_id) AS items FROM contributions GROUP BY 1)
SELECT paper_id, '# ' || p.title || chr(10) || chr(10) || '**Authors:** ' || coalesce(array_to_string(p.authors, ', '), '') || chr(10) || chr(10) || '## Contributions' || chr(10) || items AS markdown FROM p JOIN c USING (paper_id)""")
def snk11_reports(spark, sf):
    from ..sources.logs import report

    p = table(spark, sf, "papers").groupBy("paper_id").agg(F.max_by(F.struct("title", "authors"), "ingested_at").alias("p")).select("paper_id", "p.*")
    claims = table(spark, sf, "contributions").groupBy("paper_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "contribution_id", "claim"))), lambda x: x["claim"]).alias("claims"))
    return report(p.join(claims, "paper_id"))
