"""Queries of the eight problems over the Parquet tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import conversations, mixing, names, neardup, scans, spam, splitting, storage, tokens


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return names.linked(names.entities(table(spark, sf, "papers")))


def p1_entities(spark: SparkSession, sf: str) -> DataFrame:
    return names.entities(table(spark, sf, "papers"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.pieces(table(spark, sf, "chunks")).filter("piece = 0").select("chunk_id")


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.pieces(table(spark, sf, "chunks"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.verdicts(table(spark, sf, "session_log")).filter("reason is not null")


def p3_conversations(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.conversations(table(spark, sf, "session_log"), table(spark, sf, "turn_segments"))


def scanned_records(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "chunks").select(F.lit("chunk").alias("record_type"), F.col("chunk_id").alias("id"), "paper_id", "text", F.col("indexed_at").alias("at"))
    sections = table(spark, sf, "sections").select(F.lit("section").alias("record_type"), F.col("section_id").alias("id"), "paper_id", "text", F.lit(None).cast("timestamp").alias("at"))
    return chunks.unionByName(sections)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return scans.traced(scanned_records(spark, sf)).select("record_type", F.col("id").alias("record_id"))


def p4_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return scans.repaired(scanned_records(spark, sf)).withColumnRenamed("id", "record_id")


def near_records(spark: SparkSession, sf: str) -> DataFrame:
    chunks = table(spark, sf, "chunks").select(F.lit(0).alias("kind"), F.col("chunk_id").alias("id"), "text")
    claims = table(spark, sf, "contributions").select(F.lit(1).alias("kind"), F.col("contribution_id").alias("id"), F.col("claim").alias("text"))
    return chunks.unionByName(claims)


def record_type() -> Column:
    return F.when(F.col("kind") == 0, "chunk").otherwise("claim").alias("record_type")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.pairs(*neardup.classes_and_links(near_records(spark, sf))).select(record_type(), "id_a", "id_b")


def p5_groups(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.groups(*neardup.classes_and_links(near_records(spark, sf))).select(record_type(), "id", "group_id", "links")


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encode(table(spark, sf, "documents"), tokens.ranks(spark))


def _mixture(spark: SparkSession, sf: str, select: bool = False) -> mixing.Mixture:
    docs = tokens.count(table(spark, sf, "documents"), tokens.ranks(spark), ["doc_id", "source"]).withColumn("sources", F.array("source"))
    if select:  # the texts are encoded once for the plan and the selection
        docs = storage.written(docs, "token-counts")
    return mixing.mix(spark, docs, table(spark, sf, "mix_targets"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    report = _mixture(spark, sf).report
    return report.filter("short and max_repeats * tokens < wanted").select("source")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Target and reached share of each source: of the wanted total and of the tokens really selected."""
    mixture = _mixture(spark, sf, select=True)
    used = mixture.select().groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used"), F.count(F.lit(1)).alias("records"), F.max("copies").alias("most_copies"))
    rows = mixture.report.join(used, "source", "left").na.fill(0, ["used", "records", "most_copies"])
    return _shares(rows, mixture.total)


def _shares(rows: DataFrame, total: int) -> DataFrame:
    whole = rows.agg(F.sum("used").alias("whole"))
    return rows.crossJoin(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", "tokens", "records", "most_copies", "used",
        (F.col("used") / F.lit(max(1, total))).alias("share_of_wanted"), F.when(F.col("whole") > 0, F.col("used") / F.col("whole")).otherwise(0.0).alias("actual_share"), "short",
    )


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf, select=True).select()


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return spam.stuffed(table(spark, sf, "documents"))


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return spam.shares(table(spark, sf, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_entities, p2_found, p2_pieces, p3_found, p3_conversations, p4_found, p4_repaired, p5_found, p5_groups, p6_ids, p7_found, p7_shares, p7_mixture, p8_found, p8_shares)
}

SQL = {
    "p2_found": "SELECT DISTINCT chunk_id FROM chunks WHERE length(text) > 2400",
    "p3_found": r"""WITH RECURSIVE e AS (
 SELECT session_id, id, arg_max(struct_pack(parent := parent_id, type := type, role := role, turn := turn_id, seen := coalesce(regexp_matches(text, '[\p{L}\p{N}\p{P}\p{S}]'), false)), received_at) AS v
 FROM session_log WHERE session_id IS NOT NULL GROUP BY 1, 2),
f AS (SELECT session_id, id, v.parent AS parent, v.type AS type, v.role AS role, v.turn AS turn, v.seen AS seen FROM e),
kids AS (SELECT session_id, max(n) AS most FROM (SELECT session_id, parent, count(*) AS n FROM f WHERE parent IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
chain AS (SELECT session_id, id, 0 AS pos FROM f WHERE type = 'session_header' AND parent IS NULL UNION ALL SELECT f.session_id, f.id, pos + 1 FROM chain JOIN f ON f.session_id = chain.session_id AND f.parent = chain.id),
whole AS (SELECT f.session_id, count(*) = (SELECT count(*) FROM chain c WHERE c.session_id = f.session_id) AND count(*) FILTER (type = 'session_header') = 1 AND count(*) FILTER (parent IS NULL) = 1 AND coalesce(max(most), 1) = 1 AS ok,
 count(*) FILTER (type = 'message' AND role = 'user' AND seen) AS asked FROM f LEFT JOIN kids USING (session_id) GROUP BY 1),
o AS (SELECT f.*, pos, sum(CAST(type = 'turn_started' AS INT)) OVER (PARTITION BY f.session_id ORDER BY pos) AS seg FROM f JOIN chain USING (session_id, id) JOIN whole ON whole.session_id = f.session_id AND ok),
opened AS (SELECT session_id, seg, turn AS t FROM o WHERE type = 'turn_started'),
ended AS (SELECT o.session_id, o.seg, t, min(pos) AS e FROM o JOIN opened USING (session_id, seg) WHERE type = 'turn_completed' AND turn = t GROUP BY 1, 2, 3),
good AS (SELECT DISTINCT o.session_id, t FROM o JOIN ended USING (session_id, seg) WHERE pos < e AND type = 'message' AND role = 'assistant' AND seen),
lacking AS (SELECT DISTINCT o.session_id FROM o WHERE type IN ('turn_started', 'turn_completed', 'turn_aborted') AND turn IS NOT NULL AND NOT EXISTS (SELECT 1 FROM good g WHERE g.session_id = o.session_id AND g.t = o.turn))
SELECT session_id, CASE WHEN NOT ok THEN 'broken' WHEN asked = 0 THEN 'empty' ELSE 'no_reply' END AS reason FROM whole WHERE NOT ok OR asked = 0 OR session_id IN (SELECT session_id FROM lacking)""",
    "p5_found": r"""WITH r AS (SELECT DISTINCT 'chunk' AS record_type, chunk_id AS id, text FROM chunks UNION ALL SELECT 'claim', contribution_id, claim FROM contributions),
w AS (SELECT record_type, id, regexp_extract_all(regexp_replace(lower(text), '([\x{4E00}-\x{9FFF}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS w FROM r WHERE text IS NOT NULL),
s AS (SELECT DISTINCT record_type, id, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS s FROM w, unnest(generate_series(1, len(w) - 2)) t(k)),
n AS (SELECT record_type, id, count(*) AS n FROM s GROUP BY 1, 2),
p AS (SELECT a.record_type, a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.record_type = b.record_type AND a.s = b.s AND a.id < b.id GROUP BY 1, 2, 3)
SELECT p.record_type, id_a, id_b FROM p JOIN n x ON x.record_type = p.record_type AND x.id = id_a JOIN n y ON y.record_type = p.record_type AND y.id = id_b WHERE 3 * c >= x.n + y.n""",
}
