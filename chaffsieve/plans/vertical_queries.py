"""Queries of the vertical searches, over results derived from pages, parts, suppliers and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaffsieve.operators import verticals as V
from chaffsieve.plans import base as B
from chaffsieve.plans.registry import query


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers are requests, parts their results: web for most, other sections for some."""
    part = B.table(spark, sf_dir, "part").withColumn("request_id", F.col("p_partkey") % 50)
    rows = part.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name", "p_type", "p_size"))).alias("ps"))
    pick = lambda kind: F.filter("ps", lambda p: p["p_partkey"] % 7 == kind)
    url = lambda p: F.concat(F.lit("https://p/"), p["p_partkey"].cast("string"))
    return rows.select(
        "request_id",
        F.when(F.col("request_id") % 3 == 0, F.concat(F.lit("k"), F.col("request_id").cast("string"))).alias("summarizer"),
        F.transform(
            F.filter("ps", lambda p: (p["p_partkey"] % 7 < 3) & (F.col("request_id") % 10 != 4)),
            lambda p: F.struct(url(p).alias("url"), p["p_name"].alias("title"), p["p_type"].alias("description")),
        ).alias("web"),
        F.transform(pick(3), lambda p: F.struct(p["p_name"].alias("question"), p["p_type"].alias("answer"), p["p_name"].alias("title"), url(p).alias("url"))).alias("faq"),
        F.transform(pick(4), lambda p: F.struct(url(p).alias("url"), p["p_type"].alias("data"))).alias("discussions"),
        (F.col("request_id") % 2 == 0).alias("mutated_discussions"),
        F.transform(
            pick(5),
            lambda p: F.struct(url(p).alias("url"), p["p_name"].alias("title"), F.struct(p["p_type"].alias("src")).alias("thumbnail"), F.struct(p["p_size"].alias("views")).alias("video")),
        ).alias("videos"),
        F.lit(False).alias("mutated_videos"),
    )


_PARTS = """WITH p AS (SELECT *, p_partkey % 50 AS request_id, p_partkey % 7 AS kind, 'https://p/' || p_partkey AS url FROM part),
w AS (SELECT request_id, url, p_name, p_type, p_partkey FROM p WHERE kind < 3 AND request_id % 10 <> 4),
has AS (SELECT DISTINCT request_id FROM w), req AS (SELECT DISTINCT request_id FROM p),
q AS (SELECT p.*, row_number() OVER (PARTITION BY request_id, kind ORDER BY p_partkey) - 1 AS ord FROM p WHERE kind >= 3 AND request_id IN (FROM has))"""


@query(
    "s05_p02_p06_u02_web_sections",
    f"""{_PARTS}
SELECT request_id, 'summarizer' AS section, 0 AS ord, 'Summarizer key: k' || request_id AS body, false AS is_error FROM req WHERE request_id % 3 = 0
UNION ALL SELECT request_id, 'web', 0, 'No web results found', true FROM req WHERE request_id NOT IN (FROM has)
UNION ALL SELECT request_id, 'web', row_number() OVER (PARTITION BY request_id ORDER BY p_partkey) - 1,
  '{{"url":"' || url || '","title":"' || p_name || '","description":"' || p_type || '"}}', false FROM w
UNION ALL SELECT request_id, 'faq', ord, '{{"question":"' || p_name || '","answer":"' || p_type || '","title":"' || p_name || '","url":"' || url || '"}}', false FROM q WHERE kind = 3
UNION ALL SELECT request_id, 'discussions', ord, '{{"mutated_by_goggles":' || (request_id % 2 = 0) || ',"url":"' || url || '","data":"' || p_type || '"}}', false FROM q WHERE kind = 4
UNION ALL SELECT request_id, 'videos', ord, '{{"mutated_by_goggles":false,"url":"' || url || '","title":"' || p_name || '","thumbnail_url":"' || p_type || '","view_count":' || p_size || '}}', false
  FROM q WHERE kind = 5""",
)
def web_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = V.web_sections(_found(spark, sf_dir))
    return out.select("request_id", "section", F.col("ord").cast("long").alias("ord"), "body", "is_error")


_IMG = """page_id, CASE WHEN page_id % 9 = 1 THEN NULL ELSE 't' END AS title, CASE WHEN page_id % 9 = 2 THEN 'no url' ELSE url END AS url, url AS image_url,
  CASE page_id % 9 WHEN 3 THEN '2024-02-30T10:00:00Z' WHEN 4 THEN '2024-01-01' ELSE '2024-02-29T10:00:00.123Z' END AS page_fetched,
  CASE WHEN page_id % 9 = 5 THEN 'sure' ELSE 'high' END AS confidence, page_id % 6 AS width, page_id % 7 + 1 AS height"""


@query(
    "s06_p09_a17_images",
    f"""WITH i AS (SELECT {_IMG} FROM pages) SELECT confidence, count(*) AS n, CAST(sum(page_id) AS BIGINT) AS ids FROM i
WHERE page_id % 9 NOT IN (1, 2, 3, 4, 5) AND width > 0 GROUP BY confidence""",
)
def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    B.table(spark, sf_dir, "pages").createOrReplaceTempView("_pages")
    rows = V.images(spark.sql(f"SELECT {_IMG} FROM _pages"))
    return rows.groupBy("confidence").agg(F.count("*").alias("n"), F.sum("page_id").alias("ids"))


@query(
    "s07_s08_p07_p08_news_videos",
    """SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN value > 10 END, false) AS breaking, CASE WHEN event_id % 4 <> 0 THEN event_type END AS duration FROM events""",
)
def news_and_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "events").select(
        "event_id", F.expr("CASE WHEN event_id % 3 = 0 THEN value > 10 END").alias("breaking"), F.when(F.expr("event_id % 4 <> 0"), F.struct(F.col("event_type").alias("duration"))).alias("video")
    )
    return V.news(rows).select("event_id", "breaking", F.col("video.duration").alias("duration"))


_HOURS = """SELECT o_custkey % 20 AS request_id, o_custkey AS poi_id, o_orderkey % 9 = 0 AS is_today, o_orderkey AS pos,
  CASE WHEN o_orderkey % 9 = 0 THEN 'Monday' WHEN o_orderkey % 2 = 0 THEN 'Tuesday' ELSE 'WEDNESDAY' END AS full_name,
  concat(o_orderkey % 12, ':00') AS opens, concat(o_orderkey % 12 + 8, ':00') AS closes FROM orders"""


@query(
    "a12_opening_hours",
    f"""WITH h AS ({_HOURS}), d AS (SELECT request_id, poi_id, CASE WHEN is_today THEN 'today (' || lower(full_name) || ')' ELSE lower(full_name) END AS day, is_today,
  min(pos) AS first, string_agg(opens || '-' || closes, ', ' ORDER BY pos) AS spans FROM h GROUP BY ALL)
SELECT request_id, poi_id, string_agg(day || ': ' || spans, '; ' ORDER BY is_today DESC, first) AS hours FROM d GROUP BY ALL""",
)
def opening_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    B.table(spark, sf_dir, "orders").createOrReplaceTempView("_orders")
    return V.opening_hours(spark.sql(_HOURS.replace("FROM orders", "FROM _orders")))


def _places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = B.table(spark, sf_dir, "customer")
    places = c.selectExpr("c_nationkey AS request_id", "c_custkey AS ord", "concat('p', c_custkey % 97) AS id", "c_name AS name")
    said = c.selectExpr("c_nationkey AS request_id", "c_custkey AS ord", "concat('p', c_custkey % 89) AS id", "concat(c_mktsegment, c_custkey) AS description")
    return places, said


@query(
    "s09_j02_p10_o02_described_places",
    """WITH p AS (SELECT c_nationkey AS request_id, c_custkey AS ord, 'p' || c_custkey % 97 AS id, c_name AS name,
  row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS n FROM customer),
d AS (SELECT c_nationkey AS request_id, 'p' || c_custkey % 89 AS id, arg_min(c_mktsegment || c_custkey, c_custkey) AS description FROM customer GROUP BY ALL)
SELECT p.request_id, p.ord, p.id, p.name, CASE WHEN EXISTS (SELECT 1 FROM p x WHERE x.n <= 20 AND x.request_id = p.request_id AND x.id = p.id) THEN description END AS description
FROM p LEFT JOIN d USING (request_id, id)""",
)
def described_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.described_places(*_places(spark, sf_dir))


@query(
    "u08_local_fallback",
    """WITH r AS (SELECT n_nationkey AS request_id FROM nation), pl AS (SELECT c_nationkey AS request_id, c_custkey AS ord, c_name AS body FROM customer WHERE c_nationkey % 3 = 0),
w AS (SELECT s_nationkey AS request_id, s_suppkey AS ord, s_name AS body FROM supplier WHERE s_nationkey % 3 = 1),
rest AS (SELECT request_id FROM r WHERE request_id NOT IN (SELECT request_id FROM pl))
SELECT CAST(request_id AS BIGINT) AS request_id, CAST(ord AS BIGINT) AS ord, body FROM (SELECT * FROM pl UNION ALL SELECT w.* FROM w SEMI JOIN rest USING (request_id)
UNION ALL SELECT request_id, -1, 'no places, web results follow' FROM rest WHERE request_id IN (SELECT request_id FROM w)
UNION ALL SELECT request_id, -1, 'no places' FROM rest WHERE request_id NOT IN (SELECT request_id FROM w))""",
)
def local_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = B.table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey AS bigint) AS request_id")
    places = B.table(spark, sf_dir, "customer").filter("c_nationkey % 3 = 0").selectExpr("cast(c_nationkey AS bigint) AS request_id", "c_custkey AS ord", "c_name AS body")
    web = B.table(spark, sf_dir, "supplier").filter("s_nationkey % 3 = 1").selectExpr("cast(s_nationkey AS bigint) AS request_id", "s_suppkey AS ord", "s_name AS body")
    return V.local_or_web(requests, places, web)


@query(
    "s11_a13_summary_text",
    """SELECT conv_id, string_agg(CASE turn % 3 WHEN 0 THEN text WHEN 1 THEN ' (https://s/' || turn || ')' ELSE '' END, '' ORDER BY turn) AS summary
FROM conversations GROUP BY conv_id""",
)
def summary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("turn") % 3 == 0, F.lit("token")).when(F.col("turn") % 3 == 1, F.lit("inline_reference")).otherwise(F.lit("image"))
    part = F.struct("turn", kind.alias("type"), F.col("text").alias("data"), F.concat(F.lit("https://s/"), F.col("turn").cast("string")).alias("url"))
    parts = B.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return parts.select("conv_id", V.summary_text(F.col("parts")).alias("summary"))
