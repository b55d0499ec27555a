"""Queries of the whole filter, of output compaction and of metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaffsieve.functions import urls
from chaffsieve.functions.text import PREFIX_KEYS
from chaffsieve.operators import filter as whole, rollups, work_table
from chaffsieve.plans import base as B
from chaffsieve.plans.decision_queries import CLEANED_SQL, FINAL_SQL, _answers
from chaffsieve.plans.registry import query


_M, _SNIP = B.source_sql(B.MARKED), B.snippet_sql()
_KEYS = "[" + ", ".join(map(B.quoted, PREFIX_KEYS)) + "]"
_OFF = f"""WITH {_M}, {_SNIP}, keyed AS (SELECT *, {B.sql_line_key('text')} AS key FROM snip),
judged AS (SELECT *, CASE WHEN {B.sql_trim('text')} = '' THEN 'nav' WHEN len(list_filter({_KEYS}, lambda k: key = k OR ({B.sql_units('key')} <= 40
  AND starts_with(key, k) AND NOT regexp_matches(substr(key, len(k) + 1, 1), '[a-z0-9]')))) > 0 OR {B.sql_title('text')} = {B.sql_title('title')}
  THEN 'boilerplate' END AS reason FROM keyed)"""


# The local chain, then what follows the tiles elsewhere: the kept snippets are those that the chain leaves.
_ON = f"""{_OFF.replace('judged AS', 'local AS')}, kept AS (SELECT * FROM local WHERE reason IS NULL),
{FINAL_SQL.split('kept AS (SELECT * FROM snip WHERE index % 7 <> 6),', 1)[1]}, {CLEANED_SQL}"""


@query(
    "s12_filter_on",
    f"""{_ON} SELECT l.request_id, l.source_index, l.index, CAST(NULL AS BIGINT) AS part, l.reason IS NULL AND NOT d.gone AND c.position IS NULL AS kept,
  CASE WHEN l.reason IS NOT NULL THEN l.reason WHEN c.position IS NOT NULL THEN 'dup' WHEN d.gone THEN 'keep_probability' END AS reason
FROM local l LEFT JOIN decided d ON d.request_id = l.request_id AND d.source_index = l.source_index AND d.index = l.index
LEFT JOIN covered c ON c.request_id = d.request_id AND c.source_index = d.source_index AND c.position = d.position""",
)
def filter_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode on with recorded answers: a row a snippet."""
    out = whole.run(B.marked_sources(spark, sf_dir), "on", lambda tiles, asked: _answers(tiles)).snippets
    return out.select("request_id", "source_index", "index", "part", "kept", "reason")


@query("d02_filter_off", f"{_OFF} SELECT request_id, source_index, index, reason IS NULL AS kept, reason FROM judged")
def filter_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whole.run(B.marked_sources(spark, sf_dir), "off").snippets
    return out.select("request_id", "source_index", "index", "kept", "reason")


@query(
    "p18_a02_off_scale",
    f"""{_OFF}, alive AS (SELECT request_id, source_index, count(*) AS n, sum({B.sql_units(B.sql_trim('text'))}) AS c FROM judged WHERE reason IS NULL GROUP BY ALL)
SELECT request_id, count(*) AS n_sources, CAST(sum(n) AS BIGINT) AS n_snippets, CAST(sum(c) AS BIGINT) AS n_chars FROM alive GROUP BY request_id""",
)
def off_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whole.run(B.marked_sources(spark, sf_dir), "off")
    return rollups.output_scale(out.sources, out.snippets)


@query("page_host", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def page_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "pages").select("page_id", urls.host(F.col("url")).alias("host"))


_META = """SELECT page_id % 40 AS request_id, 'https://' || regexp_extract(url, '://([^/?#]+)', 1) || '/' AS url, page_id FROM pages"""
_AGE = "CASE page_id % 3 WHEN 0 THEN '2024-01-0' || (page_id % 9 + 1) ELSE NULL END"


def _shown(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    B.table(spark, sf_dir, "pages").createOrReplaceTempView("_pages")
    pages = spark.sql(_META.replace("FROM pages", "FROM _pages"))
    items = pages.selectExpr("request_id", "url", "page_id AS source_index", "concat('t', page_id % 2) AS title")
    one = pages.groupBy("request_id", "url").agg(F.min("page_id").alias("page_id"))
    meta = one.selectExpr(
        "request_id", "CASE WHEN page_id % 11 = 5 THEN concat(url, 'x') ELSE url END AS url", "concat('t', page_id % 2) AS title",
        "CASE WHEN page_id % 4 = 0 THEN 'other.host' ELSE regexp_extract(url, '://([^/]+)', 1) END AS hostname", f"{_AGE} AS age",
        "CASE WHEN page_id % 5 = 0 THEN 'more' END AS extra",
    )
    return items, meta


_SHOWN = f"""WITH pg AS ({_META}), items AS (SELECT request_id, url, page_id AS source_index, 't' || page_id % 2 AS title FROM pg),
one AS (SELECT request_id, url, min(page_id) AS page_id FROM pg GROUP BY ALL),
meta AS (SELECT request_id, CASE WHEN page_id % 11 = 5 THEN url || 'x' ELSE url END AS url, 't' || page_id % 2 AS title,
  CASE WHEN page_id % 4 = 0 THEN 'other.host' ELSE regexp_extract(url, '://([^/]+)', 1) END AS hostname, {_AGE} AS age,
  CASE WHEN page_id % 5 = 0 THEN 'more' END AS extra FROM one)"""


@query(
    "p13_j09_compact_metadata",
    f"""{_SHOWN}, s AS (SELECT request_id, url, min(title) AS lo, max(title) AS hi FROM items GROUP BY ALL),
r AS (SELECT request_id, url, lo IS NOT NULL AS used, CASE WHEN lo = title AND hi = title THEN NULL ELSE title END AS title,
  CASE WHEN lo IS NOT NULL AND hostname = regexp_extract(url, '://([^/]+)', 1) THEN NULL ELSE hostname END AS hostname,
  CASE WHEN lo IS NULL THEN age END AS age, extra FROM meta LEFT JOIN s USING (request_id, url))
SELECT request_id, url, title, hostname, age, extra FROM r WHERE NOT used OR title IS NOT NULL OR hostname IS NOT NULL OR extra IS NOT NULL""",
)
def compact_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work_table.compacted(*_shown(spark, sf_dir))[1].select("request_id", "url", "title", "hostname", "age", "extra")


@query(
    "j01_item_ages",
    f"{_SHOWN} SELECT request_id, url, source_index, i.title, age FROM items i LEFT JOIN (SELECT request_id, url, age FROM meta) USING (request_id, url)",
)
def item_ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work_table.compacted(*_shown(spark, sf_dir))[0].select("request_id", "url", "source_index", "title", "age")


@query(
    "p11_trimmed_metadata",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS title, CASE WHEN event_id % 4 <> 0 THEN 'h' || user_id END AS hostname,
  CASE WHEN event_id % 5 <> 0 THEN strftime(ts, '%Y-%m-%d') || 'T' END AS age FROM events""",
)
def trimmed_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T"))
    meta = F.to_json(
        F.struct(
            F.expr("CASE WHEN event_id % 3 = 0 THEN event_type END").alias("title"), F.expr("CASE WHEN event_id % 4 <> 0 THEN concat('h', user_id) END").alias("hostname"),
            F.array(F.lit("3 days ago"), F.when(F.expr("event_id % 5 <> 0"), day).otherwise(F.lit("old")), F.lit("x")).alias("age"), F.lit(1).alias("unknown"),
        )
    )
    m = work_table.trimmed_meta(meta)
    rows = B.table(spark, sf_dir, "events").select("event_id", m.alias("m"))
    return rows.select("event_id", "m.title", "m.hostname", F.get("m.age", F.lit(0)).alias("age"))
