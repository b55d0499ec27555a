"""Queries of request parameters, dates and other scalar rules, over parameters derived from orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaffsieve.functions import dates, decisions as D
from chaffsieve.functions import net
from chaffsieve.functions import params as P
from chaffsieve.operators import rollups, work_table
from chaffsieve.plans import base as B
from chaffsieve.plans.registry import query

_PARAMS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 40 - 3 END AS count,
  CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE o_orderkey % 11 - 1 END AS maximum_number_of_urls,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderkey * 37 % 9000 END AS maximum_number_of_tokens,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_orderkey * 11 % 1500 END AS maximum_number_of_tokens_per_url,
  o_orderkey % 13 - 2 AS offset_, (o_orderkey * 7 % 400) - 200 AS coordinate, o_orderpriority AS word FROM orders"""
_P = f"WITH p AS ({_PARAMS})"


def _params(spark: SparkSession, sf_dir: str) -> DataFrame:
    B.table(spark, sf_dir, "orders").createOrReplaceTempView("_orders")
    return spark.sql(_PARAMS.replace("FROM orders", "FROM _orders"))


@query(
    "s02_endpoints",
    "WITH " + B.values_sql("e", "endpoint, path", list(P.ENDPOINTS.items())) + " SELECT * FROM e",
)
def endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(P.ENDPOINTS.items()), "endpoint string, path string")


_RAISED = ", ".join(f"CASE WHEN {n} IS NOT NULL THEN greatest({n}, {v}) END AS {n}" for n, v in P.FLOORS.items())
_REPORT = "concat_ws(';', " + ", ".join(f"CASE WHEN {n} < {v} THEN '{n}:' || {n} || '>{v}' END" for n, v in P.FLOORS.items()) + ")"


@query("p22_p23_raised_parameters", f"{_P} SELECT id, {_RAISED}, {_REPORT} AS report FROM p")
def raised_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _params(spark, sf_dir)
    report = P.raise_report({n: F.col(n) for n in P.FLOORS})
    said = F.transform(F.map_entries(report), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["requested"].cast("string"), F.lit(">"), e["value"]["applied"].cast("string")))
    return rows.select("id", *[P.raised(n, F.col(n)).alias(n) for n in P.FLOORS], F.array_join(said, ";").alias("report"))


@query(
    "p24_p25_defaults",
    f"{_P} SELECT id, " + ", ".join(f"coalesce({n}, {v}) AS {n}" for n, v in P.DEFAULTS.items()) + ", "
    + ", ".join(f"coalesce({n}, {v}) AS stats_{n}" for n, v in P.STATS_DEFAULTS.items()) + " FROM p",
)
def defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = [F.coalesce(n, F.lit(v)).alias(f"stats_{n}") for n, v in P.STATS_DEFAULTS.items()]
    return _params(spark, sf_dir).select("id", *[P.filled(n, F.col(n)).alias(n) for n in P.DEFAULTS], *stats)


@query(
    "p26_p30_query_predicate",
    rf"""WITH {B.source_sql()}, {B.snippet_sql()}, q AS (
  SELECT request_id, source_index, index, {B.sql_trim("text")} AS q FROM snip
  UNION ALL SELECT doc_id, -1, -1, {B.sql_trim("text")} FROM documents)
SELECT request_id, source_index, index, length(q) BETWEEN 1 AND 400 AND len(regexp_split_to_array(q, '[{B.WS}]+')) <= 50 AS valid,
  nullif(q, '') AS place_query FROM q""",
)
def query_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole lines and whole texts as queries."""
    lines = work_table.snippet_rows(B.sources(spark, sf_dir)).select("request_id", "source_index", "index", "text")
    whole = B.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), F.lit(-1).cast("long").alias("source_index"), F.lit(-1).cast("long").alias("index"), "text")
    t = F.col("text")
    return lines.unionByName(whole).select("request_id", "source_index", "index", P.is_query(t).alias("valid"), P.place_query(t).alias("place_query"))


_FRESH = "CASE id % 5 WHEN 0 THEN 'pd' WHEN 1 THEN 'px' WHEN 2 THEN '2024-13-45to2024-01-01' WHEN 3 THEN '2024-01-01to' ELSE 'pm ' END"


@query(
    "p27_p28_ranges",
    f"""{_P} SELECT id, regexp_matches({_FRESH}, {B.quoted(P.FRESHNESS)}) AS fresh, offset_ BETWEEN 0 AND 9 AS offset_ok, coordinate BETWEEN -90 AND 90 AS lat_ok,
  coordinate BETWEEN -180 AND 180 AS lon_ok, coalesce(count BETWEEN 1 AND 20, true) AS count_ok FROM p""",
)
def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _params(spark, sf_dir).select(
        "id", P.is_freshness(F.expr(_FRESH)).alias("fresh"), P.in_range("offset", F.col("offset_")).alias("offset_ok"), P.in_range("latitude", F.col("coordinate")).alias("lat_ok"),
        P.in_range("longitude", F.col("coordinate")).alias("lon_ok"), P.in_range("web_count", F.col("count")).alias("count_ok"),
    )


@query(
    "p21_u05_tool_permission",
    f"""{_P}, t AS (SELECT id, word, CASE WHEN id % 3 = 0 THEN ['1-URGENT', '2-HIGH'] ELSE [] END AS a, CASE WHEN id % 3 = 1 THEN ['5-LOW', 'none'] ELSE [] END AS d FROM p)
SELECT id, CASE WHEN len(a) > 0 THEN list_contains(a, word) ELSE NOT list_contains(d, word) END AS permitted,
  CASE WHEN id % 3 = 1 THEN 'none' ELSE '' END AS unknown FROM t""",
)
def tool_permission(spark: SparkSession, sf_dir: str) -> DataFrame:
    arr = lambda *v: F.array(*map(F.lit, v)).cast("array<string>")
    rows = _params(spark, sf_dir).select(
        "id", "word", F.when(F.expr("id % 3 = 0"), arr("1-URGENT", "2-HIGH")).otherwise(arr()).alias("a"), F.when(F.expr("id % 3 = 1"), arr("5-LOW", "none")).otherwise(arr()).alias("d")
    )
    known = arr("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    errors = P.tool_errors(F.col("a"), F.col("d"), known)
    return rows.select("id", P.permitted(F.col("word"), F.col("a"), F.col("d")).alias("permitted"), F.array_join(errors, ",").alias("unknown"))


_GOGGLE = "CASE page_id % 5 WHEN 0 THEN '  ' || url || ' ' WHEN 1 THEN replace(url, 'http:', 'HTTPS:') WHEN 2 THEN '   ' WHEN 3 THEN '$discard,site=a' ELSE url END"


@query(
    "s04_goggles",
    f"""WITH g AS (SELECT page_id, {B.sql_trim(_GOGGLE)} AS g FROM pages)
SELECT page_id, CASE WHEN g = '' OR regexp_matches(g, '^(?i)http://') THEN NULL ELSE g END AS goggle FROM g""",
)
def goggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "pages").select("page_id", P.goggle(F.expr(_GOGGLE)).alias("goggle"))


@query(
    "s03_u03_query_strings",
    f"""{_P} SELECT id, concat_ws('&', CASE WHEN count IS NOT NULL THEN 'count=' || count END, 'q=' || replace(word, ' ', '+'),
  CASE WHEN id % 4 <> 0 THEN 'ids=' || id || '&ids=b' END, CASE WHEN id % 3 <> 0 THEN 'result_filter=news%2Cweb%2Clocations' END,
  'goggles=g') AS query_string FROM p""",
)
def query_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.create_map(F.lit("query"), F.col("word"), F.lit("count"), F.col("count").cast("string"))
    ids = F.when(F.expr("id % 4 <> 0"), F.array(F.col("id").cast("string"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    wanted = F.concat(F.array(F.lit("news")), F.array(F.lit("web"), F.lit("locations")))
    out = P.query_string(plain, ids, wanted, F.expr("id % 3 = 0"), F.array(F.lit(" g "), F.lit("http://x.y"), F.lit("")))
    return _params(spark, sf_dir).select("id", out.alias("query_string"))


_STAMP = "CASE event_id % 7 WHEN 0 THEN d || 'T10:00:00Z' WHEN 1 THEN d || 'T24:00' WHEN 2 THEN d WHEN 3 THEN '2023-02-29T01:00Z' WHEN 4 THEN d || 'T10:00:00.5+02:00' WHEN 5 THEN '2024-1-05' ELSE d || 'T09:30' END"
_ISO = B.quoted(dates.TIME)


@query(
    "f34_f37_o04_dates",
    f"""WITH e AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS d FROM events), s AS (SELECT event_id, d, {_STAMP} AS x FROM e),
v AS (SELECT event_id, d, x, regexp_matches(x, {_ISO}) AND try_cast(substr(x, 1, 10) AS DATE) IS NOT NULL AS iso FROM s)
SELECT event_id, iso, iso AND regexp_matches(x, {B.quoted(dates.ZONED)}) AS zoned, CASE WHEN iso THEN x ELSE d END AS page_date,
  CASE WHEN iso AND regexp_matches(x, {B.quoted(dates.ZONED)}) THEN x END AS retrieval FROM v""",
)
def date_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("d")).withColumn("x", F.expr(_STAMP))
    x = F.col("x")
    return rows.select(
        "event_id", dates.is_iso_time(x).alias("iso"), dates.is_iso_time(x, zoned=True).alias("zoned"),
        dates.page_date(F.array(F.lit("2 days ago"), F.col("d"), x)).alias("page_date"), dates.retrieval_time(x).alias("retrieval"),
    )


@query(
    "f38_t04_local_stamps",
    "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g+00:00') AS iso FROM events",
)
def local_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.expr("cast(ts as timestamp)")
    return B.table(spark, sf_dir, "events").select("event_id", dates.local_stamp(ts).alias("day"), dates.local_iso(ts).alias("iso"))


@query(
    "f48_f50_retry_rules",
    """SELECT event_id, least(500.0::DOUBLE * pow(2.0::DOUBLE, event_id % 6), 5000.0::DOUBLE) * (1 - 0.25::DOUBLE * (event_id % 10) / 10) AS backoff_ms,
  CASE event_id % 4 WHEN 0 THEN CAST(event_id % 60 AS DOUBLE) * 1000 WHEN 1 THEN 1500.0::DOUBLE END AS retry_after_ms,
  CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'auth' WHEN 2 THEN 'rate_limited' ELSE 'http' END AS kind,
  CASE event_id % 6 WHEN 0 THEN NULL WHEN 4 THEN true WHEN 5 THEN true ELSE false END AS retryable FROM events""",
)
def retry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempt, random = F.expr("cast(event_id % 6 + 1 as double)"), F.expr("cast(event_id % 10 as double) / 10")
    header = F.expr("CASE event_id % 4 WHEN 0 THEN cast(event_id % 60 as string) WHEN 1 THEN ' 1.5' WHEN 2 THEN '-3' ELSE 'soon' END")
    outcome = D.status_outcome(F.expr("element_at(array(200, 401, 429, 404, 503, 529), cast(event_id % 6 + 1 as int))"))
    rows = B.table(spark, sf_dir, "events").withColumn("outcome", outcome)
    return rows.select(
        "event_id", D.backoff_ms(attempt, random).alias("backoff_ms"), D.retry_after_ms(header).alias("retry_after_ms"),
        F.col("outcome.kind").alias("kind"), F.col("outcome.retryable").alias("retryable"),
    )


@query(
    "f51_one_line_messages",
    r"SELECT doc_id, substr(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), 1, 200) AS message, substr(regexp_replace(text, '[\x00-\x1F\x7F]', ' ', 'g'), 1, 80) AS value FROM documents",
)
def one_line_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return B.table(spark, sf_dir, "documents").select("doc_id", P.one_line(t).alias("message"), P.one_line(t, 80).alias("value"))


_HOSTS = (
    "Example.COM:8080", "example.com", "example.com/path", "example.com?q=1", "example.com#frag", "user:pw@example.com", "example.com:80evil",
    "example.com:99999999", "[::1]", "[::1]:80", "", "  127.0.0.1 ", "127.0.0.01", "127.256.0.1", "localhost", "::1", "a b", "example.com:",
    "127.9.200.255", "a,b  c,,d", "0080", "65536",
)
_ORIGINS = ("https://Example.com:443/x?y", "HTTP://a.B:8080", "ftp://u:p@h.i/", "blob:x", "null", " wss://h:443 ", "http://h:0080/", "https://[::1]:8443", "http://h:70000", "")
_PICKED = f"""SELECT page_id, url, [{', '.join(map(B.quoted, _HOSTS))}][page_id % {len(_HOSTS)} + 1] AS v,
  CASE WHEN page_id % 3 = 0 THEN [{', '.join(map(B.quoted, _ORIGINS))}][page_id % {len(_ORIGINS)} + 1] ELSE url END AS o FROM pages"""


@query(
    "f53_hosts_ports_lists",
    rf"""WITH picked AS ({_PICKED}), t AS (SELECT *, trim(v) AS h, trim(o) AS u FROM picked),
cut AS (SELECT *, split_part(h, ']', 1) AS six, regexp_replace(h, '^(\[[^\]]*\]|[^:]*)', '') AS rest,
  lower(regexp_extract(u, '^([A-Za-z]+)://', 1)) AS scheme, regexp_extract(u, '^[A-Za-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)', 1) AS name,
  coalesce(nullif(regexp_extract(u, '^[A-Za-z]+://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]+):0*([0-9]+)', 1), ''), '0') AS n FROM t)
SELECT page_id,
  CASE WHEN h = '' OR regexp_matches(h, '[/@?# ,]') OR starts_with(h, ':') OR NOT regexp_full_match(rest, '(:[0-9]*)?')
    OR coalesce(try_cast(nullif(replace(rest, ':', ''), '') AS BIGINT), 0) > 65535 THEN NULL
    WHEN starts_with(h, '[') THEN lower(substr(six, 2)) ELSE lower(split_part(h, ':', 1)) END AS host,
  v IN ('localhost', '::1', '127.9.200.255') AS loopback,
  CASE WHEN regexp_full_match(h, '[0-9]+') AND CAST(h AS BIGINT) BETWEEN 1 AND 65535 THEN CAST(h AS INTEGER) END AS port,
  array_to_string(list_filter(regexp_split_to_array(v, '[\s,]+'), lambda x: x <> ''), '|') AS list,
  CASE WHEN scheme NOT IN ('http', 'https', 'ws', 'wss', 'ftp') OR name = '' OR CAST(n AS BIGINT) > 65535 THEN NULL
    ELSE scheme || '://' || lower(name) || CASE WHEN n = '0' OR (scheme, n) IN (('http', '80'), ('https', '443'), ('ws', '80'), ('wss', '443'), ('ftp', '21'))
      THEN '' ELSE ':' || n END END AS origin FROM cut""",
)
def hosts_ports_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("page_id") % len(values)).cast("int"))
    v, o = F.col("v"), F.col("o")
    rows = B.table(spark, sf_dir, "pages").select("page_id", pick(_HOSTS).alias("v"), F.when(F.expr("page_id % 3 = 0"), pick(_ORIGINS)).otherwise(F.col("url")).alias("o"))
    return rows.select(
        "page_id", net.host(v).alias("host"), net.is_loopback(v).alias("loopback"), net.port(v).alias("port"),
        F.array_join(net.delimited(v), "|").alias("list"), net.origin(o).alias("origin"),
    )


_BUDGETS = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 60 - 3 END AS count,
  CASE WHEN o_orderkey % 8 <> 0 THEN o_orderkey % 55 END AS maximum_number_of_urls, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey * 37 % 40000 END AS maximum_number_of_tokens,
  CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 300 END AS maximum_number_of_snippets, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey * 11 % 9000 END AS maximum_number_of_tokens_per_url,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 110 END AS maximum_number_of_snippets_per_url, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 12 - 1 END AS "offset" FROM orders"""
_OUT_OF_RANGE = ", ".join(f"CASE WHEN \"{n}\" NOT BETWEEN {a} AND {b} THEN '{n}' END" for n, (a, b) in P.BUDGETS.items())
_HANDED = ", ".join(
    f"'{n}=' || " + (f"greatest(coalesce({n}, {P.DEFAULTS[n]}), {P.FLOORS[n]})" if n in P.DEFAULTS else f'"{n}"') for n in sorted(P.BUDGETS)
)


@query("o05_budgets", f"WITH b AS ({_BUDGETS}) SELECT id, concat_ws(',', {_OUT_OF_RANGE}) AS errors, concat_ws('&', {_HANDED}) AS handed FROM b")
def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    B.table(spark, sf_dir, "orders").createOrReplaceTempView("_orders")
    rows = spark.sql(_BUDGETS.replace("FROM orders", "FROM _orders").replace('"offset"', "offset"))
    columns = {n: F.col(n) for n in P.BUDGETS}
    none = F.array().cast("array<string>")
    handed = P.query_string(P.upstream(columns), none, none, F.lit(False), none)
    return rows.select("id", F.array_join(P.budget_errors(columns), ",").alias("errors"), handed.alias("handed"))


_PLACE = """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '   ' ELSE o_orderpriority END AS query,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 55 END AS count, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 100 - 5 END AS latitude,
  CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 200 - 10 END AS longitude, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 9 - 1 END AS radius,
  CASE o_orderkey % 7 WHEN 0 THEN ' ' WHEN 1 THEN 'paris france' END AS location FROM orders"""


@query(
    "s13_place_search_parameters",
    f"""WITH p AS ({_PLACE}) SELECT id, coalesce(count BETWEEN 1 AND 50, true) AND coalesce(latitude BETWEEN -90 AND 90, true)
  AND coalesce(longitude BETWEEN -180 AND 180, true) AND coalesce(radius >= 0, true) AND coalesce(trim(location) <> '', true) AS valid,
  nullif(trim(query), '') AS query FROM p""",
)
def place_search_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    B.table(spark, sf_dir, "orders").createOrReplaceTempView("_orders")
    rows = spark.sql(_PLACE.replace("FROM orders", "FROM _orders"))
    fit = P.is_place_search(*(F.col(c) for c in ("query", "count", "latitude", "longitude", "radius", "location")))
    return rows.select("id", fit.alias("valid"), P.place_query(F.col("query")).alias("query"))


@query(
    "u04_distinct_in_order",
    """WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS kinds FROM f GROUP BY user_id""",
)
def distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rollups.distinct_in_order(B.table(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"], "kinds")
    return out.select("user_id", F.array_join("kinds", ",").alias("kinds"))
