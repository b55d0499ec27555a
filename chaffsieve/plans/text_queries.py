"""Queries of the text, date and URL functions and of the local rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chaffsieve.functions import text as T
from chaffsieve.functions.regions import line_flags, without_code
from chaffsieve.operators import coverage, local_rules, work_table
from chaffsieve.plans import base as B
from chaffsieve.plans.registry import query

_S, _M = B.source_sql(), B.source_sql(B.MARKED)
_SNIP = B.snippet_sql()


def _snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work_table.snippet_rows(B.marked_sources(spark, sf_dir))


@query(
    "p01_w09_work_table",
    f"WITH {_S}, {_SNIP} SELECT request_id, source_index, index, {B.sql_units('text')} AS units, title, url FROM snip",
)
def work_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work_table.snippet_rows(B.sources(spark, sf_dir)).select(
        "request_id", "source_index", "index", T.utf16_length(F.col("text")).cast("long").alias("units"), "title", "url"
    )


@query(
    "p15_blank_snippets",
    f"""WITH {_M}, {_SNIP} SELECT request_id, source_index, count(*) AS n,
  count(*) FILTER (WHERE {B.sql_trim('text')} = '') AS n_blank FROM snip GROUP BY ALL""",
)
def blank_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snippets(spark, sf_dir).groupBy("request_id", "source_index").agg(
        F.count("*").alias("n"), F.count_if(T.is_blank(F.col("text"))).alias("n_blank")
    )


@query(
    "f01_f02_normalized_lines",
    rf"""WITH {_M}, {_SNIP} SELECT request_id, source_index, index, {B.sql_line('text')} AS line,
  regexp_replace(text, '[\p{{P}}\p{{S}}{T.WS}]+\z', '') AS bare FROM snip""",
)
def normalized_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _snippets(spark, sf_dir).select(
        "request_id", "source_index", "index", T.normalized_line(t).alias("line"), T.without_trailing_marks(t).alias("bare")
    )


_KEYS = "[" + ", ".join(map(B.quoted, T.PREFIX_KEYS)) + "]"
_PREFIX = f"""len(list_filter({_KEYS}, lambda k: key = k OR ({B.sql_units('key')} <= 40 AND starts_with(key, k)
    AND NOT regexp_matches(substr(key, len(k) + 1, 1), '[a-z0-9]')))) > 0"""


@query(
    "f03_f04_boilerplate_lines",
    f"""WITH {_M}, {_SNIP}, keyed AS (SELECT *, {B.sql_line_key('text')} AS key FROM snip)
SELECT request_id, source_index, index, key FROM keyed WHERE {_PREFIX}""",
)
def boilerplate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _snippets(spark, sf_dir).filter(T.matches_prefix(t)).select("request_id", "source_index", "index", T.line_key(t).alias("key"))


@query(
    "f05_f06_title_keys",
    f"""WITH {_M}, {_SNIP} SELECT request_id, source_index, index, {B.sql_title('text')} AS key,
  {B.sql_title('text')} = {B.sql_title('title')} AS title_only FROM snip""",
)
def title_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _snippets(spark, sf_dir).select(
        "request_id", "source_index", "index", T.normalized_title(t).alias("key"), T.is_title_only(t, F.col("title")).alias("title_only")
    )


_TITLES = "CASE WHEN index % 4 = 1 THEN title WHEN index % 4 = 2 THEN '#  ' || title ELSE text END"
_LONG = "CASE source_index WHEN 0 THEN title || ' - Site' WHEN 1 THEN title || ' by Someone' WHEN 2 THEN title || ' byte' ELSE title END"


@query(
    "f07_w02_a16_title_repeats",
    f"""WITH {_S}, {_SNIP}, l AS (SELECT request_id, source_index, index, {_TITLES} AS line, {_LONG} AS page FROM snip),
k AS (SELECT *, {B.sql_title('line')} AS a, {B.sql_title('page')} AS b FROM l),
r AS (SELECT *, substr(b, length(a) + 1) AS rest FROM k),
h AS (SELECT * FROM r WHERE a <> '' AND b <> '' AND (a = b OR (starts_with(b, a) AND regexp_matches(rest, {B.quoted(T.BYLINE)})
  AND {B.sql_units('rest')} <= 40 AND {B.sql_units('rest')} < {B.sql_units('a')} AND {B.sql_units('a')} >= 20)))
SELECT request_id, source_index, index, row_number() OVER w AS nth, count(*) OVER (PARTITION BY request_id, source_index) >= 2
  AND row_number() OVER w > 1 AS deleted FROM h WINDOW w AS (PARTITION BY request_id, source_index ORDER BY index)""",
)
def title_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = work_table.snippet_rows(B.sources(spark, sf_dir)).select(
        "request_id", "source_index", "index", F.expr(_TITLES).alias("line"), F.expr(_LONG).alias("page")
    )
    own = Window.partitionBy("request_id", "source_index")
    hits = rows.filter(T.repeats_title(F.col("line"), F.col("page"))).withColumn("nth", F.row_number().over(own.orderBy("index")).cast("long"))
    return hits.select(
        "request_id", "source_index", "index", "nth", ((F.count("*").over(own) >= 2) & (F.col("nth") > 1)).alias("deleted")
    )


@query(
    "f08_boilerplate_strip",
    f"""WITH {_M}, l AS (SELECT request_id, source_index, title, unnest(snippets) AS x, unnest(range(0, len(snippets))) AS i FROM src),
k AS (SELECT *, {B.sql_line_key('x')} AS key, {B.sql_title('x')} AS a, {B.sql_title('title')} AS b FROM l),
alive AS (SELECT *, substr(b, length(a) + 1) AS rest FROM k WHERE NOT ({_PREFIX})),
hits AS (SELECT *, a <> '' AND b <> '' AND (a = b OR (starts_with(b, a) AND regexp_matches(rest, {B.quoted(T.BYLINE)})
  AND {B.sql_units('rest')} <= 40 AND {B.sql_units('rest')} < {B.sql_units('a')} AND {B.sql_units('a')} >= 20)) AS hit FROM alive),
nth AS (SELECT *, row_number() OVER (PARTITION BY request_id, source_index, hit ORDER BY i) AS r FROM hits),
rest AS (SELECT request_id, source_index, string_agg(x, chr(10) ORDER BY i) AS t FROM nth WHERE NOT hit OR r = 1 GROUP BY ALL),
out AS (SELECT request_id, source_index, title, array_to_string(snippets, chr(10)) AS raw, coalesce({B.sql_trim('t')}, '') AS t FROM src LEFT JOIN rest USING (request_id, source_index)),
judged AS (SELECT *, CASE WHEN {B.sql_trim('raw')} = '' THEN 'nav' WHEN t = '' OR {B.sql_title('t')} = {B.sql_title('title')} THEN 'boilerplate' END AS reason FROM out)
SELECT request_id, source_index, reason IS NULL AS kept, reason, sha256(CASE WHEN reason IS NULL THEN t ELSE raw END) AS text_sha256 FROM judged""",
)
def boilerplate_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as one snippet each: prefix lines and title repeats go."""
    whole = B.marked_sources(spark, sf_dir).withColumn("snippets", F.array(F.array_join("snippets", "\n")))
    return local_rules.applied(whole, platforms=False).select(
        "request_id", "source_index", "kept", "reason", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )


_CODE = "concat(text, '\n```\nx = 1\n~~~\n```\n> said\nmore of it\n\n    indented\n', if(doc_id % 2 = 0, 'a `b\nc` d', 'a `b` c'))"


# The lines of the documents open no region; those of the added ones are worked out by hand: a fence of four lines, a quotation
# that goes on for a line, a blank line, indented code, and a code span that does or does not cross a line's end.
@query(
    "f09_f10_f12_line_regions",
    """WITH n AS (SELECT doc_id, repeat('0', len(string_split(text, chr(10)))) AS z, doc_id % 2 = 0 AS crossed FROM documents)
SELECT doc_id, coalesce(z || '11110001' || CASE WHEN crossed THEN '11' ELSE '0' END, '0') AS code,
  coalesce(z || '11111101' || CASE WHEN crossed THEN '11' ELSE '0' END, '0') AS quoted, z IS NOT NULL AS has_code FROM n""",
)
def line_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and quotation flags of all lines, as strings of 0 and 1."""
    docs = B.table(spark, sf_dir, "documents").select("doc_id", F.expr(_CODE).alias("text"))
    return line_flags(docs, "doc_id").select("doc_id", "code", "quoted", F.col("code").contains("1").alias("has_code"))


_HEAD = "CASE index % 5 WHEN 0 THEN '## ' || text WHEN 1 THEN '   #\t' || text WHEN 2 THEN '####### ' || text ELSE text END"


@query(
    "f11_f13_headings_and_prose",
    rf"""WITH {_S}, {_SNIP}, l AS (SELECT request_id, source_index, index, {_HEAD.replace('#\t', "#' || chr(9) || '")} AS line FROM snip)
SELECT request_id, source_index, index, {B.sql_trim("regexp_replace(line, '^ {0,3}#{1,6}[ \\t]+', '')")} AS bare,
  {B.sql_trim(f"regexp_replace(regexp_replace(replace(line, '*', ''), '^[{T.WS}]*#{{1,6}}[{T.WS}]+', '', 'g'), '[{T.WS}]+', ' ', 'g')")} AS prose FROM l""",
)
def headings_and_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = work_table.snippet_rows(B.sources(spark, sf_dir)).withColumn("line", F.expr(_HEAD))
    line = F.col("line")
    return rows.select(
        "request_id", "source_index", "index", T.without_heading_mark(line).alias("bare"), T.normalized_prose(F.replace(line, F.lit("*"), F.lit(""))).alias("prose")
    )


_TAKE = "'# ' || title || chr(10) || chr(10) || CASE source_index WHEN 0 THEN '## **Key takeaways**' WHEN 1 THEN 'KEY TAKEAWAYS' WHEN 2 THEN '**key takeaways** x' ELSE text END"
_PAGE = "CASE WHEN request_id % 2 = 0 THEN trim(title) ELSE trim(title) || ' | Site' END"


@query(
    "f14_empty_takeaways",
    rf"""WITH {_S}, {_SNIP}, l AS (
  SELECT request_id, source_index, index, {_PAGE} AS page,
    list_filter(list_transform(string_split({_TAKE}, chr(10)), lambda x: {B.sql_trim('x')}), lambda x: x <> '') AS ls FROM snip),
p AS (SELECT *, {B.sql_trim('substr(ls[1], 3)')} AS head,
  lower({B.sql_trim(rf"regexp_replace(regexp_replace(ls[2], '^#{{1,6}}[{T.WS}]+', ''), '^\*\*(.*?)\*\*\z', '\1')")}) AS section FROM l)
SELECT request_id, source_index, index FROM p WHERE len(ls) = 2 AND starts_with(ls[1], '# ') AND section = 'key takeaways'
  AND (page = head OR starts_with(page, head || ' - ') OR starts_with(page, head || ' | '))""",
)
def empty_takeaways(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = work_table.snippet_rows(B.sources(spark, sf_dir))
    return rows.filter(T.is_empty_takeaways(F.expr(_TAKE.replace("chr(10)", "'\n'")), F.expr(_PAGE))).select("request_id", "source_index", "index")


COVER_SQL = rf"""prose AS MATERIALIZED (
  SELECT request_id, source_index, index AS position, {B.sql_trim(f"regexp_replace(text, '[{T.WS}]+', ' ', 'g')")} AS t FROM snip),
long AS MATERIALIZED (SELECT *, {B.sql_units('t')} AS u FROM prose WHERE {B.sql_units('t')} >= 40),
held AS MATERIALIZED (
  SELECT i.request_id, i.source_index, i.position, o.position AS outer_position, o.u, i.t AS inner_t, o.t AS outer_t
  FROM long i JOIN long o ON i.request_id = o.request_id AND i.source_index = o.source_index
    AND (o.u > i.u OR (o.u = i.u AND o.position < i.position)) AND contains(o.t, i.t)),
pairs AS (
  SELECT * FROM held WHERE regexp_matches(outer_t, '(^|[^\p{{L}}\p{{N}}_])' || regexp_escape(inner_t) || '($|[^\p{{L}}\p{{N}}_])')),
covered AS (
  SELECT request_id, source_index, position, arg_min(outer_position, (-u, outer_position)) AS covered_by FROM pairs GROUP BY ALL)"""


@query(
    "j06_w03_o03_same_source_coverage",
    f"WITH {_S}, {_SNIP}, {COVER_SQL} SELECT request_id, source_index, position, covered_by FROM covered",
)
def same_source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_code(work_table.snippet_rows(B.sources(spark, sf_dir)))
    return coverage.covered(rows.withColumn("position", F.col("index")))


@query(
    "flagship",
    f"""WITH {_M}, {_SNIP}, {COVER_SQL.replace('FROM snip)', f"FROM snip WHERE {B.sql_trim('text')} <> '')", 1)},
alive AS (
  SELECT s.request_id, s.source_index, count(*) AS n, CAST(sum({B.sql_units('text')}) AS BIGINT) AS c
  FROM snip s LEFT JOIN covered c ON c.request_id = s.request_id AND c.source_index = s.source_index AND c.position = s.index
  WHERE {B.sql_trim('text')} <> '' AND c.position IS NULL GROUP BY ALL)
SELECT request_id, count(*) AS n_sources, CAST(sum(n) AS BIGINT) AS n_snippets, CAST(sum(c) AS BIGINT) AS n_chars FROM alive GROUP BY ALL""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without blanks and without what their document covers, then kept sources, snippets and units."""
    rows = _snippets(spark, sf_dir).filter(~T.is_blank(F.col("text"))).withColumn("position", F.col("index"))
    key = ["request_id", "source_index", "position"]
    rest = rows.join(coverage.covered(rows), key, "left_anti")
    return (
        rest.groupBy("request_id", "source_index")
        .agg(F.count("*").alias("n"), F.sum(T.utf16_length(F.col("text")).cast("long")).alias("c"))
        .groupBy("request_id")
        .agg(F.count("*").alias("n_sources"), F.sum("n").alias("n_snippets"), F.sum("c").alias("n_chars"))
    )


_SITES = (
    "https://github.com/acme/tool",
    "https://www.github.com/acme/tool/pull/7",
    "https://GitHub.com/acme/tool/releases/tag/v1?x=1",
    "https://github.com/acme/tool/compare/a...b",
    "https://x.com/someone/status/12",
    "https://twitter.com/i/trending/99",
    "https://dev.to/someone/a-post",
    "https://github.com/topics/data",
    "https://x.com/home",
    "https://example.com/plain",
)
_PAGE_LINES = (
    "\nRepository files navigation\n# About\n",
    "\nUh oh!\nThere was an error while loading. Please reload this page.\n\nAll reactions\nacme/tool:fix Copy head branch name to clipboard",
    "\nChoose a tag to compare\n\nNo results found\n> Choose a tag to compare",
    "\nfix it Configuration menu Copy the full SHA abcdef0 View commit details Browse the repository at this point in the history",
    "\nShow more\nRelated Trending Stories on X",
    "\n```\nShow more\n```\nShow more",
    '{"@type":"Article","headline":"Other","articleBody":"body text"}',
    '{"@type":"Thing","author":"x"}',
    '[{"unknown":1}]',
    "\nShare\n",
)


def _site_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values)).cast("int"))
    lines = F.split("text", "\n")
    extra = pick(_PAGE_LINES)
    own = F.when(extra.startswith("\n"), F.concat(F.get(lines, F.lit(0)), extra)).otherwise(extra)
    return B.table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / 5).alias("request_id"), (F.col("doc_id") % 5).alias("source_index"), pick(_SITES).alias("url"),
        F.get(lines, F.lit(0)).alias("title"), F.lit(None).cast("string").alias("meta"), F.concat(F.array(own), lines).alias("snippets"),
    )


# What the rules make of each page's first snippet, worked out by hand: text, cleaner actions, route and outcome.
_FIRST = "string_split(text, chr(10))[1]"
_NL = "chr(10)"
_MADE = {
    0: (f"{_FIRST} || {_NL} || '# About'", "github:repo_nav:2"),
    1: (f"{_FIRST} || {_NL} || {_NL} || 'acme/tool:fix'", "github:pr_loading_placeholder:3,github:pr_loading_placeholder:5,github:copy_branch_button:6,github:pr_uh_oh:2"),
    2: (f"{_FIRST} || {_NL} || {_NL} || '> Choose a tag to compare'", "github:tag_compare:2,github:tag_compare:4"),
    3: (f"{_FIRST} || {_NL} || 'fix it abcdef0'", "github:compare_commit_menu:2"),
    4: (f"{_FIRST} || {_NL}", "x:related_trending_heading:3,x:show_more_button:2"),
    5: (f"{_FIRST} || {_NL} || '```' || {_NL} || 'Show more' || {_NL} || '```'", "x:show_more_button:5"),
    7: (B.quoted(_PAGE_LINES[7]), ""),
    8: (B.quoted(_PAGE_LINES[8]), ""),
    9: (f"{_FIRST} || {_NL} || 'Share' || {_NL}", ""),
}
_BY_PAGE = lambda at: "CASE doc_id % 10 " + " ".join(f"WHEN {k} THEN {v[at] if at == 0 else B.quoted(v[at])}" for k, v in _MADE.items()) + " END"
_RULED = f"""WITH d AS (SELECT * FROM documents WHERE text IS NOT NULL),
first AS (SELECT doc_id, 0 AS index, CAST(NULL AS BIGINT) AS part, {_BY_PAGE(0)} AS text, {_BY_PAGE(1)} AS actions,
  CASE doc_id % 10 WHEN 7 THEN 'dropped_meta' WHEN 8 THEN 'kept_raw' ELSE 'not_json' END AS route,
  CASE doc_id % 10 WHEN 4 THEN 'boilerplate' WHEN 7 THEN 'jsonld_meta' WHEN 9 THEN 'boilerplate' END AS reason FROM d WHERE doc_id % 10 <> 6
  UNION ALL SELECT doc_id, 0, 0, 'body text', '', 'converted', NULL FROM d WHERE doc_id % 10 = 6
  UNION ALL SELECT doc_id, 0, 1, 'Other', '', NULL, NULL FROM d WHERE doc_id % 10 = 6),
line AS (SELECT doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS index, unnest(string_split(text, chr(10))) AS x, {_FIRST} AS title FROM d),
keyed AS (SELECT *, {B.sql_line_key('x')} AS key FROM line),
judged AS (SELECT *, CASE WHEN {B.sql_trim('x')} = '' THEN 'nav' WHEN {_PREFIX} OR {B.sql_title('x')} = {B.sql_title('title')} THEN 'boilerplate' END AS reason FROM keyed),
ruled AS (SELECT * FROM first UNION ALL
  SELECT doc_id, index, NULL, CASE WHEN reason IS NULL THEN {B.sql_trim('x')} ELSE x END, '', 'not_json', reason FROM judged)"""


@query(
    "d01_d02_u01_local_rules",
    f"""{_RULED} SELECT doc_id // 5 AS request_id, doc_id % 5 AS source_index, index, part, reason IS NULL AS kept, reason, route, sha256(text) AS text_sha256, actions FROM ruled""",
)
def local_rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cleaners (F15-F33, J07, J08, W04-W08) on pages of every kind: a row for each snippet or part."""
    return local_rules.applied(_site_sources(spark, sf_dir)).select(
        "request_id", "source_index", "index", "part", "kept", "reason", "route", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.array_join(F.transform("actions", lambda a: F.concat_ws(":", a["cleaner"], a["rule"], a["line"].cast("string"))), ",").alias("actions"),
    )


_ACTS = lambda name: f"CAST(sum(len(list_filter(string_split(actions, ','), lambda a: starts_with(a, '{name}:')))) AS BIGINT)"


@query(
    "a03_local_counters",
    f"""{_RULED} SELECT doc_id // 5 AS request_id, count(*) FILTER (WHERE route = 'converted') AS jsonld_converted,
  count(*) FILTER (WHERE route = 'dropped_meta') AS jsonld_dropped, count(*) FILTER (WHERE route = 'kept_raw') AS jsonld_kept_raw,
  count(*) FILTER (WHERE reason IN ('nav', 'boilerplate')) AS snippets_prefiltered, count(*) FILTER (WHERE reason = 'dup') AS dup_removed,
  {_ACTS('github')} AS github_cleanup_actions, {_ACTS('x')} AS x_cleanup_actions, {_ACTS('devto')} AS devto_cleanup_actions FROM ruled GROUP BY ALL""",
)
def local_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return local_rules.counters(local_rules.applied(_site_sources(spark, sf_dir)))


_PAGE_SQL = "regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '[?#].*', '')"


@query(
    "f15_f24_f28_page_kinds",
    f"""WITH p AS (
  SELECT page_id, CASE page_id % 7 WHEN 0 THEN regexp_replace(url, '//[^/]*', '//github.com') WHEN 1 THEN regexp_replace(url, '//[^/]*', '//x.com')
    WHEN 2 THEN regexp_replace(url, '//[^/]*', '//dev.to') WHEN 3 THEN 'https://github.com/a/b/pull/' || page_id
    WHEN 4 THEN 'https://x.com/u_' || page_id % 9 || '/status/' || page_id WHEN 5 THEN 'https://github.com/a/b/releases/tag/v' || page_id
    ELSE url END AS url FROM pages),
s AS (SELECT page_id, regexp_extract(url, '//([^/?#]*)', 1) AS h, regexp_replace({_PAGE_SQL}, '/+$', '') AS path, {_PAGE_SQL} AS raw FROM p)
SELECT page_id, CASE WHEN h <> 'github.com' THEN NULL WHEN regexp_matches(path, '^/[^/]+/[^/]+$') THEN 'repo_root'
    WHEN regexp_matches(path, '^/[^/]+/[^/]+/pull/[0-9]+$') THEN 'pull' WHEN regexp_matches(path, '^/[^/]+/[^/]+/releases(/tag/[^/]+)?$') THEN 'release' END AS forge,
  CASE WHEN h <> 'x.com' THEN NULL WHEN regexp_matches(path, '^/[A-Za-z0-9_]{{1,15}}/status/[0-9]+$') THEN 'status'
    WHEN regexp_matches(path, '^/[A-Za-z0-9_]{{1,15}}$') THEN 'profile' END AS social,
  h = 'dev.to' AND regexp_matches(raw, '^/[A-Za-z0-9_-]+/[A-Za-z0-9_-]+/?$') AS article FROM s""",
)
def page_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chaffsieve.functions import urls

    url = F.expr(
        """CASE page_id % 7 WHEN 0 THEN regexp_replace(url, '//[^/]*', '//github.com') WHEN 1 THEN regexp_replace(url, '//[^/]*', '//x.com')
        WHEN 2 THEN regexp_replace(url, '//[^/]*', '//dev.to') WHEN 3 THEN concat('https://github.com/a/b/pull/', page_id)
        WHEN 4 THEN concat('https://x.com/u_', page_id % 9, '/status/', page_id)
        WHEN 5 THEN concat('https://github.com/a/b/releases/tag/v', page_id) ELSE url END"""
    )
    rows = B.table(spark, sf_dir, "pages").select("page_id", url.alias("url"))
    u = F.col("url")
    return rows.select("page_id", urls.forge_kind(u).alias("forge"), urls.social_kind(u).alias("social"), urls.is_article(u).alias("article"))
