"""Queries of tiles, answers, verdicts, roll-ups and output, with probabilities from arithmetic on ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaffsieve.functions import decisions as D
from chaffsieve.functions import text as T
from chaffsieve.operators import classifier, rollups, verdicts, work_table
from chaffsieve.plans import base as B
from chaffsieve.plans.registry import query
from chaffsieve.plans.text_queries import COVER_SQL

KEY = ["request_id", "source_index"]
_BASE = f"{B.source_sql()}, {B.snippet_sql()}"

# Tiles of the kept snippets: every seventh snippet counts as dropped before.
_TILES = f"""WITH {_BASE}, kept AS (SELECT * FROM snip WHERE index % 7 <> 6),
placed AS (SELECT *, row_number() OVER (PARTITION BY request_id, source_index ORDER BY index) - 1 AS position,
  count(*) OVER (PARTITION BY request_id, source_index) AS n_candidates FROM kept),
tiles AS (SELECT *, position - position % 3 AS group_start, least(3, n_candidates - (position - position % 3)) AS group_size,
  substr('ABC', CAST(position % 3 + 1 AS INTEGER), 1) AS letter FROM placed)"""


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = B.sources(spark, sf_dir)
    rows = work_table.snippet_rows(sources).withColumn("kept", F.col("index") % 7 != 6)
    return classifier.tiled(classifier.candidates(sources.withColumn("verdict", F.lit("keep")), rows))


@query(
    "w01_p17_snippet_tiles",
    f"{_TILES} SELECT request_id, source_index, index, position, group_start, group_size, 'group' || group_start AS group_key, letter FROM tiles",
)
def snippet_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir).select(*KEY, "index", "position", "group_start", "group_size", "group_key", "letter")


_LABELS = "[['none','A'],['none','A','B','AB'],['none','A','B','AB','C','AC','BC','ABC']]"


@query(
    "f44_f45_f47_questions",
    f"""{_TILES}, groups AS (SELECT DISTINCT request_id, source_index, group_start, group_size FROM tiles)
SELECT request_id, source_index, 's' || source_index || '__group' || group_start AS global_key, 'choice' AS type,
  array_to_string({_LABELS}[group_size], ',') AS labels, array_to_string(list_transform(range(0, group_size),
    lambda k: substr('ABC', CAST(k + 1 AS INTEGER), 1) || '=s' || source_index || '[' || (group_start + k) || ']'), '; ') || '. ' ||
    CASE WHEN group_size = 1 THEN 'Keep A if it holds information specific to the intent.'
    ELSE 'Select exactly the letters that hold information specific to the intent, or none.' END AS instructions FROM groups
UNION ALL SELECT DISTINCT request_id, source_index, 's' || source_index || '__filler', 'noul', NULL,
  'No snippet of source s' || source_index || ' helps to answer the intent.' FROM tiles""",
)
def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.questions(_tiles(spark, sf_dir)).select(
        *KEY, "global_key", "type", F.array_join("labels", ",").alias("labels"), "instructions"
    )


_RULES = ("Keep A if it holds information specific to the intent.", "Select exactly the letters that hold information specific to the intent, or none.")
_SET = f"""'["No snippet of source s0 helps to answer the intent.","A=s0[0]. {_RULES[0]}","A=s0[0]; B=s0[1]. {_RULES[1]}",' ||
  '"A=s0[0]; B=s0[1]; C=s0[2]. {_RULES[1]}",' || array_to_string(list_transform({_LABELS}, lambda l: '["' || array_to_string(l, '","') || '"]'), ',') || ']'"""


@query("f46_question_set_id", f"SELECT substr(sha256({_SET}), 1, 12) AS id")
def question_set_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(D.question_set_id().alias("id"))


@query(
    "j12_group_map",
    f"""{_TILES}, maps AS (SELECT request_id, source_index, group_start // 3 % 2 AS ord, list(DISTINCT group_start ORDER BY group_start) AS groups FROM tiles GROUP BY ALL)
SELECT request_id, 's' || source_index AS source_id, array_to_string(arg_max(groups, ord), ',') AS groups FROM maps GROUP BY request_id, source_index""",
)
def group_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = F.array_sort(F.collect_set("group_start")).alias("groups")
    maps = _tiles(spark, sf_dir).groupBy("request_id", D.source_id(F.col("source_index")).alias("source_id"), F.expr("group_start div 3 % 2").alias("ord")).agg(groups)
    return classifier.group_map(maps).select("request_id", "source_id", F.array_join("groups", ",").alias("groups"))


@query(
    "p20_request_summaries",
    f"""{_TILES} SELECT request_id, count(DISTINCT source_index) AS n_sources, count(*) AS n_snippets, CAST(sum({B.sql_units('text')}) AS BIGINT) AS n_chars
FROM tiles GROUP BY request_id""",
)
def request_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = _tiles(spark, sf_dir).groupBy("request_id").agg(
        F.count_distinct("source_index").alias("n_sources"), F.count("*").alias("n_snippets"), F.sum(T.utf16_length(F.col("text"))).alias("n_chars"),
        *(F.lit("text").alias(c) for c in rollups.BODY),
    )
    return rollups.request_summary(requests)


@query(
    "d03_s12_classifier_state",
    f"""{_TILES}, one AS (
  SELECT request_id, source_index, '"s' || source_index || '":{{"id":"s' || source_index || '","url":' || to_json(any_value(url)) || ',"title":' || to_json(any_value(title)) ||
    ',"snippets":' || to_json(list(text ORDER BY position)) || ',"page_date":"2024-02-29"}}' AS body FROM tiles GROUP BY request_id, source_index)
SELECT request_id, '{{"query":"q' || request_id || '","intent":"find it","sources":{{' || string_agg(body, ',' ORDER BY source_index) ||
  '}},"retrieval_time":"2024-05-01T10:00:00Z"}}' AS state FROM one GROUP BY request_id""",
)
def classifier_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles, sources = _tiles(spark, sf_dir), B.sources(spark, sf_dir)
    age = F.to_json(F.struct(F.array(F.lit("3 days ago"), F.lit("2024-02-29")).alias("age")))
    requests = sources.select("request_id").distinct().select(
        "request_id", F.concat(F.lit("q"), "request_id").alias("query"), F.lit("find it").alias("intent"), F.lit("2024-05-01T10:00:00Z").alias("retrieval_time")
    )
    return classifier.state(requests, sources.withColumn("meta", age), tiles)


# Answers: probabilities of the labels of a tile; some tiles lack labels, some sums are off, some are missing.
_P = "CAST(((request_id * 31 + source_index * 17 + group_start * 7 + {k} * 13) % 97 + 1) AS DOUBLE)"
_WEIGHTS = "[" + ", ".join(_P.format(k=k) for k in range(8)) + "]"
_KIND = "(request_id + source_index + group_start) % 11"


def _answers(tiles: DataFrame) -> DataFrame:
    groups = tiles.select(*KEY, "group_start", "group_size", "group_key").distinct()
    weights = F.expr("array(" + ", ".join(_P.format(k=k) for k in range(8)) + ")")
    labels = D.option_labels(F.col("group_size").cast("int"))
    rows = groups.withColumn("w", F.slice(weights, F.lit(1), F.size(labels))).withColumn("l", labels)
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    kind = F.expr(_KIND)
    scale = F.when(kind == 3, F.lit(1.25)).otherwise(F.lit(1.0))
    rows = rows.withColumn("p", F.transform("w", lambda x: x / total * scale))
    answer = F.map_from_arrays(F.when(kind == 5, F.transform("l", lambda x: F.concat(x, F.lit("?")))).otherwise(F.col("l")), F.col("p"))
    source = D.source_id(F.col("source_index"))
    choice = rows.filter(kind != 7).select(
        "request_id", D.global_key(source, F.col("group_key")).alias("global_key"), F.lit("choice").alias("type"), F.lit(None).cast("double").alias("noul"), answer.alias("probabilities")
    )
    pages = tiles.select(*KEY).distinct().select(
        "request_id", D.global_key(source, F.lit("filler")).alias("global_key"), F.lit("noul").alias("type"), _page_p().alias("noul"),
        F.lit(None).cast("map<string,double>").alias("probabilities"),
    )
    return choice.unionByName(pages)


_PAGE = "CASE WHEN (request_id + source_index) % 13 = 4 THEN NULL WHEN (request_id + source_index) % 17 = 5 THEN 1.5 ELSE CAST((request_id * 29 + source_index * 41) % 101 AS DOUBLE) / 100 END"


def _page_p():
    return F.expr(_PAGE.replace("1.5", "1.5D"))


_JUDGED = f"""{_TILES}, weighed AS (
  SELECT *, {_WEIGHTS}[1:CAST(pow(2, group_size) AS INTEGER)] AS w, {_LABELS}[group_size] AS l, {_KIND} AS kind FROM tiles),
scaled AS (SELECT *, list_reduce(w, lambda a, x: a + x) AS total, CASE WHEN kind = 3 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END AS f FROM weighed),
judged AS (
  SELECT *, CASE kind WHEN 7 THEN 'missing' WHEN 5 THEN 'labels' WHEN 3 THEN 'sum' ELSE 'ok' END AS answer_state,
    CASE WHEN kind IN (3, 5, 7) THEN NULL ELSE list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len(l) + 1),
      lambda i: CASE WHEN contains(l[i], letter) THEN w[i] / total * f ELSE 0.0::DOUBLE END)), lambda a, x: a + x) END AS keep_probability
  FROM scaled)"""


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tiles = _tiles(spark, sf_dir)
    got = classifier.answered(classifier.questions(tiles), _answers(tiles))
    return classifier.judged_snippets(tiles, got), classifier.page_answers(got)


@query(
    "j03_a10_a11_u06_marginals",
    f"{_JUDGED} SELECT request_id, source_index, index, answer_state, round(keep_probability, 12) AS keep_probability FROM judged",
)
def marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judged(spark, sf_dir)[0].select(*KEY, "index", "answer_state", F.round("keep_probability", 12).alias("keep_probability"))


_T = D.Thresholds()
_SLACK = f"{D.NEAR_GAP + D.SLACK!r}::DOUBLE"
_PAGES = f"""pages AS (
  SELECT DISTINCT request_id, source_index, {_PAGE} AS p FROM tiles),
paged AS (
  SELECT *, p IS NOT NULL AND p BETWEEN 0 AND 1 AS good,
    coalesce(p IS NOT NULL AND p BETWEEN 0 AND 1 AND (p >= {_T.page_drop}::DOUBLE OR {_T.page_drop}::DOUBLE - p <= {_SLACK}), false) AS drops,
    CASE WHEN p < {_T.page_drop}::DOUBLE AND {_T.page_drop}::DOUBLE - p <= {_SLACK} THEN least({_T.page_drop}::DOUBLE - p, 0.02::DOUBLE) END AS gap FROM pages)"""


def _paged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    judged, pages = _judged(spark, sf_dir)
    sources = B.sources(spark, sf_dir).withColumns({"verdict": F.lit("keep"), "reason": F.lit(None).cast("string")})
    return verdicts.page_verdicts(sources, pages.withColumn("status", F.lit("answered")), _T), judged


@query(
    "f39_f41_d04_page_verdicts",
    f"""{_TILES}, {_PAGES} SELECT request_id, source_index, CASE WHEN drops THEN 'drop' ELSE 'keep' END AS verdict,
  CASE WHEN drops THEN 'filler' END AS reason, CASE WHEN NOT good THEN 'validation' END AS fail_kind, round(gap, 12) AS near_gap FROM paged""",
)
def page_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paged(spark, sf_dir)[0].select(*KEY, "verdict", "reason", "fail_kind", F.round("near_gap", 12).alias("near_gap"))


_CUT = f"CASE WHEN group_size >= 2 THEN {_T.group_keep}::DOUBLE ELSE {_T.single_keep}::DOUBLE END"
FINAL_SQL = _FINAL = f"""{_JUDGED}, {_PAGES}, decided AS (
  SELECT j.*, coalesce(NOT drops AND (keep_probability < {_CUT} OR keep_probability - ({_CUT}) <= {_SLACK}), false) AS gone,
    CASE WHEN NOT drops AND keep_probability >= {_CUT} AND keep_probability - ({_CUT}) <= {_SLACK}
      THEN least(keep_probability - ({_CUT}), 0.02::DOUBLE) END AS gap, drops, good
  FROM judged j JOIN paged USING (request_id, source_index))"""


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sources, judged = _paged(spark, sf_dir)
    active = sources.select(*KEY, (F.col("verdict") == "keep").alias("active"))
    return sources, verdicts.snippet_verdicts(judged.join(active, KEY), _T)


@query(
    "f40_f42_j05_d05_snippet_verdicts",
    f"""{_FINAL} SELECT request_id, source_index, index, NOT gone AS kept, CASE WHEN gone THEN 'keep_probability' END AS reason,
  round(gap, 12) AS near_gap FROM decided""",
)
def snippet_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir)[1].select(*KEY, "index", "kept", "reason", F.round("near_gap", 12).alias("near_gap"))


@query(
    "p19_cleanup_eligible",
    f"""{_FINAL} SELECT request_id, source_index FROM decided GROUP BY ALL
HAVING bool_and(NOT drops AND good AND answer_state = 'ok' AND keep_probability BETWEEN 0 AND 1)""",
)
def cleanup_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, judged = _paged(spark, sf_dir)
    return verdicts.cleanup_eligible(sources, judged)


#: Eligible sources and what their kept snippets cover, after decided.
CLEANED_SQL = f"""eligible AS (SELECT request_id, source_index FROM decided GROUP BY ALL
  HAVING bool_and(NOT drops AND good AND answer_state = 'ok' AND keep_probability BETWEEN 0 AND 1)),
clean AS (SELECT * FROM decided JOIN eligible USING (request_id, source_index) WHERE NOT gone),
{COVER_SQL.replace('FROM snip', 'FROM clean').replace('index AS position', 'position')}"""


@query(
    "d06_final_cleanup",
    f"""{_FINAL}, {CLEANED_SQL} SELECT d.request_id, d.source_index, index, NOT gone AND c.position IS NULL AS kept,
  CASE WHEN c.position IS NOT NULL THEN 'dup' WHEN gone THEN 'keep_probability' END AS reason, covered_by,
  CASE WHEN c.position IS NOT NULL THEN 'same_source_exact_coverage' END AS final
FROM decided d LEFT JOIN covered c ON c.request_id = d.request_id AND c.source_index = d.source_index AND c.position = d.position""",
)
def final_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, judged = _paged(spark, sf_dir)
    _, rows = _decided(spark, sf_dir)
    return verdicts.final_cleanup(rows, verdicts.cleanup_eligible(sources, judged)).select(*KEY, "index", "kept", "reason", "covered_by", "final")


_ENDED = f"""{_FINAL}, alive AS (SELECT request_id, source_index, count(*) FILTER (WHERE NOT gone) AS n_kept,
  coalesce(sum({B.sql_units('text')}) FILTER (WHERE NOT gone), 0) AS units, count(*) FILTER (WHERE gone) AS n_gone, bool_or(drops) AS drops FROM decided GROUP BY ALL),
ended AS (SELECT *, CASE WHEN drops OR n_kept = 0 THEN 'drop' ELSE 'keep' END AS verdict,
  CASE WHEN drops THEN 'filler' WHEN n_kept = 0 THEN 'empty' END AS reason FROM alive)"""


def _ended(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sources, rows = _decided(spark, sf_dir)
    return verdicts.finished(sources, rows), rows


@query("p16_d07_drop_empty", f"{_ENDED} SELECT request_id, source_index, verdict, reason, n_kept FROM ended")
def drop_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ended(spark, sf_dir)[0].select(*KEY, "verdict", "reason", "n_kept")


@query(
    "a01_input_scale",
    f"""WITH {B.source_sql()} SELECT request_id, count(*) AS n_sources, CAST(sum(len(snippets)) AS BIGINT) AS n_snippets,
  CAST(sum(list_sum(list_transform(snippets, lambda x: {B.sql_units('x')}))) AS BIGINT) AS n_chars FROM src GROUP BY request_id""",
)
def input_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.input_scale(B.sources(spark, sf_dir))


@query(
    "a02_output_scale",
    f"""{_ENDED} SELECT request_id, count(*) AS n_sources, CAST(sum(n_kept) AS BIGINT) AS n_snippets, CAST(sum(units) AS BIGINT) AS n_chars
FROM ended WHERE verdict = 'keep' GROUP BY request_id""",
)
def output_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.output_scale(*_ended(spark, sf_dir))


@query(
    "a04_reason_histogram",
    f"{_ENDED} SELECT request_id, reason, count(*) AS n, min(source_index) AS first FROM ended WHERE verdict = 'drop' GROUP BY ALL",
)
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.reason_histogram(_ended(spark, sf_dir)[0])


@query(
    "a05_removed_in_kept",
    f"{_ENDED} SELECT request_id, CAST(sum(n_gone) AS BIGINT) AS n_removed FROM ended WHERE verdict = 'keep' GROUP BY ALL",
)
def removed_in_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.removed_in_kept(*_ended(spark, sf_dir))


_STATUS = "CASE (request_id * 3 + source_index) % 19 WHEN 2 THEN 'failed' WHEN 3 THEN 'breaker_open' ELSE 'answered' END"
_FAIL = "CASE (request_id * 3 + source_index) % 19 WHEN 2 THEN 'timeout' WHEN 5 THEN 'validation' END"
_INVALID = "CASE WHEN (request_id + source_index) % 23 = 1 THEN 1 ELSE 0 END"


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.sources(spark, sf_dir).filter("(request_id + source_index) % 29 <> 0").select(
        *KEY, F.expr(_STATUS).alias("status"), F.expr(_FAIL).alias("fail_kind"), F.expr(_INVALID).alias("n_invalid_groups")
    )


_CHECKED = f"""WITH {B.source_sql()}, checks AS (SELECT request_id, source_index, {_STATUS} AS status, {_FAIL} AS fail_kind, {_INVALID} AS n_bad
  FROM src WHERE (request_id + source_index) % 29 <> 0),
rows AS (SELECT s.request_id, c.*EXCLUDE (request_id, source_index), coalesce(c.status <> 'answered' OR c.fail_kind = 'validation' OR c.n_bad > 0, c.status IS NULL) AS bad
  FROM src s LEFT JOIN checks c USING (request_id, source_index)),
kinds AS (SELECT request_id, count(*) FILTER (WHERE bad) AS n_unchecked, list_sort(list_distinct(flatten(list(
  list_filter([CASE WHEN n_bad > 0 THEN 'validation' END, CASE WHEN status = 'breaker_open' THEN 'circuit_breaker' ELSE fail_kind END], lambda k: k IS NOT NULL))
  FILTER (WHERE bad)))) AS kinds FROM rows GROUP BY request_id)"""


@query(
    "a06_j11_unchecked",
    f"{_CHECKED} SELECT request_id, n_unchecked, coalesce(array_to_string(kinds, ','), '') AS kinds FROM kinds",
)
def unchecked(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = B.sources(spark, sf_dir).withColumn("verdict", F.lit("keep"))
    out = rollups.unchecked(sources, _checks(spark, sf_dir))
    return out.select("request_id", "n_unchecked", F.array_join("kinds", ",").alias("kinds"))


@query(
    "a07_status",
    f"""{_CHECKED} SELECT request_id, CASE WHEN bool_or(status = 'breaker_open') THEN 'breaker_open'
  WHEN bool_or(status = 'failed') THEN 'degraded' ELSE 'ok' END AS status FROM checks GROUP BY request_id""",
)
def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.status(_checks(spark, sf_dir))


_CALLS = """SELECT o_custkey AS request_id, o_orderkey AS seq, o_orderkey % 5 <> 0 AS dispatched, o_orderkey % 7 <> 0 AS answered,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) END AS input_tokens, o_orderkey % 1000 AS latency_ms,
  o_orderkey % 3 + 1 AS attempts, CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE o_orderkey % 3 + 1 END AS attempts_with_usage,
  concat('m', o_orderkey % 4) AS model FROM orders"""


@query(
    "a08_a09_a15_accounting",
    f"""WITH calls AS ({_CALLS}), firsts AS (SELECT request_id, model, min(seq) AS s FROM calls WHERE answered GROUP BY ALL),
names AS (SELECT request_id, string_agg(model, ',' ORDER BY s) AS models FROM firsts GROUP BY request_id)
SELECT request_id, count(*) FILTER (WHERE dispatched) AS n_calls, CAST(sum(coalesce(input_tokens, 0)) FILTER (WHERE dispatched) AS BIGINT) AS input_tokens,
  CAST(sum(latency_ms) FILTER (WHERE dispatched) AS BIGINT) AS latency_ms, CAST(sum(attempts) FILTER (WHERE dispatched) AS BIGINT) AS attempts,
  bool_and(attempts = attempts_with_usage) FILTER (WHERE dispatched) AS usage_complete, coalesce(any_value(models), '') AS models
FROM calls LEFT JOIN names USING (request_id) GROUP BY request_id""",
)
def accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    B.table(spark, sf_dir, "orders").createOrReplaceTempView("_orders")
    return rollups.accounting(spark.sql(_CALLS.replace("FROM orders", "FROM _orders")))


@query(
    "f52_status_line",
    f"""{_ENDED}, per AS (SELECT request_id, count(*) AS n, count(*) FILTER (WHERE verdict = 'drop') AS d,
  coalesce(CAST(sum(n_gone) FILTER (WHERE verdict = 'keep') AS BIGINT), 0) AS gone FROM ended GROUP BY request_id),
reasons AS (SELECT request_id, string_agg(c || ' ' || reason, ', ' ORDER BY f) AS said FROM (
  SELECT request_id, reason, count(*) AS c, min(source_index) AS f FROM ended WHERE verdict = 'drop' GROUP BY ALL) GROUP BY request_id)
SELECT request_id, CASE WHEN d + gone > 0 THEN '[filter] ' || concat_ws('; ',
  CASE WHEN d > 0 THEN 'dropped ' || d || ' of ' || n || CASE WHEN n = 1 THEN ' source: ' ELSE ' sources: ' END || said END,
  CASE WHEN gone > 0 THEN gone || CASE WHEN gone = 1 THEN ' snippet removed' ELSE ' snippets removed' END END) END AS status_line
FROM per LEFT JOIN reasons USING (request_id)""",
)
def status_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources, rows = _ended(spark, sf_dir)
    reasons = rollups.reason_histogram(sources).groupBy("request_id").agg(F.collect_list(F.struct("first", "reason", "n")).alias("reasons"))
    per = (
        sources.groupBy("request_id")
        .agg(F.count("*").alias("n_sources"), F.count_if(F.col("verdict") == "drop").alias("n_dropped"))
        .join(reasons, "request_id", "left")
        .join(rollups.removed_in_kept(sources, rows), "request_id", "left")
    )
    return rollups.status_line(
        per.select(
            "request_id", "n_sources", "n_dropped", F.coalesce("reasons", F.array().cast("array<struct<first:bigint,reason:string,n:bigint>>")).alias("reasons"),
            F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.lit(0).alias("n_unchecked"), F.array().cast("array<string>").alias("kinds"),
            F.create_map().cast("map<string,int>").alias("codes"),
        )
    )


@query(
    "p12_o01_rebuilt_output",
    f"""{_ENDED}, texts AS (SELECT request_id, source_index, string_agg(text, chr(31) ORDER BY index) AS t FROM decided WHERE NOT gone GROUP BY ALL)
SELECT request_id, string_agg(url || chr(30) || t, chr(29) ORDER BY source_index) AS generic, count(DISTINCT url) AS n_urls
FROM ended JOIN texts USING (request_id, source_index) JOIN src USING (request_id, source_index) WHERE verdict = 'keep' GROUP BY request_id""",
)
def rebuilt_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = work_table.rebuilt(*_ended(spark, sf_dir))
    item = lambda x: F.concat(x["url"], F.lit("\x1e"), F.array_join(x["snippets"], "\x1f"))
    return out.select(
        "request_id", F.array_join(F.transform("generic", item), "\x1d").alias("generic"), F.size("sources").cast("long").alias("n_urls")
    )


@query(
    "p14_stats_projection",
    f"""{_FINAL} SELECT request_id, source_index, index, {B.sql_units('text')} AS chars, NOT gone AS kept FROM decided""",
)
def stats_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir)[1].select(*KEY, "index", T.utf16_length(F.col("text")).cast("long").alias("chars"), "kept")


@query(
    "s16_s17_j10_sample_rows",
    f"""{_FINAL} SELECT request_id, 's' || source_index AS src, CAST(index AS VARCHAR) AS snippet_key, 's' || source_index || '__group' || group_start AS question_sent,
  letter, answer_state = 'ok' AS valid, CASE WHEN answer_state <> 'ok' THEN answer_state END AS invalid_reason, {_CUT} AS threshold,
  CASE WHEN gone THEN 'drop' ELSE 'keep' END AS verdict FROM decided""",
)
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chaffsieve.sources.samples import audit_rows

    return audit_rows(_decided(spark, sf_dir)[1], _T)
