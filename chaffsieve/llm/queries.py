"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chaffsieve.llm import boosted_rules, bpe, chat_format, decontam, license_scan, line_dedup, near_dup, qda, secret_scan, url_filter
from chaffsieve.llm._common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _tokenizer() -> str:
    """The installed vocabulary file; a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), _tokenizer()).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op3_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qda.classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.marked(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        "n_lines",
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join("removed", ",").alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["end"].cast("string")))
    return chat_format.rotated(table(spark, sf_dir, "conversations")).select(
        "conv_id",
        "speaker",
        "chunk",
        "first_message",
        "n_turns",
        "start",
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.array_join(spans, ",").alias("mask"),
    )


#: Host, path and verdict of the registered URL rules.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judged(table(spark, sf_dir, "pages"), rules)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = secret_scan.listed(F.col("spans"), secret_scan.KINDS[:3])
    return secret_scan.scanned(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *map(count, secret_scan.KINDS[:3]),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"),
        secret_scan.listed(F.col("spans")).alias("spans"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boosted_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Score of a phrase without a verified license text.
PHRASE_SCORE = 0.5


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array_union("base", F.transform("spans", lambda s: s["label"]))
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["covered"])), F.lit(0.0))
    return license_scan.scanned(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.greatest(best, F.when(F.col("n_base") > 0, F.lit(PHRASE_SCORE)).otherwise(F.lit(0.0))).alias("score"),
    )


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=2, threshold=(80, 100))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_decontam": op2_decontam,
    "op3_quality_qda": op3_quality_qda,
    "op4_line_dedup": op4_line_dedup,
    "op5_chat_format": op5_chat_format,
    "op6_url_filter": op6_url_filter,
    "op7_secret_scan": op7_secret_scan,
    "op8_quality_rules": op8_quality_rules,
    "op9_license_scan": op9_license_scan,
    "op10_near_dup": op10_near_dup,
}

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

SQL: dict[str, str] = {
    "op2_decontam": rf"""
WITH items AS (
  SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM items)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
places AS (
  SELECT doc_id, size, w, unnest(range(1, len(w) - size + 2)) AS i
  FROM docs CROSS JOIN (SELECT DISTINCT size FROM windows)),
found AS (
  SELECT doc_id, p.i, p.size, item_id
  FROM places p JOIN windows v ON v.size = p.size AND v.g = array_to_string(p.w[p.i:p.i + p.size - 1], ' ')),
covered AS (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS k FROM found),
owners AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_hit FROM covered GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN n USING (doc_id) LEFT JOIN owners USING (doc_id)""",
    "op4_line_dedup": r"""
WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
windows AS (
  SELECT doc_id, i, l[i + 1] || chr(10) || l[i + 2] || chr(10) || l[i + 3] AS g
  FROM (SELECT doc_id, l, unnest(range(0, len(l) - 2)) AS i FROM docs)),
ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r
  FROM windows WHERE regexp_matches(g, '[^\x20\x09-\x0D]')),
gone AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS k FROM ranked WHERE r > 1),
lines AS (SELECT doc_id, unnest(l) AS x, unnest(range(0, len(l))) AS k FROM docs),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(g.k) AS n_removed,
    string_agg(CAST(g.k AS VARCHAR), ',' ORDER BY g.k) AS removed,
    string_agg(x, chr(10) ORDER BY lines.k) FILTER (WHERE g.k IS NULL) AS rest
  FROM lines LEFT JOIN gone g USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, coalesce(removed, '') AS removed, sha256(coalesce(rest, '')) AS text_sha256 FROM kept""",
    "op5_chat_format": f"""
WITH said AS (
  SELECT DISTINCT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '{chat_format.UNKNOWN}') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, md5(role || chr(10) || text), role, text) - 1 AS k FROM said),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM said WHERE role <> '{chat_format.SYSTEM}'),
parts AS (
  SELECT conv_id, speaker, k, text, role = speaker AS own,
    '{chat_format.OPEN}' || CASE WHEN role = speaker THEN '{chat_format.OWN}' WHEN role = '{chat_format.SYSTEM}' THEN role
      ELSE '{chat_format.OTHER}' || role END || chr(10) AS head
  FROM numbered JOIN speakers USING (conv_id)),
placed AS (
  SELECT *, CAST(coalesce(sum(length(head) + length(text) + {len(chat_format.CLOSE)}) OVER (
    PARTITION BY conv_id, speaker ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pos
  FROM parts)
SELECT conv_id, speaker, k // {chat_format.BLOCK} AS chunk, min(k) AS first_message, count(*) AS n_turns, min(pos) AS start,
  sha256(string_agg(head || text || '{chat_format.CLOSE.strip()}' || chr(10), '' ORDER BY k)) AS text_sha256,
  coalesce(string_agg((pos + length(head)) || ':' || (pos + length(head) + length(text)), ',' ORDER BY k) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, speaker, k // {chat_format.BLOCK}""",
    "op6_url_filter": f"""
WITH rules(host, path, verdict) AS (VALUES {', '.join(map(str, URL_RULES))}),
cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
hits AS (
  SELECT s.page_id, s.host, s.path, r.host || r.path AS rule, r.verdict
  FROM split s LEFT JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS r FROM hits) WHERE r = 1""",
    "op10_near_dup": rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM words),
items AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
  WHERE 100 * c >= 80 * (len(x.s) + len(y.s) - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (
  SELECT doc_id AS id, doc_id AS c FROM sets
  UNION SELECT e.b, r.c FROM reached r JOIN both_ways e ON e.a = r.id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m AS component_id, doc_id = m AS kept
FROM sets JOIN (SELECT id, min(c) AS m FROM reached GROUP BY id) ON id = doc_id""",
}
