"""Relations that the registered queries start from, in Spark and in SQL.

Documents are sources and their lines snippets; five neighbouring ids are one request. What the tables do not hold
(markers, answers, parameters) comes from arithmetic on ids, alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaffsieve.functions.text import WS
from chaffsieve.operators import work_table

#: Lines that are added to every document, chosen by doc_id.
MARKERS = (
    "",
    "   ",
    "## Share this page!",
    "* Read next: more of it",
    "Shares of it rose today",
    "Release Time: 2024-01-02 with a very long tail that is no marker any more",
    "# Heading of its own",
    "- On this page —",
    "ON THIS PAGE",
    "Continue after ad.",
    "### Related articles / more",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work_table.document_sources(table(spark, sf_dir, "documents"))


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a marker line and the title once more at the end."""
    markers = F.array(*map(F.lit, MARKERS))
    marker = F.get(markers, (F.col("doc_id") % len(MARKERS)).cast("int"))
    first = F.get(F.split("text", "\n"), F.lit(0))
    again = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("\n"), first)).otherwise(F.lit(""))
    return table(spark, sf_dir, "documents").withColumn("text", F.concat("text", F.lit("\n"), marker, again))


def marked_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work_table.document_sources(marked_documents(spark, sf_dir))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def source_sql(text: str = "text", name: str = "src") -> str:
    return f"""{name} AS (
  SELECT doc_id // 5 AS request_id, doc_id % 5 AS source_index,
    'https://' || source || '.example.com/' || lang || '/' || doc_id AS url,
    string_split({text}, chr(10))[1] AS title, string_split({text}, chr(10)) AS snippets FROM documents)"""


def snippet_sql(source: str = "src", name: str = "snip") -> str:
    return f"""{name} AS (
  SELECT request_id, source_index, url, title, unnest(snippets) AS text, unnest(range(0, len(snippets))) AS index FROM {source})"""


_LIST = "[" + ", ".join(map(quoted, MARKERS)) + "]"
MARKED = (
    f"(text || chr(10) || {_LIST}[doc_id % {len(MARKERS)} + 1] || "
    "CASE WHEN doc_id % 3 = 0 THEN chr(10) || string_split(text, chr(10))[1] ELSE '' END)"
)


def sql_trim(x: str) -> str:
    return rf"regexp_replace({x}, '^[{WS}]+|[{WS}]+\z', '', 'g')"


def sql_units(x: str) -> str:
    return rf"(length({x}) + length(regexp_replace({x}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def sql_title(x: str) -> str:
    bare = sql_trim(rf"regexp_replace({sql_trim(x)}, '^[#*-]+', '')")
    return rf"lower(regexp_replace({bare}, '[{WS}]+', ' ', 'g'))"


def sql_line(x: str) -> str:
    return sql_trim(rf"regexp_replace({x}, '^[#*{WS}-]+', '')")


def sql_line_key(x: str) -> str:
    return rf"regexp_replace(lower({sql_line(x)}), '[\p{{P}}\p{{S}}{WS}]+\z', '')"


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression of literal rows."""

    def lit(v: object) -> str:
        return "NULL" if v is None else quoted(v) if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else repr(v)

    return f"{name}({columns}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"
