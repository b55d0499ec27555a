"""Sources and snippets of search responses as tables, and back.

A source row has request_id, source_index, url, title, meta and snippets; a snippet row has request_id, source_index,
index, part, text, kept and reason. Rows are marked, never deleted, and order is carried in the index columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

META = "map<string,string>"
#: A response as read from JSON; metadata entries stay JSON text until they are trimmed.
RESPONSE = (
    "request_id string, grounding struct<generic:array<struct<url:string,title:string,snippets:array<string>>>,"
    "map:array<string>,poi:string>, sources map<string,string>"
)


def response_sources(responses: DataFrame) -> DataFrame:
    """One row a source. A source without snippets stays; metadata is found by the source's own url."""
    return responses.select(
        "request_id", F.posexplode("grounding.generic").alias("source_index", "item"), "sources"
    ).select(
        "request_id",
        F.col("source_index").cast("long").alias("source_index"),
        F.coalesce("item.url", F.lit("")).alias("url"),
        F.coalesce("item.title", F.lit("")).alias("title"),
        F.try_element_at("sources", F.coalesce("item.url", F.lit(""))).alias("meta"),
        F.coalesce("item.snippets", F.array().cast("array<string>")).alias("snippets"),
    )


def document_sources(docs: DataFrame, per_request: int = 5) -> DataFrame:
    """Documents as sources: lines are snippets, the first line is the title, neighbouring ids are one request."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return docs.select(
        F.floor(F.col("doc_id") / per_request).alias("request_id"),
        (F.col("doc_id") % per_request).alias("source_index"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.get(lines, F.lit(0)).alias("title"),
        F.lit(None).cast("string").alias("meta"),
        lines.alias("snippets"),
    )


def snippet_rows(sources: DataFrame) -> DataFrame:
    """Every snippet kept; values that are no text are empty."""
    return sources.select(
        "request_id", "source_index", "url", "title", F.posexplode("snippets").alias("index", "text")
    ).select(
        "request_id",
        "source_index",
        "url",
        "title",
        F.col("index").cast("long").alias("index"),
        F.lit(None).cast("long").alias("part"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.lit(True).alias("kept"),
        F.lit(None).cast("string").alias("reason"),
    )


def trimmed_meta(meta: Column) -> Column:
    """Title, hostname and the first entry of age that begins like a date, from JSON text; what is missing is null."""
    m = F.from_json(meta, "title string, hostname string, age array<string>")
    age = F.get(F.filter(m["age"], lambda x: x.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}")), 0)
    return F.struct(m["title"].alias("title"), m["hostname"].alias("hostname"), F.when(age.isNotNull(), F.array(age)).alias("age"))


def drop_empty(sources: DataFrame, snippets: DataFrame) -> DataFrame:
    """Sources with verdict and reason: those that are kept but have no kept snippet are dropped as empty."""
    alive = snippets.groupBy("request_id", "source_index").agg(F.count_if("kept").alias("n_kept"))
    out = sources.join(alive, ["request_id", "source_index"], "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0).cast("long")))
    verdict = F.col("verdict") if "verdict" in sources.columns else F.lit("keep")
    reason = F.col("reason") if "reason" in sources.columns else F.lit(None).cast("string")
    empty = (verdict == "keep") & (F.col("n_kept") == 0)
    return out.withColumns(
        {"reason": F.when(empty, F.lit("empty")).otherwise(reason), "verdict": F.when(empty, F.lit("drop")).otherwise(verdict)}
    )


def rebuilt(sources: DataFrame, snippets: DataFrame) -> DataFrame:
    """One row a request: generic (kept sources with kept texts, in order) and sources (metadata by url, last wins)."""
    texts = (
        snippets.filter("kept")
        .groupBy("request_id", "source_index")
        .agg(F.array_sort(F.collect_list(F.struct("index", "part", "text"))).alias("s"))
        .select("request_id", "source_index", F.transform("s", lambda x: x["text"]).alias("texts"))
    )
    alive = sources.filter("verdict = 'keep'").join(texts, ["request_id", "source_index"], "left")
    item = F.struct("source_index", "url", "title", F.coalesce("texts", F.array().cast("array<string>")).alias("snippets"), trimmed_meta(F.col("meta")).alias("meta"))
    one = alive.groupBy("request_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    # The last source of a url gives its metadata: of the reversed list the first of each url is kept.
    urls = F.transform("items", lambda x: x["url"])
    last = F.filter("items", lambda x, i: F.array_position(F.reverse(urls), x["url"]) == F.size("items") - i)
    return one.select(
        "request_id",
        F.transform("items", lambda x: F.struct(x["url"].alias("url"), x["title"].alias("title"), x["snippets"].alias("snippets"))).alias("generic"),
        F.map_from_entries(F.transform(last, lambda x: F.struct(x["url"], x["meta"]))).alias("sources"),
    )


def compacted(items: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items (request_id, source_index, url, title) with the age of their metadata, and what metadata is left.

    meta: request_id, url, title, hostname, age, extra. A title goes if all items of its url have it, a hostname if the
    url says it; rows with nothing left go; metadata of no item stays whole.
    """
    out = items.join(meta.select("request_id", "url", "age"), ["request_id", "url"], "left")
    shown = items.groupBy("request_id", "url").agg(F.min("title").alias("_low"), F.max("title").alias("_high"))
    left = meta.join(shown, ["request_id", "url"], "left").withColumn("_used", F.col("_low").isNotNull())
    same = F.col("_used") & (F.col("_low") == F.col("title")) & (F.col("_high") == F.col("title"))
    host = F.lower(F.expr("try_parse_url(url, 'HOST')"))
    rest = left.select(
        "request_id",
        "url",
        F.when(~F.coalesce(same, F.lit(False)), F.col("title")).alias("title"),
        F.when(~(F.col("_used") & F.coalesce(F.col("hostname") == host, F.lit(False))), F.col("hostname")).alias("hostname"),
        F.when(~F.col("_used"), F.col("age")).alias("age"),
        "extra",
        "_used",
    )
    return out, rest.filter("not _used or title is not null or hostname is not null or extra is not null").drop("_used")
