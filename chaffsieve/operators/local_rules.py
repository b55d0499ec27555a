"""Stages one and two of the filter: structured data, blanks, page cleaners and boilerplate.

Most sources need no line-by-line state: their rules are column functions. Only sources with a supported page, with
structured data or with text that may hold code go through Python, as whole source rows in Arrow batches, so that the
order-dependent rules see a source's snippets together without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chaffsieve.functions import lines as L
from chaffsieve.functions import text as T

_OUT = "kept boolean, reason string, route string, actions array<struct<cleaner:string,rule:string,line:int>>"


def needs_state(platforms: bool) -> Column:
    """Sources that column functions alone cannot decide."""
    odd = F.exists(
        "snippets",
        lambda s: F.coalesce(s.rlike(rf"^[{T.WS}]*[\[{{]") | T.needs_line_pass(s, F.col("title")), F.lit(False)),
    )
    if platforms:
        odd = odd | F.lower("url").rlike(r"^[^/]*//([^/?#]*@)?(www\.)?(github\.com|x\.com|twitter\.com|dev\.to)([:/?#]|\z)")
    return odd


def _plain(sources: DataFrame) -> DataFrame:
    rows = sources.select(
        "request_id", "source_index", "url", "title", F.posexplode("snippets").alias("index", "raw")
    ).withColumn("raw", F.coalesce("raw", F.lit("")))
    rows = rows.withColumn("blank", T.is_blank(F.col("raw"))).withColumn("clean", T.plain_stripped(F.col("raw")))
    emptied = (F.col("clean") == "") | T.is_title_only(F.col("clean"), F.col("title"))
    reason = F.when(F.col("blank"), F.lit("nav")).when(emptied, F.lit("boilerplate"))
    return rows.select(
        "request_id",
        "source_index",
        "url",
        "title",
        F.col("index").cast("long").alias("index"),
        F.lit(None).cast("long").alias("part"),
        F.when(reason.isNull(), F.col("clean")).otherwise(F.col("raw")).alias("text"),
        reason.isNull().alias("kept"),
        reason.alias("reason"),
        F.lit("not_json").alias("route"),
        F.array().cast("array<struct<cleaner:string,rule:string,line:int>>").alias("actions"),
    )


def _stateful(sources: DataFrame, platforms: bool) -> DataFrame:
    kind = dict(sources.dtypes)["request_id"]

    action = pa.struct([("cleaner", pa.string()), ("rule", pa.string()), ("line", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("url", "title", "snippets")), strict=True)
            for k, (url, title, snippets) in enumerate(rows):
                own = L.local_rules(url or "", title or "", snippets, platforms)
                at += [k] * len(own)
                out += own
            source = [batch.column(c).take(pa.array(at, pa.int64())) for c in ("request_id", "source_index", "url", "title")]
            actions = [[dict(zip(("cleaner", "rule", "line"), a, strict=True)) for a in s.actions] for s in out]
            yield pa.RecordBatch.from_arrays(
                [
                    *source,
                    pa.array([s.index for s in out], pa.int64()),
                    pa.array([s.part for s in out], pa.int64()),
                    pa.array([s.text for s in out], pa.string()),
                    pa.array([s.kept for s in out], pa.bool_()),
                    pa.array([s.reason for s in out], pa.string()),
                    pa.array([s.route for s in out], pa.string()),
                    pa.array(actions, pa.list_(action)),
                ],
                names=["request_id", "source_index", "url", "title", "index", "part", "text", "kept", "reason", "route", "actions"],
            )

    rows = sources.select("request_id", F.col("source_index").cast("long").alias("source_index"), "url", "title", "snippets")
    return rows.mapInArrow(
        run, f"request_id {kind}, source_index long, url string, title string, index long, part long, text string, {_OUT}"
    )


def applied(sources: DataFrame, platforms: bool = True) -> DataFrame:
    """Snippet rows after the local rules, with route (of structured data) and actions (of page cleaners).

    platforms: whether the page cleaners run (they do not in mode off)."""
    odd = F.coalesce(needs_state(platforms), F.lit(False))
    return _plain(sources.filter(~odd)).unionByName(_stateful(sources.filter(odd), platforms))


def counters(snippets: DataFrame) -> DataFrame:
    """One row a request with the counters of the local rules."""
    acts = lambda name: F.sum(F.size(F.filter("actions", lambda a: a["cleaner"] == name)))
    routed = lambda name: F.count_if(F.col("route") == name)
    gone = F.col("reason").isin("nav", "boilerplate")
    return snippets.groupBy("request_id").agg(
        routed("converted").alias("jsonld_converted"),
        routed("dropped_meta").alias("jsonld_dropped"),
        routed("kept_raw").alias("jsonld_kept_raw"),
        F.count_if(gone).alias("snippets_prefiltered"),
        F.count_if(F.col("reason") == "dup").alias("dup_removed"),
        acts("github").alias("github_cleanup_actions"),
        acts("x").alias("x_cleanup_actions"),
        acts("devto").alias("devto_cleanup_actions"),
    )
