"""Audit records: what was asked about each snippet, what came back and what it led to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaffsieve.functions import decisions as D

FORMAT = 9


def audit_rows(decided: DataFrame, t: D.Thresholds) -> DataFrame:
    """One row a judged snippet."""
    source = D.source_id(F.col("source_index"))
    valid = F.col("answer_state") == "ok"
    return decided.select(
        "request_id",
        source.alias("src"),
        D.snippet_key(F.col("index"), F.col("part")).alias("snippet_key"),
        D.global_key(source, F.col("group_key")).alias("question_sent"),
        "letter",
        valid.alias("valid"),
        F.when(~valid, F.col("answer_state")).alias("invalid_reason"),
        D.keep_threshold(F.col("group_size"), t).alias("threshold"),
        F.when(F.col("kept"), F.lit("keep")).otherwise(F.lit("drop")).alias("verdict"),
    )


def records(requests: DataFrame, audits: DataFrame) -> DataFrame:
    """One nested record a request. requests: request_id, query, error. A failed request has no final result, an
    explicit mark of what is missing and no audit."""
    own = audits.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("src", "snippet_key", "verdict", "threshold", "invalid_reason"))).alias("snippets"))
    failed = F.col("error").isNotNull()
    return requests.join(own, "request_id", "left").select(
        F.lit(FORMAT).alias("format"),
        "request_id",
        "query",
        F.when(failed, F.lit("error")).otherwise(F.lit("ok")).alias("outcome"),
        "error",
        F.when(failed, F.lit("final_return is missing: the request failed")).alias("missing"),
        F.when(~failed, F.coalesce("snippets", F.array().cast("array<struct<src:string,snippet_key:string,verdict:string,threshold:double,invalid_reason:string>>"))).alias("snippets"),
    )


def save(rows: DataFrame, folder: str, day: str) -> None:
    """One JSON document a request, named by the first eight digits of the SHA-256 of its id; Spark's commit protocol
    lets a failed write leave nothing behind."""
    named = rows.withColumn("sample", F.substring(F.sha2(F.col("request_id").cast("string"), 256), 1, 8))
    named.write.mode("append").partitionBy("sample").json(f"{folder.rstrip('/')}/samples/{day}")
