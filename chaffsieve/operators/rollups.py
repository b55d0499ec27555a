"""Statistics of requests: scales, counters, histograms, status and the status line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chaffsieve.functions.text import utf16_length

#: Failure kinds in the order in which one is reported, with its words and code.
FAILURES = (
    ("no_key", "missing API key", 401),
    ("auth", "unauthorized", 401),
    ("circuit_breaker", "circuit breaker open", 503),
    ("rate_limited", "rate limited", 429),
    ("timeout", "timeout", 408),
    ("network", "upstream error", 500),
    ("validation", "payload rejected", 422),
)


def input_scale(sources: DataFrame) -> DataFrame:
    """Sources, snippets and UTF-16 units of what came in; sources without snippets count."""
    chars = F.aggregate(
        F.transform("snippets", lambda s: utf16_length(F.coalesce(s, F.lit(""))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return sources.groupBy("request_id").agg(
        F.count("*").alias("n_sources"), F.sum(F.size("snippets")).alias("n_snippets"), F.sum(chars).alias("n_chars")
    )


def output_scale(sources: DataFrame, snippets: DataFrame) -> DataFrame:
    """The same over kept sources and their kept snippets."""
    kept = snippets.filter("kept").groupBy("request_id", "source_index").agg(
        F.count("*").alias("n"), F.sum(utf16_length(F.col("text")).cast("long")).alias("c")
    )
    alive = sources.filter("verdict = 'keep'").join(kept, ["request_id", "source_index"], "left")
    return alive.groupBy("request_id").agg(
        F.count("*").alias("n_sources"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_snippets"), F.coalesce(F.sum("c"), F.lit(0).cast("long")).alias("n_chars")
    )


def reason_histogram(sources: DataFrame) -> DataFrame:
    """Dropped sources by reason, with the place of its first one."""
    return (
        sources.filter("verdict = 'drop'")
        .groupBy("request_id", F.coalesce("reason", F.lit("empty")).alias("reason"))
        .agg(F.count("*").alias("n"), F.min("source_index").alias("first"))
    )


def removed_in_kept(sources: DataFrame, snippets: DataFrame) -> DataFrame:
    alive = sources.filter("verdict = 'keep'").select("request_id", "source_index")
    return snippets.join(alive, ["request_id", "source_index"]).groupBy("request_id").agg(F.count_if(~F.col("kept")).alias("n_removed"))


def unchecked(sources: DataFrame, judged: DataFrame) -> DataFrame:
    """Kept sources without a valid check, and the kinds of failure. judged: status, fail_kind, n_invalid_groups."""
    rows = sources.filter("verdict = 'keep'").select("request_id", "source_index").join(judged, ["request_id", "source_index"], "left")
    bad_groups = F.coalesce(F.col("n_invalid_groups") > 0, F.lit(False))
    bad = F.col("status").isNull() | (F.col("status") != "answered") | F.coalesce(F.col("fail_kind") == "validation", F.lit(False)) | bad_groups
    kind = F.when(F.col("status") == "breaker_open", F.lit("circuit_breaker")).otherwise(F.col("fail_kind"))
    kinds = F.array_compact(F.array(F.when(bad_groups, F.lit("validation")), kind))
    return rows.groupBy("request_id").agg(
        F.count_if(bad).alias("n_unchecked"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(bad, kinds))))).alias("kinds")
    )


def primary_kind(kinds: Column) -> Column:
    """The kind that comes first in the fixed order, else the first of the set."""
    out = F.get(kinds, F.lit(0))
    for name, _, _ in reversed(FAILURES):
        out = F.when(F.array_contains(kinds, name), F.lit(name)).otherwise(out)
    return out


def status(rows: DataFrame) -> DataFrame:
    """breaker_open before degraded before ok, over the sources of each request."""
    return rows.groupBy("request_id").agg(
        F.when(F.bool_or(F.col("status") == "breaker_open"), F.lit("breaker_open"))
        .when(F.bool_or(F.col("status") == "failed"), F.lit("degraded"))
        .otherwise(F.lit("ok"))
        .alias("status")
    )


def accounting(calls: DataFrame) -> DataFrame:
    """Sums over the logical calls of each request: only dispatched ones count; usage is complete if every attempt has
    one. calls: dispatched, input_tokens, latency_ms, attempts, attempts_with_usage, model, answered, seq."""
    sent = F.col("dispatched")
    models = F.array_sort(F.collect_list(F.when(F.col("answered"), F.struct("seq", "model"))))
    return calls.groupBy("request_id").agg(
        F.count_if(sent).alias("n_calls"),
        F.sum(F.when(sent, F.coalesce("input_tokens", F.lit(0)))).alias("input_tokens"),
        F.sum(F.when(sent, F.col("latency_ms"))).alias("latency_ms"),
        F.sum(F.when(sent, F.col("attempts"))).alias("attempts"),
        F.bool_and(F.when(sent, F.col("attempts") == F.col("attempts_with_usage"))).alias("usage_complete"),
        F.array_join(F.array_distinct(F.transform(models, lambda m: m["model"])), ",").alias("models"),
    )


#: Columns of a request that hold text or model output.
BODY = ("state", "questions", "answers", "mapping", "model")


def request_summary(requests: DataFrame) -> DataFrame:
    """Requests for the log: everything but what was sent and what came back."""
    return requests.drop(*BODY)


def distinct_in_order(rows: DataFrame, key: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """`key` and `name`: the different values of each key in the order in which they were first met. Only the first place
    of each value is gathered."""
    first = rows.filter(F.col(value).isNotNull()).groupBy(*key, value).agg(F.min(F.struct(*order)).alias("_first"))
    met = F.array_sort(F.collect_list(F.struct("_first", F.col(value).alias("_value"))))
    return first.groupBy(*key).agg(F.transform(met, lambda x: x["_value"]).alias(name))


def _plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))


def status_line(per_request: DataFrame) -> DataFrame:
    """request_id and status_line (null if there is nothing to say). Needs n_sources, n_dropped, reasons (array of
    struct first, reason, n), n_removed, n_unchecked, kinds and codes (map from kind to an HTTP status)."""
    reasons = F.array_join(
        F.transform(F.array_sort("reasons"), lambda r: F.concat_ws(" ", r["n"].cast("string"), r["reason"])), ", "
    )
    dropped = F.concat(
        F.lit("dropped "), F.col("n_dropped").cast("string"), F.lit(" of "), _plural(F.col("n_sources"), "source"), F.lit(": "), reasons
    )
    kind = primary_kind(F.col("kinds"))
    words, code = F.lit("upstream error"), F.lit(500)
    for name, said, number in FAILURES:
        words, code = F.when(kind == name, F.lit(said)).otherwise(words), F.when(kind == name, F.lit(number)).otherwise(code)
    words = F.when(F.size("kinds") == 0, F.lit("check incomplete")).otherwise(words)
    code = F.coalesce(F.try_element_at("codes", kind), code)
    error = F.concat(
        F.lit("[error] ["), _plural(F.col("n_unchecked"), "source"), F.lit(" unchecked: filter "), words,
        F.lit(", raw sources kept] ["), code.cast("string"), F.lit("]"),
    )
    parts = F.array_compact(
        F.array(
            F.when(F.col("n_dropped") > 0, dropped),
            F.when(F.col("n_removed") > 0, F.concat(_plural(F.col("n_removed"), "snippet"), F.lit(" removed"))),
            F.when(F.col("n_unchecked") > 0, error),
        )
    )
    return per_request.select(
        "request_id", F.when(F.size(parts) > 0, F.concat(F.lit("[filter] "), F.array_join(parts, "; "))).alias("status_line")
    )
