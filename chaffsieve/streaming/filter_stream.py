"""The stateless part of the filter over a stream of responses, and the breaker as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chaffsieve.operators import local_rules, work_table
from chaffsieve.sources.remote import BREAK_AFTER, BREAK_S

BREAKER_OUT = "endpoint string, seq long, failures int, is_open boolean"
BREAKER_STATE = "failures int, open_until double"


def filtered(responses: DataFrame, platforms: bool = True) -> DataFrame:
    """Snippet rows after the local rules. Each source is decided from its own row, so a stream needs no state."""
    return local_rules.applied(work_table.response_sources(responses), platforms)


def hourly(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """Calls, failures and latency by endpoint and hour of `ts`, closed once the watermark has passed."""
    return (
        calls.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 hour"), "endpoint")
        .agg(F.count("*").alias("n_calls"), F.count_if(F.col("failed")).alias("n_failed"), F.sum("latency_ms").alias("latency_ms"))
        .select(F.col("window.start").alias("hour"), "endpoint", "n_calls", "n_failed", "latency_ms")
    )


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    failures, until = state.get if state.exists else (0, 0.0)
    rows = pd.concat(list(frames)).sort_values(["at", "seq"])
    out = []
    for at, seq, failed in zip(rows["at"], rows["seq"], rows["failed"], strict=True):
        is_open = at < until
        if not is_open:
            failures = failures + 1 if failed else 0
            if failures >= BREAK_AFTER:
                failures, until = 0, at + BREAK_S
        out.append((key[0], int(seq), failures, is_open))
    state.update((failures, until))
    yield pd.DataFrame(out, columns=["endpoint", "seq", "failures", "is_open"])


def breakers(calls: DataFrame) -> DataFrame:
    """For each call (endpoint, seq, at in seconds, failed) whether the endpoint's breaker was open when it came."""
    return calls.groupBy("endpoint").applyInPandasWithState(
        _step, BREAKER_OUT, BREAKER_STATE, "append", GroupStateTimeout.NoTimeout
    )
