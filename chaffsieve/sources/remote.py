"""The search API as a batch data source, one partition a block of requests, and the classifier as an Arrow stage.

spark.dataSource.register(SearchSource)
spark.read.format("search_json").option("base", ...).option("queries", json list of query strings).load()
"""

from __future__ import annotations

import json
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Attempts, back-off, breaker and gate of the classifier.
ATTEMPTS, BASE_S, CAP_S = 3, 0.5, 5.0
BREAK_AFTER, BREAK_S = 3, 60.0
CONCURRENCY, TIMEOUT_S = 12, 15.0


def fetch(url: str, headers: dict[str, str] | None = None, body: bytes | None = None, timeout: float = TIMEOUT_S) -> tuple[int, str, str]:
    """Status, its text and the body; a status that is no success is returned, not raised."""
    request = urllib.request.Request(url, data=body, headers={"Accept": "application/json", **(headers or {})})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as r:
            return r.status, r.reason, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.reason, e.read().decode(errors="replace")


def error_text(status: int, reason: str, body: str) -> str | None:
    """Status, its text and the body (JSON indented) of what is no success; null for success."""
    if 200 <= status < 300:
        return None
    try:
        body = json.dumps(json.loads(body), indent=2, ensure_ascii=False)
    except ValueError:
        pass
    return f"{status} {reason}\n{body}"


class SearchSource(DataSource):
    """Rows of request (its query string), status, body and error (null for success). A request that gets no answer fails
    its task, which Spark repeats."""

    @classmethod
    def name(cls) -> str:
        return "search_json"

    def schema(self) -> str:
        return "request string, status int, body string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


@dataclass
class _Block(InputPartition):
    queries: list[str] = field(default_factory=list)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.base, self.key = options["base"], options.get("key", "")
        self.queries = json.loads(options.get("queries", "[]"))
        self.block = int(options.get("block", "16"))

    def partitions(self) -> list[_Block]:
        step = self.block
        return [_Block(self.queries[i : i + step]) for i in range(0, len(self.queries), step)] or [_Block([])]

    def read(self, partition: _Block) -> Iterator[tuple]:
        for q in partition.queries:
            status, reason, body = fetch(f"{self.base}?{q}", {"X-Subscription-Token": self.key} if self.key else None)
            yield q, status, body, error_text(status, reason, body)


def passed_through(found: DataFrame) -> DataFrame:
    """request, text, is_error and structured for rows of a search source: the response as it is (place search)."""
    failed = F.col("error").isNotNull()
    return found.select(
        "request", F.when(failed, F.col("error")).otherwise(F.col("body")).alias("text"), failed.alias("is_error"), F.when(~failed, F.col("body")).alias("structured")
    )


@dataclass
class Breaker:
    """Opens for BREAK_S after BREAK_AFTER transient failures in a row; a success closes it."""

    now: Callable[[], float] = time.monotonic
    failures: int = 0
    open_until: float = 0.0
    lock: threading.Lock = field(default_factory=threading.Lock)

    def is_open(self) -> bool:
        return self.now() < self.open_until

    def note(self, transient_failure: bool) -> None:
        with self.lock:
            self.failures = self.failures + 1 if transient_failure else 0
            if self.failures >= BREAK_AFTER:
                self.open_until, self.failures = self.now() + BREAK_S, 0


class Client:
    """One classifier per worker: a gate, retries with back-off, and a breaker that is asked again after the gate."""

    def __init__(self, post: Callable[[str], tuple[int, str]], sleep: Callable[[float], None] = time.sleep, now: Callable[[], float] = time.monotonic, random: Callable[[], float] = lambda: 0.0):
        self.post, self.sleep, self.random = post, sleep, random
        self.breaker, self.gate = Breaker(now), threading.BoundedSemaphore(CONCURRENCY)

    def classify(self, body: str) -> dict:
        """kind (ok or a failure), status, body, attempts and dispatched."""
        out = {"kind": "breaker_open", "status": None, "body": None, "attempts": 0, "dispatched": False}
        if self.breaker.is_open():
            return out
        with self.gate:
            if self.breaker.is_open():
                return out
            while out["attempts"] < ATTEMPTS:
                out["attempts"] += 1
                out["dispatched"] = True
                try:
                    status, text = self.post(body)
                except TimeoutError:
                    out |= {"kind": "timeout", "status": None}
                    self.breaker.note(True)
                    return out
                except OSError:
                    status, text = 0, None
                out |= {"status": status or None, "body": text}
                if status == 200:
                    self.breaker.note(False)
                    return out | {"kind": "ok"}
                again = status in (0, 408, 529) or status >= 500
                out["kind"] = "network" if not status else "auth" if status in (401, 403) else "rate_limited" if status == 429 else "http"
                if not again or self.breaker.is_open():
                    break
                if out["attempts"] < ATTEMPTS:
                    self.sleep(min(BASE_S * 2 ** (out["attempts"] - 1), CAP_S) * (1 - 0.25 * self.random()))
            self.breaker.note(out["kind"] in ("network", "http", "rate_limited") and (out["status"] or 0) not in (400, 404, 422))
            return out


def classified(states: DataFrame, make_client: Callable[[], Client]) -> DataFrame:
    """request_id, kind, status, body, attempts and dispatched for rows of request_id and state, a call each.

    A worker has CONCURRENCY calls under way at most; the next waiting state, in the order of the rows, takes the place of
    one that has ended."""
    kind = dict(states.dtypes)["request_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for frame in frames:
            with ThreadPoolExecutor(CONCURRENCY) as pool:
                calls = list(pool.map(client.classify, frame["state"]))
            got = pd.DataFrame(calls, columns=["kind", "status", "body", "attempts", "dispatched"])
            got.insert(0, "request_id", frame["request_id"].to_numpy())
            got["status"] = got["status"].astype("Int32")
            yield got

    return states.select("request_id", "state").mapInPandas(
        run, f"request_id {kind}, kind string, status int, body string, attempts int, dispatched boolean"
    )


def poll(ask: Callable[[], dict], attempts: int = 20, pause: Callable[[], None] = lambda: time.sleep(0.05)) -> dict | None:
    """Asks until the status is complete; pauses after an error only."""
    for _ in range(attempts):
        try:
            got = ask()
        except OSError:
            pause()
            continue
        if got.get("status") == "complete":
            return got
    return None
