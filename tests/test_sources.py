"""Sources and sinks that talk to servers and files."""

from __future__ import annotations

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from chaffsieve.sources import remote, samples


class _Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        asked = {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
        status = int(asked.get("status", 200))
        body = "busy" if status == 503 else json.dumps({"q": asked.get("q"), "key": self.headers.get("X-Subscription-Token")})
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body.encode())

    def log_message(self, *args):
        pass


@pytest.fixture(scope="module")
def base():
    server = ThreadingHTTPServer(("127.0.0.1", 0), _Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/res/v1/local/place_search"
    server.shutdown()


def found(spark, base, queries, **options):
    spark.dataSource.register(remote.SearchSource)
    reader = spark.read.format("search_json").option("base", base).option("queries", json.dumps(queries))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def test_search_source_reads_and_reports(spark, base):
    queries = [f"q=a%20{i}" for i in range(40)] + ["status=404&q=x", "status=503"]
    rows = {r.request: r for r in found(spark, base, queries, key="secret", block="16").collect()}
    assert len(rows) == len(queries) and json.loads(rows["q=a%207"].body) == {"q": "a 7", "key": "secret"}
    assert rows["q=a%207"].error is None and rows["q=a%207"].status == 200
    assert rows["status=404&q=x"].error == '404 Not Found\n{\n  "q": "x",\n  "key": "secret"\n}'
    assert rows["status=503"].error == "503 Service Unavailable\nbusy"
    assert found(spark, base, []).count() == 0


def test_place_search_passes_through(spark, base):
    rows = {r.request: r for r in remote.passed_through(found(spark, base, ["q=x", "status=503"])).collect()}
    assert rows["q=x"].text == rows["q=x"].structured == '{"q": "x", "key": null}' and not rows["q=x"].is_error
    assert rows["status=503"].is_error and rows["status=503"].structured is None and rows["status=503"].text.startswith("503")


def test_gate_lets_twelve_calls_through_at_a_time():
    lock, now, most, order = threading.Lock(), [0], [0], []

    def post(body):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            order.append(int(body))
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        return 200, "{}"

    client = remote.Client(post)
    threads = [threading.Thread(target=client.classify, args=(str(i),)) for i in range(40)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert most[0] == remote.CONCURRENCY and sorted(order) == list(range(40))


def test_a_call_that_waited_asks_the_breaker_again():
    """What waits at the gate while the breaker opens is not sent."""
    release, sent = threading.Event(), []

    def post(body):
        sent.append(body)
        release.wait(5)
        return 500, ""

    client = remote.Client(post, sleep=lambda s: None)
    out = [None] * 20

    def call(i):
        out[i] = client.classify(str(i))

    threads = [threading.Thread(target=call, args=(i,)) for i in range(20)]
    for t in threads:
        t.start()
    while len(sent) < remote.CONCURRENCY:
        time.sleep(0.005)
    release.set()
    for t in threads:
        t.join()
    kinds = [o["kind"] for o in out]
    assert kinds.count("breaker_open") >= 20 - remote.CONCURRENCY - 3
    assert all(not o["dispatched"] and not o["attempts"] for o in out if o["kind"] == "breaker_open")


def test_calls_of_a_partition_run_together(spark):
    def make():
        def post(body):
            time.sleep(0.3)
            return 200, body

        return remote.Client(post)

    states = spark.range(24).select(F.col("id").alias("request_id"), F.col("id").cast("string").alias("state")).coalesce(1)
    remote.classified(states.limit(1), make).collect()  # starts the worker
    began = time.time()
    got = {r.request_id: (r.kind, r.body) for r in remote.classified(states, make).collect()}
    assert got == {i: ("ok", str(i)) for i in range(24)} and time.time() - began < 24 * 0.3 / 2


def test_poll():
    answers = iter([OSError(), {"status": "pending"}, OSError(), {"status": "complete", "x": 1}])
    pauses = []

    def ask():
        a = next(answers)
        if isinstance(a, OSError):
            raise a
        return a

    assert remote.poll(ask, pause=lambda: pauses.append(1))["x"] == 1 and len(pauses) == 2
    asked = []
    assert remote.poll(lambda: asked.append(1) or {"status": "pending"}) is None and len(asked) == 20


def test_samples_are_json_documents(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "q", None), ("r2", "q", "boom")], "request_id string, query string, error string")
    audits = spark.createDataFrame([("r1", "s0", "0", "keep", 0.35, None)], "request_id string, src string, snippet_key string, verdict string, threshold double, invalid_reason string")
    samples.save(samples.records(rows, audits), f"{tmp_path}/", "2024-05-01")
    parts = sorted(p.name for p in (tmp_path / "samples" / "2024-05-01").iterdir() if p.name.startswith("sample="))
    assert parts == sorted("sample=" + __import__("hashlib").sha256(i.encode()).hexdigest()[:8] for i in ("r1", "r2"))
    got = {r.request_id: r for r in spark.read.json(f"{tmp_path}/samples/2024-05-01").collect()}
    assert got["r1"].outcome == "ok" and [s.verdict for s in got["r1"].snippets] == ["keep"]
    assert got["r2"].outcome == "error" and got["r2"].missing and got["r2"].snippets is None
