"""The whole filter, decisions, sources, sinks and streaming on small inputs."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chaffsieve.functions import decisions as D
from chaffsieve.functions import lines as L
from chaffsieve.functions import text as T
from chaffsieve.operators import coverage, filter as whole, local_rules, rollups, verdicts, work_table
from chaffsieve.sources import config, logs, remote, responses

TITLE = "A title that is long"


def response(snippets, request="r", url="https://a.b/c"):
    return {"request_id": request, "grounding": {"generic": [{"url": url, "title": TITLE, "snippets": snippets}]}, "sources": {url: {"title": "x", "age": ["old", "2024-01-02"], "odd": 1}}}


def sources(spark, tmp_path, *rows):
    path = tmp_path / "in.json"
    path.write_text("\n".join(json.dumps(r) if isinstance(r, dict) else r for r in rows))
    good, bad = responses.read_responses(spark, str(path))
    return work_table.response_sources(good), bad


def test_responses_are_split(spark, tmp_path):
    got, bad = sources(spark, tmp_path, response(["a", None]), "{broken", {"request_id": "q", "grounding": {}}, response(["x"], "u", "https://u.v/"))
    assert got.count() == 2
    assert {r.reason for r in bad.collect()} == {"not json", "no items"}
    meta = got.filter("request_id = 'r'").select(work_table.trimmed_meta(F.col("meta")).alias("m")).first().m
    assert meta.age == ["2024-01-02"] and meta.hostname is None


def test_modes(spark, tmp_path):
    got, _ = sources(spark, tmp_path, response(["Show more", "", "real text"], url="https://x.com/u/status/1"))
    off = {(r["index"], r.kept, r.reason) for r in whole.run(got, "off").snippets.collect()}
    assert off == {(0, True, None), (1, False, "nav"), (2, True, None)}
    on = {(r["index"], r.kept, r.reason) for r in whole.run(got, "on").snippets.collect()}
    assert on == {(0, False, "boilerplate"), (1, False, "nav"), (2, True, None)}


def test_verdicts_reach_the_output(spark, tmp_path):
    long = "one two three four five six seven eight nine ten"
    got, _ = sources(spark, tmp_path, response([long + " eleven.", long, "other words that are kept here, and more of them"]), response(["x y"], "r2"))
    labels = ["none", "A", "B", "AB", "C", "AC", "BC", "ABC"]
    rows = [
        ("r", "s0__filler", "noul", 0.1, None),
        ("r", "s0__group0", "choice", None, {k: 1.0 if k == "ABC" else 0.0 for k in labels}),
        ("r2", "s0__filler", "noul", 0.76, None),
    ]
    out = whole.run(got, "on", spark.createDataFrame(rows, responses.ANSWERS))
    snippets = {(r.request_id, r["index"]): (r.kept, r.reason, r.covered_by) for r in out.snippets.collect()}
    assert snippets["r", 1] == (False, "dup", 0) and snippets["r", 0][0] and snippets["r", 2][0]
    verdicts = {r.request_id: (r.verdict, r.reason) for r in out.sources.collect()}
    assert verdicts == {"r": ("keep", None), "r2": ("drop", "filler")}
    final = {r.request_id: r.generic for r in work_table.rebuilt(out.sources, out.snippets).collect()}
    assert [len(i.snippets) for i in final["r"]] == [2] and "r2" not in final


def test_plain_path_equals_line_pass(spark):
    texts = ["a\r\nb", "Share", "## share me\nx", "T\nT", f"{TITLE}\nbody\n# {TITLE}", "  pad  ", "no marks", "x\nShares up\ny", "On this page", f"{TITLE} more\n{TITLE}"]
    rows = [(i, 0, "https://a.b", TITLE, [t]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "request_id int, source_index long, url string, title string, snippets array<string>")
    got = {r.request_id: (r.kept, r.text if r.kept else None) for r in local_rules.applied(df).collect()}
    for i, t in enumerate(texts):
        want = L.local_rules("https://a.b", TITLE, [t], True)[0]
        assert got[i] == (want.kept, want.text if want.kept else None)


def test_final_cleanup_leaves_out_only_real_code(spark):
    long = "one two three four five six seven eight nine ten"
    texts = [f"{long}\tand more", long, f"{long} x    y", f"{long} ~~~ z", f"`a` {long}", f"    {long}", f"\t{long}", f"~~~\n{long}\n~~~",
             f"# {TITLE}\nKey    takeaways", f"# {TITLE}  \t\nKey takeaways"]
    rows = [("r", 0, i, t, TITLE, True, None) for i, t in enumerate([*texts, long + " x y"])]
    df = spark.createDataFrame(rows, "request_id string, source_index int, position int, text string, title string, kept boolean, reason string")
    out = verdicts.final_cleanup(df, df.select("request_id", "source_index").distinct())
    got = {r.position: (r.reason, r.covered_by) for r in out.filter("not kept").collect()}
    assert got == {1: ("dup", 0), 9: ("boilerplate", None), 10: ("dup", 2)}
    assert out.count() == len(rows)


@pytest.mark.parametrize("many", [coverage.MANY, 10])
def test_coverage_by_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(coverage, "MANY", many)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    import random

    random.seed(5)
    texts = [" ".join(random.choices(words, k=random.randint(7, 14))) for _ in range(60)]
    texts += [texts[0] + "s", texts[0] + "é " + texts[0], "(" + texts[4] + ")", texts[4] + "_", "x\\E " + texts[5], texts[5], "-" * 50, "-" * 60, texts[1] + " " + texts[2], texts[3]]
    df = spark.createDataFrame([(1, i % 2, i, t) for i, t in enumerate(texts)], "request_id int, source_index int, position int, text string")
    got = {r.position: r.covered_by for r in coverage.covered(df).collect()}
    import re

    for i, t in enumerate(texts):
        outer = [j for j, o in enumerate(texts) if j % 2 == i % 2 and len(t) >= 40 and (len(o), -j) > (len(t), -i) and re.search(rf"(?<!\w){re.escape(t)}(?!\w)", o)]
        best = min(outer, key=lambda j: (-len(texts[j]), j), default=None)
        assert got.get(i) == best, (t, got.get(i), best)


@settings(max_examples=200, deadline=None)
@given(st.floats(0, 1), st.sampled_from([0.0, 0.25, 0.35, 0.77, 1.0]))
def test_decision_rules(p, t):
    """The same rules in plain floats; columns are held against SQL elsewhere."""
    near = 0 < t < 1 and t - p <= D.NEAR_GAP + D.SLACK
    assert (p >= t or near) == (p >= t or (0 < t < 1 and t - p <= 0.02 + 8 * 2**-52))


def test_decisions_at_the_edges(spark):
    rows = [(0.75, 0.77), (0.7499, 0.77), (0.77, 0.77), (1.0, 1.0), (0.99, 1.0), (0.0, 0.0)]
    df = spark.createDataFrame(rows, "p double, t double")
    got = df.select(D.page_drops(F.col("p"), F.col("t")).alias("d"), D.page_gap(F.col("p"), F.col("t")).alias("g"), D.snippet_drops(F.col("p"), F.col("t")).alias("s")).collect()
    assert [r.d for r in got] == [True, False, True, True, False, True]
    assert got[0].g == 0.02 and got[2].g is None
    assert [r.s for r in got] == [True, True, True, False, True, False]


def test_blanks_are_all_blanks(spark):
    import random

    rng = random.Random(4)
    signs = [*T.WS_CHARS, "a", "b", "é", "😀", "\x1c", "\x85", "\u200b", "\u180e"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 12))) for _ in range(400)] + [*T.WS_CHARS, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    t = F.col("t")
    for r in df.select("i", T.trimmed(t).alias("a"), T.collapsed(t).alias("b"), T.is_blank(t).alias("c"), T.normalized_title(t).alias("d")).collect():
        own = texts[r.i]
        assert (r.a, r.b, r.c, r.d) == (L.trim(own), L._BLANKS.sub(" ", own), not L.trim(own), L.title_key(own))


def test_labels_and_units(spark):
    df = spark.createDataFrame([(1, "a😀"), (2, "é"), (3, "")], "n int, s string")
    got = df.select(D.option_labels(F.col("n")).alias("l"), T.utf16_length(F.col("s")).alias("u")).collect()
    assert got[2].l == ["none", "A", "B", "AB", "C", "AC", "BC", "ABC"] and got[0].l == ["none", "A"] and [r.u for r in got] == [3, 1, 0]


def test_status_line_reports_failures(spark):
    df = spark.createDataFrame(
        [("r", 3, 1, [(0, "filler", 1)], 2, 1, ["timeout", "http"], {"timeout": 599})],
        "request_id string, n_sources long, n_dropped long, reasons array<struct<first:long,reason:string,n:long>>, n_removed long, n_unchecked long, kinds array<string>, codes map<string,int>",
    )
    line = rollups.status_line(df).first().status_line
    assert line == "[filter] dropped 1 of 3 sources: 1 filler; 2 snippets removed; [error] [1 source unchecked: filter timeout, raw sources kept] [599]"


def test_client_retries_and_breaker():
    clock, calls = [0.0], []

    def post(body):
        calls.append(body)
        return (500, "") if len(calls) <= 9 else (200, "{}")

    client = remote.Client(post, sleep=lambda s: None, now=lambda: clock[0])
    assert [client.classify("x")["kind"] for _ in range(3)] == ["http"] * 3 and len(calls) == 9
    assert client.classify("x")["kind"] == "breaker_open"
    clock[0] = 61.0
    assert client.classify("x") == {"kind": "ok", "status": 200, "body": "{}", "attempts": 1, "dispatched": True}
    assert remote.Client(lambda b: (429, "")).classify("x")["attempts"] == 1


def test_replies_become_answers(spark):
    body = json.dumps({"model": "m", "answers": {"a": {"type": "noul", "probability": 0.5}, "b": {"type": "noul", "probability": "x"}, "c": {"type": "choice", "probabilities": {"A": 0.25, "none": 0.75}}}})
    df = spark.createDataFrame([("r", 200, body), ("q", 500, ""), ("s", 200, "[]")], "request_id string, status int, body string")
    replies = responses.parse_reply(df)
    assert {r.request_id: r.kind for r in replies.collect()} == {"r": "ok", "q": "http", "s": "shape"}
    got = {r.global_key: (r.noul, r.probabilities) for r in responses.answer_rows(replies).collect()}
    assert got == {"a": (0.5, None), "c": (None, {"A": 0.25, "none": 0.75})}


def test_config(tmp_path):
    said = []
    c = config.parsed({"mode": " TEST ", "page_drop": 2, "timeout_ms": 1.5, "concurrency": 3, "other": 1}, said.append)
    assert (c.mode, c.page_drop, c.timeout_ms, c.concurrency) == ("test", 0.77, 15000, 3) and len(said) == 2
    assert config.load(str(tmp_path / "none.json"), said.append).mode == "on"
    (tmp_path / "d.txt").write_text("x" * 9000)
    assert config.description("f", str(tmp_path / "d.txt"), said.append) == "f"


def test_logs_append_by_day(spark, tmp_path):
    df = spark.sql("SELECT 'r' AS request_id, timestamp'2024-05-01 23:59:59.5' AS ts")
    for _ in range(2):
        logs.append(df, str(tmp_path / "log"))
    got = spark.read.json(str(tmp_path / "log")).collect()
    assert len(got) == 2 and str(got[0].date) == "2024-05-01" and got[0].stamp == "2024-05-01T23:59:59.500+00:00"


def test_streams(spark, tmp_path):
    from chaffsieve.streaming import filter_stream as S

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(response(["Share", "text"])))
    stream = spark.readStream.schema(work_table.RESPONSE).json(str(tmp_path / "in"))
    q = S.filtered(stream).writeStream.format("memory").queryName("rows").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["index"], r.kept) for r in spark.sql("SELECT * FROM rows").collect()} == {(0, False), (1, True)}
    calls = pd.DataFrame([("e", i, float(i), True) for i in range(4)] + [("e", 9, 70.0, False)], columns=["endpoint", "seq", "at", "failed"])
    spark.createDataFrame(calls).write.parquet(str(tmp_path / "calls"))
    stream = spark.readStream.schema("endpoint string, seq long, at double, failed boolean").parquet(str(tmp_path / "calls"))
    q = S.breakers(stream).writeStream.outputMode("append").format("memory").queryName("open").start()
    q.processAllAvailable()
    q.stop()
    assert {r.seq: r.is_open for r in spark.sql("SELECT * FROM open").collect()} == {0: False, 1: False, 2: False, 3: True, 9: False}
