"""The registered queries that SQL does not cover, on the whole small tables, against plain Python."""

from __future__ import annotations

import hashlib
import struct
import zlib

import pytest
from tokenizers import Tokenizer

from chaffsieve.llm import boosted_rules, license_scan, queries
from tests.conftest import SMALL
from tests.llm.test_operators import brute_counts, brute_license, brute_random, brute_secrets


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, documents):
    library = Tokenizer.from_file(queries._tokenizer())
    library.no_truncation()
    library.no_padding()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_bpe(spark, SMALL).collect()}
    want = {}
    for i, t in documents.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        want[i] = (len(ids), hashlib.sha256(packed).hexdigest(), sha(library.decode(ids, skip_special_tokens=False)))
    assert got == want


def test_op3(spark, documents):
    rows = {r.doc_id: r for r in queries.op3_quality_qda(spark, SMALL).collect()}
    assert set(rows) == set(documents)
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op3_on_held_out_rows(spark):
    """Of a table large enough for a fit; a fifth of the labelled rows is held out."""
    folder = SMALL.replace("sf0.001", "sf0.01")
    known = spark.read.parquet(f"{folder}/labels.parquet").filter("quality is not null").select("doc_id", "quality")
    held = queries.op3_quality_qda(spark, folder).filter("held_out").join(known, "doc_id").collect()
    assert len(held) > 50 and sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)


def test_op7(spark, documents):
    got = {r.doc_id: r for r in queries.op7_secret_scan(spark, SMALL).collect()}
    random = brute_random(list(documents.values()))
    assert set(got) == set(documents)
    for k, (i, t) in enumerate(documents.items()):
        base = brute_secrets(t)
        r = got[i]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == kind for s in base) for kind in ("assign", "access", "hex")]
        assert r.base_sha256 == sha(",".join(f"{kind}:{a}:{b}" for kind, a, b in base))
        order = {"assign": 0, "access": 1, "hex": 2, "random": 3}
        every = sorted([*base, *(("random", a, b) for a, b in random.get(k, ()))], key=lambda s: (s[1], order[s[0]]))
        assert r.spans == ",".join(f"{kind}:{a}:{b}" for kind, a, b in every)


def test_op8(spark, documents, labels):
    rows = {r.doc_id: r for r in queries.op8_quality_rules(spark, SMALL).collect()}
    assert set(rows) == set(documents)
    for i, t in documents.items():
        n, chars, symbols, lines, repeats = brute_counts(t)
        r = rows[i]
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words] == [n, chars, symbols, lines, repeats]
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n)
        assert r.kept == (not r.base_failed and r.score >= boosted_rules.REJECT_BELOW)
    good = [i for i in labels if i in rows and labels[i] == 1 and not rows[i].base_failed]
    assert good and all(rows[i].kept for i in good)


def test_op8_scores_are_those_of_a_walk_through_each_tree(spark, documents):
    """The flat arrays against a walk from node to node, a document at a time."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    forest = boosted_rules.fitted(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    import math

    from chaffsieve.llm.stats import measured

    bodies = [(t or "").encode() for t in documents.values()]
    _, features = measured(bodies)
    for x, score in zip(features, forest.score(features), strict=True):
        total = forest.base
        for node in forest.roots:
            while forest.left[node] != node:
                node = forest.left[node] if x[forest.feature[node]] <= forest.cut[node] else forest.right[node]
            total += forest.value[node]
        assert math.isclose(score, 1 / (1 + math.exp(-total)), rel_tol=1e-9)


def test_op9(spark, documents):
    got = {r.doc_id: r for r in queries.op9_license_scan(spark, SMALL).collect()}
    assert set(got) == set(documents)
    for i, t in documents.items():
        n, n_base, first, last, base, spans = brute_license(t, license_scan.TEMPLATES)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, n_base, first, last, ",".join(base))
        assert r.labels == ",".join(sorted({*base, *(label for _, label, _ in spans)})) and 0 <= r.score <= 1
        assert bool(r.score) == bool(base or spans)
