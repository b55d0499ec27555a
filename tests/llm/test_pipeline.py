"""The pipeline's stages, each against its brute-force rule on what the one before it kept."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from chaffsieve.llm import boosted_rules, decontam
from tests.conftest import SMALL
from tests.llm.test_operators import brute_groups, brute_hits, brute_lines


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = {r.doc_id: r.text for r in docs.collect()}, spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in docs.collect())
        seen[name] = (before, {r.doc_id: r["text"] if "text" in docs.columns else r for r in docs.collect()})
    before, after = seen["quality_rules"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    verdicts = {r.doc_id: r for r in boosted_rules.judged(spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    assert set(after) == {i for i, r in verdicts.items() if r.kept}
    assert all(i in after for i, q in labels.items() if q and not verdicts[i].base_failed)
    before, after = seen["line_dedup"]
    gone = brute_lines(list(before.items()))
    rest = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in before.items()}
    assert after == {i: t for i, t in rest.items() if i not in gone or t.strip()}
    before, after = seen["near_dedup"]
    assert set(after) == {i for i, (_, c) in brute_groups(list(before.items()), 5).items() if i == c}
    before, after = seen["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for i, t in before.items():
        n, hit, _ = brute_hits(t, items, decontam.WINDOW)
        assert (i in after) == (hit < decontam.DROP_SHARE * n or not hit)
        assert i not in after or brute_hits(after[i], items, decontam.WINDOW)[1] == 0
        assert hit or after[i] == t
    before, after = seen["bpe"]
    assert set(after) == set(before)


def test_last_stage_decodes(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.createDataFrame([(1, "Two words, twice."), (2, "é x\ny")], "doc_id long, text string")
    want = {r.doc_id: library.decode(library.encode(r.text).ids, skip_special_tokens=False) for r in docs.collect()}
    assert {r.doc_id: r.decoded for r in corpus_pipeline.encode(spark, docs, SMALL).collect()} == want


def test_run_equals_the_stages(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 100


def test_stages_on_odd_rows(spark):
    """Null and empty texts, null and repeated ids, columns that clash, and no rows at all."""
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    plain = " ".join(words[:60]) + "."
    rows = [(1, plain), (1, plain), (2, plain), (3, None), (4, ""), (None, plain), (None, None), (5, " ".join(words[50:])), (6, "a\nb\nc\nd"), (7, "a\nb\nc\ne")]
    docs = spark.createDataFrame([(i, t, "x", "x", None if t is None else len(t), "x", 1) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, kept string, removed int")
    stages = dict(corpus_pipeline.STAGES)

    def after(name, df=docs):
        out = stages[name](spark, df, SMALL)
        assert name == "bpe" or out.columns == df.columns
        return sorted(((r.doc_id, r.decoded if name == "bpe" else r.text) for r in out.collect()), key=str)

    every = sorted(rows, key=str)
    assert all(t for _, t in after("quality_rules"))
    assert after("line_dedup") == sorted([(7, "e") if r == rows[-1] else r for r in rows], key=str)
    assert after("near_dedup") == sorted([r for r in rows if r[0] != 2], key=str)
    assert after("decontamination") == every
    assert len(after("bpe")) == len(rows) and {t for i, t in after("bpe") if i in (3, 4)} == {""}
    for name in stages:
        assert after(name, docs.limit(0)) == []
