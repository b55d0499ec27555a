"""Null and repeated ids, several texts of one id, and empty tables: what each docstring says."""

from __future__ import annotations

from collections import Counter

from tokenizers import Tokenizer

from chaffsieve.llm import boosted_rules, bpe, decontam, near_dup, qda, queries, stats, url_filter
from tests.llm.test_operators import brute_counts, brute_hits, labelled, table

ROWS = [(None, "One two, three."), (None, None), (None, "One two, three."), (7, "One two, three."), (7, "One two, three."), (7, "four"), (8, ""), (8, "x " * 5000)]


def test_bpe_gives_a_row_for_every_row(spark):
    library = Tokenizer.from_file(queries._tokenizer())
    got = Counter((r.doc_id, r.n_tokens, r.decoded) for r in bpe.round_trip(table(spark, ROWS), queries._tokenizer()).collect())
    want = Counter()
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == want


def test_statistics_give_a_row_for_every_row(spark):
    got = Counter((r.doc_id, *(r[c] for c in stats.COUNTS)) for r in stats.document_stats(table(spark, ROWS)).collect())
    assert got == Counter((i, *brute_counts(t)) for i, t in ROWS)


def test_decontamination_gives_a_row_for_every_row(spark):
    items = [(1, "two three"), (1, "two three"), (2, "x x x")]
    rows = decontam.hits(table(spark, ROWS), spark.createDataFrame(items, "item_id long, text string"), window=3)
    got = Counter((r.doc_id, r.n_words, sum(h.end - h.start for h in r.hits), str(r.item_ids)) for r in rows.collect())
    assert got == Counter((i, n, hit, str(ids)) for i, t in ROWS for n, hit, ids in [brute_hits(t, items, 3)])


def test_classifier(spark):
    """Every row has a score; each text of a labelled id counts in the fit, null ids and null labels do not."""
    docs, labels, n = labelled(spark, 60)
    odd = docs.unionByName(table(spark, ROWS)).unionByName(docs.limit(5))
    more = labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 5, 0)], "doc_id long, quality int, toxic int"))
    rows = qda.classified(odd, more).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    one = {r.doc_id: r.score for r in qda.classified(docs, labels.filter("quality = 1")).collect()}
    assert set(one.values()) == {1.0}


def test_quality_rules(spark):
    docs, labels, n = labelled(spark, 60)
    odd = docs.unionByName(table(spark, ROWS))
    rows = boosted_rules.judged(odd, labels.unionByName(spark.createDataFrame([(None, 1, 0)], labels.schema))).collect()
    assert len(rows) == odd.count() and all(r.base_failed and not r.kept for r in rows if r.doc_id is None)
    assert boosted_rules.filtered(odd.limit(0), labels).count() == 0


def test_url_filter_without_pages_and_with_repeats(spark):
    rules = spark.createDataFrame([*queries.URL_RULES, queries.URL_RULES[0]], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/en/x", "y"), (1, "http://a.com/en/x", "y"), (None, None, "y")], "page_id long, url string, host string")
    assert url_filter.judged(pages.limit(0), rules).count() == 0
    got = Counter((r.page_id, r.rule, r.verdict) for r in url_filter.judged(pages, rules).collect())
    assert got == {(1, "com/en/", "block"): 2, (None, None, "allow"): 1}


def test_near_duplicates_leave_null_ids_out(spark):
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(table(spark, ROWS), 2).collect())
    assert got == {(7, 2, 7, True): 2, (7, 1, 7, True): 1, (8, 0, 8, True): 1, (8, 1, 8, True): 1}
