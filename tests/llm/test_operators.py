"""Training-data operators against brute force, on small inputs with nulls, blanks, ties, repeats and odd columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from chaffsieve.llm import (
    boosted_rules, bpe, chat_format, components, decontam, license_scan, line_dedup, near_dup, qda, queries, secret_scan,
    stats, url_filter,
)
from tests.conftest import SMALL, same

#: More columns than the operators know, with names that they use inside.
DOCS = "doc_id long, text string, body string, _id string, _text string, n int, run long, features string, kept string, area int"


def table(spark, texts):
    """doc_id and text, from a list of texts or of (doc_id, text), with clashing columns."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "x", "x", "x", 1, 2, "x", "x", 3) for i, t in rows], DOCS)


ODD = [None, "", "   ", "one", "A b c", "a B c", "\n\n", "word " * 3000, "é" * 40, "x" * 30000]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, duck, name):
    same(queries.QUERIES[name](spark, SMALL), duck.sql(queries.SQL[name]))


def vocabulary(n=300, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n)]


# Near-duplicates ---------------------------------------------------------------------------------------------------


def brute_groups(rows, size):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and find(a) != find(b):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed):
    rng, words = random.Random(seed), vocabulary()
    out = list(ODD)
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([2, 3, 4, 5, 6, 9, 15, 40, 200]))
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy[: len(copy) - rng.randint(0, 1)]))
    return out


@pytest.mark.parametrize("size", [1, 2, 5])
def test_near_duplicates(spark, size):
    texts = near_copies(size)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(table(spark, texts), size).collect()}
    assert got == brute_groups(list(enumerate(texts)), size)


@pytest.mark.parametrize("tile", [512, 5])
def test_short_texts_of_stock_phrases(spark, monkeypatch, tile):
    """Every list of a similar pair may begin with a text that is like neither."""
    monkeypatch.setattr(near_dup, "TILE", tile)
    rng, words = random.Random(7), vocabulary(12, 7)
    phrases = [rng.choices(words, k=3) for _ in range(9)]
    texts = []
    for _ in range(250):
        text = [w for p in rng.choices(phrases, k=rng.choice([1, 2, 2, 3])) for w in p]
        texts.append(" ".join(text[rng.randint(0, 1) :] + rng.choices(words, k=rng.randint(0, 2))))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(table(spark, texts), 2).collect()}
    assert got == brute_groups(list(enumerate(texts)), 2)


@pytest.mark.parametrize("words", [5, 6, 8])
def test_small_vocabularies_lose_no_link(spark, words):
    """Recall 1.0 where every list has many members that are like some and unlike others."""
    rng = random.Random(words)
    texts = [" ".join(rng.choices("abcdefgh"[:words], k=rng.choice([3, 5, 8, 8, 12, 20, 40]))) for _ in range(600)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(table(spark, texts), 2).collect()}
    assert got == brute_groups(list(enumerate(texts)), 2)


def test_documents_of_several_texts(spark):
    rows = [(3, "a b c"), (3, "d e f"), (8, "d e f"), (9, "a b c"), (9, "x y z"), (9, ""), (20, "x y z"), (21, "p q"), (21, "p q")]
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(table(spark, rows), 2).collect())
    assert got == [(3, 2, 3, True), (3, 2, 3, True), (8, 2, 3, False), (9, 0, 9, True), (9, 2, 3, False), (9, 2, 3, False),
                   (20, 2, 3, False), (21, 1, 21, True), (21, 1, 21, True)]


def test_large_group_is_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 7)
    rng, words = random.Random(3), vocabulary()
    base = rng.choices(words, k=60)
    texts = [" ".join(w if rng.random() > 0.04 else rng.choice(words) for w in base) for _ in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(table(spark, texts), 2).collect()}
    assert got == brute_groups(list(enumerate(texts)), 2)


def test_no_documents_and_repeated_rows(spark):
    assert near_dup.near_duplicates(table(spark, []).limit(0)).count() == 0
    got = near_dup.near_duplicates(table(spark, [(3, "a b c"), (3, "a b c"), (5, "a b c"), (None, "a b c")]), 2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(3, 3, True), (3, 3, True), (5, 3, False)]


def test_components_of_a_long_path(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    edges = edges.unionByName(spark.createDataFrame([(100, 101), (101, 100), (7, 7)], "a long, b long"))
    got = {r.id: r.component for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


# Decontamination ---------------------------------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_hits(text, items, window):
    w = WORD.findall((text or "").translate(LOWER))
    hit, ids = set(), set()
    for item, t in items:
        v = WORD.findall((t or "").translate(LOWER))
        size = min(window, len(v))
        grams = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if size else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                ids.add(item)
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("block", [1 << 24, 600])
def test_hits(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    rng, words = random.Random(4), vocabulary(12)
    items = [(i, " ".join(rng.choices(words, k=k))) for i, k in enumerate([4, 5, 9, 2, 30, 4])] + [(99, None), (98, "!!"), (3, "zz zz")]
    texts = ODD + [", ".join(rng.choices(words, k=60)).title() for _ in range(30)] + [items[4][1].upper()]
    rows = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    got = decontam.hits(table(spark, texts), rows, window=4)
    seen = {r.doc_id: (r.n_words, sum(h.end - h.start for h in r.hits), r.item_ids) for r in got.collect()}
    assert seen == {i: brute_hits(t, items, 4) for i, t in enumerate(texts)}


def test_spans_are_cut_and_whole_documents_go(spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps")], "item_id long, text string")
    texts = ["a b c d e f g h The quick, brown FOX jumps. i j k", "the quick brown fox jumps", "clean text", None,
             "a b c d e f g the quick brown the quick brown fox jumps fox jumps h i j k l m n o p"]
    docs = table(spark, texts)
    out = decontam.decontaminated(docs, items, window=5)
    assert out.columns == docs.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[0] == "a b c d e f g h . i j k" and 1 not in got and got[2] == "clean text" and got[3] is None
    assert decontam.hits(out, items, window=5).filter("size(hits) > 0").count() == 0
    empty = items.limit(0)
    assert decontam.decontaminated(docs, empty).count() == len(texts)
    assert decontam.hits(docs.limit(0), items).count() == decontam.decontaminated(docs.limit(0), items).count() == 0
    assert decontam.hits(docs, spark.createDataFrame([(None, "a b"), (1, None), (2, "..")], "item_id long, text string")).filter("size(hits) > 0").count() == 0


def test_equal_hashes_are_told_apart_by_words(monkeypatch):
    monkeypatch.setattr(decontam, "rolling", lambda hashes, size: np.zeros(max(0, len(hashes) - size + 1), np.uint64))
    index = decontam.Index([(1, b"a b c d"), (2, b"x y"), (3, b"b c d e"), (4, b"!")], 3)
    docs = [b"a b c d e", b"c d", b"x y x", b"", b"q b c d"]
    want = [brute_hits(d.decode(), [(1, "a b c d"), (2, "x y"), (3, "b c d e")], 3) for d in docs]
    assert [(sum(e - s for s, e in runs), ids) for runs, ids in index.scan([decontam.words(d) for d in docs])] == [w[1:] for w in want]


def test_results_do_not_depend_on_blocks(spark, monkeypatch):
    rng, words = random.Random(9), vocabulary(14)
    items = [(i, " ".join(rng.choices(words, k=5))) for i in range(25)]
    rows = spark.createDataFrame(items, "item_id long, text string")
    texts = [(rng.choice([1, 2, None, 50 + i]), " ".join(rng.choices(words, k=8) + items[i % 25][1].split()[: rng.randint(3, 5)]
             + rng.choices(words, k=9) + items[(7 * i) % 25][1].split())) for i in range(60)] + [(3, None), (3, "")]
    seen = []
    for block in (1 << 24, 1000):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
        found, out = decontam.hits(table(spark, texts), rows, window=4), decontam.decontaminated(table(spark, texts), rows, window=4)
        seen.append([sorted(map(str, found.collect())), sorted(map(str, out.collect()))])
    assert seen[0] == seen[1] and len(seen[0][0]) == len(texts)


# Line dedup --------------------------------------------------------------------------------------------------------


def brute_lines(rows):
    seen, gone = set(), {}
    for i, t in sorted(rows):
        lines = (t or "").split("\n")
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if re.search("[^\x20\x09-\x0d]", "".join(w)):
                if w in seen:
                    gone.setdefault(i, set()).update((k, k + 1, k + 2))
                seen.add(w)
    return {i: sorted(g) for i, g in gone.items()}


def test_line_dedup(spark):
    rng = random.Random(6)
    texts = [t for t in ODD if t is None or len(t) < 5000] + ["\n".join(rng.choices("abcd", k=rng.randint(1, 14))) for _ in range(60)]
    got = {r.doc_id: (r.removed, r.text) for r in line_dedup.marked(table(spark, texts)).collect()}
    want = brute_lines(list(enumerate(texts)))
    for i, t in enumerate(texts):
        rest = t if i not in want else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i])
        assert got[i] == (want.get(i, []), rest)


def test_line_dedup_of_documents_of_several_texts(spark):
    rows = [(1, "a\nb\nc\nd"), (1, "a\nb\nc\ne"), (1, "a\nb\nc\ne"), (2, "x\na\nb\nc")]
    docs = spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, text string, removed string, n_lines int")
    out = line_dedup.marked(docs)
    assert sorted(out.columns) == ["doc_id", "n_lines", "removed", "text"]
    got = sorted((r.doc_id, r.text) for r in out.collect())
    assert got in ([(1, "a\nb\nc\nd"), (1, "e"), (1, "e"), (2, "x")], [(1, "a\nb\nc\ne"), (1, "a\nb\nc\ne"), (1, "d"), (2, "x")])


def test_line_dedup_keeps_columns_and_drops_what_is_empty(spark):
    docs = table(spark, ["a\nb\nc", "a\nb\nc", (None, "a\nb\nc"), None, (0, "a\nb\nc")])
    out = line_dedup.deduplicated(docs)
    assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == ["0", "0", "3", "None"]
    assert line_dedup.deduplicated(docs.limit(0)).count() == 0


# Chat --------------------------------------------------------------------------------------------------------------


def test_rotation(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, "ann", "é😀"), (2, 0, "system", "x"), (None, 0, "ann", "y"), (3, None, None, "z")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, chunk string")
    got = {(r.conv_id, r.speaker): r for r in chat_format.rotated(df).collect()}
    assert set(got) == {(1, "ann"), (1, "bob"), (3, "unknown")}
    ann = got[1, "ann"]
    assert ann.text == "<|im_start|>system\ns<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n<|im_start|>assistant\né😀<|im_end|>\n"
    assert [ann.text[m.start : m.end] for m in ann.mask] == ["hi", "é😀"] and ann.n_turns == 4 and ann.start == 0
    assert [m.end - m.start for m in got[1, "bob"].mask] == [0]


def brute_dialogues(rows, block):
    """A row for each speaker and range of messages, with offsets in the whole dialogue."""
    talks = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            talks.setdefault(conv, set()).add((-1 if turn is None else turn, "unknown" if role is None else role, text or ""))
    out = {}
    for conv, said in talks.items():
        said = sorted(said, key=lambda m: (m[0], hashlib.md5(f"{m[1]}\n{m[2]}".encode()).hexdigest(), m[1].encode(), m[2].encode()))
        for speaker in {r for _, r, _ in said} - {"system"}:
            at = 0
            for k, (_, role, text) in enumerate(said):
                head = f"<|im_start|>{'assistant' if role == speaker else role if role == 'system' else 'user name=' + role}\n"
                row = out.setdefault((conv, speaker, k // block), [k, 0, at, "", []])
                row[1] += 1
                row[3] += f"{head}{text}<|im_end|>\n"
                if role == speaker:
                    row[4].append((at + len(head), at + len(head) + len(text)))
                at += len(head) + len(text) + len("<|im_end|>\n")
    return out


@pytest.mark.parametrize("small", [False, True])
def test_one_unit_at_all_sizes(spark, monkeypatch, small):
    """Ties, crowded turns, repeats, wide gaps between turns, odd names: alike, however deep the tree has to be."""
    if small:
        monkeypatch.setattr(chat_format, "BLOCK", 7)
        monkeypatch.setattr(chat_format, "CROWD", 8)
        monkeypatch.setattr(chat_format, "BITS", 4)
    rng = random.Random(3)
    names = ["ann", "bob", "system", None, "", "assistant", "a\nb", "<|im_end|>", "é"]
    rows = [(1, rng.choice([5, 5, 5, i, None]), rng.choice(names), f"t{rng.randint(0, 300)}") for i in range(900)]
    rows += [(2, rng.choice([-(10**12), 0, 7, 10**12 + i]), rng.choice(names), rng.choice([None, "", "x" * 5000, "é😀"])) for i in range(60)]
    rows += [(3, 0, "system", "x"), (None, 1, "ann", "y"), (4, 1, "ann", "z"), (4, 1, "ann", "z")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, chunk string, k int")
    got = {(r.conv_id, r.speaker, r.chunk): [r.first_message, r.n_turns, r.start, r.text, [tuple(m) for m in r.mask]] for r in chat_format.rotated(df).collect()}
    assert got == brute_dialogues(rows, chat_format.BLOCK)
    assert chat_format.rotated(df.limit(0)).count() == 0


# URLs --------------------------------------------------------------------------------------------------------------


def test_urls(spark, monkeypatch):
    urls = [None, "", "no scheme", "http://EXAMPLE.com/en/71?x", "https://a.b.example.com/en/2", "http://example.net/de/8/", "x://net", "http://org/es/#f", "http://a..org/es/1", "http://xexample.com/en/7"]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    want = {0: (None, "allow"), 3: ("example.com/en/7", "allow"), 4: ("com/en/", "block"), 5: ("example.net/de/8", "block"), 7: ("org/es/", "block"), 8: ("org/es/", "block"), 9: ("com/en/", "block")}
    for most in (100, 0):
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(df.unionByName(df.limit(0)), rules).collect()}
        assert got == {i: want.get(i, (None, "allow")) for i in range(len(urls))}
    assert url_filter.judged(df, rules.limit(0)).filter("verdict = 'allow'").count() == len(urls)


# Secrets -----------------------------------------------------------------------------------------------------------


def brute_secrets(t):
    t, out = t or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        out += [(m.start(), 0, m.end())] * (len(m[2]) >= 8)
    for k, (p, least) in enumerate((("AKIA[A-Z0-9]+", 16), ("[0-9a-f]+", 32)), 1):
        out += [(m.start(), k, m.end()) for m in re.finditer(p, t) if len(m[0]) >= least]
    return [(secret_scan.KINDS[k], a, b) for a, k, b in sorted(out)]


def test_secrets(spark):
    rng = random.Random(8)
    bits = ["😀é ", "password = ", 'Token:"', "API_KEY='", "apikey : ", "secret", "\n", " ", "AKIA", "deadbeef" * 4, "the_quick_brown_fox_jumps_over", "A" * 30, "-" * 40, "ſecret=abcdefghij "]
    token = lambda: "".join(rng.choices("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=rng.randint(8, 44)))
    texts = ODD + ["".join(rng.choice([*bits, token(), hashlib.sha1(token().encode()).hexdigest()]) for _ in range(rng.randint(1, 7))) for _ in range(200)]
    texts += [texts[-1]]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secret_scan.scanned(table(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[0] != "random"] == brute_secrets(t)


def test_randomness_battery(spark):
    rng = random.Random(9)
    sign = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choices(sign, k=40)) for _ in range(40)]
    names = ["some_long_identifier_name_here", "path/to/a/file/with/a/long/name", "=" * 60, "InternationalizationSupport", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "2024-01-02-2024-01-03-2024"] * 7
    rows = secret_scan.scanned(table(spark, [f"x {t} y" for t in keys + names])).collect()
    found = {r.doc_id for r in rows if any(s.kind == "random" for s in r.spans)}
    assert len(found & set(range(40))) >= 36 and not found - set(range(40))


def brute_evidence(token):
    """Minus the decimal logarithm of the battery's p-value, in plain floats."""
    for pattern, alphabet, equal, changes in secret_scan.ENCODINGS:
        if re.search(pattern, token):
            break
    else:
        return 0.0
    s = token.lower() if len(alphabet) == 16 else token.replace("=", "")
    n = len(s)
    if n < 4:
        return 0.0
    pairs, usual = sum(s.count(c) * (s.count(c) - 1) / 2 for c in set(s)), n * (n - 1) / 2 * equal
    uniform = mixed = 0
    if pairs < usual <= secret_scan.EXACT_PAIRS:
        uniform = -math.log(math.fsum(math.exp(k * math.log(usual) - usual - math.lgamma(k + 1)) for k in range(int(pairs) + 1)))
    elif pairs < usual:
        uniform = usual - pairs + (pairs * math.log(pairs / usual) if pairs else 0)
    kind = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "-" for c in s]
    changed = sum(a != b for a, b in zip(kind, kind[1:]))  # noqa: B905
    if changed > (n - 1) * changes:
        q = min(changed / (n - 1), 1 - 1e-12)
        mixed = (n - 1) * (q * math.log(q / changes) + (1 - q) * math.log((1 - q) / (1 - changes)))
        tail = math.fsum(math.exp(math.log(math.comb(n - 1, k)) + k * math.log(changes) + (n - 1 - k) * math.log(1 - changes)) for k in range(changed, n))
        if n - 1 <= secret_scan.EXACT_STEPS and tail:
            mixed = -math.log(tail)
    codes = [alphabet.index(c) + 1 - (len(alphabet) + 1) / 2 for c in s]
    energy = sum(c * c for c in codes)
    r = min(abs(sum(a * b for a, b in zip(codes, codes[1:]))) / energy, 1 - 1e-9)  # noqa: B905
    z = (math.atanh(secret_scan.SERIAL) - math.atanh(r)) * math.sqrt(n - 3)
    apart = z * z / 2 + max(math.log(2), math.log(z * math.sqrt(2 * math.pi))) if z > 0 else 0
    return min(uniform, mixed, apart) / math.log(10)


def brute_random(texts):
    """doc index -> spans of the battery, by Benjamini-Hochberg over all tokens of a length class."""
    tokens = []
    for i, t in enumerate(texts):
        for m in re.finditer("[A-Za-z0-9+/_=-]+", t or ""):
            if len(m[0]) >= 20:
                level = max(k for k, least in enumerate(secret_scan.LENGTHS) if len(m[0]) >= least)
                tokens.append((level, min(int(brute_evidence(m[0]) // secret_scan.BIN_WIDTH), secret_scan.BINS), i, m.start(), m.end()))
    out = {}
    for level in {t[0] for t in tokens}:
        own = [t for t in tokens if t[0] == level]
        fine = [b for b in {t[1] for t in own} if 10 ** (-b * secret_scan.BIN_WIDTH) <= sum(t[1] >= b for t in own) * secret_scan.FDR / len(own)]
        for _, b, i, start, end in own:
            fixed = [(s, e) for _, s, e in brute_secrets(texts[i])]
            if fine and b >= min(fine) and not any(s <= start and end <= e for s, e in fixed):
                out.setdefault(i, []).append((start, end))
    return {i: sorted(spans) for i, spans in out.items()}


def random_texts(rng):
    hexes, base32, alnum = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    signs = [hexes, hexes.upper(), base32, alnum, alnum + "+/", alnum + "-_", "abcdefghijklmnopqrstuvwxyz"]
    plain = ["some_long_identifier_name_here", "path/to/a/file/with/a/long/name", "=" * 60, "InternationalizationSupport", "a" * 29, "2024-01-02-2024-01-03-2024",
             "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "a/b_c+d-e=" * 4, "20240102030405060708091011121314"]
    out = []
    for _ in range(250):
        words = [rng.choice(plain) if rng.random() < 0.5 else "".join(rng.choices(rng.choice(signs), k=rng.choice([19, 20, 24, 32, 40, 64, 120, 900]))) for _ in range(rng.randint(0, 3))]
        out.append(" é ".join(words))
    return out + ["password = " + out[1], None, ""]


def test_random_spans_by_brute_force(spark):
    texts = random_texts(random.Random(12))
    rows = secret_scan.scanned(table(spark, texts)).collect()
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == "random"] for r in rows}
    want = brute_random(texts)
    assert {i: s for i, s in got.items() if s} == want and len(want) > 30 and len(rows) == len(texts)


def test_secrets_of_no_documents_and_null_ids(spark):
    assert secret_scan.scanned(table(spark, []).limit(0)).count() == 0
    docs = table(spark, [(None, "token=abcdefgh"), (None, "x"), (2, "token=abcdefgh"), (2, "token=abcdefgh"), (2, "y")])
    got = sorted((str(r.doc_id), len(r.spans)) for r in secret_scan.scanned(docs).collect())
    assert got == [("2", 0), ("2", 1), ("2", 1), ("None", 0), ("None", 1)]


# Licenses ----------------------------------------------------------------------------------------------------------


def normal(text):
    return WORD.findall((text or "").translate(LOWER))


def brute_license(text, templates):
    """(n_words, n_base, first, last, base labels, spans) of a text, with plain loops and a quadratic subsequence."""
    own, base, found = normal(text), [], []
    for phrase, label in license_scan.PHRASES:
        p = phrase.split()
        base += [(i, label) for i in range(len(own)) if own[i : i + len(p)] == p]
    for label, t in templates:
        t = normal(t)
        hits = sorted((i - j, i) for i in range(len(own) - 2) for j in range(len(t) - 2) if own[i : i + 3] == t[j : j + 3])
        groups = []
        for d, i in hits:
            if groups and d - groups[-1][-1][0] <= 3 and d - groups[-1][0][0] <= max(3, int(0.25 * len(t))):
                groups[-1].append((d, i))
            else:
                groups.append([(d, i)])
        for g in groups:
            place = own[max(0, g[0][0]) : max(0, g[-1][0] + len(t))]
            row = [0] * (len(t) + 1)
            for x in place:
                last = 0
                for j, y in enumerate(t, 1):
                    row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
            if len(g) >= 0.3 * (len(t) - 2) and row[-1] >= 0.8 * len(t):
                found.append((-row[-1], min(i for _, i in g), label, max(i for _, i in g) + 3))
    kept = []
    for f in sorted(found):
        if all(f[3] <= k[1] or k[3] <= f[1] for k in kept):
            kept.append(f)
    starts = [i for i, _ in base]
    return (len(own), len(base), min(starts, default=None), max(starts, default=None), sorted({x for _, x in base}), sorted((k[1], k[2], k[3]) for k in kept))


def license_rows(rng):
    notices, out = [normal(t) for _, t in license_scan.TEMPLATES], []
    for _ in range(60):
        text = []
        for _ in range(rng.randint(1, 3)):
            t = rng.choice(notices)
            text += rng.choices(["a", "b", "the", "mit", "license"], k=rng.randint(0, 12))
            text += [rng.choice(["x", w, w, w]) if rng.random() < 0.1 else w for w in t if rng.random() > rng.choice([0, 0, 0.05, 0.3])]
        out.append(", ".join(text).title())
    out += ["mit license " * 40, "released under the mit license " * 6, "licensed under cc by 4 0 licensed under cc by 4 0"]
    return [*ODD, *out, "x MIT   License. y mit license", "Licensed under CC BY-NC 4.0.", "general public license", "the apache and license"]


def test_licenses_by_brute_force(spark):
    texts = license_rows(random.Random(5))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[20]), (None, texts[21]), (15, texts[15]), (15, texts[16])]
    want = [(i, *brute_license(t, license_scan.TEMPLATES)) for i, t in rows]
    got = [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base, [(s.start, s.label, s.end) for s in r.spans])
           for r in license_scan.scanned(table(spark, rows)).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(bool(w[-1]) for w in want) > 30


def test_no_licenses(spark):
    assert license_scan.scanned(table(spark, []).limit(0)).count() == 0
    docs = table(spark, ["mit license", license_scan.TEMPLATES[0][1]])
    for templates in ((), (("x", "two words"),), (("x", ""),)):
        got = {r.doc_id: (r.base, r.spans) for r in license_scan.scanned(docs, templates=templates).collect()}
        assert got == {0: (["mit"], []), 1: ([], [])}


# Quality -----------------------------------------------------------------------------------------------------------


def brute_counts(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    hit = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 8)}
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)]


def test_counts(spark):
    rng, words = random.Random(2), [*vocabulary(5), "é#", "x|"]
    texts = [t for t in ODD if t is None or len(t) < 5000] + ["".join(w + rng.choice(" \n\t") for w in rng.choices(words, k=rng.randint(1, 60))) for _ in range(40)]
    got = {r.doc_id: [r[c] for c in stats.COUNTS] for r in stats.document_stats(table(spark, texts)).collect()}
    assert got == {i: brute_counts(t) for i, t in enumerate(texts)}


def labelled(spark, n=300):
    rng, words = random.Random(1), vocabulary()
    good = [" ".join(rng.choices(words, k=rng.randint(30, 90))) + "." for _ in range(n)]
    bad = [" ".join(w + rng.choice(["!!", "###", "|"]) for w in rng.choices(words, k=rng.randint(30, 90))) for _ in range(n)]
    docs = table(spark, good + bad + ODD)
    labels = spark.createDataFrame([(i, int(i < n), 0) for i in range(2 * n) if i % 3], "doc_id long, quality int, toxic int")
    return docs, labels, n


def test_discriminant(spark):
    docs, labels, n = labelled(spark)
    rows = qda.classified(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 2 * n]
    assert held and all(r.predicted == int(r.doc_id < n) for r in held)
    assert {r.score for r in qda.classified(docs, labels.limit(0)).collect()} == {0.5}
    assert qda.classified(docs.limit(0), labels).count() == 0


def test_discriminant_sums_equal_a_direct_fit(spark):
    rng = np.random.default_rng(0)
    x, y = rng.random((200, len(stats.FEATURES))), rng.integers(0, 2, 200)
    z = qda.transformed(x)
    model = qda.fit(spark.createDataFrame([(r.tolist(), int(c)) for r, c in zip(x, y, strict=True)], "features array<double>, label int").repartition(5))
    assert np.allclose(model.means, [z[y == c].mean(axis=0) for c in (0, 1)])
    again = np.linalg.inv(model.inverse[1]) @ np.linalg.inv(model.inverse[1]).T
    assert np.isclose(np.linalg.slogdet(again)[1], model.log_det[1])


def test_boosted_rules(spark):
    docs, labels, n = labelled(spark)
    rows = {r.doc_id: r for r in boosted_rules.judged(docs, labels).collect()}
    assert all(rows[i].kept for i in range(n) if not rows[i].base_failed)
    assert sum(rows[i].kept for i in range(n, 2 * n)) <= 0.02 * n
    assert rows[2 * n].base_failed and not rows[2 * n + 7].kept
    kept = boosted_rules.filtered(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}
    assert boosted_rules.judged(docs, labels.limit(0)).filter("not base_failed and not kept").count() == 0
    assert boosted_rules.judged(docs.limit(0), labels).count() == 0


def test_boosted_fit_does_not_depend_on_row_order(spark):
    """Labels and texts that contradict each other, in any order of rows."""
    docs, labels, n = labelled(spark, 60)
    more = docs.filter("doc_id % 7 = 0").withColumn("text", F.concat("text", F.lit(" and ### more!!")))
    other = labels.filter("doc_id % 5 = 0").withColumn("quality", 1 - F.col("quality"))
    docs, labels = docs.unionByName(more), labels.unionByName(other)
    trees = [boosted_rules.fitted(d, w) for d, w in ((docs, labels), (docs.orderBy(F.rand(1)), labels.orderBy(F.desc("quality"))))]
    assert all((getattr(trees[0], f) == getattr(trees[1], f)).all() for f in ("feature", "cut", "left", "right", "value", "roots"))


def test_monotone_features():
    rng = np.random.default_rng(1)
    x = rng.random((3000, len(stats.FEATURES)))
    at = stats.FEATURES.index("symbols")
    y = (rng.random(3000) < 0.5 + 0.3 * np.sin(9 * x[:, at])).astype(float)
    forest = boosted_rules.grow(x, y)
    grid = np.repeat(rng.random((20, 1, x.shape[1])), 50, axis=1)
    grid[:, :, at] = np.linspace(0, 1, 50)
    scores = forest.score(grid.reshape(-1, x.shape[1])).reshape(20, 50)
    assert (np.diff(scores, axis=1) <= 1e-12).all() and np.ptp(scores) > 0


# BPE ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries._tokenizer())


ALPHABET = "abcdeéßüİΣσς  \t\n\x1c\x1f\x85'\u2019\u00a0\u0301\u0065\u030112²½٣中文字😀!!..#<|endoftext|>ABCÄÖ'S'll\u200b\ufeff\x00"


def test_bpe_equals_the_library(spark, tokenizer):
    rng = random.Random(1)
    texts = ODD + ["It'LL be <|endoftext|>x<|startoftext|>", "abc" * 4000, "<|endoftext|>" * 3]
    texts += ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(1, 60))) for _ in range(600)]
    rows = {r.doc_id: r for r in bpe.round_trip(table(spark, texts), queries._tokenizer(), most=50).collect()}
    for i, t in enumerate(texts):
        want = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(rows[i].ids) // 4}I", bytes(rows[i].ids))) == want
        assert rows[i].decoded == tokenizer.decode(want, skip_special_tokens=False) and rows[i].n_tokens == len(want)
    back = {r.doc_id: r.text for r in bpe.decoded(bpe.round_trip(table(spark, texts[:20]), queries._tokenizer(), decode=False), queries._tokenizer()).collect()}
    assert back == {i: rows[i].decoded for i in range(20)}
    assert bpe.round_trip(table(spark, []).limit(0), queries._tokenizer()).count() == 0


def test_pieces_are_cut_at_the_tokenizers_blanks():
    """Every character between two letters, but surrogates; with the four that Arrow takes for blanks on a way of their own."""
    signs = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for group in ([c for c in signs if c not in bpe._NO_BLANKS], list(bpe._NO_BLANKS)):
        cut = bpe.pieces_of(bpe.pa.array([f"a{c}b" for c in group])).to_pylist()
        assert [len(p) == 2 for p in cut] == [not bpe._SPLIT.fullmatch(c) for c in group]
    assert bpe.pieces_of(bpe.pa.array([None, "", " a ", "a  b"], bpe.pa.string())).to_pylist()[0] == [""]


def test_words_that_stand_once_in_each_partition_count(spark):
    docs = table(spark, ["often one", "often two", "often three"]).repartition(3)
    assert bpe.frequent_words(docs, bpe._bpe(open(queries._tokenizer(), encoding="utf-8").read()), 1)[0].startswith("often")


def test_lexicon_is_minimal_and_exact():
    words = [b"tap", b"taps", b"top", b"tops", b"stop", b"stops", b"\xc3\xa9"]
    lexicon = bpe.Lexicon(bpe.Lexicon.compiled({w: [i, i + 1] for i, w in enumerate(words)}))
    asked = [*words, b"", b"ta", b"tapsx", b"x"]
    got = [None if b is None else list(np.frombuffer(b, "<u4")) for b in lexicon.packed(asked)]
    assert got == [[i, i + 1] for i in range(len(words))] + [None] * 4
    assert len(lexicon.final) < sum(map(len, words)) - 8  # shared suffixes
    assert bpe.Lexicon(bpe.Lexicon.compiled({})).packed([b"a"]) == [None]
