"""License scan by diagonal voting.

All rolling word k-grams of the documents are hashed and joined with the positions of those of the templates. A hit
votes for the diagonal (position in the document minus position in the template). Neighbouring diagonals of a template
are merged into one candidate as long as they drift by no more than a quarter of the template; a candidate needs votes of
VOTED of the template's k-grams, and is verified word by word: the longest common subsequence of its place and the template
must have COVERED of the template's words. Its span reaches from the first to the last word that voted.

The template positions are broadcast only where there are at most BROADCAST_GRAMS of them; beyond that the join
shuffles. Texts are read once for the hashes and once more for the span words, and only documents with a template gram
carry their words to the verification.

Defined cases: null, empty and wordless texts have no words and no labels; documents shorter than a k-gram can
hold phrases only; templates shorter than one are never found, and without any template only phrases are; repeated rows
each get a row (documents are told apart by doc_id and text); rows with null doc_id are scanned too; other columns are
ignored; of overlapping spans the one with the most words in common stays, then the one with the smaller start, then label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaffsieve.llm._common import ALNUM, rolling, slices, texts, word_hashes
from chaffsieve.llm.license_texts import TEMPLATES

#: Consecutive words and the label that they give.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
GRAM = 3
#: Diagonals this near to their neighbour are one candidate.
SLACK = 3
#: Most drift of merged diagonals, as a share of the template's words.
DRIFT = 0.25
#: Least share of a template's k-grams that vote for a candidate.
VOTED = 0.3
#: Least share of a template's words that its place has in order.
COVERED = 0.8
BROADCAST_GRAMS = 1 << 18


def words(body: bytes | None) -> list[bytes]:
    return (body or b"").translate(ALNUM).split()


def _grams(docs: DataFrame, size: int) -> DataFrame:
    """_id, _text, grams: the hashes of all rolling k-grams of each document, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = [words(b) for b in part.column("body").to_pylist()]
            flat = word_hashes([w for ws in own for w in ws])
            ends = np.cumsum([len(w) for w in own]).tolist()
            grams = [rolling(flat[e - len(w) : e], size).view(np.int64) for w, e in zip(own, ends, strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("_text"), pa.ListArray.from_arrays(offsets, np.concatenate(grams))],
                names=["_id", "_text", "grams"],
            )

    return docs.mapInArrow(run, "_id long, _text long, grams array<long>")


def template_positions(docs: DataFrame, templates: tuple, size: int) -> DataFrame:
    """gram, template, pos for every k-gram of every template."""
    rows = [
        (int(g), t, p)
        for t, (_, text) in enumerate(templates)
        for p, g in enumerate(rolling(word_hashes(words(text.encode())), size).view(np.int64).tolist())
    ]
    return docs.sparkSession.createDataFrame(rows, "gram long, template int, pos int")


def votes(docs: DataFrame, templates: tuple = TEMPLATES, size: int = GRAM) -> DataFrame:
    """_id, _text, template, diagonal, votes, first and last (position of a voting k-gram)."""
    known = template_positions(docs, templates, size)
    if sum(len(words(t.encode())) for _, t in templates) <= BROADCAST_GRAMS:
        known = F.broadcast(known)
    return (
        _grams(docs, size)
        .select("_id", "_text", F.posexplode("grams").alias("at", "gram"))
        .join(known, "gram")
        .groupBy("_id", "_text", "template", (F.col("at") - F.col("pos")).alias("diagonal"))
        .agg(F.count_distinct("at").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"))
    )


def merged(voted: list, drift: int) -> list[tuple[int, int, int, int, int]]:
    """(low, high, votes, first, last) of neighbouring diagonals, from (diagonal, votes, first, last) in order."""
    out: list[tuple] = []
    for diagonal, n, first, last in voted:
        if out and diagonal - out[-1][1] <= SLACK and diagonal - out[-1][0] <= drift:
            low, _, m, f, e = out[-1]
            out[-1] = (low, diagonal, m + n, min(f, first), max(e, last))
        else:
            out.append((diagonal, diagonal, n, first, last))
    return out


def places(own: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the phrase's words stand consecutively."""
    out, n = [], len(phrase)
    try:
        at = own.index(phrase[0])
        while True:
            if own[at : at + n] == phrase:
                out.append(at)
            at = own.index(phrase[0], at + 1)
    except ValueError:
        return out


def common(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence: one bit for each word of b, zero where the length grows."""
    where: dict[bytes, int] = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    row = whole = (1 << len(b)) - 1
    for x in a:
        both = row & where.get(x, 0)
        row = ((row + both) | (row - both)) & whole
    return len(b) - row.bit_count()


def _spans(own: list[bytes], voted: list, wanted: list[tuple[str, list[bytes]]], size: int) -> list[dict]:
    """The verified spans of a document of these words, from its votes (template, diagonal, votes, first, last)."""
    found, by_template = [], {}
    for t, *rest in sorted(voted):
        by_template.setdefault(t, []).append(rest)
    for t, diagonals in by_template.items():
        label, text = wanted[t]
        for low, high, n, first, last in merged(diagonals, max(SLACK, int(DRIFT * len(text)))):
            if n < VOTED * (len(text) - size + 1):
                continue
            same = common(own[max(0, low) : max(0, high + len(text))], text)
            if same >= COVERED * len(text):
                found.append((-same, first, label, last + size, same / len(text)))
    kept: list[tuple] = []
    for span in sorted(found):
        if all(span[3] <= k[1] or k[3] <= span[1] for k in kept):
            kept.append(span)
    kept.sort(key=lambda k: (k[1], k[2]))
    return [dict(zip(("label", "start", "end", "covered"), (k[2], k[1], k[3], k[4]), strict=True)) for k in kept]


def _counted(docs: DataFrame, phrases: tuple, templates: tuple, size: int) -> DataFrame:
    """doc_id, _text, n_words, n_base, first_word, last_word, base (labels), and own: the words of documents with a
    template gram, with blanks between them."""
    parts = [(p.encode().split(), label) for p, label in phrases]
    known = [rolling(word_hashes(words(t.encode())), size) for _, t in templates]
    grams = np.unique(np.concatenate([np.empty(0, np.uint64), *known]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = [words(b) for b in part.column("body").to_pylist()]
            flat = word_hashes([w for ws in own for w in ws])
            ends = np.cumsum([len(w) for w in own]).tolist()
            n, first, last, labels, kept = [], [], [], [], []
            for w, e in zip(own, ends, strict=True):
                found = [(at, label) for p, label in parts for at in places(w, p)]
                starts = [at for at, _ in found]
                n.append(len(found))
                first.append(min(starts, default=None))
                last.append(max(starts, default=None))
                labels.append(sorted({label for _, label in found}))
                rolled = rolling(flat[e - len(w) : e], size)
                kept.append(b" ".join(w) if np.isin(rolled, grams).any() else None)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("_text"),
                    pa.array([len(w) for w in own], pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(first, pa.int64()),
                    pa.array(last, pa.int64()),
                    pa.array(labels, pa.list_(pa.string())),
                    pa.array(kept, pa.binary()),
                ],
                names=["doc_id", "_text", "n_words", "n_base", "first_word", "last_word", "base", "own"],
            )

    return docs.mapInArrow(
        run,
        "doc_id long, _text long, n_words long, n_base long, first_word long, last_word long, base array<string>, own binary",
    )


def scanned(docs: DataFrame, phrases: tuple = PHRASES, templates: tuple = TEMPLATES, size: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base (labels of phrases) and spans (array of label, start, end
    in words, covered: the verified template spans)."""
    docs = texts(docs, F.xxhash64("text").alias("_text"))
    voted = (
        votes(docs, templates, size)
        .groupBy("_id", "_text")
        .agg(F.collect_list(F.struct("template", "diagonal", "votes", "first", "last")).alias("voted"))
    )
    counted = _counted(docs, phrases, templates, size)
    rows = counted.join(
        voted, counted["doc_id"].eqNullSafe(voted["_id"]) & counted["_text"].eqNullSafe(voted["_text"]), "left"
    ).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", "own", "voted")
    wanted = [(label, words(text.encode())) for label, text in templates]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for own, voted in zip(batch.column("own").to_pylist(), batch.column("voted").to_pylist(), strict=True):
                rows = [tuple(v.values()) for v in voted or ()]
                spans.append(_spans(own.split(), rows, wanted, size) if rows and own is not None else [])
            kind = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("covered", pa.float64())])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in _PLAIN), pa.array(spans, pa.list_(kind))], names=[*_PLAIN, "spans"]
            )

    return rows.mapInArrow(
        verify,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base array<string>, "
        "spans array<struct<label:string,start:long,end:long,covered:double>>",
    )


_PLAIN = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base"]
