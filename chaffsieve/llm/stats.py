"""Statistics of whole texts for the quality models and rules, a row for each document.

Words are runs of anything but the six ASCII blanks. Null counts as empty; an empty text has zeros everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chaffsieve.llm._common import rolling, slices, texts, word_hashes

REPEAT_WINDOW = 8
#: Whole counts that rules use.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Shares and logarithms that models use.
FEATURES = [
    "log_words", "word_length", "symbols", "pipes", "exclaims", "upper", "digits", "points", "dup_lines", "repeats",
    "distinct", "line_words", "closed_lines", "short_words", "long_words", "wide_chars", "log_lines", "marked_words",
]

_KINDS = {
    "blank": b" \t\n\x0b\x0c\r", "symbol": b"#*$%&<>", "pipe": b"|", "exclaim": b"!", "upper": bytes(range(65, 91)),
    "digit": b"0123456789", "point": b".,;:?\"'()-", "tail": bytes(range(128, 192)), "wide": bytes(range(192, 256)),
}
_CODE = np.zeros(256, np.uint8)
for _k, _chars in enumerate(_KINDS.values(), 1):
    _CODE[list(_chars)] = _k
_AT = {k: i for i, k in enumerate(_KINDS, 1)}
_MARKS = tuple(b"#*$%&|<>!")


def _repeated(hashes: np.ndarray) -> int:
    """Words within windows of REPEAT_WINDOW words that the text has twice or more."""
    windows = rolling(hashes, REPEAT_WINDOW)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    ranked = windows[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(hashes) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + REPEAT_WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(body: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[list[int], list[float]]:
    """COUNTS and FEATURES of one text."""
    kinds = np.bincount(_CODE[np.frombuffer(body, np.uint8)], minlength=16)
    n, get = len(words), lambda k: int(kinds[_AT[k]])
    chars = len(body) - get("tail")
    word_chars = chars - get("blank")
    lines = [x for x in body.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = _repeated(hashes)
    counts = [n, word_chars, get("symbol") + get("pipe"), dup, repeat]
    if not n:
        return counts, [0.0] * len(FEATURES)
    lengths = np.fromiter(map(len, words), np.int64, n)
    closed = sum(x.rstrip()[-1:] in b".!?\"':;" for x in lines)
    marked = sum(w[-1] in _MARKS for w in words)
    features = [
        np.log1p(n), word_chars / n, counts[2] / word_chars, get("pipe") / n, get("exclaim") / n,
        get("upper") / word_chars, get("digit") / word_chars, get("point") / word_chars, dup / len(lines), repeat / n,
        len(np.unique(hashes)) / n, np.log1p(n / len(lines)), closed / len(lines), (lengths <= 3).mean(),
        (lengths >= 12).mean(), get("wide") / word_chars, np.log1p(len(lines)), marked / n,
    ]
    return counts, [float(x) for x in features]


def measured(bodies: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """COUNTS and FEATURES of texts, a row for each."""
    bodies = [b or b"" for b in bodies]
    words = [b.split() for b in bodies]
    flat = word_hashes([w for ws in words for w in ws])
    ends = np.cumsum([len(w) for w in words]).tolist()
    rows = [measure(b, w, flat[e - len(w) : e]) for b, w, e in zip(bodies, words, ends, strict=True)]
    counts = np.array([c for c, _ in rows], np.int64).reshape(-1, len(COUNTS))
    return counts, np.array([f for _, f in rows], np.float64).reshape(-1, len(FEATURES))


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS as long and FEATURES as array<double>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            counts, features = measured(part.column("body").to_pylist())
            rows = pa.ListArray.from_arrays(np.arange(len(counts) + 1, dtype=np.int32) * len(FEATURES), features.ravel())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c) for c in counts.T.copy()), rows],
                names=["doc_id", *COUNTS, "features"],
            )

    counts = ", ".join(f"{c} long" for c in COUNTS)
    return texts(docs).mapInArrow(run, f"doc_id long, {counts}, features array<double>")
