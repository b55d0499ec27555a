"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Words are runs of [0-9a-z] and non-ASCII characters after A-Z became a-z. The windows of an item are its runs of
`window` words; an item of fewer words is one window. Windows are hashed; a bit table and then the words themselves
decide on a document window, so a hit is never a hash collision.

The items go out as broadcasts of at most BLOCK_BYTES of text (an item is not cut); more items mean more blocks and one
scan for each, never a larger broadcast. A worker holds the words, 16 bytes a window and 8 a word of a block: about five
times its text, and twenty times while it builds the index. The results do not depend on the number of blocks.

Defined cases: null, empty or wordless texts have no words and no hits; items that are null, wordless or without id
have no windows; repeated items count once by item_id; repeated documents are scanned row by row; other columns are
ignored by `hits` and returned unchanged by `decontaminated`.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaffsieve.llm._common import ALNUM, rolling, slices, texts, word_hashes, written

WINDOW = 10
#: Most bytes of item text in one broadcast.
BLOCK_BYTES = 8 << 20
#: A document of which at least this share of the words is hit goes as a whole.
DROP_SHARE = 0.5
_BITS = 22
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_HITS = "array<struct<start:int,end:int>>"


def words(body: bytes | None) -> list[bytes]:
    return (body or b"").translate(ALNUM).split()


class Index:
    """Windows of the items by their length: sorted hashes, each with the place of the window in one byte string of all
    words and with its item, and a bit table over the hashes."""

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        own = [(item, words(body)) for item, body in items]
        own = [(item, w) for item, w in own if w]
        flat = [x for _, w in own for x in w]
        self.text = b" ".join(flat)
        lengths = np.fromiter(map(len, flat), np.int64, len(flat))
        self.ends = (np.cumsum(lengths + 1) - 1).astype(np.int32)
        self.starts = (self.ends - lengths).astype(np.int32)
        self.items = np.array([item for item, _ in own], np.int64)
        hashes, counts = word_hashes(flat), np.array([len(w) for _, w in own], np.int64)
        owner = np.repeat(np.arange(len(own)), counts)
        sizes = np.minimum(window, counts)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.bits: dict[int, np.ndarray] = {}
        for size in np.unique(sizes).tolist():
            rolled = rolling(hashes, size)
            at = np.flatnonzero((owner[: len(rolled)] == owner[size - 1 :]) & (sizes[owner[: len(rolled)]] == size))
            at = at[np.argsort(rolled[at], kind="stable")]
            self.windows[size] = (rolled[at], at.astype(np.int32), owner[at].astype(np.int32))
            self.bits[size] = np.zeros(1 << _BITS, bool)
            self.bits[size][rolled[at] >> np.uint64(64 - _BITS)] = True

    def _owners(self, size: int, low: int, high: int, found: bytes) -> set[int]:
        """The items of the windows low to high of this length that are these words."""
        _, at, owner = self.windows[size]
        same = set()
        for k in range(low, high):
            if self.text[self.starts[at[k]] : self.ends[at[k] + size - 1]] == found:
                same.add(int(self.items[owner[k]]))
        return same

    def scan(self, docs: list[list[bytes]]) -> list[tuple[list[tuple[int, int]], list[int]]]:
        """For each document its hit runs of words (start, end) and the items that occur."""
        flat = [x for w in docs for x in w]
        ends = np.cumsum([len(w) for w in docs])
        owner = np.repeat(np.arange(len(docs)), [len(w) for w in docs])
        hashes = word_hashes(flat)
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[int]] = {}
        for size, (known, _, _) in self.windows.items():
            rolled = rolling(hashes, size)
            if not len(rolled):
                continue
            at = np.flatnonzero(self.bits[size][rolled >> np.uint64(64 - _BITS)])
            at = at[owner[at] == owner[at + size - 1]]
            low, high = (np.searchsorted(known, rolled[at], side) for side in ("left", "right"))
            seen: dict[bytes, set[int]] = {}
            for p, a, b in zip(*(x[low < high].tolist() for x in (at, low, high)), strict=True):
                window = b" ".join(flat[p : p + size])
                if window not in seen:
                    seen[window] = self._owners(size, a, b, window)
                if seen[window]:
                    d = int(owner[p])
                    start = p - int(ends[d]) + len(docs[d])
                    spans.setdefault(d, []).append((start, start + size))
                    items.setdefault(d, set()).update(seen[window])
        out = []
        for d in range(len(docs)):
            runs: list[tuple[int, int]] = []
            for start, end in sorted(spans.get(d, ())):
                if runs and start <= runs[-1][1]:
                    runs[-1] = (runs[-1][0], max(end, runs[-1][1]))
                else:
                    runs.append((start, end))
            out.append((runs, sorted(items.get(d, ()))))
        return out


_BUILT: dict = {}


def _index(key: str, items: list, window: int) -> Index:
    """Built once in a worker."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Index(items, window)
    return _BUILT[key]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The items, read partition by partition, in blocks of at most BLOCK_BYTES or of one item; at least one block."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("body"))
    block, held, blocks = [], 0, 0
    for r in items.filter("item_id is not null and body is not null").toLocalIterator():
        size = len(r[1]) + 64
        if block and held + size > BLOCK_BYTES:
            yield block
            block, held, blocks = [], 0, blocks + 1
        block.append((r[0], bytes(r[1])))
        held += size
    if block or not blocks:
        yield block


def _sent(docs: DataFrame, items: DataFrame) -> list[tuple]:
    """The blocks of items as broadcasts, each with a key for its index."""
    sc = docs.sparkSession.sparkContext
    return [(sc.broadcast(block), uuid.uuid4().hex) for block in _blocks(items)]


def _scanned(docs: DataFrame, block: tuple, window: int) -> DataFrame:
    """docs: row, doc_id and body. A row for each of them with its hits in one block of items."""
    sent, key = block

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(key, sent.value, window)
        for part in slices(batches):
            found = [words(b) for b in part.column("body").to_pylist()]
            seen = index.scan(found)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row"),
                    part.column("doc_id"),
                    pa.array([len(w) for w in found], pa.int64()),
                    pa.array(
                        [[{"start": s, "end": e} for s, e in runs] for runs, _ in seen],
                        pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
                    ),
                    pa.array([ids for _, ids in seen], pa.list_(pa.int64())),
                ],
                names=["row", "doc_id", "n_words", "hits", "item_ids"],
            )

    return docs.mapInArrow(scan, f"row long, doc_id long, n_words long, hits {_HITS}, item_ids array<long>")


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, hits (merged runs of hit words, end exclusive) and item_ids (sorted), a row for each document."""
    docs, blocks = texts(docs), _sent(docs, items)
    if len(blocks) == 1:
        return _scanned(docs.withColumn("row", F.lit(0).cast("long")), blocks[0], window).drop("row")
    # Written, so that every block meets the same number on the same row.
    docs = written(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    return _merged([_scanned(docs, b, window) for b in blocks]).drop("row")


def _merged(parts: list[DataFrame]) -> DataFrame:
    """One row a document from those of several blocks of items: the runs are united, the items concatenated."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    united = F.expr(
        """aggregate(array_sort(flatten(collect_list(hits))), cast(array() as array<struct<start:int,end:int>>),
        (a, x) -> case when size(a) > 0 and x.start <= element_at(a, -1).end then
          concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(x.end, element_at(a, -1).end))))
          else concat(a, array(x)) end)"""
    )
    return out.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        united.alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"),
    )


def _cut(body: bytes, runs: list[tuple[int, int]], drop_share: float) -> bytes | None:
    """The text without the runs of words, or None where the whole document goes."""
    low = body.translate(ALNUM)
    if sum(e - s for s, e in runs) >= drop_share * len(low.split()):
        return None
    places = [m.span() for m in _WORD.finditer(low)]
    kept, at = [], 0
    for start, end in runs:
        kept.append(body[at : places[start][0]])
        at = places[end - 1][1]
    return b"".join([*kept, body[at:]])


def without(body: bytes, index: Index, drop_share: float = DROP_SHARE) -> bytes | None:
    """The text without its hit spans, or None where the whole document goes. What closes up is scanned again."""
    while body is not None and (runs := index.scan([words(body)])[0][0]):
        body = _cut(body, runs, drop_share)
    return body


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, drop_share: float = DROP_SHARE) -> DataFrame:
    """The documents, all columns kept, with hit spans cut out of the text; documents that are mostly hit go."""
    schema, blocks = docs.schema, _sent(docs, items)
    if len(blocks) > 1:
        return _cut_by_blocks(docs, blocks, window, drop_share)
    sent, key = blocks[0]

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _index(key, sent.value, window)
        for part in slices(batches, "text"):
            bodies = [None if b is None else b.encode() for b in part.column("text").to_pylist()]
            seen = index.scan([words(b) for b in bodies])
            if any(runs for runs, _ in seen):
                new = [
                    without(b, index, drop_share) if runs else b for b, (runs, _) in zip(bodies, seen, strict=True)
                ]
                part = _replaced(part, new, pa.array([not r or n is not None for n, (r, _) in zip(new, seen, strict=True)]))
            yield part

    return docs.mapInArrow(clean, schema)


def _replaced(part: pa.RecordBatch, new: list[bytes | None], keep: pa.Array) -> pa.RecordBatch:
    field = part.schema.field("text")
    text = pa.array([None if n is None else n.decode() for n in new], field.type)
    return part.set_column(part.schema.get_field_index("text"), field, text).filter(keep)


def _cut_by_blocks(docs: DataFrame, blocks: list[tuple], window: int, drop_share: float) -> DataFrame:
    """As with one block: the runs of all blocks are united before a document is judged and cut, and what closes up is
    scanned again by all of them."""
    columns, row, runs = docs.columns, f"row_{uuid.uuid4().hex}", f"runs_{uuid.uuid4().hex}"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            found = [[(x["start"], x["end"]) for x in r] for r in part.column(runs).to_pylist()]
            bodies = [b.encode() for b in part.column("text").to_pylist()]
            new = [_cut(b, r, drop_share) for b, r in zip(bodies, found, strict=True)]
            part = part.drop_columns([runs])
            yield _replaced(part, new, pa.array([n is not None for n in new], pa.bool_()))

    rest, done = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows"), []
    while True:
        bodies = texts(rest, F.col(row).alias("row"))
        found = _merged([_scanned(bodies, b, window) for b in blocks]).filter("size(hits) > 0")
        found = written(found.select(F.col("row").alias(row), F.col("hits").alias(runs)), "hits")
        done.append(rest.join(found, row, "left_anti").select(columns))
        if found.isEmpty():
            break
        hit = rest.join(found, row).select(*columns, row, runs)
        rest = written(hit.mapInArrow(cut, hit.drop(runs).schema), "rows")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
