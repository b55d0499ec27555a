"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

The most frequent words of the corpus are merged once, on the driver, and compiled into the minimal acyclic automaton
of these words: equal suffixes share their states. Every arc carries a number, and the sum along a word's path is the
word's rank, by which its ids stand in one packed table. The whole is a flat byte string that workers memory-map. Words
that are not in it are merged exactly, by rank and then from the left, so which words are in it changes only the speed.

Texts are encoded as the tokenizer file says: special tokens are found in the raw text, then NFC, lower case without
context, the split pattern, and byte-level symbols of which the last ends the word.

Defined cases: null and empty texts have no ids and decode to the empty text; repeated documents each get a row; other
columns are ignored. A word of any length is merged in O(n log n).
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import struct
import tempfile
import unicodedata
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaffsieve.llm._common import slices, texts

#: Words in the lexicon; it is what is broadcast, about 6 MB.
LEXICON_WORDS = 1 << 17
#: Longer words are not worth a place in it.
LEXICON_BYTES = 48
#: Pieces between blanks that a worker remembers.
CACHE = 80_000
#: Bytes of text that are encoded at a time: the more, the fewer pieces are looked up again.
ENCODED = 4 << 20
#: Pieces that are counted at a time.
COUNTED = 2_000_000
_MAGIC = b"MAT1"
#: Bits of an id, and a rank after all others.
_ID = 20
_MASK, _NONE = (1 << _ID) - 1, 1 << 62
#: Fixed values of the tokenizer: its split pattern, with the Unicode blanks spelled out.
_BLANK = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_BLANK}\p{{L}}\p{{N}}]+"
#: The same for many pieces at once, with what parts them as a match of its own.
_PATTERN = regex.compile(rf"\n|{_WORDS}")
#: Blanks for str.split() that are none for the tokenizer.
_NO_BLANKS = ("\x1c", "\x1d", "\x1e", "\x1f")
_SPLIT = regex.compile(rf"[^{_BLANK}]+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next ones from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """Merges and ids of a tokenizer file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        v = self.vocab
        # Both ids of a pair in one number, and its rank above the new id in another: the least is the first to merge.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[v[a] << _ID | v[b]] = rank << _ID | v[a + b]
        symbols = byte_symbols()
        self.first = [v[s] for s in symbols]
        self.last = [v[s + self.end] for s in symbols]
        names = {i: t for t, i in [*v.items(), *self.special.items()]}
        self.tokens = pa.array([names.get(i, "") for i in range(max(names) + 1)])
        self.mark = os.path.commonprefix(list(self.special))  # stands in every special token
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word: the pair of the lowest rank is merged first, the leftmost among equals."""
        ids = [*map(self.first.__getitem__, word[:-1]), self.last[word[-1]]]
        if len(ids) > 256:
            return self._merge_long(ids)
        get = self.merges.get
        ranks = [get(a << _ID | b, _NONE) for a, b in pairwise(ids)]
        while ranks and (least := min(ranks)) != _NONE:
            i = ranks.index(least)
            new = ids[i] = least & _MASK
            del ranks[i], ids[i + 1]
            if i < len(ranks):
                ranks[i] = get(new << _ID | ids[i + 1], _NONE)
            if i:
                ranks[i - 1] = get(ids[i - 1] << _ID | new, _NONE)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap for words of which a pass for each merge would take too long."""
        n, get = len(ids), self.merges.get
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]

        def entry(i: int) -> tuple[int, int, int, int, int] | None:
            j = after[i]
            m = get(ids[i] << _ID | ids[j]) if j >= 0 else None
            return None if m is None else (m >> _ID, i, ids[i], ids[j], m & _MASK)

        heap = [e for i in range(n - 1) if (e := entry(i))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for at in (i, before[i]):
                if at >= 0 and (e := entry(at)):
                    heapq.heappush(heap, e)
        return [x for x in ids if x >= 0]

    def words(self, pieces: list[str]) -> list[str]:
        """The words of pieces without blanks and special tokens, with a line feed after those of each piece."""
        text = "\n".join([*pieces, ""])
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return _PATTERN.findall(text.lower())

    def decode(self, ids: pa.Array) -> pa.Array:
        """Texts of ids (little-endian unsigned 32-bit integers): the tokens with blanks between them, as the tokenizer
        file has no decoder."""
        counts = pc.fill_null(pc.binary_length(ids), 0).to_numpy(zero_copy_only=False) // 4
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        flat = np.frombuffer(b"".join(ids.drop_null().to_pylist()), "<u4")
        return pc.binary_join(pa.ListArray.from_arrays(offsets, self.tokens.take(pa.array(flat))), " ")


class Lexicon:
    """A minimal acyclic transducer from words to id sequences over one flat buffer."""

    def __init__(self, buffer: bytes | mmap.mmap):
        magic, arcs, states, words, ids = struct.unpack_from("<4s4q", buffer)
        if magic != _MAGIC:
            raise ValueError("no lexicon")
        at, parts = 36, []
        for n, kind in ((arcs, "<i8"), (arcs, "<i4"), (arcs, "<i4"), (states, "u1"), (words + 1, "<i4"), (ids, "<u4")):
            at += -at % 8
            parts.append(np.frombuffer(buffer, kind, n, at))
            at += parts[-1].nbytes
        self.keys, self.target, self.output, self.final, self.offsets, self.ids = parts
        self.bytes = memoryview(self.ids).cast("B") if ids else memoryview(b"")

    @staticmethod
    def compiled(entries: dict[bytes, list[int]]) -> bytes:
        """The buffer for words and their ids. States with equal futures are one state."""
        words = sorted(w for w in entries if w)
        register: dict[tuple, int] = {}
        final, arcs, count = [], [], []

        def fixed(node: list) -> int:
            """The state of a finished node: [is final, [(byte, state), ...]]."""
            key = (node[0], *node[1])
            state = register.get(key)
            if state is None:
                state = register[key] = len(final)
                final.append(node[0])
                arcs.append(node[1])
                count.append(int(node[0]) + sum(count[s] for _, s in node[1]))
            return state

        path, last = [[False, []]], b""
        for word in [*words, None]:
            shared = 0
            if word is not None:
                while shared < min(len(word), len(last)) and word[shared] == last[shared]:
                    shared += 1
            while len(path) > shared + 1:
                done = path.pop()
                path[-1][1].append((last[len(path) - 1], fixed(done)))
            if word is not None:
                path += [[False, []] for _ in word[shared:]]
                path[-1][0] = True
                last = word
        root = fixed(path[0])
        keys, target, output = [], [], []
        for state, own in enumerate(arcs):
            total = int(final[state])
            for byte, to in own:
                keys.append(state << 8 | byte)
                target.append(to)
                output.append(total)
                total += count[to]
        flat = [i for w in words for i in entries[w]]
        offsets = np.concatenate([[0], np.cumsum([len(entries[w]) for w in words])])
        final_bits = np.array(final, np.uint8)
        final_bits[root] |= 2
        out = bytearray(struct.pack("<4s4q", _MAGIC, len(keys), len(final), len(words), len(flat)))
        for part, kind in ((keys, "<i8"), (target, "<i4"), (output, "<i4"), (final_bits, "u1"), (offsets, "<i4"), (flat, "<u4")):
            out += b"\0" * (-len(out) % 8) + np.asarray(part).astype(kind).tobytes()
        return bytes(out)

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 for those that are not in it: all words walk one arc at a time together."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = np.cumsum(lengths) - lengths
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        root = int(np.flatnonzero(self.final & 2)[0])
        state, rank = np.full(n, root, np.int64), np.zeros(n, np.int64)
        live = np.flatnonzero(lengths > 0)
        rank[lengths == 0] = -1
        step = 0
        while len(live) and len(self.keys):
            key = state[live] << 8 | text[starts[live] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[at] == key
            rank[live[~good]] = -1
            live, at = live[good], at[good]
            rank[live] += self.output[at]
            state[live] = self.target[at]
            step += 1
            ended = lengths[live] == step
            closed = live[ended]
            rank[closed[(self.final[state[closed]] & 1) == 0]] = -1
            live = live[~ended]
        if not len(self.keys):
            rank[:] = -1
        return rank

    def packed(self, words: list[bytes]) -> list[bytes | None]:
        """The ids of each word as bytes, None for those that are not in it."""
        rank = self.ranks(words)
        ids = self.bytes  # slices of the map, no copy of it
        start, end = (4 * self.offsets[np.maximum(rank, 0) + k].astype(np.int64) for k in (0, 1)) if len(self.offsets) > 1 else (rank, rank)
        return [bytes(ids[a:b]) if r >= 0 else None for r, a, b in zip(rank.tolist(), start.tolist(), end.tolist(), strict=True)]


class Encoder:
    """Encodes whole texts with a lexicon, remembering pieces between blanks in two generations: pieces that were not
    met in the time of one generation are forgotten."""

    def __init__(self, bpe: Bpe, lexicon: Lexicon):
        self.bpe, self.lexicon = bpe, lexicon
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces, as bytes."""
        special, mark = self.bpe.special, self.bpe.mark
        odd = [p for p in pieces if mark in p] if special else []
        if odd:
            pieces = [p for p in pieces if mark not in p]
        flat = self.bpe.words(pieces)
        parts = [self._parted(p) for p in odd]
        new = set(flat).union(*parts)
        new.discard("\n")
        words = list(new.difference(special))
        raw = [w.encode() for w in words]
        ids = {w: struct.pack("<I", i) for w, i in special.items()}
        merge = self.bpe.merge
        for w, r, got in zip(words, raw, self.lexicon.packed(raw), strict=True):
            ids[w] = array("I", merge(r)).tobytes() if got is None else got
        young, at = self.young, 0
        for piece in pieces:
            end = flat.index("\n", at)
            young[piece] = ids[flat[at]] if end == at + 1 else b"".join([ids[w] for w in flat[at:end]])
            at = end + 1
        for piece, own in zip(odd, parts, strict=True):
            young[piece] = b"".join([ids[w] for w in own])

    def _parted(self, piece: str) -> list[str]:
        """The words and special tokens of a piece."""
        own, at = [], 0
        for m in self.bpe.split.finditer(piece):
            own += [*self.bpe.words([piece[at : m.start()]])[:-1], m.group()]
            at = m.end()
        return own + self.bpe.words([piece[at:]])[:-1]

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces, learned where they are new."""
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {"": b""}
        young, old, new = self.young, self.old, []
        for p in pieces:
            if p not in young:
                ids = old.get(p)
                if ids is None:
                    new.append(p)
                else:
                    young[p] = ids
        if new:
            self._learn(new)
        return [young[p] for p in pieces]

    def encode(self, text: pa.Array) -> pa.Array:
        """Ids of each text (null: none) as little-endian unsigned 32-bit integers. Python sees every piece of `text` once."""
        lists = pieces_of(text)
        pieces = lists.flatten().dictionary_encode()
        ids = pa.array(self._known(pieces.dictionary.to_pylist()), pa.binary())
        return pc.binary_join(pa.ListArray.from_arrays(_ends(lists), ids.take(pieces.indices)), b"")


def _ends(lists: pa.Array) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())]).astype(np.int32))


def pieces_of(text: pa.Array) -> pa.Array:
    """Texts cut at the tokenizer's blanks; there may be empty pieces. No word and no special token has a blank."""
    text = pc.fill_null(text, "")
    if pc.any(pc.match_substring_regex(text, f"[{''.join(_NO_BLANKS)}]")).as_py():
        return pa.array([_SPLIT.findall(t) for t in text.to_pylist()], pa.list_(pa.string()))
    return pc.utf8_split_whitespace(text)


def frequent_words(docs: DataFrame, bpe: Bpe, most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words, counted over all documents; ties go by the word."""
    sent = docs.sparkSession.sparkContext.broadcast(bpe)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Array] = []

        def flush() -> Iterator[pa.RecordBatch]:
            tally = pa.chunked_array(held, pa.string()).value_counts()
            held.clear()
            flat = pa.array(sent.value.words(tally.field("values").to_pylist()), pa.string())
            parted = pc.equal(flat, "\n").to_numpy(zero_copy_only=False)
            # Every word counts as often as its piece.
            n = tally.field("counts").to_numpy()[(np.cumsum(parted) - parted)[~parted]]
            words = pa.table({"word": flat.filter(pa.array(~parted)), "n": n}).group_by("word").aggregate([("n", "sum")])
            for batch in words.select(["word", "n_sum"]).rename_columns(["word", "n"]).to_batches(max_chunksize=1 << 15):
                yield batch

        for part in slices(batches):
            held.append(pc.utf8_split_whitespace(part.column("body").cast(pa.string())).flatten())
            if sum(map(len, held)) > COUNTED:
                yield from flush()
        if held:
            yield from flush()

    counted = texts(docs).select("body").mapInArrow(count, "word string, n long")
    counted = counted.filter(F.octet_length("word") <= LEXICON_BYTES).groupBy("word").agg(F.sum("n").alias("n"))
    return [r[0] for r in counted.orderBy(F.desc("n"), "word").limit(most).select("word").collect()]


def lexicon_for(docs: DataFrame, bpe: Bpe, most: int = LEXICON_WORDS) -> bytes:
    """The compiled lexicon of the corpus's most frequent words."""
    return Lexicon.compiled({(raw := w.encode()): bpe.merge(raw) for w in frequent_words(docs, bpe, most)})


_BUILT: dict = {}


def _worker(key: str, spec: str, lexicon: bytes) -> Encoder:
    """Built once in a worker, over a memory-mapped file without a name."""
    if key not in _BUILT:
        _BUILT.clear()
        with tempfile.TemporaryFile() as f:
            f.write(lexicon)
            f.flush()
            _BUILT[key] = Encoder(_bpe(spec), Lexicon(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))
    return _BUILT[key]


@lru_cache(1)
def _bpe(spec: str) -> Bpe:
    return Bpe(spec)


def round_trip(docs: DataFrame, tokenizer: str, most: int = LEXICON_WORDS, decode: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit integers) and, if asked for, decoded (text).

    tokenizer: path of the tokenizer file, read on the driver.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    sent = docs.sparkSession.sparkContext.broadcast((spec, lexicon_for(docs, _bpe(spec), most)))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(key, *sent.value)
        for part in slices(batches, most=ENCODED):
            ids = encoder.encode(part.column("body").cast(pa.string()))
            n = pc.cast(pc.divide(pc.binary_length(ids), 4), pa.int64())
            columns = [part.column("doc_id"), n, ids]
            if decode:
                columns.append(encoder.bpe.decode(ids))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary" + ", decoded string" * decode)


def decoded(rows: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text for rows of doc_id and ids."""
    with open(tokenizer, encoding="utf-8") as f:
        sent = rows.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(sent.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), bpe.decode(batch.column("ids"))], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
