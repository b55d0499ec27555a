"""MinHash near-duplicates by bottom-k sketches from one hash function.

1. Every document becomes the set of 64-bit hashes of its distinct word shingles. Documents of equal sets form one
   class, and only its smallest doc_id goes on: copies are never compared.
2. The bottom-k sketch of a class is its k smallest values. The inverted lists are keyed by runs of three neighbouring
   retained values, which keeps stock phrases from filling them. At a similarity of 0.8 no more than a fifth of the
   union differs, so for sets of up to k shingles and a union of six or more such a shared run always exists (sets of
   four and five also give runs of two); for larger sets a pair at exactly 0.8 shares no run with a chance of about
   2e-10.
3. Each list links its members to its smallest member: lists of the same members count once, and give one row a member.
   Links of very different sizes, or whose union-sketch estimate of the similarity is too low to matter, go.
4. What hangs together so far is a neighbourhood. Where a link went, two other members of the list may still be similar to
   each other and not to the smallest: in lists with members of several neighbourhoods all pairs across these are compared
   by their sketches, in tiles, and neighbourhoods that meet become one.
5. Inside each neighbourhood the exact Jaccard similarity of the full sets decides, as matrix products of tiles of at most
   TILE documents; a large neighbourhood is cut into pairs of tiles, so no task gets more than two tiles. Each pair of
   tiles returns the components of its links, and the components of these are the groups.

Defined cases: null, empty and blank texts have no shingles, link with nothing and are their own component. Texts with
fewer words than a shingle are one shingle. Every row gives a row. A doc_id with several different texts is one
document with a row and a set for each of them: it is linked with whatever one of these is linked with (rows without
shingles stand alone even so). Other columns are ignored. Rows with null doc_id are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaffsieve.llm._common import forgotten, mix, rolling, shingle_hashes, slices, texts, word_hashes, written
from chaffsieve.llm.components import components

#: Retained values of a sketch.
SKETCH = 64
#: Links with an estimate below threshold minus this go: over five standard deviations at 64 values.
MARGIN = 0.27
#: Documents and set values in a tile.
TILE, TILE_VALUES = 512, 1 << 20


def _sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    for part in slices(batches):
        bodies = part.column("body").to_pylist()
        words = [(b or b"").lower().split() for b in bodies]
        ends = np.cumsum([len(w) for w in words])
        flat = word_hashes([x for w in words for x in w])
        yield part, [shingle_hashes(flat[e - len(w) : e], size) for w, e in zip(words, ends.tolist(), strict=True)]


def _runs(low: np.ndarray, n: int) -> np.ndarray:
    """Keys of the inverted lists: runs of three retained values, and of two for sets of four and five."""
    keys = [rolling(low, 3)]
    if n in (4, 5):
        keys.append(rolling(low, 2))
    return np.unique(np.concatenate(keys))


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n (set size), sig_a and sig_b (128 bits of the set), low (sketch), runs (keys)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, size):
            n, a, b, low, runs = [], [], [], [], []
            for values in sets:
                ranked = np.unique(values)
                n.append(len(ranked))
                a.append(mix(ranked).sum(dtype=np.uint64).astype(np.int64))
                b.append(mix(ranked ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64).astype(np.int64))
                low.append(ranked[:SKETCH].tobytes())
                runs.append(_runs(ranked[:SKETCH], len(ranked)).view(np.int64))
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(a, np.int64)),
                    pa.array(np.array(b, np.int64)),
                    pa.array(low, pa.binary()),
                    pa.ListArray.from_arrays(offsets, np.concatenate(runs) if runs else np.empty(0, np.int64)),
                ],
                names=["doc_id", "n", "sig_a", "sig_b", "low", "runs"],
            )

    return docs.mapInArrow(sketch, "doc_id long, n long, sig_a long, sig_b long, low binary, runs array<long>")


def estimate(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity from two bottom-k sketches: the share of common values among the bottom of their union."""
    union = np.union1d(a, b)[: max(1, min(SKETCH, max(len(a), len(b))))]
    return len(np.intersect1d(np.intersect1d(a, b, True), union, True)) / max(1, len(union))


def _estimated(links: DataFrame, low: DataFrame, least: float) -> DataFrame:
    """a, b and near (whether the estimate reaches `least`)."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("low_a").to_pylist(), batch.column("low_b").to_pylist(), strict=True)
            good = [estimate(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) >= least for a, b in pairs]
            yield pa.RecordBatch.from_arrays(
                [batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], names=["a", "b", "near"]
            )

    return (
        links.join(low.select(F.col("doc_id").alias("a"), F.col("low").alias("low_a")), "a")
        .join(low.select(F.col("doc_id").alias("b"), F.col("low").alias("low_b")), "b")
        .mapInArrow(keep, "a long, b long, near boolean")
    )


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all pairs."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    value, column = np.unique(flat, return_inverse=True)
    shared = np.bincount(column) > 1
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(shared.sum()), 4096):
        here = (column >= start) & (column < start + 4096)
        grid = np.zeros((len(sets), 4096), np.float32)
        grid[owner[here], column[here] - start] = 1
        common += grid @ grid.T
    return common.astype(np.int64)


def _alike(sets: list[np.ndarray], threshold: tuple[int, int]) -> np.ndarray:
    """The pairs with enough in common, by exact set sizes and intersections."""
    sizes, both = np.array([len(s) for s in sets], np.int64), _common(sets)
    return threshold[1] * both >= threshold[0] * (sizes[:, None] + sizes[None, :] - both)


def _maybe_alike(low: list[np.ndarray], n: np.ndarray, threshold: tuple[int, int], least: float) -> np.ndarray:
    """The pairs that their sketches do not rule out: exact where both are whole sets, else no estimate that `estimate`
    lets pass is lost."""
    held, both = np.array([len(s) for s in low], np.int64), _common(low)
    whole = np.maximum(n[:, None], n[None, :]) <= SKETCH
    exact = threshold[1] * both >= threshold[0] * (held[:, None] + held[None, :] - both)
    sized = threshold[1] * np.minimum(n[:, None], n[None, :]) >= threshold[0] * np.maximum(n[:, None], n[None, :])
    return np.where(whole, exact, sized & (both >= least * np.maximum(held[:, None], held[None, :])))


def _forest(ids: np.ndarray, linked: np.ndarray, sides: np.ndarray | None) -> list:
    """The components of the linked pairs, each as pairs of its smallest id and every other one.

    sides: 0 or 1 for each document; with both present, only pairs across are looked at.
    """
    if sides is not None:
        linked &= sides[:, None] != sides[None, :]
    edges, seen = [], np.zeros(len(ids), bool)
    linked |= linked.T
    for start in np.argsort(ids, kind="stable").tolist():
        if seen[start]:
            continue
        seen[start], todo = True, [start]
        while todo:
            new = np.flatnonzero(linked[todo.pop()] & ~seen).tolist()
            seen[new] = True
            todo += new
            edges += [(int(ids[start]), int(ids[j])) for j in new]
    return edges


def _dealt(rows: DataFrame, *keep: str) -> DataFrame:
    """Rows of area, tiles and doc_id dealt to the pairs (p, q) of tiles of their area, and the side they are on.

    Each document of tile t goes to the pairs (t, x) of tiles, x from 0 up; a single tile is one pair with itself."""
    tile = F.pmod(F.xxhash64("doc_id"), F.col("tiles")).cast("int")
    return (
        rows.withColumn("tile", tile)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .select(
            "area",
            F.least("tile", "other").alias("p"),
            F.greatest("tile", "other").alias("q"),
            (F.col("tile") > F.col("other")).alias("side"),
            *keep,
        )
    )


def _among(rest: DataFrame, known: DataFrame, threshold: tuple[int, int], least: float) -> DataFrame:
    """Links (a, b) between the neighbourhoods (near) of any two members of the lists (area, m, doc_id, near), as far as
    sketches can tell. Members of one neighbourhood need no link."""
    rows = rest.withColumn("tiles", F.ceil(F.col("m") / F.lit(TILE)).cast("int"))
    dealt = _dealt(rows.join(known.select("doc_id", "n", "low"), "doc_id"), "near", "n", "low")

    def link(key: tuple, group: pa.Table) -> pa.Table:
        near, at = np.unique(group.column("near").to_numpy(), return_inverse=True)
        low = [np.frombuffer(x, np.uint64) for x in group.column("low").to_pylist()]
        linked = _maybe_alike(low, group.column("n").to_numpy(), threshold, least)
        if key[1].as_py() != key[2].as_py():
            side = group.column("side").to_numpy(zero_copy_only=False).astype(bool)
            linked &= side[:, None] != side[None, :]
        met = np.zeros((len(near), len(near)), bool)
        i, j = np.nonzero(linked)
        met[at[i], at[j]] = True
        edges = _forest(near, met, None)
        return pa.table(
            {"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())}
        )

    return dealt.groupBy("area", "p", "q").applyInArrow(link, "a long, b long")


def _verified(docs: DataFrame, known: DataFrame, near: DataFrame, size: int, threshold: tuple[int, int]) -> DataFrame:
    """Exact links (a, b) within the neighbourhoods (id, component)."""
    near = near.select(F.col("id").alias("doc_id"), F.col("component").alias("area"))
    areas = near.join(known.select("doc_id", "n"), "doc_id").groupBy("area").agg(
        F.greatest(F.ceil(F.count("*") / F.lit(TILE)), F.ceil(F.sum("n") / F.lit(TILE_VALUES))).cast("int").alias("tiles")
    )
    small = near.join(written(areas, "areas"), "area")
    dealt = _dealt(docs.join(small, "doc_id"), "doc_id", "body")

    def link(key: tuple, group: pa.Table) -> pa.Table:
        bodies, ids = group.column("body").to_pylist(), group.column("doc_id").to_numpy()
        sets = [np.unique(shingle_hashes(word_hashes((b or b"").lower().split()), size)) for b in bodies]
        side = group.column("side").to_numpy(zero_copy_only=False).astype(bool)
        edges = _forest(ids, _alike(sets, threshold), side if key[1].as_py() != key[2].as_py() else None)
        return pa.table(
            {"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())}
        )

    return dealt.groupBy("area", "p", "q").applyInArrow(link, "a long, b long")


def _several(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between the smallest members of the classes that a doc_id with several texts is in."""
    texts_of = known.filter("n > 0").groupBy("doc_id").agg(F.count_distinct("n", "sig_a", "sig_b").alias("m")).filter("m > 1")
    own = known.select("doc_id", "n", "sig_a", "sig_b").join(texts_of.select("doc_id"), "doc_id")
    own = own.withColumnRenamed("doc_id", "a").join(classes.withColumnRenamed("doc_id", "b"), ["n", "sig_a", "sig_b"])
    return own.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, size: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept. threshold: the least similarity
    as a ratio of whole numbers. Needs the columns doc_id and text."""
    docs = texts(docs).filter("doc_id is not null")
    known = written(sketches(docs, size), "sketches")
    classes = written(
        known.filter("n > 0").groupBy("n", "sig_a", "sig_b").agg(F.min("doc_id").alias("doc_id")), "classes"
    )
    heads = known.join(classes.select("doc_id"), "doc_id", "left_semi")
    listed = heads.select("doc_id", "n", F.explode("runs").alias("run"))
    centre = (
        listed.groupBy("run")
        .agg(
            F.min("doc_id").alias("b"),
            F.min_by("n", "doc_id").alias("n_b"),
            F.count("*").alias("m"),
            F.bit_xor(F.xxhash64("doc_id")).alias("who"),
        )
        .filter("m > 1")
    )
    least = threshold[0] / threshold[1] - MARGIN
    # Of the lists with the same members one is enough.
    members = written(
        listed.join(centre, "run")
        .filter(F.col("doc_id") != F.col("b"))
        .groupBy(F.xxhash64("b", "m", "who").alias("area"), F.col("doc_id").alias("a"), "b")
        .agg(F.first("m").alias("m"), F.first(F.least("n", "n_b") >= least * F.greatest("n", "n_b")).alias("sized")),
        "members",
    )
    stars = members.groupBy("a", "b").agg(F.first("sized").alias("sized"))
    low = known.select("doc_id", "low")
    judged = written(_estimated(stars.filter("sized").select("a", "b"), low, least), "judged")
    first = written(components(judged.filter("near").select("a", "b")), "first")
    # In a list of two the one pair has been looked at; a list within one neighbourhood has no more to say.
    placed = members.filter("m > 2").join(first.withColumnRenamed("id", "a"), "a", "left")
    placed = written(placed.select("area", "m", F.col("a").alias("doc_id"), F.coalesce("component", "a").alias("near")), "placed")
    mixed = placed.groupBy("area").agg(F.min("near").alias("low"), F.max("near").alias("high")).filter("low <> high")
    # Written: else the join is on an aggregate's key, and adaptive execution leaves a long list in one task.
    mixed = written(mixed.select("area"), "mixed")
    links = first.select(F.col("id").alias("a"), F.col("component").alias("b"))
    near = written(components(links.unionByName(_among(placed.join(mixed, "area"), known, threshold, least))), "near")
    exact = components(_verified(docs, known, near, size, threshold).unionByName(_several(known, classes)))
    exact = written(exact, "exact")
    for spent in (members, judged, first, placed, mixed, near):
        forgotten(spent)
    found = classes.join(exact.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "n", "sig_a", "sig_b", F.coalesce("component", "doc_id").alias("component_id")
    )
    out = known.select("doc_id", "n", "sig_a", "sig_b").join(found, ["n", "sig_a", "sig_b"], "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
        (F.col("doc_id") == F.coalesce("component_id", "doc_id")).alias("kept"),
    )
