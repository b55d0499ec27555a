"""Same-source coverage: a snippet goes if a longer one of its source (or an equal one before it) contains it whole.

Containment at word bounds is transitive, so the first container in the order (length down, position up) is the one
that a pass over this order would keep; the operator needs no order of processing.

A source is one row of its texts in this order, and each text is looked for in those before it, as one string. Sources of
more than MANY snippets are never gathered: there candidates meet through words. A container has every word of what it
contains, and so the rarest one; each candidate asks for its rarest word in the source, and only snippets with this word
are compared. Both ways give the same rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaffsieve.functions import text as T
from chaffsieve.functions.lines import units

LEAST_UNITS = 40
#: Snippets of a source that are looked at as one row.
MANY = 4096
WORD = r"[\p{L}\p{N}_]"
KEY = ["request_id", "source_index"]


def covered(snippets: DataFrame) -> DataFrame:
    """request_id, source_index, position, covered_by (position) for what goes. Needs text and position; snippets with
    code must have been left out."""
    rows = snippets.select(*KEY, "position", "text")
    large = rows.groupBy(*KEY).agg(F.count("*").alias("n")).filter(F.col("n") > MANY).select(*KEY)
    few = _gathered(rows.join(large, KEY, "left_anti"))
    return few.unionByName(_joined(_prose(rows.join(large, KEY, "left_semi"))))


def _prose(rows: DataFrame) -> DataFrame:
    prose = rows.select(*KEY, F.col("position").cast("long").alias("position"), T.normalized_prose(F.col("text")).alias("prose"))
    return prose.withColumn("units", T.utf16_length(F.col("prose"))).filter(F.col("units") >= LEAST_UNITS)


def _bounded(text: str, start: int, end: int) -> bool:
    """Whether no word character stands on either side."""

    def is_word(c: str) -> bool:
        return c == "_" or unicodedata.category(c)[0] in "LN"

    return not (start and is_word(text[start - 1])) and not (end < len(text) and is_word(text[end]))


def containers(texts: list[str]) -> list[tuple[int, int]]:
    """(contained, container) as numbers of the texts, longest first; of several containers the first. The texts hold no
    line feed."""
    whole, ends, out = "\n".join(texts), [], []
    at = 0
    for i, t in enumerate(texts):
        place = whole.find(t, 0, max(0, at - 1))
        while place >= 0 and not _bounded(whole, place, place + len(t)):
            place = whole.find(t, place + 1, at - 1)
        if place >= 0:
            out.append((i, next(k for k, end in enumerate(ends) if place < end)))
        at += len(t) + 1
        ends.append(at)
    return out


def _gathered(rows: DataFrame) -> DataFrame:
    sources = rows.groupBy(*KEY).agg(F.collect_list(F.struct(F.col("position").cast("long").alias("position"), "text")).alias("s"))
    sources = sources.filter("size(s) > 1").select(
        *KEY, F.transform("s", lambda x: x["position"]).alias("at"), F.transform("s", lambda x: T.normalized_prose(x["text"])).alias("prose")
    )
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, inner, outer = [], [], []
            for k, (at, prose) in enumerate(zip(batch.column("at").to_pylist(), batch.column("prose").to_pylist(), strict=True)):
                ranked = sorted((-units(t), p, t) for p, t in zip(at, prose, strict=True) if t is not None)
                ranked = [x for x in ranked if -x[0] >= LEAST_UNITS]
                for i, j in containers([t for _, _, t in ranked]):
                    row.append(k)
                    inner.append(ranked[i][1])
                    outer.append(ranked[j][1])
            own = [batch.column(c).take(pa.array(row, pa.int64())) for c in KEY]
            yield pa.RecordBatch.from_arrays([*own, pa.array(inner, pa.int64()), pa.array(outer, pa.int64())], names=[*KEY, "position", "covered_by"])

    return sources.mapInArrow(run, f"request_id {kinds['request_id']}, source_index {kinds['source_index']}, position long, covered_by long")


def _joined(prose: DataFrame) -> DataFrame:
    words = prose.select(
        *KEY, "position", "units",
        F.explode(F.array_union(F.regexp_extract_all("prose", F.lit(rf"{WORD}+"), F.lit(0)), F.array(F.lit("")))).alias("word"),
    )
    spread = words.groupBy(*KEY, "word").agg(F.count("*").alias("n")).filter("n > 1")
    # The empty word stands for texts without any word character; a word of one snippet says that nothing contains it.
    rare = (
        words.join(spread, [*KEY, "word"], "left")
        .groupBy(*KEY, "position", "units")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(1)).alias("n"), "word")).alias("rarest"))
        .filter("rarest.n > 1")
        .select(*KEY, F.col("position").alias("inner_position"), F.col("units").alias("inner_units"), F.col("rarest.word").alias("word"))
    )
    first = (F.col("units") > F.col("inner_units")) | (
        (F.col("units") == F.col("inner_units")) & (F.col("position") < F.col("inner_position"))
    )
    # Texts join only what is left of the pairs.
    pairs = rare.join(words, [*KEY, "word"]).filter(first).drop("word", "inner_units", "units")
    inner = prose.select(*KEY, F.col("position").alias("inner_position"), F.col("prose").alias("inner_prose"))
    pairs = pairs.join(inner, [*KEY, "inner_position"]).join(prose, [*KEY, "position"])
    whole = F.concat(F.lit(rf"(^|[^\p{{L}}\p{{N}}_])\Q"), F.replace("inner_prose", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E([^\p{L}\p{N}_]|\z)"))
    hit = pairs.filter(F.contains("prose", F.col("inner_prose")) & F.regexp(F.col("prose"), whole))
    return (
        hit.groupBy(*KEY, F.col("inner_position").alias("position"))
        .agg(F.min_by("position", F.struct(-F.col("units"), F.col("position"))).alias("covered_by"))
    )
