"""Code and quotation regions of texts, as strings of 0 and 1 over their lines.

A text without marks that could open a region is answered by a column expression; the others go through Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaffsieve.functions import lines as L
from chaffsieve.functions import text as T


def _bits(flags: list[bool]) -> str:
    return "".join("1" if f else "0" for f in flags)


def without_code(rows: DataFrame) -> DataFrame:
    """The rows whose text holds no code, all columns kept. Only texts with marks of code take the exact pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not L.has_code(t) for t in batch.column("text").to_pylist()], pa.bool_()))

    marked = T.may_hold_code(F.col("text"))
    return rows.filter(~marked).unionByName(rows.filter(marked).mapInArrow(run, rows.schema))


def line_flags(rows: DataFrame, key: str) -> DataFrame:
    """`key`, code and quoted for rows of `key` and text; null counts as the empty text, which is one line."""
    rows = rows.select(key, F.coalesce("text", F.lit("")).alias("text"))
    marked = T.may_hold_code(F.col("text")) | F.col("text").rlike("(?m)^ {0,3}>")
    zeros = F.regexp_replace(F.regexp_replace("text", "[^\n]", ""), "\n", "0")
    plain = rows.filter(~marked).select(key, F.concat(zeros, F.lit("0")).alias("code"), F.concat(zeros, F.lit("0")).alias("quoted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, quoted = [], []
            for text in batch.column("text").to_pylist():
                lines = L.split_lines(text)
                flags = L.code_flags(lines)
                code.append(_bits(flags))
                quoted.append(_bits(L.quote_flags(lines, flags)))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(code, pa.string()), pa.array(quoted, pa.string())], names=[key, "code", "quoted"])

    kind = dict(rows.dtypes)[key]
    return plain.unionByName(rows.filter(marked).mapInArrow(run, f"{key} {kind}, code string, quoted string"))
