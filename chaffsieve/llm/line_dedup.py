"""Line dedup by overlapping windows of three lines, in DataFrame functions only.

Every three neighbouring lines are hashed to 128 bits. The first occurrence of a window in the order (doc_id, line)
stays, later ones cover their three lines, and all covered lines go. A removed line always has a surviving copy: its
window stands earlier, and so on back to the first.

The smallest occurrence of each window is an aggregate with partial sums, and windows meet it in a join that adaptive
execution can split, so a window that a third of all documents share is never gathered. Only arrays of one document's
windows are.

Defined cases: lines are what stands between line feeds; windows of blank lines only do not count; documents of fewer
than three lines, null texts and rows with null doc_id stay as they are; rows of equal doc_id and text count as one
document and keep the same lines; different texts of one doc_id are documents in the order of a hash of the text; all other
columns are kept unless they are named like the internal ones (_dd_...); `marked` replaces columns n_lines and removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = "second half"


def _windows(docs: DataFrame) -> DataFrame:
    """_dd_id, _dd_text (hash), pos, a, b: a row for each window."""
    hashed = F.expr(
        f"""transform(sequence(0, size(_dd_lines) - 3), i -> named_struct(
          'pos', i,
          'blank', concat(_dd_lines[i], _dd_lines[i + 1], _dd_lines[i + 2]) not rlike '[^ \\\\t-\\\\r]',
          'a', xxhash64(_dd_lines[i], _dd_lines[i + 1], _dd_lines[i + 2]),
          'b', xxhash64('{SEED}', _dd_lines[i], _dd_lines[i + 1], _dd_lines[i + 2])))"""
    )
    lines = docs.select(
        F.col("doc_id").alias("_dd_id"), F.xxhash64("text").alias("_dd_text"), F.split("text", "\n").alias("_dd_lines")
    ).filter("_dd_id is not null and size(_dd_lines) >= 3")
    return lines.select("_dd_id", "_dd_text", F.inline(hashed)).filter("not blank").drop("blank")


def later_windows(docs: DataFrame) -> DataFrame:
    """_dd_id, _dd_text, _dd_later: for documents with a later occurrence, the starting lines of such, sorted."""
    windows = _windows(docs)
    first = (
        windows.groupBy("a", "b")
        .agg(F.min(F.struct("_dd_id", "_dd_text", "pos")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("a", "b", "first")
    )
    later = windows.join(first, ["a", "b"]).filter("_dd_id <> first._dd_id or _dd_text <> first._dd_text or pos <> first.pos")
    return later.groupBy("_dd_id", "_dd_text").agg(F.array_sort(F.collect_set("pos")).alias("_dd_later"))


def marked(docs: DataFrame) -> DataFrame:
    """The documents with n_lines and removed (sorted numbers of removed lines); text is what is left."""
    return _marked(docs).select(
        *[c for c in docs.columns if c not in ("text", "n_lines", "removed")],
        F.coalesce(F.size("_dd_lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce("_dd_gone", F.array().cast("array<int>")).alias("removed"),
        _rest().alias("text"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with the lines of later windows taken out; those with nothing left go."""
    out = _marked(docs).withColumn("text", _rest())
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = F.when(F.col("_dd_gone").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed)
    return out.filter("_dd_gone is null or text rlike '[^ \\\\t-\\\\r]'").select(docs.columns)


def _marked(docs: DataFrame) -> DataFrame:
    later = later_windows(docs)
    out = docs.withColumns({"_dd_key": F.xxhash64("text"), "_dd_lines": F.split("text", "\n")}).join(
        later, (F.col("doc_id") == F.col("_dd_id")) & (F.col("_dd_key") == F.col("_dd_text")), "left"
    )
    # Sorted starts give sorted runs: each adds the lines that the one before has not covered.
    covered = F.expr(
        """flatten(transform(_dd_later, (s, i) ->
          sequence(greatest(s, coalesce(get(_dd_later, i - 1) + 3, s)), s + 2)))"""
    )
    return out.withColumn("_dd_gone", covered)


def _rest():
    """The lines that are not covered, each found through its neighbours in the sorted list of removed lines."""
    left = F.expr(
        """flatten(transform(concat(array(-1), _dd_gone), (x, i) ->
          slice(_dd_lines, x + 2, coalesce(get(_dd_gone, i), size(_dd_lines)) - x - 1)))"""
    )
    return F.when(F.col("_dd_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
