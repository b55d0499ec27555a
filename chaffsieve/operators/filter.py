"""The whole filter over a table of search responses, in its three modes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaffsieve.functions import decisions as D
from chaffsieve.operators import classifier, local_rules, verdicts
from chaffsieve.sources.scratch import written

KEY = ["request_id", "source_index"]


@dataclass(frozen=True)
class Filtered:
    """Sources with verdicts, snippets with marks, and the questions that were asked (None without a classifier)."""

    sources: DataFrame
    snippets: DataFrame
    questions: DataFrame | None


def run(
    sources: DataFrame,
    mode: str = "on",
    answers: DataFrame | Callable[[DataFrame, DataFrame], DataFrame] | None = None,
    thresholds: D.Thresholds = D.Thresholds(),  # noqa: B008
) -> Filtered:
    """Mode off: local rules without page cleaners, no verdicts. Modes on and test: cleaners, then verdicts from the
    recorded answers (request_id, global_key, type, noul, probabilities), or from those that a function of the tiles and
    the questions gets; without answers only the local chain.

    A source whose request has no answer at all was not answered and is kept as it is."""
    if mode not in ("off", "on", "test"):
        raise ValueError(f"unknown mode {mode!r}")
    marked = sources.withColumns({"verdict": F.lit("keep"), "reason": F.lit(None).cast("string")})
    rows = local_rules.applied(sources, platforms=mode != "off")
    if mode == "off" or answers is None:
        return Filtered(verdicts.finished(marked, rows), rows, None)
    rows = written(rows, "rules")
    tiles = written(classifier.tiled(classifier.candidates(marked, rows)), "tiles")
    asked = classifier.questions(tiles)
    if callable(answers):
        answers = answers(tiles, asked)
    got = classifier.answered(asked, answers)
    replied = answers.select("request_id").distinct().withColumn("status", F.lit("answered"))
    pages = classifier.page_answers(got).join(replied, "request_id", "left").withColumn("status", F.coalesce("status", F.lit("failed")))
    judged_sources = verdicts.page_verdicts(marked, pages, thresholds)
    judged = written(classifier.judged_snippets(tiles, got), "judged")
    eligible = verdicts.cleanup_eligible(judged_sources, judged)
    active = judged_sources.select(*KEY, ((F.col("verdict") == "keep") & (F.col("status") == "answered")).alias("active"))
    decided = written(verdicts.snippet_verdicts(judged.join(active, KEY), thresholds), "decided")
    final = verdicts.final_cleanup(decided, eligible)
    shared = ["request_id", "source_index", "url", "title", "index", "part", "text", "kept", "reason", "route", "actions"]
    # What was dropped before has no judgment; both together are all rows.
    before = rows.filter("not kept").select(*shared)
    whole = before.unionByName(final.select(*shared, "near_gap", "covered_by"), allowMissingColumns=True)
    return Filtered(verdicts.finished(judged_sources, whole), whole, asked)
