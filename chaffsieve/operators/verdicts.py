"""Page and snippet verdicts, final cleanup and the chains of the three modes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chaffsieve.functions import decisions as D
from chaffsieve.functions import text as T
from chaffsieve.functions.regions import without_code
from chaffsieve.operators import coverage
from chaffsieve.operators.work_table import drop_empty

KEY = ["request_id", "source_index"]


def page_verdicts(sources: DataFrame, pages: DataFrame, t: D.Thresholds = D.Thresholds()) -> DataFrame:  # noqa: B008
    """Kept sources with an answered request: verdict, reason, near_gap and fail_kind. An unusable answer keeps the
    source and is a validation failure. pages: request_id, source_index, status, page_probability."""
    p, cut = F.col("page_probability"), F.lit(t.page_drop)
    asked = (F.col("verdict") == "keep") & (F.col("status") == "answered")
    good = F.coalesce(D.usable(p), F.lit(False))
    drops = asked & good & D.page_drops(p, cut)
    return sources.join(pages, KEY, "left").withColumns(
        {
            "fail_kind": F.when(asked & ~good, F.lit("validation")),
            "page_verdict": F.when(asked, F.when(drops, F.lit("drop")).otherwise(F.lit("keep"))),
            "near_gap": F.when(asked & good, D.page_gap(p, cut)),
            "reason": F.when(drops, F.lit("filler")).otherwise(F.col("reason")),
            "verdict": F.when(drops, F.lit("drop")).otherwise(F.col("verdict")),
        }
    )


def snippet_verdicts(rows: DataFrame, t: D.Thresholds = D.Thresholds()) -> DataFrame:  # noqa: B008
    """Judged snippets of kept, answered sources (active) with kept, reason and near_gap. Null judgments keep."""
    p, cut = F.col("keep_probability"), D.keep_threshold(F.col("group_size"), t)
    drops = F.coalesce(F.col("active") & D.snippet_drops(p, cut), F.lit(False))
    return rows.withColumns(
        {
            "near_gap": F.when(F.col("active"), D.snippet_gap(p, cut)),
            "reason": F.when(drops, F.lit("keep_probability")).otherwise(F.col("reason")),
            "kept": F.col("kept") & ~drops,
        }
    )


def cleanup_eligible(sources: DataFrame, judged: DataFrame) -> DataFrame:
    """Sources of which every judgment is valid, before snippet verdicts: (request_id, source_index)."""
    p = F.col("keep_probability")
    whole = judged.groupBy(*KEY).agg(
        F.bool_and(F.coalesce(D.usable(p), F.lit(False)) & (F.col("answer_state") == "ok")).alias("whole")
    )
    fine = sources.filter("verdict = 'keep' and page_verdict = 'keep' and fail_kind is null")
    return fine.select(*KEY).join(whole.filter("whole"), KEY).select(*KEY)


def final_cleanup(rows: DataFrame, eligible: DataFrame) -> DataFrame:
    """Kept snippets of eligible sources that are empty takeaways (boilerplate) or covered (dup), with covered_by.

    rows: snippet rows with position and title. Texts that hold code are left alone."""
    mine = rows.filter("kept").join(eligible, KEY, "left_semi").select(*KEY, "position", "text", "title")
    fit = without_code(mine)
    bare = T.is_empty_takeaways(F.col("text"), F.col("title"))
    gone = coverage.covered(fit.filter(~bare)).select(*KEY, "position", "covered_by").withColumn("final", F.lit("same_source_exact_coverage"))
    empty = fit.filter(bare).select(*KEY, "position", F.lit(None).cast("long").alias("covered_by"), F.lit("empty_takeaways").alias("final"))
    out = rows.join(gone.unionByName(empty), [*KEY, "position"], "left")
    return out.withColumns(
        {
            "reason": F.when(F.col("final") == "empty_takeaways", F.lit("boilerplate"))
            .when(F.col("final").isNotNull(), F.lit("dup"))
            .otherwise(F.col("reason")),
            "kept": F.col("kept") & F.col("final").isNull(),
        }
    )


def finished(sources: DataFrame, snippets: DataFrame) -> DataFrame:
    """Last stage of every mode: kept sources without kept snippets are dropped as empty."""
    return drop_empty(sources, snippets)
