"""Threshold decisions, option labels and identities as column functions. Probabilities are doubles throughout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest distance at which a near miss still drops, and the slack for its comparison.
NEAR_GAP = 0.02
SLACK = 8 * 2.0**-52
GROUP_SIZE = 3
SUM_TOLERANCE = 0.06


@dataclass(frozen=True)
class Thresholds:
    """Defaults of the page, group and single-snippet thresholds."""

    page_drop: float = 0.77
    group_keep: float = 0.25
    single_keep: float = 0.35


def usable(p: Column) -> Column:
    """A finite number in [0, 1]; null for null."""
    return ~F.isnan(p) & p.between(0.0, 1.0)


def _near(gap: Column, threshold: Column) -> Column:
    return (threshold > 0) & (threshold < 1) & (gap <= NEAR_GAP + SLACK)


def page_drops(p: Column, threshold: Column) -> Column:
    return (p >= threshold) | _near(threshold - p, threshold)


def page_gap(p: Column, threshold: Column) -> Column:
    """Distance of a near miss, null for any other decision."""
    gap = threshold - p
    return F.when((p < threshold) & _near(gap, threshold), F.least(gap, F.lit(NEAR_GAP)))


def snippet_drops(p: Column, threshold: Column) -> Column:
    return (p < threshold) | _near(p - threshold, threshold)


def snippet_gap(p: Column, threshold: Column) -> Column:
    gap = p - threshold
    return F.when((p >= threshold) & _near(gap, threshold), F.least(gap, F.lit(NEAR_GAP)))


def keep_threshold(size: Column, t: Thresholds) -> Column:
    return F.when(size >= 2, F.lit(t.group_keep)).otherwise(F.lit(t.single_keep))


def option_labels(size: Column) -> Column:
    """Labels of all subsets of the first `size` letters, in the order of their bit masks; the empty one is none."""
    letter = lambda mask, k, c: F.when(F.shiftright(mask, k) % 2 == 1, F.lit(c)).otherwise(F.lit(""))
    masks = F.sequence(F.lit(0), F.shiftleft(F.lit(1), 3) - 1)
    labels = F.transform(masks, lambda m: F.concat(letter(m, 0, "A"), letter(m, 1, "B"), letter(m, 2, "C")))
    named = F.transform(labels, lambda x: F.when(x == "", F.lit("none")).otherwise(x))
    return F.slice(named, F.lit(1), F.pow(F.lit(2), size).cast("int"))


def source_id(source_index: Column) -> Column:
    return F.concat(F.lit("s"), source_index.cast("string"))


def snippet_key(index: Column, part: Column) -> Column:
    return F.concat_ws(".", index.cast("string"), part.cast("string"))


def global_key(source: Column, local: Column) -> Column:
    return F.concat(source, F.lit("__"), local)


def page_instructions(source: Column) -> Column:
    return F.concat(F.lit("No snippet of source "), source, F.lit(" helps to answer the intent."))


def group_instructions(source: Column, start: Column, size: Column) -> Column:
    """The letters with the snippets that they stand for, and what to keep."""
    refs = F.transform(
        F.sequence(F.lit(0), size - 1),
        lambda k: F.concat(F.substring(F.lit("ABC"), k + 1, F.lit(1)), F.lit("="), source, F.lit("["), (start + k).cast("string"), F.lit("]")),
    )
    rule = F.when(size == 1, F.lit("Keep A if it holds information specific to the intent.")).otherwise(
        F.lit("Select exactly the letters that hold information specific to the intent, or none.")
    )
    return F.concat(F.array_join(refs, "; "), F.lit(". "), rule)


def question_set_id() -> Column:
    """Identity of the questions: all texts, with a first source and position, and the options of each size, as one JSON
    list, hashed. Thresholds are no part of it."""
    source, sizes = F.lit("s0"), [F.lit(n) for n in range(1, GROUP_SIZE + 1)]
    texts = [page_instructions(source), *(group_instructions(source, F.lit(0), n) for n in sizes)]
    said = F.to_json(F.array(*texts))
    options = F.to_json(F.array(*(option_labels(n) for n in sizes)))
    inner = lambda c: F.substring(c, F.lit(2), F.length(c) - 2)
    return F.substring(F.sha2(F.concat(F.lit("["), inner(said), F.lit(","), inner(options), F.lit("]")), 256), 1, 12)


def answer_state(probabilities: Column, size: Column) -> Column:
    """missing, labels, sum or ok for a choice answer (map from label to probability)."""
    expected = option_labels(size)
    same = (F.size(probabilities) == F.size(expected)) & F.forall(
        expected, lambda k: F.coalesce(F.map_contains_key(probabilities, k), F.lit(False))
    )
    total = F.aggregate(F.map_values(probabilities), F.lit(0.0), lambda a, b: a + b)
    return (
        F.when(probabilities.isNull(), F.lit("missing"))
        .when(~same, F.lit("labels"))
        .when(F.abs(total - 1) < SUM_TOLERANCE, F.lit("ok"))
        .otherwise(F.lit("sum"))
    )


def marginal(probabilities: Column, letter: Column) -> Column:
    """Sum over the labels that contain the letter."""
    return F.aggregate(
        F.map_entries(probabilities),
        F.lit(0.0),
        lambda a, e: a + F.when(F.contains(e["key"], letter), e["value"]).otherwise(F.lit(0.0)),
    )


def backoff_ms(attempt: Column, random: Column) -> Column:
    return F.least(F.lit(500.0) * F.pow(F.lit(2.0), attempt - 1), F.lit(5000.0)) * (1 - 0.25 * random)


def retry_after_ms(header: Column) -> Column:
    """Seconds as a number that is not negative, in milliseconds; null for anything else."""
    seconds = F.when(F.trim(header).rlike(r"^[0-9]+(\.[0-9]+)?$"), F.trim(header)).cast("double")
    return seconds * 1000


def status_outcome(status: Column) -> Column:
    """Failure kind and whether another attempt may help; null for success."""
    kind = lambda k, again: F.struct(F.lit(k).alias("kind"), F.lit(again).alias("retryable"))
    return (
        F.when(status == 200, F.lit(None))
        .when(status.isin(401, 403), kind("auth", False))
        .when(status == 429, kind("rate_limited", False))
        .when((status == 408) | (status == 529) | (status >= 500), kind("http", True))
        .otherwise(kind("http", False))
    )
