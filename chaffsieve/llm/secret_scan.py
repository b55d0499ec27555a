"""Secret scan: fixed patterns, and a battery of randomness tests with false-discovery control, in DataFrame functions.

Places of a pattern come from what `split` leaves between the matches: the start of a match is the length of all gaps
and matches before it, a running sum over a document's matches. The matches, a few rows a document, are written once.

The battery looks at runs of 20 and more token characters. The encoding of each is inferred (hexadecimal, base32,
letters and digits, base64 in either alphabet), and three tests are taken over its symbols, each with the p-value of an
ordinary token (a word, a name, a number, a path) looking at least as random as this one:
  * chi-squared uniformity: the statistic is a function of the number of pairs of equal symbols. In ordinary tokens these
    are at least the share that the encoding's row says; fewer have the lower tail of a Poisson;
  * runs of one character class (lower, upper, digit, other): in ordinary tokens the class changes between neighbours with
    at most the share that the row says; more have the upper tail of a binomial;
  * serial correlation of the symbol codes at lag one, about the middle of the alphabet: at least SERIAL in sequences,
    repeated and sorted symbols; less has a normal tail, by Fisher's z.
Tails are summed, or bounded by Chernoff's bound for tokens so long that the sum would be far below any cut.
A token is random only if it is so in all three, so the p-value of the battery is the largest of the three (an
intersection-union test). Long tokens have more power than short ones: Benjamini-Hochberg control at level FDR is taken
within length classes, over the tokens of all documents, from a histogram of p-values whose size is fixed.

Defined cases: null and empty texts have no spans; rows of equal doc_id and text are one document to the histogram and
each get a row; rows with null doc_id are scanned like others; other columns are ignored; tokens of no encoding (such as
paths with underscores) and of padding only are never random.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from chaffsieve.llm._common import written

#: Fixed patterns, in the order in which spans of equal start are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
TOKEN = r"[A-Za-z0-9+/_=-]+"
KINDS = ("assign", "access", "hex", "random")
#: Least length of the second group, the match, the match, and the match.
LEAST = (8, 16, 32, 20)
#: What a text must contain for any of the patterns to be kept.
_ANY = r"(?i:passw(or)?d|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{12}|[A-Za-z0-9+/_=-]{20}"
FDR = 0.01
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings in the order in which they are tried: pattern, alphabet, and of ordinary tokens the least share of equal
#: pairs of symbols and the largest share of neighbours of different class.
ENCODINGS = (
    ("^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef", 0.10, 0.20),
    ("^[A-Z2-7]+=*$", _UPPER + "234567", 0.055, 0.05),
    ("^[A-Za-z0-9]+$", _DIGITS + _UPPER + _LOWER, 0.05, 0.15),
    ("^[A-Za-z0-9+/]+=*$", _UPPER + _LOWER + _DIGITS + "+/", 0.05, 0.15),
    ("^[A-Za-z0-9_-]+=*$", _UPPER + _LOWER + _DIGITS + "-_", 0.05, 0.15),
)
#: Least lag-one correlation of sequences.
SERIAL = 0.7
#: Most expected pairs and steps for which the tail is summed; beyond, it is far from any cut, and its bound does.
EXACT_PAIRS, EXACT_STEPS = 500, 1000
#: Lower ends of the length classes.
LENGTHS = (20, 32, 48, 96)
BINS, BIN_WIDTH = 400, 0.25


def _matches(docs: DataFrame) -> DataFrame:
    """_id, _text (hash), kind (index), start, match, value: the matches of all patterns that are long enough."""
    # A zero-width guard keeps shorter runs out of the arrays; a maximal run is then found where it starts.
    patterns = (
        ASSIGN,
        rf"(?=AKIA[A-Z0-9]{{12}}){ACCESS}",
        rf"(?<![0-9a-f])(?=[0-9a-f]{{{LEAST[2]}}}){HEX}",
        rf"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]{{{LEAST[3]}}}){TOKEN}",
    )
    hit = docs.filter(F.col("text").rlike(_ANY)).select(
        F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), "text"
    )
    per_kind = [
        F.struct(
            F.lit(k).alias("kind"),
            F.split("text", p, -1).alias("gaps"),
            F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("found"),
            F.regexp_extract_all("text", F.lit(p), F.lit(2 if k == 0 else 0)).alias("values"),
        )
        for k, p in enumerate(patterns)
    ]
    each = hit.select("_id", "_text", F.inline(F.array(*per_kind))).filter("size(found) > 0")
    rows = each.select(
        "_id",
        "_text",
        "kind",
        F.posexplode(
            F.arrays_zip(F.transform("gaps", lambda g: F.length(g)).alias("gap"), "found", "values")
        ).alias("i", "m"),
    ).filter("m.found is not null")
    rows = rows.select("_id", "_text", "kind", "i", "m.gap", F.col("m.found").alias("match"), F.col("m.values").alias("value"))
    # The matches of one pattern in one document: bounded by that document.
    so_far = Window.partitionBy("_id", "_text", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.distinct().withColumn("start", F.sum(F.col("gap") + F.length("match")).over(so_far) - F.length("match"))
    least = F.element_at(F.array(*map(F.lit, LEAST)), F.col("kind") + 1)
    return placed.filter(F.length("value") >= least).select(
        "_id", "_text", "kind", F.col("start").cast("long").alias("start"), "match"
    )


def _tested(tokens: DataFrame) -> DataFrame:
    """The tokens with `evidence`: minus the decimal logarithm of the p-value of the battery."""

    def inferred(at: int) -> Column:
        out = F.lit(None)
        for row in reversed(ENCODINGS):
            out = F.when(F.col("match").rlike(row[0]), F.lit(row[at])).otherwise(out)
        return out

    t = tokens.withColumns({"alphabet": inferred(1), "equal": inferred(2), "changes": inferred(3)})
    plain = F.when(F.length("alphabet") == 16, F.lower("match")).otherwise(F.regexp_replace("match", "=", ""))
    t = t.withColumn("symbols", F.when(F.col("alphabet").isNotNull(), plain).otherwise(F.lit("")))
    t = t.withColumn("n", F.length("symbols").cast("double"))
    # Counts of symbols: what is lost when a symbol is taken out.
    t = t.withColumn(
        "pairs",
        F.expr(
            """aggregate(array_distinct(split(symbols, '')), 0D, (a, c) -> a + if(c = '', 0D,
            (length(symbols) - length(replace(symbols, c, ''))) * (length(symbols) - length(replace(symbols, c, '')) - 1) / 2D))"""
        ),
    )
    t = t.withColumn("few", F.col("n") * (F.col("n") - 1) / 2 * F.col("equal"))
    # Each maximal run of a class becomes one letter.
    runs = F.col("symbols")
    for pattern, letter in (("[a-z]+", "\u0001"), ("[A-Z]+", "\u0002"), ("[0-9]+", "\u0003"), ("[+/_-]+", "\u0004")):
        runs = F.regexp_replace(runs, pattern, letter)
    t = t.withColumns({"steps": F.greatest(F.col("n") - 1, F.lit(1.0)), "steps_changed": F.length(runs) - 1.0})
    poisson = """-ln(if(pairs < 1, exp(-few), aggregate(sequence(1, cast(pairs as int)), named_struct('t', exp(-few), 's', exp(-few)),
        (a, i) -> named_struct('t', a.t * few / i, 's', a.s + a.t * few / i), a -> a.s)))"""
    bound = "few - pairs + if(pairs > 0, pairs * ln(pairs / few), 0D)"
    uniform = F.expr(f"if(pairs < few, if(few <= {EXACT_PAIRS}, {poisson}, {bound}), 0D)")
    binomial = """-ln(aggregate(sequence(1, cast(steps as int)), named_struct('t', power(1 - changes, steps), 's', 0D),
        (a, i) -> named_struct('t', a.t * (steps - i + 1) / i * changes / (1 - changes),
          's', a.s + if(i >= steps_changed, a.t * (steps - i + 1) / i * changes / (1 - changes), 0D)), a -> a.s))"""
    part = "least(steps_changed / steps, 1 - 1e-12D)"
    bound = f"steps * ({part} * ln({part} / changes) + (1 - {part}) * ln((1 - {part}) / (1 - changes)))"
    # A sum too small for a double has no logarithm; the bound stands for it.
    mixed = F.expr(f"if(steps_changed > steps * changes, coalesce(if(steps <= {EXACT_STEPS}, {binomial}, NULL), {bound}), 0D)")
    codes = """if(n > 3, transform(sequence(1, cast(n as int)), i ->
        cast(instr(alphabet, substr(symbols, i, 1)) as double) - (length(alphabet) + 1) / 2D), cast(array() as array<double>))"""
    t = t.withColumn("codes", F.expr(codes)).withColumn("energy", F.expr("aggregate(codes, 0D, (a, c) -> a + c * c)"))
    lag = F.expr("if(n > 3, aggregate(sequence(1, size(codes) - 1), 0D, (a, i) -> a + codes[i] * codes[i - 1]), 0D)")
    size = F.least(F.abs(lag / F.col("energy")), F.lit(1 - 1e-9))
    z = (F.atanh(F.lit(SERIAL)) - F.atanh(size)) * F.sqrt(F.col("n") - 3)
    # Of a half and of what is left of the density divided by z, the smaller bounds the tail.
    tail = z * z / 2 + F.greatest(F.log(F.lit(2.0)), F.log(z * F.sqrt(F.lit(2 * math.pi))))
    apart = F.when((F.col("n") > 3) & (F.col("energy") > 0), F.when(z > 0, tail))
    nats = F.least(*(F.coalesce(test, F.lit(0.0)) for test in (uniform, mixed, apart)))
    return t.withColumn("evidence", nats / F.log(F.lit(10.0)))


def _random(tokens: DataFrame) -> DataFrame:
    """The tokens that the battery finds random, at the false-discovery level of their length class."""
    group = F.lit(0)
    for k, least in enumerate(LENGTHS[1:], 1):
        group = F.when(F.length("match") >= least, F.lit(k)).otherwise(group)
    at = F.least(F.floor(F.col("evidence") / BIN_WIDTH), F.lit(BINS)).cast("int")
    # Few bytes but much work a row: dealt by a number that adaptive execution does not lower.
    parts = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tested = _tested(tokens.repartition(parts, "_id", "_text", "start")).withColumns({"class": group, "bin": at})
    tested = written(tested.select(*tokens.columns, "class", "bin"), "tested")
    counts = tested.groupBy("class", "bin").agg(F.count("*").alias("n"))  # at most len(LENGTHS) * (BINS + 1) rows
    above = Window.partitionBy("class").orderBy(F.desc("bin"))
    whole = Window.partitionBy("class")
    level = counts.withColumns({"k": F.sum("n").over(above), "m": F.sum("n").over(whole)})
    # All p-values of a bin are at most 10 ** -(bin * BIN_WIDTH).
    cut = (
        level.filter(F.pow(F.lit(10.0), -F.col("bin") * BIN_WIDTH) <= F.col("k") * FDR / F.col("m"))
        .groupBy("class")
        .agg(F.min("bin").alias("cut"))
    )
    return tested.join(F.broadcast(cut), "class").filter(F.col("bin") >= F.col("cut")).select(tokens.columns)


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id and spans (array of kind, start, end; code points, end exclusive; by start, then kind as listed).

    Spans of kind "random" that lie inside a span of a fixed pattern are not listed again.
    """
    docs = docs.select("doc_id", "text")
    found = written(_matches(docs), "matches")
    rows = found.filter("kind < 3").unionByName(_random(found.filter("kind = 3")))
    rows = rows.select("_id", "_text", "kind", "start", (F.col("start") + F.length("match")).alias("end"))
    # Of the fixed spans that begin no later, the furthest end; a window over one document's spans.
    so_far = Window.partitionBy("_id", "_text").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(F.col("kind") < 3, F.col("end"))).over(so_far)
    rows = rows.withColumn("reach", reach).filter("kind < 3 or reach is null or reach < end")
    names = F.array(*map(F.lit, KINDS))
    named = F.transform(
        F.array_sort(F.collect_list(F.struct("start", "kind", "end"))),
        lambda s: F.struct(F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    rows = rows.groupBy("_id", "_text").agg(named.alias("spans"))
    out = docs.select("doc_id", F.xxhash64("text").alias("_key")).join(
        rows, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_text")), "left"
    )
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return out.select("doc_id", F.coalesce("spans", empty).alias("spans"))


def listed(spans: Column, kinds: tuple[str, ...] = KINDS) -> Column:
    """kind:start:end of the spans of these kinds, comma-joined."""
    own = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(
        F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
