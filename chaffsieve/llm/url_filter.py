"""URL filter: host-suffix and path-prefix expressions against rules by short hash prefixes.

A url gives an expression for each suffix of its host and each path prefix that is as long as some rule's path. Short
prefixes of the SHA-256 of these meet those of the rules in an equi-join; then the full digests are compared, and the
longest rule wins (then the longer host, then block before allow).

Every host and path is looked up once, however many pages share it. Rules are broadcast only where there are at most
BROADCAST_RULES of them; beyond that the join shuffles.

Defined cases: a null url or one without "://" has an empty host and path and no rule; hosts are compared in lower
case (A-Z), paths as they are; repeated rules count once; repeated pages each get a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_RULES = 100_000
#: Hexadecimal digits of the join key.
SHORT = 8
DEFAULT = "allow"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def judged(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict. rules: host, path, verdict (allow or block)."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = rules.select(
        F.col("verdict"), F.concat("host", "path").alias("rule"), F.length("host").alias("n_host"), F.length("path").alias("n_path")
    ).distinct()
    lengths = sorted(r[0] for r in rules.select("n_path").distinct().collect())  # as many as the longest path, at most
    known = rules.select("*", F.sha2("rule", 256).alias("digest")).withColumn("short", F.substring("digest", 1, SHORT))
    if rules.count() <= BROADCAST_RULES:
        known = F.broadcast(known)
    suffixes = F.expr(
        "transform(split(host, '[.]'), (x, i) -> array_join(slice(split(host, '[.]'), i + 1, size(split(host, '[.]'))), '.'))"
    )
    prefixes = F.transform(
        F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n),
    )
    asked = (
        rows.select("host", "path")
        .filter("host <> ''")
        .distinct()
        .withColumn("suffix", F.explode(suffixes))
        .select("host", "path", F.explode(F.transform(prefixes, lambda p: F.concat("suffix", p))).alias("asked"))
        .withColumn("full", F.sha2("asked", 256))
    )
    found = (
        asked.join(known, F.substring("full", 1, SHORT) == F.col("short"))
        .filter("full = digest")
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length("rule"), "n_host", "verdict", "rule")).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    )
    return rows.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(DEFAULT)).alias("verdict")
    )
