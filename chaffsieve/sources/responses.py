"""Responses and answers from JSON files, split into valid and broken rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chaffsieve.operators.work_table import RESPONSE

ANSWERS = "request_id string, global_key string, type string, noul double, probabilities map<string,double>"


def read_responses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Valid responses, and broken lines with the reason. A response needs a grounding with a list of items, and its
    sources must be keyed by URLs."""
    raw = spark.read.schema(RESPONSE + ", _corrupt string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    keys = F.map_keys(F.coalesce("sources", F.create_map().cast("map<string,string>")))
    bad_url = F.exists(keys, lambda k: ~k.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"))
    reason = (
        F.when(F.col("_corrupt").isNotNull(), F.lit("not json"))
        .when(F.col("grounding.generic").isNull(), F.lit("no items"))
        .when(bad_url, F.lit("source key is no url"))
    )
    marked = raw.withColumn("_reason", reason)
    good = marked.filter("_reason is null").drop("_reason", "_corrupt")
    return good, marked.filter("_reason is not null").select("request_id", F.col("_reason").alias("reason"))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Recorded answers; probabilities that are no finite numbers in [0, 1] are kept for the verdicts to refuse."""
    return spark.read.schema(ANSWERS).json(path)


def parse_reply(status: DataFrame) -> DataFrame:
    """request_id, kind (ok, http, shape) and answers from rows of request_id, status and body (JSON text). One broken
    answer does not touch the others."""
    # Probabilities come as JSON text first: NaN and quoted numbers are not numbers.
    body = F.from_json("body", "model string, answers map<string,string>")
    rows = status.withColumn("b", body)
    kind = F.when(F.col("status") != 200, F.lit("http")).when(F.col("b.answers").isNull(), F.lit("shape")).otherwise(F.lit("ok"))
    return rows.select("request_id", kind.alias("kind"), F.when(kind == "ok", F.col("b.answers")).alias("answers"), F.col("b.model").alias("model"))


def answer_rows(replies: DataFrame) -> DataFrame:
    """The answers table of good replies: request_id, global_key, type, noul, probabilities."""
    each = replies.filter("kind = 'ok'").select("request_id", F.explode("answers").alias("global_key", "json"))
    number = lambda c: F.when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?\z"), c.try_cast("double"))
    noul = number(F.get_json_object("json", "$.probability"))
    texts = F.from_json(F.get_json_object("json", "$.probabilities"), "map<string,string>")
    values = F.transform_values(texts, lambda _, v: number(v))
    whole = F.forall(F.map_values(values), lambda v: v.isNotNull())
    kind = F.get_json_object("json", "$.type")
    return each.select(
        "request_id", "global_key", kind.alias("type"), F.when(kind == "noul", noul).alias("noul"), F.when((kind == "choice") & whole, values).alias("probabilities")
    ).filter("noul is not null or probabilities is not null")
