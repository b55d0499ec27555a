"""The shared classifier request and what its answers say: candidates, tiles, questions, answers, marginals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chaffsieve.functions import decisions as D
from chaffsieve.functions import dates

KEY = ["request_id", "source_index"]


def candidates(sources: DataFrame, snippets: DataFrame) -> DataFrame:
    """Kept snippets of kept sources with their position in the source (from 0) and the number of such."""
    alive = snippets.filter("kept").join(sources.filter("verdict = 'keep'").select(*KEY), KEY, "left_semi")
    order = Window.partitionBy(*KEY)
    return alive.withColumn(
        "position", (F.row_number().over(order.orderBy("index", "part")) - 1).cast("long")
    ).withColumn("n_candidates", F.count("*").over(order))


def tiled(rows: DataFrame) -> DataFrame:
    """Candidates in tiles of three: group_start, group_size, group_key and letter. No join: arithmetic on positions."""
    start = F.col("position") - F.col("position") % D.GROUP_SIZE
    return rows.withColumns(
        {
            "group_start": start,
            "group_size": F.least(F.lit(D.GROUP_SIZE).cast("long"), F.col("n_candidates") - start),
            "group_key": F.concat(F.lit("group"), start.cast("string")),
            "letter": F.substring(F.lit("ABC"), (F.col("position") % D.GROUP_SIZE + 1).cast("int"), F.lit(1)),
        }
    )


def questions(tiles: DataFrame) -> DataFrame:
    """One page question a source and one choice question a tile: local_key, global_key, type, instructions, labels."""
    source = D.source_id(F.col("source_index"))
    pages = tiles.select(*KEY).distinct().select(
        *KEY, F.lit("filler").alias("local_key"), F.lit("noul").alias("type"), D.page_instructions(source).alias("instructions"),
        F.lit(None).cast("array<string>").alias("labels"),
    )
    size = F.col("group_size").cast("int")
    groups = tiles.select(*KEY, "group_key", "group_start", "group_size").distinct().select(
        *KEY, F.col("group_key").alias("local_key"), F.lit("choice").alias("type"),
        D.group_instructions(source, F.col("group_start"), size).alias("instructions"), D.option_labels(size).alias("labels"),
    )
    return pages.unionByName(groups).withColumn("global_key", D.global_key(source, F.col("local_key")))


def state(requests: DataFrame, sources: DataFrame, tiles: DataFrame) -> DataFrame:
    """One row a request with the JSON state that the classifier gets. requests: request_id, query, intent and
    retrieval_time (left out where it is not a valid zoned time); an unknown page date is an explicit null."""
    texts = tiles.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("t"))
    age = F.from_json("meta", "age array<string>")["age"]
    one = sources.join(texts, KEY).select(
        "request_id",
        "source_index",
        F.struct(
            D.source_id(F.col("source_index")).alias("id"), "url", "title", F.transform("t", lambda x: x["text"]).alias("snippets"),
            dates.page_date(age).alias("page_date"),
        ).alias("body"),
    )
    per = one.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("source_index", "body"))).alias("s"))
    body = F.transform("s", lambda x: F.concat(F.lit('"'), x["body"]["id"], F.lit('":'), F.to_json(x["body"], {"ignoreNullFields": "false"})))
    when = dates.retrieval_time(F.col("retrieval_time"))
    return requests.join(per, "request_id").select(
        "request_id",
        F.concat(
            F.expr("substr(to_json(struct(query, intent)), 1, length(to_json(struct(query, intent))) - 1)"),
            F.lit(',"sources":{'),
            F.array_join(body, ","),
            F.lit("}"),
            F.coalesce(F.concat(F.lit(',"retrieval_time":"'), when, F.lit('"')), F.lit("")),
            F.lit("}"),
        ).alias("state"),
    )


def group_map(mappings: DataFrame) -> DataFrame:
    """request_id, source_id and groups: of several mappings of a source the last one holds. mappings: request_id, ord,
    source_id, groups."""
    return mappings.groupBy("request_id", "source_id").agg(F.max_by("groups", "ord").alias("groups"))


def answered(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """Questions with their answers by the explicit key; answers to nothing are ignored, a missing one is null.

    answers: request_id, global_key, type, noul, probabilities. An answer of the wrong type is none."""
    got = answers.select("request_id", "global_key", F.col("type").alias("_type"), "noul", "probabilities")
    out = asked.join(got, ["request_id", "global_key"], "left")
    right = F.col("_type") == F.col("type")
    return out.withColumns(
        {"noul": F.when(right, F.col("noul")), "probabilities": F.when(right, F.col("probabilities"))}
    ).drop("_type")


def judged_snippets(tiles: DataFrame, got: DataFrame) -> DataFrame:
    """Tiles with answer_state and keep_probability: the sum over the labels with the snippet's letter where the tile's
    answer is valid, else null (an invalid tile touches no other)."""
    answers = got.filter("type = 'choice'").select(*KEY, F.col("local_key").alias("group_key"), "probabilities")
    out = tiles.join(answers, [*KEY, "group_key"], "left").withColumn(
        "answer_state", D.answer_state(F.col("probabilities"), F.col("group_size").cast("int"))
    )
    return out.withColumn(
        "keep_probability",
        F.when(F.col("answer_state") == "ok", D.marginal(F.col("probabilities"), F.col("letter"))),
    ).drop("probabilities")


def page_answers(got: DataFrame) -> DataFrame:
    return got.filter("type = 'noul'").select(*KEY, F.col("noul").alias("page_probability"))
