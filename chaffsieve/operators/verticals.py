"""Projections of the vertical searches: web sections, images, news, videos, places and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTIONS = ("summarizer", "web", "faq", "discussions", "news", "videos")
MAX_IDS = 20
DATETIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?Z\z"


def _has(kind: T.StructType, path: str) -> bool:
    head, _, rest = path.partition(".")
    return head in kind.names and (not rest or _has(kind[head].dataType, rest))


def web_sections(found: DataFrame) -> DataFrame:
    """request_id, section, section_ord, ord, body (JSON) and is_error, in the order of the sections.

    found: request_id, summarizer (key), web, faq, discussions, news, videos (arrays of structs) and the flags
    mutated_discussions, mutated_news, mutated_videos. Without web rows there is one message after the summarizer key,
    and no later section."""
    has_web = F.coalesce(F.size("web") > 0, F.lit(False))
    key = found.filter("summarizer is not null").select(
        "request_id", F.lit("summarizer").alias("section"), F.lit(0).alias("ord"), F.concat(F.lit("Summarizer key: "), "summarizer").alias("body"), F.lit(False).alias("is_error")
    )
    none = found.filter(~has_web).select("request_id", F.lit("web").alias("section"), F.lit(0).alias("ord"), F.lit("No web results found").alias("body"), F.lit(True).alias("is_error"))
    out = key.unionByName(none)
    shapes: dict[str, list] = {
        "web": ["url", "title", "description", "extra_snippets"],
        "faq": ["question", "answer", "title", "url"],
        "discussions": ["url", "data"],
        "news": ["source", "breaking", "is_live", "age", "url", "title", "description", "extra_snippets"],
        "videos": ["url", "title", "description", "age", ("thumbnail.src", "thumbnail_url"), ("video.duration", "duration"), ("video.views", "view_count"), ("video.creator", "creator"), ("video.publisher", "publisher"), ("video.tags", "tags")],
    }
    for section, fields in shapes.items():
        if section not in found.columns:
            continue
        flag = [F.col(f"mutated_{section}").alias("mutated_by_goggles")] if f"mutated_{section}" in found.columns else []
        rows = found.filter(has_web).select("request_id", *[c for c in found.columns if c.startswith("mutated_")], F.posexplode(section).alias("ord", "r"))
        item = found.schema[section].dataType.elementType
        pairs = [f if isinstance(f, tuple) else (f, f) for f in fields]
        own = [F.col(f"r.{path}").alias(name) for path, name in pairs if _has(item, path)]
        out = out.unionByName(
            rows.select("request_id", F.lit(section).alias("section"), "ord", F.to_json(F.struct(*flag, *own)).alias("body"), F.lit(False).alias("is_error"))
        )
    at = F.array_position(F.array(*map(F.lit, SECTIONS)), F.col("section")).cast("int")
    return out.withColumn("section_ord", at)


def images(rows: DataFrame) -> DataFrame:
    """Rows that fit: title, two URLs, a UTC time, a known confidence and whole positive sizes."""
    url = lambda c: F.coalesce(F.try_parse_url(c, F.lit("PROTOCOL")).isNotNull(), F.lit(False))
    fit = (
        F.col("title").isNotNull()
        & url(F.col("url"))
        & url(F.col("image_url"))
        & F.col("page_fetched").rlike(DATETIME)
        & F.substring("page_fetched", 1, 10).try_cast("date").isNotNull()
        & F.col("confidence").isin("low", "medium", "high")
        & (F.col("width") > 0)
        & (F.col("height") > 0)
    )
    return rows.filter(fit)


def news(rows: DataFrame) -> DataFrame:
    return rows.withColumn("breaking", F.coalesce("breaking", F.lit(False)))


def opening_hours(hours: DataFrame) -> DataFrame:
    """request_id, poi_id and hours: one "day: intervals" entry a day in the order met, joined by "; "; today first.

    hours: request_id, poi_id, is_today, pos (order), full_name, opens, closes."""
    span = F.concat("opens", F.lit("-"), "closes")
    day = F.when(F.col("is_today"), F.lit("today")).otherwise(F.lower("full_name"))
    per = hours.groupBy("request_id", "poi_id", day.alias("day")).agg(
        F.min("pos").alias("first"),
        F.min_by(F.lower("full_name"), "pos").alias("name"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", span.alias("span")))), lambda x: x["span"]).alias("spans"),
        F.bool_or("is_today").alias("now"),
    )
    label = F.when(F.col("now"), F.concat(F.lit("today ("), "name", F.lit(")"))).otherwise(F.col("day"))
    entry = F.struct((~F.col("now")).alias("later"), "first", F.concat(label, F.lit(": "), F.array_join("spans", ", ")).alias("text"))
    return per.groupBy("request_id", "poi_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["text"]), "; ").alias("hours")
    )


def described_places(places: DataFrame, descriptions: DataFrame) -> DataFrame:
    """All places, with the first description of their id among those of the first MAX_IDS ids of the request.

    places: request_id, ord, id, ...; descriptions: request_id, ord, id, description."""
    asked = places.withColumn("_n", F.row_number().over(Window.partitionBy("request_id").orderBy("ord"))).filter(f"_n <= {MAX_IDS}")
    first = descriptions.groupBy("request_id", "id").agg(F.min_by("description", "ord").alias("description"))
    known = asked.select("request_id", "id").distinct().join(first, ["request_id", "id"])
    return places.join(known, ["request_id", "id"], "left")


def local_or_web(requests: DataFrame, places: DataFrame, web: DataFrame) -> DataFrame:
    """Places where a request has any, else its web rows after a message, else only a message: request_id, ord, body."""
    with_places = places.select("request_id").distinct()
    rest = requests.select("request_id").join(with_places, "request_id", "left_anti")
    fallback = web.join(rest, "request_id", "left_semi")
    with_web = fallback.select("request_id").distinct()
    told = with_web.select("request_id", F.lit(-1).alias("ord"), F.lit("no places, web results follow").alias("body"))
    lost = rest.join(with_web, "request_id", "left_anti").select("request_id", F.lit(-1).alias("ord"), F.lit("no places").alias("body"))
    cols = ["request_id", "ord", "body"]
    return places.select(cols).unionByName(fallback.select(cols)).unionByName(told).unionByName(lost)


def summary_text(parts: Column) -> Column:
    """Tokens as they are, references as their url in brackets, anything else as nothing. parts: type, data, url."""
    return F.array_join(
        F.transform(
            parts,
            lambda p: F.when(p["type"] == "token", p["data"])
            .when(p["type"] == "inline_reference", F.concat(F.lit(" ("), p["url"], F.lit(")")))
            .otherwise(F.lit("")),
        ),
        "",
    )
