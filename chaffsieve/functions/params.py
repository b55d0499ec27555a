"""Request parameters: floors, defaults, validity and the query string, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chaffsieve.functions.text import collapsed, trimmed

#: Floors and defaults of the numeric parameters.
FLOORS = {"count": 1, "maximum_number_of_urls": 1, "maximum_number_of_tokens": 1024, "maximum_number_of_tokens_per_url": 512}
DEFAULTS = {"count": 10, "maximum_number_of_urls": 5, "maximum_number_of_tokens": 4000, "maximum_number_of_tokens_per_url": 800}
STATS_DEFAULTS = {"maximum_number_of_urls": 20, "maximum_number_of_tokens": 8192}
#: Inclusive ranges.
RANGES = {
    "latitude": (-90, 90), "longitude": (-180, 180), "offset": (0, 9), "web_count": (1, 20), "news_count": (1, 50),
    "videos_count": (1, 50), "places_count": (1, 50), "images_count": (1, 200),
}
#: Inclusive ranges of the budgets of a context request, which the remote side enforces.
BUDGETS = {
    "count": (1, 50), "maximum_number_of_urls": (1, 50), "maximum_number_of_tokens": (1024, 32768), "maximum_number_of_snippets": (1, 256),
    "maximum_number_of_tokens_per_url": (512, 8192), "maximum_number_of_snippets_per_url": (1, 100), "offset": (0, 9),
}
SAFESEARCH = ("off", "moderate", "strict")
FRESHNESS = r"^(pd|pw|pm|py|[0-9]{4}-[0-9]{2}-[0-9]{2}to[0-9]{4}-[0-9]{2}-[0-9]{2})\z"
#: Endpoints and their paths.
ENDPOINTS = {
    "images": "/res/v1/images/search", "localPois": "/res/v1/local/pois", "localDescriptions": "/res/v1/local/descriptions",
    "news": "/res/v1/news/search", "videos": "/res/v1/videos/search", "web": "/res/v1/web/search",
    "summarizer": "/res/v1/summarizer/search", "llmContext": "/res/v1/llm/context", "placeSearch": "/res/v1/local/place_search",
}


def raised(name: str, c: Column) -> Column:
    """The value at its floor at least; null stays null."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(FLOORS[name])))


def raise_report(columns: dict[str, Column]) -> Column:
    """Map from the parameters that were raised to what was asked and what holds."""
    rows = [
        F.when(c < FLOORS[n], F.struct(F.lit(n).alias("key"), F.struct(c.alias("requested"), F.lit(FLOORS[n]).cast("long").alias("applied")).alias("value")))
        for n, c in columns.items()
    ]
    return F.map_from_entries(F.array_compact(F.array(*rows)))


def filled(name: str, c: Column) -> Column:
    return F.coalesce(c, F.lit(DEFAULTS[name]))


def budget_errors(columns: dict[str, Column]) -> Column:
    """The names of the budgets that are out of their range, in the order given; absent ones are not."""
    return F.array_compact(F.array(*(F.when(~c.between(*BUDGETS[n]), F.lit(n)) for n, c in columns.items())))


def upstream(columns: dict[str, Column]) -> Column:
    """The budgets that are handed to the remote side, as a map for `query_string`: defaults for absent ones where there are
    such, floors for low ones; what is absent without a default is left out."""
    out = []
    for n, c in columns.items():
        whole = filled(n, c) if n in DEFAULTS else c
        out += [F.lit(n), (raised(n, whole) if n in FLOORS else whole).cast("string")]
    return F.map_filter(F.create_map(*out), lambda k, v: v.isNotNull())


def is_query(c: Column) -> Column:
    """1 to 400 characters after trimming, of at most 50 words."""
    q = trimmed(c)
    return F.coalesce(F.length(q).between(1, 400) & (F.size(F.split(collapsed(q), " ")) <= 50), F.lit(False))


def is_freshness(c: Column) -> Column:
    return F.coalesce(c.rlike(FRESHNESS), F.lit(False))


def in_range(name: str, c: Column) -> Column:
    """Null is an absent parameter and passes."""
    return F.coalesce(c.between(*RANGES[name]), F.lit(True))


def place_query(c: Column) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def is_place_search(query: Column, count: Column, latitude: Column, longitude: Column, radius: Column, location: Column) -> Column:
    """Whether the parameters of a place search fit; each may be absent, a blank query counts as absent."""
    short = place_query(query).isNull() | is_query(query)
    named = location.isNull() | (trimmed(location) != "")
    return short & named & in_range("places_count", count) & in_range("latitude", latitude) & in_range("longitude", longitude) & (radius.isNull() | (radius >= 0))


def goggle(c: Column) -> Column:
    """The trimmed goggle; null for blanks and for URLs that are not https."""
    g = trimmed(c)
    url = g.rlike("^(?i)https?://")
    return F.when((g != "") & (~url | g.rlike(r"^(?i)https://[^/?#\s]")), g)


def encoded(c: Column) -> Column:
    return F.url_encode(c)


def query_string(params: Column, ids: Column, result_filter: Column, summary: Column, goggles: Column) -> Column:
    """params: map of plain parameters (null values are left out, query becomes q); ids and goggles repeat; the result
    filter is one comma-joined value, left out where empty or where a summary is asked for."""
    pair = lambda k, v: F.concat(encoded(k), F.lit("="), encoded(v))
    plain = F.transform(
        F.filter(F.array_sort(F.map_entries(params)), lambda e: e["value"].isNotNull()),
        lambda e: pair(F.when(e["key"] == "query", F.lit("q")).otherwise(e["key"]), e["value"]),
    )
    own = F.filter(F.transform(goggles, goggle), lambda g: g.isNotNull())
    wanted = F.when(~F.coalesce(summary, F.lit(False)) & (F.size(result_filter) > 0), F.array(pair(F.lit("result_filter"), F.array_join(result_filter, ","))))
    none = F.array().cast("array<string>")
    return F.array_join(
        F.concat(
            plain,
            F.coalesce(F.transform(ids, lambda i: pair(F.lit("ids"), i)), none),
            F.coalesce(wanted, none),
            F.coalesce(F.transform(own, lambda g: pair(F.lit("goggles"), g)), none),
        ),
        "&",
    )


def permitted(name: Column, allowed: Column, denied: Column) -> Column:
    return F.when(F.size(allowed) > 0, F.array_contains(allowed, name)).otherwise(~F.array_contains(denied, name))


def tool_errors(allowed: Column, denied: Column, known: Column) -> Column:
    """Both lists at once are an error; else the names that no tool has."""
    both = (F.size(allowed) > 0) & (F.size(denied) > 0)
    return F.when(both, F.array(F.lit("allowed and denied exclude each other"))).otherwise(F.array_except(F.concat(allowed, denied), known))


def one_line(c: Column, most: int = 200) -> Column:
    """Control characters become blanks, long texts are cut."""
    return F.substring(F.regexp_replace(c, r"[\x00-\x1F\x7F]", " "), 1, most)
