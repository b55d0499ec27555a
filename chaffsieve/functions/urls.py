"""Page kinds by url as column functions; the same decisions as in `lines`, for whole tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chaffsieve.functions import lines as L


def host(url: Column) -> Column:
    """Lower-case host without user and port; null for what is no absolute url."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", F.lower(found))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def _tidy(url: Column) -> Column:
    return F.regexp_replace(path(url), r"/+\z", "")


def forge_kind(url: Column) -> Column:
    p = _tidy(url)
    owner = F.lower(F.regexp_extract(p, "^/([^/]+)", 1))
    return F.when(
        host(url).isin(*L.FORGE_HOSTS) & ~p.contains("//"),
        F.when(p.rlike(r"^/[^/]+/[^/]+\z"), F.when(~owner.isin(*sorted(L.FORGE_RESERVED)), F.lit("repo_root")))
        .when(p.rlike(r"^/[^/]+/[^/]+/pull/[0-9]+\z"), F.lit("pull"))
        .when(p.rlike(r"^/[^/]+/[^/]+/compare(/|\z)"), F.lit("compare"))
        .when(p.rlike(r"^/[^/]+/[^/]+/releases(\z|/tag/[^/]+)"), F.lit("release")),
    )


def social_kind(url: Column) -> Column:
    p = _tidy(url)
    user = F.lower(F.regexp_extract(p, "^/([A-Za-z0-9_]{1,15})(/|$)", 1))
    return F.when(
        host(url).isin(*L.SOCIAL_HOSTS),
        F.when(p.rlike(r"^/i/trending/[0-9]+\z"), F.lit("trending")).when(
            (user != "") & ~user.isin(*sorted(L.SOCIAL_RESERVED)),
            F.when(p.rlike(r"^/[^/]+/status/[0-9]+(/(photo|video)/[1-9][0-9]*)?\z"), F.lit("status")).when(
                p.rlike(r"^/[^/]+\z"), F.lit("profile")
            ),
        ),
    )


def is_article(url: Column) -> Column:
    p = path(url)
    first = F.regexp_extract(p, "^/([^/]*)/", 1)
    ok = host(url).isin(*L.ARTICLE_HOSTS) & p.rlike(r"^/[A-Za-z0-9_-]+/[A-Za-z0-9_-]+/?\z") & ~first.isin("t", "tags", "settings", "search")
    return F.coalesce(ok, F.lit(False))
