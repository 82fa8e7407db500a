"""URL functions as Column expressions: hosts, page kinds, media addresses, allow-lists.

A null or malformed URL has no host and protocol, is allowed nowhere, and gives null or empty text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts and paths of the platform whose pages are read.
SITE_HOSTS = ("x.com", "twitter.com")
MEDIA_HOST = "pbs.twimg.com"
MEDIA_PATHS = ("/media/", "/amplify_video_thumb/", "/ext_tw_video_thumb/", "/tweet_video_thumb/")
API_MARKS = r"/graphql/|/i/api/|/2/tweets|article"
SITE = "https://x.com"


def protocol(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1), F.lit("")))


def host(url: Column) -> Column:
    """The host in lower case, without user and port; null if there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def hostname(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(host(url), r"^www\.", ""), F.lit(""))


def safe_http_url(url: Column) -> Column:
    """The URL if it is of http or https with a host, else empty."""
    return F.when(protocol(url).isin("http", "https") & host(url).isNotNull(), F.trim(url)).otherwise("")


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"[?#].*$", "")


def numeric_id(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"/(?:article|status)/(\d+)", 1), F.lit(""))


def page_kind(url: Column) -> Column:
    """article, post or other, from the path."""
    return F.when(path(url).rlike(r"/article/\d+"), "article").when(path(url).rlike(r"/status/\d+"), "post").otherwise("other")


def article_url(url: Column) -> Column:
    """The canonical address of an article page, or empty."""
    user, number = (F.regexp_extract(path(url), r"^/([^/]+)/article/(\d+)", i) for i in (1, 2))
    return F.when(number != "", F.concat(F.lit(f"{SITE}/"), user, F.lit("/article/"), number)).otherwise("")


def canonical_article_url(url: Column, expected_id: Column, handle: Column) -> Column:
    number, who = F.coalesce(F.nullif(expected_id, F.lit("")), numeric_id(url)), F.nullif(handle, F.lit(""))
    built = F.concat(F.lit(f"{SITE}/"), F.url_encode(who), F.lit("/article/"), F.url_encode(number))
    return F.coalesce(built, F.when(host(url).isNotNull(), without_query(url)), F.nullif(url, F.lit("")), F.lit(SITE))


def post_url(post_id: Column, handle: Column) -> Column:
    return F.concat(F.lit(f"{SITE}/"), F.coalesce(F.url_encode(F.nullif(handle, F.lit(""))), F.lit("i")), F.lit("/status/"), F.url_encode(post_id))


#: An address of https on the media host under one of its paths; user, port and case of the host don't count.
_MEDIA = r"^\s*(?i:https)://(?:[^/?#@]*+@(?=[^/?#:]))?+(?i:" + MEDIA_HOST.replace(".", r"\.") + r")(?=[/?#:]|\z)[^/?#]*+(?:" + "|".join(MEDIA_PATHS) + ")"


def is_media_url(url: Column) -> Column:
    return F.coalesce(url.rlike(_MEDIA), F.lit(False))


# Of these expressions each names its argument as seldom as it can, for what is named in a branch is computed there again.


def _parameters(url: Column) -> Column:
    """The query's parameters, each behind an ampersand; empty ones go."""
    return F.regexp_replace(F.concat(F.lit("&"), F.regexp_extract(url, r"\?([^#]*)", 1)), r"&+(?=&|\z)", "")


def _with_parameters(url: Column, parameters: Column) -> Column:
    return F.concat(without_query(url), F.regexp_replace(parameters, r"\A&", "?"))


def _set(parameters: Column, name: str, value: Column) -> Column:
    """Parameters with each of a name at a value of letters and digits, or with one more."""
    there = F.regexp_replace(parameters, rf"(?s)\A(?!.*&{name}=)(.*)\z", f"$1&{name}=")
    return F.regexp_replace(there, F.lit(f"&{name}=[^&]*"), F.concat(F.lit(f"&{name}="), value))


def media_url(url: Column, size: str = "orig", fill_format: bool = True) -> Column:
    """An allowed media address in the given size, with its format as parameter if asked; null for others."""
    parameters = _parameters(url)
    if fill_format:
        extension = F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1)
        parameters = F.when(parameters.rlike(r"&format=(?!&).") | (extension == ""), parameters).otherwise(_set(parameters, "format", extension))
    sized = _with_parameters(url, _set(parameters, "name", F.lit(size)))
    return F.when(is_media_url(url), F.when(F.startswith(path(url), F.lit("/media/")), sized).otherwise(url))


def media_key(url: Column) -> Column:
    """A media address without its size: equal for all sizes."""
    kept = F.regexp_replace(_parameters(url), "&name=[^&]*", "")
    return F.when(host(url).isNotNull(), _with_parameters(url, kept)).otherwise(F.coalesce(url, F.lit("")))


def media_url_score(url: Column) -> Column:
    name = F.regexp_extract(url, r"[?&]name=([^&#]*)", 1)
    score = F.when(F.startswith(path(url), F.lit("/media/")), 20).otherwise(0) + F.when(name == "orig", 10).when(name == "large", 8).otherwise(0)
    return score - F.when(name.rlike("small|thumb"), 6).otherwise(0)


def is_candidate_response(url: Column, mime: Column) -> Column:
    """Whether a response can hold article data: a host of the site, and JSON by type or address."""
    at, kind = host(url), F.lower(F.coalesce(mime, F.lit("")))
    ours = F.lit(False)
    for name in SITE_HOSTS:
        ours = ours | (at == name) | F.endswith(at, F.lit(f".{name}"))
    return F.coalesce(ours & (kind.contains("json") | kind.contains("graphql") | F.lower(url).rlike(API_MARKS)), F.lit(False))
