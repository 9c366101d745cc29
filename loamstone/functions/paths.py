"""File names, extensions, URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extension(path: Column) -> Column:
    """Lower-cased suffix with its dot, or the empty string."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def safe_name(name: Column) -> Column:
    """A file name of letters, digits, dots, dashes and underscores, without dots at its ends."""
    base = F.regexp_replace(name, r"^.*[/\\]", "")
    return F.regexp_replace(F.regexp_replace(base, r"[^A-Za-z0-9._-]", "_"), r"^\.+|\.+$", "")


def is_http(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.lit(False))


def youtube_id(url: Column) -> Column:
    """The video id of a watch, shorts or short link; null for any other host or path."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    path = F.try_parse_url(url, F.lit("PATH"))
    long = F.when(path == "/watch", F.try_parse_url(url, F.lit("QUERY"), F.lit("v"))).when(
        path.startswith("/shorts/"), F.regexp_extract(path, r"^/shorts/([^/]+)", 1)
    )
    short = F.regexp_extract(path, r"^/([^/]+)", 1)
    found = F.when(host.isin("www.youtube.com", "youtube.com"), long).when(host == "youtu.be", short)
    return F.nullif(found, F.lit(""))


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)^[0-9a-f]{8}-?([0-9a-f]{4}-?){3}[0-9a-f]{12}$"), F.lit(False))
