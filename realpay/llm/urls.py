"""Parts of web addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from realpay.llm.tables import ascii_lower

#: Host: from the first :// to the next of / ? # or the end; path: what follows, to ? # or the end.
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host(url):
    """The host with A-Z lower-cased; '' if the url is null or has no ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")))


def path(url):
    """The path as it stands; '' if the url is null or has no ://."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def sort_key(url):
    """Host labels from the last to the first, then the path in lower case: captures of a site stand together."""
    return F.concat(F.array_join(F.reverse(F.split(host(url), r"\.")), ","), F.lit(")"), ascii_lower(path(url)))
