"""Expressions over page addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip


def origin(base: Column) -> Column:
    """Scheme and host of an address, without user and default port."""
    scheme = F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(base, r"^[^:/]+://(?:[^/?#@]*@)?([^/?#]*)", 1))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    return F.concat(scheme, F.lit("://"), host)


def resolve_url(url: Column, base: Column) -> Column:
    """An address that does not start with http is resolved against the origin of base, not its path."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return (
        F.when(F.startswith(url, F.lit("http")), url)
        .when(F.startswith(url, F.lit("//")), F.concat(scheme, F.lit(":"), url))
        .when(F.startswith(url, F.lit("/")), F.concat(origin(base), url))
        .otherwise(F.concat(origin(base), F.lit("/"), url))
    )


def page_cache_key(url: Column, today: str) -> Column:
    """md5 of the address; that of a tag page holds the date, so that it expires."""
    return F.md5(F.when(F.contains(url, F.lit("/tag/")), F.concat(url, F.lit(today))).otherwise(url).cast("binary"))


def tag_from_url(url: Column) -> Column:
    """The last part of the path that is neither empty nor a number, percent-decoded; + stays +."""
    path = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")
    parts = F.transform(F.split(path, "/"), lambda x: F.trim(F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))))
    return F.try_element_at(F.filter(parts, lambda x: (x != "") & ~x.rlike(r"^\d+$")), F.lit(-1))


def tag_list_url(tag: Column, site: str) -> Column:
    """Address of a tag's list page, encoded as a path part."""
    out = F.replace(F.url_encode(tag), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.concat(F.lit(f"{site}/tag/"), out)


def page_number(text: Column) -> Column:
    """Leading integer of a text, after white space of any kind; 1 if there is none or it is no long."""
    return F.coalesce(F.regexp_extract(strip(text), r"^([+-]?[0-9]+)", 1).try_cast("long"), F.lit(1).cast("long"))
