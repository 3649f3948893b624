"""Expressions over media and image files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def media_fingerprint(path: Column, size: Column, mtime: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", path, size.cast("string"), mtime.cast("string")).cast("binary")), 1, 16)


def run_key(path: Column) -> Column:
    return F.substring(F.md5(path.cast("binary")), 1, 8)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def image_extension(content_type: Column) -> Column:
    c = F.lower(content_type)
    out = F.when(F.contains(c, F.lit("jpeg")), "jpg")
    for kind in ("png", "gif", "webp"):
        out = out.when(F.contains(c, F.lit(kind)), kind)
    return out.otherwise("jpg")


def encode_policy(ext: Column) -> tuple[Column, Column, Column]:
    """(quality, lossless, animated) of an extension: png lossless 100, gif animated 80, others 80."""
    return F.when(ext == "png", 100).otherwise(80), ext == "png", ext == "gif"


def has_skip_mark(path: Column) -> Column:
    """`_skip`, or `_skip_` and digits, before an image extension, in either case."""
    return path.rlike(r"(?i)_skip(_\d+)?\.(png|jpe?g|gif)$")


def webp_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", ".webp")


def skip_path(path: Column) -> Column:
    return F.regexp_replace(path, r"(\.[^./]*)$", r"_skip$1")


def clash_path(path: Column, stamp: str) -> Column:
    return F.regexp_replace(path, r"(\.[^./]*)$", rf"_{stamp}$1")
