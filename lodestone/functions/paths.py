"""Paths as columns: ``/``-separated, relative to the project's root; the root's directory is ``.``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.config import LANGUAGES

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def posix(c: C) -> Column:
    return F.translate(col(c), "\\", "/")


def basename(c: C) -> Column:
    return F.regexp_extract(col(c), r"([^/]*)$", 1)


def dirname(c: C) -> Column:
    d = F.regexp_extract(col(c), r"^(.*)/[^/]*$", 1)
    return F.when(d == "", ".").otherwise(d)


def suffix(c: C) -> Column:
    """Last dotted part of the name; a leading dot opens no suffix and a closing one is none."""
    return F.regexp_extract(basename(c), r"^.+(\.[^.]+)$", 1)


def stem(c: C) -> Column:
    return F.regexp_replace(basename(c), r"^(.+)\.[^.]+$", "$1")


def capped(c: C, depth: int) -> Column:
    """The first ``depth`` segments."""
    return F.array_join(F.slice(F.split(col(c), "/"), 1, depth), "/")


def label(c: C) -> Column:
    """A directory with its closing slash."""
    return F.replace(F.concat(col(c), F.lit("/")), F.lit("//"), F.lit("/"))


def language(c: C, extensions: dict[str, str] | None = None) -> Column:
    """Language of a path's extension, whatever its case; null for others."""
    out = F.lit(None).cast("string")
    by: dict[str, list[str]] = {}
    for e, lang in (extensions or LANGUAGES).items():
        by.setdefault(lang, []).append(e)
    s = F.lower(suffix(c))
    for lang, es in by.items():
        out = F.when(s.isin(es), lang).otherwise(out)
    return out
