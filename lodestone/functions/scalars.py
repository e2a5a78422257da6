"""Scalar functions: hashes, routes, environment variables, dependency names, visibility."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.paths import C, col

# How each language reads an environment variable.
ENV_PATTERNS = {
    "javascript": r"process\.env\.([A-Z][A-Z0-9_]+)",
    "typescript": r"process\.env\.([A-Z][A-Z0-9_]+)",
    "python": r"os\.(?:environ(?:\.get)?\s*\(\s*['\"]|getenv\s*\(\s*['\"])([A-Z][A-Z0-9_]+)",
    "go": r'os\.Getenv\(\s*"([A-Z][A-Z0-9_]+)',
}
#: Also takes ``os.environ["X"]``.
PYTHON_SUBSCRIPTS = r"os\.(?:environ(?:\.get)?\s*[\(\[]\s*['\"]|getenv\s*\(\s*['\"])([A-Z][A-Z0-9_]+)"
# Sample files of variables, and a line that sets one.
ENV_FILES = [".env.example", ".env.template", ".env.sample", ".env.test"]
ENV_LINE = r"^([A-Z][A-Z0-9_]+)\s*="
ROUTE_ARG = r"""\(\s*['"](.+?)['"]\s*\)"""
MODULE_HASH_CHARS = 16


def content_hash(content: C) -> Column:
    return F.sha2(col(content), 256)


def snapshot_name(path: C) -> Column:
    """Name of a project's snapshot folder."""
    return F.substring(F.sha2(col(path), 256), 1, MODULE_HASH_CHARS)


def strip(c: C) -> Column:
    """Without white space at either end, tabs and line breaks included."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def first_match(text: C, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(col(text), pattern, group), F.lit(""))


def route_arg(decorator: C) -> Column:
    return first_match(decorator, ROUTE_ARG)


def strip_slashes(c: Column, both: bool = True) -> Column:
    return F.regexp_replace(c, "^/+|/+$" if both else "/+$", "")


def route_path(prefix: C, path: C) -> Column:
    """``prefix`` and ``path`` joined and stripped; without a prefix the path as it is."""
    p = F.coalesce(col(prefix), F.lit(""))
    m = F.coalesce(col(path), F.lit(""))
    return F.when(p != "", strip_slashes(F.concat(p, F.lit("/"), m))).otherwise(m)


def env_vars(content: C, language: C, subscripts: bool = False) -> Column:
    """Names of variables that the text reads, in order, with repeats."""
    out = F.array().cast("array<string>")
    for lang, pattern in ENV_PATTERNS.items():
        pattern = PYTHON_SUBSCRIPTS if subscripts and lang == "python" else pattern
        out = F.when(col(language) == lang, F.regexp_extract_all(col(content), F.lit(pattern), F.lit(1))).otherwise(out)
    return out


def dependency_name(requirement: C) -> Column:
    """A requirement's name: all before the first version mark or bracket, trimmed, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_extract(col(requirement), r"(?s)^(.*?)(?:>=|==|\[|<|~|!|$)", 1), r"^\s+|\s+$", ""))


def python_visibility(name: C) -> Column:
    n = col(name)
    return F.when(F.startswith(n, F.lit("__")) & ~F.endswith(n, F.lit("__")), "private").when(F.startswith(n, F.lit("_")), "protected").otherwise("public")


def go_exported(name: C) -> Column:
    return F.substring(col(name), 1, 1).rlike(r"^\p{Lu}")


def tag_keys(tag: C) -> Column:
    """Sorted distinct keys of a struct tag."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(col(tag), F.lit(r"(\w+):"), F.lit(1))))


def decoded(content: C) -> Column:
    return F.decode(col(content), "UTF-8")
