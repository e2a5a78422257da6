"""Predicates over files and symbols, as columns.

Symbols are arrays of structs (see ``model.SYMBOL``), one array a file: what concerns one
file alone stays in its row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.paths import C, basename, col
from lodestone.model import CONTAINERS

# Names and paths of tests.
TEST_SUFFIXES = ["_test.py", "_test.go", ".spec.ts", ".spec.js", ".test.ts", ".test.js"]
TEST_DIRS = ["/tests/", "/test/", "/__tests__/", "/spec/", "/specs/"]
# Paths, names and attributes of generated files.
GENERATED_PATHS = ["Connected Services/", "Service References/", "/Generated/", "/obj/", "/auto_generated/", "/auto-generated/"]
GENERATED_SUFFIXES = [".Designer.cs", ".g.cs", ".g.i.cs", "Reference.cs", ".generated.cs", ".designer.cs"]
GENERATED_MARKS = ["GeneratedCode", "System.CodeDom.Compiler"]
# Beginnings of decorators that say nothing about architecture.
NOISE = [
    "System.Runtime.Serialization.",
    "System.CodeDom.Compiler.",
    "System.SerializableAttribute",
    "System.Diagnostics.DebuggerStepThroughAttribute",
    "System.Diagnostics.DebuggerNonUserCode",
    "KnownTypeAttribute",
    "DataContractAttribute",
    "DataMemberAttribute",
    "System.ComponentModel.EditorBrowsable",
]
# Decorators that make any change a high impact, and types that are no dependency.
HIGH_IMPACT = [
    "HttpGet", "HttpPost", "HttpPut", "HttpDelete", "HttpPatch", "Route", "ApiController",
    "app.route", "router.get", "router.post", "router.put", "router.delete", "api_view", "action",
    "Controller", "Get", "Post", "Put", "Delete", "Patch", "Injectable", "Component", "NgModule",
]
PRIMITIVES = [
    "string", "int", "long", "float", "double", "bool", "boolean", "byte", "char", "decimal", "short", "uint", "ulong", "ushort",
    "object", "void", "number", "any", "str",
]
# Directories of boilerplate.
BOILERPLATE = ["Migrations", "Properties", "bin", "obj", "dist", "out", "target", "vendor", "node_modules", ".idea", ".vscode", ".pytest_cache", "__pycache__"]
# Stems of entry points, and what a path's words say about their role.
ENTRY_STEMS = ["index", "main", "app", "server", "program", "bootstrap", "startup"]
ROLE_HINTS = [
    ("electron", "Electron main process"),
    ("preload", "Electron preload script"),
    ("routes", "Route definitions"),
    ("api", "API module index"),
    ("server", "HTTP server bootstrap"),
    ("backend", "Backend entry point"),
    ("frontend", "Frontend entry point"),
]
STEM_ROLES = {"main": "Application entry point", "app": "Application setup", "server": "HTTP server bootstrap"}

MINIFIED_SHARE, MINIFIED_LEAST, SHORT_NAME = 0.30, 5, 2


def any_(test: Callable[[str], Column], values: list[str]) -> Column:
    out = test(values[0])
    for v in values[1:]:
        out = out | test(v)
    return out


def is_public(visibility: Column, name: Column) -> Column:
    return ~F.coalesce(visibility, F.lit("")).isin("private", "protected") & ~F.startswith(name, F.lit("_"))


def is_public_symbol(s: Column) -> Column:
    return is_public(s["visibility"], s["name"])


def is_test(path: C) -> Column:
    name, padded = basename(path), F.concat(F.lit("/"), col(path), F.lit("/"))
    return F.startswith(name, F.lit("test_")) | any_(lambda s: F.endswith(name, F.lit(s)), TEST_SUFFIXES) | any_(lambda d: F.contains(padded, F.lit(d)), TEST_DIRS)


def is_generated_path(path: C) -> Column:
    return any_(lambda m: F.contains(col(path), F.lit(m)), GENERATED_PATHS) | any_(lambda s: F.endswith(col(path), F.lit(s)), GENERATED_SUFFIXES)


def is_generated(path: C, symbols: C) -> Column:
    """By path, or by an attribute of one of the first three symbols."""
    marks = F.flatten(F.transform(F.slice(col(symbols), 1, 3), lambda s: F.coalesce(s["decorators"], F.array().cast("array<string>"))))
    return is_generated_path(path) | F.coalesce(F.exists(marks, lambda d: any_(lambda m: F.contains(d, F.lit(m)), GENERATED_MARKS)), F.lit(False))


def short_share(n_short: Column, n: Column) -> Column:
    """Strictly more than the share of short names, of enough names."""
    return (n >= MINIFIED_LEAST) & (n_short / n > F.lit(MINIFIED_SHARE))


def is_minified(language: C, symbols: C) -> Column:
    top = F.filter(col(symbols), lambda s: is_public_symbol(s) & s["parent"].isNull())
    short = F.filter(top, lambda s: F.length(s["name"]) <= SHORT_NAME)
    return col(language).isin("javascript", "typescript") & short_share(F.size(short), F.size(top))


def public_containers(symbols: C) -> Column:
    return F.filter(col(symbols), lambda s: is_public_symbol(s) & s["kind"].isin(CONTAINERS))


def is_low_entropy(symbols: C) -> Column:
    """Public containers, none of which has a public method; free functions don't count."""
    boxes = public_containers(symbols)
    owners = F.transform(F.filter(col(symbols), lambda s: is_public_symbol(s) & (s["kind"] == "method") & s["parent"].isNotNull()), lambda s: s["parent"])
    return (F.size(boxes) > 0) & ~F.arrays_overlap(F.transform(boxes, lambda s: s["name"]), owners)


def without_noise(decorators: C) -> Column:
    return F.filter(col(decorators), lambda d: ~any_(lambda p: F.startswith(d, F.lit(p)), NOISE))


def impact_rank(impact: C, unknown: int = 2) -> Column:
    i = col(impact)
    return F.when(i == "high", 0).when(i == "medium", 1).when(i == "low", 2).otherwise(unknown)


def passes(impact: C, threshold: str) -> Column:
    """At least as grave as the threshold; unknown impacts count as low, unknown thresholds as medium."""
    return impact_rank(impact) <= impact_rank(F.lit(threshold), 1)


def impact(change: C, kind: C, visibility: C, decorators: C | None = None) -> Column:
    """How grave a change of a symbol is."""
    c, k, public = col(change), col(kind), F.coalesce(col(visibility) == "public", F.lit(False))
    loud = F.arrays_overlap(F.coalesce(col(decorators), F.array().cast("array<string>")), F.array(*map(F.lit, HIGH_IMPACT))) if decorators is not None else F.lit(False)
    return (
        F.when(loud, "high")
        .when(c.isin("added", "removed") & k.isin("class", "interface", "struct"), "high")
        .when((c == "removed") & (k == "method") & public, "high")
        .when((c == "modified") & public, "medium")
        .when((c == "added") & k.isin("function", "method") & public, "medium")
        .otherwise("low")
    )


def constructor_deps(signature: C) -> Column:
    """Types that a constructor takes: what stands between the outer parentheses, by comma, less the last word, primitives and blanks."""
    inner = F.trim(F.regexp_extract(col(signature), r"(?s)^[^(]*\((.*)\)[^)]*$", 1))
    params = F.filter(F.transform(F.split(inner, ","), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    types = F.transform(params, lambda p: F.regexp_replace(p, r"(?s)^(.*\S)\s+\S+$", "$1"))
    return F.filter(types, lambda t: ~F.lower(F.trim(F.regexp_extract(t, r"^([^<\[]*)", 1))).isin(PRIMITIVES))


def is_boilerplate(directory: C) -> Column:
    return F.arrays_overlap(F.split(col(directory), "/"), F.array(*map(F.lit, BOILERPLATE)))


def entry_role(path: C, stem: C) -> Column:
    out = F.lit("Module index")
    for s, role in STEM_ROLES.items():
        out = F.when(col(stem) == s, role).otherwise(out)
    for hint, role in reversed(ROLE_HINTS):
        out = F.when(F.contains(F.lower(col(path)), F.lit(hint)), role).otherwise(out)
    return out
