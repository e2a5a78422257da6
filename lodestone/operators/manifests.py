"""Manifests of build tools: package.json, pyproject.toml, Makefile, go.mod, *.csproj, from a frame of files (path, content)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.scalars import decoded, dependency_name, strip
from lodestone.model import S, TEXTS, struct

# Markers of each build system, in the order in which they are tried; globs over the root, or ``**/`` anywhere.
BUILD_MARKERS = [
    ("dotnet", ["*.sln", "**/*.csproj", "global.json", "Directory.Build.props"]),
    ("npm", ["package.json"]),
    ("go", ["go.mod"]),
    ("make", ["Makefile", "makefile", "GNUmakefile"]),
    ("python", ["pyproject.toml", "setup.py", "setup.cfg", "Pipfile"]),
    ("rust", ["Cargo.toml"]),
    ("maven", ["pom.xml"]),
    ("gradle", ["build.gradle", "build.gradle.kts"]),
    ("ruby", ["Gemfile"]),
]
# References that are the framework's own.
SYSTEM_REFERENCES = ["System", "Microsoft.", "mscorlib", "PresentationCore", "WindowsBase"]
MOST_PACKAGES, MOST_TARGETS, COMMON = 15, 20, 0.5


def _marked(path: Column, marker: str) -> Column:
    if marker.startswith("**/*"):
        return F.endswith(path, F.lit(marker[4:]))
    if marker.startswith("*"):
        return F.endswith(path, F.lit(marker[1:])) & ~F.contains(path, F.lit("/"))
    return path == marker


def build_systems(files: DataFrame) -> DataFrame:
    """(position, system, file): for each system the files of its first marker that has any."""
    hits = F.filter(
        F.array(*[F.when(_marked(F.col("path"), m), F.struct(F.lit(i).alias("position"), F.lit(s).alias("system"), F.lit(j).alias("marker"))) for i, (s, ms) in enumerate(BUILD_MARKERS) for j, m in enumerate(ms)]),
        lambda h: h.isNotNull(),
    )
    found = files.select("path", F.explode(hits).alias("h")).select("path", "h.*")
    first = F.min("marker").over(Window.partitionBy("position"))  # markers are few files
    return found.withColumn("__first", first).filter("marker = __first").select("position", "system", F.col("path").alias("file"))


def at_root(files: DataFrame, *names: str) -> DataFrame:
    return files.filter(F.col("path").isin(*names))


def package_json(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with scripts MAP, packages ARRAY (sorted names of both kinds of dependencies) and package_manager; invalid JSON gives nulls."""
    parsed = F.from_json(F.col(content).cast("string"), "scripts map<string,string>, dependencies map<string,string>, devDependencies map<string,string>, packageManager string")
    none = F.array().cast("array<string>")
    names = F.array_sort(F.array_union(F.coalesce(F.map_keys("__j.dependencies"), none), F.coalesce(F.map_keys("__j.devDependencies"), none)))
    return df.withColumn("__j", parsed).select(*df.columns, F.col("__j.scripts").alias("scripts"), names.alias("packages"), F.nullif(F.substring_index(F.col("__j.packageManager"), "@", 1), F.lit("")).alias("package_manager"))


@F.pandas_udf(struct(scripts=TEXTS, requirements=TEXTS))
def _toml(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    import tomllib

    for batch in texts:
        rows = []
        for text in batch:
            try:
                project = tomllib.loads(text or "").get("project", {})
                extra = [d for ds in project.get("optional-dependencies", {}).values() for d in ds]
                rows.append((list(project.get("scripts", {})), [str(d) for d in [*project.get("dependencies", []), *extra]]))
            except (tomllib.TOMLDecodeError, AttributeError, TypeError):
                rows.append((None, None))
        yield pd.DataFrame(rows, columns=["scripts", "requirements"])


def pyproject(df: DataFrame, lock: Column, content: str = "content") -> DataFrame:
    """``df`` with runner, scripts MAP and packages ARRAY of pyproject.toml; ``lock``: 'uv', 'poetry' or null."""
    runner = F.when(lock == "uv", "uv run").when(lock == "poetry", "poetry run").otherwise("python")
    parsed = df.withColumn("__t", _toml(F.col(content).cast("string"))).withColumn("runner", runner)
    deps = F.transform("__t.requirements", dependency_name)
    own = F.transform("__t.scripts", lambda s: F.struct(s.alias("key"), F.when(F.col("runner") != "python", F.concat("runner", F.lit(" "), s)).otherwise(s).alias("value")))
    pair = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    one = lambda cond, e: F.when(F.coalesce(cond, F.lit(False)), F.array(e)).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    test = F.when(F.array_contains(deps, "pytest"), F.concat("runner", F.lit(" pytest"))).when(F.array_contains(deps, "unittest"), F.concat("runner", F.lit(" python -m unittest")))
    install = one(F.col("runner") != "python", pair("install", F.when(F.col("runner") == "uv run", "uv sync").otherwise("poetry install")))
    entries = F.concat(install, own, one(test.isNotNull(), pair("test", test)))
    # the last of equal names wins
    unique = F.filter(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), e["value"].alias("value"), i.alias("i"))), lambda e: ~F.exists(F.slice(entries, e["i"] + 2, F.size(entries)), lambda x: x["key"] == e["key"]))
    scripts = F.map_from_entries(F.transform(unique, lambda e: F.struct(e["key"], e["value"])))
    return parsed.select(*df.columns, "runner", F.when(F.size(entries) > 0, scripts).alias("scripts"), F.array_sort(F.array_distinct(deps)).alias("packages"))


def make_targets(df: DataFrame, keys: list[str], text: str, most: int = MOST_TARGETS) -> DataFrame:
    """(keys, position, target): the first targets of each text.

    A line that starts with neither tab nor ``#`` and holds a colon; before it one word that doesn't start with a dot.
    """
    lines = F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), "\n")
    plain = F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("\t")) & ~F.startswith(x, F.lit("#")) & F.contains(x, F.lit(":")))
    names = F.transform(plain, lambda x: strip(F.substring_index(x, ":", 1)))
    good = F.slice(F.filter(names, lambda n: (n != "") & ~F.startswith(n, F.lit(".")) & ~F.contains(n, F.lit(" "))), 1, most)
    return df.select(*keys, F.posexplode(good).alias("position", "target"))


def go_requires(df: DataFrame, content: str = "content") -> Column:
    """Sorted module paths that a go.mod requires directly; blocks and single lines, repeats kept."""
    text = F.regexp_replace(F.col(content).cast("string"), r"\r\n?", "\n")
    blocks = F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*require \([^\n]*\n([\s\S]*?)(?:^[ \t]*\)[ \t]*$|\z)"), F.lit(1))
    inside = F.filter(F.transform(F.flatten(F.transform(blocks, lambda b: F.split(b, "\n"))), strip), lambda x: (x != "") & ~F.startswith(x, F.lit("//")))
    outside = F.split(F.regexp_replace(text, r"(?m)^[ \t]*require \([^\n]*\n[\s\S]*?(?:^[ \t]*\)[ \t]*$|\z)", ""), "\n")
    single = F.transform(F.filter(F.transform(outside, strip), lambda x: F.startswith(x, F.lit("require ")) & ~F.contains(x, F.lit("("))), lambda x: F.regexp_replace(x, r"^require\s+", ""))
    direct = F.filter(F.concat(inside, single), lambda x: ~F.contains(x, F.lit("// indirect")))
    return F.array_sort(F.filter(F.transform(direct, lambda x: F.regexp_extract(x, r"^(\S+)", 1)), lambda x: x != ""))


@F.pandas_udf(struct(target_framework=S, output_type=S, packages=TEXTS, hinted=TEXTS, project_references=TEXTS, sound=T.BooleanType()))
def _project_xml(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    import xml.etree.ElementTree as ET

    def local(node: ET.Element) -> str:
        return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""

    for batch in texts:
        rows = []
        for text in batch:
            try:
                nodes: dict[str, list[ET.Element]] = {}
                for node in ET.fromstring((text or "").lstrip("\ufeff")).iter():
                    nodes.setdefault(local(node), []).append(node)
            except ET.ParseError:
                rows.append((None, None, None, None, None, False))
                continue
            first = lambda tag: (nodes[tag][0].text or "").strip() or None if tag in nodes else None
            named = lambda tag: [v for n in nodes.get(tag, []) if (v := n.get("Include") or n.get("include"))]
            hinted = [n.get("Include", "") for n in nodes.get("Reference", []) if any(local(c) == "HintPath" for c in n.iter())]
            target = first("TargetFramework") or first("TargetFrameworks") or first("TargetFrameworkVersion")
            rows.append((target, first("OutputType"), named("PackageReference"), hinted, named("ProjectReference"), True))
        yield pd.DataFrame(rows, columns=["target_framework", "output_type", "packages", "hinted", "project_references", "sound"])


def csproj(df: DataFrame, content: str = "content") -> DataFrame:
    """(file, target_framework, output_type, packages, project_references) of project files, whatever their namespace; broken XML goes.

    Without package references, references with a hint path count, less the framework's own.
    """
    parsed = df.select("path", _project_xml(F.col(content).cast("string")).alias("x")).filter("x.sound")
    names = F.transform("x.hinted", lambda v: F.trim(F.substring_index(v, ",", 1)))
    own = "^(?:" + "|".join(p.replace(".", "\\.") for p in SYSTEM_REFERENCES) + ")"
    foreign = F.filter(names, lambda v: (v != "") & ~v.rlike(own))
    return parsed.select(
        F.col("path").alias("file"),
        "x.target_framework",
        "x.output_type",
        F.slice(F.when(F.size("x.packages") > 0, F.col("x.packages")).otherwise(foreign), 1, MOST_PACKAGES).alias("packages"),
        F.transform("x.project_references", lambda v: F.translate(v, "\\", "/")).alias("project_references"),
    )


def common_packages(df: DataFrame, project: str, package: str, share: float = COMMON) -> DataFrame:
    """(package, n): packages that at least ``share`` of the projects have, where there is more than one project."""
    pairs = df.select(project, package).distinct()
    total = df.agg(F.count_distinct(project).alias("__n"))  # one row
    counts = pairs.groupBy(package).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total)).filter((F.col("__n") > 1) & (F.col("n") >= F.col("__n") * F.lit(share))).select(package, "n")


def remaining_packages(df: DataFrame, common: DataFrame, package: str) -> DataFrame:
    return df.join(common.select(package), package, "left_anti")


def text_of(files: DataFrame) -> DataFrame:
    return files.withColumn("content", decoded("content"))
