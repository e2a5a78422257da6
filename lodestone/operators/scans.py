"""Scans of a project's files: environment variables, entry points, root files, config, CI and test directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import scalars as S
from lodestone.functions.globs import any_of
from lodestone.functions.paths import dirname, stem
from lodestone.functions.predicates import ENTRY_STEMS, entry_role, is_test

MOST_ROOT_FILES = 30
# Globs of CI files, config files and test directories, in the order in which they are listed.
CI_FILES = [".github/workflows/*.yml", ".github/workflows/*.yaml", ".gitlab-ci.yml", "Jenkinsfile", ".circleci/config.yml", "azure-pipelines.yml", ".travis.yml", "bitbucket-pipelines.yml"]
CONFIG_FILES = [
    ".editorconfig", ".eslintrc*", ".eslintrc.json", ".eslintrc.js", ".eslintrc.yml", "eslint.config.*", ".prettierrc*", ".prettierrc",
    "prettier.config.*", "tsconfig.json", "tsconfig*.json", ".stylelintrc*", "jest.config.*", "vitest.config.*", "pytest.ini",
    "pyproject.toml", ".flake8", "mypy.ini", ".mypy.ini", "rustfmt.toml", ".rustfmt.toml", ".golangci.yml", ".golangci.yaml",
]
TEST_DIRS = ["test", "tests", "spec", "specs", "__tests__", "*.Tests", "*.Test", "*.Specs"]
TEST_DIR_SUFFIXES = [".tests", ".test", ".specs", ".spec"]


def _segment_regex(glob: str) -> str:
    import re

    return "".join("[^/]*" if c == "*" else re.escape(c) for c in glob)


def env_vars(files: DataFrame, subscripts: bool = False) -> DataFrame:
    """(name): sorted distinct variables that sources read or sample files at the root set."""
    text = files.withColumn("__t", S.decoded("content"))
    read = text.filter("language IS NOT NULL").select(F.explode(S.env_vars("__t", "language", subscripts)).alias("name"))
    lines = text.filter(F.col("path").isin(S.ENV_FILES)).select(F.explode(F.split("__t", r"\r\n?|\n")).alias("line"))
    set_ = lines.select(S.first_match(F.trim("line"), S.ENV_LINE).alias("name")).filter("name IS NOT NULL")
    return read.unionByName(set_).distinct().orderBy("name")


def entry_points(files: DataFrame, path: str = "path") -> DataFrame:
    """(file, role): one file of each directory and stem that looks like an entry point, by path."""
    cand = files.filter(F.lower(stem(path)).isin(ENTRY_STEMS) & ~is_test(path))
    low = cand.select(F.col(path).alias("file"), dirname(path).alias("__dir"), F.lower(stem(path)).alias("__stem"))
    first = low.groupBy("__dir", "__stem").agg(F.min("file").alias("file"))
    return first.select("file", entry_role("file", "__stem").alias("role")).orderBy("file")


def listed(paths: DataFrame, globs: list[str], path: str = "path") -> DataFrame:
    """(position, path): paths by the first glob they match, each once."""
    at = F.lit(None).cast("int")
    for i, g in reversed(list(enumerate(globs))):
        at = F.when(F.col(path).rlike(any_of([_segment_regex(g)])), i).otherwise(at)
    return paths.select(at.alias("position"), F.col(path).alias("path")).filter("position IS NOT NULL").distinct().orderBy("position", "path")


def root_files(files: DataFrame) -> DataFrame:
    return files.filter((dirname("path") == ".") & ~F.startswith("path", F.lit("."))).select("path").orderBy("path").limit(MOST_ROOT_FILES)


def test_directories(files: DataFrame) -> DataFrame:
    """(position, path) of directories at the root that are named as tests; a closing slash marks them."""
    top = files.filter(F.contains("path", F.lit("/"))).select(F.substring_index("path", "/", 1).alias("path")).distinct()
    exact = listed(top, TEST_DIRS)
    loose = top.filter(F.lower("path").rlike(any_of([_segment_regex("*" + s) for s in TEST_DIR_SUFFIXES]))).select(F.lit(len(TEST_DIRS)).alias("position"), "path")
    both = exact.unionByName(loose).groupBy("path").agg(F.min("position").alias("position"))
    return both.select("position", F.concat("path", F.lit("/")).alias("path")).orderBy("position", "path")


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the first by ``order``."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
