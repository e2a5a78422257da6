"""``srctree``: a source tree as a table (path, size_bytes, hash, content, tracked).

The listing is made on the driver, where the options' path filters (exclude, ignore files,
include, extensions, size) drop files before any is opened, and dealt to partitions by
bytes; executors read and hash what is left.  The option ``read`` is a regular expression
of the paths to open: others give a row of path and size alone.  A file that can't be
read gives a row without content.  ``content`` may be left out (option ``content`` = false).
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from lodestone.config import ScanConfig
from lodestone.functions import globs
from lodestone.functions.paths import language
from lodestone.model import FILE
from lodestone.sources.listing import git_files, project_rules, walk

#: Bytes and files of one partition.
PART_BYTES, PART_FILES = 32 << 20, 2000


@dataclass
class Files(InputPartition):
    root: str
    rows: list[tuple[str, int, bool]]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = os.path.abspath(options["path"])
        self.only_tracked = options.get("tracked_only", "false") == "true"
        self.content = options.get("content", "true") == "true"
        self.most = int(options.get("max_bytes", "-1"))
        self.exclude, self.include, self.extensions = (json.loads(options.get(k, "[]")) for k in ("exclude", "include", "extensions"))
        self.ignore = options.get("ignore", "false") == "true"
        self.opened = re.compile(options.get("read", ""))

    def listed(self) -> Iterator[tuple[str, bool]]:
        """Paths that the options' filters leave, and whether each is tracked."""
        tracked = git_files(self.root)
        known = set(tracked or ())
        every = walk(self.root) if self.ignore or tracked is None or not self.only_tracked else []
        paths = tracked if self.only_tracked and tracked is not None else every
        left_out, rules = globs.excludes(self.exclude), globs.ignores(project_rules(self.root, every)) if self.ignore else None
        wanted = re.compile(globs.any_of([globs.shell_regex(g) for g in self.include]).replace(r"\z", r"\Z")) if self.include else None
        for p in paths:
            if self.extensions and not p.lower().endswith(tuple(self.extensions)):
                continue
            if (wanted and not wanted.search(p)) or left_out(p) or (rules and p not in known and rules(p)):
                continue
            yield p, p in known or tracked is None

    def partitions(self) -> list[Files]:
        out, rows, held = [], [], 0
        for p, tracked in self.listed():
            try:
                size = os.stat(os.path.join(self.root, p)).st_size
            except OSError:
                continue
            if 0 <= self.most < size:
                continue
            rows.append((p, size, tracked))
            held += size if self.opened.search(p) else 0
            if held >= PART_BYTES or len(rows) >= PART_FILES:
                out.append(Files(self.root, rows))
                rows, held = [], 0
        return [*out, Files(self.root, rows)] if rows or not out else out

    def read(self, part: Files) -> Iterator[tuple]:
        for path, size, tracked in part.rows:
            try:
                if not self.opened.search(path):
                    yield path, size, None, None, tracked
                    continue
                with open(os.path.join(part.root, path), "rb") as f:
                    raw = f.read()
            except OSError:
                yield path, size, None, None, tracked
                continue
            yield path, size, hashlib.sha256(raw).hexdigest(), raw if self.content else None, tracked


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "srctree"

    def schema(self) -> StructType:
        return FILE

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, content: bool = True, tracked_only: bool = False, max_bytes: int = -1, exclude: Iterable[str] = (), include: Iterable[str] = (), extensions: Iterable[str] = (), ignore: bool = False, read: str = "") -> DataFrame:
    """The files of a tree that the filters leave; those left out are never opened.

    ``ignore``: leave out untracked files that ignore files name; ``read``: expression of the paths to open.
    """
    spark.dataSource.register(TreeSource)
    flags = {"tracked_only": tracked_only, "content": content, "ignore": ignore}
    lists = {"exclude": exclude, "include": include, "extensions": extensions}
    options = {k: str(v).lower() for k, v in flags.items()} | {k: json.dumps(list(v)) for k, v in lists.items()}
    return spark.read.format("srctree").options(**options, max_bytes=max_bytes, read=read).load(root)


def scanned_files(spark: SparkSession, root: str, config: ScanConfig) -> DataFrame:
    """What a scan may look into, read once: files that aren't excluded, tracked or not ignored."""
    return read_tree(spark, root, exclude=config.exclude, ignore=True)


def project_files(spark: SparkSession, root: str, config: ScanConfig, scanned: DataFrame | None = None) -> DataFrame:
    """Files that aren't ignored or excluded, with their language (null for other files)."""
    files = scanned if scanned is not None else scanned_files(spark, root, config)
    return files.filter(~globs.ignored("path", project_rules(root))).withColumn("language", language("path", config.extensions()))


def source_files(spark: SparkSession, root: str, config: ScanConfig, scanned: DataFrame | None = None) -> DataFrame:
    """Files to parse: tracked ones, or all that aren't ignored outside a repository; by globs, language and size."""
    most = config.max_file_size_bytes
    if scanned is None:
        tracked = git_files(root) is not None
        kept = read_tree(spark, root, tracked_only=tracked, max_bytes=most, exclude=config.exclude, include=config.include, extensions=config.extensions(), ignore=not tracked)
    else:
        kept = scanned.filter("tracked").filter(globs.included("path", config.include) & (F.lit(most < 0) | (F.col("size_bytes") <= most)))
    return kept.withColumn("language", language("path", config.extensions())).filter("language IS NOT NULL AND hash IS NOT NULL")
