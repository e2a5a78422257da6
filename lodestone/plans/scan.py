"""Scans of a project: cold or against the last snapshot."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.config import load_config
from lodestone.operators import changes as C
from lodestone.plans import connectors, payload
from lodestone.sources import parse, snapshot, tree


#: Paths that are opened where the listing alone is asked for: none, and those of manifests.
NOTHING, MANIFESTS = r"[^\s\S]", r"^[^/]+\Z|\.csproj\Z"


def _existing(spark: SparkSession, root: Path, old: DataFrame) -> DataFrame:
    """Snapshot rows with ``exists``: whether the file is still on disk, whatever the filters say."""
    listing = tree.read_tree(spark, str(root), read=NOTHING).select("path", F.lit(True).alias("exists"))
    return old.join(listing, "path", "left")


def scan(spark: SparkSession, project: str = ".", force_full: bool = True, with_context: bool = False, base: str | Path | None = None) -> dict:
    """Scan a project, write its payload and its next snapshot; returns status and number of pages.

    With ``force_full`` the last snapshot is ignored.  Only new and modified files are parsed.
    """
    root = Path(project).expanduser().resolve()
    if not root.is_dir():
        return {"error": f"Not a directory: {root}"}
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("give base: a folder that driver and executors share")
    config = load_config(root)
    at = snapshot.snapshot_dir(root, base)
    old = None if force_full else snapshot.load(spark, root, base)

    kept: list[DataFrame] = []

    def once(df: DataFrame) -> DataFrame:
        kept.append(df.cache())
        return df

    try:
        scanned = once(tree.scanned_files(spark, str(root), config))  # every file is opened here, and only here
        current = tree.source_files(spark, str(root), config, scanned)
        if old is None:
            changed = C.cold_start(current)
        else:
            changed = C.detect_changes(current, _existing(spark, root, old), still_there="exists")
        changed = once(changed)
        if changed.isEmpty():
            return {"status": "no_changes", "total_chunks": 0}
        todo = current.join(changed.filter("status != 'deleted'").select("path"), "path", "left_semi")
        analyses = once(parse.parse(todo))
        files = tree.project_files(spark, str(root), config, scanned)
        listing = once(tree.read_tree(spark, str(root), read=MANIFESTS))
        result = payload.build(root, config, files, listing, changed, analyses, old, with_context)
        fresh = C.snapshot_rows(current, analyses)
        snapshot.save(C.merge_snapshot(old if old is not None else snapshot.empty(spark), changed, fresh), root, base)
        return {"status": "ready", "total_chunks": payload.write(result, at)}
    finally:
        for df in kept:
            df.unpersist()


def read_payload_chunk(project: str = ".", chunk_index: int = 0, base: str | Path | None = None) -> dict:
    return payload.read_chunk(snapshot.snapshot_dir(Path(project).expanduser().resolve(), base), chunk_index)


def generate(spark: SparkSession, project: str = ".", client: str | None = None, base: str | Path | None = None) -> dict:
    """An incremental scan with the output document's context, and the pointer files of the agents in use."""
    root = Path(project).expanduser().resolve()
    if not root.is_dir():
        return {"error": f"Not a directory: {root}"}
    output = load_config(root).output_path.removeprefix("./")
    written = connectors.setup(root, output, client)
    out = scan(spark, str(root), force_full=False, with_context=True, base=base)
    return out | {"output_path": str(root / output), "connectors": written}
