"""Snapshots of a project: a Parquet table of (path, hash, symbols) and a header beside it.

A snapshot is written into a new folder and then named by the header, so that a reader
of the old one is never overwritten and a failed write leaves the old one in place.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lodestone.model import SNAPSHOT
from lodestone.sources.listing import current_commit, is_known_commit

VERSION, HEADER = "1.0", "header.json"


def snapshot_dir(project: str | Path, base: str | Path | None = None) -> Path:
    """A folder of its own for each project, named by a hash of its absolute path."""
    top = Path(base) if base else Path.home() / ".cache" / "lodestone"
    out = top / hashlib.sha256(str(Path(project).resolve()).encode()).hexdigest()[:16]
    out.mkdir(parents=True, exist_ok=True)
    return out


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SNAPSHOT)


def read_header(at: Path) -> dict | None:
    try:
        out = json.loads((at / HEADER).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None
    return out if isinstance(out, dict) and isinstance(out.get("table"), str) else None


def load(spark: SparkSession, project: str | Path, base: str | Path | None = None) -> DataFrame | None:
    """The last snapshot; None where there is none, it is damaged, or its commit is gone."""
    at = snapshot_dir(project, base)
    header = read_header(at)
    if not header or not is_known_commit(project, header.get("base_commit")):
        return None
    try:
        table = spark.read.schema(SNAPSHOT).parquet(str(at / header["table"]))
        table.limit(1).count()
    except Exception:  # noqa: BLE001  a damaged snapshot is a cold start
        return None
    return table


def save(df: DataFrame, project: str | Path, base: str | Path | None = None) -> None:
    at = snapshot_dir(project, base)
    old = (read_header(at) or {}).get("table")
    name = f"files-{uuid.uuid4().hex[:12]}"
    df.select(*SNAPSHOT.names).write.parquet(str(at / name))
    header = {"version": VERSION, "last_run": datetime.now(timezone.utc).isoformat(), "base_commit": current_commit(project), "table": name}
    staged = at / f"{HEADER}.{uuid.uuid4().hex[:6]}"
    staged.write_text(json.dumps(header), encoding="utf-8")
    os.replace(staged, at / HEADER)
    if old and old != name:
        shutil.rmtree(at / old, ignore_errors=True)
