"""Listings of a project on the driver: tracked files by git, or a walk of the folders."""

from __future__ import annotations

import os
import subprocess
from pathlib import Path

from lodestone.functions.globs import Rule, ignore_rules

IGNORE_FILE, GIT_TIMEOUT, COMMIT_TIMEOUT = ".gitignore", 30, 10


def git_files(root: str | Path) -> list[str] | None:
    """Tracked files; None without git, outside a repository, or too late."""
    try:
        out = subprocess.run(["git", "ls-files", "-z"], cwd=root, capture_output=True, timeout=GIT_TIMEOUT)
    except (OSError, subprocess.TimeoutExpired):
        return None
    if out.returncode:
        return None
    return sorted(p.replace("\\", "/") for p in out.stdout.decode("utf-8", "replace").split("\0") if p)


def walk(root: str | Path) -> list[str]:
    """All files below ``root`` but git's own, by path."""
    out = []
    for d, dirs, files in os.walk(root):
        dirs[:] = [x for x in dirs if x != ".git"]
        out += [os.path.relpath(os.path.join(d, f), root).replace(os.sep, "/") for f in files]
    return sorted(out)


def project_rules(root: str | Path, paths: list[str] | None = None) -> list[Rule]:
    """The rules of all ignore files of a project, each scoped to its folder."""
    files = []
    for p in paths if paths is not None else walk(root):
        if p.rpartition("/")[2] == IGNORE_FILE:
            try:
                files.append((p.rpartition("/")[0] or ".", (Path(root) / p).read_text(encoding="utf-8", errors="replace")))
            except OSError:
                continue
    return ignore_rules(files)


def _git(root: str | Path, *args: str) -> str | None:
    try:
        out = subprocess.run(["git", *args], cwd=root, capture_output=True, text=True, timeout=COMMIT_TIMEOUT)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return out.stdout.strip() if out.returncode == 0 else None


def current_commit(root: str | Path) -> str | None:
    return _git(root, "rev-parse", "HEAD") or None


def is_known_commit(root: str | Path, commit: str | None) -> bool:
    """Whether a snapshot's base commit still exists; snapshots without one are valid."""
    return commit is None or _git(root, "cat-file", "-t", commit) == "commit"
