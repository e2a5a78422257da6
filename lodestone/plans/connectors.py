"""Pointer files: a line in each agent's own file that leads to the output document."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Connector:
    agent_id: str
    file_path: str
    template: str
    markers: tuple[str, ...] = ()


_SEE, _REFER = "See {file} for project context and rules.", "Always refer to {file} for codebase rules and architecture."
# The known agents, their files and their lines.
CONNECTORS = [
    Connector("claude", "CLAUDE.md", "@{file}", (".claude",)),
    Connector("gemini", ".gemini/GEMINI.md", "@{file}", (".gemini",)),
    Connector("cursor", ".cursorrules", _SEE, (".cursor",)),
    Connector("windsurf", ".windsurfrules", _SEE, (".windsurf",)),
    Connector("copilot", ".github/copilot-instructions.md", _REFER, (".github",)),
    Connector("codex", ".github/copilot-instructions.md", _REFER),
    Connector("cline", ".clinerules", _SEE),
    Connector("roo-code", ".clinerules", _SEE),
    Connector("codeium", ".codeiumrules", _SEE),
]


def connector_for(client: str | None) -> Connector | None:
    """The first agent whose id is in the client's name."""
    name = (client or "").lower()
    return next((c for c in CONNECTORS if c.agent_id in name), None) if name else None


def frame(spark: SparkSession) -> DataFrame:
    """The agents as a dimension (ordinal, agent_id, file_path, template, markers)."""
    return spark.createDataFrame([(i, c.agent_id, c.file_path, c.template, list(c.markers)) for i, c in enumerate(CONNECTORS)], "ordinal int, agent_id string, file_path string, template string, markers array<string>")


def match(clients: DataFrame, known: DataFrame, name: str = "name") -> DataFrame:
    """(name, agent_id, file_path) of each client: a containment join with the dimension, first agent first."""
    hits = clients.select(name).distinct().join(F.broadcast(known), F.contains(F.lower(name), F.col("agent_id")))  # the dimension has nine rows
    best = hits.groupBy(name).agg(F.min_by(F.struct("agent_id", "file_path"), "ordinal").alias("c"))
    return best.select(name, "c.agent_id", "c.file_path")


def apply(root: Path, c: Connector, output: str) -> bool:
    """Create the agent's file with the line, or put the line on top where it is absent; True if something was written."""
    at, line = root / c.file_path, c.template.format(file=output)
    try:
        if not at.exists():
            at.parent.mkdir(parents=True, exist_ok=True)
            at.write_text(line + "\n", encoding="utf-8")
            return True
        text = at.read_text(encoding="utf-8")
        if line in text:
            return False
        at.write_text(f"{line}\n\n{text}", encoding="utf-8")
        return True
    except OSError:
        return False


def setup(root: Path, output: str, client: str | None = None) -> list[str]:
    """Write the lines of the client's agent and of those whose markers the project has; returns the files written."""
    chosen = {c.agent_id: c for c in CONNECTORS if any((root / m).exists() for m in c.markers)}
    if own := connector_for(client):
        chosen[own.agent_id] = own
    return [c.file_path for c in chosen.values() if apply(root, c, output)]
