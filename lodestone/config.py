"""Options of a scan: size profiles, globs, languages and caps, read on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class SizeProfile:
    name: str
    max_methods_per_symbol: int
    max_symbols_per_file: int
    dir_aggregation_threshold: int
    max_files_per_layer: int
    max_route_controllers: int
    max_routes_per_controller: int
    max_go_handlers: int
    max_dir_depth: int
    impact_filter: str


# The three profiles.
PROFILES = {
    "small": SizeProfile("small", 30, 40, 20, 15, 30, 15, 15, 4, "medium"),
    "medium": SizeProfile("medium", 12, 20, 10, 8, 15, 8, 8, 3, "medium"),
    "large": SizeProfile("large", 8, 10, 5, 5, 10, 5, 5, 2, "high"),
}

# Globs that are left out by default.
DEFAULT_EXCLUDE = [
    "**/node_modules/**", "**/bin/**", "**/obj/**", "**/.git/**", "**/dist/**", "**/build/**", "**/__pycache__/**",
    "**/*.min.js", "**/*.min.css", "**/*.bundle.js", "**/vendor/**", "**/packages/**", "**/.venv/**", "**/venv/**",
    "**/bower_components/**", "**/app/lib/**", "**/wwwroot/lib/**", "**/wwwroot/libs/**", "**/static/vendor/**",
    "**/public/vendor/**", "**/assets/vendor/**", "**/site-packages/**",
]

# Extensions and their languages.
LANGUAGES = {".py": "python", ".cs": "c_sharp", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript", ".go": "go"}

CONFIG_FILE = "lodestone.config.json"


@dataclass(frozen=True)
class ScanConfig:
    exclude: tuple[str, ...] = tuple(DEFAULT_EXCLUDE)
    include: tuple[str, ...] = ()
    languages: str | tuple[str, ...] = "auto"
    project_size: str = "medium"
    output_path: str = "./AGENTS.md"
    max_file_size_bytes: int = 1_048_576
    env_subscripts: bool = False
    profile: SizeProfile = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "profile", PROFILES.get(self.project_size, PROFILES["medium"]))

    @property
    def allowed(self) -> set[str] | None:
        """Languages to keep, or None for all that are known."""
        if self.languages == "auto":
            return None
        return {self.languages} if isinstance(self.languages, str) else set(self.languages)

    def extensions(self) -> dict[str, str]:
        return {e: lang for e, lang in LANGUAGES.items() if self.allowed is None or lang in self.allowed}


_KEYS = {"exclude": list, "include": list, "languages": (str, list), "project_size": str, "agents_md_path": str, "max_file_size_bytes": int, "env_subscripts": bool}


def load_config(project: str | Path, file: str = CONFIG_FILE) -> ScanConfig:
    """Defaults, overlaid by the project's file; a missing, unreadable, non-object or mistyped file or value leaves the default."""
    try:
        raw = json.loads((Path(project) / file).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return ScanConfig()
    if not isinstance(raw, dict):
        return ScanConfig()
    good = {k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in _KEYS and isinstance(v, _KEYS[k]) and isinstance(v, bool) == (_KEYS[k] is bool)}
    if "agents_md_path" in good:
        good["output_path"] = good.pop("agents_md_path")
    return ScanConfig(**good)


def profiles_frame(spark: SparkSession) -> DataFrame:
    """The profiles as a dimension of three rows."""
    fields = list(SizeProfile.__dataclass_fields__)
    return spark.createDataFrame([tuple(getattr(p, f) for f in fields) for p in PROFILES.values()], fields)
