"""Extractors: from a file's bytes to its imports, exports and symbols."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Symbol:
    name: str
    kind: str
    visibility: str | None = "public"
    signature: str | None = None
    decorators: list[str] = field(default_factory=list)
    implements: list[str] = field(default_factory=list)
    parent: str | None = None
    line_start: int = 0
    line_end: int = 0


@dataclass
class Analysis:
    imports: list[str] = field(default_factory=list)
    exports: list[str] = field(default_factory=list)
    symbols: list[Symbol] = field(default_factory=list)


def extractor(language: str):
    """The extractor of a language; None for others."""
    if language == "python":
        from lodestone.sources.extract.python import extract
    elif language == "go":
        from lodestone.sources.extract.go import extract
    elif language == "c_sharp":
        from lodestone.sources.extract.csharp import extract
    elif language in ("typescript", "javascript"):
        from lodestone.sources.extract.typescript import extract
    else:
        return None
    return extract
