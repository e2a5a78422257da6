"""Parsing as a table function: files (path, language, content) to one row of symbols each.

``parse`` runs Arrow batches through the extractors; a file that can't be parsed gives a
row with its error and never fails the task.  ``ExtractSymbols`` is the same as a UDTF
for LATERAL joins in SQL, one row a symbol.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.model import ANALYSIS, SYMBOL
from lodestone.sources.extract import extractor


def analyse(path: str, language: str, content: bytes | None) -> tuple:
    """A row of ``model.ANALYSIS``."""
    run = extractor(language)
    if run is None or content is None:
        return path, language, [], [], [], "unsupported language" if content is not None else "unreadable"
    try:
        got = run(bytes(content).decode("utf-8", "replace").removeprefix("﻿"))
    except Exception as e:  # noqa: BLE001  one bad file must not end the scan
        return path, language, [], [], [], f"{type(e).__name__}: {e}"[:200]
    symbols = [
        (i, s.name, s.kind, s.visibility, s.signature.strip() if s.signature else s.signature, s.decorators, s.implements, s.parent, s.line_start, s.line_end)
        for i, s in enumerate(got.symbols)
    ]
    return path, language, got.imports, got.exports, symbols, None


def parse(files: DataFrame) -> DataFrame:
    """(path, language, imports, exports, symbols, error) of each file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [analyse(*r) for r in zip(batch["path"], batch["language"], batch["content"], strict=True)]
            out = pd.DataFrame(rows, columns=ANALYSIS.names)
            names = SYMBOL.names
            out["symbols"] = [[dict(zip(names, s, strict=True)) for s in row] for row in out["symbols"]]
            yield out

    return files.select("path", "language", "content").mapInPandas(run, ANALYSIS)


class ExtractSymbols:
    def eval(self, path: str, language: str, content: bytes | None) -> Iterator[tuple]:
        for s in analyse(path, language, content)[4]:
            yield s


def register(spark: SparkSession, name: str = "extract_symbols") -> None:
    """Make the table function known to SQL: ``SELECT ... FROM files, LATERAL extract_symbols(path, language, content)``."""
    spark.udtf.register(name, F.udtf(ExtractSymbols, returnType=SYMBOL))
