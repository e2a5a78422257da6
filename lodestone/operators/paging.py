"""Paging of a text: by lines, or by bytes where it has few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.paths import C, col

LINES, BYTES, COMPACT_CHARS, FEW_BREAKS = 500, 50_000, 300_000, 5


def is_compact(text: C) -> Column:
    return F.regexp_count(col(text), F.lit("\n")) < FEW_BREAKS


def lines_of(text: C) -> Column:
    """Lines without a last empty one."""
    return F.split(F.regexp_replace(col(text), r"\n\z", ""), "\n")


def chunk_count(text: C, compact: Column | None = None) -> Column:
    """How many chunks a text has, one at least."""
    compact = is_compact(text) if compact is None else compact
    by_bytes = F.ceil(F.octet_length(col(text)) / BYTES)
    by_lines = F.ceil(F.size(lines_of(text)) / LINES)
    return F.greatest(F.when(compact, by_bytes).otherwise(by_lines), F.lit(1)).cast("int")


def line_pages(df: DataFrame, keys: list[str], text: str, lines: int = LINES) -> DataFrame:
    """(keys, chunk, content): pages of whole lines, cut within each row."""
    pages = df.select(*keys, lines_of(text).alias("__l")).select(*keys, "__l", F.explode(F.sequence(F.lit(0), ((F.size("__l") - 1) / lines).cast("int"))).alias("chunk"))
    return pages.select(*keys, "chunk", F.array_join(F.slice("__l", F.col("chunk") * lines + 1, F.lit(lines)), "\n").alias("content"))


def byte_pages(df: DataFrame, keys: list[str], text: str, size: int = BYTES) -> DataFrame:
    """(keys, chunk, content BINARY): pages of ``size`` bytes, cut within each row."""
    raw = df.select(*keys, F.col(text).cast("binary").alias("__b"))
    last = F.greatest(F.ceil(F.octet_length("__b") / size).cast("int") - 1, F.lit(0))
    return raw.select(*keys, "__b", F.explode(F.sequence(F.lit(0), last)).alias("chunk")).select(*keys, "chunk", F.expr(f"substring(__b, chunk * {size} + 1, {size})").alias("content"))
