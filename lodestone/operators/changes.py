"""Change detection and snapshots: what is new, modified or gone, and the next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def detect_changes(current: DataFrame, snapshot: DataFrame, key: str = "path", hash_: str = "hash", still_there: str | None = None) -> DataFrame:
    """(key, status, old_hash, new_hash): one full outer join on the key.

    Only in ``current``: new; only in ``snapshot``: deleted; another hash: modified; equal
    ones are left out.  ``still_there``: a column of ``snapshot`` that says a key exists
    though it isn't in ``current`` (excluded or untracked); such keys aren't deleted.
    """
    there = F.coalesce(F.col(still_there), F.lit(False)) if still_there else F.lit(False)
    cur = current.select(key, F.col(hash_).alias("new_hash"), F.lit(True).alias("__cur"))
    old = snapshot.select(key, F.col(hash_).alias("old_hash"), F.lit(True).alias("__old"), there.alias("__there"))
    status = (
        F.when(F.col("__old").isNull(), "new")
        .when(F.col("__cur").isNull(), F.when(~F.col("__there"), "deleted"))
        .when(~F.col("old_hash").eqNullSafe(F.col("new_hash")), "modified")
    )
    return cur.join(old, key, "full_outer").select(key, status.alias("status"), "old_hash", "new_hash").filter("status IS NOT NULL")


def cold_start(current: DataFrame, key: str = "path", hash_: str = "hash") -> DataFrame:
    """Everything is new."""
    return current.select(key, F.lit("new").alias("status"), F.lit(None).cast("string").alias("old_hash"), F.col(hash_).alias("new_hash"))


def new_keys(current: DataFrame, snapshot: DataFrame, key: str = "path") -> DataFrame:
    return current.join(snapshot.select(key), key, "left_anti")


def merge_snapshot(old: DataFrame, changes: DataFrame, fresh: DataFrame, key: str = "path") -> DataFrame:
    """The next snapshot: old rows that didn't change, and fresh rows of those that are new or modified.

    ``fresh`` has the snapshot's columns; changed rows that it lacks (not parsed) go.
    """
    kept = old.join(changes.select(key), key, "left_anti")
    taken = fresh.join(changes.filter("status IN ('new', 'modified')").select(key), key, "left_semi")
    return kept.unionByName(taken.select(*old.columns))


def cached_symbols(symbols: str | Column) -> Column:
    """The public symbols' columns that a snapshot keeps."""
    from lodestone.functions.predicates import is_public_symbol

    s = F.col(symbols) if isinstance(symbols, str) else symbols
    return F.transform(F.filter(s, is_public_symbol), lambda x: F.struct(x["name"].alias("name"), x["kind"].alias("kind"), x["visibility"].alias("visibility"), x["signature"].alias("signature"), x["decorators"].alias("decorators")))


def snapshot_rows(files: DataFrame, analyses: DataFrame) -> DataFrame:
    """(path, hash, symbols) of parsed files; tests keep their hash alone."""
    from lodestone.functions.predicates import is_test

    symbols = cached_symbols("symbols")
    return files.select("path", "hash").join(analyses.filter("error IS NULL").select("path", "symbols"), "path").select("path", "hash", F.when(is_test("path"), F.slice(symbols, 1, 0)).otherwise(symbols).alias("symbols"))
