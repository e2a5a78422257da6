"""Symbols: differences between versions, members of containers, and the shape of a file's entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.config import SizeProfile
from lodestone.functions import predicates as P
from lodestone.model import CONTAINERS


def last_of_each(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """One row a key: the last one by ``order`` (repeated names overwrite each other)."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("__last")).select(*keys, "__last.*")


def symbol_diff(old: DataFrame, new: DataFrame, file: str = "path", name: str = "name", signature: str = "signature", order: str = "ordinal", carry: list[str] = ()) -> DataFrame:
    """(file, name, change, old signature, new signature): added, removed, or modified where the signatures differ.

    ``carry``: columns of the symbol that come along, from the new side where it has one.
    Nulls are equal to each other.
    """
    columns = [signature, *carry]
    a = last_of_each(old, [file, name], order, columns).select(file, name, F.struct(*columns).alias("__old"))
    b = last_of_each(new, [file, name], order, columns).select(file, name, F.struct(*columns).alias("__new"))
    change = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "removed").when(~F.col(f"__old.{signature}").eqNullSafe(F.col(f"__new.{signature}")), "modified")
    both = a.join(b, [file, name], "full_outer").withColumn("change", change).filter("change IS NOT NULL")
    carried = [F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(f"__old.{c}")).alias(c) for c in carry]
    return both.select(file, name, "change", F.col(f"__old.{signature}").alias("old_signature"), F.col(f"__new.{signature}").alias("new_signature"), *carried)


def worst_impact(df: DataFrame, by: str, impact: str = "impact") -> DataFrame:
    """The gravest impact of each ``by``."""
    rank = F.min(P.impact_rank(impact))
    return df.groupBy(by).agg(F.element_at(F.array(*map(F.lit, ["high", "medium", "low"])), rank + 1).alias(impact))


def members(parents: DataFrame, children: DataFrame, key: str, value: str, order: str, cap: int, extra: list[str] = ()) -> DataFrame:
    """Each parent with its children's values in order, the first ``cap`` of them, and how many there are.

    The children are folded before the join, so that each key meets once.
    """
    folded = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))).alias("__all"))
    everyone = F.coalesce(F.transform("__all", lambda x: x["v"]), F.array().cast("array<string>"))
    return parents.join(folded, key, "left").select(key, *extra, F.slice(everyone, 1, cap).alias("members"), F.size(everyone).alias("total"))


def slim(symbol: Column) -> Column:
    """What an entry of a diff shows of a symbol; without decorators the field is null."""
    return F.struct(symbol["name"].alias("name"), symbol["kind"].alias("kind"), symbol["visibility"].alias("visibility"), symbol["signature"].alias("signature"), F.when(F.size(symbol["decorators"]) > 0, symbol["decorators"]).alias("decorators"))


def _some(array: Column) -> Column:
    """The array, or null where it is empty."""
    return F.when(F.size(array) > 0, array)


def shaped_symbols(symbols: str, profile: SizeProfile) -> Column:
    """The public containers and free symbols of a file, each with its members, within its own row."""

    def children(owner: Column, kind: str) -> Column:
        return F.filter(F.col(symbols), lambda s: s["parent"].eqNullSafe(owner["name"]) & (s["kind"] == kind) & P.is_public_symbol(s))

    def shape(s: Column) -> Column:
        box = s["kind"].isin(CONTAINERS)
        methods = F.transform(children(s, "method"), lambda m: F.coalesce(F.nullif(m["signature"], F.lit("")), m["name"]))
        deps = P.constructor_deps(F.coalesce(F.get(children(s, "constructor"), F.lit(0))["signature"], F.lit("")))
        return F.struct(
            s["name"].alias("name"),
            s["kind"].alias("kind"),
            s["signature"].alias("signature"),
            F.when(box, _some(s["implements"])).alias("implements"),
            F.when(box, _some(deps)).alias("constructor_deps"),
            F.when(box, F.slice(methods, 1, profile.max_methods_per_symbol)).alias("methods"),
            F.when(box & (F.size(methods) > profile.max_methods_per_symbol), F.size(methods)).alias("total_methods"),
            F.when(s["kind"].isin("class", "struct") & (F.size(methods) == 0), F.lit(True)).alias("is_dto"),
            _some(P.without_noise(F.coalesce(s["decorators"], F.array().cast("array<string>")))).alias("decorators"),
        )

    shown = F.filter(F.col(symbols), lambda s: P.is_public_symbol(s) & (s["kind"].isin(CONTAINERS) | s["parent"].isNull()))
    return F.transform(shown, shape)


def has_signal(shaped: Column) -> Column:
    """Some symbol has methods, dependencies, decorators, or implements more than ``object``."""
    return F.exists(
        shaped,
        lambda s: (F.coalesce(F.size(s["methods"]), F.lit(0)) > 0)
        | s["constructor_deps"].isNotNull()
        | s["decorators"].isNotNull()
        | (s["implements"].isNotNull() & ~s["implements"].eqNullSafe(F.array(F.lit("object")))),
    )


def format_files(analyses: DataFrame, profile: SizeProfile) -> DataFrame:
    """Entries of the full analysis: file, language, kind, is_dto, symbols_count, total_symbols, symbols, n_symbols.

    Minified, generated and signal-less files go; files of bare containers shrink to one
    ``dto_container`` row.  All of it is row-local.
    """
    kept = analyses.filter(~P.is_minified("language", "symbols") & ~P.is_generated("path", "symbols"))
    dto = P.is_low_entropy("symbols")
    flagged = kept.withColumn("__dto", dto).withColumn("__shaped", F.when(~F.col("__dto"), shaped_symbols("symbols", profile)))
    kept = flagged.filter("__dto").unionByName(flagged.filter(~F.col("__dto") & has_signal(F.col("__shaped"))))
    most = profile.max_symbols_per_file
    return kept.select(
        F.col("path").alias("file"),
        "language",
        F.when(F.col("__dto"), "dto_container").alias("kind"),
        F.when(F.col("__dto"), True).alias("is_dto"),
        F.when(F.col("__dto"), F.size(P.public_containers("symbols"))).alias("symbols_count"),
        F.when(F.size("__shaped") > most, F.size("__shaped")).alias("total_symbols"),
        F.slice("__shaped", 1, most).alias("symbols"),
    )


def diff_entries(changes: DataFrame, analyses: DataFrame, snapshot: DataFrame, threshold: str) -> DataFrame:
    """(file, status, language, impact, added_symbols, removed_symbols, modified_symbols) of modified files with a snapshot.

    Lists hold what passes the threshold, files with none go; ``impact`` is the gravest of
    all differences, whether they pass or not.
    """
    modified = changes.filter("status = 'modified'").select("path")
    now = analyses.join(modified, "path", "left_semi")
    then = snapshot.join(modified, "path", "left_semi").join(now.select("path"), "path", "left_semi")
    fields = ["kind", "visibility", "decorators"]
    new = now.select("path", F.posexplode(F.filter("symbols", P.is_public_symbol)).alias("ordinal", "s")).select("path", "ordinal", "s.name", "s.signature", *[f"s.{f}" for f in fields])
    old = then.select("path", F.posexplode("symbols").alias("ordinal", "s")).select("path", "ordinal", "s.name", "s.signature", *[f"s.{f}" for f in fields])
    parsed = then.select("path").distinct()
    diff = symbol_diff(old, new.join(parsed, "path", "left_semi"), carry=["ordinal", *fields])
    diff = diff.withColumn("impact", P.impact("change", "kind", "visibility", "decorators")).withColumn("signature", F.coalesce("new_signature", "old_signature"))
    row = F.struct(F.col("ordinal"), slim(F.struct("name", "kind", "visibility", "signature", "decorators")).alias("s"))
    lists = {
        f"{change}_symbols": F.transform(F.array_sort(F.collect_list(F.when((F.col("change") == change) & P.passes("impact", threshold), row))), lambda x: x["s"])
        for change in ("added", "removed", "modified")
    }
    grouped = diff.groupBy("path").agg(F.min(P.impact_rank("impact")).alias("__rank"), *[v.alias(k) for k, v in lists.items()])
    grouped = grouped.filter(F.size("added_symbols") + F.size("removed_symbols") + F.size("modified_symbols") > 0)
    named = F.element_at(F.array(*map(F.lit, ["high", "medium", "low"])), F.col("__rank") + 1)
    return grouped.join(now.select("path", "language"), "path").select(F.col("path").alias("file"), F.lit("modified").alias("status"), "language", named.alias("impact"), *lists)
