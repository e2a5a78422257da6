"""Links between declarations: interfaces and what implements them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def implementations(types: DataFrame, interfaces: DataFrame, implements: str = "implements", interface: str = "name") -> DataFrame:
    """Rows of ``types``, one for each implemented name that is an interface; the name is in ``interface``.

    Interfaces are made distinct by name first, so that the join can't multiply rows.
    """
    names = interfaces.select(F.col(interface).alias("interface")).distinct()
    return types.withColumn("interface", F.explode(implements)).join(names, "interface")


def convention_links(interfaces: DataFrame, structs: DataFrame, existing: DataFrame | None = None, name: str = "name", prefix: str = "I") -> DataFrame:
    """(interface, implementor): a struct named as an interface without its prefix, unless the pair exists."""
    named = interfaces.select(F.col(name).alias("interface")).distinct().filter(F.startswith("interface", F.lit(prefix)))
    named = named.withColumn("implementor", F.expr(f"substring(interface, {len(prefix) + 1})"))
    out = named.join(structs.select(F.col(name).alias("implementor")).distinct(), "implementor").select("interface", "implementor")
    return out.join(existing.select("interface", "implementor"), ["interface", "implementor"], "left_anti") if existing is not None else out


def implementor_lists(links: DataFrame, order: list[str]) -> DataFrame:
    """(interface, implementors) in order, with repeats."""
    row = F.struct(*order, "implementor")
    return links.groupBy("interface").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["implementor"]).alias("implementors"))


def interface_map(analyses: DataFrame) -> DataFrame:
    """(interface, implementors) of a whole project, across languages, in order of path and symbol."""
    symbols = analyses.select("path", "language", F.explode("symbols").alias("s")).select("path", "language", "s.*")
    interfaces = symbols.filter("kind = 'interface'")
    types = symbols.filter("kind IN ('class', 'struct') AND size(implements) > 0")
    by_name = implementations(types, interfaces).select("interface", F.lit(0).alias("late"), "path", "ordinal", F.col("name").alias("implementor"))
    go = convention_links(interfaces, symbols.filter("language = 'go' AND kind = 'struct'"), by_name)
    late = go.select("interface", F.lit(1).alias("late"), F.lit("").alias("path"), F.lit(0).alias("ordinal"), "implementor")
    return implementor_lists(by_name.unionByName(late), ["late", "path", "ordinal"])
