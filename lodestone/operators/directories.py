"""Directories: rollups, shared methods and names, and the collapse of many alike files into one summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import SizeProfile
from lodestone.functions.paths import capped, dirname, label
from lodestone.functions.predicates import is_boilerplate

#: Share of files that makes a method common, least share of the mean that common methods cover, share of methodless files in a data directory, share of names with an affix.
COMMON, COVERED, METHODLESS, NAMED = 0.6, 0.4, 0.8, 0.8
SHORTEST_AFFIX, LONGEST_AFFIX = 3, 12


def rollup(files: DataFrame, directory: str, language: str, depth: int | None = None) -> DataFrame:
    """(directory, file_count, languages): counts and sorted distinct languages by capped directory; null without any."""
    d = capped(directory, depth) if depth else F.col(directory)
    return files.groupBy(d.alias("directory")).agg(F.count("*").alias("file_count"), F.nullif(F.array_join(F.array_sort(F.collect_set(language)), ", "), F.lit("")).alias("languages"))


def structure(files: DataFrame, depth: int) -> DataFrame:
    """(directory, file_count, languages, kind, top_level) of all directories below the root."""
    inner = files.withColumn("__dir", dirname("path")).filter("__dir != '.'")
    out = rollup(inner, "__dir", "language", depth)
    return out.select(label("directory").alias("directory"), "file_count", "languages", F.when(is_boilerplate("directory"), "boilerplate").alias("kind"), (~F.contains("directory", F.lit("/"))).alias("top_level"))


def common_members(df: DataFrame, group: str, item: str, member: str, share: float = COMMON) -> DataFrame:
    """(group, member, n_items): members that at least ``share`` of the group's items have.

    Pairs of item and member are made distinct first: both counts are then plain sums.
    """
    pairs = df.select(group, item, member).distinct()
    counts = pairs.groupBy(group, member).agg(F.count("*").alias("n_items"))
    sizes = pairs.select(group, item).distinct().groupBy(group).agg(F.count("*").alias("__n"))
    return counts.join(sizes, group).filter(F.col("n_items") >= F.lit(share) * F.col("__n")).select(group, member, "n_items")


def dominant(df: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """(group, value, n): the most frequent value; ties go to the one that comes first."""
    counts = df.groupBy(group, value).agg(F.count("*").alias("n"), F.min(order).alias("__first"))
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("__first"), F.col(value).alias("v"), F.col("n"))).alias("__best")
    return counts.groupBy(group).agg(best).select(group, F.col("__best.v").alias(value), F.col("__best.n").alias("n"))


def name_pattern(df: DataFrame, group: str, name: str, order: str) -> DataFrame:
    """(group, pattern, total, examples): the longest affix of 3 to 12 characters that enough names share.

    Suffixes, which start with a capital, go before prefixes; of equal ones the first seen.
    Needed: max(2, floor(0.8 n)) of n names, and 2 names at least.
    """
    named = df.select(F.col(group).alias("g"), F.col(name).alias("name"), F.col(order).alias("o"))
    sizes = named.groupBy("g").agg(F.count("*").alias("n")).filter("n >= 2").select("g", F.greatest(F.lit(2), F.floor(F.col("n") * F.lit(NAMED))).alias("least"))
    lengths = F.explode(F.filter(F.sequence(F.lit(SHORTEST_AFFIX), F.lit(LONGEST_AFFIX)), lambda k: k <= F.length("name")))
    cut = named.withColumn("k", lengths).select(
        "g", "o", "k", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.expr("right(name, k)").alias("affix")), F.struct(F.lit(1).alias("side"), F.expr("left(name, k)").alias("affix")))).alias("a")
    ).select("g", "o", "k", "a.*")
    counts = cut.groupBy("g", "side", "k", "affix").agg(F.count("*").alias("total"), F.min("o").alias("first"))
    fit = counts.join(sizes, "g").filter("total >= least").filter((F.col("side") == 1) | F.substring("affix", 1, 1).rlike(r"^\p{Lu}"))
    best = fit.groupBy("g").agg(F.min(F.struct("side", (-F.col("k")).alias("k"), "first", "affix", "total")).alias("b")).select("g", "b.side", "b.affix", "b.total")
    matching = named.join(best, "g").filter(F.when(F.col("side") == 0, F.endswith("name", F.col("affix"))).otherwise(F.startswith("name", F.col("affix"))))
    first3 = matching.withColumn("__rn", F.row_number().over(Window.partitionBy("g").orderBy("o"))).filter("__rn <= 3")
    examples = first3.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "name"))), lambda x: x["name"]).alias("examples"))
    pattern = F.when(F.col("side") == 0, F.concat(F.lit("*"), "affix")).otherwise(F.concat("affix", F.lit("*")))
    return best.join(examples, "g").select(F.col("g").alias(group), pattern.alias("pattern"), "total", "examples")


def share_at_least(df: DataFrame, group: str, flag: Column, share: float) -> DataFrame:
    """(group, n, n_true, holds, all_true): whether at least ``share`` of the rows have the flag, and whether all do."""
    n, true = F.count("*"), F.count_if(F.coalesce(flag, F.lit(False)))
    return df.groupBy(group).agg(n.alias("n"), true.alias("n_true"), (true / n >= F.lit(share)).alias("holds"), (true == n).alias("all_true"))


def outliers(df: DataFrame, common: DataFrame, group: str, item: str, member: str, order: list[str], most_items: int | None = 5, most: int = 5) -> DataFrame:
    """(group, item, members): the first members of each item that aren't common; the first items of each group, or all."""
    rest = df.join(common.select(group, member), [group, member], "left_anti")
    row = F.struct(*order, F.col(member).alias("__m"))
    out = rest.groupBy(group, item).agg(F.slice(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["__m"]), 1, most).alias("members"))
    if most_items is None:
        return out
    return out.withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy(item))).filter(F.col("__rn") <= most_items).drop("__rn")


def samples(df: DataFrame, group: str, item: str, order: str) -> DataFrame:
    """(group, item, index, n): first, middle and last item of each group."""
    w = Window.partitionBy(group)
    numbered = df.select(group, item, (F.row_number().over(w.orderBy(order)) - 1).alias("index"), F.count("*").over(w).alias("n"))
    return numbered.filter("index = 0 OR index = n div 2 OR index = n - 1")


def overflow(df: DataFrame, group: str, order: str, cap: int) -> tuple[DataFrame, DataFrame]:
    """The first ``cap`` rows of each group, and (group, remaining) where there are more."""
    numbered = df.withColumn("__rn", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    more = df.groupBy(group).agg((F.count("*") - cap).alias("remaining")).filter("remaining > 0")
    return numbered.filter(F.col("__rn") <= cap).drop("__rn"), more


def test_summary(df: DataFrame, directory: str, file: str, n_symbols: str, language: str) -> DataFrame:
    """(directory, file_count, test_function_count, languages, files) by directory; lists are sorted."""
    return df.groupBy(directory).agg(
        F.count("*").alias("file_count"),
        F.coalesce(F.sum(n_symbols), F.lit(0)).cast("long").alias("test_function_count"),
        F.array_sort(F.collect_set(language)).alias("languages"),
        F.array_sort(F.collect_list(file)).alias("files"),
    )


def collapse(entries: DataFrame, profile: SizeProfile, threshold: int | None = None) -> DataFrame:
    """Entries of files (see ``symbols.format_files``) with alike directories collapsed.

    A directory whose dominant language has fewer files than the threshold keeps its first
    files and one overflow row; else its dominant files become one summary, and the other
    languages' files stay.  Rows come with ``position`` (directory, rank, file) to sort by.
    """
    threshold = profile.dir_aggregation_threshold if threshold is None else threshold
    rows = entries.withColumn("__dir", dirname("file"))
    lead = dominant(rows, "__dir", "language", "file").select("__dir", F.col("language").alias("__lead"), F.col("n").alias("__n"))
    placed = rows.join(lead, "__dir")
    small, large = placed.filter(F.col("__n") < threshold), placed.filter(F.col("__n") >= threshold)

    few, more = overflow(small, "__dir", "file", profile.max_files_per_layer)
    few = few.withColumn("__rank", F.lit(0))
    more = more.select("__dir", F.lit(1).alias("__rank"), F.lit("overflow").alias("kind"), label("__dir").alias("directory"), F.col("remaining").cast("int").alias("remaining_files"))

    main = large.filter(F.col("language").eqNullSafe(F.col("__lead")))
    other = large.filter(~F.col("language").eqNullSafe(F.col("__lead"))).withColumn("__rank", F.lit(1))
    syms = main.select("__dir", "file", F.posexplode("symbols").alias("i", "s"))
    methods = syms.select("__dir", "file", "i", F.posexplode("s.methods").alias("j", "method"))
    n_methods = methods.groupBy("__dir").agg(F.count("*").alias("n_methods"))
    size = main.groupBy("__dir", "__n", F.col("__lead").alias("language")).agg(
        F.bool_and(F.coalesce(F.col("kind") == "dto_container", F.lit(False))).alias("all_dto"),
        (
            F.count_if(
                F.coalesce(F.exists("symbols", lambda s: s["kind"] == "class") & ~F.exists("symbols", lambda s: (s["kind"] == "class") & (F.coalesce(F.size(s["methods"]), F.lit(0)) > 0)), F.lit(False))
            )
            / F.count("*")
            >= F.lit(METHODLESS)
        ).alias("dto_dir"),
    )
    pairs = methods.select("__dir", "file", "method").distinct().groupBy("__dir", "method").agg(F.count("*").alias("c"))
    common = pairs.join(size.select("__dir", "__n"), "__dir").filter(F.col("c") >= F.lit(COMMON) * F.col("__n")).select("__dir", "method")
    listed = common.groupBy("__dir").agg(F.array_sort(F.collect_list("method")).alias("common"))
    pattern = name_pattern(
        syms.filter("s.kind IN ('class', 'struct', 'record')").select("__dir", F.col("s.name").alias("name"), F.struct("file", "i").alias("o")), "__dir", "name", "o"
    ).select("__dir", F.struct("pattern", "examples", F.col("total").cast("int").alias("total")).alias("naming_pattern"))
    odd = outliers(methods, common, "__dir", "file", "method", ["i", "j"])
    odd = odd.groupBy("__dir").agg(F.array_sort(F.collect_list(F.struct("file", F.col("members").alias("unique_methods")))).alias("outliers"))
    some = samples(main, "__dir", "file", "file").groupBy("__dir").agg(F.array_sort(F.collect_list("file")).alias("sample_files"))

    joined = size.join(n_methods, "__dir", "left").join(listed, "__dir", "left").join(pattern, "__dir", "left").join(odd, "__dir", "left").join(some, "__dir", "left")
    n_common = F.coalesce(F.size("common"), F.lit(0))
    mean = F.coalesce(F.col("n_methods"), F.lit(0)) / F.col("__n")
    shared = (n_common >= 2) & (n_common / mean >= F.lit(COVERED))
    dto = F.col("all_dto")
    note = (
        F.when(dto, F.concat(F.lit("Contains "), F.col("__n"), F.lit(" DTO/Entity classes with no logic methods")))
        .when(~F.coalesce(shared, F.lit(False)) & F.col("dto_dir"), "DTO/entity classes — data containers with no methods")
        .when(~F.coalesce(shared, F.lit(False)), "No common method pattern detected")
    )
    shared = F.coalesce(shared, F.lit(False)) & ~dto
    summary = joined.select(
        "__dir",
        F.lit(0).alias("__rank"),
        F.lit("directory_summary").alias("kind"),
        label("__dir").alias("directory"),
        F.col("__n").cast("int").alias("file_count"),
        "language",
        F.when(shared, F.col("common")).when(~dto & F.col("dto_dir"), F.array().cast("array<string>")).alias("common_methods"),
        F.when(~dto, F.col("naming_pattern")).alias("naming_pattern"),
        F.when(shared, F.col("outliers")).alias("outliers"),
        "sample_files",
        note.alias("note"),
    )
    parts = [few, more, summary, other]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn("position", F.struct(F.col("__dir").alias("dir"), F.col("__rank").alias("rank"), F.coalesce("file", F.lit("")).alias("file"))).drop("__dir", "__rank", "__lead", "__n")
