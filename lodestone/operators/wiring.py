"""Routes and handlers, from symbols and their decorators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.config import SizeProfile
from lodestone.functions.scalars import route_arg, route_path, strip_slashes

# Decorators of each framework and their verbs, in the order in which they are tried.
CSHARP_VERBS = {"HttpGet": "GET", "HttpPost": "POST", "HttpPut": "PUT", "HttpDelete": "DELETE", "HttpPatch": "PATCH"}
TYPESCRIPT_VERBS = {"Get": "GET", "Post": "POST", "Put": "PUT", "Delete": "DELETE", "Patch": "PATCH"}
PYTHON_VERBS = {"get": "GET", "post": "POST", "put": "PUT", "delete": "DELETE", "patch": "PATCH", "route": "ANY"}
# Parameters of Go handlers.
GO_HANDLER = r"http\.ResponseWriter|\*gin\.Context|echo\.Context"


def first_k(df: DataFrame, by: str, order: str, k: int) -> DataFrame:
    """The first ``k`` rows of each group, with the group's ``total``."""
    w = Window.partitionBy(by)
    return df.withColumn("__rn", F.row_number().over(w.orderBy(order))).withColumn("total", F.count("*").over(w)).filter(F.col("__rn") <= k).drop("__rn")


def cap_routes(df: DataFrame, by: str | list[str], verb: str, order: str, cap: int) -> DataFrame:
    """At most ``cap`` routes of each group: the first of each verb, then the others in order; with ``pick`` and ``total``.

    Groups within the cap stay in their order.
    """
    by = [by] if isinstance(by, str) else by
    w = Window.partitionBy(*by)
    marked = df.withColumn("__nth", F.row_number().over(Window.partitionBy(*by, verb).orderBy(order))).withColumn("total", F.count("*").over(w))
    spread = F.when((F.col("total") > cap) & (F.col("__nth") > 1), 1).otherwise(0)
    return marked.withColumn("__later", spread).withColumn("pick", F.row_number().over(w.orderBy("__later", order))).filter(F.col("pick") <= cap).drop("__nth", "__later")


def _verb(decorator: Column, verbs: dict[str, str], test) -> Column:
    out = F.lit(None).cast("string")
    for name, verb in reversed(verbs.items()):
        out = F.when(test(decorator, name), verb).otherwise(out)
    return out


def _of_controllers(symbols: DataFrame, language: list[str], is_controller: Column, prefix: Column, verb: Column) -> DataFrame:
    classes = symbols.filter(F.col("language").isin(language) & (F.col("kind") == "class")).filter(is_controller)
    classes = classes.select("path", F.col("name").alias("class"), F.col("ordinal").alias("class_ordinal"), prefix.alias("prefix"))
    methods = symbols.filter(F.col("language").isin(language) & (F.col("kind") == "method") & F.col("parent").isNotNull())
    methods = methods.select("path", F.col("parent").alias("class"), "ordinal", F.col("name").alias("handler"), F.posexplode("decorators").alias("nth", "decorator"))
    joined = classes.join(methods, ["path", "class"]).withColumn("method", verb).filter("method IS NOT NULL")
    return joined.select(F.col("path").alias("file"), "class", "class_ordinal", "ordinal", "nth", "method", route_path("prefix", route_arg("decorator")).alias("route"), "handler")


def routes(analyses: DataFrame) -> DataFrame:
    """(file, class, class_ordinal, ordinal, nth, method, route, handler) of all frameworks; handlers without a route have neither."""
    symbols = analyses.select("path", "language", F.explode("symbols").alias("s")).select("path", "language", "s.*")
    d = F.col("decorators")
    called = lambda x, name: (x == name) | F.startswith(x, F.lit(f"{name}("))
    first = lambda begin: F.get(F.filter(d, lambda x: F.startswith(x, F.lit(begin))), F.lit(0))
    routed = F.get(F.filter(F.transform(F.filter(d, lambda x: F.startswith(x, F.lit("Route("))), route_arg), lambda a: a.isNotNull()), F.lit(0))
    csharp = _of_controllers(
        symbols,
        ["c_sharp"],
        F.exists(d, lambda x: x.isin("ApiController", "Controller") | F.startswith(x, F.lit("Route("))),
        strip_slashes(routed, both=False),
        _verb(F.col("decorator"), CSHARP_VERBS, called),
    )
    typescript = _of_controllers(
        symbols,
        ["typescript", "javascript"],
        F.exists(d, lambda x: F.startswith(x, F.lit("Controller("))),
        strip_slashes(route_arg(first("Controller("))),
        _verb(F.col("decorator"), TYPESCRIPT_VERBS, lambda x, name: F.startswith(x, F.lit(f"{name}("))),
    )
    free = symbols.filter("kind IN ('method', 'function')")
    python = (
        free.filter("language = 'python'")
        .select("path", "ordinal", F.col("name").alias("handler"), F.posexplode("decorators").alias("nth", "decorator"))
        .withColumn("method", _verb(F.col("decorator"), PYTHON_VERBS, lambda x, name: F.contains(x, F.lit(f".{name}("))))
        .filter("method IS NOT NULL")
        .select(F.col("path").alias("file"), F.lit(None).cast("string").alias("class"), F.lit(-1).alias("class_ordinal"), "ordinal", "nth", "method", F.coalesce(route_arg("decorator"), F.lit("")).alias("route"), "handler")
    )
    none = F.lit(None).cast("string")
    go = free.filter(F.col("language") == "go").filter(F.col("signature").rlike(GO_HANDLER))
    go = go.select(F.col("path").alias("file"), none.alias("class"), F.lit(-1).alias("class_ordinal"), "ordinal", F.lit(0).alias("nth"), none.alias("method"), none.alias("route"), F.col("name").alias("handler"))
    return csharp.unionByName(typescript).unionByName(python).unionByName(go)


def wiring(analyses: DataFrame, profile: SizeProfile) -> DataFrame:
    """(file, class, routes, total_routes, handlers, total_handlers, total_route_files) of the first controllers, capped by the profile."""
    rows = routes(analyses).withColumn("__order", F.struct("ordinal", "nth"))
    keys = ["file", "class_ordinal"]
    capped = cap_routes(rows.filter("method IS NOT NULL"), keys, "method", "__order", profile.max_routes_per_controller)
    route = F.struct("pick", F.col("method"), F.col("route").alias("path"), "handler")
    nested = capped.groupBy(*keys, "class").agg(
        F.transform(F.array_sort(F.collect_list(route)), lambda r: F.struct(r["method"].alias("method"), r["path"].alias("path"), r["handler"].alias("handler"))).alias("routes"),
        F.max(F.when(F.col("total") > profile.max_routes_per_controller, F.col("total"))).cast("int").alias("total_routes"),
    )
    handlers = rows.filter("method IS NULL").groupBy(*keys, "class").agg(F.array_sort(F.collect_list(F.struct("__order", "handler"))).alias("__h"))
    most = profile.max_go_handlers
    handlers = handlers.select(*keys, "class", F.slice(F.transform("__h", lambda h: F.struct(h["handler"].alias("handler"))), 1, most).alias("handlers"), F.when(F.size("__h") > most, F.size("__h")).alias("total_handlers"))
    both = nested.unionByName(handlers, allowMissingColumns=True)
    # one row a controller: small against the symbols, and ordered as a whole
    numbered = both.withColumn("__rn", F.row_number().over(Window.orderBy(*keys)))
    total = both.agg(F.count("*").alias("__total"))
    shown = numbered.filter(F.col("__rn") <= profile.max_route_controllers).join(F.broadcast(total))  # one row
    return shown.select("__rn", "file", "class", "routes", "total_routes", "handlers", "total_handlers", F.when(F.col("__total") > profile.max_route_controllers, F.col("__total")).cast("int").alias("total_route_files")).withColumnRenamed("__rn", "position")
