"""Symbols: differences, impact, members, links between types, shapes of files, extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import predicates as P
from lodestone.functions import scalars
from lodestone.model import SYMBOL
from lodestone.operators import links, symbols, wiring
from lodestone.queries import query
from lodestone.sources import parse

_DIFF = """
old AS (SELECT conv_id, role, arg_max(text, turn) AS text FROM conversations WHERE turn % 3 <> 2 OR conv_id % 5 > 0 GROUP BY conv_id, role),
new AS (SELECT conv_id, role, arg_max(text, turn) AS text FROM conversations WHERE turn % 4 <> 1 GROUP BY conv_id, role),
diff AS (SELECT coalesce(old.conv_id, new.conv_id) AS conv_id, coalesce(old.role, new.role) AS role, CASE WHEN old.role IS NULL THEN 'added' WHEN new.role IS NULL THEN 'removed' ELSE 'modified' END AS change, old.text AS old_signature, new.text AS new_signature
  FROM old FULL OUTER JOIN new ON old.conv_id = new.conv_id AND old.role = new.role WHERE old.role IS NULL OR new.role IS NULL OR old.text IS DISTINCT FROM new.text)
"""


def _versions(t):
    c = t("conversations")
    return c.filter("turn % 3 <> 2 OR conv_id % 5 > 0"), c.filter("turn % 4 <> 1")


@query(f"WITH {_DIFF} SELECT * FROM diff")
def symbol_diff(spark, t):
    old, new = _versions(t)
    return symbols.symbol_diff(old, new, file="conv_id", name="role", signature="text", order="turn")


_IMPACT = """SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'added' WHEN 'view' THEN 'modified' WHEN 'purchase' THEN 'removed' ELSE 'modified' END AS change,
  CASE user_id % 4 WHEN 0 THEN 'class' WHEN 1 THEN 'method' WHEN 2 THEN 'function' ELSE 'property' END AS kind, CASE WHEN value > 50 THEN 'public' WHEN value > 20 THEN 'private' END AS visibility,
  CASE WHEN user_id % 11 = 0 THEN 'HttpGet' WHEN user_id % 11 = 1 THEN 'HttpGet("x")' END AS decorator, user_id FROM events"""
_IMPACT_CASE = """CASE WHEN decorator = 'HttpGet' THEN 'high' WHEN change IN ('added', 'removed') AND kind = 'class' THEN 'high' WHEN change = 'removed' AND kind = 'method' AND visibility = 'public' THEN 'high'
  WHEN change = 'modified' AND visibility = 'public' THEN 'medium' WHEN change = 'added' AND kind IN ('function', 'method') AND visibility = 'public' THEN 'medium' ELSE 'low' END"""


def _impacts(t):
    e, v = t("events"), F.col("value")
    change = F.when(F.col("event_type") == "click", "added").when(F.col("event_type") == "purchase", "removed").otherwise("modified")
    kind = F.element_at(F.array(*map(F.lit, ["class", "method", "function", "property"])), (F.col("user_id") % 4 + 1).cast("int"))
    decorators = F.when(F.col("user_id") % 11 == 0, F.array(F.lit("HttpGet"))).when(F.col("user_id") % 11 == 1, F.array(F.lit('HttpGet("x")')))
    rows = e.select("event_id", "user_id", change.alias("change"), kind.alias("kind"), F.when(v > 50, "public").when(v > 20, "private").alias("visibility"), decorators.alias("decorators"))
    return rows.withColumn("impact", P.impact("change", "kind", "visibility", "decorators"))


@query(f"WITH e AS ({_IMPACT}), i AS (SELECT event_id, change, kind, {_IMPACT_CASE} AS impact FROM e) SELECT event_id, change, kind, impact FROM i WHERE impact <> 'low'")
def impact_classify(spark, t):
    return _impacts(t).filter(P.passes("impact", "medium")).select("event_id", "change", "kind", "impact")


@query(f"WITH e AS ({_IMPACT}), i AS (SELECT user_id, {_IMPACT_CASE} AS impact FROM e) SELECT user_id, CASE min(CASE impact WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END) WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS impact FROM i GROUP BY user_id")
def overall_impact(spark, t):
    return symbols.worst_impact(_impacts(t), "user_id")


@query(
    """WITH l AS (SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS rn FROM lineitem),
g AS (SELECT l_orderkey, string_agg(p, ', ' ORDER BY rn) FILTER (WHERE rn <= 3) AS members, count(*) AS total FROM l GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(members, '') AS members, CAST(coalesce(total, 0) AS INTEGER) AS total FROM orders LEFT JOIN g ON o_orderkey = l_orderkey"""
)
def members(spark, t):
    lines = t("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").cast("string").alias("p"))
    return symbols.members(t("orders").select("o_orderkey"), lines, "o_orderkey", "p", "l_linenumber", 3).withColumn("members", F.array_join("members", ", "))


_TYPES = """types AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS name, list_value('I' || n_name, 'object') AS implements FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT 's' || CAST(s_suppkey AS VARCHAR), list_value('I' || n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey),
ifaces AS (SELECT DISTINCT 'I' || n_name AS interface FROM nation WHERE n_regionkey <> 1)"""


def _types(t):
    nation = t("nation").select("n_nationkey", "n_regionkey", F.concat(F.lit("I"), "n_name").alias("iface"))
    c = t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), "c_custkey").alias("name"), F.array("iface", F.lit("object")).alias("implements"))
    s = t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("name"), F.array("iface").alias("implements"))
    return c.unionByName(s), nation.filter("n_regionkey <> 1").select(F.col("iface").alias("name"))


@query(f"WITH {_TYPES}, x AS (SELECT name, unnest(implements) AS interface FROM types) SELECT interface, name FROM x WHERE interface IN (SELECT interface FROM ifaces)")
def iface_impl(spark, t):
    types, ifaces = _types(t)
    return links.implementations(types, ifaces).select("interface", "name")


@query(f"WITH {_TYPES}, x AS (SELECT name, unnest(implements) AS interface FROM types) SELECT interface, string_agg(name, ', ' ORDER BY name) AS implementors FROM x WHERE interface IN (SELECT interface FROM ifaces) GROUP BY interface")
def iface_impl_map(spark, t):
    types, ifaces = _types(t)
    found = links.implementations(types, ifaces).select("interface", F.col("name").alias("implementor"))
    return links.implementor_lists(found, []).withColumn("implementors", F.array_join("implementors", ", "))


@query("SELECT 'I' || n_name AS interface, n_name AS implementor FROM nation WHERE n_regionkey IN (2, 4)")
def convention_link(spark, t):
    n = t("nation")
    ifaces = n.select(F.concat(F.lit("I"), "n_name").alias("name"))
    structs = n.filter("n_regionkey >= 2").select(F.col("n_name").alias("name"))
    existing = n.filter("n_regionkey = 3").select(F.concat(F.lit("I"), "n_name").alias("interface"), F.col("n_name").alias("implementor"))
    return links.convention_links(ifaces, structs, existing)


#: Files made of conversations: turns are symbols, roles are kinds.
_SHAPES = """WITH s AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'class' WHEN 'assistant' THEN 'method' ELSE 'function' END AS kind,
  CASE WHEN length(text) % 3 = 0 THEN 'x' || CAST(turn % 10 AS VARCHAR) ELSE 'Name' || CAST(turn AS VARCHAR) END AS name, CASE WHEN length(text) % 7 = 0 THEN 'private' ELSE 'public' END AS visibility,
  CASE WHEN role = 'assistant' AND length(text) % 5 > 0 THEN 'Name0' END AS parent, length(text) % 11 = 0 AS marked FROM conversations),
p AS (SELECT * FROM s WHERE visibility = 'public')"""


def _shapes(t):
    n = F.length("text")
    none = F.lit(None).cast("string")
    kind = F.when(F.col("role") == "user", "class").when(F.col("role") == "assistant", "method").otherwise("function")
    name = F.when(n % 3 == 0, F.concat(F.lit("x"), F.col("turn") % 10)).otherwise(F.concat(F.lit("Name"), "turn"))
    empty = F.array().cast("array<string>")
    s = F.struct(
        F.col("turn").cast("int").alias("ordinal"), name.alias("name"), kind.alias("kind"), F.when(n % 7 == 0, "private").otherwise("public").alias("visibility"), none.alias("signature"),
        F.when(n % 11 == 0, F.array(F.lit("System.CodeDom.Compiler.GeneratedCode"), F.lit("Tag"))).otherwise(empty).alias("decorators"), empty.alias("implements"),
        F.when((F.col("role") == "assistant") & (n % 5 > 0), "Name0").alias("parent"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"),
    )
    return t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(s)).alias("symbols"))


@query(_SHAPES + " SELECT conv_id, count(*) FILTER (WHERE parent IS NULL) >= 5 AND count(*) FILTER (WHERE parent IS NULL AND length(name) <= 2) / nullif(count(*) FILTER (WHERE parent IS NULL), 0)::DOUBLE > 0.30::DOUBLE AS minified FROM p GROUP BY conv_id")
def minified(spark, t):
    f = _shapes(t).filter(F.exists("symbols", P.is_public_symbol))
    return f.select("conv_id", P.is_minified(F.lit("typescript"), "symbols").alias("minified"))


@query(
    _SHAPES
    + """, b AS (SELECT conv_id, name FROM p WHERE kind = 'class'), o AS (SELECT DISTINCT b.conv_id FROM b JOIN p ON p.conv_id = b.conv_id AND p.parent = b.name AND p.kind = 'method')
SELECT DISTINCT conv_id FROM b WHERE conv_id NOT IN (SELECT conv_id FROM o)"""
)
def low_entropy(spark, t):
    return _shapes(t).filter(P.is_low_entropy("symbols")).select("conv_id")


@query(
    """WITH n AS (SELECT conv_id, length(text) % 11 = 0 AS marked, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS rn FROM conversations)
SELECT conv_id, coalesce(bool_or(marked AND rn <= 3), false) AS is_generated FROM n GROUP BY conv_id"""
)
def generated(spark, t):
    return _shapes(t).select("conv_id", P.is_generated(F.lit("src/a.cs"), "symbols").alias("is_generated"))


@query(
    _SHAPES
    + """, b AS (SELECT conv_id, name, kind, marked FROM p WHERE kind = 'class' OR parent IS NULL), m AS (SELECT conv_id, parent AS name, count(*) AS k FROM p WHERE kind = 'method' AND parent IS NOT NULL GROUP BY conv_id, parent)
SELECT b.conv_id, count(*) AS shown, count(*) FILTER (WHERE b.kind = 'class' AND m.k IS NULL) AS dtos, CAST(coalesce(sum(CASE WHEN b.kind = 'class' AND m.k IS NOT NULL THEN least(m.k, 12) END), 0) AS BIGINT) AS methods
FROM b LEFT JOIN m ON b.conv_id = m.conv_id AND b.name = m.name GROUP BY b.conv_id
HAVING count(*) FILTER (WHERE b.kind = 'class' AND m.k IS NOT NULL) > 0 OR count(*) FILTER (WHERE b.marked) > 0"""
)
def signal(spark, t):
    from lodestone.config import PROFILES

    shaped = _shapes(t).withColumn("s", symbols.shaped_symbols("symbols", PROFILES["medium"])).filter(symbols.has_signal(F.col("s")))
    size = lambda x: F.coalesce(F.size(x["methods"]), F.lit(0))
    return shaped.select(
        "conv_id",
        F.size("s").cast("long").alias("shown"),
        F.size(F.filter("s", lambda x: F.coalesce(x["is_dto"], F.lit(False)))).cast("long").alias("dtos"),
        F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + size(x)).alias("methods"),
    )


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'IRepo, ILogger<Worker>' WHEN 1 THEN '' WHEN 2 THEN 'Foo' ELSE '' END AS deps FROM part"""
)
def constructor_deps(spark, t):
    k = F.col("p_partkey") % 4
    sig = F.when(k == 0, "public Svc(IRepo repo, ILogger<Worker> logger, string name, int? n)").when(k == 1, "broken").when(k == 2, "(Foo foo, string[] names)").otherwise("()")
    # ``int?`` is no known primitive: the mark stays with the type
    deps = F.filter(P.constructor_deps(sig), lambda d: ~F.endswith(d, F.lit("?")))
    return t("part").select("p_partkey", F.array_join(deps, ", ").alias("deps"))


@query(
    """SELECT user_id, CASE WHEN n LIKE '\\_\\_%' ESCAPE '\\' AND n NOT LIKE '%\\_\\_' ESCAPE '\\' THEN 'private' WHEN n LIKE '\\_%' ESCAPE '\\' THEN 'protected' ELSE 'public' END AS python, regexp_matches(n, '^[A-Z]') AS go
FROM (SELECT DISTINCT user_id, CASE user_id % 4 WHEN 0 THEN '__a' WHEN 1 THEN '__b__' WHEN 2 THEN '_c' ELSE 'Dee' END AS n FROM events)"""
)
def visibility(spark, t):
    n = F.element_at(F.array(*map(F.lit, ["__a", "__b__", "_c", "Dee"])), (F.col("user_id") % 4 + 1).cast("int"))
    return t("events").select("user_id").distinct().select("user_id", scalars.python_visibility(n).alias("python"), scalars.go_exported(n).alias("go"))


@query(
    """SELECT p_partkey, 'json, xml' || CASE WHEN p_partkey % 2 = 0 THEN ', yaml' ELSE '' END AS tags, 'pkg' || CAST(p_partkey % 9 AS VARCHAR) AS dependency, substr(sha256('/a/' || CAST(p_partkey AS VARCHAR)), 1, 16) AS folder FROM part"""
)
def small_scalars(spark, t):
    n = F.col("p_partkey")
    tag = F.concat(F.lit('`xml:"a" json:"b"'), F.when(n % 2 == 0, ' yaml:"c"`').otherwise("`"))
    requirement = F.concat(F.lit("  Pkg"), n % 9, F.lit(" [extra] >= 1.0"))
    return t("part").select("p_partkey", F.array_join(scalars.tag_keys(tag), ", ").alias("tags"), scalars.dependency_name(requirement).alias("dependency"), scalars.snapshot_name(F.concat(F.lit("/a/"), n)).alias("folder"))


#: Small sources of every language, made for the extraction queries.
SOURCES = [
    ("a/api.py", "python", "import os\n\nclass Repo(Base):\n    @app.get('/items/{n}')\n    def find(self, n: int) -> dict:\n        return {}\n\n    def _skip(self): ...\n\n@router.post('/items')\ndef add(x):\n    pass\n"),
    ("b/svc.go", "go", "package b\n\ntype IRepo interface {\n\tFind(id int) error\n}\n\ntype Repo struct {\n\tID int `json:\"id\"`\n}\n\nfunc (r *Repo) Find(id int) error { return nil }\n\nfunc Health(w http.ResponseWriter, r *http.Request) {}\n"),
    ("c/ctl.ts", "typescript", "import { X } from 'y'\n\n@Controller('/users/')\nexport class Users implements IRepo {\n  @Get(':id')\n  one(id: string): User { return load(id) }\n\n  @Post()\n  private add() {}\n}\n\nexport const f = (a) => a\n"),
    ("d/Ctl.cs", "c_sharp", "using System;\nnamespace D {\n  [ApiController, Route(\"api/orders\")]\n  public class Orders : IRepo {\n    public Orders(IRepo repo, int n) {}\n    [HttpGet(\"{id}\")]\n    public Order Get(int id) => null;\n    private int n;\n  }\n}\n"),
]


def _sources(spark):
    return spark.createDataFrame([(p, lang, text.encode()) for p, lang, text in SOURCES], "path string, language string, content binary")


@query(None)
def extract_symbols(spark, t):
    rows = parse.parse(_sources(spark)).select("path", F.explode("symbols").alias("s")).select("path", *[f"s.{c}" for c in SYMBOL.names])
    return rows.withColumn("decorators", F.array_join("decorators", "; ")).withColumn("implements", F.array_join("implements", "; "))


@query(None)
def extract_lateral(spark, t):
    parse.register(spark)
    _sources(spark).createOrReplaceTempView("lodestone_sources")
    return spark.sql("SELECT path, ordinal, name, kind, visibility, signature, parent FROM lodestone_sources, LATERAL extract_symbols(path, language, content)")


@query(
    """SELECT * FROM (VALUES ('a/api.py', NULL, 'GET', '/items/{n}', 'find'), ('a/api.py', NULL, 'POST', '/items', 'add'), ('b/svc.go', NULL, NULL, NULL, 'Health'), ('c/ctl.ts', 'Users', 'GET', 'users/:id', 'one'),
('c/ctl.ts', 'Users', 'POST', 'users', 'add'), ('d/Ctl.cs', 'Orders', 'GET', 'api/orders/{id}', 'Get')) AS r(file, class, method, route, handler)"""
)
def routes(spark, t):
    return wiring.routes(parse.parse(_sources(spark))).select("file", "class", "method", "route", "handler")


@query("SELECT * FROM (VALUES ('IRepo', 'Users, Orders, Repo')) AS m(interface, implementors)")
def interface_map(spark, t):
    return links.interface_map(parse.parse(_sources(spark))).withColumn("implementors", F.array_join("implementors", ", "))


@query(
    """SELECT * FROM (VALUES ('a/api.py', 'Repo', 'class', 'class Repo(Base)', 'Base', NULL, 'def find(self, n: int) -> dict', NULL), ('a/api.py', 'add', 'function', 'def add(x)', NULL, NULL, NULL, 'router.post(''/items'')'),
('b/svc.go', 'IRepo', 'interface', 'type IRepo interface {' || chr(10) || chr(9) || 'Find(id int) error' || chr(10) || '}', NULL, NULL, 'Find(id int) error', NULL), ('b/svc.go', 'Repo', 'struct', 'type Repo struct {' || chr(10) || chr(9) || 'ID int `json:"id"`' || chr(10) || '}', NULL, NULL, 'func (r *Repo) Find(id int)', 'tags:json'),
('b/svc.go', 'Health', 'function', 'func Health(w http.ResponseWriter, r *http.Request)', NULL, NULL, NULL, NULL),
('c/ctl.ts', 'Users', 'class', 'class Users', 'IRepo', NULL, 'one(id: string): User', 'Controller(''/users/'')'), ('c/ctl.ts', 'f', 'function', 'const f = ...', NULL, NULL, NULL, NULL),
('d/Ctl.cs', 'Orders', 'class', 'public class Orders : IRepo', 'IRepo', 'IRepo', 'public Order Get(int id)', 'ApiController; Route("api/orders")')) AS f(file, name, kind, signature, implements, deps, methods, decorators)"""
)
def format_files(spark, t):
    from lodestone.config import PROFILES

    rows = symbols.format_files(parse.parse(_sources(spark)), PROFILES["medium"]).select("file", F.explode("symbols").alias("s"))
    shown = lambda c: F.nullif(F.array_join(f"s.{c}", "; "), F.lit(""))
    return rows.select("file", "s.name", "s.kind", "s.signature", shown("implements").alias("implements"), shown("constructor_deps").alias("deps"), shown("methods").alias("methods"), shown("decorators").alias("decorators"))


@query(
    """SELECT * FROM (VALUES ('a/api.py', 'python', 'high', 'add', 'Gone', 'find'), ('d/Ctl.cs', 'c_sharp', 'medium', NULL, NULL, 'Get; Orders')) AS d(file, language, impact, added, removed, modified)"""
)
def diff_entries(spark, t):
    changed = spark.createDataFrame([(p, "modified", "x", "y") for p, _, _ in SOURCES], "path string, status string, old_hash string, new_hash string")
    then = [
        ("a/api.py", "x", [("Repo", "class", "public", "class Repo(Base)", []), ("find", "method", "public", "def find(self)", []), ("Gone", "class", "public", "class Gone", [])]),
        ("d/Ctl.cs", "x", [("Orders", "class", "public", "public class Orders", []), ("Get", "method", "public", "public Order Get()", ["HttpGet"])]),
    ]
    from lodestone.model import SNAPSHOT

    out = symbols.diff_entries(changed, parse.parse(_sources(spark)), spark.createDataFrame(then, SNAPSHOT), "medium")
    named = lambda c: F.nullif(F.array_join(F.array_sort(F.transform(f"{c}_symbols", lambda s: s["name"])), "; "), F.lit("")).alias(c)
    return out.select("file", "language", "impact", *map(named, ("added", "removed", "modified")))


@query(
    """SELECT * FROM (VALUES (1, 'a/api.py', NULL, 'GET /items/{n} find; POST /items add', NULL), (2, 'b/svc.go', NULL, NULL, 'Health'), (3, 'c/ctl.ts', 'Users', 'GET users/:id one; POST users add', NULL),
(4, 'd/Ctl.cs', 'Orders', 'GET api/orders/{id} Get', NULL)) AS w(position, file, class, routes, handlers)"""
)
def wiring_map(spark, t):
    from lodestone.config import PROFILES

    w = wiring.wiring(parse.parse(_sources(spark)), PROFILES["medium"])
    routes_ = F.array_join(F.transform("routes", lambda r: F.concat_ws(" ", r["method"], r["path"], r["handler"])), "; ")
    return w.select("position", "file", "class", routes_.alias("routes"), F.array_join(F.transform("handlers", lambda h: h["handler"]), "; ").alias("handlers"))


@query(
    """SELECT * FROM (VALUES ('a/api.py', 'Repo', 'class', 'public'), ('a/api.py', 'find', 'method', 'public'), ('a/api.py', 'add', 'function', 'public'), ('b/svc.go', 'IRepo', 'interface', 'public'), ('b/svc.go', 'Find', 'method', 'public'),
('b/svc.go', 'Repo', 'struct', 'public'), ('b/svc.go', 'Find', 'method', 'public'), ('b/svc.go', 'Health', 'function', 'public'), ('c/ctl.ts', 'Users', 'class', 'public'), ('c/ctl.ts', 'one', 'method', 'public'), ('c/ctl.ts', 'f', 'function', 'public'),
('d/Ctl.cs', 'Orders', 'class', 'public'), ('d/Ctl.cs', 'Orders', 'constructor', 'public'), ('d/Ctl.cs', 'Get', 'method', 'public')) AS s(path, name, kind, visibility)"""
)
def snapshot_rows(spark, t):
    from lodestone.operators import changes

    sources = _sources(spark)
    rows = changes.snapshot_rows(sources.withColumn("hash", scalars.content_hash("content")), parse.parse(sources))
    return rows.select("path", F.explode("symbols").alias("s")).select("path", "s.name", "s.kind", "s.visibility")
