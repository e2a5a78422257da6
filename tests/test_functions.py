import pytest
from pyspark.sql import functions as F

from lodestone.config import DEFAULT_EXCLUDE
from lodestone.functions import globs, paths, predicates, scalars


def column(spark, values, *exprs, name="path"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [tuple(r) for r in df.select("i", *exprs).orderBy("i").drop("i").collect()]


@pytest.mark.parametrize(
    ("path", "out"),
    [
        (".venv/lib/a.py", True), ("web/node_modules/x.js", True), ("dist/b.js", True), ("MyApp/app/lib/jq.js", True), ("app/lib/jq.js", False),
        ("src\\__pycache__\\foo.pyc", True), ("app/services/user.go", False), ("src/bundle.js", False), ("src/build", True), ("a/x.min.js", True), ("site-packages/a/b.py", True),
    ],
)
def test_excluded(spark, path, out):
    assert column(spark, [path], globs.excluded("path", DEFAULT_EXCLUDE)) == [(out,)]


def test_included(spark):
    assert column(spark, ["src/a/b.py", "lib/c.py", "d.go"], globs.included("path", ["src/*", "*.go"])) == [(True,), (False,), (True,)]
    assert column(spark, ["x"], globs.included("path", [])) == [(True,)]


@pytest.mark.parametrize(("glob", "yes", "no"), [("a[0-9].py", "a1.py", "ab.py"), ("[!x]y", "zy", "xy"), ("a.b", "a.b", "axb"), ("a?c", "a/c", "ac"), ("[", "[", "x")])
def test_shell_regex(spark, glob, yes, no):
    assert column(spark, [yes, no, yes + "\n"], F.col("path").rlike(globs.any_of([globs.shell_regex(glob)]))) == [(True,), (False,), (False,)]


@pytest.mark.parametrize(
    ("files", "path", "out"),
    [
        ([(".", "*.log")], "a/b.log", True), ([(".", "*.log")], "a/b.txt", False), ([(".", "build/")], "build/x", True), ([(".", "build/")], "build", False),
        ([(".", "/top")], "a/top", False), ([(".", "/top")], "top/x", True), ([(".", "a/b")], "x/a/b", False), ([(".", "**/z")], "x/y/z", True),
        ([(".", "*.log\n!keep.log")], "keep.log", False), ([("sub", "*.log")], "sub/deep/a.log", True), ([("sub", "*.log")], "a.log", False),
        ([("sub", "!a.log"), (".", "*.log")], "sub/a.log", False), ([(".", "# note\n\n  \n")], "note", False), ([(".", "a/**/c")], "a/c", True), ([(".", "\\#x")], "#x", True), ([], "x", False),
    ],
)
def test_ignored(spark, files, path, out):
    assert column(spark, [path], globs.ignored("path", globs.ignore_rules(files))) == [(out,)]


def test_paths(spark):
    got = column(spark, ["a/b/c.tar.gz", ".env", "x", "a/.hidden.py", "a/b."], paths.basename("path"), paths.dirname("path"), paths.stem("path"), paths.suffix("path"))
    assert got == [("c.tar.gz", "a/b", "c.tar", ".gz"), (".env", ".", ".env", ""), ("x", ".", "x", ""), (".hidden.py", "a", ".hidden", ".py"), ("b.", "a", "b.", "")]
    assert column(spark, ["A.PY", "b.tsx", "c.rb"], paths.language("path")) == [("python",), ("typescript",), (None,)]
    assert column(spark, ["a/b/c/d"], paths.capped("path", 2), paths.label("path")) == [("a/b", "a/b/c/d/")]


@pytest.mark.parametrize(
    ("signature", "deps"),
    [
        ("public S(IRepository repo, ILogger<W> logger)", ["IRepository", "ILogger<W>"]), ("(string a, int b, Foo c)", ["Foo"]), ("()", []), ("broken", []), ("", []),
        ("(Foo[] xs, string[] ys)", ["Foo[]"]), ("(Foo)", ["Foo"]), ("( Map<string, int> m )", ["Map<string"] + ["int>"]),
    ],
)
def test_constructor_deps(spark, signature, deps):
    assert column(spark, [signature], predicates.constructor_deps("path")) == [(deps,)]


@pytest.mark.parametrize(
    ("change", "kind", "visibility", "decorators", "out"),
    [
        ("modified", "method", "public", ["HttpGet"], "high"), ("modified", "method", "private", ["HttpGet('x')"], "low"), ("removed", "class", None, [], "high"),
        ("added", "interface", "private", [], "high"), ("removed", "method", "public", [], "high"), ("removed", "method", "private", [], "low"),
        ("modified", "property", "public", None, "medium"), ("added", "function", "public", [], "medium"), ("added", "property", "public", [], "low"), ("modified", "function", None, [], "low"),
    ],
)
def test_impact(spark, change, kind, visibility, decorators, out):
    df = spark.createDataFrame([(change, kind, visibility, decorators)], "c string, k string, v string, d array<string>")
    assert df.select(predicates.impact("c", "k", "v", "d")).first()[0] == out


def test_thresholds(spark):
    got = column(spark, ["high", "medium", "low", "odd"], *[predicates.passes("path", t) for t in ("high", "medium", "low", "odd")])
    assert got == [(True, True, True, True), (False, True, True, True), (False, False, True, False), (False, False, True, False)]


def test_env_vars(spark):
    text = "os.getenv('A_1') os.environ.get(\"B\") os.environ['CC'] process.env.DD"
    assert column(spark, [text], scalars.env_vars("path", F.lit("python")))[0][0] == ["A_1"]
    assert column(spark, [text], scalars.env_vars("path", F.lit("python"), subscripts=True))[0][0] == ["A_1", "CC"]
    assert column(spark, [text], scalars.env_vars("path", F.lit("typescript")), scalars.env_vars("path", F.lit("ruby")))[0] == (["DD"], [])


@pytest.mark.parametrize(("prefix", "path", "out"), [("api/orders", "{id}", "api/orders/{id}"), ("users", None, "users"), (None, "/x/", "/x/"), ("a", "/b/", "a//b"), ("", "", "")])
def test_route_path(spark, prefix, path, out):
    df = spark.createDataFrame([(prefix, path)], "a string, b string")
    assert df.select(scalars.route_path("a", "b")).first()[0] == out


def test_route_arg(spark):
    assert column(spark, ["Get(':id')", "get('/u', model=X)", 'Route( "a" )', "Get()"], scalars.route_arg("path")) == [(":id",), (None,), ("a",), (None,)]


def test_roles(spark):
    got = column(spark, ["rapid/main.py", "src/main.go", "x/app.ts", "x/index.js", "electron/main.js"], predicates.entry_role("path", paths.stem("path")))
    assert [r[0] for r in got] == ["API module index", "Application entry point", "Application setup", "Module index", "Electron main process"]
