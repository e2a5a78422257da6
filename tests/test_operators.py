"""Boundary cases of the operators that the queries on the driver's tables don't reach."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from lodestone.config import PROFILES
from lodestone.functions import predicates as P
from lodestone.model import ANALYSIS, SNAPSHOT
from lodestone.operators import changes, directories, links, manifests, paging, registry, scans, symbols, wiring


def symbol(name, kind="class", visibility="public", signature=None, decorators=(), implements=(), parent=None):
    return dict(ordinal=0, name=name, kind=kind, visibility=visibility, signature=signature, decorators=list(decorators), implements=list(implements), parent=parent, line_start=0, line_end=0)


def analyses(spark, *files):
    rows = [(path, language, [], [], [s | {"ordinal": i} for i, s in enumerate(syms)], None) for path, language, syms in files]
    return spark.createDataFrame(rows, ANALYSIS)


def names(n, short):
    return [symbol("ab" if i < short else f"longer{i}", "function") for i in range(n)]


@pytest.mark.parametrize(("language", "n", "short", "out"), [("javascript", 10, 6, True), ("javascript", 10, 3, False), ("typescript", 10, 4, True), ("javascript", 4, 4, False), ("python", 10, 6, False)])
def test_minified(spark, language, n, short, out):
    assert analyses(spark, ("a", language, names(n, short))).select(P.is_minified("language", "symbols")).first()[0] is out


@pytest.mark.parametrize(
    ("syms", "out"),
    [
        ([symbol("A"), symbol("B"), symbol("C", "struct")], True), ([symbol("A")], True), ([symbol("A"), symbol("m", "method", parent="A")], False), ([symbol("A"), symbol("_m", "method", parent="A")], True),
        ([symbol("f", "function")], False), ([symbol("_A")], False), ([symbol("A"), symbol("f", "function")], True), ([], False),
    ],
)
def test_low_entropy(spark, syms, out):
    assert analyses(spark, ("a", "python", syms)).select(P.is_low_entropy("symbols")).first()[0] is out


def test_format_files(spark):
    svc = [
        symbol("Svc", signature="class Svc", decorators=["DataContractAttribute", "Injectable()"], implements=["IA"]), symbol("Svc", "constructor", signature="Svc(IRepo r, int n)", parent="Svc"),
        *[symbol(f"m{i}", "method", signature=None if i else "", parent="Svc") for i in range(14)], symbol("_p", "method", parent="Svc"), symbol("Dto", "struct"), symbol("helper", "function"), symbol("inner", "field", parent="Svc"),
    ]
    df = analyses(
        spark, ("a.py", "python", svc), ("b.py", "python", [symbol("D1"), symbol("D2")]), ("c.py", "python", [symbol("f", "function")]), ("d.g.cs", "c_sharp", svc), ("e.js", "javascript", names(10, 6)),
        ("f.py", "python", [symbol("X", implements=["object"]), symbol("m", "method", "private", parent="X")]), ("g.py", "python", []), ("h.py", "python", [symbol("f", "function", decorators=["x"])]),
    )
    got = {r["file"]: r for r in symbols.format_files(df, PROFILES["medium"]).collect()}
    assert sorted(got) == ["a.py", "b.py", "f.py", "h.py"]
    a = got["a.py"]["symbols"]
    assert [s["name"] for s in a] == ["Svc", "Dto", "helper"]
    assert a[0]["methods"] == [f"m{i}" for i in range(12)] and a[0]["total_methods"] == 14 and a[0]["constructor_deps"] == ["IRepo"] and a[0]["decorators"] == ["Injectable()"] and a[0]["implements"] == ["IA"]
    assert a[1]["is_dto"] and a[2]["methods"] is None and a[2]["is_dto"] is None
    assert got["b.py"]["kind"] == "dto_container" and got["b.py"]["symbols_count"] == 2 and got["b.py"]["symbols"] is None and got["f.py"]["kind"] == "dto_container"
    capped = symbols.format_files(df, replace(PROFILES["medium"], max_symbols_per_file=2)).filter("file = 'a.py'").first()
    assert len(capped["symbols"]) == 2 and capped["total_symbols"] == 3


def test_diff_entries(spark):
    old = spark.createDataFrame([("a.py", "h", [("gone", "class", "public", "class gone", []), ("same", "function", "public", "s", []), ("mod", "function", "public", "v1", [])]), ("b.py", "h", [("x", "field", "public", "x", [])]), ("d.py", "h", [])], SNAPSHOT)
    now = analyses(
        spark, ("a.py", "python", [symbol("same", "function", signature="s"), symbol("mod", "function", signature="v1"), symbol("mod", "function", signature="v2", decorators=["d"]), symbol("new", "method", "private")]),
        ("b.py", "python", [symbol("y", "field")]), ("c.py", "python", [symbol("z")]),
    )
    changed = spark.createDataFrame([(p, "modified", "h", "g") for p in ("a.py", "b.py", "c.py")] + [("d.py", "deleted", "h", None)], "path string, status string, old_hash string, new_hash string")
    got = {r["file"]: r for r in symbols.diff_entries(changed, now, old, "medium").collect()}
    assert list(got) == ["a.py"]  # b.py is below the threshold, c.py has no snapshot
    a = got["a.py"]
    assert a["impact"] == "high" and [s["name"] for s in a["removed_symbols"]] == ["gone"] and [s["signature"] for s in a["modified_symbols"]] == ["v2"] and a["added_symbols"] == []
    assert a["modified_symbols"][0]["decorators"] == ["d"] and a["removed_symbols"][0]["decorators"] is None


def entries(spark, *files):
    out = []
    for file, language, classes in files:
        out.append((file, language, None if classes is not None else "dto_container", None, None, None, None if classes is None else [dict(name=n, kind="class", signature=n, implements=None, constructor_deps=None, methods=ms, total_methods=None, is_dto=None, decorators=None) for n, ms in classes]))
    schema = "file string, language string, kind string, is_dto boolean, symbols_count int, total_symbols int, symbols array<struct<name:string,kind:string,signature:string,implements:array<string>,constructor_deps:array<string>,methods:array<string>,total_methods:int,is_dto:boolean,decorators:array<string>>>"
    return spark.createDataFrame(out, schema)


def collapsed(spark, *files, threshold=8):
    rows = directories.collapse(entries(spark, *files), PROFILES["medium"], threshold).orderBy("position").collect()
    return [r.asDict(recursive=True) for r in rows]


def test_collapse_shared_methods(spark):
    files = [(f"repo/r{i}.go", "go", [(f"User{i}Repo", ["Find()", "Save()", "Drop()", *(["Odd()"] if i == 3 else [])])]) for i in range(8)]
    got = collapsed(spark, *files, ("repo/x.py", "python", [("X", ["a"])]), ("other/y.go", "go", [("Y", ["b"])]))
    assert [(r["kind"], r["directory"], r["file"]) for r in got] == [(None, None, "other/y.go"), ("directory_summary", "repo/", None), (None, None, "repo/x.py")]
    s = got[1]
    assert s["common_methods"] == ["Drop()", "Find()", "Save()"] and s["file_count"] == 8 and s["language"] == "go" and s["note"] is None
    assert s["naming_pattern"] == {"pattern": "*Repo", "examples": ["User0Repo", "User1Repo", "User2Repo"], "total": 8}
    assert s["outliers"] == [{"file": "repo/r3.go", "unique_methods": ["Odd()"]}] and s["sample_files"] == ["repo/r0.go", "repo/r4.go", "repo/r7.go"]


def test_collapse_without_pattern(spark):
    unique = collapsed(spark, *[(f"a/f{i}.py", "python", [(f"C{i}", [f"m{i}"])]) for i in range(8)])
    assert [r["note"] for r in unique] == ["No common method pattern detected"] and unique[0]["common_methods"] is None
    data = collapsed(spark, *[(f"a/f{i}.py", "python", [(f"Order{i}Entity", [] if i < 8 else ["m"])]) for i in range(10)])
    assert data[0]["note"].startswith("DTO/entity classes") and data[0]["common_methods"] == [] and data[0]["naming_pattern"]["pattern"] == "*Entity"
    less = collapsed(spark, *[(f"a/f{i}.py", "python", [(f"C{i}", [] if i < 6 else ["m"])]) for i in range(10)])
    assert less[0]["note"] == "No common method pattern detected"
    boxes = collapsed(spark, *[(f"f{i}.py", "python", None) for i in range(9)])
    assert boxes[0]["note"] == "Contains 9 DTO/Entity classes with no logic methods" and boxes[0]["directory"] == "./" and boxes[0]["sample_files"] == ["f0.py", "f4.py", "f8.py"]


def test_collapse_keeps_small_directories(spark):
    few = collapsed(spark, *[(f"a/f{i}.py", "python", [(f"C{i}", ["m"])]) for i in range(7)])
    assert [r["file"] for r in few] == [f"a/f{i}.py" for i in range(7)]
    over = collapsed(spark, *[(f"a/f{i}.py", "python" if i % 2 else "go", [(f"C{i}", ["m"])]) for i in range(10)])
    assert [r["file"] for r in over] == [f"a/f{i}.py" for i in range(8)] + [None] and over[-1]["kind"] == "overflow" and over[-1]["remaining_files"] == 2
    assert collapsed(spark) == []


@pytest.mark.parametrize(
    ("classes", "pattern"),
    [
        (["UserService", "OrderService", "ItemService"], ("*Service", 3)), (["AbstractA", "AbstractB", "AbstractC"], ("Abstract*", 3)), (["ARequest", "BRequest", "CRequest", "Other"], ("*Request", 3)),
        (["Foo", "Bar", "Baz"], None), (["Single"], None),
    ],
)
def test_name_pattern(spark, classes, pattern):
    df = spark.createDataFrame([("d", c, i) for i, c in enumerate(classes)], "g string, name string, o int")
    got = directories.name_pattern(df, "g", "name", "o").collect()
    assert [(r["pattern"], r["total"]) for r in got] == ([pattern] if pattern else [])


@pytest.mark.parametrize(("verbs", "cap", "picked"), [("GGGGGPPD", 5, "GPDGG"), ("GGGP", 3, "GPG"), ("GPG", 5, "GPG"), ("GPDXY", 2, "GP")])
def test_cap_routes(spark, verbs, cap, picked):
    df = spark.createDataFrame([("c", v, i) for i, v in enumerate(verbs)], "c string, v string, o int")
    got = wiring.cap_routes(df, "c", "v", "o", cap).orderBy("pick").collect()
    assert "".join(r["v"] for r in got) == picked and {r["total"] for r in got} == {len(verbs)}


def test_wiring_caps(spark):
    many = [(f"f{i:02}.ts", "typescript", [symbol(f"C{i}", decorators=[f"Controller('c{i}')"]), *[symbol(f"m{j}", "method", decorators=["Get('x')" if j < 11 else "Post()"], parent=f"C{i}") for j in range(15)]]) for i in range(20)]
    got = wiring.wiring(analyses(spark, *many), PROFILES["medium"]).orderBy("position").collect()
    assert len(got) == 15 and got[0]["total_route_files"] == 20 and len(got[0]["routes"]) == 8 and got[0]["total_routes"] == 15
    assert [r["method"] for r in got[0]["routes"]] == ["GET", "POST", *["GET"] * 6] and got[0]["routes"][0]["path"] == "c0/x"


def test_interface_map(spark):
    df = analyses(
        spark, ("a.ts", "typescript", [symbol("IRepo", "interface"), symbol("A", implements=["IRepo", "Unknown", "IRepo"])]), ("b.go", "go", [symbol("IStore", "interface"), symbol("Store", "struct"), symbol("Repo", "struct")]),
        ("c.py", "python", [symbol("IStore2"), symbol("B", implements=["IRepo"])]),
    )
    got = {r["interface"]: r["implementors"] for r in links.interface_map(df).collect()}
    assert got == {"IRepo": ["A", "A", "B", "Repo"], "IStore": ["Store"]}
    assert links.interface_map(analyses(spark)).count() == 0


def test_changes(spark):
    cur = spark.createDataFrame([("same", "1"), ("mod", "2"), ("new", "3")], "path string, hash string")
    old = spark.createDataFrame([("same", "1", True), ("mod", "1", True), ("gone", "1", False), ("hidden", "1", True)], "path string, hash string, there boolean")
    got = {r["path"]: r["status"] for r in changes.detect_changes(cur, old, still_there="there").collect()}
    assert got == {"mod": "modified", "new": "new", "gone": "deleted"}
    assert changes.detect_changes(cur, cur).count() == 0
    merged = changes.merge_snapshot(old.drop("there"), changes.detect_changes(cur, old), cur.filter("path != 'new'"))
    assert sorted(tuple(r) for r in merged.collect()) == [("mod", "2"), ("same", "1")]


def test_manifests(spark):
    df = spark.createDataFrame([("package.json", "{broken"), ("package.json", '{"dependencies": {"b": "1", "a": "2"}, "packageManager": "pnpm@8"}')], "path string, content string")
    bad, good = manifests.package_json(df).collect()
    assert bad["packages"] == [] and bad["scripts"] is None and good["packages"] == ["a", "b"] and good["package_manager"] == "pnpm"
    toml = spark.createDataFrame([("not toml [",), ("[project]\nname = 'x'",), ('[project]\ndependencies = ["unittest"]\n[project.scripts]\ntest = "a:b"\n',)], "content string")
    rows = manifests.pyproject(toml, F.lit(None).cast("string")).collect()
    assert rows[0]["scripts"] is None and rows[1]["packages"] == [] and rows[2]["scripts"] == {"test": "python python -m unittest"}
    xml = spark.createDataFrame([("a.csproj", "<broken"), ("b.csproj", "<Project>" + "".join(f'<PackageReference Include="P{i}"/>' for i in range(20)) + "</Project>")], "path string, content string")
    rows = manifests.csproj(xml).collect()
    assert [r["file"] for r in rows] == ["b.csproj"] and len(rows[0]["packages"]) == 15 and rows[0]["target_framework"] is None
    make = spark.createDataFrame([(1, "# c: x\n.PHONY: all\nall: build\n\tgo: x\nVAR := 1\ntwo words: x\n" + "".join(f"t{i}:\n" for i in range(30)))], "i int, text string")
    assert [r["target"] for r in manifests.make_targets(make, ["i"], "text").orderBy("position").collect()][:3] == ["all", "VAR", "t0"]
    assert manifests.make_targets(make, ["i"], "text").count() == 20


def test_registry(spark):
    df = spark.createDataFrame([(s, i) for i, s in enumerate("bbbaaacdd")], "s string, o int")
    known = registry.registry(df, "s", "o")
    assert {r["s"]: r["key"] for r in known.collect()} == {"b": "m0", "a": "m1"}
    assert [r["s"] for r in registry.rewrite(df, known, "s").orderBy("o").collect()] == ["m0"] * 3 + ["m1"] * 3 + ["c", "d", "d"]


@pytest.mark.parametrize(("text", "chunks"), [("x\n" * 510, 2), ("x\n" * 500, 1), ("x\n" * 1500, 3), ("y" * 50_001, 2), ("", 1)])
def test_paging(spark, text, chunks):
    df = spark.createDataFrame([(1, text)], "i int, t string")
    assert df.select(paging.chunk_count("t")).first()[0] == chunks
    lines = [r["content"] for r in paging.line_pages(df, ["i"], "t").orderBy("chunk").collect()]
    assert "\n".join(lines) == (text[:-1] if text.endswith("\n") else text)
    assert b"".join(r["content"] for r in paging.byte_pages(df, ["i"], "t").orderBy("chunk").collect()).decode() == text


def test_scans(spark):
    df = spark.createDataFrame([(p,) for p in ["a.py", ".hidden", "Makefile", "tests/x.py", "App.Tests/y.cs", "my.spec/z.js", ".github/workflows/ci.yml", "tsconfig.base.json", "tsconfig.json", "sub/tsconfig.json"]], "path string")
    assert [r["path"] for r in scans.root_files(df).collect()] == ["Makefile", "a.py", "tsconfig.base.json", "tsconfig.json"]
    assert [r["path"] for r in scans.test_directories(df).collect()] == ["tests/", "App.Tests/", "my.spec/"]
    assert [r["path"] for r in scans.listed(df, scans.CONFIG_FILES).collect()] == ["tsconfig.json", "tsconfig.base.json"]
    assert [r["path"] for r in scans.listed(df, scans.CI_FILES).collect()] == [".github/workflows/ci.yml"]


def test_filters_reach_the_scan(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("n_chars <= 100").select("doc_id")
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(n_chars,100)" in plan and "text" not in plan.split("ReadSchema")[1]
