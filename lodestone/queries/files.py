"""Files: changes, snapshots, directories, paths, globs, text scans, manifests, pages of a text."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.config import DEFAULT_EXCLUDE, LANGUAGES
from lodestone.functions import globs, paths, predicates, scalars
from lodestone.operators import changes, directories, manifests, paging, scans
from lodestone.queries import query

#: Source files made of rows, for what the driver's tables lack.
WEB_PATH = r"^https?://[^/]*/?(.*)$"

# The snapshot that documents are compared with: some are missing, some differ, some are gone.
SNAPSHOT_SQL = "SELECT CASE WHEN doc_id % 10 = 4 THEN doc_id + 1000000000 ELSE doc_id END AS doc_id, CASE WHEN doc_id % 7 = 0 THEN sha256(coalesce(text, '') || 'x') ELSE sha256(text) END AS hash FROM documents WHERE doc_id % 10 <> 3"
CHANGES_SQL = f"""
WITH cur AS (SELECT doc_id, sha256(text) AS hash FROM documents), old AS ({SNAPSHOT_SQL})
SELECT coalesce(cur.doc_id, old.doc_id) AS doc_id,
  CASE WHEN old.doc_id IS NULL THEN 'new' WHEN cur.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS status,
  old.hash AS old_hash, cur.hash AS new_hash
FROM cur FULL OUTER JOIN old ON cur.doc_id = old.doc_id
WHERE cur.hash IS DISTINCT FROM old.hash
"""


def _current(t):
    return t("documents").select("doc_id", scalars.content_hash("text").alias("hash"))


def _snapshot(t):
    moved = F.when(F.col("doc_id") % 10 == 4, F.col("doc_id") + 1_000_000_000).otherwise(F.col("doc_id"))
    changed = F.when(F.col("doc_id") % 7 == 0, scalars.content_hash(F.concat(F.coalesce("text", F.lit("")), F.lit("x")))).otherwise(scalars.content_hash("text"))
    return t("documents").filter("doc_id % 10 <> 3").select(moved.alias("doc_id"), changed.alias("hash"))


@query(CHANGES_SQL)
def change_detect(spark, t):
    return changes.detect_changes(_current(t), _snapshot(t), key="doc_id")


@query("SELECT doc_id, 'new' AS status, CAST(NULL AS VARCHAR) AS old_hash, sha256(text) AS new_hash FROM documents WHERE n_chars <= 20000")
def cold_start(spark, t):
    small = t("documents").filter("n_chars <= 20000")
    return changes.cold_start(small.select("doc_id", scalars.content_hash("text").alias("hash")), key="doc_id")


@query(f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({SNAPSHOT_SQL}))")
def new_paths(spark, t):
    return changes.new_keys(_current(t).select("doc_id"), _snapshot(t), key="doc_id")


@query(
    f"""WITH changed AS ({CHANGES_SQL}), old AS ({SNAPSHOT_SQL})
SELECT doc_id, hash FROM old WHERE doc_id NOT IN (SELECT doc_id FROM changed)
UNION ALL SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id IN (SELECT doc_id FROM changed WHERE status <> 'deleted')"""
)
def snapshot_merge(spark, t):
    old, cur = _snapshot(t), _current(t)
    return changes.merge_snapshot(old, changes.detect_changes(cur, old, key="doc_id"), cur, key="doc_id")


@query("SELECT source AS directory, count(*) AS file_count, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS languages FROM documents GROUP BY source")
def dir_rollup(spark, t):
    return directories.rollup(t("documents"), "source", "lang")


@query(
    r"""WITH p AS (SELECT regexp_extract(url, '^https?://[^/]*/?(.*)$', 1) AS path FROM pages),
d AS (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM p)
SELECT array_to_string(string_split(CASE WHEN dir = '' THEN '.' ELSE dir END, '/')[1:2], '/') AS directory, count(*) AS file_count FROM d GROUP BY 1"""
)
def url_dir_rollup(spark, t):
    p = t("pages").select(F.regexp_extract("url", WEB_PATH, 1).alias("path")).withColumn("dir", paths.dirname("path")).withColumn("language", F.lit("html"))
    return directories.rollup(p, "dir", "language", 2).select("directory", "file_count")


@query(
    r"""WITH p AS (SELECT page_id, replace(regexp_extract(url, '^https?://[^/]*/?(.*)$', 1), '\', '/') AS path FROM pages),
b AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d FROM p)
SELECT page_id, path, name, CASE WHEN d = '' THEN '.' ELSE d END AS directory, regexp_replace(name, '^(.+)\.[^.]+$', '\1') AS stem,
  regexp_extract(name, '^.+(\.[^.]+)$', 1) AS suffix FROM b"""
)
def path_parts(spark, t):
    p = t("pages").select("page_id", paths.posix(F.regexp_extract("url", WEB_PATH, 1)).alias("path"))
    return p.select("page_id", "path", paths.basename("path").alias("name"), paths.dirname("path").alias("directory"), paths.stem("path").alias("stem"), paths.suffix("path").alias("suffix"))


#: Paths with what globs, tests and languages look for, made of documents' ids.
DIRS = ["src", "node_modules/x", "app/lib/y", "web/app/lib", "tests", "src/build", "lib/__pycache__", "pkg/spec", "src/api", "Service References/a", "web/static/vendor/q"]
NAMES = ["main.py", "index.ts", "test_a.py", "b_test.go", "c.spec.ts", "d.min.js", "Program.cs", "server.go", "app.jsx", "e.g.cs", "build", "util.test.js", "readme.md"]
FILES_SQL = f"SELECT doc_id, (list_value({', '.join(map(repr, DIRS))}))[doc_id % {len(DIRS)} + 1] || '/' || (list_value({', '.join(map(repr, NAMES))}))[doc_id % {len(NAMES)} + 1] AS path FROM documents"


def _files(t):
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    return t("documents").select("doc_id", F.concat(pick(DIRS), F.lit("/"), pick(NAMES)).alias("path"))


def _globbed(value: str, patterns: list[str]) -> str:
    """Shell patterns in the oracle's own GLOB."""
    return "(" + " OR ".join(f"{value} GLOB '{g}'" for g in patterns) + ")"


_BARE = [b for b in (g.removeprefix("**/").removesuffix("/**") for g in DEFAULT_EXCLUDE) if b and "/" not in b]


@query(f"SELECT doc_id, path FROM ({FILES_SQL}) WHERE NOT ({_globbed('path', DEFAULT_EXCLUDE)} OR len(list_filter(string_split(path, '/'), lambda c: {_globbed('c', _BARE)})) > 0)")
def exclude_globs(spark, t):
    return _files(t).filter(~globs.excluded("path", DEFAULT_EXCLUDE))


_INCLUDE = ["src/*", "*.go"]


@query(f"SELECT doc_id, path FROM ({FILES_SQL}) WHERE path LIKE 'src/%' OR path LIKE '%.go'")
def include_globs(spark, t):
    return _files(t).filter(globs.included("path", _INCLUDE))


_RULES = globs.ignore_rules([(".", "*.js\n/src/\n!src/build\n# note\n\ntests/"), ("lib", "*.py"), ("pkg", "*\n!c.spec.ts")])


@query(
    rf"""SELECT doc_id, path FROM ({FILES_SQL}) WHERE NOT CASE
  WHEN path LIKE 'pkg/%' THEN NOT path LIKE '%/c.spec.ts'
  WHEN path LIKE 'lib/%.py' THEN true
  WHEN path LIKE '%tests/%' THEN true
  WHEN path LIKE 'src/build/%' OR path = 'src/build' THEN false
  WHEN path LIKE 'src/%' THEN true
  ELSE path LIKE '%.js' END"""
)
def ignore_rules(spark, t):
    return _files(t).filter(~globs.ignored("path", _RULES))


_LANG_SQL = "CASE lower(regexp_extract(path, '^.+(\\.[^./]+)$', 1)) " + " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in LANGUAGES.items()) + " END"


@query(f"SELECT doc_id, path, {_LANG_SQL} AS language FROM ({FILES_SQL}) WHERE {_LANG_SQL} IN ('python', 'go', 'typescript')")
def lang_filter(spark, t):
    return _files(t).withColumn("language", paths.language("path")).filter(F.col("language").isin("python", "go", "typescript"))


@query(
    rf"""SELECT doc_id, path, regexp_matches(path, '(^|/)test_[^/]*$|(_test\.py|_test\.go|\.spec\.ts|\.spec\.js|\.test\.ts|\.test\.js)$')
  OR regexp_matches('/' || path || '/', '/(tests|test|__tests__|spec|specs)/') AS is_test,
  regexp_matches(path, 'Connected Services/|Service References/|/Generated/|/obj/|/auto_generated/|/auto-generated/|(\.Designer\.cs|\.g\.cs|\.g\.i\.cs|Reference\.cs|\.generated\.cs|\.designer\.cs)$') AS is_generated
FROM ({FILES_SQL})"""
)
def test_file_flag(spark, t):
    return _files(t).select("doc_id", "path", predicates.is_test("path").alias("is_test"), predicates.is_generated_path("path").alias("is_generated"))


@query(
    rf"""WITH f AS ({FILES_SQL}), c AS (
  SELECT path, coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '.') AS dir, lower(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\.[^.]+$', '\1')) AS stem FROM f
  WHERE NOT (regexp_matches(path, '(^|/)test_[^/]*$|(_test\.py|_test\.go|\.spec\.ts|\.spec\.js|\.test\.ts|\.test\.js)$') OR regexp_matches('/' || path || '/', '/(tests|test|__tests__|spec|specs)/'))),
g AS (SELECT dir, stem, min(path) AS file FROM c WHERE stem IN ('index', 'main', 'app', 'server', 'program', 'bootstrap', 'startup') GROUP BY dir, stem)
SELECT file, CASE WHEN lower(file) LIKE '%electron%' THEN 'Electron main process' WHEN lower(file) LIKE '%preload%' THEN 'Electron preload script'
  WHEN lower(file) LIKE '%routes%' THEN 'Route definitions' WHEN lower(file) LIKE '%api%' THEN 'API module index' WHEN lower(file) LIKE '%server%' THEN 'HTTP server bootstrap'
  WHEN lower(file) LIKE '%backend%' THEN 'Backend entry point' WHEN lower(file) LIKE '%frontend%' THEN 'Frontend entry point'
  WHEN stem = 'main' THEN 'Application entry point' WHEN stem = 'app' THEN 'Application setup' WHEN stem = 'server' THEN 'HTTP server bootstrap' ELSE 'Module index' END AS role FROM g"""
)
def entry_points(spark, t):
    return scans.entry_points(_files(t).distinct())


@query(
    f"""WITH f AS ({FILES_SQL}), d AS (SELECT array_to_string(string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/')[1:2], '/') AS dir, {_LANG_SQL} AS lang FROM f)
SELECT dir || '/' AS directory, count(*) AS file_count, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS languages,
  CASE WHEN list_has_any(string_split(dir, '/'), ['Migrations', 'Properties', 'bin', 'obj', 'dist', 'out', 'target', 'vendor', 'node_modules', '.idea', '.vscode', '.pytest_cache', '__pycache__']) THEN 'boilerplate' END AS kind,
  dir NOT LIKE '%/%' AS top_level FROM d GROUP BY dir"""
)
def project_structure(spark, t):
    return directories.structure(_files(t).withColumn("language", paths.language("path")), 2)


@query(
    r"""WITH w AS (SELECT unnest(regexp_extract_all(text, '[A-Z][A-Z0-9_]+', 0)) AS name FROM documents) SELECT DISTINCT name FROM w"""
)
def token_extract(spark, t):
    return t("documents").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Z][A-Z0-9_]+"), F.lit(0))).alias("name")).distinct()


@query(
    """SELECT DISTINCT CASE doc_id % 4 WHEN 0 THEN 'KEY_' WHEN 1 THEN 'DB_' WHEN 2 THEN 'PORT_' ELSE 'HOME_' END || CAST(doc_id % 17 AS VARCHAR) AS name FROM documents
UNION SELECT DISTINCT 'SET_' || CAST(doc_id % 5 AS VARCHAR) FROM documents"""
)
def env_vars(spark, t):
    n, d = F.col("doc_id") % 17, t("documents")
    kind = F.col("doc_id") % 4
    text = (
        F.when(kind == 0, F.concat(F.lit("x = os.getenv('KEY_"), n, F.lit("')")))
        .when(kind == 1, F.concat(F.lit('y = os.environ.get("DB_'), n, F.lit('")')))
        .when(kind == 2, F.concat(F.lit("f(process.env.PORT_"), n, F.lit(", process.env.lower)")))
        .otherwise(F.concat(F.lit('os.Getenv("HOME_'), n, F.lit('"); os.Getenv(name)')))
    )
    language = F.when(kind < 2, "python").when(kind == 2, "typescript").otherwise("go")
    sources = d.select(F.concat(F.lit("a"), "doc_id").alias("path"), language.alias("language"), text.cast("binary").alias("content"))
    dotenv = d.select(F.lit(".env.example").alias("path"), F.lit(None).cast("string").alias("language"), F.concat(F.lit("# SET=1\n SET_"), F.col("doc_id") % 5, F.lit(" = 1\nlower=2")).cast("binary").alias("content"))
    return scans.env_vars(sources.unionByName(dotenv))


@query(r"""SELECT page_id, nullif(regexp_extract(html, 'href="(.+?)"', 1), '') AS target FROM pages""")
def href_extract(spark, t):
    return t("pages").select("page_id", scalars.first_match("html", r'href="(.+?)"').alias("target"))


@query(
    r"""WITH e AS (SELECT event_id, 'Get(''/' || event_type || '/' || CAST(user_id % 7 AS VARCHAR) || '/'')' AS decorator, CASE WHEN event_id % 3 > 0 THEN 'api/v' || CAST(event_id % 3 AS VARCHAR) END AS prefix FROM events)
SELECT event_id, '/' || split_part(decorator, '/', 2) || '/' || split_part(decorator, '/', 3) || '/' AS arg,
  CASE WHEN prefix IS NULL THEN '/' || split_part(decorator, '/', 2) || '/' || split_part(decorator, '/', 3) || '/' ELSE prefix || '//' || split_part(decorator, '/', 2) || '/' || split_part(decorator, '/', 3) END AS route FROM e"""
)
def route_arg(spark, t):
    d = F.concat(F.lit("Get('/"), "event_type", F.lit("/"), F.col("user_id") % 7, F.lit("/')"))
    prefix = F.when(F.col("event_id") % 3 > 0, F.concat(F.lit("api/v"), F.col("event_id") % 3))
    e = t("events").select("event_id", scalars.route_arg(d).alias("arg"), prefix.alias("prefix"))
    return e.select("event_id", "arg", scalars.route_path("prefix", "arg").alias("route"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM events")
def json_manifest(spark, t):
    return t("events").select("event_id", F.from_json("props", "k string")["k"].alias("k"))


@query(
    """SELECT o_orderkey, 'build:' || o_orderstatus AS script, string_agg(DISTINCT p, ', ' ORDER BY p) AS packages, 'npm' AS package_manager FROM (
  SELECT o_orderkey, o_orderstatus, unnest(list_value('p' || CAST(o_custkey % 5 AS VARCHAR), 'q' || CAST(o_custkey % 3 AS VARCHAR), 'p1')) AS p FROM orders) GROUP BY o_orderkey, o_orderstatus"""
)
def package_manifest(spark, t):
    text = F.format_string('{"scripts": {"build": "%s"}, "dependencies": {"p%d": "1", "p1": "2"}, "devDependencies": {"q%d": "^3"}, "packageManager": "npm@9.1"}', "o_orderstatus", F.col("o_custkey") % 5, F.col("o_custkey") % 3)
    parsed = manifests.package_json(t("orders").select("o_orderkey", text.alias("content")))
    return parsed.select("o_orderkey", F.concat(F.lit("build:"), F.col("scripts")["build"]).alias("script"), F.array_join("packages", ", ").alias("packages"), "package_manager")


@query(
    r"""WITH m AS (SELECT doc_id, replace(text, ',', ':') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM m),
g AS (SELECT doc_id, i, trim(split_part(line, ':', 1)) AS target FROM l WHERE line <> '' AND line NOT LIKE chr(9) || '%' AND line NOT LIKE '#%' AND line LIKE '%:%'),
k AS (SELECT doc_id, target, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS position FROM g WHERE target <> '' AND target NOT LIKE '.%' AND target NOT LIKE '% %')
SELECT doc_id, CAST(position AS INTEGER) AS position, target FROM k WHERE position < 20"""
)
def make_targets(spark, t):
    return manifests.make_targets(t("documents").select("doc_id", F.translate("text", ",", ":").alias("text")), ["doc_id"], "text")


#: Manifests made of parts: modules of which some are indirect, and requirements with version marks.
@query(
    """SELECT p_partkey, 'example.com/a' || CAST(p_partkey % 9 AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN ', example.com/b' || CAST(p_partkey % 4 AS VARCHAR) ELSE '' END || ', example.com/single' AS modules FROM part"""
)
def go_manifest(spark, t):
    n = F.col("p_partkey")
    text = F.concat(
        F.lit("module m\n\nrequire (\n\texample.com/a"), n % 9, F.lit(" v1.0.0\n\t// note\n\texample.com/b"), n % 4, F.lit(" v2.1.0"), F.when(n % 2 == 1, " // indirect").otherwise(""),
        F.lit("\n)\n\nrequire example.com/single v0.1.0\nrequire example.com/gone v1 // indirect\n"),
    )
    parsed = t("part").select("p_partkey", text.alias("content"))
    return parsed.select("p_partkey", F.array_join(manifests.go_requires(parsed), ", ").alias("modules"))


@query(
    """SELECT p_partkey, 'uv run' AS runner, 'pkg' || CAST(p_partkey % 6 AS VARCHAR) || ', pytest' AS packages, 'uv run pytest' AS test, 'uv sync' AS install, 'uv run cli' || CAST(p_partkey % 3 AS VARCHAR) AS script FROM part"""
)
def python_manifest(spark, t):
    text = F.format_string('[project]\ndependencies = ["Pkg%d[extra]>=1.0", "pytest ~= 8"]\n[project.optional-dependencies]\ndev = ["pkg%d<2"]\n[project.scripts]\ncli%d = "a:b"\n', F.col("p_partkey") % 6, F.col("p_partkey") % 6, F.col("p_partkey") % 3)
    made = manifests.pyproject(t("part").select("p_partkey", text.alias("content")), F.lit("uv"))
    script = F.col("scripts")[F.concat(F.lit("cli"), F.col("p_partkey") % 3)]
    return made.select("p_partkey", "runner", F.array_join("packages", ", ").alias("packages"), F.col("scripts")["test"].alias("test"), F.col("scripts")["install"].alias("install"), script.alias("script"))


@query(
    """SELECT 'p' || CAST(p_partkey AS VARCHAR) || '.csproj' AS file, CASE WHEN p_partkey % 2 = 0 THEN 'net8.0' ELSE 'v4.8' END AS target_framework, CASE WHEN p_partkey % 2 = 0 THEN 'Exe' END AS output_type,
  CASE WHEN p_partkey % 2 = 0 THEN 'Pack' || CAST(p_partkey % 5 AS VARCHAR) ELSE 'Lib' || CAST(p_partkey % 7 AS VARCHAR) END AS packages, '../c/C.csproj' AS project_references FROM part"""
)
def dotnet_manifest(spark, t):
    n = F.col("p_partkey")
    sdk = F.concat(F.lit('<Project Sdk="S"><PropertyGroup><TargetFramework>net8.0</TargetFramework><OutputType>Exe</OutputType></PropertyGroup><ItemGroup><PackageReference Include="Pack'), n % 5, F.lit('" Version="1"/><ProjectReference Include="..\\c\\C.csproj"/></ItemGroup></Project>'))
    old = F.concat(
        F.lit('<Project xmlns="http://schemas.example/2003"><PropertyGroup><TargetFrameworkVersion>v4.8</TargetFrameworkVersion></PropertyGroup><ItemGroup><Reference Include="System.Xml"><HintPath>x</HintPath></Reference><Reference Include="Lib'),
        n % 7, F.lit(', Version=1"><HintPath>l.dll</HintPath></Reference><Reference Include="NoHint"/><ProjectReference Include="..\\c\\C.csproj"/></ItemGroup></Project>'),
    )
    made = manifests.csproj(t("part").select(F.concat(F.lit("p"), n, F.lit(".csproj")).alias("path"), F.when(n % 2 == 0, sdk).otherwise(old).alias("content")))
    return made.withColumn("packages", F.array_join("packages", ", ")).withColumn("project_references", F.array_join("project_references", ", "))


@query(
    """SELECT system, file FROM (VALUES ('dotnet', 'src/p1.csproj'), ('dotnet', 'p0.csproj'), ('npm', 'package.json'), ('python', 'setup.py')) AS v(system, file)"""
)
def build_systems(spark, t):
    names = ["src/p1.csproj", "p0.csproj", "package.json", "x/package.json", "global.json", "setup.py", "Pipfile", "a/go.mod"]
    files = spark.createDataFrame([(n,) for n in names], "path string")
    return manifests.build_systems(files).select("system", "file")


@query("WITH p AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT p_brand, count(*) AS n FROM p GROUP BY p_brand HAVING count(*) >= (SELECT count(DISTINCT l_orderkey) FROM p) * 0.1::DOUBLE")
def common_packages(spark, t):
    pairs = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(t("part").select("p_partkey", "p_brand"), "p_partkey")
    return manifests.common_packages(pairs, "l_orderkey", "p_brand", share=0.1)


@query(
    """WITH x AS (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey), c AS (SELECT p_brand FROM x GROUP BY p_brand HAVING count(*) >= (SELECT count(DISTINCT l_orderkey) FROM x) * 0.15::DOUBLE)
SELECT l_orderkey, p_brand FROM x WHERE p_brand NOT IN (SELECT p_brand FROM c)"""
)
def remaining_packages(spark, t):
    pairs = t("lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(t("part").select("p_partkey", "p_brand"), "p_partkey").select("l_orderkey", "p_brand").distinct()
    return manifests.remaining_packages(pairs, manifests.common_packages(pairs, "l_orderkey", "p_brand", share=0.15), "p_brand").select("l_orderkey", "p_brand")


@query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), n AS (SELECT doc_id, CASE WHEN ls[len(ls)] = '' AND len(ls) > 1 THEN ls[1:len(ls)-1] ELSE ls END AS ls FROM l),
c AS (SELECT doc_id, ls, unnest(range(0, CAST(ceil(len(ls) / 3.0) AS BIGINT))) AS chunk FROM n)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, array_to_string(ls[chunk * 3 + 1 : chunk * 3 + 3], chr(10)) AS content FROM c"""
)
def payload_lines(spark, t):
    return paging.line_pages(t("documents"), ["doc_id"], "text", lines=3)


@query("WITH c AS (SELECT doc_id, text, unnest(range(0, greatest(1, CAST(ceil(strlen(text) / 1000.0) AS BIGINT)))) AS chunk FROM documents) SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, sha256(CAST(array_slice(encode(text), chunk * 1000 + 1, chunk * 1000 + 1000) AS BLOB)) AS digest FROM c")
def payload_bytes(spark, t):
    return paging.byte_pages(t("documents"), ["doc_id"], "text", size=1000).select("doc_id", "chunk", F.sha2("content", 256).alias("digest"))


@query(
    """SELECT doc_id, CAST(greatest(1, CASE WHEN len(string_split(text, chr(10))) - 1 < 5 THEN ceil(strlen(text) / 50000.0) ELSE ceil((len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END) / 500.0) END) AS INTEGER) AS chunks FROM documents"""
)
def payload_chunks(spark, t):
    return t("documents").select("doc_id", paging.chunk_count("text").alias("chunks"))


# Beginnings of lines that carry no content, as decorators that carry none.
@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS kept FROM l WHERE NOT (line LIKE 'Licensed%' OR line LIKE 'Copyright%') GROUP BY doc_id"""
)
def noise_filter(spark, t):
    lines = F.filter(F.split("text", "\n"), lambda x: ~predicates.any_(lambda p: F.startswith(x, F.lit(p)), ["Licensed", "Copyright"]))
    return t("documents").select("doc_id", F.size(lines).cast("long").alias("kept")).filter("kept > 0")


#: A listing with root files, configuration, CI files and test directories; directories of documents' ids around them.
LISTING = ["README.md", ".eslintrc.json", "tsconfig.json", "tsconfig.base.json", "pyproject.toml", "Makefile", ".github/workflows/ci.yml", ".gitlab-ci.yml", "tests/a.py", "App.Tests/b.cs", "my.SPEC/c.js", "src/tests/d.py", "sub/tsconfig.json"]


def _listing(spark):
    return spark.createDataFrame([(p,) for p in LISTING], "path string")


@query("SELECT * FROM (VALUES ('README.md'), ('tsconfig.json'), ('tsconfig.base.json'), ('pyproject.toml'), ('Makefile')) AS r(path)")
def root_files(spark, t):
    return scans.root_files(_listing(spark))


@query("SELECT * FROM (VALUES ('config', '.eslintrc.json'), ('config', 'tsconfig.json'), ('config', 'tsconfig.base.json'), ('config', 'pyproject.toml'), ('ci', '.github/workflows/ci.yml'), ('ci', '.gitlab-ci.yml')) AS r(what, path)")
def config_and_ci_files(spark, t):
    files = _listing(spark)
    found = lambda what, xs: scans.listed(files, xs).select(F.lit(what).alias("what"), "path")
    return found("config", scans.CONFIG_FILES).unionByName(found("ci", scans.CI_FILES))


@query("SELECT * FROM (VALUES ('tests/'), ('App.Tests/'), ('my.SPEC/')) AS r(path)")
def test_directories(spark, t):
    return scans.test_directories(_listing(spark)).select("path")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars <= 5000")
def size_filter(spark, t):
    return t("documents").filter("n_chars <= 5000").select("doc_id", "n_chars")
