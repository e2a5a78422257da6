"""Whole scans over small projects: sources, snapshots, payload, paging, connectors, streaming."""

import json
import subprocess

import pytest

from lodestone.config import PROFILES, ScanConfig, load_config
from lodestone.functions import globs
from lodestone.plans import cli, connectors, payload, scan
from lodestone.sources import listing, snapshot, tree
from lodestone.streaming import incremental

FILES = {
    "src/api/main.py": "import os\n\n@app.get('/items')\ndef items():\n    return os.getenv('API_KEY')\n\nclass Repo(IRepo):\n    def find(self, n: int): ...\n",
    "src/svc/store.go": "package svc\n\ntype IStore interface {\n\tGet(id int) error\n}\n\ntype Store struct{}\n\nfunc (s *Store) Get(id int) error { return nil }\n",
    "src/web/ctl.ts": "export interface IRepo { a(): void }\n@Controller('u')\nexport class Users implements IRepo {\n  @Get(':id')\n  one(id: string): void { }\n}\n",
    "tests/test_main.py": "class TestItems:\n    def test_a(self): ...\n    def test_b(self): ...\n",
    "node_modules/x/y.js": "class Hidden { m() {} }\n",
    "ignored/z.py": "class Z:\n    def m(self): ...\n",
    ".gitignore": "ignored/\n",
    ".env.example": "DB_URL=1\n# NOTE=1\nlower=2\n",
    "package.json": '{"scripts": {"build": "tsc"}, "dependencies": {"b": "1"}, "packageManager": "pnpm@8"}',
    "Makefile": "build: x\n\tgo build\n",
    "README.md": "hello\n",
    "src/__init__.py": "",
}


def project(at, files=FILES, git=False):
    for name, text in files.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_text(text)
    if git:
        run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", *a], cwd=at, check=True, capture_output=True)
        run("init", "-q")
        run("add", "-A")
        run("commit", "-qm", "x")
    return at


def result(at, base):
    return json.loads((snapshot.snapshot_dir(at, base) / payload.PAYLOAD_FILE).read_text())


@pytest.mark.parametrize("git", [False, True])
def test_scan_and_rescan(spark, tmp_path, git):
    at, base = project(tmp_path / "p", git=git), tmp_path / "cache"
    out = scan.scan(spark, str(at), base=base)
    assert out["status"] == "ready" and out["total_chunks"] == 1
    got = result(at, base)
    assert list(got)[:2] == ["metadata", "project_structure"] and got["metadata"]["languages_detected"] == ["go", "python", "typescript"]
    assert got["env_vars"] == ["API_KEY", "DB_URL"] and got["entry_points"] == [{"file": "src/api/main.py", "role": "API module index"}]
    assert got["build_system"]["detected"] == ["npm", "make", "pnpm"] and got["build_system"]["scripts"] == {"npm": {"build": "tsc"}, "make": {"build": "make build"}}
    assert {r["file"] for r in got["full_analysis"] if "file" in r} == {"src/api/main.py", "src/svc/store.go", "src/web/ctl.ts"}
    assert [r for r in got["full_analysis"] if r.get("kind") == "test_directory_summary"] == [{"directory": "tests/", "kind": "test_directory_summary", "file_count": 1, "test_function_count": 1, "languages": ["python"], "files": ["tests/test_main.py"]}]
    assert got["interface_impl_map"] == {"IRepo": ["Repo", "Users"], "IStore": ["Store"]}
    assert got["wiring"]["route_map"][0]["routes"] == [{"method": "GET", "path": "/items", "handler": "items"}]
    assert got["project_structure"]["directories"]["src/api/"] == {"languages": "python", "file_count": 1} and got["project_structure"]["test_directories"] == ["tests/"]

    assert scan.scan(spark, str(at), force_full=False, base=base) == {"status": "no_changes", "total_chunks": 0}
    (at / "src/svc/store.go").unlink()
    (at / "src/web/ctl.ts").write_text("@Controller('u')\nexport class Users {\n  @Get(':id')\n  two(id: string): void { }\n}\n")
    (at / "src/api/more.py").write_text("class More:\n    def m(self): ...\n")
    if git:
        subprocess.run(["git", "add", "-A"], cwd=at, check=True)
    assert scan.scan(spark, str(at), force_full=False, base=base)["status"] == "ready"
    got = result(at, base)
    assert [(c["file"], c["status"], c["impact"]) for c in got["changes"]] == [("src/svc/store.go", "deleted", "high"), ("src/web/ctl.ts", "modified", "high")]
    diff = got["changes"][1]["diff"]
    assert [s["name"] for s in diff["removed_symbols"]] == ["IRepo", "one"] and [s["name"] for s in diff["added_symbols"]] == ["two"]
    assert [r["file"] for r in got["full_analysis"]] == ["src/api/more.py"]
    kept = {r["path"] for r in snapshot.load(spark, at, base).collect()}
    assert kept == {"src/__init__.py", "src/api/main.py", "src/api/more.py", "src/web/ctl.ts", "tests/test_main.py"}
    assert [r["symbols"] for r in snapshot.load(spark, at, base).filter("path = 'tests/test_main.py'").collect()] == [[]]


def test_generate(spark, tmp_path):
    at, base = project(tmp_path / "p"), tmp_path / "c"
    (at / ".cursor").mkdir()
    (at / "CLAUDE.md").write_text("mine\n")
    (at / "AGENTS.md").write_text("old text")
    out = scan.generate(spark, str(at), client="Claude Desktop", base=base)
    assert sorted(out["connectors"]) == [".cursorrules", "CLAUDE.md"] and (at / "CLAUDE.md").read_text() == "@AGENTS.md\n\nmine\n"
    got = result(at, base)
    assert got["existing_agents_md"] == "old text" and got["instructions"] == "update-existing"
    assert scan.generate(spark, str(at), client="claude", base=base)["connectors"] == []
    assert "error" in scan.generate(spark, str(at / "none")) and "error" in scan.scan(spark, str(at / "none"))


def test_tree(spark, tmp_path):
    at = project(tmp_path / "t", {"_a.py": "", ".b": "x", "d/e.py": "y" * 100})
    rows = {r["path"]: r for r in tree.read_tree(spark, str(at)).collect()}
    assert sorted(rows) == [".b", "_a.py", "d/e.py"] and rows["_a.py"]["content"] == b"" and rows["d/e.py"]["size_bytes"] == 100
    assert [r["path"] for r in tree.read_tree(spark, str(at), max_bytes=99).orderBy("path").collect()] == [".b", "_a.py"]
    assert all(r["content"] is None and r["hash"] for r in tree.read_tree(spark, str(at), content=False).collect())
    small = tree.source_files(spark, str(at), ScanConfig(max_file_size_bytes=100))
    assert {r["path"] for r in small.collect()} == {"_a.py", "d/e.py"}
    assert listing.git_files(tmp_path / "nowhere") is None and tree.read_tree(spark, str(tmp_path / "t")).count() == 3
    (tmp_path / "empty").mkdir()
    assert tree.read_tree(spark, str(tmp_path / "empty")).count() == 0


def test_snapshot(spark, tmp_path):
    at = project(tmp_path / "p", {"a.py": ""}, git=True)
    assert snapshot.load(spark, at, tmp_path / "c") is None
    rows = spark.createDataFrame([("a.py", "h", [])], snapshot.SNAPSHOT)
    snapshot.save(rows, at, tmp_path / "c")
    snapshot.save(snapshot.load(spark, at, tmp_path / "c").unionByName(rows), at, tmp_path / "c")
    assert snapshot.load(spark, at, tmp_path / "c").count() == 2
    d = snapshot.snapshot_dir(at, tmp_path / "c")
    assert len(d.name) == 16 and len(list(d.glob("files-*"))) == 1
    header = json.loads((d / snapshot.HEADER).read_text())
    assert header["base_commit"] == listing.current_commit(at) and listing.is_known_commit(at, None)
    (d / snapshot.HEADER).write_text(json.dumps(header | {"base_commit": "0" * 40}))
    assert snapshot.load(spark, at, tmp_path / "c") is None
    (d / snapshot.HEADER).write_text("{broken")
    assert snapshot.load(spark, at, tmp_path / "c") is None


@pytest.mark.parametrize("text", [None, "{broken", "[1]", '{"exclude": 1, "project_size": "huge", "max_file_size_bytes": true}'])
def test_bad_config_gives_defaults(tmp_path, text):
    if text:
        (tmp_path / "lodestone.config.json").write_text(text)
    got = load_config(tmp_path)
    assert got.profile == PROFILES["medium"] and got.max_file_size_bytes == 1_048_576 and len(got.exclude) == 22 and got.allowed is None


def test_config(tmp_path):
    (tmp_path / "lodestone.config.json").write_text('{"project_size": "large", "languages": ["go"], "agents_md_path": "./.x/A.md"}')
    got = load_config(tmp_path)
    assert got.profile.max_dir_depth == 2 and got.extensions() == {".go": "go"} and got.output_path == "./.x/A.md"
    assert ScanConfig(languages="go").allowed == {"go"}


def test_pages(tmp_path):
    file = tmp_path / payload.PAYLOAD_FILE
    text = "".join(f"line {i}\n" for i in range(1500))
    file.write_text(text)
    assert payload.read_chunk(tmp_path, 99)["error"].startswith("chunk_index 99") and payload.read_chunk(tmp_path, -1)["error"]
    pages = [payload.read_chunk(tmp_path, i) for i in range(3)]
    assert "".join(p["data"] for p in pages) == text and [p["has_more"] for p in pages] == [True, True, False] and not file.exists()
    assert "error" in payload.read_chunk(tmp_path, 0)
    big = {"a": ["\u00e9" * 100] * 1000}
    assert payload.write(big, tmp_path) == -(-len(payload.encode(big)) // 50_000) and payload.is_compact(payload.encode(big))


def test_connectors(tmp_path):
    assert connectors.connector_for("my-Cursor v2").agent_id == "cursor" and connectors.connector_for(None) is None and connectors.connector_for("vim") is None
    assert connectors.setup(tmp_path, "AGENTS.md") == [] and connectors.setup(tmp_path, "AGENTS.md", "gemini") == [".gemini/GEMINI.md"]
    assert (tmp_path / ".gemini/GEMINI.md").read_text() == "@AGENTS.md\n"


def test_stream(spark, tmp_path):
    src, at = tmp_path / "in", str(tmp_path / "state")
    schema = "path string, hash string, seq int"
    for k, rows in enumerate([[("a", "1", 0), ("b", "1", 0)], [("a", "2", 0), ("b", None, 1), ("b", "1", 0), ("c", "1", 0)], [("a", "2", 0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = incremental.watch(spark.readStream.schema(schema).parquet(str(src)), at, str(tmp_path / "cp"))
        q.awaitTermination(60)
        assert q.exception() is None, k
    log = sorted((r["batch"], r["path"], r["status"]) for r in incremental.change_log(spark, at).collect())
    assert log == [(0, "a", "new"), (0, "b", "new"), (1, "a", "modified"), (1, "b", "deleted"), (1, "c", "new")]


def test_cli(spark, tmp_path, capsys):
    at = project(tmp_path / "p", {"a.py": "class A:\n    def m(self): ...\n"})
    assert cli.main(["scan", str(at), "--base", str(tmp_path / "c")]) == 0 and cli.main(["read", str(at), "--base", str(tmp_path / "c")]) == 0
    lines = capsys.readouterr().out.strip().splitlines()
    assert json.loads(lines[0])["status"] == "ready" and '"full_analysis"' in json.loads(lines[1])["data"]
    assert cli.main(["read", str(at), "--base", str(tmp_path / "c")]) == 1


def test_files_left_out_are_never_opened(spark, tmp_path):
    at = tmp_path / "p"
    for p in ("a.py", "lib/b.go", "node_modules/x/i.js", "ignored/c.py", "package.json", "data.bin"):
        (at / p).parent.mkdir(parents=True, exist_ok=True)
        (at / p).write_text("{}" if p.endswith("json") else "x = 1\n")
    (at / ".gitignore").write_text("ignored/\n")
    opened = lambda df: {r["path"] for r in df.collect() if r["hash"] is not None}
    scanned = tree.scanned_files(spark, str(at), ScanConfig())
    assert {p for part in tree.TreeReader({"path": str(at), "ignore": "true", "exclude": json.dumps(ScanConfig().exclude)}).partitions() for p, *_ in part.rows} == {"a.py", "lib/b.go", "package.json", "data.bin", ".gitignore"}
    assert opened(scanned) == {"a.py", "lib/b.go", "package.json", "data.bin", ".gitignore"}
    assert opened(tree.source_files(spark, str(at), ScanConfig())) == opened(tree.source_files(spark, str(at), ScanConfig(), scanned)) == {"a.py", "lib/b.go"}
    assert opened(tree.read_tree(spark, str(at), read=scan.NOTHING)) == set() and tree.read_tree(spark, str(at), read=scan.NOTHING).count() == 7
    assert opened(tree.read_tree(spark, str(at), read=scan.MANIFESTS)) == {"a.py", "package.json", "data.bin", ".gitignore"}


def test_driver_tests_of_paths_are_the_columns(spark):
    paths = ["a/node_modules/b.js", "node_modules", "x/y.min.js", "src/build", "a/__pycache__/c.pyc", "src/a.py", "lib/x/y.py", "tests/a\nb", "dist/z", "q/distant/z", "Service References/a"]
    rules = globs.ignore_rules([(".", "*.js\n/src/\n!src/build\ntests/"), ("lib", "*.py")])
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    got = df.select("path", globs.excluded("path", ScanConfig().exclude).alias("e"), globs.ignored("path", rules).alias("i")).collect()
    excludes, ignores = globs.excludes(ScanConfig().exclude), globs.ignores(rules)
    assert [(r["path"], r["e"], r["i"]) for r in got] == [(p, excludes(p), ignores(p)) for p in paths]
