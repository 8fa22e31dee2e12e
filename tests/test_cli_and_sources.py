import json
import subprocess

import pytest

from codeloom.cli import main, parse_target
from codeloom.schema import RELATIONS
from codeloom.sources import ndjson, vcs
from codeloom.sources.tree import read_collection, read_tree, walk
from codeloom.store import Store


def put(root, files):
    for p, text in files.items():
        f = root / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(text if isinstance(text, bytes) else text.encode())


def git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


def test_walk_and_ignores(tmp_path):
    put(tmp_path, {".gitignore": "build/\n*.log\n!keep.log\n/top.py\n", "a.py": "", "top.py": "", "sub/top.py": "", "build/x.py": "", "x.log": "", "keep.log": "", ".hid/a.py": "", "sub/.gitignore": "gen_*\n", "sub/gen_a.py": "", "gen_a.py": "", "sub/ok.rs": ""})
    assert walk(str(tmp_path)) == ["a.py", "gen_a.py", "keep.log", "sub/ok.rs", "sub/top.py"]


def test_own_ignore_file_and_order(tmp_path):
    put(tmp_path / "t", {".gitignore": "a.py\n", ".ignore": "!a.py\nb.py\n", "a.py": "", "b.py": "", "c.py": "", "d.py": ""})
    git(tmp_path / "t", "init", "-q")
    (tmp_path / "mine").write_text("c.py\n")
    git(tmp_path / "t", "config", "core.excludesFile", str(tmp_path / "mine"))
    assert walk(str(tmp_path / "t")) == ["a.py", "d.py"]


def test_reading(spark, tmp_path):
    put(tmp_path, {"a.py": "x = 1\n", "b.go": b"\xff\xfe", "c.txt": "no"})
    for df in (read_tree(spark, str(tmp_path)), read_collection(spark, f"file://{tmp_path}")):
        got = {r.path: (r.language, r.content, r.error is None) for r in df.collect()}
        assert got == {"a.py": ("python", "x = 1\n", True), "b.go": ("go", None, False)}
    (tmp_path / "none").mkdir()
    assert read_tree(spark, str(tmp_path / "none")).count() == 0


def test_status_lines(spark):
    parse = lambda out, below="": [tuple(r) for r in vcs.status_rows(spark.createDataFrame([(x,) for x in out.splitlines()], "value string"), below).collect()]
    out = "M\ta.py\nA\tsub/b.py\nD\tc.py\nR100\told.py\tsub/new.py\nC75\ta.py\tsub/copy.py\n"
    assert parse(out) == [("M", "a.py"), ("A", "sub/b.py"), ("D", "c.py"), ("D", "old.py"), ("M", "sub/new.py"), ("M", "sub/copy.py")]
    assert parse(out, "sub/") == [("A", "b.py"), ("M", "new.py"), ("M", "copy.py")]


def test_records(spark, tmp_path):
    f = tmp_path / "r.ndjson"
    rows = [{"type": "ping", "available": True, "protocol_version": 1}, {"type": "definition", "docid": "M:a", "name": "a", "file": "a.cs", "start_line": 1, "start_col": 1}] * 2
    rows += [{"type": "reference", "docid": "M:a", "file": "a.cs", "line": 2, "col": 3, "is_definition": False}, {"type": "reference", "docid": "M:x", "file": "a.cs", "line": 2, "col": 3}, {"type": "other"}]
    f.write_text("\n".join(map(json.dumps, rows)))
    rec = ndjson.read_records(spark, str(f))
    for version, want in (("8.0.1", True), ("7.0", False), ("x", False), ("10", True)):
        f.write_text(json.dumps({**rows[0], "dotnet_version": version}))
        assert ndjson.usable(ndjson.read_records(spark, str(f))).first()[0] is want
    f.write_text("\n".join(map(json.dumps, rows)))
    assert ndjson.definitions(rec).count() == 1 and ndjson.references(rec).count() == 1 and ndjson.usable(rec).first()[0]
    f.write_text(json.dumps(rows[0]) + "\n{broken\n")
    with pytest.raises(Exception):  # noqa: B017
        ndjson.read_records(spark, str(f)).collect()


@pytest.mark.parametrize(
    "text,want",
    [("name", ("name", None, None)), ("src/a.py:f", ("f", None, "src/a.py")), ("src/a.py", (None, None, "src/a.py")), ("a.py", (None, None, "a.py")), ("Cart.total", ("total", "Cart", None)), ("a::b", ("b", None, "a:"))],
)
def test_targets(text, want):
    t = parse_target(text)
    assert (t.name, t.scope, t.file) == want


@pytest.mark.parametrize("where", ["data", "version"])
def test_a_crash_leaves_the_index_as_it_was(spark, tmp_path, where):
    store = Store(spark, f"file://{tmp_path}/x")
    meta = lambda v: {"metadata": spark.createDataFrame([("k", v)], "key string, value string")}
    assert not store.exists()
    with pytest.raises(RuntimeError):
        store.write(meta("a"), fail_at=where)
    assert not store.exists()
    assert store.write(meta("a")) == 1
    with pytest.raises(RuntimeError):
        store.write(meta("b"), fail_at=where)
    assert store.current() == 1 and store.read("metadata").first().value == "a"
    assert store.write(meta("c")) == 2 and store.read("metadata").first().value == "c" and store.read("metadata", 1).first().value == "a"
    store.drop_old(1)
    assert store.versions() == [2] and store.read("metadata").first().value == "c" and len(list((tmp_path / "x/data/metadata").iterdir())) == 1


def test_a_version_keeps_relations_of_the_one_before(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/x")
    note = lambda v: spark.createDataFrame([("k", v)], "key string, value string")
    files = spark.createDataFrame([(1, "a.py", "h", "python", None)], RELATIONS["files"])
    store.write({"files": files, "metadata": note("a")})
    store.write({"metadata": note("b")}, keep=["files"])
    assert store.folders(1)["files"] == store.folders(2)["files"] and store.read("files").count() == 1
    store.drop_old(1)
    assert store.read("files").count() == 1 and store.read("metadata").first().value == "b" and store.read("symbols").count() == 0
    # of two writers of one version the second fails
    late = Store(spark, store.root)
    late.current = lambda: 1
    late.folders = lambda v: {}
    with pytest.raises(FileExistsError):
        late.write({"metadata": note("c")})
    assert store.read("metadata").first().value == "b"


def test_commands_end_to_end(spark, tmp_path, capsys):
    root = ["--root", str(tmp_path)]
    run = lambda *a: (main([*root, *a], spark), capsys.readouterr())
    code, io = run("--json", "symbols")
    assert code == 2 and json.loads(io.err)["code"] == 2
    assert run("status")[0] == 0
    put(tmp_path, {"util.py": "def pay(x):\n    return x\n", "app.py": "from util import pay\n\ndef go():\n    pay(1)\n", "o.cs": "class O { int Run(int n) { if (n > 1) { Go(); } return n; } }\n"})
    git(tmp_path, "init", "-q")
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "one")
    assert run("init")[0] == 0
    before = {r["name"] for r in json.loads(run("--json", "symbols")[1].out)}
    assert before == {"pay", "go", "O", "Run"}
    deps = json.loads(run("--json", "deps", "pay")[1].out)
    assert deps["references"] == [{"path": "app.py", "line": 4, "column": 4}]
    assert [r["path"] for r in json.loads(run("--json", "deps", "util.py")[1].out)["dependents"]] == ["app.py"]
    assert [n["kind"] for n in json.loads(run("--json", "flow", "O.Run")[1].out)["nodes"]] == ["entry", "exit", "branch", "call", "return"]
    assert run("flow", "pay")[0] == 1
    assert run("symbols", "--grep", "(")[0] == 1
    page = json.loads(run("--json", "symbols", "--limit", "1", "--offset", "1", "--body")[1].out)
    assert page["total_count"] == 4 and page["symbols"][0]["name"] == "O" and page["symbols"][0]["body"].startswith("class O")
    # a change in the used file: update gives what a rebuild would give
    put(tmp_path, {"util.py": "\ndef pay(x):\n    return x\n\ndef extra(): pass\n"})
    (tmp_path / "o.cs").unlink()
    diff = json.loads(run("--json", "diff")[1].out)
    assert [x["name"] for x in diff["added"]] == ["extra"] and [x["name"] for x in diff["modified"]] == ["pay"] and {x["name"] for x in diff["removed"]} == {"O", "Run"}
    assert json.loads(run("--json", "status")[1].out)["stale_files"] == 2
    assert run("update")[0] == 0
    table = lambda: {k: sorted(map(str, df.drop("last_indexed_at").collect())) for k, df in Store(spark, f"file://{tmp_path}/.codeloom").all().items() if k != "metadata"}
    updated = table()
    assert any("extra" in x for x in updated["symbols"]) and len(updated["references"]) == 1
    # nothing but the commit moves: the other relations stay where they lie
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "two")
    store = Store(spark, f"file://{tmp_path}/.codeloom")
    assert run("update")[0] == 0
    git(tmp_path, "commit", "-qm", "three", "--allow-empty")
    before, at = store.folders(store.current()), store.current()
    assert run("update")[0] == 0 and store.current() == at + 1
    assert {k for k, v in store.folders(at + 1).items() if before[k] != v} == {"metadata"} and table() == updated
    assert json.loads(run("--json", "status")[1].out)["head_commit"] == {r["key"]: r["value"] for r in store.read("metadata").collect()}["last_indexed_commit"]
    assert run("init")[0] == 0
    assert table() == updated
    for c in ("summary", "files", "export", "status"):
        assert run(c)[0] == 0 and run("--compact", c)[0] == 0
