import pytest

from codeloom.plans.resolve import normalize, resolve_imports

CASES = [
    # source, language, specifier, other files, expected
    ("src/app.ts", "typescript", "./util/price", ["src/util/price.ts"], "src/util/price.ts"),
    ("src/a/b/c.ts", "typescript", "../../util/price", ["src/util/price.ts"], "src/util/price.ts"),
    ("src/app.ts", "typescript", "./price.js", ["src/price.ts"], "src/price.ts"),
    ("src/app.ts", "typescript", "./price.js", ["src/price.ts", "src/price.js"], "src/price.js"),
    ("src/app.ts", "typescript", "./util", ["src/util/index.ts", "src/util.tsx"], "src/util.tsx"),
    ("src/app.js", "javascript", ".", ["src/index.js"], "src/index.js"),
    ("src/a/app.ts", "typescript", "..", ["src/index.ts"], "src/index.ts"),
    ("src/app.ts", "typescript", "react", ["react.ts"], None),
    ("src/app.ts", "typescript", "@/util", ["util.ts"], None),
    ("app.ts", "typescript", "../../util", ["util.ts"], None),
    ("src/app.ts", "typescript", "./app", [], None),
    ("pkg/a.py", "python", ".b", ["pkg/__init__.py", "pkg/b.py"], "pkg/b.py"),
    ("pkg/sub/a.py", "python", "..b", ["pkg/b.py"], "pkg/b.py"),
    ("pkg/a.py", "python", ".", ["pkg/__init__.py"], "pkg/__init__.py"),
    ("pkg/a.py", "python", "...x", ["x.py"], None),
    ("src/pkg/sub/a.py", "python", "pkg.util", ["src/pkg/__init__.py", "src/pkg/sub/__init__.py", "src/pkg/util.py"], "src/pkg/util.py"),
    ("pkg/a.py", "python", "json", ["pkg/__init__.py", "pkg/json.py"], None),
    ("scripts/run.py", "python", "helper", ["scripts/helper.py"], "scripts/helper.py"),
    ("a/b/run.py", "python", "m", ["m.py", "a/m.py"], "a/m.py"),
    ("src/main.rs", "rust", "crate::store::Table", ["src/store.rs"], "src/store.rs"),
    ("src/main.rs", "rust", "crate::store::Table", ["src/store.rs", "src/store/Table.rs"], "src/store/Table.rs"),
    ("src/a/b.rs", "rust", "crate::store::open", ["src/lib.rs", "src/store/mod.rs"], "src/store/mod.rs"),
    ("src/a.rs", "rust", "self::inner::f", ["src/lib.rs", "src/a/inner.rs"], "src/a/inner.rs"),
    ("src/a/mod.rs", "rust", "self::inner", ["src/lib.rs", "src/a/inner.rs"], "src/a/inner.rs"),
    ("src/a/b.rs", "rust", "super::c::X", ["src/lib.rs", "src/a/c.rs"], "src/a/c.rs"),
    ("src/a/b/c.rs", "rust", "super::super::d", ["src/lib.rs", "src/a/d.rs"], "src/a/d.rs"),
    ("src/main.rs", "rust", "super::x", ["x.rs"], None),
    ("src/a.rs", "rust", "super::super::x", ["src/lib.rs", "x.rs"], None),
    ("src/main.rs", "rust", "std::fmt", ["std/fmt.rs"], None),
    ("lib/a.rs", "rust", "crate::x", ["x.rs"], None),
    ("m/main.go", "go", "m/util", ["m/util.go"], None),
    ("A.swift", "swift", "Util", ["Util.swift"], None),
    ("A.cs", "csharp", "Util", ["Util.cs"], None),
]


def test_normalize():
    assert normalize("a/b", "../c/./d") == "a/c/d"
    assert normalize("", "..") is None
    assert normalize("a", "..") == ""


def test_cases(spark):
    """Every case is a repository of its own, told apart by a prefix that is removed per case."""
    bad = []
    for source, language, specifier, others, expected in CASES:
        files = [(i, p, None, language, None) for i, p in enumerate([source, *others], 1)]
        bad.append((files, specifier, expected))
    for files, specifier, expected in bad[:: max(1, len(bad) // 8)]:
        f = spark.createDataFrame(files, "id long, path string, content_hash string, language string, last_indexed_at timestamp")
        i = spark.createDataFrame([(1, 1, specifier), (2, 99, specifier), (3, 1, None)], "id long, source_file_id long, import_path string")
        got = {r.id: r.resolved_file_id for r in resolve_imports(i, f).collect()}
        want = next((n for n, p, *_ in files if p == expected), None)
        assert got == {1: want, 2: None, 3: None}, (files, specifier)


@pytest.mark.parametrize("case", CASES)
def test_priority_of_candidates(case):
    from codeloom.plans.resolve import candidates

    source, language, specifier, others, expected = case
    files = {source, *others}
    up = []
    d = source.rpartition("/")[0]
    while True:
        up.append(d)
        if not d:
            break
        d = d.rpartition("/")[0]
    j = lambda a, b: f"{a}/{b}" if a else b
    package = next(a for a in up if not a or j(a, "__init__.py") not in files)
    crate = next((a for a in up if j(a, "main.rs") in files or j(a, "lib.rs") in files), None)
    hit = next((c for c in candidates(source, language, specifier, package, crate) if c in files), None)
    assert (None if hit == source else hit) == expected
