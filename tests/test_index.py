import pytest
from pyspark.sql import functions as F

from codeloom.operators import maintenance as M
from codeloom.plans.index import Index, bind_references
from codeloom.schema import FILES, IMPORTS, REFERENCES, SYMBOLS, evolve

PATHS = ["src/util/price.ts", "src/legacy/price.ts", "src/domain/basket.ts", "src/audit.ts", "src/Glob_als.ts"]


def make(spark, imports, references, symbols=None, n=len(PATHS)):
    files = [(i, p, f"h{i}", "typescript", None) for i, p in enumerate(PATHS[:n], 1)]
    symbols = symbols or [(11, "showPrice", "fn", 1), (12, "showPrice", "fn", 2)]
    sym = [(i, name, kind, f, 1, 0, 1, "pub", None, None) for i, name, kind, f in symbols]
    imp = [(k, s, p, None, names, r) for k, (s, p, names, r) in enumerate(imports, 1)]
    ref = [(k, s, f, line, 0, q) for k, (s, f, line, q) in enumerate(references, 1)]
    return Index(spark.createDataFrame(files, FILES), spark.createDataFrame(sym, SYMBOLS), spark.createDataFrame(imp, IMPORTS), spark.createDataFrame(ref, REFERENCES))


def sites(i):
    return {(r.symbol_id, r.path, r.line) for r in i.attributed().collect()}


def test_attribution_matrix(spark):
    both = lambda f, line, q=False: [(11, f, line, q), (12, f, line, q)]
    # the imported definition owns a bare usage; a qualified one keeps all; the own file keeps its own
    i = make(spark, [(3, "../util/price", ["showPrice"], 1)], both(3, 5) + both(3, 6, True) + both(2, 7) + both(5, 8) + both(3, 5))
    basket, legacy, glob = PATHS[2], PATHS[1], PATHS[4]
    assert sites(i) == {(11, basket, 5), (11, basket, 6), (12, basket, 6), (11, legacy, 7), (12, legacy, 7), (11, glob, 8), (12, glob, 8)}
    # an alias, an unresolved import and a barrel that defines nothing decide nothing
    for imports in ([(3, "../util/price", ["fm"], 1)], [(3, "pkg", ["showPrice"], None)], [(3, "../audit", ["showPrice"], 4)]):
        assert sites(make(spark, imports, both(3, 5))) == {(11, basket, 5), (12, basket, 5)}
    # one name bound to two files: both are answers
    two = [(3, "a", ["showPrice"], 1), (3, "b", ["showPrice"], 2)]
    assert sites(make(spark, two, both(3, 5))) == {(11, basket, 5), (12, basket, 5)}


def test_transitive_cycles_depth_and_order(spark):
    i = make(spark, [(1, "x", [], 2), (2, "y", [], 3), (3, "z", [], 1), (1, "w", [], 4), (2, "react", [], None)], [])
    walk = lambda d, back=False: [(r.path, r.depth) for r in i.transitive(PATHS[0], d, back).collect()]
    assert walk(1) == [(PATHS[3], 1), (PATHS[1], 1)]
    assert walk(9) == [(PATHS[3], 1), (PATHS[1], 1), ("react", 2), (PATHS[2], 2)]
    assert walk(9, True) == [(PATHS[2], 1), (PATHS[1], 2)]
    assert walk(0) == []
    assert {r.path for r in i.dependents(PATHS[0]).collect()} == {PATHS[2]}
    assert {r.path for r in i.dependents("REACT").collect()} == {PATHS[1]}  # not indexed: by the specifier's text
    assert [r.path for r in i.dependencies(PATHS[0]).collect()] == [PATHS[3], PATHS[1]]


def test_listing_filters_and_pages(spark):
    i = make(spark, [], [], [(k, n, "fn", f) for k, n, f in ((1, "getB", 1), (2, "setA", 1), (3, "x", 2), (4, "get", 5), (5, "Größe", 5))])
    ids = lambda **k: [r.id for r in i.list_symbols(**k).collect()]
    assert ids() == [5, 4, 3, 1, 2]
    assert ids(offset=3) == [1, 2] and ids(limit=2, offset=1) == [4, 3]
    assert set(ids(pattern="^(?P<v>get|set)")) == {1, 2, 4}
    assert ids(file="glob_ALS") == [5, 4] and ids(file="glob%s") == [5, 4]
    assert ids(name="größe") == [5] and ids(name="grÖße") == []  # only ASCII folds
    assert ids(scope="none") == []
    assert i.count_symbols(pattern="get").first()[0] == 2
    with pytest.raises(ValueError):
        i.list_symbols(pattern="(")


def test_empty_index(spark):
    e = lambda s: spark.createDataFrame([], s)
    i = Index(e(FILES), e(SYMBOLS), e(IMPORTS), e(REFERENCES))
    for df in (i.list_symbols(), i.attributed(), i.file_edges(), i.files_with_counts(), i.export(), i.directories(), i.transitive("a", 3), i.symbol_dependencies()):
        assert df.count() == 0
    assert {r.relation: r.n for r in i.totals().collect()} == {"files": 0, "symbols": 0, "imports": 0}


def test_binding_prefers_the_scope(spark):
    raw = spark.createDataFrame(
        [(1, "m", 1, 0, "A", False), (1, "m", 2, 0, "Z", False), (1, "m", 3, 0, None, True), (1, "m", 3, 0, None, True), (1, None, 4, 0, None, False), (1, "none", 5, 0, None, False)],
        "file_id long, symbol_name string, line long, column long, from_scope string, qualified boolean",
    )
    sym = spark.createDataFrame([(1, "m", "fn", 1, 1, 0, 1, "pub", "A", None), (2, "m", "fn", 2, 1, 0, 1, "pub", "B", None), (3, "m", "fn", 3, 1, 0, 1, "pub", None, None), (4, None, "fn", 3, 1, 0, 1, "pub", None, None)], SYMBOLS)
    assert sorted((r.line, r.symbol_id) for r in bind_references(raw, sym).collect()) == [(1, 1), (2, 1), (2, 2), (2, 3), (3, 1), (3, 2), (3, 3)]


def test_delete_cascades_and_unresolves(spark):
    i = make(spark, [(3, "a", ["f"], 1), (1, "b", ["f"], 2)], [(11, 3, 1, False), (12, 3, 2, False), (12, 1, 3, False)])
    rel = {"files": i.files, "symbols": i.symbols, "imports": i.imports, "references": i.references}
    out = M.delete_files(rel, i.files.where("id = 1").select("id"))
    assert {r.id for r in out["files"].collect()} == {2, 3, 4, 5}
    assert {r.id for r in out["symbols"].collect()} == {12}
    assert {(r.source_file_id, r.resolved_file_id) for r in out["imports"].collect()} == {(3, None)}
    assert {(r.symbol_id, r.line) for r in out["references"].collect()} == {(12, 2)}


def test_upserts(spark):
    f = lambda *r: spark.createDataFrame(list(r), FILES)
    got = M.upsert_files(f((1, "a", "h", "go", None), (2, "b", "h", "go", None)), f((9, "a", "new", "go", None), (9, "c", "h", "go", None)))
    assert {(r.id, r.path, r.content_hash) for r in got.collect()} == {(1, "a", "new"), (2, "b", "h"), (9, "c", "h")}
    m = lambda *r: spark.createDataFrame(list(r), "key string, value string")
    assert {tuple(r) for r in M.upsert_metadata(m(("a", "1"), ("b", "2")), m(("b", "3"))).collect()} == {("a", "1"), ("b", "3")}


def test_stale_files(spark):
    files = spark.createDataFrame([(1, "a.py", "h", "python", None), (2, "b.py", "h", "python", None)], FILES)
    changes = spark.createDataFrame([("M", "a.py"), ("A", "new.py"), ("M", "b.py"), ("M", "x.txt"), ("D", "b.py"), ("D", "gone.py")], "status string, path string")
    current = spark.createDataFrame([("a.py", "changed"), ("new.py", "h"), ("b.py", "h"), ("x.txt", "h")], "path string, content_hash string")
    modified, deleted = M.stale_files(files, changes, current, ["py"])
    assert {r.path for r in modified.collect()} == {"a.py", "new.py"} and {r.path for r in deleted.collect()} == {"b.py"}


def test_semantic_ingest(spark):
    files = spark.createDataFrame([(1, "a.cs", "h", "csharp", None), (2, "b.py", "h", "python", None)], FILES)
    sym = spark.createDataFrame([(1, "Add", "fn", 1, 3, 0, 4, "pub", "C", None), (2, "Add", "fn", 1, 9, 0, 9, "pub", "C", "M:old")], SYMBOLS)
    ref = spark.createDataFrame([(1, 1, 1, 5, 0, False), (2, 2, 2, 6, 0, False)], REFERENCES)
    imp = spark.createDataFrame([], IMPORTS)
    d = spark.createDataFrame([("M:x", "Add", "a.cs", 3), ("M:w", "Add", "a.cs", 3), ("M:y", "Add", "none.cs", 3)], "docid string, name string, file string, start_line long")
    u = spark.createDataFrame([("M:x", "a.cs", 7, 5, False), ("M:x", "a.cs", 7, 5, False), ("M:x", "a.cs", 3, 1, True), ("M:unknown", "a.cs", 8, 1, False)], "docid string, file string, line long, col long, is_definition boolean")
    out = M.ingest_semantic({"files": files, "symbols": sym, "imports": imp, "references": ref}, d, u)
    assert {(r.id, r.docid) for r in out["symbols"].collect()} == {(1, "M:x"), (2, "M:old")}
    assert {(r.symbol_id, r.file_id, r.line, r.column) for r in out["references"].collect()} == {(2, 2, 6, 0), (1, 1, 7, 4)}


def test_old_tables_gain_columns(spark):
    old = spark.createDataFrame([(1, "n", "fn", 1, 2, 3)], "id long, name string, kind string, file_id long, line long, column long")
    r = evolve(old, "symbols").first()
    assert (r.end_line, r.visibility, r.scope, r.docid) == (0, "private", None, None)
    assert evolve(spark.createDataFrame([(1, 2, 3, 4, 5)], "id long, symbol_id long, file_id long, line long, column long"), "references").first().qualified is False


def test_text_functions(spark):
    from codeloom.functions import text as T

    df = spark.createDataFrame([("a\r\nb\nc", 2, 3), ("a", 5, 0), ("a\nb", 2, 0), (None, 1, 1)], "c string, l long, e long")
    assert [r[0] for r in df.select(T.body_slice(F.col("c"), F.col("l"), F.col("e"))).collect()] == ["b\nc", None, "b", None]
    one = spark.createDataFrame([("src/mod.tar.gz", "  a   b\n", None)], "p string, w string, n string")
    r = one.select(T.parent_dir(F.col("p")), T.stem(F.col("p")), T.collapse(F.col("w")), T.elide(F.col("p"), 5), T.elide_left(F.col("p"), 5), T.display_name(F.col("n"), F.col("p")), T.sqlite_like(F.col("p"), "SRC/_od%")).first()
    assert list(r) == ["src", "mod.tar", "a b", "src/…", "…r.gz", "src/mod.tar.gz", True]


def test_patterns_of_the_jvm(spark):
    from codeloom.functions import text as T

    df = spark.createDataFrame([("größe",), ("x1",), (None,)], "c string")
    assert [r[0] for r in df.where(T.grep(F.col("c"), r"^\p{L}+$")).collect()] == ["größe"]
    assert df.where(T.grep(F.col("c"), r"(?P<a>x)\d")).count() == 1


def test_numbering_beyond_one_task(spark, monkeypatch):
    from codeloom.plans import index

    rows = [(i * 7919 % 1000 // 3, f"p{i % 50}", i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b string, c int").repartition(5)
    want = [(r[0], r[1], r[2], k) for k, r in enumerate(sorted(rows), 11)]
    for bound in (10**6, 10):
        monkeypatch.setattr(index, "NUMBERED_AT_ONCE", bound)
        got = sorted(tuple(r) for r in index.numbered(df, ["a", "b", "c"], 1000, 10).select("a", "b", "c", "position").collect())
        assert got == sorted(want)
