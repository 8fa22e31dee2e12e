"""Operators without a relational table of their own, on small literal inputs.

Each query runs an operator over a literal project or record set; its SQL is
the table of the rows that are expected, written down by hand.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.extract.tables import parse_files
from codeloom.flow.tables import flow_graphs, rendered
from codeloom.functions import text as T
from codeloom.operators import maintenance as M
from codeloom.plans.resolve import resolve_imports
from codeloom.schema import FILES, IMPORTS, REFERENCES, SYMBOLS
from codeloom.session import ship
from codeloom.sources import vcs
from codeloom.sources.tree import LANGUAGES

QUERIES: dict = {}
SQL: dict[str, str] = {}


def values(columns: dict[str, str], rows: list[tuple]) -> str:
    cell = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)
    return "SELECT " + ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in columns.items()) + f" FROM (VALUES {body}) AS t({', '.join(f'\"{c}\"' for c in columns)})"


def expects(columns: dict[str, str], rows: list[tuple]):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: (ship(spark), f(spark))[1]
        SQL[f.__name__] = values(columns, rows)
        return f

    return add


_SYM = {"name": "VARCHAR", "kind": "VARCHAR", "line": "BIGINT", "end_line": "BIGINT", "visibility": "VARCHAR", "scope": "VARCHAR"}


def _symbols(spark, language, text):
    df = spark.createDataFrame([(1, "p", language, text)], "file_id long, path string, language string, content string")
    return parse_files(df).select(F.inline("symbols")).select(*_SYM)


@expects(_SYM, [("Shop", "struct", 2, 2, "pub", None), ("find", "fn", 4, 4, "private", "Shop"), ("show", "fn", 7, 9, "private", "Show"), ("MAX", "const", 11, 11, "pub", None), ("inner", "mod", 12, 12, "private", None), ("go", "fn", 12, 12, "pub", "inner")])
def x01_rust_symbols(spark):
    return _symbols(spark, "rust", "use std::fmt;\npub struct Shop { n: u32 }\nimpl Shop {\n    fn find(&self) {}\n}\nimpl Show for Shop {\n    fn show(&self) {\n        fn local() {}\n    }\n}\npub const MAX: u32 = 3;\nmod inner { pub fn go() {} }\n")


@expects(_SYM, [("S", "struct", 2, 2, "pub", None), ("shape", "interface", 3, 3, "private", None), ("A", "const", 5, 7, "pub", None), ("b", "const", 6, 7, "private", None), ("Run", "fn", 8, 10, "pub", "S")])
def x02_go_symbols(spark):
    return _symbols(spark, "go", "package a\ntype S struct{}\ntype shape interface{}\nconst (\n\tA = 1\n\tb = 2\n)\nfunc (s *S) Run() {\n\tconst local = 1\n}\n")


@expects(_SYM, [("LIMIT", "const", 1, 1, "pub", None), ("Cart", "class", 2, 7, "pub", None), ("__init__", "fn", 3, 5, "protected", "Cart"), ("__hide", "fn", 6, 7, "private", "Cart"), ("run", "fn", 9, 10, "pub", None)])
def x03_python_symbols(spark):
    return _symbols(spark, "python", "LIMIT = 3\nclass Cart:\n    def __init__(self):\n        def local():\n            pass\n    def __hide(self):\n        pass\n@deco\nasync def run():\n    pass\nMAX_2 = 1\n")


@expects(_SYM, [("I", "interface", 1, 1, "pub", None), ("T", "type", 2, 2, "private", None), ("E", "enum", 3, 3, "pub", None), ("k", "const", 4, 4, "pub", None), ("C", "class", 5, 7, "pub", None), ("go", "fn", 6, 6, "private", "C")])
def x04_typescript_symbols(spark):
    return _symbols(spark, "typescript", "export interface I { a: string }\ntype T = string;\nexport enum E { A }\nexport const k = 1;\nexport class C {\n  go(): void { const local = 1; }\n}\n")


@expects(_SYM, [("a", "const", 1, 1, "pub", None), ("b", "fn", 2, 2, "private", None), ("D", "class", 3, 3, "private", None), ("m", "fn", 3, 3, "private", "D")])
def x05_javascript_symbols(spark):
    return _symbols(spark, "javascript", "export const a = 1;\nfunction b() {}\nclass D { m() {} }\n")


@expects(_SYM, [("S", "struct", 1, 1, "private", None), ("m", "fn", 2, 2, "pub", "S"), ("P", "trait", 4, 4, "private", None), ("L", "type", 5, 5, "pub", None), ("e", "fn", 6, 6, "private", "S")])
def x06_swift_symbols(spark):
    return _symbols(spark, "swift", "public struct S {\n  public func m() { func local() {} }\n}\npublic protocol P {}\npublic typealias L = Int\nextension S { func e() {} }\n")


@expects(_SYM, [("N", "mod", 1, 6, "pub", None), ("C", "class", 2, 5, "pub", "N"), ("C", "fn", 3, 3, "pub", "C"), ("P", "fn", 4, 4, "private", "C")])
def x07_csharp_symbols(spark):
    return _symbols(spark, "csharp", "namespace N {\n  public class C {\n    public C(int a) { }\n    int P { get; set; }\n  }\n}\n")


_REF = {"symbol_name": "VARCHAR", "line": "BIGINT", "column": "BIGINT", "from_scope": "VARCHAR", "qualified": "BOOLEAN"}


@expects(_REF, [("pay", 2, 4, None, False), ("rate", 2, 8, None, False), ("format", 3, 10, None, True), ("show", 4, 7, None, False), ("name", 4, 18, None, True), ("wide", 4, 35, None, False), ("deep", 5, 10, None, False)])
def x22_usages(spark):
    df = spark.createDataFrame([(1, "p", "python", "def f():\n    pay(rate())\n    label.format(1)\n    f'{show(a)}{b.name():>{c}} {d:{wide(1)}} {{no(1)}}'\n    f'{f\"{deep(1)}\"}'\n")], "file_id long, path string, language string, content string")
    return parse_files(df).select(F.inline("references")).select(*_REF)


@expects(_REF, [("List", 1, 33, "A", False), ("B.C", 2, 8, "A", False), ("D", 3, 8, "A", False), ("E.F<int>", 4, 8, "A", False), ("Go", 5, 0, "A", False), ("Run", 6, 2, "A", True), ("int", 8, 8, "A", False)])
def x24_csharp_creations(spark):
    """Creations by the name of their type; calls with type arguments are no usages."""
    text = "class A { void M() { var x = new List<int>();\nx = new B.C(1);\nx = new D { P = 1 };\nx = new E.F<int>();\nGo(x);\na.Run(x);\nGo<int>(); a.B<int>(); y = new int[3]; y = new();\nz = new int();\n} }\n"
    df = spark.createDataFrame([(1, "p", "csharp", text)], "file_id long, path string, language string, content string")
    return parse_files(df).select(F.inline("references")).select(*_REF)


_IMP = {"import_path": "VARCHAR", "names": "VARCHAR"}


@expects(_IMP, [("os", ""), (".m", "y,z"), ("q", "")])
def x16_import_bindings(spark):
    df = spark.createDataFrame([(1, "p", "python", "import os, a.b as c\nfrom .m import x as y, z\nfrom q import *\n")], "file_id long, path string, language string, content string")
    return parse_files(df).select(F.inline("imports")).select("import_path", F.array_join("names", ",").alias("names"))


_CASES = [
    ("src/app.ts", "typescript", "./util/price", ["src/util/price.ts"], 0),
    ("src/app.ts", "typescript", "./price.js", ["src/price.ts"], 0),
    ("src/app.ts", "typescript", "./util", ["src/util/index.ts"], 0),
    ("src/app.ts", "typescript", "react", ["react.ts"], None),
    ("pkg/sub/a.py", "python", "..b", ["pkg/b.py", "pkg/__init__.py"], 0),
    ("pkg/a.py", "python", "json", ["pkg/__init__.py", "pkg/json.py"], None),
    ("a/b/run.py", "python", "m", ["m.py", "a/m.py"], 1),
    ("src/main.rs", "rust", "crate::store::Table", ["src/store.rs", "src/store/Table.rs"], 1),
    ("src/a.rs", "rust", "self::inner::f", ["src/lib.rs", "src/a/inner.rs"], 1),
    ("src/a/b/c.rs", "rust", "super::super::d", ["src/lib.rs", "src/a/d.rs"], 1),
    ("src/a.rs", "rust", "super::super::x", ["src/lib.rs", "x.rs"], None),
    ("m/main.go", "go", "m/util", ["m/util.go"], None),
]


@expects({"import_id": "BIGINT", "resolved_path": "VARCHAR"}, [(k, None if hit is None else f"case{k}/{files[hit]}") for k, (_, _, _, files, hit) in enumerate(_CASES, 1)])
def r01_resolution_cases(spark):
    files, imports, n = [], [], 0
    for k, (source, language, spec, others, _) in enumerate(_CASES, 1):
        n += 1
        imports.append((k, n, spec))
        files.append((n, f"case{k}/{source}", language))
        for p in others:
            n += 1
            files.append((n, f"case{k}/{p}", language))
    f = spark.createDataFrame(files, "id long, path string, language string")
    got = resolve_imports(spark.createDataFrame(imports, "id long, source_file_id long, import_path string"), f)
    return got.join(f.select(F.col("id").alias("resolved_file_id"), F.col("path").alias("resolved_path")), "resolved_file_id", "left").select(F.col("id").alias("import_id"), "resolved_path")


@expects({"status": "VARCHAR", "path": "VARCHAR"}, [("A", "b.py"), ("M", "new.py"), ("M", "copy.py")])
def s11_change_feed(spark):
    out = ["M\ta.py", "A\tsub/b.py", "D\tc.py", "R100\told.py\tsub/new.py", "C75\ta.py\tsub/copy.py"]
    return vcs.status_rows(spark.createDataFrame([(x,) for x in out], "value string"), "sub/")


@expects({"symbol_id": "BIGINT", "file_id": "BIGINT", "line": "BIGINT", "column": "BIGINT"}, [(2, 2, 6, 0), (1, 1, 7, 4)])
def o66_semantic_ingest(spark):
    files = spark.createDataFrame([(1, "a.cs", "h", "csharp", None), (2, "b.py", "h", "python", None)], FILES)
    sym = spark.createDataFrame([(1, "Add", "fn", 1, 3, 0, 4, "pub", "C", None), (2, "Add", "fn", 1, 9, 0, 9, "pub", "C", "M:old")], SYMBOLS)
    ref = spark.createDataFrame([(1, 1, 1, 5, 0, False), (2, 2, 2, 6, 0, False)], REFERENCES)
    d = spark.createDataFrame([("M:x", "Add", "a.cs", 3), ("M:w", "Add", "a.cs", 3)], "docid string, name string, file string, start_line long")
    u = spark.createDataFrame([("M:x", "a.cs", 7, 5, False), ("M:x", "a.cs", 7, 5, False), ("M:x", "a.cs", 3, 1, True), ("M:no", "a.cs", 8, 1, False)], "docid string, file string, line long, col long, is_definition boolean")
    out = M.ingest_semantic({"files": files, "symbols": sym, "imports": spark.createDataFrame([], IMPORTS), "references": ref}, d, u)
    return out["references"].select("symbol_id", "file_id", "line", "column")


@expects({"id": "BIGINT", "resolved_file_id": "BIGINT"}, [(1, 5), (2, None), (3, 7)])
def m06_apply_resolutions(spark):
    imp = spark.createDataFrame([(1, 1, "a", None, [], 4), (2, 1, "b", None, [], 6), (3, 1, "c", None, [], 7)], IMPORTS)
    new = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id long, resolved_file_id long")
    return M.apply_resolutions(imp, M.changed_resolutions(imp, new)).select("id", "resolved_file_id")


@expects({"key": "VARCHAR", "value": "VARCHAR"}, [("a", "1"), ("b", "3")])
def m02_upsert_metadata(spark):
    m = lambda *r: spark.createDataFrame(list(r), "key string, value string")
    return M.upsert_metadata(m(("a", "1"), ("b", "2")), m(("b", "3")))


_EDGE = {"source": "VARCHAR", "label": "VARCHAR", "target": "VARCHAR"}


def _graph(spark, language, text, *names):
    rows = [(k, f"f{k}", language, n, None, 1, text) for k, n in enumerate(names, 1)]
    return flow_graphs(spark.createDataFrame(rows, "symbol_id long, path string, language string, name string, scope string, line long, content string"))


def _edges(spark, language, text, *names):
    """Edges with the kind and label of both ends; one row without ends where there is no graph."""
    g = _graph(spark, language, text, *names)
    node = lambda i: F.element_at(F.filter("nodes", lambda n: n["id"] == i), 1)
    shown = lambda n: F.concat_ws(" ", n["kind"], n["label"])
    e = g.select("nodes", F.explode_outer("edges").alias("e"))
    return e.select(F.when(F.col("e").isNotNull(), shown(node(F.col("e.from")))).alias("source"), F.col("e.label").alias("label"), F.when(F.col("e").isNotNull(), shown(node(F.col("e.to")))).alias("target"))


@expects(_EDGE, [
    ("entry f(x: u32) -> R", None, "call get(…)"), ("call get(…)", "Err ?", "exit end"), ("call get(…)", None, "branch let Some(v) = get(x)?"),
    ("branch let Some(v) = get(x)?", "else", "call Err(…)"), ("call Err(…)", None, "return return Err(E)"), ("return return Err(E)", None, "exit end"),
    ("branch let Some(v) = get(x)?", "bound", "loop for i in v"), ("loop for i in v", "body", "branch i > 3"), ("branch i > 3", "true", "break break"), ("branch i > 3", "false", "call step(…)"),
    ("call step(…)", "repeat", "loop for i in v"), ("break break", None, "match match v"), ("loop for i in v", "done", "match match v"), ("match match v", "A", "return 1"), ("return 1", None, "exit end"), ("match match v", "_", "call big(…)"), ("call big(…)", None, "return big(v)"), ("return big(v)", None, "exit end"),
])
def g03_rust_flow(spark):
    return _edges(spark, "rust", "fn f(x: u32) -> R {\n let Some(v) = get(x)? else { return Err(E); };\n for i in v { if i > 3 { break; } step(i); }\n match v { A => 1, _ => big(v) }\n}\n", "f")


@expects(_EDGE, [
    ("entry F(int n) -> int", None, "branch try"), ("branch try", "try", "match switch n"), ("match switch n", "1", "call A(…)"), ("match switch n", "2", "call A(…)"), ("call A(…)", None, "break break;"),
    ("match switch n", "default", "call Close(…)"), ("call Close(…)", None, "return return 3;"), ("return return 3;", None, "exit end"), ("break break;", None, "call Close(…)"),
    ("branch try", "catch (E e) when (Ok(e))", "call Ok(…)"), ("call Ok(…)", None, "call Close(…)"), ("call Close(…)", None, "match switch n"),
    ("match switch n", "> 0 when B()", "call C(…)"), ("call C(…)", None, "return return n switch { > 0 when B() => C(), _ => 2 };"), ("match switch n", "_", "return return n switch { > 0 when B() => C(), _ => 2 };"),
    ("return return n switch { > 0 when B() => C(), _ => 2 };", None, "exit end"),
])
def g04_csharp_flow(spark):
    text = "class K { int F(int n) {\n try { switch (n) { case 1: case 2: A(); break; default: return 3; } }\n catch (E e) when (Ok(e)) { }\n finally { Close(); }\n return n switch { > 0 when B() => C(), _ => 2 };\n} }\n"
    return _edges(spark, "csharp", text, "F")


_SKIP = "call Skip(…)"
_EACH = "loop foreach (var x in Items())"


@expects(_EDGE, [
    ("entry G(int n) -> IEnumerable<int>", None, "branch n < 0"), ("branch n < 0", "true", "call new E(…)"), ("call new E(…)", None, "throw throw new E();"), ("throw throw new E();", None, "exit end"),
    ("branch n < 0", "false", "call Open(…)"), ("call Open(…)", None, "call Read(…)"), ("call Read(…)", None, "yield yield return Read(r);"), ("yield yield return Read(r);", None, "loop do while (n > 0)"),
    ("loop do while (n > 0)", "body", _SKIP), (_SKIP, None, "branch Skip(n)"), ("branch Skip(n)", "true", "continue continue;"), ("continue continue;", None, "loop do while (n > 0)"), ("branch Skip(n)", "false", "loop do while (n > 0)"),
    ("loop do while (n > 0)", "done", "call Items(…)"), ("call Items(…)", None, _EACH), (_EACH, "body", "branch x > 9"), ("branch x > 9", "true", "goto goto again;"), ("branch x > 9", "false", _EACH),
    (_EACH, "done", "return yield break;"), ("return yield break;", None, "exit end"),
])
def g12_csharp_jumps(spark):
    """Throw, yield, goto, wrappers (using, lock, a labelled statement), do and foreach."""
    text = "class K { IEnumerable<int> G(int n) {\n if (n < 0) { throw new E(); }\n using (var r = Open()) { lock (r) { yield return Read(r); } }\n again:\n do { n--; if (Skip(n)) { continue; } } while (n > 0);\n"
    return _edges(spark, "csharp", text + " foreach (var x in Items()) { if (x > 9) { goto again; } }\n yield break;\n} }\n", "G")


@expects(_EDGE, [
    ("entry Q() -> int", None, "call Load(…)"), ("call Load(…)", None, "return Load()"), ("return Load()", None, "exit end"), (None, None, None), (None, None, None), (None, None, None),
])
def g21_no_graph(spark):
    """An arrow property has a graph; one with accessors, a method without body and a missing one have an error instead."""
    return _edges(spark, "csharp", "class K {\n int Q => Load();\n int P { get { return 1; } set { } }\n abstract void R();\n}\n", "Q", "P", "R", "Z")


@expects(_EDGE, [
    ("entry h(x: &mut V) -> u8", None, "loop loop"), ("loop loop", "body", "call x.pop(…)"), ("call x.pop(…)", None, "loop while let Some(v) = x.pop()"),
    ("loop while let Some(v) = x.pop()", "body", "branch v.bad"), ("branch v.bad", "true", "continue continue 'outer"), ("continue continue 'outer", None, "loop loop"),
    ("branch v.bad", "false", "branch v.done"), ("branch v.done", "true", "break break 'outer"), ("branch v.done", "false", "loop while let Some(v) = x.pop()"), ("loop while let Some(v) = x.pop()", "done", "loop loop"),
    ("break break 'outer", None, "call raw(…)"), ("call raw(…)", None, "return 1"), ("return 1", None, "exit end"),
])
def g08_rust_labels(spark):
    """Labelled loops, patterns in conditions, closures and an unsafe block."""
    return _edges(spark, "rust", "fn h(x: &mut V) -> u8 {\n 'outer: loop { while let Some(v) = x.pop() { if v.bad { continue 'outer; } if v.done { break 'outer; } } }\n let f = |a| a.go();\n unsafe { raw(x) };\n 1\n}\n", "h")


_FLOW = "fn f() { if a() { return; } b()? }"


@expects({"line_no": "BIGINT", "text": "VARCHAR"}, [
    (1, "#0 entry f() :1"), (2, "#2 call a(…) :1"), (3, "#3 branch a() :1"), (4, "  [true]"), (5, "    #4 return return :1"), (6, "    #1 exit end :1"), (7, "  [false]"),
    (8, "    #5 call b(…) :1"), (9, "      ! Err ? -> #1"), (10, "    #6 return b()? :1"), (11, "    -> #1 exit (end)"),
])
def k07_flow_tree(spark):
    return _lines(_graph(spark, "rust", _FLOW, "f"), "tree")


@expects({"line_no": "BIGINT", "text": "VARCHAR"}, [
    (1, "flowchart TD"), (2, '  n0(["f()"])'), (3, '  n1(["end"])'), (4, '  n2["a(…)"]'), (5, '  n3{"a()"}'), (6, '  n4[/"return"/]'), (7, '  n5["b(…)"]'), (8, '  n6[/"b()?"/]'),
    (9, "  n0 --> n2"), (10, "  n2 --> n3"), (11, '  n3 -->|"true"| n4'), (12, "  n4 --> n1"), (13, '  n3 -->|"false"| n5'), (14, '  n5 -->|"Err ?"| n1'), (15, "  n5 --> n6"), (16, "  n6 --> n1"),
])
def k08_flow_mermaid(spark):
    return _lines(_graph(spark, "rust", _FLOW, "f"), "mermaid")


def _lines(graphs, how):
    lines = rendered(graphs, how).select(F.posexplode(F.split(F.rtrim("text", F.lit("\n")), "\n")).alias("n", "text"))
    return lines.select((F.col("n") + 1).cast("long").alias("line_no"), "text")


@expects({"target": "VARCHAR", "name": "VARCHAR", "scope": "VARCHAR", "file": "VARCHAR"}, [
    ("pay", "pay", None, None), ("src/a.py:pay", "pay", None, "src/a.py"), ("src/a.py", None, None, "src/a.py"), ("a.py", None, None, "a.py"), ("Cart.total", "total", "Cart", None), ("a::b", "b", None, "a:"), ("a.b.c", "a.b.c", None, None),
])
def q10_targets(spark):
    asked = spark.createDataFrame([(t,) for t in ("pay", "src/a.py:pay", "src/a.py", "a.py", "Cart.total", "a::b", "a.b.c")], "target string")
    return asked.select("target", T.target(F.col("target"), LANGUAGES).alias("t")).select("target", "t.*")


@expects({"case_no": "BIGINT", "collapsed": "VARCHAR", "unquoted": "VARCHAR", "escaped": "VARCHAR", "short": "VARCHAR", "stem": "VARCHAR", "found": "BOOLEAN"}, [
    (1, "a b c", "x/y", "say #quot;hi#quot;", "0123456", "mod", True), (2, "", "", "", "", "", False), (3, None, None, None, None, None, None),
])
def f08_text_functions(spark):
    df = spark.createDataFrame([(1, " a\t b\n c ", '"x/y"', 'say "hi"', "0123456789", "src/mod.rs"), (2, "", "", "", "", ""), (3, None, None, None, None, None)], "case_no long, a string, b string, c string, d string, e string")
    return df.select(
        "case_no", T.collapse(F.col("a")).alias("collapsed"), T.unquote(F.col("b")).alias("unquoted"), T.mermaid_escape(F.col("c")).alias("escaped"), T.short_commit(F.col("d")).alias("short"), T.stem(F.col("e")).alias("stem"),
        T.grep(F.col("e"), "(?P<dir>src)/").alias("found"),
    )


@expects({"docid": "VARCHAR", "kind": "VARCHAR", "visibility": "VARCHAR", "scope": "VARCHAR", "listed": "BOOLEAN", "by_rule": "BOOLEAN"}, [
    ("N:A", "mod", "pub", None, True, True), ("T:A.B", "class", "private", "A", True, True), ("M:A.B.C", "fn", "pub", "B", False, True), ("P:A.B.D", "fn", "private", "B", False, False), ("M:X", "fn", "pub", None, True, False), ("M:Y", "interface", "pub", None, False, False),
])
def h07_helper_vocabulary(spark):
    """Definitions in the index's words, and which files count, by list and by rule."""
    from codeloom.sources import ndjson

    rows = [("N:A", "Namespace", "internal", "", "a.cs"), ("T:A.B", "Class", "internal", "A", "a.cs"), ("M:A.B.C", "Method", "Public", "B", "src/binary/c.cs"), ("P:A.B.D", "Property", "protected", "B", "src/obj/d.cs"), ("M:X", "Constructor", "public", None, "x/bin/x.cs"), ("M:Y", "interface", "pub", None, "../y.cs"), ("M:Z", "enum", "pub", None, None)]
    d = ndjson.mapped(spark.createDataFrame(rows, "docid string, kind string, visibility string, scope string, file string"))
    mark = lambda df, name: df.select("docid", F.lit(True).alias(name))
    listed = mark(ndjson.indexed(d, spark.createDataFrame([("a.cs",), ("x/bin/x.cs",), ("x/bin/x.cs",)], "path string")), "listed")
    found = d.where("file is not null").join(listed, "docid", "left").join(mark(ndjson.indexed(d), "by_rule"), "docid", "left")
    return found.select("docid", "kind", "visibility", "scope", F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("by_rule", F.lit(False)).alias("by_rule"))


@expects({"type": "VARCHAR", "docid": "VARCHAR", "file": "VARCHAR", "line": "BIGINT"}, [("definition", "M:a", "a.cs", 1), ("reference", "M:a", "b.cs", 2)])
def s14_helper_records(spark):
    from codeloom.session import work_dir
    from codeloom.sources import ndjson

    lines = ['{"type":"ping","available":true,"protocol_version":1}'] + ['{"type":"definition","docid":"M:a","name":"a","file":"a.cs","start_line":1,"start_col":1}'] * 2
    lines += ['{"type":"reference","docid":"M:a","file":"b.cs","line":2,"col":3,"is_definition":false}', '{"type":"reference","docid":"M:x","file":"b.cs","line":9,"col":1}', '{"type":"later"}']
    path = work_dir(spark, "records")
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    rec = ndjson.read_records(spark, path)
    d = ndjson.definitions(rec).select(F.lit("definition").alias("type"), "docid", "file", F.col("start_line").alias("line"))
    return d.unionByName(ndjson.references(rec).select(F.lit("reference").alias("type"), "docid", "file", "line"))
