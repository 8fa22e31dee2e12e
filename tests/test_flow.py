import pytest

from codeloom.flow.graph import FlowError
from codeloom.flow.parse import flow
from codeloom.flow.render import mermaid, tree


def rust(body, head="fn f()"):
    return flow("rust", f"{head} {{ {body} }}", "a.rs", "f", None, 1)


def cs(body, head="int F()"):
    return flow("csharp", f"class C {{ {head} {{ {body} }} }}", "A.cs", "F", None, 1)


def shape(g):
    """Edges by label, as kind:label pairs."""
    name = {n["id"]: n["label"] if n["kind"] != "exit" else "END" for n in g["nodes"]}
    return {(name[e["from"]], e["label"], name[e["to"]]) for e in g["edges"]}


def kinds(g):
    return [n["kind"] for n in g["nodes"]][2:]


def reachable(g):
    seen, todo = {0}, [0]
    while todo:
        n = todo.pop()
        for e in g["edges"]:
            if e["from"] == n and e["to"] not in seen:
                seen.add(e["to"])
                todo.append(e["to"])
    return seen


def test_rust_branches():
    s = shape(rust("if a() { b(); } else if c { return; } else { d(); } e()"))
    assert ("a(…)", None, "a()") in s and ("a()", "true", "b(…)") in s and ("a()", "false", "c") in s and ("c", "true", "return") in s and ("c", "false", "d(…)") in s
    assert ("e(…)", None, "e()") in s and ("e()", None, "END") in s


def test_rust_loops_and_labels():
    g = rust("'o: for x in xs() { while y { if z { break 'o; } continue; } } loop { break; }")
    s = shape(g)
    assert ("for x in xs()", "body", "while y") in s and ("break 'o", None, "loop") in s and ("continue", None, "while y") in s
    assert ("for x in xs()", "done", "loop") in s and ("loop", "done", "END") not in s
    assert ("while y", "done", "for x in xs()") in s  # a label the edge had is kept on the way back


def test_rust_match_let_else_and_question_mark():
    g = rust("let Some(v) = get()? else { return; }; match v { A => 1, B if big(v) => { two() } _ => three()? }", "fn f() -> R")
    s = shape(g)
    assert ("get(…)", "Err ?", "END") in s and ("let Some(v) = get()?", "else", "return") in s and ("let Some(v) = get()?", "bound", "match v") in s
    assert ("match v", "A", "1") in s and ("match v", "B if big(v)", "big(…)") in s and ("three(…)", "Err ?", "END") in s
    assert sum(n["kind"] == "return" for n in g["nodes"]) == 4


def test_rust_calls_in_order_and_skipped_bodies():
    g = rust("a(b(c()), |x| hidden(x)).d::<T>(e()); fn inner() { nope() } println!(\"{}\", quiet());")
    assert [n["label"] for n in g["nodes"]][2:] == ["c(…)", "b(…)", "a(…)", "e(…)", "a(b(c()), |x| hidden(x)).d::<T>(…)", "println!"]


def test_rust_unreachable_tail_and_implicit_unit():
    g = rust("return; gone();")
    assert kinds(g) == ["return"] and reachable(g) == {0, 1, 2}
    assert shape(rust("x;")) == {("f()", None, "END")}
    assert kinds(rust("unsafe { a(); }")) == ["call"]


def test_locating():
    src = "impl A { fn go() { one() } }\nimpl B { fn go() { two() } }\nfn outer() { fn go() { three() } }"
    call = lambda scope, line: flow("rust", src, "a.rs", "go", scope, line)["nodes"][2]["label"]
    assert call("A", 1) == "one(…)" and call("B", 99) == "two(…)" and call(None, 3) == "three(…)"
    with pytest.raises(FlowError):
        flow("rust", src, "a.rs", "go", None, 99)
    with pytest.raises(FlowError, match="no flow graphs for python"):
        flow("python", "def f(): pass", "a.py", "f", None, 1)


def test_signature():
    g = flow("rust", "impl S { pub fn f(&self, m: Map<K, V>) -> Option<u8> where K: X { None } }", "a.rs", "f", "S", 1)
    assert g["nodes"][0]["label"] == "S.f(&self, m: Map<K, V>) -> Option<u8>"
    assert g["function"]["params"] == ["&self", "m: Map<K, V>"]


def test_csharp_switch_statement():
    g = cs("switch (v()) { case 1: case 2: A(); break; case > 5 when B(): return 1; } return 2;")
    s = shape(g)
    assert ("switch v()", "1", "A(…)") in s and ("switch v()", "2", "A(…)") in s and ("switch v()", "> 5 when B()", "return 1;") in s
    assert ("switch v()", "no match", "return 2;") in s and ("break;", None, "return 2;") in s
    arms = [e["label"] for e in g["edges"] if e["label"] and g["nodes"][e["from"]]["kind"] == "match"]
    assert arms == ["1", "2", "> 5 when B()", "no match"]


def test_csharp_switch_expression_keeps_source_order():
    g = cs("var y = x switch { 1 => 7, 2 => A(), _ => new D<string, int>() }; return y;")
    arms = [e["label"] for e in g["edges"] if g["nodes"][e["from"]]["kind"] == "match"]
    assert arms == ["1", "2", "_"]
    assert "new D<string, int>(…)" in [n["label"] for n in g["nodes"]]


def test_csharp_finally_runs_once_per_leaving_path():
    g = cs("try { if (x) { return 1; } A(); } catch (E e) when (Ok(e)) { throw; } finally { Close(); } return 2;")
    assert sum(n["label"] == "Close(…)" for n in g["nodes"]) == 3
    s = shape(g)
    assert ("try", "catch (E e) when (Ok(e))", "Ok(…)") in s and ("Close(…)", None, "return 1;") in s and ("Close(…)", None, "throw;") in s and ("Close(…)", None, "return 2;") in s


def test_csharp_loops_jumps_yield_goto():
    g = cs("foreach (var x in Get()) { switch (x) { case 1: continue; default: break; } yield return x; } do { i++; } while (Go()); yield break;", "IEnumerable<int> F()")
    s = shape(g)
    assert ("foreach (var x in Get())", "body", "switch x") in s and ("continue;", None, "foreach (var x in Get())") in s and ("break;", None, "yield return x;") in s
    assert ("yield return x;", "repeat", "foreach (var x in Get())") in s and "do while (Go())" in {n["label"] for n in g["nodes"]}
    assert ("yield break;", None, "END") in s
    assert not [e for e in cs("goto done; ")["edges"] if e["to"] == 1]


def test_csharp_wrappers_lambdas_and_local_functions():
    g = cs("using (var a = Open()) lock (b) { Run(q => Hidden(q), delegate { Hid(); }); } int Local(int z) { return Inner(); } using var c = Two();", "void F()")
    assert [n["label"] for n in g["nodes"]][2:] == ["Open(…)", "Run(…)", "Two(…)"]


def test_csharp_arrow_members_and_accessors():
    src = "class C { int P => Calc(); int Q { get; set; } int M(int a) => a switch { 1 => A(), _ => 2 }; }"
    assert [n["kind"] for n in flow("csharp", src, "a.cs", "P", "C", 1)["nodes"]][2:] == ["call", "return"]
    assert [n["kind"] for n in flow("csharp", src, "a.cs", "M", None, 1)["nodes"]][2:] == ["match", "call", "return"]
    with pytest.raises(FlowError, match="accessors"):
        flow("csharp", src, "a.cs", "Q", None, 1)


def test_long_chains_are_cut_at_the_left():
    g = cs("return items.Where(x => x.IsActive).OrderBy(x => x.CreatedAtTimestamp).Select(x => x.Name).ToList();")
    last = [n["label"] for n in g["nodes"] if n["kind"] == "call"][-1]
    assert last.startswith("…") and last.endswith("ToList(…)")


@pytest.mark.parametrize("g", [rust("loop { if a { break; } }"), cs("while (x) { if (y) break; A(); } try { B(); } finally { C(); }")])
def test_every_node_is_reachable_and_renders(g):
    assert reachable(g) | {1} == {n["id"] for n in g["nodes"]}
    assert mermaid(g).startswith("flowchart TD\n  n0([") and tree(g).startswith("#0 entry")


def test_mermaid_escapes():
    assert '#quot;a#quot;' in mermaid(rust('if x == "a" {}')) and "#124;" in mermaid(rust("match v { A | B => 1, }"))


def test_many_functions(spark):
    from codeloom.flow.tables import edge_rows, flow_graphs, node_rows

    schema = "symbol_id long, path string, language string, name string, scope string, line long, content string"
    df = spark.createDataFrame([(1, "a.rs", "rust", "f", None, 1, "fn f() { g() }"), (2, "a.py", "python", "f", None, 1, "x"), (3, "b.rs", "rust", "f", None, 1, None)], schema)
    g = flow_graphs(df)
    assert {r.symbol_id: r.error is None for r in g.collect()} == {1: True, 2: False, 3: False}
    assert node_rows(g).count() == 4 and edge_rows(g).count() == 3


def test_functions_without_a_graph_have_a_row(monkeypatch):
    from codeloom.flow import parse

    def fail(*_):
        raise IndexError("gone")

    text = "class C { int F() { return 1; } int G(); int P { get; set; } }"
    assert [(g["function"]["name"], g["error"]) for g in parse.functions("csharp", text, "a.cs")] == [("F", None)]
    monkeypatch.setattr(parse.Builder, "build", fail)
    assert [(g["function"]["name"], g["function"]["line"], g["nodes"], g["error"]) for g in parse.functions("csharp", text, "a.cs")] == [("F", 1, None, "IndexError: gone")]


def test_broken_and_deep_texts():
    from codeloom.flow.parse import functions

    for text in ("fn f(", "fn f() { if x { ", "fn f(a { } fn g() { h() }", "fn { }", "fn f() { match x { A => ", "}}}} fn f() { }"):
        list(functions("rust", text, "a.rs"))
    for text in ("class C { int F(", "class C { int F( { } }", "class C { void F() { switch (x) { case ", "class C { void F() { try { } } }", "class C { int F() => "):
        list(functions("csharp", text, "a.cs"))
    chain = "if a { b(); } " + "else if a { b(); } " * 3000
    assert len(rust(chain)["nodes"]) == 2 + 2 * 3001
