from codeloom.extract.scan import parse
from codeloom.extract.tables import relations


def names(text, language):
    p = parse(text, language)
    return {(s["name"], s["kind"], s["visibility"], s["scope"]) for s in p.symbols}, p


def test_python():
    text = '''import os, a.b as c, d.e
from .m import x as y, z
from q import *
MAX = 1
MAX_2 = 2
class A:
    def __init__(self):
        def inner(): pass
        self.go(f(1))
    def _p(self): pass
    def __q(self): pass
    class B: pass
@deco(1)
async def run():
    return A().go()
'''
    s, p = names(text, "python")
    assert s == {("MAX", "const", "pub", None), ("A", "class", "pub", None), ("__init__", "fn", "protected", "A"), ("_p", "fn", "protected", "A"), ("__q", "fn", "private", "A"), ("B", "class", "pub", "A"), ("run", "fn", "pub", None)}
    assert [(i["import_path"], i["names"]) for i in p.imports] == [("os", []), ("d.e", []), (".m", ["y", "z"]), ("q", [])]
    assert {(r["symbol_name"], r["qualified"]) for r in p.references} == {("go", True), ("f", False), ("deco", False), ("A", False)}
    init = next(x for x in p.symbols if x["name"] == "__init__")
    assert (init["line"], init["column"], init["end_line"]) == (7, 8, 9)


def test_rust():
    text = '''use std::fmt;
use crate::a::{b, c};
pub(crate) struct S { x: u32 }
enum E { A(u32) }
pub trait T { type X; fn sig(&self); fn dflt(&self) { go(); } }
impl T for S { type X = u8; pub fn m(&self) { fn local() {} self.n(q()); println!("{}", hidden(1)); } }
impl<A> G<A> { fn g() { a::b::call(); if let Some(x) = opt() { x } } }
pub const K: u32 = 1;
static Z: u8 = 2;
mod inner { pub fn f() {} }
'''
    s, p = names(text, "rust")
    assert s == {
        ("S", "struct", "pub", None), ("E", "enum", "private", None), ("T", "trait", "pub", None), ("dflt", "fn", "private", "T"), ("X", "type", "private", "T"), ("m", "fn", "pub", "T"),
        ("g", "fn", "private", None), ("K", "const", "pub", None), ("Z", "const", "private", None), ("inner", "mod", "private", None), ("f", "fn", "pub", "inner"),
    }
    assert [i["import_path"] for i in p.imports] == ["std::fmt", "crate::a"]
    assert {(r["symbol_name"], r["qualified"]) for r in p.references} == {("go", False), ("n", True), ("q", False), ("call", True), ("opt", False)}


def test_go():
    text = '''package a
import ( "fmt"; m "x/y" )
import "z"
type S struct { a int }
type I interface { Do() }
const ( A = 1
  b = 2 )
var V, w int
func F(x int) int { const l = 1; return g(fmt.Sprint(x)) }
func (s *S) m() {}
'''
    s, p = names(text, "go")
    assert s == {("S", "struct", "pub", None), ("I", "interface", "pub", None), ("A", "const", "pub", None), ("b", "const", "private", None), ("V", "const", "pub", None), ("w", "const", "private", None), ("F", "fn", "pub", None), ("m", "fn", "private", "S")}
    assert [i["import_path"] for i in p.imports] == ["fmt", "x/y", "z"]
    assert {(r["symbol_name"], r["qualified"]) for r in p.references} == {("g", False), ("Sprint", True)}


def test_typescript_and_javascript():
    text = '''import d, { a as b, c } from "./x";
import * as ns from './y';
import "side";
export interface I { m(): void }
type T = { a: string };
export enum E { A }
export const k = 1, j = 2;
let loc = (x: number) => { const inner = 1; return inner; };
export default class C { constructor(p: string) {} go(): void { this.run(new D(f())); } }
export function fn<A>(x: A): A { return x; }
'''
    s, p = names(text, "typescript")
    assert s == {
        ("I", "interface", "pub", None), ("T", "type", "private", None), ("E", "enum", "pub", None), ("k", "const", "pub", None), ("j", "const", "pub", None), ("loc", "const", "private", None),
        ("C", "class", "pub", None), ("constructor", "fn", "private", "C"), ("go", "fn", "private", "C"), ("fn", "fn", "pub", None),
    }
    assert [(i["import_path"], i["names"]) for i in p.imports] == [("./x", ["d", "b", "c"]), ("./y", ["ns"]), ("side", [])]
    assert {(r["symbol_name"], r["qualified"]) for r in p.references} >= {("run", True), ("D", False), ("f", False)}
    s, _ = names("export const a = 1;\nfunction b() {}\nvar c = 2\n", "javascript")
    assert s == {("a", "const", "pub", None), ("b", "fn", "private", None), ("c", "const", "private", None)}


def test_swift():
    text = '''import Foundation
public struct S { public func m() { call(1); a.q() } }
extension S { func e() {} }
public protocol P {}
actor A {}
public typealias L = Int
open func f() { func local() {} }
'''
    s, p = names(text, "swift")
    assert s == {("S", "struct", "private", None), ("m", "fn", "pub", "S"), ("e", "fn", "private", "S"), ("P", "trait", "private", None), ("A", "class", "private", None), ("L", "type", "pub", None), ("f", "fn", "pub", None)}
    assert [(r["symbol_name"], r["qualified"]) for r in p.references] == [("call", False)]
    assert [i["import_path"] for i in p.imports] == ["Foundation"]


def test_csharp():
    text = '''using System;
using IO = System.IO;
namespace N.M {
public class C { private readonly int _f = Make(1); public C(int x) { Use(x); } public int P { get; set; } internal int Q => Calc();
  public int M(int a) { var b = new List(); return b.Add(a); } }
interface I { int Do(); }
record R(int X);
enum E { A }
}
'''
    s, p = names(text, "csharp")
    assert s == {
        ("N.M", "mod", "pub", None), ("C", "class", "pub", "N.M"), ("C", "fn", "pub", "C"), ("P", "fn", "pub", "C"), ("Q", "fn", "private", "C"), ("M", "fn", "pub", "C"),
        ("I", "interface", "private", "N.M"), ("Do", "fn", "pub", "I"), ("R", "class", "private", "N.M"), ("E", "enum", "private", "N.M"),
    }
    assert [(i["import_path"], i["alias"]) for i in p.imports] == [("System", None), ("System.IO", "IO")]
    assert {(r["symbol_name"], r["qualified"], r["from_scope"]) for r in p.references} == {("Make", False, "C"), ("Use", False, "C"), ("Calc", False, "C"), ("List", False, "C"), ("Add", True, "C")}


def test_bytes_and_oddities():
    assert parse("é = 1\ndef ö(): pass\n", "python").symbols[0]["column"] == 4
    assert parse("x = 'é'; f()\n", "python").references[0]["column"] == 10
    for language in ("python", "rust", "go", "typescript", "javascript", "swift", "csharp"):
        for text in ("", "\n", "((((", "}}}}", '"', "/*", "﻿", "def (", "fn {", "class", "import"):
            parse(text, language)
    assert parse("x", "cobol").symbols == []


def test_relations(spark):
    rows = [(1, "a.py", "python", "def f(): g()\n"), (2, "b.py", "python", None), (3, "c.zig", "zig", "fn x() {}"), (4, "d.py", "python", "")]
    rel = relations(spark.createDataFrame(rows, "file_id long, path string, language string, content string"))
    assert [(r.file_id, r.name) for r in rel["symbols"].collect()] == [(1, "f")]
    assert [r.symbol_name for r in rel["raw_references"].collect()] == ["g"]
    assert [r.file_id for r in rel["errors"].collect()] == [2]
