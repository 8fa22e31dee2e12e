"""Short texts that the grammars must reject and accept, by language."""

INVALID = {
    "python": [
        '1 = x',
        'None = 1',
        'f() = 3',
        'del f()',
        'a, b += 1',
        'def f(*): pass',
        'def f(a=1, b): pass',
        'f(a=1, 2)',
        'f(x for x in y, 1)',
        '{1: 2, 3}',
        'banana X = 3',
        'foo x:\n    bar y:\n        pass',
        'f"{a b}"',
        'f"{"',
        'lambda a=1, b: 0',
        'lambda *: 0',
        'def f(**k, a): pass',
        'def f(*a, *b): pass',
        'def f(/, a): pass',
        'def f(a, /, b, /): pass',
        'x = *a',
        'a = b += 1',
        '(a, b) : int = 3',
        '[x for x in]',
        'import a.b as c.d',
        'from . import *, a',
        'f(**k, *a)',
        'f(a for a in b, c)',
        'class A: x = yield = 3',
        'with a as f(): pass',
        'for f() in x: pass',
        'for 1 in x: pass',
        'True += 1',
        'a.b: int = c = d',
        'del (a, 1)',
        "print 'x'",
        "exec 'x'",
        'async x = 1',
        'nonlocal x, 1',
        '{**a: 1}',
        '{1, **a}',
        '{*a: 1}',
        'match x:\n  pass',
        'try:\n  pass\nexcept:\n  pass\nexcept A:\n  pass\n',
        'raise a, b',
        "f'{}'",
        "f'{a!z}'",
        "f'{a!r:{b c}}'",
        '(yield) = 1',
        'a if b = c',
        'x = (a=1)',
        'def f(a, a:): pass',
        'return = 1',
        'a := 1',
        '[a, b] := 1',
        'f(a.b=1)',
        'f(a:=1, b)=2',
        '@\ndef f(): pass',
        'global a.b',
        'lambda: (yield) = 1',
        "b'é'",
        "'a' b'c'",
    ],
    "javascript": [
        '1 = x;',
        'const x;',
        'a ?? b || c;',
        'x = /(/;',
        'a() = 1;',
        'for (const x of a, b) {}',
        'let [a];',
        'const {a};',
        'a || b ?? c;',
        'new.target = 1;',
        '++a++;',
        '-a ** b;',
        'for (let x = 1 of y) {}',
        'if (a) const b = 1;',
        'return = 1;',
        'function f(...a, b) {}',
        'var a.b = 1;',
        "import {a} fro 'b';",
        'export {a b};',
        'a?.b = 1;',
        '`${a b}`',
        'delete',
        'yield => 1;',
        'await = = 1',
        'x = /[/;',
        'x = /a/gg;',
    ],
    "typescript": [
        'let x: = 1;',
        'interface A { a: }',
        'type A = ;',
        'function f(a?: number, ...b, c) {}',
        '1 = x;',
        'a ?? b || c;',
        'enum A { a b }',
    ],
    "rust": [
        'a < b < c;',
        'fn f() { a < b < c; }',
        'fn f() { a == b == c; }',
        'fn f() { let x = ; }',
        'struct A { a: i32 b: i32 }',
        'fn f(a) {}',
        'fn f() { 1 = ; }',
        'fn f() { x as ; }',
        'fn f() { a..b..c; }',
        'fn f() -> {}',
        'impl A { x }',
        'fn f() { if x { 1 } else 2 }',
        'enum A { B(i32 }',
        'use a::{b, c;',
        'fn f() { let mut = 1; }',
        'fn f() { match x { 1 => 2 3 => 4 } }',
        'pub fn f();;x',
        'fn f() { |a, b }',
        'fn f() { &&& }',
    ],
    "go": [
        'package a\nvar a',
        'package a\nfunc f() { var a }',
        'package a\nfunc f() { x := }',
        'package a\nfunc f() { if x { } else y }',
        'package a\nfunc f(a int b int) {}',
        'package a\nimport a',
        'package a\nfunc f() { for i := 0; i < 1 { } }',
        'package a\ntype A struct { a, b }',
        'package a\nfunc f() { 1 := 2 }',
        'package a\nfunc f() { a.b := 2 }',
        'package a\nfunc f() { go x }',
        'package a\nfunc f() { defer x }',
        'package a\nfunc f() { a++ + b }',
        'package a\nfunc f() { switch { case 1: fallthrough default } }',
        'package a\nx := 1',
        'package a\nfunc f() (a int, string) {}',
        'package a\nconst a int',
        'package a\nfunc f(a, b int, string) {}',
        'package a\nfunc f(a ...int, b int) {}',
        "package a\nfunc f() { 'ab' }",
        'package a\nfunc f() { return 1 2 }',
        'package a\nfunc f() { a, b += 1 }',
        'package a\nfunc f() { var x int = }',
        'package a\nvar a int\nimport "x"',
    ],
    "swift": [
        'class A { func f() }',
        'let',
        'func f( {}',
        'let x = ',
        'if x { } else y',
        'struct A { var }',
        'func f(a) {}',
        'enum A { case }',
        'for x y {}',
        'let x: = 1',
        'switch x { case 1 }',
        'switch x { }x',
        'guard x { }',
        'class A { let x: }',
        'func f() -> { }',
        'func f() { return return }',
        'x = = 1',
        'protocol P { func f() { } }',
        'struct S { init() }',
        '"\\(a b)"',
        'let x = [1, 2',
        'import',
        'a b',
        'f(a b)',
        'func f(_ a: Int b: Int) {}',
    ],
    "csharp": [
        'class A { string s = $"{a b}"; }',
        'class A { } using X;',
        'class A { int x }',
        'class A { void f() }',
        'class A { void f() { int x = ; } }',
        'class A { void f() { if x { } } }',
        'class A { int f( { } }',
        'namespace A { int x; }',
        'class A : { }',
        'class A { void f(int) { } }',
        'class A { void f() { for (;;) } }',
        'class A { void f() { x = 1 } }',
        'class A { void f() { return 1 2; } }',
        'enum A { a b }',
        'class A { public public int x; }x',
        'class A { void f() { try { } } }',
        'class A { int x { get; set } }',
        'class A { void f() { new A; } }',
        'using A',
        'class A { void f() { switch (x) { case 1 break; } } }',
        'class { }',
        'class A { void f() { var = ; } }',
        'class A { void f() { lock { } } }',
        'class A { string s = $"{}"; }',
        'class A { void f() { x.y(; } }',
        'class A<> { }',
        "class A { char c = 'ab'; }",
    ],
}

VALID = {
    "python": [
        'type X = int',
        'type = 3',
        'match x:\n    case 1:\n        pass\n    case [a, *b] if a: pass\n    case _: pass',
        'match = 1\nmatch.x = 2\nmatch(a)\nprint(match)',
        'case = 3',
        'f(*a, b, *c, **d, e=1)',
        'f(a=1, *b)',
        'def f(a, /, b, *, c, **d): pass',
        'def f(*a, b=1, c): pass',
        'x: int = yield',
        '(a) = 1\n(a.b) += 1\n[a, *b] = c\n*a, b = c',
        'with (a as b, c as d): pass\nwith (a): pass\nwith (a, b): pass\nwith a, b as c: pass',
        "f'{a!r:>{w}} {{x}} {b=}'",
        "f'{x:%Y-%m}'",
        "f'{lambda_}'",
        'f"{a[\'b\']}"',
        "f'''{\na\n}'''",
        'lambda *a, b=1, **k: 0',
        'lambda: (yield)',
        'for x in *a, b: pass',
        'return_ = 1',
        "{**a, 'b': 1}",
        '{*a, b}',
        'f(x for x in y)',
        'f((x for x in y), 1)',
        'del a, b[0], (c.d, e)',
        'async def f():\n    async with a as b: pass\n    async for x in y: pass\n    return [x async for x in y]',
        '@a.b(c)\nclass A(B, metaclass=C): pass',
        'try: pass\nexcept* A as e: pass',
        "print(*a, sep='')",
        'x = a if b else c',
        'global a, b',
        'assert a, b',
        'raise A from b',
        'a = b = c',
        'a[1:2, ::3] = 1',
        'a: int',
        'a.b: int = 1',
        'a[0]: int',
        'x = (yield)',
        'f(a:=1)',
        '[y := 1, y**2]',
        'not a not in b',
        'f\'{a}\' \'b\' "c"',
        "f'{a,}'",
        "f'{*a, b}'",
        "f'{yield_}'",
        "rf'\\d{a}'",
        "match x:\n    case {'a': 1, **r}: pass\n    case A(b=1, c=2): pass\n    case 'a' | 'b': pass\n    case -1 + 2j: pass\n    case (1, 2) as t: pass",
        'match a, b:\n    case c, d: pass',
    ],
    "javascript": [
        'const x = 1;',
        'for (const x of y) {}',
        'for (const x in y) {}',
        '(a ?? b) || c;',
        'a ?? b ?? c;',
        'x = /[(]/;',
        '[a, b] = [b, a];',
        '({a, b: c} = d);',
        'a.b = 1; a[0] += 2;',
        'let let_ = 1;',
        'x = a / b / c;',
        'async () => { for await (const x of y) {} }',
        'label: for (;;) { break label; }',
        '(-a) ** b; a ** -b;',
        'x = {get a() { return 1 }, set a(v) {}, async *b() {}, [c]: 1};',
        'class A { #x = 1; static { } get y() { return this.#x } static async *z() {} }',
        "import a, {b as c} from 'd'; export * as e from 'f';",
        'a?.b?.[c]?.(d);',
        'new.target;',
        'x = y\n/z/g.test(w)',
        'function f({a, b = 1}, [c, ...d], ...e) {}',
        'if (a) b; else c',
        'do x++; while (y) z',
        'var {a, ...b} = c;',
        '`a${`b${c}`}d`',
        'x = a ? b : c ? d : e;',
        'yield_ = 1; async = 2; of = 3; get = 4;',
        '(a, b) => ({...a, b});',
        'x = function* () { yield* a; };',
        "import('a').then(b);",
        'import.meta.url;',
        'tag`a${b}`;',
        'a = b ? (c, d) : e => f;',
        'for (let i = 0, n = 1; i < n; i++) ;',
        'for (a.b of c) ;',
        'x = a\n++b',
        'x = {if: 1, class: 2}; x.new;',
    ],
    "typescript": [
        'let x: number;',
        'declare const x: number;',
        'declare let y;',
        'const x = <T,>(a: T) => a;',
        'let a = b as const;',
        'function f<T extends U = V>(this: A, b?: c): d is E {}',
        'abstract class A<T> extends B<C> implements D { private readonly x: number = 1; abstract f(): void; constructor(public a: string) { super() } }',
        'type A<T> = T extends (infer U)[] ? U : never;',
        "enum A { B = 1, C = 'd' }",
        'namespace A.B { export const c = 1 }',
        'let x = a!.b!;',
        'type M = { readonly [K in keyof T]?: T[K] };',
        "import type { A } from 'b'; import { type C } from 'd';",
        'export type { A };',
        'let f: (a: number) => void;',
        'function f(a: string): void;\nfunction f(a: any) {}',
        'let t: [a: string, b?: number];',
        'x satisfies Y;',
        'let v = <any>x;',
        'a<b>(c);',
        'type T = `a${B}`;',
        'class A { static #p?: string; declare x: number; override f() {} get [Symbol.x]() { return 1 } }',
    ],
    "rust": [
        'fn f() { (a < b) == c; }',
        'fn f() { a < b && c < d; }',
        'fn f() { let x = Vec::<i32>::new(); }',
        'fn f() { a..b; ..; a..=b; }',
        'fn f() { if let Some(x) = y && z { } }',
        'fn f() { let x = y as usize < z; }',
        'fn f() { x = y = z; }',
        "fn f<'a, T: A + 'a, const N: usize>(x: &'a T) -> impl B where T: C {}",
        '#[a] struct A<T>(pub T);',
        'fn f() { match x { 1 | 2 => {} A { b, .. } if c => d, _ => e } }',
        'fn f() { let A { b, c: d } = e else { return }; }',
        'macro_rules! m { ($a:expr) => { $a + 1 }; }',
        'fn f() { || 1; move |a, b: i32| -> i32 { a }; }',
        'unsafe impl A for B {}',
        'const fn f() {}',
        "fn f() { 'a: loop { break 'a 1; } }",
        'fn f() { x?.await; }',
        'fn f() { S { a, ..b }; }',
        'use a::{self, b as c, d::*};',
        'fn f() { a << b >> c; a >>= 1; a >= b; }',
        'fn f() { let x: Vec<Vec<i32>> = y; }',
    ],
    "go": [
        'package a\nvar a int',
        'package a\nvar a = 1\nvar (\n b, c = 1, 2\n d int\n)',
        'package a\nconst (\n a = iota\n b\n)',
        'package a\nfunc f() { x, y := 1, 2; x, y = y, x }',
        'package a\nfunc (r *R[T]) f(a, b int, c ...string) (d error) { defer g(); go func() {}() }',
        'package a\nfunc f[T any, U ~int | string](a T) U { return U(a) }',
        'package a\nfunc f() { for range 10 { }; for i := range x { }; for k, v = range m { }; for i := 0; i < 1; i++ { }; for { } }',
        'package a\nfunc f() { switch x := y.(type) { case int, string: default: } }',
        'package a\nfunc f() { select { case a := <-b: case c <- d: default: } }',
        'package a\ntype A struct { B; *C; d, e int `tag`; f func(int) }',
        'package a\ntype I interface { f(int) string; J; ~int | ~string }',
        'package a\nfunc f() { a[1:2:3], b.c, *d = 1, 2, 3 }',
        'package a\nfunc f() { <-c; g(); }',
        'package a\nfunc f() { x := []int{1, 2: 3}; m := map[string]A{"a": {b: 1}} }',
        'package a\nfunc f(int, string) (int, error) { return 1, nil }',
        'package a\nfunc f() { L: for { break L; continue L }; goto L }',
        'package a\nfunc f() { if x := g(); x != nil { } else if y { } else { } }',
        'package a\nfunc f()\n',
        'package a\nfunc f() { (<-c) ; (g()) }',
        'package a\nfunc f() { var x, y int = 1, 2; const z = 3; type T int }',
    ],
    "swift": [
        'protocol P { func f(); var x: Int { get set }; init(); subscript(i: Int) -> Int { get } }',
        'class A { func f() {}; init() {}; deinit {} }',
        'let x = "\\(a) \\(b.c("d"))"',
        'func f(_ a: Int, b c: String = "d") throws -> [Int: String]? { return nil }',
        'if let x = y, x > 1 { } else if case .a(let b) = c { } else { }',
        'switch x { case 1, 2: break; case .a(let b) where b > 1: fallthrough; default: return }',
        'guard let self else { return }',
        'for (i, x) in y.enumerated() where i > 1 { }',
        'let f = { (a: Int) -> Int in a + 1 }',
        'x.map { $0 + 1 }.filter { $0 > 1 }',
        'enum A: String { case b = "c", d; indirect case e(A, f: Int) }',
        'extension A: B where C: D { }',
        '@objc private(set) var x: Int = 1 { didSet { } }',
        'var x: Int { get { 1 } set { } }',
        'let x = a ? b : c',
        'try? f(); try! g(); await h()',
        'do { try f() } catch let e as E { } catch { }',
        '#if DEBUG\nlet x = 1\n#endif',
        'struct A<T: B>: C { static func == (l: A, r: A) -> Bool { true } }',
        '@_silgen_name("f") func f()',
        'let x = [1, 2, 3][0...1]',
        'typealias A = (Int) -> Void',
        'func f<T>(_ x: some P, y: inout T) async {}',
        'class A { class func f() {} }',
    ],
    "csharp": [
        'class A { string s = $"{a} {b:N2} {c,10} {{x}}"; }',
        'using X; class A { }',
        'using X; using var_ = Y.Z; namespace A; class B { }',
        'class A { int x { get; set; } = 1; int Y => 1; }',
        'class A { abstract void f(); partial void g(); extern int h(); }',
        'interface I { void f(); int X { get; } }',
        'class A { void f() { a.b(); x++; new A(); await c; a = b; a ??= b; } }',
        'class A { void f() { var x = a is B b ? b : c switch { 1 => 2, _ => 3 }; } }',
        'class A { void f() { foreach (var (a, b) in c) { } for (int i = 0; i < 1; i++) { } } }',
        'class A<T> : B<T>, C where T : class, new() { }',
        'record A(int X, string Y) : B(X);',
        'class A { void f() { using var x = y; using (z) { } lock (a) { } } }',
        'class A { void f() { int? x = a?.b?[0]; var (c, d) = e; (f, g) = h; } }',
        'class A { string s = @"a""b"; string t = """a"b"""; string u = $@"{a}""{b}"; }',
        'class A { string s = $"{(a ? b : c)} {d["e"]} {f(\'g\')}"; }',
        'class A { void f() { Func<int, int> g = x => x + 1; h(async (a, b) => { await c; }); } }',
        'class A { void f() { var q = from x in y where z select w; } }',
        '[Attr(1)] public class A { [B] int x; ~A() { } public static A operator +(A a, A b) => a; }',
        'Console.WriteLine("x"); int y = 1; class A { }',
        'class A { void f() { List<int> x = new(); var y = new List<int>(); int[] z = [1, ..w]; } }',
        'class A { void f() { goto x; x: return; } }',
        'class A { void f() { if (a) b(); else c(); do { } while (d); switch (e) { case 1: case > 2 when f: break; default: break; } try { } catch (E x) when (y) { } finally { } } }',
        'class A { event E x; event F y { add { } remove { } } delegate void D(int a); enum G : byte { H = 1, I } }',
        'class A { string s = $"{a:yyyy-MM-dd}"; string t = $"{a,-5:X}"; }',
        'class A { string s = $"""{a} "b" """; string t = $$"""{x} {{y}}"""; }',
    ],
}
