"""Grammars: valid and broken sources, Python against the interpreter's own parser."""

from __future__ import annotations

import ast
import glob
import os
import random
import re
import time
import warnings

import pytest

from hearthdex.llm.parsing import GrammarError, Parser
from hearthdex.llm.syntax import first_error, invalid_files, invalid_rates, language, parsed_files

VALID = {
    "python": [
        "", "\n\n# only\n", "x = 1", "def f(a, /, b: int = 2, *c, d, **e) -> int:\n    return a\n", "async def f():\n    async with a as b, c: pass\n    return [x async for x in y]\n",
        "match x:\n    case {'a': [1, *_], **r} if r: pass\n    case A.B(c=1) | None as z: pass\nmatch = 1; case = 2; type = 3\n", "type X[T: int = str] = list[T]\n", "f'{a!r:>{w}} {{}} {x=} {\"nested\" + f\"{1}\"}'\n",
        "try:\n    pass\nexcept* (A, B) as e:\n    pass\n", "with (open(a) as b, c):\n    pass\n", "print(*a, **b, c=1)\nx[1:2, ::3, *y] = 4\n(a, *b), c = d\n", "lambda x, *, y=1: (yield)\n",
        "if (n := 1) > 0: x: int\nelse:\n\ty = '''\n====\n<<<<<<< HEAD\n'''\n", "a = b if c else d, *e\nfor x in *a, b: ...\n", "x = 0xFF + 1_000j + 0o17 + .5e-3\ny = 1if 1else 2\n", "\ufeffx = 1\r\ny = 2\r\n",
    ],
    "rust": [
        "", "#!/usr/bin/env x\n#![allow(dead_code)]\nfn main() {}\n", "pub(crate) async unsafe fn f<'a, T: ?Sized + 'a, const N: usize>(x: &'a mut [T; N]) -> impl Fn(u8) -> u8 + 'a where T: Copy { |y| y }\n",
        "fn f() { let Some(x) = y else { return; }; if let A { b, .. } = c && d {} match x { 1..=5 | 7 => {} -1 => 2, ref mut z @ _ if z > 3 => {}, } }\n",
        "impl<T> X for Vec<Vec<T>> { type A<'b> = B; const C: u8 = 1 << 2; fn m(&self) { a::<u8>(b.0.1, c?, d.await)[..2].e() } }\n", "macro_rules! m { ($($x:expr),*) => {{ $( f($x); )* }}; }\nm! { a b }\nfn f() { vec![1; 2]; m!(x) }\n",
        "fn f() -> u8 { for i in 0..n { 'a: loop { break 'a } } while x < y {} let s = S { a, b: 1, ..d }; match s { S { a: 1, .. } => (), _ => {} } unsafe { *p as u8 } }\n",
        'const A: &str = r#"}"# ; static B: char = \'\\u{41}\'; const C: u64 = 0xff_u64 + 1e3 as u64; // <<<<<<<\n', "enum E { A = 1, B(u8), C { x: u8 } }\nstruct U;\nstruct T(pub u8, u8);\ntrait W: X + 'static { fn f(&self); }\nuse a::{b, c::*, d as _};\nextern \"C\" { fn g(x: u8, ...); }\n",
        "fn f() { let x = a < b && c == d || !(e > f) == g; let y = a as u8 + 1 << 2 < b; if let A = b && c < d {} a == (b == c); let z = -&*a.b == c..d; x >>= a < b; }\ntype F = fn(u8, _: u8);\n",
        "fn f() { let c = move || -> u8 { 1 }; let r = ..; let q = &a..=b; if x == (S { a: 1 }) {} x <<= 1; y >>= 2; z >= w; let v: Vec<u8>= g(); }\n",
    ],
    "javascript": [
        "", "#!/usr/bin/env node\nvar a = 1\nvar b = 2\n", "import a, { b as c, default as d } from 'x'; export * as e from \"y\"; export default class extends f(g) { static #p = 1; get x() { return this.#p } static { h() } async *[Symbol.iterator]() {} }\n",
        "const f = async ({ a = 1, ...b }, [c, , d] = []) => ({ ...b, [c]: d, async e() {}, get g() { return 1 } })\n", "x = a ? b : c ?? d; y = a?.[b]?.(c)?.d; z = /[/\\]]+/g.test(q) / 2; label: for (const [k, v] of m) { continue label }\n",
        "for (let i = 0, n = 3; i < n; i++); for (x in y); do z(); while (1) if (a) b; else c\n", "const t = `a ${b + `c ${d}`} e`; tag`x`; new A.B(c)(d); new.target; import('x').then(y => y)\n",
        "return_ = function* () { yield* a; yield; const b = yield c }\n", "const v = <div a={1} {...p} b='it\"s'>it's {x.map(y => <A.B key={y}/>)} <></> &amp; // not a comment</div>\n", "with (a) b; if (x) function g() {}\n", "<!-- old\nx\n--> older\ny = a --> b\n", "for (let in obj) ;\nfor (var i = 0 in {}) ;\nlet = 1; await = let\nasync function f() { await g; function h() { return await } }\n", "export default class { }\nx = class { }\n", "a\n++b\nlet c = 1_000n, d = .5, e = 0b1, await_\n",
    ],
    "typescript": [
        "interface A<T extends object = {}> extends B<T>, C { readonly a?: string; [k: string]: any; (x: number): void; new (y: T): A<T>; m<U>(this: U): asserts this is T; get z(): number }\n",
        "type M<T> = { readonly [K in keyof T as `x${string & K}`]?: T[K] extends infer U ? U : never }; type F = (a: number, ...b: string[]) => void; type G = abstract new () => object; type H = [a: string, b?: number, ...c: any[]];\n",
        "abstract class A<T> extends B<T> implements C, D { constructor(private readonly a: string, public b?: number) { super() } declare x: number; static y!: string; abstract m(): void; override n<U>(x: U): x is U { return true } [k: string]: any }\n",
        "enum E { A = 1, 'B' }\ndeclare module 'x' { export const y: number; function f(a: string): void }\nnamespace N.M { export type T = 1 }\ndeclare global { var z: any }\nexport import a = b.c; import d = require('d'); export = e;\n",
        "let x = <any>y as unknown as Map<string, Array<Set<number>>>; let z = a!.b![0]!; const f = async <T,>(v: T): Promise<T> => v; g<string>(h); const k = i < j, l = m > (n); let q = r satisfies S;\n",
        "function f(a: string): void;\nfunction f(a: any) { return a ? (b) : c }\n@dec() class X { @a @b.c() d: string; @e() f() {} }\nlet u: unique symbol, v: typeof import('x'), w: A.B.C<D>[], t: 'a' | \"b\" | -1 | `c`;\n",
    ],
    "tsx": ["export const A = <T extends object>({ x }: P<T>): JSX.Element => <B<C, D<E>[]> x={1}><A<B> c={1} /></B>;\n", "const g = <T,>(x: T) => x; const e = <p>{a as string}</p>; function h<T>(x: T) { return x < 3 ? <a/> : null }\n"],
}
BROKEN = {
    "python": ["def f(:\n", "x = (1,\n", "if x\n    y\n", "  x = 1\n", "def f():\nx\n", "a = 'b\n", "print 'x'\n", "f(a=1, b)\n", "1 = x\n", "x = 012\n", "def f(a=1, b): pass\n", "if x:\n    a\n  b\n", "<<<<<<< HEAD\nx = 1\n=======\n", "f'{a'\n", "for x in y: z }\n", "{% if a %}\n"],
    "rust": ["fn f( {}\n", "fn f() { let x = ; }\n", "struct S { a: u8\n", "fn f() { a b }\n", "let x = 1;\n", 'const A: &str = "x;\n', "fn f() { x.; }\n", "fn f() {}\n}\n", "/* open\n", "<<<<<<< a\nfn f() {}\n", "fn f() { if x { } else }\n", "impl { }\n", "fn f() {}\n/// left alone\n", "def f():\n    pass\n", "fn f(x) {}\n", "fn f() { a < b < c; }\n", "fn f() { let x = a == b == c; }\n", "fn f() { if a <= b > c {} }\n", "fn f() { m!(\n=======\n); }\n<<<<<<< x\n"],
    "javascript": ["function f( {}\n", "const x;\n", "let a = {b: 1\n", "if (x { }\n", "x = ;\n", "'abc\n", "{\"a\": 1, \"b\": 2}\n", "a b\n", "return }\n", "class A { b( }\n", "const v = <div><p></div>;\n", "`a ${b\n", "interface A { b: string }\n", "<<<<<<< HEAD\nx\n", "class { }\n", "let let = 1\n", "x = async () => await\n", "async function f() { return await }\n", "import a from 'a'\nx = await\n", "import a from 'a'\n<!-- x\n", "const let = 1\n", "function f() {\n  x\n>>>>>>> a\n}\n", "let a: string = 1\n"],
    "typescript": ["interface A { b: }\n", "let x: = 1\n", "type A = { a: string\n", "class A { private }}\n", "function f(a: string { }\n", "enum E { A = }\n", "const x = <div>a</div>;\n", "def f(): pass\n", "let y: Map<string = 1;\n"],
    "tsx": ["const a = <p>{b</p>;\n", "const a = <p>x > y</p>;\n", "export function A() { return (<a></b>); }\n", "const c = (\n  <p>\n=======\n  </p>\n);\n"],
}


@pytest.mark.parametrize("name,source", [(n, s) for n, all_ in VALID.items() for s in all_])
def test_valid(name, source):
    place = language(name).error(source)
    assert place < 0, source[max(0, place - 30) : place + 20]


@pytest.mark.parametrize("name,source", [(n, s) for n, all_ in BROKEN.items() for s in all_])
def test_broken(name, source):
    assert 0 <= language(name).error(source) <= len(source)


def agrees(source):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(source, "x", "exec", dont_inherit=True, flags=ast.PyCF_ONLY_AST)
        want = True
    except (SyntaxError, ValueError):
        want = False
    return (language("python").error(source) < 0) == want


def test_python_agrees_with_the_interpreter_on_its_library_and_on_damage():
    rng = random.Random(4)
    files = [f for f in sorted(glob.glob(os.path.join(os.path.dirname(os.__file__), "*.py"))) if os.path.getsize(f) < 30_000][::6]
    sources = [open(f, encoding="utf-8", newline="").read() for f in files]
    assert all(agrees(s) for s in sources)
    small = [s for s in sources if len(s) < 6000]
    for _ in range(150):
        s = rng.choice(small)
        i = rng.randrange(len(s))
        damaged = rng.choice([s[:i], s[:i] + s[i + 1 :], s[:i] + rng.choice("()[]{}:,.='\"#\\ \n\t*1a@;") + s[i:]])
        assert agrees(damaged), damaged[max(0, i - 40) : i + 40]


#: A piece that opens, what stands inside, a piece that closes; text before and behind. By extension.
NESTED = {
    "py": [
        ("(", "1", ")", "x = ", "\n"), ("(", "a", ")", "", " = 1\n"), ("[", "a", "]", "", " = 1\n"), ("lambda: ", "1", "", "x = ", "\n"), ("{1: ", "1", "}", "x = ", "\n"),
        ("f(", "", ")", "", "\n"), ("a[", "1", "]", "", "\n"), ("1 if a else ", "2", "", "x = ", "\n"), ("not ", "a", "", "x = ", "\n"), ("(a for a in ", "b", ")", "x = ", "\n"),
        ('f"{', "1", '}"', "x = ", "\n"), ("(", "a", ")", "with ", ": pass\n"), ("[", "", "]", "match x:\n case ", ": pass\n"), ("(", "a", ")", "del ", "\n"), ("(", "a", ")", "", ": int\n"),
        ("(yield ", "1", ")", "def f():\n x = ", "\n"), ("(", "a := 1", ")", "", "\n"),
    ],
    "rs": [
        ("(", "1", ")", "fn f() { let x = ", "; }"), ("A<", "B", ">", "fn f() { let x: ", "; }"), ("{", "", "}", "fn f() ", ""), ("if a {", "", "}", "fn f() { ", " }"),
        ("match a { b => ", "1", "}", "fn f() { ", " }"), ("match a { b => {", "1", "} }", "fn f() { ", " }"), ("|a| ", "1", "", "fn f() { let x = ", "; }"), ("(", "a", ")", "fn f() { let ", " = 1; }"),
        ("f(", "", ")", "fn f() { ", "; }"), ("A { a: ", "1", "}", "fn f() { let x = ", "; }"), ("if a {} else ", "{}", "", "fn f() { ", " }"), ("mod a { ", "", "}", "", ""), ("a::{", "b", "}", "use ", ";"),
        ("&", "u8", "", "fn f(x: ", ") {}"), ("(", "a", ")", "fn f() { if ", " {} }"), ("fn(", "", ")", "fn f(x: ", ") {}"), ("<", "A", " as B>::C", "fn f(x: ", ") {}"), ("Box<dyn A<", "B", ">>", "fn f(x: ", ") {}"),
    ],
    "js": [
        ("(", "1", ")", "x = ", ""), ("[", "", "]", "x = ", ""), ("{a: ", "1", "}", "x = ", ""), ("(a) => ", "1", "", "x = ", ""), ("() => {", "", "}", "x = ", ""), ("f(function () {", "", "})", "", ""),
        ("a ? ", "b", " : c", "x = ", ""), ("`${", "1", "}`", "x = ", ""), ("<a>{", "1", "}</a>", "x = ", ""), ("new ", "A", "()", "x = ", ""), ("class { a() { return ", "1", "} }", "x = ", ""),
        ("[", "a", "]", "let ", " = 1"), ("(a = ", "1", ") => 1", "x = ", ""), ("if (a) ; else ", ";", "", "", ""), ("try {", "", "} finally {}", "", ""),
    ],
    "ts": [
        ("A<", "B", ">", "let x: ", ""), ("(", "A", ")", "let x: ", ""), ("(a: ", "A", ") => B", "let x: ", ""), ("A extends B ? C : ", "D", "", "type X = ", ""), ("{a: ", "A", "}", "let x: ", ""),
        ("a ? (", "b", ") : c", "x = ", ""), ("(a): B => ", "1", "", "x = ", ""), ("<A>", "b", "", "x = ", ""), ("namespace A {", "", "}", "", ""), ("`${", "A", "}`", "type X = ", ""),
        ("<T,>(a = ", "1", ") => 1", "x = ", ""), ("f<A>(", "", ")", "x = ", ""), ("(a < ", "b", ")", "x = ", ""),
    ],
}


@pytest.mark.parametrize("ext", NESTED)
def test_time_grows_with_the_length_however_deep_the_text_is_nested(ext):
    def seconds(form, n):
        opening, inside, closing, before, behind = form
        source = before + opening * n + inside + closing * n + behind
        began = time.process_time()
        assert first_error(f"a.{ext}", source) is None, source[:80]
        broken = before + opening * n + inside + " 1 1 " + closing * n + behind
        assert first_error(f"a.{ext}", broken) is not None or form[0] == 'f"{', broken[:80]
        return time.process_time() - began

    seconds(NESTED[ext][0], 3)  # compiles the grammar
    seconds(NESTED[ext][0], 3)
    for form in NESTED[ext]:
        assert seconds(form, 2000) < 2, form


def test_depth_is_no_limit():
    for path, source in (("a.py", "x = %s\n"), ("a.rs", "fn f() { x = %s; }"), ("a.ts", "x = %s")):
        assert first_error(path, source % ("(" * 20_000 + "1" + ")" * 20_000)) is None
        assert first_error(path, source % ("(" * 20_000 + "1 1" + ")" * 20_000)) is not None


def test_a_cycle_without_a_column_is_refused():
    with pytest.raises(GrammarError):
        Parser("s = a EOF\na = '(' a ')' / 'x'\n", "s")
    assert Parser("s = a EOF\n@a = '(' a ')' / 'x'\n", "s").parse(["(", "x", ")", "EOF"], [False] * 4) == -1


def test_large_charts_are_emptied(monkeypatch):
    monkeypatch.setattr("hearthdex.llm.parsing.LARGE", 3)
    p = Parser("s = b* EOF\n@@b = e ';' / e '!' ';'\n@e = '(' e ')' / 'x' 'x' 'x' 'x'\n", "s")
    one = list("((xxxx))!;")
    assert p.parse(one * 50 + ["EOF"], [False] * 501) == -1
    assert p.parse(one * 50 + ["(", "EOF"], [False] * 502) == 501


def test_grammar_texts():
    p = Parser("s = item+ EOF\nitem = 'a' 'b'? / &'c' 'c' !'a' # none\n", "s")
    say = lambda *k: p.parse([*k, "EOF"], [False] * (len(k) + 1))
    assert say("a", "b", "c", "a".replace("a", "c")) == -1
    assert say("a", "c", "a") == 2 and say() == 0 and say("a", "b", "b") == 2
    for bad in ("s = (", "s = 'a'\ns = 'b'", "s = none", "= x"):
        with pytest.raises(GrammarError):
            Parser(bad, "s")


def test_lines_and_languages():
    assert first_error("a/b.py", "x = 1\ny = (\n") == ("python", 3) or first_error("a/b.py", "x = 1\ny = (\n")[0] == "python"
    assert first_error("a.rs", "fn f() {\n  a b\n}\n") == ("rust", 2)
    assert first_error("a.md", "((") is None and first_error("README", "((") is None and first_error("b.PY", "((") is None


def test_rows(spark):
    schema = "repo string, path string, chunk_index int, text string, indexed_at int, language string, line int"
    rows = [
        ("r", "a.py", 0, "x = 1\n", 1, "odd", 5), ("r", "b.py", 0, "x = (\n", 2, None, 5), ("r", "b.py", 0, "fine\n", 1, None, 5), ("r", "c.md", 0, "((", 1, None, 5),
        ("s", "d.ts", 1, "= 1\n", 1, None, 5), ("s", "d.ts", 0, "let x ", 1, None, 5), ("s", "e.rs", 0, None, 1, None, 5), (None, "f.py", 0, "((", 1, None, 5), ("r", None, 0, "((", 1, None, 5),
    ]
    df = spark.createDataFrame(rows + rows[:3], schema)
    assert [(r["repo"], r["path"], r["language"]) for r in invalid_files(df).collect()] == [("r", "b.py", "python")]
    assert {(r["path"], r["line"] > 0) for r in parsed_files(df).collect()} == {("a.py", False), ("b.py", True), ("d.ts", False), ("e.rs", False)}
    assert {tuple(r) for r in invalid_rates(df).collect()} == {("r", "python", 2, 1, 0.5), ("s", "typescript", 1, 0, 0.0), ("s", "rust", 1, 0, 0.0)}
    assert invalid_files(df.limit(0)).count() == 0


def test_markers_inside_rust_macros():
    for source in ("fn f() { vec![\n<<<<<<< HEAD\n1\n=======\n2\n>>>>>>> a\n]; }\n", "macro_rules! m {\n() => {\n||||||| a\n};\n}\n"):
        assert language("rust").error(source) == re.search("^[<|]", source, re.M).start()
    assert language("rust").error('fn f() { m!(r"\n<<<<<<< HEAD\n", a\n/*\n=======\n*/ << 1); }\n') < 0
