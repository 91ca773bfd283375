from __future__ import annotations

from hearthdex.chunking.structural import chunk_source, chunked, chunks_for_embedding, focus_pieces, language_for_path, outline


def names(language, source):
    return [(c.symbol, c.start_line, c.end_line) for c in chunk_source(language, source)]


RUST = '''// leading
use x::y;

#[derive(Debug)]
pub struct Point {
    x: char, // '{'
}

impl<'a> Point {
    fn beta(&self) -> &'a str { "}" }
}

pub(crate) async fn alpha<T: Into<String>>(x: T) -> Vec<u8> where T: Copy { r#"}"#.into() }

macro_rules! m { ($x:expr) => { fn hidden() {} }; }

mod inner {
    enum Kind { A, B(u8) }
    pub trait Walk { fn step(&self); }
    const N: usize = 3;
}
struct Unit;
'''


def test_rust():
    assert names("rust", RUST) == [("Point", 5, 7), (None, 9, 11), ("alpha", 13, 13), ("Kind", 18, 18), ("Walk", 19, 19), ("Unit", 22, 22)]
    assert chunk_source("rust", RUST)[0].text.startswith("pub struct Point")


def test_rust_tests_are_left_out():
    source = '''pub fn kept() {}
#[cfg(test)]
mod tests { fn a() {} struct B; }
#[test]
// a comment does not end it
#[ignore]
fn gone() {}
#[tokio::test]
async fn gone_too() {}
#[cfg(feature = "test-utils")]
fn kept_2() {}
#[cfg(not(test))]
fn kept_3() {}
#[cfg(all(unix, not(test)))]
fn kept_4() {}
#[cfg(any(test, unix))]
fn gone_3() {}
#[bench]
fn gone_4() {}
struct Kept5 { a: u8 }
'''
    assert [n[0] for n in names("rust", source)] == ["kept", "kept_2", "kept_3", "kept_4", "Kept5"]


def test_only_gated_items_fall_back_to_windows():
    assert names("rust", "#[test]\nfn a() {}\n") == [(None, 1, 2)]


def test_python():
    source = "import os\n\n@deco\ndef alpha(x):\n    return x\n\nif x:\n    class Point:\n        def beta(self): pass\n\nasync def gamma(): pass\n"
    assert names("python", source) == [("alpha", 4, 5), ("Point", 8, 9), ("gamma", 11, 11)]
    assert names("python", "def broken(:\n") == [(None, 1, 1)]


def test_ecma():
    source = '''import x from "y";
export function alpha(x) { return `}${x}`; }
class Point { beta() { return /[}]/; } }
const a = 1, b = { c: [2] };
let late = () => {
  return 3;
}
var old;
foo(1);
export default class extends Q { named() {} }
'''
    assert [n[0] for n in names("javascript", source)] == ["alpha", "Point", None, None, None, "named"]
    typed = "export interface I { a: string }\nabstract class A { m(): void {} }\nfunction f<T>(x: T): T { return x }\nvar v = 1;\n"
    assert [n[0] for n in names("typescript", typed)] == ["I", "m", "f"]
    assert [n[0] for n in names("tsx", "export function Alpha(): any {\n  return <p>it's</p>;\n}\n")] == ["Alpha"]


def test_dispatch_and_lines():
    assert [(c.language, c.text) for c in chunk_source(None, "a\r\nb\n", 1)] == [("text", "a"), ("text", "b")]
    assert chunk_source("python", "") == [] and len(chunk_source("python", "\n\n")) == 1
    assert [language_for_path(p) for p in ("a.rs", "b.PY", "c.tsx", "d/e.jsx", "f.", "g")] == ["rust", None, "tsx", "javascript", None, None]


def test_pieces():
    source = "fn big() {\n" + "    x();\n" * 400 + "}\n"
    pieces, largest = chunks_for_embedding("a.rs", source, 512)
    assert largest <= 512 and "".join(p.text for p in pieces) == source.rstrip("\n") and {p.symbol for p in pieces} == {"big"}
    tagged = focus_pieces(chunk_source("rust", source + "fn small() {}\n"), 512)
    assert [t for _, t in tagged][-1] is False and all(t for _, t in tagged[:-1])
    assert chunks_for_embedding("empty.rs", "", 512) == ([], 0)


def test_as_operator(spark):
    df = spark.createDataFrame([("a.py", "def f():\n    pass\n", 1), ("b.md", "x\r\ny", 2), ("c.rs", "", 3), ("d.rs", None, 4), (None, "z", 5)], "path string, text string, start_line int")
    rows = chunked(df.drop("start_line")).collect()
    assert {(r["path"], r["language"], r["symbol"], r["text"]) for r in rows} == {("a.py", "python", "f", "def f():\n    pass"), ("b.md", "text", None, "x\ny"), (None, "text", None, "z")}
    assert [(r["path"], r["code"], r["why_matched"]) for r in outline(df).where("path = 'a.py'").collect()] == [("a.py", "def f():", "outline")]
    assert chunked(df.drop("start_line").limit(0)).count() == 0


def test_template_strings_that_hold_templates():
    nested = "const x = `x${`}`}` + `a ${ {b: '}'}[`c${\"`\"}`] /* ` */ } \\` \\${`;\n"
    source = nested + "export function alpha() {\n  return `${f({a: `)`})}`;\n}\n\nclass Point {\n  m() {}\n}\n"
    for language in ("javascript", "typescript"):
        assert [c.symbol for c in chunk_source(language, source)] == [None, "alpha", "Point"]  # a constant is a chunk without a symbol
        assert [c.symbol for c in chunk_source(language, source + "const y = `${")] == [None]
