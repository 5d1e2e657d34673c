"""Structural chunks of brace languages."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkloft.operators import code_blocks
from sparkloft.operators.chunking import CHARS, LINES, split_code

GO = '''package main

// Server {
type Server struct {
\tname string
}

func (s *Server) Run(x int) error {
\tif x > 0 {
\t\tlog("}")
\t}
\treturn nil
}

func helper() string { return `{
}` }
'''
JAVA = '''@Service
public class Box<T> extends Base {
    private final char open = '{';

    @Override
    public List<String> names(int a,
                              int b) throws IOException {
        for (int i = 0; i < a; i++) { go(i); }
        return null;
    }

    interface Inner { void call(); }
}
'''
RUST = '''#[derive(Debug)]
pub struct Point<'a> { x: &'a str }

impl<'a> Display for Point<'a> {
    fn fmt(&self, f: &mut Formatter) -> Result {
        let s = r#"{"{"#;
        match s { _ => Ok(()) }
    }
}

pub trait Shape { fn area(&self) -> f64; }
'''
TS = '''export class Cart {
  total(x: number): number {
    return `${x} {`.length;
  }
}
export const add = (a: number) => {
  return a;
};
async function load(url) {
  while (true) { break; }
}
'''


@pytest.mark.parametrize(
    "text,language,want",
    [
        (GO, "go", [("Server", "struct", 4, 6), ("Run", "method", 8, 13), ("helper", "function", 15, 16)]),
        (JAVA, "java", [("Box", "class", 2, 13), ("names", "method", 6, 10), ("Inner", "interface", 12, 12)]),
        (RUST, "rust", [("Point", "struct", 2, 2), ("Point", "impl", 4, 9), ("fmt", "method", 5, 8), ("Shape", "trait", 11, 11)] ),
        (TS, "typescript", [("Cart", "class", 1, 5), ("total", "method", 2, 4), ("add", "function", 6, 8), ("load", "function", 9, 11)]),
    ],
)
def test_symbols(text, language, want):
    assert [tuple(s) for s in code_blocks.symbols(text, language)] == want


def test_blocks_stay_whole():
    one = "/** {\n * doc\n */\nint f%d() {\n" + "  g();\n" * 20 + "}\n"
    text = "".join(one % k for k in range(5)) + "int big() {\n" + "  if (x) {\n    y();\n  }\n" * 30 + "}\nint tail;"
    got = code_blocks.split_blocks(text, "c", LINES, CHARS)
    assert [(a, b) for a, b, _ in got[:5]] == [(1 + 25 * k, 25 + 25 * k) for k in range(5)]
    assert got[5][0] == 126 and got[5][2].count("{") == got[5][2].count("}") + 1  # the header and whole inner blocks
    for _, _, t in got[6:-1]:
        assert t.strip().startswith("if") or t.strip() == "}"
    assert got[-1][2] == "int tail;"
    assert "\n".join(t for _, _, t in got) == text


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(['{', '}', '\n', '\n', '"', "'", "`", "/*", "*/", "//", "\\", "fn a(", ")", " ", ";", "@x", "#[y]", "class B", "long " * 40]), max_size=150), st.sampled_from(code_blocks.BRACES))
def test_every_line_once(parts, language):
    text = "".join(parts)
    assert len(code_blocks.masked(text, language)) == len(text)
    chunks = code_blocks.split_blocks(text, language, 6, 120)
    rows = text.split("\n")
    held = [i for a, b, _ in chunks for i in range(a, b + 1)]
    assert held == sorted(set(held))
    if chunks:
        assert all(not rows[i - 1].strip() for i in set(range(1, len(rows) + 1)) - set(held))
    for a, b, t in chunks:
        assert t == "\n".join(rows[a - 1 : b])
        assert a == b or b - a < 6 and len(t) <= 120
    for s in code_blocks.symbols(text, language):
        assert 1 <= s.first <= s.last <= len(rows)


@pytest.mark.parametrize(
    "unit", ["{\n", "}\n", '"', "`", "/*", "fn a(", "class ", "a b c d e f ", "x(\n", "'\\'", "fn a {\n", "{" * 50 + "\n", '"\\"', "int f(int a,\n", "const a = (", "@x(", " ", "\n"]
)
def test_hostile_text_takes_linear_time(unit):
    text = unit * (200_000 // len(unit))
    for language in ("rust", "typescript", "java", "go"):
        at = time.process_time()
        code_blocks.split_blocks(text, language, LINES, CHARS)
        code_blocks.symbols(text, language)
        assert time.process_time() - at < 5, (unit, language)


def test_without_blocks(spark):
    from sparkloft.operators.chunking import chunk_files

    text = "\n".join(f"line {k}" for k in range(60))
    assert code_blocks.split_blocks(text, "go", LINES, CHARS) == []
    rows = [("a.go", text, "code", "go"), ("b.rs", None, "code", "rust"), ("c.ts", "", "code", "typescript"), ("d.go", GO, "code", "go")]
    got = chunk_files(spark.createDataFrame(rows, "source string, text string, source_type string, language string")).collect()
    assert [(r["start_line"], r["end_line"]) for r in got if r["source"] == "a.go"] == [(a, b) for a, b, _ in split_code(text)]
    assert [(r["symbol_name"], r["symbol_kind"], r["text"]) for r in got if r["source"] == "d.go"] == [("helper", "function", GO)]
    assert {r["source"] for r in got} == {"a.go", "d.go"}
