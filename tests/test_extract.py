"""One small file for each language."""

import time

import pytest

from quarry.sources.crawl import EXTENSIONS
from quarry.sources.extract import extract_file
from quarry.sources.packs import PACKS, SCANNED, fidelity

CASES = {
    "go": ("package a\ntype (\n\tT struct {\n\t\tx int\n\t}\n)\ntype I interface {\n\tM(a int) int\n}\ntype A int\nvar v = 1\nconst c = 2\nfunc F() { if v > 0 { g(1) } }\nfunc (t *T) P() {}\n",
           {("T", "struct"), ("I", "iface"), ("M", "method"), ("A", "cls"), ("v", "var"), ("c", "var"), ("F", "fn"), ("P", "method")}, {"g"}),
    "java": ("import a.b.Cee;\nclass A {\n  static final int MAX_N = 1;\n  int low = 2;\n  A() { f(); }\n  int f() { return new a.B().go(); }\n}\ninterface I { void m(); }\nenum E { X }\n",
             {("A", "cls"), ("MAX_N", "var"), ("A", "method"), ("f", "method"), ("I", "iface"), ("m", "method"), ("E", "cls")}, {"Cee", "f", "B", "go"}),
    "c": ("#define N 3\nstruct S { int x; };\nenum E { A };\nstatic int v = 1;\nint f(int a) {\n  return g(a);\n}\n",
          {("N", "macro"), ("S", "cls"), ("E", "cls"), ("v", "var"), ("f", "fn"), ("x", "var")}, {"g"}),
    "cpp": ("class A {\n public:\n  int m(int q) { return 1; }\n};\nint A::n() { return h(2); }\nvoid f() { x.k(); }\n", {("A", "cls"), ("m", "method"), ("n", "method"), ("f", "fn")}, {"h", "k"}),
    "csharp": ("class A {\n  int P { get; set; }\n  public int M(int a) { return B(a); }\n}\nstruct S {}\ninterface I {}\n", {("A", "cls"), ("P", "var"), ("M", "method"), ("S", "struct"), ("I", "iface")}, {"B"}),
    "dart": ("class A {\n  int m() { return f(1); }\n}\nint f(int a) => a;\ntypedef T = int;\n", {("A", "cls"), ("m", "method"), ("f", "fn"), ("T", "cls")}, {"f"}),
    "elixir": ("defmodule A.B do\n  def f(x) do\n    x |> g()\n  end\nend\n", {("A.B", "cls"), ("f", "fn")}, {"g"}),
    "bash": ("f() {\n  g 1\n}\nfunction h {\n  f\n}\n", {("f", "fn"), ("h", "fn")}, {"g", "f"}),
    "javascript": ("class A {\n  m(x) {\n    return g(x);\n  }\n}\nfunction f() {}\nconst h = (x) => x;\nnew A();\n", {("A", "cls"), ("m", "method"), ("f", "fn"), ("h", "fn")}, {"g", "A"}),
    "typescript": ("interface I { a: int }\nenum E { A }\ntype T = string;\nclass A {\n  m(x: number): number {\n    return g(x);\n  }\n}\n", {("I", "iface"), ("E", "cls"), ("T", "cls"), ("A", "cls"), ("m", "method")}, {"g"}),
    "json": ('{"a": {"b": 1, "c": {"d": 2}}, "e": [{"f": 1}], "g": "x"}', {("a", "sec"), ("b", "sec"), ("c", "sec"), ("e", "sec"), ("g", "sec")}, set()),
    "toml": ('k = 1\n[t.u]\n"q" = [\n  "x = 1",\n]\n[[a]]\nz = """\nn = 1\n"""\n', {("k", "sec"), ("t.u", "sec"), ('"q"', "sec"), ("a", "sec"), ("z", "sec")}, set()),
    "yaml": ("a:\n  b: 1\n  c: |\n    not: key\nd: {e: 1}\n- f: 2\n", {("a", "sec"), ("b", "sec"), ("c", "sec"), ("d", "sec"), ("e", "sec"), ("f", "sec")}, set()),
    "html": ('<p class="x" id="y">a</p><!-- <p id="z"> -->', {("id", "sec")}, set()),
    "kotlin": ("import a.B\nclass A {\n  fun m(x: Int): Int { return g(x) }\n}\nobject O {}\n", {("A", "cls"), ("m", "fn"), ("O", "cls")}, {"B", "g"}),
    "lua": ("local function f(a)\n  if a then return g(a) end\nend\nfunction T:m() end\nT.h = function() end\n", {("f", "fn"), ("m", "method"), ("h", "fn")}, {"g"}),
    "objc": ("@interface A : B\n- (int)m:(int)x;\n@end\n@implementation A\n- (int)m:(int)x {\n  return [self go:x];\n}\n@end\n", {("A", "cls"), ("m", "method")}, {"go"}),
    "php": ("<?php\nclass A {\n  const X = 1;\n  function m() { return $this->g(); }\n}\nfunction f() {}\ninterface I {}\n", {("A", "cls"), ("X", "var"), ("m", "method"), ("f", "fn"), ("I", "iface")}, {"g"}),
    "python": ("X = 1\nif X:\n    Y = 2\nclass A:\n    z: int = 3\n    def m(self):\n        self.w = 1\n        return g(self.h())\n", {("X", "var"), ("Y", "var"), ("A", "cls"), ("z", "var"), ("m", "fn"), ("w", "var")}, {"g", "h"}),
    "ruby": ("module M\n  class A\n    MAX = 1\n    def m(x)\n      g(x)\n    end\n  end\nend\n", {("M", "cls"), ("A", "cls"), ("MAX", "var"), ("m", "method")}, {"g"}),
    "rust": ("struct S {}\ntrait T { fn q(&self); }\nconst N: i32 = 1;\nmacro_rules! mm { () => {} }\nfn f() { g(1); h!(2) }\n", {("S", "cls"), ("T", "iface"), ("q", "method"), ("N", "var"), ("mm", "macro"), ("f", "fn")}, {"g", "h"}),
    "swift": ("class A {\n  var v = 1\n  init() { }\n  func m() { g(1) }\n}\nprotocol P {}\n", {("A", "cls"), ("v", "var"), ("init", "method"), ("m", "fn"), ("P", "iface")}, {"g"}),
}
CASES["cuda"], CASES["tsx"] = CASES["c"], CASES["typescript"]


@pytest.mark.parametrize("lang", sorted(CASES))
def test_language(lang):
    src, defs, refs = CASES[lang]
    found = extract_file(lang, src.encode())
    got = {(d[0], d[1]) for d in found.defs}
    assert defs <= got, defs - got
    assert refs <= {r[0] for r in found.refs}
    data = src.encode()
    for name, start, end in found.refs:
        assert data[start:end].decode() == name
    for d in found.defs:
        assert 0 <= d[4] <= d[5] <= len(data) and d[2] == 1 + data[:d[4]].count(b"\n")


def test_every_language_has_a_pack():
    assert set(EXTENSIONS) == set(PACKS) | set(SCANNED) == set(CASES)
    assert all(fidelity(lang) in ("close", "heuristic") for lang in EXTENSIONS)


@pytest.mark.parametrize("src", [b"", b"\n", b"\xff\xfe{", b"{" * 5000, b'"unclosed\n/* x', b"def f(:\n", b"a: [1,\n{{"])
@pytest.mark.parametrize("lang", sorted(CASES))
def test_odd_sources(lang, src):
    extract_file(lang, src)


def test_complexity():
    found = extract_file("python", b"def f(x):\n    if x:\n        pass\n    elif x > 1:\n        pass\n    for i in x:\n        y = 1 if i else 2\n    return y\n")
    assert {d[0]: d[6] for d in found.defs}["f"] == 4
    found = extract_file("go", b"package a\nfunc F() {\n\tif a { }\n\tfor { switch b { case 1: } }\n\t// if for\n\ts := \"if\"\n}\n")
    assert {d[0]: d[6] for d in found.defs}["F"] == 4


def test_shapes_beyond_the_common_ones():
    kinds = lambda lang, src: {(d[0], d[1]) for d in extract_file(lang, src.encode()).defs}
    js = kinds("javascript", "const o = { run: function () { return 1 }, go: async (x) => x, n: 3 }\na.b.c = function () {}\nx.y = function () {}\np.q.r = (z) => z\n")
    assert {("run", "fn"), ("go", "fn"), ("c", "method"), ("r", "method")} <= js and not {"n", "y"} & {n for n, _ in js}
    cpp = kinds("cpp", "TEST_CASE(\"adds\", f(1)) {\n  int inner;\n}\n#if A\nint gated;\n#else\nlong *other[3];\n#endif\nint open;\nvoid k() { if (x) { y(); } }\n")
    assert {("TEST_CASE", "macro"), ("gated", "var"), ("other", "var")} <= cpp and not {"open", "if", "inner"} & {n for n, _ in cpp}
    ex = extract_file("elixir", b'defmodule T do\n  test "adds two", ctx do\n    g(1)\n  end\n  # test "no" do\nend\n')
    assert ("\"adds two\"", "fn") in {(d[0], d[1]) for d in ex.defs} and "\"no\"" not in {d[0] for d in ex.defs}
    assert [d[3] for d in ex.defs if d[0] == '"adds two"'] == [4]
    assert "init" in {r[0] for r in extract_file("objc", b"void f() {\n  ops->init(1);\n}\n").refs}


def test_python_with_syntax_errors():
    src = b"import os\ndef a(x):\n    return g(x)\n\ndef broken(:\n    y = h(1)\n\nclass C:\n    def m(self):\n        return )\n    def n(self):\n        pass\n"
    found = extract_file("python", src)
    assert {"a", "C", "m", "n"} <= {d[0] for d in found.defs} and {"g", "h"} <= {r[0] for r in found.refs}
    for name, start, end in found.refs:
        assert src[start:end].decode() == name
    many = b"".join(b"def f%d(:\n    pass\n" % i for i in range(200))
    assert {d[0] for d in extract_file("python", many).defs} >= {"f0", "f199"}


def test_extents_take_time_in_proportion():
    ruby = b"".join(b"def m%d\n  1\nend\n" % i for i in range(20_000))
    yaml = b"".join(b"k%d:\n  a: 1\n" % i for i in range(20_000))
    began = time.process_time()
    assert len(extract_file("ruby", ruby).defs) == 20_000 and len(extract_file("yaml", yaml).defs) == 40_000
    assert time.process_time() - began < 20
