"""Extraction from brackets and indents, sound and broken."""

import ast
import glob
import sysconfig

import pytest

from semindex.operators import chunking
from semindex.operators.nodes import LANGUAGES, braced_nodes, indented_nodes

GOOD = """import { x } from "y"; // { not a block
/* function ghost() { */
export class Über extends Base {
  private a = "}";
  method(b: number): string {
    if (b > 1) { return `{${b}`; }
    return items.map((i) => { return i * 2; }).join("{");
  }
  get other() { return 1 }
}
interface Shape { area(): number; }
function last(x)
{
  const re = { a: [1, 2], b: 'it\\'s' };
  return x;
}
"""


def heads(nodes):
    return [n.text.split("\n")[0].strip() for n in nodes]


def test_definitions_of_a_script():
    nodes = braced_nodes(GOOD, LANGUAGES[".ts"])
    assert set(heads(nodes)) >= {"export class Über extends Base {", "method(b: number): string {", "get other() { return 1 }", "interface Shape { area(): number; }", "function last(x)"}
    assert not any("ghost" in h for h in heads(nodes))
    lines = GOOD.split("\n")
    for n in nodes:
        got = n.text.split("\n")
        assert len(got) == n.end - n.start + 1 and lines[n.start].endswith(got[0]) or lines[n.start].find(got[0]) >= 0
    whole = next(n for n in nodes if n.text.startswith("export class"))
    assert (whole.start, whole.end) == (2, 9) and {c.text.split("(")[0] for c in whole.children} >= {"method"}


@pytest.mark.parametrize("broken", ["function bad(x) {\n  if (x) {\n  return 1;\n", "function bad(x) {\n  foo(bar[1;\n}\n", "function bad(x) {\n  return 1; }\n}\n", 'function bad(x) {\n  s = "open {;\n'])
def test_a_broken_function_keeps_all_others(broken):
    good = [f"function f{i}(a) {{\n  return [a, {{ b: {i} }}];\n}}\n" for i in range(4)]
    want = {g.strip() for g in good}
    nodes = braced_nodes("".join([*good[:2], broken, *good[2:]]), LANGUAGES[".js"])
    assert want <= {n.text for n in nodes} and any(n.text.startswith("function bad") for n in nodes)


def test_other_languages():
    rust = "impl<'a> A<'a> {\n    fn f(&'a self, c: char) -> bool { c == '{' }\n}\nstruct B { x: u8 }\n"
    assert {h.split("{")[0].strip() for h in heads(braced_nodes(rust, LANGUAGES[".rs"]))} == {"impl<'a> A<'a>", "fn f(&'a self, c: char) -> bool", "struct B"}
    java = "package p;\n@A(\"{\")\npublic class X {\n  @Override\n  public int f(int a)\n      throws E {\n    for (;;) { a++; }\n  }\n}\n"
    assert {(n.start, n.end) for n in braced_nodes(java, LANGUAGES[".java"])} == {(1, 8), (3, 7)}
    go = "package m\n\nfunc F(a int) {\n\tx := []int{1}\n\tgo func() { y() }()\n}\n\ntype T struct {\n\tA int\n}\n"
    assert {(n.start, n.end) for n in braced_nodes(go, LANGUAGES[".go"])} >= {(2, 5), (7, 9)}
    css = "a:hover { color: red; }\n@media x {\n  b { c: d }\n}\n"
    assert {(n.start, n.end) for n in braced_nodes(css, LANGUAGES[".css"])} == {(0, 0), (1, 3), (2, 2)}
    data = '{\n "a": {"b": [1, 2, {"c": "}"}]},\n "d": 3\n}'
    assert {n.text for n in braced_nodes(data, LANGUAGES[".json"])} == {data, '"a": {"b": [1, 2, {"c": "}"}]}', '"b": [1, 2, {"c": "}"}]', '{"c": "}"}'}
    for text in ("", "}}}", "{{{", "plain prose, with (brackets) and { more }", '"', "'", "`", "/*"):
        for language in LANGUAGES.values():
            assert all(isinstance(n.text, str) for n in braced_nodes(text, language))


def by_ast(text):
    """Ranges of what the extraction is to find, multi-line strings and semicolons as ast has them."""
    return {(n.lineno - 1, n.end_lineno - 1, n.col_offset) for n in ast.walk(ast.parse(text)) if isinstance(n, chunking.PYTHON_SEEDS)}


def test_indents_agree_with_ast_on_the_standard_library():
    files = sorted(glob.glob(sysconfig.get_paths()["stdlib"] + "/*.py"))[:120]
    agreed = wanted = 0
    for name in files:
        text = open(name, encoding="utf-8", errors="replace").read()
        if "\t" in text or "\f" in text or "; import" in text:
            continue
        want = by_ast(text)
        lines = text.split("\n")
        got = {(n.start, n.end) for n in indented_nodes(text, recover=False)}
        wanted += len(want)
        agreed += sum((a, b) in got for a, b, _ in want)
        assert len(got) <= len({x[:2] for x in want}) * 1.02 + 3, name
        assert len(lines) > 0
    assert wanted > 10_000 and agreed >= 0.995 * wanted


@pytest.mark.parametrize("broken", ["def bad(x:\n    return (1\n", "def bad(x):\n    y = [1, 2\n    return y\n", "class Bad(\n    a = 1\n", "def bad(x)\n    return 1\n"])
def test_broken_python_keeps_all_others(broken):
    good = [f"def f{i}(a):\n    if a:\n        return [a,\n            {i}]\n" for i in range(3)] + ["class C:\n    def m(self):\n        pass\n"]
    text = good[0] + broken + "".join(good[1:])
    with pytest.raises(SyntaxError):
        ast.parse(text)
    texts = {n.text for n in chunking.python_nodes(text)}
    assert {g.strip() for g in good} <= texts and "def m(self):\n        pass" in texts


@pytest.mark.parametrize("odd", ["Wh " * 2600, "if x:\n    y = a" + ".b" * 2000 + "\n", "import a\rimport b\nif x:\n    y = 1\n"])
def test_python_that_the_parser_cannot_take_goes_by_indents(odd):
    """The parser runs out of its stack (a MemoryError), the tree is too deep, lines end where no row does."""
    as_rows = lambda nodes: [(n.start, n.end, n.text) for n in nodes]
    assert as_rows(chunking.python_nodes(odd)) == as_rows(indented_nodes(odd))
