"""Node extraction that survives broken code: one automaton over brackets, one over indents, with small tables for languages.

A text is read once, token by token (comments, strings, brackets, ends of statements); a stack holds the open blocks. A
statement that owns a block is a node, its children are the statements in the block. If brackets don't match, the text is
read once more with recovery: a line that begins like a definition, no deeper than the head of an open block, closes that block
before it. So a broken function costs its own end and no other node. Python goes by indents in the same way.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

from semindex.operators.chunking import Node


@dataclass(frozen=True)
class Language:
    comments: str  # regular expressions
    strings: str
    newline_ends: bool = False  # whether a line break may end a statement
    blocks: str = "{"
    separators: str = ";"
    every: bool = False  # whether each block is a seed, not only those of definitions
    tokens: re.Pattern = field(init=False)

    def __post_init__(self) -> None:
        ends = re.escape(self.separators)
        object.__setattr__(self, "tokens", re.compile(rf"(?P<comment>{self.comments})|(?P<string>{self.strings})|(?P<mark>[{{}}()\[\]{ends}]|\n)", re.S))


SLASHES = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
QUOTED = r'"(?:\\.|[^"\\\n])*(?:"|(?=\n|\Z))'
SINGLE = r"'(?:\\.|[^'\\\n])*(?:'|(?=\n|\Z))"
LETTER = r"'(?:\\[^\n']{1,9}|[^'\\\n])'"
TEMPLATE = r"`(?:\\.|[^`\\])*(?:`|\Z)"
C_LIKE = Language(SLASHES + r"|^[ \t]*#[^\n]*", rf"{QUOTED}|{LETTER}")
SCRIPT = Language(SLASHES, rf"{QUOTED}|{SINGLE}|{TEMPLATE}", newline_ends=True)
LINES = Language(SLASHES, rf'"""(?:.*?)(?:"""|\Z)|{QUOTED}|{LETTER}|{TEMPLATE}', newline_ends=True)
LANGUAGES: dict[str, Language] = {
    ".js": SCRIPT, ".jsx": SCRIPT, ".ts": SCRIPT, ".tsx": SCRIPT, ".go": LINES, ".kt": LINES, ".kts": LINES, ".zig": LINES,
    ".c": C_LIKE, ".h": C_LIKE, ".cpp": C_LIKE, ".hpp": C_LIKE, ".cs": C_LIKE, ".java": C_LIKE, ".rs": Language(SLASHES, rf"{QUOTED}|{LETTER}"), ".sol": C_LIKE,
    ".php": Language(SLASHES + r"|#[^\n]*", rf"{QUOTED}|{SINGLE}"), ".css": Language(r"/\*.*?(?:\*/|\Z)", rf"{QUOTED}|{SINGLE}", every=True),
    ".json": Language(r"(?!)", QUOTED, blocks="{[", separators=",", every=True),
}

#: A head that defines something, one that steers the flow, and a line that may only begin a definition.
DEFINES = re.compile(r"\b(?:class|interface|enum|struct|union|trait|impl|namespace|module|function|func|fn|fun|def|object|record|protocol|extension|type|mod|contract|library|modifier|constructor|package)\b|=>\s*\Z")
METHOD = re.compile(r"[\w>\]]\s*\([^;{}]*\)[^;={}]*\Z")
FLOW = re.compile(r"\s*(?:\}\s*)?(?:if|else|for|while|switch|catch|do|try|finally|return|with|synchronized|using|lock|foreach|select|match|loop|unsafe|case|default)\b")
HEADLINE = re.compile(
    r"(?:export|import|public|private|protected|internal|static|async|abstract|final|override|open|class|interface|enum|struct|union|trait|impl|pub|fn|func|fun|function|def|namespace|module|type|const|let|var|void|package|contract|template|@\w)\b|[\w.#*@:&>~+ \[\]=\"-]+\{\s*$"
)
PAIRS = {")": "(", "]": "[", "}": "{"}


class Open:
    """An open block: its bracket, its node, the brackets open in its present statement, where that began, blocks within it."""

    __slots__ = ("bracket", "raw", "inner", "begin", "pending", "indent")

    def __init__(self, bracket: str, raw: list, indent: int):
        self.bracket, self.raw, self.inner, self.begin, self.pending, self.indent = bracket, raw, [], None, [], indent


def block_tree(text: str, language: Language, recover: bool) -> tuple[list, bool]:
    """The tree over ``text``, as [begin, end, children, head or None], and whether all brackets matched."""
    root = [0, len(text), [], None]
    stack, sound, last, code = [Open("", root, -1)], True, 0, re.compile(r"\S")

    def indent_at(i: int) -> int:
        line = text.rfind("\n", 0, i) + 1
        return len(text[line:i]) - len(text[line:i].lstrip()) if text[line:i].strip() else i - line

    def end_statement(top: Open, end: int) -> None:
        """The present statement becomes a child, with the blocks in it; one that is a block is that block."""
        if top.begin is not None:
            if len(top.pending) == 1 and top.pending[0][0] == top.begin and top.pending[0][1] == end:
                top.raw[2].append(top.pending[0])
            elif text[top.begin : end].strip():
                top.raw[2].append([top.begin, end, top.pending, None])
        top.begin, top.pending, top.inner = None, [], []

    def close(end: int) -> None:
        done = stack.pop()
        end_statement(done, max(done.begin or 0, len(text[:end].rstrip()) if text[end - 1 : end] != done_bracket(done) else end - 1))
        done.raw[1] = end
        stack[-1].pending.append(done.raw)
        if not stack[-1].inner:  # the statement that owns the block ends with it
            end_statement(stack[-1], end)

    def done_bracket(block: Open) -> str:
        return "}" if block.bracket == "{" else "]"

    for token in language.tokens.finditer(text):
        a, kind, top = token.start(), token.lastgroup, stack[-1]
        if top.begin is None and (m := code.search(text, last, a)):
            top.begin = m.start()
        last = token.end()
        if kind == "comment":
            continue
        mark = token[0]
        if kind == "string":
            top.begin = a if top.begin is None else top.begin
        elif mark in "{[(" and mark not in language.blocks:
            top.begin = a if top.begin is None else top.begin
            top.inner.append(mark)
        elif mark in "{[(":
            if top.begin is None:
                before = top.raw[2][-1] if top.raw[2] else None
                if language.newline_ends and before is not None and before[3] is None and not before[2] and not text[before[1] : a].strip():
                    top.begin = top.raw[2].pop()[0]  # the head stands on the line above
                else:
                    top.begin = a
            raw = [top.begin, len(text), [], text[top.begin : a]]
            stack.append(Open(mark, raw, indent_at(top.begin)))
        elif mark in PAIRS:
            wanted = PAIRS[mark]
            if wanted in language.blocks:
                at = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].bracket == wanted), None)
                sound &= at == len(stack) - 1 and not top.inner
                while at is not None and len(stack) > at:
                    close(last if len(stack) == at + 1 else a)
            elif top.inner and top.inner[-1] == wanted:
                top.inner.pop()
            else:
                sound = False
        elif mark == "\n":
            if recover and len(stack) > 1 and (line := text[last : text.find("\n", last) if text.find("\n", last) >= 0 else len(text)]).strip():
                depth = len(line) - len(line.lstrip())
                at = next((i for i in range(1, len(stack)) if stack[i].indent >= depth), None)
                if at is not None and HEADLINE.match(line.lstrip()):
                    end = len(text[:a].rstrip())
                    while len(stack) > at:
                        close(end)
                    end_statement(stack[-1], end)
            elif language.newline_ends and not top.inner and top.begin is not None:
                end_statement(top, a)
        elif not top.inner:  # a separator
            end_statement(top, last if mark == ";" else a)
    end = len(text.rstrip())
    if stack[-1].begin is None and (m := code.search(text, last)):
        stack[-1].begin = m.start()
    sound &= len(stack) == 1 and not stack[0].inner
    while len(stack) > 1:
        close(end)
    end_statement(stack[0], end)
    return root, sound


def braced_nodes(text: str, language: Language) -> list[Node]:
    """Definitions of a text in a language of brackets; none if there are none."""
    tree, sound = block_tree(text, language, recover=False)
    if not sound:
        tree, _ = block_tree(text, language, recover=True)
    starts = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]
    row = lambda i: bisect_right(starts, i) - 1
    seeds: list[Node] = []
    made: dict[int, Node] = {}
    order = [tree]
    for raw in order:
        order.extend(raw[2])
    for raw in reversed(order):  # children before their parents
        begin, end = raw[0], max(raw[0], raw[1])
        made[id(raw)] = Node(row(begin), row(max(begin, end - 1)), (text, begin, end), [made[id(c)] for c in raw[2]])
    for raw in order[1:]:
        head = raw[3]
        if head is not None and (language.every or not FLOW.match(head) and (DEFINES.search(head) or METHOD.search(head))):
            seeds.append(made[id(raw)])
    return seeds


PY_TOKENS = re.compile(r"#[^\n]*|[rbufRBUF]{0,2}(?:\"\"\".*?(?:\"\"\"|\Z)|'''.*?(?:'''|\Z)|\"(?:\\.|[^\"\\\n])*\"?|'(?:\\.|[^'\\\n])*'?)|[()\[\]{}]|\\\n|\n", re.S)
PY_BLOCK = re.compile(r"(?:(?:async\s+)?def|class|with|try|for|while|if|elif|else|except|finally|async\s+(?:with|for)|match|case)\b.*:", re.S)
PY_SEED = re.compile(r"(?:async\s+)?def\s+\w+\s*[\[(]|class\s+\w+|with\b|try\s*:|for\b|while\b|if\b|elif\b")
PY_IMPORT = re.compile(r"import\s+[\w.]+(?:\s+as\s+\w+)?(?:\s*,\s*[\w.]+(?:\s+as\s+\w+)?)*\s*(?:#.*)?\Z|from\s+[.\w]+\s+import\b")
PY_NEXT = re.compile(r"(?:elif|else|except|finally)\b")
PY_HEADLINE = re.compile(r"(?:async\s+def|def|class|import|from|with|try|for|while|if|return|raise|@\w)\b")


def logical_lines(text: str, recover: bool) -> list[tuple[int, int, int]]:
    """(begin, end, indent) of each logical line that has code: brackets, triple quotes and back slashes carry a line on. With
    ``recover``, brackets that are still open before a line that begins like a statement, no deeper than theirs, are given up."""
    out, depth, begin, last = [], 0, None, 0
    code = re.compile(r"[^\s]")

    def finish(end: int) -> None:
        nonlocal begin
        if begin is not None:
            line = text.rfind("\n", 0, begin) + 1
            out.append((begin, len(text[:end].rstrip()) if end > begin else end, begin - line))
        begin = None

    for token in PY_TOKENS.finditer(text):
        a, mark = token.start(), token[0]
        if begin is None and (m := code.search(text, last, a)):
            begin = m.start()
        last = token.end()
        if mark[0] == "#" or mark[0] == "\\":
            if mark[0] == "#" and begin is not None and not depth:
                finish(a)
            continue
        if mark == "\n":
            if depth and recover and begin is not None:
                line = text[last : text.find("\n", last) if text.find("\n", last) >= 0 else len(text)]
                own = begin - (text.rfind("\n", 0, begin) + 1)
                if line.strip() and len(line) - len(line.lstrip()) <= own and PY_HEADLINE.match(line.lstrip()):
                    depth = 0
            if not depth:
                finish(a)
        elif mark in "([{":
            begin, depth = a if begin is None else begin, depth + 1
        elif mark in ")]}":
            begin, depth = a if begin is None else begin, max(0, depth - 1)
        elif begin is None:
            begin = a
    if begin is None and (m := code.search(text, last)):
        begin = m.start()
    finish(len(text))
    return out


def indented_nodes(text: str, recover: bool = True) -> list[Node]:
    """Definitions, imports and block statements of a Python text, by indents alone; decorators stand before the node, as ast has it."""
    lines = logical_lines(text, recover)
    starts = [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]
    row = lambda i: bisect_right(starts, i) - 1
    ends = [end for _, end, _ in lines]
    head = [text[a:b] for a, b, _ in lines]
    blocks = [bool(PY_BLOCK.match(h)) for h in head]
    n = len(lines)
    reach = list(range(n))  # the last line of each statement
    open_at: list[int] = []  # block statements that may go on
    for i, (_, _, indent) in enumerate(lines):
        goes_on = PY_NEXT.match(head[i])
        while open_at and (lines[open_at[-1]][2] > indent or lines[open_at[-1]][2] == indent and not goes_on):
            open_at.pop()
        for j in open_at:
            reach[j] = i
        if blocks[i]:
            open_at.append(i)
    made: list[Node] = []
    for i, (a, _, _) in enumerate(lines):
        end = max(a, ends[reach[i]])
        made.append(Node(row(a), row(max(a, end - 1)), (text, a, end)))
    stack: list[int] = []
    for i in range(n):
        while stack and reach[stack[-1]] < i:
            stack.pop()
        if stack:
            made[stack[-1]].children.append(made[i])
        if reach[i] > i:
            stack.append(i)
    seed = lambda h, block: PY_SEED.match(h) and block or PY_IMPORT.match(h)
    return [made[i] for i in range(n) if seed(head[i], blocks[i])]
