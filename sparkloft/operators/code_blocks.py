"""Code of brace languages into chunks at block borders, and the declarations in it."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

# The languages whose blocks are braces, and the words that begin a declaration of a named block.
BRACES = ("c", "cpp", "csharp", "go", "java", "javascript", "kotlin", "php", "rust", "scala", "swift", "typescript")
_KINDS = {
    "class": "class", "struct": "struct", "interface": "interface", "enum": "enum", "trait": "trait", "impl": "impl", "record": "record",
    "object": "object", "protocol": "protocol", "mod": "module", "namespace": "namespace", "fn": "function", "func": "function", "fun": "function",
    "function": "function", "def": "function"
}
_NOT_NAMES = frozenset("if for while switch catch return else do try new throw await match loop sizeof using lock foreach synchronized super this when".split())

DEPTH = 64  # blocks nested deeper than this are cut by lines

_QUOTED = r'"""[\s\S]*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?'
_COMMENT = r"/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*"
_BACKTICKS = r"`(?:\\[\s\S]|[^`\\])*(?:`|\Z)"
_CHAR = r"'(?:\\[^\n]{1,9}?|[^'\\\n])'"
_SINGLE = r"'(?:\\.|[^'\\\n])*'?"
_RAW = r'r(?<=\br)(#+)"[\s\S]*?(?:"\1|\Z)'
_HIDDEN = {
    "go": rf"{_COMMENT}|`[^`]*(?:`|\Z)|{_QUOTED}|{_CHAR}", "rust": rf"{_COMMENT}|{_RAW}|{_QUOTED}|{_CHAR}", "javascript": rf"{_COMMENT}|{_BACKTICKS}|{_QUOTED}|{_SINGLE}",
    "typescript": rf"{_COMMENT}|{_BACKTICKS}|{_QUOTED}|{_SINGLE}", "php": rf"{_COMMENT}|#(?!\[)[^\n]*|{_QUOTED}|{_SINGLE}",
    "csharp": rf'{_COMMENT}|@"(?:[^"]|"")*(?:"|\Z)|{_QUOTED}|{_CHAR}'
}
_PATTERNS = {lang: re.compile(_HIDDEN.get(lang, f"{_COMMENT}|{_QUOTED}|{_CHAR}")) for lang in BRACES}

_NAMED = re.compile(
    r"^[ \t]*(?:[\w@.]+(?:\([^()\n]*\))?[ \t]+){0,6}?(?P<word>" + "|".join(_KINDS) + r")\b[ \t]*(?:<[^<>{}\n]*>[ \t]*)?(?P<receiver>\([^()\n]*\)[ \t]*)?(?:[\w:<>, &']+[ \t]for[ \t]+)?\*?(?P<name>[A-Za-z_$][\w$]*)",
    re.M,
)
_WORDS = re.compile("|".join(sorted(_KINDS, key=len, reverse=True)))
_BRACE = re.compile(r"[{}]")
_TYPE = re.compile(r"^[ \t]*type[ \t]+(?P<name>\w+)[^\n{}]*?[ \t](?P<word>struct|interface)\b", re.M)
_ARROW = re.compile(r"^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<name>[\w$]+)[^\n=]*=[ \t]*(?:async[ \t]+)?(?:function\b|\([^()\n]*\)[^\n=]*=>|[\w$]+[ \t]*=>)", re.M)
_CALLED = re.compile(r"^[ \t]*(?:[\w<>\[\],.?&*:]+[ \t]+){0,6}?[*&]?(?P<name>[A-Za-z_$~][\w$]*)[ \t]*\([^(){};]*\)[^;{}=\n]*\{", re.M)


class Symbol(NamedTuple):
    name: str
    kind: str
    first: int  # lines count from 1
    last: int


def masked(text: str, language: str) -> str:
    """The text with comments and quoted text as spaces; lines and places stay. A quote left open ends with its line."""
    return _PATTERNS[language].sub(_blank, text)


def _blank(m: re.Match) -> str:
    hidden = m[0]
    return "\n".join([" " * len(x) for x in hidden.split("\n")]) if "\n" in hidden else " " * len(hidden)


def depths(code: str) -> list[int]:
    """Open braces at the end of each line; a closing brace too many counts as none."""
    out, depth = [], 0
    for line in code.split("\n"):
        closing = line.count("}")
        if not closing:
            depth += line.count("{")
        else:
            for c in _BRACE.findall(line):
                depth = depth + 1 if c == "{" else max(depth - 1, 0)
        out.append(depth)
    return out


def _named(code: str) -> Iterator[re.Match]:
    """The matches of ``_NAMED``, which lie within a line: only lines with one of its words are tried."""
    tried = -1
    for m in _WORDS.finditer(code):
        begin = code.rfind("\n", 0, m.start()) + 1
        if begin != tried:
            tried = begin
            if found := _NAMED.match(code, begin):
                yield found


def symbols(text: str, language: str, code: str | None = None) -> list[Symbol]:
    """Named declarations with a block (or ended by a semicolon), in the order of their lines; functions inside a type are methods.

    ``code``: the masked text, where the caller has it.
    """
    code = masked(text, language) if code is None else code
    ends: dict[int, int] = {}  # of each opening brace, the line of its closing one
    line, stack = 1, []
    borders = []  # places of braces and semicolons
    for m in re.finditer(r"[{};\n]", code):
        c, at = m[0], m.start()
        if c == "\n":
            line += 1
            continue
        borders.append(at)
        if c == "{":
            stack.append(at)
        elif c == "}" and stack:
            ends[stack.pop()] = line
    ends.update(dict.fromkeys(stack, line))
    starts = [0] + [m.end() for m in re.finditer("\n", code)]
    found: dict[int, tuple[str, str, int]] = {}
    patterns = [_NAMED, _CALLED] + ([_TYPE] if language == "go" else []) + ([_ARROW] if language in ("javascript", "typescript") else [])
    for pattern in patterns:
        for m in _named(code) if pattern is _NAMED else pattern.finditer(code):
            words = m.groupdict()
            first = code[m.start() : m.start("word" if words.get("word") else "name")]
            if words["name"] in _NOT_NAMES or pattern is _CALLED and words["name"] in _KINDS or set(re.findall(r"\w+", first)) & _NOT_NAMES:
                continue
            kind = "method" if words.get("receiver") else _KINDS.get(words.get("word") or "", "function")
            found.setdefault(m.start("name"), (words["name"], kind, m.start() + len(first) - len(first.lstrip())))
    out = []
    for at, (name, kind, begin) in sorted(found.items()):
        b = bisect_left(borders, at)
        first = bisect_right(starts, begin)
        last = ends[borders[b]] if b < len(borders) and code[borders[b]] == "{" else bisect_right(starts, at)
        out.append(Symbol(name, kind, first, max(first, last)))
    return _methods(out)


def _methods(rows: list[Symbol]) -> list[Symbol]:
    out, around = [], []
    for s in sorted(rows, key=lambda s: (s.first, -s.last)):
        while around and around[-1].last < s.first:
            around.pop()
        inside = around and around[-1].kind not in ("function", "method", "namespace", "module")
        s = s._replace(kind="method") if inside and s.kind == "function" else s
        out.append(s)
        around.append(s)
    return out


def _items(ends: list[int], begin: int, end: int, level: int, leads: list[bool]) -> list[tuple[int, int]]:
    """Pieces of the lines [begin, end) that end where no block above ``level`` is open; comments and annotations go with what follows."""
    out, at = [], begin
    for i in range(begin, end):
        if ends[i] <= level and not leads[i] or i == end - 1:
            out.append((at, i + 1))
            at = i + 1
    return out


def _leads(rows: list[str], code: list[str], ends: list[int]) -> list[bool]:
    """Lines of comments, annotations and quoted text, which stay with the line after them."""
    out = []
    for i, (r, c) in enumerate(zip(rows, code, strict=True)):
        flat, said = ends[i] == (ends[i - 1] if i else 0), c.lstrip()
        out.append(flat and (said.startswith(("@", "#[")) if said else bool(r.strip())))
    return out


def split_blocks(text: str, language: str, lines: int, chars: int, code: str | None = None) -> list[tuple[int, int, str]]:
    """(first line, last line, text): neighbouring whole blocks together up to ``lines`` and ``chars``; none where the text has no block.

    A block that is larger by itself is taken apart at the blocks in it, and so on, and shares no chunk with its neighbours; what has no
    blocks is cut by lines. Every line is in exactly one chunk, but for chunks of blank lines, which are dropped. A longer line is
    a chunk by itself. ``code``: the masked text, where the caller has it.
    """
    rows, code = text.split("\n"), masked(text, language) if code is None else code
    ends = depths(code)
    if not any(ends):
        return []
    leads = _leads(rows, code.split("\n"), ends)
    sizes = [0]
    for r in rows:
        sizes.append(sizes[-1] + len(r) + 1)

    def fits(a: int, b: int) -> bool:
        return b - a <= lines and sizes[b] - sizes[a] - 1 <= chars

    pieces: list[tuple[int, int, int]] = []  # first line, line after the last, whose block: pieces meet in a chunk within it only
    block = 0
    for first, last in _items(ends, 0, len(rows), 0, leads):
        block += 2 * (not fits(first, last))
        todo = [(first, last, 0)]
        while todo:
            a, b, nested = todo.pop()
            if fits(a, b) or b - a == 1:
                pieces.append((a, b, block))
                continue
            level = min((ends[i] for i in range(a, b - 1) if not leads[i]), default=0)
            parts = _items(ends, a, b, level, leads) if nested < DEPTH else []
            if len(parts) < 2:  # no border inside
                parts = [(i, i + 1) for i in range(a, b)]
            todo += [(x, y, nested + 1) for x, y in reversed(parts)]
        block += not fits(first, last)
    out, at = [], 0
    while at < len(pieces):
        a, b, block = pieces[at]
        at += 1
        while at < len(pieces) and pieces[at][2] == block and fits(a, pieces[at][1]):
            b = pieces[at][1]
            at += 1
        body = "\n".join(rows[a:b])
        if body.strip():
            out.append((a + 1, b, body))
    return out
