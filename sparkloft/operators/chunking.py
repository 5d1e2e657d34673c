"""Texts and code into chunks, by Arrow batches; the splitters are own ones with the documented sizes."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloft.functions.text import chunk_id
from sparkloft.operators import code_blocks

SIZE, OVERLAP = 512, 50  # tokens of about four characters
LINES, LINE_OVERLAP, CHARS = 40, 15, 1500
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n{2,}")


def _tokens(text: str) -> int:
    return -(-len(text) // 4)


def split_text(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[str]:
    """Whole sentences up to ``size`` tokens; the next chunk begins with the last sentences of up to ``overlap``. Longer sentences are cut at words."""
    units: list[str] = []
    for sentence in _SENTENCE.split(text):
        while _tokens(sentence) > size:
            cut = sentence.rfind(" ", 0, size * 4)
            cut = cut if cut > 0 else size * 4
            units.append(sentence[:cut])
            sentence = sentence[cut:].lstrip()
        if sentence.strip():
            units.append(sentence.strip())
    out, now, fresh = [], [], False
    for u in units:
        if now and _tokens(" ".join([*now, u])) > size:
            if fresh:
                out.append(" ".join(now))
            kept: list[str] = []
            for x in reversed(now):
                if _tokens(" ".join([x, *kept])) > overlap:
                    break
                kept.insert(0, x)
            now = kept if _tokens(" ".join([*kept, u])) <= size else []
        now.append(u)
        fresh = True
    if now and fresh:
        out.append(" ".join(now))
    return out


def split_code(text: str, lines: int = LINES, overlap: int = LINE_OVERLAP, chars: int = CHARS) -> list[tuple[int, int, str]]:
    """(first line, last line, text): windows of lines, shorter where they would pass ``chars``."""
    rows, out, at = text.split("\n"), [], 0
    while at < len(rows):
        to = at + 1
        while to < len(rows) and to - at < lines and len("\n".join(rows[at : to + 1])) <= chars:
            to += 1
        body = "\n".join(rows[at:to])
        if body.strip():
            out.append((at + 1, to, body))
        if to >= len(rows):
            break
        at = max(at + 1, to - overlap)
    return out


def python_symbols(text: str) -> list[tuple[str, str, int, int]]:
    """(name, kind, first line, last line) of functions, methods and classes; none where the text does not parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out = []

    def walk(node, prefix: str, in_class: bool) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{prefix}{x.name}"
                kind = "class" if isinstance(x, ast.ClassDef) else "method" if in_class else "function"
                out.append((name, kind, x.lineno, x.end_lineno or x.lineno))
                walk(x, name + ".", isinstance(x, ast.ClassDef))
            else:
                walk(x, prefix, in_class)

    walk(tree, "", False)
    return out


def symbol_of(symbols: list[tuple[str, str, int, int]], first: int, last: int):
    """The symbol that starts last within the lines, else the last started one that overlaps them."""
    inside = [s for s in symbols if first <= s[2] <= last]
    over = [s for s in symbols if s[2] <= last and s[3] >= first]
    return max(inside or over, key=lambda s: s[2], default=None)


def chunk_files(files: DataFrame) -> DataFrame:
    """(source, chunk_index, total_chunks, text, start_line, end_line, symbol_name, symbol_kind, chunk_id) of files (source, text, source_type, language).

    Code of brace languages is cut at block borders, other code and code without a block in windows of lines.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for source, text, kind, lang in zip(pdf["source"], pdf["text"], pdf["source_type"], pdf["language"], strict=True):
                if kind == "code":
                    parts, symbols = [], python_symbols(text or "") if lang == "python" else []
                    if lang in code_blocks.BRACES:
                        code = code_blocks.masked(text or "", lang)
                        parts, symbols = code_blocks.split_blocks(text or "", lang, LINES, CHARS, code), code_blocks.symbols(text or "", lang, code)
                    parts = [(t, a, b, symbol_of(symbols, a, b)) for a, b, t in parts or split_code(text or "")]
                else:
                    parts = [(t, None, None, None) for t in split_text(text or "")]
                out += [(source, i, len(parts), t, a, b, s and s[0], s and s[1]) for i, (t, a, b, s) in enumerate(parts)]
            frame = pd.DataFrame(
                out, columns=["source", "chunk_index", "total_chunks", "text", "start_line", "end_line", "symbol_name", "symbol_kind"]
            )
            yield frame.astype({"start_line": "Int64", "end_line": "Int64"})

    schema = "source string, chunk_index int, total_chunks int, text string, start_line int, end_line int, symbol_name string, symbol_kind string"
    rows = files.select("source", "text", "source_type", "language").mapInPandas(run, schema)
    return rows.withColumn("chunk_id", chunk_id(F.col("source"), F.col("chunk_index")))
