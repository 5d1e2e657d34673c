"""Files as DataFrames: scans, presets, ignore rules, language detection."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import chain
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloft.functions.text import glob_to_regex, html_text, minified

# Known extensions by language, and presets.
LANGUAGE_EXTENSIONS = {
    "python": ["py", "pyw", "pyi"],
    "typescript": ["ts", "tsx"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "kotlin": ["kt", "kts"],
    "c": ["c", "h"],
    "cpp": ["cpp", "cc", "cxx", "hpp", "hxx"],
    "java": ["java"],
    "go": ["go"],
    "rust": ["rs"],
    "swift": ["swift"],
    "csharp": ["cs", "csx"],
    "pascal": ["pas", "pp", "lpr", "dpr", "dpk"],
}
DOCUMENT_EXTENSIONS = ["txt", "md", "pdf", "html", "rst"]
PRESETS = {
    "python": ["py", "pyi", "pyw"],
    "javascript": ["js", "jsx", "mjs", "cjs"],
    "typescript": ["ts", "tsx"],
    "go": ["go"],
    "rust": ["rs"],
    "java": ["java"],
    "csharp": ["cs"],
    "pascal": ["pas", "pp", "lpr", "dpr", "dpk"],
    "object-pascal": ["pas", "pp", "lpr", "dpr", "dpk"],
    "c": ["c", "h"],
    "cpp": ["cpp", "hpp", "cc", "hh"],
    "web": ["html", "css", "scss", "jsx", "tsx"],
    "docs": ["md", "txt", "rst", "pdf"],
    "text": ["md", "txt", "rst"],
    "pdf": ["pdf"],
}
PRESETS["code"] = [e for name in ("python", "javascript", "typescript", "go", "rust", "java", "csharp", "pascal", "c", "cpp") for e in PRESETS[name]]

# How lines of a language look that hardly any other language writes so: the openings and ends of lines that tell it.
TELLING_LINES = {
    "python": r"(?:def|async def) .*\)(?: -> .*)?:$|(?:class|elif|except|with) .*:$|from [\w.]+ import .+|self\.\w+ = .+|if __name__ == .*",
    "javascript": r"(?:const|let) [\w{}\[\], ]+ = (?:.*=> ?\{|require\(.*\);?|async .*)$|module\.exports\b.*|(?:export default|async) function\b.*|console\.log\(.*|\}\)?;? ?// .*",
    "typescript": r"(?:export )?(?:interface \w+|type \w+ = .+|enum \w+|declare \w+).*|(?:private|public|readonly) \w+\??: .+;|(?:const|let) \w+: .+ = .+|.*\) ?: (?:void|Promise<.*) \{$",
    "java": r"import (?:static )?(?:java|javax|org|com)\.[\w.*]+;|@(?:Override|Deprecated|Test)$|(?:public|protected|private) (?:static |final )*(?:class|interface|void|[A-Z]\w*) .*\{$|System\.out\.print.*",
    "kotlin": r"(?:(?:private|override|suspend|internal) )*fun .*[{=].*|(?:data|sealed|open) class .*|va[lr] \w+(?:: \w+\??)? (?:=|by) .+|companion object.*",
    "cpp": r"(?:template ?<.*|namespace \w+ ?\{|using namespace \w+;|std::.*;|#include <(?:\w+)>|(?:virtual|explicit) .*;|.*\bcout ?<<.*)",
    "c": r"#include <\w+\.h>|#define \w+.*|#ifn?def \w+|typedef struct.*|(?:static |unsigned )*(?:int|void|char|size_t) \*?\w+\([^)]*\)(?: ?\{|;)?$|(?:printf|free|memcpy)\(.*\);",
    "go": r"package \w+$|func (?:\(\w+ \*?\w+\) )?\w+\(.*\{$|import \($|type \w+ (?:struct|interface) ?\{|.* := .*|defer .+|if err != nil \{",
    "rust": r"(?:pub )?(?:fn \w+.*\{|struct \w+.*|enum \w+.*|mod \w+;)$|use [\w:]+(?:::\{.*\})?;|let mut .*;|impl(?:<.*>)? .*\{|#\[\w+.*\]|match .*\{|println!\(.*",
    "swift": r"import (?:Foundation|UIKit|SwiftUI)|(?:public |private |override )*func \w+\(.*\{$|guard .* else \{.*|if let .*\{|(?:struct|class|enum|extension) \w+: .*\{|@\w+ (?:var|struct) .*",
    "csharp": r"using (?:static )?System(?:\.\w+)*;|namespace [\w.]+(?: ?\{|;)?|.*\{ get;.*\}.*|(?:public|internal|private) (?:static |sealed |partial |async |override )*(?:class|record|struct|Task|string|bool) .*|\[\w+(?:\(.*\))?\]$",
    "pascal": r"(?i:(?:unit|program|library|uses) .+;|(?:procedure|function) \w+.*;|begin|end[.;]|(?:interface|implementation|var|const)|\w+ := .+;)",
}
TELLING_SHARE = 0.05
PRUNED = ("node_modules", "__pycache__", ".venv", "venv", ".git", "dist", "build", "target", ".tox", ".mypy_cache", ".pytest_cache")


def preset_globs(names: Iterable[str]) -> list[str]:
    """Globs of presets, first mention first, each once."""
    unknown = [n for n in names if n not in PRESETS]
    if unknown:
        raise ValueError(f"unknown presets {unknown}; known are {sorted(PRESETS)}")
    return list(dict.fromkeys(f"*.{e}" for n in names for e in PRESETS[n]))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def detect_language(path: Column, text: Column) -> Column:
    """By extension; else the language with the most telling lines, if they are over TELLING_SHARE of the lines that are not blank."""
    pairs = [(F.lit(e), F.lit(lang)) for lang, found in LANGUAGE_EXTENSIONS.items() for e in found]
    by_name = F.try_element_at(F.create_map(*chain.from_iterable(pairs)), extension(path))
    lines = F.greatest(F.regexp_count(text, F.lit(r"(?m)^.*\S")), F.lit(1))
    order = {lang: -k for k, lang in enumerate(TELLING_LINES)}
    told = [
        F.struct(
            F.regexp_count(text, F.lit(rf"(?m)^[ \t]*(?:{look})")).alias("n"), F.lit(order[lang]).alias("k"), F.lit(lang).alias("lang")
        ) for lang,
        look in TELLING_LINES.items()
    ]
    best = F.array_max(F.array(*told))
    return F.coalesce(by_name, F.when(best["n"] > TELLING_SHARE * lines, best["lang"]))


def ignore_rule(pattern: str) -> tuple[bool, str] | None:
    """An ignore-file line as (kept, regular expression over the relative path); None for blanks and comments."""
    line = pattern.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    keep, line = line.startswith("!"), line.removeprefix("!")
    folder, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.removeprefix("/")
    out = []
    for part in re.split(r"(\*\*/|/\*\*$|\*\*|\*|\?)", line):
        out.append({"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or re.escape(part))
    return keep, ("^" if anchored else "^(?:.*/)?") + "".join(out) + ("/.*$" if folder else "(?:/.*)?$")


def ignored(path: Column, rules: Iterable[str]) -> Column:
    """Whether the last rule that matches a relative path drops it. Rules become one CASE; no Python runs on the rows."""
    out = F.lit(False)
    for rule in rules:
        if parsed := ignore_rule(rule):
            keep, pattern = parsed
            out = F.when(path.rlike(pattern), F.lit(not keep)).otherwise(out)
    return out


@dataclass(frozen=True)
class Landmarks:
    """What a folder's listing tells before any file is read: ignore files by folder, and folders that are skipped whole."""

    ignore: tuple[tuple[str, tuple[str, ...]], ...] = ()
    skipped: tuple[str, ...] = ()


def landmarks(spark: SparkSession, folder: str, ignore_name: str = ".gitignore", project_mark: str | None = None) -> Landmarks:
    """Ignore files of all folders, virtual environments, and nested projects (folders below the root that hold ``project_mark``).

    A listing on the driver, as Spark's own is; skipped folders are not entered, and only ignore files, which are small, are opened.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    ignore, skipped, todo = [], [], [("", root)]
    while todo:
        prefix, at = todo.pop()
        held = {f.getPath().getName(): f for f in fs.listStatus(at)}
        if prefix and ("pyvenv.cfg" in held or project_mark in held):
            skipped.append(prefix)
            continue
        if ignore_name in held:
            reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(held[ignore_name].getPath()), "UTF-8"))
            ignore.append((prefix, tuple(str(x) for x in reader.lines().toArray())))
            reader.close()
        todo += [
            (f"{prefix}/{name}".strip("/"), f.getPath()) for name,
            f in held.items() if f.isDirectory() and name not in PRUNED and name != project_mark
        ]
    outer_first = sorted(ignore, key=lambda x: (x[0].count("/") + bool(x[0]), x[0]))
    return Landmarks(tuple(outer_first), tuple(sorted(skipped)))


def layered_ignore(path: Column, layers: Iterable[tuple[str, Iterable[str]]]) -> Column:
    """Ignore rules of several folders: each layer sees the path from its own folder on; deeper layers decide after outer ones."""
    out = F.lit(False)
    for prefix, rules in layers:
        inner = path if not prefix else F.substring(path, len(prefix) + 2, 1 << 30)
        inside = F.lit(True) if not prefix else path.startswith(prefix + "/")
        for rule in rules:
            if parsed := ignore_rule(rule):
                keep, pattern = parsed
                out = F.when(inside & inner.rlike(pattern), F.lit(not keep)).otherwise(out)
    return out


@F.pandas_udf(T.StringType())
def docx_text(content: pd.Series) -> pd.Series:
    """Paragraphs of word-processor files, a line each; what is no such file has no text."""
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def read(data: bytes | None) -> str | None:
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                body = ElementTree.fromstring(z.read("word/document.xml"))
        except (TypeError, KeyError, zipfile.BadZipFile, ElementTree.ParseError):
            return None
        return "\n".join("".join(t.text or "" for t in p.iter(word + "t")) for p in body.iter(word + "p"))

    return content.map(read)


def _texts(files: DataFrame) -> DataFrame:
    """(source, file_name, file_size, modified, text, language, source_type) of listed files; generated blobs and files without text go."""
    path = F.col("path")
    kind = extension(path)
    plain = F.col("content").cast("string")
    text = F.when(kind == "docx", docx_text(F.col("content"))).when(kind.isin("html", "htm"), html_text(plain)).otherwise(plain)
    name = F.regexp_extract(path, "[^/]+$", 0)
    rows = files.where(kind != "pdf").select(
        path.alias("source"), name.alias("file_name"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"),
        text.alias("text")
    )
    rows = rows.where(F.col("text").isNotNull() & ~minified(F.col("file_name"), F.col("text")))
    tier = F.when(extension(F.col("source")).isin(*DOCUMENT_EXTENSIONS, "docx", "htm"), "doc").otherwise("code")
    lang = detect_language(F.col("source"), F.col("text"))
    return rows.withColumn("source_type", tier).withColumn("language", F.when(F.col("source_type") == "code", lang))


def scan(
    spark: SparkSession, folder: str, globs: Iterable[str] = (), ignore: Iterable[str] = (), include_code: bool = True, marks: Landmarks | None = None, recursive: bool = True
) -> DataFrame:
    """(source, file_name, file_size, modified, text, language, source_type) of a folder's text files, pruned before they are decoded.

    The listing is Spark's own; contents are read only for paths that pass, since the path filter goes into the scan. ``marks`` (of
    ``landmarks``) adds the ignore files of the folders and skips virtual environments and nested projects. Markup is read as its text;
    pdf files need a parser that is not here and are left out.
    """
    known = [*DOCUMENT_EXTENSIONS, "docx", "htm"] + ([e for found in LANGUAGE_EXTENSIONS.values() for e in found] if include_code else [])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(folder)
    path = F.col("path")
    relative = F.regexp_replace(path, "^.*?" + re.escape(folder.rstrip("/").removeprefix("file:")) + "/", "")
    keep = ~F.concat(F.lit("/"), relative).rlike("/(" + "|".join(map(re.escape, PRUNED)) + ")/") & ~ignored(relative, ignore)
    if marks is not None:
        keep &= ~layered_ignore(relative, marks.ignore)
        for prefix in marks.skipped:
            keep &= ~relative.startswith(prefix + "/")
    globs = list(globs)
    keep &= F.regexp_extract(path, "[^/]+$", 0).rlike("|".join(f"(?:{glob_to_regex(g)})" for g in globs)) if globs else extension(path).isin(*known)
    return _texts(files.where(keep))


def read_file(spark: SparkSession, path: str) -> DataFrame:
    """One file as ``scan`` would have it, whatever its extension."""
    return _texts(spark.read.format("binaryFile").load(path))


def manifest_dependencies(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(source, package, dependency) of pyproject.toml and package.json files (source, text); files that do not parse give none."""
    import pandas as pd

    def parse(batches):
        import json
        import tomllib

        for pdf in batches:
            out = []
            for source, text in zip(pdf["source"], pdf["text"], strict=True):
                try:
                    if source.endswith("pyproject.toml"):
                        project = tomllib.loads(text).get("project", {})
                        name, deps = project.get("name"), [re.match(r"[A-Za-z0-9_.-]*", d.strip())[0] for d in project.get("dependencies", [])]
                    elif source.endswith("package.json"):
                        data = json.loads(text)
                        name, deps = data.get("name"), [*data.get("dependencies", {}), *data.get("devDependencies", {})]
                    else:
                        continue
                except (ValueError, TypeError, AttributeError):
                    continue
                out += [(source, name, d) for d in dict.fromkeys(deps) if name and d and d != name]
            yield pd.DataFrame(out, columns=["source", "package", "dependency"])

    return files.select("source", "text").mapInPandas(parse, "source string, package string, dependency string")
