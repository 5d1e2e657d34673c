"""Code files to triples: symbols, calls, decorators, imports."""

from __future__ import annotations

import ast
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloft.operators.ordered import parts

# Names of entity types, and the ends of session relations.
ENTITY_TYPES = "Package Module Class Method Function Interface Enum Folder Decorator DesignDoc UserDoc PRD Runbook README APIDoc Service Endpoint Database ConfigFile Decision Error Session Tool File Task Commit Author".split()
PREDICATES = "calls extends implements references depends_on imports contains defined_in decorated_by handled_by modifies authored_by".split()
RELATION_TYPES = {
    "touches": ("File", None), "fixed-by": ("Error", "Decision"), "superseded-by": ("Decision", "Decision"), "ran-in": ("Tool", "Session"),
    "depends-on": ("Task", "Task"), "decided": ("Session", "Decision")
}
BROADCAST_FILES = 200_000  # paths that are broadcast at most
_SCHEMA = "source_file string, subject string, subject_type string, predicate string, object string, object_type string"


def normalize_type(raw: Column) -> Column:
    """Known names whatever their case; others as they are."""
    known = F.create_map(*chain.from_iterable((F.lit(t.lower()), F.lit(t)) for t in ENTITY_TYPES))
    return F.coalesce(F.try_element_at(known, F.lower(raw)), raw)


def relation_ends(relation: Column) -> tuple[Column, Column]:
    def end(i: int) -> Column:
        out = F.lit(None).cast("string")
        for r, ends in RELATION_TYPES.items():
            if ends[i]:
                out = F.when(relation == r, ends[i]).otherwise(out)
        return out

    return end(0), end(1)


ROUTE_METHODS = {"get", "post", "put", "patch", "delete", "head", "options", "route", "websocket"}


def _endpoint(decorator: ast.expr) -> str | None:
    """METHOD /path of a web route's decorator, as @app.get("/path"); None for other decorators."""
    if not isinstance(decorator, ast.Call) or not isinstance(decorator.func, ast.Attribute) or decorator.func.attr not in ROUTE_METHODS:
        return None
    first = decorator.args[0] if decorator.args else None
    if not isinstance(first, ast.Constant) or not isinstance(first.value, str) or not first.value.startswith("/"):
        return None
    return f"{decorator.func.attr.upper()} {first.value}"


def folder_triples(files: DataFrame) -> DataFrame:
    """(source_file, subject, subject_type, predicate, object, object_type): each file in its folder, each folder in the one above."""
    parts = F.split("source", "/")
    at = F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("n")
    rows = files.where(F.col("source").contains("/")).select("source", parts.alias("p"), at)
    name = lambda n: F.array_join(F.slice("p", 1, n), "/")
    inner = F.when(F.col("n") == F.size("p") - 1, F.col("source")).otherwise(name(F.col("n") + 1))
    kind = F.when(F.col("n") == F.size("p") - 1, "File").otherwise("Folder")
    out = rows.select(inner.alias("subject"), kind.alias("subject_type"), F.lit("in_folder").alias("predicate"), name(F.col("n")).alias("object"))
    out = out.distinct().select(F.when(F.col("subject_type") == "File", F.col("subject")).alias("source_file"), "*", F.lit("Folder").alias("object_type"))
    return out.where("object <> ''")


def reference_triples(references: DataFrame) -> DataFrame:
    """Triples of cross references that a language server has resolved elsewhere.

    references: (source_file, caller, target_file, target, kind): kind call or reference; rows without a resolved end are dropped.
    """
    rows = references.where("target is not null and target_file is not null and source_file is not null")
    subject = F.when(F.col("caller").isNull(), F.col("source_file")).otherwise(F.concat("source_file", F.lit(":"), "caller"))
    made = (
        "source_file", subject.alias("subject"), F.when(F.col("caller").isNull(), "File").otherwise("Function").alias("subject_type"),
        F.when(F.col("kind") == "call", "calls").otherwise("references").alias("predicate"), F.concat("target_file", F.lit(":"), "target").alias("object"), F.lit("Function").alias("object_type"),
    )
    return rows.select(*made).where("subject <> object").distinct()


def python_triples(path: str, text: str) -> list[tuple]:
    """contains, defined_in, calls, decorated_by, extends and imports edges of one file; a file that does not parse gives none."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out, top = [], {x.name for x in tree.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))}

    def name_of(x) -> str | None:
        if isinstance(x, ast.Call):
            x = x.func
        parts = []
        while isinstance(x, ast.Attribute):
            parts.append(x.attr)
            x = x.value
        return ".".join([x.id, *reversed(parts)]) if isinstance(x, ast.Name) else None

    def visit(node, owner: str | None, owner_type: str, cls: str | None) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                is_class = isinstance(x, ast.ClassDef)
                routes = [r for r in map(_endpoint, x.decorator_list) if r]
                me = f"{path}:{owner + '.' if owner else ''}{x.name}"
                kind = "Class" if is_class else "Method" if cls else "Function"
                out.append((path, me, kind, "defined_in", path, "File"))
                if owner:
                    out.append((path, f"{path}:{owner}", owner_type, "contains", me, kind))
                out.extend((path, me, kind, "decorated_by", d, "Function") for d in map(name_of, x.decorator_list) if d)
                if is_class:
                    out.extend((path, me, kind, "extends", b, "Class") for b in map(name_of, x.bases) if b)
                out.extend((path, r, "Endpoint", "handled_by", me, kind) for r in routes)
                inner = f"{owner + '.' if owner else ''}{x.name}"
                visit(x, inner, kind, inner if is_class else cls)
                continue
            if isinstance(x, ast.Import):
                out.extend((path, path, "File", "imports", a.name, "Module") for a in x.names)
            elif isinstance(x, ast.ImportFrom):
                out.append((path, path, "File", "imports", "." * x.level + (x.module or ""), "Module"))
            elif isinstance(x, ast.Call) and owner and (called := name_of(x)):
                if called in top:
                    called = f"{path}:{called}"
                elif called.startswith("self.") and cls and called.count(".") == 1:
                    called = f"{path}:{cls}.{called[5:]}"
                out.append((path, f"{path}:{owner}", owner_type, "calls", called, "Function"))
            visit(x, owner, owner_type, cls)

    visit(tree, None, "File", None)
    return list(dict.fromkeys(out))


def triples(files: DataFrame) -> DataFrame:
    """Triples of Python files (source, text, language), a file a row and no shuffle."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame(
                [t for s, x in zip(pdf["source"], pdf["text"], strict=True) for t in python_triples(s, x or "")],
                columns=["source_file", "subject", "subject_type", "predicate", "object", "object_type"]
            )

    return files.where("language = 'python'").select("source", "text").mapInPandas(run, _SCHEMA)


_IMPORTS = {
    "javascript": (r"""(?m)(?:import\s[^'"\n]*from\s*|import\s*|require\(\s*)['"]([^'"]+)['"]""", 1),
    "java": (r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)", 1),
    "go": (r"""(?m)^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\n]+)"\s*$""", 1),
}


def import_triples(files: DataFrame) -> DataFrame:
    """(source_file, predicate, object) of imports in JavaScript, TypeScript, Java and Go, by pattern."""
    out = None
    for lang, (pattern, group) in _IMPORTS.items():
        langs = (lang, "typescript") if lang == "javascript" else (lang,)
        rows = files.where(F.col("language").isin(*langs)).select(
            F.col("source").alias("source_file"), F.lit("imports").alias("predicate"),
            F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)))).alias("object")
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def to_graph(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, label) and edges (source_id, target_id, label, source_file) of triples, each once."""
    ends = F.explode(
        F.array(
            F.struct(F.col("subject").alias("id"), F.col("subject_type").alias("label")),
            F.struct(F.col("object").alias("id"), F.col("object_type").alias("label"))
        )
    ).alias("n")
    nodes = rows.select(ends).groupBy("n.id").agg(F.min("n.label").alias("label")).select(
        "id", F.regexp_extract("id", r"[^:]*$", 0).alias("name"), "label"
    )
    edges = rows.select(
        F.col("subject").alias("source_id"), F.col("object").alias("target_id"), F.col("predicate").alias("label"), "source_file"
    ).distinct()
    return nodes, edges


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source_file, object, target): dotted modules to files, the nearest ancestor folder first.

    Leading dots name the file's own folder (one dot) or one above it (two), and so on; such a module is looked for there only. Candidate
    paths are few for each import and meet the files in an equi-join.
    """
    dots = F.length(F.regexp_extract("object", r"^\.*", 0))
    folders = F.filter(F.split(F.regexp_replace("source_file", r"/?[^/]*$", ""), "/"), lambda x: x != "")
    last = F.size(folders)
    rows = imports.withColumns({"dots": dots, "dotted": F.replace(F.ltrim(F.col("object"), F.lit(".")), F.lit("."), F.lit("/")), "folders": folders})
    steps = F.when(F.col("dots") > 0, F.array(F.col("dots") - 1)).otherwise(F.sequence(F.lit(0), last))
    up = rows.withColumn("k", F.explode(steps)).where(F.col("k") <= F.size("folders"))
    base = F.array_join(F.slice("folders", 1, F.size("folders") - F.col("k")), "/")
    stem = F.concat_ws("/", F.nullif(base, F.lit("")), F.nullif("dotted", F.lit("")))
    candidates = F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")))
    up = up.withColumn("target", F.explode(candidates))
    known = files.select(F.col("source").alias("target")).distinct()
    few = known.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES
    hit = up.join(F.broadcast(known) if few else known, "target")
    # a fixed number of parts: paths shrink so well in a shuffle that parts dealt by their bytes hold millions of rows, which a task then sorts
    hit = hit.repartition(parts(imports.sparkSession), "source_file", "object")
    return hit.groupBy("source_file", "object").agg(F.min_by("target", F.struct("k", "target")).alias("target"))
