"""Files, transcripts, commit logs, chunks and code triples."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from sparkloft.operators import chunking, code_graph, tiers
from sparkloft.sources import files, history, sessions


def test_presets_and_ignore(spark):
    assert files.preset_globs(["c", "text", "c"]) == ["*.c", "*.h", "*.md", "*.txt", "*.rst"]
    rows = spark.createDataFrame([("a/x.log",), ("keep.log",), ("build/y.py",), ("src/build/z.py",), ("docs/a/b.md",), ("top.md",)], "p string")
    got = {r["p"] for r in rows.where(files.ignored(F.col("p"), ["# c", "*.log", "!keep.log", "/build/", "docs/**/b.md"])).collect()}
    assert got == {"a/x.log", "build/y.py", "docs/a/b.md"}


def test_folder_scan(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "src").mkdir()
    for name, text in {"a.md": "# A", "src/b.py": "import os\n", "node_modules/c.py": "x", "d.bin": "x", "lib.min.js": "x"}.items():
        (tmp_path / name).write_text(text)
    got = {r["file_name"]: (r["source_type"], r["language"]) for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("doc", None), "b.py": ("code", "python")}
    assert [r["file_name"] for r in files.scan(spark, str(tmp_path), ["*.md"]).collect()] == ["a.md"]


SAMPLES = {
    "python": "from a import b\n\nclass A(B):\n    def run(self, x):\n        self.x = x\n        return x\n",
    "javascript": "const a = require('a');\nfunction f(x) {\n  console.log(x);\n}\nmodule.exports = f;\n",
    "typescript": "export interface A {\n  name: string;\n}\ntype B = A | null;\nconst x: number = 1;\n",
    "java": "package a.b;\nimport java.util.List;\npublic class A {\n  @Override\n  public void run() {\n    System.out.println(1);\n  }\n}\n",
    "kotlin": "data class A(val x: Int)\nfun main() {\n  val y = 1\n  println(y)\n}\n",
    "cpp": "#include <vector>\nnamespace a {\ntemplate <class T>\nT f(T x) { return x; }\n}\nint main() { std::cout << 1; }\n",
    "c": "#include <stdio.h>\n#define N 3\nint main(void)\n{\n  printf(\"x\");\n  return 0;\n}\n",
    "go": "package main\nimport (\n\"fmt\"\n)\nfunc main() {\n  x := 1\n  fmt.Println(x)\n}\n",
    "rust": "use std::fmt;\nfn main() {\n  let mut x = 1;\n  println!(\"{}\", x);\n}\n",
    "swift": "import Foundation\nclass A: B {\n  func run() {\n    guard let x = y else { return }\n  }\n}\n",
    "csharp": "using System;\nnamespace A {\n  public class B {\n    public string Name { get; set; }\n  }\n}\n",
    "pascal": "unit A;\ninterface\nimplementation\nprocedure Run;\nbegin\n  x := 1;\nend;\nend.\n",
}


def test_language(spark):
    rows = spark.createDataFrame(
        [("x.rs", ""), ("noext", "package main\nimport (\n\"fmt\"\n)\nfunc a() {}\n"), ("noext", "plain words")], "p string, t string"
    )
    assert [r[0] for r in rows.select(files.detect_language(F.col("p"), F.col("t"))).collect()] == ["rust", "go", None]
    own = [(lang, text) for lang, text in SAMPLES.items()]
    told = spark.createDataFrame(own, "lang string, t string").select(
        "lang", files.detect_language(F.lit("noext"), F.col("t")).alias("found")
    ).collect()
    assert [(r["lang"], r["found"]) for r in told] == [(lang, lang) for lang in SAMPLES]


def test_dependencies(spark):
    rows = spark.createDataFrame(
        [
            ("a/pyproject.toml", '[project]\nname = "me"\ndependencies = ["x>=1", "y", "me"]\n'),
            ("package.json", json.dumps({"name": "js", "dependencies": {"l": "1"}})), ("b/pyproject.toml", "not toml [")
        ],
        "source string, text string"
    )
    assert sorted(
        (r["package"], r["dependency"]) for r in files.manifest_dependencies(spark, rows).collect()
    ) == [("js", "l"), ("me", "x"), ("me", "y")]


def _write(folder, day, tool, rows):
    d = folder / f"{day}-{tool}"
    d.mkdir(parents=True, exist_ok=True)
    (d / "s.jsonl").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_transcripts(spark, tmp_path):
    _write(tmp_path, "2026-01-05", "chat", [
        {"type": "queue", "sessionId": "s"},
        {"type": "user", "timestamp": "t1", "message": {"role": "user", "content": "please  help"}},
        "not json",
        {
            "type": "assistant", "timestamp": "t2",
            "message": {
                "role": "assistant",
                "content": [
                    {"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "sure"},
                    {"type": "tool_use", "name": "Write", "input": {"file_path": "a.py"}}
                ]
            }
        },
        {
            "type": "user", "timestamp": "t3",
            "message": {"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "ok"}]}]}
        },
    ])
    _write(tmp_path, "2026-01-06", "roll", [
        {"type": "session_meta", "payload": {"session_id": "x"}},
        {"type": "response_item", "payload": {"type": "message", "role": "developer", "content": [{"type": "input_text", "text": "rules"}]}},
        {"type": "event_msg", "payload": {"type": "user_message", "message": "add"}},
        {
            "type": "response_item", "timestamp": "t",
            "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "add"}]}
        },
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": "{\"command\":\"ls\"}"}},
        {"type": "response_item", "payload": {"type": "function_call_output", "output": "src"}},
    ])
    _write(tmp_path, "2026-01-07", "step", [
        {
            "step_index": 0, "source": "USER_EXPLICIT", "type": "USER_INPUT", "status": "DONE",
            "content": "<USER_REQUEST>\nlook\n</USER_REQUEST>\nmeta"
        },
        {"step_index": 1, "source": "MODEL", "type": "PLANNER_RESPONSE", "status": "RUNNING", "content": "hm"},
        {
            "step_index": 1, "source": "MODEL", "type": "PLANNER_RESPONSE", "status": "DONE", "content": "done", "thinking": "deep",
            "tool_calls": [{"name": "run", "args": {"c": "ls"}}]
        },
        {"step_index": 2, "source": "MODEL", "type": "RUN_COMMAND", "status": "RUNNING", "content": "out"},
    ])
    formats = {"roll": "rollout", "step": "step"}
    t = sessions.parse_archive(spark, str(tmp_path), formats)
    by = {}
    for r in t.orderBy("tool", "idx", "kind").collect():
        by.setdefault(r["tool"], []).append((r["idx"], r["role"], r["kind"], r["tool_name"] or r["text"], r["terminal"]))
    assert by["chat"] == [
        (0, "user", "text", "please help", True), (1, "assistant", "thinking", "hm", True), (2, "assistant", "text", "sure", True),
        (3, "assistant", "tool_use", "Write", True), (4, "user", "tool_result", "ok", True)
    ]
    assert by["roll"] == [(0, "user", "text", "add", True), (1, "assistant", "tool_use", "shell", True), (2, "assistant", "tool_result", "src", True)]
    assert by["step"] == [
        (0, "user", "text", "look", True), (1, "assistant", "text", "done", True), (1, "assistant", "thinking", "deep", True),
        (1, "assistant", "tool_use", "run", True), (2, "assistant", "tool_result", "out", False)
    ]
    assert {r["tool"] for r in sessions.parse_archive(spark, str(tmp_path), formats, "2026-01-06", "2026-01-07").collect()} == {"roll"}
    assert {r["title"] for r in sessions.session_titles(t).collect()} == {"please help", "add", "look"}


def test_commit_log(spark, tmp_path):
    log = f"{history.COMMIT}abc\nAnn\na@x\n2026-01-01T00:00:00+00:00\nFix it\nbody line{history.END}\n3\t1\tsrc/a.py\n-\t-\tpic.png\n{history.COMMIT}def\nBo\nb@x\n2026-01-02T00:00:00+00:00\nMore\n{history.END}\n"
    rows = history.parse_log(spark.createDataFrame([(log,)], "value string")).orderBy("sha").collect()
    assert [
        (r["sha"], r["subject"], r["body"], r["files_changed"], r["lines_added"], r["lines_deleted"]) for r in rows
    ] == [("abc", "Fix it", "body line", ["src/a.py", "pic.png"], 3, 1), ("def", "More", "", [], 0, 0)]
    assert history.commit_chunks(spark.createDataFrame(rows)).count() == 2
    repository = tmp_path / "work"
    repository.mkdir()

    def git(*args):
        named = ["-c", "user.name=Ann", "-c", "user.email=a@x", "-c", "commit.gpgsign=false"]
        return subprocess.run(["git", "-C", str(repository), *named, *args], check=True, capture_output=True, text=True).stdout.strip()

    git("init", "-q")
    for k in range(3):
        (repository / f"f{k}.txt").write_text("line\n" * (k + 1))
        git("add", "-A")
        git("commit", "-q", "-m", f"Change {k}\n\nbody")
    first, last = git("rev-list", "--max-parents=0", "HEAD"), git("rev-parse", "HEAD")
    got = history.commits(spark, str(repository)).orderBy("subject").collect()
    assert [
        (r["subject"], r["body"], r["files_changed"], r["lines_added"]) for r in got
    ] == [(f"Change {k}", "body", [f"f{k}.txt"], k + 1) for k in range(3)]
    assert history.commits(spark, str(repository), depth=2).count() == 2
    assert history.commits(spark, str(repository), since=first).count() == 2
    assert [r["subject"] for r in history.commits(spark, str(repository), paths=["f1.txt"]).collect()] == ["Change 1"]
    assert {r["sha"] for r in history.reachable(spark, str(repository)).collect()} == {r["sha"] for r in got}
    state = spark.createDataFrame([(str(repository), first, 1), ("other", "x", 5)], "repository string, sha string, indexed long")
    after = history.advance(state, history.commits(spark, str(repository), since=first), str(repository), last)
    assert sorted(tuple(r) for r in after.collect()) == sorted([(str(repository), last, 3), ("other", "x", 5)])
    with pytest.raises(Exception, match="not a git repository|does not have any commits|No such file|cannot change"):
        history.commits(spark, str(tmp_path / "none")).count()


CODE = '''
import os
from a.b import c

class Base(Root):
    @cached
    def run(self):
        return self.stop(helper())

    def stop(self, x):
        pass

def helper():
    return os.getcwd()
'''


def test_chunks_and_code(spark):
    text = "One sentence here. " * 200
    parts = chunking.split_text(text, 100, 20)
    assert all(len(p) <= 400 for p in parts) and parts[0].startswith("One") and len(parts) > 9
    assert chunking.split_text("x" * 5000, 100) and chunking.split_text("") == []
    code = chunking.split_code("\n".join(f"line {i}" for i in range(100)))
    assert [(a, b) for a, b, _ in code] == [(1, 40), (26, 65), (51, 90), (76, 100)]
    df = spark.createDataFrame(
        [("b.py", CODE, "code", "python"), ("a.md", text, "doc", None), ("n.md", None, "doc", None)],
        "source string, text string, source_type string, language string"
    )
    rows = chunking.chunk_files(df).collect()
    assert {r["symbol_name"] for r in rows if r["source"] == "b.py"} == {"helper"} and all(
        r["total_chunks"] == sum(x["source"] == r["source"] for x in rows) for r in rows
    )
    t = {(r["subject"], r["predicate"], r["object"]) for r in code_graph.triples(df).collect()}
    assert {
        ("b.py:Base.run", "calls", "b.py:Base.stop"), ("b.py:Base.run", "calls", "b.py:helper"), ("b.py:Base.run", "decorated_by", "cached"),
        ("b.py:Base", "extends", "Root"), ("b.py", "imports", "a.b"), ("b.py:Base", "contains", "b.py:Base.stop"),
        ("b.py:helper", "calls", "os.getcwd")
    } <= t
    nodes, edges = code_graph.to_graph(code_graph.triples(df))
    assert nodes.count() == nodes.select("id").distinct().count() and edges.count() == len(t)
    js = spark.createDataFrame(
        [
            ("x.ts", "import {a} from './a'\nconst b = require(\"b\")", "typescript"), ("y.go", 'import (\n  "fmt"\n  x "net/http"\n)', "go"),
            ("Z.java", "import static a.b.C;\nimport d.E;", "java")
        ],
        "source string, text string, language string"
    )
    assert {(r["source_file"], r["object"]) for r in code_graph.import_triples(js).collect()} == {
        ("x.ts", "./a"), ("x.ts", "b"), ("y.go", "fmt"), ("y.go", "net/http"), ("Z.java", "a.b.C"), ("Z.java", "d.E")
    }
    imports = spark.createDataFrame([("p/q/m.py", "u.v")], "source_file string, object string")
    known = spark.createDataFrame([("p/u/v.py",), ("u/v/__init__.py",)], "source string")
    assert code_graph.resolve_imports(imports, known).first()["target"] == "p/u/v.py"
    near = spark.createDataFrame([("p/q/m.py", ".v"), ("p/q/m.py", "..u.v"), ("p/q/m.py", "....v"), ("m.py", "u.v")], "source_file string, object string")
    known = spark.createDataFrame([("p/q/v.py",), ("p/u/v.py",), ("v.py",), ("u/v.py",)], "source string")
    got = {(r["source_file"], r["object"]): r["target"] for r in code_graph.resolve_imports(near, known).collect()}
    assert got == {("p/q/m.py", ".v"): "p/q/v.py", ("p/q/m.py", "..u.v"): "p/u/v.py", ("m.py", "u.v"): "u/v.py"}
    assert spark.range(1).select(
        code_graph.normalize_type(F.lit("readme")), code_graph.relation_ends(F.lit("touches"))[0]
    ).first()[:] == ("README", "File")


def test_tiers(spark):
    reg = tiers.Registry()
    reg.domain("health")
    items = spark.createDataFrame(
        [
            ("record", "health", "s1", "2026-01-05T00:00:00"), ("document", "nope", "s1", None), ("entity", "code", "", None),
            ("other", "code", "s", None)
        ],
        "tier string, domain string, source_id string, ts string"
    )
    out = tiers.route(items, reg)
    assert out["record"].first()["iso_week"] == "2026-W02" and out["document"].count() == 0
    assert {r["problem"] for r in out["rejected"].collect()} == {"unknown domain", "no provenance", "unknown tier"}
    assert tiers.forget({"a": items}, "s1")["a"].count() == 2
    chunks = spark.createDataFrame([({"k": "own"},), (None,)], "extra map<string,string>")
    assert [r["extra"] for r in tiers.inject(chunks, {"k": "c", "z": "1"}).collect()] == [{"z": "1", "k": "own"}, {"k": "c", "z": "1"}]
