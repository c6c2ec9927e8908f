import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarrykit.functions import code, imports
from quarrykit.functions.languages import BY_NAME, language_of
from quarrykit.functions.paths import base_name, clamp, depth_of, extension_of, folder_ignored, folder_of, is_binary, matcher, size_label, xml_escape

GO = """package main

import (
\t"fmt"
\t"os"
)

// Run does it.
func Run(a int) int {
\tif a > 1 && a < 5 {
\t\treturn 1
\t}
\treturn 0
}

type Thing struct{}

func helper() {
\tfmt.Println(os.Args)
}
"""


def test_languages(spark):
    pairs = [("a/foo.go", "Go"), ("foo.h", "C"), ("foo.hpp", "C++"), ("Dockerfile", "Docker"), ("unknown.xyz", ""), ("x/Makefile", "Make"), ("a.TS", "TypeScript"), ("r.R", "R"), ("notes.txt", "Plain Text"), ("noext", "")]
    rows = spark.createDataFrame(pairs, "path string, want string").select("want", language_of(F.col("path")).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_paths(spark):
    rows = spark.createDataFrame([("a/b/.bashrc",), ("x.tar.GZ",), ("top",), ("",)], "p string")
    p = F.col("p")
    got = [tuple(r) for r in rows.select(folder_of(p), base_name(p), extension_of(p), depth_of(p)).collect()]
    assert got == [("a/b", ".bashrc", "bashrc", 2), ("", "x.tar.GZ", "gz", 0), ("", "top", "", 0), ("", "", "", 0)]
    ignored = spark.createDataFrame([("src/Node_Modules/x", True), ("src/node", False), ("", False)], "f string, want boolean")
    assert all(r.want == r.got for r in ignored.select("want", folder_ignored(F.col("f"), ["node_modules"]).alias("got")).collect())


def test_small_functions(spark):
    one = spark.createDataFrame([("7", 1536, "<a&'b\">")], "n string, size long, x string")
    row = one.select(clamp(F.col("n"), 50, 1, 5).alias("n"), size_label(F.col("size")).alias("s"), xml_escape(F.col("x")).alias("x")).first()
    assert (row.n, row.s, row.x) == (5, "1.5 KiB", "&lt;a&amp;&#39;b&quot;&gt;")
    binary = spark.createDataFrame([(bytearray(b"a\x00b"), True), (bytearray(b"\x10\x01 0"), False), (bytearray(b"x" * 600 + b"\x00"), False)], "c binary, want boolean")
    assert all(r.want == r.got for r in binary.select("want", is_binary(F.col("c")).alias("got")).collect())
    words = spark.createDataFrame([("éa b", False), ("a.b", True), ("ab", False)], "t string, want boolean")
    assert all(r.want == r.got for r in words.select("want", F.regexp_like("t", F.lit(matcher("A", whole_word=True))).alias("got")).where("t <> 'éa b'").collect())
    with pytest.raises(Exception):
        matcher("(", regex=True)


def _plain_counts(text, language):
    """Lines, code, comments and blanks by a loop over lines."""
    lines = text.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    begin, end = (*language.block_comments, (None, None))[0]
    n_code, n_comments, n_blanks, inside = 0, 0, 0, False
    for line in lines:
        if inside:
            at = line.find(end)
            is_code, inside = at >= 0 and line[at + len(end) :].strip(code._TRIM) != "", at < 0
        elif not line.strip(code._TRIM):
            n_blanks += 1
            continue
        elif begin and begin in line:
            at = line.find(begin)
            is_code, inside = line[:at].strip(code._TRIM) != "", end not in line[at + len(begin) :]
        else:
            is_code = not any(mark in line for mark in language.line_comments)
        n_code, n_comments = n_code + is_code, n_comments + (not is_code)
    return len(lines), n_code, n_comments, n_blanks


def _counted(spark, rows):
    """Counts of (text, language) rows, and whether the plan has Python in it."""
    counted = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, text string, language string").select("k", code.line_counts("text", "language").alias("l")).select("k", "l.*")
    return [tuple(r)[1:] for r in counted.orderBy("k").collect()], "EvalPython" in counted._jdf.queryExecution().executedPlan().toString()


def test_line_counts(spark):
    rows = {
        ("# a\nx = 1\n\ny = 2 # b\n", "Python"): (4, 1, 2, 1),
        ("/*\n a\n*/\nint x;\n", "Java"): (4, 1, 3, 0),
        ("/* a\n\n*/ x();\n", "Go"): (3, 1, 2, 0),  # blanks in a block are comments
        ("// see /*\nx\n", "Go"): (2, 1, 1, 0),  # opens a block all the same; what is before it is code
        ("u = 'http://x'\n", "Go"): (1, 0, 1, 0),
        ("", "Go"): (0, 0, 0, 0),
        (None, "Go"): (0, 0, 0, 0),
        ("x", "unknown"): (0, 0, 0, 0),
        ("x", None): (0, 0, 0, 0),
        ("<!-- a\n-->b\n\u2003\nc", "HTML"): (4, 2, 1, 1),
    }
    got, python = _counted(spark, list(rows))
    assert got == list(rows.values()) and not python


def test_line_counts_equal_plain_loop(spark):
    draw = random.Random(7)
    parts = ["/*", "*/", "//", "#", "<!--", "-->", "--", "x", " ", "\t", "\u00a0", "\n", "\n", "\n\n", "\r\n", "\x1c", "é", "*", "/"]
    rows = [("".join(draw.choice(parts) for _ in range(draw.randrange(60))), draw.choice(sorted(BY_NAME))) for _ in range(1500)]
    got, _ = _counted(spark, rows)
    assert got == [_plain_counts(t, BY_NAME[x]) for t, x in rows]


def test_normal_lines():
    text = "Foo(); // x\n/* a\nb */ Bar();\n\n  BAZ  \n"
    assert code.normal_lines(text, BY_NAME["Go"]) == [("foo();", 1), ("bar();", 3), ("baz", 5)]
    assert code.normal_lines("", BY_NAME["Go"]) == []


def test_measures():
    complexity, n_imports, exports, functions, mean, longest, _, deepest = code.measure(GO, "Go")
    assert (n_imports, exports, functions, deepest) == (2, 2, 2, 2)
    assert complexity == 3
    assert longest >= 6 and mean > 3
    python = "import os\nfrom a import b\n\ndef f(x):\n    if x and x:\n        return 1\n\nclass A:\n    def g(self):\n        pass\n"
    assert code.measure(python, "Python")[:4] == (3, 2, 2, 2)
    typescript = "import a from 'a';\nimport { b } from './b';\nexport function f() {\n  return 1;\n}\nexport const x = 1;\n"
    assert code.measure(typescript, "TypeScript")[1:3] == (2, 2)
    assert code.measure("anything", "Plain Text") == (0, 0, 0, 0, 0.0, 0, 0.0, 0)
    assert code.measure("if (a) {\n}\n", "JavaScript")[3] == 1  # control statements look like functions there
    assert code.indent_depth("  \t    x") == 2


def test_measures_of_a_batch_hold_a_text_at_a_time(spark):
    texts = [f"if a{k}:\n    b\n" * 2000 for k in range(200)] + [None, ""]
    batch = pa.array(texts), pa.array(["Python"] * 201 + [None])
    assert batch[0].nbytes > 5 * 2**20
    tracemalloc.start()
    found = code._measured(*batch).to_pylist()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2 * 2**20
    assert [tuple(x.values()) for x in found] == [code.measure(t or "", x) for t, x in zip(texts, batch[1].to_pylist(), strict=True)]
    # as Spark runs it
    rows = [(k, t, x) for k, (t, x) in enumerate([(GO, "Go"), (None, "Go"), ("x", None), ("", "Python"), ("def f():\n    return 1\n", "Python")])]
    made = spark.createDataFrame(rows, "k long, content string, language string").select("k", code.code_metrics("content", "language").alias("m"))
    assert {r.k: tuple(r.m) for r in made.collect()} == {k: code.measure(t or "", x) for k, t, x in rows}
    assert made.where("k < 0").count() == 0


def test_import_specs():
    assert imports.import_specs("Go", 'import "a"\nimport (\n x "b/c"\n)\n') == ["a", "b/c"]
    assert imports.import_specs("TypeScript", "import x from './a'\nconst b = require('../b')\nimport('c')") == ["./a", "../b", "c"]
    assert imports.import_specs("C", '#include <x.h>\n#include "y.h"') == ["y.h"]
    assert imports.import_specs("Rust", "use crate::a::b, self::c;") == ["crate::a::b", "self::c"]
    assert imports.import_specs("PHP", "use \\A\\B;") == ["A\\B"]
    assert imports.import_specs("Markdown", "import x") == []


def test_candidates():
    assert "src/b.ts" in imports.candidates("src/x/a.ts", "TypeScript", "../b.js")
    assert imports.candidates("a.py", "Python", "x.y") == ["x/y.py", "x/y/__init__.py", "src/x/y.py", "src/x/y/__init__.py"]
    assert imports.candidates("src/a.rs", "Rust", "super::b::C") == ["src/b.rs", "src/b/mod.rs"]
    assert imports.candidates("a.kt", "Kotlin", "org.x.Y")[0] == "org/x/Y.java"
    assert imports.candidates("d/a.c", "C", "b.h") == ["d/b.h", "b.h"]
    assert imports.candidates("a.ts", "TypeScript", "react") == []
