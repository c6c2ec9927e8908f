"""Measures of source files: lines, normalised lines, complexity, functions and nesting.

Lines are counted in expressions. Braces, indentation and functions are measured by small per-file helpers in Arrow UDFs; everything around them stays in expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrykit.functions.languages import BY_NAME, Language

ColumnOrName = Column | str

#: White space that is trimmed off lines: Unicode's, with the separators that Python adds left out.
_TRIM = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _lines(content: str) -> list[str]:
    lines = content.split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def _opener(line: str, language: Language) -> tuple[int, str, str] | None:
    """The first block comment that opens in a line: its place and both marks."""
    found = [(line.find(a), a, b) for a, b in language.block_comments if a in line]
    return min(found) if found else None


def _code_and_state(line: str, language: Language, closing: str | None) -> tuple[str, str | None, str | None]:
    """Text before and after comments of a line, and the mark that closes what stays open; a state step of both counts."""
    if closing is not None:
        end = line.find(closing)
        return ("", None, closing) if end < 0 else ("", line[end + len(closing) :], None)
    opened = _opener(line, language)
    if opened is None:
        return line, None, None
    at, mark, close = opened
    return line[:at], None, None if close in line[at + len(mark) :] else close


def normal_lines(content: str, language: Language) -> list[tuple[str, int]]:
    """Code of each line without comments, trimmed and in lower case, with its number from 1; empty ones are left out."""
    out = []
    closing = None
    for number, line in enumerate(_lines(content), 1):
        if closing is not None:
            _, line, closing = _code_and_state(line, language, closing)
            if line is None:
                continue
        code, _, closing = _code_and_state(line, language, None)
        ends = [code.find(mark) for mark in language.line_comments if mark in code]
        code = code[: min(ends)] if ends else code
        text = code.strip(_TRIM).lower()
        if text:
            out.append((text, number))
    return out


@dataclass(frozen=True)
class Grammar:
    """Patterns that a language is measured by; flags as in the patterns."""

    imports: str | None
    exports: str | None
    functions: tuple[str, ...]
    decisions: tuple[str, ...]
    line: str
    block: str | None = r"/\*.*?\*/"
    skip: tuple[str, ...] = ()


# fixed values: what counts as a decision, and words that don't begin a function
_DECISIONS = (r"\b(?:if|for|while|switch|catch|case|do|else\s+if)\b", r"\&\&|\|\||\?")
_SKIP = ("if", "for", "while", "switch", "catch", "return", "throw", "case", "else", "do", "foreach")
_C_FUNCTION = r"(?m)^\s*[\w<>&*:\s,\.]+\([^;]*\)\s*\{?\s*$"
_JS = Grammar(
    r"\b(?:import|require\()\b",
    r"\bexport\b",
    (
        r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s",
        r"(?m)^\s*(?:export\s+)?(?:async\s+)?\([^)]*\)\s*=>\s*\{",
        r"(?m)^\s*(?:export\s+)?(?:async\s+)?[\w$]+\s*\([^)]*\)\s*\{",
    ),
    _DECISIONS,
    r"//.*",
)
_C = Grammar(r"#include", None, (_C_FUNCTION,), _DECISIONS, r"//.*", skip=_SKIP)

# fixed values: patterns of imports, exports and function starts of each language
GRAMMARS = {
    "Go": Grammar(None, r"(?m)^\s*(?:func|var|const|type)\s+[A-Z]", (r"(?m)^\s*func\s",), _DECISIONS, r"//.*"),
    "Rust": Grammar(r"\buse\b", r"(?m)^\s*pub\s", (r"(?m)^\s*(?:(?:pub|async|unsafe|extern)\s+)*fn\s",), _DECISIONS, r"//.*"),
    "Python": Grammar(
        r"(?m)^\s*(?:import|from\s+\S+\s+import)\s",
        r"(?m)^(?:def|class)\s",
        (r"(?m)^\s*(?:async\s+)?(?:def|class)\s",),
        (r"\b(?:if|elif|for|while|except|with|match|case)\b", r"\b(?:and|or)\b"),
        r"#.*",
        None,
    ),
    "TypeScript": _JS,
    "JavaScript": _JS,
    "Java": Grammar(r"(?m)^\s*import\s", r"(?m)^\s*public\s", (_C_FUNCTION,), _DECISIONS, r"//.*", skip=_SKIP),
    "Kotlin": Grammar(
        r"(?m)^\s*import\s",
        r"(?m)^\s*(?:public|open)\s|^\s*fun\s|^\s*(?:class|object|interface)\s",
        (r"(?m)^\s*(?:public|private|protected|internal|override|suspend|operator|infix|tailrec|external|inline)\s+fun\s|^\s*fun\s",),
        _DECISIONS,
        r"//.*",
    ),
    "PHP": Grammar(
        r"\buse\s+[A-Z\\]",
        r"(?m)^\s*(?:public|protected)\s+function\s|^\s*(?:abstract\s+)?class\s",
        (r"(?m)^\s*(?:public|private|protected|static|abstract|final|async)?\s*(?:function\s+)?(?:function\s)",),
        _DECISIONS,
        r"(?://.*|#.*)",
    ),
    "C#": Grammar(r"(?m)^\s*using\s", r"(?m)^\s*public\s", (_C_FUNCTION,), _DECISIONS, r"//.*", skip=_SKIP),
    "C++": _C,
    "C": _C,
    "Swift": Grammar(
        r"(?m)^\s*import\s",
        r"\bpublic\b",
        (r"(?m)^\s*(?:public|private|internal|fileprivate|open|static|class|struct|enum)\s+(?:func\s+)?func\s|^\s*func\s",),
        _DECISIONS,
        r"//.*",
    ),
}


def _compiled(pattern: str) -> re.Pattern[str]:
    """ASCII classes; ``\\s`` without the vertical tab."""
    inside = re.sub(r"\[([^\]]*)\\s([^\]]*)\]", lambda m: f"[{m[1]}\\t\\n\\f\\r {m[2]}]", pattern)
    return re.compile(re.sub(r"\\s", lambda _: r"[\t\n\f\r ]", inside), re.ASCII)


_CACHE: dict[str, re.Pattern[str]] = {}


def _count(pattern: str | None, source: str) -> int:
    if pattern is None:
        return 0
    found = _CACHE.get(pattern) or _CACHE.setdefault(pattern, _compiled(pattern))
    return sum(1 for _ in found.finditer(source))


def indent_depth(line: str) -> int:
    """Tabs count one, and so do four spaces in a row; a tab drops spaces before it."""
    lead = line[: len(line) - len(line.lstrip("\t "))]
    return lead.count("\t") + sum(len(run) // 4 for run in lead.split("\t"))


def _go_imports(source: str) -> int:
    """Single imports, and every line of import blocks that isn't blank."""
    n, inside = 0, False
    for line in (x.strip(_TRIM) for x in source.split("\n")):
        if inside:
            inside = line != ")"
            n += inside and line != ""
        elif line.startswith("import ("):
            inside = True
        else:
            n += line.startswith("import ")
    return n


def _braces(lines: list[str], start: int) -> int | None:
    """The line on which the first brace from ``start`` on is closed."""
    depth = 0
    for k in range(start, len(lines)):
        for mark in re.findall(r"[{}]", lines[k]):
            depth += 1 if mark == "{" else -1
            if mark == "}" and depth == 0:
                return k
    return None


def _controls(line: str, words: tuple[str, ...]) -> bool:
    text = line.strip(_TRIM)
    return any(text.startswith(w) and (rest := text[len(w) :].strip(_TRIM)) is not None and (rest == "" or rest[0] == "(") for w in words)


def _lengths(grammar: Grammar, source: str, python: bool) -> Iterator[int]:
    """Lengths of functions in lines."""
    lines = source.split("\n")
    if python:
        k = 0
        while k < len(lines):
            if not lines[k].strip(_TRIM).startswith(("def ", "class ")):
                k += 1
                continue
            base, end = indent_depth(lines[k]), k + 1
            while end < len(lines) and (not lines[end].strip(_TRIM) or indent_depth(lines[end]) > base):
                end += 1
            yield end - k
            k = end
        return
    for pattern in grammar.functions:
        found = _CACHE.get(pattern) or _CACHE.setdefault(pattern, _compiled(pattern))
        for hit in found.finditer(source):
            first = source.count("\n", 0, hit.start())
            if not _controls(lines[first], grammar.skip) and (last := _braces(lines, first)) is not None:
                yield last - first + 1


def measure(content: str, language: str) -> tuple[int, int, int, int, float, int, float, int]:
    """Complexity, imports, exports, functions, their mean and longest length, mean and deepest nesting; zeros for other languages."""
    grammar = GRAMMARS.get(language)
    if grammar is None:
        return 0, 0, 0, 0, 0.0, 0, 0.0, 0
    source = re.sub(grammar.block, " ", content) if grammar.block else content
    source = re.sub(grammar.line, "\n", source)
    lengths = list(_lengths(grammar, source, language == "Python"))
    depths = [indent_depth(x) for x in source.split("\n") if x.strip(_TRIM)]
    return (
        1 + sum(_count(d, source) for d in grammar.decisions),
        _go_imports(source) if language == "Go" else _count(grammar.imports, source),
        _count(grammar.exports, source),
        len(lengths),
        sum(lengths) / len(lengths) if lengths else 0.0,
        max(lengths, default=0),
        sum(depths) / len(depths) if depths else 0.0,
        max(depths, default=0),
    )


# UDFs are made when they are used: reading their types needs a session, which workers that import this don't have


def _of_language(language: ColumnOrName, value: Callable[[Language], Column]) -> Column:
    """A value of each row's language; null for unknown ones."""
    return F.try_element_at(F.create_map(*[x for name, own in BY_NAME.items() for x in (F.lit(name), value(own))]), F.col(language) if isinstance(language, str) else language)


def line_counts(content: ColumnOrName, language: ColumnOrName) -> Column:
    """Line counts of each text, as a struct; zeros for null texts and unknown languages.

    A walk over a file's lines in expressions: what is carried from line to line is whether a block comment is open, and the counts. A line that holds a line
    comment's mark anywhere counts as a comment, as does one inside a block comment, unless there is code before or after the comment.
    """
    text = F.col(content) if isinstance(content, str) else content
    marks = F.struct(
        _of_language(language, lambda x: F.lit(x.block_comments[0][0] if x.block_comments else None).cast("string")).alias("open"),
        _of_language(language, lambda x: F.lit(x.block_comments[0][1] if x.block_comments else None).cast("string")).alias("close"),
        _of_language(language, lambda x: F.array(*[F.lit(m) for m in x.line_comments]).cast("array<string>")).alias("line"),
    )
    lines = F.split(text, "\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)

    def solid(x: Column) -> Column:
        return F.btrim(x, F.lit(_TRIM)) != ""

    def step(own: Column, s: Column, x: Column) -> Column:
        opened, closed = F.coalesce(F.position(own["open"], x), F.lit(0)), F.coalesce(F.position(own["close"], x), F.lit(0))
        after_open = F.substr(x, opened + F.length(own["open"]))
        blank = ~s["open"] & ~solid(x)
        code = F.when(s["open"], (closed > 0) & solid(F.substr(x, closed + F.length(own["close"])))).when(opened > 0, solid(F.substr(x, F.lit(1), opened - 1)))
        code = ~blank & code.otherwise(~F.exists(own["line"], lambda m: F.contains(x, m)))
        stays = F.when(s["open"], closed == 0).when(opened > 0, F.position(own["close"], after_open) == 0).otherwise(False)
        return F.struct(stays.alias("open"), (s["code"] + code.cast("long")).alias("code"), (s["blank"] + blank.cast("long")).alias("blank"))

    zero = F.struct(F.lit(False).alias("open"), F.lit(0).cast("long").alias("code"), F.lit(0).cast("long").alias("blank"))
    # the marks are an array of one, so that they are worked out once a file
    walked = F.transform(F.array(marks), lambda own: F.aggregate(lines, zero, lambda s, x: step(own, s, x)))[0]
    known = text.isNotNull() & _of_language(language, lambda x: F.lit(True)).isNotNull()
    total = F.when(known, F.size(lines)).otherwise(0).cast("long")
    code, blank = (F.coalesce(F.when(known, walked[x]), F.lit(0)).cast("long") for x in ("code", "blank"))
    return F.struct(total.alias("lines_total"), code.alias("lines_code"), (total - code - blank).alias("lines_comment"), blank.alias("lines_blank"))


def normalized_lines(content: ColumnOrName, language: ColumnOrName) -> Column:
    """Normalised lines of each text, as an array of structs; none for null texts and unknown languages."""

    def normalize(content: pd.Series, language: pd.Series) -> pd.Series:
        out = [normal_lines(c, BY_NAME[x]) if c is not None and x in BY_NAME else [] for c, x in zip(content, language, strict=True)]
        return pd.Series([[{"text": t, "number": n} for t, n in rows] for rows in out], dtype=object)

    return F.pandas_udf(normalize, "array<struct<text: string, number: int>>")(content, language)


_MEASURES = ("complexity", "imports", "exports", "func_count", "avg_func_len", "max_func_len", "avg_nesting", "max_nesting")


def _measured(content: pa.Array, language: pa.Array) -> pa.Array:
    """Measures of a batch. One text at a time becomes a Python string, the others stay in the batch."""
    rows = [measure(c.as_py() or "", x.as_py()) for c, x in zip(content, language, strict=True)]
    columns = [pa.array([row[k] for row in rows], type=pa.float64() if x.startswith("avg") else pa.int64()) for k, x in enumerate(_MEASURES)]
    return pa.StructArray.from_arrays(columns, names=list(_MEASURES))


def code_metrics(content: ColumnOrName, language: ColumnOrName) -> Column:
    """What ``measure`` says of each text, as a struct."""
    kinds = ", ".join(f"{x} {'double' if x.startswith('avg') else 'long'}" for x in _MEASURES)
    return F.arrow_udf(_measured, kinds)(content, language)
