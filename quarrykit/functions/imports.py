"""Import statements of source files, and the files that they may mean."""

from __future__ import annotations

import posixpath
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: patterns of import statements
PATTERNS = {
    "js": r"""(?:import\s+(?:[^"']*?\s+from\s+)?["']([^"']+)["']|import\(\s*["']([^"']+)["']\s*\)|require\(\s*["']([^"']+)["']\s*\))""",
    "python": r"(?m)^\s*(?:import|from)\s+([\w.]+)",
    "rust": r"\buse\s+([^;{]+)",
    "java": r"(?m)^\s*import\s+(?:static\s+)?([\w.]+)",
    "cs": r"(?m)^\s*using\s+([\w.]+)",
    "cpp": r'#include\s+"([^>"]+)[>"]',
    "php": r"(?m)^\s*use\s+([\w\\]+)",
    "swift": r"(?m)^\s*import\s+(\w+)",
}
_PATTERN_OF = {"TypeScript": "js", "JavaScript": "js", "Python": "python", "Rust": "rust", "Java": "java", "Kotlin": "java", "C#": "cs", "C": "cpp", "C++": "cpp", "PHP": "php", "Swift": "swift"}
_COMPILED = {k: re.compile(v, re.ASCII) for k, v in PATTERNS.items()}
# fixed values: file names that are entry points
ENTRY_POINTS = (
    "main.go", "main.rs", "main.py", "__main__.py",
    "index.ts", "index.tsx", "index.js", "index.jsx",
    "app.ts", "app.tsx", "app.js", "app.jsx",
    "server.ts", "server.js",
)


def _quoted(text: str) -> list[str]:
    first, last = text.find('"'), text.rfind('"')
    return [text[first + 1 : last]] if first < last else []


def import_specs(language: str, content: str) -> list[str]:
    """What a file imports, as written, in order and with repeats."""
    if language == "Go":
        out, inside = [], False
        for line in (x.strip() for x in content.split("\n")):
            if inside:
                inside = line != ")"
                out += _quoted(line) if inside else []
            elif line.startswith("import ("):
                inside = True
            elif line.startswith("import "):
                out += _quoted(line)
        return out
    kind = _PATTERN_OF.get(language)
    if kind is None:
        return []
    found = [next(g for g in m.groups() if g) for m in _COMPILED[kind].finditer(content) if any(m.groups())]
    if kind == "rust":
        return [part.strip() for spec in found for part in spec.split(",") if part.strip()]
    if kind == "php":
        return [spec.removeprefix("\\") for spec in found]
    return found


def _under(folder: str, rest: str) -> str:
    return f"{folder}/{rest}"


# fixed values: what is put behind and before a spec to make paths, best first
SCRIPT_ENDS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
TYPED_ENDS = (".ts", ".tsx")
PYTHON_ROOTS, PYTHON_ENDS = ("", "src/"), (".py", "/__init__.py")
RUST_ROOTS, RUST_ENDS = ("src/", ""), (".rs", "/mod.rs")
JAVA_ROOTS = ("", "src/main/java/", "src/main/kotlin/", "src/")


def candidates(from_file: str, language: str, spec: str) -> list[str]:
    """Paths that a spec may mean, best first; none if it lies outside the repository. Go has its own rule (see ``operators.graph``)."""
    folder = posixpath.dirname(from_file)
    if language in ("TypeScript", "JavaScript"):
        if not spec.startswith(("./", "../")):
            return []
        base = posixpath.normpath(posixpath.join(folder, spec))
        more = [base[:-3] + e for e in TYPED_ENDS] if base.endswith(".js") else []
        return [base + e for e in SCRIPT_ENDS] + more
    if language == "Python":
        spec = spec.removeprefix(".")
        parts = [p for p in spec.split(".") if p]
        if not parts or spec.startswith("."):
            return []
        base = posixpath.normpath("/".join(parts))
        return [f"{root}{base}{end}" for root in PYTHON_ROOTS for end in PYTHON_ENDS]
    if language == "Rust":
        head, colons, rest = spec.strip().partition("::")
        name = rest.split("::", 1)[0]
        if not colons or head not in ("crate", "super", "self"):
            return []
        roots = RUST_ROOTS if head == "crate" else (_under(folder, ""),)
        return [f"{root}{name}{end}" for root in roots for end in RUST_ENDS]
    if language in ("Java", "Kotlin", "C#"):
        parts = spec.split(".")
        if len(parts) < 2:
            return []
        inner = posixpath.normpath("/".join(p for p in parts[:-1] if p) or ".")
        return [f"{root}{inner}/{parts[-1]}.java" for root in JAVA_ROOTS]
    if language in ("C", "C++"):
        return [] if spec.startswith("/") else [_under(folder, spec), spec]
    if language == "PHP":
        inner = spec.replace("\\", "/").removeprefix("/") + ".php"
        return [inner, _under(folder, inner)]
    return []


def _imports(path: pd.Series, language: pd.Series, content: pd.Series) -> pd.Series:
    out = []
    for p, x, c in zip(path, language, content, strict=True):
        out.append([{"spec": s, "candidates": candidates(p, x, s)} for s in import_specs(x, c or "")])
    return pd.Series(out, dtype=object)


def extract_imports(files: DataFrame) -> DataFrame:
    """One row per import statement of ``files`` (``repo_id``, ``path``, ``language``, ``content``): ``ordinal``, ``spec`` and ``candidates``."""
    found = F.pandas_udf(_imports, "array<struct<spec: string, candidates: array<string>>>")
    found = files.select("repo_id", "path", "language", F.posexplode(found("path", "language", "content")).alias("ordinal", "i"))
    return found.select("repo_id", F.col("path").alias("from_file"), "language", "ordinal", "i.spec", "i.candidates")
