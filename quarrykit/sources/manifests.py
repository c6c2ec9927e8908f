"""Dependencies from manifests. Their formats are public; what is read from each is this library's own choice, stated below."""

from __future__ import annotations

import json
import re
import tomllib
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.functions.paths import base_name

# fixed values: manifests and the names of their managers
MANAGERS = {
    "package.json": "npm", "composer.json": "composer", "go.mod": "go", "Cargo.toml": "cargo",
    "pom.xml": "maven", "requirements.txt": "pip", "pyproject.toml": "pip",
}

_REQUIREMENT = re.compile(r"^\s*([A-Za-z0-9][\w.-]*)\s*(?:\[[^\]]*\])?\s*([^;#]*)")


def _json(text: str, scopes: dict[str, str]) -> list[tuple[str, str, str]]:
    whole = json.loads(text)
    return [(k, str(v), scope) for key, scope in scopes.items() for k, v in (whole.get(key) or {}).items()]


def _requirements(lines: list[str]) -> list[tuple[str, str, str]]:
    found = [_REQUIREMENT.match(x) for x in lines if x.strip() and not x.lstrip().startswith(("#", "-"))]
    return [(m[1], m[2].strip(), "runtime") for m in found if m]


def _go(text: str) -> list[tuple[str, str, str]]:
    body = re.findall(r"^require\s*\(([^)]*)\)", text, re.M)
    lines = [x for b in body for x in b.splitlines()] + re.findall(r"^require\s+([^(\n]+)$", text, re.M)
    out = []
    for line in lines:
        code, _, note = line.partition("//")
        parts = code.split()
        if len(parts) >= 2:
            out.append((parts[0], parts[1], "indirect" if "indirect" in note else "direct"))
    return out


def _cargo(text: str) -> list[tuple[str, str, str]]:
    whole = tomllib.loads(text)
    scopes = {"dependencies": "runtime", "dev-dependencies": "dev", "build-dependencies": "build"}
    return [(k, v if isinstance(v, str) else str(v.get("version", "")), scope) for key, scope in scopes.items() for k, v in whole.get(key, {}).items()]


def _pyproject(text: str) -> list[tuple[str, str, str]]:
    project = tomllib.loads(text).get("project", {})
    extra = [(n, v, name) for name, own in project.get("optional-dependencies", {}).items() for n, v, _ in _requirements(own)]
    return _requirements(project.get("dependencies", [])) + extra


def _maven(text: str) -> list[tuple[str, str, str]]:
    root = ET.fromstring(re.sub(r'\sxmlns="[^"]+"', "", text, count=1))
    return [(f"{d.findtext('groupId', '')}:{d.findtext('artifactId', '')}", d.findtext("version", ""), d.findtext("scope", "compile")) for d in root.iter("dependency")]


def parse_manifest(name: str, text: str) -> list[tuple[str, str, str]]:
    """(name, version, scope) of each dependency; none for files that can't be read as what their name says."""
    try:
        if name == "package.json":
            return _json(text, {"dependencies": "runtime", "devDependencies": "dev", "peerDependencies": "peer", "optionalDependencies": "optional"})
        if name == "composer.json":
            return _json(text, {"require": "runtime", "require-dev": "dev"})
        if name == "go.mod":
            return _go(text)
        if name == "Cargo.toml":
            return _cargo(text)
        if name == "pom.xml":
            return _maven(text)
        if name == "pyproject.toml":
            return _pyproject(text)
        return _requirements(text.splitlines())
    except (ValueError, AttributeError, TypeError, ET.ParseError):
        return []


def _entries(name: pd.Series, content: pd.Series) -> pd.Series:
    rows = [[{"name": a, "version": b, "scope": c} for a, b, c in parse_manifest(n, t)] if t else [] for n, t in zip(name, content, strict=True)]
    return pd.Series(rows, dtype=object)


def dependencies(files: DataFrame) -> DataFrame:
    """Dependencies of the manifests among ``files`` (``repo_id``, ``path``, ``content``)."""
    name = base_name(F.col("path"))
    manager = F.create_map(*[F.lit(x) for pair in MANAGERS.items() for x in pair])
    found = files.where(name.isin(*MANAGERS)).select("repo_id", "path", name.alias("n"), "content")
    entries = F.pandas_udf(_entries, "array<struct<name: string, version: string, scope: string>>")
    each = found.select("repo_id", F.col("path").alias("file_path"), manager[F.col("n")].alias("manager"), F.explode(entries("n", "content")).alias("e"))
    return each.select("repo_id", "file_path", "manager", "e.*")
