"""Languages: how files are recognised, and their comments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrykit.functions.paths import base_name, extension_of


@dataclass(frozen=True)
class Language:
    name: str
    extensions: tuple[str, ...] = ()
    filenames: tuple[str, ...] = ()
    line_comments: tuple[str, ...] = ()
    block_comments: tuple[tuple[str, str], ...] = ()


_C_BLOCK = (("/*", "*/"),)

# fixed values: extensions, file names and comment marks of each language
LANGUAGES = (
    Language("Go", ("go",), (), ("//",), _C_BLOCK),
    Language("Rust", ("rs",), (), ("//",), _C_BLOCK),
    Language("Python", ("py", "pyw"), (), ("#",)),
    Language("Java", ("java",), (), ("//",), _C_BLOCK),
    Language("Kotlin", ("kt", "kts"), (), ("//",), _C_BLOCK),
    Language("TypeScript", ("ts", "tsx", "mts", "cts"), (), ("//",), _C_BLOCK),
    Language("JavaScript", ("js", "jsx", "mjs", "cjs"), (), ("//",), _C_BLOCK),
    Language("PHP", ("php",), (), ("//", "#"), _C_BLOCK),
    Language("C#", ("cs",), (), ("//",), _C_BLOCK),
    Language("C++", ("cpp", "cc", "cxx", "c++", "hpp", "hh", "hxx"), (), ("//",), _C_BLOCK),
    Language("C", ("c", "h"), (), ("//",), _C_BLOCK),
    Language("Swift", ("swift",), (), ("//",), _C_BLOCK),
    Language("JSON", ("json", "jsonc", "json5")),
    Language("YAML", ("yml", "yaml"), (), ("#",)),
    Language("TOML", ("toml",), (), ("#",)),
    Language("Markdown", ("md", "markdown")),
    Language("HTML", ("html", "htm", "vue", "svelte", "xml", "svg", "xhtml"), (), (), (("<!--", "-->"),)),
    Language("CSS", ("css",), (), (), _C_BLOCK),
    Language("SCSS", ("scss", "sass"), (), ("//",), _C_BLOCK),
    Language("Shell", ("sh", "bash", "zsh"), (), ("#",)),
    Language("Ruby", ("rb", "rake", "gemspec"), (), ("#",)),
    Language("SQL", ("sql",), (), ("--",), _C_BLOCK),
    Language("Lua", ("lua",), (), ("--",)),
    Language("R", ("r",), (), ("#",)),
    Language("Docker", (), ("Dockerfile", "dockerfile"), ("#",)),
    Language("Make", (), ("Makefile", "makefile", "GNUmakefile"), ("#",)),
    Language("Plain Text", ("txt", "text", "csv", "log")),
)
BY_NAME = {x.name: x for x in LANGUAGES}


def language_of(path: Column) -> Column:
    """The language by extension, else by file name, else an empty text."""
    by_extension = F.create_map(*[F.lit(v) for x in LANGUAGES for e in x.extensions for v in (e, x.name)])
    by_name = F.create_map(*[F.lit(v) for x in LANGUAGES for e in x.filenames for v in (e, x.name)])
    return F.coalesce(F.try_element_at(by_extension, extension_of(path)), F.try_element_at(by_name, base_name(path)), F.lit(""))
