"""Scalar functions of paths, times and sizes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folder_of(path: Column) -> Column:
    """Text before the last slash, else nothing."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension_of(path: Column) -> Column:
    """The last extension in lower case without its dot; ``.bashrc`` has ``bashrc``."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)\.([^.]*)$", 1))


def depth_of(path: Column) -> Column:
    """Slashes of a file's path."""
    return (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("long")


def folder_ignored(folder: Column, names: list[str]) -> Column:
    """True if any part of a folder's path is an ignored name, in any case."""
    wanted = [n.lower() for n in names]
    return F.exists(F.split(F.lower(folder), "/"), lambda part: part.isin(wanted)) if wanted else F.lit(False)


def is_binary(content: Column) -> Column:
    """A zero byte among the first 512."""
    return F.locate("00", F.regexp_replace(F.hex(F.substring(content, 1, 512)), "(..)", "$1 ")) > 0


def extension_filter(wanted: str) -> str:
    """Lower case, one leading dot dropped."""
    return wanted.lower().removeprefix(".")


def matcher(text: str, regex: bool = False, whole_word: bool = False, case_sensitive: bool = False) -> str:
    """A Java pattern for a search text. Word edges are those of ASCII letters, digits and underscores; an alternation in a whole-word
    pattern isn't put in brackets."""
    import re

    if regex:
        re.compile(text)
    pattern = text if regex else "".join(f"\\{c}" if not c.isalnum() and c.isascii() and c not in "_ \n" else c for c in text)
    if whole_word:
        pattern = rf"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])){pattern}(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
    return pattern if case_sensitive else f"(?iu){pattern}"


def utc_text(ts: Column) -> Column:
    """RFC 3339 in UTC, to the second."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def day_of(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def size_label(size: Column) -> Column:
    """Bytes as B, KiB, MiB or GiB, one decimal from KiB on."""
    label = F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B")))
    for power, unit in ((1, "KiB"), (2, "MiB")):
        label = label.when(size < 1024 ** (power + 1), F.concat(F.format_string("%.1f", size / 1024**power), F.lit(f" {unit}")))
    return label.otherwise(F.concat(F.format_string("%.1f", size / 1024**3), F.lit(" GiB")))


def xml_escape(value: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(plain), F.lit(escaped))
    return value


def clamp(value: Column, default: int, low: int, high: int) -> Column:
    """An integer parameter given as text: out of range below or unreadable takes the default, too large the limit."""
    number = value.try_cast("int")
    return F.when(number.isNull() | (number < low), F.lit(default)).otherwise(F.least(number, F.lit(high)))
