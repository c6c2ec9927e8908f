"""What several corpus operators share, beside the library's stored tables and graph loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrykit.iterate import components, delete_path, find_roots, new_path, partitions, released, shared_dir, stored

__all__ = ["components", "delete_path", "draw", "find_roots", "new_path", "partitions", "released", "shared_dir", "stored", "utf8"]


def utf8(text: str | None) -> bytes:
    """UTF-8 bytes of a text, none for null; a lone surrogate, which has no UTF-8 form, becomes ``?``."""
    return b"" if text is None else text.encode("utf-8", "replace")


def draw(*parts: F.Column) -> F.Column:
    """A double in [0, 1) from a hash of the given columns; the same in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))
