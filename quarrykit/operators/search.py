"""Content search: an inverted index finds files, and a pattern finds their lines."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.functions.paths import extension_filter, matcher

LINES_PER_FILE, SNIPPET = 50, 240
_TOKEN = r"[^\p{L}\p{N}]+"


_MARKS = re.compile(r"[\u0300-\u036f]")
#: Bytes of text whose tokens are put together at once.
_AT_ONCE = 2**20


def _fold(texts: pa.Array) -> pa.Array:
    """Lower case without diacritics."""
    return pa.array([(t if t.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", t))).lower() for t in texts.to_pylist()], type=pa.string())


def _parts(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``_AT_ONCE`` bytes of text each, a row at least."""
    ends = np.cumsum(pc.binary_length(batch[column]).to_numpy(zero_copy_only=False), dtype=np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(ends // _AT_ONCE)) + 1).tolist(), len(ends)]
    return (batch.slice(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False))


def _postings(file_id: pa.Array, text: pa.Array) -> pa.RecordBatch:
    """Each row's distinct tokens (runs of letters and digits) with their positions: a stable sort by row and token of all tokens."""
    split = pc.split_pattern_regex(text, _TOKEN)
    row = np.repeat(np.arange(len(text)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    words = split.flatten()
    solid = pc.not_equal(words, "")
    row, words = row[solid.to_numpy(zero_copy_only=False)], words.filter(solid)
    position = np.arange(len(row)) - np.searchsorted(row, row)
    coded = words.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((position, code, row))
    row, code, position = row[order], code[order], position[order]
    first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])))) if len(row) else np.zeros(0, dtype=np.int64)
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), pa.array(position.astype(np.int32)))
    return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[first])), file_id.take(pa.array(row[first])), places], names=["token", "file_id", "positions"])


def _grouped(folded: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings of ``file_id`` and ``content``, part by part: a batch may hold many times the text that should be taken apart at once."""

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, "content"):
                yield _postings(part["file_id"], _fold(part["content"]) if folded else part["content"])

    return grouped


def build_index(files: DataFrame, folded: bool = True, only: str | None = None) -> DataFrame:
    """``token``, ``file_id`` and the token's ``positions`` in it, of ``files`` (``file_id``, ``content``), a row a file.

    A file's tokens are put together where its row is, so nothing is shuffled. ``folded`` drops diacritics; without it only case is folded, by Spark. For a single query without a written index, ``only`` is its text: rows
    of other tokens aren't made.
    """
    text = F.coalesce("content", F.lit(""))
    found = files.select("file_id", (text if folded else F.lower(text)).alias("content"))
    index = found.mapInArrow(_grouped(folded), f"token string, file_id {found.schema['file_id'].dataType.simpleString()}, positions array<int>")
    return index if only is None else index.where(F.col("token").isin(tokens_of(only)))


def tokens_of(text: str) -> list[str]:
    """Tokens of a query: lower case, without diacritics."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ").lower()
    return [t for t in re.split(r"[\W_]+", plain) if t]


def matching_files(index: DataFrame, text: str) -> DataFrame:
    """Files that hold every phrase of a query (``file_id``). A white-space-delimited part is a phrase of its tokens in a row."""
    phrases = [p for p in (tokens_of(part) for part in text.split()) if p]
    if not phrases:
        return index.select("file_id").limit(0)
    found = []
    for phrase in phrases:
        starts = [index.where(F.col("token") == t).select("file_id", F.expr(f"transform(positions, p -> p - {k})").alias(f"p{k}")) for k, t in enumerate(phrase)]
        joined = reduce(lambda a, b: a.join(b, "file_id"), starts)
        common = reduce(F.array_intersect, [F.col(f"p{k}") for k in range(len(phrase))])
        found.append(joined.where(F.size(common) > 0).select("file_id"))
    return reduce(lambda a, b: a.join(b, "file_id", "left_semi"), found).distinct()


def matching_lines(files: DataFrame, pattern: str) -> DataFrame:
    """The first lines of each file that a pattern matches: ``number`` from 1, and ``text`` cut to a snippet."""
    lines = F.transform(F.split("content", "\n"), lambda t, k: F.struct((k + 1).alias("number"), t.alias("text")))
    hits = F.slice(F.filter(lines, lambda x: F.regexp_like(x["text"], F.lit(pattern))), 1, LINES_PER_FILE)
    each = files.select("file_id", "path", F.explode(hits).alias("hit"))
    return each.select("file_id", "path", F.col("hit.number").cast("long").alias("number"), F.substring("hit.text", 1, SNIPPET).alias("text"))


def search_content(files: DataFrame, text: str, index: DataFrame | None = None, regex: bool = False, whole_word: bool = False, case_sensitive: bool = False, extension: str = "") -> DataFrame:
    """Lines of files that match. An index narrows plain searches to files that hold all tokens; patterns read all files."""
    text = text.strip()
    if not text:
        return matching_lines(files.limit(0), "$.")
    if extension:
        files = files.where(F.col("extension") == extension_filter(extension))
    if not regex and index is not None:
        files = files.join(matching_files(index, text), "file_id", "left_semi")
    return matching_lines(files, matcher(text, regex, whole_word, case_sensitive))


def page_hits(lines: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of files with their matching lines, ordered by path."""
    files = lines.groupBy("file_id", "path").agg(F.sort_array(F.collect_list(F.struct("number", "text"))).alias("matches"))
    return files.orderBy("path", "file_id").offset(max(0, offset)).limit(limit)
