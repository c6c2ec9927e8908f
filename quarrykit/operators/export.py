"""Files, commits and contributors as CSV or JSON, and the import graph as SVG."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.functions.paths import utc_text, xml_escape
from quarrykit.iterate import stored
from quarrykit.operators.graph import import_layers
from quarrykit.ordering import ordered

# fixed values: columns of each export, in order
COLUMNS = {
    "files": (
        "path", "name", "folder", "extension", "language", "size", "lines_total", "lines_code", "lines_comment", "lines_blank",
        "complexity", "imports", "exports", "author", "commits", "last_commit_at",
    ),
    "commits": ("hash", "author", "email", "date", "message", "files_changed", "insertions", "deletions", "is_merge"),
    "contributors": ("name", "email", "commits", "insertions", "deletions", "first_commit_at", "last_commit_at"),
}
_TIMES = ("date", "first_commit_at", "last_commit_at")


def export_rows(kind: str, table: DataFrame) -> DataFrame:
    """The columns of an export in its order: files by path, commits newest first, contributors by commits."""
    if kind not in COLUMNS:
        raise ValueError(f"unknown export: {kind}")
    order = {"files": ["path"], "commits": [F.desc("date"), "hash"], "contributors": [F.desc("commits"), "email"]}[kind]
    shown = [utc_text(F.col(c)).alias(c) if c in _TIMES else F.col(c) for c in COLUMNS[kind] if c in table.columns]
    return table.orderBy(*order).select(*shown)


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(x.title() for x in rest)


def write_export(kind: str, table: DataFrame, path: str, form: str = "csv", single_file: bool = True) -> None:
    """Writes an export; any form but ``json`` is CSV. One file is a person's download; ``single_file=False`` writes ordered parts.

    A JSON export in one file is one array; in parts it is JSON lines. Lines of the array are written by Spark, so no row meets the driver.
    """
    rows = export_rows(kind, table)
    if form != "json":
        (rows.coalesce(1) if single_file else rows).write.option("header", True).csv(path)
        return
    line = F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in rows.columns]), {"ignoreNullFields": "false"})
    if not single_file:
        rows.select(line.alias("value")).write.text(path)
        return
    rows = stored(rows.select(F.monotonically_increasing_id().alias("k"), line.alias("line")), "export")
    last = rows.agg(F.max("k")).first()[0]
    if last is None:
        table.sparkSession.range(1).select(F.lit("[]").alias("value")).coalesce(1).write.text(path)
        return
    value = F.concat(F.when(F.col("k") == 0, "[").otherwise(""), "line", F.when(F.col("k") == last, "]").otherwise(","))
    rows.orderBy("k").select(value.alias("value")).coalesce(1).write.text(path)


def svg(edges: DataFrame) -> DataFrame:
    """The lines (``line``, in order of ``part``, ``k``) of a picture of all resolved import edges: files in columns by the longest chain of imports from them."""
    pairs = stored(edges.where("resolved").select("from_file", "to_file").distinct(), "pairs")
    # a column may hold a large part of all files: places are counted over ranges of (layer, name), not in a window a column
    layers = stored(import_layers(pairs.withColumn("resolved", F.lit(True))), "layers")
    numbered = ordered(layers, "layer", "node").numbered()
    tops = numbered.groupBy("layer").agg(F.min("row_number").alias("top"))  # a row a column
    row = F.col("row_number") - F.col("top") + 1
    placed = stored(numbered.join(tops, "layer").select("node", (20 + 240 * F.col("layer")).alias("x"), (40 * row - 10).alias("y")), "placed")
    ends = pairs.join(placed.selectExpr("node AS from_file", "x + 200 AS x1", "y AS y1"), "from_file").join(placed.selectExpr("node AS to_file", "x AS x2", "y AS y2"), "to_file")
    lines = ends.select(F.lit(1).alias("part"), F.concat_ws("\n", "from_file", "to_file").alias("k"), F.format_string('<line x1="%d" y1="%d" x2="%d" y2="%d" stroke="#888"/>', "x1", "y1", "x2", "y2").alias("line"))
    box = F.format_string('<rect x="%d" y="%d" width="200" height="30" fill="#eee"/><text x="%d" y="%d">', "x", F.col("y") - 15, F.col("x") + 8, F.col("y") + 5)
    boxes = placed.select(F.lit(2).alias("part"), F.col("node").alias("k"), F.concat(box, xml_escape(F.col("node")), F.lit("</text>")).alias("line"))
    size = placed.agg(F.coalesce(F.max("x") + 240, F.lit(260)).alias("w"), F.coalesce(F.max("y") + 70, F.lit(60)).alias("h"))
    head = size.select(F.lit(0).alias("part"), F.lit("").alias("k"), F.format_string('<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d">', "w", "h").alias("line"))
    tail = size.select(F.lit(3).alias("part"), F.lit("").alias("k"), F.lit("</svg>").alias("line"))
    return reduce(DataFrame.unionByName, [head, lines, boxes, tail])


def write_svg(edges: DataFrame, path: str) -> None:
    """The picture as one text file, a person's download."""
    svg(edges).orderBy("part", "k").select("line").coalesce(1).write.text(path)
