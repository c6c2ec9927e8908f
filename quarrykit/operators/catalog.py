"""The files of a repository: filters, totals, lists, pages and trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.functions.paths import depth_of
from quarrykit.ordering import Ordered, ordered

_SORTS = {"loc": ("lines_code", False), "complexity": ("complexity", False), "name": ("name", True), "": ("path", True), "path": ("path", True)}

#: Rows up to a page's end that Spark may keep in one place to find it.
SHALLOW = 10_000


def filter_files(files: DataFrame, folder: str = "", extension: str = "", language: str = "") -> DataFrame:
    for column, value in (("folder", folder), ("extension", extension), ("language", language)):
        if value:
            files = files.where(F.col(column) == value)
    return files


def _order(sort: str) -> list[Column]:
    if sort not in _SORTS:
        raise ValueError(f"unknown sort: {sort}")
    column, ascending = _SORTS[sort]
    return [F.col(column).asc() if ascending else F.col(column).desc(), F.col("path")]


def list_files(files: DataFrame, sort: str = "") -> DataFrame:
    """Ordered by ``loc`` or ``complexity`` (largest first), ``name`` or path; equals by path."""
    return files.orderBy(*_order(sort))


def page_size(limit: int, most: int = 1000) -> int:
    return min(limit, most) if limit > 0 else 100


def page(listed: DataFrame, limit: int = 100, offset: int = 0, most: int = 1000) -> DataFrame:
    """A page near the front of an ordered table: Spark keeps the best ``offset`` + ``limit`` rows, so a deep page is better read from ``ordered_files``."""
    return listed.offset(max(0, offset)).limit(page_size(limit, most))


def ordered_files(files: DataFrame, sort: str = "") -> Ordered:
    """Files written in an order once, for pages at any depth."""
    return ordered(files, *_order(sort))


def page_with_total(files: DataFrame, limit: int, offset: int, sort: str = "", shallow: int = SHALLOW) -> DataFrame:
    """A page with the number of all rows that match beside it. Beyond ``shallow`` rows, only the ranges of the order that the page lies in are read for it."""
    if max(0, offset) + page_size(limit) <= shallow:
        total = files.agg(F.count("*").alias("total"))
        return page(list_files(files, sort), limit, offset).crossJoin(F.broadcast(total))  # one row
    listed = ordered_files(files, sort)
    return listed.rows(offset, page_size(limit)).withColumn("total", F.lit(listed.total).cast("long"))


def search_names(files: DataFrame, text: str, column: str = "name", case_sensitive: bool = False, limit: int = 50) -> DataFrame:
    """Files whose column holds a text, by path: one row more than the limit says that there are more."""
    value = F.col(column)
    hit = value.contains(text) if case_sensitive else F.lower(value).contains(text.lower())
    return files.where(hit).orderBy("path").limit(limit + 1)


def scan_totals(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"),
        *[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("lines_total", "lines_code", "lines_comment", "lines_blank")],
        F.count_if(F.col("lines_total") == 0).alias("zero_line_files"),
    )


def language_rollup(files: DataFrame, unknown: bool = False) -> DataFrame:
    """Files, lines and bytes of each language; without a language only if ``unknown``."""
    known = files.withColumn("language", F.coalesce("language", F.lit("")))
    known = known if unknown else known.where("language <> ''")
    return known.groupBy("language").agg(
        F.count("*").alias("files"), F.sum("lines_total").alias("loc"), F.sum("lines_code").alias("code"),
        F.sum("lines_comment").alias("comments"), F.sum("lines_blank").alias("blank"), F.sum("size").alias("size"),
    )


def top_languages(files: DataFrame, n: int = 8) -> DataFrame:
    return language_rollup(files).orderBy(F.desc("code"), "language").limit(n).select("language", "code")


def metrics_totals(files: DataFrame) -> DataFrame:
    sums = ("lines_total", "lines_code", "lines_comment", "lines_blank", "size", "complexity", "imports", "exports", "func_count")
    return files.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in sums], F.max("lines_total").alias("max_loc"), F.max("complexity").alias("max_complexity"))


def repository_summary(files: DataFrame, **others: DataFrame) -> DataFrame:
    """Sums of files beside the row counts of other tables."""
    out = scan_totals(files)
    for name, table in others.items():
        out = out.crossJoin(F.broadcast(table.agg(F.count("*").alias(name))))  # one row each
    return out


def deepest_file(files: DataFrame) -> DataFrame:
    """The path with most slashes, the first of equals; none if all are at the top."""
    return files.select("path", depth_of(F.col("path")).alias("depth")).where("depth > 0").orderBy(F.desc("depth"), "path").limit(1)


def ranked_files(files: DataFrame, column: str = "lines_total") -> DataFrame:
    """All files of a known language that have lines, largest first."""
    return files.where((F.coalesce("language", F.lit("")) != "") & (F.col("lines_total") > 0)).orderBy(F.desc(column), "path")


def line_composition(files: DataFrame) -> DataFrame:
    sums = files.agg(F.sum("lines_code").alias("code"), F.sum("lines_comment").alias("comment"), F.sum("lines_blank").alias("blank"))
    return sums.unpivot([], ["code", "comment", "blank"], "kind", "lines")


def folders(files: DataFrame) -> DataFrame:
    return files.where("folder <> ''").select("folder").distinct()


def tree_children(files: DataFrame, prefix: str = "") -> DataFrame:
    """Names of the folders right below a folder."""
    inside = f"{prefix}/" if prefix else ""
    below = files.where(F.col("folder").startswith(inside) & (F.col("folder") != prefix))
    return below.select(F.split_part(F.substr("folder", F.lit(len(inside) + 1)), F.lit("/"), F.lit(1)).alias("child")).where("child <> ''").distinct()


def manager_counts(dependencies: DataFrame) -> DataFrame:
    return dependencies.groupBy("manager").agg(F.count("*").alias("dependencies"))


def grouped_dependencies(dependencies: DataFrame) -> DataFrame:
    """Dependencies by manager, then name: ``manager``, ``total`` (how many it has), ``name``, ``version``, ``scope``. No group is gathered in a row."""
    totals = manager_counts(dependencies).select(F.col("manager").alias("of"), F.col("dependencies").alias("total"))
    known = dependencies.join(totals, F.col("manager").eqNullSafe(F.col("of")))
    return known.select("manager", "total", "name", "version", "scope").orderBy("manager", "name", "version", "scope")


def of_repository(tables: dict[str, DataFrame], repo_id: int) -> dict[str, DataFrame]:
    """One repository's rows of each table: questions are put to one repository, whose folder alone is read from tables that ``write_tables`` wrote."""
    return {name: table.where(F.col("repo_id") == repo_id) for name, table in tables.items()}


def repositories(table: DataFrame) -> DataFrame:
    """All repositories, last scanned first."""
    return table.orderBy(F.desc("scanned_at"), "repo_id")
