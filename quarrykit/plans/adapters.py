"""The library's tables over the driver's: events and orders are commits, documents are files, pages are paths and links."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.functions.languages import language_of
from quarrykit.functions.paths import base_name, depth_of, extension_of, folder_of

LINKS = r'href="([^"]+)"'


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    return events.select(
        F.col("event_id").alias("hash"), user.alias("author"), user.alias("email"), F.col("event_type").alias("message"), F.col("ts").alias("date"),
        F.floor("value").cast("long").alias("insertions"), F.coalesce(F.get_json_object("props", "$.k").cast("long"), F.lit(0)).cast("long").alias("deletions"),
    )


def order_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    customer = F.col("o_custkey").cast("string")
    return orders.select(F.col("o_orderkey").alias("hash"), customer.alias("author"), customer.alias("email"), F.col("o_orderpriority").alias("message"), F.col("o_orderdate").alias("date"))


def line_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("hash"), F.col("l_partkey").alias("path"), F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("deleted"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id"), F.lit(".txt")))
    text = F.coalesce("text", F.lit(""))
    files = docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), F.col("lang").alias("language"), F.col("n_chars").alias("size"), text.alias("content"))
    lines = F.split("content", "\n")
    blank = F.size(F.filter(lines, lambda x: F.regexp_replace(x, r"^[\s\x85\xA0]+|[\s\x85\xA0]+$", "") == "")).cast("long")
    total = F.size(lines).cast("long")
    comment = F.size(F.filter(lines, lambda x: F.ltrim(x).startswith("#"))).cast("long")
    return files.withColumns({
        "name": base_name(F.col("path")), "folder": folder_of(F.col("path")), "extension": extension_of(F.col("path")),
        "lines_total": total, "lines_blank": blank, "lines_comment": comment, "lines_code": total - blank - comment,
    })


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of pages without scheme, query and fragment."""
    path = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"), "html")
    return pages.withColumns({"folder": folder_of(F.col("path")), "name": base_name(F.col("path")), "depth": depth_of(F.col("path"))})


#: Letters of a word that name a file.
STEM = 6
#: Domains of the driver's pages, in the order in which a link is looked up beyond its own.
DOMAINS = ("example.com", "example.net", "example.org")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, and the files that each may mean: ``domain/letter/stem`` of the word it names, of its own domain first."""
    pages = page_paths(spark, sf_dir)
    host = F.substring_index("path", "/", 1)
    links = pages.select("page_id", F.regexp_extract(host, r"[^.]+\.[^.]+$", 0).alias("domain"), F.posexplode(F.regexp_extract_all("html", F.lit(LINKS), F.lit(1))).alias("ordinal", "spec"))
    word = F.regexp_replace(F.regexp_replace("spec", "^/+", ""), r"[/?#].*$", "")
    links = links.withColumn("tail", F.when(word != "", F.concat(F.lit("/"), F.lower(F.substring(word, 1, 1)), F.lit("/"), F.lower(F.substring(word, 1, STEM)))))
    tries = F.array(F.concat("domain", "tail"), *[F.concat(F.lit(x), "tail") for x in DOMAINS])
    return links.select("page_id", "ordinal", "spec", F.concat("domain", "tail").alias("own"), F.when(F.col("tail").isNotNull(), tries).alias("candidates"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page as the file of its first link's word; pages may share one. ``path`` and ``folder``, each path once."""
    paths = page_links(spark, sf_dir).where("ordinal = 0 AND own IS NOT NULL").select(F.col("own").alias("path")).distinct()
    return paths.withColumn("folder", folder_of(F.col("path")))


def page_edges(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """Import edges between files of pages, from resolved links (``page_id``, ``ordinal``, ``to_file``)."""
    first = page_links(spark, sf_dir).where("ordinal = 0 AND own IS NOT NULL").select("page_id", F.col("own").alias("from_file"))
    return found.where("to_file IS NOT NULL").join(first, "page_id").select("from_file", "to_file", F.lit("link").alias("kind"), F.lit(True).alias("resolved"))


def page_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of pages whose own path ends in ``.html``, as entry points (``path``)."""
    entries = page_paths(spark, sf_dir).where("endswith(path, '.html')").select("page_id")
    return page_links(spark, sf_dir).where("ordinal = 0 AND own IS NOT NULL").join(entries, "page_id", "left_semi").select(F.col("own").alias("path")).distinct()


#: Sources of parts by ``p_partkey % 6``: path and content. Each imports parts 6 and 12 further, which have its language; ``{body}`` is one to three lines.
PART_SOURCES = (
    ("web/s{z}/p{k}.ts", "// if this were code\n/* one\n two */\nimport {{ a }} from './p{k6}'\nconst b = require('../s0/p{k12}.js')\nimport 'react'\nexport function run() {{\n    if (a && b) {{\n{body}    }}\n}}\n", "        x()\n"),
    ("src/s{z}/p{k}.py", "import os\nfrom s{z}.p{k6} import x\n\nclass Run:\n    def go(self):\n        if a and b:\n{body}", "            x()\n"),
    ("src/p{k}.rs", "use crate::p{k6}::Thing;\nuse std::fmt;\npub fn run() {{\n\tif a || b {{\n{body}\t}}\n}}\n", "\t\tx();\n"),
    ("src/main/java/org/s{z}/P{k}.java", "import org.s{z}.P{k6};\nimport static java.util.List;\npublic class P{k} {{\n\tpublic int run(int a) {{\n\t\twhile (a > 0 && b) {{\n{body}\t\t}}\n\t}}\n}}\n", "\t\t\tx();\n"),
    ("c/s{z}/p{k}.c", "#include <stdio.h>\n#include \"p{k6}.c\"\n#include \"c/s0/p{k12}.c\"\nint run(int a) {{\n\tif (a || b) {{\n{body}\t}}\n}}\n", "\t\tx();\n"),
    ("go/s{z}/p{k}.go", "package s{z}\nimport \"fmt\"\nimport (\n\t\"example.org/m/go/s{z1}\"\n\tx \"example.org/m/none\"\n)\nfunc Run() {{\n\tif a && b {{\n{body}\t}}\n}}\nfunc helper() {{\n}}\n", "\t\tx()\n"),
)


#: Sources in the other languages, by ``p_partkey % 6``, as above.
MORE_SOURCES = (
    ("k/p{k}.kt", "import a.b\nclass P{k}\nfun run(a: Int) {{\n\tif (a > 0 && b) {{\n{body}\t}}\n}}\n", "\t\tx()\n"),
    ("php/p{k}.php", "<?php\nuse A\\B;\nclass P{k} {{\n\tpublic function run($a) {{\n\t\tif ($a || $b) {{\n{body}\t\t}}\n\t}}\n}}\n", "\t\t\tx();\n"),
    ("cs/p{k}.cs", "using System;\npublic class P{k} {{\n\tpublic int Run(int a) {{\n\t\twhile (a > 0 && b) {{\n{body}\t\t}}\n\t}}\n}}\n", "\t\t\tx();\n"),
    ("cpp/p{k}.cpp", "#include <a>\n/* one\ntwo */\nint run(int a) {{\n\tif (a || b) {{\n{body}\t}}\n}}\n", "\t\tx();\n"),
    ("sw/p{k}.swift", "import Foundation\n\npublic func run() {{\n\tif a && b {{\n{body}\t}}\n}}\n", "\t\tx()\n"),
    ("js/p{k}.js", "import x from './y' // why\nexport function run() {{\n\tif (a && b) {{\n{body}\t}}\n}}\n", "\t\tx()\n"),
)
#: Manifests by ``p_partkey % 7``.
PART_MANIFESTS = (
    ("m{k}/package.json", '{{"name": "x", "dependencies": {{"p{k}": "^{z}.1"}}, "devDependencies": {{"test-it": "2"}}}}'),
    ("m{k}/composer.json", '{{"require": {{"v/p{k}": "{z}.0"}}, "require-dev": {{}}}}'),
    ("m{k}/go.mod", "module x\n\nrequire (\n\texample.org/p{k} v1.{z}.0\n\texample.org/q v0.1.0 // indirect\n)\n\nrequire example.org/r v2.0.0\n"),
    ("m{k}/Cargo.toml", '[package]\nname = "x"\n\n[dependencies]\np{k} = "1.{z}"\n\n[dev-dependencies]\nq = {{ version = "2" }}\n'),
    ("m{k}/pom.xml", '<project xmlns="http://maven.apache.org/POM/4.0.0"><dependencies><dependency><groupId>g</groupId><artifactId>p{k}</artifactId><version>{z}.2</version></dependency></dependencies></project>'),
    ("m{k}/requirements.txt", "# pinned\np{k}=={z}\nq[extra] >=2 ; python_version > '3'\n-r other.txt\n\n"),
    ("m{k}/pyproject.toml", '[project]\nname = "x"\ndependencies = ["p{k}>={z}"]\n'),
)


def _filled(pattern: str, values: dict[str, Column]) -> Column:
    """The pattern with its names replaced by columns."""
    parts = [x for text, name, _, _ in Formatter().parse(pattern) for x in ([F.lit(text)] if text else []) + ([values[name]] if name else [])]
    return F.concat(*parts)


def part_files(spark: SparkSession, sf_dir: str, sources: tuple[tuple[str, str, str], ...] = PART_SOURCES) -> DataFrame:
    """Each part as a source file, and a ``go.mod``: ``repo_id``, ``path``, ``language``, ``content``."""
    k, z = F.col("p_partkey"), F.col("p_size") % 3
    values = {"k": k, "k6": k + 6, "k12": k + 12, "z": z, "z1": (z + 1) % 3}
    path, content = F.lit(None).cast("string"), F.lit(None).cast("string")
    for m, (place, source, line) in enumerate(sources):
        own = k % len(sources) == m
        path = F.when(own, _filled(place, values)).otherwise(path)
        content = F.when(own, _filled(source, values | {"body": F.repeat(F.lit(line), (z + 1).cast("int"))})).otherwise(content)
    files = table(spark, sf_dir, "part").select(path.alias("path"), content.alias("content"))
    files = files.unionByName(spark.range(1).select(F.lit("go.mod").alias("path"), F.lit("module example.org/m\n").alias("content")))
    return files.select(F.lit(1).alias("repo_id"), "path", language_of(F.col("path")).alias("language"), "content")


def part_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a manifest that names it: ``repo_id``, ``path``, ``content``."""
    files = part_files(spark, sf_dir, tuple((path, content, "") for path, content in PART_MANIFESTS))
    return files.where("path <> 'go.mod'").select("repo_id", "path", "content")


def part_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a file of its brand, named by its size."""
    names = ("main.go", "helper.go", "index.ts", "main.py", "Main.java", "domain.py", "notes.main.go")
    name = F.element_at(F.array(*[F.lit(x) for x in names]), (F.col("p_size") % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_partkey", name).alias("path"))
