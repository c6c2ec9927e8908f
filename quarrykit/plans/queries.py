"""Queries over the driver's tables, each with the DuckDB SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrykit.digraph import reachable
from quarrykit.functions.code import code_metrics, line_counts
from quarrykit.functions.paths import base_name, size_label
from quarrykit.iterate import new_path, stored
from quarrykit.operators import catalog, content_index, duplicates, export, graph, history, search
from quarrykit.plans import adapters as A
from quarrykit.sources import manifests

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

EVENTS = """commits AS (SELECT event_id AS hash, user_id::VARCHAR AS author, user_id::VARCHAR AS email, event_type AS message, ts AS date,
  floor(value)::BIGINT AS insertions, coalesce(json_extract_string(props, '$.k')::BIGINT, 0) AS deletions FROM events)"""
ORDERS = """commits AS (SELECT o_orderkey AS hash, o_custkey::VARCHAR AS author, o_custkey::VARCHAR AS email, o_orderpriority AS message, o_orderdate AS date FROM orders),
changes AS (SELECT l_orderkey AS hash, l_partkey AS path, trunc(l_quantity)::BIGINT AS added, l_linenumber::BIGINT AS deleted FROM lineitem)"""
FILES = r"""raw AS (SELECT doc_id AS file_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, lang AS language, n_chars AS size, coalesce(text, '') AS content FROM documents),
files AS (SELECT *, regexp_extract(path, '[^/]*$') AS name, regexp_replace(path, '/[^/]*$', '') AS folder, 'txt' AS extension,
  len(string_split(content, chr(10)))::BIGINT AS lines_total,
  len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^[\s\x{85}\x{A0}]*$')))::BIGINT AS lines_blank,
  len(list_filter(string_split(content, chr(10)), lambda x: ltrim(x) LIKE '#%'))::BIGINT AS lines_comment FROM raw),
code AS (SELECT *, lines_total - lines_blank - lines_comment AS lines_code FROM files)"""
PAGES = r"""paths AS (SELECT page_id, html, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages),
tree AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, regexp_extract(path, '[^/]*$') AS name, length(path) - length(replace(path, '/', '')) AS depth FROM paths),
links AS (SELECT page_id, host, (generate_subscripts(specs, 1) - 1)::INTEGER AS ordinal, unnest(specs) AS spec FROM
  (SELECT page_id, split_part(path, '/', 1) AS host, regexp_extract_all(html, 'href="([^"]+)"', 1) AS specs FROM paths)),
named AS (SELECT *, '/' || lower(substr(word, 1, 1)) || '/' || lower(substr(word, 1, 6)) AS tail FROM
  (SELECT page_id, ordinal, spec, regexp_extract(host, '[^.]+\.[^.]+$') AS domain, regexp_replace(regexp_replace(spec, '^/+', ''), '[/?#].*$', '') AS word FROM links) WHERE word <> ''),
owned AS (SELECT page_id, domain || tail AS path FROM named WHERE ordinal = 0),
site AS (SELECT DISTINCT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder FROM owned),
tries AS (SELECT page_id, ordinal, 0 AS rank, domain || tail AS path FROM named
  UNION ALL SELECT page_id, ordinal, k, first || tail FROM named, (VALUES (1, 'example.com'), (2, 'example.net'), (3, 'example.org')) t(k, first)),
resolved AS (SELECT page_id, ordinal, arg_min(path, rank) AS to_file FROM tries SEMI JOIN site USING (path) GROUP BY ALL),
imports AS (SELECT owned.path AS from_file, to_file FROM resolved JOIN owned USING (page_id)),
entries AS (SELECT DISTINCT path FROM owned WHERE page_id IN (SELECT page_id FROM paths WHERE path LIKE '%.html'))"""
GRAPH = PAGES + r""",
reached AS (SELECT path FROM entries UNION SELECT to_file FROM reached JOIN imports ON path = from_file),
crossing AS (SELECT x.folder AS source, y.folder AS target FROM imports JOIN site x ON x.path = from_file JOIN site y ON y.path = to_file WHERE x.folder <> y.folder),
edges AS (SELECT DISTINCT source, target FROM crossing),
closure AS (SELECT source, target FROM edges UNION SELECT c.source, e.target FROM closure c JOIN edges e ON c.target = e.source)"""
SOURCES = r"""parts AS (SELECT p_partkey AS k, (p_size % 3)::BIGINT AS z, p_partkey % 6 AS m FROM part),
sources AS (SELECT *, CASE m WHEN 0 THEN 'web/s' || z || '/p' || k || '.ts' WHEN 1 THEN 'src/s' || z || '/p' || k || '.py' WHEN 2 THEN 'src/p' || k || '.rs'
  WHEN 3 THEN 'src/main/java/org/s' || z || '/P' || k || '.java' WHEN 4 THEN 'c/s' || z || '/p' || k || '.c' ELSE 'go/s' || z || '/p' || k || '.go' END AS path FROM parts),
-- what each source has: lines beyond z, comments, blanks, imports, exports, functions; lines of a second function; levels of indentation a body line has, all others', lines that have one, beyond z; block comments of several lines stay in measures
shapes(m, language, more, lines_comment, lines_blank, imports, exports, func_count, second, steep, levels, solid) AS (VALUES
  (0, 'TypeScript', 11, 3, 0, 2, 1, 2, 3, 2, 2, 9), (1, 'Python', 7, 0, 1, 2, 1, 1, 0, 3, 3, 5), (2, 'Rust', 7, 0, 0, 2, 1, 1, 0, 2, 2, 6),
  (3, 'Java', 9, 0, 0, 2, 2, 1, 0, 3, 6, 8), (4, 'C', 8, 0, 0, 3, 0, 1, 0, 2, 2, 7), (5, 'Go', 13, 0, 0, 3, 1, 2, 2, 2, 4, 12))"""
BLANK = r"[\t\x0b\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*"
RUNS = r"""split AS (SELECT doc_id AS file_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS number FROM documents),
lines AS (SELECT file_id, number, lower(regexp_replace(line, '^[\s\x{85}\x{A0}]+|[\s\x{85}\x{A0}]+$', '', 'g')) AS text FROM split),
solid AS (SELECT *, (row_number() OVER (PARTITION BY file_id ORDER BY number) - 1)::INTEGER AS index FROM lines WHERE text <> ''),
windows AS (SELECT file_id, index AS start, number AS first, list(text) OVER w AS texts, last(number) OVER w AS last FROM solid
  WINDOW w AS (PARTITION BY file_id ORDER BY index ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
runs AS (SELECT file_id, start, first, last, array_to_string(texts, chr(10)) AS fragment FROM windows WHERE len(texts) = 3),
usable AS (SELECT file_id, fragment FROM runs QUALIFY count(*) OVER (PARTITION BY fragment) BETWEEN 2 AND 30),
shared AS (SELECT x.file_id AS a, y.file_id AS b, count(*) AS shared FROM usable x JOIN usable y ON x.fragment = y.fragment AND x.file_id < y.file_id GROUP BY ALL),
sizes AS (SELECT file_id, count(*) AS n FROM runs GROUP BY file_id),
pairs AS (SELECT a, b, shared, 2 * shared / (x.n + y.n) AS similarity FROM shared JOIN sizes x ON a = x.file_id JOIN sizes y ON b = y.file_id WHERE 2 * shared / (x.n + y.n) >= 0.6),
both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
walk AS (SELECT a AS node, a AS seen FROM both_ways UNION SELECT w.node, e.b FROM walk w JOIN both_ways e ON w.seen = e.a),
members AS (SELECT node AS file_id, min(seen) AS group_id FROM walk GROUP BY node),
grouped AS (SELECT r.*, coalesce(group_id, -1 - r.file_id) AS group_id FROM runs r LEFT JOIN members m ON r.file_id = m.file_id),
inside AS (SELECT * FROM grouped WINDOW f AS (PARTITION BY fragment) QUALIFY count(*) OVER f > 1 AND min(group_id) OVER f = max(group_id) OVER f AND min(group_id) OVER f >= 0),
counted AS (SELECT group_id, count(DISTINCT file_id) AS file_count FROM inside GROUP BY group_id HAVING count(DISTINCT file_id) > 1)"""


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {EVENTS} SELECT strftime(date, '%Y-%m-%d') AS day, count(*) AS commits FROM commits GROUP BY day")
def heatmap_daily(spark, d):
    return history.heatmap_daily(A.event_commits(spark, d))


@query(f"WITH {EVENTS} SELECT (i // 24)::INTEGER AS weekday, (i % 24)::INTEGER AS hour, count(hash) AS commits FROM range(168) t(i) LEFT JOIN commits ON dayofweek(date) * 24 + hour(date) = i GROUP BY ALL")
def heatmap_hourly(spark, d):
    return history.heatmap_hourly(A.event_commits(spark, d))


@query(f"WITH {EVENTS} SELECT count(*) AS total, strftime(min(date), '%Y-%m-%d') AS first_day, strftime(max(date), '%Y-%m-%d') AS last_day FROM commits")
def heatmap_range(spark, d):
    return history.heatmap_range(A.event_commits(spark, d))


STREAKS = """days AS (SELECT DISTINCT email, date::DATE AS day FROM commits),
islands AS (SELECT email, day, day - row_number() OVER (PARTITION BY email ORDER BY day)::INTEGER AS island FROM days),
streaks AS (SELECT email, min(day)::VARCHAR AS start_day, max(day)::VARCHAR AS end_day, count(*) AS days FROM islands GROUP BY email, island)"""


@query(f"WITH {EVENTS}, {STREAKS} SELECT * FROM streaks")
def streaks_all(spark, d):
    return history.streaks(A.event_commits(spark, d))


@query(f"""WITH {EVENTS}, {STREAKS}, longest AS (SELECT * FROM streaks QUALIFY row_number() OVER (PARTITION BY email ORDER BY days DESC, start_day) = 1),
latest AS (SELECT * FROM streaks QUALIFY row_number() OVER (PARTITION BY email ORDER BY start_day DESC) = 1),
active AS (SELECT email, count(*) AS active_days FROM days GROUP BY email), totals AS (SELECT email, count(*) AS commits FROM commits GROUP BY email)
SELECT email, active_days, commits, longest.start_day AS longest_start, longest.days AS longest_days, latest.start_day AS current_start, latest.days AS current_days
FROM active JOIN totals USING (email) JOIN longest USING (email) JOIN latest USING (email)""")
def streaks_summary(spark, d):
    return history.streak_summary(A.event_commits(spark, d))


CONTRIBUTORS = """board AS (SELECT email, arg_max(author, (date, hash)) AS name, count(*) AS commits, sum(insertions)::BIGINT AS insertions, sum(deletions)::BIGINT AS deletions,
  min(date) AS first_commit_at, max(date) AS last_commit_at FROM commits GROUP BY email)"""


@query(f"WITH {EVENTS}, {CONTRIBUTORS} SELECT * FROM board")
def leaderboard(spark, d):
    return history.leaderboard(A.event_commits(spark, d))


@query(f"WITH {EVENTS}, {CONTRIBUTORS} SELECT name AS label, commits FROM board ORDER BY commits DESC, email LIMIT 10")
def ownership_top10(spark, d):
    return history.top_contributors(A.event_commits(spark, d))


ROLLUP = """rolled AS (SELECT c.*, coalesce(n, 0)::BIGINT AS files_changed, coalesce(ins, 0)::BIGINT AS insertions, coalesce(del, 0)::BIGINT AS deletions FROM commits c LEFT JOIN
  (SELECT hash, count(*) AS n, sum(added) AS ins, sum(deleted) AS del FROM changes GROUP BY hash) s USING (hash))"""


@query(f"WITH {ORDERS}, {ROLLUP} SELECT * FROM rolled")
def commit_rollup(spark, d):
    return history.commit_rollup(A.order_commits(spark, d), A.line_changes(spark, d))


@query(f"WITH {ORDERS}, {ROLLUP}, commits2 AS (SELECT * FROM rolled), {CONTRIBUTORS.replace('FROM commits', 'FROM commits2')} SELECT * FROM board")
def contributor_rollup(spark, d):
    return history.contributors(history.commit_rollup(A.order_commits(spark, d), A.line_changes(spark, d)))


@query(f"WITH {EVENTS} SELECT * FROM commits ORDER BY date DESC, hash DESC LIMIT 50")
def commit_feed(spark, d):
    return history.commit_feed(A.event_commits(spark, d))


@query(f"WITH {ORDERS}, {ROLLUP} SELECT *, insertions + deletions AS changed FROM rolled ORDER BY changed DESC, hash LIMIT 20")
def largest_commits(spark, d):
    return history.largest_commits(history.commit_rollup(A.order_commits(spark, d), A.line_changes(spark, d)))


HISTORY = """history AS (SELECT path, count(*) AS commits, min(date) AS first_commit_at, max(date) AS last_commit_at, arg_max(author, (date, hash)) AS author
  FROM changes JOIN commits USING (hash) GROUP BY path)"""


@query(f"WITH {ORDERS}, {HISTORY} SELECT * FROM history")
def file_history(spark, d):
    return history.file_history(A.order_commits(spark, d), A.line_changes(spark, d))


ATTRIBUTED = """attributed AS (SELECT p_partkey AS path, p_brand AS language, coalesce(commits, 0) AS commits, coalesce(author, '') AS author, first_commit_at, last_commit_at
  FROM part LEFT JOIN history ON p_partkey = path)"""


def _attributed(spark, d):
    parts = A.table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("language"))
    return history.attribute_files(parts, history.file_history(A.order_commits(spark, d), A.line_changes(spark, d)))


@query(f"WITH {ORDERS}, {HISTORY}, {ATTRIBUTED} SELECT * FROM attributed")
def file_attribution(spark, d):
    return _attributed(spark, d)


@query(f"WITH {ORDERS}, {HISTORY}, {ATTRIBUTED} SELECT author, count(*) AS files, round(count(*) / sum(count(*)) OVER (), 9) AS share FROM attributed WHERE author <> '' GROUP BY author")
def ownership(spark, d):
    return history.ownership(_attributed(spark, d)).withColumn("share", F.round("share", 9))


@query(f"""WITH {EVENTS}, daily AS (SELECT strftime(date, '%Y-%m-%d') AS day, count(*) AS commits FROM commits GROUP BY day)
SELECT day, commits, CASE WHEN commits / max(commits) OVER () > 0.66 THEN 3 WHEN commits / max(commits) OVER () > 0.33 THEN 2 ELSE 1 END AS level, (row_number() OVER (ORDER BY day) - 1) // 7 AS week FROM daily""")
def heat_level(spark, d):
    return history.heat_levels(history.heatmap_daily(A.event_commits(spark, d)))


@query(f"""WITH {EVENTS}, daily AS (SELECT strftime(date, '%Y-%m-%d') AS day, count(*) AS commits FROM commits GROUP BY day),
weeks AS (SELECT *, (row_number() OVER (ORDER BY day) - 1) // 7 AS week FROM daily) SELECT week, min(day) AS first_day, count(*) AS days, sum(commits)::BIGINT AS commits FROM weeks GROUP BY week""")
def weeks_of_seven(spark, d):
    days = history.heat_levels(history.heatmap_daily(A.event_commits(spark, d)))
    return days.groupBy("week").agg(F.min("day").alias("first_day"), F.count("*").alias("days"), F.sum("commits").alias("commits"))


@query(f"""WITH {FILES} SELECT count(*) AS files, sum(size)::BIGINT AS size, sum(lines_total)::BIGINT AS lines_total, sum(lines_code)::BIGINT AS lines_code, sum(lines_comment)::BIGINT AS lines_comment,
sum(lines_blank)::BIGINT AS lines_blank, count_if(lines_total = 0)::BIGINT AS zero_line_files, (SELECT count(*) FROM events) AS commits, (SELECT count(*) FROM part) AS dependencies FROM code""")
def repo_summary(spark, d):
    return catalog.repository_summary(A.document_files(spark, d), commits=A.table(spark, d, "events"), dependencies=A.table(spark, d, "part"))


DECISIONS = r"""measured AS (SELECT *, 1 + len(regexp_extract_all(t, '\b(?:if|for|while|switch|catch|case|do|else\s+if)\b')) + len(regexp_extract_all(t, '&&|\|\||\?')) AS complexity, len(regexp_extract_all(t, '(?m)^\s*import\s')) AS imports
  FROM (SELECT *, regexp_replace(regexp_replace(content, '/\*.*?\*/', ' ', 'g'), '//[^\n]*', chr(10), 'g') AS t FROM code))"""


def _measured(spark, d):
    """Documents, measured as if they were Kotlin."""
    files = A.document_files(spark, d).withColumn("m", code_metrics("content", F.lit("Kotlin")))
    return files.select("*", *[f"m.{x}" for x in ("complexity", "imports", "exports", "func_count")]).drop("m")


@query(f"""WITH {FILES}, {DECISIONS} SELECT sum(lines_total)::BIGINT AS lines_total, sum(lines_code)::BIGINT AS lines_code, sum(lines_blank)::BIGINT AS lines_blank, sum(size)::BIGINT AS size,
max(lines_total) AS max_loc, sum(complexity)::BIGINT AS complexity, max(complexity)::BIGINT AS max_complexity, sum(imports)::BIGINT AS imports FROM measured""")
def metrics_totals(spark, d):
    return catalog.metrics_totals(_measured(spark, d)).select("lines_total", "lines_code", "lines_blank", "size", "max_loc", "complexity", "max_complexity", "imports")


@query(f"""WITH {FILES} SELECT language, count(*) AS files, sum(lines_total)::BIGINT AS loc, sum(lines_code)::BIGINT AS code, sum(lines_comment)::BIGINT AS comments, sum(lines_blank)::BIGINT AS blank,
sum(size)::BIGINT AS size FROM code WHERE language <> '' GROUP BY language""")
def language_rollup(spark, d):
    return catalog.language_rollup(A.document_files(spark, d))


@query(f"WITH {FILES} SELECT language, sum(lines_code)::BIGINT AS code FROM code WHERE language <> '' GROUP BY language ORDER BY code DESC, language LIMIT 8")
def top_languages(spark, d):
    return catalog.top_languages(A.document_files(spark, d))


@query(f"WITH {PAGES} SELECT path, depth FROM tree WHERE depth > 0 ORDER BY depth DESC, path LIMIT 1")
def deepest_path(spark, d):
    return catalog.deepest_file(A.page_paths(spark, d))


@query(f"WITH {FILES} SELECT path, name, folder, extension, language, size, lines_code FROM code WHERE language = 'en'")
def file_list_sorted(spark, d):
    files = catalog.filter_files(A.document_files(spark, d), language="en")
    return catalog.list_files(files, "loc").select("path", "name", "folder", "extension", "language", "size", "lines_code")


@query(f"WITH {FILES} SELECT path, lines_code, (SELECT count(*) FROM files) AS total FROM code ORDER BY lines_code DESC, path LIMIT 25 OFFSET 50")
def file_page(spark, d):
    return catalog.page_with_total(A.document_files(spark, d), 25, 50, "loc").select("path", "lines_code", "total")


@query(f"WITH {FILES} SELECT path, lines_total FROM code WHERE language <> '' AND lines_total > 0")
def ranked_files(spark, d):
    return catalog.ranked_files(A.document_files(spark, d)).select("path", "lines_total")


@query(f"WITH {FILES} SELECT DISTINCT split_part(substr(folder, 6), '/', 1) AS child FROM files WHERE folder LIKE 'src1/%' AND length(folder) > 5")
def tree_children(spark, d):
    return catalog.tree_children(A.document_files(spark, d), "src1")


@query(f"WITH {PAGES} SELECT DISTINCT folder FROM tree WHERE folder <> ''")
def distinct_folders(spark, d):
    return catalog.folders(A.page_paths(spark, d))


def _parts(spark, d):
    return A.table(spark, d, "part").select(F.concat("p_brand", F.lit("/"), "p_partkey").alias("path"), F.col("p_name").alias("name"), F.lower("p_type").alias("extension"))


PARTS = "parts AS (SELECT p_brand || '/' || p_partkey AS path, p_name AS name, lower(p_type) AS extension FROM part)"


@query(f"WITH {PARTS} SELECT * FROM parts WHERE contains(lower(name), lower('An')) ORDER BY path LIMIT 51")
def search_name_ci(spark, d):
    return catalog.search_names(_parts(spark, d), "An")


@query(f"WITH {PARTS} SELECT * FROM parts WHERE contains(name, 'an') ORDER BY path LIMIT 51")
def search_name_cs(spark, d):
    return catalog.search_names(_parts(spark, d), "an", case_sensitive=True)


@query(f"WITH {FILES} SELECT path, language FROM files WHERE extension = 'txt' AND contains(lower(folder), 'src2/') ORDER BY path LIMIT 51")
def search_ext(spark, d):
    files = catalog.filter_files(A.document_files(spark, d), extension="txt")
    return catalog.search_names(files, "src2/", "folder").select("path", "language")


@query(f"WITH {PAGES} SELECT page_id, path FROM tree WHERE contains(lower(folder), 'example.net') ORDER BY path LIMIT 51")
def search_folder(spark, d):
    return catalog.search_names(A.page_paths(spark, d), "Example.NET", "folder").orderBy("path").select("page_id", "path").where("path IS NOT NULL")


def _hits(pattern: str, where: str = "TRUE") -> str:
    return f"""WITH {FILES}, each_line AS (SELECT file_id, path, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1)::BIGINT AS number FROM files WHERE {where}),
hits AS (SELECT * FROM each_line WHERE regexp_matches(text, '{pattern}') QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY number) <= 50) SELECT file_id, path, number, substr(text, 1, 240) AS text FROM hits"""


_served: dict[tuple, str] = {}


def _index(spark, d):
    """The written index of all documents, made by the first query that needs it and served from then on, as long as the table stays as it is."""
    changed = A.table(spark, d, "documents").agg(F.max("_metadata.file_modification_time"), F.count("*")).first()
    key = (spark.sparkContext.applicationId, d, *changed)
    if key not in _served:
        path = new_path(spark, "index")
        content_index.write_index(A.document_files(spark, d).select("file_id", "content"), path)
        _served[key] = path
    return _served[key]


TOKENS = "string_split_regex(lower(content), '[^\\p{L}\\p{N}]+')"


@query(_hits("(?i)disgusting", f"list_contains({TOKENS}, 'disgusting')"))
def search_content(spark, d):
    return search.search_content(A.document_files(spark, d), "Disgusting", index=content_index.open_index(spark, _index(spark, d), "Disgusting"))


@query(_hits(r"(?i)under the", f"list_has_all({TOKENS}, ['under', 'the'])"))
def search_words(spark, d):
    return search.search_content(A.document_files(spark, d), "under the", index=content_index.open_index(spark, _index(spark, d), "under the"))


@query(_hits(r"(?i)example\.com", f"contains(' ' || array_to_string({TOKENS}, ' ') || ' ', ' example com ')"))
def search_phrase(spark, d):
    return search.search_content(A.document_files(spark, d), "example.com", index=content_index.open_index(spark, _index(spark, d), "example.com"))


@query(f"""WITH {FILES}, words AS (SELECT file_id, array_to_string(list_transform({TOKENS}, lambda x: strip_accents(x)), ' ') AS w FROM files)
SELECT file_id FROM words WHERE contains(' ' || w || ' ', ' fur ') AND contains(' ' || w || ' ', ' in der ')""")
def index_files(spark, d):
    """Files by a phrase and a word without its diacritics, from the written index alone."""
    return search.matching_files(content_index.open_index(spark, _index(spark, d), "FÜR in-der"), "FÜR in-der")


@query(_hits("(?i)lic[a-z]+ under the [A-Z]"))
def search_regex(spark, d):
    return search.search_content(A.document_files(spark, d), "lic[a-z]+ under the [A-Z]", regex=True)


@query(_hits("(^|[^0-9A-Za-z_])MIT([^0-9A-Za-z_]|$)"))
def search_whole_word(spark, d):
    return search.search_content(A.document_files(spark, d), "MIT", regex=True, whole_word=True, case_sensitive=True)


@query(f"""WITH {FILES}, each_token AS (SELECT file_id, unnest(t) AS token, generate_subscripts(t, 1) - 1 AS position FROM
  (SELECT file_id, list_filter(string_split_regex(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM files))
SELECT token, file_id, count(*) AS n, min(position)::BIGINT AS first_position FROM each_token GROUP BY ALL""")
def inverted_index(spark, d):
    index = search.build_index(A.document_files(spark, d), folded=False)
    return index.select("token", "file_id", F.size("positions").cast("long").alias("n"), F.col("positions")[0].cast("long").alias("first_position"))


def _lines(spark, d):
    return duplicates.plain_lines(A.document_files(spark, d))


def _runs(spark, d):
    return stored(duplicates.shingles(_lines(spark, d), 3), "runs")


@query(f"WITH RECURSIVE {RUNS} SELECT file_id, number::BIGINT AS number, index::BIGINT AS index, text FROM solid")
def normalized_lines(spark, d):
    return duplicates.each_line(_lines(spark, d)).select("file_id", F.col("number").cast("long").alias("number"), F.col("index").cast("long").alias("index"), "text")


@query(f"WITH RECURSIVE {RUNS} SELECT file_id, start::BIGINT AS start, first::BIGINT AS first, last::BIGINT AS last, fragment FROM runs")
def shingles(spark, d):
    runs = duplicates.shingles(_lines(spark, d), 3)
    return runs.select("file_id", *[F.col(x).cast("long").alias(x) for x in ("start", "first", "last")], "fragment")


@query(f"WITH RECURSIVE {RUNS} SELECT a, b, shared, round(similarity, 9) AS similarity FROM pairs")
def duplicate_pairs(spark, d):
    return duplicates.similar_pairs(_runs(spark, d)).withColumn("similarity", F.round("similarity", 9))


@query(f"WITH RECURSIVE {RUNS} SELECT a, b, floor(least(similarity, 1) * 100 + 0.5)::BIGINT AS percent FROM pairs")
def similarity_percent(spark, d):
    return duplicates.in_percent(duplicates.similar_pairs(_runs(spark, d))).select("a", "b", "percent")


@query(f"""WITH RECURSIVE {RUNS}, top AS (SELECT group_id, fragment FROM inside GROUP BY group_id, fragment QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, fragment) = 1),
best AS (SELECT group_id, max(similarity) AS similarity FROM pairs JOIN members ON a = file_id GROUP BY group_id)
SELECT group_id, fragment, 3::BIGINT AS lines, round(similarity, 9) AS similarity, file_count FROM counted JOIN top USING (group_id) JOIN best USING (group_id)""")
def duplicate_groups(spark, d):
    runs = _runs(spark, d)
    return duplicates.duplicate_groups(runs, duplicates.similar_pairs(runs), 3).withColumn("similarity", F.round("similarity", 9))


@query(f"""WITH RECURSIVE {RUNS}, starts AS (SELECT DISTINCT group_id, file_id, start, first, last FROM inside SEMI JOIN counted USING (group_id)),
apart AS (SELECT *, coalesce(start - lag(start) OVER w >= 3, true) AS new FROM starts WINDOW w AS (PARTITION BY group_id, file_id ORDER BY start)),
islands AS (SELECT *, count_if(new) OVER (PARTITION BY group_id, file_id ORDER BY start) AS island FROM apart)
SELECT group_id, file_id, min(first)::BIGINT AS start_line, max(last)::BIGINT AS end_line FROM islands GROUP BY group_id, file_id, island""")
def duplicate_blocks(spark, d):
    runs = _runs(spark, d)
    blocks = duplicates.duplicate_blocks(runs, duplicates.similar_pairs(runs), 3)
    return blocks.select("group_id", "file_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@query(f"WITH {PAGES} SELECT page_id, ordinal, spec FROM links")
def link_specs(spark, d):
    return A.page_links(spark, d).select("page_id", "ordinal", "spec")


def _resolved(spark, d):
    return graph.resolve_first(A.page_links(spark, d), A.page_files(spark, d), ["page_id", "ordinal"])


def _edges(spark, d):
    return stored(A.page_edges(spark, d, _resolved(spark, d)), "edges")


def _folder_graph(spark, d):
    return graph.folder_graph(_edges(spark, d), A.page_files(spark, d).select("folder"))


@query(f"WITH {PAGES} SELECT page_id, ordinal, spec, to_file FROM links LEFT JOIN resolved USING (page_id, ordinal)")
def link_resolution(spark, d):
    return _resolved(spark, d).select("page_id", "ordinal", "spec", "to_file")


@query(f"WITH {PAGES} SELECT page_id, ordinal, spec FROM links ANTI JOIN resolved USING (page_id, ordinal)")
def unresolved_links(spark, d):
    found = _resolved(spark, d).withColumn("resolved", F.col("to_file").isNotNull())
    return graph.unresolved(found).select("page_id", "ordinal", "spec")


@query(f"WITH RECURSIVE {GRAPH} SELECT source, target FROM crossing")
def folder_graph(spark, d):
    return _folder_graph(spark, d)


@query(f"WITH RECURSIVE {GRAPH} SELECT path AS node FROM reached")
def reachable_nodes(spark, d):
    edges = _edges(spark, d).select(F.col("from_file").alias("source"), F.col("to_file").alias("target"))
    return reachable(stored(edges.distinct(), "steps"), A.page_entries(spark, d).select(F.col("path").alias("node")))


@query(f"WITH RECURSIVE {GRAPH} SELECT path FROM site ANTI JOIN reached USING (path)")
def dead_nodes(spark, d):
    return graph.dead_files(A.page_files(spark, d), _edges(spark, d), A.page_entries(spark, d))


@query(f"WITH RECURSIVE {GRAPH} SELECT DISTINCT folder FROM site WHERE folder NOT IN (SELECT target FROM edges) AND folder NOT IN (SELECT folder FROM site SEMI JOIN entries USING (path))")
def unused_nodes(spark, d):
    return graph.unused_folders(A.page_files(spark, d), _folder_graph(spark, d), A.page_entries(spark, d))


@query(f"WITH {PAGES} SELECT DISTINCT from_file AS node FROM imports UNION SELECT to_file FROM imports")
def graph_nodes(spark, d):
    return graph.nodes(_edges(spark, d))


@query(f"""WITH RECURSIVE {GRAPH}, mutual AS (SELECT a.source AS node, a.target AS other FROM closure a JOIN closure b ON a.source = b.target AND a.target = b.source),
named_ AS (SELECT node, min(other) AS component, count(DISTINCT other) AS n FROM mutual GROUP BY node) SELECT node, component, n AS size FROM named_ WHERE n > 1""")
def cycles(spark, d):
    return graph.cycles(_folder_graph(spark, d)).select("node", "component", "size")


@query(f"""WITH RECURSIVE {GRAPH}, pairs AS (SELECT DISTINCT from_file AS source, to_file AS target FROM imports),
reach AS (SELECT source, target FROM pairs UNION SELECT r.source, p.target FROM reach r JOIN pairs p ON r.target = p.source),
same AS (SELECT a.source AS node, min(a.target) AS other FROM reach a JOIN reach b ON a.source = b.target AND a.target = b.source GROUP BY a.source),
names AS (SELECT source AS node FROM pairs UNION SELECT target FROM pairs), groups AS (SELECT node, coalesce(least(other, node), node) AS part FROM names LEFT JOIN same USING (node)),
links_ AS (SELECT DISTINCT x.part AS source, y.part AS target FROM pairs JOIN groups x ON source = x.node JOIN groups y ON target = y.node WHERE x.part <> y.part),
longest AS (SELECT part, 0::BIGINT AS layer FROM groups UNION SELECT l.source, d.layer + 1 FROM longest d JOIN links_ l ON l.target = d.part)
SELECT node, max(layer) AS layer FROM groups JOIN longest USING (part) GROUP BY node""")
def import_layers(spark, d):
    return graph.import_layers(_edges(spark, d))


@query("""SELECT o_orderkey::VARCHAR AS path, o_totalprice AS lines_code, (SELECT count(*) FROM orders) AS total FROM orders
ORDER BY o_totalprice DESC, o_orderkey::VARCHAR LIMIT 40 OFFSET (SELECT 3 * count(*) // 4 FROM orders)""")
def deep_page(spark, d):
    """A page three quarters into all orders, read from the ranges of the order that it lies in."""
    files = A.table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("path"), F.col("o_totalprice").alias("lines_code"))
    return catalog.page_with_total(files, 40, 3 * files.count() // 4, "loc", shallow=0)


@query("SELECT p_brand AS manager, count(*) OVER (PARTITION BY p_brand) AS total, p_name AS name, p_type AS scope FROM part")
def dependencies_grouped(spark, d):
    parts = A.table(spark, d, "part").select(F.col("p_brand").alias("manager"), F.col("p_name").alias("name"), F.lit("").alias("version"), F.col("p_type").alias("scope"))
    return catalog.grouped_dependencies(parts).select("manager", "total", "name", "scope")


@query("SELECT p_brand AS manager, count(*) AS dependencies FROM part GROUP BY p_brand")
def manager_counts(spark, d):
    return catalog.manager_counts(A.table(spark, d, "part").select(F.col("p_brand").alias("manager")))


@query(f"WITH {FILES}, sums AS (SELECT sum(lines_code)::BIGINT AS code, sum(lines_comment)::BIGINT AS comment, sum(lines_blank)::BIGINT AS blank FROM code) UNPIVOT sums ON code, comment, blank INTO NAME kind VALUE lines")
def line_composition(spark, d):
    return catalog.line_composition(A.document_files(spark, d))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE format('{:.1f} KiB', round(n_chars / 1024, 1)) END AS label FROM documents")
def bytes_label(spark, d):
    return A.table(spark, d, "documents").select("doc_id", size_label(F.col("n_chars")).alias("label"))


@query(f"WITH {FILES} SELECT path, name, folder, extension, language, size, lines_total, lines_code, lines_comment, lines_blank FROM code")
def export_files(spark, d):
    return export.export_rows("files", A.document_files(spark, d))


@query(f"WITH {EVENTS} SELECT hash, author, email, strftime(date, '%Y-%m-%dT%H:%M:%SZ') AS date, message, insertions, deletions FROM commits")
def export_commits(spark, d):
    return export.export_rows("commits", A.event_commits(spark, d))


@query(f"WITH {FILES}, {DECISIONS} SELECT file_id, complexity::BIGINT AS complexity FROM measured")
def complexity_text(spark, d):
    return _measured(spark, d).select("file_id", "complexity")


@query(rf"""WITH texts AS (SELECT doc_id AS file_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT file_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l FROM texts),
counts AS (SELECT file_id, len(l)::BIGINT AS lines_total, len(list_filter(l, lambda x: regexp_full_match(x, '{BLANK}')))::BIGINT AS lines_blank, len(list_filter(l, lambda x: contains(x, '#')))::BIGINT AS lines_comment FROM lines)
SELECT *, lines_total - lines_blank - lines_comment AS lines_code FROM counts""")
def loc_counts(spark, d):
    return A.document_files(spark, d).select("file_id", line_counts("content", F.lit("Python")).alias("l")).select("file_id", "l.*")


@query(rf"""WITH texts AS (SELECT doc_id AS file_id, regexp_replace(coalesce(text, ''), '#[^\n]*', chr(10), 'g') AS t FROM documents),
depths AS (SELECT file_id, t, list_transform(list_transform(list_filter(string_split(t, chr(10)), lambda x: NOT regexp_full_match(x, '{BLANK}')), lambda x: regexp_extract(x, '^[\t ]*')),
  lambda x: length(x) - length(replace(x, chr(9), '')) + len(regexp_extract_all(x, ' {{4}}'))) AS d FROM texts)
SELECT file_id, (1 + len(regexp_extract_all(t, '\b(?:if|elif|for|while|except|with|match|case)\b')) + len(regexp_extract_all(t, '\b(?:and|or)\b')))::BIGINT AS complexity,
  len(regexp_extract_all(t, '(?m)^\s*(?:import|from\s+\S+\s+import)\s'))::BIGINT AS imports, len(regexp_extract_all(t, '(?m)^(?:def|class)\s'))::BIGINT AS exports,
  round(coalesce(list_avg(d), 0), 9) AS avg_nesting, coalesce(list_max(d), 0)::BIGINT AS max_nesting FROM depths""")
def text_metrics(spark, d):
    measured = A.document_files(spark, d).select("file_id", code_metrics("content", F.lit("Python")).alias("m"))
    return measured.select("file_id", "m.complexity", "m.imports", "m.exports", F.round("m.avg_nesting", 9).alias("avg_nesting"), "m.max_nesting")


@query(f"""WITH {SOURCES} SELECT path, language, z + more AS lines_total, z + more - lines_comment - lines_blank AS lines_code, lines_comment::BIGINT AS lines_comment, lines_blank::BIGINT AS lines_blank
FROM sources JOIN shapes USING (m) UNION ALL SELECT 'go.mod', '', 0, 0, 0, 0""")
def source_lines(spark, d):
    return A.part_files(spark, d).select("path", "language", line_counts("content", "language").alias("l")).select("path", "language", "l.*")


@query(f"""WITH {SOURCES} SELECT path, 3::BIGINT AS complexity, imports::BIGINT AS imports, exports::BIGINT AS exports, func_count::BIGINT AS func_count,
round((z + 5 + CASE m WHEN 0 THEN z ELSE 0 END + second) / func_count, 9) AS avg_func_len, z + 5 AS max_func_len, round((steep * (z + 1) + levels) / (z + 1 + solid), 9) AS avg_nesting, steep::BIGINT AS max_nesting
FROM sources JOIN shapes USING (m)""")
def source_metrics(spark, d):
    measured = A.part_files(spark, d).where("language <> ''").select("path", code_metrics("content", "language").alias("m")).select("path", "m.*")
    return measured.withColumns({x: F.round(x, 9) for x in ("avg_func_len", "avg_nesting")})


@query(f"""WITH {SOURCES}, named AS (SELECT k, z, m, path, lower(language) AS kind FROM sources JOIN shapes USING (m))
SELECT f.path AS from_file, t.path AS to_file, f.kind, true AS resolved FROM named f JOIN named t ON t.k = f.k + 6 WHERE f.m < 5 AND (f.m = 2 OR t.z = f.z)
UNION ALL SELECT f.path, t.path, f.kind, true FROM named f JOIN named t ON t.k = f.k + 12 WHERE f.m IN (0, 4) AND t.z = 0
UNION ALL SELECT path, 'go/s' || (z + 1) % 3, kind, (z + 1) % 3 IN (SELECT z FROM named WHERE m = 5) FROM named WHERE m = 5
UNION ALL SELECT path, 'none', kind, false FROM named WHERE m = 5""")
def source_imports(spark, d):
    return graph.import_edges(A.part_files(spark, d)).drop("repo_id")


@query("""WITH parts AS (SELECT p_partkey AS k, (p_size % 3)::BIGINT AS z, p_partkey % 6 AS m FROM part),
-- lines beyond z, comments, blanks; complexity, imports, exports, functions, lines of the first one (with a blank line before it) and a second one beyond z; indentation of a body line and of all others, lines that have one beyond z, block comments of several lines among them
shapes(m, language, place, ending, more, comments, blanks, complexity, imports, exports, func_count, longest, second, steep, levels, solid) AS (VALUES
  (0, 'Kotlin', 'k', 'kt', 7, 0, 0, 3, 1, 2, 1, 5, NULL, 2, 2, 6), (1, 'PHP', 'php', 'php', 9, 0, 0, 4, 1, 2, 1, 5, NULL, 3, 6, 8), (2, 'C#', 'cs', 'cs', 8, 0, 0, 3, 1, 2, 1, 5, NULL, 3, 6, 7),
  (3, 'C++', 'cpp', 'cpp', 8, 2, 0, 3, 1, 0, 1, 5, NULL, 2, 2, 7), (4, 'Swift', 'sw', 'swift', 7, 0, 1, 3, 1, 1, 1, 6, NULL, 2, 2, 5), (5, 'JavaScript', 'js', 'js', 6, 1, 0, 3, 1, 1, 2, 6, 3, 2, 2, 5))
SELECT place || '/p' || k || '.' || ending AS path, language, z + more AS lines_total, z + more - comments - blanks AS lines_code, comments::BIGINT AS lines_comment, blanks::BIGINT AS lines_blank,
  complexity::BIGINT AS complexity, imports::BIGINT AS imports, exports::BIGINT AS exports, func_count::BIGINT AS func_count,
  round((z + longest + CASE WHEN second IS NULL THEN 0 ELSE z + second END) / func_count, 9) AS avg_func_len, z + longest AS max_func_len, round((steep * (z + 1) + levels) / (z + 1 + solid), 9) AS avg_nesting, steep::BIGINT AS max_nesting
FROM parts JOIN shapes USING (m)""")
def source_metrics_more(spark, d):
    files = A.part_files(spark, d, A.MORE_SOURCES).where("language <> ''")
    measured = files.select("path", "language", line_counts("content", "language").alias("l"), code_metrics("content", "language").alias("m")).select("path", "language", "l.*", "m.*")
    return measured.withColumns({x: F.round(x, 9) for x in ("avg_func_len", "avg_nesting")})


@query(f"WITH {SOURCES} SELECT path, z + more - lines_comment - lines_blank AS n, z + more AS last FROM sources JOIN shapes USING (m)")
def source_normal_lines(spark, d):
    """Lines of code without comments, as duplicate detection compares them."""
    files = A.part_files(spark, d).where("language <> ''").withColumn("file_id", F.xxhash64("path"))
    counted = duplicates.each_line(duplicates.code_lines(files)).groupBy("file_id").agg(F.count("*").alias("n"), F.max("number").cast("long").alias("last"))
    return files.select("file_id", "path").join(counted, "file_id").select("path", "n", "last")


@query(f"""WITH RECURSIVE {SOURCES}, named AS (SELECT k, z, m, path FROM sources),
steps AS (SELECT f.path AS source, t.path AS target FROM named f JOIN named t ON t.k = f.k + 6 WHERE f.m < 5 AND (f.m = 2 OR t.z = f.z)
  UNION SELECT f.path, t.path FROM named f JOIN named t ON t.k = f.k + 12 WHERE f.m IN (0, 4) AND t.z = 0
  UNION SELECT path, 'go/s' || (z + 1) % 3 FROM named WHERE m = 5 UNION SELECT regexp_extract(path, '^(.*)/[^/]*$', 1), path FROM named),
reached AS (SELECT sources.path FROM sources JOIN part ON k = p_partkey WHERE p_retailprice < 1000 UNION SELECT target FROM reached JOIN steps ON path = source)
SELECT path FROM named ANTI JOIN reached USING (path) UNION ALL SELECT 'go.mod'""")
def source_dead_files(spark, d):
    """Files of parts that imports don't reach from those of cheap parts; Go's lead to folders, and these to their files."""
    files = A.part_files(spark, d)
    cheap = A.table(spark, d, "part").where("p_retailprice < 1000").select(F.concat(F.lit("p"), F.col("p_partkey")).alias("stem"))
    entries = files.withColumn("stem", F.lower(F.substring_index(base_name(F.col("path")), ".", 1))).join(cheap, "stem", "left_semi").select("path")
    return graph.dead_files(files, stored(graph.import_edges(files), "edges"), entries)


@query("""WITH names AS (SELECT p_brand || '/' || p_partkey || '/' || ['main.go', 'helper.go', 'index.ts', 'main.py', 'Main.java', 'domain.py', 'notes.main.go'][p_size % 7 + 1] AS path, p_size % 7 AS m FROM part)
SELECT path FROM names WHERE m IN (0, 2, 3)""")
def entry_points(spark, d):
    return graph.entry_points(A.part_entries(spark, d))


@query("""WITH parts AS (SELECT p_partkey AS k, p_size % 3 AS z, p_partkey % 7 AS m FROM part), made(m, file, manager, name, version, scope) AS (VALUES
  (0, 'package.json', 'npm', 'p#', '^%.1', 'runtime'), (0, 'package.json', 'npm', 'test-it', '2', 'dev'), (1, 'composer.json', 'composer', 'v/p#', '%.0', 'runtime'),
  (2, 'go.mod', 'go', 'example.org/p#', 'v1.%.0', 'direct'), (2, 'go.mod', 'go', 'example.org/q', 'v0.1.0', 'indirect'), (2, 'go.mod', 'go', 'example.org/r', 'v2.0.0', 'direct'),
  (3, 'Cargo.toml', 'cargo', 'p#', '1.%', 'runtime'), (3, 'Cargo.toml', 'cargo', 'q', '2', 'dev'), (4, 'pom.xml', 'maven', 'g:p#', '%.2', 'compile'),
  (5, 'requirements.txt', 'pip', 'p#', '==%', 'runtime'), (5, 'requirements.txt', 'pip', 'q', '>=2', 'runtime'), (6, 'pyproject.toml', 'pip', 'p#', '>=%', 'runtime'))
SELECT 'm' || k || '/' || file AS file_path, manager, replace(name, '#', k::VARCHAR) AS name, replace(version, '%', z::VARCHAR) AS version, scope FROM parts JOIN made USING (m)""")
def manifest_dependencies(spark, d):
    return manifests.dependencies(A.part_manifests(spark, d)).drop("repo_id")


@query(f"""WITH {FILES}, named AS (SELECT *, CASE lang WHEN 'es' THEN NULL WHEN 'fr' THEN '' ELSE lang END AS known FROM code JOIN (SELECT doc_id AS file_id, lang FROM documents) USING (file_id))
SELECT coalesce(known, '') AS language, count(*) AS files, sum(lines_total)::BIGINT AS loc, sum(lines_code)::BIGINT AS code, sum(lines_comment)::BIGINT AS comments, sum(lines_blank)::BIGINT AS blank, sum(size)::BIGINT AS size
FROM named GROUP BY ALL""")
def language_rollup_unknown(spark, d):
    known = F.when(F.col("language") == "fr", "").when(F.col("language") != "es", F.col("language"))
    return catalog.language_rollup(A.document_files(spark, d).withColumn("language", known), unknown=True)


@query(f"""WITH {EVENTS}, {STREAKS}, longest AS (SELECT email, days AS longest_days, start_day AS longest_start FROM streaks QUALIFY row_number() OVER (PARTITION BY email ORDER BY days DESC, start_day) = 1)
SELECT email, longest_days, longest_start FROM longest ORDER BY longest_days DESC, email LIMIT 20""")
def streak_leaders(spark, d):
    return history.streak_leaders(A.event_commits(spark, d)).limit(20).select("email", "longest_days", "longest_start")


@query(f"""WITH {EVENTS}, {CONTRIBUTORS} SELECT name, email, commits, insertions, deletions, strftime(first_commit_at, '%Y-%m-%dT%H:%M:%SZ') AS first_commit_at, strftime(last_commit_at, '%Y-%m-%dT%H:%M:%SZ') AS last_commit_at FROM board""")
def export_contributors(spark, d):
    return export.export_rows("contributors", history.contributors(A.event_commits(spark, d)))


@query(f"""WITH RECURSIVE {RUNS}, top AS (SELECT group_id, fragment FROM inside GROUP BY group_id, fragment QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY count(*) DESC, fragment) = 1),
starts AS (SELECT DISTINCT group_id, file_id, start, first, last FROM inside SEMI JOIN counted USING (group_id)),
apart AS (SELECT *, coalesce(start - lag(start) OVER w >= 3, true) AS new FROM starts WINDOW w AS (PARTITION BY group_id, file_id ORDER BY start)),
islands AS (SELECT *, count_if(new) OVER (PARTITION BY group_id, file_id ORDER BY start) AS island FROM apart),
blocks AS (SELECT group_id, file_id, min(first) AS a, max(last) AS b FROM islands GROUP BY group_id, file_id, island)
SELECT group_id, file_count, string_agg(file_id || ':' || a || '-' || b, ' ' ORDER BY file_id, a) AS blocks FROM counted JOIN top USING (group_id) JOIN blocks USING (group_id) GROUP BY ALL""")
def duplicate_report(spark, d):
    """Groups with their blocks in order of file and line."""
    runs = _runs(spark, d)
    pairs = stored(duplicates.similar_pairs(runs), "pairs")
    nested = duplicates.nested_groups(duplicates.duplicate_groups(runs, pairs, 3), duplicates.duplicate_blocks(runs, pairs, 3))
    shown = F.transform("blocks", lambda x: F.concat(x["file_id"], F.lit(":"), x["start_line"], F.lit("-"), x["end_line"]))
    return nested.select("group_id", "file_count", F.array_join(shown, " ").alias("blocks"))


@query(_hits("(?i)license", "extension = 'txt'"))
def search_extension(spark, d):
    return search.search_content(A.document_files(spark, d), "license", extension=".TXT")


@query("SELECT c_custkey AS repo_id, c_name AS name, max(o_orderdate) AS scanned_at FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL ORDER BY scanned_at DESC, repo_id LIMIT 50")
def recent_repositories(spark, d):
    """Customers as repositories, whose last order is their last scan."""
    scans = A.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("repo_id")).agg(F.max("o_orderdate").alias("scanned_at"))
    return catalog.repositories(A.table(spark, d, "customer").select(F.col("c_custkey").alias("repo_id"), F.col("c_name").alias("name")).join(scans, "repo_id")).limit(50)


@query()
def indent_metrics(spark, d):
    measured = A.document_files(spark, d).select("file_id", code_metrics("content", F.lit("JavaScript")).alias("m"))
    return measured.select("file_id", "m.*")
