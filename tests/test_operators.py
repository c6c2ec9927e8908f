import json
import os
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from quarrykit.digraph import reachable, strong_components
from quarrykit.iterate import components
from quarrykit.operators import catalog, duplicates, export, graph, history, search
from quarrykit.plans.scan import scan
from quarrykit.settings import Settings
from quarrykit.sources import repository
from quarrykit.sources.manifests import parse_manifest
from quarrykit.streaming import activity


def _commits(spark):
    rows = [("h1", "Al", "a@x", "one", "2024-01-01 10:00:00", 10, 0), ("h2", "Al", "a@x", "two", "2024-01-02 11:00:00", 1, 0), ("h3", "Alice", "a@x", "five", "2024-01-05 09:00:00", 1, 1), ("h4", "Bo", "", "x", "2024-01-05 09:00:00", 0, 0)]
    return spark.createDataFrame(rows, "hash string, author string, email string, message string, date string, insertions long, deletions long").withColumn("date", F.to_timestamp_ntz("date"))


def test_streaks_and_board(spark):
    row = history.streak_summary(_commits(spark)).where("email = 'a@x'").first()
    assert (row.longest_start, row.longest_days, row.current_start, row.current_days, row.active_days) == ("2024-01-01", 2, "2024-01-05", 1, 3)
    board = [(r.email, r.name, r.commits) for r in history.leaderboard(_commits(spark)).collect()]
    assert board == [("a@x", "Alice", 3), ("Bo", "Bo", 1)]
    assert history.largest_commits(_commits(spark)).first().message == "one"
    assert history.heatmap_hourly(_commits(spark)).agg(F.count("*"), F.sum("commits")).first()[:] == (168, 4)


def test_results_do_not_hang_on_partitions(spark):
    few, many = (sorted(map(tuple, history.streaks(_commits(spark).repartition(n)).collect())) for n in (1, 8))
    assert few == many


def test_components_and_cycles_on_random_graphs(spark):
    import random

    rnd = random.Random(4)
    pairs = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(30)]
    roots = dict(map(tuple, components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    parent = {x: x for p in pairs for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert roots == {x: find(x) for x in linked}
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (4, 4), (5, 6), (6, 5)], "source long, target long")
    assert dict(map(tuple, strong_components(edges).collect())) == {0: 0, 1: 0, 2: 0, 5: 5, 6: 5}
    assert strong_components(edges.limit(0)).count() == 0
    seeds = spark.createDataFrame([(1,)], "node long")
    assert {r.node for r in reachable(edges, seeds).collect()} == {0, 1, 2, 3}


def _code_file(k, body):
    return (k, f"pkg/{k}.go", "Go", body)


def test_duplicates(spark):
    block = "\n".join(f"step{k}(x)" for k in range(11))
    rows = [_code_file(1, block), _code_file(2, "first()\n" + block), _code_file(3, "\n".join(f"other{k}()" for k in range(11)))]
    files = spark.createDataFrame(rows, "file_id long, path string, language string, content string")
    runs = duplicates.shingles(duplicates.code_lines(files), 6)
    pairs = duplicates.similar_pairs(runs)
    groups, blocks = duplicates.duplicate_groups(runs, pairs), duplicates.duplicate_blocks(runs, pairs)
    group = groups.first()
    assert groups.count() == 1 and group.file_count == 2 and group.similarity >= 0.5
    assert sorted((r.file_id, r.start_line, r.end_line) for r in blocks.collect()) == [(1, 1, 11), (2, 2, 12)]
    assert len(duplicates.nested_groups(groups, blocks).first().blocks) == 2
    starts = spark.createDataFrame([(0, 0, s, s, s + 5) for s in (0, 1, 2, 10)], "group_id long, file_id long, start int, first int, last int")
    assert sorted((r.start_line, r.end_line) for r in duplicates.merge_runs(starts, 6).collect()) == [(0, 7), (10, 15)]


def test_search(spark):
    rows = [(1, "a/main.go", "go", "func Handler() {}\n// café here"), (2, "b/util.go", "go", "handler helper\nHandlers"), (3, "c/x.txt", "txt", "")]
    files = spark.createDataFrame(rows, "file_id long, path string, extension string, content string")
    index = search.build_index(files)
    hits = lambda *a, **k: sorted((r.file_id, r.number) for r in search.search_content(files, *a, **k).collect())
    assert hits("handler", index=index) == [(1, 1), (2, 1), (2, 2)]
    assert hits("Handler", index=index, case_sensitive=True) == [(1, 1), (2, 2)]
    assert hits("handler", index=index, whole_word=True) == [(1, 1), (2, 1)]
    assert hits("hand", index=index) == []  # parts of tokens aren't found
    assert hits("hand", regex=True) == [(1, 1), (2, 1), (2, 2)]
    assert hits("handler", index=index, extension=".TXT") == []
    assert hits("  ", index=index) == []
    assert {r.file_id for r in search.matching_files(index, "cafe").collect()} == {1}
    assert {r.file_id for r in search.matching_files(index, "func-handler").collect()} == {1}
    page = search.page_hits(search.search_content(files, "handler", index=index), limit=1).collect()
    assert [r.path for r in page] == ["a/main.go"]


def test_import_graph(spark):
    rows = [
        (1, "go.mod", "", "module example.com/m\n"), (1, "main.go", "Go", 'import "example.com/m/pkg/util"\nimport "fmt"\n'), (1, "pkg/util/util.go", "Go", ""),
        (1, "src/index.ts", "TypeScript", "import './lib/helper.js'"), (1, "src/lib/helper.ts", "TypeScript", "import '../index'"), (1, "old/dead.py", "Python", "import missing"),
    ]
    files = spark.createDataFrame(rows, "repo_id long, path string, language string, content string")
    edges = graph.import_edges(files)
    assert sorted((r.from_file, r.to_file, r.resolved) for r in edges.collect()) == [("main.go", "pkg/util", True), ("src/index.ts", "src/lib/helper.ts", True), ("src/lib/helper.ts", "src/index.ts", True)]
    report = graph.report(files, edges)
    assert [r.path for r in report["entry_points"].collect()] == ["main.go", "src/index.ts"]
    assert [r.path for r in report["dead_files"].collect()] == ["go.mod", "old/dead.py"]
    assert [r.members for r in report["cycles"].collect()] == [["src", "src/lib"]]
    assert [r.folder for r in report["unused_folders"].collect()] == ["old"]
    drawn = [r.line for r in export.svg(edges).orderBy("part", "k").collect()]
    assert drawn[0].startswith("<svg") and drawn[-1] == "</svg>" and len(drawn) == 2 + 3 + 4
    # what imports nothing, and a circle, is in the first column; main.go, which has one import below it, is in the next
    assert '<line x1="460" y1="30" x2="20" y2="30" stroke="#888"/>' in drawn and sum('<rect x="20"' in x for x in drawn) == 3
    assert [r.line for r in export.svg(edges.limit(0)).orderBy("part", "k").collect()] == ['<svg xmlns="http://www.w3.org/2000/svg" width="260" height="60">', "</svg>"]


def test_exports(spark, tmp_path):
    commits = _commits(spark).withColumns({"files_changed": F.lit(1), "is_merge": F.lit(False)})
    export.write_export("commits", commits, str(tmp_path / "c"))
    text = next((tmp_path / "c").glob("part-*")).read_text().splitlines()
    assert text[0].startswith("hash,author,email,date") and len(text) == 5 and "2024-01-05T09:00:00Z" in text[1]
    export.write_export("commits", commits, str(tmp_path / "j"), "json")
    rows = json.loads(next((tmp_path / "j").glob("part-*")).read_text())
    assert len(rows) == 4 and "filesChanged" in rows[0]
    export.write_export("commits", commits.limit(0), str(tmp_path / "e"), "json")
    assert [json.loads(x.read_text()) for x in (tmp_path / "e").glob("part-*")] == [[]]
    with pytest.raises(ValueError):
        export.export_rows("nothing", commits)


def test_catalog(spark):
    files = spark.createDataFrame([("a/x.py", "x.py", "a", "py", "Python", 10, 5), ("y", "y", "", "", "", 2, 0)], "path string, name string, folder string, extension string, language string, size long, lines_total long")
    files = files.withColumns({c: F.col("lines_total") for c in ("lines_code", "lines_comment", "lines_blank", "complexity", "imports", "exports", "func_count")})
    assert catalog.scan_totals(files).first().zero_line_files == 1
    assert catalog.language_rollup(files).count() == 1 and catalog.language_rollup(files, unknown=True).count() == 2
    assert catalog.filter_files(files, language="Python").count() == 1
    assert catalog.scan_totals(files.limit(0)).first().size == 0
    assert [r.child for r in catalog.tree_children(files).collect()] == ["a"]
    with pytest.raises(ValueError):
        catalog.list_files(files, "size")


def test_settings():
    assert Settings.from_json('{"dupMinLines": 0, "extra": 1}').dupMinLines == 6
    assert Settings.from_json(Settings(theme="light").to_json()).theme == "light"
    for bad in ({"workerCount": 65}, {"dupMinSimilarity": 1.5}, {"maxFileSize": -1}):
        with pytest.raises(ValueError):
            Settings(**bad).validate()


def test_manifests():
    assert parse_manifest("package.json", '{"dependencies": {"a": "^1"}, "devDependencies": {"b": "2"}}') == [("a", "^1", "runtime"), ("b", "2", "dev")]
    assert parse_manifest("go.mod", "module m\nrequire (\n a/b v1.0 // indirect\n c v2\n)\n") == [("a/b", "v1.0", "indirect"), ("c", "v2", "direct")]
    assert parse_manifest("requirements.txt", "a==1 # x\n-r b\nc[d]>=2\n") == [("a", "==1", "runtime"), ("c", ">=2", "runtime")]
    assert parse_manifest("Cargo.toml", '[dependencies]\nserde = { version = "1" }\nx = "2"\n') == [("serde", "1", "runtime"), ("x", "2", "runtime")]
    assert parse_manifest("pom.xml", "<project><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>1</version></dependency></dependencies></project>") == [("g:a", "1", "compile")]
    assert parse_manifest("package.json", "{") == []


def _git(root, *args, when="2024-02-01T10:00:00"):
    env = os.environ | {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when, "GIT_AUTHOR_NAME": "Alice", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "Alice", "GIT_COMMITTER_EMAIL": "a@x"}
    subprocess.run(["git", "-C", str(root), "-c", "init.defaultBranch=main", *args], check=True, env=env, capture_output=True)


def test_settings_are_kept_by_key(spark, tmp_path):
    path = str(tmp_path / "settings")
    Settings(theme="light").save(spark, path)
    Settings(dupMinLines=9).save(spark, path, "1")
    Settings(theme="blue", maxFileDepth=3).save(spark, path)
    assert Settings.load(spark, path) == Settings(theme="blue", maxFileDepth=3)
    assert Settings.load(spark, path, "1").dupMinLines == 9
    assert Settings.load(spark, path, "none") == Settings()


def test_slices_of_a_log_make_the_whole_log(spark, tmp_path):
    _git(tmp_path, "init")
    for k in range(7):
        if k == 4:
            _git(tmp_path, "checkout", "-b", "side")
        (tmp_path / f"f{k % 3}.py").write_text("x = 1\n" * (k + 1))
        _git(tmp_path, "add", ".")
        _git(tmp_path, "commit", "-m", f"change {k}", when=f"2024-02-0{k + 1}T10:00:00")
    _git(tmp_path, "checkout", "main")
    (tmp_path / "own.py").write_text("y = 2\n")
    _git(tmp_path, "add", ".")
    _git(tmp_path, "commit", "-m", "own", when="2024-02-08T10:00:00")
    _git(tmp_path, "merge", "--no-ff", "-m", "joined", "side", when="2024-02-09T10:00:00")
    log = subprocess.run(["git", "-C", str(tmp_path), "log", "--all", "--date-order", "--numstat", f"--pretty=format:{repository._FORMAT}"], capture_output=True, text=True, check=True).stdout
    want, ordinal = [], 0
    for line in filter(None, log.split("\n")):
        ordinal += line.startswith(repository.RECORD)
        want.append((ordinal, line))
    spark.dataSource.register(repository.GitLog)
    for size in (1, 4, 2000):
        read = spark.read.format("git_log").option("path", str(tmp_path)).option("commits", str(size)).load()
        assert sorted(map(tuple, read.collect())) == sorted(want)
        assert read.rdd.getNumPartitions() == -(-9 // size)


def test_scan_of_a_repository(spark, tmp_path):
    body = "package dup\n\nfunc A() {\n" + "".join(f"\tcall{k}()\n" for k in range(9)) + "}\n"
    tree = {"go.mod": "module example.com/m\n", "main.go": 'package main\n\nimport "example.com/m/pkg/util"\n\nfunc main() {}\n', "pkg/util/util.go": "package util\n", "pkg/dup/one.go": body, "pkg/dup/two.go": body, ".hidden": "x\n", "node_modules/x.js": "x", "data.bin": "a\x00b", "requirements.txt": "numpy==1\n"}
    for path, text in tree.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    _git(tmp_path, "init")
    _git(tmp_path, "add", "main.go", "go.mod")
    _git(tmp_path, "commit", "-m", "day one")
    _git(tmp_path, "add", "pkg")
    _git(tmp_path, "commit", "-m", "day two", when="2024-02-02T10:00:00")
    _git(tmp_path, "tag", "v1.0")
    tables = scan(spark, str(tmp_path))
    files = {r.path: r for r in tables["files"].collect()}
    assert set(files) == set(tree) - {"node_modules/x.js"}
    assert files["data.bin"].lines_total == 0 and files["main.go"].author == "Alice" and files[".hidden"].commits == 0
    assert tables["commits"].count() == 2 and tables["contributors"].first().commits == 2
    assert tables["tags"].first().name == "v1.0" and tables["branches"].first().is_current
    assert [(r.from_file, r.to_file) for r in tables["import_edges"].collect()] == [("main.go", "pkg/util")]
    assert tables["duplicate_groups"].count() == 1 and tables["duplicate_blocks"].count() == 2
    assert [r.name for r in tables["dependencies"].collect()] == ["numpy"]
    assert tables["repository"].first().tag_count == 1
    assert repository.browse(str(tmp_path))[2] == ["node_modules", "pkg"]
    repository.write_tables({"files": tables["files"]}, str(tmp_path / "out"))
    repository.write_tables({"files": tables["files"].limit(1)}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/files")).count() == 1
    repository.write_tables({"files": tables["files"], "tags": tables["tags"]}, str(tmp_path / "out"))
    other = tables["files"].limit(2).withColumn("repo_id", F.lit(2).cast("long"))
    repository.write_tables({"files": other}, str(tmp_path / "out"))
    repository.write_tables({"files": tables["files"], "tags": tables["tags"].limit(0)}, str(tmp_path / "out"))
    stored_ = {x: spark.read.schema(tables[x].schema).parquet(str(tmp_path / "out" / x)) for x in ("files", "tags")}
    assert stored_["tags"].count() == 0 and catalog.of_repository(stored_, 2)["files"].count() == 2 and catalog.of_repository(stored_, 1)["files"].count() == tables["files"].count()


def test_orders_and_percent(spark):
    repos = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-03-01"), (3, "2024-03-01")], "repo_id long, scanned_at string")
    assert [r.repo_id for r in catalog.repositories(repos).collect()] == [2, 3, 1]
    days = [("a", 1), ("b", 1), ("b", 2), ("c", 5), ("c", 6), ("d", 1), ("d", 2), ("d", 3)]
    commits = spark.createDataFrame([(e, f"2024-01-0{d} 10:00:00") for e, d in days], "email string, date string").withColumn("date", F.to_timestamp("date"))
    assert [r.email for r in history.streak_leaders(commits).collect()] == ["d", "b", "c", "a"]
    deps = spark.createDataFrame([("pip", "b"), ("npm", "z"), (None, "n"), ("pip", "a")], "manager string, name string").withColumns({"version": F.lit(""), "scope": F.lit("")})
    assert [(r.manager, r.total, r.name) for r in catalog.grouped_dependencies(deps).collect()] == [(None, 1, "n"), ("npm", 1, "z"), ("pip", 2, "a"), ("pip", 2, "b")]
    pairs = spark.createDataFrame([(0.6,), (0.555,), (1.5,)], "similarity double")
    assert sorted(r.percent for r in duplicates.in_percent(pairs).collect()) == [56, 60, 100]


def test_graph_loops_equal_brute_force(spark):
    rng = random.Random(5)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(60)} | {(k, k + 1) for k in range(50, 75)}
    edges = spark.createDataFrame(sorted(pairs), "source long, target long")
    reach = {}
    for n in {x for p in pairs for x in p}:
        seen, todo = {n}, [n]
        while todo:
            todo = [b for a, b in pairs if a in todo and b not in seen and not seen.add(b)]
        reach[n] = seen
    got = {r.node for r in reachable(edges, spark.createDataFrame([(50,), (0,)], "node long")).collect()}
    assert got == reach[50] | reach.get(0, {0})
    want = {n: min(m for m in reach[n] if n in reach[m]) for n in reach if any(m != n and n in reach[m] for m in reach[n])}
    assert {r.node: r.component for r in strong_components(edges).collect()} == want and want


def test_streams_equal_batches(spark, tmp_path):
    commits = spark.createDataFrame([("a", f"2024-01-0{d} 10:00:00") for d in (1, 2, 3, 6)], "email string, date string").withColumn("date", F.to_timestamp("date"))
    commits.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(commits.schema).parquet(str(tmp_path / "in"))
    for name, made in (("days", activity.daily_stream(stream)), ("runs", activity.streak_stream(stream))):
        made.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("days").count() == 4
    assert sorted((r.start_day, r.days) for r in spark.table("runs").collect()) == [("2024-01-01", 3), ("2024-01-06", 1)]
