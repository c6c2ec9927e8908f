"""The written content index against plain token lists, and pages of written orders."""

import os
import re
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from quarrykit.iterate import new_path
from quarrykit.operators import catalog, content_index, history, search
from quarrykit.operators.search import build_index, matching_files, tokens_of
from quarrykit.ordering import ordered

WORDS = ["alpha", "beta", "Gamma", "délta", "eps", "zeta"]


def _files(spark, rows):
    return spark.createDataFrame(rows, "file_id long, content string")


def _plain(rows):
    """(token, file_id) to positions."""
    out = {}
    for i, text in rows:
        for k, t in enumerate(tokens_of(text or "")):
            out.setdefault((t, i), []).append(k)
    return out


def _read(index):
    return {(r.token, r.file_id): list(r.positions) for r in index.collect()}


def _scanned(df):
    """Files that a table's plan reads, after pruning by folders."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters: \[(.*?)\]", plan)


def test_index_equals_token_lists(spark):
    rows = [(k, " ".join(WORDS[(k * j) % 6] for j in range(k % 9))) for k in range(40)] + [(50, None), (51, ""), (52, "  ,. "), (53, "one " * 5000), (-4, "É alpha\nalpha")]
    assert _read(build_index(_files(spark, rows))) == _plain(rows)
    assert _read(build_index(_files(spark, rows), only="Alpha zeta")) == {k: v for k, v in _plain(rows).items() if k[0] in ("alpha", "zeta")}
    assert build_index(_files(spark, rows).limit(0)).count() == 0


def test_index_is_searched_by_ranges_and_changed_by_files(spark):
    rows = [(k, f"common w{k % 50} delta-{k} ") for k in range(600)]
    path = new_path(spark, "index")
    assert content_index.write_index(_files(spark, rows), path, ranges=12) == 0
    found = content_index.open_index(spark, path, "w7")
    assert _read(found) == {k: v for k, v in _plain(rows).items() if k[0] == "w7"}
    # the plan prunes to few of the ranges, and asks for the token inside them
    filters, pushed = _scanned(found)[0]
    assert "range" in filters and ("token" in pushed)
    read = spark.read.schema(content_index._CATALOGUE).parquet(f"{path}/catalogue").where("first <= 'w7' AND last >= 'w7'").count()
    assert 1 <= read <= 3
    # a frequent token is split over ranges
    assert spark.read.parquet(f"{path}/postings").where("token = 'common'").select("range").distinct().count() > 1
    # one file changes, one goes, one comes: the new segment holds these alone
    fresh = [(3, "common again"), (900, "w7 common")]
    assert content_index.write_index(_files(spark, fresh), path, removed=_files(spark, [(7, "")]), ranges=2) == 1
    assert {r.file_id for r in spark.read.parquet(f"{path}/postings/segment=1").collect()} == {3, 900}
    now = [r for r in rows if r[0] not in (3, 7)] + fresh
    assert _read(content_index.open_index(spark, path)) == _plain(now)
    assert {r.file_id for r in matching_files(content_index.open_index(spark, path, "w7"), "w7").collect()} == {k for k in range(600) if k % 50 == 7 and k != 7} | {900}
    assert {r.file_id for r in matching_files(content_index.open_index(spark, path, "delta-57 common"), "delta-57 common").collect()} == {57}
    # what a lost write left behind isn't seen
    os.makedirs(f"{path.removeprefix('file://')}/postings/segment=2/range=0")
    spark.createDataFrame([("w7", 5000, [0])], "token string, file_id long, positions array<int>").write.mode("append").parquet(f"{path}/postings/segment=2/range=0")
    assert _read(content_index.open_index(spark, path)) == _plain(now)
    assert content_index.compact(spark, path) == 2 and content_index.compact(spark, path) == 2
    assert _read(content_index.open_index(spark, path)) == _plain(now)
    assert content_index.write_index(_files(spark, []), path, removed=_files(spark, [(900, "")])) == 3
    assert _read(content_index.open_index(spark, path, "again w7")) == {k: v for k, v in _plain(now).items() if k[0] in ("again", "w7") and k[1] != 900}
    assert content_index.open_index(spark, path, "unheard").count() == 0


def test_no_index_has_no_rows(spark):
    path = new_path(spark, "index")
    assert content_index.open_index(spark, path, "x").count() == 0
    content_index.write_index(_files(spark, []), path)
    assert content_index.open_index(spark, path, "x").count() == content_index.open_index(spark, path).count() == 0


def test_pages_of_a_written_order(spark):
    table = spark.range(5000).select(F.concat(F.lit("p"), F.col("id")).alias("path"), (F.col("id") * 7919 % 100).alias("lines_code"), F.lit(1).alias("row_number"))
    want = [(r.path, r.lines_code) for r in table.collect()]
    want.sort(key=lambda r: (-r[1], r[0]))
    listed = catalog.ordered_files(table.drop("row_number"), "loc")
    assert listed.total == 5000
    for offset, limit in ((0, 10), (3777, 50), (4990, 50), (5000, 10), (9999, 5), (-3, 2), (10, 0)):
        assert [tuple(r) for r in listed.rows(offset, limit).collect()] == want[max(0, offset) : max(0, offset) + limit]
    page = listed.rows(3777, 50)
    page.collect()
    # of eight folders, only those of the page are read
    assert re.search(r"PartitionFilters: \[[^\]]*_part", page._jdf.queryExecution().executedPlan().toString())
    parts = {r[0] for r in page.select(F.input_file_name()).distinct().collect()}
    assert len(parts) <= 2
    numbers = {r.path: r.row_number for r in listed.numbered().collect()}
    assert numbers == {path: k + 1 for k, (path, _) in enumerate(want)}
    deep = catalog.page_with_total(table.drop("row_number"), 5, 4000, "loc", shallow=100).collect()
    assert [(r.path, r.total) for r in deep] == [(p, 5000) for p, _ in want[4000:4005]]
    assert ordered(table.drop("row_number").limit(0), "path").rows(0, 10).count() == 0
    assert history.deep_feed(table.limit(0).select(F.col("path").alias("hash"), F.lit(1).alias("date"))).total == 0


def _most_held(rows, folded=True):
    """Bytes of Python and numpy that putting a batch of ``rows`` texts into an index takes at most."""
    batch = pa.RecordBatch.from_pydict({"file_id": list(range(rows)), "content": ["Été alpha beta gamma " * 100] * rows})
    tracemalloc.start()
    made = sum(part.num_rows for part in search._grouped(folded)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == 4 * rows
    return most


def test_index_takes_a_batch_apart_in_parts():
    _most_held(10)
    for folded in (True, False):
        small, large = _most_held(1000, folded), _most_held(4000, folded)
        assert large < 1.2 * small and large < 40 * 2**20


def test_index_parts_leave_rows_whole(spark, monkeypatch):
    rows = [(k, " ".join(WORDS[(k * j) % 6] for j in range(k % 9))) for k in range(40)] + [(50, None), (51, ""), (52, "  ,. "), (53, "one " * 50), (-4, "É alpha\nalpha")]
    whole = pa.RecordBatch.from_pydict({"file_id": [k for k, _ in rows], "content": [t or "" for _, t in rows]})
    for most in (1, 20, 1000):
        monkeypatch.setattr(search, "_AT_ONCE", most)
        parts = list(search._grouped(True)(iter([whole, whole.slice(0, 0)])))
        found = {(t, i): p for part in parts for t, i, p in zip(*(part[c].to_pylist() for c in ("token", "file_id", "positions")), strict=True)}
        assert found == _plain(rows) and sum(part.num_rows for part in parts) == len(found)
        assert most == 1000 or len(parts) > 5


def test_letters_of_an_index_are_those_of_queries(spark):
    # U+0870 is a letter since Unicode 14
    index = build_index(_files(spark, [(1, "a\u0870b c"), (2, "a b")]))
    assert {r.file_id for r in matching_files(index, "A\u0870B").collect()} == {1}
