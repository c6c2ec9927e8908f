"""Operators 11 to 13 against brute force: ranked search, main text, fill-in-the-middle."""

import hashlib
import html
import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrykit.llm import fill_middle, main_text, ranked_search
from quarrykit.llm.queries import QUERIES
from tests.helpers import SMALL

# ranked search

_TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return _TERM.findall((text or "").translate(_LOWER))


def _ranked(docs, items, k):
    """All (item, rank, doc_id, score) by scoring every document."""
    counts = [(i, Counter(_terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n, total = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 75 + (75 * c.total() * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in _terms(text) if t in c)
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def _corpus(seed, n=300):
    rng = np.random.default_rng(seed)
    words = [f"t{int(x)}" for x in rng.zipf(1.3, 40000) % 900]
    at = iter(words)
    docs = [(k, " ".join(itertools.islice(at, int(rng.integers(1, 90))))) for k in range(n)]
    docs += [(1000 + k, "same words HERE, same Words") for k in range(25)] + [(2000, None), (2001, ""), (2002, "... !?"), (None, "t1 t2 t3"), (7, "t5 t5 t6"), (7, "t5 t5 t6"), (2003, "É é T1\x1ct2 " * 3000)]
    items = [(k, " ".join(itertools.islice(at, 12))) for k in range(12)] + [(50, "HERE same"), (51, None), (52, ""), (53, "unheard"), (54, "é t1 É é"), (1, "t5 t6"), (None, "t7 t8 t8"), (55, docs[3][1] + " " + docs[4][1] * 40)]
    return docs, items


@pytest.mark.parametrize("joined", [False, True])
@pytest.mark.parametrize("k", [1, 10])
def test_ranking_equals_scoring_everything(spark, make, monkeypatch, joined, k):
    if joined:  # as beyond the bound for terms in every task
        monkeypatch.setattr(ranked_search, "MOST_TERMS", 5)
    docs, items = _corpus(3)
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, rank string, row int")
    got = ranked_search.rank_documents(make(docs, clash=("score", "rank", "row", "item", "t")).repartition(5), table, k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(_ranked(docs, items, k), key=repr)


def test_ranking_skips_documents_and_keeps_ties(spark, make, monkeypatch):
    """Frequent terms alone make no candidates, and more equal scores than places go by id."""
    docs = [(k, f"the of rare{k % 40} " + "the " * (k % 5)) for k in range(400)] + [(1000 + k, "the of needle") for k in range(60)]
    seen, scores = [], ranked_search._scores
    monkeypatch.setattr(ranked_search, "_scores", lambda pairs, *x: seen.append(pairs.count()) or scores(pairs, *x))
    got = ranked_search.rank_documents(make(docs[::-1]), spark.createDataFrame([(0, "the of needle")], "item_id long, text string"))
    assert [(r["rank"], r.doc_id) for r in got.orderBy("rank").collect()] == [(k + 1, 1000 + k) for k in range(10)]
    assert seen[-1] == 60


def test_ranking_of_nothing(spark, make):
    items = spark.createDataFrame([(0, "the")], "item_id long, text string")
    assert ranked_search.rank_documents(make([(0, "the")]).limit(0), items).count() == 0
    assert ranked_search.rank_documents(make([(0, None), (1, "")]), items).count() == 0
    assert ranked_search.rank_documents(make([(0, "the")]), items.limit(0)).count() == 0


# main text


def _article(page):
    """The article of the driver's pages, whose paragraphs are split at their tags."""
    found = re.search(r"<article>(.*?)</article>", page, re.DOTALL)
    plain = [re.sub(r"</?b>", "", re.sub("<br>", " ", x)) for x in re.split(r"</?(?:p|h1)>", found[1])]
    return "\n".join(x for x in (" ".join(html.unescape(p).split()) for p in plain) if x)


def test_main_text_of_pages_is_their_article(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    got = QUERIES["op12_text_density"](spark, SMALL).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == _article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


STORY = ["A title of this", "First paragraph with bold text, a link & more words than most others have.", "Second one.", "An item", "Its sequel", "a b", "Somebody said this in many words that go on."]
BODY = "<h2>A title&nbsp;of   this</h2><div class=entry><p>First paragraph with <b>bo</b>ld\n text, a <a href='x'>link</a> &amp; more words than most others have.<p>Second one.<ul><li>An item<li>Its sequel</ul><table><tr><td>a<td>b</table><blockquote>Somebody said this in many words that go on.</blockquote></div>"
NOISE = {
    "menu": "<ul class='main-menu'><li><a href=/>Home page of this site</a></ul>", "nav": "<nav><a href=/>Home</a> and away, many words in a menu</nav>", "header": "<header><h1>The name of the site</h1></header>",
    "comments": "<div id=comments><p>" + "I read this and I write about it at length. " * 20 + "</p></div>", "sidebar": "<div class='sidebar-right'><p>Other news in a long sentence, which nobody asked for.</p></div>",
    "cookie": "<div class='cookie-notice'>We use cookies and want a yes.</div>", "ad": "<section class=\"ad-slot big\"><p>Buy this now, or else it will be gone for ever.</p></section>", "form": "<form><p>Write a letter to us, we like letters very much.</p><input></form>",
    "script": "<script>if (a<b) { write('<p>no words</p>') }</script>", "style": "<style>p { color: red }</style>", "comment": "<!-- <p>a comment of markup</p> -->", "footer": "<footer><p>All rights reserved for ever and ever.</p></footer>",
    "links": "<div>" + "<a href=y>more of it</a> " * 30 + "</div>", "role": "<div role=complementary><p>Something else that is of interest to others.</p></div>",
}


@pytest.mark.parametrize("noise", NOISE)
@pytest.mark.parametrize("around", ["<article>{}</article>", "<main class='with-sidebar'>{}</main>", "<div class=post>{}</div>"])
def test_main_text_leaves_out(noise, around):
    page = "<html><head><title>T</title></head><body class='no-sidebar'><div class='page has-menu'>{0}" + around.format(BODY) + "{0}</div></body></html>"
    assert main_text.main_text(page.format(NOISE[noise])).split("\n") == STORY


def test_main_text_of_broken_pages():
    whole = main_text.main_text
    assert whole("") == whole("<html><body></body></html>") == whole("<p") == whole("<!-- never ended") == whole("<script>var x = '<p>no</p>'") == ""
    assert whole("plain &lt;text&gt; only") == "plain <text> only"
    assert whole("<p>one<p title=\"a>b\">two</b></i></p></p></div>three") == "one\ntwo\nthree"
    assert whole("<p>5 < 6 and a<br>b&#x41;&amp;amp;</p><p unclosed='") == "5 < 6 and a bA&amp;"
    assert whole("<article><header><h1>Head</h1></header><p>Text</article>") == "Head\nText"
    assert whole("<P>Upper<SCRIPT>x</script ><P>case") == "Upper\ncase"
    deep = "<div><b>" * 20000 + "<p>core</p>" + "</div>" * 100
    assert whole(deep) == "core"
    assert len(whole("<article>" + "<p>word &eacute; <i>x</i></p>" * 30000 + "</article>").split("\n")) == 30000
    assert whole("<a \"" * 5001 + "> end") in ("", "end", '"> end')


def test_main_text_of_tables(spark):
    rows = [(1, "u", None, "a"), (2, "u", "", "b"), (3, None, "<article><p>x</article>", "c"), (3, None, "<article><p>x</article>", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = main_text.extract_main_text(pages)
    assert got.columns == pages.columns and sorted((r.page_id, r.text) for r in got.collect()) == [(1, ""), (2, ""), (3, "x"), (3, "x")]
    assert main_text.extract_main_text(pages.limit(0)).count() == 0


# fill-in-the-middle

_UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def _middle(i, text):
    """(n, form, prefix, middle, output) in plain string operations."""
    text = text or ""
    units = _UNIT.findall(text)
    drawn = hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()
    h = [int(drawn[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 80
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_middles_equal_plain_strings_and_go_back(make):
    texts = ["", None, " ", "\t\n \x0b\x0c\r", "a", " a", "a ", "a b", "  a  b\n\nc  ", "é ß \U0001f600x y", "x <P> y", "<M>", "a<S>b", "a\x1cb \x85c", "w " * 50000, "x" * 100000]
    rows = [(k, texts[k % len(texts)]) for k in range(400)] + [(None, "null ids too, at least once"), (3, "twice here"), (3, "twice here")]
    got = fill_middle.fill_in_middle(make(rows, clash=("form", "output", "_done")))
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "_done", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = got.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(back) == len(rows) and {r.form for r in back} == {"plain", "psm", "spm"}
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == _middle(r.doc_id, r.text) and r.back == (r.text or "") for r in back)
    assert fill_middle.fill_in_middle(make(rows).limit(0)).count() == 0


def test_middles_with_other_sentinels(make):
    rows = [(k, f"one <P> two three {k}") for k in range(200)]
    marks = ("<|p|>", "<|s|>", "<|m|>")
    got = fill_middle.fill_in_middle(make(rows), percent=100, spm_percent=0, sentinels=marks).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r.form == "psm" and r.output.startswith("<|p|>") and r.back == r.text for r in got)
