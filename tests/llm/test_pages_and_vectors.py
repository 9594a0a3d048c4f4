"""Main text of pages, and nearest neighbours against brute force."""

import html
import re

import numpy as np
from pyspark.sql import functions as F

from fluvia.llm import ann
from fluvia.llm.html import extract, main_text


def test_articles_of_the_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    rows = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages.withColumn("text", F.lit("clash"))).collect():
        inner = re.search(r"<article>(.*?)</article>", rows[r.page_id], re.S).group(1)
        inner = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inner))
        want = re.sub(r"\s+", " ", html.unescape(inner)).strip()
        assert (r.text, r.n_chars) == (want, len(want))


def test_pages_without_an_article_and_odd_pages():
    page = """<html><head><title>T</title></head><body><div id="header">Site</div><ul class="nav"><li><a>one</a><li><a>two</a></ul>
    <div class="post"><h2>Head &amp; line</h2><p>A long first paragraph with <b>bold</b>ness and enough words to count as text of the page.</p><p>Brief.</p>
    <p>Another long paragraph that goes on for a while, so that it is surely content as well.</p></div>
    <div class="comments"><p>A reader's remark that is quite long too, but no part of the article at all.</p></div><form>Name <input></form><footer>(c)</footer>"""
    want = "Head & line A long first paragraph with boldness and enough words to count as text of the page. Brief. Another long paragraph that goes on for a while, so that it is surely content as well."
    assert main_text(page) == want
    inside = "<article><h1>A</h1><p>Some text here.</p><section class='comments'><p>I agree</p></section><aside>more</aside><p>End.</p></article>"
    assert main_text(inside) == "A Some text here. End."
    assert [main_text(x) for x in (None, "", "<p>", "<script>x</script>", "<nav>a</nav>")] == [""] * 5
    assert main_text("<div>" * 5000 + "deep") == "deep" and len(main_text("<p>a" * 20_000)) == 39_999


def brute(rows, queries, k):
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids], float)
    out = {}
    for q in queries:
        d = np.sqrt(((x - rows[q]) ** 2).sum(1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out[q] = [(ids[j], d[j]) for j in order]
    return out


def test_recall_and_exact_scores(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    want = brute(rows, [i for i in rows if i % 20 == 0], 10)
    got = {}
    for r in ann.search(vectors, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = r
    assert got.keys() == want.keys() and all(sorted(g) == list(range(1, 11)) for g in got.values())
    recall = np.mean([len({r.vec_id for r in got[q].values()} & {i for i, _ in want[q]}) / 10 for q in want])
    assert recall >= 0.9
    assert all(r.score == np.sqrt(((rows[q] - rows[r.vec_id]) ** 2).sum()) for q in got for r in got[q].values())


def test_copies_ties_and_vectors_that_take_no_part(spark):
    good = [(i, [float(i % 3), 1.0, -0.0]) for i in range(40)]
    bad = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 0.0]), (104, [float("inf"), 0.0, 1.0]), (105, [1.0]), (None, [1.0, 1.0, 1.0])]
    vectors = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").withColumn("h", F.lit("clash"))
    want = brute({i: np.array(v) for i, v in good}, [0, 20], 10)
    got = {}
    for r in ann.search(vectors, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False))).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == want
    assert ann.search(vectors.limit(0), F.lit(True)).count() == 0
    few = spark.createDataFrame(good[:3], "vec_id long, embedding array<float>")
    assert ann.search(few, F.col("vec_id") == 0).count() == 2


def test_probing_finds_every_code_in_the_radius():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 64))
    index = ann.Index(ann.learn(x), x)
    for r in (10, 30, 50):
        far = ann.distances(index.codes[:5], index.codes)
        assert all(set(index.within(index.codes[i], r)) == set(np.flatnonzero(far[i] <= r)) for i in range(5))


def test_probing_prunes_where_vectors_have_near_neighbours():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(200, 64))
    x = np.repeat(centres, 30, 0) + rng.normal(size=(6000, 64)) * 0.08
    coder = ann.learn(x[rng.permutation(len(x))[:3000]])
    probed, ranked = ann.Index(coder, x).shares(x[:50])
    assert probed < 0.1 and ranked < 0.02
    # without structure no radius that finds the neighbours is narrow: most codes are probed, few are ranked
    y = rng.normal(size=(6000, 64))
    probed, ranked = ann.Index(ann.learn(y[:3000]), y).shares(y[:50])
    assert ranked < 0.3 < probed < 0.9
