"""Pages whose region the clusters choose: without article markup, with misleading names, cut by adverts; and odd rows."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.llm import html
from fluvia.llm.html import main_text

LONG = "A paragraph of the text that has many words and goes on for quite a while, so that its ratio of text to tags is high. " * 3
AD = '<div class="ad"><a>Buy</a></div>'
MENU = "".join(f"<li><a href='/{i}'>Topic {i}</a></li>" for i in range(40))
PLAIN = f"<body><div><ul>{MENU}</ul></div><div><h2>Head</h2><p>{LONG}</p><p>Brief.</p><p>{LONG}</p></div><div><a>Imprint</a><br><a>Contact</a></div></body>"


def test_brief_lines_beside_adverts_stay():
    page = f'<body><div class="nav"><a>Home</a></div><div class="x"><p>Lead.</p>{AD}<p>{LONG}</p>{AD}<h3>Brief</h3>{AD}<p>{LONG}</p>{AD}<p>End.</p></div><div class="ad">Buy</div><div><p>Elsewhere</p></div></body>'
    assert main_text(page) == f"Lead. {LONG.strip()} Brief {LONG.strip()} End."


def test_clusters_alone_find_the_region(monkeypatch):
    want = f"Head {LONG.strip()} Brief. {LONG.strip()}"
    assert main_text(PLAIN) == want
    monkeypatch.setattr(html, "clusters", lambda lines, *_: np.ones(len(lines), bool))
    assert main_text(PLAIN) != want  # no names here: without the clusters nothing parts text from menus


def test_shuffled_ratios_lose_the_region(monkeypatch):
    monkeypatch.setattr(html, "clusters", lambda lines, *_: np.array([len(t) < 20 for t, *_ in lines]))
    assert main_text(PLAIN) != f"Head {LONG.strip()} Brief. {LONG.strip()}"


def test_a_comment_is_no_article_and_a_wrapper_is_no_boilerplate():
    post = f'<div class="post"><h1>Title</h1><p>{LONG}</p></div><article class="comment"><p>{LONG} I agree.</p></article>'
    assert main_text(f"<body>{post}</body>") == f"Title {LONG.strip()}"
    assert main_text(f'<body><div class="social"><h1>Title</h1><p>{LONG}</p><div class="share">Share it</div></div></body>') == f"Title {LONG.strip()}"
    form = f"<body><form><nav><a>x</a></nav><div><p>{LONG}</p><p>{LONG}</p></div></form></body>"
    assert main_text(form) == f"{LONG.strip()} {LONG.strip()}"
    links = f'<body><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><div><p>Buy now cheap</p></div><ul><li><a href="/">Links list</a></li></ul></body>'
    assert main_text(links) == f"Title {LONG.strip()} {LONG.strip()}"


def test_rows_of_any_kind(spark):
    rows = [(1, "u", PLAIN), (1, "u", PLAIN), (2, None, None), (None, "v", ""), (3, "w", "<p>" + "word " * 60_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x"), "lines": F.lit(0)})
    out = html.extract(pages)
    assert out.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    got = sorted(((r.page_id or 0, r.url, r.n_chars) for r in out.collect()), key=str)
    n = len(main_text(PLAIN))
    assert got == sorted([(1, "u", n), (1, "u", n), (2, None, 0), (0, "v", 0), (3, "w", 5 * 60_000 - 1)], key=str)
    assert html.extract(pages.limit(0)).count() == 0


TEXT = "A sentence of the article that is long enough to stand out. " * 6


@pytest.mark.parametrize("piece", ["<![foo bar]>", "<![foo[bar]]>", "<![>", "<![CDATA[x]]>", "<!foo>", "<!-- x", "<![if IE]>", "<![endif]-->"])
def test_odd_sections_are_no_text_and_no_error(piece):
    assert TEXT.strip() in html.main_text(f"<article><p>{TEXT}</p><p>{TEXT}</p></article>{piece}")
    html.main_text(f"{piece}<p>{TEXT}</p>")
    html.main_text(piece)


@pytest.mark.parametrize("piece", ["<!--", "</", "<![", "<!", "<a "])
def test_what_never_ends_is_read_once(piece):
    began = time.perf_counter()
    html.main_text(f"<article><p>{TEXT}</p></article>" + piece * (80_000 // len(piece)))
    assert time.perf_counter() - began < 5


def test_articles_side_by_side_all_stay():
    two = "".join(f"<article><h2>Part {k}</h2><p>{TEXT}</p></article>" for k in "ab")
    text = html.main_text(f"<body><nav><a>Home</a></nav>{two}<footer>end</footer></body>")
    assert text == " ".join(f"Part {k} {TEXT.strip()}" for k in "ab")
    teaser = f"<body><article><p>{TEXT}</p><p>{TEXT}</p></article><article><p>Short teaser.</p></article></body>"
    assert html.main_text(teaser) == f"{TEXT.strip()} {TEXT.strip()}"
