"""Main text of pages: the given pages against their article elements, other layouts against what they say, odd markup."""

import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import extract

PAGES = "/root/testdata/sf0.01/pages.parquet"


def test_given_pages_equal_their_article(spark):
    for row, own in zip(*(df.orderBy("page_id").collect() for df in (spark.read.parquet(PAGES), extract.extract(spark.read.parquet(PAGES))))):
        inside = re.search("<article>(.*)</article>", row.html, re.S).group(1)
        want = " ".join(html.unescape(re.sub("</?[a-z][^<>]*>", " ", inside)).split())
        assert (own.page_id, own.url, own.text, own.n_chars) == (row.page_id, row.url, want, len(want))


def test_tree_holds_on_pages_it_was_not_grown_from():
    right = total = 0
    for k, page in enumerate(extract.LABELLED):
        tree = extract.grow(*extract.labelled_rows([p for i, p in enumerate(extract.LABELLED) if i != k]))
        x, y = extract.labelled_rows([page])
        right, total = right + (extract.main_text(tree, x) == y).sum(), total + len(y)
    assert right / total >= 0.9
    x, y = extract.labelled_rows()
    assert (extract.main_text(extract.trained(), x) == y).all()


LONG = "These words are the text of the page and there are quite a few of them in this paragraph."
LAYOUTS = [
    # menus, notices, adverts, sidebars, forms, comments and footers around an article
    (f"""<body class="has-sidebar"><header class="site-header"><a href="/">Site</a></header><nav><ul><li><a href=x>One<li><a href=y>Two</ul></nav>
     <div class="cookie-banner"><p>We use cookies. {LONG}</p><button>Accept</button></div>
     <article class="post"><header class="entry-header"><h1>Title &amp; more</h1></header><p>{LONG}<p>Short.</p><div class="ad-slot">Buy now</div><ul><li>one<li>two</ul>
     <form><label>Mail</label><input><textarea>type</textarea></form><script>var t = "</p><p>no";</script></article>
     <section id="comments"><article class="comment"><p>{LONG}</p></article></section><aside>{LONG}</aside><footer>&copy; {LONG}</footer></body>""",
     f"Title & more {LONG} Short. one two"),
    # no telling names at all
    (f"<body><div><a href=1>Home</a> <a href=2>News</a> <a href=3>All</a></div><div>{LONG}</div><div>{LONG} {LONG}</div><div><a href=4>More</a> <a href=5>Back</a></div></body>", f"{LONG} {LONG} {LONG}"),
    ("<article>a<b>b</b>c<br>d<!-- x --><span> e</span>&nbsp;f&#x41;&lt;p&gt;</article>", "abc d e fA<p>"),
    ("<main><p>1 < 2 and 3 <4 <P CLASS='ad'>no</P><p title='a > b'>yes</main>", "1 < 2 and 3 <4 yes"),
    ("<article>kept<!-- never ended <p>lost</p></article>", "kept"),
    ("<article>kept<script>never ended <p>lost</p></article>", "kept"),
    ("<article><p hidden>no</p><p style='display: none'>no</p><p aria-hidden=\"true\">no</p><div role='navigation'>no</div>yes</article>", "yes"),
    ("<article><table><tr><td>a<td>b<tr><td>c</table></article></div></p>", "a b c"),
    ("plain text only", None), ("", ""), ("<", None), ("<p", None), ("<!doctype html>", ""), ("   \n ", ""),
]


@pytest.mark.parametrize("page,want", LAYOUTS)
def test_layouts_and_odd_markup(page, want):
    found = extract.blocks(page)
    kept = extract.main_text(extract.trained(), extract.features(found)) if found else np.zeros(0, bool)
    got = " ".join(b[0] for b, k in zip(found, kept) if k)
    assert want is None or got == want


def test_nulls_repeats_other_columns_empty_and_very_long(spark):
    long = f"<article>{'<p>word</p>' * 60_000}<p>{'x' * 1_000_000}</p></article>"
    rows = [(1, "u", None), (1, None, ""), (None, "u", "<article>a</article>"), (None, "u", "<article>a</article>"), (2, "v", long), (3, "w", "<" * 20_000 + "a href='" * 2_000)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string").withColumn("text", F.lit(5)).withColumn("n_chars", F.lit(None))
    got = extract.extract(pages)
    assert got.dtypes == [("page_id", "int"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    by = sorted((str(r.page_id), r.n_chars) for r in got.collect())
    assert by[:4] == [("1", 0), ("1", 0), ("2", 60_000 * 5 + 1_000_000), by[3]] and by[4:] == [("None", 1), ("None", 1)]
    assert extract.extract(pages.where("false")).count() == 0
