import html
import random
import re

import pytest

from ledgerline.llm import html_text
from ledgerline.llm.staging import read


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.train(spark)


def test_given_pages(spark, data):
    """The pages' article element, block by block, by a plain regular expression."""
    pages = read(spark, data, "pages")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        inside = re.search(r"<article>(.*)</article>", source[r.page_id], re.S)[1]
        parts = re.split(r"</?(?:p|h1|div)>", inside)
        lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br>" in p else "", p)).split()) for p in parts]
        assert r.text == "\n".join(filter(None, lines))
        assert r.n_chars == len(r.text)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies for many reasons that nobody reads at all.</div>
<main><article><h1>Title &amp; more</h1><p class=lead>First   paragraph,<br>with&nbsp;a <a href="x>y">link</a> and 1 &lt; 2.</p>
<script>var a = "<p>no</p>";</script><div class="ad">Buy now and save a lot of money today.</div><p>Yes.
<p>Third <b>unclosed <i>marks<p>Fourth &#233;t&eacute;.<ul><li>Point one is here to stay in the text.</li><li>Point two as well.</li></ul>
<form><label>Mail</label><input><button>Send</button></form></article>
<section id="comments"><article class="comment"><p>I read this and did not like it at all, sorry to say so.</p></article></section></main>
<aside><article><p>Another story that is only linked from here.</p></article></aside><p hidden>Not shown</p>
<footer>&copy; Somebody</footer>"""


def test_furniture_goes_and_everything_of_the_article_stays(tree):
    assert html_text.main_text(PAGE, tree).split("\n") == [
        "Title & more", "First paragraph, with a link and 1 < 2.", "Yes.", "Third unclosed marks", "Fourth été.", "Point one is here to stay in the text.", "Point two as well.",
    ]


def test_pages_without_marked_elements(tree):
    body = ["<a href=1>Home</a>", "<a href=2>News</a>", "<a href=3>About us</a>"] + ["word " * 60] * 3 + ["<a href=4>Next page</a>", "<a href=5>Imprint</a>"]
    page = "<html><body>" + "".join(f"<div>{b}</div>" for b in body)
    assert html_text.main_text(page, tree).split("\n") == [("word " * 60).strip()] * 3


def lines_of(source):
    """The article element's lines, by a plain regular expression."""
    parts = re.split(r"</?(?:p|h1|div)>", re.search(r"<article>(.*)</article>", source, re.S)[1])
    return list(filter(None, (" ".join(html.unescape(re.sub(r"<[^>]*>", " " if "<br>" in p else "", p)).split()) for p in parts)))


def test_text_features_alone_find_the_articles(spark, data, tree):
    """The given pages with every mark of their author taken away: only word counts, links and headings are left."""
    for r in read(spark, data, "pages").collect():
        bare = re.sub(r"<(/?)(?:nav|article|footer)\b[^>]*>", r"<\1div>", r.html).replace(' class="ad"', "")
        assert html_text.main_text(bare, tree).split("\n") == lines_of(r.html)


def test_tree_decides(spark, data, tree):
    """Features dealt to other blocks of the page change what is extracted."""
    rng, changed = random.Random(3), 0
    pages = read(spark, data, "pages").collect()
    for r in pages:
        page = html_text.Page(r.html)
        x = html_text.features([b[1:4] for b in page.blocks])
        right = html_text.article(page, [html_text.is_article(tree, y) for y in x])
        rng.shuffle(x)
        changed += right != html_text.article(page, [html_text.is_article(tree, y) for y in x])
    assert changed > len(pages) / 4


def test_given_pages_need_the_tree(spark, data, tree):
    """A tree that takes every block extracts other text from nearly all given pages."""
    pages = [r.html for r in read(spark, data, "pages").collect()]
    assert sum(html_text.main_text(p, 1.0) != html_text.main_text(p, tree) for p in pages) > len(pages) / 2


@pytest.mark.parametrize(
    ("part", "kept"),
    [
        ('<div class="legal-history"><p>{}</p></div>', True),
        ('<div id="search-algorithms"><p>{}</p></div>', True),
        ('<p class="share-price">{}</p>', True),
        ('<header><h2>Head</h2><p>{}</p></header>', True),
        ('<section class="menu"><p>{}</p></section>', True),
        ('<div class="ad-banner"><p>{}</p></div>', False),
        ('<div class="comment-list"><p>{}</p></div>', False),
        ("<aside><p>{}</p></aside>", False),
        ('<div role="complementary"><p>{}</p></div>', False),
    ],
)
def test_names_do_not_decide_over_running_text(tree, part, kept):
    around = "<html><body><nav><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></nav><article><h1>Title</h1><p>" + "word " * 60 + "</p>{}<p>" + "more " * 60 + "</p></article><footer>Imprint</footer>"
    got = html_text.main_text(around.format(part.format("inner " * 25)), tree).split("\n")
    assert got[0] == "Title" and got[1].startswith("word") and got[-1].startswith("more")
    assert (("inner " * 25).strip() in got) == kept


def test_articles_with_subheadings(tree):
    inside = "<h1>Title</h1>" + "".join(f"<h2>Part {k}</h2><p>" + "word " * (20 + 15 * k) + "</p><p>" + "more " * 50 + "</p>" for k in range(4))
    got = html_text.main_text(f"<body><nav><a href=1>Home</a></nav><div><div>{inside}</div></div><footer>Imprint</footer>", tree).split("\n")
    assert [x for x in got if x.startswith("Part")] == [f"Part {k}" for k in range(4)] and len(got) == 13


def test_all_of_an_article_stays(tree):
    inside = "<h2>Title</h2>" + "<p>" + "word " * 70 + "</p><p>Where <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds.</p><ul>" + "".join(f"<li><a href=/{k}>Reference {k}</a></li>" for k in range(3)) + "</ul><p>" + "more " * 30 + "</p>"
    expected = ["Title", ("word " * 70).strip(), "Where x=2 holds.", "Reference 0", "Reference 1", "Reference 2", ("more " * 30).strip()]
    around = "<nav><a href=/>Home</a></nav>{}<footer>Imprint</footer>"
    for tag in ('<article>{}</article>', '<div class="post-body">{}</div>', "<main><section>{}</section></main>", "<div>{}</div>"):
        assert html_text.main_text(around.format(tag.format(inside)), tree).split("\n") == expected


def test_labelled_table_is_learnt(tree):
    for page in html_text.labelled():
        for x, row in zip(html_text.features([r[:3] for r in page]), page):
            assert html_text.is_article(tree, x) == bool(row[3])


def test_edge_pages(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "plain & text < here", "x"), (None, "u", "<p", "x"), (4, "u", "<article><p>" + "w " * 100_000, "x"), (4, "u", "<!-- open", "x"), (5, "u", '<a "' * 5000, "x"), (6, "u", "<div>" * 20_000, "x")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    assert [r.text for r in got if r.page_id in (1, 2)] == ["", ""]
    assert max(r.n_chars for r in got) == 199_999
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
