"""Main texts of hand-made and of given pages."""

from __future__ import annotations

import html
import random
import re
import time

import pytest

from release_guard.llm import queries
from release_guard.llm.html_text import CLOSES, INLINE, SCOPES, extract_text, host, main_text, page_nodes, parse, style_tree

PAGES = "page_id long, url string, html string, host string, text string, source string, low int"


@pytest.fixture
def pages(spark):
    return lambda rows: spark.createDataFrame([(i, u, h, "x", "y", "z", 1) for i, u, h in rows], PAGES).repartition(2)


@pytest.mark.parametrize(
    "source,text",
    [
        ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<br>b</p><p>c", "a b c"), ("<p>a<b>b</b>c", "abc"),
        ("<article><h1>T</h1><p><b>x<br><p>y</p></article><footer>f</footer>", "T x y"),
        ("<nav>n</nav><main><header><h1>H</h1></header><p>x</p><aside>s</aside></main><header>h</header>", "H x"),
        ("<body><div id=menu>m</div><div class='post sideBar'>s</div><div>keep<script>var a='</div>';</script></div>", "keep"),
        ("<article><p>a</p><div class='comments'><p>c</p></div><section id='comment-list'>d</section><p>b</article>", "a b"),
        ("<p>1 &lt; 2 &nbsp; &#233;&eacute;</p><!-- <p>no</p> --><style>p{}</style>", "1 < 2 éé"),
        ("<ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table>", "a b 1 2 3"),
        ("<title>t</title><p>x</p><form><p>f</p></form><p>y", "x y"), ("a < b and c > d <", "a < b and c > d <"),
        ("<article>one</article><article>two</article><p>out</p>", "one two"), ("<p hidden>h</p><p aria-hidden=true>i</p><p>j", "j"),
        ('<div class="ad">x</div><p title="a > b">t</p><div class="adventure">kept</div>', "t kept"),
        ("<!DOCTYPE html><html><head><meta charset=utf-8><title>t</title><body><p>x\n\n y</p></body></html> ", "x y"),
        ("<p>a</p><script>never closed <p>b", "a"), ("<article><p>x</p>", "x"), ("<div><div><p>deep</div></div>after", "deep after"),
        ('<a title="broken>text</a><p>y', "text y"), ("<div role=navigation>n</div><div role='main'>m</div>", "m"),
        ("<b><p>bold</b> tail</p>", "bold tail"), ("x<svg><text>s</text></svg>y<textarea>t</textarea>z", "xyz"),
    ],
)
def test_pages(source, text):
    assert main_text(parse(source), frozenset()) == text


@pytest.mark.parametrize(
    "source", ["<b>" * 300_000, "<b>" * 150_000 + "</i>" * 150_000, "<head>" + "<span>" * 150_000, "<table><tr><td>" * 60_000, "<ul><li>" * 100_000]
)
def test_a_megabyte_of_nested_tags_takes_seconds(source):
    start = time.process_time()
    assert main_text(parse(source), frozenset()) == ""
    assert time.process_time() - start < 15


def by_walking(open_tags, tag, start):
    """What a tag closes, found by walking over the open elements: the depth that stays open, or None."""
    cut = None
    ends = ({tag} if not start else CLOSES.get(tag, set() if tag in INLINE else {"p"}))
    for depth in range(len(open_tags) - 1, 0, -1):
        if open_tags[depth] in ends:
            cut = depth
            if not start:
                break
        elif open_tags[depth] in SCOPES and open_tags[depth] not in ends and (start or tag in INLINE):
            break
    return cut


def test_elements_close_as_by_walking():
    rng = random.Random(1)
    names = "div p b i a span ul li dl dt dd table tr td th tbody thead section blockquote option h2".split()
    for _ in range(3000):
        tags = [(rng.choice(names), rng.random() < 0.6) for _ in range(rng.randint(1, 25))]
        open_tags, wanted = ["html"], []
        for i, (tag, start) in enumerate(tags):
            cut = by_walking(open_tags, tag, start)
            open_tags = open_tags if cut is None else open_tags[:cut]
            open_tags = [*open_tags, tag] if start else open_tags
            blocks = [t for t in open_tags if t not in INLINE]
            wanted.append((f"w{i}", blocks))
        page = parse("".join(f"<{'' if start else '/'}{tag}>w{i}" for i, (tag, start) in enumerate(tags)))
        found = []
        for node, text in page.pieces:
            if text:
                up, chain = node, []
                while up >= 0:
                    chain.append(page.tag[up])
                    up = page.parent[up]
                found.append((text, chain[::-1]))
        assert found == wanted, tags


def test_comments_go_at_any_length():
    long = f"<p>{PROSE}</p>" * 30
    assert main_text(parse(f"<main><p>{PROSE}</p><div class=comments>{long}</div></main>"), frozenset()) == PROSE
    assert main_text(parse(f"<article><p>{PROSE}</p><ol class='commentlist'><li>{long}</ol></article>"), frozenset()) == PROSE
    assert main_text(parse(f"<p>{PROSE}</p><section id=disqus_thread>{long}</section>"), frozenset()) == PROSE
    # A paragraph of the article that is named by the word stays.
    assert main_text(parse(f"<article><p>{PROSE}</p><p class=comment>x</p></article>"), frozenset()) == f"{PROSE} x"


def test_a_paragraph_of_the_story_in_a_menu_stays():
    page = f"<article><p>{PROSE}</p><div class=menu><p>part of it</p></div><div class=menu><a>one</a> <a>two</a></div></article>"
    assert main_text(parse(page), frozenset()) == f"{PROSE} part of it"


def test_deep_and_long_pages():
    assert main_text(parse("<div>" * 5000 + "x"), frozenset()) == "x"
    assert len(main_text(parse("<p>word</p>" * 20_000), frozenset())) == 99_999
    assert main_text(parse("<" * 50_000), frozenset()).startswith("<")


def test_branches_alike_on_the_site_go(pages):
    rows = [(i, f"https://Site.example.org/{i}", f"<body><div class=box>Try our offer</div><div class=story><p>story {i}</p></div>") for i in range(30)]
    rows += [(100, "http://other.example.org/", "<body><div class=box>Try our offer</div><p>z")]
    found = {r["page_id"]: r["text"] for r in extract_text(pages(rows)).collect()}
    assert found == {**{i: f"story {i}" for i in range(30)}, 100: "Try our offer z"}


def test_copies_of_an_article_stay(pages):
    rows = [(i, "https://a.example.org/", "<article><h1>T</h1><p>same</p></article>") for i in range(40)]
    assert {r["text"] for r in extract_text(pages(rows)).collect()} == {"T same"}


def test_importance(pages):
    rows = [(i, "u://h/x", f"<div class=same>a</div><div class=differs>{i}</div>") for i in range(16)]
    df = pages(rows).select("page_id", host("url").alias("host"), "html")
    nodes = page_nodes(df.selectExpr("host", "page_id as page_key", "html as source"))
    tree = [(r["pages"], round(r["content"], 6), round(r["presentation"], 6)) for r in style_tree(nodes).collect()]
    assert sorted(tree) == [(16, 0.0, 0.0), (16, 1.0, 0.0), (16, 1.0, 0.0)]


def test_odd_rows(pages):
    rows = [(1, None, None), (2, "", ""), (None, "no address", "<p>x"), (4, "http://h", "<p>y"), (4, "http://h", "<p>y"), (5, "http://h", "p" * 200_000)]
    found = sorted((r["page_id"] or 0, r["url"], r["text"]) for r in extract_text(pages(rows)).collect())
    assert found == sorted([(1, None, ""), (2, "", ""), (0, "no address", "x"), (4, "http://h", "y"), (4, "http://h", "y"), (5, "http://h", "p" * 200_000)], key=lambda r: r[0])
    assert extract_text(pages([])).count() == 0


def plain(source):
    """The article of a given page, read with two expressions."""
    body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", body))).split())


def test_given_pages(spark, sf_dir):
    found = {r["page_id"]: r for r in queries.op6_style_tree_text(spark, sf_dir).collect()}
    given = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(found) == len(given)
    for page in given:
        r = found[page["page_id"]]
        assert (r["url"], r["text"], r["n_chars"]) == (page["url"], plain(page["html"]), len(plain(page["html"])))


@pytest.mark.parametrize(
    "source,text",
    [
        ('<div style="overflow:hidden"><p>x</div><div data-hidden="false">y</div>', "x y"),
        ('<body style="overflow-x:hidden"><p>x', "x"), ("<body hidden><p>x", "x"), ('<body aria-hidden="true"><p>x', "x"),
        ('<div data-id="search" title="class=ad id=menu">x</div><p data-role=\'navigation\'>y', "x y"),
        ('<div title="a"hidden>x</div><div title="a"" HIDDEN=until-found>x</div><div aria-hidden = \'TRUE\'>x</div><p>y', "y"),
        ("<div class=a class=ad>x</div><p>y", "x y"),
    ],
)
def test_attributes_by_their_whole_names(source, text):
    assert main_text(parse(source), frozenset()) == text


PROSE = "a long passage that belongs to the article and is not a part of the frame"


@pytest.mark.parametrize(
    "source,text",
    [
        (f"<article class='post no-sidebar'><p>{PROSE}</article>", PROSE), (f"<main class='has-sidebar'><p>{PROSE}</main>", PROSE),
        (f"<div id='content-sidebar-wrap'><article><p>{PROSE}</article><div class=sidebar>s</div></div>", PROSE),
        (f"<div id='content-sidebar-wrap'><p>{PROSE}</div>", PROSE),
        (f"<article><p>{PROSE}</p><section class='related-work'><p>others</p></section><p class=notice>n</p></article>", f"{PROSE} others n"),
        (f"<article><p>{PROSE} <a class=related>link</a> on</p><ul class=share><li><a>f</a><li><a>t</a></ul></article>", f"{PROSE} link on"),
        (f"<div class=menu><a>{PROSE}</a></div><p>{PROSE}</p>", PROSE), (f"<div class=ad>{PROSE[:30]}</div><p>{PROSE}</p>", PROSE),
        (f"<div class=reply>{PROSE}</div><div class=reply>{PROSE}</div><p>x", f"{PROSE} {PROSE} x"),
        (f"<main><article><p>{PROSE}</p></article><div id=comments><article class=comment>c</article></div></main>", PROSE),
    ],
)
def test_class_words_do_not_decide_alone(source, text):
    assert main_text(parse(source), frozenset()) == text


def test_small_hosts_lose_what_is_alike(pages):
    notice = "<div class=box>Try our offer</div>"
    story = "<div class=story><p>one long story that stands on two pages of a host</div>"
    rows = [(i, "http://two.example/", f"<body>{notice}<div class=story><p>a longer story {i}</p></div>") for i in (1, 2)]
    # Copies are one page, and do not outvote another one.
    rows += [(i, "http://copies.example/", f"<body>{notice}<div class=story><p>same story</p></div>") for i in range(10, 40)]
    rows += [(i, "http://three.example/", f"<body>{notice}<div class=story><p>a longer story {i // 20}</p></div>") for i in range(50, 80)]
    rows += [(i, "http://near.example/", f"<body>{story}<div class=date>{i}</div>") for i in (90, 91)]
    found = {r["page_id"]: r["text"] for r in extract_text(pages(rows)).collect()}
    assert found[1] == "a longer story 1" and found[2] == "a longer story 2"
    assert {found[i] for i in range(10, 40)} == {"Try our offer same story"}
    assert {found[i] for i in range(50, 80)} == {"a longer story 2", "a longer story 3"}
    assert found[90] == "one long story that stands on two pages of a host 90"
