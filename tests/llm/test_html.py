import random
import time

import pytest

from stratalog.llm.html import best_container, blocks, container_path, extract_main_text, main_text, read
from stratalog.llm.shared import Workspace


def planted(rng, i, style):
    para = lambda: " ".join(f"word{rng.randrange(99)}" for _ in range(rng.randrange(15, 60)))
    paras = [para() for _ in range(rng.randrange(2, 6))]
    title, extra = f"Title {i} & more", [f"{x} {i}." for x in ("Menu", "Advert", "Notice", "Reader comment", "Foot", "Side")]
    open_, close = {
        "article": ("<article>", "</article>"),
        "div": (f'<div class="wrap"><div class="post-body c{i}">', "</div></div>"),
        "table": ('<table><tr><td class="main">', "</td></tr></table>"),
    }[style]
    body = "".join(f"<p>{p.replace(' ', chr(10) + ' ', 2)}&amp;<b>b</b>old</p>" for p in paras)
    page = (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='<p>no</p>';</script></head><body>"
        f"<header><a href=/>Site</a></header><nav><ul><li><a href=x>{extra[0]}</a><li>b</ul></nav><!-- <p>hidden</p> -->"
        f'<div class="cookie-notice">{extra[2]}</div><div class=ad>{extra[1]}</div><aside class="sidebar">{extra[5] * 9}</aside>'
        f"{open_}<h1>{title.replace('&', '&amp;')}</h1>{body}<form><input name=q>Search</form>"
        f'<div id="comments"><p>{extra[3] * 20}</p></div>{close}<footer>&copy; {extra[4]}</footer></body></html>'
    )
    return page, " ".join([title, *[f"{p}&bold" for p in paras]])


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, host string")


def test_planted_articles(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for i in range(120):
        style = ("article", "div", "table")[i % 3]
        page, text = planted(rng, i, style)
        rows.append((i, f"https://{style}.example.org/{i}", page))
        want[i] = text
    rows += [(500, "https://article.example.org/x", None), (501, None, ""), (502, "junk", "plain &lt;text&gt;  here"), (1, "https://div.example.org/1", rows[1][2])]
    want |= {500: "", 501: "", 502: "plain <text> here"}
    for limit in (100, 0):
        got = extract_main_text(frame(spark, rows), Workspace(spark, "t"), broadcast_hosts=limit).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.text == want[r.page_id], r.page_id
            assert r.n_chars == len(r.text)
    assert extract_main_text(frame(spark, []), Workspace(spark, "t")).count() == 0


def test_unclosed_and_odd_markup():
    assert main_text("<body><article><p><b>One.<br><p>Two<i>x</i></article><footer>no", None) == "One. Twox"
    assert [b[0] for b in blocks('<div title="a>b">x</div><a href=y')] == ["x"]
    assert main_text("<p>" + "<div>" * 3000 + "deep", None) == "deep"


def test_marked_wrappers_keep_their_article():
    story, notice = "The river rose over the old bridge that night. " * 6, '<div class="cookie-notice">We use cookies.</div>'
    article = f"<article><h1>High water</h1><p>{story}</p></article>"
    want = f"High water {story.strip()}"
    for page in (
        f'<div class="layout has-sidebar">{article}</div>',
        f'<div id="page" class="no-sidebar">{article}<div class="sidebar">Other things</div></div>',
        f'<article class="post comments-open"><h1>High water</h1><p>{story}</p></article>',
        f'<article class="post tag-search"><h1>High water</h1><p>{story}</p></article>',
        f'<div class="search-page">{article}</div>',
        f'<div class="search-page"><div class="text"><h1>High water</h1><p>{story}</p></div></div>',
        f'<article><div class="post-header"><h1>High water</h1></div><p>{story}</p></article>',
        f'<div class="post"><div class="entry-header"><h1>High water</h1></div><p>{story}</p></div>',
    ):
        got = " ".join(b[0] for b in blocks(f"<html><body>{notice}{page}<footer>Foot</footer></body></html>"))
        assert got == want, page


def test_marked_boilerplate_stays_out():
    story = "The river rose over the old bridge. "
    comments = f'<div id="comments"><article class="comment"><p>{"I was there and saw it. " * 40}</p></article></div>'
    related = f'<section class="related"><article><a href="/x">{"Another story " * 30}</a></article></section>'
    for page in (f"<main><article><p>{story}</p></article>{comments}</main>{related}", f"<article><p>{story}</p>{comments}</article>{related}", f'<div><p>{story * 30}<span class="share">Share</span></p></div>{related}'):
        assert {b[0] for b in blocks(f"<body>{page}</body>")} <= {story.strip(), (story * 30).strip()}, page


def test_text_in_nested_containers_is_read_with_its_lead():
    long = lambda w: f"{w} of the long river. " * 50
    foot = '<div class="legal">All rights reserved.</div>'
    pages = {
        "article": f"<article><h1>T</h1><p>lead</p><section>{long('One')}</section><section>{long('Two')}</section></article>{foot}",
        "table": f'<div class="post"><h1>T</h1><p>lead</p><table><tr><td>{long("One")}</td><td>{long("Two")}</td></tr></table></div>{foot}',
        "quote": f'<div class="post"><h1>T</h1><p>lead</p><blockquote>{long("One")}</blockquote><div class="text"><div>{long("Two")}</div></div></div>{foot}',
    }
    for page in pages.values():
        for wanted in (None, container_path("body/article"), container_path("body/div.post")):
            assert main_text(f"<body>{page}</body>", wanted) == f"T lead {long('One').strip()} {long('Two').strip()}", page
    layout = f'<table><tr><td class="left">{"<p><a href=/x>Linked page</a></p>" * 9}</td><td class="text"><p>{long("One")}</p></td></tr></table>'
    assert main_text(f"<body>{layout}</body>", None) == long("One").strip()


def test_page_of_another_template_on_the_host(spark):
    story = "The river rose over the old bridge. " * 30
    rows = [(i, f"http://h.org/{i}", f"<body><div><h1>T{i}</h1><p>{story}</p></div></body>") for i in range(20)]
    rows.append((99, "http://h.org/x", f"<body><div>Small note.</div><article><h1>X</h1><section><p>{story}</p></section></article></body>"))
    got = {r.page_id: r.text for r in extract_main_text(frame(spark, rows), Workspace(spark, "t")).collect()}
    assert got == {i: f"T{i} {story.strip()}" for i in range(20)} | {99: f"X {story.strip()}"}


def test_an_article_is_never_left_for_a_part_of_it():
    long = "Of the long river. " * 60
    quote = f"<article><p>{'The author says. ' * 5}</p><blockquote>{long}</blockquote><p>And ends.</p></article>"
    section = f"<article><h1>Head</h1><p>Lead.</p><section>{long}</section></article>"
    assert main_text(f"<body>{quote}</body>", None) == f"{('The author says. ' * 5).strip()} {long.strip()} And ends."
    assert main_text(f"<body>{section}</body>", None) == f"Head Lead. {long.strip()}"


def test_deep_and_unclosed_pages_take_linear_time():
    began = time.perf_counter()
    for page, want in (("<div>" * 100_000 + "deep", "deep"), ("<div class=menu>" * 30_000 + "<p>x" * 10_000, "x"), ("<b>" * 60_000 + "<p>a</b>" * 10_000, "a"), ("<article class=comments>" * 20_000 + "t", ""), ("</section>" * 99_999 + "e", "e")):
        assert set(main_text(page, None).split()) == set(want.split())
    assert time.perf_counter() - began < 40


def test_votes_match_brute_force(spark):
    rng = random.Random(9)
    story = lambda n: "The river rose over the old bridge. " * n
    rows = []
    for i in range(90):
        a, b = rng.randrange(1, 40), rng.randrange(1, 40)
        rows.append((i, f"http://h{i % 4}.org/{i}", f"<body><div class='left'><p>{story(a)}</p></div><div class='right'><p>{story(b)}</p></div><p>{story(30)}</p></body>" if i % 5 else f"<article>{story(b)}</article>"))
    votes = {}
    for i, _, page in rows:
        path, worth = best_container(*read(page))
        own = votes.setdefault(i % 4, {})
        own[path] = own.get(path, 0) + worth
    best = {h: max(v, key=lambda p: (round(v[p], 3), p)) for h, v in votes.items()}
    got = {r.page_id: r.text for r in extract_main_text(frame(spark, rows).repartition(5), Workspace(spark, "t")).collect()}
    assert got == {i: main_text(page, best[i % 4]) for i, _, page in rows}


@pytest.mark.parametrize(
    "before, after",
    [
        ('<form id="aspnetForm" method="post">', "</form>"),
        ('<form><div class="search-page">', "</div></form>"),
        ("<article data-a hidden-x>", "</article>"),
        ("<article not-hidden>", "</article>"),
        ("<div data-hidden>", "</div>"),
        ('<div title="the hidden > door">', "</div>"),
    ],
)
def test_a_form_or_an_attribute_like_hidden_keeps_its_article(before, after):
    prose = "A long sentence about the harbour and its boats, told at length. " * 4
    page = f"<html><body><nav><a href=x>Home</a></nav>{before}<p>{prose}</p><p>The end of it.</p>{after}<footer>Imprint</footer></body></html>"
    assert main_text(page, None) == f"{prose.strip()} The end of it."


def test_forms_beside_an_article_and_hidden_elements_go():
    prose = "A long sentence about the harbour and its boats, told at length. " * 4
    page = f"<body><article><p>{prose}</p><form><label>Your mail</label><input name=m></form><p hidden>secret</p><div HIDDEN=''>secret</div></article><form>Search here</form></body>"
    assert main_text(page, None) == prose.strip()


@pytest.mark.parametrize("name", ["ad-hoc", "side-effects", "search-results-note2", "share-price", "comment-worthy", "alert-level-history"])
def test_paragraphs_named_for_what_they_tell_stay(name):
    prose = "A long sentence about the harbour and its boats, told at length. " * 4
    page = f'<body><article><p>{prose}</p><p class="{name}">A telling line.</p><p>End.</p></article></body>'
    assert main_text(page, None) == f"{prose.strip()} A telling line. End."


@pytest.mark.parametrize("name", ["ad", "ad-slot", "cookie-notice", "share-buttons", "advert x", "newsletter-signup", "social_links", "related-box"])
def test_paragraphs_that_are_marks_as_a_whole_go(name):
    prose = "A long sentence about the harbour and its boats, told at length. " * 4
    page = f'<body><article><p>{prose}</p><p class="{name}">Buy this now.</p><p>End.</p></article></body>'
    assert main_text(page, None) == f"{prose.strip()} End."


def test_a_headline_and_a_correction_beside_the_article_stay():
    prose = "A long sentence about the harbour and its boats, told at length. " * 4
    page = f'<body><div class="top"><a href=x>Home</a></div><div class="story"><h1>Headline of it</h1><article><p>{prose}</p></article><p>Correction: it was a ship.</p></div><div class="more"><p>Another page says more of the harbour.</p></div></body>'
    assert main_text(page, None) == f"Headline of it {prose.strip()} Correction: it was a ship."
