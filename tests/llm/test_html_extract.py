import html as h
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import html_extract as H

PROSE = "The house of the old man was in the middle of the wood, and it is said that he was not at home for many years."


def article(page: str) -> str:
    """The article's blocks by plain splitting, for pages of one template."""
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    parts = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(p for p in parts if p)


def test_whole_table(spark):
    path = "/root/testdata/sf0.01"
    got = {r["page_id"]: r for r in H.query(spark, path).collect()}
    for r in spark.read.parquet(f"{path}/pages.parquet").collect():
        assert got[r["page_id"]]["text"] == article(r["html"])
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"]) and got[r["page_id"]]["url"] == r["url"]


def test_blocks_without_an_article_element():
    page = f"""<html><head><title>T</title><style>p {{}}</style></head><body><header>My site</header><ul class="menu"><li><a href="/">Home</a><li><a href="/x">More</a></ul>
    <div id="content"><h2>A story</h2><p>{PROSE} {PROSE}</p><p>Short one.</p><p>{PROSE} {PROSE}</p></div><div class="cookie-notice"><p>{PROSE} {PROSE}</p></div>
    <p><a href="a">one link</a> <a href="b">another link</a></p><aside><p>{PROSE} {PROSE}</p></aside><section id="comments"><p>{PROSE} {PROSE}</p></section><form><p>{PROSE} {PROSE}</p></form><footer>&copy; me</footer>"""
    assert H.main_text(page) == f"A story\n{PROSE} {PROSE}\nShort one.\n{PROSE} {PROSE}"


def test_boilerplate_inside_an_article():
    page = f'<article><h1>T &amp; U</h1><p>Yes.</p><div class="ad">Buy {PROSE}</div><p>a&nbsp;b\n c</p><ul class="share-buttons"><li>x</ul><div class="comments"><p>{PROSE}</p></div><script>if (a<b) x("</p>")</script><p>End</article><p>{PROSE} {PROSE}</p>'
    assert H.main_text(page) == "T & U\nYes.\na b c\nEnd"


def test_second_pass_inherits():
    blocks = [H.Block("x", "p", 0, 0, False, label) for label in ("good", "", "good", "", "bad")]
    H.second_pass(blocks)
    assert [b.label for b in blocks] == ["good", "good", "good", "bad", "bad"]


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<!--", "<script>", "<p class='x", "</p></div>", "<title>t</title>", "<a href=\"x>y\">", "&#x110000; &bogus;"])
def test_odd_pages(page):
    assert H.main_text(page) == ""


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<article>", "</article>", "<b>", "</b>", "<br>", "text ", "<", ">", '"', "<!--", "-->", "<script>", "</script>", "&amp;", "<li>", "<a href=x>", "</a>"]), max_size=40))
def test_any_markup(parts):
    page = "".join(parts)
    text = H.main_text(page)
    assert all(line == " ".join(line.split()) and line for line in text.split("\n")) or text == ""


def test_long_pages_take_time_in_proportion():
    import time

    began = time.process_time()
    H.main_text("<p class='" * 20_000)
    H.main_text("<div>" * 20_000 + "x")
    H.main_text('<a title="' * 20_000 + ">" * 20_000)
    assert time.process_time() - began < 20


def test_edges(spark):
    df = spark.createDataFrame([(1, "u", None), (1, "u", None), (2, None, "<article>x</article>"), (None, "u", "")], "page_id long, url string, html string")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in H.extract(df).collect()) == [(0, "", 0), (1, "", 0), (1, "", 0), (2, "x", 1)]
    assert H.extract(df.limit(0)).count() == 0


def test_quoted_signs_of_any_length():
    for size in (10, 100_000):
        for quote in "\"'":
            page = f"<article><p>One.</p><img alt={quote}x > y{quote} src={quote}data:{'A' * size}{quote}><p>Two.</p><div data-x = {quote}{'<p>no</p>' * size}{quote}>Three.</div></article>"
            assert H.main_text(page) == "One.\nTwo.\nThree."


@pytest.mark.parametrize("mark", ["content with-sidebar", "no-sidebar", "has-banner", "social-page"])
def test_layout_wrappers_decide_nothing(mark):
    inner = f'<article><h1>T</h1><p>Yes.</p><div class="ad">{PROSE}</div><p>{PROSE}</p></article><div class="sidebar"><p>{PROSE}</p></div>'
    assert H.main_text(f'<body><div class="{mark}"><div id="{mark}">{inner}</div></div><footer>x</footer></body>') == f"T\nYes.\n{PROSE}"
    assert H.main_text(f'<body><div class="{mark}"><p>{PROSE} {PROSE}</p><div class="sidebar"><p>{PROSE}</p></div><p>{PROSE} {PROSE}</p></div></body>') == f"{PROSE} {PROSE}\n{PROSE} {PROSE}"


def test_comments_as_articles_stay_boilerplate():
    page = f'<body><div id="post"><p>{PROSE} {PROSE}</p><p>{PROSE} {PROSE}</p></div><div id="comments"><article><p>{PROSE} {PROSE}</p></article></div></body>'
    assert H.main_text(page) == f"{PROSE} {PROSE}\n{PROSE} {PROSE}"


def variants(page: str) -> dict[str, str]:
    """The page with its article element replaced by elements that say nothing."""
    plain = page.replace("<article>", "<div>").replace("</article>", "</div>")
    return {"div": plain, "gone": page.replace("<article>", "").replace("</article>", ""), "deep": plain.replace("<div>", '<div id="x"><section><div>').replace("<nav>", "<div>").replace("</nav>", "</div>")}


def test_the_rules_carry_pages_without_an_article_element(spark):
    from collections import Counter

    for name in ("div", "gone", "deep"):
        want = got = kept = 0
        for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("html").collect():
            lines, told = article(r["html"]).split("\n"), H.main_text(variants(r["html"])[name]).split("\n")
            want, got, kept = want + len(lines), got + len(told), kept + sum((Counter(lines) & Counter(told)).values())
        assert kept >= 0.98 * want and kept >= 0.98 * got, name


@pytest.mark.parametrize("inline", ["<button>Share this now</button>", "<label>Your name</label>", "<span class='advert'>Buy <span>this</span> now</span>", '<a class="share-links" href="x">Share</a>', "<em hidden>x</em>"])
def test_inline_boilerplate_leaves_its_block(inline):
    assert H.main_text(f"<article><p>One {inline} two.</p>{inline}<p>Three.{inline}</p></article>") == "One two.\nThree."


def test_classes_are_matched_as_a_whole():
    for mark in ("social-history", "advice", "reply-to-critics", "navigational", "no-banner"):
        assert H.main_text(f"<article><p>One.</p><p class='{mark}'>Two.</p><div id='{mark}'>Three.</div></article>") == "One.\nTwo.\nThree."
    for mark in ("social", "post ad", "cookie_notice", "sidebar-right", "comments-list", "newsletter-signup-form", "sidebarRight", "relatedPosts", "ad-300x250", "SOCIAL", "user-comments", "privacy-notice"):
        assert H.main_text(f"<article><p>One.</p><p class='{mark}'>Two.</p><div id='{mark.split()[-1]}'>Three.</div></article>") == "One."


def test_tags_end_where_their_attributes_say():
    for tag in ("<a href='x' title=\"a > b\">", '<a data-x = "a>b">', "<a title='1 > 0' data-y=a\"b>", '<a href=x/ alt="</a>" >', "<a\ntitle=\n'>'\n>"):
        assert H.main_text(f"<article><p>{tag}T</a> and words.</p></article>") == "T and words."
    assert H.main_text('<article><p title="1 > 0 ' + "x" * 70_000 + '">Yes.</p></article>') == "Yes."


def test_stray_tags_take_time_in_proportion():
    import time

    for page in ("<div>" * 20_000 + "</b>" * 20_000, "<div>x" * 20_000 + "</p>" * 20_000, "<a>" * 20_000 + "<p></p>" * 20_000, "<head>" * 20_000, "<svg>" * 20_000, "<div>" * 20_000 + f"<p>{PROSE}</p>" * 2000, "<span class=ad>" * 20_000 + "x", "<p a='" * 20_000 + '"'):
        began = time.process_time()
        H.main_text(page)
        assert time.process_time() - began < 2, page[:20]


def test_neighbours_of_the_same_element_are_nearest():
    page = f"""<body><div>My site.</div><p>Posted by me</p><div><h1>Title</h1><p>Short.</p><p>{PROSE} {PROSE}</p><ul><li><a href="a">a link</a><li><a href="b">another</a></ul><p>Two words</p></div><p>Powered by it</p></body>"""
    assert H.main_text(page) == f"Title\nShort.\n{PROSE} {PROSE}\nTwo words"


def test_prose_beside_an_article_must_be_longer():
    inner = f"<article><h1>T</h1><p>{PROSE} {PROSE}</p></article>"
    assert H.main_text(f"<body>{inner}<div><p>{PROSE} {PROSE}</p></div></body>") == f"T\n{PROSE} {PROSE}"
    long = " ".join([PROSE] * 6)
    assert H.main_text(f"<body><article class='card'><p>Teaser.</p></article><div><p>{long}</p></div></body>").endswith(long)


def test_languages_without_stop_words():
    text = "東京は日本の首都である。" * 40
    assert H.main_text(f"<body><ul><li><a href='x'>家</a></ul><div><h1>題</h1><p>{text}</p><p>短い。</p></div><footer>x</footer></body>") == f"題\n{text}\n短い。"
