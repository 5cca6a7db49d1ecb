import time

import pytest

from plenum.llm import html_text

CHROME = ('<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>'
          '<nav><ul><li><a href="/a">menu</a></li></ul></nav><div class="ad">Buy this now, it is a long advert text that goes on and on.</div>%s'
          '<footer>&copy; site</footer></body></html>')


def page(body):
    return CHROME % body


def main_text(source):
    return html_text.extract(source, html_text.vote(source)[0])


def test_article_without_the_rest():
    body = ("<article><h1>Head &amp; shoulders</h1><p>One <b>bo</b>ld\n\n word.<br>Next&nbsp;line</p><p>Two<aside>side</aside></p><form>name <input></form>"
            '<div class="comments"><p>first!</p></div><script>x()</script><!-- no --></article>')
    assert main_text(page(body)) == "Head & shoulders One bold word. Next line Two"


def test_other_shapes():
    text = "Words of the story that are long enough to count. "
    shapes = {
        f'<div id="content"><p>{text}</p><p>{text}</p></div><div class="sidebar-left"><p>{text * 3}</p></div>': 2,
        f'<main><section><p>{text}</p></section><section><p>{text}</p></section></main><div role="complementary">{text * 5}</div>': 2,
        f'<div class="header">{text}</div><div class="post-body">{text}<br>{text}</div><div class="cookie-notice">{text * 4}</div>': 2,
        f"<table><tr><td>{text}</td></tr></table>": 1,
        f'<div class="page has-sidebar no-comments"><div class="story">{text}</div></div><ol class="comment-list"><li>{text * 3}</li></ol>': 1,
    }
    for body, times in shapes.items():
        assert main_text(page(body)) == " ".join([text.strip()] * times), body


def test_broken_markup():
    assert main_text("plain words") == "plain words"
    assert main_text("<article><p>open <b>never closed<p>next") == "open never closed next"
    assert main_text('<article><p title="a>b">x</p></div></article><script>if (a < b) {') == "x"
    assert main_text("<article>a < b and c</article>") == "a < b and c"
    assert main_text("<!-- never closed <p>gone</p>") == ""
    assert html_text.extract(None, None) == "" and html_text.vote("") == (None, 0.0)


def test_letters_that_grow_in_lower_case():
    """U+0130 is two characters in lower case; what stands before a script must not shift its end."""
    story = "\u0130stanbul " * 60
    body = f"<article><p>{story}</p><SCRIPT>var a = 1;</Script><p>after the script</p><style>p{{}}</style>tail</article>"
    assert main_text(page(body)) == f"{story}after the script tail"
    leak = f"<article><p>{story}</p><script>one()</script>x<script>{'two(); ' * 30}</script><p>end</p></article>"
    assert main_text(page(leak)) == f"{story}x end"


def test_a_page_without_the_winning_path_uses_its_own():
    assert html_text.extract(page("<article><p>own text</p></article>"), "html/body/div.story") == "own text"


def test_hosts_vote(spark):
    story = "A long story that fills the page with many words. " * 3
    odd = f'<div class="story-{{}}"><p>short</p></div><div class="links-7"><p>{story}</p></div>'
    rows = [(i, f"https://A.example/{i}", page(f'<div class="story-{i}"><p>{story}</p></div><div class="links-{i}"><p>tail</p></div>')) for i in range(5)]
    rows += [(9, "https://a.example/9", page(odd.format(9))), (10, None, None), (11, "no url", page(""))]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    out = {r["page_id"]: r["text"] for r in html_text.extract_pages(pages).collect()}
    assert out[0] == " ".join(story.split()) and out[9] == "short" and out[10] == "" and out[11] == ""
    assert html_text.extract_pages(pages.limit(0)).count() == 0
    assert html_text.extract_pages(pages.union(pages)).count() == 2 * len(rows)


def test_very_long_page():
    body = "<article>" + "<p>word &lt; &#233;</p>" * 50_000 + "</article>"
    assert main_text(page(body)) == " ".join(["word < é"] * 50_000)


STORY = " ".join(f"Sentence number {i} of a story that goes on." for i in range(30))


@pytest.mark.parametrize("wrapper", ['form id="aspnetForm"', 'div class="layout sidebar-right"', 'div class="page footer-visible"', 'div class="toc-layout"', 'div id="public-notices"',
                                     'div class="post comments-open"', 'div class="widget"'])
@pytest.mark.parametrize("inner", ["<article><p>%s</p></article>", '<div class="story"><h1>Story</h1><p>%s</p></div>', "<h1>Story</h1><p>%s</p>"])
def test_a_wrapper_with_a_hint_does_not_take_the_article_with_it(wrapper, inner):
    name = wrapper.split()[0]
    sides = '<div class="sidebar"><p>See also this and that page.</p></div><div class="comments"><p>I was first!</p></div><form>Search <input></form>'
    if "comments-open" in wrapper and "div" not in inner and "article" not in inner:
        inner = "<article>%s</article>" % inner
    got = main_text(page(f"<{wrapper}>{inner % STORY}{sides}</{name}>"))
    assert got.removeprefix("Story ") == STORY


def test_hints_are_followed_where_an_article_is_left():
    for word in ("comments", "sidebar", "related", "notice", "newsletter"):
        long = f'<div class="{word}"><p>{STORY}</p></div>'
        assert main_text(page(f"<article><p>{STORY[:400]}</p></article>{long}")) == STORY[:400].strip(), word
    cards = "".join(f"<article><p>{STORY[:150]}</p></article>" for _ in range(3))
    assert main_text(page(f'<div class="story"><p>{STORY}</p></div><div class="related">{cards}</div>')) == STORY


def test_wrappers_inside_each_other():
    assert main_text(page(f'<form><div class="layout sidebar-left"><div class="toc"><p>one two</p></div><div class="notices"><p>{STORY}</p></div></div></form>')) == STORY


@pytest.mark.parametrize("piece", ['<p "x', "<p 'x", '<p "x\'', "<a", "<a<", "</ul><div>", "<div>", "<ul>x", "<!-", "<![CDATA[", '<p a="', "<script", "&amp", "<table><tr><td>", "</div>x"])
def test_time_grows_with_the_page(piece):
    """A page of one construct repeated, 1 MB of it: no scan starts again from every place."""
    source = "<article><p>story</p></article>" + piece * (1_000_000 // len(piece))
    start = time.process_time()
    html_text.extract(source, html_text.vote(source)[0])
    assert time.process_time() - start < 60
    small = "<article><p>story</p></article>" + piece * (100_000 // len(piece))
    start = time.process_time()
    html_text.extract(small, None)
    fast = time.process_time() - start
    start = time.process_time()
    html_text.extract(source, None)
    assert time.process_time() - start < 40 * fast + 0.5


def test_unbalanced_quotes_lose_no_text():
    assert main_text('<article><p title="x>one</p><p>two</p></article>') == "one two"
    assert main_text("<article><p title='x>one</p><p class=\"a>b\">two</p></article>") == 'one b">two'
    assert main_text("<article>one <p") == "one <p"


def test_awkward_rows(spark, awkward):
    from pyspark.sql import functions as F

    pages = awkward.select(F.col("doc_id").alias("page_id"), F.lit("http://h/x").alias("url"), F.col("text").alias("html"), *[c for c in awkward.columns if c not in ("url", "html")])
    rows = {(r["page_id"], r["text"]) for r in html_text.extract_pages(pages).collect()}
    want = {(r["page_id"], " ".join((r["html"] or "").split())) for r in pages.collect()}
    assert rows == want
