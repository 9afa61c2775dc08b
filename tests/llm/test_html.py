import pytest

from foretrace.llm import html

PAGE = """<!DOCTYPE html><html><head><title>Title words here</title><style>p{margin:0}</style><script>var t="</p><p>x";</script></head>
<body><nav><ul><li><a href="/a">Home page link</a></li></ul></nav><!-- <p>comment</p> --><div class="ad">Buy these wonderful things now please</div>
%s<footer>&copy; site &middot; all words of the footer</footer></body></html>"""
ARTICLE = """<article><h1>A  heading&amp;more</h1><p><b>First &lt;b&gt; text,<br>with
a break.<p>Second one &eacute;&#233;&#x4e2d; a &amp b, so some more words to read.</p><aside>Side box words</aside><form>Name <input></form>
<div class="cookie-notice">We use cookies</div><ul><li>point one</li><li>point<b>ed</b> two</li></ul><p>End.</p><section id="comments"><p>reader says this and that</p></section></article>"""
WANTED = ["A heading&more", "First <b> text, with a break.", "Second one éé中 a & b, so some more words to read.", "point one", "pointed two", "End."]
DIVS = "<div id=wrap><div>" + "".join(f"<p>Paragraph {k} has a number of plain words in it.</p>" for k in range(6)) + "</div></div>"


@pytest.fixture(scope="module")
def weight():
    counts = {}
    blocks, tokens = html.parsed(PAGE % ARTICLE)
    for kind, b, n in tokens:
        key = kind, blocks[b].inside and not blocks[b].junk
        counts[key] = counts.get(key, 0) + n
    return html.weights(counts)


def test_article_without_the_rest(weight):
    assert html.main_text(PAGE % ARTICLE, weight).split("\n\n") == WANTED


def test_names_of_the_page_itself_are_no_junk(weight):
    page = (PAGE % ARTICLE).replace("<body>", '<body class="has-sidebar">').replace("<article>", '<article id="main-with-comments">')
    assert html.main_text(page, weight).split("\n\n") == WANTED


def test_pages_that_mark_no_article(weight):
    text = html.main_text(PAGE % DIVS, weight)
    assert text.split("\n\n") == [f"Paragraph {k} has a number of plain words in it." for k in range(6)]
    assert html.main_text(PAGE % DIVS, html.weights({})) == text


def brute_region(tokens, weight):
    score = [n * weight.get(kind, -1.0 if kind.startswith("tag") else 0.5) for kind, _, n in tokens]
    return max(sum(score[a:b]) for a in range(len(score)) for b in range(a + 1, len(score) + 1))


def test_region_has_the_largest_sum(weight):
    for page in (PAGE % ARTICLE, PAGE % DIVS, PAGE % "<p>one</p>"):
        tokens = html.parsed(page)[1]
        first, last = html.best_region(tokens, weight)
        own = [k for k, (kind, b, _) in enumerate(tokens) if first <= b <= last and kind.startswith("word")]
        score = sum(n * weight.get(kind, 0) for kind, _, n in tokens[own[0] : own[-1] + 1])
        assert abs(score - brute_region(tokens, weight)) < 1e-9


@pytest.mark.parametrize("page", ["", "   ", "<", "<<<>>>", "<p", "<p title=\"x>y", "</div></div>", "<script>never closed <p>x</p>", "<!-- open", "<!doctype", "<a href='\"'>", "& &amp &#xD800; &#0;"])
def test_broken_pages_do_not_fail(page, weight):
    assert isinstance(html.main_text(page, weight), str)


def test_long_pages_take_linear_time(weight):
    page = PAGE % ("<article>" + "<p>some words of a text</p>" * 50_000 + "<p title=\"broken>x</p>" * 2000 + "</article>")
    assert html.main_text(page, weight).count("\n\n") >= 50_000


def test_tags_end_outside_their_quotes(weight):
    state = "x > y <p>" * 600
    for given in (f'data-state="{state}"', f"data-state='{state}'", """title='5" > 4'""", '''title="it's > that"'''):
        page = (PAGE % ARTICLE).replace("<article>", f"<article {given}>").replace("<p>End.", f"<p {given}>End.")
        assert html.main_text(page, weight).split("\n\n") == WANTED
    assert html.main_text(PAGE % ARTICLE + "<p title='never closed>", weight).split("\n\n") == WANTED


@pytest.mark.parametrize("piece, wanted", [
    ('See <a href="/hidden-gems">these</a> and much more', "See these and much more"), ('a <span hidden>x <span>y</span> z</span> b', "a b"),
    ("a <span hidden>never closed", "a"), ('<i data-hidden="false" title="hidden costs">a</i> b', "a b"), ("<i style='display: none'>a</i> b <b>c</b>", "b c")])
def test_only_hidden_elements_are_hidden(weight, piece, wanted):
    page = (PAGE % ARTICLE).replace("<p>End.", f"<p>{piece}</p><div title='hidden costs' data-hidden=false><p>All of it.</p></div><p>End.")
    assert html.main_text(page, weight).split("\n\n") == [*WANTED[:-1], wanted, "All of it.", "End."]


@pytest.mark.parametrize("wrapper", ['div class="page has-sidebar"', 'div id="content-with-sidebar"', 'div class="widget"', "form id=aspnetForm", 'div class="single comments-open"'])
def test_names_of_wrappers_do_not_empty_the_page(weight, wrapper):
    for inside in (ARTICLE, "<div><h1>A heading</h1>" + DIVS + "</div>"):
        page, name = PAGE % inside, wrapper.split()[0]
        wrapped = page.replace(inside, f"<{wrapper}>{inside}</{name}>") if name == "div" else page.replace("<body>", f"<body><{wrapper}>").replace("<form>Name <input></form>", "")
        assert html.main_text(wrapped, weight) == html.main_text(page, weight) != ""


def test_comments_longer_than_the_text_stay_out(weight):
    comments = '<section class="comments">' + "<p>reader says this and that at length</p>" * 60 + "</section>"
    assert html.main_text((PAGE % ARTICLE).replace("</article>", comments + "</article>"), weight).split("\n\n") == WANTED


def test_the_region_chooses_among_articles(weight):
    cards = "".join(f'<article><h2>Card {k}</h2><a href="/c{k}">Read more of this</a></article>' for k in range(4))
    comments = "".join(f'<article class="comment"><p>Reader {k} says this and that about it.</p></article>' for k in range(3))
    page = PAGE % (f"<main>{ARTICLE}</main><div><ul><li><a href='/x'>a</a></li><li><a href='/y'>b</a></li></ul></div>{cards}{comments}")
    assert html.main_text(page, weight).split("\n\n") == WANTED
    nested = (PAGE % ARTICLE).replace("</article>", comments + "</article>")
    assert html.main_text(nested, weight).split("\n\n") == WANTED


def test_unmarked_text_beside_an_article_is_kept(weight):
    beside = "".join(f"<p>Paragraph {k} has a number of plain words in it.</p>" for k in range(8))
    text = html.main_text(PAGE % ("<div>" + ARTICLE + beside + "</div>"), weight).split("\n\n")
    assert text == WANTED + [f"Paragraph {k} has a number of plain words in it." for k in range(8)]


def test_the_scan_finds_articles_whose_marks_are_gone(weight):
    page = (PAGE % ARTICLE).replace("<article>", "<div>").replace("</article>", "</div>")
    assert html.main_text(page, weight).split("\n\n") == WANTED


def test_every_page_has_a_row(spark):
    rows = [(1, "u", PAGE % ARTICLE, "t"), (1, "u", PAGE % ARTICLE, "t"), (2, None, None, "t"), (None, "v", "", "t"), (3, "w", PAGE % "", "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    out = html.extracted(df).collect()
    assert len(out) == 5 and all(r.n_chars == len(r.text) for r in out)
    assert sorted(r.text for r in out) == ["", "", "", "\n\n".join(WANTED), "\n\n".join(WANTED)]
    assert html.extracted(df.limit(0)).count() == 0
