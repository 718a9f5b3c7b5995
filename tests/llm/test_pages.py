import pytest

from docengine.llm import pages

ARTICLE = "<article><h1>Title &amp; more</h1><p>First <b>bold</b>  text of the article that runs on for a while.<br>next line<p>Short.</p><p>A third paragraph, <a href='/x'>linked</a> and long enough to be content.</p></article>"
TEXT = "Title & more\nFirst bold text of the article that runs on for a while. next line\nShort.\nA third paragraph, linked and long enough to be content."


@pytest.mark.parametrize(
    "around",
    [
        "{}",
        "<html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav>{}<footer>&copy; us, a long footer text about nothing</footer></body></html>",
        "<body><header><h1>Site</h1></header><div class='ad'>Buy this very fine thing now for a low price today only.</div><main>{}</main><aside>Other things to read, a long list of words.</aside>",
        "<script>var a='<p>no</p>';</script>{}<div class='comments'><p>I think this article is wrong in so many ways, said a reader.</p></div>",
        "<div id='cookie-notice'>We use cookies for everything that we do here.</div>{}<form><label>Mail</label><input></form><section class='related-posts'><p>More</p></section>",
        "{}<article class='comment'><p>A reader's comment that is rather long, longer than the article in fact, as they sometimes are, on and on and on and on and on and on and on.</p></article>",
    ],
)
def test_article(around):
    assert pages.main_text(around.format(ARTICLE)) == TEXT


def test_without_article():
    html = "<body><div class=menu><a href=x>One</a><a href=y>Two</a></div><div><p>A first paragraph with plenty of words in it to be content.</p><p>And a second one with as many words as the first one has.</p></div><footer>foot</footer></body>"
    assert pages.main_text(html) == "A first paragraph with plenty of words in it to be content.\nAnd a second one with as many words as the first one has."


def test_broken_markup():
    assert pages.main_text("<article><p>open <b>bold<p>next &eacute;&#33;</article></b> tail") == "open bold\nnext é!"
    assert pages.main_text(None) == pages.main_text("") == pages.main_text("<nav>x</nav>") == ""


def test_frames(spark):
    rows = [(1, "u", ARTICLE, "x"), (1, "u", ARTICLE, "x"), (None, None, None, "x"), (2, "v", "", "x"), (3, "w", "<article>" + "<p>some words of text</p>" * 5000, "x")]
    got = pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    out = sorted(((r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got.collect()), key=str)
    assert out == sorted([(1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (None, None, "", 0), (2, "v", "", 0), (3, "w", "\n".join(["some words of text"] * 5000), 18 * 5000 + 4999)], key=str)
    assert pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string").limit(0)).count() == 0


def test_everything_in_the_region_without_article():
    long = "A paragraph with plenty of words in it to be content, and then some more words so that it is long."
    parts = [f"<p>{long}</p>", "<ul><li>one</li><li><b>two</b></li></ul>", "<table><tr><td>a</td><td>b</td></tr></table>", "<blockquote>quoted</blockquote>", "<section><h2>Part</h2><div>inner</div></section>", f"<p>{long}</p>"]
    html = f"<body><div class=menu><a href=x>One</a></div><div>{''.join(parts)}</div><footer>foot</footer></body>"
    assert pages.main_text(html) == "\n".join([long, "one", "two", "a", "b", "quoted", "Part", "inner", long])
    assert pages.main_text(f"<body><div>{parts[1]}{parts[0]}</div><div class=ad>Buy this</div></body>") == f"one\ntwo\n{long}"
    assert pages.main_text(f"<div>{parts[4]}<blockquote>{long} {long}</blockquote><p>end</p></div>") == f"Part\ninner\n{long} {long}\nend"


@pytest.mark.parametrize(
    "html",
    [
        f"<body><div id=page class='has-sidebar'>{ARTICLE}</div></body>", f"<body><div class='search'><div>{ARTICLE}</div></div><div class=ad>Buy this</div></body>",
        ARTICLE.replace("<article>", "<article class='post no-comments'>"), ARTICLE.replace("<h1>", "<h1 id='related'>"), ARTICLE.replace("<p>Short.", "<section id='search-results'><p>Short.</section>"),
        f"<div class='widget'>{ARTICLE.replace('article>', 'div>')}</div><div class='comments'>No.</div>", ARTICLE.replace("article>", "div>").replace("<div>", "<div class='notice'>"),
    ],
)
def test_names_that_drop_nothing(html):
    assert pages.main_text(html) == TEXT


def test_names_that_still_drop():
    more = "".join(f"<div class='{x}'><p>Something else that is here too, words.</p></div>" for x in ("related-posts", "ad ad-1", "x comments-list", "social_share_box"))
    assert pages.main_text(ARTICLE.replace("</article>", f"{more}</article>")) == TEXT


@pytest.mark.parametrize(
    "html",
    [
        f"<body><form id='aspnetForm' action='/'><nav><a href=/>Home</a></nav>{ARTICLE}<input></form></body>", f"<body class='search'><div class='site has-sidebar'>{ARTICLE}<div class='sidebar'>More</div></div></body>",
        ARTICLE.replace("<article>", "<article class='post sponsored'>") + "<p>A line below the article that is no small part of all the text of this page.</p>",
        f"<body>{ARTICLE}<form class='newsletter'><p>Please give us your address so that we can write to you every day.</p><label>Mail</label></form></body>",
    ],
)
def test_forms_and_wrappers(html):
    assert pages.main_text(html) == TEXT


def test_all_articles_with_clusters():
    second = ARTICLE.replace("First", "Other").replace("Title", "Second")
    assert pages.main_text(f"<body>{ARTICLE}<div class=ad>Buy this very fine thing now.</div>{second}</body>") == f"{TEXT}\n" + TEXT.replace("First", "Other").replace("Title", "Second")
    assert pages.main_text(ARTICLE.replace("<p>Short.", "<section id='search-engines'><p>Short.</section>")) == TEXT


def test_pages_built_from_known_text():
    """Random pages: what their articles hold, blocks of every kind, and nothing else."""
    import random

    r = random.Random(6)
    words = lambda n: " ".join(f"word{r.randrange(500)}" for _ in range(n))
    junk = [lambda: f"<nav><ul>{''.join(f'<li><a href=/{i}>{words(2)}</a></li>' for i in range(4))}</ul></nav>", lambda: f"<aside><p>{words(30)}</p></aside>", lambda: f"<div class='ad-box'><p>{words(20)}</p></div>", lambda: f"<script>var x = '{words(9)}';</script><style>p {{}}</style>", lambda: f"<footer><p>{words(12)}</p></footer>", lambda: f"<section class='comments'><article><p>{words(40)}</p></article></section>", lambda: f"<form><label>{words(2)}</label><input></form>"]
    for _ in range(60):
        blocks, expected = [], []
        for _ in range(r.randrange(2, 9)):
            kind, texts = r.choice(["p", "ul", "table", "blockquote", "h2", "div"]), [words(r.choice([1, 5, 40])) for _ in range(r.randrange(1, 4))]
            inner = {"ul": "<ul>{}</ul>", "table": "<table><tr>{}</tr></table>"}.get(kind, "{}")
            tag = {"ul": "li", "table": "td"}.get(kind, kind)
            blocks.append(inner.format("".join(f"<{tag}>{t.replace(' ', ' <i>', 1) + '</i>' if ' ' in t else t}</{tag}>\n" for t in texts)))
            expected += texts
        expected.append(words(50))
        blocks.append(f"<p>{expected[-1]}")
        around = [x() for x in r.sample(junk, 4)]
        inside = r.choice(junk[2:6])()
        html = f"<!doctype html><html><head><title>{words(3)}</title></head><body>{around[0]}{around[1]}<article>{blocks[0]}{inside}{''.join(blocks[1:])}</article>{around[2]}{around[3]}</body></html>"
        assert pages.main_text(html) == "\n".join(expected), html


@pytest.mark.parametrize("broken", ["<![foo[ x", "<![CDATA[ a < b ]]>", "<![if IE]>", "<!>", "<?php echo 1 ?>", "</>", "</ p>", "<!--->", "<!-- a > b -->", "<a href='x' =\"", "<p <b>", "<a b='c>d'>", "<script>if (a < b) '</p>'</script>", "<style>a > b {}</style>", "<\x00>"])
def test_odd_markup_ends_no_page(broken):
    """What stands behind it is read, as far as the construct itself ends."""
    for html in (broken, ARTICLE + broken, f"<article><p>Some words before it, enough of them.</p>{broken}"):
        pages.main_text(html)
    assert pages.main_text(ARTICLE + broken).startswith(TEXT)
    if broken.count("'") % 2 == 0 and broken.endswith(">"):
        got = pages.main_text(f"{broken}{ARTICLE}")
        assert got.endswith(TEXT)


@pytest.mark.parametrize("piece", ["<a ", "<div>x", "<div>", "<!--", "<a '", "<a ='>'", "<a =\">\"", "<![x[", "<b>x", "</b>", "<p>x", "&", "&amp", "<", "<script>", "<i><p>x</p>", "<table><tr><td>x", "</p x='"])
def test_a_long_page_of_anything(piece):
    """Time grows with the page, not with its square."""
    import time

    def took(size, before, after):
        html = before + piece * (size // len(piece)) + after
        began = time.process_time()
        pages.main_text(html)
        return time.process_time() - began

    for before, after in (("", ""), ("<b><article><p>", ""), ("", ">")):
        took(1 << 12, before, after)
        assert took(1 << 18, before, after) < 0.5 + 16 * took(1 << 15, before, after)


def test_unmatched_end_tags_below_many_elements():
    import time

    began = time.process_time()
    pages.main_text("<b><article>" + "<x>" * 10_000 + "</b>" * 10_000 + "<i>" * 10_000 + "</div>" * 10_000)
    assert time.process_time() - began < 8


def test_title_and_lead_before_the_clusters():
    long = "".join(f"<p>A paragraph, number {k}, with plenty of words in it to be content, and then some more words.</p>" for k in range(6))
    body = pages.main_text(f"<div>{long}</div>")
    assert pages.main_text(f"<div><h1>TITLE</h1></div><div><p>Short lead.</p></div><div>{long}</div>") == f"TITLE\nShort lead.\n{body}"
    assert pages.main_text(f"<nav>menu</nav><h1>TITLE</h1><div class=ad>Buy</div><article>{long}</article>") == f"TITLE\n{body}"
    assert pages.main_text(f"<header><h1>Site</h1></header><article>{long}</article>") == body
    assert pages.main_text(f"<h1>Site</h1><article><h2>Title</h2>{long}</article>") == f"Title\n{body}"


@pytest.mark.parametrize("name", ["user-comments", "reader_comments", "post-comments-area", "comments", "CommentList"])
def test_reader_comments_in_an_article(name):
    assert pages.main_text(ARTICLE.replace("</article>", f"<div class='{name}'><p>I disagree with all of it, said a reader.</p></div></article>")) == TEXT


def test_quotations_stay():
    assert pages.main_text(ARTICLE.replace("<p>Short.", "<blockquote class='comment'>Short.</blockquote>")) == TEXT
    assert pages.main_text(ARTICLE.replace("<p>Short.", "<div class='no-comments'>Short.</div>")) == TEXT
