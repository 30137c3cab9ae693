"""Main text of small pages."""

import time

import pytest

from merchgrid.llm.html_text import SURGE, WINDOW, extract, lines, with_text


def test_article_page():
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></li></ul></nav>'
        '<!-- ad --><div class="ad">Buy this now, it is a long advert text that would surge by itself if it were not marked as one.</div>'
        "<article><h1>Head</h1><p><b>One &amp;&amp; two.<br><p>Ti.</p><p>Three\n  four&nbsp;five</p></article><footer>&copy; f &middot; x</footer>"
    )
    assert extract(page) == "Head\nOne && two.\nTi.\nThree four five"


def test_other_parts():
    body = "<p>" + "word " * 40 + "</p><p>short</p>"
    text = "word " * 39 + "word\nshort"
    for junk in (
        '<div id="sidebar"><p>{}</p></div>', "<aside>{}</aside>", '<div class="cookie-notice">{}</div>', "<form><p>{}</p><input></form>", '<section class="comments"><div class="comment">{}</div><div>{}</div></section>',
        "<header>{}</header>", '<div role="navigation">{}</div>', "<noscript>{}</noscript>", '<ul class="menu"><li>{}</li></ul>',
    ):
        j = junk.replace("{}", "boiler plate " * 20)
        assert extract(f"<body>{j}<div>{body}</div>{j}</body>") == text
        assert extract(f"<body>{j}<main>{body}{j}</main>{j}</body>") == text
        assert extract(f"<body>{j}<article><header><h1>H</h1></header>{body}</article>") == "H\n" + text


def test_sums_decide_beside_articles():
    body = "word " * 39 + "word"
    cards = '<article><a href="/x">One more story</a></article>'
    assert extract(f"<body>{cards}<div><p>{body}</p></div>{cards}</body>") == body
    assert extract(f"<body><div><p>{body}</p></div><main><p>One line.</p></main></body>") == body + "\nOne line."
    assert extract(f"<body><div>Low.</div><article><p>{body}</p></article></body>") == body
    assert extract(f"<body><article><p>Low.</p></article><div><p>{body}</p></div></body>") == "Low.\n" + body


def test_marked_parts_inside_the_text():
    body = "word " * 39 + "word"
    byline, advert = '<div class="byline">By A. Writer</div>', '<div class="ad">Buy this.</div>'
    page = f"<body><h1>Storm hits coast</h1>{byline}<p>{body}</p>{advert}<p>Low.</p>{advert}<p>{body}</p>{advert}<p>See you soon.</p></body>"
    assert extract(page) == f"Storm hits coast\n{body}\nLow.\n{body}\nSee you soon."
    assert extract(f"<body><p>Site</p><h1><a href='/'>Head</a></h1><p>Lead.</p>{byline}<p>Still.</p>{advert}<p>{body}</p></body>") == f"Head\nLead.\nStill.\n{body}"
    links = '<ul><li><a href="/a">a</a></li></ul>'
    assert extract(f"<body><h2>Pages</h2>{byline}{links}{byline}<p>{body}</p>{advert}{links}</body>") == body
    assert extract(f"<body><h1>Head</h1>{byline}<p>Short.</p>{advert}<p>End.</p></body>") == "Head\nShort.\nEnd."


def test_edges():
    assert extract("") == "" and extract("<p></p>") == "" and extract("plain") == "plain"
    assert extract("<div class='ad'>x") == "" and extract("<p>a<foo") == "a"
    assert extract("<article><p>a</p></article>") == "a"
    assert extract("<table><tr><td>a</td><td>b</td></tr></table>") == "a b"
    assert extract('<p class="ad">x<p>y') == "y"
    assert extract("<div class='ad'><div>x</div>y</div><p>z</p>") == "z"
    assert extract("<p>" + "a < b &lt; c " * 30 + "</p>").startswith("a < b < c")


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "x"), (2, None, None, "y")], "page_id long, url string, html string, text string")
    assert [r.text for r in with_text(df).orderBy("page_id").collect()] == ["a", ""]
    assert with_text(df.limit(0)).count() == 0


def test_other_words_mark_nothing():
    body = "word " * 39 + "word"
    for name in ("long-form", "form-factor", "market-share", "press-notice", "post comments-open", "entry-social-history", "no-sidebar", "has-comments"):
        for element in ("div", "article", "section"):
            assert extract(f'<body><{element} class="{name}"><p>{body}</p></{element}></body>') == body, name
    for name in ("site-footer", "cookie-notice", "related-posts", "adSlot2", "main-nav", "x comments", "newsletter_signup"):
        assert extract(f'<body><p>{body}</p><div class="{name}"><p>{body} again</p></div></body>') == body, name
    assert extract(f'<body><article class="teaser"><p>{body}</p></article></body>') == body


def test_text_ends_at_the_dive_behind_an_article():
    body = "word " * 39 + "word"
    assert extract(f"<body><article><p>{body}</p></article><p>tail</p><ul><li>Copyright 2020 all</li></ul></body>") == body
    assert extract(f"<body><article><p>{body}</p></article><p>tail</p><article><p>End.</p></article></body>") == f"{body}\ntail\nEnd."


def test_malformed_tags():
    assert extract("<p title='a>b'>x</p><p>y<") == "x\ny<" and extract('<p title="a>x</p><p>y') == "x\ny"
    assert extract("a <b>c</b> <!x y> <?z> </> d") == "a c d" and extract("<xmp>seen</xmp>") == "seen"


@pytest.mark.parametrize("unit", ["<a x", '<a "', "<a '\">", '<a ">" ', "<!-- ", "<p", "<script>", "</", "<", "<p>x", '<div class="ad">', "<h1>a</h1><aside>b</aside>", "a&amp", "<a>b</a>", "<p class=class=", "</p x"])
def test_linear_on_a_megabyte(unit):
    start = time.perf_counter()
    extract(unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - start < 10


def test_windows_against_a_naive_rule():
    """Without marked parts: kept is what lies from the first to the last window over the threshold, by trying every window."""
    for sizes in ([5, 40, 30, 20, 3], [90, 0, 1], [10, 10, 10], [SURGE, 1, 1, 1], [30, 30, 27], [30, 30, 26]):
        html = "<body><aside>x</aside>" + "".join(f"<p>{'y' * n}</p>" for n in sizes) + "<aside>x</aside><p>low</p></body>"
        surge = any(sum(sizes[i : i + WINDOW]) > SURGE for i in range(len(sizes)))
        want = "\n".join([*("y" * n for n in sizes if n), "low"])
        assert extract(html) == want, (sizes, surge)
        linked = html.replace("<body>", "<body><p>Lead in.</p>")
        assert extract(linked) == (want if surge else "Lead in.\n" + want), (sizes, surge)
    assert [x[1] for x in lines("<p>ab<a>cd</a>e</p>")] == [3]
