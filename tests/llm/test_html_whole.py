"""Articles of pages without article elements stay whole, also on hosts of several layouts."""

from claimforge.llm import html_extract as H

POST = "<body><nav><a href=/>menu</a></nav><div class=top><a href=/a>a link</a> <a href=/b>b link</a></div><div class=post><h1>title {}</h1><p>lead</p><div class=text><p>{}</p></div><p>closing</p></div></body>"
PARTS = "<body><section class=one><p>{}</p></section><section class=two><p>last tenth</p></section></body>"


def texts(spark, rows):
    df = spark.createDataFrame([(i, "http://h/", h) for i, h in enumerate(rows)], "page_id long, url string, html string")
    return {r.page_id: r.text for r in H.extract(df).collect()}


def test_div_layouts(spark):
    body = "many words of the text " * 20
    got = texts(spark, [POST.format(i, body + str(i)) for i in range(4)])
    assert got == {i: f"title {i}\nlead\n{body}{i}\nclosing" for i in range(4)}
    got = texts(spark, [PARTS.format(f"part {i} " * 20) for i in range(3)])
    assert got == {i: (f"part {i} " * 20).strip() + "\nlast tenth" for i in range(3)}


def test_mixed_hosts(spark):
    """A page of another layout that has a small container of the winner's path keeps its text; the host's own side containers go."""
    usual = "<body><article><p>{}</p></article><div class=extra><p>more of this host</p></div></body>"
    rare = "<body><article><p>teaser</p></article><div class=story><p>{}</p><p>end</p></div></body>"
    story = "the story of the page " * 10
    got = texts(spark, [usual.format(f"article {i} " * 20) for i in range(5)] + [rare.format(story), usual.format("few")])
    assert got[0] == ("article 0 " * 20).strip() and got[5] == f"teaser\n{story.strip()}\nend" and got[6] == "few"


def test_wrappers_named_like_boilerplate():
    story = "<h1>Head</h1><p>" + "the story goes on " * 20 + "</p>"
    want = "Head\n" + ("the story goes on " * 20).strip()
    menu = "<nav><a href=/>menu</a></nav><div class=sidebar><p>side text</p></div>"
    for open_, close in (
        ('<div class="layout no-sidebar"><article>', "</article></div>"),
        ('<div id="page" class="with-sidebar"><article>', "</article></div>"),
        ('<div class="site search"><article>', "</article></div>"),
        ("<form action=/><article>", "</article></form>"),
        ('<form action=/><div class="sidebar">', "</div></form>"),
        ("<main>", '<section class="thread"><article class="comment"><p>I hate it</p></article></section></main>'),
        ("<article>", '<div class="comments"><p>I hate it, and all of you</p></div></article>'),
        ("<article><div class=ad>buy</div>", '<div class="share-buttons">share</div></article><div id=comment-list><p>me too</p></div>'),
    ):
        assert H.main_text(f"<body>{menu}{open_}{story}{close}<footer>end</footer></body>", None) == want, open_
    kept = H.main_text("<article><h1 class='page-header'>T</h1><h2 id='related-work'>R</h2><section id='search-methods'><p>long text of it</p></section><p title=it's data-id=ads>q</p></article>", None)
    assert kept == "T\nR\nlong text of it\nq"


def test_long_and_deep_pages_take_linear_time():
    import time

    for page, want in (
        ("<div>" * 100_000 + "x", "x"),
        ("<div class=a><p>t" * 20_000, "\n".join("t" * 20_000)),
        ("<p title='a" * 50_000, ""),
        ('<b "' * 50_000 + ">x", "x"),
        ("<p>" + "a < b & c </ d <" * 50_000, None),
    ):
        began = time.perf_counter()
        text = H.main_text(page, "body/div.a")
        assert want is None or text == want
        assert time.perf_counter() - began < 3


def test_pages_of_the_tables_by_a_plain_extractor():
    """On the test tables, whose pages have an article or a div of the class main, that element's blocks are the text."""
    from html.parser import HTMLParser

    import duckdb

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.depth, self.skip, self.out, self.piece = 0, 0, [], []

        def cut(self):
            if text := " ".join("".join(self.piece).split()):
                self.out.append(text)
            self.piece = []

        def handle_starttag(self, tag, attrs):
            if tag in ("script", "style"):
                self.skip += 1
            if tag in H.BLOCK or tag in H.AWAY:
                self.cut()
            if tag == "br" and self.depth:
                self.piece.append(" ")
            if tag == self.within and (self.depth or dict(attrs).get("class") == self.named):
                self.depth += 1

        def handle_endtag(self, tag):
            if tag in ("script", "style"):
                self.skip -= 1
            if tag in H.BLOCK or tag in H.AWAY:
                self.cut()
            if tag == self.within and self.depth:
                self.depth -= 1

        def handle_data(self, data):
            if self.depth and not self.skip:
                self.piece.append(data)

    seen = 0
    for (html,) in duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet' where html is not null").fetchall():
        if html.count("<article>") != 1 or "</article>" not in html:
            continue
        p = Plain()
        p.within, p.named = "article", None
        p.feed(html)
        p.close()
        seen += 1
        assert H.main_text(html, None) == "\n".join(p.out)
    assert seen > 50


def test_pages_with_broken_markup_and_hidden_parts():
    """Comments that end early, drawings and navigations that are never closed, inline and hidden adverts, alerts beside the article."""
    story = "the story goes on " * 20
    want = f"Head\n{story.strip()}\nlast words"
    page = lambda inner, before="", after="": f"<body><nav><a href=/>menu</a></nav>{before}<article><h1>Head</h1><p>{story}</p>{inner}<p>last words</p></article>{after}<footer>end</footer></body>"
    for inner in (
        "<!-->", "<!--->", "<!-- a --!>", "<!-- <p>no</p> -->", "<![CDATA[ x > y ]]>", "<svg><path d=M0>", "<svg><text>no</text></svg>", "<p><span class=advert>buy</span></p>", "<ins class=adsbygoogle>buy</ins>",
        "<div class=google-ad><p>buy</p></div>", "<div class=ad-300x250>buy</div>", "<div id=adbox>buy</div>", "<div class='dfp-ad-unit'>buy</div>", "<ol class=commentlist><li>me too</li></ol>", "<div class=fb-comments>me too</div>",
        "<div hidden><p>secret</p></div>", "<p hidden>secret</p>", "<div style='color:red; display: none'>secret</div>", "<p><span style=display:none>secret</span></p>", "<div hidden=''>secret</div>", "<span><span class=ad>buy</span></span>",
    ):
        assert H.main_text(page(inner), None) == want, inner
    for before in ("<div class=alert>cookies here</div>", "<div class='alert alert-info'>mind</div>"):
        assert H.main_text(page("", before), None) == want, before
        assert H.main_text(f"<body>{before}<div class=post><h1>Head</h1><p>{story}</p><p>last words</p></div></body>", None) == want, before
    assert H.main_text(f"<body><nav><article><h1>Head</h1><p>{story}</p><p>last words</p></article></body>", None).endswith(want)
    assert H.main_text(f"<body><noscript><article><h1>Head</h1><p>{story}</p><p>last words</p></article></noscript></body>", None) == want
    assert H.main_text(page("<p><span class=name>of</span> <span>x</span> <ins>new</ins></p>"), None) == f"Head\n{story.strip()}\nof x new\nlast words"
    assert H.main_text(page("<p>a < b <span class=ad>never closed</p>"), None) == f"Head\n{story.strip()}\na < b never closed\nlast words"
    assert H.main_text(page("<div class='response-time main-content'><p>kept</p></div><p data-hidden=1 title='hidden x'>seen</p>"), None) == f"Head\n{story.strip()}\nkept\nseen\nlast words"


def test_names():
    for name in ("ad", "ads", "google-ad", "ad-300x250", "ad_slot_2", "adsbygoogle", "cookie-notice", "share-buttons", "post-sidebar", "alert-info", "newsletter-form", "related-posts"):
        assert H.named(name) == "side", name
    for name in ("comments", "comment-list", "commentlist", "user-comments", "fb-comments", "disqus-thread"):
        assert H.named(name) == "comments", name
    for name in ("", "post", "content", "no-sidebar", "with-sidebar", "layout", "header-image-credits", "advice", "shared-memory", "research", "address", "socialism"):
        assert H.named(name) == "", name
