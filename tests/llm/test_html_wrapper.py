import itertools
import json
import random
import re

from relspark.llm import html_wrapper as h

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=/>Home</a></ul></nav>
<!-- ad --><div class="ad-slot">Buy</div><article><h1>Title &amp; more</h1><p>One <b>bold</b>word<br>next &lt;p&gt;<script>var t="</p>";</script><p>Two&nbsp;x
 y<span class="promo">no</span></p><form><p>Name</p></form><div class="comments"><p>First!</p></div><section><ul><li>i1<li>i2</ul></section></article>
<aside>Also</aside><footer>&copy; me</footer></body></html>"""
TEXT = "Title & more One boldword next <p> Two x y i1 i2"


def inferred(*pages):
    whole = {}
    for p in pages:
        whole = h.united(whole, h.expression(h.Page(p)))
    return whole


def wrapper(*pages):
    return h.decisions(inferred(*pages))


def regex(wrapper, at=""):
    """The form of a place as a regular expression over keys."""
    out = ""
    for keys, optional, repeated in h.form(wrapper, at):
        body = "".join(f"(?:{re.escape(k)} )" + ("?" if len(keys) > 1 else "") for k in keys)
        out += f"(?:{body})" + {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[optional, repeated]
    return re.compile(out)


def test_article():
    assert h.extract(PAGE, wrapper(PAGE)) == TEXT and h.extract(PAGE, {}) == TEXT
    assert h.extract(None, {}) == "" and h.extract("", {}) == "" and h.extract("<!-- never closed <p>x", {}) == "" and h.extract("a < b", {}) == "a < b"


def test_frames_of_the_article_stay():
    page = """<body class="with-sidebar"><form id="page"><div class="layout sidebar-left"><div class="sidebar">s</div>
<article class="post"><header><h1>H</h1></header><p>T</p></article><div class="comments"><article class="comment"><p>c</p></article></div></div>
</form></body>"""
    assert h.extract(page, wrapper(page)) == "H T"


def test_deep_and_odd_markup():
    deep = "<div>" * 5000 + "<p>in</p>" + "</div>" * 5000 + "<p>out</p>"
    assert h.extract(deep, wrapper(deep, deep)) == "in out"
    assert h.extract("<div class='sidebar'>" * 3000 + "<article>x</article>", {}) in ("", "x") and h.extract("</p></b>a</div><p", {}) == "a"
    assert h.extract("<p title='unclosed>a</p><p>b", {}) in ("b", "a b")


def test_template_without_landmarks():
    page = "<div><p>Welcome to our site</p><h2>{}</h2><div>{}</div></div>".format
    w = wrapper(page("One", "Text one"), page("Two", "Text two"), page("Three", "Text three"))
    assert h.extract(page("Four", "Text four"), w) == "Four Text four"
    alone = page("One", "Text one")
    assert h.extract(alone, wrapper(alone, alone)) == "Welcome to our site One Text one"


def test_a_text_of_one_page_is_no_template():
    a, b = "<div><h2>One</h2><p>Text one</p></div>", "<div><h2>Two</h2><p>Text two</p><blockquote>Only here</blockquote></div>"
    w = wrapper(a, b)
    assert h.extract(a, w) == "One Text one" and h.extract(b, w) == "Two Text two Only here"
    odd = "<div class='text'><p>Own</p><p>text</p></div>"
    assert h.extract(odd, wrapper(*[f"<article><p>{k}</p></article>" for k in range(5)], odd)) == "Own text"
    alone = "<div><h1>Title</h1><p>a</p><p>b</p></div>"
    assert h.extract(alone, wrapper(alone)) == h.extract(alone, wrapper(alone, alone, alone)) == "Title a b"


def test_templates_against_brute_force():
    """Blocks with a key each: template is what all pages that have the block hold alike, on two different pages at least."""
    r = random.Random(7)
    for _ in range(200):
        names = [f"b{c}" for c in "qrstuv"]
        pages = [{n: r.choice("xy") if n < "bt" else "w" for n in names if k == 0 or r.random() < 0.4} for k in range(r.randint(1, 5))]
        made = ["<div>" + "".join(f"<p class={c}>{c} {t}</p>" for c, t in p.items()) + "</div>" for p in pages]
        w = wrapper(*made)
        for p, m in zip(pages, made, strict=True):
            having = {c: [q for q in pages if c in q] for c in p}
            template = {c for c in p if len({q[c] for q in having[c]}) == 1 and len({tuple(q.items()) for q in having[c]}) > 1}
            assert h.extract(m, w) == " ".join(f"{c} {t}" for c, t in p.items() if c not in template)


def test_template_inside_the_article():
    page = "<article><h1>{0}</h1><p>Text {0}</p><p class=note>Read more on our site</p><div class=teaser><h3>Join us</h3></div></article>".format
    w = wrapper(*map(page, "abc"))
    assert [h.extract(page(k), w) for k in "abcd"] == [f"{k} Text {k}" for k in "abcd"]
    two = wrapper(page("a"), page("b"), page("a"), page("b"))  # two pages, however often
    assert h.extract(page("a"), two) == "a Text a Read more on our site Join us"


def test_the_main_region_is_where_the_slots_are():
    page = "<article><h3>Card {0}</h3></article><div class=text><p>{1}</p></div>".format
    long = {k: f"{k} tells a long story " * 9 for k in "abc"}
    w = wrapper(*[page(k, t) for k, t in long.items()])
    assert all(t.strip() in h.extract(page(k, t), w) for k, t in long.items())
    banner = "<article><p>The same on every page of this host, word for word</p></article><main><p>{0} is new</p></main><div><p>{0}?</p></div>".format
    assert h.extract(banner("b"), wrapper(*map(banner, "abc"))) == "b is new"
    usual = "<div><p>Top {0}</p></div><main><p>Before {0}</p><article><p>Story {0} goes on and on</p></article></main>".format
    assert h.extract(usual("b"), wrapper(*map(usual, "abc"))) == "Before b Story b goes on and on"


def test_what_stands_beside_an_inner_article_stays():
    page = "<div>Top {0}</div><main><p>Lead {0}</p><article><p>Story {0}</p></article><p>Tail {0}</p><div class=comments>c</div></main>".format
    assert h.extract(page("b"), wrapper(*map(page, "abc"))) == h.extract(page("b"), {}) == "Lead b Story b Tail b"


def test_whole_tokens_decide_inside_of_landmarks():
    inside = """<article><p>a</p><section class='related-work'><p>b</p></section><div class='ad-hoc'>c</div>
<div class='search-results-study'>d</div>{}</article>""".format
    assert h.extract(inside(""), {}) == "a b c d"
    for said in ("related", "related-posts", "ad", "x ad-slot", "comment-list", "commentList", "social-share", "sidebar-left", "newsletter-form"):
        assert h.extract(inside(f"<div class='{said}'><p>no</p></div>"), {}) == "a b c d", said
    assert h.extract("<div class='article-header'>no</div><article><div class='article-header'><h1>T</h1></div><p>x</p></article>", {}) == "T x"


def test_words_of_content_parts_and_bodies():
    page = """<body class="single-post page-content"><div class="site-header">Site</div><div class="footer-widgets">w</div><div class="layout with-sidebar">
<div class="post"><header><h1>T</h1></header><p>x</p><div class="related-topics">r</div></div></div><div class="footer">f</div></body>"""
    assert h.extract(page, {}) == "T x" and h.extract(page.replace("layout with-sidebar", "sidebar"), {}) == ""
    assert h.extract(page.replace('<div class="post">', '<article>').replace("r</div></div>", "r</div></article>"), {}) == "T x r"


def test_any_depth():
    for n in (100, 130, 3000):
        deep = "<article>" + "<div>" * n + "in <nav>MENU</nav><div class=comments>reader comment</div><p>Body</p>" + "</div>" * n + "</article>"
        assert h.extract(deep, wrapper(deep)) == "in Body"
        json.dumps(inferred(deep))


def test_groups():
    w = inferred("<ul><li>a<li>b<li>c</ul>")
    assert h.form(w) == [(["ul"], False, False)] and h.form(w, h.place("", "ul")) == [(["li"], False, True)]
    w = inferred("<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>a<dd>x</dl>", "<dl><dt>a<dd>x</dl><table></table>")
    assert h.form(w) == [(["dl"], False, False), (["table"], True, False)] and h.form(w, h.place("", "dl")) == [(["dd", "dt"], True, True)]
    w = inferred("<h1>a</h1><p>b</p>", "<h1>a</h1><pre>x</pre><p>b</p><p>c</p>", "<p>b</p><h4>z</h4>")
    assert h.form(w) == [(["h1"], True, False), (["pre"], True, False), (["p"], False, True), (["h4"], True, False)]
    long = "".join(f"<{t}>x</{t}>" for t in random.Random(1).choices(["p", "h2", "table", "pre", "ul"], k=300))
    assert h.form(inferred(long)) == [(["h2", "p", "pre", "table", "ul"], True, True)]


def random_page(r, depth=0):
    inside = lambda t: random_page(r, depth + 1) if depth < 2 and t == "div" else r.choice(["x", "y"])
    return "".join(f"<{t}>{inside(t)}</{t}>" for t in r.choices(["p", "h2", "div", "table"], k=r.randint(1, 4)))


def test_wrappers_accept_the_pages_they_are_made_of():
    r = random.Random(4)
    for _ in range(60):
        pages = [random_page(r) for _ in range(3)]
        w = inferred(*pages)
        for page in map(h.Page, pages):
            for k, row in enumerate(page.children):
                assert regex(w, page.places[k]).fullmatch("".join(f"{key} " for key in row)), pages


def test_wrappers_do_not_depend_on_the_order_of_pages():
    r = random.Random(6)
    for _ in range(20):
        pages = [random_page(r) for _ in range(4)]
        assert len({json.dumps(inferred(*order), sort_keys=True) for order in itertools.permutations(pages)}) == 1
        a, b = inferred(*pages[:2]), inferred(*pages[2:])
        assert json.dumps(h.united(a, b), sort_keys=True) == json.dumps(inferred(*pages), sort_keys=True)


HOST = """<body><div class=x><p>Welcome, reader {0}</p></div><article><p class=k>Kindly supported by our patrons</p><h1>{0}</h1><p>Story {0}</p>
<div><h4>Write to us</h4></div></article></body>""".format


def test_the_wrapper_decides_beside_a_landmark(spark):
    """Texts differ from those without the host's wrapper, and don't depend on how the pages are dealt."""
    rows = [(k, f"http://h.x/{k}", HOST(f"n{k} " * (k % 7 + 1))) for k in range(40)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    results = []
    for n in (1, 7, 23):
        out = h.main_text(df.repartition(n, "page_id")).collect()
        results.append(sorted((r.page_id, r.text) for r in out))
    assert results[0] == results[1] == results[2]
    for (page_id, text), (_, _, page) in zip(results[0], rows, strict=True):
        alone = h.extract(page, wrapper(page))
        name = " ".join(["n%d" % page_id] * (page_id % 7 + 1))
        assert text == f"{name} Story {name}" and alone == f"Kindly supported by our patrons {name} Story {name} Write to us"


def test_pages_of_a_host_share_their_region():
    """On most pages the article is a card; one page with a long card doesn't change what the main region is."""
    page = "<article><h3>Card {0}</h3></article><div class=text><p>{1}</p></div>".format
    usual = [page(k, f"{k} tells a long story " * 9) for k in "abcdef"]
    odd = page("word " * 30, "Short text")
    assert h.extract(odd, wrapper(odd)) == "Card " + ("word " * 30).strip()
    assert h.extract(odd, wrapper(odd, *usual)).endswith("Short text")


def test_operator(spark, none):
    rows = [(1, "http://a.b/x", PAGE, "k"), (2, "http://a.b/y", PAGE.replace("One", "Uno"), "k"), (3, None, "<p>only</p>", "k")]
    rows += [(4, "http://c.d", None, "k"), (None, "x", "", None), (1, "http://a.b/x", PAGE, "k")]
    rows.append((5, "http://long/", "<article>" + "<p>w</p>" * 20000 + "</article>", "k"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    out = sorted(((r.page_id, r.text, r.n_chars) for r in h.main_text(df).collect()), key=str)
    want = [(1, TEXT), (2, TEXT.replace("One", "Uno")), (3, "only"), (4, ""), (None, ""), (1, TEXT), (5, " ".join(["w"] * 20000))]
    assert out == sorted(((i, t, len(t)) for i, t in want), key=str)
    assert h.main_text(df.limit(0)).count() == 0


def test_wrappers_hold_no_texts_and_large_ones_are_joined_by_shuffle(spark, monkeypatch):
    assert "Two" not in json.dumps(inferred(PAGE)) and len(json.dumps(inferred(f"<div>{'word ' * 20000}</div>"))) < 300
    rows = [(k, f"http://{'big' if k % 3 else 'h' + str(k)}.x/{k}", f"<div><p>Frame</p><p class=a>Text {k}</p><h2>{k}</h2></div>") for k in range(60)]
    df = spark.createDataFrame([*rows, (99, None, None)], "page_id long, url string, html string")
    want = sorted(map(tuple, h.main_text(df).collect()), key=str)
    monkeypatch.setattr(h, "BROADCAST_BYTES", 100)
    monkeypatch.setattr(h, "COPY_PAGES", 7)
    out = h.main_text(df)
    assert sorted(map(tuple, out.collect()), key=str) == want and len(want) == 61
    assert "SortMergeJoin" in out._jdf.queryExecution().toString()


def test_query(spark, sf):
    """Against a plain reading of these pages: what stands in <article>, block by block."""
    import html
    import re

    def plainly(page):
        inside = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
        return " ".join(t for t in (" ".join(html.unescape(re.sub(r"<[a-zA-Z/][^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside)) if t)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = h.op4_html_wrapper(spark, sf).collect()
    assert len(out) == len(pages) and all(r.text == plainly(pages[r.page_id]) and r.n_chars == len(r.text) for r in out)
