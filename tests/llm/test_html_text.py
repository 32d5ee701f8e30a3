import random
import time
from html import escape

from pyspark.sql import Row

from helixframe.llm.html_text import extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="top"><a href="/">Home</a></header><nav><ul><li><a href="/a">A, b, c, d</a><li><a href="/b">B</a></ul></nav><!-- ad, ad -->
<div class="ad">Buy, now, all, this.</div><div id="cookie-notice"><p>We use cookies, many, many of them, for you.</p></div>
<article><h1>Head &amp; tail</h1><p><b>First one, with a comma.<br>Second
 line <a href="/x">link</a>.<p>Next&nbsp;para, and more.</p><ul><li>One<li>Two</ul><form><p>Mail, please</p></form>
<div class="comments"><p>Nice, very nice, I say.</p></div><pre>a
  b</pre>loose text</article><aside><p>Side, by, side, by, side, by, side.</p></aside><footer>&copy; me, 2020</footer></body></html>"""


def test_article_without_boilerplate():
    assert main_text(PAGE) == "Head & tail\n\nFirst one, with a comma. Second line link.\n\nNext para, and more.\n\nOne\n\nTwo\n\na b\n\nloose text"


def test_best_container_without_article():
    page = "<body><div class=menu><a href=1>one, two</a></div><div id=wrap><div class=content><p>Some text, long, enough, to win.</p><p>More text, again, and again.</p></div><div class=links><a>x</a> <a>y</a> <a>z</a></div></div><footer>f</footer></body>"
    assert main_text(page) == "Some text, long, enough, to win.\n\nMore text, again, and again."


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p>") == main_text("<script>x") == main_text("<!-- a") == ""
    assert main_text("plain text &lt;b&gt;") == "plain text <b>"
    assert main_text("<article><p>cut, off<di") == "cut, off"
    assert main_text("<article>" + "<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert main_text("<article><p>" + "word, " * 50000 + "</article>").count("word") == 50000


LONG = "A sentence of the text, which is long enough, and goes on for a while. " * 3


def test_names_do_not_drop_what_holds_the_article():
    page = f"<body><div class='layout no-sidebar'><article><h1 class='entry-header'>Title</h1><p>{LONG}</p></article></div></body>"
    assert main_text(page) == f"Title\n\n{LONG.strip()}"
    assert main_text(f"<body><div class='has-widget'><p>{LONG}</p></div><div class='widget'><p>Short, one.</p></div></body>") == LONG.strip()
    page = f"<body><article><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p><div class='related'><p>Other, more, and so on.</p></div></article></body>"
    assert main_text(page) == f"Title\n\n{LONG.strip()}"
    page = f"<body><article><p>x</p><div class='post-tags'><p>{LONG[:72]}</p></div><div class='share-text'><p>{LONG[:72]}</p></div></article></body>"
    assert main_text(page) == f"x\n\n{LONG[:72].strip()}\n\n{LONG[:72].strip()}"


def test_blocks_between_chosen_siblings_stay():
    page = f"<body><div id=w><h1>Title</h1><div>{f'<p>{LONG}</p>' * 4}</div><h2>Part</h2><ul><li>One<li>Two</ul><pre>code</pre><p>Short.</p><table><tr><td>cell</table><ul><li><a>x</a><li><a>y</a></ul><div><p>{LONG}</p></div><p>End.</p></div></body>"
    assert main_text(page).split("\n\n") == ["Title", *[LONG.strip()] * 4, "Part", "One", "Two", "code", "Short.", "cell", LONG.strip()]


def test_table(spark):
    rows = [Row(page_id=i % 3, url=None if i == 1 else "u", html=h, text="x", n_chars=0) for i, h in enumerate([PAGE, None, "", PAGE])]
    got = extract(spark.createDataFrame(rows)).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 0, len(main_text(PAGE)), len(main_text(PAGE))]
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


ARTICLE = "<body><nav><a href=1>x</a></nav><article><h1>Title</h1><p>One, two, and three.</p>{}<p>Last, not least.</p></article><footer>f</footer></body>"


def test_what_stands_in_an_article_stays():
    for part, text in {
        '<svg class="i"/>': "", "<svg><text>drawn</text></svg>": "", "<iframe src=x><p>after</p>": "after", "<script>x</script >": "",
        "<p>So <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p>": "So x=2 holds",
        "<ul><li><a href=1>Ref one</a></li><li><a href=2>Ref two</a></li><li><a href=3>Ref three</a></li></ul>": "Ref one\n\nRef two\n\nRef three",
        "<fieldset><p>Field</p></fieldset>": "Field", '<section class="related-work"><p>Others did.</p></section>': "Others did.", '<section class="related-posts"><p>Others did.</p></section>': "",
        '<div class="content-header"><h2>Head</h2></div>': "Head", '<div class="comments-list"><p>Nice, I say.</p></div>': "", "<p title='it's'>Quote</p>": "Quote", "<p>1 < 2 & 3</p>": "1 < 2 & 3",
    }.items():
        assert main_text(ARTICLE.format(part)) == "\n\n".join(x for x in ("Title", "One, two, and three.", text, "Last, not least.") if x), part


def test_hostile_pages_take_time_in_proportion():
    for page in ("<a '" * 250_000, "<a ='>' " * 120_000, "<i>" * 90_000 + "</x>" * 90_000, "<div>" * 60_000 + "<td>" * 60_000, "<td><table>" + "<div>" * 60_000 + "<td>" * 60_000, "<iframe>" * 120_000, "<!" * 400_000, "<p>" + "<i>" * 90_000 + "<p>" * 90_000):
        began = time.process_time()
        main_text(page)
        assert time.process_time() - began < 10, page[:20]  # a quadratic reading takes minutes


def test_planted_articles():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgé<&") for _ in range(rng.randint(2, 9)))
    sentence = lambda n: " ".join(word() for _ in range(n)) + ", and so on."
    shown = lambda t: "".join(f"<b>{escape(w)}</b>" if rng.random() < 0.2 else f"{escape(w)}<!-- no -->" if rng.random() < 0.1 else escape(w) for w in t.replace(" ", "\0 \0").split("\0"))
    around = ["<nav><ul><li><a href=/>Home</a><li><a href=/b>B, b</a></ul></nav>", "<header><h2>Site, name</h2></header>", "<aside><p>Side, side, and side.</p></aside>", "<div class=cookie-banner><p>Cookies, many.</p></div>", "<footer><p>Foot, foot.</p></footer>", "<form><p>Mail, please.</p></form>", "<script>var a='<p>';</script>", "<div id=comments><p>So nice, so very nice.</p></div>", "<div class='ad ad-top'><p>Buy, buy.</p></div>"]
    for k in range(150):
        blocks, html = [], ""
        for _ in range(rng.randint(3, 12)):
            kind = rng.choice(["p", "p", "p", "h2", "blockquote", "pre", "li"])
            text = sentence(rng.randint(3, 40))
            blocks.append(text)
            html += f"<ul><li>{shown(text)}</ul>" if kind == "li" else f"<{kind}>{shown(text)}</{kind}>"
        wrap = rng.choice(["<article>{}</article>", "<main>{}</main>", "<main><div class=post>{}</div></main>", "<div class='has-sidebar'><article class=entry>{}</article></div>"])
        before, after = (" ".join(rng.sample(around, rng.randint(0, 5))) for _ in range(2))
        assert main_text(f"<html><body>{before}{wrap.format(html)}{after}</body></html>") == "\n\n".join(blocks), k


def test_forms_around_the_page():
    """As some servers make them: one form holds everything, with an article or without."""
    inner = f"<nav><a href=1>x</a></nav><article><h1>Title</h1><p>{LONG}</p><form><input><p>Mail, please.</p></form></article><div class=sidebar><p>Side.</p></div>"
    assert main_text(f"<body><form id=aspnetForm>{inner}</form></body>") == f"Title\n\n{LONG.strip()}"
    inner = f"<div id=top><a href=1>x</a> <a href=2>y</a></div><div><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div><form><p>Search, all.</p></form>"
    assert main_text(f"<body><form>{inner}</form></body>").startswith(f"Title\n\n{LONG.strip()}")
    assert main_text(f"<body><form><p>{LONG * 3}</p></form><main><p>Short, but the article.</p></main></body>") == "Short, but the article."
    assert main_text(f"<body><dialog open><article><p>{LONG}</p></article></dialog></body>") == LONG.strip()


def test_words_of_names_within_an_article():
    for part, text in {
        '<div class="code-widget"><pre>x = 1</pre></div>': "x = 1", '<div class="menu-of-the-day"><p>Soup, bread.</p></div>': "Soup, bread.", "<section id=login-guide><p>Log in.</p></section>": "Log in.",
        "<section id=cookies><h2>Cookies</h2><p>They are small.</p></section>": "Cookies\n\nThey are small.", "<h2 id=cookies>Cookies</h2>": "Cookies", '<p class="comment">A remark.</p>': "A remark.", '<p class="ad">Buy, now.</p>': "",
        '<pre class="popup">code</pre>': "code", '<div class="post-comments"><p>Nice, I say.</p></div>': "", '<div id="comments"><p>Nice.</p></div>': "", "<aside><p>By the way.</p></aside>": "", "<footer><p>By me.</p></footer>": "", "<div class=newsletter-signup><p>Mail.</p></div>": "",
    }.items():
        assert main_text(ARTICLE.format(part)) == "\n\n".join(x for x in ("Title", "One, two, and three.", text, "Last, not least.") if x), part
    assert main_text(f"<body><article><aside><h1>T</h1><p>{LONG}</p></aside><p>x</p></article></body>") == f"T\n\n{LONG.strip()}\n\nx"


def test_length_switches_no_rule():
    """The same page at any length of its article: comments by name go, however long they are."""
    for n in (1, 3, 4, 60):
        page = f"<body><article><p>{'Word, by word. ' * n}</p></article><div class=comments>{'<p>So nice, so very nice, and so on.</p>' * 40}</div></body>"
        assert main_text(page) == ("Word, by word. " * n).strip()


def test_planted_articles_among_unknown_names():
    """Boilerplate that none of the code's words names: links, short labels and asides around an article of some length."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioubcdfglmnrst") for _ in range(rng.randint(2, 9)))
    links = lambda n: "".join(f"<a href='/{word()}'>{word()} {word()}</a> " for _ in range(n))
    around = [lambda: f"<div class='{word()}'>{links(9)}</div>", lambda: f"<ul id='{word()}'>" + "".join(f"<li>{links(1)}</li>" for _ in range(6)) + "</ul>", lambda: f"<div class='{word()}'><span>{word()}</span> {links(3)}</div>", lambda: f"<form><label>{word()}</label><select><option>{word()}</select></form>"]
    for k in range(100):
        blocks = [" ".join(word() for _ in range(rng.randint(12, 60))) + ", and so on, and more." for _ in range(rng.randint(4, 12))]
        body = "".join(f"<p>{b}</p>" for b in blocks)
        before, after = ("".join(rng.choice(around)() for _ in range(rng.randint(0, 4))) for _ in range(2))
        page = f"<html><body><div class='{word()}'>{before}<div class='{word()}'>{body}</div>{after}</div></body></html>"
        assert main_text(page) == "\n\n".join(blocks), k
