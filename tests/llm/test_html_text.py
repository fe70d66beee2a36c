import random
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

from folioframe.llm.html_text import extract_main_text, names_boilerplate, page_parts
from pyspark.sql import functions as F

PAGES = "page_id long, url string, html string"


def text(html):
    return "\n".join(t for t, _ in page_parts(html)[0])


def test_blocks_of_an_article():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head>
    <body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- <p>gone</p> --><div class="ad">Buy</div>
    <article class="post"><header><h1>A &amp; B</h1></header><p><b>First   line.<br><p>Second&nbsp;<i>li</i>ne &lt;3 &eacute;</p>
    <div class="cookie-notice">We use cookies</div><form><input name=q><button>Go</button></form><ul><li>one<li>two</ul>
    <table><tr><td>a<td>b<tr><td>c</table><pre>x
    y</pre><section id="comments"><p>me too</p></section><aside>See also</aside><p hidden>no</p><p style="display: none">no</p></article>
    <footer>&copy; me</footer></body></html>"""
    assert text(page) == "A & B\nFirst line.\nSecond line <3 é\none\ntwo\na b\nc\nx y"


def test_forgiving_parsing():
    assert text("<p>a<p>b</div></b>c") == "a\nbc"
    assert text("plain &am &amp text") == "plain &am & text"
    assert text("a < b <article>x 1 < 2 <b>y</b") == "x 1 < 2 y</b"
    assert text("<article><script>let a = '<p>';") == ""
    assert text('<article><p title="a > b">in</p><p class=ad>out</p></article>') == "in"
    assert text("<main><p>m</p></main><p>outside</p>") == "m"
    assert text("<div role=main>r</div><p>o</p>") == "r"
    assert text("<p>out</p><article>short</article><article>the longer article</article>") == "short\nthe longer article"
    assert text("<p>out</p><main><h1>Title</h1><article>body</article><p>after</p></main><article>more</article>") == "Title\nbody\nafter\nmore"
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert text("<article>" + "<p>x</p>" * 20000 + "</article>").count("\n") == 19999
    assert text("<!-- never closed <p>x") == "" and text(None) == "" and text("") == ""


def test_names_inside_an_article():
    article = '<article><section class="share-prices"><p>a</p></section><div class="notice-board">b</div><div id="ad-3">c</div><div class="post cookie-notice">d</div><p class="social-history">e</p><div class="related-posts">f</div></article>'
    assert text(article) == "a\nb\ne"
    assert [names_boilerplate(n) for n in ("ad", "ads-box", "comments", "menu-main", "box", "content", "advert-free", "")] == [True, True, True, True, False, False, False, False]


def test_time_grows_with_the_page_only():
    pages = ["<a " * 350_000, "<p " * 300_000 + ">", '<a "' * 250_001 + ">", "<div>" * 200_000, "<b>" * 300_000 + "</i>" * 200_000, "<div>x" * 150_000, "<script>" * 100_000, "<!--" * 250_000, "</" * 500_000 + ">", "<p><table>" + "<b><hr>" * 100_000, "&" * 1_000_000]
    for page in pages:
        began = time.time()
        blocks, elements = page_parts(page)
        assert time.time() - began < 30, page[:20]
    blocks, elements = page_parts("<div>x" * 4000)
    assert len(blocks) == len(elements) == 4000


class Plain(HTMLParser):
    """Subtrees of div, ul, li and p of well-formed pages, as (tag, its markup)."""

    def __init__(self, html):
        super().__init__()
        self.open, self.found = [], []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        self.open = [o + f"<{tag}>" for o in self.open] + [f"<{tag}>"]

    def handle_data(self, data):
        self.open = [o + data for o in self.open]

    def handle_endtag(self, tag):
        self.open = [o + f"</{tag}>" for o in self.open]
        self.found.append(self.open.pop())


def test_recurring_subtrees_against_brute_force(spark):
    rng = random.Random(3)
    parts = ["<div><p>Join us.</p><p>Now.</p></div>", "<p>One line.</p>", "<ul><li>a</li><li>b</li></ul>", "<div><ul><li>a</li><li>b</li></ul></div>"]
    rows = []
    for i in range(160):
        host = f"h{i % 4}.com"
        body = [f"<p>own {i} {k}</p>" for k in range(3)] + [p for k, p in enumerate(parts) if rng.random() < (0.15, 0.25, 0.4, 0.8)[(k + i) % 4]]
        rng.shuffle(body)
        rows.append((i, f"http://{host}/{i}", "<article>" + "".join(body) + "</article>"))
    rows += [(1000 + i, "http://h1.com/copy", rows[1][2]) for i in range(60)]
    pages_of, seen = defaultdict(set), Counter()
    for _, url, html in rows:
        host = url.split("/")[2]
        if html not in pages_of[host]:
            pages_of[host].add(html)
            for sub in set(Plain(html).found) - {html}:
                seen[host, sub] += 1
    expected = {}
    for i, url, html in rows:
        host, left = url.split("/")[2], html
        gone = [s for s in Plain(html).found if s != html and seen[host, s] >= 10 and seen[host, s] >= 0.3 * len(pages_of[host])]
        for sub in sorted(gone, key=len, reverse=True):
            left = left.replace(sub, "")
        expected[i] = text(left)
    out = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert out == expected
    assert any(expected[i] != text(html) for i, _, html in rows)


def test_menus_with_varying_words_go_outside_articles(spark):
    rng = random.Random(4)
    rows = []
    for i in range(40):
        menu = "".join(f'<li><a href="/{rng.random()}">{rng.choice("river stone light winter".split())} {rng.randint(0, 999)}</a></li>' for _ in range(rng.randint(3, 7)))
        links = "".join(f"<li><a>see {i} {k}</a></li>" for k in range(3))
        story = f"<h1>Title {i}</h1><p>Text {i} with <a>one link</a> in it.</p>"
        rows.append((i, f"http://a.com/{i}", f'<body><div class="top"><ul>{menu}</ul></div><div class="story">{story}</div></body>'))
        rows.append((100 + i, f"http://b.com/{i}", f"<body><article>{story}<ul>{links}</ul></article></body>"))
    out = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    for i in range(40):
        assert out[i] == f"Title {i}\nText {i} with one link in it."
        assert out[100 + i] == f"Title {i}\nText {i} with one link in it.\n" + "\n".join(f"see {i} {k}" for k in range(3))


def test_recurring_subtrees_go_and_copies_do_not_count(spark):
    box = "<div><p>Follow us on the river.</p><p>Every week.</p></div>"
    rows = [(i, f"http://a.com/{i}", f"<article><h1>Title {i}</h1><p>Body {i} text</p>{box}<p>Tail {i}</p></article>") for i in range(30)]
    rows += [(100 + i, "http://b.com/x", f"<article><p>Same page</p>{box}</article>") for i in range(50)]  # copies
    rows += [(200 + i, f"http://c.com/{i}", f"<article><p>Page {i}</p>{box if i < 3 else ''}</article>") for i in range(30)]  # too few
    rows += [(300 + i, f"http://d.com/{i}", f"<article><p>Page {i}</p>{box}</article>") for i in range(6)]  # small host
    out = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert out[7] == "Title 7\nBody 7 text\nTail 7"
    assert out[120] == "Same page\nFollow us on the river.\nEvery week."
    assert out[201].endswith("Every week.") and out[305].endswith("Every week.")
    shuffled = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, PAGES), broadcast_digests=0).collect()}
    assert shuffled == out


def test_awkward_rows(spark):
    rows = [(1, None, None), (2, None, "<p>x</p>"), (2, None, "<p>x</p>"), (None, "http://h/", ""), (3, "u", "é" * 100000)]
    frame = spark.createDataFrame(rows, PAGES).withColumn("blocks", F.lit(1)).withColumn("host", F.lit("z")).withColumn("text", F.lit("t"))
    out = sorted(((r.page_id or 0), r.text, r.n_chars) for r in extract_main_text(frame).collect())
    assert out == [(0, "", 0), (1, "", 0), (2, "x", 1), (2, "x", 1), (3, "é" * 100000, 100000)]
    assert extract_main_text(spark.createDataFrame([], PAGES)).count() == 0
