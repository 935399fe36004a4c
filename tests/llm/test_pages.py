from __future__ import annotations

import gzip
import hashlib
import random
import time

import pytest

from symloom.llm import html, warc

LONG = "<p>" + "Many words, with commas, and more. " * 40 + "</p>"
PAGES = [
    (1, "http://a/1", LONG), (2, "http://a/2", LONG), (3, None, None), (4, "u\nv", ""), (5, "http://b", "é" * 30_000), (6, "http://c", "\r\n0\r\n\r\n"),
    (None, "http://d", "only here"), (None, "http://e", LONG), (7, "http://f", "x"), (7, "http://f", "x"),
]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, digest string")


def test_archives_give_the_pages_back(spark):
    out = warc.read(warc.write(pages(spark, PAGES).repartition(3))).collect()
    assert len(out) == len(PAGES)
    largest: dict[str, int] = {}
    for i, _, h in PAGES:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    for r in out:
        raw = next((h or "") for i, u, h in PAGES if i == r.page_id and (u or "").replace("\n", "%0A") == (r.url or ""))
        first = largest[raw] == (-1 if r.page_id is None else r.page_id)
        assert r.payload_bytes == len(raw.encode()) and r.payload_digest == warc.sha1_base32(raw.encode())
        assert r.record_type == ("response" if first else "revisit")
        assert r.refers_to == (None if first else largest[raw])
        assert r.payload == (raw.encode() if first else None)
    assert warc.read(warc.write(pages(spark, []))).count() == 0


def test_segments_are_put_in_order_and_checked():
    raw = b"".join(gzip.compress(x) for x in warc.records("urn:page:9:0.0", "http://x", b"abc" * 20_000, None))
    found = list(warc.read_records(raw))
    assert len(found) > 3 and found[0][0]["warc-segment-number"] == "1"
    parts = [(int(h["warc-segment-number"]), int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None, b) for h, b in found]
    digest = found[0][0]["warc-payload-digest"].removeprefix("sha1:")
    assert warc.assemble("urn:page:9:0.0", "response", digest, None, parts[::-1])[1] == b"abc" * 20_000
    with pytest.raises(ValueError):
        warc.assemble("urn:page:9:0.0", "response", digest, None, parts[:1] + parts[2:])
    with pytest.raises(ValueError):
        warc.assemble("urn:page:9:0.0", "response", digest, None, parts[:-1] + [(parts[-1][0], 5, parts[-1][2])])


def test_chunks():
    for body in (b"", b"x", b"y" * 10_000):
        assert warc.unchunked(warc.chunked(body)) == body
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: z\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n")


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body>
<nav><ul><li><a href="/x">Menu, one</a></li></ul></nav><div class="ad">Buy, buy, buy this now, please, friend.</div><header>Site, name</header>
<article><h1>Head  line</h1><p>First &amp; <b>bold</b>,
 with text, and commas, to score well enough.<p>Second<br>line, unclosed, and some more words here.<form><p>Name, please, and more, and more words</p></form></article>
<div class="comments"><p>I, as a reader, think, that this is, well, wrong.</p></div><aside>Side, bar</aside><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert html.extract(PAGE) == "Head line\nFirst & bold, with text, and commas, to score well enough.\nSecond line, unclosed, and some more words here."


def test_without_article_the_best_container_and_siblings_stay():
    page = "<body><div id=menu><a href=1>a, b, c, d, e, f, g, h link link</a></div><div><div>" + LONG * 3 + "</div><p>" + "A plain sibling paragraph of good length that has no links in it at all, so it stays." + "</p></div></body>"
    lines = html.extract(page).split("\n")
    assert len(lines) == 4 and lines[3].startswith("A plain sibling")


def test_figures_keep_their_words():
    page = "<article>" + LONG + "<figure><img src=x><video>no video</video><table><tr><td>Cell</td></tr></table><figcaption>A caption</figcaption></figure></article>"
    assert html.extract(page).split("\n")[1:] == ["Cell", "A caption"]


def test_content_beside_a_long_section_stays():
    one = "<p>A paragraph, of some words, that stands alone.</p>"
    lines = html.extract("<body>Bare <b>text</b><div><div>" + LONG * 20 + "</div><h2>Title</h2><ul><li>item</li></ul><pre>code</pre><div>" + one + "</div></div><div>" + one + "</div><div><a href=1>Home page</a> <a href=2>Contact</a></div></body>").split("\n")
    assert lines[0] == "Bare text" and lines[1:21] == lines[1:2] * 20
    assert lines[21:] == ["Title", "item", "code", *["A paragraph, of some words, that stands alone."] * 2]


def test_a_page_without_scores_gives_its_blocks():
    assert html.extract("<body><div>short text</div><nav>menu</nav><div><a href=1>a link</a></div><h2>end</h2></body>") == "short text\nend"


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "</div></p>", "<!-- only", "<script>x", "<nav>menu</nav>", "&", "<a" + " x" * 5000])
def test_odd_pages_do_not_fail(page):
    assert isinstance(html.extract(page), str)


def test_deep_nesting():
    assert html.extract("<div>" * 3000 + LONG).startswith("Many words")


def test_table(spark):
    rows = {r.page_id: r for r in html.main_text(pages(spark, [(1, "u", PAGE), (2, None, None), (2, None, None), (None, "v", "")])).collect()}
    assert rows[1].n_chars == len(rows[1].text) and rows[2].text == "" and rows[None].n_chars == 0
    assert html.main_text(pages(spark, [])).count() == 0
    assert hashlib.sha1(b"").hexdigest()[:4] == "da39"


def test_segments_meet_across_archives(spark):
    bodies = {i: (f"page {i} é " * 4000 * i).encode() for i in range(1, 5)}
    raw = [gzip.compress(r) for i, b in bodies.items() for r in warc.records(f"urn:page:{i}:0.{i}", f"u{i}", b, None)]
    raw += [gzip.compress(r) for r in warc.records("urn:page:9:0.9", None, bodies[4], "urn:page:4:0.4")]
    for cut in ([5, 6, 7], [1, 12], [], list(range(len(raw)))):
        parts = [b"".join(reversed(raw[a:b])) for a, b in zip([0, *cut], [*cut, len(raw)], strict=True)]
        rows = spark.createDataFrame([(0, i, bytearray(p)) for i, p in enumerate(parts)], "part int, archive int, content binary")
        found = {r.page_id: r for r in warc.read(rows).collect()}
        assert {i: bytes(found[i].payload) for i in bodies} == bodies
        assert found[9].record_type == "revisit" and found[9].refers_to == 4 and found[9].payload_bytes == len(bodies[4])
    with pytest.raises(Exception, match="missing|not the total"):
        warc.read(spark.createDataFrame([(0, 0, bytearray(b"".join(raw[:2])))], "part int, archive int, content binary")).collect()


ARTICLE = "<article><header><h1>Headline</h1></header>" + "<p>A paragraph of the article, with commas, and words, enough to score.</p>" * 4 + "<figure><pre>x = 1</pre><figcaption>Listing</figcaption></figure></article>"


@pytest.mark.parametrize("name", ["comment", "comment-content", "post-comment", "comment-body", "sidebar-content", "promo content", "ad-text", "cookie-text", "page-header"])
def test_unlikely_words_win(name):
    other = f"<div class='{name}'><p>Somebody says, here, that this is not, at all, what was wanted.</p></div>"
    want = html.extract("<body><div class='content'>" + ARTICLE + "</div></body>")
    assert want.split("\n")[0] == "Headline" and want.split("\n")[-2:] == ["x = 1", "Listing"]
    assert html.extract("<body>" + other + "<div class='content'>" + ARTICLE + other + "</div>" + other + "</body>") == want
    assert html.extract("<body><header>Site</header><div class='layout-with-sidebar sidebar-wrap'>" + ARTICLE + f"</div><article class='{name} comment'><p>I, a reader, say so.</p></article></body>") == want


@pytest.mark.parametrize("page", ["<" + "a" * 200_000, "<b " * 100_000, "<b>" * 100_000 + "</i>" * 100_000, '<b ">"' * 60_000, "<b>" * 50_000 + "<hr>" * 50_000, "<ul>" + "<b>" * 50_000 + "<option/>" * 50_000, "<b>" * 50_000 + "<table><td>" + "<i>" * 50_000 + "</b>" * 50_000, "&#" + "1" * 100_000 + ";", "<" * 200_000 + ">", "<!" * 100_000, "<p>x" * 50_000, "<div>text, " * 50_000])
def test_long_pages_take_linear_time(page):
    began = time.process_time()
    assert isinstance(html.extract(page), str)
    assert time.process_time() - began < 4


def _scored(node, depth=0):
    """Points of one tree by the plain rule: each block's own points, given to each ancestor."""
    total = {}

    def text(n):
        return " ".join(x if isinstance(x, str) else text(x) for x in n.items)

    def visit(n, up):
        own = sum(len(x.strip()) if isinstance(x, str) else 0 for x in n.items)
        commas = sum(x.count(",") for x in n.items if isinstance(x, str))
        if own >= 25 or (n.tag == "p" and own):
            points = 1 + commas + min(3, own // 100)
            for level, x in enumerate((up if n.tag == "p" else [n, *up])[:6]):
                total[id(x)] = total.get(id(x), 0) + points / (1 if level == 0 else 2 if level == 1 else 3 * level)
        for x in n.items:
            if not isinstance(x, str):
                visit(x, [n, *up])

    visit(node, [])
    return total


def test_scores_equal_the_plain_rule():
    rng = random.Random(3)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            return "<p>" + "some words, " * rng.randrange(0, 30) + "</p>"
        return "<div>" + "".join(make(depth - 1) for _ in range(rng.randrange(1, 4))) + ("bare text of a container, " * rng.randrange(0, 3)) + "</div>"

    for _ in range(50):
        root = html.tree(make(5))
        found = html.score(root)
        want = _scored(root)
        assert {id(x): round(x.points, 9) for x in found} == {k: round(v, 9) for k, v in want.items()}


PARA = "This is a whole paragraph, with commas, of many plain words that a reader would want to read, and it goes on for a while to be long enough. "


@pytest.mark.parametrize("name", ["byline", "meta", "commentary", "legal", "tag", "disclaimer", "copyright-law", "promotion-history", "social-history", "advertising-in-print", "has-sidebar", "menuOfTheDay history"])
@pytest.mark.parametrize("outer", ["article", "div"])
def test_parts_of_the_article_stay_whatever_their_names(outer, name):
    page = f"<body><nav><a href=x>menu</a></nav><{outer}><p>{PARA * 3}</p><div class='{name}'><p>Kept: {PARA}</p></div><p>{PARA * 2}</p></{outer}></body>"
    assert html.extract(page) == "\n".join([(PARA * 3).strip(), ("Kept: " + PARA).strip(), (PARA * 2).strip()])


SIGNED = "".join(f"<div class='c'><span class='author'>R{i}</span><p>Lost {PARA}</p></div>" for i in range(3))


@pytest.mark.parametrize(
    ("name", "inner"),
    [(n, f"<p>Lost {PARA}</p>") for n in ("readerComments", "userComments", "adContainer", "AdSlot", "siteFooter", "rightRail", "gdpr", "cookieNotice", "NewsletterSignup", "comment-list", "side")]
    + [("thread", SIGNED), ("feedback", SIGNED), ("toc", "<ul>" + "<li><a href=x>Lost part</a></li>" * 6 + "</ul>"), ("copyright", "Lost, 2020")],
)
def test_other_parts_go_without_an_article(name, inner):
    page = f"<body><div class='page'><div><p>{PARA * 3}</p><p>{PARA * 3}</p></div><div class='{name}'>{inner}</div></div></body>"
    assert html.extract(page) == "\n".join([(PARA * 3).strip()] * 2)


def test_a_box_of_the_whole_page_is_only_a_box():
    page = f"<body><div class='widget-wrap'><p>{PARA * 3}</p><p>{PARA * 3}</p></div><div class='widget'><p>Lost {PARA}</p></div></body>"
    assert html.extract(page) == "\n".join([(PARA * 3).strip()] * 2)


@pytest.mark.parametrize("value", ["a-" * 500_000, "A" * 1_000_000, "ad " * 330_000, "x" * 1_000_000 + "-open", "aB" * 500_000, "-" * 1_000_000])
def test_long_names_take_linear_time(value):
    began = time.process_time()
    html.extract(f"<div class='{value}'><p>{PARA * 5}</p></div>")
    assert time.process_time() - began < 3


def test_names():
    assert html.names("readerComments AdSlot has-sidebar menu-open copyright-law HTMLPage x_y2z") == [["reader", "comments"], ["ad", "slot"], ["copyright", "law"], ["html", "page"], ["x", "y", "z"]]
