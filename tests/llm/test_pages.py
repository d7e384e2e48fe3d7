"""Main text and archives: fixed pages, odd rows, round trips."""

import gzip
import hashlib
import time

import pytest

from hirelake.llm.main_text import Page, extract_main_text, host
from hirelake.llm.warc import reachable, read_warc, record_candidates, write_warc

PAGE = "page_id long, url string, html string"

LAYOUT = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head>
<body class="home page-{n}"><header><a href="/">Logo</a></header><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-banner">We use cookies</div><div class="layout"><div class="content col-{n}"><article id="post-{n}">
<h1>Title {n} &amp; more</h1><p>First   paragraph, with <b>bold</b>\n and <a href="/x">a link</a>.<p>Second &lt;one&gt; &eacute;&#8212;&#x41;.
<div class="ad">Buy now</div><aside>Side</aside><form><label>Name</label><input></form><ul><li>point one<li>point two</ul><!-- <p>no</p> -->
<blockquote>Quoted words here.</blockquote><section class="comments"><p>Reader says hello, hello, hello, hello, hello</p></section></article></div>
<div class="sidebar"><p>Related things to read</p></div></div><footer>Copyright</footer></body></html>"""

WANT = "Title {n} & more\nFirst paragraph, with bold and a link.\nSecond <one> é—A.\npoint one\npoint two\nQuoted words here."


def test_article_without_its_surroundings(spark):
    rows = [(i, f"https://www.Site.example/{i}", LAYOUT.format(n=i)) for i in range(8)]
    got = {r["page_id"]: r for r in extract_main_text(spark.createDataFrame(rows, PAGE)).collect()}
    for i in range(8):
        assert got[i]["text"] == WANT.format(n=i) and got[i]["n_chars"] == len(got[i]["text"]) and got[i]["url"] == rows[i][1]


def test_the_host_outvotes_a_page_that_misleads(spark):
    good = "<body><div class='story'><p>The story of this page runs on for a while.</p></div><div class='list'><p>Short.</p></div></body>"
    bad = "<body><div class='story'><p>Small story.</p></div><div class='list'><p>A list of offers that is much longer than the story of the page itself.</p></div></body>"
    rows = [(i, "http://h.example/x", good) for i in range(5)] + [(9, "http://h.example/y", bad), (10, "http://other.example/y", bad)]
    got = {r["page_id"]: r["text"] for r in extract_main_text(spark.createDataFrame(rows, PAGE)).collect()}
    assert got[9] == "Small story." and got[10].startswith("A list of offers")


def test_odd_pages(spark):
    rows = [
        (1, "http://a.example/", None), (2, None, ""), (3, "no url", "just text &amp; no tags"), (4, "http://a.example/", "<p>open <b>end"), (None, None, None), (5, "http://a.example/", "<div>" * 3000 + "deep" + "</div>" * 3000),
        (6, "http://b.example/", "<article>" + "<p>word word</p>" * 20_000 + "</article>"), (7, "http://c.example/", "<article><p>a</article><article><p>b"), (7, "http://c.example/", "<article><p>a</article><article><p>b"),
        (8, "http://d.example/", "<body><script>if (a < b) { document.write('<p>x</p>') }"), (9, "http://d.example/", "<nav>only a menu</nav>"), (10, "http://e.example/", '<main data-x="a > b"><p title=\'it is "quoted"\'>kept</p></main>'),
        (11, "http://f.example/", "<table><tr><td>one<td>two</table>"), (12, "http://g.example/", "<article><p>line<br>broken&nbsp;here</p></article>"),
    ]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], PAGE + ", host string, text string")
    got = extract_main_text(frame)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    answers = [(r["page_id"], r["text"]) for r in got.collect()]
    by = dict(answers)
    assert len(answers) == len(rows) and all(t is not None for _, t in answers)
    assert by[1] == by[2] == by[None] == by[8] == by[9] == "" and by[3] == "just text & no tags" and by[4] == "open end" and by[5] == "deep"
    assert by[6] == "\n".join(["word word"] * 20_000) and by[7] == "a\nb" and by[10] == "kept" and by[11] == "one\ntwo" and by[12] == "line broken here"
    assert extract_main_text(frame.limit(0)).count() == 0


def test_end_tags_find_their_element_behind_many_unclosed_ones():
    options = "<optgroup label=x>" + "<option>Country" * 300
    for inner in (options, options * 2, "<div>" * 300, "<button>" * 300):
        assert Page(f"<body><header><form><select>{inner}</select></form></header><article><p>The story.</p></article>").text(None) == "The story."
    assert Page("<div>" * 50_000 + "</section>" * 50_000 + "<p>end").text(None) == "end"


@pytest.mark.parametrize("around", ["article", "main", "div class=post"])
def test_a_body_beside_its_title_and_lead(spark, around):
    body = "".join(f"<p>Paragraph {i} of a body that runs on and on for quite a while.</p>" for i in range(30))
    html = f"<body><div class=top><p>Site</p></div><{around}><h1>Title</h1><p class=lead>Lead</p><div class=entry-content>{body}</div><section><p>Sources</p></section><div class=related><p>Other</p></div></{around.split()[0]}><div class=list><p>More of the site</p></div></body>"
    want = ["Title", "Lead", *[f"Paragraph {i} of a body that runs on and on for quite a while." for i in range(30)], "Sources"]
    got = extract_main_text(spark.createDataFrame([(i, "http://h.example/", html) for i in range(3)], PAGE)).collect()
    assert [r["text"] for r in got] == ["\n".join(want)] * 3


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "page header-fixed", "elementor-widget elementor-widget-theme-post-content", "layout sidebar-left", "widget"])
def test_layout_words_on_wrappers_leave_the_article(name):
    story, side = "<p>The story of this page runs on.</p>", "<div class='comments'><article><p>I say so, and so does everybody else here, again and again.</p></article></div><div class='sidebar'><p>More</p></div>"
    assert Page(f"<div class='{name}'><article>{story}</article></div>{side}").text(None) == "The story of this page runs on."
    assert Page(f"<body><div id='{name}'>{story * 3}</div>{side}").text(None) == "\n".join(["The story of this page runs on."] * 3)


def test_named_elements_beside_the_article_stay_out():
    for name in ("sidebar", "ad-slot", "related-posts", "sticky-header", "comment-list", "main nav", "cookie-banner"):
        assert Page(f"<div><p>The story of this page runs on.</p><div class='{name}'><p>Something else.</p></div></div>").text(None) == "The story of this page runs on."


def test_many_unclosed_quotes_take_no_square_time():
    assert Page("<a href=\"x " * 20_000).text(None) == ""
    Page("<" * 50_000 + "<p " * 50_000)


def test_hosts(spark):
    urls = ["HTTPS://User@Www.Ex.example:80/p", "ftp://h/x", "//h/x", "mailto:a@b", "", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(host(df.u)).collect()] == ["www.ex.example", "h", "", "", "", ""]


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 4\r\n\r\nfake\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"


def want_records(rows):
    groups = {}
    for i, _, h in rows:
        groups.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        first = min((x for x in groups[h or ""] if x is not None), default=None)
        again = len(body) >= 100 and first is not None and i != first
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("per_archive", [1, 3, 1000])
def test_round_trip(spark, tmp_path, per_archive):
    same, long = "<p>" + "é" * 60 + "</p>", "<p>" + "words " * 100_000 + "</p>"
    rows = [(5, "http://a/\r\nX: y", same), (3, None, same), (9, "u", same), (9, "u", same), (3, "u", same), (None, "u", same), (11, "u", None), (12, "u", ""), (13, "u", "x" * 99), (14, "u", "x" * 99), (15, "u", FAKE * 3),
            (16, "u", "\r\n\r\nWARC/1.1\r\n"), (17, "u", long), (18, "u", long), (None, "u", "y" * 200), (None, "u", "y" * 200), (-4, "u", "é\x00\x1f☃")]
    frame = spark.createDataFrame([(*r, "x", "z") for r in rows], PAGE + ", digest string, first string")
    path = str(tmp_path / "warc")
    write_warc(frame, path, records_per_archive=per_archive)
    got = read_warc(spark, path, payloads=True).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == want_records(rows)
    payloads = {(r["page_id"], r["payload_digest"]): bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    assert payloads[15, hashlib.sha256((FAKE * 3).encode()).hexdigest()] == (FAKE * 3).encode()
    assert {r["url"] for r in got if r["page_id"] == 5} == {"http://a/X: y"}
    assert len({r["archive"] for r in got}) >= (len(rows) if per_archive == 1 else 1)


def test_heads_of_any_length(spark, tmp_path):
    urls = ["http://a.example/", "data:," + "x" * 100_000, "http://b.example/", "http://c.example/WARC/1.1", "data:," + "é" * 200_000, "http://d.example/"]
    path = str(tmp_path / "warc")
    write_warc(spark.createDataFrame([(i, u, f"<p>page {i}</p>") for i, u in enumerate(urls)], PAGE).coalesce(1), path)
    assert sorted((r["page_id"], r["url"]) for r in read_warc(spark, path).collect()) == list(enumerate(urls))


def test_many_magics_without_an_end_take_no_square_time():
    assert list(record_candidates(b"WARC/1.1\r\n" * 300_000)) == []


def test_empty_table(spark, tmp_path):
    write_warc(spark.createDataFrame([], PAGE), str(tmp_path / "warc"))
    assert read_warc(spark, str(tmp_path / "warc")).count() == 0


def test_gzip_truncated_and_broken_archives(spark, tmp_path):
    def record(i, body):
        http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
        return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n" % (i, len(http)) + http + b"\r\n\r\n"

    good = b"".join(record(i, b"body %d" % i) for i in range(20))
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(good))
    (tmp_path / "b.warc").write_bytes(good[:-30])
    (tmp_path / "c.warc").write_bytes(record(1, b"one") + b"junk" + record(2, b"two"))
    (tmp_path / "d.warc").write_bytes(b"")
    got = sorted((r["archive"], r["page_id"]) for r in read_warc(spark, str(tmp_path)).collect())
    assert got == [("a.warc.gz", i) for i in range(20)] + [("b.warc", i) for i in range(19)] + [("c.warc", 1)]


def test_candidates_hold_every_head_and_pointer_jumping_keeps_the_chain(spark):
    links = [(1, i, i + 1 if i < 99 else None) for i in range(100)] + [(1, 1000, 1001), (1, 1001, 5), (2, 0, None), (3, 4, 5)]
    got = {tuple(r) for r in reachable(spark.createDataFrame(links, "f long, offset long, after long")).collect()}
    assert got == {(1, i) for i in range(100)} | {(2, 0)}
    data = (FAKE * 2).encode()
    assert [c[0] for c in record_candidates(data)] == [m for m in range(len(data)) if data[m:m + 7] == b"WARC/1."]


ARTICLE = "<h1>Title</h1><p>" + "The article says a few things about rivers. " * 6 + "</p><p>" + "It ends with some more about them. " * 5 + "</p>"
SAID = "A reader disagrees with all of it and says so at length. " * 60


SECTIONS = ("comments-area", "comments", "comment-list", "post-comments", "replies", "disqus-thread", "cookie-banner", "consent-box", "advert-block", "ad-slot")


def test_longer_sections_of_others_never_win(spark):
    rows = []
    for n, name in enumerate(SECTIONS):
        other = f"<div class='{name}'><p>{SAID}</p><article class='item'><p>{SAID}</p></article></div>"
        for m, body in enumerate((f"<div class='entry'>{ARTICLE}</div>{other}", f"<main>{ARTICLE}{other}</main>", f"<article>{ARTICLE}</article>{other}")):
            rows += [(len(rows) + i, f"http://h{n}-{m}.example/{i}", f"<html><body><div class='page'>{body}</div></body></html>") for i in range(2)]
    got = extract_main_text(spark.createDataFrame(rows, PAGE)).collect()
    bad = [rows[r["page_id"]][2][:60] for r in got if "reader disagrees" in r["text"] or "article says" not in r["text"] or "ends with" not in r["text"]]
    assert len(got) == len(rows) and not bad, bad


def test_scripts_end_at_their_end_tag_whatever_their_slash(spark):
    for script in ("<script src=http://x/>var a = 1;</script>", "<script src='a.js'/>var a = 1;</script>", "<style/>p {}</style>"):
        page = f"<html><body><div>{script}{ARTICLE}</div></body></html>"
        got = extract_main_text(spark.createDataFrame([(1, "http://h.example/a", page)], PAGE)).first()
        assert "var a" not in got["text"] and "p {}" not in got["text"] and "article says" in got["text"]


def test_a_stray_sign_before_a_long_word_takes_linear_time():
    started = time.time()
    for tail in ("a" * 1_000_000, "a" * 500_000 + "<b" * 200_000, "a='" * 200_000):
        Page("<p>text</p><" + tail)
    assert time.time() - started < 20


def test_names_that_only_mention_others_keep_the_article(spark):
    for name in ("post-with-comments", "has-ads", "no-comments", "comments-closed"):
        page = f"<html><body><div class='{name}'>{ARTICLE}</div></body></html>"
        got = extract_main_text(spark.createDataFrame([(1, "http://h.example/a", page)], PAGE)).first()
        assert "article says" in got["text"], name
