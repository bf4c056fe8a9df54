"""Page text: parser, templates, odd input."""

import html
import re

import pytest

from faultline.llm import html_text
from faultline.llm.queries import QUERIES


def _texts(page):
    return [t for t, _ in html_text.parsed(page)[0]]


@pytest.mark.parametrize("page, want", [
    (None, []), ("", []), ("plain &amp; simple", ["plain & simple"]), ("<p>a<p>b</p>c", ["a", "b", "c"]),
    ("<p>a <b>b\n\t c</b>  d<br>e&nbsp;f</p>", ["a b c d e f"]), ("<p>1 < 2 &lt; 3", ["1 < 2 < 3"]),
    ("<script>var t='</p>';</script><style>p{}</style><p>x", ["x"]), ("<p>x<script>never closed <p>y", ["x"]),
    ("<!-- <p>no</p> --><p>yes<!-- open", ["yes"]), ("<nav>menu<p>menu</nav><p>text", ["text"]),
    ("<body><div class='site-header'>h</div><main><p>m</main><p>outside", ["m"]),
    ("<article><header>h</header><p>a</p><div id=comments><p>c</div><form>f</form><aside>s</aside><p>b</article>", ["a", "b"]),
    ("<article>one</article><article><p>two</article><p>three", ["one", "two"]),
    ("<article><button>b</button>text<div hidden>h</div></article>", ["text"]),
    ("<div class=ad>x</div><div class='headline address'>kept</div>", ["kept"]),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>", ["a", "b", "c", "d"]),
    ("<p title='a>b' class=\"x\">q</p></div></div><p>r", ["q", "r"]), ("<p", []), ("<p>a</p", ["a"]), ("<P>A</P><NAV>n</NAV>", ["A"]),
    ("<article><p>cut off &eacute", ["cut off é"]), ("<title>t</title><h1>h</h1>", ["h"]),
])
def test_parser(page, want):
    assert _texts(page) == want


def test_a_very_long_and_a_deep_page():
    assert _texts("<article>" + "<p>word word</p>" * 50_000) == ["word word"] * 50_000
    assert _texts("<div>" * 3_000 + "x" + "</div>" * 3_000) == ["x"]


def _page(host, k, body):
    return f"http://{host}/{k}", f"<html><body>{body}</body></html>"


@pytest.fixture(scope="module")
def pages(spark):
    share = "<section><p>Follow us</p><p>on all channels</p></section>"
    rows = [_page("big.org", k, f"<div><p>Story {k}</p>{share}<p>End {k}</p></div>") for k in range(40)]
    rows += [_page("copy.org", k, "<p>The same copied story</p>" if k < 12 else f"<p>Own {k}</p>") for k in range(30)]
    rows += [_page("few.org", k, f"<p>Few {k}</p>{share}") for k in range(5)]
    rows += [_page("big.org", "x", f"{share}"), (None, "<p>no url</p>"), ("http://null/", None), ("http://empty/", ""), _page("big.org", 0, f"<div><p>Story 0</p>{share}<p>End 0</p></div>")]
    return spark.createDataFrame([(k, u, h, "own", 3) for k, (u, h) in enumerate(rows)], "page_id bigint, url string, html string, text string, host int")


def test_templates_go_and_copies_stay(pages):
    out = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert len(out) == pages.count()
    assert out[7] == "Story 7\n\nEnd 7" and out[41] == "The same copied story" and out[60] == "Own 20"
    assert out[71] == "Few 1\n\nFollow us\n\non all channels"
    assert [out[k] for k in (75, 76, 77, 78, 79)] == ["", "no url", "", "", "Story 0\n\nEnd 0"]


def test_other_columns_are_kept(pages):
    assert set(html_text.extract(pages).columns) == {"page_id", "url", "host", "text"}


def test_empty_table(pages):
    assert html_text.extract(pages.where("false")).count() == 0


def test_query_finds_the_articles(spark, sf):
    found = {r["page_id"]: r for r in QUERIES["op3_html_extraction"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(found) == len(rows)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        want = "\n\n".join(p for p in parts if p)
        assert (found[r["page_id"]]["text"], found[r["page_id"]]["n_chars"]) == (want, len(want))


@pytest.mark.parametrize("page, want", [
    ('<div class="page has-sidebar"><article><p>Hello</p></article></div>', ["Hello"]),
    ('<div class="layout no-comments"><p>Hello</div>', ["Hello"]), ('<div class="social-sciences"><p>Hello</div>', ["Hello"]),
    ('<form id="all"><main><p>Hello</main></form>', ["Hello"]), ('<form id="all"><p>Hello</form>', ["Hello"]),
    ('<p>Hello<form><p>Sign up</form>', ["Hello"]), ('<div class="sidebar"><article><p>Hello</article></div>', ["Hello"]),
    ('<aside><article><p>teaser</article></aside><p>Hello', ["Hello"]),
    ('<main><p>Hello<article class="comment"><p>c</article></main>', ["Hello"]),
    ('<main><article><p>Hello</article><div class="related-links"><article><p>teaser</article></div></main>', ["Hello"]),
    ('<article><p>Hello<form><p>reply</form></article>', ["Hello"]), ('<div class="cookieNotice"><p>c</div><p>Hello', ["Hello"]),
    ('<div class="site_footer"><p>f</div><p>Hello', ["Hello"]), ('<div class="addresses"><p>Hello</div>', ["Hello"]),
])
def test_marks_and_names(page, want):
    assert _texts(page) == want


def _extracted(spark, rows, **options):
    frame = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id bigint, url string, html string")
    return {r["page_id"]: r["text"] for r in html_text.extract(frame.repartition(3), **options).collect()}


def test_an_article_copied_on_its_host_stays(spark):
    rows = [_page("a.org", k, f"<div>{k}</div><article><h1>One</h1><p>The same story</article>") for k in range(9)]
    rows += [_page("a.org", k, f"<article><p>Own {k}</article>") for k in range(9, 14)]
    rows += [_page("b.org", k, f"<script>track({k})</script><p>Unmarked story</p><div class=ad>{k}</div>") for k in range(20)]
    out = _extracted(spark, rows)
    assert {out[k] for k in range(9)} == {"One\n\nThe same story"} and out[10] == "Own 10"
    assert {out[k] for k in range(14, 34)} == {"Unmarked story"}


def test_a_notice_on_some_pages_of_a_large_host_goes(spark):
    notice = "<section><p>We use cookies</p></section>"
    rows = [_page("a.org", k, f"{notice if k % 30 == 0 else ''}<p>Story {k}</p>") for k in range(300)]
    out = _extracted(spark, rows)
    assert out[30] == "Story 30" and all("cookies" not in t for t in out.values())


def test_templates_equal_a_count_of_all_subtrees(spark):
    """Host by host, every subtree of every distinct content, counted without Spark."""
    draw = __import__("random").Random(3)
    parts = [f"<div><p>part {k}</p><ul><li>x{k % 3}</ul></div>" for k in range(12)]
    rows = [_page(f"h{draw.randrange(3)}.org", k, "".join(draw.sample(parts, 3)) + f"<p>Own {k % 70}</p>") for k in range(120)]
    seen = {}
    for url, page in rows:
        found = html_text.read_page(page)
        for subtree in found.subtrees:
            seen.setdefault((url.split("/")[2], subtree), set()).add(tuple(t for t, _, _ in found.blocks))
    gone = {key for key, contents in seen.items() if len(contents) >= 8}
    assert 5 < len(gone) < len(seen)
    out = _extracted(spark, rows)
    for k, (url, page) in enumerate(rows):
        want = [t for t, _, inside in html_text.read_page(page).blocks if not any((url.split("/")[2], s) in gone for s in inside)]
        assert out[k] == "\n\n".join(want)


def test_templates_of_the_given_pages_without_their_marks(spark):
    """The given pages with article, menu and advert unmarked and a box on each page of a host: the method alone takes the box."""
    rows = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html").collect()
    assert len(rows) > 2_000
    plain = [re.sub(r"</?(?:article|footer|nav)>", "", r["html"]).replace('class="ad"', "") for r in rows]
    boxed = [h.replace("<body>", f"<body><section><p>All of {r['url'].split('/')[2].lower()}</p></section>") for r, h in zip(rows, plain)]
    frame = spark.createDataFrame([(r["page_id"], r["url"], h) for r, h in zip(rows, boxed)], "page_id bigint, url string, html string")
    out = {r["page_id"]: r["text"] for r in html_text.extract(frame).collect()}
    pages = {}
    for r, h in zip(rows, plain):
        pages.setdefault(r["url"].split("/")[2].lower(), set()).add(tuple(t for t, _, _ in html_text.read_page(h).blocks))
    large = [r for r in rows if len(pages[r["url"].split("/")[2].lower()]) >= 8]
    assert len(large) > 1_500 and all("All of" not in out[r["page_id"]] for r in large)
    assert sum(len(out[r["page_id"]]) for r in large) > 0.9 * sum(
        len("\n\n".join(t for t, _, _ in html_text.read_page(h).blocks)) for r, h in zip(rows, plain) if len(pages[r["url"].split("/")[2].lower()]) >= 8)


def test_templates_go_from_marked_parts(spark):
    """A box in the article of many pages goes there too; paragraphs, near copies and a box that is the article stay."""
    box = "<div><p>Read our letter</p><ul><li>daily<li>weekly</ul></div>"
    rows = [_page("a.org", k, f"<article><h1>Story {k}</h1><p>What happened on day {k}</p>{box}<p>The editors</p></article>") for k in range(9)]
    rows += [_page("b.org", k, f"<article><h1>Story {k}</h1><p>What happened on day {k}</p>{box}</article>") for k in range(7)]
    parts = "".join(f"<section><p>{word * 30}</p></section>" for word in ("one ", "two ", "three "))
    rows += [_page("c.org", k, f"<main><h1>Copy {k}</h1>{parts}</main>") for k in range(12)]
    rows += [_page("d.org", k, f"<main><h1>{k}</h1><div><p>The whole story of the day</p></div></main>") for k in range(12)]
    rows += [_page("a.org", "open", f"<p>Not marked</p>{box}")]
    out = _extracted(spark, rows)
    assert [out[k] for k in range(9)] == [f"Story {k}\n\nWhat happened on day {k}\n\nThe editors" for k in range(9)]
    assert all(out[k].endswith("Read our letter\n\ndaily\n\nweekly") for k in range(9, 16))
    assert all(out[k].count("\n\n") == 3 for k in range(16, 28)) and out[29] == "1\n\nThe whole story of the day"
    assert out[40] == "Not marked"
