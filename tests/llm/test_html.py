import random
import re
from html import unescape

import pytest

from sparkloom.llm import html_extract as h

CASES = [
    ("", ""),
    ("plain", "plain"),
    ("<p>a<p>b", "a b"),
    ("<div>a<b>b</b>c <i>d</i></div>\n\n<p> e\t f </p>", "abc d e f"),
    ("<p>x &amp; y&nbsp;&eacute; &#8364;</p>", "x & y é €"),
    ("<nav><ul><li><a href=x>m</a></ul></nav><p>t</p><footer>f</footer>", "t"),
    ("<script>var a='<p>no</p>'</script><style>p{}</style><!-- <p>no</p> --><p>yes</p>", "yes"),
    ("<html><head><title>T</title></head><body><header>site</header><article><header><h1>H</h1><span>by me</span></header><p>one<br>two</p><aside>s</aside></article><div class='comments'><p>c</p></div></body>", "H one two"),
    ("<article><p>a</p><form>f</form><div class='ad-box'>buy</div><section id=comments>c</section><p>b</p></article>", "a b"),
    ("<div class=sidebar>x</div><main><div class='cookie-notice'>ok?</div><p>m</p></main>", "m"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
    ("<p title='a > b'>q</p>", "q"),
    ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ("<article><p><b>open<br><p>next</p></article><footer>f</footer>", "open next"),
    ("<div hidden>no</div><div style='display: none'>no</div><p>y", "y"),
    ("<article class='post'>long text here</article><article class='comment'>me too, I also think that</article>", "long text here"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_markup(page, text):
    assert h.main_text(page) == text


def test_odd_input_never_fails():
    r = random.Random(8)
    for _ in range(500):
        h.main_text("".join(r.choice(["<", ">", "p", "/", " ", "'", '"', "<p>", "</div>", "<div class='", "<!--", "-->", "&", "<td>", "<script>", "é"]) for _ in range(60)))
    assert h.main_text("<div>" * 20_000 + "deep") == "deep"


@pytest.mark.parametrize("rows", [200_000, 0])
def test_site_templates_go_and_articles_stay(spark, monkeypatch, rows):
    monkeypatch.setattr(h, "BROADCAST_ROWS", rows)
    page = lambda i, body: f"<html><body><div><p>Site slogan</p><p>Call us</p></div>{body}<div><a href=/>home</a> all rights</div></body></html>"
    data = [(i, f"http://a.com/{i}", page(i, f"<div><p>story {i}</p><p>own words {i}</p></div>")) for i in range(30)]
    data += [(100 + i, f"http://b.com/{i}", page(i, "<article><p>the same article everywhere</p></article>")) for i in range(30)]
    data += [(200, None, page(0, "<p>x</p>")), (201, "http://c.com/", None), (202, "nonsense", "<p>y</p>"), (0, "http://a.com/0", data[0][2])]
    got = h.extract(spark.createDataFrame(data, "page_id bigint, url string, html string")).collect()
    assert len(got) == len(data)
    text = {x.id: x.text for x in got}
    assert all(text[i] == f"story {i} own words {i}" for i in range(30)) and all(text[100 + i] == "the same article everywhere" for i in range(30))
    assert (text[200], text[201], text[202]) == ("Site slogan Call us x home all rights", "", "y")


def plain_text(page):
    """What stands in the paragraphs of a well-formed page, by a pattern instead of a tree."""
    return " ".join(" ".join(unescape(x).split()) for x in re.findall(r"<(?:h1|p)>(.*?)</(?:h1|p)>", page, re.S))


def site(r, host, n):
    """Pages that share menus, slogans and boxes, some inside the article; and each page's story."""
    slogan, share, author = ("".join(f"<p>{r.choice('abcdef') * 9} {r.random()}</p>" for _ in range(k)) for k in (2, 1, 3))
    out = []
    for i in range(n):
        story = "".join(f"<p>{' '.join(f'w{r.randint(0, 10**6)}' for _ in range(r.randint(3, 40)))} &amp;\n &eacute;</p>" for _ in range(r.randint(3, 8)))
        if i % 3 == 0:
            story += "<p>a passage that many stories share, and that stays</p>" if i % 2 else ""
            body = f"<article><h1>t{i}</h1>{story}<div>{author}</div><ul><li><a href=/x>Share {host}</a></li></ul></article>"
            want = plain_text(f"<h1>t{i}</h1>{story}")
        else:
            body, want = f"<div>{story}</div>", plain_text(story)
        out.append((f"http://{host}/{i}", f"<html><body><div>{slogan}</div>{body}<div>{share}</div></body></html>", want))
    return out


def test_results_match_the_stories_only_with_template_removal(spark):
    r = random.Random(21)
    rows = [x for host in ("a.example", "b.example:80", "c.example") for x in site(r, host, 40)]
    pages = spark.createDataFrame([(i, u, p) for i, (u, p, _) in enumerate(rows)], "page_id bigint, url string, html string").repartition(3)
    got, bare = ({x.id: x.text for x in h.extract(pages, templates=t).collect()} for t in (True, False))
    assert all(got[i] == want for i, (_, _, want) in enumerate(rows))
    assert all(bare[i] != want for i, (_, _, want) in enumerate(rows))


def test_copies_of_a_page_make_no_template(spark):
    page = "<html><body><div><p>The only story</p></div></body></html>"
    rows = [(i, f"http://a.com/{i % 2}", page) for i in range(5)] + [(9, "http://a.com/9", "<article>one</article><article class=teaser>no</article><article>two</article>")]
    got = {x.id: x.text for x in h.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got == {**{i: "The only story" for i in range(5)}, 9: "one two"}


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.com/1", "<p>x</p>", "s", 3)], "page_id bigint, url string, html string, host string, `ha.sh` int")
    assert h.extract(df).collect() == [(1, "http://a.com/1", "x")]


def test_empty_table(spark):
    assert h.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0
