"""Main text of web pages: markup rules plus removal of what a site repeats on many pages.

A first pass hashes element subtrees and counts in Spark on how many different pages of its host each
hash stands; equal pages count once, or copies of a page would make a template of its story.  A second pass
deletes the subtrees that recur across many pages of the host, and everything that the markup itself
marks as menu, header, footer, sidebar, notice, advert, form, script or comment, then joins the remaining
blocks.  Where a page names its article, what recurs inside goes if it is a box (a list, table or division
that holds less than half of the article) or mostly links; bare paragraphs and headings stay,
for passages that articles share are content.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: A subtree recurs if it stands on so many pages of the host, and on this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.02
#: Up to so many recurring subtrees are sent to every executor; beyond, they are joined by shuffle.
BROADCAST_ROWS = 200_000
SALTS = 64

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*+>|<\?[^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - {"br", "option", "body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SAME = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg canvas button select input textarea head title object embed dialog menu audio video noembed noframes xmp datalist map".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist".split())
NAMES = frozenset(
    "nav navbar navigation menu submenu sidebar aside footer header masthead topbar breadcrumb breadcrumbs ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices notification alert newsletter subscribe subscription signup login popup modal overlay comment comments disqus replies respond discussion social share sharing shares related recommended recommendations widget widgets pagination pager toolbar skip skiplink copyright legal disclaimer searchbox".split()
)
PROTECTED = frozenset("html body main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Inside a named article, only these go for recurring, whatever they hold.
BOXES = frozenset("div section ul ol table details fieldset figure".split())
HASHED = frozenset("div section ul ol table p dl blockquote center td article main h2 h3 h4 h5 h6 details fieldset figure".split())


class Node:
    __slots__ = ("attributes", "children", "parent", "tag")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def attribute(self, name: str) -> str | None:
        for m in ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None


def parse(html: str) -> Node:
    """A tolerant tree: unclosed and misnested elements end where their parent does."""
    root = at = Node("#root", "", None)
    end, n = 0, len(html)
    for m in iter(lambda: TOKEN.search(html, end), None):
        if m.start() > end:
            at.children.append(html[end : m.start()])
        end = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            x = at
            while x.parent is not None and x.tag != tag and not (tag not in ("table", "body", "html") and x.tag in ("td", "th", "table") and tag not in BLOCK):
                x = x.parent
            if x.tag == tag:
                at = x.parent
            continue
        if tag in CLOSES_P:
            x = at
            while x.parent is not None and x.tag != "p" and x.tag not in BLOCK:
                x = x.parent
            if x.tag == "p":
                at = x.parent
        if tag in SAME:
            ends, stops = SAME[tag]
            x, last = at, None
            while x.parent is not None and x.tag not in stops:
                if x.tag in ends:
                    last = x
                x = x.parent
            if last is not None:
                at = last.parent
        node = Node(tag, m[3] or m[6] or "", at)
        at.children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, end)
            stop = close.start() if close else n
            if stop > end:
                node.children.append(html[end:stop])
            end = close.end() if close else n
        elif tag not in VOID and not node.attributes.endswith("/"):
            at = node
        elif node.attributes.endswith("/") and tag not in VOID:
            at = node  # in HTML a slash doesn't close
    if end < n:
        at.children.append(html[end:])
    return root


def _dropped(node: Node, inside: bool) -> bool:
    tag = node.tag
    if tag in DROPPED:
        return True
    if not node.attributes or tag in PROTECTED:
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(node.attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True
    if found.get("role", "").lower() in ROLES and tag not in ("article", *HEADINGS):
        return True
    if "class" not in found and "id" not in found:
        return False
    words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')}").lower())
    hit = NAMES.intersection(words)
    if tag == "article":
        hit = {"comment", "comments", "ad", "ads", "advert", "promo", "sponsored", "related", "teaser", "reply"}.intersection(words)
    elif inside:
        hit -= {"header", "legal"}
    return bool(hit) and not (tag in HEADINGS and inside)


def text_of(node: Node) -> str:
    """All text below, white space squeezed."""
    parts, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag not in RAW or x is node:
            if x.tag in BLOCK:
                parts.append(" ")
            todo.extend(reversed(x.children))
    return " ".join(unescape("".join(parts)).split())


def hashes(root: Node) -> dict[int, tuple[int, Node]]:
    """id(node) -> (hash of its subtree, node) for block elements that hold text."""
    out, known = {}, {}
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo.extend(c for c in x.children if not isinstance(c, str))
    for x in reversed(order):
        h, text = blake2b(x.tag.encode(), digest_size=8), False
        for c in x.children:
            if isinstance(c, str):
                if s := " ".join(c.split()):
                    h.update(b"\0" + s.encode("utf-8", "surrogatepass"))
                    text = True
            else:
                d, has = known[id(c)]
                h.update(b"\1" + d)
                text |= has
        known[id(x)] = h.digest(), text
        if text and x.tag in HASHED:
            out[id(x)] = int.from_bytes(known[id(x)][0], "little", signed=True), x
    return out


def _link_share(node: Node) -> float:
    total, linked, todo = 0, 0, [(node, False)]
    while todo:
        x, inside = todo.pop()
        if isinstance(x, str):
            total += (n := len(x.strip()))
            linked += n * inside
        else:
            todo.extend((c, inside or x.tag == "a") for c in x.children)
    return linked / total if total else 1.0


def _roots(root: Node) -> list[Node]:
    """The named articles that aren't inside something dropped, comments or teasers; else the main element."""
    articles, mains, todo = [], [], [root]
    while todo:
        x = todo.pop()
        if x.tag in ("article", "main") or x.attributes and re.search(r"""(?:role\s*=\s*["']?main|itemprop\s*=\s*["']?articleBody)\b""", x.attributes):
            if _dropped(x, False):
                continue
            if x.tag == "article" or "articleBody" in x.attributes:
                articles.append(x)
                continue
            mains.append(x)
        elif x.tag == "header" or _dropped(x, False):
            continue
        todo.extend(c for c in reversed(x.children) if not isinstance(c, str))
    return articles or mains[:1]


def _size(node: Node) -> int:
    """Letters of text below."""
    total, todo = 0, [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            total += len(x.strip())
        elif x.tag not in RAW:
            todo.extend(x.children)
    return total


def _template(node: Node, top: Node, named: bool) -> bool:
    """Whether a subtree that recurs is the site's and not the article's."""
    return not named or _link_share(node) > 0.5 or node.tag in BOXES and 2 * _size(node) < _size(top)


def main_text(html: str, recurring: frozenset[int] | set[int] = frozenset()) -> str:
    """The text of the article; ``recurring`` has the hashes of the site's template subtrees."""
    root = parse(html)
    found = {i: h for i, (h, _) in hashes(root).items() if h in recurring} if recurring else {}
    roots = _roots(root)
    named = bool(roots)
    blocks: list[str] = []
    part: list[str] = []

    def close():
        if part:
            if s := " ".join(unescape("".join(part)).split()):
                blocks.append(s)
            part.clear()

    for top in roots or [root]:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                part.append(x)
                continue
            if x is None:
                close()
                continue
            if x is not top:
                if x.tag == "header":
                    close()
                    heads = [h for h in _below(x) if h.tag in HEADINGS] if named else []
                    todo.extend(reversed(heads))
                    continue
                if _dropped(x, named) or id(x) in found and _template(x, top, named):
                    if x.tag in BLOCK:
                        close()
                    continue
            if x.tag in BLOCK:
                close()
                todo.append(None)
            todo.extend(reversed(x.children))
        close()
    return " ".join(blocks)


def _below(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(c for c in reversed(x.children) if not isinstance(c, str))
    return out


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def recurring(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, hash, pages): subtrees that stand on many different pages of their host. Pages without a host have none."""

    def run(batches):
        for b in common.pieces(batches, "html"):
            texts = [x or "" for x in b.column("html").to_pylist()]
            digests = [blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in texts]
            got = [sorted({h for h, _ in hashes(parse(x)).values()}) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column("host"), pa.array(digests, pa.binary()), pa.array(got, pa.list_(pa.int64()))], ["host", "page", "hashes"])

    found = pages.select(host_of(common.column(url)).alias("host"), common.column(html).alias("html")).where("host <> ''").mapInArrow(run, "host string, page binary, hashes array<bigint>").dropDuplicates(["host", "page"])
    # The count of a host's pages rides along under a null, which no subtree has for a hash.
    counted = common.stored(found.select("host", F.explode(F.concat(F.array(F.lit(None).cast("bigint")), "hashes")).alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("pages")).where(F.col("hash").isNull() | (F.col("pages") >= MIN_PAGES)), "html-subtrees")
    of_host = counted.where("hash is null").select("host", F.col("pages").alias("all_pages"))
    return counted.where("hash is not null").join(of_host, "host").where(F.col("pages") >= MIN_SHARE * F.col("all_pages")).select("host", "hash", "pages")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", templates: bool = True) -> DataFrame:
    """One row per page: id, url, text.

    Null or empty html gives an empty text; a page without a usable URL is treated by its markup
    alone, as all pages are without ``templates``; repeated rows give repeated results; an empty table
    gives an empty table; columns other than the three named aren't read.  Up to ``BROADCAST_ROWS``
    hashes go to every executor once; more are joined to the pages, hot hosts dealt over salts.
    """
    spark = pages.sparkSession
    common.small_batches(spark)
    rows = pages.select(common.column(key).alias("id"), common.column(url).alias("url"), common.column(html).alias("html"), host_of(common.column(url)).alias("host"))
    kind = f"id {rows.schema['id'].dataType.simpleString()}, url {rows.schema['url'].dataType.simpleString()}, text string"
    found = recurring(pages, url, html) if templates else spark.createDataFrame([], "host string, hash bigint, pages bigint")
    site = common.stored(found.groupBy("host").agg(F.collect_list("hash").alias("hashes")), "html-templates")
    size = site.agg(F.coalesce(F.sum(F.size("hashes")), F.lit(0))).first()[0]
    if size <= BROADCAST_ROWS:
        sent = spark.sparkContext.broadcast({r.host: frozenset(r.hashes) for r in site.collect()})
        rows = rows.withColumn("hashes", F.lit(None).cast("array<bigint>"))
    else:
        sent = None
        salted = site.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("host", "t_host")
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(salted, (F.col("host") == F.col("t_host")) & (F.col("salt") == F.col("t_salt")), "left")

    def run(batches):
        sites: dict[str, frozenset] = sent.value if sent else {}
        for b in common.pieces(batches, "html"):
            texts = []
            for host, page, hashes_ in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), b.column("hashes"), strict=True):
                if sent is None and host not in sites:
                    sites[host] = frozenset(hashes_.as_py() or ())
                texts.append(main_text(page or "", sites.get(host, frozenset())))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    return rows.select("id", "url", "html", "host", "hashes").mapInArrow(run, kind)
