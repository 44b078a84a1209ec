"""Main text of web pages with a site style tree.

Pages of one host are merged into a tree: an element node is a path of tags and classes from the body, its
styles are the presentations seen there (the sequence of child blocks), its contents the block texts. A
node's importance is the entropy of its styles over the host's pages, joined with one minus the mean
entropy of its contents: what every page repeats weighs nothing, what differs from page to page weighs one.
Branches of low importance are removed from each page. Elements whose tag or class names their purpose
(menus, forms, adverts, ...) have the importance zero from the start, the article element the importance one.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import scratch

GAMMA = 0.9
THRESHOLD = 0.2
LEAST_PAGES = 8  # distinct pages of a host below which entropy says nothing
LOW_NODES = 200_000  # up to so many low nodes are broadcast, 8 bytes each and their host; more are joined by shuffle
HOT_SHARE = 256  # hosts with more than one page in so many are split; fewer than so many hosts can be

_SKIPPED = {"script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "audio", "video", "head", "title", "textarea", "select", "button", "option", "datalist"}
_OUTSIDE = {"nav", "footer", "aside", "form", "header", "menu", "dialog", "fieldset"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption"}
_CLOSES_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "li", "dd", "dt"}
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_STOP = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
_MAIN = {"article", "main"}
#: Whole class tokens or ids that name a part which is not main text. Names that also stand on main text or
#: its wrappers (header, search, related, alert, notice, hidden, has-sidebar, ...) are left to the tree.
_NAMED = {
    "ad", "ads", "adv", "advert", "advertisement", "advertising", "adbox", "ad-slot", "ad-container", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "main-nav", "site-nav", "nav-menu", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "masthead", "site-header", "footer", "site-footer", "colophon",
    "sidebar", "aside", "rail", "widget", "widgets", "widget-area", "related-posts", "related-articles", "recommended", "share", "sharing", "share-buttons", "social-share",
    "cookie", "cookies", "cookie-notice", "cookie-banner", "cookie-consent", "consent", "gdpr", "popup", "modal", "newsletter", "newsletter-signup", "subscribe", "subscription", "signup", "login", "search-form",
    "comment", "comments", "commentlist", "comment-list", "comments-area", "comment-section", "comments-section", "user-comments", "reader-comments", "disqus", "respond", "toolbar",
}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alertdialog", "toolbar"}
#: Ids here are anchors of the text.
_ANCHORS = {"h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "main"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)>", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "math", "canvas", "object", "audio", "video")}


def _named(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """Class part of a path, whether a name says that this is not main text, and whether it is not shown."""
    if not attributes or "=" not in attributes and "hidden" not in attributes.lower():
        return "", False, False
    label, named, out = "", False, False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "class":
            label = "." + ".".join(sorted(value.split()))
            named |= not _NAMED.isdisjoint(value.split())
        elif key == "id":
            named |= tag not in _ANCHORS and value in _NAMED
        elif key == "role":
            named |= not _ROLES.isdisjoint(value.split())
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            out = True
    return label, named, out


def blocks(page: str | None) -> list[tuple[str, str, int]]:
    """(path, text, prior) of each block in page order; prior: -1 never, 1 in the article, 0 open.

    Broken nesting is mended as browsers do where it matters: a block ends an open paragraph, list items and
    cells end their like, an end tag closes what it finds open, the end of the page closes all. An article
    inside an element with a telling name is the page's article if there is no other; until the end of the
    page it has the prior 2, and the rest of such an element -2.
    """
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str, int]] = []  # tag, path, prior
    held: list[str] = []
    page = page or ""

    def flush():
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(next(((p, text, prior) for tag, p, prior in reversed(stack) if tag in _BLOCK), ("", text, 0)))

    def close(to: int):
        if any(tag in _BLOCK for tag, _, _ in stack[to:]):
            flush()
        del stack[to:]

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        start = m.start() if m else len(page)
        if start > at and (not stack or stack[-1][2] >= 0):
            held.append(page[at:start])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            else:
                if tag in _BLOCK:
                    flush()
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in _BLOCK:
            flush()
        if tag in _VOID:
            continue
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in _BLOCK:
                    break
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in _SAME.get(tag, ()):
                close(i)
                break
            if stack[i][0] in _STOP.get(tag, ()):
                break
        label, named, bad = _named(tag, m[3])
        above, prior = (stack[-1][1], stack[-1][2]) if stack else ("", 0)
        article = tag in _MAIN or "itemprop=\"articlebody\"" in m[3].lower()
        if tag in _SKIPPED or tag in ("html", "body"):
            bad, named = tag in _SKIPPED, False
        elif tag in _OUTSIDE and not (tag == "header" and prior > 0):
            bad = True
        if prior == -1 or bad:
            prior = -1
        elif article:
            prior = 2 if named or prior in (-2, 2) else 1
        elif named:
            prior = -2
        if m[3].endswith("/") and tag not in _BLOCK:
            continue
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        stack.append((tag, f"{above}/{tag}{label}" if tag in _BLOCK and tag not in ("html", "body") else above, prior))
    flush()
    top = 1 if any(prior == 1 for _, _, prior in out) else 2 if any(prior == 2 for _, _, prior in out) else 0
    if top:
        out = [(p, t, 1 if prior == top else -1) for p, t, prior in out]
    return out


def _host(url) -> F.Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def extract(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_nodes: int = LOW_NODES) -> DataFrame:
    """(page_id, url, text, n_chars, n_removed) of each page.

    Blocks keep page order and are joined by an empty line; n_removed counts blocks that the tree took out.
    Null html has no text. Pages of one host with the same blocks count once in the tree, so copies of an
    article do not look like a menu. A null url is a host of its own. Repeated rows give equal rows.
    """
    block = "array<struct<node:long,text:string,content:long,prior:int>>"
    kind = pa.list_(pa.struct([("node", pa.int64()), ("text", pa.string()), ("content", pa.int64()), ("prior", pa.int32())]))

    def signed(s: str) -> int:
        return int.from_bytes(xxhash.xxh64_digest(s.encode("utf-8", "surrogatepass")), "little", signed=True)

    def run(batches):
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("blocks", kind)])
        for batch in batches:
            parsed = []
            for page in batch.column(3).to_pylist():
                found = [b for b in blocks(page) if b[2] >= 0]
                parsed.append([{"node": signed(p), "text": t, "content": signed(t), "prior": prior} for p, t, prior in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(parsed, kind)], schema=schema)

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), _host(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    parsed = scratch(spark, rows.mapInArrow(run, f"page_id long, url string, host string, blocks {block}"), "blocks")

    # the tree: styles and contents of each node, over the distinct pages of a host
    body = F.xxhash64(F.transform("blocks", lambda b: F.struct(b["node"], b["content"])))
    light = parsed.select("host", body.alias("body"), F.transform("blocks", lambda b: F.struct(b["node"].alias("node"), b["content"].alias("content"))).alias("blocks"))
    distinct = light.dropDuplicates(["host", "body"])
    per_host = distinct.groupBy("host").agg(F.count("*").alias("m"))
    seen = distinct.select("host", "body", F.explode("blocks").alias("b")).select("host", "body", "b.node", "b.content")
    in_page = seen.groupBy("host", "body", "node", "content").agg(F.count("*").alias("k"))
    style = in_page.groupBy("host", "body", "node").agg(F.sum("k").alias("style"))

    def entropy(weight):
        """Sum of -p ln p over a group from sums of w and w ln w, with p = w / sum w."""
        return F.log(F.sum(weight)) - F.sum(weight * F.log(weight)) / F.sum(weight)

    content = in_page.groupBy("host", "node", "content").agg(entropy(F.col("k").cast("double")).alias("h"))
    content = content.groupBy("host", "node").agg(F.avg("h").alias("h"), F.count("*").alias("contents"))
    styles = style.groupBy("host", "node", "style").agg(F.count("*").alias("pages")).groupBy("host", "node").agg(entropy(F.col("pages").cast("double")).alias("s"), F.count("*").alias("l"))
    tree = content.join(styles, ["host", "node"]).join(per_host.where(F.col("m") >= LEAST_PAGES), "host")
    fade = F.pow(F.lit(GAMMA), F.col("l"))
    importance = (1 - fade) * F.col("s") / F.log("m") + fade * (1 - F.col("h") / F.log("m"))
    nodes = scratch(spark, tree.where(importance < THRESHOLD).select("host", "node"), "low")
    low = nodes.groupBy("host").agg(F.collect_set("node").alias("low"))
    if nodes.count() <= broadcast_nodes:
        joined = parsed.join(F.broadcast(low), "host", "left")
    else:
        # a hot host's pages meet its nodes in many tasks; this broadcast table has fewer than HOT_SHARE rows by its condition
        part = -(-parsed.count() // HOT_SHARE) or 1
        hot = F.broadcast(parsed.groupBy("host").agg(F.count("*").alias("n")).where(F.col("n") > part).select("host", F.ceil(F.col("n") / F.lit(part)).alias("parts")))
        parts = F.coalesce("parts", F.lit(1).cast("long"))
        low = low.join(hot, "host", "left").select("host", "low", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("salt"))
        salted = parsed.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url", F.lit("salt")), parts)).drop("parts")
        joined = salted.join(low, ["host", "salt"], "left")
    keep = F.filter("blocks", lambda b: (b["prior"] == 1) | F.col("low").isNull() | ~F.array_contains("low", b["node"]))
    text = F.array_join(F.transform(keep, lambda b: b["text"]), "\n\n")
    return joined.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"), (F.size("blocks") - F.size(keep)).alias("n_removed"))
