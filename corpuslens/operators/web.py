"""Web pages: main content, titles, links, bounded breadth-first crawl over a page table, web index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslens.functions.let import let, open_array
from corpuslens.functions.windows import position_in_group, top_per_group
from corpuslens.session import cut_lineage

# Elements that are not content, places of the main content in order, block elements, and
# elements without an end tag.
DROPPED = {"script", "style", "nav", "footer", "header", "aside", "iframe", "noscript"}
MAIN = [
    ("tag", "main"), ("tag", "article"), ("role", "main"), ("class", "content"), ("class", "main-content"),
    ("id", "content"), ("id", "main-content"), ("class", "documentation"), ("class", "docs-content"),
]
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Tree(HTMLParser):
    """Nested lists [tag, attributes, children]; text is a plain string. Open paragraphs end at a block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = ["", {}, []]
        self.open = [self.root]
        self.counts = Counter()  # open elements by tag, so that a hopeless search of the open ones is skipped

    def handle_starttag(self, tag, attrs):
        closes = {"li"} if tag == "li" else {"p"} if tag in BLOCKS or tag in ("ul", "ol", "article", "section") else ()
        for node in reversed(self.open) if any(self.counts[c] for c in closes) else ():
            if node[0] in ("ul", "ol", "table", "body", "article"):
                break
            if node[0] in closes:
                self.handle_endtag(node[0])
                break
        node = [tag, dict(attrs), []]
        self.open[-1][2].append(node)
        if tag not in VOID:
            self.open.append(node)
            self.counts[tag] += 1

    def handle_endtag(self, tag):
        while self.counts[tag]:
            ended = self.open.pop()[0]
            self.counts[ended] -= 1
            if ended == tag:
                return

    def handle_data(self, data):
        self.open[-1][2].append(data)


def _events(root):
    """("open", element), ("text", string) and ("close", element) below an element in document order, without
    dropped elements. Keeps its own stack, so nesting may be of any depth."""
    stack = [(root, iter(root[2]))]
    while stack:
        node, children = stack[-1]
        child = next(children, None)
        if child is None:
            stack.pop()
            if stack:
                yield "close", node
        elif isinstance(child, str):
            yield "text", child
        elif child[0] not in DROPPED:
            yield "open", child
            stack.append((child, iter(child[2])))


def _text(node) -> str:
    return "".join(value for kind, value in _events(node) if kind == "text")


def _content(root) -> str:
    """Trimmed texts joined by a space; a block is followed by one more. One pass; an only child's pieces are
    taken over, not copied."""
    levels = [[]]
    for kind, value in _events(root):
        if kind == "open":
            levels.append([])
        elif kind == "text":
            if value.strip():
                levels[-1] += [" ", value.strip()] if levels[-1] else [value.strip()]
        else:
            inner = levels.pop()
            if inner:
                if levels[-1]:
                    levels[-1].append(" ")
                    levels[-1] += inner
                else:
                    levels[-1] = inner
                if value[0] in BLOCKS:
                    levels[-1].append(" ")
    return "".join(levels[0])


def _matches(node, kind, value) -> bool:
    tag, attrs, _ = node
    if kind == "tag":
        return tag == value
    found = attrs.get(kind) or ""
    return value in found.split() if kind == "class" else found == value


def extract_page(url: str, html: str) -> tuple[str, str]:
    """(title, content) of one page: the main part's text, one trimmed line per non-empty line."""
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    nodes = [value for kind, value in _events(parser.root) if kind == "open"]
    heads = ["".join(_text(n) for n in nodes if n[0] == "title").strip()]
    heads += [_text(n).strip() for n in nodes if n[0] == "h1"][:1]
    title = next((h for h in heads if h), url)
    main = next((n for k, v in MAIN for n in nodes if _matches(n, k, v)), None)
    if main is None:
        main = next((n for n in nodes if n[0] == "body"), parser.root)
    lines = [x.strip() for x in _content(main).split("\n")]
    return title, "\n".join(x for x in lines if x)


def page_extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, content); pages are independent, so this is one narrow stage."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [extract_page(u, h) for u, h in zip(pdf["url"], pdf["html"])]
            yield pd.DataFrame(
                {
                    "page_id": pdf["page_id"], "url": pdf["url"],
                    "title": [t for t, _ in found], "content": [c for _, c in found],
                }
            )

    return pages.select("page_id", "url", "html").mapInPandas(
        run, "page_id long, url string, title string, content string"
    )


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def encode_url(url: Column) -> Column:
    """Percent-encode what a URL may not hold as is: blanks, quotes, angle brackets, non-ASCII characters."""
    special = r"""[^\x21-\x7e]|["<>`]"""
    each = F.transform(
        F.split(url, ""),
        lambda c: F.when(c == " ", "%20").when(c.rlike(special), F.url_encode(c)).otherwise(c),
    )
    return F.when(url.rlike(special), F.array_join(each, "")).otherwise(url)


def resolve_link(base: Column, href: Column) -> Column:
    """Absolute address of a link, without fragment; null if it is not a web address."""
    link = F.regexp_replace(F.trim(F.replace(href, F.lit("&amp;"), F.lit("&"))), "#.*$", "")
    scheme = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*:)", 1)
    site = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)
    page = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(page == site, F.concat(site, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    query = lambda u: F.regexp_extract(u, r"(\?.*)$", 1)
    joined = (
        F.when(link == "", F.regexp_replace(base, "#.*$", ""))
        .when(link.rlike(r"(?i)^https?://"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.rlike(r"^[a-zA-Z][\w+.-]*:"), F.lit(None).cast("string"))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(page, link))
        .otherwise(F.concat(folder, link))
    )

    def clean(address):
        from corpuslens.functions.paths import normalize

        path = F.regexp_replace(F.substring(F.regexp_replace(address, r"\?.*$", ""), F.length(site_of(address)) + 1, F.length(address)), "^/", "")
        dotted = path.rlike(r"(^|/)\.\.?(/|$)")
        return F.when(dotted, F.concat(site_of(address), F.lit("/"), normalize(path), query(address))).otherwise(address)

    def site_of(address):
        return F.regexp_extract(address, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1)

    return encode_url(clean(joined))


HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""


def links_of(url: Column, html: Column) -> Column:
    """Distinct links of a page to its own host, in order."""
    found = F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), lambda h: resolve_link(url, h))
    own = lambda xs: F.filter(xs, lambda x: x.isNotNull() & (host(x) == host(url)))
    return F.array_distinct(let(found, own))


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, url, position, link)."""
    return open_array(pages, ["page_id", "url"], links_of(F.col("url"), F.col("html")), "position", "link")


def page_titles(pages: DataFrame) -> DataFrame:
    """Title by pattern only: the title element, else the first heading, else the address."""
    pick = lambda tag: F.trim(F.regexp_extract("html", rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1))
    title = F.coalesce(F.nullif(pick("title"), F.lit("")), F.nullif(pick("h1"), F.lit("")), F.col("url"))
    return pages.select("page_id", "url", title.alias("title"))


def allowed(url: Column, include: list[str] | None, exclude: list[str] | None) -> Column:
    keep = F.lit(True)
    if exclude:
        keep &= ~url.rlike("|".join(f"(?:{p})" for p in exclude))
    if include:
        keep &= url.rlike("|".join(f"(?:{p})" for p in include))
    return keep


def crawl(
    roots: DataFrame,
    pages: DataFrame,
    links: DataFrame,
    max_depth: int = 1,
    max_pages: int = 10,
    include: list[str] | None = None,
    exclude: list[str] | None = None,
) -> DataFrame:
    """Breadth-first walk from every root over (url, position, link): (root, url, depth, visit_order).

    Pages come in queue order: by depth, then order of the linking page, then position of the link. Pages
    that are not in the table, or not allowed, are skipped and do not count. Every level keeps at most
    ``max_pages`` per root, so the frontier is bounded; levels are cut at the shared checkpoint folder.
    """
    known = pages.select("url").filter(allowed(F.col("url"), include, exclude)).distinct()
    step = links.select(F.col("url").alias("_from"), "position", F.col("link").alias("url")).join(known, "url", "left_semi")
    level = (
        roots.select(F.col("root"), F.col("root").alias("url")).distinct()
        .join(known, "url", "left_semi")
        .select("root", "url", F.lit(0).alias("depth"), F.lit(1).alias("visit_order"))
    )
    visited = level
    for depth in range(1, max_depth + 1):
        frontier = level.select("root", F.col("url").alias("_from"), F.col("visit_order").alias("_at"))
        found = (
            frontier.join(step, "_from")
            .groupBy("root", "url")
            .agg(F.min(F.struct("_at", "position")).alias("_place"))
            .join(visited.select("root", "url"), ["root", "url"], "left_anti")
        )
        before = visited.groupBy("root").agg(F.count(F.lit(1)).cast("int").alias("_before"))
        near = top_per_group(found, ["root"], [F.col("_place"), F.col("url")], max_pages)
        from pyspark.sql import Window

        order = F.row_number().over(Window.partitionBy("root").orderBy("_place", "url"))
        level = (
            near.join(before, "root")
            .withColumn("visit_order", F.col("_before") + order)
            .filter(F.col("visit_order") <= max_pages)
            .select("root", "url", F.lit(depth).alias("depth"), "visit_order")
        )
        if depth < max_depth:
            level = cut_lineage(level)
        visited = visited.unionByName(level)
    return visited


def web_index(documents: DataFrame, order: str = "page_id") -> DataFrame:
    """Documents of each host's web index: ``web_<host>``, id ``url::position``, never cut into chunks."""
    named = documents.withColumn("index", F.concat(F.lit("web_"), F.replace(host(F.col("url")), F.lit("."), F.lit("_"))))
    placed = position_in_group(named, ["index"], [F.col(order)], "_position")
    return placed.select(
        "index",
        F.concat_ws("::", "url", (F.col("_position") - 1).cast("string")).alias("doc_id"),
        "url", F.coalesce("title", F.lit("")).alias("title"), F.lit("web").alias("source"), "content",
    )
