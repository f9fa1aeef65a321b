"""Main text of web pages by consensus paths of each host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import cut

#: Elements by their part in the layout.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg", "canvas", "object", "audio", "video", "head", "fieldset"} | RAW
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
CONTAINERS = {"article", "main", "section", "div", "td", "body", "center"}
#: Class and id words of parts that are no article.
DROPPED_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "overlay",
    "comment", "comments", "disqus", "replies", "sidebar", "aside", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "header", "masthead", "toolbar", "share", "sharing", "social",
    "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "widget", "pagination", "pager", "skip", "hidden",
}
#: Parts of a class name that take a dropped word back ("no-sidebar", "has-header").
KEPT_WORDS = {"no", "not", "non", "without", "with", "has", "have", "hide", "layout", "grid", "col", "cols", "page", "wrap", "wrapper", "container", "content", "main", "body", "article", "post"}
#: Parts that never hold the page's article, even in an article element of their own.
FOREIGN_WORDS = {"comment", "comments", "disqus", "replies", "related", "recommended", "promo", "promotion", "sponsor", "sponsored", "ad", "ads", "advert", "adverts", "advertisement", "widget", "newsletter"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "p", "table", "tbody", "tr", "td", "th", "pre", "blockquote", "figure", "figcaption"}
_DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "menu", "menubar", "alert", "form"}
#: Elements whose open tag ends a paragraph, or the element of the same kind before it.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body"}

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|/?[a-zA-Z].*?(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: An unlinked block of so many characters is prose; so much prose beside the best containers is a part of the article, and less is if it is a twentieth of it.
PROSE, MUCH = 40, 200
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Block:
    """A run of text in one block element: the numbers of the containers it lies in, outermost first, and whether it is in an h1."""

    __slots__ = ("inside", "linked", "text", "title")

    def __init__(self, text: str, linked: int, inside: tuple[int, ...], title: bool = False):
        self.text, self.linked, self.inside, self.title = text, linked, inside, title


def _tag_class(tag: str, attributes: dict[str, str]) -> str:
    """A container's step in its path, with digits in its first class made alike."""
    first = (attributes.get("class") or attributes.get("id") or "").split()
    return tag + ("." + re.sub(r"\d+", "0", first[0].lower()) if first else "")


def _class_words(attributes: dict[str, str]) -> set[str]:
    """The dropped words among the names in class and id. A name counts by its parts ("site-header", "sidebar-2"), but for one
    with a part that takes it back."""
    found: set[str] = set()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        parts = re.split(r"[_-]+", name)
        if not DROPPED_WORDS.isdisjoint(parts) and (len(parts) == 1 or KEPT_WORDS.isdisjoint(parts)):
            found |= DROPPED_WORDS.intersection(parts)
    return found


def _is_dropped(tag: str, attributes: dict[str, str], in_article: bool) -> tuple[bool, bool]:
    """(whether the element starts a part that is no article, whether an article or main within it ends that): layout named by
    class only may be wrapped around the article itself."""
    if tag in DROPPED and not (tag == "header" and in_article):
        return True, False
    if not attributes:
        return False, False
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role", "").lower() in _DROPPED_ROLES or _HIDING.search(attributes.get("style", "")):
        return True, False
    if tag in ("body", "html", "article", "main"):
        return False, False
    words = _class_words(attributes)
    if tag in _HEADINGS and in_article:  # parts of the text, whatever their names, but for notices and adverts
        words &= FOREIGN_WORDS | {"notice", "cookie", "cookies", "consent", "hidden"}
    return bool(words), bool(words) and FOREIGN_WORDS.isdisjoint(words)


def parse(page: str) -> tuple[list[Block], list[str]]:
    """The blocks of a page outside its layout parts, and the paths of its containers by number."""
    blocks: list[Block] = []
    paths: list[str] = []
    stack: list[tuple[str, bool, int, bool]] = []  # tag, whether it starts a dropped part, container number or -1, whether an article ends the part
    dropped = links = 0
    path: list[str] = []
    inside: tuple[int, ...] = ()
    text: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal text, linked
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                blocks.append(Block(whole, linked, inside, any(t == "h1" for t, *_ in stack)))
            text, linked = [], 0

    def pop() -> None:
        nonlocal dropped, links, inside
        if stack[-1][0] in BLOCKS:
            flush()
        tag, drops, container, _ = stack.pop()
        dropped -= drops
        links -= tag == "a"
        if container >= 0:
            inside = inside[:-1]
            path.pop()

    at, lower = 0, None
    while True:
        m = _TAG.search(page, at)
        stop = m.start() if m else len(page)
        if stop > at and not dropped:
            part = page[at:stop]
            text.append(part)
            if links:
                linked += len(part)
        if not m:
            break
        at = m.end()
        tag = m.group(2)
        if not tag:
            if m.group(0).startswith("<![CDATA[") and not dropped:
                continue
            continue
        if m.group(0)[-1] != ">":  # the page ends within a tag
            break
        tag = tag.lower()
        if m.group(1):
            if any(t == tag for t, *_ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag == "br" or tag == "wbr" or tag == "hr":
            if tag == "hr":
                flush()
            elif tag == "br" and not dropped:
                text.append(" ")
            continue
        if tag in VOID:
            continue
        raw = m.group(3)
        if tag in RAW:
            lower = lower if lower is not None else page.lower()
            end = lower.find(f"</{tag}", at) if len(lower) == len(page) else -1
            if len(lower) != len(page):
                close = re.compile(f"</{tag}", re.I).search(page, at)
                end = close.start() if close else -1
            if end < 0:
                break
            close = page.find(">", end)
            at = len(page) if close < 0 else close + 1
            continue
        if raw.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        attributes = {k.lower(): a or b or c or "" for k, a, b, c in _ATTRIBUTE.findall(raw)} if "=" in raw or "hidden" in raw else {}
        if tag in BLOCKS:
            flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] in _ENDS.get(tag, ()):
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in _SCOPES:
                    break
        if dropped and tag in ("article", "main") and not _is_dropped(tag, attributes, False)[0] and all(ends for _, drops, _, ends in stack if drops):
            stack = [(t, False, c, False) for t, _, c, _ in stack]
            dropped = 0
        drops, ends = _is_dropped(tag, attributes, any(t in ("article", "main") for t, *_ in stack)) if not dropped else (False, False)
        container = -1
        dropped += drops
        if tag in CONTAINERS and not dropped:
            container = len(paths)
            path.append(_tag_class(tag, attributes))
            paths.append("/".join(path))
            inside = (*inside, container)
        links += tag == "a"
        stack.append((tag, drops, container, ends))
    flush()
    return blocks, paths


def container_scores(blocks: list[Block], paths: list[str]) -> dict[str, float]:
    """By path, the text that its containers hold themselves, less linked text; an outer container gets a half of it."""
    scores: dict[str, float] = {}
    for b in blocks:
        worth = len(b.text) - 2 * b.linked
        for depth, container in enumerate(reversed(b.inside[-2:])):
            scores[paths[container]] = scores.get(paths[container], 0.0) + worth * (0.5**depth)
    return scores


def best_path(scores: dict[str, float]) -> str | None:
    """The path of the highest score above zero, ties to the smaller path."""
    good = [(-v, p) for p, v in scores.items() if v > 0]
    return min(good)[1] if good else None


def _belongs(gained: list[Block], kept: list[Block], depth: int, tag: str, marked: dict[int, bool], in_article: bool) -> bool:
    """Whether blocks of a container at this depth and of this tag, which lie beside the kept ones, are parts of the article."""
    plain = [b for b in gained if 2 * b.linked <= len(b.text)]
    if any(b.title for b in plain) and not any(b.title for b in kept):
        return True
    prose = [b for b in plain if len(b.text) >= PROSE]
    if in_article and tag != "main":  # beyond an article, only further ones are parts
        prose = [b for b in prose if any(marked[i] for i in b.inside[depth + 1 :])]
    elif any(len(b.inside) == depth + 1 for b in (prose if tag == "body" else plain)):
        return True
    added = sum(len(b.text) for b in prose)
    return added >= MUCH or added > 0 and 20 * added >= added + sum(len(b.text) for b in kept)


def article_blocks(blocks: list[Block], paths: list[str], best: set[int]) -> list[Block]:
    """The blocks of the article around the best containers (of one path).

    It is the innermost article or main around them, or they themselves, and grows to each outer container that holds
    more of the article beside it: a title, text of its own, or much prose in other containers. Beyond an article only
    a title, further articles and a main count. Parts of an outer container that are mostly links don't count.
    """
    hits = [b for b in blocks if best.intersection(b.inside)]
    tags = [p.rsplit("/", 1)[-1].split(".", 1)[0] for p in paths]
    marked = {i: t in ("article", "main") for i, t in enumerate(tags)}
    chain = {i for b in hits for i in b.inside}
    depth = paths[min(best)].count("/")
    around = [d for d in range(depth + 1) if marked[hits[0].inside[d]]]
    depth, in_article = (around[-1], True) if around else (depth, False)
    # by block: the depth of its last container around the best, and the container beside them that it lies in
    last, sides, sizes = [], [], {}
    for b in blocks:
        out = next((d for d, i in enumerate(b.inside) if i not in chain), len(b.inside))
        side = b.inside[out] if out < len(b.inside) else -1
        n, m = sizes.get(side, (0, 0))
        sizes[side] = n + len(b.text), m + b.linked
        last.append(out - 1), sides.append(side)
    parts = [(b, d) for b, d, side in zip(blocks, last, sides, strict=True) if side < 0 or 2 * sizes[side][1] <= sizes[side][0]]
    for d in sorted({d for _, d in parts if 0 <= d < depth}, reverse=True):
        if _belongs([b for b, x in parts if d <= x < depth], [b for b, x in parts if x >= depth], d, tags[hits[0].inside[d]], marked, in_article):
            depth = d
    return [b for b, x in parts if x >= depth]


def extract(page: str | None, path: str | None) -> str:
    """The page's article around the containers of the path; where it has none, around those of its own best path, else all blocks."""
    blocks, paths = parse(page or "")
    wanted = {i for i, p in enumerate(paths) if p == path}
    if not any(wanted.intersection(b.inside) for b in blocks):
        own = best_path(container_scores(blocks, paths))
        wanted = {i for i, p in enumerate(paths) if p == own}
        if not wanted:
            return "\n".join(b.text for b in blocks)
    return "\n".join(b.text for b in article_blocks(blocks, paths, wanted))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per page: its host, and its best path with its share of the page's score."""
    for batch in batches:
        hosts, paths, votes = [], [], []
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            scores = container_scores(*parse(page.as_py() or ""))
            if best := best_path(scores):
                hosts.append(host), paths.append(best), votes.append(scores[best] / sum(v for v in scores.values() if v > 0))
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(votes, pa.float64())], ["host", "path", "vote"])


def _extract_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [extract(page.as_py(), path.as_py()) for page, path in zip(batch.column("html"), batch.column("path"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def host_of(url) -> object:
    """The host of a URL in lower case, without user, port or a leading www.; empty if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.coalesce(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


def main_text(pages: DataFrame, *, most_broadcast: int = 100_000) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars (code points of text).

    Every page votes, with the share of its score, for the tag-class path of the container that holds most of its
    unlinked text; per host the path with most votes wins (ties to the smaller path). In all pages of the host, the
    article around the containers of that path is then extracted (article_blocks). A page without such a container is
    extracted around its own best path, or as a whole. Layout
    parts (menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments) never count.

    A null or empty html has an empty text. Pages whose url is null or has no host vote together. Null and repeated
    page_ids keep their rows; an empty table gives an empty result; other columns are ignored. Votes are added before
    the shuffle. The hosts' paths are counted: up to most_broadcast of them are broadcast, and no page is shuffled; more
    meet the pages in a join by host and salt, so that a hot host's pages go to many tasks.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    votes = base.select("host", "html").mapInArrow(_vote, "host string, path string, vote double").groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("votes"))
    winners = votes.groupBy("host").agg(F.min_by("path", F.struct(-F.col("votes"), F.col("path"))).alias("path"))
    winners = cut(winners)
    if winners.count() <= most_broadcast:
        joined = base.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63))))
        joined = base.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(64)).cast("int")).join(salted, ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "html", "path")
    return joined.mapInArrow(_extract_rows, "page_id long, url string, text string, n_chars long")
