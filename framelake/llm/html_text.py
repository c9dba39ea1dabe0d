"""Operator 9: main text of web pages by removal of site templates.

1. Every page is read into its element tree; each block element's subtree gets a hash of its white-space-normalised source.
2. Spark counts the pages of each host that hold a subtree. Pages of one host whose text (before templates go) is equal are
   copies and count once, so that copies of a page cannot make its content a template. A subtree on many such pages of its host is template.
3. Pages join the template subtrees of their own host. The text of a page is what is left after these subtrees, the elements whose role is not the
   article (navigation, asides, forms, scripts, reader comments, an article inside an article, hidden elements, ...) and those that a class or id names as
   such a part. A name counts by whole tokens (`sidebar`, `site-sidebar`, not `with-sidebar`); ids of headings, sections and paragraphs inside an
   article are anchors and name nothing. A part that only its name marks stays if it holds most of the page's text, or the page's only article.
   If the page has an article (or main) element, the text is that element's.
   Inside it, headings, paragraphs, lists, tables and figures are never template, other elements only on INSIDE_PAGES pages and INSIDE_SHARE of the host's. On a
   host that has copies of one page only nothing is.

Null html and pages without text give an empty string. Broken markup is read as far as it goes: unclosed elements end with
their parent. Repeated rows and null ids are kept; a page with a null or odd url belongs to the host of its own text.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, tidied

MIN_PAGES, MIN_SHARE = 3, 0.02  # a subtree on so many pages of different text of its host, and on such a share of them, is template
INSIDE_PAGES, INSIDE_SHARE = 5, 0.5  # the same inside an article

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<raw>script|style|noscript|template|svg|iframe)\b.*?(?:</(?P=raw)\s*+>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][\w:-]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>|(?P<text>[^<]++|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TELLS = re.compile(r"class|id|role|hidden|style", re.I)
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)

# Element names of HTML and common names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br img wbr"
    " math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot munder mover munderover mfenced semantics annotation audio video canvas object button textarea select option output meter progress".split())
DROP = frozenset("nav footer aside form head title dialog menu fieldset".split())
OUTSIDE = frozenset("figcaption audio video canvas object button textarea select option datalist math".split())  # text of an article, but no text beside one
LANDMARK = frozenset("article main".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre article main section body html ul ol li dl dt dd table thead tbody tr td th caption figure figcaption".split())
ANCHORS = frozenset("p h1 h2 h3 h4 h5 h6 section li dt dd blockquote figure table".split())  # their ids inside an article name places
CLOSES_P = frozenset("p div ul ol dl li dt dd table tr td th thead tbody section article aside header footer nav main form h1 h2 h3 h4 h5 h6 blockquote pre figure hr address fieldset".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
COMMENTS = frozenset("comment comments commentlist commentform reply replies respond disqus".split())
PARTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices"
    " newsletter subscribe subscription signup promo promoted promotion sponsor sponsored".split()
)
PARTS_OUTSIDE = PARTS | frozenset(
    "header alert popup modal overlay login share sharing social related recommended recommendations widget widgets toolbar masthead pagination pager skip complementary contentinfo search searchbox".split()
)
DENIES = frozenset("no not non with without has have is hide hides show shows free js".split())  # `no-sidebar`, `has-menu`, `ad-free` describe other elements
PIECE = re.compile(r"[a-z]+")
KEPT, NAMED, GONE = 0, 1, 2


def names(token: str, parts: frozenset[str]) -> bool:
    """Does a class or id name one of the parts, as a whole, by its first or by its last word?"""
    words = PIECE.findall(token.lower())
    return bool(words) and (words[0] in parts or words[-1] in parts) and DENIES.isdisjoint(words)


def part_kind(tag: str, attrs: str, inside: bool, in_article: bool) -> int:
    """GONE for what is not the article by its element, role or being hidden, and for comments; NAMED for a part by its name alone; else KEPT."""
    if tag in DROP or not inside and (tag in OUTSIDE or tag == "header") or tag == "article" and in_article:
        return GONE
    if not attrs or tag in ("html", "body", "main") or not TELLS.search(attrs):
        return KEPT
    parts, kind = PARTS if inside else PARTS_OUTSIDE, KEPT
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and NO_DISPLAY.search(value):
            return GONE
        if name not in ("class", "id", "role") or name == "id" and inside and tag in ANCHORS:
            continue
        for token in value.split():
            if names(token, COMMENTS):
                return GONE
            if tag != "article" and names(token, parts):
                kind = NAMED
    return kind


def read_page(page: str, template: frozenset[int] | None) -> tuple[list[tuple[int, bool]], str]:
    """(hash, inside an article) of the page's subtrees and its main text (template None), or its main text without the `template` subtrees."""
    hashes: list[tuple[int, bool]] = []
    blocks: list[tuple[str, bool, int]] = []  # text, inside an article, innermost named part
    open_: list[tuple[str, int, int, int, bool, int]] = []  # tag, start, kind, first block, inside an article, named part around it
    above = [-1]  # of each named part the one around it; the first entry stands for none
    buffer: list[str] = []
    dropped = inside = articles = part = 0

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                blocks.append((text, inside > 0, part))

    def close(at: int) -> None:
        nonlocal dropped, inside, articles, part
        tag, start, kind, first, within, around = open_.pop()
        if tag in INLINE:
            dropped -= kind != KEPT
            return
        flush()
        part = around
        dropped -= kind == GONE
        inside -= tag in LANDMARK
        articles -= tag == "article"
        if tag not in LANDMARK and tag not in ("html", "body") and not (within and tag in PROSE):
            h = xxhash.xxh3_64_intdigest(" ".join(page[start:at].split()), within) - (1 << 63)
            if template is None:
                hashes.append((h, within))
            elif h in template:
                del blocks[first:]

    for m in TOKEN.finditer(page):
        kind = m.lastgroup
        if kind == "text":
            if not dropped:
                buffer.append(entities.unescape(m["text"]) if "&" in m["text"] else m["text"])
            continue
        if not (tag := m["tag"]):
            continue  # comments, declarations, raw elements
        tag = tag.lower()
        if m["end"]:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    while len(open_) > i + 1:
                        close(m.start())
                    close(m.end())
                    break
                if tag in INLINE and open_[i][0] not in INLINE:
                    break
            continue
        if tag in INLINE:
            if tag == "br":
                buffer.append(" ")
            elif tag not in VOID and not m["attrs"].endswith("/") and (held := part_kind(tag, m["attrs"], inside > 0, articles > 0)):
                dropped += 1
                open_.append((tag, m.start(), held, len(blocks), inside > 0, part))
            continue
        flush()
        if tag in CLOSES_P:
            while open_ and (open_[-1][0] == "p" or open_[-1][0] in INLINE):
                close(m.start())
        if tag in SIBLINGS:
            while open_ and open_[-1][0] in SIBLINGS[tag] | {"p"}:
                close(m.start())
        if tag in VOID or m["attrs"].endswith("/"):
            continue
        held = part_kind(tag, m["attrs"], inside > 0, articles > 0)
        open_.append((tag, m.start(), held, len(blocks), inside > 0, part))
        if held == NAMED:
            above.append(part)
            part = len(above) - 1
        dropped += held == GONE
        inside += tag in LANDMARK
        articles += tag == "article"
    while open_:
        close(len(page))
    flush()
    return hashes, "\n".join(main_text(blocks, above))


def main_text(blocks: list[tuple[str, bool, int]], above: list[int]) -> list[str]:
    """The blocks of the article, or those of the page where it has none; named parts go unless they hold most of the text or the only article."""
    size = [0] * len(above)
    for text, _, part in blocks:
        while part > 0:
            size[part] += len(text)
            part = above[part]
    most, gone = sum(len(text) for text, _, _ in blocks) / 2, [False] * len(above)
    for part in range(1, len(above)):  # a part comes after the one around it
        gone[part] = size[part] <= most or gone[above[part]]
    stays = [(text, within) for text, within, part in blocks if not gone[part]]
    return [t for t, within in stays if within] or [t for t, within, _ in blocks if within] or [t for t, _ in stays]


def host_of(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


def template_subtrees(keyed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, inside_pages: int = INSIDE_PAGES, inside_share: float = INSIDE_SHARE) -> DataFrame:
    """(key, subtrees): for every page of (key, host, html), host a number, its subtrees that are template of its host."""

    def subtrees(batches: Iterator):
        for batch in batches:
            rows = []
            for k, h, page in zip(batch["key"], batch["host"], batch["html"], strict=True):
                hashes, text = read_page(page, None)
                body = xxhash.xxh3_64_intdigest(text) - (1 << 63)
                rows += [(k, h, x, within, body) for x, within in {(None, False), *hashes}]
            yield pd.DataFrame(rows, columns=["key", "host", "subtree", "within", "body"], dtype=object)  # nulls would turn 64-bit hashes into floats

    held = keyed.mapInPandas(tidied(subtrees), "key bigint, host bigint, subtree bigint, within boolean, body bigint")  # a row of no subtree for each page
    held = materialize(held, "held")
    counts = held.groupBy("host", "subtree", "within").agg(F.countDistinct("body").alias("n"))
    counts = materialize(counts.where(F.col("subtree").isNull() | (F.col("n") >= F.when(F.col("within"), inside_pages).otherwise(min_pages))), "subtrees")
    sizes = counts.where("subtree is null").select("host", F.col("n").alias("pages"))
    common = counts.where("subtree is not null").join(sizes, "host").where(F.col("n") >= F.when(F.col("within"), inside_share).otherwise(min_share) * F.col("pages")).select("host", "subtree")
    return held.join(common, ["host", "subtree"]).groupBy("key").agg(F.collect_set("subtree").alias("subtrees"))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of (page_id, url, html)."""
    page = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", page.alias("html"), host_of("url").alias("host"), F.xxhash64("page_id", "url", page).alias("key"))
    template = template_subtrees(keyed.select("key", F.xxhash64("host").alias("host"), "html").where("html <> ''"))
    joined = keyed.select("key", "page_id", "url", "html").join(template, "key", "left")

    def texts(batches: Iterator):
        for batch in batches:
            found = [read_page(page, frozenset(known if known is not None else ()))[1] for page, known in zip(batch["html"], batch["subtrees"], strict=True)]
            yield batch[["page_id", "url"]].assign(text=found)

    out = joined.drop("key").mapInPandas(tidied(texts), "page_id bigint, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
