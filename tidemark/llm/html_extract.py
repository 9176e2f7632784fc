"""HTML extraction with a site style tree (after Yi, Liu and Li 2003).

The pages of a host are merged: elements of the same tags and attributes, on the same path, are one node of the
host's tree, at every level.  Paths begin at the page, and anew at an article or main element, so that layouts and
ids around articles don't matter inside them.  A text belongs to its nearest element that is a node; a node's content
features are its texts, link targets and image sources.  A feature's importance is one less the entropy of the pages
that have it there, a node's content importance the mean of its features', and its presentation importance the entropy
of its children's styles, each in parts of the most that so many pages could have.  Texts of nodes where both are low
repeat from page to page and are removed; inside an article only from pages all of whose features there repeat.  A
branch is gone when all of its nodes are.

Copies are told from boilerplate first.  Inside articles, pages on which all but the node has the same longest run of
text count once for it, so copies and near copies of one article aren't evidence; outside, equal pages do.

Entropy alone can't tell menus, adverts and footers that change with each page from text.  So branches whose
tags, roles or class names say what they are have no importance, and the page's own article or main element
itself is never removed.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import cut, through
from tidemark.llm.url_filters import url_parts

#: A node seen on fewer pages is never judged by its entropy; below LEAST_IMPORTANCE it is noise.
LEAST_PAGES, LEAST_IMPORTANCE = 4, 0.3
#: Stands for any feature of a node.
ANY = 0
#: Inside articles: elements that are also judged by their place among siblings of one style, from either end;
#: and those directly in which inline elements are judged too, unless they hold running text of their own.
_PLACED = frozenset("blockquote div ol p section ul".split())
_HOLDERS = frozenset("article div main section".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)", re.S)
_REST = re.compile(r"<!--.*|<[!?/][^>]*>?", re.S)
_ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b", re.S)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
_NOISE_TAG = frozenset("aside button dialog footer form head menu nav object script select style svg template title".split())
_NOISE_NAME = frozenset("ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies dialog disqus footer header masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
_NOISE_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
_CLOSES_P = _BLOCK - {"body", "html"}


class Node:
    """One element: its style, what is inside in order (texts and elements), its parent; and, once placed, the
    key of its path and the keys of the tree's nodes that it is judged by."""

    __slots__ = ("tag", "style", "inside", "parent", "noise", "root", "key", "judged", "target")

    def __init__(self, tag: str, attributes: str, parent: Node | None):
        found = {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
        names, role = f"{found.get('class', '')} {found.get('id', '')}", found.get("role", "").lower()
        self.tag, self.inside, self.parent, self.key, self.judged = tag, [], parent, 0, ()
        self.style = tag + "".join(f".{x}" for x in sorted(found.get("class", "").split())) + (f"#{found['id']}" if found.get("id") else "")
        self.target = found.get("href") or found.get("src") or ""
        self.root = tag in ("article", "main") or role in ("main", "article")
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "")
        named = tag not in ("html", "body") and not self.root and any(x.lower() in _NOISE_NAME for x in _NAME.findall(names))
        self.noise = tag in _NOISE_TAG or role in _NOISE_ROLE or hidden or named


class _Open:
    """The open elements.  Where each tag is open is kept at hand, so that no end tag walks over all of them."""

    def __init__(self, top: Node):
        self.stack, self.places = [top], {top.tag: [0]}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def nearest(self, tags: frozenset) -> int:
        return max((self.places[x][-1] for x in tags if self.places.get(x)), default=-1)

    def close(self, tags: frozenset, within: frozenset) -> None:
        """Closes the nearest open element of ``tags``, and all inside it, unless one of ``within`` is nearer."""
        top = self.stack[-1].tag
        if top in tags and top not in within and len(self.stack) > 1:  # mostly
            self.places[top].pop()
            self.stack.pop()
            return
        at = self.nearest(tags)
        if at > 0 and at > self.nearest(within):
            for node in self.stack[at:]:
                self.places[node.tag].pop()
            del self.stack[at:]


_IN_ARTICLE, _P = frozenset({"article"}), frozenset({"p"})
_OVER_P = frozenset({"article", "div", "section", "td", "th", "li", "blockquote", "body"})
_OVER_ITEMS = frozenset({"ul", "ol", "table", "dl", "select", "article"})
_ITEMS = {x: frozenset(same) for same in (("li",), ("tr",), ("td", "th"), ("dt", "dd"), ("option",)) for x in same}


def parse(page: str) -> Node:
    """The page's elements as a tree; unclosed and stray tags are put right as browsers mostly do.  Takes time in
    proportion to the page."""
    top = Node("#page", "", None)
    opened = _Open(top)
    done, size, last = 0, len(page), page.rfind(">")
    while done < size:
        at = page.find("<", done)
        # no tag ends beyond the last >, so only comments are looked for there
        m = None if at < 0 else _TOKEN.search(page, at) if at < last else _REST.search(page, at)
        if m is None:
            opened.stack[-1].inside.append(page[done:])
            break
        if m.start() > done:
            opened.stack[-1].inside.append(page[done : m.start()])
        done = m.end()
        if at >= last:
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["end"]:
            opened.close(frozenset({tag}), frozenset() if tag in ("html", "body", "article", "main") else _IN_ARTICLE)
            continue
        if tag in _CLOSES_P:
            opened.close(_P, _OVER_P)
        if tag in _ITEMS:
            opened.close(_ITEMS[tag], _OVER_ITEMS)
        node = Node(tag, m["attributes"], opened.stack[-1])
        opened.stack[-1].inside.append(node)
        if tag in _RAW:
            end = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(page, done)
            done = end.end() if end else size
        elif tag not in _VOID and not (m["attributes"] or "").endswith("/"):
            opened.push(node)
    return top


def _roots(top: Node) -> list[Node]:
    """Outermost article or main elements outside noise; a main element stands back for articles inside it."""
    found: list[tuple[Node, list[Node]]] = []
    stack: list[tuple[Node, list[Node] | None]] = [(top, None)]
    while stack:
        node, within = stack.pop()
        if node.root and node.tag == "article":
            found.append((node, [])) if within is None else within.append(node)
            continue
        if node.root and within is None:
            within = []
            found.append((node, within))
        stack += [(x, within) for x in reversed(node.inside) if isinstance(x, Node) and not x.noise]
    return [x for node, inner in found for x in inner or [node]]


def main_text(page: str | None, noise: frozenset[tuple[int, int]] = frozenset()) -> str:
    """The page's article: blocks in page order, white space as one space, joined by line feeds.

    noise: (key, feature) of the host's nodes without importance, as signed numbers; see ``site_noise``.
    """
    top = parse(page or "")
    dropped = frozenset()
    if noise:
        dropped = {key for key, _, _, features, _ in branches(top) if (_signed(key), ANY) in noise or features and all((_signed(key), _signed(x)) in noise for x in features)}
    roots = _roots(top)
    blocks: list[str] = []
    open_block: list[str] = []

    def flush() -> None:
        if text := " ".join(entities.unescape("".join(open_block)).split()):
            blocks.append(text)
        open_block.clear()

    for root in roots or [top]:
        # (node, position inside, whether its texts are removed); an explicit stack, as pages may nest deeply
        stack: list[list] = [[root, 0, False]]
        while stack:
            node, i, mute = stack[-1]
            if i == len(node.inside):
                if node.tag in _BLOCK:
                    flush()
                stack.pop()
                continue
            stack[-1][1] += 1
            child = node.inside[i]
            if isinstance(child, str):
                open_block.append(" " if mute else child)
                continue
            if child.noise or child.tag == "header" and not roots:
                if child.tag in _BLOCK:
                    flush()
                continue
            if child.tag in _BLOCK:
                flush()
            elif child.tag in ("br", "td", "th", "img"):
                open_block.append(" ")
            stack.append([child, 0, not dropped.isdisjoint(child.judged) if child.judged and dropped else mute])
        flush()
    return "\n".join(blocks)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed)


def _place(node: Node, within: int) -> None:
    """Keys of the elements in ``node``, which is outside (0), in a main (1) or in an article element (2)."""
    children = [x for x in node.inside if isinstance(x, Node) and not x.noise]
    placed: dict[str, list[Node]] = {}
    inline = within and node.tag in _HOLDERS and not any(isinstance(x, str) and x.strip() for x in node.inside)
    for child in children:
        if child.root and within < 2:
            child.key, child.judged = _hash(child.tag, 1), ()
            continue
        child.key = _hash(child.style, node.key)
        child.judged = (child.key,) if not within or child.tag in _BLOCK or inline and child.tag not in ("td", "th") else ()
        if within and child.tag in _PLACED:
            placed.setdefault(child.style, []).append(child)
    for style, same in placed.items():
        if len(same) > 1:
            for i, child in enumerate(same):
                child.judged += (_hash(f"{style} {i}", node.key), _hash(f"{style} {i - len(same)}", node.key))


def branches(top: Node) -> list[tuple[int, bool, int, frozenset[int], int]]:
    """(key, whether in an article, hash of the children's styles, features, hash of what else the page has) of each of
    the tree's nodes to which any text of the page belongs; elements of one node count together.

    What else the page has is inside articles its longest run of article text elsewhere, outside its whole text.
    """
    runs: list[tuple[int, int]] = []
    texts: list[int] = []
    found: dict[int, list] = {}
    # node, position inside, where it is (see _place), first run, features and whether a text is among them (of the nearest node)
    stack: list[list] = [[top, 0, 0, 0, [[], False]]]
    _place(top, 0)
    while stack:
        node, i, within, begin, held = frame = stack[-1]
        if i < len(node.inside):
            frame[1] += 1
            x = node.inside[i]
            if isinstance(x, str):
                if text := " ".join(x.split()):
                    held[0].append(_hash(text))
                    held[1] = True
                    texts.append(held[0][-1])
                    if within:
                        runs.append((len(text), held[0][-1]))
            elif not x.noise:
                inner = 2 if x.tag == "article" and x.root else max(within, int(x.root))
                _place(x, inner)
                own = [[], False] if x.judged else held
                if x.target:
                    own[0].append(_hash(x.target, 2))
                stack.append([x, 0, inner, len(runs), own])
            continue
        stack.pop()
        if not node.judged or not held[1]:
            continue
        style = _hash("|".join(y.style for y in node.inside if isinstance(y, Node) and not y.noise))
        for key in node.judged:
            if (seen := found.get(key)) is None:
                found[key] = [within > 0, begin, len(runs), style, set(held[0])]
            else:
                seen[1:4] = min(seen[1], begin), len(runs), _hash(str(style), seen[3])
                seen[4].update(held[0])
    whole = _hash(" ".join(map(str, texts)))
    before, after = [(0, 0)], [(0, 0)]
    for run in runs:
        before.append(max(before[-1], run))
    for run in reversed(runs):
        after.append(max(after[-1], run))
    last = len(runs)
    return [(key, inside, style, frozenset(features), max(before[begin], after[last - end])[1] if inside else whole) for key, (inside, begin, end, style, features) in found.items()]


def _branches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for host, page in zip(batch["host"], batch["html"]):
            for key, inside, style, features, rest in branches(parse(page or "")):
                same = _signed(_hash(f"{style} {sorted(features)} {rest}"))
                out.append((host, _signed(key), inside, 0, _signed(style), same))
                out += [(host, _signed(key), inside, 1, _signed(x), same) for x in features]
        yield pd.DataFrame(out, columns=["host", "key", "inside", "kind", "hash", "page"])


def importance(variants: DataFrame) -> DataFrame:
    """(host, key, inside, pages, importance, often) of variants(host, key, inside, kind, hash, c), the number c of
    pages that have a children's style (kind 0) or a content feature (kind 1) at a node.

    often: features that LEAST_PAGES pages or more have there."""
    is_style, c = F.col("kind") == 0, F.col("c")
    sums = variants.groupBy("host", "key", "inside").agg(
        F.sum(F.when(is_style, c)).alias("pages"), F.sum(F.when(~is_style, c)).alias("features"), F.sum(F.when(is_style, c * F.log(c))).alias("s"), F.sum(F.when(~is_style, c * F.log(c))).alias("f"),
        F.collect_list(F.when(~is_style & (c >= LEAST_PAGES), F.col("hash"))).alias("often"),
    )
    share = lambda total, logs: F.when(F.col("pages") > 1, 1 - F.col(logs) / (F.col(total) * F.log("pages"))).otherwise(1.0)
    return sums.select("host", "key", "inside", "pages", F.greatest(share("pages", "s"), share("features", "f")).alias("importance"), "often")


def site_noise(pages: DataFrame) -> DataFrame:
    """(host, keys, features), two arrays of one length: nodes of each host's style tree whose presentation and
    content both hardly vary.  Outside articles a feature is ANY; inside, each that LEAST_PAGES different pages have.
    """
    seen = pages.select("host", "html").mapInPandas(_branches, "host string, key long, inside boolean, kind byte, hash long, page long").distinct()
    variants = seen.groupBy("host", "key", "inside", "kind", "hash").agg(F.count("*").alias("c"))
    noise = importance(variants).where((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < LEAST_IMPORTANCE))
    noise = noise.select("host", "key", F.explode(F.when(F.col("inside"), F.col("often")).otherwise(F.array(F.lit(ANY)))).alias("feature"))
    noise = noise.groupBy("host").agg(F.collect_list(F.struct("key", "feature")).alias("noise"))
    return cut(noise.select("host", F.col("noise.key").alias("keys"), F.col("noise.feature").alias("features")), "noise")


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        noise = (frozenset(zip(keys, features)) if keys is not None else frozenset() for keys, features in zip(batch.pop("keys"), batch.pop("features")))
        texts = [main_text(*x) for x in zip(batch.pop("html"), noise)]
        yield batch.assign(text=texts)


def extract_articles(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of pages(page_id, url, html).

    The text is the page's article element, or its main element, or else its body, without branches that are
    menus, page headers, footers, sidebars, notices, adverts, forms, comments or hidden, scripts and styles,
    and without those that the host's style tree finds unimportant, inside the article as well.  A null or empty page has an empty text.
    Pages of a null URL are one host.  Repeated rows and null ids are kept; other columns are ignored.
    """
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    pages = pages.withColumn("host", url_parts(F.col("url"))[0])
    joined = pages.join(site_noise(pages), "host", "left").select("page_id", "url", "html", "keys", "features")
    out = through(joined, _extract, "page_id", "url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
