"""HTML extraction: site template removal by element subtrees counted per host.

A page is parsed to a tree of elements. Each block subtree of the main text is hashed with its tags, classes and
text, and counted per host in Spark, once for each distinct main text it is in, so mirrored pages count as one:
pairs of subtree and main text are packed by bucket and made distinct, counts are merged, and those that recur are
written as sorted hash arrays in the shared folder. A second pass deletes what recurs, inside article and main
as well, and what is marked as no part of the text: menus, headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments. Outside article and main any block with a word of MARKS
in its class or id is marked; inside, only whole classes and ids known as furniture are, and the counts decide the rest.

Inside an article, bare text blocks (PROSE without class or id) are never taken for templates: near copies and
articles with common lines share them. A block must recur in PAGES main texts, however many the host has, and in twice as
many as the page's own prose does, so that near copies keep their paragraphs, lists and tables; outside of
articles a fifth of the host's texts (SHARE) is enough in place of the latter.

The main text is that of the article elements, without those that are marked as comments, replies or teasers; or of main, where it has several articles or is
mostly beside them; or else of the body; in page order. Character references are decoded once, in each run of text between tags; white space in a block is one space; blocks are joined by one.
Null and empty pages and pages of nothing but templates give an empty text. A url without a host is its own host. Broken markup never raises:
unclosed elements end with their parent, a tag without an end is text, and from the first tag on whose quotes never close tags end at the next ">".
The time for a page grows with its length, whatever is in it. Rows may repeat; the results replace columns of their names.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared
from .textbatch import hashes, mix, slices

#: Fixed values of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    (
        "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
        "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
        "table tbody td tfoot th thead title tr ul"
    ).split()
)
ENDS_P = BLOCK - {"br", "td", "th", "tr", "option", "optgroup", "caption", "title"}
CLOSES = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
}
SCOPE = {
    "ul",
    "ol",
    "dl",
    "table",
    "select",
    "body",
    "html",
    "article",
    "main",
    "section",
    "div",
    "nav",
    "aside",
    "footer",
    "header",
    "td",
    "th",
    "li",
    "blockquote",
}
#: Elements, roles and class or id words that are no part of an article. Inside article and main only whole classes in FURNITURE and ids in PLACES count.
NOT_TEXT = set(
    "script style noscript template head title iframe object svg canvas annotation annotation-xml audio video select button textarea datalist form nav footer aside menu dialog search".split()
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
MARKS = set(
    "nav navbar navigation menu menubar header masthead topbar footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus reply replies "
    "related recommended breadcrumb breadcrumbs pagination pager widget form search skip".split()
)
FURNITURE = set(
    "nav navbar menu menubar masthead topbar sidebar ad ads adv advert adverts advertisement advertising sponsor sponsored promo "
    "cookie cookies gdpr popup overlay newsletter subscribe signup share sharing comments disqus replies breadcrumb breadcrumbs pagination pager".split()
)
PLACES = {"comments", "disqus_thread", "sidebar"}
#: Joined class and id words that name furniture inside an article too: what it is about, and what kind of box it is.
BOXED = re.compile(
    "(?:comments?|repl(?:y|ies)|respond|ads?|advert|newsletter|cookies?|related|recommended|share|sharing|social|subscribe)[-_]+"
    "(?:list|area|section|thread|form|box|slot|unit|banner|container|wrapper|notice|bar|signup|widget|posts?|articles?|stories|links|buttons?|icons|block|popup)(?:[-_].*)?"
)
OTHERS = re.compile("(?:comment|reply|response|teaser|related|recommended|promo|sponsored)(?:[-_].*)?")  # classes of articles that are none of the page's own
TEXTUAL = {"p", "li", "dd", "td", "th", "blockquote", "span", "b", "i", "em", "strong", "code"}  # a button in these is a word of theirs
MARKABLE = BLOCK - {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "caption", "figcaption", "legend", "summary", "br"}  # headings and inline elements are never deleted for a word
TEMPLATE = (BLOCK | NOT_TEXT) - {"html", "body", "br"}
PROSE = set("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 hr legend li p pre summary tbody td tfoot th thead tr".split())
PLAIN = {"html", "body", "article", "main"}  # never deleted for a class word
RAW = {t: re.compile(rf"(?i)</{t}(?=[\s/>])[^>]*>?") for t in "script style textarea title noscript iframe xmp noembed noframes".split()}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")  # possessive: nothing is tried twice
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
PAGES = 4  # a template recurs in so many distinct main texts of its host, whatever the host's size
BUCKET = 16 << 20  # bytes of html for each bucket, in whatever number of buckets
SHARE = 0.2  # on pages whose own prose recurs (near copies), those in this share of the host's texts go too, outside of articles


class Node:
    """gone: no part of any text; worded: has a word of MARKS, which counts outside article and main."""

    __slots__ = ("tag", "mark", "gone", "worded", "children")

    def __init__(self, tag: str, mark: str = "", gone: bool = False):
        self.tag, self.mark, self.gone, self.worded, self.children = tag, mark, gone, False, []


def _attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


class _Open:
    """The open elements, from the root in; where those of a tag and of SCOPE are is known without a walk."""

    def __init__(self, root: Node):
        self.nodes, self.where, self.scope = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.where.setdefault(node.tag, []).append(len(self.nodes))
        self.scope.append(len(self.nodes) if node.tag in SCOPE else self.scope[-1])
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            self.where[self.nodes.pop().tag].pop()
            self.scope.pop()

    def last(self, tag: str) -> int:
        """The place of the innermost open element of this tag, 0 if there's none."""
        held = self.where.get(tag)
        return held[-1] if held else 0


def _marked(node: Node, attributes: dict[str, str]) -> None:
    """Sets what the attributes say of a node."""
    tag = node.tag
    names, place = attributes.get("class", "").lower(), attributes.get("id", "").lower()
    node.mark = f"{attributes.get('class', '')}#{attributes.get('id', '')}"
    style = attributes.get("style", "").replace(" ", "").lower()
    node.gone = tag not in PLAIN and attributes.get("role", "").lower() in ROLES
    node.gone |= "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in style
    words = names.split()
    if tag in MARKABLE and tag not in PLAIN:
        marks = FURNITURE.intersection(words)
        # "share" is also a word for stock: it counts alone or beside other such words
        node.gone |= place in PLACES or bool(marks - {"share"}) or (bool(marks) and not set(words) - FURNITURE - MARKS - {"buttons", "bar", "links", "icons", "box"})
        node.gone |= any(BOXED.fullmatch(w) for w in (*words, place))
    if tag == "article":
        node.gone |= attributes.get("itemprop", "").lower() == "comment" or any(OTHERS.fullmatch(w) for w in (*words, place))
    if (tag in MARKABLE or tag in ("a", "ins", "label")) and tag not in PLAIN:
        node.worded = not MARKS.isdisjoint(re.split(r"[\s_-]+", f"{names} {place}"))


class _Tags:
    """Finds a page's tags, comments and declarations from left to right."""

    def __init__(self, page: str):
        self.page, self.last, self.form = page, page.rfind(">"), TAG

    def after(self, at: int) -> tuple[int, int, re.Match | None] | None:
        """The start, end and match (None but for tags) of the next."""
        page = self.page
        while (at := page.find("<", at)) >= 0:
            if page.startswith(("<!", "<?"), at):
                mark = "-->" if page.startswith("<!--", at) else ">"
                end = page.find(mark, at + 2 * len(mark) - 2)
                return at, end + len(mark) if end >= 0 else len(page), None
            if at > self.last:  # no tag ends any more
                return None
            m = self.form.match(page, at)
            if not m and self.form is TAG and (m := LOOSE.match(page, at)):  # quotes that never close
                self.form = LOOSE
            if m:
                return at, m.end(), m
            at += 1
        return None


def parse(page: str) -> Node:
    """The tree of a page: children are texts (not yet decoded) and nodes."""
    root = Node("#root")
    stack = _Open(root)
    at, tags = 0, _Tags(page)
    while found := tags.after(at):
        start, end, m = found
        if start > at:
            stack.nodes[-1].children.append(page[at:start])
        at = end
        if m is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if k := stack.last(tag):
                stack.cut(k)
            continue
        if tag in ENDS_P or tag in CLOSES:
            k = max([stack.last(x) for x in CLOSES.get(tag, ())] + [stack.last("p") if tag in ENDS_P else 0])
            if k and k >= stack.scope[-1]:
                stack.cut(k)
        node = Node(tag)
        if attributes := _attributes(m[3]):
            _marked(node, attributes)
        around = stack.nodes[-1].tag
        node.gone |= tag in NOT_TEXT and not (tag == "button" and around in TEXTUAL) and not (tag == "footer" and around == "blockquote")
        stack.nodes[-1].children.append(node)
        if tag in RAW:  # no markup inside; nothing of it is text of an article
            node.gone = True
            close = RAW[tag].search(page, at)
            at = close.end() if close else len(page)
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.push(node)
    if at < len(page):
        stack.nodes[-1].children.append(page[at:])
    return root


def _articles(node: Node, tag: str, out: list[Node]) -> list[Node]:
    """The outermost elements of this tag that aren't deleted."""
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str) or x.gone or x.worded:
            continue
        if x.tag == tag:
            out.append(x)
        else:
            stack += reversed(x.children)
    return out


def _written(parts: list[Node], without: list[Node], paragraphs: bool = False) -> int:
    """Characters of the parts' text outside links and the nodes `without`; with paragraphs, only those in p, pre, blockquote, dd and headings."""
    total, skip = 0, set(map(id, without))
    stack = [(x, not paragraphs) for x in parts]
    while stack:
        x, counts = stack.pop()
        if isinstance(x, str):
            total += len(x.strip()) if counts else 0
        elif id(x) not in skip and not x.gone and not x.worded and x.tag != "a":
            counts = counts or x.tag in ("p", "pre", "blockquote", "dd", "h1", "h2", "h3")
            stack += [(y, counts) for y in x.children]
    return total


def main_parts(root: Node) -> list[Node]:
    """The articles; but main where it has several, or more text beside them than in them, and the whole page where its paragraphs beside them are twice as long."""
    articles, mains = _articles(root, "article", []), _articles(root, "main", [])
    if not articles:
        return mains or [root]
    if mains:
        within = [a for m in mains for a in _articles(m, "article", [])]
        beside = _written(mains, within, True)
        if beside and (len(within) > 1 or beside > _written(within, [])):
            return mains
    elif _written([root], articles, True) > 2 * _written(articles, []):
        return [root]
    return articles


def text_of(parts: list[Node], deleted: set[int]) -> str:
    """The parts' text without deleted nodes (by identity): decoded, one space between words and blocks."""
    out: list[str] = []
    inside = parts[0].tag in ("article", "main")
    whole = set(map(id, parts))
    stack: list = list(reversed(parts))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(entities.unescape(x) if "&" in x else x)
            continue
        if (x.gone and id(x) not in whole) or id(x) in deleted or (not inside and (x.worded or x.tag == "header")):
            continue
        if x.tag in BLOCK:
            out.append("\n")
            stack.append("\n")
        stack += reversed(x.children)
    return " ".join("".join(out).split())


def subtrees(parts: list[Node]) -> tuple[list[Node], list[bytes]]:
    """The block subtrees below the parts, with a digest of the tags, classes and texts of each; deleted ones count as absent."""
    nodes: list[Node] = []
    names: list[bytes] = []
    whole = set(map(id, parts))
    made: dict[int, bytes] = {}
    stack = [(x, False) for x in parts]
    while stack:
        node, ready = stack.pop()
        if not ready:
            stack.append((node, True))
            stack += [(x, False) for x in node.children if not isinstance(x, str) and not x.gone]
            continue
        held = [node.tag.encode("utf-8", "replace"), node.mark.encode("utf-8", "replace")]
        for x in node.children:
            if not isinstance(x, str):
                held.append(made.get(id(x), b""))
            elif text := x.strip():
                held.append(text.encode("utf-8", "replace"))
        made[id(node)] = name = hashlib.blake2b(b"\0".join(held), digest_size=16).digest()
        if node.tag in TEMPLATE and id(node) not in whole:  # a word that is bold on many pages is no template
            nodes.append(node)
            names.append(name)
    return nodes, names


def _size(node: Node) -> int:
    """Characters below a node."""
    n, stack = 0, [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            n += len(x)
        elif not x.gone:
            stack += x.children
    return n


def templates_of(parts: list[Node], nodes: list[Node], counts: list[int], total: int) -> set[int]:
    """The nodes to delete, by identity; counts of nodes below PAGES are 0, total is the host's number of texts."""
    if not any(counts):
        return set()
    article = parts[0].tag == "article"
    count = {id(x): c for x, c in zip(nodes, counts, strict=True)}
    bare = {id(x) for x in nodes if x.tag in PROSE and x.mark in ("", "#")}
    often = {k for k, c in count.items() if c and k not in bare}
    if article and not often:
        return often
    prose, stack = [], list(parts)
    while stack:
        x = stack.pop()
        if isinstance(x, str) or x.gone or id(x) in often:
            continue
        if x.tag in PROSE and id(x) in count:
            prose.append((count[id(x)], _size(x)))
        else:
            stack += x.children
    prose.sort()
    half, own = sum(n for _, n in prose) / 2, 0
    for c, n in prose:  # the median by size
        half -= n
        own = c
        if half <= 0:
            break
    if article:
        return {k for k in often if count[k] >= 2 * own}
    return {k for k, c in count.items() if c and (c >= 2 * own or c >= SHARE * total)}


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").hostname or (url or "")
    except ValueError:
        return url or ""


def _page_keys(url: str | None, page: str | None) -> tuple[list[Node], str, list[Node], np.ndarray, int, int]:
    """The main parts and their text, their blocks with a key of each, the host's key and the key of the text."""
    parts = main_parts(parse(page or ""))
    text = text_of(parts, set())
    nodes, names = subtrees(parts)
    host = host_of(url).encode("utf-8", "replace")
    keys = hashes(pa.array([host + b"\0" + x for x in names] + [host + b"\0pages", text.encode("utf-8", "replace")], pa.binary()))
    return parts, text, nodes, keys[:-2], int(keys[-2]), int(keys[-1])


def _packed(table: np.ndarray, bucket: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The rows of each bucket as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket, table = bucket[order], table[order]
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(bucket)]
    return bucket[starts].tolist(), [table[a:b].tobytes() for a, b in zip(starts, ends, strict=False)]


def _distinct(table: np.ndarray) -> np.ndarray:
    if not len(table):
        return table
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return table[np.r_[True, (table[1:] != table[:-1]).any(1)]]


def _pairs(bits: int):
    """Distinct pairs of block and main text, by buckets of the pair, so that a block on every page is in many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 8 << 20):
            found = [np.zeros((0, 2), np.uint64)]
            for url, page in zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True):
                *_, keys, host, text = _page_keys(url, page)
                keys = np.unique(np.r_[keys, np.uint64(host)])
                found.append(np.stack([keys, np.full(len(keys), text, np.uint64)], 1))
            table = _distinct(np.concatenate(found))
            bucket = (mix(table[:, 0] ^ mix(table[:, 1])) >> np.uint64(64 - bits)).astype(np.int32)
            bucket, data = _packed(table, bucket)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(data, pa.binary())], names=["bucket", "data"])

    return run


def _count(bits: int):
    """The main texts of each block in this bucket of pairs, by buckets of the block."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        table = _distinct(np.frombuffer(b"".join(rows["data"]), np.uint64).reshape(-1, 2))
        key, count = np.unique(table[:, 0], return_counts=True)
        bucket, data = _packed(np.stack([key, count.astype(np.uint64)], 1), (mix(key) >> np.uint64(64 - bits)).astype(np.int32))
        return pd.DataFrame({"bucket": bucket, "data": data})

    return run


def _merge(at: str):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        table = np.frombuffer(b"".join(rows["data"]), np.uint64).reshape(-1, 2)
        table = table[np.argsort(table[:, 0], kind="stable")]
        first = np.flatnonzero(np.r_[True, table[1:, 0] != table[:-1, 0]]) if len(table) else np.zeros(0, np.int64)
        count = np.add.reduceat(table[:, 1], first) if len(table) else table[:, 1]
        many = count >= PAGES
        own = int(rows["bucket"].iloc[0])
        shared.put(f"{at}/{own}", [table[first, 0][many], count[many]])
        return pd.DataFrame({"bucket": [own], "n": [int(many.sum())]})

    return run


class Templates:
    """Counts of what recurs on a host's pages, from the shared folder."""

    def __init__(self, at: str, bits: int):
        self.shift, self.files = np.uint64(64 - bits), shared.Files(at)

    def counts(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.uint64)
        bucket = (mix(keys) >> self.shift).astype(np.int64)
        for b in np.unique(bucket).tolist():
            held = self.files[b].view(np.uint64)
            n = len(held) // 2
            mine = np.flatnonzero(bucket == b)
            if n:
                place = np.minimum(np.searchsorted(held[:n], keys[mine]), n - 1)
                out[mine] = np.where(held[:n][place] == keys[mine], held[n:][place], 0)
        return out


def extract_pages(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """Adds text and n_chars to pages without its html."""
    new = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    others = shared.others(pages, (f.name for f in new), html)
    spark = pages.sparkSession
    at = shared.folder(spark, "templates")
    size = pages.agg(F.sum(F.octet_length(html))).first()[0] or 0
    bits = min(31, max(8, (size // BUCKET).bit_length()))
    pairs = pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(_pairs(bits), "bucket int, data binary")
    packed = shared.by_bucket(pairs, bits).applyInPandas(_count(bits), "bucket int, data binary")
    packed = packed.unionByName(spark.range(1 << bits).select(F.col("id").cast("int").alias("bucket"), F.lit(b"").alias("data")))  # each bucket's file is there
    shared.saved(shared.by_bucket(packed, bits).applyInPandas(_merge(f"{at}/counts"), "bucket int, n long"), f"{at}/done")
    schema = T.StructType([pages.schema[c] for c in others] + new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Templates(f"{at}/counts", bits)
        for batch in slices(batches, html, 8 << 20):
            pages_ = [_page_keys(u, h) for u, h in zip(batch[url].to_pylist(), batch[html].to_pylist(), strict=True)]
            keys = np.concatenate([np.r_[p[3], np.uint64(p[4])] for p in pages_]) if pages_ else np.zeros(0, np.uint64)
            named, place = np.unique(keys, return_inverse=True)
            count = held.counts(named)[place]
            texts, start = [], 0
            for parts, text, nodes, own, *_ in pages_:
                got, total = count[start : start + len(own)], count[start + len(own)]
                start += len(own) + 1
                deleted = templates_of(parts, nodes, got.tolist(), int(total))
                texts.append(text_of(parts, deleted) if deleted else text)
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in others), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                names=schema.names,
            )

    return pages.select(*others, html).mapInArrow(run, schema)
