"""Main text of web pages by site style trees.

The pages of a host are merged into one tree of style nodes (a path of tags and classes). A node
is important if its pages lay out its children in many ways (presentation) or if its texts
differ from page to page (content), both measured as entropy; branches that are unimportant
throughout are removed from each page, and so are the elements that HTML itself or a usual
class name marks as navigation, notice, advert, form or comment; if that leaves nothing, text that
only a class name marks stays. Where a page marks an article that holds most of its unmarked text, only that is
taken."""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fitlens.llm.common import written

# Element names of HTML and usual class names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table tbody td tfoot th thead tr ul".split())
NOISE_TAGS = frozenset(
    "aside audio button canvas datalist dialog fieldset footer form head iframe input label legend map menu meter nav noscript "
    "object optgroup option output picture progress script search select style svg template textarea title video".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs byline-share captcha comment comments commentlist "
    "consent cookie cookies disqus footer gdpr header-bar login masthead menu modal nav navbar navigation newsletter notice "
    "notification pagination pager popup promo promotion related recommended reply replies respond share sharing shares sidebar "
    "signup skip social sponsor sponsored subscribe subscription tagcloud toc toolbar topbar widget".split())
#: In a compound name like ``no-sidebar`` these say that the element is none of the kind; the others
#: only say that it holds something of the kind, as in ``ad-slot``.
NEGATING = frozenset("no not non has have with without hide hides is".split())
HOLDERS = frozenset(
    "area bar block bottom box button buttons column container content element frame group holder inner item items left link links "
    "list outer overlay panel placeholder region right row section site slot thread top unit wrap wrapper".split())
#: Compound names whose last part says too little.
NOISE_NAMES = frozenset("site-header page-banner global-header top-header site-info back-to-top table-of-contents related-posts related-articles".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
CONTENT_TAGS = frozenset(["article", "main"])
#: Elements of running text: inside an article a class name does not take them away.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th figcaption caption".split())
#: How an element is marked: not at all, by a word that is only part of its class or id, by a whole
#: word, by its tag or role.
PLAIN, HINT, WORD, TAG = range(4)
CLOSED_BY = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)),
             "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
             "option": ("option", ("select", "datalist"))}

_OPEN = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
# The rest of a tag. Possessive, so that no part of it is read twice.
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)*+)>""")
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z][a-z-]*[a-z]|[a-z]")

#: Pages of a host below which a node counts as important, weight of what lies below a node
#: against its own layout, and the share of the host's most important text below which a branch
#: is noise.
MIN_PAGES, BELOW, NOISE = 5, 0.9, 0.2
#: Levels of the tree; what lies deeper counts to the node of the last level.
MAX_DEPTH = 128


def _names_noise(word: str) -> int:
    """What a word of a class or id says: its last part names the thing (``site-footer``), unless another
    negates it; a first part names what a holder holds (``ad-slot``)."""
    parts = [p for p in re.split(r"[-_]+", word) if p]
    if word in NOISE_WORDS or "-".join(parts) in NOISE_NAMES:
        return WORD
    if len(parts) < 2 or NOISE_WORDS.isdisjoint(parts):
        return PLAIN
    if not NEGATING.isdisjoint(parts):
        return PLAIN
    if parts[-1] in NOISE_WORDS or parts[0] in NOISE_WORDS and all(p in HOLDERS or p.isdigit() or p in NOISE_WORDS for p in parts[1:]):
        return WORD
    return HINT


def _marked(tag: str, attributes: str, in_article: bool) -> tuple[str, int]:
    """Style name of an element, and how its name or class marks it as noise. A form may wrap a whole
    page, so it marks no more than a word does."""
    noise, style = PLAIN, tag
    if tag in NOISE_TAGS or tag == "header" and not in_article:
        noise = WORD if tag == "form" else TAG
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            words = value.split()
            if name == "role":
                if any(w in NOISE_ROLES for w in words):
                    noise = max(noise, WORD if "form" in words else TAG)
            else:
                if tag not in ("body", "html", *CONTENT_TAGS) and not (in_article and tag in TEXT_TAGS):
                    noise = max([noise, *map(_names_noise, words)])
                if name == "class" and words:
                    style = f"{tag}.{'.'.join(sorted(words))}"
    return style, noise


class Block:
    __slots__ = ("path", "text", "mark", "inside")

    def __init__(self, path: str, text: str, mark: int, inside: bool):
        self.path, self.text, self.mark, self.inside = path, text, mark, inside

    @property
    def noise(self) -> bool:
        return self.mark >= WORD


def parse(page: str | None) -> tuple[list[Block], dict[str, list[str]]]:
    """Blocks of text in page order, and the children of every style node in order of appearance.
    White space in a block is one space, character references are decoded, empty blocks left out."""
    blocks: list[Block] = []
    children: dict[str, list[str]] = {}
    # Tag, path, mark, whether in an article, depth of the path, path of the nearest block.
    stack: list[tuple[str, str, int, bool, int, str]] = [("", "", PLAIN, False, 0, "")]
    open_: dict[str, int] = {}
    parts: list[str] = []
    text = page or ""
    at, end, owner = 0, len(text), stack[0]

    def flush():
        if parts:
            joined = " ".join("".join(parts).split())
            if joined:
                blocks.append(Block(owner[5], joined, owner[2], owner[3]))
            parts.clear()

    def cut(k):
        for tag, *_ in stack[k:]:
            open_[tag] -= 1
        del stack[k:]

    def close(names, scope=()):
        # Only where such a tag is open is the stack searched for it.
        if any(open_.get(n) for n in names):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in names:
                    flush()
                    cut(k)
                    return
                if stack[k][0] in scope:
                    return

    def add(piece):
        nonlocal owner
        if piece:
            if not parts or stack[-1][2] != owner[2]:
                flush()
                owner = stack[-1]
            parts.append(entities.unescape(piece) if "&" in piece else piece)

    while at < end:
        m = _OPEN.search(text, at)
        if not m:
            add(text[at:])
            break
        add(text[at:m.start()])
        at, tag = m.end(), m[2]
        if tag is None:
            # A comment or declaration, to the end of the page if nothing ends it.
            mark = "-->" if m[0] == "<!--" else ">"
            found = text.find(mark, at)
            at = found + len(mark) if found >= 0 else end
            continue
        rest = _REST.match(text, at)
        if not rest:
            break  # a tag that nothing ends has the rest of the page
        at, tag = rest.end(), tag.lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            if open_.get(tag):
                cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
            continue
        if tag in BLOCKS:
            flush()
            if tag in CLOSED_BY:
                names, scope = CLOSED_BY[tag]
                close(names.split(), scope)
            elif tag not in ("html", "head", "body"):
                close(("p",), ("table", "td", "th", "button"))
            if tag == "body":
                close(("head",))
        elif tag == "br":
            add(" ")
        top = stack[-1]
        style, noise = _marked(tag, rest[1], top[3])
        path, depth = top[1], top[4]
        if depth < MAX_DEPTH:
            path, depth = f"{path}/{style}", depth + 1
            seen = children.setdefault(top[1], [])
            if not seen or seen[-1] != style:
                seen.append(style)
        if tag in VOID or rest[1].endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(text, at)
            found = text.find(">", closing.end()) if closing else -1
            at = found + 1 if found >= 0 else end
            continue
        # The words of a wrapper say nothing of an article below it.
        above = PLAIN if tag in CONTENT_TAGS and top[2] < TAG else top[2]
        open_[tag] = open_.get(tag, 0) + 1
        stack.append((tag, path, max(above, noise), top[3] or tag in CONTENT_TAGS, depth, path if tag in BLOCKS else top[5]))
    flush()
    return blocks, children


def main_text(page: str | None, noise_paths=frozenset()) -> str:
    """Blocks that count, joined by an empty line. Entropy takes nothing of a marked article and never
    empties a page, and class names do not either; what the tags themselves mark never stays."""
    blocks, _ = parse(page)
    good = [b for b in blocks if not b.noise] or [b for b in blocks if b.mark < TAG]
    important = [b for b in good if b.inside or b.path not in noise_paths] if noise_paths else good
    good = important or good
    # An article has the text where it holds at least half of what nothing marks.
    size = lambda inside: sum(len(b.text) for b in good if b.inside == inside and b.mark == PLAIN)
    if any(b.inside for b in good) and size(True) >= size(False):
        good = [b for b in good if b.inside]
    return "\n\n".join(b.text for b in good)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def style_nodes(pages: DataFrame) -> DataFrame:
    """One row per host and style node: ``host, path, pages``, the entropy of its layouts and of its
    texts. Pages of a host with the same blocks count once. ``pages`` needs ``url, html``."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            out: dict[str, list] = {"row": [], "page": [], "path": [], "kind": [], "feature": []}
            for i, page in enumerate(batch.column("html").to_pylist()):
                blocks, children = parse(page)
                found = {(b.path, 1, b.text) for b in blocks if not b.noise}
                found |= {(p, 2, " ".join(c)) for p, c in children.items()}
                found |= {(p, 0, "") for p in {f[0] for f in found}}
                own = "\n".join(f"{b.path}\n{b.text}" for b in blocks if not b.noise)
                out_page = xxh3_64_intdigest(own.encode("utf-8", "surrogatepass")) >> 1
                for path, kind, feature in found:
                    out["row"].append(i)
                    out["page"].append(out_page)
                    out["path"].append(path)
                    out["kind"].append(kind)
                    out["feature"].append(xxh3_64_intdigest(feature.encode("utf-8", "surrogatepass")) >> 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("host").take(pa.array(out["row"], pa.int64())), pa.array(out["page"], pa.int64()),
                 pa.array(out["path"], pa.string()), pa.array(out["kind"], pa.int32()), pa.array(out["feature"], pa.int64())],
                ["host", "page", "path", "kind", "feature"])

    narrow = pages.select(host_of(F.col("url")).alias("host"), "html")
    features = narrow.mapInArrow(emit, "host string, page long, path string, kind int, feature long").distinct()
    counts = features.groupBy("host", "path", "kind", "feature").agg(F.count(F.lit(1)).alias("n"))
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    nodes = counts.groupBy("host", "path").agg(
        of(0, F.col("n")).alias("pages"), of(1, F.lit(1)).alias("texts"), of(1, F.log("n")).alias("text_logs"),
        of(2, F.col("n") * F.log("n")).alias("layout_logs"))
    all_pages = F.log(F.col("pages"))
    layout = F.when(F.col("layout_logs").isNull(), None).when(F.col("pages") < MIN_PAGES, 1.0).otherwise(
        F.greatest(F.lit(0.0), 1 - F.col("layout_logs") / (F.col("pages") * all_pages)))
    content = F.when(F.col("texts").isNull(), None).when(F.col("pages") < MIN_PAGES, 1.0).otherwise(
        F.greatest(F.lit(0.0), 1 - F.col("text_logs") / (F.col("texts") * all_pages)))
    return nodes.select("host", "path", "pages", layout.alias("layout"), content.alias("content"))


def _noise_of_host(nodes: pd.DataFrame) -> list[str]:
    """Paths that are unimportant together with everything below them."""
    rows = {r.path: r for r in nodes.itertuples()}
    below: dict[str, list[str]] = {}
    for path in rows:
        parent = path.rpartition("/")[0]
        if path and parent in rows:
            below.setdefault(parent, []).append(path)
    best = max((r.content for r in rows.values() if not math.isnan(r.content)), default=1.0)
    importance: dict[str, float] = {}
    noise: set[str] = set()
    for path in sorted(rows, key=lambda p: -p.count("/")):
        row, parts = rows[path], []
        for child in below.get(path, ()):
            parts.append((rows[child].pages, importance[child]))
        if not math.isnan(row.content):
            parts.append((row.pages, row.content))
        value = sum(n * x for n, x in parts) / sum(n for n, _ in parts) if parts else 1.0
        if below.get(path) and not math.isnan(row.layout):
            value = (1 - BELOW) * row.layout + BELOW * value
        importance[path] = value
        if value < NOISE * best and all(c in noise for c in below.get(path, ())):
            noise.add(path)
    return sorted(p for p in noise if not math.isnan(rows[p].content))


def noise_paths(pages: DataFrame) -> DataFrame:
    """``host, noise``: the style nodes to remove, for hosts with any."""
    def run(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
        found = _noise_of_host(nodes.astype({"layout": float, "content": float}))
        return pd.DataFrame({"host": pd.Series([key[0]] * len(found), dtype=object), "path": pd.Series(found, dtype=object)})

    found = style_nodes(pages).groupBy("host").applyInPandas(run, "host string, path string")
    return found.groupBy("host").agg(F.collect_set("path").alias("noise"))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages`` (``page_id, url, html``; other columns
    are ignored). A null or empty page has empty text; pages without a host form one site. Equal
    rows give equal rows.

    Pages are parsed twice, so no page text is stored or shuffled for the tree, which has one row
    per host and style node. The join back by host is a broadcast only where the table that was
    written is small enough for Spark's own limit; otherwise Spark splits the large hosts."""
    removed = written(noise_paths(pages)).withColumnRenamed("host", "_host")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("_site")).join(
        removed, F.col("_site") == F.col("_host"), "left").select("page_id", "url", "html", "noise")
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, frozenset(n or ())) for p, n in zip(
                batch.column("html").to_pylist(), batch.column("noise").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                 pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
