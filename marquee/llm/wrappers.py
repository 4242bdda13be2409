"""Main text of web pages through inferred wrappers.

A wrapper is a union-free regular expression over a host's token streams: tags in
order, text slots, and groups that are optional or repeated. It is inferred by
aligning one page after another. Equal neighbours, alone or in groups of two or
three, are a repeated group. A tag is aligned with the tag of the same sign and
occurrence under the same parent; what only some streams have becomes optional,
and where streams differ in text, the text becomes a slot. Text that is the same on
all pages of a host is a constant of its wrapper.

A wrapper is kept as rows, one for each token, so joining two wrappers is a sum:
tasks align their own pages, Spark adds their wrappers up by host and token. No
host is gathered in one task, and results depend neither on the order of pages nor
on partitions.

The wrapper tells content from furniture: the article (or, on hosts without such an
element, the element with most running text) without what tags, roles and classes
name as furniture. Outside marked articles its constants and the menus among its
repeated groups go too.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.shared import materialize

NAME = r"[A-Za-z][A-Za-z0-9:-]*+"
#: Quotes count only behind an equals sign; nothing here is tried twice.
TAG = re.compile(rf"<(?P<close>/?)(?P<tag>{NAME})(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
PLAIN_TAG = re.compile(rf"<(?P<close>/?)(?P<tag>{NAME})(?P<attrs>[^>]*+)>")
RAW = {
    t: re.compile(rf"</{t}\s*+>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "select")
}
ATTRIBUTE = re.compile(r"([A-Za-z-]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?+")
VOID = {"img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "button", "canvas", "cite", "code", "data", "del", "dfn", "em", "font", "g", "i", "ins",
    "kbd", "label", "map", "mark", "math", "mfrac", "mi", "mn", "mo", "mrow", "msqrt", "msub", "msup", "mtext", "nobr", "object", "output", "q",
    "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "svg", "text", "time", "tspan", "tt", "u", "var",
}
#: An opening tag ends open elements of these kinds, up to the boundary tags.
ENDS = {
    "li": ({"li", "p"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}), "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
FURNITURE_TAGS = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "fieldset"}
FURNITURE_ROLES = {"navigation", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "form"}
#: Names of furniture wherever it stands: menus, adverts, notices, reader comments.
FURNITURE_NAMES = re.compile(
    r"(?:^|[-_\s])(?:nav(?:igation|bar|menu|links?)?|menu|breadcrumbs?|side-?bar|ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|"
    r"notices?|alert|popup|modal|newsletter|subscri\w+|shar(?:e|ing)|social|comments?|disqus|repl(?:y|ies)|respond|paginat\w+|pager|toolbar)"
    r"(?:$|[-_\s])",
    re.I,
)
#: A class that tells what a page has is no furniture, nor is a box around the content and its sidebar.
HAS_NAME = re.compile(r"(?:has|no|with|without|is)[-_]|.*[-_](?:wrap|wrapper|layout|container)$", re.I)
#: Whole classes by which an article is an advert or a reader's comment.
NO_ARTICLE = re.compile(r"(?:ads?|advert\w*|sponsor\w*|promo|comments?|comment[-_]\S+|repl(?:y|ies))", re.I)
SECTION_IDS = re.compile(r"(?:comments?|disqus|respond|ads?)(?:$|[-_])", re.I)
#: Elements that some sites put around the whole page.
AROUND_ALL = {"form", "fieldset", "dialog"}
#: Names of furniture around the article; within it they are part of it.
OUTER_NAMES = re.compile(
    r"(?:^|[-_\s])(?:header|masthead|footer|aside|banner|related|recommend\w*|login|signup|register|form|widget|skip\w*)(?:$|[-_\s])", re.I
)
CONTENT_NAMES = re.compile(r"(?:^|[-_\s])(?:article(?:-?body)?|content|post(?:-?body)?|entry|story|main)(?:$|[-_\s])", re.I)
SPACES = re.compile(r"\s+")
DIGITS = re.compile(r"\d+")
#: Different pages that must agree before a text counts as the template's. Fewer pages
#: are no evidence: two articles may well share a paragraph.
TEMPLATE_PAGES = 8
#: Elements nested deeper are read as part of the one around them; their text stays.
MOST_DEPTH, MOST_MARKED_DEPTH = 100, 140


class Node:
    """An element or a text ("#") of a page."""

    __slots__ = ("sign", "kind", "items", "text", "chars", "links", "raw", "marked")

    def __init__(self, sign: str, kind: str = "", text: str | None = None, chars: int = 0, links: int = 0):
        self.sign, self.kind, self.text, self.chars, self.links = sign, kind, text, chars, links
        self.items: list[Node] = []
        self.raw = self.marked = 0


def _furniture_name(names: str) -> bool:
    """Whether a class or id names furniture by itself."""
    return any(
        FURNITURE_NAMES.search(name) and not (HAS_NAME.match(name) and (name[:3].lower() in ("has", "no-", "no_", "is-", "is_", "wit") or CONTENT_NAMES.search(name)))
        for name in names.split()
    )


def _kind(tag: str, attributes: dict[str, str], inside: bool = False) -> str:
    """ "x" furniture, "h" furniture unless in an article, "c" article, "n" named like one, "" neither.
    The id of a section in an article is made of its heading, so few of them name furniture."""
    own_id = attributes.get("id", "")
    if inside and tag == "section" and not SECTION_IDS.match(own_id):
        own_id = ""
    role, names = attributes.get("role", "").lower(), f"{attributes.get('class', '')} {own_id}"
    if tag in FURNITURE_TAGS or role in FURNITURE_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return "x"
    if "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return "x"
    if tag == "article" and any(map(NO_ARTICLE.fullmatch, attributes.get("class", "").split())):
        return "x"
    if tag in ("article", "main") or role in ("main", "article") or attributes.get("itemprop") == "articleBody":
        return "c"
    if tag not in ("body", "html") and names != " ":
        if _furniture_name(names):
            return "x"
        if OUTER_NAMES.search(names):
            return "h"
    if tag == "header" or role == "banner":
        return "h"
    return "n" if CONTENT_NAMES.search(names) else ""


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, close mark, tag, attributes) of each tag of a page in one pass; comments,
    declarations and elements whose text is no text have the tag "". What begins like a
    tag but has no end is text."""
    at, last, pattern = page.find("<"), page.rfind(">"), TAG
    while 0 <= at < last:
        m = pattern.match(page, at)
        if m is None and page[at + 1 : at + 2] in "!?" and at + 1 < len(page):
            comment = page.startswith("<!--", at)
            end = page.find("-->", at + 4) + 3 if comment else page.find(">", at) + 1
            end = end if end > 3 or not comment else len(page)
            yield at, end, "", "", ""
        elif m is None and PLAIN_TAG.match(page, at):  # quotes hide every later end: from here on they count for nothing
            pattern = PLAIN_TAG
            continue
        elif m is None:
            end = at + 1
        else:
            tag, end = m["tag"].lower(), m.end()
            if tag in RAW and not m["close"]:
                closed = RAW[tag].search(page, end)
                yield at, closed.end() if closed else len(page), "", "", ""
                end = closed.end() if closed else len(page)
            else:
                yield at, end, m["close"], tag, m["attrs"]
        at = page.find("<", end)


def parse(page: str) -> Node:
    """The element tree of a page. Inline tags are no elements; a text is what stands
    between two block tags, its references decoded, its white space single spaces."""
    root = Node("html")
    stack, run = [("html", root, 0, False, False)], []  # tag, node, depth, in an article, in furniture
    furnished = False
    open_tags = Counter()  # of the stack, so that a stray closing tag costs nothing
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        if run:
            text = SPACES.sub(" ", entities.unescape("".join(run))).strip()
            run.clear()
            if text:
                stack[-1][1].items.append(Node("#", text=text, chars=len(text), links=min(linked, len(text))))
        linked = 0

    def put(raw: str) -> None:
        nonlocal linked
        if raw:
            run.append(raw)
            if links:
                linked += len(raw.strip())

    def cut(k: int) -> None:
        open_tags.subtract(entry[0] for entry in stack[k:])
        del stack[k:]

    at = 0
    for start, end, close, tag, attrs in _tags(page):
        put(page[at:start])
        at = end
        if not tag or tag in VOID:
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if close else 1
            continue
        flush()
        if close:
            links = 0
            if open_tags[tag] > 0:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                cut(k)
            continue
        if tag in ("html", "body") and stack[-1][0] in ("html", "head"):
            cut(1)
            if tag == "html":
                continue
        if tag in ENDS:
            ended, bounds = ENDS[tag]
            k, lowest = len(stack) - 1, 0
            while k > max(0, len(stack) - MOST_DEPTH) and stack[k][0] not in bounds:
                lowest = k if stack[k][0] in ended else lowest
                k -= 1
            if lowest:
                cut(lowest)
        elif stack[-1][0] == "p":
            cut(len(stack) - 1)
        attributes = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attrs)} if attrs.strip(" /") else {}
        _, above, depth, inside, hidden = stack[-1]
        kind = _kind(tag, attributes, inside)
        if depth >= (MOST_MARKED_DEPTH if kind else MOST_DEPTH) and (kind != "x" or hidden):
            if tag != "hr":
                stack.append((tag, *stack[-1][1:]))
                open_tags[tag] += 1
            continue
        named = DIGITS.sub("0", attributes.get("class", "").split(" ")[0]) if attributes.get("class") else ""
        node = Node(f"{tag}.{named}" if named else tag, kind)
        above.items.append(node)
        furnished = furnished or kind == "x"
        if tag != "hr":
            stack.append((tag, node, depth + 1, inside or kind == "c", hidden or kind == "x"))
            open_tags[tag] += 1
    put(page[at:])
    flush()
    if furnished:
        _weigh(root)
        _keep_around(root, root.raw, root.marked)
    return root


def _weigh(node: Node) -> None:
    """Characters outside links of each element, and of those the ones in articles."""
    node.raw = max(0, node.chars - node.links)
    for x in node.items:
        _weigh(x)
        node.raw += x.raw
        node.marked += x.marked
    if node.kind == "c":
        node.marked = node.raw


def _keep_around(node: Node, every: int, marked: int) -> None:
    """What holds the articles (half of their text) is no furniture, nor is a form around most
    of a page without any, whatever it is called."""
    if node.kind == "x":
        around = node.sign.split(".")[0] in AROUND_ALL and not marked and 2 * node.raw > every
        if not around and not (marked and 2 * node.marked >= marked):
            return
        node.kind = ""
    for x in node.items:
        _keep_around(x, every, marked)


def places(signs: list[str]) -> list[tuple[str, int]]:
    """Sign and occurrence of each of a parent's tokens; neighbours that repeat, alone or
    in groups of two or three, have the occurrence of the first."""
    out: list[tuple[str, int]] = []
    seen: Counter[str] = Counter()
    i = 0
    while i < len(signs):
        for size in (1, 2, 3):
            unit, end = signs[i : i + size], i + size
            while signs[end : end + size] == unit:
                end += size
            if end > i + size:
                break
        else:
            size, end = 1, i + 1
        group = []
        for sign in signs[i : i + size]:
            group.append((sign, seen[sign]))
            seen[sign] += 1
        out += group * ((end - i) // size)
        i = end
    return out


ROOT = 0


def place_hash(parent: int, sign: str, occurrence: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{parent} {sign} {occurrence}".encode("utf-8", "surrogatepass")) >> 1


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _running(node: Node) -> int:
    """Characters outside links and furniture."""
    if node.kind == "x":
        return 0
    return node.chars - node.links + sum(_running(x) for x in node.items)


def _marked(node: Node, kind: str) -> int:
    """Running characters in elements of a kind."""
    if node.kind == "x":
        return 0
    return _running(node) if node.kind == kind else sum(_marked(x, kind) for x in node.items)


def _mark(every: int, article: int, named: int) -> str:
    """How a host marks its content: by a "c" element, an "n" one, or not."""
    if article:
        return "c"
    return "n" if named and 2 * named >= every else ""


def _texts(node: Node) -> Iterator[str]:
    if node.text:
        yield node.text
    for x in node.items:
        yield from _texts(x)


class Wrapper:
    """The wrapper of some pages of a host.

    tokens: by place [parent, sign, occurrence, pages, repeated, least and greatest hash
    of the text, characters, of these in links]. Adding pages in any order, or adding up
    wrappers, gives the same.
    """

    def __init__(self):
        self.tokens: dict[int, list] = {}
        self.pages = self.every = self.article = self.named = 0
        self.different: set[int] = set()

    def add(self, page: str) -> None:
        tree = parse(page)
        self.pages += 1
        self.every += _running(tree)
        self.article += _marked(tree, "c")
        self.named += _marked(tree, "n")
        self.different.add(text_hash("\n".join(_texts(tree))))
        met: dict[int, int] = {}
        self._align(tree, ROOT, met)
        for place, times in met.items():
            token = self.tokens[place]
            token[3] += 1
            token[4] = token[4] or times > 1

    def _align(self, node: Node, parent: int, met: dict[int, int]) -> None:
        tokens = self.tokens
        for x, (sign, occurrence) in zip(node.items, places([x.sign for x in node.items])):
            place = place_hash(parent, sign, occurrence)
            met[place] = met.get(place, 0) + 1
            token = tokens.get(place)
            if token is None:
                tokens[place] = token = [parent, sign, occurrence, 0, False, None, None, 0, 0]
            if x.text is not None:
                h = text_hash(x.text)
                token[5] = h if token[5] is None else min(token[5], h)
                token[6] = h if token[6] is None else max(token[6], h)
            token[7] += x.chars
            token[8] += x.links
            if x.items and x.kind != "x":  # nothing in furniture is kept, so nothing there is learned
                self._align(x, place, met)


SCHEMA = (
    "host string, what string, place long, parent long, sign string, occurrence int, pages long, repeated boolean, "
    "low long, high long, chars long, links long, every long, article long, named long"
)
ARROW = [
    ("host", pa.string()), ("what", pa.string()), ("place", pa.int64()), ("parent", pa.int64()), ("sign", pa.string()), ("occurrence", pa.int32()),
    ("pages", pa.int64()), ("repeated", pa.bool_()), ("low", pa.int64()), ("high", pa.int64()), ("chars", pa.int64()), ("links", pa.int64()),
    ("every", pa.int64()), ("article", pa.int64()), ("named", pa.int64()),
]
#: Tokens that a task holds before it hands its wrappers on.
HELD_TOKENS = 100_000


def _rows(found: dict[str, Wrapper]) -> pa.RecordBatch:
    rows: list[tuple] = []
    for host, w in found.items():
        rows.append((host, "host", ROOT, None, None, None, w.pages, None, None, None, None, None, w.every, w.article, w.named))
        rows += [(host, "page", h, *[None] * 12) for h in w.different]
        rows += [(host, "token", p, *token, None, None, None) for p, token in w.tokens.items()]
    return pa.record_batch([pa.array(c, k) for c, (_, k) in zip(zip(*rows), ARROW)], names=[n for n, _ in ARROW])


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, Wrapper] = {}
    held = 0
    for batch in batches:
        for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            wrapper = found.setdefault(host, Wrapper())
            held -= len(wrapper.tokens)
            wrapper.add(page)
            held += len(wrapper.tokens) + 1
            if held >= HELD_TOKENS:
                yield _rows(found)
                found, held = {}, 0
    if found:
        yield _rows(found)


HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: str = "url"):
    """The host of a URL in lower case; null and relative URLs share the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """The wrappers of all hosts, from all pages with html, a row for each token:
    (host, what, place, parent, sign, occurrence, pages, repeated, low, high, chars,
    links, ...). `what` is "token", "host" (its pages and characters) or "page" (a row
    for each different page, its hash as place)."""
    parts = pages.where("html is not null and html <> ''").select(host_of().alias("host"), "html").mapInArrow(_infer, SCHEMA)
    return parts.groupBy("host", "what", "place").agg(
        F.first("parent").alias("parent"), F.first("sign").alias("sign"), F.first("occurrence").alias("occurrence"),
        F.sum("pages").alias("pages"), F.bool_or("repeated").alias("repeated"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum("every").alias("every"), F.sum("article").alias("article"),
        F.sum("named").alias("named"),
    )


def expressions(wrappers: DataFrame) -> DataFrame:
    """(host, parent, place, token): each token of the wrappers as regular expression: `tag`, `+` where
    repeated, `?` where optional, "#" a slot, "=" a constant text."""
    pages = wrappers.where("what = 'host'").select("host", F.col("pages").alias("every_page"))
    above = wrappers.where("what = 'token'").select("host", F.col("place").alias("parent"), F.col("pages").alias("parent_pages"))
    tokens = wrappers.where("what = 'token'").join(pages, "host").join(above, ["host", "parent"], "left")
    text = F.when(F.col("sign") == "#", F.when(F.col("low") == F.col("high"), "=").otherwise("#")).otherwise(F.col("sign"))
    mark = F.concat(
        F.when(F.col("repeated"), "+").otherwise(""), F.when(F.col("pages") < F.coalesce("parent_pages", "every_page"), "?").otherwise("")
    )
    return tokens.select("host", "parent", "place", F.concat(text, mark).alias("token"))


def rules(wrappers: DataFrame) -> DataFrame:
    """(host, mark, constants, menus): what extraction needs of a host's wrapper. Constants
    (a text) and menus (repeated groups that are links) are on all pages of the
    host, so there are no more of them than its shortest page has tokens."""
    mark = F.when(F.col("article") > 0, "c").when((F.col("named") > 0) & (2 * F.col("named") >= F.col("every")), "n").otherwise("")
    hosts = wrappers.where("what = 'host'").select("host", mark.alias("mark"), F.col("pages").alias("all_pages"))
    different = wrappers.where("what = 'page'").groupBy("host").agg(F.count("*").alias("different"))
    known = hosts.join(different, "host")
    constant = (F.col("sign") == "#") & ~F.col("repeated") & (F.col("low") == F.col("high")) & (F.col("different") >= TEMPLATE_PAGES)
    menu = F.col("repeated") & (F.col("sign") != "#") & (F.col("text_chars") > 0) & (F.col("text_links") >= 0.8 * F.col("text_chars"))
    tokens = wrappers.where("what = 'token'")
    below = tokens.where("sign = '#'").groupBy("host", F.col("parent").alias("place")).agg(
        F.sum("chars").alias("text_chars"), F.sum("links").alias("text_links")
    )
    told = (
        tokens.join(below, ["host", "place"], "left")
        .join(known, "host")
        .where(F.col("pages") == F.col("all_pages"))
        .select("host", "place", "low", constant.alias("constant"), F.coalesce(menu, F.lit(False)).alias("menu"))
        .where("constant or menu")
        .groupBy("host")
        .agg(
            F.collect_list(F.when(F.col("constant"), F.struct("place", F.col("low").alias("text")))).alias("constants"),
            F.collect_list(F.when(F.col("menu"), F.col("place"))).alias("menus"),
        )
    )
    return known.join(told, "host", "left").select("host", "mark", "constants", "menus")


def extract(page: str | None, mark: str | None = None, constants: frozenset = frozenset(), menus: frozenset = frozenset()) -> str:
    """The main text of a page by its host's rules; without (mark None) by the page's own."""
    if not page:
        return ""
    tree = parse(page)
    if mark is None:
        mark = _mark(_running(tree), _marked(tree, "c"), _marked(tree, "n"))
    if mark and not _marked(tree, mark):  # a page may lack the element that its host has
        mark = ""
    blocks: list[str] = []

    def walk(node: Node, place: int, inside: bool, marked: bool, menu: bool) -> None:
        if node.kind == "x" or node.kind == "h" and not (inside and mark):
            return
        marked = marked or node.kind == "c"
        inside = inside or not mark or node.kind == mark
        known = (constants or menus) and not marked
        below = places([x.sign for x in node.items]) if known else ()
        for i, x in enumerate(node.items):
            at = place_hash(place, *below[i]) if known else ROOT
            if x.text is None:
                walk(x, at, inside, marked, known and at in menus)
            elif inside and not (known and (menu or (at, text_hash(x.text)) in constants)):
                blocks.append(x.text)

    walk(tree, ROOT, False, False, False)
    return "\n".join(blocks)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    loaded: dict[str, tuple[frozenset, frozenset]] = {}
    for batch in batches:
        texts = []
        columns = (batch.column(c) for c in ("html", "host", "mark", "constants", "menus"))
        for page, host, mark, constants, menus in zip(*columns):
            host = host.as_py()
            if host not in loaded:
                if len(loaded) > 5000:
                    loaded.clear()
                loaded[host] = frozenset((c["place"], c["text"]) for c in constants.as_py() or ()), frozenset(menus.as_py() or ())
            texts.append(extract(page.as_py(), mark.as_py(), *loaded[host]))
        yield pa.record_batch(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of `pages` (page_id, url, html).

    Null and empty html have the empty text. A null or relative url belongs to the
    empty host. Repeated rows come out each, and count once as evidence for a constant;
    other columns are not read. In a marked article only adverts, forms, notices, menus
    and comments go, so a text that all its pages share stays; elsewhere a text counts as
    template from TEMPLATE_PAGES different pages on. Pages of any depth, length or number
    of siblings take linear time.
    """
    wrappers = materialize(infer_wrappers(pages), "wrappers")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", host_of().alias("host"))
    return rows.join(rules(wrappers), "host", "left").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
