"""Main text of web pages: template subtrees of a site are counted in Spark and removed.

Every element subtree of a page has a hash of its tags, classes and text. Spark counts, for
each host, on how many pages a subtree stands; one that recurs across many pages of its host
is template and is deleted, with the elements that are no article by their tag or class.
What is left of the article (of the page, where none is marked) is the text.

Pages whose text is the same before templates go count as one page, so a page or an article
that a site shows under many addresses stays whole. Subtrees that recur on pages of different
text go inside marked articles too, a heading only with what it heads; but not where they are
nearly all of an article, which is then one that the site shows again under another title or date.
Pages without an address have no site, and so no templates.
"""

from __future__ import annotations

import dataclasses
import html as entities
import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topictide.llm.store import saved
from topictide.llm.texts import per_text

#: A subtree is template on this share of a host's pages, and on this many at least. The
#: share bounds the templates of a host to 1 / share times the subtrees of a page.
SHARE, LEAST_PAGES = 0.05, 5
#: Templates that leave less than one part in so many of a marked article are the article.
MOST = 5
#: The templates of all hosts are broadcast up to these many hosts and hashes (8 bytes each).
BROADCAST_HOSTS, BROADCAST_HASHES = 20_000, 1_000_000

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:"[^"]*"|'[^']*'|[^>"'])*|[^>]*)(?:>|\Z)""",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
SPACE = re.compile(r"\s+")
LAYOUT = re.compile(r"(?:with|without|no|not|has|have)[^a-z0-9]")
#: Inside a marked article, words that name no part beside these leave a dropped word its meaning.
GENERIC_WORDS = frozenset(
    "box block section list area container wrapper wrap inner outer top bottom left right middle slot unit item items content "
    "bar row col column site page main primary secondary global inline small large mobile desktop sticky fixed js article post "
    "story blog news email user users reader readers thread button buttons icons links link panel".split()
)
#: An id alone drops a part of a marked article only by one of these.
ID_WORDS = frozenset("nav navbar navigation sidebar ad ads advert advertisement cookie cookies consent comment comments respond disqus".split())
#: Stands among the words of an element for the attributes that hide it.
UNSEEN = "@hidden"

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Elements that are no article text by their tag, or by a word of their class, id or role.
DROPPED = frozenset(
    "head script style noscript template nav footer aside form button select option textarea input label iframe object embed "
    "svg canvas audio video map menu dialog title link meta".split()
)
DROPPED_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead banner footer sidebar aside complementary "
    "contentinfo notice alert cookie cookies consent ad ads advert advertisement advertising sponsor sponsored promo promotion "
    "form search login signup subscribe newsletter share sharing social related comment comments reply replies respond disqus "
    "popup modal pagination pager toolbar widget".split()
)
#: A start tag in the value's set closes an open element of the key.
CLOSED_BY = {
    "p": BLOCKS - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"},
    "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "head": {"body", "article", "main", "div", "p", "nav", "header", "section", "h1"},
}
#: The other way round: what a start tag can close.
CLOSES = {tag: [key for key, tags in CLOSED_BY.items() if tag in tags] for tag in frozenset().union(*CLOSED_BY.values())}
#: An implied end does not reach beyond these.
SCOPES = frozenset("html body table td th ul ol dl div section article main aside nav header footer form blockquote".split())


@dataclasses.dataclass(slots=True)
class Element:
    tag: str
    words: frozenset
    named: bool  # by a whole class, role or id token of dropped and generic words
    start: int  # of its events
    end: int = 0
    digest: int = 0
    chars: int = 0
    linked: int = 0
    parts: list = dataclasses.field(default_factory=list)


def _words(attrs: str) -> tuple[frozenset, bool]:
    """Words of class, id and role, and whether a whole token of them names a dropped part."""
    if "=" not in attrs and "hidden" not in attrs:
        return frozenset(), False
    found, named = set(), False
    for name, value in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            found.add(UNSEEN)
        elif name in ("class", "id", "role"):
            for token in value.split():
                # what a layout goes with or without does not name the element itself
                parts = [token] if LAYOUT.match(token) else re.split(r"[^a-z0-9]+", token)
                found.update(parts)
                said = {part for part in parts if part and not part.isdigit()}
                known = ID_WORDS if name == "id" else DROPPED_WORDS
                named = named or not known.isdisjoint(said) and said <= DROPPED_WORDS | GENERIC_WORDS
    return frozenset(found - {""}), named


def parse(html: str) -> tuple[list, list[Element]]:
    """Events in page order (text, or an element at its start and again at its end), and elements.

    The order is that of a browser for the cases that matter to text: void and raw elements,
    optional end tags, stray and missing end tags, a page that breaks off.
    """
    events: list = []
    elements: list[Element] = []
    stack: list[Element] = []
    opened_tags: dict[str, int] = {}

    def text(raw: str) -> None:
        if raw:
            value = entities.unescape(raw) if "&" in raw else raw
            events.append(value)
            if stack and (plain := SPACE.sub(" ", value).strip()):
                top = stack[-1]
                top.parts.append(plain)
                top.chars += len(plain)
                if top.tag == "a":
                    top.linked += len(plain)

    def close() -> None:
        node = stack.pop()
        opened_tags[node.tag] -= 1
        node.end = len(events)
        events.append(node)
        key = "\x00".join((node.tag, *sorted(node.words), *node.parts))
        node.digest = xxhash.xxh3_64_intdigest(key.encode("utf-8", "surrogatepass")) - (1 << 63)
        node.parts = []
        if node.tag == "a":
            node.linked = node.chars
        if stack:
            up = stack[-1]
            up.parts.append(f"\x01{node.digest}")
            up.chars += node.chars
            up.linked += node.linked

    at, size = 0, len(html)
    while at < size:
        token = TOKEN.search(html, at)
        if token is None:
            text(html[at:])
            break
        text(html[at : token.start()])
        at = token.end()
        if token["tag"] is None:
            if token[0].startswith("<![CDATA["):
                text(token[0][9:].removesuffix("]]>"))
            continue
        tag = token["tag"].lower()
        if token["end"]:
            for depth in range(len(stack) - 1, -1, -1) if opened_tags.get(tag) else ():
                if stack[depth].tag == tag:
                    while len(stack) > depth:
                        close()
                    break
            continue
        for depth in range(len(stack) - 1, -1, -1) if any(map(opened_tags.get, CLOSES.get(tag, ()))) else ():
            opened = stack[depth].tag
            if tag in CLOSED_BY.get(opened, ()):
                while len(stack) > depth:
                    close()
            elif opened in SCOPES:
                break
        node = Element(tag, *_words(token["attrs"]), len(events))
        elements.append(node)
        events.append(node)
        stack.append(node)
        opened_tags[tag] = opened_tags.get(tag, 0) + 1
        if tag in VOID or token["attrs"].endswith("/") and tag not in BLOCKS:
            close()
        elif tag in RAW:
            ending = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
            at = ending.end() if ending else size
            close()
    while stack:
        close()
    return events, elements


def _unseen(node: Element) -> bool:
    return node.tag in DROPPED or UNSEEN in node.words


def _dropped(node: Element) -> bool:
    return _unseen(node) or "hidden" in node.words or not DROPPED_WORDS.isdisjoint(node.words)


def _outermost(elements: list[Element], wanted: str, dropped) -> list[Element]:
    """Outermost articles or main parts that are not in dropped elements."""
    found, done = [], -1
    for node in elements:
        if node.start > done and node.tag not in ("html", "body"):
            if dropped(node) and node.tag != "head":
                done = node.end
            elif node.tag == wanted or wanted == "main" and "main" in node.words:
                found.append(node)
                done = node.end
    return found


def _around_largest(elements: list[Element], wanted: str) -> list[Element]:
    """Marked parts of a page that has them only in elements with a dropped word.

    Words drop no element around the largest part; the others go by them.
    """
    parts = _outermost(elements, wanted, _unseen)
    parts = [p for p in parts if not _dropped(p)] or parts
    if not parts:
        return []
    largest = max(parts, key=lambda p: p.chars)
    around = {e.start for e in elements if e.start <= largest.start and e.end >= largest.end}
    return _outermost(elements, wanted, lambda e: _dropped(e) and e.start not in around)


def _own_chars(elements: list[Element], root: Element) -> int:
    """Characters of a part outside its dropped elements."""
    total, done = root.chars, root.start
    for node in elements:
        if done < node.start < root.end and _dropped(node):
            total, done = total - node.chars, node.end
    return total


def _roots(elements: list[Element]) -> list[Element]:
    """Outermost marked articles, or else main parts, that are not in dropped elements.

    Where all articles are in elements with a dropped word, the largest counts, unless a main
    part has as much text outside such elements (then they are its comments or teasers).
    """
    if found := _outermost(elements, "article", _dropped):
        return found
    wrapped, main = _around_largest(elements, "article"), _outermost(elements, "main", _dropped)
    if main and wrapped:
        return main if sum(_own_chars(elements, m) for m in main) >= max(w.chars for w in wrapped) else wrapped
    return wrapped or main or _around_largest(elements, "main")


def main_text(html: str, templates: frozenset = frozenset()) -> str:
    """Blocks of the main text, joined by line feeds."""
    events, elements = parse(html)
    text = _rendered(events, elements, templates)
    if templates and _roots(elements):
        whole = _rendered(events, elements)
        # a part that stands twice in an article is none of it, so blocks count once
        if MOST * len(text) < len("\n".join(dict.fromkeys(whole.split("\n")))):
            return whole
    return text


def _dropped_inside(node: Element, templates: frozenset) -> bool:
    """Whether a part of a marked article is none of it.

    A word of its class or id says so only where it names the whole part, or where the part
    recurs on the site or is mostly links: an article may have a section on search or menus.
    """
    if _unseen(node) or "hidden" in node.words or node.named:
        return True
    return _dropped(node) and (node.digest in templates or 2 * node.linked > node.chars)


def _heads_nothing(events: list, heading: Element, last: int, templates: frozenset) -> bool:
    """Whether what follows a heading in its article goes as well."""
    for event in events[heading.end + 1 : last]:
        if isinstance(event, str):
            if event.strip():
                return False
        elif event.start > heading.end and event.chars:
            if event.tag not in HEADINGS:
                return event.digest in templates or _dropped_inside(event, templates)
            if event.tag <= heading.tag:  # h2 ends what h3 heads; a deeper one does not
                return True
    return False


def _rendered(events: list, elements: list[Element], templates: frozenset = frozenset()) -> str:
    roots = _roots(elements)
    marked = bool(roots)
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if block := SPACE.sub(" ", "".join(line)).strip():
            blocks.append(block)
        line.clear()

    for first, last in [(r.start, r.end) for r in roots] or [(0, len(events))]:
        at, header_end, headings = first, -1, 0
        while at < last:
            event = events[at]
            if isinstance(event, str):
                if at > header_end or headings:  # an article's own header counts for its headings
                    line.append(event)
                at += 1
                continue
            opening = event.start == at
            if event.tag in BLOCKS:
                flush()
            elif event.tag == "br":
                line.append(" ")
            if opening and at != first:
                removable = event.tag not in ("html", "body") and event.digest in templates
                if removable and marked and event.tag in HEADINGS:
                    removable = _heads_nothing(events, event, last, templates)
                skipped = _dropped_inside(event, templates) if marked else _dropped(event) or event.tag == "header"
                if skipped and event.tag != "body" or removable:
                    at = event.end + 1
                    continue
                if event.tag == "header":
                    header_end = max(header_end, event.end)
            if event.tag in HEADINGS:
                headings += 1 if opening else -1
            at += 1
        flush()
    return "\n".join(blocks)


def page_hashes(html: str) -> tuple[int, list[int]]:
    """A hash of the page's text with its templates, and those of its block subtrees with text."""
    events, elements = parse(html)
    content = xxhash.xxh3_64_intdigest(_rendered(events, elements).encode("utf-8", "surrogatepass")) - (1 << 63)
    return content, list({e.digest for e in elements if e.chars and e.tag in BLOCKS and e.tag not in ("html", "body")})


def host_of(url):
    """Host of an address, lower case and without port; empty if there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def site_templates(pages: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """One row per host with template subtrees: host and their hashes. Pages are told apart by text."""
    hashes = per_text(page_hashes, "content long, h array<long>")
    sites = pages.select(host_of(F.col("url")).alias("host"), "html").where(F.col("host") != "")
    listed = sites.select("host", hashes(F.col("html")).alias("p")).select("host", "p.*")
    found = listed.select("host", "content", F.explode(F.concat(F.col("h"), F.array(F.lit(None).cast("long")))).alias("hash")).distinct()
    counts = found.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n"))  # the null hash counts the pages
    counts = saved(counts.where((F.col("n") >= least_pages) | F.col("hash").isNull()))
    totals = counts.where(F.col("hash").isNull()).select("host", F.col("n").alias("pages"))
    recurring = counts.where(F.col("hash").isNotNull()).join(totals, "host").where(F.col("n") >= share * F.col("pages"))
    return recurring.groupBy("host").agg(F.collect_list("hash").alias("templates"))


def extract_main_text(pages: DataFrame, share: float = SHARE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars``, without ``html``.

    A null or empty html has an empty text; a page with a null or odd address has no templates.
    Repeated rows and other pages of equal text count as one page. An empty table
    gives no rows. Columns named ``text`` or ``n_chars`` are replaced.
    """
    templates = saved(site_templates(pages, share, least_pages))
    hosts, hashes = templates.agg(F.count(F.lit(1)), F.sum(F.size("templates"))).first()
    if hosts <= BROADCAST_HOSTS and (hashes or 0) <= BROADCAST_HASHES:
        templates = F.broadcast(templates)
    pages = pages.drop("text", "n_chars")
    mark = next("_" * i for i in range(1, len(pages.columns) + 9) if not any(n.startswith("_" * i) for n in pages.columns))
    key, host, listed = mark + "key", mark + "host", mark + "templates"
    templates = templates.select(F.col("host").alias(host), F.col("templates").alias(listed))
    joined = pages.withColumn(key, host_of(F.col("url"))).join(templates, F.col(key) == F.col(host), "left")
    out = joined.withColumn("text", _text_column()(F.col("html"), F.col(listed)))
    return out.withColumn("n_chars", F.length("text").cast("long")).drop(key, host, listed, "html")


def _text_column():
    import pyarrow as pa

    def batch(html: pa.Array, templates: pa.Array) -> pa.Array:
        sets, out = {b"": frozenset()}, []
        for page, row in zip(html.to_pylist(), templates, strict=True):
            values = row.values
            key = b"" if values is None else values.to_numpy(zero_copy_only=False).tobytes()
            if key not in sets:
                sets[key] = frozenset(values.to_pylist())
            out.append(main_text(page or "", sets[key]))
        return pa.array(out, pa.string())

    batch.__annotations__ = {"html": pa.Array, "templates": pa.Array, "return": pa.Array}
    return F.arrow_udf(batch, "string")
