"""The main text of web pages, found with a site style tree.

The element trees of all pages of a host are merged by the path of their tags, classes and ids. Every
node of the merged tree gets two importances from the pages it occurs on: of
its presentation, the entropy of the sequences of children it has, and of its content,
the entropy of the texts below it. Both are 1 where every page differs and 0 where all
are alike. A branch of low importance is the same all over the site, such as a banner or a notice, and
is removed from each page. Copies of a page count as one page. What is alike on n different pages goes if it
is at most 1 - 1/n of the page's text, so that two pages with one story do not lose it. A host of one
page has nothing to compare; there only the priors act.

Entropy alone cannot tell menus, adverts and footers whose text changes from page to page
from an article. Elements and roles that say what they are therefore have a fixed prior: such
branches always go. A class or id that does so removes a branch that is also alike all over the site,
mostly links or a small part of the page's text; articles and what holds them stay. Headings, paragraphs, lists
and the like inside an article element stay whatever their entropy, for copies of one article on a host would
otherwise remove each other. Entropy decides on all the rest.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
TEXT_BLOCKS = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote figure figcaption table thead tbody tfoot tr td th caption".split()
)
# A start tag closes open elements of these names, and, unless it is inline, paragraphs, up to a container.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th"},
    "thead": {"tbody", "thead", "tfoot", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th"},
    "option": {"option"},
}
CLOSES = {tag: frozenset(ends) | {"p"} for tag, ends in CLOSES.items()}
P_CLOSED, NOTHING_CLOSED = frozenset({"p"}), frozenset()
SCOPES = frozenset("html body div section article main aside nav header footer form ul ol dl table td th blockquote".split())

# Priors: what names itself as something other than the article.
DROPPED = frozenset(
    "head nav footer aside form button select menu dialog object applet canvas audio video script style noscript iframe "
    "template svg math textarea title fieldset".split()
)
DROPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar "
    "navigation navi breadcrumb breadcrumbs sidebar side aside footer foot header masthead topbar toolbar cookie cookies "
    "consent gdpr notice notices notification alert popup modal overlay comment comments commentlist disqus reply replies "
    "respond share sharing social related recommended newsletter subscribe subscription widget pagination pager login "
    "signup search skip".split()
)
# Those that may as well name a part of an article.
WEAK_WORDS = frozenset(
    "related side header notice notices notification alert search share sharing social reply replies respond recommended "
    "promotion overlay banner widget skip".split()
)
# What readers write is never part of the article, however long it is; paragraphs, headings and the like of an article may be about it.
COMMENT_WORDS = frozenset("comment comments commentlist disqus".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption".split())
# Names of page parts; inside an article they remove what is mostly links or alike on the site.
FRAME_WORDS = frozenset(
    "menu nav navbar navigation navi breadcrumb breadcrumbs sidebar aside footer foot masthead topbar toolbar pagination pager".split()
)
# What turns a class word into its opposite, as in has-sidebar.
NEGATED = re.compile(r"(?<![a-z])(?:no|not|non|has|with|without)[-_\s]+[a-z]+")
NO_WORD, WEAK, FRAME, STRONG, COMMENT = range(5)
# Shares of a page's text: a class word alone removes branches of at most a half in all, a weak one of a quarter
# each, and links a branch of up to nine tenths of which they are a half.
MOST_NAMED, MOST_WEAK, MOST_LINKS, LEAST_LINKS = 0.5, 0.25, 0.9, 0.5
DROPPED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split()
)
MAIN_ROLES = frozenset({"main", "article"})
BODY_WORDS = frozenset({"articlebody"})

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+[^>]*+)>?",
    re.DOTALL,
)
# Attributes one after the other, so that no name is found inside a value or another name.
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[a-z]+")
MASK = (1 << 64) - 1


@lru_cache(1 << 14)
def traits(tag: str, attributes: str) -> tuple[str, bool, bool, int]:
    """The label of an element in the style tree, whether it goes by its name, whether it is the article, its class word."""
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes):
        # The first of several attributes of a name counts.
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    named = " ".join([found.get("class", ""), found.get("id", "")])
    named = re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()
    words = set(WORD.findall(named))
    role = found.get("role", "").lower()
    label = f"{tag}.{' '.join(sorted(words))}.{role}"
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    main = tag in ("article", "main") or role in MAIN_ROLES or found.get("itemprop", "").lower() in BODY_WORDS
    whole_page = tag in ("html", "body")
    dropped = tag in DROPPED or (not whole_page and (hidden or role in DROPPED_ROLES))
    meant = set(WORD.findall(NEGATED.sub(" ", named))) & DROPPED_WORDS
    if whole_page or main or not meant:
        word = NO_WORD
    elif meant & COMMENT_WORDS:
        word = COMMENT
    else:
        word = WEAK if meant <= WEAK_WORDS else FRAME if meant <= WEAK_WORDS | FRAME_WORDS else STRONG
    return label, dropped, main and not dropped, word


@dataclass
class Page:
    """The block elements of a page in order, and its pieces of text."""

    parent: list[int] = field(default_factory=list)
    path: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    dropped: list[bool] = field(default_factory=list)
    main: list[bool] = field(default_factory=list)
    own_main: list[bool] = field(default_factory=list)
    word: list[int] = field(default_factory=list)
    # Characters directly in the node, and those of them in links.
    chars: list[int] = field(default_factory=list)
    links: list[int] = field(default_factory=list)
    # (node, text); a None text is the end of a block or line.
    pieces: list[tuple[int, str | None]] = field(default_factory=list)


def parse(source: str) -> Page:
    """Read a page of any quality; nothing in it is an error. The time grows with its length, however deep its elements lie."""
    page = Page()
    open_tags: list[str] = []
    open_nodes: list[int] = []
    # The depths at which each tag is open, and those of containers, ascending; the root, at depth 0, is in neither.
    places: dict[str, list[int]] = {}
    scopes: list[int] = []
    links = 0

    def enter(tag: str, attributes: str) -> None:
        nonlocal links
        label, dropped, main, word = traits(tag, attributes)
        up = open_nodes[-1] if open_nodes else -1
        links += tag == "a"
        if open_tags:
            places.setdefault(tag, []).append(len(open_tags))
            if tag in SCOPES:
                scopes.append(len(open_tags))
        if tag in INLINE and not dropped and not word:
            open_tags.append(tag)
            open_nodes.append(up)
            return
        above = page.path[up] if up >= 0 else 0
        page.parent.append(up)
        page.path.append(xxhash.xxh3_64_intdigest(label, seed=above))
        page.tag.append(tag)
        # A header inside an article holds its title.
        gone = dropped or (tag == "header" and not (up >= 0 and page.main[up]))
        page.dropped.append(gone or (up >= 0 and page.dropped[up]))
        page.main.append(main or (up >= 0 and page.main[up]))
        page.own_main.append(main)
        page.word.append(word)
        page.chars.append(0)
        page.links.append(0)
        open_tags.append(tag)
        open_nodes.append(len(page.parent) - 1)
        if tag not in INLINE:
            page.pieces.append((up, None))

    def say(text: str) -> None:
        node, size = open_nodes[-1], len(text.strip())
        page.pieces.append((node, text))
        page.chars[node] += size
        page.links[node] += size if links else 0

    def leave(depth: int) -> None:
        nonlocal links
        while len(open_tags) > depth:
            tag = open_tags.pop()
            node = open_nodes.pop()
            links -= tag == "a"
            if open_tags:
                places[tag].pop()
                if tag in SCOPES:
                    scopes.pop()
            if tag not in INLINE:
                page.pieces.append((node, None))

    enter("html", "")
    at = 0
    while at < len(source):
        token = TOKEN.search(source, at)
        end = token.start() if token else len(source)
        if end > at:
            say(source[at:end])
        if not token:
            break
        at = token.end()
        if token[1]:
            tag = token[1].lower()
            if tag in ("html", "body"):
                continue
            own = places.get(tag)
            # The end of an inline element does not reach out of the container it stands in.
            if own and not (tag in INLINE and scopes and scopes[-1] > own[-1]):
                leave(own[-1])
        elif token[2]:
            tag, attributes = token[2].lower(), token[3].strip()
            if tag == "html":
                continue
            if tag in RAW:
                if attributes.endswith("/") and tag in ("svg", "math"):
                    continue
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                at = close.end() if close else len(source)
                continue
            if tag in VOID:
                if tag in ("br", "hr"):
                    page.pieces.append((open_nodes[-1], None))
                continue
            if tag == "body" or (tag not in INLINE and tag != "head"):
                if places.get("head"):
                    leave(places["head"][0])
            ends = CLOSES.get(tag, NOTHING_CLOSED if tag in INLINE else P_CLOSED)
            if ends:
                # The outermost of the elements that end here, up to the nearest container that does not.
                if ends.isdisjoint(SCOPES):
                    wall = scopes[-1] if scopes else 0
                else:
                    wall = max((places[s][-1] for s in SCOPES if s not in ends and places.get(s)), default=0)
                inside = [own[i] for e in ends if (own := places.get(e)) and (i := bisect_right(own, wall)) < len(own)]
                if inside:
                    leave(min(inside))
            enter(tag, attributes)
        elif token[0] == "<":
            say("<")
    return page


def named_branches(page: Page, low: Mapping[int, int] | frozenset[int]) -> set[int]:
    """The nodes that go by a word of their class or id and by what they hold.

    They are in `low`, or mostly links, or a small part of the page's text; readers' comments go at any length. An article
    stays, and what holds it; in an article paragraphs and the like, and what is named as a frame or by a weak
    word, go for links or in `low` only, inline elements of paragraphs in `low` only.
    """
    n = len(page.parent)
    if not any(page.word):
        return set()
    chars = [0 if page.dropped[i] else page.chars[i] for i in range(n)]
    links = [0 if page.dropped[i] else page.links[i] for i in range(n)]
    holds = [page.own_main[i] and not page.dropped[i] for i in range(n)]
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        if up >= 0:
            chars[up] += chars[i]
            links[up] += links[i]
            holds[up] = holds[up] or holds[i]
    total = chars[0]
    found, small = set(), set()
    for i in range(n):
        up = page.parent[i]
        inside = up >= 0 and page.main[up]
        if not page.word[i] or page.dropped[i] or (holds[i] and not inside):
            continue
        if page.path[i] in low:
            found.add(i)
        elif page.word[i] == COMMENT and not (inside and (page.tag[i] in LEAVES or page.tag[i] in INLINE)):
            found.add(i)
        elif inside and page.tag[i] in INLINE and page.tag[up] in TEXT_BLOCKS:
            continue
        elif links[i] and links[i] >= LEAST_LINKS * chars[i] and chars[i] <= MOST_LINKS * total:
            found.add(i)
        elif inside and (page.tag[i] in TEXT_BLOCKS or page.word[i] in (WEAK, FRAME)):
            continue
        elif chars[i] <= (MOST_WEAK if page.word[i] == WEAK else MOST_NAMED) * total:
            small.add(i)
    # Together, each branch once.
    under = [False] * n
    together = 0
    for i in range(n):
        above = page.parent[i] >= 0 and under[page.parent[i]]
        under[i] = above or i in small
        together += chars[i] if i in small and not above else 0
    return found | small if together <= MOST_NAMED * total else found


def alike_branches(page: Page, low: Mapping[int, int]) -> set[int]:
    """The paths of `low`, which names their numbers of pages, that hold a share of the page's text they may take."""
    n = len(page.parent)
    chars = [0 if page.dropped[i] else page.chars[i] for i in range(n)]
    for i in range(n - 1, 0, -1):
        if page.parent[i] >= 0:
            chars[page.parent[i]] += chars[i]
    by_path = dict.fromkeys(low, 0)
    for i in range(n):
        if page.path[i] in by_path:
            by_path[page.path[i]] += chars[i]
    return {path for path, size in by_path.items() if size * low[path] <= chars[0] * (low[path] - 1)}


def main_text(page: Page, low: Mapping[int, int] | frozenset[int], words: bool = True) -> str:
    """The text of a page without dropped branches, without the nodes in `low` and, with `words`, those named by a class.

    `low` has the paths of low importance and on how many pages they are.
    """
    n = len(page.parent)
    low = alike_branches(page, low) if isinstance(low, Mapping) else low
    named = named_branches(page, low) if words else set()
    gone = list(page.dropped)
    for i in range(n):
        up = page.parent[i]
        inside = up >= 0 and page.main[up]
        if page.path[i] in low and not (page.main[i] and (not inside or page.tag[i] in TEXT_BLOCKS)):
            gone[i] = True
        # An article stays in a branch that is alike on all pages.
        if up >= 0 and gone[up] and (inside or not page.main[i]):
            gone[i] = True
        if i in named:
            gone[i] = True
    only = any(page.main[i] and not gone[i] for i in range(n))
    kept = [
        " " if text is None else html.unescape(text)
        for node, text in page.pieces
        if text is None or not gone[node] and (page.main[node] or not only)
    ]
    text = " ".join("".join(kept).split())
    if text or not (low or named):
        return text
    # A page of nothing but such branches is a copy of other pages, not their frame.
    return main_text(page, low, words=False) if named else main_text(page, frozenset())


def node_facts(page: Page) -> dict[int, tuple[int, int]]:
    """Per path of the style tree a hash of the children's sequence and one of the text below."""
    n = len(page.parent)
    text, style = [0] * n, [0] * n
    for node, piece in page.pieces:
        if piece:
            for word in (piece.strip(),):
                if word:
                    text[node] = (text[node] * 31 + xxhash.xxh3_64_intdigest(word)) & MASK
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        if up >= 0:
            text[up] = (text[up] * 37 + text[i] + 1) & MASK
            style[up] = (style[up] * 41 + page.path[i]) & MASK
    facts: dict[int, tuple[int, int]] = {}
    for i in range(n):
        s, t = facts.get(page.path[i], (0, 0))
        facts[page.path[i]] = ((s * 43 + style[i] + 1) & MASK, (t * 43 + text[i] + 1) & MASK)
    return facts


def host(url: str) -> Column:
    """The host of an address in lower case; empty if there is none."""
    found = F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.coalesce(F.lower(found), F.lit(""))


def _signed(x: int) -> int:
    return x - (1 << 63)


ROOT = _signed(parse("").path[0])


def page_nodes(pages: DataFrame) -> DataFrame:
    """host, page_key, node, style and content of each page's distinct paths."""
    schema = pa.schema([("host", pa.string()), *((n, pa.int64()) for n in ("page_key", "node", "style", "content"))])

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for site, key, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for path, (style, text) in node_facts(parse(source)).items():
                    rows.append((site, key, _signed(path), _signed(style), _signed(text)))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = "host string, page_key long, node long, style long, content long"
    return pages.select("host", "page_key", "source").mapInArrow(nodes, ddl)


def style_tree(nodes: DataFrame) -> DataFrame:
    """host, node, pages, presentation and content importance of every node of the hosts' style trees.

    The importance is the entropy over the different pages of the node to the base of their number; a node on one
    page has importance 1. Copies of a page, alike in page_key, count as one. Counts are combined before the shuffle, hosts are not collected.
    """

    # Every page has one root, so its rows count the copies, which weigh one page together.
    copies = nodes.where(F.col("node") == ROOT).groupBy("page_key").agg(F.count("*").alias("copies")).where("copies > 1")
    copies = stored(copies, "page-copies")
    weighed = nodes.join(copies, "page_key", "left").withColumn("weight", 1 / F.coalesce("copies", F.lit(1)))

    def entropy(kind: str) -> DataFrame:
        # The sum of the parts of a page is a whole number but for rounding.
        each = weighed.groupBy("host", "node", kind).agg(F.round(F.sum("weight")).alias("n"))
        both = each.groupBy("host", "node").agg(
            F.sum("n").cast("long").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("n_log_n")
        )
        value = 1 - F.col("n_log_n") / (F.col("pages") * F.log("pages"))
        return both.select("host", "node", "pages", F.when(F.col("pages") < 2, 1.0).otherwise(value).alias(kind))

    return entropy("style").join(entropy("content").drop("pages"), ["host", "node"]).select(
        "host", "node", "pages", F.col("style").alias("presentation"), F.col("content").alias("content")
    )


def extract_text(
    pages: DataFrame, id_column: str = "page_id", url: str = "url", source: str = "html",
    least_importance: float = 0.2, least_pages: int = 2,
) -> DataFrame:
    """page_id, url and the main text of every page, with white space collapsed.

    Branches whose presentation and content importance both lie below `least_importance` go, if the node occurs
    on `least_pages` different pages of the host at least and is no more than `alike_branches` allows of the page's text. A page with an article or main element
    gives the text inside, another page all that is left of its body. Null and empty pages have an empty text;
    a null address belongs to the host ''. Repeated rows are pages of their own.
    """
    page = F.coalesce(F.col(source).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("url"), host(url).alias("host"), page.alias("source"))
    rows = rows.withColumn("page_key", F.xxhash64("host", "source"))
    nodes = stored(page_nodes(rows), "page-nodes")
    low = style_tree(nodes).where(
        (F.col("pages") >= least_pages)
        & (F.col("presentation") < least_importance)
        & (F.col("content") < least_importance)
    )
    # Written down, so that Spark knows the size and sends a small table to all tasks, a large one by shuffle.
    lists = nodes.join(low.select("host", "node", "pages"), ["host", "node"])
    lists = lists.groupBy("page_key").agg(F.collect_set(F.struct("node", "pages")).alias("low"))
    lists = stored(lists, "low-nodes")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for page, low in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                found.append(main_text(parse(page), {x["node"] + (1 << 63): x["pages"] for x in low or ()}))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.string())], names=["page_id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    joined = rows.join(lists, "page_key", "left").select("page_id", "url", "source", "low")
    return joined.mapInArrow(texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
