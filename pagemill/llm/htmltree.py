"""One page as a row of tokens: opened elements and blocks of text, each with its place in the tree of elements."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import xxhash

#: A comment, a declaration, a tag (quoted attribute values may hold '>'), or a tag that the end of the page cuts off.
_MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Element names of HTML by how they are parsed.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title textarea xmp iframe noembed noframes noscript template svg math canvas object select datalist button audio video map".split())
HEAD_ONLY = frozenset("meta link title script style base noscript template".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption address details summary hr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: An element closes others of its own kind only up to one of these.
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
# Names by which pages mark what is not the article.
OUT_TAGS = frozenset("nav aside footer menu dialog".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar comment comments "
    "respond replies discussion disqus share sharing social related recommended recommendations trending newsletter subscribe subscription signup login cookie cookies consent gdpr notice notices notification popup modal overlay widget widgets pagination pager search copyright disclaimer paywall skiplink".split()
)
OUT_PARTS = re.compile("sidebar|footer|comment|newsletter|cookie|advert|breadcrumb|navbar|sponsor")
#: Words that say that an element holds the article beside what the words above name ("content with-sidebar").
WHOLE_WORDS = frozenset("content main article with has no without wrapper layout container page".split())
MAIN_ROLES = frozenset(("main", "article"))


@dataclass(eq=False)
class Node:
    """An element's place: equal paths of labels share one. out: 1 within a form, 2 within what is not the article; main: 1 within main, 2 within an article."""

    parent: Node | None
    tag: str
    code: int
    out: int = 0
    main: int = 0
    leaf: bool = False
    depth: int = 0
    below: dict[str, Node] = field(default_factory=dict)


@dataclass
class Block:
    node: Node
    text: str
    linked: int
    code: int


def _marks(tag: str, attributes: str, parent: Node) -> tuple[str, int, int]:
    """The label of an element, and whether it or its parents are outside of the article or inside a marked one."""
    out, main, label = parent.out, parent.main, tag
    if attributes and not attributes.isspace():
        found = {k.lower(): unescape(v.strip("\"'")) for k, v in _ATTRIBUTE.findall(attributes)}
        # Numbers in an id and long ones in a class name one element, not a kind of element.
        names = f"{re.sub('[0-9]{3,}', '0', found.get('class', ''))} {re.sub('[0-9]+', '0', found.get('id', ''))}".strip()
        role = found.get("role", "").lower()
        label = f"{tag}.{names}" if names else tag
        words = {w.lower() for w in _WORD.findall(names)} if names else set()
        if role in OUT_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I):
            out = 2
        elif tag not in ("html", "body", "article", "main") and (words & OUT_WORDS or OUT_PARTS.search(names.lower())) and not words & WHOLE_WORDS:
            out = 2
        elif tag == "article" and words & {"comment", "comments", "teaser", "related", "promo", "ad", "advert"}:
            out = 2
        if role in MAIN_ROLES or found.get("itemprop", "").lower() == "articlebody":
            main = max(main, 1 if role == "main" else 2)
    if tag in OUT_TAGS or tag == "header" and main < 2:
        out = 2
    elif tag == "form":
        out = max(out, 1)
    elif tag == "article":
        main = 2
    elif tag == "main":
        main = max(main, 1)
    return label, out, main


def _child(parent: Node, tag: str, attributes: str) -> Node:
    key = tag + attributes
    found = parent.below.get(key)
    if found is None:
        label, out, main = _marks(tag, attributes, parent)
        same = parent.below.get(f"={label}")
        if same is None:
            same = Node(parent, tag, xxhash.xxh64_intdigest(label, parent.code), out, main, tag in LEAVES or parent.leaf, parent.depth + 1)
            parent.below[f"={label}"] = same
        parent.below[key] = found = same
    return found


def parse(html: str | None) -> list[Node | Block]:
    """The opened elements, without inline ones, and the blocks of text in page order.

    Any string is read: elements that the page leaves open end with their parent or the page, end tags without a start and a tag cut
    off by the end are passed over. Blocks have character references decoded and white space as single spaces; scripts, styles and what a page does not show have none.
    """
    root = Node(None, "", 0)
    out: list[Node | Block] = []
    stack: list[tuple[str, Node]] = [("", root)]
    n_open: dict[str, int] = {}
    pieces: list[str] = []
    linked = links = unseen = 0
    html = html or ""
    at, size = 0, len(html)

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                node = stack[-1][1]
                out.append(Block(node, text, min(linked, len(text)), xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), node.code ^ 1)))
            pieces.clear()
        linked = 0

    def close_to(depth: int) -> None:
        nonlocal links, unseen
        for tag, _ in stack[depth:]:
            n_open[tag] -= 1
            links -= tag == "a"
            unseen -= tag in UNSEEN
        del stack[depth:]

    while at < size:
        mark = _MARK.search(html, at)
        until = mark.start() if mark else size
        if until > at and not unseen:
            piece = html[at:until]
            piece = unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            if links:
                linked += len(piece.strip())
        if not mark:
            break
        at = mark.end()
        ends, tag, attributes = mark.group(1, 2, 3) if mark.group(2) else mark.group(4, 5, 6)
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            pieces.append(" ")
            continue
        inline = tag in INLINE
        if not inline:
            flush()
        if ends:
            if n_open.get(tag):
                depth = len(stack) - 1
                while stack[depth][0] != tag and not (inline and stack[depth][0] not in INLINE):
                    depth -= 1
                if stack[depth][0] == tag:
                    close_to(depth)
            continue
        if n_open.get("head") and tag not in HEAD_ONLY:
            close_to(next(i for i, (x, _) in enumerate(stack) if x == "head"))
        if not inline:
            closed, scope = CLOSES.get(tag, {"p"}), SCOPES.get(tag, ())
            if any(n_open.get(x) for x in closed):
                depth, last = len(stack) - 1, 0
                while depth and stack[depth][0] not in scope and (stack[depth][0] in closed or stack[depth][0] in INLINE or stack[depth][0] in CLOSES):
                    last = depth if stack[depth][0] in closed else last
                    depth -= 1
                if last:
                    close_to(last)
        if tag in VOID or attributes.endswith("/") and tag in ("path", "circle", "rect", "use"):
            continue
        node = stack[-1][1] if inline else _child(stack[-1][1], tag, attributes)
        stack.append((tag, node))
        n_open[tag] = n_open.get(tag, 0) + 1
        links += tag == "a"
        unseen += tag in UNSEEN
        if not inline and not unseen:
            out.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I).search(html, at)
            at = end.start()
    flush()
    return out
