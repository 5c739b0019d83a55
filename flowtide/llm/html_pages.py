"""One pass over the markup of a page: text blocks, and the containers that hold them.

Only block elements are kept on the stack. A new paragraph, list item or cell ends an open one, an end tag
ends everything inside its element, and one without a start is ignored, so unclosed or crossed inline tags
do no harm. An inline element that is hidden or marked as no article takes its text with it until it, or the block
around it, ends. Quoted attributes have any length; places from which no tag can end are remembered, so that broken
markup is scanned in linear time. A tag with an unclosed quote ends at its first closing bracket.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|iframe|object|svg|math|canvas|textarea|title)\b"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)"
    r"|<[!?/][^<>]*>",
    re.DOTALL | re.IGNORECASE,
)
_BARE = re.compile(r"</?[a-zA-Z][^<>]*(?:>|\Z)")
_PLAIN = re.compile(r"[^<>\"']*+")
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
_NAMES = frozenset("class id role style hidden aria-hidden".split())
_PART = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article body div main section td center blockquote".split())
#: Elements that never belong to an article.
SKIPPED = frozenset("nav footer aside form menu button select dialog head fieldset option datalist".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that mark what is not the article.
SKIPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promos promotion "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social related recommended recommendations sidebar sidebars widget widgets "
    "breadcrumb breadcrumbs menu menus nav navbar navigation pagination pager footer masthead topbar comment comments "
    "commentlist disqus reply replies respond feedback form search searchbox outbrain taboola".split()
)
#: Words that may stand beside them in one class or id: with any other word it names something else, as in "form-factor".
BESIDE_WORDS = frozenset(
    "a an article articles bar bars blog body bottom box boxes button buttons block blocks center col column container content "
    "desktop entry fixed footer global group header holder icon icons in inner item items left level link links list lists local "
    "main message messages mobile module modules more news outer page pages panel placeholder post posts primary right row "
    "secondary section site slot space sticky strip tab the thread title toggle tools top unit user wrap wrapper zone".split()
)
#: Elements whose id says nothing about what they are: headings and paragraphs are named for their text.
_NAMED_FOR_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd td th tr pre figure figcaption".split())
#: An element of this kind ends an open one of the same group before it.
_ENDS = {t: frozenset(g) for g in (("li",), ("dt", "dd"), ("td", "th"), ("tr",)) for t in g}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LIST = frozenset("li td th dd dt div".split())


@dataclass(slots=True)
class Block:
    text: str
    holder: int  # the innermost container
    links: int  # characters inside links
    tag: str
    skipped: bool
    article: bool  # inside an article or main element


@dataclass(slots=True)
class Page:
    """Containers are numbered, parents before children; 0 is the page itself."""

    blocks: list[Block] = field(default_factory=list)
    names: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [-1])

    def path(self, at: int) -> str:
        """Generalised tags and classes from the page to a container."""
        names = []
        while at > 0:
            names.append(self.names[at])
            at = self.parents[at]
        return "".join(f">{name}" for name in reversed(names))

    def places(self, path: str) -> list[int]:
        """The containers of a path."""
        steps = path.split(">")[1:]
        depth = [0] * len(self.names)  # steps of the path that lead here, or -1
        found = []
        for i in range(1, len(self.names)):
            above = depth[self.parents[i]]
            depth[i] = above + 1 if 0 <= above < len(steps) and self.names[i] == steps[above] else -1
            if depth[i] == len(steps):
                found.append(i)
        return found


@dataclass(slots=True)
class _Open:
    tag: str
    holder: int
    skipped: bool
    article: bool
    heading_only: bool


def _attributes(source: str) -> dict[str, str]:
    if not source.strip():
        return {}
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(source) if m[1] and m[1].lower() in _NAMES}


def _tag_end(html: str, at: int, failed: set[int]) -> int:
    """Place of the bracket that closes a tag whose attributes start at ``at``, or -1. ``failed`` are places of quotes
    from which there is none; each is looked at once."""
    seen = []
    while True:
        at = _PLAIN.match(html, at).end()
        if html.startswith(">", at):
            return at
        if at == len(html) or html[at] == "<" or at in failed:
            break
        seen.append(at)
        at = html.find(html[at], at + 1) + 1
        if not at:
            break
    failed.update(seen)
    return -1


def _tokens(html: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """Start, end, tag, whether it is an end tag, and attributes; without a tag what is no text."""
    at, failed = 0, set()
    while m := _TOKEN.search(html, at):
        at = m.end()
        if m["raw"] or m["tag"]:
            close = _tag_end(html, at, failed)
            if close < 0:
                bare = _BARE.match(html, m.start())
                if bare:
                    at = bare.end()
                    yield m.start(), at, None, False, ""
                continue
            attributes, at = html[at:close], close + 1
            if m["tag"]:
                yield m.start(), at, m["tag"].lower(), bool(m["end"]), attributes
                continue
            over = re.compile(rf"</{m['raw']}\s*>", re.IGNORECASE).search(html, at)
            at = over.end() if over else len(html)
        yield m.start(), at, None, False, ""


def _marked(names: str) -> bool:
    """Whether a class or id is made of words that mark what is not the article."""
    for name in names.split():
        words = set(_PART.findall(_CAMEL.sub(" ", name).lower()))
        if words & SKIPPED_WORDS and words <= SKIPPED_WORDS | BESIDE_WORDS:
            return True
    return False


def _is_skipped(tag: str, attributes: dict[str, str]) -> bool:
    if tag in SKIPPED:
        return True
    if not attributes:
        return False
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.IGNORECASE):
        return True
    if attributes.get("role", "").lower() in SKIPPED_ROLES:
        return True
    classes = attributes.get("class", "")
    if tag in ("body", "html", "article", "main"):
        # a word of the whole page's class says nothing about its text, but an article may be a comment
        return tag == "article" and bool({"comment", "comments", "reply"} & set(_PART.findall(_CAMEL.sub(" ", classes).lower())))
    return _marked(classes) or (tag not in INLINE and tag not in _NAMED_FOR_TEXT and _marked(attributes.get("id", "")))


def generalised(tag: str, attributes: dict[str, str]) -> str:
    """Tag and classes with the digits taken out, so that numbered copies of a template agree."""
    classes = sorted({re.sub(r"\d+", "", c) for c in attributes.get("class", "").lower().split()} - {"", "-", "_"})
    return ".".join([tag, *classes]).replace(">", "")


def parse(html: str) -> Page:
    page = Page()
    stack = [_Open("", 0, False, False, False)]
    open_: Counter[str] = Counter()
    pieces: list[str] = []
    links, in_link, at = 0, 0, 0
    hidden: list | None = None  # a skipped inline element: its tag, how often it is open, elements on the stack

    def close_block() -> None:
        nonlocal links
        if pieces:
            text = "".join(pieces)
            if "&" in text:
                text = unescape(text)
            text = " ".join(text.split())
            if text:
                top = stack[-1]
                skipped = top.skipped or (top.heading_only and top.tag not in HEADINGS)
                page.blocks.append(Block(text, top.holder, links, top.tag, skipped, top.article))
            pieces.clear()
        links = 0

    def cut(depth: int) -> None:
        """End all elements from this place of the stack on."""
        nonlocal hidden
        for element in stack[depth:]:
            open_[element.tag] -= 1
        del stack[depth:]
        if hidden and len(stack) < hidden[2]:
            hidden = None

    for start, end, tag, ends_one, attrs in _tokens(html):
        if start > at and not hidden:
            piece = html[at:start]
            pieces.append(piece)
            if in_link:
                links += len(piece.strip())
        at = end
        if tag is None:
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 0 if ends_one else 1
            if hidden:
                if tag == hidden[0]:
                    hidden[1] += -1 if ends_one else 1
                    hidden = hidden if hidden[1] else None
            elif not ends_one and attrs and tag not in VOID and not attrs.endswith("/") and _is_skipped(tag, _attributes(attrs)):
                hidden = [tag, 1, len(stack)]
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                close_block()
            continue
        close_block()
        if ends_one:
            if open_[tag]:
                cut(next(depth for depth in range(len(stack) - 1, 0, -1) if stack[depth].tag == tag))
            continue
        in_link = 0
        if stack[-1].tag == "p" or stack[-1].tag in HEADINGS:
            cut(len(stack) - 1)
        ends = _ENDS.get(tag)
        if ends and any(open_[t] for t in ends):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in ends:
                    cut(depth)
                    break
                if stack[depth].tag in ("ul", "ol", "dl", "table"):
                    break
        if attrs.endswith("/") and tag not in CONTAINERS:
            continue
        attributes = _attributes(attrs)
        top = stack[-1]
        holder = top.holder
        article = top.article or tag in ("article", "main")
        # the head of a page goes, the head of an article keeps its headings
        heading_only = top.heading_only or (tag == "header" and article)
        skipped = top.skipped or bool(hidden) or (tag == "header" and not article) or _is_skipped(tag, attributes)
        if tag in CONTAINERS:
            page.parents.append(holder)
            page.names.append(generalised(tag, attributes))
            holder = len(page.names) - 1
        stack.append(_Open(tag, holder, skipped, article, heading_only))
        open_[tag] += 1
    if at < len(html) and not hidden:
        pieces.append(html[at:])
    close_block()
    return page


def is_link_list(block: Block) -> bool:
    """An item of a menu. Inside an article a list of links is part of it."""
    return not block.article and block.tag in _LIST and block.links >= 0.8 * len(block.text)
