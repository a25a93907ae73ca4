"""Text lines of a raw HTML page: one line per block, with what its mark-up says about it.

A page is read once into its elements, with the end tags that HTML lets one omit, and each element then
is kept or left out as a whole. What is left out: elements that stand beside an article by their name, by
their role, because they are hidden, or by a word of their class or id. Never left out are ``html``,
``body``, ``main``, an ``article`` that is in no other one, and whatever holds every ``article`` and
``main`` of the page: that is a wrapper, however it is called.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

#: Elements whose content is never article text.
ASIDE_TAGS = frozenset(
    "nav footer aside form noscript template iframe object svg canvas button select textarea head title "
    "dialog menu audio video".split()
)
MAIN_TAGS = frozenset(("article", "main"))
WHOLE_PAGE = frozenset(("html", "body", "main"))
INLINE_TAGS = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr img".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())

#: Words in a class or id, and roles, that mark what stands beside an article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr notice "
    "newsletter subscribe sidebar menu nav navbar navigation breadcrumb breadcrumbs footer comment comments "
    "replies disqus share sharing social related popup modal".split()
)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
#: A name of several parts marks its element if the last part is such a word ("main-nav"), or the first one is
#: and the last one only says what kind of box it is ("cookie-banner"); "share-price" is neither.
BOX_WORDS = frozenset(
    "area bar banner block body box button buttons card container content footer form header icons inner item "
    "items left link links list menu message module overlay panel popup posts right row section signup slot "
    "stories top unit widget widgets wrap wrapper bottom articles thread".split()
)
#: First parts that say something about the page, not about the element ("has-sidebar").
ABOUT_PAGE = frozenset("has with no without not hide is".split())
COMMENT_WORDS = frozenset("comment comments replies disqus".split())

#: Start tags that end an open element of the same parent, whose end tag HTML lets one omit.
ENDS_P = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul".split()
)
ENDED_BY = {
    "li": frozenset(("li",)),
    "dt": frozenset(("dt", "dd")),
    "dd": frozenset(("dt", "dd")),
    "p": ENDS_P,
    "option": frozenset(("option", "optgroup")),
    "optgroup": frozenset(("optgroup",)),
    "tr": frozenset(("tr", "tbody", "tfoot")),
    "td": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "th": frozenset(("td", "th", "tr", "tbody", "tfoot")),
    "thead": frozenset(("tbody", "tfoot")),
    "tbody": frozenset(("tbody", "tfoot")),
    "head": frozenset(("body",)),
}

#: The open elements that a start tag may end.
MAY_END = {tag: [name for name, enders in ENDED_BY.items() if tag in enders] for tag in frozenset().union(*ENDED_BY.values())}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style)\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*+>"
    r"""|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<rest>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|</?[a-z][^>]*+>",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'=<>`]+))?""")
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


class Line(NamedTuple):
    text: str
    in_main: bool


def attributes_of(rest: str) -> dict[str, str]:
    """Attributes by lower-case name; of a repeated one the first, as HTML has it."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), unescape(value[1:-1] if value[:1] in "\"'" else value))
    return out


def marks(name: str) -> bool:
    """Whether one name of a class or id says that its element stands beside an article."""
    parts = [part.lower() for part in NAME_PART.findall(name)]
    while len(parts) > 1 and parts[-1].isdigit():
        parts.pop()
    if not parts or parts[0] in ABOUT_PAGE:
        return False
    return parts[-1] in ASIDE_WORDS or parts[0] in ASIDE_WORDS and (len(parts) == 1 or parts[-1] in BOX_WORDS)


class Element:
    """An open or closed element: whether it is to be left out, and how many mains it has inside."""

    __slots__ = ("tag", "strong", "weak", "in_main", "mains", "dropped")

    def __init__(self, tag: str, rest: str, in_main: bool) -> None:
        self.tag, self.in_main, self.mains, self.dropped = tag, in_main, 0, False
        self.strong = tag in ASIDE_TAGS or tag == "header" and not in_main
        self.weak = False
        if tag in WHOLE_PAGE or not rest or rest.isspace():
            return
        found = attributes_of(rest)
        names = [*found.get("class", "").split(), *found.get("id", "").split()]
        if tag == "article":
            # An article inside another one may be a comment or an advert; the outermost is the article.
            self.weak = in_main and any(name.lower() in ASIDE_WORDS for name in names)
            return
        self.weak = (
            "hidden" in found
            or "display:none" in re.sub(r"\s", "", found.get("style", "")).lower()
            or found.get("role", "").strip().lower() in ASIDE_ROLES
            or any(marks(name) for name in names)
            or not in_main and any(name.lower() in ("header", "site-header", "page-header") for name in names)
        )


def page_lines(html: str) -> list[Line]:
    """The lines of a page in order, without those that its mark-up puts beside the article.

    References are decoded, white space is made one space; lines without text are left out. An element
    that is never closed ends with the one it is in.
    """
    # What the page consists of: texts with the element they are in, and breaks between blocks (None).
    pieces: list[tuple[str, int] | None] = []
    elements = [Element("", "", False)]
    parents = [0]
    stack = [0]
    still_open: Counter[str] = Counter()
    n_main = at = 0

    def close_to(depth: int) -> None:
        nonlocal n_main
        while len(stack) > depth:
            gone = elements[stack.pop()]
            still_open[gone.tag] -= 1
            n_main -= gone.tag in MAIN_TAGS
            if gone.tag not in INLINE_TAGS:
                pieces.append(None)

    for token in TOKEN.finditer(html):
        if token.start() > at:
            pieces.append((html[at : token.start()], stack[-1]))
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE_TAGS:
            pieces.append(None)
        if token["end"]:
            if still_open[tag]:
                close_to(next(k for k in range(len(stack) - 1, 0, -1) if elements[stack[k]].tag == tag))
            continue
        while any(still_open[name] for name in MAY_END.get(tag, ())):
            # An open element that this tag ends, also from inside inline elements that were left open.
            k = len(stack) - 1
            while k > 1 and elements[stack[k]].tag in INLINE_TAGS:
                k -= 1
            if tag not in ENDED_BY.get(elements[stack[k]].tag, ()):
                break
            close_to(k)
        if tag in VOID_TAGS or token["rest"].endswith("/") and tag not in MAIN_TAGS and tag in ASIDE_TAGS:
            continue
        elements.append(Element(tag, token["rest"], bool(n_main)))
        parents.append(stack[-1])
        stack.append(len(elements) - 1)
        still_open[tag] += 1
        n_main += tag in MAIN_TAGS
    if at < len(html):
        pieces.append((html[at:], stack[-1]))

    for k in range(len(elements) - 1, 0, -1):  # an element comes after the one it is in
        elements[parents[k]].mains += elements[k].mains + (elements[k].tag in MAIN_TAGS)
    for k, element in enumerate(elements):
        wrapper = element.mains > 0 and element.mains == elements[0].mains
        element.dropped = elements[parents[k]].dropped or (element.strong or element.weak) and not wrapper

    lines: list[Line] = []
    parts: list[str] = []
    inside = False
    for piece in [*pieces, None]:
        if piece is None:
            if parts:
                text = " ".join(unescape("".join(parts)).split())
                parts.clear()
                if text:
                    lines.append(Line(text, inside))
            continue
        text, k = piece
        if not elements[k].dropped:
            if not parts:
                inside = elements[k].in_main or elements[k].tag in MAIN_TAGS
            parts.append(text)
        elif elements[k].tag not in INLINE_TAGS and parts:
            parts.append("")
    return lines
