"""A page as a tree of block elements and texts, tolerant of broken markup."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|object|select)\b(?P<rawattrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
WORD = re.compile(r"[a-z]+|[A-Z](?:[a-z]+|[A-Z]*(?![a-z]))")
SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr img"
    " math maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub"
    " msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
#: What an opening tag ends, if it is open in the same list, table or section.
ENDS = {
    "li": ("li",),
    "dt": ("dt", "dd"),
    "dd": ("dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
    "body": ("head",),
}
FENCES = frozenset("ul ol dl table tbody thead tfoot div section article main aside nav header footer form body html".split())


class Element:
    """``label`` is the tag with the words of its class, identifier and role."""

    __slots__ = ("tag", "label", "words", "kids", "unseen", "inside", "sums")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.kids, self.unseen = tag, [], False
        self.inside, self.sums = None, {}  # noted by those who ask
        words = set()
        if attributes:
            for name, a, b, c in ATTRIBUTE.findall(attributes):
                name, value = name.lower(), a or b or c
                if name in ("class", "id", "role"):
                    words.update(w.lower() for w in WORD.findall(unescape(value)))
                elif name == "style":
                    self.unseen |= "display:none" in value.replace(" ", "").lower()
                else:
                    self.unseen |= value.lower() != "false"
        self.words = words
        self.label = ".".join([tag, *sorted(words)])


class Text:
    """White space is single; ``linked`` counts the characters inside links."""

    __slots__ = ("value", "linked")

    def __init__(self, value: str, linked: int):
        self.value, self.linked = value, linked


def parse(html: str) -> Element:
    """The root of a page. Inline elements are part of their block's text; a line break is white space."""
    root = Element("")
    stack = [root]
    inline: Counter[str] = Counter()  # open inline elements of the block
    opened: Counter[str] = Counter()  # tags on the stack
    parts: list[str] = []
    linked = 0

    def close(depth: int) -> None:
        opened.subtract(e.tag for e in stack[depth:])
        del stack[depth:]

    def settle() -> None:
        nonlocal linked
        if parts:
            value = SPACE.sub(" ", unescape("".join(parts))).strip()
            if value:
                stack[-1].kids.append(Text(value, linked))
            parts.clear()
            linked = 0

    for token in TOKEN.finditer(html):
        text = token["text"]
        if text is not None:
            parts.append(text)
            if inline["a"]:
                linked += len(text)
            continue
        tag = token["tag"]
        if tag is None:
            if token["raw"] and token["raw"].lower() not in ("title", "script", "style"):
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        elif tag in INLINE:
            if not token["end"]:
                inline[tag] += 1
            elif inline[tag]:
                inline[tag] -= 1
        elif token["end"]:
            settle()
            if opened[tag]:
                close(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            inline.clear()
        else:
            settle()
            inline.clear()
            ended = ENDS.get(tag, ())
            while stack[-1].tag == "p" or stack[-1].tag in ended:
                close(len(stack) - 1)
            for depth in range(len(stack) - 1, 0, -1) if ended else ():
                if stack[depth].tag in ended:
                    close(depth)
                    break
                if stack[depth].tag in FENCES:
                    break
            element = Element(tag, token["attrs"])
            stack[-1].kids.append(element)
            if tag not in VOID and not token["attrs"].endswith("/"):
                stack.append(element)
                opened[tag] += 1
    settle()
    return root
