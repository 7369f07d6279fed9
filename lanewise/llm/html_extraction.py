"""Main texts of pages by wrappers inferred per host.

A wrapper is a union-free regular expression over block tags: a sequence of
elements and texts in which an element may be optional or repeated, and a text
is fixed or a slot. A page is such an expression itself once runs of equal
elements are folded into repeated ones. Two expressions are aligned level by
level: matching elements are aligned in turn, elements without a partner become
optional, runs become repeated groups, and texts that differ become slots.

Every task folds its own pages into one wrapper per host before anything is
shuffled, so a host with a third of all pages costs one small row per task;
those meet in two steps. Labels carry no digits. An element has at most
``WIDEST`` kinds of children: of more, the rarest lose their words and, if the
tags are too many as well, their tags. They meet in general parts, which bounds
a wrapper and drops nothing; a page's element without a label of its own in the
wrapper is looked up there.

A text of the wrapper remembers the values that it had most often. One that came
with several different articles, and on at least half of the pages that have its
element, is part of the template wherever it stands, also between
others of its kind and inside articles; there it is left out with the element
that holds nothing else, but for headings and labels.

A page's text is that of all its articles, main and content elements. Where it
has none, the wrapper says by paths where most of the changing text is: the way
leads down into the one part that holds nearly all of it, and what the wrapper
knows as fixed is left out. Names alone make furniture outside regions, or where
a name says nothing else; other names in a region count if the wrapper finds the
same texts there on other pages, or if they hold links.
"""

from __future__ import annotations

import json
from collections.abc import Container, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.html_tree import Element, Text, parse
from lanewise.llm.workers import importable
from lanewise.storage import stored

WIDEST = 48
GENERAL = 16  # of these, parts that stand for several labels
DEEPEST = 100  # in a wrapper, what is nested deeper is taken as siblings
HOSTS_AT_ONCE = 2000
MERGERS = 32
SURE = 4  # pages with different texts that must agree on a fixed text
LINKED = 0.8  # share of link characters that makes a list of links
TELLING = 3  # texts of a page that tell it from others; one of them may be the template's
VALUES = 12  # of a text in a wrapper: those that came with most articles
NEARLY_ALL = 0.75  # of the changing text, in the part that is the article

FURNITURE_TAGS = frozenset("head nav footer aside form button fieldset dialog menu menuitem datalist audio video canvas embed".split())
FURNITURE = frozenset(
    "ad ads adv adsense adsbygoogle banner banners promo promotion widget widgets menu menus nav navigation masthead"
    " consent gdpr notice notices notification popup modal overlay signup login discussion replies reply respond"
    " recommended recommendations share sharing social toolbar pager copyright search contentinfo complementary".split()
)
STEMS = ("advert", "breadcrumb", "comment", "cookie", "disqus", "footer", "navbar", "newsletter", "paginat", "related", "sidebar", "sponsor", "subscri")
HEADS = frozenset("header topbar".split())
#: Words that are also those of a text's subject, and words that say nothing.
AMBIGUOUS = frozenset(
    "banner banners promo promotion menu menus navigation notice notices notification overlay discussion replies reply"
    " respond recommended recommendations sharing social search copyright complementary modal".split()
)
VAGUE = frozenset(
    "area bar block blocks body bottom box col column container content footer head header holder inner item items left"
    " link links list outer panel post posts right section side slot text thread title top unit wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What is the same on many pages and belongs to the text nevertheless.
LABELS = HEADINGS | {"th", "dt", "caption"}
CONTAINERS = frozenset("html body div section main article center td tr table tbody form".split())
PROSE = HEADINGS | {"p", "blockquote", "pre"}
POSTS = frozenset("post entry story hentry".split())
KEPT, NAMED, PLAIN, FURNISHED, UNSURE = range(5)
NOTED = frozenset({"main", "article", "h1"})
NOTHING: frozenset = frozenset()
COMMENTS = frozenset("comment comments reply replies discussion".split())
REGIONS = frozenset("content article post entry story text body main".split())

# An expression is a list of parts: elements [label, optional, repeated, pages, parts] and texts
# ["", value, bodies, values, mass]: ``bodies`` tells up to SURE different articles that the text came with, as copies of
# a page say nothing about a template; ``values`` has [pages, bodies] of several values, and ``mass`` counts characters
# outside links.


def value_of(text: str) -> str:
    return xxhash.xxh3_64_hexdigest(text.encode("utf-8", "replace"))


def expression(element: Element, inside: int = 0, body: int | None = None, depth: int = 1) -> list:
    """The parts of an element, folded. Furniture ("!") is kept without what it holds; "?" marks what may be such."""
    body = body_of(element) if body is None else body
    out: list = []
    around = [(iter(element.kids), out, inside)]  # more than one only below DEEPEST
    while around:
        kids, texts, inside = around[-1]
        kid = next(kids, None)
        if kid is None:
            around.pop()
        elif isinstance(kid, Text):
            value = value_of(kid.value)
            texts.append(["", value, [body], {value: [1, [body]]}, len(kid.value) - kid.linked])
        elif (says := judged(kid, inside)) == FURNISHED:
            out.append(["!" + kid.label, 0, 0, 1, []])
        elif depth < DEEPEST:
            out.append([marked(kid.label, says), 0, 0, 1, expression(kid, level(kid.label, inside), body, depth + 1)])
        else:
            out.append([kid.label, 0, 0, 1, []])
            around.append((iter(kid.kids), out[-1][4], level(kid.label, inside)))
    if depth == DEEPEST:
        out = [[*p[:4], folded(p[4])] if p[0] else p for p in out]
    return folded(out)


def body_of(root: Element) -> int:
    """What tells a page from others with the same template: its longest texts in a region, else all its texts."""
    texts: list[tuple[int, int, str]] = []  # (region, and surely no furniture; characters; text)
    around = [(iter(root.kids), 0, True)]
    while around:
        kids, inside, sure = around[-1]
        kid = next(kids, None)
        if kid is None:
            around.pop()
        elif isinstance(kid, Text):
            texts.append((bool(inside) + (sure and bool(inside)), len(kid.value), kid.value))
        elif (says := judged(kid, inside)) != FURNISHED:
            around.append((iter(kid.kids), level(kid.label, inside), sure and says == KEPT))
    longest = sorted(texts, reverse=True)[:TELLING]
    told = [t for region, _, t in longest if region == longest[0][0]] if longest and longest[0][0] else [t for _, _, t in texts]
    return xxhash.xxh3_64_intdigest("\n".join(told).encode("utf-8", "replace"))


def marked(label: str, says: int) -> str:
    return "?" + label if says == UNSURE else label


def together(a: list, b: list, side_by_side: bool) -> list:
    """One part for two with equal labels, of one page (``side_by_side``) or of two."""
    if not a[0]:
        same = a[1] is not None and a[1] == b[1]
        bodies = sorted({*a[2], *b[2]})[:SURE] if same else []
        return ["", a[1] if same else None, bodies, values_of_both(a[3], b[3], side_by_side), a[4] + b[4]]
    pages = max(a[3], b[3]) if side_by_side else None
    parts = aligned(a[4], b[4], side_by_side)
    return [a[0], a[1] & b[1] if side_by_side else a[1] | b[1], a[2] | b[2] | side_by_side, pages or a[3] + b[3], parts]


def values_of_both(a: dict, b: dict, one_page: bool) -> dict:
    """Values with their pages and articles; of too many, those of most articles and pages."""
    out = dict(a)
    for value, (pages, bodies) in b.items():
        if value in out:
            known, others = out[value]
            out[value] = [max(known, pages) if one_page else known + pages, bodies if bodies == others else sorted({*others, *bodies})[:SURE]]
        else:
            out[value] = [pages, bodies]
    if len(out) > VALUES:
        out = dict(sorted(out.items(), key=lambda item: (-len(item[1][1]), -item[1][0], item[0]))[:VALUES])
    return out


def folded(parts: list) -> list:
    """Neighbours with equal labels become one repeated part."""
    out: list = []
    for part in parts:
        if out and out[-1][0] == part[0]:
            out[-1] = together(out[-1], part, True)
        else:
            out.append(part)
    return bounded(out)


def general(label: str) -> str:
    """The label without its words."""
    return label[0] + "*" if label[0] in "!?" else label if label.endswith("*") else label.partition(".")[0] + ".*"


def met(parts: list) -> list:
    """Parts with equal labels meet, wherever they are."""
    first: dict[str, list] = {}
    for part in parts:
        known = first.get(part[0])
        first[part[0]] = together(known, part, True) if known else part
    return list(first.values())


def relabelled(parts: list, labels: dict[str, str]) -> list:
    """Parts under their new labels; pages add up where different ones meet."""
    first: dict[str, list] = {}
    for part in parts:
        name = labels.get(part[0], part[0])
        part = [name, 1, *part[2:]] if name != part[0] else part
        known = first.get(name)
        first[name] = together(known, part, False) if known else part
    return list(first.values())


def bounded(parts: list) -> list:
    """Parts with equal labels meet if there are too many; then the rarest become general."""
    if len(parts) <= WIDEST:
        return parts
    parts = met(parts)
    if len(parts) <= WIDEST:
        return parts
    own = ranked(p for p in parts if p[0] and not p[0].endswith("*"))
    keep = WIDEST - GENERAL - (len(own) < len([p for p in parts if not p[0].endswith("*")]))
    parts = relabelled(parts, {label: general(label) for label in own[keep:]})
    signs = [p[0] for p in parts if p[0] in ("!*", "?*")]
    wide = ranked(p for p in parts if p[0].endswith(".*"))
    if len(signs) + len(wide) >= GENERAL:
        parts = relabelled(parts, {label: "*" for label in wide[GENERAL - 1 - len(signs) :]})
    return parts


def ranked(parts: Iterable[list]) -> list[str]:
    """Labels, those of most pages first."""
    return [p[0] for p in sorted(parts, key=lambda p: (-p[3], p[0]))]


def settled(parts: list) -> list:
    """Parts of too few pages to tell anything join the general ones, if there are any."""
    names = {p[0] for p in parts if p[0].endswith("*")}
    if not names:
        return parts
    few = [p[0] for p in parts if p[0] and p[0] not in names and p[3] < SURE]
    return relabelled(parts, {label: known(label, names) for label in few})


def known(label: str, names: Container[str]) -> str:
    """The label that stands for another among ``names``, its own if there is none."""
    return next((name for name in (label, general(label), "*") if name in names), label)


def optional(part: list) -> list:
    return [part[0], 1, *part[2:]] if part[0] else part


def aligned(a: list, b: list, side_by_side: bool = False) -> list:
    """The expression that both sequences of parts fit, by a longest common subsequence of labels."""
    if [p[0] for p in a] == [p[0] for p in b]:
        return [together(x, y, side_by_side) for x, y in zip(a, b)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(together(a[i], b[j], side_by_side))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append(optional(a[i]))
            i += 1
        else:
            out.append(optional(b[j]))
            j += 1
    return folded(out)


@lru_cache(maxsize=1 << 16)
def is_region(label: str) -> bool:
    tag, *words = label.split(".")
    return tag in ("article", "main") or tag in ("div", "section", "td") and not REGIONS.isdisjoint(words)


def level(label: str, inside: int) -> int:
    """What the children of an element are in: 0 no region, 1 a region, 2 an article."""
    return max(inside, 2 if label.partition(".")[0] == "article" else int(is_region(label)))


@lru_cache(maxsize=1 << 16)
def named(label: str, inside: int) -> int:
    """What an element's label says of it.

    ``FURNISHED`` is no part of a text, ``PLAIN`` and ``NAMED`` are not unless
    they hold an article, and of ``UNSURE`` the label does not say enough, nor of
    ``NAMED`` if it holds a region.
    """
    tag, *words = label.split(".")
    if tag in ("html", "body", "main"):
        return KEPT
    if tag == "article":
        posted = {"open", "closed"}.intersection(words) or "comment" not in words and not POSTS.isdisjoint(words)
        return KEPT if posted or COMMENTS.isdisjoint(words) else FURNISHED
    if tag in FURNITURE_TAGS:
        return FURNISHED
    if inside and tag in PROSE:
        return KEPT
    told = [w for w in words if w in FURNITURE or w.startswith(STEMS)]
    clear = [w for w in told if w not in AMBIGUOUS and not w.startswith("related")]
    if told and (clear or not inside) and all(w in told or w in VAGUE for w in words):
        return PLAIN
    if tag in HEADS or not HEADS.isdisjoint(words):
        return KEPT if inside == 2 and not told else UNSURE if inside else NAMED
    return KEPT if not told else UNSURE if inside else NAMED


def holds(element: Element, tags: Container[str] = (), regions: bool = False) -> bool:
    """Whether an element that is no furniture by its name and has one of the tags, or is a region, is in an element."""
    if element.inside is None:
        survey(element)
    return regions and "" in element.inside or any(tag in element.inside for tag in tags)


def survey(element: Element) -> None:
    """Note for every element which of the tags that matter are in it, and "" for a region; children before parents."""
    order, around = [], [element]
    while around:
        order.append(around.pop())
        around += [kid for kid in order[-1].kids if isinstance(kid, Element) and kid.inside is None]
    for parent in reversed(order):
        found: frozenset = NOTHING
        for kid in parent.kids:
            if isinstance(kid, Element):
                if named(kid.label, 0) == KEPT:
                    own = {kid.tag} & NOTED | ({""} if is_region(kid.label) else set())
                    found = found | own if own else found
                if not kid.inside <= found:
                    found = found | kid.inside
        parent.inside = found


def judged(element: Element, inside: int) -> int:
    """``KEPT``, ``FURNISHED`` or ``UNSURE``: what an element is by itself."""
    if element.unseen:
        return FURNISHED
    says = named(element.label, inside)
    if element.tag == "form":  # some sites put the whole page into one
        return KEPT if holds(element, ("main", "article", "h1"), True) else FURNISHED
    if says in (KEPT, FURNISHED):
        return says
    if holds(element, ("main", "article")) or says == PLAIN and is_region(element.label) and holds(element, ("h1",)):
        return KEPT
    return UNSURE if says == UNSURE or says == NAMED and holds(element, (), True) else FURNISHED


def link_sums(element: Element, inside: int) -> tuple[int, int]:
    """Characters in links and all characters of what is neither furniture nor heading; each element is asked once per level."""
    around = [(element, inside, False)]
    while around:
        parent, within, done = around.pop()
        if within in parent.sums:
            continue
        kids = [(k, level(k.label, within)) for k in parent.kids if isinstance(k, Element) and k.tag not in HEADINGS and judged(k, within) != FURNISHED]
        if done:
            texts = [k for k in parent.kids if isinstance(k, Text)]
            parts = [k.sums[deeper] for k, deeper in kids]
            parent.sums[within] = sum(t.linked for t in texts) + sum(p[0] for p in parts), sum(len(t.value) for t in texts) + sum(p[1] for p in parts)
        else:
            around.append((parent, within, True))
            around += [(k, deeper, False) for k, deeper in kids]
    return element.sums[inside]


def mostly_links(element: Element, inside: int) -> bool:
    """Whether links make up what is neither furniture nor heading; all of it, if that holds a region."""
    linked, size = link_sums(element, inside)
    return size > 0 and linked >= (1 if holds(element, (), True) else LINKED) * size


def repeats(parts: list) -> bool:
    """Whether all texts are those of other pages."""
    return all(repeats(p[4]) if p[0] else p[1] is not None and len(p[2]) >= SURE for p in parts)


def profile(wrapper: list) -> dict:
    """What extraction needs: fixed texts, changing text and furniture by path, and labels where some are general."""
    fixed: dict[str, set[str]] = {}
    mass: dict[str, int] = {}
    bodies: set[int] = set()
    furniture: set[str] = set()
    labels: dict[str, set[str]] = {}

    def walk(parts: list, path: str, pages: int) -> None:
        parts = settled(parts)
        if any(p[0].endswith("*") for p in parts):
            labels[path] = {p[0] for p in parts}
        for part in parts:
            if part[0]:
                walk(part[4], f"{path}/{part[0]}", part[3])
                if part[0][0] == "?" and part[0] != "?*" and repeats(part[4]):
                    furniture.add(f"{path}/{part[0]}")
                continue
            known_fixed = {value for value, (times, of) in part[3].items() if len(of) >= SURE and 2 * times >= pages}
            if known_fixed:
                fixed.setdefault(path, set()).update(known_fixed)
            for _, of in part[3].values():
                bodies.update(of)
            mass[path] = mass.get(path, 0) + part[4]

    walk(wrapper, "", max((part[3] for part in wrapper if part[0]), default=0))
    return {"fixed": fixed, "furniture": furniture, "labels": labels, "mass": mass, "sure": len(bodies) >= SURE}


def in_prose(text: Text) -> bool:
    return text.linked < LINKED * len(text.value)


class Blocks:
    """Texts of a page by their path in the wrapper and the innermost region they are in, 0 if in none."""

    def __init__(self, root: Element, told: dict):
        self.rows: list[tuple[str, int, Text]] = []  # (path, region, text)
        self.owner: list[int] = []  # of each row: its element
        self.elements: list[tuple[int, str, bool]] = [(-1, "", True)]  # (the one it is in, tag, whether a region)
        self.told = told
        self.above, self.article = [0], [False]  # by region: the one it is in, whether it is an article
        self.labels, self.furniture = told["labels"], told["furniture"]
        self.walk(root)

    def walk(self, root: Element) -> None:
        around = [(iter(root.kids), "", 0, 0, 0)]  # (children, path, region, level, element)
        paths = [""]  # of the open elements that a wrapper has
        while around:
            kids, path, region, inside, element = around[-1]
            kid = next(kids, None)
            if kid is None:
                around.pop()
                del paths[len(around) :]
                continue
            if isinstance(kid, Text):
                self.rows.append((path, region, kid))
                self.owner.append(element)
                continue
            says = judged(kid, inside)
            if says == FURNISHED:
                continue
            above = paths[min(len(around), DEEPEST) - 1]
            label = marked(kid.label, says) if len(around) < DEEPEST else kid.label
            label = known(label, self.labels[above]) if above in self.labels else label
            here, inner = f"{above}/{label}", region
            if says == UNSURE and (here in self.furniture or mostly_links(kid, inside)):
                continue
            if is_region(kid.label):
                inner = len(self.above)
                self.above.append(region)
                self.article.append(kid.tag == "article")
            paths.append(here)
            self.elements.append((element, kid.tag, inner != region))
            around.append((iter(kid.kids), here, inner, level(kid.label, inside), len(self.elements) - 1))

    def taken(self) -> list[Text]:
        """Texts of all regions; one that adds only links to the regions inside it, or to others, does not count."""
        prose = {region for _, region, text in self.rows if in_prose(text)}
        whole = [False]
        for region in range(1, len(self.above)):
            whole.append(whole[self.above[region]] or self.article[region] or region in prose)
        found = [i for i, (_, region, _) in enumerate(self.rows) if whole[region]]
        found = found or [i for i, (_, region, _) in enumerate(self.rows) if region]
        template = self.template()
        own = [i for i in found if not template[i]]
        return [self.rows[i][2] for i in own or found]

    def sums(self, of: list[int]) -> list[int]:
        """What the rows below each element add up to."""
        total = [0] * len(self.elements)
        for element, value in zip(self.owner, of):
            total[element] += value
        for element in range(len(total) - 1, 0, -1):
            total[self.elements[element][0]] += total[element]
        return total

    def fixed(self) -> list[bool]:
        fixed = self.told["fixed"]
        return [path in fixed and value_of(text.value) in fixed[path] for path, _, text in self.rows]

    def template(self) -> list[bool]:
        """Whether a row is fixed, and so is all else in its element, which is no region, heading or label."""
        fixed = self.fixed()
        if not any(fixed):
            return fixed
        texts, same = self.sums([1] * len(fixed)), self.sums([int(f) for f in fixed])
        rows = []
        for element, is_fixed in zip(self.owner, fixed):
            _, tag, region = self.elements[element]
            rows.append(is_fixed and texts[element] == same[element] and not region and tag not in LABELS)
        return rows

    def heaviest(self) -> list[bool]:
        """Whether a row is in the part that holds nearly all of the changing text of the host's pages.

        An element weighs what the wrapper has at the different paths in it. The
        way ends at headings, and where no single part is nearly all.
        """
        if not self.told["sure"]:
            return [True] * len(self.rows)
        mass, fixed = self.told["mass"], self.fixed()
        met: set[tuple[int, str]] = set()
        weights = [0] * len(self.elements)
        for (path, _, text), element, is_fixed in zip(self.rows, self.owner, fixed):
            while not is_fixed and in_prose(text) and element >= 0 and (element, path) not in met:
                met.add((element, path))
                weights[element] += mass.get(path, 0)
                element = self.elements[element][0]
        kids: dict[int, list[int]] = {}
        for element in range(1, len(self.elements)):
            kids.setdefault(self.elements[element][0], []).append(element)
        here = 0
        while True:
            inner = kids.get(here, [])
            best = max(inner, key=lambda e: (weights[e], -e), default=None)
            if best is None or self.elements[best][1] not in CONTAINERS or weights[best] < NEARLY_ALL * weights[here]:
                break
            if any(self.elements[e][1] in HEADINGS and weights[e] for e in inner) or sum(weights[e] >= (1 - NEARLY_ALL) * weights[best] for e in inner) > 1:
                break
            here = best
        inside = [here == 0] * len(self.elements)
        for element in range(1, len(self.elements)):
            inside[element] = inside[element] or element == here or inside[self.elements[element][0]]
        return [inside[element] for element in self.owner]


def main_text(html: str, told: dict) -> str:
    """The texts of the page's regions; without one, those of its heaviest part but lists of links and fixed texts."""
    blocks = Blocks(parse(html), told)
    found = blocks.taken()
    if found:
        return "\n".join(t.value for t in found)
    part, fixed = blocks.heaviest(), blocks.fixed()
    loose = [i for i, (_, _, t) in enumerate(blocks.rows) if part[i] and in_prose(t)]
    # A fixed heading is kept with the text below it.
    above = {i for i, below in zip(loose, loose[1:]) if blocks.elements[blocks.owner[i]][1] in HEADINGS and not fixed[below]}
    own = [i for i in loose if not fixed[i] or i in above]
    return "\n".join(blocks.rows[i][2].value for i in own or loose)


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper per host from the pages of a partition."""
    wrappers: dict[str, list] = {}

    def rows() -> pa.RecordBatch:
        texts = [json.dumps(w) for w in wrappers.values()]
        return pa.RecordBatch.from_arrays([pa.array(list(wrappers), pa.string()), pa.array(texts, pa.string())], ["host", "wrapper"])

    for batch in batches:
        for host, html in zip(batch["host"].to_pylist(), batch["html"].to_pylist()):
            page = expression(parse(html or ""))
            wrappers[host] = aligned(wrappers[host], page) if host in wrappers else page
            if len(wrappers) > HOSTS_AT_ONCE:
                yield rows()
                wrappers.clear()
    yield rows()


def _merge(group: pa.Table) -> pa.Table:
    host, merged = group["host"][0].as_py(), None
    for text in sorted(group["wrapper"].to_pylist()):
        merged = json.loads(text) if merged is None else aligned(merged, json.loads(text))
    return pa.table({"host": [host], "wrapper": [json.dumps(merged)]})


def host_of(url: Column) -> Column:
    """Host name in lower case, empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit(""))


def wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper): one expression per host, as JSON."""
    importable(pages.sparkSession)
    rows = pages.select(host_of(F.col(f"`{url}`")).alias("host"), F.col(f"`{html}`").alias("html"))
    partial = rows.mapInArrow(_infer, "host string, wrapper string")
    spread = partial.withColumn("part", F.pmod(F.xxhash64("wrapper"), F.lit(MERGERS)))
    half = spread.groupBy("host", "part").applyInArrow(_merge, "host string, wrapper string")
    return half.groupBy("host").applyInArrow(_merge, "host string, wrapper string")


@lru_cache(maxsize=4096)
def _told(wrapper: str | None) -> dict:
    return profile(json.loads(wrapper)) if wrapper else profile([])


def _extract(htmls: pa.Array, wrapper: pa.Array) -> pa.Array:
    texts = [main_text(h or "", _told(w)) for h, w in zip(htmls.to_pylist(), wrapper.to_pylist())]
    return pa.array(texts, pa.string())


_extract.__annotations__ = {"htmls": pa.Array, "wrapper": pa.Array, "return": pa.Array}


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per row of ``pages``: its key, address, ``text`` and ``n_chars``.

    A block's white space is single; blocks are joined by a line feed. A null
    or empty page, or one without main text, gives the empty text. Pages without
    a host name share a wrapper. Repeated rows stay; other columns are left out,
    whatever their names. Wrappers are inferred and stored while the result is
    being built.
    """
    importable(pages.sparkSession)
    known = stored(wrappers(pages, url, html), "wrappers")
    address = F.col(f"`{url}`")
    rows = pages.select(F.col(f"`{key}`").alias("id"), address.alias("address"), F.col(f"`{html}`").alias("html"))
    joined = rows.withColumn("host", host_of(F.col("address"))).join(known, "host", "left")
    done = joined.select("id", "address", F.arrow_udf(_extract, "string")("html", "wrapper").alias("main"))
    return done.select(
        F.col("id").alias(key),
        F.col("address").alias(url),
        F.col("main").alias("text"),
        F.length("main").cast("bigint").alias("n_chars"),
    )
