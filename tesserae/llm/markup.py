"""Pages as block trees: the block-level elements of a page and the text runs between their borders."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Elements by how a reader of pages treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
HIDDEN = frozenset("head noscript template svg math iframe object select button datalist canvas audio video".split())
BLOCKS = (
    "#text address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header html hr legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
).split()
NUMBER = {name: i for i, name in enumerate(BLOCKS)}
# An element that starts ends the open ones named, up to the nearest of the borders.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody",), ("table",)), "tfoot": (("tbody", "thead"), ("table",)),
}
P_BORDERS = ("table", "td", "th", "body", "html", "button", "object")
# Words of class, id and role attributes by what they usually mark.
MARKS = {
    "advert": "ad ads adv advert adverts advertisement sponsor sponsored promo promotion banner dfp adsense taboola outbrain",
    "navigation": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs skip",
    "header": "header masthead topbar top logo brand hero",
    "footer": "footer foot copyright colophon legal bottom",
    "sidebar": "sidebar side aside widget widgets rail related recommended recommend trending popular more complementary",
    "comment": "comment comments reply replies respond disqus discussion thread reader readers",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay paywall warning message toast",
    "form": "form search login signup subscribe subscription newsletter contact register",
    "share": "share sharing social follow tags meta byline author toolbar",
    "content": "content article post entry story main text body page-content single prose blog news",
    "layout": "container wrapper wrap page row col column columns grid layout inner outer site",
}
MARK_OF = {word: i for i, words in enumerate(MARKS.values()) for word in words.split()}
MARK_NAMES = tuple(MARKS)

# Comments; tags, in which only a quote right after an equals sign opens a value; declarations; a cut end.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|=)*+)(>?)"
    r"|<[!?][^>]*>"
    r"|<[/!?][^>]*\Z",
    re.S,
)
# Attributes in order, so that quoted values are passed over whole: (name, value in one of three forms).
ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>][^\s>]*+)))?""")
MARKING = frozenset(("class", "id", "role"))
PIECES = re.compile(r"[a-z]+")


@dataclass
class Tree:
    """Blocks in page order: ``parent``, past-the-last block ``end``, element, marks; runs carry their text."""

    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    truth: list[int] = field(default_factory=list)  # 1 or 0 where the attribute of ``parse`` says so, else -1


def marks_of(attributes: str, truth_name: str | None = None) -> tuple[int, int]:
    """(bits of the marks in class, id and role, value of the attribute ``truth_name`` or -1)."""
    bits, truth = 0, -1
    for name, *values in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name == truth_name:
            truth = int("1" in values)
        elif name in MARKING:
            for word in PIECES.findall("".join(values).lower()):
                if word in MARK_OF:
                    bits |= 1 << MARK_OF[word]
    return bits, truth


def parse(page: str, truth_name: str | None = None) -> Tree:
    """The block tree of a page. Wrong or missing end tags are repaired; scripts, styles and hidden elements are left out.

    ``truth_name`` names the attribute that says of our own rebuilt pages what is main text. The time
    is in proportion to the page: places of open elements are kept by name, and closing one removes
    all that it passes.
    """
    tree = Tree()
    stack: list[tuple[str, int]] = []  # (element, block number or -1 for an inline element)
    places: dict[str, list[int]] = {}  # of each open element in the stack, by name
    blocks: list[int] = []  # open blocks
    run: list[str] = []
    linked = links = hidden = 0
    at, size = 0, len(page)

    def add(tag: str, bits: int, truth: int) -> int:
        number, parent = len(tree.parent), blocks[-1] if blocks else -1
        tree.parent.append(parent)
        tree.end.append(number + 1)
        tree.depth.append(tree.depth[parent] + 1 if parent >= 0 else 0)
        tree.tag.append(NUMBER[tag])
        tree.marks.append(bits)
        tree.text.append("")
        tree.linked.append(0)
        tree.truth.append(truth)
        return number

    def flush():
        nonlocal linked
        text = " ".join("".join(run).split())
        if text:
            number = add("#text", 0, -1)
            tree.text[number], tree.linked[number] = text, min(linked, len(text))
        run.clear()
        linked = 0

    def say(text: str):
        nonlocal linked
        if text and not hidden:
            text = html.unescape(text) if "&" in text else text
            run.append(text)
            if links:
                linked += len(text)

    def close(index: int):
        nonlocal links, hidden
        if any(n >= 0 for _, n in stack[index:]):
            flush()
        for name, number in reversed(stack[index:]):
            if number >= 0:
                tree.end[number] = len(tree.parent)
                blocks.pop()
            places[name].pop()
            links -= name == "a"
            hidden -= name in HIDDEN
        del stack[index:]

    def last(names) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def close_open(names, borders):
        index = last(names)
        if index >= 0 and index > last(borders):
            close(index)

    while at < size:
        found = TOKEN.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        name, attributes = found[2].lower(), found[3]
        if not found[4]:  # the page ends in the tag
            break
        if found[1]:
            if places.get(name):
                close(places[name][-1])
            continue
        if name == "body" and hidden:
            close_open(("head",), ())
        if name in VOID:
            if name == "hr":
                flush()
            elif name == "br":
                say(" ")
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}\b[^>]*+(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else size
            continue
        number = -1
        if name in NUMBER and not hidden:
            close_open(("p",), P_BORDERS)
            if name in ENDS:
                close_open(*ENDS[name])
            flush()
            number = add(name, *marks_of(attributes, truth_name)) if attributes else add(name, 0, -1)
            blocks.append(number)
        places.setdefault(name, []).append(len(stack))
        stack.append((name, number))
        links += name == "a"
        hidden += name in HIDDEN
    close(0)
    flush()
    return tree
