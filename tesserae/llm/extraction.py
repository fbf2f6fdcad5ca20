"""Main text of pages by gradient-boosted trees over block-tree nodes with hierarchical decoding.

Every block of a page is described by its subtree (text, link and punctuation density), its element
and attribute words, its depth, its ancestors and its siblings. Two forests give the chance that a
block holds any main text and the chance that it holds nothing else. Decoding chooses for each
block one of three states - all of it is kept, none of it, or its children decide - so that the
product of chances over the page is greatest: a block in a dropped one is dropped, and a block in
a kept one is kept.

The forests are fitted on at most ``sample`` pages, picked by a digest among all that are not empty,
or among those with a run of words if the first pick has none: once as they are, where an article or
main element marks the main text, and ``variants`` times rebuilt, with their own text under other elements, attributes and
surroundings (side bars, notices, forms, comments). Of a page of more than ``page_chars`` characters
the sample has the first blocks with text, written anew without scripts, comments and other
attributes, so that it stays within that size. Everything else is a map over the table.

Defined results: a null or empty page, or one without main text, gives an empty text; a table in
which no sampled page marks its main text is judged by rebuilt pages alone, and if there is no text
at all to rebuild, everything outside known page furniture is kept; an empty table gives an empty
result. Only the named columns are read.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.boosting import Forest, fit
from tesserae.llm.markup import BLOCKS, MARK_NAMES, MARKS, NUMBER, Tree, parse
from tesserae.llm.tasks import below, digest, slices, strings

MAIN = tuple(NUMBER[n] for n in ("article", "main"))
FURNITURE = tuple(NUMBER[n] for n in ("nav", "header", "footer", "aside", "form", "menu", "dialog"))
FURNITURE_MARKS = sum(1 << i for i, n in enumerate(MARK_NAMES) if n not in ("content", "layout", "header", "share"))
# Marks main text in rebuilt pages, whose text is escaped; given pages are parsed without it.
TRUTH = "data-main"
GROUPS = (
    ("#text",), ("p", "blockquote", "pre"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("li", "dd", "dt"), ("ul", "ol", "dl", "menu"),
    ("div", "center"), ("section", "details"), ("article",), ("main",), ("nav", "menu"), ("header",), ("footer",),
    ("aside", "dialog"), ("form", "fieldset", "legend"), ("table", "tbody", "thead", "tfoot", "tr", "td", "th"),
    ("body", "html"), ("figure", "figcaption"),
)


@dataclass(frozen=True)
class Settings:
    """What the forests are fitted with."""

    sample: int = 120
    page_chars: int = 1 << 16
    variants: int = 2
    trees: int = 25
    depth: int = 4
    seed: int = 11


def describe(trees: list[Tree]) -> np.ndarray:
    """The features of all blocks of the trees, in order."""
    sizes = np.array([len(t.parent) for t in trees])
    n = int(sizes.sum())
    if not n:
        return np.zeros((0, 1))
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    whole = np.repeat(sizes, sizes)
    flat = lambda name: np.array([v for t in trees for v in getattr(t, name)])
    parent, depth, tag, marks = flat("parent") + base, flat("depth"), flat("tag"), flat("marks")
    root = parent < base
    parent[root] = np.flatnonzero(root)
    end, here = flat("end") + base, np.arange(n)
    texts = [s for t in trees for s in t.text]
    chars = np.array([len(s) for s in texts])
    words = np.array([s.count(" ") + 1 if s else 0 for s in texts])
    stops = np.array([s.count(".") + s.count(",") + s.count("!") + s.count("?") for s in texts])
    is_run = chars > 0

    def below(values):
        """Sums over subtrees; a subtree is a range in page order."""
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[end] - sums[here]

    text, links, marks_in, runs = below(chars), below(flat("linked")), below(stops), below(is_run)
    blocks, word_sum = end - here, below(words)
    groups = np.zeros((len(BLOCKS), len(GROUPS)))
    for j, names in enumerate(GROUPS):
        groups[[NUMBER[m] for m in names], j] = 1
    own = groups[tag]
    bits = (marks[:, None] >> np.arange(len(MARK_NAMES))) & 1
    # What stands above a block: flags and marks pass down the levels of the tree.
    above = np.concatenate([own[:, 7:15], bits], axis=1)
    nearest = np.concatenate([own, bits], axis=1)[parent]
    in_order = np.argsort(depth, kind="stable")
    for at in np.split(in_order, np.flatnonzero(np.diff(depth[in_order])) + 1)[1:]:
        above[at] = np.maximum(above[at], above[parent[at]])
    children = np.bincount(parent[~root], minlength=n)
    place = here - parent
    family = text[parent]
    start = np.cumsum(chars) - chars
    page_start = start[base]
    page_text = np.maximum(text[base], 1)
    per_page = np.add.reduceat(chars, np.flatnonzero(here == base)) if n else chars
    page_text = np.maximum(np.repeat(per_page, sizes[sizes > 0]), 1)
    safe = np.maximum(text, 1)
    previous = np.where(here - 1 >= base, here - 1, here)
    columns = [
        depth, np.log1p(text), np.log1p(chars), links / safe, marks_in / safe, np.log1p(runs), text / np.maximum(runs, 1),
        np.log1p(word_sum), text / np.maximum(word_sum, 1), text / blocks, np.log1p(blocks), children, place / whole,
        text / np.maximum(family, 1), (text[parent] - text) / np.maximum(children[parent], 1), children[parent],
        text / page_text, (start - page_start) / page_text, links[parent] / np.maximum(family, 1), tag[previous] == tag,
    ]
    return np.concatenate([np.stack(columns, axis=1).astype(float), own, bits, above, nearest], axis=1).astype(np.float32)


def targets(tree: Tree) -> list[bool]:
    """Whether each run is main text: by ``TRUTH`` if it was parsed with it, else by its article or main element."""
    n = len(tree.parent)
    marked = any(t >= 0 for t in tree.truth)
    kept = [False] * n
    for i in range(n):
        up = tree.parent[i]
        inherited = kept[up] if up >= 0 else False
        if marked:
            kept[i] = bool(tree.truth[i]) if tree.truth[i] >= 0 else inherited
        elif inherited:
            kept[i] = tree.tag[i] not in FURNITURE and not tree.marks[i] & FURNITURE_MARKS
        else:
            dropped = up >= 0 and (tree.tag[up] in FURNITURE or bool(tree.marks[up] & FURNITURE_MARKS))
            kept[i] = tree.tag[i] in MAIN and not dropped
    return kept


def decode(tree: Tree, some: np.ndarray, only: np.ndarray) -> list[bool]:
    """The runs to keep: the best consistent choice of whole, none or mixed for every block."""
    n = len(tree.parent)
    least = 1e-6
    whole = np.log(np.clip(only, least, 1)).tolist()
    none = np.log(np.clip(1 - some, least, 1)).tolist()
    mixed = np.log(np.clip(some - only, least, 1)).tolist()
    free = [0.0] * n  # the best that the children reach when they decide for themselves
    best = [0.0] * n
    for i in range(n - 1, -1, -1):  # children come after their parents
        choice = max(whole[i], none[i])
        if tree.end[i] > i + 1:
            choice = max(choice, mixed[i] + free[i])
        best[i] = choice
        up = tree.parent[i]
        if up >= 0:
            whole[up] += whole[i]
            none[up] += none[i]
            free[up] += choice
    kept = [False] * n
    i = 0
    while i < n:
        if best[i] == whole[i]:
            kept[i : tree.end[i]] = [True] * (tree.end[i] - i)
            i = tree.end[i]
        elif best[i] == none[i]:
            i = tree.end[i]
        else:
            i += 1
    return kept


def rebuilt(tree: Tree, kept: list[bool], others: list[str], rng: random.Random) -> str:
    """A page with the main text of ``tree`` under other elements, and with furniture made of ``others``."""
    some = lambda *names: rng.choice(names)
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")

    def words(low, high):
        text = rng.choice(others).split()
        at = rng.randrange(max(1, len(text) - high))
        return escape(" ".join(text[at : at + rng.randint(low, high)]))

    def attribute(*names):
        name = rng.choice(names)
        extra = rng.choice(("", "", " wide", " js-x", " clearfix"))
        return f' {some("class", "class", "id")}="{name}{extra}"' if name else ""

    def off(tag, marks, body):
        return f'<{tag} {TRUTH}="0"{attribute(*marks)}>{body}</{tag}>'

    def links(low, high):
        entries = "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(rng.randint(low, high)))
        return f"<ul>{entries}</ul>"

    def paragraphs(low, high):
        return "".join(f"<p>{words(4, 60)}</p>" for _ in range(rng.randint(low, high)))

    advert = lambda: off(some("div", "div", "aside", "section"), ("ad", "ads", "advert", "sponsored", "promo", "ad-slot"), words(3, 25))
    comments = lambda: off(
        some("section", "div", "ol"), ("comments", "comment-list", "reader-comments", "disqus", "responses comments"),
        "".join(f'<{t}{attribute("comment", "", "reply")}><p>{words(3, 60)}</p></{t}>' for t in [some("div", "li", "article")] * rng.randint(1, 5)),
    )
    side = lambda: off(
        some("aside", "div", "section"), ("sidebar", "side", "related", "widget", "trending", "right-rail"),
        some(f"<h3>{words(1, 3)}</h3>", "") + some(links(2, 8), paragraphs(1, 3), words(3, 20)),
    )
    form = lambda: off(
        some("form", "form", "div"), ("search", "newsletter", "signup", "login", "subscribe", "contact-form"),
        f"<label>{words(1, 6)}</label><input type=text><button>{words(1, 2)}</button>" + some("", f"<p>{words(3, 15)}</p>"),
    )
    notice = lambda: off(some("div", "section", "aside"), ("cookie-notice", "cookies", "consent", "notice", "notification", "alert", "popup"), some(f"<p>{words(4, 30)}</p>", words(4, 30)))
    menu = lambda: off("nav", ("", "", "menu", "main-nav"), links(3, 10)) if rng.random() < 0.6 else off("div", ("menu", "navbar", "nav", "breadcrumbs"), links(3, 10))
    top = lambda: off("header", ("", "site-header", "top"), f"<h1>{words(1, 4)}</h1>" + some("", f"<p>{words(2, 8)}</p>", links(2, 5))) if rng.random() < 0.6 else off("div", ("header", "masthead", "topbar"), words(1, 8))
    foot = lambda: off("footer", ("", "", "site-footer"), some(f"&copy; {words(2, 20)}", f"<p>{words(2, 20)}</p>", links(2, 6))) if rng.random() < 0.7 else off("div", ("footer", "copyright", "legal"), f"&copy; {words(2, 20)}")

    runs = [tree.text[i] for i in range(len(tree.parent)) if tree.text[i] and kept[i]]
    body = [f"<h1>{escape(runs[0])}</h1>"] if runs else []
    for text in runs[1:]:
        inner = escape(text)
        if rng.random() < 0.2 and " " in inner:
            head, tail = inner.split(" ", 1)
            inner = f'<a href="/y">{head}</a> {tail}' if rng.random() < 0.5 else f"<b>{head}</b> {tail}"
        tag = rng.choices(("p", "li", "blockquote", "h2", "div", "td"), (12, 2, 1, 1, 1, 0.5))[0]
        body.append({"li": f"<ul><li>{inner}</li></ul>", "td": f"<table><tr><td>{inner}</td></tr></table>"}.get(tag, f"<{tag}>{inner}</{tag}>"))
        if rng.random() < 0.06:
            body.append(rng.choice((advert, side, form, notice))())
    tag, marks = rng.choice(
        (("article", ("", "post", "entry")), ("article", ("",)), ("main", ("", "content")), ("div", ("content", "article-body", "post", "entry-content", "story")), ("section", ("content", "article", "")))
    )
    core = f'<{tag} {TRUTH}="1"{attribute(*marks)}>{"".join(body)}</{tag}>'
    around = [core]
    for maker, chance in ((side, 0.5), (comments, 0.5), (advert, 0.4), (form, 0.3), (side, 0.2)):
        if rng.random() < chance:
            around.insert(rng.choice((0, len(around), len(around))), maker())
    inside = "".join(around)
    for _ in range(rng.randrange(3)):
        inside = f"<div{attribute('container', 'wrapper', 'page', 'row', 'layout', '')}>{inside}</div>"
    before = "".join(m() for m, chance in ((notice, 0.4), (top, 0.5), (menu, 0.8), (advert, 0.4)) if rng.random() < chance)
    after = "".join(m() for m, chance in ((advert, 0.3), (form, 0.2), (foot, 0.9), (notice, 0.2)) if rng.random() < chance)
    return f"<html><head><title>{words(1, 8)}</title></head><body>{before}{inside}{after}</body></html>"


def shortened(page: str, limit: int) -> str:
    """The page, or if it is longer than ``limit`` its first blocks with text, as markup of about ``limit`` characters.

    Half of the limit is left to text, however deep the blocks are nested.
    """
    if len(page) <= limit:
        return page
    tree = parse(page)
    chars = np.concatenate([[0], np.cumsum([len(s) for s in tree.text])])
    out, opened, size, room = [], [], 0, limit // 2
    for i, text in enumerate(tree.text):
        while opened and opened[-1][1] <= i:
            out.append(f"</{opened.pop()[0]}>")
        if size >= limit:
            break
        if text:
            text = text[: limit - size]
            link = min(tree.linked[i], len(text))
            escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
            out.append((f"<a>{escape(text[:link])}</a>" if link else "") + escape(text[link:]) + "<hr>")
            size += len(out[-1])
        elif chars[tree.end[i]] > chars[i] and room > 0:
            name = BLOCKS[tree.tag[i]]
            words = " ".join(own.split()[0] for j, own in enumerate(MARKS.values()) if tree.marks[i] >> j & 1)
            out.append(f'<{name} class="{words}">' if words else f"<{name}>")
            opened.append((name, tree.end[i]))
            size += 2 * len(out[-1])  # its end tag included
            room -= 2 * len(out[-1])
    return "".join(out) + "".join(f"</{name}>" for name, _ in reversed(opened))


def has_words(page: str) -> bool:
    """Whether the page has a run that rebuilt pages can be made of."""
    return any(len(s.split()) > 2 for s in parse(page).text)


def sampled(rows: DataFrame, settings: Settings) -> list[str]:
    """At most ``sample`` of the pages ``html`` of ``rows``, shortened in the tasks that read them."""

    def run(batches):
        for batch in slices(batches, "html", 1 << 21):
            pages = pa.array([shortened(p, settings.page_chars) for p in strings(batch.column("html"))], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pages], ["digest", "html"])

    few = below(rows, settings.sample, rows.count(), "page_id", "html")
    few = few.select(digest("page_id", "html").alias("digest"), "html").mapInArrow(run, "digest bigint, html string")
    few = few.dropDuplicates(["digest"])  # a repeated row counts once
    return [r.html for r in few.orderBy("digest", "html").limit(settings.sample).collect()]


def learned(rows: DataFrame, settings: Settings) -> tuple[Forest, Forest] | None:
    """The forests of a sample of ``rows``; of one among the pages with words if the first has none."""

    def run(batches):
        for batch in slices(batches, "html", 1 << 21):
            yield batch.filter(pa.array([has_words(p) for p in strings(batch.column("html"))], pa.bool_()))

    rows = rows.filter(F.length("html") > 0)
    forests = learn(sampled(rows, settings), settings)
    return forests or learn(sampled(rows.mapInArrow(run, rows.schema), settings), settings)


def learn(pages: list[str], settings: Settings) -> tuple[Forest, Forest] | None:
    """The forests (any main text, nothing but main text) of sampled pages, or None without any text."""
    rng = random.Random(settings.seed)
    trees = [parse(p) for p in pages]
    truths = [targets(t) for t in trees]
    runs = [s for t in trees for s in t.text if len(s.split()) > 2]
    if not runs:
        return None
    marked = [(t, k) for t, k in zip(trees, truths) if any(k)]
    examples = list(marked)
    for tree, kept in marked or [(t, [True] * len(t.parent)) for t in trees if any(t.text)]:
        for _ in range(settings.variants):
            page = parse(rebuilt(tree, kept, runs, rng), TRUTH)
            examples.append((page, targets(page)))
    x = describe([t for t, _ in examples])
    some, only, useful = [], [], []
    for tree, kept in examples:
        good = [bool(s) and k for s, k in zip(tree.text, kept)]
        counts = np.cumsum([0, *good])
        runs_so_far = np.cumsum([0, *[bool(s) for s in tree.text]])
        end, here = np.array(tree.end), np.arange(len(tree.end))
        yes, total = counts[end] - counts[here], runs_so_far[end] - runs_so_far[here]
        some += (yes > 0).tolist()
        only += ((yes == total) & (total > 0)).tolist()
        useful += (total > 0).tolist()
    used = np.array(useful)
    x, some, only = x[used], np.array(some)[used], np.array(only)[used]
    return tuple(fit(x, y.astype(float), settings.trees, settings.depth) for y in (some, only))


def main_texts(pages: list[str], forests: tuple[Forest, Forest] | None) -> list[str]:
    """The main text of each page: kept runs in page order, one per line."""
    trees = [parse(p) for p in pages]
    if forests is None:
        furniture = [
            [t.tag[i] not in FURNITURE and not t.marks[i] & FURNITURE_MARKS for i in range(len(t.parent))] for t in trees
        ]
        for t, k in zip(trees, furniture):
            for i, up in enumerate(t.parent):
                k[i] = k[i] and (up < 0 or k[up])
        return ["\n".join(s for s, k in zip(t.text, own) if s and k) for t, own in zip(trees, furniture)]
    x = describe(trees)
    some, only = (f.chances(x) if len(x) else np.zeros(0) for f in forests)
    only = np.minimum(only, some)
    out, at = [], 0
    for tree in trees:
        n = len(tree.parent)
        kept = decode(tree, some[at : at + n], only[at : at + n])
        out.append("\n".join(s for s, k in zip(tree.text, kept) if s and k))
        at += n
    return out


def extract(
    pages: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    settings: Settings = Settings(),
) -> DataFrame:
    """Per row ``page_id``, ``url``, ``text`` and ``n_chars``."""
    rows = pages.select(
        F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).cast("string").alias("html")
    )
    forests = learned(rows.select("page_id", "html"), settings)
    parts = forests and [(f.base, f.features, f.limits, f.values) for f in forests]
    model = pages.sparkSession.sparkContext.broadcast(parts)  # two forests of a fixed size

    def run(batches):
        own = model.value and tuple(Forest(*p) for p in model.value)
        for batch in slices(batches, "html", 1 << 21):
            texts = main_texts(strings(batch.column("html")), own)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
