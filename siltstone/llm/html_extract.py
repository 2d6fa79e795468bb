"""Main text of web pages: a chain model over the page's leaf blocks.

A page is cut into leaf blocks: runs of text between tags that start or end a block. Every block is seen with its open
elements (tags, words of their class, id and role) and with its own make-up (length, share of linked words, ends of
sentences, neighbours of the same kind, how much of the page's text its container has). A linear-chain conditional
random field marks blocks as main text or not, in page order, by Viterbi decoding. It is trained, the same way each
time, on labelled pages that ``labelled_pages`` writes from a fixed seed: articles among menus, headers, footers,
sidebars, notices, adverts, forms, bylines and comments (lists of items with or without parts, replies in replies, terms, rows of
tables) in the markup that public sites use, and in markup whose names say nothing.

One pass over the pages, without a shuffle; the tag scanner keeps the open elements only, no tree. Its work is linear in
a page's length, whatever the nesting: every character is looked at a bounded number of times, an element is closed
once, and of the names in attributes only those that the model knows are kept.

Defined results: a null or empty html gives an empty text and n_chars 0; a page of any length is read whole; unclosed
and stray tags are borne as browsers do (a block tag closes an open paragraph, a stray end tag is ignored, a script or
style isn't closed by a slash in its start tag), and an unfinished tag, comment or script runs to the page's end;
repeated rows give equal results; null page_ids and urls are
carried through; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Container, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.shipping import ship
from siltstone.llm import chain

SCHEMA = "page_id long, url string, text string, n_chars long"
SEED, PAGES = 7, 1200
#: Labelled pages that a feature must be in to have a weight.
SEEN = 4

#: HTML elements that start a block, that hold no text of the page, and that have no end tag.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("script style noscript template title textarea iframe svg math object canvas audio video noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
#: What an opening tag closes, if it's open inside the nearest element of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}

#: Silent elements whose content is no markup, those that a slash may close, and elements that hold blocks.
RAW = frozenset("script style noscript title textarea iframe noembed noframes".split())
FOREIGN = frozenset(("svg", "math"))
HOLDERS = frozenset("address article aside body center details dialog div fieldset footer form header main menu nav ol section table td ul".split())

#: A tag: its slash, name and attributes. Nothing is tried twice, so a tag without an end costs one pass over what follows.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?>[\s/]++|=?[^\s/>=]++(?>\s*+=\s*+(?>"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+|=|"|')*+)>""")
ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+")


class Block(NamedTuple):
    """A leaf block: its text, marks of its open elements, linked characters, its own tag, its container's number, and whether its own tag is named."""

    text: str
    marks: frozenset
    linked: int
    held: str
    holder: int
    named: bool = False


class Open:
    """The open elements, with the places of each kind, so that any of them is found without a search."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.marks: list[frozenset] = []  # each with those of the elements around it
        self.numbers: list[int] = []  # of the holder that it is or stands in
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.named: list[bool] = []  # of the blocks
        self.made = 0

    def push(self, name: str, own: set[str], named: bool) -> None:
        around = self.marks[-1] if self.marks else frozenset()
        if name in HOLDERS:
            self.made += 1
        self.numbers.append(self.made if name in HOLDERS else self.numbers[-1] if self.numbers else 0)
        self.marks.append(around if own <= around else around | own)
        self.places.setdefault(name, []).append(len(self.names))
        if name in BLOCKS:
            self.blocks.append(len(self.names))
            self.named.append(named)
        self.names.append(name)

    def last(self, names) -> int:
        """The place of the innermost open element of these names; -1 if there's none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def cut(self, place: int) -> None:
        """Close the element at a place and all in it."""
        while len(self.names) > place:
            name = self.names.pop()
            self.places[name].pop()
            self.marks.pop()
            self.numbers.pop()
            if name in BLOCKS:
                self.blocks.pop()
                self.named.pop()

    def block(self) -> str:
        return self.names[self.blocks[-1]] if self.blocks else ""


@lru_cache(maxsize=64)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*+>?", re.I)


@lru_cache(maxsize=64)
def _edge_of(name: str) -> re.Pattern:
    return re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*+>?", re.I)


def _past(page: str, name: str, at: int) -> int:
    """Where a silent element ends whose start tag ended at a place."""
    if name in RAW:
        stop = _end_of(name).search(page, at)
        return stop.end() if stop else len(page)
    depth = 1
    for edge in _edge_of(name).finditer(page, at):
        depth += -1 if edge[1] else not edge[0].endswith("/>")
        if not depth:
            return edge.end()
    return len(page)


def blocks(page: str, known: Container[str] | None = None) -> list[Block]:
    """Leaf blocks in page order. known: marks to keep; all if None."""
    out: list[Block] = []
    held = Open()
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                inside = bool(held.names)
                out.append(Block(text, held.marks[-1] if inside else frozenset(), linked, held.block(), held.numbers[-1] if inside else 0, bool(held.named) and held.named[-1]))
            parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if held.places.get("a"):
            linked += len(text.strip())

    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            say(page[at:])
            break
        if begin > at:
            say(page[at:begin])
        after = page[begin + 1 : begin + 2]
        if after == "/" and page[begin + 2 : begin + 3].isalpha() or after.isalpha():
            tag = TAG.match(page, begin) if after.isascii() else None
            if tag is None and after.isascii() and page[begin + 1 + (after == "/")].isascii():
                break  # the page ends in a tag
        else:
            tag = None
        if tag is None:
            if page.startswith("<!--", begin):
                stop = page.find("-->", begin + 2)
                at = stop + 3 if stop >= 0 else size
            elif after and after in "!?/":
                stop = page.find(">", begin)
                at = stop + 1 if stop >= 0 else size
            else:
                say("<")
                at = begin + 1
            continue
        at, name = tag.end(), tag[2].lower()
        block = name in BLOCKS
        if block:
            flush()
        if tag[1]:
            place = held.last((name,))
            if place >= 0 and (block or place > (held.blocks[-1] if held.blocks else -1)):
                held.cut(place)  # an inline end tag doesn't close a block
            continue
        if name in SILENT:
            if not (name in FOREIGN and tag[3].endswith("/")):
                at = _past(page, name, at)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if block:
            if held.block() == "p":
                held.cut(held.blocks[-1])
            ends, inside = CLOSES.get(name, ((), ()))
            place = held.last(ends)
            if place > held.last(inside):
                held.cut(place)
        if name in VOID or tag[3].endswith("/") and not block:
            continue
        marks = {f"<{name}"}
        for _, *values in ATTRIBUTE.findall(tag[3]):
            marks.update(f"={w}" for w in PART.findall("".join(values).lower()))
        held.push(name, marks if known is None else {m for m in marks if m in known}, len(marks) > 1)
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Names of each block's features; each counts 1."""
    out = []
    sizes: Counter[int] = Counter()
    titled = set()
    for x in page:
        sizes[x.holder] += len(x.text) - x.linked
        if x.held == "h1":
            titled.add(x.holder)
    total, most = max(1, sum(max(0, n) for n in sizes.values())), max(sizes.values(), default=0)
    body = [bool({"<article", "<main"} & x.marks or x.marks & {"=article", "=content", "=post", "=entry", "=main"}) for x in page]
    lone = not any(body)  # nothing tells where the article is
    for i, x in enumerate(page):
        n = x.text.count(" ") + 1
        part = sizes[x.holder]
        f = ["1", f"n{min(n, 64).bit_length()}", f"in{x.held}", f"a{int(4 * min(x.linked / max(1, len(x.text)), 1))}", f"part{int(4 * max(0, part) / total)}", *x.marks]
        if x.text[-1] in ".!?…。":
            f.append("stop")
        if i == 0:
            f.append("first")
        if i and x.marks == page[i - 1].marks:
            f.append("same")
        if i and x.holder == page[i - 1].holder:
            f.append("beside")
        if part == most:
            f.append("most")
        if x.named:
            f.append("named")
        if x.holder in titled:
            f.append("titled")
        for side, k in (("before", i - 1), ("after", i + 1)):
            y = page[k] if 0 <= k < len(page) else None
            f.append(f"{side}-{y.held if y else ''}")
            if y and y.holder == x.holder and y.linked * 2 > len(y.text):
                f.append(f"{side}-links")
        if body[i]:
            f.append("body")
        elif lone:
            f += [f"lone-part{int(4 * max(0, part) / total)}", f"lone-most{part == most}", f"lone-titled{x.holder in titled}{bool(titled)}", f"lone-named{x.named}", f"lone-in{x.held}"]
        out.append(f)
    return out


@lru_cache(maxsize=1)
def trained() -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Feature numbers, weights and transitions, learnt from the labelled pages."""
    pages = labelled_pages(PAGES, SEED)
    often = Counter(x for page, _ in pages for x in {x for f in features(blocks(page)) for x in f})
    names = {x: k for k, x in enumerate(sorted(x for x, n in often.items() if n >= SEEN))}
    rows, marked = [], []
    for page, marks in pages:
        own = features(blocks(page, names))
        assert len(own) == len(marks), page
        x = np.zeros((len(own), len(names)), np.float32)
        for i, f in enumerate(own):
            x[i, [names[w] for w in f if w in names]] = 1
        rows.append(x)
        marked.append(np.array(marks))
    weights, moves = chain.train(rows, marked, steps=160, ridge=3e-5)
    return names, weights, moves


def by_name(model: tuple[dict[str, int], np.ndarray, np.ndarray]) -> tuple[dict[str, tuple[float, float]], list]:
    """A model's weights by feature name, and its transitions."""
    names, weights, moves = model
    return {x: tuple(weights[k].tolist()) for x, k in names.items()}, moves.tolist()


def main_text(page: str, model: tuple[dict[str, tuple[float, float]], list]) -> str:
    """The blocks that the model (see by_name) marks as main text, one to a line."""
    table, moves = model
    found = blocks(page, table)
    scores = []
    for f in features(found):
        known = [table[x] for x in f if x in table]
        scores.append((sum(x for x, _ in known), sum(y for _, y in known)))
    return "\n".join(x.text for x, y in zip(found, chain.viterbi(scores, moves)) if y)


def extract(pages: DataFrame) -> DataFrame:
    """SCHEMA, one row per page."""
    model = by_name(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [main_text(x.as_py() or "", model) for x in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[x.split()[0] for x in SCHEMA.split(", ")])

    ship(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, SCHEMA)


def labelled_pages(count: int, seed: int) -> list[tuple[str, list[int]]]:
    """Pages with a mark (1: main text) for each leaf block, in page order. The same for the same arguments."""
    rng = random.Random(seed)
    letters = "etaoinshrdlucmfwypvbgk"

    def word() -> str:
        return "".join(rng.choices(letters, range(len(letters), 0, -1), k=rng.randint(1, 9)))

    def phrase(low: int, high: int, stop: str = "") -> str:
        text = " ".join(word() for _ in range(rng.randint(low, high)))
        return text[:1].upper() + text[1:] + stop

    def prose() -> str:
        return " ".join(phrase(1, 18, rng.choice((".", ".", ".", "?", "!", ""))) for _ in range(rng.choice((1, 1, 2, 4, 8))))

    def inline(text: str) -> str:
        ws = text.split(" ")
        for _ in range(rng.choice((0, 0, 1, 2))):
            k = rng.randrange(len(ws))
            t = rng.choice(("b", "em", "a href='/x'", "span", "strong", "i"))
            ws[k] = f"<{t}>{ws[k]}</{t.split()[0]}>"
        return " ".join(ws)

    bare = False  # whether this page's names say nothing

    def attrs(*names: str) -> str:
        kind = rng.random()
        name = word() if bare else rng.choice(names)
        name = rng.choice((name, f"{name}-{word()}", f"{word()}-{name}", f"{word()} {name}", name.title(), f"{name}{rng.randint(1, 9)}"))
        return f' class="{name}"' if kind < 0.6 else f' id="{name}"' if kind < 0.8 else f" class='{name}' id='{word()}'"

    def links(low: int, high: int) -> tuple[str, list[int]]:
        n = rng.randint(low, high)
        how = rng.choice(("li", "li", "bare", "p"))
        if how == "bare":
            return " ".join(f"<a href='/{word()}'>{phrase(1, 3)}</a>" for _ in range(n)), [0]
        rows = "".join(f"<{how}><a href='/{word()}'>{phrase(1, 5)}</a></{how}>" for _ in range(n))
        return (f"<ul>{rows}</ul>" if how == "li" else rows), [0] * n

    def box(tag: str, mark: str, inner: tuple[str, list[int]]) -> tuple[str, list[int]]:
        return f"<{tag}{mark}>{inner[0]}</{tag}>", inner[1]

    def loose(low: int = 1, high: int = 3) -> tuple[str, list[int]]:
        n = rng.randint(low, high)
        if rng.random() < 0.4:
            return inline(prose()), [0]
        t = rng.choice(("p", "div", "li", "h3", "p"))
        return "".join(f"<{t}>{inline(prose())}</{t}>" for _ in range(n)), [0] * n

    def entry() -> tuple[str, list[int]]:
        t = rng.choice(("label", "p", "div"))
        return f"<{t}>{phrase(1, 4)}</{t}><input name='q'><button>{phrase(1, 2)}</button>", [0, 0]

    def joined(*pieces: tuple[str, list[int]]) -> tuple[str, list[int]]:
        return "".join(p[0] for p in pieces), [m for p in pieces for m in p[1]]

    def said() -> tuple[str, list[int]]:
        """What one reader wrote, in blocks of its own."""
        t, n = rng.choice(("p", "p", "div", "blockquote")), rng.choice((1, 1, 2, 3))
        return "".join(f"<{t}>{inline(prose())}</{t}>" for _ in range(n)), [0] * n

    def who(*names: str) -> tuple[str, list[int]]:
        """A line with a reader's or an author's name and a time."""
        line = rng.choice((f"<cite>{phrase(1, 3)}</cite> says", f"<a href='/u/{word()}'>{phrase(1, 2)}</a> <time>{rng.randint(1, 28)} {word()} 20{rng.randint(10, 25)}</time>", f"By {phrase(1, 3)}", f"{phrase(1, 2)} | {rng.randint(1, 59)} min", f"<b>{phrase(1, 2)}</b>"))
        return box(rng.choice(("div", "p", "footer", "h4", "header", "div")), attrs(*names), (line, [0]))

    def reply() -> tuple[str, list[int]]:
        return box(rng.choice(("div", "p")), attrs("reply", "actions", "links", "votes"), (" ".join(f"<a href='#{word()}'>{phrase(1, 1)}</a>" for _ in range(rng.randint(1, 3))), [0]))

    def comment(shape: str, deep: int = 0) -> tuple[str, list[int]]:
        named = attrs("comment", "reply", "response", "message") if rng.random() < 0.7 else ""
        if shape == "list":  # an item with its own parts, replies in a list in it
            inner = joined(who("comment-author", "comment-meta", "author", "vcard"), box("div", attrs("comment-content", "comment-text", "body"), said()), reply())
            if rng.random() < 0.5:
                inner = box(rng.choice(("article", "div")), attrs("comment-body"), inner)
            if deep < 2 and rng.random() < 0.25:
                inner = joined(inner, box(rng.choice(("ul", "ol")), attrs("children", "replies"), comment(shape, deep + 1)))
            return box("li", named, inner)
        if shape == "plain":  # an item with nothing but what was said
            return box("li", named, said() if rng.random() < 0.7 else (inline(prose()), [0]))
        if shape == "terms":
            return joined(box("dt", named, (phrase(1, 3), [0])), box("dd", "", said() if rng.random() < 0.5 else (inline(prose()), [0])))
        if shape == "rows":
            return box("tr", named, joined(box("td", "", (phrase(1, 2), [0])), box("td", "", said() if rng.random() < 0.5 else (inline(prose()), [0]))))
        if shape == "parts":
            return box("div", named, joined(who("author", "user", "meta"), said(), *([reply()] if rng.random() < 0.5 else [])))
        return box(shape, named, (inline(prose()), [0]))

    def comments() -> tuple[str, list[int]]:
        shape = rng.choice(("list", "list", "list", "plain", "plain", "terms", "rows", "parts", "parts", "p", "div", "article"))
        rows = joined(*[comment(shape) for _ in range(rng.randint(1, 5))])
        around = {"list": ("ol", "ul"), "plain": ("ul", "ol"), "terms": ("dl",), "rows": ("table",)}.get(shape)
        if around:
            rows = box(rng.choice(around), attrs("comment-list", "commentlist", "comments") if rng.random() < 0.6 else "", rows)
        pieces = [rows]
        if rng.random() < 0.6:
            pieces.insert(0, box(rng.choice(("h2", "h3", "h4", "p")), attrs("comments-title", "title") if rng.random() < 0.5 else "", (f"{rng.randint(1, 90)} {phrase(1, 3)}" if rng.random() < 0.5 else phrase(1, 2), [0])))
        if rng.random() < 0.4:
            pieces.append(box("form", attrs("comment-form", "respond") if rng.random() < 0.5 else "", entry()))
        return box(*rng.choice((("section", attrs("comments", "comment", "discussion", "responses", "replies", "disqus", "respond")), ("div", attrs("comments", "comments-area", "comment", "discussion", "responses", "reviews", "replies", "feedback", "talkback")))), joined(*pieces))

    def junk(where: str) -> tuple[str, list[int]]:
        kinds = {
            "top": ("nav", "header", "notice", "ad", "form", "menu"),
            "mid": ("ad", "notice", "share", "related", "form", "figure-ad"),
            "end": ("footer", "comments", "sidebar", "ad", "related", "notice", "form", "footer", "comments"),
        }[where]
        kind = rng.choice(kinds)
        if kind in ("nav", "menu"):
            return box(*rng.choice((("nav", ""), ("nav", attrs("nav", "menu", "navbar", "breadcrumb")), ("div", attrs("nav", "menu", "navigation", "navbar", "topbar", "breadcrumbs")), ("ul", attrs("menu", "nav")))), links(2, 7) if bare or rng.random() < 0.85 else joined((f"<h2>{phrase(1, 3)}</h2>", [0]), links(2, 7)))
        if kind == "header":
            return box(*rng.choice((("header", ""), ("header", attrs("site-header", "masthead")), ("div", attrs("header", "masthead", "banner", "branding")))), rng.choice((links(2, 5), loose(1, 2))))
        if kind == "footer":
            return box(*rng.choice((("footer", ""), ("footer", attrs("footer")), ("div", attrs("footer", "copyright", "colophon", "legal", "bottom")))), rng.choice((loose(1, 2), links(1, 4), (f"&copy; {phrase(1, 12, '.')}", [0]))))
        if kind == "sidebar":
            return box(*rng.choice((("aside", ""), ("aside", attrs("sidebar", "widget")), ("div", attrs("sidebar", "widget", "rail", "secondary")))), rng.choice((links(2, 6), loose(1, 4))))
        if kind in ("ad", "figure-ad"):
            return box(rng.choice(("div", "div", "aside", "section", "p")) if rng.random() < 0.8 else "div", attrs("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "banner"), (inline(prose()), [0]))
        if kind == "notice":
            return box(rng.choice(("div", "section", "aside")), attrs("cookie", "cookies", "consent", "notice", "banner", "alert", "popup", "modal", "gdpr", "paywall", "newsletter", "subscribe"), loose(1, 2))
        if kind == "share":
            return box("div", attrs("share", "social", "tags", "byline", "meta", "toolbar"), links(2, 5))
        if kind == "related":
            return box(rng.choice(("div", "section", "aside")), attrs("related", "recommended", "more", "popular", "trending", "teaser"), links(2, 6))
        if kind == "comments":
            return comments()
        return box("form", attrs("search", "login", "subscribe", "contact") if rng.random() < 0.5 else "", entry())

    def article() -> tuple[str, list[int]]:
        out, marks = [], []
        if rng.random() < 0.8:
            t = rng.choice(("h1", "h1", "h2"))
            title = f"<{t}{attrs('entry-title', 'title', 'headline') if rng.random() < 0.3 else ''}>{phrase(1, 12)}</{t}>", [1]
            if rng.random() < 0.25 and not bare:
                by = who("byline", "entry-meta", "meta", "author", "posted", "dateline")
                title = joined(title, by) if rng.random() < 0.8 else joined(by, title)
            if rng.random() < 0.2 and not bare:
                title = box("header", attrs("entry-header", "post-header", "article-header") if rng.random() < 0.7 else "", title)
            out.append(title[0])
            marks += title[1]
        for _ in range(rng.choice((1, 1, 2, 3, 5, 9))):
            kind = rng.random()
            if kind < 0.66:
                open_b = rng.random() < 0.1
                out.append(f"<p>{'<b>' if open_b else ''}{inline(prose())}{'<br>' if open_b else '</p>'}")
                marks.append(1)
            elif kind < 0.73:
                t = rng.choice(("h2", "h3", "h4"))
                out.append(f"<{t}>{phrase(1, 6)}</{t}>")
                marks.append(1)
            elif kind < 0.80:
                n = rng.randint(1, 4)
                t = rng.choice(("ul", "ol"))
                out.append(f"<{t}>" + "".join(f"<li>{inline(prose())}</li>" for _ in range(n)) + f"</{t}>")
                marks += [1] * n
            elif kind < 0.87:
                t = rng.choice(("blockquote", "pre", "figcaption", "div", "td"))
                own = f"<{t}>{inline(prose())}</{t}>"
                out.append(f"<table><tr>{own}</tr></table>" if t == "td" else own)
                marks.append(1)
            else:
                text, own = junk("mid")
                out.append(text)
                marks += own
        return "".join(out), marks

    pages = []
    for _ in range(count):
        bare = rng.random() < 0.3
        out, marks = [f"<!DOCTYPE html><html><head><title>{phrase(1, 5)}</title><style>p{{}}</style></head><body>"], []

        def add(piece: tuple[str, list[int]]) -> None:
            out.append(piece[0])
            marks.extend(piece[1])

        for _ in range(rng.randint(0, 3)):
            add(junk("top"))
            out.append(rng.choice(("", "<!-- x -->", "<script>var a='</p>';</script>", "\n")))
        body = article()
        if rng.random() < 0.1:
            own = box("footer", attrs("entry-footer", "post-footer", "tags"), links(1, 3))
            body = body[0] + own[0], body[1] + own[1]
        if rng.random() < 0.35:
            body = f"<div{attrs('content', 'post', 'entry', 'article', 'story', 'text')}>{body[0]}</div>", body[1]
        frame = rng.choice((("article", ""), ("article", ""), ("main", ""), ("article", attrs("post", "entry", "story")), ("div", attrs("content", "article", "post", "story", "entry", "main"))))
        body = box(*frame, body)
        if rng.random() < 0.2 and frame[0] != "main" and not bare:  # one element around the article and what readers say
            body = box(*rng.choice((("main", ""), ("div", attrs("content", "main", "primary")))), joined(body, *[rng.choice((comments, lambda: junk("end")))() for _ in range(rng.randint(0, 2))]))
        add(body)
        for _ in range(rng.randint(0, 3)):
            add(junk("end"))
        out.append("</body></html>")
        pages.append(("".join(out), marks))
    return pages
