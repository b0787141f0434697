"""Main text of HTML pages by maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by the boxes they stand in, tags score below
zero, and the main content is the contiguous run of the sequence with the greatest sum, found in one
scan. All weights are learnt from labelled pages: how element names and the words of class, id and
role attributes of the elements around a word, and the block it stands in, speak for or against content,
how large a share of a block's words is linked, and how often a tag between blocks stands among content.
Blocks inside the run whose words score below zero (an advert in the article) are left out of the text.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled as own_pages

#: Element names by their part in a page.
SKIPPED = {"script", "style", "noscript", "template", "iframe", "svg", "title"}
BOXES = {"nav", "footer", "aside", "form", "menu", "dialog", "header", "article", "main", "section", "div", "body", "figure", "ul", "ol", "dl", "table", "button", "label", "select", "textarea", "fieldset", "address", "details"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Boxes whose element says nothing.
NEUTRAL = {"body", "details", "div", "dl", "figure", "ol", "section", "table", "ul"}
#: Elements in which an article is a teaser or a note.
FAR = {"nav", "footer", "aside", "menu"}

#: So many boxes around most of a page, one in the other, are read without their names.
OUTER = 8
#: Shares of a block's words that are linked, up to which they are few, some, most; all beyond.
LINKED = {"few": 0.25, "some": 0.5, "most": 0.8}
#: A word's score and the standing of a box stay between these; a tag's between the next two.
LEAST, MOST, DEAR, CHEAP = -3.0, 2.0, -3.0, -0.02
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Block elements whose tags have weights of their own.
KINDS = HEADINGS | {"p", "li", "tr", "td", "th", "dt", "dd", "blockquote", "figcaption", "pre"}
#: Of these, the ones that end before the next block, and before the next of the same kind.
SOFT, NEXT = HEADINGS | {"p"}, {"li": {"li"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
#: Elements that end a block of text; any other is part of it.
BLOCKS = KINDS | BOXES | {"html", "head", "hr", "legend", "option", "optgroup", "summary", "caption", "thead", "tbody", "tfoot", "center", "hgroup", "search", "title"}

#: Comments, declarations, and tags: an attribute's value may hold brackets in quotes; a tag that isn't closed ends before the next one.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>?|<(/?)([a-zA-Z][\w:-]*)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=|[^<>=]++)*+)>?", re.S
)
CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])[^<>]*>?", re.I) for name in SKIPPED}
#: A link, and what marks a place for links instead.
ANCHOR = re.compile(r"(?<![\w-])(?:name|id)(?![\w-])", re.I)
HREF = re.compile(r"(?<![\w-])href(?![\w-])", re.I)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)


@dataclass
class Box:
    """An open box: its name, what its features are, whether an article is open, and its standing when scored."""

    name: str
    features: list[str]
    inside: bool
    standing: float = 0.0
    around: Box | None = None
    far: bool = False
    held: bool = False
    top: Box | None = None  # the outermost box that speaks against this
    most: float = LEAST  # the best standing of the box and those around it
    at: int = 0  # where its tag stands
    first: int = 0  # the blocks from this one to before the next are in it
    stop: int = -1


@dataclass
class Block:
    """Text between two block tags: its words, the boxes around it, the tags since the last block, whether it's a heading."""

    text: str
    box: Box | None
    tags: list[str]
    heading: bool = False
    held: bool = False
    inset: bool = False
    score: float = 0.0
    n: int = 0
    linked: float = 0.0  # the share of its words that is linked
    own: float = 0.0  # what its own tags add to the score of each of its words
    top: bool = False  # a heading of the first level

    def links(self) -> list[str]:
        """What the share of linked words shows, by itself and inside an article."""
        if not self.linked:
            return []
        level = next((k for k, most in LINKED.items() if self.linked <= most), "all")
        return [f"links {level}" + (" inside" if self.box and self.box.inside else "")]


@dataclass
class Weights:
    """What features and tags weigh; a feature that wasn't seen weighs nothing."""

    features: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    inline: dict[str, float] = field(default_factory=dict)  # names on elements within a block

    def box(self, features: list[str]) -> float:
        return sum(self.features.get(f, 0.0) for f in features)


def _names(attributes: str) -> list[str]:
    """The words of class, id and role attributes, whole and by their parts."""
    found: dict[str, None] = {}
    for name, value in ATTRIBUTE.findall(attributes):
        value = value.strip("\"'").lower()
        if name.lower() == "hidden" or name.lower() == "aria-hidden" and value == "true":
            found["hidden"] = None
        for word in re.split(r"[^a-z0-9_-]+", value):
            parts = [w for w in re.split(r"[_-]+", word) if w]
            if len(parts) > 1:
                found["-".join(parts)] = None
            found.update(dict.fromkeys(parts))
    return list(found)


def _tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(from, before, element, whether it closes, attributes) of every tag of ``page``.

    Comments, declarations and skipped elements with all they hold are one token without a name.
    """
    at, open_ended = 0, set()  # elements that aren't closed any more from here on
    while m := TOKEN.search(page, at):
        at, name = m.end(), (m[2] or "").lower()
        if name in SKIPPED:
            if not m[1] and not m[3].endswith("/") and name not in open_ended:
                closing = CLOSING[name].search(page, at)
                if closing:
                    at = closing.end()
                elif name in ("script", "style", "iframe"):
                    at = len(page)
                else:
                    open_ended.add(name)
            name = ""
        yield m.start(), at, name, bool(m[1]), m[3] or ""


def read(page: str, weights: Weights | None = None, plain: frozenset[int] = frozenset(), afresh: bool = False) -> list[Block]:
    """The text blocks of a page in order, scored if there are ``weights``."""
    return _read(page, weights, plain, afresh)[0]


def _read(page: str, weights: Weights | None, plain: frozenset[int] = frozenset(), afresh: bool = False) -> tuple[list[Block], list[Box]]:
    """The text blocks and the boxes of a page in order.

    The names of boxes whose tags stand at ``plain`` don't count; with ``afresh`` an article in a box
    that speaks against it counts as if it stood alone. A main element does so anyway, unless its own
    names speak against it. Unclosed and crossing tags are read as browsers do, as far as boxes go. A
    block element with names is a box of its own; an element within a block whose names speak
    against it is left out of the block's text.
    """
    out: list[Block] = []
    boxes: list[Box] = []
    stack: list[Box] = []
    open_: Counter = Counter()
    held: list[str] = []
    linked: list[str] = []
    tags: list[str] = []
    last, heading, top = 0, False, False
    link, mute = -1, ""  # how many boxes are around an open link; the element that is left out
    start = weights.features.get("", 0.0) if weights else 0.0

    def flush() -> None:
        nonlocal tags, mute
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        mute = ""
        if text:
            n = text.count(" ") + 1
            share = min(1.0, len(entities.unescape(" ".join(linked)).split()) / n) if linked else 0.0
            out.append(Block(text, stack[-1] if stack else None, tags, heading, n=n, linked=share, top=top))
            tags = []
        linked.clear()

    def pop() -> Box:
        box = stack.pop()
        box.stop = len(out)
        open_[box.name] -= 1
        return box

    def hold(text: str) -> None:
        if not mute:
            held.append(text)
            if link >= 0:
                linked.append(text)

    for at, after, name, closing, attributes in _tokens(page):
        text, last = page[last:at], after
        hold(text)
        if not name:
            continue
        if name not in BLOCKS:
            if name == "a":
                link = -1 if closing or ANCHOR.search(attributes) and not HREF.search(attributes) else len(stack)
            if name == "br":
                held.append(" ")
            elif closing:
                mute = "" if mute == name else mute
            elif weights and attributes and not mute and name not in VOID and sum(weights.inline.get(x, 0.0) for x in _names(attributes)) < -1:
                mute = name
            continue
        flush()
        if stack and (stack[-1].name in SOFT or not closing and stack[-1].name in NEXT and name in NEXT[stack[-1].name]):
            ended = pop()
            if closing and name == ended.name:
                link, heading = min(link, len(stack)), False
                continue
        inside = bool(stack) and stack[-1].inside
        tags.append("inside" if inside else name if name in KINDS else "box" if name in BOXES else "block")
        heading, top = not closing and name in HEADINGS, not closing and name == "h1"
        if name in VOID or name not in BOXES and name not in KINDS:
            continue
        if closing:
            if open_[name]:
                while pop().name != name:
                    pass
                if link > len(stack):
                    link = -1
            continue
        names = _names(attributes) if attributes else []
        if name not in BOXES and not names:
            continue
        around = stack[-1] if stack else None
        whole = name in ("article", "main") or "role" in attributes.lower() and "main" in names
        features = [] if name in NEUTRAL or name not in BOXES else [name, *([f"{name} inside"] if inside else [])]
        kind = f"{name} " if name in ("body", "article", "main") else "heading " if name in HEADINGS else ""
        # the names of a body and of boxes around the page say nothing
        if name != "body" and (at not in plain or name in FAR) or "hidden" in names and name != "body":
            features += [f"{kind}.{x}" for x in names] + ([f"{kind}.{x} inside" for x in names] if inside else [])
        box = Box(name, features, inside or whole, around=around, far=bool(around and around.far) or name in FAR, at=at, first=len(out))
        if weights:
            delta, before = weights.box(features), around.standing if around else start
            if before < 0 and whole and not (around and around.far) and delta > 0 and not inside:
                if name == "main" or afresh:
                    before = start
                else:
                    box.held = True
            box.held = box.held or bool(around and around.held)
            box.standing = before if before < 0 < delta else max(LEAST - 1, min(MOST, before + delta))
            box.top = around.top if around and around.top and box.standing <= 0 else box if box.standing <= 0 else None
            box.most = max(around.most if around else LEAST, box.standing if box.standing > before else LEAST)
        stack.append(box)
        boxes.append(box)
        open_[name] += 1
    hold(page[last:])
    flush()
    while stack:
        pop()
    if weights:
        _score(out, weights, start)
    return out, boxes


def _score(found: list[Block], weights: Weights, start: float) -> None:
    """Score the words of each block, and mark insets and what an article in an unlikely box holds.

    An inset speaks against itself in a box that speaks for content, or that has text before and after it.
    """
    marked = _has_article(found)
    first: dict[int, int] = {}  # by box: its first and last blocks that score over zero
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        b.score = b.box.standing if b.box else start
        if b.heading and b.score > 0:
            b.score += weights.features.get("heading", 0.0)
        if marked and not (b.box and b.box.inside):
            b.score += weights.features.get("beside", 0.0)
        if b.score > 0:
            b.own = weights.box(b.links())
        b.held = bool(b.box and b.box.held)
        if b.score > 0:
            own = b.box
            while own and own.name in KINDS:  # a paragraph with names stands in the box around it
                own = own.around
            first.setdefault(id(own), i)
            last[id(own)] = i
    for i, b in enumerate(found):
        top = b.box and b.box.top
        among = top is not None and top.around is not None and first.get(id(top.around), i) < i < last.get(id(top.around), i)
        b.inset = b.score <= 0 and (among or bool(b.box and b.box.most >= min(MOST, start + 0.5)))


def _has_article(found: list[Block]) -> bool:
    return any(b.box and b.box.inside and b.box.standing > 0 for b in found)


def _wrappers(found: list[Block], boxes: list[Box]) -> list[Box]:
    """The boxes around most of a page, from the outermost on: over half of its words, and its title if it has one."""
    upto = [0]
    for b in found:
        upto.append(upto[-1] + b.n)
    title = next((i for i, b in enumerate(found) if b.top), next((i for i, b in enumerate(found) if b.heading), None))
    return [x for x in boxes if x.name != "body" and 2 * (upto[x.stop] - upto[x.first]) > upto[-1] and (title is None or x.first <= title < x.stop)][:OUTER]


def _total(found: list[Block], weights: Weights) -> float:
    scores = sequence(found, weights)
    start, stop = best_run(scores)
    return sum(scores[start:stop])


def blocks(page: str, weights: Weights) -> list[Block]:
    """The scored blocks of a page.

    The names of a box around the whole page say nothing about its text: where no article speaks for
    itself the page is read without the names of its wrappers too, of one more each time, and the
    reading whose best run has the greatest sum counts.
    """
    found, boxes = _read(page, weights)
    good = lambda: sum(b.n for b in found if b.score > 0)
    if not _has_article(found) and sum(b.n for b in found if b.held) > good():
        found = read(page, weights, afresh=True)
    if _has_article(found):
        return found
    around = _wrappers(found, boxes)
    against = [i for i, x in enumerate(around, 1) if weights.box(x.features) < 0]
    readings = [found, *(read(page, weights, frozenset(x.at for x in around[:i])) for i in against)]
    return max(readings, key=lambda r: _total(r, weights)) if against else found


def best_run(scores: list[float]) -> tuple[int, int]:
    """The contiguous run (from, before) with the greatest sum over zero, the longest of equals; (0, 0) if none."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += score
        if total > best or total == best > 0:
            best, found = total, (start, i + 1)
    return found


def sequence(found: list[Block], weights: Weights) -> list[float]:
    """Scores of the tags before each block and of its words, in turn.

    A block's own tags count with its words, by the share of these that is linked, so that links weigh
    the same in a long and in a short block. What speaks against a block counts for two of its words at most, so that an
    advert doesn't end the run; for an inset, which stands in a box that speaks for content, it counts as a tag.
    """
    out, after = [], False  # after: an inset's closing tags come before the next block
    for b in found:
        score = b.score + b.own
        if b.inset:
            out += [CHEAP, CHEAP]
        else:
            out += [CHEAP if after else sum(weights.tags.get(t, DEAR) for t in b.tags), max(LEAST, min(MOST, score)) * (b.n if score > 0 else min(b.n, 2))]
        after = b.inset
    return out


def main_text(page: str | None, weights: Weights, scan: bool = True) -> str:
    """The main text of ``page``: its content blocks joined by line feeds; empty if there are none.

    Without ``scan`` every block whose words score over zero is taken, wherever it stands and whatever its tags.
    """
    found = blocks(page or "", weights)
    if not scan:
        return "\n".join(b.text for b in found if b.score > 0)
    start, stop = best_run(sequence(found, weights))
    return "\n".join(b.text for i, b in enumerate(found) if start <= 2 * i + 1 < stop and b.score + b.own > 0)


def fit(pages: list[tuple[str, list[str]]], penalty: float = 0.3, rounds: int = 12) -> Weights:
    """Weights from pages with the texts of their content blocks in order.

    Features are weighed by a logistic regression over blocks (presence of what a block and the boxes
    around it show), tags by the log odds to stand before a content block.
    """
    rows, tags = Counter(), Counter()
    for page, content in pages:
        left, found = list(content), read(page)
        marked = any(b.box and b.box.inside for b in found)
        for b in found:
            wanted = bool(left) and b.text == left[0]
            if wanted:
                left.pop(0)
            features, box = {"", *(["heading"] if b.heading else []), *b.links()}, b.box
            if marked and not (box and box.inside):
                features.add("beside")
            while box:
                features.update(box.features)
                box = box.around
            rows[frozenset(features), wanted] += 1
            for t in b.tags:
                tags[t, wanted] += 1
    names = sorted({"", *(f for features, _ in rows for f in features)})
    at = {f: i for i, f in enumerate(names)}
    x, y, n = np.zeros((len(rows), len(names))), np.zeros(len(rows)), np.zeros(len(rows))
    for i, ((features, wanted), k) in enumerate(sorted(rows.items(), key=lambda r: (sorted(r[0][0]), r[0][1]))):
        x[i, [at[f] for f in features]] = 1
        y[i], n[i] = wanted, k
    w = np.zeros(len(names))
    for _ in range(rounds):  # Newton's method with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = x.T @ (x * (n * p * (1 - p))[:, None]) + penalty * np.eye(len(names))
        w += np.linalg.solve(step, x.T @ (n * (y - p)) - penalty * w)
    odds = lambda t: math.log((tags[t, True] + 1) / (tags[t, False] + 1))
    learnt = dict(zip(names, w.tolist(), strict=True))
    return Weights(
        learnt, {t: max(DEAR, min(CHEAP, odds(t))) for t in {k for k, _ in tags}},
        {x: learnt.get(f".{x}", 0.0) for x in own_pages.INLINE},
    )


@functools.cache
def own_weights() -> Weights:
    """Weights from the labelled pages of this package."""
    return fit(own_pages.pages())


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", labelled=None) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars (code points).

    Null and empty html gives an empty text; ids and urls are returned as they are, also null or
    repeated; extra columns aren't read; an empty table gives no rows. Time grows with a page's
    length, whatever its markup. ``labelled``: pages with the texts of their content blocks, from
    which the weights are fitted; by default those of this package.
    """
    weights = fit(labelled) if labelled else own_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return (
        pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).alias("html"))
        .mapInArrow(run, "page_id long, url string, text string, n_chars long")
        .withColumnsRenamed({"page_id": page_id, "url": url})
    )
