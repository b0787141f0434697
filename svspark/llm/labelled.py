"""Labelled pages for the extraction of main text: layouts with their content known, built by a rule.

No labelled pages come with the tables, so these are made from parts: ways to mark or not to mark an
article, what stands around it, what stands inside it that isn't text of it, and what it holds.
"""

from __future__ import annotations

import random

#: Words of class, id and role attributes on pages, by what they are put on.
NAMES = {
    "nav": "breadcrumb breadcrumbs menu nav navbar navigation pagination toolbar topbar main-nav site-nav nav-menu menu-main".split(),
    "ad": "ad ads adv advert advertisement adverts advertising adsbygoogle banner promo promotion sponsor sponsored outbrain taboola ad-slot ad-container top-banner".split(),
    "notice": "alert consent cookie cookies modal notice popup cookie-notice gdpr-consent site-alert".split(),
    "form": "login newsletter search signup subscribe search-form newsletter-signup".split(),
    "side": "complementary related share sharing sidebar social teaser widget right-sidebar sidebar-left related-posts share-buttons widget-area recommended recommendations trending popular see-also more-stories read-next rail".split(),
    "comments": "comment comments discussion disqus feedback replies reply respond responses reviews talkback thread comment-list comments-area comments-title".split(),
    "foot": "contentinfo footer copyright site-footer page-footer".split(),
    "head": "header masthead site-header page-header branding".split(),
    "content": "article articlebody body content entry main post story text entry-content post-body main-content article-text".split(),
    "outer": "container layout outer page root site wrapper has-sidebar with-sidebar no-sidebar has-nav with-nav header-fixed comments-open full-width".split(),
}
#: Names that also tell on elements within a block.
INLINE = [*NAMES["ad"], *NAMES["notice"], "hidden", "share", "social"]
#: Names that headings and paragraphs of articles have.
TOLD = {"heading": "title headline heading entry-title post-title article-title page-title".split(), "p": "lead intro first dropcap summary paragraph".split()}
WORDS = "amber basin candle delta ember forest garden harbour island jacket kettle lantern meadow nickel orchard pebble quarry river silver timber".split()


class Page:
    """One page and the texts of its content blocks; the seed decides on all of it."""

    def __init__(self, seed: int):
        self.r, self.content = random.Random(seed), []
        self.html = self._page()

    def _words(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(WORDS) for _ in range(self.r.randint(low, high)))

    def _name(self, kind: str) -> str:
        return self.r.choice(["class='{}'", "id='{}'", "class='{} x1'", "class='box {}'"]).format(self.r.choice(NAMES[kind]))

    def _links(self, n: int) -> str:
        items = [f"<a href='#'>{self._words(1, 3)}</a>" for _ in range(n)]
        return self.r.choice(["<ul><li>{}</li></ul>", "<div>{}</div>", "<p>{}</p>"]).format(self.r.choice(["</li><li>", " | "]).join(items))

    def _around(self, kind: str) -> str:
        """A part that is no content: of a telling element, of a telling name, or of neither."""
        r, n = self.r, self._name(kind)
        if kind == "nav":
            return r.choice([f"<nav>{self._links(5)}</nav>", f"<nav {n}>{self._links(4)}</nav>", f"<div {n}>{self._links(5)}</div>", f"<ul {n}><li>{self._links(3)}</li></ul>", f"<menu>{self._links(3)}</menu>", f"<div>{self._links(6)}</div>"])
        if kind == "form":
            return r.choice([f"<form>{self._words(1, 6)} <input><button>{self._words(1, 2)}</button></form>", f"<form {n}><label>{self._words(1, 3)}</label><select><option>{self._words(1, 2)}</option></select><textarea>{self._words(1, 4)}</textarea></form>", f"<div {n}><p>{self._words(3, 20)}</p><button>{self._words(1, 2)}</button></div>"])
        if kind == "side":
            return r.choice([f"<aside>{self._some(2)}</aside>", f"<aside {n}>{self._some(3)}</aside>", f"<div {n}><h3>{self._words(1, 3)}</h3>{self._some(2)}</div>", f"<section {n}>{self._some(2)}{self._links(4)}</section>", f"<div {n}><article>{self._some(1)}</article></div>", f"<aside><article>{self._some(2)}</article></aside>"])
        if kind == "comments":
            each = r.choice(["<div class='comment'>{}</div>", "<li>{}</li>", "<article class='comment'>{}</article>", "<p>{}</p>"])
            return f"<{(t := r.choice(['div', 'section', 'ol']))} {n}>" + "".join(each.format(self._words(4, 40)) for _ in range(r.randint(2, 8))) + f"</{t}>"
        if kind == "foot":
            return r.choice([f"<footer>{self._words(3, 20)}</footer>", f"<footer {n}><p>{self._words(3, 20)}</p>{self._links(3)}</footer>", f"<div {n}>{self._words(4, 25)}</div>", f"<div>{self._words(2, 4)}</div>"])
        if kind == "head":
            return r.choice([f"<header>{self._words(1, 4)}{self._links(3)}</header>", f"<header {n}><h2>{self._words(1, 4)}</h2></header>", f"<div {n}>{self._words(1, 5)}</div>", f"<div><a href='/'>{self._words(1, 2)}</a></div>"])
        if kind == "notice":
            return r.choice([f"<div {n}><p>{self._words(5, 30)}</p><button>{self._words(1, 1)}</button></div>", f"<dialog>{self._words(5, 25)}</dialog>", f"<div hidden>{self._words(3, 20)}</div>", f"<div {n}>{self._words(5, 30)}</div>"])
        return r.choice([f"<div {n}>{self._words(3, 25)}</div>", f"<div {n}><a href='#'>{self._words(3, 12)}</a></div>", f"<div {n}><p>{self._words(5, 25)}</p></div>", f"<section {n}>{self._words(3, 20)}</section>"])

    def _some(self, n: int) -> str:
        return "".join(f"<p>{self._words(4, 40)}</p>" for _ in range(n))

    def _block(self, tag: str, low: int, high: int) -> str:
        text = self._words(low, high)
        self.content.append(text)
        name, kind = "", "p" if tag == "p" else "heading" if tag in ("h1", "h2", "h3") else ""
        if kind and self.r.random() < 0.15:
            name = f" class='{self.r.choice([*TOLD[kind], *NAMES['content'], *(NAMES['head'] if kind == 'heading' else [])])}'"
        if tag in ("p", "li", "td", "blockquote") and self.r.random() < 0.35:  # links inside
            return f"<{tag}{name}>{self._linked(text.split(), self.r.uniform(0.02, 0.45))}</{tag}>"
        if self.r.random() < 0.2:  # marked words inside
            first, _, rest = text.partition(" ")
            text = f"<b>{first}</b> {rest}" if rest else f"<em>{first}</em>"
        return f"<{tag}{name}>{text}</{tag}>" if tag else text

    def _linked(self, words: list[str], share: float) -> str:
        return " ".join(f"<a href='/{w}'>{w}</a>" if self.r.random() < share else w for w in words)

    def _inside(self, marked: bool) -> str:
        r, out = self.r, []
        title = self._block("h1", 2, 9)
        out.append(f"<header>{title}</header>" if marked and r.random() < 0.3 else title)
        for _ in range(r.randint(2, 8)):
            kind = r.choices(["p", "h2", "list", "quote", "table", "figure", "box", "bare", "refs", "inset"], [40, 7, 5, 4, 3, 3, 6, 4, 3 if marked else 0, 9])[0]
            if kind == "p":
                out.append(self._block("p", 5, 80))
            elif kind == "h2":
                out.append(self._block(r.choice(["h2", "h3"]), 1, 6))
            elif kind == "list":
                t = r.choice(["ul", "ol"])
                out.append(f"<{t}>" + "".join(self._block("li", 1, 15) for _ in range(r.randint(2, 5))) + f"</{t}>")
            elif kind == "quote":
                out.append(f"<blockquote>{self._block('p', 5, 40)}</blockquote>" if r.random() < 0.5 else self._block("blockquote", 5, 40))
            elif kind == "table":
                out.append("<table>" + "".join(f"<tr>{self._block('td', 1, 4)}{self._block('td', 1, 4)}</tr>" for _ in range(2)) + "</table>")
            elif kind == "figure":
                out.append(f"<figure><img src='x'>{self._block('figcaption', 2, 12)}</figure>")
            elif kind == "box":
                out.append(f"<{(t := r.choice(['div', 'section']))}>{self._block('p', 5, 60)}</{t}>")
            elif kind == "refs":
                out.append(f"<ul><li><a href='x'>{self._block('', 2, 8)}</a></li><li><a href='y'>{self._block('', 2, 8)}</a></li></ul>")
            elif kind == "bare":
                out.append(f"<div>{self._block('', 8, 60)}</div>")
            elif r.random() < 0.3:  # a single paragraph or heading that is none of the article's
                t, k = r.choice([("p", "ad"), ("p", "notice"), ("p", "side"), ("p", "comments"), ("h3", "comments"), ("h3", "side"), ("h3", "ad"), ("li", "nav")])
                out.append(f"<{t} {self._name(k)}>{self._words(1, 20)}</{t}>" if r.random() < 0.9 else f"<{t} hidden>{self._words(1, 20)}</{t}>")
            else:
                out.append(self._around(r.choice(["ad", "ad", "side", "form", "nav"])))
        out.append(self._block("p", 5, 60))
        if marked and r.random() < 0.2:
            out.append(self._around(r.choice(["foot", "comments", "side"])))
        return "".join(out)

    def _page(self) -> str:
        r = self.r
        top = "".join(self._around(k) for k in r.sample(["head", "nav", "ad", "notice", "form", "side"], r.randint(1, 4)))
        mark = r.choice(["article", "article", "main", "main article", "named", "named", "role", "none"])
        body, name = self._inside(mark not in ("none", "named")), self._name("content")
        own = {
            "article": f"<article>{body}</article>" if r.random() < 0.5 else f"<article {name}>{body}</article>",
            "main": f"<main>{body}</main>", "main article": f"<main><article>{body}</article></main>",
            "named": f"<div {name}>{body}</div>", "role": f"<div role='main'>{body}</div>", "none": f"<div>{body}</div>",
        }[mark]
        low = "".join(self._around(k) for k in r.sample(["comments", "side", "side", "foot", "ad", "nav"], r.randint(1, 4)))
        page = top + own + low
        for _ in range(r.randint(0, 2)):
            page = f"<div {self._name('outer')}>{page}</div>"
        body = r.choice(["<body>", f"<body {self._name('outer')}>", "<body class='single has-sidebar'>"])
        return f"<html><head><title>{self._words(1, 5)}</title></head>{body}{page}</body></html>"


def pages(n: int = 1500, seed: int = 0) -> list[tuple[str, list[str]]]:
    """``n`` pages, each with the texts of its content blocks in order."""
    return [(p.html, p.content) for p in (Page(seed + i) for i in range(n))]
