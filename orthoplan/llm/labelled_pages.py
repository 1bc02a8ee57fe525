"""Labelled web pages to train the content model on: generated layouts whose parts are known.

Each page is a list of (html, is_content) pieces, wrapped into one document; a node is content if its start tag stands in
a content piece; a content node's parent is content, too, but for the one that holds all of it. Layouts vary in element names, classes, nesting, order and sloppiness (tags left open). The words
are meaningless on purpose, as the model must not learn any language.
"""

from __future__ import annotations

import random

CONTENT_CLASSES = ["", "", "content", "post", "entry-content", "story-body", "article-text", "main-content", "post-body", "page-content", "text", "articleBody"]
WRAPPERS = ["page", "container", "wrapper", "site", "layout", "row", "inner", "col", "outer", "root", ""]
BOILERPLATE = {
    "menu": ["nav", "navbar", "main-menu", "menu", "top-nav", "breadcrumbs", "site-navigation", "pagination", "tabs", "toc-menu"],
    "header": ["header", "site-header", "masthead", "top-bar", "page-header", "branding", "logo"],
    "footer": ["footer", "site-footer", "bottom", "copyright", "legal", "colophon", "page-footer"],
    "sidebar": ["sidebar", "aside", "side-column", "related", "widget", "recommended", "trending", "more-stories", "teaser", "rail"],
    "notice": ["cookie-notice", "cookie-banner", "consent", "alert", "notice", "gdpr", "popup", "modal", "message", "warning", "announcement", "paywall"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "banner-ad", "ad-slot", "adsbox", "promotion"],
    "form": ["form", "newsletter", "subscribe", "signup", "login", "search-form", "search", "contact-form"],
    "comments": ["comments", "comment-list", "comment", "replies", "discussion", "responses", "reader-comments", "disqus", "feedback"],
    "share": ["share", "social", "social-links", "tags", "meta-links"],
}
ROLES = {"menu": "navigation", "header": "banner", "footer": "contentinfo", "sidebar": "complementary", "notice": "alert", "form": "search", "ad": "", "comments": "", "share": ""}
TAGS = {"menu": ["nav", "ul", "div"], "header": ["header", "div"], "footer": ["footer", "div"], "sidebar": ["aside", "div", "section"], "notice": ["div", "section", "p", "dialog"], "ad": ["div", "aside", "ins", "section", "p"], "form": ["form", "form", "div"], "comments": ["section", "div", "ol", "ul"], "share": ["div", "ul"]}


class Page:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)
        self.longest = self.rng.choice([12, 30, 120, 120])  # words of a paragraph
        self.plain = self.rng.random() < 0.2  # a page without punctuation
        self.pieces: list[tuple[str, bool]] = []

    def words(self, low: int, high: int) -> str:
        r = self.rng
        out = ["".join(r.choice("aeiou") + r.choice("bcdfglmnprst") for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        if self.plain:
            return " ".join(out)
        for i in range(r.randint(6, 12), len(out), r.randint(8, 14)):
            out[i] += r.choice([".", ",", "."])
        return " ".join(out).capitalize() + r.choice([".", ".", ".", "!", "?", ""])

    def put(self, html: str, content: bool) -> None:
        self.pieces.append((html, content))

    def attributes(self, kind: str) -> str:
        name = self.rng.choice(BOILERPLATE[kind])
        role = f' role="{ROLES[kind]}"' if ROLES[kind] and self.rng.random() < 0.15 else ""
        return self.rng.choice([f' class="{name}"', f' id="{name}"', f' class="{name} clearfix"', f' class="{name}" id="{name}-1"']) + role

    def links(self, n: int) -> str:
        items = "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(n))
        return self.rng.choice([f"<ul>{items}</ul>", items.replace("<li>", "").replace("</li>", " ")])

    def boilerplate(self, kind: str) -> None:
        r = self.rng
        tag = r.choice(TAGS[kind])
        telling = tag in ("nav", "header", "footer", "aside", "form")
        attributes = "" if telling and r.random() < 0.6 else self.attributes(kind)
        if kind in ("menu", "share"):
            body = self.links(r.randint(3, 8))
        elif kind == "header":
            body = r.choice(["", f"<img src='l.png'><h1>{self.words(1, 3)}</h1>"]) + r.choice([f"<p>{self.words(2, 12)}</p>", f'<a href="/">{self.words(1, 2)}</a>', f"<div>{self.words(1, 6)}</div>" + self.links(3)])
        elif kind == "footer":
            body = r.choice([f"&copy; {self.words(3, 20)}", f"<p>{self.words(5, 30)}</p>", self.links(4) + f"<p>&copy; {self.words(2, 12)}</p>"])
        elif kind == "sidebar":
            body = f"<h3>{self.words(1, 3)}</h3>" + r.choice([self.links(5), f"<p>{self.words(8, 40)}</p>", f"<p>{self.words(10, 30)}</p>{self.links(2)}", f"<div>{self.words(6, 25)}</div>"])
        elif kind == "form":
            body = r.choice([f"<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 1)}</button>", f"<p>{self.words(5, 25)}</p><input type=email><button>{self.words(1, 2)}</button>", f"<label>{self.words(1, 2)}</label><textarea>{self.words(0, 3)}</textarea><select><option>{self.words(1, 1)}<option>{self.words(1, 1)}</select>"])
        elif kind == "comments":
            inner = r.choice(["div", "li", "article", "p"])
            body = f"<h2>{self.words(1, 3)}</h2>" * r.randint(0, 1)
            for _ in range(r.randint(1, 5)):
                name = r.choice(['', ' class="comment"', ' class="reply"', ' class="comment-body"'])
                body += f"<{inner}{name}>" + r.choice([f"<b>{self.words(1, 2)}</b> ", f"<cite>{self.words(1, 2)}</cite>", ""]) + (self.words(5, 60) if inner == "p" else f"<p>{self.words(5, 60)}</p>") + f"</{inner}>"
        else:
            body = r.choice([self.words(3, 30), f"<p>{self.words(4, 40)}</p>", f"<a href='/x'>{self.words(2, 9)}</a>", f"{self.words(3, 25)} <button>{self.words(1, 1)}</button>", f"<b>{self.words(1, 3)}</b><span>{self.words(4, 20)}</span>"])
        if tag == "p" and "<p>" in body:  # no paragraph stands in another
            body = body.replace("<p>", "").replace("</p>", "")
        self.put(f"<{tag}{attributes}>{body}</{tag}>", False)

    def paragraph(self) -> None:
        r = self.rng
        text = self.words(2, self.longest) if r.random() < 0.95 else self.words(200, 700)
        if r.random() < 0.35:
            at = r.randrange(len(text) + 1)
            text = text[:at] + r.choice([f' <a href="/w">{self.words(1, 4)}</a> ', f" <b>{self.words(1, 9)}</b> ", f" <em>{self.words(1, 3)}</em>", f" <span>{self.words(1, 5)}</span>", "<br>"]) + text[at:]
        kind = r.random()
        if kind < 0.72:
            end = r.choice(["</p>", "</p>", "</p>", ""])
            self.put(f"<p{r.choice(['', '', '', ' class=lead', ' class=p1'])}>{text}{end}\n", True)
        elif kind < 0.78:
            self.put("<ul>" + "".join(f"<li>{self.words(2, 30)}</li>" for _ in range(r.randint(2, 5))) + "</ul>", True)
        elif kind < 0.83:
            self.put(f"<blockquote><p>{text}</p></blockquote>", True)
        elif kind < 0.87:
            self.put(f"<figure><img src=x><figcaption>{self.words(3, 14)}</figcaption></figure>", True)
        elif kind < 0.9:
            self.put("<table>" + "".join(f"<tr><td>{self.words(1, 4)}<td>{self.words(1, 4)}" for _ in range(3)) + "</table>", True)
        elif kind < 0.95:
            self.put(f"<h{(k := r.randint(2, 4))}>{self.words(2, 7)}</h{k}>", True)
        else:
            self.put(f"<div>{text}</div>", True)

    def article(self, inner: list[str]) -> None:
        r = self.rng
        if r.random() < 0.8:
            h = r.choice([f"<h1>{self.words(2, 14)}</h1>", f'<h1 class="title">{self.words(2, 14)}</h1>', f"<h2>{self.words(2, 12)}</h2>"])
            self.put(h, True)
        sloppy = r.random() < 0.3
        if sloppy:
            self.put(f"<p><b>{self.words(5, 40)}<br>", True)
        n = r.choice([1, 2, 3, 3, 5, 9, 15, 60])
        for i in range(n):
            self.paragraph()
            if inner and r.random() < 0.25:
                self.boilerplate(r.choice(inner))


def page(seed: int) -> list[tuple[str, bool]]:
    """The pieces of one labelled page."""
    p = Page(seed)
    r = p.rng
    p.put(f"<!DOCTYPE html><html><head><meta charset=utf-8><title>{p.words(2, 9)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head>", False)
    wraps = [r.choice(WRAPPERS) for _ in range(r.choice([0, 0, 1, 2]))]
    shape = r.choice(["article", "article", "article", "main", "main", "main-article", "div", "div", "div", "section", "td", "bare"])
    frames = ["<body>"] + [f'<div class="{w}">' if w else "<div>" for w in wraps]
    for k, frame in enumerate(frames):  # without an element of its own, the innermost frame is the content
        p.put(frame, shape == "bare" and k == len(wraps))
    before, after = ["header", "menu", "notice", "ad", "form", "sidebar", "share"], ["sidebar", "comments", "footer", "ad", "form", "menu", "notice", "share"]
    for kind in r.sample(before, r.randint(0, 4)):
        p.boilerplate(kind)
    name = r.choice(CONTENT_CLASSES)
    attributes = f' class="{name}"' if name else ""
    opened = []
    if shape == "main-article":
        p.put("<main>", False)
        opened.append("main")
    tag = {"main-article": "article", "bare": None}.get(shape, shape)
    if tag == "td":
        p.put("<table><tr>", False)
        opened += ["table"]
    if tag:
        p.put(f"<{tag}{attributes if tag != 'article' or r.random() < 0.3 else ''}>", True)
    if tag == "div" and r.random() < 0.3:
        p.put("<div>", True)
        opened.append("div")
    p.article(["ad", "share", "notice", "form", "sidebar", "menu", "comments"] if r.random() < 0.5 else [])
    if tag and r.random() < 0.2:
        p.boilerplate(r.choice(["comments", "share", "form", "footer"]))
    p.put("".join(f"</{t}>" for t in ([tag] if tag else []) + opened[::-1]), False)
    for kind in r.sample(after, r.randint(0, 5)):
        p.boilerplate(kind)
    p.put("</div>" * len(wraps) + "</body></html>", False)
    return p.pieces
