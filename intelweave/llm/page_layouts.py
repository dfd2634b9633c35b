"""Training pages for the block labeller: sampled texts dressed in varied layouts, with known labels.

Real pages of one corpus share few layouts, and a model that saw those alone would know little of others.
So the texts of a bounded sample are put into layouts drawn from the names below: an article somewhere, and
before, inside and behind it what pages carry besides. Most of that is worded like an article, so that the
element, its names and its surroundings decide; some of it bears no telling name, so that wording decides.
"""

from __future__ import annotations

import random

from intelweave.llm.html_blocks import Paths, blocks_of

KEEP = ""  # stands before the text of blocks to be kept

# Names by which pages mark their parts, and phrases of those parts.
ARTICLE = "content main article post entry story text body page single blog news".split()
MENU = "nav navbar menu navigation breadcrumb breadcrumbs tabs links pagination pager skip".split()
HEAD = "header masthead topbar logo brand banner top site title tagline".split()
FOOT = "footer copyright legal bottom colophon imprint credits disclaimer".split()
SIDE = "sidebar aside widget related recommended popular trending more archive tags categories".split()
NOTICE = "cookie cookies consent gdpr notice alert message popup modal overlay dialog warning announcement privacy".split()
ADVERT = "ad ads advert advertisement adsense sponsored sponsor promo promotion banner partner offer commercial".split()
FORM = "form newsletter subscribe signup login search contact register subscription".split()
COMMENTS = "comments comment replies reply discussion respond disqus reviews thread reader feedback".split()
SHARE = "share social sharing follow buttons tools meta byline toolbar".split()
PHRASES = {
    "notice": ["We use cookies to improve this site.", "Accept all cookies", "Diese Seite verwendet Cookies.", "Ce site utilise des cookies.", "Este sitio usa cookies."],
    "advert": ["Advertisement", "Sponsored", "Anzeige", "Publicité", "Publicidad", "Buy now and save!"],
    "form": ["Your name", "E-mail address", "Subscribe to our newsletter", "Search", "Send", "Password", "Name", "Log in"],
    "foot": ["© 2024 {x}", "Privacy policy", "Terms of use", "Impressum", "{x} © 2021 · {y}"],
    "share": ["Share", "Tweet", "Print", "Follow us", "By {x}", "Posted on May 4", "Read more"],
    "comments": ["{x} says:", "Reply", "2 comments", "Leave a comment", "Comments", "{x}, 3 days ago"],
    "menu": ["Home", "About", "Contact", "News", "Start", "Kontakt", "Accueil", "Inicio"],
}


def filler(rng: random.Random, n: int) -> str:
    """Sentences of made-up words, where a sample holds no texts."""
    parts = "ar be con de el fi go ha in ju ka lo mi no os pe qui ra so ter un ve".split()
    out, fresh = [], True
    for _ in range(n):
        w = "".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        w, fresh = (w.capitalize() if fresh else w), False
        if rng.random() < 0.12:
            w, fresh = w + ".", True
        out.append(w)
    return " ".join(out)


class Dresser:
    """Draws pages; equal seeds and texts give equal pages."""

    def __init__(self, texts: list[str], seed: int) -> None:
        self.rng = random.Random(seed)
        self.words = [t.split() for t in texts]
        self.lengthy = 0.8  # share of long texts on the page

    def text(self, low: int, high: int) -> str:
        r = self.rng
        n = r.randint(low, high)
        if not self.words or r.random() < 0.1:
            return filler(r, n)
        words = r.choice(self.words)
        at = r.randint(0, max(len(words) - n, 0)) if r.random() < 0.5 else 0
        return " ".join(words[at:at + n])

    def long(self) -> str:
        return self.text(15, 120) if self.rng.random() < self.lengthy else self.text(1, 15)

    def phrase(self, kind: str) -> str:
        return self.rng.choice(PHRASES[kind]).format(x=self.text(1, 2), y=self.text(2, 6))

    def named(self, names: list[str], tags: list[str], certain: bool = False) -> tuple[str, str]:
        """Opening and closing tag; a telling tag may do without a name."""
        r = self.rng
        tag = r.choice(tags)
        if not certain and tag not in ("div", "section", "p", "ul", "span", "td") and r.random() < 0.5:
            return f"<{tag}>", f"</{tag}>"
        name = r.choice(names)
        extra = r.choice(["", "", "", "-box", "-wrapper", "_1", " block", " col-8", "-area", "-inner", " widget" if names is not ARTICLE else " wide"])
        lead = r.choice(["", "", "", "site-", "page-", "js-", "the-"])
        name = lead + name + extra
        if r.random() < 0.1:
            name = name.title().replace("-", "")
        return f'<{tag} {r.choice(["class", "class", "class", "id"])}="{name}">', f"</{tag}>"

    def items(self, kind: str | None, n: int, links: bool, tag: str = "li") -> str:
        out = []
        for _ in range(n):
            t = self.phrase(kind) if kind and self.rng.random() < 0.3 else self.text(1, 5)
            t = f'<a href="/x">{t}</a>' if links else t
            out.append(f"<{tag}>{t}" + ("" if self.rng.random() < 0.05 else f"</{tag}>"))
        return "".join(out)

    def prose(self, low: int, high: int) -> str:
        tag = "p" if self.rng.random() < 0.8 else "div"
        return "".join(f"<{tag}>{self.long()}</{tag}>" for _ in range(self.rng.randint(low, high)))

    def part(self, kind: str) -> str:
        """One part besides the article."""
        r = self.rng
        if kind == "menu":
            a, b = self.named(MENU, ["nav", "nav", "div", "ul"])
            body = self.items("menu", r.randint(2, 9), True) if a.startswith("<ul") else f"<ul>{self.items('menu', r.randint(2, 9), True)}</ul>"
            if r.random() < 0.15:
                body = self.items("menu", r.randint(2, 9), True, "div")
        elif kind == "head":
            a, b = self.named(HEAD, ["header", "div"])
            body = r.choice([f"<h1>{self.text(1, 4)}</h1>", f"<h1>{self.text(1, 4)}</h1><p>{self.text(2, 9)}</p>", f"<div>{self.text(1, 6)}</div>", f"<p>{self.text(3, 25)}</p>"]) + (self.part("menu") if r.random() < 0.4 else "")
        elif kind == "foot":
            a, b = self.named(FOOT, ["footer", "footer", "div"])
            body = r.choice([self.phrase("foot"), f"<p>{self.phrase('foot')}</p>", f"<p>{self.long()}</p>", f"<ul>{self.items('foot', r.randint(2, 6), True)}</ul>", f"&copy; {self.text(1, 3)} &middot; {self.long()}"])
        elif kind == "side":
            a, b = self.named(SIDE, ["aside", "div", "section"])
            body = f"<h{r.randint(2, 4)}>{self.text(1, 4)}</h3>" + r.choice([f"<ul>{self.items(None, r.randint(2, 8), True)}</ul>", self.prose(1, 3), f"<p>{self.text(5, 30)}</p>"])
        elif kind == "notice":
            a, b = self.named(NOTICE, ["div", "div", "section", "dialog", "p"])
            body = r.choice([self.phrase("notice"), self.long(), f"<p>{self.phrase('notice')} {self.text(3, 30)}</p>"])
        elif kind == "advert":
            a, b = self.named(ADVERT, ["div", "div", "section", "p", "aside"])
            body = r.choice([self.long(), self.text(2, 12), self.phrase("advert"), self.prose(1, 2), f"<a href=x>{self.text(2, 10)}</a>"])
        elif kind == "form":
            a, b = self.named(FORM, ["form", "form", "div"])
            body = f"<p>{self.phrase('form')}</p>" + r.choice([f"<label>{self.text(1, 3)}</label><input>", f"<div>{self.phrase('form')}</div><div>{self.text(1, 20)}</div>", self.prose(1, 1), f"<fieldset><legend>{self.text(1, 4)}</legend>{self.text(1, 9)}</fieldset>"])
        elif kind == "share":
            a, b = self.named(SHARE, ["div", "ul", "p"])
            body = f"<li>{self.phrase('share')}</li><li>{self.phrase('share')}</li>" if a.startswith("<ul") else self.phrase("share") + " " + self.text(1, 3)
        else:
            a, b = self.named(COMMENTS, ["div", "section", "ol", "aside"], certain=True)
            each = r.choice(["div", "li", "article", "section"])
            name = f' class="{r.choice(COMMENTS)}"' if r.random() < 0.7 else ""
            body = f"<h3>{self.phrase('comments')}</h3>" if r.random() < 0.6 else ""
            for _ in range(r.randint(1, 6)):
                who = r.choice(["", f"<p>{self.phrase('comments')}</p>", f"<b>{self.text(1, 2)}</b>", f"<h4>{self.text(1, 2)}</h4>"])
                body += f"<{each}{name}>{who}{self.prose(1, 3)}</{each}>"
        return a + (self.long() if a.startswith("<p") else body) + b  # a paragraph holds no blocks

    def article(self) -> str:
        """An article; each of its blocks begins with ``KEEP``."""
        r = self.rng
        a, b = self.named(ARTICLE, ["article", "article", "article", "main", "div", "div", "section", "td"])
        if a.startswith("<td"):
            a, b = "<table><tr>" + a, b + "</tr></table>"
        out = [f"<h1>{KEEP}{self.text(1, 12)}</h1>"] if r.random() < 0.8 else []
        bare = r.random() < 0.08
        again = ""
        for i in range(r.choice([r.randint(1, 4), r.randint(2, 22), r.randint(2, 22), r.randint(10, 50)])):
            u = r.random()
            t = KEEP + (self.long() if r.random() < 0.95 else self.phrase(r.choice(list(PHRASES))))
            if again and r.random() < 0.9:
                out.append(f"<p>{again}</p>")
                continue
            again = t if r.random() < 0.03 else ""
            if bare:
                out.append(f"<div>{t}</div>")
            elif u < 0.72:
                out.append(f"<p>{t}</p>")
            elif u < 0.78:
                out.append(f"<p><b>{t}<br>" if r.random() < 0.7 else f"<p>{t}")
            elif u < 0.82:
                out.append(f"<h{r.randint(2, 4)}>{KEEP}{self.text(1, 9)}</h3>")
            elif u < 0.86:
                tag = r.choice(["ul", "ol"])
                out.append(f"<{tag}>" + "".join(f"<li>{KEEP}{self.text(2, 25)}</li>" for _ in range(r.randint(2, 5))) + f"</{tag}>")
            elif u < 0.89:
                out.append(f"<blockquote>{t}</blockquote>" if r.random() < 0.5 else f"<blockquote><p>{t}</p></blockquote>")
            elif u < 0.91:
                out.append(f"<table><tr><td>{KEEP}{self.text(1, 6)}</td><td>{KEEP}{self.text(1, 6)}</td></tr></table>")
            elif u < 0.93:
                out.append(f"<pre>{t}</pre>")
            elif u < 0.95:
                out.append(f"<figure><figcaption>{KEEP}{self.text(3, 15)}</figcaption></figure>")
            elif i:
                out.append(self.part(r.choice(["advert", "advert", "advert", "notice", "share", "form", "side", "menu"])))
            else:
                out.append(f"<p>{t}</p>")
        if r.random() < 0.3:
            out.append(f"<p>{KEEP}{self.text(1, 6)}</p>")
        tail = ""
        if r.random() < 0.25:
            tail = "".join(self.part(k) for k in ("share", "comments", "side") if r.random() < 0.5)
        return a + "".join(out) + tail + b

    def page(self) -> str:
        r = self.rng
        self.lengthy = r.choice([0.1, 0.5, 0.8, 0.95])
        front = [k for k, p in (("notice", 0.3), ("head", 0.4), ("menu", 0.7), ("advert", 0.4), ("form", 0.15), ("side", 0.15)) if r.random() < p]
        back = [k for k, p in (("share", 0.2), ("comments", 0.4), ("side", 0.4), ("advert", 0.25), ("form", 0.2), ("notice", 0.15), ("foot", 0.8)) if r.random() < p]
        if r.random() < 0.3:
            r.shuffle(front)
        parts = [*map(self.part, front), self.article(), *map(self.part, back)]
        body = "".join(parts)
        for _ in range(r.choice([0, 0, 1, 2])):
            body = f'<div{r.choice(["", " class=container", " id=page", " class=row", " class=wrapper"])}>{body}</div>'
        return f"<html><head><title>{self.text(1, 5)}</title></head><body>{body}</body></html>"


def labelled(html: str, paths: Paths) -> tuple[list[tuple[str, int, int]], list[int]]:
    """Blocks of a dressed page, without the marks, and their labels."""
    found = blocks_of(html, paths)
    labels = [int(KEEP in t) for t, _, _ in found]
    return [(t.replace(KEEP, ""), node, links) for t, node, links in found], labels
