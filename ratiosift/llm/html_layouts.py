"""Made-up web pages with known main text, on which the node classifier of ``html_text`` is trained.

No labelled pages exist among the tables, so pages are drawn from many usual layouts: with semantic tags, with telling
class names, with meaningless ones and with none. The first character of each block of main text is ``MARK``.
"""

from __future__ import annotations

import random

MARK = "\ue000"

_SYLLABLES = "ba co da en fi ga ho il ka lo me no or pa qui ra so te un vo wa xe yo zi the ing tion er".split()
#: Names that sites give to the parts of their pages.
_NAMES = {
    "nav": "nav navbar menu main-menu navigation topnav site-nav nav-links",
    "header": "header site-header masthead top-bar page-header banner-top",
    "footer": "footer site-footer bottom page-footer colophon",
    "side": "sidebar side aside rail right-col widget-area widgets",
    "ad": "ad ads advert advertisement sponsor sponsored promo banner-ad",
    "comment": "comments comment-list reader-comments discussion responses disqus replies",
    "notice": "cookie cookie-notice consent notice alert gdpr popup newsletter-popup",
    "more": "related share social recommended more-stories tags breadcrumbs pagination",
    "form": "login search subscribe signup newsletter contact-form",
    "main": "article content post entry story main-content post-body article-body entry-content main text",
}
_TAGS = {"nav": "nav", "header": "header", "footer": "footer", "side": "aside", "form": "form", "comment": "section", "main": "article"}


class Page:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.style = self.r.choice(["tags", "names", "both", "both", "names", "plain"])

    def word(self) -> str:
        return "".join(self.r.choices(_SYLLABLES, k=self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def prose(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            s = self.words(3, 18)
            if self.r.random() < 0.4:
                s = s.replace(" ", ", ", 1)
            out.append(s.capitalize() + self.r.choice("....?!"))
        text = " ".join(out)
        if self.r.random() < 0.25:
            text = text.replace(" ", f" <{(t := self.r.choice(['b', 'em', 'a href=\"/x\"', 'span']))}>", 1) + f"</{t.split()[0]}>"
        return text

    def open(self, kind: str) -> tuple[str, str]:
        tag = _TAGS.get(kind, "div") if self.style in ("tags", "both") and self.r.random() < 0.85 else self.r.choice(["div", "div", "div", "section", "td"])
        tag = "div" if tag == "td" else tag
        name = ""
        if self.style in ("names", "both") and self.r.random() < 0.85:
            name = f' {self.r.choice(["class", "class", "id"])}="{self.r.choice(_NAMES[kind].split())}"'
        elif self.r.random() < 0.2:
            name = f' class="css-{self.word()}"'
        return f"<{tag}{name}>", f"</{tag}>"

    def around(self, kind: str, inner: str) -> str:
        a, b = self.open(kind)
        return a + inner + b

    def links(self, low: int = 2, high: int = 9) -> str:
        n = self.r.randint(low, high)
        if self.r.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/{self.word()}">{self.words(1, 3)}</a></li>' for _ in range(n)) + "</ul>"
        return self.r.choice([" ", " | "]).join(f'<a href="/{self.word()}">{self.words(1, 2)}</a>' for _ in range(n))

    def ad(self) -> str:
        return self.around("ad", self.r.choice([self.prose(1, 2), f'<a href="/buy">{self.words(2, 8)}</a>', f"<p>{self.prose(1, 3)}</p>"]))

    def comments(self) -> str:
        one = lambda: self.r.choice([f"<p>{self.prose(1, 4)}</p>", f"<div><b>{self.word()}</b><p>{self.prose(1, 3)}</p></div>", f"<li>{self.prose(1, 3)}</li>"])
        return self.around("comment", f"<h3>{self.words(1, 3)}</h3>" + "".join(one() for _ in range(self.r.randint(1, 6))))

    def form(self) -> str:
        return self.around("form", f"<{'form' if self.r.random() < 0.6 else 'div'}><label>{self.words(1, 3)}</label><input name=q><p>{self.prose(1, 1)}</p><button>Go</button>" + "</form>")

    def block(self) -> str:
        k = self.r.random()
        if k < 0.75:
            return f"<p>{MARK}{self.prose(1, 7)}" + ("</p>" if self.r.random() < 0.9 else "")
        if k < 0.82:
            return f"<h{self.r.choice('23')}>{MARK}{self.words(2, 8)}</h{self.r.choice('23')}>"
        if k < 0.89:
            return "<ul>" + "".join(f"<li>{MARK}{self.prose(1, 2)}</li>" for _ in range(self.r.randint(2, 5))) + "</ul>"
        if k < 0.94:
            return f"<blockquote>{MARK}{self.prose(1, 3)}</blockquote>"
        return f"<table><tr><td>{MARK}{self.words(1, 5)}</td><td>{MARK}{self.words(1, 5)}</td></tr></table>"

    def main(self) -> str:
        title = f"<h1>{MARK}{self.words(2, 10)}</h1>"
        if self.r.random() < 0.15:
            title = f"<header>{title}</header>"
        inner = [self.block() for _ in range(self.r.choice([0, 1, 1, 2, 3, 5, 8, 15]))]
        if self.r.random() < 0.15 or not inner:
            inner.insert(0, f"<p>{MARK}{self.words(1, 6).capitalize()}.</p>")
        for made, chance in ((self.ad, 0.2), (lambda: self.around("more", self.links(2, 5)), 0.15), (self.form, 0.05), (lambda: self.around("notice", f"<p>{self.prose(1, 2)}</p>"), 0.08)):
            if self.r.random() < chance:
                inner.insert(self.r.randint(0, len(inner)), made())
        if self.r.random() < 0.15:
            inner.append(self.comments())
        body = (title if self.r.random() < 0.85 else "") + "".join(inner)
        for _ in range(self.r.choice([1, 1, 1, 2, 3])):
            body = self.around("main", body)
        return body

    def html(self) -> str:
        r = self.r
        top, bottom = [], []
        if r.random() < 0.5:
            top.append(self.around("header", r.choice([f"<a href=/>{self.words(1, 3)}</a>", f"<h2>{self.words(1, 4)}</h2><p>{self.words(2, 6)}</p>", self.links()])))
        if r.random() < 0.8:
            top.append(self.around("nav", self.links()))
        for made, chance in ((lambda: self.around("notice", f"<p>{self.prose(1, 2)}</p>"), 0.3), (self.ad, 0.5), (lambda: self.around("more", self.links(2, 4)), 0.2)):
            if r.random() < chance:
                top.append(made())
        r.shuffle(top)
        side = self.around("side", "".join(r.choice([self.links, lambda: f"<h4>{self.words(1, 3)}</h4>" + self.links(), lambda: f"<p>{self.prose(1, 2)}</p>"])() for _ in range(r.randint(1, 3))))
        middle = [self.main()]
        if r.random() < 0.5:
            middle.insert(r.randint(0, 1), side)
        if r.random() < 0.4:
            bottom.append(self.comments())
        for made, chance in ((lambda: self.around("more", f"<h3>{self.words(1, 3)}</h3>" + self.links()), 0.35), (self.form, 0.3), (self.ad, 0.2), (lambda: self.around("notice", f"<p>{self.prose(1, 3)}</p>"), 0.15)):
            if r.random() < chance:
                bottom.append(made())
        if r.random() < 0.85:
            bottom.append(self.around("footer", r.choice([f"&copy; {self.word()} &middot; {self.prose(1, 2)}", f"<p>{self.prose(1, 2)}</p>" + self.links(), self.links()])))
        whole = "".join(top + middle + bottom)
        if r.random() < 0.3:
            whole = f'<div class="{r.choice(["wrapper", "page", "container", "site"])}">{whole}</div>'
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title><style>p{{margin:0}}</style></head><body>{whole}</body></html>"


def pages(n: int, seed: int = 0) -> list[str]:
    return [Page(seed * 1_000_003 + k).html() for k in range(n)]
