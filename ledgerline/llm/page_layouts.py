"""Labelled pages of many layouts, from which the content model learns together with pages of the corpus.

A page is put together from parts of sites: menus, headers, notices, adverts, sidebars, forms, comments, footers, and one
main text. Elements say by ``data-gold`` whether what is below them is main text, up to the next that says otherwise.
Words are invented, so the model can only learn from structure, names of classes and the shape of texts.
"""

from __future__ import annotations

import random

_SYLLABLES = "an the er in on at re st ed ou ha is it en nd or ti as to ar te le se ou me de co la no ri ro li ca ma si".split()

_MAIN = [
    ("article", ""), ("article", "post"), ("article", "h-entry"), ("main", ""), ("main", "content"), ("div", "content"), ("div", "main-content"), ("div", "post-content"), ("div", "entry-content"), ("div", "entry"),
    ("div", "article-body"), ("div", "story"), ("div", "story-body"), ("section", "article"), ("section", "body-text"), ("div", "text"), ("div", "page-content"), ("div", "blog-post"), ("div", ""), ("td", "main"),
]
_NOT = {
    "menu": ["nav", "nav.navbar", "div.menu", "div.nav", "ul.menu", "div.navigation", "div.top-menu", "div.breadcrumbs", "ol.breadcrumb", "div.pagination", "div.toc", "ul.tabs", "div.toolbar"],
    "header": ["header", "header.site-header", "div.header", "div.masthead", "div.top", "div.page-header", "div.site-title", "div.logo", "div.banner"],
    "footer": ["footer", "footer.site-footer", "div.footer", "div.bottom", "div.copyright", "div.legal", "div.colophon", "section.footer"],
    "sidebar": ["aside", "aside.sidebar", "div.sidebar", "div.side", "div.right-column", "div.widget", "div.secondary", "td.left", "div.related", "section.related-posts", "div.recommended", "div.trending", "div.most-read", "div.tags"],
    "notice": ["div.notice", "div.cookie-notice", "div.cookie-banner", "div.alert", "div.gdpr", "div.consent", "div.warning", "div.message", "div.popup", "div.modal", "div.announcement", "div.disclaimer", "section.notice", "p.notice", "div.paywall", "div.privacy"],
    "advert": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "div.promotion", "div.ad-slot", "section.ad", "aside.ad", "div.adsense", "div.sponsor", "p.ad", "div.banner-ad", "div.commercial"],
    "form": ["form", "form.search", "form.login", "div.newsletter", "div.subscribe", "form.signup", "div.search-box", "form.contact", "div.login", "fieldset", "form.comment-form"],
    "comments": ["div.comments", "section.comments", "div.comment-list", "ol.commentlist", "div.responses", "div.discussion", "div.replies", "section.comment-section", "div.disqus-thread", "div.reader-comments", "ul.comments", "div.feedback"],
    "share": ["div.share", "ul.social", "div.social-links", "div.share-buttons", "div.byline", "div.meta", "p.meta", "div.post-meta", "div.author-box"],
}


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.odd = False

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, least: int, most: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(least, most)))

    def sentence(self) -> str:
        if self.odd:
            return self.r.choice([" | ".join(self.word() for _ in range(self.r.randint(3, 20))), self.words(4, 25), f'{self.word()} = "{self.r.getrandbits(160):x}"'])
        text = self.words(2, 18)
        if self.r.random() < 0.3:
            text += ", " + self.words(2, 8)
        return text.capitalize() + self.r.choice(["."] * 8 + ["?", "!", ":"])

    def prose(self, least: int, most: int) -> str:
        return " ".join(self.sentence() for _ in range(self.r.randint(least, most)))

    def link(self, text: str) -> str:
        return f'<a href="/{self.word()}">{text}</a>'

    def element(self, spec: str, inside: str, gold: int | None = None, cls: str | None = None) -> str:
        tag, _, name = spec.partition(".")
        name = name if cls is None else cls
        named = ""
        if name:
            if self.r.random() < 0.3:
                name = self.r.choice([name.replace("-", "_"), name.title().replace("-", ""), f"{self.word()}-{name}", f"{name} {self.word()}", f"{name}-{self.r.randint(1, 9)}"])
            named = f' {self.r.choice(["class", "class", "id"])}="{name}"'
        mark = "" if gold is None else f' data-gold="{gold}"'
        return f"<{tag}{named}{mark}>{inside}</{tag}>"

    def links(self, bare: bool = False) -> str:
        n, short = self.r.randint(3, 9), self.r.random() < 0.7
        items = [self.link(self.words(1, 2) if short else self.words(3, 9)) for _ in range(n)]
        if bare or self.r.random() < 0.25:
            return self.r.choice([" | ", " ", " &middot; "]).join(items)
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"

    def fields(self) -> str:
        rows = [f'<label>{self.words(1, 3)}</label><input type="text">' for _ in range(self.r.randint(1, 3))]
        text = self.r.choice(["", f"<p>{self.sentence()}</p>", f"<h3>{self.words(1, 4)}</h3>", self.sentence()])
        return text + "".join(rows) + self.r.choice(["", f"<p>{self.prose(1, 2)}</p>", f"<span>{self.words(1, 3)}</span>"])

    def comment(self) -> str:
        head = self.r.choice([f"<b>{self.word()}</b>", f"<span>{self.words(1, 2)}</span> ", f'<div class="author">{self.word()}</div>', ""])
        text = f"{head}{self.r.choice(['<p>%s</p>', '%s', '<div>%s</div>']) % self.prose(1, 5)}"
        return self.element(self.r.choice(["div.comment", "li.comment", "article.comment", "div.reply", "li", "div", "div.comment-body"]), text)

    def boilerplate(self, kind: str) -> str:
        r = self.r
        spec = r.choice(_NOT[kind])
        plain = r.choice([self.prose(1, 4), f"<p>{self.prose(1, 4)}</p>", f"<p>{self.sentence()}</p>{self.link(self.words(1, 4))}"])
        title = r.choice(["", f"<h2>{self.words(1, 4)}</h2>", f"<h3>{self.words(1, 4)}</h3>", f"<h4>{self.words(1, 3)}</h4>"])
        if spec.startswith("p."):
            plain, title = self.prose(1, 3), ""
        inside = {
            "menu": lambda: self.links(spec.startswith(("ul", "ol"))),
            "header": lambda: r.choice([f"<h1>{self.words(1, 3)}</h1>", f"<div>{self.words(1, 4)}</div>", self.link(self.words(1, 3)), self.sentence(), f"<p>{self.sentence()}</p>"]) + r.choice(["", self.links(), self.element("form", self.fields())]),
            "footer": lambda: r.choice([f"&copy; {self.words(1, 4)}", plain, self.links() + plain, f"<p>{self.words(2, 8)}</p>", f"&copy; {self.word()} &middot; {self.prose(1, 3)}"]),
            "sidebar": lambda: title + r.choice([self.links(), plain, self.links() + plain, plain + plain]),
            "notice": lambda: r.choice(["", title]) + plain,
            "advert": lambda: r.choice([plain, self.link(self.prose(1, 2)), title + plain]),
            "form": self.fields,
            "comments": lambda: title + "".join(self.comment() for _ in range(r.randint(1, 5))),
            "share": lambda: r.choice([self.links(True), self.words(2, 6), self.links()]),
        }[kind]()
        return self.element(spec, inside, 0)

    def paragraph(self) -> str:
        r = self.r
        text = self.prose(1, 7) if r.random() < 0.85 else r.choice([self.word().capitalize() + ".", self.words(1, 3), self.words(5, 40)])
        if r.random() < 0.3:
            text = f"{self.sentence()} {r.choice([self.link(self.words(1, 5)), '<b>' + self.word() + '</b>', '<em>' + self.words(1, 3) + '</em>'])} {text}"
        return r.choice([f"<p>{text}</p>"] * 6 + [f"<p>{text}", f"<p><b>{text}<br><p>{self.sentence()}</p>", f"<div>{text}</div>"])

    def main(self) -> str:
        r = self.r
        blocks = [r.choice([f"<h1>{self.words(2, 10)}</h1>"] * 3 + [f"<h2>{self.words(2, 8)}</h2>", ""])]
        for _ in range(r.randint(1, 9)):
            blocks.append(self.paragraph())
            if r.random() < 0.2:
                items = "".join(f"<li>{self.sentence() if r.random() < 0.6 else self.words(1, 8)}</li>" for _ in range(r.randint(2, 6)))
                cells = "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 6)}</td></tr>" for _ in range(r.randint(2, 4)))
                blocks.append(r.choice([f"<h2>{self.words(1, 6)}</h2>", f"<h3>{self.words(1, 6)}</h3>", f"<ul>{items}</ul>", f"<ol>{items}</ol>", f"<blockquote>{self.paragraph()}</blockquote>", f"<pre>{self.words(5, 20)}</pre>", f"<table>{cells}</table>", f'<figure><img src="x"><figcaption>{self.sentence()}</figcaption></figure>']))
        for kind in ("advert", "notice", "share", "form", "comments", "menu", "sidebar", "footer"):
            if r.random() < 0.12:
                blocks.insert(len(blocks) if kind in ("comments", "footer") else r.randint(0, len(blocks)), self.boilerplate(kind))
        tag, name = r.choice(_MAIN)
        return self.element(tag if tag != "td" else "td", "".join(blocks), 1, name)

    def page(self) -> str:
        r = self.r
        part = lambda kind, p: self.boilerplate(kind) if r.random() < p else ""
        before = [part(k, p) for k, p in (("notice", 0.25), ("header", 0.6), ("menu", 0.8), ("advert", 0.4), ("sidebar", 0.2), ("form", 0.1))]
        after = [part(k, p) for k, p in (("share", 0.2), ("sidebar", 0.4), ("advert", 0.25), ("comments", 0.35), ("form", 0.2), ("notice", 0.15), ("menu", 0.15), ("footer", 0.8))]
        self.odd = r.random() < 0.12  # a main text that is no prose
        main = self.main()
        self.odd = False
        if main.startswith("<td"):
            main = f"<table><tr>{self.boilerplate('sidebar') if r.random() < 0.5 else ''}{main}</tr></table>"
        if r.random() < 0.4:
            side = self.boilerplate("sidebar") if r.random() < 0.5 else ""
            main = self.element(r.choice(["div.wrapper", "div.container", "div", "div.row", "section", "div.page", "main"]), main + side)
        body = "".join(before) + main + "".join(after)
        if r.random() < 0.3:
            body = self.element(r.choice(["div.wrapper", "div.container", "div.page", "div"]), body)
        return f'<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title></head><body data-gold="0">{body}' + r.choice(["</body></html>", ""])


def labelled_pages(n: int, seed: int = 0) -> list[str]:
    return [_Writer(seed * 1_000_003 + k).page() for k in range(n)]
