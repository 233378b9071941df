"""Made-up pages with known main text, on which the extractor is trained. data-y marks what is kept (1) and dropped (0)."""

from __future__ import annotations

import numpy as np

#: Names that pages give to their parts.
NAMES = {
    "nav": "nav navbar navigation menu main-menu top-menu site-nav topbar breadcrumb breadcrumbs pagination pager toc tabs skip-link nav-links primary-menu dropdown mega-menu toolbar",
    "header": "header site-header masthead page-header logo branding top-header banner site-branding",
    "footer": "footer site-footer page-footer bottom copyright footer-links colophon legal credits site-info",
    "side": "sidebar side aside widget widgets widget-area related related-posts recommended popular trending most-read tag-cloud tags archive recent-posts author-box rail right-rail secondary read-more see-also",
    "ad": "ad ads advert adverts advertisement ad-slot ad-banner sponsored sponsor promo promotion promoted adsense ad-container commercial dfp partner outbrain taboola affiliate",
    "notice": "notice cookie cookies cookie-banner consent cookie-consent gdpr alert popup modal newsletter subscribe subscription signup paywall notification disclaimer privacy overlay callout-subscribe warning message toast",
    "comments": "comments comment comment-list comment-body comments-area discussion disqus replies reply respond reader-comments user-comments thread feedback responses",
    "share": "share sharing social social-links share-buttons follow like-buttons addthis sociable tweet print-tools",
    "form": "search search-form login contact-form subscribe-form form signin searchbox poll survey",
    "main": "content main main-content article article-body post post-content entry entry-content story story-body body text body-text article-content page-content blog-post single hentry copy prose markdown rich-text",
}
VALUES = {k: v.split() for k, v in NAMES.items()}
_SOUND = "an be ca de er fo ga hi in jo ka le ma no or pe qu ra se ti un ve wo xi za the and ing tion er es la el die der un que é ü ñ".split()


class Page:
    def __init__(self, rng: np.random.Generator) -> None:
        self.rng = rng
        self.named = rng.random() < 0.8  # pages whose parts have names
        self.semantic = rng.random() < 0.6  # pages with nav, article, footer
        self.sloppy = rng.random() < 0.3  # unclosed elements
        self.bare = rng.random() < 0.15  # pages whose article has no element of its own

    def odds(self, p: float) -> bool:
        return self.rng.random() < p

    def pick(self, xs):
        return xs[int(self.rng.integers(len(xs)))]

    def word(self) -> str:
        return "".join(self.pick(_SOUND) for _ in range(int(self.rng.integers(1, 5))))

    def words(self, low: int, high: int) -> str:
        n = int(np.exp(self.rng.uniform(np.log(low), np.log(high + 1))))
        return " ".join(self.word() for _ in range(max(1, n)))

    def prose(self, low: int = 1, high: int = 90) -> str:
        out = []
        for w in self.words(low, high).split():
            out.append(w + self.pick(["", "", "", "", "", ",", ".", ". ", " &amp;"]))
        text = " ".join(out).strip() + self.pick([".", ".", ".", "", "!"])
        if self.odds(0.25):
            at = text.find(" ", len(text) // 2)
            if at > 0:
                tag = self.pick(["b", "em", "a href=\"#\"", "i", "strong", "code", "span", 'span class="x"'])
                text = f"{text[:at]} <{tag}>{self.word()}</{tag.split()[0]}>{text[at:]}"
        return text

    def name(self, kind: str) -> str:
        if not self.named or self.odds(0.12):
            return "" if self.odds(0.6) else f' class="{self.word()}"'
        attribute = self.pick(["class", "class", "class", "id"])
        value = self.pick(VALUES[kind])
        if self.odds(0.2):
            value += f" {self.word()}"
        return f' {attribute}="{value}"'

    def box(self, kind: str, inside: str, tag: str, keep: int) -> str:
        return f'<{tag}{self.name(kind)} data-y="{keep}">{inside}</{tag}>'

    def links(self, low: int, high: int) -> str:
        n = int(self.rng.integers(low, high))
        items = [f'<a href="/{self.word()}">{self.words(1, 4)}</a>' for _ in range(n)]
        style = self.rng.random()
        if style < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return self.pick([" | ", " ", " &middot; "]).join(items) if style < 0.85 else "".join(f"<p>{x}</p>" for x in items)

    def navigation(self) -> str:
        return self.box("nav", self.links(2, 12), "nav" if self.semantic and self.odds(0.8) else self.pick(["div", "ul", "div", "td"][:3]), 0)

    def advert(self) -> str:
        inside = self.pick([lambda: self.prose(2, 25), lambda: f"<p>{self.prose(2, 20)}</p>", lambda: f'<a href="#">{self.words(1, 8)}</a>', lambda: f"<h4>{self.words(1, 4)}</h4><p>{self.prose(3, 20)}</p>"])()
        return f'<div class="{self.pick(VALUES["ad"])}" data-y="0">{inside}</div>' if self.odds(0.85) else self.box("ad", inside, self.pick(["div", "aside", "section"]), 0)

    def notice(self) -> str:
        inside = f"<p>{self.prose(4, 35)}</p>" if self.odds(0.6) else self.prose(4, 30)
        if self.odds(0.5):
            inside += f"<button>{self.word()}</button>"
        return f'<{(tag := self.pick(["div", "div", "section", "aside", "p", "dialog"]))} {self.pick(["class", "id"])}="{self.pick(VALUES["notice"])}" data-y="0">{inside}</{tag}>'

    def side(self) -> str:
        parts = []
        for _ in range(int(self.rng.integers(1, 4))):
            head = f"<{(t := self.pick(['h3', 'h2', 'h4', 'p']))}>{self.words(1, 4)}</{t}>"
            parts.append(self.box("side", head + self.pick([lambda: self.links(2, 8), lambda: f"<p>{self.prose(3, 30)}</p>"])(), self.pick(["div", "section"]), 0))
        return self.box("side", "".join(parts), "aside" if self.semantic and self.odds(0.8) else "div", 0)

    def comments(self) -> str:
        said = []
        for _ in range(int(self.rng.integers(1, 6))):
            by = f'<{(t := self.pick(["b", "span", "h4", "div", "cite"]))}>{self.words(1, 2)}</{t}>'
            said.append(f'<{(t := self.pick(["div", "li", "article", "p"]))}{self.name("comments")}>{by} {self.prose(3, 60) if t == "p" else "<p>" + self.prose(3, 60) + "</p>"}</{t}>')
        body = "".join(said)
        if self.odds(0.5):
            body = f"<h3>{self.words(1, 3)}</h3>" + body
        if self.odds(0.4):
            body += self.form()
        return f'<{(t := self.pick(["div", "section", "div", "ol", "aside"]))} {self.pick(["class", "id"])}="{self.pick(VALUES["comments"])}" data-y="0">{body}</{t}>'

    def form(self) -> str:
        fields = "".join(f"<label>{self.words(1, 3)}</label><input name=q>" for _ in range(int(self.rng.integers(1, 4))))
        if self.odds(0.4):
            fields = f"<p>{self.prose(2, 20)}</p>" + fields
        return f'<form{self.name("form")} data-y="0">{fields}<button>{self.word()}</button></form>'

    def footer(self) -> str:
        inside = self.pick(["&copy; ", "", "&copy; 2020 "]) + self.words(1, 6)
        if self.odds(0.5):
            inside += " &middot; " + self.prose(2, 15)
        if self.odds(0.5):
            inside = f"<p>{inside}</p>" + (self.links(2, 8) if self.odds(0.5) else "")
        return self.box("footer", inside, "footer" if self.semantic or self.odds(0.4) else "div", 0)

    def paragraph(self) -> str:
        kind = self.rng.random()
        if kind < 0.74:
            text = self.prose(1, 120)
            if self.odds(0.1):
                text = text.replace(". ", ".<br>", 2)
            if self.odds(0.04):
                text = "<b>" + text
            return f"<p>{text}" + ("" if self.sloppy and self.odds(0.6) else "</p>")
        if kind < 0.82:
            return f"<{(t := self.pick(['h2', 'h3', 'h4']))}>{self.words(1, 8)}</{t}>"
        if kind < 0.88:
            return f"<{(t := self.pick(['ul', 'ol']))}>" + "".join(f"<li>{self.prose(1, 20)}</li>" for _ in range(int(self.rng.integers(2, 6)))) + f"</{t}>"
        if kind < 0.92:
            return f"<blockquote>{self.pick(['<p>', ''])}{self.prose(4, 40)}</blockquote>"
        if kind < 0.94:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr>" for _ in range(int(self.rng.integers(2, 5)))) + "</table>"
        if kind < 0.96:
            return f"<pre><code>{self.words(3, 20)}</code></pre>"
        if kind < 0.98:
            return f"<figure><img src=x><figcaption>{self.prose(2, 15)}</figcaption></figure>"
        return f"<div>{self.prose(5, 80)}</div>"

    def article(self) -> str:
        parts = [self.paragraph() for _ in range(int(np.exp(self.rng.uniform(0, np.log(40)))))]
        for make, p in ((self.advert, 0.15), (self.share, 0.15), (self.notice, 0.06), (self.side, 0.06), (self.form, 0.04)):
            if self.odds(p):
                parts.insert(int(self.rng.integers(len(parts) + 1)), make())
        title = f"<{(t := self.pick(['h1', 'h1', 'h1', 'h2']))}>{self.words(1, 12)}</{t}>"
        if self.odds(0.15):
            title = f'<header data-y="1">{title}</header>'
        inside = (title if self.odds(0.85) else "") + "".join(parts)
        if self.odds(0.12):
            inside += self.comments()
        shape = self.rng.random()
        if self.bare:
            return self.prose(20, 200) if self.odds(0.15) else inside
        if self.semantic:
            body = f'<{(t := self.pick(["article", "article", "main", "article"]))}{self.name("main") if self.odds(0.5) else ""} data-y="1">{inside}</{t}>'
            return f'<main data-y="1">{body}</main>' if self.odds(0.2) and t != "main" else body
        if shape < 0.7:
            body = self.box("main", inside, self.pick(["div", "div", "section", "td"][:3]), 1)
            return f'<div data-y="1">{body}</div>' if self.odds(0.3) else body
        return "".join(f'<div data-y="1">{x}</div>' if "data-y" not in x else x for x in [inside]) if shape < 0.9 else f'<table><tr><td data-y="0">{self.links(2, 8)}</td><td data-y="1">{inside}</td></tr></table>'

    def share(self) -> str:
        return self.box("share", self.links(2, 5), self.pick(["div", "ul", "p"]), 0)

    def whole(self) -> str:
        if self.bare and self.odds(0.3):
            return f'<body data-y="1">{self.article()}</body>'
        before = [make() for make, p in ((self.notice, 0.15), (self.navigation, 0.75), (self.advert, 0.4), (self.form, 0.1), (self.notice, 0.08), (self.side, 0.12)) if self.odds(p)]
        if self.odds(0.35):
            inside = f"<{(t := self.pick(['h1', 'div', 'p', 'a']))}>{self.words(1, 4)}</{t}>" + "".join(before[:2])
            before[:2] = [self.box("header", inside, "header" if self.semantic else "div", 0)]
        after = [make() for make, p in ((self.share, 0.15), (self.comments, 0.4), (self.side, 0.35), (self.advert, 0.2), (self.notice, 0.1), (self.footer, 0.8)) if self.odds(p)]
        body = "".join(before) + self.article() + "".join(after)
        for _ in range(int(self.rng.integers(0, 3))):
            body = f"<div{self.pick(['', ' class=wrapper', ' id=page', ' class=container', ' class=row'])}>{body}</div>"
        page = f"<!DOCTYPE html><html><head><title>{self.words(2, 6)}</title></head><body{' data-y="1"' if self.bare else ''}>{body}</body></html>"
        return page[: int(len(page) * self.rng.uniform(0.5, 1))] if self.odds(0.1) else page


def example_pages(n: int, seed: int = 5) -> list[str]:
    rng = np.random.default_rng(seed)
    return [Page(rng).whole() for _ in range(n)]
