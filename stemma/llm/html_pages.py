"""Labelled pages to train the extractor on: invented layouts in which every block says whether it is main text.

A text begins with MAIN or REST, characters that no page uses; the trainer
takes them off again and keeps them as the labels.
"""

from __future__ import annotations

import random

MAIN, REST = "\ue000", "\ue001"

SYLLABLES = "an be co da en fi go ha in ja ka lo me no or pa qui re si ta un ve wo xa yo zu ment tion ing".split()
#: Names that sites give to the parts of their pages.
NAMES = {
    "wrap": ["wrapper", "container", "row", "col-md-8", "inner", "outer", "site", "grid", "block", "box", "css-1x2y3", "layout"],
    "main": ["content", "main-content", "post", "entry-content", "article-body", "story", "post-body", "mainText", "articleText"],
    "nav": ["nav", "navbar", "menu", "main-menu", "navigation", "topnav", "breadcrumbs", "pagination", "site-nav"],
    "head": ["header", "masthead", "site-header", "top-banner", "logo", "branding"],
    "foot": ["footer", "site-footer", "page-footer", "copyright", "legal", "colophon", "bottom"],
    "side": ["sidebar", "side", "widget", "related-posts", "recommended", "popular", "trending", "right-rail", "aside", "more-stories"],
    "notice": ["cookie-notice", "cookie-banner", "consent", "alert", "notice", "popup", "modal", "newsletter", "subscribe", "gdpr"],
    "advert": ["ad", "ads", "advert", "advertisement", "sponsored", "ad-slot", "promo", "banner-ad", "adsense"],
    "comment": ["comments", "comment", "comment-list", "commentlist", "replies", "reader-comments", "discussion", "disqus", "respond"],
    "share": ["share", "social", "share-buttons", "tags", "post-meta", "follow-us"],
}
SEMANTIC = {"nav": "nav", "head": "header", "foot": "footer", "side": "aside"}


class PageMaker:
    """Makes one page after the other from a seed."""

    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        r = self.random
        return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 4))) for _ in range(r.randint(least, most)))

    def sentence(self, least: int = 1, most: int = 25) -> str:
        return self.words(least, most).capitalize() + self.random.choice(". . . . ! ?".split())

    def prose(self) -> str:
        return " ".join(self.sentence() for _ in range(self.random.choice([1, 1, 1, 2, 3, 5, 8])))

    def part(self, kind: str, inside: str, semantic: float = 0.5) -> str:
        """An element that names its kind by its tag, class, id or role."""
        r = self.random
        tag = SEMANTIC.get(kind)
        if tag and r.random() < semantic:
            return f"<{tag}>{inside}</{tag}>" if r.random() < 0.7 else f'<{tag} class="{r.choice(NAMES["wrap"])}">{inside}</{tag}>'
        tag = r.choice(["div", "div", "section"])
        name = r.choice(NAMES[kind])
        if kind == "nav" and r.random() < 0.2:
            return f'<{tag} role="navigation">{inside}</{tag}>'
        return f'<{tag} {r.choice(["class", "class", "id"])}="{name}">{inside}</{tag}>'

    def wrapped(self, inside: str) -> str:
        for _ in range(self.random.choice([0, 0, 1, 2])):
            inside = f'<div class="{self.random.choice(NAMES["wrap"])}">{inside}</div>'
        return inside

    def links(self, mark: str = REST) -> str:
        r = self.random
        items = [f'<li><a href="/x">{mark}{self.words(1, 4)}</a></li>' for _ in range(r.randint(1, 8))]
        if r.random() < 0.3:
            return "".join(f"<p>{i[4:-5]}</p>" for i in items)
        return f"<ul>{''.join(items)}</ul>"

    def rest(self, kind: str) -> str:
        """One part that is not main text."""
        r = self.random
        say = lambda text: f"{REST}{text}"
        title = f"<h{r.randint(2, 4)}>{say(self.words(1, 4))}</h3>" if r.random() < 0.5 else ""
        if kind == "nav":
            inside = self.links()
        elif kind == "foot":
            inside = r.choice(["", self.links()]) + f"<p>{say(r.choice(['&copy; ', 'Copyright ', '']) + self.prose())}</p>"
            inside = inside if r.random() < 0.6 else say("&copy; " + self.words(1, 3) + " &middot; " + self.prose())
        elif kind == "head":
            inside = r.choice([f"<h1>{say(self.words(1, 3))}</h1>", say(self.words(1, 4)), f"<p>{say(self.sentence())}</p>"])
            inside += r.choice(["", self.links()])
        elif kind == "side":
            inside = title + r.choice([self.links(), f"<p>{say(self.prose())}</p>", say(self.prose())])
        elif kind == "notice":
            text = r.choice(["We use cookies. ", "Subscribe to our newsletter. ", "", ""]) + self.prose()
            inside = r.choice([f"<p>{say(text)}</p>", say(text)]) + r.choice(["", f"<button>{say('Accept')}</button>"])
        elif kind == "advert":
            inside = r.choice([say(self.prose()), f"<p>{say(self.prose())}</p>", f'<a href="/y">{say(self.sentence())}</a>'])
        elif kind == "comment":
            each = r.choice(["<p>{}</p>", "<li>{}</li>", '<div class="comment-body"><p>{}</p></div>'])
            inside = title + "".join(each.format(say(self.prose())) for _ in range(r.randint(1, 5)))
            inside += r.choice(["", f"<form><label>{say('Name')}</label><button>{say('Post')}</button></form>"])
        elif kind == "form":
            inside = f"<label>{say(self.words(1, 3))}</label><input type='text'><p>{say(self.sentence())}</p><button>{say('Send')}</button>"
            return f"<form>{inside}</form>"
        else:
            inside = self.links() if r.random() < 0.5 else say(self.words(1, 6))
        return self.part(kind, inside)

    def article(self) -> str:
        """The main text, with parts inside it that are not."""
        r = self.random
        say = lambda text: f"{MAIN}{text}"
        head = f"<h{r.choice([1, 1, 2])}>{say(self.sentence(2, 12))}</h1>" if r.random() < 0.85 else ""
        if head and r.random() < 0.15:
            head = f"<header>{head}</header>"
        out = [head]
        for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14])):
            kind = r.random()
            if kind < 0.68:
                text = self.prose()
                if r.random() < 0.15:
                    text = text.replace(" ", ' <a href="/z">', 1) + "</a>"
                out.append(r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}</b><br>"]).format(say(text)))
            elif kind < 0.76:
                out.append(f"<h{r.randint(2, 4)}>{say(self.words(1, 7))}</h2>")
            elif kind < 0.84:
                items = "".join(f"<li>{say(self.sentence())}</li>" for _ in range(r.randint(1, 5)))
                out.append(r.choice(["<ul>{}</ul>", "<ol>{}</ol>"]).format(items))
            elif kind < 0.88:
                out.append(f"<blockquote><p>{say(self.prose())}</p></blockquote>")
            elif kind < 0.91:
                cells = "".join(f"<td>{say(self.words(1, 4))}</td>" for _ in range(2))
                out.append(f"<table><tr>{cells}</tr></table>")
            elif kind < 0.93:
                out.append(f"<pre>{say(self.words(3, 12))}</pre>")
            else:
                out.append(self.rest(r.choice(["advert", "share", "side", "notice", "form", "nav"])))
        if r.random() < 0.2:
            out.append(self.rest(r.choice(["comment", "share", "side", "foot"])))
        inside = "".join(out)
        shape = r.random()
        if shape < 0.5:
            inside = f"<article>{inside}</article>"
        elif shape < 0.65:
            inside = f"<main>{inside}</main>"
        elif shape < 0.95:
            inside = f'<div {r.choice(["class", "id"])}="{r.choice(NAMES["main"])}">{inside}</div>'
        return inside

    def page(self) -> str:
        r = self.random
        before = [k for k in ("notice", "head", "nav", "advert", "form") if r.random() < 0.45]
        after = [k for k in ("share", "comment", "side", "advert", "nav", "form", "notice") if r.random() < 0.35]
        if r.random() < 0.85:
            after.append("foot")
        middle = "".join(self.rest(k) for k in before) + self.wrapped(self.article()) + "".join(self.rest(k) for k in after)
        page = f"<!DOCTYPE html><html><head><title>x</title></head><body>{self.wrapped(middle)}</body></html>"
        return page[: r.randint(len(page) // 2, len(page))] if r.random() < 0.1 else page


def labelled_pages(number: int, seed: int = 1) -> list[str]:
    maker = PageMaker(seed)
    return [maker.page() for _ in range(number)]
