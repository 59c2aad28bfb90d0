"""Labelled pages to train the extraction on: layouts with known main text, filled with made-up words.

No table holds labelled pages, so they are drawn here from a fixed seed: pages that name their parts by elements,
by classes or ids, or not at all, with parts nested, left out and in changing order. Long sentences stand in adverts
and notes, and single words in articles, so that a part is not known by the length of its text alone.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

# Words that name parts of pages, and words that such parts hold.
MAIN = "content main article post entry story body text".split()
PARTS = {
    "menu": ("nav", "nav menu navigation navbar breadcrumb breadcrumbs topnav links tabs toc".split(), "Home,About us,Contact,Login,Sign up,News,Products,Next,Previous,More".split(",")),
    "header": ("header", "header masthead banner top branding site logo topbar".split(), "Welcome,Search,Menu,Subscribe now,The daily site".split(",")),
    "footer": ("footer", "footer bottom copyright legal colophon credits".split(), "© 2020 All rights reserved,Privacy policy,Terms of use,Imprint,Copyright".split(",")),
    "sidebar": ("aside", "sidebar aside side widget related rail recommended popular tags secondary".split(), "Related articles,Most read,Tags,Archive,You may also like,Follow us".split(",")),
    "notice": ("div", "notice cookie cookies consent alert message popup modal gdpr newsletter warning paywall".split(), "We use cookies,Accept all,Subscribe to our newsletter,Notice,This site uses cookies to improve your experience.".split(",")),
    "advert": ("div", "ad ads advert adverts advertisement sponsor sponsored promo promotion banner".split(), "Advertisement,Sponsored,Buy now,Special offer,Click here".split(",")),
    "form": ("form", "form search login signup subscribe contact input".split(), "Name,E-mail,Search,Send,Submit,Password,Your message".split(",")),
    "comments": ("section", "comment comments reply replies discussion responses respond thread disqus".split(), "Comments,Reply,3 comments,Leave a comment,Anonymous says:,Posted on 3 May".split(",")),
    "share": ("div", "share social sharing buttons tools follow meta".split(), "Share,Tweet,Print,E-mail this,Like".split(",")),
}
COMMON = "the of and to in a is that this was for it on by with as at from we our you your all may also use more out up".split()
SYLLABLES = "an be co da el fi go hu in jo ka lu mi no os pe qu ra si tu un vo wa xe yo za ch er th str".split()


class Page:
    """One page in the making: its parts of html, and for each leaf block whether it is main text."""

    def __init__(self, r: random.Random):
        self.r, self.html, self.labels = r, [], []
        self.style = r.choices(("elements", "classes", "both", "bare"), (4, 4, 3, 1))[0]

    def words(self, low: int, high: int) -> str:
        r = self.r
        made = ("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high)))
        return " ".join(r.choice(COMMON) if r.random() < 0.25 else w for w in made)

    def sentences(self, low: int, high: int) -> str:
        r = self.r
        made = [self.words(2, 18).capitalize() for _ in range(r.randint(low, high))]
        made = [w.replace(" ", ", ", 1) if r.random() < 0.4 else w for w in made]
        if r.random() < 0.15:  # marks in place of stops
            mark = r.choice(["%%%", "***", "#", '"', ")", ";", " -", "..."])
            return " ".join(w + (mark if r.random() < 0.7 else "") for w in made)
        return " ".join(w + r.choice("....?!") for w in made)

    def block(self, tag: str, text: str, main: bool) -> None:
        r = self.r
        if r.random() < 0.15:
            text = f"<{'b' if r.random() < 0.5 else 'em'}>{text}" + ("" if r.random() < 0.3 else "</b></em>")
        self.html.append(f"<{tag}>{text}" + ("" if tag in ("p", "li") and r.random() < 0.2 else f"</{tag}>"))
        self.labels.append(main)

    def link(self, text: str) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{text}</a>'

    def named(self, element: str, names: list[str]) -> tuple[str, str]:
        """Opening and closing tag of a part in this page's style."""
        r = self.r
        tag = element if self.style in ("elements", "both") else "div"
        if self.style == "bare" or (self.style == "elements" and tag != "div"):
            return f"<{tag}>", f"</{tag}>"
        name = r.choice(names)
        if r.random() < 0.4:
            name += r.choice(["-", " ", "_"]) + r.choice(["wrapper", "box", "inner", "1", "container", "left", r.choice(names)])
        return f'<{tag} {r.choice(["class", "class", "id"])}="{name}">', f"</{tag}>"

    def part(self, kind: str) -> None:
        """A part that is not main text."""
        r = self.r
        element, names, phrases = PARTS[kind]
        head, tail = self.named(element, names)
        bare = self.style == "bare"
        self.html.append(head)
        form = r.random()
        if kind == "menu" or (kind in ("footer", "sidebar", "share", "header") and form < 0.4):
            self.html.append("<ul>")
            for _ in range(r.randint(2, 8)):
                self.block("li", self.link((r.choice(phrases) if r.random() < 0.3 else self.words(1, 4).capitalize()) + r.choice(["", "", "", ".", ",", "!"])), False)
            self.html.append("</ul>")
        elif kind == "form":
            for _ in range(r.randint(1, 4)):
                self.block(r.choice(["label", "p", "button"]), r.choice(phrases), False)
                self.html.append("<div><input></div>")
        elif kind == "comments":
            for _ in range(r.randint(1, 5)):
                self.block(r.choice(["h3", "h4", "div"]), r.choice(phrases), False)
                for _ in range(r.randint(1, 2)):
                    self.block("p", self.sentences(1, 4), False)
        else:
            if r.random() < 0.4:
                self.block(r.choice(["h2", "h3", "h4", "p"]), r.choice(phrases), False)
            for _ in range(r.randint(1, 3)):
                text = r.choice(phrases) if bare or r.random() < 0.3 else self.words(1, 6).capitalize() if r.random() < 0.3 else self.sentences(1, r.choice([2, 4, 9]))
                if r.random() < 0.3:
                    text = self.link(text)
                if r.random() < 0.5 and not bare:
                    self.block("p", text, False)
                else:  # text that stands in the part itself
                    self.html.append(f"<div>{text}</div>" if self.html[-1] != head else text)
                    self.labels.append(False)
        self.html.append(tail)

    def article(self) -> None:
        r = self.r
        element = r.choice(["article", "article", "main"])
        head, tail = self.named(element, MAIN)
        self.html.append(head)
        if r.random() < 0.8:
            inner = r.random() < 0.15 and self.style != "bare"
            self.html.append("<header>" if inner else "")
            self.block("h1", self.words(1, 9).capitalize() + r.choice(["", "", "."]), True)
            self.html.append("</header>" if inner else "")
        for _ in range(r.choice([1, 1, 2, 3, 5, 8, 14])):
            form = r.random()
            if form < 0.08:
                self.block(r.choice(["h2", "h3"]), self.words(1, 6).capitalize(), True)
            elif form < 0.13:
                self.html.append("<ul>" if form < 0.11 else "<ol>")
                for _ in range(r.randint(1, 5)):
                    self.block("li", self.words(1, 12) if r.random() < 0.6 else self.sentences(1, 2), True)
                self.html.append("</ul>" if form < 0.11 else "</ol>")
            elif form < 0.16:
                self.block(r.choice(["blockquote", "pre", "figcaption"]), self.sentences(1, 2), True)
            elif form < 0.18:
                self.html.append("<table>")
                for _ in range(r.randint(1, 3)):
                    self.html.append("<tr>")
                    for _ in range(2):
                        self.block("td", self.words(1, 3), True)
                    self.html.append("</tr>")
                self.html.append("</table>")
            elif form < 0.3 and self.style != "bare":
                self.part(r.choice(["advert", "share", "notice", "sidebar", "menu", "form"]))
            else:
                short = r.random()
                text = self.words(1, 4).capitalize() + r.choice([".", ".", "", "***"]) if short < 0.2 and self.style != "bare" else self.sentences(1, 12)
                if r.random() < 0.1:
                    text = text.replace(" ", f" {self.link(self.words(1, 3))} ", 1)
                self.block("p", text, True)
        if r.random() < 0.1 and self.style != "bare":
            self.part(r.choice(["comments", "share", "footer"]))
        self.html.append(tail)


def labelled_pages(n: int, seed: int = 11) -> Iterator[tuple[str, list[bool]]]:
    """`n` pages and for each of their leaf blocks whether it belongs to the main text."""
    r = random.Random(seed)
    for _ in range(n):
        page = Page(r)
        wrap = r.random() < 0.4
        page.html.append("<!DOCTYPE html><html><head><title>x</title><script>var a='<p>'</script></head><body>")
        page.html.append('<div class="page wrapper">' if wrap else "")
        before = [k for k in ("notice", "header", "menu", "advert", "sidebar", "form") if r.random() < 0.4]
        after = [k for k in ("share", "comments", "sidebar", "advert", "form", "menu", "notice") if r.random() < 0.3]
        r.shuffle(before)
        r.shuffle(after)
        for kind in before:
            page.part(kind)
        if r.random() < 0.97:
            page.article()
        for kind in after + (["footer"] if r.random() < 0.8 else []):
            page.part(kind)
        page.html.append("</div>" if wrap else "")
        page.html.append("</body></html>" if r.random() < 0.8 else "")
        yield "".join(page.html), page.labels
