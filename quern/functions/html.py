"""Zones and links of a page: title, headings, bold text, body and anchors.

Parsing is lenient: what is left open is closed by the next block (bold, headings) or the end of the page. Script, style and noscript
are invisible, links in them too. Text nodes are joined by a space, so markup inside a word splits it. The body is all text
outside of the title, whether or not there is a body element.
"""

from __future__ import annotations

from html.parser import HTMLParser

from .urls import normalize_url, resolve

# Elements that no other content may be in, and those that end an open bold or heading.
INVISIBLE = frozenset(("script", "style", "noscript"))
BLOCKS = frozenset("p div ul ol li table tr td th body html section article header footer nav aside main form h1 h2 h3 h4 h5 h6".split())
ZONES = {"h1": "head", "h2": "head", "h3": "head", "b": "bold", "strong": "bold"}


class _Zones(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.body: list[str] = []
        self.title: list[str] | None = None
        self.zones: dict[str, list[tuple[int, list[str]]]] = {"head": [], "bold": []}
        self.links: list[tuple[str | None, list[str]]] = []
        self.open: list[tuple[str, list[str]]] = []
        self.invisible = ""
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if self.invisible:
            return
        if tag in INVISIBLE:
            self.invisible = tag
            return
        if tag == "title":
            self.in_title = self.title is None
            if self.in_title:
                self.title = []
        elif tag == "a":
            self._close("a")
            parts: list[str] = []
            self.links.append((dict(attrs).get("href"), parts))
            self.open.append(("a", parts))
        if tag in BLOCKS:
            self._close("b", "strong", "h1", "h2", "h3")
        if tag in ZONES:
            parts = []
            self.zones[ZONES[tag]].append((len(self.body), parts))
            self.open.append((tag, parts))

    def _close(self, *tags: str) -> None:
        self.open = [x for x in self.open if x[0] not in tags]

    def handle_endtag(self, tag):
        if self.invisible:
            if tag == self.invisible:
                self.invisible = ""
            return
        if tag == "title":
            self.in_title = False
        elif tag in ZONES or tag == "a":
            for k in range(len(self.open) - 1, -1, -1):
                if self.open[k][0] == tag:
                    del self.open[k]
                    break
        elif tag in BLOCKS:
            self._close("b", "strong")

    def handle_data(self, data):
        if self.invisible:
            return
        if self.in_title and self.title is not None:
            self.title.append(data)
            return
        self.body.append(data)
        for _, parts in self.open:
            parts.append(data)


def parse_page(source: str | None, url: str | None) -> dict:
    """{body, title, head, bold, links: [(target, anchor text)]}; the links' base is the normalised address of the page."""
    page = _Zones()
    page.feed(source or "")
    page.close()
    base = normalize_url(url)
    links = []
    for href, parts in page.links:
        if (target := resolve(base, href)) is not None:
            links.append((normalize_url(target), " ".join(parts)))
    return {
        "body": " ".join(page.body),
        "title": " ".join(page.title or ()),
        "head": " ".join(" ".join(p) for _, p in page.zones["head"]),
        "bold": " ".join(" ".join(p) for _, p in page.zones["bold"]),
        "links": links,
    }
