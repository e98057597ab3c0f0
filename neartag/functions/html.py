"""Text parts of one HTML page; the per-row helper behind ``clean_html``."""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

# Elements that never hold content.
VOID_ELEMENTS = frozenset((
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "param", "source", "track", "wbr",
))


class PageText(HTMLParser):
    """Collects body text, the text of ``code`` elements and the text of links.

    Code is taken out of the body and out of link text; link text stays in the body.
    An element left open ends with the element around it, or with the page.  Open elements
    are counted by name and each is popped once, so a page takes linear time however many
    of its elements stay open.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.body: list[str] = []
        self.code: list[list[str]] = []
        self.links: list[list[str]] = []
        self._open: list[str] = []
        self._count: Counter[str] = Counter()
        self._in_code: list[list[str]] = []
        self._in_link: list[list[str] | None] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID_ELEMENTS:
            return
        if tag == "a":
            if self._count["a"]:
                self.handle_endtag("a")
            part = None if self._in_code else []
            self._in_link.append(part)
            if part is not None:
                self.links.append(part)
        elif tag == "code":
            self._in_code.append([])
            self.code.append(self._in_code[-1])
        self._open.append(tag)
        self._count[tag] += 1

    def handle_endtag(self, tag):
        if not self._count[tag]:
            return
        while True:
            name = self._open.pop()
            self._count[name] -= 1
            if name == "code":
                self._in_code.pop()
            elif name == "a":
                self._in_link.pop()
            if name == tag:
                return

    def handle_data(self, data):
        if self._in_code:
            for part in self._in_code:
                part.append(data)
            return
        self.body.append(data)
        # A link that is open ends before the next begins, so there is one at most.
        if self._in_link and self._in_link[-1] is not None:
            self._in_link[-1].append(data)


def split_page(html: str | None) -> tuple[str, str, str]:
    """Body, code and link text of a page; several parts are joined by newlines."""
    page = PageText()
    page.feed(html or "")
    page.close()
    return ("".join(page.body), "\n".join("".join(p) for p in page.code),
            "\n".join("".join(p) for p in page.links))
