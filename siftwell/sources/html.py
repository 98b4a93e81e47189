"""Text of web pages: the title, and the visible text of the whole body."""

from __future__ import annotations

import codecs
import re
from html.entities import html5
from html.parser import HTMLParser

SKIPPED = frozenset(("script", "style", "noscript", "template", "svg", "iframe"))
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CHARSET = re.compile(rb"<meta[^>]{0,400}?charset\s*=\s*[\"']?\s*([A-Za-z0-9_.:-]+)", re.IGNORECASE)
_AMPERSAND = re.compile("&((?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9A-Fa-f]+);)?")


class _Text(HTMLParser):
    """Skipped elements that aren't raw text end with their own end tag or with their parent's."""

    CDATA_CONTENT_ELEMENTS = ("script", "style", "iframe")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.titles: list[str] = []
        self.open: list[str] = []
        self.hidden = 0  # how many of the open elements lie above the skipped one, itself included; 0: none is skipped
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "title" and not self.titles and not self.hidden:
            self.in_title = True
            return
        if tag not in _VOID:
            self.open.append(tag)
            if tag in SKIPPED and not self.hidden:
                self.hidden = len(self.open)
        if not self.hidden and tag not in _INLINE:
            self.out.append(" ")

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if not self.hidden and tag not in _INLINE and tag not in SKIPPED:
            self.out.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag == "title":
            self.in_title = False
            return
        if tag in self.open:
            self._close(len(self.open) - 1 - self.open[::-1].index(tag))
        if not self.hidden and tag not in _INLINE and tag not in SKIPPED:
            self.out.append(" ")

    def _close(self, at: int) -> None:
        del self.open[at:]
        if len(self.open) < self.hidden:
            self.hidden = 0

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.titles.append(data)
        elif not self.hidden:
            self.out.append(data)


def collapse(text: str) -> str:
    return re.sub(r"[ \t\n\r\f\xa0]+", " ", text).strip()


def _whole_only(html: str) -> str:
    """html in which every ampersand that begins no whole character reference, semicolon included, stands for itself."""
    return _AMPERSAND.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], html)


def extract(html: str | None, whole_references: bool = False) -> tuple[str, str]:
    """Title and body text.  Character references may lack their semicolon, as in browsers, unless ``whole_references``."""
    parser = _Text()
    parser.feed(_whole_only(html or "") if whole_references else html or "")
    parser.close()
    return collapse("".join(parser.titles)), collapse("".join(parser.out))


def decode(data: bytes) -> str:
    """By the byte-order mark, else the charset of a meta element, else UTF-8."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be")):
        if data.startswith(mark):
            return data[len(mark) :].decode(name, "replace")
    found = _CHARSET.search(data[:5120])
    name = found[1].decode("ascii") if found else "utf-8"
    try:
        return data.decode(name, "replace")
    except LookupError:
        return data.decode("utf-8", "replace")
