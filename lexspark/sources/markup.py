"""The standard library's HTML parser, with a short way for the tags that most pages are made of."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

_START, _END = re.compile(r"""<([a-z][a-z0-9]*)((?: [a-z]+=(?:'[^'&<>]*'|"[^"&<>]*"))*)>"""), re.compile(r"</([a-z][a-z0-9]*)>")
_ATTRS = re.compile(r"""([a-z]+)=(?:'([^']*)'|"([^"]*)")""")
#: URLs of a host, and paths on it, that are joined as they stand: no dots alone, nothing empty, nothing encoded.
_BASE, _PATH = re.compile(r"(https?://[A-Za-z0-9.:-]+)(?:[/?#]|$)"), re.compile(r"(?:/[A-Za-z0-9_~-][A-Za-z0-9_~.-]*)+(?:\?[A-Za-z0-9_~.&=-]+)?(?:#[A-Za-z0-9_~.-]+)?")
#: Elements whose content is no markup: the parser has to know that they are open.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


def joined(base: str, link: str) -> str:
    """urljoin, with a short way for plain paths on a host."""
    host = _BASE.match(base) if _PATH.fullmatch(link) else None
    return host[1] + link if host else urljoin(base, link)


class Parser(HTMLParser):
    """HTMLParser without line numbers; plain tags (lower case, attributes in quotes and without references) are read by
    one match."""

    def __init__(self):
        super().__init__(convert_charrefs=True)

    def updatepos(self, i, j):
        return j

    def parse_starttag(self, i):
        m = _START.match(self.rawdata, i)
        if m is None or m[1] in _RAW:
            return super().parse_starttag(i)
        self.lasttag = m[1]
        self.handle_starttag(m[1], [(k, a or b) for k, a, b in _ATTRS.findall(m[2])] if m[2] else [])
        return m.end()

    def parse_endtag(self, i):
        m = _END.match(self.rawdata, i) if self.cdata_elem is None else None
        if m is None or m[1] in _RAW:
            return super().parse_endtag(i)
        self.handle_endtag(m[1])
        return m.end()
