"""A tag parser that no page stops."""

from __future__ import annotations

import re
from html.parser import HTMLParser

_TAG = re.compile(r"<[A-Za-z/!?]")


class TolerantParser(HTMLParser):
    """Python's parser, without its errors: a marked section (``<![x[ ... ]]>``) is a comment up to the next ``>``, as in browsers."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        return self.parse_bogus_comment(i, report)

    def read(self, page: str) -> None:
        """A whole page; what begins after the last ``>`` like a tag never ends and is left out."""
        if m := _TAG.search(page, page.rfind(">") + 1):
            page = page[: m.start()]
        self.feed(page)
        self.close()
