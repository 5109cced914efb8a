"""A scanner of HTML that never goes back: text and tags of a page, in time that grows with its length."""

from __future__ import annotations

import re
from collections.abc import Iterator

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_PLAIN = re.compile(r"[^>\"']*")


class Scanner:
    """Goes through a page token by token; `at` may be set on, past raw text, between two tokens.

    A token is (begin, end, slash, tag, attributes): begin to end is its place, tag its name in lower case, "" for comments,
    declarations and a "<" that opens nothing (then end is begin + 1 and slash is "<", as it is text). A tag ends at the first ">" outside
    of quotes; if there is none, quotes are taken for ordinary signs from there on, so that no text is lost and none is read twice."""

    def __init__(self, page: str):
        self.page, self.at, self.quoted = page, 0, True
        self.last = {q: page.rfind(q) for q in "\"'>"}

    def _tag_end(self, at: int) -> int:
        """The place of the ">" that ends the tag whose name ends at `at`, -1 if there is none."""
        page, begin = self.page, at
        while self.quoted:
            at = _PLAIN.match(page, at).end()
            if at == len(page):
                self.quoted = False
            elif page[at] == ">":
                return at
            else:
                quote = page[at]
                at = at + 1 if at >= self.last[quote] else page.index(quote, at + 1) + 1
        return page.find(">", begin) if begin <= self.last[">"] else -1

    def tokens(self) -> Iterator[tuple[int, int, str, str, str]]:
        page = self.page
        while (begin := page.find("<", self.at)) >= 0:
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                self.at = len(page) if end < 0 else end + 3
                yield begin, self.at, "", "", ""
            elif page[begin + 1 : begin + 2] in ("!", "?"):
                end = page.find(">", begin)
                self.at = len(page) if end < 0 else end + 1
                yield begin, self.at, "", "", ""
            elif (name := _NAME.match(page, begin)) and (end := self._tag_end(name.end())) >= 0:
                self.at = end + 1
                yield begin, end + 1, name[1], name[2].lower(), page[name.end() : end]
            else:
                self.at = begin + 1
                yield begin, begin + 1, "<", "", ""


class Ends:
    """Finds where raw text ends. What a search found holds for all places before it, so that no part of a page is searched twice."""

    def __init__(self, page: str):
        self.page, self.found = page, {}

    def find(self, pattern: str, at: int) -> re.Match | None:
        known = self.found.get(pattern, ())
        if known == () or (known is not None and known.start() < at):
            known = self.found[pattern] = re.compile(pattern, re.I).search(self.page, at)
        return known
