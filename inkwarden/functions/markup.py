"""Markup as a list of events, which the functions on pages read in passes."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.entities import html5
from html.parser import HTMLParser
from typing import NamedTuple

#: Elements that have no end tag in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Event(NamedTuple):
    """``kind`` is open, close, text, comment, doctype or other; ``size`` is the number of characters of the tag or text."""

    kind: str
    name: str
    size: int
    attrs: tuple[tuple[str, str | None], ...] = ()

    @property
    def attributes(self) -> dict[str, str | None]:
        return dict(self.attrs)


class _Lexer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[Event] = []
        self.at = 0

    def parse_endtag(self, i):
        self.at = i
        return super().parse_endtag(i)

    def handle_starttag(self, tag, attrs):
        self.found.append(Event("open", tag, len(self.get_starttag_text()), tuple(attrs)))

    def handle_startendtag(self, tag, attrs):
        self.found += [Event("open", tag, len(self.get_starttag_text()), tuple(attrs)), Event("empty", tag, 0)]

    def handle_endtag(self, tag):
        end = self.rawdata.find(">", self.at)
        self.found.append(Event("close", tag, (end if end >= 0 else len(self.rawdata)) - self.at + 1))

    def handle_data(self, data):
        self.found.append(Event("text", data, len(data)))

    def handle_comment(self, data):
        self.found.append(Event("comment", data, len(data)))

    def handle_decl(self, decl):
        self.found.append(Event("doctype", decl, len(decl)))

    def unknown_decl(self, data):
        self.found.append(Event("other", data, len(data)))

    handle_pi = unknown_decl


#: An ampersand that is not the beginning of ``&amp`` or of a number, with the name and semicolon behind it.
_NAMED = re.compile(r"&(?!amp|#)(?:[A-Za-z][A-Za-z0-9]*;)?")


def read(markup: str, finish: bool, bare: bool = True) -> tuple[list[Event], str]:
    """The events of a page, and what is left of it behind the last one; with ``finish`` the rest is read as well as it can be.

    A tag that closes itself is an ``open`` and, behind it, an ``empty`` event. Names of characters count
    without their semicolon, too; unless ``bare``, ``&amp`` alone does and the others are text.
    """
    held = None
    if not bare and "&" in markup:
        held = next(c for c in map(chr, range(0xF0000, 0x10FFFE)) if c not in markup)  # stands for an ampersand that is text
        markup = _NAMED.sub(lambda m: m[0] if m[0][1:] in html5 else held + m[0][1:], markup)
    lexer = _Lexer()
    lexer.feed(markup)
    rest = lexer.rawdata
    if finish:
        lexer.close()
    if held is None or held not in markup:
        return lexer.found, rest
    told = lambda x: x and x.replace(held, "&")
    return [Event(e.kind, told(e.name), e.size, tuple((told(k), told(v)) for k, v in e.attrs)) for e in lexer.found], told(rest)


def within(events: Iterable[Event], marks: Iterable[object]) -> Iterator[tuple[Event, object, int]]:
    """Each event with the mark of the outermost marked element that is open around it, or None, and the open elements with its own.

    ``marks`` has one mark for each event (None: no mark), of which those of open
    events count. An end tag closes everything up to the last element of its name.
    """
    names: list[str] = []
    known: Counter[str] = Counter()  # how often each is open
    since, around = 0, None  # the outermost marked element's depth and mark
    for event, mark in zip(events, marks, strict=True):
        if event.kind == "close" and known[event.name]:
            while True:
                known[last := names.pop()] -= 1
                if last == event.name:
                    break
            if len(names) < since:
                since, around = 0, None
        outer = around
        if event.kind == "open" and event.name not in VOID:
            names.append(event.name)
            known[event.name] += 1
            if around is None and mark is not None:
                since, around = len(names), mark
        elif event.kind == "empty" and event.name not in VOID and names[-1:] == [event.name]:
            known[names.pop()] -= 1
            if len(names) < since:
                since, around = 0, None
        yield event, outer, len(names)
