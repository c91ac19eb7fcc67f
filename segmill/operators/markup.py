"""XML and HTML: parse events with their places, chunks at sentence-final tags, and character offsets."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser
from xml.parsers import expat
from xml.sax.saxutils import escape

import numpy as np
import regex

from .cascade import Piece

Span = tuple[int, int]


@dataclass
class Part:
    """A piece with its place: of a tag one span, of text one span a character."""

    piece: Piece
    spans: list[Span] = field(default_factory=list)


class _Builder:
    """Turns events into parts; marks what stands next to sentence-final tags and leaves pruned elements out."""

    def __init__(self, eos_tags: Iterable[str] | None, prune_tags: Iterable[str] | None):
        self.eos, self.prune = frozenset(eos_tags or ()), frozenset(prune_tags or ())
        self.parts: list[Part] = []
        self.text: list[str] = []
        self.spans: list[Span] = []
        self.first, self.pruning = True, 0

    def characters(self, data: str, spans: list[Span]) -> None:
        if not self.pruning:
            self.text.append(data)
            self.spans += spans

    def flush(self, eos: bool) -> None:
        if data := "".join(self.text):
            self.parts.append(Part(Piece(data, first_in_sentence=self.first, last_in_sentence=eos), self.spans))
            self.first = False
        self.text, self.spans = [], []

    def tag(self, name: str, text: str, kind: str, span: Span) -> None:
        eos = name in self.eos
        self.flush(eos)
        self.parts.append(Part(Piece(text, None, True, kind, eos, True), [span]))
        self.first = self.first or eos

    def start(self, name: str, attributes: list[tuple[str, str]], span: Span) -> None:
        self.pruning += name in self.prune
        if not self.pruning:
            said = "".join(f' {k}="{escape(v, {chr(34): "&quot;"})}"' for k, v in attributes)
            self.tag(name, f"<{name}{said}>", "start", span)

    def end(self, name: str, span: Span) -> None:
        if not self.pruning:
            self.tag(name, f"</{name}>", "end", span)
        self.pruning -= name in self.prune


def parse_xml(xml: str, eos_tags: Iterable[str] | None = None, prune_tags: Iterable[str] | None = None) -> list[Part]:
    """The tags and texts of a document in order. Comments, instructions and declarations go; ill-formed XML raises ValueError."""
    raw = xml.encode("utf-8")
    char_of = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80) - 1
    at = lambda i: int(char_of[i]) if i < len(raw) else len(xml)
    builder = _Builder(eos_tags, prune_tags)
    parser = expat.ParserCreate("utf-8")
    parser.ordered_attributes = True
    parser.buffer_text = False
    tag_end, empty, literal = 0, False, False

    def start(name, attributes):
        nonlocal tag_end, empty
        begin, quote = at(parser.CurrentByteIndex), ""
        i = begin
        while xml[i] != ">" or quote:
            if quote:
                quote = "" if xml[i] == quote else quote
            elif xml[i] in "\"'":
                quote = xml[i]
            i += 1
        tag_end, empty = i + 1, xml[i - 1] == "/"
        builder.start(name, list(zip(attributes[::2], attributes[1::2])), (begin, tag_end))

    def end(name):
        nonlocal empty
        begin = at(parser.CurrentByteIndex)
        builder.end(name, (tag_end, tag_end) if empty else (begin, xml.index(">", begin) + 1))  # an empty element's end has no width
        empty = False

    def cdata(inside):
        nonlocal literal
        literal = inside

    def characters(data):
        begin = at(parser.CurrentByteIndex)
        if xml[begin] == "&" and not literal:
            spans = [(begin, xml.index(";", begin) + 1)] * len(data)
        elif xml.startswith(data, begin):
            spans = [(begin + k, begin + k + 1) for k in range(len(data))]
        else:  # a line end of two characters
            spans = [(begin, begin + 2 if xml.startswith("\r\n", begin) else begin + 1)] * len(data)
        builder.characters(data, spans)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = lambda: cdata(True), lambda: cdata(False)
    try:
        parser.Parse(raw, True)
    except expat.ExpatError as e:
        raise ValueError(f"ill-formed XML: {e}") from None
    return builder.parts


class _Html(HTMLParser):
    """Permissive parsing: void elements close themselves, unclosed ones close with their parents."""

    VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

    def __init__(self, builder: _Builder):
        super().__init__(convert_charrefs=True)
        self.builder, self.open = builder, []

    def handle_starttag(self, tag, attrs):
        self.builder.start(tag, [(k, v or "") for k, v in attrs], (0, 0))
        if tag in self.VOID:
            self.builder.end(tag, (0, 0))
        else:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open:
                top = self.open.pop()
                self.builder.end(top, (0, 0))
                if top == tag:
                    break

    def handle_data(self, data):
        self.builder.characters(data, [(0, 0)] * len(data))


def parse_html(html: str, eos_tags: Iterable[str] | None = None, prune_tags: Iterable[str] | None = None) -> list[Part]:
    """As ``parse_xml`` for pages that aren't well-formed; without places. All elements close, so sentence tags can nest."""
    builder = _Builder(eos_tags, prune_tags)
    parser = _Html(builder)
    parser.feed(html)
    parser.close()
    while parser.open:
        builder.end(parser.open.pop(), (0, 0))
    builder.flush(False)
    return builder.parts


# A document as a string: B and E are start and end tags that end sentences, s and e other ones, w is a text, a space a blank one.
#: Texts with which a sentence begins, and texts with which one ends.
_FIRST = regex.compile(r"(?:^|[BE])[^wBE]*(w)")
_LAST = regex.compile(r"[w ](?=[^w ]*[BE])")
#: After a sentence-final end tag a chunk goes on up to a start tag or a text, else up to what leads to a sentence-final start tag.
_CHUNK = regex.compile(r"[^w]*w.*?(?:(?<=E[eE ]*)(?=[sw]| *B)|(?<!E[eE ]*)(?=[s ]*B)|$)|.+")


def _code(piece: Piece) -> str:
    if not piece.markup:
        return "w" if piece.text.strip() else " "
    return ("BE" if piece.markup_eos else "se")[piece.markup_class == "end"]


def chunks(parts: list[Part]) -> list[list[Part]]:
    """Parts between sentence-final tags.

    A chunk that has words ends before the next sentence-final start tag, with start
    tags and white space directly before that tag going along with it; or after a
    sentence-final end tag, at the next start tag or words, so that further end tags
    stay on the left. What is left at the end is a chunk even without words.
    """
    codes = "".join([_code(p.piece) for p in parts])
    for m in _FIRST.finditer(codes):
        parts[m.start(1)].piece.first_in_sentence = True
    for m in _LAST.finditer(codes):
        parts[m.start()].piece.last_in_sentence = True
    return [parts[m.start() : m.end()] for m in _CHUNK.finditer(codes)]


# Characters that may stand in a source between the characters of a token.
_SKIPPED = frozenset(
    map(chr, [*range(0x20), *range(0x7F, 0xA0), *range(0x2000, 0x2010), *range(0x202A, 0x202F), *range(0x2066, 0x206A), 0x20, 0xA0, 0xAD, 0x61C, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x2060, 0x3000, 0xFE0F, 0xFEFF])
)


def normalised(text: str, spans: list[Span]) -> list[tuple[str, int, int]]:
    """The NFC characters of ``text`` with their places: a base with its marks is composed as a block and shares one place."""
    if unicodedata.is_normalized("NFC", text):
        return [(c, a, b) for c, (a, b) in zip(text, spans)]
    out, i = [], 0
    while i < len(text):
        j = i + 1
        while j < len(text) and unicodedata.combining(text[j]):
            j += 1
        out += [(c, spans[i][0], spans[j - 1][1]) for c in unicodedata.normalize("NFC", text[i:j])]
        i = j
    if "".join(c for c, _, _ in out) != unicodedata.normalize("NFC", text):
        raise ValueError("composition reaches across blocks; these characters can't be placed")
    return out


def place_tokens(tokens: list[Piece], source: list[tuple[str, int, int]]) -> None:
    """Set ``char_start`` and ``char_end`` of the tokens, matched from left to right; markup has its places already."""
    at = 0
    for t in tokens:
        if t.markup:
            continue
        start = end = None
        for c in t.text if t.original_spelling is None else t.original_spelling:
            while True:
                if at >= len(source):
                    raise ValueError(f"token {t.text!r} is not in its source")
                d, a, b = source[at]
                at += 1
                if d == c or (c.isspace() and d.isspace()):
                    start = a if start is None else start
                    end = b
                    break
                if d not in _SKIPPED:
                    raise ValueError(f"{d!r} is skipped before {t.text!r}")
        t.char_start, t.char_end = start, end


def resolve_entities(xml: str) -> tuple[str, list[Span]]:
    """A text with its five named and all numeric entities resolved, and the place of each character."""
    out, spans, at = [], [], 0
    for m in re.finditer(r"&(?:#\d+|#x[0-9a-f]+|amp|apos|gt|lt|quot);", xml, re.IGNORECASE):
        spans += [(i, i + 1) for i in range(at, m.start())]
        out += [xml[at : m.start()], unescape(m.group().lower())]
        spans.append(m.span())
        at = m.end()
    out.append(xml[at:])
    return "".join(out), spans + [(i, i + 1) for i in range(at, len(xml))]
