"""The cascade: one unit of text, a paragraph or an XML chunk, through all rules in order.

The working set is a plain list of pieces. A rule replaces an open piece by the pieces
that its spans cut from it; claimed spans are locked and never looked at again. Cutting
keeps account of the space after each piece and of sentence flags.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass, field

import regex

from ..functions import rules as R
from ..functions.lexicons import Lexicon, load
from ..functions.rules import Rule, RuleSet, compile_rules

CLASSES = frozenset(
    "URL XML_entity XML_tag abbreviation action_word amount date email_address emoticon hashtag measurement mention number ordinal regular semester symbol time".split()
)
LANGUAGES = {"de": "de", "de_CMC": "de", "en": "en", "en_PTB": "en"}
DEFAULT = "de_CMC"


@dataclass(frozen=True)
class Options:
    """How to segment; plain values only, so that it goes to workers as it is. A language without rules means the default one."""

    language: str = DEFAULT
    split_camel_case: bool = False
    split_sentences: bool = True
    character_offsets: bool = False
    lexicon_folder: str | None = None
    lexicon: Lexicon = field(default=None)

    def __post_init__(self):
        if self.language not in LANGUAGES:
            object.__setattr__(self, "language", DEFAULT)
        if self.lexicon is None:
            object.__setattr__(self, "lexicon", load(self.code, self.lexicon_folder))

    @property
    def code(self) -> str:
        return LANGUAGES[self.language]

    def rules(self) -> RuleSet:
        return compile_rules(self.code, self.split_camel_case, self.lexicon)


@dataclass(slots=True)
class Piece:
    """A token, or text that may still be cut."""

    text: str
    token_class: str | None = "regular"
    markup: bool = False
    markup_class: str | None = None
    markup_eos: bool | None = None
    locked: bool = False
    space_after: bool = True
    original_spelling: str | None = None
    first_in_sentence: bool = False
    last_in_sentence: bool = False
    char_start: int | None = None
    char_end: int | None = None

    @property
    def extra_info(self) -> str:
        said = [] if self.space_after else ["SpaceAfter=No"]
        if self.original_spelling is not None:
            said.append(f'OriginalSpelling="{self.original_spelling}"')
        return ", ".join(said)


def checked(piece: Piece) -> Piece:
    """The piece, if its fields agree with each other; raises ValueError otherwise."""
    if piece.markup:
        if piece.token_class is not None or piece.markup_class not in ("start", "end") or piece.markup_eos is None:
            raise ValueError("a markup token has a markup class and no token class")
    elif piece.markup_class is not None or piece.markup_eos is not None:
        raise ValueError("only a markup token has a markup class")
    elif piece.token_class is not None and piece.token_class not in CLASSES:
        raise ValueError(f"unknown token class {piece.token_class!r}")
    return piece


def cut(piece: Piece, spans: list[tuple[int, int, str | None]], token_class: str | None, lock: bool = True, join: bool = False) -> list[Piece]:
    """``piece`` cut at ``spans`` (start, end, replacement): spans become tokens, the gaps stay open."""
    if not spans:
        return [piece]
    text, out, at = piece.text, [], 0
    for start, end, new in spans:
        found = text[start:end]
        spelling = None
        if new is not None and new != found:
            spelling, found = found, new
        if at < start and (gap := text[at:start].strip()):
            out.append(Piece(gap, space_after=text[start - 1] == " " or found[:1] == " "))
        at = end
        if found[-1:] == " " or text[end : end + 1] == " ":
            space = True
        else:
            space = piece.space_after if end == len(text) else False
        found = found.strip()
        if join and " " in found:
            spelling = found if spelling is None else spelling
            found = found.replace(" ", "")
        out.append(Piece(found, token_class, locked=lock, space_after=space, original_spelling=spelling))
    if rest := text[at:].strip():
        out.append(Piece(rest, space_after=piece.space_after))
    out[0].first_in_sentence = piece.first_in_sentence
    out[-1].last_in_sentence = piece.last_in_sentence
    return out


_PICTURE = regex.compile(r"[\p{Extended_Pictographic}\p{Emoji_Presentation}]")


def _emoji_spans(rule: Rule, text: str) -> list:
    if text.isascii() or not _PICTURE.search(text) and "️" not in text:
        return []
    found = []
    for m in rule.pattern.finditer(text):
        cluster = m.group()
        if _PICTURE.search(cluster) or (len(cluster) > 1 and "️" in cluster):
            found.append((m.start(), m.end(), None))
    return found


def _abbreviation_spans(rule: Rule, text: str) -> list:
    found = []
    for m in rule.hint.matches(rule.pattern, text):
        if rule.other is not None and rule.other.fullmatch(m.group()):
            at = m.start()
            for i in range(m.start(), m.end()):
                if text[i] == ".":
                    found.append((at, i + 1, None))
                    at = i + 1
        else:
            found.append((m.start(), m.end(), None))
    return found


def _left_spans(rule: Rule, text: str) -> list:
    cuts = [m.start() for m in rule.pattern.finditer(text)]
    return [(a, b, None) for a, b in zip([0, *cuts], cuts)]


def _group_spans(rule: Rule, text: str) -> list:
    order = sorted(rule.pattern.groupindex.values())
    return [(*m.span(g), None) for m in rule.pattern.finditer(text) for g in order if m.start(g) >= 0]


def _whole_spans(rule: Rule, text: str) -> list:
    if rule.template:
        return [(*m.span(), m.expand(rule.template)) for m in rule.pattern.finditer(text)]
    return [(*m.span(), None) for m in rule.pattern.finditer(text)]


def _member_spans(rule: Rule, text: str) -> list:
    words, lower = rule.other
    return [(m.start(), m.end(), None) for m in rule.pattern.finditer(text) if (m.group().lower() if lower else m.group()) in words]


def _inner_spans(rule: Rule, text: str) -> list:
    return [(m.start(), m.end(), None) for o in rule.pattern.finditer(text) for m in rule.other.finditer(text, o.start(), o.end())]


SPANS = {"whole": _whole_spans, "groups": _group_spans, "member": _member_spans, "inner": _inner_spans, "left": _left_spans, "abbreviation": _abbreviation_spans, "emoji": _emoji_spans}


def apply_rule(pieces: list[Piece], rule: Rule) -> list[Piece]:
    """All open pieces cut by one rule."""
    spans_of, lock = SPANS[rule.mode], rule.mode != "left"
    one = rule.needs if len(rule.needs) == 1 and rule.needs != "0" else ""  # any text holds the empty one
    out, changed = [], False
    for p in pieces:
        if not p.locked and not p.markup and one in p.text and (spans := spans_of(rule, p.text)):
            out += cut(p, spans, rule.token_class, lock, rule.join)
            changed = True
        else:
            out.append(p)
    return out if changed else pieces


def drop_empty(pieces: list[Piece]) -> list[Piece]:
    """Without open pieces of white space; their sentence flags go to the next or last token that isn't markup, if there is one."""
    gone = [not p.markup and not p.locked and not p.text.strip() for p in pieces]
    if not any(gone):
        return pieces
    left = list(pieces)
    for i, p in enumerate(pieces):
        if gone[i]:
            if p.first_in_sentence and (after := next((q for j, q in enumerate(pieces) if j > i and not q.markup), None)):
                after.first_in_sentence = True
            if p.last_in_sentence and (before := next((pieces[j] for j in range(i - 1, -1, -1) if not pieces[j].markup and not gone[j]), None)):
                before.last_in_sentence = True
    return [p for p, g in zip(left, gone) if not g]


_SPACES, _CONTROLS, _STRANDED, _INVISIBLE = (regex.compile(p) for p in (R.OTHER_SPACE, R.CONTROLS, R.STRANDED_SELECTOR, R.INVISIBLE))


def _clean(text: str) -> bool:
    """Whether a text whose white space is single spaces surely has no controls, invisible characters or variation selectors."""
    return text.isprintable() and "\uFE0F" not in text


def _pass(pieces: list[Piece], table: tuple[Rule, ...]) -> list[Piece]:
    """All rules in order, but for those that a look at the text rules out: cutting makes no new text."""
    text = "\n".join([p.text for p in pieces if not p.markup and not p.locked])
    seen = set(text)
    if any(c.isdecimal() for c in seen):
        seen.add("0")
    low = text.lower().replace("ſ", "s")
    hinted: dict[int, bool] = {}
    for rule in table:
        if rule.needs and seen.isdisjoint(rule.needs) or rule.word and rule.word not in low:
            continue
        if (hint := rule.hint) is not None and rule.mode != "abbreviation":
            if id(hint) not in hinted:
                hinted[id(hint)] = bool(hint.search(text))
            if not hinted[id(hint)]:
                continue
        pieces = apply_rule(pieces, rule)
    return pieces


def segment(pieces: list[Piece], options: Options) -> list[Piece]:
    """The tokens of one unit, given as text and markup pieces."""
    table = options.rules()
    for p in pieces:
        p.text = unicodedata.normalize("NFC", p.text)
        if not p.markup and not p.locked:
            p.text = _SPACES.sub(" ", p.text)
            if not _clean(p.text):
                p.text = _SPACES.sub(" ", _STRANDED.sub("", _CONTROLS.sub("", p.text)))
    pieces = _pass(pieces, table.early)
    for p in pieces:
        if not p.markup and not p.locked and not _clean(p.text):
            p.text = _SPACES.sub(" ", _INVISIBLE.sub("", p.text))
    pieces = _pass(drop_empty(pieces), table.late)
    out = []
    for p in pieces:
        if p.markup or p.locked:
            out.append(p)
            continue
        if words := p.text.split():
            out += map(Piece, words)
            out[-1].space_after = p.space_after
    return out


def segment_text(text: str, options: Options) -> list[Piece]:
    """The tokens of one paragraph of plain text."""
    return segment([Piece(text, first_in_sentence=True, last_in_sentence=True)], options)
