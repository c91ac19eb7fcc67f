"""The ordered table of segmentation rules.

A rule claims spans of unlocked text and gives them a token class. Modes:

- ``whole``: each match is a token (``join``: without its inner spaces; ``template``: rewritten).
- ``groups``: each named group of a match is a token, what lies between stays open.
- ``member``: a match is a token if the word list has it (``lower``: in lower case).
- ``left``: cut before each match, and leave both sides open.
- ``inner``: the matches of a second pattern within the matches of the first.
- ``abbreviation``, ``emoji``: see the cascade.

``needs`` names characters of which a text must hold one for the rule to match at all
("0" stands for any digit), ``word`` a lower-case string that it must hold, and ``hint`` a
pattern without look at its surroundings that must match in it; they only save time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import regex

from . import lexicons
from .lexicons import Lexicon, ordered

DE, EN = "de", "en"


@dataclass(frozen=True)
class Rule:
    name: str
    mode: str
    pattern: object
    token_class: str = "regular"
    needs: str = ""
    other: object = None
    join: bool = False
    template: str | None = None
    hint: object = None
    word: str = ""


def any_of(entries) -> str:
    return "|".join(regex.escape(e, literal_spaces=True) for e in entries)


# The patterns that decide what is a token of which kind.
OTHER_SPACE = r"[^\S ]\s*| \s+"  # white space but for single spaces
CONTROLS = r"[\u0000-\u001F\u007F-\u009F]"
STRANDED_SELECTOR = r" \uFE0F"
INVISIBLE = r"[\u00AD\u061C\u200B-\u200F\u202A-\u202E\u2060\u2066-\u2069\uFEFF]"
ATTRIBUTES = r"""(?:\s+[_:A-Z][-.:\w]*\s*=\s*(?:"[^"]*"|'[^']*'))*\s*"""
XML_DECLARATION = r"<\?xml" + ATTRIBUTES + r"\?>"
XML_TAG = r"<(?:[_:A-Z][-.:\w]*" + ATTRIBUTES + r"/?|/[_:A-Z][-.:\w]*\s*)>"
FLAG = r"\p{Regional_Indicator}{2}\uFE0F?"
SPACED_EMOTICON = r"([:;])[ ]([()])(?![ ]?(?:00|[+])\d)"
EMAIL = r"\b[\w.%+-]+(?:@| \[at\] )[\w.-]+(?:\.| \[?dot\]? )\p{L}{2,}\b"
PROTOCOL = r"(?:(?:https?|ftp|svn)://|(?:https?://)?www\.)"
MARKDOWN_LINK = r"(?P<a>\[)[^]]+(?P<b>\])(?P<c>\()" + PROTOCOL + r"[^)]+(?P<d>\))"
URL_WITH_PARENTHESES = r"\b" + PROTOCOL + r"""[^][<> ]+?\(\S*?\)[^][<> ]*(?=$|[\'. "!?,;])"""
URL = r"\b" + PROTOCOL + r"""[^][<> ]+[^][<>\'. "!?,;:()]"""
DOI = r"\bdoi:10\.\d+/\S+"
DOI_AFTER_SPACE = r"(?<=\bdoi: )10\.\d+/\S+"
BARE_URL = r"\b[\w./-]+\.(?:de|com|tv|me|net|us|org|at|cc|ly|be|ch|info|live|eu|edu|gov|jpg|png|gif|log|txt|xlsx?|docx?|pptx?|pdf)(?:-\w+)?\b"
REDDIT = r"(?<!\w)/?[rlu](?:/\w+)+/?(?!\w)"
ENTITY = r"&(?:quot|amp|apos|lt|gt|#\d+|#x[0-9a-f]+);"
HEART = r"(?:^|^\D|(?<=\D[ ])|(?<=.[^\d ])|(?<=[<^]3[ ]?))[<^]3(?!\d)"
EMOTICON_FACE = r"(?:[:;]|(?<!\d)8)[-'oO]?(?:\)+|\(+|[*]|([DPp])\1*(?!\w))"
EMOTICON_REST = r"\b[Xx]D+\b|\b(?:D'?:|oO)\b|(?<!\b\d{1,2}):\w+:(?!\d{2}\b)"
DINGBAT = r"[\u2600-\u27BF]"
MENTION = r"[@]\w+(?!\w)"
HASHTAGS = r"(?<!\w)(?:[#]\w(?:[\w-]*\w)?)+(?!\w)"
HASHTAG = r"[#]\w(?:[\w-]*\w)?(?!\w)"
ACTION_WORD = r"(?<!\w)(?P<a>[*+])(?P<b>[^\s*]+)(?P<c>[*])(?!\w)"
UNDERLINE = r"(?<!\w)(?P<a>_)(?:\w[^_]+\w)(?P<b>_)(?!\w)"
PLUS_WORD = r"\b\w+[&+]\w+\b"
CAMEL_WORD = r"\b\w*\p{Ll}\p{Lu}\w*\b"
CAMEL_IN = r"\b\p{L}+\p{Ll}In(?:nen)?\p{Ll}*\b"
CAMEL_CUT = r"(?<=\p{Ll}{2})(\p{Lu})(?!\p{Lu}|\b)"
GENDER = r"\b\p{L}+[*:/]in(?:nen)?\p{Ll}*\b"
DECADE = r"\b(?:[12]\d)?\d0['’]?s\b"
DMS, LLREVE, NOT = r"(?<=\w)(['’][dms])\b", r"(?<=\w)(['’](?:ll|re|ve))\b", r"(?<=\w)(n['’]t)\b"
TRAILING_APOSTROPHE = r"(?<=[sx])(['’])(?![\w'])"
CONTRACTIONS = """a|lot gon|na got|ta lem|me out|ta wan|na c'm|on more|['’]n d['’]|ye ['’]t|is ['’]t|was there|s i|m you|re he|s she|s ai|nt are|nt is|nt do|nt
    does|nt did|nt i|ve you|ve they|ve have|nt has|nt can|not ca|nt could|nt wo|nt would|nt you|ll let|s du|n|no wha|dd|ya wha|t|cha i|'m|a""".split()
NUMBER_ABBREVIATION = r"\b(no\.)\s*(?=\d)"
DEGREE = r"(?<=\d ?)°(?:F|C|Oe)\b"
FRACTION_PART = r"(?:\d{1,2}/(?:(?:[1-9]|10)|(?:\d{1,2}|100)/100|(?:\d{1,3}|1000)/1000))"
SCIENTIFIC = r"(?:[−+-]?(?:\d*[.,])?\d+(?:[eE][−+-]?\d+)?)"
GROUPED = r"(?:\d{1,3}(?:[.]\d{3})+(?:,\d+)?|\d{1,3}(?:,\d{3})+(?:[.]\d+)?)"
NUMBER = f"(?P<number>{FRACTION_PART}|{SCIENTIFIC}|{GROUPED})"
NUMBER_RANGE = "(?:" + "|".join(f"(?P<{p}from>{n})(?P<{p}dash>[-–])(?P<{p}to>{n})" for p, n in (("fr", FRACTION_PART), ("sn", SCIENTIFIC), ("gn", GROUPED))) + ")"
NO_NUMBER_BEFORE, NO_NUMBER_AFTER = r"(?<!\w|\d[.,]?)", r"(?![.,]?\d)"
LETTER_ELLIPSIS = r"(?<![\w.])(?P<a>\p{L})(?P<b>\.{3})(?!\.)"
AND_CETERA = r"(?<![\w.&])&c\.(?!\p{L}{1,3}\.)"
STREET = r"(?<![\w.])([\p{L}-]+str\.)(?!\p{L})"
NUMBERED = r"(?<![\w.])(\w+\.-?Nr\.)(?!\p{L}{1,3}\.)"
LETTER_ABBREVIATION = r"(?<![\w.])\p{L}\.(?!\p{L}{1,3}\.)"
POSTSCRIPT = r"(?<!\d[ ])\bps\."
MULTIPART = r"(?:\p{L}+\.){2,}"
ARTICLE = r"\bArt.(?=\s?\d)"
ISBN = (
    r"\b(?:(?<=ISBN(?:-1[03])?:?[ ]?)|(?<![0-9][ -]))(?:(?:[0-9]{9}[0-9X])|(?:(?=[0-9X -]{13}\b)[0-9]{1,5}([ -])[0-9]{1,7}\1[0-9]{1,7}\1[0-9X])"
    r"|(?:97[89][0-9]{10})|(?:(?=[0-9X -]{17}\b)97[89]([ -])[0-9]{1,5}\2[0-9]{1,7}\2[0-9]{1,7}\2[0-9]))(?!\w|[ -][0-9])"
)
_DAY, _MONTH = r"(?:0?[1-9]|1[0-9]|2[0-9]|3[01])", r"(?:0?[1-9]|1[0-2])"
DATE_YMD = r"(?<![\d.])(?P<a>\d{4})(?P<b>([/-])\d{1,2})(?P<c>\3\d{1,2})(?!\d)"
DATE_DMY = rf"(?<![\d.])(?P<a>{_DAY}([./-]))(?P<b>{_MONTH}\2)(?P<c>(?:\d\d){{1,2}})(?!\d)"
DATE_MDY = rf"(?<![\d.])(?P<a>{_MONTH}([./-]))(?P<b>{_DAY}\2)(?P<c>(?:\d\d){{1,2}})(?!\d)"
DATE_DM = r"(?<![\d.])(?P<a>\d{1,2}([./-]))(?P<b>\d{1,2}\2)(?!\d)"
TIME_AM_PM = r"(?<![\w])(?P<a>\d{1,2}(?:(?:[.:]\d{2})){0,2}) ?(?P<b>(?:[ap]m\b|[ap]\.m\.(?!\w)))"
TIME = r"(?<!\w)\d{1,2}(?:(?::\d{2}){1,2}){1,2}(?![\d:])"
US_PHONE = r"(?<![\d-])(?:[2-9]\d{2}[/-])?\d{3}-\d{4}(?![\d-])"
US_ZIP = r"(?<![\d-])\d{5}-\d{4}(?![\d-])"
IDENTIFIER = r"(?<![\d-])\d+-(?:\d+-)+\d+(?![\d-])|(?<![\d/])\d+/(?:\d+/)+\d+(?![\d/])"
ORDINAL = r"(?<![\w.])(?:\d{1,3}|\d{5,}|[3-9]\d{3})\.(?!\d)"
ENGLISH_ORDINAL = r"\b(?:\d+(?:,\d+)*)?(?:1st|2nd|3rd|\dth)\b"
ROMAN_ORDINAL = r"\b(?=[MDCLXVI])M{0,4}(?:C[MD]|D?C{0,3})(?:X[CL]|L?X{0,3})(?:I[XV]|V?I{0,3})\."
FRACTION = r"(?<!\w)\d+/\d+(?![\d/])"
CALCULATION = r"(?P<a>\d+(?:[,.]\d+)?)(?P<b>[+*x×÷−])(?P<c>\d+(?:[,.]\d+)?)"
AMOUNT = r"(?<!\w)(?:\d+[\d,.]*[,.]-)(?!\w)"
SEMESTER = r"(?<!\w)(?P<a>[WS]S|SoSe|WiSe)(?P<b>\d\d(?:/\d\d)?)(?!\w)"
NUMBER_COMPOUND = r"(?<!\w-?)(?:\d+-?[\p{L}@][\p{L}@-]*)(?!\w)"
IPV4 = r"(?:\d{1,3}[.]){3}\d{1,3}"
SECTION = r"(?:\d+[.])+\d+[.]?"
QUESTION_EXCLAMATION = r"([!?]+)"
ARROW = r"(-+[ ]?>|<[ ]?-+|[\u2190-\u21ff])"
BRACKETS = r"((?:(?<=\w)[(](?!inn?[)]))|(?:(?<!\w)[(])|(?:(?<!.[(]in|[(]inn)[)])|[][{}])"
SLASH_WORD = r"\b(?:w/o|w/out|b/t|l/c|b/c|d/c|u/s)\b|\bw/(?!\w)"
SLASH = r"(/+)(?!in(?:nen)?|en)"
APOSTROPHE_WORD = r"\b([dlo]['’]\p{L}+)\b"
LATEX_QUOTES = r"(?:(?<!`)``(?!`))|(?:(?<!')''(?!'))"
LATEX_PAIR = r"(?<!`)(?P<a>`)(?:[^`']+)(?P<b>')(?!')"
QUOTE_PAIR = r"(?<!\p{L})(?P<a>['])(?:[^']+)(?P<b>['])(?!\p{L})"
SHARP = r"\b[acdfg]#(?:-\p{L}+)?(?!\w)"
HYPHEN = r"(?<=\w)-+(?=\w)"
ENGLISH_QUOTES = r"([„“”‚‘’\"»«›‹])"
ENGLISH_PUNCTUATION = r"([#<>%‰€$£₤¥°@~*,;:+×÷±≤≥=&/–—-]+)"
PUNCTUATION = r"([#<>%‰€$£₤¥°@~*„“”‚‘\"»«›‹,;:+×÷±≤≥=&–—])"
ELLIPSIS = r"\.{2,}|…+(?:\.{2,})?"
GLUED_DOT = r"(?<=\p{Ll}{2})(\.)(?=\p{Lu}\p{Ll}{2})"
DOT = r"(\.)"


def _c(pattern: str, fold: bool = False):
    return regex.compile(pattern, regex.IGNORECASE if fold else 0)


class Within:
    """Whether a text, in lower case if ``fold``, holds any of ``parts``, or one of the characters and a match of the pattern that go together."""

    def __init__(self, *parts: str, fold: bool = False, patterns: tuple = ()):
        self.parts, self.fold, self.patterns = parts, fold, patterns

    def search(self, text: str) -> bool:
        low = text.lower() if self.fold else text
        return any(p in low for p in self.parts) or any(any(c in text for c in chars) and p.search(text) for chars, p in self.patterns)


_DOT_LETTER, _ROMAN_DOT = _c(r"\.\p{L}"), _c(r"[MDCLXVI]\.")
_URL_START = Within("://", "www.", fold=True)
_DOT_GLUED = Within("-", patterns=((".", _c(r"\.\S")),))
_SINGLE = Within("/", ";", patterns=((".", _DOT_LETTER), ("345", _c(r"\d\p{L}"))))
_LETTERS_BEFORE = _c(r"(?r)\p{L}+")
_DOTS, _DATE, _ISBN_DIGITS = Within("..", "…"), _c(r"\d[./-]\d"), _c(r"[0-9][0-9X -]{8}", True)


class AbbreviationHint:
    """Where an open piece has letters and a dot that can begin an abbreviation.

    An abbreviation starts where no letter or dot precedes, so its letters up to the
    first dot are a whole run of letters in the piece: a single letter, or one that an
    entry begins with.
    """

    def __init__(self, entries: tuple[str, ...]):
        starts = [regex.match(r"\p{L}+\.", e.lower()) for e in entries]
        self.starts = frozenset(m.group()[:-1] for m in starts if m) if all(starts) else None

    def places(self, text: str) -> Iterator[int]:
        at = 0
        for part in text.split(".")[:-1]:
            at += len(part) + 1
            word = part[part.rfind(" ") + 1 :]
            if not (word.isascii() and word.isalpha()):
                found = _LETTERS_BEFORE.match(word)
                if not found:
                    continue
                word = found.group()
            if len(word) == 1 or word.lower() in self.starts or not word.isascii():
                yield at - 1 - len(word)

    def matches(self, pattern, text: str) -> Iterator:
        """The matches of the pattern of abbreviations, looked for only where one can begin."""
        if self.starts is None:
            yield from pattern.finditer(text)
            return
        end = 0
        for at in self.places(text):
            if at >= end and (found := pattern.match(text, at)):
                end = found.end()
                yield found


_abbreviation_hint = lru_cache(maxsize=16)(AbbreviationHint)


class FaceHint:
    """Whether a text has any face of the lists or can match the patterns of emoticons."""

    start = _c(r"[:;8][-'oO]?[()*DPp]|D'?:|:\w+:")

    def __init__(self, faces: tuple[str, ...]):
        self.by_key: dict[str, list[str]] = {}
        for face in sorted({*faces, "XD", "xD", "oO"}):
            self.by_key.setdefault(_rare_characters([face]), []).append(face)

    def search(self, text: str) -> bool:
        if any(key in text and any(f in text for f in faces) for key, faces in self.by_key.items()):
            return True
        return (":" in text or ";" in text or "8" in text) and bool(self.start.search(text))


def _rare_characters(faces, first: str = "") -> str:
    """Characters of which every face has one: those of ``first`` or else, for each face, one that is rare in prose."""
    out = set(first)
    for face in faces:
        if out.isdisjoint(face):
            out.add(max(face, key=lambda c: (not c.isascii(), not c.isalnum() and c not in " .,-()", not c.isalnum() and c not in " .")))
    return "".join(sorted(out))


@dataclass(frozen=True)
class RuleSet:
    """The rules of one configuration: before and after invisible characters are removed."""

    early: tuple[Rule, ...]
    late: tuple[Rule, ...]


def _contractions() -> list[Rule]:
    out = []
    for parts in CONTRACTIONS:
        groups = "".join(f"(?P<p{i}>{p})" for i, p in enumerate(parts.split("|"), 1))
        edge = r"(?<!\w)" if parts.startswith("[") else r"\b"
        apostrophe = "'" in parts
        out.append(Rule(f"contraction {parts}", "groups", _c(edge + groups + r"\b", True), needs="'’" if apostrophe else "", word="" if apostrophe else parts.replace("|", "")))
    return out


@lru_cache(maxsize=16)
def compile_rules(language: str, split_camel_case: bool, lexicon: Lexicon) -> RuleSet:
    """All passes in their order; the first rule that claims a span locks it."""
    en = language == EN
    plain = [e for e in ordered(lexicon.plus_ampersand) if not regex.fullmatch(r"\w+[&+]\w+", e)]
    words = frozenset(e.lower() for e in lexicon.plus_ampersand if regex.fullmatch(r"\w+[&+]\w+", e))
    camel = frozenset(e for e in lexicon.camel_case if regex.fullmatch(r"\w+", e))
    camel_names = [e for e in ordered(lexicon.camel_case) if not regex.fullmatch(r"\w+", e)]
    singles = {k: any_of(ordered(v)) for k, v in (("token", lexicons.SINGLE_TOKENS[language]), ("abbreviation", lexicons.SINGLE_TOKEN_ABBREVIATIONS[language]))}
    faces = any_of(ordered([*lexicons.EMOTICONS, *lexicons.TEXTFACES]))
    face_hint = FaceHint((*lexicons.EMOTICONS, *lexicons.TEXTFACES))
    early = [
        Rule("A6 xml declaration", "whole", _c(XML_DECLARATION, True), "XML_tag", "<"),
        Rule("A7 xml tag", "whole", _c(XML_TAG, True), "XML_tag", "<"),
        Rule("A8 textface with space", "whole", _c(any_of(ordered(lexicons.TEXTFACES_WITH_SPACE))), "emoticon", _rare_characters(lexicons.TEXTFACES_WITH_SPACE)),
        Rule("A9 flag", "whole", _c(FLAG), "emoticon", "".join(map(chr, range(0x1F1E6, 0x1F200)))),
        Rule("A10 textface with emoji", "whole", _c(any_of(ordered(lexicons.TEXTFACES_WITH_EMOJI))), "emoticon", "♥☼☉☝☞☜♪"),
        Rule("A11 emoji", "emoji", _c(r"\X"), "emoticon"),
    ]
    late = [
        Rule("B1 spaced emoticon", "whole", _c(SPACED_EMOTICON), "emoticon", ":;", template=r"\1\2"),
        Rule("B2 e-mail", "whole", _c(EMAIL), "email_address", "@[", join=True),
        Rule("B3 markdown link", "groups", _c(MARKDOWN_LINK, True), "symbol", "["),
        Rule("B4 url with parentheses", "whole", _c(URL_WITH_PARENTHESES, True), "URL", "(", hint=_URL_START),
        Rule("B5 url", "whole", _c(URL, True), "URL", ".:", hint=_URL_START),
        Rule("B6 doi", "whole", _c(DOI, True), "URL", ":"),
        Rule("B7 doi after space", "whole", _c(DOI_AFTER_SPACE, True), "URL", ":"),
        Rule("B8 bare url", "whole", _c(BARE_URL, True), "URL", ".", hint=_DOT_LETTER),
        Rule("B9 reddit", "whole", _c(REDDIT, True), "URL", "/"),
        Rule("B10 entity", "whole", _c(ENTITY, True), "XML_entity", "&"),
        Rule("B11 single token", "whole", _c(rf"(?<![\w.])(?:{singles['token']})(?!\p{{L}})", True), needs="./;345", hint=_SINGLE),
        Rule("B12 heart", "whole", _c(HEART), "emoticon", "<^"),
        Rule("B13 emoticon", "whole", _c(f"(?:{EMOTICON_FACE})|(?:{EMOTICON_REST})|{faces}"), "emoticon", _rare_characters([*lexicons.EMOTICONS, *lexicons.TEXTFACES], ":;8XxO"), hint=face_hint),
        Rule("B14 dingbat", "whole", _c(DINGBAT), "emoticon"),
        Rule("B15 mention", "whole", _c(MENTION), "mention", "@"),
        Rule("B16 hashtags", "inner", _c(HASHTAGS), "hashtag", "#", other=_c(HASHTAG)),
        Rule("B17 action word", "groups", _c(ACTION_WORD), "action_word", "*"),
        Rule("B18 underline", "groups", _c(UNDERLINE), needs="_"),
        Rule("B20 plus and ampersand", "whole", _c(rf"(?<!\w)(?:{any_of(plain)})(?!\w)", True), needs="+&") if plain else None,
        Rule("B21 plus and ampersand words", "member", _c(PLUS_WORD), needs="+&", other=(words, True)),
        *(
            [
                Rule("B22 camel-case names", "whole", _c(r"\b(?:" + "|".join([*map(regex.escape, camel_names), r":Mac\p{Lu}\p{Ll}*"]) + r")\b")),
                Rule("B23 camel-case words", "member", _c(CAMEL_WORD), other=(camel, False)),
                Rule("B24 In and Innen", "whole", _c(CAMEL_IN)),
                Rule("B25 camel case", "left", _c(CAMEL_CUT), None),
            ]
            if split_camel_case
            else []
        ),
        Rule("B26 gender marker", "whole", _c(GENDER, True), needs="*:/"),
    ]
    if en:
        late += [
            Rule("C1 decade", "whole", _c(DECADE), needs="0"),
            Rule("C2 d m s", "whole", _c(DMS, True), needs="'’"),
            Rule("C3 ll re ve", "whole", _c(LLREVE, True), needs="'’"),
            Rule("C4 not", "whole", _c(NOT, True), needs="'’"),
            Rule("C5 trailing apostrophe", "left", _c(TRAILING_APOSTROPHE), None, "'’"),
            *_contractions(),
            Rule("C44 No.", "whole", _c(NUMBER_ABBREVIATION, True), needs="0"),
            Rule("C45 degree", "whole", _c(DEGREE, True), needs="°"),
            Rule("C46 unbreakable word", "whole", _c(rf"\b(?:{any_of(ordered(lexicons.NONBREAKING_WORDS))})\b", True), needs="-"),
            Rule("C47 unbreakable prefix", "whole", _c(rf"(?<![\w-])(?:{any_of(ordered(lexicons.NONBREAKING_PREFIXES))})-[\w-]+", True), needs="-"),
            Rule("C48 unbreakable suffix", "whole", _c(rf"\b[\w-]+-(?:{any_of(ordered(lexicons.NONBREAKING_SUFFIXES))})(?![\w-])", True), needs="-"),
        ]
    dates = "whole" if en else "groups"
    units = any_of(ordered(lexicons.UNITS))
    known = any_of(ordered(lexicon.abbreviations, lower=True))
    late += [
        Rule("D1 measurement", "groups", _c(NO_NUMBER_BEFORE + f"(?:{NUMBER}|{NUMBER_RANGE})[ ]?(?P<unit>{units})" + r"(?!\w)", True), "measurement", "0"),
        Rule("D2 letter and ellipsis", "groups", _c(LETTER_ELLIPSIS), "abbreviation", ".", word="..."),
        Rule("D3 et cetera", "whole", _c(AND_CETERA), "abbreviation", "&"),
        Rule("D4 street", "whole", _c(STREET, True), "abbreviation", ".", word="str."),
        Rule("D5 number", "whole", _c(NUMBERED, True), "abbreviation", ".", word="nr."),
        Rule("D6 single-token abbreviation", "whole", _c(rf"(?<![\w.])(?:{singles['abbreviation']})(?!\p{{L}})", True), "abbreviation", ".-", hint=_DOT_GLUED),
        Rule("D7 letter", "whole", _c(LETTER_ABBREVIATION), "abbreviation", "."),
        Rule("D8 postscript", "whole", _c(POSTSCRIPT, True), "abbreviation", ".", word="ps."),
        Rule("D9 abbreviation", "abbreviation", _c(rf"(?<![\p{{L}}.])(?:(?:(?:\p{{L}}\.){{2,}})" + (f"|{known}" if known else "") + r")+(?!\p{L}{1,3}\.)", True), "abbreviation", ".", other=None if en else _c(MULTIPART), hint=_abbreviation_hint(lexicon.abbreviations)),
        Rule("D10 article", "whole", _c(ARTICLE, True), "abbreviation", "0"),
        Rule("E1 isbn", "whole", _c(ISBN, True), "number", "0", join=True, hint=_ISBN_DIGITS),
        Rule("E2 date ymd", dates, _c(DATE_YMD), "date", "0", hint=_DATE),
        Rule("E3 date dmy", dates, _c(DATE_DMY), "date", "0", hint=_DATE),
        Rule("E4 date mdy", dates, _c(DATE_MDY), "date", "0", hint=_DATE),
        Rule("E5 date dm", dates, _c(DATE_DM), "date", "0", hint=_DATE),
        Rule("E6 am and pm", "groups", _c(TIME_AM_PM, True), "time", "0") if en else None,
        Rule("E7 time", "whole", _c(TIME), "time", ":"),
        *([Rule("E8 us phone", "whole", _c(US_PHONE), "number", "0"), Rule("E9 us zip", "whole", _c(US_ZIP), "number", "0"), Rule("E10 identifier", "whole", _c(IDENTIFIER), "number", "0")] if en else []),
        Rule("E12 english ordinal", "whole", _c(ENGLISH_ORDINAL), "ordinal", "0") if en else Rule("E11 ordinal", "whole", _c(ORDINAL), "ordinal", "0"),
        Rule("E13 roman ordinal", "whole", _c(ROMAN_ORDINAL), "ordinal", ".", hint=_ROMAN_DOT),
        Rule("E14 number range", "groups", _c(NO_NUMBER_BEFORE + NUMBER_RANGE + NO_NUMBER_AFTER), "number", "0"),
        Rule("E15 fraction", "whole", _c(FRACTION), "number", "/"),
        Rule("E16 calculation", "groups", _c(CALCULATION), "number", "0"),
        Rule("E17 amount", "whole", _c(AMOUNT), "amount", "-"),
        Rule("E18 semester", "groups", _c(SEMESTER, True), "semester", "0"),
        Rule("E19 number compound", "whole", _c(NUMBER_COMPOUND), needs="0"),
        Rule("E20 number", "groups", _c(r"(?<!\w-?|\d[.,]?)" + NUMBER + NO_NUMBER_AFTER), "number", "0"),
        Rule("E21 ipv4", "whole", _c(NO_NUMBER_BEFORE + IPV4 + NO_NUMBER_AFTER), "number", "0"),
        Rule("E22 section", "whole", _c(NO_NUMBER_BEFORE + SECTION + NO_NUMBER_AFTER), "number", "0"),
        Rule("F1 question and exclamation", "whole", _c(QUESTION_EXCLAMATION), "symbol", "!?"),
        Rule("F2 arrow", "whole", _c(ARROW), "symbol", "<>" + "".join(map(chr, range(0x2190, 0x2200))), join=True),
        Rule("F3 brackets", "whole", _c(BRACKETS, True), "symbol", "()[]{}"),
        Rule("F4 slash word", "whole", _c(SLASH_WORD, True), needs="/") if en else Rule("F5 slash", "whole", _c(SLASH), "symbol", "/"),
        Rule("F6 apostrophe word", "whole", _c(APOSTROPHE_WORD, True), needs="'’"),
        Rule("F7 latex quotes", "whole", _c(LATEX_QUOTES), "symbol", "`'"),
        Rule("F8 latex pair", "groups", _c(LATEX_PAIR), "symbol", "`"),
        Rule("F9 quote pair", "groups", _c(QUOTE_PAIR), "symbol", "'"),
        Rule("F10 sharp", "whole", _c(SHARP, True), needs="#"),
        *(
            [Rule("F11 hyphen", "whole", _c(HYPHEN), "symbol", "-"), Rule("F12 quotes", "whole", _c(ENGLISH_QUOTES), "symbol"), Rule("F13 punctuation", "whole", _c(ENGLISH_PUNCTUATION), "symbol")]
            if en
            else [Rule("F14 punctuation", "whole", _c(PUNCTUATION), "symbol")]
        ),
        Rule("F15 ellipsis", "whole", _c(ELLIPSIS), "symbol", ".…", hint=_DOTS),
        Rule("F16 glued dot", "whole", _c(GLUED_DOT), "symbol", ".", hint=_DOT_LETTER),
        Rule("F17 dot", "whole", _c(DOT), "symbol", "."),
    ]
    return RuleSet(tuple(r for r in early if r), tuple(r for r in late if r))
