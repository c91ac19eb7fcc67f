"""Golden rows of the cascade, by stage; German unless said otherwise."""

import random

import pytest

from segmill.functions.lexicons import Lexicon
from segmill.operators.cascade import Options, Piece, apply_rule, checked, cut, drop_empty, segment_text

DE, EN = Options("de_CMC", split_camel_case=True), Options("en_PTB", split_camel_case=True)


def words(text, options=DE):
    return " ".join(t.text for t in segment_text(text, options))


GERMAN = [
    ("foo   bar\n", "foo bar"),
    ("­ \n ­", ""),
    ("Haus​tür", "Haustür"),
    ("tag quaki : )", "tag quaki :)"),
    ("Tel: ( 0049)", "Tel : ( 0049 )"),
    ("Na 👨‍👩‍👧‍👦 ok", "Na 👨‍👩‍👧‍👦 ok"),
    ("🇩🇪🇫🇷", "🇩🇪 🇫🇷"),
    ("#a#b.", "#a #b ."),
    ("(http://www.x.de) s", "( http://www.x.de ) s"),
    ("siehe http://x.de/a_(b) .", "siehe http://x.de/a_(b) ."),
    ("[Text](http://x.de/y)", "[ Text ] ( http://x.de/y )"),
    ("doi:10.1000/xyz und doi: 10.1/ab", "doi:10.1000/xyz und doi : 10.1/ab"),
    ("auf x.com-App und /r/foo", "auf x.com-App und /r/foo"),
    ("n [at] p [dot] com", "n[at]p[dot]com"),
    ("a.b@c.de,", "a.b@c.de ,"),
    ("2<3!", "2 < 3 !"),
    ("du <3 mich", "du <3 mich"),
    (":smile: um 08:30:00", ":smile: um 08:30:00"),
    ("XD :-)) ;P T_T", "XD :-)) ;P T_T"),
    ("winke@bochum", "winke @bochum"),
    ("*grins* und +seufz*", "* grins * und + seufz *"),
    ("_ganz wichtig_", "_ ganz wichtig _"),
    ("bei AT&T und R&B", "bei AT&T und R&B"),
    ("derText", "der Text"),
    ("eBay LehrerInnen PepsiCo", "eBay LehrerInnen PepsiCo"),
    ("Schüler*innen Lehrer:in Student(inn)en", "Schüler*innen Lehrer:in Student(inn)en"),
    ("30-50kg 5 km", "30 - 50 kg 5 km"),
    ("vgl.z.B.die", "vgl. z. B. die"),
    ("Bahnhofstr. Art.-Nr. Art. 5", "Bahnhofstr. Art.-Nr. Art. 5"),
    ("a... b....", "a ... b. ..."),
    ("978 0 596 52068 7", "9780596520687"),
    ("16.07.2013 2016-01-27 20.06.", "16. 07. 2013 2016 -01 -27 20. 06."),
    ("um 2:40 am 3. XIV. Tag", "um 2:40 am 3. XIV. Tag"),
    ("1/2 7x4 6.200,- WS15/16", "1/2 7 x 4 6.200,- WS 15/16"),
    ("8-fach 18-Jährigen 1.000.000 -5,3", "8-fach 18-Jährigen 1.000.000 -5,3"),
    ("1.1.1. 192.168.0.1", "1.1.1. 192.168.0.1"),
    ("Was?!! - > so", "Was ?!! -> so"),
    ("und/oder Kolleg/innen", "und / oder Kolleg/innen"),
    ("O'Connor l'Enfer 'so' ``ja''", "O'Connor l'Enfer ' so ' `` ja ''"),
    ("C# „Ha“ a,b;c", "C# „ Ha “ a , b ; c"),
    ("Das ist.Und dann …", "Das ist . Und dann …"),
    ("&amp; <b class='x'>ja</b> <Medien weggelassen>", "&amp; <b class='x'> ja </b> < Medien weggelassen >"),
]
GERMAN += [  # lists: what they lack isn't an abbreviation or a name
    ("im ``LaTeX-Stil''!", "im `` LaTeX-Stil '' !"),
    ("Hey Mr. Maier", "Hey Mr. Maier"),
    ("Seine Art. Klar, die beste. Nun", "Seine Art . Klar , die beste . Nun"),
    ("Gehen wir zu McDonald's?", "Gehen wir zu McDonald's ?"),
    ("im 9. Jh. bzw. ca. 800", "im 9. Jh. bzw. ca. 800"),
]
ENGLISH = [
    ("the U.S., e.g. x", "the U.S. , e.g. x"),
    ("You cannot come!", "You can not come !"),
    ("don't I'll it's he'd", "do n't I 'll it 's he 'd"),
    ("Alex' dog, the boys'.", "Alex ' dog , the boys ' ."),
    ("dunno gonna 'tis lets", "du n no gon na 't is let s"),
    ("anty-foobar anti-foobar x-ray", "anty - foobar anti-foobar x-ray"),
    ("5:30p.m. 70's 21st 45 °F", "5:30 p.m. 70's 21st 45 °F"),
    ("No. 5 and no. Yes", "No. 5 and no . Yes"),
    ("01/27/2016 555-1234 12345-6789 1-2-3", "01/27/2016 555-1234 12345-6789 1-2-3"),
    ("w/o b/c and/or", "w/o b/c and / or"),
    ("a -- b", "a -- b"),
]


ENGLISH += [("in class. In a lab. They sing. We pop.", "in class . In a lab . They sing . We pop ."), ("Dr. Hill et al. vs. Mr. Hall", "Dr. Hill et al. vs. Mr. Hall")]


@pytest.mark.parametrize("text,expected", GERMAN)
def test_german(text, expected):
    assert words(text) == expected


@pytest.mark.parametrize("text,expected", ENGLISH)
def test_english(text, expected):
    assert words(text, EN) == expected


@pytest.mark.parametrize("text,token,token_class", [("http://x.de", "http://x.de", "URL"), ("a@b.de", "a@b.de", "email_address"), (":)", ":)", "emoticon"), ("@x", "@x", "mention"), ("#x", "#x", "hashtag"), ("z.B.", "z.", "abbreviation"), ("2:40", "2:40", "time"), ("3. Mai", "3.", "ordinal"), ("5", "5", "number"), ("5 kg", "kg", "measurement"), ("1.1.", "1.", "date"), ("<a>", "<a>", "XML_tag"), ("&lt;", "&lt;", "XML_entity"), ("!", "!", "symbol"), ("6.200,-", "6.200,-", "amount"), ("WS15", "WS", "semester"), ("*ha*", "ha", "action_word"), ("ha", "ha", "regular")])
def test_classes(text, token, token_class):
    assert {t.text: t.token_class for t in segment_text(text, DE)}[token] == token_class


def test_spaces_and_spelling():
    got = segment_text("tag quaki : ) ok!", DE)
    assert [(t.text, t.extra_info) for t in got] == [("tag", ""), ("quaki", ""), (":)", 'OriginalSpelling=": )"'), ("ok", "SpaceAfter=No"), ("!", "")]


def test_cut():
    p = Piece("ab cd ef", space_after=False, first_in_sentence=True, last_in_sentence=True)
    assert cut(p, [], "number") == [p]
    got = cut(p, [(3, 5, None)], "number")
    assert [(t.text, t.locked, t.space_after, t.first_in_sentence, t.last_in_sentence) for t in got] == [("ab", False, True, True, False), ("cd", True, True, False, False), ("ef", False, False, False, True)]
    got = cut(p, [(0, 2, "x"), (6, 8, None)], "number")
    assert [(t.text, t.original_spelling, t.space_after, t.first_in_sentence, t.last_in_sentence) for t in got] == [("x", "ab", True, True, False), ("cd", None, True, False, False), ("ef", None, False, False, True)]
    joined = cut(Piece("a b c"), [(0, 5, None)], "number", join=True)
    assert (joined[0].text, joined[0].original_spelling) == ("abc", "a b c")


def test_locked_and_markup_are_left_alone():
    rule = next(r for r in DE.rules().late if r.name.startswith("F17"))
    pieces = [Piece("a.b", locked=True), Piece("<a.b>", None, True, "start", False, True), Piece("a.b")]
    assert [p.text for p in apply_rule(pieces, rule)] == ["a.b", "<a.b>", "a", ".", "b"]


def test_drop_empty_hands_flags_on():
    a, b, c = Piece(" ", first_in_sentence=True), Piece("x"), Piece(" ", last_in_sentence=True)
    assert drop_empty([a, b, c]) == [b] and b.first_in_sentence and b.last_in_sentence
    assert drop_empty([Piece(" ", first_in_sentence=True)]) == []


def test_checks():
    assert Options("fr") == Options("de_CMC")
    with pytest.raises(ValueError):
        checked(Piece("x", "nonsense"))
    with pytest.raises(ValueError):
        checked(Piece("x", markup_class="start"))
    assert checked(Piece("<a>", None, True, "start", False)).text == "<a>"
    assert Options("de").code == Options("de_CMC").code == "de"


def test_own_lexicon(tmp_path):
    (tmp_path / "abbreviations_de.txt").write_text("# mine\nXyz.\n\n", encoding="utf-8")
    own = Options("de", lexicon_folder=str(tmp_path))
    assert words("Der Xyz. ging bzw. lief", own) == "Der Xyz. ging bzw . lief"
    assert isinstance(own.lexicon, Lexicon) and own.lexicon.abbreviations == ("Xyz.",)


def test_guards_change_nothing(monkeypatch):
    """Rules that a look at the text rules out would not have matched."""
    import random

    from segmill.functions import lexicons
    from segmill.operators import cascade

    r = random.Random(6)
    stock = [t for t, _ in GERMAN + ENGLISH] + lexicons.EMOTICONS + lexicons.TEXTFACES + lexicons.TEXTFACES_WITH_SPACE + lexicons.TEXTFACES_WITH_EMOJI
    stock += lexicons.ABBREVIATIONS["de"][:40] + lexicons.PLUS_AMPERSAND + ["Unter der Brücke steht ein Hund.", "Caſt's no. 5", "DON'T im HES", "S-Bahnhofſtr. Pſ. "]
    texts = stock + [r.choice([" ", "", "."]).join(r.choices(stock, k=r.randint(2, 5))) for _ in range(400)]
    plain = lambda t, o: [(p.text, p.token_class, p.space_after) for p in segment_text(t, o)]
    with_guards = [plain(t, o) for t in texts for o in (DE, EN)]

    def every_rule(pieces, table):
        for rule in table:
            pieces = apply_rule(pieces, rule)
        return pieces

    monkeypatch.setattr(cascade, "_pass", every_rule)
    assert [plain(t, o) for t in texts for o in (DE, EN)] == with_guards


@pytest.mark.parametrize("language", ["de", "en"])
def test_hints_miss_nothing(language):
    rules = {r.name.split()[0]: r for r in Options(language).rules().late}
    parts = ["z.B.", "usw.", "USW.", "ſt.", "É.", "é.t.", "a.", "b.c.", "x1a.", "..", ".", " ", "(", "gut", "No.", "etc.", ":)", "8-D", "D':", "xD", "oO", ":ja:", "^_^", "2004-03-12", "5.6.", "978-3-16-148410-0", "X", "ja.Das", "http://a.de", "WWW.b.de/(c)", "4ever", "U-", "XI."]
    rng = random.Random(3)
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 8))) for _ in range(3000)]
    for text in texts:
        rule = rules["D9"]
        assert [m.span() for m in rule.hint.matches(rule.pattern, text)] == [m.span() for m in rule.pattern.finditer(text)], text
        for name in ("B4", "B5", "B8", "B11", "B13", "D6", "E1", "E2", "E3", "E4", "E5", "E13", "F15", "F16"):
            assert rules[name].hint.search(text) or not rules[name].pattern.search(text), (name, text)
