import pytest

from segmill.functions.sqludf import split_tokens
from segmill.operators.cascade import Options
from segmill.operators.engine import _rows, markup_units, paragraphs, sentences, text_units

EOS = "title h1 h2 h3 h4 h5 h6 p br hr div ol ul dl table".split()


def split(text, language="de_CMC"):
    o = Options(language)
    return [" ".join(t.text for t in s) for _, s in sentences(text_units(text, o), o)]


def xml(text, tag=None, strip=False, prune=None):
    o = Options()
    return [(k, t.text) for _, k, _, t in _rows(markup_units(text, o, EOS, prune), o, tag, strip)]


def joined(rows):
    return " ".join(t for _, t in rows)


@pytest.mark.parametrize(
    "text,expected",
    [
        ("Alles da. Wer kommt? Ich!", ["Alles da .", "Wer kommt ?", "Ich !"]),
        ("Wandern, usw. Worauf", ["Wandern , usw.", "Worauf"]),
        ('Foo "Bar." Baz.', ['Foo " Bar . "', "Baz ."]),
        ("A! 👍 B!", ["A ! 👍", "B !"]),
        ("Am 12. Juni geht es los.", ["Am 12. Juni geht es los ."]),
        ("Er kam. @wer weiß. #so. und so", ["Er kam .", "@wer weiß .", "#so . und so"]),
        ("Sie sagte: „Nein.“ Dann ging sie.", ["Sie sagte : „ Nein . “", "Dann ging sie ."]),
        ("(Ja.) Gut. (Nein)", ["( Ja . )", "Gut .", "( Nein )"]),
        ("ohne Punkt", ["ohne Punkt"]),
    ],
)
def test_split(text, expected):
    assert split(text) == expected


def test_split_english():
    assert split('He said "Go." Then he left.', "en_PTB") == ['He said " Go . "', "Then he left ."]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("<f><p>Ja</p> Du da. Er.</f>", [(0, "<f>"), (0, "<p>"), (0, "Ja"), (0, "</p>"), (1, "Du"), (1, "da"), (1, "."), (2, "Er"), (2, "."), (2, "</f>")]),
        ("<f>Ja<br/>Du</f>", [(0, "<f>"), (0, "Ja"), (1, "<br>"), (1, "</br>"), (1, "Du"), (1, "</f>")]),
        ("<f><p></p><p>Ja</p></f>", [(0, "<f>"), (0, "<p>"), (0, "</p>"), (0, "<p>"), (0, "Ja"), (0, "</p>"), (0, "</f>")]),
    ],
)
def test_xml_sentences(text, expected):
    assert xml(text) == expected


@pytest.mark.parametrize(
    "text,expected",
    [
        ("<f>Er da. Sie da.</f>", "<f> <s> Er da . </s> <s> Sie da . </s> </f>"),
        ("<f><i>Er</i> da. Sie.</f>", "<f> <s> <i> Er </i> da . </s> <s> Sie . </s> </f>"),
        ("<f><i>Er. Sie</i> da.</f>", "<f> <i> <s> Er . </s> </i> <s> <i> Sie </i> da . </s> </f>"),
        ("<f>Er <i>da. Sie. Ich</i> auch.</f>", "<f> <s> Er <i> da . </i> </s> <i> <s> Sie . </s> </i> <s> <i> Ich </i> auch . </s> </f>"),
        ("<f><p>Er da.</p> <p></p> <p>Sie.</p></f>", "<f> <p> <s> Er da . </s> </p> <p> </p> <p> <s> Sie . </s> </p> </f>"),
        ("<f>Er da.<x/> Sie.<x/></f>", "<f> <s> Er da . </s> <x> </x> <s> Sie . </s> <x> </x> </f>"),
    ],
)
def test_sentence_tags(text, expected):
    assert joined(xml(text, "s")) == expected


def test_strip_prune_escape():
    assert xml("<f><p>hallo</p>du</f>", strip=True) == [(0, "hallo"), (1, "du")]
    assert joined(xml("<f>bar <del>x <del>y</del></del>baz</f>", prune=["del"])) == "<f> bar baz </f>"
    with pytest.raises(ValueError):
        xml("<f><b></f>")
    with pytest.raises(ValueError):
        markup_units("<f/>", Options(character_offsets=True), EOS, ["x"])


@pytest.mark.parametrize("text", ["<f>Er  &amp; &#228;h <b a='1'>so</b>!<br/>Ende é.</f>", "<?xml version='1.0'?>\r\n<f>\r\n<!-- c --><p>a&lt;b</p>\r\nx <![CDATA[y&z]]></f>"])
def test_xml_offsets(text):
    from html import unescape
    from unicodedata import normalize

    o = Options(character_offsets=True)
    for _, tokens in markup_units(text, o, EOS, None):
        for t in tokens:
            got = text[t.char_start : t.char_end]
            if t.markup:
                assert got.replace("'", '"') in (t.text, "") or got in ("<br/>",)
            else:
                assert normalize("NFC", unescape(got)) == t.text


def test_text_offsets():
    text = "Hallo  é­ : )\n\nZweite Zeile.\n"
    o = Options(character_offsets=True)
    got = [(t.text, text[t.char_start : t.char_end]) for _, ts in text_units(text, o, "empty_lines") for t in ts]
    assert got == [("Hallo", "Hallo"), ("é", "é"), (":)", ": )"), ("Zweite", "Zweite"), ("Zeile", "Zeile"), (".", ".")]


def test_paragraphs():
    assert paragraphs("a\n\nb\nc", "single_newlines") == [(0, "a\n"), (3, "b\n"), (5, "c")]
    assert paragraphs("a\nb\n\n\nc\n", "empty_lines") == [(0, "a\nb\n\n"), (5, "\n"), (6, "c\n")]
    assert paragraphs("", "empty_lines") == [] and paragraphs("", None) == [(0, "")]
    with pytest.raises(ValueError):
        paragraphs("a", "tabs")


def test_pretokenized():
    assert split_tokens("Ja . Nein .".split()) == [["Ja", "."], ["Nein", "."]]
    assert split_tokens("<foo> <p> hallo </p> du </foo>".split(), eos_tags={"p"}) == [["<foo>", "<p>", "hallo", "</p>"], ["du", "</foo>"]]
    assert split_tokens("<foo> Foo <br/> bar </foo>".split(), eos_tags={"br"}) == [["<foo>", "Foo"], ["<br/>", "bar", "</foo>"]]
    assert split_tokens([]) == [[]]
