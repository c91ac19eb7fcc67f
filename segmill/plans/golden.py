"""Golden rows: small inputs with the tokens, sentences and places that the rules ask for.

Each query runs the engine over the inputs of its table; its SQL form lists what is
expected. The tables hold at least one row for every pass and for every operator on
sentences, markup, offsets and evaluation, since the driver's texts lack most of them.
In an expected row tokens stand between bars, their class after two colons unless it is
``regular``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sqludf
from ..operators import evaluate
from ..operators.cascade import Options
from ..operators.engine import extra_info, records, sentence_texts, tokenize_text, tokenize_xml
from ..sources.text import paragraphs, read_lexicon, scratch
from . import cli

# (pass, language, text, expected tokens)
CASCADE = [
    ('A1 nfc', 'de', 'Cafe\u0301 und u\u0308ber', 'Café | und | über'),
    ('A2 white space', 'de', 'ein\xa0\u2003Haus\tam\nSee', 'ein | Haus | am | See'),
    ('A3 controls', 'de', 'Glo\x07cke\x7f', 'Glocke'),
    ('A4 stranded selector', 'de', 'nun ️ja', 'nunja'),
    ('A5 white space again', 'de', 'eins \x07 zwei', 'eins | zwei'),
    ('A6 xml declaration', 'de', '<?xml version="1.0" encoding="UTF-8"?> Los', '<?xml version="1.0" encoding="UTF-8"?>::XML_tag | Los'),
    ('A7 xml tag', 'de', "<b class='x'>fett</b> <Bild fehlt>", "<b class='x'>::XML_tag | fett | </b>::XML_tag | <::symbol | Bild | fehlt | >::symbol"),
    ('A8 textface with space', 'de', 'na ( \u0361\xb0 \u035c\u0296 \u0361\xb0) so', 'na | ( \u0361\xb0 \u035c\u0296 \u0361\xb0)::emoticon | so'),
    ('A9 flag', 'de', 'nach 🇦🇹🇨🇭!', 'nach | 🇦🇹::emoticon | 🇨🇭::emoticon | !::symbol'),
    ('A10 textface with emoji', 'de', 'los ☜(ﾟヮﾟ☜) du', 'los | ☜(ﾟヮﾟ☜)::emoticon | du'),
    ('A11 emoji', 'de', 'Oma\U0001f469\u200d\U0001f373\U0001f44d\U0001f3fd!', 'Oma | \U0001f469\u200d\U0001f373::emoticon | \U0001f44d\U0001f3fd::emoticon | !::symbol'),
    ('A12 invisibles', 'de', 'Blu\xadmen\u200bbeet', 'Blumenbeet'),
    ('A13 white space once more', 'de', 'vor \u2060 nach', 'vor | nach'),
    ('A14 drop empty', 'de', '\xad \u200b\n\xad', ''),
    ('B1 spaced emoticon', 'de', 'na gut : ) und ; ( aber Fax: (0049) 30', 'na | gut | :)::emoticon | und | ;(::emoticon | aber | Fax | :::symbol | (::symbol | 0049::number | )::symbol | 30::number'),
    ('B2 e-mail', 'de', 'an eva.m+neu@post.example.de, oder eva [at] post [dot] de!', 'an | eva.m+neu@post.example.de::email_address | ,::symbol | oder | eva[at]post[dot]de::email_address | !::symbol'),
    ('B3 markdown link', 'de', 'siehe [das Buch](https://buch.example.org/x) hier', 'siehe | [::symbol | das | Buch | ]::symbol | (::symbol | https://buch.example.org/x::URL | )::symbol | hier'),
    ('B4 url with parentheses', 'de', 'auf https://wiki.example.org/Ort_(Land) und dort', 'auf | https://wiki.example.org/Ort_(Land)::URL | und | dort'),
    ('B5 url', 'de', '(http://www.ort.example/a?b=1) und www.ort.example.', '(::symbol | http://www.ort.example/a?b=1::URL | )::symbol | und | www.ort.example::URL | .::symbol'),
    ('B6 doi', 'de', 'doi:10.1234/abc.5-x gelesen', 'doi:10.1234/abc.5-x::URL | gelesen'),
    ('B7 doi after space', 'de', 'DOI: 10.1234/abc.5-x gelesen', 'DOI | :::symbol | 10.1234/abc.5-x::URL | gelesen'),
    ('B8 bare url', 'de', 'bild.jpg, ort.de-Leser und liste.xlsx', 'bild.jpg::URL | ,::symbol | ort.de-Leser::URL | und | liste.xlsx::URL'),
    ('B9 reddit', 'de', 'in /r/brot/ und u/koch-x', 'in | /r/brot/::URL | und | u/koch::URL | -x'),
    ('B10 entity', 'de', 'A &amp; B &#8364; &#x20ac; &nbsp;', 'A | &amp;::XML_entity | B | &#8364;::XML_entity | &#x20ac;::XML_entity | &::symbol | nbsp | ;::symbol'),
    ('B11 single token', 'de', 'das 5G-Netz und 4G, tl;dr', 'das | 5G | -Netz | und | 4G | ,::symbol | tl;dr'),
    ('B12 heart', 'de', 'ich <3 dich, 2<3 und <33', 'ich | <3::emoticon | dich | ,::symbol | 2::number | <::symbol | 3::number | und | <::symbol | 33::number'),
    ('B13 emoticon', 'de', 'ja :-) nein ;( oO XDD :lach: um 10:30:15 ¯\\_(ツ)_/¯', 'ja | :-)::emoticon | nein | ;(::emoticon | oO::emoticon | XDD::emoticon | :lach:::emoticon | um | 10:30:15::time | ¯\\_(ツ)_/¯::emoticon'),
    ('B14 dingbat', 'de', 'gut✓ Regen☔', 'gut | ✓::emoticon | Regen | ☔::emoticon'),
    ('B15 mention', 'de', 'Dank an @eva_m, gruss@bonn', 'Dank | an | @eva_m::mention | ,::symbol | gruss | @bonn::mention'),
    ('B16 hashtags', 'de', '#brot#wein-fest! C#', '#brot::hashtag | #wein-fest::hashtag | !::symbol | C#'),
    ('B17 action word', 'de', '*lacht* und +nickt* aber * so *', '*::action_word | lacht::action_word | *::action_word | und | +::action_word | nickt::action_word | *::action_word | aber | *::symbol | so | *::symbol'),
    ('B18 underline', 'de', '_sehr wichtig_ und snake_case', '_ | sehr | wichtig | _ | und | snake_case'),
    ('B20 plus and ampersand', 'de', 'in C++ und Canal+ aber 3+ mehr', 'in | C++ | und | Canal+ | aber | 3::number | +::symbol | mehr'),
    ('B21 plus and ampersand words', 'de', 'bei at&t und R&B, nicht x&y', 'bei | at&t | und | R&B | ,::symbol | nicht | x | &::symbol | y'),
    ('B22 camel-case names', 'de', 'die A:MacDings und Mac', 'die | A | :MacDings | und | Mac'),
    ('B23 camel-case words', 'de', 'eBay und YouTube', 'eBay | und | YouTube'),
    ('B24 In and Innen', 'de', 'LehrerInnen und SchülerIn', 'LehrerInnen | und | SchülerIn'),
    ('B25 camel case', 'de', 'derZug undDann GmbH NRWTag', 'der | Zug | und | Dann | GmbH | NRWTag'),
    ('B26 gender marker', 'de', 'Maler*innen, Bäcker:in, Koch/innen', 'Maler*innen | ,::symbol | Bäcker:in | ,::symbol | Koch/innen'),
    ('C1 decade', 'en', "the 1970s and 80's, 90s", "the | 1970s | and | 80's | ,::symbol | 90s"),
    ('C2 d m s', 'en', "he'd say I'm Eva's", "he | 'd | say | I | 'm | Eva | 's"),
    ('C3 ll re ve', 'en', "we'll see, they're in, you’ve won", "we | 'll | see | ,::symbol | they | 're | in | ,::symbol | you | ’ve | won"),
    ('C4 not', 'en', "I don't and can’t", "I | do | n't | and | ca | n’t"),
    ('C5 trailing apostrophe', 'en', "the boys' ball, Max' hat", "the | boys | ' | ball | ,::symbol | Max | ' | hat"),
    ('C6-C39 two parts', 'en', "alot gonna gotta lemme outta wanna c'mon 'tis 'twas d'ye more'n", "a | lot | gon | na | got | ta | lem | me | out | ta | wan | na | c'm | on | 't | is | 't | was | d' | ye | more | 'n"),
    ('C6-C39 two parts', 'en', 'theres im youre hes shes aint arent isnt dont doesnt didnt', 'there | s | i | m | you | re | he | s | she | s | ai | nt | are | nt | is | nt | do | nt | does | nt | did | nt'),
    ('C6-C39 two parts', 'en', 'ive youve theyve havent hasnt cannot cant couldnt wont wouldnt youll lets', 'i | ve | you | ve | they | ve | have | nt | has | nt | can | not | ca | nt | could | nt | wo | nt | would | nt | you | ll | let | s'),
    ('C40-C43 three parts', 'en', "dunno Whaddya whatcha i'ma", "du | n | no | Wha | dd | ya | wha | t | cha | i | 'm | a"),
    ('C44 No.', 'en', 'No. 7 won, no. None', 'No. | 7::number | won | ,::symbol | no | .::symbol | None'),
    ('C45 degree', 'en', 'at 20 °C or 68°F', 'at | 20::number | °C | or | 68::number | °F'),
    ('C46 unbreakable word', 'en', 'an x-ray, uh-huh', 'an | x-ray | ,::symbol | uh-huh'),
    ('C47 unbreakable prefix', 'en', 'anti-war and e-mail-like', 'anti-war | and | e-mail-like'),
    ('C48 unbreakable suffix', 'en', 'child-less but child-care', 'child-less | but | child | -::symbol | care'),
    ('D1 measurement', 'de', '5 km, 30-50kg und 2,5 m²', '5::measurement | km::measurement | ,::symbol | 30::measurement | -::measurement | 50::measurement | kg::measurement | und | 2,5::measurement | m²::measurement'),
    ('D2 letter and ellipsis', 'de', 'ach, M... war da', 'ach | ,::symbol | M::abbreviation | ...::abbreviation | war | da'),
    ('D3 et cetera', 'de', 'Brot &c. und A&c.', 'Brot | &c.::abbreviation | und | A | &::symbol | c.::abbreviation'),
    ('D4 street', 'de', 'in der Ringstr. 5', 'in | der | Ringstr.::abbreviation | 5::number'),
    ('D5 number', 'de', 'die Kfz.-Nr. und Best.-Nr. 7', 'die | Kfz.-Nr.::abbreviation | und | Best.-Nr.::abbreviation | 7::number'),
    ('D6 single-token abbreviation', 'de', 'beim Dipl.-Ing. o.k.', 'beim | Dipl.-Ing.::abbreviation | o.k.::abbreviation'),
    ('D6 single-token abbreviation', 'en', 'e.g. at 5 a.m. sharp', 'e.g.::abbreviation | at | 5::number | a.m.::abbreviation | sharp'),
    ('D7 letter', 'de', 'Frau K. kam', 'Frau | K.::abbreviation | kam'),
    ('D8 postscript', 'de', 'Ps. danke, 100 PS. Ende', 'Ps.::abbreviation | danke | ,::symbol | 100::number | PS | .::symbol | Ende'),
    ('D9 abbreviation', 'de', 'vgl. bspw. u.a. bzw.ca. Haus.', 'vgl.::abbreviation | bspw.::abbreviation | u.::abbreviation | a.::abbreviation | bzw.::abbreviation | ca.::abbreviation | Haus | .::symbol'),
    ('D9 abbreviation', 'en', 'the U.K. vs. Dr. Hill et al.', 'the | U.K.::abbreviation | vs.::abbreviation | Dr.::abbreviation | Hill | et | al.::abbreviation'),
    ('D10 article', 'de', 'nach Art. 5 und seiner Art.', 'nach | Art.::abbreviation | 5::number | und | seiner | Art | .::symbol'),
    ('E1 isbn', 'de', 'ISBN 3-16-148410-0 und 978 3 16 148410 0', 'ISBN | 3-16-148410-0::number | und | 9783161484100::number'),
    ('E2 date ymd', 'de', 'am 2019-03-07 und 2019/3/7', 'am | 2019::date | -03::date | -07::date | und | 2019::date | /3::date | /7::date'),
    ('E2 date ymd', 'en', 'on 2019-03-07', 'on | 2019-03-07::date'),
    ('E3 date dmy', 'de', 'am 24.12.2019 und 1/2/19', 'am | 24.::date | 12.::date | 2019::date | und | 1/::date | 2/::date | 19::date'),
    ('E3 date dmy', 'en', 'on 24.12.2019', 'on | 24.12.2019::date'),
    ('E4 date mdy', 'de', 'am 12/24/2019', 'am | 12/::date | 24/::date | 2019::date'),
    ('E4 date mdy', 'en', 'on 12/24/2019', 'on | 12/24/2019::date'),
    ('E5 date dm', 'de', 'vom 24.12. bis 31.12.', 'vom | 24.::date | 12.::date | bis | 31.::date | 12.::date'),
    ('E5 date dm', 'en', 'from 24.12. on', 'from | 24.12.::date | on'),
    ('E6 am and pm', 'en', 'at 5:30 p.m. or 11pm', 'at | 5:30::time | p.m.::abbreviation | or | 11::time | pm::time'),
    ('E7 time', 'de', 'um 14:05 oder 14:05:30', 'um | 14:05::time | oder | 14:05:30::time'),
    ('E8 us phone', 'en', 'call 555-0199 or 212-555-0199', 'call | 555-0199::number | or | 212-555-0199::number'),
    ('E9 us zip', 'en', 'in 20500-0003 now', 'in | 20500-0003::number | now'),
    ('E10 identifier', 'en', 'id 12-34-56 and 100/200/300', 'id | 12-34-56::number | and | 100/200/300::number'),
    ('E11 ordinal', 'de', 'der 3. Mann im Jahr 1999. Und 12345.', 'der | 3.::ordinal | Mann | im | Jahr | 1999::number | .::symbol | Und | 12345.::ordinal'),
    ('E12 english ordinal', 'en', 'the 1st, 22nd, 3rd and 1,000th', 'the | 1st::ordinal | ,::symbol | 22nd::ordinal | ,::symbol | 3rd::ordinal | and | 1,000th::ordinal'),
    ('E13 roman ordinal', 'de', 'Ludwig XIV. kam', 'Ludwig | XIV.::ordinal | kam'),
    ('E14 number range', 'de', '10-20, 1.000–2.000 und 1/4-3/4', '10::number | -::number | 20::number | ,::symbol | 1.000::number | –::number | 2.000::number | und | 1/4::number | -::number | 3/4::number'),
    ('E15 fraction', 'de', 'zu 17/23 voll', 'zu | 17/23::number | voll'),
    ('E16 calculation', 'de', '3x4 und 5+6,5', '3::number | x::number | 4::number | und | 5::number | +::number | 6,5::number'),
    ('E17 amount', 'de', 'für 6.200,- Euro', 'für | 6.200,-::amount | Euro'),
    ('E18 semester', 'de', 'im WS15/16 und SoSe20', 'im | WS::semester | 15/16::semester | und | SoSe::semester | 20::semester'),
    ('E19 number compound', 'de', '3-fach, 12jährig und 18-Loch-Platz', '3-fach | ,::symbol | 12jährig | und | 18-Loch-Platz'),
    ('E20 number', 'de', '-5,5 und 1.234.567,8 und 2.5E3', '-5,5::number | und | 1.234.567,8::number | und | 2.5E3::number'),
    ('E21 ipv4', 'de', 'von 192.168.0.1 aus', 'von | 192.168.0.1::number | aus'),
    ('E22 section', 'de', 'siehe 2.3.1. und 4.5.6.7.8', 'siehe | 2.3.1.::number | und | 4.5.6.7.8::number'),
    ('F1 question and exclamation', 'de', 'Wie?!! Ja!', 'Wie | ?!!::symbol | Ja | !::symbol'),
    ('F2 arrow', 'de', 'A - > B, C --> D ← E', 'A | ->::symbol | B | ,::symbol | C | -->::symbol | D | ←::symbol | E'),
    ('F3 brackets', 'de', '(ja) [nein] {so} Kund(inn)en', '(::symbol | ja | )::symbol | [::symbol | nein | ]::symbol | {::symbol | so | }::symbol | Kund(inn)en'),
    ('F4 slash word', 'en', 'w/o and w/ b/c x/y', 'w/o | and | w/ | b/c | x | /::symbol | y'),
    ('F5 slash', 'de', 'und/oder Maler/innen Koch/en', 'und | /::symbol | oder | Maler/innen | Koch/en'),
    ('F6 apostrophe word', 'de', "O'Neill und l'Eau", "O'Neill | und | l'Eau"),
    ('F7 latex quotes', 'de', "``so'' sagt er", "``::symbol | so | ''::symbol | sagt | er"),
    ('F8 latex pair', 'de', "das `kleine' Haus", "das | `::symbol | kleine | '::symbol | Haus"),
    ('F9 quote pair', 'de', "das 'kleine' Haus, Hans' Hut", "das | '::symbol | kleine | '::symbol | Haus | ,::symbol | Hans' | Hut"),
    ('F10 sharp', 'de', 'in C# und F#-Moll', 'in | C# | und | F#-Moll'),
    ('F11 hyphen', 'en', 'a well-known man', 'a | well | -::symbol | known | man'),
    ('F12 quotes', 'en', "“so” he's ‘in’ „it“", "“::symbol | so | ”::symbol | he | 's | ‘::symbol | in | ’::symbol | „::symbol | it | “::symbol"),
    ('F13 punctuation', 'en', 'a, b; c: 5% and/or -- x=y', 'a | ,::symbol | b | ;::symbol | c | :::symbol | 5::number | %::symbol | and | /::symbol | or | --::symbol | x | =::symbol | y'),
    ('F14 punctuation', 'de', 'a, b; c: 5% §3 x=y –', 'a | ,::symbol | b | ;::symbol | c | :::symbol | 5::number | %::symbol | § | 3::number | x | =::symbol | y | –::symbol'),
    ('F15 ellipsis', 'de', 'na.. so... und…...', 'na | ..::symbol | so | ...::symbol | und | …...::symbol'),
    ('F16 glued dot', 'de', 'Er kam.Dann ging sie.so', 'Er | kam | .::symbol | Dann | ging | sie | .::symbol | so'),
    ('F17 dot', 'de', 'Ende.', 'Ende | .::symbol'),
    ('F18 white space split', 'de', 'drei kleine Worte', 'drei | kleine | Worte'),
]

STAGES = {"golden_normalisation": "A", "golden_spans": "B", "golden_english": "C", "golden_abbreviations": "D", "golden_numbers": "E", "golden_punctuation": "F"}

# (language, text, expected sentences, of tokens between spaces)
SENTENCES = [
    ("de", "Er kam. Sie ging.", ["Er kam .", "Sie ging ."]),
    ("de", "Brot, Milch usw. Dann ging er.", ["Brot , Milch usw.", "Dann ging er ."]),
    ("de", "Er rief „Halt!“ Dann kam sie.", ["Er rief „ Halt ! “", "Dann kam sie ."]),
    ("de", 'Sie sagt "Nein." Er geht.', ['Sie sagt " Nein . "', "Er geht ."]),
    ("de", 'Er sagt: "Komm." und geht.', ['Er sagt : " Komm . " und geht .']),
    ("de", "Toll! 👍 Weiter so!", ["Toll ! 👍", "Weiter so !"]),
    ("de", "Ist das so?! Ja …", ["Ist das so ?!", "Ja …"]),
    ("de", "Am 3. Mai kam er. am Abend", ["Am 3. Mai kam er . am Abend"]),
    ("de", "Gut. 700 kamen. 12. Mai", ["Gut .", "700 kamen . 12. Mai"]),
    ("de", "@eva kam. @udo ging. #brot!", ["@eva kam .", "@udo ging .", "#brot !"]),
    ("de", "Das (wirklich!) stimmt. (Ja.) Nun", ["Das ( wirklich ! ) stimmt .", "( Ja . )", "Nun"]),
    ("de", "Ja... nein... Doch", ["Ja ... nein ...", "Doch"]),
    ("de", "Fertig. – Los!", ["Fertig .", "– Los !"]),
    ("de", "Er (Udo) kam.) Sie", ["Er ( Udo ) kam . )", "Sie"]),
    ("de", "er kam. sie ging.", ["er kam . sie ging ."]),
    ("de", "kurz", ["kurz"]),
    ("en", 'He left. "Why?" she asked. I know.', ["He left .", '" Why ? " she asked .', "I know ."]),
    ("en", 'He said "Go." Then he left.', ['He said " Go . "', "Then he left ."]),
    ("en", "Mr. Hill left at 5 p.m. sharp. Ok.", ["Mr. Hill left at 5 p.m. sharp .", "Ok ."]),
    ("en", "See etc. Then go. 20 left.", ["See etc.", "Then go .", "20 left ."]),
    ("fr", "Il part. Elle reste.", ["Il part .", "Elle reste ."]),
    (None, "Er da. Sie da.", ["Er da .", "Sie da ."]),
]

# (how, XML, expected tokens by chunk); sentence-final tags are p and br
MARKUP = [
    ("plain", "<f a='x\"y'>Er &amp; <b c=\"1\">sie</b>.</f>", ["<f a=\"x&quot;y\"> Er &amp; <b c=\"1\"> sie </b> . </f>"]),
    ("plain", "<?xml version='1.0'?><!DOCTYPE f><f><!-- weg --><?pi weg?>da</f>", ["<f> da </f>"]),
    ("plain", "<f><p>Er da.</p><p>Sie da.</p>Nun</f>", ["<f> <p> Er da . </p>", "<p> Sie da . </p>", "Nun </f>"]),
    ("plain", "<f>eins<br/>zwei <b>drei</b></f>", ["<f> eins", "<br> </br> zwei <b> drei </b> </f>"]),
    ("plain", "<f>Wort<b/>mitte <i>im</i>mer</f>", ["<f> Wort <b> </b> mitte <i> im </i> mer </f>"]),
    ("plain", "<f><p>  </p><p>da &lt; dort &#228;</p></f>", ["<f> <p> </p> <p> da &lt; dort ä </p> </f>"]),
    ("strip", "<f><p>Er &amp; sie.</p><p>Du</p></f>", ["Er & sie .", "Du"]),
    ("prune", "<f>eins <del>zwei <b>drei</b></del>vier</f>", ["<f> eins vier </f>"]),
    ("html", "<p>eins<br>zwei<p>drei &amp; vier", ["<p> eins", "<br> </br> zwei", "<p> drei &amp; vier </p> </p>"]),
]

# (XML or text, expected document with sentence tags)
SENTENCE_TAGS = [
    ("<f>Er da. Sie da.</f>", "<f> <s> Er da . </s> <s> Sie da . </s> </f>"),
    ("<f><i>Er</i> da. Sie.</f>", "<f> <s> <i> Er </i> da . </s> <s> Sie . </s> </f>"),
    ("<f>Er <i>da.</i> Sie.</f>", "<f> <s> Er <i> da . </i> </s> <s> Sie . </s> </f>"),
    ("<f><i>Er. Sie</i> da.</f>", "<f> <i> <s> Er . </s> </i> <s> <i> Sie </i> da . </s> </f>"),
    ("<f>Er <i>da. Sie. Ich</i> auch.</f>", "<f> <s> Er <i> da . </i> </s> <i> <s> Sie . </s> </i> <s> <i> Ich </i> auch . </s> </f>"),
    ("<f><p>Er da.</p> <p></p> <p>Sie &amp; er.</p></f>", "<f> <p> <s> Er da . </s> </p> <p> </p> <p> <s> Sie &amp; er . </s> </p> </f>"),
    ("<f>Er da.<x/> Sie.<x/></f>", "<f> <s> Er da . </s> <x> </x> <s> Sie . </s> <x> </x> </f>"),
]

# (tokens given, sentence-final tags or none, expected sentences)
PRETOKENISED = [
    ("Ja . Nein .", None, ["Ja .", "Nein ."]),
    ('Er sagt " Ja . " Dann', None, ['Er sagt " Ja .', '" Dann']),
    ("<foo> <p> hallo </p> du </foo>", ["p"], ["<foo> <p> hallo </p>", "du </foo>"]),
    ("<foo> Foo <br/> bar </foo>", ["br"], ["<foo> Foo", "<br/> bar </foo>"]),
    ("<x:p> eins </x:p> zwei", ["p"], ["<x:p> eins </x:p> zwei"]),
]

# (text, expected tokens with extra information)
EXTRA = [
    ("Na gut : ) so!", [("Na", ""), ("gut", ""), (":)", 'OriginalSpelling=": )"'), ("so", "SpaceAfter=No"), ("!", "")]),
    ("n [at] p [dot] de.", [("n[at]p[dot]de", 'SpaceAfter=No, OriginalSpelling="n [at] p [dot] de"'), (".", "")]),
    ("(ja) -5,5%", [("(", "SpaceAfter=No"), ("ja", "SpaceAfter=No"), (")", ""), ("-5,5", "SpaceAfter=No"), ("%", "")]),
]

# (XML, expected (token, start, end) in characters of the source)
OFFSETS = [
    ("<f>Er &amp; <b a='1'>so</b>!<br/></f>", [("<f>", 0, 3), ("Er", 3, 5), ("&amp;", 6, 11), ('<b a="1">', 12, 21), ("so", 21, 23), ("</b>", 23, 27), ("!", 27, 28), ("<br>", 28, 33), ("</br>", 33, 33), ("</f>", 33, 37)]),
    ("<f>Cafe\u0301 : )  &#228;\u00ADh</f>", [("<f>", 0, 3), ("Café", 3, 8), (":)", 9, 12), ("äh", 14, 22), ("</f>", 22, 26)]),
    ("<f>\r\n<!-- c --><p>a&lt;b</p></f>", [("<f>", 0, 3), ("<p>", 15, 18), ("a", 18, 19), ("&lt;", 19, 23), ("b", 23, 24), ("</p>", 24, 28), ("</f>", 28, 32)]),
]

# part: (file, options); what comes out stands in FILE_LINES as (part, sentence, paragraph, token, line)
FILES = {
    "text": ("Er kam.\nSie auch.\n\nNun", "-t", "--split-sentences"),
    "lines": ("Er kam\n\nNun", "-s", "single_newlines", "-e"),
    "xml": ("<f><p>Er &amp; <del>weg</del>sie</p></f>", "--tag", "p", "--prune", "del"),
    "stripped": ("<f><p>Er &amp; sie</p></f>", "--strip-tags", "--tag", "p"),
    "tagged": ("Ja! Nein", "--sentence_tag", "s"),
}
FILE_LINES = [
    *[("text", s, p, i, line) for s, p, i, line in [(0, 0, 0, "Er|regular"), (0, 0, 1, "kam|regular"), (0, 0, 2, ".|symbol$"), (1, 0, 3, "Sie|regular"), (1, 0, 4, "auch|regular"), (1, 0, 5, ".|symbol$"), (2, 1, 0, "Nun|regular$")]],
    *[("lines", 0, p, i, line) for p, i, line in [(0, 0, "Er|"), (0, 1, "kam|"), (1, 0, "Nun|")]],
    *[("xml", 0, 0, i, line) for i, line in enumerate(["<f>", "<p>", "Er", "&amp;", "sie", "</p>", "</f>"])],
    *[("stripped", 0, 0, i, line) for i, line in enumerate(["Er", "&", "sie"])],
    *[("tagged", s, 0, i, line) for i, (s, line) in enumerate([(0, "<s>"), (0, "Ja"), (0, "!"), (0, "</s>"), (1, "<s>"), (1, "Nein"), (1, "</s>")])],
    *[("list", 0, 0, len(e), e) for e in ("bzw.", "usw.", "ca.")],
]
SQL_TABLE = [(1, 0, 0, "Er", "regular", ""), (1, 0, 1, "kam", "regular", "SpaceAfter=No"), (1, 0, 2, ".", "symbol", ""), (1, 1, 3, "Sie", "regular", ""), (1, 1, 4, "nicht", "regular", "SpaceAfter=No"), (1, 1, 5, "!", "symbol", "")]

# (separator, text, expected paragraphs with their starts)
PARAGRAPHS = [
    ("single_newlines", "a\n\nb\n \nc", [("a\n", 0), ("b\n", 3), ("c", 7)]),
    ("empty_lines", "a\nb\n\nc\n", [("a\nb\n\n", 0), ("c\n", 5)]),
    ("empty_lines", "\na", [("\n", 0), ("a", 1)]),
]

# Lines of one token each, by side and file; an empty line ends a sentence.
LINES = [("a", "gold", "Er kam . - Sie ging ."), ("a", "system", "Er kam. Sie gi ng ."), ("b", "gold", "<s> ja - nein"), ("b", "system", "ja - nei n")]
SCORES = [("a", 5, 1, 1, 1, 0, 1), ("b", 2, 1, 0, 2, 0, 0)]
CONCORDANCE = [("a", 4, "■", "Erkam■.Sieg"), ("a", 5, "●", "Erkam.●Siegi"), ("a", 10, "□", ".Siegi□ng."), ("b", 4, "□", "janei□n")]


def _class(token: str) -> tuple[str, str]:
    text, _, kind = token.rpartition("::") if "::" in token[1:] else (token, "", "")
    return text, kind or "regular"


def _cascade(stage: str):
    rows = [(f"{i:03d} {rule}", *r) for i, (rule, *r) in enumerate(CASCADE) if rule.startswith(stage)]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        inputs = spark.createDataFrame([r[:3] for r in rows], "rule string, lang string, text string")
        options = Options("de_CMC", split_camel_case=True, split_sentences=False)
        tokens = tokenize_text(inputs, options, id_col="rule", lang="lang", fields=["tok_no", "text", "token_class"])
        return tokens.select(F.col("doc_id").alias("rule"), "tok_no", F.col("text").alias("token"), "token_class")

    expected = [(rule, k, *_class(t)) for rule, _, _, e in rows for k, t in enumerate(e.split(" | ") if e else [])]
    return query, _values(expected, "rule VARCHAR, tok_no INTEGER, token VARCHAR, token_class VARCHAR")


def _values(rows: list[tuple], columns: str) -> str:
    """SQL for literal rows."""

    def literal(x) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    names = [c.split() for c in columns.split(", ")]
    casts = ", ".join(f"CAST(c{i} AS {kind}) AS {n}" for i, (n, kind) in enumerate(names))
    values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    return f"SELECT {casts} FROM (VALUES {values}) AS v({', '.join(f'c{i}' for i in range(len(names)))})"


def golden_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = spark.createDataFrame([(i, lang, text) for i, (lang, text, _) in enumerate(SENTENCES)], "doc_id long, lang string, text string")
    return sentence_texts(tokenize_text(inputs, lang="lang")).select("doc_id", "sent_no", "sentence")


def golden_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of XML and HTML documents by chunk: tags, texts, entities, chunks at sentence-final tags, stripping, pruning."""
    out = None
    hows = {"plain": {}, "strip": {"strip_tags": True}, "prune": {"prune_tags": ["del"]}, "html": {"html": True}}
    for how, more in hows.items():
        inputs = spark.createDataFrame([(i, xml) for i, (h, xml, _) in enumerate(MARKUP) if h == how], "doc_id long, xml string")
        t = tokenize_xml(inputs, Options(split_sentences=False), ["p", "br"], **more)
        out = t if out is None else out.unionByName(t)
    parts = F.sort_array(F.collect_list(F.struct("tok_no", "text")))
    return out.groupBy("doc_id", "par_no").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("chunk"))


def golden_sentence_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = spark.createDataFrame([(i, xml) for i, (xml, _) in enumerate(SENTENCE_TAGS)], "doc_id long, xml string")
    t = tokenize_xml(inputs, Options(), ["p"], xml_sentences="s", fields=["text"], nested=True)
    return t.select("doc_id", F.array_join("tokens.text", " ").alias("tagged"))


def golden_pretokenised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of given tokens through the functions for SQL: strings, strings with tags, and records."""
    sqludf.register(spark)
    spark.createDataFrame([(i, t.split(), tags) for i, (t, tags, _) in enumerate(PRETOKENISED)], "doc_id long, tokens array<string>, tags array<string>").createOrReplaceTempView("segmill_given")
    return spark.sql(
        """SELECT doc_id, CAST(k AS INT) AS sent_no, array_join(s, ' ') AS sentence
           FROM (SELECT doc_id, posexplode(if(tags IS NULL, segmill_split_de(tokens), segmill_split_xml_de(tokens, tags))) AS (k, s) FROM segmill_given)
           UNION ALL
           SELECT 100 + doc_id, CAST(k AS INT), array_join(transform(s, x -> x.text), ' ')
           FROM (SELECT doc_id, posexplode(segmill_split_records_de(transform(tokens, x -> named_struct('text', x, 'token_class', 'regular', 'extra_info', '')))) AS (k, s) FROM segmill_given WHERE tags IS NULL)"""
    )


def golden_extra_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EXTRA)], "doc_id long, text string")
    return tokenize_text(inputs, Options(split_sentences=False)).select("doc_id", "tok_no", F.col("text").alias("token"), extra_info().alias("extra_info"))


def golden_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tokens as records."""
    inputs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EXTRA)], "doc_id long, text string")
    t = tokenize_text(inputs, Options(split_sentences=False), nested=True).select("doc_id", F.posexplode(records(F.col("tokens"))).alias("tok_no", "r"))
    return t.select("doc_id", "tok_no", F.col("r.text").alias("token"), "r.extra_info")


def golden_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of tokens in XML: entities, tags, composed characters, emoticons with spaces, empty elements."""
    inputs = spark.createDataFrame([(i, xml) for i, (xml, _) in enumerate(OFFSETS)], "doc_id long, xml string")
    t = tokenize_xml(inputs, Options(split_sentences=False, character_offsets=True), nested=True, fields=["text", "char_start", "char_end"])
    return t.select("doc_id", F.posexplode("tokens").alias("tok_no", "t")).select("doc_id", "tok_no", F.col("t.text").alias("token"), "t.char_start", "t.char_end")


def golden_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for kind in ("single_newlines", "empty_lines"):
        inputs = spark.createDataFrame([(i, t) for i, (k, t, _) in enumerate(PARAGRAPHS) if k == kind], "doc_id long, text string")
        p = paragraphs(inputs, kind)
        out = p if out is None else out.unionByName(p)
    return out.select("doc_id", "par_no", F.col("par_start").cast("long").alias("par_start"), F.replace("text", F.lit("\n"), F.lit("/")).alias("paragraph"))


def _sides(spark: SparkSession) -> DataFrame:
    rows = [(file, side, i, "" if t == "-" else t) for file, side, text in LINES for i, t in enumerate(text.split())]
    lines = spark.createDataFrame(rows, "file string, side string, line_no int, token string")
    gold, system = (evaluate.characters(lines.filter(F.col("side") == s), ignore_tags=True) for s in ("gold", "system"))
    return evaluate.aligned(gold, system)


def golden_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confusion counts, precision, recall and F1 by file, and the corpus row."""
    per = evaluate.scores(_sides(spark))
    both = per.unionByName(evaluate.total(per))
    return both.select(*[F.col(c) if c == "file" else F.round(c, 9).alias(c) if c[-2:] in ("_p", "_r", "f1") else F.col(c).cast("long").alias(c) for c in both.columns])


def golden_concordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.concordance(_sides(spark), context=5)


def golden_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("a", "Er kam", "Er kam"), ("b", "Er kam", "Er kom mit"), ("c", "ja", "")]
    sides = (spark.createDataFrame([(f, 0, t.replace(" ", "")) for f, *both in rows for t in [both[k]]], "file string, line_no int, token string") for k in range(2))
    return evaluate.mismatches(evaluate.aligned(*(evaluate.characters(s) for s in sides)))


def golden_output_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command line's output: a token a line with class and extra information, a blank line after each sentence."""
    inputs = spark.createDataFrame([(0, "Er kam. Na gut : )")], "doc_id long, text string")
    out = cli.lines(tokenize_text(inputs, Options()), token_classes=True, extra=True, blank_lines=True)
    return out.select("ord.tok_no", F.replace(F.replace("value", F.lit("\t"), F.lit("|")), F.lit("\n"), F.lit("$")).alias("line"))


def golden_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files and XML files through the command line's options, and a word list."""

    def file(text: str) -> str:
        path = scratch(spark, "file")
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)
        return path

    out = None
    for part, (text, *options) in FILES.items():
        lines = cli.run(spark, cli.arguments([file(text), "-o", "-", *options]))
        row = lines.select(F.lit(part).alias("part"), "ord.*", F.replace(F.replace("value", F.lit("\t"), F.lit("|")), F.lit("\n"), F.lit("$")).alias("line"))
        out = row if out is None else out.unionByName(row)
    entries = read_lexicon(spark, file("# Liste\nbzw.\n\nCa.\nca.\nusw."), lower=True)
    words = entries.select(F.lit("list").alias("part"), F.lit(0).alias("s"), F.lit(0).alias("par_no"), F.length("entry").alias("tok_no"), F.col("entry").alias("line"))
    return out.unionByName(words)


def golden_sql_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and sentences through the table function for SQL."""
    sqludf.register(spark)
    spark.createDataFrame([(1, "Er kam. Sie nicht!"), (2, None)], "doc_id long, text string").createOrReplaceTempView("segmill_texts")
    return spark.sql("SELECT d.doc_id, t.sent_no, t.tok_no, t.token, t.token_class, t.extra_info FROM segmill_texts d, LATERAL segmill_tokenize(d.text, 'de') t")


def _scores_sql() -> str:
    names = [f"{k}_{c}" for k in ("tok", "sent") for c in ("tp", "fp", "fn")]
    counts = _values(SCORES, "file VARCHAR, " + ", ".join(f"{n} BIGINT" for n in names))
    measures = ", ".join(f"{k}_tp / ({k}_tp + {k}_fp) AS {k}_p, {k}_tp / ({k}_tp + {k}_fn) AS {k}_r, 2 * {k}_tp / (2 * {k}_tp + {k}_fp + {k}_fn) AS {k}_f1" for k in ("tok", "sent"))
    weight = {"tok": "(tok_tp + tok_fn)", "sent": "(sent_tp + sent_fp)"}
    ratios = [f"{k}_{m}" for k in ("tok", "sent") for m in ("p", "r", "f1")]
    means = ", ".join(f"round(sum({weight[r.partition('_')[0]]} * {r}) / sum({weight[r.partition('_')[0]]}), 9) AS {r}" for r in ratios)
    sums = ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in names)
    return f"""WITH c AS ({counts}), m AS (SELECT *, {measures} FROM c)
        SELECT file, {', '.join(names)}, {', '.join(f'round({r}, 9) AS {r}' for r in ratios)} FROM m UNION ALL SELECT 'TOTAL', {sums}, {means} FROM m"""


QUERIES = {name: _cascade(stage) for name, stage in STAGES.items()} | {
    "golden_sentences": (golden_sentences, _values([(i, k, s) for i, (_, _, e) in enumerate(SENTENCES) for k, s in enumerate(e)], "doc_id BIGINT, sent_no INTEGER, sentence VARCHAR")),
    "golden_markup": (golden_markup, _values([(i, k, s) for i, (_, _, e) in enumerate(MARKUP) for k, s in enumerate(e)], "doc_id BIGINT, par_no INTEGER, chunk VARCHAR")),
    "golden_sentence_tags": (golden_sentence_tags, _values([(i, e) for i, (_, e) in enumerate(SENTENCE_TAGS)], "doc_id BIGINT, tagged VARCHAR")),
    "golden_pretokenised": (
        golden_pretokenised,
        _values([(i + n, k, s) for n in (0, 100) for i, (_, tags, e) in enumerate(PRETOKENISED) if not n or tags is None for k, s in enumerate(e)], "doc_id BIGINT, sent_no INTEGER, sentence VARCHAR"),
    ),
    "golden_extra_info": (golden_extra_info, _values([(i, k, *t) for i, (_, e) in enumerate(EXTRA) for k, t in enumerate(e)], "doc_id BIGINT, tok_no INTEGER, token VARCHAR, extra_info VARCHAR")),
    "golden_records": (golden_records, _values([(i, k, *t) for i, (_, e) in enumerate(EXTRA) for k, t in enumerate(e)], "doc_id BIGINT, tok_no INTEGER, token VARCHAR, extra_info VARCHAR")),
    "golden_offsets": (golden_offsets, _values([(i, k, *t) for i, (_, e) in enumerate(OFFSETS) for k, t in enumerate(e)], "doc_id BIGINT, tok_no INTEGER, token VARCHAR, char_start INTEGER, char_end INTEGER")),
    "golden_paragraphs": (golden_paragraphs, _values([(i, k, a, t.replace("\n", "/")) for i, (_, _, e) in enumerate(PARAGRAPHS) for k, (t, a) in enumerate(e)], "doc_id BIGINT, par_no INTEGER, par_start BIGINT, paragraph VARCHAR")),
    "golden_files": (golden_files, _values(FILE_LINES, "part VARCHAR, s INTEGER, par_no INTEGER, tok_no INTEGER, line VARCHAR")),
    "golden_sql_table": (golden_sql_table, _values(SQL_TABLE, "doc_id BIGINT, sent_no INTEGER, tok_no INTEGER, token VARCHAR, token_class VARCHAR, extra_info VARCHAR")),
    "golden_scores": (golden_scores, _scores_sql()),
    "golden_concordance": (golden_concordance, _values(CONCORDANCE, "file VARCHAR, pos BIGINT, error VARCHAR, line VARCHAR")),
    "golden_mismatches": (golden_mismatches, _values([("b", 4, 3), ("c", 2, 0)], "file VARCHAR, differing BIGINT, first_at BIGINT")),
    "golden_output_lines": (golden_output_lines, _values([(0, "Er|regular|"), (1, "kam|regular|SpaceAfter=No"), (2, ".|symbol|$"), (3, "Na|regular|"), (4, "gut|regular|"), (5, ':)|emoticon|OriginalSpelling=": )"$')], "tok_no INTEGER, line VARCHAR")),
}


def queries() -> dict:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items()}
