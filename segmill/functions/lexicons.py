"""Word lists of the segmentation rules.

Fixed values stand as they must be for right results. Of the large lists (abbreviations,
names with plus or ampersand, camel-case names) the most frequent entries stand here.
Complete ones are a parameter: ``load`` reads files of a folder that hold one entry a
line, ``#`` starting a comment.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

# Fixed values.
SINGLE_TOKENS = {"de": ".Net /rant /s E/E tl;dr zl;ng S/4 R/3 3G 4G 5G".split(), "en": "tl;dr 3G 4G 5G".split()}
SINGLE_TOKEN_ABBREVIATIONS = {
    "de": """ak.mas Art.-Nr. At.-Gew. Best.-Nr. BT-Drs. Dipl.-Ing. E.ON Forsch.frage GV.NRW. H.-I. H.-Qu. IT.NRW klass.-lat.
        Komm.formen Krim.-Ob.-Insp. Kto.-Nr. L.-Abg. M.-Schr. Mat.-Nr. MBl.NRW. o.k. Pan.do/ra Priv.-Doz. prov.-fr. Proz.-Bev.
        r.-k. Reg.-Bez. Rg.-Präs. röm.-kath. Sat.1 SMBl.NRW. soz.-päd. SP.ON T.V. Uni-Kl. USt-IdNr. Zeitschr.titel""".split(),
    "en": "e.g. i.e. a.m. p.m. P.S. T.V.".split(),
}
EOS_ABBREVIATIONS = frozenset("usw. usf. etc. uvam.".split())
NONBREAKING_WORDS = "mm-hm mm-mm o-kay uh-huh uh-oh x-ray x-rayed x-rays".split()
NONBREAKING_PREFIXES = """a adeno agro ambi ante anti aorto arch axio be bi bio broncho centi circum cis co colo contra cortico counter cran cross
    crypto cyber de deca demi dis e eco electro ennea ex extra ferro gastro giga hemi hepta hexa hypo ideo idio in infra inter intra iso judeo
    macro medi mega micro mid milli mini mono multi musculo neo neuro nitro non novem octa octo ortho over paleo pan para pelvi penta peri pheno
    phospho pica pneumo poly post pre preter pro pseudo quadri quasi quinque re recto salpingo semi sept sero soci sub super supra sur tele tera
    tetra tri u uber ultra un uni veno ventriculo vice x""".split()
NONBREAKING_SUFFIXES = """able ahol aholic ation centric cracy crat dom er ery esque ette fest fold ful gate gon hood ian ible ing isation ise
    ising ism ist itis ization ize izing less logist logy ly most o-torium rama wise""".split()
UNITS = """bit cent cm cm2 cm3 cm^2 cm^3 cm² cm³ dm dm2 dm3 dm^2 dm^3 dm² dm³ eur f ft g gbit/s ghz h hz kg km km/h km2 km3 km^2 km^3 km² km³ l lb
    m m2 m3 m^2 m^3 mbit/s min ml mm mm2 mm3 mm^2 mm^3 mm² mm³ m² m³ qm s sek""".split()

# Frequent entries of the large lists, each of about 200; complete lists are a parameter.
ABBREVIATIONS = {
    "de": """abb. abh. abs. abschn. abzgl. adj. adr. adv. allg. amtl. anh. anl. anm. anschl. apr. archäol. aufl. aug. ausg. ausschl. az. bay. bd. bde. bearb. begr.
        ber. bes. beschl. betr. bez. bgbl. bibl. biol. bj. bln. bsp. bspw. bzgl. bzw. ca. cf. chem. co. ders. dez. dgl. di. dipl. diss. do. doz. dr.
        dt. ebd. ehem. eigtl. einschl. einw. engl. entspr. etc. etw. ev. evang. evtl. exkl. fa. fam. feb. ff. forts. fr. franz. frz. fußn. geb. gebr.
        gegr. gem. geogr. ges. gesch. gest. gez. ggf. ggfs. hbf. hist. hl. hr. hrn. hrsg. hs. ing. inkl. insb. insbes. int. ital. jan. jg. jh. jhd.
        jmd. jmdm. jmdn. jr. jul. jun. jur. kap. kath. kfm. kl. kto. lfd. lit. lt. ltd. mag. math. max. mdl. med. mi. min. mind. mio. mitgl. mo. mr.
        mrd. mrs. ms. mtl. mwst. möbl. nachf. nachm. nat. niederl. nov. nr. nördl. obj. okt. orig. österr. östl. phys. pl. polit. prof. psych. rd.
        reg. rel. resp. röm. sa. sep. sept. sog. soz. spez. sr. st. std. stellv. str. stud. südl. techn. tel. tsd. tägl. ugs. univ. urspr. usf. usw.
        verf. vergl. verh. vgl. vllt. vors. vs. westl. wg. wiss. ziff. zool. zt. zus. zz. zzgl. zzt.""".split(),
    "en": """abbrev. acad. acct. adj. adm. adv. agric. al. alt. amer. anat. apr. archaeol. archit. assoc. astron. aug. ave. biol. blvd. bros. calif. capt. cf. ch.
        chem. chr. chron. co. col. coll. colloq. comm. comp. conf. congr. conj. contrib. corp. corr. dec. def. dep. dept. descr. dict. diss. dist.
        div. doc. dr. econ. ed. educ. encycl. eng. esp. etc. exc. exec. ext. fam. feb. fig. fl. fr. freq. fri. ft. gen. geog. geogr. geol. geom. gov.
        govt. hist. hosp. inc. ind. inst. instr. int. internat. intr. ital. jan. jap. jr. jrnl. jul. jun. lang. lat. lb. lit. lt. ltd. mag. mar. mech.
        med. mem. mil. min. misc. mon. mr. mrs. ms. mss. mt. mts. mus. nat. nov. num. obj. obs. oct. okla. ont. opp. org. orig. pers. ph.d. phil.
        philos. phys. pl. plur. pol. polit. prep. pres. prob. proc. prof. pron. prov. ps. psychol. publ. quot. rec. ref. reg. rel. rep. repr. rev.
        russ. sat. sc. sch. sci. sen. sep. sept. ser. soc. sp. spec. sq. sr. st. stat. str. subj. suppl. surg. syst. techn. technol. tel. theol. thur.
        trans. transl. treas. tue. ult. univ. va. var. vet. viz. vocab. vol. vols. vs. wed. wk. wks. yr. yrs. zool.""".split(),
}
PLUS_AMPERSAND = """A&E A&M A&P A&R A++ A+++ AAC+ AD&D ANT+ ARCH+ AT&T Auer+Weber B&B B&C B&F B&M B&O B&Q B&T B&W B+B BB&T BD+ Belle&Sebastian Bild+Funk Blohm+Voss C&A
    C&C C&D C&L C&M C&O C&P C&R C&S C&T C&W C++ C++Builder Canal+ CD+DVD CD+G CI+ COM+ Ctrl+Alt+Del D&A D&B D&D D&G D&O D&S D&W DAB+ Digital+
    Do&Co DTS++ DVD+R DVD+RW E&N E&Y E+ EG&G Endress+Hauser Erasmus+ F&A F&B F&E F&F F&K F&R Fix+Foxi G&B G&D G&L G++ G+H G+J Go+ Google+
    Gruner+Jahr GTK+ GTX+ H&H H&K H&M H&N H&R H&S Hahn+Kolb HD+ HSPA+ Huber+Suhner I&K I&U info+ J&B J&J J&M J&P J&S J&T J+S Johnson&Johnson
    Jugend+Technik K&K K&L K&M K&N K&R K&S K+S Kaiser+Kraft L&C L&M L&N L&P L&S Landis+Gyr LIFE+ M&A M&B M&D M&G M&M M&Ms M&S M&T Mann+Hummel
    Markt+Technik Notepad++ O&K O&M P&A P&C P&E P&G P&I P&L P&M P&O P&P P&R P&T P&W P+R PAL+ Park&Ride Peek&Cloppenburg Pen&Paper Pepperl+Fuchs
    PG&E Plug&play Plus+ Pratt&Whitney Procter&Gamble Q&A R&A R&B R&D R&F R&R R&S Rohde&Schwarz S&D S&G S&H S&K S&P S&T S&W Serve&Volley
    Sport+Technik StrongDC++ SXGA+ T&D T&T TACACS+ V&A V&R V&S VIVA+ W&B W&W WXGA+ X++ Y&R Yin&Yang""".split()
# Own examples.
CAMEL_CASE = """AirBnB BaFöG BMBFplus BibTeX eBay FaceBook GitHub GitLab GmbH iPhone iPad InDesign JavaScript LibreOffice LinkedIn MacBook
    MySQL OpenOffice PayPal PepsiCo PhD PlayStation PostgreSQL PowerPoint QuickTime SharePoint SoundCloud StackOverflow TeX TikTok
    TypeScript WhatsApp WikiLeaks WordPress YouTube""".split()

# Emoticons and text faces.
EMOTICONS = r"""(-.-) (T_T) (♥_♥) )': )-: (-: )= )o: )x :'C :/ :< :C :[ =( =) =D =P >: \: ]: x( ^^ o.O \O/ \m/ :;)) _)) *_* ._. >_< *<:-) :!: :;-)) x'D :^)
    (>_<) :-> \o/ B-) :-$ O:-) =-O :O :-! :-x :-| :-\ :-[ >:-( ^.^""".split()
TEXTFACES_WITH_SPACE = r"""⚆ _ ⚆
˙ ͜ʟ˙
◔ ⌣ ◔
( ﾟヮﾟ)
(• ε •)
(づ￣ ³￣)づ
♪~ ᕕ(ᐛ)ᕗ
\ (•◡•) /
( ಠ ͜ʖರೃ)
( ⚆ _ ⚆ )
(▀̿Ĺ̯▀̿ ̿)
༼ つ ◕_◕ ༽つ
༼ つ ಥ_ಥ ༽つ
( ͡° ͜ʖ ͡°)
( ͡°╭͜ʖ╮͡° )
(╯°□°）╯︵ ┻━┻
( ͡ᵔ ͜ʖ ͡ᵔ )
┬──┬ ノ( ゜-゜ノ)
┬─┬ノ( º _ ºノ)
(ง ͠° ͟ل͜ ͡°)ง
(͡ ͡° ͜ つ ͡͡°)
﴾͡๏̯͡๏﴿ O'RLY?
（╯°□°）╯︵( .o.)
(° ͡ ͜ ͡ʖ ͡ °)
┬─┬ ︵ /(.□. ）
(/) (°,,°) (/)
| (• ◡•)| (❍ᴥ❍ʋ)
༼ つ ͡° ͜ʖ ͡° ༽つ
(╯°□°)╯︵ ʞooqǝɔɐɟ
┻━┻ ︵ヽ(`Д´)ﾉ︵ ┻━┻
┬┴┬┴┤ ͜ʖ ͡°) ├┬┴┬┴
(ó ì_í)=óò=(ì_í ò)
(•_•) ( •_•)>⌐■-■ (⌐■_■)
(ﾉ◕ヮ◕)ﾉ*:･ﾟ✧ ✧ﾟ･: *ヽ(◕ヮ◕ヽ)
[̲̅$̲̅(̲̅ ͡° ͜ʖ ͡°̲̅)̲̅$̲̅]
/╲/\╭( ͡° ͡° ͜ʖ ͡° ͡°)╮/\╱\
( ͡°( ͡° ͜ʖ( ͡° ͜ʖ ͡°)ʖ ͡°) ͡°)
(._.) ( l: ) ( .-. ) ( :l ) (._.)
̿ ̿ ̿'̿'\̵͇̿̿\з=(•_•)=ε/̵͇̿̿/'̿'̿ ̿
༼ ºل͟º ༼ ºل͟º ༼ ºل͟º ༽ ºل͟º ༽ ºل͟º ༽
̿'̿'\̵͇̿̿\з=( ͠° ͟ʖ ͡°)=ε/̵͇̿̿/'̿̿ ̿ ̿ ̿ ̿ ̿
̿̿ ̿̿ ̿̿ ̿'̿'\̵͇̿̿\з= ( ▀ ͜͞ʖ▀) =ε/̵͇̿̿/’̿’̿ ̿ ̿̿ ̿̿ ̿̿
ヽ(°◇° )ノ
■-■¬ <(•_•)""".split("\n")
TEXTFACES_WITH_EMOJI = "♥‿♥ ☼.☼ ≧☉_☉≦ (°ロ°)☝ (☞ﾟ∀ﾟ)☞ ☜(˚▽˚)☞ ☜(⌒▽⌒)☞ (☞ຈل͜ຈ)☞ ヾ(⌐■_■)ノ♪ (☞ﾟヮﾟ)☞ ☜(ﾟヮﾟ☜)".split()
TEXTFACES = r"""=U ಠ_ಠ ◉_◉ ಥ_ಥ :') ಠ⌣ಠ ಠ~ಠ ಠ_ಥ ಠ‿↼ ʘ‿ʘ ಠoಠ ರ_ರ ◔̯◔ ¬_¬ ب_ب °Д° ^̮^ >_> ಠ╭╮ಠ (>ლ) ʕ•ᴥ•ʔ (ಥ﹏ಥ) (ᵔᴥᵔ) (¬‿¬) ⌐╦╦═─ (•ω•) (¬_¬) ｡◕‿◕｡ (ʘ‿ʘ) ٩◔̯◔۶
    (>人<) (~_^) (^̮^) (･.◤) (◕‿◕✿) ｡◕‿‿◕｡ (─‿‿─) (；一_一) (ʘᗩʘ') (✿´‿`) ლ(ಠ益ಠლ) ~(˘▾˘~) (~˘▾˘)~ (｡◕‿◕｡) (っ˘ڡ˘ς) ლ(´ڡ`ლ) ƪ(˘⌣˘)ʃ (´・ω・`)
    (ღ˘⌣˘ღ) (▰˘◡˘▰) 〆(・∀・＠) ༼ʘ̚ل͜ʘ̚༽ ᕙ(⇀‸↼‶)ᕗ ᕦ(ò_óˇ)ᕤ (｡◕‿‿◕｡) ヽ༼ຈل͜ຈ༽ﾉ (ง°ل͜°)ง ╚(ಠ_ಠ)=┐ (´・ω・)っ由 Ƹ̵̡Ӝ̵̨̄Ʒ ¯\_(ツ)_/¯ ▄︻̷̿┻̿═━一 (ง'̀-'́)ง
    ¯\(°_o)/¯ ｡゜(｀Д´)゜｡ (づ｡◕‿‿◕｡)づ (;´༎ຶД༎ຶ`) (ノಠ益ಠ)ノ彡┻━┻ ლ,ᔑ•ﺪ͟͠•ᔐ.ლ (ﾉ◕ヮ◕)ﾉ*:･ﾟ✧ ┬┴┬┴┤(･_├┬┴┬┴ [̲̅$̲̅(̲̅5̲̅)̲̅$̲̅]
    \(ˆ˚ˆ)/ (╥﹏╥) (╯°□°)╯︵ ┻━┻ ┬─┬ ノ(°–°ノ) (^._.^)ﾉ ฅ^•ﻌ•^ฅ (•_•) (■_■¬) ƪ(ړײ)ƪ""".split()

#: Tags whose start and end are sentence boundaries unless others are named.
EOS_TAGS = frozenset("title h1 h2 h3 h4 h5 h6 p br hr div ol ul dl table".split())


def ordered(entries, lower: bool = False) -> list[str]:
    """Distinct entries, longest first and then by text."""
    return sorted({e.lower() if lower else e for e in entries}, key=lambda e: (-len(e), e))


@dataclass(frozen=True)
class Lexicon:
    """The replaceable lists of a language; plain tuples, so that it can go to workers."""

    abbreviations: tuple[str, ...] = ()
    plus_ampersand: tuple[str, ...] = tuple(PLUS_AMPERSAND)
    camel_case: tuple[str, ...] = tuple(CAMEL_CASE)
    source: str = field(default="")


def read_entries(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [x for line in f if (x := line.strip()) and not x.startswith("#")]


def load(language: str, folder: str | None = None) -> Lexicon:
    """The lists of ``language`` (de or en), those found in ``folder`` in place of the built-in ones."""

    def pick(name: str, own: list[str]) -> tuple[str, ...]:
        path = os.path.join(folder, name) if folder else ""
        return tuple(read_entries(path) if path and os.path.exists(path) else own)

    return Lexicon(pick(f"abbreviations_{language}.txt", ABBREVIATIONS[language]), pick("tokens_with_plus_or_ampersand.txt", PLUS_AMPERSAND), pick("camel_case_tokens.txt", CAMEL_CASE), folder or "")
