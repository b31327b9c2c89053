"""Sentence boundaries in any script, as one chain of SQL expressions.

Every step keeps the number of code points, so places in the masked text are places in the text:

1. blank lines, list marks and the dots of decimals, URLs, initials and abbreviations give way to placeholders of
   the private-use area; quotations are found, their quotes told apart and terminators inside them masked;
2. a marker goes in behind each terminator that its script's rule lets end a sentence;
3. the pieces between markers are trimmed, and their places restore the text by substring.

Texts change language and their language tag may be wrong, so no list is chosen by a tag: an abbreviation counts by what
stands beside it. Those that name a number need one, those that name somebody need a name, and only those that are no
word of another language need nothing. A short word before a small letter is an abbreviation, known or not.

No pattern has a bound on lengths, looks back or ahead over a stretch of text it has looked at before, or recurses;
places come from prefix sums by doubling. Time grows in proportion to the text (n log n in its sentences).

Blanks are Unicode white space. A private-use character in the source counts as a letter. Null and blank texts give no
sentence; equal texts give equal sentences; a text without a terminator is one sentence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seriesmill.functions.let import let

# Placeholders: masked dot, blank line, terminator that is a question mark or a bar elsewhere, closing and opening quote,
# last letter of a quotation, other masked terminator, list item's line break, boundary.
DOT, GAP, ASK, SHUT, OPEN, LAST, INNER, ITEM, CUT = (chr(0xE000 + i) for i in range(9))

# Abbreviations by language. A number follows (or a letter by itself, as in Pt. B) ...
NUMBERED = {
    "en": "Fig Figs fig figs No Nos p pp Vol Vols Sec Eq Eqs Ref Refs Ch Pt Dept Art Ex App Par Sect",
    "de": "Abb Tab S Nr Bd Kap Art Abs Str Anm Z",
    "fr": "fig Fig tab Tab chap vol no nos n art p pp",
    "es": "pág págs Pág núm núms Núm cap Cap fig art",
    "it": "fig tab pag pagg cap n nn art",
    "pt": "fig tab pág págs cap núm n art",
    "ru": "рис Рис табл Табл стр Стр гл с ст п",
    "el": "σχ Σχ πίν Πίν σελ Σελ αρ κεφ άρθ",
    "hi": "सं पृ",
    "ar": "ص",
}
# ... a name follows ...
NAMED = {
    "en": "Dr Mr Mrs Ms Prof Gen Rev St Mt Sgt Lt Col Capt Cpl Maj Sen Rep Gov Hon Pres Messrs Adm",
    "de": "Hr Fr Frl Dr Prof St Dipl Ing",
    "fr": "M MM Mme Mmes Mlle Me Dr Pr St Ste",
    "es": "Sr Sres Sra Sras Srta D Dr Dra Lic Ing Gral",
    "it": "Sig Sigg sig sigg Dott dott Ing ing Avv avv Prof prof",
    "pt": "Sr Sra Srta Dr Dra Exmo Exma Ilmo Ilma Eng",
    "ru": "им ул проф Проф акад пр наб",
    "el": "κ κκ δρ Δρ καθ",
    "hi": "डॉ श्री प्रो",
    "ar": "د م أ",
}
# ... the sentence goes on, whatever follows.
RUNNING = {
    "en": "approx Approx vs cf Cf viz e.g i.e E.g I.e",
    "de": "ca bzw z. B z.B d. h d.h u. a u.a vgl Vgl evtl ggf inkl exkl sog",
    "fr": "env p. ex",
    "es": "aprox Aprox p. ej",
    "it": "cfr Cfr p. es",
    "pt": "aprox p. ex cf",
    "ru": "см См ср т. е т.е напр",
    "el": "βλ Βλ περ Περ π.χ Π.χ πρβλ",
}
# Abbreviations that end a sentence too, if what follows looks like the start of one.
MAY_END = "etc|est|U.S|U.K|a.m|p.m|Inc|Ltd|Co|Jr|Sr|usw|ecc|EE. UU|т. д|т.д|т. п|т.п|др|г|гг|κ.λπ|κ.ά".split("|")
# What the U.S. is part of a name with.
OF_STATE = "Air|Army|Bureau|Census|Coast|Congress|Constitution|Department|Dollar|Embassy|Federal|Geological|Government|House|Marine|Marines|Navy|President|Senate|Supreme|Treasury"
# Words that begin sentences, and are no names.
STARTERS = {
    "en": "The This That These Those There Then It He She We They You In On At As By For From With But And Or If When Where Why What Who How Is Are Was Did Do Not Most Some All Only After Before",
    "de": "Der Die Das Ein Eine Es Er Sie Wir Ich Im Am Auf Bei Für Aber Und Wenn Wo Warum Wer Wie Dann Nach Vor Von Mit",
    "fr": "Le La Les Un Une Il Elle Ils Elles Nous Vous Je Ce Cette Ces Dans Sur En Au Pour Mais Et Si Quand Où Puis Après",
    "es": "El Los Las Una Él Ella Ellos Se Esta Este Con Por Para Pero Y Cuando Donde Luego Después",
    "it": "Il Lo Gli Un Una Nel Nella Questo Questa Per Ma Poi Dopo Quando Si",
    "pt": "O Os As Um Uma Ele Ela Eles No Na Este Esta Mas Depois Quando Se",
    "ru": "Он Она Оно Они Мы Вы Это Эта Этот Эти В На По Из От Но И А Если Когда Где Почему Что Кто Как Затем Потом После",
    "el": "Ο Η Το Οι Τα Τον Την Αυτό Αυτή Στο Στη Αλλά Και Όταν Μετά",
}
# German words that follow an ordinal number.
ORDINALS = "Januar|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Quartal|Jahrhundert|Halbjahr|Woche|Tag|Auflage|Kapitel|Klasse"
# Chinese words and Japanese particles with which a clause goes on behind a quotation; Chinese verbs that report speech.
GOES_ON_HAN = "但|而|却|并|且|然后|于是|所以|因此|可是|不过|的|和|与|或|等|之"
GOES_ON_KANA = "と|って|など|の|は|が|を|に|も|で|や|か|だ|な|へ|から|まで|より"
SAY_HAN = "[问说道答喊叫写想讲]"

QUOTES = [("“", "”"), ("„", "“"), ("„", "”"), ("«", "»"), ("「", "」"), ("『", "』"), ('"', '"')]
WIDE = "。！？｡．"
TERMS = ".!?…؟।॥" + WIDE + ASK
SHUTS = rf")\]}}）】〉》」』”’»{SHUT}"
OPENS = rf"(\[{{（【〈《「『“‘«„¿¡{OPEN}"
#: What may begin a sentence behind a quotation, an ellipsis or an abbreviation: an upper-case letter, a digit, an opening mark or a single letter with a hyphen, as in x-axis.
START = rf"(?:\p{{Lu}}|\p{{Nd}}|[{OPENS}]|\p{{L}}-\p{{L}})"
CASELESS = r"\p{Lo}"
#: Cheap tests that most characters fail before a class of many is tried.
TERM_NEXT = rf"(?=[.!?\u061f-\uffff])(?!\p{{L}})(?=[{TERMS}])"
BLANK = "[\\s\u00a0]"
WORD = r"\p{L}\p{N}"
HAN, KANA, THAI, DEVANAGARI, ARABIC, HANGUL = r"\p{IsHan}", r"\p{IsHiragana}\p{IsKatakana}", "\u0e00-\u0e45\u0e47-\u0e7f", "\u0900-\u097f", "\u0600-\u06ff", "\uac00-\ud7a3"
#: Blanks that are trimmed off a sentence.
EDGES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000" + GAP + ITEM


def _any(words: list[str]) -> str:
    """A pattern for any of the words that tries no letter twice; a blank stands for any white space."""
    heads: dict[str, list[str]] = {}
    for w in sorted(set(words)):
        heads.setdefault(w[:1], []).append(w[1:])
    tails = [(h if h not in ". " else {".": r"\.", " ": r"\s"}[h]) + _any(rest) for h, rest in heads.items() if h]
    return f"(?:{'|'.join(tails)}{'|' if '' in heads else ''})" if tails else ""


def _all(words: dict[str, str], joint: str = " ") -> list[str]:
    """The words of all languages; a blank behind a dot belongs to its word."""
    return [w.replace("\0", ". ") for text in words.values() for w in text.replace(". ", "\0").split(joint)]


def _dots() -> str:
    """A pattern for dots that end nothing. It looks back from the dot, so that only dots cost anything."""
    first = rf"(?<![{WORD}])(?<!(?<![{WORD}])\p{{L}}{{1,2}}\.)"  # not inside a word or an abbreviation
    number = rf"(?={BLANK}*+(?:[(\[№#]*+\p{{Nd}}|[IVXLC]++(?![{WORD}])|\p{{Lu}}(?![{WORD}.])))"
    starters = rf"{_any(_all(STARTERS))}(?![{WORD}])"
    name = rf"(?={BLANK}*+(?:\p{{Lu}}|{CASELESS}|[{OPENS}]))(?!\s+{starters})"
    running, parts = _all(RUNNING), []
    for w in running + MAY_END:
        bits = w.split(".")
        parts += [(".".join(bits[:n]), ".".join(bits[n:])) for n in range(1, len(bits))]
    ends = rf"[{SHUTS}\"“]*+(?:\s++(?:{START}|\"|{CASELESS})|\s*+(?:[{GAP}{ITEM}]|$))"
    cases = [
        rf"{number}(?<={first}{_any(_all(NUMBERED))}\.)",
        rf"{name}(?<={first}{_any(_all(NAMED))}\.)",
        rf"(?<={first}{_any(running)}\.)(?<!\p{{Nd}}\s?см\.)",
        rf"(?!{ends})(?<={first}{_any(MAY_END)}\.)",
        rf"(?=\s+(?:{OF_STATE})(?![{WORD}]))(?<={first}U\.S\.)",
        rf"(?=\s+\p{{Lu}})(?!\s+{starters})(?<=(?<!\p{{Nd}}\s?){first}г\.)",  # a town, not a year
        rf"(?=\s+\p{{L}})(?!\s+{starters})(?<={first}\p{{Lu}}\.)",  # initials
        rf"(?=\s?\p{{L}}{{1,2}}\.)(?:{'|'.join(rf'(?={BLANK}?{_any([b])}{chr(92)}.)(?<={first}{_any([a])}{chr(92)}.)' for a, b in sorted(set(parts)))})",  # inside abbreviations
    ]
    # Decimals and versions; ordinals; words short enough to be abbreviations.
    return rf"[.．](?:(?=\p{{Nd}})(?<=[\p{{Nd}}v_].)|(?=\s+(?:{ORDINALS})\b)(?<=\p{{Nd}}\.)(?<!(?:1[5-9]|20)\d\d\.)|(?<=(?<![{WORD}])[\p{{L}}\p{{M}}]{{1,6}}\.)(?:{'|'.join(cases)}))"


def _ends() -> str:
    """A pattern for terminators, with what closes behind them, that end a sentence: one rule per script and case."""
    quiet = r"[)\]}）】〉》]*+"
    shut = rf"(?:{BLANK}?{SHUT}|[”’»“\"])++"
    short = rf"(?!{BLANK}++\p{{Ll}}(?!-)(?<=(?<![{WORD}])\p{{L}}{{1,3}}\.{BLANK}.))"
    reported = rf"[^{TERMS}：:，、；\n“”「」『』{OPEN}{SHUT}{GAP}{ITEM}]*+(?<={SAY_HAN}[道着了]?)[。，！？｡]"
    cases = [
        # Scripts with blanks: before anything but a mark that goes on; behind an ellipsis or a closing quote only before what looks like a start.
        # Tried where a run of terminators begins, and possessive: neither recursion nor another try at each of a run's places.
        rf"(?<![!?؟।॥{ASK}])(?<!(?<!\.)\.(?!\.))(?:[!?؟।॥{ASK}]++|(?<!\.)\.(?!\.))++{quiet}(?={BLANK}++[^\s\u00a0,;:\-–—{SHUTS}{GAP}{ITEM}]){short}",
        rf"(?<![\s.…])(?:\.\.+|…+){quiet}(?={BLANK}++(?:{START}|{CASELESS}))",
        rf"[{TERMS}]{quiet}{shut}{quiet}(?={BLANK}++{START})",
        # A blank left out between two sentences.
        rf"[.!?](?<=(?:[\p{{Ll}}\p{{M}}]{{2}}|\p{{Ll}}[ \u00a0]|[!?]).)[{SHUTS}]*+(?=(?:\p{{Lu}}|[¿¡])[\p{{L}}\s])",
        r"(?<=\p{Nd})[!?]++(?=\p{Lu}\p{Ll})",
        r"[.!?][)\]](?=\p{Lu}\p{Ll})",
        rf"[।॥?!{ASK}]{quiet}(?=[{DEVANAGARI}])",
        rf"[.؟!](?<=[{ARABIC}].){quiet}(?=[{ARABIC}])",
        rf"[.?!](?<=[{HANGUL}].){quiet}(?=[{HANGUL}])",
        # Scripts without blanks: wide terminators end a sentence, behind a closing quote unless the clause goes on.
        rf"(?<![{WIDE}])[{WIDE}]++[.!?…{WIDE}]*+{quiet}(?![{SHUTS}.!?…{WIDE}])",
        rf"(?<![\p{{Nd}}…])…{{2,}}{quiet}(?=[{HAN}{KANA}\p{{Nd}}{OPENS}a-zA-Z])",
        rf"(?:[{WIDE}]|……){quiet}{SHUT}++{quiet}(?=\s*+[{HAN}{KANA}\p{{Nd}}{OPENS}a-zA-Z])(?!{GOES_ON_HAN}|{GOES_ON_KANA}|[{HAN}]{reported})",
    ]
    return rf"{TERM_NEXT}(?:{'|'.join(cases)})"


def _if_any(t: Column, needles: list[str], step: Callable[[Column], Column]) -> Column:
    """step on a text that holds one of the needles, else the text: a search of bytes is far cheaper than a pattern."""

    def gated(x: Column) -> Column:
        found = F.lit(False)
        for n in needles:
            found = found | F.contains(x, F.lit(n))
        return F.when(found, step(x)).otherwise(x)

    return let(t, gated)


def masked(text: Column) -> Column:
    """text with placeholders, as long as before."""
    number = r"(?!(?:1[5-9]|20)\d\d(?!\d))\d++"  # a year that begins a line is no list mark
    clause = r";\u037e.!?。！？\ue001-\ue007"
    greek = r"[\u0370-\u03ff\u1f00-\u1fff]"
    mark = lambda start: rf"({start}[ \t]*+{number})\.(?=[ \t]+\S)"

    def lines(x: Column) -> Column:
        x = F.regexp_replace(x, r"\n([\s\u00a0&&[^\n]]*+)(?=\n)", f"{GAP}$1")
        x = F.regexp_replace(x, rf"\n(?=[ \t]*+(?:[•‣◦▪*\-–]|{number}[.)])[ \t]+\S)", ITEM)
        return F.regexp_replace(x, mark(r"[\n\ue001-\ue007]"), f"$1{DOT}")

    def questions(x: Column) -> Column:
        """The Greek question mark ends a clause whose first letter is Greek; a bar behind Devanagari is a danda."""
        of_clause = rf"((?:[{clause}]|\G|^)[^\p{{L}}{clause}]*+{greek}[^{clause}]*+)[;\u037e](?=[\s{SHUTS}\"]|$)"
        return F.regexp_replace(x, rf"{of_clause}|([{DEVANAGARI}]\s*+)\|(?!\|)", f"$1$2{ASK}")

    urls = lambda x: F.regexp_replace(x, r"(://|\G(?!^))([^\s.!?]*+)[.!?](?=[^\s.!?\p{L}\p{N}]*+[\p{L}\p{N}])", f"$1$2{DOT}")
    # The placeholders' first two bytes; a character that begins with them becomes a letter.
    foreign = F.contains(text.cast("binary"), F.lit(b"\xee\x80"))
    t = F.when(foreign, F.regexp_replace(text, "[\ue000-\ue03f]", "x")).otherwise(text)
    t = _if_any(t, ["\n"], lines)
    t = _if_any(t, ["://"], urls)
    t = _if_any(t, ["."], lambda x: F.regexp_replace(F.regexp_replace(x, mark("^"), f"$1{DOT}"), _dots(), DOT))
    t = _if_any(t, [";", "\u037e", "|"], questions)
    return _if_any(t, [a for a, _ in QUOTES], _quotations)


def _quotations(t: Column) -> Column:
    """Quotes of quotations told apart, and terminators before the last letter of a quotation masked."""
    inner = lambda a, b: f"[^{a}{b}{GAP}{ITEM}]"
    one = lambda a, b: rf"{a}(?={inner(a, b)})({inner(a, b)}*[{WORD}])?([^{WORD}{a}{b}{GAP}{ITEM}]*+){b}"
    odd, even = (("".join(f"${2 * i + k}" for i in range(len(QUOTES)))) for k in (1, 2))
    t = F.regexp_replace(t, rf"(?=[\"«\u201c-\u300e])(?:{'|'.join(one(a, b) for a, b in QUOTES)})", f"{OPEN}{odd}{LAST}{even}{SHUT}")
    t = F.regexp_replace(t, rf"({OPEN}|\G(?!^))([^{TERMS}{OPEN}{LAST}{SHUT}]*+)[{TERMS}]", f"$1$2{INNER}")
    return F.replace(t, F.lit(LAST), F.lit(""))


def marked(t: Column) -> Column:
    """The masked text with a marker behind every sentence; blank lines and list items' breaks are markers too."""
    t = F.regexp_replace(t, _ends(), f"$0{CUT}")
    for c in (GAP, ITEM):
        t = F.replace(t, F.lit(c), F.lit(c + CUT))
    # Thai: a blank between two Thai letters, but for the sign of repetition.
    thai = lambda x: F.regexp_replace(x, f"[{THAI}][ \u00a0\n]++(?=[{THAI}])", f"$0{CUT}")
    holds = lambda x: F.contains(x.cast("binary"), F.lit(b"\xe0\xb8")) | F.contains(x.cast("binary"), F.lit(b"\xe0\xb9"))
    return let(t, lambda x: F.when(holds(x), thai(x)).otherwise(x))


def running_sums(numbers: Column) -> Column:
    """Sums up to and with each element, by doubling: as many passes as the length has binary digits."""
    step = lambda k: F.call_function("shiftleft", F.lit(1), k)
    add = lambda acc, k: F.transform(acc, lambda x, i: x + F.coalesce(F.get(acc, i - step(k)), F.lit(0)))
    rounds = F.sequence(F.lit(0), F.length(F.bin(F.size(numbers))))
    return F.aggregate(rounds, numbers, lambda acc, k: F.when(step(k) < F.size(acc), add(acc, k)).otherwise(acc))


def sentence_spans(text: Column) -> Column:
    """array<struct<sent_start,sent_end>> of a text; see the module."""

    def part(piece: Column) -> Column:
        n = F.length(piece)
        return F.struct(n.alias("n"), F.length(F.ltrim(piece, F.lit(EDGES))).alias("core"), F.length(F.rtrim(piece, F.lit(EDGES))).alias("right"))

    def spans(parts: Column) -> Column:
        ends = running_sums(F.transform(parts, lambda p: p["n"]))
        placed = F.zip_with(parts, ends, lambda p, e: F.struct((e - p["core"]).alias("sent_start"), (e - p["n"] + p["right"]).alias("sent_end")))
        return F.filter(placed, lambda s: s["sent_start"] < s["sent_end"])

    return let(F.transform(F.split(marked(masked(text)), CUT), part), spans)


def sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per sentence: key, sent_no, sent_start, sent_end and, if asked for, the sentence."""
    d = docs.select(F.col(key), F.col(text).alias("_text"))
    out = d.select(key, "_text", F.posexplode(sentence_spans(F.col("_text"))).alias("sent_no", "_s"))
    cols = [key, "sent_no", "_s.sent_start", "_s.sent_end"]
    if with_text:
        cols.append(F.expr("substring(_text, _s.sent_start + 1, _s.sent_end - _s.sent_start)").alias("sentence"))
    return out.select(*cols)
