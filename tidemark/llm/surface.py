"""Texts as a reader sees them, and the pieces of personal information their surface may show.

``readable`` undoes markup, quoting, entities, wide and look-alike characters and keeps for every
character left the offset it came from. ``candidates`` then lists what may be personal information:
spans with a shape or a pair of name parts, and the words around them. Nothing is decided here; the
scores of ``pii`` decide.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from itertools import accumulate

# Characters that look like a Latin letter.
LOOKALIKES = str.maketrans("аеорсухіјѕАВЕКМНОРСТУХΑΒΕΗΙΚΜΝΟΡΤΧο", "aeopcyxijsABEKMHOPCTYXABEHIKMNOPTXo")
_DASHES = "‐‑‒–—−－"
_HIDDEN = "\u00ad\u200b\u200c\u200d\u2060\ufeff\u200e\u200f\r"
#: Wide forms, dashes, quotes and look-alikes, each as the plain character.
_PLAIN = {**{c: c - 0xFEE0 for c in range(ord("！"), ord("～") + 1)}, **dict.fromkeys(map(ord, _DASHES), "-"), **dict.fromkeys(map(ord, "‘’"), "'"), **LOOKALIKES}
_ODD = re.compile("[" + "".join(map(re.escape, map(chr, _PLAIN))) + "]")
_BLANK = "\u00a0\u2000-\u200a\u3000"
_PIECE = re.compile(
    rf"(?=[&<\[\n\t\r{_HIDDEN}{_BLANK}\u0300-\u036f]| [ \t\r\n{_BLANK}])(?:"  # spares the rest at most places
    r"(?P<entity>&(?:#\d++|#[xX][0-9a-fA-F]++|[a-zA-Z]++);)"
    r"|(?P<inline></?(?:b|i|u|em|strong|span|font|tt|code|s)(?:\s[^<>]*+)?>|\[/?(?:b|i|u)\])"
    r"|(?P<block><br\s*/?>[ \t\r]*\n?[>| \t]*|</?(?:p|div|blockquote|li|ul|ol|td|tr|table|pre|h\d|hr)(?:\s[^<>]*+)?/?>)"
    r"|(?P<line>\n[>| \t\r]++|[ \t\r]++\n[>| \t\r]*)"
    rf"|(?P<blank>[ \t{_BLANK}]{{2,}}|[\t{_BLANK}])"
    rf"|(?P<hidden>[{_HIDDEN}]+)"
    r"|(?P<combined>[\u0300-\u036f]+))"
)


class Offsets:
    """Where each character of a readable text came from: runs of (place there, place here, whether they go on together)."""

    def __init__(self, runs: list[tuple[int, int, bool]]):
        self.starts = [r[0] for r in runs]
        self.runs = runs

    def __getitem__(self, i: int) -> int:
        there, here, together = self.runs[bisect_right(self.starts, i) - 1]
        return here + (i - there if together else 0)


def readable(text: str) -> tuple[str, Offsets]:
    """The text without markup, quote marks and disguised characters, and each character's offset in ``text``.

    A line break (with the quote marks of the next line) becomes one newline, blanks become one space.
    """
    out: list[str] = []
    runs: list[tuple[int, int, bool]] = []
    size = 0

    def put(s: str, where: int, together: bool) -> None:
        nonlocal size
        if s:
            out.append(s)
            runs.append((size, where, together))
            size += len(s)

    def plain(s: str, where: int) -> None:
        put(s.translate(_PLAIN) if not s.isascii() and _ODD.search(s) else s, where, True)

    end = 0
    for m in _PIECE.finditer(text):
        at = m.start()
        if at > end:
            plain(text[end:at], end)
        end = m.end()
        kind = m.lastgroup
        if kind == "line" or kind == "block":
            put("\n", at, False)
        elif kind == "blank":
            put(" ", at, False)
        elif kind == "entity":
            char = html.unescape(m.group())
            if char == m.group():
                plain(char, at)
            else:
                put(char if len(char) == 1 else " ", at, False)
        elif kind == "combined" and out:  # the mark belongs to the letter before it
            out[-1] = out[-1][:-1] + unicodedata.normalize("NFC", out[-1][-1] + m.group())[:1]
    if end < len(text):
        plain(text[end:], end)
    runs.append((size, len(text), False))
    return "".join(out), Offsets(runs)


_AT = r"(?:[ \n]?@[ \n]?|[ \n]?[\[({<][ \n]?(?:at|AT|At|arobase|arroba)[ \n]?[\])}>][ \n]?)"
_DOT = r"(?:\.|[ \n]?[\[({<][ \n]?(?:dot|DOT|Dot|punkt|point|punto)[ \n]?[\])}>][ \n]?|[ \n](?:dot|DOT)[ \n])"
_LOCAL = r"(?<![\w.+@-])[^\W_][\w.+'-]{0,63}"
_LOCAL_END = re.compile(rf"{_LOCAL}\Z")
_SIGN = re.compile(_AT)
EMAIL = re.compile(rf"{_LOCAL}{_AT}[^\W_][\w-]{{0,62}}(?:{_DOT}[^\W_][\w-]{{0,62}}){{0,5}}{_DOT}[^\W\d_]{{2,24}}(?![\w-])")
SPELT_EMAIL = re.compile(rf"{_LOCAL}[ \n](?:at|AT)[ \n][^\W_][\w-]{{0,62}}(?:[ \n](?:dot|DOT)[ \n][^\W_][\w-]{{0,62}}){{1,6}}(?![\w-])")
_FILE_NAMES = re.compile(r"(?i)\.(?:png|jpe?g|gif|svg|webp|bmp|ico|pdf|txt|zip|gz|tar|exe|html?|css|js|py|log|bak|conf)$")

_S = r"[ \n]"
_SEP = r"(?:[ \n]?[-./][ \n]?|[ \n])"
#: Shapes that are what they are wherever they stand.
PHONE_SHAPES = [
    rf"\+[ \n]?\d(?:[ \n./()-]{{0,3}}\d){{7,14}}",
    rf"00(?:[ \n./()-]{{0,2}}[1-9])(?:[ \n./()-]{{0,3}}\d){{8,13}}",
    rf"(?:1{_SEP})?\(\d{{3}}\){_S}?\d{{3}}{_S}?[-. ]?{_S}?\d{{4}}",
    rf"(?:1{_SEP})?\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{4}}",
    rf"\(0\d{{1,5}}\)[ \n/-]?\d(?:[ \n-]?\d){{4,9}}",
    rf"0\d{{1,4}}{_SEP}\d(?:[ \n-]?\d){{4,9}}",
    rf"0\d(?:{_SEP}\d\d){{4}}",
    rf"\d{{3}}{_SEP}\d{{3}}{_SEP}\d{{3}}",
    rf"\d(?:[ \n]\d){{8,13}}",
]
ID_SHAPES = [
    rf"\d{{3}}[ \n]?[- ][ \n]?\d\d[ \n]?[- ][ \n]?\d{{4}}",
    rf"[A-Za-z]{{2}}[ \n-]?\d\d[ \n-]?\d\d[ \n-]?\d\d[ \n-]?[A-Da-d]",
    rf"\d{{8}}[ \n]?[- ]?[ \n]?[A-HJ-NP-TV-Z]",
    rf"\d{{8}}[ \n]?[- ]?[A-Za-z]",
    rf"[XYZxyz][ \n-]?\d{{7}}[ \n-]?[A-Za-z]",
    rf"\d{_S}\d\d{_S}\d\d{_S}\d\d{_S}\d{{3}}{_S}\d{{3}}(?:{_S}\d\d)?",
    rf"\d\d{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{3}}",
    r"[A-Za-z]\d{3}[A-Za-z]\d{4}",
]
#: Shapes that only their surroundings explain.
# Digits as words.
DIGIT_WORDS = "zero|oh|one|two|three|four|five|six|seven|eight|nine|null|eins|zwei|zwo|drei|vier|fünf|sechs|sieben|acht|neun|zéro|un|deux|trois|quatre|cinq|sept|huit|neuf|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve"
SPELT_NUMBER = re.compile(rf"(?<![\w@#$.,/:=+-])(?i:(?:plus[ \n])?(?:(?:double|triple)[ \n])?(?:{DIGIT_WORDS})(?:[ \n,-]{{1,2}}(?:(?:double|triple)[ \n])?(?:{DIGIT_WORDS})){{6,15}})(?![\w@%]|[.,:/-]\d|-[A-Za-z])")
OPEN_SHAPES = [r"\d{8,15}", r"[A-Za-z]{1,2}\d{6,9}[A-Za-z]?", r"[A-Z]\d{2}[A-Z0-9]{5,7}", r"\d{2,6}(?:[ \n./-]\d{2,6}){1,4}"]
_BEFORE = r"(?<![\w@#$.,/:=+-])"
_AFTER = r"(?![\w@%]|[.,:/-]\d|-[A-Za-z])"
#: Tried where a run of digits begins and up to ``_LEAD`` characters before it, which every shape has at its start.
_LEAD = 3
_DIGITS = re.compile(r"(?<!\d)\d")
_SPELT = set(DIGIT_WORDS.split("|"))
NUMBER = re.compile(
    "|".join(
        f"{_BEFORE}(?P<{k}>{'|'.join(shapes)}){_AFTER}"
        for k, shapes in (("id", ID_SHAPES), ("phone", PHONE_SHAPES), ("open", OPEN_SHAPES))
    )
)
_NOT_NUMBERS = re.compile(r"^(?:(?:19|20)\d\d[-./](?:0\d|1[0-2])[-./]\d\d(?:[ \n].*)?|\d{1,3}(?:\.\d{1,3}){3}|\d+\.\d+(?:\.\d+)?)$", re.S)

# Words that name a kind of street.
STREET_EN = "street|st|road|rd|lane|ln|drive|dr|avenue|ave|boulevard|blvd|court|ct|way|terrace|ter|place|pl|close|crescent|square|sq|parkway|pkwy|circle|cir|alley|row|walk|mews|hill|rise|highway|hwy|trail|trl|loop"
STREET_FR = "rue|avenue|av|impasse|chemin|place|boulevard|bd|quai|allée|allee|cours|passage|route|ruelle|sentier|square|villa|montée"
STREET_ES = "calle|plaza|paseo|avda|avenida|camino|ronda|travesía|travesia|carretera|callejón|glorieta|cuesta|rambla"
STREET_DE = "straße|strasse|str|weg|gasse|allee|steig|platz|ufer|damm|ring|pfad|stieg|graben|markt|chaussee|zeile"
STREET_KINDS = set(STREET_EN.split("|"))
_CAP = r"[A-ZÀ-ÖØ-Þ][\wÀ-ÿ'-]*"
_NUM = r"\d{1,5}(?:[ ]?-?[A-Za-z](?![A-Za-z]))?"
ADDRESS_EN = re.compile(
    rf"(?<![\w.,#-])\d{{1,5}}(?:-?[A-Za-z])?[ \n](?:(?:N|S|E|W|NE|NW|SE|SW|North|South|East|West)\.?[ \n])?(?:{_CAP}\.?[ \n]){{1,3}}(?i:{STREET_EN})\b\.?"
    rf"|(?<![\w.,#-])\d{{1,5}}(?:-?[A-Za-z])?[ \n](?i:(?:(?:n|s|e|w|ne|nw|se|sw|north|south|east|west)\.?[ \n])?(?:[a-z'-]+\.?[ \n]){{1,3}}(?:{STREET_EN})\b\.?)"
)
ADDRESS_FR = re.compile(
    rf"(?<![\w.,#-])\d{{1,4}}(?:[ \n]?(?i:bis|ter|quater|[a-d])\b)?[ \n]?,?[ \n]?(?i:{STREET_FR})\.?[ \n](?:(?i:de la|de l'|du|des|de|d'|la|le|les|l')[ \n]?){{0,2}}[^\W\d_][\w'-]*(?:(?:[ \n][A-ZÀ-ÖØ-Þ][\w'-]*){{1,3}}|(?:[ \n][a-zà-öø-þ][\w'-]*){{0,2}})"
)
ADDRESS_ES = re.compile(
    rf"(?<![\w])(?i:(?:{STREET_ES})\b\.?|c/)[ \n]?(?:(?i:de la|de los|de las|del|de|la|el|los|las)[ \n])?(?:[^\W\d_][\w'-]*[ \n]){{0,3}}[^\W\d_][\w'-]*,?[ \n](?:(?i:n[º°o]\.?|núm\.?|num\.?)[ \n]?)?\d{{1,4}}(?![\w-]*\d)"
)
ADDRESS_DE = re.compile(
    rf"(?<![\w-])(?:(?:(?:{_CAP}[ \n-]){{0,2}}[A-ZÄÖÜ][\wäöüß-]*|(?:{_CAP}[ \n-]){{1,2}})(?i:{STREET_DE})\.?|(?:Am|An der|An den|Auf der|Auf dem|Im|In der|In den|Zum|Zur|Hinter der|Unter den|Bei der)[ \n](?:{_CAP}[ \n]){{0,2}}{_CAP})[ \n][1-9]\d{{0,3}}(?:[ ]?[a-h](?![\w]))?(?![\w.]*\d|[.,]\d)"
)
ADDRESS_DE_FREE = re.compile(rf"(?<![\w-])(?:(?i:am|an der|auf der|im|in der|zum|zur|hinter der|unter den)[ \n](?i:(?:[a-zäöüß]{{2,}}[ \n]){{0,2}}[a-zäöüß]{{2,}})|(?:[a-zäöüß]{{3,}}[ \n])?[a-zäöüßA-ZÄÖÜ]*(?i:straße|strasse|str|weg|gasse|allee|steig|platz|ufer|damm|pfad)\.?)[ \n][1-9]\d{{0,3}}(?:[ ]?[a-hA-H](?![\w]))?(?![\w.]*\d|[.,]\d)")
#: An email has one of these, or words for them and for the dot.
_EMAIL_SIGNS = ["@", "at)", "at]", "at}", "at>", "arobase", "arroba"]
#: A house number.
_HOUSE = re.compile(r"(?<![\w.,#-])\d{1,5}(?!\d)")
#: Tokens of a German address before its number, and of those of a street's name with its kind.
_DE_TOKENS, _DE_NAME = 6, 3
_ES_FIRST, _DE_PLACE, _DE_ARTICLE, _DE_KIND = 1, 2, 4, 8


class _Streets(dict):
    """Bits of a word: begins a Spanish street; begins the place of a German one, alone or before an article; ends in a German kind of street."""

    def __missing__(self, w: str) -> int:
        x = w.rstrip(".").lower()
        bits = _ES_FIRST * (x in _ES_KINDS) | _DE_PLACE * (x in {"am", "im", "zum", "zur"}) | _DE_ARTICLE * (x in {"an", "auf", "in", "hinter", "unter", "bei"}) | _DE_KIND * x.endswith(_DE_KINDS)
        if len(self) > 200_000:
            self.clear()
        self[w] = bits
        return bits


_STREETS = _Streets()
_ES_KINDS = {*STREET_ES.split("|"), "c"}
_DE_KINDS = tuple(STREET_DE.split("|"))
#: Words within a street's name that are written small where the others have capitals.
_SMALL_IN_STREETS = {"de", "du", "des", "la", "le", "les", "los", "las", "el", "del", "der", "den", "dem", "of", "the", "am", "an", "auf", "im", "in", "zum", "zur", "bei", "hinter", "unter", "y", "et"}

_WORD = re.compile(r"([^\W\d_]++(?:['-][^\W\d_]++)*+\.?|\n+|[^\s\w]|[\w]+)")
_LETTER_WORD = re.compile(r"[^\W\d_]+(?:['-][^\W\d_]+)*\.?$")
PREFIXES = {"van", "von", "de", "del", "della", "di", "da", "du"}
INNER_PREFIXES = {"der", "den", "la", "los", "las", "het", "dem"}
DETERMINERS = {"the", "a", "an", "this", "that", "der", "die", "das", "ein", "eine", "einen", "einem", "le", "la", "les", "un", "une", "el", "los", "las", "una", "our", "my", "your", "their", "mein", "meine", "meinen", "meinem", "meiner", "unser", "unsere", "notre", "mon", "ma", "mi"}
_TITLES = {"dr", "mr", "mrs", "ms", "miss", "prof", "herr", "frau", "hr", "fr", "m", "mme", "mlle", "sr", "sra", "srta", "don", "doña", "sir", "madam", "monsieur", "madame", "señor", "señora", "dres"}


def _shape(s: str) -> str:
    return re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", s.replace("\n", " ")))


def _context(words: list[str]) -> str:
    return " ".join("#" if w[:1].isdigit() else "^" if w[:1] == "\n" else w.lower().rstrip(".") or "." for w in words)


class _Kinds(dict):
    """Kind of a word: C capital first, U all capitals, I initial, i small initial, p prefix, l small, . ends in a stop, '' no word."""

    def __missing__(self, w: str) -> str:
        if w[:1] == "\n" or not _LETTER_WORD.match(w):
            k = ""
        else:
            bare = w.rstrip(".")
            if len(bare) == 1:
                k = "I" if bare.isupper() else "i" if w.endswith(".") else ""
            elif w.endswith("."):
                k = "."  # an abbreviation or the end of a sentence
            elif bare.isupper():
                k = "U"
            elif bare[0].isupper():
                k = "C"
            else:
                k = "p" if bare in PREFIXES else "l"
        if len(self) > 200_000:  # a memory of words only; what is forgotten is found out again
            self.clear()
        self[w] = k
        return k


_KINDS = _Kinds()


class Tokens:
    """The words, signs and line breaks of a text with their places; ``gaps[i]`` is what stands before token i."""

    def __init__(self, norm: str):
        parts = _WORD.split(norm)
        ends = list(accumulate(map(len, parts)))
        self.words, self.gaps = parts[1::2], parts[0::2]
        self.starts, self.ends = ends[0:-1:2], ends[1::2]
        self.kinds = [_KINDS[w] for w in self.words]
        self._letters: list[int] | None = None

    def before(self, at: int, n: int) -> list[str]:
        """The last ``n`` tokens that begin before the place."""
        i = bisect_left(self.starts, at)
        return self.words[max(0, i - n) : i]

    def letters_before(self, at: int, n: int) -> list[str]:
        """The last ``n`` tokens with a letter first that begin before the place."""
        if self._letters is None:
            self._letters = [i for i, w in enumerate(self.words) if w[0].isalpha()]
        i = bisect_left(self._letters, bisect_left(self.starts, at))
        return [self.words[j] for j in self._letters[max(0, i - n) : i]]


def name_candidates(tokens: Tokens, ordinary: set[str]) -> Iterator[tuple]:
    """(start, end, form, given, family, left, right, after determiner) for every pair of words that has the form of a name.

    Forms: ``full`` Given [initials] Family; ``turned`` Family, Given; ``initials`` X. [Y.] Family or
    ``turned`` without given name Family, X.; ``parted`` turned on two lines; ``small`` both in lower case, ``large`` both in capitals. A given name is null for initials.
    """
    toks, starts, ends, kinds, gaps = tokens.words, tokens.starts, tokens.ends, tokens.kinds, tokens.gaps
    n = len(toks)

    def gap(i: int) -> str:
        """What separates token i from the next."""
        return gaps[i + 1]

    def end_word(i: int) -> tuple[str, int] | None:
        """Word and end of token i without a full stop, for the last part of a name."""
        if kinds[i] in ("", "I", "i"):
            return None
        w = toks[i].rstrip(".")
        return w, starts[i] + len(w)

    def case(w: str) -> str:
        return "U" if w.isupper() else "C" if w[0].isupper() else "l"

    def skip_line(i: int) -> int | None:
        """Index of the word after token i across a blank or a line break, else None."""
        if i + 1 < n and kinds[i + 1] == "" and toks[i + 1] == "\n" and i + 2 < n:
            return i + 2
        if i + 1 < n and gap(i) == " ":
            return i + 1
        if i + 1 < n and gap(i) == "" and kinds[i] in ("I", "i") and toks[i].endswith("."):
            return i + 1
        return None

    def family(i: int | None) -> tuple[str, int, str, int] | None:
        """(family, end, case, index) that begins at token i, with its prefixes."""
        parts, j = [], i
        while j is not None and j < n and len(parts) < 3 and (toks[j].lower() in PREFIXES or parts and toks[j].lower() in INNER_PREFIXES):
            parts.append(toks[j].lower())
            j = skip_line(j)
        if j is None or j >= n:
            return None
        e = end_word(j)
        if e is None:
            return None
        return " ".join([*parts, e[0].lower()]), e[1], case(e[0]), j

    def around(i: int, j: int) -> tuple[str, str, bool]:
        title = toks[i - 1].rstrip(".").lower() if i else ""
        left = toks[max(0, i - 2) : i]
        if title in _TITLES:
            left = ["title", title]
        right = toks[j + 1 : j + 3]
        before = toks[i - 1].lower() if i else ""
        return _context(["\n"] * (2 - len(left)) + left), _context(right + ["\n"] * (2 - len(right))), before in DETERMINERS and ends[i - 1] + 1 == starts[i]

    for i, k in enumerate(kinds):
        if not k or k == "." or k == "l" and toks[i] in ordinary:
            continue
        # most words with a capital are followed by a small one that is no part of a name
        if k in "CU" and i + 1 < n and kinds[i + 1] == "l" and toks[i + 1] not in INNER_PREFIXES:
            continue
        if k in ("C", "U", "l") and toks[i].lower() not in _TITLES | DETERMINERS:
            given = toks[i]
            j, m = i, skip_line(i)
            middle = 0
            while m is not None and m < n and kinds[m] in ("I", "i") and middle < 3:
                j, m, middle = m, skip_line(m), middle + 1
            f = family(m)
            if f and m is not None:
                fam, end, c, last = f
                form = "full" if k == "C" and c == "C" else "large" if k == "U" and c == "U" else "small" if k == "l" and c == "l" else None
                if form == "small" and (given in ordinary or fam.rpartition(" ")[2] in ordinary or len(given) < 3 or len(fam) < 4):
                    form = None
                if form:
                    yield (starts[i], end, form, given.lower(), fam, *around(i, last))
        # Family, Given   or   Family, X.
        if (k in ("C", "U", "l") or k == "p") and not (i and (kinds[i - 1] == "p" or i > 1 and kinds[i - 2] == "p" and toks[i - 1].lower() in INNER_PREFIXES)):
            f = family(i)
            if f and f[3] + 2 < n and toks[f[3] + 1][0] == "," and gap(f[3]) == "":
                fam, _, c, last = f
                g = skip_line(last + 1)
                if g is not None and kinds[g] in ("I", "i") and (c != "l"):
                    h = g
                    while h + 1 < n and kinds[h + 1] in ("I", "i") and gap(h) in ("", " "):
                        h += 1
                    yield (starts[i], ends[h], "turned", None, fam, *around(i, h))
                elif g is not None:
                    e = end_word(g)
                    if e and toks[g].lower() not in PREFIXES and case(e[0]) == c and (c != "l" or not (e[0] in ordinary or fam.rpartition(" ")[2] in ordinary)):
                        form = "turned" if g == last + 2 else "parted"  # parted: on two lines
                        yield (starts[i], e[1], form, e[0].lower(), fam, *around(i, g))
        if k in ("I", "i") and toks[i].endswith(".") and not (i and kinds[i - 1] in ("I", "i", "C", "U") and toks[i - 1].rstrip(".").lower() not in _TITLES and gap(i - 1) in ("", " ")):
            m = skip_line(i)
            while m is not None and m < n and kinds[m] in ("I", "i"):
                m = skip_line(m)
            f = family(m)
            if f and (f[2] != "l" or k == "i"):
                yield (starts[i], f[1], "initials", None, f[0], *around(i, f[3]))


#: What may stand between an address and the town that follows it.
_TOWN = re.compile(r"\.?(?:[ ,\n]*(?:#[ ]?\d+|[Aa]pt\.?[ ]\d+|\d{4,5}|\d+[ºª°][ ]?\w?))?[ ,]*\n?[ ,]*$")


def _street_capitals(address: str) -> bool:
    """Whether all words of an English address but small ones, its kind of street and the letter of its number have capitals."""
    words = re.findall(r"(?<![\w-])[^\W\d_][\w'-]*", address)
    return bool(words) and all(not w[0].islower() or w in _SMALL_IN_STREETS or w in STREET_KINDS or len(w) == 1 for w in words) and any(w[0].isupper() for w in words)


def street_core(address: str) -> str:
    """The words of an address that name its street, without number, direction and kind of street."""
    words = re.findall(r"[^\W\d_][\w']*", address.lower().replace("\n", " "))
    kept = [w for w in words if not re.fullmatch(rf"(?:n|s|e|w|ne|nw|se|sw|north|south|east|west|bis|ter|{STREET_EN}|{STREET_FR}|{STREET_ES})", w) and len(w) > 1]
    return " ".join(kept or words)


# Bits of a name candidate's flag.
AFTER_DETERMINER, ORDINARY_GIVEN, ORDINARY_FAMILY, SEED_GIVEN, SEED_FAMILY, BEFORE_GIVEN = 1, 2, 4, 8, 16, 32
_NEXT_LINE = re.compile(r"[ ,]?\n+([^\W\d_]+(?:-[^\W\d_]+)*)(?=[ \n][^\W\d_])")


def _emails(norm: str) -> Iterator[re.Match]:
    low = norm.lower()
    if any(x in low for x in _EMAIL_SIGNS):
        end = 0
        for sign in _SIGN.finditer(norm):
            local = _LOCAL_END.search(norm, max(end, sign.start() - 64), sign.start())
            if local and (m := EMAIL.match(norm, local.start())):
                yield m
                end = m.end()
    if "dot" in low and ("at " in low or "at\n" in low):
        yield from SPELT_EMAIL.finditer(norm)


def _addresses(norm: str, tokens: Tokens) -> Iterator[tuple[re.Match, str]]:
    """Spans with the form of an address, language by language, without overlap within a language.

    The patterns are tried only where one can begin: French and English addresses with their number, Spanish
    and German ones at certain words, or some words before a kind of street that a number follows.
    """
    houses = [m.start() for m in _HOUSE.finditer(norm)]
    words, starts = tokens.words, tokens.starts

    def tried(pattern: re.Pattern, places: Iterable[int]) -> Iterator[re.Match]:
        end = 0
        for p in places:
            if p >= end and (m := pattern.match(norm, p)):
                yield m
                end = m.end()

    for m in tried(ADDRESS_FR, houses):
        yield m, "fr"
    marked = [(j, bits) for j, w in enumerate(words) if (bits := _STREETS[w])]
    for m in tried(ADDRESS_ES, [starts[j] for j, bits in marked if bits & _ES_FIRST]):
        yield m, "es"
    german: set[int] = set()
    n = len(words)
    for j, bits in marked:
        if bits & _DE_PLACE or bits & _DE_ARTICLE and j + 1 < n and words[j + 1].lower() in ("der", "den", "dem"):
            if any(w[0].isdigit() for w in words[j + 1 : j + _DE_TOKENS + 1]):
                german.add(j)
        if bits & _DE_KIND and j + 1 < n and words[j + 1][0].isdigit():
            german.update(range(max(0, j - _DE_NAME + 1), j + 1))
    places = [starts[j] for j in sorted(german)]
    for m in tried(ADDRESS_DE, places):
        yield m, "de"
    for m in tried(ADDRESS_DE_FREE, places):
        yield m, "de free"
    for m in tried(ADDRESS_EN, houses):
        yield m, "en"


def _numbers(norm: str, tokens: Tokens, digits: list[int]) -> Iterator[re.Match]:
    """Spans with the shape of a number, first those in digits, then those in words."""
    end = 0
    for p in digits:
        c = norm[p - 1] if p else " "
        if c in "@#$.,/:=_":
            continue  # nothing begins before the digits, nor with them
        lead = 1 if c in "+(" else _LEAD if c in " \n-" and p > 1 and (norm[p - 2].isalpha() or norm[p - 2] == "+") else 2 if c.isalpha() else 0
        for a in range(max(end, p - lead), p + 1):
            if m := NUMBER.match(norm, a):
                yield m
                end = m.end()
                break
    # seven words of digits at least
    if sum(map(_SPELT.__contains__, map(str.lower, tokens.words))) >= 7:
        yield from SPELT_NUMBER.finditer(norm)


def candidates(text: str, ordinary: set[str], seeds: set[str] = frozenset()) -> Iterator[tuple]:
    """(kind, start, end, form, first, second, left, right, flag): spans in ``text`` that may be personal information.

    kind email: certain. kind number: form is id, phone or open, first the shape. kind address: form is the
    language, first the words that name the street. kind name: as ``name_candidates``.
    """
    norm, at = readable(text)
    tokens = Tokens(norm)

    def span(a: int, b: int) -> tuple[int, int]:
        return at[a], at[b - 1] + 1

    marked = bytearray(len(norm))  # what an earlier candidate covers
    address_ends: list[int] = []
    number_starts: set[int] = set()

    def free(a: int, b: int) -> bool:
        return marked.find(1, a, b) < 0

    def take(a: int, b: int) -> None:
        marked[a:b] = b"\1" * (b - a)

    def town(a: int) -> bool:
        """Whether only the rest of an address lies before ``a``: a town, no name."""
        i = bisect_right(address_ends, a)
        return i > 0 and a - address_ends[i - 1] <= 24 and bool(_TOWN.match(norm[address_ends[i - 1] : a]))

    def label(b: int) -> bool:
        """Whether a number follows the colon or stop at ``b``: the word before it names the number."""
        return bool(re.match(r"[.:]{1,2}[ \n]", norm[b : b + 3])) and any(b + i in number_starts for i in (1, 2, 3, 4))

    for m in _emails(norm):
        if free(*m.span()) and not _FILE_NAMES.search(m.group()):
            take(*m.span())
            yield ("email", *span(*m.span()), "email", None, None, "", "", 0)
    digits = [m.start() for m in _DIGITS.finditer(norm)]
    for m, language in _addresses(norm, tokens) if digits else ():
        s = m.group()
        if not free(*m.span()):
            continue
        take(*m.span())
        insort(address_ends, m.end())
        left = _context(tokens.before(m.start(), 2))
        if language == "fr":  # how many of the words after the kind of street belong to it, the core decides
            a, b = m.span()
            while True:
                part = norm[a:b]
                yield ("address", *span(a, b), language, street_core(part), None, left, "", int(part != part.lower()))
                shorter = re.search(r"[ \n][\w'-]+$", part)
                if not shorter or len(part[: shorter.start()].split()) < 3:
                    break
                b = a + shorter.start()
            continue
        clear = _street_capitals(s) if language == "en" else s != s.lower() and (language != "de free" or not s.isupper())
        yield ("address", *span(*m.span()), language[:2], street_core(s), None, left, "", int(clear))
    for m in _numbers(norm, tokens, digits):
        s = m.group()
        form = m.lastgroup or "phone"
        if not free(*m.span()) or form == "open" and _NOT_NUMBERS.match(s):
            continue
        take(*m.span())
        number_starts.add(m.start())
        left = tokens.letters_before(m.start(), 3)
        a, b = m.span()
        if s.startswith("(") and ")" not in s:
            a += 1
        yield ("number", *span(a, b), form, _shape(norm[a:b]), None, _context(left), "", 0)
    for a, b, form, given, fam, left, right, det in name_candidates(tokens, ordinary):
        if fam in _TITLES or given in _TITLES:
            continue
        if free(a, b) and not town(a) and not label(b):
            last = fam.rpartition(" ")[2]
            below = _NEXT_LINE.match(norm, b)  # a greeting stands above a name, a name does not
            flag = BEFORE_GIVEN * bool(below and below[1].lower() in seeds) | AFTER_DETERMINER * det | ORDINARY_GIVEN * (given in ordinary) | ORDINARY_FAMILY * (last in ordinary or last in STREET_KINDS) | SEED_GIVEN * (given in seeds) | SEED_FAMILY * (fam in seeds)
            yield ("name", *span(a, b), form, given, fam, left, right, flag)
