"""Problem 6, the plain-Python part: finding personal information and making surrogates.

Patterns find e-mail addresses, phone numbers, identity numbers and street
addresses; names of persons are found by given names, titles and initials next
to a word that a small model holds for a family name. Everything is found in
the one form of the text (problem 1) and placed in the text as it stands.
"""

from __future__ import annotations

import hashlib
import hmac
import math
import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache
from operator import itemgetter
from typing import NamedTuple

import numpy as np

from . import forms, names

KINDS = ("email", "id_number", "phone", "address", "name")


class Found(NamedTuple):
    kind: str
    start: int
    end: int
    value: str  # in its one form


# --- Fixed values: words that announce an identity number. ---
_ID_CUE = (
    r"(?:passport|pasaporte|passeport|passaporto|reisepass|personalausweis|ausweis(?:nummer|nr\.?)?|identity card|identity number|id card|id number|id[- ]no\.?|national id|driving licen[cs]e|driver'?s? licen[cs]e|f[üu]hrerschein|"
    r"permis de conduire|permiso de conducir|carte d'identit[ée]|carta d'identit[àa]|documento de identidad|c[ée]dula|dni|nie|nif|ssn|social security|social insurance|national insurance|insurance number|ni number|"
    r"sozialversicherung(?:snummer)?|versicherungsnummer|sv-nummer|rentenversicherungsnummer|num[ée]ro de s[ée]curit[ée] sociale|s[ée]curit[ée] sociale|seguridad social|tax (?:no\.?|id|number|identification)|steuer-?id|steueridentifikationsnummer|"
    r"steuernummer|steuer-?nr\.?|num[ée]ro fiscal|codice fiscale|pan|aadhaar|tin|pesel|bsn|curp|cpf|personnummer|residence permit|aufenthaltstitel)"
)
_ID_FILL = r"(?:\s*(?:no|nr|num|number|nummer|n°|nº|id|#|card)\b\.?)*\s*[:#\-–]?\s*"
_ID_VALUE = r"(?:[A-Za-z]{1,5}[ -]?)?\d[\dA-Za-z]*(?:[ -]\d[\dA-Za-z]*)*(?:[ -](?-i:[A-Z]{1,2})\b(?:[ -]?\d+)?)?"
_EMAIL = re.compile(r"[\w.+-]+(?:\s?[(\[{]\s?at\s?[)\]}]\s?|\s?@\s?)[\w-]+(?:(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?)[\w-]+)*(?:\.|\s?[(\[{]\s?dot\s?[)\]}]\s?)[A-Za-z]{2,}\b", re.I)
_ID_AFTER = re.compile(rf"\b{_ID_CUE}{_ID_FILL}({_ID_VALUE})", re.I)
_ID_BEFORE = re.compile(rf"(?<![\w-])({_ID_VALUE})\s*(?:\(\s*|as (?:an? |my )?|is (?:my|the) |, )(?:no\.? )?{_ID_CUE}\b", re.I)
_ID_PLAIN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
_PHONES = [
    re.compile(r"(?<![\w.+])\+\s?\d[\d ().\-/]{6,20}\d(?!\w)"),
    re.compile(r"(?<![\w.\-/])00\s?\d{2}[ \-/.(][\d ()\-/.]{6,16}\d(?!\w)"),
    re.compile(r"(?<![\w.\-/])\(0?\d{2,4}\)\s?\d{3,4}[ .\-]?\d{3,4}(?![\w-])"),
    re.compile(r"(?<![\w.\-/])\d{3}([.\-])\d{3,4}\1\d{4}(?![\w-])"),
    re.compile(r"(?<![\w.\-/])0\d{2,4}[/ ]\d{5,8}(?!\w)"),
]
_PHONE_CUE = re.compile(r"(?:\b(?:tel|telephone|telefon|teléfono|téléphone|phone|mobile|móvil|movil|mobil|handy|cell|fax|telefax|whatsapp|signal|call me (?:on|at)|reach(?:able|ed)? (?:under|at|on))\b\.?|☎️?|📞|📱)(?:\s*\([^)\d]*\))?\s*[:.]?\s*([+(]?\d[\d ().\-/]{5,20}\d)(?!\w)", re.I)
_STREET = r"(?:Street|St|Road|Rd|Avenue|Ave|Av|Lane|Ln|Court|Ct|Drive|Dr|Boulevard|Blvd|Close|Way|Place|Pl|Square|Sq|Terrace|Ter|Crescent|Cres|Gardens|Gdns|Row|Mews|Walk|Parade|Alley|Quay)"
_FLAT = r"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite)\s+\w{1,5},?\s+)?"
_ADDRESSES = [  # two English, a French, three German, one German with a preposition, a Spanish and Italian
    re.compile(rf"{_FLAT}(?<![\w/.-])\d{{1,4}}[A-Za-z]?,?\s+(?:[A-ZÀ-Þ][\w'’-]*\s+){{1,3}}{_STREET}\b\.?(?:,?\s+Apt\.?\s+\w{{1,5}})?"),
    re.compile(rf"{_FLAT.upper()}(?<![\w/.-])\d{{1,4}}[A-Z]?,?\s+(?:[A-ZÀ-Þ][A-ZÀ-Þ'’-]*\s+){{1,3}}{_STREET.upper()}\b\.?"),
    re.compile(r"(?<![\w/.-])\d{1,4}(?:\s?(?:bis|ter|[a-z]))?,?\s+(?:rue|boulevard|bd|avenue|av\.|chemin|allée|allee|place|impasse|quai|route|cours|passage|square)\s+(?:des?\s+(?:la\s+|l['’])?|du\s+|d['’])?[A-ZÀ-Þ][\w'’-]+(?:\s+[A-ZÀ-Þ][\w'’-]+)*", re.I),
    re.compile(r"\b[A-ZÄÖÜ][a-zäöüß-]*(?:straße|strasse|str\.|weg|allee|platz|gasse|ring|damm|ufer|chaussee|stieg|pfad)\s+\d{1,4}\s?[a-z]?\b"),
    re.compile(r"\b[A-ZÄÖÜ-]+(?:STRASSE|STRAßE|STR\.|WEG|ALLEE|PLATZ|GASSE|DAMM|UFER|CHAUSSEE)\s+\d{1,4}\s?[A-Z]?\b"),
    re.compile(r"\b(?:[A-ZÄÖÜ][a-zäöüß]+(?:er|-)\s?)(?:Straße|Strasse|Str\.|Weg|Allee|Platz|Gasse|Ring|Damm|Ufer)\s+\d{1,4}\s?[a-z]?\b"),
    re.compile(r"\b(?:Am|An der|An den|Im|In der|In den|Auf der|Auf dem|Zum|Zur|Hinter der|Hinter dem|Unter den|AM|IM|ZUM|ZUR|AN DER|AUF DER)\s+[A-ZÄÖÜ][\wäöüß-]+\s+\d{1,3}\s?[a-zA-Z]?\b(?![.\d])"),
    re.compile(r"\b(?:calle|c/|avenida|avda\.?|plaza|paseo|camino|carrera|ronda|via|viale|corso|piazza)\s+(?:de\s+(?:la\s+|los\s+|las\s+)?|del\s+)?[A-ZÀ-Þ][\w'’-]+(?:\s+[A-ZÀ-Þ][\w'’-]+){0,3},?\s+\d{1,4}\b(?:,\s*\d+[ºªo°]?\s*(?:izq|dcha|der|[A-Z])\b\.?)?", re.I),
]
_TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "professor", "frau", "herr", "mme", "mlle", "monsieur", "madame", "señor", "señora", "señorita", "sra", "don", "doña", "signor", "signora"}
_TOKEN = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_CAPITAL = re.compile(r"[A-ZÀ-ÞŁŠŽ]")
_GAP = re.compile(r"[ \t]*")
_DIGITS = re.compile(r"\d")
# Quick tests before the full patterns; each is implied by what it stands before.
_LINE_END = re.compile(r"[\n\r\f]")
_AT = re.compile(r"[(\[{]\s?at\s?[)\]}]", re.I)
# --- Fixed values: how the first words of the cues of identity numbers begin, and the words and ends of words of addresses. ---
_ID_STARTS = set("pas rei per aus ide nat dri füh fuh car doc céd ced dni nie nif ssn soc ins soz ver sv rent ren sv- núm num sec séc seg tax ste cod pan aad tin pes bsn cur cpf res auf id ni sv".split())
_ENGLISH_STREETS = set("street st road rd avenue ave av lane ln court ct drive dr boulevard blvd close way place pl square sq terrace ter crescent cres gardens gdns row mews walk parade alley quay".split())
_FRENCH_STREETS = set("rue boulevard bd avenue av chemin allée allee place impasse quai route cours passage square".split())
_SPANISH_STREETS = set("c calle avenida avda plaza paseo camino carrera ronda via viale corso piazza".split())
_GERMAN_PLACES = set("am an im in auf zum zur hinter unter".split())
_GERMAN_STREETS = ("straße", "strasse", "str", "weg", "allee", "platz", "gasse", "ring", "damm", "ufer", "chaussee", "stieg", "pfad")
_LETTERS = re.compile(r"[^\W\d_]+")


class _Hint:
    """A quick test of a line by its words in small letters; true for every line that the patterns behind it match."""

    def __init__(self, starts: set[str] = frozenset(), words: set[str] = frozenset(), ends: tuple[str, ...] = ()):
        self.starts, self.words, self.ends = starts, words, ends

    def __call__(self, words: list[str]) -> bool:
        if self.words:
            return not self.words.isdisjoint(words)
        return any(w.endswith(self.ends) for w in words) if self.ends else any(w[:3] in self.starts or w[:2] in self.starts for w in words)

    def search(self, line: str) -> bool:
        return self(_LETTERS.findall(line.lower()))


_ID_HINT = _Hint(starts=_ID_STARTS)
#: Patterns of addresses behind the quick test of their language.
_HINTED_ADDRESSES = [
    (_Hint(words=_ENGLISH_STREETS), _ADDRESSES[:2]), (_Hint(words=_FRENCH_STREETS), _ADDRESSES[2:3]), (_Hint(ends=_GERMAN_STREETS), _ADDRESSES[3:6]), (_Hint(words=_GERMAN_PLACES), _ADDRESSES[6:7]), (_Hint(words=_SPANISH_STREETS), _ADDRESSES[7:]),
]


#: Score of a word that is known as a family name; the opposite for a word known as another.
KNOWN = 9.0


def bare(word: str) -> str:
    return word.lower().replace("ß", "ss").replace("’", "'").translate(names._ACCENTS)


def word_hash(word: str) -> int:
    """64 bits of hash of a word, signed."""
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little", signed=True)


class Words:
    """A set of words by their sorted hashes: 8 bytes a word, so that as many fit as a corpus has."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = array("q", np.sort(np.asarray(hashes, dtype=np.int64)).tobytes())

    def __len__(self) -> int:
        return len(self.hashes)

    def __contains__(self, word: str) -> bool:
        h = word_hash(word)
        k = bisect_left(self.hashes, h)
        return k < len(self.hashes) and self.hashes[k] == h


class FamilyNames:
    """How much a word looks like a family name: log odds of its beginnings and endings, learned from labelled words."""

    def __init__(self, family: list[str], other: list[str], given: Iterable[str] = ()):
        self.known_other: set[str] | Words = {bare(w) for w in other}
        self.given = names.GIVEN | set(names.NICKNAMES) | {bare(w) for w in given}
        yes, no = Counter(), Counter()
        family_set = {bare(w) for w in family if len(w) > 2}
        others = {w for w in self.known_other if len(w) > 2} - family_set
        for words, counts in ((family_set, yes), (others, no)):
            for w in words:
                counts.update(self.parts(w))
        self._weigh(((p, yes[p], no[p]) for p in {*yes, *no}), len(family_set), len(others))
        self.family: set[str] | Words = family_set
        self.facts: dict[str, tuple] = {}

    def _weigh(self, counts: Iterable[tuple[str, int, int]], families: int, others: int) -> None:
        n, m = families + 1, others + 1
        # the same is added to both shares: else each part would count the more for a family name, the more others there are
        self.weight = {p: math.log((yes + 0.3) / n) - math.log(no / m + 0.3 / n) for p, yes, no in counts}

    @classmethod
    def counted(cls, family: Words, other: Words, counts: Iterable[tuple[str, int, int]], given: Iterable[str]) -> FamilyNames:
        """The model of words that were counted elsewhere: ``counts`` has of each beginning and ending how many family names and how many others have it."""
        model = cls([], [], given)
        model.family, model.known_other = family, other
        model._weigh(counts, len(family), len(other))
        return model

    def fact(self, word: str) -> tuple[bool, str, bool, float, bool]:
        """(capital, plain form, given name, score, may begin or be a name) of a word, kept as words recur."""
        if len(self.facts) >= 500_000:  # only memory: what is forgotten is worked out again
            self.facts.clear()
        low = bare(word)
        stem = re.sub(r"['’]s$", "", word)
        capital = bool(_CAPITAL.match(word))
        score = max(self.score(word), self.score(stem) if stem != word else -KNOWN) if capital else -KNOWN  # of no use for another
        found = self.facts[word] = (capital, low, low in self.given, score, capital and (low in self.given or score > -3 or low in _TITLES))
        return found

    def facts_of(self, words: list[str]) -> list[tuple]:
        get = self.facts.get
        return [get(w) or self.fact(w) for w in words]

    def __getstate__(self):
        return self.__dict__ | {"facts": {}}

    @staticmethod
    def parts(w: str) -> list[str]:
        return [f"^{w[:k]}" for k in (2, 3, 4) if len(w) > k] + [f"{w[-k:]}$" for k in (3, 4, 5) if len(w) > k]

    def score(self, word: str) -> float:
        """Positive: rather a family name. A hyphenated word counts by its weakest part."""
        parts = [p for p in re.split(r"-", bare(word)) if p]
        if not parts or min(map(len, parts)) < 3:
            return -KNOWN
        return min(self._score(p) for p in parts)

    def _score(self, w: str) -> float:
        if w in self.family:
            return KNOWN
        if w in self.known_other:
            return -KNOWN
        hits = [self.weight.get(p, -0.3) for p in self.parts(w)]
        return sum(hits)


_MAY_NAME = itemgetter(4)


@lru_cache(maxsize=200_000)
def _is_org(token: str) -> bool:
    return names._sort_of(bare(token))[0] in ("line", "school", "legal")


def _person_names(line: str, model: FamilyNames) -> list[tuple[int, int]]:
    """Places of persons' names in one line."""
    facts = model.facts_of(_TOKEN.findall(line))
    if not any(map(_MAY_NAME, facts)):
        return []
    tokens = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(line)]
    caps = [f[0] for f in facts]
    out: list[tuple[int, int]] = []
    k, n = 0, len(tokens)

    def gap(i: int) -> str:
        return line[tokens[i][2] : tokens[i + 1][1]] if i + 1 < n else line[tokens[i][2] :]

    def firm(i: int) -> bool:
        """Does a word of firms or schools follow the token, at once or after a comma or dash?"""
        j = i + 1
        if j >= n:
            return False
        between = gap(i)
        if not re.fullmatch(r"[\s,.\-–—&+]*(?:['’]s)?\s*", between):
            return False
        if "&" in between or "+" in between:
            return True
        return caps[j] and len(tokens[j][0]) > 1 and _is_org(tokens[j][0])

    def given(i: int) -> bool:
        return i < n and caps[i] and facts[i][2]

    def family(i: int, least: float = 0.0) -> bool:
        return i < n and caps[i] and len(tokens[i][0]) > 2 and not facts[i][2] and facts[i][3] > least

    while k < n:
        word, a, b = tokens[k]
        if not caps[k]:
            k += 1
            continue
        low = facts[k][1]
        if low in _TITLES and k + 1 < n and re.fullmatch(r"\.?\s+", gap(k)):
            j = k + 1
            if len(tokens[j][0]) == 1 and gap(j).startswith(".") and j + 1 < n:
                j += 1
            if given(j) and family(j + 1, -4) and gap(j).strip() == "":
                j += 1
            if (family(j, -3) or given(j)) and not firm(j):
                out.append((tokens[k + 1][1], tokens[j][2]))
                k = j + 1
                continue
        if given(k):
            between = gap(k)
            if k + 1 < n and between.strip() in ("", ".") and "\n" not in between:
                j = k + 1
                if len(tokens[j][0]) == 1 and caps[j] and gap(j).startswith(".") and j + 1 < n:
                    j += 1
                if given(j) and family(j + 1) and gap(j).strip() == "":
                    j += 1
                if family(j, -2.5) and not firm(j):
                    out.append((a, tokens[j][2]))
                    k = j + 1
                    continue
        if family(k) and k + 1 < n:
            between = gap(k)
            if between in (", ", ",", " ") and (given(k + 1) or between.startswith(",") and len(tokens[k + 1][0]) == 1 and caps[k + 1] and gap(k + 1).startswith(".")) and not firm(k + 1):
                if not (between == " " and family(k + 2) and gap(k + 1) == " "):
                    out.append((a, tokens[k + 1][2]))
                    k += 2
                    continue
        if len(word) == 1 and k + 1 < n and re.fullmatch(r"\.\s?", gap(k)):
            j = k + 1
            if len(tokens[j][0]) == 1 and caps[j] and re.fullmatch(r"\.\s?", gap(j)) and j + 1 < n:
                j += 1
            if family(j) and not firm(j):
                out.append((a, tokens[j][2]))
                k = j + 1
                continue
        # a family name by itself: one that is known, or any before a genitive
        stem = re.sub(r"['’]s$", "", word)
        least = 0.0 if stem != word else KNOWN - 1
        if facts[k][3] > least and len(stem) > 4 and not facts[k][2] and not firm(k) and not (k and gap(k - 1) == " " and _is_org(tokens[k - 1][0])):
            out.append((a, a + len(stem)))
        k += 1
    return out


def _free(spans: list[Found], a: int, b: int) -> bool:
    return not any(a < s.end and s.start < b for s in spans)


def entities(text: str | None, model: FamilyNames) -> list[Found]:
    """Personal information in a text, in the order of places in the text as it stands."""
    if not text:
        return []
    flat, moves = forms.canonical_with_places(text)
    spans: list[Found] = []

    def add(kind: str, a: int, b: int) -> None:
        if _free(spans, a, b):
            spans.append(Found(kind, a, b, flat[a:b]))

    at = 0
    for line in _LINE_END.split(flat):
        if len(line) > 3:
            if "@" in line or ("(" in line or "[" in line or "{" in line) and _AT.search(line):
                for m in _EMAIL.finditer(line):
                    add("email", at + m.start(), at + m.end())
            digits = len(_DIGITS.findall(line))
            words = _LETTERS.findall(line.lower()) if digits else []
            if digits >= 4 and _ID_HINT(words):
                for pattern in (_ID_AFTER, _ID_BEFORE):
                    for m in pattern.finditer(line):
                        of_it, length = len(_DIGITS.findall(m[1])), len(re.sub(r"[\W_]", "", m[1]))
                        if of_it >= 4 and length >= 6 and (of_it >= 5 or length > of_it):
                            add("id_number", at + m.start(1), at + m.end(1))
            if digits >= 7:
                for m in _ID_PLAIN.finditer(line):
                    add("id_number", at + m.start(), at + m.end())
                for pattern in _PHONES:
                    for m in pattern.finditer(line):
                        if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                            add("phone", at + m.start(), at + m.end())
                for m in _PHONE_CUE.finditer(line):
                    if 7 <= len(_DIGITS.findall(m[1])) <= 15:
                        add("phone", at + m.start(1), at + m.end(1))
            if digits:
                for hint, patterns in _HINTED_ADDRESSES:
                    if hint(words):
                        for pattern in patterns:
                            for m in pattern.finditer(line):
                                add("address", at + m.start(), at + m.end())
            for a, b in _person_names(line, model):
                add("name", at + a, at + b)
        at += len(line) + 1
    starts = [m[0] for m in moves]
    there = lambda p: p if not moves or (i := bisect_right(starts, p)) == 0 else moves[i - 1][1] + p - moves[i - 1][0]
    return sorted((Found(s.kind, there(s.start), there(s.end - 1) + 1, s.value) for s in spans), key=lambda s: s.start)


# ---- surrogates ----

# --- Fixed values: given names for surrogates, by the gender they are usual for. ---
_SURROGATE_GIVEN = {
    "f": "Alba Berta Cleo Delia Edda Flora Gesa Hedda Ilka Jella Kara Ludmila Mona Nora Odile Petra Quirina Runa Sunna Tilda Ulla Verena Wanda Xenia Yara Zilla".split(),
    "m": "Adrian Boris Cyril Detlef Edgar Falk Gero Hugo Igor Jasper Kasimir Leopold Magnus Norbert Otto Piet Quentin Ruben Sixtus Till Ulf Valentin Wim Xaver Yannick Zeno".split(),
}
# --- Fixed values: given names usual for women; others count as men's. ---
_WOMEN = set("amara anais beatriz chloe christina daniela dora dorothea elizabeth femi frances giulia grace hana iris ingrid kavya katherine leila lina lucja lucia mina margaret meera nadia noor priya rebecca renee rose samantha selin theodora victoria yuki zoe anna maria emma eva fatima hannah helen isabel jane julia laura linda marie mary nina olga patricia sara sofia susan ursula alexandra becky becca beth liz lizzie betty lisa libby bess thea peggy maggie meg greta madge rita daisy kate kathy katie kat cathy kitty bea trixie".split())
_ONSETS, _VOWELS, _ENDS = "b d f g h k l m n p r s t v w z".split(), "a e i o u".split(), "l n r s t rg lm nd rk".split()


def _stream(key: bytes, kind: str, value: str, salt: int) -> int:
    return int.from_bytes(hmac.new(key, f"{kind}\x00{value}\x00{salt}".encode(), hashlib.sha256).digest(), "big")


def _cased(word: str, like: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.lower() if like.islower() else word[:1].upper() + word[1:]


def _made_word(bits: int, syllables: int = 4) -> str:
    out = ""
    for _ in range(syllables):
        bits, o = divmod(bits, len(_ONSETS))
        bits, v = divmod(bits, len(_VOWELS))
        out += _ONSETS[o] + _VOWELS[v]
    return out + _ENDS[bits % len(_ENDS)]


def _same_pattern(value: str, bits: int) -> str:
    """Digits for digits and letters for letters; a country code or what else stands before the first four digits keeps its length."""
    out = []
    for ch in value:
        if ch.isdigit():
            bits, d = divmod(bits, 10)
            out.append(str(d))
        elif ch.isascii() and ch.isalpha() and any(x.isdigit() for x in value):
            bits, d = divmod(bits, 26)
            out.append(_cased(chr(97 + d), ch) if ch.islower() else chr(65 + d))
        else:
            out.append(ch)
    return "".join(out)


def reference_form(kind: str, value: str) -> str:
    """What makes two mentions the same: letters and digits, without case, accents and signs between them."""
    plain = bare(value)
    return re.sub(r"\W+", " " if kind in ("name", "address") else "", plain).strip()


# --- Fixed values: endings that tell apart surrogates of given names with one gender and initial. ---
_GIVEN_ENDINGS = {"f": "lina rita nella dora mira sina vera tessa lotta wina".split(), "m": "mar win bert rik dan gard lef mund tor vin".split()}


@lru_cache(maxsize=8)
def given_surrogates(key: bytes) -> tuple[dict[str, str], dict[str, str]]:
    """Of each letter its surrogate as an initial, and of each known given name its own surrogate, which begins with that of its initial and keeps the gender.

    Both are fixed by the key alone, and no two are equal.
    """
    letters = [chr(97 + k) for k in range(26)]
    initials = dict(zip(letters, sorted(letters, key=lambda x: _stream(key, "initial", x, 0))))
    groups: dict[tuple[str, str], list[str]] = {}
    for name in sorted(names.GIVEN | set(names.NICKNAMES)):
        groups.setdefault(("f" if name in _WOMEN else "m", initials.get(name[0], name[0])), []).append(name)
    out = {}
    for (gender, initial), those in groups.items():
        base = next((n for n in _SURROGATE_GIVEN[gender] if n[0].lower() == initial), _SURROGATE_GIVEN[gender][0])
        for k, name in enumerate(sorted(those, key=lambda x: _stream(key, "given", x, 0))):
            turn, ending = divmod(k - 1, len(_GIVEN_ENDINGS[gender]))
            out[name] = base if k == 0 else base + _GIVEN_ENDINGS[gender][ending] * (turn + 1)
    if len({x.lower() for x in out.values()}) < len(out):
        raise ValueError("two given names have one surrogate")
    return initials, out


def coined_parts(value: str) -> list[str]:
    """The parts of a person's name that get a coined word: all but known given names and initials of the alphabet."""
    parts = [bare(p) for w in _TOKEN.findall(value) for p in w.split("-")]
    return sorted({p for p in parts if p not in names.GIVEN and p not in names.NICKNAMES and not re.fullmatch("[a-z]", p)})


def coined(part: str, key: bytes, salt: int = 0) -> str:
    """A word for a part of a name; never one of the surrogates of given names."""
    reserved = {x.lower() for x in given_surrogates(key)[1].values()}
    word = _made_word(_stream(key, "family", part, salt), 4 if len(part) > 1 else 1)
    while word in reserved:
        word = _made_word(_stream(key, "family", f"{part}\x00{word}", salt), 4)
    return word


def name_surrogate(value: str, key: bytes, words: dict[str, str]) -> str:
    """A person's name with each part replaced by its own surrogate; ``words`` has those of ``coined_parts``."""
    initials, given = given_surrogates(key)

    def part(p: str) -> str:
        low = bare(p)
        if low in given:
            return _cased(given[low], p)
        return initials[low].upper() if re.fullmatch("[a-z]", low) else _cased(words[low], p)

    return _TOKEN.sub(lambda m: "-".join(map(part, m[0].split("-"))), value)


def surrogate(kind: str, value: str, key: bytes, salt: int = 0) -> str:
    """A replacement of the same kind and format. A part of a name has the same one wherever it stands."""
    if kind == "name":
        return name_surrogate(value, key, {p: coined(p, key, salt) for p in coined_parts(value)})
    bits = _stream(key, kind, reference_form(kind, value), salt)
    if kind == "email":
        return f"{_made_word(bits)}{bits % 97}@{_made_word(bits >> 64, 2)}.invalid"
    if kind == "address":
        return re.sub(r"\d+", lambda m: str(1 + bits % 198) if len(m[0]) < 4 else _same_pattern(m[0], bits >> 20), _TOKEN.sub(lambda m: m[0] if re.fullmatch(rf"(?:{_STREET}|rue|boulevard|avenue|chemin|calle|plaza|de|la|des|du|flat|apt)", m[0], re.I) else _cased(_made_word(bits >> 40, 3), m[0]), value))
    return _same_pattern(value, bits)
