"""Problem 1, the plain-Python part: one form for text that looks the same.

``segments(text)`` finds the unstable segments of a text with a character class
that is built from Unicode's own properties (normalization quick check,
decomposition tags, default-ignorable ranges, look-alike letters), normalizes
each with the context it needs - the blank-delimited run around it, as a mark
composes with the letter before it and a look-alike is judged by its word - and
says what to put in its place. Everything outside of the segments is never
looked at again: ``splice`` copies it unchanged.
"""

from __future__ import annotations

import re
import unicodedata as ud

# --- Fixed values: look-alike letters and the Latin letters they stand for. ---
LOOKALIKES: dict[str, str] = dict(
    zip(
        # Greek capitals, Greek small letters
        "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "ανορυικχγ"
        # Cyrillic capitals, Cyrillic small letters
        "АВЕЅІЈКМНОРСТУХԀԌҺԚԜ" "аеорсухѕіјһԁԛԝӏ"
        # Armenian
        "ՕՍՏօսոհցզ"
        # Cherokee
        "ᎪᎬᎻᏞᎷᏢᎢᏙᎳᏃᏟᏚᏒᏴᎫᏦ",
        "ABEZHIKMNOPTYX" "avopuikxy"
        "ABESIJKMHOPCTYXdGhQW" "aeopcyxsijhdqwl"
        "OUSounhgq"
        "AEHLMPTVWZCSRBJK",
    )
)
# Letters of phonetic script that are drawn as the Latin letter itself.
LATIN_TWINS: dict[str, str] = {"ɑ": "a", "ɡ": "g", "ɩ": "i", "ꞵ": "ß"}
# A single small Greek letter by itself is a sign (α version, χ test), not a Latin letter;
# the others, which are drawn as Latin letters, are signs only before a hyphen (ν-process).
GREEK_SIGNS = set("αγκχ")
# Ranges of characters that show nothing (default ignorable code points and odd controls).
INVISIBLE_RANGES: list[tuple[int, int]] = [
    (0x00, 0x08), (0x0B, 0x0B), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F),
    (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0),
    (0xFFF0, 0xFFFB), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
# Decomposition tags of characters that are another form of the same letter, digit, sign or space.
FORM_TAGS = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")
# Blocks in which characters with a decomposition lie; outside of them everything is stable.
DECOMPOSING_BLOCKS: list[tuple[int, int]] = [
    (0xA0, 0x3400), (0xA640, 0xAC00), (0xF900, 0x10000), (0x10780, 0x107C0), (0x11000, 0x12000),
    (0x1D000, 0x1E000), (0x1EE00, 0x1F300), (0x1FB00, 0x1FC00), (0x2F800, 0x2FA20),
]


def _form(ch: str) -> str | None:
    """The usual spelling of one character, or None if it is the usual one."""
    if ch in "\u0085  ":
        return "\n"
    if ud.category(ch) == "Zs":
        return None if ch == " " else " "
    if ch in LATIN_TWINS:
        return LATIN_TWINS[ch]
    raw = ud.decomposition(ch)
    if not raw:
        return None
    if not raw.startswith("<"):
        nfc = ud.normalize("NFC", ch)
        return nfc if nfc != ch else None
    whole = ud.normalize("NFKC", ch)
    if raw.startswith(FORM_TAGS):
        return whole
    # ligatures, long s, roman numerals: letters written as one sign
    if raw.startswith("<compat>") and ch != "µ" and whole.isalpha() and ud.category(ch)[0] in "LN":
        return whole
    return None


def _ranges(points: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for p in points:
        if out and out[-1][1] == p - 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


def _build() -> tuple[dict[str, str], list[tuple[int, int]]]:
    forms, points = {}, set()
    for lo, hi in DECOMPOSING_BLOCKS:
        for p in range(lo, hi):
            ch = chr(p)
            if (usual := _form(ch)) is not None:
                forms[ch] = usual
                points.add(p)
            elif ud.combining(ch) and not ud.is_normalized("NFC", "e" + ch + "") or 0x300 <= p <= 0x345:
                points.add(p)
    for lo, hi in INVISIBLE_RANGES:
        points.update(range(lo, hi + 1))
    points.update(map(ord, LOOKALIKES))
    return forms, _ranges(sorted(points))


FORMS, UNSTABLE_RANGES = _build()
_esc = lambda p: f"\\U{p:08x}"
UNSTABLE = re.compile("[" + "".join(f"{_esc(a)}-{_esc(b)}" for a, b in UNSTABLE_RANGES) + "]+")
# Spans of stable characters that make up nearly all texts.
STABLE_SPANS: list[tuple[int, int]] = [
    (0x20, 0x7E), (0x09, 0x0A), (0x0C, 0x0D), (0xA1, 0xAC), (0xAE, 0x131), (0x134, 0x13E), (0x150, 0x17E), (0x2010, 0x2010),
    (0x2012, 0x2027), (0x2030, 0x205E), (0x2190, 0x22FF), (0x2500, 0x27BF), (0x1F300, 0x1FAFF),
]
assert not any(a <= hi and lo <= b for a, b in UNSTABLE_RANGES for lo, hi in STABLE_SPANS)
#: For Java: a character that is in none of the stable spans. It is a few comparisons, where the whole class would be hundreds.
JAVA_NOT_SURELY_STABLE = "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in STABLE_SPANS) + "]"
_INVISIBLE = {chr(p) for lo, hi in INVISIBLE_RANGES for p in range(lo, hi + 1)}
_BLANK = re.compile("[ \t\n\r\f]")
_LETTERS = re.compile(r"[^\W\d_]+")
_WORD_NEAR = 40


def _pictorial(ch: str) -> bool:
    return ud.category(ch) in ("So", "Sk") or ch in "️⃣"


def _joins(ch: str, before: str, after: str) -> bool:
    """Does an invisible character belong to an emoji or to the spelling of a joining script?"""
    if ch in "︎️":
        return bool(before) and (_pictorial(before) or before in "0123456789#*" and after == "⃣" or ud.category(before) in ("Sm", "Po"))
    if ch == "‍" and before and after and _pictorial(before) and _pictorial(after):
        return True
    if "\U000e0020" <= ch <= "\U000e007f":
        return before == "\U0001f3f4" or "\U000e0020" <= before <= "\U000e007f"
    if ch in "‌‍" and before and after:
        return all("֐" <= x <= "෿" and ud.category(x)[0] in "LM" for x in (before, after))
    return False


def _meant(word: str, text: str, start: int, end: int) -> bool:
    """Is a word of look-alikes only really meant as Greek or Cyrillic? Judged by itself and the words next to it."""
    if len(word) == 1 and "α" <= word <= "ω" and (word in GREEK_SIGNS or text[end : end + 1] == "-"):
        return True
    script = ud.name(word[0], "").split(" ")[0]
    near = _LETTERS.findall(text[max(0, start - _WORD_NEAR) : start])[-1:] + _LETTERS.findall(text[end : end + _WORD_NEAR])[:1]
    return any(any(ch not in LOOKALIKES and ud.name(ch, "").startswith(script) for ch in w) for w in near)


def _word(word: str, text: str, start: int, end: int) -> str:
    """A word with its look-alikes put right."""
    twins = [ch for ch in word if ch in LOOKALIKES]
    if not twins:
        return word
    foreign = [ch for ch in word if ch not in LOOKALIKES and ch > "ͯ" and not ud.name(ch, "").startswith("LATIN")]
    if foreign:
        return word
    if len(twins) == len(word) and _meant(word, text, start, end):
        return word
    return "".join(LOOKALIKES.get(ch, ch) for ch in word)


def _canonical(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    """Of one blank-delimited run with unstable characters: the replacements within it."""
    units: list[tuple[str, int, int]] = []  # usual spelling, place in text
    for i in range(start, end):
        ch = text[i]
        if ch in _INVISIBLE and not _joins(ch, text[i - 1 : i] if i else "", text[i + 1 : i + 2]):
            usual = ""
        else:
            usual = FORMS.get(ch, ch)
        if units and ud.combining(ch):
            base = units[-1]
            joined = ud.normalize("NFC", base[0] + usual)
            if joined != base[0] + usual:
                units[-1] = (joined, base[1], i + 1)
                continue
        units.append((usual, i, i + 1))
    flat = "".join(u[0] for u in units)
    if any(ch in LOOKALIKES for ch in flat):
        fixed = _LETTERS.sub(lambda m: _word(m[0], text[:start] + flat + text[end : end + _WORD_NEAR], start + m.start(), start + m.end()), flat)
        at = 0
        for k, (usual, a, b) in enumerate(units):  # look-alikes are one for one, so places stay
            units[k] = (fixed[at : at + len(usual)], a, b)
            at += len(usual)
    return [(a, b, usual) for usual, a, b in units if text[a:b] != usual]


def segments(text: str | None) -> list[tuple[int, int, str]]:
    """The places (start, end, usual spelling) where a text has another than the usual spelling."""
    if not text or text.isascii() and (text.isprintable() or not UNSTABLE.search(text)):
        return []
    out: list[tuple[int, int, str]] = []
    done = 0
    for m in UNSTABLE.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and text[start - 1] not in " \t\n\r\f":
            start -= 1
        nxt = _BLANK.search(text, m.end())
        done = nxt.start() if nxt else len(text)
        out += _canonical(text, start, done)
    return out


def splice(text: str, parts: list[tuple[int, int, str]]) -> str:
    """The text with its segments replaced."""
    if not parts:
        return text
    out, at = [], 0
    for a, b, usual in parts:
        out += [text[at:a], usual]
        at = b
    out.append(text[at:])
    return "".join(out)


def canonical(text: str | None) -> str | None:
    """The one form of a text; None stays None."""
    return text if text is None else splice(text, segments(text))


def canonical_with_places(text: str) -> tuple[str, list[tuple[int, int]]]:
    """The one form, and pairs (place in it, place in the text) where the offset between both changes."""
    parts = segments(text)
    moves, shift = [], 0
    for a, b, usual in parts:
        if len(usual) != b - a:
            moves.append((a + shift + len(usual), b))
            shift += len(usual) - (b - a)
    return splice(text, parts), moves


def original_place(place: int, moves: list[tuple[int, int]]) -> int:
    """The place in the text of a place in its one form."""
    best = (0, 0)
    for at, there in moves:
        if at > place:
            break
        best = (at, there)
    return best[1] + place - best[0]
