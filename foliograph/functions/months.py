"""Dates as people type them, read as months, in columns.

``month_number`` gives 12 * year + month - 1 of a date string or null if the
string is not wholly a valid date. It is built from JVM expressions only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: names of months (also without accents), by number; English, German, French, Spanish, Italian, Portuguese, Dutch. ---
MONTH_NAMES: dict[int, list[str]] = {
    1: ["jan", "january", "januar", "jänner", "janvier", "janv", "enero", "ene", "gennaio", "janeiro", "januari"],
    2: ["feb", "february", "februar", "feber", "février", "févr", "fév", "febrero", "febbraio", "fevereiro", "februari"],
    3: ["mar", "march", "märz", "mär", "mrz", "mars", "marzo", "março", "maart"],
    4: ["apr", "april", "avril", "avr", "abril", "abr", "aprile"],
    5: ["may", "mai", "mayo", "maggio", "maio", "mei"],
    6: ["jun", "june", "juni", "juin", "junio", "giugno", "junho"],
    7: ["jul", "july", "juli", "juillet", "juil", "julio", "luglio", "julho"],
    8: ["aug", "august", "août", "agosto", "ago", "augustus"],
    9: ["sep", "sept", "september", "septembre", "septiembre", "setiembre", "settembre", "setembro"],
    10: ["oct", "october", "okt", "oktober", "octobre", "octubre", "ottobre", "outubro", "out"],
    11: ["nov", "november", "novembre", "noviembre", "novembro"],
    12: ["dec", "december", "dez", "dezember", "décembre", "déc", "diciembre", "dic", "dicembre", "dezembro"],
}
# --- Fixed values: words for "until today", in small letters and without accents. ---
UNTIL_TODAY: list[str] = [
    "present", "the present", "to present", "till present", "until present", "at present", "presently", "current", "currently",
    "now", "until now", "till now", "to now", "today", "until today", "till today", "date", "to date", "till date", "until date",
    "up to date", "to this day", "ongoing", "on going", "on-going", "continuing", "still", "still employed", "to the present",
    "heute", "bis heute", "jetzt", "bis jetzt", "aktuell", "derzeit", "laufend", "gegenwart", "gegenwartig", "bis dato", "dato", "andauernd",
    "aujourd'hui", "jusqu'a aujourd'hui", "a aujourd'hui", "a ce jour", "jusqu'a ce jour", "actuel", "actuellement", "maintenant", "en cours", "present jour",
    "actualidad", "la actualidad", "hasta la actualidad", "a la actualidad", "en la actualidad", "actual", "actualmente", "presente", "al presente",
    "hasta hoy", "hoy", "hasta la fecha", "a la fecha", "hasta ahora", "ahora", "en curso", "vigente",
    "oggi", "ad oggi", "presente giorno", "attuale", "attualmente", "in corso", "hoje", "ate hoje", "atual", "atualmente", "o presente", "ate o momento", "ate ao presente",
    "heden", "nu", "tot heden", "tot nu", "nuvarande", "idag", "i dag", "nutid", "naværende", "nykyinen", "obecnie", "do dzis", "teraz", "do chwili obecnej",
    "soucasnost", "dosud", "sucasnost", "jelenleg", "prezent", "in prezent", "gunumuz", "halen", "devam ediyor",
    "настоящее время", "по настоящее время", "наст. время", "по н.в.", "сейчас", "сегодня", "дотепер", "тепер", "сьогодні",
    "σημερα", "μεχρι σημερα", "τωρα", "現在", "至今", "现在", "今", "현재",
]
_ACCENTED, _PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüçñýάέήίόύώ", "aaaaaaeeeeiiiiooooouuuucnyαεηιουω"
# The shapes of a date once a month's name is written as # and its number; groups y, m and d tell which part is which.
SHAPES: list[str] = [
    r"(?P<y>\d{4})",
    r"(?P<m>\d{1,2}) ?[./-] ?(?P<y>\d{4}|\d{2})",
    r"(?P<y>\d{4}) ?[./-] ?(?P<m>\d{1,2})",
    r"(?P<y>\d{4}) ?[./-] ?(?P<m>\d{1,2}) ?[./-] ?(?P<d>\d{1,2})",
    r"(?P<d>\d{1,2}) ?[./-] ?(?P<m>\d{1,2}) ?[./-] ?(?P<y>\d{4}|\d{2})",
    r"#(?P<m>\d+) ?[,/-]? ?(?:de |of |del )?'?(?P<y>\d{4}|\d{2})",
    r"(?P<d>\d{1,2})(?:st|nd|rd|th|er|\.|º)?[ /-](?:de |of )?#(?P<m>\d+) ?[,/-]? ?(?:de |of |del )?'?(?P<y>\d{4}|\d{2})",
    r"#(?P<m>\d+) (?P<d>\d{1,2})(?:st|nd|rd|th)?,? ?'?(?P<y>\d{4})",
    r"(?P<y>\d{4}) ?[,/-]? ?#(?P<m>\d+)",
]
#: A word that may be a month's name.
NAME = r"([\p{L}]{3,})\.?"


def _one_pattern() -> tuple[str, str]:
    """All shapes as one pattern, and the replacement that writes a match as year|month|day."""
    places: dict[str, list[int]] = {"y": [], "m": [], "d": []}
    number = 0

    def plain_group(m: re.Match) -> str:
        nonlocal number
        number += 1
        places[m[1]].append(number)
        return "("

    whole = "|".join(re.sub(r"\(\?P<(\w)>", plain_group, shape) for shape in SHAPES)
    return f"^(?:{whole})$", "|".join("".join(f"${k}" for k in places[part]) for part in "ymd")


def plain(text: Column) -> Column:
    """Small letters without accents, one blank between words, none around; typographic apostrophes as ASCII."""
    lowered = F.translate(F.lower(text), _ACCENTED + "’‘`´", _PLAIN + "''''")
    return F.trim(F.regexp_replace(lowered, r"[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+", " "))


def _without_accents(word: str) -> str:
    return word.translate(str.maketrans(_ACCENTED, _PLAIN))


def _bind(column: Column, then) -> Column:
    """``then(column)``, where the column is computed once however often ``then`` refers to it."""
    return F.transform(F.array(column), then)[0]


def month_number(value: Column, year_alone_month: int, until_today: Column | None = None) -> Column:
    """The month of a typed date, or null.

    ``year_alone_month`` (1 to 12) is what a year alone means; ``until_today`` is the month number that words
    for "until today" mean (without it they are no date). Valid are year, year and month by number or name, and
    both with a day, which stands first unless the year does, and must exist in that month. Anything else,
    be it a date with a word too many or a month 13, gives null.
    """
    today = F.lit(None).cast("int") if until_today is None else until_today
    names = {_without_accents(name): number for number, group in MONTH_NAMES.items() for name in group}
    by_name = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair])
    pattern, parts = _one_pattern()

    def numbered(p: Column) -> Column:
        number = F.element_at(by_name, F.regexp_extract(p, NAME, 1))
        return F.when(number.isNotNull(), F.regexp_replace(p, NAME, F.concat(F.lit("#"), number.cast("string")))).otherwise(p)

    def year(text: Column) -> Column:
        n = text.try_cast("int")
        return F.when(F.length(text) == 4, n).when(n <= 39, n + 2000).otherwise(n + 1900)

    def from_parts(x: Column) -> Column:
        y = year(x[0])
        month = F.when(x[1] == "", F.lit(year_alone_month)).otherwise(x[1].try_cast("int"))
        return F.struct(y.alias("y"), F.when(month.between(1, 12), month).alias("m"), x[2].alias("day"))

    def valid(x: Column) -> Column:
        last = F.dayofmonth(F.last_day(F.make_date(x["y"], x["m"], F.lit(1))))
        good = (x["y"] >= 1000) & x["m"].isNotNull() & ((x["day"] == "") | x["day"].try_cast("int").between(1, last))
        return F.when(good, x["y"] * 12 + x["m"] - 1)

    def dated(q: Column) -> Column:
        return F.when(q.rlike(pattern), _bind(_bind(F.split(F.regexp_replace(q, pattern, parts), r"\|", -1), from_parts), valid))

    def read(p: Column) -> Column:
        word = F.regexp_replace(p, r"^[-–(\[ ]+|[.)\] ]+$", "")
        return F.when(word.isin(UNTIL_TODAY), today).otherwise(_bind(numbered(p), dated))

    return _bind(plain(value), read)


def month_of(moment: Column) -> Column:
    """The month number of a timestamp."""
    return F.year(moment) * 12 + F.month(moment) - 1


def as_text(number: Column) -> Column:
    """A month number as 'YYYY-MM'."""
    return F.when(number.isNotNull(), F.format_string("%04d-%02d", F.floor(number / 12).try_cast("int"), (F.pmod(number, F.lit(12)) + 1).try_cast("int")))
