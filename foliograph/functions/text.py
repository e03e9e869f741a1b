"""Scalar text functions, as columns. All but ``compatibility_form``, ``decoded`` and ``close_heading`` stay in the JVM.

A null gives null everywhere unless said otherwise. Patterns avoid look-around where a plain form exists.
"""

from __future__ import annotations

import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: list markers, page numbers, months, dates and periods as the documents write them. ---
BULLETS = r"[•▪●○◦·–—>*\-]"
LIST_PREFIX = rf"^\s*(?:({BULLETS})\s*|(\d+[.)])\s*)"
PAGE_NUMBER = r"(?i)^\s*(?:page\s+)?\d{1,3}(?:\s*(?:of|/)\s*\d{1,3})?\s*$"
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DATE_ATOM = rf"(?:{MONTH}\.?\s*-?\s*\d{{2,4}}|\d{{1,2}}/\d{{2,4}}|(?:19|20)\d{{2}})"
PERIOD = rf"(?i)(?:^|\D)({DATE_ATOM})\s*(?:[-–—]|\bto\b)\s*({DATE_ATOM}|present|current|now|till\s+date|to\s+date)(?:\D|$)"
STRICT_PERIOD = rf"(?i)^\s*({DATE_ATOM})\s*(?:[-–—]|\bto\b)\s*({DATE_ATOM}|present|current|now|till\s+date|to\s+date)\s*$"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
PHONE = r"\+?\(?\d[\d ().\-]{5,18}\d"
# --- Fixed values: legal forms of firms and nouns of titles, by which rows are told apart. ---
# ends of words are spelled out: what counts as a word's end next to an accented letter differs between engines
LEGAL_SUFFIX = r"(?i)(?:^|[^\p{L}\p{N}_])(?:ltd|limited|inc|llc|corp|corporation|systems|services|technologies|infotech|bank|university|laboratories)(?:[^\p{L}\p{N}_]|$)"
ROLE_NOUN = (
    r"(?i)(?:^|[^\p{L}\p{N}_])(?:analyst|engineer|developer|consultant|manager|director|designer|architect|scientist|officer|specialist|associate|executive|lead|intern|owner|"
    r"president|chief|researcher|accountant|administrator|coordinator|technician|teacher|nurse|professor|fellow|underwriter)(?:[^\p{L}\p{N}_]|$)"
)


@F.pandas_udf(T.StringType())
def compatibility_form(text: pd.Series) -> pd.Series:
    """NFKC, which has no built-in expression."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes as text: UTF-8 with or without mark, UTF-16 if marked, Windows-1252, else Latin-1."""

    def read(raw: bytes) -> str:
        raw = bytes(raw)
        for name in ("utf-8-sig", *(["utf-16"] if raw[:2] in (b"\xff\xfe", b"\xfe\xff") else []), "cp1252"):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                continue
        return raw.decode("latin-1")

    return content.map(read, na_action="ignore")


def close_heading(value: Column, known: list[str], cutoff: float = 0.88) -> Column:
    """The closest known heading by matching blocks (not edit distance), or null; apply it to distinct short lines."""
    wanted = sorted(known)

    @F.pandas_udf(T.StringType())
    def close(part: pd.Series) -> pd.Series:
        return part.map(lambda v: next(iter(difflib.get_close_matches(v, wanted, n=1, cutoff=cutoff)), None), na_action="ignore")

    return close(value)


def unified_lines(text: Column) -> Column:
    """Line ends as LF, no blanks at line ends nor around the text."""
    lf = F.regexp_replace(text, r"\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lf, r"[ \t]+(\n|$)", "$1"), r"^\s+|\s+$", "")


def indent(line: Column) -> Column:
    return F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))


def list_marker(line: Column) -> Column:
    """The bullet or number a line begins with, or the empty string."""
    return F.concat(F.regexp_extract(line, LIST_PREFIX, 1), F.regexp_extract(line, LIST_PREFIX, 2))


def without_marker(line: Column) -> Column:
    """Without private-use glyphs, a leading bullet or number, and blanks around."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, r"[\x{e000}-\x{f8ff}]", ""), LIST_PREFIX, ""))


def is_page_number(line: Column) -> Column:
    return line.rlike(PAGE_NUMBER)


def word_key(value: Column) -> Column:
    """Words in small letters with one blank between; & counts as and."""
    return F.array_join(F.regexp_extract_all(F.lower(F.replace(value, F.lit("&"), F.lit(" and "))), F.lit(r"[\p{L}\p{N}_+#.]+"), 0), " ")


def slug(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def safe_stem(value: Column) -> Column:
    """A path-safe name; 'resume' for what leaves nothing."""
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(value, F.lit("")), r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", "")
    return F.when(stem == "", F.lit("resume")).otherwise(stem)


def label_case(key: Column) -> Column:
    return F.initcap(F.trim(F.regexp_replace(key, r"[_\-]+", " ")))


def yes_no(flag: Column) -> Column:
    """Yes or No; the empty string for null."""
    return F.when(flag, "Yes").when(~flag, "No").otherwise("")


def period(text: Column) -> Column:
    """struct(start, end) of the first period within a text; null without one."""
    there = F.regexp_extract(text, PERIOD, 1)
    return F.when(there != "", F.struct(there.alias("start"), F.regexp_extract(text, PERIOD, 2).alias("end")))


def strict_period(text: Column) -> Column:
    """struct(start, end) of a text that is nothing but a period; 'till date' and 'to date' become Present."""
    start, end = F.regexp_extract(text, STRICT_PERIOD, 1), F.regexp_extract(text, STRICT_PERIOD, 2)
    return F.when(start != "", F.struct(start.alias("start"), F.when(end.rlike(r"(?i)^(?:till|to)\s+date$"), "Present").otherwise(end).alias("end")))


def four_digit_year(text: Column) -> Column:
    """The first abbreviated year after a month's name written out: up to 39 as 20xx, else 19xx."""
    pattern = rf"(?i)\b({MONTH})\.?\s+(\d{{2}})(?:\D|$)"
    yy = F.regexp_extract(text, pattern, 2)
    century = F.when(yy.try_cast("int") <= 39, "20").otherwise("19")
    return F.when(yy == "", text).otherwise(F.regexp_replace(text, rf"(?i)\b({MONTH})\.?\s+(\d{{2}})(\D|$)", F.concat(F.lit("$1 "), century, F.lit("$2$3"))))


def sentences(line: Column) -> Column:
    """The sentences of a line without its list marker: cut after . ! ? and white space."""
    marked = F.regexp_replace(without_marker(line), r"([.!?])\s+", "$1\u0001")
    return F.filter(F.split(marked, "\u0001"), lambda s: F.trim(s) != "")


def email(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, EMAIL, 0), F.lit(""))


def phone(text: Column) -> Column:
    """The first phone number of 7 to 15 digits."""
    found = F.filter(F.regexp_extract_all(text, F.lit(PHONE), 0), lambda p: F.length(F.regexp_replace(p, r"\D", "")).between(7, 15))
    return F.get(found, F.lit(0))


def link(text: Column, site: str) -> Column:
    """The first link to a site such as linkedin.com/in/ or github.com/."""
    return F.nullif(F.regexp_extract(text, rf"(?i)(?:https?://)?(?:www\.)?{site}[\w\-./%]+", 0), F.lit(""))


def role_title(text: Column) -> Column:
    """Does a line look like a title: a role noun, at most eight words, no end of sentence?"""
    return text.rlike(ROLE_NOUN) & (F.size(F.split(F.trim(text), r"\s+")) <= 8) & ~text.rlike(r"[.!?]$")


def name_like(text: Column) -> Column:
    """Two to six words without digits of which at least three fifths begin with a capital, or a legal form."""
    words = F.split(F.trim(text), r"\s+")
    capital = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    return text.rlike(LEGAL_SUFFIX) | (F.size(words).between(2, 6) & ~text.rlike(r"\d") & (capital * 5 >= F.size(words) * 3))


def company_and_place(text: Column) -> Column:
    """struct(company, place): what follows a legal form and a comma is the place."""
    pattern = r"(?i)^(.*?\b(?:ltd|limited|inc|llc|corp|corporation|gmbh|ag|co)\b\.?)\s*,\s*(.+)$"
    company = F.regexp_extract(text, pattern, 1)
    return F.struct(F.when(company != "", company).otherwise(F.trim(text)).alias("company"), F.when(company != "", F.trim(F.regexp_extract(text, pattern, 2))).alias("place"))


def employment_header(text: Column) -> Column:
    """struct(company, title, period) of a line that begins an employment, else null.

    Forms: "title at company (dates)", "company – title", "company – title | dates", "Company: name".
    """
    at = r"^\s*(.{3,60}?)\s+at\s+(\p{Lu}[^(|]{1,80}?)\s*(?:\(([^()]*)\))?\s*$"
    dash = r"^\s*(\p{L}[^–—|]{1,80}?)\s+[–—]\s+([^|–—]{3,60}?)\s*(?:\|\s*(.+))?$"
    label = r"(?i)^\s*(?:company|employer|organi[sz]ation)\s*:\s*(.+)$"

    def parts(pattern: str, company: int, title: int, when: int) -> Column:
        return F.struct(F.trim(F.regexp_extract(text, pattern, company)).alias("company"), F.nullif(F.trim(F.regexp_extract(text, pattern, title)), F.lit("")).alias("title"), F.nullif(F.trim(F.regexp_extract(text, pattern, when)), F.lit("")).alias("period"))

    named = F.struct(F.trim(F.regexp_extract(text, label, 1)).alias("company"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("period"))
    role = lambda pattern, g: F.regexp_extract(text, pattern, g).rlike(ROLE_NOUN)
    return F.when(text.rlike(label), named).when(text.rlike(at) & role(at, 1), parts(at, 2, 1, 3)).when(text.rlike(dash) & role(dash, 2), parts(dash, 1, 2, 3))


def labelled(text: Column) -> Column:
    """array<struct(label, value)> of "Label: value" parts between pipes; labels in small letters."""
    parts = F.filter(F.split(text, r"\s*\|\s*"), lambda p: p.rlike(r"^\s*[A-Za-z][A-Za-z /-]{1,30}:\s*\S"))
    return F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.regexp_extract(p, r"^\s*([A-Za-z][A-Za-z /-]{1,30}):", 1))).alias("label"), F.trim(F.regexp_extract(p, r"^[^:]+:\s*(.*)$", 1)).alias("value")))


# --- Fixed values: groups of RTF that hold no text of the document, and words that stand for signs. ---
_RTF_HIDDEN = {"fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer", "generator", "themedata", "listtable", "listoverridetable"}
_RTF_SIGNS = {"par": "\n", "line": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "bullet": "•", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”"}
_RTF_TOKEN = re.compile(r"\\'([0-9a-fA-F]{2})|\\([a-zA-Z]+)(-?\d+)? ?|\\(.)|([{}])|([^\\{}\r\n]+)|[\r\n]+", re.S)


def read_rtf(source: str) -> str:
    """The text of an RTF document: groups nest, escapes of bytes are Windows-1252, escapes of characters skip what stands in for them."""
    out: list[str] = []
    stack: list[tuple[bool, int]] = []
    hidden, stand_in, skip = False, 1, 0  # within a hidden group; signs that follow an escape as its stand-in; how many of them are left
    for byte, word, number, symbol, brace, plain in _RTF_TOKEN.findall(source):
        if brace == "{":
            stack.append((hidden, stand_in))
        elif brace:
            hidden, stand_in = stack.pop() if stack else (False, 1)
            skip = 0
        elif byte or plain:
            signs = bytes([int(byte, 16)]).decode("cp1252", errors="replace") if byte else plain
            signs, skip = signs[skip:], max(0, skip - len(signs))
            if not hidden:
                out.append(signs)
        elif word == "u" and number:
            if not hidden:
                out.append(chr(int(number) % 65536))
            skip = stand_in
        elif word == "uc" and number:
            stand_in = int(number)
        elif word in _RTF_HIDDEN or symbol == "*":
            hidden = True
        elif not hidden and word in _RTF_SIGNS:
            out.append(_RTF_SIGNS[word])
        elif not hidden and symbol:
            out.append({"~": " ", "_": "-", "-": ""}.get(symbol, symbol))
    joined = "".join(out).encode("utf-16", errors="surrogatepass").decode("utf-16", errors="replace")  # pairs of escapes that make one character
    return joined.strip()


@F.pandas_udf(T.StringType())
def rtf_text(source: pd.Series) -> pd.Series:
    """The plain text of RTF documents; null for null."""
    return source.map(read_rtf, na_action="ignore")
