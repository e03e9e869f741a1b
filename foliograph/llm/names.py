"""Problem 4, the plain-Python part: reading the name of a firm or school.

``read`` takes a name apart into first name, name proper (one or two words),
line of business or kind of school; ``align`` says by the best assignment of
tokens whether two readings can be the same, permitting one edit in a word,
initials, nicknames and abbreviations.
"""

from __future__ import annotations

import functools
import re
from typing import NamedTuple

from . import forms
from .titles import deletes, near

# --- Fixed values: lines of business and their short forms. ---
LINES: dict[str, str] = {
    "technologies": "technology tech technol techn", "construction": "constructions const constr constrn", "foods": "food", "pharma": "pharmaceuticals pharmaceutical pharm",
    "media": "med", "logistics": "logistic log logist", "energy": "energies enrgy", "engineering": "engg eng engrg engineers", "manufacturing": "mfg manuf manufacturers manufg",
    "services": "serv service svcs svc servs", "solutions": "soln solns solution sol", "software": "softw sw s/w softwares", "systems": "sys system syst", "robotics": "rob robotic robot",
    "laboratories": "labs lab laboratory", "airways": "airw airway airlines", "insurance": "ins insur insurances", "retail": "ret retailers", "textiles": "text textile tex",
    "hospital": "hosp hospitals", "consulting": "consultg cons consult consultants consultancy consltg", "management": "mgt mgmt mgmnt mngmt", "international": "intl int'l internat internatl", "partners": "ptnrs partner ptnr ptrs",
    "bank": "banking bk", "chemicals": "chem chemical", "motors": "motor automotive", "electronics": "electronic electr", "holdings": "holding hldgs", "trading": "traders trdg", "publishing": "publ publishers", "security": "secur", "design": "designs",
    "telecom": "telecommunications telecoms", "transport": "transports transp", "hotels": "hotel", "travel": "travels", "aviation": "aerospace", "industries": "industry ind", "group": "grp", "studios": "studio", "networks": "network netw", "analytics": "analytic",
}
# --- Fixed values: kinds of school and their other forms. ---
SCHOOLS: dict[str, str] = {
    "college": "clg coll colleges col", "university": "universidad univ universite universitat universita uni u universitet universitaet", "polytechnic": "poly polytech polytechnique politecnico politecnica polytechn",
    "institute": "inst instituto institut instit", "hochschule": "hs fachhochschule", "academy": "acad akademie academie academia", "school": "sch schule escuela ecole",
}
# --- Fixed values: legal forms. ---
LEGAL = set("inc incorporated llc ltd limited pvt private p gmbh ag sa co company corp corporation plc kg ohg llp lp srl spa bv nv oy ab as sarl sas eurl ev mbh cie limitada ltda pte pty".split())
STOP = set("of the and de des du la le los las el der die das von zu fur for y et und & + at in".split())
# --- Fixed values: short and pet forms of given names. ---
NICKNAMES: dict[str, str] = {
    "bill": "william", "will": "william", "billy": "william", "willy": "william", "liam": "william", "becky": "rebecca", "becca": "rebecca", "bob": "robert", "rob": "robert", "bobby": "robert", "bert": "robert", "robbie": "robert",
    "beth": "elizabeth", "liz": "elizabeth", "lizzie": "elizabeth", "betty": "elizabeth", "eliza": "elizabeth", "lisa": "elizabeth", "libby": "elizabeth", "bess": "elizabeth", "chris": "christopher christian christina", "kit": "christopher katherine", "topher": "christopher", "dan": "daniel", "danny": "daniel", "dani": "daniel daniela",
    "fran": "francisco frances francis", "paco": "francisco", "pancho": "francisco", "kiko": "francisco", "frank": "francisco francis", "curro": "francisco", "thea": "theodora dorothea", "dora": "theodora dorothea", "teddy": "theodora theodore", "theo": "theodora theodore", "peggy": "margaret", "maggie": "margaret", "meg": "margaret", "greta": "margaret", "madge": "margaret", "rita": "margaret", "daisy": "margaret", "marge": "margaret",
    "mick": "michael", "mike": "michael", "mickey": "michael", "micky": "michael", "sasha": "aleksandr aleksandra alexander", "alex": "aleksandr alexander alexandra", "sascha": "aleksandr alexander", "sandy": "aleksandr alexander", "xander": "alexander aleksandr", "alek": "aleksandr", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kat": "katherine", "cathy": "katherine", "kay": "katherine", "kitty": "katherine",
    "hans": "johannes", "jo": "johannes joseph josephine", "johann": "johannes", "jan": "johannes", "hannes": "johannes", "pepe": "jose", "chepe": "jose", "tom": "tomas tomasz thomas", "tommy": "tomas thomas", "tomek": "tomasz", "sam": "samuel samantha", "sammy": "samuel", "bea": "beatriz", "betty-": "beatriz", "trixie": "beatriz", "vic": "victor victoria", "ed": "eduardo edward", "nick": "nicholas nikolai", "tony": "antonio anthony", "jim": "james", "jack": "john jack",
    "joe": "joseph", "dick": "richard", "rick": "richard", "rich": "richard", "steve": "stephen steven", "matt": "matthew matteo", "teo": "matteo", "ben": "benjamin", "andy": "andrew", "tim": "timothy", "jurg": "jurgen", "juergen": "jurgen", "jorg": "jurgen", "bjoern": "bjorn", "lucy": "lucja lucia", "lucia": "lucja", "rafa": "rafael", "rafi": "rafael", "pasha": "pavel", "paul": "pavel paul", "nadya": "nadia", "giulietta": "giulia", "julia": "giulia julia", "osc": "oscar", "zoe": "zoe", "renee": "renee", "ollie": "oliver", "greg": "gregory",
}
# --- Fixed values: given names that stand before family names in names of firms. ---
GIVEN = set(
    "aleksandr alexander alexandra amara anais arjun beatriz bjorn bram chloe christopher christian christina daniel daniela dora dorothea eduardo edward elizabeth emre femi frances francis francisco giulia grace hana iris ingrid ishaan james john jose joseph jurgen "
    "johannes kavya katherine kofi leila lina lucja lucia mina marek margaret mark matteo matthew meera michael nadia noor oscar pavel priya rafael rebecca renee richard robert rohan rose samuel samantha selin soren stephen theodora theodore tomas tomasz thomas victor victoria wei william yuki zoe "
    "anna maria peter paul andrew anthony antonio benjamin carlos david emma eva fatima george hannah helen henry isabel ivan jane julia karl laura linda lucas luis marie martin mary nicholas nina olga oliver patricia pedro philip sara sofia stefan susan sven timothy ursula walter yusuf".split()
)

_ACCENTS = {ord(a): b for a, b in zip("áàâäãåéèêëíìîïóòôöõúùûüçñøłýšžč", "aaaaaaeeeeiiiiooooouuuucnolyszc")}
_FIXED = {**{x: k for k, v in LINES.items() for x in (k, *v.split())}}
_KIND = {**{x: k for k, v in SCHOOLS.items() for x in (k, *v.split())}}


class Reading(NamedTuple):
    core: tuple[str, ...]  # the name proper, sorted
    line: str  # line of business or kind of school, "" if not named
    first: str  # first name or initial, "" if none


def _plain(text: str) -> str:
    return text.lower().replace("ß", "ss").replace("’", "'").translate(_ACCENTS)


_NEIGHBOURS: dict[str, list[str]] = {}
for _w in sorted({*_FIXED, *_KIND, *GIVEN}):
    if len(_w) >= 3:
        for _d in deletes(_w):
            _NEIGHBOURS.setdefault(_d, []).append(_w)


def _close(token: str) -> list[str]:
    """Known words within one edit of a token, by the index of deletions."""
    return sorted({k for d in deletes(token) for k in _NEIGHBOURS.get(d, ()) if near(k, token) <= 1})


@functools.lru_cache(maxsize=200_000)
def _sort_of(token: str) -> tuple[str, str]:
    """(sort, usual form) of a token in small letters: line, school, legal, given, initial, stop or core."""
    bare = token.replace(".", "")
    if token in STOP or bare in STOP:
        return "stop", ""
    if bare in LEGAL:
        return "legal", bare
    if bare in _FIXED:
        return "line", _FIXED[bare]
    if bare in _KIND:
        return "school", _KIND[bare]
    if len(bare) == 1:
        return "initial", bare
    if bare in GIVEN or bare in NICKNAMES:
        return "given", bare
    if len(bare) >= 3:
        close = [k for k in _close(bare) if len(k) >= (4 if len(bare) >= 5 else 3) and (k in GIVEN and len(k) >= 5 < len(bare) + 1 or k not in GIVEN) and (len(k) > 3 or sorted(k) == sorted(bare))]
        for table, sort in ((_FIXED, "line"), (_KIND, "school")):
            there = [k for k in close if k in table]
            if there:
                return sort, table[max(there, key=len)]
        if close and len(bare) >= 5:
            return "given", close[0]
    return "core", bare


def _unglued(token: str) -> list[str]:
    """A token that may have a line of business run on, apart."""
    bare = token.replace(".", "")
    if _sort_of(token)[0] != "core" or len(bare) < 7:
        return [token]
    for cut in range(len(bare) - 2, 3, -1):
        tail = bare[cut:]
        if (tail in _FIXED or tail in _KIND) and len(tail) >= 3 and (token.endswith(".") or tail not in ("ins", "ret", "eng", "rob", "sol", "med", "log", "tex", "col", "ind", "uni", "lab", "sys", "sch")) and cut >= 4:
            return [bare[:cut], tail]
    for cut in range(len(bare) - 6, 4, -1):
        tail = bare[cut:]
        if any(len(k) >= 6 and k not in GIVEN for k in _close(tail)):
            return [bare[:cut], tail]
    return [token]


def read(name: str | None) -> Reading | None:
    """The reading of a name; None for a null name or one without a word."""
    text = forms.canonical(name or "") or ""
    text = re.sub(r"(?i)^\W*m/s\.?(?=\s)|\bg\.?m\.?b\.?h\b\.?", lambda m: " GMBH " if m[0][:1] in "gG" else "", text)
    text = re.sub(r"(?<=[a-zà-ÿ])(?=[A-ZÀ-Þ])", " ", text)  # BuzikutemTechnology
    text = re.sub(r"\s+", " ", _plain(text)).strip()
    text = re.sub(r"\(p\)", " pvt ", text)
    text = re.sub(r"\b(?:inst(?:itute|\.|)|i\.) ?(?:of )?(?:technology|techn?(?:ol)?\.?)(?=\W|$)|(?<=\w )\bi\.?t\.?$", "institute", text)
    pieces = [p for p in re.split(r"\s*,\s*|\s+[-–—|/]+\s*|\s*[-–—]+\s+", text) if p.strip()]
    core: list[str] = []
    line = school = first = ""
    for n, piece in enumerate(pieces):
        tokens: list[str] = []
        for t in re.findall(r"(?:\w\.){2,}\w?|[\w']+(?:/\w+)?\.?|-", piece.replace("-", " - ")):
            tokens += [t] if t == "-" else _unglued(t)
        sorts = [(t, *_sort_of(t)) for t in tokens if t != "-"]
        telling = any(s in ("line", "school", "given", "initial", "legal") for _, s, _ in sorts)
        if n and core and not telling:
            continue  # a place
        if n and core and "-" in tokens and not any(s in ("line", "school", "legal") for _, s, _ in sorts):
            continue
        for t, sort, usual in sorts:
            if sort == "line":
                line = usual if not line or line == "partners" else line
            elif sort == "school":
                school = usual if not school or school == "institute" else school
            elif sort == "core" and len(usual) > 1:
                core.append(usual)
            elif sort in ("given", "initial") and (not first or len(first) == 1 < len(usual)):
                first = usual
    if school:
        line = "school:" + school
        first = ""
        if school == "hochschule" and len(core) == 1 and core[0].endswith("er") and re.search(r"er hochschule|er hs", text):
            core = [core[0][:-2]]
    if not core and first and len(first) > 1:
        core, first = [first], ""
    if not core:
        return None
    if len(core) > 1 and not line and re.search(r"[&+]| and ", text):
        line = "partners"
    return Reading(tuple(sorted(core)), line, first)


@functools.lru_cache(maxsize=50_000)
def full_names(first: str) -> frozenset[str]:
    return frozenset(NICKNAMES.get(first, first).split()) | {first}


def same_first(a: str, b: str) -> bool:
    """Can two first names be one? An initial fits every name that begins with it, or whose full form does."""
    if not a or not b or a == b:
        return True
    if len(a) == 1 or len(b) == 1:
        return any(x[0] == y[0] for x in full_names(a) for y in full_names(b))
    return bool(full_names(a) & full_names(b)) or min(len(a), len(b)) > 4 and near(a, b) <= 1


#: Cost of giving a word to one that it can't be; more than any number of edits.
NEVER = 1_000_000


def assignment(costs: list[list[int]]) -> int:
    """The least total cost of giving each row a column of its own (as many columns as rows), by shortest augmenting paths."""
    n = len(costs)
    of_row, of_column, owner = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        far, came, done = [NEVER * n + 1] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while owner[at]:
            done[at], row, least, to = True, owner[at], NEVER * n + 1, 0
            for j in range(1, n + 1):
                if not done[j]:
                    cost = costs[row - 1][j - 1] - of_row[row] - of_column[j]
                    if cost < far[j]:
                        far[j], came[j] = cost, at
                    if far[j] < least:
                        least, to = far[j], j
            for j in range(n + 1):
                if done[j]:
                    of_row[owner[j]] += least
                    of_column[j] -= least
                else:
                    far[j] -= least
            at = to
        while at:
            owner[at] = owner[came[at]]
            at = came[at]
    return sum(costs[owner[j] - 1][j - 1] for j in range(1, n + 1))


def align(a: Reading, b: Reading) -> int | None:
    """Edits of the best assignment of one name's words to the other's, or None if they can't be the same."""
    if len(a.core) != len(b.core) or a.line and b.line and a.line != b.line or not same_first(a.first, b.first):
        return None

    def edits(x: str, y: str) -> int:
        n = near(x, y) if min(len(x), len(y)) > 3 else 3 * (x != y)
        return n if n <= 1 else NEVER

    total = assignment([[edits(x, y) for y in b.core] for x in a.core])
    return total if total < NEVER else None
