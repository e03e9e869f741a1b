"""Records that come as JSON of any shape: brought to the canonical form, merged, and checked.

A record is one document's tree of any depth, which columns cannot describe, so
each text is handled by itself in an Arrow batch; nothing is shuffled. A text
that is no JSON object gives null.
"""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: names that keys go by, by the canonical key. ---
KEY_NAMES = {
    "personal_information": "contact contact_details contact_information", "profile_snapshot": "summary professional_summary career_summary", "work_history": "experience employment_history professional_experience professional_background",
    "projects": "projects_highlights project_highlights key_projects", "domain_experience": "domain_expertise industry_domain_experience core_banking_and_domain_expertise", "technical_skills": "technical_skill tools_and_technology tools_and_technologies",
    "certifications": "certificates licenses licences", "awards": "honors honours", "publications": "publication",
}
# --- Fixed values: names that fields of employments, roles, schools and details go by, first come first served. ---
COMPANY_NAMES = ("company", "employer", "company_name", "organization")
TITLE_NAMES = ("designation", "job_title", "title", "role", "position")
DUTY_NAMES = ("role_and_responsibilities", "responsibilities", "duties")
PERIOD_NAMES = ("duration", "dates", "date_range", "period")
CLIENT_NAMES = ("clients", "client")
DEGREE_NAMES = ("degree", "qualification", "program", "title")
SCHOOL_NAMES = ("institution", "university_or_board", "college_school", "university", "school")
DETAIL_FIELDS = ("date_of_birth", "nationality", "languages", "place", "signature", "gender", "marital_status")
LABELS = {"projects": "name", "certifications": "name", "awards": "name", "achievements": "name", "publications": "name", "domain_experience": "name", "skills": "name"}
LISTS = ("profile_snapshot", "work_history", "education", "projects", "skills", "certifications", "awards", "achievements", "publications", "domain_experience")
OBJECTS = ("personal_information", "personal_details", "source_sections", "source_audit")
PROVENANCE = {"source_blocks", "responsibility_sources", "achievement_sources", "source_audit", "field_sources", "_audit"}
VERSION = "canonical-resume/v1"
_BY_NAME = {name: key for key, names in KEY_NAMES.items() for name in names.split()}
_PERIOD = re.compile(
    r"\s*((?:[A-Z][a-z]{2,8}\.?\s+\d{4}|\d{1,2}/\d{4}|\d{4}))\s*(?:[-–—]|to)\s*((?:[A-Z][a-z]{2,8}\.?\s+\d{4}|\d{1,2}/\d{4}|\d{4})|present|current|till\s+date|to\s+date)\s*", re.I
)


def slug(name: Any) -> str:
    return re.sub(r"[^a-z0-9]+", "_", str(name).casefold()).strip("_")


def flat(value: Any) -> list:
    """A list without nested lists, nulls and empty texts; a single value is a list of one."""
    if value is None or value == "":
        return []
    if not isinstance(value, list):
        return [value]
    return [x for item in value for x in flat(item)]


def merged(into: Any, more: Any) -> Any:
    """Objects field by field, lists with what they lack, other values replaced unless the new one is empty."""
    if isinstance(into, dict) and isinstance(more, dict):
        return into | {k: merged(into[k], v) if k in into else v for k, v in more.items()}
    if isinstance(into, list):
        return into + [x for x in flat(more) if x not in into]
    return into if more in (None, "", [], {}) else more


def merge_section(record: dict, key: str, value: Any) -> int:
    """Puts a section's value into a record by the kind of its key; returns the place where a list's new items begin."""
    if key in ("personal_information", "personal_details"):
        listed = {"additional_details": flat(value)} if not isinstance(value, dict) else value
        record[key] = merged(record.get(key) or {}, listed)
        return 0
    if key in LISTS:
        there = flat(record.get(key))
        record[key] = there + flat(value)
        return len(there)
    before = record.get(key)
    as_object = lambda v: v if isinstance(v, dict) else {"general": flat(v)}
    record[key] = merged(as_object(before), as_object(value)) if before not in (None, "", [], {}) else as_object(value)
    return 0


def _first(record: dict, names: tuple[str, ...]) -> Any:
    return next((record[n] for n in names if record.get(n) not in (None, "", [], {})), None)


def _texts(value: Any) -> list[str]:
    return [t for t in (str(x).strip() for x in flat(value)) if t]


def period(text: str) -> dict[str, str]:
    """start_date and end_date of a text that is nothing but a period; empty otherwise."""
    m = _PERIOD.fullmatch(text)
    return {"start_date": m[1], "end_date": "Present" if re.fullmatch(r"(?:till|to)\s+date", m[2], re.I) else m[2]} if m else {}


def role_of(raw: Any, job: dict, alone: bool) -> dict | None:
    """A role in canonical form; the employer's client and period belong to it only if it is the employer's only role."""
    raw = {"designation": raw} if isinstance(raw, str) else raw
    if not isinstance(raw, dict):
        return None
    known = {*COMPANY_NAMES, *TITLE_NAMES, *DUTY_NAMES, *PERIOD_NAMES, *CLIENT_NAMES, "employment_period", "roles"}
    given = raw.get("employment_period")
    stated = str(_first(raw, PERIOD_NAMES) or (given.get("source_text") if isinstance(given, dict) else given) or (_first(job, PERIOD_NAMES) if alone else None) or "").strip()
    clients = _texts(_first(raw, CLIENT_NAMES)) or (_texts(_first(job, CLIENT_NAMES)) if alone else [])
    role = {k: v for k, v in raw.items() if k not in known} | {"designation": str(_first(raw, TITLE_NAMES) or ""), "role_and_responsibilities": _texts(_first(raw, DUTY_NAMES)), "clients": clients, "duration": stated}
    if "achievements" in role:
        role["achievements"] = _texts(role["achievements"])
    periods = [{"source_text": stated} | given] if isinstance(given, dict) else [{"source_text": stated} | period(stated)] if stated else []
    role["employment_periods"] = periods
    if periods:
        role["employment_period"] = periods[0]
        role |= {k: periods[0][k] for k in ("start_date", "end_date") if periods[0].get(k)}
    return role


def job_of(raw: Any) -> dict | None:
    """An employment in canonical form: a flat one has its one role within, an employer that is an object lends its fields. None for one that is no object."""
    if not isinstance(raw, dict):
        return None
    company = _first(raw, COMPANY_NAMES)
    if isinstance(company, dict):
        raw = raw | {"location": raw.get("location") or company.get("location")}
        company = _first(company, ("name", *COMPANY_NAMES))
    roles = raw.get("roles")
    if not isinstance(roles, list):
        roles = [{k: v for k, v in raw.items() if k not in ("location", "source_blocks", *COMPANY_NAMES)}] if any(k in raw for k in TITLE_NAMES + DUTY_NAMES) else []
        raw = {k: v for k, v in raw.items() if k in ("location", "source_blocks", *PERIOD_NAMES, *CLIENT_NAMES)}
    out = {k: v for k, v in raw.items() if k not in ("roles", "achievements", *COMPANY_NAMES, *CLIENT_NAMES)}
    return out | {"company": str(company or "").strip(), "roles": [r for r in (role_of(x, raw, len(roles) == 1) for x in roles) if r]}


def canonical(source: dict) -> dict:
    """A record in canonical form; what has no place in it is kept under source_sections, and nothing is lost."""
    out: dict[str, Any] = {}
    for name, value in source.items():
        if name == "_audit":
            continue
        key = _BY_NAME.get(slug(name), slug(name))
        out[key] = out[key] + flat(value) if isinstance(out.get(key), list) else value
    information = out.get("personal_information") or {}
    information = dict(information) if isinstance(information, dict) else {"additional_details": flat(information)}
    details = out.get("personal_details") or {}
    details = dict(details) if isinstance(details, dict) else {"additional_details": flat(details)}
    for k in [k for k in information if str(k).isdecimal()]:  # positions instead of names: the first is the name if there is none
        value = information.pop(k)
        if not information.get("name") and isinstance(value, str) and not re.search(r"[\d@]", value):
            information["name"] = value
        else:
            information.setdefault("additional_details", []).append(value)
    for k in ("name", "title", "email", "phone", "location"):
        if k in out and k not in LISTS:
            information.setdefault(k, out.pop(k))
    for k in DETAIL_FIELDS:
        for holder in (out, information):
            if k in holder:
                details.setdefault(k, holder.pop(k))
    email = str(information.get("email") or "")
    if m := re.fullmatch(r"\s*(\S+@\S+?)[\s,;|]+(\+?[\d\s().-]{7,})\s*", email):
        information |= {"email": m[1], "phone": information.get("phone") or m[2].strip()}
    if "languages" in details:
        details["languages"] = _texts(re.split(r"[,;|]", details["languages"]) if isinstance(details["languages"], str) else details["languages"])
    jobs = out.get("work_history")
    broken = [x for x in flat(jobs if isinstance(jobs, list) else [jobs] if jobs else []) if not isinstance(x, dict)]
    record: dict[str, Any] = {"schema_version": VERSION, "personal_information": information, "personal_details": details}
    record["profile_snapshot"] = _texts(out.get("profile_snapshot"))
    record["work_history"] = [j for j in map(job_of, flat(jobs)) if j]
    record["education"] = []
    for x in flat(out.get("education")):
        x = dict(x) if isinstance(x, dict) else {"degree": str(x)}
        degree = _first(x, DEGREE_NAMES)
        record["education"].append(x | ({"degree": degree, "qualification": x.get("qualification") or degree} if degree else {}) | ({"institution": _first(x, SCHOOL_NAMES)} if _first(x, SCHOOL_NAMES) else {}))
    for key, label in LABELS.items():
        value = out.get(key)
        items = [(x, category) for category, listed in value.items() for x in flat(listed)] if isinstance(value, dict) and not value.get(label) else [(x, None) for x in flat(value)]
        record[key] = [(dict(x) if isinstance(x, dict) else {label: str(x)}) | ({"category": c} if c else {}) for x, c in items]
    technical = out.get("technical_skills")
    record["technical_skills"] = {k: _texts(v) for k, v in technical.items()} if isinstance(technical, dict) else _texts(technical)
    known = {*record, "source_sections", "source_audit", "unresolved_blocks"}
    sections = out.get("source_sections") if isinstance(out.get("source_sections"), dict) else {}
    record["source_sections"] = sections | {k: v for k, v in out.items() if k not in known} | ({"unreadable_employments": broken} if broken else {})
    record["source_audit"] = out.get("source_audit") or {}
    return record


def contents(value: Any, key: str = ""):
    """The texts of a record in small letters, without those that tell where something comes from, and without years, dates and scores."""
    if isinstance(value, dict):
        for k, v in value.items():
            if k not in PROVENANCE:
                yield from contents(v, k)
    elif isinstance(value, list):
        for v in value:
            yield from contents(v, key)
    elif isinstance(value, (str, int, float)) and not isinstance(value, bool) and key not in ("year", "start_date", "end_date", "score", "gpa", "cgpa", "percentage"):
        yield str(value).strip().casefold()


def wrong(record: dict) -> list[tuple[str, str]]:
    """(rule, where) of every rule of canonical records that one breaks."""
    out = [("missing field", k) for k in ("schema_version", "technical_skills", *LISTS, *OBJECTS) if k not in record]
    if "schema_version" in record and record["schema_version"] != VERSION:
        out.append(("unknown version", str(record["schema_version"])))
    out += [("not an object", k) for k in OBJECTS if k in record and not isinstance(record[k], dict)]
    out += [("not a list", k) for k in LISTS if k in record and not isinstance(record[k], list)]
    listed = lambda k: record[k] if isinstance(record.get(k), list) else []
    for j, job in enumerate(listed("work_history")):
        here = f"work_history[{j}]"
        if not isinstance(job, dict) or not isinstance(job.get("roles"), list):
            out.append(("employment without roles", here))
            continue
        if "details" in job:
            out.append(("details instead of roles", here))
        if not str(_first(job, COMPANY_NAMES) or "").strip():
            out.append(("employment without employer", here))
        for r, role in enumerate(job["roles"]):
            if not isinstance(role, dict) or not isinstance(role.get("role_and_responsibilities"), list):
                out.append(("role without list of duties", f"{here}.roles[{r}]"))
            else:
                out += [("not a list", f"{here}.roles[{r}].{k}") for k in ("clients", "achievements", "projects") if k in role and not isinstance(role[k], list)]
                out += [("details instead of duties", f"{here}.roles[{r}]")] * ("details" in role)
    for i, entry in enumerate(listed("education")):
        if not isinstance(entry, dict):
            out.append(("education that is no object", f"education[{i}]"))
        elif any(k in entry for k in ("date_of_birth", "languages", "nationality")):
            out.append(("personal detail in education", f"education[{i}]"))
    information, audit = record.get("personal_information"), record.get("source_audit")
    out += [("number as a key", f"personal_information.{k}") for k in (information if isinstance(information, dict) else {}) if str(k).isdecimal()]
    blocks = (audit if isinstance(audit, dict) else {}).get("semantic_block_map") or {}
    text = lambda b: str(b.get("raw_text") or b.get("text") or "").strip().casefold()
    kind, section = (lambda b: str(b.get("block_type") or "").upper()), (lambda b: re.sub(r"\s+", " ", str(b.get("section") or "").casefold()).strip())
    markers = {text(b) for b in blocks.values() if b.get("is_page_number") and kind(b) == "PAGE_ARTIFACT" and text(b)}
    leaked = markers & set(contents({k: v for k, v in record.items() if k not in ("source_audit", "unresolved_blocks")}))
    out += [("page marker in the content", m) for m in sorted(leaked)]
    foreign = {i for i, b in blocks.items() if re.search("domain|expertise|technical skill|tools and technolog", section(b)) or section(b) in ("personal details", "personal information", "languages")}
    private = {i for i, b in blocks.items() if section(b) in ("personal details", "personal information", "languages")}
    employment = ("experience", "professional experience", "work experience", "work history", "employment history", "career history")
    for i, b in sorted(blocks.items()):
        to = str(b.get("destination") or "")
        if section(b) in employment and (to.startswith("$.skills") or to.startswith("$.profile_snapshot") and kind(b) != "PROFILE_SUMMARY"):
            out.append(("employment assigned to another field", i))
        if kind(b) == "PAGE_ARTIFACT" and to:
            out.append(("page marker with a destination", i))
    of = lambda records: {str(s) for x in records if isinstance(x, dict) for s in flat(x.get("source_blocks"))}
    jobs = [j for j in listed("work_history") if isinstance(j, dict)]
    out += [("row of another section in employments", i) for i in sorted((of(jobs) | of([r for j in jobs for r in flat(j.get("roles"))])) & foreign)]
    out += [("personal detail in education", i) for i in sorted(of(listed("education")) & private)]
    if any(section(b) in ("project", "projects", "project highlights") and kind(b) not in ("SECTION_HEADING", "PAGE_ARTIFACT") for b in blocks.values()) and not record.get("projects"):
        out.append(("projects lost", "projects"))
    return out


def _object(text: Any) -> dict | None:
    try:
        value = json.loads(text)
    except (TypeError, ValueError):
        return None
    return value if isinstance(value, dict) else None


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """The canonical form of records as JSON."""
    return pd.Series([None if (r := _object(t)) is None else json.dumps(canonical(r), ensure_ascii=False, sort_keys=True) for t in text], dtype=object)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("rule", T.StringType()), T.StructField("at", T.StringType())])))
def wrong_in_json(text: pd.Series) -> pd.Series:
    """The rules that canonical records as JSON break."""
    return pd.Series([None if (r := _object(t)) is None else wrong(r) for t in text], dtype=object)


@F.pandas_udf(T.StringType())
def merged_json(into: pd.Series, more: pd.Series) -> pd.Series:
    """The first record merged with the second; null only if both are no objects."""
    pairs = [(_object(a), _object(b)) for a, b in zip(into, more)]
    return pd.Series([None if a is None and b is None else json.dumps(merged(a or {}, b or {}), ensure_ascii=False, sort_keys=True) for a, b in pairs], dtype=object)
