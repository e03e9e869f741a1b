"""Invented documents for trying things out: each seed gives another one, always the same."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

# --- Fixed values: what the invented documents are made of. ---
_NAMES = ["Mira Talvest", "Jonas Ferrick", "Adela Munsted", "Tomas Birkvall", "Nora Castelby", "Ilan Dorvane"]
_FIRMS = ["Korvane Software Ltd", "Belmira Foods Inc", "Tessaly Systems", "Orinday Laboratories", "Pellworth Bank", "Quintale Technologies"]
_TITLES = ["Software Engineer", "Data Analyst", "Project Manager", "System Administrator", "Business Analyst"]
_DUTIES = ["Built reporting tools using Python and SQL.", "Led the migration of services to Kubernetes.", "Documented the release process for new staff.", "Improved the response time of the order system.", "Designed dashboards for regional managers."]
_SKILLS = ["Python", "SQL", "Docker", "Kubernetes", "Git", "Tableau", "Java", "Linux"]


def sample_text(seed: int) -> str:
    """One invented document with the usual sections."""
    r = random.Random(seed)
    name = r.choice(_NAMES)
    first, last = name.lower().split()
    out = [name, r.choice(_TITLES), f"{first}.{last}@mail.example | +44 20 7946 0{r.randrange(100, 999)}", "", "Summary", "Professional with experience in analysis and communication, used to working with several teams.", "", "Experience"]
    year = r.randrange(2004, 2012)
    for firm in r.sample(_FIRMS, 2):
        out += [f"{firm} - {r.choice(_TITLES)} | Jan {year} - Dec {year + 3}", *[f"- {d}" for d in r.sample(_DUTIES, 2)]]
        year += 4
    return "\n".join([*out, "", "Education", f"Bachelor of Science, University of Tremont, {year - 9}", "", "Skills", ", ".join(r.sample(_SKILLS, 5))])


def samples(spark: SparkSession, n: int = 2) -> DataFrame:
    """upload_id, candidate_name, raw_text of n invented documents."""
    texts = [(seed, sample_text(seed)) for seed in range(n)]
    return spark.createDataFrame([(k, t.split("\n", 1)[0], t) for k, t in texts], "upload_id bigint, candidate_name string, raw_text string")
