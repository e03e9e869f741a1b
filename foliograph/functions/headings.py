"""The vocabulary of section headings."""

from __future__ import annotations

# --- Fixed values: headings that stand for each section; a heading listed under two sections belongs to the later. ---
SECTION_HEADINGS: dict[str, str] = {
    "Summary": "summary|professional summary|career summary|profile|professional profile|profile summary|career objective|objective|about me|about|personal statement|executive summary",
    "Personal Information": "personal information|personal details|personal detail|contact|contact information|contact details|personal profile",
    "Experience": "experience|work experience|professional experience|pofessional experience|professional experiance|work experiance|employment history|work history|career history|relevant experience|industry experience|project experience|"
    "professional background|internship experience|internships|internship|career experience|employment|professional employment|work background|career profile|experience summary|career highlights|employment experience",
    "Projects": "project|projects|personal projects|academic projects|key projects|research projects|selected projects|project experience|project highlights|key achievements and projects|project portfolio|selected work|portfolio|"
    "projects and achievements|projects and highlights|projects handled",
    "Education": "education|education qualification|educational qualification|educational background|academic background|academic qualifications|academic qualification|educational qualifications|education and qualifications|eeducation",
    "Domain Experience": "domain experience|domain expertise|industry domain experience|core banking and domain expertise",
    "Business Analysis and Product Management": "business analysis and product management",
    "Technical Program Management": "technical program management",
    "Skills": "skills|key skills|core skills|areas of expertise|skills and competencies|skills and qualifications|technical competencies|technical proficiencies|key competencies|competencies|areas of strength|areas of competence|"
    "technologies|technical tools|computer skills|professional skills|functional skills|interpersonal skills|soft skills|tech stack|tools and technologies",
    "Certifications": "certification|certifications|certificate|certificates|licenses|licences|credentials|licenses and certifications|licences and certifications|certifications and licenses|certifications and licences|certificates and licenses|"
    "certificates and licences|licenses and certificates|licences and certificates|professional certifications|achievements and certifications|achievement and certification|certifications and awards|certificates and awards|certification and licenses",
    "Technical Skills": "technical skills|technical skill set|technical expertise|technical profile|technical exposure",
    "Key Strengths": "key strengths|key strengths and competencies",
    "Core Competencies": "core competencies|core competency|core competences",
    "Training": "training|professional training|professional development|courses|coursework",
    "Tools and Technology": "tools and technology|tools and technologies|technology stack",
    "Publications": "publication|publications|research publications",
    "Awards": "award|awards|achievements|honors|honours",
    "Volunteering": "volunteering|volunteer experience|community involvement",
    "Leadership": "leadership|leadership experience|activities|extracurricular activities",
    "Languages": "language|languages",
    "Interests": "interests|hobbies and interests|hobbies",
    "References": "references|professional references",
}
# --- Fixed values: the structural kind of a section; any other name is its own kind. ---
SECTION_KINDS: dict[str, str] = {
    "experience": "experience|professional experience|work experience|work history|employment history|career history|relevant experience|industry experience|internship experience|internships|career experience|professional background|professional employment|employment experience|work background",
    "summary": "summary|professional summary|profile summary|career summary|executive summary|career objective",
    "skills": "skills|technical skills|core competencies|technical expertise|tools and technologies|tools and technology|professional skills|key skills|core skills|soft skills|skills and competencies|technical competencies",
    "projects": "projects|project experience|personal projects|academic projects|research projects|project highlights|key projects",
    "education": "education|education qualification|educational qualification|educational qualifications|academic qualification|academic qualifications|educational background|academic background",
    "personal information": "header|contact|personal information|personal details",
}


def by_heading() -> dict[str, str]:
    """heading -> section, the later section winning."""
    return {h: section for section, listed in SECTION_HEADINGS.items() for h in listed.split("|")}


def by_section() -> dict[str, str]:
    """section name in small letters -> kind."""
    return {name: kind for kind, listed in SECTION_KINDS.items() for name in listed.split("|")}
