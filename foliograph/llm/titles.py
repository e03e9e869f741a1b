"""Problem 5: values typed freely, mapped to a canonical list of job titles.

Distinct values are normalised (one form of characters, small letters, words of
grade, term and team dropped, abbreviations spelled out, words respelled to
known words within one edit) and looked up in an inverted index of the
character n-grams of the list's entries and their known other names. The score
is the cosine of n-grams weighted by their rarity; a title is accepted if its
score reaches a threshold and leads over every other title by a margin. What is
not accepted is reported with title_id -1.

Respelling uses an index of deletions, so every known word within one edit is
found. Where several fit, the one is taken that gives the highest score.

The index holds the reference list only. Its size is checked (``MAX_TITLES``),
so it is a parameter; values, however many, are spread over all tasks. Other
names come as rows (name, title) beside the list; those of ``known_names`` are
taken if none are given.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import forms

GRAM = 3
#: Least cosine of an accepted title, and its least lead over every other title.
THRESHOLD, MARGIN = 0.8, 0.05
MAX_TITLES = 20_000

# --- Fixed values: words that tell grade, term, shift or team and not the occupation. ---
GRADES = set(
    "senior sr snr junior jr jnr lead principal trainee intern staff graduate associate "
    "i ii iii iv v 1 2 3 4 m f d w x mfd mwd contract contractor temporary temp permanent perm part full time parttime fulltime "
    "freelance freelancer interim acting deputy night day late early shift team leader north south east west region regional central "
    "remote hybrid onsite hours hourly weekend evening apprentice working student teamlead".split()
)
# --- Fixed values: abbreviations of single words. ---
SHORT = {
    "eng": "engineer", "engr": "engineer", "engg": "engineer", "engnr": "engineer", "mgr": "manager", "mngr": "manager", "mgmt": "management",
    "dev": "developer", "devel": "developer", "dvlpr": "developer", "admin": "administrator", "adm": "administrator", "asst": "assistant", "assist": "assistant", "tech": "technician", "technicn": "technician",
    "rep": "representative", "cons": "consultant", "coord": "coordinator", "co-ordinator": "coordinator", "supv": "supervisor", "supvr": "supervisor", "spvr": "supervisor", "exec": "executive", "ofcr": "officer", "off": "officer",
    "mktg": "marketing", "mkt": "marketing", "fin": "financial", "cust": "customer", "svc": "service", "serv": "service", "sw": "software", "s/w": "software", "db": "database", "sys": "system", "systems": "system",
    "bus": "business", "mech": "mechanical", "elec": "electrical", "lab": "laboratory", "hr": "human resources", "h.r": "human resources", "qa": "quality assurance", "q.a": "quality assurance", "ux": "user experience",
    "ml": "machine learning", "acct": "account", "sec": "secondary", "prim": "primary", "univ": "university", "constr": "construction", "const": "construction", "maint": "maintenance", "ops": "operations", "purch": "purchasing",
    "proj": "project", "prod": "product", "prog": "program", "programme": "program", "gen": "generalist", "res": "research", "reg": "registered", "wh": "warehouse", "whse": "warehouse", "chem": "chemical", "med": "medical", "secy": "secretary", "ctr": "centre", "center": "centre", "tchr": "teacher", "op": "operator", "oper": "operator",
    "cst": "customer", "counsel": "counsel", "sci": "scientist", "des": "designer", "anal": "analyst", "comp": "compliance", "ins": "insurance", "stat": "station", "net": "network", "netw": "network", "prof": "professional", "pharm": "pharmacist", "physio": "physiotherapist", "teach": "teaching", "kit": "kitchen", "sup": "supply", "chn": "chain", "inf": "information", "tax": "tax", "hosp": "hospital",
    "forklft": "forklift", "cntrl": "control", "contr": "controller", "ctrl": "controller", "graph": "graphic", "int": "interior", "rec": "recruiter", "evt": "event", "trk": "truck", "drv": "driver",
}
# --- Fixed values: whole names that are other words for a title, English and abbreviations. ---
OTHER_ENGLISH = {
    "swe": "Software Engineer", "software developer": "Software Engineer", "programmer": "Software Engineer", "computer programmer": "Software Engineer", "dba": "Database Administrator", "sre": "Site Reliability Engineer", "sysadmin": "System Administrator", "csr": "Customer Service Representative",
    "customer service agent": "Customer Service Representative", "customer service advisor": "Customer Service Representative", "cfo": "Chief Financial Officer", "c.f.o": "Chief Financial Officer", "finance director": "Chief Financial Officer", "cto": "Chief Technology Officer", "c.t.o": "Chief Technology Officer", "ceo": "Chief Executive Officer", "c.e.o": "Chief Executive Officer", "managing director": "Chief Executive Officer",
    "lorry driver": "Truck Driver", "hgv driver": "Truck Driver", "teaching aide": "Teaching Assistant", "classroom assistant": "Teaching Assistant", "pa": "Executive Assistant", "personal assistant": "Executive Assistant", "ea": "Executive Assistant", "hr manager": "Human Resources Manager", "personnel manager": "Human Resources Manager", "rn": "Registered Nurse", "r.n": "Registered Nurse", "staff nurse": "Registered Nurse", "nurse": "Registered Nurse",
    "pt": "Physiotherapist", "physical therapist": "Physiotherapist", "waitress": "Waiter", "cook": "Chef", "headhunter": "Recruiter", "talent acquisition specialist": "Recruiter", "bookkeeper": "Accountant", "attorney": "Legal Counsel", "lawyer": "Legal Counsel", "in-house lawyer": "Legal Counsel", "tester": "Quality Assurance Engineer", "test engineer": "Quality Assurance Engineer", "app developer": "Mobile Developer", "web designer": "Web Developer",
    "webmaster": "Web Developer", "website developer": "Web Developer", "shop manager": "Store Manager", "salesman": "Sales Representative", "sales rep": "Sales Representative", "salesperson": "Sales Representative", "checkout operator": "Cashier", "caregiver": "Care Assistant", "carer": "Care Assistant", "healthcare assistant": "Care Assistant", "forklift driver": "Forklift Operator", "fork lift truck driver": "Forklift Operator", "buyer": "Purchasing Manager", "procurement manager": "Purchasing Manager", "warehouse worker": "Warehouse Operative", "warehouseman": "Warehouse Operative",
    "buying manager": "Purchasing Manager", "elementary school teacher": "Primary School Teacher", "high school teacher": "Secondary School Teacher", "assistant professor": "University Lecturer", "lecturer": "University Lecturer", "telephone agent": "Call Centre Agent", "call center agent": "Call Centre Agent", "call handler": "Call Centre Agent", "loss adjuster": "Claims Adjuster", "claims handler": "Claims Adjuster", "underwriter": "Insurance Underwriter", "tax adviser": "Tax Consultant", "tax advisor": "Tax Consultant", "payroll clerk": "Payroll Administrator", "front desk clerk": "Receptionist", "office administrator": "Administrative Assistant", "reporter": "Journalist", "interpreter": "Translator", "hotelier": "Hotel Manager", "event planner": "Event Coordinator", "site manager": "Construction Manager", "joiner": "Carpenter", "security officer": "Security Guard", "key account manager": "Account Manager", "sommelier": "", "information security analyst": "Security Analyst", "ui/ux designer": "User Experience Designer", "ux designer": "User Experience Designer",
    "legal assistant": "Paralegal", "legal adviser": "Legal Counsel", "administrator assistant": "Administrative Assistant", "chemist": "Pharmacist", "data typist": "Data Entry Clerk", "data input clerk": "Data Entry Clerk", "chartered accountant": "Accountant", "kitchen porter": "Kitchen Assistant", "kitchen helper": "Kitchen Assistant", "technical author": "Technical Writer", "logistics planner": "Supply Chain Planner",
}
# --- Fixed values: German names of the titles, by title. ---
GERMAN = {
    "Software Engineer": "softwareentwickler", "Data Engineer": "dateningenieur", "Data Analyst": "datenanalyst", "Data Scientist": "datenwissenschaftler", "Data Entry Clerk": "datenerfasser|datentypist", "Web Developer": "webentwickler", "Mobile Developer": "app entwickler|mobilentwickler", "Database Administrator": "datenbankadministrator",
    "System Administrator": "systemadministrator", "Network Engineer": "netzwerktechniker|netzwerkingenieur", "Quality Assurance Engineer": "qualitatsingenieur|softwaretester", "Security Analyst": "sicherheitsanalyst", "Business Analyst": "geschaftsanalyst", "Product Manager": "produktmanager", "Project Manager": "projektleiter|projektmanager", "Program Manager": "programmleiter|programmmanager", "Technical Writer": "technischer redakteur",
    "Graphic Designer": "grafiker|grafikdesigner", "Interior Designer": "innenarchitekt|raumausstatter", "Mechanical Engineer": "maschinenbauingenieur", "Electrical Engineer": "elektroingenieur", "Civil Engineer": "bauingenieur", "Chemical Engineer": "chemieingenieur", "Process Engineer": "verfahrensingenieur|prozessingenieur", "Maintenance Technician": "wartungstechniker|instandhaltungstechniker", "Laboratory Technician": "laborant|labortechniker",
    "Research Scientist": "forscher|wissenschaftler", "Research Assistant": "wissenschaftlicher mitarbeiter", "Accountant": "buchhalter", "Auditor": "wirtschaftsprufer|revisor", "Financial Analyst": "finanzanalyst", "Financial Controller": "finanzcontroller", "Payroll Administrator": "lohnbuchhalter", "Tax Consultant": "steuerberater", "Bank Teller": "bankkaufmann|bankkauffrau|kassierer bank", "Insurance Underwriter": "versicherungskaufmann", "Claims Adjuster": "schadensregulierer|schadenregulierer",
    "Sales Manager": "vertriebsleiter", "Sales Representative": "vertriebsmitarbeiter|aussendienstmitarbeiter", "Account Manager": "kundenbetreuer", "Marketing Manager": "marketingleiter", "Marketing Coordinator": "marketingkoordinator", "Store Manager": "filialleiter|marktleiter", "Cashier": "kassierer", "Customer Service Representative": "kundendienstmitarbeiter|kundenberater", "Call Centre Agent": "callcenter agent", "Human Resources Manager": "personalleiter", "Human Resources Generalist": "personalreferent",
    "Recruiter": "personalvermittler", "Office Manager": "buroleiter", "Executive Assistant": "vorstandsassistent|assistent der geschaftsfuhrung", "Administrative Assistant": "verwaltungsassistent|sachbearbeiter", "Receptionist": "empfangsmitarbeiter|rezeptionist", "Legal Counsel": "rechtsberater|syndikus|jurist", "Paralegal": "rechtsanwaltsfachangestellter", "Compliance Officer": "compliancebeauftragter", "Operations Manager": "betriebsleiter", "Warehouse Supervisor": "lagerleiter",
    "Warehouse Operative": "lagerarbeiter|lagerist|lagermitarbeiter", "Forklift Operator": "gabelstaplerfahrer|staplerfahrer", "Truck Driver": "lkw fahrer|lastwagenfahrer|kraftfahrer", "Supply Chain Planner": "logistikplaner", "Purchasing Manager": "einkaufsleiter|einkaufer", "Registered Nurse": "krankenschwester|krankenpfleger|pflegefachkraft", "Care Assistant": "pflegehelfer|altenpfleger", "Pharmacist": "apotheker", "Physiotherapist": "physiotherapeut|krankengymnast", "Dental Hygienist": "dentalhygieniker", "Medical Secretary": "arztsekretar",
    "Primary School Teacher": "grundschullehrer", "Secondary School Teacher": "gymnasiallehrer", "University Lecturer": "hochschuldozent|dozent", "Teaching Assistant": "hilfslehrer", "Librarian": "bibliothekar", "Chef": "koch|kochin", "Kitchen Assistant": "kuchenhilfe|kuchenhelfer", "Hotel Manager": "hoteldirektor|hotelmanager", "Waiter": "kellner", "Event Coordinator": "veranstaltungskoordinator|eventmanager", "Electrician": "elektriker", "Plumber": "klempner|installateur", "Welder": "schweisser", "Carpenter": "tischler|zimmermann|schreiner",
    "Construction Manager": "bauleiter", "Security Guard": "wachmann|sicherheitsmitarbeiter", "Journalist": "journalist|redakteur", "Copywriter": "werbetexter", "Translator": "ubersetzer|dolmetscher", "Photographer": "fotograf", "Chief Executive Officer": "geschaftsfuhrer|vorstandsvorsitzender", "Chief Technology Officer": "technischer leiter|technischer direktor", "Chief Financial Officer": "finanzvorstand|kaufmannischer leiter",
}
# --- Fixed values: French names of the titles, by title. ---
FRENCH = {
    "Software Engineer": "ingenieur logiciel|developpeur", "Data Engineer": "ingenieur de donnees|ingenieur donnees", "Data Analyst": "analyste de donnees", "Data Scientist": "scientifique des donnees", "Data Entry Clerk": "operateur de saisie|agent de saisie", "Web Developer": "developpeur web", "Mobile Developer": "developpeur mobile", "Database Administrator": "administrateur de bases de donnees", "System Administrator": "administrateur systeme|administrateur systemes",
    "Network Engineer": "ingenieur reseau", "Quality Assurance Engineer": "ingenieur qualite", "Security Analyst": "analyste securite", "Business Analyst": "analyste metier", "Product Manager": "chef de produit", "Project Manager": "chef de projet", "Program Manager": "responsable de programme", "Technical Writer": "redacteur technique", "Graphic Designer": "graphiste", "Interior Designer": "architecte d'interieur|decorateur d'interieur", "Mechanical Engineer": "ingenieur mecanique", "Electrical Engineer": "ingenieur electrique",
    "Civil Engineer": "ingenieur civil|ingenieur genie civil", "Chemical Engineer": "ingenieur chimiste", "Process Engineer": "ingenieur procedes", "Maintenance Technician": "technicien de maintenance", "Laboratory Technician": "technicien de laboratoire|laborantin", "Research Scientist": "chercheur", "Research Assistant": "assistant de recherche", "Accountant": "comptable", "Auditor": "auditeur", "Financial Analyst": "analyste financier", "Financial Controller": "controleur financier|controleur de gestion", "Payroll Administrator": "gestionnaire de paie",
    "Tax Consultant": "conseiller fiscal|fiscaliste", "Bank Teller": "guichetier", "Insurance Underwriter": "souscripteur", "Claims Adjuster": "expert en sinistres|gestionnaire de sinistres", "Sales Manager": "directeur des ventes|responsable des ventes", "Sales Representative": "commercial|representant commercial", "Account Manager": "charge de clientele|responsable de comptes", "Marketing Manager": "directeur marketing|responsable marketing", "Marketing Coordinator": "coordinateur marketing", "Store Manager": "directeur de magasin|gerant de magasin", "Cashier": "caissier|caissiere",
    "Customer Service Representative": "conseiller clientele", "Call Centre Agent": "teleconseiller|agent de centre d'appels", "Human Resources Manager": "directeur des ressources humaines|responsable des ressources humaines", "Human Resources Generalist": "generaliste des ressources humaines", "Recruiter": "recruteur|charge de recrutement", "Office Manager": "responsable de bureau", "Executive Assistant": "assistant de direction|assistante de direction", "Administrative Assistant": "assistant administratif", "Receptionist": "receptionniste", "Legal Counsel": "juriste|conseiller juridique",
    "Paralegal": "assistant juridique", "Compliance Officer": "responsable conformite", "Operations Manager": "responsable des operations|directeur des operations", "Warehouse Supervisor": "chef d'entrepot", "Warehouse Operative": "magasinier|manutentionnaire", "Forklift Operator": "cariste", "Truck Driver": "chauffeur routier|chauffeur poids lourd|routier", "Supply Chain Planner": "planificateur logistique", "Purchasing Manager": "responsable achats|acheteur", "Registered Nurse": "infirmier|infirmiere", "Care Assistant": "aide-soignant|aide soignante", "Pharmacist": "pharmacien|pharmacienne", "Physiotherapist": "kinesitherapeute",
    "Dental Hygienist": "hygieniste dentaire", "Medical Secretary": "secretaire medicale", "Primary School Teacher": "professeur des ecoles|instituteur|institutrice", "Secondary School Teacher": "professeur de lycee|professeur de college", "University Lecturer": "maitre de conferences|enseignant chercheur", "Teaching Assistant": "assistant d'education|assistant pedagogique", "Librarian": "bibliothecaire", "Chef": "cuisinier|chef de cuisine|cuisiniere", "Kitchen Assistant": "commis de cuisine|aide de cuisine", "Hotel Manager": "directeur d'hotel", "Waiter": "serveur|serveuse", "Event Coordinator": "coordinateur evenementiel|coordinateur d'evenements",
    "Electrician": "electricien", "Plumber": "plombier", "Welder": "soudeur", "Carpenter": "menuisier|charpentier", "Construction Manager": "conducteur de travaux|chef de chantier", "Security Guard": "agent de securite", "Journalist": "journaliste", "Copywriter": "concepteur redacteur", "Translator": "traducteur|traductrice", "Photographer": "photographe", "Chief Executive Officer": "directeur general|president directeur general", "Chief Technology Officer": "directeur technique", "Chief Financial Officer": "directeur financier",
}
# --- Fixed values: Spanish names of the titles, by title. ---
SPANISH = {
    "Software Engineer": "ingeniero de software|programador", "Data Engineer": "ingeniero de datos", "Data Analyst": "analista de datos", "Data Scientist": "cientifico de datos", "Data Entry Clerk": "grabador de datos|digitador", "Web Developer": "desarrollador web", "Mobile Developer": "desarrollador movil", "Database Administrator": "administrador de bases de datos", "System Administrator": "administrador de sistemas", "Network Engineer": "ingeniero de redes", "Quality Assurance Engineer": "ingeniero de calidad", "Security Analyst": "analista de seguridad", "Business Analyst": "analista de negocio|analista de negocios",
    "Product Manager": "jefe de producto|gerente de producto", "Project Manager": "jefe de proyecto|gerente de proyecto", "Program Manager": "jefe de programa|gerente de programa", "Technical Writer": "redactor tecnico", "Graphic Designer": "disenador grafico", "Interior Designer": "disenador de interiores|interiorista", "Mechanical Engineer": "ingeniero mecanico", "Electrical Engineer": "ingeniero electrico", "Civil Engineer": "ingeniero civil", "Chemical Engineer": "ingeniero quimico", "Process Engineer": "ingeniero de procesos", "Maintenance Technician": "tecnico de mantenimiento", "Laboratory Technician": "tecnico de laboratorio|laboratorista",
    "Research Scientist": "investigador|cientifico investigador", "Research Assistant": "asistente de investigacion|ayudante de investigacion", "Accountant": "contable|contador", "Auditor": "auditor de cuentas", "Financial Analyst": "analista financiero", "Financial Controller": "controlador financiero|controller financiero", "Payroll Administrator": "administrador de nominas", "Tax Consultant": "asesor fiscal", "Bank Teller": "cajero de banco|cajero bancario", "Insurance Underwriter": "suscriptor de seguros", "Claims Adjuster": "perito de seguros|ajustador de siniestros", "Sales Manager": "jefe de ventas|gerente de ventas", "Sales Representative": "representante de ventas|agente comercial|vendedor",
    "Account Manager": "gerente de cuentas|ejecutivo de cuentas", "Marketing Manager": "gerente de marketing|jefe de marketing", "Marketing Coordinator": "coordinador de marketing", "Store Manager": "encargado de tienda|gerente de tienda", "Cashier": "cajero|cajera", "Customer Service Representative": "representante de atencion al cliente|agente de atencion al cliente", "Call Centre Agent": "teleoperador|teleoperadora", "Human Resources Manager": "gerente de recursos humanos|jefe de recursos humanos|jefe de personal", "Human Resources Generalist": "generalista de recursos humanos", "Recruiter": "reclutador|seleccionador de personal", "Office Manager": "jefe de oficina|gerente de oficina",
    "Executive Assistant": "asistente ejecutivo|asistente de direccion", "Administrative Assistant": "auxiliar administrativo|asistente administrativo", "Receptionist": "recepcionista", "Legal Counsel": "asesor juridico|abogado", "Paralegal": "asistente legal", "Compliance Officer": "oficial de cumplimiento", "Operations Manager": "gerente de operaciones|jefe de operaciones", "Warehouse Supervisor": "jefe de almacen|supervisor de almacen", "Warehouse Operative": "mozo de almacen|operario de almacen", "Forklift Operator": "carretillero|operador de montacargas", "Truck Driver": "camionero|conductor de camion", "Supply Chain Planner": "planificador de la cadena de suministro",
    "Purchasing Manager": "jefe de compras|gerente de compras", "Registered Nurse": "enfermero|enfermera", "Care Assistant": "auxiliar de enfermeria|cuidador", "Pharmacist": "farmaceutico|farmaceutica", "Physiotherapist": "fisioterapeuta", "Dental Hygienist": "higienista dental", "Medical Secretary": "secretaria medica", "Primary School Teacher": "maestro de primaria|profesor de primaria|maestra", "Secondary School Teacher": "profesor de secundaria|profesor de instituto", "University Lecturer": "profesor universitario", "Teaching Assistant": "auxiliar docente", "Librarian": "bibliotecario|bibliotecaria", "Chef": "cocinero|cocinera|jefe de cocina", "Kitchen Assistant": "ayudante de cocina|pinche de cocina",
    "Hotel Manager": "director de hotel|gerente de hotel", "Waiter": "camarero|camarera|mesero", "Event Coordinator": "coordinador de eventos", "Electrician": "electricista", "Plumber": "fontanero|plomero", "Welder": "soldador", "Carpenter": "carpintero", "Construction Manager": "jefe de obra", "Security Guard": "guardia de seguridad|vigilante de seguridad", "Journalist": "periodista", "Copywriter": "redactor publicitario", "Translator": "traductor|traductora", "Photographer": "fotografo|fotografa", "Chief Executive Officer": "director general|director ejecutivo", "Chief Technology Officer": "director de tecnologia|director tecnico", "Chief Financial Officer": "director financiero",
}

_WORD = re.compile(r"[^\W_]+(?:[./'&-][^\W_]+)*")
_ACCENTS = {ord(a): b for a, b in zip("áàâäãåéèêëíìîïóòôöõúùûüçñøł", "aaaaaaeeeeiiiiooooouuuucnol")}


def plain(value: str) -> str:
    """One form of characters, small letters, no accents."""
    return (forms.canonical(value) or "").lower().replace("ß", "ss").replace("’", "'").translate(_ACCENTS)


def words(value: str, joined: bool = False) -> list[str]:
    """The words that tell the occupation, abbreviations spelled out. ``joined``: words with a hyphen stay one word, without it."""
    out: list[str] = []
    text = re.sub(r"[,(\[/|–—]\s*(?:m\W*[fw]\W*[dx]?|f\W*m\W*[dx]?)\s*[)\]]?", " ", plain(value))
    for whole in _WORD.findall(text):
        for w in [whole] if whole in OTHER_ENGLISH or whole in SHORT else [whole.replace("-", "")] if joined else whole.split("-"):
            if w in OTHER_ENGLISH or w in SHORT:
                out += SHORT.get(w, w).split()
            elif re.fullmatch(r"(?:\w\.)+\w?", w):  # C.F.O
                out.append(w.replace(".", ""))
            else:
                out += [y for x in re.split(r"[./&]", w) if x for y in SHORT.get(x, x).split()]
    kept = [w for w in out if w not in GRADES]
    return kept or out


def near(a: str, b: str) -> int:
    """Edits (insertions, deletions, substitutions, swaps of neighbours) between two words, counted up to 3."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 2:
        return 3
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], older[j - 2] + 1)
    return min(3, row[-1])


def deletes(word: str) -> set[str]:
    """The word and what is left of it without any one letter: two words within one edit share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def known_names() -> list[tuple[str, str]]:
    """(name, title) of the other names of titles that are known: English, German, French and Spanish."""
    return [(name, title) for title, listed in (*GERMAN.items(), *FRENCH.items(), *SPANISH.items()) for name in listed.split("|")] + [(name, title) for name, title in OTHER_ENGLISH.items() if title]


class Index:
    """Inverted index of character n-grams over the names of the titles."""

    def __init__(self, titles: list[tuple[int, str]], others: list[tuple[str, str]] | None = None):
        ids = {t: i for i, t in titles}
        self.names: list[tuple[list[str], int]] = []
        seen = set()
        for name, title_id in [(t, i) for i, t in titles] + [(n, ids.get(t)) for n, t in (known_names() if others is None else others)]:
            ws = words(name)
            key = tuple(sorted(ws))
            if title_id is not None and ws and (key, title_id) not in seen:
                seen.add((key, title_id))
                self.names.append((ws, title_id))
        self.known = {w for ws, _ in self.names for w in ws}
        self.neighbours: dict[str, list[str]] = defaultdict(list)
        self.stems: dict[str, list[str]] = defaultdict(list)
        for w in sorted(self.known):
            for d in deletes(w) if len(w) > 3 else ():
                self.neighbours[d].append(w)
            if len(w) > 4:
                self.stems[w[:-1]].append(w)
        self.short: dict[str, list[str]] = defaultdict(list)
        for a in sorted(SHORT):
            for d in deletes(a) if len(a) > 2 else ():
                self.short[d].append(a)
        grams = [Counter(self.grams(ws)) for ws, _ in self.names]
        df = Counter(g for c in grams for g in c)
        n = len(grams)
        self.idf = {g: math.log((n + 1) / (d + 0.5)) for g, d in df.items()}
        self.unseen = math.log((n + 1) / 0.5)
        posting: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, c in enumerate(grams):
            norm = math.sqrt(sum((x * self.idf[g]) ** 2 for g, x in c.items())) or 1.0
            for g, x in c.items():
                posting[g].append((k, x * self.idf[g] / norm))
        self.posting = {g: (np.array([k for k, _ in p]), np.array([w for _, w in p])) for g, p in posting.items()}
        self.title_ids = np.array([i for _, i in self.names])

    @staticmethod
    def grams(ws: list[str]) -> list[str]:
        return [f" {w} "[k : k + GRAM] for w in ws for k in range(max(1, len(w) + 3 - GRAM))]

    def scores(self, ws: list[str]) -> np.ndarray:
        total = np.zeros(len(self.names))
        norm = 0.0
        for g, x in Counter(self.grams(ws)).items():
            weight = x * self.idf.get(g, self.unseen)
            norm += weight * weight
            if g in self.posting:
                k, w = self.posting[g]
                total[k] += weight * w
        return total / math.sqrt(norm) if norm else total

    def spellings(self, w: str) -> list[list[str]]:
        """What a word may stand for: known words within one edit, abbreviations within one, the other gender of a known word, or itself; itself first if it is known."""
        close = sorted({x for d in deletes(w) for x in self.neighbours.get(d, ()) if near(w, x) == 1}) if len(w) > 3 else []
        out = [[x] for x in close]
        # a short form is a misspelt word only if it has more than three letters or the same ones
        if w in self.known:
            return [[w], *out]
        out += [SHORT[a].split() for a in sorted({a for d in deletes(w) for a in self.short.get(d, ()) if near(w, a) == 1 and (len(a) > 3 or sorted(a) == sorted(w))})]
        out += [[x] for k in (1, 2, 3) for x in self.stems.get(w[:-k], ()) if len(w) - len(x) in (0, 1, 2) and [x] not in out]
        return [*out, [w]] if out else [[w]]

    def lookup(self, value: str) -> tuple[int, float]:
        """The title meant, or -1, and the score."""
        found = [self._best(words(value))]
        if "-" in plain(value):
            found.append(self._best(words(value, joined=True)))
        title, score, lead = max(found, key=lambda f: f[1])
        return (title, score) if score >= THRESHOLD and lead >= MARGIN else (-1, score)

    def _best(self, ws: list[str]) -> tuple[int, float, float]:
        """The best title, its score and its lead. Of the spellings of a word the one is kept that gives the highest score, word by word."""
        if not ws or not self.names:
            return -1, 0.0, 0.0
        choices = [self.spellings(w) for w in ws]
        chosen = [c[0] for c in choices]
        flat = lambda: [x for c in chosen for x in c]
        best = self._score(flat())
        for k, choice in enumerate(choices):
            for c in choice[1:]:
                before, chosen[k] = chosen[k], c
                score = self._score(flat())
                if score[1] > best[1]:
                    best = score
                else:
                    chosen[k] = before
        return best

    def _score(self, ws: list[str]) -> tuple[int, float, float]:
        s = self.scores(ws)
        k = int(np.argmax(s))
        title, other = int(self.title_ids[k]), s[self.title_ids != self.title_ids[k]]
        return title, float(s[k]), float(s[k] - (other.max() if len(other) else 0.0))


def mapped(values: DataFrame, titles: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """value, title_id, score of each distinct ``value`` (a column); title_id -1 for none. Null values are left out.

    ``names`` has other names of titles as rows (name, title).
    """
    listed = [(int(r[0]), r[1]) for r in titles.select("title_id", "title").where("title_id is not null and title is not null").distinct().limit(MAX_TITLES + 1).collect()]
    others = None if names is None else sorted((r[0], r[1]) for r in names.select("name", "title").where("name is not null and title is not null").distinct().limit(MAX_TITLES + 1).collect())
    if max(len(listed), len(others or ())) > MAX_TITLES:
        raise ValueError("the reference list is too long for a parameter")
    listed.sort()

    @F.pandas_udf("struct<title_id int, score double>")
    def look(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = Index(listed, others)
        for part in parts:
            yield pd.DataFrame([index.lookup(v) for v in part], columns=["title_id", "score"])

    spark = values.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    distinct = values.select("value").where("value is not null").distinct()
    # few bytes, but much work: a stated number of tasks is not coalesced
    return distinct.repartition(tasks, "value").withColumn("hit", look("value")).select("value", "hit.title_id", "hit.score")


def blocks_with_titles(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """block_id, value, title_id, score of each block whose designation is not literally a title."""
    typed = blocks.select("block_id", F.col("entities.designation").alias("value")).where("value is not null")
    literal = titles.select(F.col("title").alias("value")).where("value is not null").distinct()
    typed = typed.join(literal, "value", "left_anti")
    return typed.join(mapped(typed, titles), "value").select("block_id", "value", "title_id", "score")


def found(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    return blocks_with_titles(blocks, titles).select("block_id", "title_id").distinct()


def unmatched(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """The values that belong to no title, and how often each was typed."""
    return blocks_with_titles(blocks, titles).where("title_id = -1").groupBy("value").agg(F.count("*").alias("blocks"), F.max("score").alias("score"))
