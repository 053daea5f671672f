"""Word lists and patterns that steer parsing and tagging.

Every operator takes these as a parameter, so that a caller can bring other
lists. The defaults below are fixed values: results depend on them word by word.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

# ---------------------------------------------------------------- fixed values
QUALIFICATION_HEADERS = (
    "requirements", "qualifications", "required qualifications", "must have", "required skills",
    "minimum qualifications", "what you need", "what we need", "you have",
)

RESPONSIBILITY_HEADERS = (
    "responsibilities", "you will", "duties", "day-to-day", "what you'll do", "the role",
    "your role", "daily tasks",
)

BONUS_WORDS = ("preferred", "nice to have", "bonus", "plus", "asset", "ideal")

SOFT_SKILLS = (
    "communication", "leadership", "teamwork", "collaboration", "problem solving",
    "critical thinking", "analytical", "detail-oriented", "organized", "self-motivated",
    "interpersonal", "presentation", "written", "verbal",
)

OWNERSHIP = {
    "manage": ("manage", "lead", "drive", "own", "direct", "oversee"),
    "lead": ("develop", "build", "create", "design", "implement", "establish"),
    "support": ("support", "assist", "help", "contribute", "collaborate"),
    "assist": ("maintain", "monitor", "review", "participate"),
}

FREQUENCY = {
    "daily": ("daily", "day-to-day", "regularly", "routine", "ongoing"),
    "weekly": ("weekly", "bi-weekly", "biweekly"),
    "regularly": ("frequently", "often", "continuous"),
    "ad-hoc": ("ad-hoc", "as needed", "occasional", "periodic", "from time to time"),
}

ACTIVITY_DOMAINS = {
    "Data Engineering": (
        "pipeline", "etl", "elt", "ingest", "data warehouse", "data lake", "spark", "airflow",
    ),
    "Data Visualization": (
        "dashboard", "visualization", "power bi", "tableau", "report", "visual",
    ),
    "Analytics": ("analysis", "analyze", "metric", "kpi", "insight", "trend", "statistical"),
    "Data Science": ("machine learning", "model", "algorithm", "prediction", "ml", "ai"),
    "Database Management": ("database", "sql", "query", "optimization", "schema", "index"),
    "Data Governance": ("quality", "governance", "compliance", "security", "privacy", "gdpr"),
}

TAG_DOMAINS = {
    **ACTIVITY_DOMAINS,
    "Data Visualization": (*ACTIVITY_DOMAINS["Data Visualization"], "bi"),
    "Data Science": (*ACTIVITY_DOMAINS["Data Science"], "deep learning"),
    "Database Management": (*ACTIVITY_DOMAINS["Database Management"], "rdbms"),
    "Cloud Computing": ("azure", "aws", "gcp", "cloud", "saas", "paas", "iaas"),
    "Business Intelligence": (
        "bi", "business intelligence", "reporting", "power bi", "tableau", "looker",
    ),
}

POSTING_SKILLS = (
    "python", "sql", "r", "java", "javascript", "c#", "c++", "power bi", "tableau", "excel",
    "looker", "qlik", "azure", "aws", "gcp", "cloud", "spark", "hadoop", "kafka", "airflow",
    "pandas", "numpy", "scikit-learn", "tensorflow", "pytorch", "git", "docker", "kubernetes",
    "etl", "elt", "api", "rest", "machine learning", "deep learning", "nlp", "ai", "statistics",
    "mathematics", "modeling",
)

PROFILE_SKILLS = (
    "python", "sql", "r", "java", "javascript", "c#", "power bi", "tableau", "excel", "looker",
    "azure", "aws", "gcp", "spark", "hadoop", "airflow", "pandas", "numpy", "scikit-learn", "git",
    "docker", "kubernetes", "machine learning", "deep learning", "nlp", "etl", "api", "rest",
)

ENTITY_SKILL_MARKS = ("sql", "python", "azure", "aws", "bi")
ENTITY_SKILL_LABELS = ("PRODUCT", "ORG", "GPE")
ENTITY_LABELS = ("ORG", "PRODUCT", "GPE", "PERSON")

QUALIFICATION_PATTERNS = (
    r"what you(?:'ll| will)?\s+(?:bring|need|have)\b",
    r"\b(?:requirements?|qualifications?)\b",
    r"(?:required|minimum)\s+(?:skills?|qualifications?)\b",
    r"you\s+(?:bring|have|need)\b",
    r"(?:preferred|desired)\s+(?:skills?|qualifications?)\b",
    r"(?:must haves?|nice to haves?)\b",
    r"skills?\s+(?:and|&)\s+(?:qualifications?|experience)\b",
)

RESPONSIBILITY_PATTERNS = (
    r"\b(?:responsibilities|duties)\b",
    r"what you(?:'ll| will)\s+do\b",
    r"(?:your role|the role|day[- ]to[- ]day)\b",
    r"you will\s+(?:be\s+)?responsible\b",
    r"in this\s+(?:role|position)\b",
    r"key\s+responsibilities\b",
)

BOILERPLATE_PATTERNS = (
    r"equal\s+(?:opportunity|employment).{0,500}",
    r"we are committed to.{0,300}diversity",
    r"(?:to apply|application process).{0,200}",
    r"benefits?.{0,500}(?:medical|dental|401k)",
    r"(?:compensation|salary)\s+(?:range|information)",
)

SECTION_TOP_N = {
    "Summary": 1, "TechnicalSkills": 1, "Projects": 3, "ProfessionalExperience": 3,
    "Education": 2, "Certifications": 1,
}

SCORE_WEIGHTS = {
    "overall_similarity": 0.40, "required_match": 0.30, "responsibility_alignment": 0.20,
    "bonus_match": 0.10,
}

FIT_THRESHOLD = 0.70
NATURAL_KEY = ("company", "job_title", "date_posted")
STORED_TEXT_CHARS = 500
CONTEXT_CHARS = 200
MIN_SUMMARY_CHARS = 50
# ---------------------------------------------------------- end of fixed values

# Small starter lexicons of our own for tagging without a trained model. A caller
# with a real gazetteer passes a table instead.
STARTER_ENTITIES = {
    "Microsoft": "ORG", "Google": "ORG", "Amazon": "ORG", "Apache": "ORG", "Oracle": "ORG",
    "Azure": "PRODUCT", "AWS": "PRODUCT", "Power BI": "PRODUCT", "SQL Server": "PRODUCT",
    "Python": "PRODUCT", "MySQL": "PRODUCT", "PostgreSQL": "PRODUCT", "BigQuery": "PRODUCT",
    "Canada": "GPE", "London": "GPE", "Paris": "GPE", "Berlin": "GPE", "New York": "GPE",
}

STARTER_VERBS = (
    "analyze", "assist", "build", "collaborate", "communicate", "contribute", "coordinate",
    "create", "define", "deliver", "deploy", "design", "develop", "document", "drive", "ensure",
    "establish", "evaluate", "help", "identify", "implement", "improve", "lead", "maintain",
    "manage", "monitor", "optimize", "oversee", "participate", "perform", "prepare", "present",
    "provide", "report", "review", "support", "test", "train", "translate", "work",
)

STARTER_IRREGULAR_FORMS = {"built": "build", "led": "lead", "drove": "drive", "driven": "drive",
                           "oversaw": "oversee", "overseen": "oversee"}


def verb_forms(lemmas: Sequence[str] = STARTER_VERBS,
               irregular: Mapping[str, str] = STARTER_IRREGULAR_FORMS) -> dict[str, str]:
    """Regular inflected forms (third person, past, gerund) of each lemma, plus irregular ones."""
    forms: dict[str, str] = {}
    for lemma in lemmas:
        if lemma.endswith("e"):
            inflected = (lemma + "s", lemma + "d", lemma[:-1] + "ing")
        elif lemma.endswith("y") and lemma[-2] not in "aeiou":
            inflected = (lemma[:-1] + "ies", lemma[:-1] + "ied", lemma + "ing")
        else:
            inflected = (lemma + "s", lemma + "ed", lemma + "ing")
        for form in (lemma, *inflected):
            forms.setdefault(form, lemma)
    forms.update(irregular)
    return forms


# For verbs that no list has: gerunds and past forms are cut by the first rule whose test they pass
# (test, what is cut off, what is put in its place). The exceptions come first; null is no verb.
VERB_RULES = (
    (r"(?:bb|dd|gg|kk|mm|nn|pp|rr|tt)(?:ing|ed)$", r".(?:ing|ed)$", ""),
    (r"[^aeiou]ied$", r"ied$", "y"),
    (r"(?:at|iz|is|uc|ag|rg|dg|iv|lv|rv|ov|as|us|ur|ir|qu|ib|ud|ut|bl|pl|tl|gl|dl|c)(?:ing|ed)$", r"(?:ing|ed)$", "e"),
    (r"(?:ing|ed)$", r"(?:ing|ed)$", ""),
)
VERB_EXCEPTIONS = {
    "being": "be", "having": "have", "doing": "do", "going": "go", "making": "make", "taking": "take", "writing": "write", "using": "use",
    "used": "use", "scaling": "scale", "scaled": "scale", "need": "need", "feed": "feed", "thing": None, "nothing": None, "something": None,
    "anything": None, "everything": None, "during": None, "morning": None, "evening": None, "according": None, "hundred": None, "speed": None,
    "seed": None, "indeed": None, "spring": None, "string": None, "ceiling": None,
}


@dataclass(frozen=True)
class Lexicon:
    """All word lists used while parsing and tagging one corpus."""

    qualification_headers: Sequence[str] = QUALIFICATION_HEADERS
    responsibility_headers: Sequence[str] = RESPONSIBILITY_HEADERS
    qualification_patterns: Sequence[str] = QUALIFICATION_PATTERNS
    responsibility_patterns: Sequence[str] = RESPONSIBILITY_PATTERNS
    bonus_words: Sequence[str] = BONUS_WORDS
    soft_skills: Sequence[str] = SOFT_SKILLS
    ownership: Mapping[str, Sequence[str]] = field(default_factory=lambda: OWNERSHIP)
    frequency: Mapping[str, Sequence[str]] = field(default_factory=lambda: FREQUENCY)
    activity_domains: Mapping[str, Sequence[str]] = field(default_factory=lambda: ACTIVITY_DOMAINS)
    tag_domains: Mapping[str, Sequence[str]] = field(default_factory=lambda: TAG_DOMAINS)
    posting_skills: Sequence[str] = POSTING_SKILLS
    profile_skills: Sequence[str] = PROFILE_SKILLS
    entities: Mapping[str, str] = field(default_factory=lambda: STARTER_ENTITIES)
    verbs: Mapping[str, str] = field(default_factory=verb_forms)
    entity_skill_marks: Sequence[str] = ENTITY_SKILL_MARKS
    #: Whether gerunds and past forms of verbs that the list lacks count too.
    guess_verbs: bool = False


DEFAULT_LEXICON = Lexicon()


def validate_weights(weights: Mapping[str, float]) -> Mapping[str, float]:
    """Composite weights must sum to 1 within 0.01."""
    total = sum(weights.values())
    if not 0.99 <= total <= 1.01:
        raise ValueError(f"score weights must sum to 1.0, got {total}")
    return weights
