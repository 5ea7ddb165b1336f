"""Own word lists, a pack a language, and the dimension tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STOPWORDS = "a an and are as at be but by for from has have he her his i in is it its of on or our she that the their they this to was we were what which with you your".split()
DETECTION = {
    "de": "und der die das ist nicht mit für von den dem ein eine zu auch sich des im auf wird".split(),
    "en": "the and of to in that was with for this is are by from which have".split(),
    "es": "de la el que los las una por con para del se al es su en un".split(),
    "fr": "le les des et la un une est que qui dans pour pas sur au de elle".split(),
}
SCRIPTS = {"hi": "[\\x{0900}-\\x{097F}]", "el": "[\\x{0370}-\\x{03FF}]", "ru": "[\\x{0400}-\\x{04FF}]"}
PRONOUNS = "i me my mine myself we us our ours".split()
VERBS = "achieved analysed built created cut delivered designed developed drove grew improved increased launched led made managed opened planned raised ran reduced saved shipped sold started taught won wrote".split()
PRESENT = "build create cut deliver design develop drive grow improve increase launch lead make manage open plan raise reduce save ship sell start teach win write".split()
AUXILIARIES = "is are was were be been being".split()
PARTICIPLES = "built cut done given grown held known led made paid run seen sent set shown sold taken taught told won written".split()
WEAK = ("responsible for", "worked on", "duties included", "tasked with", "helped with", "in charge of")
BUZZWORDS = ("team player", "hard working", "go getter", "think outside the box", "results driven", "self starter", "detail oriented", "synergy", "dynamic", "passionate")
INJECTION = ("ignore all previous instructions", "ignore previous instructions", "disregard the above", "you are now", "as an ai language model", "rate this candidate", "system prompt")
SYNONYMS = {"js": "javascript", "ts": "typescript", "k8s": "kubernetes", "postgres": "postgresql", "py": "python", "golang": "go"}
PHRASES = ("machine learning", "data science", "project management", "customer service", "public speaking")
IMPLIES = {"django": "python", "react": "javascript", "typescript": "javascript", "kubernetes": "docker", "postgresql": "sql"}
SOFT = ("communication", "leadership", "teamwork", "creativity", "patience")
SKILLS = ("python", "java", "javascript", "typescript", "sql", "docker", "kubernetes", "spark", "excel", "react", "django", "go", "linux", "machine learning", "data science")
HEADINGS = (
    ("experience", "experience|employment|work history|professional background"),
    ("education", "education|studies|qualifications"),
    ("skills", "skills|technologies|tools"),
    ("certifications", "certifications?|licen[cs]es"),
    ("languages", "languages"),
    ("summary", "summary|profile|objective|about me"),
)
POSTING = (
    ("required", "requirements|qualifications|what you bring|must haves?|your profile"),
    ("preferred", "preferred|nice to haves?|bonus"),
    ("responsibilities", "responsibilities|what you will do|the role"),
    ("excluded", "about us|benefits|perks|we offer"),
)
# The weights that a posting's parts and kinds of term carry.
SECTION_WEIGHTS = {"required": 2.0, "preferred": 0.5, "responsibilities": 0.5, "body": 1.0}
GENERAL_WEIGHT, SOFT_WEIGHT = 0.25, 0.4
# Levels of the international classification of education, highest first.
DEGREE_NAMES = ((8, "ph\\.?d|doctorate|doctoral"), (7, "master|m\\.?sc|mba|m\\.?a\\."), (6, "bachelor|b\\.?sc|b\\.?a\\."), (5, "associate degree|foundation degree"), (4, "diploma"), (3, "high school|a-levels|abitur"), (2, "secondary school"))
#: No letter stands before a degree: "schema." names none.
DEGREES = tuple((level, f"(?:^|[^a-z])(?:{names})") for level, names in DEGREE_NAMES)
#: A degree as an asking line writes it, with what belongs to it.
DEGREE = rf"(?i)(?:^|[^a-z])(?:{'|'.join(names for _, names in DEGREE_NAMES)})(?:['’]?s\b)?(?: degree\b)?"
# The common reference levels of language, lowest first.
CEFR = ("A1", "A2", "B1", "B2", "C1", "C2")
LEVEL_WORDS = {"native": "C2", "fluent": "C1", "advanced": "C1", "intermediate": "B1", "conversational": "B1", "basic": "A2", "beginner": "A1"}
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
# (suffix, replacement, least length of the word, ending that forbids it); the first that fits is used.
STEMS = (("ies", "y", 5, ""), ("sses", "ss", 5, ""), ("ing", "", 6, ""), ("ed", "", 5, ""), ("es", "e", 5, ""), ("s", "", 4, "ss"), ("ly", "", 6, ""))
NUMBER_WORDS = {w: i for i, w in enumerate("one two three four five six seven eight nine ten eleven twelve".split(), 1)}
LEAVE = ("parental leave", "maternity leave", "sabbatical", "career break", "sick leave")
# Calling codes of the regions that have rules of their own.
REGIONS = {"US": "1", "GB": "44", "DE": "49", "FR": "33", "ES": "34", "IN": "91", "BR": "55", "PT": "351", "MX": "52", "AU": "61", "JP": "81", "CA": "1"}
# (region, rule, weight or None, severity or None): a weight of 0 drops the rule there.
REGION_RULES = (("DE", "format.photo", 0.0, None), ("JP", "format.photo", 0.0, None), ("DE", "privacy.dateOfBirth", 0.0, None), ("US", "privacy.dateOfBirth", 5.0, "warning"), ("GB", "privacy.dateOfBirth", 5.0, "warning"), ("US", "format.photo", 5.0, "warning"), ("FR", "format.photo", 0.0, None), ("IN", "content.metrics", 8.0, None))


def words_table(spark: SparkSession, words, name: str = "word") -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], f"{name} string")


def pairs_table(spark: SparkSession, pairs, names: str) -> DataFrame:
    return spark.createDataFrame([tuple(p) for p in pairs], names)
