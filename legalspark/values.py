"""Lists, patterns and constants on which results depend. Their order is part of their meaning."""

# --- fixed values: topic filter of listings ---
FILTER_PROFILE = "cyber_law_v1"
TOPIC_PHRASES = (
    "prevention of electronic crimes", "electronic crimes act", "electronic crime", "cyber crime", "cybercrime",
    "cyber-crime", "cyber security", "cybersecurity", "computer crime", "online fraud", "electronic fraud",
    "identity theft", "electronic forgery", "digital forgery", "unauthorized access", "unauthorised access",
    "data theft", "data breach", "hacking", "phishing", "spoofing", "impersonation", "social media",
    "defamation on internet", "online defamation", "information technology", "electronic transaction",
    "cyber crime wing", "cybercrime wing", "cyber wing", "e-fraud", "efraud", "whatsapp", "facebook", "twitter",
    "instagram", "fake account", "morphing", "deepfake", "blackmail online", "sextortion",
)
TOPIC_TOKENS = ("peca", "fia", "otp", "sim", "imei")

# --- fixed values: strict filter of one court's listing ---
STRICT_PHRASES = (
    "cyber crime", "cybercrime", "prevention of electronic crimes", "peca", "electronic crimes act", "electronic crime",
    "cyber terrorism", "cyber stalking", "cyber fraud", "fia cyber",
)

# --- fixed values: full-text scan ---
SCAN_PHRASES = (
    "cyber crime", "cybercrime", "cyber-crime", "prevention of electronic crimes", "peca", "electronic crimes act",
    "electronic crime", "cyber terrorism", "cyber stalking", "cyberstalking", "cyber fraud", "fia cyber", "cyberspace",
    "hacking", "unauthorised access", "unauthorized access", "online harassment", "digital crime", "internet crime",
    "cyber offense", "cyber offence", "section 3 peca", "section 4 peca", "section 9 peca", "section 10 peca",
    "section 11 peca", "section 14 peca", "section 15 peca", "section 16 peca", "section 17 peca", "section 18 peca",
    "section 19 peca", "section 20 peca", "section 21 peca", "section 22 peca", "electronic forgery", "identity theft",
    "data theft", "malicious code", "denial of service", "phishing", "ransomware", "child pornography",
    "obscene material online", "spamming", "spoofing", "cyber extortion", "nccia", "national cyber crime",
    "prevention of electronic crime",
)

# --- fixed values: outcome patterns with weights ---
OUTCOME_MIXED = (
    (r"partially\s+allowed", 4), (r"partly\s+allowed", 4), (r"allowed\s+in\s+part", 4),
    (r"modified\s+the\s+sentence", 3), (r"partial\s+relief", 3),
)
OUTCOME_POSITIVE = (
    (r"petition\s+is\s+allowed", 5), (r"writ\s+petition\s+is\s+allowed", 5),
    (r"this\s+writ\s+petition\s+is\s+allowed", 5), (r"this\s+petition\s+is\s+allowed", 5),
    (r"accordingly,?\s+this\s+writ\s+petition\s+is\s+allowed", 5), (r"\(petition\s+was\s+allowed", 4),
    (r"petition\s+was\s+allowed", 4), (r"impugned\s+notice.*set\s+aside", 4),
    (r"notice\s+.*\s+is\s+hereby\s+set\s+aside", 4), (r"hereby\s+set\s+aside", 3),
    (r"directed\s+to\s+be\s+released\s+on\s+bail", 4), (r"petitioner\s+was\s+granted\s+bail", 4),
    (r"granted\s+bail", 3), (r"appeal\s+is\s+allowed", 3),
)
OUTCOME_NEGATIVE = (
    (r"bail\s+petition.*dismissed", 5), (r"this\s+bail\s+petition.*dismissed", 5), (r"writ\s+petition.*dismissed", 5),
    (r"this\s+writ\s+petition.*dismissed", 5), (r"instant\s+(?:writ\s+)?petition.*dismissed", 4),
    (r"petition\s+having\s+no\s+force.*dismissed", 4), (r"stands\s+dismissed", 3), (r"dismissed\s+in\s+limine", 3),
    (r"bail\s+refused", 4), (r"refused\s+bail", 4), (r"declined\s+to\s+grant\s+bail", 4), (r"declined\s+bail", 3),
    (r"no\s+force.*dismissed", 3),
)

# --- fixed values: classes of questions ---
SPECIFIC_REFERENCES = (
    r"\bsection\s+\d+[A-Z]*\b", r"\barticle\s+\d+[A-Z]*\b", r"\bclause\s+\([a-z0-9]+\)", r"\bpara\s+\d+\b",
    r"\bparagraph\s+\d+\b",
)
COMPLEXITY_INDICATORS = (
    "but", "however", "except", "unless", "whereas", "although", "and also", "as well as", "in addition", "furthermore",
    "what if", "suppose", "in case", "scenario", "both", "either", "neither", "combination",
)
LEGAL_TERMS = (
    "bail", "custody", "prosecution", "defendant", "plaintiff", "evidence", "witness", "testimony", "appeal",
    "jurisdiction", "liability", "damages", "contract", "tort", "statute", "precedent", "ruling", "judgment", "decree",
    "writ",
)
CONDITIONALS = ("if", "when", "where", "whether")
#: complexity: (use_multi_stage, top_k, max_words, description)
STRATEGIES = {
    "simple": (False, 5, 1000, "Direct lookup - fast retrieval"),
    "moderate": (True, 10, 1500, "Balanced retrieval with re-ranking"),
    "complex": (True, 15, 2000, "Comprehensive multi-stage retrieval"),
}

# --- fixed values: greetings ---
GREETINGS = (
    "hello", "hi", "hey", "greetings", "good morning", "good afternoon", "good evening", "assalam o alaikum", "aoa",
    "asalam o alaikum", "salam", "slm", "hi there", "hello there", "how are you", "how are you doing", "what's up",
    "whats up", "hey advisor", "hi advisor",
)
GREETING_BLOCKERS = ("law", "crime", "bail", "peca", "ppc", "court", "judge", "police", "fir", "complaint")

# --- fixed values: evidence checklist ---
DATE_PATTERNS = (r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", r"\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)\b")
CHECKLIST = {
    "Date of Incident": DATE_PATTERNS,
    "Jurisdiction / Location": (r"\b(karachi|lahore|islamabad|peshawar|quetta|pakistan)\b",),
    "CNIC / Identity of Respondent": (r"\b\d{5}-\d{7}-\d\b", r"\bcnic\b"),
    "Proof of Harm / Defamation": (r"\bdefamation\b", r"\bharm\b", r"\bdamage\b", r"\blibel\b"),
    "Witness Statements": (r"\bwitness\b", r"\bstatement\b"),
    "Formal Notice Proof": (r"\blegal notice\b", r"\bformal notice\b", r"\bnotice served\b"),
}

# --- fixed values: documents ---
DOCUMENT_TYPES = {
    "constitution": "Constitution", "penal code": "Penal Code", "pakistan penal code": "Penal Code",
    "prevention of electronic crimes": "Cyber Law", "electronic transactions ordinance": "Ordinance",
    "telecommunication rules": "Rules", "pakistan telecommunication": "Rules",
}
SHORT_LABELS = (
    ("constitution", "Constitution"), ("criminal procedure", "CrPC"), ("penal code", "PPC"), ("qanun-e-shahadat", "QSO"),
    ("civil procedure", "CPC"), ("prevention of electronic crimes", "PECA 2016"),
    ("electronic transactions ordinance", "ETO 2002"), ("telecommunication rules", "Telecom Rules"),
    ("telecom rules", "Telecom Rules"),
)
TITLE_FILES = {
    "Constitution of the Islamic Republic of Pakistan": "Constitution, 1973.pdf",
    "Pakistan Penal Code": "Pakistan Penal Code.pdf",
    "The Electronic Transactions Ordinance, 2002": "The Electronic Transactions Ordinance, 2002.pdf",
    "Pakistan Telecommunication Rules, 2000": "Pakistan Telecom Rules.pdf",
    "The Prevention of Electronic Crimes Act, 2016": "PECA Act, 2016.pdf",
    "Prevention of Electronic Crimes (Amendment) Act, 2025": "PECA Amendment, 2025.pdf",
}
TITLE_STOPWORDS = ("the", "of", "and", "a", "an", "for", "to", "in", "on", "act", "rules", "ordinance", "code")
COURTS = {"lhc": "Lahore High Court", "ihc": "Islamabad High Court", "phc": "Peshawar High Court", "shc": "Sindh High Court"}

# --- fixed values: references and citations ---
REFERENCE_PATTERNS = (
    ("section", r"section\s+(\d+[A-Z]*)"), ("article", r"article\s+(\d+[A-Z]*)"), ("clause", r"clause\s+\(([a-z0-9]+)\)"),
    ("order", r"order\s+([IVXLCDM]+)"),
)
PROVISION_PATTERNS = (
    r"\bSection\s+(\d+[A-Z]*)\b", r"\bSec\.\s+(\d+[A-Z]*)\b", r"\bS\.\s+(\d+[A-Z]*)\b", r"\bArticle\s+(\d+[A-Z]*)\b",
    r"\bArt\.\s+(\d+[A-Z]*)\b", r"\b(\d+)\s+PPC\b", r"\bPPC\s+(\d+)\b", r"\b(\d+)\s+Cr\.?P\.?C\.?\b",
    r"\bCr\.?P\.?C\.?\s+(\d+)\b", r"\bPECA\s+(\d+[A-Z]*)\b",
)
STATUTE_ALIASES = (
    (r"prevention of electronic crimes", "electronic crimes"), (r"pakistan penal code", "penal code"),
    (r"electronic transactions", "electronic transactions"), (r"pakistan telecommunication\w*", "telecommunication"),
    (r"telecommunication\w*", "telecommunication"), (r"\bpeca\b", "electronic crimes"), (r"\bppc\b", "penal code"),
    (r"penal code", "penal code"), (r"\beto\b", "electronic transactions"), (r"\btelecom\b", "telecommunication"),
    (r"\bconstitution\b", "constitution"),
)
STOP_NOUN_PHRASES = (
    "the president", "any person", "such order", "the state", "the court", "any law", "the government", "the authority",
    "the act", "the ordinance", "the federal government", "the provincial government", "any offence", "the chairman",
)
