"""Word lists, labels and thresholds that results depend on."""

# ---- fixed values: keyword lexicon -------------------------------------------------------------
KEYWORDS = (
    "excel", "word", "powerpoint", "outlook", "microsoft office", "google sheets", "google docs",
    "tableau", "power bi",
    "sql", "mysql", "postgresql", "data analysis", "data analytics", "machine learning",
    "artificial intelligence", "generative ai", "genai", "aws", "azure", "gcp", "google cloud",
    "enterprise architecture", "systems architecture", "security", "tokenisation", "tokenization",
    "defi", "web3", "automation", "fintech",
    "human resources", "hr", "recruitment", "payroll", "performance management",
    "labour law", "employment equity", "organisational development", "training and development",
    "onboarding", "talent management", "succession planning",
    "accounting", "bookkeeping", "financial reporting", "budgeting", "forecasting",
    "ifrs", "gaap", "tax", "auditing", "cost accounting", "management accounting",
    "communication", "project management", "leadership", "teamwork", "problem solving",
    "critical thinking", "time management", "customer service", "negotiation",
    "presentation", "stakeholder management", "change management",
    "technical leadership", "mentorship", "technical strategy", "vendor evaluation",
    "procurement", "proof of concept", "agile", "safe", "pmp", "togaf", "cissp",
    "digital marketing", "seo", "social media", "content creation", "google analytics",
    "email marketing", "crm", "salesforce",
    "mathematics", "statistics", "quantitative analysis", "numeracy", "financial modelling",
)

# ---- fixed values: terms never reported as business skills -------------------------------------
EXCLUDED_TERMS = (
    "algorithms", "c#", "c++", "ci cd", "ci/cd", "cloud native", "cloud-native", "css",
    "data engineering", "data science", "databases", "devops", "django", "distributed systems",
    "encryption", "f#", "flask", "go", "go programming language", "golang", "haskell", "html",
    "j2ee", "java", "javascript", "kotlin", "kubernetes", "mainframe", "python", "r", "rust",
    "scala", "site reliability engineering", "software engineering", "sre",
    "technical architecture", "typescript", "z/os",
)

# ---- fixed values: surface forms of canonical skills -------------------------------------------
ALIASES = {
    "artificial intelligence": ("ai", "generative ai", "gen ai"),
    "business intelligence": ("bi", "business intelligence", "dashboards", "dashboarding"),
    "communication": ("written communication", "verbal communication", "interpersonal communication"),
    "crm": ("customer relationship management",),
    "data analysis": ("data analyst", "analytical skills", "analysis"),
    "data analytics": ("analytics", "data insights", "insight generation"),
    "financial modelling": ("financial modeling", "financial models"),
    "google analytics": ("ga4", "google analytics 4"),
    "human resources": ("human resource management", "people management"),
    "machine learning": ("ml", "predictive modelling", "predictive modeling"),
    "microsoft office": ("ms office", "office suite"),
    "power bi": ("powerbi", "power-bi", "business intelligence dashboards"),
    "problem solving": ("troubleshooting", "analytical problem solving"),
    "project management": ("programme management", "program management"),
    "sql": ("t-sql", "sql server", "structured query language"),
    "stakeholder management": ("stakeholder engagement", "stakeholder relations"),
    "tableau": ("tableau dashboards",),
    "training and development": ("learning and development", "l&d"),
}

# ---- fixed values: phrase heads that make a mined phrase a skill -------------------------------
HEAD_TERMS = (
    "accounting", "analysis", "analytics", "auditing", "budgeting", "communication",
    "compliance", "dashboard", "dashboards", "development", "forecasting", "leadership",
    "management", "marketing", "modelling", "modeling", "payroll", "programming",
    "recruitment", "reporting", "sales", "service", "statistics", "training",
)

# ---- fixed values: vocabularies of the skill classifier ----------------------------------------
TECHNICAL_TERMS = (
    "ai", "algorithm", "algorithms", "analytics", "api", "architecture", "automation",
    "azure", "aws", "bi", "cloud", "code", "coding", "css", "dashboard", "data",
    "database", "databases", "devops", "django", "engineering", "excel", "flask",
    "gcp", "html", "java", "javascript", "kubernetes", "machine", "model",
    "modelling", "modeling", "power", "programming", "python", "r", "reporting",
    "science", "security", "software", "sql", "systems", "tableau", "technical",
    "technology", "typescript",
)
SOFT_TERMS = (
    "adaptability", "collaboration", "communication", "creative", "critical",
    "emotional", "empathy", "influence", "influencing", "interpersonal", "leadership",
    "mentorship", "negotiation", "presentation", "problem", "relationship",
    "stakeholder", "team", "teamwork", "time",
)
BUSINESS_TERMS = (
    "accounting", "auditing", "budgeting", "change", "commercial", "compliance",
    "customer", "finance", "financial", "forecasting", "governance", "hr",
    "human", "ifrs", "labour", "management", "marketing", "operations", "payroll",
    "procurement", "recruitment", "risk", "sales", "service", "strategy", "tax",
    "training", "vendor",
)
TOOL_TERMS = (
    "aws", "azure", "bi", "c#", "c++", "css", "django", "excel", "gcp", "html",
    "java", "javascript", "kubernetes", "power", "python", "r", "salesforce",
    "sql", "tableau", "typescript",
)
METHOD_TERMS = (
    "agile", "analysis", "analytics", "auditing", "forecasting", "management",
    "modelling", "modeling", "reporting", "research", "strategy", "testing",
)

# ---- fixed values: business refinement ---------------------------------------------------------
REFINE_DROP = (
    "c++", "c#", "f#", "rust", "haskell", "go", "scala", "kotlin", "java", "javascript",
    "typescript", "html", "css", "django", "flask", "j2ee", "z/os", "mainframe", "kubernetes",
    "devops", "ci cd", "ci/cd", "sre", "site reliability engineering", "distributed systems",
    "algorithms", "encryption", "tokenisation", "tokenization",
)
REFINE_LABELS = {
    "data analysis": "business analytics",
    "data analytics": "business analytics",
    "data science": "business analytics",
    "sql": "data-driven decision making",
    "mysql": "data-driven decision making",
    "postgresql": "data-driven decision making",
    "databases": "data governance",
    "python": "analytics automation",
    "r": "analytics automation",
    "machine learning": "AI strategy",
    "artificial intelligence": "AI strategy",
    "generative ai": "AI strategy",
    "genai": "AI strategy",
    "software engineering": "digital transformation",
    "technical architecture": "digital transformation",
    "enterprise architecture": "digital transformation",
    "systems architecture": "digital transformation",
    "cloud native": "digital transformation",
    "cloud-native": "digital transformation",
    "aws": "digital transformation",
    "azure": "digital transformation",
    "gcp": "digital transformation",
    "google cloud": "digital transformation",
    "security": "digital risk governance",
    "web3": "digital transformation",
    "defi": "fintech strategy",
    "fintech": "fintech strategy",
    "automation": "process automation",
    "technical leadership": "digital leadership",
    "technical strategy": "digital strategy",
    "vendor evaluation": "vendor management",
}

# ---- fixed values: sectors ---------------------------------------------------------------------
MISSING_SECTORS = ("", "unclassified", "unknown", "none", "n/a", "na", "other")
SECTOR_KEYWORDS = {
    "Cybersecurity and Risk": (
        "cyber", "cybersecurity", "security", "risk", "governance", "compliance",
        "fraud", "audit", "controls", "privacy", "information security",
    ),
    "Finance and Accounting": (
        "finance", "financial", "accounting", "accountant", "tax", "treasury",
        "investment", "banking", "insurance", "fintech", "payroll", "budget",
    ),
    "Technology and Data": (
        "data", "analytics", "analysis", "ai", "artificial intelligence",
        "machine learning", "software", "developer", "engineering", "cloud",
        "python", "sql", "database", "digital", "automation", "tableau",
        "power bi", "business intelligence",
    ),
    "Human Resources and Talent": (
        "human resources", "hr", "talent", "recruitment", "recruiter",
        "learning and development", "training", "people", "workforce",
    ),
    "Marketing and Sales": (
        "marketing", "sales", "brand", "customer", "crm", "market research",
        "commercial", "business development", "advertising", "media",
    ),
    "Operations and Supply Chain": (
        "operations", "supply chain", "logistics", "procurement", "warehouse",
        "manufacturing", "production", "process", "quality", "inventory",
    ),
    "Strategy and Management": (
        "strategy", "strategic", "management", "manager", "leadership",
        "consulting", "project management", "change management", "stakeholder",
        "executive", "mba",
    ),
    "Education and Curriculum": (
        "course", "curriculum", "module", "teaching", "education", "learning",
        "academic", "university", "programme", "program",
    ),
}

# ---- fixed values: stop words ------------------------------------------------------------------
SKILL_STOP_WORDS = ("and", "the", "for", "with", "of", "in", "to", "a", "an")
RETRIEVAL_STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "based", "by", "for", "from",
    "have", "how", "i", "in", "is", "it", "of", "on", "or", "our", "show",
    "that", "the", "there", "this", "to", "us", "using", "what", "which",
    "with", "you",
)

# ---- fixed values: advert labels ---------------------------------------------------------------
SECTION_LABELS = {
    "summary": ("summary", "job summary"),
    "position_info": (
        "position info", "position information", "key responsibilities", "qualifications",
        "preferred knowledge and experience",
    ),
}
METADATA_LABELS = {
    "recruiter": ("recruiter", "agency", "consultant"),
    "job_reference": ("job ref", "job reference", "reference", "ref"),
    "date_posted": ("date posted", "posted", "posted date"),
    "location": ("location",),
}

# ---- fixed values: crawled pages ---------------------------------------------------------------
PAGE_TERMS = ("mba", "master", "business-administration", "programme", "programmes", "curriculum", "module")
URL_TERMS = (
    "mba", "master", "business-administration", "programme", "programmes", "program", "programs",
    "course", "courses", "curriculum", "module",
)
MODULE_HINTS = ("module", "course", "curriculum", "core", "elective", "learning outcome", "credits", "nqf")
MODULE_TOPICS = ("management", "finance", "strategy", "leadership", "analytics", "marketing", "operations")

# ---- fixed values: scores ----------------------------------------------------------------------
WEIGHTS = {"semantic": 0.55, "skill": 0.20, "confidence": 0.15, "policy": 0.10}
SCORE_BANDS = ("0-20", "20-40", "40-60", "60-80", "80-100")
MISMATCH_THRESHOLD = 55
TOP_MODULES = 3
