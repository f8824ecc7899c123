"""Weights, code tables, word lists and patterns of the public feeds.

They decide results, so they are stated here in plain text and used everywhere else by name.
"""

# --- registry codes (fixed values) ---
REGISTRANT_TYPES = {
    "1": "Individual", "2": "Partnership", "3": "Corporation", "4": "Co-Owned",
    "5": "Government", "7": "LLC", "8": "Non-Citizen Corporation", "9": "Non-Citizen Co-Owned",
}
AIRWORTHINESS_CLASSES = {
    "1": "Standard", "2": "Limited", "3": "Restricted", "4": "Experimental", "5": "Provisional",
    "6": "Multiple", "7": "Primary", "8": "Special Flight Permit", "9": "Light Sport",
}
STATUS_CODES = {"V": "Valid", "T": "Valid", "E": "Expired", "R": "Pending", "W": "Revoked"}

# US registration marks: no I or O among the letters (fixed value)
MARK_PATTERN = r"^N(?:[1-9]\d{0,4}|[1-9]\d{0,3}[A-HJ-NP-Z]|[1-9]\d{0,2}[A-HJ-NP-Z]{2})$"

# Maintenance chapters by two-digit code prefix (fixed values)
CHAPTERS = {
    "21": "air conditioning/pressurisation", "22": "auto flight", "24": "electrical power",
    "25": "equipment/furnishings", "27": "flight controls", "28": "fuel system",
    "32": "landing gear", "33": "lights", "34": "navigation", "52": "doors", "53": "fuselage",
    "55": "stabilizers", "57": "wings", "61": "propeller", "71": "powerplant", "72": "engine",
    "73": "engine fuel and control", "74": "ignition", "78": "exhaust", "79": "engine oil",
    "80": "engine starting",
}

# --- word lists (fixed values) ---
NAME_STOPWORDS = [
    "LLC", "INC", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "TRUSTEE", "TRUST", "THE", "OF",
    "AND", "AVIATION", "AIR",
]
MAKE_STOPWORDS = [
    "INC", "CORP", "CORPORATION", "CO", "COMPANY", "LTD", "LLC", "AIRCRAFT", "AVIATION",
    "INDUSTRIES", "AEROSPACE", "THE", "AND", "DESIGN", "GROUP",
]
TASK_STOPWORDS = [
    "the", "and", "for", "with", "that", "can", "current", "find", "get", "retrieve", "return",
    "data", "service",
]

# --- scoring (fixed values) ---
MODULE_WEIGHTS = {  # per cent, in report order
    "registration": 10, "maintenance": 20, "accidents": 20, "adExposure": 15, "utilisation": 10,
    "enforcement": 15, "humanFactors": 5, "airport": 5,
}
MODULE_LABELS = {
    "registration": "Registration complexity", "maintenance": "Maintenance signal",
    "accidents": "Accident/incident signal", "adExposure": "AD exposure",
    "utilisation": "Utilisation signal", "enforcement": "Enforcement/compliance",
    "humanFactors": "Human-factors themes", "airport": "Airport exposure",
}
SCORE_BANDS = [
    (20, "Low public risk signal"),
    (40, "Some review points"),
    (60, "Material due-diligence questions"),
    (80, "High review priority"),
    (100, "Serious public-risk concentration; manual expert review recommended"),
]
SEVERITY_RANK = {"priority": 0, "review": 1, "info": 2}
INJURY_WEIGHT = {"fatal": 45, "serious": 35, "minor": 25, "none": 18}
DAMAGE_WEIGHT = {"destroyed": 15, "substantial": 10, "minor": 5, "none": 0}
COST_WEIGHT = {"high": 12, "medium": 7, "low": 3}
ACTION_WEIGHT = {"revocation": 40, "suspension": 25, "civil_penalty": 15}

# Cause themes, in report order (fixed values)
CAUSE_THEMES = [
    (r"(?i)loss of (directional )?control.*landing|landing.*loss of control|ground ?loop",
     "loss of control on landing"),
    (r"(?i)gear (collapse|extension|retract)|landing gear", "landing-gear events"),
    (r"(?i)fuel (exhaustion|starvation|contamination)", "fuel management"),
    (r"(?i)engine (failure|power loss)|power ?loss", "engine power loss"),
    (r"(?i)carburetor|carb ice", "carburetor icing"),
    (r"(?i)weather|vfr into imc|instrument meteorological", "weather decision-making"),
    (r"(?i)stall|spin", "aerodynamic stall"),
]

# Enforcement categories; the first rule that hits wins (fixed values)
CATEGORY_RULES = [
    (r"(?i)maintenance|inspection|airworth|repair|return to service|record|logbook", "maintenance"),
    (r"(?i)drug|alcohol|testing", "drug_testing"),
    (r"(?i)hazmat|hazardous material|dangerous good", "hazmat"),
    (r"(?i)duty time|flight time|rest|fatigue|operational|part ?135|part ?121|dispatch",
     "operational"),
]

# --- quality (fixed values) ---
CHECK_DIMENSION = {
    "status": "availability", "json": "availability", "max_latency": "availability",
    "min_rows": "completeness", "unique_field": "completeness", "fields_present": "schema",
    "field_pattern": "join_keys", "value_range": "schema", "known_answer": "task",
    "freshness": "freshness",
}
# rule names, then the rules of each policy (fixed values)
POLICY_RULES = ["maximum_receipt_age_minutes", "minimum_consecutive_passes", "minimum_success_rate_30d",
                "minimum_confidence", "allow_experimental_sources"]
POLICIES = {
    "production": {"maximum_receipt_age_minutes": 1440, "minimum_consecutive_passes": 3,
                   "minimum_success_rate_30d": 0.9, "minimum_confidence": 0.9,
                   "allow_experimental_sources": False},
    "standard": {"maximum_receipt_age_minutes": 2880, "minimum_consecutive_passes": 1,
                 "minimum_confidence": 0.75, "allow_experimental_sources": True},
    "permissive": {"allow_experimental_sources": True},
}
DEFAULT_TTL_HOURS = 6
SAMPLE_CHARS = 16 * 1024

# --- carrier decisions (fixed values) ---
DECISION_LOWER = "Lower observed concern"
DECISION_VERIFY = "Manual verification required"
DECISION_ELEVATED = "Elevated observed concern"
DECISION_STOP = "Do not proceed until discrepancies are resolved"
NATIONAL_VEHICLE_OOS = 20
NATIONAL_DRIVER_OOS = 5

# --- session badges (fixed values) ---
LINES_YELLOW, LINES_RED = 300, 500
IMPORTS_YELLOW, IMPORTS_RED = 15, 25
EXPORTS_YELLOW = 10
FLAT_FILES = 15
DEEP_SEGMENTS = 5

# Wording that must never appear in generated text (fixed value)
BANNED_WORDING = (
    r"(?i)\b(un)?safe\b|\bairworthy\b|\bdangerous aircraft\b|\bbad operator\b|\bnon-compliant\b"
)
