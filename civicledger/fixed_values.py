"""Names, lists, thresholds and sentences that results must carry verbatim."""

# --- Fixed values: status and tier vocabulary -------------------------------------------
PROJECT_STATUSES = ["Recommended", "Sanctioned", "Work Order Issued", "In Progress",
                    "Completed", "Cancelled", "Stalled"]
MILESTONES = ["On Track", "Delayed", "Critical", "Completed"]
STAGES = ["Feasibility", "Tendering", "Contract Awarded", "Foundation", "Structure",
          "Finishing", "Inspection", "Commissioned", "Completed"]
STORED_TIERS = ["Low", "Moderate", "High", "Critical"]
ENGINE_TIERS = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
HISTORY_EVENTS = ["Created", "Sanctioned", "Tender Floated", "Work Order Issued", "Fund Disbursed",
                  "Milestone Reached", "Inspection Passed", "Delay Flagged", "Cost Revised",
                  "Completed", "Cancelled", "Status Changed"]
FACTOR_CATEGORIES = ["Agency Past Performance", "Delay in Tendering", "Budget Gap",
                     "Slow Physical Pace", "Monsoon Seasonality", "Geographic Remoteness",
                     "Land Dispute", "Contractor Inaction", "Other"]
HOUSES = ["Lok Sabha", "Rajya Sabha"]

# --- Fixed values: cleaning -------------------------------------------------------------
UNION_TERRITORY_WORDS = ["islands", "chandigarh", "delhi", "haveli", "ladakh", "lakshadweep",
                         "puducherry", "jammu and kashmir"]
CURRENCY_WORDS = "crores?|cr|lakhs?|inr|rs\\.?|₹"
NULL_DATE_WORDS = ["none", "null", "nat", "nan", "n/a", "-", "undefined"]
STATUTORY_SC_PCT = 15.0
STATUTORY_ST_PCT = 7.5
MAJOR_HEAD = 3475

STATE_CODES = {
    "Andhra Pradesh": "IN-AP", "Arunachal Pradesh": "IN-AR", "Assam": "IN-AS", "Bihar": "IN-BR",
    "Chhattisgarh": "IN-CT", "Goa": "IN-GA", "Gujarat": "IN-GJ", "Haryana": "IN-HR",
    "Himachal Pradesh": "IN-HP", "Jharkhand": "IN-JH", "Karnataka": "IN-KA", "Kerala": "IN-KL",
    "Madhya Pradesh": "IN-MP", "Maharashtra": "IN-MH", "Manipur": "IN-MN", "Meghalaya": "IN-ML",
    "Mizoram": "IN-MZ", "Nagaland": "IN-NL", "Odisha": "IN-OR", "Punjab": "IN-PB",
    "Rajasthan": "IN-RJ", "Sikkim": "IN-SK", "Tamil Nadu": "IN-TN", "Telangana": "IN-TG",
    "Tripura": "IN-TR", "Uttar Pradesh": "IN-UP", "Uttarakhand": "IN-UT", "West Bengal": "IN-WB",
    "Andaman and Nicobar Islands": "IN-AN", "Chandigarh": "IN-CH",
    "Dadra and Nagar Haveli and Daman and Diu": "IN-DH", "Delhi": "IN-DL",
    "Jammu and Kashmir": "IN-JK", "Ladakh": "IN-LA", "Lakshadweep": "IN-LD", "Puducherry": "IN-PY",
}

# --- Fixed values: phrases removed before duplicate comparison ---------------------------
BOILERPLATE = ["construction of", "installation of", "provision of", "renovation of",
               "development of", "work of", "under mplads", "mplads scheme", "improvement of",
               "supply and installation of", "execution of", "establishment of", "supply of",
               "erection of", "commissioning of"]
BOILERPLATE_V1 = BOILERPLATE[:10]

# --- Fixed values: risk configuration ----------------------------------------------------
ENGINES = ["cost_anomaly", "duplicate_detection", "delay_detection", "progress_mismatch",
           "agency_pattern"]
ENGINE_WEIGHTS = {e: 0.20 for e in ENGINES}
TIER_BOUNDS = [(30.0, "LOW"), (60.0, "MEDIUM"), (80.0, "HIGH"), (100.1, "CRITICAL")]
CONFIDENCE_BOUNDS = [(0.85, "HIGH"), (0.60, "MEDIUM"), (0.30, "LOW")]
MIN_PEERS = 2
DELAY_DAYS = (30, 90, 180, 365)
MISMATCH_GAPS = (10.0, 20.0, 35.0, 50.0)
DUPLICATE_LOW, DUPLICATE_POSSIBLE, DUPLICATE_STRONG = 0.60, 0.75, 0.88
AGENCY_MIN_PROJECTS = 3
AGENCY_DELAY_RATE, AGENCY_COST_RATE, AGENCY_MISMATCH_RATE = 0.50, 0.30, 0.30

CLOSED_STATUSES = ["completed", "physically complete", "closed"]
STALLED_STATUSES = ["stalled", "stopped", "held up", "pending approval"]
CANCELLED_STATUSES = ["cancelled", "dropped", "rejected"]
PREWORK_STATUSES = ["recommended", "sanctioned", "tender floated"]
EARLY_STATUSES = ["work order issued", "proposed", "sanctioned", "recommended", "approved", "pending"]

ENGINE_CATEGORY = {"cost_anomaly": "Budget Gap", "delay_detection": "Delay in Tendering",
                   "progress_mismatch": "Slow Physical Pace", "duplicate_detection": "Other",
                   "agency_pattern": "Agency Past Performance", "explained_risk": "Other"}
ENGINE_TITLE = {"cost_anomaly": "Cost Anomaly Detection",
                "duplicate_detection": "Duplicate Project Detection",
                "delay_detection": "Project Delay Detection",
                "progress_mismatch": "Progress Mismatch Detection",
                "agency_pattern": "Agency Pattern Analysis",
                "explained_risk": "Explained Risk Assessment"}
ENGINE_SHORT = {"cost_anomaly": "Cost Anomaly", "delay_detection": "Delay",
                "progress_mismatch": "Progress Mismatch", "agency_pattern": "Agency Pattern",
                "duplicate_detection": "Duplicate", "explained_risk": "Explained"}
SUMMARY_WORDS = {"cost_anomaly": "cost anomaly", "delay_detection": "delay",
                 "progress_mismatch": "progress mismatch",
                 "duplicate_detection": "duplicate similarity", "agency_pattern": "agency friction"}

# --- Fixed values: evidence keys kept per engine ------------------------------------------
EVIDENCE_KEYS = {
    "cost_anomaly": ["sanctioned_amount", "cost", "peer_median", "peer_mean", "deviation",
                     "deviation_pct", "cost_ratio", "peer_group", "sample_size"],
    "duplicate_detection": ["matched_project_id", "similarity", "match_confidence",
                            "category_match", "location_match", "description_preview"],
    "delay_detection": ["overdue_days", "delay_percentage", "status", "sanction_date",
                        "expected_completion_date", "actual_completion_date",
                        "planned_duration_days"],
    "progress_mismatch": ["financial_progress", "physical_progress", "progress_gap",
                          "sanctioned_amount", "expenditure"],
    "agency_pattern": ["agency_name", "projects_analyzed", "delay_rate", "cost_anomaly_rate",
                       "mismatch_rate", "historical_sample_size"],
}
FORBIDDEN_WORDS = ["fraud", "corrupt", "manipulation", "wrongdoing"]

# --- Fixed values: sentences of the explanation layer --------------------------------------
NOTHING_FLAGGED = ("No significant risk factors were detected based on the configured "
                   "detection thresholds.")
ROUTINE_MONITORING = ("Continue standard periodic administrative monitoring; no prioritized field "
                      "inspection required at this time.")
ROUTINE_TRACKING = ("Continue routine quarterly milestone tracking and maintain regular "
                    "monitoring reports.")
LOW_BAND_REASON = {
    "cost_anomaly": "Sanctioned cost aligns within expected peer group distribution.",
    "duplicate_detection":
        "No significant textual overlap or duplicate characteristics identified.",
    "delay_detection": "Project milestones and timeline are progressing on schedule.",
    "progress_mismatch":
        "Financial utilization aligns closely with verified physical progress.",
    "agency_pattern":
        "Historical agency performance metrics are consistent with standard benchmarks.",
}
INITIAL_SNAPSHOT = "Initial baseline project snapshot recorded upon first ingestion."
NO_CHANGE = "No meaningful project changes detected within numeric tolerance thresholds."
TRIAGE_STATUS = "Under Review by District Nodal Officer"

# --- Fixed values: feature contract (name, type, leakage context, min, max, imputation) ------
FEATURE_CONTRACT = [
    ("delay_days", "int", "in_flight", -365.0, 1825.0, "0"),
    ("utilization_ratio", "float", "in_flight", 0.0, 2.0, "0.0"),
    ("cost_per_category", "float", "pre_award", 10000.0, 50000000.0, "overall median"),
    ("progress_gap", "float", "in_flight", -100.0, 100.0, "0.0"),
    ("cost_deviation", "float", "in_flight", -50000000.0, 50000000.0, "0.0"),
    ("project_duration", "int", "in_flight", 1.0, 3650.0, "elapsed duration"),
    ("cost_relative_to_category", "float", "pre_award", 0.1, 10.0, "1.0"),
    ("sanction_sla_delay_days", "int", "pre_award", 0.0, 1000.0, "0"),
    ("progress_gap_fin_phy", "float", "in_flight", -100.0, 100.0, "0.0"),
    ("unreleased_allocation", "float", "in_flight", 0.0, 50000000.0, "0.0"),
    ("planned_duration_days", "int", "pre_award", 15.0, 1825.0, "sector median"),
]

# --- Fixed values: search ------------------------------------------------------------------
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it",
              "of", "on", "or", "that", "the", "this", "to", "was", "with"]

# The English stop list of full-text search.
ENGLISH_STOP_WORDS = [
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves",
    "he", "him", "his", "himself", "she", "her", "hers", "herself", "it", "its", "itself", "they", "them", "their",
    "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are", "was",
    "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and",
    "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off",
    "over", "under", "again", "further", "then", "once", "here", "there", "when", "where", "why", "how", "all", "any",
    "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so",
    "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now"]

# The published English (Porter2) suffix rules: suffix -> ways (region of the word, pattern of what stands before,
# replacement), first one that holds; of several suffixes the longest counts. "!" in front negates a pattern.
ENGLISH_WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli",
    "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas",
    "cosmos": "cosmos", "bias": "bias", "andes": "andes"}
ENGLISH_LEFT_AFTER_PLURALS = ["inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"]
ENGLISH_LONG_PREFIXES = ["gener", "commun", "arsen"]
ENGLISH_SHORT_SYLLABLE = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"
ENGLISH_PLURALS = {"sses": [(0, "", "ss")], "ied": [(0, "..", "i"), (0, "", "ie")], "ies": [(0, "..", "i"), (0, "", "ie")], "us": [], "ss": [], "s": [(0, "[aeiouy].", "")]}
ENGLISH_PAST = {"eed": [(1, "", "ee")], "eedly": [(1, "", "ee")], "ed": [(0, "[aeiouy]", "")], "edly": [(0, "[aeiouy]", "")], "ing": [(0, "[aeiouy]", "")], "ingly": [(0, "[aeiouy]", "")]}
ENGLISH_AFTER_PAST = {"at": [(0, "", "ate")], "bl": [(0, "", "ble")], "iz": [(0, "", "ize")], "bb": [(0, "", "b")], "dd": [(0, "", "d")], "ff": [(0, "", "f")], "gg": [(0, "", "g")],
                      "mm": [(0, "", "m")], "nn": [(0, "", "n")], "pp": [(0, "", "p")], "rr": [(0, "", "r")], "tt": [(0, "", "t")]}
ENGLISH_FINAL_Y = {"y": [(0, ".[^aeiouy]$", "i")], "Y": [(0, ".[^aeiouy]$", "i")]}
ENGLISH_DERIVED = {
    "tional": [(1, "", "tion")], "enci": [(1, "", "ence")], "anci": [(1, "", "ance")], "abli": [(1, "", "able")], "entli": [(1, "", "ent")], "izer": [(1, "", "ize")],
    "ization": [(1, "", "ize")], "ational": [(1, "", "ate")], "ation": [(1, "", "ate")], "ator": [(1, "", "ate")], "alism": [(1, "", "al")], "aliti": [(1, "", "al")],
    "alli": [(1, "", "al")], "fulness": [(1, "", "ful")], "ousli": [(1, "", "ous")], "ousness": [(1, "", "ous")], "iveness": [(1, "", "ive")], "iviti": [(1, "", "ive")],
    "biliti": [(1, "", "ble")], "bli": [(1, "", "ble")], "ogi": [(1, "l$", "og")], "fulli": [(1, "", "ful")], "lessli": [(1, "", "less")], "li": [(1, "[cdeghkmnrt]$", "")]}
ENGLISH_SECOND_DERIVED = {"tional": [(1, "", "tion")], "ational": [(1, "", "ate")], "alize": [(1, "", "al")], "icate": [(1, "", "ic")], "iciti": [(1, "", "ic")], "ical": [(1, "", "ic")],
                          "ful": [(1, "", "")], "ness": [(1, "", "")], "ative": [(2, "", "")]}
ENGLISH_REMOVED = {**{s: [(2, "", "")] for s in ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize")}, "ion": [(2, "[st]$", "")]}
ENGLISH_FINAL_E = {"e": [(2, "", ""), (1, "!" + ENGLISH_SHORT_SYLLABLE, "")], "l": [(2, "l$", "")]}
