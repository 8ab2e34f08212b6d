"""Fixed values of the document-archive domain.

Everything here is data, stated plainly: registrations, label maps, keyword
lists, patterns and thresholds whose exact value and order decide results.
The logic that uses them lives in ``docspark.functions`` and
``docspark.operators``.
"""

# --- fleet (fixed values) ---------------------------------------------------
FLEET_REGISTRATIONS = [
    "TS-INB", "TS-INC", "TS-IND", "TS-INE", "TS-INF", "TS-ING", "TS-INH",
    "TS-INI", "TS-INJ", "TS-INK", "TS-INL", "TS-INM", "TS-INN", "TS-INO",
    "TS-INP", "TS-INQ", "TS-INR", "TS-INT", "TS-INU",
]
ACTIVE_REGISTRATIONS = ["TS-INP", "TS-INQ"]
TREE_REGISTRATIONS = ["TS-INP", "TS-INQ", "TS-IML", "TS-INN", "TS-INM"]
REPAIR_REGISTRATIONS = [
    "TS-INC", "TS-IND", "TS-INE", "TS-INF", "TS-ING", "TS-INH", "TS-INI",
    "TS-INJ", "TS-INK", "TS-INL", "TS-INM", "TS-INN", "TS-INO", "TS-INP",
    "TS-INQ", "TS-INR", "TS-INT", "TS-INU",
]
KNOWN_MSN = {"TS-INP": "2158", "TS-INQ": "3012"}
MSN_TO_REGISTRATION = {
    "1597": "TS-INP", "6333": "TS-INQ", "2158": "TS-INP", "3012": "TS-INQ",
}
KEPT_AIRCRAFT = [
    ("TS-INP", "A320-214", "2158"),
    ("TS-INQ", "A320-214", "3012"),
]
DEFAULT_AIRCRAFT_MODEL = "A320-214"

# --- labels (fixed values) --------------------------------------------------
TYPE_NAME_TO_VALUE = {
    "WORK_ORDER": "Work Order", "JOBCARD": "Jobcard",
    "DEFECT_REPORT": "Defect Report", "SPECS": "Specs",
    "CERTIFICATE": "Certificate", "AD": "AD", "SB": "SB", "AMM": "AMM",
    "CMM": "CMM", "IPC": "IPC", "ATL": "ATL", "NCR": "NCR", "RCT": "RCT",
}
CHECK_CATEGORIES = ["Check A", "Check B", "Check C", "Check D"]
CHECK_TYPE_NAMES = {
    "CHECK_A": "Check A", "CHECK_C": "Check C", "CHECK_D": "Check D",
    "CHECK A": "Check A", "CHECK C": "Check C", "CHECK D": "Check D",
}

# --- thresholds (fixed values) ----------------------------------------------
REVIEW_OCR_BELOW = 60.0
REVIEW_CLASSIFIER_BELOW = 0.5
CRITICAL_AD_ABOVE = 0.7
LOW_OCR_ALERT_BELOW = 50.0
OCR_RUN_REVIEW_BELOW = 55.0
OCR_GOOD = 75.0
MIN_SIMILARITY = 0.3
ARBITRATION_BELOW = 0.85

# --- entity patterns, tried in order (fixed values) -------------------------
REGISTRATION_DEGRADED = [
    (r"\b[EtTiI!][N][OPQRSTU]\b", 0),
    (r"\b[OoEe]{1,2}N[OPQRSTU]\b", 0),
    (r"A/?C[^\n]*\n[^\n]{0,10}(IN[A-Z])", 1),
    (r"A/?C[^\n]*\n[^\n]{0,5}([NQ]{2}|NP|NO)\b", 1),
]
REGISTRATION_PATTERNS = [
    r"\b(TS-IN[A-Z])\b",
    r"\b(TS-[A-Z]{3})\b",
    r"IMMATRICULATION[\s:.-]*\n?[^\n]{0,30}(TS-IN[A-Z])",
    r"A/?C[\s:.-]*\n[!\s]*(TS-IN[A-Z])\b",
    r"A/?C[\s:.-]*\n[!\s]*(IN[A-Z])\b",
    r"A/?C[\s:.-]*\n[!\s]*([A-Z]{2})\b",
    r"A/?C[\s:.-]+([A-Z]{2})\b",
    r"FSN[\s:.-]*\n?[^\n]{0,50}\(?(TS-IN[A-Z])\)?",
    r"(?:TAIL\s+NUMBER|FSN\s*:)[^\n]*\n[^\n]*(TS-IN[A-Z])",
    r"(?:AIRCRAFT|REG(?:ISTRATION)?)[\s:.-]+(TS-IN[A-Z])",
    r"![!\s]*(IN[A-Z])\b",
    r"!([NQ]{2}|NP|NO|NI|NH|NG|NF|NE|ND|NC|NB|NM|NL|NK|NJ|NN|NR|NT|NU)\b",
    r"[OoEe]{1,2}(NQ|NP|NO|NI|NM|NN|NR)\b",
    r"[t!|i][A/?C\s]*\n[t!|i\s]*(N[A-Z])\b",
    r"A/?C[^\n]*\n[^\n]{0,5}(N[OPQRSTU])\b",
    r"\b(N[OPQRSTU])\b(?=\s*\n|\s*!)",
    r"\b(IN[A-Z])\b",
]
ENTITY_PATTERNS = {
    "es_reference": [
        r"\b(ES\s*\d{6,8})\b",
        r"WORK\s+ORDER\s+No[\s:.-]*(ES[\s]?\d{6,8})",
        r"\bES[\s-]?(\d{6,8})\b",
        r"FSN[\s:.-]+([A-Z]{0,2}\d{6,8})\b",
    ],
    "part_number": [
        r"P/?N[\s:.-]+([A-Z0-9][-A-Z0-9]{3,30})",
        r"PART\s+NO?\.?\s*:?\s*([A-Z0-9][-A-Z0-9]{3,30})",
    ],
    "serial_number": [
        r"S/?N[\s:.-]+([A-Z0-9][-A-Z0-9]{2,20})",
        r"MSN[\s:.-]+(\d{3,6})",
    ],
    "ata_chapter": [
        r"ATA[\s-]+(\d{2}[-\d]{0,5})",
        r"CHAPTER[\s:]+(\d{2}[-\d]{0,5})",
    ],
    "work_order_number": [
        r"WORK\s+ORDER[\s:.-]+([A-Z0-9-]{4,20})",
        r"W/?O[\s:.-]+([A-Z0-9-]{4,20})",
    ],
    "sb_ad_reference": [
        r"\b(A3[0-9]{2}-\d{2}-\d{3,5}[A-Z]?)\b",
        r"\b(AD[\s]?\d{4}-\d{2}-\d{2,4})\b",
    ],
    "item_number": [
        r"ITEM[\s:.-]+(\d{1,6})",
        r"CARD\s+NO?\.?[\s:.-]+(\d{1,6})",
    ],
    "document_date": [
        r"DATE[\s:.-]+(\d{1,2}[/-]\d{1,2}[/-]\d{2,4})",
        r"(\d{1,2}[/-]\d{1,2}[/-]\d{4})",
        r"(\d{4}-\d{2}-\d{2})",
    ],
    "effectivity": [
        r"EFFECTIV(?:ITY|E)[\s:.-]+([A-Z0-9,\s-]{3,50})",
    ],
}
FILENAME_ES = r"(ES\d{6,8})"
FILENAME_ITEM = r"^(\d{3,4})(?:\.PDF)?$"
FILENAME_SB = r"(A3\d{2}-\d{2}-\d{3,5}[A-Z]?)"
FILENAME_ATA = r"ATA[\s-]?(\d{2})"
RCT_FILENAME = r"(TS-[A-Z]{3})_CHECK\s*([ABCD])_([A-Z]{0,2}\d{4,8})_RCT"
RCT_WP_PATTERNS = [
    r"WORK\s*PACKAGE\s*REF\s*[:\s]+([A-Z]{0,2}\d{4,8})",
    r"W\.?P\.?\s*REF\s*[:\s]+([A-Z]{0,2}\d{4,8})",
]
RCT_CHECK_PATTERNS = [r"\bCHECK\s*([ABCD])\b", r"\bVISITE\s*([ABCD])\b"]
ATA_DESCRIPTIONS = {
    "05": "Time Limits", "21": "Air Conditioning", "22": "Auto Flight",
    "23": "Communications", "24": "Electrical Power", "25": "Equipment",
    "26": "Fire Protection", "27": "Flight Controls", "28": "Fuel",
    "29": "Hydraulic Power", "30": "Ice Protection", "31": "Instruments",
    "32": "Landing Gear", "33": "Lights", "34": "Navigation", "49": "APU",
    "51": "Structures", "52": "Doors", "53": "Fuselage", "71": "Power Plant",
    "72": "Engine", "79": "Oil",
}
MSN_PATTERNS = [
    r"(?i)(?:MSN|S/N|SERIAL\s*NO?\.?|MANUFACTURER\s*SERIAL)[\s:.\-]+(\d{3,5})",
    r"(?i)\bMSN[\s:]*(\d{3,5})\b",
    r"\b(2158|3012)\b",
]
MSN_ENTITY_KEYS = ["msn", "serial_number", "manufacturer_serial"]
LINKED_WP_BLOCK = (
    r"(?i)(?:linked\s+wp|wp\s+linked)\s*[:\-]?\s*((?:ES\s*\d{4,8}\s*[/,]?\s*)+)"
)
LINKED_WP_FALLBACK = r"(?i)(?:linked|wp)\s+.*?(ES\s*\d{4,8})"
QUICK_PATTERNS = [
    r"(?i)ATA[\s\-]+(\d{2})",
    r"(?i)P/?N[\s:.\-]+([A-Z0-9][\-A-Z0-9]{3,20})",
    r"(?i)(?:S/N|MSN|SERIAL)[\s:.\-]+([A-Z0-9]{3,12})",
    r"(?i)\b(TS-IN[A-Z])\b",
    r"\b(ES\d{6,8})\b",
    r"(?i)\b(A3\d{2}-\d{2}-\d{3,5}|SB[\s\-]\w+)\b",
    r"(?i)(?:W/O|WORK ORDER)[\s:.\-]+([A-Z0-9\-]{4,20})",
]
# Second entity set: the alternatives of one field carry one group each.
COMPACT_ENTITY_PATTERNS = {
    "aircraft_registration": [
        r"\b(TS-[A-Z]{3})\b",
        r"A/?C\s*[:\-]?\s*(TS-[A-Z]{3})",
        r"A/?C\s*\n\s*(TS-[A-Z]{3})",
        r"A/?C\s*\n[!\s]*(INP|INQ|INO)\b",
        r"![A-Z]?(INP|INQ|INO)\b",
        r"FSN\s*[:\-]?\s*(TS-[A-Z]{3})",
    ],
    "es_reference": [r"\b(ES\s*\d{5,7})\b"],
    "ata_chapter": [
        r"\bATA\s*(\d{2}[-–]\d{2}(?:[-–]\d{2})?)\b",
        r"\bATA\s*(\d{2})\b",
    ],
    "part_number": [r"\bP/?N[:\s#]?\s*([A-Z0-9][-A-Z0-9]{3,20})\b"],
    "serial_number": [r"\b(?:S/?N|MSN)[:\s#]?\s*([A-Z0-9]{3,20})\b"],
    "doc_ref": [r"\b((?:AD|SB|AMM|CMM)\s+[\w][-\w]{3,25})\b"],
}
# Span annotation: label -> patterns, in priority order.
SPAN_PATTERNS = {
    "AIRCRAFT_REG": [r"\b(TS-[A-Z]{3})\b"],
    "ES_REF": [r"\b(ES\d{6})\b", r"\b(ES\s?\d{6})\b"],
    "ATA_CHAPTER": [
        r"\bATA\s*(\d{2}[-–]\d{2}(?:[-–]\d{2})?)\b",
        r"\b(\d{2}[-–]\d{2}[-–]\d{2})\b",
        r"\bATA\s*(\d{2})\b",
    ],
    "PART_NUMBER": [
        r"\bP/?N[:\s#]?\s*([A-Z0-9][-A-Z0-9]{3,20})\b",
        r"\bPart\s+No\.?\s*:?\s*([A-Z0-9][-A-Z0-9]{3,20})\b",
        r"\bPN[:\s]([A-Z0-9][-A-Z0-9]{3,20})\b",
    ],
    "SERIAL_NUMBER": [
        r"\bS/?N[:\s#]?\s*([A-Z0-9][-A-Z0-9]{3,20})\b",
        r"\bMSN\s*:?\s*(\d{3,6})\b",
        r"\bSerial\s+No\.?\s*:?\s*([A-Z0-9]{4,20})\b",
    ],
    "DOC_REF": [
        r"\b(AD\s+\d{4}[-–]\d{2}[-–]\d{2,4})\b",
        r"\b(SB\s+[\w][-\w]{3,25})\b",
        r"\b(AMM\s+\d{2}[-–]\d{2}[-–]\d{2,4})\b",
        r"\b(CMM\s+[\w][-\w]{3,20})\b",
    ],
    "DATE_AVIO": [
        r"\b(\d{1,2}\s+(?:JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC|"
        r"JANV?|FÉVR?|MARS|AVR|JUIN|JUIL|AOÛT|SEPT?|OCT|NOV|DÉC)\s+\d{4})\b",
        r"\b(\d{4}[-/]\d{2}[-/]\d{2})\b",
        r"\b(\d{2}[-/]\d{2}[-/]\d{4})\b",
    ],
    "AIRLINE": [],
}
SPAN_TEXT_LIMIT = 4800
# Full-match format rules per field.
FORMAT_RULES = {
    "ata_chapter": r"\d{2}(-\d{2,4})?",
    "serial_number": r"[A-Z0-9\-]{3,20}",
    "es_reference": r"(ES\d{6,8}|\d{6,8})",
    "document_date": r"\d{4}-\d{2}-\d{2}",
    "effectivity": r"(TS-[A-Z]{3}|\d{3,6}|[A-Z0-9,\s-]{3,30})",
    "part_number": r"[A-Z0-9\-]{4,20}",
    "sb_ad_reference": r"(\d{2}-\d{2,5}-\d{2,6}|(?:SB|AD)[-\s]?\w+)",
    "work_order_number": r"[A-Z0-9\-]{3,20}",
}

# --- processing profiles (fixed values, declaration order matters) ----------
PROFILE_PATTERNS = {
    "AIRCRAFT_REG": (r"(?i)\bTS-I[A-Z]{2}\b", 0),
    "MSN": (r"(?i)(?:MSN|M\.S\.N\.?)[:\s#]*(\d{3,5})", 1),
    "CHECK_ID": (r"\b(ES\d{6})\b", 1),
    "CHECK_TYPE": (r"(?i)(?:Check|CHECK|Visite)\s+([ABC]|Line|Heavy|OASN)", 1),
    "WORK_ORDER": (r"(?i)(?:W\.?O\.?|Work\s*Order)[:\s#]*([A-Z0-9\-]{4,15})", 1),
    "FSN": (r"(?i)(?:FSN|F\.S\.N\.?)[:\s#]*([A-Z0-9\-]{5,20})", 1),
    "ATA_CHAPTER": (r"\b(\d{2}-\d{2}(?:-\d{2})?)\b", 1),
    "PART_NUMBER": (
        r"(?i)(?:P/?N|Part\s*N(?:o|umber)?\.?)[:\s#]*([A-Z0-9][\w\-]{3,20})", 1),
    "SERIAL_NUMBER": (
        r"(?i)(?:S/?N|Serial\s*N(?:o|umber)?\.?)[:\s#]*([A-Z0-9][\w\-]{3,20})", 1),
    "SB_NUMBER": (
        r"(?i)(?:SB|S\.B\.)[:\s]*([A-Z0-9]{2,10}-\d{2}-\d{3,4}(?:-\d+)?)", 1),
    "REVISION": (r"(?i)(?:Rev(?:ision)?\.?|Rév\.?)[:\s]*(\d+|[A-Z])", 1),
    "EFFECTIVITY": (
        r"(?i)(?:Effectiv(?:ity|ité)|Applicabilit[yé])[:\s]*([^\n]{5,60})", 1),
    "DATE": (r"\b(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}|\d{4}-\d{2}-\d{2})\b", 1),
    "COMPLIANCE_DATE": (
        r"(?i)(?:Compliance|Due\s*Date|Date\s*limite)[:\s]*([^\n]{5,40})", 1),
    "FLIGHT_HOURS": (
        r"(?i)(?:FH|Flight\s*Hours?|Heures?\s*de\s*Vol)[:\s]*(\d+(?:\.\d+)?)", 1),
    "FLIGHT_CYCLES": (r"(?i)(?:FC|Flight\s*Cycles?|Cycles?)[:\s]*(\d+)", 1),
}
PROFILES = {
    "job_card": {
        "keywords": ["job_card", "job card", "jobcard", "jc", "task_card"],
        "filename_regex": r"^(\d{3,4}\.pdf$|.*task.*)",
        "confidence": 0.95,
        "entities": ["FSN", "AIRCRAFT_REG", "MSN", "CHECK_ID", "CHECK_TYPE",
                     "ATA_CHAPTER", "PART_NUMBER", "SERIAL_NUMBER",
                     "FLIGHT_HOURS", "FLIGHT_CYCLES", "DATE"],
        "required": ["fsn", "aircraft_reg", "ata_chapter"],
        "formats": {"aircraft_reg": r"^TS-I[A-Z]{2}$",
                    "ata_chapter": r"^\d{2}-\d{2}(-\d{2})?$"},
        "prefix": "Job Card maintenance task: ", "max_chars": 800,
        "display": "Job Card",
    },
    "work_order": {
        "keywords": ["work_order", "work order", "wo", "ordre_travail"],
        "filename_regex": r"^(wo[-_]?)?es\d{5,8}",
        "confidence": 0.92,
        "entities": ["WORK_ORDER", "CHECK_ID", "CHECK_TYPE", "AIRCRAFT_REG",
                     "MSN", "DATE", "FLIGHT_HOURS", "FLIGHT_CYCLES"],
        "required": ["work_order", "aircraft_reg"],
        "formats": {"aircraft_reg": r"^TS-I[A-Z]{2}$"},
        "prefix": "Work order maintenance: ", "max_chars": 700,
        "display": "Work Order",
    },
    "service_bulletin": {
        "keywords": ["sb", "service_bulletin", "service bulletin", "bulletin"],
        "filename_regex": None,
        "confidence": 0.93,
        "entities": ["SB_NUMBER", "REVISION", "EFFECTIVITY", "MSN",
                     "COMPLIANCE_DATE", "ATA_CHAPTER", "PART_NUMBER", "DATE"],
        "required": ["sb_number", "revision"],
        "formats": {"sb_number": r"^[A-Z]\d{3}-\d{2}-\d{3,4}"},
        "prefix": "Service bulletin airworthiness: ", "max_chars": 900,
        "display": "Service Bulletin",
    },
    "amm": {
        "keywords": ["amm", "aircraft_maintenance", "maintenance_manual"],
        "filename_regex": None,
        "confidence": 0.90,
        "entities": ["ATA_CHAPTER", "PART_NUMBER", "SERIAL_NUMBER",
                     "AIRCRAFT_REG", "REVISION", "DATE"],
        "required": ["ata_chapter"],
        "formats": {"ata_chapter": r"^\d{2}-\d{2}(-\d{2})?$"},
        "prefix": "Aircraft maintenance manual procedure: ", "max_chars": 1000,
        "display": "AMM",
    },
    "delivery_package": {
        "keywords": ["old_doc", "old doc", "delivery", "livraison",
                     "delivery_package"],
        "filename_regex": None,
        "confidence": 0.88,
        "entities": ["MSN", "AIRCRAFT_REG", "DATE", "PART_NUMBER",
                     "CHECK_TYPE"],
        "required": ["msn"],
        "formats": {},
        "prefix": "Aircraft delivery document: ", "max_chars": 600,
        "display": "Delivery Package",
    },
    "cmm": {
        "keywords": ["cmm", "ipc", "illustrated_parts",
                     "component_maintenance"],
        "filename_regex": None,
        "confidence": 0.91,
        "entities": ["PART_NUMBER", "SERIAL_NUMBER", "ATA_CHAPTER",
                     "REVISION"],
        "required": ["part_number"],
        "formats": {},
        "prefix": "Component maintenance catalog: ", "max_chars": 700,
        "display": "CMM",
    },
    "mel": {
        "keywords": ["mel", "minimum_equipment", "liste_equipement"],
        "filename_regex": None,
        "confidence": 0.94,
        "entities": ["ATA_CHAPTER", "AIRCRAFT_REG", "REVISION", "DATE",
                     "COMPLIANCE_DATE"],
        "required": ["ata_chapter"],
        "formats": {},
        "prefix": "Minimum equipment list item: ", "max_chars": 800,
        "display": "MEL",
    },
}
GENERIC_PROFILE_ENTITIES = ["AIRCRAFT_REG", "MSN", "DATE", "ATA_CHAPTER"]
PROFILE_TO_TYPE = {
    "job_card": "Jobcard", "work_order": "Work Order", "ncr": "NCR",
    "atl": "ATL", "ad": "AD", "sb": "SB", "rct": "RCT",
    "certificate": "Certificate", "defect_report": "Defect Report",
    "d_b_chart": "D&B Chart", "amm": "AMM", "cmm": "CMM", "ipc": "IPC",
    "specs": "Specs",
}

# --- paths (fixed values, order matters) ------------------------------------
SUBCATEGORY_EXACT = {
    "JOBCARD": "Jobcard", "JOB CARD": "Jobcard", "WORKORDER": "Work Order",
    "WORK ORDER": "Work Order", "DEFECT REPORT": "Defect Report",
    "NCR": "NCR", "RCT": "RCT",
}
DISCOVERY_CATEGORIES = [
    ("check a", "Check A"), ("check c", "Check C"), ("check d", "Check D"),
    ("atl", "ATL"), ("/sb/", "SB"), ("\\sb\\", "SB"), ("/ad/", "AD"),
    ("\\ad\\", "AD"), ("airworthiness", "AD"), ("amm", "AMM"),
    ("cmm", "CMM"), ("ipc", "IPC"), ("mel", "MEL"), ("specs", "Specs"),
    ("structural", "Structural Repair"), ("stc", "STC"),
    ("weight", "Weight & Balance"),
]
SEGMENT_CATEGORIES = [
    ("CHECK A", "Check A"), ("CHECK-A", "Check A"), ("CHECK C", "Check C"),
    ("CHECK-C", "Check C"), ("CHECK D", "Check D"), ("ATL", "ATL"),
    ("SB", "SB"), ("SERVICE BULLETIN", "SB"), ("AD", "AD"),
    ("AIRWORTHINESS", "AD"), ("SPECS", "Specs"),
    ("STRUCTURAL REPAIR", "Structural Repair"),
    ("WEIGHT", "Weight & Balance"), ("OLD DOC", "Delivery Package"),
]
SEGMENT_SUBCATEGORIES = [
    ("JOBCARD", "Jobcard"), ("JOB CARD", "Jobcard"),
    ("WORKORDER", "Work Order"), ("WORK ORDER", "Work Order"),
    ("DEFECT REPORT", "Defect Report"), ("NCR", "NCR"), ("RCT", "RCT"),
    ("D&B", "D&B Chart"),
]
INVENTORY_EXTENSIONS = [
    "pdf", "doc", "docx", "xls", "xlsx", "rtf", "txt", "jpg", "jpeg", "tif",
    "tiff", "msg",
]
EXCLUDED_DIRECTORIES = [
    "bin", "lib", "jre", "java", "adobe", "acrobat", "windows", "system32",
    "program files", "node_modules", "__pycache__", ".git",
]

# --- file naming (fixed values) ---------------------------------------------
NAME_TYPE_LABELS = {
    "WORK_ORDER": "Work_Order", "JOBCARD": "Jobcard", "AD": "AD", "SB": "SB",
    "AMM": "AMM", "CMM": "CMM", "IPC": "IPC", "SPECS": "Specs",
    "CERTIFICATE": "Certificate", "DEFECT_REPORT": "Defect_Report",
    "NCR": "NCR", "RCT": "RCT", "ATL": "ATL", "DB_CHART": "DB_Chart",
    "OTHER": "Doc",
}
NAME_CATEGORY_LABELS = {
    "Check A": "Check_A", "Check C": "Check_C", "Check D": "Check_D",
    "AD": "AD", "SB": "SB", "AMM": "AMM", "CMM": "CMM", "IPC": "IPC",
    "Specs": "Specs", "Certificates": "Certificates",
    "Structural Repair": "Structural_Repair", "Engine File": "Engine_File",
    "Correspondence": "Correspondence", "Weight & Balance": "Weight_Balance",
    "ATL": "ATL",
}
SHORT_TYPES = {
    "WORK_ORDER": "WO", "JOBCARD": "JC", "AD": "AD", "SB": "SB",
    "AMM": "AMM", "CMM": "CMM", "IPC": "IPC", "SPECS": "SPECS",
    "CERTIFICATE": "CERT", "DEFECT_REPORT": "DR", "RCT": "RCT",
    "NCR": "NCR", "ATL": "ATL",
}
CATEGORY_FOLDERS = {
    "check a": "Checks/Check_A", "check c": "Checks/Check_C",
    "check d": "Checks/Check_D", "ad": "Navigabilite/AD",
    "sb": "Navigabilite/SB", "amm": "Technique/AMM", "cmm": "Technique/CMM",
    "ipc": "Technique/IPC", "specs": "Technique/Specs",
    "certificates": "Certificates", "structural repair": "Structural Repair",
    "engine file": "Engine_File", "correspondence": "Correspondence",
    "weight & balance": "Weight_Balance", "atl": "ATL",
}
TYPE_FOLDERS = {
    "WORK_ORDER": "Work_Order", "JOBCARD": "Job_Card", "AD": "AD",
    "SB": "SB", "DEFECT_REPORT": "Defect_Report", "RCT": "RCT", "NCR": "NCR",
}

# --- classification rules (fixed values, declaration order breaks ties) -----
RULES = {
    "Work Order": {
        "weight": 1.3,
        "keywords": ["work order", "ordre d execution", "ordre d'execution",
                     "execution no", "travaux", "maintenance task",
                     "workorder", "task card", "wp linked", "wp ref",
                     "opened on", "repetitive w.o"],
        "filename": [r"ES\d{4,8}", r"WO\d+"],
        "path": ["workorder", "work order", "wo", "check a", "check c",
                 "check"],
    },
    "Jobcard": {
        "weight": 1.0,
        "keywords": ["job card", "jobcard", "task", "skill", "man hours"],
        "filename": [r"^\d{2,4}\.pdf$"],
        "path": ["jobcard", "job card"],
    },
    "Defect Report": {
        "weight": 1.0,
        "keywords": ["defect", "anomaly", "finding", "damage", "discrepancy",
                     "defect report"],
        "filename": [r"^\d{1,3}\.pdf$"],
        "path": ["defect report", "defect"],
    },
    "NCR": {
        "weight": 1.0,
        "keywords": ["non conformity", "ncr", "non-conformance",
                     "non conformance report"],
        "filename": [],
        "path": ["ncr"],
    },
    "AD": {
        "weight": 1.2,
        "keywords": ["airworthiness directive", "ad", "directive", "easa",
                     "faa", "mandatory"],
        "filename": [r"A3\d{2}-\d{2}-\d{3,5}", r"AD-\d{4}"],
        "path": ["ad", "airworthiness"],
    },
    "SB": {
        "weight": 1.0,
        "keywords": ["service bulletin", "sb", "modification", "retrofit"],
        "filename": [r"A3\d{2}-\d{2}[A-Z]\d{4}", r"SB-"],
        "path": ["sb", "service bulletin"],
    },
    "ATL": {
        "weight": 1.0,
        "keywords": ["technical log", "atl", "flight log", "sector",
                     "departure", "arrival"],
        "filename": [r"TL\d{2}[A-Z]{3}"],
        "path": ["atl", "technical log"],
    },
    "AMM": {
        "weight": 1.0,
        "keywords": ["aircraft maintenance manual", "amm", "procedure",
                     "maintenance manual"],
        "filename": [r"AMM"],
        "path": ["amm"],
    },
    "CMM": {
        "weight": 1.0,
        "keywords": ["component maintenance manual", "cmm", "overhaul",
                     "bench test"],
        "filename": [r"CMM"],
        "path": ["cmm"],
    },
    "IPC": {
        "weight": 1.0,
        "keywords": ["illustrated parts", "ipc", "parts catalog", "figure",
                     "item number"],
        "filename": [r"IPC"],
        "path": ["ipc"],
    },
    "Specs": {
        "weight": 1.0,
        "keywords": ["specifications", "specs", "technical specification",
                     "general information", "msn"],
        "filename": [r"Specs", r"MSN.*Specs"],
        "path": ["specs", "specifications", "status"],
    },
    "Certificate": {
        "weight": 1.0,
        "keywords": ["certificate", "certificat", "form 1", "crs",
                     "release to service", "approval"],
        "filename": [r"cert", r"Form1", r"CRS"],
        "path": ["certificates", "burn certs", "ht certificates"],
    },
    "RCT": {
        "weight": 1.1,
        "keywords": ["rct", "release certificate", "return to service"],
        "filename": [r"RCT"],
        "path": ["rct"],
    },
}
RULE_KEYWORD_POINTS = 0.15
RULE_FILENAME_POINTS = 0.35
RULE_PATH_POINTS = 0.50
STRUCTURAL_TYPES = [
    "Work Order", "Jobcard", "Defect Report", "NCR", "Certificate", "RCT",
]
TYPE_TO_CATEGORY = {
    "Work Order": "Check A", "Jobcard": "Check A",
    "Defect Report": "Check C", "NCR": "Check C", "AD": "AD", "SB": "SB",
    "ATL": "ATL", "AMM": "AMM", "CMM": "CMM", "IPC": "IPC",
    "Specs": "Specs", "Certificate": "Certificates", "RCT": "Check A",
}
WORK_ORDER_FILENAME = r"(?i)^ES\d{4,8}(\.pdf)?$"
PATH_TYPE_RULES = [
    (r"[/\\]workorder[/\\]", "Work Order"),
    (r"_workorder_", "Work Order"),
    (r"[/\\]jobcard[/\\]", "Jobcard"),
    (r"_jobcard_", "Jobcard"),
    (r"[/\\]defect[_\s]?report[/\\]", "Defect Report"),
    (r"_defect[_\s]?report_", "Defect Report"),
    (r"_rct[-_.]", "RCT"),
    (r"[/\\]rct[/\\]", "RCT"),
    (r"[/\\]old[_\s]?doc[/\\]ad[/\\]", "AD"),
    (r"[/\\]ad[_\s]?dfps[/\\]", "AD"),
    (r"[/\\]ads[_\s]?not", "AD"),
    (r"[/\\]old[_\s]?doc[/\\]sb[/\\]", "SB"),
    (r"[/\\]sb[_\s]?airbus[/\\]", "SB"),
    (r"[/\\]atl[/\\]", "ATL"),
    (r"[/\\]ncr[/\\]", "NCR"),
    (r"_rct\.pdf$", "RCT"),
    (r"_rct_", "RCT"),
    (r"rct-es\d+", "RCT"),
    (r"[/\\]ht[_\s]?certificates[/\\]", "Certificate"),
    (r"[/\\]occm[/\\]", "Certificate"),
    (r"[/\\]cmm[/\\]", "CMM"),
    (r"[/\\]specs[/\\]", "Specs"),
]
NON_INFORMATIVE_FOLDERS = [
    "/downloads/", "/desktop/", "/documents/", "/temp/", "/tmp/",
]
CATEGORY_PATH_RULES = [
    (["check a", "check-a"], "Check A"),
    (["check c", "check-c"], "Check C"),
    (["/atl/"], "ATL"),
    (["/sb/"], "SB"),
    (["/ad/"], "AD"),
    (["specs", "specifications"], "Specs"),
    (["structural repair"], "Structural Repair"),
    (["/stc/"], "STC"),
    (["weight", "balance"], "Weight & Balance"),
]
KEYWORD_RULES = {
    "AD": {"kw": ["airworthiness directive", " ad ", "directive", "easa ad",
                  "faa ad", "mandatory action"], "fn": ["a3", "ad-"]},
    "SB": {"kw": ["service bulletin", " sb ", "modification", "retrofit"],
           "fn": ["sb-", "a3"]},
    "AMM": {"kw": ["aircraft maintenance manual", "amm",
                   "maintenance manual", "procedure"], "fn": ["amm"]},
    "CMM": {"kw": ["component maintenance manual", "cmm", "overhaul",
                   "bench test"], "fn": ["cmm"]},
    "IPC": {"kw": ["illustrated parts", "ipc", "parts catalog", "figure",
                   "item number"], "fn": ["ipc"]},
    "Specs": {"kw": ["specifications", "specs", "technical specification",
                     "general information", "msn"], "fn": ["specs", "msn"]},
    "Certificate": {"kw": ["certificate", "certificat", "form 1", "crs",
                           "release to service", "approval"],
                    "fn": ["cert", "form1", "crs"]},
    "RCT": {"kw": ["rct", "release certificate", "return to service"],
            "fn": ["rct"]},
    "Work Order": {"kw": ["work order", "wo ", "task card",
                          "maintenance task"], "fn": ["wo-", "workorder"]},
    "Jobcard": {"kw": ["job card", "jobcard", "job sheet", "task number"],
                "fn": []},
    "Defect Report": {"kw": ["defect report", "defect", "fault", "snag",
                             "mel"], "fn": ["defect", "dr-"]},
    "NCR": {"kw": ["non conformance", "ncr", "non-conformance",
                   "quality report"], "fn": ["ncr"]},
    "ATL": {"kw": ["technical log", "atl", "flight log", "sector",
                   "departure", "arrival"], "fn": ["tl"]},
}
FILENAME_LABEL_RULES = [
    ("ES", "Work Order"), ("CHECK_A", "Check A"), ("CHECK_C", "Check C"),
    ("CHECK_D", "Check D"), ("AD", "Airworthiness Directive"),
    ("SB", "Service Bulletin"), ("AMM", "Aircraft Maintenance Manual"),
    ("CMM", "Component Maintenance Manual"),
    ("IPC", "Illustrated Parts Catalog"), ("MEL", "Minimum Equipment List"),
]

# --- page segmentation (fixed values) ---------------------------------------
BOUNDARY_PATTERNS = [
    (r"(?i)WORK\s*ORDER", "WORK_ORDER"),
    (r"(?i)ORDRE\s+D.EXECUTION", "JOBCARD"),
    (r"(?i)MAINTENANCE\s+JOB\s+CARD", "JOBCARD"),
    (r"(?i)DEFECT\s+REPORT", "DEFECT_REPORT"),
    (r"(?i)RAPPORT\s+DE\s+CONTROLE", "WORK_ORDER"),
    (r"(?i)MAINTENANCE\s+AND\s+PERFORMANCE\s+LOG", "ATL"),
    (r"(?i)NON.CONFORMITY\s+REPORT|NCR\s+N", "NCR"),
    (r"(?i)RELEASE\s+TO\s+SERVICE|CERTIFICATE\s+OF\s+RELEASE", "CERTIFICATE"),
    (r"(?i)AIRWORTHINESS\s+DIRECTIVE|SB/AD/CN", "AD"),
    (r"(?i)SERVICE\s+BULLETIN", "SB"),
]
PAGE_ES = r"(?i)\bES\s*0*(\d{4,8})\b"
PAGE_REGISTRATION = r"(?i)\b(TS-[A-Z]{2,4})\b"
HEADER_LINES = 20
TOP_LINES = 5

# --- relabelling phrases (fixed values) -------------------------------------
FALSE_AD_BELOW = 0.36
CERTIFICATE_PHRASES = [
    "EASA F1", "EASA Form", "FAA Form", "FAA 8130", "8130-3", "Form One",
    "Form 1", "EASA0001", "EASA ECB", "Acceptance Certificate",
    "Release Certificate", "BTB Complete", "BTB Compleete", "Air Arabia-1",
    "Air Arabia-2",
]
SPECS_PHRASES = [
    "Oil consumption", "Flight Summary", "General Overview", "Weight Report",
    "Weight And Balance", "AFM", "LLP Status", "LLP Sheet",
    "Installation and Removal", "Non-Operation Statement", "Trend report",
    "Engine Change", "Totals-Statement", "LOPA", "Start.pdf", "ReadMe",
    "MSN 2158 General", "MSN 2158 Flight", "ELA_A320", "ETOPS", "CDSS",
]
REGISTRATION_FIXES = [("TS-INC", "TS-INP"), ("TS-OFM", "TS-INQ")]
ENGINE_FILE_LIKE = "0%.%.pdf"
DENT_CHART_ILIKE = ["%d&b%chart%", "%dent%buckle%", "%chart_r0%"]
PATCHABLE_AIRCRAFT_FIELDS = [
    "aircraft_type", "msn", "variant", "delivery_date", "lessor", "notes",
    "model",
]

# --- search (fixed values) --------------------------------------------------
VARIANT_SCORES = [(8, 0.9), (5, 0.7), (0, 0.5)]
HYBRID_WEIGHTS = {
    "text": 0.5, "vector": 0.5, "aircraft": 0.20, "es": 0.25, "ata": 0.10,
    "type": 0.10, "ocr": 0.05,
}
