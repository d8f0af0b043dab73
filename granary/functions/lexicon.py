"""Word lists and patterns whose members decide results. Operators take them as parameters."""

# Intent signals (substrings of the lower-cased question).
RECORDKEEPING = ("what records", "which records", "maintain", "keep", "recordkeeping", "log", "register", "what should be", "what to", "document in", "enter in", "record in")
PROCEDURAL = ("how to", "procedure for", "steps to", "process for", "what is the procedure", "how do i", "how should", "method", "way to", "approach to")
SUMMARIZATION = (
    "summarize", "summary of", "summarise", "overview of", "brief overview", "explain the", "what is covered in", "what does the", "tell me about", "explain", "describe",
    "give me an overview", "what are the main", "key points", "main topics", "contents of", "what's in the", "give me a summary",
)
DOCUMENT_PATTERNS = (
    r"passage planning\s*(document|manual|section|chapter|procedure)?",
    r"(chapter|section|doc|document|manual)\s+\d+",
    r"(the|this)\s+(document|manual|chapter|section|procedure)",
    r"np\s*\d+",
    r"(solas|ism|marpol|stcw)\s*(chapter|part|section)?",
)
WH_WORDS = ("what", "how", "when", "where", "why", "who")

# Entities: name and the patterns that show it, between word boundaries.
ENTITIES = {
    "regulations": (("ISM Code", (r"ism\s*code", "ism")), ("SOLAS", ("solas",)), ("MARPOL", ("marpol",)), ("STCW", ("stcw",)), ("ISPS", ("isps", r"isps\s*code")), ("MLC", ("mlc", r"mlc\s*2006")), ("IMDG", ("imdg", r"imdg\s*code"))),
    "equipment": (("ECDIS", ("ecdis",)), ("Radar", ("radar",)), ("GPS", ("gps", "gnss")), ("VHF", ("vhf",)), ("AIS", ("ais",)), ("EPIRB", ("epirb",)), ("SART", ("sart",)), ("Lifeboat", (r"life\s*boat", "lifeboat")), ("Life Raft", (r"life\s*raft",))),
    "personnel": (("Master", ("master", "captain")), ("Chief Officer", (r"chief\s*officer", r"chief\s*mate")), ("Chief Engineer", (r"chief\s*engineer",)), ("Navigation Officer", (r"navigation\s*officer",)), ("OOBW", ("oobw", r"officer\s*of\s*the\s*watch"))),
    "procedures": (("Fire Drill", (r"fire\s*drill",)), ("Boat Drill", (r"boat\s*drill",)), ("Emergency Response", (r"emergency\s*response",)), ("Passage Planning", (r"passage\s*plan(?:ning)?",)), ("Risk Assessment", (r"risk\s*assessment",))),
}
FORMS = r"\b(NP\s*\d{3,4}[A-Z]?|CG[-\s]?\d{4}[A-Z]?|[A-Z]{2,3}[-\s]?\d{2,4}[A-Z]?)\b"
FORM_KEYWORDS = ("passage planning", "recordkeeping", "ECDIS")
GENERIC_STARTERS = ("what", "which", "how", "where", "when", "who", "list")

# Sections that an intent looks for, and markers that are set off in a passage.
SECTIONS = {
    "recordkeeping": ("recordkeeping", "records", "documentation", "maintain following"),
    "procedural": ("process", "procedure", "steps", "how to", "method"),
    "checking": ("checking", "assurance", "verification", "validation"),
    "requirements": ("requirements", "compliance", "must", "shall"),
}
MARKERS = ("Process", "Procedure", "Responsibility", "Checking & Assurance", "Checking", "Assurance", "Recordkeeping", "Records", "Documentation", "Requirements", "Compliance", "Instructions")
END_MARKERS = (*MARKERS, "Notes", "References", "Background")

# Rule mining.
STOP = tuple(
    "a an the and or of to in on for by with without within from into over under up down is are was were be been being shall should must may can could would will as at that this these those which who whom whose it its their there here".split()
)
GENERIC = tuple(
    "vessel ship company master officer crew personnel staff procedure procedures policy policies ensure ensured ensuring checked verify verified compliant compliance record records document documented documentation report reporting system systems equipment operations operation operational management meeting meetings risk risks item items type types all where during any use using onboard".split()
)
NOISY = (r"\bup\s*to\s*date\b", r"\buptodate\b", r"\bupto\s*date\b", r"\bupdated?\b", r"\bnot\s+answered\b", r"\bnot\s+marked\b", r"\bn/?a\b", r"^\d+$", r"^[\W_]+$")
HEADING_WORDS = ("record", "responsibility", "objective", "requirement", "general", "process", "procedure", "compliance", "monitoring", "execution", "planning", "appraisal", "assessment", "validation")
CALLOUTS = ("recordkeeping", "records", "documentation", "documents to be retained")
