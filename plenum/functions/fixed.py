"""Word lists, patterns and lookup tables whose content decides the results.

Patterns are written so that Java's regex engine and RE2 read them alike. ``WS``, ``NWS`` and
``WORD`` spell out Unicode white space and word characters instead of relying on ``(?U)``.
"""

from typing import NamedTuple


class Issue(NamedTuple):
    """An issue that a rule adds."""

    primary_category: str
    secondary_category: str
    stance: str
    specific_concern: str
    is_root_cause: bool


# Character classes
WS = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
NWS = r"[^\s\x0B\x1C-\x1F\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS_OR_WORD = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}\p{L}\p{N}_]"

# US states
STATES = {
    "ALABAMA": "AL", "ALASKA": "AK", "ARIZONA": "AZ", "ARKANSAS": "AR", "CALIFORNIA": "CA", "COLORADO": "CO",
    "CONNECTICUT": "CT", "DELAWARE": "DE", "FLORIDA": "FL", "GEORGIA": "GA", "HAWAII": "HI", "IDAHO": "ID",
    "ILLINOIS": "IL", "INDIANA": "IN", "IOWA": "IA", "KANSAS": "KS", "KENTUCKY": "KY", "LOUISIANA": "LA",
    "MAINE": "ME", "MARYLAND": "MD", "MASSACHUSETTS": "MA", "MICHIGAN": "MI", "MINNESOTA": "MN", "MISSISSIPPI": "MS",
    "MISSOURI": "MO", "MONTANA": "MT", "NEBRASKA": "NE", "NEVADA": "NV", "NEW HAMPSHIRE": "NH", "NEW JERSEY": "NJ",
    "NEW MEXICO": "NM", "NEW YORK": "NY", "NORTH CAROLINA": "NC", "NORTH DAKOTA": "ND", "OHIO": "OH",
    "OKLAHOMA": "OK", "OREGON": "OR", "PENNSYLVANIA": "PA", "RHODE ISLAND": "RI", "SOUTH CAROLINA": "SC",
    "SOUTH DAKOTA": "SD", "TENNESSEE": "TN", "TEXAS": "TX", "UTAH": "UT", "VERMONT": "VT", "VIRGINIA": "VA",
    "WASHINGTON": "WA", "WEST VIRGINIA": "WV", "WISCONSIN": "WI", "WYOMING": "WY",
}
# with the District of Columbia
STATE_CODES = [*STATES.values(), "DC"]

# Record cleaning
NAME_SUFFIXES = ["Jr", "Sr", "II", "III", "IV", "V"]
OFFICE_WORDS = ["Board", "Council", "Mayor", "School", "District"]
FEDERAL_LEVELS = ["FEDERAL", "FEDERAL-DOWNLOAD", "PRESIDENTIAL"]
STATE_LEVELS = ["STATE", "STATE LEGISLATIVE", "STATEWIDE", "LEGISLATIVE"]
LOCAL_LEVELS = [
    "LOCAL", "CITY", "COUNTY", "TOWNSHIP", "TOWN", "MUNICIPAL", "REGIONAL", "SCHOOL BOARD",
    "MAYOR", "TOWN COUNCIL", "CLERK/TREASURER", "BALLOT INITIATIVE", "COUNTY/CITY",
    "COUNTY COUNCIL",
]
LOCAL_KEYWORDS = ["LOCAL", "CITY", "COUNTY", "TOWNSHIP", "MUNICIPAL", "REGIONAL"]
PARTY_SPELLINGS = {
    "nonpartisan": "Nonpartisan",
    "independent": "Independent",
    "Nonparisan": "Nonpartisan",
    "Nonpartisian": "Nonpartisan",
    "Non Partisan": "Nonpartisan",
    "Libertarian Party": "Libertarian",
}
ELECTION_TYPES = ["primary", "runoff", "general"]
MUNICIPAL_WORDS = ["council", "mayor", "alderman", "commissioner"]
FEDERAL_WORDS = ["house", "senate", "congress"]

# Opt-out and non-substantive messages
STOP_WORDS = ["stop", "unsubscribe"]
STOP_PATTERNS = [
    r"stop$",
    r"unsubscribe$",
    rf"remove{WS}+me$",
    rf"opt{WS}+out$",
    r"cancel$",
    r"end$",
    r"quit$",
    rf"don'?t{WS}+text{WS}+me",
    rf"stop{WS}+texting",
    rf"remove{WS}+from{WS}+list",
    rf"take{WS}+me{WS}+off",
    rf"no{WS}+more{WS}+texts?",
    rf"delete{WS}+my{WS}+number",
]
EMOJI = r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
GREETING_PATTERNS = [
    r"(?:hi|hello|hey)",
    r"(?:thanks?|thank\s+you)",
    r"(?:good\s+morning|good\s+afternoon|good\s+evening)",
    r"(?:ok|okay|yes|no|sure|absolutely)",
    r"(?:got\s+it|understood|makes\s+sense)",
    r"(?:will\s+do|sounds\s+good|perfect)",
]
EXCLAMATION_PATTERNS = [
    r"(?:great|good|nice)",
    r"(?:awesome|cool|sweet)",
    r"(?:lol|haha|wow|omg)",
]
WRONG_PERSON_PATTERNS = [
    rf"wrong{WS}+number",
    rf"not{WS}+interested",
    rf"don'?t{WS}+live{WS}+(?:here|there|in)",
    rf"moved{WS}+(?:away|out)",
]
SHORT_CIVIC_PATTERNS = [
    r"tax(?:es)?", r"truck", r"traffic", r"water", r"read", r"parks?", r"school", r"police",
    r"crime", r"business", r"develop(?:ment)?", r"zoning", r"housing", r"utilities?",
]
REACTION_EMOJI = "👍👎❤️😀😊🙂🙁😢😡🤔💯🔥✨🎉👏🤝💪🚀⭐"
OPT_OUT_PATTERNS = [
    rf"stop{WS}*$",
    rf"unsubscribe{WS}*$",
    rf"remove{WS}+me{WS}*$",
    rf"opt{WS}*out{WS}*$",
    rf"👍{WS}+to{WS}+.*$",
    rf"👍{WS}*$",
    rf"👎{WS}*$",
    rf"❤️{WS}*$",
    rf"😀{WS}*$",
    rf"😊{WS}*$",
    rf"[{REACTION_EMOJI}]+{WS}*$",
    rf".{{1,2}}{WS}*$",
]
CIVIC_KEYWORDS = [
    "roads", "traffic", "construction", "sidewalks", "bridges", "water", "sewer",
    "streetlights", "potholes", "snow removal", "garbage", "recycling", "utilities",
    "police", "fire", "emergency", "schools", "education", "library", "parks",
    "recreation", "senior center", "health", "hospital", "clinic",
    "business", "development", "zoning", "permits", "taxes", "budget", "revenue",
    "jobs", "employment", "economic", "retail", "commercial", "industrial",
    "mayor", "council", "trustee", "alderman", "meeting", "vote", "election",
    "ordinance", "policy", "regulation", "transparency", "accountability",
    "housing", "affordable", "subdivision", "planning", "growth",
    "density", "rezoning", "variances", "building",
    "public transit", "bus", "train", "parking", "bike lanes", "pedestrian",
    "traffic lights", "stop signs", "speed limit",
    "environment", "pollution", "noise", "air quality", "green space",
    "sustainability", "energy", "solar", "climate",
    "safety", "crime", "drugs", "homelessness", "youth", "seniors",
    "accessibility", "diversity", "inclusion", "neighborhood",
]

# What heavy cleaning takes out of a text
LINK_PATTERN = r"https?://[a-z!$-_]+"
#: Anchoring at the word start changes no match and keeps long words linear.
ADDRESS_PATTERN = rf"(?<!{NWS}){NWS}+@{NWS}+"
PHONE_PATTERN = r"(?U)\b\d{3}-\d{3}-\d{4}\b|\b\(\d{3}\)\s*\d{3}-\d{4}\b"

# Rule-based classification
UNCATEGORIZED_RULES = [
    (
        "federal/national political issue",
        [r"trump", r"biden", r"federal", r"president", r"democrat", r"republican",
         r"national\s+election", r"congress", r"senate"],
    ),
    (
        "wrong number/location",
        [r"wrong\s+number", r"don't\s+live", r"moved\s+out", r"not\s+eligible",
         r"different\s+state", r"connecticut", r"florida"],
    ),
    (
        "personal attack without substantive content",
        [r"fuck\s+off", r"fuck\s+you", r"go\s+to\s+hell", r"🖕"],
    ),
    (
        "simple acknowledgment without issues",
        [rf"^(?:thanks?|thank\s+you){WS_OR_WORD}*$",
         rf"^(?:great|good)\s*(?:thanks?)?{WS_OR_WORD}*$",
         rf"^(?:hi|hello|hey){WS_OR_WORD}*$"],
    ),
    (
        "general support without specific issues",
        [r"happy\s+that\s+you\s+were\s+elected", r"glad\s+that\s+you\s+reached\s+out",
         r"i'll\s+be\s+watching"],
    ),
]
EBIKE_TRIGGERS = [r"e-?bike", r"electric\s+bike", r"e-?scooter", r"electric\s+scooter"]
ENFORCEMENT_WORDS = [r"enforcement", r"fine", r"ticket", r"police", r"ban", r"ordinance"]
# Patterns that call for issues, and the category keys that they rule out
CATEGORY_RULES = [
    {
        "triggers": [r"truck\s+traffic", r"semi\s+truck", r"warehouse", r"intermodal",
                     r"cn\s+rail", r"rail\s+yard", r"data\s+center", r"industrial"],
        "required": [
            Issue(
                primary_category="infrastructure_and_transportation", secondary_category="roads_and_bridges", stance="negative",
                specific_concern="truck traffic impact on roads", is_root_cause=False,
            ),
            Issue(
                primary_category="housing_and_development", secondary_category="zoning_and_permits", stance="negative",
                specific_concern="zoning approvals enabling development", is_root_cause=True,
            ),
        ],
        "avoid": [],
    },
    {
        "triggers": [r"property\s+tax", r"home\s+tax", r"house\s+tax", r"property\s+taxes"],
        "required": [
            Issue(
                primary_category="housing_and_development", secondary_category="taxes_and_assessments", stance="negative",
                specific_concern="property tax burden", is_root_cause=False,
            ),
        ],
        "avoid": ["government_operations/budget_and_taxes"],
    },
    {
        "triggers": EBIKE_TRIGGERS,
        "required": [
            Issue(
                primary_category="infrastructure_and_transportation", secondary_category="transit_and_walkways", stance="neutral",
                specific_concern="e-bike/scooter infrastructure needs", is_root_cause=False,
            ),
        ],
        "avoid": [],
    },
    {
        "triggers": [r"water\s+bill", r"water\s+cost", r"water\s+price"],
        "required": [
            Issue(
                primary_category="quality_of_life", secondary_category="utilities_and_waste", stance="negative",
                specific_concern="water utility costs", is_root_cause=False,
            ),
        ],
        "avoid": [],
    },
]
BUSINESS_PERMIT_PATTERN = r"business.*permit|permit.*business"
BUSINESS_PERMIT_ISSUE = Issue(
    primary_category="housing_and_development", secondary_category="zoning_and_permits", stance="negative",
    specific_concern="zoning/permits enabling business issues", is_root_cause=True,
)
TRUCK_WORDS = ["truck", "warehouse", "intermodal", "cn rail", "data center"]
NEGATIVE_CONCERN_WORDS = ["too high", "bad", "terrible", "awful", "problem"]
POSITIVE_CONCERN_WORDS = ["great", "good", "love", "excellent", "wonderful"]
STANCES = ["negative", "requesting", "positive", "neutral"]
TAXONOMY = {
    "infrastructure_and_transportation": {
        "roads_and_bridges": "Roads, bridges, pavement, traffic management",
        "transit_and_walkways": "Public transit, sidewalks, bike lanes",
        "lighting_and_signage": "Street lighting, traffic signs, speed limit signs",
    },
    "public_safety": {
        "police": "Police services, crime prevention",
        "fire_and_ems": "Fire/EMS response",
        "emergency_management": "Emergency management, disaster prep",
    },
    "education": {
        "schools": "K-12 schools, funding, performance",
        "school_safety": "School safety, transportation",
        "educational_programs": "After-school programs, special education, extracurriculars",
    },
    "housing_and_development": {
        "affordable_housing": "Affordable housing, homelessness",
        "zoning_and_permits": "Zoning, permits, code enforcement",
        "taxes_and_assessments": "Property taxes, assessments",
    },
    "health_and_human_services": {
        "public_health": "Public health programs",
        "mental_health": "Mental health, substance abuse",
        "senior_and_disability": "Senior services, disability support",
    },
    "economic_development": {
        "jobs_and_business": "Job creation, business support, workforce development",
        "downtown_revitalization": "Downtown revitalization, main street programs",
        "industrial_development": "Warehouses, logistics, manufacturing, industrial zoning",
        "tourism": "Tourism, economic attractions",
    },
    "quality_of_life": {
        "recreation_and_libraries": "Parks, recreation, libraries, community centers",
        "utilities_and_waste": "Trash/recycling, utilities, water/sewer",
        "environmental": "Noise, air quality, environmental concerns",
    },
    "government_operations": {
        "budget_and_taxes": "Budget, taxes, fees",
        "service_and_transparency": "Customer service, transparency",
        "civic_engagement": "Elections, civic engagement, public meetings",
    },
    "other": {
        "uncategorized": "Issues that don't fit standard municipal categories",
        "general_feedback": "General feedback or comments about city services",
    },
}

# Privacy and markup patterns
PII_PATTERNS = {
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "phone": r"\b\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "dob": r"\b(?:0[1-9]|1[0-2])/(?:0[1-9]|[12]\d|3[01])/\d{4}\b",
}
FENCE_TAG = "untrusted_web_content"
DANGEROUS_MARKUP = r"<script|<img\b|javascript:"
MARKUP_PATTERNS = [
    r"(?is)<script[^>]*>.*?</script>",
    r"(?is)<style[^>]*>.*?</style>",
    r"(?s)<!--.*?-->",
    r"<[^>]+>",
    r"[\x{200B}-\x{200F}\x{FEFF}]",
    r"[\x{202A}-\x{202E}]",
]

# Name lists of the confidence calibration
MALE_NAMES = ["stanley", "john", "marco", "kennith", "domingo", "morrio", "jr"]
FEMALE_NAMES = ["susan", "jacqueline", "adrienne", "laura", "verla"]

# Header names of message exports
MESSAGE_HEADERS = {
    "Campaign ID": "campaign_id",
    "Campaign Name": "campaign_name",
    "Contact Phone Number": "contact_phone_number",
    "Carrier": "carrier",
    "Campaign Number": "campaign_number",
    "Is Automatic Reply?": "is_automatic_reply",
    "Send Direction": "send_direction",
    "Send Status": "send_status",
    "Error Code": "error_code",
    "Sent At": "sent_at",
    "Message Text": "message_text",
    "Texter Name": "texter_name",
    "Message Type": "message_type",
    "MMS Attachments": "mms_attachments",
}
POLL_ALIASES = {
    "phone_number": ["phone_number", "Contact Phone Number", "phone", "Phone", "contact_phone"],
    "message_text": ["message_text", "Message Text", "message", "text", "body", "Message"],
    "sent_at": ["sent_at", "Sent At", "timestamp", "date", "created_at"],
    "round": ["round", "Round", "contact_round", "Round Number"],
    "poll_id": ["poll_id", "Poll ID"],
    "campaign_name": ["campaign_name", "Campaign Name"],
    "carrier": ["carrier", "Carrier"],
}
PHONE_HEADERS = ["phone_number", "contact phone number", "phone", "contact_phone_number"]
TEXT_HEADERS = ["message_text", "message text", "message", "text", "body"]
TEXT_COLUMNS = ["Message Text", "text", "message_text", "Message", "message", "content",
                "body", "description"]
TEXT_COLUMN_WORDS = ["text", "message", "content"]
TIMESTAMP_COLUMNS = ["timestamp", "created_at", "date", "time", "created", "sent_at",
                     "received_at"]
DEMOGRAPHICS = ["round", "age_group", "voting_performance_category", "location", "ward",
                "income_level", "education_level", "homeowner_status", "business_owner",
                "has_children_under_18"]

# Usage prices per million tokens (model, input, output)
MODEL_PRICES = [
    ("gemini-2.5-flash", 0.30, 2.50),
    ("gemini-2.5-pro", 1.25, 10.00),
    ("gemini-2.5-flash-lite", 0.10, 0.40),
    ("gemini-embedding-001", 0.15, 0.0),
    ("gemini-3-flash-preview", 0.50, 3.00),
    ("gemini-3-pro-preview", 2.50, 15.00),
    ("gemini-3.5-flash", 1.50, 9.00),
]
DEFAULT_MODEL = "gemini-2.5-flash"

# Scoring ladders of the choice of k as (lower bound, points)
SEPARATION_POINTS = [(50.0, 50), (20.0, 45), (10.0, 40), (5.0, 35), (3.0, 30), (2.0, 25),
                     (1.5, 15), (1.0, 5)]
COHESION_POINTS = [(0.8, 30), (0.7, 25), (0.6, 20), (0.5, 15), (0.4, 10)]
COHESION_FLOOR = 5
# ... and as (upper bound, points)
CV_POINTS = [(0.3, 10), (0.5, 7), (0.7, 5), (1.0, 3)]
LARGEST_SHARE_POINTS = [(20.0, 10), (30.0, 7), (40.0, 5), (50.0, 3)]

# Keyword groups of plan tasks (keywords, result)
THEME_WORDS = [
    (["intro", "introduction", "candidate intro"], "intro"),
    (["gotv", "vote", "election day", "reminder", "polling"], "gotv"),
    (["persuasion", "persuasive", "contrast", "experience"], "persuasive"),
    (["ballot", "early voting", "mail", "absentee"], "early_voting"),
]
THEME_DEFAULT = "persuasive"
EVENT_WORDS = [
    (["launch"], ("events", "Plan event", "launch")),
    (["social", "post", "media"], ("socialMedia", "Write post", "event_promotion")),
    (["meeting", "town hall", "forum", "debate"], ("events", "Attend event", "community_engagement")),
    (["deadline"], ("education", "Get reminder", "deadline_reminder")),
]
EVENT_DEFAULT = ("events", "Plan event", "community_engagement")
