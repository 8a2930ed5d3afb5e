"""Word lists, patterns, maps and formats that decide the results.

Everything here is data.  Patterns are Java regular expressions.  ``\\b`` and ``\\s`` differ
between Java releases and from the Unicode meaning wanted here, so word edges and white space
are spelled out.
"""

import string

# --- character classes ---------------------------------------------------------------------
# Java looks a class up in one table for the Latin-1 characters that it names one by one, but asks each
# range and each property in turn.  So the classes that are tried at every place name theirs.
_LETTERS, _DIGITS = string.ascii_letters, string.digits
ALNUM = _LETTERS + _DIGITS
HEX = f"[{string.hexdigits}]"
_LATIN_1_WORD = "".join(
    rf"\x{code:02x}" for code in (0xAA, 0xB2, 0xB3, 0xB5, 0xB9, 0xBA, 0xBC, 0xBD, 0xBE, *range(0xC0, 0x100)) if code not in (0xD7, 0xF7)
)
# [\p{L}\p{N}_]
WORD = rf"[{ALNUM}_{_LATIN_1_WORD}[\x{{100}}-\x{{10ffff}}&&[\p{{L}}\p{{N}}]]]"
EDGE_BEFORE = rf"(?<!{WORD})"
EDGE_AFTER = rf"(?!{WORD})"
EDGE = rf"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
# Single Latin-1 characters become one table look-up; the others are kept behind a range check.
SPACE_CHARS = (
    r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0[\x{1680}-\x{3000}&&"
    r"[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
)
SPACE = f"[{SPACE_CHARS}]"
NONSPACE = f"[^{SPACE_CHARS}]"
SPACES = f"{SPACE}+"

# --- normalised indicator table: fixed column order ------------------------------------------
INDICATOR_COLUMNS = [
    ("source", "string"),
    ("indicator_type", "string"),
    ("indicator_value", "string"),
    ("threat_category", "string"),
    ("malicious_verdicts", "int"),
    ("total_verdicts", "int"),
    ("confidence_score", "double"),
    ("severity", "string"),
    ("tags", "array<string>"),
    ("country", "string"),
    ("asn", "bigint"),
    ("asn_owner", "string"),
    ("source_reference", "string"),
    ("description", "string"),
    ("first_seen", "string"),
    ("last_seen", "string"),
    ("processed_at", "string"),
]

# --- entity patterns, in extraction order ------------------------------------------------------
IPV4 = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
IPV6 = rf"(?:{HEX}{{1,4}}:){{7}}{HEX}{{1,4}}"
# Java's matcher calls itself for every turn of a group that may give back, but not of a group that
# may not (``*+``, ``++``).  So the loops below never give back: a turn looks ahead for a valid end.
_LABEL = rf"[{ALNUM}](?:[{ALNUM}-]{{0,61}}[{ALNUM}])?"
_ENDING = rf"[{_LETTERS}]{{2,}}+{EDGE_AFTER}"
# Whole labels up to the last one that an ending follows.  A label after another one starts nothing
# new, and the first look-ahead spares plain words the rest.
DOMAIN = (
    rf"(?=[{ALNUM}][{ALNUM}-]{{0,62}}+\.)"
    rf"(?:(?<!\.)|(?<!{EDGE_BEFORE}{_LABEL}\.))"
    rf"(?:(?:{_LABEL}\.(?!{_ENDING}))*+{_LABEL}\.(?={_ENDING}))++[a-zA-Z]{{2,}}"
)
_HOST = r"[-\p{L}\p{N}_.]"
_PCT = r"%[\p{Nd}a-fA-F]{2}"
_URL_PATH = r"[-\p{L}\p{N}_%!$&'()*+,;=:~]"
_URL_TAIL = r"[-\p{L}\p{N}_%!$&'()*+,;=:~/.]"
# A part of the path, and a part of the host, that can be the last one.
_LAST_PART = f"/{_URL_PATH}+{EDGE}"
_LAST_HOST = f"{_HOST}*{EDGE}"
# Everything as long as it goes; else up to the last part of the path, or of the host, that can end
# a URL.
URL = (
    rf"https?://(?:{_HOST}|{_PCT})(?:"
    rf"{_HOST}*+(?:{_PCT}{_HOST}*+)*+(?:/{_URL_PATH}++)*+(?:\?{_URL_TAIL}+)?(?:#{_URL_TAIL}+)?{EDGE}"
    rf"|{_HOST}*+(?:{_PCT}{_HOST}*+)*+"
    rf"(?:/{_URL_PATH}++(?=(?:(?!{_LAST_PART})/{_URL_PATH}++)*+{_LAST_PART}))*+{_LAST_PART}"
    rf"|(?:{_HOST}*+{_PCT}(?=(?:(?!{_LAST_HOST}){_HOST}*+{_PCT})*+{_LAST_HOST}))*+{_LAST_HOST})"
)
CVE = r"(?i:CVE)-\p{Nd}{4}-\p{Nd}{4,7}"
# The at sign ends the local part, so nothing is gained by giving characters back.
_LOCAL_PART = f"[{ALNUM}._%+-]"
EMAIL = rf"{_LOCAL_PART}++@[{ALNUM}.-]+\.[A-Z|a-z]{{2,}}"
# Where a match can begin at all; tried first.
BEGINNINGS = {
    "ipv4": "(?=[0-9])",
    "ipv6": f"(?={HEX})",
    "domain": f"(?=[{ALNUM}])",
    "url": "(?=h)",
    "hash": f"(?={HEX})",
    "cve": "(?=[cC])",
    "email": f"(?={_LOCAL_PART})",
}
HEX_LENGTHS = {"md5": 32, "sha1": 40, "sha256": 64}

ENTITY_TYPES = ["ipv4", "ipv6", "domain", "url", "md5", "sha1", "sha256", "cve", "email"]
FALSE_POSITIVES = {
    "ipv4": ["0.0.0.0", "127.0.0.1", "255.255.255.255"],
    "domain": ["example.com", "domain.com"],
}
CONTEXT_CHARS = 50
ENTITY_TO_INDICATOR = {
    "ipv4": "ip",
    "ipv6": "ip",
    "domain": "domain",
    "url": "url",
    "md5": "hash",
    "sha1": "hash",
    "sha256": "hash",
    "cve": "cve",
    "email": "email",
}
EXTRACTED_SOURCE = "nlp_extraction"

# Private, loopback, multicast and reserved networks as inclusive integer ranges, and the two
# addresses inside 192.0.0.0/24 that are public.
IPV4_EXCLUDED = [
    (0, 16777215),
    (167772160, 184549375),
    (2130706432, 2147483647),
    (2851995648, 2852061183),
    (2886729728, 2887778303),
    (3221225472, 3221225727),
    (3221225984, 3221226239),
    (3232235520, 3232301055),
    (3323068416, 3323199487),
    (3325256704, 3325256959),
    (3405803776, 3405804031),
    (3758096384, 4294967295),
]
IPV4_INCLUDED_ANYWAY = [3221225481, 3221225482]

# --- text cleaning ---------------------------------------------------------------------------------
PROTECTED_HASH = r"[a-fA-F0-9]{32,64}"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# --- relationship phrases: {S} source token, {T} target token ---------------------------------------
RELATION_PHRASES = [
    ("communicates_with", "{S} communicates with {T}"),
    ("communicates_with", "{S} connects to {T}"),
    ("communicates_with", "{S} reached out to {T}"),
    ("communicates_with", "connection(?:s)? (?:from|between) {S} (?:to|and) {T}"),
    ("contains", "{S} contains {T}"),
    ("contains", "{S} embeds {T}"),
    ("contains", "{S} dropped {T}"),
    ("contains", "{T} (?:was|were) found in {S}"),
    ("hosted_on", "{S} (?:is|was) hosted on {T}"),
    ("hosted_on", "{T} hosts {S}"),
    ("hosted_on", "{S} (?:resides|located) on {T}"),
    ("exploits", "{S} exploits {T}"),
    ("exploits", "{T} (?:is|was) exploited by {S}"),
    ("exploits", "exploitation of {T} by {S}"),
    ("attributed_to", "{S} (?:is|was) attributed to {T}"),
    ("attributed_to", "{T} (?:is|was) responsible for {S}"),
    ("attributed_to", "{T}(?:'s)? campaign using {S}"),
]
PHRASE_CONFIDENCE = 0.9
MAX_TOKENS_BETWEEN = 10

# --- severity -----------------------------------------------------------------------------------------
SEVERITY_KEYWORDS = [
    ("active exploitation", "critical", 1.0),
    ("zero-day", "critical", 1.0),
    ("zero day", "critical", 1.0),
    ("widespread", "critical", 0.9),
    ("ransomware", "critical", 0.9),
    ("data breach", "critical", 0.9),
    ("massive", "critical", 0.8),
    ("critical vulnerability", "critical", 1.0),
    ("critical impact", "critical", 1.0),
    ("significant damage", "critical", 0.9),
    ("national security", "critical", 0.9),
    ("emergency patch", "critical", 0.9),
    ("immediate action", "critical", 0.8),
    ("high impact", "high", 0.8),
    ("high risk", "high", 0.8),
    ("exploit available", "high", 0.8),
    ("actively targeting", "high", 0.7),
    ("vulnerability", "high", 0.6),
    ("serious", "high", 0.7),
    ("important patch", "high", 0.7),
    ("data loss", "high", 0.7),
    ("privilege escalation", "high", 0.7),
    ("remote code execution", "high", 0.7),
    ("unauthorized access", "high", 0.7),
    ("moderate", "medium", 0.6),
    ("potential impact", "medium", 0.5),
    ("could affect", "medium", 0.5),
    ("may lead to", "medium", 0.5),
    ("limited impact", "medium", 0.5),
    ("security bulletin", "medium", 0.5),
    ("security advisory", "medium", 0.5),
    ("information disclosure", "medium", 0.5),
    ("denial of service", "medium", 0.5),
    ("low impact", "low", 0.3),
    ("minor", "low", 0.3),
    ("minimal", "low", 0.3),
    ("unlikely", "low", 0.2),
    ("theoretical", "low", 0.2),
    ("low priority", "low", 0.3),
    ("low risk", "low", 0.3),
]
LEVEL_FACTORS = {"critical": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25}
LEVEL_BANDS = [("critical", 0.8), ("high", 0.6), ("medium", 0.4)]
CVSS = rf"(?i)CVSS(?:v\p{{Nd}})?{SPACES}(?:Base{SPACES})?Score:{SPACE}*(\p{{Nd}}+\.\p{{Nd}}+)"
CVSS_BANDS = [("critical", 9.0), ("high", 7.0), ("medium", 4.0)]
CVSS_WEIGHT = 2.0
NEGATIONS = ["not", "no longer", "isn't", "doesn't", "won't", "cannot", "can't", "never"]
MITIGATIONS = ["mitigated", "resolved", "fixed", "patched", "addressed"]
NEGATION_WORDS = 10
NO_EVIDENCE = "No severity indicators found in text"

# --- model ------------------------------------------------------------------------------------------------
HIGH_RISK_TAGS = ["malware", "apt", "botnet", "ransomware", "phishing"]
MODEL_FEATURES = ["indicator_type", "source"]
MISSING_CATEGORY = "missing"
TEST_SIZE = 0.2
SEED = 42
REQUEST_FIELDS = ["indicator_type", "source"]
REQUEST_TYPES = ["ip", "domain", "url", "file_hash", "email"]
REQUEST_SOURCES = ["alienvault", "virustotal", "mandiant", "recorded_future", "other"]

# --- policies ---------------------------------------------------------------------------------------------
RESOURCE_KINDS = {
    "instances": "Instance",
    "buckets": "Bucket",
    "disks": "Disk",
    "firewalls": "Firewall",
    "topics": "Topic",
    "subscriptions": "Subscription",
    "services": "Service",
    "clusters": "Cluster",
}
PUBLIC_MEMBERS = ["allUsers", "allAuthenticatedUsers"]
READER_ROLES = ["roles/storage.objectViewer", "roles/storage.legacyObjectReader"]
AUDITED_METHODS = [
    ("compute.googleapis.com", "beta.compute.instances.insert"),
    ("compute.googleapis.com", "beta.compute.instances.update"),
    ("storage.googleapis.com", "storage.setIamPermissions"),
]
IMAGE_RESOURCE_TYPES = [
    "run.googleapis.com/Service",
    "container.googleapis.com/Cluster",
    "cloudfunctions.googleapis.com/Function",
]
SIGNATURE_ISSUER = "https://accounts.google.com"
SIGNATURE_IDENTITY = r".*@your-builder-project\.iam\.gserviceaccount\.com"

# --- raw zone ------------------------------------------------------------------------------------------------
NORMALISED_SOURCES = ["alienvault", "virustotal", "scc", "asset"]
DEFAULT_SOURCES = ["alienvault", "virustotal"]
RAW_RETENTION_DAYS = 90
