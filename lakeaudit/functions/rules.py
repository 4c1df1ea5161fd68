"""The detection rules: fixed values that other tools' results depend on.

Each row: category, confidence, flags (i: either case), reason, label pattern,
value pattern, what must follow, and words of which a text must hold one (lower
case) for the rule to be worth running; no words: the text must hold a digit.
The whole match is label + value + follow; the span is that of the value.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# --- fixed values -----------------------------------------------------------
_STREET = r"\d+\s+(?:[A-Z][A-Za-z.'’-]+\s+){1,6}(?:Rd|Road|St|Street|Ave|Avenue|Blvd|Boulevard|Lane|Ln|Drive|Dr|Court|Ct|Circle|Cir|Way|Place|Pl)\.?"
_UNIT = r"(?:,\s*(?:Apt|Apartment|Suite|Ste|Unit|#)\s*[\w-]+)?(?:,\s*[A-Z][A-Za-z .'-]+,\s*[A-Z]{2}\s+\d{5}(?:-\d{4})?)?"
_NUMBER = r"(?:\+?1[-.\s]?)?(?:\(\d{3}\)|\d{3})[-.\s]?\d{3}[-.\s]?\d{4}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_ANY, _SET = r"\s*[:=#]?\s*", r"\s*[:=]\s*"
TABLE = [
    ("name", 0.86, "", "Matched a labeled synthetic person name.", r"\b(?:Patient|Patient Name|Member|Member Name|Subscriber|Subscriber Name|Name|Full Name|Emergency Contact|Spouse)\s*:\s*", r"[A-Z][A-Za-z'’-]+(?:\s+[A-Z]\.)?(?:\s+[A-Z][A-Za-z'’-]+){1,3}", r"\b", ["patient", "member", "subscriber", "name", "contact", "spouse"]),
    ("name", 0.84, "", "Matched a labeled comma-form person name.", r"\b(?:Patient|Member|Subscriber|Name)\s*:\s*", r"[A-Z][A-Za-z'’-]+,\s*[A-Z][A-Za-z'’-]+(?:\s+[A-Z]\.)?", r"\b", ["patient", "member", "subscriber", "name"]),
    ("dob", 0.95, "i", "Matched a labeled date of birth.", r"\b(?:DOB|Date of birth|Birth date|Birthdate)" + _SET, r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}", r"\b", ["dob", "birth"]),
    ("date", 0.82, "i", "Matched an individual-related healthcare date.", r"\b(?:admission date|admitted|discharge date|discharged|date of service|service date|appointment date|death date|visit date)\s*[:=]?\s*", r"\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{2,4}|[A-Z][a-z]+ \d{1,2}, \d{4}", r"\b", ["date", "admitted", "discharged"]),
    ("phone", 0.92, "i", "Matched a phone number.", r"(?<!\d)", _NUMBER + r"(?:\s*(?:x|ext\.?|extension)\s*\d{1,6})?", r"(?!\d)", []),
    ("fax", 0.90, "i", "Matched a labeled fax number.", r"\b(?:fax|facsimile)" + _SET, _NUMBER, r"(?!\d)", ["fax", "facsimile"]),
    ("email", 0.94, "i", "Matched an email address.", r"\b", r"[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", r"\b", ["@"]),
    ("ssn", 0.96, "i", "Matched a labeled Social Security number.", r"\b(?:SSN|Social Security(?: Number)?)\s*[:=]?\s*", r"\d{3}-\d{2}-\d{4}|XXX-XX-\d{4}", r"\b", ["ssn", "social security"]),
    ("address", 0.90, "i", "Matched a labeled street address.", r"\baddress" + _SET, _STREET + _UNIT, r"\b", ["address"]),
    ("address", 0.78, "", "Matched a street address pattern.", r"\b", _STREET + _UNIT, r"\b", []),
    ("address", 0.88, "i", "Matched a post office box address.", r"\b", r"P\.?O\.?\s+Box\s+\d{2,10}", r"\b", ["box"]),
    ("zip_code", 0.86, "i", "Matched a labeled ZIP or postal code.", r"\b(?:ZIP|ZIP code|postal code)\s*[:=]?\s*", r"\d{5}(?:-\d{4})?", r"\b", ["zip", "postal"]),
    ("member_id", 0.95, "i", "Matched a labeled member, subscriber, or health plan identifier.", r"\b(?:Member ID|member_id|subscriber(?: id)?|subscriber_id|beneficiary(?: number| id)?|health plan(?: beneficiary)?(?: number| id)?)" + _ANY, r"(?=[A-Z0-9-]*\d)[A-Z0-9]{2,}(?:-[A-Z0-9]{2,})*", r"\b", ["member", "subscriber", "beneficiary", "health"]),
    ("member_id", 0.94, "i", "Matched a synthetic member identifier.", r"\b", r"MBR-SYN-\d{4,}", r"\b", ["mbr-"]),
    ("claim_id", 0.93, "i", "Matched a labeled claim or authorization identifier.", r"\b(?:Claim ID|claim_id|claim number|claim|authorization(?: number| id)?|auth(?: number| id)?)" + _ANY, r"(?=[A-Z0-9-]*\d)[A-Z]{2,}-?[A-Z0-9]{2,}(?:-[A-Z0-9]{2,})*", r"\b", ["claim", "auth"]),
    ("claim_id", 0.92, "i", "Matched a synthetic claim identifier.", r"\b", r"CLM-SYN-\d{4,}", r"\b", ["clm-"]),
    ("mrn", 0.97, "i", "Matched a labeled medical record number.", r"\b(?:MRN|mrn|Medical Record(?: Number)?|Record No\.?)" + _ANY, r"[A-Z]*-?\d[\dA-Z-]{3,}", r"\b", ["mrn", "record"]),
    ("policy_number", 0.90, "i", "Matched a labeled policy number.", r"\b(?:Policy No\.?|Policy Number|policy_number)" + _ANY, r"[A-Z0-9]{2,}(?:-[A-Z0-9]{2,})+", r"\b", ["policy"]),
    ("group_number", 0.88, "i", "Matched a labeled group number.", r"\b(?:Group No\.?|Group Number|group_number)" + _ANY, r"[A-Z0-9]{2,}(?:-[A-Z0-9]{2,})*", r"\b", ["group"]),
    ("account_number", 0.88, "i", "Matched a labeled account number.", r"\b(?:Account No\.?|Account Number|account_number|Acct #?)" + _ANY, r"[A-Z0-9-]{5,}", r"\b", ["account", "acct"]),
    ("license_number", 0.86, "i", "Matched a labeled license or certificate number.", r"\b(?:License No\.?|License Number|Certificate No\.?|Certificate Number)" + _ANY, r"[A-Z0-9-]{5,}", r"\b", ["license", "certificate"]),
    ("vehicle_id", 0.86, "i", "Matched a labeled vehicle identifier.", r"\b(?:VIN|Vehicle ID|License Plate|Plate)" + _ANY, r"[A-HJ-NPR-Z0-9-]{5,17}", r"\b", ["vin", "vehicle", "plate"]),
    ("device_id", 0.84, "i", "Matched a labeled device identifier.", r"\b(?:Device ID|Device Serial|Serial Number|serial)" + _ANY, r"[A-Z0-9-]{5,}", r"\b", ["device", "serial"]),
    ("url", 0.90, "i", "Matched a URL.", r"\b", r"https?://[^\s<>\]\)\"']+", "", ["http"]),
    ("ip_address", 0.90, "", "Matched an IPv4 address.", r"\b", rf"(?:{_OCTET}\.){{3}}{_OCTET}", r"\b", []),
]
#: How matches of each rule begin, in lower case for rules of either case: a pattern of one width, and the width; None: anyhow.
STARTS = [
    ("Pat|Mem|Sub|Nam|Ful|Eme|Spo", 3), ("Pat|Mem|Sub|Nam", 3), ("dob|dat|bir", 3), ("adm|dis|dat|ser|app|dea|vis", 3), (r"[(+0-9](?<![0-9][(+0-9])", 1), ("fax|fac", 3), None, ("ssn|soc", 3), ("add", 3), (r"[0-9](?<![0-9A-Za-z_][0-9])", 1), ("po|p[.]", 2),
    ("zip|pos", 3), ("mem|sub|ben|hea", 3), ("mbr", 3), ("cla|aut", 3), ("clm", 3), ("mrn|med|rec", 3), ("pol", 3), ("gro", 3), ("acc", 3), ("lic|cer", 3), ("vin|veh|lic|pla", 3), ("dev|ser", 3), None, (r"[0-9](?:[.][0-9][\s\S]|[0-9][.][0-9]|[0-9][0-9][.])", 4),
]
LAYERS = ["user_message", "rag_context", "tool_output", "model_input", "memory", "debug_log"]
DESTINATION_LAYERS = [*LAYERS, "model_provider"]
RANK = {"allowed": 0, "redact": 1, "violation": 2}
PHI_STATUSES = ["non_phi", "synthetic", "deidentified", "real_phi"]
NER_CATEGORIES = {"PERSON": "name", "PHONE_NUMBER": "phone", "EMAIL_ADDRESS": "email", "LOCATION": "address", "DATE_TIME": "date", "US_SSN": "ssn", "IP_ADDRESS": "ip_address", "URL": "url", "US_DRIVER_LICENSE": "license_number", "CREDIT_CARD": "account_number"}
# --- end of fixed values ----------------------------------------------------

CATEGORIES = list(dict.fromkeys(r[0] for r in TABLE))


@dataclass(frozen=True)
class Rule:
    number: int
    category: str
    confidence: float
    reason: str
    pattern: re.Pattern
    words: tuple[str, ...]


RULES = tuple(Rule(i, c, f, why, re.compile(f"{label}({value}){after}", re.I if flags else 0), tuple(words)) for i, (c, f, flags, why, label, value, after, words) in enumerate(TABLE))
