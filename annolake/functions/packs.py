"""Pattern packs, label spaces, surrogate strategies and risk profiles, and their registries."""

from __future__ import annotations

from dataclasses import dataclass, field

# --------------------------------------------------------------------------- fixed values: patterns
# Java syntax. A numbered group, where there is one, is the entity that a match is narrowed to.

US_STATES = (
    "Alabama|Alaska|Arizona|Arkansas|California|Colorado|Connecticut|Delaware|Florida|Georgia|Hawaii|Idaho|Illinois|Indiana|Iowa|Kansas|Kentucky|"
    "Louisiana|Maine|Maryland|Massachusetts|Michigan|Minnesota|Mississippi|Missouri|Montana|Nebraska|Nevada|New Hampshire|New Jersey|New Mexico|"
    "New York|North Carolina|North Dakota|Ohio|Oklahoma|Oregon|Pennsylvania|Rhode Island|South Carolina|South Dakota|Tennessee|Texas|Utah|Vermont|"
    "Virginia|Washington|West Virginia|Wisconsin|Wyoming|District of Columbia|Puerto Rico"
)
MONTH = "Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?"
SEASON = "winter|spring|summer|autumn|fall"
ORDINAL = "(?:st|nd|rd|th)"
HOLIDAY = "Christmas|Thanksgiving|Easter|Hanukkah|Rosh Hashanah|Ramadan|New Year(?:'s)?(?:\\s+Day)?|Independence Day|Memorial Day|Victoria Day|Canada Day|Labour Day|Labor Day|Veterans Day|Mother's Day|Father's Day|Valentine's Day"
STREET = "Street|St|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Road|Rd|Lane|Ln|Court|Ct|Place|Pl|Circle|Cir|Way|Highway|Hwy|Parkway|Pkwy|Terrace|Ter|Trail|Trl|Square|Sq|Plaza|Plz|Crescent|Cres|Alley|Aly|Loop|Row"
ORGANIZATION = (
    r"Hospitals?|Medical\s+Center|Medical\s+Centre|Medical\s+Group|Health\s+System|Health\s+Center|Health\s+Centre|Healthcare|Health\s+Care|Cancer\s+Center|Cancer\s+Centre|"
    r"Children's\s+Hospital|Memorial\s+Hospital|Clinic|Polyclinic|Infirmary|Sanitarium|Sanatorium|Urgent\s+Care|Surgery\s+Center|"
    r"Inc\.?|LLC|L\.L\.C\.|Corp\.?|Corporation|Co\.|Company|Foundation|Ltd\.?|Limited|Group|Associates|Partners|Pharmaceuticals?|Pharma|Laboratories|Labs?\.?|Industries|"
    r"Holdings|Enterprises|Solutions|Systems|Technologies|University|College|Institute|Academy|Society|Association"
)

PATTERNS: dict[str, list[str]] = {
    "EMAIL": [
        r"\b[A-Za-z0-9._%+\-]+\s?@\s?[A-Za-z0-9][A-Za-z0-9\-\.]*\.[A-Za-z]{2,24}\b",
        r"\b[A-Za-z0-9._%+\-]+\s*(?:\[at\]|\(at\))\s*[A-Za-z0-9][A-Za-z0-9\-\.]*\s*(?:\[dot\]|\(dot\)|\.)\s*[A-Za-z]{2,24}\b",
    ],
    "PHONE": [
        r"\+\d{1,3}[-.\s]?\(?\d{1,4}\)?[-.\s]?\d{1,4}[-.\s]?\d{1,9}",
        r"\(\d{3}\)\s*\d{3}[-.\s]?\d{4}",
        r"\b\d{3}[-.\s]\d{3}[-.\s]\d{4}\b",
        r"(?:phone|tel|telephone|mobile|cell|cellular|pager|beeper|fax|facsimile|home\s+phone|work\s+phone|office\s+phone)\s*(?:number|num|no|#)?\s*[:#\-]?\s*(\(?\+?\d[\d\s\-\.\(\)]{6,18}\d)(?:\s*(?:x|ex|ext|extension)\.?\s*\(?\d+\)?)?",
    ],
    "DATE": [
        r"\b\d{1,2}[\-\/\.]\d{1,2}[\-\/\.]\d{2,4}\b",
        r"\b\d{4}[\-\/\.]\d{1,2}[\-\/\.]\d{1,2}\b",
        r"\b\d{1,2}[\-\/]\d{4}\b",
        r"\b\d{4}[\-\/]\d{1,2}\b",
        r"\b\d{1,2}\/\d{1,2}\-\d{1,2}\/\d{1,2}(?:\/\d{2,4})?\b",
        r"\b\d{1,2}\/\d{1,2}\/\d{2,4}\-\d{1,2}\/\d{1,2}\/\d{2,4}\b",
        rf"\b(?:{MONTH})\.?\s+\d{{1,2}}{ORDINAL}?\s*[\,\s]+\d{{2,4}}\b",
        rf"\b\d{{1,2}}{ORDINAL}?\s+(?:of\s+)?(?:{MONTH})\.?\s*[\,\s]+\d{{2,4}}\b",
        rf"\b(?:{MONTH})\.?\s+\d{{1,2}}{ORDINAL}?\b",
        rf"\b\d{{1,2}}{ORDINAL}?\s+(?:of\s+)?(?:{MONTH})\b",
        rf"\b(?:{MONTH})\.?\s*(?:of\s+)?\d{{4}}\b",
        rf"\b(?:{MONTH})\.?\s*'\d{{2}}\b",
        rf"\b(?:{MONTH})\.?\s+\d{{1,2}}\s*(?:\-|to|through)\s*\d{{1,2}}\s*[\,\s]+\d{{2,4}}\b",
        rf"\b\d{{1,2}}\s*(?:\-|to|through)\s*\d{{1,2}}\s+(?:{MONTH})\.?\s*[\,\s]+\d{{2,4}}\b",
        rf"\b(?:{SEASON})\s*(?:of\s+)?\d{{2,4}}\b",
        r"\b(?:19|20)\d0s\b",
        r"\bthe\s+\d0s\b",
        r"'\d{2}s\b",
        r"\b(?:19|20)\d{2}\s*(?:\-|to|through|until)\s*(?:19|20)\d{2}\b",
        rf"\b(?:{HOLIDAY})\b",
        r"\b(?:since|from|in|year|during|until|before|after|by|circa)\s+(\d{4})\b",
    ],
    "DATE_TIME": [
        r"\b\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?:\s*Z|\s*[+-]\d{2}:?\d{2})?\b",
        r"\b(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?(?:\s*[ap]\.?\s*m\.?)?\b",
        r"\b\d{1,2}\s*[ap]\.?\s*m\.?\b",
    ],
    "AGE": [
        r"\b(?:age[ds]?|aged)\s*(?:is|of|=|:)?\s*(\d{1,3})\b",
        r"\b\d{1,3}\s*[\-]?\s*year[\s\-]*old\b",
        r"\b\d{1,3}\s*(?:years?|yrs?)[\s\.\-]*old\b",
        r"\b\d{1,3}\s*y[\s\.\/]\s*o\.?\b",
    ],
    "ID": [
        r"\b(?:mrn|medical\s+record(?:\s+(?:number|num|no|#))?|hospital\s+(?:number|num|no|#)|chart\s+(?:number|num|no|#)?|case\s+(?:number|num|no|#)|empi)\s*(?:number|num|no|#)?\s*[:#\-]?\s*([A-Za-z]?\d[\dA-Za-z\-\/]{2,})\b",
        r"\b(?:patient|subject|study|enrollment)\s+(?:id|identifier|number|#)\s*[:#\-]?\s*([A-Z0-9][A-Z0-9\-]{2,})\b",
        r"\b(?:ID|HCN|HRN|UPI)[\s:#]+([A-Z0-9][\dA-Z\-]{2,})\b",
        r"\b(?:account|acct|acc)\s*(?:number|num|no|#)?\s*[:#\-]?\s*(\d[\dA-Z\-]{3,})\b",
        r"\b(?:license\s+plate|plate\s+number|plate\s+#|tag\s+number)\s*[:#\-]?\s*([A-Z0-9][A-Z0-9\-]{1,7}[A-Z0-9])\b",
        r"\bDEA\s*(?:number|num|no|#)?\s*[:#\-]?\s*([A-Z]{2}\d{7})\b",
        r"\bNPI\s*(?:number|num|no|#)?\s*[:#\-]?\s*(\d{10})\b",
        r"\b(?:VIN|vehicle\s+identification\s+number)\s*(?:number|num|no|#)?\s*[:#\-]?\s*([A-HJ-NPR-Z0-9]{17})\b",
        r"\b(?:licen[cs]e|lic\.?|certificate|cert\.?)\s*(?:number|num|no|#)?\s*[:#\-]?\s*([A-Z0-9][\dA-Z\-]{3,})\b",
        r"\b(?:device\s+(?:id|number|serial|#)|serial\s+(?:number|num|no|#)|s\/n|s\.n\.|model\s+(?:number|num|no|#))\s*[:#\-]?\s*([A-Z0-9][A-Z0-9\-]{3,})\b",
        r"\bUDI[\s:#\-]+([\dA-Z\(\)\+\-]{8,})\b",
        r"\bOHIP[\s:#\-]+(\d{4}[- \/]?\d{3}[- \/]?\d{3}(?:[- \/]?[A-Z]{2})?)\b",
        r"\bSIN[\s:#\-]+(\d{3}[- \/]?\d{3}[- \/]?\d{3})\b",
    ],
    "SSN": [r"\b\d{3}-\d{2}-\d{4}\b", r"\b\d{3} \d{2} \d{4}\b", r"\b\d{3}/\d{2}/\d{4}\b", r"\b\d{9}\b"],
    "URL": [
        r"\bhttps?:\/\/[^\s<>\"\)\]]+",
        r"\b(?:ftp|ftps|file):\/\/[^\s<>\"\)\]]+",
        r"\bwww\.[a-zA-Z0-9][a-zA-Z0-9\-]*(?:\.[a-zA-Z0-9\-]+)+(?:\/[^\s<>\"\)\]]*)?",
    ],
    "IP_ADDRESS": [r"\b(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)){3}\b", r"\b(?:[a-fA-F0-9]{1,4}:){7}[a-fA-F0-9]{1,4}\b"],
    "ORGANIZATION": [rf"\b(?:(?-i:[A-Z])[A-Za-z'\.\-]+\s+){{1,4}}(?-i:{ORGANIZATION})\b"],
    "POSTAL_CODE": [r"\b[a-zA-Z]\d[a-zA-Z][ \-]?\d[a-zA-Z]\d\b", rf"\b(?:{US_STATES})\s*[,.]?\s*(\d{{5}}(?:-\d{{4}})?)\b"],
    "ADDRESS": [
        rf"\b\d+\s+(?:[A-Za-z\.']+\s+)?(?:[A-Za-z\.']+\s+)?(?:{STREET})\.?(?:\s*[,.]?\s*(?:apt|suite|ste|unit|bldg|building|fl|floor|rm|room)\.?\s*#?\s*[\w]+)?\b",
        r"\bP\.?\s*O\.?\s*Box\s+\d+\b",
    ],
}
GENERIC_LABELS = ("EMAIL", "PHONE", "URL", "IP_ADDRESS", "DATE", "SSN")

# --------------------------------------------------------------------------- fixed values: labels

CLINICAL_LABELS = (
    "NAME FIRST_NAME LAST_NAME PATIENT DOCTOR STAFF HCW ADDRESS LOCATION CITY STATE COUNTRY ZIP_CODE POSTAL_CODE DATE DATE_TIME PHONE TELEPHONE FAX EMAIL SSN MRN "
    "ID ACCOUNT LICENSE VEHICLE_ID DEVICE_ID URL IP_ADDRESS BIOMETRIC PHOTO AGE ORGANIZATION HOSPITAL IDNUM OHIP SIN PERSON OTHER"
).split()
CLINICAL_ALIASES = {
    "PHONE_NUMBER": "PHONE", "EMAIL_ADDRESS": "EMAIL", "LOCATION_OTHER": "LOCATION", "POSTAL_CODE_CA": "POSTAL_CODE", "ZIP_CODE_US": "ZIP_CODE", "ZIP": "ZIP_CODE",
    "FIRSTNAME": "FIRST_NAME", "LASTNAME": "LAST_NAME", "FULLNAME": "NAME", "FULL_NAME": "NAME", "DATE_OF_BIRTH": "DATE", "DOB": "DATE", "STREET_ADDRESS": "ADDRESS",
    "MEDICAL_RECORD": "MRN", "SOCIAL_SECURITY": "SSN",
}
GENERIC_SPACE = "NAME EMAIL PHONE ADDRESS DATE ID LOCATION ORGANIZATION URL IP_ADDRESS OTHER".split()
GENERIC_ALIASES = {"PHONE_NUMBER": "PHONE", "EMAIL_ADDRESS": "EMAIL", "STREET_ADDRESS": "ADDRESS", "FULL_NAME": "NAME", "PERSON": "NAME", "IP": "IP_ADDRESS"}
LABEL_RANKING = "NAME PATIENT FIRST_NAME LAST_NAME SSN MRN ID DATE DOB PHONE FAX EMAIL ADDRESS STREET CITY STATE ZIP COUNTRY HOSPITAL ORGANIZATION AGE URL IP DEVICE PLATE VIN ACCOUNT".split()

RISK_WEIGHTS = {
    "SSN": 10.0, "SIN": 10.0, "MRN": 8.0, "BIOMETRIC": 8.0, "PATIENT": 7.0, "NAME": 6.0, "PHONE": 6.0, "FAX": 6.0, "EMAIL": 6.0, "ID": 5.0, "IDNUM": 5.0, "OHIP": 5.0,
    "ACCOUNT": 5.0, "LICENSE": 5.0, "VEHICLE_ID": 5.0, "DEVICE_ID": 5.0, "URL": 4.0, "IP_ADDRESS": 4.0, "DOCTOR": 4.0, "ADDRESS": 4.0, "STAFF": 3.0, "HCW": 3.0,
    "PERSON": 3.0, "DATE": 3.0, "DATE_TIME": 3.0, "ZIP_CODE": 3.0, "POSTAL_CODE": 3.0, "CITY": 2.0, "HOSPITAL": 2.0, "ORGANIZATION": 2.0, "LOCATION": 2.0,
    "STATE": 1.0, "COUNTRY": 1.0, "AGE": 1.0,
}
HIPAA = (
    "Names", "Geographic data (smaller than state)", "Dates (except year)", "Phone numbers", "Fax numbers", "Email addresses", "Social Security numbers",
    "Medical record numbers", "Health plan beneficiary numbers", "Account numbers", "Certificate/license numbers", "Vehicle identifiers", "Device identifiers",
    "Web URLs", "IP addresses", "Biometric identifiers", "Full-face photographs", "Any other unique identifying number",
)
HIPAA_OF_LABEL = {
    "NAME": (1,), "PATIENT": (1,), "DOCTOR": (1,), "STAFF": (1,), "HCW": (1,), "PERSON": (1,), "HOSPITAL": (1, 18), "ORGANIZATION": (1, 18), "LOCATION": (2,), "ADDRESS": (2,),
    "CITY": (2,), "STATE": (2,), "COUNTRY": (2,), "ZIP": (2,), "ZIP_CODE": (2,), "POSTAL_CODE": (2,), "DATE": (3,), "DATE_TIME": (3,), "AGE": (3,), "PHONE": (4,),
    "FAX": (5,), "EMAIL": (6,), "SSN": (7,), "SIN": (7,), "MRN": (8,), "OHIP": (9,), "ACCOUNT": (10,), "LICENSE": (11,), "ID": (8, 9, 10, 11, 18), "IDNUM": (18,),
    "VEHICLE_ID": (12,), "DEVICE_ID": (13,), "URL": (14,), "IP_ADDRESS": (15,), "BIOMETRIC": (16,),
}
GENERIC_COVERAGE = {"names": "Personal names", "contact": "Contact info (email, phone)", "location": "Locations and addresses", "id": "Identifiers and account numbers", "temporal": "Dates and timestamps", "network": "URLs and network identifiers"}
GENERIC_OF_LABEL = {
    "NAME": ("names",), "EMAIL": ("contact",), "PHONE": ("contact",), "ADDRESS": ("location",), "LOCATION": ("location",), "ORGANIZATION": ("names",), "DATE": ("temporal",),
    "ID": ("id",), "URL": ("network",), "IP_ADDRESS": ("network",),
}

STRATEGY_OF_LABEL = {
    "NAME": "Name", "PATIENT": "Name", "PERSON": "Name", "STAFF": "Name", "HCW": "Name", "DOCTOR": "Name", "FIRST_NAME": "Name", "LAST_NAME": "Name", "FIRSTNAME": "Name",
    "LASTNAME": "Name", "FULL_NAME": "Name", "FULLNAME": "Name", "USERNAME": "Name", "DATE": "Date", "DATE_TIME": "Date", "PHONE": "Phone", "PHONE_NUMBER": "Phone",
    "FAX": "Phone", "EMAIL": "Email", "EMAIL_ADDRESS": "Email", "ID": "ID", "MRN": "ID", "SSN": "ID", "SIN": "ID", "OHIP": "ID", "IDNUM": "ID", "LOCATION": "Address",
    "ADDRESS": "Address", "LOCATION_OTHER": "Address", "POSTAL_CODE": "Postal Code", "POSTAL_CODE_CA": "Postal Code", "ZIP_CODE": "Postal Code", "ZIP_CODE_US": "Postal Code",
    "HOSPITAL": "Organization", "ORGANIZATION": "Organization", "AGE": "Age", "COUNTRY": "Country", "STATE": "State", "URL": "URL",
}

GENERIC_STRATEGIES = {"NAME": "Name", "EMAIL": "Email", "PHONE": "Phone", "ADDRESS": "Address", "DATE": "Date", "ID": "ID", "LOCATION": "Address", "ORGANIZATION": "Organization", "URL": "URL"}

# --------------------------------------------------------------------------- model labels

#: What an analyzer calls an entity, and the label that it gets.
ENTITY_LABELS = {
    "PERSON": "NAME",
    "DATE_TIME": "DATE",
    "PHONE_NUMBER": "PHONE",
    "EMAIL_ADDRESS": "EMAIL",
    "LOCATION": "LOCATION",
    "MEDICAL_LICENSE": "ID",
    "US_SSN": "ID",
    "IP_ADDRESS": "ID",
}

#: What a recognition model calls an entity, and what the analyzer does.
MODEL_ENTITIES = {
    "PER": "PERSON",
    "PERSON": "PERSON",
    "NORP": "NRP",
    "FAC": "FACILITY",
    "LOC": "LOCATION",
    "GPE": "LOCATION",
    "LOCATION": "LOCATION",
    "ORG": "ORGANIZATION",
    "ORGANIZATION": "ORGANIZATION",
    "DATE": "DATE_TIME",
    "TIME": "DATE_TIME",
    "AGE": "AGE",
    "ID": "ID",
    "EMAIL": "EMAIL",
    "PATIENT": "PERSON",
    "STAFF": "PERSON",
    "HCW": "PERSON",
    "HOSP": "ORGANIZATION",
    "HOSPITAL": "ORGANIZATION",
    "PATORG": "ORGANIZATION",
    "FACILITY": "LOCATION",
    "PHONE": "PHONE_NUMBER",
}

# --------------------------------------------------------------------------- packs and registries


@dataclass(frozen=True)
class LabelSpace:
    name: str
    labels: tuple[str, ...]
    aliases: dict[str, str] = field(default_factory=dict)
    fallback: str = "OTHER"

    def __post_init__(self):
        if self.fallback not in self.labels:
            raise ValueError(f"label space {self.name!r}: the fallback {self.fallback!r} is none of its labels")
        if bad := sorted(v for v in self.aliases.values() if v not in self.labels):
            raise ValueError(f"label space {self.name!r}: aliases lead to unknown labels {bad}")


@dataclass(frozen=True)
class RiskProfile:
    """``identifiers``: key -> (name, required); ``covers``: label -> keys."""

    name: str
    weights: dict[str, float]
    identifiers: dict[str, tuple[str, bool]]
    covers: dict[str, tuple[str, ...]]
    default_weight: float = 1.0


class Registry(dict):
    """Named packs; a wrong name tells the known ones."""

    def __init__(self, kind: str, **items):
        super().__init__(items)
        self.kind = kind

    def __missing__(self, key):
        raise KeyError(f"no {self.kind} named {key!r}; known: {sorted(self)}")


PATTERN_PACKS = Registry("pattern pack", clinical_phi=PATTERNS, generic_pii={k: v for k, v in PATTERNS.items() if k in GENERIC_LABELS})
LABEL_SPACES = Registry("label space", clinical_phi=LabelSpace("clinical_phi", tuple(CLINICAL_LABELS), CLINICAL_ALIASES), generic_pii=LabelSpace("generic_pii", tuple(GENERIC_SPACE), GENERIC_ALIASES))
RISK_PROFILES = Registry(
    "risk profile",
    clinical_phi=RiskProfile("clinical_phi", RISK_WEIGHTS, {f"{i:02d}": (n, i != 17) for i, n in enumerate(HIPAA, 1)}, {k: tuple(f"{i:02d}" for i in v) for k, v in HIPAA_OF_LABEL.items()}),
    generic_pii=RiskProfile("generic_pii", {}, {k: (v, True) for k, v in GENERIC_COVERAGE.items()}, GENERIC_OF_LABEL),
)
SURROGATE_PACKS = Registry("surrogate pack", clinical_phi=STRATEGY_OF_LABEL, generic_pii=GENERIC_STRATEGIES)
