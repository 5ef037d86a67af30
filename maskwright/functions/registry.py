"""Types of personal data: default strategies, code prefixes, sensitivity and compliance, as data and as a DataFrame."""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

STRATEGIES = ("pseudonym", "realistic", "mask", "remove", "category", "name_mask", "landline_mask", "keep")
REVERSIBLE = frozenset({"pseudonym", "realistic", "remove", "keep"})

# Registered types with their sensitivity, in the order of registration.
SENSITIVITY = {
    "zh": "phone 3, phone_landline 3, id_number 4, hk_id 4, tw_id 4, macau_id 4, taiwan_arc 4, bank_card 4, passport 3, license_plate 2, address 2, credit_code 3, qq 2, wechat 2, date_of_birth 2, military_id 3, "
    "social_security 4, job_title 2, organization 2, school 2, ethnicity 3, workplace 2, criminal_record 4, financial 3, biometric 4, medical 4, religion 4, political 4, sexual_orientation 4, self_reference 2, person 3, age 2",
    "en": "phone 2, ssn 4, credit_card 3, address 2, person 2, date_of_birth 3, us_passport 4, medical 4, financial 3, criminal_record 4, biometric 4, religion 3, political 3, sexual_orientation 4, self_reference 1",
    "shared": "openai_api_key 4, anthropic_api_key 4, aws_access_key 4, github_token 4, jwt 4, ssh_private_key 4, email 2, ip_address 2, mac_address 2",
}
# Strategies that differ from remove, prefixes of codes, labels of categories.
DEFAULT_STRATEGY = {
    "person": "pseudonym", "organization": "pseudonym", "school": "pseudonym", "location": "category", "phone": "mask", "email": "mask", "bank_card": "mask", "credit_card": "mask", "self_reference": "keep",
}
PREFIXES = {
    "person": "P", "organization": "O", "id_number": "ID", "passport": "PASS", "license_plate": "PLATE", "address": "ADDR", "ssn": "SSN", "military_id": "MIL", "social_security": "SOC", "credit_code": "BIZ",
    "date_of_birth": "DOB", "us_passport": "PASS", "job_title": "TITLE", "school": "SCH", "ethnicity": "ETH", "workplace": "WORK", "criminal_record": "CRIM", "financial": "FIN", "biometric": "BIO", "medical": "MED",
    "religion": "REL", "political": "POL", "sexual_orientation": "ORI", "ip_address": "IP", "mac_address": "MAC", "imei": "IMEI", "url_token": "URL", "age": "AGE", "gender": "GEN", "self_reference": "S",
    "openai_api_key": "OAI-KEY", "anthropic_api_key": "ANT-KEY", "aws_access_key": "AWS-KEY", "github_token": "GH-TOKEN", "jwt": "JWT", "ssh_private_key": "SSH-KEY",
}
CATEGORY_LABELS = {"location": "[LOCATION]"}
CHECKSUMS = {
    "id_number": "MOD 11-2", "hk_id": "HKID mod-11", "tw_id": "TWID weighted mod-10", "bank_card": "Luhn (or BIN prefix)", "credit_code": "MOD 31", "credit_card": "Luhn", "jwt": "base64url decode + JSON.alg field",
}
# Compliance. Articles are in legal order.
PIPL_ORDER = ("PIPL Art.13", "PIPL Art.28", "PIPL Art.51", "PIPL Art.29", "PIPL Art.55", "PIPL Art.56")
PIPL_SENSITIVE = ("medical", "financial", "religion", "political", "sexual_orientation", "criminal_record", "biometric")
GDPR_SPECIAL = ("medical", "biometric", "ethnicity", "religion", "political", "sexual_orientation", "criminal_record")
HIPAA = {
    "person": "names", "phone": "phone_numbers", "phone_landline": "phone_numbers", "email": "email_addresses", "ssn": "ssn", "social_security": "ssn", "medical": "medical_record", "date_of_birth": "dates",
    "address": "geographic", "ip_address": "ip_address", "mac_address": "device_identifier", "biometric": "biometric", "us_passport": "certificate_number", "passport": "certificate_number",
    "license_plate": "vehicle_identifier", "financial": "account_numbers", "bank_card": "account_numbers", "credit_card": "account_numbers",
}
UNKNOWN_SENSITIVITY = 2


class TypeInfo(NamedTuple):
    lang: str
    name: str
    strategy: str
    prefix: str
    sensitivity: int
    reversible: bool
    checksum: str | None
    pipl_articles: tuple[str, ...]
    gdpr_special: bool
    hipaa_category: str | None


def prefix_of(name: str) -> str:
    """The prefix of codes for a type; one without an entry gives its first four letters in upper case."""
    return PREFIXES.get(name, name.upper()[:4])


def strategy_of(name: str) -> str:
    return DEFAULT_STRATEGY.get(name, "remove")


def is_reversible(strategy: str) -> bool:
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    return strategy in REVERSIBLE


def articles(name: str, sensitivity: int) -> tuple[str, ...]:
    wanted = {"PIPL Art.13", "PIPL Art.28", "PIPL Art.56"} | ({"PIPL Art.51", "PIPL Art.29"} if sensitivity >= 3 else set()) | ({"PIPL Art.55"} if name in PIPL_SENSITIVE else set())
    return tuple(a for a in PIPL_ORDER if a in wanted)


@lru_cache(maxsize=1)
def builtin_types() -> tuple[TypeInfo, ...]:
    out = []
    for lang, listed in SENSITIVITY.items():
        for entry in listed.split(", "):
            name, level = entry.split()
            out.append(
                TypeInfo(lang, name, strategy_of(name), prefix_of(name), int(level), strategy_of(name) in REVERSIBLE, CHECKSUMS.get(name), articles(name, int(level)), name in GDPR_SPECIAL, HIPAA.get(name))
            )
    return tuple(out)


class Registry:
    """Built-in types and those that the user adds."""

    def __init__(self):
        self._types = {(t.lang, t.name): t for t in builtin_types()}

    def register(self, lang: str, name: str, *, sensitivity: int = UNKNOWN_SENSITIVITY, strategy: str = "remove", prefix: str | None = None, checksum: str | None = None) -> TypeInfo:
        is_reversible(strategy)
        t = TypeInfo(lang, name, strategy, prefix or prefix_of(name), sensitivity, strategy in REVERSIBLE, checksum, articles(name, sensitivity), name in GDPR_SPECIAL, HIPAA.get(name))
        self._types[(lang, name)] = t
        return t

    def unregister(self, lang: str, name: str) -> None:
        self._types.pop((lang, name), None)

    def get(self, lang: str, name: str) -> TypeInfo:
        return self._types[(lang, name)]

    def lookup(self, name: str) -> list[TypeInfo]:
        return [t for t in self._types.values() if t.name == name]

    def list_types(self, lang: str | None = None) -> list[TypeInfo]:
        return [t for t in self._types.values() if lang in (None, t.lang)]

    def sensitivity(self, name: str) -> int:
        """Of the first type of that name in any language."""
        return next((t.sensitivity for t in self._types.values() if t.name == name), UNKNOWN_SENSITIVITY)

    def resolve(self, name: str, lang: str) -> TypeInfo | None:
        """The type of that language, else the first of that name."""
        return self._types.get((lang, name)) or next(iter(self.lookup(name)), None)


REGISTRY = Registry()
_SCHEMA = "lang string, name string, strategy string, prefix string, sensitivity int, reversible boolean, checksum string, pipl_articles array<string>, gdpr_special boolean, hipaa_category string, position int"


def types_frame(spark: SparkSession, registry: Registry = REGISTRY) -> DataFrame:
    """The dimension table, one row per type (a bounded table: registered types only)."""
    return spark.createDataFrame([(*t[:7], list(t.pipl_articles), *t[8:], i) for i, t in enumerate(registry.list_types())], _SCHEMA)


def catalog_markdown(registry: Registry = REGISTRY) -> str:
    rows = ["| lang | type | strategy | prefix | sensitivity | PIPL | GDPR Art.9 | HIPAA |", "|-|-|-|-|-|-|-|-|"]
    return "\n".join(rows + [f"| {t.lang} | {t.name} | {t.strategy} | {t.prefix} | {t.sensitivity} | {', '.join(a[10:] for a in t.pipl_articles)} | {'yes' if t.gdpr_special else ''} | {t.hipaa_category or ''} |" for t in registry.list_types()])
