"""Option presets of compliance regimes."""

from __future__ import annotations

# What each preset changes.
_STRICT = {k: {"strategy": "remove"} for k in ("phone", "email", "bank_card", "credit_card")}
_REALISTIC = "person phone phone_landline address id_number bank_card license_plate passport age date_of_birth ssn credit_card email ip_address mac_address"
PROFILES = {
    "default": {},
    "pipl": {"config": _STRICT},
    "gdpr": {"config": _STRICT},
    "hipaa": {"config": _STRICT, "types": ["phone", "id_number", "ssn", "date_of_birth", "email", "address", "person", "ip_address"]},
    "pseudonym-llm": {"config": {k: {"strategy": "realistic"} for k in _REALISTIC.split()}},
}


def profile(name: str) -> dict:
    if name not in PROFILES:
        raise ValueError(f"unknown profile {name!r}; known: {', '.join(PROFILES)}")
    return PROFILES[name]


def with_profile(name: str | None, config: dict | None, types: list[str] | None) -> tuple[dict, list[str] | None]:
    """The preset with the caller's options over it."""
    p = profile(name or "default")
    return {**p.get("config", {}), **(config or {})}, types if types is not None else p.get("types")
