"""Column lists of the three standard result tables."""

from __future__ import annotations

# The standard columns of each office, in output order.
OFFICE_COLUMNS = {
    "president": [
        "year", "state", "state_po", "candidate", "party",
        "writein", "candidatevotes", "totalvotes",
    ],
    "senate": [
        "year", "state", "state_po", "district", "class", "stage", "special",
        "candidate", "party", "writein", "mode", "candidatevotes", "totalvotes",
    ],
    "house": [
        "year", "state", "state_po", "district", "stage", "runoff", "special",
        "candidate", "party", "writein", "mode", "candidatevotes", "totalvotes",
    ],
}

# Columns a validated table must have, beyond the common ones.
REQUIRED_COMMON = ["year", "state", "state_po", "candidate", "party", "candidatevotes", "totalvotes"]
REQUIRED_BY_OFFICE = {
    "house": ["district", "stage", "runoff", "special"],
    "senate": ["district", "class", "stage", "special"],
    "president": [],
}

# The seat column that tells two races of one state apart.
SEAT_COLUMNS = {"house": ["district"], "senate": ["class"], "president": []}


def check_office(office: str) -> str:
    if office not in OFFICE_COLUMNS:
        raise ValueError(f"office must be one of {sorted(OFFICE_COLUMNS)}, not {office!r}")
    return office
