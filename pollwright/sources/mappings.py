"""Column-mapping documents: source column -> standard name or a rule."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

# The published column mapping of the old and new result files. A plain text
# value renames; a rule is an ``extract`` regex, a ``constant`` or a ``derived`` equality.
DEFAULT_MAPPINGS = {
    "senate_mapping": {
        "old_format": {
            "year": "year",
            "class": "class",
            "state": "state",
            "state_po": "state_po",
            "district": "district",
            "stage": "stage",
            "special": "special",
            "candidate": "candidate",
            "party_detailed": "party",
            "writein": "writein",
            "mode": "mode",
            "candidatevotes": "candidatevotes",
            "totalvotes": "totalvotes",
        },
        "new_format": {
            "cycle": "year",
            "office_seat_name": {"type": "extract", "pattern": "Class (\\d+)", "target": "class"},
            "state": "state",
            "state_abbrev": "state_po",
            "district": {"type": "constant", "value": "statewide"},
            "stage": "stage",
            "special": "special",
            "candidate_name": "candidate",
            "ballot_party": "party",
            "votes": "candidatevotes",
            "total_votes": "totalvotes",
            "writein": {"type": "derived", "source": "ballot_party", "condition": "W"},
            "mode": {"type": "constant", "value": "TOTAL"},
        },
    },
    "house_mapping": {
        "old_format": {
            "year": "year",
            "state": "state",
            "state_po": "state_po",
            "district": "district",
            "stage": "stage",
            "runoff": "runoff",
            "special": "special",
            "candidate": "candidate",
            "party_detailed": "party",
            "writein": "writein",
            "mode": "mode",
            "candidatevotes": "candidatevotes",
            "totalvotes": "totalvotes",
        },
        "new_format": {
            "cycle": "year",
            "state": "state",
            "state_abbrev": "state_po",
            "office_seat_name": {"type": "extract", "pattern": "District (\\d+)", "target": "district"},
            "stage": "stage",
            "special": "special",
            "candidate_name": "candidate",
            "ballot_party": "party",
            "votes": "candidatevotes",
            "writein": {"type": "derived", "source": "ballot_party", "condition": "W"},
            "mode": {"type": "constant", "value": "TOTAL"},
            "runoff": {"type": "constant", "value": "FALSE"},
        },
    },
    "president_mapping": {
        "old_format": {
            "year": "year",
            "state": "state",
            "state_po": "state_po",
            "candidate": "candidate",
            "party_detailed": "party",
            "writein": "writein",
            "candidatevotes": "candidatevotes",
            "totalvotes": "totalvotes",
        },
        "new_format": {
            "cycle": "year",
            "state": "state",
            "state_abbrev": "state_po",
            "candidate_name": "candidate",
            "ballot_party": "party",
            "votes": "candidatevotes",
            "writein": {"type": "derived", "source": "ballot_party", "condition": "W"},
            "mode": {"type": "constant", "value": "TOTAL"},
        },
    },
}


def read_mapping(spark: SparkSession, path: str) -> dict:
    """Load a mapping document of the same shape from any path Spark can read."""
    document = spark.read.text(path, wholetext=True).first()
    return json.loads(document["value"])
