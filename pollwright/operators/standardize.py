"""Two generations of result files to one schema, with validation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollwright.functions.columns import as_flag, clean_text, extract, to_number, to_votes, zero_pad
from pollwright.functions.scale import with_group_stats
from pollwright.operators.results import require_columns
from pollwright.sources.mappings import DEFAULT_MAPPINGS
from pollwright.sources.schemas import REQUIRED_BY_OFFICE, REQUIRED_COMMON, check_office

# New-format titles that only change their name, and the seat patterns.
NEW_FORMAT_NAMES = {
    "state_abbrev": "state_po",
    "candidate_name": "candidate",
    "ballot_party": "party",
    "votes": "candidatevotes",
    "cycle": "year",
}
DISTRICT_PATTERN = r"District (\d+)"
CLASS_PATTERN = r"Class (\d+)"


def is_new_format(df: DataFrame) -> bool:
    return "race_id" in df.columns


def _mapped(df: DataFrame, source: str, rule: str | Mapping) -> Column | None:
    """The standard column that one mapping entry describes, or None if its source is absent."""
    if isinstance(rule, str):
        return F.col(source).alias(rule) if source in df.columns else None
    if rule["type"] == "constant":
        return F.lit(rule["value"]).alias(source)
    if rule["type"] == "derived":
        equal = F.col(rule["source"]).eqNullSafe(F.lit(rule["condition"])) if rule["source"] in df.columns else None
        return None if equal is None else equal.alias(source)
    if rule["type"] == "extract":
        if source not in df.columns:
            return None
        text = F.coalesce(extract(source, rule["pattern"]), F.lit("0"))
        return (zero_pad(text, 3) if rule["target"] == "district" else text).alias(rule["target"])
    raise ValueError(f"unknown mapping rule {rule['type']!r}")


def standardize_by_mapping(df: DataFrame, office: str, mappings: Mapping = DEFAULT_MAPPINGS) -> DataFrame:
    """Apply a mapping document: one projection, whatever the number of rules."""
    office_rules = mappings.get(f"{office}_mapping")
    if office_rules is None:
        raise ValueError(f"no mapping for office {office!r}")
    rules = office_rules["new_format" if is_new_format(df) else "old_format"]
    columns = [_mapped(df, source, rule) for source, rule in rules.items()]
    standard = df.select(*[c for c in columns if c is not None])
    present = set(standard.columns)
    return standard.withColumns(
        {c: F.col(c).try_cast("int") for c in ("year",) if c in present}
        | {c: to_votes(c) for c in ("candidatevotes", "totalvotes") if c in present}
        | {
            c: F.upper(F.coalesce(F.col(c).cast("string"), F.lit("")))
            for c in ("state", "state_po", "candidate", "party")
            if c in present
        }
    )


def _text_or(df: DataFrame, column: str, default: str) -> Column:
    return clean_text(column) if column in df.columns else F.lit(default)


def standardize_new_format(df: DataFrame, office: str) -> DataFrame:
    """Fixed renames and the derived columns of the new files."""
    check_office(office)
    named = df.withColumnsRenamed({k: v for k, v in NEW_FORMAT_NAMES.items() if k in df.columns})
    party = _text_or(named, "party", "")
    seat = F.col("office_seat_name") if "office_seat_name" in named.columns else F.lit("")
    derived = {
        "party": party,
        "writein": party == "W",
        "mode": F.lit("TOTAL"),
        "stage": _text_or(named, "stage", "GEN"),
        "special": _text_or(named, "special", "FALSE"),
        "runoff": F.lit("FALSE"),
    }
    if office == "house":
        derived["district"] = zero_pad(F.coalesce(extract(seat, DISTRICT_PATTERN), F.lit("0")), 3)
    else:
        derived["district"] = F.lit("statewide")
    if office == "senate":
        derived["class"] = F.coalesce(extract(seat, CLASS_PATTERN), F.lit("0")).cast("int")
    return named.withColumns(derived)


def standardize_old_format(df: DataFrame, office: str) -> DataFrame:
    """Fill the columns that older files leave out."""
    check_office(office)
    defaults = {
        "writein": F.lit(False),
        "mode": F.lit("TOTAL"),
        "district": F.lit("000" if office == "house" else "statewide"),
    }
    if office == "senate":
        half = F.floor((F.col("year").cast("int") - 1976) / F.lit(2.0))
        defaults["class"] = (F.pmod(half, F.lit(3)) + 1).cast("int")
    return df.withColumns({k: v for k, v in defaults.items() if k not in df.columns})


def import_election(df: DataFrame, office: str) -> DataFrame:
    """Any result file to the office's standard schema. Where the file has no race totals they are
    the sums of the candidates' votes."""
    check_office(office)
    shaped = standardize_new_format(df, office) if is_new_format(df) else standardize_old_format(df, office)
    cleaned = shaped.withColumns(
        {c: _text_or(shaped, c, "") for c in ("party", "candidate", "state")} | _typed(shaped)
    )
    full = require_columns(cleaned, office).withColumns({c: to_votes(c) for c in ("candidatevotes", "totalvotes")})
    if "totalvotes" in cleaned.columns:
        return full
    return derive_totalvotes(full.drop("totalvotes"), race_keys(office)).select(*full.columns)


def _typed(df: DataFrame) -> dict[str, Column]:
    """Types of the columns that a CSV delivers as text."""
    whole = {c: F.col(c).try_cast("int") for c in ("year", "class") if c in df.columns}
    return whole | ({"writein": as_flag("writein")} if "writein" in df.columns else {})


def race_keys(office: str) -> list[str]:
    """The columns that tell an office's races apart."""
    seat = {"house": ["district"], "senate": ["district", "class"], "president": []}
    return ["year", "state", *seat[check_office(office)]]


def derive_totalvotes(df: DataFrame, keys=("year", "state", "district")) -> DataFrame:
    """Race total as the sum of its candidates, where the file has none."""
    if "totalvotes" in df.columns:
        return df
    return with_group_stats(df, list(keys), totalvotes=F.sum("candidatevotes"))


def validate(df: DataFrame, office: str, keys=("year", "state", "district")) -> DataFrame:
    """One row per check with the number of offending rows (races for the total check).

    One scan: rows are reduced to races first, then races to a single row.
    """
    required = REQUIRED_COMMON + REQUIRED_BY_OFFICE[check_office(office)]
    missing = [c for c in required if c not in df.columns]
    checks = {"required_columns": F.lit(len(missing)).cast("bigint")}
    if "candidatevotes" in df.columns:
        votes = to_number("candidatevotes")
        races = [k for k in keys if k in df.columns]
        bad_class = F.lit(False)
        if office == "senate" and "class" in df.columns:
            bad_class = ~F.coalesce(F.col("class").try_cast("int").between(1, 3), F.lit(False))
        total = to_number("totalvotes") if "totalvotes" in df.columns else F.lit(None).cast("double")
        per_race = df.groupBy(*races).agg(
            F.count_if(votes.isNull()).alias("_text"),
            F.count_if(votes < 0).alias("_negative"),
            F.count_if(bad_class).alias("_class"),
            F.coalesce(F.sum(votes), F.lit(0.0)).alias("_sum"),
            F.min(total).alias("_low"),
            F.max(total).alias("_high"),
        )
        off = ~(F.col("_sum").eqNullSafe(F.col("_low")) & F.col("_sum").eqNullSafe(F.col("_high")))
        # The race check skips races with a null key, as a group-by in pandas does.
        keyed = F.lit(True)
        for k in races:
            keyed = keyed & F.col(k).isNotNull()
        summary = per_race.agg(
            F.sum("_text").alias("numeric_votes"),
            F.sum("_negative").alias("nonnegative_votes"),
            F.sum("_class").alias("senate_class"),
            F.count_if(off & keyed).alias("race_totals"),
        )
        checks |= {"numeric_votes": F.col("numeric_votes"), "nonnegative_votes": F.col("nonnegative_votes")}
        if office == "senate":
            checks["senate_class"] = F.col("senate_class")
        if "totalvotes" in df.columns:
            checks["race_totals"] = F.col("race_totals")
    else:
        summary = df.limit(0).agg(F.count(F.lit(1)).alias("_none"))
    rows = F.array(
        *[
            F.struct(F.lit(name).alias("check"), F.coalesce(bad, F.lit(0)).cast("bigint").alias("offending"))
            for name, bad in checks.items()
        ]
    )
    return (
        summary.select(F.explode(rows).alias("c"))
        .select("c.check", "c.offending", (F.col("c.offending") == 0).alias("passed"))
    )
