"""Projections, filters and set operations on result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollwright.functions.columns import as_flag, share
from pollwright.functions.scale import with_group_stats
from pollwright.sources.schemas import OFFICE_COLUMNS, check_office


def _listed(values: Sequence | str | None) -> list | None:
    """A list from a list or from comma-separated text; None means no filter."""
    if values is None or values == "":
        return None
    return [v for v in values.split(",") if v] if isinstance(values, str) else list(values)


def filter_in(df: DataFrame, years=None, states=None, districts=None) -> DataFrame:
    """Optional IN lists; ``None`` keeps everything."""
    years = _listed(years)
    for column, values in (
        ("year", None if years is None else [int(y) for y in years]),
        ("state", _listed(states)),
        ("district", _listed(districts)),
    ):
        if values is not None:
            df = df.where(F.col(column).isin(values))
    return df


def general_only(df: DataFrame, strict: bool = False) -> DataFrame:
    """General elections. New files spell the stage out; ``strict`` takes only ``GEN``."""
    if strict:
        return df.where(F.col("stage") == "GEN")
    return df.where(F.upper("stage").isin("GEN", "GENERAL"))


def exclude_states(df: DataFrame, states: Sequence[str] = ("DC",), column: str = "state_po") -> DataFrame:
    """Drop the listed states; rows without a state stay."""
    return df.where(~F.coalesce(F.col(column).isin(list(states)), F.lit(False)))


def drop_zero_votes(df: DataFrame, votes: str = "candidatevotes") -> DataFrame:
    """Drop candidates with 0 votes; unknown counts stay."""
    return df.where(F.col(votes).isNull() | (F.col(votes) != 0))


def fill_blank(df: DataFrame, votes: Sequence[str] = ("candidatevotes", "totalvotes")) -> DataFrame:
    """Null party to empty, null votes to 0, any other null text to ``Blank``."""
    zeros = {c: 0 for c in votes if c in df.columns}
    return df.na.fill({**zeros, **({"party": ""} if "party" in df.columns else {})}).na.fill("Blank")


def require_columns(df: DataFrame, office: str) -> DataFrame:
    """The office's standard columns in order; missing ones are created empty."""
    return df.select(
        *[F.col(c) if c in df.columns else F.lit("").alias(c) for c in OFFICE_COLUMNS[check_office(office)]]
    )


def party_major(df: DataFrame, party: str = "party") -> DataFrame:
    """DEMOCRAT and REPUBLICAN as they are, everything else OTHER."""
    bucket = F.when(F.col(party).isin("DEMOCRAT", "REPUBLICAN"), F.col(party)).otherwise("OTHER")
    return df.withColumn("party_major", bucket)


def state_district(df: DataFrame) -> DataFrame:
    """Race key ``state-district``."""
    return df.withColumn("state_district", F.concat_ws("-", F.col("state"), F.col("district").cast("string")))


def fix_unopposed(df: DataFrame, keys: Sequence[str], votes: str = "candidatevotes") -> DataFrame:
    """A lone candidate with less than one vote gets one vote; ``unopposed`` marks the row."""
    raced = with_group_stats(df, keys, _rows=F.count(F.lit(1)), _sum=F.coalesce(F.sum(votes), F.lit(0)))
    alone = (F.col("_rows") == 1) & (F.col("_sum") < 1)
    return (
        raced.withColumn("unopposed", alone.cast("int"))
        .withColumn(votes, F.when(alone, F.lit(1).cast(df.schema[votes].dataType)).otherwise(F.col(votes)))
        .drop("_rows", "_sum")
    )


def senate_year_class(year: Column) -> Column:
    """The class that is regularly up in a year (1, 2 or 3)."""
    return (F.floor(F.pmod((year - 1976) / F.lit(2.0), F.lit(3.0))) + 1).cast("int")


def senate_class_columns(df: DataFrame) -> DataFrame:
    """``year_class``, and ``actually_special``: special and not the class that is up anyway."""
    return df.withColumn("year_class", senate_year_class(F.col("year"))).withColumn(
        "actually_special", as_flag("special") & ~F.col("class").cast("int").eqNullSafe(F.col("year_class"))
    )


def effective_year(df: DataFrame, year: str = "year") -> DataFrame:
    """Odd years count for the following even year."""
    return df.withColumn("eff_year", F.col(year) + F.pmod(F.col(year), F.lit(2)))


def vote_shares(df: DataFrame) -> DataFrame:
    """Percent of the race total per row."""
    return df.select("year", "state", "party", share(F.col("votes"), F.col("total_votes")).alias("vote_share"))


def presidential_years(df: DataFrame) -> DataFrame:
    return df.where(F.pmod(F.col("year") - 1976, F.lit(4)) == 0)


def two_party_heatmap(shares: DataFrame, n_states: int = 20) -> DataFrame:
    """Positive DEMOCRAT and REPUBLICAN shares of the first states by name."""
    shown = shares.where(F.col("party").isin("DEMOCRAT", "REPUBLICAN") & (F.col("vote_share") > 0))
    return shown.join(first_states(shown, n_states), "state", "left_semi").select(*shares.columns)


def first_states(df: DataFrame, n: int) -> DataFrame:
    """The first ``n`` distinct states in name order."""
    return df.select("state").distinct().orderBy("state").limit(n)


def drop_last_years(df: DataFrame, n: int = 3, year: str = "eff_year") -> DataFrame:
    """Remove the last ``n`` distinct years, which only hold carried terms."""
    last = df.select(year).where(F.col(year).isNotNull()).distinct().orderBy(F.desc(year)).limit(n)
    return df.where(F.col(year) < last.agg(F.min(year)).scalar())


def newer_than(new: DataFrame, old: DataFrame) -> DataFrame:
    """Old rows plus the new rows of years after the last old one."""
    last = old.agg(F.coalesce(F.max("year"), F.lit(-(2**31)))).scalar()
    return union_results(old, new.where(F.col("year") > last))


def split_special(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regular rows and truly special rows, after ``senate_class_columns``."""
    return df.where(~F.col("actually_special")), df.where("actually_special")


def union_results(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Concatenate by column name; missing columns become null."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def distinct_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*columns).distinct()


def sort_results(df: DataFrame, office: str, votes: str = "candidatevotes") -> DataFrame:
    """Year, state and seat upwards, votes downwards; then all other columns, so that equal rows
    keep their place."""
    seat = {"senate": ["class"], "house": ["district"], "president": []}[check_office(office)]
    first = ["year", "state", *seat]
    return df.orderBy(*first, F.desc(votes), *[c for c in df.columns if c not in (*first, votes)])
