"""Encoders, scaling and date features. Fitting and applying are separate steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollwright.functions.scale import running_sum

UNKNOWN = "Unknown"

# Order of the party columns and the parties folded into OTHER.
PARTY_ORDER = ["DEMOCRAT", "REPUBLICAN", "INDEPENDENT", "OTHER"]
FOLDED_PARTIES = ["LIBERTARIAN", "GREEN"]


def _category(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(UNKNOWN))


def category_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value): the distinct values of all columns, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _category(c).alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.*").distinct()


def fit_labels(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, code): the position of each value among the sorted values of its column.

    Codes are a running count over range-partitioned values, so columns with very many
    categories are numbered in parallel, and all of them in one pass.
    """
    counted = running_sum(category_values(df, columns), ["column"], ["value"], F.lit(1).cast("bigint"), "_n")
    return counted.select("column", "value", (F.col("_n") - 1).cast("bigint").alias("code"))


def label_encode(df: DataFrame, labels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``{col}_code`` for every column; a value not seen in fitting is an error."""
    out = df
    for c in columns:
        lookup = labels.where(F.col("column") == c).select(F.col("value").alias("_value"), F.col("code").alias(f"{c}_code"))
        out = out.withColumn("_key", _category(c)).join(lookup, F.col("_key") == F.col("_value"), "left")
        unseen = F.raise_error(F.concat(F.lit(f"unseen value in {c}: "), F.col("_key"))).cast("bigint")
        out = out.withColumn(f"{c}_code", F.coalesce(F.col(f"{c}_code"), unseen)).drop("_key", "_value")
    return out


def one_hot_long(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, column, value): the ones of a one-hot encoding, for any number of values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _category(c).alias("value")) for c in columns])
    return df.select(key, F.explode(pairs).alias("_p")).select(key, "_p.*")


def one_hot(df: DataFrame, values: Mapping[str, Sequence[str]]) -> DataFrame:
    """0/1 columns ``{col}_{value}`` for the listed values; another value gives zeros."""
    return df.select(
        "*",
        *[(_category(c) == v).cast("int").alias(f"{c}_{v}") for c, vs in values.items() for v in vs],
    )


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with ``{col}_mean`` and ``{col}_std`` (population), null counted as 0."""
    stats = []
    for c in columns:
        x = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        stats += [F.avg(x).alias(f"{c}_mean"), F.stddev_pop(x).alias(f"{c}_std")]
    return df.agg(*stats)


def standard_scale(df: DataFrame, columns: Sequence[str], scaler: DataFrame | None = None) -> DataFrame:
    """Columns shifted and scaled; a constant column is only shifted."""
    fitted = scaler if scaler is not None else fit_scaler(df, columns)
    stats = fitted.select(F.struct(*fitted.columns)).scalar()
    scaled = df.withColumn("_stats", stats)
    for c in columns:
        std = F.col("_stats")[f"{c}_std"]
        centered = F.coalesce(F.col(c).cast("double"), F.lit(0.0)) - F.col("_stats")[f"{c}_mean"]
        scaled = scaled.withColumn(c, centered / F.when(std == 0.0, F.lit(1.0)).otherwise(std))
    return scaled.drop("_stats")


class DemographicEncoder:
    """Label codes, then one-hot columns, then scaled numbers, fitted once and reused.

    ``onehot`` lists the values of each one-hot column, which become columns of the result.
    """

    def __init__(
        self, categorical: Sequence[str], numerical: Sequence[str], onehot: Mapping[str, Sequence[str]] | None = None
    ):
        self.categorical = list(categorical)
        self.numerical = list(numerical)
        self.values = {c: list(vs) for c, vs in (onehot or {}).items()}

    def fit(self, df: DataFrame) -> DemographicEncoder:
        self.labels = fit_labels(df, self.categorical)
        self.scaler = fit_scaler(df, self.numerical) if self.numerical else None
        return self

    @property
    def feature_names(self) -> list[str]:
        hot = [f"{c}_{v}" for c, vs in self.values.items() for v in vs]
        return [f"{c}_code" for c in self.categorical] + hot + self.numerical

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        out = one_hot(label_encode(df, self.labels, self.categorical), self.values)
        if self.numerical:
            out = standard_scale(out, self.numerical, self.scaler)
        return out.select(*keep, *[f"`{n}`" for n in self.feature_names])


def encode_demographics(
    df: DataFrame,
    categorical: Sequence[str],
    numerical: Sequence[str],
    onehot: Mapping[str, Sequence[str]] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    return DemographicEncoder(categorical, numerical, onehot).fit(df).transform(df, keep)


def encode_party(df: DataFrame, party: str = "party") -> DataFrame:
    """0/1 columns ``party_{name}`` in fixed order; text outside the list gives zeros."""
    upper = F.upper(party)
    name = F.when(upper.isNull() | upper.isin(FOLDED_PARTIES), "OTHER").otherwise(upper)
    return df.withColumns({f"party_{p}": (name == p).cast("int") for p in PARTY_ORDER})


def normalize_shares(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns clamped at 0 and divided by their row sum; an all-zero row stays zero."""
    clamped = {c: F.greatest(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    total = reduce(lambda a, b: a + b, clamped.values())
    return df.withColumns({c: F.when(total == 0.0, x).otherwise(x / total) for c, x in clamped.items()})


def temporal_features(df: DataFrame, date: str = "date") -> DataFrame:
    """year, month, day_of_year and its place on a 365-day circle."""
    angle = F.lit(2.0) * F.pi() * F.dayofyear(date) / F.lit(365.0)
    return df.withColumns(
        {
            "year": F.year(date),
            "month": F.month(date),
            "day_of_year": F.dayofyear(date),
            "sin_day": F.sin(angle),
            "cos_day": F.cos(angle),
        }
    )
