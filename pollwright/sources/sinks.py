"""Writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from pollwright.operators.aggregates import votes_by_state, votes_by_year
from pollwright.operators.results import vote_shares


def write_table(
    df: DataFrame, path: str, format: str = "parquet", partition_by: Sequence[str] = (), mode: str = "error"
) -> None:
    """CSV with a header, or Parquet; partition by year for later pruning."""
    if format not in ("csv", "parquet"):
        raise ValueError(f"format must be csv or parquet, not {format!r}")
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if format == "csv":
        writer.option("header", True).option("escape", '"').csv(path)  # quotes doubled, as the readers expect
    else:
        writer.parquet(path)


def export_bundle(frames: Mapping[str, DataFrame], path: str, mode: str = "error") -> None:
    """Row JSON, one folder per dataset, each written in parallel."""
    for name, frame in frames.items():
        frame.write.mode(mode).option("ignoreNullFields", False).json(f"{path}/{name}")


def visualization_bundle(
    party_survey: DataFrame, leaner_survey: DataFrame, presidential: DataFrame, senate: DataFrame
) -> dict[str, DataFrame]:
    """The datasets of the visualization export, ready for ``export_bundle``."""
    return {
        "surveys/party_identification": party_survey,
        "surveys/leaners": leaner_survey,
        "elections/presidential/by_year": votes_by_year(presidential),
        "elections/presidential/by_state": votes_by_state(presidential),
        "elections/presidential/vote_shares": vote_shares(presidential),
        "elections/senate/by_year": votes_by_year(senate),
    }
