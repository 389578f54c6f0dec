"""Electors, Senate terms and the nearest survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pollwright.functions.scale import null_safe_join
from pollwright.operators.aggregates import electors_by_state


def attach_electors(pres: DataFrame, house: DataFrame) -> DataFrame:
    """House seats of the state plus 2 for its senators; DC has 3 in all."""
    joined = null_safe_join(pres, electors_by_state(house), ["year", "state_po"], "left")
    dc = F.when(F.col("state_po") == "DC", 1).otherwise(0)
    return joined.withColumn("electors", F.coalesce("electors", F.lit(0)) + 2 + dc)


def _backward(year_class: str = "year_class") -> Column:
    return F.pmod(F.col(year_class) - F.col("class"), F.lit(3))


def _original_year(year: Column) -> Column:
    """Year of the regular election whose term a special election of ``year`` cuts."""
    return year - F.pmod(year, F.lit(2)) - 2 * _backward()


def special_terms(special: DataFrame) -> DataFrame:
    """Distance to the class's regular year both ways, and the year of the term it cuts."""
    return (
        special.withColumn("class_diff", F.pmod(F.col("class") - F.col("year_class"), F.lit(3)))
        .withColumn("class_diff_backward", _backward())
        .withColumn("original_year", _original_year(F.col("year")))
    )


def _carry(df: DataFrame, offsets: Column) -> DataFrame:
    return (
        df.withColumn("election_year", F.col("year"))
        .withColumn("election_cur", F.explode(offsets))
        .withColumn("year", F.col("year") + F.col("election_cur"))
    )


def _regular_offsets() -> Column:
    return F.array(F.lit(0), F.lit(2), F.lit(4))


def _special_offsets() -> Column:
    """One more session if the class is up in four years, none if it is up in two."""
    class_diff = F.pmod(F.col("class") - F.col("year_class"), F.lit(3))
    return F.when(class_diff == 2, F.array(F.lit(0), F.lit(2))).otherwise(F.array(F.lit(0)))


def carry_forward(main: DataFrame) -> DataFrame:
    """Each regular row once per session of its term.

    ``election_year`` keeps the year of the vote and ``election_cur`` the distance from it.
    """
    return _carry(main, _regular_offsets())


def carry_special(special: DataFrame) -> DataFrame:
    """Special rows for the rest of the term they fill."""
    carried = _carry(special_terms(special), _special_offsets())
    return carried.withColumn("original_year", _original_year(F.col("year")))


def drop_superseded(main_carried: DataFrame, special: DataFrame) -> DataFrame:
    """Remove carried regular rows from the year in which a special election cut their term.

    Only the earliest special year of each (state, class, term) matters, so the special
    side is reduced to that before the anti join. Rows marked ``actually_special`` stay.
    """
    cuts = (
        special_terms(special)
        .groupBy(
            F.col("state").alias("_state"), F.col("class").alias("_class"), F.col("original_year").alias("_term")
        )
        .agg(F.min("year").alias("_cut"))
    )
    return main_carried.join(
        cuts,
        ~F.col("actually_special")
        & (F.col("state") == F.col("_state"))
        & (F.col("class") == F.col("_class"))
        & (F.col("election_year") == F.col("_term"))
        & (F.col("year") >= F.col("_cut")),
        "left_anti",
    )


def carry_terms(rows: DataFrame, special: DataFrame) -> DataFrame:
    """Regular and special rows carried in one pass over ``rows``, superseded terms removed.

    The same rows as ``drop_superseded(carry_forward(regular), special)`` and
    ``carry_special(special)`` together.
    """
    offsets = F.when(F.col("actually_special"), _special_offsets()).otherwise(_regular_offsets())
    return drop_superseded(_carry(rows, offsets), special)


def align_nearest(surveys: DataFrame, elections: DataFrame, date: str = "date", year: str = "year") -> DataFrame:
    """Each election row with the survey nearest to 1 November of its year, the earlier on ties.

    Only distinct days are compared: surveys are first reduced to one row per day (the
    smallest, if a day has several). The window without a partition key therefore holds at
    most one row per calendar day and year, and the result has one row per election year.
    """
    values = [c for c in surveys.columns if c != date]
    per_day = (
        surveys.where(F.col(date).isNotNull())
        .groupBy(F.col(date).cast("date").alias("_day"))
        .agg(F.min(F.struct(*values)).alias("_values"))
        .select("_day", F.struct(F.col("_day").alias("day"), F.col("_values").alias("values")).alias("_survey"))
    )
    targets = (
        elections.where(F.col(year).isNotNull())
        .select(F.col(year).alias("_year"))
        .distinct()
        .withColumn("_day", F.make_date("_year", F.lit(11), F.lit(1)))
    )
    line = per_day.unionByName(targets, allowMissingColumns=True)
    in_order = Window.orderBy("_day")
    before = in_order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.orderBy(F.desc("_day")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = line.select(
        "_year",
        "_day",
        F.last("_survey", ignorenulls=True).over(before).alias("_left"),
        F.last("_survey", ignorenulls=True).over(after).alias("_right"),
    ).where(F.col("_year").isNotNull())
    to_left = F.datediff("_day", "_left.day")
    to_right = F.datediff("_right.day", "_day")
    pick = F.when(F.col("_right").isNull() | (to_left <= to_right), F.col("_left")).otherwise(F.col("_right"))
    chosen = near.select("_year", pick.alias("_survey")).where(F.col("_survey").isNotNull())
    # A calendar year occurs once here, so at most 9,999 rows are broadcast.
    return elections.join(F.broadcast(chosen), F.col(year) == F.col("_year")).select(
        *elections.columns,
        F.col("_survey.day").alias("survey_date"),
        *[F.col(f"_survey.values.{v}").alias(v) for v in values],
    )
