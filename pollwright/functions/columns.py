"""Scalar expressions shared by the operators. Everything here is a native column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean_text(value: Column | str) -> Column:
    """Upper-case text; null and the literal ``nan`` become empty."""
    text = F.coalesce(as_column(value).cast("string"), F.lit(""))
    return F.upper(F.when(text == "nan", "").otherwise(text))


def extract(value: Column | str, pattern: str, group: int = 1) -> Column:
    """Regex group, null where the pattern does not match."""
    return F.nullif(F.regexp_extract(as_column(value).cast("string"), pattern, group), F.lit(""))


def zero_pad(value: Column | str, width: int) -> Column:
    """Left pad with zeros; longer text is kept whole, which ``lpad`` would cut."""
    text = as_column(value)
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def to_number(value: Column | str) -> Column:
    """Double, or null where the text is not a number."""
    return as_column(value).cast("string").try_cast("double")


def to_votes(value: Column | str) -> Column:
    """Vote count as double; anything that is not a number counts 0."""
    return F.coalesce(to_number(value), F.lit(0.0))


def as_flag(value: Column | str) -> Column:
    """Boolean from a boolean or from TRUE / FALSE text; null is false."""
    return F.lower(as_column(value).cast("string")).eqNullSafe("true")


def key_text(keys: Sequence[str]) -> list[Column]:
    """Keys as text with nulls kept in place, ready for ``concat_ws``."""
    return [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]


def group_key(keys: Sequence[str]) -> Column:
    """All keys as one text that is never null and keeps null apart from empty."""
    return F.concat_ws("\x01", *[F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys])


def digest(seed: int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def unit_interval(hex_digest: Column, part: Column) -> Column:
    """One of the four 32-bit slices of an md5 digest as a number in [0, 1)."""
    hex8 = F.substr(hex_digest, part * 8 + 1, F.lit(8))
    return F.conv(hex8, 16, 10).cast("double") / F.lit(4294967296.0)


def share(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """``part / whole * scale``, null where the whole is 0."""
    return part / F.nullif(whole.cast("double"), F.lit(0.0)) * F.lit(scale)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    A column used inside a lambda is evaluated again for every element. Here the value
    becomes the variable of a lambda over a one-element array.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_sum(values: Column | str) -> Column:
    return F.aggregate(as_column(values), F.lit(0.0), lambda acc, x: acc + x)


def normalized(values: Column | str) -> Column:
    """Negative entries to 0, then divide by the sum; an all-zero row stays zero."""
    clamped = F.transform(as_column(values), lambda x: F.greatest(x, F.lit(0.0)))

    def divide(pair: Column) -> Column:
        return F.transform(pair["v"], lambda x: x / pair["s"])

    def by_sum(v: Column) -> Column:
        total = array_sum(v)
        return F.struct(v.alias("v"), F.when(total == 0.0, F.lit(1.0)).otherwise(total).alias("s"))

    return let(let(clamped, by_sum), divide)


def one_hot_array(values: Column, position: Column) -> Column:
    """0/1 array of the size of ``values`` with a single 1 at ``position``."""
    return let(position, lambda p: F.transform(values, lambda _, i: (i == p).cast("int")))


def above_spread(values: Column | str) -> Column:
    """0/1 array: entries above the mean plus the sample standard deviation of the array."""
    v = as_column(values)
    size = F.size(v)

    def bar(mean: Column) -> Column:
        spread = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
        return mean + F.sqrt(spread / F.nullif(size - 1, F.lit(0)))

    def mark(limit: Column) -> Column:
        return F.transform(v, lambda x: F.coalesce((x > limit).cast("int"), F.lit(0)))

    return let(let(array_sum(v) / size, bar), mark)


def squared_distance(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def _real(x: Column) -> Column:
    """The score, null for NaN."""
    return F.when(~F.isnan(x), x)


def preferred(a: Column, b: Column) -> Column:
    """Whether score ``a`` is above ``b``; null and NaN are below every number and alike."""
    a, b = _real(a), _real(b)
    return F.coalesce(a > b, a.isNotNull() & b.isNull())


def preference_order(scores: Column | str) -> Column:
    """Positions from most to least preferred; ties in position order, null and NaN last."""
    values = as_column(scores)
    pairs = F.transform(
        values, lambda x, i: F.struct(_real(x).isNull().alias("none"), (-_real(x)).alias("x"), i.alias("i"))
    )
    # sort_array compares compiled; array_sort would call a comparator per pair.
    return F.sort_array(pairs)["i"]


def top_position(scores: Column | str) -> Column:
    """0-based position of the largest entry, the first one on ties; null and NaN are below
    every number. Null for an empty array."""
    values = as_column(scores)
    numbers = F.transform(values, _real)
    found = F.array_position(numbers, F.array_max(numbers)) - 1
    return F.when(F.size(values) > 0, F.coalesce(found, F.lit(0))).cast("int")


def ranks(order: Column | str) -> Column:
    """Rank of every position, 1 is best, from a preference order."""
    return let(
        as_column(order),
        lambda o: F.transform(F.sequence(F.lit(0), F.size(o) - 1), lambda i: F.array_position(o, i).cast("int")),
    )


def bin_index(value: Column, low: Column, width: Column, bins: int) -> Column:
    """Equal-width bin; the top edge belongs to the last bin."""
    return F.least(F.floor((value - low) / width), F.lit(bins - 1)).cast("int")
