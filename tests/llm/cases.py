"""A small documents table with the awkward rows that every operator must take."""

from __future__ import annotations

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that the operators also use inside.
        *[T.StructField(c, T.StringType()) for c in ("row", "fp", "h", "kid", "tokens", "key", "kept", "p", "at")],
    ]
)


def long_text(seed: int, words: int = 4000) -> str:
    return " ".join(f"w{(seed * 7919 + i * i) % 977}x{i % 31}" for i in range(words))


def texts() -> list[tuple[int | None, str | None]]:
    base = "the quick brown fox jumps over the lazy dog while seven other animals watch from the hill and say nothing at all"
    shared = "Shared line of many documents."
    rows = [
        (0, None),
        (1, ""),
        (2, " \t\n\x0b\x0c\r "),
        (3, "one"),
        (4, "Two  words"),
        (5, base),
        (6, base),
        (7, base + " tail"),
        (8, base.upper()),
        (9, long_text(1)),
        (10, long_text(1) + " end"),
        (11, "a b c a b c a b c " * 30),
        (12, "word " * 80),
        (13, "Ünï ÇÉ straße ÀB İ Σ 中文 😀 é   nb\x1csep"),
        (14, "it's <|endoftext|> they're!!'s <|startoftext|"),
        (15, "% # $ | < > & * " * 20),
        (16, "\n\n  \n" + base + "\n\n" + base),
        (None, "no id here " + base),
        (None, "no id here " + base),
        (None, None),
        (17, base),
        (17, base),
        (17, "same id, other text"),
        (-3, long_text(5, 300)),
    ]
    rows += [(100 + i, f"{' ' * (i % 3)}{shared if i % 2 else shared.upper()}\r\nown text {i} {long_text(i, 60)}\nÉshared") for i in range(12)]
    rows += [(200 + i, f"only nine {i}\nnine line") for i in range(9)]
    return rows


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    data = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t), *["clash"] * 9) for i, t in rows]
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def by_id(rows, key="doc_id"):
    """Rows as sorted tuples, nulls first."""
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v) if not isinstance(v, list) else v for v in r))
