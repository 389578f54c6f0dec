"""Document fingerprints by one-permutation MinHash, from DataFrame functions only.

Every five-word shingle is hashed once. The top bits of the hash name a bin, and each bin keeps
its smallest hash. An empty bin takes the value of another bin, which an own hash sequence of
the empty bin picks (optimal densification). Of each bin four low-order bits are stored, one hex
digit a bin; the likeness of two fingerprints corrects for digits that agree by chance.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pollwright.llm.common import WORD_SPLIT, cut, let

BINS = 256
BIN_BITS = 8
VALUE_BITS = 4
SHINGLE = 5
PROBES = 8
_REST = (1 << (64 - BIN_BITS)) - 1


def _longs(values: list[int]) -> Column:
    return F.array(*[F.lit(v).cast("bigint") for v in values])


def _ints(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def shingle_hashes(text: Column) -> Column:
    """One hash per shingle; a text of fewer words has one of all its words, no words none."""
    words = F.array_remove(F.split(text, WORD_SPLIT), "")

    def of(w: Column) -> Column:
        rolled = F.transform(
            F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)])
        )
        few = F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(w) >= SHINGLE, rolled).otherwise(few)

    return let(F.transform(words, lambda x: F.xxhash64(x)), of)


def fingerprint(text: Column) -> Column:
    """``BINS`` hex digits; the empty string for a text without words or null."""
    # One largest value per bin makes sure that each bin comes up once; it marks empty ones.
    largest = [((b - BINS // 2) << (64 - BIN_BITS)) | _REST for b in range(BINS)]
    rng = random.Random(5)
    probes = [_ints([rng.randrange(BINS) for _ in range(BINS)]) for _ in range(PROBES)]
    digits = F.array(*[F.lit(f"{d:x}") for d in range(1 << VALUE_BITS)])

    def smallest(s: Column) -> Column:
        new_bin = lambda x, i: ~F.shiftright(x, 64 - BIN_BITS).eqNullSafe(
            F.shiftright(F.get(s, i - 1), 64 - BIN_BITS)
        )
        return F.filter(s, new_bin)

    def value(x: Column) -> Column:
        low = x.bitwiseAND(F.lit((1 << VALUE_BITS) - 1)).cast("int")
        return F.when(x.bitwiseAND(F.lit(_REST)) != F.lit(_REST), low)

    def densified(v: Column) -> Column:
        def fill(filled: Column) -> Column:
            # Where the probes meet empty bins only: the filled bin whose hash with this one is least.
            def nearest(b: Column) -> Column:
                return F.array_min(F.transform(filled, lambda c: F.struct(F.xxhash64(b, c), F.get(v, c).alias("v"))))["v"]

            return F.transform(
                v, lambda x, b: F.coalesce(x, *[F.get(v, F.get(p, b)) for p in probes], nearest(b))
            )

        return let(F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda c: F.get(v, c).isNotNull()), fill)

    def packed(h: Column) -> Column:
        mins = let(F.sort_array(F.concat(h, _longs(largest))), smallest)
        filled = let(F.transform(mins, value), densified)
        return F.when(F.size(h) > 0, F.array_join(F.transform(filled, lambda x: F.get(digits, x)), "")).otherwise(F.lit(""))

    return let(shingle_hashes(F.coalesce(text, F.lit(""))), packed)


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1. Two empty fingerprints are alike."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda e: e))
    chance = 1 / (1 << VALUE_BITS)
    agree = (same / F.lit(float(BINS)) - chance) / (1 - chance)
    return (
        F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(agree, F.lit(0.0)))
    )


def keyed_texts(docs: DataFrame, *more: Column) -> DataFrame:
    """``kid, kn, h, text``: the id (0 for null), whether it is null, and a hash of the text
    (null as empty). Rows that agree in the three are one document. ``more`` is added."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(
        F.coalesce(doc_id, F.lit(0).cast("bigint")).alias("kid"),
        doc_id.isNull().alias("kn"),
        F.xxhash64(text).alias("h"),
        text.alias("text"),
        *more,
    )


def followed_by(keyed: DataFrame) -> DataFrame:
    """For each document the one it follows, by falling id; the first follows the last.

    ``kid, kn, h`` and, of the document before it, ``p_kid, p_kn, p_h, p_chars``. Only ids move:
    they are range partitioned, each block looks back inside itself, and each block's first row
    meets the last row of the block before (one row a block).
    """
    ids = keyed.groupBy("kid", "kn", "h").agg(F.max(F.length("text")).alias("n_chars"))
    order = [F.col("kn"), F.col("kid").desc(), F.col("h")]
    blocks = cut(ids.repartitionByRange(*order).withColumn("block", F.spark_partition_id()))
    inside = Window.partitionBy("block").orderBy(*order)
    me = F.struct(F.col("kid").alias("p_kid"), F.col("kn").alias("p_kn"), F.col("h").alias("p_h"), F.col("n_chars").alias("p_chars"))
    placed = cut(
        blocks.select(
            "*",
            me.alias("me"),
            F.lag(me).over(inside).alias("before"),
            F.lead("block").over(inside).isNull().alias("is_last"),
        )
    )
    lasts = placed.where("is_last").select("block", F.col("me").alias("before"))
    by_block = Window.orderBy("block")
    first_block = F.min("block").over(by_block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lasts = lasts.select(F.coalesce(F.lead("block").over(by_block), first_block).alias("block"), "before")
    inner = placed.where(F.col("before").isNotNull()).select("kid", "kn", "h", "before.*")
    edge = placed.where(F.col("before").isNull()).select("kid", "kn", "h", "block").join(lasts, "block")
    return inner.unionByName(edge.select("kid", "kn", "h", "before.*"))


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, whose last half is replaced by the
    start of the next document by falling id (after the last: the first).

    Columns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``. Null text is empty. Documents of equal id are ordered by a hash of the text;
    rows with equal id and text are one document in this order and get equal results; null ids
    come last. A single document follows itself; an empty table gives no rows. Other columns are
    not read. Each text is moved once, and the part of it that the document before needs once
    more.
    """
    texts = keyed_texts(docs).withColumn("fp", fingerprint(F.col("text")))
    key = ["kid", "kn", "h"]
    sent = (
        texts.join(followed_by(keyed_texts(docs)), key)
        .select(
            F.col("p_kid").alias("kid"),
            F.col("p_kn").alias("kn"),
            F.col("p_h").alias("h"),
            F.left("text", F.floor(F.col("p_chars") / 2).cast("int")).alias("tail"),
            F.col("fp").alias("next_fp"),
        )
        .groupBy(*key)
        .agg(F.first("tail").alias("tail"), F.first("next_fp").alias("next_fp"))
    )
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = texts.join(sent, key).select(
        F.when(~F.col("kn"), F.col("kid")).alias("doc_id"),
        n.cast("bigint").alias("n_chars"),
        F.concat(F.left("text", n - half), F.col("tail")).alias("edited"),
        F.col("fp").alias("fingerprint"),
        "next_fp",
    )
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        "next_fp",
    ).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fp")).alias("near_next"),
    )
