"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a non-zero vector of radius + 1 bits. For each non-zero vector v, one
mask keeps the positions whose vector has an odd product with v. The vectors of ``radius``
positions span less than the whole space, so some v has an even product with each of them: its
mask leaves all these positions out. So two fingerprints within the radius agree under at least
one of the 2^(radius+1) - 1 masks, and no pair is lost.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollwright.llm.common import cut, slices
from pollwright.llm.components import smallest_reachable

BITS = 64
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def covering_masks(radius: int, seed: int = 11) -> list[int]:
    """Masks as signed 64-bit integers; any ``radius`` positions are left out by one of them."""
    kinds = (1 << (radius + 1)) - 1
    vectors = [1 + i % kinds for i in range(BITS)]  # evenly, so that all masks are about as long
    random.Random(seed).shuffle(vectors)
    masks = []
    for v in range(1, 1 << (radius + 1)):
        mask = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)
        masks.append(mask - (1 << BITS) if mask >> (BITS - 1) else mask)
    return masks


def simhash(text: str, shingle: int = 3) -> int:
    """The fingerprint as an unsigned integer: a bit is set if it is in over half the hashes."""
    words = text.encode().translate(_LOWER).split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(shingle, n)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist())
    hashes = np.array([digest(line[a:b], 42) for a, b in spans], dtype="<u8")
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, *more: Column) -> DataFrame:
    """``doc_id, fp`` (signed 64 bits) and ``more``, columns of type bigint, for every row; null
    and wordless texts give zero."""
    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *more)
    names = ["doc_id", "fp", *slim.columns[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            fps = [simhash(t or "", shingle) for t in part.column(1).to_pylist()]
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.record_batch([part.column(0), fp, *part.columns[2:]], names=names)

    return slim.mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def links(classes: DataFrame, radius: int, pair_up_to: int = 32) -> DataFrame:
    """Links ``(a, b)`` between the different fingerprints ``fp`` of ``classes``, each within
    ``radius`` (at most 2) bits, that connect all that are within ``radius`` bits.

    Candidates agree under a mask. A bucket of up to ``pair_up_to`` members compares them with
    each other. A larger one goes an exact way that is linear in its members: two values are
    within two bits if and only if some value is at most one bit away from both. Each member
    names these values (only bits that the mask leaves out can differ). At most 65 members can
    name the same value; those within the radius of the smallest of them are linked to it, and
    under radius 1 the others to the value itself if it is a member.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the radius must be 0, 1 or 2")
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("m")) for i, m in enumerate(covering_masks(radius))])
    keyed = (
        classes.select("fp", F.explode(tables).alias("x"))
        .select("fp", "x.t", "x.m")
        .withColumn("key", F.col("fp").bitwiseAND(F.col("m")))
    )
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = cut(keyed.join(sizes, ["t", "key"]))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius

    small = keyed.where(F.col("n") <= pair_up_to)
    left, right = small.select("t", "key", F.col("fp").alias("a")), small.select("t", "key", F.col("fp").alias("b"))
    pairs = left.join(right, ["t", "key"]).where((F.col("a") < F.col("b")) & near)

    flips = F.array(*[F.lit(0).cast("bigint")], *[F.lit(1 << i if i < 63 else -(1 << 63)) for i in range(BITS)])
    named = (
        keyed.where(F.col("n") > pair_up_to)
        .select("m", "fp", F.explode(flips).alias("flip"))
        .where(F.col("m").bitwiseAND(F.col("flip")) == 0)
        .groupBy(F.col("fp").bitwiseXOR(F.col("flip")).alias("centre"))
        .agg(F.collect_set("fp").alias("members"))
        .where(F.size("members") > 1)
    )
    hub = F.array_min("members") if radius == 2 else F.col("centre")
    stars = named.where((F.lit(radius) == 2) | F.array_contains("members", F.col("centre")))
    stars = stars.select(hub.alias("a"), F.explode("members").alias("b")).where((F.col("a") != F.col("b")) & near)
    return pairs.select("a", "b").union(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest id among the documents that can be reached over links of at
    most ``radius`` bits, null if none of them has an id. Equal fingerprints are one class before
    anything is compared, so copies are never expanded into pairs. Null, empty and wordless texts
    have the fingerprint zero and are linked like others. Repeated rows give equal rows; other
    columns are not read; an empty table gives an empty result.
    """
    marked = cut(fingerprints(docs, shingle))
    placed = _components(marked, F.col("doc_id"), radius)
    first = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    component = cut(placed.join(first, "component").select("fp", "component_id"))
    return marked.join(component, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _components(marked: DataFrame, order: Column, radius: int) -> DataFrame:
    """``fp, first, component`` of all fingerprints; ``first`` is the least ``order`` of its rows."""
    classes = cut(marked.groupBy("fp").agg(F.min(order).alias("first")))
    reached = smallest_reachable(links(classes, radius)).withColumnRenamed("node", "fp")
    return classes.join(reached, "fp", "left").withColumn("component", F.coalesce("component", "fp"))


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row of each group of near duplicates, with all columns: the one with the smallest id.

    Where rows of a group share that id, or have none, the smallest hash of the text decides, and
    among rows of equal id and text the smallest of the other columns as JSON. A row without an
    id stays only where its whole group has none. An id whose texts lead several groups stays
    once for each of them.
    """
    text = F.col("text").cast("string")
    # 128 bits, so that different texts don't meet.
    hashes = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]
    marked = cut(fingerprints(docs, shingle, *hashes))
    key = ["kn", "kid", "h1", "h2"]
    kid = [F.col("doc_id").isNull().alias("kn"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("kid")]
    placed = _components(marked, F.struct(*kid, "h1", "h2"), radius)
    winners = cut(placed.groupBy("component").agg(F.min("first").alias("first")).select("first.*"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rest = F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    # Equal texts are in one group, so a key is the key of one group.
    found = docs.select(*kid, *hashes, row, rest.alias("rest")).join(winners, key)
    return found.groupBy(*key).agg(F.min_by("row", "rest").alias("row")).select("row.*")
