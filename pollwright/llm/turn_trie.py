"""Prefix trie of conversations from padded matrices of turn ids.

A conversation is a row of turn ids. Rows are range-partitioned in lexicographic order, so every
node of the trie is a run of neighbouring rows. In a shard, numpy sorts the padded matrix; a mask
says where a column changes from the row before, and once OR-ed along the columns it marks the row
at which each node of each depth starts. ``reduceat`` over these starts aggregates a whole depth.

Every figure of a node is a sum over its members. A member adds what only the row before can tell:
up to which depth it shares the path of that row. So a shard needs its own rows and one neighbour
on each side, and the nodes that reach over a shard's boundary are added up afterwards.

Rows are at most ``width`` turns long. A longer conversation continues in a row of its own, which
starts with the digest of all turns before it and so meets only rows with the same past.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pollwright.functions.scale import running_sum
from pollwright.llm.common import cut

WIDTH = 64
SHARD_ROWS = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()
PAD = np.iinfo(np.int64).min

PARTS = (
    "kind int, shard int, depth bigint, k1 bigint, k2 bigint, q1 bigint, q2 bigint, conv_id bigint, "
    "parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
    "ends binary, ends_sha256 string, open boolean"
)
NODE, FACT = 0, 1
KEY = ["depth", "k1", "k2"]


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, h1, h2, chars``: the turns of each conversation numbered from 0 by ``turn``
    (null first; equal turns in the order of their hashes), with 128 bits of role and text and the
    code points of the text. Null role or text counts as empty; rows without a conversation go."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hashed = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.xxhash64(role, text).alias("h1"),
        F.xxhash64(F.lit(1), role, text).alias("h2"),
        F.length(text).cast("bigint").alias("chars"),
    )
    numbered = running_sum(hashed, ["conv_id"], ["turn", "h1", "h2"], F.lit(1), "_n")
    return numbered.select("conv_id", (F.col("_n") - 1).alias("pos"), "h1", "h2", "chars")


def rebuilt(turns: DataFrame, shared: Column, base: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Every conversation of ``turns`` (as from ``ordered_turns``) with its first ``shared`` turns
    taken from the conversation ``base`` (both are functions of ``conv_id``; ``shared`` is at most
    ``most``): what that one has of them, then its own turns after its first ``shared``.

    Gives ``conv_id, size`` of every conversation, also of those that end up without turns, and
    ``conv_id, size, depth, h1, h2, chars`` of the turns, with depths from 1."""
    turns = cut(turns)
    firsts = (
        turns.where(F.col("pos") < most)
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "h1", "h2", "chars"))).alias("firsts"))
    )
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = convs.select("conv_id", "own", shared.cast("int").alias("shared"), base.alias("base"))
    taken = F.coalesce(F.slice("firsts", 1, F.col("shared")), F.array().cast("array<struct<pos:bigint,h1:bigint,h2:bigint,chars:bigint>>"))
    convs = convs.join(firsts, "base", "left").select("conv_id", "own", "shared", taken.alias("taken"))
    n = F.size("taken")
    convs = cut(convs.withColumn("size", n + F.greatest(F.col("own") - F.col("shared"), F.lit(0))))
    lead = convs.select("conv_id", "size", F.explode("taken").alias("t")).select(
        "conv_id", "size", (F.col("t.pos") + 1).alias("depth"), "t.h1", "t.h2", "t.chars"
    )
    own = turns.join(convs.select("conv_id", "shared", "size", n.alias("n")), "conv_id").where(F.col("pos") >= F.col("shared"))
    own = own.select("conv_id", "size", (F.col("pos") - F.col("shared") + F.col("n") + 1).alias("depth"), "h1", "h2", "chars")
    return convs.select("conv_id", "size"), lead.unionByName(own)


def _rows(convs: DataFrame, turns: DataFrame, width: int) -> DataFrame:
    """``conv_id, seg, p1, p2, t, more``: rows of at most ``width`` turns; ``t`` holds 128-bit ids of
    the turns at their depths and the code points, ``p1, p2`` are the digest of the earlier rows."""
    marked = turns.select(
        "conv_id",
        "size",
        F.floor((F.col("depth") - 1) / width).cast("bigint").alias("seg"),
        F.struct(
            "depth",
            F.xxhash64("depth", "h1", "h2").alias("e1"),
            F.xxhash64(F.lit(1), "depth", "h1", "h2").alias("e2"),
            F.col("chars").alias("chars"),
        ).alias("x"),
    )
    grouped = marked.groupBy("conv_id", "seg").agg(
        F.max("size").alias("size"),
        F.bit_xor("x.e1").alias("x1"),
        F.bit_xor("x.e2").alias("x2"),
        F.sort_array(F.collect_list("x")).alias("x"),
    )
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    rows = grouped.select(
        "conv_id",
        "seg",
        F.coalesce(F.bit_xor("x1").over(before), F.lit(0)).alias("p1"),
        F.coalesce(F.bit_xor("x2").over(before), F.lit(0)).alias("p2"),
        F.transform("x", lambda x: F.struct(x["e1"].alias("e1"), x["e2"].alias("e2"), x["chars"].alias("chars"))).alias("t"),
        (F.col("size") > (F.col("seg") + 1) * width).alias("more"),
    )
    zero = F.lit(0).cast("bigint")
    bare = convs.where("size = 0").select(
        "conv_id",
        zero.alias("seg"),
        zero.alias("p1"),
        zero.alias("p2"),
        F.array().cast(rows.schema["t"].dataType).alias("t"),
        F.lit(False).alias("more"),
    )
    return rows.unionByName(bare)


def _with_neighbours(rows: DataFrame, shard_rows: int) -> DataFrame:
    """``rows`` in range shards, each with the last row before it and the first one after it
    (``edge`` -1 and 1; 0 for its own)."""
    order = ["seg", "p1", "p2", "t", "more", "conv_id"]
    rows = cut(rows)
    shards = max(1, -(-rows.count() // shard_rows))
    ranged = cut(rows.repartitionByRange(shards, *order).withColumn("shard", F.spark_partition_id()))
    row = F.struct(*order)
    ends = ranged.groupBy("shard").agg(F.min(row).alias("low"), F.max(row).alias("high"))
    # One row a shard, and a shard is thousands of rows.
    along = Window.orderBy("shard")
    ends = ends.select("shard", F.lag("high").over(along).alias("before"), F.lead("low").over(along).alias("after"))
    edges = [
        ends.where(F.col(c).isNotNull()).select("shard", f"{c}.*", F.lit(e).alias("edge"))
        for c, e in (("before", -1), ("after", 1))
    ]
    return ranged.withColumn("edge", F.lit(0)).unionByName(edges[0]).unionByName(edges[1])


def shard_parts(shard: pa.Table, width: int = WIDTH) -> pa.Table:
    """The nodes of one shard, with its share of each node's figures."""
    shard = shard.combine_chunks()
    number = {c: shard.column(c).to_numpy(zero_copy_only=False) for c in ("conv_id", "seg", "p1", "p2", "more", "edge")}
    lists = shard.column("t").combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    n, w = len(size), int(size.max(initial=0))
    ends = np.cumsum(size)
    at = np.repeat(np.arange(n), size), np.arange(len(values)) - np.repeat(ends - size, size)
    ids = np.full((2, n, w), PAD)
    chars = np.zeros((n, w), np.int64)
    ids[0][at], ids[1][at] = values.field(0).to_numpy(), values.field(1).to_numpy()
    chars[at] = values.field(2).to_numpy()

    keys = [number["conv_id"], number["more"]]
    for d in reversed(range(w)):
        keys += [ids[1][:, d], ids[0][:, d]]
    order = np.lexsort([*keys, number["p2"], number["p1"], number["seg"]])
    conv, seg, p1, p2, more, edge = (number[c][order] for c in ("conv_id", "seg", "p1", "p2", "more", "edge"))
    ids, chars, size = ids[:, order], chars[order], size[order]
    own = edge == 0

    # changed[i, d]: whether row i has another path of d turns than row i - 1.
    changed = np.ones((n, w + 1), bool)
    changed[1:, 0] = (seg[1:] != seg[:-1]) | (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])
    changed[1:, 1:] = (ids[:, 1:] != ids[:, :-1]).any(axis=0)
    changed = np.logical_or.accumulate(changed, axis=1)
    common = (~changed[:, 1:] & (np.arange(w) < size[:, None])).sum(axis=1)
    text = np.concatenate([np.zeros((n, 1), np.int64), np.cumsum(chars, axis=1)], axis=1)
    shared_text = text[np.arange(n), common]
    # The last row of a node on which all its members end, and none goes on.
    followed = np.zeros(n, bool)
    followed[:-1] = ~changed[1:, 0] & (common[1:] >= size[:-1])
    leaf = own & ~more & ~followed
    key = np.zeros((2, n, w + 1), np.int64)
    key[:, :, 0] = p1, p2
    for d in range(w):
        key[:, :, d + 1] = key[:, :, d] ^ np.where(ids[:, :, d] == PAD, 0, ids[:, :, d])

    out: list[dict] = []
    up_closed = np.zeros(n, bool)  # per row: whether its node one turn up is wholly here
    up_conv = np.zeros(n, np.int64)
    names = conv.astype(str)
    for d in range(w + 1):
        inside = np.flatnonzero(size >= d)
        if not len(inside):
            break
        first = np.flatnonzero(changed[inside, d])
        run = np.cumsum(changed[inside, d]) - 1

        def total(x: np.ndarray) -> np.ndarray:
            return np.add.reduceat(x[inside].astype(np.int64), first)

        here = own[inside]
        members = total(own)
        lowest = np.minimum.reduceat(np.where(here, conv[inside], np.iinfo(np.int64).max), first)
        children = total(own & (size > d) & (common <= d))
        saved = total(np.where(own, np.maximum(shared_text - text[:, d - 1], 0), 0)) if d else total(np.where(own, shared_text, 0))
        leaves = total(leaf)
        closed = (members == np.add.reduceat(np.ones(len(inside), np.int64), first)) & (total(more) == 0) & (d > 0)
        start = inside[first]
        ending = own & ~more & (size == d)
        stop = np.append(first[1:], len(inside))
        for j in np.flatnonzero(members):
            i = start[j]
            row = {
                "depth": int(seg[i]) * width + d,
                "k1": int(key[0, i, d]),
                "k2": int(key[1, i, d]),
                "open": not closed[j],
            }
            if d == 0 and seg[i]:
                # The members of this node are counted where its path ends; here are its children.
                out.append(row | {"n_children": int(children[j])})
                continue
            rows = inside[first[j] : stop[j]]
            rows = rows[ending[rows]]
            joined = ",".join(names[rows]).encode()
            row |= {
                "conv_id": int(lowest[j]),
                "n_convs": int(members[j]),
                "n_children": int(children[j]),
                "n_leaves": int(leaves[j]),
                "saved_tokens": int(saved[j]),
                "ends": joined if len(rows) and not closed[j] else None,
                "ends_sha256": hashlib.sha256(joined).hexdigest() if closed[j] else None,
            }
            if d:
                row |= {"q1": int(key[0, i, d - 1]), "q2": int(key[1, i, d - 1])}
                row["parent_conv_id"] = int(up_conv[i]) if up_closed[i] else None
            out.append(row)
        up_closed[inside], up_conv[inside] = closed[run], lowest[run]
    for i in np.flatnonzero(own & (more | (seg > 0))):
        out.append(
            {"kind": FACT, "conv_id": int(conv[i]), "depth": int(seg[i]), "saved_tokens": int(shared_text[i]), "n_leaves": int(leaf[i])}
        )
    rest = {"kind": NODE, "shard": shard.column("shard")[0].as_py()}
    for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
        rest[c] = 0
    return pa.Table.from_pylist([rest | r for r in out], schema=_ARROW)


_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
_ARROW = pa.schema([(c.split()[0], _TYPES[c.split()[1]]) for c in PARTS.split(", ")])


def _digests(chunks: DataFrame) -> DataFrame:
    """``depth, k1, k2, ends_sha256`` over the chunks ``ends`` of each node in the order of the
    shards. A digest has to see its bytes in order, so a node's chunks pass through one task, as a
    stream; a chunk is what a whole shard holds of the node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest, done = None, None, []

        def taken() -> pa.RecordBatch:
            columns = [pa.array(c) for c in zip(*done)]
            return pa.record_batch(columns, names=[*KEY, "ends_sha256"])

        for batch in batches:
            for *key, ends in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2)], batch.column(4)):
                if key != now:
                    if now is not None:
                        done.append((*now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(ends.as_buffer())
                else:
                    digest.update(b",")
                    digest.update(ends.as_buffer())
            if len(done) >= 8192:
                yield taken()
                done = []
        if now is not None:
            done.append((*now, digest.hexdigest()))
            yield taken()

    sorted_chunks = chunks.select(*KEY, "shard", "ends").repartition(*KEY).sortWithinPartitions(*KEY, "shard")
    return sorted_chunks.mapInArrow(run, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per node of the trie of ``turns(conv_id, size, depth, h1, h2, chars)``, where
    ``convs(conv_id, size)`` lists every conversation with its number of turns.

    ``conv_id`` (the smallest member), ``depth, parent_conv_id`` (that of the node one turn up, null
    for the root), ``n_convs, n_children, n_leaves`` (childless nodes in the subtree),
    ``saved_tokens`` (over the subtree, each node's last text times its members but one, in code
    points) and ``ends_sha256``, of the ids of the members that end at the node, ascending and joined
    by commas. No conversations give no nodes; equal ones are members of the same nodes, and however
    many they are, they are spread over shards. Columns other than those named are not read.
    """
    spread = _with_neighbours(_rows(convs, turns, width), shard_rows)
    # A shard is one group: about ``shard_rows`` short rows.
    found = cut(spread.groupBy("shard").applyInArrow(lambda t: shard_parts(t, width), PARTS))
    nodes = found.where(F.col("kind") == NODE)

    # What a member's later rows add to every node on its path: sums over these rows alone.
    later = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)
    facts = found.where(F.col("kind") == FACT).select(
        "conv_id",
        F.col("depth").alias("seg"),
        F.sum("saved_tokens").over(later).alias("saved"),
        F.sum("n_leaves").over(later).alias("leaves"),
    )
    path = (
        spread.where("edge = 0 and more")
        .join(facts.where((F.col("saved") > 0) | (F.col("leaves") > 0)), ["conv_id", "seg"])
        .select("conv_id", "seg", "p1", "p2", "t", "saved", "leaves")
    )
    state = F.struct(F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    steps = F.aggregate(
        "t",
        F.array(state),
        lambda a, x: F.array_append(
            a,
            F.struct(
                F.element_at(a, -1)["k1"].bitwiseXOR(x["e1"]).alias("k1"),
                F.element_at(a, -1)["k2"].bitwiseXOR(x["e2"]).alias("k2"),
            ),
        ),
    )
    added = path.select("seg", "saved", "leaves", F.posexplode(steps).alias("d", "k")).where((F.col("d") > 0) | (F.col("seg") == 0))
    none = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    added = added.select(
        (F.col("seg") * width + F.col("d")).alias("depth"),
        "k.k1",
        "k.k2",
        none.alias("q1"),
        none.alias("q2"),
        none.alias("conv_id"),
        zero.alias("n_convs"),
        zero.alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
    )
    opened = nodes.where("open")
    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    merged = (
        opened.select(*KEY, "q1", "q2", "conv_id", *sums)
        .unionByName(added)
        .groupBy(*KEY)
        .agg(F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums])
    )
    digests = _digests(opened.where(F.col("ends").isNotNull()))
    merged = cut(
        merged.join(digests, KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    )
    columns = ["conv_id", "depth", *sums, "ends_sha256"]
    closed = nodes.where("not open")
    known = closed.where(F.col("parent_conv_id").isNotNull()).select(*columns, "parent_conv_id")
    # The parent of a node that reaches over a boundary does so too, so parents are looked up there.
    lost = closed.where(F.col("parent_conv_id").isNull()).select(*columns, "q1", "q2").unionByName(merged.select(*columns, "q1", "q2"))
    up = merged.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    looked = lost.join(up, ["depth", "q1", "q2"], "left").select(*columns, "parent_conv_id")
    return known.unionByName(looked).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )
