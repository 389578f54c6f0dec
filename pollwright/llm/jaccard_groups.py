"""Jaccard join of shingle sets through a token-group matrix.

Similar sets are put into groups of about 64. A group keeps the union of its members' tokens, its
row of the token-group matrix, and the members as bits over that union. A query set that has fewer
than the needed tokens in the union has no partner in the group, so the group stays closed to it;
only qualifying queries meet the members, and the exact intersection decides.

Which groups a query is compared with at all: a linked pair differs in few tokens. Tokens are dealt
by hash into more parts than that, so a linked pair agrees on whole parts, and the digest of a part
(its signature) brings both together. Sizes are cut into bands, so that the number of parts fits.

Equal sets are one class. Links are followed only until everything that shares a signature is
connected: a group meets one group per signature first, that of the most central text. Of the groups
that are then still apart, those meet each other that a bound on the number of differing tokens, taken
from a few parity bits a set, does not keep apart. Both bounds are exact, so no link is lost, and a huge
group of near copies is not taken to all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollwright.llm.common import cut, slices
from pollwright.llm.components import smallest_reachable

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
U = np.uint64
GROUP_MEMBERS, GROUP_TOKENS = 64, 1 << 20
BUCKET, SHARD_ENTRIES = 4096, 1 << 16  # holders of one signature, entries of many, in a task's memory
PARTNERS = 32  # groups that meet one group in a task's memory
SPARE = 1  # parts beyond those that can differ, so that empty ones need not count
GROWTH = 1.35  # of the sizes in a band
FLUSH = 1 << 20  # signatures that a task sorts at a time
SHARD_SIGNATURES = 1 << 20
SIGNATURES_PER_BYTE = 0.03  # only for the number of shards


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + U((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingle_sets(texts: list[str], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all texts as sorted 64-bit hashes, text after text, and the size
    of each text's set."""
    words, counts, odd = [], [], {}
    for i, t in enumerate(texts):
        ws = t.encode().translate(_LOWER).split()
        if 0 < len(ws) < shingle:
            odd[i] = xxhash.xxh64_intdigest(b" ".join(ws), 1)
            ws = []
        words += ws
        counts.append(len(ws))
    coded = pa.array(words, pa.binary()).dictionary_encode()
    digest = xxhash.xxh64_intdigest
    known = np.array([digest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    at = known[coded.indices.to_numpy()] if words else np.zeros(0, np.uint64)
    counts = np.array(counts, np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    n = max(0, len(at) - shingle + 1)
    value = np.zeros(n, np.uint64)
    for k in range(shingle):
        value = mix(value + at[k : k + n], k + 1)
    inside = owner[:n] == owner[shingle - 1 : shingle - 1 + n] if n else np.zeros(0, bool)
    owner, value = owner[:n][inside], value[inside]
    if odd:
        owner = np.concatenate([owner, np.fromiter(odd, np.int64, len(odd))])
        value = np.concatenate([value, np.array(list(odd.values()), np.uint64)])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[first], np.bincount(owner[first], minlength=len(texts))


def set_digests(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two signed numbers; 0 for empty sets."""
    some = np.flatnonzero(sizes)
    starts = (np.cumsum(sizes) - sizes)[some]
    found = np.zeros((2, len(sizes)), np.uint64)
    if len(some):
        found[0][some] = np.bitwise_xor.reduceat(mix(values, 7), starts)
        found[1][some] = np.add.reduceat(mix(values, 8), starts)
    return found[0].view(np.int64), found[1].view(np.int64)


@cache
def bands(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower ends of the size bands up to ``largest``, per band the largest size that can link
    with one of its sizes, and the number of parts (0 where only equal sets can link)."""
    low = [1]
    while low[-1] <= largest:
        low.append(max(low[-1] + 1, int(low[-1] * max(GROWTH, 100 / percent))))
    top = np.array(low[1:], np.int64) - 1
    reach = top * 100 // percent
    # Sets of a and b tokens that link differ in at most (a + b) (100 - p) / (100 + p) of them.
    differ = (top + reach) * (100 - percent) // (100 + percent)
    return np.array(low[:-1], np.int64), reach, np.where(differ > 0, differ + 1 + SPARE, 0)


def signatures(values: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """``(set number, signature)`` of all sets: each in its own band, and in the band below if it
    is small enough to link with a set from there.

    At most ``differ`` parts of a linked pair differ, so at least 1 + SPARE are equal. A set with
    up to SPARE empty parts leaves those out: of the equal ones at least one is not empty. A
    set with more of them gives the signatures of its empty parts as well."""
    low, reach, parts = bands(percent, 1 << max(4, int(sizes.max(initial=1)).bit_length()))
    own = np.searchsorted(low, sizes, side="right") - 1
    starts = np.cumsum(sizes) - sizes
    owners, found = [], []
    for shift in (0, 1):
        band = own - shift
        takes = (sizes > 0) & (band >= 0)
        takes[takes] &= (sizes[takes] <= reach[band[takes]]) & (parts[band[takes]] > 0)
        who = np.flatnonzero(takes)
        if not len(who):
            continue
        m, n, b = parts[band[who]], sizes[who], band[who]
        offset = np.cumsum(m) - m
        owner = np.repeat(np.arange(len(who)), n)
        at = np.repeat(starts[who] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        token = values[at]
        cell = offset[owner] + ((mix(token, 11) >> U(32)) % m[owner].astype(np.uint64)).astype(np.int64)
        order = np.argsort(cell, kind="stable")
        cell, token = cell[order], mix(token[order], 13)
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        content = np.zeros(m.sum(), np.uint64)
        content[cell[first]] = np.add.reduceat(token, first)
        filled = np.zeros(len(content), bool)
        filled[cell[first]] = True
        whose = np.repeat(np.arange(len(who)), m)
        empty = m - np.bincount(whose[filled], minlength=len(who))
        given = filled | (empty > SPARE)[whose]
        name = (np.arange(len(content)) - offset[whose]).astype(np.uint64) | (b[whose].astype(np.uint64) << U(40))
        owners.append(who[whose[given]])
        found.append(mix(content[given] ^ mix(name[given], 17), 19))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(found)


def _row_key(docs: DataFrame) -> list:
    """What tells rows of different id or text apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit(1), text).alias("t2"),
        text.alias("text"),
    ]


_FOUND = (
    "kind int, doc_id bigint, t1 bigint, t2 bigint, n bigint, d1 bigint, d2 bigint, "
    "shard int, sigs binary, handles binary, many binary"
)
ROW, SHARED, KNOWN = 0, 1, 2


def _signed_rows(docs: DataFrame, shingle: int, percent: int, bits: int) -> DataFrame:
    """Three kinds of rows. ROW: a document with the size and the digest of its set. SHARED: blocks
    of signatures with the first half of the digests, sorted, one block for each shard of
    signatures. KNOWN: a further holder (``d1``) of a signature (``d2``) that several sets of the
    task have; it need not be sent to the shard, as the first one says so (``many``)."""
    names = [c.split()[0] for c in _FOUND.split(", ")]
    schema = pa.schema(
        [(n, {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for n, c in zip(names, _FOUND.split(", "))]
    )

    def batch(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.record_batch(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema
        )

    def blocks(sig: np.ndarray, handle: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((handle, sig))
        sig, handle = sig[order], handle[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (handle[1:] != handle[:-1])
        sig, handle = sig[new], handle[new]
        first = np.ones(len(sig), bool)
        first[1:] = sig[1:] != sig[:-1]
        many = np.append(~first[1:], False)[first]
        if not first.all():
            yield batch(kind=[KNOWN] * int((~first).sum()), d1=handle[~first], d2=sig[~first].view(np.int64))
        sig, handle = sig[first], handle[first]
        shard = (sig >> U(64 - bits)).astype(np.int64) if bits else np.zeros(len(sig), np.int64)
        cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
        rows = [(int(shard[a]), sig[a:b].tobytes(), handle[a:b].tobytes(), many[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:])]
        for a in range(0, len(rows), 64):
            s, x, h, m = zip(*rows[a : a + 64])
            yield batch(kind=[SHARED] * len(s), shard=s, sigs=x, handles=h, many=m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, handles, waiting = [], [], 0
        for part in slices(batches):
            values, sizes = shingle_sets(part.column(3).to_pylist(), shingle)
            d1, d2 = set_digests(values, sizes)
            yield batch(kind=[ROW] * len(sizes), doc_id=part.column(0), t1=part.column(1), t2=part.column(2), n=sizes, d1=d1, d2=d2)
            owner, sig = signatures(values, sizes, percent)
            sigs.append(sig)
            handles.append(d1[owner])
            waiting += len(sig)
            if waiting >= FLUSH:
                yield from blocks(np.concatenate(sigs), np.concatenate(handles))
                sigs, handles, waiting = [], [], 0
        if waiting:
            yield from blocks(np.concatenate(sigs), np.concatenate(handles))

    return docs.select(*_row_key(docs)).mapInArrow(run, _FOUND)


def _shared_signatures(found: DataFrame) -> DataFrame:
    """``sig, handle`` of the signatures that several sets have, from the blocks of all tasks."""

    def meet(block: pa.Table) -> pa.Table:
        sig = np.concatenate([np.frombuffer(b.as_buffer(), np.uint64) for b in block.column("sigs")])
        handle = np.concatenate([np.frombuffer(b.as_buffer(), np.int64) for b in block.column("handles")])
        many = np.concatenate([np.frombuffer(b.as_buffer(), bool) for b in block.column("many")])
        order = np.argsort(sig, kind="stable")
        sig, handle, many = sig[order], handle[order], many[order]
        first = np.flatnonzero(np.diff(sig, prepend=~sig[:1]) != 0)
        run = np.cumsum(np.bincount(first, minlength=len(sig))) - 1
        several = np.logical_or.reduceat(many, first)
        several |= np.minimum.reduceat(handle, first) != np.maximum.reduceat(handle, first)
        keep = several[run]
        return pa.table({"sig": sig[keep].view(np.int64), "handle": handle[keep]})

    met = found.where(F.col("kind") == SHARED).groupBy("shard").applyInArrow(meet, "sig bigint, handle bigint")

    known = found.where(F.col("kind") == KNOWN).select(F.col("d2").alias("sig"), F.col("d1").alias("handle"))
    return met.union(known).distinct()


def links_of(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def connected(n: int, pairs: list[tuple[int, int]]) -> np.ndarray:
    """The smallest member of each number's connected part."""
    up = list(range(n))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return np.array([top(i) for i in range(n)], np.int64)


_GROUP = "grp bigint, node string, d1 bigint, d2 bigint, n bigint, parity binary, union binary, bits binary, sizes binary, nodes binary"
PARITY_BITS = 256


def parities(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A row of bits per set; each token turns one bit over. Two sets differ in at least as many
    tokens as these rows do in bits."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    cell = owner * PARITY_BITS + (mix(values, 23) >> U(64 - PARITY_BITS.bit_length() + 1)).astype(np.int64)
    odd = np.bincount(cell, minlength=len(sizes) * PARITY_BITS) % 2
    return np.packbits(odd.reshape(len(sizes), PARITY_BITS).astype(bool), axis=1)


def group_rows(grp: int, values: np.ndarray, sizes: np.ndarray, ids: list[tuple[int, int]], percent: int) -> list[dict]:
    """A row per member with the node of its connected part in the group, and on the first row the
    group's token union, the members' bits over it, their sizes and nodes."""
    union, column = np.unique(values, return_inverse=True)
    bits = np.zeros((len(sizes), len(union)), bool)
    bits[np.repeat(np.arange(len(sizes)), sizes), column] = True
    packed = np.packbits(bits, axis=1)
    pairs = []
    for i in range(len(sizes) - 1):
        inter = np.bitwise_count(packed[i] & packed[i + 1 :]).sum(axis=1, dtype=np.int64)
        pairs += [(i, i + 1 + int(j)) for j in np.flatnonzero(links_of(inter, sizes[i], sizes[i + 1 :], percent))]
    part = connected(len(sizes), pairs)
    names = [f"{d1}:{d2}:{n}" for (d1, d2), n in zip(ids, sizes.tolist())]
    rows = [
        {"grp": grp, "node": names[p], "d1": i[0], "d2": i[1], "n": n, "parity": x.tobytes()}
        for p, i, n, x in zip(part, ids, sizes.tolist(), parities(values, sizes))
    ]
    rows[0] |= {
        "union": union.tobytes(),
        "bits": packed.tobytes(),
        "sizes": sizes.astype(np.int64).tobytes(),
        "nodes": "\n".join(names[p] for p in part).encode(),
    }
    return rows


class Group:
    """What a group's first row holds, read again."""

    def __init__(self, union: bytes, bits: bytes, sizes: bytes, nodes: bytes):
        self.union = np.frombuffer(union, np.uint64)
        self.sizes = np.frombuffer(sizes, np.int64)
        self.bits = np.frombuffer(bits, np.uint8).reshape(len(self.sizes), -1)
        self.nodes = nodes.decode().split("\n")

    def on(self, columns: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The bits of some members over some tokens of the union."""
        return np.packbits(np.unpackbits(self.bits[rows], axis=1, count=len(self.union))[:, columns], axis=1)


def cross_links(a: Group, b: Group, percent: int) -> set[tuple[str, str]]:
    """Nodes of ``a`` and ``b`` with a link between them. A member is opened if the other group's
    token union holds as much of it as any link needs."""
    at = np.searchsorted(b.union, a.union)
    at[at == len(b.union)] = 0
    in_a = b.union[at] == a.union
    in_b = np.zeros(len(b.union), bool)
    in_b[at[in_a]] = True

    def qualifying(g: Group, shared: np.ndarray) -> np.ndarray:
        bound = np.bitwise_count(g.bits & np.packbits(shared)).sum(axis=1, dtype=np.int64)
        return np.flatnonzero(100 * bound >= percent * g.sizes)

    rows_a, rows_b = qualifying(a, in_a), qualifying(b, in_b)
    if not len(rows_a) or not len(rows_b):
        return set()
    # Both unions are sorted, so the shared tokens have the same order in both.
    bits_a, bits_b = a.on(np.flatnonzero(in_a), rows_a), b.on(np.flatnonzero(in_b), rows_b)
    found = set()
    for i, bits in zip(rows_a, bits_a):
        inter = np.bitwise_count(bits & bits_b).sum(axis=1, dtype=np.int64)
        for j in np.flatnonzero(links_of(inter, a.sizes[i], b.sizes[rows_b], percent)):
            found.add((a.nodes[i], b.nodes[rows_b[j]]))
    return found


def _meet(pairs: DataFrame, blobs: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between nodes, for pairs ``x, y`` of groups. The partners of a group are
    dealt into portions, so that a task holds few of them however many there are."""
    many = pairs.groupBy("x").agg(F.ceil(F.count("*") / PARTNERS).alias("portions"))
    dealt = cut(pairs.join(many, "x").select("x", "y", F.pmod(F.xxhash64("y"), F.col("portions")).alias("portion")))
    sides = blobs.select(F.col("grp").alias("y"), "union", "bits", "sizes", "nodes")
    partners = dealt.join(sides, "y").select("x", "portion", F.lit(False).alias("centre"), "union", "bits", "sizes", "nodes")
    centres = dealt.select("x", "portion").distinct().join(sides.withColumnRenamed("y", "x"), "x")
    centres = centres.select("x", "portion", F.lit(True).alias("centre"), "union", "bits", "sizes", "nodes")

    def test(rows: pa.Table) -> pa.Table:
        groups = [Group(*r) for r in zip(*[rows.column(c).to_pylist() for c in ("union", "bits", "sizes", "nodes")])]
        centre = rows.column("centre").to_pylist()
        hub = groups[centre.index(True)]
        found = set().union(*[cross_links(hub, g, percent) for g, c in zip(groups, centre) if not c])
        return pa.table({"a": pa.array([a for a, _ in found], pa.string()), "b": pa.array([b for _, b in found], pa.string())})

    return partners.unionByName(centres).groupBy("x", "portion").applyInArrow(test, "a string, b string")


def _apart_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """Pairs ``x, y`` of groups that hold sets of ``entries(sig, grp, component, n, parity)`` with the
    same signature, of different components, that the bits of ``parities`` do not tell apart.

    A task takes many signatures. The holders of a signature of more than ``BUCKET`` are dealt into
    portions, and a task takes two of them; the comparison of all pairs stays inside numpy, and only
    what passes it is a row."""
    buckets = entries.groupBy("sig").agg(F.ceil(F.count("*") / BUCKET).alias("portions"))
    tasks = max(1, -(-entries.count() // SHARD_ENTRIES))
    dealt = entries.join(buckets, "sig").withColumn("portion", F.pmod(F.xxhash64("grp", "n", "parity"), F.col("portions")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("portions") - 1))).select(
        "sig",
        "grp",
        "component",
        "n",
        "parity",
        "portion",
        F.least("portion", "other").alias("lo"),
        F.greatest("portion", "other").alias("hi"),
        F.when(F.col("portions") == 1, F.pmod(F.xxhash64("sig"), F.lit(tasks))).otherwise(F.col("sig")).alias("task"),
    )

    def compare(rows: pa.Table) -> pa.Table:
        sig, grp, n, portion, lo, hi = (rows.column(c).to_numpy() for c in ("sig", "grp", "n", "portion", "lo", "hi"))
        component = rows.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
        bits = np.frombuffer(b"".join(rows.column("parity").to_pylist()), np.uint64).reshape(-1, PARITY_BITS // 64)
        order = np.argsort(sig, kind="stable")
        cuts = np.flatnonzero(np.diff(sig[order], prepend=~sig[order][:1], append=~sig[order][-1:]))
        found = [np.zeros((0, 2), np.int64)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            i = order[a:b]
            cross = lo[i[0]] != hi[i[0]]
            left = i[portion[i] == lo[i[0]]] if cross else i
            right = i[portion[i] == hi[i[0]]] if cross else i
            step = max(1, (1 << 20) // max(1, len(right)))
            for at in range(0, len(left), step):
                some = left[at : at + step, None]
                differ = np.bitwise_count(bits[some[:, 0], None] ^ bits[right]).sum(axis=2, dtype=np.int64)
                near = differ * (100 + percent) <= (n[some] + n[right]) * (100 - percent)
                x, y = np.nonzero(near & (component[some] != component[right]) & (grp[some] != grp[right]))
                x, y = grp[some[x, 0]], grp[right[y]]
                found.append(np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"x": pairs[:, 0], "y": pairs[:, 1]})

    return dealt.groupBy("task", "lo", "hi").applyInArrow(compare, "x bigint, y bigint").distinct()


def similar_sets(docs: DataFrame, shingle: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``.

    Two documents link when their sets of distinct shingles of ``shingle`` words (A-Z lower-cased;
    with fewer words the whole sequence) share at least ``percent`` percent of their union.
    ``component_id`` is the smallest id that can be reached over links, the document's own included, null
    where none of them has an id. Null, empty and wordless texts have no shingles and link with
    nothing. Repeated rows link with each other; other columns are not read; an empty table gives
    an empty result.
    """
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    bits = min(24, max(0, int(total * SIGNATURES_PER_BYTE / SHARD_SIGNATURES).bit_length()))
    found = cut(_signed_rows(docs, shingle, percent, bits))
    rows = found.where(F.col("kind") == ROW).select("doc_id", "t1", "t2", "n", "d1", "d2")
    shared = cut(_shared_signatures(found))

    # One document of each set that shares a signature. A handle is half a digest; should two sets
    # have the same, both are taken.
    classes = rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("row"), F.min("doc_id").alias("first"))
    # A set is central if many others have its signatures: the text that others are edited from.
    held_by = shared.groupBy("sig").agg(F.count("*").alias("holders"))
    by_handle = shared.join(held_by, "sig").groupBy("handle").agg(F.min("sig").alias("g"), F.sum("holders").alias("central"))
    chosen = classes.join(by_handle, F.col("d1") == F.col("handle")).select("n", "d1", "d2", "row", "g", "central")
    chosen = cut(chosen)
    sizes = chosen.groupBy("g").agg(
        F.greatest(F.ceil(F.count("*") / GROUP_MEMBERS), F.ceil(F.sum("n") / GROUP_TOKENS)).alias("portions")
    )
    grouped = cut(
        chosen.join(sizes, "g").select(
            "n", "d1", "d2", "row", "central", F.xxhash64("g", F.pmod(F.xxhash64("d1", "d2"), F.col("portions"))).alias("grp")
        )
    )
    keyed = docs.select(*_row_key(docs))
    wanted = grouped.select(
        "grp", "d1", "d2", F.col("row.doc_id").alias("r"), F.col("row.t1").alias("t1"), F.col("row.t2").alias("t2")
    )
    on = F.col("doc_id").eqNullSafe(F.col("r")) & (keyed.t1 == wanted.t1) & (keyed.t2 == wanted.t2)
    held = keyed.join(wanted, on).select("grp", "d1", "d2", "text")
    held = held.groupBy("grp", "d1", "d2").agg(F.first("text").alias("text"))

    def build(members: pa.Table) -> pa.Table:
        values, sizes = shingle_sets(members.column("text").to_pylist(), shingle)
        ids = list(zip(members.column("d1").to_pylist(), members.column("d2").to_pylist()))
        return pa.Table.from_pylist(group_rows(members.column("grp")[0].as_py(), values, sizes, ids, percent), schema=layout)

    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    layout = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _GROUP.split(", ")])
    built = cut(held.groupBy("grp").applyInArrow(build, _GROUP))
    blobs = built.where(F.col("union").isNotNull()).select("grp", "union", "bits", "sizes", "nodes")
    cells = built.select("grp", "node", "d1", "d2", "n", "parity")

    holders = cut(shared.join(cells, F.col("handle") == F.col("d1")).select("sig", "grp", "node").distinct())
    # The group of a signature's most central holder meets the others.
    centres = grouped.groupBy("grp").agg(F.max("central").alias("central"))
    hubs = holders.join(centres, "grp").groupBy("sig").agg(F.max(F.struct("central", "grp")).alias("hub"))
    hubs = hubs.select("sig", F.col("hub.grp").alias("x"))
    star = cut(holders.join(hubs, "sig").where("grp <> x").select("x", F.col("grp").alias("y")).distinct())
    first = cut(_meet(star, blobs, percent))
    reached = smallest_reachable(first).select("node", "component")
    placed = cells.join(reached, "node", "left").select("d1", "grp", "n", "parity", F.coalesce("component", "node").alias("component"))
    placed = shared.join(placed, F.col("handle") == F.col("d1")).select("sig", "grp", "component", "n", "parity")
    # Signatures whose holders are not all connected yet.
    apart = placed.groupBy("sig").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("sig")
    left = _apart_pairs(cut(placed.join(apart, "sig")), percent)
    left = left.join(star.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")), ["x", "y"], "left_anti")
    second = cut(_meet(cut(left), blobs, percent))
    reached = smallest_reachable(first.union(second)).select("node", "component")

    named = F.concat_ws(":", "d1", "d2", "n")
    of_class = cells.join(reached, "node", "left").select(
        "d1", "d2", "n", F.coalesce("component", "node").alias("component")
    )
    joined = classes.select("n", "d1", "d2", "first").join(of_class, ["n", "d1", "d2"], "left")
    joined = joined.withColumn("component", F.coalesce("component", named))
    lowest = joined.groupBy("component").agg(F.min("first").alias("component_id"))
    final = joined.join(lowest, "component").select("n", "d1", "d2", "component_id")
    some = rows.where("n > 0").join(final, ["n", "d1", "d2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    none = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return some.unionByName(none)
