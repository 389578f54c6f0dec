"""The conversation trie against a plain dictionary of prefixes."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from compare import connect, differences
from pyspark.sql import functions as F

from pollwright.llm import queries, turn_trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, size string, seg string, t string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3)


def plain_trie(convs: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    members: dict[tuple, list[int]] = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids: dict[tuple, list[tuple]] = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = kids.get(path, [])
        leaves[path] = sum(leaves[k] for k in below) or 1
        own = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        saved[path] = own + sum(saved[k] for k in below)
    out = []
    for path, ms in members.items():
        ends = ",".join(map(str, sorted(m for m in ms if len(convs[m]) == len(path))))
        up = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(ms), len(path), up, len(ms), len(kids.get(path, [])), leaves[path], saved[path], digest))
    return sorted(out, key=str)


def plain_rebuilt(rows) -> dict[int, list[tuple[str, str]]]:
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(ts, key=lambda x: x[:2])] for c, ts in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def conversations(seed: int, n: int, longest: int) -> list[tuple]:
    rng = random.Random(seed)
    said = ["hello", "", "Ünï 😀", "yes\n", "no"]
    rows = []
    for c in rng.sample(range(0, 450), n):
        for turn in rng.sample([None, *range(20 * longest)], rng.randint(1, longest)):
            rows.append((c, turn, rng.choice(["user", "assistant", None]), rng.choice([*said, None])))
    return rows


@pytest.mark.parametrize(("width", "shard_rows"), [(64, 4096), (2, 7), (1, 1000), (3, 1)])
def test_trie_is_the_plain_one(spark, width, shard_rows):
    rows = conversations(width, 60, 9)
    # Copies of one conversation in several shards, a long one, one that another continues,
    # rows without a conversation.
    rows += [(2000 + c, t, "user", f"copy {t}") for c in range(25) for t in range(4)]
    rows += [(c, t, "system", f"long {t % 7}") for c in (700, 701, 702) for t in range(40 if c < 702 else 23)]
    rows += [(None, 1, "user", "lost"), (None, None, None, None)]
    turns = turn_trie.ordered_turns(table(spark, rows))
    shared = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(6))
    convs, rebuilt = turn_trie.rebuilt(turns, shared, F.col("conv_id") - F.col("conv_id") % 100, 5)
    got = sorted((tuple(r) for r in turn_trie.prefix_trie(convs, rebuilt, width, shard_rows).collect()), key=str)
    want = plain_rebuilt(rows)
    assert min(map(len, want.values())) == 0  # some are turnless
    assert got == plain_trie(want)


def test_trie_of_repeated_rows_and_of_nothing(spark):
    # Equal rows are turns of their own; equal turn numbers keep a fixed order.
    rows = [(1, 5, "user", "a"), (1, 5, "user", "a"), (2, 5, "user", "a"), (2, 6, "user", "a")]
    convs, rebuilt = turn_trie.rebuilt(turn_trie.ordered_turns(table(spark, rows)), F.lit(0), F.col("conv_id"), 5)
    got = sorted((tuple(r) for r in turn_trie.prefix_trie(convs, rebuilt).collect()), key=str)
    assert got == plain_trie({1: [("user", "a")] * 2, 2: [("user", "a")] * 2})
    convs, rebuilt = turn_trie.rebuilt(turn_trie.ordered_turns(table(spark, [])), F.lit(0), F.col("conv_id"), 5)
    assert turn_trie.prefix_trie(convs, rebuilt).collect() == []


def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.01"
    name = "op13_conversation_trie"
    assert differences(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name]) is None
