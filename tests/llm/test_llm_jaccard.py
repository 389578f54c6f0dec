"""The Jaccard join against all pairs of plain sets."""

from __future__ import annotations

import random

import numpy as np
import pytest
from cases import by_id, docs, texts
from compare import connect, differences

from pollwright.llm import jaccard_groups, queries


def plain_sets(rows, shingle):
    out = []
    for doc_id, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        words = [w for w in low.split(" ") if w]
        if len(words) < shingle:
            out.append((doc_id, {tuple(words)} if words else set()))
        else:
            out.append((doc_id, {tuple(words[i : i + shingle]) for i in range(len(words) - shingle + 1)}))
    return out


def plain_join(rows, shingle, percent):
    sets = plain_sets(rows, shingle)
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                up[top(i)] = top(j)
    out = []
    for i, (doc_id, a) in enumerate(sets):
        ids = [d for j, (d, b) in enumerate(sets) if b and top(j) == top(i) and d is not None] if a else [doc_id]
        out.append((doc_id, len(a), min(ids, default=None)))
    return by_id(out)


def near_copies(seed):
    """Chains of edits around every size, where many pairs lie close to the threshold."""
    rng = random.Random(seed)
    rows = []
    for family in range(25):
        words = [f"f{family}w{rng.randint(0, 400)}" for _ in range(rng.choice([3, 8, 11, 12, 13, 20, 40, 90, 300]))]
        for _ in range(rng.randint(2, 12)):
            edited = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 50))):
                at = rng.randrange(len(edited))
                edited[at : at + rng.choice([0, 1])] = [f"e{rng.randint(0, 9)}"]
            if rng.random() < 0.4:
                edited = edited[: max(1, len(edited) - rng.randint(0, len(words) // 9))]
            rows.append((len(rows), " ".join(edited)))
            if rng.random() < 0.5:
                words = edited
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("percent", "members"), [(90, 64), (80, 2)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, percent, members):
    # Groups of few members, so that links cross groups, and few partners at a time.
    monkeypatch.setattr(jaccard_groups, "GROUP_MEMBERS", members)
    monkeypatch.setattr(jaccard_groups, "PARTNERS", 3)
    monkeypatch.setattr(jaccard_groups, "BUCKET", 64 * members - 126)
    rows = near_copies(percent) + [(1000 + (i or 0), t) for i, t in texts()] + [(None, "a b c d e f"), (None, "a b c d e f")]
    got = jaccard_groups.similar_sets(docs(spark, rows), percent=percent).collect()
    assert by_id(got) == plain_join(rows, 3, percent)


def test_no_documents(spark):
    assert jaccard_groups.similar_sets(docs(spark, [])).collect() == []


@pytest.mark.parametrize("percent", [60, 80, 90, 97])
def test_linked_sets_share_a_signature(percent):
    rng = np.random.default_rng(percent)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        # As different as a link allows, by any mix of missing and other tokens.
        differ = 2 * len(a) * (100 - percent) // (100 + percent)
        lost = int(rng.integers(0, differ + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[lost:], rng.integers(0, 2**63, differ - lost, dtype=np.uint64)]))
        inter = len(np.intersect1d(a, b))
        if 100 * inter < percent * (len(a) + len(b) - inter) or np.array_equal(a, b) or not len(b):
            continue
        owner, sig = jaccard_groups.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), percent)
        assert np.intersect1d(sig[owner == 0], sig[owner == 1]).size


def test_parity_bits_never_differ_in_more_than_tokens():
    rng = np.random.default_rng(4)
    for n in (1, 30, 300, 3000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 2**63, n // 7, dtype=np.uint64)]))
        x, y = jaccard_groups.parities(np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))
        assert (jaccard_groups.parities(a, np.array([len(a)])) == x).all()


def test_texts_that_share_a_passage_are_not_paired(spark, monkeypatch):
    """400 texts with the same 60 words in the middle have many signatures in common and no link."""
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([*[f"a{i}x{k}" for k in range(6)], *passage, *[f"b{i}x{k}" for k in range(7)]])) for i in range(400)]
    pairs = []
    plain = jaccard_groups._apart_pairs

    def counted(*args):
        found = plain(*args)
        pairs.append(found.count())
        return found

    monkeypatch.setattr(jaccard_groups, "_apart_pairs", counted)
    got = jaccard_groups.similar_sets(docs(spark, rows)).collect()
    assert len({r.component_id for r in got}) == 400 and sum(pairs) < 400


def test_a_hot_family_needs_few_comparisons(spark, monkeypatch):
    """1,500 near copies of one text: groups meet a hub, not each other."""
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join([*base[:i % 100], f"x{i}", *base[i % 100 + 1 :]])) for i in range(1500)]
    met = []
    plain = jaccard_groups._meet

    def counted(pairs, blobs, percent):
        met.append(pairs.count())
        return plain(pairs, blobs, percent)

    monkeypatch.setattr(jaccard_groups, "_meet", counted)
    got = jaccard_groups.similar_sets(docs(spark, rows)).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 1500
    # About 24 groups or more; all pairs of texts would be over a million.
    assert sum(met) < 1500


def test_query_matches_sql(spark):
    name, sf = "op12_jaccard_join", "/root/testdata/sf0.01"
    assert differences(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name]) is None
