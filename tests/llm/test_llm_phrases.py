"""Phrase counts in quotient filters against plain counters."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import SCHEMA, docs, texts
from compare import connect, differences

from pollwright.llm import phrase_filters, queries
from pollwright.llm.phrase_filters import Permutation, merge_filters, pack_filter, unpack_filter


def plain_collocations(rows, least, top):
    grams: dict[str, Counter] = {}
    total: Counter = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            found = grams.setdefault(lang, Counter())
            for k in range(1, 6):
                found.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in grams.items():
        often = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        best = []
        for g, a in often.items():
            inside = any(len(o) > len(g) and 100 * b >= 100 * a and any(o[i : i + len(g)] == g for i in range(len(o))) for o, b in often.items())
            if not inside:
                score, _, l, r = min(
                    (1000 * a * total[lang] // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g))
                )
                best.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def invented(seed):
    rng = random.Random(seed)
    stock = ["new york city", "of the", "in the name of the", "É à", "a", "b", "New", "the", "x\x1cy", "don't", "😀 😀"]
    ends = [" ", " ", " ", ", ", ".", "\n", "\t", "  ", "!", "\r\n", ":"]
    rows = []
    for _ in range(200):
        text = "".join(rng.choice(stock) + rng.choice(ends) for _ in range(rng.randint(0, 40)))
        rows.append((rng.choice(["en", "en", "de", None, "und"]), text))
    return rows


@pytest.mark.parametrize(("block", "shard", "top"), [(1 << 20, 1 << 21, 2000), (150, 40, 25)])
def test_collocations_are_those_of_plain_counts(spark, monkeypatch, block, shard, top):
    monkeypatch.setattr(phrase_filters, "BLOCK_TOKENS", block)
    monkeypatch.setattr(phrase_filters, "ROW_TOKENS", 64)
    monkeypatch.setattr(phrase_filters, "SHARD_GRAMS", shard)
    rows = invented(block) + [("en", t) for _, t in texts()] + [(None, None), ("fr", ""), ("fr", " , ")]
    data = [(i % 7, t, lang, "s", 0, *["clash"] * 9) for i, (lang, t) in enumerate(rows)]
    got = phrase_filters.collocations(spark.createDataFrame(data, SCHEMA).repartition(4), least=4, top=top)
    assert sorted(tuple(r) for r in got.collect()) == plain_collocations(rows, 4, top)


def test_nothing_frequent_and_nothing_at_all(spark):
    assert phrase_filters.collocations(docs(spark), least=10**6).collect() == []
    assert phrase_filters.collocations(docs(spark, [])).collect() == []


def test_words_of_blocks_are_numbered_without_a_join(spark, monkeypatch):
    frame = type(spark.range(1))
    plain, joined = frame.join, []
    monkeypatch.setattr(frame, "join", lambda self, other, *a, **k: joined.extend([self.columns, other.columns]) or plain(self, other, *a, **k))
    found, _ = phrase_filters.frequent_phrases(docs(spark, [(i, "a b a b. c a b") for i in range(3)]), least=3)
    assert joined and not any("local" in columns for columns in joined)
    assert sorted((r["phrase"], r["a"]) for r in found.where("k < 3").collect()) == [("a", 9), ("a b", 9), ("b", 9), ("b a", 3), ("c", 3), ("c a", 3)]


@pytest.mark.parametrize("bits", [1, 2, 3, 7, 16, 17, 40, 63, 64])
def test_permutation_is_undone(bits):
    rng = np.random.default_rng(bits)
    some = np.arange(1 << bits, dtype=np.uint64) if bits <= 16 else rng.integers(0, 1 << bits, 5000, dtype=np.uint64, endpoint=False) if bits < 64 else rng.integers(0, 2**64 - 1, 5000, dtype=np.uint64)
    p = Permutation(bits)
    mixed = p(some)
    assert int(mixed.max()) < 1 << bits
    assert (p.back(mixed) == some).all()
    assert len(np.unique(mixed)) == len(np.unique(some))
    if bits == 64:
        return
    with pytest.raises(ValueError):
        Permutation(65)


@pytest.mark.parametrize("bits", [1, 5, 8, 31, 64])
@pytest.mark.parametrize("n", [0, 1, 2, 300, 5000])
def test_filter_loses_nothing(bits, n):
    rng = np.random.default_rng(n + bits)
    high = (1 << bits) - 1
    values = np.unique(rng.integers(0, high, n, dtype=np.uint64, endpoint=True))
    if n > 2:
        values = np.unique(np.append(values, [np.uint64(0), np.uint64(high)]))
    counts = rng.choice([1, 2, 254, 255, 256, 10**12], len(values))
    data = pack_filter(values, counts, bits)
    back = unpack_filter(data)
    assert (back[0] == values).all() and (back[1] == counts).all()


def test_merged_filters_add_up():
    rng = np.random.default_rng(0)
    parts, want = [], Counter()
    for _ in range(5):
        values, counts = np.unique(rng.integers(0, 700, 900, dtype=np.uint64), return_counts=True)
        want.update(dict(zip(values.tolist(), counts.tolist())))
        parts.append(pack_filter(values, counts, 10))
    values, counts, place, source = merge_filters(parts)
    assert dict(zip(values.tolist(), counts.tolist())) == want and (np.diff(values.astype(np.int64)) > 0).all()
    for i, part in enumerate(parts):
        assert (values[place[source == i]] == unpack_filter(part)[0]).all()


def test_a_filter_is_compact():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 34, 100_000, dtype=np.uint64))
    size = len(pack_filter(values, np.ones(len(values), np.int64), 34))
    assert size < 5 * len(values)  # a plain counter takes 16 bytes


def test_query_matches_sql(spark):
    name, sf = "op11_collocations", "/root/testdata/sf0.01"
    assert differences(queries.QUERIES[name](spark, sf), connect(sf), queries.ORACLES[name]) is None
