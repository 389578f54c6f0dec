"""Fingerprints, sharding, mixing, packing, link trust, SimHash: against plain loops."""

from __future__ import annotations

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from cases import by_id, docs, labels, long_text, texts
from compare import connect, differences
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pollwright.llm import (
    components,
    fingerprints,
    link_trust,
    mixing,
    packing,
    queries,
    sharding,
    simhash_cover,
    word_bpe,
)
from pollwright.llm.common import table

SF = "/root/testdata/sf0.001"
NOT_NATIVE = ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if re.match("op[256]_", n)])
def test_native_operators_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in NOT_NATIVE if x in plan]


# -- fingerprints


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(values):
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return signed(h)


def plain_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    hashes = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    if not hashes:
        return ""
    shingles = [chained(hashes[i : i + 5]) for i in range(len(hashes) - 4)] or [chained(hashes)]
    bins = [None] * 256
    for s in shingles:
        b = (s >> 56) + 128
        bins[b] = s if bins[b] is None else min(bins[b], s)
    rng = random.Random(5)
    probes = [[rng.randrange(256) for _ in range(256)] for _ in range(8)]
    out = []
    for b in range(256):
        v = next((bins[x] for x in [b, *(p[b] for p in probes)] if bins[x] is not None), None)
        if v is None:
            near = min((signed(xxhash.xxh64_intdigest(struct.pack("<i", c), xxhash.xxh64_intdigest(struct.pack("<i", b), 42))), c) for c in range(256) if bins[c] is not None)
            v = bins[near[1]]
        out.append(f"{v & 15:x}")
    return "".join(out)


def test_fingerprint_is_the_plain_computation(spark):
    got = docs(spark).select("text", fingerprints.fingerprint(F.col("text")).alias("f")).collect()
    for r in got:
        assert r.f == plain_fingerprint(r.text or "")


def test_edited_texts_and_neighbours(spark):
    got = fingerprints.edited_likeness(docs(spark)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in texts())
    hash_of = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted({(i, t or "") for i, t in texts()}, key=lambda x: (x[0] is None, -(x[0] or 0), hash_of(x[1])))
    want = {}
    for k, (i, t) in enumerate(order):
        follower = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + follower[:half]
        want[i, hashlib.sha256(edited.encode()).hexdigest()] = (len(t), plain_fingerprint(t), plain_fingerprint(edited), plain_fingerprint(follower))
    for r in got:
        n, own, other, follower = want[r.doc_id, r.edited_sha256]
        assert (r.n_chars, r.fingerprint, r.edited_fingerprint) == (n, own, other)
        assert (r.near_edited == 1) == (own == other) and (r.near_next == 1) == (own == follower)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert fingerprints.edited_likeness(docs(spark, [])).collect() == []
    alone = fingerprints.edited_likeness(docs(spark, [(4, "abc def")])).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abc abc").hexdigest()


def test_likeness_estimates_the_common_share(spark):
    rng = random.Random(4)
    pairs = []
    for k in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
        cut = 4 + k * 6
        pairs.append((" ".join(words), " ".join(words[:cut] + [f"v{rng.randrange(10**6)}" for _ in range(400 - cut)])))
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    truth = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in pairs]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    near = fingerprints.likeness(fingerprints.fingerprint(F.col("a")), fingerprints.fingerprint(F.col("b")))
    got = [r.x for r in df.select("i", near.alias("x")).orderBy("i").collect()]
    errors = np.abs(np.array(got) - truth)
    assert errors.mean() < 0.04 and errors.max() < 0.15


# -- sharding


@pytest.mark.parametrize("limit, bits", [(400, 16), (400, 2), (3000, 5), (10**9, 16)])
def test_shards_are_those_of_bucket_splitting(spark, limit, bits):
    rows = sharding.hashed(docs(spark)).collect()
    items = [((r.doc_id, r.n_bytes, r.copy), r.hash, r.n_bytes) for r in rows]
    assert len({h for _, h, _ in items}) == len(texts())
    want = {k: (f"{h:060b}", n, 1) for k, h, n in items if n > limit}
    todo = [("", [x for x in items if x[2] <= limit])]
    while todo:
        prefix, members = todo.pop()
        size = sum(n for *_, n in members)
        if size <= limit:
            want |= {k: (prefix, size, len(members)) for k, *_ in members}
        else:
            for bit in "01":
                todo.append((prefix + bit, [x for x in members if f"{x[1]:060b}"[len(prefix)] == bit]))
    got = sharding.extendible_shards(docs(spark), limit, bits).collect()
    assert {(r.doc_id, r.n_bytes, r.copy): (r.shard, r.shard_bytes, r.shard_docs) for r in got} == want
    assert all(r.depth == len(r.shard) for r in got) and len(got) == len(texts())


def test_shard_files_hold_every_row(spark, tmp_path):
    d = docs(spark)
    shards = sharding.extendible_shards(d, 2000)
    sharding.write_shards(d, shards, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter(tuple(r) for r in back.select(*d.columns).collect()) == Counter(tuple(r) for r in d.collect())
    assert sharding.extendible_shards(docs(spark, []), 100).collect() == []


def test_shard_files_of_a_hot_group(spark, tmp_path):
    """Rows equal in id and size, some alike in all columns, others not: each is written once."""
    hot = spark.range(6000).select(
        F.lit(3).cast("bigint").alias("doc_id"), F.lit("same").alias("text"), (F.col("id") % 4000).alias("shard")
    )
    shards = sharding.extendible_shards(hot, 400, 4)
    assert shards.agg(F.max("shard_bytes")).first()[0] <= 400 and shards.count() == 6000
    sharding.write_shards(hot, shards, str(tmp_path / "hot"))
    back = spark.read.parquet(str(tmp_path / "hot"))
    assert Counter(tuple(r) for r in back.select(*hot.columns).collect()) == Counter(tuple(r) for r in hot.collect())


def test_a_hot_group_is_numbered_by_many_tasks(spark):
    n = 20 * sharding.COPIES + 7
    hot = spark.range(n).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    rows = sharding.hashed(hot).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.min("copy").alias("a"), F.max("copy").alias("b"), F.sum("copy").alias("s")).collect()
    assert sum(r.n for r in rows) == n and sum(r.s for r in rows) == n * (n - 1) // 2
    assert min(r.a for r in rows) == 0 and max(r.b for r in rows) == n - 1
    assert max(r.n for r in rows) < n / 2


# -- mixing


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(2)
    p = rng.dirichlet([0.3] * 3, 500)
    t = rng.integers(1, 200, 500)
    members = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p)], "tokens bigint, p array<double>").repartition(5)
    targets = {"clean": 0.7, "low": 0.02, "toxic": 0.28}
    moves, error = mixing.fit_rates(members, targets, mixing.DOMAINS)
    got = members.select("tokens", "p", mixing.rate_of(F.col("p"), moves).alias("r")).collect()
    wanted = np.array(list(targets.values())) * t.sum()
    assert min(r.r for r in got) >= 0 and error < 1e-5
    totals = sum(np.array(r.p) * r.tokens * r.r for r in got)
    assert np.abs(totals - wanted).sum() / t.sum() < 1e-5
    # Rates are those of the last multipliers: equal for equal probabilities.
    assert len({(tuple(r.p), r.r) for r in got}) == len({tuple(r.p) for r in got})


def test_unreachable_targets_end_at_the_least_distance(spark):
    """Two domains that always come in the same proportion: the nearest point of the ray."""
    members = spark.createDataFrame([(10, [0.75, 0.25])] * 4, "tokens bigint, p array<double>")
    moves, error = mixing.fit_rates(members, {"a": 0.5, "b": 0.5}, ("a", "b"))
    got = members.select(mixing.rate_of(F.col("p"), moves).alias("r")).first().r
    assert got == pytest.approx((0.75 * 0.5 + 0.25 * 0.5) / (0.75**2 + 0.25**2), abs=1e-3) and error > 0.1


def test_classifier_and_rates_on_labelled_rows(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.mixing_query(spark, sf)
    truth = mixing.quality_domains(table(spark, sf, "labels"))
    best = F.expr("case when p_clean >= p_low and p_clean >= p_toxic then 'clean' when p_low >= p_toxic then 'low' else 'toxic' end")
    right = got.join(truth, "doc_id").agg(F.avg((best == F.col("domain")).cast("int"))).first()[0]
    assert right > 0.93
    sums = got.agg(*[F.sum(F.col("tokens") * F.col("rate") * F.col(f"p_{d}")).alias(d) for d in mixing.DOMAINS], F.sum("tokens").alias("n")).first()
    for d, share in queries.MIX_TARGETS.items():
        assert sums[d] / sums["n"] == pytest.approx(share, abs=1e-4)


def test_mixing_takes_odd_rows(spark):
    d = docs(spark)
    model = mixing.fit_domains(d, mixing.quality_domains(labels(spark, [(5, 1, 0), (12, 0, 0), (12, 1, None), (13, None, 1), (None, 1, 1)])))
    got = mixing.mixing_rates(d, model, queries.MIX_TARGETS).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in texts())
    assert all(r.rate >= 0 and sum(r.p) == pytest.approx(1) for r in got)
    kept = mixing.thin_to_shares(d, model, {"low": 0.1})
    assert kept.columns == d.columns and kept.count() <= d.count()
    none = docs(spark, [])
    empty = mixing.fit_domains(none, mixing.quality_domains(labels(spark, [])))
    assert mixing.mixing_rates(none, empty, queries.MIX_TARGETS).collect() == []
    assert mixing.thin_to_shares(none, empty, {"low": 0.1}).collect() == []


def plain_membership(text, model):
    """Words, buckets and softmax in plain Python and numpy."""
    words = [w for w in re.split(r"[\x20\x09-\x0D.,;:'\"()]+", (text or "").lower()) if w]
    n = len(model.weights[0])
    hashed = [np.uint64(xxhash.xxh64_intdigest(w.encode(), 42)).view(np.int64) for w in words]
    buckets = list(dict.fromkeys(int(h) % (n - 1) + 1 for h in hashed))
    if 2 * len(buckets) < len(words):
        buckets.append(0)
    z = np.array([b + sum(w[k] for k in buckets) for b, w in zip(model.bias, model.weights)])
    e = np.exp(z - z.max())
    return len(words), e / e.sum()


def test_membership_is_the_plain_softmax(spark):
    rng = np.random.default_rng(4)
    weights = [np.zeros(50), *rng.standard_normal((2, 50))]
    model = mixing.DomainModel(mixing.DOMAINS, (0.0, 0.3, -0.2), tuple(tuple(map(float, w)) for w in weights))
    rows = [(i, t) for i, (_, t) in enumerate(texts()) if t is None or "İ" not in t]
    got = docs(spark, rows).select("doc_id", mixing.membership(F.col("text"), model).alias("m")).collect()
    found = {r.doc_id: r.m for r in got}
    for i, t in rows:
        n, p = plain_membership(t, model)
        assert found[i].tokens == n and found[i].p == pytest.approx(p.tolist(), abs=1e-9)


def test_drawn_tokens_meet_the_targets(spark):
    sf = "/root/testdata/sf0.1"  # enough toxic documents for the draw's chance to even out
    d = table(spark, sf, "documents")
    domains = mixing.quality_domains(table(spark, sf, "labels")).cache()
    model = mixing.fit_domains(d, domains)
    share = lambda df: df.select(mixing.membership(F.col("text"), model).alias("m")).agg(
        *[F.sum(F.col("m.tokens") * F.get("m.p", F.lit(k))) / F.sum("m.tokens") for k in range(3)]
    ).first()
    for most in ({"low": 0.02, "toxic": 0.01}, {"low": 0.001, "toxic": 0.001}):
        before, kept = share(d), mixing.thin_to_shares(d, model, most)
        after = share(kept)
        for k, name in ((1, "low"), (2, "toxic")):
            want = min(most[name], before[k])
            assert after[k] == pytest.approx(want, rel=0.35, abs=0.002)
        found = {r.domain: (r["all"], r.stay) for r in domains.join(d, "doc_id").join(
            kept.select("doc_id", F.lit(1).alias("k")).distinct(), "doc_id", "left"
        ).groupBy("domain").agg(F.count("*").alias("all"), F.count("k").alias("stay")).collect()}
        assert found["clean"][1] >= 0.97 * found["clean"][0]
        assert found["toxic"][1] < 0.5 * found["toxic"][0]


# -- packing


def check_pieces(rows, want_ids, capacity):
    """Every id in one piece, windows gapless and within the capacity."""
    assert Counter((r.doc_id, r.doc_tokens) for r in rows if r.start == 0) == Counter((i, len(x)) for i, x in want_ids)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows)
    covered = defaultdict(int)
    for (i, start, length, c, n), k in pieces.items():
        fits = [x for j, x in want_ids if j == i and len(x) == n and crc(x[start : start + length]) == c]
        assert fits
        covered[i] += length * k
    total = defaultdict(int)
    for i, x in want_ids:
        total[i] += len(x)
    assert covered == total
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for parts in windows.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    return sum(total.values()) / (len(windows) * capacity)


def ids_of(rows):
    t = Tokenizer.from_file(word_bpe.DEFAULT_PATH)
    return [(i, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x in rows]


@pytest.mark.parametrize("capacity, windows, chunk", [(4096, 256, 512), (64, 8, 16), (100, 1, 100)])
def test_packing_keeps_every_id(spark, capacity, windows, chunk):
    got = packing.pack_documents(docs(spark), capacity, 2, windows, chunk).collect()
    check_pieces(got, ids_of(texts()), capacity)
    assert packing.pack_documents(docs(spark, [])).collect() == []


def test_packing_wastes_little(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    assert check_pieces(queries.packing_query(spark, sf).collect(), ids_of(rows), 4096) > 0.97


def test_differencing_balances():
    rng = random.Random(1)
    for n, ways in [(1, 3), (7, 7), (40, 6), (500, 40)]:
        sizes = [rng.randrange(1, 512) for _ in range(n)]
        parts = packing.differencing(sizes, ways)
        assert sorted(i for p in parts for i in p) == list(range(n))
        if n >= 40:
            sums = [sum(sizes[i] for i in p) for p in parts]
            assert max(sums) - min(sums) < 60


# -- link trust

RULES = queries.URL_RULES


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    best = None
    for verdict, rule in RULES:
        domain, _, start = rule.partition("/")
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            best = max(best or (0, "", ""), (len(rule), rule, verdict))
    return host, path, best and best[1], best and best[2]


URLS = [
    None, "", "no scheme/x", "http://", "https://COM/", "http://com", "http://a.com?x=/en/", "http://www.Example.com/en/1#a",
    "http://example.com/en/", "http://x.example.com/en", "ftp://b.net/es/1", "http://net/fr/x?q", "http://notcom.org/en/",
    "http://a.net/de/://b.com/", "http://É.org/en/", "http://xcom/", "http://u:p@h.com:80/es/", "http://a.net/fr/2", "http://a.net/fr/2",
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(URLS)], "page_id bigint, url string, html string, host string")
    got = {r.page_id: r for r in link_trust.judge_urls(pages, RULES).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain_verdict(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        if verdict:
            assert got[i].verdict == verdict
    assert link_trust.judge_urls(pages.where("page_id < 0"), RULES).collect() == []


def plain_rank(seeds, edges, damping=0.85, steps=200):
    total, rank = sum(seeds.values()), dict(seeds)
    for _ in range(steps):
        new = dict.fromkeys(seeds, 0.0)
        lost = 0.0
        for h, r in rank.items():
            out = {b: n for (a, b), n in edges.items() if a == h}
            if not out:
                lost += r
            for b, n in out.items():
                new[b] += damping * r * n / sum(out.values())
        rank = {h: new[h] + seeds[h] * (1 - damping + damping * lost / total) for h in seeds}
    return rank


def test_trust_follows_links_and_distrust_goes_back(spark):
    link = lambda *to: "".join(f'<a class="x" href="{u}">t</a>' for u in to)
    pages = [
        (1, "http://good.com/", link("http://kind.org/a", "//kind.org/b", "/own")),
        (2, "http://kind.org/", link("http://far.org/")),
        (3, "http://far.org/", None),
        (4, "http://farm.org/", link("http://bad.net/es/1", "http://bad.net/es/2", "relative")),
        (5, "http://bad.net/es/1", link("http://good.com/")),
        (6, "http://bad.net/es/2", ""),
        (7, "http://bad.net/en/", ""),
        (8, "http://lone.org/", link("mailto:x", "javascript:y")),
    ]
    df = spark.createDataFrame([(i, u, h) for i, u, h in pages], "page_id bigint, url string, html string")
    split = df.select(link_trust.host_of(F.col("url")).alias("host"), "html")
    edges = {(r.src, r.dst): r.n for r in link_trust.host_links(split).collect()}
    assert edges == {("good.com", "kind.org"): 2, ("kind.org", "far.org"): 1, ("farm.org", "bad.net"): 2, ("bad.net", "good.com"): 1}
    hosts = ["good.com", "kind.org", "far.org", "farm.org", "bad.net", "lone.org"]
    seeds = {h: 2.0 if h == "bad.net" else 1.0 if h == "good.com" else 0.0 for h in hosts}
    table_ = spark.createDataFrame(list(seeds.items()), "host string, seed double")
    links = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n bigint")
    got = {r.host: r["rank"] for r in link_trust.personalised_rank(table_, "seed", links, steps=100, tolerance=1e-9).collect()}
    for h, r in plain_rank(seeds, edges).items():
        assert got[h] == pytest.approx(r, abs=1e-5)
    verdicts = {r.page_id: (r.rule, r.verdict) for r in link_trust.judge_urls(df, RULES).collect()}
    assert verdicts == {
        1: ("com/", "allow"), 2: (None, "allow"), 3: (None, "allow"), 4: (None, "block"), 5: ("net/es/", "block"),
        6: ("net/es/", "block"), 7: (None, "block"), 8: (None, "allow"),
    }
    # Two of three pages of bad.net are blocked, whoever links to it; farm.org gets its distrust.
    trust = plain_rank({h: float(h == "good.com") for h in hosts}, edges)
    distrust = plain_rank({h: 2.0 * (h == "bad.net") for h in hosts}, {(b, a): n for (a, b), n in edges.items()})
    assert {h for h in hosts if h != "bad.net" and distrust[h] > trust[h]} == {"farm.org"}


def test_a_linked_host_is_judged_by_its_own_pages(spark):
    """Links from elsewhere neither clear a host that is mostly blocked nor block one that isn't."""
    pages = [("http://bad.net/es/1", ""), ("http://bad.net/es/2", ""), ("http://bad.net/en/", "")]
    pages += [("http://mixed.net/es/1", ""), *[(f"http://mixed.net/en/{i}", "") for i in range(9)]]
    for more in ([], [("http://farm.org/", '<a href="http://bad.net/es/1">x</a><a href="http://mixed.net/es/1">x</a>')]):
        df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages + more)], "page_id bigint, url string, html string")
        got = {(r.host, r.rule, r.verdict) for r in link_trust.judge_urls(df, RULES).collect()}
        assert {("bad.net", None, "block"), ("mixed.net", None, "allow")} <= got


def test_ranks_on_a_larger_graph(spark):
    """Hot in- and out-degrees, hosts without links, cycles and weights, against the plain loop."""
    rng = random.Random(2)
    hosts = [f"h{i}" for i in range(400)]
    edges = Counter()
    for h in hosts[:300]:
        for _ in range(rng.randint(0, 4)):
            edges[h, rng.choice(hosts)] += rng.randint(1, 5)
        edges[h, "h0"] += 1
    for h in hosts[1:]:
        edges["h1", h] += 1
    edges = {(a, b): n for (a, b), n in edges.items() if a != b}
    seeds = {h: float(rng.choice([0, 0, 0, 3])) for h in hosts}
    table_ = spark.createDataFrame(list(seeds.items()), "host string, seed double")
    links = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n bigint")
    got = {r.host: r["rank"] for r in link_trust.personalised_rank(table_, "seed", links, tolerance=0.05).collect()}
    want = plain_rank(seeds, edges, steps=100)
    # The last step moved less than the tolerance; what would follow is at most 0.85 / 0.15 of that.
    assert sum(abs(got[h] - want[h]) for h in hosts) <= 0.05 * 6 * sum(seeds.values())
    assert sum(got.values()) == pytest.approx(sum(seeds.values()))


def test_farms_of_any_size_are_blocked(spark):
    """Pages that link to a bad host block their host, however many it has; trust still counts."""
    link = lambda *to: "".join(f'<a href="{u}">t</a>' for u in to)
    bad = "http://bad.net/es/1"
    pages = [(bad, ""), ("http://good.com/", link("http://kind.org/")), ("http://kind.org/", link(bad)), ("http://lone.org/", "")]
    pages += [(f"http://farm{size}.org/{k}", link(*[bad] * 9)) for size in (1, 2, 40) for k in range(size)]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id bigint, url string, html string")
    got = {(r.host, r.verdict) for r in link_trust.judge_urls(df, RULES).collect()}
    good = {(h, "allow") for h in ("good.com", "kind.org", "lone.org")}
    assert got == good | {("bad.net", "block"), *[(f"farm{size}.org", "block") for size in (1, 2, 40)]}


# -- SimHash


def plain_simhash(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, radius=2):
    parent = list(range(len(values)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius:
                parent[top(i)] = top(j)
    return [top(i) for i in range(len(values))]


def test_near_duplicates(spark):
    got = simhash_cover.near_duplicates(docs(spark)).collect()
    rows = texts()
    prints = [plain_simhash(t or "") for _, t in rows]
    tops = plain_components(prints)
    first = {c: min((i for (i, _), x in zip(rows, tops) if x == c and i is not None), default=None) for c in set(tops)}
    want = [(i, f"{p:016x}", first[c]) for (i, _), p, c in zip(rows, prints, tops)]
    assert by_id(map(tuple, got)) == by_id(want)
    assert simhash_cover.near_duplicates(docs(spark, [])).collect() == []


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_masks_cover_every_pair(radius):
    masks = simhash_cover.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for _ in range(3000):
        off = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(m & off == 0 for m in masks)


@pytest.mark.parametrize("radius, pair_up_to", [(2, 32), (2, 2), (1, 1), (1, 32), (0, 32)])
def test_links_connect_exactly_the_near(spark, radius, pair_up_to):
    rng = random.Random(9)
    values = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        values |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(25)}
    chain = rng.getrandbits(64)
    for b in range(40):
        chain ^= 1 << b
        values.add(chain)
    values = sorted(values)
    classes = spark.createDataFrame([(signed(v),) for v in values], "fp bigint")
    links = simhash_cover.links(classes, radius, pair_up_to)
    assert all(((r.a ^ r.b) & (2**64 - 1)).bit_count() <= radius for r in links.collect())
    found = {r.node: r.component for r in components.smallest_reachable(links).collect()}
    tops = plain_components(values, radius)
    smallest = {c: min(signed(v) for v, x in zip(values, tops) if x == c) for c in set(tops)}
    assert {signed(v): found.get(signed(v), signed(v)) for v in values} == {signed(v): smallest[c] for v, c in zip(values, tops)}


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + k) for k in range(1, 50)] + [(5, 5), (2001, 2000), (2000, 2001)]
    got = {r.node: r.component for r in components.smallest_reachable(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1050), 1000), 2000: 2000, 2001: 2000}


def test_keep_one_of_each_group(spark):
    d = docs(spark)
    got = simhash_cover.keep_one(d)
    assert got.columns == d.columns
    rows = texts()
    tops = plain_components([plain_simhash(t or "") for _, t in rows])
    want = Counter(min((i for (i, _), x in zip(rows, tops) if x == c and i is not None), default=None) for c in set(tops))
    assert Counter(r.doc_id for r in got.collect()) == want
    assert simhash_cover.keep_one(docs(spark, [])).collect() == []


def test_keep_one_takes_every_group_of_a_repeated_id(spark):
    """Ids that lead several groups, rows of one id in several groups, a hot id, null ids."""
    a, b = "alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight nine"
    rows = [(1, a), (2, a), (2, b), (3, b), (7, long_text(1)), (7, long_text(2)), (None, long_text(3)), (None, long_text(4))]
    rows += [(9, long_text(20 + i, 80)) for i in range(40)] + [(9, long_text(20, 80).upper()), (2, b), (8, None), (8, "")]
    rows += texts()
    tops = plain_components([plain_simhash(t or "") for _, t in rows])
    # Spark's hash of null is its seed.
    order = lambda i, t: (i is None, i or 0, 42 if t is None else signed(xxhash.xxh64_intdigest(t.encode(), 42)))
    want = Counter(min((x for x, y in zip(rows, tops) if y == c), key=lambda x: order(*x)) for c in set(tops))
    assert want[2, b] == 1 and len([i for i, _ in want if i == 9]) > 30
    for parts in (1, 7):
        got = simhash_cover.keep_one(docs(spark, rows).repartition(parts)).collect()
        assert Counter((r.doc_id, r.text) for r in got) == want


def test_keep_one_of_equal_texts_is_fixed(spark):
    rows = [(4, "equal id and text", x) for x in "cab"]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    for parts in (1, 3):
        assert [r.source for r in simhash_cover.keep_one(df.repartition(parts)).collect()] == ["a"]


def test_a_repeated_labelled_id_gives_one_training_row(spark):
    """10,000 rows with the id of one label: the driver gets one of them."""
    from pollwright.llm import quality_lines

    rows = [(5, f"text number {i} of the same id") for i in range(10_000)] + [(6, "another text"), (None, "no id")]
    d = docs(spark, rows)
    found = quality_lines.labelled_sample(d, labels(spark, [(5, 1, 0), (5, 0, 1), (6, 0, 0), (None, 1, 0)]), "quality", 100).collect()
    assert sorted((r.doc_id, r.label) for r in found) == [(5, 0), (6, 0)]
    again = quality_lines.labelled_sample(d.repartition(7), labels(spark, [(5, 1, 0), (5, 0, 1), (6, 0, 0)]), "quality", 100).collect()
    assert {(r.doc_id, r.text) for r in found} == {(r.doc_id, r.text) for r in again}
    model = mixing.fit_domains(d, mixing.quality_domains(labels(spark, [(5, 1, 0), (6, 1, 0)])))
    assert model.bias[0] >= max(model.bias)
