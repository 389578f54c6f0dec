"""Quality rules, token counts, line dedup, byte network: against plain loops."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from cases import by_id, docs, labels, texts
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pollwright.llm import byte_cnn, line_runs, quality_lines, queries, token_counts, word_bpe
from pollwright.llm.common import table

SF = "/root/testdata/sf0.01"
BLANK = r"[\x20\x09-\x0D]"


def base_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    n = len(words)
    failed = n < 50 or 100 * len(inside) > 50 * n
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_base_statistics(spark):
    got = quality_lines.quality_rules(docs(spark), quality_lines.UNTRAINED).collect()
    want = [(i, *base_stats(t or "")) for i, t in texts()]
    assert by_id(tuple(r)[:7] for r in got) == by_id(want)
    assert not [r for r in got if r.base_failed and r.kept]


def test_viterbi_is_the_best_labelling():
    rng = np.random.default_rng(3)
    for n in range(1, 8):
        x = rng.standard_normal((n, quality_lines.N_FEATURES))
        model = quality_lines.LineModel(
            tuple(rng.standard_normal(quality_lines.N_FEATURES).tolist()), tuple(map(tuple, rng.standard_normal((2, 2)).tolist()))
        )

        def score(path):
            s = sum(float(x[i] @ np.array(model.emission)) for i, y in enumerate(path) if y)
            return s + sum(model.transition[a][b] for a, b in zip(path, path[1:]))

        best = max(itertools.product((0, 1), repeat=n), key=score)
        assert [int(v) for v in quality_lines.viterbi(x, model)] == list(best)


def test_training_raises_the_likelihood_of_the_labels():
    rng = np.random.default_rng(1)
    data = [(rng.standard_normal((5, quality_lines.N_FEATURES)) + (2 * y - 1), y) for y in (0, 1) for _ in range(40)]
    model = quality_lines.train(data, 8, 100)
    right = sum(np.mean(quality_lines.viterbi(x, model)) == y for x, y in data)
    assert right >= 75


def test_clean_documents_stay_and_junk_goes(spark):
    judged = queries.quality_rules(spark, SF).join(table(spark, SF, "labels"), "doc_id").where("not base_failed")
    rates = {r.quality: r.rate for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rates[1] >= 0.99 and rates[0] <= 0.05


def test_halves_are_told_apart(spark):
    """A good document followed or preceded by a bad one: the share of content words is near the
    good half's, and a document of one kind keeps its single label."""
    docs_, labels_ = table(spark, SF, "documents"), table(spark, SF, "labels")
    model = quality_lines.fit_line_model(docs_, labels_, rows=200)
    assert all(x != 0 for row in model.transition for x in row)
    seen = {r.doc_id for r in quality_lines.labelled_sample(docs_, labels_, "quality", 200).select("doc_id").collect()}
    rows = docs_.join(labels_, "doc_id").where("text is not null and quality is not null").select("doc_id", "text", "quality").collect()
    rows = sorted((r.quality, r.doc_id, r.text) for r in rows if r.doc_id not in seen and r.text.count("\n") >= 3)
    good, bad = ([t for q, _, t in rows if q == y] for y in (1, 0))
    errors = []
    for i, g in enumerate(good[:150]):
        b = bad[i % len(bad)]
        share = quality_lines.judge(f"{g}\n{b}" if i % 2 else f"{b}\n{g}", model, 0.5)[8]
        errors.append(abs(share - len(g.split()) / len(g.split() + b.split())))
    assert len(errors) > 50 and np.median(errors) < 0.15 and np.mean(errors) < 0.15


def test_keep_quality_keeps_columns_and_only_judged_rows(spark):
    d = docs(spark)
    kept = quality_lines.keep_quality(d, quality_lines.UNTRAINED)
    assert kept.columns == d.columns
    want = [i for i, t in texts() if quality_lines.judge(t or "", quality_lines.UNTRAINED, 0.5)[6]]
    assert Counter(r.doc_id for r in kept.collect()) == Counter(want)
    none = labels(spark, [])
    assert quality_lines.fit_line_model(d, none) == quality_lines.UNTRAINED
    assert quality_lines.quality_rules(docs(spark, []), quality_lines.UNTRAINED).collect() == []


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(word_bpe.DEFAULT_PATH)
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_every_prefix_count_is_the_librarys(spark, library):
    got = token_counts.prefix_token_counts(docs(spark)).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter(
        (i, len((t or "").encode()), len(library(t or ""))) for i, t in texts()
    )
    counts = token_counts.PrefixCounts()
    for _, text in texts():
        text = (text or "")[:300]
        if len(library(text)) and text.isascii() or len(text) < 60 and "é" not in text:
            steps = np.cumsum(np.frombuffer(counts.steps([text])[0], np.int8), dtype=int).tolist()
            assert steps == [len(library(text[: i + 1])) for i in range(len(text))]


def test_truncation_and_budget(spark, library):
    text = "An unusually worded sentence, isn't it? Yes: it is."
    d = docs(spark, [(1, text), (2, None)])
    steps = token_counts.prefix_token_counts(d)
    r = {x.doc_id: x for x in steps.select(
        "doc_id",
        token_counts.tokens_at(F.col("steps"), F.lit(9)).alias("at"),
        token_counts.longest_prefix(F.col("steps"), F.lit(6)).alias("fits"),
    ).collect()}
    assert r[1].at == len(library(text[:9])) and r[2].at == 0 and r[2].fits == 0
    assert r[1].fits == max(i for i in range(len(text) + 1) if len(library(text[:i])) <= 6)


def test_cached_ids_are_the_librarys(library):
    ids = word_bpe.ChunkIds(limit=5)
    many = [t or "" for _, t in texts()]
    for _ in range(3):
        assert [np.frombuffer(b, "<u4").tolist() for b in ids.encode(pa.array(many))] == [library(t) for t in many]


def line_rows(rows, least):
    strip = lambda s: re.sub(f"^{BLANK}+|{BLANK}+$", "", s)
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keys = [[strip(x).translate(low) for x in (t or "").split("\n")] for _, t in rows]
    found = Counter(k for ks in keys for k in set(ks) if k)
    out = []
    for (i, t), ks in zip(rows, keys):
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, ks) if found[k] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("least, batches", [(10, 4), (2, 7), (12, 1)])
def test_line_dedup(spark, least, batches):
    got = line_runs.dedup_lines(docs(spark), least, batches).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert by_id(map(tuple, got)) == by_id(line_rows(texts(), least))


def test_line_dedup_of_rows_keeps_columns(spark):
    d = docs(spark)
    got = line_runs.drop_frequent_lines(d)
    assert got.columns == d.columns and dict(got.dtypes) == dict(d.dtypes)
    want = {(i, k): len(k) for i, _, _, k in line_rows(texts(), 10)}
    for r in got.collect():
        assert want[(r.doc_id, r.text or "")] == (r.n_chars or 0) and r.kid == "clash"
    assert line_runs.dedup_lines(docs(spark, [])).collect() == []


def test_runs_are_merged_by_level(spark):
    runs = line_runs.LineRuns(min_docs=3, fan_out=2)
    counts = spark.createDataFrame([(1, 1, 1), (2, 2, 2), (3, 3, 1)], "h1 bigint, h2 bigint, n bigint")
    sizes = []
    for _ in range(4):
        runs.add(counts)
        sizes.append([len(level) for level in runs.levels])
    assert sizes == [[1], [0, 1], [1, 1], [0, 0, 1]]
    assert sorted(tuple(r) for r in runs.frequent.collect()) == [(1, 1), (2, 2), (3, 3)]


def test_a_known_hash_never_enters_a_second_run(spark):
    rng = np.random.default_rng(6)
    runs, total = line_runs.LineRuns(min_docs=4, fan_out=3), Counter()
    schema = "h1 bigint, h2 bigint, n bigint"
    for _ in range(5):
        batch = {int(h): int(rng.integers(1, 3)) for h in rng.integers(0, 60, 40)}
        total.update(batch)
        counts = spark.createDataFrame([(h, -h, n) for h, n in batch.items()], schema)
        plan = runs.meet(counts)._jdf.queryExecution().executedPlan().toString()
        # The batch moves once, and every run is merge-joined where it lies.
        assert plan.count("SortMergeJoin") == len(runs.runs()) and plan.count("Exchange") == 1
        runs.add(counts)
        held = [r.h1 for run in runs.runs() for r in run.collect()]
        assert len(held) == len(set(held)) and set(held) == set(total)
    assert [len(level) for level in runs.levels] == [2, 1]
    assert {r.h1 for r in runs.frequent.collect()} == {h for h, n in total.items() if n >= 4}


def test_network_score_is_the_plain_convolution():
    w = byte_cnn.new_weights(1)
    text = ("Ab é! " * 230).encode()
    padded = list(text) + [byte_cnn.PAD] * (-len(text) % byte_cnn.CHUNK + byte_cnn.WIDTH)
    z = []
    for c in range(0, len(text), byte_cnn.CHUNK):
        peaks = []
        for f in range(byte_cnn.FILTERS):
            at = [
                sum(
                    float(w["bytes"][padded[c + o + k]] @ w["filters"][k * byte_cnn.DIMS : (k + 1) * byte_cnn.DIMS, f])
                    for k in range(byte_cnn.WIDTH)
                )
                for o in range(0, byte_cnn.CHUNK, byte_cnn.HOP)
            ]
            peaks.append(max(0, max(at) + float(w["filter_bias"][f])))
        hidden = np.maximum(np.array(peaks) @ w["hidden"] + w["hidden_bias"], 0)
        z.append(float(hidden @ w["out"] + w["out_bias"][0]))
    assert byte_cnn.score_texts([text.decode()], w)[0] == pytest.approx(1 / (1 + np.exp(-np.mean(z))), abs=1e-4)


def test_network_tells_quality_on_held_out_rows(spark):
    scored = queries.quality_classifier(spark, "/root/testdata/sf0.1").join(table(spark, "/root/testdata/sf0.1", "labels"), "doc_id")
    rows = [(r.score, r.quality, r.doc_id, r.held_out) for r in scored.collect()]
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for _, _, i, h in rows)
    good = np.array([s for s, q, _, h in rows if h and q == 1])
    bad = np.array([s for s, q, _, h in rows if h and q == 0])
    assert (good[:, None] > bad[None]).mean() >= 0.97
    assert (good >= 0.3).mean() >= 0.98


def test_network_takes_odd_rows(spark):
    got = byte_cnn.score_quality(docs(spark), byte_cnn.new_weights()).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in texts())
    scores = {}
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        scores.setdefault(r.doc_id, set()).add(r.score)
    assert scores[0] == scores[1] and scores[5] == scores[6] and len(scores[17]) == 2
    assert byte_cnn.score_quality(docs(spark, []), byte_cnn.new_weights()).collect() == []
    assert byte_cnn.fit_byte_cnn(docs(spark), labels(spark, []))["out"].shape == (byte_cnn.HIDDEN,)


def test_line_query_hashes_the_kept_text(spark):
    rows = queries.line_dedup_query(spark, "/root/testdata/sf0.001").collect()
    docs_ = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()]
    want = [(i, n, d, hashlib.sha256(k.encode()).hexdigest()) for i, n, d, k in line_rows(docs_, 10)]
    assert by_id(map(tuple, rows)) == by_id(want)
