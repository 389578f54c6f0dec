"""Quality probability from a convolutional network over bytes, in numpy.

A text is read as chunks of ``CHUNK`` bytes, each with the first bytes of the next one, so that
every window of ``WIDTH`` bytes lies in a chunk. Learned filters run over all windows of a
chunk, each keeps its maximum, a small hidden layer turns the maxima into a chunk's logit, and
the mean over the chunks gives the document's probability. All bytes of a text are used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pollwright.llm.common import slices, texts
from pollwright.llm.quality_lines import labelled_sample

CHUNK, WIDTH, HOP = 512, 12, 4
DIMS, FILTERS, HIDDEN = 8, 32, 32
PAD = 256
BLOCK = 256  # chunks computed at once

Weights = dict[str, np.ndarray]


def new_weights(seed: int = 7) -> Weights:
    rng = np.random.default_rng(seed)

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    weights = {
        "bytes": normal(PAD + 1, DIMS, scale=0.5),
        "filters": normal(WIDTH * DIMS, FILTERS, scale=(WIDTH * DIMS) ** -0.5),
        "filter_bias": np.zeros(FILTERS, np.float32),
        "hidden": normal(FILTERS, HIDDEN, scale=FILTERS**-0.5),
        "hidden_bias": np.zeros(HIDDEN, np.float32),
        "out": normal(HIDDEN, scale=HIDDEN**-0.5),
        "out_bias": np.zeros(1, np.float32),
    }
    weights["bytes"][PAD] = 0
    return weights


def to_chunks(data: bytes) -> np.ndarray:
    """Chunks of a text with their overlap, padded; an empty text is one chunk of padding."""
    n = max(1, -(-len(data) // CHUNK))
    padded = np.full(n * CHUNK + WIDTH - HOP, PAD, np.int16)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK + WIDTH - HOP)[::CHUNK]


def pooled(chunks: np.ndarray, w: Weights) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's maximum in each chunk, and the window where it is."""
    codes = w["bytes"][chunks].reshape(len(chunks), -1)
    windows = np.lib.stride_tricks.sliding_window_view(codes, WIDTH * DIMS, axis=1)[:, :: HOP * DIMS]
    found = np.ascontiguousarray(windows).reshape(-1, WIDTH * DIMS) @ w["filters"]
    found = found.reshape(len(chunks), -1, FILTERS)
    return found.max(axis=1), found.argmax(axis=1)


def logits(chunks: np.ndarray, w: Weights) -> np.ndarray:
    out = []
    for start in range(0, len(chunks), BLOCK):
        peak, _ = pooled(chunks[start : start + BLOCK], w)
        hidden = np.maximum(np.maximum(peak + w["filter_bias"], 0) @ w["hidden"] + w["hidden_bias"], 0)
        out.append(hidden @ w["out"] + w["out_bias"])
    return np.concatenate(out)


def score_texts(many: list[str], w: Weights) -> list[float]:
    """One probability per text. Texts are computed one by one in blocks of chunks, so equal
    texts have equal scores and a long text needs no more memory than its bytes."""
    out = []
    for text in many:
        z = float(np.mean(logits(to_chunks(text.encode()), w), dtype=np.float64))
        out.append(float(1 / (1 + np.exp(-np.clip(z, -30, 30)))))
    return out


def train(samples: list[tuple[bytes, int]], epochs: int = 12, batch: int = 32, rate: float = 3e-3, seed: int = 7) -> Weights:
    """Adam on the log loss; gradients reach a filter through its maximum only."""
    w = new_weights(seed)
    rng = np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(samples))
        for start in range(0, len(order), batch):
            part = [samples[i] for i in order[start : start + batch]]
            pieces = [to_chunks(data) for data, _ in part]
            owner = np.repeat(np.arange(len(part)), [len(p) for p in pieces])
            share = (1 / np.array([len(p) for p in pieces], np.float32))[owner]
            chunks = np.concatenate(pieces)
            found = [pooled(chunks[i : i + BLOCK], w) for i in range(0, len(chunks), BLOCK)]
            peak = np.concatenate([f[0] for f in found]) + w["filter_bias"]
            where = np.concatenate([f[1] for f in found])
            active = np.maximum(peak, 0)
            before = active @ w["hidden"] + w["hidden_bias"]
            hidden = np.maximum(before, 0)
            z = np.bincount(owner, (hidden @ w["out"]) * share) + w["out_bias"][0]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - np.array([y for _, y in part])) / len(part)

            g_chunk = (error[owner] * share).astype(np.float32)
            g_before = g_chunk[:, None] * w["out"] * (before > 0)
            g_peak = (g_before @ w["hidden"].T) * (peak > 0)
            at = where[..., None] * HOP + np.arange(WIDTH)
            seen = chunks[np.arange(len(chunks))[:, None, None], at]
            g_codes = g_peak[..., None] * w["filters"].T
            g_bytes = np.zeros_like(w["bytes"])
            flat = g_codes.reshape(-1, DIMS)
            for k in range(DIMS):
                g_bytes[:, k] = np.bincount(seen.ravel(), flat[:, k], PAD + 1)
            g_bytes[PAD] = 0
            gradients = {
                "bytes": g_bytes,
                "filters": np.einsum("cf,cfk->kf", g_peak, w["bytes"][seen].reshape(len(chunks), FILTERS, -1)),
                "filter_bias": g_peak.sum(0),
                "hidden": active.T @ g_before,
                "hidden_bias": g_before.sum(0),
                "out": hidden.T @ g_chunk,
                "out_bias": np.array([error.sum()]),
            }
            step += 1
            now = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in gradients.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] = (w[k] - now * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
    return w


def held_out(doc_id):
    """Whether a document is kept from training: the remainder of its id's CRC by 5 is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_byte_cnn(docs: DataFrame, labels: DataFrame, rows: int = 3000, max_bytes: int = 16_384) -> Weights:
    """The network, trained on at most ``rows`` labelled documents of at most ``max_bytes`` each
    (whole texts) that are not held out; of rows with the same id one counts, the one with the least
    hash of its text. Without any labelled row it stays as initialised."""
    usable = docs.where(F.octet_length("text") <= max_bytes)
    sample = labelled_sample(usable, labels.where(~held_out("doc_id")), "quality", rows)
    got = sorted((r.doc_id, r.text, r.label) for r in sample.collect())
    if not got:
        return new_weights()
    return train([(text.encode(), int(label)) for _, text, label in got])


def score_quality(docs: DataFrame, weights: Weights, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    The score depends on nothing but the text. Null text is scored like the empty text, null ids
    are not held out, repeated rows give equal scores, and other columns are not read. No
    shuffle; the weights (a few thousand numbers) travel with the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            scores = pa.array(score_texts(texts(part), weights), pa.float64())
            yield pa.record_batch([part.column(0), scores], names=["doc_id", "score"])

    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text"))
    scored = slim.mapInArrow(run, "doc_id bigint, score double")
    return scored.select(
        "doc_id",
        held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
