"""Quality rules over lines: a linear-chain conditional random field marks each line as content
or boilerplate, and the share of content decides whether a document stays."""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pollwright.llm.common import BLANKS, slices, texts

STATS = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, n_lines bigint, content_share double"
)
SYMBOLS = "#*$%&|<>"
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = SYMBOLS.encode()
N_FEATURES = 11


@dataclass(frozen=True)
class LineModel:
    """Weights of the field: ``emission`` for content against boilerplate, ``transition[a][b]``
    from state a to b, where 1 is content."""

    emission: tuple[float, ...]
    transition: tuple[tuple[float, float], tuple[float, float]]


# Used where no labelled row of either class is at hand.
UNTRAINED = LineModel(
    (1.5, 0.3, -4.0, -2.0, -12.0, -8.0, -3.0, 0.5, 0.0, -0.5, -6.0), ((0.8, -0.8), (-0.8, 0.8))
)


def line_features(lines: list[bytes], words: list[list[bytes]]) -> np.ndarray:
    """One row per line: constant, length, shares of capitals, digits, symbols, exclamation
    marks and bars, share of different words, word length, repeated line, repeated words."""
    rows, seen = [], set()
    for line, ws in zip(lines, words):
        size, n = len(line), len(ws)
        rows.append(
            (
                1.0,
                np.log1p(n) / 5,
                (size - len(line.translate(None, _UPPER))) / size,
                (size - len(line.translate(None, _DIGIT))) / size,
                (size - len(line.translate(None, _SYMBOL))) / size,
                line.count(b"!") / n,
                line.count(b"|") / n,
                len(set(ws)) / n,
                size / n / 10,
                float(line in seen),
                sum(map(operator.eq, ws, ws[1:])) / n,
            )
        )
        seen.add(line)
    return np.array(rows, dtype=np.float64).reshape(-1, N_FEATURES)


def worded_lines(text: str) -> tuple[list[bytes], list[list[bytes]]]:
    """The lines that hold a word, and their words. Splitting bytes splits at exactly the six
    blanks, and every line end is one of them."""
    lines, words = [], []
    for line in text.encode().split(b"\n"):
        ws = line.split()
        if ws:
            lines.append(line)
            words.append(ws)
    return lines, words


def viterbi(features: np.ndarray, model: LineModel) -> list[bool]:
    """The best labelling of a document's lines; on ties a line is content."""
    if not len(features):
        return []
    scores = (features @ np.array(model.emission)).tolist()
    (bb, bc), (cb, cc) = model.transition
    boiler, content, back = 0.0, scores[0], []
    for s in scores[1:]:
        from_content = (content + cb >= boiler + bb, content + cc >= boiler + bc)
        back.append(from_content)
        boiler, content = (
            content + cb if from_content[0] else boiler + bb,
            (content + cc if from_content[1] else boiler + bc) + s,
        )
    state = content >= boiler
    labels = [state]
    for from_content in reversed(back):
        state = from_content[state]
        labels.append(state)
    return labels[::-1]


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    at = np.flatnonzero(np.fromiter(map(counts.__getitem__, windows), np.int64, len(windows)) > 1)
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[at + shift] = True
    return int(covered.sum())


def judge(text: str, model: LineModel, min_content: float) -> tuple:
    lines, words = worded_lines(text)
    flat = [w for ws in words for w in ws]
    n = len(flat)
    repeats = repeated_words(flat)
    failed = n < 50 or 100 * repeats > 50 * n
    labels = viterbi(line_features(lines, words), model)
    content = sum(len(ws) for ws, label in zip(words, labels) if label)
    share = content / n if n else 0.0
    return (
        n,
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeats,
        failed,
        not failed and share >= min_content,
        len(lines),
        share,
    )


def quality_rules(docs: DataFrame, model: LineModel, min_content: float = 0.5) -> DataFrame:
    """Base statistics, the share of words in content lines and the verdict per document:
    ``doc_id`` and the columns of ``STATS``.

    Null and empty texts have no words, so they fail the base rule. Null ids and repeated rows
    give one row each; an empty table gives none; other columns are not read. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", *[f.split()[0] for f in STATS.split(", ")]]
        for part in slices(batches):
            rows = [judge(t, model, min_content) for t in texts(part)]
            yield pa.record_batch([part.column(0), *map(pa.array, zip(*rows))], names=names)

    slim = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id bigint, {STATS}")


def keep_quality(docs: DataFrame, model: LineModel, min_content: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the rules keep."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            kept = [judge(t or "", model, min_content)[6] for t in part.column(at).to_pylist()]
            yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema]))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``rows`` labelled documents, chosen by a hash of the
    id. A document with several labels counts by the lowest, and of rows with the same id
    the text with the least hash is taken, so there are never more rows than chosen ids."""
    chosen = (
        labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min(column).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    # The limit bounds the broadcast side.
    return one_text_each(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "label")


def one_text_each(found: DataFrame, label: str) -> DataFrame:
    """One row per id: rows of one id are reduced before they move, however many there are."""
    return found.groupBy("doc_id", label).agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", label)


def fit_line_model(
    docs: DataFrame, labels: DataFrame, rows: int = 1500, lines: int = 32, steps: int = 150
) -> LineModel:
    """The field's weights by maximum conditional likelihood.

    A line's label says what kind of document it is like: lines of documents labelled ``quality`` 1
    are taken as content, those of documents labelled 0 as boilerplate. Beside the documents the
    field learns from joined pieces of a good and a bad one, so that it sees labels change inside a
    document. At most ``rows`` labelled documents are read, one text per id, and of each at most
    ``lines`` consecutive lines from its middle; the untrained weights are returned if either
    class is missing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [line_features(*worded_lines(t)) for t in texts(part)]
            mid = [x[max(0, (len(x) - lines) // 2) :][:lines] for x in found]
            yield pa.record_batch(
                [part.column(0), part.column(2), pa.array([x.tobytes() for x in mid], pa.binary())],
                names=["doc_id", "label", "features"],
            )

    sample = labelled_sample(docs, labels, "quality", rows).select("doc_id", "text", F.col("label").cast("int"))
    got = sorted(
        (r.doc_id, r.label, r.features)
        for r in sample.mapInArrow(run, "doc_id bigint, label int, features binary").collect()
        if r.features
    )
    if len({label for _, label, _ in got}) < 2:
        return UNTRAINED
    single = [(np.frombuffer(x).reshape(-1, N_FEATURES), label) for _, label, x in got]
    return train(single + joined_pieces(single, lines), lines, steps)


Labelled = tuple[np.ndarray, int | np.ndarray]


def joined_pieces(documents: list[tuple[np.ndarray, int]], lines: int) -> list[Labelled]:
    """Pieces of good and bad documents one after the other, in both orders by turns, with a label
    for each line. Every document of the larger class is used once."""
    good, bad = ([x for x, label in documents if label == y] for y in (1, 0))
    out = []
    for i in range(max(len(good), len(bad))):
        pair = [(good[i % len(good)], 1), (bad[i % len(bad)], 0)][:: 1 if i % 2 else -1]
        # Pieces of many lengths, whatever the lengths of the documents.
        cuts = [1 + (i * 7 + k * 5) % (lines // 2) for k in range(2)]
        pieces = [(x[:cut], label) for (x, label), cut in zip(pair, cuts)]
        out.append((np.concatenate([x for x, _ in pieces]), np.concatenate([np.full(len(x), label) for x, label in pieces])))
    return out


def train(documents: list[Labelled], lines: int, steps: int) -> LineModel:
    """Gradient ascent (Adam) on the likelihood of whole labellings, by forward and backward
    sums over all documents at once. A label holds for a whole document or for each line; good, bad
    and mixed documents have the same weight together, and inside a kind all count alike."""
    n = len(documents)
    x = np.zeros((n, lines, N_FEATURES))
    real = np.zeros((n, lines))
    y = np.zeros((n, lines), int)
    kind = np.zeros(n, int)
    for i, (features, label) in enumerate(documents):
        x[i, : len(features)] = features
        real[i, : len(features)] = 1
        y[i, : len(features)] = label
        kind[i] = label if np.isscalar(label) else 2
    share = 1 / np.bincount(kind)[kind] / len(np.unique(kind))
    truth = np.eye(2)[y] * real[..., None]
    edges = real[:, 1:]
    true_edges = np.einsum("nt,nta,ntb->ab", edges * share[:, None], truth[:, :-1], truth[:, 1:])
    emission, transition = np.zeros(N_FEATURES), np.zeros((2, 2))
    params, moments = np.zeros(N_FEATURES + 4), np.zeros((2, N_FEATURES + 4))
    for step in range(1, steps + 1):
        emission, transition = params[:N_FEATURES], params[N_FEATURES:].reshape(2, 2)
        unary = np.stack([np.zeros((n, lines)), x @ emission], -1)
        forward, backward = unary.copy(), np.zeros_like(unary)
        for t in range(1, lines):
            moved = np.logaddexp.reduce(forward[:, t - 1, :, None] + transition, axis=1) + unary[:, t]
            forward[:, t] = np.where(real[:, t, None] > 0, moved, forward[:, t - 1])
        for t in range(lines - 2, -1, -1):
            moved = np.logaddexp.reduce(transition + (unary[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
            backward[:, t] = np.where(real[:, t + 1, None] > 0, moved, 0.0)
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        marginal = np.exp(forward + backward - total[:, None, None]) * real[..., None]
        pairs = np.exp(
            forward[:, :-1, :, None]
            + transition
            + (unary[:, 1:] + backward[:, 1:])[:, :, None, :]
            - total[:, None, None, None]
        ) * edges[..., None, None]
        gradient = np.concatenate(
            [
                np.einsum("nt,ntf->f", (truth - marginal)[..., 1] * share[:, None], x),
                (true_edges - np.einsum("ntab,n->ab", pairs, share)).ravel(),
            ]
        ) - 0.001 * params
        moments = 0.9 * moments[0] + 0.1 * gradient, 0.99 * moments[1] + 0.01 * gradient**2
        rate = 0.2 / np.sqrt(moments[1] / (1 - 0.99**step) + 1e-12)
        params = params + rate * moments[0] / (1 - 0.9**step)
    return LineModel(
        tuple(map(float, params[:N_FEATURES])), tuple(tuple(map(float, r)) for r in params[N_FEATURES:].reshape(2, 2))
    )
