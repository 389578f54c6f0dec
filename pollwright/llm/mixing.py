"""Mixing to target weights with soft membership, from DataFrame functions only.

A classifier trained on a labelled table gives every document a probability for each domain.
Non-negative document rates are then fitted by projected-gradient least squares so that the
expected tokens per domain meet the targets.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pollwright.llm.common import cut, let
from pollwright.llm.quality_lines import one_text_each

DOMAINS = ("clean", "low", "toxic")
MARKS = "[\\x20\\x09-\\x0D.,;:'\"()]+"


@dataclass(frozen=True)
class DomainModel:
    """Softmax regression over the hashes of a document's features: ``bias[k]`` and
    ``weights[k][bucket]`` are scores of domain k against the first one."""

    domains: tuple[str, ...]
    bias: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]


def quality_domains(labels: DataFrame) -> DataFrame:
    """``doc_id, domain``: low quality first, then toxic, else clean. Documents with several
    labels count by the worst; rows without an id or a label are left out."""
    worst = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    )
    return worst.select(
        "doc_id",
        F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").otherwise("clean").alias("domain"),
    )


def words_of(text: Column) -> Column:
    """Lower-cased words, cut at blanks and at the marks that surround words."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), MARKS), "")


def features(words: Column, buckets: int) -> Column:
    """Buckets of the different words, and bucket 0 for texts where few words are different."""

    def of(hashed: Column) -> Column:
        mark = lambda d: F.when(F.size(d) * 2 < F.size(hashed), F.array_append(d, F.lit(0))).otherwise(d)
        return let(F.array_distinct(hashed), mark)

    return let(F.transform(words, lambda w: (F.pmod(F.xxhash64(w), F.lit(buckets - 1)) + 1).cast("int")), of)


def fit_domains(
    docs: DataFrame,
    labelled: DataFrame,
    domains: tuple[str, ...] = DOMAINS,
    buckets: int = 16_384,
    rows: int = 4096,
    max_bytes: int = 16_384,
) -> DomainModel:
    """The classifier, from at most ``rows`` labelled documents of at most ``max_bytes`` each
    (whole texts), chosen by a hash of the id; the driver gets their buckets. Of rows with the same
    id one counts, the one with the least hash of its text. Without labelled documents all domains
    are equally likely."""
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    usable = docs.select("doc_id", "text").where(F.octet_length("text") <= max_bytes)
    # The limit bounds the broadcast side.
    sample = one_text_each(usable.join(F.broadcast(chosen), "doc_id").where(F.col("domain").isin(*domains)), "domain")
    got = sorted((r.doc_id, domains.index(r.domain), r.x) for r in sample.select("doc_id", "domain", features(words_of(F.col("text")), buckets).alias("x")).collect())
    k = len(domains)
    if not got:
        return DomainModel(tuple(domains), (0.0,) * k, ((0.0,) * buckets,) * k)
    return _train(got, tuple(domains), buckets)


def _train(got: list[tuple[int, int, list[int]]], domains: tuple[str, ...], buckets: int, steps: int = 80) -> DomainModel:
    """Adam on the log loss with a small penalty on the weights."""
    k = len(domains)
    truth = np.eye(k)[[y for _, y, _ in got]]
    owner = np.repeat(np.arange(len(got)), [len(x) for *_, x in got])
    at = np.array([b for *_, x in got for b in x], dtype=np.int64)
    params = np.zeros((k, buckets + 1))
    first, second = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        z = np.stack([np.bincount(owner, row[at], len(got)) + row[-1] for row in params], 1)
        chance = np.exp(z - z.max(axis=1, keepdims=True))
        error = chance / chance.sum(axis=1, keepdims=True) - truth
        slope = np.stack([np.append(np.bincount(at, e[owner], buckets), e.sum()) for e in error.T]) / len(got)
        slope[:, :-1] += 1e-4 * params[:, :-1]
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        params -= 0.1 * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    params -= params[0]
    return DomainModel(domains, tuple(params[:, -1].tolist()), tuple(tuple(r) for r in params[:, :-1].tolist()))


def membership(text: Column, model: DomainModel) -> Column:
    """Struct of ``tokens``, the number of words, and ``p``, the array of domain probabilities;
    a text without words has those of the bias."""
    # As one text each, which Spark turns into an array once; many literals burden the driver.
    tables = [F.split(F.lit(",".join(map(repr, w))), ",").cast("array<double>") for w in model.weights[1:]]

    def summed(buckets: Column, weights: Column) -> Column:
        return F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(weights, b))

    def scores(buckets: Column) -> Column:
        return F.array(F.lit(0.0), *[summed(buckets, t) + b for t, b in zip(tables, model.bias[1:])])

    def softmax(s: Column) -> Column:
        top = F.array_max(s)
        exps = F.transform(s, lambda x: F.exp(x - top))
        return let(exps, lambda e: let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda n: F.transform(e, lambda x: x / n)))

    def both(words: Column) -> Column:
        p = let(let(features(words, len(model.weights[0])), scores), softmax)
        return F.struct(F.size(words).cast("bigint").alias("tokens"), p.alias("p"))

    return let(words_of(text), both)


def fit_rates(
    members: DataFrame, targets: Mapping[str, float], domains: tuple[str, ...], tolerance: float = 1e-6, steps: int = 40
) -> tuple[list[list[float]], float]:
    """The moves that ``rate_of`` turns into the rates of ``members(tokens, p)``, and the final
    relative error of the domain totals.

    Minimises the squared distance between the expected domain tokens sum(rate * tokens * p) and
    the target shares of all tokens, over rates of at least 0, starting from 1. A step adds
    p' G^-1 (what is missing) to each rate and cuts at 0. G = sum(tokens * p p') over the
    documents whose rate is above 0 scales the gradient, so that a step that cuts nothing ends
    the search; a step that makes the distance greater is taken back and halved. Each step is one
    pass that sums a few numbers per domain; a document's rate is a function of its own ``p``, so
    none is stored.
    """
    k = len(domains)
    p = [F.get("p", F.lit(i)) for i in range(k)]
    weights = np.array([targets[d] for d in domains], float)

    def measured(moves: list[list[float]]) -> tuple[np.ndarray, np.ndarray, float]:
        weighted = F.when(F.col("r") > 0, F.col("tokens")).otherwise(0)
        sums = (
            members.select("tokens", "p", rate_of(F.col("p"), moves).alias("r"))
            .agg(
                F.sum("tokens").alias("total"),
                *[F.sum(F.col("tokens") * F.col("r") * p[i]).alias(f"t{i}") for i in range(k)],
                *[F.sum(weighted * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)],
            )
            .first()
        )
        totals = np.array([sums[f"t{i}"] or 0 for i in range(k)], float)
        gram = np.array([[sums[f"g{min(i, j)}_{max(i, j)}"] or 0 for j in range(k)] for i in range(k)], float)
        return totals, gram, float(sums["total"] or 0)

    moves: list[list[float]] = []
    totals, gram, total = measured(moves)
    if not total:
        return [], 0.0
    missing = weights / weights.sum() * total - totals
    part = 1.0
    for _ in range(steps):
        if np.abs(missing).sum() <= tolerance * total:
            break
        move = np.linalg.pinv(gram + np.eye(k) * 1e-9 * total) @ missing * part
        tried = [*moves, move.tolist()]
        totals, new_gram, _ = measured(tried)
        left = weights / weights.sum() * total - totals
        if np.square(left).sum() < np.square(missing).sum():
            moves, missing, gram, part = tried, left, new_gram, min(1.0, 2 * part)
        else:
            part /= 2
    return moves, float(np.abs(missing).sum() / total)


def rate_of(p: Column, moves: list[list[float]]) -> Column:
    """The rate of a document with domain probabilities ``p``: 1 and all moves, each cut at 0."""
    if not moves:
        return F.lit(1.0)
    table = F.array(*[F.array(*[F.lit(x) for x in m]) for m in moves])

    def moved(q: Column) -> Column:
        dot = lambda m: sum(F.get(q, F.lit(i)) * F.get(m, F.lit(i)) for i in range(len(moves[0])))
        return F.aggregate(table, F.lit(1.0), lambda r, m: F.greatest(F.lit(0.0), r + dot(m)))

    return let(p, moved)


def mixing_rates(docs: DataFrame, model: DomainModel, targets: Mapping[str, float]) -> DataFrame:
    """``doc_id, tokens, p, rate`` for every row: words, domain probabilities and the fitted rate.

    Null and empty texts have no tokens, the bias's probabilities and the rate that goes with
    them. Null ids and repeated rows are fitted like others, other columns are not read, and an
    empty table gives no rows. Nothing is shuffled but partial sums.
    """
    m = membership(F.col("text").cast("string"), model)
    members = cut(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), m.alias("m")).select("doc_id", "m.*"))
    moves, _ = fit_rates(members, targets, model.domains)
    return members.withColumn("rate", rate_of(F.col("p"), moves))


def thin_to_shares(docs: DataFrame, model: DomainModel, most: Mapping[str, float]) -> DataFrame:
    """The rows of ``docs``, with all columns, that a draw at the fitted rate keeps.

    The targets are the shares in ``most`` of all expected tokens for these domains, or what they have
    where that is less, and the rest for the first domain, whose documents have rates of one and
    more. A row stays if a number in [0, 1) made from its id and text is below its rate; equal
    rows meet the same fate. Rates above one keep a row once, so clean documents stay and the drawn
    total is smaller than the fitted one.
    """
    m = membership(F.col("text").cast("string"), model).alias("m")
    members = cut(docs.select(m).select("m.*"))
    sums = [F.sum(F.col("tokens") * F.get("p", F.lit(i))) for i in range(len(model.domains))]
    now = [x or 0.0 for x in members.agg(*sums).first()]
    total = sum(now)
    if not total:
        return docs
    targets = {d: min(most.get(d, 1.0), x / total) for d, x in zip(model.domains, now)}
    targets[model.domains[0]] = 1 - sum(targets[d] for d in model.domains[1:])
    moves, _ = fit_rates(members, targets, model.domains)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # One expression: as a column, the probabilities would be computed for each of their uses.
    return docs.where(draw < rate_of(membership(F.col("text").cast("string"), model)["p"], moves))
