"""Counterfactual-regularised toxicity classifier.

A logistic model over character grams of words. Labelled texts that mention an
identity term are paired with the same text with each term swapped for another
of its group, and training adds the squared difference of the two scores
(as log-odds) to the loss. Weights that only tell groups apart thus cost more
than they earn, and neutral mentions of a group stay below the threshold.

Summed weights drift with the length of a text and overstate what was learned, so
log-odds are calibrated: each part of the sample is scored by a model of the other
parts, and a logistic fit of the labels to these scores and to the length beyond the
mean corrects the final model. A prior holds the correction near none in small samples.

Training reads a bounded sample of the labelled rows (``sample_rows``); scoring
is one pass over the whole texts without a shuffle, with a model of at most
``features`` weights.

Defined results: null and empty texts score the model's prior; labels other
than 0 and 1, and labels without a doc_id, are ignored; a doc_id labelled twice
counts as toxic if any label says so; with no labelled rows, or only one kind,
every score is next to 0 (no labels, or none toxic) or to 1 (all toxic). Repeated documents
are scored alike, one row each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from vigil.llm import common
from vigil.llm.spans import join_texts

# Identity terms by group; a term is swapped for the next one of its group.
IDENTITY_TERMS = {
    "gender": ["women", "men"],
    "gender_one": ["woman", "man"],
    "youth": ["girls", "boys"],
    "faith": ["christians", "muslims", "jews", "hindus", "buddhists", "atheists"],
    "faith_one": ["christian", "muslim", "jewish", "hindu", "buddhist", "atheist"],
    "colour": ["black", "white", "asian", "latino"],
    "love": ["gay", "straight", "lesbian", "bisexual"],
    "origin": ["immigrants", "natives", "refugees", "foreigners"],
    "nation": ["american", "mexican", "chinese", "african", "arab", "european"],
    "age": ["old", "young"],
    "gender_de": ["frauen", "männer"],
    "gender_fr": ["femmes", "hommes"],
    "gender_es": ["mujeres", "hombres"],
}

GRAM = 5
BUCKETS = 1 << 20
# letters become lower case, all other ASCII becomes a blank, other bytes stay
_LETTERS = np.full(256, 0x20, dtype=np.uint8)
_LETTERS[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTERS[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTERS[0x80:] = np.arange(0x80, 0x100)


def swapper(groups: dict[str, list[str]]):
    """A function that swaps every identity term of a text, or returns None if there is none."""
    follow = {t: terms[(i + 1) % len(terms)] for terms in groups.values() for i, t in enumerate(terms)}
    found = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, follow), key=len, reverse=True)) + r")(?!\w)", re.I)

    def swap(text: str) -> str | None:
        changed, n = found.subn(lambda m: follow[m[0].lower()], text)
        return changed if n else None

    return swap


def gram_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the gram at each byte of all texts, and the offset of each text.

    Grams that span a word boundary other than a single leading or trailing
    blank, and the blanks added between texts, are in bucket 0.
    """
    data, offsets = join_texts([b" " + t for t in texts], gap=GRAM)
    data = _LETTERS[data]
    n = len(data) - GRAM + 1
    value = np.zeros(n, dtype=np.uint64)
    inner = np.zeros(n, dtype=bool)
    for i in range(GRAM):
        part = data[i : i + n]
        value = (value << np.uint64(8)) | part
        if 0 < i < GRAM - 1:
            inner |= part == 0x20
    mixed = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
    mixed[inner] = 0
    return mixed.astype(np.int32), offsets


def distinct_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, bucket) pairs."""
    buckets, offsets = gram_buckets(texts)
    at = np.flatnonzero(buckets)
    owner = np.searchsorted(offsets, at, side="right") - 1
    pairs = np.unique(owner.astype(np.int64) * BUCKETS + buckets[at])
    return pairs // BUCKETS, (pairs % BUCKETS).astype(np.int32)


@dataclass
class Model:
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    # correction of the log-odds: factor, weight of the length beyond the mean, constant
    calibration: tuple[float, float, float] = (1.0, 0.0, 0.0)
    mean_length: float = 0.0

    def raw(self, rows: np.ndarray, buckets: np.ndarray, texts: int) -> np.ndarray:
        """Log-odds, without correction, from distinct (text, bucket) pairs."""
        if not len(self.buckets):
            return np.full(texts, self.bias)
        at = np.minimum(np.searchsorted(self.buckets, buckets), len(self.buckets) - 1)
        known = self.buckets[at] == buckets
        return self.bias + np.bincount(rows[known], weights=self.weights[at[known]], minlength=texts)

    def log_odds(self, texts: list[bytes]) -> np.ndarray:
        rows, buckets = distinct_buckets(texts)
        factor, tilt, constant = self.calibration
        beyond = beyond_mean(np.bincount(rows, minlength=len(texts)), self.mean_length)
        return factor * self.raw(rows, buckets, len(texts)) + tilt * beyond + constant


def beyond_mean(grams: np.ndarray, mean: float) -> np.ndarray:
    """How far the logarithm of a text's distinct grams lies above the mean, at least 0."""
    return np.maximum(0.0, np.log1p(grams) - mean)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -50, 50)))


def descend(rows, columns, toxic, pairs, width, *, pull: float, decay: float, steps: int):
    """Minimise log loss + pull * mean squared swap difference + decay * squared weights.

    rows and columns list the ones of a 0/1 matrix whose first len(toxic) rows
    are labelled; pairs lists (row, row of the swapped text).
    """
    total = int(max(rows.max(initial=-1) + 1, len(toxic), pairs.max(initial=-1) + 1))
    share = toxic.mean()
    weights, bias = np.zeros(width), float(np.log(share / (1 - share)))
    # both kinds weigh alike, so that the rarer one is learned as well
    importance = np.where(toxic > 0, 0.5 / max(toxic.sum(), 1), 0.5 / max((1 - toxic).sum(), 1))
    moment, square = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        z = bias + np.bincount(rows, weights=weights[columns], minlength=total)
        pushed = np.zeros(total)
        pushed[: len(toxic)] = importance * (sigmoid(z[: len(toxic)]) - toxic)
        if len(pairs):
            gap = 2 * pull * (z[pairs[:, 0]] - z[pairs[:, 1]]) / len(pairs)
            np.add.at(pushed, pairs[:, 0], gap)
            np.add.at(pushed, pairs[:, 1], -gap)
        slope = np.append(np.bincount(columns, weights=pushed[rows], minlength=width) + 2 * decay * weights, pushed.sum())
        moment = 0.9 * moment + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        move = 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
        weights -= move[:-1]
        bias -= move[-1]
    return weights, bias


SAMPLED = pa.schema([("toxic", pa.int32()), ("buckets", pa.binary()), ("swapped", pa.binary())])


def sampled_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    swap = swapper(IDENTITY_TERMS)
    for batch in common.batches_of(batches):
        texts = common.texts_of(batch)
        swaps = [swap(t.decode()) for t in texts]
        both = texts + [(s or "").encode() for s in swaps]
        rows, buckets = distinct_buckets(both)
        cut = np.searchsorted(rows, np.arange(len(both) + 1))
        blobs = [buckets[cut[i] : cut[i + 1]].tobytes() for i in range(len(both))]
        yield common.pack(
            SAMPLED,
            batch.column(batch.schema.get_field_index("toxic")).cast(pa.int32()),
            blobs[: len(texts)],
            [b if s is not None else None for b, s in zip(blobs[len(texts) :], swaps, strict=True)],
        )


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_rows: int, folds: int, held_out: int) -> DataFrame:
    """(text, toxic) of at most ``sample_rows`` labelled documents outside the held-out fold."""
    told = (
        labels.where(labels["doc_id"].isNotNull() & labels["toxic"].isin(0, 1))
        .where(common.fold(folds) != held_out)
        .groupBy(labels["doc_id"].cast("long").alias("did"))
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("did"), "did")
        .limit(sample_rows)
    )
    # the right side has at most sample_rows rows of two numbers
    return common.whole_texts(docs).join(F.broadcast(told), "did").select("text", "toxic")


def flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) pairs of bucket sets."""
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return rows, np.concatenate([*sets, np.zeros(0, dtype=np.int32)])


def chosen_buckets(sets: list[np.ndarray], toxic: np.ndarray, bound: int, least_gain: float) -> np.ndarray:
    """The at most ``bound`` buckets whose presence tells the kinds apart by ``least_gain`` or more, sorted.

    The gain is the log-likelihood ratio of a presence test; rows with a bucket must be two or more.
    """
    seen = [np.zeros(BUCKETS), np.zeros(BUCKETS)]
    for kind, buckets in zip(toxic.astype(int), sets, strict=True):
        seen[kind][buckets] += 1
    n = [(toxic == 0).sum(), (toxic == 1).sum()]
    rate = [(seen[k] + 0.5) / (n[k] + 1) for k in (0, 1)]
    mean = (seen[0] + seen[1] + 1) / (n[0] + n[1] + 2)
    gain = sum(
        seen[k] * np.log(rate[k] / mean) + (n[k] - seen[k]) * np.log((1 - rate[k]) / (1 - mean)) for k in (0, 1)
    )
    gain[seen[0] + seen[1] < 2] = 0
    best = np.argsort(-gain, kind="stable")[:bound]
    return np.sort(best[gain[best] > least_gain]).astype(np.int32)


def fit(
    sets: list[np.ndarray],
    swapped: list[np.ndarray | None],
    toxic: np.ndarray,
    *,
    features: int,
    per_row: float,
    least_gain: float,
    pull: float,
    decay: float,
    steps: int,
) -> Model:
    """The model of rows given as bucket sets, each with that of its swapped text, if there is one."""
    others = [i for i, s in enumerate(swapped) if s is not None]
    pairs = np.array([(i, len(sets) + k) for k, i in enumerate(others)], dtype=np.int64).reshape(-1, 2)
    # few labelled rows can't tell many buckets apart
    bound = min(features, max(32, int(len(toxic) * per_row)))
    chosen = chosen_buckets(sets, toxic, bound, least_gain)
    wanted = np.full(BUCKETS, -1, dtype=np.int64)
    wanted[chosen] = np.arange(len(chosen))
    rows, buckets = flat([*sets, *(swapped[i] for i in others)])
    columns = wanted[buckets]
    weights, bias = descend(
        rows[columns >= 0], columns[columns >= 0], toxic, pairs, len(chosen), pull=pull, decay=decay, steps=steps
    )
    return Model(chosen, weights, bias)


def calibrated(raw: np.ndarray, beyond: np.ndarray, toxic: np.ndarray, prior: float) -> tuple[float, float, float]:
    """Factor, weight of the length and constant that fit the labels best, held near (1, 0, 0) by ``prior``."""
    given = np.stack([raw, beyond, np.ones(len(raw))], axis=1)
    start = np.array([1.0, 0.0, 0.0])

    def loss(at: np.ndarray) -> float:
        z = given @ at
        return float(np.sum(np.logaddexp(0.0, z) - toxic * z) + prior * np.sum((at - start) ** 2) / 2)

    at = start.copy()
    for _ in range(100):
        p = sigmoid(given @ at)
        slope = given.T @ (p - toxic) + prior * (at - start)
        curve = (given * (p * (1 - p))[:, None]).T @ given + prior * np.eye(3)
        step = np.linalg.solve(curve, slope)
        # whole steps can overshoot where most scores are far from the threshold
        while loss(at - step) > loss(at) and np.abs(step).max() > 1e-9:
            step /= 2
        at = at - step
        if np.abs(step).max() <= 1e-9:
            break
    # a correction that turns the order of scores round is none
    return tuple(map(float, at)) if np.isfinite(at).all() and at[0] > 0 else (1.0, 0.0, 0.0)


def train(
    docs: DataFrame,
    labels: DataFrame,
    *,
    sample_rows: int = 6000,
    features: int = 4096,
    per_row: float = 0.6,
    least_gain: float = 4.0,
    folds: int = 5,
    held_out: int = 0,
    pull: float = 1.0,
    decay: float = 1e-3,
    steps: int = 300,
    parts: int = 2,
    prior: float = 10.0,
) -> Model:
    """Fit the model on a bounded sample of the labelled rows.

    The driver receives at most ``sample_rows`` sets of gram buckets. Of them the
    ``features`` buckets (``per_row`` for each row at most) that differ most between the two
    kinds, by a log-likelihood gain above ``least_gain``, take part in the descent. The scores
    that calibrate the model come from ``parts`` models that did not see the rows scored; where
    these rows are of one kind only, nothing is corrected.
    """
    found = (
        labelled_sample(docs, labels, sample_rows, folds, held_out)
        .mapInArrow(sampled_features, "toxic int, buckets binary, swapped binary")
        .orderBy(F.xxhash64("buckets"), "toxic")
        .toArrow()
    )
    toxic = np.asarray(found.column("toxic")).astype(float)
    if not len(toxic) or toxic.min() == toxic.max():
        return Model(np.zeros(0, dtype=np.int32), np.zeros(0), 50.0 if len(toxic) and toxic[0] == 1 else -50.0)
    sets, swapped = (
        [None if b is None else np.frombuffer(b, dtype=np.int32) for b in found.column(name).to_pylist()]
        for name in ("buckets", "swapped")
    )
    settings = dict(features=features, per_row=per_row, least_gain=least_gain, pull=pull, decay=decay, steps=steps)
    model = fit(sets, swapped, toxic, **settings)
    sizes = np.array([len(s) for s in sets])
    model.mean_length = float(np.log1p(sizes).mean())
    part = np.arange(len(sets)) % parts
    raw = np.zeros(len(sets))
    for this in range(parts):
        rest, own = np.flatnonzero(part != this), np.flatnonzero(part == this)
        if not len(rest) or toxic[rest].min() == toxic[rest].max():
            return model
        partial = fit([sets[i] for i in rest], [swapped[i] for i in rest], toxic[rest], **settings)
        raw[own] = partial.raw(*flat([sets[i] for i in own]), len(own))
    model.calibration = calibrated(raw, beyond_mean(sizes, model.mean_length), toxic, prior)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` (null texts stay null) and tox_score, a double from 0 to 1.

    A column that already bears this name is replaced.
    """
    docs = docs.drop("tox_score")
    schema = StructType([*docs.schema.fields, StructField("tox_score", DoubleType(), False)])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.batches_of(batches):
            values = sigmoid(model.log_odds(common.texts_of(batch)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, "tox_score"]
            )

    return docs.mapInArrow(scored, schema)
