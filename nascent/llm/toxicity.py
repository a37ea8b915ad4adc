"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts and unlabelled texts are all the classifier sees; texts labelled
clean are part of the unlabelled ones. Its risk is corrected by the class prior, and the
negative part is kept from falling below zero (Kiryo et al., 2017), so that a flexible
model cannot earn a negative risk by overfitting the unlabelled texts. Last, the intercept
is lowered where the mean score of the unlabelled texts is above ``slack`` times the prior.

A text is the set of its lower-cased words. Every word gives four hashed features: itself
and its first four, five and six letters. The score is linear in them, so a word has one
weight, which is looked up once per distinct word; whole texts are read, long ones too.

Defined results: a null or empty text has no words and gets the score of the intercept;
repeated rows are scored alike; ties and extra columns play no part; an empty table gives
an empty result; without a toxic training row every score is the prior (0 if unknown).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nascent.llm.common import bounded_batches, clean_text

DIMS = 1 << 20
WORD = re.compile(r"\w+")
CACHED_WORDS = 400_000


@dataclass(frozen=True)
class ToxicitySettings:
    """``positives`` and ``unlabelled`` bound the rows the classifier is fitted on."""

    positives: int = 1_500
    unlabelled: int = 4_500
    features: int = 1_024
    min_rows: int = 3
    min_evidence: float = 4.0
    epochs: int = 300
    rate: float = 0.05
    ridge: float = 1e-3
    slack: float = 1.5


@dataclass(frozen=True)
class ToxicityModel:
    """Hashed features in rising order, their weights and the intercept."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float


def word_slots(word: str) -> tuple[int, ...]:
    """The feature slots of a lower-cased word."""
    forms = {word, *(word[:n] + "~" for n in (4, 5, 6) if len(word) >= n)}
    return tuple(zlib.crc32(form.encode("utf-8", "surrogatepass")) % DIMS for form in forms)


def text_slots(text: str) -> np.ndarray:
    """The distinct feature slots of a text, sorted."""
    slots = {s for word in set(WORD.findall(text.lower())) for s in word_slots(word)}
    return np.array(sorted(slots), dtype=np.int32)


def _chosen(docs: DataFrame, id_col: str, limit: int) -> DataFrame:
    """At most ``limit`` ids, by hash order; only the id column is read."""
    order = F.xxhash64(F.col(id_col), F.lit("fit"))
    return docs.select(id_col).distinct().orderBy(order, F.col(id_col)).limit(limit)


def training_rows(
    docs: DataFrame,
    toxic_ids: DataFrame,
    settings: ToxicitySettings,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> pd.DataFrame:
    """``(positive, slots)`` of a bounded sample of toxic and of unlabelled rows.

    At most ``positives`` + ``unlabelled`` ids are drawn, and the texts meet them by a
    broadcast join, so no text is shuffled. An id with several rows takes one of them, chosen
    by hash before the shuffle, so that a repeated id costs no more than another.
    """
    bounded_batches(docs.sparkSession)
    known = _chosen(toxic_ids.where(F.col(id_col).isNotNull()), id_col, settings.positives)
    drawn = _chosen(docs.where(F.col(id_col).isNotNull()), id_col, settings.unlabelled)
    ids = known.withColumn("positive", F.lit(1)).unionByName(drawn.withColumn("positive", F.lit(0)))
    # Python ints from here on: the bound above is also the bound of this list.
    pairs = [(r[0], r[1]) for r in ids.collect()]
    small = docs.sparkSession.createDataFrame(pairs, f"{id_col} {dict(docs.dtypes)[id_col]}, positive int")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "positive": batch["positive"],
                    "slots": [text_slots(t).tobytes() for t in batch["text"]],
                }
            )

    texts = docs.select(F.col(id_col), clean_text(text_col).alias("text"))
    rows = texts.join(F.broadcast(small), id_col).select(
        F.col(id_col).cast("string").alias("id"), "positive", "text"
    )
    found = rows.mapInPandas(extract, "id string, positive int, slots binary")
    one = F.min_by("slots", F.xxhash64("slots")).alias("slots")
    return found.groupBy("id", "positive").agg(one).toPandas().sort_values(["positive", "id"])


def fit(rows: pd.DataFrame, prior: float, settings: ToxicitySettings) -> ToxicityModel:
    """Fit the linear classifier on a bounded sample by full-batch Adam.

    Features are kept that are told apart best between toxic and unlabelled rows, by the
    z value of the two shares. ``prior`` is the share of toxic rows among all.
    """
    base = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    empty = ToxicityModel(np.zeros(0, np.int64), np.zeros(0), base)
    positive = rows["positive"].to_numpy() == 1
    n_pos, n_unl = int(positive.sum()), int((~positive).sum())
    if n_pos == 0 or n_unl == 0:
        return empty
    # Row by row, so that nothing beside the rows themselves grows with their words.
    in_pos, in_unl = np.zeros(DIMS, dtype=np.int32), np.zeros(DIMS, dtype=np.int32)
    texts = [np.frombuffer(s, dtype=np.int32) for s in rows["slots"]]
    for known, slots in zip(positive, texts, strict=True):
        (in_pos if known else in_unl)[slots] += 1
    share = (in_pos + in_unl) / (n_pos + n_unl)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_pos + 1 / n_unl))
    evidence = np.where(in_pos >= settings.min_rows, (in_pos / n_pos - in_unl / n_unl) / spread, 0)
    slots = np.flatnonzero(evidence >= settings.min_evidence)
    slots = np.sort(slots[np.argsort(-evidence[slots], kind="stable")[: settings.features]])
    if not len(slots):
        return empty
    place = np.full(DIMS, -1, dtype=np.int32)
    place[slots] = np.arange(len(slots))
    x = np.zeros((len(texts), len(slots)), dtype=np.float32)
    for row, found in enumerate(texts):
        columns = place[found]
        x[row, columns[columns >= 0]] = 1
    weights, bias = _descend(x[positive], x[~positive], prior, base, settings)
    bias += _shift_down(x[~positive] @ weights.astype(np.float32) + bias, min(settings.slack * prior, 1.0))
    return ToxicityModel(slots.astype(np.int64), weights.astype(np.float64), bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _shift_down(margins: np.ndarray, most: float) -> float:
    """What to add so that the mean score of the unlabelled rows is ``most`` at the most.

    With few positives the margins grow while their words hardly occur elsewhere, and the
    corrected risk then lifts the intercept for all texts; this takes that back.
    """
    if _sigmoid(margins).mean() <= most:
        return 0.0
    low, high = -60.0, 0.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (low, middle) if _sigmoid(margins + middle).mean() > most else (middle, high)
    return (low + high) / 2


def _descend(
    pos: np.ndarray, unl: np.ndarray, prior: float, bias: float, settings: ToxicitySettings
) -> tuple[np.ndarray, float]:
    """Minimise prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]), l logistic."""
    size = pos.shape[1]
    theta, first, second = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    theta[-1] = bias
    for step in range(1, settings.epochs + 1):
        weights = theta[:-1].astype(np.float32)  # else the matrices would be copied as doubles
        g_pos, g_unl = pos @ weights + theta[-1], unl @ weights + theta[-1]
        negative = np.logaddexp(0, g_unl).mean() - prior * np.logaddexp(0, g_pos).mean()
        d_pos = -prior * _sigmoid(-g_pos) / len(pos)
        d_neg_pos, d_neg_unl = -prior * _sigmoid(g_pos) / len(pos), _sigmoid(g_unl) / len(unl)
        # Where the corrected negative risk is below zero, step away from it.
        a, b = (d_pos + d_neg_pos, d_neg_unl) if negative >= 0 else (-d_neg_pos, -d_neg_unl)
        slope = a.astype(np.float32) @ pos + b.astype(np.float32) @ unl
        gradient = np.append(slope + settings.ridge * theta[:-1], a.sum() + b.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        unbiased = np.sqrt(second / (1 - 0.999**step)) + 1e-8
        theta -= settings.rate * first / (1 - 0.9**step) / unbiased
    return theta[:-1], float(theta[-1])


def score_column(model: ToxicityModel, text: Column) -> Column:
    """The probability that a text is toxic, as a column expression."""
    weight = dict(zip(model.slots.tolist(), model.weights.tolist(), strict=True))
    bias = model.bias
    cache: dict[str, float] = {}

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            if not text:
                out[i] = bias
                continue
            words = set(WORD.findall(text.lower()))
            if len(cache) > CACHED_WORDS:
                cache.clear()
            seen = set()
            for word in words:
                if word not in cache:
                    cache[word] = tuple(s for s in word_slots(word) if s in weight)
                seen.update(cache[word])
            # Features count once per text; a fixed order makes the sum the same everywhere.
            out[i] = bias + sum(weight[s] for s in sorted(seen))
        return pd.Series(_sigmoid(out))

    return score(text)


def train(
    docs: DataFrame,
    labels: DataFrame,
    settings: ToxicitySettings | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> ToxicityModel:
    """Learn from ``docs`` and the labels of their ids; both are already the training part.

    The prior is the share of toxic rows among the labelled ones, a fair sample of all.
    """
    settings = settings or ToxicitySettings()
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    prior = marks.agg(F.avg((F.col(label_col) == 1).cast("double"))).first()[0] or 0.0
    toxic = marks.where(F.col(label_col) == 1)
    rows = training_rows(docs, toxic, settings, id_col, text_col)
    return fit(rows, prior, settings)
