"""Quality scores from random Fourier features, ridge regression and isotonic calibration.

Every text becomes a short vector of statistics. Random Fourier features (Rahimi and
Recht, 2007) turn a Gaussian kernel on them into a linear model, whose normal equations
are sums over partitions: each task adds its part, so all labelled rows train it. The
ridge scores are calibrated by pooling adjacent violators over a fixed grid of scores.

Defined results: a null or empty text has zero statistics and a score like any other;
repeated rows score alike; ties share their grid cell; extra columns are ignored; an
empty table gives an empty result; without labels every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nascent.llm.common import bounded_batches, clean_text

STATISTICS = (
    "log_chars log_words word_mean word_long upper digit space symbol punctuation stop bar bang "
    "non_ascii line_mean line_repeat word_distinct end_mark capital_lines longest_run short_words"
).split()


@dataclass(frozen=True)
class QualitySettings:
    features: int = 256
    width: float = 4.0
    ridge: float = 1e-2
    cells: int = 1024
    groups: int = 32
    seed: int = 11


def _byte_classes() -> np.ndarray:
    """Class of every byte: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 symbol, 6 punctuation,
    7 full stop, 8 bar, 9 exclamation mark, 10 first byte of a longer character, 11 its rest."""
    kind = np.zeros(256, dtype=np.uint8)
    kind[97:123], kind[65:91], kind[48:58] = 1, 2, 3
    kind[[9, 10, 11, 12, 13, 32]] = 4
    kind[[ord(c) for c in "#$%&*+/<=>@\\^_`{}~[]"]] = 5
    kind[[ord(c) for c in ",;:-'\"()?"]] = 6
    kind[ord(".")], kind[ord("|")], kind[ord("!")] = 7, 8, 9
    kind[192:], kind[128:192] = 10, 11
    return kind


BYTE_CLASS = _byte_classes()


def statistics(text: str) -> list[float]:
    """The numbers of ``STATISTICS`` for one text, from all of it."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if not len(raw):
        return [0.0] * len(STATISTICS)
    kinds = BYTE_CLASS[raw]
    count = np.bincount(kinds, minlength=12).astype(float)
    chars = len(raw) - count[11]
    words = text.split()
    n_words = max(1, len(words))
    lines = [line for line in text.split("\n") if line.strip()]
    n_lines = max(1, len(lines))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    letters = max(1.0, count[1] + count[2] + count[10])
    changes = np.flatnonzero(np.diff(raw)) + 1
    runs = np.diff(np.concatenate(([0], changes, [len(raw)])))
    return [
        float(np.log1p(chars)),
        float(np.log1p(len(words))),
        float(min(lengths.mean(), 50)) if len(lengths) else 0.0,
        float((lengths > 15).sum() / n_words),
        count[2] / letters,
        count[3] / chars,
        count[4] / chars,
        count[5] / chars,
        count[6] / chars,
        count[7] / n_words,
        count[8] / n_words,
        count[9] / n_words,
        count[10] / chars,
        float(np.log1p(len(words) / n_lines)),
        1 - len(set(lines)) / n_lines,
        len(set(words)) / n_words,
        sum(line.rstrip()[-1] in ".!?\"" for line in lines) / n_lines,
        sum(line[0].isupper() for line in lines) / n_lines,
        float(np.log1p(runs.max())),
        float((lengths <= 2).sum() / n_words),
    ]


def with_statistics(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, stats array<double>)``, one row per row of ``docs``; no shuffle."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t) for t in texts])

    return docs.select(F.col(id_col), measure(clean_text(text_col)).alias("stats"))


@dataclass(frozen=True)
class QualityModel:
    """Standardisation, projection, ridge weights and the calibration steps."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    low: float
    high: float
    steps: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(z), 1))])

    def cells(self, raw: np.ndarray) -> np.ndarray:
        share = (raw - self.low) / max(self.high - self.low, 1e-12)
        return np.clip((share * len(self.steps)).astype(int), 0, len(self.steps) - 1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=float).reshape(-1, len(STATISTICS))


def _moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every statistic; one aggregate over all rows."""
    found = rows.select(
        *(F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(len(STATISTICS))),
        *(F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(len(STATISTICS))),
    ).first()
    numbers = np.array([0.0 if v is None else v for v in found], dtype=float)
    mean, deviation = np.split(numbers, 2)
    return mean, np.where(deviation > 1e-9, deviation, 1.0)


def _normal_equations(rows: DataFrame, model: QualityModel, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y over all rows, summed per task, then in a tree, then on the driver.

    A part is one row of (features + 1)² numbers, whatever the number of rows; tasks without
    rows send none. Each of three levels leaves ``groups`` times fewer sums, so that a million
    tasks meet in groups of about 32, and the driver adds at most ``groups`` sums.
    """
    size = model.directions.shape[1] + 1

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, seen, filled = np.zeros((size, size + 1)), 0, False
        for batch in batches:
            if len(batch):
                z = model.features(_matrix(batch["stats"]))
                total += z.T @ np.hstack([z, batch[["y"]].to_numpy(dtype=float)])
                seen = int(batch["spread"].iloc[0])
                filled = True
        if filled:
            yield pd.DataFrame({"g": [seen], "total": [total.astype("<f8").tobytes()]})

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(p, dtype="<f8") for p in parts["total"])
        return pd.DataFrame({"g": parts["g"].iloc[:1], "total": [total.tobytes()]})

    given = rows.select("stats", "y", F.spark_partition_id().alias("spread"))
    parts = given.mapInPandas(part, "g int, total binary")
    for level in (3, 2, 1):
        parts = parts.withColumn("g", F.pmod("g", F.lit(groups**level)))
        parts = parts.groupBy("g").applyInPandas(add, "g int, total binary")
    summed = parts.collect()
    total = sum((np.frombuffer(r["total"], dtype="<f8") for r in summed), np.zeros(size * (size + 1)))
    total = total.reshape(size, size + 1)
    return total[:, :size], total[:, size]


def pool_adjacent(sums: np.ndarray, counts: np.ndarray, start: float) -> np.ndarray:
    """Non-decreasing means by pooling adjacent violators; cells without rows take a neighbour's."""
    blocks: list[list[float]] = []
    for i in np.flatnonzero(counts):
        blocks.append([sums[i], counts[i], i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, count, _ = blocks.pop()
            blocks[-1][0] += total
            blocks[-1][1] += count
    if not blocks:
        return np.full(len(counts), start)
    firsts = np.array([b[2] for b in blocks])
    means = np.array([b[0] / b[1] for b in blocks])
    return means[np.maximum(np.searchsorted(firsts, np.arange(len(counts)), side="right") - 1, 0)]


def train(rows: DataFrame, settings: QualitySettings | None = None) -> QualityModel:
    """Fit on ``(stats, y)`` rows with y 0 or 1. Rows are read three times, so pass a settled table."""
    settings = settings or QualitySettings()
    random = np.random.default_rng(settings.seed)
    mean, scale = _moments(rows)
    model = QualityModel(
        mean,
        scale,
        random.normal(size=(len(STATISTICS), settings.features)) / settings.width,
        random.uniform(0, 2 * np.pi, settings.features),
        np.zeros(settings.features + 1),
        0.0,
        1.0,
        np.full(settings.cells, 0.5),
    )
    left, right = _normal_equations(rows, model, settings.groups)
    count = left[-1, -1]
    if not count:
        return model
    penalty = np.full(len(left), settings.ridge * count / settings.features)
    penalty[-1] = 1e-9
    weights = np.linalg.solve(left + np.diag(penalty), right)
    model = QualityModel(mean, scale, model.directions, model.phases, weights, -0.5, 1.5, model.steps)
    scored = rows.select("y", _cell_column(model)(F.col("stats")).alias("cell"))
    cells = scored.groupBy("cell").agg(F.sum("y").alias("hits"), F.count("*").alias("n")).collect()
    sums, counts = np.zeros(settings.cells), np.zeros(settings.cells)
    for cell in cells:
        sums[cell["cell"]], counts[cell["cell"]] = cell["hits"], cell["n"]
    steps = pool_adjacent(sums, counts, 0.5)
    return QualityModel(mean, scale, model.directions, model.phases, weights, -0.5, 1.5, steps)


def _cell_column(model: QualityModel):
    @F.pandas_udf("int")
    def cell(stats: pd.Series) -> pd.Series:
        return pd.Series(model.cells(model.features(_matrix(stats)) @ model.weights))

    return cell


def score_column(model: QualityModel, stats: Column) -> Column:
    """The calibrated score of a column of statistics."""

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        raw = model.features(_matrix(values)) @ model.weights
        return pd.Series(model.steps[model.cells(raw)])

    return score(stats)
