"""Toxicity severity by cumulative-link ordinal regression.

The features of a text are its distinct lower-cased words and their beginnings of three to seven letters. One weight
vector serves all thresholds: P(grade > k) = sigmoid(w . x - t_k) with t_0 <= t_1 <= t_2, fitted by maximum
likelihood of the grades with an L1 penalty. The output is the expected severity, the sum of P(grade > k).

The labels say only toxic or not, so training grades are made: 0 for rows labelled 0; a row labelled 1 gets 1, 2
or 3 by the tertile of the share of its features that are markers (features over-represented among rows
labelled 1). Other graded labels can be given in a ``grade`` column.

The thresholds are then shifted together so that P(grade > 0) is one half where the sample's classes part best.

The fit uses a bounded sample of labelled rows (``sample_rows`` of each class, picked by the hash of doc_id);
scoring covers every row and whole texts.

Defined results: null or empty text has no features, so its severity is what the thresholds give; without both
classes among the labelled rows nothing is learned and every severity is 0; rows with null labels or null doc_id
teach nothing; repeated documents count once in training and are scored each; very long texts count whole, each word
once; of equally likely grades the lowest is named, and of equal hashes the smaller doc_id comes into the sample first; an
empty table gives no rows; a column named ``toxicity`` is replaced, others may have any names.

Scale: scoring is a column of the scan. What reaches the driver comes from the sample alone: at most ``sample_rows`` rows of
each class, with the features that tell the classes apart, which three or more of these rows hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lawmill.llm.memory import give_back
from lawmill.session import materialise, small

SAMPLE_ROWS = 2500
LEAST_ROWS = 4
LEAST_RATIO = 4.0
GRADES = 4
WORD = re.compile(r"\w+")
PREFIXES = (3, 4, 5, 6, 7)
SCORE = T.StructType(
    [
        T.StructField("severity", T.DoubleType()),
        T.StructField("grade", T.IntegerType()),
        T.StructField("toxic_probability", T.DoubleType()),
    ]
)


def word_features(word: str) -> list[int]:
    """Signed 64-bit ids of a word and of its beginnings."""
    names = [word] + [f"{word[:n]}*" for n in PREFIXES if len(word) >= n]
    return [xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - 2**63 for x in names]


def text_words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass
class Model:
    """Weights by feature id and the thresholds; no thresholds: nothing learned."""

    weights: dict[int, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


def fit_ordinal(row: np.ndarray, column: np.ndarray, n_columns: int, grade: np.ndarray, l1: float = 0.0005, steps: int = 400):
    """Weights and thresholds of the cumulative-link model, by accelerated proximal steps on the mean log-likelihood.

    ``row`` and ``column`` list the ones of the 0/1 feature matrix.
    """
    n, levels = len(grade), int(grade.max())
    weights, momentum = np.zeros(n_columns), np.zeros(n_columns)
    share = np.array([(grade > k).mean() for k in range(levels)]).clip(1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(np.log((1 - share) / share) + 1e-3 * np.arange(levels))
    # each feature has its own step, by how many rows hold it; a row's number of features bounds the rest
    width = max(1.0, np.bincount(row, minlength=n).mean())
    step = 4.0 / (np.bincount(column, minlength=n_columns) / n * width + 1e-2)
    for turn in range(1, steps + 1):
        ahead = weights + (turn - 1) / (turn + 2) * momentum
        score = np.bincount(row, ahead[column], n)
        low = np.r_[-np.inf, cuts][grade]
        high = np.r_[cuts, np.inf][grade]
        below, above = _sigmoid(score - low), _sigmoid(score - high)
        inside = np.maximum(below - above, 1e-9)
        d_low, d_high = below * (1 - below), above * (1 - above)
        slope = (d_low - d_high) / inside
        pull = np.bincount(column, slope[row], n_columns) / n
        new = ahead + step * pull
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        momentum, weights = new - weights, new
        moves = np.array([(d_high / inside)[grade == k].sum() - (d_low / inside)[grade == k + 1].sum() for k in range(levels)]) / n
        cuts = np.maximum.accumulate(cuts + 2.0 * moves)
    return weights, cuts


def _best_cut(scores: np.ndarray, toxic: np.ndarray, clean_weight: float = 10.0) -> float:
    """The score that parts the classes best, a clean row above it costing more; the middle of a tie."""
    order = np.argsort(scores, kind="stable")
    x, y = scores[order], toxic[order]
    gain = clean_weight * np.r_[0, np.cumsum(~y)] / (~y).sum() - np.r_[0, np.cumsum(y)] / y.sum()
    gain[1:-1][x[1:] <= x[:-1]] = -np.inf
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    ends = np.r_[x[0] - 1, x, x[-1] + 1]
    first = best[0]
    last = first
    while last + 1 in best:
        last += 1
    return float(ends[first] + ends[last + 1]) / 2


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """doc_id, toxic (and grade), features of the sampled labelled rows; at most ``sample_rows`` of each class."""
    graded = ["grade"] if "grade" in labels.columns else []
    kept = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").select(
        F.col("doc_id").alias("_id"), (F.col("toxic") > 0).cast("int").alias("toxic"), *graded
    )
    parts = [
        kept.filter(F.col("toxic") == side).dropDuplicates(["_id"]).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows) for side in (0, 1)
    ]
    picked = F.broadcast(parts[0].unionByName(parts[1]))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({f for w in text_words(t) for f in word_features(w)}) for t in texts], dtype=object)

    rows = docs.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("_id")).select("doc_id", "toxic", *graded, features(F.col("text")).alias("features"))
    columns = [F.first(c).alias(c) for c in ("toxic", *graded)]
    return rows.groupBy("doc_id").agg(*columns, F.max("features").alias("features"))


def _training_rows(docs: DataFrame, labels: DataFrame, sample_rows: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The sampled rows with their telling features and number of features, and the telling features with their counts.

    A feature tells if at least three rows hold it and its share of rows differs between the classes by three standard
    errors and by a factor. The factor keeps out common words, whose shares differ only because one class has longer texts.
    """
    sample = materialise(_sample(docs, labels, sample_rows))
    n = {row["toxic"]: row["count"] for row in sample.groupBy("toxic").count().collect()}
    if min(n.get(0, 0), n.get(1, 0)) < LEAST_ROWS:
        return pd.DataFrame(), pd.DataFrame()
    each = sample.select("doc_id", "toxic", F.explode("features").alias("feature"))
    counts = each.groupBy("feature").agg(F.sum("toxic").alias("held"), F.sum(1 - F.col("toxic")).alias("held_clean"))
    share = (F.col("held") + F.col("held_clean")) / (n[0] + n[1])
    gap = (F.col("held") + 0.5) / (n[1] + 1) - (F.col("held_clean") + 0.5) / (n[0] + 1)
    error = F.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1])) + 1e-12
    ratio = ((F.col("held") + 0.5) / (n[1] + 1)) / ((F.col("held_clean") + 0.5) / (n[0] + 1))
    marked = (F.abs(gap) / error >= 3) & (F.greatest(ratio, 1 / ratio) >= LEAST_RATIO)
    telling = counts.filter(marked & (F.col("held") + F.col("held_clean") >= 3)).toPandas().sort_values("feature")
    ids = docs.sparkSession.createDataFrame(telling[["feature"]]) if len(telling) else each.select("feature").limit(0)
    held = each.join(small(ids, 1_000_000), "feature").groupBy("doc_id").agg(F.collect_list("feature").alias("told"))
    rows = sample.withColumn("n_features", F.size("features")).drop("features").join(held, "doc_id", "left")
    return rows.toPandas().sort_values("doc_id").reset_index(drop=True), telling.reset_index(drop=True)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Model from documents and their labels (doc_id, toxic 0/1, optionally grade 0, 1, ...)."""
    rows, telling = _training_rows(docs, labels, sample_rows)
    if not len(rows):
        return Model()
    toxic = rows["toxic"].to_numpy() > 0
    told = [[] if x is None else x for x in rows["told"]]
    row = np.repeat(np.arange(len(rows)), [len(x) for x in told])
    ids = telling["feature"].to_numpy(np.int64)
    column = np.searchsorted(ids, np.array([f for x in told for f in x], np.int64))
    rate = [(telling[name].to_numpy(float) + 0.5) / (n + 1) for name, n in (("held_clean", (~toxic).sum()), ("held", toxic.sum()))]
    markers = rate[1] >= 10 * rate[0]
    if "grade" in rows:
        grade = rows["grade"].fillna(0).to_numpy(np.int64)
    else:
        density = np.bincount(row, markers[column], len(rows)) / np.maximum(rows["n_features"].to_numpy(), 1)
        edges = np.quantile(density[toxic], [1 / 3, 2 / 3])
        grade = np.where(toxic, 1 + (density > edges[0]) + (density > edges[1]), 0)
    # dense grades: a level that no row has can't place its threshold
    levels, grade = np.unique(grade, return_inverse=True)
    if len(levels) < 2:
        return Model()
    weights, cuts = fit_ordinal(row, column, len(ids), grade)
    # the thresholds keep their distances; the lowest moves to where the classes part best
    cuts = cuts + _best_cut(np.bincount(row, weights[column], len(rows)), grade > 0) - cuts[0]
    return Model({int(f): float(w) for f, w in zip(ids, weights) if w}, [float(c) for c in cuts])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` plus ``toxicity``: struct of severity, grade (most likely), toxic_probability = P(grade > 0).

    A column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SCORE)
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights, cuts = shared.value.weights, np.array(shared.value.thresholds)

        class Known(dict):
            def __missing__(self, word: str) -> float:
                if len(self) > 200_000:
                    self.clear()
                value = self[word] = sum(weights.get(f, 0.0) for f in word_features(word))
                return value

        known = Known()
        for texts in batches:
            total = np.array([sum(map(known.__getitem__, text_words(t))) for t in texts], float)
            if not len(cuts):
                zero = np.zeros(len(total))
                yield pd.DataFrame({"severity": zero, "grade": zero.astype(np.int32), "toxic_probability": zero})
                continue
            over = _sigmoid(total[:, None] - cuts[None, :])
            each = np.diff(np.c_[np.zeros(len(total)), 1 - over, np.ones(len(total))], axis=1)
            yield pd.DataFrame(
                {"severity": over.sum(axis=1), "grade": each.argmax(axis=1).astype(np.int32), "toxic_probability": over[:, 0]}
            )
        known.clear()
        give_back()

    return docs.withColumn("toxicity", scores(F.col("text")))
