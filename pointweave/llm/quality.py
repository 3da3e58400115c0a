"""Document quality by ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w . x) with ordered thresholds and one weight vector shared by all grades.
x marks which hashed words, runs of symbols and shape bins a text holds. The model is fitted on a bounded sample of
rated documents; every document is then scored by expected grade and tail probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from pointweave.llm.tables import limit_batches, table
from pointweave.llm.words import plain_words, utf8

#: Rated documents that the fit uses at most, those with the least hash of their id.
FIT_ROWS = 8_000
#: Buckets of hashed features; few words share one.
BUCKETS = 1 << 26
#: Features seen in fewer documents of the sample than this share of it (and than 3) are left out.
LEAST_SHARE = 0.002
#: Features whose documents' mean grade lies fewer standard errors than this from the sample's mean are left out.
LEAST_Z = 4.0
L2 = 1e-5
STEPS = 300
#: Selected: at least this grade with at least this probability.
KEEP_GRADE = 2
KEEP_PROBABILITY = 0.5

_SYMBOLS = re.compile(r"[^\w\s]{2,}|(.)\1{3,}")
#: First letters of a word that count as a feature of their own: inflected and compounded forms share them.
PREFIX_BYTES = (4, 5)


def shape_features(text: str, words: list[bytes], distinct: int) -> list[str]:
    """Bins of length, of the shares of upper case, symbols, digits and distinct words and lines, and the text's symbol runs."""
    n = max(len(text), 1)
    letters = sum(map(str.isalpha, text)) or 1
    upper = sum(map(str.isupper, text)) / letters
    symbols = 1 - (letters + text.count(" ") + text.count("\n")) / n
    lines = text.split("\n")
    out = [
        f"length:{min(len(words), 1 << 16).bit_length()}",
        f"upper:{round(10 * upper)}",
        f"symbols:{round(20 * max(symbols, 0))}",
        f"distinct:{round(10 * distinct / max(len(words), 1))}",
        f"lines:{round(10 * len(set(lines)) / len(lines))}",
        f"mean:{round(min(n / max(len(words), 1), 40))}",
    ]
    runs = {m.group(0)[:4] for m in _SYMBOLS.finditer(text)}
    return out + [f"run:{r}" for r in runs]


def features(text: str | None) -> np.ndarray:
    """Sorted distinct buckets of a text; a null or empty text has those of its shape only."""
    text = text or ""
    words = plain_words(text)
    distinct = set(words)
    shape = [xxh64_intdigest(utf8(f), 1) for f in shape_features(text, words, len(distinct))]
    starts = [xxh64_intdigest(w, n) for n in PREFIX_BYTES for w in {w[:n] for w in distinct if len(w) > n}]
    return np.unique(np.array([xxh64_intdigest(w) for w in distinct] + starts + shape, np.uint64) % np.uint64(BUCKETS)).astype(np.int32)


@dataclass
class OrdinalModel:
    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    @property
    def grades(self) -> int:
        return len(self.thresholds) + 1

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1.. in columns."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    def score(self, found: np.ndarray) -> float:
        at = np.searchsorted(self.buckets, found)
        at[at == len(self.buckets)] = 0
        return float(self.weights[at[self.buckets[at] == found]].sum()) if len(self.buckets) else 0.0


def fit_ordinal(
    rows: list[np.ndarray], grades: np.ndarray, n_grades: int, l2: float = L2, steps: int = STEPS, least_share: float = LEAST_SHARE, least_z: float = LEAST_Z
) -> OrdinalModel:
    """Penalised maximum likelihood by Adam on the whole sample; thresholds are a first one and positive gaps."""
    n = len(rows)
    flat = np.concatenate(rows) if n else np.empty(0, np.int32)
    buckets, index, seen = np.unique(flat, return_inverse=True, return_counts=True)
    total = np.bincount(index, weights=np.repeat(grades, [len(r) for r in rows]), minlength=len(buckets))
    z = np.abs(total / np.maximum(seen, 1) - (grades.mean() if n else 0)) * np.sqrt(seen) / max(grades.std() if n else 0, 1e-9)
    keep = (seen >= max(3, least_share * n)) & (z >= least_z)
    place = np.where(keep, np.cumsum(keep) - 1, -1)[index]
    row = np.repeat(np.arange(n), [len(r) for r in rows])[place >= 0]
    column = place[place >= 0]
    buckets = buckets[keep]
    w = np.zeros(len(buckets))
    share = np.array([(grades > k).mean() for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    first = np.log((1 - share) / share)
    cuts = np.concatenate([first[:1], np.log(np.diff(first).clip(1e-2))])
    moments = [np.zeros(len(w) + len(cuts)) for _ in range(2)]
    for step in range(1, steps + 1):
        gaps = np.exp(cuts[1:])
        theta = np.concatenate([cuts[:1], cuts[0] + np.cumsum(gaps)])
        s = np.bincount(row, weights=w[column], minlength=n)
        bounds = np.concatenate([[-np.inf], theta, [np.inf]])
        up, down = (1 / (1 + np.exp(-np.clip(bounds[grades + i] - s, -60, 60))) for i in (1, 0))
        p = np.maximum(up - down, 1e-12)
        slope_up, slope_down = up * (1 - up), down * (1 - down)
        ds = (slope_up - slope_down) / p / n  # of the mean negative log-likelihood
        dw = np.bincount(column, weights=ds[row], minlength=len(w)) + l2 * w
        dtheta = np.array([(-(slope_up * (grades == k)) / p + slope_down * (grades == k + 1) / p).sum() / n for k in range(n_grades - 1)])
        after = np.cumsum(dtheta[::-1])[::-1]
        gradient = np.concatenate([dw, after[:1], after[1:] * gaps])
        for m, power, value in ((0, 0.9, gradient), (1, 0.999, gradient * gradient)):
            moments[m] = power * moments[m] + (1 - power) * value
        move = 0.1 * min(1.0, 2 * (1 - step / (steps + 1))) * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-8)
        w -= move[: len(w)]
        cuts -= move[len(w) :]
    theta = np.concatenate([cuts[:1], cuts[0] + np.cumsum(np.exp(cuts[1:]))])
    return OrdinalModel(buckets, w, theta)


def fit(docs: DataFrame, ratings: DataFrame, n_grades: int, fit_rows: int = FIT_ROWS) -> OrdinalModel | None:
    """A model from ratings (doc_id, grade 0..n_grades-1) of docs; None without rated documents.

    The sample, at most fit_rows documents, is the only data that comes to the driver, as feature buckets. Of the
    ratings of one id the lowest counts, and of its texts the first in binary order, so that repeated rows do not add to it.
    """
    rated = ratings.filter(F.col("doc_id").isNotNull() & F.col("grade").between(0, n_grades - 1)).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"), F.min("text").alias("text"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([features(t) for t in batch.column(2).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), found], names=["doc_id", "grade", "features"])

    limit_batches(docs.sparkSession)
    rows = texts.mapInArrow(read, "doc_id long, grade int, features array<int>").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by("doc_id")
    lists = rows["features"].combine_chunks()
    return fit_ordinal(np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1]), rows["grade"].to_numpy(), n_grades)


def _scores(model: OrdinalModel | None, batch_texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    if model is None:
        return np.zeros(len(batch_texts)), np.ones((len(batch_texts), KEEP_GRADE))
    score = np.array([model.score(features(t)) for t in batch_texts])
    return score, model.tails(score)


def with_quality(docs: DataFrame, model: OrdinalModel | None, keep_grade: int = KEEP_GRADE, keep_probability: float = KEEP_PROBABILITY) -> DataFrame:
    """One row per row of docs: doc_id, expected_grade, p_keep (probability of keep_grade or more), kept.

    Null and empty texts are scored by their shape; null ids and repeated rows are scored like others; without a
    model (nothing rated) every document is kept. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, tails = _scores(model, batch.column(1).to_pylist())
            p = tails[:, keep_grade - 1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tails.sum(axis=1)), pa.array(p), pa.array(p >= keep_probability)], names=["doc_id", "expected_grade", "p_keep", "kept"])

    limit_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(rate, f"doc_id {kind}, expected_grade double, p_keep double, kept boolean")


def selected(docs: DataFrame, model: OrdinalModel | None, keep_grade: int = KEEP_GRADE, keep_probability: float = KEEP_PROBABILITY) -> DataFrame:
    """The rows of docs that the model keeps, all their columns as they were, without a join."""
    if model is None:
        return docs
    at = docs.columns.index("text")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, tails = _scores(model, batch.column(at).to_pylist())
            yield batch.filter(pa.array(tails[:, keep_grade - 1] >= keep_probability))

    limit_batches(docs.sparkSession)
    return docs.mapInArrow(choose, docs.schema)


def graded(labels: DataFrame) -> DataFrame:
    """Ratings from the label table: 0 poor, 1 good but toxic, 2 good and clean; rows with a null label are left out."""
    return labels.filter("quality is not null and toxic is not null").select(
        "doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade")
    )


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> OrdinalModel | None:
    return fit(docs, graded(table(spark, sf_dir, "labels")), 3)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return with_quality(docs, fitted(spark, docs, sf_dir))
