"""Quality classifier by positive-unlabelled learning.

A linear model with the logistic loss minimises the non-negative unbiased risk

    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-))

over trusted positives (P) and unlabelled texts (U).  The class prior is estimated
from P and U alone: a plain P-against-U model is fitted on two thirds of both, and
on the last third the smallest ratio of the shares of U and P above a score, with
a confidence margin, is the share of positives in U.

Features are the frequencies of pairs of byte classes over the whole text, how many
words repeat the one before them, how many are distinct, and the logarithmic
length: nothing but the text.

The fit uses bounded samples, chosen by a hash of the id: at most
``Parameters.positives`` trusted and ``Parameters.unlabelled`` texts.  All texts
are scored.

Defined results: null and empty texts have the features of an empty text and get a
score like any other.  A doc_id labelled both 1 and 0, or with a null label, is no
trusted positive; labels of unknown documents and null ids are ignored.  Without positives or
unlabelled texts nothing can be learnt: every score is 0.5.  Repeated rows are each
scored, alike.  A null id is not held out and never learnt from.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmine.llm import textkit
from tiltmine.llm.shared import only

CLASSES = 16
PAIRS = CLASSES * CLASSES
WIDTH = PAIRS + 3


def _classes() -> np.ndarray:
    table = np.full(256, 15, dtype=np.int64)
    for group, members in enumerate(
        [b"aeiouy", b"bcdfghjklmnpqrstvwxz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\n\v\f\r", b".", b",;:", b"!?", b"|", b"#$%&*@^~", b"\"'()[]{}-`", b"_=+/<>\\"]
    ):
        table[list(members)] = group
    table[0xC0:] = 13
    table[0x80:0xC0] = 14
    return table


_CLASS = _classes()


def features(column: pa.Array) -> np.ndarray:
    """Square roots of the frequencies of class pairs, of repeats and of distinct words, and the logarithmic length: float32 (rows, WIDTH)."""
    data, offs = textkit.utf8(column)
    rows = len(offs) - 1
    out = np.zeros((rows, WIDTH), np.float32)
    kind = _CLASS[data]
    if len(kind) > 1:
        pair = kind[:-1] * CLASSES + kind[1:]
        row = np.repeat(np.arange(rows), np.diff(offs))
        same = row[:-1] == row[1:]
        counts = np.bincount(row[:-1][same] * PAIRS + pair[same], minlength=rows * PAIRS).reshape(rows, PAIRS)
        out[:, :PAIRS] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
        word, woffs = textkit.words(data, offs)
        total = np.maximum(np.diff(woffs), 1)
        owner = np.repeat(np.arange(rows), np.diff(woffs))
        again = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
        out[:, PAIRS] = np.sqrt(np.bincount(owner[1:][again], minlength=rows) / total)
        _, _, kept = textkit.distinct(word >> np.uint64(12), woffs, 52)
        out[:, PAIRS + 1] = np.sqrt(np.diff(kept) / total)
    out[:, -1] = np.log1p(np.diff(offs)) / 10
    return out


@dataclass(frozen=True)
class Parameters:
    positives: int = 12_000
    unlabelled: int = 12_000
    steps: int = 300
    rate: float = 0.05
    decay: float = 1e-4
    threshold: float = 0.3


@dataclass
class Model:
    mean: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH, np.float32))
    scale: np.ndarray = field(default_factory=lambda: np.ones(WIDTH, np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(WIDTH, np.float32))
    bias: float = 0.0
    prior: float = 0.5

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (((x - self.mean) / self.scale) @ self.weights + self.bias).astype(np.float64)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def _softplus_slope(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _descend(p: np.ndarray, u: np.ndarray, steps: int, rate: float, decay: float, slopes) -> tuple[np.ndarray, float]:
    """Adam on whole samples; ``slopes(zp, zu)`` are the slopes of the risk by each margin."""
    w = np.zeros(p.shape[1] + 1)
    m = v = np.zeros_like(w)
    for t in range(1, steps + 1):
        own = w[:-1].astype(np.float32)
        gp, gu = slopes(p @ own + w[-1], u @ own + w[-1])
        g = np.append(gp.astype(np.float32) @ p + gu.astype(np.float32) @ u + decay * w[:-1], gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(sp: np.ndarray, su: np.ndarray, margin: float = 0.05) -> float:
    """Share of positives in U, from scores that neither sample was fitted on."""
    cuts = np.unique(sp)
    above_p = 1 - np.searchsorted(np.sort(sp), cuts, side="left") / len(sp)
    above_u = 1 - np.searchsorted(np.sort(su), cuts, side="left") / len(su)
    slack = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(len(su)) + 1 / np.sqrt(len(sp)))
    ok = above_p > 0
    best = np.argmin((above_u[ok] + slack) / above_p[ok])
    return float(np.clip(above_u[ok][best] / above_p[ok][best], margin, 1 - margin))


def fit(p: np.ndarray, u: np.ndarray, parameters: Parameters = Parameters()) -> Model:
    if not len(p) or not len(u):
        return Model()
    both = np.concatenate([p, u])
    mean, scale = both.mean(axis=0), both.std(axis=0)
    scale = np.where(scale > 1e-4, scale, 1).astype(np.float32)
    p, u = (p - mean) / scale, (u - mean) / scale
    fit_p, fit_u = np.arange(len(p)) % 3 > 0, np.arange(len(u)) % 3 > 0
    prior = 0.5
    if fit_p.sum() and fit_u.sum() and (~fit_p).sum() and (~fit_u).sum():
        a, b = p[fit_p], u[fit_u]
        w, c = _descend(a, b, parameters.steps // 2, parameters.rate, 1e-3, lambda zp, zu: (-_softplus_slope(-zp) / len(a), _softplus_slope(zu) / len(b)))
        prior = estimate_prior(p[~fit_p] @ w + c, u[~fit_u] @ w + c)

    def slopes(zp: np.ndarray, zu: np.ndarray):
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        up = -prior * _softplus_slope(-zp) / len(zp)
        rest_p, rest_u = -prior * _softplus_slope(zp) / len(zp), _softplus_slope(zu) / len(zu)
        if negative >= 0:
            return up + rest_p, rest_u
        return -rest_p, -rest_u  # the part that cannot be negative is driven back

    w, b = _descend(p, u, parameters.steps, parameters.rate, parameters.decay, slopes)
    return Model(mean.astype(np.float32), scale, w.astype(np.float32), b, prior)


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _sample_features(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of the texts of a bounded number of ids."""

    @textkit.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.tobytes() for x in features(batch.column("text"))], pa.binary())], names=["doc_id", "x"])

    rows = docs.join(F.broadcast(ids), "doc_id", "left_semi").mapInArrow(run, "doc_id long, x binary")
    rows = rows.groupBy("doc_id").agg(F.min("x").alias("x")).orderBy("doc_id").collect()  # repeated rows count once
    return np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(-1, WIDTH)


def train(docs: DataFrame, labels: DataFrame, parameters: Parameters = Parameters()) -> Model:
    docs, labels = only(docs, "doc_id", "text"), only(labels, "doc_id", "quality")
    fitted = lambda df: df.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = fitted(docs.select("doc_id")).distinct()
    trusted = fitted(labels).groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("quality")).where("quality = 1").select("doc_id")
    trusted = trusted.join(known, "doc_id", "left_semi")
    first = lambda df, most: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return fit(_sample_features(docs, first(trusted, parameters.positives)), _sample_features(docs, first(known, parameters.unlabelled)), parameters)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every whole text."""

    @textkit.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(features(batch.column("text"))))], names=["doc_id", "score"])

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, parameters: Parameters = Parameters()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    out = scored(docs, train(docs, labels, parameters))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= parameters.threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, parameters: Parameters = Parameters()) -> DataFrame:
    """The rows of ``docs``, all columns, that are predicted to be good."""
    model = train(docs, labels, parameters)
    at = docs.columns.index("text")
    schema = docs.schema

    @textkit.trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textkit.chunks(batches):
            yield batch.filter(pa.array(model.score(features(batch.column(at))) >= parameters.threshold))

    return docs.mapInArrow(run, schema)
