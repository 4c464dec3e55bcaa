"""Quality classifier: regularised quadratic discriminant over transformed statistics of a text.

Class means and covariances come from moments summed over all labelled rows (no sample); each covariance is shrunk
towards the pooled one and towards a multiple of the identity, and its Cholesky factor is computed once. A score is
the sigmoid of the difference of the classes' Gaussian log densities (Mahalanobis distances through the factors) and log
priors. One pass over the texts makes the statistics, kept as a table; training and scoring read that.
"""

from __future__ import annotations

import string
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import sliced, small, table, written

THRESHOLD = 0.3
#: Broadcast labels up to this number, else join them through a shuffle.
MOST_LABELS = 1_000_000
#: Bytes (a sixth as many words) added to a text's length, so that shares of a very short text aren't extreme.
LEAN = 60
FEATURES = (
    "log_words", "log_word_length", "upper", "digit", "stop_punct", "odd_punct", "bang", "bar", "blank", "non_ascii",
    "distinct_words", "top_word", "next_repeats", "line_words", "distinct_lines",
)

_B = lambda s: np.frombuffer(s.encode(), np.uint8)
_SETS = {
    "upper": _B(string.ascii_uppercase), "digit": _B(string.digits), "stop_punct": _B(".,;:?'\""), "bang": _B("!"), "bar": _B("|"),
    "odd_punct": np.array([b for b in _B(string.punctuation) if chr(b) not in ".,;:?'\"!|-"]), "blank": _B(" \t\n\r"), "non_ascii": np.arange(128, 256),
}


def features(text: str | None) -> list[float]:
    """The statistics of a whole text, logs and square roots of counts and shares. Null, empty and blank: of no words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    by_word = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    share = {k: float(np.sqrt(counts[v].sum() / (len(raw) + LEAN))) for k, v in _SETS.items()}
    repeats = sum(map(str.__eq__, words, words[1:]))
    lean = LEAN / 6
    return [
        np.log(len(words) + lean), np.log((len(raw) + LEAN) / (len(words) + lean)), share["upper"], share["digit"], share["stop_punct"], share["odd_punct"], share["bang"], share["bar"], share["blank"], share["non_ascii"],
        np.log((len(by_word) + lean) / (len(words) + lean)), np.sqrt(max(by_word.values(), default=1) / (len(words) + lean)), np.sqrt(repeats / (len(words) + lean)), np.log((len(words) + lean) / (len(lines) + 1)), (len(set(lines)) + 1) / (len(lines) + 1),
    ]


def measured(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, x array<double>) of every row."""
    kind = df.schema[id].dataType.simpleString()

    def run(batches):
        for b in sliced(batches):
            x = [features(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], [id, "x"])

    return df.select(id, text).mapInArrow(run, f"`{id}` {kind}, x array<double>")


def _moments(batches):
    """Of rows (x, y): for each y the count (i = -1), sums (j = -1) and sums of products of a partition."""
    d = len(FEATURES)
    total = np.zeros((2, d + 1, d + 1))
    for b in batches:
        x, y = np.array(b.column(0).to_pylist(), float).reshape(-1, d), b.column(1).to_numpy(zero_copy_only=False)
        one = np.hstack([np.ones((len(x), 1)), x])
        for k in (0, 1):
            total[k] += one[y == k].T @ one[y == k]
    at = [(k, i, j) for k in (0, 1) for i in range(d + 1) for j in range(d + 1)]
    yield pa.RecordBatch.from_arrays([*(pa.array([t[c] for t in at], pa.int32()) for c in range(3)), pa.array(total.ravel())], ["y", "i", "j", "v"])


class Model:
    """Two Gaussians with shrunk covariances; score() is the probability of class 1."""

    def __init__(self, moments: np.ndarray, to_pooled: float = 0.3, to_identity: float = 0.05):
        n, d = moments[:, 0, 0], moments.shape[1] - 1
        self.only = None if n.all() else (0.5 if not n.any() else float(n[1] > 0))
        if self.only is not None:
            return
        all_ = moments.sum(0)
        self.mean = all_[0, 1:] / n.sum()
        self.scale = np.sqrt(np.maximum(np.diag(all_[1:, 1:]) / n.sum() - self.mean**2, 1e-9))
        mu = (moments[:, 0, 1:] / n[:, None] - self.mean) / self.scale
        cov = []
        for k in (0, 1):
            m = moments[k, 0, 1:] / n[k]
            cov.append((moments[k, 1:, 1:] / n[k] - np.outer(m, m)) / np.outer(self.scale, self.scale))
        pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
        self.parts = []
        for k in (0, 1):
            s = (1 - to_pooled) * cov[k] + to_pooled * pooled
            s = (1 - to_identity) * s + to_identity * max(np.trace(s) / d, 1e-3) * np.eye(d)
            low = np.linalg.cholesky(s)
            self.parts.append((mu[k], np.linalg.inv(low), float(np.log(np.diag(low)).sum()), float(np.log(n[k] / n.sum()))))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.only is not None:
            return np.full(len(x), self.only)
        z = (x - self.mean) / self.scale
        g = [prior - half - 0.5 * (((z - mu) @ inv.T) ** 2).sum(1) for mu, inv, half, prior in self.parts]
        return 1 / (1 + np.exp(np.clip(g[0] - g[1], -500, 500)))


def train(rows: DataFrame, **shrink) -> Model:
    """rows: x array<double>, y int (0 or 1). Only the summed moments reach the driver. One class alone: a constant score."""
    d = len(FEATURES)
    m = np.zeros((2, d + 1, d + 1))
    for y, i, j, v in rows.select("x", F.col("y").cast("int")).mapInArrow(_moments, "y int, i int, j int, v double").groupBy("y", "i", "j").agg(F.sum("v")).collect():
        m[y, i, j] = v
    return Model(m, **shrink)


def held_out(id):
    """Whether a row is held out: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled(labels: DataFrame, id: str, label: str) -> DataFrame:
    """(id, y) of the labels that teach."""
    return labels.select(F.col(id), F.col(label).alias("y")).where(F.col("y").isin(0, 1) & ~held_out(F.col(id)))


def fitted(df: DataFrame, labels: DataFrame, id: str, text: str, label: str) -> tuple[DataFrame, Model]:
    """The statistics of all rows, and the model that those with labels teach (rows held out aside)."""
    x = written(measured(df, id, text), "quality")
    return x, train(x.join(labelled(labels, id, label), id))


def scores(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """Every row's (id, held_out, score, predicted); learns from labelled rows that aren't held out.

    Null and empty texts are scored like others. Labels other than 0 and 1 and null labels teach nothing; a text with
    several labels teaches each. No labels: 0.5; labels of one class: that class. Null ids: held_out as of the empty string.
    Repeated rows come back as often. Other columns are left out. Empty table: no rows.
    """
    x, model = fitted(df, labels, id, text, label)

    def run(batches):
        for b in batches:
            s = model.score(np.array(b.column(2).to_pylist(), float).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], [id, "held_out", "score", "predicted"])

    kind = df.schema[id].dataType.simpleString()
    return x.select(id, held_out(F.col(id)).alias("held_out"), "x").mapInArrow(run, f"`{id}` {kind}, held_out boolean, score double, predicted int")


def accepted(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df, all columns, whose text scores threshold or more. Odd rows as in scores(); no join back by id is needed."""
    y = small(labelled(labels, id, label), MOST_LABELS)
    model = train(measured(df.join(y.select(id).distinct(), id, "left_semi"), id, text).join(y, id))  # only what teaches is measured twice
    at = df.columns.index(text)

    def run(batches):
        for b in sliced(batches):
            x = np.array([features(t) for t in b.column(at).to_pylist()], float).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= threshold))

    return df.mapInArrow(run, df.schema)


def crc_fold(id) -> int:
    """held_out by hand, for tests."""
    return zlib.crc32(str(id).encode()) % 5


def op4_quality(spark, sf_dir):
    """Every document's quality score."""
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
