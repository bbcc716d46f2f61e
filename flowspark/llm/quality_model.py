"""Quality classifier: random Fourier features over document statistics, ridge by normal equations, isotonic calibration.

Statistics are computed once for each document and written (a few dozen numbers, no text). Training rows are those
with a label; each partition adds up its own normal equations, a few tasks add those up, and the driver solves one
system of FEATURES + 1 unknowns: what it receives does not grow with the rows. Calibration takes the labelled rows
that the fit left out, counted in BINS bins of the ridge score, and pools adjacent violators.

Nulls: a null or empty text has zero statistics and gets a score like any other; a null label is no label; a document
with several label rows counts once for each. Repeated rows each get a row. Without labels every score is the neutral
0.5. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, pick, position, row_key

FEATURES = 256
BINS = 512
ROWS = 2000  # whose features are held at a time
RIDGE = 1.0
SEED = 20240501
NAMES = (
    "log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "marks", "stops", "high_bytes", "entropy", "distinct_words", "distinct_pairs", "same_next",
    "lines_per_word", "repeated_lines", "line_words", "top_word", "short_words", "long_words", "deflated",
)
_CLASSES = {"upper": range(65, 91), "digits": range(48, 58), "symbols": b"#*$%&|<>@^~_=+\\{}[]", "marks": b"!?", "stops": b".,;:", "high_bytes": range(128, 256)}
_OF = np.array([[b in c for c in _CLASSES.values()] for b in range(256)], dtype=float)


def statistics(text: str) -> list[float]:
    """The whole text's statistics, in the order of NAMES."""
    raw = text.encode()
    words = text.split()
    n, k = len(raw), len(words)
    if not k:
        return [float(np.log1p(n)), *[0.0] * (len(NAMES) - 1)]
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    p = counts[counts > 0] / n
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=k)
    pairs = set(zip(words, words[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    seen: dict[str, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    same = sum(a == b for a, b in zip(words, words[1:])) / k
    return [
        float(np.log1p(n)), float(np.log1p(k)), float(sizes.mean()), *(counts @ _OF / n), float(-(p * np.log2(p)).sum()), len(seen) / k, (len(pairs) + 1) / k, same,
        len(lines) / k, 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(k / max(1, len(lines)))), max(seen.values()) / k, float((sizes <= 2).mean()), float((sizes >= 15).mean()), len(zlib.compress(raw, 1)) / n,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs' doc_id, row (the key of its doc_id and text) and the array stats."""
    docs = pick(docs, "doc_id", "text").select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    schema = docs.select("doc_id", "row", F.lit(None).cast("array<double>").alias("stats")).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([statistics(t.as_py() or "") for t in b.column(2)], pa.list_(pa.float64()))], names=["doc_id", "row", "stats"])

    return docs.mapInArrow(work, schema)


def _sums(parts: DataFrame, width: int, rows_to_sums) -> np.ndarray:
    """Adds up what rows_to_sums makes of each partition, in levels: one vector a partition, then one for each shuffle
    partition (adaptive execution joins small ones), then one for each of eight tasks."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                x = np.array(b.column(0).flatten(), dtype=float).reshape(b.num_rows, -1)
                y = np.array(b.column(1), dtype=float)
                for i in range(0, len(x), ROWS):
                    total += rows_to_sums(x[i : i + ROWS], y[i : i + ROWS])
        yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(width), False
        for b in batches:
            for v in b.column(0):
                total, some = total + np.frombuffer(v.as_py()), True
        if some:
            yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    each = parts.mapInArrow(first, "v binary").withColumn("part", F.spark_partition_id())
    level = each.repartition("part").select("v").mapInArrow(then, "v binary")
    got = level.repartition(8).mapInArrow(then, "v binary").collect()
    return np.sum([np.frombuffer(r.v) for r in got], axis=0) if got else np.zeros(width)


class Projection:
    """Standardised statistics to cosines that approximate a Gaussian kernel, and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES):
        draw = np.random.default_rng(SEED)
        self.mean, self.scale = mean, scale
        self.weights = draw.normal(size=(len(mean), features)) / np.sqrt(2.0 * len(mean))
        self.phase = draw.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2.0 / len(self.phase)) * np.cos(z @ self.weights + self.phase), np.ones((len(x), 1))])


def pool(score: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the isotonic fit: mean score and share of good rows of each pooled block, both ascending."""
    blocks: list[list[float]] = []
    for s, g, k in zip(score, good, n):
        blocks.append([s * k, g, k])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Model:
    def __init__(self, project: Projection | None, theta: np.ndarray | None, knots: tuple[np.ndarray, np.ndarray] | None):
        self.project, self.theta, self.knots = project, theta, knots

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.project(x) @ self.theta

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.theta is None:
            return np.full(len(x), 0.5)
        r = self.raw(x)
        return np.clip(np.interp(r, *self.knots) if self.knots else r, 0.0, 1.0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """score of any number of rows."""
        return np.concatenate([np.zeros(0), *[self.score(x[i : i + ROWS]) for i in range(0, len(x), ROWS)]])


def fit(labelled: DataFrame, calibration: Column) -> Model:
    """labelled: stats, label, and what calibration reads. The rows for which it holds calibrate, the others fit."""
    d = len(NAMES)
    labelled = labelled.withColumn("calibrates", calibration)
    own = labelled.filter("not calibrates").select("stats", "label")
    moments = _sums(own, 2 * d + 2, lambda x, y: np.concatenate([x.sum(0), (x * x).sum(0), [len(x), y.sum()]]))
    n = moments[-2]
    if not n:
        return Model(None, None, None)
    mean = moments[:d] / n
    scale = np.sqrt(np.maximum(moments[d : 2 * d] / n - mean**2, 1e-8))
    project = Projection(mean, scale)
    k = FEATURES + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = project(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    total = _sums(own, k * k + k, normal)
    gram, right = total[: k * k].reshape(k, k), total[k * k :]
    theta = np.linalg.solve(gram + RIDGE * np.diag([*[1.0] * FEATURES, 1e-6]), right)
    model = Model(project, theta, None)

    def count(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(((model.raw(x) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS), np.bincount(at, model.raw(x), BINS)])

    bins = _sums(labelled.filter("calibrates").select("stats", "label"), 3 * BINS, count).reshape(3, BINS)
    good, size, score = bins[:, bins[1] > 0]
    return Model(project, theta, pool(score / size, good, size) if len(size) else None)


def _learnt(seen: DataFrame, labels: DataFrame, trains: Column, calibrates: Column) -> Model:
    marks = pick(labels, "doc_id", "quality").filter("quality is not null").select("doc_id", F.col("quality").cast("double").alias("label")).filter(trains)
    return fit(seen.join(marks, "doc_id").select("doc_id", "stats", "label"), calibrates)


def score_quality(docs: DataFrame, labels: DataFrame, trains: Column, calibrates: Column) -> DataFrame:
    """doc_id, row and score. trains and calibrates are conditions on doc_id: which labelled rows are learnt from, and which
    of those calibrate. labels, lang, source and doc_id are no inputs of a score."""
    seen = cut(with_statistics(docs), "quality-statistics")
    model = _learnt(seen, labels, trains, calibrates)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(2).flatten(), dtype=float).reshape(b.num_rows, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.scores(x), pa.float64())], names=["doc_id", "row", "score"])

    return seen.mapInArrow(work, seen.select("doc_id", "row", F.lit(0.0).alias("score")).schema)


def drop_low_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """docs without the documents that score below least; every labelled row is learnt from, a fifth of them for
    calibration. Each text is judged by its own score, whatever other rows its doc_id, null or repeated, has. A second
    pass over the texts scores them where they are: that takes their statistics twice, but no text is shuffled."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = _learnt(cut(with_statistics(docs), "quality-statistics"), labels, F.lit(True), fold == 4)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t.as_py() or "") for t in texts], dtype=float).reshape(len(texts), len(NAMES))
        return pa.array(model.scores(x), pa.float64())

    return numbered(docs).filter(score(F.col(f"c{position(docs, 'text')}")) >= least).toDF(*docs.columns)
