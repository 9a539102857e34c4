"""Quality classifier: naive Bayes support vectors.

Features are the presence of n-grams, hashed into a fixed number of buckets:
words, pairs of neighbouring words (the text's ends count as words there), and
patterns of four neighbouring words, which say only which of them are equal, so
that repetition is seen in words never met before. Over all labelled rows to be
learned from, Spark counts each feature's documents by class; the logarithm of
the ratio of the classes' shares scales the feature. On a bounded sample of
these rows a linear model with hinge loss is fitted by dual coordinate descent,
classes weighed equally. Its margins become probabilities by a logistic curve,
which is fitted on margins that models fitted without the row give.

Nulls: a null text is an empty one; it has a score too, as has a text without
words. Rows with a label other than 0 or 1 or with a null id are not learned
from; a row with several labels counts with the greatest. If only one class can
be learned from, all scores are that class; if none, 0.5. Repeated rows are
counted as often as they come, stand in the sample once, and are scored alike;
one id on many rows is many rows. Texts of any length are read whole. An empty
table gives an empty result. Columns of the input stay, a clashing
`quality_score` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brookmill.llm.store import passing, written
from brookmill.llm.textcode import MULTIPLIER, mixed_bits, seeded, shingle_codes, word_codes

#: Buckets of features.
BUCKETS = 1 << 18
#: Most rows of each class, and most features of all rows, that the model is fitted on.
SAMPLE_ROWS, SAMPLE_FEATURES = 4_000, 40_000_000
#: Passes of coordinate descent, bound of the dual variables, smoothing of counts, folds for the logistic curve.
PASSES, BOUND, SMOOTHING, FOLDS = 12, 0.5, 1.0, 3
KINDS = {"word": 1, "pair": 2, "pattern": 3}
#: Stand for the beginning and the end of a text.
ENDS = seeded(2, 3)
#: Words to a pattern.
PATTERN = 4


def _bucket(codes: np.ndarray, kind: str) -> np.ndarray:
    return (mixed_bits(codes * np.uint64(MULTIPLIER) + np.uint64(KINDS[kind])) % np.uint64(BUCKETS)).astype(np.int64)


def patterns(words: np.ndarray) -> np.ndarray:
    """For each place, a bit for each two of the PATTERN words from there on that are equal."""
    n = len(words)
    padded = np.concatenate([words, np.arange(PATTERN, dtype=np.uint64)])  # codes of no word
    out, bit = np.zeros(n, np.uint64), 0
    for i in range(PATTERN):
        for j in range(i + 1, PATTERN):
            out |= (padded[i : i + n] == padded[j : j + n]).astype(np.uint64) << np.uint64(bit)
            bit += 1
    return out


def features(text: str, kinds: tuple[str, ...] = tuple(KINDS)) -> np.ndarray:
    """The sorted buckets of a text's features of these kinds."""
    words = word_codes(text)
    codes = {
        "word": lambda: words,
        "pair": lambda: shingle_codes(np.concatenate([ENDS[:1], words, ENDS[1:]]), 2),
        "pattern": lambda: patterns(words),
    }
    return np.unique(np.concatenate([_bucket(np.unique(codes[kind]()), kind) for kind in kinds]))


def log_ratios(positive: np.ndarray, negative: np.ndarray) -> np.ndarray:
    """Logarithms of the ratio of the classes' shares, from documents by feature and class."""
    p, q = positive + SMOOTHING, negative + SMOOTHING
    return np.log(p / p.sum()) - np.log(q / q.sum())


def descend(rows: list[np.ndarray], signs: np.ndarray, scale: np.ndarray, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and offset of the linear model with hinge loss on the scaled rows.

    Each row is scaled to length 1 besides its constant, so that long texts
    don't count for more. Dual variables are bounded by BOUND times the inverse
    share of the row's class.
    """
    values = [scale[r] / max(np.linalg.norm(scale[r]), 1e-9) for r in rows]
    square = np.array([v @ v for v in values]) + 1.0
    many = max(int((signs > 0).sum()), 1), max(int((signs < 0).sum()), 1)
    bound = BOUND * len(rows) / 2 / np.where(signs > 0, many[0], many[1])
    weights, offset, dual = np.zeros(BUCKETS), 0.0, np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(PASSES):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = signs[i] * (weights[rows[i]] @ values[i] + offset) - 1.0
            new = min(max(dual[i] - gradient / square[i], 0.0), bound[i])
            step = (new - dual[i]) * signs[i]
            if step:
                weights[rows[i]] += step * values[i]
                offset += step
                dual[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return weights, offset


def margins(rows: list[np.ndarray], weights: np.ndarray, offset: float, scale: np.ndarray) -> np.ndarray:
    """The model's margin of each row, all rows at once; every text has a feature."""
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    found = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    values = scale[found]
    lengths = np.sqrt(np.bincount(owner, values * values, len(rows)))
    return np.bincount(owner, weights[found] * values, len(rows)) / np.maximum(lengths, 1e-9) + offset


def logistic(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve from margins to probabilities, by Newton's method on smoothed labels."""
    ends = (weight * label).sum(), (weight * (1 - label)).sum()
    aim = np.where(label > 0, (ends[0] + 1) / (ends[0] + 2), 1 / (ends[1] + 2))
    x, at = np.stack([margin, np.ones(len(margin))], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (weight * (p - aim)) + 1e-6 * at)
        at = at - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


class Model:
    """Weights for the buckets of features, and the curve of probabilities; or one fixed score."""

    def __init__(self, weights: np.ndarray | None, scale: np.ndarray | None, offset: float, slope: float, shift: float, fixed: float = 0.5, kinds: tuple[str, ...] = tuple(KINDS)):
        self.weights, self.scale, self.offset, self.slope, self.shift, self.fixed, self.kinds = weights, scale, offset, slope, shift, fixed, kinds

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.fixed)
        found: list[np.ndarray] = []
        for at in range(0, len(texts), 64):
            found.append(margins([features(t, self.kinds) for t in texts[at : at + 64]], self.weights, self.offset, self.scale))
        margin = np.concatenate(found) if found else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def gone_over(rows: DataFrame, many: dict[int, int] | None = None, sample_rows: int = 0, kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """One pass over rows (doc_id, text, label 0 or 1), of which `many` have each label: counts and a sample.

    Rows with a bucket say how many documents of a label have that feature,
    summed within a task. Rows with `found` are of the sample: label and features
    of about sample_rows different rows of each class, drawn by a hash of the
    whole row. A row that repeats in a task is given once by it.
    """
    share = F.when(F.col("label") == 1, F.lit(sample_rows / many[1])).otherwise(F.lit(sample_rows / many[0])) if many else F.lit(0.0)
    drawn = rows.withColumn("draw", F.xxhash64(F.lit("quality"), "doc_id", "text", "label"))
    schema = pa.schema([("label", pa.int32()), ("bucket", pa.int32()), ("n", pa.int64()), ("draw", pa.int64()), ("found", pa.binary())])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, seen = np.zeros((2, BUCKETS), np.int64), set()
        for batch in batches:
            sample: list[tuple] = []
            for text, label, draw, chosen in zip(batch.column("text"), *[batch.column(c).to_pylist() for c in ("label", "draw", "chosen")]):
                found = features(text.as_py() or "", kinds)
                totals[label][found] += 1
                if chosen and (draw, label) not in seen:
                    seen.add((draw, label))
                    sample.append((label, None, None, draw, found.astype("<u4").tobytes()))
            if sample:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*sample), schema.types)], schema=schema)
        label, bucket = np.nonzero(totals)
        counts = [label.astype(np.int32), bucket.astype(np.int32), totals[label, bucket]]
        yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in counts], *[pa.nulls(len(label), t) for t in schema.types[3:]]], schema=schema)

    columns = drawn.select("text", "label", "draw", (F.pmod("draw", F.lit(1_000_000)) < share * 1_000_000).alias("chosen"))
    return columns.mapInArrow(go, "label int, bucket int, n long, draw long, found binary")


def counts_in(parts: DataFrame) -> np.ndarray:
    """Documents by class and feature, from what gone_over() gives: summed by Spark."""
    totals = np.zeros((2, BUCKETS))
    for r in parts.where(F.col("bucket").isNotNull()).groupBy("label", "bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        totals[r["label"], r["bucket"]] = r["n"]
    return totals


def sample_in(parts: DataFrame, sample_features: int = SAMPLE_FEATURES) -> list[tuple[int, np.ndarray]]:
    """label and features of the sample's rows, from what gone_over() gives, in an order that reruns alike."""
    out, used = [], 0
    rows = parts.where(F.col("found").isNotNull()).select("draw", "label", "found").distinct()
    for r in rows.orderBy("draw", "label", "found").toLocalIterator():
        used += len(r["found"]) // 4
        if used > sample_features:
            break
        out.append((r["label"], np.frombuffer(bytes(r["found"]), "<u4").astype(np.int64)))
    return out


def counted(rows: DataFrame) -> np.ndarray:
    """Documents by class and feature of rows (doc_id, text, label 0 or 1)."""
    return counts_in(gone_over(rows))


def sample_of(rows: DataFrame, many: dict[int, int], sample_rows: int, sample_features: int = SAMPLE_FEATURES) -> list[tuple[int, np.ndarray]]:
    """label and features of about sample_rows different rows of each class."""
    return sample_in(gone_over(rows, many, sample_rows), sample_features)


def learned(rows: DataFrame, sample_rows: int = SAMPLE_ROWS, kinds: tuple[str, ...] = tuple(KINDS)) -> Model:
    """The model of rows (doc_id, text, label 0 or 1), from features of these kinds.

    Texts are read once. Counts by feature and class are over all rows and reach
    the driver as at most BUCKETS numbers a class. The fit sees at most about
    sample_rows rows a class, and SAMPLE_FEATURES features in all.
    """
    label = F.col("label").cast("int")
    rows = rows.where(label.isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "text", label.alias("label"))
    many = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(many) < 2:
        return Model(None, None, 0.0, 0.0, 0.0, float(next(iter(many))) if many else 0.5)
    with passing():
        parts = written(gone_over(rows, many, sample_rows, kinds), "quality-parts")
        totals, sample = counts_in(parts), sample_in(parts)
    if len({label for label, _ in sample}) < 2:
        return Model(None, None, 0.0, 0.0, 0.0, many[1] / (many[0] + many[1]))
    model = fitted([found for _, found in sample], np.array([label for label, _ in sample]), log_ratios(totals[1], totals[0]), many)
    model.kinds = kinds
    return model


def fitted(rows: list[np.ndarray], label: np.ndarray, scale: np.ndarray, many: dict[int, int]) -> Model:
    signs, fold = np.where(label > 0, 1.0, -1.0), np.arange(len(rows)) % FOLDS
    margin = np.zeros(len(rows))
    for k in range(FOLDS):
        some, out = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        weights, offset = descend([rows[i] for i in some], signs[some], scale)
        margin[out] = margins([rows[i] for i in out], weights, offset, scale)
    weights, offset = descend(rows, signs, scale)
    # the sample's classes count as they do among all rows
    weight = np.where(label > 0, many[1] / max((label > 0).sum(), 1), many[0] / max((label == 0).sum(), 1))
    slope, shift = logistic(margin, label.astype(float), weight * len(rows) / weight.sum())
    return Model(weights, scale, offset, slope, shift)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with quality_score, the probability of label 1."""
    docs = docs.drop("quality_score")
    held = docs.sparkSession.sparkContext.broadcast(model)  # its size is fixed by BUCKETS

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(held.value.scores([text or "" for text in batch.column("text").to_pylist()]), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "quality_score"])

    return docs.mapInArrow(predict, T.StructType([*docs.schema.fields, T.StructField("quality_score", T.DoubleType())]))
