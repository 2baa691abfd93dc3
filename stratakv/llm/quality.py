"""Operator 6, quality classifier: random Fourier features, ridge by normal equations, isotonic map.

Statistics of a whole text (shares of character classes, repetition, lengths) are standardised and
lifted by random cosines, which approximate a Gaussian kernel. Each partition of the labelled rows
sums its normal equations; their sum gives the ridge weights. Raw scores of the labelled rows are
then made chances of the label by isotonic regression over counts in fine bins.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, give_back, materialize

_CLASSES = np.zeros((256, 6))
for _b in range(256):
    _c = chr(_b)
    _CLASSES[_b] = [
        _b >= 128 or _c.isalpha(),
        "A" <= _c <= "Z",
        _c.isdigit() and _b < 128,
        _c in " \t\r",
        _c == "\n",
        33 <= _b < 127 and not _c.isalnum(),
    ]
STATISTICS = (
    "log_bytes letters capitals digits spaces newlines marks hard_marks mark_variety log_words word_bytes "
    "long_words distinct_words top_word repeated_pairs equal_neighbours line_words distinct_lines capital_words ends"
).split()


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, all finite; null counts as empty."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(STATISTICS)
    n = len(raw)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    letters, capitals, digits, spaces, newlines, marks = (counts @ _CLASSES).tolist()
    plain = sum(int(counts[ord(c)]) for c in ".,;:'\"-?")
    variety = counts[33:127][_CLASSES[33:127, 5] > 0]
    words = raw.split()
    k = max(len(words), 1)
    numbers: dict[bytes, int] = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    seq = np.array(ids or [0], dtype=np.int64)
    top = int(np.bincount(seq).max()) if words else 0
    pairs = seq[:-1] * (len(numbers) + 1) + seq[1:]
    distinct_pairs = len(np.unique(pairs)) if len(pairs) else 1
    lines = [line for line in raw.split(b"\n") if line.strip()]
    lengths = sum(map(len, words))
    long_words = sum(len(w) > 20 for w in numbers)
    shouted = sum(w.isupper() for w in numbers)
    ended = sum(line.rstrip()[-1:] in (b".", b"!", b"?", b'"', b":") for line in lines)
    return [
        float(np.log1p(n)),
        letters / n,
        capitals / max(letters, 1.0),
        digits / n,
        spaces / n,
        newlines / n,
        marks / n,
        (marks - plain) / n,
        float(variety.max()) / n if marks else 0.0,
        float(np.log1p(len(words))),
        lengths / k,
        long_words / max(len(numbers), 1),
        len(numbers) / k**0.8,
        top / k,
        1.0 - distinct_pairs / max(len(pairs), 1),
        float((seq[1:] == seq[:-1]).mean()) if len(seq) > 1 else 0.0,
        float(np.log1p(len(words) / max(len(lines), 1))),
        len(set(lines)) / max(len(lines), 1),
        shouted / max(len(numbers), 1),
        ended / max(len(lines), 1),
    ]


@dataclass(frozen=True)
class Fit:
    """max_rows bounds the labelled rows that are fitted (a sample by hash of the id above it)."""

    features: int = 256
    width: float = 3.0
    ridge: float = 1e-3
    folds: int = 3
    bins: int = 2000
    max_rows: int = 200_000
    partitions: int = 12
    seed: int = 6


@dataclass
class Model:
    """Standardisation, random frequencies, weights, and the isotonic map as points (x, y)."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    x: np.ndarray
    y: np.ndarray

    def lift(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        wave = np.cos(z @ self.frequencies + self.phases) * np.sqrt(2 / self.frequencies.shape[1])
        return np.hstack([wave, z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.lift(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.x, self.y), 0.0, 1.0)


def _with_statistics(rows: DataFrame, text: str) -> DataFrame:
    """The rows without their text, with the array column ``stats``."""
    kept = [c for c in rows.columns if c != text]
    schema = T.StructType([*rows.select(*kept).schema.fields, T.StructField("stats", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            stats = pa.array([statistics(t.as_py()) for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), stats], names=[*kept, "stats"])

    return rows.mapInArrow(lambda b: give_back(run(b)), schema)


def _floats(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


def _stack(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(rows: DataFrame, model: Model, folds: int) -> np.ndarray:
    """Sums over partitions of (X'X, X'y) by fold: each task sends one set, and there are few tasks."""
    width = len(model.weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = np.zeros((folds, width + 1, width)), False
        for batch in batches:
            x, y = (model.lift(_stack(batch.column(0))), _floats(batch.column(1))) if batch.num_rows else (None, None)
            for fold in range(folds if batch.num_rows else 0):
                of = batch.column(2).to_numpy() == fold
                own[fold, :-1] += x[of].T @ x[of]
                own[fold, -1] += x[of].T @ y[of]
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], names=["sums"])

    total = np.zeros((folds, width + 1, width))
    for row in rows.select("stats", "y", "fold").mapInArrow(run, "sums binary").collect():
        total += np.frombuffer(row["sums"], dtype=np.float64).reshape(total.shape)
    return total


def isotonic(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Non-decreasing fit to values with weights (pool adjacent violators)."""
    out: list[list[float]] = []
    for w, v in zip(weight.tolist(), value.tolist(), strict=True):
        out.append([w, v, 1])
        while len(out) > 1 and out[-2][1] >= out[-1][1]:
            w1, v1, n1 = out.pop()
            w0, v0, n0 = out.pop()
            out.append([w0 + w1, (w0 * v0 + w1 * v1) / (w0 + w1), n0 + n1])
    return np.concatenate([np.full(int(n), v) for _, v, n in out] or [[]])


def fit(docs: DataFrame, labels: DataFrame, learn: Callable[[Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", how: Fit = Fit()) -> Model | None:
    """A model of ``label_col`` (0 or 1) from the texts alone; None without both labels.

    ``learn`` says by the id which rows may be learned from. Several labels of an id are averaged,
    null labels and ids are left out; of several rows with a labelled id one is learned, chosen by
    a hash of its statistics. Above ``how.max_rows`` labelled ids a sample by hash of the id is
    taken, so the rows fitted, their broadcast ids and the sums sent to the driver are bounded
    whatever the tables' sizes and however often an id comes.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if learn is not None:
        known = known.where(learn(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("key")).agg(F.avg(label_col).alias("y"))
    known = materialize(known, "quality-labels")
    n = known.count()
    if n > how.max_rows:
        share = how.max_rows / n
        known = known.where(F.pmod(F.xxhash64(F.col("key").cast("string")), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).join(F.broadcast(known), "key")
    fold = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit("fold")), F.lit(how.folds)).cast("int").alias("fold")
    found = _with_statistics(rows.select("key", "y", fold, "text"), "text")
    one = found.groupBy("key").agg(F.max_by(F.struct("y", "fold", "stats"), F.xxhash64("stats")).alias("row"))
    rows = materialize(one.select("row.*"), "quality-fit").coalesce(how.partitions)
    k = len(STATISTICS)
    sums = rows.agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("y"),
        *(F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(k)),
        *(F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(k)),
    ).first()
    if not sums["n"] or sums["y"] in (0.0, 1.0):
        return None
    rng = np.random.default_rng(how.seed)
    mean, scale = np.array([sums[f"m{i}"] for i in range(k)]), np.array([sums[f"s{i}"] for i in range(k)])
    model = Model(
        mean, np.where(scale > 1e-9, scale, 1.0),
        rng.normal(size=(k, how.features)) / how.width, rng.uniform(0, 2 * np.pi, how.features),
        np.zeros(how.features + k + 1), np.array([0.0]), np.array([0.0]),
    )
    each = _summed(rows, model, how.folds)

    def solved(total: np.ndarray) -> np.ndarray:
        a = total[:-1]
        return np.linalg.solve(a + how.ridge * max(a[-1, -1], 1.0) * np.eye(len(a)), total[-1])

    model.weights = solved(each.sum(axis=0))
    # the map is fitted to scores of rows by weights that were fitted without their fold
    binned = _binned(rows, model, [solved(each.sum(axis=0) - own) for own in each], how)
    weight = np.array([r["n"] for r in binned], dtype=float)
    rise = isotonic(weight, np.array([r["y"] for r in binned]) / weight)
    # a prior row of each label keeps chances off 0 and 1; within a level, a slight slope keeps order
    level = np.unique(rise)
    at = np.array([r["raw"] for r in binned]) / weight
    total = {v: weight[rise == v].sum() for v in level}
    smooth = np.array([(v * total[v] + 0.5) / (total[v] + 1) for v in rise])
    smooth = np.maximum.accumulate(smooth)
    lean = np.linspace(0, 1e-6, len(at))
    model.x, model.y = at, np.clip(smooth * (1 - 2e-6) + lean, 0, 1)
    return model


def _binned(rows: DataFrame, model: Model, by_fold: list[np.ndarray], how: Fit) -> list:
    """Per bin of the raw score: rows, sum of labels, sum of raw scores; at most ``how.bins`` bins."""
    bins, weights = how.bins, np.stack(by_fold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, fold = model.lift(_stack(batch.column(0))), batch.column(2).to_numpy()
                raw = np.einsum("ij,ij->i", x, weights[fold])
                at = np.clip(np.floor((raw + 0.5) * bins / 2), 0, bins - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw), pa.array(_floats(batch.column(1)))], names=["bin", "raw", "y"])

    scored = rows.select("stats", "y", "fold").mapInArrow(run, "bin long, raw double, y double")
    sums = scored.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"), F.sum("raw").alias("raw"))
    return sorted(sums.collect(), key=lambda r: r["bin"])


def score(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """The rows with ``score_col``, the chance of label 1 by the whole text, from 0 to 1.

    Columns ``keep`` (by default all) come along. Null texts count as empty and are scored too;
    without a model (no labels) every row scores 0.5. Repeated rows score alike; an empty table
    gives an empty result.
    """
    names = docs.columns if keep is None else keep
    (text,) = fresh(docs.select(*(F.col(f"`{c}`") for c in names)), "text_to_score")
    rows = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text_col}`").alias(text))
    if model is None:
        return rows.drop(text).withColumn(score_col, F.lit(0.5))
    schema = T.StructType([*rows.drop(text).schema.fields, T.StructField(score_col, T.DoubleType())])
    packed = pickle.dumps(model)
    sent = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for batch in batches:
            texts = batch.column(len(names))
            values = np.zeros(0)
            if batch.num_rows:
                values = own.score(np.array([statistics(t.as_py()) for t in texts]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(values, pa.float64())], names=[*names, score_col])

    return rows.mapInArrow(lambda b: give_back(run(b)), schema)


def learnable(key: Column) -> Column:
    """Rows that labels may be learned from: crc32 of the id as text is no multiple of 5."""
    return F.crc32(key.cast("string").cast("binary")) % 5 != 0


#: A row is kept if its score is this or more.
THRESHOLD = 0.3


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    scored = score(docs, fit(docs, labels, learnable), keep=["doc_id"])
    return scored.select(
        "doc_id",
        F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns."""
    (at,) = fresh(docs, "quality_score")
    return score(docs, fit(docs, labels, learnable), score_col=at).where(F.col(at) >= THRESHOLD).drop(at)
