"""Vector similarity and nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _sized(a: Column, b: Column, value: Column) -> Column:
    wrong = F.raise_error(F.lit("vectors must have one dimension")).cast("double")
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(F.size(a) != F.size(b), wrong).otherwise(value)


def cosine(a: Column, b: Column) -> Column:
    """(1 + cos) / 2; an all-zero vector is an error, null gives null."""
    norm = F.sqrt(_dot(a, a) * _dot(b, b))
    zero = F.raise_error(F.lit("cosine similarity is not defined for all-zero vectors")).cast("double")
    return _sized(a, b, F.when(norm == 0, zero).otherwise((1 + _dot(a, b) / norm) / 2))


def euclidean(a: Column, b: Column) -> Column:
    """1 / (1 + squared distance)."""
    d2 = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x)
    return _sized(a, b, 1 / (1 + d2))


def dot_product(a: Column, b: Column) -> Column:
    """(1 + a.b) / 2."""
    return _sized(a, b, (1 + _dot(a, b)) / 2)


SIMILARITIES = {"cosine": cosine, "euclidean": euclidean, "dot_product": dot_product}
#: The most rows that a nearest-neighbour query may ask for.
MAX_NEIGHBOURS = 1000


def vector(values: Sequence[float]) -> Column:
    """A literal vector of 32-bit floats."""
    if any(v is None for v in values):
        raise ValueError("a vector has no null elements")
    return F.array(*(F.lit(float(v)).cast("float") for v in values))


def nearest(df: DataFrame, column: str, query: Sequence[float], k: int, similarity: str = "cosine", ties: Sequence[str] = ()) -> DataFrame:
    """The k rows most similar to a query vector, exact; tasks send their k best only."""
    if not 0 < k <= MAX_NEIGHBOURS:
        raise ValueError(f"k must be from 1 to {MAX_NEIGHBOURS}")
    score = SIMILARITIES[similarity](F.col(column), vector(query))
    return df.withColumn("score", score).orderBy(F.desc("score"), *ties).limit(k)


def centroids(df: DataFrame, column: str, cell: str) -> DataFrame:
    """The mean vector of each cell."""
    parts = df.select(cell, F.posexplode(column).alias("i", "x")).groupBy(cell, "i").agg(F.avg("x").alias("x"))
    return parts.groupBy(cell).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centroid"))


def nearest_in_cells(df: DataFrame, column: str, cell: str, query: Sequence[float], k: int, probes: int, ties: Sequence[str] = ()) -> DataFrame:
    """Inverted lists: the k nearest (squared distance) among rows of the ``probes`` nearest cells."""
    q = vector(query)
    cells = centroids(df, column, cell).withColumn("_d", euclidean(F.col("centroid"), q)).orderBy(F.desc("_d"), cell).limit(probes)
    inside = df.join(F.broadcast(cells.select(cell)), cell, "left_semi")
    return nearest(inside, column, query, k, "euclidean", ties)


#: Rows that cells and probes are fitted on; every row is indexed.
FIT_ROWS = 20_000


def fit_cells(df: DataFrame, column: str, id_col: str, cells: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, sample): k-means of a sample by hash of at most ``FIT_ROWS`` vectors."""
    taken = df.where(F.col(column).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(FIT_ROWS)
    sample = np.array([r[0] for r in taken.select(column).collect()], dtype=np.float64)
    centres = sample[:: max(len(sample) // cells, 1)][:cells].copy()
    for _ in range(rounds):
        own = _far(sample, centres).argmin(axis=1)
        for c in np.unique(own):
            centres[c] = sample[own == c].mean(axis=0)
    return centres, sample


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)


def choose_probes(centres: np.ndarray, sample: np.ndarray, query: Sequence[float], k: int, goal: float = 0.95) -> int:
    """The fewest probes with that recall in the sample, for the query and on average for 50 stored vectors."""
    asked = np.vstack([np.array(query, dtype=np.float64)[None], sample[:: max(len(sample) // 50, 1)]])
    own = _far(sample, centres).argmin(axis=1)
    rank = _far(asked, centres).argsort(axis=1).argsort(axis=1)  # of each cell for each query
    near = _far(asked, sample).argsort(axis=1)[:, :k]
    need = np.take_along_axis(rank, own[near], axis=1)
    for probes in range(1, len(centres)):
        recall = (need < probes).mean(axis=1)
        if min(recall[0], recall[1:].mean()) >= goal:
            return probes
    return len(centres)


def nearest_in_lists(df: DataFrame, column: str, query: Sequence[float], k: int, id_col: str, cells: int = 10, probes: int | None = None) -> DataFrame:
    """Inverted lists of k-means cells: the k nearest (squared distance) of the rows in the probed cells."""
    centres, sample = fit_cells(df, column, id_col, cells)
    if not len(sample):
        return nearest(df, column, query, k, "euclidean", [id_col])
    probes = probes or choose_probes(centres, sample, query, k)
    order = _far(np.array(query, dtype=np.float64)[None], centres)[0].argsort()[:probes]
    lists = F.array(*(F.struct(F.lit(i).alias("i"), F.array(*map(F.lit, c.tolist())).alias("v")) for i, c in enumerate(centres)))
    far = lambda c: F.aggregate(F.zip_with(c["v"], F.col(column), lambda x, y: (x - y) ** 2), F.lit(0.0), lambda a, x: a + x)
    cell = F.array_min(F.transform(lists, lambda c: F.struct(far(c).alias("d"), c["i"].alias("i"))))["i"]
    return nearest(df.where(cell.isin([int(c) for c in order])), column, query, k, "euclidean", [id_col])


def to_bytes(column: str) -> Column:
    """A vector of floats as big-endian bytes of 4 each."""
    return F.unhex(F.array_join(F.transform(column, lambda x: F.lpad(F.hex(float_bits(x)), 8, "0")), ""))


def float_bits(x: Column) -> Column:
    """The IEEE 754 single-precision bits of a normal number or zero, as a non-negative long."""
    d = F.abs(x.cast("double"))
    e = F.floor(F.log2(d)).cast("long")
    e = F.when(F.pow(F.lit(2.0), e.cast("double")) > d, e - 1).when(F.pow(F.lit(2.0), (e + 1).cast("double")) <= d, e + 1).otherwise(e)
    mantissa = F.round((d / F.pow(F.lit(2.0), e.cast("double")) - 1) * 8388608).cast("long")
    sign = F.when(x < 0, F.lit(2147483648)).otherwise(F.lit(0)).cast("long")
    return F.when(d == 0, sign).otherwise(sign + (e + 127) * 8388608 + mantissa)
