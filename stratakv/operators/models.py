"""Models of key sets: piecewise-linear rank models, exact discrete rank functions, size models.

A piecewise-linear (PLR) model is rows (model, key_start, key_end, slope, intercept, n): the rank
of a key within a sorted set is about slope x key + intercept. A discrete one is rows
(key_min, key_max, num): num keys spread evenly over an inclusive interval.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranks
from .spans import covered, number_bucket

SEGMENTS = "model long, key_start double, key_end double, slope double, intercept double, n long"


def greedy_segments(keys: list[float], error: float, start: int = 0) -> Iterator[tuple[float, float, float, float]]:
    """Segments (first key, last key, slope, intercept) of sorted keys' ranks within an error.

    A segment grows as long as some line through its first point stays within ``error`` of all of
    its points: the cone of feasible slopes narrows with each point.
    """
    i = 0
    while i < len(keys):
        x0, low, high, j = keys[i], float("-inf"), float("inf"), i + 1
        while j < len(keys):
            dx, dy = keys[j] - x0, j - i
            if dx <= 0:
                break
            if (dy - error) / dx > high or (dy + error) / dx < low:
                break
            low, high = max(low, (dy - error) / dx), min(high, (dy + error) / dx)
            j += 1
        slope = 0.0 if j == i + 1 else (max(low, 0.0) + high) / 2
        yield x0, keys[j - 1], slope, start + i - slope * x0
        i = j


def fit_plr(keys: DataFrame, model: str, key: str, error: float = 1.0, chunk: int = 100_000) -> DataFrame:
    """A PLR model of the distinct keys of each model id, fitted in chunks of consecutive ranks.

    Ranks come from key ranges (see ``ranks``) and a chunk is one task's work, so no task holds a set.
    """
    distinct = keys.select(F.col(model).cast("long").alias("model"), F.col(key).cast("double").alias("key")).distinct()
    ranked = ranks.ranked(distinct, ["key"], by=["model"])
    chunks = ranked.withColumn("chunk", F.floor(F.col("rank") / chunk))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        rows = list(greedy_segments(pdf["key"].tolist(), error, int(pdf["rank"].iloc[0])))
        out = pd.DataFrame(rows, columns=["key_start", "key_end", "slope", "intercept"])
        out.insert(0, "model", pdf["model"].iloc[0])
        out["n"] = len(pdf)
        return out

    segments = chunks.groupBy("model", "chunk").applyInPandas(fit, SEGMENTS)
    totals = ranked.groupBy("model").agg(F.count(F.lit(1)).alias("total"))
    return segments.join(totals, "model").withColumn("n", F.col("total")).drop("total")


def predict(queries: DataFrame, segments: DataFrame, key: str = "key") -> DataFrame:
    """Queries (model, key) with ``rank`` by the model: clipped to [0, n]; between segments, the earlier one's end."""
    seg = segments.select("model", "key_start", "key_end", "slope", "intercept", "n")
    both = queries.select("model", F.col(key).cast("double").alias("at"), F.lit(1).alias("q"), *(F.lit(None).cast("double").alias(c) for c in ("key_end", "slope", "intercept")), F.lit(None).cast("long").alias("n"))
    points = both.unionByName(seg.select("model", F.col("key_start").alias("at"), F.lit(0).alias("q"), "key_end", "slope", "intercept", "n"))
    w = Window.partitionBy("model").orderBy("at", "q").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("q") == 0, F.struct("key_end", "slope", "intercept", "n")), ignorenulls=True).over(w)
    rank = F.least(F.col("at"), F.col("s.key_end")) * F.col("s.slope") + F.col("s.intercept")
    return points.withColumn("s", own).where("q = 1").select("model", F.col("at").alias(key), F.coalesce(F.least(F.greatest(rank, F.lit(0.0)), F.col("s.n").cast("double")), F.lit(0.0)).alias("rank"))


def inverse(positions: DataFrame, segments: DataFrame) -> DataFrame:
    """(model, pos) with the key that the model puts at that rank."""
    first = segments.withColumn("r0", F.col("slope") * F.col("key_start") + F.col("intercept"))
    points = positions.select("model", F.col("pos").cast("double").alias("at"), F.lit(1).alias("q"), F.lit(None).cast("struct<key_start:double,key_end:double,slope:double,r0:double>").alias("s"))
    rows = points.unionByName(first.select("model", F.col("r0").alias("at"), F.lit(0).alias("q"), F.struct("key_start", "key_end", "slope", "r0").alias("s")))
    w = Window.partitionBy("model").orderBy("at", "q").rowsBetween(Window.unboundedPreceding, 0)
    s = F.last("s", ignorenulls=True).over(w)
    key = F.when(F.col("own.slope") > 0, F.least(F.col("own.key_start") + (F.col("at") - F.col("own.r0")) / F.col("own.slope"), F.col("own.key_end"))).otherwise(F.col("own.key_start"))
    return rows.withColumn("own", s).where("q = 1").select("model", F.col("at").alias("pos"), key.alias("key"))


def merge_plr(segments: DataFrame, dedup: bool = False) -> DataFrame:
    """One model (0) of the union of all models' key sets: slopes add up between all breakpoints.

    A piece starts at the sum of the models' own ranks there, so errors do not grow from piece to
    piece. Between its segments a model has the rank of the next one's start, after the last all keys.
    With ``dedup`` keys of several sets count once where slopes are densities of a common integer
    domain: the merged slope is 1 - prod(1 - slope), and ranks are its running sum.
    """
    cuts = segments.select(F.explode(F.array("key_start", "key_end")).alias("at")).distinct()
    pieces = cuts.withColumn("to", F.lead("at").over(Window.orderBy("at"))).where("to is not null")  # few: breakpoints of models
    start = F.col("slope") * F.col("key_start") + F.col("intercept")
    after = F.coalesce(F.lead(start).over(Window.partitionBy("model").orderBy("key_start")), F.col("n").cast("double"))
    known = segments.withColumn("after", after).select("model", F.col("key_start").alias("at"), F.struct("key_end", "slope", "intercept", "after").alias("s"))
    sets = segments.groupBy("model").agg(F.max("n").alias("n"))
    asked = pieces.crossJoin(F.broadcast(sets))  # a row for each model and piece
    points = asked.withColumn("q", F.lit(1)).unionByName(known.withColumn("q", F.lit(0)), allowMissingColumns=True)
    own = F.last("s", ignorenulls=True).over(Window.partitionBy("model").orderBy("at", "q").rowsBetween(Window.unboundedPreceding, 0))
    placed = points.withColumn("s", own).where("q = 1")
    inside = F.col("at") < F.col("s.key_end")
    slope = F.when(inside, F.col("s.slope")).otherwise(0.0)
    rank = F.coalesce(F.when(inside, F.col("at") * F.col("s.slope") + F.col("s.intercept")).otherwise(F.col("s.after")), F.lit(0.0))
    each = placed.select("at", "to", "n", slope.alias("slope"), rank.alias("rank"))
    whole = F.col("slope") * (F.col("to") - F.col("at"))
    if dedup:
        # a zero factor (slope 1) makes the product 0
        dense = 1 - F.when(F.max("slope") >= 1, 0.0).otherwise(F.exp(F.sum(F.log1p(-F.least("slope", F.lit(1 - 1e-12))))))
        slopes = each.groupBy("at", "to").agg(dense.alias("slope"))
        w = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
        grown = slopes.withColumn("rank", F.coalesce(F.sum(whole).over(w), F.lit(0.0)))
        grown = grown.withColumn("n", F.ceil(F.max(F.col("rank") + whole).over(Window.partitionBy())))
    else:
        grown = each.groupBy("at", "to").agg(F.sum("slope").alias("slope"), F.sum("rank").alias("rank"), F.sum("n").alias("n"))
    return grown.select(F.lit(0).cast("long").alias("model"), F.col("at").alias("key_start"), F.col("to").alias("key_end"), "slope", (F.col("rank") - F.col("slope") * F.col("at")).alias("intercept"), F.col("n").cast("long").alias("n"))


class DiscreteCdf:
    """Exact integer rank function over disjoint sorted intervals of evenly spread keys."""

    def __init__(self, intervals: list[tuple[int, int, int]]):
        for lo, hi, n in intervals:
            if not (lo <= hi and 0 <= n <= hi - lo + 1):
                raise ValueError(f"no {n} keys in [{lo}, {hi}]")
        self.intervals = sorted(intervals)
        if any(a[1] >= b[0] for a, b in zip(self.intervals, self.intervals[1:])):
            raise ValueError("intervals overlap")

    @property
    def count(self) -> int:
        return sum(n for _, _, n in self.intervals)

    def select(self, rank: int) -> int:
        """The key of a rank from 0: key i of n in [lo, hi] is lo + floor(i * width / n)."""
        for lo, hi, n in self.intervals:
            if rank < n:
                return lo + rank * (hi - lo + 1) // n
            rank -= n
        raise IndexError("rank beyond the last key")

    def count_less_than(self, key: int) -> int:
        """Keys below a key: the inverse of ``select``."""
        total = 0
        for lo, hi, n in self.intervals:
            if key > hi:
                total += n
            elif key > lo:
                total += -(-(key - lo) * n // (hi - lo + 1))
        return total

    def slice(self, first: int, last: int) -> list[int]:
        """The keys of ranks [first, last)."""
        return [self.select(r) for r in range(first, last)]


def select_ranks(wanted: DataFrame, intervals: DataFrame) -> DataFrame:
    """(rank, key): ``DiscreteCdf.select`` for a table of ranks, with the intervals as a table."""
    placed = ranks.running(intervals, ["key_min"], {"before": F.col("num")})
    key = F.col("key_min") + F.expr("(rank - before) * (key_max - key_min + 1) div num")
    ranges = placed.where("num > 0").select("key_min", "key_max", "num", "before", F.col("before").alias("start"), (F.col("before") + F.col("num")).alias("end"))
    width = ranges.agg(F.max("num")).first()[0] or 1  # an interval lies in two buckets at most
    return covered(wanted, ranges, number_bucket(width), key="rank").select("rank", key.cast("long").alias("key"))


def materialize(intervals: DataFrame) -> DataFrame:
    """All keys of a discrete model."""
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.col("num").cast("long") - 1)).alias("i")
    return intervals.where("num > 0").select("key_min", "key_max", "num", i).select(F.expr("key_min + i * (key_max - key_min + 1) div num").cast("long").alias("key"))


def split_by_size(keys: DataFrame, key: str, size: Column, target: int, bounds: DataFrame | None = None) -> DataFrame:
    """Cuts sorted keys into output files of at most about ``target`` bytes: (file, first, last, n, bytes).

    A file also ends at each boundary key (column ``at``) of ``bounds``.
    """
    rows = keys.select(F.col(key).alias("key"), size.cast("long").alias("bytes"), F.lit(1).alias("real"))
    if bounds is not None:  # a mark sorts before the row of its key
        rows = rows.unionByName(bounds.select(F.col("at").alias("key"), F.lit(0).cast("long").alias("bytes"), F.lit(0).alias("real")))
    placed = ranks.running(rows, ["key", "real"], {"upto": F.col("bytes"), "zone": 1 - F.col("real")})
    cut = placed.where("real = 1").withColumn("part", F.floor(F.col("upto") / target))
    files = cut.groupBy("zone", "part").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    return ranks.ranked(files, ["first"], "file").select((F.col("file") + 1).alias("file"), "first", "last", "n", "bytes")


class SizeModel:
    """File size by number of entries: the least affine line at or above calibration points.

    estimate(n) = ceil(n * rise / run) + base, with exact integer arithmetic, saturating at 2^63 - 1.
    """

    LIMIT = 2**63 - 1

    def __init__(self, points: list[tuple[int, int]]):
        if len(points) < 2 or len({n for n, _ in points}) < 2:
            raise ValueError("calibration needs two sizes")
        (n0, b0), (n1, b1) = min(points), max(points)
        self.run, self.rise = n1 - n0, b1 - b0
        if self.rise < 0:
            raise ValueError("sizes must not fall")
        self.base = max(b - -(-n * self.rise // self.run) for n, b in points)

    def estimate(self, n: int) -> int:
        return min(-(-n * self.rise // self.run) + self.base, self.LIMIT)

    @classmethod
    def fitted(cls, samples: DataFrame, entries: str, size: str) -> SizeModel:
        """The model of measured files: the upper hull's line that lies least above all samples.

        Samples are reduced to the largest size of each number of entries before they are collected;
        of their upper hull (at most 4,096 numbers, spread evenly, the rest below a line) the pair
        of neighbours is taken whose line has the least total excess.
        """
        per = samples.groupBy(F.col(entries).cast("long").alias("n")).agg(F.max(F.col(size).cast("long")).alias("b"))
        low, high = per.agg(F.min("n"), F.max("n")).first()
        if low is None or low == high:
            raise ValueError("calibration needs two sizes")
        slot = F.floor((F.col("n") - low) * 4095 / (high - low))
        points = sorted((r.n, r.b) for r in per.groupBy(slot.alias("s")).agg(F.max_by("n", "b").alias("n"), F.max("b").alias("b")).collect())
        ends = per.where(F.col("n").isin(low, high)).collect()
        points = sorted(set(points) | {(r.n, r.b) for r in ends})
        hull: list[tuple[int, int]] = []
        for n, b in points:
            while len(hull) > 1 and (hull[-1][1] - hull[-2][1]) * (n - hull[-2][0]) <= (b - hull[-2][1]) * (hull[-1][0] - hull[-2][0]):
                hull.pop()
            if not hull or n > hull[-1][0]:
                hull.append((n, b))
        best = None
        for p, q in zip(hull, hull[1:]):
            if q[1] < p[1]:
                continue
            line = cls([p, q])
            over = sum(line.estimate(n) - b for n, b in points)
            if all(line.estimate(n) >= b for n, b in points) and (best is None or over < best[0]):
                best = over, line
        if best is None:  # sizes fall throughout: the largest is never exceeded
            top = max(b for _, b in points)
            return cls([(low, top), (high, top)])
        return best[1]

    def max_entries(self, size: int) -> int:
        """The most entries whose estimate is at most ``size``."""
        if size < self.estimate(0):
            return 0
        return self.LIMIT if self.rise == 0 else (size - self.base) * self.run // self.rise

    def column(self, n: Column) -> Column:
        return (F.ceil(n * F.lit(self.rise) / F.lit(self.run)) + self.base).cast("long")


def merge_discrete(models: list[DiscreteCdf]) -> tuple[int, int]:
    """(least, most) possible number of distinct keys in the union of models: its feasible totals.

    The largest model is a witness of the least; the most is limited by the keys of the domain.
    """
    least = max((m.count for m in models), default=0)
    domain: set[tuple[int, int]] = {(lo, hi) for m in models for lo, hi, _ in m.intervals}
    room, end = 0, None
    for lo, hi in sorted(domain):
        lo = lo if end is None else max(lo, end + 1)
        if hi >= lo:
            room += hi - lo + 1
            end = hi
    return least, min(sum(m.count for m in models), room)
