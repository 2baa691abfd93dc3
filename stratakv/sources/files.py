"""Sources and sinks: load traces, dumps, delimited copies, exports, log lines, workloads."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ranks, reconcile

#: Bytes of a load trace's header; 64-bit little-endian key ids follow.
TRACE_HEADER = 88


def write_trace(path: str, ids: Sequence[int], magic: bytes = b"VLOADTR1") -> None:
    """A load trace file on a local path: magic, count, zeros up to the header's end, key ids."""
    head = (magic + struct.pack("<Q", len(ids))).ljust(TRACE_HEADER, b"\0")
    with open(path, "wb") as f:
        f.write(head + b"".join(struct.pack("<Q", i) for i in ids))


def read_trace(spark: SparkSession, path: str, magic: bytes = b"VLOADTR1") -> DataFrame:
    """(seq, key_id) of load trace files; a file with another magic is an error."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                if bytes(content[: len(magic)]) != magic:
                    raise ValueError(f"{name} is no load trace")
                body = bytes(content[TRACE_HEADER:])
                ids = struct.unpack(f"<{len(body) // 8}Q", body[: len(body) // 8 * 8])
                yield pd.DataFrame({"path": name, "seq": range(len(ids)), "key_id": ids})

    return files.mapInPandas(unpack, "path string, seq long, key_id long")


def generate_trace(spark: SparkSession, n: int, unique_ratio: float = 1.0, alpha: float = 0.0, seed: int = 1) -> DataFrame:
    """(seq, key_id) of n writes over n * unique_ratio keys: shuffled, uniform, or Zipf-like for alpha in (0, 1).

    With ratio 1 every key is written once, in steps of the golden section of n. Zipf ids come from the inverse of the
    continuous rank distribution.
    """
    keys = max(1, round(n * unique_ratio))
    rows = spark.range(n).withColumnRenamed("id", "seq")
    u = (F.pmod(F.xxhash64("seq", F.lit(seed)), F.lit(2**52)) + 0.5) / float(2**52)
    if alpha > 0:
        key = F.floor(F.lit(float(keys)) * F.pow(u, F.lit(1 / (1 - alpha))))
    elif keys == n:
        spread = (F.col("seq").cast("decimal(38,0)") * F.lit(_coprime(n)) + seed) % F.lit(n)
        return rows.withColumn("key_id", spread.cast("long"))
    else:
        # the first pass covers every key once, so the unique count is exact
        key = F.when(F.col("seq") < keys, F.col("seq")).otherwise(F.floor(u * keys))
    return rows.withColumn("key_id", F.least(key.cast("long"), F.lit(keys - 1)))


def _coprime(n: int) -> int:
    from math import gcd

    k = int(n * 0.6180339887) | 1
    while gcd(k, n) != 1:
        k += 2
    return k


def workload(spark: SparkSession, n: int, mix: dict[str, int], keys: int, zipf: float = 0.0, seed: int = 1) -> DataFrame:
    """(seq, op, key_id): operations by weight over a key distribution."""
    total, upto = sum(mix.values()), 0
    pick = F.pmod(F.xxhash64("seq", F.lit(seed), F.lit("op")), F.lit(total))
    op = None
    for name, weight in mix.items():
        upto += weight
        op = F.when(pick < upto, name) if op is None else op.when(pick < upto, name)
    u = (F.pmod(F.xxhash64("seq", F.lit(seed), F.lit("key")), F.lit(2**52)) + 0.5) / float(2**52)
    key = F.floor(F.lit(float(keys)) * (F.pow(u, F.lit(1 / (1 - zipf))) if zipf else u)).cast("long")
    return spark.range(n).withColumnRenamed("id", "seq").select("seq", op.alias("op"), F.least(key, F.lit(keys - 1)).alias("key_id"))


#: Named mixes of the usual key-value workloads; F reads, changes and writes back.
MIXES = {"A": {"read": 50, "update": 50}, "B": {"read": 95, "update": 5}, "C": {"read": 100}, "D": {"read": 95, "insert": 5}, "E": {"scan": 95, "insert": 5}, "F": {"read": 50, "readmodifywrite": 50}}


def replay(trace: DataFrame, view: DataFrame) -> DataFrame:
    """Results of a read trace (seq, op, key): get and multiget find a key, seek the next one at or after.

    Seeks go through key ranges of keys and trace together, each range a task.
    """
    gets = trace.where(F.col("op").isin("get", "multiget", "read")).join(view.select("key", "value"), "key", "left")
    asked = trace.where(F.col("op") == "seek").select("seq", "op", "key")
    seeks = ranks.following(asked, view.select(F.col("key").alias("found")), "key", "found", "next")
    seeks = seeks.join(view.select(F.col("key").alias("next"), "value"), "next", "left")
    return gets.select("seq", "op", "key", F.when(F.col("value").isNotNull(), F.col("key")).alias("found"), "value").unionByName(seeks.select("seq", "op", "key", F.col("next").alias("found"), "value"))


#: Version of the dump format, 8 bytes big-endian after the magic.
DUMP_VERSION = 1


def dump(view: DataFrame, path: str, magic: bytes, info: dict | None = None) -> None:
    """Writes (key, value) as one dump file, sorted by key: the inverse of ``read_dump``.

    The file is one stream, so it is written by the driver through Spark's file system layer; rows
    come partition by partition, in the binary form that tasks give them, and are never all held.
    """
    spark = view.sparkSession
    rows = view.select(F.col("key").cast("binary").alias("key"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions("key")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            slices = (x for pair in zip(pdf["key"], pdf["value"], strict=True) for x in map(bytes, pair))
            yield pd.DataFrame({"content": [b"".join(struct.pack("<I", len(x)) + x for x in slices)]})

    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, False)
    try:
        head = json.dumps(info or {}, sort_keys=True).encode()
        out.write(bytearray(magic + struct.pack(">Q", DUMP_VERSION) + struct.pack("<I", len(head)) + head))
        for row in ordered.mapInPandas(pack, "content binary").toLocalIterator():
            out.write(bytearray(row["content"]))
    finally:
        out.close()


def read_dump(spark: SparkSession, path: str, magic: bytes) -> DataFrame:
    """(key, value) of dumps: magic, version, length and text of a JSON header, then length-prefixed keys and values."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for content in map(bytes, pdf["content"]):
                if not content.startswith(magic):
                    raise ValueError("no dump")
                at = len(magic) + 8
                if int.from_bytes(content[at - 8 : at], "big") != DUMP_VERSION:
                    raise ValueError("no dump of a known version")
                (n,) = struct.unpack_from("<I", content, at)
                at += 4 + n
                slices = []
                while at < len(content):
                    (n,) = struct.unpack_from("<I", content, at)
                    slices.append(content[at + 4 : at + 4 + n])
                    at += 4 + n
                yield pd.DataFrame({"key": slices[::2], "value": slices[1::2]})

    return files.mapInPandas(unpack, "key binary, value binary")


def copy_to(df: DataFrame, path: str, columns: Sequence[str], delimiter: str = ",") -> None:
    df.select(*columns).write.option("header", True).option("sep", delimiter).csv(path)


def copy_from(spark: SparkSession, path: str, schema, delimiter: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", delimiter).csv(path)


def ingest(log: DataFrame, external: DataFrame, seq: int) -> DataFrame:
    """A log with an external sorted file's rows at one new sequence number; rows that have one are an error."""
    if "seq" in external.columns:
        wrong = F.raise_error(F.lit("an external file has no sequence numbers")).cast("long")
        checked = external.withColumn("seq", F.when(F.col("seq") == 0, F.lit(seq)).otherwise(wrong))
    else:
        checked = external.withColumn("seq", F.lit(seq).cast("long"))
    return log.unionByName(checked, allowMissingColumns=True)


def file_properties(df: DataFrame) -> DataFrame:
    """Per source file: rows, first and last key, bytes, and the share of deletes (0 without ``kind``)."""
    deleted = F.col("kind").isin("DEL", "SINGLEDEL") if "kind" in df.columns else F.lit(False)
    return df.withColumn("file", F.input_file_name()).groupBy("file").agg(
        (F.count_if(deleted) / F.count(F.lit(1))).alias("deletes"),
        F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.max("key").alias("last"),
        F.sum(F.octet_length(F.col("key").cast("string"))).alias("key_bytes"),
    )


def checksum(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """CRC-32 of each row's columns, joined by a zero byte."""
    return df.withColumn("crc", F.crc32(F.concat_ws("\0", *(F.col(c).cast("string") for c in columns)).cast("binary")))


def io_trace(lines: DataFrame, column: str = "value") -> DataFrame:
    """(at, op, file, latency, offset, length) of an I/O trace's lines of ``name: value`` fields, comma-separated."""
    fields = F.str_to_map(F.regexp_replace(column, r"\s*([,:])\s*", "$1"), F.lit(","), F.lit(":"))
    get = lambda name, kind: F.try_element_at(fields, F.lit(name)).try_cast(kind)
    names = {"at": ("Access Time", "long"), "op": ("File Operation", "string"), "file": ("File Name", "string"), "latency": ("Latency", "long"), "offset": ("Offset", "long"), "length": ("Length", "long")}
    return lines.select(*(get(n, k).alias(c) for c, (n, k) in names.items())).where("op is not null")


def cache_trace(accesses: DataFrame, path: str) -> None:
    """Writes block accesses (at, block, size, hit) as a trace in order of time, one line each."""
    line = F.concat_ws(",", F.col("at").cast("string"), F.col("block").cast("string"), F.col("size").cast("string"), F.col("hit").cast("int").cast("string"))
    accesses.repartitionByRange("at", "block").sortWithinPartitions("at", "block").select(line.alias("value")).write.text(path)


def read_cache_trace(spark: SparkSession, path: str) -> DataFrame:
    """The accesses of a trace."""
    return spark.read.schema("at long, block string, size long, hit int").csv(path).withColumn("hit", F.col("hit") == 1)


class Backups:
    """Incremental backups of a view: each holds the rows that are new or changed since the one before.

    A manifest table names every backup's keys that went; restore takes the newest row of each key.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "key"):
        self.spark, self.path, self.key, self.numbers = spark, path.rstrip("/"), key, []

    def create(self, view: DataFrame) -> int:
        """Writes a backup and returns its number."""
        number = len(self.numbers)
        rest = [c for c in view.columns if c != self.key]
        now = view.select(self.key, F.struct(*rest).alias("row"), F.xxhash64(*rest).alias("h"))
        if number:
            old = self._newest(number - 1).where("not gone").select(self.key, F.col("h").alias("old"))
            both = now.join(old, self.key, "full").where("h is null or old is null or h <> old")
        else:
            both = now.withColumn("old", F.lit(None).cast("long"))
        both.select(self.key, "row", "h", F.col("h").isNull().alias("gone"), F.lit(number).alias("number")).write.parquet(f"{self.path}/{number}")
        self.numbers.append(number)
        return number

    def _newest(self, number: int) -> DataFrame:
        every = self.spark.read.parquet(*(f"{self.path}/{n}" for n in self.numbers if n <= number))
        top = every.groupBy(self.key).agg(F.max_by(F.struct("row", "h", "gone"), "number").alias("t"))
        return top.select(self.key, "t.row", "t.h", "t.gone")

    def restore(self, number: int) -> DataFrame:
        """The view as it was at a backup."""
        return self._newest(number).where("not gone").select(self.key, "row.*")


def follower(spark: SparkSession, path: str, schema, upto: int | None = None) -> DataFrame:
    """A read-only instance over another's log folder: the newest state of what lies there now.

    Calling it again catches up; ``upto`` stays at a sequence number.
    """
    log = spark.read.schema(schema).parquet(path)
    return reconcile.live(log if upto is None else reconcile.snapshot(log, upto))


def moving_average(samples: DataFrame, value: str, order: Sequence[str], by: Sequence[str], alpha: float = 0.002) -> DataFrame:
    """(by, average): exponential moving average of each group's samples in order; the first one starts it.

    The weight of sample i of n is alpha (1 - alpha)^(n - i), and (1 - alpha)^(n - 1) for the first:
    a weighted sum, so no task folds a group's samples in turn.
    """
    placed = ranks.ranked(samples.select(*by, *order, value), list(order), "_i", by)
    last = placed.groupBy(*by).agg(F.max("_i").alias("_n"))
    left = F.col("_n") - F.col("_i")
    weight = F.pow(F.lit(1 - alpha), left) * F.when(F.col("_i") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    return placed.join(last, list(by)).groupBy(*by).agg(F.sum(F.col(value) * weight).alias("average"))


# --- text logs -----------------------------------------------------------------------------------

def parse_lines(lines: DataFrame, fields: dict[str, tuple[str, str]], column: str = "value") -> DataFrame:
    """Lines that match all patterns, as columns: name -> (pattern with one group, type)."""
    keep = None
    for pattern, _ in fields.values():
        hit = F.col(column).rlike(pattern)
        keep = hit if keep is None else keep & hit
    return lines.where(keep).select(*(F.regexp_extract(column, p, 1).cast(t).alias(n) for n, (p, t) in fields.items()))


def key_values(line: str | Column, pair: str = " ", equals: str = "=") -> Column:
    """A map of the ``k=v`` words of a line."""
    c = F.col(line) if isinstance(line, str) else line
    return F.str_to_map(c, F.lit(pair), F.lit(equals))


def percentile_linear(column: str, p: float) -> Column:
    """The percentile at rank p * (n - 1) with linear interpolation, cut to a whole number."""
    return F.percentile(column, p).cast("long")


def breakdown(df: DataFrame, by: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Per group and metric: jobs, total, share of the group's total, mean, p50, p95, p99, max."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("x")) for m in metrics))).alias("p")
    long = df.select(*by, pairs).select(*by, "p.metric", "p.x")
    stats = long.groupBy(*by, "metric").agg(
        F.count("x").alias("jobs"), F.sum("x").alias("total"), F.avg("x").alias("mean"),
        percentile_linear("x", 0.5).alias("p50"), percentile_linear("x", 0.95).alias("p95"), percentile_linear("x", 0.99).alias("p99"), F.max("x").alias("max"),
    )
    whole = F.sum("total").over(Window.partitionBy(*by))
    return stats.withColumn("share", F.try_divide(F.col("total") * 100, whole))


def level_statistics(df: DataFrame, level: str, x: str) -> DataFrame:
    """Mean, sample deviation (0 below two rows), least and largest per level."""
    return df.groupBy(level).agg(F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"))


def ratios(df: DataFrame, key: str, system: str, value: str, a: str, b: str) -> DataFrame:
    """Per key the value of systems a and b and b / a (null without a or at 0)."""
    pivot = df.groupBy(key).pivot(system, [a, b]).agg(F.avg(value))
    return pivot.withColumn("ratio", F.try_divide(b, a))


def ledger(jobs: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per level: input and output entries, jobs whose outputs don't add up, outputs over capacity,
    and outputs whose keys overlap the one before them.

    jobs (job, level, entries, capacity); outputs (job, key_min, key_max, entries).
    """
    before = F.lag("key_max").over(Window.partitionBy("job").orderBy("key_min"))
    marked = outputs.withColumn("overlap", F.coalesce(F.col("key_min") <= before, F.lit(False)).cast("int"))
    joined = jobs.withColumnRenamed("entries", "given").join(marked, "job", "left")
    per_job = joined.groupBy("job", "level", "given", "capacity").agg(
        F.coalesce(F.sum("entries"), F.lit(0)).alias("made"), F.sum("overlap").alias("overlaps"), F.sum((F.col("entries") > F.col("capacity")).cast("int")).alias("over")
    )
    return per_job.groupBy("level").agg(
        F.sum("given").cast("long").alias("given"), F.sum("made").cast("long").alias("made"), F.sum((F.col("given") != F.col("made")).cast("int")).alias("unbalanced"),
        F.coalesce(F.sum("overlaps"), F.lit(0)).alias("overlaps"), F.coalesce(F.sum("over"), F.lit(0)).alias("over_capacity"),
    )


def triggered(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules (rule, condition, pattern, suggestion) all of whose conditions match some line of ``facts`` (value)."""
    hits = facts.join(F.broadcast(rules), F.expr("value rlike pattern")).select("rule", "condition").distinct()
    need = rules.groupBy("rule").agg(F.count_distinct("condition").alias("need"), F.first("suggestion").alias("suggestion"))
    have = hits.groupBy("rule").agg(F.count(F.lit(1)).alias("have"))
    return need.join(have, "rule").where("have = need").select("rule", "suggestion")


def simulate_cache(trace: DataFrame, capacity: int, by: str | None = None, key: str = "key", seq: str = "seq") -> DataFrame:
    """Hits and misses of an LRU cache of ``capacity`` entries over an access trace, one cache per group.

    A group's trace is one ordered pass, as the cache is one; groups run side by side.
    """
    from collections import OrderedDict

    rows = trace.select((F.col(by) if by else F.lit("all")).cast("string").alias("grp"), F.col(seq).alias("seq"), F.col(key).cast("string").alias("key"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cache: OrderedDict[str, None] = OrderedDict()
        hits = 0
        for k in pdf.sort_values("seq")["key"]:
            if k in cache:
                hits += 1
                cache.move_to_end(k)
            else:
                cache[k] = None
                if len(cache) > capacity:
                    cache.popitem(last=False)
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]], "hits": [hits], "misses": [len(pdf) - hits]})

    return rows.groupBy("grp").applyInPandas(run, "grp string, hits long, misses long")
