"""What the training-data operators share: table reads, written intermediates, size checks.

Intermediates are written as Parquet under ``spark.checkpoint.dir``, which all executors and the
driver share, so a lost executor costs the re-read of a file and never a recomputation of the
stages before it.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: dict[str, SparkSession] = {}


def give_back(batches):
    """The batches of a worker's task; at its end, freed memory goes back to the system.

    Workers are used again by later stages, whose memory would else come on top.
    """
    try:
        yield from batches
    finally:
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL("libc.so.6").malloc_trim(0)


#: Rows of one Arrow batch: whole texts may be long, and a worker holds a batch or two at a time.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables; Arrow batches of the session are kept small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a local master gets a temporary folder of its own (tests); on a
    cluster that is an error, as a machine-local folder is not seen by the other machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="stratakv-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/stratakv/{label}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and return a read of it (cuts the lineage)."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for path, spark in _WRITTEN.items():
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``max_rows`` rows, else as it is (sort-merge).

    ``df`` should be materialised: it is counted here.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def text_or_empty(col: str | Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that clash with no column of ``df`` (case is ignored)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def prefix_sums(lengths: Column, block: int = 256) -> Column:
    """Exclusive prefix sums of an array of ints, in time linear in its length (for a fixed block).

    Sums run within blocks of ``block`` entries on top of the prefix sums of the block totals, so
    no accumulator longer than a block or than the number of blocks is ever copied.
    """
    zero = F.lit(0).cast("long")

    def running(values: Column, start: Column) -> Column:
        """[start, start + v0, ...] without the last sum."""
        begin = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(
            values,
            begin,
            lambda acc, v: F.struct((acc["at"] + v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )

    n_blocks = F.ceil(F.size(lengths) / F.lit(block)).cast("int")
    blocks = F.transform(F.sequence(F.lit(1), n_blocks), lambda b: F.slice(lengths, (b - 1) * block + 1, F.lit(block)))
    starts = running(F.transform(blocks, lambda v: F.aggregate(v, zero, lambda a, x: a + x)), zero)
    long_way = F.flatten(F.zip_with(blocks, starts, running))
    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).when(F.size(lengths) <= block, running(lengths, zero)).otherwise(long_way)


def with_spans(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column | None]], near: int = 32) -> DataFrame:
    """For each kind, its leftmost non-overlapping matches, as the column of that name.

    ``patterns`` maps a kind to a Java pattern, which must not match the empty string, and a cheap
    condition without which no match is possible (None: always tried). A span is a struct
    (start, end, value, left, right): code points, the end exclusive; left and right are up to
    ``near`` characters of the text between this match and its neighbours of the same kind.
    The pieces between matches come from ``split`` by the same pattern, for texts with a match
    only, so starts are prefix sums of piece and match lengths. The text column is dropped.
    """
    kinds = list(patterns)
    found, gaps = fresh(df, *(f"found_{k}" for k in kinds)), fresh(df, *(f"gaps_{k}" for k in kinds))
    every = F.col(text)
    rest = [F.col(c) for c in df.columns]
    none = F.array().cast("array<string>")
    step = df.select(
        *rest,
        *(
            F.coalesce(F.when(F.lit(True) if need is None else need, F.regexp_extract_all(every, F.lit(p), F.lit(0))), none).alias(f)
            for f, (p, need) in zip(found, patterns.values(), strict=True)
        ),
    )
    step = step.select(
        *(F.col(c) for c in df.columns if c != text),
        *(F.col(f) for f in found),
        *(
            F.when(F.size(f) > 0, F.split(every, p, -1)).alias(g)
            for f, g, (p, _) in zip(found, gaps, patterns.values(), strict=True)
        ),
    )

    def piece(g: Column) -> Column:
        return F.struct(
            F.length(g).cast("long").alias("n"),
            F.right(g, F.lit(near)).alias("tail"),
            F.left(g, F.lit(near)).alias("head"),
        )

    step = step.withColumns({g: F.transform(g, piece) for g in gaps})
    steps = fresh(step, *(f"steps_{k}" for k in kinds))
    step = step.withColumns(
        {
            s: F.when(
                F.col(g).isNotNull(),
                F.zip_with(F.slice(g, F.lit(1), F.size(f)), F.col(f), lambda p, m: p["n"] + F.length(m)),
            )
            for s, g, f in zip(steps, gaps, found, strict=True)
        }
    )
    starts = fresh(step, *(f"starts_{k}" for k in kinds))
    step = step.withColumns({a: F.when(F.col(s).isNotNull(), prefix_sums(F.col(s))) for a, s in zip(starts, steps, strict=True)})
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,value:string,left:string,right:string>>")

    def spans(f: str, g: str, s: str, a: str) -> Column:
        n = F.size(f)
        rows = F.arrays_zip(
            F.col(f).alias("m"),
            F.col(s).alias("s"),
            F.col(a).alias("a"),
            F.slice(g, F.lit(1), n).alias("before"),
            F.slice(g, F.lit(2), n).alias("after"),
        )
        out = F.transform(
            rows,
            lambda r: F.struct(
                (r["a"] + r["before"]["n"]).alias("start"),
                (r["a"] + r["s"]).alias("end"),
                r["m"].alias("value"),
                r["before"]["tail"].alias("left"),
                r["after"]["head"].alias("right"),
            ),
        )
        return F.coalesce(F.when(F.col(g).isNotNull(), out), nothing)

    return step.select(
        *(F.col(c) for c in df.columns if c != text),
        *(spans(f, g, s, a).alias(k) for k, f, g, s, a in zip(kinds, found, gaps, steps, starts, strict=True)),
    )


def join_spans(spans: Column) -> Column:
    """``kind:start:end`` of an array of structs, comma-joined in the array's order."""
    return F.array_join(
        F.transform(
            spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        ),
        ",",
    )


def count_where(spans: str, field: str, value: str) -> Column:
    """How many structs of an array have that value in a field."""
    return F.size(F.filter(spans, lambda s: s[field] == value)).cast("long")
