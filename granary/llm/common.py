"""Shared helpers: tables, durable intermediate results, connected components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Row handle added by the operators; it is stored with the rows, so every reader sees the same one.
ROW = "__row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if "local[" not in spark.sparkContext.master and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = getattr(spark, "_granary_dir", None) or f"file://{tempfile.mkdtemp(prefix='granary-')}"
        spark._granary_dir = at
    return at.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: it cuts the lineage and
    survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/granary/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._granary_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_granary_path", None)
        if path is not None:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it finds them when memory is collected, which
    a driver with little to do may put off for long. What a plan that has just ended still holds goes the second time."""
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def given_back() -> None:
    """In a worker: memory that was freed goes back to the system, at once from here on for arrays over a megabyte. Else a
    worker keeps what its largest task took, beside the JVM and the next task."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


def free_name(df: DataFrame, name: str = ROW) -> str:
    """`name`, or a longer one if df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str = ROW, tag: str = "rows") -> DataFrame:
    """df with a number for each row, stored once. Numbers made by a scan depend on its splits, and these on
    the executors of the moment; stored ones are the same for every job, retry and branch of a plan."""
    return stored(df.withColumn(name, F.monotonically_increasing_id()), tag)


def window_hashes(items: Column, width: int) -> Column:
    """A 64-bit hash of each window of `width` words, in time linear in the words: hashes of 1, 2, 4, ...
    words are joined pairwise. Fewer words than `width` give none."""

    def joined(a: Column, b: Column, shift: int) -> Column:
        """a[i] with b[i + shift], as far as there is one."""
        n = F.greatest(F.lit(0), F.size(b) - shift)
        return F.zip_with(F.slice(a, 1, n), F.slice(b, F.lit(shift + 1), n), lambda x, y: F.xxhash64(x, y))

    def grown(power: Column, size: int, done: Column | None, have: int) -> Column:
        """power: hashes of `size` words; done: of the first `have` words of each window so far."""
        if width & size:
            done = power if done is None else joined(done, power, have)
            have += size
        if have == width:
            return done
        return let(joined(power, power, size), lambda twice: grown(twice, size * 2, done, have))

    return let(F.transform(items, lambda w: F.xxhash64(w)), lambda one: grown(one, 1, None, 0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def held_out(doc_id: str, mod: int, rest: int):
    """crc32(doc_id as text) mod `mod` is `rest`; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(False))


def learnable(doc_id: str, mod: int, rest: int):
    """Rows a model may learn from: a known id that isn't held out."""
    return F.col(doc_id).isNotNull() & ~held_out(doc_id, mod, rest)


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(a, b) long edges -> (node, root): root is the smallest node reachable.

    Alternating large-star and small-star rounds on stored edge tables; each round is a
    partial-aggregated minimum and one equi-join, and O(log^2) rounds suffice. Self loops
    and repeats are fine; nodes without an edge don't appear; no edges give no rows.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), tag)
    before = None
    while True:
        last = e
        # u > v always. Large star: every neighbour above u goes to the smallest of u's neighbourhood.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: the neighbours below u, and u, go to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        e = stored(
            small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(),
            tag,
        )
        discard(last)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node").unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
