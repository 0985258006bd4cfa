"""Helpers that several operators use: tables, lineage cuts, size-checked joins, ranks, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Most rows of a table that is sent to every executor; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Most bytes of a batch that goes to a Python worker, whatever its texts' lengths.
BATCH_BYTES = 4 << 20

_OPEN: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Texts can be very long: batches are bounded by bytes, which bounds what a Python worker holds.

    The session keeps the setting, since frames run after the call that made them; batches of
    numbers are as large as before.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_KEPT: dict[str, dict] = {}


def begin(owner: str) -> dict:
    """What a Python worker keeps for the next tasks of one operator; called where its work starts.

    Workers are reused by tasks of all operators, so what one has kept and freed is given back
    when another starts.
    """
    if owner not in _KEPT:
        _KEPT.clear()
        gc.collect()
        pa.set_memory_pool(pa.system_memory_pool())
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        trim and trim(0)
        _KEPT[owner] = {}
    return _KEPT[owner]


def _folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own only on a local master (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="doclathe-"))
    return sc.getCheckpointDir()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored within are deleted when the block ends, but for those stored as `lasting`.

    A frame that leaves the block must be built on lasting tables and its inputs alone.
    Lasting ones, and those of functions that open no block, belong to the block around them;
    without one they stay, as the frames that are built on them may run at any time.
    """
    token = _OPEN.set((*_OPEN.get(), []))
    try:
        yield
    finally:
        paths = _OPEN.get()[-1]
        _OPEN.reset(token)
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """The frame, written as Parquet to the shared checkpoint folder and read again: it cuts the lineage."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
    around = _OPEN.get()[:-1] if lasting else _OPEN.get()
    if around:
        around[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """A small frame with its lineage cut."""
    return stored(df, "cut")


def unused(name: str, taken: Iterable[str]) -> str:
    """The name, or one made of it that isn't among those taken, whatever their case."""
    low = {t.lower() for t in taken}
    return next(n for n in (name + "_" * i for i in range(len(low) + 1)) if n.lower() not in low)


def packed(docs: DataFrame, *replaced: str) -> Column:
    """All columns as one struct `row`, so that no name clashes; a column to be replaced goes."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in replaced]).alias("row")


def is_small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether the frame has at most so many rows; counts no further than that."""
    return df.limit(most + 1).count() <= most


def same(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, (left[a].eqNullSafe(right[b]) for a, b in keys))


def attach(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join on columns of the same names, nulls matching nulls.

    The right side goes to all executors only if it has at most BROADCAST_ROWS rows;
    beyond that both sides are shuffled and adaptive execution splits skewed keys.
    """
    named = small.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)], *[c for c in small.columns if c not in on])
    right = F.broadcast(named) if is_small(small) else named
    out = big.join(right, same(big, named, [(c, f"_k{i}") for i, c in enumerate(on)]), how)
    return out.drop(*[f"_k{i}" for i in range(len(on))])


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """A gapless rank from 0 in the given order, without one task that sees all rows.

    Rows are range-partitioned and sorted; each partition numbers its own rows, and the
    driver adds up one count for each partition.
    """
    parts = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    pid, local = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    offsets, total = {}, 0
    for p, n in sorted(map(tuple, parts.groupBy(pid.alias("p")).count().collect())):
        offsets[p], total = total, total + n
    if not offsets:
        return parts.withColumn(name, F.lit(0).cast("long")).drop("_m")
    starts = F.create_map(*[F.lit(x).cast("long") for kv in offsets.items() for x in kv])
    return parts.withColumn(name, F.element_at(starts, pid) + local).drop("_m")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b), as rows (node, root), root being the least node.

    Alternating large-star and small-star steps: each is one grouped minimum and one join,
    so a hub with very many neighbours is reduced by partial aggregation. Edges stay on the
    executors; the driver sees one number a round.
    """
    spark = edges.sparkSession
    with scratch(spark):
        now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
        before = None
        for _ in range(rounds):
            both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            # large star: larger neighbours are hung on the least node of the neighbourhood
            large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
            # small star: a node and its smaller neighbours are hung on the least of them
            down = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(down, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            now = stored(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
            state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
            if state == before:
                break
            before = state
        else:
            raise RuntimeError("components did not settle")
        return stored(now.select(F.col("a").alias("node"), F.col("b").alias("root")), "roots", lasting=True)
