"""Gapless numbers in an order, made where the rows are."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_folder(spark: SparkSession) -> None:
    """The folder that spark.checkpoint.dir names is used; one of our own only on a local master where it is unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None and sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="doclathe-"))


def ranked(keys: DataFrame, by: str, name: str = "rank") -> DataFrame:
    """Rows with a number from 0 in the order of `by`; give keys alone, as the rows are shuffled and written once.

    Rows are dealt by range and sorted; each partition numbers its own, and the driver adds up
    one count for each partition. The dealt rows are checkpointed, since a second run of the
    sampling might deal them otherwise.
    """
    checkpoint_folder(keys.sparkSession)
    dealt = keys.repartitionByRange(by).sortWithinPartitions(by).withColumn("_m", F.monotonically_increasing_id()).checkpoint()
    part, own = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    starts, total = [], 0
    for p, n in sorted(map(tuple, dealt.groupBy(part.alias("p")).count().collect())):
        starts += [F.lit(p).cast("long"), F.lit(total).cast("long")]
        total += n
    before = F.try_element_at(F.create_map(*starts), part) if starts else F.lit(0).cast("long")
    return dealt.withColumn(name, before + own).drop("_m")
