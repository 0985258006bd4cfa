"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import WORD, attach, cut, packed, ranked, scratch, stored, table

#: Two levels of so many bins each stand between a source's rows and the rows that are ordered.
BINS = 4096


def words(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: float = 1.0, most: int = 3) -> DataFrame:
    """Target of each source, from rows (source, size).

    Sources by code point, null last, take the weights in turn. They share budget times the
    sum of sizes by weight; a target stops at `most` times its source's size, and what is
    above is shared anew by weight until no target is above. Returns source, source_size,
    target. Without rows, or if all sizes are 0, targets are 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    listed = ranked(totals, F.col("source").asc_nulls_last(), name="_rank")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    listed = cut(listed.withColumn("_w", F.element_at(cycle, (F.col("_rank") % len(weights) + 1).cast("int"))))
    level, cap = 0.0, F.col("source_size") * most
    while True:  # the level only rises, at most once for each source that is newly above
        full = F.lit(level) * F.col("_w") > cap
        total, held, left = listed.agg(F.sum("source_size"), F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("_w")))).first()
        if not left:
            break
        above = (budget * (total or 0) - (held or 0)) / left
        if above <= level:
            break
        level = above
    return listed.select("source", "source_size", F.least(F.lit(level) * F.col("_w"), cap.cast("double")).alias("target"))


def _due(most: int) -> Column:
    """Copies due, from a source's ratio, spread and preferred."""
    return F.least(F.greatest(F.col("ratio") * F.col("share") + F.col("spread") * (F.col("prefer") - F.col("preferred")), F.lit(0.0)), F.lit(float(most)))


def shorter_first(size: Column, middle: int = 1000) -> Column:
    """A preference for shorter texts, from 1 down to 0: one half at `middle` words."""
    return middle / (middle + size).cast("double")


def _odds_rank(p: Column, u: Column) -> Column:
    """Order in (0, 1) of Q = u / (1-u) over p / (1-p), as Q / (1 + Q); null without a fraction p."""
    return F.when(p > 0, F.least(u * (1 - p) / (u * (1 - p) + (1 - u) * p), F.lit(1 - 1e-12)))


def pareto_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: float = 1.0, most: int = 3, seed: int = 20, share: Column | None = None, prefer: Callable[[Column], Column] | None = None, name: str = "mix") -> DataFrame:
    """Adds to each document the column `name`: size, source_size, target, copies, taken.

    A document of a source is due target / source_size copies, times `share` if given (a
    positive number by which documents of one source are preferred, of mean 1 weighted by
    size). With `prefer`, a number from 0 to 1 made of the size, documents of a source get unequal odds: what is
    above the source's mean of it, weighted by size, is due up to as much more, so that the
    source's sum stays and nobody is due under 0 or over `most`. It gets the whole part for certain. The fraction p is its inclusion probability
    for one more copy: documents are ordered by u / (1-u) over p / (1-p), u being a fixed
    number in (0, 1) made of seed, doc_id and text, and taken in this order while the words
    taken stay within half a document of the source's words still due.

    Null text has size 0; null sources are a source; rows alike in id and text share their u
    and are taken together or not at all. Never more than `most` copies. Reruns agree. All
    columns of the input stay, but for one of that name.
    """
    share = share if share is not None else F.lit(1.0)
    liked = prefer(F.col("size")) if prefer is not None else F.lit(0.0)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 12) + 0.5) / float(1 << 52)
    with scratch(docs.sparkSession):
        sized = cut(docs.select("source", words("text").alias("size"), u.alias("u"), share.alias("share")).withColumn("prefer", liked))
        means = sized.groupBy("source").agg(F.try_divide(F.sum(F.col("prefer") * F.col("size")), F.sum("size")).alias("preferred"))
        ratio = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
        targets = attach(source_targets(sized, weights, budget, most), means, ["source"]).withColumn("ratio", ratio)
        targets = cut(targets.withColumns({"spread": F.least("ratio", most - F.col("ratio")), "preferred": F.coalesce("preferred", F.lit(0.0))}))
        rows = attach(sized, targets, ["source"]).withColumn("due", _due(most)).withColumn("v", _odds_rank(F.col("due") - F.floor("due"), F.col("u")))
        left = targets.join(rows.groupBy("source").agg(F.sum(F.floor("due") * F.col("size")).alias("sure")).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", (F.col("target") - F.col("sure")).alias("left"))
        left = cut(left)
        rows = rows.where("v is not null").select("source", "size", "v", F.floor(F.col("v") * BINS).alias("b1"), F.floor(F.col("v") * BINS * BINS).alias("b2"))

        # Where the ordered sizes cross what is left: first among BINS sums of a source, then among
        # the BINS parts of that bin, then among the few rows of one part. No task orders a source.
        def crossing(sums: DataFrame, name: str) -> DataFrame:
            w = Window.partitionBy("source").orderBy(name)
            run = sums.withColumn("before", F.sum("s").over(w) - F.col("s") + F.col("done"))
            return attach(run, left, ["source"]).where("before <= left").groupBy("source").agg(F.max(name).alias(f"{name}x"), F.max("before").alias("done"))

        zero = F.lit(0).cast("long")
        one = cut(crossing(rows.groupBy("source", "b1").agg(F.sum("size").alias("s")).withColumn("done", zero), "b1"))
        inner = attach(rows, one, ["source"], "inner").where("b1 = b1x")
        two = cut(crossing(inner.groupBy("source", "b2").agg(F.sum("size").alias("s"), F.first("done").alias("done")), "b2"))
        part = attach(attach(rows, two, ["source"], "inner").where("b2 = b2x"), left, ["source"])
        ties = part.groupBy("source", "v", "done", "left").agg(F.sum("size").alias("s"))
        run = ties.withColumn("before", F.sum("s").over(Window.partitionBy("source").orderBy("v")) - F.col("s") + F.col("done"))
        last = run.where(F.col("before") + F.col("s") / 2 <= F.col("left")).groupBy("source").agg(F.max("v").alias("_last"))
        bounds = attach(targets, two.select("source", (F.col("b2x") / float(BINS * BINS)).alias("_below")), ["source"])
        bounds = stored(attach(bounds, last, ["source"]), "bounds", lasting=True)

    out = attach(docs.select(packed(docs, name), "source", words("text").alias("size"), u.alias("u"), share.alias("share")), bounds, ["source"]).withColumn("prefer", liked)
    out = out.withColumn("due", _due(most)).withColumn("v", _odds_rank(F.col("due") - F.floor("due"), F.col("u")))
    extra = F.coalesce((F.col("v") < F.col("_below")) | (F.col("v") <= F.coalesce("_last", F.lit(-1.0))), F.lit(False)).cast("long")
    out = out.withColumn("copies", F.floor("due") + extra)
    return out.select("row.*", F.struct("size", "source_size", F.col("target").cast("double").alias("target"), "copies", (F.col("copies") * F.col("size")).alias("taken")).alias(name))


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each row of `documents` the mix takes; shorter texts of a source have better odds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return pareto_mix(docs, prefer=shorter_first).select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "mix.copies")


QUERIES = {"op10_pareto_mix": op10_pareto_mix}
ORACLES: dict[str, str] = {}
