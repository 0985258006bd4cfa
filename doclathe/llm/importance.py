"""Importance resampling towards a target corpus, on hashed n-grams of words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import begin, bounded_batches, packed, ranked, scratch, stored, table, unused

#: Letters A-Z lower-cased, digits, a-z and all bytes of other code points kept; the rest parts words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of a text that are split into words at a time, and buckets of a row that is written.
PIECE, BLOCK = 1 << 20, 1 << 18
BUCKETS = 10_000


class Ring:
    """Running CRC-32 states of the runs that began at each of the last n words.

    A further word extends each state by a space and itself, and begins one of its own; a state
    of n words is dropped. `take` gives the CRC of every run that ends in the word.
    """

    def __init__(self, n: int):
        self.n, self.states = n, []

    def take(self, words: list[bytes]) -> list[int]:
        crc = zlib.crc32
        if self.n == 1:
            return list(map(crc, words))
        out, states = [], self.states
        for w in words:
            spaced = b" " + w
            states = [crc(spaced, s) for s in (states[-self.n + 1 :])]
            states.append(crc(w))
            out += states
        self.states = states
        return out


def scan(data: bytes, n: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """One scan of a text: words and buckets of a piece at a time, parted between words."""
    ring, at = Ring(n), 0
    data = data.translate(FOLD)
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        got = ring.take(words)
        for k in range(0, len(got), BLOCK):
            yield (0 if k else len(words)), (np.array(got[k : k + BLOCK], dtype=np.int64) % buckets).astype(np.int32)
        at = end


def _scanner(n: int, buckets: int):
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("words", pa.int64()), ("buckets", pa.list_(pa.int32()))])

    def batch(rows: list[tuple[int, int | None, int, np.ndarray]]) -> pa.RecordBatch:
        row, ids, words, got = zip(*rows)
        ends = np.cumsum([0, *map(len, got)], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(got)))
        return pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), pa.array(ids, pa.int64()), pa.array(words, pa.int64()), lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("importance")
        row, none = TaskContext.get().partitionId() << 33, np.zeros(0, np.int32)
        for b in batches:
            held, size = [], 0
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                blank = True
                for words, got in scan(text.as_py() or b"", n, buckets):
                    held.append((row, i, words, got))
                    size, blank = size + len(got), False
                    if size >= BLOCK:
                        yield batch(held)
                        held, size = [], 0
                if blank:
                    held.append((row, i, 0, none))
                row += 1
            if held:
                yield batch(held)

    return run


def features(texts: DataFrame, n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """Rows (row, doc_id, words, buckets) of texts (doc_id, text): one for each, more for very long ones.

    Words are runs of letters and digits of ASCII and of all other code points, A-Z
    lower-cased; features are the runs of 1 to n words, joined by a space, each as the
    unsigned CRC-32 of its UTF-8 bytes modulo `buckets`. `row` tells the texts apart.
    """
    data = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return data.mapInArrow(_scanner(n, buckets), "row long, doc_id long, words long, buckets array<int>")


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("importance")
        n = np.zeros(buckets, np.int64)
        for b in batches:
            n += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    return run


def counts(feats: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows (bucket, n): each partition counts for itself, and counts of at most `buckets` rows meet."""
    return feats.select("buckets").mapInArrow(_counted(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares, of every bucket: `buckets` numbers, whatever the data."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect():  # at most `buckets` rows
        s[r.bucket], t[r.bucket] = r.s, r.t
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _summed(gain: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("importance")
        for b in batches:
            lists = b.column("buckets")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            run_ = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy(zero_copy_only=False)])])
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), b.column("words"), pa.array(np.diff(ends)), pa.array(run_[ends[1:]] - run_[ends[:-1]])], names=["row", "doc_id", "words", "n_features", "gain"])

    return run


def noise(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), u made of the SHA-256 of `<seed>:<doc_id>`."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    u = (F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(u)))


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, seed: int = 2024, least: int = 20, percent: int = 10) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank), one for each of docs (doc_id, text).

    Each text of docs and target (text) is scanned once; its buckets are written and read for
    the counts and again for the weights. weight is the floored mean gain of a document's
    features, score is weight plus Gumbel noise, and of the N documents with `least` words or
    more the floor(percent N / 100) best scores get a rank from 1: drawing without replacement
    in proportion to exp(weight / 1000). Ties go to the smaller doc_id, null last.

    Null and empty texts have no features and weight 0; a null doc_id is read as empty by the
    noise; rows alike are documents of their own, with the same score and ranks in a row; no
    documents give no rows, and an empty target is a uniform one; other columns don't matter.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    with scratch(spark):
        feats = stored(features(docs.select("doc_id", "text"), n, buckets), "features")
        wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), n, buckets)
        gain = gains(counts(feats, buckets), counts(wanted, buckets), buckets)
        parts = feats.mapInArrow(_summed(gain), "row long, doc_id long, words long, n_features long, gain long")
        total = parts.groupBy("row").agg(F.first("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("words", "n_features", "gain")])
        mean = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
        scored = stored(total.select("row", "doc_id", "words", "n_features", mean.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
        fit = scored.where(F.col("words") >= least)
        drawn = fit.count() * percent // 100
        first = ranked(fit, F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row"), name="rank")
        rank = F.when(F.col("rank") < drawn, F.col("rank") + 1)
        every = first.select("doc_id", "n_features", "weight", "score", rank.alias("rank"))
        rest = scored.where(F.col("words") < least).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
        return stored(every.unionByName(rest), "resampled", lasting=True)


def drawn_documents(docs: DataFrame, target: DataFrame, name: str = "draw", **settings) -> DataFrame:
    """The drawn rows of docs, with all their columns and the struct `name` of weight, score and rank.

    Noise goes by a number that each row gets, so rows alike are drawn independently of each
    other, and doc_id may be anything.
    """
    name = unused(name, [c for c in docs.columns if c != name])
    numbered = docs.select(packed(docs, name), "doc_id", "text", F.monotonically_increasing_id().alias("_at"))
    held = stored(numbered, "numbered")
    got = resample(held.select(F.col("_at").alias("doc_id"), "text"), target, **settings)
    return held.join(got.where("rank IS NOT NULL").withColumnRenamed("doc_id", "_at"), "_at").select("row.*", F.struct("weight", "score", "rank").alias(name))


def op12_crc_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `documents` with its weight towards `benchmark`, and the rank of those drawn."""
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_crc_ring": op12_crc_ring}
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLES = {
    "op12_crc_ring": f"""
WITH said AS (SELECT doc_id, {_WORDS} AS words FROM documents),
doc_words AS (SELECT doc_id, unnest(words) AS word FROM said),
goal_words AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
crcs AS (SELECT word, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, octet_length(encode(word)) + 1), lambda k: CAST('0x' || substr(hex(encode(word)), 2 * k - 1, 2) AS BIGINT))),
  lambda s, b: list_reduce(list_prepend(xor(s, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 10000 AS bucket
  FROM (SELECT word FROM doc_words UNION SELECT word FROM goal_words)),
s AS (SELECT bucket, count(*) AS n FROM doc_words JOIN crcs USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM goal_words JOIN crcs USING (word) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln(CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * ((SELECT sum(n) FROM s) + 10000) / (CAST(s.n + 1 AS DOUBLE) * (coalesce((SELECT sum(n) FROM t), 0) + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
sums AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS gain FROM doc_words JOIN crcs USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
weighed AS (SELECT said.doc_id, CAST(len(words) AS BIGINT) AS n_features, CASE WHEN n IS NULL THEN 0 ELSE (gain - ((gain % n) + n) % n) // n END AS weight,
  CAST('0x' || left(sha256('2024:' || said.doc_id), 8) AS BIGINT) AS h FROM said LEFT JOIN sums USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / 4294967296))) AS BIGINT) AS score FROM weighed),
ordered AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 10 * n // 100 THEN k END AS rank FROM scored LEFT JOIN ordered USING (doc_id)"""
}
