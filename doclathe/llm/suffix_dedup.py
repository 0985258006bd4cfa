"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import attach, begin, bounded_batches, is_small, packed, scratch, stored, table

LENGTH = 400
#: Most anchors that are sent to every executor: one long each.
ANCHORS = 1_000_000
#: Suffixes of a bucket, about; a task sorts one bucket at a time.
BUCKET = 150_000
#: Bytes of a text that are looked at in one go, besides an overlap.
SLICE = 1 << 18
#: Rows of a batch that a worker returns, about.
ROWS = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)
_ALL = ~np.uint64(0)
#: A run (start, n) as one number: start * 2**20 + 2 * n, plus 1 if its strings are asked about.
_RUN = 20


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _ODD and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_ODD), -1, 2**64))
    return tuple(np.cumprod(np.append(np.ones(1, np.uint64), np.full(n - 1, x))) for x in (_ODD, inverse))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashed:
    """Hashes of any substrings of 8 bytes or more of some bytes, each by a subtraction and a product.

    The sums are of mixed hashes of all 8 bytes in a row, so that regular texts have no
    regular sums.
    """

    def __init__(self, data: bytes) -> None:
        x = np.frombuffer(data, np.uint8).astype(np.uint64)
        for n in (1, 2, 4):  # 2, 4, 8 bytes from each place on
            x = x[:-n] | (x[n:] << np.uint64(8 * n))
        self.up, down = _powers(1 << len(data).bit_length())
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(x + _ODD) * down[: len(x)], dtype=np.uint64)))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end - 7] - self.sums[start]) * self.up[start])


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours."""
    n = len(h) - w + 1
    rows = np.concatenate((h, np.full(-len(h) % w, _ALL))).reshape(-1, w)
    to = np.minimum.accumulate(rows, axis=1).ravel()
    since = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[:n], to[w - 1 : w - 1 + n])


def segments(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """The starts of `length` bytes in runs with one anchor: anchor, content, start, count.

    A string's anchor is the least hash among its pieces of some 0.64 of its length, so equal
    strings have equal anchors at equal places, the first of equal hashes. content is the hash of all that a run's strings cover.
    """
    k = length * 16 // 25
    of = Hashed(data).of
    at = np.arange(len(data) - k + 1)
    h = of(at, at + k)
    m = _least(h, length - k + 1)
    # a run ends where the least hash changes, or where it stands at the start and so is left behind
    start = np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (h[: len(m) - 1] == m[:-1])))
    count = np.diff(np.append(start, len(m)))
    content = of(start, start + count - 1 + length) ^ _mixed(count.astype(np.uint64))
    return m[start], content, start, count


def _batch(names: list[str], cols: list[np.ndarray], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c, t) for c, t in zip(cols, types)], names=names)


def digest(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _anchored(docs: DataFrame, length: int) -> DataFrame:
    """Rows (digest, anchor, content, start, n): the runs of each text of `length` bytes or more."""
    names, types = ["anchor", "content", "start", "n"], [pa.int64()] * 4

    def flush(own: list[tuple]) -> pa.RecordBatch:
        rest = _batch(names, [np.concatenate([x[c] for x in own]) for c in (1, 2, 3, 4)], types)
        whose = pa.array([d for d, *_ in own], pa.binary()).take(pa.array(np.repeat(np.arange(len(own)), [len(x[1]) for x in own])))
        return pa.RecordBatch.from_arrays([whose, *rest.columns], names=["digest", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("suffixes")
        for b in batches:
            own, held = [], 0
            for d, t in zip(b.column("digest"), b.column("text")):
                data = t.as_py().encode()
                for lo in range(0, len(data) - length + 1, SLICE):
                    m, content, start, n = segments(data[lo : lo + SLICE + length - 1], length)
                    own.append((d.as_py(), m, content, start + lo, n))
                    held += len(m)
                    if held >= ROWS:
                        yield flush(own)
                        own, held = [], 0
            if own:
                yield flush(own)

    return docs.select("digest", "text").mapInArrow(run, "digest binary, anchor long, content long, start long, n long")


def _suffixes(texts: DataFrame, length: int) -> DataFrame:
    """Suffixes (t0, t1, doc, at) of rows (doc, text, runs): two leading tokens of half `length` bytes each, hashed.

    at is twice the place, plus 1 if the answer is wanted.
    """
    half, names, types = length // 2, ["t0", "t1", "doc", "at"], [pa.int64()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("suffixes")
        for b in batches:
            own, held = [], 0
            for doc, t, r in zip(b.column("doc").to_pylist(), b.column("text"), b.column("runs")):
                data, runs = t.as_py().encode(), np.sort(r.values.to_numpy())
                start, n, wanted = runs >> _RUN, (runs & ((1 << _RUN) - 1)) >> 1, runs & 1
                for part in np.split(np.arange(len(runs)), np.flatnonzero(np.diff(start // SLICE)) + 1):
                    lo = int(start[part[0]])
                    of = Hashed(data[lo : int(start[part[-1]] + n[part[-1]]) - 1 + length]).of
                    size = n[part]
                    at = np.arange(size.sum()) + np.repeat(start[part] - lo - (np.cumsum(size) - size), size)
                    own.append((of(at, at + half), of(at + half, at + length), np.full(len(at), doc), 2 * (at + lo) + np.repeat(wanted[part], size)))
                    held += len(at)
                    if held >= ROWS:
                        yield _batch(names, [np.concatenate(c) for c in zip(*own)], types)
                        own, held = [], 0
            if own:
                yield _batch(names, [np.concatenate(c) for c in zip(*own)], types)

    return texts.select("doc", "text", "runs").mapInArrow(run, "t0 long, t1 long, doc long, at long")


def multikey_order(keys: list[np.ndarray], few: int = 2048) -> np.ndarray:
    """Places of rows in the order of several keys, by multikey quicksort.

    Rows are parted into less than, equal to and greater than a pivot of their current token;
    only those equal go on to the next one. Few rows are ordered directly.
    """
    done, stack = [], [(np.arange(len(keys[0])), 0)]
    while stack:
        rows, k = stack.pop()
        if k == len(keys) or len(rows) < 2:
            done.append(rows)
        elif len(rows) <= few:
            done.append(rows[np.lexsort([x[rows] for x in keys[: k - 1 if k else None : -1]])])
        else:
            v = keys[k][rows]
            pivot = np.sort(v[[0, len(v) // 4, len(v) // 2, 3 * len(v) // 4, -1]])[2]
            stack += [(rows[v > pivot], k), (rows[v == pivot], k + 1), (rows[v < pivot], k)]
    return np.concatenate(done) if done else np.arange(0)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's suffixes, sorted here, those that a neighbour equals; and its first and last, marked as edge.

    A suffix that stands alone at an edge may go on in the next bucket; within a bucket two
    neighbours decide.
    """
    begin("suffixes")
    cols = ("t0", "t1", "doc", "at")
    got = [[b.column(c).to_numpy() for c in cols] for b in batches if b.num_rows]
    if not got:
        return
    rows = [np.concatenate(x) for x in zip(*got)]
    order = multikey_order(rows)
    rows = np.stack([x[order] for x in rows])
    rows = rows[:, np.append(True, (rows[:, 1:] != rows[:, :-1]).any(axis=0))]  # repeated rows of a text count once
    eq = (rows[:2, 1:] == rows[:2, :-1]).all(axis=0)
    twin = (np.append(False, eq) | np.append(eq, False)) & (rows[3] % 2 == 1)
    for part, edge in ((rows[:, twin], False), (rows[:, [0, -1]], True)):
        for lo in range(0, part.shape[1], ROWS):
            own = part[:, lo : lo + ROWS]
            yield pa.RecordBatch.from_arrays([*map(pa.array, own), pa.array(np.full(own.shape[1], edge))], names=[*cols, "edge"])


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """Where texts (digest, text) repeat: digest, starts (of repeated strings), runs (of them, as numbers).

    Texts of equal digest are one text here; repeats are counted within and between texts.

    1. Each text's strings are dealt into runs with one anchor, and anchors that occur once
       are dropped: their strings are unique.
    2. Runs that as a whole occur twice are repeated, each of their strings.
    3. The other runs, and one of each kind of the repeated ones, become suffixes of two
       tokens. Sampled splitters range-partition them by these, each bucket is sorted by
       multikey quicksort and its neighbours are compared, and the bucket edges are compared
       across boundaries.
    """
    spark = texts.sparkSession
    place = F.xxhash64("digest", "start")
    long_ones = texts.where(F.octet_length("text") >= length)
    with scratch(spark):
        with scratch(spark):
            runs = stored(_anchored(long_ones, length).withColumn("place", place), "runs")
            often = runs.groupBy("anchor").agg(F.min("place").alias("a"), F.max("place").alias("b")).where("a <> b").select("anchor")
            often = stored(often, "anchors")
            often = F.broadcast(often) if is_small(often, ANCHORS) else often
            live = stored(runs.join(often, "anchor", "left_semi"), "live", lasting=True)
        with scratch(spark):
            kinds = stored(live.groupBy("anchor", "content").agg(F.min("place").alias("first"), F.max("place").alias("last")), "kinds")
            mixed = stored(kinds.groupBy("anchor").count().where("count > 1").select("anchor", F.lit(True).alias("mixed")), "mixed")
            kinds = attach(kinds, mixed, ["anchor"]).select("anchor", "content", "first", (F.col("first") != F.col("last")).alias("repeated"), F.coalesce("mixed", F.lit(False)).alias("mixed"))
            kinds = stored(kinds.where("repeated or mixed"), "kinds")
            number = F.shiftleft("start", _RUN) + 2 * F.col("n")
            live = stored(attach(live, kinds, ["anchor", "content"], "inner").select("digest", number.alias("run"), "repeated", (F.col("mixed") & (F.col("first") == F.col("place"))).alias("asked")), "asked", lasting=True)
        whole = live.where("repeated").groupBy("digest").agg(F.collect_set("run").alias("runs"))
        asked = live.where("asked").select("digest", (F.col("run") + F.when(F.col("repeated"), 0).otherwise(1)).alias("run"))
        wanted = stored(asked.groupBy("digest").agg(F.collect_set("run").alias("runs")).withColumn("doc", F.monotonically_increasing_id()), "wanted")
        names = wanted.select("digest")
        some = long_ones.join(F.broadcast(names), "digest", "left_semi") if is_small(names) else long_ones
        n = wanted.agg(F.sum(F.aggregate("runs", F.lit(0).cast("long"), lambda x, r: x + F.shiftright(r.bitwiseAND((1 << _RUN) - 1), 1)))).first()[0] or 0
        hits = _repeated(_suffixes(some.join(wanted, "digest"), length), n)
        starts = hits.groupBy("doc").agg(F.collect_set(F.shiftright("at", 1)).alias("starts"))
        starts = starts.join(wanted.select("doc", "digest"), "doc").select("digest", "starts")
        return stored(starts.join(whole, "digest", "full_outer").select("digest", "starts", "runs"), "spans", lasting=True)


def _short_windows(texts: DataFrame, length: int, words: int) -> DataFrame:
    """Rows (t0, t1, doc, at, digest): each run of `words` words of under `length` bytes, as two tokens.

    at is twice (place * length + bytes), plus 1. Each row of texts is a document.
    """
    names, types = ["t0", "t1", "doc", "at"], [pa.int64()] * 4

    def windows(data: bytes, lo: int) -> tuple[np.ndarray, ...]:
        """Those that start in [lo, lo + SLICE): starts, lengths, tokens."""
        first = max(0, lo - 1)
        part = data[first : lo + SLICE + length + 1]
        codes = np.frombuffer(part, np.uint8)
        inner = np.concatenate(([False], (codes != 0x20) & ((codes < 0x09) | (codes > 0x0D)), [False]))
        start, end = (np.flatnonzero(x) for x in (inner[1:] & ~inner[:-1], inner[:-1] & ~inner[1:]))
        start, end = start[: max(0, len(start) - words + 1)], end[words - 1 :]
        own = (end - start < length) & (start + first >= lo) & (start + first < lo + SLICE)
        start, end = start[own], end[own]
        if not len(start):
            return start, end, start, end
        of, half = Hashed(part).of, (start + end) // 2
        return start + first, end - start, of(start, half), of(half, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("suffixes")
        for b in batches:
            for doc, d, t in zip(b.column("doc").to_pylist(), b.column("digest"), b.column("text")):
                data = t.as_py().encode()
                for lo in range(0, len(data), SLICE):
                    start, size, t0, t1 = windows(data, lo)
                    if len(start):
                        rows = _batch(names, [t0, t1, np.full(len(start), doc), 2 * (start * length + size) + 1], types)
                        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([d.as_py()] * len(start), pa.binary())], names=[*names, "digest"])

    numbered = texts.withColumn("doc", F.monotonically_increasing_id())
    return numbered.select("doc", "digest", "text").mapInArrow(run, "t0 long, t1 long, doc long, at long, digest binary")


def repeated_windows(texts: DataFrame, length: int, words: int) -> DataFrame:
    """Where runs of `words` words of under `length` bytes repeat: digest, short, as pairs of start and length in turn.

    texts has digest and text. Words have one byte at least, so `words` of them 2 * words - 1,
    and the tokens 8 or more.
    """
    if words < 9:
        raise ValueError("runs of under 9 words are too short for tokens")
    spark = texts.sparkSession
    with scratch(spark):
        windows = stored(_short_windows(texts, length, words), "windows")
        hits = _repeated(windows.select("t0", "t1", "doc", "at"), windows.count())
        place = F.shiftright("at", 1)
        span = F.array(F.floor(place / length).cast("long"), (place % length).cast("long"))
        whose = windows.select("doc", "digest").distinct()
        return stored(hits.join(whose, "doc").groupBy("digest").agg(F.flatten(F.collect_set(span)).alias("short")), "short", lasting=True)


def _repeated(suffixes: DataFrame, n: int) -> DataFrame:
    """Rows (doc, at) of the wanted ones of n suffixes (t0, t1, doc, at) that equal another, by ranges of sampled splitters."""
    parts = max(int(suffixes.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET))
    found = stored(suffixes.repartitionByRange(parts, "t0", "t1", "doc", "at").mapInArrow(_neighbours, "t0 long, t1 long, doc long, at long, edge boolean"), "found")
    edges = found.where("edge")
    across = edges.groupBy("t0", "t1").agg(F.min(F.xxhash64("doc", "at")).alias("a"), F.max(F.xxhash64("doc", "at")).alias("b")).where("a <> b").select("t0", "t1")
    return found.where("not edge").select("doc", "at").unionByName(edges.join(across, ["t0", "t1"], "left_semi").where("at % 2 = 1").select("doc", "at"))


def _spans(starts, runs, short, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed stretches, from and to."""
    number = lambda x: np.asarray(() if x is None else x, np.int64)
    starts, runs, short = number(starts), number(runs), number(short)
    a = np.concatenate((starts, runs >> _RUN, short[::2]))
    b = np.concatenate((starts + length, (runs >> _RUN) + ((runs & ((1 << _RUN) - 1)) >> 1) - 1 + length, short[::2] + short[1::2]))
    order = np.argsort(a)
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.append(True, a[1:] > b[:-1])
    return a[new], b[np.append(new[1:], True)]


_CUT = T.StructType([T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())])


def _cut_out(length: int):
    @F.pandas_udf(_CUT)
    def run(text: pd.Series, starts: pd.Series, runs: pd.Series, short: pd.Series) -> pd.DataFrame:
        begin("suffixes")
        rows = []
        for t, *own in zip(text, starts, runs, short):
            data, kept, at = t.encode(), [], 0
            a, b = _spans(*own, length)
            for x, y in zip(a.tolist(), b.tolist()):
                kept.append(data[at:x])
                at = y
            kept = b"".join([*kept, data[at:]])
            rows.append((len(data) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore")))
        return pd.DataFrame(rows, columns=_CUT.names)

    # filters on the result stay behind it; before it, they would run it twice, in two workers a task
    return run.asNondeterministic()


def dedup(docs: DataFrame, length: int = LENGTH, words: int | None = None, name: str = "cut") -> DataFrame:
    """Adds to each document the column `name`: n_bytes, n_removed, n_spans, kept_sha256, kept_text.

    A byte is removed if a string of `length` bytes (32 or more) over it also starts anywhere
    else in any document, the same one included; all copies go. Texts are taken as UTF-8
    bytes, null as empty. With `words` (9 or more), a byte also goes if so many words over it,
    from the first one's start to the last one's end, stand anywhere else, however short.
    kept_sha256 is of the bytes left; kept_text drops what is left of a character that was cut
    in two. Documents alike, repeated rows included, are copies of each other: from `length`
    bytes on they go whole. No rows give none. All columns of the input stay, but for one of
    that name.
    """
    if length < 32:
        raise ValueError("strings of under 32 bytes are too short for tokens")
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(packed(docs, name), text.alias("text")).withColumn("digest", digest(F.col("text"))).withColumn("n_bytes", F.octet_length("text").cast("long"))
    with scratch(spark):
        copies = stored(rows.where(F.col("n_bytes") >= length).groupBy("digest").count().where("count > 1").select("digest", F.lit(1).alias("kind")), "copies")
        spans = repeated_spans(rows.select("digest", "text"), length)
        if words is None:
            spans = spans.withColumn("short", F.lit(None).cast("array<long>"))
        else:
            # runs of words of `length` bytes or more are found as strings
            spans = spans.join(repeated_windows(rows.select("digest", "text"), length, words), "digest", "full_outer")
        spans = stored(attach(spans, copies, ["digest"]).where("kind is null").drop("kind"), "spans", lasting=True)
        kinds = stored(copies.unionByName(spans.select("digest", F.lit(2).alias("kind"))), "kinds", lasting=True)
    marked = attach(rows, kinds, ["digest"])
    zero = F.lit(0).cast("long")
    gone = F.col("kind") == 1
    plain = marked.where("kind is null or kind = 1").select(
        "row",
        F.struct("n_bytes", F.when(gone, F.col("n_bytes")).otherwise(zero).alias("n_removed"), F.when(gone, zero + 1).otherwise(zero).alias("n_spans"), F.sha2(F.when(gone, "").otherwise(F.col("text")), 256).alias("kept_sha256"), F.when(gone, "").otherwise(F.col("text")).alias("kept_text")).alias(name),
    )
    some = marked.where("kind = 2").join(spans, "digest").withColumn("c", _cut_out(length)("text", "starts", "runs", "short"))
    return plain.unionByName(some.select("row", F.struct("n_bytes", "c.n_removed", "c.n_spans", "c.kept_sha256", "c.kept_text").alias(name))).select("row.*", name)


def op9_suffix_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is cut from each document of `documents`: one row for each of its rows, null texts as empty."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "cut.n_bytes", "cut.n_removed", "cut.n_spans", "cut.kept_sha256")


QUERIES = {"op9_suffix_ranges": op9_suffix_ranges}
ORACLES: dict[str, str] = {}
