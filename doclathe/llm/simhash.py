"""SimHash near-dedup: fingerprints linked through Gray-ordered hierarchical indexes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import attach, begin, bounded_batches, components, cut, packed, scratch, stored, table

SEED = 42
FAN = 16
#: Buckets of more fingerprints are split once more.
BUCKET = 2048


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of each run of k words, repeats included, of the text with A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, "<u8")
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], "<u8")
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - k + 1]
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[k - 1 :].tolist())), "<u8", len(starts))


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        part = hashes[i : i + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint(text: Column | str, k: int = 3) -> Column:
    """64-bit SimHash of a text's k-word shingles, as a long. Null and blank texts: 0."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([simhash(shingle_hashes(t, k)) for t in texts], dtype="int64")

    return run(text)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each number in the reflected Gray code: neighbours there differ in one bit."""
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def close_pairs(fps: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of distinct uint64 fingerprints in Gray order at most `bits` apart.

    Hierarchical index: FAN neighbours in Gray order make a node, FAN nodes a node above. A
    node keeps the bits that all below it share and that no node above keeps, so a query adds
    up its differences on the way down, and leaves a whole group once they exceed `bits`.
    Queries go in blocks, which bounds the pairs held at a time.
    """
    levels = [(np.full(len(fps), ~np.uint64(0)), fps)]
    while len(levels[-1][1]) > 1:
        mask, val = levels[-1]
        at = np.arange(0, len(val), FAN)
        mask = np.bitwise_and.reduceat(mask, at) & ~np.bitwise_or.reduceat(val ^ np.repeat(val[at], np.diff(np.append(at, len(val)))), at)
        levels.append((mask, val[at] & mask))
    own = [(levels[k][0] & ~np.repeat(levels[k + 1][0], FAN)[: len(levels[k][0])]) if k + 1 < len(levels) else levels[k][0] for k in range(len(levels))]
    for lo in range(0, len(fps), 512):
        q = np.arange(lo, min(lo + 512, len(fps)))
        node, gone = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            gone = gone + np.bitwise_count((fps[q] ^ levels[k][1][node]) & own[k][node])
            fit = (gone <= bits) & ((node + 1) * FAN**k - 1 > q)
            q, node, gone = q[fit], node[fit], gone[fit]
            if k:
                below = (node[:, None] * FAN + np.arange(FAN)).ravel()
                q, gone = np.repeat(q, FAN), np.repeat(gone, FAN)
                fit = below < len(levels[k - 1][1])
                q, node, gone = q[fit], below[fit], gone[fit]
        if len(q):
            yield q, node


def _forest(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (from, to) that connect what close pairs connect: one for each fingerprint but the last."""
    fps = fps[np.argsort(gray_rank(fps))]
    root = np.arange(len(fps))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b in close_pairs(fps, bits):
        for i, j in zip(a.tolist(), b.tolist()):
            i, j = top(i), top(j)
            if i != j:
                root[max(i, j)] = min(i, j)
    linked = np.flatnonzero(root != np.arange(len(fps)))
    return fps[linked], fps[root[linked]]


def _runs(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, fp) with each bucket's rows together: links within the buckets."""
    begin("simhash")
    rest_k, rest_f = np.empty(0, np.int64), np.empty(0, np.uint64)

    def flush(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(keys):
            return
        at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        size = np.diff(np.append(at, len(keys)))
        got = [_forest(fps[s : s + n], bits) for s, n in zip(at[size > 1], size[size > 1])]
        a = np.concatenate([x for x, _ in got] or [fps[:0]])
        b = np.concatenate([x for _, x in got] or [fps[:0]])
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    for batch in batches:
        k = np.concatenate([rest_k, batch.column("bucket").to_numpy(zero_copy_only=False)])
        f = np.concatenate([rest_f, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(k):
            continue
        last = len(k) if k[0] != k[-1] else 0
        if last:
            last = int(np.flatnonzero(k != k[-1])[-1]) + 1
        yield from flush(k[:last], f[:last])
        rest_k, rest_f = k[last:], f[last:]
    yield from flush(rest_k, rest_f)


def _blocks(bits: int, of: list[int]) -> list[list[int]]:
    """The bit numbers in bits + 1 parts: numbers at most `bits` apart agree in one part at least."""
    n = len(of)
    return [of[n * i // (bits + 1) : n * (i + 1) // (bits + 1)] for i in range(bits + 1)]


def _value(fp: Column, block: list[int]) -> Column:
    return F.shiftrightunsigned(fp, block[0]).bitwiseAND((1 << len(block)) - 1)


def fingerprint_links(fps: DataFrame, bits: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp), which connect all that are at most `bits` apart.

    Fingerprints are dealt by the value of each of bits + 1 blocks; two close ones share a
    bucket at least. A bucket of over `bucket` fingerprints is dealt anew by blocks of the
    bits that aren't shared yet, again and again, until it is small or few bits are left, so
    no bucket exceeds a task. Each bucket builds a Gray-ordered index and emits a spanning
    forest of its close pairs.
    """
    n = bits + 1
    live = fps.select("fp", F.lit(0).cast("long").alias("path"), F.lit(0).alias("way"))
    # way: which blocks were taken so far, in base n; path: a hash of the values shared by them
    ways: dict[int, list[int]] = {0: list(range(64))}
    done = None
    while True:
        parts = {w * n + i + 1: (b, [x for x in bitsleft if x not in b]) for w, bitsleft in ways.items() for i, b in enumerate(_blocks(bits, bitsleft))}
        way_of = F.col("way") * n
        deal = []
        for i in range(n):
            value = F.coalesce(*[F.when(F.col("way") == w, _value_of(F.col("fp"), _blocks(bits, left)[i])) for w, left in ways.items()])
            deal.append(F.struct((way_of + i + 1).alias("way"), F.xxhash64("path", way_of + i + 1, value).alias("path")))
        live = live.select("fp", F.explode(F.array(*deal)).alias("d")).select("fp", "d.path", "d.way")
        ways = {w: left for w, (_, left) in parts.items()}
        hot = cut(live.groupBy("path", "way").count().where(F.col("count") > bucket).select("path", "way", F.lit(True).alias("hot")))
        if hot.isEmpty() or min(map(len, ways.values())) <= 18:
            done = live if done is None else done.unionByName(live)
            break
        marked = cut(attach(live, hot, ["path", "way"]))
        cold = marked.where("hot is null").drop("hot")
        done = cold if done is None else done.unionByName(cold)
        live = marked.where("hot").drop("hot")
    rows = done.select(F.col("path").alias("bucket"), "fp").repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(lambda b: _runs(b, bits), "a long, b long")


def _value_of(fp: Column, block: list[int]) -> Column:
    """The value of a block of bits, which may stand in several runs."""
    out, at = None, 0
    i = 0
    while i < len(block):
        j = i
        while j + 1 < len(block) and block[j + 1] == block[j] + 1:
            j += 1
        part = F.shiftleft(_value(fp, block[i : j + 1]), at)
        out = part if out is None else out.bitwiseOR(part)
        at += j + 1 - i
        i = j + 1
    return out


def link_fingerprints(rows: DataFrame, bits: int = 2) -> DataFrame:
    """Rows (doc_id, fp) with component_id: the least doc_id of those reachable over links.

    Equal fingerprints are linked. Rows alike stay separate rows; null ids count for no
    component_id, which is null where a component has no other.
    """
    rows = cut(rows.select("doc_id", "fp"))
    least = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(fingerprint_links(least.select("fp"), bits))
    named = least.join(roots, least.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


#: Bands and rows of the supplementary sketch.
BANDS, ROWS = 24, 4
_A = np.random.default_rng(24).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def _sketch(hashes: np.ndarray) -> np.ndarray:
    """Least value of the hashes under BANDS * ROWS orders, 32 bits each."""
    out = np.full(len(_A), ~np.uint32(0), np.uint32)
    for i in range(0, len(hashes), 1024):
        part = (hashes[i : i + 1024, None] * _A) >> np.uint64(32)
        out = np.minimum(out, part.min(axis=0).astype(np.uint32))
    return out


def _features(docs: DataFrame, k: int) -> DataFrame:
    """Rows (doc_id, kind, fp, sketch, bands): kind is a hash of the lower-cased words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("simhash")
        for b in batches:
            kinds, fps, sketches, bands = [], [], [], []
            for t in b.column("text").to_pylist():
                kinds.append(xxhash.xxh3_128_digest(b" ".join((t or "").encode().lower().split())))
                h = shingle_hashes(t, k)
                fps.append(simhash(h))
                s = _sketch(h)
                sketches.append(s.tobytes())
                bands.append([xxhash.xxh64_intdigest(s[ROWS * i : ROWS * (i + 1)].tobytes(), i) - (1 << 63) for i in range(BANDS)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(kinds, pa.binary()), pa.array(fps, pa.int64()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "kind", "fp", "sketch", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, kind binary, fp long, sketch binary, bands array<long>")


#: Most kinds of a block, whose pairs one task compares; larger groups are dealt over more blocks.
BLOCK = 512


def _exhausted(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows of tasks (task, at, side, kind, root, sketch), each task's together: those in a pair that may be alike.

    Pairs are of sides 0 and 1, or within side 2; of different roots; and their first common
    band is the one at place `at`. With the shingle sets (own) the pairs are decided, and
    links (a, b) are returned that connect all that are alike.
    """
    begin("simhash")
    held: list[pa.RecordBatch] = []

    def groups() -> Iterator[pa.Table]:
        for batch in batches:
            task = batch.column("task").to_numpy()
            for lo, hi in zip(ends := [0, *(np.flatnonzero(task[1:] != task[:-1]) + 1).tolist()], [*ends[1:], len(task)]):
                if held and lo < hi and held[-1].column("task")[0].as_py() != task[lo]:
                    yield pa.Table.from_batches(held)
                    held.clear()
                if lo < hi:
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield pa.Table.from_batches(held)

    for rows in groups():
        kinds, names = rows.column("kind").to_pylist(), rows.column("root").to_pylist()
        side, band = rows.column("side").to_numpy(), rows.column("at")[0].as_py()
        number = {r: i for i, r in enumerate(dict.fromkeys(names))}
        root = np.array([number[r] for r in names])
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint32).reshape(len(kinds), -1)
        decide = "own" in rows.column_names
        if decide:
            own = rows.column("own").combine_chunks()
            at = own.offsets.to_numpy() - own.offsets[0].as_py()
            values, tokens = np.unique(own.flatten().to_numpy(), return_inverse=True)
            mark, size = np.zeros(len(values), bool), np.diff(at)
        asked, links = np.zeros(len(kinds), bool), []
        for i in range(len(kinds)):
            others = np.flatnonzero((side == 1 if side[i] == 0 else (side == 2) & (np.arange(len(side)) > i)) & (root != root[i])) if side[i] != 1 else ()
            if not len(others):
                continue
            equal = sketch[others] == sketch[i]
            common = equal.reshape(-1, BANDS, ROWS).all(axis=2)
            others = others[(equal.mean(axis=1) >= similarity - 0.2) & common.any(axis=1) & (common.argmax(axis=1) == band)]
            if not decide:
                asked[others] = True
                asked[i] |= len(others) > 0
                continue
            mark[tokens[at[i] : at[i + 1]]] = True
            for j in others.tolist():
                if root[i] != root[j] and min(size[i], size[j]) >= similarity * max(size[i], size[j]):
                    shared = np.count_nonzero(mark[tokens[at[j] : at[j + 1]]])
                    if shared >= similarity * (size[i] + size[j] - shared):
                        links.append((kinds[i], kinds[j]))
                        root[root == root[j]] = root[i]
            mark[tokens[at[i] : at[i + 1]]] = False
        if decide:
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.binary()) for c in (0, 1)], names=["a", "b"])
        elif asked.any():
            yield from rows.filter(pa.array(asked)).combine_chunks().to_batches()


def _dealt(rest: DataFrame, block: int) -> DataFrame:
    """Rows (kind, root, band, at) as rows (task, at, side, kind, root) whose tasks meet all pairs of different roots in a band.

    A band's kinds are dealt into blocks of some `block`: those of a root with more of them by
    themselves, the others together. Each two blocks are a task, except two of one root.
    """
    per = stored(rest.groupBy("band", "root").agg(F.count("*").alias("n")), "roots")
    per = per.join(per.groupBy("band").agg(F.count("*").alias("roots")).where("roots > 1").select("band"), "band", "left_semi")
    own = F.when(F.col("n") > block, F.col("root")).otherwise(F.lit(b""))
    per = per.select("band", "root", "n", own.alias("own"))
    sizes = stored(per.groupBy("band", "own").agg(F.ceil(F.sum("n") / block).cast("long").alias("salts")), "sizes")
    blocks = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select("band", F.struct("own", "salt").alias("x"))
    two = blocks.join(blocks.withColumnRenamed("x", "y"), "band").where((F.col("x") <= F.col("y")) & ((F.col("x.own") != F.col("y.own")) | (F.length("x.own") == 0)))
    ends = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.lit(2).alias("side"), F.col("x").alias("x")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("x")), F.struct(F.lit(1).alias("side"), F.col("y").alias("x"))))
    tasks = two.select("band", F.xxhash64("band", "x", "y").alias("task"), F.explode(ends).alias("e")).select("band", "task", "e.side", "e.x.own", "e.x.salt")
    salted = rest.join(per.select("band", "root", "own"), ["band", "root"]).join(sizes, ["band", "own"]).withColumn("salt", F.pmod(F.xxhash64("kind"), F.col("salts")))
    return salted.join(tasks, ["band", "own", "salt"]).select("task", "at", "side", "kind", "root")


@F.pandas_udf(T.DoubleType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal places of two sketches."""
    x, y = (np.frombuffer(b"".join(s), np.uint32).reshape(-1, len(_A)) for s in (a, b))
    return pd.Series((x == y).mean(axis=1))


def _shingle_sets(k: int):
    @F.pandas_udf("array<long>")
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, k)).view("<i8") for t in text])

    return run


def near_links(docs: DataFrame, k: int = 5, similarity: float = 0.8, bits: int = 2, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Kinds of texts (doc_id, kind), and links (a, b) between kinds of Jaccard likeness `similarity` or more.

    Candidates are kinds whose SimHash fingerprints the Gray-ordered index links, and, since
    fingerprints of 64 bits miss most pairs between 0.8 and 0.95, kinds that share a band of
    a min-wise sketch. A band's kinds are first compared with two of them: the one that meets
    most others over all its bands, and the one of least hash, which changes from band to
    band. Then each two kinds of a band that no links connect yet are compared as well, block
    by block, so that each pair that shares a band is linked, connected or refuted. Pairs
    whose sketches differ in over 0.2 more places than asked for go (of alike pairs fewer than
    one in a million); of the rest the shingle sets are compared, as 64-bit hashes.
    """
    rows = stored(_features(docs, k), "features")
    kinds = stored(rows.drop("doc_id").dropDuplicates(["kind"]), "kinds")
    banded = kinds.select("kind", F.posexplode("bands").alias("at", "band"))
    sizes = banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    banded = stored(banded.join(sizes, "band"), "bands")
    centre = banded.groupBy("kind").agg(F.sum("n").alias("met"))
    banded = banded.join(centre, "kind")
    hubs = banded.groupBy("band").agg(F.max_by("kind", F.struct("met", "kind")).alias("h1"), F.min_by("kind", F.xxhash64("kind", "band")).alias("h2"))
    met = banded.join(hubs, "band").select("kind", F.explode(F.array("h1", "h2")).alias("hub")).where("kind <> hub")
    by_fp = kinds.groupBy("fp").agg(F.min("kind").alias("kind"))
    links = fingerprint_links(by_fp.select("fp"), bits)
    named = by_fp.select(F.col("fp").alias("a"), F.col("kind").alias("kind")).join(links, "a").join(by_fp.select(F.col("fp").alias("b"), F.col("kind").alias("hub")), "b").select("kind", "hub")
    same_fp = kinds.join(by_fp.select("fp", F.col("kind").alias("hub")), "fp").where("kind <> hub").select("kind", "hub")
    pairs = met.unionByName(named).unionByName(same_fp).select(F.least("kind", "hub").alias("a"), F.greatest("kind", "hub").alias("b")).distinct()
    sketch = kinds.select("kind", "sketch")
    pairs = pairs.join(sketch.select(F.col("kind").alias("a"), F.col("sketch").alias("sa")), "a").join(sketch.select(F.col("kind").alias("b"), F.col("sketch").alias("sb")), "b")
    pairs = stored(pairs.where(_alike("sa", "sb") >= similarity - 0.2).select("a", "b"), "pairs")
    named = rows.select("doc_id", "kind")
    sets = _sets(docs, named, pairs.select(F.explode(F.array("a", "b")).alias("kind")), k)
    both = pairs.join(sets.select(F.col("kind").alias("a"), F.col("own").alias("oa")), "a").join(sets.select(F.col("kind").alias("b"), F.col("own").alias("ob")), "b")
    shared = F.size(F.array_intersect("oa", "ob"))
    links = stored(both.where(shared >= similarity * (F.size("oa") + F.size("ob") - shared)).select("a", "b"), "links")
    # the hubs have met their whole band; the others of it, by what is connected so far
    roots = components(links)
    rest = banded.join(hubs, "band").where("kind <> h1 and kind <> h2").select("kind", "band", "at")
    rest = stored(rest.join(roots, rest.kind == roots.node, "left").select("kind", "band", "at", F.coalesce("root", "kind").alias("root")), "rest")
    shape = "task long, at int, side int, kind binary, root binary, sketch binary"
    open_ = _dealt(rest, block).join(sketch, "kind").select("task", "at", "side", "kind", "root", "sketch")
    open_ = stored(open_.repartition("task").sortWithinPartitions("task").mapInArrow(lambda b: _exhausted(b, similarity), shape), "open")
    if open_.isEmpty():
        return named, links
    sets = _sets(docs, named, open_.select("kind"), k)
    more = open_.join(sets, "kind").repartition("task").sortWithinPartitions("task").mapInArrow(lambda b: _exhausted(b, similarity), "a binary, b binary")
    return named, links.unionByName(stored(more, "links"))


def _sets(docs: DataFrame, rows: DataFrame, kinds: DataFrame, k: int) -> DataFrame:
    """The shingle sets (kind, own) of the kinds asked for, from whole texts, one of each."""
    asked = stored(kinds.distinct(), "asked")
    one = stored(attach(rows, asked.withColumn("ask", F.lit(1)), ["kind"], "inner").groupBy("kind").agg(F.min("doc_id").alias("doc_id")), "one")
    texts = attach(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), one.select("doc_id", F.lit(1).alias("ask")).distinct(), ["doc_id"], "inner")
    sets = attach(texts.select(_kind("text").alias("kind"), _shingle_sets(k)("text").alias("own")), asked.withColumn("ask", F.lit(1)), ["kind"], "inner").select("kind", "own").dropDuplicates(["kind"])
    return stored(sets, "sets")


@F.pandas_udf(T.BinaryType())
def _kind(text: pd.Series) -> pd.Series:
    return pd.Series([xxhash.xxh3_128_digest(b" ".join((t or "").encode().lower().split())) for t in text])


def near_dedup(docs: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group of near copies, with all its columns: that of least doc_id.

    Texts of equal words (A-Z lower-cased) are copies; groups are what links of near_links
    reach. Null and blank texts are one group. A null doc_id counts as greater than others;
    of rows alike in doc_id and words one stays. No rows give none.
    """
    with scratch(docs.sparkSession):
        rows, links = near_links(docs, k, similarity)
        roots = components(links)
        least = rows.groupBy("kind").agg(F.min("doc_id").alias("doc_id"))
        grouped = least.join(roots, least.kind == roots.node, "left").select("kind", "doc_id", F.coalesce("root", "kind").alias("root"))
        stay = grouped.groupBy("root").agg(F.min_by("kind", F.struct(F.col("doc_id").isNull(), "doc_id", "kind")).alias("kind"))
        kept = stay.join(least, "kind").select("kind", "doc_id", F.lit(True).alias("stays"))
        each = rows.groupBy("kind", "doc_id").agg(F.count("*").alias("n"))
        marks = each.join(kept, each.kind.eqNullSafe(kept.kind) & each.doc_id.eqNullSafe(kept.doc_id), "left").select(each.kind, each.doc_id.alias("id"), "n", F.col("stays").isNotNull().alias("stays"))
        # only rows that go, or of which some go, are looked up
        marks = stored(marks.where("not stays or n > 1").select("kind", "id", F.col("stays").alias("again")), "marks", lasting=True)
    named = docs.select(packed(docs), F.col("doc_id").cast("long").alias("id"), _kind("text").alias("kind"))
    out = attach(named, marks, ["kind", "id"])
    return out.where("again is null").select("row.*").unionByName(out.where("again").dropDuplicates(["kind"]).select("row.*"))


def op2_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of each row of `documents`; null and blank texts have fingerprint 0."""
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", fingerprint("text").alias("fp"))
    return link_fingerprints(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op2_gray_index": op2_gray_index}
ORACLES: dict[str, str] = {}
