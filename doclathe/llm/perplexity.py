"""Quality classifier: perplexity under a modified Kneser-Ney model of trusted text."""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import attach, cut, is_small, bounded_batches, scratch, stored, table

#: Bits of a code point: three of them make a trigram's number.
BITS = 21
ONE, TWO = (1 << BITS) - 1, (1 << 2 * BITS) - 1
#: Code points there are: what no text has shows shares the last of the probability.
POINTS = 0x110000
#: Code points that are looked up at a time.
SLICE = 1 << 20
#: Most rows of a model that is sent to every executor, 36 bytes each; larger ones are joined.
MODEL_ROWS = 200_000
#: Bytes of text, about, that ask together for what they need of a model that is joined, and
#: that are compressed together.
BLOCK_BYTES, BLOB_BYTES = 64 << 20, 1 << 20
#: Rows of a model, about, that are looked up by one group of a join.
SHARD_ROWS = 1 << 16
#: Kinds of a model's rows: the order of an n-gram of code points with its log probability, WORD
#: of a word with its count, LOSS with all words' count at key 0 and what is taken off counts of 1,
#: 2 and more at keys 1 to 3, and WEIGHT + kind of a context with its log weight of the lower order.
WORD, LOSS, WEIGHT = 4, 5, 10
#: A word runs up to and including the white space behind it, so a text is nothing but words.
WORDS = re.compile(r"[^\x20\x09-\x0D]*+[\x20\x09-\x0D]|[^\x20\x09-\x0D]++")
#: A word that stands again right after itself is read as one mark.
AGAIN = "\x01"
REPEATS = re.compile(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)((?:[\x20\x09-\x0D]++\1(?![^\x20\x09-\x0D]))+)")


def marked(text: str) -> str:
    """The text with a mark for each word that repeats the one before.

    Repeated words look likely to an n-gram model, letter by letter; as marks they are as rare
    as they are in trusted text.
    """
    return REPEATS.sub(lambda m: m[1] + AGAIN * len(m[2].split()), text)


def slices(texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which text, trigram) of each code point of the texts, some SLICE at a time."""
    for own in _stretches(texts):
        yield _joined(own)


def _stretches(texts: Sequence[str]) -> Iterator[list[tuple[int, str]]]:
    """(which text, stretch of it with two code points before) of the texts, some SLICE code points at a time.

    A trigram is a code point z after x and y, as x * 2**42 + y * 2**21 + z; two zeros stand
    before a text. Texts of any length are taken whole, in stretches, with repeated words as
    marks. A word over a border, at each SLICE code points of a text, counts as two.
    """
    own: list[tuple[int, str]] = []
    held = 0
    for i, t in enumerate(texts):
        t = "\0\0" + marked(t)
        for lo in range(2, len(t), SLICE):
            own.append((i, t[lo - 2 : lo + SLICE]))
            held += len(own[-1][1])
            if held >= SLICE:
                yield own
                own, held = [], 0
    if own:
        yield own


def _words(own: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the stretches' distinct words, by a hash of 64 bits, and (which of these, first code point) of each word."""
    words = [w for _, t in own for w in WORDS.findall(t, 2)]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes, known_ = pd.factorize(np.array(words, object))
    return _hashed(known_), codes, np.cumsum(sizes) - sizes


def _hashed(words: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(words, categorize=False).view(np.int64)


def _joined(own: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(t for _, t in own).encode("utf-32-le"), np.uint32).astype(np.int64)
    sizes = np.array([len(t) for _, t in own])
    whose = np.repeat([i for i, _ in own], sizes)
    real = np.ones(len(codes), bool)
    begin = np.cumsum(sizes) - sizes
    real[begin] = real[begin + 1] = False
    grams = (codes[:-2] << 2 * BITS) | (codes[1:-1] << BITS) | codes[2:]
    return whose[2:][real[2:]], grams[real[2:]]


def fold_of(text: Column) -> Column:
    """1 or 2 by the text, so that copies fall together."""
    return (F.pmod(F.xxhash64(text), F.lit(2)) + 1).cast("int")


def count_grams(rows: DataFrame) -> DataFrame:
    """Rows (kind, gram, n1, n2): how often each trigram and word stands in all texts of (text, fold) of folds 1 and 2, counted by batch, then by shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            folds, texts = b.column("fold").to_pylist(), b.column("text").to_pylist()
            for f in (1, 2):
                for own in _stretches([t for t, k in zip(texts, folds) if k == f and t]):
                    words, codes, _ = _words(own)
                    for kind, (g, n) in ((3, np.unique(_joined(own)[1], return_counts=True)), (WORD, (words, np.bincount(codes)))):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), f, np.int32)), pa.array(np.full(len(g), kind, np.int32)), pa.array(g), pa.array(n)], names=["fold", "kind", "gram", "n"])

    return rows.select("text", "fold").mapInArrow(run, "fold int, kind int, gram long, n long").groupBy("kind", "gram").agg(*[F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in (1, 2)])


def _discounted(rows: DataFrame) -> DataFrame:
    """The rows (model, n) with `off`, the discounts of their model, and `d`, their own.

    Discounts for counts of 1, 2 and more come from how many grams of a model have counts 1 to
    4; where these are too few, 0.5 is taken off.
    """
    per = rows.groupBy("model").agg(*[F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    off = [F.greatest(F.least(k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}")), F.lit(float(k))), F.lit(0.0)) for k in (1, 2, 3)]
    off = F.when(F.least("n1", "n2", "n3", "n4") > 0, F.array(*off)).otherwise(F.array(*[F.lit(0.5)] * 3))
    # one row for each of three models
    return rows.join(F.broadcast(per.select("model", off.alias("off"))), "model").withColumn("d", F.element_at("off", F.least("n", F.lit(3)).cast("int")))


def _level(rows: DataFrame, few_contexts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Interpolated p of rows (model, context, gram, n, low), and each context's weight of low."""
    rows = _discounted(rows)
    sums = rows.groupBy("model", "context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("weight"))
    p = (F.col("n") - F.col("d")) / F.col("total") + F.col("weight") * F.col("low")
    return cut(rows.join(F.broadcast(sums) if few_contexts else sums, ["model", "context"]).select("model", "gram", p.alias("p"))), sums.select("model", "context", "weight")


def fit(trusted: DataFrame) -> DataFrame:
    """Models of all texts given, as rows (kind, key, v0, v1, v2), a value being what its kind says or null.

    Model 0 is of all texts, model 1 of those of fold 2 and model 2 of those of fold 1. Counts,
    continuation counts, discounts and probabilities are tables, joined by shards of the
    n-grams; they grow with the texts and none is collected. Without texts: no rows.
    A word is likely by its own count, with a weight of what its code points say, each after
    the two before; these orders in turn are interpolated down to all code points alike.
    Counts and orders are deleted once the models are stored.
    """
    with scratch(trusted.sparkSession):
        return _fit(trusted)


def _fit(trusted: DataFrame) -> DataFrame:
    counts = cut(count_grams(trusted.select("text", fold_of(F.col("text")).alias("fold"))))
    ns = F.col("n1") + F.col("n2"), F.col("n2"), F.col("n1")
    of = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), n.alias("n")) for m, n in enumerate(ns)])).alias("of")
    each = counts.select("kind", "gram", of).select("kind", "gram", "of.*").where("n > 0")
    c3, words = each.where("kind = 3").drop("kind"), each.where(F.col("kind") == WORD)
    c2 = c3.groupBy("model", F.col("gram").bitwiseAND(TWO).alias("gram")).agg(F.count("*").alias("n"))
    c1 = c2.groupBy("model", F.col("gram").bitwiseAND(ONE).alias("gram")).agg(F.count("*").alias("n"))
    context, none = F.shiftright("gram", BITS), F.lit(0).cast("long")
    levels = [_level(c1.select("model", none.alias("context"), "gram", "n", F.lit(1.0 / POINTS).alias("low")), True)]
    for c, last in ((c2, ONE), (c3, TWO)):
        low = levels[-1][0].select("model", F.col("gram").alias("last"), F.col("p").alias("low"))
        levels.append(_level(c.withColumn("last", F.col("gram").bitwiseAND(last)).join(low, ["model", "last"]).select("model", context.alias("context"), "gram", "n", "low")))
    log = lambda c: F.log(F.greatest(c, F.lit(1e-12)))
    # what a word's code points say depends on where it stands, so words keep their counts until texts are scored
    spare = cut(_discounted(words.select("model", "n")).groupBy("model").agg(F.first("off").alias("off"), F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("weight")))
    values = [(LOSS, F.lit(0), F.col("total").cast("double")), *[(LOSS, F.lit(k), F.element_at("off", k)) for k in (1, 2, 3)], (WEIGHT + WORD, F.lit(0), log(F.col("weight")))]
    rows = [spare.select("model", F.lit(kind).alias("kind"), key.cast("long").alias("key"), value.alias("value")) for kind, key, value in values]
    for k, (p, w) in enumerate(levels, 1):
        for kind, own, key, value in ((k, p, "gram", "p"), (WEIGHT + k, w, "context", "weight")):
            rows.append(own.select("model", F.lit(kind).alias("kind"), F.col(key).alias("key"), log(F.col(value)).alias("value")))
    spelling = reduce(DataFrame.unionByName, rows).groupBy("kind", "key").agg(*[F.max(F.when(F.col("model") == m, F.col("value"))).alias(f"v{m}") for m in range(3)])
    return stored(spelling.unionByName(counts.where(F.col("kind") == WORD).select("kind", F.col("gram").alias("key"), *[F.when(n > 0, n.cast("double")).alias(f"v{m}") for m, n in enumerate(ns)])), "model", lasting=True)


class Known:
    """The rows of one model, or those of them that some texts need, sorted to be looked up."""

    def __init__(self, kind: np.ndarray, key: np.ndarray, value: np.ndarray) -> None:
        self.parts = {}
        for k in np.unique(kind).tolist():
            own = np.flatnonzero(kind == k)
            own = own[np.argsort(key[own])]
            self.parts[k] = key[own], value[own]

    def look(self, kind: int, keys: np.ndarray, other: np.ndarray | float) -> np.ndarray:
        if kind not in self.parts:
            return np.broadcast_to(np.asarray(other, float), keys.shape)
        own, value = self.parts[kind]
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        return np.where(own[at] == keys, value[at], other)

    def log_p(self, grams: np.ndarray) -> np.ndarray:
        """Of each trigram: its own probability, or what its contexts leave to the lower orders."""
        p = np.zeros(len(grams)) - np.log(POINTS)
        for k, keys in ((1, grams & ONE), (2, grams & TWO), (3, grams)):
            context = keys >> BITS if k > 1 else np.zeros_like(keys)
            p = self.look(k, keys, p + self.look(WEIGHT + k, context, 0.0))
        return p

    def log_word(self, words: np.ndarray, which: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        """Of each word, one of those given: its own share, and the weight of how it is spelt."""
        n = self.look(WORD, words, 0.0)
        total, *off = self.look(LOSS, np.arange(4), 0.0)
        own = np.full(len(words), -np.inf)
        there = n > 0
        own[there] = np.log(np.maximum((n[there] - np.array(off)[np.minimum(n[there], 3).astype(int) - 1]) / total, 1e-12))
        return np.logaddexp(own[which], spelt + self.look(WEIGHT + WORD, np.zeros(1, np.int64), 0.0))


def _asked(grams: np.ndarray, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(kind, keys) of all rows that log_p and log_word may look up."""
    for kind in (WEIGHT + 1, WEIGHT + WORD):
        yield kind, np.zeros(1, np.int64)
    yield LOSS, np.arange(4)
    yield WORD, np.unique(words)
    for k, keys in ((1, grams & ONE), (2, grams & TWO), (3, grams)):
        yield k, np.unique(keys)
        if k > 1:
            yield WEIGHT + k, np.unique(keys >> BITS)


def known(models: pd.DataFrame) -> dict[int, Known]:
    kind, key = models.kind.to_numpy(), models.key.to_numpy()
    values = ((m, models[f"v{m}"].to_numpy(float)) for m in range(3))
    return {m: Known(kind[there], key[there], v[there]) for m, v in values if (there := ~np.isnan(v)).any()}


def perplexities(models: dict[int, Known], texts: Sequence[str | None], folds: Sequence[int]) -> pd.DataFrame:
    """perplexity under model 0, and held_out under the model of a text's fold; NaN for empty texts, fold 0 and absent models."""
    texts, folds = [t or "" for t in texts], np.asarray(folds, np.int64)
    total, apart, n = (np.zeros(len(texts)) for _ in range(3))
    whole = models.get(0) or Known(np.empty(0), np.empty(0), np.empty(0))
    for own in _stretches(texts):
        whose, grams = _joined(own)
        words, which, begin = _words(own)
        at, u = pd.factorize(grams)
        n += np.bincount(whose, minlength=len(texts))
        total += np.bincount(whose[begin], whole.log_word(words, which, np.add.reduceat(whole.log_p(u)[at], begin)), len(texts))
        sizes = np.diff(begin, append=len(grams))
        for f in (1, 2):
            if f in models and (held := folds[whose[begin]] == f).any():
                spelt = np.add.reduceat(models[f].log_p(u)[at[folds[whose] == f]], np.cumsum(sizes[held]) - sizes[held])
                apart += np.bincount(whose[begin][held], models[f].log_word(words, which[held], spelt), len(texts))
    n[n == 0] = np.nan
    there = np.isin(folds, [f for f in (1, 2) if f in models])
    return pd.DataFrame({"perplexity": np.exp(-total / n), "held_out": np.where(there, np.exp(-apart / n), np.nan)})


_SCORES = T.StructType([T.StructField("perplexity", T.DoubleType()), T.StructField("held_out", T.DoubleType())])


def score(docs: DataFrame, models: DataFrame) -> DataFrame:
    """The struct `score` in place of the text of rows with text and fold: perplexities by code point of each whole text.

    A model of at most MODEL_ROWS rows is sent to the executors. A larger one is joined with
    what blocks of texts ask of it, with the same results.
    """
    if not is_small(models, MODEL_ROWS):
        return _by_block(docs, models)
    held = docs.sparkSession.sparkContext.broadcast(known(models.toPandas()))

    @F.pandas_udf(_SCORES)
    def run(text: pd.Series, fold: pd.Series) -> pd.DataFrame:
        return perplexities(held.value, text.tolist(), fold.tolist())

    return docs.withColumn("score", run("text", "fold")).drop("text")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as compressed blobs of some BLOB_BYTES, numbered by blocks of some BLOCK_BYTES within the task."""
    block, size, squeeze = TaskContext.get().partitionId() << 32, 0, zstandard.ZstdCompressor(level=3)
    for batch in batches:
        sizes = pc.coalesce(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        blob = np.cumsum(sizes) // BLOB_BYTES
        for begin in np.flatnonzero(np.diff(blob, prepend=-1)).tolist():
            end = int(np.searchsorted(blob, blob[begin], "right"))
            if size and size + sizes[begin:end].sum() > BLOCK_BYTES:
                block, size = block + 1, 0
            size += int(sizes[begin:end].sum())
            out = io.BytesIO()
            with pa.ipc.new_stream(out, batch.schema) as w:
                w.write_batch(batch.slice(begin, end - begin))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([squeeze.compress(out.getvalue())], pa.binary())], names=["block", "blob"])


def _rows(blobs: Iterable[bytes]) -> Iterator[pd.DataFrame]:
    for blob in blobs:
        yield pa.ipc.open_stream(zstandard.decompress(blob)).read_pandas()


def _pack(kind: np.ndarray, key: np.ndarray, values: Sequence[np.ndarray] = ()) -> bytes:
    """Rows of a model, or what is asked of it, in some ten times fewer bytes than as a table's rows.

    Keys go as differences, and bytes of the same place stand together: in sorted keys, and in
    counts, most of these are alike.
    """
    columns = [np.diff(key, prepend=0), *values]
    planes = [c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in map(np.ascontiguousarray, columns)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([kind.astype(np.uint8).tobytes(), *planes]))


def _unpack(packed: bytes, n_values: int = 0) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    n = len(raw) // (9 + 8 * n_values)
    column = lambda i, of: np.ascontiguousarray(raw[n * (1 + 8 * i) : n * (9 + 8 * i)].reshape(8, n).T).view(of).ravel()
    return raw[:n].astype(np.int64), np.cumsum(column(0, np.int64)), [column(1 + i, np.float64) for i in range(n_values)]


#: Shards: how many first bits of a word part them, and a prime that spreads other keys.
HIGH, PRIME = 24, 1_000_003


def _shard(kind: np.ndarray, key: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each row: words, which are hashes, by ranges, so that a shard's are close together."""
    return np.where(kind == WORD, ((key >> (64 - HIGH)) + (1 << HIGH - 1)) * shards >> HIGH, key % PRIME % shards)


def _shard_column(shards: int) -> Column:
    word = F.shiftright((F.shiftright("key", 64 - HIGH) + (1 << HIGH - 1)) * shards, HIGH)
    return F.when(F.col("kind") == WORD, word).otherwise(F.col("key") % PRIME % shards).cast("int")


def _found(rows: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
    """What each of the asks (block, asked) finds in a shard's rows of a model, packed."""
    own = {k: g.sort_values("key") for k, g in rows.groupby("kind")}
    out = []
    for block, packed in zip(asks.block, asks.asked):
        kind, key, _ = _unpack(packed)
        parts = []
        for k in np.unique(kind).tolist():
            if k in own:
                known_, keys = own[k].key.to_numpy(), key[kind == k]
                at = np.minimum(np.searchsorted(known_, keys), len(known_) - 1)
                parts.append(own[k].iloc[at[known_[at] == keys]])
        if sum(map(len, parts)):
            got = pd.concat(parts)
            out.append((block, _pack(got.kind.to_numpy(), got.key.to_numpy(), [got[f"v{m}"].to_numpy(float) for m in range(3)])))
    return pd.DataFrame(out, columns=["block", "found"])


def _by_block(docs: DataFrame, models: DataFrame) -> DataFrame:
    """score by sharded joins: each block of texts asks for each row of the model once.

    Blocks are made where the rows are read, as compressed blobs that are shuffled once; a
    task holds what a block knows of the model and a blob's texts at a time. What a block asks
    of a shard of the model is one packed row, and so is what it finds there.
    """
    # both uses group these rows whole, so that their one shuffle is used twice
    placed = docs.mapInArrow(_blocks, "block long, blob binary").repartition("block")
    n_rows, *there = models.agg(F.count("*"), *[F.count(f"v{m}") for m in range(3)]).first()
    present = {m for m in range(3) if there[m]}
    shards = n_rows // SHARD_ROWS + 1

    def ask(rows: pd.DataFrame) -> pd.DataFrame:
        kinds: dict[int, list[np.ndarray]] = {}
        for frame in _rows(rows.blob):
            for some in _stretches([t or "" for t in frame.text]):
                spoken = {w for _, t in some for w in WORDS.findall(t, 2)}
                for kind, keys in _asked(pd.unique(_joined(some)[1]), _hashed(np.array(list(spoken), object))):
                    kinds.setdefault(kind, []).append(keys)
            if len(kinds.get(WORD, ())) > 16:
                kinds = {k: [np.unique(np.concatenate(v))] for k, v in kinds.items()}
        own = {kind: np.unique(np.concatenate(keys)) for kind, keys in sorted(kinds.items())}
        if not own:
            return pd.DataFrame({"shard": [], "block": [], "asked": []})
        kind, key = np.repeat(list(own), [len(k) for k in own.values()]), np.concatenate(list(own.values()))
        shard = _shard(kind, key, shards)
        order = np.argsort(shard, kind="stable")
        begin = np.flatnonzero(np.diff(shard[order], prepend=-1))
        asked = [_pack(kind[at], key[at]) for at in np.split(order, begin[1:])]
        return pd.DataFrame({"shard": shard[order[begin]], "block": rows.block.iloc[0], "asked": asked})

    asked = placed.groupBy("block").applyInPandas(ask, "shard int, block long, asked binary")
    held = models.withColumn("shard", _shard_column(shards))
    found = held.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(_found, "block long, found binary")

    def answer(rows: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(p, 3) for p in got.found]
        kind, key = (np.concatenate([p[i] for p in parts] or [np.empty(0, np.int64)]) for i in (0, 1))
        values = {f"v{m}": np.concatenate([p[2][m] for p in parts] or [np.empty(0)]) for m in range(3)}
        own = known(pd.DataFrame({"kind": kind, "key": key, **values}))
        own |= {m: Known(np.empty(0), np.empty(0), np.empty(0)) for m in present if m not in own}
        out = []
        for frame in _rows(rows.blob):
            scored = perplexities(own, frame.text.tolist(), frame.fold.tolist())
            out.append(frame.drop(columns="text").join(scored))
        return pd.concat(out)

    kept = [f for f in docs.schema.fields if f.name != "text"]
    out = placed.groupBy("block").cogroup(found.groupBy("block")).applyInPandas(answer, T.StructType([*kept, *_SCORES.fields]))
    return out.select(*[f.name for f in kept], F.struct(*_SCORES.names).alias("score"))


def judge(docs: DataFrame, labels: DataFrame, quantile: float = 0.99) -> DataFrame:
    """Perplexity and verdict of each document (doc_id, text, lang).

    Trusted texts are those labelled of quality 1 and not toxic; all of them train the model.
    The threshold of a language is the `quantile` of its trusted texts' perplexities, each
    under a model of the other half of the trusted texts, since a text that trained a model
    has a lower one than texts as good that didn't (approximate to 1 in 10,000 ranks).
    Languages without trusted texts, null included, take that of all trusted ones. A document
    is kept if its perplexity is at most the threshold. Without trusted texts, and for empty
    texts, nothing is kept. Rows alike are judged each, and alike. Returns doc_id, lang, perplexity, threshold, kept.
    """
    good = labels.groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int")).alias("good")).where("good = 1").select("doc_id", F.lit(1).alias("trusted"))
    marked = attach(docs.select("doc_id", "text", "lang"), cut(good), ["doc_id"])
    marked = marked.withColumn("fold", F.when(F.col("trusted") == 1, fold_of(F.col("text"))).otherwise(0))
    scored = score(marked.select("doc_id", "text", "lang", "fold"), fit(marked.where("trusted = 1")))
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    rows = cut(scored.select("doc_id", "lang", "fold", real("score.perplexity").alias("perplexity"), F.coalesce(real("score.held_out"), real("score.perplexity")).alias("held_out")))
    at = F.percentile_approx("held_out", F.lit(quantile), F.lit(10_000)).alias("threshold")
    by_lang = rows.where("fold > 0").groupBy("lang").agg(at)
    everyone = rows.where("fold > 0").agg(at).first()[0]
    out = attach(rows, by_lang, ["lang"]).withColumn("threshold", F.coalesce("threshold", F.lit(everyone).cast("double")))
    return out.select("doc_id", "lang", "perplexity", "threshold", F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False)).alias("kept"))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, threshold and verdict of each row of `documents`, by the trusted texts of `labels`."""
    bounded_batches(spark)
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_kneser_ney": op4_kneser_ney}
ORACLES: dict[str, str] = {}
