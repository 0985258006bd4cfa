"""Document fingerprints: closed syncmers over words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import table

#: Words of an anchor, each of which is an inner piece.
K = 4


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def with_anchors(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """Adds `out`: the anchors of a text column in order, as array<struct<pos, hash>>.

    A run of k words is an anchor if the least hash of its words is the first's or the last's
    (a closed syncmer of k words with inner pieces of one word): whether it is one depends on
    its own words alone, so an edit changes only the anchors it touches, and of any k - 1
    runs in a row one at least is an anchor unless hashes tie. pos counts words from 0, hash
    is 32 bits of the run's XXH64. A text of 1 to k-1 words is one anchor; null, empty and
    blank texts have none.
    """
    h, ws = f"_{out}_h", f"_{out}_w"
    df = df.withColumn(ws, words(F.coalesce(text, F.lit("")))).withColumn(h, F.transform(ws, lambda w: F.xxhash64(w)))
    at = lambda i, d: F.get(h, i + d)
    low = lambda x: F.shiftrightunsigned(x, 32)
    inner = lambda i: F.least(*[at(i, d) for d in range(1, k - 1)]) if k > 3 else at(i, 1)
    closed = lambda x, i: (i + k <= F.size(h)) & (F.least(x, at(i, k - 1)) <= inner(i))
    run = lambda x, i: F.struct(i.alias("pos"), low(F.xxhash64(x, *[at(i, d) for d in range(1, k)])).alias("hash"))
    found = F.filter(F.transform(h, lambda x, i: F.when(closed(x, i), run(x, i))), lambda a: a.isNotNull())
    short = F.transform(F.array(F.lit(0)), lambda i: F.struct(i.alias("pos"), low(F.xxhash64(h)).alias("hash")))
    return df.withColumn(out, F.when(F.size(h) >= k, found).when(F.size(h) > 0, short).otherwise(found)).drop(ws, h)


def fingerprint(anchors: str) -> Column:
    """Anchor hashes in order, 8 hexadecimal digits each."""
    return F.array_join(F.transform(anchors, lambda a: F.lpad(F.lower(F.hex(a["hash"])), 8, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Shared anchors among all distinct anchors of two columns of distinct hashes; 1 if neither has any."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, 1.0).otherwise(both / total).cast("double")


def matched_positions(a: str, b: str) -> Column:
    """Places (pos in a, pos in b) of the anchors that two documents share, first place of each."""
    first = lambda c: F.map_from_entries(F.transform(F.array_distinct(F.transform(c, lambda x: x["hash"])), lambda h: F.struct(h, F.get(F.filter(c, lambda x: x["hash"] == h), F.lit(0))["pos"])))
    return F.transform(F.array_intersect(F.map_keys(first(a)), F.map_keys(first(b))), lambda h: F.struct(F.try_element_at(first(a), h).alias("pos_a"), F.try_element_at(first(b), h).alias("pos_b")))


def with_next(docs: DataFrame, least: int = 64) -> DataFrame:
    """Adds next_text: the text of the document next by descending doc_id, after the last the first's.

    Rows (doc_id, text); null texts are empty, null ids come last, rows of equal id are
    ordered by text. No task sees all rows: quantiles of doc_id cut them into groups, the
    first rows of a group stand also at the end of the group before, and each group takes
    its own next texts. There are four groups for each shuffle partition, fewer if they
    would have under `least` rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ids = rows.select(key.cast("double").alias("key"))
    n = ids.count()
    groups = min(1 + n // least, 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(ids.approxQuantile("key", [i / groups for i in range(1, groups)], 0.2 / groups))) if groups > 1 else []
    # groups count from the highest ids
    group = F.lit(len(cuts)) - _below(cuts, key.cast("double"))
    rows = rows.withColumn("_group", group)
    heads = {g: top for g, top in rows.groupBy("_group").agg(F.max(key)).collect()}
    order = sorted(heads)
    before = {heads[g]: order[i - 1] for i, g in enumerate(order)}
    own = F.struct(F.col("_group").alias("g"), F.lit(False).alias("again"))
    if before:
        tops = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
        also = F.try_element_at(tops, key)
        places = F.when(also.isNotNull(), F.array(own, F.struct(also.alias("g"), F.lit(True).alias("again")))).otherwise(F.array(own))
    else:
        places = F.array(own)
    spread = rows.select("doc_id", "text", key.alias("_key"), F.explode(places).alias("_p"))
    w = Window.partitionBy("_p.g").orderBy(F.col("_p.again"), F.col("_key").desc(), "text")
    return spread.withColumn("next_text", F.lead("text").over(w)).where("not _p.again").select("doc_id", "text", "next_text")


def _below(cuts: list[float], key: Column) -> Column:
    """How many of the sorted cuts are below the key, by halving."""
    def half(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key > cuts[mid], half(mid + 1, hi)).otherwise(half(lo, mid))

    return half(0, len(cuts))


def op8_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all `documents`, of their edited texts, and their likeness to these and to the next document."""
    rows = with_next(table(spark, sf_dir, "documents"))
    n = F.length("text")
    changed = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - changed), F.substring("next_text", F.lit(1), changed))
    rows = rows.withColumn("edited", edited)
    for text in ("text", "edited", "next_text"):
        rows = with_anchors(rows, text, f"{text}_anchors")
    distinct = [F.array_distinct(F.transform(f"{x}_anchors", lambda a: a["hash"])).alias(f"{x}_set") for x in ("text", "edited", "next_text")]
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), fingerprint("text_anchors").alias("fingerprint"), fingerprint("edited_anchors").alias("edited_fingerprint"), *distinct)
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("text_set", "edited_set").alias("near_edited"), likeness("text_set", "next_text_set").alias("near_next"))


QUERIES = {"op8_closed_syncmers": op8_closed_syncmers}
ORACLES: dict[str, str] = {}
