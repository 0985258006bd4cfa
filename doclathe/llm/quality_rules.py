"""Quality rules: features of each text, and verdicts on hosts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import attach, begin, bounded_batches, packed, stored, table

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: A host goes if its shrunk share of failed documents is over this.
HOST_LIMIT = 0.8
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeated(words: list[bytes]) -> int:
    """Words that stand in a window of WINDOW words found twice or more."""
    windows = list(zip(*(words[i:] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict = {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    total, end = 0, 0
    for i in sorted(i for at in seen.values() if len(at) > 1 for i in at):
        total += i + WINDOW - max(i, end)
        end = i + WINDOW
    return total


def _features(text: str | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode()
    words = data.split()  # of bytes: splits at the six ASCII white spaces only
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), _repeated(words)


@F.pandas_udf(T.StructType([T.StructField(x, T.LongType()) for x in NAMES]))
def text_features(text: pd.Series) -> pd.DataFrame:
    begin("rules")
    return pd.DataFrame([_features(x) for x in text], columns=list(NAMES))


def failed(f: str) -> Column:
    """The document rule, on the struct column of text_features."""
    return (F.col(f"{f}.n_words") < 10) | (100 * F.col(f"{f}.n_repeat_words") > 20 * F.col(f"{f}.n_words"))


def host_verdicts(rows: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Which hosts go, from rows (host, failed); null is a host.

    The prior Beta(a, b) has the mean and variance of the hosts' shares of failed documents
    (method of moments). A host with f of n failed has the shrunk share (f + a) / (n + a + b),
    so a small host needs more evidence. If the shares don't vary, or vary as much as 0s and
    1s would, no prior fits and the plain share counts. Returns host, n_docs, n_failed,
    shrunk, host_rejected.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    share = F.col("n_failed") / F.col("n_docs")
    prior = hosts.agg(F.avg(share).alias("m"), F.var_pop(share).alias("v"))
    strength = F.when((F.col("v") > 0) & (F.col("v") < F.col("m") * (1 - F.col("m"))), F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(0.0)
    prior = prior.select((F.col("m") * strength).alias("a"), ((1 - F.col("m")) * strength).alias("b"))
    shrunk = (F.col("n_failed") + F.col("a")) / (F.col("n_docs") + F.col("a") + F.col("b"))
    # the prior is one row
    return hosts.join(F.broadcast(prior)).select("host", "n_docs", "n_failed", shrunk.alias("shrunk"), (shrunk > limit).alias("host_rejected"))


def judge(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Features and verdict of each document (doc_id, text, `host`), one row for each input row.

    Texts are looked at once: their five numbers are written, and both the hosts' verdicts and
    the documents' are made of them. Null and empty texts have no words and fail; a null host is
    one; repeated rows each count for their host; no rows give none; long texts are taken whole;
    other columns of any name don't matter.
    """
    rows = stored(docs.select("doc_id", F.col(host).alias("host"), text_features("text").alias("f")).withColumn("failed", failed("f")), "features")
    hosts = stored(host_verdicts(rows, limit).select("host", "host_rejected"), "hosts")
    return attach(rows, hosts, ["host"]).select(
        "doc_id", "host", *[f"f.{x}" for x in NAMES], F.col("failed").alias("base_failed"), (~F.col("failed") & ~F.col("host_rejected")).alias("kept")
    )


def keep_good(docs: DataFrame, host: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that pass their own rule and whose host isn't rejected, with all their columns."""
    rows = docs.select(packed(docs), F.col(host).alias("host"), text_features("text").alias("f")).withColumn("failed", failed("f"))
    bad = host_verdicts(rows.select("host", "failed"), limit).where("host_rejected").select("host", F.lit(True).alias("bad"))
    return attach(rows.where("not failed"), bad, ["host"]).where("bad is null").select("row.*")


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and verdicts of all `documents`, their source being the host."""
    bounded_batches(spark)
    return judge(table(spark, sf_dir, "documents")).drop("host")


QUERIES = {"op3_host_rules": op3_host_rules}
ORACLES = {
    "op3_host_rules": f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
windows AS (SELECT r, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') AS g
            FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM words)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1),
repeats AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, i + o AS p FROM twice, range({WINDOW}) t(o)) GROUP BY r),
lines AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)
          WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
base AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                CAST(coalesce(lines.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words
         FROM docs JOIN words USING (r) LEFT JOIN lines USING (r) LEFT JOIN repeats USING (r)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM judged GROUP BY source),
prior AS (SELECT m, CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE 0 END AS s
          FROM (SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts)),
bad AS (SELECT source, (f + m * s) / (n + s) > {HOST_LIMIT} AS rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AS kept
FROM judged JOIN bad ON judged.source IS NOT DISTINCT FROM bad.source"""
}
