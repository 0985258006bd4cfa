"""URL filters: token combinations mined by FP-growth, and rules written by hand."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import attach, cut, is_small, table

#: (verdict, host, path): a rule fits its host and all subdomains if the path starts with its own.
HAND_RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
BAD = "=bad"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Distinct tokens: host labels (h:), path segments (p:) and query keys (q:)."""
    part = lambda kind, text, mark: F.transform(F.filter(F.split(text, mark), lambda x: x != ""), lambda x: F.concat(F.lit(kind), x))
    query = F.coalesce(F.regexp_extract(url, r"://[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    return F.array_distinct(F.concat(part("h:", host_of(url), r"\."), part("p:", path_of(url), "/"), keys))


def mine_rules(labelled: DataFrame, support: float = 0.002, least: int = 5, confidence: float = 0.5) -> DataFrame:
    """Rules (tokens, confidence, n) from rows (url, bad): URLs with all tokens tend to be bad.

    FP-growth finds the token sets that hold in at least `support` of the rows and in `least`
    rows, with and without the label; a rule's confidence is the share that is bad among its
    rows. A rule goes if dropping one token leaves a rule of no less confidence. Tokens that
    stand in just the same rows are mined as one, and each of them makes the rules that it
    stands for: a URL of n tokens that is all there is of its kind would have 2**n sets
    otherwise. Null URLs don't count; repeated rows each count; no labelled row, or none that
    is bad: no rules.
    """
    spark = labelled.sparkSession
    rows = labelled.where("url is not null").select(url_tokens(F.col("url")).alias("own"), F.coalesce("bad", F.lit(False)).alias("bad"))
    rows = cut(rows.where(F.col("bad") | (F.size("own") > 0)).withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "tokens array<string>, confidence double, n long")
    entries = rows.select("row", F.explode("own").alias("token"))
    where = entries.groupBy("token").agg(F.struct(F.count("*"), F.expr("bit_xor(xxhash64(row))"), F.expr("bit_xor(xxhash64(row, 1))")).alias("where"))
    alike = cut(where.groupBy("where").agg(F.array_sort(F.collect_list("token")).alias("alike")).select(F.get("alike", F.lit(0)).alias("item"), "alike"))
    items = entries.join(alike.select("item", F.explode("alike").alias("token")), "token").groupBy("row").agg(F.collect_set("item").alias("items"))
    items = rows.select("row", "bad").join(items, "row", "left")
    items = cut(items.select(F.concat(F.coalesce("items", F.array().cast("array<string>")), F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")))
    sets = cut(FPGrowth(itemsCol="items", minSupport=min(1.0, max(support, least / n)), numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(items).freqItemsets)
    without = F.array_sort(F.array_remove("items", BAD))
    bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(without.alias("tokens"), F.col("freq").alias("n_bad"))
    rules = cut(bad.join(sets.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n")), "tokens").select("tokens", (F.col("n_bad") / F.col("n")).alias("confidence"), "n").where(F.col("confidence") >= confidence))
    shorter = rules.where(F.size("tokens") > 1).select("tokens", "confidence", F.explode("tokens").alias("x")).select(F.col("tokens").alias("long"), F.col("confidence").alias("c"), F.array_remove("tokens", F.col("x")).alias("tokens"))
    worse = shorter.join(rules, "tokens").where(F.col("confidence") >= F.col("c")).select(F.col("long").alias("tokens")).distinct()
    kept = rules.join(worse, "tokens", "left_anti")
    ways = kept.select("tokens", "confidence", "n", F.explode("tokens").alias("item")).join(alike, "item").groupBy("tokens", "confidence", "n").agg(F.collect_list("alike").alias("ways"))
    each = F.aggregate("ways", F.array(F.array().cast("array<string>")), lambda made, way: F.flatten(F.transform(made, lambda m: F.transform(way, lambda t: F.concat(m, F.array(t))))))
    return cut(ways.select(F.explode(each).alias("tokens"), "confidence", "n").withColumn("tokens", F.array_sort("tokens")))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The surest rule that fits each distinct url: url, mined (its tokens), confidence.

    Inverted index: each rule stands under its rarest token, counted over the urls, so a URL
    meets only the rules that share a rare token with it; then all tokens are compared. URLs
    that no rule fits are absent.
    """
    tokens = urls.where("url is not null").select("url").distinct().select("url", url_tokens(F.col("url")).alias("own"))
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    entries = tokens.select("url", "own", F.explode("own").alias("token"))
    small = is_small(rules)
    hint = F.broadcast if small else (lambda x: x)
    often = cut(entries.join(hint(wanted), "token").groupBy("token").count())
    rarest = rules.select("tokens", "confidence", F.explode("tokens").alias("token")).join(hint(often), "token", "left")
    index = rarest.groupBy("tokens", "confidence").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token")).alias("t")).select("tokens", "confidence", F.col("t.token").alias("token"))
    met = entries.join(hint(index), "token").where(F.size(F.array_except("tokens", "own")) == 0)
    best = met.groupBy("url").agg(F.max(F.struct("confidence", (-F.size("tokens")).alias("s"), F.array_join("tokens", " ").alias("mined"))).alias("b"))
    return best.select("url", "b.mined", "b.confidence")


def hand_verdict(host: Column, path: Column, rules=HAND_RULES) -> Column:
    """The longest of a short list of rules that fits, as struct (n, rule, verdict); null if none does."""
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    each = [F.when(fits(h, p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    return F.array_max(F.array(*each))


def judge_urls(pages: DataFrame, labelled: DataFrame, hand=HAND_RULES, **mining) -> DataFrame:
    """Verdict on each row of pages (page_id, url), from labelled rows (url, bad).

    A hand-written rule decides, the longest first; else the surest mined rule that fits
    blocks; else the page is allowed. Null URLs and those without :// have no host, path or
    token and are allowed. Of equally sure rules the one of fewer tokens counts, then the last by
    name; rows alike are judged alike; no pages give no rows, and no labels no mined rules; long
    URLs are read whole; other columns of any name don't matter. Returns page_id, host, path, rule, verdict, mined, confidence.
    """
    rows = pages.select("page_id", "url")
    found = match_rules(rows, mine_rules(labelled, **mining))
    rows = attach(rows, cut(found), ["url"])
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rows = rows.withColumn("_hand", hand_verdict(F.col("host"), F.col("path"), hand))
    verdict = F.coalesce("_hand.verdict", F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", F.col("_hand.rule").alias("rule"), verdict.alias("verdict"), "mined", "confidence")


def op6_fp_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on every url of `pages`, rules being mined from pages whose id has a label."""
    pages = table(spark, sf_dir, "pages")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.bool_or(F.coalesce(bad, F.lit(False))).alias("bad"))
    labelled = pages.select("url", "page_id").join(labels, F.col("page_id") == F.col("doc_id")).select("url", "bad")
    return judge_urls(pages, labelled)


QUERIES = {"op6_fp_growth": op6_fp_growth}
ORACLES: dict[str, str] = {}
