"""Personal data: what is written plainly, and words that co-occurrence shows to give it away."""

from __future__ import annotations

import bisect
import hashlib
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import attach, begin, bounded_batches, packed, scratch, stored, table, unused

#: Kinds of spans, in the order in which those of one start are listed.
KINDS = ("email", "ip", "card", "phone", "term")
#: Linear forms of the kinds' patterns: a run that can't match from its start can't from within.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)?+")
IP = re.compile(r"[0-9]++(?:\.[0-9]++){0,3}+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: A term: letters and digits of any script, three or more, lower-cased.
TERM = re.compile(r"[^\W_]{3,}")
#: Bits of the table that tells which terms can't be asked for: 1 MiB, whatever the corpus.
FILTER_BITS = 1 << 23
#: Terms whose answer a worker keeps.
KEPT_TERMS = 1 << 18
#: Rows of a batch that goes back to the JVM.
ROWS = 8192


def _luhn(digits: str) -> bool:
    odd, even = map(int, digits[-1::-2]), (2 * int(d) for d in digits[-2::-2])
    return (sum(odd) + sum(d - 9 if d > 9 else d for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, by start and kind; kinds as numbers of KINDS."""
    out = []
    if "@" in text:
        out += [(m.start(), 0, m.end()) for m in EMAIL.finditer(text) if m[1]]
    for m in IP.finditer(text):
        if m[0].count(".") == 3 and all(len(p) < 4 and int(p) < 256 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out)


def _entity(text: str, start: int, kind: int, end: int) -> bytes:
    """What a span stands for: its kind and its value without case, spaces and punctuation that don't matter."""
    value = text[start:end].lower()
    if kind > 1:
        value = "".join(c for c in value if c.isdigit())
    return hashlib.md5(f"{kind}:{value}".encode(errors="surrogatepass")).digest()


def _clear_of(spans: list[tuple[int, int, int]]) -> Callable[[int, int], bool]:
    """Whether a stretch overlaps none of the spans."""
    starts, ends, far = [s for s, _, _ in spans], [], 0
    for _, _, end in spans:
        far = max(far, end)
        ends.append(far)

    def clear(start: int, end: int) -> bool:
        k = bisect.bisect_left(starts, end)
        return k == 0 or ends[k - 1] <= start

    return clear


def surroundings(text: str, spans: list[tuple[int, int, int]], window: int) -> Iterator[tuple[bytes, str | None, int, int]]:
    """Rows (entity, term, context, first) of a text with spans.

    For each span its terms, up to `window` on either side, with a hash of them all; `first` is
    1 where an entity and a term meet for the first time in the text, and each entity has one
    row without a term.
    """
    clear = _clear_of(spans)
    at, to = array("q"), array("q")
    for m in TERM.finditer(text):
        if clear(*m.span()):
            at.append(m.start())
            to.append(m.end())
    met: set[tuple[bytes, str | None]] = set()
    for start, kind, end in spans:
        entity = _entity(text, start, kind, end)
        k, after = bisect.bisect_left(at, start), bisect.bisect_left(at, end)
        near = [*range(max(0, k - window), k), *range(after, min(len(at), after + window))]
        terms = [text[at[i] : to[i]].lower() for i in near]
        context = xxhash.xxh64("\n".join(terms).encode(errors="surrogatepass")).intdigest() - (1 << 63)
        for term in [None, *sorted(set(terms))]:
            yield entity, term, context, int((entity, term) not in met)
            met.add((entity, term))


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema, strict=True)], schema=schema)


def _terms(text: str) -> set[str]:
    """Its different terms; a long text's are met one by one."""
    found = TERM.findall(text) if len(text) < 1 << 20 else (m[0] for m in TERM.finditer(text))
    return {t.lower() for t in set(found)}


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[str]:
    for b in batches:
        for text in b.column(0):
            yield text.as_py() or ""


def _spans_and_contexts(window: int):
    """Of each text with spans: its key and spans, then its rows of surroundings."""
    schema = pa.schema([("key", pa.binary()), ("starts", pa.list_(pa.int32())), ("kinds", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("entity", pa.binary()), ("term", pa.string()), ("context", pa.int64()), ("first", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for text in _texts(batches):
            if spans := base_spans(text):
                yield (hashlib.md5(text.encode()).digest(), *map(list, zip(*spans)), None, None, None, None)
                for row in surroundings(text, spans, window):
                    yield (None, None, None, None, *row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("sanitise")
        yield from _batches(rows(batches), schema)

    return run


FOUND = "key binary, starts array<int>, kinds array<int>, ends array<int>, entity binary, term string, context long, first long"


def term_filter(terms: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter of the rows' terms: two bits each, made where the rows are; the driver gets bits/64 numbers at most."""
    h = F.xxhash64("term")
    at = F.explode(F.array(F.pmod(h, F.lit(bits)), F.pmod(F.shiftright(h, 32), F.lit(bits))))
    words = terms.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 AS int)))").alias("bits"))
    out = np.zeros(bits >> 6, np.uint64)
    for r in words.toArrow().to_batches():
        out[r.column(0).to_numpy()] = r.column(1).to_numpy().view(np.uint64)
    return out


def _asked(held: np.ndarray) -> Callable[[str], bool]:
    """Whether a term may be in the filter; answers are kept for terms that come again."""
    bits, kept = held.size << 6, begin("sanitise")
    table_ = held.tobytes()

    def fresh(term: str) -> bool:
        h = xxhash.xxh64(term.encode(errors="surrogatepass"), seed=42).intdigest()
        h -= (h >> 63) << 64
        return all(table_[(x % bits) >> 3] >> ((x % bits) & 7) & 1 for x in (h, h >> 32))

    def asked(term: str) -> bool:
        got = kept.get(term)
        if got is None:
            if len(kept) >= KEPT_TERMS:
                kept.clear()
            got = kept[term] = fresh(term)
        return got

    return asked


def _frequencies(held: np.ndarray):
    """(term, n): texts of a batch that hold the term, for terms that are asked for."""
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("sanitise").clear()
        asked, seen = _asked(held), Counter()
        for text in _texts(batches):
            seen.update(filter(asked, _terms(text)))
            if len(seen) > ROWS:
                yield from _batches(seen.items(), schema)
                seen.clear()
        yield from _batches(seen.items(), schema)

    return run


def _places(held: np.ndarray):
    """(key, term, starts, ends) of terms that are asked for, clear of the text's own spans."""
    schema = pa.schema([("key", pa.binary()), ("term", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        asked = _asked(held)
        for text in _texts(batches):
            if not any(map(asked, _terms(text))):
                continue
            clear, at = _clear_of(base_spans(text)), {}
            for m in TERM.finditer(text):
                if asked(term := m[0].lower()) and clear(*m.span()):
                    at.setdefault(term, []).append(m.span())
            key = hashlib.md5(text.encode()).digest()
            for term, spans in at.items():
                yield (key, term, *map(list, zip(*spans)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("sanitise").clear()
        yield from _batches(rows(batches), schema)

    return run


def disclosures(found: DataFrame, texts: DataFrame, total: int, support: int, generalise: float) -> DataFrame:
    """Rows (term, share): the most of an entity's information that a term gives away.

    Of N texts, n(c) hold entity c, n(t) the term, n(t, c) both near each other. c's information
    is log2(N / n(c)), and the term gives log2(N n(t, c) / (n(t) n(c))) of it. Only pairs that
    meet in `support` different surroundings or more count, so copies of one passage are one.
    """
    met = found.where("entity IS NOT NULL").groupBy("entity", "term", "context").agg(F.sum("first").alias("n"))
    met = stored(met.groupBy("entity", "term").agg(F.sum("n").alias("n"), F.count("*").alias("contexts")), "met")
    pairs = stored(met.where((F.col("contexts") >= support) & F.col("term").isNotNull()).select("entity", "term", F.col("n").alias("both")), "pairs")
    entities = met.where("term IS NULL").select("entity", F.col("n").alias("n_entity"))
    counted = texts.mapInArrow(_frequencies(term_filter(pairs.select("term").distinct())), "term string, n long")
    counted = stored(counted.groupBy("term").agg(F.sum("n").alias("n_term")), "counted")
    terms = attach(pairs.select("term").distinct(), counted, ["term"])
    known = attach(attach(pairs, stored(entities, "entities"), ["entity"]), stored(terms, "terms"), ["term"])
    information = F.log2(F.lit(float(total)) / F.col("n_entity"))
    given = F.log2(F.lit(float(total)) * F.col("both") / (F.col("n_term") * F.col("n_entity")))
    shares = known.where(information > 0).groupBy("term").agg(F.max(given / information).alias("share"))
    return shares.where(F.col("share") >= generalise)


def find_private(docs: DataFrame, window: int = 8, support: int = 3, generalise: float = 0.9, remove: float = 0.97) -> DataFrame:
    """Rows (key, spans) of every different text of docs with spans, key being its MD5.

    spans: an array of (start, kind, end, share), by start and kind, in code points, end
    exclusive; kind numbers KINDS, share is null but for terms. Base spans are the kinds'
    patterns, leftmost and non-overlapping in each kind, without those that fail the kind's
    test. Terms are words near base spans that give away `generalise` or more of the
    information of an entity (see `disclosures`), wherever they stand clear of base spans;
    from `remove` on they are to be removed, below to be generalised.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select("text")
    with scratch(spark):
        found = stored(texts.mapInArrow(_spans_and_contexts(window), FOUND), "found")
        terms = stored(disclosures(found, texts, texts.count(), support, generalise), "terms")
        placed = texts.mapInArrow(_places(term_filter(terms)), "key binary, term string, starts array<int>, ends array<int>")
        placed = attach(placed.groupBy("key", "term").agg(F.first(F.struct("starts", "ends")).alias("p")), terms, ["term"], "inner")
        share = F.col("share")
        plain = found.where("key IS NOT NULL").groupBy("key").agg(F.first(F.arrays_zip("starts", "kinds", "ends")).alias("s"))
        plain = plain.select("key", F.transform("s", lambda x: F.struct(x["starts"].alias("start"), x["kinds"].alias("kind"), x["ends"].alias("end"), F.lit(None).cast("double").alias("share"))).alias("spans"))
        zipped = F.transform(F.arrays_zip(F.col("p.starts").alias("a"), F.col("p.ends").alias("b")), lambda x: F.struct(x["a"].alias("start"), F.lit(4).alias("kind"), x["b"].alias("end"), share.alias("share")))
        both = plain.unionByName(placed.select("key", zipped.alias("spans"))).groupBy("key").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
        return stored(both, "private", lasting=True)


def _key(text: Column | str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")))


def rewriter(remove: float, kinds: tuple[str, ...] = KINDS):
    """A function that writes texts without their spans: overlapping ones as the first of them."""

    @F.pandas_udf("string")
    def written(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text: str | None, found) -> str | None:
            if text is None or found is None:
                return text
            out, at = [], 0
            for s in found:
                if s["start"] < at:
                    continue
                word = text[s["start"] : s["end"]]
                if s["kind"] < 4:
                    shown = f"[{kinds[s['kind']].upper()}]"
                elif s["share"] >= remove:
                    shown = "[...]"
                else:
                    shown = "[NUMBER]" if any(map(str.isdigit, word)) else "[NAME]" if word[0].isupper() else "[WORD]"
                out += [text[at : s["start"]], shown]
                at = s["end"]
            return "".join([*out, text[at:]])

        return pd.Series([one(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    return written


def sanitise(docs: DataFrame, name: str = "clean", window: int = 8, support: int = 3, generalise: float = 0.9, remove: float = 0.97) -> DataFrame:
    """Adds to docs the struct `name` of the text without personal data and the spans it had.

    Base spans read as their kind, `[EMAIL]`; terms to be removed as `[...]`; others as
    `[NUMBER]`, `[NAME]` or `[WORD]`. Null texts stay null and have no spans, as have empty
    ones; rows alike are cleaned alike and count each for itself; no rows give none; columns of
    any name stay, but for one of that name.
    """
    name = unused(name, [c for c in docs.columns if c != name])
    found = find_private(docs, window, support, generalise, remove)
    rows = attach(docs.select(packed(docs, name), "text", _key("text").alias("key")), found, ["key"])
    return rows.select("row.*", F.struct(rewriter(remove)("text", "spans").alias("text"), F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int,share:double>>")).alias("spans")).alias(name))


def op11_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every row of `documents`: what is written, and terms that give it away."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = attach(docs.select("doc_id", _key("text").alias("key")), find_private(docs), ["key"])
    rows = rows.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,kind:int,end:int,share:double>>")))
    names = F.array(*map(F.lit, KINDS))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")
    of_kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    base = F.filter("spans", lambda s: s["kind"] < 4)
    return rows.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


QUERIES = {"op11_disclosure": op11_disclosure}
#: Co-occurrence windows and Luhn sums aren't expressible in SQL at reasonable length; tests compare with brute force.
ORACLES: dict[str, str] = {}
