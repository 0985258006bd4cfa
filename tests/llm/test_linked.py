"""SimHash, repeated passages, fingerprints: brute force and odd inputs."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from doclathe.llm import fingerprints, simhash, suffix_dedup
from doclathe.llm._shared import components, ranked

from test_counted import ODD, docs_of, with_clashes


def roots(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {n: top(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, i) for i in range(2000, 2200)]
    want = roots({n for x in links for n in x}, links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if n != r}


def test_ranks_are_gapless(spark):
    xs = [None, "b", "a", "ä", "B", "z"] * 3
    got = [r.x for r in ranked(spark.createDataFrame([(x,) for x in xs], "x string"), F.col("x").asc_nulls_last()).orderBy("rank").collect()]
    assert got == sorted((x for x in xs if x), key=lambda s: s.encode()) + [None] * 3


# op2


def slow_simhash(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_by_brute_force():
    for t in ["", None, "a", "a b", "The quick brown fox " * 3, "É b\tc\x0bd\x1ce f", "x y z"]:
        assert simhash.simhash(simhash.shingle_hashes(t, 3)) % 2**64 == slow_simhash(t)


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_index_finds_all_close_pairs(bits):
    rng = np.random.default_rng(bits)
    x = list(rng.integers(0, 2**63, 60, dtype=np.uint64))
    for _ in range(900):
        b = x[rng.integers(len(x))]
        for _ in range(rng.integers(0, 4)):
            b = b ^ (np.uint64(1) << np.uint64(rng.integers(64)))
        x.append(b)
    fps = np.unique(np.array(x, np.uint64))
    fps = fps[np.argsort(simhash.gray_rank(fps))]
    got = {p for a, b in simhash.close_pairs(fps, bits) for p in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= bits}
    assert got == want


def test_gray_neighbours_differ_in_one_bit():
    x = np.arange(4096, dtype=np.uint64)
    order = x[np.argsort(simhash.gray_rank(x))]
    assert all(int(a ^ b).bit_count() == 1 for a, b in zip(order[:-1], order[1:]))


@pytest.mark.parametrize("bucket", [2048, 8])
def test_linking_by_brute_force(spark, bucket, monkeypatch):
    rng = random.Random(6)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(300):
        b = rng.choice(fps)
        for _ in range(rng.randint(0, 3)):
            b ^= 1 << rng.randrange(64)
        fps.append(b)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)] + [(None, 0), (7, 0), (7, 0)]
    ids = [f % 2**64 for _, f in rows]
    distinct = sorted(set(ids))
    top = roots(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[:i] if (a ^ b).bit_count() <= 2])
    least: dict = {}
    for (i, _), f in zip(rows, ids):
        if i is not None:
            least[top[f]] = min(i, least.get(top[f], i))
    whole = simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda f, b=2: whole(f, b, bucket))
    got = simhash.link_fingerprints(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == least.get(top[r.fp % 2**64])


def near_groups(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").encode().lower().split() for t in texts)]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return roots(range(len(texts)), links)


def test_near_copies_by_brute_force(spark):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 150))) for _ in range(60)]
    for _ in range(140):
        w = rng.choice(texts[:60]).split()
        for _ in range(rng.randint(0, 1 + len(w) // 40)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        texts.append(rng.choice((str.upper, str))(" ".join(w)))
    texts += ["", None, "   "]
    top = near_groups(texts)
    df = with_clashes(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    out = simhash.near_dedup(df)
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(top.values()))


@pytest.mark.parametrize("block", [16, 512])
def test_edits_without_their_original(spark, block):
    """A family whose mean likeness is a little under 0.8: alike pairs are mostly not those of hubs."""
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(5000)]
    base = [rng.choice(vocab) for _ in range(400)]
    texts = []
    for _ in range(300):
        w = list(base)
        for at in rng.sample(range(400), 6):
            w[at] = rng.choice(vocab)
        texts.append(" ".join(w))
    top = near_groups(texts)
    rows, links = simhash.near_links(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]), block=block)
    ids = {r.kind: r.doc_id for r in rows.collect()}
    got = roots(range(300), [(ids[a], ids[b]) for a, b in links.collect()])
    assert got == top
    assert 1 < len(set(top.values())) < 300


@pytest.mark.parametrize(("rows", "n"), [([], 0), (ODD, 5)])
def test_near_dedup_of_odd_rows(spark, rows, n):
    assert simhash.near_dedup(docs_of(spark, rows)).count() == n


# op9


def slow_cut(texts, length):
    data = [(t or "").encode() for t in texts]
    where: dict = {}
    for i, x in enumerate(data):
        for p in range(len(x) - length + 1):
            where.setdefault(x[p : p + length], []).append((i, p))
    gone = [bytearray(len(x)) for x in data]
    for at in where.values():
        if len(at) > 1:
            for i, p in at:
                gone[i][p : p + length] = b"\1" * length
    for x, g in zip(data, gone):
        kept = bytes(c for c, z in zip(x, g) if not z)
        yield len(x), sum(g), sum(1 for j in range(len(g)) if g[j] and (j == 0 or not g[j - 1])), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("few", [1, 7, 5000])
def test_multikey_order(few):
    rng = np.random.default_rng(few)
    keys = [rng.integers(0, m, 3000) for m in (3, 40, 2, 1000)]
    assert np.array_equal(np.stack([k[suffix_dedup.multikey_order(keys, few)] for k in keys]), np.stack([k[np.lexsort(keys[::-1])] for k in keys]))
    assert len(suffix_dedup.multikey_order([k[:0] for k in keys])) == 0


@pytest.mark.parametrize(("length", "small"), [(40, False), (101, False), (60, True)])
def test_cut_by_brute_force(spark, length, small, monkeypatch):
    for name in ("SLICE", "ROWS", "BUCKET") if small else ():
        monkeypatch.setattr(suffix_dedup, name, 64)
    rng = random.Random(length)
    parts = ["".join(rng.choice("abcdé") for _ in range(rng.randint(20, 250))) for _ in range(20)]
    free = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 60)))
    texts = ["".join(rng.choice(parts) if rng.random() < 0.6 else free() for _ in range(rng.randint(0, 7))) for _ in range(90)]
    texts += [None, "", "ab" * 300, "a" * 200, texts[3], texts[3], "x" * 60 + texts[3], "中" * 90]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    df = with_clashes(docs_of(spark, rows))
    got = {r.doc_id: (r.cut.n_bytes, r.cut.n_removed, r.cut.n_spans, r.cut.kept_sha256) for r in suffix_dedup.dedup(df, length).collect()}
    assert got == dict(enumerate(slow_cut(texts, length)))


@pytest.mark.parametrize(("length", "small"), [(60, False), (250, True)])
def test_passages_of_short_words_by_brute_force(spark, length, small, monkeypatch):
    """51 words may have 101 bytes."""
    for name in ("SLICE", "ROWS", "BUCKET") if small else ():
        monkeypatch.setattr(suffix_dedup, name, 97)
    rng = random.Random(length)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 3)))
    prose = lambda n: "".join(word() + rng.choice("     \n") for _ in range(n))
    parts = [prose(n) for n in (50, 51, 52, 60, 61, 80, 120)]
    texts = ["".join(x for _ in range(rng.randint(1, 4)) for x in (rng.choice(parts), prose(rng.randint(1, 9)))) for _ in range(40)]
    alone = " ".join(f"{i:x}" for i in range(51))
    texts += [None, "", "a " * 51, "b " * 50, "c " * 60, parts[1], parts[1], parts[0], alone, alone]
    data = [(t or "").encode() for t in texts]
    where: dict = {}
    for i, x in enumerate(data):
        at = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", x)]
        spans = [(at[j][0], at[j + 50][1]) for j in range(len(at) - 50)] + [(p, p + length) for p in range(len(x) - length + 1)]
        for a, b in set(spans):
            where.setdefault(x[a:b], []).append((i, a, b))
    gone = [bytearray(len(x)) for x in data]
    for found in where.values():
        if len(found) > 1:
            for i, a, b in found:
                gone[i][a:b] = b"\1" * (b - a)
    want = {i: hashlib.sha256(bytes(c for c, z in zip(x, g) if not z)).hexdigest() for i, (x, g) in enumerate(zip(data, gone))}
    df = docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)])
    assert {r.doc_id: r.cut.kept_sha256 for r in suffix_dedup.dedup(df, length, 51).collect()} == want


def test_cut_of_nothing_and_of_repeated_rows(spark):
    assert suffix_dedup.dedup(docs_of(spark, []), 50).count() == 0
    got = suffix_dedup.dedup(docs_of(spark, ODD), 50).collect()
    assert len(got) == len(ODD)
    assert {r.doc_id: r.cut.n_removed for r in got}[None] == 60_000


# op8


def slow_anchors(text, k=fingerprints.K):
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]

    def chain(xs):
        seed = 42
        for x in xs:
            seed = xxhash.xxh64_intdigest((x % 2**64).to_bytes(8, "little"), seed)
        return seed >> 32

    if 0 < len(h) < k:
        return [(0, chain(h))]
    return [(i, chain(h[i : i + k])) for i in range(len(h) - k + 1) if min(h[i], h[i + k - 1]) <= min(h[i + 1 : i + k - 1])]


def test_anchors_by_brute_force(spark):
    rng = random.Random(11)
    texts = ["", None, "one", "one two three", " \t", *(" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))) for _ in range(60))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: [tuple(a) for a in r.anchors] for r in fingerprints.with_anchors(df, "text", "anchors").collect()}
    assert got == {i: slow_anchors(t) for i, t in enumerate(texts)}


def test_next_text_and_likeness(spark, tmp_path):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 4) for _ in range(rng.randint(0, 50))) for _ in range(300)]
    texts[7] = None
    df = docs_of(spark, [(3 * i, t, "s") for i, t in enumerate(texts)])
    with_clashes(df).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in fingerprints.op8_closed_syncmers(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[i - 1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        r = got[3 * i]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = ({h for _, h in slow_anchors(x)} for x in (t, edited, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert r.near_edited == pytest.approx(like(a, b)) and r.near_next == pytest.approx(like(a, c))
        assert r.fingerprint == "".join(f"{h:08x}" for _, h in slow_anchors(t))


@pytest.mark.parametrize("rows", [[], ODD])
def test_next_of_odd_rows(spark, rows):
    assert fingerprints.with_next(docs_of(spark, rows)).count() == len(rows)


def test_matched_positions(spark):
    df = spark.createDataFrame([("x y a b c d e f g", "a b c d e f g")], "s string, t string")
    df = fingerprints.with_anchors(fingerprints.with_anchors(df, "s", "sa"), "t", "ta")
    assert all(p.pos_a == p.pos_b + 2 for p in df.select(fingerprints.matched_positions("sa", "ta").alias("m")).first().m)


def test_fingerprint_plan_is_native(spark):
    df = spark.createDataFrame([("a b c d e",)], "text string")
    plan = fingerprints.with_anchors(df, "text", "a")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
