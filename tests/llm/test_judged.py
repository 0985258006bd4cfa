"""URL filters, licence scans, perplexity and the pipeline: brute force, held-out labels, odd inputs."""

from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from conftest_sf import SF
from pyspark.sql import functions as F

from doclathe.llm import license_scan, perplexity, url_filter

from test_counted import ODD, docs_of, with_clashes

# op6

URLS = [None, "", "no scheme", "http://", "HTTPS://Blog.Example.COM", "http://x.example.com/en/7/a?q=1#t", "http://a.net/de/1", "http://example.net/de/8", "http://org/es/", "http://notcom/en/", "x://y://z/en/?k=v&l", "http://com?x=/en/", "http://COM/en/#f"]


def slow_tokens(url):
    if url is None or "://" not in url:
        return set()
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0] + [len(rest)])
    host, path = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    end = min([i for i in map(path.find, "?#") if i >= 0] + [len(path)])
    query = path[end + 1 :].split("#")[0] if path[end : end + 1] == "?" else ""
    return {f"h:{x}" for x in host.split(".") if x} | {f"p:{x}" for x in path[:end].split("/") if x} | {f"q:{x.split('=')[0]}" for x in query.split("&") if x}


def slow_rules(labelled, support, least, confidence):
    rows = [(slow_tokens(u), b) for u, b in labelled if u is not None]
    rows = [(t, b) for t, b in rows if t or b]
    need = max(support, least / len(rows)) * len(rows)
    n, bad = Counter(), Counter()
    for tokens, b in rows:
        for k in range(1, len(tokens) + 1):
            for c in combinations(sorted(tokens), k):
                n[c] += 1
                bad[c] += b
    rules = {c: bad[c] / n[c] for c in n if bad[c] >= need and bad[c] / n[c] >= confidence}
    return {c: p for c, p in rules.items() if not any(rules.get(tuple(x for x in c if x != y), 0) >= p for y in c)}


def labelled_urls(n=400):
    rng = random.Random(3)
    out = []
    for i in range(n):
        host = rng.choice(["spam.example.com", "www.good.org", "m.example.com"])
        path = rng.choice(["en", "buy", "de"])
        url = f"http://{host}/{path}/{i % 9}" + rng.choice(["", "?ref=x", "?page=2&ref=x"])
        out.append((url, rng.random() < (0.9 if "spam" in host or path == "buy" and "m." in host else 0.1)))
    return out


def test_rules_by_brute_force(spark):
    rows = labelled_urls() + [(None, True), ("nothing", True)]
    want = slow_rules(rows, 0.01, 5, 0.6)
    got = url_filter.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"), 0.01, 5, 0.6).collect()
    assert {tuple(sorted(r.tokens)): pytest.approx(r.confidence) for r in got} == want and want


def test_tokens_that_go_together_are_mined_as_one(spark):
    long_url = "http://" + ".".join(f"h{i}" for i in range(20)) + "/" + "/".join(f"p{i}" for i in range(20))
    rows = [(long_url, True)] * 6 + [("http://a.b/x", i % 2 == 0) for i in range(12)] + [("http://a.b/y?k=1", True)] * 5 + [(None, True), ("http://c.d/" + "z" * 50_000, False)]
    got = {tuple(r.tokens): (r.confidence, r.n) for r in url_filter.mine_rules(spark.createDataFrame(rows, "url string, bad boolean"), 0.01, 5, 0.6).collect()}
    assert got[("h:h3",)] == got[("p:p19",)] == (1.0, 6) and got[("p:y",)] == got[("q:k",)] == (1.0, 5)
    assert len(got) == 44 and got[("h:a",)] == (pytest.approx(11 / 17), 17)


def test_verdicts_by_brute_force(spark):
    rows = labelled_urls()
    rules = slow_rules(rows, 0.01, 5, 0.6)
    urls = URLS + [u for u, _ in rows[:60]] + [rows[0][0]]
    pages = with_clashes(spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, html string"))
    got = {r.page_id: r for r in url_filter.judge_urls(pages, spark.createDataFrame(rows, "url string, bad boolean"), support=0.01, least=5, confidence=0.6).collect()}
    hand = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    for i, u in enumerate(urls):
        host = path = ""
        if u is not None and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([k for k in map(rest.find, "/?#") if k >= 0] + [len(rest)])
            host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fit = [r for r in hand if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
        rule = max(fit, key=len, default=None)
        mined = any(set(c) <= slow_tokens(u) for c in rules)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, hand[rule] if rule else "block" if mined else "allow")
    assert len(got) == len(urls)


def test_without_labels_nothing_is_mined(spark):
    none = spark.createDataFrame([], "url string, bad boolean")
    pages = spark.createDataFrame([(1, "http://a.b/c"), (None, None)], "page_id long, url string")
    assert {r.verdict for r in url_filter.judge_urls(pages, none).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), none).count() == 0


# op7


def test_wordings_are_found_and_differences_named(spark):
    rows = [(1, "x y\nReleased under the MIT license!\nz", "s"), (2, "Licensed under the Apache Public License, Version 2.0.", "s"), (3, "we licensed under water the rights", "s"), *ODD[:3], (9, "w " * 50_000 + "Licensed under CC BY-NC 4.0.", "s"), (10, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0.", "s")]
    got = license_scan.scan(with_clashes(docs_of(spark, rows))).collect()
    found = sorted((r.doc_id, r.license, r.start, tuple(r.missing), tuple(r.added)) for r in got if r.doc_id != 2)
    assert found == [(1, "MIT", 2, (), ()), (9, "CC-BY-NC-4.0", 50_000, (), ()), (10, "CC-BY-NC-4.0", 0, (), ()), (10, "CC-BY-NC-4.0", 7, (), ())]
    assert {(r.license, bool(r.missing or r.added)) for r in got if r.doc_id == 2} <= {("Apache-2.0", True)}
    assert license_scan.scan(docs_of(spark, [])).count() == 0


def slow_differences(want, have):
    row = list(range(len(have) + 1))
    for i, w in enumerate(want, 1):
        row, before = [i], row
        for j, h in enumerate(have):
            row.append(before[j] if w == h else min(before[j + 1], row[j]) + 1)
    return row[-1]


def test_no_block_is_missed_by_brute_force():
    rng = random.Random(17)
    templates = [("one", "released under the mit license"), ("two", "licensed under cc by nc 4 0"), ("three", "use of this source code is governed by a style license")]
    scanner = license_scan.Scanner(templates)
    assert scanner.slack == {"one": 1, "two": 1, "three": 2}
    words = sorted({w for _, t in templates for w in t.split()}) + ["x", "y"]
    hits = 0
    for _ in range(400):
        ws = [rng.choice(words) for _ in range(rng.randint(0, 6))]
        for _ in range(rng.randint(0, 2)):
            own = rng.choice(templates)[1].split()
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(own) + 1)
                own[k : k + rng.randint(0, 1)] = [rng.choice(words)] if rng.random() < 0.5 else []
            ws += own + [rng.choice(words) for _ in range(rng.randint(0, 4))]
        got = scanner.scan(" ".join(ws))
        for name, start, n, _, missing, added in got:
            want = scanner.words[name]
            assert slow_differences(want, ws[start : start + n]) == len(missing) + len(added) <= scanner.slack[name]
        assert all(a[1] + a[2] <= b[1] for a, b in zip(got, got[1:]))
        for name, want in scanner.words.items():
            for a in range(len(ws)):
                for b in range(a + 1, min(len(ws), a + len(want) + scanner.slack[name]) + 1):
                    if slow_differences(want, ws[a:b]) <= scanner.slack[name]:
                        hits += 1
                        assert any(s < b and a < s + n for _, s, n, *_ in got), (ws, name, a, b, got)
    assert hits > 300


def test_whole_licences_with_changes():
    s = license_scan.Scanner(license_scan.TEMPLATES)
    text = dict(license_scan.TEMPLATES)["MIT (text)"]
    (found,) = s.scan("Copyright 2024 A. " + text.replace("free of charge, ", "").replace("AUTHORS", "WRITERS AND AUTHORS") + " end")
    assert (found[0], found[1], found[4], found[5]) == ("MIT (text)", 3, ["free", "of", "charge"], ["writers", "and"])
    assert [x[0] for x in s.scan("Released under MIT License.")] == ["MIT"]


def test_each_template_saves_most_on_itself():
    s = license_scan.Scanner(license_scan.TEMPLATES)
    for name, text in license_scan.TEMPLATES:
        block = " ".join(license_scan.wording(text)).encode()
        alone = len(s.plain.compress(block))
        assert max(s.words, key=lambda n: s.reduction(n, block, alone)) == name


# op4


def test_probabilities_sum_to_one_and_match_plain_counts(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc d.é") for _ in range(rng.randint(1, 80))) for _ in range(200)] + [None, ""]
    model = perplexity.known(perplexity.fit(spark.createDataFrame([(t,) for t in texts], "text string")).toPandas())[0]
    p = lambda *grams: np.exp(model.log_p(np.array(grams, np.int64)))
    bits, two = perplexity.BITS, perplexity.TWO
    for context in (0, ord("a"), ord("a") << bits | ord("b"), ord("é") << bits | ord("x")):
        seen = [context << bits | ord(c) for c in "abc d.é" + perplexity.AGAIN]
        assert p(*seen).sum() + (perplexity.POINTS - len(seen)) * p(context << bits | ord("q"))[0] == pytest.approx(1, abs=1e-6)

    c3 = Counter()
    for t in texts:
        padded = "\0\0" + perplexity.marked(t or "")
        c3.update(ord(x) << 2 * bits | ord(y) << bits | ord(z) for x, y, z in zip(padded, padded[1:], padded[2:]))
    c2 = Counter(g & two for g in c3)
    c1 = Counter(g & perplexity.ONE for g in c2)

    def off(counts):
        k = [sum(v == i for v in counts.values()) for i in (1, 2, 3, 4)]
        if min(k) == 0:
            return [0.5] * 3
        y = k[0] / (k[0] + 2 * k[1])
        return [min(max(i - (i + 1) * y * k[i] / k[i - 1], 0), i) for i in (1, 2, 3)]

    def prob(counts, context, gram, d, low):
        own = {g: v for g, v in counts.items() if context is None or g >> bits == context}
        if not own:
            return low
        total = sum(own.values())
        v = own.get(gram, 0)
        take = lambda v: d[min(v, 3) - 1] if v else 0
        return (v - take(v)) / total + sum(map(take, own.values())) / total * low

    d1, d2, d3 = off(c1), off(c2), off(c3)
    for g in [*list(c3)[:20], 5, 70 << 2 * bits | 67 << bits | 68]:
        low1 = prob(c1, None, g & perplexity.ONE, d1, 1 / perplexity.POINTS)
        low2 = prob(c2, (g & two) >> bits, g & two, d2, low1)
        assert p(g)[0] == pytest.approx(prob(c3, g >> bits, g, d3, low2), rel=1e-9)


def test_words_stand_above_their_spelling(spark):
    texts = ["the cat the dog\nthe cat", "a dog  sat on", "on on on the mat", "x", "the end", ""]
    models = perplexity.known(perplexity.fit(spark.createDataFrame([(t,) for t in texts], "text string")).toPandas())
    words = Counter(w for t in texts for w in perplexity.WORDS.findall(perplexity.marked(t)))
    k = [sum(v == i for v in words.values()) for i in (1, 2, 3, 4)]
    y = k[0] / (k[0] + 2 * k[1]) if min(k) else 0
    d = [min(max(i - (i + 1) * y * k[i] / k[i - 1], 0), i) for i in (1, 2, 3)] if min(k) else [0.5] * 3
    total = sum(words.values())
    weight = sum(d[min(v, 3) - 1] for v in words.values()) / total
    probes = ["the dog sat", "unseen words here ", "the the cat", "x", " \n"]
    got = perplexity.perplexities(models, [*probes, "", None], [0] * 7).perplexity.tolist()
    for text, found in zip(probes, got):
        m, at, want = perplexity.marked(text), 0, 0.0
        assert "".join(perplexity.WORDS.findall(m)) == m
        spelt = models[0].log_p(next(perplexity.slices([text]))[1])
        for w in perplexity.WORDS.findall(m):
            own = (words[w] - d[min(words[w], 3) - 1]) / total if w in words else 0
            want += np.log(own + weight * np.exp(spelt[at : at + len(w)].sum()))
            at += len(w)
        assert found == pytest.approx(np.exp(-want / len(m)), rel=1e-9)
    assert np.isnan(got[-2:]).all()


def test_repeated_words_are_marked():
    cases = {"a a b": "a\x01 b", "are. are.\nare. x": "are.\x01\x01 x", "ab abc ab": "ab abc ab", "a b a b": "a b a b", "x  x": "x\x01", "": "", "the the": "the\x01", "aa a": "aa a", "é é é": "é\x01\x01"}
    assert {t: perplexity.marked(t) for t in cases} == cases


def test_long_texts_are_taken_whole_in_stretches(monkeypatch):
    texts = ["abcdefghij" * 30, "", "xy", "é" * 101]
    want = {i: g.tolist() for i, t in enumerate(texts) for _, g in perplexity.slices([t])}
    monkeypatch.setattr(perplexity, "SLICE", 7)
    got: dict = {}
    for whose, grams in perplexity.slices(texts):
        for i, g in zip(whose.tolist(), grams.tolist()):
            got.setdefault(i, []).append(g)
    assert got == want and [len(got.get(i, [])) for i in range(4)] == [300, 0, 2, 101]


def test_a_large_model_is_joined_with_the_same_results(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(docs_of(spark, ODD).select("doc_id", "text"), allowMissingColumns=True)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = lambda: sorted(((r.doc_id, r.lang, r.perplexity and round(r.perplexity, 9), r.threshold and round(r.threshold, 9), r.kept) for r in perplexity.judge(docs, labels).collect()), key=str)
    want = rows()
    monkeypatch.setattr(perplexity, "MODEL_ROWS", 10)
    assert rows() == want and len(want) == docs.count()


def test_blocks_ask_a_joined_model_by_few_rows(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = lambda: sorted((r.doc_id, *[f"{x or np.nan:.9f}" for x in r.score]) for r in perplexity.score(rows, model).collect())
    rows = docs.join(labels.where("quality = 1").select("doc_id").distinct().withColumn("t", F.lit(1)), "doc_id", "left").select("doc_id", "text", F.when(F.col("t") == 1, perplexity.fold_of(F.col("text"))).otherwise(0).alias("fold")).repartition(8)
    model = perplexity.fit(rows.where("fold > 0").select("text"))
    want = scored()
    monkeypatch.setattr(perplexity, "MODEL_ROWS", 10)
    monkeypatch.setattr(perplexity, "SHARD_ROWS", 2000, raising=False)
    before = shuffled(spark)
    assert scored() == want and model.count() > 6000
    assert 0 < shuffled(spark) - before < model.count() + 10 * docs.count()


def shuffled(spark) -> int:
    """Rows that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_what_is_asked_of_a_model_is_packed_as_it_is():
    rng = np.random.default_rng(1)
    words, grams = np.unique(rng.integers(-(1 << 63), 1 << 63, 20_000)), np.unique(rng.integers(0, 1 << 63, 50))
    kind, key = np.repeat([3, perplexity.WORD], [len(grams), len(words)]), np.concatenate([grams, words])
    values = [np.where(rng.random(len(key)) < 0.2, np.nan, rng.geometric(0.5, len(key))) for _ in range(3)]
    for n in (0, 1, len(key)):
        packed = perplexity._pack(kind[:n], key[:n], [v[:n] for v in values])
        got = perplexity._unpack(packed, 3)
        assert np.array_equal(got[0], kind[:n]) and np.array_equal(got[1], key[:n])
        assert all(np.array_equal(a, b[:n], equal_nan=True) for a, b in zip(got[2], values))
    assert len(packed) < 9 * len(key) and len(perplexity._pack(kind, key)) < 7.5 * len(key)


def test_python_and_spark_deal_keys_to_the_same_shards(spark):
    keys = [0, 1, -1, (1 << 63) - 1, -(1 << 63), 1 << 62, -(1 << 62), 97 << 42 | 98 << 21 | 99, perplexity.PRIME]
    rows = [(k, x) for k in (1, 3, perplexity.WORD, perplexity.LOSS, 13) for x in keys if k == perplexity.WORD or x >= 0]
    kind, key = (np.array(c, np.int64) for c in zip(*rows))
    for shards in (1, 7, 4000):
        got = spark.createDataFrame(rows, "kind int, key long").select("kind", "key", perplexity._shard_column(shards).alias("s")).collect()
        want = {(k, x): s for (k, x), s in zip(rows, perplexity._shard(kind, key, shards).tolist())}
        assert {(r.kind, r.key): r.s for r in got} == want and set(want.values()) <= set(range(shards))


def test_blocks_hold_all_rows_in_order(monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 3)  # noqa: N815

    monkeypatch.setattr(perplexity, "TaskContext", Task)
    monkeypatch.setattr(perplexity, "BLOB_BYTES", 50)
    monkeypatch.setattr(perplexity, "BLOCK_BYTES", 120)
    texts = ["a" * n for n in (0, 10, 49, 1, 1, 300, 0, 0, 70, 20)] + [None, "é" * 30]
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(k, k + len(t))), "text": pa.array(t, pa.string())}) for k, t in ((0, texts[:7]), (7, texts[7:]), (12, []))]
    out = [b.to_pylist()[0] for b in perplexity._blocks(iter(batches))]
    frames = list(perplexity._rows(x["blob"] for x in out))
    assert [i for f in frames for i in f.doc_id] == list(range(12)) and [t for f in frames for t in f.text] == texts
    blocks = [x["block"] for x in out]
    assert blocks == sorted(blocks) and blocks[0] == 3 << 32 and len(set(blocks)) > 3


def test_junk_is_told_from_trusted_text(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.col("doc_id") % 2 == 0
    got = perplexity.judge(docs, labels.where(~held)).join(labels.where(held), "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.85
    assert got[got.quality == 0].kept.mean() < 0.3


@pytest.mark.parametrize("rows", [[], ODD])
def test_judging_without_labels(spark, rows):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = perplexity.judge(with_clashes(docs_of(spark, rows)), labels).collect()
    assert len(got) == len(rows) and not any(r.kept for r in got)


# The pipeline


def test_stages_on_their_own_inputs(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    clean = [prose(rng.randint(40, 120)) for _ in range(30)]
    near = clean[0].split()
    near[5] = "changed"
    texts = clean + [clean[1], " ".join(near), f"{prose(30)} {passage} {prose(30)}", f"{prose(25)} {passage} {prose(20)}", "short", "again and again it goes " * 20, None]
    docs = docs_of(spark, [(i, t, f"src{i % 3}") for i, t in enumerate(texts)])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    a = cp.quality(spark, docs, "")
    assert sorted(r.doc_id for r in a.collect()) == list(range(34))
    b = cp.near_copies(spark, a, "")
    assert sorted(r.doc_id for r in b.collect()) == [*range(30), 32, 33]
    c = {r.doc_id: r for r in cp.passages(spark, b, "").collect()}
    assert sorted(c) == [*range(30), 32, 33]
    for i in range(30):
        assert c[i].text == texts[i]
    for i in (32, 33):
        assert passage not in c[i].text and c[i].n_chars == len(c[i].text) < len(texts[i]) - 200
    for stage in (cp.quality, cp.near_copies, cp.passages, cp.mixture):
        assert stage(spark, docs, "").columns == docs.columns
        assert stage(spark, docs.limit(0), "").count() == 0
    out = cp.run(spark, str(tmp_path)).toPandas()
    mixed = cp.mixture(spark, cp.passages(spark, b, ""), "").groupBy("doc_id").count().toPandas()
    assert {d: n for d, n in out[out.piece == 0].groupby("doc_id").size().items()} == dict(mixed.values.tolist())
    assert (out.groupby("sequence_id").length.sum() <= 2048).all()


def test_model_keeps_no_table_but_its_own(spark):
    before = stored_tables(spark)
    model = perplexity.fit(spark.createDataFrame([("one two two three",), ("two one",), ("three four",)], "text string"))
    assert len(stored_tables(spark) - before) == 1 and model.count() > 10


def stored_tables(spark) -> set[str]:
    from pathlib import Path
    from urllib.parse import urlparse

    from doclathe.llm._shared import _folder

    return {x.name for x in Path(urlparse(_folder(spark)).path).iterdir()}
