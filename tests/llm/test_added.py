"""Personal data, importance resampling and the conversation trie: brute force and odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from doclathe.llm import conversation_trie, importance, sanitise

from test_counted import DOC, ODD, docs_of, with_clashes

# op11

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def slow_base(text):
    def fits(kind, m):
        digits = [int(c) for c in m if c.isdigit()]
        if kind == "ip":
            return all(int(p) <= 255 for p in m.split("."))
        if kind == "card":
            doubled = [d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind != "phone" or 10 <= len(digits) <= 15

    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(PLAIN) for m in re.finditer(p, text or "") if fits(kind, m[0]))


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(5)
    parts = ["a@b.cc", "@", ".", "..", "x%y@", "-", " ", "+", "+1 (017) 555-7713", "10.0.0.255", "256.1.1.1", "0001.2.3.4.5", "4012888888881881", "4012 8888-8888 1881", "9", "ä", "\U0001f600", "a", "\n", "(", ")"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert sanitise.base_spans(text) == slow_base(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "+1" + "(" * 400_000, "a@" * 200_000, "1 " * 200_000):
        sanitise.base_spans(text)


def slow_private(texts, window, support, generalise):
    term = re.compile(r"[^\W_]{3,}")
    texts = [t or "" for t in texts]
    met, contexts, n_entity, n_term = Counter(), defaultdict(set), Counter(), Counter()
    for t in texts:
        spans = slow_base(t)
        free = [m for m in term.finditer(t) if not any(s < m.end() and m.start() < e for s, _, e in spans)]
        here, entities = set(), set()
        for s, k, e in spans:
            value = t[s:e].lower() if k < 2 else "".join(c for c in t[s:e] if c.isdigit())
            near = [m[0].lower() for m in free if m.end() <= s][-window:] + [m[0].lower() for m in free if m.start() >= e][:window]
            entities.add((k, value))
            for w in near:
                here.add(((k, value), w))
                contexts[(k, value), w].add(tuple(near))
        met.update(here)
        n_entity.update(entities)
        n_term.update({m[0].lower() for m in term.finditer(t)})
    shares = {}
    for (c, w), n in met.items():
        info = math.log2(len(texts) / n_entity[c])
        if len(contexts[c, w]) >= support and info > 0:
            shares[w] = max(shares.get(w, 0), math.log2(len(texts) * n / (n_term[w] * n_entity[c])) / info)
    shares = {w: s for w, s in shares.items() if s >= generalise}
    out = []
    for t in texts:
        base = slow_base(t)
        out.append(sorted(base + [(m.start(), 4, m.end()) for m in term.finditer(t) if m[0].lower() in shares and not any(s < m.end() and m.start() < e for s, _, e in base)]))
    return out


def revealing_texts():
    rng = random.Random(8)
    words = ["river", "Stone", "green", "market", "window", "paper", "Winter", "coffee", "mountain", "train", "letters", "music"]
    out = []
    for i in range(160):
        some = [rng.choice(words) for _ in range(rng.randint(5, 25))]
        if i % 16 == 0:
            some[3:3] = ["Zorblat", "agent7", "mail", "z.b@mail.example.com"]
        if i % 80 == 1:
            some.append("zorblat")
        if i % 20 == 3:
            some += ["+44 20 7946 0958", "harbour"]
        out.append(" ".join(some))
    copy = "A passage that Quibblex wrote to q.x@mail.example.org is copied"
    return out + [copy] * 20 + [None, "", "no data", "4012888888881881"]


def test_terms_by_brute_force(spark):
    texts = revealing_texts()
    docs = with_clashes(docs_of(spark, [(i, t, "s") for i, t in enumerate(texts)]))
    got = {r.doc_id: r.clean for r in sanitise.sanitise(docs).collect()}
    want = slow_private(texts, 8, 3, 0.9)
    assert {i: [(s.start, s.kind, s.end) for s in r.spans] for i, r in got.items()} == dict(enumerate(want))
    terms = {(texts[i] or "")[s:e] for i, spans in enumerate(want) for s, k, e in spans if k == 4}
    assert {"Zorblat", "agent7"} <= terms and not {"Quibblex", "river", "mail"} & terms
    assert "z.b@" not in got[0].text and "Zorblat" not in got[0].text and "[EMAIL]" in got[0].text
    assert got[1].text.endswith(" [WORD]") and " [NAME] [...] mail [EMAIL] " in got[0].text
    assert got[len(texts) - 4].text is None and got[len(texts) - 3].text == "" and got[len(texts) - 1].text == "[CARD]"


def test_private_data_in_odd_documents(spark):
    docs = with_clashes(docs_of(spark, [*ODD, (9, "x " * 40_000 + "me@here.example.com", "b"), (9, "me@here.example.com", "b"), (9, "me@here.example.com", "b")]))
    out = sanitise.sanitise(docs)
    assert sorted(out.columns) == sorted([*docs.columns, "clean"])
    rows = out.collect()
    assert len(rows) == len(ODD) + 3 and sum(len(r.clean.spans) for r in rows) == 3
    assert sanitise.sanitise(docs.limit(0)).count() == 0


def test_the_digest_columns(spark, tmp_path):
    rows = [(1, "call +1 (017) 555-7713 or a@b.cc", "s"), (2, None, "s"), (3, "10.0.0.1, 4012888888881881", "s")]
    docs_of(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in sanitise.op11_disclosure(spark, str(tmp_path)).collect()}
    for i, text, _ in rows:
        said = ",".join(f"{sanitise.KINDS[k]}:{s}:{e}" for s, k, e in slow_base(text))
        assert (got[i].spans, got[i].base_sha256) == (said, hashlib.sha256(said.encode()).hexdigest())
    assert [(got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone) for i in (1, 2, 3)] == [(1, 0, 0, 1), (0, 0, 0, 0), (0, 1, 1, 0)]


# op12


def slow_features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) for i in range(len(words)) for k in range(1, n + 1) if i + k <= len(words)]


def slow_resample(docs, target, n, buckets, least, percent):
    s, t, feats = Counter(), Counter(), []
    for i, text in docs:
        words, f = slow_features(text, n)
        f = [x % buckets for x in f]
        s.update(f)
        feats.append((i, words, f))
    for text in target:
        t.update(x % buckets for x in slow_features(text, n)[1])
    total, goal = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (goal + buckets))))
    rows = []
    for k, (i, words, f) in enumerate(feats):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("n", [1, 3])
def test_weights_and_ranks_by_brute_force(spark, n, monkeypatch):
    rng = random.Random(2)
    vocabulary = ["the", "Ä", "naïve", "x1", "y", "UPPER", "lower", "ſ", "İx"]
    said = lambda k: "".join(rng.choice(vocabulary) + rng.choice([" ", "\n", "-", "\x7f", "."]) for _ in range(k))
    docs = [(i, said(rng.randint(0, 60))) for i in range(120)] + [(i, t) for i, t, _ in ODD]
    target = [said(30) for _ in range(5)] + [None, ""]
    monkeypatch.setattr(importance, "PIECE", 64)
    monkeypatch.setattr(importance, "BLOCK", 16)
    df = with_clashes(spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string"))
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, goal, n=n, buckets=97, least=10, percent=30).collect()
    assert sorted((tuple(r) for r in got), key=str) == slow_resample(docs, target, n, 97, 10, 30)


def test_resampling_without_rows_and_with_all_columns(spark):
    goal = spark.createDataFrame([("some words here",)], "text string")
    docs = with_clashes(docs_of(spark, [*ODD, *[(7, "some words here " * 9, "s")] * 12]))
    assert importance.resample(docs.limit(0), goal).count() == 0
    assert importance.resample(docs, goal.limit(0)).where("rank IS NOT NULL").count() == 1
    drawn = importance.drawn_documents(docs, goal, least=3, percent=50)
    assert drawn.columns == [*docs.columns, "draw"] and drawn.count() == 8


# op13


def slow_trie(rows, family=5, most=9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            key = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own[c].append(((turn is not None, turn or 0), role or "", key, text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most
        first = sorted(own.get(c - c % family, []))
        built[c] = [(t[1], t[3]) for t in first[:h] + sorted(turns)[h:]]
    members = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in kids
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CHAT = "conv_id long, turn long, role string, text string"


def check_trie(spark, rows):
    got = conversation_trie.prefix_trie(with_clashes(spark.createDataFrame(rows, CHAT).repartition(5)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_trie(rows)


def test_nodes_by_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(conversation_trie, "RUN_BYTES", 3000)
    monkeypatch.setattr(conversation_trie, "BLOCK_IDS", 7)
    rows = [(c, t if rng.random() < 0.97 else None, rng.choice(["user", "assistant", None]), rng.choice(["a", "bé", "", None])) for c in range(400) for t in range(rng.randint(1, 14))]
    rows += [(c, t, "user", "same") for c in range(500, 800) for t in range(5)]
    check_trie(spark, rows + rows[:20] + [(None, 1, "user", "x"), (9001, 1, "user", "a"), (9002, 1, "user", "b")])


def test_odd_conversations(spark):
    check_trie(spark, [])
    check_trie(spark, [(4, 1, "user", "x")])
    check_trie(spark, [(10, t, "user", f"t{t}") for t in range(120)] + [(11, t, "user", "x" * 50_000) for t in range(12)])


def test_merging_runs():
    rng = random.Random(6)
    seq = lambda: b"".join(bytes([rng.randint(0, 1)]) * conversation_trie.TURN for _ in range(rng.randint(0, 6)))
    for _ in range(300):
        entries = [[(seq(), [1], 1, i) for i in range(rng.randint(0, 12))] for _ in range(rng.randint(0, 7))]
        got = list(conversation_trie.merged([conversation_trie.sorted_run(e) for e in entries]))
        want = sorted(x for e in entries for x in {d for d, *_ in e})
        assert [g[1] for g in got] == want
        assert [g[0] for g in got] == [0, *(conversation_trie._shared(a, b, 0) for a, b in zip(want, want[1:]))][: len(want)]
