"""Packing, mixing, quality rules and chats: brute force, round trips and odd inputs."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from doclathe.llm import chat_format, mixing, packing, quality_rules

DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("shard", "n", "x", "c", "base", "first", "_shard", "_rank", "row", "mix", "cut", "size", "copies", "f", "host", "failed", "rank", "kind", "digest")


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOC)


def with_clashes(df):
    return df.withColumns({c: F.lit(7) for c in CLASH if c not in df.columns})


ODD = [(1, None, "a"), (2, "", "a"), (3, "one two  three\n", None), (3, "one two  three\n", None), (None, "x " * 30_000, "b"), (5, "tab\tsep\x0bwords\x1cnot", "b"), (6, "ä ß 中文 <|endoftext|>", "b")]


# op1

MARKED = "a\x01b \x01 c"


def test_tokens_equal_the_tokenizer():
    rng = random.Random(1)
    parts = [*"aZ \x01é'sΣς’dll 0123\n\t\x0b\x1c\x85\xa0́İ!?,.-ß中 ", "<|endoftext|>", "don't", "WORD.", "a1,"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    path = packing.word_tokenizer()
    tok = packing._tokenizer(path)
    for words in (packing.Words(path), packing.words_of(path)):
        ids, ends = packing.token_ids(words, pa.array([None, *texts, ""]))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [tok.encode(t, add_special_tokens=False).ids + [0] for t in ("", *texts, "")]
    assert [len(x) for x in packing.token_ids(packing.words_of(path), pa.array([], pa.string()))] == [0, 0]


def test_words_are_forgotten_in_time(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    path = packing.word_tokenizer()
    words, tok = packing.Words(path), packing._tokenizer(path)
    for k in range(12):
        texts = [f"w{k}x{i} same {MARKED}" for i in range(30)]
        ids, ends = packing.token_ids(words, pa.array(texts))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [tok.encode(t, add_special_tokens=False).ids + [0] for t in texts]
        assert len(words.number) <= 100


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_each_piece_once(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice((rng.randint(1, 40), rng.randint(1, 100))) for _ in range(rng.randint(0, 400)))
    steps = packing.plan(counts, 100)
    used = Counter()
    for filling, times in steps:
        assert sum(x * n for x, n in filling) <= 100
        for x, n in filling:
            used[x] += n * times
    assert used == counts
    rooms: list[int] = []
    for x in sorted(counts.elements(), reverse=True):  # best-fit, one by one
        fit = [r for r in rooms if r >= x]
        rooms.remove(min(fit)) if fit else None
        rooms.append((min(fit) if fit else 100) - x)
    assert packing.least_bins(counts, 100) <= sum(t for _, t in steps) <= len(rooms)


def test_plan_is_least_on_small_inputs():
    def least(items, rooms):
        if not items:
            return len(rooms)
        best = least(items[1:], rooms + (20 - items[0],))
        for i, r in enumerate(rooms):
            if r >= items[0]:
                best = min(best, least(items[1:], rooms[:i] + (r - items[0],) + rooms[i + 1 :]))
        return best

    rng = random.Random(3)
    for _ in range(25):
        items = tuple(sorted((rng.randint(1, 20) for _ in range(7)), reverse=True))
        assert sum(t for _, t in packing.plan(Counter(items), 20)) == least(items, ())


def test_plan_goes_on_after_best_fit_on_many_lengths():
    rng = random.Random(9)
    counts = Counter(min(2048, int(rng.gauss(1000, 350))) for _ in range(20_000))
    counts = Counter({x: n for x, n in counts.items() if x >= 350})
    left, first = Counter(counts), 0
    for x in sorted(counts, reverse=True):
        while left[x]:
            f = packing._best_fit(left, sorted(+left, reverse=True), 2048)
            times = min(left[y] // n for y, n in f)
            left.subtract({y: n * times for y, n in f})
            first += times
    steps = packing.plan(counts)
    used = Counter()
    for f, times in steps:
        used.update({x: n * times for x, n in f})
    assert used == counts
    assert packing.least_bins(counts, 2048) <= sum(t for _, t in steps) < first


def test_small_inputs_are_planned_in_time():
    rng = random.Random(12)
    for k in range(200):
        low, high = [(150, 190), (170, 200), (300, 378), (100, 1000), (300, 1100)][k % 5]
        lengths = [rng.randint(low, high) for _ in range(rng.choice([8, 12, 24 if k % 2 else 4096 // ((low + high) // 2)]))]
        if k % 5 < 3:  # a sum of exactly two sequences, where the last piece can make it
            last = 4096 - sum(lengths[1:])
            lengths[0] = last if 0 < last <= 2048 else lengths[0]
        began = time.time()
        steps = packing.plan(Counter(lengths))
        assert time.time() - began < 2
        used = Counter()
        for f, n in steps:
            assert sum(x * m for x, m in f) <= 2048
            used.update({x: m * n for x, m in f})
        assert used == Counter(lengths)


def test_completions_are_searched_whole():
    rng = random.Random(5)
    for _ in range(60):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        fewest = sum(t for _, t in packing.plan(Counter(items), 20))
        assert len(packing.complete(Counter(items), fewest, 20, 10_000)) == fewest
        assert packing.complete(Counter(items), fewest - 1, 20, 10_000) is None
    with pytest.raises(packing._Spent):
        packing.complete(Counter(range(100, 200)), 8, 2048, 3)


def test_pack_is_gapless(spark):
    got = packing.pack(with_clashes(packing.pieces(with_clashes(docs_of(spark, ODD)), packing.word_tokenizer(), 64)), 64).toPandas()
    tok = packing._tokenizer(packing.word_tokenizer())
    for i, t, _ in ODD:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        mine = got[got.doc_id == i] if i is not None else got[got.doc_id.isna()]
        assert {(r.start, r.length, r.ids_crc32) for r in mine.itertuples()} == {(s, len(ids[s : s + 64]), zlib.crc32(array("I", ids[s : s + 64]).tobytes())) for s in range(0, len(ids), 64)}
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 64


def test_pack_of_nothing(spark):
    assert packing.pack(packing.pieces(docs_of(spark, []), packing.word_tokenizer())).count() == 0


# op10


def test_targets_by_pouring(spark):
    rng = random.Random(5)
    sizes = {f"s{i:02}": rng.choice((0, 5, 100, 1000, 20_000)) for i in range(17)} | {None: 50}
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    names = sorted((k for k in sizes if k is not None)) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    target, open_, rest = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while open_:
        level = rest / sum(weight[k] for k in open_)
        full = {k for k in open_ if level * weight[k] > 3 * sizes[k]}
        for k in full:
            target[k] = 3.0 * sizes[k]
            rest -= target[k]
        open_ -= full
        if not full:
            target |= {k: level * weight[k] for k in open_}
            break
    assert got == pytest.approx(target)


def test_mix_is_near_and_steady(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(3000)]
    df = with_clashes(docs_of(spark, rows))
    got = mixing.pareto_mix(df).select("doc_id", "source", "mix.*").toPandas()
    again = mixing.pareto_mix(df.repartition(7)).select("doc_id", "source", "mix.*").toPandas()
    assert set(map(tuple, got[["doc_id", "copies"]].values)) == set(map(tuple, again[["doc_id", "copies"]].values))
    assert (got.taken <= 3 * got["size"]).all() and len(got) == 3000
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()


@pytest.mark.parametrize("weights", [(5, 2, 1), (1, 1, 1)])
def test_which_documents_are_taken_by_plain_pareto_sampling(spark, weights):
    """Order and cut recomputed in Python from the same random numbers."""
    rng = random.Random(19)
    rows = [(i, "w " * rng.choice((0, rng.randint(1, 40), rng.randint(100, 900))), rng.choice(["a", "a", "a", "a", "b", "c", None])) for i in range(1500)]
    df = docs_of(spark, rows)
    u = {r.doc_id: r.u for r in df.select("doc_id", ((F.shiftrightunsigned(F.xxhash64(F.lit(20), "doc_id", "text"), 12) + 0.5) / float(1 << 52)).alias("u")).collect()}
    got = {r.doc_id: r for r in mixing.pareto_mix(df, weights, prefer=lambda size: mixing.shorter_first(size, 100)).select("doc_id", "mix.*").collect()}
    unequal = 0
    for s in {s for *_, s in rows}:
        own = [(i, len(t.split())) for i, t, x in rows if x == s]
        total = sum(n for _, n in own)
        target = got[own[0][0]].target
        like = {i: 100 / (100 + n) for i, n in own}
        mean = sum(like[i] * n for i, n in own) / total
        ratio = target / total
        due = {i: min(max(ratio + min(ratio, 3 - ratio) * (like[i] - mean), 0), 3) for i, _ in own}
        assert sum(due[i] * n for i, n in own) == pytest.approx(target)
        unequal += len({round(d % 1, 6) for d in due.values()}) > 10
        left = target - sum(int(due[i]) * n for i, n in own)
        rank = {i: u[i] / (1 - u[i]) / (due[i] % 1 / (1 - due[i] % 1)) for i, _ in own if due[i] % 1}
        want, used, on = {i: int(due[i]) for i, _ in own}, 0, True
        size = dict(own)
        for i in sorted(rank, key=rank.get):
            on = on and used + size[i] / 2 <= left
            if on:
                want[i] += 1
                last = i
            used += size[i]
        far = [i for i in want if got[i].copies != want[i]]
        assert len(far) <= 1 and all(size[i] <= max(size.values()) for i in far), (s, far)
        assert abs(sum(got[i].taken for i, _ in own) - target) <= max(size.values())
    assert unequal


def test_unequal_shares_prefer(spark):
    rows = [(i, "w w w w w", "a" if i % 2 else "b") for i in range(4000)]
    share = F.when(F.col("doc_id") % 4 < 2, 1.6).otherwise(0.4)
    got = mixing.pareto_mix(docs_of(spark, rows), weights=(1, 3), share=share).select("doc_id", "mix.*").toPandas()
    odd = got[(got.doc_id % 2 == 1)]
    high, low = odd[odd.doc_id % 4 < 2].copies.mean(), odd[odd.doc_id % 4 >= 2].copies.mean()
    assert high / low == pytest.approx(4, rel=0.15)


@pytest.mark.parametrize("rows", [[], [(1, None, None)], ODD])
def test_mix_of_odd_rows(spark, rows):
    got = mixing.pareto_mix(docs_of(spark, rows)).select("doc_id", "text", "mix.*").collect()
    assert len(got) == len(rows)
    alike = [r.copies for r in got if r.doc_id == 3]
    assert len(set(alike)) <= 1


# op3


def slow_features(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\v\f\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_features_by_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a ", "b ", "c\n", "#", "\t", "\x1c", "é ", "a b a b "]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + ODD
    got = quality_rules.judge(with_clashes(docs_of(spark, rows)).drop("host", "f", "failed")).toPandas()
    want = Counter((*slow_features(t),) for _, t, _ in rows)
    assert Counter(map(tuple, got[list(quality_rules.NAMES)].values.tolist())) == want


def test_bad_hosts_go_and_small_ones_are_shrunk(spark):
    good, bad = "ten words that are all different so it is quite fine", "no"
    rows = [(i, bad if i % 100 < 95 else good, "bad") for i in range(400)] + [(1000 + i, good if i % 50 else bad, f"h{i % 8}") for i in range(1600)] + [(9000, bad, "tiny"), (9001, good, "tiny")]
    got = quality_rules.judge(docs_of(spark, rows)).toPandas()
    assert not got[got.host == "bad"].kept.any()
    assert got[(got.host != "bad") & ~got.base_failed].kept.all()


@pytest.mark.parametrize("rows", [[], ODD])
def test_good_documents_keep_their_columns(spark, rows):
    df = with_clashes(docs_of(spark, rows))
    out = quality_rules.keep_good(df)
    assert out.columns == df.columns
    assert out.count() == 0


# op5


def test_chats_come_back(spark):
    rng = random.Random(4)
    bits = ["[INST] ", " [/INST]", "</s>", "<s>", "<<SYS>>\n", "\n<</SYS>>\n\n", "\\", "[", "<", "/", "INST]", "[ROLE]", "[/ROLE]", "[/TURN]", "a", "\n", " ", "é", "$1"]
    rows = []
    for c in range(120):
        for t in range(rng.randint(1, 5)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "tool", "we[/ROLE]ird", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))])))
    rows += [(500, 1, "user", "x" * 100_000), (500, None, "system", ""), (501, 1, "user", "tie"), (501, 1, "user", "tie"), (None, 1, "user", "who")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    out = chat_format.format_chats(df).select("*", chat_format.parse_chat(F.col("formatted")).alias("turns")).collect()
    want: dict = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert {r.conv_id for r in out} == set(want)
    for r in out:
        assert [tuple(t) for t in r.turns] == [x[1:] for x in sorted(want[r.conv_id])]
        assert "".join(s.text for s in r.segments) == r.formatted


def test_order_of_roles(spark):
    cases = {"ua": (True, True), "sua": (True, True), "uau": (True, False), "au": (False, False), "uu": (False, False), "usa": (False, False)}
    names = {"u": "user", "a": "assistant", "s": "system"}
    rows = [(i, k, names[r], "x") for i, c in enumerate(cases) for k, r in enumerate(c)]
    got = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {r.conv_id: (r.valid_order, r.complete) for r in got} == dict(enumerate(cases.values()))


def test_hard_conversation_and_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    (r,) = chat_format.op5_role_machine(spark, str(tmp_path)).collect()
    text = "</s>[INST] ok [/INST]"
    assert r.conv_id == -1 and r.n_turns == 2 and r.loss_chars == len(text)
    assert r.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_chat_plan_is_native(spark):
    df = spark.createDataFrame([(1, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat_format.format_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
