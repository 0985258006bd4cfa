"""Best-fit packing: token counts of documents, and sequences planned by bin completion."""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import begin, bounded_batches, packed, stored, table

#: Rows of one length are numbered in shards of about so many.
SHARD_ROWS = 2048
#: Words that a worker remembers before it starts anew.
REMEMBERED = 500_000
#: Texts that are looked at together, at most.
ROWS = 512
#: Words that are encoded at a time, and the mark between them, a word by itself.
AT_ONCE, MARK = 128, "\x01"
#: A mark after a letter or digit, at a word's end: the tokenizer parts them as well.
END_MARK = r"([a-z0-9])([.,])(\s|$)"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Words:
    """Ids of the words met so far, one after another in one array."""

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer.__wrapped__(path)
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.start, self.size, self.used = np.empty(1 << 16, "<u4"), np.empty(1 << 15, np.int64), np.empty(1 << 15, np.int64), 0

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, at = len(self.number), self.used
        while len(self.start) < n + len(words):
            self.start, self.size = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.size))
        while len(self.ids) < at + len(ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[at : at + len(ids)] = ids
        self.size[n : n + len(words)] = sizes
        self.start[n : n + len(words)] = at + np.cumsum(sizes) - sizes
        self.used += len(ids)
        self.number.update(zip(words, range(n, n + len(words))))

    def places(self, words: list[str]) -> np.ndarray:
        """The number of each of some distinct words; what is new is encoded, many words at a time."""
        if len(self.number) + len(words) > REMEMBERED and self.number:
            self.forget()
        got = list(map(self.number.get, words))
        fresh = [w for w, g in zip(words, got) if g is None]
        plain = [w for w in fresh if MARK not in w] if len(self.mark) == 1 else []
        runs = [plain[i : i + AT_ONCE] for i in range(0, len(plain), AT_ONCE)]
        for run, e in zip(runs, self.tokenizer.encode_batch_fast([f" {MARK} ".join(r) for r in runs], add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids))
            if len(ends) == len(run):
                self._add(run, ids[ids != self.mark[0]], np.diff(ends, prepend=-1) - 1)
        for w in fresh:
            if w not in self.number:
                ids = self.tokenizer.encode(w, add_special_tokens=False).ids
                self._add([w], np.array(ids, "<u4"), np.array([len(ids)]))
        return np.array([self.number[w] if g is None else g for w, g in zip(words, got)], np.int64)


def words_of(path: str) -> Words:
    """One for each worker process and tokenizer, so that tasks share what is known."""
    kept = begin("packing")
    if path not in kept:
        kept[path] = Words(path)
    return kept[path]


def token_ids(words: Words, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, each followed by id 0, as one array, and where each text ends in it.

    The tokenizer drops white space and never joins over it, so a text's ids are those of
    its words in turn, and each distinct word is encoded once. It lowers letters and parts
    words from marks, so these are lowered and parted before, unless the text may hold a
    special token, whose string counts as it stands.
    """
    texts = texts.fill_null("")
    tidy = pc.replace_substring_regex(pc.ascii_lower(texts), END_MARK, r"\1 \2\3")
    split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, tidy))
    flat = split.flatten().dictionary_encode()
    place = words.places(flat.dictionary.to_pylist())
    of = place[flat.indices.to_numpy(zero_copy_only=False)]
    # each text ends with a word of its own, of the one id 0, which stands before all others
    ends = split.offsets.to_numpy()[1:] - split.offsets[0].as_py()
    size, start = np.insert(words.size[of], ends, 1), np.insert(words.start[of] + 1, ends, 0)
    ids = np.concatenate([np.zeros(1, "<u4"), words.ids[: words.used]])
    last = np.cumsum(size)
    out = ids[np.arange(last[-1] if len(last) else 0) + np.repeat(start - (last - size), size)]
    return out, last[ends + np.arange(len(ends))]


def pieces(docs: DataFrame, path: str, size: int = 2048) -> DataFrame:
    """Pieces of the documents (doc_id, text): doc_id, piece, start, length, ids_crc32.

    A document's ids are its tokens and id 0; null and empty texts have id 0 alone. Documents
    of over `size` ids are cut into pieces of `size`, the last of which may be shorter. Rows
    alike have their pieces each; no rows have none; other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        for b in (x.slice(i, ROWS) for x in batches for i in range(0, x.num_rows, ROWS)):
            ids, ends = token_ids(words, b.column("text"))
            first = np.append(0, ends[:-1])
            n = -(-(ends - first) // size)
            which = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            lo = first[which] + piece * size
            hi = np.minimum(lo + size, ends[which])
            data = memoryview(ids.view(np.uint8))
            crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(lo.tolist(), hi.tolist())]
            cols = [b.column("doc_id").take(pa.array(which)), pa.array(piece, pa.int32()), pa.array(piece * size, pa.int64()), pa.array(hi - lo, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first


def _best_fit(left: Counter, lengths: list[int], room: int) -> Filling:
    """The longest that fits, again and again."""
    got: list[tuple[int, int]] = []
    for x in lengths:
        if x <= room and (n := min(left[x], room // x)):
            got.append((x, n))
            room -= x * n
    return tuple(got)


def _dominated(filling: Filling, waste: int, left: Counter) -> bool:
    """Whether one free piece could stand for two or more of the filling's, which would be free instead."""
    used = dict(filling)
    sums = {x + y for x, n in filling for y, _ in filling if y < x or y == x and n > 1}
    sums |= {n * x for x, n in filling if n > 1}
    return any(left[y] > used.get(y, 0) for s in sums for y in range(s, s + waste + 1))


def fillings(left: Counter, lengths: list[int], room: int, width: float, tries: float, children: float = 8) -> list[Filling]:
    """Up to `width` undominated fillings of the room, least waste first, then fewest pieces."""
    lengths = [x for x in lengths if x <= room and left[x]]
    found: dict[Filling, int] = {_best_fit(left, lengths, room): 0}
    stack: list[tuple[int, int, Filling]] = [(0, room, ())]
    full = 0
    while stack and tries and full < width:
        at, r, got = stack.pop()
        tries -= 1
        used = dict(got)
        if left[r] > used.get(r, 0) and (not got or r <= got[-1][0]):
            one = tuple(sorted({**used, r: used.get(r, 0) + 1}.items(), reverse=True))
            found[one] = 0
            full += 1
            continue
        deeper = []
        for i in range(at, len(lengths)):
            x = lengths[i]
            if x < r and left[x] > used.get(x, 0):
                deeper.append((i, r - x, tuple(sorted({**used, x: used.get(x, 0) + 1}.items(), reverse=True))))
                if len(deeper) >= children:
                    break
        if not deeper:
            found.setdefault(got, 0)
        stack += reversed(deeper)
    ranked = sorted(((room - sum(x * n for x, n in f), sum(n for _, n in f), f) for f in found))
    kept: list[Filling] = []
    for waste, _, f in ranked:
        if len(kept) < width and not _dominated(f, waste, left):
            kept.append(f)
    return kept or [ranked[0][2]]


def least_bins(counts: dict[int, int], size: int) -> int:
    """Lower bound: pieces over half a sequence stand alone, and what fits beside none of them adds up."""
    best = -(-sum(x * n for x, n in counts.items()) // size)
    for k in {0, *(x for x in counts if x <= size // 2)}:
        large = sum(n for x, n in counts.items() if x > size - k)
        half = [(x, n) for x, n in counts.items() if size // 2 < x <= size - k]
        free = sum((size - x) * n for x, n in half)
        rest = sum(x * n for x, n in counts.items() if k <= x <= size // 2)
        best = max(best, large + sum(n for _, n in half) + max(0, -(-(rest - free) // size)))
    return best


def _search(left: Counter, bins: int, size: int, width: float, nodes: float, tries: float, children: float = 8) -> list[tuple[Filling, int]] | None:
    """The best solution of fewer than `bins` sequences that bin completion finds in `nodes` branches.

    The longest piece left opens a sequence and its undominated fillings are the branches, each
    used as often as its pieces last, then half as often and once. Depth first; a branch goes
    if its waste so far excludes fewer sequences than the best solution.
    """
    left = Counter(left)
    order, total = sorted(left, reverse=True), sum(x * n for x, n in left.items())
    bound = least_bins(left, size)

    def use(filling: Filling, times: int) -> None:
        for x, n in filling:
            left[x] -= n * times

    best: list[tuple[Filling, int]] | None = None
    path: list[tuple[Filling, int]] = []
    branches: list[list[tuple[Filling, int]]] = []
    starts: list[int] = []
    wasted, i, down = 0, 0, True
    while bins > bound:
        if down:
            i = _longest(left, order, i)
            if i == len(order):
                if (n := sum(t for _, t in path)) < bins:
                    best, bins = list(path), n
                down = False
                continue
            x = order[i]
            left[x] -= 1
            options = fillings(left, order[i:], size - x, width, tries, children)
            left[x] += 1
            whole = [tuple(sorted({**dict(f), x: dict(f).get(x, 0) + 1}.items(), reverse=True)) for f in options]
            often = [_often(left, f) for f in whole]
            once = dict.fromkeys([*zip(whole, often), *((f, n) for f, t in zip(whole, often) for n in (t // 2, 1) if n)])
            branches.append(list(reversed(once)))
            starts.append(i)
        if not branches:
            break
        if len(path) == len(branches):  # back to this depth: undo its branch
            f, t = path.pop()
            use(f, -t)
            wasted -= t * (size - sum(x * n for x, n in f))
        down = False
        if not branches[-1] or nodes <= 0:
            branches.pop()
            starts.pop()
            continue
        f, t = branches[-1].pop()
        waste = t * (size - sum(x * n for x, n in f))
        if total + wasted + waste > (bins - 1) * size:
            continue
        nodes -= 1
        use(f, t)
        path.append((f, t))
        wasted += waste
        i, down = starts[-1], True
    return best


class _Spent(Exception):
    """The steps of a search are used up."""


def _completions(left: Counter, room: int, slack: int) -> Iterator[Filling]:
    """Fillings of the room that waste at most `slack`, longest pieces first, made while they are asked for.

    Which sums the pieces from a length on can make is known as bits, so a branch that can't
    come to within `slack` of the room is cut where it begins. A filling goes if a free piece
    fits beside it, or is dominated.
    """
    lengths = [x for x in sorted(left, reverse=True) if left[x] and x <= room]
    whole = (1 << (room + 1)) - 1
    sums = [1]
    for x in reversed(lengths):
        bits, n, step = sums[-1], min(left[x], room // x), 1
        while n:  # as often as the pieces last, by doubling
            k = min(step, n)
            bits |= (bits << (x * k)) & whole
            n, step = n - k, step * 2
        sums.append(bits)
    sums.reverse()

    def reaches(i: int, r: int) -> bool:
        low = max(0, r - slack)
        return bool((sums[i] >> low) & ((1 << (r - low + 1)) - 1))

    stack: list[tuple[int, int, Filling]] = [(0, room, ())]
    while stack:
        i, r, got = stack.pop()
        if i == len(lengths):
            used = dict(got)
            if not any(left[x] > used.get(x, 0) for x in lengths if x <= r) and not _dominated(got, r, left):
                yield got
            continue
        x = lengths[i]
        for n in range(min(left[x], r // x) + 1):  # the greatest number is taken up first
            if reaches(i + 1, r - n * x):
                stack.append((i + 1, r - n * x, (*got, (x, n)) if n else got))


def complete(counts: dict[int, int], bins: int, size: int, steps: int) -> list[Filling] | None:
    """A packing into `bins` sequences, or None if there is none; _Spent if neither is known after `steps` fillings.

    Depth first on the longest piece's completions. The slack that is left bounds each one's
    waste, and what pieces were found not to fit so many sequences is remembered.
    """
    left, failed = Counter(counts), set()

    def solve(bins: int) -> list[Filling] | None:
        nonlocal steps
        now = +left
        if not now:
            return []
        slack = bins * size - sum(x * n for x, n in now.items())
        state = (bins, tuple(sorted(now.items())))
        if slack < 0 or state in failed or least_bins(now, size) > bins:
            return None
        x = max(now)
        left[x] -= 1
        for f in _completions(left, size - x, slack):
            steps -= 1
            if steps < 0:
                raise _Spent
            left.subtract(dict(f))
            rest = solve(bins - 1)
            left.update(dict(f))
            if rest is not None:
                left[x] += 1
                return [tuple(sorted({**dict(f), x: dict(f).get(x, 0) + 1}.items(), reverse=True)), *rest]
        left[x] += 1
        failed.add(state)
        return None

    return solve(bins)


def _often(left: Counter, filling: Filling) -> int:
    return min(left[x] // n for x, n in filling)


def _longest(left: Counter, order: list[int], i: int) -> int:
    while i < len(order) and not left[order[i]]:
        i += 1
    return i


def plan(counts: dict[int, int], size: int = 2048, width: int = 3, descents: int = 4, tries: int = 60, steps: int = 3000, deep: int = 300) -> list[tuple[Filling, int]]:
    """Sequences as (pieces by length, how often), from how many pieces there are of each length.

    The first solution is best-fit. Then its sequences are opened again and packed by bin
    completion: some of the last or of the most wasteful ones, then more, in the end all.
    Each search may take several times the branches that one solution needs, so that it
    always goes on after a first one. It ends at the lower bound, or when nothing is gained.
    What is then still above the bound, with up to `deep` sequences, is searched for one fewer,
    and so on, in up to `steps` fillings: either the plan is proved to be a least one, or the
    steps are used up. Its input has at most `size` rows, so its work doesn't grow with the documents.
    """
    left = Counter({x: n for x, n in counts.items() if n})
    order = sorted(left, reverse=True)
    bound = least_bins(left, size)
    best: list[tuple[Filling, int]] = []
    i = _longest(left, order, 0)
    while i < len(order):  # best-fit
        f = _best_fit(left, order[i:], size)
        best.append((f, _often(left, f)))
        for x, n in f:
            left[x] -= n * best[-1][1]
        i = _longest(left, order, i)
    waste = lambda step: size - sum(x * n for x, n in step[0])
    k, bins = 8, sum(t for _, t in best)
    while bins > bound:
        gained = False
        for places in (range(len(best))[-k:], sorted(range(len(best)), key=lambda j: waste(best[j]))[-k:]):
            gone = set(places)
            chosen, own = [best[j] for j in places], Counter()
            for f, t in chosen:
                own.update({x: n * t for x, n in f})
            before = sum(t for _, t in chosen)
            found = _search(own, before, size, width, descents * (len(own) + len(chosen)) + 200, tries)
            if found:
                best = [step for j, step in enumerate(best) if j not in gone] + found
                bins = sum(t for _, t in best)
                gained = True
                break
        if not gained:
            if k >= len(best):
                break
            k *= 4
    try:
        while bound < bins <= deep:
            fewer = complete({x: n for x, n in counts.items() if n}, bins - 1, size, steps)
            if fewer is None:
                break
            best, bins = [(f, 1) for f in fewer], bins - 1
    except _Spent:
        pass
    return best


def pack(rows: DataFrame, size: int = 2048) -> DataFrame:
    """Rows of pieces (doc_id, piece, ids_crc32, length from 1 to `size`) with sequence_id and offset added.

    Pieces of one length are alike, so the sequences are planned on the number of pieces of
    each length: at most `size` numbers reach the driver. Each piece is then numbered within
    its length, in shards, and takes the place that the plan has for this number. Repeated
    rows are separate pieces; null ids are ids. No rows: no sequences. Columns of the input
    stay, whatever their names, but for those named sequence_id and offset.
    """
    rows = stored(rows, "pieces", lasting=True)
    counts = dict(map(tuple, rows.groupBy("length").count().collect()))
    shards = 1 + sum(counts.values()) // SHARD_ROWS
    shard = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards))
    keys = [F.col(c).alias(c) for c in ("doc_id", "piece", "ids_crc32", "length")]
    plain = rows.select(packed(rows, "sequence_id", "offset"), *keys, shard.alias("shard"))
    w = Window.partitionBy("length", "shard").orderBy("doc_id", "piece", "ids_crc32")
    local = plain.select("row", "length", "shard", (F.row_number().over(w) - 1).alias("n"))
    sizes = rows.select("length", shard.alias("shard")).groupBy("length", "shard").agg(F.count("*").alias("c"))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "shard", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    numbered = local.join(sizes, ["length", "shard"]).select("row", "length", (F.col("base") + F.col("n")).alias("rank"))
    places, taken, sequence = [], Counter(), 0
    for filling, times in plan(counts, size):
        offset = 0
        for x, n in filling:
            places.append((x, taken[x], taken[x] + n * times, n, sequence, offset))
            taken[x] += n * times
            offset += n * x
        sequence += times
    # some steps for each length of the plan, of at most 63 different lengths each
    columns = ("x", "first", "last", "each", "sequence", "begin")
    at = rows.sparkSession.createDataFrame(pa.table({c: pa.array([p[i] for p in places], pa.int64()) for i, c in enumerate(columns)}))
    nth = F.col("rank") - F.col("first")
    met = numbered.join(F.broadcast(at), (F.col("length") == F.col("x")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    return met.select("row.*", (F.col("sequence") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"), (F.col("begin") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"))


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places; null texts are empty, no documents give no rows."""
    bounded_batches(spark)
    return pack(pieces(table(spark, sf_dir, "documents"), word_tokenizer()))


QUERIES = {"op1_bin_completion": op1_bin_completion}
ORACLES: dict[str, str] = {}
