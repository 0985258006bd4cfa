"""Conversation prefix trie by LCP-aware merging of sorted runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import attach, begin, bounded_batches, scratch, stored, table

#: Bytes of a turn's digest, SHA-256: sequences compare as their digests, one after the other.
TURN = 32
#: Bytes of sequences that are sorted into one run, and that one merging task gets.
RUN_BYTES, BUCKET_BYTES = 16 << 20, 32 << 20
#: Ids that are joined to one string before a group's strings meet.
BLOCK_IDS = 8192
#: Rows of a batch that goes back to the JVM.
ROWS = 4096

RUNS = "run long, pos long, lcp int, data binary, sizes array<int>, n long, least long"
NODES = "bucket int, slot int, depth long, digest binary, size long, conv_id long, parent_conv_id long, parent_slot int, n long, children long, leaves long, saved long, ends string"
TOPS = "bucket int, slot int, gid long, parent long, depth long, conv_id long, n long, children long, leaves long, saved long, ends string"


def sequences(rows: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Each conversation rebuilt: conv_id, data (its turns' digests in a row), sizes (bytes of its texts).

    Conversation c takes the first h turns of c - c % family, h being the unsigned CRC-32 of
    the decimal c modulo `most`, and its own turns after its first h. A turn is its role and
    text, null being empty; turns go by number, null first, then by role and digest. Rows
    without a conv_id belong to no conversation. Texts aren't shuffled: 36 bytes and the role
    are, for each turn, and conversations that share a first one meet in one row, so the turns
    of one conversation must fit a task as digests.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    turn = F.struct("turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).alias("size"), "conv_id")
    turns = rows.where("conv_id IS NOT NULL").select((F.col("conv_id") - F.col("conv_id") % family).alias("base"), turn.alias("t"))
    met = turns.groupBy("base").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    each = met.select("base", "ts", F.explode(F.array_distinct(F.transform("ts", lambda t: t["conv_id"]))).alias("conv_id"))
    h = (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    own, first = F.filter("ts", lambda t: t["conv_id"] == F.col("conv_id")), F.filter("ts", lambda t: t["conv_id"] == F.col("base"))
    each = each.select("conv_id", own.alias("own"), F.slice(first, 1, h).alias("first"), h.alias("h"))
    each = each.select("conv_id", F.concat("first", F.slice("own", F.col("h") + 1, F.size("own"))).alias("seq"))
    data = F.unhex(F.array_join(F.transform("seq", lambda t: t["digest"]), ""))
    return each.select("conv_id", data.alias("data"), F.transform("seq", lambda t: t["size"]).alias("sizes"))


def _shared(a: bytes, b: bytes, at: int) -> int:
    """Turns that two sequences share, given that they share the first `at`."""
    end = min(len(a), len(b)) // TURN
    while at < end and a[at * TURN : at * TURN + TURN] == b[at * TURN : at * TURN + TURN]:
        at += 1
    return at


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield _table(held, schema)
            held = []
    if held:
        yield _table(held, schema)


_RUN = pa.schema([("run", pa.int64()), ("pos", pa.int64()), ("lcp", pa.int32()), ("data", pa.binary()), ("sizes", pa.list_(pa.int32())), ("n", pa.int64()), ("least", pa.int64())])
_NODE = pa.schema([("bucket", pa.int32()), ("slot", pa.int32()), ("depth", pa.int64()), ("digest", pa.binary()), ("size", pa.int64()), *[(c, pa.int64()) for c in ("conv_id", "parent_conv_id")], ("parent_slot", pa.int32()), *[(c, pa.int64()) for c in ("n", "children", "leaves", "saved")], ("ends", pa.string())])
_TOP = pa.schema([("bucket", pa.int32()), ("slot", pa.int32()), *[(c, pa.int64()) for c in ("gid", "parent", "depth", "conv_id", "n", "children", "leaves", "saved")], ("ends", pa.string())])


def sorted_run(entries: list[tuple[bytes, list[int], int, int]]) -> list[tuple]:
    """Entries (data, sizes, n, least) in order, equal ones as one, each with what it shares with the one before."""
    out, last = [], b""
    for data, same in groupby(sorted(entries, key=itemgetter(0)), key=itemgetter(0)):
        same = list(same)
        out.append((_shared(last, data, 0), data, same[0][1], sum(e[2] for e in same), min(e[3] for e in same)))
        last = data
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin("conversation_trie")
    run = TaskContext.get().partitionId() << 32

    def rows() -> Iterator[tuple]:
        nonlocal run
        held, size = [], 0
        for batch in batches:
            for i, d, s in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "data", "sizes")), strict=True):
                held.append((d, s, 1, i))
                size += len(d) + 200
                if size >= RUN_BYTES:
                    yield from ((run, pos, *e) for pos, e in enumerate(sorted_run(held)))
                    held, size, run = [], 0, run + 1
        yield from ((run, pos, *e) for pos, e in enumerate(sorted_run(held)))

    return _batches(rows(), _RUN)


def merged(runs: list[list[tuple]]) -> Iterator[tuple]:
    """Sorted runs of (lcp, data, ...) as one, each lcp that with the entry given before.

    A loser tree: whoever lost a match keeps what it shares with the winner, and both sides of
    a later match share that much with the winner given last. If the two numbers differ, the
    greater is less, and nothing is compared; otherwise comparing starts behind them.
    """
    n = 1
    while n < len(runs):
        n *= 2
    streams = [iter(r) for r in runs] + [iter(())] * (n - len(runs))
    heads = [next(s, None) for s in streams]
    shares = [0] * n  # with the entry given last, or with the winner of the match lost

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser."""
        if heads[a] is None or heads[b] is None:
            return (b, a) if heads[a] is None else (a, b)
        if shares[a] != shares[b]:
            return (a, b) if shares[a] > shares[b] else (b, a)
        x, y = heads[a][1], heads[b][1]
        k = _shared(x, y, shares[a])
        won, lost = (a, b) if x[k * TURN : k * TURN + TURN] <= y[k * TURN : k * TURN + TURN] else (b, a)
        shares[lost] = k
        return won, lost

    losers, winners = [0] * n, [0] * n + list(range(n))
    for at in range(n - 1, 0, -1):
        winners[at], losers[at] = play(winners[2 * at], winners[2 * at + 1])
    won = winners[1]
    while heads[won] is not None:
        yield (shares[won], *heads[won][1:])
        heads[won] = next(streams[won], None)
        shares[won] = heads[won][0] if heads[won] else 0
        at = (won + n) // 2
        while at:
            won, losers[at] = play(won, losers[at])
            at //= 2


class Node:
    """An open node: what its closed children and the conversations that end in it come to."""

    __slots__ = ("digest", "size", "n", "least", "children", "leaves", "saved", "ends", "slot", "name", "below")

    def __init__(self, digest: bytes, size: int, slot: int | None = None, name: int | None = None):
        self.digest, self.size, self.slot, self.name = digest, size, slot, name
        self.n = self.children = self.leaves = self.saved = 0
        self.least = self.ends = None
        self.below: list[int] = []  # rows of children that wait for this node's least member

    def add(self, n: int, least: int | None, children: int, leaves: int, saved: int) -> None:
        self.n, self.children, self.leaves, self.saved = self.n + n, self.children + children, self.leaves + leaves, self.saved + saved
        self.least = least if self.least is None else self.least if least is None else min(self.least, least)

    def close(self, parent: Node | None) -> None:
        if not self.children:
            self.leaves = 1
        self.saved += (self.n - 1) * self.size
        if parent is not None:
            parent.add(self.n, self.least, 1, self.leaves, self.saved)


def bucket_nodes(bucket: int, entries: Iterable[tuple]) -> list[list]:
    """The nodes of one bucket's merged entries, from a stack of open ones.

    The prefixes of the bucket's first and last sequence may be of other buckets as well: they
    have a slot, and hold what is closed below them and ends in them in this bucket.
    """
    out: list[list] = []
    stack = [Node(b"", 0, slot=0)]
    slots, first, total = 1, True, 0

    def emit(node: Node, depth: int, parent: Node | None) -> None:
        known = node.slot is None and parent.slot is not None
        if node.slot is None and parent.slot is None:
            parent.below.append(len(out))
        out.append([bucket, node.slot, depth, node.digest if node.slot is not None else None, node.size, node.least, None, parent.slot if known else None, node.n, node.children, node.leaves, node.saved, node.ends])
        for row in node.below:
            out[row][6] = node.least

    for share, data, sizes, n, least in entries:
        total += 1
        while len(stack) > share + 1:
            node = stack.pop()
            if node.slot is None:
                node.close(stack[-1])
            emit(node, len(stack), stack[-1])
        for k in range(share, len(data) // TURN):
            stack.append(Node(data[k * TURN : k * TURN + TURN], sizes[k], slots if first else None))
            slots += first
        stack[-1].add(n, least, 0, 0, 0)
        stack[-1].ends = hashlib.sha256(data).hexdigest()
        first = False
    if not total:
        return []
    # what is open is the path of the last sequence; its nodes get the slots after the first's
    for node in stack:
        if node.slot is None:
            node.slot, slots = slots, slots + 1
        for row in node.below:
            out[row][7] = node.slot
        node.below = []
    for depth in range(len(stack) - 1, -1, -1):
        emit(stack[depth], depth, None)
    return out


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    begin("conversation_trie")
    runs: dict[int, list[tuple]] = {}
    for batch in batches:
        for run, share, data, sizes, n, least in zip(*(batch.column(c).to_pylist() for c in ("run", "lcp", "data", "sizes", "n", "least")), strict=True):
            mine = runs.setdefault(run, [])
            mine.append((share if mine else 0, data, sizes, n, least))

    def distinct() -> Iterator[tuple]:
        """Entries that several runs hold as one."""
        held = None
        for share, data, sizes, n, least in merged(list(runs.values())):
            if held is not None and share * TURN == len(data) == len(held[1]):
                held = (*held[:3], held[3] + n, min(held[4], least))
                continue
            if held is not None:
                yield held
            held = (share, data, sizes, n, least)
        if held is not None:
            yield held

    yield from _batches(bucket_nodes(TaskContext.get().partitionId(), distinct()), _NODE)


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The paths at the buckets' borders, bucket by bucket, on one more stack of open nodes."""
    begin("conversation_trie")
    rows = chain.from_iterable(zip(*(b.column(c).to_pylist() for c in ("bucket", "slot", "depth", "digest", "size", "conv_id", "n", "children", "leaves", "saved", "ends")), strict=True) for b in batches)

    def given() -> Iterator[tuple]:
        stack: list[Node] = []
        names, along = 0, False

        def closed() -> tuple:
            node = stack.pop()
            parent = stack[-1] if stack else None
            node.close(parent)
            return (None, None, node.name, parent.name if parent else None, len(stack), node.least, node.n, node.children, node.leaves, node.saved, node.ends)

        for bucket, slot, depth, digest, size, least, n, children, leaves, saved, ends in rows:
            along = (slot == 0 or along) and len(stack) > depth and stack[depth].digest == digest
            if not along:
                while len(stack) > depth:
                    yield closed()
                stack.append(Node(digest, size, name=names))
                names += 1
            stack[depth].add(n, least, children, leaves, saved)
            stack[depth].ends = ends or stack[depth].ends
            yield (bucket, slot, stack[depth].name, *[None] * 8)
        while stack:
            yield closed()

    return _batches(given(), _TOP)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order as strings of up to BLOCK_IDS each: (ends, first id, text)."""
    begin("conversation_trie")
    ids = chain.from_iterable(zip(b.column("ends").to_pylist(), b.column("conv_id").to_pylist(), strict=True) for b in batches)

    def rows() -> Iterator[tuple]:
        for ends, group in groupby(ids, key=itemgetter(0)):
            held: list[int] = []
            for _, i in group:
                held.append(i)
                if len(held) == BLOCK_IDS:
                    yield ends, held[0], ",".join(map(str, held))
                    held = []
            if held:
                yield ends, held[0], ",".join(map(str, held))

    return _batches(rows(), pa.schema([("ends", pa.string()), ("first", pa.int64()), ("ids", pa.string())]))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each group, in order, through one running SHA-256."""
    begin("conversation_trie")
    blocks = chain.from_iterable(zip(b.column("ends").to_pylist(), b.column("ids").to_pylist(), strict=True) for b in batches)

    def rows() -> Iterator[tuple]:
        for ends, group in groupby(blocks, key=itemgetter(0)):
            state, before = hashlib.sha256(), ""
            for _, ids in group:
                state.update((before + ids).encode())
                before = ","
            yield ends, state.hexdigest()

    return _batches(rows(), pa.schema([("ends", pa.string()), ("ends_sha256", pa.string())]))


def end_digests(seqs: DataFrame) -> DataFrame:
    """Rows (ends, ends_sha256): of each sequence's SHA-256, that of its conversations' ids.

    Ids are joined block by block in sorted ranges before a group meets, so a group of very
    many is few rows; its task streams them and holds a block at a time.
    """
    ids = seqs.select(F.sha2("data", 256).alias("ends"), "conv_id")
    blocks = ids.repartitionByRange("ends", "conv_id").sortWithinPartitions("ends", "conv_id").mapInArrow(_blocks, "ends string, first long, ids string")
    return blocks.repartition("ends").sortWithinPartitions("ends", "first").mapInArrow(_digests, "ends string, ends_sha256 string")


def prefix_trie(rows: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """The trie of the rebuilt conversations, one row for each node.

    Partitions sort their sequences into runs with LCPs, equal ones as one entry; sampled
    splitters deal the runs to buckets by range, and each bucket merges its parts of runs by a
    loser tree and closes nodes from a stack. What crosses buckets, the paths of each bucket's
    first and last sequence, goes through one more stack in bucket order: two paths a bucket,
    streamed by one task.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
    as the query op13 says. Null roles and texts are empty; null turns come first, equal ones
    go by role and digest, and repeated rows are turns of their own; empty texts are turns;
    rows without a conv_id count for nothing; no rows give no nodes; other columns don't
    matter. Turns are equal if their SHA-256 are. A conversation must fit a task as digests.
    """
    spark = rows.sparkSession
    bounded_batches(spark)
    rows = rows.select("conv_id", "turn", "role", "text")
    with scratch(spark):
        seqs = stored(sequences(rows, family, most), "sequences")
        runs = stored(seqs.mapInArrow(_runs, RUNS), "runs")
        size = runs.agg(F.sum(F.octet_length("data") + 4 * F.size("sizes") + 48)).first()[0] or 0
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_BYTES + 1)
        dealt = runs.repartitionByRange(buckets, "data").sortWithinPartitions("run", "pos")
        nodes = stored(dealt.mapInArrow(_nodes, NODES), "nodes")
        paths = nodes.where("slot IS NOT NULL").repartition(1).sortWithinPartitions("bucket", "slot")
        tops = stored(paths.mapInArrow(_tops, TOPS), "tops")
        top = tops.where("bucket IS NULL").drop("bucket", "slot")
        named = top.select("gid", F.col("conv_id").alias("named"))
        places = attach(tops.where("bucket IS NOT NULL").select("bucket", F.col("slot").alias("parent_slot"), "gid"), named, ["gid"]).drop("gid")
        known = ["depth", "conv_id", "n", "children", "leaves", "saved", "ends"]
        above = attach(top.select(F.col("parent").alias("gid"), *known), named, ["gid"]).select(*known, F.col("named").alias("parent_conv_id"))
        inner = nodes.where("slot IS NULL")
        waiting = attach(inner.where("parent_slot IS NOT NULL").drop("parent_conv_id"), stored(places, "places"), ["bucket", "parent_slot"])
        every = above.unionByName(waiting.select(*known, F.col("named").alias("parent_conv_id")))
        every = every.unionByName(inner.where("parent_slot IS NULL").select(*known, "parent_conv_id"))
        ended = attach(every.where("ends IS NOT NULL"), stored(end_digests(seqs), "ends"), ["ends"])
        plain = every.where("ends IS NULL").withColumn("ends_sha256", F.sha2(F.lit("").cast("binary"), 256))
        return stored(ended.unionByName(plain).select(*map(_named, OUT)), "trie", lasting=True)


OUT = {"conv_id": "conv_id", "depth": "depth", "parent_conv_id": "parent_conv_id", "n_convs": "n", "n_children": "children", "n_leaves": "leaves", "saved_tokens": "saved", "ends_sha256": "ends_sha256"}


def _named(name: str) -> Column:
    return F.col(OUT[name]).alias(name)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all `conversations`, rebuilt in families of five."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES = {"op13_prefix_trie": op13_prefix_trie}
ORACLES = {
    "op13_prefix_trie": """
WITH own AS (SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda s, b: list_reduce(list_prepend(xor(s, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h FROM own),
built AS (SELECT a.conv_id, list_concat(list_slice(coalesce(b.turns, []), 1, h), list_slice(a.turns, h + 1, len(a.turns))) AS seq
  FROM own a JOIN crc USING (conv_id) LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 5),
keyed AS (SELECT conv_id, seq, list_transform(seq, lambda x: sha256(length(x.r) || ':' || x.r || x.t)) AS keys FROM built),
paths AS (SELECT conv_id, len(keys) AS total, unnest(range(len(keys) + 1)) AS depth, seq, keys FROM keyed),
members AS (SELECT conv_id, depth, total, array_to_string(list_slice(keys, 1, depth), '') AS node, array_to_string(list_slice(keys, 1, depth - 1), '') AS above,
  CASE WHEN depth > 0 THEN strlen(seq[depth].t) ELSE 0 END AS size FROM paths),
nodes AS (SELECT node, depth, any_value(CASE WHEN depth > 0 THEN above END) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
  sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = total), '')) AS ends_sha256 FROM members GROUP BY node, depth),
children AS (SELECT above AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
lists AS (SELECT n.node, n.depth, coalesce(c.n, 0) AS n_children, (n.n_convs - 1) * n.size AS saved FROM nodes n LEFT JOIN children c ON c.node = n.node),
ups AS (SELECT left(node, 64 * unnest(range(depth + 1))) AS top, n_children, saved FROM lists),
sums AS (SELECT top, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM ups GROUP BY top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, l.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN lists l ON l.node = n.node JOIN sums s ON s.top = n.node LEFT JOIN nodes p ON p.node = n.above"""
}
