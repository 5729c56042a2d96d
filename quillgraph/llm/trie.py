"""The prefix trie of conversations, from the Cartesian tree over the common prefixes of neighbours in sorted order."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import map_batches, materialize

#: Conversations share the first turns of the first one of their HOST, 0 to SHARED - 1 of them.
HOST, SHARED = 100, 6

#: Sequences in a block, as a multiple of the square root of their number.
BLOCK = 4

#: Conversation ids that are joined to one piece of text before they are hashed in order.
PIECE = 65_536

#: Share of all nodes above which the children of one node are joined apart from the others (so there are 1,000 such nodes at most).
HOT_SHARE = 1 / 1000

_MOST = 2**63 - 1
_TURN = 16  # bytes that stand for a turn in the key of a sequence

_TOKEN = "turns int, n long, lo long, leaves long, saved long, kids long, key binary, sizes array<long>, ends binary"
_MADE = f"made int, grp long, seq long, {_TOKEN}, parent binary, node binary"
_LINK, _KEY, _NODE = range(3)
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_COLUMNS = [(c.split()[0], _TYPES[c.split()[1]]) for c in _MADE.split(", ")]


def rebuilt(conversations: DataFrame, host: int = HOST, shared: int = SHARED) -> DataFrame:
    """conv_id and turns (key: 128 bits of role and text, size: code points of the text) of each conversation with the first
    turns of its host in place of its own. Turns of equal number are in order of role, then text."""
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    key = F.unhex(F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    rows = rows.select("conv_id", F.struct("turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("tie"), F.struct(key.alias("key"), F.char_length("text").cast("long").alias("size")).alias("turn_of")).alias("_t"))
    own = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("_t")), lambda t: t["turn_of"]).alias("turns"))
    own = materialize(own, "conversations")
    hosts = own.where(F.col("conv_id") % host == 0).select(F.col("conv_id").alias("_host"), F.slice("turns", 1, shared - 1).alias("_first"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(shared)).cast("int")
    joined = own.withColumn("_host", F.col("conv_id") - F.col("conv_id") % host).join(hosts, "_host", "left")
    first = F.slice(F.coalesce("_first", F.slice("turns", F.lit(1), F.lit(0))), F.lit(1), h)
    return joined.select("conv_id", F.concat(first, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def _alike(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with in common."""
    most = min(len(a), len(b)) // _TURN
    for i in range(most):
        if a[_TURN * i : _TURN * (i + 1)] != b[_TURN * i : _TURN * (i + 1)]:
            return i
    return most


class _Open:
    """A node whose interval may grow: sums over its children so far."""

    __slots__ = ("ends", "kids", "leaves", "lo", "n", "saved", "turns")

    def __init__(self, turns: int, n: int = 0, lo: int = _MOST, leaves: int = 0, saved: int = 0, kids: int = 0, ends: bytes | None = None):
        self.turns, self.n, self.lo, self.leaves, self.saved, self.kids, self.ends = turns, n, lo, leaves, saved, kids, ends


class _Block:
    """The Cartesian tree of a run of sorted sequences, built with a stack of open nodes.

    An open node is closed by the first smaller common prefix on its right, if there is a smaller one on its left too. Where the
    block is not the whole, those without a smaller value on either side are kept: values that fall from the left edge, values
    that rise to the right edge (the nearest smaller values of these lie in other blocks), and the two sequences at the edges.
    Their number does not exceed twice the depth.
    """

    def __init__(self, whole: bool):
        self.whole, self.stack, self.head, self.left, self.last, self.current, self.rows = whole, [], None, [], None, None, []

    def key(self, k: dict) -> None:
        if self.last is not None and self.joined:
            self.link(_alike(self.last["key"], k["key"]))
        if self.last is None and not self.whole:
            self.head = k
        else:
            self.current = k
        self.last, self.joined = k, True

    def token(self, t: dict) -> None:
        """A value that another block has kept, with what its node holds between its edges."""
        self.link(t["turns"])
        top = self.stack[-1]
        self._add(top, t)
        top.ends = t["ends"] or top.ends
        self.joined = False

    def link(self, turns: int) -> None:
        while self.stack and self.stack[-1].turns > turns:
            node = self.stack.pop()
            self._settle(node)
            if self.stack or self.whole:
                self.current = node
            else:
                self.left.append(node)
        if not self.stack or self.stack[-1].turns < turns:
            self.stack.append(_Open(turns))
        self._settle(self.stack[-1])

    @staticmethod
    def _add(node: _Open, more: dict) -> None:
        node.n += more["n"]
        node.lo = min(node.lo, more["lo"])
        node.leaves += more["leaves"]
        node.saved += more["saved"]
        node.kids += more["kids"]

    def _settle(self, parent: _Open) -> None:
        """The current subtree becomes a child of the parent, or ends there."""
        child, self.current = self.current, None
        if child is None:
            return
        if isinstance(child, dict):  # a sequence
            if child["turns"] == parent.turns:
                parent.n, parent.lo, parent.ends = parent.n + child["n"], min(parent.lo, child["lo"]), child["ends"]
                return
            child = _Open(child["turns"], child["n"], child["lo"], 1, 0, 0, child["ends"])
        key, sizes = self.last["key"], self.last["sizes"]
        for d in range(child.turns, parent.turns, -1):  # the depths between are nodes of the same members with one child
            deepest, first = d == child.turns, d == parent.turns + 1
            child.saved += (child.n - 1) * sizes[d - 1] if d else 0
            self.rows.append({
                "made": _NODE, "turns": d, "n": child.n, "lo": child.lo, "leaves": child.leaves, "saved": child.saved, "kids": child.kids if deepest else 1, "ends": child.ends if deepest else None,
                "parent": hashlib.md5(key[: _TURN * (d - 1)]).digest() if first and d else None, "node": hashlib.md5(key[: _TURN * d]).digest() if deepest and child.kids else None,
            })
        self._add(parent, {"n": child.n, "lo": child.lo, "leaves": child.leaves, "saved": child.saved, "kids": 1})

    def finish(self, group: int) -> None:
        if self.whole:
            self.link(-1)
            return
        kept = [self.head, *self.left, *self.stack, *([self.current] if self.current is not None else [])]
        for i, x in enumerate(kept):
            of = x if isinstance(x, dict) else {s: getattr(x, s) for s in _Open.__slots__} | {"made": _LINK}
            self.rows.append(of | {"grp": group, "seq": i})


def _blocks(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, block = None, None

        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in _COLUMNS], [c for c, _ in _COLUMNS])

        for b in batches:
            for t in b.to_pylist():
                if t["grp"] != group:
                    if block is not None:
                        block.finish(group)
                        yield packed(block.rows)
                    group, block = t["grp"], _Block(whole)
                (block.key if t["made"] == _KEY else block.token)(t)
                if len(block.rows) >= 4096:
                    yield packed(block.rows)
                    block.rows.clear()
        if block is not None:
            block.finish(group)
            yield packed(block.rows)

    return run


def _nodes(sequences: DataFrame, block: int) -> DataFrame:
    """All nodes of distinct sequences (ends, n, lo, sizes, key). Blocks of the sorted sequences are reduced to their edges, these
    in larger blocks again, until one is left."""
    count = sequences.count()
    size = max(block * math.isqrt(count), 2)
    blocks = -(-count // size)
    tokens = sequences.select(
        F.lit(_KEY).alias("made"), F.size("sizes").alias("turns"), "n", "lo", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"), F.lit(0).cast("long").alias("kids"), "key", "sizes", "ends",
    )
    tokens = tokens.repartitionByRange(blocks, "key").sortWithinPartitions("key") if blocks > 1 else tokens.coalesce(1).sortWithinPartitions("key")
    tokens = tokens.withColumn("grp", F.spark_partition_id().cast("long"))
    found = None
    while True:
        made = materialize(map_batches(tokens, _blocks(blocks <= 1), _MADE), "trie")
        nodes = made.where(f"made = {_NODE}")
        found = nodes if found is None else found.unionByName(nodes)
        if blocks <= 1:
            return found
        kept = made.where(f"made <> {_NODE}").drop("parent", "node")
        was, blocks = blocks, min(-(-kept.count() // size), blocks // 2)
        kept = kept.withColumn("_of", F.floor(F.col("grp") * blocks / was).cast("long")).repartition(max(blocks, 1), "_of").sortWithinPartitions("_of", "grp", "seq")
        tokens = kept.withColumn("grp", F.col("_of")).drop("_of", "seq")


def _pieces():
    """Runs of equal `ends` in order, as joined ids of at most PIECE each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, ids = None, []
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([of], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], ["ends", "first", "piece"])
        for b in batches:
            for e, i in zip(b.column("ends").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if ids and (e != of or len(ids) >= PIECE):
                    yield pack()
                    ids = []
                of = e
                ids.append(i)
        if ids:
            yield pack()

    return run


def _digests():
    """SHA-256 of the pieces of each `ends`, in order; only the state of one hash is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sha = None, None
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([of], pa.binary()), pa.array([sha.hexdigest()], pa.string())], ["ends", "sha"])
        for b in batches:
            for e, piece in zip(b.column("ends").to_pylist(), b.column("piece").to_pylist(), strict=True):
                if e != of:
                    if sha is not None:
                        yield pack()
                    of, sha = e, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(piece.encode())
        if sha is not None:
            yield pack()

    return run


def _end_digests(members: DataFrame, several: DataFrame) -> DataFrame:
    """ends, sha: the hash of the ids that end at one node, where several do. Ids are dealt out by range, and only their joined
    pieces meet: a hash is sequential, so that a node's pieces pass through one task, PIECE ids a row."""
    ids = members.join(several.select("ends"), "ends", "left_semi").select("ends", "conv_id")
    spread = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = map_batches(ids.repartitionByRange(spread, "ends", "conv_id").sortWithinPartitions("ends", "conv_id"), _pieces(), "ends binary, first long, piece string")
    pieces = materialize(pieces, "trie-pieces")
    return materialize(map_batches(pieces.repartition("ends").sortWithinPartitions("ends", "first"), _digests(), "ends binary, sha string"), "trie-ends")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id. Nodes with over a thousandth of all nodes as children are broadcast, so that no task gets all
    children of a hot node."""
    inner = nodes.where("node IS NOT NULL").select(F.col("node").alias("parent"), F.col("lo").alias("parent_lo"), "kids")
    hot = inner.where(F.col("kids") > max(int(nodes.count() * HOT_SHARE), 1)).drop("kids")
    tops = nodes.where("parent IS NOT NULL")
    apart = tops.join(F.broadcast(hot), "parent")
    rest = tops.join(F.broadcast(hot.select("parent")), "parent", "left_anti").join(inner.drop("kids"), "parent", "left")
    chain = nodes.where("parent IS NULL").withColumn("parent_lo", F.when(F.col("turns") > 0, F.col("lo")))
    found = apart.unionByName(rest).withColumn("parent_lo", F.coalesce("parent_lo", "lo"))
    return found.unionByName(chain)


def conversation_trie(conversations: DataFrame, host: int = HOST, shared: int = SHARED, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256.

    Equal conversations are counted first. The distinct ones are sorted by their turns' hashes; the Cartesian tree over the numbers
    of turns that neighbours have in common has a node for each set of equal values between their nearest smaller ones. Blocks
    find those within them, and hand on the values whose nearest smaller ones lie outside. A node stands for all depths down from
    its parent's; sums of members, leaves and tokens pass from children to parents as intervals close.

    A conversation's turns (24 bytes each) are one row; members are never collected. Null roles and texts are empty, null turns come
    first; turns of equal number are in order of role and the hash of their text, so repeated rows are turns that follow each other.
    Rows without conv_id belong to no conversation. Further columns are not looked at. An empty table has no nodes.
    """
    members = rebuilt(conversations, host, shared)
    key = F.aggregate("turns", F.lit(b""), lambda k, t: F.concat(k, t["key"]))
    members = members.withColumn("key", key).select("conv_id", "key", F.transform("turns", lambda t: t["size"]).alias("sizes"), F.unhex(F.md5("key")).alias("ends"))
    members = materialize(members, "trie-members")
    sequences = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("lo"), F.first("sizes").alias("sizes"), F.first("ends").alias("ends")), "trie-sequences")
    nodes = materialize(_nodes(sequences, block), "trie-nodes")
    several = _end_digests(members, sequences.where("n > 1"))
    alone = sequences.where("n = 1").select("ends", F.sha2(F.col("lo").cast("string").cast("binary"), 256).alias("sha"))
    done = _with_parents(nodes).join(several.unionByName(alone), "ends", "left")
    return done.select(
        F.col("lo").alias("conv_id"), F.col("turns").cast("long").alias("depth"), F.col("parent_lo").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
