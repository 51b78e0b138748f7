"""Merkle manifest of a dataset with a witness for every row.

A row's leaf is the hash of its fields. Leaves of a branch (a value of one column) stand in
order; while a branch has several nodes, each run of ``arity`` consecutive ones (the last may be
shorter) becomes the hash of its members. The last node left is the branch's root, and the
branches' roots, in order, give the manifest's root in the same way.

Witnesses are kept incrementally. A branch is cut into aligned blocks of arity ** levels leaves. A
task reads a block's nodes in order and appends them to open runs, one on each level: a new node
takes the digests already in its run as the left part of its partial witness, and extends the
right part of those that are there. A run that is full becomes a node of the next level, which is
appended there in the same way; what is still open at a block's end is closed upward. Block roots
are written and are the next round's appends, until each branch has one node; the branches'
roots are appended last. So a row's witness is its own part, within its block, and the parts of
the roots above, which all rows of a block share and which are joined in once.

No task holds more than a block, whatever share of the rows a branch has, and the order within
a branch comes from a range sort with offsets of its partitions, not from a window over it.

A witness lists, from leaf to root, the siblings' digests of a level, left to right; the place
among them follows from the leaf's position. ``fold`` recomputes the root from a leaf and its
witness.

Defined results: a null field is hashed as `-`, an empty one as `0:`. The null branch comes first.
Rows without an id come first in their branch, repeated rows each have a leaf; rows of one id
stand in the order of their digests. Other columns than the hashed ones do not matter. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failscope.llm.common import counted, saved

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
WIDTH = 32
#: Rows above which the written witnesses of block roots are not broadcast; a row has at most a
#: few kilobytes: levels x (arity - 1) digests.
SHARED_ROWS = 10_000


def field(c: Column) -> Column:
    """A field's bytes in a leaf: `-` if null, else its UTF-8 length, `:` and itself."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: dict[str, Column]) -> Column:
    """The digest (binary) of a row with these values."""
    return F.unhex(F.sha2(F.concat(*[field(values[name]) for name in FIELDS]).cast("binary"), 256))


def node_hash(parts: bytes) -> bytes:
    """Digest of digests that stand one after another: hashed as hex text."""
    return sha256(parts.hex().encode()).digest()


class Node:
    """A digest with the witness it has so far in its run."""

    __slots__ = ("digest", "left", "right", "parent")

    def __init__(self, digest: bytes) -> None:
        self.digest, self.left, self.right, self.parent = digest, b"", bytearray(), None


class Frontier:
    """Open runs of a block, one on each of ``levels`` levels."""

    def __init__(self, arity: int, levels: int) -> None:
        self.arity, self.levels = arity, levels
        self.runs: list[list[Node]] = [[] for _ in range(levels)]
        self.root: Node | None = None

    def append(self, node: Node, level: int = 0) -> None:
        """Put a node into the open run of its level; complete runs go up."""
        if level == self.levels:
            self.root = node
            return
        run = self.runs[level]
        node.left = b"".join([n.digest for n in run])
        for earlier in run:
            earlier.right += node.digest
        run.append(node)
        if len(run) == self.arity:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        parent = Node(node_hash(b"".join([n.digest for n in run])))
        for node in run:
            node.parent = parent
        self.append(parent, level + 1)

    def close(self) -> Node:
        """Complete what is open, from below, and return the block's root."""
        for level in range(self.levels):
            if self.runs[level]:
                self._complete(level)
        return self.root


def witness(node: Node) -> list[bytes]:
    """A node's siblings on each level up to its block's root."""
    out = []
    while node.parent is not None:
        out.append(node.left + bytes(node.right))
        node = node.parent
    return out


def fold(digest: bytes, place: int, siblings: list[bytes], arity: int) -> bytes:
    """The root over a node at ``place`` with these siblings."""
    for level in siblings:
        cut = place % arity * WIDTH
        digest = node_hash(level[:cut] + digest + level[cut:])
        place //= arity
    return digest


def _height(size: int, arity: int) -> int:
    """Levels until one of ``size`` nodes is left."""
    levels = 0
    while size > 1:
        size, levels = -(-size // arity), levels + 1
    return levels


_NODES = "branch string, place long, size long, doc_id long, digest binary, changed binary"


def _blocks(nodes: DataFrame, arity: int, levels: int) -> DataFrame:
    """Nodes (branch, place, size, doc_id, digest, changed) with their ``witness`` within their block,
    and block roots (``top``) at the places they have in the next round."""
    block = arity**levels

    def finished(branch: str, number: int, held: list[tuple], size: int) -> pa.RecordBatch:
        frontier = Frontier(arity, min(levels, _height(size, arity)))
        for row in held:
            frontier.append(row[0])
        root = frontier.close()
        n = len(held)
        return pa.RecordBatch.from_arrays([
            pa.array([branch] * (n + 1), pa.string()),
            pa.array([r[1] for r in held] + [number], pa.int64()),
            pa.array([size] * n + [-(-size // block)], pa.int64()),
            pa.array([r[2] for r in held] + [None], pa.int64()),
            pa.array([r[0].digest for r in held] + [root.digest], pa.binary()),
            pa.array([r[3] for r in held] + [None], pa.binary()),
            pa.array([witness(r[0]) for r in held] + [None], pa.list_(pa.binary())),
            pa.array([False] * n + [True])],
            names=["branch", "place", "size", "doc_id", "digest", "changed", "witness", "top"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at, total = None, 0
        for batch in batches:
            for branch, place, size, doc, digest, changed in zip(*[c.to_pylist() for c in batch.columns]):
                if held and at != (branch, place // block):
                    yield finished(*at, held, total)
                    held = []
                at, total = (branch, place // block), size
                held.append((Node(digest), place, doc, changed))
        if held:
            yield finished(*at, held, total)

    columns = ["branch", "place", "size", "doc_id", "digest", "changed"]
    number = F.floor(F.col("place") / block).alias("block")
    dealt = nodes.repartition("branch", number).sortWithinPartitions("branch", "place").select(*columns)
    return dealt.mapInArrow(run, _NODES + ", witness array<binary>, top boolean")


def _placed(rows: DataFrame, branch: str, order: list[str], name: str) -> DataFrame:
    """``rows`` with their ``place`` in their branch, by ``order``, and the branch's ``size``."""
    ordered = rows.repartitionByRange(branch, *order).sortWithinPartitions(branch, *order)
    ordered = saved(ordered.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33).alias("part")
    pieces = ordered.groupBy(branch, part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(branch)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces, n = counted(pieces.select(
        F.col(branch).alias("b"), F.col("part").alias("p"), "first",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(whole).alias("size")), name + "-pieces")
    pieces = F.broadcast(pieces) if n <= SHARED_ROWS else pieces
    return ordered.withColumn("part", part).join(
        pieces, (F.col(branch) == F.col("b")) & (F.col("part") == F.col("p"))).withColumn(
        "place", F.col("at") - F.col("first") + F.col("before")).drop("b", "p", "part", "first", "before", "at")


def _raised(nodes: DataFrame, arity: int, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """Tables of nodes with witnesses, round by round, and the branches' roots (branch, digest).

    A branch that has one node at first is its own root.
    """
    rounds = []
    while True:
        table = saved(_blocks(nodes, arity, levels), "merkle-nodes")
        rounds.append(table.where("NOT top").drop("top"))
        nodes = table.where("top").select("branch", "place", "size", "doc_id", "digest", "changed")
        if nodes.where("size > 1").isEmpty():
            return rounds, saved(nodes.select("branch", "digest"), "merkle-roots")


def _joined(rounds: list[DataFrame], arity: int, levels: int) -> DataFrame:
    """The first round's nodes with whole witnesses up to their branch's root."""
    block = arity**levels
    above = None
    for table in reversed(rounds):
        if above is not None:
            shared, n = counted(above.select(
                F.col("branch").alias("b"), F.col("place").alias("up"), F.col("witness").alias("rest")), "merkle-witnesses")
            shared = F.broadcast(shared) if n <= SHARED_ROWS else shared
            table = table.join(shared, (F.col("branch") == F.col("b")) & (
                F.floor(F.col("place") / block) == F.col("up")), "left").withColumn(
                "witness", F.concat("witness", F.coalesce("rest", F.array().cast("array<binary>")))).drop("b", "up", "rest")
        above = table
    return above


def manifest(docs: DataFrame, changed: Column | None = None, arity: int = 8, levels: int = 3) -> DataFrame:
    """A row per document: doc_id, place, leaf, changed, witness, subroot, root_place, root_witness, root.

    Digests are binary. ``witness`` leads to the branch's root ``subroot``, ``root_witness`` (from
    ``root_place``) on to ``root``. ``changed``: an expression over ``docs`` for a changed text, or null;
    the column of that name is the leaf of the row with that text.
    """
    values = {name: F.col(name) for name in FIELDS}
    other = F.lit(None).cast("binary") if changed is None else F.when(
        changed.isNotNull(), leaf({**values, "text": changed}))
    # '' for the null branch, so that keys are not null and keep the order
    branch = F.coalesce(F.concat(F.lit("+"), F.col("lang").cast("string")), F.lit("")).alias("branch")
    leaves = saved(docs.select(
        branch, F.col("doc_id").cast("long").alias("doc_id"), leaf(values).alias("digest"),
        other.alias("changed"), F.monotonically_increasing_id().alias("salt")), "merkle-leaves")
    placed = _placed(leaves, "branch", ["doc_id", "digest", "salt"], "merkle-order").drop("salt")
    rounds, subroots = _raised(placed.select(*[c.split()[0] for c in _NODES.split(", ")]), arity, levels)

    # the branches' roots are the leaves of one more tree; its one branch is ''
    tops = subroots.select(F.lit("").alias("one"), "branch", F.col("digest"))
    tops = _placed(tops, "one", ["branch"], "merkle-branches")
    named = saved(tops.select("one", "place", F.col("branch").alias("b"), F.col("digest").alias("subroot")), "merkle-names")
    nodes = tops.select(F.lit("").alias("branch"), "place", "size", F.lit(None).cast("long").alias("doc_id"),
                        "digest", F.lit(None).cast("binary").alias("changed"))
    upper, root = _raised(nodes, arity, levels)
    upper = _joined(upper, arity, levels).select(
        F.col("place").alias("root_place"), F.col("witness").alias("root_witness"))
    root = root.select(F.col("branch").alias("one"), F.col("digest").alias("root"))
    shared, n = counted(named.join(upper, F.col("place") == F.col("root_place")).join(root, "one").drop(
        "one", "place"), "merkle-shared")
    shared = F.broadcast(shared) if n <= SHARED_ROWS else shared
    return _joined(rounds, arity, levels).join(shared, F.col("branch") == F.col("b")).select(
        "doc_id", "place", F.col("digest").alias("leaf"), "changed", "witness", "subroot",
        "root_place", "root_witness", "root")


def verify(rows: DataFrame, arity: int = 8) -> DataFrame:
    """``manifest``'s rows as hex digests: doc_id, leaf, subroot, root, proof_sha256 (hash of all
    siblings, leaf to root), folded_root (from the changed leaf, or else its own), verified."""
    names = ["leaf", "subroot", "root", "proof_sha256", "folded_root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for place, own, changed, siblings, subroot, up, above, root in zip(
                    *[c.to_pylist() for c in batch.columns[1:]]):
                top = fold(own if changed is None else changed, place, siblings, arity)
                row = (own, subroot, root, node_hash(b"".join(siblings) + b"".join(above)),
                       fold(top, up, above, arity))
                for column, digest in zip(out, row):
                    column.append(digest.hex())
            good = [a == b for a, b in zip(out[4], out[2])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.string()) for c in out], pa.array(good, pa.bool_())],
                names=["doc_id", *names, "verified"])

    return rows.select("doc_id", "place", "leaf", "changed", "witness", "subroot", "root_place",
                       "root_witness", "root").mapInArrow(
        run, "doc_id long, " + ", ".join(f"{n} string" for n in names) + ", verified boolean")
