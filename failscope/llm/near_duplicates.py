"""MinHash near-duplicates by a chosen-path set similarity join.

Texts with equal shingle sets form a class; the work below is on classes. A tree gives every
class a path of minwise tokens (the smallest shingle under a hash function of the tree and
depth). A node holds the classes whose paths begin alike. A node of more than ``leaf`` classes
is branched by the next token; a smaller one is compared exhaustively. Two sets of similarity
J share a node of depth D with probability J^D, so independent trees are repeated until a pair
at the threshold is found with the target recall.

What a node compares are 256-bit sketches (one bit of the least hash in each of 256 bins): a
pair is dropped only if more bits differ than a linked pair shows in five standard deviations.
The rest is confirmed on full sets, best pair of each class first and only between classes
that are not yet connected, so a large group of near copies costs a forest, not all its pairs.
A node that is still large at the last depth holds near copies. Its pivot is the member nearest
to the majority of its sketches, as copies of one text differ more from each other than from it.
A member is then what tells it from the pivot (the shingles that only one of the two has), and
the overlap of two such differences says exactly whether two members are linked. Pairs that are
linked whatever their overlap is all have a link with one member, so a star holds them. For all
others a least overlap is known. A member that, for all it lacks and all additions it shares,
cannot reach it with any partner's distance is left out. The rest share one of the rarest shingles
of both differences and are joined on those, apart for each range of the partner's distance. Members
far from the pivot are compared with the near ones, and get a pivot of their own among themselves.

Links join classes into components by contraction in rounds, each one written to the shared
folder. Nothing of the corpus goes to the driver but counts.

Defined results: null and wordless texts have no shingles and are linked with nothing. Rows
without an id take no part in links, are kept, and have no component. Repeated rows each get
a row. A set is compared by 64-bit hashes of its shingles.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from failscope.llm.common import counted, saved, small
from failscope.llm.shingles import mix, seeds, shingle_sets
from failscope.session import new_path, write_observed

BINS = 256
#: Sketch columns, of 64 bins each.
SKETCH = ["s1", "s2", "s3", "s4"]
_U = np.uint64


def trees_for(threshold: float, depth: int, recall: float) -> int:
    """Trees that find a pair at the threshold with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth))


def most_differing(threshold: float) -> int:
    """Bins that may differ: mean of a linked pair plus five standard deviations."""
    p = 1 - threshold
    return math.ceil(BINS * p + 5 * math.sqrt(BINS * p * (1 - p)))


def _paths(items: np.ndarray, factors: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Node keys of a set: (trees, depth), each the hash of the tokens down to there."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, _U)
    for at in range(0, len(items), 2048):
        part = mix_rows(items[at: at + 2048], factors)
        np.minimum(least, part, out=least)
    tokens = least.reshape(trees, depth)
    keys = np.empty((trees, depth), _U)
    key = seeds(trees, 5)
    for level in range(depth):
        key = mix(key * _U(0x9E3779B97F4A7C15) + tokens[:, level])
        keys[:, level] = key
    return keys


def mix_rows(items: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return ((items[None, :] ^ (factors >> _U(7))[:, None]) * factors[:, None]).min(axis=1)


def _sketch(items: np.ndarray) -> np.ndarray:
    """Words of a bit for each bin's least member; an empty bin gives 0."""
    edges = np.arange(BINS, dtype=_U) << _U(64 - (BINS - 1).bit_length())
    first = np.searchsorted(items, edges)
    after = np.append(first[1:], len(items))
    bits = np.zeros(BINS, _U)
    full = first < after
    bits[full] = mix(items[first[full]]) & _U(1)
    return (bits.reshape(-1, 64) << np.arange(64, dtype=_U)).sum(axis=1, dtype=_U)


def signatures(docs: DataFrame, words: int, trees: int, depth: int) -> DataFrame:
    """(doc_id, n, h1, h2, s1 to s4, paths) of every row; h1 and h2 identify the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = seeds(trees * depth, 3)
        for batch in batches:
            sizes, marks, paths, lengths = [], [], [], []
            for items in shingle_sets(batch.column(1), words):
                n = len(items)
                sizes.append(n)
                if n:
                    marks.append(np.concatenate([
                        [items.sum(dtype=_U), mix(items + _U(n)).sum(dtype=_U)], _sketch(items)]))
                    paths.append(_paths(items, factors, trees, depth).ravel())
                    lengths.append(trees * depth)
                else:
                    marks.append(np.zeros(2 + len(SKETCH), _U))
                    lengths.append(0)
            columns = np.array(marks, _U).reshape(-1, 2 + len(SKETCH)).view(np.int64)
            flat = (np.concatenate(paths) if paths else np.empty(0, _U)).view(np.int64)
            ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()),
                *[pa.array(np.ascontiguousarray(columns[:, i])) for i in range(2 + len(SKETCH))],
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "n", "h1", "h2", *SKETCH, "paths"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n long, h1 long, h2 long, "
             + "".join(f"{c} long, " for c in SKETCH) + "paths array<long>")


def full_sets(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, h1, h2, items) of rows that have shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column(1), words))
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate([*sets, np.empty(0, _U)]).view(np.int64)
            h1 = np.array([s.sum(dtype=_U) for s in sets], _U).view(np.int64)
            h2 = np.array([mix(s + _U(len(s))).sum(dtype=_U) for s in sets], _U).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(h1), pa.array(h2),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))],
                names=["doc_id", "h1", "h2", "items"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, h1 long, h2 long, items array<long>").where(F.size("items") > 0)


def _differing() -> Column:
    return reduce(operator.add, [
        F.bit_count(F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}"))) for c in SKETCH])


def _near(most: int, percent: int) -> Column:
    """Sizes and sketches of a and b allow a link.

    Of two linked sets at most ``apart`` members are in one only, and no more bins differ; nor
    do more than ``most`` allows. A bin that differs does so in its bit with chance 1/2.
    """
    apart = (F.col("a.n") + F.col("b.n")) * ((100 - percent) / (100 + percent))
    bins = F.least(apart, F.lit(float(most)))
    limit = bins / 2 + F.sqrt(bins) * 2.5 + 1
    return (F.least("a.n", "b.n") * 100 >= F.greatest("a.n", "b.n") * percent) & (_differing() <= limit)


def _as_pairs(joined: DataFrame) -> DataFrame:
    return joined.select(
        F.least("a.cid", "b.cid").alias("x"), F.greatest("a.cid", "b.cid").alias("y"),
        _differing().alias("differ"))


def _leaf_rows(classes: DataFrame, trees: int, depth: int, leaf: int):
    """Rows (node, cid, n, sketch) of small nodes, and of nodes still large at the end."""
    leaves, large = [], None
    for level in range(depth):
        steps = [F.struct(
            F.get("paths", F.lit(t * depth + level)).alias("node"),
            F.get("paths", F.lit(t * depth + max(level - 1, 0))).alias("parent"))
            for t in range(trees)]
        rows = classes.select("cid", "n", *SKETCH, F.explode(F.array(*steps)).alias("at"))
        rows = rows.select("at.*", "cid", "n", *SKETCH)
        if large is not None:
            rows = rows.join(large.withColumnRenamed("node", "parent"), "parent", "left_semi")
        rows = rows.drop("parent")
        path = new_path(rows.sparkSession, "node-sizes")
        is_big = F.col("size") > leaf
        seen = write_observed(rows.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where(
            "size > 1"), path, big=F.count(F.when(is_big, 1)))
        sizes = rows.sparkSession.read.schema("node long, size long").parquet(path)
        few, n_big = sizes.where(~is_big).select("node"), seen["big"]
        leaves.append(saved(rows.join(small(few, seen["rows"] - n_big), "node", "left_semi"), "leaves"))
        if not n_big:
            return leaves, None
        large = small(sizes.where(is_big).select("node"), n_big)
    return leaves, saved(rows.join(large, "node", "left_semi"), "large-leaves")


def _majority(large: DataFrame) -> DataFrame:
    """(node, m_s1 to m_s4): each bin's more frequent bit among a node's members."""
    sums = [F.sum(F.getbit(c, F.lit(i)).cast("int")).alias(f"{c}_{i}")
            for c in SKETCH for i in range(64)]
    total = large.groupBy("node").agg(F.count(F.lit(1)).alias("members"), *sums)

    def bits(c: str) -> Column:
        ones = [F.shiftleft(F.when(F.col(f"{c}_{i}") * 2 > F.col("members"), F.lit(1)).otherwise(
            F.lit(0)).cast("long"), i) for i in range(64)]
        return reduce(lambda a, b: a.bitwiseOR(b), ones).alias(f"m_{c}")

    return total.select("node", *[bits(c) for c in SKETCH])


def _families(large: DataFrame) -> DataFrame:
    """(pivot, cid): the members of large nodes, those with the same pivot as one."""
    far = reduce(operator.add, [
        F.bit_count(F.col(c).bitwiseXOR(F.col(f"m_{c}"))) for c in SKETCH])
    pivots = large.join(_majority(large), "node").groupBy("node").agg(
        F.min(F.struct(far.alias("far"), "cid")).alias("least"))
    return large.select("node", "cid").join(
        saved(pivots.select("node", F.col("least.cid").alias("pivot")), "pivots"), "node"
    ).select("pivot", "cid").distinct()


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]


def _differences(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(pivot, cid, gap, level, far, added, gone) of (pivot, cid).

    ``added`` and ``gone``: shingles that only the member, only the pivot has. Members are linked if
    twice the overlap of theirs, times 100 + ``percent``, is at least the sum of their ``gap``.
    ``level`` is a range of gaps, twice as wide as the one before it on the way from zero up or down.
    """
    base = sets.join(rows.select(F.col("pivot").alias("cid")).distinct(), "cid", "left_semi")
    both = rows.join(sets, "cid").join(base.select(
        F.col("cid").alias("pivot"), F.col("items").alias("base")), "pivot")
    parts = both.select("pivot", "cid", F.size("items").alias("n"), F.array_except("items", "base").alias("added"),
                        F.array_except("base", "items").alias("gone"))
    apart = F.size("added") + F.size("gone")
    gap = (apart * (100 + percent) - F.col("n") * (100 - percent)).cast("long")
    steps = F.floor(F.col("gap") / (2 * (100 + percent)))
    level = F.when(steps >= 0, F.length(F.bin(steps + 1)) - 1).otherwise(-F.length(F.bin(-steps)))
    return saved(parts.withColumn("gap", gap).select(
        "pivot", "cid", "gap", level.alias("level"), (apart * 2 > F.col("n")).alias("far"),
        "added", "gone"), "differences")


def _levels(members: DataFrame) -> DataFrame:
    """(pivot, levels) of (pivot, inner, far, level, gap, reach): of each kind and range of gaps its
    ``part``, the least gap (low) and the largest ``reach``."""
    return members.groupBy("pivot", F.struct("inner", "far", "level").alias("part")).agg(
        F.min("gap").alias("low"), F.max("reach").alias("reach")).groupBy("pivot").agg(
        F.collect_list(F.struct("part", "low", "reach")).alias("levels"))


def _may_link(at: Column) -> Column:
    """Some member of ``at`` can be linked with this one: neither gap is over the other's reach."""
    return ~(F.col("inner") & at["part"]["inner"]) & (at["low"] <= F.col("reach")) & (F.col("gap") <= at["reach"])


def _linkable(members: DataFrame, percent: int) -> DataFrame:
    """(pivot, cid, gap, level, inner, far, apart) of the members that can have a link which is in no star.

    Two members overlap in shingles that both add or that both lack. So a member's overlap is at
    most all it lacks and those of its additions that another one has too; its ``reach`` is the
    largest gap of a partner for which that is enough.
    """
    adds = members.select("pivot", "cid", F.explode("added").alias("e"))
    shared = saved(adds.groupBy("pivot", "e").agg(F.count(F.lit(1)).alias("uses")).where(
        "uses > 1").drop("uses"), "shared-additions")
    most = adds.join(shared, ["pivot", "e"]).groupBy("pivot", "cid").agg(F.count(F.lit(1)).alias("most"))
    reach = (F.size("gone") + F.coalesce("most", F.lit(0))) * (2 * (100 + percent)) - F.col("gap")
    reached = saved(members.join(most, ["pivot", "cid"], "left").select(
        "pivot", "cid", "gap", "level", "inner", "far", F.concat("added", "gone").alias("apart"),
        reach.alias("reach")), "reaches")
    return saved(reached.join(_levels(reached), "pivot").where(F.exists("levels", _may_link)).drop(
        "levels", "reach"), "linkable")


def _rarest(members: DataFrame, percent: int) -> DataFrame:
    """(pivot, cid, gap, part, to, e, rest): the rarest shingles e of what tells a member apart, of
    which it shares one with every member of part ``to`` that it is linked with; ``rest`` are as
    rare as e or more frequent ones.

    Only shingles that members to be compared share count: not two inner, not two far ones.
    """
    step = 2 * (100 + percent)
    each = members.select("pivot", "cid", "inner", "far", F.explode("apart").alias("e"))
    shared = saved(each.groupBy("pivot", "e").agg(
        F.count(F.lit(1)).alias("uses"), F.min("inner").alias("inner"), F.min("far").alias("far")).where(
        "uses > 1 AND NOT inner AND NOT far").select("pivot", "e", "uses"), "shared-shingles")
    own = each.drop("inner", "far").join(shared, ["pivot", "e"]).groupBy("pivot", "cid").agg(
        F.sort_array(F.collect_list(F.struct("uses", "e"))).alias("own"))
    rows = saved(members.drop("apart").join(own, ["pivot", "cid"]).withColumn(
        "reach", F.size("own") * step - F.col("gap")), "own-shingles")
    need = lambda at: F.greatest(F.lit(1), F.ceil((F.col("gap") + at["low"]) / step)).cast("int")
    levels = F.filter("levels", lambda at: _may_link(at) & ~(F.col("far") & at["part"]["far"]))
    found = F.flatten(F.transform(levels, lambda at: F.transform(
        F.slice("own", F.lit(1), F.size("own") + 1 - need(at)),
        lambda one, i: F.struct(at["part"].alias("to"), one["e"].alias("e"), (F.size("own") - i).alias("rest")))))
    return rows.join(_levels(rows), "pivot").select(
        "pivot", "cid", "gap", F.struct("inner", "far", "level").alias("part"), F.explode(found).alias("one")).select(
        "pivot", "cid", "gap", "part", "one.to", "one.e", "one.rest")


def _met(keys: DataFrame, percent: int) -> DataFrame:
    """(pivot, x, y) of different members that share one of their rarest shingles.

    At the first one that they share, the overlap is at most what either has left from there on.
    """
    a, b = keys.alias("a"), keys.alias("b")
    return a.join(b, (F.col("a.pivot") == F.col("b.pivot")) & (F.col("a.e") == F.col("b.e"))
                  & (F.col("a.to") == F.col("b.part")) & (F.col("a.part") == F.col("b.to"))
                  & (F.col("a.cid") < F.col("b.cid"))
                  & (F.least("a.rest", "b.rest") * (2 * (100 + percent)) >= F.col("a.gap") + F.col("b.gap"))
                  ).select("a.pivot", F.col("a.cid").alias("x"), F.col("b.cid").alias("y"))


def _family_links(rows: DataFrame, sets: DataFrame, percent: int, pivots: int) -> DataFrame:
    """Links (x, y) that connect all linked members (pivot, cid) of a family; ``sets``: (cid, items).

    Members far from their pivot go on to the next round, with one of them as their pivot; with the
    last of ``pivots`` none counts as far, so all pairs are covered whatever a family holds. In every
    round members whose difference leaves no partner for a link are left out first.
    """
    found = []
    for left in range(pivots - 1, -1, -1):
        members = _differences(rows, sets, percent)
        tops = saved(members.groupBy("pivot").agg(F.min(F.struct("gap", "cid")).alias("top")).select(
            "pivot", F.col("top.cid").alias("nearest"), F.col("top.gap").alias("least")), "nearest")
        inner = F.col("gap") + F.col("least") <= 0
        members = members.join(tops, "pivot").withColumn("inner", inner).withColumn(
            "far", F.col("far") & ~inner & F.lit(left > 0))
        star = members.where("inner AND cid != nearest").select(*_ordered("cid", "nearest"))
        members = _linkable(members.drop("nearest", "least"), percent)
        keys = saved(_rarest(members, percent), "rarest-shingles")
        met = saved(_met(keys, percent).distinct(), "met")
        a = members.select("pivot", F.col("cid").alias("x"), F.col("gap").alias("gx"), F.col("apart").alias("ax"))
        b = members.select("pivot", F.col("cid").alias("y"), F.col("gap").alias("gy"), F.col("apart").alias("ay"))
        overlap = F.size(F.array_intersect("ax", "ay"))
        linked = met.join(a, ["pivot", "x"]).join(b, ["pivot", "y"]).where(
            overlap * (2 * (100 + percent)) >= F.col("gx") + F.col("gy")).select("x", "y")
        found.append(saved(star.union(linked).distinct(), "family-links"))
        others = members.where("far").select("pivot", "cid")
        groups = others.groupBy("pivot").agg(
            F.min(F.struct(F.xxhash64("cid"), "cid")).getField("cid").alias("next"),
            F.count(F.lit(1)).alias("size")).where("size > 1")
        rows, n = counted(others.join(groups, "pivot").select(F.col("next").alias("pivot"), "cid").distinct(),
                          "far-members")
        if not n:
            break
    return reduce(DataFrame.union, found).distinct()


def contract(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (x, y): root is its component's least node.

    Every round hooks each node to its least neighbour and renames the edges' ends, so an
    edge list shrinks until it is empty; a hub's rows are pre-aggregated before the shuffle.
    """
    nodes = edges.select(F.col("x").alias("node")).union(edges.select("y")).distinct()
    roots = nodes.select("node", F.col("node").alias("root"))
    rows = 1
    while rows:
        both = edges.select("x", "y").union(edges.select("y", "x"))
        least = saved(both.groupBy("x").agg(F.min("y").alias("y")).select(
            F.col("x").alias("node"), F.least("x", "y").alias("to")), "hooks")
        roots = roots.join(least.select(F.col("node").alias("root"), "to"), "root", "left").select(
            "node", F.coalesce("to", "root").alias("root"))
        moved = edges.join(least.select(F.col("node").alias("x"), F.col("to").alias("x2")), "x").join(
            least.select(F.col("node").alias("y"), F.col("to").alias("y2")), "y")
        edges, rows = counted(moved.where("x2 != y2").select(
            F.least("x2", "y2").alias("x"), F.greatest("x2", "y2").alias("y")).distinct(), "edges")
    return saved(roots, "roots")


class _Forest:
    """Confirmed links so far, as (cid, label) of the classes that have one."""

    def __init__(self) -> None:
        self.labels: DataFrame | None = None

    def open(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose ends are not connected, with their labels."""
        if self.labels is None:
            return pairs.select("*", F.col("x").alias("lx"), F.col("y").alias("ly"))
        a = self.labels.select(F.col("cid").alias("x"), F.col("label").alias("lx"))
        b = self.labels.select(F.col("cid").alias("y"), F.col("label").alias("ly"))
        return pairs.join(a, "x", "left").join(b, "y", "left").select(
            *pairs.columns, F.coalesce("lx", "x").alias("lx"), F.coalesce("ly", "y").alias("ly")
        ).where("lx != ly")

    def add(self, linked: DataFrame) -> None:
        """Merge the components of linked pairs (x, y, lx, ly)."""
        roots = contract(linked.select(F.col("lx").alias("x"), F.col("ly").alias("y")).distinct())
        if self.labels is None:
            self.labels = roots.select(F.col("node").alias("cid"), F.col("root").alias("label"))
            return
        known = self.labels.join(roots, self.labels.label == roots.node, "left").select(
            "cid", F.coalesce("root", "label").alias("label"))
        new = roots.join(self.labels, roots.node == self.labels.cid, "left_anti").select(
            F.col("node").alias("cid"), F.col("root").alias("label"))
        self.labels = saved(known.union(new), "labels")


def _sets(wanted: DataFrame, docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(cid, items) of the classes ``wanted`` (cid)."""
    keys = classes.join(wanted, "cid", "left_semi").select(
        F.col("cid").alias("doc_id"), "h1", "h2")
    found = full_sets(docs.join(wanted, F.col("doc_id") == F.col("cid"), "left_semi"), words).join(
        keys, ["doc_id", "h1", "h2"], "left_semi").select(F.col("doc_id").alias("cid"), "items")
    return saved(found.dropDuplicates(["cid"]), "sets")


def _confirm(forest: _Forest, pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int,
             percent: int) -> None:
    """Confirm pairs on full sets until none is left between different components."""
    wanted = saved(pairs.select(F.col("x").alias("cid")).union(pairs.select("y")).distinct(), "wanted")
    sets = _sets(wanted, docs, classes, words)
    todo, share = pairs, 1
    while True:
        rank = F.row_number().over(Window.partitionBy("y").orderBy("differ", "x"))
        ranked, rows = counted(forest.open(todo).withColumn("rank", rank), "ranked")
        if not rows:
            return
        now = ranked.where(F.col("rank") <= share)
        inter = F.size(F.array_intersect("a.items", "b.items"))
        union = F.size("a.items") + F.size("b.items") - inter
        linked, found = counted(
            now.join(sets.alias("a"), F.col("x") == F.col("a.cid"))
            .join(sets.alias("b"), F.col("y") == F.col("b.cid"))
            .where(inter * 100 >= union * percent).select("x", "y", "lx", "ly"), "linked")
        if found:
            forest.add(linked)
        todo = ranked.where(F.col("rank") > share).select("x", "y", "differ")
        share *= 4


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, depth: int = 3,
                    recall: float = 0.9999, leaf: int = 32, pivots: int = 3) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id, kept (see the module's text).

    ``words`` per shingle; a link needs a similarity of at least ``percent`` / 100. Members of large
    nodes get up to ``pivots`` pivots, one after another; which links are found does not depend on it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    trees = trees_for(percent / 100, depth, recall)
    most = most_differing(percent / 100)
    marks = saved(signatures(docs, words, trees, depth), "signatures")
    members = marks.where("n > 0 AND doc_id IS NOT NULL")
    ids = members.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("cid"))
    classes = saved(ids, "classes")
    full = members.withColumnRenamed("doc_id", "cid").join(
        classes, ["h1", "h2", "n", "cid"], "left_semi").dropDuplicates(["h1", "h2", "n", "cid"])
    full = saved(full, "class-paths")

    leaves, large = _leaf_rows(full, trees, depth, leaf)
    found = None
    for rows in leaves:
        pairs = _as_pairs(rows.alias("a").join(rows.alias("b"), "node").where(
            (F.col("a.cid") < F.col("b.cid")) & _near(most, percent)))
        found = pairs if found is None else found.union(pairs)
    forest = _Forest()
    if large is not None:
        families = saved(_families(large), "families")
        sets = _sets(saved(families.select("cid").distinct(), "large-members"), docs, full, words)
        links, rows = counted(_family_links(families, sets, percent, pivots), "large-links")
        if rows:
            forest.add(links.select("x", "y", F.col("x").alias("lx"), F.col("y").alias("ly")))
    pairs, rows = counted(forest.open(found.where("x != y").distinct()).select("x", "y", "differ"), "pairs")
    if rows:
        _confirm(forest, pairs, docs, full, words, percent)

    rows = marks.select("doc_id", "n", "h1", "h2").join(
        classes.select("h1", "h2", "n", F.col("cid").alias("class")), ["h1", "h2", "n"], "left")
    component = F.coalesce("class", "doc_id")
    if forest.labels is not None:
        rows = rows.join(forest.labels.withColumnRenamed("cid", "class"), "class", "left")
        component = F.coalesce("label", "class", "doc_id")
    component = F.when(F.col("doc_id").isNotNull(), component)
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
