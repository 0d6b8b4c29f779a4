"""Merkle manifest of a dataset: a tree of digests for each group of rows, a root over the groups, and proofs.

Rows are digested where they are read and sorted by range of group and id, so that a group of any size is dealt over many
tasks; counts of the ranges give every leaf its place in its group, and with it the arity of all its ancestors. Nodes then
climb the tree as events: a partial parent gathers its children's digests by their slots, whatever their order, and once it
has as many as its group's size asks for it becomes a node itself and is told to its own parent. Sorted ranges complete
nearly all parents where they are; the children of those that stay partial (the frontier, a few at each end of a range) are
reshuffled by ever larger blocks of leaves until only the groups' tops are left. Every parent that is completed is kept with
its children's digests; along these links, from the root down, each node gets its siblings' digests level by level, which
make up the proof of a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Levels of the tree that one reshuffle of the frontier completes at least: a task's group has ARITY ** LEVELS nodes at most.
LEVELS = 3
ARITY = 16
#: Partial parents that a task keeps; beyond, they go to the frontier as they are.
PARTIAL = 100_000
#: Completed nodes in one batch of results.
BATCH = 10_000

LINK, OPEN, TOP = range(3)
_NODES = "kind int, grp string, n bigint, level int, place bigint, digest binary, children binary"


def field(c: Column) -> Column:
    """A value as it is digested: its UTF-8 byte count, a colon and the value, or - for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*columns: Column) -> Column:
    """The row's digest, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*map(field, columns)), 256))


def told(digest: Column) -> Column:
    """Digests as lowercase hex text."""
    return F.lower(F.hex(digest))


def joint(children: bytes) -> bytes:
    """The digest of a run of digests, which are put together as hex text."""
    return hashlib.sha256(children.hex().encode()).digest()


class Climb:
    """Partial parents of one task. After each event, `out` holds what has been completed by it."""

    def __init__(self, arity: int):
        self.arity = arity
        self.partial: dict[tuple, dict[int, bytes]] = {}
        self.out: list[tuple] = []

    def add(self, grp: str, n: int, level: int, place: int, digest: bytes) -> None:
        while True:
            width = -(-n // self.arity**level)
            if width == 1:
                self.out.append((TOP, grp, n, level, place, digest, None))
                return
            parent, slot = divmod(place, self.arity)
            held = self.partial.setdefault((grp, n, level, parent), {})
            held[slot] = digest
            if len(held) < min(self.arity, width - self.arity * parent):
                return
            del self.partial[grp, n, level, parent]
            children = b"".join(held[i] for i in range(len(held)))
            level, place, digest = level + 1, parent, joint(children)
            self.out.append((LINK, grp, n, level, place, digest, children))

    def leave(self) -> None:
        """Children of the parents that are still partial go to the frontier."""
        for (grp, n, level, parent), held in self.partial.items():
            self.out += [(OPEN, grp, n, level, parent * self.arity + slot, digest, None) for slot, digest in held.items()]
        self.partial.clear()

    def batch(self) -> pa.RecordBatch:
        rows, self.out = self.out, []
        return pa.record_batch([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["kind", "grp", "n", "level", "place", "digest", "children"])


def climbed(nodes: DataFrame, arity: int) -> DataFrame:
    """What the nodes (grp, n, level, place, digest) of each partition complete, and what they leave open."""

    def run(batches):
        task = Climb(arity)
        for batch in batches:
            for event in zip(*(batch.column(c).to_pylist() for c in ("grp", "n", "level", "place", "digest"))):
                task.add(*event)
                if len(task.out) >= BATCH:
                    yield task.batch()
            if len(task.partial) > PARTIAL:
                task.leave()
        task.leave()
        yield task.batch()

    return written(nodes.select("grp", "n", "level", "place", "digest").mapInArrow(run, _NODES), "tree-nodes")


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows with their place in their group (grp), by the order, and the group's size n; equal rows in any order."""
    own = [*rows.columns]
    tied = rows.withColumn("tie", F.monotonically_increasing_id())
    by = [F.col("grp"), *(F.asc_nulls_first(c) for c in order), F.col("tie")]
    ranged = written(tied.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie").withColumn("at", F.monotonically_increasing_id()), "sorted-leaves")
    of_range = ranged.groupBy("grp", F.shiftright("at", 33).alias("range")).agg(F.min("at").alias("first"), F.count("*").alias("held"))
    before = F.sum("held").over(Window.partitionBy("grp").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    # a written table, as Spark then knows whether it is small enough to be sent
    ranges = written(of_range.withColumn("before", F.coalesce(before, F.lit(0))).withColumn("n", F.sum("held").over(Window.partitionBy("grp"))).drop("held"), "ranges")
    met = ranged.withColumn("range", F.shiftright("at", 33)).join(ranges, ["grp", "range"])
    return met.select(*own, "n", (F.col("at") - F.col("first") + F.col("before")).alias("place"))


def tree(leaves: DataFrame, arity: int) -> tuple[DataFrame, DataFrame]:
    """All completed parents of the leaves (grp, n, place, digest) and the groups' tops."""
    found = climbed(leaves.withColumn("level", F.lit(0)), arity)
    every, span = found, 1
    while not (frontier := found.filter(F.col("kind") == OPEN)).isEmpty():
        span *= arity**LEVELS
        block = F.expr(f"CAST(place * CAST(power({arity}, level) AS BIGINT) DIV {span} AS BIGINT)")
        found = climbed(frontier.withColumn("block", block).repartition("grp", "block"), arity)
        every = every.unionByName(found)
    return every.filter(F.col("kind") == LINK), every.filter(F.col("kind") == TOP)


@dataclass
class Manifest:
    """The trees as tables. leaves: grp, the caller's columns, digest, n, place; links and root_links: completed parents with
    their children's digests; groups: a row for each group with its subroot, its tree's height (level), and its leaf's place
    in the tree over the groups; root: 32 bytes, None without rows."""

    leaves: DataFrame
    links: DataFrame
    groups: DataFrame
    root_links: DataFrame
    root: bytes | None
    arity: int


def manifest(rows: DataFrame, id_col: str, group_col: str, columns: Sequence[str], also: dict[str, Column] | None = None, arity: int = ARITY) -> Manifest:
    """The manifest of rows: leaves are digests of `columns`, each group's ascend by id (null first), groups by UTF-8 bytes
    (null first). also: further columns of the leaves.

    While a level has more than one node, every `arity` consecutive ones become the digest of their digests as hex text. A
    null value has a form that no value has. Equal ids stand by their digests, equal rows in any order, and each is a leaf.
    An empty table has no groups and no root. Columns that aren't named don't count. Texts are digested whole.
    """
    group = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))
    made = rows.select(group.alias("grp"), F.col(id_col).alias("id"), leaf_digest(*(F.col(c) for c in columns)).alias("digest"), *(c.alias(name) for name, c in (also or {}).items()))
    # as a table of its own, as ranges are found from a sample, and texts would be read and digested for it once more
    leaves = written(placed(written(made, "leaf-digests"), ["id", "digest"]), "leaves")
    links, tops = tree(leaves, arity)
    over = tops.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "n", "level", "digest").withColumnsRenamed({"n": "own_n", "level": "height"})
    groups = written(placed(over, ["of"]), "groups")
    root_links, root_tops = tree(groups, arity)
    root = root_tops.first()
    return Manifest(leaves, links, groups.select(F.col("of").alias("grp"), F.col("own_n").alias("n"), F.col("height").alias("level"), F.col("digest").alias("subroot"), "place"), root_links, root and bytes(root["digest"]), arity)


def _below(parents: DataFrame, arity: int, keep: Sequence[str]) -> DataFrame:
    """The children of parents (place, children, path): place, and path with the siblings of each before its parent's."""
    each = parents.withColumn("slot", F.explode(F.expr("sequence(0, octet_length(children) DIV 32 - 1)")))
    return each.select(*keep, (F.col("place") * arity + F.col("slot")).alias("place"), _path(F.col("slot")).alias("path"))


def _path(slot: Column) -> Column:
    """The siblings on both sides of the child in the slot, and then the parent's path."""
    cut = lambda start, length: F.substring(F.col("children"), start, length)
    own = F.struct(cut(F.lit(1), (slot * 32).cast("int")).alias("before"), cut((slot * 32 + 33).cast("int"), F.octet_length("children")).alias("after"))
    return F.concat(F.array(own), F.col("path"))


def proofs(found: Manifest) -> DataFrame:
    """The leaves with subroot and path: for each level from the leaf's to the root's, the digests of the siblings before and
    after, 32 bytes each."""
    arity, empty = found.arity, F.expr("CAST(array() AS array<struct<before: binary, after: binary>>)")
    rises = lambda links: links.agg(F.max("level")).first()[0] or 0
    # the tree over the groups, from its top down to the groups
    over, at = rises(found.root_links), None
    for level in range(over, 0, -1):
        parents = found.root_links.filter(F.col("level") == level).select("place", "children")
        parents = parents.withColumn("path", empty) if at is None else parents.join(at, "place")
        at = _below(parents, arity, [])
    of_group = found.groups.withColumn("path", empty) if at is None else found.groups.join(at, "place")
    tops = written(of_group.select("grp", "level", "subroot", "path"), "group-paths")
    # the groups' trees, from the highest level down to the parents of leaves
    at = None
    for level in range(rises(found.links), 0, -1):
        starts = tops.filter(F.col("level") == level).select("grp", F.lit(0).cast("long").alias("place"), "subroot", "path")
        held = starts if at is None else at.unionByName(starts)
        parents = held.join(found.links.filter(F.col("level") == level).select("grp", "place", "children"), ["grp", "place"])
        at = _below(parents, arity, ["grp", "subroot"]) if level > 1 else parents
    alone = tops.filter(F.col("level") == 0).select("grp", F.lit(0).cast("long").alias("place"), "subroot", "path", F.lit(None).cast("binary").alias("children"))
    parents = alone if at is None else at.unionByName(alone)
    parents = parents.withColumnRenamed("place", "parent")
    met = found.leaves.withColumn("parent", F.floor(F.col("place") / arity)).join(parents, ["grp", "parent"])
    path = F.when(F.col("children").isNull(), F.col("path")).otherwise(_path(F.col("place") - F.col("parent") * arity))
    return met.withColumn("path", path).drop("parent", "children")


def proof_digest(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: told(F.concat(s["before"], s["after"]))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root, as hex text, that follows from a leaf's digest and its siblings."""
    return F.aggregate(path, told(leaf), lambda digest, s: F.sha2(F.concat(told(s["before"]), digest, told(s["after"])), 256))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
