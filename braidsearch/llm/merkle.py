"""A Merkle manifest of a dataset, and proofs of its rows by octopus multiproofs.

Every row is a leaf: the SHA-256 of its fields, each with its length. The leaves of a tree stand in
the order of a key; while a level has several nodes, every two neighbours become the hash of both, a
last one alone the hash of itself. The roots of all trees are the leaves of one tree more, whose
root stands for the dataset. Digests are hex texts and are hashed as such.

*Building.* A range sort on tree and key numbers the leaves without a group for any tree, so a tree that
holds a third of all rows, or all, is spread like the rest; equal keys are told apart by their leaves. ``2 **
BITS`` neighbouring leaves are a leaf partition; a task climbs `BITS` levels above it. The nodes reached
are the leaves of the next tier, so a billion rows take three tiers.

*Proving.* Each leaf partition marks the paths of the leaves it is asked for, level by level, and lists
the coordinates that the marked nodes need and do not give themselves: the union over its leaves, each
once. These few are fetched by one join with the stored nodes, and then the partition derives its shared
interior nodes and expands the proof of every leaf on its own. A partition whose leaves are all asked for
fetches one node a level above it.

Defined results: a null field is ``-``; a null tree is a tree of its own, before all others; null keys come
first in their tree; repeated rows are equal leaves, each with a proof of its own; a lone leaf is the root of
its tree; very long fields are hashed whole; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from braidsearch.session import materialize

# Levels that a task climbs; 2 ** BITS leaves are a leaf partition.
BITS = 12
# Bytes of nodes that may be broadcast when nodes are fetched.
BROADCAST_BYTES = 32 << 20
NODE_BYTES = 128

NODES = "tree string, level int, index bigint, hash string, last boolean"


def field(column: Column) -> Column:
    """Byte count and value of a field, ``-`` where it is null."""
    value = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(column) for column in columns)), 256)


def tree_name(column: Column) -> Column:
    """A text that orders trees: null first, the others by their bytes."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


@dataclass
class Forest:
    """Numbered leaves, the nodes above them by tier, and the root of every tree.

    ``leaves``: ``tree, at, n, leaf`` and what else they carry; ``n`` is the number of leaves of the tree.
    """

    leaves: DataFrame
    tiers: list[DataFrame]
    bits: int

    @property
    def roots(self) -> DataFrame:
        """``tree, hash`` of every tree."""
        found = [self.leaves.filter("n = 1").select("tree", F.col("leaf").alias("hash"))]
        found += [tier.filter("last").select("tree", "hash") for tier in self.tiers]
        return reduce(DataFrame.unionByName, found)

    def level(self, tier: int) -> DataFrame:
        """``tree, level, index, hash`` of the nodes on levels ``tier * bits`` to before those of the next."""
        low, high = tier * self.bits, (tier + 1) * self.bits
        if tier == 0:
            found = [self.leaves.select("tree", F.lit(0).alias("level"), F.col("at").alias("index"), F.col("leaf").alias("hash"))]
        else:
            found = [self.tiers[tier - 1].filter(F.col("level") == low)]
        if tier < len(self.tiers):
            found.append(self.tiers[tier].filter(F.col("level") < high))
        return reduce(DataFrame.unionByName, (part.select("tree", "level", "index", "hash") for part in found))


# --- building


def numbered(leaves: DataFrame, order: list[str]) -> DataFrame:
    """``leaves`` with ``at``, its place in its tree, and ``n``, the size of the tree.

    ``leaves`` are stored rows: Spark reads them twice, once to find the ranges.
    """
    keys = ["tree", *order, "leaf", "row"]
    placed = leaves.withColumn("row", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = materialize(placed.withColumn("row", F.monotonically_increasing_id()), "merkle-sorted")
    part = F.shiftright("row", 33).alias("part")
    # one row for each tree that a part holds
    pieces = placed.groupBy("tree", part).agg(F.count("*").alias("held"), F.min("row").alias("first"))
    of_tree = Window.partitionBy("tree")
    before = of_tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        "tree", "part", "first", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"),
        F.sum("held").over(of_tree).alias("n"),
    )
    joined = placed.withColumn("part", part).join(pieces, ["tree", "part"])
    return joined.withColumn("at", F.col("row") - F.col("first") + F.col("before")).drop("row", "part", "first", "before")


def above(level: list[str]) -> list[str]:
    """The hashes of every two neighbours, of a last one alone."""
    return [sha256("".join(level[i : i + 2]).encode()).hexdigest() for i in range(0, len(level), 2)]


def _climb(base: int, bits: int):
    """Nodes above one run of neighbours ``tree, n, index, hash`` on level ``base``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        tree, total = table["tree"][0].as_py(), table["n"][0].as_py()
        low, hashes = table["index"][0].as_py(), table["hash"].to_pylist()
        levels, indices, found, last = [], [], [], []
        for level in range(base + 1, base + bits + 1):
            if total == 1:
                break
            low, total, hashes = low >> 1, (total + 1) >> 1, above(hashes)
            levels += [level] * len(hashes)
            indices += range(low, low + len(hashes))
            found += hashes
            last += [total == 1] * len(hashes)
        columns = [[tree] * len(found), levels, indices, found, last]
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.bool_()]
        return pa.Table.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)],
            names=["tree", "level", "index", "hash", "last"],
        )

    return run


def forest(leaves: DataFrame, order: list[str], bits: int = BITS) -> Forest:
    """Trees over ``leaves`` (``tree, leaf``, the columns of ``order``, others), leaves ordered by ``order``."""
    rows = materialize(numbered(leaves, order), "merkle-leaves")
    sizes = rows.groupBy("tree").agg(F.first("n").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    tiers = []
    level = rows.select("tree", "n", F.col("at").alias("index"), F.col("leaf").alias("hash"))
    while most > 1:
        base = len(tiers) * bits
        runs = level.filter("n > 1").groupBy("tree", F.shiftright("index", bits))
        tier = materialize(runs.applyInArrow(_climb(base, bits), NODES), "merkle-nodes")
        tiers.append(tier)
        most = -(-most >> bits)
        # the nodes reached are the next leaves; a tree's size shrinks as its levels do
        reached = tier.filter((F.col("level") == base + bits) & ~F.col("last")).drop("level", "last")
        shrunk = sizes.select("tree", F.ceil(F.col("n") / F.lit(1 << (base + bits))).alias("n"))
        level = reached.join(shrunk, "tree")
    return Forest(rows, tiers, bits)


# --- proving


def missing(at: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Level and index of the nodes that proofs of the leaves ``at`` need and these do not give.

    ``at`` are sorted places in a tree of ``n`` leaves.
    """
    level = 0
    while n > 1:
        beside = at ^ 1
        need = beside[(beside < n) & ~np.isin(beside, at)]
        yield from ((level, int(index)) for index in need)
        at, n, level = np.unique(at >> 1), (n + 1) >> 1, level + 1


def expand(at: np.ndarray, leaves: list[str], n: int, fetched: dict) -> list[list[str | None]]:
    """Of each leaf its siblings from the leaves up, None where a node stands alone.

    ``fetched`` holds what `missing` lists; all other nodes are derived here, each once.
    """
    proofs: list[list[str | None]] = [[] for _ in leaves]
    known, below = dict(zip(at.tolist(), leaves, strict=True)), at
    level = 0
    while n > 1:
        for index in np.unique(below).tolist():
            beside = index ^ 1
            if beside < n and beside not in known:
                known[beside] = fetched[level, beside]
        for proof, index in zip(proofs, below.tolist(), strict=True):
            proof.append(known.get(index ^ 1))
        up = {}
        for index in np.unique(below >> 1).tolist():
            both = known[2 * index] + known.get(2 * index + 1, "")
            up[index] = sha256(both.encode()).hexdigest()
        known, below, n, level = up, below >> 1, (n + 1) >> 1, level + 1
    return proofs


def fold(leaf: str, at: int, siblings: list[str | None]) -> str:
    """The root that a leaf and its siblings lead to."""
    for beside in siblings:
        if beside is None:
            both = leaf
        else:
            both = beside + leaf if at & 1 else leaf + beside
        leaf, at = sha256(both.encode()).hexdigest(), at >> 1
    return leaf


def _needs(table: pa.Table) -> pa.Table:
    at, n = np.unique(table["at"].to_numpy()), table["n"][0].as_py()
    wanted = list(missing(at, n))
    return pa.table(
        {
            "tree": pa.array([table["tree"][0].as_py()] * len(wanted), pa.string()),
            "block": pa.array([table["block"][0].as_py()] * len(wanted), pa.int64()),
            "level": pa.array([level for level, _ in wanted], pa.int32()),
            "index": pa.array([index for _, index in wanted], pa.int64()),
        }
    )


def _fetched(of: Forest, needs: DataFrame) -> DataFrame:
    """``tree, block, fetched``: the needed nodes of every leaf partition.

    A node of tier t is needed by at most ``2 ** (BITS * (t - 1))`` partitions: few for the lowest two tiers,
    which are joined by their coordinates. Above there is one node for `2 ** (2 * BITS)` leaves; these are
    broadcast as long as they are small.
    """
    tier = F.floor(F.col("level") / of.bits).cast("int")
    found = []
    for row in needs.select(tier.alias("tier")).distinct().collect():  # one row for each tier, three or four
        nodes = of.level(row.tier)
        if row.tier > 1 and nodes.count() * NODE_BYTES <= BROADCAST_BYTES:
            nodes = F.broadcast(nodes)
        found.append(needs.filter(tier == row.tier).join(nodes, ["tree", "level", "index"]))
    each = F.collect_list(F.struct("level", "index", "hash")).alias("fetched")
    if not found:
        return needs.withColumn("hash", F.lit("")).groupBy("tree", "block").agg(each)
    return reduce(DataFrame.unionByName, found).groupBy("tree", "block").agg(each)


Finish = Callable[[list, dict, list], list]


def proved(
    of: Forest, finish: Finish, schema: str, carried: DataFrame | None = None,
    wanted: Column | None = None,
) -> DataFrame:
    """Rows of ``schema`` that ``finish`` makes of the proofs, leaf partition by leaf partition.

    ``finish`` gets the leaves as dicts, what ``carried`` says of their tree, and their proofs. ``wanted``
    is a condition on leaves; without it all are proved.
    """
    asked = of.leaves if wanted is None else of.leaves.filter(wanted)
    asked = asked.withColumn("block", F.shiftright("at", of.bits))
    needs = asked.filter("n > 1").select("tree", "block", "at", "n").groupBy("tree", "block").applyInArrow(
        _needs, "tree string, block bigint, level int, index bigint"
    )
    fetched = _fetched(of, materialize(needs, "merkle-needs"))
    blocks = asked.select("tree", "block").distinct().join(fetched, ["tree", "block"], "left")
    if carried is not None:
        blocks = blocks.join(carried, "tree")
    blocks = materialize(blocks, "merkle-blocks")

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(leaves: pa.Table, block: pa.Table) -> pa.Table:
        rows, about = leaves.to_pylist(), block.to_pylist()[0]
        nodes = {(node["level"], node["index"]): node["hash"] for node in about["fetched"] or ()}
        at = leaves["at"].to_numpy()
        proofs = expand(at, [row["leaf"] for row in rows], rows[0]["n"], nodes)
        return pa.Table.from_pylist(finish(rows, about, proofs), schema=arrow)

    return asked.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(run, schema)


# --- the manifest of a table


@dataclass
class Manifest:
    """The trees of a table, and the tree over their roots."""

    trees: Forest
    top: Forest

    @property
    def root(self) -> DataFrame:
        """One row ``root``; none for an empty table."""
        return self.top.roots.select(F.col("hash").alias("root"))


def manifest(leaves: DataFrame, order: list[str], bits: int = BITS) -> Manifest:
    trees = forest(leaves, order, bits)
    roots = materialize(trees.roots, "merkle-roots")
    top = roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("hash").alias("leaf"))
    return Manifest(trees, forest(top, ["name"], bits))


def tops(found: Manifest) -> DataFrame:
    """``tree, top_at, top_siblings, subroot, root``: where the root of each tree stands in the last one."""

    def finish(rows, about, proofs):
        return [
            {"tree": row["name"], "top_at": row["at"], "top_siblings": proof, "subroot": row["leaf"], "root": about["root"]}
            for row, proof in zip(rows, proofs, strict=True)
        ]

    schema = "tree string, top_at bigint, top_siblings array<string>, subroot string, root string"
    return proved(found.top, finish, schema, found.top.roots.withColumnRenamed("hash", "root"))


def proofs(found: Manifest, wanted: Column | None = None) -> DataFrame:
    """``tree, at, leaf, siblings, top_at, top_siblings, subroot, root`` of every leaf, or of those ``wanted``."""

    def finish(rows, about, paths):
        same = {name: about[name] for name in ("tree", "top_at", "top_siblings", "subroot", "root")}
        return [
            {"at": row["at"], "leaf": row["leaf"], "siblings": path} | same
            for row, path in zip(rows, paths, strict=True)
        ]

    return proved(
        found.trees, finish,
        "tree string, at bigint, leaf string, siblings array<string>, top_at bigint, top_siblings array<string>, "
        "subroot string, root string", tops(found), wanted,
    )


def checked(found: Manifest, wanted: Column | None = None) -> DataFrame:
    """``row_id, leaf, subroot, root, proof_sha256, folded_root``: proofs folded from the leaf a reader holds.

    Leaves carry ``row_id`` and ``held``, the hash of the row as the reader has it, null where it is the leaf.
    """

    def finish(rows, about, paths):
        top_at, top = about["top_at"], about["top_siblings"]
        out = []
        for row, path in zip(rows, paths, strict=True):
            given = "".join(node for node in [*path, *top] if node is not None)
            subroot = fold(row["held"] or row["leaf"], row["at"], path)
            out.append(
                {
                    "row_id": row["row_id"], "leaf": row["leaf"], "subroot": about["subroot"], "root": about["root"],
                    "proof_sha256": sha256(given.encode()).hexdigest(), "folded_root": fold(subroot, top_at, top),
                }
            )
        return out

    return proved(
        found.trees, finish,
        "row_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string", tops(found), wanted,
    )


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def document_leaves(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """``tree, row_id, leaf, held`` of a table of documents; ``tampered`` rows are held with one character more."""
    fields = {name: F.col(name) for name in FIELDS}
    more = leaf([*(fields | {"n_chars": F.col("n_chars") + 1}).values()])
    held = F.when(tampered, more) if tampered is not None else F.lit(None).cast("string")
    found = docs.select(
        tree_name(F.col("lang")).alias("tree"), F.col("doc_id").cast("bigint").alias("row_id"),
        leaf(list(fields.values())).alias("leaf"), held.alias("held"),
    )
    return materialize(found, "merkle-hashed")


def document_manifest(docs: DataFrame, tampered: Column | None = None, bits: int = BITS) -> Manifest:
    """The manifest of a table of documents: a tree for each ``lang``, leaves by ``doc_id``."""
    return manifest(document_leaves(docs, tampered), ["row_id"], bits)
