"""A Merkle manifest of a dataset: one digest for all rows, a proof for each.

Leaves form a tree per key, and the roots of these trees, in order of the key, form one more tree. A tree is cut to
blocks of whole subtrees. A block is hashed in one task: each parent keeps a copy of its hash state from before every
child slot (the midstate), so folding a replaced child takes up the matching state and hashes the replacement and the
siblings to its right, never those to its left. Blocks of blocks follow until one node is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankmill.operators.running import group_totals
from rankmill.sources.scratch import keep

ARITY = 2
# Levels of a tree that one block spans; a block has at most ARITY ** HEIGHT nodes.
HEIGHT = 10

# The tree that joins the roots of all others.
_TOP = "top"
_STEPS = "array<struct<before:string,after:string>>"
_PLACED = "tree string, pos bigint, n bigint, node string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field_text(value: Column) -> Column:
    """One field of a leaf: a dash if null, else its bytes in UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 over all fields of a row."""
    return F.sha2(F.encode(F.concat(*map(field_text, fields)), "UTF-8"), 256)


class Subtree:
    """The lower levels of a tree over consecutive nodes.

    Every parent keeps one copied state per child slot. With ``levels`` given, exactly so many are built, even where
    one node alone is hashed again; without, levels are built until one node remains.
    """

    def __init__(self, nodes: list[str], arity: int = ARITY, levels: int | None = None):
        self.arity = arity
        self.levels = [nodes]
        self.states: list[list[list]] = []
        while len(self.levels[-1]) > 1 if levels is None else len(self.states) < levels:
            below, above, kept = self.levels[-1], [], []
            for first in range(0, len(below), arity):
                state, slots = hashlib.sha256(), []
                for child in below[first : first + arity]:
                    slots.append(state.copy())
                    state.update(child.encode())
                above.append(state.hexdigest())
                kept.append(slots)
            self.levels.append(above)
            self.states.append(kept)
        self.root = self.levels[-1][0]

    def _siblings(self, position: int) -> Iterator[tuple[int, int, int, list[str]]]:
        for level, below in enumerate(self.levels[:-1]):
            parent, slot = divmod(position, self.arity)
            first = parent * self.arity
            yield level, parent, slot, below[first : first + self.arity]
            position = parent

    def steps(self, position: int) -> list[dict]:
        """The siblings before and after the node, joined, level by level."""
        return [
            {"before": "".join(run[:slot]), "after": "".join(run[slot + 1 :])}
            for _, _, slot, run in self._siblings(position)
        ]

    def fold(self, position: int, replacement: str) -> str:
        """The root with another node at ``position``."""
        for level, parent, slot, run in self._siblings(position):
            state = self.states[level][parent][slot].copy()
            state.update(replacement.encode())
            for sibling in run[slot + 1 :]:
                state.update(sibling.encode())
            replacement = state.hexdigest()
        return replacement


class Path:
    """The way from a block's root to the root of all: at each level a state that has the left siblings."""

    def __init__(self, steps: Sequence[dict]):
        self.text = "".join(step["before"] + step["after"] for step in steps)
        self.resume = [(hashlib.sha256(step["before"].encode()), step["after"].encode()) for step in steps]

    def fold(self, node: str) -> str:
        for state, after in self.resume:
            state = state.copy()
            state.update(node.encode())
            state.update(after)
            node = state.hexdigest()
        return node


def _levels(n: int, arity: int, height: int) -> int | None:
    """Levels of every block in a tree of ``n`` nodes; a tree that is one block ends where one node remains."""
    return height if n > arity**height else None


def _block_of(arity: int, height: int) -> Column:
    return F.floor(F.col("pos") / F.lit(arity**height)).cast("bigint").alias("block")


def _raise(nodes: DataFrame, arity: int, height: int) -> DataFrame:
    """The roots of all blocks, as nodes of a smaller tree."""

    def roots(key: tuple, block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        n = block.column("n")[0].as_py()
        tree = Subtree(block.column("node").to_pylist(), arity, _levels(n, arity, height))
        return pa.table(
            {
                "tree": pa.array([key[0].as_py()], pa.string()),
                "pos": pa.array([key[1].as_py()], pa.int64()),
                "n": pa.array([-(-n // arity**height)], pa.int64()),
                "node": pa.array([tree.root], pa.string()),
            }
        )

    grouped = nodes.groupBy("tree", _block_of(arity, height))
    return grouped.applyInArrow(roots, _PLACED)


def _lower(nodes: DataFrame, paths: DataFrame, arity: int, height: int) -> DataFrame:
    """(tree, pos, steps, root) of each node from those of its block's root."""

    def walk(key: tuple, block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        n = block.column("n")[0].as_py()
        tree = Subtree(block.column("node").to_pylist(), arity, _levels(n, arity, height))
        path = above.column("steps")[0].as_py()
        found = [tree.steps(i) + path for i in range(len(block))]
        return pa.table(
            {
                "tree": block.column("tree"),
                "pos": block.column("pos"),
                "steps": pa.array(found, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))),
                "subroot": pa.chunked_array([pa.array([above.column("subroot")[0].as_py()] * len(block), pa.string())]),
                "root": pa.chunked_array([pa.array([above.column("root")[0].as_py()] * len(block), pa.string())]),
            }
        )

    grouped = nodes.groupBy("tree", _block_of(arity, height))
    return grouped.cogroup(paths.groupBy("tree", F.col("pos").alias("block"))).applyInArrow(
        walk, f"tree string, pos bigint, steps {_STEPS}, subroot string, root string"
    )


def _climb(leaves: DataFrame, arity: int, height: int) -> list[DataFrame]:
    """Nodes above ``leaves``, a table per step, until each tree is one node; all are stored."""
    found = []
    nodes = leaves
    while True:
        nodes = keep(_raise(nodes, arity, height), "nodes")
        found.append(nodes)
        if nodes.where("n > 1").isEmpty():
            return found


def _descend(steps: list[DataFrame], paths: DataFrame, arity: int, height: int) -> DataFrame:
    """From the paths of the trees' roots to those of the roots of the lowest blocks."""
    for nodes in reversed(steps[:-1]):
        paths = keep(_lower(nodes, paths, arity, height), "paths")
    return paths


def _sized(leaves: DataFrame) -> DataFrame:
    """Adds ``n``, the number of leaves of a tree; the count is one row a tree."""
    sizes = leaves.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    return leaves.join(sizes, "tree")


def _first(n: int, kind: pa.DataType, value) -> pa.Array:
    return pa.array([value] * n, kind)


def manifest(
    rows: DataFrame,
    fields: Sequence[str],
    tree_col: str,
    order_by: Sequence[str],
    changed: Column | None = None,
    changed_fields: Sequence[Column] | None = None,
    arity: int = ARITY,
    height: int = HEIGHT,
    num_partitions: int | None = None,
) -> DataFrame:
    """One row per row of ``rows``: the ``order_by`` columns, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is ``leaf_digest`` over ``fields``. The rows of one ``tree_col`` are the leaves of a tree in ascending
    ``order_by`` (null first, then the leaf), where every ``arity`` consecutive nodes, the last run having fewer, are
    replaced by the digest of their joined hex text as long as several remain. The trees' roots, in order of
    ``tree_col`` (null first, then bytewise), form the last tree in the same way.

    ``proof_sha256`` is the digest of all siblings of the row's nodes on the way up, left to right, level by level. Rows
    for which ``changed`` holds are folded with the leaf over ``changed_fields`` instead of their own, everything else
    as it is; ``verified`` says whether that gives the root. Without ``changed`` every row verifies.

    A null field is a dash, an empty one ``0:``. Very long texts are hashed whole inside Spark and never move; only
    digests and the ``order_by`` columns do. Rows equal in ``order_by`` follow their leaves; equal rows are leaves
    of their own that may swap places. An empty table gives no rows. No tree meets one task as a whole: equal rows are
    counted first, rows numbered in range slices, and a task holds at most ``arity ** height`` nodes. Other columns
    are not read, whatever their names.
    """
    own = [F.col(c) for c in fields]
    leaf = leaf_digest(own)
    other = F.lit(None).cast("string") if changed is None else F.when(changed, leaf_digest(changed_fields or own))
    tree = F.when(F.col(tree_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit(":"), F.col(tree_col).cast("string")))
    keys = {f"_k{i}": c for i, c in enumerate(order_by)}
    plain = rows.select(
        tree.alias("tree"), *(F.col(c).alias(k) for k, c in keys.items()), leaf.alias("node"), other.alias("other")
    )
    ranked = group_totals(
        keep(plain, "leaves"),
        "tree",
        [*map(F.col, keys), F.col("node")],
        {"rank": F.lit(1).cast("bigint")},
        num_partitions,
    )
    leaves = keep(_sized(ranked.withColumn("pos", F.col("rank") - 1).drop("rank")), "leaves")
    steps = _climb(leaves.select("tree", "pos", "n", "node"), arity, height)

    # The roots of all trees are the leaves of the last one; a dash sorts before a colon.
    roots = steps[-1].select(F.lit(_TOP).alias("group"), "tree", "node")
    ordered = group_totals(roots, "group", [F.col("tree")], {"rank": F.lit(1).cast("bigint")}, num_partitions)
    top = ordered.select(
        F.col("group").alias("tree"), (F.col("rank") - 1).alias("pos"), "node", F.col("tree").alias("of")
    )
    top = keep(_sized(top), "roots")
    top_steps = _climb(top.select("tree", "pos", "n", "node"), arity, height)
    above = top_steps[-1].select(
        "tree", "pos", F.array().cast(_STEPS).alias("steps"), F.lit("").alias("subroot"), F.col("node").alias("root")
    )
    above = _descend(top_steps, above, arity, height)
    above = keep(_lower(top.select("tree", "pos", "n", "node"), above, arity, height), "paths")
    starts = (
        top.join(above.select("pos", "steps", "root"), "pos")
        .select(F.col("of").alias("tree"), F.lit(0).cast("bigint").alias("pos"), "steps", F.col("node").alias("subroot"), "root")
    )
    paths = _descend(steps, keep(starts, "paths"), arity, height)

    names = list(keys)
    given = [T.StructField(keys[k], plain.schema[k].dataType) for k in names]
    ddl = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    schema = T.StructType([*given, *T.StructType.fromDDL(ddl).fields])

    def prove(key: tuple, block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        size, n = len(block), block.column("n")[0].as_py()
        nodes = block.column("node").to_pylist()
        built = Subtree(nodes, arity, _levels(n, arity, height))
        path = Path(above.column("steps")[0].as_py())
        root = above.column("root")[0].as_py()
        proofs, folded = [], []
        for i, (node, instead) in enumerate(zip(nodes, block.column("other").to_pylist(), strict=True)):
            proofs.append(digest("".join(s["before"] + s["after"] for s in built.steps(i)) + path.text))
            folded.append(path.fold(built.fold(i, instead or node)))
        return pa.table(
            {
                **{keys[k]: block.column(k) for k in names},
                "leaf": block.column("node"),
                "subroot": _first(size, pa.string(), above.column("subroot")[0].as_py()),
                "root": _first(size, pa.string(), root),
                "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array(folded, pa.string()),
                "verified": pa.array([f == root for f in folded], pa.bool_()),
            }
        )

    grouped = leaves.groupBy("tree", _block_of(arity, height))
    return grouped.cogroup(paths.groupBy("tree", F.col("pos").alias("block"))).applyInArrow(prove, schema)
