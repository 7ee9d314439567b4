"""Scoring rows with a trained ensemble of decision trees, without leaving Spark's own expressions.

All trees lie in flat arrays of nodes, which become literals of the plan. A row holds one node number per tree; every
level moves all of them one step down, until each is a leaf.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Nodes are literals of the plan, so their number is bounded.
MAX_NODES = 1 << 16


@dataclass(frozen=True)
class Ensemble:
    """Nodes of all trees in one numbering; a leaf has feature -1 and is its own child.

    A row goes ``left`` where its feature is below ``threshold``, ``missing`` where it has none (NULL or NaN), else
    ``right``. The score is ``base`` and the values of the leaves reached.
    """

    features: tuple[str, ...]
    roots: tuple[int, ...]
    feature: tuple[int, ...]
    threshold: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    missing: tuple[int, ...]
    value: tuple[float, ...]
    depth: int
    base: float = 0.0


def from_dump(dump: Sequence[Mapping], features: Sequence[str], base: float = 0.0) -> Ensemble:
    """Read trees in the common nested form: ``nodeid, split, split_condition, yes, no, missing, children``, or ``leaf``."""
    nodes: list[list] = []
    deepest = 0
    names = list(features)

    def add(node: Mapping, depth: int) -> int:
        nonlocal deepest
        deepest = max(deepest, depth)
        number = len(nodes)
        nodes.append([-1, 0.0, number, number, number, 0.0])
        if "leaf" in node:
            nodes[number][5] = float(node["leaf"])
            return number
        below = {child["nodeid"]: add(child, depth + 1) for child in node["children"]}
        left, right = below[node["yes"]], below[node["no"]]
        missing = below[node.get("missing", node["yes"])]
        nodes[number] = [names.index(node["split"]), float(node["split_condition"]), left, right, missing, 0.0]
        return number

    roots = tuple(add(tree, 0) for tree in dump)
    if len(nodes) > MAX_NODES:
        raise ValueError(f"the trees have {len(nodes)} nodes, more than {MAX_NODES}")
    columns = zip(*nodes, strict=True) if nodes else [()] * 6
    feature, threshold, left, right, missing, value = map(tuple, columns)
    return Ensemble(tuple(names), roots, feature, threshold, left, right, missing, value, deepest, base)


def _literals(values: Sequence, dtype: str) -> Column:
    return F.array(*map(F.lit, values)).cast(f"array<{dtype}>")


def tree_score(model: Ensemble) -> Column:
    """The score of a row with the model's feature columns."""
    feature, left, right, missing = (
        _literals(v, "int") for v in (model.feature, model.left, model.right, model.missing)
    )
    threshold, value = _literals(model.threshold, "double"), _literals(model.value, "double")
    row = F.array(*(F.col(f"`{name}`").cast("double") for name in model.features)).cast("array<double>")

    def down(at: Column) -> Column:
        x = F.get(row, F.get(feature, at))
        return (
            F.when(F.get(feature, at) < 0, at)
            .when(x.isNull() | F.isnan(x), F.get(missing, at))
            .when(x < F.get(threshold, at), F.get(left, at))
            .otherwise(F.get(right, at))
        )

    levels = F.sequence(F.lit(1), F.lit(model.depth)) if model.depth else F.array().cast("array<int>")
    leaves = F.aggregate(levels, _literals(model.roots, "int"), lambda at, _: F.transform(at, down))
    return F.aggregate(leaves, F.lit(float(model.base)), lambda total, at: total + F.get(value, at))


def score_trees(df: DataFrame, model: Ensemble, target: str = "pred") -> DataFrame:
    """Add the score of every row; columns other than the features are untouched and never leave the JVM."""
    return df.withColumn(target, tree_score(model))
