"""Reply trees to chat text: root-to-leaf paths, branches ranked by score, one formatted conversation a path.

A message is written as ``<|im_start|>role``, a line break, the text, ``<|im_end|>`` and a line break. Control
strings inside roles and texts are escaped, so what is written can be read back exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.operators.running import group_rank
from rankmill.sources.scratch import keep

START, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"

# A written message. Escaped texts hold no "<|", escaped roles no line break either.
_MESSAGE = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END) + "\n", re.DOTALL)
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escaped(text: Column) -> Column:
    """One backslash more between "<" and "|", so that no control string is left; reversed by ``unescaped``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escaped_role(role: Column) -> Column:
    """As for texts, after backslashes are doubled and line breaks written as two characters."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: str) -> str:
    return _ROLE_ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def chain(rows: DataFrame, tree: str, order_by: Sequence[str]) -> DataFrame:
    """Turns as a tree without branches: adds ``node``, the rank by ``order_by``, and ``parent``, the one before."""
    ranked = group_rank(rows.drop("node", "parent"), [tree], [F.col(c) for c in order_by], "node")
    return ranked.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def _same(left: DataFrame, right: DataFrame, node: str, other: str) -> Column:
    return left["_tree"].eqNullSafe(right["_t"]) & (left[node] == right[other])


def _steps(nodes: DataFrame) -> list[DataFrame]:
    """Ancestors 1, 2, 4, ... edges up: each from the one before joined with itself, until none is left."""
    limit = max(1, nodes.count()).bit_length()
    steps = [keep(nodes.where("_parent is not null").select("_tree", "_node", F.col("_parent").alias("_up")), "step")]
    while not steps[-1].isEmpty():
        # In n nodes no path has n edges, so ancestors that far up mean a circle of replies.
        if len(steps) > limit:
            raise ValueError("some replies answer each other in a circle")
        near = steps[-1]
        far = near.select(F.col("_tree").alias("_t"), F.col("_node").alias("_n"), F.col("_up").alias("_far"))
        doubled = near.join(far, _same(near, far, "_up", "_n")).select("_tree", "_node", F.col("_far").alias("_up"))
        steps.append(keep(doubled, "step"))
    return steps[:-1]


def paths(nodes: DataFrame) -> DataFrame:
    """(_tree, _leaf, _node, _back) for every node on every root-to-leaf path, ``_back`` edges above the leaf."""
    steps = _steps(nodes)
    parents = nodes.where("_parent is not null").select(F.col("_tree").alias("_t"), F.col("_parent").alias("_p"))
    leaves = nodes.join(parents, _same(nodes, parents, "_node", "_p"), "left_anti")
    found = leaves.select("_tree", F.col("_node").alias("_leaf"), "_node", F.lit(0).cast("bigint").alias("_back"))
    # Each distance is one sum of powers of two: every pass adds, for what is found, what lies 2^k edges further.
    for k in reversed(range(len(steps))):
        far = steps[k].select(F.col("_tree").alias("_t"), F.col("_node").alias("_n"), "_up")
        further = found.join(far, _same(found, far, "_node", "_n")).select(
            "_tree", "_leaf", F.col("_up").alias("_node"), F.col("_back") + (1 << k)
        )
        found = keep(found.union(further), "paths")
    return found


def format_paths(
    messages: DataFrame,
    tree: str = "conv_id",
    node: str = "node",
    parent: str = "parent",
    role: str = "role",
    text: str = "text",
    score: str | None = None,
    top: int | None = None,
) -> DataFrame:
    """The messages of the chosen root-to-leaf paths as consecutive pieces of formatted text.

    Returns (tree, leaf, path_rank, position, role, segment, loss_start, loss_length). The segments of a path in
    order of ``position`` are its conversation. The loss mask covers ``loss_length`` code points from
    ``loss_start`` of the segment: the text of an assistant's message, nothing else. Paths are ranked in their
    tree by the falling sum of their messages' ``score`` (null is 0), then by leaf; ``top`` keeps the best.

    A message whose parent is null or missing is a root. Null roles and texts are empty; messages without a node
    are left out, a null tree is a tree. Of rows with one (tree, node) the smallest by parent, role and text
    counts. Circles are an error. Other columns are not read. No list is gathered: one conversation with a large
    share of all rows stays rows, and ranks are found over several tasks.
    """
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    rows = messages.where(f"`{node}` is not null").select(
        F.col(tree).alias("_tree"),
        F.col(node).alias("_node"),
        F.struct(
            F.col(parent).alias("parent"),
            F.coalesce(role, F.lit("")).alias("role"),
            F.coalesce(text, F.lit("")).alias("text"),
            value.alias("score"),
        ).alias("_m"),
    )
    kept = keep(rows.groupBy("_tree", "_node").agg(F.min("_m").alias("_m")).select("_tree", "_node", "_m.*"), "messages")
    ids = kept.select(F.col("_tree").alias("_t"), F.col("_node").alias("_n"))
    linked = kept.select("_tree", "_node", F.col("parent").alias("_parent"), "score")
    nodes = linked.join(ids, _same(linked, ids, "_parent", "_n"), "left").select(
        "_tree", "_node", F.col("_n").alias("_parent"), "score"
    )
    nodes = keep(nodes, "nodes")
    found = paths(nodes)
    scores = nodes.select(F.col("_tree").alias("_t"), F.col("_node").alias("_n"), "score")
    branches = (
        found.join(scores, _same(found, scores, "_node", "_n"))
        .groupBy("_tree", "_leaf")
        .agg(F.max("_back").alias("_depth"), F.sum("score").alias("_score"))
    )
    ranked = group_rank(branches, ["_tree"], [F.desc("_score"), F.col("_leaf")], "path_rank")
    if top is not None:
        ranked = ranked.where(F.col("path_rank") <= top)
    chosen = ranked.select(F.col("_tree").alias("_t"), F.col("_leaf").alias("_l"), "_depth", "path_rank")
    placed = found.join(chosen, _same(found, chosen, "_leaf", "_l")).select(
        "_tree", "_leaf", "_node", "path_rank", (F.col("_depth") - F.col("_back")).alias("position")
    )
    said = kept.select(F.col("_tree").alias("_t"), F.col("_node").alias("_n"), "role", "text")
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    learned = F.col("role") == LEARNED
    return placed.join(said, _same(placed, said, "_node", "_n")).select(
        F.col("_tree").alias(tree),
        F.col("_leaf").alias("leaf"),
        "path_rank",
        "position",
        "role",
        F.concat(head, body, F.lit(END + "\n")).alias("segment"),
        F.when(learned, F.char_length(head)).cast("bigint").alias("loss_start"),
        F.when(learned, F.char_length(body)).cast("bigint").alias("loss_length"),
    )


def conversations(segments: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row a path with its whole ``text`` and ``loss`` spans, for conversations that fit into a row."""
    parts = F.array_sort(F.collect_list(F.struct("position", "segment", "loss_start", "loss_length")))
    whole = segments.groupBy(*keys).agg(parts.alias("_parts"))
    start = F.aggregate(
        "_parts",
        F.expr("named_struct('at', 0L, 'spans', cast(array() as array<struct<start: bigint, length: bigint>>))"),
        lambda acc, x: F.struct(
            (acc["at"] + F.char_length(x["segment"])).alias("at"),
            F.when(x["loss_start"].isNull(), acc["spans"])
            .otherwise(
                F.concat(
                    acc["spans"],
                    F.array(F.struct((acc["at"] + x["loss_start"]).alias("start"), x["loss_length"].alias("length"))),
                )
            )
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.array_join(F.transform("_parts", lambda x: x["segment"]), "")
    return whole.select(*keys, text.alias("text"), start.alias("loss"))


def read_back(segments: DataFrame, keys: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """Parse formatted conversations: (keys, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).

    Pieces are read in order, one at a time, so memory does not grow with a conversation. ``turns_sha256`` is over
    role, line break, text, line break of each turn; the loss figures are over the unescaped masked text.
    """
    partitions = num_partitions or int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [*keys, "segment", "loss_start", "loss_length"]
    ordered = segments.repartition(partitions, *keys).sortWithinPartitions(*keys, "position").select(*columns)
    kinds = dict(ordered.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + (
        ", n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
    names = [*keys, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    class Reader:
        def __init__(self, key: tuple):
            self.key, self.turns, self.learned, self.chars = key, 0, 0, 0
            self.all, self.masked = hashlib.sha256(), hashlib.sha256()

        def take(self, segment: str, start: int | None, length: int | None) -> None:
            self.chars += len(segment)
            for role, text in _MESSAGE.findall(segment):
                self.turns += 1
                self.all.update(f"{unescaped_role(role)}\n{unescaped(text)}\n".encode())
            if start is not None:
                text = unescaped(segment[start : start + length])
                self.learned += len(text)
                self.masked.update(text.encode())

        def row(self) -> tuple:
            return (*self.key, self.turns, self.all.hexdigest(), self.learned, self.masked.hexdigest(), self.chars)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, kinds = None, None
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in range(len(keys))]
            done = []
            for *key, segment, start, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if reader is None or reader.key != tuple(key):
                    done += [reader.row()] if reader else []
                    reader = Reader(tuple(key))
                reader.take(segment, start, length)
            if done:
                yield rows(done, kinds)
        if reader:
            yield rows([reader.row()], kinds)

    def rows(done: list[tuple], kinds: list) -> pa.RecordBatch:
        types = [*kinds, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return ordered.mapInArrow(read, schema)
