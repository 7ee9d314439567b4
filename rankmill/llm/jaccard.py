"""Similarity join on word shingles by count vectors in R-trees.

A text's set of shingles is hashed into groups. Two views of the groups bring similar sets together:

* Cells. With more groups than two similar sets can have differences, some groups are equal in both. Sets that
  agree in the content of a group meet in its cell; no other pair can be similar. Each set enters the cells of its
  fullest groups only, which other texts that share a passage hardly agree in.
* Count vectors. The number of shingles in each of 64 groups is a point. The overlap of two sets is at most the
  sum over the groups of the smaller count, for a pair of points as for a point and a box of an R-tree.

All candidate pairs come from R-trees over points. An id that is the smallest of some cells queries trees of all the
others it meets there; once the links of those pairs are known, cells that they do not settle index their points and
are queried by each of their members. A pair whose bound is high enough is bounded once more, by counts in as many
groups as half its shingles, and what remains is verified on the sets.

A cell of more than BLOCK members is divided before its members meet. Its pivot is what most of a few members hold;
two similar members are either both so close to it that they are similar to the closest one, which queries them all, or
differ from it in a common shingle. So those that do meet again in a cell of that shingle. Where the smaller cells
have many more members to pair than the cell's blocks, the cell stays whole.

Points reach the trees as sorted rows, a group after the other: a task holds a batch of rows and one group.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankmill.llm.components import components
from rankmill.llm.words import mix, slices, words
from rankmill.operators.running import group_rank
from rankmill.sources.scratch import keep

GROUPS = 64
LEAF = 8
# One spare group for so many differences.
SPARE = 4
# Points of a cell in one block. Larger cells are divided, at most so many times; blocks of what is still larger are
# compared pair by pair.
BLOCK = 128
DIVISIONS = 6
# Cells that replace a large one may give so many times the rows to pair that its blocks give; theirs meet fewer others.
MORE = 4
# Members that a pivot is made of, at most.
PIVOT_SAMPLE = 15
# Pairs that a task gathers before it passes them on.
PAIRS = 1 << 16

_U = np.uint64


class Threshold:
    """Similar: den * |A and B| >= num * |A or B|. All in whole numbers."""

    def __init__(self, num: int, den: int):
        if not 0 < 2 * num >= den >= num:
            raise ValueError("the similarity must be from one half to one")
        self.num, self.den = num, den
        # Size bands, each up to 1.6 times as wide as the one before.
        edges = [1]
        while edges[-1] < 1 << 40:
            edges.append(max(edges[-1] + 1, int(edges[-1] * 1.6)))
        self.edges = np.array(edges, np.int64)
        # Differences between two similar sets of which the larger is in a band, and groups for more than those:
        # two similar sets have the same content in more groups than are spare.
        self.differences = 2 * (self.edges[1:] - 1) * (den - num) // (den + num)
        self.spare = (self.differences + SPARE - 1) // SPARE
        self.groups = np.where(self.differences > 0, self.differences + 1 + self.spare, 0)

    def need(self, total):
        """The overlap that two sets with ``total`` elements in sum must have to be similar."""
        return -(-total * self.num // (self.num + self.den))

    def bands(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last band whose cells a set of n enters: its own, to that of its largest partner."""
        first = np.searchsorted(self.edges, n, "right") - 1
        return first, np.searchsorted(self.edges, n * self.den // self.num, "right") - 1


def shingle_sets(part, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash), sorted and distinct: k-word shingles, or all words where there are fewer."""
    found = words(part, lower=True)
    text, hashes = [], []
    begins = found.windows(k)
    text.append(found.text[begins])
    hashes.append(found.window_hashes(k, begins))
    for few in range(1, k):
        begins = np.flatnonzero((found.position == 0) & (found.counts[found.text] == few))
        text.append(found.text[begins])
        hashes.append(found.window_hashes(few, begins))
    text, hashes = np.concatenate(text), np.concatenate(hashes)
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[new], hashes[new]


def _wrapped_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, _U)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _digests(hashes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """128 bits of each set."""
    return [_wrapped_sums(mix(hashes ^ _U(salt)), offsets).view(np.int64) for salt in (0x51A3, 0xC0FFEE77)]


def _cells(threshold: Threshold, text: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, cell): for each band entered, the fullest groups, named by band, group and the group's content.

    All sets order cells alike, by size and name, and leave out their lowest ``spare`` ones. Of more than ``spare``
    cells that two sets share, the highest is above that many in both, so both keep it.
    """
    first, last = threshold.bands(np.maximum(n, 1))
    content, place = mix(hashes ^ _U(0x7E57)), mix(hashes ^ _U(0x6709))
    out_text, out_cell = [], []
    for step in range(int((last - first).max(initial=0)) + 1):
        band = first + step
        groups = np.where((band <= last) & (n > 0), threshold.groups[band], 0)
        base = np.concatenate(([0], np.cumsum(groups)))
        inside = groups[text] > 0
        t = text[inside]
        # The high half of a hash times the number of groups, its own high half, is the group.
        group = ((place[inside] >> _U(32)) * groups[t].astype(_U) >> _U(32)).astype(np.int64)
        sums = np.zeros(base[-1], _U)
        np.add.at(sums, base[t] + group, content[inside])
        size = np.bincount(base[t] + group, minlength=base[-1])
        owner = np.repeat(np.arange(len(n)), groups)
        number = np.arange(base[-1]) - base[:-1][owner]
        name = mix((band[owner] << 40 | number).astype(_U))
        cell = mix(sums ^ name)
        order = np.lexsort((cell, size, owner))
        used = order[number >= threshold.spare[band][owner]]
        out_text.append(owner[used])
        out_cell.append(cell[used])
    return np.concatenate(out_text), np.concatenate(out_cell)


def _points(text: np.ndarray, hashes: np.ndarray, n: int) -> pa.Array:
    counts = np.bincount(text * GROUPS + (mix(hashes) >> _U(58)).astype(np.int64), minlength=n * GROUPS)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * GROUPS, pa.int32()), pa.array(counts, pa.int32()))


def _digester(k: int, names: list[str]):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                text, hashes = shingle_sets(part, k)
                offsets = np.searchsorted(text, np.arange(part.count + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, part.count),
                        pa.array(np.diff(offsets), pa.int64()),
                        *(pa.array(d) for d in _digests(hashes, offsets)),
                        _points(text, hashes, part.count),
                    ],
                    names=names,
                )

    return digest


def _signer(k: int, threshold: Threshold):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                text, hashes = shingle_sets(part, k)
                offsets = np.searchsorted(text, np.arange(part.count + 1))
                n = np.diff(offsets)
                owner, cell = _cells(threshold, text, hashes, n)
                order = np.argsort(owner, kind="stable")
                starts = np.searchsorted(owner[order], np.arange(part.count + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, part.count),
                        pa.array(n, pa.int64()),
                        *(pa.array(d) for d in _digests(hashes, offsets)),
                        pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(cell[order].view(np.int64))),
                    ],
                    names=["id", "n", "d1", "d2", "cells"],
                )

    return sign


def _setter(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                text, hashes = shingle_sets(part, k)
                offsets = np.searchsorted(text, np.arange(part.count + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, part.count),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.view(np.int64))),
                    ],
                    names=["id", "set"],
                )

    return sets


class RTree:
    """Boxes over points of whole counts, packed by falling extent; each level has the boxes of LEAF below."""

    def __init__(self, points: np.ndarray):
        order = np.arange(len(points))
        # Sort-tile: by size, then inside slabs by the group that varies most, and so on inside those.
        size = points.sum(axis=1)
        order = order[np.argsort(size, kind="stable")]
        for axis, width in zip(np.argsort(-points.var(axis=0))[:2], (LEAF * LEAF, LEAF), strict=True):
            for start in range(0, len(order), width * LEAF):
                slab = order[start : start + width * LEAF]
                order[start : start + width * LEAF] = slab[np.argsort(points[slab, axis], kind="stable")]
        self.order, self.levels = order, []
        high, low = points[order], size[order]
        while len(high) > 1:
            cuts = np.arange(0, len(high), LEAF)
            high, low = np.maximum.reduceat(high, cuts), np.minimum.reduceat(low, cuts)
            self.levels.append((high, low))
        self.points, self.size = points, size

    def near(self, point: np.ndarray, threshold: Threshold) -> np.ndarray:
        """Points whose bound on the overlap with ``point`` allows similarity."""
        n, here = point.sum(), np.zeros(1, np.int64)
        for high, low in reversed(self.levels):
            if len(high) > 1:
                here = (here[:, None] * LEAF + np.arange(LEAF)).ravel()
                here = here[here < len(high)]
            here = here[np.minimum(high[here], point).sum(axis=1) >= threshold.need(n + low[here])]
        if self.levels:
            here = (here[:, None] * LEAF + np.arange(LEAF)).ravel()
            here = here[here < len(self.order)]
        found = self.order[here]
        return found[np.minimum(self.points[found], point).sum(axis=1) >= threshold.need(n + self.size[found])]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The groups of rows that are equal in the first ``keys`` columns, of rows sorted by those."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = np.stack([batch.column(k).to_numpy() for k in range(keys)])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(start, end - start)
        held = batch.slice(cuts[-1])
    if held is not None:
        yield held


def _counts(points: pa.ListArray) -> np.ndarray:
    return points.flatten().to_numpy().reshape(-1, GROUPS).astype(np.int64)


def _prober(threshold: Threshold):
    """Pairs of a block pair that are in different components and whose bound is high enough.

    Rows are (cell, i, j, block, id, part, point), sorted: the points of blocks i and j, once if they are one.
    """

    def made(pairs: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, many = [], 0
        for group in _groups(batches, 3):
            i, j, block, ids, parts = (group.column(k).to_numpy() for k in range(1, 6))
            points, left, right = _counts(group.column(6)), block == i, block == j
            if not left.any():
                continue
            tree = RTree(points[left])
            for x, part, point in zip(ids[right], parts[right], points[right], strict=True):
                found = tree.near(point, threshold)
                found = ids[left][found[parts[left][found] != part]]
                if len(found):
                    pairs.append(np.stack([np.minimum(found, x), np.maximum(found, x)]))
                    many += len(found)
            if many >= PAIRS:
                yield made(pairs)
                pairs, many = [], 0
        if pairs:
            yield made(pairs)

    return probe


def _enough(both: Column, total: Column, threshold: Threshold) -> Column:
    """den * both >= num * (total - both), in whole numbers."""
    return both.cast("bigint") * (threshold.num + threshold.den) >= total.cast("bigint") * threshold.num


def _star_prober(threshold: Threshold):
    """Of an id's partners those that the tree of their points finds near its own point.

    Rows are (a, block, partner, b, shared, point), sorted: with the id's own point first, as no partner.
    """

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 2):
            own = int(np.searchsorted(group.column(2).to_numpy(), 1))
            if not 0 < own < group.num_rows:
                continue
            points = _counts(group.column(5))
            tree = RTree(points[own:])
            for point in points[:own]:
                found = tree.near(point, threshold)
                if len(found):
                    rows = pa.array(found + own)
                    yield pa.RecordBatch.from_arrays(
                        [group.column(k).take(rows) for k in (0, 3, 4)], names=["a", "b", "shared"]
                    )

    return probe


def _near(star: DataFrame, points: DataFrame, threshold: Threshold) -> DataFrame:
    """Pairs (a, b, shared) that R-trees over the points of each id's partners give for its own point.

    The partners of a hub are dealt to blocks of about BLOCK by hash, a tree each.
    """
    blocks = star.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
    dealt = star.join(blocks, "a").withColumn("_block", F.pmod(F.xxhash64("b"), F.col("_blocks")))
    partners = points.select(F.col("id").alias("b"), "point")
    others = dealt.join(partners, "b").select("a", "_block", F.lit(1).alias("_partner"), "b", "shared", "point")
    each = blocks.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)).alias("_block"))
    own = each.join(points.select(F.col("id").alias("a"), "point"), "a").select(
        "a", "_block", F.lit(0).alias("_partner"), F.col("a").alias("b"), F.lit(0).cast("bigint").alias("shared"), "point"
    )
    rows = others.union(own).repartition("a", "_block").sortWithinPartitions("a", "_block", "_partner")
    return rows.mapInArrow(_star_prober(threshold), "a bigint, b bigint, shared bigint")


def _finely(hashes: np.ndarray) -> bytes:
    """Counts in a power of two of groups, about two shingles in each; a byte per group, 255 standing for any more."""
    bits = max(6, (len(hashes) // 2).bit_length())
    group = (mix(hashes) >> _U(64 - bits)).astype(np.int64)
    return np.minimum(np.bincount(group, minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _allows(x: bytes, y: bytes, threshold: Threshold) -> bool:
    """Whether the sum of smaller counts allows similarity; of two resolutions the coarser is taken."""
    a, b = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (x, y))
    if max(a.max(), b.max()) == 255:
        return True
    total = int(a.sum() + b.sum())
    size = min(len(a), len(b))
    a, b = (v.reshape(size, -1).sum(axis=1) for v in (a, b))
    return int(np.minimum(a, b).sum()) >= threshold.need(total)


def _narrowed(pairs: DataFrame, rows: DataFrame, shingle: int, threshold: Threshold) -> DataFrame:
    """Pairs (a, b, ...) whose fine counts allow similarity; far fewer bytes move than sets have."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                text, hashes = shingle_sets(part, shingle)
                offsets = np.searchsorted(text, np.arange(part.count + 1))
                fine = [_finely(hashes[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(part.first, part.count), pa.array(fine, pa.binary())], names=["id", "fine"]
                )

    names = pairs.columns

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist()
            stay = [_allows(v, w, threshold) for v, w in zip(x, y, strict=True)]
            yield batch.filter(pa.array(stay, pa.bool_())).select(names)

    pairs = keep(pairs, "near")
    wanted = keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "wanted")
    fine = keep(rows.join(wanted, "id", "left_semi").mapInArrow(count, "id bigint, fine binary"), "fine")
    left = fine.select(F.col("id").alias("a"), F.col("fine").alias("_x"))
    right = fine.select(F.col("id").alias("b"), F.col("fine").alias("_y"))
    joined = pairs.join(right, "b").join(left, "a").select(*names, "_x", "_y")
    return joined.mapInArrow(judge, pairs.schema)


def _similar(pairs: DataFrame, sets: DataFrame, threshold: Threshold) -> DataFrame:
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    both, total = F.size(F.array_intersect("x", "y")), F.size("x") + F.size("y")
    joined = pairs.join(right, "b").join(left, "a").where(_enough(both, total, threshold))
    return keep(joined.select("a", "b").distinct(), "links")


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of which the links so far do not put both in one component."""
    left = found.select(F.col("node").alias("a"), F.col("component").alias("_ca"))
    right = found.select(F.col("node").alias("b"), F.col("component").alias("_cb"))
    joined = pairs.join(left, "a", "left").join(right, "b", "left")
    return joined.where(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select("a", "b")


def _with(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components with further links."""
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links))


def _unsettled(members: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cell, id, part) of all members, and (cell, _n) of cells of several components; of cells with the same members one."""
    part = found.select(F.col("node").alias("id"), F.col("component").alias("part"))
    known = members.join(part, "id", "left").select("cell", "id", F.coalesce("part", "id").alias("part"))
    known = keep(known.distinct(), "cells")
    xor, total = F.bit_xor(F.xxhash64("id")), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(38,0)"))
    cells = known.groupBy("cell").agg(
        F.count(F.lit(1)).alias("_n"), xor.alias("_x"), total.alias("_y"), F.min("part").alias("_f"), F.max("part").alias("_t")
    )
    once = cells.where("_f < _t").groupBy("_n", "_x", "_y").agg(F.min("cell").alias("cell"))
    return known, keep(once.select("cell", "_n"), "unsettled")


def _pivots(large: DataFrame, sets: DataFrame) -> DataFrame:
    """(cell, pivot): shingles that more than half of a few members of each cell hold, at most PIVOT_SAMPLE.

    Any pivot gives the same links; this one makes differences rare that members have in common.
    """
    few = large.groupBy("cell", F.pmod(F.xxhash64("id"), F.lit(PIVOT_SAMPLE)).alias("_deal")).agg(F.min("id").alias("id"))
    held = few.join(sets, "id").select("cell", F.explode("set").alias("shingle"))
    counts = held.groupBy("cell", "shingle").agg(F.count(F.lit(1)).alias("_held"))
    most = counts.join(few.groupBy("cell").agg(F.count(F.lit(1)).alias("_of")), "cell").where("2 * _held > _of")
    pivots = most.groupBy("cell").agg(F.sort_array(F.collect_list("shingle")).alias("pivot"))
    nothing = F.array().cast("array<bigint>")
    cells = large.select("cell").distinct()
    return cells.join(pivots, "cell", "left").select("cell", F.coalesce("pivot", nothing).alias("pivot"))


def _to_pair(members: Column) -> Column:
    """Rows that a cell gives to its pairs of blocks."""
    return members * F.ceil(members / BLOCK)


def _divided(
    large: DataFrame, rows: DataFrame, shingle: int, threshold: Threshold
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of (cell, id, part) of large cells: pairs (a, b, shared) to verify, (cell, id) of cells that replace them, and of those that stay.

    A cell stays if the cells that would replace it give MORE times the rows to pair that its own blocks give.

    Let d(x) be in how many shingles x differs from its cell's pivot. x and y of n(x) and n(y) shingles are similar when
    they differ in at most (n(x) + n(y)) * (den - num) / (den + num). With far(x) = (den + num) * d(x) - (den - num) * n(x):

    * If far(x) + far(y) <= 0, they are similar, and so is each with the member of least far.
    * Else similar ones have a difference from the pivot in common. All but n(x) * (den - num) / num of the differences
      of x are also differences of y, so in any order of shingles one of the first so many, and one more, is common.
    """
    num, den = threshold.num, threshold.den
    sets = _sets_of(rows, large.select("id").distinct(), shingle)
    pivots = keep(_pivots(large, sets).withColumn("_pivot", F.xxhash64("pivot")), "pivots")
    # Cells with the same pivot are one.
    held = keep(large.join(pivots.select("cell", "_pivot"), "cell").select("_pivot", "id", "part").distinct(), "held")
    sizes = held.groupBy("_pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("_blocks"))
    # A pivot meets its members in blocks, so that no task gets all of them.
    each = pivots.groupBy("_pivot").agg(F.min("pivot").alias("pivot")).join(sizes, "_pivot")
    each = each.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
    dealt = held.join(sizes, "_pivot").withColumn("_block", F.pmod(F.xxhash64("id"), F.col("_blocks"))).drop("_blocks")
    met = dealt.join(sets, "id").join(each, ["_pivot", "_block"])
    size = F.size("set").cast("bigint")
    # Shingles that the pivot lacks come first: few members have the same ones.
    named = (F.transform(F.array_except(*x), lambda x: F.xxhash64("_pivot", x)) for x in (("set", "pivot"), ("pivot", "set")))
    met = met.withColumn("_other", F.concat(*map(F.sort_array, named)))
    far = (den + num) * F.size("_other").cast("bigint") - (den - num) * size
    first = F.slice("_other", F.lit(1), (F.floor(size * (den - num) / num) + 1).cast("int"))
    met = keep(met.select("_pivot", "_block", "id", "part", far.alias("_far"), first.alias("_first")), "differences")
    nearest = met.groupBy("_pivot").agg(F.min(F.struct("_far", "id", "part")).alias("_least")).join(sizes, "_pivot")
    nearest = nearest.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks") - 1)))
    joined = met.join(nearest.select("_pivot", "_block", "_least"), ["_pivot", "_block"])
    joined = joined.where("_far + _least._far <= 0 and part <> _least.part")
    star = joined.select(F.col("_least.id").alias("a"), F.col("id").alias("b"), F.lit(1).cast("bigint").alias("shared"))
    entries = met.select("_pivot", F.explode("_first").alias("cell"), "id", "part")
    replaced = large.groupBy("cell").agg(F.count(F.lit(1)).alias("_n")).join(pivots.select("cell", "_pivot"), "cell")
    before = replaced.groupBy("_pivot").agg(F.sum(_to_pair(F.col("_n"))).alias("_before"))
    open_ = entries.groupBy("_pivot", "cell").agg(
        F.count(F.lit(1)).alias("_n"), F.min("part").alias("_f"), F.max("part").alias("_t")
    )
    after = open_.where("_f < _t").groupBy("_pivot").agg(F.sum(_to_pair(F.col("_n"))).alias("_after"))
    worth = keep(before.join(after, "_pivot", "left").where(f"coalesce(_after, 0) < {MORE} * _before").select("_pivot"), "worth")
    smaller = entries.join(worth, "_pivot", "left_semi").select("cell", "id")
    stay = pivots.join(worth, "_pivot", "left_anti").select("cell")
    return keep(star.distinct(), "star"), smaller, large.join(stay, "cell").select("cell", "id")


def _open_pairs(known: DataFrame, unsettled: DataFrame, points: DataFrame, threshold: Threshold) -> DataFrame:
    """Candidate pairs of the members of unsettled cells, those of a large one block by block."""
    rows = known.join(unsettled.select("cell"), "cell")
    ranked = group_rank(rows, ["cell"], [F.col("part"), F.col("id")], "_rank")
    placed = keep(ranked.withColumn("_block", F.floor((F.col("_rank") - 1) / BLOCK)), "blocks")
    # Pairs of blocks of a cell, a block with itself too, unless both lie in one component as a whole.
    spans = placed.groupBy("cell", "_block").agg(F.min("part").alias("_from"), F.max("part").alias("_to"))
    left = spans.select("cell", F.col("_block").alias("i"), F.col("_from").alias("_f"), F.col("_to").alias("_t"))
    right = spans.select("cell", F.col("_block").alias("j"), "_from", "_to")
    mixed = F.least("_f", "_from") < F.greatest("_t", "_to")
    wanted = left.join(right, "cell").where((F.col("i") <= F.col("j")) & mixed).select(
        "cell", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("_block")
    )
    # Bounded: at most BLOCK points a block.
    blocks = placed.join(wanted, ["cell", "_block"]).join(points, "id").select("cell", "i", "j", "_block", "id", "part", "point")
    blocks = blocks.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
    return blocks.mapInArrow(_prober(threshold), "a bigint, b bigint").distinct()


def _sets_of(rows: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """The sets of the given ids, from their texts."""
    wanted = keep(ids, "wanted")
    return keep(rows.join(wanted, "id", "left_semi").mapInArrow(_setter(shingle), "id bigint, set array<bigint>"), "sets")


def _sets(rows: DataFrame, pairs: DataFrame, shingle: int) -> DataFrame:
    """The sets of the ids in ``pairs``."""
    return _sets_of(rows, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), shingle)


def near_duplicates(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    similarity: tuple[int, int] = (80, 100),
) -> DataFrame:
    """(id, n_shingles, component_id) for each row: components of texts linked by similar shingle sets.

    Words are runs of other than ASCII blanks, A-Z lower-cased. A set has the distinct shingles of ``shingle``
    words; fewer words are one shingle. Sets link when their Jaccard similarity reaches ``similarity`` exactly,
    given as a fraction. ``component_id`` is the smallest whole-number id that links reach, itself included.

    Null and empty texts have no shingles and link with nothing. Equal sets are one class: they are linked
    through their smallest id and never paired. Rows that share an id are one document, linked where any of them
    is. A row with a null id gets its class's component, null if it has no other row. Other columns are not read.

    Every link between classes is found or implied: a pair in one cell is verified, or both sides are known to be
    in one component, or the bound excludes it, or the pair meets in a smaller cell. Classes and hubs are reduced by partial aggregates or joins with
    a side that is unique in the key. A cell is read in order by one task, which keeps one id of it.
    """
    threshold = Threshold(*similarity)
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    digests = ["id", "n", "d1", "d2", "point"]
    digested = keep(
        rows.mapInArrow(_digester(shingle, digests), "id bigint, n bigint, d1 bigint, d2 bigint, point array<int>"),
        "digests",
    )
    signed = rows.where("id is not null").mapInArrow(
        _signer(shingle, threshold), "id bigint, n bigint, d1 bigint, d2 bigint, cells array<bigint>"
    )
    classes = signed.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("id"), F.first("cells").alias("cells"))
    entries = classes.select("id", F.explode("cells").alias("cell"))
    # Runs through a cell in order of id and holds one value: a large cell takes time, not memory.
    inside = Window.partitionBy("cell").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    members = keep(entries.withColumn("_first", F.first("id").over(inside)).where("id > _first"), "members")
    points = digested.select("id", "point").where("id is not null")
    star = members.groupBy(F.col("_first").alias("a"), F.col("id").alias("b")).agg(F.count(F.lit(1)).alias("shared"))
    # An id has at most one pair a cell.
    of_id = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("shared"), "a"))
    near = _narrowed(_near(star, points, threshold), rows, shingle, threshold)
    pairs = keep(near.withColumn("_rank", of_id), "pairs")
    sets = _sets(rows, pairs, shingle)
    # Most copies are linked with the id they share most cells with. So that pair of an id is verified first, and
    # of the others only those that these links leave apart.
    links = _similar(pairs.where("_rank = 1").select("a", "b"), sets, threshold)
    found = keep(components(links), "components")
    apart = keep(_apart(pairs.where("_rank > 1").select("a", "b"), found), "apart")
    if not apart.isEmpty():
        found = keep(_with(found, _similar(apart, sets, threshold)), "components")
    known, unsettled = _unsettled(members.select("cell", "id"), found)
    whole = []
    for _ in range(DIVISIONS):
        if unsettled.where(F.col("_n") > BLOCK).isEmpty():
            break
        large = keep(known.join(unsettled.where(F.col("_n") > BLOCK).select("cell"), "cell"), "large")
        star, smaller, stay = _divided(large, rows, shingle, threshold)
        whole.append(keep(stay, "whole"))
        if not star.isEmpty():
            near = keep(_narrowed(_near(star, points, threshold), rows, shingle, threshold).select("a", "b"), "pairs")
            found = keep(_with(found, _similar(near, _sets(rows, near, shingle), threshold)), "components")
        small = known.join(unsettled.where(F.col("_n") <= BLOCK).select("cell"), "cell").select("cell", "id")
        known, unsettled = _unsettled(small.union(smaller), found)
    if any(not stay.isEmpty() for stay in whole):
        rest = known.join(unsettled.select("cell"), "cell").select("cell", "id")
        known, unsettled = _unsettled(functools.reduce(DataFrame.union, whole, rest), found)
    opened = _open_pairs(known, unsettled, points, threshold)
    opened = keep(_narrowed(opened, rows, shingle, threshold), "open")
    more = _similar(opened, _sets(rows, opened, shingle), threshold)
    whole = _with(found, more) if not more.isEmpty() else found
    named = digested.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("id").alias("node"))
    named = named.join(whole, "node", "left").select("n", "d1", "d2", F.coalesce("component", "node").alias("component_id"))
    own = digested.select("id", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return own.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
