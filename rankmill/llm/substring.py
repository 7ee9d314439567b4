"""Substring dedup with fixed-block anchors.

Reference blocks are the words 0-6, 7-13, ... of each document, without overlap. Any 13 words of it hold a whole
block, so a document that repeats them has that block among its rolling 7-word windows: every rolling window is
probed against the blocks. Hits are then extended: around each, the 13-word windows it can lie in are compared as
wholes over all documents, and overlapping repeats grow together to maximal ones.

Probes are packed: a shuffled row has thousands of them, four bytes of hash and two to four of position each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.words import covered, slices, words
from rankmill.sources.scratch import keep

WINDOW = 13


def _packed(part: np.ndarray, tag: np.ndarray, position: np.ndarray, owner: np.ndarray, ids: np.ndarray, kind: int):
    """A row for each part: its tags, positions, and runs of one document."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part, tag, position, owner = part[order], tag[order], position[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    wide = "<u4" if position.max() > 0xFFFF else "<u2"
    for a, b in zip(starts, np.append(starts[1:], len(part)), strict=True):
        if kind == 0:
            yield int(part[a]), 0, np.unique(tag[a:b]).tobytes(), b"", b"", b""
            continue
        run = np.flatnonzero(np.concatenate(([True], owner[a + 1 : b] != owner[a : b - 1])))
        yield (
            int(part[a]),
            1,
            tag[a:b].tobytes(),
            _steps(position[a:b].astype(wide)),
            ids[owner[a:b][run]].tobytes(),
            np.diff(np.append(run, b - a)).astype("<u4").tobytes(),
        )


def _steps(positions: np.ndarray) -> bytes:
    """Differences, all low bytes first: they are small, so the high bytes take next to nothing in a shuffle."""
    return np.diff(positions, prepend=positions.dtype.type(0)).view(np.uint8).reshape(len(positions), -1).T.tobytes()


def _places(steps: bytes, n: int) -> np.ndarray:
    wide = len(steps) // n
    planes = np.frombuffer(steps, np.uint8).reshape(wide, n).T.copy()
    return np.cumsum(planes.view(f"<u{wide}").ravel(), dtype=f"<u{wide}").astype(np.int64)


_PACKED = "part int, kind int, tags binary, positions binary, ids binary, runs binary"


def _prober(block: int, parts: int):
    names = ["part", "kind", "tags", "positions", "ids", "runs"]
    types = [pa.int32(), pa.int32(), *[pa.binary()] * 4]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            taken = []
            for texts in slices(batch.column(1)):
                found = words(texts)
                begins = found.windows(block)
                hashes = found.window_hashes(block, begins)
                taken.append(
                    (
                        ((hashes >> np.uint64(32)) % np.uint64(parts)).astype(np.uint32),
                        hashes.astype("<u4"),
                        found.position[begins].astype(np.uint32),
                        (found.text[begins] + texts.first).astype(np.uint32),
                    )
                )
            if not taken:
                continue
            part, tag, position, owner = (np.concatenate(x) for x in zip(*taken, strict=True))
            aligned = position % block == 0
            index = _packed(part[aligned], tag[aligned], position[aligned], owner[aligned], ids, 0)
            rows = [*index, *_packed(part, tag, position, owner, ids, 1)]
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return probe


class _Index:
    """Blocks of one part. Of each, the first probe is held back until there is a second."""

    def __init__(self, part: int):
        self.part, self.parts, self.tags = part, [], None

    def add(self, tags: bytes) -> None:
        self.parts.append(np.frombuffer(tags, "<u4"))

    def close(self) -> None:
        if self.tags is None:
            self.tags = np.unique(np.concatenate(self.parts)) if self.parts else np.zeros(0, "<u4")
            self.seen = np.zeros(len(self.tags), np.uint8)
            self.first_id, self.first_position = np.zeros(len(self.tags), np.int64), np.zeros(len(self.tags), np.int64)
            self.parts = []

    def hits(self, tags: np.ndarray, ids: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probes of blocks that are probed more than once, by this row or an earlier one."""
        self.close()
        if not len(self.tags):
            return ids[:0], positions[:0]
        at = np.minimum(np.searchsorted(self.tags, tags), len(self.tags) - 1)
        match = self.tags[at] == tags
        at, ids, positions = at[match], ids[match], positions[match]
        block, first, count = np.unique(at, return_index=True, return_counts=True)
        alone = (self.seen[block] == 0) & (count == 1)
        held = block[self.seen[block] == 1]
        out = np.isin(at, block[alone], invert=True)
        result = (
            np.concatenate((self.first_id[held], ids[out])),
            np.concatenate((self.first_position[held], positions[out])),
        )
        self.first_id[block[alone]], self.first_position[block[alone]] = ids[first[alone]], positions[first[alone]]
        self.seen[block] = np.where(alone, 1, 2)
        return result


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, position) of windows that hit a block; rows come sorted by part, blocks before probes."""
    index = None
    for batch in batches:
        ids, places = [], []
        for part, kind, tags, positions, owners, runs in zip(*batch.columns, strict=True):
            if index is None or index.part != part.as_py():
                index = _Index(part.as_py())
            if kind.as_py() == 0:
                index.add(tags.as_py())
                continue
            tags = np.frombuffer(tags.as_py(), "<u4")
            positions = _places(positions.as_py(), len(tags))
            owner = np.repeat(np.frombuffer(owners.as_py(), "<i8"), np.frombuffer(runs.as_py(), "<u4"))
            hit, place = index.hits(tags, owner, positions)
            ids.append(hit)
            places.append(place)
        if ids:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (ids, places)], names=["id", "position"]
            )


def _extender(window: int, block: int):
    """(window hash, id) of every window around a hit, once a text."""

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hits = batch.column(2)
            for texts in slices(batch.column(1)):
                found = words(texts)
                first = np.searchsorted(found.text, np.arange(texts.count))
                marks = np.zeros(len(found.starts), bool)
                for i in range(texts.count):
                    places = np.array(hits[texts.first + i].as_py(), np.int64)
                    # Rows that share an id share hits; those beyond a text's end are another row's.
                    marks[first[i] + places[places < found.counts[i]]] = True
                begins = found.windows(window)
                # A window begins up to so many words before a block that lies inside it.
                total = np.concatenate(([0], np.cumsum(marks)))
                begins = begins[total[np.minimum(begins + window - block + 1, len(marks))] > total[begins]]
                hashes = found.window_hashes(window, begins)
                ids = batch.column(0).to_numpy(zero_copy_only=False)[found.text[begins] + texts.first]
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ids)], names=["g", "id"])

    return extend


def _remover(window: int, names: list[str]):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            repeats = batch.column(2)
            for texts in slices(batch.column(1)):
                found = words(texts)
                begins = found.windows(window)
                hashes = found.window_hashes(window, begins).view(np.int64)
                bounds = np.searchsorted(found.text[begins], np.arange(texts.count + 1))
                bad = np.zeros(len(begins), bool)
                for i in range(texts.count):
                    if repeats[texts.first + i].is_valid:
                        mine = slice(bounds[i], bounds[i + 1])
                        bad[mine] = np.isin(hashes[mine], repeats[texts.first + i].values.to_numpy())
                gone = covered(begins[bad], window, len(found.starts))
                first = np.concatenate(([0], np.cumsum(found.counts)))
                data, kept, spans = texts.data.tobytes(), [], []
                for i in range(texts.count):
                    mine = slice(first[i], first[i + 1])
                    pieces = zip(found.starts[mine][~gone[mine]].tolist(), found.ends[mine][~gone[mine]].tolist(), strict=True)
                    kept.append(b" ".join(data[a:b] for a, b in pieces).decode())
                    edge = np.diff(np.concatenate(([0], gone[mine].astype(np.int8), [0])))
                    runs = zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)
                    spans.append([{"start": a, "end": b} for a, b in runs])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.first, texts.count),
                        pa.array(found.counts, pa.int64()),
                        pa.array(np.bincount(found.text[gone], minlength=texts.count), pa.int64()),
                        pa.array(kept, pa.string()),
                        pa.array(spans, span),
                    ],
                    names=names,
                )

    return remove


def repeated_windows(rows: DataFrame, window: int, num_partitions: int | None = None) -> DataFrame:
    """(id, repeats): hashes of the windows that also start in a smaller id, for ids that have any."""
    block = (window + 1) // 2
    parts = num_partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probes = rows.mapInArrow(_prober(block, parts), _PACKED)
    matched = (
        probes.repartition(parts, "part")
        .sortWithinPartitions("part", "kind")
        .mapInArrow(_match, "id bigint, position bigint")
    )
    # Bounded by the words of the document.
    hits = keep(matched.groupBy("id").agg(F.collect_list("position").alias("hits")), "hits")
    around = keep(
        rows.join(hits, "id").select("id", "text", "hits").mapInArrow(_extender(window, block), "g bigint, id bigint"),
        "windows",
    )
    shared = around.groupBy("g").agg(F.min("id").alias("_first"), F.max("id").alias("_last")).where("_first < _last")
    repeats = around.join(shared, "g").where("id > _first")
    return repeats.groupBy("id").agg(F.collect_set("g").alias("repeats"))


def remove_repeats(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """(id, n_words, n_removed, text, spans) for each row: repeats of text of smaller ids are taken out.

    Words are runs of other than ASCII blanks, unchanged. A word goes if it lies in ``window`` consecutive words
    whose sequence also starts in a document with a smaller whole-number id, as given, not as left over. ``text``
    has the other words joined by a space, ``spans`` the maximal removed runs as word numbers, end excluded.

    Null and empty texts have no words. Rows that share an id are one document, whose rows do not remove each
    other. A row with a null id is no reference and loses nothing. Windows are compared by 64-bit hashes. Other
    columns are not read; an empty table gives no rows.
    """
    rows = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    repeats = repeated_windows(rows.where("id is not null"), window)
    names = [id_col, "n_words", "n_removed", text_col, "spans"]
    return (
        rows.join(repeats, "id", "left")
        .select("id", "text", "repeats")
        .mapInArrow(
            _remover(window, names),
            f"`{id_col}` bigint, n_words bigint, n_removed bigint, `{text_col}` string, "
            "spans array<struct<start: bigint, end: bigint>>",
        )
    )
