"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Texts are normalised to words with single blanks between them. A document is scanned once; where something is
found, its words are mapped back to the original text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.frames import whole_rows, with_id
from rankmill.sources.scratch import keep

WINDOW = 10
# Characters of distinct windows in one automaton, which bounds a Python worker's memory; a larger benchmark is
# cut to several automata, and each scans every text.
BLOCK_CHARS = 4 << 20
# Automata that one reading of the documents goes through; a larger benchmark takes several readings.
BLOCKS_A_PASS = 8

# Bytes to normalised bytes: a-z, 0-9 and all bytes of other characters stay, A-Z is lowered, the rest is blank.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_SEPARATOR = np.array([c == 32 for c in _NORMAL])


def normal_words(text: str | None) -> list[bytes]:
    """The words of a text: A-Z lower-cased, cut at every ASCII character that is no letter or digit."""
    return (text or "").encode().translate(_NORMAL).split()


@dataclass
class Block:
    """Part of the benchmark: each distinct window with the items that have it."""

    windows: dict[str, list] = field(default_factory=dict)
    number: int = 0

    def automaton(self) -> tuple[ahocorasick.Automaton, list[list], np.ndarray]:
        found = ahocorasick.Automaton()
        items = list(self.windows.values())
        lengths = np.array([w.count(" ") - 1 for w in self.windows])
        for i, window in enumerate(self.windows):
            found.add_word(window, i)
        found.make_automaton()
        return found, items, lengths


def item_windows(text: str | None, window: int = WINDOW) -> list[str]:
    """Every window of an item, blanks around each word; a shorter item is one window, one without words none."""
    found = [w.decode() for w in normal_words(text)]
    last = max(1, len(found) - window + 1) if found else 0
    return [f" {' '.join(found[i : i + window])} " for i in range(last)]


def benchmark_blocks(items: Iterator, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> Iterator[Block]:
    """Blocks of bounded size from (item id, text) rows; an item's windows may be in several."""
    block, size = Block(), 0
    for item, text in items:
        for w in item_windows(text, window):
            if size + len(w) > block_chars and block.windows:
                yield block
                block, size = Block(), 0
            size += 0 if w in block.windows else len(w)
            ids = block.windows.setdefault(w, [])
            if item is not None and item not in ids[-1:]:
                ids.append(item)
    if block.windows:
        yield block


# The automaton of the block that this Python worker used last.
_READY: dict[int, tuple] = {}


def _automaton(block: Block) -> tuple:
    if block.number not in _READY or _READY[block.number][0] != block.windows:
        _READY.clear()
        _READY[block.number] = (block.windows, *block.automaton())
    return _READY[block.number][1:]


def _merge(ranges: list, hits: list, normal: str, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Disjoint ranges of word numbers, end excluded, of matches and of what was found before."""
    # The blank that ends a match has as many blanks before it as there are words up to it.
    blank = np.cumsum(np.frombuffer(normal.encode("utf-32-le"), np.uint32) == 32) - 1
    ends = blank[[end for end, _ in hits]]
    edge = np.zeros(int(blank[-1]) + 1, np.int64)
    np.add.at(edge, ends - lengths[[i for _, i in hits]], 1)
    np.add.at(edge, ends, -1)
    for r in ranges:
        edge[r["first"]] += 1
        edge[r["last"]] -= 1
    inside = np.diff(np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8), [0])))
    return list(zip(np.flatnonzero(inside == 1).tolist(), np.flatnonzero(inside == -1).tolist(), strict=True))


def _scanner(block: Block):
    """Adds to (id, text, ranges, items) what one automaton finds."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, items, lengths = _automaton(block)
        for batch in batches:
            ranges, found = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, text in enumerate(batch.column(1)):
                normal = f" {b' '.join(normal_words(text.as_py())).decode()} "
                if hits := list(automaton.iter(normal)):
                    ranges[i] = [{"first": a, "last": b} for a, b in _merge(ranges[i], hits, normal, lengths)]
                    found[i] = sorted({*found[i], *(item for _, w in hits for item in items[w])})
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(ranges, batch.schema.field(2).type),
                    pa.array(found, batch.schema.field(3).type),
                ],
                names=batch.schema.names,
            )

    return scan


def _spans(text: str, ranges: list[dict]) -> list[dict]:
    """The code points from the first to the last word of each range in the original text."""
    data = np.frombuffer(text.encode(), np.uint8)
    inside = np.concatenate(([False], ~_SEPARATOR[data], [False]))
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return [{"start": int(chars[starts[r["first"]]]), "end": int(chars[ends[r["last"] - 1]])} for r in ranges]


def _reporter(names: list[str]):
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            ranges = batch.column(2).to_pylist()
            texts = [t.as_py() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(normal_words(t)) for t in texts], pa.int64()),
                    pa.array([sum(r["last"] - r["first"] for r in x) for x in ranges], pa.int64()),
                    batch.column(3),
                    pa.array([_spans(t, r) if r else [] for t, r in zip(texts, ranges, strict=True)], span),
                ],
                names=names,
            )

    return report


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_cols: tuple[str, ...] = ("text",),
    window: int = WINDOW,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Where benchmark text occurs in documents: (id, n_words, n_hit, items, spans), a row for each row given.

    A window is ``window`` consecutive words of one of the item's texts (question, answer); a text of fewer
    words, but not none, is one window. ``n_hit`` counts the document's words inside any occurrence of any
    window, ``items`` has the ids of items with an occurring window, ``spans`` the stretches of hit words as code
    point offsets of the original text.

    Null and empty texts have no words. Repeated rows are answered alike; an item whose id is null counts for
    hits but is not listed; repeated ids are one item. An empty benchmark hits nothing. Other columns of either
    table are not read. No row is shuffled; a very long text is scanned whole. The benchmark goes through the driver
    in blocks of ``block_chars``, one automaton each, and never as a whole: after ``BLOCKS_A_PASS`` of them what was
    found is written and read again, so a benchmark of any size has an answer in as many passes as it needs.
    """
    item_type = dict(benchmark.dtypes)[item_col]
    rows = (
        (row[0], text)
        for row in benchmark.select(item_col, *item_text_cols).toLocalIterator()
        for text in row[1:]
    )
    scanned = documents.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.expr("cast(array() as array<struct<first: bigint, last: bigint>>)").alias("_ranges"),
        F.expr(f"cast(array() as array<{item_type}>)").alias("_items"),
    )
    schema = scanned.schema
    report = _reporter([id_col, "n_words", "n_hit", "items", "spans"])
    last = None
    for number, block in enumerate(benchmark_blocks(rows, window, block_chars)):
        if last is not None:
            scanned = scanned.mapInArrow(_scanner(last), schema)
        if number and number % BLOCKS_A_PASS == 0:
            scanned = keep(scanned, "scanned")
        block.number = number
        last = block
    # The last automaton's worker reports, too.
    scan = (lambda batches: batches) if last is None else _scanner(last)
    return scanned.mapInArrow(
        lambda batches: report(scan(batches)),
        with_id(
            documents,
            id_col,
            f"n_words bigint, n_hit bigint, items array<{item_type}>, spans array<struct<start: bigint, end: bigint>>",
        ),
    )


def clean_rows(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows without any hit, unchanged."""
    return whole_rows(
        documents, text_col, lambda rows, i, t: contamination(rows, benchmark, i, t, **options), "n_hit = 0"
    )
