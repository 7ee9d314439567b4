"""Packing token sequences by minimum bin slack.

Documents are cut to pieces of at most one window. The number of pieces of each length (at most one count per
length) is all the planning sees: again and again a subset-sum over the remaining lengths, as a bitset, finds the
multiset that fills a window closest to capacity; it is used as often as its lengths last. Pieces are then numbered
inside their length, and the number decides sequence and offset.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankmill.llm.frames import with_id
from rankmill.operators.running import group_rank
from rankmill.sources.scratch import keep

WINDOW = 1024
END = 0
# Blanks in one run that the rank file's pattern can take.
LONG_RUN = 1 << 16
_LONG_BLANKS = re.compile(rf"\s{{{LONG_RUN}}}")


class Tokenizer:
    """Byte-level BPE from a file of ranks; the ids equal those of the same vocabulary's JSON file.

    The strings of special tokens in a text give the special ids, as that file's reader does it. A text with a run
    of more than LONG_RUN blanks goes to that reader: the pattern of the rank file tries such a run from every end
    and has no room for longer ones. Nothing is cut inside a run, as merges reach across.
    """

    def __init__(self, ranks_path: str, pattern: str, special: Mapping[str, int], json_path: str):
        import tiktoken

        self._json_path = json_path

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding(
            "packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(special)
        )

    @functools.cached_property
    def _whole(self):
        """The JSON file's reader, loaded by the workers that meet such a text."""
        from tokenizers import Tokenizer as JsonTokenizer

        return JsonTokenizer.from_file(self._json_path)

    def ids(self, text: str) -> bytes:
        """The ids as little-endian 32-bit numbers."""
        if len(text) > LONG_RUN and _LONG_BLANKS.search(text):
            return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self._encoding.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


def public_tokenizer() -> Tokenizer:
    """The byte-level vocabulary of 50,257 ids from the folder of public tokenizers."""
    import public_tokenizers

    return Tokenizer(
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
        {"<|endoftext|>": 50256},
        public_tokenizers.path("byte_bpe_50k.json"),
    )


# The tokenizer of this Python worker, by the function that makes it.
_MADE: dict = {}


def _tokenizer(make) -> Tokenizer:
    if make not in _MADE:
        _MADE[make] = make()
    return _MADE[make]


def pieces(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    tokenizer=public_tokenizer,
    with_ids: bool = False,
) -> DataFrame:
    """Tokenise and cut: (id, start, length, ids_crc32, doc_tokens[, ids]), a row a piece.

    A document is its ids, then ``END``; a null or empty text is ``END`` alone, so every row gives a piece.
    Pieces are whole windows and one remainder. Repeated rows give repeated pieces, an empty table none. A very long
    text is encoded whole, whatever it is made of, and cut to as many pieces as it needs.
    """
    fields = [("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    ddl = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    if with_ids:
        fields, ddl = [*fields, ("ids", pa.list_(pa.int64()))], ddl + ", ids array<bigint>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(tokenizer).ids
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            source, rows = [], []
            for i, text in enumerate(batch.column(1)):
                ids = memoryview(encode(text.as_py() or "") + end)
                total = len(ids) // 4
                for start in range(0, total, window):
                    part = ids[start * 4 : (start + window) * 4]
                    row = [start, len(part) // 4, zlib.crc32(part), total]
                    rows.append([*row, np.frombuffer(part, "<u4").astype(np.int64)] if with_ids else row)
                    source.append(i)
            columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(source, pa.int64())),
                    *(pa.array(list(c), kind) for c, (_, kind) in zip(columns, fields, strict=True)),
                ],
                names=[id_col, *(name for name, _ in fields)],
            )

    return documents.select(id_col, text_col).mapInArrow(cut, with_id(documents, id_col, ddl))


def fill(counts: Mapping[int, int], capacity: int) -> dict[int, int]:
    """How many of each length come closest to ``capacity`` from below; longer ones are preferred."""
    reached, steps = 1, []
    mask = (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, size = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(size, left)
            steps.append((length, take, reached))
            reached |= (reached << (length * take)) & mask
            left, size = left - take, size * 2
        if reached >> capacity & 1:
            break
    target, found = reached.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> target & 1:
            target -= length * take
            found[length] = found.get(length, 0) + take
    return found


def plan(counts: Mapping[int, int], window: int = WINDOW) -> list[tuple[int, dict[int, int]]]:
    """(repeats, pieces of each length in one sequence) until nothing remains.

    Each sequence takes the longest piece left, and the best filling of the rest of its window.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    patterns = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        need = fill({k: n for k, n in rest.items() if n and k <= window - longest}, window - longest)
        need[longest] = need.get(longest, 0) + 1
        repeats = min(left[k] // n for k, n in need.items())
        patterns.append((repeats, need))
        for k, n in need.items():
            left[k] -= n * repeats
            if not left[k]:
                del left[k]
    return patterns


def _placements(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length, rows (first rank, pieces a sequence, first sequence, first offset), ranks rising from 0."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    sequence = 0
    for repeats, need in patterns:
        offset = 0
        for length in sorted(need, reverse=True):
            rows.setdefault(length, []).append((used.get(length, 0), need[length], sequence, offset))
            used[length] = used.get(length, 0) + repeats * need[length]
            offset += length * need[length]
        sequence += repeats
    return {length: np.array(r, np.int64) for length, r in rows.items()}


def pack(cut: DataFrame, window: int = WINDOW, num_partitions: int | None = None) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces with a ``length`` from 1 to ``window``.

    Every piece lies in one sequence; a sequence holds at most ``window`` tokens without gaps from 0 on. Other
    columns are kept (ids, if they are to be assembled); equal pieces are placed in any order; no piece gives no
    sequence. Only one count a length reaches the driver. A hot length is numbered over several tasks.
    """
    kept = keep(cut.drop("sequence_id", "offset"), "pieces")
    # Bounded: one row a length, at most ``window``.
    counts = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 0 < length <= window for length in counts):
        raise ValueError(f"piece lengths must be from 1 to {window}")
    places = _placements(plan(counts, window))
    keys = [c for c in kept.columns if c not in ("length", "ids")]
    ranked = group_rank(kept, ["length"], [F.col(c) for c in keys], "_rank", num_partitions)
    names = ranked.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            ranks = batch.column(names.index("_rank")).to_numpy(zero_copy_only=False) - 1
            sequences, offsets = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
            for length in np.unique(lengths):
                here = np.flatnonzero(lengths == length)
                table = places[int(length)]
                at = table[np.searchsorted(table[:, 0], ranks[here], "right") - 1]
                inside = ranks[here] - at[:, 0]
                sequences[here] = at[:, 2] + inside // at[:, 1]
                offsets[here] = at[:, 3] + inside % at[:, 1] * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequences), pa.array(offsets)],
                names=[*names[:-1], "sequence_id", "offset"],
            )

    placed = T.StructType.fromDDL("sequence_id bigint, offset bigint")
    return ranked.mapInArrow(place, T.StructType([*ranked.schema.fields[:-1], *placed.fields]))


def sequences(packed: DataFrame, window: int = WINDOW, padding: int = END) -> DataFrame:
    """(sequence_id, input_ids, n_tokens) of packed pieces with their ``ids``.

    Padded to the window, except where the tokens are a power of two already.
    """
    # Bounded: a sequence holds at most ``window`` pieces.
    joined = packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids")
    )
    size = F.size("ids")
    missing = F.when(F.bit_count(size) == 1, 0).otherwise(F.lit(window) - size)
    padded = F.concat("ids", F.array_repeat(F.lit(padding).cast("bigint"), missing))
    return joined.select("sequence_id", padded.alias("input_ids"), size.cast("bigint").alias("n_tokens"))
