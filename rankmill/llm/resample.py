"""Importance resampling towards a target distribution.

Hashed n-grams are counted over all documents and over the target's texts. A bucket's gain is the logarithm of the ratio
of its smoothed shares, a document's weight the mean gain of its n-grams, looked up in an array. Gumbel noise makes the
highest scores a draw without replacement. The cutoff comes from weighted medians of medians: blocks of keys give
their median and size, the median of these by weight discards at least a quarter of what remains, until it is
the key looked for. Only winners are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmill.llm.frames import with_id
from rankmill.llm.words import LOWER, Texts, slices, sums, words
from rankmill.operators.running import number_rows
from rankmill.sources.scratch import keep

BUCKETS = 10_000
# Keys of which one median is taken; bounds a task's memory and what reaches the driver.
BLOCK_KEYS = 1 << 20

# Bytes that end a word once A-Z are lower-cased: all of ASCII but digits and letters.
_BREAK = np.ones(256, bool)
_BREAK[0x30:0x3A] = _BREAK[0x61:0x7B] = _BREAK[0x80:] = False

# Words of more bytes are hashed one by one.
_LONG = 128
_ONES = np.uint32(0xFFFFFFFF)


def _crc_table() -> np.ndarray:
    """The 256 remainders of the reflected polynomial of CRC-32."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_CRC = _crc_table()


def _advance(states: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 states after the bytes of each span; byte j of all spans at once, longest spans first."""
    lengths = ends - starts
    order = np.argsort(-lengths, kind="stable")
    out, at, lengths = states[order], starts[order], lengths[order]
    n_long = int(np.searchsorted(-lengths, -_LONG, "left"))
    for i in range(n_long):
        part = data[at[i] : at[i] + lengths[i]].tobytes()
        out[i] = zlib.crc32(part, int(out[i] ^ _ONES)) ^ 0xFFFFFFFF
    out_rest, at, lengths = out[n_long:], at[n_long:], lengths[n_long:]
    for j in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -j, "left"))
        state = out_rest[:n]
        out_rest[:n] = _CRC[(state ^ data[at[:n] + j]) & np.uint32(0xFF)] ^ (state >> np.uint32(8))
    back = np.empty_like(out)
    back[order] = out
    return back


def _blank(states: np.ndarray) -> np.ndarray:
    return _CRC[(states ^ np.uint32(0x20)) & np.uint32(0xFF)] ^ (states >> np.uint32(8))


def features(texts: Texts, ngram: int, buckets: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for each length of n-gram the text and the bucket of every occurrence."""
    found = words(texts, lower=True, other=_BREAK)
    data = LOWER[texts.data]
    begins = np.arange(len(found.starts))
    states = _advance(np.full(len(begins), _ONES), data, found.starts, found.ends)
    out = []
    for n in range(1, ngram + 1):
        if n > 1:
            inside = found.position[begins] + n <= found.counts[found.text[begins]]
            begins, states = begins[inside], _blank(states[inside])
            last = begins + n - 1
            states = _advance(states, data, found.starts[last], found.ends[last])
        out.append((found.text[begins], ((states ^ _ONES) % np.uint32(buckets)).astype(np.int64)))
    return found.counts, out


def bucket_counts(df: DataFrame, text_col: str = "text", ngram: int = 2, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): occurrences of n-grams in all texts. A task adds up an array; buckets without any are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for texts in slices(batch.column(0)):
                for _, bucket in features(texts, ngram, buckets)[1]:
                    total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used])], names=["bucket", "n"])

    counted = df.select(text_col).mapInArrow(count, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def _array(counts: DataFrame, buckets: int) -> np.ndarray:
    """Counts as an array; at most one row a bucket reaches the driver."""
    out = np.zeros(buckets, np.int64)
    for row in counts.collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(target: Sequence[int], source: Sequence[int]) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, for each bucket."""
    size = float(len(source))
    of_target, of_source = float(sum(map(int, target))) + size, float(sum(map(int, source))) + size
    return np.array(
        [
            math.floor(1000 * math.log((float(t) + 1) * of_source / ((float(s) + 1) * of_target)))
            for t, s in zip(target, source, strict=True)
        ],
        np.int64,
    )


def weigh(
    documents: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", ngram: int = 2
) -> DataFrame:
    """(id, n_words, n_features, weight): the mean gain of a text's n-grams, rounded down; 0 without any."""
    buckets = len(gains)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[], [], []]
            for texts in slices(batch.column(1)):
                counts, grams = features(texts, ngram, buckets)
                n, total = np.zeros(texts.count, np.int64), np.zeros(texts.count, np.int64)
                for text, bucket in grams:
                    edges = np.searchsorted(text, np.arange(texts.count + 1))
                    n += np.diff(edges)
                    total += sums(gains[bucket], edges)
                for column, values in zip(columns, (counts, n, total // np.maximum(n, 1)), strict=True):
                    column.append(values)
            joined = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in joined)],
                names=[id_col, "n_words", "n_features", "weight"],
            )

    schema = with_id(documents, id_col, "n_words bigint, n_features bigint, weight bigint")
    return documents.select(id_col, text_col).mapInArrow(judge, schema)


def noise(key: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variable, rounded down, from a digest of seed and key; a null key counts as empty."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(F.encode(text, "UTF-8"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


Key = tuple[int, ...]


def _before(keys: np.ndarray, bound: Key) -> tuple[np.ndarray, np.ndarray]:
    """Which columns of ``keys`` sort before the bound, and which equal it."""
    less, equal = np.zeros(keys.shape[1], bool), np.ones(keys.shape[1], bool)
    for row, value in zip(keys, bound, strict=True):
        less |= equal & (row < value)
        equal &= row == value
    return less, equal


def _median(keys: np.ndarray) -> Key | None:
    if not keys.shape[1]:
        return None
    middle = np.lexsort(keys[::-1])[(keys.shape[1] - 1) // 2]
    return tuple(int(v) for v in keys[:, middle])


def _survey(keys: DataFrame, low: Key | None, high: Key | None, pivot: Key | None, block: int) -> list:
    """Of each block: what remains before the pivot, at it and after it, with the medians of both sides.

    One row a block reaches the driver. Without a pivot all that remains counts as before it.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(parts: list[np.ndarray]) -> list:
            held = np.concatenate(parts, axis=1)
            if pivot is None:
                return [held.shape[1], _median(held), 0, 0, None]
            less, equal = _before(held, pivot)
            below, above = held[:, less], held[:, ~less & ~equal]
            return [below.shape[1], _median(below), int(equal.sum()), above.shape[1], _median(above)]

        def emit(parts: list[np.ndarray]) -> pa.RecordBatch:
            key = pa.list_(pa.int64())
            kinds = [pa.int64(), key, pa.int64(), pa.int64(), key]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], kind) for v, kind in zip(row(parts), kinds, strict=True)],
                names=["n_before", "before", "n_equal", "n_after", "after"],
            )

        parts, size = [], 0
        for batch in batches:
            held = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            stay = np.ones(held.shape[1], bool)
            if low is not None:
                less, equal = _before(held, low)
                stay &= ~less & ~equal
            if high is not None:
                stay &= _before(held, high)[0]
            parts.append(held[:, stay])
            size += parts[-1].shape[1]
            if size >= block:
                yield emit(parts)
                parts, size = [], 0
        if size:
            yield emit(parts)

    schema = "n_before bigint, before array<bigint>, n_equal bigint, n_after bigint, after array<bigint>"
    return keys.mapInArrow(look, schema).collect()


def _weighted_median(medians: list[tuple[Key, int]]) -> Key:
    """The median that has at least half of all weight at or before it."""
    half, seen = sum(n for _, n in medians) / 2, 0
    for key, n in sorted(medians):
        seen += n
        if seen >= half:
            break
    return key


def cutoff(keys: DataFrame, take: int, block: int = BLOCK_KEYS) -> tuple[Key, int, int] | None:
    """The ``take``-th smallest row of integer columns, compared from left to right.

    Returns it with the number of rows before it and of rows equal to it; None if there are not so many rows. Every
    round discards at least a quarter of the remaining keys, so rounds grow with the logarithm of the rows. Ties and
    repeated rows are counted, never gathered. Columns hold no nulls.
    """
    low = high = pivot = None
    before = 0
    found = _survey(keys, None, None, None, block)
    sides = [(tuple(r["before"]), r["n_before"]) for r in found if r["n_before"]]
    if not 0 < take <= sum(n for _, n in sides):
        return None
    while True:
        pivot = _weighted_median(sides)
        found = _survey(keys, low, high, pivot, block)
        n_before, n_equal = sum(r["n_before"] for r in found), sum(r["n_equal"] for r in found)
        if take <= before + n_before:
            high, side = pivot, "before"
        elif take <= before + n_before + n_equal:
            return pivot, before + n_before, n_equal
        else:
            low, side, before = pivot, "after", before + n_before + n_equal
        sides = [(tuple(r[side]), r[f"n_{side}"]) for r in found if r[f"n_{side}"]]


def resample(
    documents: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = 25,
    min_words: int = 20,
    seed: int = 7,
    ngram: int = 2,
    buckets: int = BUCKETS,
    block: int = BLOCK_KEYS,
    num_partitions: int | None = None,
) -> DataFrame:
    """(id, n_features, weight, score, rank), a row per document; documents not drawn have no rank.

    Of the documents with at least ``min_words`` words the ``percent`` of highest score are drawn, rounded down; ties
    go to the smaller id, a null id last. Of rows equal in id, score and ``n_features`` any may be drawn. Ids must be
    integers. A null or empty text has no words, weight 0 and only the noise as score; without target texts all gains
    are about 0. Very long texts are counted and weighed whole, in a slice of their own. An empty table gives no rows.
    Other columns are not read, whatever their names.
    """
    gains = bucket_gains(
        _array(bucket_counts(target, text_col, ngram, buckets), buckets),
        _array(bucket_counts(documents, text_col, ngram, buckets), buckets),
    )
    weighed = weigh(documents, gains, id_col, text_col, ngram)
    order = [-F.col("score"), F.col(id_col).isNull().cast("bigint"), F.coalesce(F.col(id_col), F.lit(0)).cast("bigint")]
    order.append(F.col("n_features"))
    scored = keep(
        weighed.withColumn("score", F.col("weight") + noise(F.col(id_col), seed)).withColumn(
            "_in", F.col("n_words") >= min_words
        ),
        "scored",
    )
    columns = [id_col, "n_features", "weight", "score"]
    eligible = scored.where("_in")
    take = percent * eligible.count() // 100
    keys = keep(eligible.select(*(c.alias(f"k{i}") for i, c in enumerate(order))), "keys")
    last = cutoff(keys, take, block)
    unranked = F.lit(None).cast("bigint").alias("rank")
    if last is None:
        return scored.select(*columns, unranked)

    key, n_before, n_equal = last
    place, bound = F.struct(*order), F.struct(*(F.lit(v).cast("bigint") for v in key))
    first = F.col("_in") & (place < bound)
    tied = F.col("_in") & (place == bound)
    winners = number_rows(scored.where(first).select(*columns), order, "rank", num_partitions)
    others = scored.where(~first & ~tied).select(*columns, unranked)
    # Rows at the cutoff are equal in every column: one of them, as often as there are.
    copies = documents.sparkSession.range(n_equal)
    rank = F.when(F.col("id") < take - n_before, F.col("id") + n_before + 1)
    kind = documents.schema[id_col].dataType
    at_cutoff = copies.select(
        F.lit(None if key[1] else key[2]).cast(kind).alias(id_col),
        F.lit(key[3]).cast("bigint").alias("n_features"),
        (F.lit(-key[0]).cast("bigint") - noise(F.lit(None if key[1] else key[2]).cast(kind), seed)).alias("weight"),
        F.lit(-key[0]).cast("bigint").alias("score"),
        rank.alias("rank"),
    )
    return winners.unionByName(others).unionByName(at_cutoff)
