"""Cross-entropy difference of two matched n-gram models, after Moore and Lewis.

A target and a background bigram model have one vocabulary, one set of bigrams and one smoothing; they differ in
their counts alone. A text scores the mean over its words of target loss minus background loss: low scores read
like the target. Counts cover every word and bigram of every document; what a document adds itself is left out
when it is scored.

No model is gathered. Documents are dealt to blocks by a hash. A block asks for its own distinct words and bigrams
in packed lists, one a bucket of hashes; each bucket sums the counts of all blocks and answers every block with
those of its list; a block is scored by its answers. So the lists grow with the input, a task's memory does not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.frames import with_id
from rankmill.llm.words import Words, group_sizes, mix, slices, words

# Weight of the unigram estimate in a context, and added count of each word of the vocabulary.
CONTEXT = 5.0
ADDED = 0.5
# Words of a block (smaller ones, down to LEAST_WORDS, give a small table tasks enough), and entries of a bucket.
BLOCK_WORDS = 2 << 20
LEAST_WORDS = 1 << 16
BUCKET_ENTRIES = 4 << 20
# Buckets are the highest bits of a hash, at least so many.
LEAST_BITS = 8
# Words whose distinct ones are listed together when the vocabulary is counted.
FLUSH = 4 << 20

_PAIR = np.uint64(0xA24BAED4963EE407)
# Counts of an entry: of a word, and of it as the last of its text, in target and background; of a bigram the first two.
_WORD_COUNTS, _PAIR_COUNTS = 4, 2


def _pairs(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * _PAIR + w)


def _bigrams(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index, first and second word hash of each bigram; the index is that of its second word."""
    second = found.windows(2) + 1
    return second, found.hashes[second - 1], found.hashes[second]


def _packed(values: np.ndarray) -> bytes:
    """Unsigned numbers as planes of bytes, as many as the largest needs."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values, "<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + planes.T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending distinct hashes: the first, and the packed steps between them."""
    return keys[:1].astype("<u8").tobytes() + _packed(np.diff(keys))


def _unpacked_keys(data: bytes) -> np.ndarray:
    first = np.frombuffer(data, "<u8", 1)
    return np.cumsum(np.concatenate((first, _unpacked(data[8:]))), dtype=np.uint64)


def _by_bucket(keys: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """The buckets that ascending hashes lie in, and where."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=1 << bits))
    return [(int(bucket[a]), slice(a, b)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed distinct words by bucket; in bucket -1 the words of both sides are counted."""
    n = np.zeros(2, np.int64)
    kept, size = [], 0

    def listed(hashes: list[np.ndarray], n: np.ndarray) -> pa.RecordBatch:
        keys = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        parts = _by_bucket(keys, LEAST_BITS)
        zeros = [0] * len(parts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([-1, *(b for b, _ in parts)], pa.int64()),
                pa.array([b"", *(_packed_keys(keys[x]) for _, x in parts)], pa.binary()),
                *(pa.array([int(x), *zeros], pa.int64()) for x in n),
            ],
            names=["bucket", "keys", "n_target", "n_background"],
        )

    for batch in batches:
        flags = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
        for part in slices(batch.column(0)):
            found = words(part, lower=True)
            hits = found.counts[flags[part.first : part.first + part.count]].sum()
            n += hits, len(found.hashes) - hits
            kept.append(np.unique(found.hashes))
            size += len(found.hashes)
            if size >= FLUSH:
                yield listed(kept, n)
                kept, size, n = [], 0, np.zeros(2, np.int64)
    yield listed(kept, n)


def _distinct(rows: pa.Table) -> pa.Table:
    lists = [_unpacked_keys(x) for x in rows.column("keys").to_pylist() if x]
    n_words = len(np.unique(np.concatenate(lists))) if lists else 0
    sums = [sum(rows.column(c).to_pylist()) for c in ("n_target", "n_background")]
    return pa.table([pa.array([x], pa.int64()) for x in (n_words, *sums)], names=["n_words", "n_target", "n_background"])


@dataclass
class Block:
    """Texts of a block, slice by slice with a flag of each, and its ascending distinct words and bigrams with
    their counts in the block."""

    parts: list[tuple[Words, int, np.ndarray]]
    words: np.ndarray
    word_counts: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray


def _sums(label: np.ndarray, n: int, columns: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.bincount(label, x, n) for x in columns]).astype(np.int64)


def _joined(arrays: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(arrays) if arrays else np.zeros(0, kind)


def _block(texts: pa.ChunkedArray, flags: np.ndarray) -> Block:
    parts, all_words, word_side, last, all_pairs, pair_side = [], [], [], [], [], []
    for part in slices(_one(texts)):
        found = words(part, lower=True)
        own = flags[part.first : part.first + part.count]
        second, left, right = _bigrams(found)
        parts.append((found, part.count, own))
        all_words.append(found.hashes)
        word_side.append(own[found.text])
        last.append(found.position + 1 == found.counts[found.text])
        all_pairs.append(_pairs(left, right))
        pair_side.append(own[found.text[second]])
    target, last = _joined(word_side, bool), _joined(last, bool)
    keys, label = np.unique(_joined(all_words, np.uint64), return_inverse=True)
    word_counts = _sums(label, len(keys), [target, ~target, target & last, ~target & last])
    target = _joined(pair_side, bool)
    pairs, label = np.unique(_joined(all_pairs, np.uint64), return_inverse=True)
    return Block(parts, keys, word_counts, pairs, _sums(label, len(pairs), [target, ~target]))


def _one(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)


def _flagged(rows: pa.Table, id_col: str) -> tuple[pa.Table, np.ndarray]:
    """The documents of a block and whether each is of the target, by its own flag or by a marked row of its id."""
    marks = rows.column("_mark")
    texts, marked = rows.filter(pc.invert(marks)), rows.filter(marks)
    flags = texts.column("_t").to_numpy().astype(bool)
    if len(marked):
        flags = flags | pc.is_in(texts.column(id_col), _one(marked.column(id_col))).to_numpy().astype(bool)
    return texts, flags


def _asked(rows: pa.Table, id_col: str, text_col: str, bits: int) -> pa.Table:
    """What one block asks: packed hashes and own counts by bucket, bigrams in buckets after those of the words."""
    texts, flags = _flagged(rows, id_col)
    block = _block(texts.column(text_col), flags)
    bucket, keys, counts = [], [], []
    for first, table, n in ((0, block.words, block.word_counts), (1 << bits, block.pairs, block.pair_counts)):
        for b, where in _by_bucket(table, bits):
            bucket.append(first + b)
            keys.append(_packed_keys(table[where]))
            counts.append(_packed(n[where].T.ravel()))
    block_id = rows.column("_block")[:1].to_pylist() * len(bucket)
    return pa.table(
        [pa.array(block_id, pa.int64()), pa.array(bucket, pa.int64()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())],
        names=["_block", "bucket", "keys", "counts"],
    )


def _answered(rows: pa.Table, bits: int) -> pa.Table:
    """Sums over all blocks for each list of one bucket, in the order of the list."""
    lists = [_unpacked_keys(x) for x in rows.column("keys").to_pylist()]
    n = _WORD_COUNTS if rows.column("bucket")[0].as_py() < 1 << bits else _PAIR_COUNTS
    counts = np.concatenate([_unpacked(x).reshape(n, -1) for x in rows.column("counts").to_pylist()], axis=1)
    keys, label = np.unique(np.concatenate(lists), return_inverse=True)
    sums = _sums(label, len(keys), list(counts))
    ends = np.cumsum([len(x) for x in lists])
    answers = [_packed(sums[label[b - len(x) : b]].T.ravel()) for x, b in zip(lists, ends, strict=True)]
    return pa.table(
        [rows.column("_block"), rows.column("bucket"), pa.array(answers, pa.binary())], names=["_block", "bucket", "counts"]
    )


@dataclass
class Models:
    """Sorted hashes of the words and bigrams of a block with their (target, background) counts over all documents;
    ``context_counts``: of a word as the first of a bigram; ``size``: distinct words of all documents."""

    total: np.ndarray
    size: int
    words: np.ndarray
    word_counts: np.ndarray
    context_counts: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray


def _models(total: np.ndarray, size: int, block: Block, answers: pa.Table, bits: int) -> Models:
    rows = sorted(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist(), strict=True))

    def counts(lists: list[bytes], n: int, entries: int) -> np.ndarray:
        found = [_unpacked(x).reshape(n, -1).T for x in lists]
        table = np.concatenate([np.zeros((0, n), np.uint64), *found]).astype(np.int64)
        if len(table) != entries:
            raise ValueError(f"a block has {entries} entries and answers for {len(table)}: its documents changed meanwhile")
        return table

    of_words = counts([x for b, x in rows if b < 1 << bits], _WORD_COUNTS, len(block.words))
    of_pairs = counts([x for b, x in rows if b >= 1 << bits], _PAIR_COUNTS, len(block.pairs))
    return Models(total, size, block.words, of_words[:, :2], of_words[:, :2] - of_words[:, 2:], block.pairs, of_pairs)


def _rest(counts: np.ndarray, at: np.ndarray, own: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """Counts at some places without what the text itself adds to its own model."""
    found = counts[at].astype(float)
    found[np.arange(len(at)), mine] -= own
    return found


def losses(models: Models, found: Words, n_texts: int, in_target: np.ndarray) -> np.ndarray:
    """Mean loss of each text under the target and the background model, 0 for a text without words."""
    mine = np.where(in_target, 0, 1)[found.text]
    at = np.searchsorted(models.words, found.hashes)
    own, _ = group_sizes(found.text, at)
    count = _rest(models.word_counts, at, own, mine)
    total = np.tile(models.total.astype(float), (len(at), 1))
    total[np.arange(len(at)), mine] -= found.counts[found.text]
    p = (count + ADDED) / (total + ADDED * (models.size + 1))
    second, left, right = _bigrams(found)
    pair = np.searchsorted(models.pairs, _pairs(left, right))
    own_pair, _ = group_sizes(found.text[second], pair)
    own_context, _ = group_sizes(found.text[second], at[second - 1])
    joint = _rest(models.pair_counts, pair, own_pair, mine[second])
    around = _rest(models.context_counts, at[second - 1], own_context, mine[second])
    p[second] = (joint + CONTEXT * p[second]) / (around + CONTEXT)
    loss = -np.log(p)
    n = np.maximum(np.bincount(found.text, minlength=n_texts), 1)
    return np.column_stack([np.bincount(found.text, loss[:, i], n_texts) / n for i in (0, 1)])


def _lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch.column(1)):
            ids, n = batch.column(0).slice(part.first, part.count), words(part, lower=True).counts
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64())], names=["_id", "n"])


def cross_entropy_difference(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str | None = "in_target",
    targets: DataFrame | None = None,
) -> DataFrame:
    """(id, n_words, target_loss, background_loss, score) for each row; ``score`` is their difference.

    Documents with a true ``target_col`` or an id in ``targets`` are the target, all others (null too) the
    background. Words are runs of other than ASCII blanks, A-Z lower-cased. A text without words scores 0; repeated
    rows count as often as they occur and score alike; if one side has no words, its model is uniform. Other columns
    are not read.

    Every word and bigram is in the models, at any size. A frequent one is an entry for each block that has it.
    Texts move once, to their block; ``targets`` are sent there instead of being joined before. Rows equal in id
    and text are in one block, with ``targets`` rows equal in id.
    """
    spark = documents.sparkSession
    flag = F.lit(False) if target_col is None else F.coalesce(F.col(target_col), F.lit(False))
    rows = documents.select(id_col, text_col, flag.alias("_t"))
    lists = rows.select(text_col, "_t").mapInArrow(_vocabulary, "bucket bigint, keys binary, n_target bigint, n_background bigint")
    counted = lists.groupBy("bucket").applyInArrow(_distinct, "n_words bigint, n_target bigint, n_background bigint")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted.columns]
    size, *total = counted.agg(*sums).first()
    total = np.array(total, np.int64)
    marked = rows.withColumn("_mark", F.lit(False))
    key = [id_col, text_col]
    if targets is not None:
        ids = targets.select(F.col(id_col).cast(documents.schema[id_col].dataType).alias("_id")).where("_id is not null")
        lengths = rows.where("not _t").select(id_col, text_col).mapInArrow(_lengths, with_id(documents, id_col, "n bigint", "_id"))
        moved = lengths.join(ids, "_id", "left_semi").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        total += moved, -moved
        texts = F.lit(None).cast(documents.schema[text_col].dataType).alias(text_col)
        marked = marked.unionByName(ids.select(F.col("_id").alias(id_col), texts, F.lit(True).alias("_t"), F.lit(True).alias("_mark")))
        # A row without an id meets no target: its text deals it.
        key = [id_col, F.when(F.col(id_col).isNull(), F.col(text_col))]
    n = int(total.sum())
    bits = max(LEAST_BITS, (n // BUCKET_ENTRIES).bit_length())
    least = min(n // LEAST_WORDS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(1, -(-n // BLOCK_WORDS), least)
    # The choice depends on a row alone, so both readings of a block have the same texts.
    dealt = marked.withColumn("_block", F.pmod(F.xxhash64(*key), F.lit(blocks).cast("bigint")))
    asked = dealt.groupBy("_block").applyInArrow(
        lambda rows: _asked(rows, id_col, text_col, bits), "_block bigint, bucket bigint, keys binary, counts binary"
    )
    answers = asked.groupBy("bucket").applyInArrow(
        lambda rows: _answered(rows, bits), "_block bigint, bucket bigint, counts binary"
    )

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        texts, flags = _flagged(rows, id_col)
        block = _block(texts.column(text_col), flags)
        models = _models(total, size, block, answers, bits)
        loss = np.concatenate([np.zeros((0, 2)), *(losses(models, *part) for part in block.parts)])
        n_words = np.concatenate([np.zeros(0, np.int64), *(found.counts for found, _, _ in block.parts)])
        return pa.table(
            [
                texts.column(id_col),
                pa.array(n_words, pa.int64()),
                *(pa.array(x) for x in (loss[:, 0], loss[:, 1], loss[:, 0] - loss[:, 1])),
            ],
            names=[id_col, "n_words", "target_loss", "background_loss", "score"],
        )

    schema = with_id(documents, id_col, "n_words bigint, target_loss double, background_loss double, score double")
    return dealt.groupBy("_block").cogroup(answers.groupBy("_block")).applyInArrow(score, schema)
