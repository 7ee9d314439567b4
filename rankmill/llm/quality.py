"""Quality rules: base features of whole texts, and a calibrated classifier on hashed n-grams against a threshold.

The classifier is a logistic regression on the mean weight of hashed word 1- and 2-grams and character 3- and
4-grams, trained on labelled rows, its probabilities calibrated on rows it has not seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.frames import with_id
from rankmill.llm.words import LOWER, WHITE, Texts, Words, covered, group_sizes, mix, slices, span_hashes, sums, words

BITS = 18
# Labelled rows of each class that the classifier is fitted on: whole texts, smallest key first. Texts of any length
# are hashed inside tasks; a text reaches the driver as at most 2 ** BITS features.
SAMPLE = 1500
# Entries of the sample that a step of the fit takes together: few, as they lie in the driver several times as doubles.
CHUNK = 1 << 17
THRESHOLD = 0.5
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30

# Characters that count as symbols.
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_features(texts: Texts, found: Words) -> list[np.ndarray]:
    """The columns of FEATURES for each text of a slice."""
    data, offsets = texts.data, texts.offsets
    n_words = np.diff(np.searchsorted(found.starts, offsets))
    letters = ~WHITE[data] & ((data & 0xC0) != 0x80)
    # Lines that hold a word; one that starts at the end of its text is empty.
    breaks = np.flatnonzero(data == 10)
    starts = np.concatenate((offsets[:-1][np.diff(offsets) > 0], breaks[~np.isin(breaks + 1, offsets)] + 1))
    starts.sort()
    of_line = np.searchsorted(offsets, starts, "right") - 1
    next_break = np.append(breaks, len(data))[np.searchsorted(breaks, starts)]
    ends = np.minimum(next_break, offsets[of_line + 1])
    inked = np.searchsorted(found.starts, ends) > np.searchsorted(found.starts, starts)
    starts, ends, of_line = starts[inked], ends[inked], of_line[inked]
    _, earlier = group_sizes(of_line, span_hashes(data, starts, ends))
    n_dup = np.bincount(of_line[earlier > 0], minlength=texts.count)
    begins = found.windows(REPEAT_WINDOW)
    size, _ = group_sizes(found.text[begins], found.window_hashes(REPEAT_WINDOW, begins))
    repeated = covered(begins[size > 1], REPEAT_WINDOW, len(found.starts))
    n_repeat = np.bincount(found.text[repeated], minlength=texts.count)
    return [n_words, sums(letters, offsets), sums(_SYMBOL[data], offsets), n_dup, n_repeat]


def hashed_ngrams(texts: Texts, found: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) arrays, one entry an n-gram; each kind of n-gram has hashes of its own."""
    shift = np.uint64(64 - BITS)
    for k in (1, 2):
        begins = found.windows(k)
        yield found.text[begins], (found.window_hashes(k, begins) >> shift).astype(np.int64)
    # Character n-grams over bytes in lower case; they lie within one text.
    data = LOWER[texts.data].astype(np.uint64)
    of_byte = np.repeat(np.arange(texts.count), np.diff(texts.offsets))
    for k in (3, 4):
        if len(data) >= k:
            code = np.zeros(len(data) - k + 1, np.uint64)
            for j in range(k):
                code = code << np.uint64(8) | data[j : len(data) - k + 1 + j]
            same = of_byte[: len(code)] == of_byte[k - 1 :]
            yield of_byte[: len(code)][same], (mix(code[same] + np.uint64(k)) >> shift).astype(np.int64)


@dataclass
class Model:
    """Weights by hashed feature, and slope and offset of the calibration."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, texts: Texts, found: Words) -> np.ndarray:
        """Sum over the kinds of n-gram of the mean weight; an empty text has the bias alone."""
        total = np.full(texts.count, self.bias)
        for text, feature in hashed_ngrams(texts, found):
            n = np.bincount(text, minlength=texts.count)
            total += np.bincount(text, self.weights[feature], texts.count) / np.maximum(n, 1)
        return total

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30)))


def sampled(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled texts of each class, those with the smallest hash of the id: (id, label, _key, _text).

    Labels are 0 or 1 rows of (id, label); of several labels of one id the smallest counts. The choice is made
    before texts are read.
    """
    one = labels.where(f"`{id_col}` is not null").groupBy(id_col).agg(F.min("label").alias("label"))
    keyed = one.withColumn("_key", F.xxhash64(id_col))
    chosen = keyed.where("label = 0").orderBy("_key", id_col).limit(rows)
    chosen = chosen.unionByName(keyed.where("label = 1").orderBy("_key", id_col).limit(rows))
    # Bounded: two times ``rows`` ids. Repeated documents of an id count once, by their smallest text.
    texts = documents.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    return texts.groupBy(id_col, "label", "_key").agg(F.min(F.coalesce(text_col, F.lit(""))).alias("_text"))


def _entries(part: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of a slice: the share of a feature in each kind of n-gram of its text, summed."""
    keys, values = [], []
    for text, feature in hashed_ngrams(part, words(part, lower=True)):
        n = np.bincount(text, minlength=part.count)
        key, count = np.unique(text << BITS | feature, return_counts=True)
        keys.append(key)
        values.append(count / n[key >> BITS])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key, of = np.unique(np.concatenate(keys), return_inverse=True)
    return key >> BITS, key & ((1 << BITS) - 1), np.bincount(of, np.concatenate(values), len(key))


def _text_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts each feature is; the texts themselves count as feature -1 - label."""
    n, labels = np.zeros(1 << BITS, np.int64), np.zeros(2, np.int64)
    for batch in batches:
        labels += np.bincount(batch.column(0).to_numpy(zero_copy_only=False), minlength=2)
        for part in slices(batch.column(3)):
            n += np.bincount(_entries(part)[1], minlength=1 << BITS)
    used = np.flatnonzero(n)
    columns = [pa.array(np.append(used, [-1, -2])), pa.array(np.append(n[used], labels))]
    yield pa.RecordBatch.from_arrays(columns, names=["feature", "n"])


def _rows(usable: np.ndarray):
    """Texts as lists of their usable features and values."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(3)):
                text, feature, value = _entries(part)
                keep = usable[feature]
                ends = np.searchsorted(text[keep], np.arange(part.count + 1)).astype(np.int32)
                lists = [pa.array(feature[keep].astype(np.int32)), pa.array(value[keep].astype(np.float32))]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).slice(part.first, part.count) for i in range(3)),
                        *(pa.ListArray.from_arrays(pa.array(ends), x) for x in lists),
                    ],
                    names=["label", "_key", "_id", "features", "values"],
                )

    return rows


@dataclass
class Matrix:
    """Sparse rows of the sampled texts, in the order of their keys, with the label of each."""

    y: np.ndarray
    row: np.ndarray
    feature: np.ndarray
    value: np.ndarray

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for i in range(0, len(self.row), CHUNK):
            yield self.row[i : i + CHUNK], self.feature[i : i + CHUNK], self.value[i : i + CHUNK]

    def times(self, w: np.ndarray) -> np.ndarray:
        return sum((np.bincount(r, v * w[f], len(self.y)) for r, f, v in self.chunks()), np.zeros(len(self.y)))

    def gradient(self, error: np.ndarray) -> np.ndarray:
        return sum((np.bincount(f, v * error[r], 1 << BITS) for r, f, v in self.chunks()), np.zeros(1 << BITS))


def _matrix(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> Matrix:
    """The sample as feature rows. An n-gram in fewer than one of a hundred sampled texts is left out.

    Of a sample without both classes only the labels are read.
    """
    found = sampled(documents, labels, id_col, text_col, rows).select(
        F.col("label").cast("int"), "_key", F.col(id_col).cast("string").alias("_id"), "_text"
    )
    counts = found.mapInArrow(_text_counts, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = (counts.column(i).to_numpy() for i in (0, 1))
    of_class = [int(n[feature == -1 - label].sum()) for label in (0, 1)]
    if not all(of_class):
        y = np.repeat([0.0, 1.0], of_class)
        return Matrix(y, np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))
    usable = np.zeros(1 << BITS, bool)
    usable[feature[(feature >= 0) & (n >= max(2, sum(of_class) // 100))]] = True
    sample = found.mapInArrow(
        _rows(usable), "label int, _key bigint, _id string, features array<int>, values array<float>"
    ).toArrow()
    keys, ids = sample.column("_key").to_pylist(), sample.column("_id").to_pylist()
    order = np.array(sorted(range(len(keys)), key=lambda i: (keys[i], ids[i])))
    rank = np.empty(len(order), np.min_scalar_type(len(order)))
    rank[order] = np.arange(len(order))
    y = sample.column("label").to_numpy()[order].astype(float)
    features, values = sample.column("features"), sample.column("values")
    sizes = np.concatenate([x.value_lengths().to_numpy() for x in features.chunks])
    del sample
    # What is copied is given back at once, not when the fit is over.
    feature = np.concatenate([x.flatten().to_numpy() for x in features.chunks])
    del features
    value = np.concatenate([x.flatten().to_numpy() for x in values.chunks])
    del values
    pa.default_memory_pool().release_unused()
    return Matrix(y, np.repeat(rank, sizes), feature, value)


def _logistic(matrix: Matrix, weight, steps=200, rate=1.0, decay=1e-6):
    """Weights of a logistic regression with shrinkage, by Adam over the whole sample."""
    size, y = 1 << BITS, matrix.y
    w, bias = np.zeros(size), 0.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        z = matrix.times(w) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = matrix.gradient(error) + decay * w
        gb = error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-8)
    return w, bias


def _platt(margin, y, steps=100) -> tuple[float, float]:
    """Slope and offset of a logistic curve through held-out margins, by Newton steps.

    The targets are those of Platt: a little inside 0 and 1, the more so the fewer rows there are.
    """
    positive = y.sum()
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (len(y) - positive + 2))
    x = np.column_stack((margin, np.ones_like(margin)))
    p = np.array([0.0, 0.0])
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        hessian = x.T @ (x * (q * (1 - q) + 1e-6)[:, None]) + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (q - target))
        p -= step * min(1.0, 1.0 / (np.abs(step).max() + 1e-12))
    return max(float(p[0]), 1e-3), float(p[1])


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE) -> Model:
    """Fit on at most ``rows`` labelled texts of each class; labels are (id, label), 1 for good.

    Four of five sampled texts train the weights; the fifth calibrates, weighted back to the classes' shares among
    all labels. Without labels of both classes every text gets the probability of the class there is (one half
    without any).
    """
    shares = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    matrix = _matrix(documents, labels, id_col, text_col, rows)
    y = matrix.y
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(1 << BITS), 0.0, 0.0, 0.0 if not len(y) else 30.0 * (2 * y[0] - 1))
    balance = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (1 - y).sum()) / len(y)
    fold = np.arange(len(y)) % 5
    if min(y.sum(), (1 - y).sum()) < 10:
        w, bias = _logistic(matrix, balance)
        return Model(w, bias)
    train = fold != 0
    w, bias = _logistic(matrix, balance * train)
    margin = matrix.times(w) + bias
    slope, offset = _platt(margin[~train], y[~train])
    # From the sample's shares to those of all labels.
    held = y[~train]
    prior = np.log(max(shares.get(1, 0), 1) / max(shares.get(0, 0), 1))
    offset += prior - np.log((held.sum() + 0.5) / ((1 - held).sum() + 0.5))
    return Model(w, bias, slope, offset)


_VERDICT = ", ".join(f"{name} bigint" for name in FEATURES) + ", base_failed boolean, quality double, kept boolean"


def _judge(model: Model, threshold: float, name: str, text_of: Callable[[pa.RecordBatch], pa.Array]):
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(text_of(batch)):
                features = base_features(part, words(part))
                n_words, n_repeat = features[0], features[4]
                failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEATED * n_words)
                good = model.probability(model.margin(part, words(part, lower=True)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, part.count),
                        *(pa.array(f, pa.int64()) for f in features),
                        pa.array(failed),
                        pa.array(good),
                        pa.array(~failed & (good >= threshold)),
                    ],
                    names=[name, *FEATURES, "base_failed", "quality", "kept"],
                )

    return judge


def apply_rules(
    documents: DataFrame,
    model: Model,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """(id, base features, base_failed, quality, kept) for each row, in Arrow batches.

    Words are runs of other than ASCII blanks. ``n_dup_lines`` counts lines with a word that equal an earlier
    line, ``n_repeat_words`` words in 8-word windows found twice or more in the text. A text fails the base rules
    with fewer than 20 words or with more than 30 in 100 words repeated; else ``kept`` asks for a probability of
    at least ``threshold``. A null or empty text has no words and fails. Rows are judged one by one: repeated
    rows alike, an empty table gives no rows, other columns are not read.
    """
    judge = _judge(model, threshold, id_col, lambda batch: batch.column(1))
    return documents.select(id_col, text_col).mapInArrow(judge, with_id(documents, id_col, _VERDICT))


def keep_rows(documents: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that are kept, unchanged. A row moves as one struct, so that its text moves once."""
    rows = documents.select(F.struct(*documents.columns).alias("_row"))
    judge = _judge(model, threshold, "_row", lambda batch: batch.column(0).field(text_col))
    return rows.mapInArrow(judge, with_id(rows, "_row", _VERDICT)).where("kept").select("_row.*")
