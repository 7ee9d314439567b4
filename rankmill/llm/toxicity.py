"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's probability is a logistic function of its words; a document is toxic if any sentence is: one minus
the product of (1 - p), the noisy-or. Training follows the document labels through that product, so weight gathers
on the sentences that explain them; these are then what is located.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankmill.llm.frames import with_id
from rankmill.llm.quality import sampled
from rankmill.llm.words import Texts, Words, slices, words

BITS = 18
# Labelled rows of each class that the model is fitted on: whole texts, cut to sentences and hashed inside tasks.
SAMPLE = 3000
# A word in fewer sampled documents has no weight.
MIN_DOCUMENTS = 3

# Bytes between words: all ASCII but letters and digits. Bytes that end a sentence.
_BETWEEN = np.array([not (b >= 0x80 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) for b in range(256)])
_STOPS = np.isin(np.arange(256), [ord(c) for c in ".!?\n"])


@dataclass
class Sentences:
    """Sentences of a slice: first and last word of each, its text, and the distinct (sentence, feature) pairs."""

    first: np.ndarray
    last: np.ndarray
    text: np.ndarray
    sentence: np.ndarray
    feature: np.ndarray


def sentences(part: Texts, found: Words) -> Sentences:
    """Cut at full stops, exclamation and question marks and line breaks; a sentence has a word at least."""
    stops = np.concatenate(([0], np.cumsum(_STOPS[part.data])))[found.starts]
    new = np.ones(len(stops), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (found.text[1:] != found.text[:-1])
    of_word = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(stops)) - 1 if len(first) else first
    feature = (found.hashes >> np.uint64(64 - BITS)).astype(np.int64)
    pairs = np.unique(of_word << BITS | feature)
    return Sentences(first, last, found.text[first], pairs >> BITS, pairs & ((1 << BITS) - 1))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentence_scores(self, cut: Sentences) -> np.ndarray:
        z = np.bincount(cut.sentence, self.weights[cut.feature], len(cut.first)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Probability that any sentence of a text is toxic; 0 for a text without sentences."""
    return -np.expm1(np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), n))


@dataclass
class Sample:
    """Labels of the sampled texts, the text of each sentence, and the distinct (sentence, feature) pairs."""

    y: np.ndarray
    text: np.ndarray
    sentence: np.ndarray
    feature: np.ndarray


def train(sample: Sample, weight: np.ndarray, steps: int = 300, rate: float = 0.1, sparse: float = 2e-4) -> Model:
    """Ascend the likelihood of document labels under the noisy-or, by Adam with shrinkage towards zero."""
    size, y, text = 1 << BITS, sample.y, sample.text
    documents = np.unique(text[sample.sentence] << BITS | sample.feature)
    usable = np.bincount(documents & (size - 1), minlength=size) >= MIN_DOCUMENTS
    keep = usable[sample.feature]
    row, feature = sample.sentence[keep], sample.feature[keep]
    w, bias = np.zeros(size), -5.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[feature], len(text)) + bias, -30, 30)))
        whole = noisy_or(p, text, len(y))
        # Of log likelihood to a sentence's logit: p (1 - P) / P in a toxic document, -p in a clean one.
        pull = np.where(y == 1, (1 - whole) / np.maximum(whole, 1e-9), -1.0) * weight
        error = -p * pull[text]
        g, gb = np.bincount(feature, error[row], size), error.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        a, b = 1 - 0.9**step, 1 - 0.99**step
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-6)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * sparse / (np.sqrt(v / b) + 1e-4), 0)
        bias -= rate * (mb / a) / (np.sqrt(vb / b) + 1e-6)
    return Model(w, bias)


def _sentence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as the features of all their sentences, and how many of them each sentence has."""
    for batch in batches:
        for part in slices(batch.column(3)):
            cut = sentences(part, words(part, lower=True, other=_BETWEEN))
            sizes = np.bincount(cut.sentence, minlength=len(cut.first))
            bounds = np.arange(part.count + 1)
            lists = [
                pa.ListArray.from_arrays(pa.array(np.searchsorted(of, bounds).astype(np.int32)), pa.array(x.astype(np.int32)))
                for of, x in ((cut.text, sizes), (cut.text[cut.sentence], cut.feature))
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(part.first, part.count) for i in range(3)), *lists],
                names=["label", "_key", "_id", "sizes", "features"],
            )


def sample_rows(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> Sample:
    """The sampled texts in the order of their keys; no text reaches the driver, only numbers."""
    found = sampled(documents, labels, id_col, text_col, rows).select(
        F.col("label").cast("int"), "_key", F.col(id_col).cast("string").alias("_id"), "_text"
    )
    table = found.mapInArrow(
        _sentence_rows, "label int, _key bigint, _id string, sizes array<int>, features array<int>"
    ).toArrow()
    table = table.sort_by([("_key", "ascending"), ("_id", "ascending")])
    sizes, features = (table.column(name).combine_chunks() for name in ("sizes", "features"))
    text = np.repeat(np.arange(len(table)), sizes.value_lengths().to_numpy())
    sentence = np.repeat(np.arange(len(text)), sizes.flatten().to_numpy())
    return Sample(table.column("label").to_numpy().astype(float), text, sentence, features.flatten().to_numpy().astype(np.int64))


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = SAMPLE) -> Model:
    """Fit on at most ``rows`` labelled texts of each class; labels are (id, label), 1 for toxic.

    The classes are weighted back to their shares among all labels. Without labels of both classes no sentence is
    toxic, or each one is. Null and empty texts have no sentence; texts of any length are hashed inside tasks.
    """
    shares = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = sample_rows(documents, labels, id_col, text_col, rows)
    y = sample.y
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(1 << BITS), 30.0 if y.any() else -30.0)
    share = shares[1] / (shares[0] + shares[1])
    weight = np.where(y == 1, share / y.sum(), (1 - share) / (1 - y).sum())
    return train(sample, weight)


def score(
    documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", located: float = 0.5
) -> DataFrame:
    """(id, score, n_sentences, offending) for each row.

    ``offending`` has the sentences with a probability of at least ``located``: code points from the first to the
    last word, and the probability. Null and empty texts have no sentence and score 0. Only the text decides:
    repeated rows score alike, other columns are not read, an empty table gives no rows.
    """
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.column(1)):
                found = words(part, lower=True, other=_BETWEEN)
                cut = sentences(part, found)
                p = model.sentence_scores(cut)
                spans = [[] for _ in range(part.count)]
                for i in np.flatnonzero(p >= located):
                    begin, text = part.offsets[cut.text[i]], part.data
                    start, end = found.starts[cut.first[i]], found.ends[cut.last[i]]
                    # Code points: bytes that do not go on a character.
                    before = int(((text[begin:start] & 0xC0) != 0x80).sum())
                    inside = int(((text[start:end] & 0xC0) != 0x80).sum())
                    spans[cut.text[i]].append({"start": before, "end": before + inside, "probability": float(p[i])})
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.first, part.count),
                        pa.array(noisy_or(p, cut.text, part.count)),
                        pa.array(np.bincount(cut.text, minlength=part.count), pa.int64()),
                        pa.array(spans, span),
                    ],
                    names=[id_col, "score", "n_sentences", "offending"],
                )

    return documents.select(id_col, text_col).mapInArrow(
        judge,
        with_id(
            documents,
            id_col,
            "score double, n_sentences bigint, offending array<struct<start: bigint, end: bigint, probability: double>>",
        ),
    )
