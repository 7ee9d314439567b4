"""Operators that learn: held-out accuracy, exact arithmetic on small cases, and every odd row gets an answer."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rankmill.llm import lmscore, quality, queries, toxicity
from rankmill.llm.words import WHITE, mix, slices, words
from tests.llm.conftest import odd_rows

LARGER = "/root/testdata/sf0.01"


def area(scores, labels):
    """Share of (bad, good) pairs in the right order."""
    pairs = [(a > b) + (a == b) / 2 for a, x in zip(scores, labels) if x for b, y in zip(scores, labels) if not y]
    return sum(pairs) / len(pairs)


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}


def test_toxicity_of_held_out_documents(spark, labels):
    rows = queries.op5_toxicity(spark, LARGER).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert area([r.score for r in held], [labels[r.doc_id].toxic for r in held]) > 0.8


def test_toxic_sentences_are_located(spark, odd, empty):
    rng = np.random.default_rng(1)
    word = lambda: f"w{rng.integers(40)}"
    rows = []
    for i in range(200):
        parts = [" ".join(word() for _ in range(8)) for _ in range(5)]
        if i % 2:
            parts[i % 5] = f"{word()} Insült {word()}"
        rows.append((i, ". ".join(parts) + ".", i % 2))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, label int")
    model = toxicity.fit(frame.select("doc_id", "text"), frame.select("doc_id", "label"))
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    for i, text, label in rows:
        assert (got[i].score >= 0.5) == bool(label)
        assert ["Insült" in text[s.start : s.end] for s in got[i].offending] == [True] * label
    assert {r.doc_id for r in toxicity.score(odd, model).collect()} == {i for i, _ in odd_rows()}
    blank = [r.score for r in toxicity.score(odd, model).collect() if r.n_sentences == 0]
    assert blank and set(blank) == {0.0}
    assert toxicity.score(empty, toxicity.fit(empty, frame.select("doc_id", "label").limit(0))).count() == 0


def feature_of(piece, k, other=WHITE):
    """Hashed feature of k words, by the bytes of these words alone."""
    (part,) = slices(pa.array([piece]))
    found = words(part, other=other)
    assert len(found.starts) == k
    value = found.hashes[0] if other is not WHITE else found.window_hashes(k, np.array([0]))[0]
    return int(value) >> 64 - quality.BITS


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def plain_sentences(text, known={}):  # noqa: B006
    """Sets of features of the sentences that have a word."""
    for sentence in re.split(r"[.!?\n]", low(text)):
        found = set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", sentence))
        for word in found - set(known):
            known[word] = feature_of(word, 1, toxicity._BETWEEN)
        if found:
            yield {known[word] for word in found}


def plain_noisy_or(model, text):
    clean = 1.0
    for features in plain_sentences(text):
        clean *= 1 - 1 / (1 + math.exp(-(sum(model.weights[f] for f in sorted(features)) + model.bias)))
    return 1 - clean


def test_toxicity_scores_match_plain_sentences(spark, odd, plain_documents, sf_dir):
    """Every score is one minus the product over plain sentences, also for texts of many slices."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", "toxic as label")
    model = toxicity.fit(documents, rows)
    assert model.weights.any()
    got = {r.doc_id: r.score for r in toxicity.score(documents, model).collect()}
    assert got == pytest.approx({i: plain_noisy_or(model, t) for i, t in plain_documents}, abs=1e-9)
    long = " ".join(t or "" for _, t in plain_documents[:60] * 5)
    assert len(long.encode()) > 256 << 10
    texts = [*odd_rows(), (-1, long), (-2, "No stop " * 40_000)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in toxicity.score(frame, model).collect()}
    assert got == pytest.approx({i: plain_noisy_or(model, t) for i, t in texts}, abs=1e-9)


def test_toxicity_sample_reaches_the_driver_as_numbers(spark, empty):
    """Texts of 100 KB and of 1 MB are fitted on whole; features are those of plain sentences."""
    rng = np.random.default_rng(4)
    phrase = lambda n: " ".join(f"w{k}" for k in rng.integers(500, size=n))
    texts = [None, "", ". ! ?", *(". ".join(phrase(9) for _ in range(n)) for n in (1, 3, 3000, 30_000))]
    rows = [(i, text, i % 2) for i, text in enumerate(texts)]
    frame = spark.createDataFrame(rows + rows[3:4], "doc_id bigint, text string, label int")
    sample = toxicity.sample_rows(frame, frame.select("doc_id", "label"), "doc_id", "text", 10)
    chosen = quality.sampled(frame, frame.select("doc_id", "label"), "doc_id", "text", 10).collect()
    ordered = sorted(chosen, key=lambda r: (r._key, str(r.doc_id)))
    assert list(sample.y) == [r.label for r in ordered] and len(ordered) == len(texts)
    plain = [(k, features) for k, r in enumerate(ordered) for features in plain_sentences(r._text)]
    assert list(sample.text) == [k for k, _ in plain]
    sets = [set() for _ in plain]
    for k, feature in zip(sample.sentence.tolist(), sample.feature.tolist(), strict=True):
        assert feature not in sets[k]
        sets[k].add(feature)
    assert sets == [features for _, features in plain]
    none = toxicity.sample_rows(empty, frame.select("doc_id", "label").limit(0), "doc_id", "text", 10)
    assert [len(x) for x in (none.y, none.text, none.sentence, none.feature)] == [0] * 4


def plain_quality(model, text, known):
    """Probability from plain word 1- and 2-grams and byte 3- and 4-grams."""
    found = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    data = low(text).encode()
    margin = model.bias
    for k in (1, 2):
        pieces = [" ".join(found[i : i + k]) for i in range(len(found) - k + 1)]
        for piece in set(pieces) - set(known):
            known[piece] = feature_of(piece, k)
        margin += sum(model.weights[known[p]] for p in pieces) / max(1, len(pieces))
    for k in (3, 4):
        codes = [int.from_bytes(data[i : i + k], "big") + k for i in range(len(data) - k + 1)]
        for code in set(codes) - set(known):
            known[code] = int(mix(np.array([code], np.uint64))[0]) >> 64 - quality.BITS
        margin += sum(model.weights[known[c]] for c in codes) / max(1, len(codes))
    return 1 / (1 + math.exp(-(model.slope * margin + model.offset)))


def test_quality_verdicts_match_plain_ngrams(spark, plain_documents, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").selectExpr("doc_id", "quality as label")
    model = quality.fit(documents, rows)
    long = " ".join(t or "" for _, t in plain_documents[:60] * 5)
    assert len(long.encode()) > 256 << 10
    texts = [*plain_documents, *((-1 - i, t) for i, t in odd_rows()), (-1000, long)]
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    got, known = {r.doc_id: r for r in quality.apply_rules(frame, model).collect()}, {}
    assert len(got) == len(texts)
    for i, text in texts:
        good = plain_quality(model, text, known)
        assert got[i].quality == pytest.approx(good, abs=1e-9)
        assert got[i].kept == (not got[i].base_failed and good >= 0.5)


def test_quality_of_documents_not_fitted_on(spark, labels):
    documents = spark.read.parquet(f"{LARGER}/documents.parquet")
    rows = spark.read.parquet(f"{LARGER}/labels.parquet").selectExpr("doc_id", "quality as label")
    model = quality.fit(documents, rows.where("doc_id % 3 > 0"))
    held = [r for r in quality.apply_rules(documents, model).collect() if r.doc_id % 3 == 0 and r.doc_id in labels]
    judged = [r for r in held if not r.base_failed]
    right = Counter((labels[r.doc_id].quality, r.kept) for r in judged)
    assert right[1, True] / (right[1, True] + right[1, False]) > 0.95
    assert right[0, False] > right[0, True]
    one_class = quality.fit(documents, rows.where("label = 1"))
    assert all(r.kept != r.base_failed for r in quality.apply_rules(documents, one_class).collect())


def test_quality_sample_reaches_the_driver_as_feature_rows(spark, labels):
    """1,500 texts a class are fitted on, and no text is collected."""
    assert quality.SAMPLE == 1500
    documents = spark.read.parquet(f"{LARGER}/documents.parquet")
    rows = spark.read.parquet(f"{LARGER}/labels.parquet").selectExpr("doc_id", "quality as label")
    matrix = quality._matrix(documents, rows, "doc_id", "text", 40)
    chosen = quality.sampled(documents, rows, "doc_id", "text", 40).collect()
    texts = [(int(r.label), r._text) for r in sorted(chosen, key=lambda r: (r._key, str(r.doc_id)))]
    assert list(matrix.y) == [label for label, _ in texts] and len(texts) == 80
    w = np.random.default_rng(2).normal(size=1 << quality.BITS)
    seen = np.zeros(1 << quality.BITS, int)
    parts = list(slices(pa.array([text for _, text in texts]), limit=1))
    for part in parts:
        seen[np.unique(np.concatenate([f for _, f in quality.hashed_ngrams(part, words(part, lower=True))]))] += 1
    w[seen < 2] = 0
    plain = [quality.Model(w, 0.0).margin(part, words(part, lower=True))[0] for part in parts]
    assert matrix.times(w) == pytest.approx(plain, rel=1e-4, abs=1e-4)
    assert quality.fit(documents, rows).weights.any()


def plain_losses(rows):
    """Both losses of each text by plain counts; every word and bigram is in the models."""
    found = {i: [w.lower() for w in (t or "").split()] for i, t, _ in rows}
    out = {}
    for i, _, target in rows:
        losses = []
        for side in (True, False):
            own = [found[j] for j, _, flag in rows if flag == side and j != i]
            one, two = Counter(w for d in own for w in d), Counter(p for d in own for p in zip(d, d[1:]))
            before = Counter(p[0] for d in own for p in zip(d, d[1:]))
            size = len({w for d in found.values() for w in d})
            total = sum(one.values())
            loss = 0.0
            for k, w in enumerate(found[i]):
                p = (one[w] + lmscore.ADDED) / (total + lmscore.ADDED * (size + 1))
                if k:
                    v = found[i][k - 1]
                    p = (two[v, w] + lmscore.CONTEXT * p) / (before[v] + lmscore.CONTEXT)
                loss -= math.log(p)
            losses.append(loss / max(1, len(found[i])))
        out[i] = losses
    return out


def test_losses_match_plain_counts(spark, odd, empty):
    rows = [(i, (t or "")[:2000], i % 3 == 0) for i, t in odd_rows() if not t or t.isascii()]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, in_target boolean")
    got = {r.doc_id: r for r in lmscore.cross_entropy_difference(frame).collect()}
    for i, (target, background) in plain_losses(rows).items():
        assert got[i].target_loss == pytest.approx(target, rel=1e-9)
        assert got[i].background_loss == pytest.approx(background, rel=1e-9)
        assert got[i].score == pytest.approx(target - background, abs=1e-9)
    flagged = odd.selectExpr("doc_id", "text", "cast(null as boolean) as in_target")
    assert lmscore.cross_entropy_difference(flagged).count() == odd.count()
    assert lmscore.cross_entropy_difference(empty.selectExpr("*", "true as in_target")).count() == 0


def test_rare_words_of_a_large_corpus_are_in_the_models(spark):
    """2.4 million words, most bigrams of which occur once: losses are those of all counts."""
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(f"w{w}" for w in rng.zipf(1.2, 6000) % 200_000), i % 4 == 0) for i in range(400)]
    found = {i: text.split() for i, text, _ in rows}
    one, two, before = ({side: Counter() for side in (True, False)} for _ in range(3))
    for i, _, side in rows:
        one[side].update(found[i])
        two[side].update(zip(found[i], found[i][1:]))
        before[side].update(found[i][:-1])
    size, total = len(set(one[True]) | set(one[False])), {side: sum(one[side].values()) for side in one}
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, in_target boolean").repartition(6)
    got = {r.doc_id: r for r in lmscore.cross_entropy_difference(frame).collect()}
    assert len(got) == len(rows) and all(r.n_words == 6000 for r in got.values())
    for i, _, target in rows[::40] + rows[1::40]:
        text, losses = found[i], []
        own = Counter(text), Counter(zip(text, text[1:])), Counter(text[:-1])
        for side in (True, False):
            loss, mine = 0.0, side == target
            for k, w in enumerate(text):
                p = one[side][w] - mine * own[0][w] + lmscore.ADDED
                p /= total[side] - mine * len(text) + lmscore.ADDED * (size + 1)
                if k:
                    v = text[k - 1]
                    p = two[side][v, w] - mine * own[1][v, w] + lmscore.CONTEXT * p
                    p /= before[side][v] - mine * own[2][v] + lmscore.CONTEXT
                loss -= math.log(p)
            losses.append(loss / len(text))
        assert [got[i].target_loss, got[i].background_loss] == pytest.approx(losses, rel=1e-9)


def test_target_ids_and_target_flags_score_alike(spark, odd):
    texts = odd.select("doc_id", "text")
    texts = texts.union(texts.limit(5)).union(texts.selectExpr("cast(null as bigint)", "text"))
    ids = texts.where("doc_id % 3 = 0").select("doc_id").union(texts.selectExpr("cast(null as bigint)").limit(1))
    flagged = lmscore.cross_entropy_difference(texts.selectExpr("*", "doc_id % 3 = 0 as in_target"))
    marked = lmscore.cross_entropy_difference(texts, target_col=None, targets=ids)
    rows = [sorted(((r.doc_id is None, r.doc_id, *map(str, r[1:])) for r in x.collect()), key=str) for x in (flagged, marked)]
    assert len(rows[0]) == texts.count() and rows[0] == rows[1]


def test_low_scores_read_like_the_target(spark, labels):
    rows = [r for r in queries.op3_lm_score(spark, LARGER).collect() if r.doc_id in labels]
    assert area([-r.score for r in rows], [labels[r.doc_id].quality for r in rows]) > 0.75


def test_a_step_of_the_fit_needs_little_beside_the_sample():
    import tracemalloc

    rng = np.random.default_rng(1)
    n = 1 << 21
    row, feature = np.sort(rng.integers(0, 3000, n)).astype(np.uint16), rng.integers(0, 1 << quality.BITS, n).astype(np.int32)
    matrix = quality.Matrix(np.zeros(3000), row, feature, rng.random(n, np.float32))
    weights = rng.random(1 << quality.BITS)
    tracemalloc.start()
    margin = matrix.times(weights)
    matrix.gradient(margin)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(margin, np.bincount(row, matrix.value * weights[feature], 3000))
    assert peak < 12 << 20
