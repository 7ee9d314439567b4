"""Token files, resampling and the manifest against brute-force versions."""

import glob
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankmill.llm import manifest, queries, resample, tokenfiles, words

from .conftest import WORDS, odd_rows

CLASHING = "doc_id bigint, text string, ids string, rank int, weight string, leaf int, start int, part string, n int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 3, "z", 4) for i, t in rows], CLASHING)


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def whole(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


# --- token files -------------------------------------------------------------------------------------

ALPHABET = [*"abzAZ09 '.,!<|>-_#\t\n\x0b\x00\x7f\x85\xa0éÉÀÿßñ×÷ªµºſΣςσİı日本가ﬁ́̈​ 　😀", "'s", "'ll", " the ", "<|endoftext|>", "<|startoftext|>"]


def test_ids_equal_those_of_the_whole_text(library):
    rng = random.Random(5)
    tokenizer = tokenfiles.public_tokenizer()
    for _ in range(6000):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 24)))
        assert tokenizer.ids(text) == whole(library, text), repr(text)


@pytest.mark.parametrize("piece", [" ", "\t", "\n", "\xa0", "a", "é", "日", "<|endoftext|>", "!"])
def test_very_long_runs(library, piece):
    text = piece * (1_000_000 // len(piece))
    assert tokenfiles.public_tokenizer().ids(text) == whole(library, text)


def test_forgetting_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(tokenfiles, "_REMEMBERED", 3)
    tokenizer = tokenfiles.public_tokenizer()
    for _, text in odd_rows():
        assert tokenizer.ids(text or "") == whole(library, text)


def read_back(spark, documents, path, **settings):
    tokenfiles.write_tokens(documents, path, **settings)
    index = tokenfiles.document_index(spark, path)
    sums = {r["start"]: r["ids_crc32"] for r in tokenfiles.with_checksums(index, path).collect()}
    rows = [(r.doc_id, r.start, r.n_tokens, r.ids, sums[r.start]) for r in tokenfiles.with_tokens(index, path).collect()]
    return sorted(rows, key=lambda r: r[1])


def check(rows, documents, library):
    ids = [(r[0] is not None, r[0]) for r in rows]
    assert ids == sorted(ids)
    start = 0
    for _, at, n, tokens, crc in rows:
        assert at == start and n == len(tokens)
        assert crc == zlib.crc32(np.array(tokens, "<u4").tobytes())
        start += n
    want = [(i, np.frombuffer(whole(library, t), "<u4").tolist() + [2]) for i, t in documents]
    assert sorted(((r[0] or 0, r[3]) for r in rows)) == sorted((i or 0, t) for i, t in want)


@pytest.mark.parametrize("frame_ids, frame_docs", [(7, 3), (1 << 16, 1 << 10)])
def test_round_trip_of_odd_rows(spark, tmp_path, library, frame_ids, frame_docs):
    rows = [*odd_rows(), (None, "null id"), (None, "null id"), (4, "again"), (4, "again"), (4, None)]
    settings = {"frame_ids": frame_ids, "frame_docs": frame_docs, "num_partitions": 5}
    check(read_back(spark, clashing(spark, rows), str(tmp_path / "t"), **settings), rows, library)


def test_round_trip_of_a_very_long_text(spark, tmp_path, library):
    rng = random.Random(1)
    rows = [(1, "a"), (2, " ".join(rng.choice(WORDS) for _ in range(300_000))), (3, None)]
    check(read_back(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), str(tmp_path / "t")), rows, library)


def test_equal_rows_are_split_between_parts(spark, tmp_path):
    documents = spark.range(4000).select(F.lit(5).cast("bigint").alias("doc_id"), F.lit("a hot row").alias("text"))
    parts = tokenfiles.write_tokens(documents.repartition(4), str(tmp_path / "t"), num_partitions=4).collect()
    assert len(parts) == 4 and max(p["n_docs"] for p in parts) < 2000


def test_empty_table(spark, tmp_path, empty):
    path = str(tmp_path / "t")
    assert tokenfiles.write_tokens(empty, path).count() == 0
    assert tokenfiles.with_checksums(tokenfiles.document_index(spark, path), path).count() == 0


def test_only_requested_frames_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    documents = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 50).alias("text"))
    tokenfiles.write_tokens(documents, path, frame_ids=256, num_partitions=1)
    (name,) = glob.glob(f"{path}/*.ids.zst")
    reader = tokenfiles.FrameReader(name)
    n = len(reader._offsets) - 1
    reader.read(150 * 101 * 4, 404)
    assert n > 50 and reader.decompressed <= 2
    # A damaged frame is found out, and harms no document that lies elsewhere.
    damaged = int(reader._offsets[10]) + 12
    data = bytearray(open(name, "rb").read())
    data[damaged] ^= 0xFF
    open(name, "wb").write(data)
    found = tokenfiles.read_documents(spark, path, [150, 3, 150, 999]).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in found) == [(3, 101), (150, 101)]
    with pytest.raises(Exception, match="frame 10 .*checksum|decompression error"):
        tokenfiles.read_documents(spark, path, [26, 27]).collect()


def test_any_zstandard_reader_gets_all_ids(spark, tmp_path):
    import zstandard

    path = str(tmp_path / "t")
    documents = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id bigint, text string")
    tokenfiles.write_tokens(documents, path, frame_ids=2, num_partitions=1)
    (name,) = glob.glob(f"{path}/*.ids.zst")
    with open(name, "rb") as stream:
        data = zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True).read()
    assert len(np.frombuffer(data, "<u4")) == 5


def test_query_op11(spark, sf_dir, library, plain_documents):
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in queries.op11_token_files(spark, sf_dir).collect())
    want, start = [], 0
    for i, text in sorted(plain_documents, key=lambda r: r[0]):
        data = whole(library, text) + b"\2\0\0\0"
        want.append((i, start, len(data) // 4, zlib.crc32(data)))
        start += len(data) // 4
    assert got == want


# --- resampling --------------------------------------------------------------------------------------


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def plain_grams(text):
    found = plain_words(text)
    return found + [f"{a} {b}" for a, b in zip(found, found[1:])]


def plain_resample(documents, target, percent=25, min_words=20, seed=7, buckets=10_000):
    def counts(texts):
        out = [0] * buckets
        for text in texts:
            for gram in plain_grams(text):
                out[zlib.crc32(gram.encode()) % buckets] += 1
        return out

    s, t = counts(x for _, x in documents), counts(target)
    n_s, n_t = sum(s), sum(t)
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
        for b in range(buckets)
    ]
    rows, eligible = [], []
    for i, text in documents:
        grams = plain_grams(text)
        weight = sum(gain[zlib.crc32(g.encode()) % buckets] for g in grams) // len(grams) if grams else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(grams), weight, score, None])
        if len(plain_words(text)) >= min_words:
            eligible.append(rows[-1])
    eligible.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, row in enumerate(eligible[: percent * len(eligible) // 100], 1):
        row[4] = rank
    return sorted(map(tuple, rows), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_checksums_of_words():
    import pyarrow as pa

    texts = ["Ab cd", "", None, "x" * 700 + " é日 q", "a-b\tC" + " 12" * 40]
    for part in words.slices(pa.array(texts)):
        counts, grams = resample.features(part, 3, 10_000)
        assert counts.tolist() == [len(plain_words(t)) for t in texts]
        for n, (text, bucket) in enumerate(grams, 1):
            want = []
            for i, t in enumerate(texts):
                w = plain_words(t)
                want += [(i, zlib.crc32(" ".join(w[j : j + n]).encode()) % 10_000) for j in range(len(w) - n + 1)]
            assert list(zip(text.tolist(), bucket.tolist())) == want


@pytest.mark.parametrize("percent", [0, 1, 25, 60, 100])
def test_resample_odd_rows(spark, percent):
    rows = [*odd_rows(), (None, "only a null id " * 9), (None, "only a null id " * 9)]
    hot = "the same hot row again and again " * 5
    rows += [(99, hot)] * 40 + [(98, hot)] * 3
    target = [rows[8][1], None, "", "w1 w2 w3 w4 日本 " * 30]
    got = resample.resample(
        clashing(spark, rows), spark.createDataFrame([(t, 1) for t in target], "text string, n int"), percent=percent, block=7
    )
    assert rows_of(got) == plain_resample(rows, target, percent)


def test_resample_a_very_long_text(spark):
    rng = random.Random(2)
    rows = [(1, " ".join(rng.choice(WORDS) for _ in range(120_000))), (2, "w1 " * 30), (3, "y" * 400_000)]
    got = resample.resample(
        spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([("w1 w2",)], "text string"), percent=50
    )
    assert rows_of(got) == plain_resample(rows, ["w1 w2"], 50)


def test_resample_empty_tables(spark, empty):
    some = spark.createDataFrame([(1, "w1 " * 30), (2, "w2 " * 30)], "doc_id bigint, text string")
    assert rows_of(resample.resample(empty, some)) == []
    assert rows_of(resample.resample(some, empty, percent=50)) == plain_resample([(1, "w1 " * 30), (2, "w2 " * 30)], [], 50)


def test_cutoff_is_the_exact_key(spark):
    rng = random.Random(9)
    for values in ([rng.randrange(50) for _ in range(700)], [3] * 300, list(range(500)), [1, 2]):
        rows = [(v, v % 3) for v in values]
        keys = spark.createDataFrame(rows, "a bigint, b bigint").repartition(5)
        ordered = sorted(rows)
        for take in {1, len(rows) // 3 + 1, len(rows)}:
            key = ordered[take - 1]
            want = (key, ordered.index(key), ordered.count(key))
            assert resample.cutoff(keys, take, block=16) == want
        assert resample.cutoff(keys, len(rows) + 1) is None and resample.cutoff(keys, 0) is None


def test_every_round_discards_a_quarter(spark, monkeypatch):
    seen = []
    survey = resample._survey

    def spy(*args):
        found = survey(*args)
        seen.append(found)
        return found

    monkeypatch.setattr(resample, "_survey", spy)
    rng = random.Random(4)
    keys = spark.createDataFrame([(rng.randrange(10**9),) for _ in range(5000)], "a bigint").repartition(8)
    resample.cutoff(keys, 1234, block=64)
    left = 5000
    for found in seen[1:]:
        sides = [sum(r["n_before"] for r in found), sum(r["n_after"] for r in found)]
        assert max(sides) <= 0.75 * left + 1
        left = max(sides)
    assert len(seen) < 2 + math.log(5000, 4 / 3)


# --- manifest ----------------------------------------------------------------------------------------


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes, arity):
    """The root, and each leaf's way up: its slot among the siblings of each level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
        for way, i in zip(ways, at):
            way.append((runs[i // arity], i % arity))
        at = [i // arity for i in at]
        nodes = [h("".join(run)) for run in runs]
    return nodes[0], ways


def plain_leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_manifest(rows, arity=2):
    """Rows are (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((plain_leaf(row), row))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {}
    for lang in langs:
        trees[lang].sort(key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0]))
        built[lang] = plain_tree([leaf for leaf, _ in trees[lang]], arity)
    if not langs:
        return []
    root, tops = plain_tree([built[lang][0] for lang in langs], arity)
    out = []
    for lang, top in zip(langs, tops):
        for (leaf, row), way in zip(trees[lang], built[lang][1]):
            node = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                node = plain_leaf((*row[:3], row[3] + 1, row[4]))
            proof = ""
            for run, slot in way + top:
                proof += "".join(run[:slot] + run[slot + 1 :])
                node = h("".join([*run[:slot], node, *run[slot + 1 :]]))
            out.append((row[0], leaf, built[lang][0], root, h(proof), node, node == root))
    return sorted(out, key=repr)


def tampered():
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return fields, changed, [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields]


def manifest_of(spark, rows, **settings):
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf int, tree int, pos string"
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], schema)
    fields, changed, instead = tampered()
    return rows_of(manifest.manifest(table, fields, "lang", ["doc_id"], changed, instead, **settings))


def odd_manifest_rows():
    rng = random.Random(6)
    langs = ["en", "de", None, "", "é", "日", "-", ":"]
    rows = [(i, rng.choice(["s", "", None]), rng.choice(langs[:3]), rng.choice([None, i]), t) for i, t in odd_rows()]
    rows += [(1000 + i, "s", lang, 5, "x") for i, lang in enumerate(langs)]
    rows += [(None, None, None, None, None)] * 3 + [(7, "s", "en", 1, "same")] * 5 + [(7, "s", "en", 2, "other")]
    return rows


@pytest.mark.parametrize("arity, height", [(2, 10), (2, 2), (2, 1), (3, 2), (5, 1)])
def test_manifest_of_odd_rows(spark, arity, height):
    rows = odd_manifest_rows()
    assert manifest_of(spark, rows, arity=arity, height=height) == plain_manifest(rows, arity)


def test_manifest_of_small_tables(spark):
    rows = [(3, "s", "en", 4, "text")]
    assert manifest_of(spark, []) == []
    assert manifest_of(spark, rows) == plain_manifest(rows)


def test_manifest_of_a_very_long_text(spark):
    rows = [(i, "s", "en", 4, "日 x" * n) for i, n in enumerate((200_000, 0, 5))]
    assert manifest_of(spark, rows) == plain_manifest(rows)


def test_folding_resumes_midstates():
    nodes = [h(str(i)) for i in range(11)]
    for arity in (2, 3, 4):
        tree = manifest.Subtree(nodes, arity)
        for i in range(len(nodes)):
            changed = [*nodes[:i], "other", *nodes[i + 1 :]]
            assert tree.fold(i, "other") == manifest.Subtree(changed, arity).root
        # A state per child, which the parent's digest goes through.
        state = tree.states[0][1][arity - 1].copy()
        state.update(nodes[2 * arity - 1].encode())
        assert state.hexdigest() == tree.levels[1][1]
