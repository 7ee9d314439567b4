"""Operators with one right answer, against plain Python over the given tables and over odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from rankmill.llm import chat, decontaminate, jaccard, linededup, packing, quality, queries, sharding, substring
from tests.llm.conftest import odd_rows

BLANK = r"[^\x20\x09-\x0D]+"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_id(df, key="doc_id"):
    rows = df.collect()
    found = {r[key]: r for r in rows}
    assert len(found) == len(rows)
    return found


# Lines


def plain_lines(rows, least=10):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= least and len(holders[key(x)]) > 1 and i > min(holders[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_lines_of_odd_rows(odd):
    got = by_id(linededup.dedup_lines(odd))
    assert {i: (r.n_lines, r.n_dropped, r.text) for i, r in got.items()} == plain_lines(odd_rows())
    assert got[0].n_words == 7 and "shard" in got[0]


def test_lines_with_repeated_and_missing_ids(spark, empty):
    rows = [(1, "a line that is long\nx"), (1, "a line that is long\nx"), (None, "a line that is long"), (2, "A line that is long ")]
    got = linededup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r.doc_id), r.n_dropped, r.text) for r in got) == [
        ("1", 0, "a line that is long\nx"), ("1", 0, "a line that is long\nx"), ("2", 1, ""), ("None", 0, "a line that is long")
    ]
    assert linededup.dedup_lines(empty).count() == 0
    more = [(i, "the same long line") for i in range(4)]
    kept = linededup.dedup_lines(spark.createDataFrame(more, "doc_id bigint, text string"), max_documents=4)
    assert {r.n_dropped for r in kept.collect()} == {0}


# Benchmark passages


def plain_contamination(rows, items, size=10):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))

    windows = defaultdict(set)
    for item, text in items:
        found = words(text)
        for i in range(max(1, len(found) - size + 1) if found else 0):
            windows[tuple(found[i : i + size])].add(item)
    lengths = {len(w) for w in windows}
    out = {}
    for doc, text in rows:
        found, hit, which = words(text), set(), set()
        for n in lengths:
            for i in range(len(found) - n + 1):
                if (w := tuple(found[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    which |= windows[w]
        out[doc] = (len(found), len(hit), {i for i in which if i is not None})
    return out


def test_decontamination_of_the_tables(spark, sf_dir, plain_documents):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = plain_contamination(plain_documents, items)
    got = by_id(queries.op4_decontaminate(spark, sf_dir))
    assert any(hits for _, hits, _ in want.values())
    for i, (n, hits, which) in want.items():
        r = got[i]
        digest = sha(",".join(sorted(map(str, which))))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, hits, len(which), digest, hits > 0)


@pytest.mark.parametrize("block_chars", [1 << 22, 120])
def test_decontamination_of_odd_rows(spark, odd, block_chars, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCKS_A_PASS", 2)
    rows = odd_rows()
    words = rows[12][1].split()
    items = [(1, " ".join(words[3:18])), (2, rows[5][1]), (None, rows[9][1]), (3, None), (4, "..."), (2, rows[5][1])]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = by_id(decontaminate.contamination(odd, benchmark, block_chars=block_chars))
    want = plain_contamination(rows, items)
    assert {i: (r.n_words, r.n_hit, set(r["items"])) for i, r in got.items()} == want
    for i, text in rows:
        cut = " ".join(text[s.start : s.end] for s in got[i].spans) if text else ""
        assert len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(cut))) == want[i][1]
    kept = decontaminate.clean_rows(odd, benchmark, block_chars=block_chars)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, x in want.items() if not x[1]}
    if block_chars == 120:
        passes = list(decontaminate.benchmark_blocks(iter(items), block_chars=block_chars))
        assert len(passes) > decontaminate.BLOCKS_A_PASS
    none = benchmark.where("false")
    assert decontaminate.contamination(odd, none).where("n_hit > 0").isEmpty()


# Similarity


def plain_components(rows, k, num, den):
    sets = {}
    for i, text in rows:
        words = re.findall(BLANK, lower(text))
        grams = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}
        sets[i] = sets.get(i, set()) | grams
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (1, 60), (2, 100)])
def test_similar_odd_rows(odd, k, num):
    got = by_id(jaccard.near_duplicates(odd, shingle=k, similarity=(num, 100)))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == plain_components(odd_rows(), k, num, 100)


def test_similar_tables(spark, sf_dir, plain_documents):
    got = by_id(queries.op6_ngram_jaccard(spark, sf_dir))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == plain_components(plain_documents, 3, 90, 100)


def test_a_family_of_copies_that_no_single_member_links(spark):
    # Each text differs from the next in little, from far ones in much: one component by chains alone.
    import random

    rng = random.Random(5)
    words = [f"q{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(60):
        rows.append((rng.randrange(10**9), " ".join(words)))
        for _ in range(3):
            words[rng.randrange(300)] = f"q{rng.randrange(10**6)}"
    for i in range(20):  # similar, but below the threshold among themselves
        other = list(words)
        for j in rng.sample(range(300), 14):
            other[j] = f"r{rng.randrange(10**6)}"
        rows.append((rng.randrange(10**9), " ".join(other)))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame, shingle=3, similarity=(90, 100)).collect()}
    want = {i: c for i, (_, c) in plain_components(rows, 3, 90, 100).items()}
    assert len(set(want.values())) > 1 and got == want


def test_cells_of_many_blocks(spark, monkeypatch):
    # Close copies of one text and strays near the threshold, so that cells hold a large component and others.
    import random

    rng = random.Random(11)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(60):
        copy = list(base)
        for j in rng.sample(range(80), rng.choice([0, 1, 1, 2, 3])):
            copy[j] = f"x{rng.randrange(10**6)}"
        rows.append((i * 7 + 3, " ".join(copy)))
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame, shingle=3, similarity=(90, 100)).collect()}
    want = {i: c for i, (_, c) in plain_components(rows, 3, 90, 100).items()}
    assert len(set(want.values())) > 1 and got == want


def family(rng, size, changes, first=0):
    """Copies of one text with some words changed, and chains of copies of such copies."""
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(size):
        copy = list(rows[rng.randrange(len(rows))][1].split()) if rows and rng.random() < 0.4 else list(base)
        for j in rng.sample(range(90), rng.choice(changes)):
            copy[j] = f"x{rng.randrange(10**6)}"
        rows.append((first + i * 7 + 3, " ".join(copy)))
    return rows


@pytest.mark.parametrize("block,divisions", [(4, 6), (4, 0), (8, 1)])
def test_divided_cells_keep_every_link(spark, monkeypatch, block, divisions):
    import random

    rows = family(random.Random(block + divisions), 120, [0, 1, 2, 3, 5])
    # Two documents with one id, a null and a text of its own.
    rows += [(3, rows[50][1] + " more"), (5000, None), (5001, "alone"), (10, "")]
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "DIVISIONS", divisions)
    divided, real = [], jaccard._divided
    monkeypatch.setattr(jaccard, "_divided", lambda *args: divided.append(1) or real(*args))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame, shingle=3, similarity=(90, 100)).collect()}
    want = linked(rows, 3, 90)
    assert len(set(want.values())) > 3 and got == want
    assert bool(divided) == bool(divisions)


def linked(rows, k, num):
    """Components of ids, where rows of one id are one document."""
    parent = {i: i for i, _ in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = []
    for i, text in rows:
        words = re.findall(BLANK, lower(text))
        sets.append((i, {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}))
    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= num * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return {i: root(i) for i in parent}


def test_pairs_of_a_cell_grow_with_its_members(spark, monkeypatch):
    # Far copies of one text: all in the same cells, no two of them similar.
    import random

    rng = random.Random(3)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    given, real = [], jaccard._open_pairs

    def watch(known, unsettled, *rest):
        given.append(unsettled.agg(F.max("_n"), F.sum("_n")).first())
        return real(known, unsettled, *rest)

    monkeypatch.setattr(jaccard, "_open_pairs", watch)
    for size in (60, 240):
        rows = []
        for i in range(size):
            copy = [f"w{i}" for i in range(90)]
            for j in rng.sample(range(90), 4):
                copy[j] = f"x{rng.randrange(10**6)}"
            rows.append((i, " ".join(copy)))
        jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=3, similarity=(90, 100)).count()
    (most, few), (most_of_more, more) = (((a or 0), (b or 0)) for a, b in given)
    assert max(most, most_of_more) <= 8 and more <= 6 * max(few, 60)


def test_cells_stay_whole_where_division_gives_more_to_pair(spark, monkeypatch):
    # Texts of one half in common and of passages from a few others: they share cells, and many differences from any pivot.
    import random

    rng = random.Random(5)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    base = [f"w{i}" for i in range(200)]
    pool = [[[f"x{part}_{kind}_{i}" for i in range(12)] for kind in range(3)] for part in range(4)]
    rows = []
    for i in range(40):
        text = list(base)
        for part in range(4):
            text[part * 50 : part * 50 + 12] = rng.choice(pool[part])
        rows.append((i, " ".join(text)))
    seen, real = [], jaccard._unsettled

    def watch(members, found):
        known, unsettled = real(members, found)
        seen.append(unsettled.agg(F.sum(F.col("_n") * F.ceil(F.col("_n") / 8)), F.max("_n")).first())
        return known, unsettled

    monkeypatch.setattr(jaccard, "_unsettled", watch)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame, shingle=5, similarity=(80, 100)).collect()}
    assert got == linked(rows, 5, 80)
    assert len(seen) > 1 and seen[0][1] > 8 and seen[-1][0] <= jaccard.MORE * seen[0][0]


@pytest.mark.parametrize("records", [1, 5, 64])
def test_groups_that_cross_arrow_batches(spark, monkeypatch, records):
    import random

    rows = family(random.Random(records), 60, [0, 1, 2, 3, 5])
    rows.append((3, rows[50][1] + " more"))
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "DIVISIONS", 0)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, records)
    try:
        frame = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(frame, shingle=3, similarity=(90, 100)).collect()}
    finally:
        spark.conf.unset(name)
    assert got == linked(rows, 3, 90)


def test_points_reach_the_trees_in_small_batches(spark, monkeypatch):
    """A row has one point, so that a batch does not grow with the cells in it."""

    def measure(threshold):
        def probe(batches):
            import pyarrow as pa

            for batch in batches:
                size = sum(c.nbytes for c in batch.columns)
                yield pa.RecordBatch.from_arrays([pa.array([size]), pa.array([batch.num_rows])], names=["a", "b"])

        return probe

    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "_prober", measure)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(name, 8)
    try:
        known = spark.range(60).selectExpr("7L as cell", "id", "id as part")
        cells = spark.sql("select 7L as cell, 60L as _n")
        points = spark.range(60).selectExpr("id", "array_repeat(cast(id as int), 64) as point")
        sizes = jaccard._open_pairs(known, cells, points, jaccard.Threshold(80, 100)).collect()
    finally:
        spark.conf.unset(name)
    # 60 points of 256 bytes are in ten pairs of blocks; a batch has eight of those rows.
    assert sizes and max(r.a for r in sizes) <= 8 * 512


def test_every_link_comes_out_of_an_index(odd, monkeypatch):
    """Pairs that are verified are those that R-trees gave, less what finer counts exclude."""
    given, verified, links = set(), set(), set()

    def pairs_of(df):
        return {(r.a, r.b) for r in df.select("a", "b").collect()}

    def watch(name, note):
        real = getattr(jaccard, name)

        def call(*args):
            out = real(*args)
            note(args, out)
            return out

        monkeypatch.setattr(jaccard, name, call)

    watch("_near", lambda args, out: given.update(pairs_of(out)))
    watch("_open_pairs", lambda args, out: given.update(pairs_of(out)))
    watch("_similar", lambda args, out: (verified.update(pairs_of(args[0])), links.update(pairs_of(out))))
    jaccard.near_duplicates(odd, shingle=3, similarity=(80, 100)).count()
    assert links and links <= verified <= given


def test_similar_rows_without_ids(spark, empty):
    rows = [(None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (3, "A B C D E"), (None, "alone in here it is"), (9, None)]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.component_id) for r in got) == Counter(
        [(None, 3), (5, 3), (5, 3), (3, 3), (None, None), (9, 9)]
    )
    assert jaccard.near_duplicates(empty).count() == 0


# Repeats


def plain_repeats(rows, k=13):
    words = {i: re.findall(BLANK, t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - k + 1):
            first.setdefault(tuple(words[i][j : j + k]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for j in range(len(w) - k + 1):
            if first[tuple(w[j : j + k])] < i:
                gone.update(range(j, j + k))
        out[i] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


def test_repeats_of_odd_rows(odd):
    got = by_id(substring.remove_repeats(odd))
    assert {i: (r.n_words, r.n_removed, r.text) for i, r in got.items()} == plain_repeats(odd_rows())
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got.values())


def test_repeats_of_the_tables(spark, sf_dir, plain_documents):
    got = by_id(queries.op9_substring_dedup(spark, sf_dir))
    want = plain_repeats(plain_documents)
    assert {i: (r.n_words, r.n_removed, r.kept_sha256) for i, r in got.items()} == {
        i: (n, gone, sha(text)) for i, (n, gone, text) in want.items()
    }


def test_repeats_with_shared_and_missing_ids(spark, empty):
    text = " ".join(f"v{i}" for i in range(30))
    rows = [(4, text), (4, text + " end"), (None, text), (6, "new " + text)]
    got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert Counter((r.doc_id, r.n_removed, r.text) for r in got) == Counter(
        [(4, 0, text), (4, 0, text + " end"), (None, 0, text), (6, 30, "new")]
    )
    assert substring.remove_repeats(empty).count() == 0


# Chat


def plain_turns(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in found.items():
        turns.sort()
        said = "".join(x[3] for x in turns if x[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{x[2]}\n{x[3]}\n" for x in turns)), len(said), sha(said))
    return out


def test_conversations_are_read_back(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    marker = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", marker), (-1, 1, "assistant", marker)]
    got = by_id(queries.op1_chat_format(spark, sf_dir), "conv_id")
    assert {i: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for i, r in got.items()} == plain_turns(rows)


ODD_TURNS = [
    (1, 0, "user", None), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\n"), (1, 2, "a\nb\\n<|", "<\\|<\\\\|"),
    (1, 3, "assistant", ""), (2, None, None, "x"), (2, 5, "assistant", "日本<|"), (2, 5, "assistant", "日本<|"),
    (None, 1, "user", "no id"), (None, 2, "assistant", "yes"), (7, 0, "user", "line\nline\r\n\t"),
]


def test_odd_turns_are_read_back(spark):
    frame = spark.createDataFrame(ODD_TURNS, "conv_id bigint, turn bigint, role string, text string")
    segments = chat.format_paths(chat.chain(frame, "conv_id", ["turn", "role", "text"]))
    got = by_id(chat.read_back(segments, ["conv_id", "leaf"]), "conv_id")
    assert {i: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for i, r in got.items()} == plain_turns(ODD_TURNS)
    whole = by_id(chat.conversations(segments, ["conv_id", "leaf"]), "conv_id")
    for i, r in whole.items():
        assert len(r.text) == got[i].formatted_chars
        masked = "".join(chat.unescaped(r.text[s.start : s.start + s.length]) for s in r.loss)
        assert sha(masked) == got[i].loss_sha256
    none = frame.where("false")
    assert chat.read_back(chat.format_paths(chat.chain(none, "conv_id", ["turn"])), ["conv_id", "leaf"]).count() == 0


def test_trees_become_ranked_paths(spark):
    import random

    rng = random.Random(8)
    rows, parent = [], {}
    for tree in range(4):
        for node in range(40):
            up = rng.randrange(node) if node and rng.random() < 0.95 else None
            up = 999 if node == 7 else up  # a parent that is not there
            parent[tree, node] = up if up != 999 else None
            rows.append((tree, node, up, "user", f"{tree}-{node}", rng.randint(-3, 3), "clash"))
    frame = spark.createDataFrame(
        rows, "conv_id bigint, node bigint, parent bigint, role string, text string, score int, leaf string"
    )
    want, score = {}, {(r[0], r[1]): r[5] for r in rows}
    for tree in range(4):
        inner = {p for (t, _), p in parent.items() if t == tree}
        for leaf in set(range(40)) - inner:
            path = [leaf]
            while parent[tree, path[-1]] is not None:
                path.append(parent[tree, path[-1]])
            want[tree, leaf] = path[::-1]
    got = defaultdict(list)
    ranks = {}
    for r in chat.format_paths(frame, score="score").collect():
        got[r.conv_id, r.leaf].append((r.position, int(r.segment.split("-")[1].split("<")[0])))
        ranks[r.conv_id, r.leaf] = r.path_rank
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == want
    for tree in range(4):
        order = sorted((-sum(score[tree, n] for n in p), leaf) for (t, leaf), p in want.items() if t == tree)
        assert [ranks[tree, leaf] for _, leaf in order] == list(range(1, len(order) + 1))
    assert {r.path_rank for r in chat.format_paths(frame, score="score", top=2).collect()} == {1, 2}
    circle = spark.createDataFrame([(1, 1, 2, "user", "a"), (1, 2, 1, "user", "b")], "conv_id int, node int, parent int, role string, text string")
    with pytest.raises(ValueError, match="circle"):
        chat.format_paths(circle)


# Packing


def check_packed(rows, documents, window):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in documents}
    placed, filled = defaultdict(list), defaultdict(int)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        placed[r.sequence_id].append((r.offset, r.length))
        filled[r.doc_id] += r.length
    assert filled == {i: len(x) for i, x in ids.items()}
    for parts in placed.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
    assert sorted(placed) == list(range(len(placed)))
    return sum(map(len, ids.values())) / (len(placed) * window)


def test_packing_of_the_tables(spark, sf_dir, plain_documents):
    assert check_packed(queries.op7_packing(spark, sf_dir).collect(), plain_documents, 1024) > 0.95


def test_packing_of_odd_rows(spark, odd, empty):
    marked = [(i, f"{t or ''} <|endoftext|> x\xa0 y  z") if i % 3 else (i, t) for i, t in odd_rows()]
    frame = spark.createDataFrame(marked, "doc_id bigint, text string")
    cut = packing.pieces(frame, window=64, with_ids=True)
    packed = packing.pack(cut, window=64)
    check_packed(packed.collect(), marked, 64)
    for r in packing.sequences(packed, 64).collect():
        assert len(r.input_ids) in (64, r.n_tokens) and (len(r.input_ids) == 64 or r.n_tokens & (r.n_tokens - 1) == 0)
    assert packing.pack(packing.pieces(empty)).count() == 0
    twice = packing.pack(packing.pieces(odd.union(odd)))
    assert twice.count() == 2 * packing.pieces(odd).count()


@pytest.mark.parametrize("unit", [" ", "\t", "\n", "\xa0", "a", "日", " a"])
def test_very_long_runs_are_encoded(unit):
    import public_tokenizers
    from tokenizers import Tokenizer

    text = "x" + unit * 1_000_000 + "y z"
    want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    assert packing.public_tokenizer().ids(text) == b"".join(i.to_bytes(4, "little") for i in want)


def test_a_very_long_run_is_packed(spark):
    rows = [(1, "x" + " " * 800_000 + "y"), (2, "z"), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    check_packed(packing.pack(packing.pieces(frame)).collect(), rows, 1024)


def test_fill_is_the_best_there_is():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(rng.randint(1, 4))}
        capacity = rng.randint(1, 40)
        best = 0
        for used in itertools.product(*(range(n + 1) for n in counts.values())):
            total = sum(k * n for k, n in zip(counts, used, strict=True))
            best = max(best, total if total <= capacity else 0)
        found = packing.fill(counts, capacity)
        assert sum(k * n for k, n in found.items()) == best and all(n <= counts[k] for k, n in found.items())


# Sharding


def plain_shard(key, shards):
    import math

    def score(s):
        seed = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        unit = ((xxhash.xxh64_intdigest(s.to_bytes(4, "little"), seed) >> 11) + 0.5) / 2**53
        return shards[s] / -math.log(unit)

    return max(range(len(shards)), key=lambda s: (score(s), -s))


def test_shards_of_the_tables(spark, sf_dir, plain_documents):
    got = by_id(queries.op8_sharding(spark, sf_dir))
    slots = defaultdict(list)
    for i, text in plain_documents:
        r = got[i]
        data = (text or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weighted_shards(spark, odd, empty):
    weights = [1.0, 2.0, 5.0]
    frame = spark.range(6000).withColumnRenamed("id", "k")
    rows = frame.withColumn("s", sharding.shard_of(F.col("k"), weights)).collect()
    assert all(r.s == plain_shard(r.k, weights) for r in rows[:500])
    share = Counter(r.s for r in rows)
    assert all(abs(share[s] / 6000 - w / 8) < 0.03 for s, w in enumerate(weights))
    moved = frame.withColumn("s", sharding.shard_of(F.col("k"), {0: 1.0, 1: 2.0, 2: 5.0, 9: 2.0})).collect()
    assert all(a.s == b.s or b.s == 9 for a, b in zip(sorted(rows), sorted(moved), strict=True))
    both = odd.select("doc_id", "shard").union(odd.select(F.lit(None).cast("bigint"), "shard"))
    found = sharding.shard_records(both, "doc_id", [1.0] * 3, num_partitions=5).collect()
    slots = defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
    assert len(found) == both.count() and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in found if r.doc_id is None}) == 1
    assert sharding.shard_records(empty, "doc_id", [1.0]).count() == 0


# Base features of the quality rules


def plain_features(text):
    text = text or ""
    words = re.findall(BLANK, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(BLANK, line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    inside = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(inside) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed


def test_base_features(spark, sf_dir, odd, empty, plain_documents):
    got = by_id(queries.op10_quality_rules(spark, sf_dir))
    columns = [*quality.FEATURES, "base_failed"]
    assert {i: tuple(got[i][c] for c in columns) for i in got} == {i: plain_features(t) for i, t in plain_documents}
    assert not any(r.kept and r.base_failed for r in got.values())
    rows = odd_rows() + [(500, "a b\n\n a b\na b\na b"), (501, "#\n#"), (502, " ".join(["one two three"] * 9)), (503, "x\n")]
    model = quality.fit(empty, spark.createDataFrame([], "doc_id bigint, label int"))
    found = by_id(quality.apply_rules(spark.createDataFrame(rows, "doc_id bigint, text string"), model))
    assert {i: tuple(found[i][c] for c in columns) for i in found} == {i: plain_features(t) for i, t in rows}
    assert quality.apply_rules(empty, model).count() == 0
