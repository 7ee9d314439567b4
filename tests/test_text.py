import hashlib
import random
import re
import time

from pyspark.sql import functions as F

from rankmill.functions import text


def py_halfwidth(s):
    return "".join(" " if c == "　" else chr(ord(c) - 0xFEE0) if 0xFF00 <= ord(c) <= 0xFF5E else c for c in s)


def py_rm_repeat(s):
    return re.sub(r"(\S{2,}?)\1+", r"\1", re.sub(r"(.)\1+", r"\1\1", s))


def py_clean(s):
    return py_rm_repeat(py_halfwidth(s.replace("\n", " ").replace("\r", ""))).lower().strip()


def one(spark, value, builder):
    frame = spark.createDataFrame([(value,)], "x string")
    return frame.select(builder(F.col("x")).alias("y")).first().y


def test_fixed_examples(spark):
    assert one(spark, "ＡＢ１２　ｚ！～x", text.to_halfwidth) == "AB12 z!~x"
    assert one(spark, "xxxxy 好好好 gogogogo 早安早安早安!!!", text.rm_repeat) == "xxy 好好 go 早安!!"
    assert one(spark, "XXXXy\n好好好 GoGoGo 走走走了走走了", text.simple_clean) == "xxy 好好 go 走走了"
    assert one(spark, None, text.simple_clean) is None


def test_random_texts_match_a_plain_statement(spark):
    rng = random.Random(7)
    alphabet = "ab安哈 \n\r\t~ＡＢ　  \u00851"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    frame = spark.createDataFrame([(t,) for t in texts], "x string")
    rows = frame.select("x", text.rm_repeat(F.col("x")).alias("r"), text.simple_clean(F.col("x")).alias("c")).collect()
    assert [r.r for r in rows] == [py_rm_repeat(r.x) for r in rows]
    assert [r.c for r in rows] == [py_clean(r.x) for r in rows]


def test_whole_documents_match_a_plain_statement(spark, sf_dir):
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = documents.select("text", F.md5(text.simple_clean(F.col("text"))).alias("digest")).collect()
    assert [r.digest for r in rows] == [hashlib.md5(py_clean(r.text).encode()).hexdigest() for r in rows]


def test_tokens(spark):
    assert one(spark, "ab漢字, x1 é", text.tokenize) == ["ab", "漢", "字", "x1", "é"]
    pairs = one(spark, "ab漢字語 c", lambda c: text.tokenize(c, han_bigrams=True))
    assert pairs == ["ab", "漢", "字", "語", "漢字", "字語", "c"]
    assert one(spark, "軟體", lambda c: text.tokenize(c, {"軟": "软", "體": "体"})) == ["软", "体"]
    assert one(spark, None, text.tokenize) is None
    signed = one(spark, "C++ and C#, .NET or F&B (full-time). x_y 漢字+1 a.b.c... #tag +", lambda c: text.tokenize(c, signs=True))
    assert signed == ["C++", "and", "C#", ".NET", "or", "F&B", "full-time", "x", "y", "漢", "字", "1", "a.b.c", "tag"]
    assert tuple(one(spark, " Ａb  ", text.tokenize_to_struct)) == (" Ａb  ", ["ab"])
    assert tuple(one(spark, None, text.tokenize_to_struct)) == (None, None)


def test_long_stretches_match_a_plain_statement(spark):
    rng = random.Random(3)
    texts = ["", "x" * 500, "ab" * 400, "好" * 300]
    for _ in range(150):
        letters = rng.choice(["ab", "abc", "安哈好😀x", "abcdefghijklmnopqrst"])
        t = "".join(rng.choice(letters) for _ in range(rng.choice([50, 140, 300])))
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(t))
            j = min(len(t), i + rng.choice([3, 70, 100, 130]))
            t = t[:j] + t[i:j] * rng.choice([1, 2, 3]) + rng.choice(["", " ", "xy"]) + t[j:]
        texts.append(t)
    frame = spark.createDataFrame([(t,) for t in texts], "x string")
    rows = frame.select("x", text.rm_repeat(F.col("x")).alias("r")).collect()
    assert [r.r for r in rows] == [py_rm_repeat(r.x) for r in rows]


def test_long_texts_take_no_quadratic_time(spark):
    """Characters without blanks between them; the second text holds a long piece twice."""
    rng = random.Random(4)
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(20_000))
    frame = spark.createDataFrame([(han,)], "x string").select(text.rm_repeat(F.col("x")).alias("r"))
    frame.collect()
    start = time.perf_counter()
    assert frame.first().r == han
    assert time.perf_counter() - start < 3
    assert one(spark, han[:9000] + han[1000:], text.rm_repeat) == han
