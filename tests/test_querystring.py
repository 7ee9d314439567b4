import random
from urllib.parse import parse_qsl

from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from rankmill.functions.querystring import DEFAULT_PARAMS, ParamRegistry, query_map, with_query_params

# One value for each kind of parameter, written for this test.
SAMPLE = (
    "keyword=%E8%B3%87%E6%96%99+SQL&zone=7%2C12&edu=4&jobexp=1%2C5%2C8&s9=2&wt=16%2C1&order=3&asc=1&mode=l&"
    "ro=2&isnew=7&kwop=1&indcat=&m=0&scmax=90000&unknown=%31"
)


def parse(spark, text, registry=DEFAULT_PARAMS):
    frame = spark.createDataFrame([(text,)], "querystring string")
    return with_query_params(frame, registry=registry).first().query_params


def test_sample(spark):
    p = parse(spark, SAMPLE)
    assert (p.keyword, p.edu, p.jobexp, p.zone) == ("資料 SQL", [4], [1, 5, 8], [7, 12])
    assert (p.s9, p.wt, p.order, p.asc, p.ro, p.isnew) == ([2], [16, 1], 3, 1, [2], [7])
    assert (p.kwop, p.m, p.scmax, p.scmin, p.s5, p.sr, p.area) == (True, False, 90000, -1, 0, 0, [])


def test_codes_flags_and_bad_numbers(spark):
    p = parse(spark, "sctp=S&wktm=%E9%9A%94%E9%80%B1%E4%BC%91&m=1&s5=256&sr=99&order=x&zone=1%2Cy#sctp=P")
    assert (p.sctp, p.wktm, p.m, p.s5, p.sr, p.order, p.zone) == (2, 2, True, 1, 1, None, [1, None])


def test_schema_order(spark):
    names = with_query_params(spark.createDataFrame([("",)], "querystring string")).schema["query_params"].dataType.names
    assert names == DEFAULT_PARAMS.names and len(names) == 27


def test_map_edges(spark):
    cases = {
        "keyword=a+b&keyword=c&edu=&x": {"keyword": "c"},
        "p#q#r": {},
        "": {},
        "a=1&a=2&b=%E5%AE%89&a=3": {"a": "3", "b": "安"},
        "=v&k==": {"": "v", "k": "="},
        "%6B=1&k=2": {"k": "2"},
    }
    frame = spark.createDataFrame([(q,) for q in cases], "q string")
    for row in frame.select("q", query_map(F.col("q")).alias("m")).collect():
        assert row.m == cases[row.q]


def test_random_strings_match_a_plain_statement(spark):
    rng = random.Random(3)
    pieces = ["a", "b", "=", "&", "+", "%41", "%E5%AE%89", "#", "1", ",", " "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(2000)]
    frame = spark.createDataFrame([(t,) for t in texts], "q string")
    for row in frame.select("q", query_map(F.col("q")).alias("m")).collect():
        assert row.m == dict(parse_qsl(row.q.split("#", 1)[0])), row.q


def test_own_registry(spark):
    registry = ParamRegistry()

    @registry.register("page", IntegerType())
    def page(value):
        return value.try_cast("int") + 1

    registry.register_many(["a", "b"], IntegerType(), lambda v: F.length(v))
    assert tuple(parse(spark, "page=4&b=xyz", registry)) == (5, None, 3)
