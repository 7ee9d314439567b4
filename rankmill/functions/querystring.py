"""URL parameters: parse a query string to a map and to a typed struct."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructField, StructType

from rankmill.functions.expressions import bind
from rankmill.functions.scalars import to_integer

ParamBuilder = Callable[[Column], Column]


def _entries(text: Column, strip_fragment: bool) -> Column:
    """Decoded ``array<struct<k,v>>`` without blank or missing values."""
    if strip_fragment:
        text = F.regexp_replace(text, r"(?s)#.*$", "")
    pairs = F.filter(
        F.split(text, "&"),
        lambda p: (F.instr(p, F.lit("=")) > 0) & (F.instr(p, F.lit("=")) < F.length(p)),
    )
    decoded = F.transform(
        pairs,
        lambda p: F.struct(
            F.try_url_decode(F.substring_index(p, "=", 1)).alias("k"),
            F.try_url_decode(F.substr(p, F.instr(p, F.lit("=")) + 1)).alias("v"),
        ),
    )
    return F.filter(decoded, lambda e: e["k"].isNotNull())


def query_map(text: Column, strip_fragment: bool = True) -> Column:
    """``map<string,string>`` of the parameters; the last value wins, blank or missing values are dropped.

    A malformed percent escape makes that value NULL.
    """

    def to_map(entries: Column, keys: Column) -> Column:
        # Only a repeated key makes the entries search each other.
        n = F.size(keys)
        last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, n), e["k"]))
        unique = F.size(F.array_distinct(keys)) == n
        return F.when(unique, F.map_from_entries(entries)).otherwise(F.map_from_entries(last))

    return bind(_entries(text, strip_fragment), lambda e: bind(e["k"], lambda keys: to_map(e, keys)))


def text_param(value: Column) -> Column:
    return value


def code_param(codes: dict[str, int]) -> ParamBuilder:
    """Known texts to codes, everything else (also a missing parameter) to 0."""

    def build(value: Column) -> Column:
        coded = F.lit(0)
        for text, code in codes.items():
            coded = F.when(value == text, F.lit(code)).otherwise(coded)
        return coded

    return build


def int_list_param(value: Column) -> Column:
    """Comma-separated integers; missing gives an empty list, an element that is no integer gives NULL."""
    items = F.transform(F.split(value, ","), lambda item: to_integer(item, "int"))
    return F.coalesce(items, F.array().cast("array<int>"))


def int_param(value: Column) -> Column:
    """Integer; missing gives -1, text that is no integer gives NULL."""
    return F.when(value.isNull(), F.lit(-1)).otherwise(to_integer(value, "int"))


def flag_param(value: Column) -> Column:
    return F.coalesce(value == "1", F.lit(False))


def match_param(expected: str) -> ParamBuilder:
    """1 if the value equals ``expected``, else 0."""
    return lambda value: F.coalesce(value == expected, F.lit(False)).cast("int")


class ParamRegistry:
    """Ordered parameters with type and column builder; yields one typed struct column."""

    def __init__(self) -> None:
        self._params: dict[str, tuple[DataType, ParamBuilder]] = {}

    def register(self, name: str, dtype: DataType, builder: ParamBuilder | None = None):
        """Add one parameter; without ``builder`` it is a decorator for one."""
        return self.register_many([name], dtype, builder)

    def register_many(self, names: Iterable[str], dtype: DataType, builder: ParamBuilder | None = None):
        if builder is None:
            return lambda fn: self.register_many(names, dtype, fn) or fn
        for name in names:
            self._params[name] = (dtype, builder)
        return None

    def copy(self) -> ParamRegistry:
        other = ParamRegistry()
        other._params.update(self._params)
        return other

    @property
    def names(self) -> list[str]:
        return list(self._params)

    @property
    def schema(self) -> StructType:
        return StructType([StructField(name, dtype) for name, (dtype, _) in self._params.items()])

    def struct(self, params: Column) -> Column:
        """Typed struct from a parameter map.

        The map is bound once. As one bound expression the many fields also stay out of the generated row
        loop, which would otherwise grow past what the JVM compiles.
        """

        def fields(bound: Column) -> Column:
            return F.struct(
                *(
                    build(F.try_element_at(bound, F.lit(name))).cast(dtype).alias(name)
                    for name, (dtype, build) in self._params.items()
                )
            )

        return bind(params, fields)

    def parse(self, text: Column, strip_fragment: bool = True) -> Column:
        """Typed struct straight from a query string."""
        return self.struct(query_map(text, strip_fragment))


# Parameter names in schema order, codes and marks.
SCALAR_PARAMS = ("sctp", "mode", "wktm", "order", "asc", "scmax", "scmin", "kwop", "m", "s5", "sr")
LIST_PARAMS = (
    "area", "dep", "edu", "expcat", "incat", "isnew", "jobcat", "cat",
    "jobexp", "ro", "rostatus", "s9", "wf", "wt", "zone",
)

DEFAULT_PARAMS = ParamRegistry()
DEFAULT_PARAMS.register("keyword", StringType(), text_param)
DEFAULT_PARAMS.register("sctp", IntegerType(), code_param({"P": 1, "S": 2}))
DEFAULT_PARAMS.register("mode", IntegerType(), code_param({"s": 1, "l": 2}))
DEFAULT_PARAMS.register("wktm", IntegerType(), code_param({"週休二日": 1, "隔週休": 2}))
DEFAULT_PARAMS.register_many(LIST_PARAMS, ArrayType(IntegerType()), int_list_param)
DEFAULT_PARAMS.register_many(("order", "asc", "scmax", "scmin"), IntegerType(), int_param)
DEFAULT_PARAMS.register_many(("kwop", "m"), BooleanType(), flag_param)
DEFAULT_PARAMS.register("s5", IntegerType(), match_param("256"))
DEFAULT_PARAMS.register("sr", IntegerType(), match_param("99"))


def with_query_params(
    df: DataFrame, source: str = "querystring", target: str = "query_params", registry: ParamRegistry = DEFAULT_PARAMS
) -> DataFrame:
    """Add the typed struct of a query-string column."""
    return df.withColumn(target, registry.parse(F.col(source)))
