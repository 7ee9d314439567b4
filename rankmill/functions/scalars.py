"""Date, number and identifier expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankmill.functions.expressions import bind, named

# Fixed value: modulus 2^61 - 1 of a numeric hash over 128-bit integers.
HASH_MODULUS = (1 << 61) - 1


def to_integer(text: Column, dtype: str = "bigint") -> Column:
    """Text to an integer type; anything that is no integer of that type gives NULL.

    The pattern goes first: a failing cast raises and catches an exception, dirty logs have many of those.
    """
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), text.try_cast(dtype))


def epoch_to_ts(millis: Column) -> Column:
    """Epoch milliseconds as text to a timestamp; bad text gives NULL."""
    return F.timestamp_millis(to_integer(millis))


def day_span(start: Column, stop: Column) -> Column:
    """Days from start to stop, both counted."""
    return F.datediff(stop, start) + 1


def case_codes(value: Column, codes: Mapping[str, int], default: int = 0) -> Column:
    coded = None
    for text, code in codes.items():
        coded = (F if coded is None else coded).when(value == text, F.lit(code))
    return coded.otherwise(F.lit(default))


def _hex_to_decimal(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("decimal(20,0)")


@named
def uuid_to_long(text: Column) -> Column:
    """The 128-bit number of a UUID modulo 2^61 - 1; 2^64 leaves remainder 8."""
    digits = F.regexp_replace(text, "-", "")
    high = _hex_to_decimal(F.substring(digits, 1, 16))
    low = _hex_to_decimal(F.substring(digits, 17, 16))
    return ((high * F.lit(8) + low) % F.lit(HASH_MODULUS).cast("decimal(20,0)")).cast("bigint")


def float_text(value: Column) -> Column:
    """Shortest decimal text: plain from 1e-4 up to 1e16, otherwise ``1.5e+16`` / ``1e-05`` form."""

    def render(v: Column) -> Column:
        native = v.cast("string")
        easy = ~native.contains("E") & (F.length(native) < 18)
        return F.when(easy, native).otherwise(bind(native, lambda text: _rare_float_text(v, text)))

    return bind(value.cast("double"), render)


def _rounded_text(value: Column, digits: int) -> Column:
    """``d.dddE+n`` with so many digits; whole numbers that a long holds are rounded from all their digits."""
    whole = F.abs(value).try_cast("bigint").cast("decimal(20,0)")
    length = F.length(whole.cast("string"))
    rounded = F.when(length == 17, F.round(whole, digits - 17)).when(length == 18, F.round(whole, digits - 18))
    text = rounded.otherwise(F.round(whole, digits - 19)).cast("decimal(20,0)").cast("string")
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    spelled = F.concat(
        sign, F.substr(text, F.lit(1), F.lit(1)), F.lit("."), F.substr(text, F.lit(2)), F.lit("E"),
        (F.length(text) - 1).cast("string"),
    )
    is_whole = (F.abs(value) >= 1e16) & (F.abs(value) < 9e18)
    return F.when(is_whole, spelled).otherwise(F.upper(F.format_string(f"%.{digits - 1}e", value)))


def _rare_float_text(value: Column, native: Column) -> Column:
    # From 17 digits on the JVM's text is not always the shortest that reads back as the same number.
    exact = F.when(F.length(native) < 18, native)
    for digits in (15, 16, 17):
        shorter = _rounded_text(value, digits)
        exact = exact.when(shorter.cast("double") == value, shorter)
    exact = exact.otherwise(native)

    def render(text: Column) -> Column:
        plain = F.rtrim(text.cast("decimal(38,22)").cast("string"), F.lit("0"))
        plain = F.when(plain.endswith("."), F.concat(plain, F.lit("0"))).otherwise(plain)
        mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.?0*$", "")
        power = F.substring_index(text, "E", -1).cast("int")
        digits = F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0"))
        scientific = F.concat(mantissa, F.when(power < 0, F.lit("e-")).otherwise(F.lit("e+")), digits)
        size = F.abs(value)
        return (
            F.when(~text.contains("E"), text)
            .when((size >= 1e-4) & (size < 1e16), plain)
            .otherwise(scientific)
        )

    return bind(exact, render)
