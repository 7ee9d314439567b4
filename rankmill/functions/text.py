"""Text cleaning and tokenizing as native column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from rankmill.functions.expressions import bind, named

# The full-width block U+FF00..U+FF5E sits 0xFEE0 above U+0020..U+007E; U+3000 is a blank.
_FULLWIDTH = "".join(map(chr, range(0xFF00, 0xFF5F))) + "　"
_HALFWIDTH = "".join(map(chr, range(0x0020, 0x007F))) + " "

# Patterns. (?d) limits "." to \n as line end; (?U) makes \s and \S follow Unicode.
_CHAR_REPEAT = r"(?d)(.)\1+"
_WORD_REPEAT = r"(?U)(\S{2,}?)\1+"
# Pieces of at most half of _LONG characters, all that a shorter stretch without blanks can repeat.
_LONG = 128
_SHORT_REPEAT = rf"(?U)(\S{{2,{_LONG // 2}}}?)\1+"
_LONG_STRETCH = rf"(?U)\S{{{_LONG + 1},}}"
_HAS_LONG_STRETCH = rf"(?U)(?:^|\s)\S{{{_LONG + 1}}}"
# Distances between equal stretches that are tried one by one; with more, every length is.
_DISTANCES = 8
_EDGE_SPACE = r"(?U)^\s+|\s+$"
_TOKEN = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+"
# Words keep signs between their letters, a dot before them and plus or number signs after: .NET, C++, F&B.
_SIGNED = r"\p{IsHan}|\.?[\p{L}\p{N}&&[^\p{IsHan}]]+(?:[.&+#-][\p{L}\p{N}&&[^\p{IsHan}]]+)*[+#]*"
_TOKEN_RUN = r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"


@named
def to_halfwidth(text: Column) -> Column:
    """Full-width forms to ASCII, ideographic blank to blank."""
    return F.translate(text, _FULLWIDTH, _HALFWIDTH)


@named
def to_lower(text: Column) -> Column:
    return F.lower(text)


def _recurring(stretch: Column) -> Column:
    """What lies between equal pieces of half of _LONG characters: their distances, and -1 where one comes thrice.

    A piece longer than that can only repeat at such a distance, as its beginning comes again there.
    """

    def places(chars: Column) -> Column:
        size = F.lit(_LONG // 2)
        starts = F.sequence(F.lit(1), F.size(chars) - size + 1)
        hashed = lambda at: F.struct(F.xxhash64(F.slice(chars, at, size)).alias("h"), at.alias("at"))
        return F.array_sort(F.transform(starts, hashed))

    def distances(found: Column) -> Column:
        pairs = F.zip_with(
            found,
            F.slice(found, 2, F.size(found)),
            lambda a, b: F.when(a["h"] == b["h"], b["at"] - a["at"]),
        )
        thrice = F.zip_with(pairs, F.slice(pairs, 2, F.size(pairs)), lambda a, b: F.when((a > 0) & (b > 0), -1))
        return F.array_distinct(F.array_compact(F.concat(pairs, thrice)))

    # By code points: splitting on nothing would cut those outside the basic plane in two.
    return bind(F.regexp_extract_all(stretch, F.lit("(?s)."), F.lit(0)), lambda c: bind(places(c), distances))


def _repeat_pattern(text: Column) -> Column:
    """The pattern of repeated pieces that needs no more lengths than this text has.

    Trying every length at every place takes a time quadratic in a stretch without blanks. Short stretches only need
    short pieces; in a long one, a long piece can only repeat at a distance of equal stretches, mostly none.
    """

    def chosen(distances: Column) -> Column:
        far = F.array_sort(F.filter(distances, lambda d: d > _LONG // 2))
        each = F.transform(
            far, lambda d, i: F.concat(F.lit(r"|(\S{"), d.cast("string"), F.lit("})\\"), (i + 2).cast("string"), F.lit("+"))
        )
        few = F.concat(F.lit(_SHORT_REPEAT), F.array_join(each, ""))
        every = F.array_contains(distances, -1) | (F.size(far) > _DISTANCES)
        return F.when(every, F.lit(_WORD_REPEAT)).otherwise(few)

    stretches = F.regexp_extract_all(text, F.lit(_LONG_STRETCH), F.lit(0))
    long = bind(F.array_distinct(F.flatten(F.transform(stretches, _recurring))), chosen)
    return F.when(text.rlike(_HAS_LONG_STRETCH), long).otherwise(F.lit(_SHORT_REPEAT))


@named
def rm_repeat(text: Column) -> Column:
    """Runs of one character shrink to two; immediate repeats of a longer piece shrink to one."""
    once = F.regexp_replace(text, _CHAR_REPEAT, "$1$1")

    def shrunk(value: Column) -> Column:
        pattern = _repeat_pattern(value)
        # Only the group that matched has a text.
        groups = F.regexp_count(pattern, F.lit(r"\(\\S"))
        kept = F.array_join(F.transform(F.sequence(F.lit(1), groups), lambda i: F.concat(F.lit("$"), i.cast("string"))), "")
        return F.regexp_replace(value, pattern, kept)

    return bind(once, shrunk)


def strip(text: Column) -> Column:
    """Trim every Unicode blank, not only U+0020."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


@named
def simple_clean(text: Column) -> Column:
    """One line, half-width, without long repeats, lower case, trimmed. NULL stays NULL."""
    one_line = F.translate(text, "\n\r", " ")
    return strip(to_lower(rm_repeat(to_halfwidth(one_line))))


def _with_bigrams(run: Column) -> Column:
    chars = F.split(run, "")
    pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substr(run, i, F.lit(2)))
    return F.when(run.rlike(r"^\p{IsHan}{2,}$"), F.concat(chars, pairs)).otherwise(F.array(run))


@named
def tokenize(
    text: Column, char_map: Mapping[str, str] | None = None, han_bigrams: bool = False, signs: bool = False
) -> Column:
    """Tokens in text order, duplicates kept: words, and single Han characters.

    ``char_map`` replaces characters first (for instance traditional to simplified forms);
    ``han_bigrams`` also emits each pair of neighbouring Han characters, as a search index would. With ``signs`` a
    word keeps the signs that are part of names (``C++``, ``C#``, ``.NET``, ``F&B``, ``full-time``); the two exclude
    each other.
    """
    if signs and han_bigrams:
        raise ValueError("signs and han_bigrams exclude each other")
    if char_map:
        text = F.translate(text, "".join(char_map), "".join(char_map.values()))
    if not han_bigrams:
        return F.regexp_extract_all(text, F.lit(_SIGNED if signs else _TOKEN), F.lit(0))
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_TOKEN_RUN), F.lit(0)), _with_bigrams))


@named
def tokenize_to_struct(text: Column, **options) -> Column:
    """``{keyword, token[]}``: the text as given, and the non-empty tokens of its cleaned form."""
    tokens = F.filter(tokenize(simple_clean(text), **options), lambda token: F.length(token) > 0)
    return F.struct(text.alias("keyword"), tokens.alias("token"))
