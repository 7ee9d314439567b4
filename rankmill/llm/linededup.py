"""Line dedup across documents, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The blanks that are stripped, and the letters that are lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; the plain function where a text has only one-byte characters."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _digest(value: Column) -> list[Column]:
    """128 bits as two differently seeded hashes."""
    return [F.xxhash64(F.lit(1), value).alias("h1"), F.xxhash64(F.lit(2), value).alias("h2")]


def dedup_lines(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    max_documents: int = 1,
) -> DataFrame:
    """Drop lines whose key is in more than ``max_documents`` documents, except in the smallest id holding it.

    Returns the input's columns with ``text_col`` replaced by the kept lines joined by a newline, plus
    ``n_lines`` and ``n_dropped``; columns of these two names are replaced.

    A line's key is the line without blanks at both ends, A-Z lower-cased; keys of fewer than ``min_chars``
    code points are never dropped. A null or empty text is one empty line. All lines with a key stay in its
    smallest document, repeats too. Rows that share an id count as one document; equal rows are cleaned alike
    and all stay. A row with a null id keeps all its lines and counts nowhere.

    Lines are counted by two partial aggregations, so a line that is everywhere meets no single task as rows.
    Every text moves once, to meet the positions of its dropped lines.
    """
    given = documents.drop("n_lines", "n_dropped")
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = line_key(F.col("_line"))
    entries = (
        documents.select(F.col(id_col).alias("_id"), text.alias("_text"))
        .where("_id is not null")
        .select("_id", F.xxhash64("_text").alias("_row"), F.posexplode(F.split("_text", "\n")).alias("_pos", "_line"))
        .select("_id", "_row", "_pos", key.alias("_key"))
        .where(F.char_length("_key") >= min_chars)
        .select("_id", "_row", "_pos", *_digest(F.col("_key")))
    )
    if max_documents == 1:
        # In two documents or more: the smallest and the greatest id differ.
        shared = entries.groupBy("h1", "h2").agg(F.min("_id").alias("_keeper"), F.max("_id").alias("_last"))
        shared = shared.where("_keeper < _last")
    else:
        holders = entries.groupBy("h1", "h2", "_id").agg(F.lit(1).alias("_one"))
        shared = holders.groupBy("h1", "h2").agg(F.min("_id").alias("_keeper"), F.count("_id").alias("_n"))
        shared = shared.where(F.col("_n") > max_documents)
    dropped = (
        entries.join(shared.select("h1", "h2", "_keeper"), ["h1", "h2"])
        .where("_id > _keeper")
        # Bounded by the lines of one text.
        .groupBy("_id", "_row")
        .agg(F.collect_set("_pos").alias("_drop"))
    )
    # The lines are cut below the join, so that picking one by position does not cut the text again.
    others = [F.col(c) for c in given.columns if c != text_col]
    cut = given.select(
        F.struct(*others).alias("_other"), F.split(text, "\n").alias("_lines"), F.col(id_col).alias("_own"),
        F.xxhash64(text).alias("_hash"),
    )
    joined = cut.join(dropped, (F.col("_own") == F.col("_id")) & (F.col("_hash") == F.col("_row")), "left")
    every = F.sequence(F.lit(0), F.size("_lines") - 1)
    # Kept positions in their order, then the lines there.
    kept = F.transform(F.array_except(every, F.col("_drop")), lambda p: F.get("_lines", p))
    whole = F.array_join(F.when(F.col("_drop").isNull(), F.col("_lines")).otherwise(kept), "\n")
    return joined.select(
        *(whole.alias(c) if c == text_col else F.col("_other")[c].alias(c) for c in given.columns),
        F.size("_lines").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )
