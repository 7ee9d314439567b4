"""Text-match scores of listed jobs against the query tokens, from a token index kept as a table.

A field holds a set of tokens, so a match scores the token's inverse document frequency in that field,
``ln(1 + (N - df + 0.5) / (df + 0.5))``; a token given twice in the query counts twice. These weights are computed when
the index is built. It holds one row per job, a hash table of its tokens, and is stored in buckets of the job: scoring lists
moves the lists to the index and never the index.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DoubleType, IntegerType, StringType, StructField, StructType

from rankmill.functions.expressions import bind
from rankmill.sources.catalog import TEXT_INDEX

# Share of all listed positions above which a job is joined by broadcast.
HOT_SHARE = 1 / 256

# Searched fields, in output order.
TEXT_FIELDS = ("description", "job", "others", "management", "name", "product", "profile", "welfare")


def score_column(field: str) -> str:
    return f"text_{field}"


SCORE_COLUMNS = tuple(map(score_column, TEXT_FIELDS))


def field_tokens(docs: DataFrame, key: str = "jobno") -> DataFrame:
    """One row (job, field, tokens) per text that has tokens, each token once.

    ``key`` must be unique in ``docs``.
    """
    present = [name for name in TEXT_FIELDS if name in docs.columns]
    stacked = F.explode(
        F.array(
            *(
                F.struct(F.lit(name).alias("field"), F.array_distinct(F.col(f"{name}.token")).alias("tokens"))
                for name in present
            )
        )
    )
    return (
        docs.select(F.col(key).cast("bigint").alias("job"), stacked.alias("f"))
        .select("job", "f.field", "f.tokens")
        .where(F.size("tokens") > 0)
    )


def postings(index: DataFrame) -> DataFrame:
    """Distinct (field, job, token)."""
    return index.select("field", "job", F.explode("tokens").alias("token"))


def idf_table(index: DataFrame) -> DataFrame:
    """(field, token, df, idf) of the postings of ``field_tokens``."""
    frequency = postings(index).groupBy("field", "token").agg(F.count(F.lit(1)).alias("df"))
    # One row per field: at most len(TEXT_FIELDS) rows, so the broadcast cannot grow with the data.
    sizes = index.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"))
    return frequency.join(F.broadcast(sizes), "field").select("field", "token", "df", _idf().alias("idf"))


def _idf() -> Column:
    return F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))


# Tokens of a block: what one task weighs at a time.
BLOCK_TOKENS = 2_000_000

# Blocks are parts of so many buckets of the job, and so are the buckets of a table that stores the index.
BUCKETS = TEXT_INDEX.buckets

# A job's slots are a part of this many values that tokens are dealt to by hash.
HASHES = 1 << 16


def _hashed(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(HASHES)).cast("int")


def _by_job() -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The function for one block; made here, so that workers need no module of this package."""
    fields, widest = TEXT_FIELDS, HASHES.bit_length() - 1

    def by_job(texts: pa.Table, weights: pa.Table) -> pa.Table:
        """Index rows of a block from its texts (job, field, tokens) and its distinct (in_field, token, hash, idf)."""
        texts, weights = texts.combine_chunks(), weights.combine_chunks()
        ids = texts["job"].combine_chunks().dictionary_encode(null_encoding="encode")
        row_of = ids.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        rows, names, numbers, hashes, idfs = [], [], [], [], []
        for field in pc.unique(weights["in_field"]).to_pylist():
            known = weights.filter(pc.equal(weights["in_field"], field)).combine_chunks()
            lists = pc.equal(texts["field"], field)
            held = texts["tokens"].filter(lists).combine_chunks()
            owner = row_of[lists.to_numpy()]
            tokens = held.flatten()
            at = pc.index_in(tokens, value_set=known["token"].combine_chunks())
            # Only NULL is no token of the block.
            there = pc.is_valid(at)
            at = at.filter(there).to_numpy(zero_copy_only=False)
            names.append(tokens.filter(there).cast(pa.string()))
            each = np.repeat(owner, pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False))
            rows.append(each[there.to_numpy(zero_copy_only=False)])
            number = fields.index(field) + 1 if field in fields else 0
            numbers.append(np.full(len(at), number, dtype=np.int8))
            hashes.append(known["hash"].to_numpy()[at])
            idfs.append(known["idf"].to_numpy()[at])
        row = np.concatenate([np.empty(0, np.int64), *rows])
        # A slot for about four tokens; a power of two, so that hashes are dealt evenly.
        n_tokens = np.bincount(row, minlength=len(ids.dictionary))
        n_slots = 1 << np.minimum(np.ceil(np.log2(np.maximum(n_tokens / 4, 1))).astype(np.int64), widest)
        slot = np.concatenate([np.empty(0, np.int64), *hashes]).astype(np.int64) & (n_slots[row] - 1)
        order = np.lexsort((slot, row))
        first_slot = np.concatenate([[0], np.cumsum(n_slots + 1)])
        filled = np.bincount(first_slot[row] + slot + 1, minlength=first_slot[-1])
        upto = np.concatenate([[0], np.cumsum(n_tokens)])
        # Before a job's first slot stand all tokens of the jobs before it.
        starts = np.cumsum(filled) - np.repeat(upto[:-1], n_slots + 1)

        def listed(offsets: np.ndarray, values: pa.Array) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

        token = pa.chunked_array(names, pa.string()).combine_chunks().take(pa.array(order))
        number = np.concatenate([np.empty(0, np.int8), *numbers])[order]
        idf = np.concatenate([np.empty(0), *idfs])[order]
        columns = {
            "job": ids.dictionary,
            "starts": listed(first_slot, pa.array(starts, pa.int32())),
            "token": listed(upto, token),
            "field": listed(upto, pa.array(number, pa.int8())),
            "idf": listed(upto, pa.array(idf, pa.float64())),
        }
        return pa.table(columns).filter(pa.array(n_tokens > 0))

    return by_job


def weighted_index(index: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(job, starts, token, field, idf) of ``field_tokens``: a hash table of a job's tokens in parallel lists.

    Entries ``starts[s]`` to before ``starts[s + 1]`` are those of slot s: a token, a field that has it and its weight.
    Jobs are dealt to blocks of at most about ``block_tokens`` tokens, each a part of one bucket. A block's distinct tokens go out with their counts and
    come back with their weights; its texts are moved once to be counted and once to be weighed, but no posting is
    moved by itself. ``index`` is read several times, so it should be stored.
    """
    n_tokens = index.agg(F.sum(F.size("tokens"))).first()[0] or 0
    n_blocks = BUCKETS * max(1, -(-n_tokens // (block_tokens * BUCKETS)))
    # The hash by which bucketed tables are written.
    block = F.pmod(F.hash("job"), F.lit(n_blocks)).cast("int").alias("block")
    texts = index.select(block, "job", "field", "tokens")
    counted = texts.repartition("block").select("block", "field", F.explode("tokens").alias("token"))
    counted = counted.where(F.col("token").isNotNull() & F.col("field").isNotNull())
    in_block = counted.groupBy("block", "field", "token").agg(F.count(F.lit(1)).alias("n"))
    # As many rows of a token as there are blocks, at most.
    df = F.sum("n").over(Window.partitionBy("field", "token"))
    # One row per field: at most len(TEXT_FIELDS) rows, so the broadcast cannot grow with the data.
    sizes = index.groupBy("field").agg(F.count(F.lit(1)).alias("n_docs"))
    weights = (
        in_block.withColumn("df", df)
        .join(F.broadcast(sizes), "field")
        # Names of their own: both sides come from the same columns.
        .select(
            F.col("block").alias("of_block"),
            F.col("field").alias("in_field"),
            F.col("token"),
            _hashed(F.col("token")).alias("hash"),
            _idf().alias("idf"),
        )
    )
    made = StructType(
        [
            index.schema["job"],
            StructField("starts", ArrayType(IntegerType())),
            StructField("token", ArrayType(StringType())),
            StructField("field", ArrayType(ByteType())),
            StructField("idf", ArrayType(DoubleType())),
        ]
    )
    return texts.groupBy("block").cogroup(weights.groupBy("of_block")).applyInArrow(_by_job(), made)


def _score_struct(query: Column) -> Column:
    """Eight sums over the query tokens; of a job's entries only those in a token's slot are looked at."""

    def of_token(token: Column) -> Column:
        slot = F.pmod(_hashed(token), F.size("starts") - 1)
        # Entries are looked up by their place, none is copied.
        return bind(
            slot,
            lambda s: F.filter(
                F.when(F.get("starts", s) < F.get("starts", s + 1), F.sequence(F.get("starts", s), F.get("starts", s + 1) - 1)),
                lambda i: F.get("token", i) == token,
            ),
        )

    def total(held: Column, number: int) -> Column:
        added = F.aggregate(
            held, F.lit(0.0), lambda acc, i: acc + F.when(F.get("field", i) == number, F.get("idf", i)).otherwise(0.0)
        )
        return F.coalesce(added, F.lit(0.0)).alias(SCORE_COLUMNS[number - 1])

    found = F.when(F.col("starts").isNotNull(), F.flatten(F.array_compact(F.transform(query, of_token))))
    return bind(found, lambda held: F.struct(*(total(held, i + 1) for i in range(len(TEXT_FIELDS)))))


def _hot_jobs(lists: DataFrame, share: float) -> list[int]:
    """Jobs with more than ``share`` of all positions: fewer than 1 / ``share`` of them."""
    return _hot_positions(lists.select(F.explode("joblist").alias("job")), share)


def _hot_positions(positions: DataFrame, share: float) -> list[int]:
    counted = positions.groupBy("job").agg(F.count(F.lit(1)).alias("n"))
    n_all = positions.agg(F.count(F.lit(1))).first()[0]
    return [row["job"] for row in counted.where((F.col("n") > share * n_all) & F.col("job").isNotNull()).collect()]


def text_field_scores(lists: DataFrame, index: DataFrame, hot_share: float = HOT_SHARE) -> DataFrame:
    """Eight scores per (gid, pos_in_list, job) for ``lists(gid, joblist, tokens)``; no match scores 0.

    ``index`` is a stored ``weighted_index`` in buckets of ``job``, so only the positions are shuffled. Jobs that make
    up more than ``hot_share`` of all positions would fill one bucket's task: fewer than 1 / ``hot_share``, their rows
    of the index are broadcast instead and their positions stay where they are. ``lists`` is read several times, so
    it should be stored.
    """
    positions = lists.select("gid", "tokens", F.posexplode("joblist").alias("pos_in_list", "job"))
    scored = _scored(positions, index, _hot_jobs(lists, hot_share))
    return scored.select("gid", "pos_in_list", "job", "text_score.*")


def _scored(positions: DataFrame, index: DataFrame, hot: list[int]) -> DataFrame:
    """``positions`` with ``text_score`` for their ``tokens``; without hot jobs they are left in the index's buckets."""
    rows = index.select("job", "starts", "token", "field", "idf")
    if hot:
        is_hot = F.coalesce(F.col("job").isin(hot), F.lit(False))
        few = F.broadcast(rows.where(F.col("job").isin(hot)))
        joined = positions.where(~is_hot).join(rows.hint("merge"), "job", "left").unionByName(
            positions.where(is_hot).join(few, "job", "left")
        )
    else:
        joined = positions.join(rows.hint("merge"), "job", "left")
    return joined.select(*positions.columns, _score_struct(F.col("tokens")).alias("text_score"))


def with_position_scores(exploded: DataFrame, index: DataFrame, hot_share: float = HOT_SHARE) -> DataFrame:
    """Add ``text_score`` to exploded lists (``job``, ``tokens`` and any other columns), a row per position.

    The rows move once, to the index, and nothing is put together again by list, so ids may repeat. What later steps
    join by job finds the rows in the index's buckets. ``exploded`` is read several times, so its lists should be stored.
    """
    return _scored(exploded, index, _hot_positions(exploded, hot_share))


def with_text_scores(grouped: DataFrame, index: DataFrame) -> DataFrame:
    """Add ``text_score`` to every item of ``job_rel_list``, matched by list position.

    Only ids, lists and tokens go through the scoring shuffles; the wide rows move once, unexploded. Where the lists are
    exploded anyway, ``with_position_scores`` moves less.
    ``grouped`` is read several times, so it should be stored.
    """
    scores = text_field_scores(grouped.select("gid", "joblist", "tokens"), index)
    per_list = scores.groupBy("gid").agg(
        F.array_sort(
            F.collect_list(F.struct("pos_in_list", F.struct(*SCORE_COLUMNS).alias("text_score")))
        ).alias("_scores")
    )
    scored_item = F.zip_with(
        "job_rel_list",
        F.col("_scores.text_score"),
        lambda item, score: F.struct(
            item["job"].alias("job"),
            item["rel"].alias("rel"),
            item["action"].alias("action"),
            score.alias("text_score"),
        ),
    )
    return grouped.join(per_list, "gid", "left").withColumn("job_rel_list", scored_item).drop("_scores")
