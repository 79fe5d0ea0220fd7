"""Exact deduplication with a heavy-hitter split. [native]

Every row is reduced to its text's SHA-256 digest, its doc_id and a hash of its
other columns; this slim table is written once.  Misra-Gries counters (Spark's
frequent-items sketch: a bounded table of counters, all lowered when it is
full) run over it a partition at a time and are merged in two steps, so that
every digest with more than a ``SHARE`` of the rows is a candidate.  A second
pass counts the candidates exactly, combining before its shuffle, and verifies
them: only digests that really hold that share, at most 1 / SHARE by
arithmetic, become winners and are broadcast.  Their rows are settled where
they are read.  All other digests, none of which has that share, take an
ordinary shuffle.

Of equal texts the row with the largest doc_id stays; among rows with that
doc_id the one with the largest hash of its other columns, and of rows alike in
everything one.

Nulls and odd input.  A null text counts as empty.  A null doc_id is smaller
than any other.  Repeated rows are separate rows of a group, of which one
stays.  Long texts are digested whole.  Extra columns only break ties (maps by
their sorted entries), and ``deduplicated`` keeps them.  An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import hash_of_row, staged

#: A digest with this share of all rows, and two rows, is settled by broadcast.
SHARE = 1 / 4000
#: Counters of a sketch; it lists whatever has over 7 / 32,768 of the rows, less than SHARE.
COUNTERS = 16384
#: Groups of partitions whose sketches are merged before all of them are.
MERGES = 64


def same(text: Column) -> Column:
    """No change: texts are equal when identical."""
    return text


def _body(normalise: Callable[[Column], Column]) -> Column:
    return F.coalesce(normalise(F.col("text")), F.lit("")).cast("binary")


def _digest(normalise: Callable[[Column], Column]) -> Column:
    return F.unhex(F.sha2(_body(normalise), 256))


def candidates(rows: DataFrame, key: str = "h") -> DataFrame:
    """One column ``key``: every value that may hold a SHARE of the rows."""
    once = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("g")).agg(F.expr(f"approx_top_k_accumulate({key}, {COUNTERS})").alias("s"))
    # grouped, since a combination over a partition without sketches fails
    twice = once.groupBy(F.pmod("g", F.lit(1))).agg(F.expr(f"approx_top_k_combine(s, {COUNTERS})").alias("s"))
    return twice.select(F.expr(f"inline(approx_top_k_estimate(s, {COUNTERS}))")).select(F.col("item").alias(key))


def winners(rows: DataFrame) -> DataFrame:
    """digest, best, group_size of the digests that hold a SHARE of the rows.

    rows: digest, best (a struct whose largest stays).  The sketch runs over
    64-bit hashes of digests; a candidate's rows are grouped by whole digests."""
    least = max(2, -(-rows.count() * SHARE // 1))
    maybe = candidates(rows.select(F.xxhash64("digest").alias("h"))).select(F.col("h").alias("_h"))
    counted = rows.join(F.broadcast(maybe), F.xxhash64("digest") == F.col("_h"), "left_semi").groupBy("digest")
    return counted.agg(F.max("best").alias("best"), F.count("*").alias("group_size")).where(F.col("group_size") >= least)


def find(docs: DataFrame, normalise: Callable[[Column], Column] = same) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, heavy: one row for each
    document, dropped ones too; heavy tells by which of the two ways."""
    slim = docs.select("doc_id", _digest(normalise).alias("digest"), hash_of_row(docs, ("doc_id", "text")).alias("tie"), F.monotonically_increasing_id().alias("row"))
    # the row's number is fixed by what is written here
    slim = staged(slim, "digests").select("digest", F.struct("doc_id", "tie", "row").alias("best"))
    heavy = staged(winners(slim), "winners").withColumnRenamed("best", "top")
    met = slim.join(F.broadcast(heavy), "digest", "left")
    group = Window.partitionBy("digest")
    rest = met.where(F.col("top").isNull()).select("digest", "best", F.max("best").over(group).alias("top"), F.count("*").over(group).alias("group_size"), F.lit(False).alias("heavy"))
    both = met.where(F.col("top").isNotNull()).select("digest", "best", "top", "group_size", F.lit(True).alias("heavy")).unionByName(rest)
    return both.select(
        F.col("best.doc_id").alias("doc_id"),
        F.col("top.doc_id").alias("keep_id"),
        "group_size",
        (F.col("best.row") == F.col("top.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "heavy",
    )


def deduplicated(docs: DataFrame, normalise: Callable[[Column], Column] = same) -> DataFrame:
    """The documents that stay, with their own columns."""
    named = docs.withColumns({"__exact_digest": _digest(normalise), "__exact_best": F.struct("doc_id", hash_of_row(docs, ("doc_id", "text")).alias("tie"))})
    slim = staged(named.select(F.col("__exact_digest").alias("digest"), F.col("__exact_best").alias("best")), "digests")
    heavy = staged(winners(slim), "winners").select(F.col("digest").alias("__exact_digest"), F.col("best").alias("__exact_top"))
    met = named.join(F.broadcast(heavy), "__exact_digest", "left")
    hot = met.where(F.col("__exact_best") == F.col("__exact_top")).dropDuplicates(["__exact_digest"])  # alike in all columns
    by = Window.partitionBy("__exact_digest").orderBy(F.desc("__exact_best"))
    cold = met.where(F.col("__exact_top").isNull()).withColumn("__exact_rank", F.row_number().over(by)).where(F.col("__exact_rank") == 1)
    return hot.select(*docs.columns).unionByName(cold.select(*docs.columns))
